"""Pairing main documents with compulsory ones, one to one, by an explainable score.

Candidates are never listed document by document, nor class by class. Documents that agree in a set of facts (of VIN, plate,
file plate, name and car: each subset that can make a candidate is a star of its own) and have one year and file year form a
star class, and a candidate is an edge between two star classes. A pair that agrees in exactly that set has that edge's score; a pair
that agrees in more facts has further edges of higher scores, and its lower ones change nothing. So a plate and a year on
any number of documents with all different names is one edge, and names count only where two are alike.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerloom.functions import dates as D, text as X
from ledgerloom.functions.filenames import with_archive_name
from ledgerloom.functions.similarity import ratio_bound, sequence_ratio
from ledgerloom.operators.extract import vin_candidates
from ledgerloom.operators.linkage import contained_either_way
from ledgerloom.operators.windows import keyed_positions, keyed_running
from ledgerloom.session import cut_lineage

# Points per fact and thresholds.
POINTS = {"vin": 50, "plate": 30, "year": 15, "name": 10, "car": 5, "file_plate": 25, "file_year": 5}
REVIEW_FROM, AUTO_FROM, LEAST_MARGIN, NAME_RATIO = 30, 50, 15, 0.85
FACTS = ["vin", "plate", "year", "name", "car", "file_plate", "file_year"]


def with_facts(docs: DataFrame) -> DataFrame:
    """Adds vin, plate, year, name, car, file_plate, file_year (null when unknown) and ``flagged``.

    Documents: chassis_no, license_plate, coverage_start, insured_name, car_make, car_model, car, orig_filename,
    requires_review, parse_error, review_fields.
    """
    read = with_archive_name(docs.withColumn("_file", F.coalesce("orig_filename", F.lit(""))), "_file")
    is_plate = F.col("kind") == "plate"
    known = lambda c: F.nullif(c, F.lit(""))
    return read.withColumns(
        {
            "vin": known(X.vin_key("chassis_no")),
            "plate": known(X.plate_key("license_plate")),
            "year": D.coverage_year("coverage_start"),
            "name": known(X.name_key("insured_name")),
            "car": known(X.car_key("car_make", "car_model", "car")),
            "file_plate": F.when(is_plate, X.plate_key("key")),
            "file_year": F.when(is_plate, F.col("year_be")),
            "flagged": F.coalesce("requires_review", F.lit(False))
            | (F.length(F.coalesce("parse_error", F.lit(""))) > 0)
            | (F.coalesce(F.size("review_fields"), F.lit(0)) > 0),
        }
    ).drop("_file", "kind", "key", "number", "suffix", "year_be")


def similar_names(mains: DataFrame, prbs: DataFrame) -> DataFrame:
    """Distinct (main_name, prb_name) with a ratio of at least 0.85.

    With T characters in both names, such a pair shares at least 0.275 T - 1 bigrams (repeats counted apart), and T is
    at least 1.739 times either length. So among each name's rarest bigrams, all but that many plus one, the two have
    one in common: prefix filtering, which leaves the common bigrams out of the join.
    """
    m = mains.select(F.col("name").alias("text")).filter("text is not null").distinct()
    p = prbs.select(F.col("name").alias("text")).filter("text is not null").distinct()

    def bigrams(df: DataFrame) -> DataFrame:
        at = F.sequence(F.lit(1), F.length("text") - 1)
        pieces = df.filter(F.length("text") >= 2).select("text", F.explode(F.transform(at, lambda i: F.substring(F.col("text"), i, F.lit(2)))).alias("b"))
        return pieces.groupBy("text", "b").agg(F.count("*").alias("n")).select(
            "text", F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.concat("b", F.lit("#"), i.cast("string")))).alias("gram")
        )

    gm, gp = bigrams(m), bigrams(p)
    weight = gm.unionByName(gp).groupBy("gram").agg(F.count("*").alias("w"))

    def rarest(grams: DataFrame) -> DataFrame:
        size = F.length("text")
        needed = F.greatest(F.floor(size * 1.739 * 0.275 - 1), F.lit(1))
        place = F.row_number().over(W.partitionBy("text").orderBy("w", "gram"))
        return grams.join(weight, "gram").withColumn("_r", place).filter(F.col("_r") <= (size - 1) - needed + 1).select("text", "gram")

    blocked = (
        rarest(gm).withColumnRenamed("text", "main_name").join(rarest(gp).withColumnRenamed("text", "prb_name"), "gram")
        .select("main_name", "prb_name").distinct()
    )
    a, b = F.length("main_name"), F.length("prb_name")
    blocked = blocked.filter((F.col("main_name") != F.col("prb_name")) & (2 * F.least(a, b) >= NAME_RATIO * (a + b)))
    blocked = blocked.filter(ratio_bound("main_name", "prb_name") >= NAME_RATIO - 1e-9)
    close = blocked.filter(sequence_ratio("main_name", "prb_name") >= NAME_RATIO)
    equal = m.join(p, "text", "left_semi").select(F.col("text").alias("main_name"), F.col("text").alias("prb_name"))
    return equal.unionByName(close.select("main_name", "prb_name"))


def _effective(side: DataFrame, other: DataFrame, liked: dict[str, DataFrame]) -> DataFrame:
    """Drop facts nothing on the other side answers. A VIN without a partner still conflicts with any other VIN."""
    answers = {f: other.select(f).filter(F.col(f).isNotNull()) for f in ("vin", "plate", "file_plate")} | liked
    out = side
    for fact, answer in answers.items():
        there = answer.distinct().select(F.col(fact).alias("_key"), F.lit(True).alias("_there"))
        lone = F.lit("*") if fact == "vin" else F.lit(None).cast("string")
        # rows without the fact get a key of their own, so that they don't meet in one task
        out = out.withColumn("_key", F.coalesce(F.col(fact), F.concat(F.lit("\0"), F.col("doc_id").cast("string")))).join(there, "_key", "left")
        out = out.withColumn(fact, F.when(F.col("_there"), F.col(fact)).when(F.col(fact).isNotNull(), lone)).drop("_key", "_there")
    return out.withColumn("file_year", F.when(F.col("file_plate").isNotNull(), F.col("file_year")))


# Facts two documents can agree in; a set of them that can't reach the review score with years equal makes no candidate.
STAR_FACTS = ["vin", "plate", "file_plate", "name", "car"]


def _points(set_: tuple[str, ...], same_year: bool, same_file_year: bool) -> int:
    more = POINTS["year"] * same_year + POINTS["file_year"] * (same_file_year and "file_plate" in set_)
    return sum(POINTS[f] for f in set_) + more


STARS = [s for n in range(1, 6) for s in combinations(STAR_FACTS, n) if _points(s, True, True) >= REVIEW_FROM]


def _star_rows(side: DataFrame, name: str) -> DataFrame:
    """A row per document and star it belongs to: the star's number, its facts, and what else decides its edges."""
    stars = []
    for k, set_ in enumerate(STARS):
        here = [f"{f} IS NOT NULL" for f in set_] + ["vin <> '*'"] * ("vin" in set_) + ["year IS NOT NULL"] * (_points(set_, False, True) < REVIEW_FROM)
        facts = [f"'{f}', " + (f if f in set_ else "cast(NULL AS string)") for f in STAR_FACTS]
        file_year = "file_year" if "file_plate" in set_ else "cast(NULL AS int)"
        has_vin = "false" if "vin" in set_ else "vin IS NOT NULL"
        stars.append(f"CASE WHEN {' AND '.join(here)} THEN named_struct('star', {k}, {', '.join(facts)}, 'year', year, 'file_year', {file_year}, 'has_vin', {has_vin}) END")
    spread = side.select("doc_id", "pos", F.expr(f"explode(array_compact(array({', '.join(stars)})))").alias("s")).select("doc_id", "pos", "s.*")
    key = F.sha2(F.to_json(F.struct("star", *STAR_FACTS, "year", "file_year", "has_vin"), {"ignoreNullFields": "false"}), 256)
    return spread.withColumn("cls", F.concat(F.lit(name), key))


def _star_edges(m_rows: DataFrame, p_rows: DataFrame, names: DataFrame, cars: DataFrame) -> DataFrame:
    """Edges of at least the review score: star, m_cls, p_cls, m_n, p_n, same_year, same_file_year, score.

    One equi-join: on the star and its facts (a main's name stands for each name it is like, its car for each that
    contains it or is contained), with marks for year and VIN. A main without a year meets mark A, which every document of
    the other side carries; with one it meets that year and mark N (no year). A document with a VIN that is no fact of the
    star meets only those without.
    """
    facts = ["star", *STAR_FACTS, "year", "file_year", "has_vin"]
    mc, pc = (rows.groupBy("cls", *facts).agg(F.count("*").alias("n")) for rows in (m_rows, p_rows))
    for fact, like in (("name", names), ("car", cars)):
        other = like.select(F.col(f"main_{fact}").alias(fact), F.col(f"prb_{fact}").alias("_like"))
        told = mc.filter(F.col(fact).isNotNull()).join(other, fact).withColumn(fact, F.col("_like")).drop("_like")
        mc = mc.filter(F.col(fact).isNull()).unionByName(told)
    year = F.col("year").cast("string")
    m_years = F.when(year.isNull(), F.array(F.lit("A"))).otherwise(F.array(year, F.lit("N")))
    p_years = F.array(F.lit("A"), F.coalesce(year, F.lit("N")))
    m_vins = F.array(F.when(F.col("has_vin"), F.lit("B")).otherwise(F.lit("A")))
    p_vins = F.when(F.col("has_vin"), F.array(F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("B")))

    def keyed(df: DataFrame, side: str, years: Column, vins: Column) -> DataFrame:
        own = [F.col(c).alias(f"{side}_{c}") for c in ("cls", "n", "year", "file_year")]
        on = F.to_json(F.struct("star", *STAR_FACTS))
        return df.select(*own, "star", on.alias("_on"), F.explode(years).alias("_y"), vins.alias("_v")).withColumn("_v", F.explode("_v"))

    pairs = keyed(mc, "m", m_years, m_vins).join(keyed(pc, "p", p_years, p_vins).drop("star"), ["_on", "_y", "_v"])
    same = lambda f: F.coalesce(F.col(f"m_{f}") == F.col(f"p_{f}"), F.lit(False))
    return _scored(pairs.select("star", "m_cls", "p_cls", "m_n", "p_n", same("year").alias("same_year"), same("file_year").alias("same_file_year")))


def _scored(rows: DataFrame) -> DataFrame:
    """``score`` of star and marks, from the review score on."""
    facts = F.get(F.array(*[F.lit(_points(s, False, False)) for s in STARS]), F.col("star"))
    year, file_year = F.when(F.col("same_year"), POINTS["year"]).otherwise(0), F.when(F.col("same_file_year"), POINTS["file_year"]).otherwise(0)
    return rows.withColumn("score", facts + year + file_year).filter(F.col("score") >= REVIEW_FROM)


def _level_pairs(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(m_doc, p_doc): what one pass in the order (main position, compulsory position) takes among edges of one score.

    Documents with the same edges of this score form a unit. In a round a unit's best partner is the one whose next free
    member comes first; two units that name each other are matched member by member for as long as no other partner of
    either has an earlier member. Each such pair precedes all others at either end. A round reads the members that are
    still free and have an edge.
    """
    asked = edges.select(F.explode(F.array("m_cls", "p_cls")).alias("cls")).distinct()
    held = rows.join(asked, "cls", "left_semi").groupBy("doc_id", "pos").agg(F.array_sort(F.collect_set("cls")).alias("_all"))
    held = held.withColumn("unit", F.when(F.size("_all") == 1, F.get("_all", F.lit(0))).otherwise(F.sha2(F.concat_ws(",", "_all"), 256)))
    members = cut_lineage(keyed_positions(held, ["unit"], ["pos"], "rank"))
    classes = members.groupBy("unit").agg(F.first("_all").alias("_all")).select("unit", F.explode("_all").alias("cls"))
    of = lambda side: classes.withColumnsRenamed({"unit": f"{side}_unit", "cls": f"{side}_cls"})
    links = cut_lineage(edges.select("m_cls", "p_cls").join(of("m"), "m_cls").join(of("p"), "p_cls").select("m_unit", "p_unit").distinct())
    members, taken = members.drop("_all"), []
    while True:
        heads = members.groupBy("unit").agg(F.min("pos").alias("head"), F.min("rank").alias("from"))
        both = links.select(F.explode(F.array(F.struct(F.col("m_unit").alias("unit"), F.col("p_unit").alias("other")), F.struct(F.col("p_unit").alias("unit"), F.col("m_unit").alias("other")))).alias("l")).select("l.*")
        seen = both.join(heads.select(F.col("unit").alias("other"), "head"), "other")
        best = seen.groupBy("unit").agg(F.min(F.struct("head", "other")).alias("_best"))
        rival = seen.join(best, "unit").groupBy("unit").agg(F.first("_best.other").alias("other"), F.min(F.when(F.col("other") != F.col("_best.other"), F.col("head"))).alias("rival"))
        choice = rival.join(heads.select("unit", "from"), "unit")
        back = choice.select(F.col("unit").alias("other"), F.col("other").alias("unit"), F.col("from").alias("other_from"), F.col("rival").alias("other_rival"))
        mutual = choice.join(back, ["unit", "other"]).join(links.select(F.col("m_unit").alias("unit"), F.col("p_unit").alias("other")), ["unit", "other"], "left_semi")
        ends = F.array(F.struct(F.lit(True).alias("is_m"), "unit", "from", F.col("other_rival").alias("until")), F.struct(F.lit(False).alias("is_m"), F.col("other").alias("unit"), F.col("other_from").alias("from"), F.col("rival").alias("until")))
        matched = cut_lineage(mutual.select(F.concat("unit", F.lit("/"), "other").alias("pair"), F.explode(ends).alias("e")).select("pair", "e.*"))
        near = members.join(matched, "unit").filter(F.col("until").isNull() | (F.col("pos") < F.col("until"))).withColumn("_k", F.col("rank") - F.col("from"))
        run = lambda is_m, name: near.filter(F.col("is_m") == is_m).select("pair", "_k", F.col("doc_id").alias(name))
        step = cut_lineage(run(True, "m_doc").join(run(False, "p_doc"), ["pair", "_k"]).select("m_doc", "p_doc"))
        taken.append(step)
        left = members.join(step.select(F.explode(F.array("m_doc", "p_doc")).alias("doc_id")), "doc_id", "left_anti")
        open_ = left.select("unit").distinct()
        links = cut_lineage(
            links.join(open_.withColumnRenamed("unit", "m_unit"), "m_unit", "left_semi").join(open_.withColumnRenamed("unit", "p_unit"), "p_unit", "left_semi")
        )
        if links.isEmpty():
            return reduce(DataFrame.unionByName, taken)
        linked = links.select(F.explode(F.array("m_unit", "p_unit")).alias("unit")).distinct()
        members = cut_lineage(left.join(linked, "unit", "left_semi"))


def _assigned(edges: DataFrame, m_rows: DataFrame, p_rows: DataFrame) -> DataFrame:
    """(m_doc, p_doc, score) of one greedy pass in the order (score down, main position, compulsory position): a level
    after the other, each among the documents that higher ones left. There are at most as many levels as sums of points."""
    asked = edges.select(F.explode(F.array("m_cls", "p_cls")).alias("cls")).distinct()
    rows = cut_lineage(m_rows.select("cls", "doc_id", "pos").unionByName(p_rows.select("cls", "doc_id", "pos")).join(asked, "cls", "left_semi"))
    out, score = [], None
    while True:
        free = rows.select("cls").distinct()
        alive = edges if score is None else edges.filter(F.col("score") < score)
        alive = alive.join(free.withColumnRenamed("cls", "m_cls"), "m_cls", "left_semi").join(free.withColumnRenamed("cls", "p_cls"), "p_cls", "left_semi")
        score = alive.agg(F.max("score")).first()[0]
        if score is None:
            break
        found = _level_pairs(edges.filter(F.col("score") == score), rows)
        out.append(found.withColumn("score", F.lit(score)))
        rows = cut_lineage(rows.join(found.select(F.explode(F.array("m_doc", "p_doc")).alias("doc_id")), "doc_id", "left_anti"))
    none = edges.select(F.col("m_cls").alias("m_doc"), F.col("p_cls").alias("p_doc"), "score").limit(0)
    return reduce(DataFrame.unionByName, out) if out else none


def _best_others(picked: DataFrame, edges: DataFrame, rows: DataFrame, partners: DataFrame, side: str, other: str) -> DataFrame:
    """For each picked pair the best score of another candidate of its ``side`` document.

    Of a class's edges the two best towards different classes suffice: the better one counts unless the partner is its
    only document, which leaves the other."""
    own, far = f"{side}_cls", f"{other}_cls"
    top = edges.groupBy(own).agg(F.max(F.struct("score", far, f"{other}_n")).alias("_top"))
    below = edges.join(top, own).filter(F.col(far) != F.col(f"_top.{far}")).groupBy(own).agg(F.max("score").alias("_below"))
    # an edge of the partner at the top score is known by its class
    best = top.join(below, own, "left").select(F.col(own).alias("cls"), F.col("_top.score").alias("_score"), F.col(f"_top.{far}").alias("_far"), F.col(f"_top.{other}_n").alias("_n"), "_below")
    mine = picked.select(f"{side}_doc", f"{other}_doc").join(rows.select(F.col("doc_id").alias(f"{side}_doc"), "cls"), f"{side}_doc").join(best, "cls")
    in_top = partners.select(F.col("doc_id").alias(f"{other}_doc"), F.col("cls").alias("_far"), F.lit(True).alias("_in"))
    alone = F.coalesce(F.col("_in"), F.lit(False)) & (F.col("_n") == 1)
    score = F.when(alone, F.col("_below")).otherwise(F.col("_score"))
    return mine.join(in_top, [f"{other}_doc", "_far"], "left").groupBy(f"{side}_doc").agg(F.max(score).alias(f"_{side}_other"))


def _stars(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Star rows of mains and of compulsory documents, the edges between their classes, and like names."""
    keep = ["doc_id", "pos", *FACTS]
    rows = cut_lineage(docs.filter(F.col("doc_type").isin("motor_main", "motor_prb")).select("doc_type", *keep))
    mains, prbs = (rows.filter(F.col("doc_type") == t).select(*keep) for t in ("motor_main", "motor_prb"))
    names = cut_lineage(similar_names(mains, prbs))
    distinct = lambda side, name: side.filter("car <> ''").select(F.col("car").alias(name)).distinct()
    cars = contained_either_way(distinct(mains, "key"), distinct(prbs, "text"))
    cars = cut_lineage(cars.select(F.col("key").alias("main_car"), F.col("text").alias("prb_car")))
    m_rows = cut_lineage(_star_rows(_effective(mains, prbs, {"name": names.select(F.col("main_name").alias("name")), "car": cars.select(F.col("main_car").alias("car"))}), "m"))
    p_rows = cut_lineage(_star_rows(_effective(prbs, mains, {"name": names.select(F.col("prb_name").alias("name")), "car": cars.select(F.col("prb_car").alias("car"))}), "p"))
    return m_rows, p_rows, cut_lineage(_star_edges(m_rows, p_rows, names, cars)), names


def candidate_edges(docs: DataFrame) -> DataFrame:
    """Edges between star classes: star (its number in STARS), m_cls, p_cls, m_n and p_n (their documents), score."""
    return _stars(docs)[2]


def candidate_counts(docs: DataFrame) -> DataFrame:
    """How many pairs of documents have each score (score, pairs), without listing a pair: pairs that agree in at least a
    set of facts are counted by its edges, those that agree in exactly it by inclusion and exclusion over larger sets. Pairs
    that agree in the VIN are in no set without it."""
    edges = candidate_edges(docs)
    at_least = edges.groupBy("star", "same_year", "same_file_year").agg(F.sum(F.col("m_n") * F.col("p_n")).alias("n"))
    sets = [(k, j, (-1) ** (len(big) - len(small)), "file_plate" in small) for k, big in enumerate(STARS) for j, small in enumerate(STARS) if set(small) <= set(big) and ("vin" in small) == ("vin" in big)]
    within = docs.sparkSession.createDataFrame(sets, "star int, part int, sign int, has_file boolean")
    parts = at_least.join(within, "star").groupBy(F.col("part").alias("star"), "same_year", (F.col("same_file_year") & F.col("has_file")).alias("same_file_year"))
    return _scored(parts.agg(F.sum(F.col("n") * F.col("sign")).alias("n"))).groupBy("score").agg(F.sum("n").alias("pairs")).filter("pairs > 0")


def pair_documents(docs: DataFrame) -> DataFrame:
    """main_id, prb_id, score, reasons, margin, status for documents with facts, doc_type, doc_id, pos and flagged.

    margin is the score less the best other candidate at either end (or the score). auto needs 50 points, a vehicle
    anchor, a margin of 15, equal known years, no flags and no plate conflict; all else is review.
    """
    m_rows, p_rows, edges, names = _stars(docs)
    picked = cut_lineage(_assigned(edges, m_rows, p_rows))
    facts = docs.select("doc_id", F.struct("flagged", *FACTS).alias("f"))
    rows = (
        picked.join(_best_others(picked, edges, m_rows, p_rows, "m", "p"), "m_doc").join(_best_others(picked, edges, p_rows, m_rows, "p", "m"), "p_doc")
        .join(facts.withColumnsRenamed({"doc_id": "m_doc", "f": "_m"}), "m_doc")
        .join(facts.withColumnsRenamed({"doc_id": "p_doc", "f": "_p"}), "p_doc")
    )
    rows = rows.withColumns({"_mn": F.col("_m.name"), "_pn": F.col("_p.name")})
    rows = rows.join(names.select(F.col("main_name").alias("_mn"), F.col("prb_name").alias("_pn"), F.lit(True).alias("_alike")), ["_mn", "_pn"], "left")
    best_other = F.greatest("_m_other", "_p_other")
    rows = rows.withColumn("margin", F.when(best_other.isNull(), F.col("score")).otherwise(F.col("score") - best_other))
    same = lambda f: F.coalesce(F.col(f"_m.{f}") == F.col(f"_p.{f}"), F.lit(False))
    tests = {
        "vin": same("vin"), "plate": same("plate"), "year": same("year"), "name": F.coalesce("_alike", F.lit(False)),
        "car": F.coalesce(X.contains_either_way(F.col("_m.car"), F.col("_p.car")), F.lit(False)), "file_plate": same("file_plate"), "file_year": same("file_plate") & same("file_year"),
    }
    anchor = tests["vin"] | (tests["plate"] & tests["year"]) | (tests["file_plate"] & tests["file_year"])
    auto = (
        (F.col("score") >= AUTO_FROM)
        & anchor
        & (F.col("margin") >= LEAST_MARGIN)
        & tests["year"]
        & ~(F.col("_m.flagged") | F.col("_p.flagged"))
        & F.coalesce(F.col("_m.plate") == F.col("_p.plate"), F.lit(True))
    )
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(f)) for f, t in tests.items()]))
    return rows.select(F.col("m_doc").alias("main_id"), F.col("p_doc").alias("prb_id"), "score", reasons.alias("reasons"), "margin", F.when(auto, "auto").otherwise("review").alias("status"))


def outcome_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every document with ``outcome``: paired, orphan_main, orphan_prb or other."""
    used = pairs.select(F.explode(F.array("main_id", "prb_id")).alias("doc_id")).withColumn("_used", F.lit(True))
    outcome = (
        F.when(F.col("_used"), "paired")
        .when(F.col("doc_type") == "motor_main", "orphan_main")
        .when(F.col("doc_type") == "motor_prb", "orphan_prb")
        .otherwise("other")
    )
    return docs.join(used, "doc_id", "left").withColumn("outcome", outcome).drop("_used")


# -- attachments by anchors ------------------------------------------------------------------------------------------
def attach_by_anchor(attachments: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each attachment with its one parent and the reason, or null and why not.

    Cascade: policy number, VIN, plate with agreeing year and name. Several at a level end the cascade, except at the
    last. ``candidates``: cand_id, numbers, vins, plates, names, years (arrays). ``attachments``: doc_id, number, vin,
    plate, name, year. Candidates are counted per anchor beforehand, so no attachment meets a list of candidates.
    """
    def counted(array: str, key: str) -> DataFrame:
        rows = candidates.select("cand_id", F.explode(F.array_distinct(array)).alias(key))
        return rows.groupBy(key).agg(F.count("*").alias(f"_n_{key}"), F.min("cand_id").alias(f"_c_{key}"))

    any_mark, none_mark = F.lit("*any"), F.lit("*none")

    def options(array: str) -> Column:
        texts = F.transform(F.array_distinct(array), lambda v: v.cast("string"))
        return F.array_append(F.when(F.size(array) > 0, texts).otherwise(F.array(none_mark)), any_mark)

    spread = candidates.select("cand_id", F.explode(F.array_distinct("plates")).alias("plate"), options("years").alias("ys"), options("names").alias("ns"))
    spread = spread.select("cand_id", "plate", F.explode("ys").alias("_y"), "ns").select("cand_id", "plate", "_y", F.explode("ns").alias("_n"))
    plates = spread.groupBy("plate", "_y", "_n").agg(F.count("*").alias("n"), F.min("cand_id").alias("c"))
    asked = lambda c: F.when(F.col(c).isNull(), F.array(any_mark)).otherwise(F.array(F.col(c).cast("string"), none_mark))
    probe = attachments.filter("plate is not null").select("doc_id", "plate", F.explode(asked("year")).alias("_y"), asked("name").alias("ns"))
    probe = probe.select("doc_id", "plate", "_y", F.explode("ns").alias("_n"))
    by_plate = probe.join(plates, ["plate", "_y", "_n"]).groupBy("doc_id").agg(F.sum("n").alias("_n_plate"), F.min("c").alias("_c_plate"))
    joined = attachments.join(counted("numbers", "number"), "number", "left").join(counted("vins", "vin"), "vin", "left").join(by_plate, "doc_id", "left")
    several = lambda k: F.col(f"_n_{k}") > 1
    parent = (
        F.when(F.col("_n_number") == 1, F.col("_c_number"))
        .when(~F.coalesce(several("number"), F.lit(False)) & (F.col("_n_vin") == 1), F.col("_c_vin"))
        .when(~F.coalesce(several("number"), F.lit(False)) & ~F.coalesce(several("vin"), F.lit(False)) & (F.col("_n_plate") == 1), F.col("_c_plate"))
    )
    reason = (
        F.when(F.col("_n_number") == 1, "policy_number")
        .when(several("number"), "policy_number_ambiguous")
        .when(F.col("_n_vin") == 1, "chassis")
        .when(several("vin"), "chassis_ambiguous")
        .when(F.col("_n_plate") == 1, "plate_year_name")
        .otherwise("no_unique_evidence")
    )
    return joined.select(*attachments.columns, parent.alias("parent_id"), reason.alias("reason"))


def anchors_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidates for attachments: pairs and lone mains with the anchors of their documents. cand_id is the main's id."""
    owner = pairs.select(F.col("prb_id").alias("doc_id"), F.col("main_id").alias("cand_id"))
    mains = docs.filter("doc_type = 'motor_main'").select("doc_id", F.col("doc_id").alias("cand_id"))
    members = mains.unionByName(owner).join(
        docs.select("doc_id", F.nullif(F.upper(F.trim("policy_number")), F.lit("")).alias("number"), "vin", "plate", "name", "year"), "doc_id"
    )
    return members.groupBy("cand_id").agg(
        *[F.collect_set(c).alias(f"{c}s") for c in ("number", "vin", "plate", "name", "year")]
    )


def import_plan(docs: DataFrame, duplicates: str = "duplicate_of") -> DataFrame:
    """``route`` per document: duplicate, safe_pair, review_pair, standalone_main, orphan_prb, standalone_other (fire,
    SME), attached, attachment_review (endorsement, credit note) or held. Duplicates are marked beforehand."""
    unique = cut_lineage(docs.filter(F.col(duplicates).isNull()))
    pairs = cut_lineage(pair_documents(unique))
    status = pairs.select(F.explode(F.array("main_id", "prb_id")).alias("doc_id"), F.col("status").alias("_pair"))
    kinds = ["endorsement", "credit_note"]
    wanted = unique.filter(F.col("doc_type").isin(kinds)).select(
        "doc_id", F.nullif(F.upper(F.trim("policy_number")), F.lit("")).alias("number"), "vin", "plate", "name", "year"
    )
    attached = attach_by_anchor(wanted, anchors_of(unique, pairs)).select("doc_id", "parent_id", "reason")
    doc = F.col("doc_type")
    route = (
        F.when(F.col(duplicates).isNotNull(), "duplicate")
        .when(F.col("_pair") == "auto", "safe_pair")
        .when(F.col("_pair") == "review", "review_pair")
        .when(doc == "motor_main", "standalone_main")
        .when(doc == "motor_prb", "orphan_prb")
        .when(doc.isin("fire", "sme_property"), "standalone_other")
        .when(doc.isin(kinds) & F.col("parent_id").isNotNull(), "attached")
        .when(doc.isin(kinds), "attachment_review")
        .otherwise("held")
    )
    return docs.join(status, "doc_id", "left").join(attached, "doc_id", "left").withColumn("route", route).drop("_pair")


# -- pairing by evidence ---------------------------------------------------------------------------------------------
# Points per kind of evidence.
EVIDENCE_POINTS = {"vin": 80, "year": 20, "next_to": 18, "near": 8, "token": 3, "token_cap": 22}
READY_FROM, READY_BESIDE_FROM, READY_MARGIN = 80, 44, 8


def evidence_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds vins and tokens read from the whole text."""
    t = F.col(text)
    return docs.withColumns({"vins": vin_candidates(t), "tokens": X.identity_tokens(t)})


def _evidence_edges(mains: DataFrame, prbs: DataFrame) -> DataFrame:
    """Pairs of a batch that share more than a year: (batch_id, m, p, points and what they are made of).

    Each kind of evidence is an equi-join of its own: on VIN, on position plus or minus three, on a telling token.
    """
    m, p = mains.select("batch_id", "m", "m_pos", "vins", "tokens"), prbs.select("batch_id", "p", "p_pos", "vins", "tokens")

    def on(kind: str, left: Column, right: Column, what: Column) -> DataFrame:
        a = m.select("batch_id", "m", F.explode(left).alias("_on"))
        b = p.select("batch_id", "p", F.explode(right).alias("_on"))
        return a.join(b, ["batch_id", "_on"]).select("batch_id", "m", "p", F.lit(kind).alias("kind"), what.alias("what")).distinct()

    steps = F.array(*[F.col("m_pos") + d for d in range(-3, 4)])
    telling = F.filter("tokens", lambda t: (F.length(t) >= 5) | t.rlike("[0-9]"))
    shared = F.col("_on").cast("string")
    found = on("vin", F.col("vins"), F.col("vins"), shared).unionByName(on("token", telling, telling, shared))
    found = found.unionByName(on("place", steps, F.array("p_pos"), shared))
    pick = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("what"))))
    return found.groupBy("batch_id", "m", "p").agg(pick("vin").alias("same_vins"), pick("token").alias("same_tokens"), F.max(F.when(F.col("kind") == "place", F.col("what").cast("int"))).alias("at"))


def _scored_edges(mains: DataFrame, prbs: DataFrame) -> DataFrame:
    of = EVIDENCE_POINTS
    edges = _evidence_edges(mains, prbs)
    edges = edges.join(mains.select("batch_id", "m", "m_order", "m_pos", F.col("year").alias("m_year")), ["batch_id", "m"])
    edges = edges.join(prbs.select("batch_id", "p", "p_order", F.col("year").alias("p_year")), ["batch_id", "p"])
    apart, same_year = F.abs(F.col("at") - F.col("m_pos")), F.coalesce(F.col("m_year") == F.col("p_year"), F.lit(False))
    token_points = F.least(F.lit(of["token_cap"]), of["token"] * F.size("same_tokens"))
    score = F.when(F.size("same_vins") > 0, of["vin"]).otherwise(0) + F.when(same_year, of["year"]).otherwise(0)
    score = score + F.when(apart == 1, of["next_to"]).when(apart <= 3, of["near"]).otherwise(0) + token_points
    edges = edges.withColumns({"apart": apart, "same_year": same_year}).withColumn("score", score.cast("int"))
    strong = (F.col("score") >= READY_FROM) | ((F.col("score") >= READY_BESIDE_FROM) & F.coalesce(F.col("apart") == 1, F.lit(False)) & F.col("same_year"))
    return edges.withColumn("strong", strong)


def _taken(edges: DataFrame) -> DataFrame:
    """(batch_id, m, p, m_order): the strong pairs that mains take, each in its turn, leading by READY_MARGIN.

    Only a score within the margin of a strong one can matter, so weaker edges are left out. A main is settled once what
    earlier undecided mains may still take cannot change its answer; all such mains settle in one round, and the
    earliest undecided one of every batch always does.
    """
    open_ = cut_lineage(edges.filter(F.col("score") > READY_BESIDE_FROM - READY_MARGIN).select("batch_id", "m", "p", "m_order", "p_order", "score", "strong"))
    takers = open_.groupBy("batch_id", "m").agg(F.max("strong").alias("may")).filter("may").drop("may")
    open_ = open_.join(takers, ["batch_id", "m"])
    taken = []
    while True:
        contended = open_.filter("strong").groupBy("batch_id", "p").agg(F.min("m_order").alias("first"))
        seen = open_.join(contended, ["batch_id", "p"], "left").withColumn("free", F.coalesce(F.col("first") >= F.col("m_order"), F.lit(True)))
        rank = F.struct("score", (-F.col("p_order")).alias("before"), "p", "strong")
        state = seen.groupBy("batch_id", "m", "m_order").agg(
            F.max(F.when(F.col("free"), rank)).alias("top"), F.sort_array(F.collect_list(F.when(F.col("free"), F.col("score"))), asc=False).alias("scores"), F.coalesce(F.max(F.when(~F.col("free"), F.col("score"))), F.lit(0)).alias("held")
        )
        second = F.coalesce(F.get("scores", F.lit(1)), F.lit(0))
        lead = F.col("top.score") - F.greatest(second, "held")
        takes = F.col("top.strong") & (lead >= READY_MARGIN)
        never = (F.col("held") == 0) | ((F.col("top.score") > F.col("held")) & (~F.col("top.strong") | (F.col("top.score") - second < READY_MARGIN)))
        state = cut_lineage(state.select("batch_id", "m", "m_order", F.col("top.p").alias("p"), F.coalesce(takes, F.lit(False)).alias("takes"), F.coalesce(never, F.lit(False)).alias("never")))
        settled = state.filter("takes or never")
        new = state.filter("takes").select("batch_id", "m", "p", "m_order")
        taken.append(new)
        gone = new.select("batch_id", "p", F.col("m_order").alias("_by"))
        rest = open_.join(settled.select("batch_id", "m"), ["batch_id", "m"], "left_anti").join(gone, ["batch_id", "p"], "left")
        open_ = cut_lineage(rest.filter("_by is null or _by > m_order").drop("_by"))
        if open_.isEmpty():
            break
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return cut_lineage(out)


def _first_free(mains: DataFrame, prbs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(batch_id, m, ``name``, ``name``_order, ``name``_n): in its turn, a main's first free partner of equal ``keys``, its place
    in order, and how many are free.

    Partners only are used up, so the first free one moves on in order: partner p is it from the time when all before it
    are used until its own use. Times are the mains' turns.
    """
    never, nobody = F.lit(2**62), F.lit(None).cast("struct<p:string,p_order:bigint,_until:bigint>")
    spans = keyed_running(prbs.withColumn("_until", F.coalesce("used_at", never)), keys, ["p_order"], {"_from": ("max", "_until")}, before=True)
    spans = cut_lineage(spans.withColumn("_from", F.coalesce("_from", F.lit(-1))))
    starts = spans.filter("_until > _from").select(*keys, F.col("_from").alias("t"), F.lit(0).alias("_k"), F.struct("p", F.col("p_order").cast("long").alias("p_order"), "_until").alias("_s"), F.lit(0).alias("_gone"), F.lit(None).cast("string").alias("m"))
    uses = prbs.filter("used_at is not null").select(*keys, F.col("used_at").alias("t"), F.lit(0).alias("_k"), nobody.alias("_s"), F.lit(1).alias("_gone"), F.lit(None).cast("string").alias("m"))
    turns = mains.select(*keys, F.col("m_order").alias("t"), F.lit(-1).alias("_k"), nobody.alias("_s"), F.lit(0).alias("_gone"), "m")
    rows = starts.unionByName(uses).unionByName(turns).withColumns({"_start": F.col("_s"), "_use": F.col("_gone")}).drop("_s", "_gone")
    rows = keyed_running(rows, keys, ["t", "_k"], {"_s": ("last", "_start"), "_gone": ("sum", "_use")}).filter("m is not null")
    total = prbs.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = rows.join(total, keys, "left")
    first = F.when(F.col("_s._until") >= F.col("t"), F.col("_s"))
    return rows.select("batch_id", "m", first["p"].alias(name), first["p_order"].alias(f"{name}_order"), (F.coalesce("_n", F.lit(0)) - F.col("_gone")).alias(f"{name}_n"))


def pair_by_evidence(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, unmatched) over batches of any size. Documents: batch_id, doc_id (string), pos, doc_type, year, vins, tokens.

    Mains take partners in order of position. A main's answer is its best free partner; a tie goes to the earlier one. A
    ready answer uses the partner up, others don't. ``reasons`` tell the evidence. Partners that share nothing but the
    year, or nothing at all, are answers only where there is no better one, and are found by order, not by listing pairs.
    Unmatched are the mains and compulsory documents in no ready pair.
    """
    doc = docs.select(F.col("batch_id").cast("string").alias("batch_id"), F.col("doc_id").cast("string").alias("doc_id"), "pos", "doc_type", F.col("year").cast("string").alias("year"), "vins", "tokens")
    doc = cut_lineage(keyed_positions(doc.filter(F.col("doc_type").isin("motor_main", "motor_prb")), ["batch_id", "doc_type"], ["pos", "doc_id"], "_order"))
    side = lambda kind, n: doc.filter(F.col("doc_type") == kind).select("batch_id", F.col("doc_id").alias(n), F.col("_order").alias(f"{n}_order"), F.col("pos").alias(f"{n}_pos"), "year", "vins", "tokens")
    mains, prbs = side("motor_main", "m"), side("motor_prb", "p")
    edges = cut_lineage(_scored_edges(mains, prbs))
    taken = _taken(edges)
    used = taken.select("batch_id", "p", F.col("m_order").alias("used_at"))
    prbs = cut_lineage(prbs.join(used, ["batch_id", "p"], "left").select("batch_id", "p", "p_order", "year", "used_at"))

    free = edges.join(used, ["batch_id", "p"], "left").filter("used_at is null or used_at >= m_order")
    best = W.partitionBy("batch_id", "m").orderBy(F.desc("score"), "p_order")
    ranked = free.withColumn("_rank", F.row_number().over(best)).withColumn("_years", F.count(F.when(F.col("same_year"), 1)).over(W.partitionBy("batch_id", "m"))).withColumn("_all", F.count("*").over(W.partitionBy("batch_id", "m")))
    facts = F.struct("p", "p_order", "score", "strong", "same_vins", "same_tokens", "apart", "same_year")
    tops = ranked.filter("_rank <= 2").groupBy("batch_id", "m").agg(F.max(F.when(F.col("_rank") == 1, facts)).alias("b1"), F.max(F.when(F.col("_rank") == 2, F.col("score"))).alias("s2"), F.first("_years").alias("_years"), F.first("_all").alias("_all"))
    of_year = _first_free(mains.filter("year is not null"), prbs.filter("year is not null"), ["batch_id", "year"], "by_year")
    of_batch = _first_free(mains, prbs, ["batch_id"], "by_batch")
    rows = mains.select("batch_id", "m").join(tops, ["batch_id", "m"], "left").join(of_year, ["batch_id", "m"], "left").join(of_batch, ["batch_id", "m"], "left")
    rows = rows.filter("by_batch_n > 0")
    year_points = F.lit(EVIDENCE_POINTS["year"])
    plain_year = F.coalesce("by_year_n", F.lit(0)) - F.coalesce("_years", F.lit(0))  # free, same year, nothing else shared
    plain = F.col("by_batch_n") - F.coalesce("_all", F.lit(0)) - plain_year
    scores = F.concat(
        F.filter(F.array(F.col("b1.score"), F.col("s2")), lambda x: x.isNotNull()),
        F.when(plain_year > 1, F.array(year_points, year_points)).when(plain_year == 1, F.array(year_points)).otherwise(F.array().cast("array<int>")),
        F.when(plain > 0, F.array(F.lit(0), F.lit(0))).otherwise(F.array().cast("array<int>")),
    )
    rows = rows.withColumn("_scores", F.sort_array(scores, asc=False))
    score, runner_up = F.get("_scores", F.lit(0)), F.coalesce(F.get("_scores", F.lit(1)), F.lit(0))
    earlier = (score == year_points) & (plain_year > 0) & (F.col("by_year_order") < F.col("b1.p_order"))  # a tie: the year alone is worth as much
    by_evidence = F.coalesce((F.col("b1.score") == score) & ~F.coalesce(earlier, F.lit(False)), F.lit(False))
    partner = F.when(by_evidence, F.col("b1.p")).when(score == year_points, F.col("by_year")).otherwise(F.col("by_batch"))
    reasons = F.filter(
        F.array(
            F.when(by_evidence & (F.size("b1.same_vins") > 0), F.concat(F.lit("vin: "), F.array_join("b1.same_vins", ", "))),
            F.when(F.when(by_evidence, F.col("b1.same_year")).otherwise(score == year_points), F.lit("same year")),
            F.when(by_evidence & (F.col("b1.apart") == 1), F.lit("next to each other")).when(by_evidence & (F.col("b1.apart") <= 3), F.lit("near each other")),
            F.when(by_evidence & (F.size("b1.same_tokens") > 0), F.concat(F.lit("shared: "), F.array_join(F.slice("b1.same_tokens", 1, 5), ", "))),
        ),
        lambda r: r.isNotNull(),
    )
    ready = by_evidence & F.col("b1.strong") & (score - runner_up >= READY_MARGIN)
    pairs = rows.select(
        "batch_id", F.col("m").alias("main_id"), partner.alias("prb_id"), score.alias("score"), runner_up.alias("runner_up"),
        F.when(ready, "ready_for_review").otherwise("needs_manual_check").alias("status"), reasons.alias("reasons"),
    )
    matched = taken.select("batch_id", F.explode(F.array("m", "p")).alias("doc_id"))
    return pairs, doc.join(matched, ["batch_id", "doc_id"], "left_anti").select("batch_id", "doc_id", "doc_type")
