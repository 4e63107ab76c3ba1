"""Linking files to policies and policies to files.

Shape shared by all of these: reduce both sides to distinct keys, find the key pairs by equality on exploded
substrings or tokens (blocking), aggregate policies or files per key before the join, and bring the answer back to
the rows last. A key that a third of all rows share is one row while matching happens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerloom.functions import dates as D, text as X
from ledgerloom.functions.filenames import with_archive_name, with_scan_facts
from ledgerloom.schemas import KEY_KIND_TYPES
from ledgerloom.session import cut_lineage, once, written

PLACEHOLDER_PLATES = ["other", "null", "fire", "pa", "ta", "asset", "misc", ""]


# -- blocking --------------------------------------------------------------------------------------------------------
#: Substrings of up to this many characters are blocks of their own; longer ones are told by several.
NUMBER_PIECE = 15


def pieces(text: Column, shortest: int, longest: int) -> Column:
    """Distinct substrings of ``shortest``..``longest`` characters."""
    sizes = F.sequence(F.lit(shortest), F.least(F.length(text), F.lit(longest)))
    by_size = F.transform(
        sizes,
        lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda at: F.substring(text, at, n)),
    )
    return F.when(F.length(text) >= shortest, F.array_distinct(F.flatten(by_size))).otherwise(F.array().cast("array<string>"))


def prefixes(text: Column, shortest: int, longest: int | None = None) -> Column:
    last = F.length(text) if longest is None else F.least(F.length(text), F.lit(longest))
    return F.when(
        last >= shortest, F.transform(F.sequence(F.lit(shortest), last), lambda n: F.substring(text, F.lit(1), n))
    ).otherwise(F.array().cast("array<string>"))


def prefix_pairs(shorts: DataFrame, longs: DataFrame) -> DataFrame:
    """(short, long) with the long text beginning with the short one, equal texts too. Inputs: one distinct column each,
    ``short`` and ``long``; nulls drop out.

    In sorted order what begins with a text follows it at once, so each task walks a range of both sides together with the
    stack of short texts that the current one begins with: rows made are the matches, whatever the lengths. What is on the
    stack where a range ends is carried to the next (per range its first and last text and some lengths, folded in order).
    """
    rows = shorts.select(F.col("short").alias("text"), F.lit(0).alias("is_long")).unionByName(longs.select(F.col("long").alias("text"), F.lit(1).alias("is_long")))
    rows = rows.filter("text is not null")
    ranged = cut_lineage(rows.repartitionByRange("text", "is_long").sortWithinPartitions("text", "is_long"))

    def walk(batches: Iterator[pa.RecordBatch], stack: list[str]) -> Iterator[tuple[str, bool, list[str]]]:
        """Every text with the short ones it begins with, itself among them if short."""
        for batch in batches:
            for text, is_long in zip(batch["text"].to_pylist(), batch["is_long"].to_pylist()):
                while stack and not text.startswith(stack[-1]):
                    stack.pop()
                if not is_long:
                    stack.append(text)
                yield text, bool(is_long), stack

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        stack: list[str] = []
        for text, _, stack in walk(batches, stack):
            first, last = text if first is None else first, text
        if first is not None:
            part, sizes = TaskContext.get().partitionId(), [len(s) for s in stack]
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "first": [first], "last": [last], "sizes": pa.array([sizes], pa.list_(pa.int32()))})

    carried, before = {}, []
    for end in ranged.mapInArrow(ends, "part int, first string, last string, sizes array<int>").orderBy("part").collect():  # a row per range
        before = [s for s in before if end["first"].startswith(s)]
        if before:
            carried[end["part"]] = before
        before = [s for s in before if end["last"].startswith(s)] + [end["last"][:n] for n in end["sizes"]]
    carry = shorts.sparkSession.sparkContext.broadcast(carried)

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, long, size = [], [], 0
        for text, is_long, stack in walk(batches, list(carry.value.get(TaskContext.get().partitionId(), []))):
            if is_long and stack:
                short.extend(stack)
                long.extend([text] * len(stack))
                size += len(stack) * len(text)
            if size >= 4_000_000:
                yield pa.record_batch({"short": short, "long": long})
                short, long, size = [], [], 0
        if short:
            yield pa.record_batch({"short": short, "long": long})

    return ranged.mapInArrow(matches, "short string, long string")


def windows(text: Column, size: int) -> Column:
    """The substrings of ``size`` characters of a text of at least as many."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda at: F.substring(text, at, F.lit(size)))


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """The distinct values of a column as ``name``, each with an id ``<name>_id`` that stays: what is exploded is the id."""
    return cut_lineage(df.select(F.col(column).alias(name)).distinct().withColumn(f"{name}_id", F.monotonically_increasing_id()))


def hashed(blocks: Column) -> Column:
    """Blocks as 64-bit hashes. Two blocks of one hash only add candidates, and every candidate is compared afterwards."""
    return F.array_distinct(F.transform(blocks, lambda b: F.xxhash64(b)))


def join_on_rarest(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """(key_id, text_id) pairs that share the key's rarest block; complete when a match needs every block of the key.

    ``keys``: key_id, blocks; ``texts``: text_id, blocks. A key with a block no text has cannot match and drops out.
    The texts' blocks are shuffled once, for their counts and for the join: ties go to the block with the least id.
    """
    spread = texts.select("text_id", F.explode(hashed(F.col("blocks"))).alias("_block")).repartition("_block")
    weight = spread.groupBy("_block").agg(F.struct(F.count("*").alias("n"), F.min("text_id").alias("least")).alias("_n"))
    chosen = (
        keys.select("key_id", F.explode(hashed(F.col("blocks"))).alias("_block"))
        .join(weight, "_block", "left")
        .groupBy("key_id")
        .agg(F.count_if(F.col("_n").isNull()).alias("_missing"), F.min(F.struct("_n", "_block")).alias("_pick"))
        .filter("_missing = 0")
        .select("key_id", F.col("_pick._block").alias("_block"))
    )
    return chosen.join(spread, "_block").select("key_id", "text_id")


def _contained(keys: DataFrame, texts: DataFrame, size: int, shortest: int, equal: bool = True) -> DataFrame:
    """The columns of both sides, save the ids, per key inside a text. ``keys``: key, key_id, ``texts``: text, text_id, and what
    they bring along. Keys longer than every text are left out at once, so are equal ones without ``equal``."""
    length, text = F.length("key"), F.col("text")
    longest = texts.agg(F.max(F.length("text"))).first()[0] or 0
    keys = keys.filter(length <= longest - (not equal))
    asked = keys.filter(length >= shortest).select(F.least(length, F.lit(2 * size)).alias("n")).distinct()
    sizes = sorted(r.n for r in asked.collect())  # at most twice ``size`` numbers: texts are only cut to lengths that keys have
    run = min((n for n in sizes if n >= size), default=None)  # all longer keys have runs of this length, and longer runs are fewer
    found = []
    if sizes and sizes[0] < size:
        cuts = [F.when(F.length(text) >= n, windows(text, n)) for n in sizes if n < size]
        cut = F.flatten(F.array_compact(F.array(*cuts)))
        short = keys.filter(length.between(shortest, size - 1)).select("key_id", F.xxhash64("key").alias("_block"))
        found.append(short.join(texts.select("text_id", F.explode(hashed(cut)).alias("_block")), "_block").select("key_id", "text_id"))
    if run:
        long = keys.filter(length >= F.lit(max(size, shortest))).select("key_id", X.grams("key", run).alias("blocks"))
        found.append(join_on_rarest(long, texts.filter(F.length(text) >= run).select("text_id", X.grams("text", run).alias("blocks"))))
    if not found:
        return keys.drop("key_id").join(texts.drop("text_id").limit(0), F.lit(False))
    pairs = reduce(DataFrame.unionByName, found)
    hits = pairs.join(keys, "key_id").join(texts, "text_id").filter(text.contains(F.col("key")))
    return (hits if equal else hits.filter("key <> text")).drop("key_id", "text_id")


def _either_way(keys: DataFrame, texts: DataFrame, size: int = 8) -> DataFrame:
    """Like ``_contained``, with one inside the other; equal ones come from the first direction alone."""
    forth = _contained(keys, texts, size, 1)
    turned = {"key": "text", "key_id": "text_id", "text": "key", "text_id": "key_id"}
    turn = lambda df: df.select(*[F.col(c).alias(turned.get(c, c)) for c in df.columns])
    return forth.unionByName(turn(_contained(turn(texts), turn(keys), size, 1, equal=False)))


def contained_pairs(keys: DataFrame, texts: DataFrame, size: int = 8, shortest: int = 1) -> DataFrame:
    """Distinct (key, text) with the key inside the text. Inputs: one column each, ``key`` and ``text``.

    Keys shorter than ``size`` join on the text's substrings of the lengths that keys have; longer ones on their rarest run
    of at least ``size`` characters. Both are joined as hashes and ids, and compared as texts at last.
    """
    return _contained(numbered(keys, "key", "key"), numbered(texts, "text", "text"), size, shortest).select("key", "text")


def contained_either_way(keys: DataFrame, texts: DataFrame, size: int = 8) -> DataFrame:
    """Distinct (key, text) with one inside the other; equal ones come from the first direction alone."""
    return _either_way(numbered(keys, "key", "key"), numbered(texts, "text", "text"), size).select("key", "text")


def number_tokens(text: Column) -> Column:
    """House numbers of one to three parts at every position, bounded by anything but a digit."""
    part = r"\d+"
    found = [
        F.regexp_extract_all(text, F.lit(r"(?<!\d)(?=(" + r"[-/]".join([part] * n) + r")(?!\d))"), F.lit(1)) for n in (1, 2, 3)
    ]
    return F.array_distinct(F.flatten(F.array(*found)))


# -- file to policy --------------------------------------------------------------------------------------------------
def parsed_names(files: DataFrame, suffix_length: int = 25) -> DataFrame:
    """Distinct file names with kind, key, number, suffix and year_be. Written out once: the linkage reads it often."""
    return cut_lineage(with_archive_name(files.select("name").distinct(), "name", suffix_length))


#: The house number and the place of an address key, which the name reader joins by the key's only blank.
_NUMBER = "CASE WHEN kind = 'address' THEN substring_index(key, ' ', 1) END"
_SUFFIX = "CASE WHEN kind = 'address' THEN substr(key, instr(key, ' ') + 1) END"


def parsed_files(files: DataFrame, suffix_length: int = 25, keep: list[str] | None = None, facts: dict[str, Column] | None = None, only: str = "true") -> tuple[DataFrame, DataFrame]:
    """(files with kind, key and year_be, the distinct kind and key that can be asked for). Each file is made and parsed once, and
    answers come back by the key, so neither the files nor their names pass a second time.

    Written are the columns ``keep`` (all) and ``facts``, computed from the file and its parts, of the files that pass ``only``.
    """
    rows = with_archive_name(files, "name", suffix_length).drop("number", "suffix")
    for fact, column in (facts or {}).items():  # a fact may read those before it
        rows = once(rows, **{fact: column})
    return _asking(rows.filter(only).select(*(files.columns if keep is None else keep), *(facts or {}), "kind", "key", "year_be"))


def _asking(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = written(rows, "files")
    return rows, written(rows.select("kind", "key").filter("kind <> 'unknown' and key <> ''").distinct(), "keys")


def counted_files(parsed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Like ``parsed_files``, of files that are parsed already and only counted: one row per kind, key, year and ``keys``, with
    ``files`` and the sum of ``length``."""
    return _asking(parsed.groupBy("kind", "key", "year_be", *keys).agg(F.count("*").alias("files"), F.sum("length").alias("length")))


def _with_parts(rows: DataFrame) -> DataFrame:
    """Number and suffix again, before the year, as ``with_archive_name`` gives them."""
    at = rows.columns.index("year_be")
    return rows.select(*rows.columns[:at], F.expr(_NUMBER).alias("number"), F.expr(_SUFFIX).alias("suffix"), *rows.columns[at:])


_SUMS = {"n_all": F.sum, "n_fit": F.sum, "first_all": F.min, "first_fit": F.min}


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[total(c).alias(c) for c, total in _SUMS.items() if c in rows.columns])


def _policy_texts(policies: DataFrame, texts: dict[str, Column], sums: list[str]) -> DataFrame:
    """kind, text, text_id and ``_stats``, a list by year of those of ``_SUMS`` that are asked for: all rows and rows of a fitting
    type, and the first of each. ``pos`` is the input order. A text is one row, however many policies and years it has."""
    upper = F.upper(F.coalesce("policy_type", F.lit(""))) if any("fit" in c for c in sums) else None
    fits = lambda kind: [] if upper is None else [upper.isin(KEY_KIND_TYPES[kind]).alias("fits")]
    sides = F.array(*[F.struct(F.lit(kind).alias("kind"), text.alias("text"), *fits(kind)) for kind, text in texts.items()])
    rows = policies.select("id", "pos", D.coverage_year("coverage_start").alias("year"), F.explode(sides).alias("s")).select("id", "pos", "year", "s.*")
    rows = rows.filter("text <> ''" if any("all" in c for c in sums) else "text <> '' and fits")
    first = F.struct("pos", "id")
    made = {"n_all": F.count("*"), "n_fit": F.count_if("fits"), "first_all": F.min(first), "first_fit": F.min(F.when(F.col("fits"), first))}
    if upper is None:
        made = {"n_all": F.count("*"), "first_all": F.min(first)}
    stats = rows.groupBy("kind", "text", "year").agg(*[made[c].alias(c) for c in sums])
    lists = stats.groupBy("kind", "text").agg(F.collect_list(F.struct("year", *sums)).alias("_stats"))
    return written(lists.withColumn("text_id", F.monotonically_increasing_id()), "texts")


def _of(texts: DataFrame, kind: str) -> DataFrame:
    return texts.filter(F.col("kind") == kind).drop("kind")


def _key_texts(asked: DataFrame, kind: str, norm: Column) -> DataFrame:
    """The distinct normalised keys as ``key``, key_id, and ``_keys``, the file keys each comes from."""
    rows = asked.filter(F.col("kind") == kind).select(norm.alias("_norm"), "key").groupBy(F.col("_norm").alias("key")).agg(F.collect_list("key").alias("_keys"))
    return cut_lineage(rows.withColumn("key_id", F.monotonically_increasing_id()))


def _told(pairs: DataFrame, kind: str) -> DataFrame:
    """Pairs of normalised keys as pairs of the file keys, with what the texts bring along."""
    rest = [c for c in pairs.columns if c not in ("key", "_keys")]
    return pairs.select(F.lit(kind).alias("kind"), F.explode("_keys").alias("key"), *rest)


def _per_year(pairs: DataFrame) -> DataFrame:
    """Sums per kind, key and year of the pairs' lists."""
    return _summed(pairs.select("kind", "key", F.inline("_stats")), ["kind", "key", "year"])


def _answers(per_year: DataFrame) -> DataFrame:
    """One list by year per kind and key. No list is longer than there are years, and a file meets one row."""
    by_year = F.struct(*[c for c in per_year.columns if c not in ("kind", "key")])
    return written(per_year.groupBy("kind", "key").agg(F.collect_list(by_year).alias("_years")), "answers")


def _typed_pairs(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(kind, key, text, _stats) of plates and names for the type-aware rules."""
    found = [_told(_either_way(_key_texts(asked, kind, X.plate_key("key")), _of(texts, kind)), kind) for kind in ("plate", "name")]
    return found[0].unionByName(found[1])


def _typed_addresses(asked: DataFrame, policy_texts: DataFrame) -> DataFrame:
    """Sums per (kind, key, year) of the policies whose address has the key's house number, its first occurrence free of
    digits on both sides, and shares a run of three letters with the key's words (any address if those are under two).

    Both sides are dictionaries of distinct (number, words), policies summed per entry and year. Of each number the run that
    most entries hold, such as a common street word, is counted once for all keys that hold it too; so keys and entries
    only meet one by one on other runs, and never if both hold that one.
    """
    number = F.regexp_replace(F.expr(_NUMBER), r"[/\-]", "")
    address = cut_lineage(asked.filter("kind = 'address'").select("key", number.alias("number"), X.address_words_key(F.expr(_SUFFIX)).alias("words")))
    found = policy_texts.filter("kind = 'address'").select("text", "_stats").withColumn("number", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\d+)"), F.lit(1)))))
    found = found.join(address.select("number").distinct(), "number", "left_semi")
    at = F.instr("text", F.col("number"))
    after = F.substring(F.col("text"), at + F.length("number"), F.lit(1))
    before = F.substring(F.col("text"), at - 1, F.lit(1))
    found = found.filter(~(after.rlike(r"\d") | ((at > 1) & before.rlike(r"\d"))))
    found = found.select("text", "number", F.inline("_stats"))
    entries = cut_lineage(_summed(found.withColumn("words", F.regexp_replace("text", r"\d+", "")), ["number", "words", "year"]))

    sums = [c for c in _SUMS if c in entries.columns]
    by_number = address.filter(F.length("words") < 2).join(_summed(entries, ["number", "year"]), "number").select("key", "year", *sums)

    def told(df: DataFrame) -> DataFrame:
        """Distinct (number, words) with an id and their runs."""
        return cut_lineage(df.select("number", "words").distinct().withColumn("id", F.monotonically_increasing_id())).withColumn("runs", X.grams("words", 3))

    texts, keys = told(entries), told(address.filter(F.length("words") >= 2))
    common = texts.select("number", F.explode("runs").alias("run")).groupBy("number", "run").agg(F.count("*").alias("n"))
    common = common.groupBy("number").agg(F.max(F.struct("n", "run"))["run"].alias("common"))
    holds = F.coalesce(F.array_contains("runs", F.col("common")), F.lit(False))
    texts, keys = (cut_lineage(side.join(common, "number", "left").withColumn("holds", holds).drop("common")) for side in (texts, keys))
    summed = texts.select("number", "words", "id", "holds").join(entries, ["number", "words"])
    by_common = keys.filter("holds").select("id", "number").join(_summed(summed.filter("holds"), ["number", "year"]), "number").select("id", "year", *sums)

    # a key meets all entries on a run, or those without the common one if it holds that itself
    sides = lambda df, marks: df.select("id", "number", F.explode("runs").alias("run"), marks.alias("_m")).withColumn("_m", F.explode("_m"))
    m = sides(keys, F.when(F.col("holds"), F.array(F.lit("other"))).otherwise(F.array(F.lit("any"))))
    t = sides(texts, F.when(F.col("holds"), F.array(F.lit("any"))).otherwise(F.array(F.lit("any"), F.lit("other")))).withColumnRenamed("id", "text_id")
    met = m.join(t, ["number", "run", "_m"]).select("id", "text_id").distinct()
    by_run = met.join(summed.select(F.col("id").alias("text_id"), "year", *sums), "text_id").select("id", "year", *sums)
    by_words = keys.select("id", "number", "words").join(_summed(by_common.unionByName(by_run), ["id", "year"]), "id").join(address, ["number", "words"])
    return by_number.unionByName(by_words.select("key", "year", *sums)).select(F.lit("address").alias("kind"), "key", "year", *sums)


def link_typed(
    files: DataFrame, policies: DataFrame, strict_type: bool = True, strict_year: bool = False, keep: list[str] | None = None,
    facts: dict[str, Column] | None = None, only: str = "true", told: DataFrame | None = None, counts: bool = True,
) -> DataFrame:
    """Files with ``policy_id``, ``strategy``, ``candidates`` and ``typed_candidates``.

    The policy type must suit the kind of key; without a fit the strategy is fallback (any type) or no-match. The
    nearest coverage year wins, then input order. A policy without a plate matches no plate.
    Files need a name; policies: id, pos, policy_type, license_plate, insured_address, insured_name, coverage_start.
    ``keep``, ``facts`` and ``only``: see ``parsed_files``. ``told``, ``counts``: see ``typed_answers``.
    """
    rows, asked = parsed_files(files, keep=keep, facts=facts, only=only)
    return _with_parts(choose_typed(rows, typed_answers(asked, policies, told, strict_type, counts), strict_type, strict_year))


def typed_answers(asked: DataFrame, policies: DataFrame, told: DataFrame | None = None, strict_type: bool = True, counts: bool = True) -> DataFrame:
    """Per kind and key of ``asked`` the policies behind it by year, for ``choose_typed``.

    ``told``: one row per ``policy_id``; its other columns come along as the struct ``told`` of the chosen policy, looked up once per
    key and year, not once per file. Without ``counts`` (``strict_type`` only) candidates aren't counted, and no policy passes whose
    type doesn't fit.
    """
    if not (counts or strict_type):
        raise ValueError("the choice of any type needs the counts")
    plate = X.plate_key("license_plate")
    firsts = ["first_fit"] if strict_type else ["first_fit", "first_all"]
    texts = _policy_texts(
        policies,
        {
            "plate": F.when(~plate.isin(PLACEHOLDER_PLATES), plate),
            "address": X.address_key("insured_address"),
            "name": X.plate_key("insured_name"),
        },
        [*(["n_all", "n_fit"] if counts else []), *firsts],
    )
    both = _per_year(_typed_pairs(asked, texts)).unionByName(_typed_addresses(asked, texts))
    facts = None if told is None else told.select(F.col("policy_id").alias("_id"), F.struct(*[c for c in told.columns if c != "policy_id"]).alias("_told"))
    by_year = []
    for c in firsts:
        side = both.filter(F.col(c).isNotNull()).select("kind", "key", "year", F.col(c).alias("first"))
        if facts is not None:
            side = side.withColumn("_id", F.col("first.id")).join(facts, "_id", "left").withColumnRenamed("_told", "told")
        fields = ["year", "first", *(["told"] if facts is not None else [])]
        by_year.append(side.groupBy("kind", "key").agg(F.collect_list(F.struct(*fields)).alias(f"_{c}")))
    if counts:
        by_year.insert(0, both.groupBy("kind", "key").agg(F.sum("n_all").alias("candidates"), F.sum("n_fit").alias("typed_candidates")))
    return written(reduce(lambda a, b: a.join(b, ["kind", "key"], "left"), by_year), "answers")


def choose_typed(rows: DataFrame, answers: DataFrame, strict_type: bool = True, strict_year: bool = False) -> DataFrame:
    """``rows``, that have kind, key and year_be, with the choice of ``link_typed``, made inside the row."""
    year_be = F.col("year_be")
    away = lambda s: D.year_distance(s["year"], year_be)
    has_told = "told" in answers.schema["_first_fit"].dataType.elementType.names
    has_counts = "candidates" in answers.columns

    def nearest(lists: str) -> Column:
        kept = F.filter(lists, lambda s: F.coalesce((away(s) == 0) | year_be.isNull(), F.lit(False))) if strict_year else F.col(lists)
        extra = lambda s: [s["told"].alias("told")] if has_told else []
        return F.array_min(F.transform(kept, lambda s: F.struct(away(s).alias("away"), s["first"].alias("first"), *extra(s))))

    staged = rows.join(answers, ["kind", "key"], "left")
    staged = staged.withColumn("_fitting", F.size(F.coalesce("_first_fit", F.array())) > 0).withColumn("_fit", nearest("_first_fit"))
    any_ = F.lit(False)
    if not strict_type:
        staged, any_ = staged.withColumn("_any", nearest("_first_all")), F.coalesce(F.col("candidates") > 0, F.lit(False))
    late = F.lit("no-match-year")
    fitting = F.col("_fitting")
    chosen = F.when(fitting, F.col("_fit.first.id"))
    facts = F.when(fitting, F.col("_fit.told")) if has_told else None
    strategy = F.when(fitting, F.when(F.col("_fit").isNotNull(), "type-match").otherwise(late))
    if not strict_type:
        chosen = chosen.when(any_, F.col("_any.first.id"))
        facts = facts.when(any_, F.col("_any.told")) if has_told else None
        strategy = strategy.when(any_, F.when(F.col("_any").isNotNull(), "fallback").otherwise(late))
    return staged.select(
        *rows.columns,
        chosen.alias("policy_id"),
        F.coalesce(strategy, F.lit("no-match")).alias("strategy"),
        *([F.coalesce(c, F.lit(0)).alias(c) for c in ("candidates", "typed_candidates")] if has_counts else []),
        *([facts.alias("told")] if has_told else []),
    )


def _loose_addresses(asked: DataFrame, texts: DataFrame, whole_numbers: bool) -> DataFrame:
    """(kind, key, and the columns of ``texts``): the key's house number, with either separator, and the start of its place are in
    the text.

    A text shows the numbers in it of the shapes that keys have, each with every start it holds: both are one block, so what
    meets is what matches. Starts are looked up in the texts without their numbers, a dictionary of streets.
    """
    number, place = X.loose_key(F.expr(_NUMBER)), X.loose_key(F.expr(_SUFFIX))
    variants = F.array_distinct(F.array(number, F.replace(number, F.lit("-"), F.lit("/")), F.replace(number, F.lit("/"), F.lit("-"))))
    start = F.when(F.length(place) >= 3, F.substring(place, 1, 5)).otherwise(F.lit(""))
    keys = asked.filter("kind = 'address'").select("key", variants.alias("_variants"), start.alias("start"))
    keys = cut_lineage(keys.select("key", "start", "_variants", F.posexplode("_variants").alias("_at", "number")))

    # A number inside a longer run is a piece of it; of one longer than a piece its beginning is asked for.
    piece = F.col("number") if whole_numbers else F.substring("number", 1, NUMBER_PIECE)
    shape = lambda c: F.translate(c, "0123456789", "9999999999")
    shapes = sorted(r.s for r in keys.select(shape(piece).alias("s")).distinct().collect() if r.s)  # lengths and places of separators
    plain = keys.filter("start rlike '[0-9/\\-]'").isEmpty()
    bare = not keys.filter("start = ''").isEmpty()
    text = F.col("text")
    if not shapes:
        return asked.select("kind", "key").join(texts.drop("text_id").limit(0), F.lit(False))

    texts = texts.withColumn("_words", F.regexp_replace(text, r"[0-9/\-]+", "\n") if plain else text)
    starts = numbered(keys.filter("start <> ''").select("start"), "start", "key")
    words = numbered(texts.select("_words"), "_words", "text")
    held = _contained(starts, words, 8, 1).groupBy(F.col("text").alias("_words")).agg(F.collect_list("key").alias("_starts"))
    placed = texts.select("text_id", "text", "_words").join(held, "_words", "left")
    runs = F.regexp_extract_all(text, F.lit(r"([0-9][0-9/\-]*)"), F.lit(1))
    if whole_numbers:
        numbers = number_tokens(text)
    else:
        numbers = F.flatten(F.transform(runs, lambda r: F.flatten(F.array_compact(F.array(*[F.when(F.length(r) >= n, windows(r, n)) for n in sorted({len(x) for x in shapes})])))))
    asked_for = F.array(*[F.lit(x) for x in shapes])
    numbers = F.filter(F.array_distinct(numbers), lambda n: F.array_contains(asked_for, shape(n)))
    none = F.array().cast("array<string>")
    with_starts = F.concat(F.coalesce("_starts", none), F.array(F.lit("")) if bare else none)
    placed = placed.select("text_id", numbers.alias("_numbers"), with_starts.alias("_starts")).filter("size(_numbers) > 0 and size(_starts) > 0")
    blocks = F.array_distinct(F.flatten(F.transform("_numbers", lambda n: F.transform("_starts", lambda s: F.xxhash64(n, s)))))
    shown = placed.select("text_id", F.explode(blocks).alias("_block"))

    inside = (lambda n: X.whole_number_in(n, text)) if whole_numbers else (lambda n: text.contains(n))
    earlier = F.exists(F.slice("_variants", 1, F.col("_at")), inside)  # a text that shows two variants counts once
    hits = keys.withColumn("_block", F.xxhash64(piece, "start")).join(shown, "_block").join(texts.drop("_words"), "text_id")
    hits = hits.filter(inside(F.col("number")) & text.contains(F.col("start")) & ~earlier)
    return hits.select(F.lit("address").alias("kind"), "key", *[c for c in texts.columns if c not in ("text_id", "_words")])


def _loose_pairs(asked: DataFrame, texts: DataFrame, whole_numbers: bool) -> DataFrame:
    """(kind, key, and what ``texts`` have) for the loose rules: plates either way, names inside, house number and place start."""
    plates = _told(_either_way(_key_texts(asked, "plate", X.loose_key("key")), _of(texts, "plate")), "plate")
    names = _told(_contained(_key_texts(asked, "name", X.loose_key("key")), _of(texts, "name"), 8, 1), "name")
    return plates.unionByName(names).unionByName(_loose_addresses(asked, _of(texts, "address"), whole_numbers))


def _loose_texts(expand: bool) -> dict[str, Column]:
    norm = X.loose_key if expand else X.plate_key
    plate = norm("license_plate")
    return {"plate": F.when(~plate.isin("other", "null"), plate), "address": norm("insured_address"), "name": norm("insured_name")}


def _loose_answers(asked: DataFrame, policies: DataFrame, nearest: bool) -> DataFrame:
    texts = _policy_texts(policies, _loose_texts(nearest), ["n_all", "first_all"])
    return _answers(_per_year(_loose_pairs(asked, texts, nearest)))


def linked_ids(files: DataFrame, policies: DataFrame, band: int | None = None) -> DataFrame:
    """(kind, key, year_be, id): every policy behind each key and year that file names ask for.

    Without ``band`` those tied on the nearest year, as ``link_nearest_year`` counts them; with it those within so many
    years or without a year, as ``link_year_band`` does. Files that share key and year share the rows: join ``parsed_names`` by
    (kind, key, year_be) for the ids of a file. Keys without a year are not asked for.

    A key has one list of years, a pair of key and text is one row, and years are told apart when it meets the policies, so what
    is shuffled doesn't grow with the years. Rows are distinct by themselves unless policies repeat an id.
    """
    nearest = band is None
    names = with_archive_name(files.select("name"), "name", 20).select("kind", "key", "year_be").filter("kind <> 'unknown' and key <> '' and year_be is not null")
    asked = written(names.distinct().groupBy("kind", "key").agg(F.collect_list("year_be").alias("_asked")), "keys")
    sides = F.array(*[F.struct(F.lit(kind).alias("kind"), text.alias("text")) for kind, text in _loose_texts(nearest).items()])
    members = policies.select("id", D.coverage_year("coverage_start").alias("_y"), F.explode(sides).alias("s")).select("id", "_y", "s.*").filter("text <> ''")
    if nearest:
        texts = _policy_texts(policies, _loose_texts(True), ["n_all", "first_all"])
        pairs = written(_loose_pairs(asked.select("kind", "key"), texts, True), "pairs")
        lists = _answers(_per_year(pairs))
        closest = lambda b: F.array_min(F.transform("_years", lambda s: D.year_distance(s["year"], b)))
        wanted = asked.join(lists, ["kind", "key"]).select("kind", "key", F.transform("_asked", lambda b: F.struct(b.alias("year_be"), closest(b).alias("away"))).alias("_asked"))
        fits = lambda s: D.year_distance(F.col("_y"), s["year_be"]) == s["away"]
    else:
        texts = members.select("kind", "text").distinct().withColumn("text_id", F.monotonically_increasing_id())
        pairs = _loose_pairs(asked.select("kind", "key"), written(texts, "texts"), False)
        wanted = asked.select("kind", "key", F.transform("_asked", lambda b: F.struct(b.alias("year_be"))).alias("_asked"))
        fits = lambda s: F.col("_y").isNull() | (F.abs(F.col("_y") - (s["year_be"] - 543)) <= band)
    met = pairs.select("kind", "key", "text").join(wanted, ["kind", "key"]).join(members, ["kind", "text"])
    found = met.select("kind", "key", F.explode(F.filter("_asked", fits)).alias("_s"), "id").select("kind", "key", "_s.year_be", "id")
    return found if policies.groupBy("id").count().filter("count > 1").isEmpty() else found.distinct()


def link_nearest_year(files: DataFrame, policies: DataFrame, strict_year: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Files with ``matches`` (policies tied on the nearest year), ``away`` and the first of them.

    Without a year in the name the first policy alone is the match. ``keep``: see ``parsed_files``.
    """
    rows, asked = parsed_files(files, 20, keep)
    year_be = F.col("year_be")
    by_distance = F.transform("_years", lambda s: F.struct(D.year_distance(s["year"], year_be).alias("away"), s["n_all"].alias("n"), s["first_all"].alias("first")))
    staged = rows.join(_loose_answers(asked, policies, True), ["kind", "key"], "left").select(*rows.columns, by_distance.alias("_years"))
    if strict_year:
        staged = staged.withColumn("_years", F.filter("_years", lambda s: F.coalesce((s["away"] == 0) | year_be.isNull(), F.lit(False))))
    staged = staged.withColumn("away", F.array_min(F.transform("_years", lambda s: s["away"])))
    tied = F.filter("_years", lambda s: s["away"] == F.col("away"))
    count = F.aggregate(tied, F.lit(0).cast("long"), lambda acc, s: acc + s["n"])
    matches = F.when(year_be.isNull(), F.when(F.size("_years") > 0, 1)).otherwise(count)
    first = F.array_min(F.transform(tied, lambda s: s["first"]))
    staged = staged.select(*rows.columns, F.coalesce(matches, F.lit(0)).cast("long").alias("matches"), "away", first["id"].alias("policy_id"))
    return _with_parts(staged)


def link_year_band(files: DataFrame, policies: DataFrame, band: int = 1, keep: list[str] | None = None) -> DataFrame:
    """Files with ``matches`` (policies under the key within ``band`` years; a missing year passes) and the first of them.

    A key has one list by year, and the band is cut from it inside a file's row. ``keep``: see ``parsed_files``.
    """
    rows, asked = parsed_files(files, 20, keep)
    target = F.col("year_be") - 543
    passes = lambda s: target.isNull() | s["year"].isNull() | s["year"].between(target - band, target + band)
    staged = rows.join(_loose_answers(asked, policies, False), ["kind", "key"], "left").select(*rows.columns, F.filter("_years", passes).alias("_years"))
    count = F.aggregate("_years", F.lit(0).cast("long"), lambda acc, s: acc + s["n_all"])
    first = F.array_min(F.transform("_years", lambda s: s["first_all"]))
    return _with_parts(staged.select(*rows.columns, F.coalesce(count, F.lit(0)).alias("matches"), first["id"].alias("policy_id")))


def ambiguity_gate(links: DataFrame, limit: int = 5) -> DataFrame:
    """More than ``limit`` matches: keep the file, do not link it."""
    return links.withColumn("ambiguous", F.col("matches") > limit).withColumn("policy_id", F.when(~F.col("ambiguous"), F.col("policy_id")))


# -- policy to file --------------------------------------------------------------------------------------------------
def expected_names(policies: DataFrame) -> DataFrame:
    """id, place, expected: the names a policy's file may carry, best first."""
    kind = F.upper(F.coalesce("policy_type", F.lit("")))
    year = D.coverage_year("coverage_start")
    yy = F.lpad(((year + 543) % 100).cast("string"), 2, "0")
    label = F.when(kind == "P", "พรบ").otherwise("กธ")

    def names(stem: Column, *forms: str) -> list[Column]:
        parts = {"spaced": (" ", "."), "wide": ("  ", "."), "tight": ("", "."), "dotless": (" ", "")}
        return [F.concat(stem, F.lit(parts[f][0]), label, F.lit(parts[f][1]), yy, F.lit(".pdf")) for f in forms]

    plate = F.nullif(X.no_blanks("license_plate"), F.lit(""))
    address = F.trim(F.coalesce("insured_address", F.lit("")))
    pattern = r"^(\d+(?:[/\-]\d+)?(?:[/\-]\d+)?)\s*(.*)$"
    house = F.nullif(F.regexp_extract(address, pattern, 1), F.lit(""))
    words = F.regexp_extract(F.trim(F.regexp_extract(address, pattern, 2)), r"^([^\s]+(?:\s+[^\s]+){0,3})", 1)
    place = F.nullif(X.no_blanks(F.rtrim(F.substring(words, 1, 30))), F.lit(""))
    houses = [house, F.replace(house, F.lit("/"), F.lit("-")), F.replace(house, F.lit("-"), F.lit("/")), F.regexp_replace(house, r"[/\-]", "")]
    by_address = []
    for h in houses:
        by_address += names(F.concat(h, place), "spaced", "dotless") + names(F.concat(h, F.lit(" "), place), "spaced")
    person, tight_person = F.nullif(F.trim("insured_name"), F.lit("")), F.nullif(X.no_blanks("insured_name"), F.lit(""))
    variants = (
        F.when(kind.isin(KEY_KIND_TYPES["plate"]), F.array(*names(plate, "spaced", "wide", "tight", "dotless")))
        .when(kind.isin(KEY_KIND_TYPES["address"]), F.array(*by_address))
        .when(kind.isin(KEY_KIND_TYPES["name"]), F.array(*names(tight_person, "spaced", "dotless"), *names(person, "spaced")))
    )
    rows = policies.filter(year.isNotNull()).select("id", F.posexplode(F.array_distinct(F.array_compact(variants))).alias("place", "expected"))
    return rows


def file_by_expected_name(policies: DataFrame, files: DataFrame) -> DataFrame:
    """id, file: the first expected name that some file carries, blanks and case aside. One equi join."""
    norm = lambda c: F.lower(X.no_blanks(c))
    index = files.groupBy(norm("name").alias("_norm")).agg(F.max("name").alias("file"))
    hits = expected_names(policies).withColumn("_norm", norm("expected")).join(index, "_norm")
    return hits.groupBy("id").agg(F.min_by("file", "place").alias("file"))


def scan_groups(files: DataFrame, facts: list[str], keep: int = 1) -> DataFrame:
    """Scanned files reduced to the first ``keep`` names per set of ``facts``, those that the choice reads: no choice below
    looks at more.

    Ranked per (facts, salt) first, so facts shared by a third of all files are cut in parallel.
    """
    rows = with_scan_facts(files.select("name").distinct()).select(*facts, "name")
    return cut_lineage(_least_names(rows, facts) if keep == 1 else _first_names(rows, facts, keep))


def _least_names(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first name per ``keys``, a partial aggregate: files that only differ in it are one row before any join."""
    return rows.groupBy(*keys).agg(F.min("name").alias("name"))


def _first_names(rows: DataFrame, keys: list[str], keep: int) -> DataFrame:
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("name"), F.lit(64)))
    near = salted.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy("name"))).filter(F.col("_r") <= keep)
    return near.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("name"))).filter(F.col("_r") <= keep).drop("_salt", "_r")


def _wanted(policies: DataFrame) -> tuple[Column, Column, Column]:
    kind = F.upper(F.trim(F.coalesce("policy_type", F.lit(""))))
    return kind, D.be_two_digits("coverage_end", "coverage_start"), X.no_blanks("license_plate")


def _year_rank() -> Column:
    """0 same year, 1 no year in the name, 2 another year."""
    return F.when(F.col("year") == F.col("target"), 0).when(F.col("year").isNull(), 1).otherwise(2)


def _least_listed(*first: str) -> Column:
    """The best name of a row's ``_files``: by the fields ``first``, then right kind, same year, no year, name."""

    def ranked(f: Column) -> Column:
        year = F.when(f["year"] == F.col("target"), 0).when(f["year"].isNull(), 1).otherwise(2)
        return F.struct(*[f[c].alias(c) for c in first], (f["compulsory"] != F.col("_p")).cast("int").alias("miss"), year.alias("off"), f["name"].alias("name"))

    return F.array_min(F.transform("_files", ranked))["name"]


def _probed(policies: DataFrame, address: Column) -> tuple[DataFrame, DataFrame]:
    """(policies with their probe, distinct probes): everything the choice depends on."""
    kind, target, plate = _wanted(policies)
    rows = policies.select(
        "id",
        F.struct(
            kind.alias("kind"), target.alias("target"), F.coalesce(plate, F.lit("")).alias("plate"), F.coalesce(address, F.lit("")).alias("address")
        ).alias("probe"),
    )
    rows = cut_lineage(rows)
    return rows, rows.select("probe", "probe.*").distinct()


def _answer(rows: DataFrame, hits: DataFrame, order: Column) -> DataFrame:
    best = hits.groupBy("probe").agg(F.min(F.struct(order.alias("rank"), F.col("name").alias("file"))).alias("_b"))
    return rows.join(best, "probe", "left").select("id", F.col("_b.file").alias("file"))


def file_strict_cascade(policies: DataFrame, files: DataFrame) -> DataFrame:
    """id, file. Motor and compulsory by plate (file plate inside the policy's); other types by address.

    Address tiers: equal (a file key also answers to its first 12 characters), then the first 15 or 12 characters,
    then the first file key sharing the first 10. Within a tier: not special, right kind, same year, no year, name.
    Which tier wins depends on the address alone, so a distinct plate or address has one list, the first name per year and
    kind; a policy meets one list and chooses inside its row.
    Policies: id, policy_type, license_plate, address, coverage_start, coverage_end.
    """
    kind, target, plate = _wanted(policies)
    by_address = kind.isin("FIRE", "ASSET", "IAR", "BURGLAR", "PA", "TA")
    asked = F.when(kind.isin("M", "P"), plate).when(by_address, X.address_compact("address"))
    rows = policies.select("id", (kind == "P").alias("_p"), target.alias("target"), by_address.alias("_by_address"), F.nullif(asked, F.lit("")).alias("_asked"))
    rows = cut_lineage(rows)
    asking = rows.filter("_asked is not null")
    texts = cut_lineage(asking.select("_by_address", F.col("_asked").alias("text")).distinct())
    told = ["year", "compulsory", "special"]
    groups = scan_groups(files, ["plate", "strict_key", *told])
    listed = F.collect_list(F.struct(*told, "name")).alias("_files")

    plates = _least_names(groups.filter("plate is not null"), ["plate", *told]).groupBy("plate").agg(listed)
    pairs = contained_pairs(groups.select(F.col("plate").alias("key")).filter("key is not null").distinct(), texts.filter("not _by_address").select("text"))
    held = pairs.withColumnRenamed("key", "plate").join(plates, "plate").select("text", F.inline("_files"))
    of_plate = _least_names(held, ["text", *told]).groupBy("text").agg(listed)

    addressed = groups.filter("plate is null and strict_key is not null")
    keyed = addressed.select(F.explode(F.array_distinct(F.array("strict_key", F.substring("strict_key", 1, 12)))).alias("akey"), *told, "name")
    keyed = cut_lineage(_least_names(keyed, ["akey", *told]).groupBy("akey").agg(listed))
    addresses = texts.filter("_by_address").select("text")
    text = F.col("text")
    tries = [F.struct(F.lit(1).alias("tier"), text.alias("akey"))]
    tries += [F.struct(F.lit(2).alias("tier"), F.when(F.length(text) >= 15, F.substring(text, 1, n)).alias("akey")) for n in (15, 12)]
    exact = addresses.select("text", F.inline(F.array(*tries))).filter("akey is not null")
    # Third tier: the first key (in name order) of at least 10 characters that starts as the address does.
    start = F.substring(text, 1, 10)
    sizes = sorted(r.n for r in addresses.select(F.length(start).alias("n")).distinct().collect())  # at most ten numbers
    starts = F.array(*[F.substring("akey", 1, n) for n in sizes]).cast("array<string>")
    first_key = keyed.filter(F.length("akey") >= 10).select("akey", F.array_min(F.transform("_files", lambda f: f["name"])).alias("_first"))
    by_start = first_key.select(F.explode(starts).alias("_start"), "akey", "_first").groupBy("_start").agg(F.min_by("akey", F.struct("_first", "akey")).alias("akey"))
    third = addresses.withColumn("_start", start).join(by_start, "_start").select("text", F.lit(3).alias("tier"), "akey")
    hits = exact.unionByName(third).join(keyed, "akey").groupBy("text").agg(F.collect_list(F.struct("tier", "_files")).alias("_hits"))  # four at most
    first = F.array_min(F.transform("_hits", lambda h: h["tier"]))
    of_address = hits.select("text", F.flatten(F.transform(F.filter("_hits", lambda h: h["tier"] == first), lambda h: h["_files"])).alias("_files"))

    lists = of_plate.select(F.lit(False).alias("_by_address"), F.col("text").alias("_asked"), "_files").unionByName(of_address.select(F.lit(True).alias("_by_address"), F.col("text").alias("_asked"), "_files"))
    answered = asking.join(lists, ["_by_address", "_asked"], "left").select("id", _least_listed("special").alias("file"))
    return answered.unionByName(rows.filter("_asked is null").select("id", F.lit(None).cast("string").alias("file")))


def file_by_prefix_key(policies: DataFrame, files: DataFrame) -> DataFrame:
    """id, file. Tries the whole address, its first 20 and 15 characters, then the name; the first that finds any wins.

    A file key fits when it equals or extends the tried key, or is a start of it of at least 8 characters. Which try wins
    depends on the texts alone, so distinct texts are answered with a list, the first name per year and kind; a policy
    meets one list and chooses inside its row.
    Policies: id, policy_type, address, person, coverage_start, coverage_end.
    """
    kind, target, _ = _wanted(policies)
    rows = policies.select("id", (kind == "P").alias("_p"), target.alias("target"), X.address_compact("address").alias("_full"), X.address_compact("person").alias("_person"))
    full, person = F.col("_full"), F.col("_person")
    tries = F.array(
        F.struct(F.lit(0).alias("tier"), full.alias("tried")),
        F.struct(F.lit(1).alias("tier"), F.when(F.length(full) > 20, F.substring(full, 1, 20)).alias("tried")),
        F.struct(F.lit(2).alias("tier"), F.when(F.length(full) > 15, F.substring(full, 1, 15)).alias("tried")),
        F.struct(F.lit(3).alias("tier"), person.alias("tried")),
    )
    rows = cut_lineage(rows)
    texts = rows.select("_full", "_person").distinct()
    tried = cut_lineage(texts.select("_full", "_person", F.inline(F.filter(tries, lambda t: F.length(t["tried"]) > 0))))
    words = tried.select("tried").distinct()
    groups = scan_groups(files, ["prefix_key", "year", "compulsory"]).filter("prefix_key is not null")
    keys = groups.select("prefix_key").distinct()
    words, keys = cut_lineage(words), cut_lineage(keys)
    extends = prefix_pairs(words.select(F.col("tried").alias("short")), keys.select(F.col("prefix_key").alias("long")))
    starts = prefix_pairs(keys.filter(F.length("prefix_key") >= 8).select(F.col("prefix_key").alias("short")), words.select(F.col("tried").alias("long")))
    starts = starts.filter("short <> long")  # equal texts come from the other direction
    pairs = extends.select(F.col("short").alias("tried"), F.col("long").alias("prefix_key")).unionByName(starts.select(F.col("long").alias("tried"), F.col("short").alias("prefix_key")))
    found = _least_names(pairs.join(groups, "prefix_key"), ["tried", "year", "compulsory"])
    lists = found.groupBy("tried").agg(F.collect_list(F.struct("year", "compulsory", "name")).alias("_files"))
    best = tried.join(lists, "tried").groupBy("_full", "_person").agg(F.min_by("_files", "tier").alias("_files"))
    asks = (full != "") | (person != "")
    answered = rows.filter(asks).join(best, ["_full", "_person"], "left").select("id", _least_listed().alias("file"))
    return answered.unionByName(rows.filter(~asks).select("id", F.lit(None).cast("string").alias("file")))


def file_by_first_token(policies: DataFrame, files: DataFrame) -> DataFrame:
    """id, file. Any policy with a plate by plate; then fire types by the first word of the address."""
    rows, probes = _probed(policies, F.split_part(F.substring(F.trim("address"), 1, 40), F.lit(" "), F.lit(1)))
    groups = scan_groups(files, ["plate", "first_token", "year", "compulsory"])
    told = ["year", "compulsory"]
    facts = [*told, "name"]
    plates = _least_names(groups.filter("plate is not null"), ["plate", *told])
    pairs = contained_pairs(
        plates.select(F.col("plate").alias("key")).distinct(), probes.filter("plate <> ''").select(F.col("plate").alias("text")).distinct()
    )
    by_plate = (
        probes.join(pairs.withColumnRenamed("text", "plate").withColumnRenamed("key", "_fp"), "plate")
        .join(plates.withColumnRenamed("plate", "_fp"), "_fp")
        .withColumn("tier", F.lit(0))
    )
    by_token = (
        probes.filter("kind in ('FIRE', 'ASSET', 'IAR', 'BURGLAR') and address <> ''")
        .join(_least_names(groups.filter("plate is null").withColumn("address", F.col("first_token")), ["address", *told]), "address")
        .withColumn("tier", F.lit(1))
    )
    shape = ["probe", "target", "kind", "tier", *facts]
    hits = by_plate.select(*shape).unionByName(by_token.select(*shape))
    order = F.struct("tier", (F.col("compulsory") != (F.col("kind") == "P")).cast("int"), _year_rank(), "name")
    return _answer(rows, hits, order)


def scored_files(policies: DataFrame, files: DataFrame, top: int = 3) -> DataFrame:
    """id, confidence and the ``top`` candidates as rank, file, score, reason (one row with nulls when there is none).

    Plate equal 100, file plate of five or more that starts the policy's 80. Only without those: first 15 of the
    address 90; then first 10, 70; then name 60. The right kind alone when any is; 20 more for the same year, at most
    100. HIGH from 100, MED from 80, else LOW; NONE without a candidate.
    Policies: id, policy_type, license_plate, address, person, coverage_start, coverage_end.
    """
    kind, target, plate = _wanted(policies)
    first = lambda c, n: F.when(F.length(c) >= n, F.substring(c, 1, n))
    address, person = X.address_compact("address"), X.name_key_anchored(F.trim("person"))
    rows = policies.select(
        "id", (kind == "P").alias("wanted"), F.coalesce(target, F.lit(-1)).alias("target"), F.when(~plate.isin("", "OTHER"), plate).alias("plate"),
        F.substring(address, 1, 15).alias("address"), F.when(F.length(person) >= 6, F.substring(person, 1, 15)).alias("person"),
    )
    scans = with_scan_facts(files.select("name").distinct()).withColumn("person_key", X.name_key_anchored("plain"))
    bare = F.col("plate").isNull()
    # A name file answers when its key (at most 15 characters) starts the name, or starts with the name's first 8.
    scans = cut_lineage(
        scans.select(
            "name", "year", "compulsory", "plate", F.when(bare, F.substring("address_key", 1, 15)).alias("address"),
            F.when(bare & (F.length("person_key") >= 6), F.substring("person_key", 1, 15)).alias("person"),
        )
    )

    def listed(on: Column, score: int, reason: str) -> DataFrame:
        """Per key the files that can be among the best: ``top`` of each year and kind. A key that a third of all files share
        is one row here, and no list is longer than the years allow."""
        few = _first_names(scans.select(on.alias("_on"), "year", "compulsory", "name").filter("_on is not null"), ["_on", "year", "compulsory"], top)
        one = F.struct("year", "compulsory", "name", F.lit(score).alias("score"), F.lit(reason).alias("reason"))
        return few.groupBy("_on").agg(F.collect_list(one).alias("_files"))

    def gathered(df: DataFrame, key: str, on: Column, *lists: DataFrame) -> DataFrame:
        """``key`` with the files of every text that it asks ``lists`` for, one after the other."""
        asked = df.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_on", F.explode(on))
        found = reduce(DataFrame.unionByName, [asked.join(x, "_on") for x in lists])
        return found.groupBy(key).agg(F.flatten(F.collect_list("_files")).alias("_files"))

    def best(found: Column) -> Column:
        """The ``top`` of a row's files, among those of the right kind if there are any."""

        def scored(f: Column) -> Column:
            same = F.coalesce(f["year"] == F.col("target"), F.lit(False))
            score = F.when(same, F.least(F.lit(100), f["score"] + 20)).otherwise(f["score"])
            reason = F.when(same, F.concat(f["reason"], F.lit("+year"))).otherwise(f["reason"])
            return F.struct((f["compulsory"] != F.col("wanted")).cast("int").alias("miss"), (-score).alias("down"), f["name"].alias("file"), reason.alias("reason"))

        return F.slice(F.array_sort(F.array_distinct(F.transform(found, scored))), 1, top)

    answered = []

    def settle(left: DataFrame, found: Column) -> DataFrame:
        """Keeps the answers of a tier and gives back the rows that have none, for the next."""
        tried = cut_lineage(left.withColumn("_best", best(found)).select("id", "_best", *[F.when(F.col("_best").isNull(), F.col(c)).alias(c) for c in rows.columns[1:]]))
        answered.append(tried.filter("_best is not null").select("id", F.filter("_best", lambda x: x["miss"] == F.get("_best", F.lit(0))["miss"]).alias("_best")))
        return tried.filter("_best is null").drop("_best")

    rows = cut_lineage(rows)
    shorter = F.filter(prefixes(F.col("plate"), 5), lambda p: p != F.col("plate"))
    exact, longer = listed(F.col("plate"), 100, "plate-exact"), listed(F.col("plate"), 80, "plate-prefix")
    of_plate = gathered(rows, "plate", shorter, longer).unionByName(exact.withColumnRenamed("_on", "plate"))
    of_plate = of_plate.groupBy("plate").agg(F.flatten(F.collect_list("_files")).alias("_files"))
    rest = settle(rows.join(of_plate, "plate", "left"), F.col("_files"))
    for size, score in ((15, 90), (10, 70)):
        found = listed(first(F.col("address"), size), score, f"addr-{size}")
        rest = settle(rest.withColumn("_on", first(F.col("address"), size)).join(found, "_on", "left"), F.col("_files"))
    by_start = gathered(rest, "person", prefixes(F.col("person"), 6, 15), listed(F.col("person"), 60, "name"))
    starts = scans.select(F.explode(prefixes(F.col("person"), 6, 8)).alias("_on"), "year", "compulsory", "name")
    few = _first_names(starts, ["_on", "year", "compulsory"], top)
    by_stem = few.groupBy("_on").agg(F.collect_list(F.struct("year", "compulsory", "name", F.lit(60).alias("score"), F.lit("name").alias("reason"))).alias("_more"))
    rest = rest.join(by_start, "person", "left").withColumn("_on", F.substring("person", 1, 8)).join(by_stem, "_on", "left")
    none = F.array().cast(by_start.schema["_files"].dataType)
    found = F.when(F.col("_files").isNotNull() | F.col("_more").isNotNull(), F.concat(F.coalesce("_files", none), F.coalesce("_more", none)))
    rest = settle(rest, found)

    hit = F.posexplode("_best").alias("rank", "_hit")
    hits = reduce(DataFrame.unionByName, answered)
    top_score = -F.get("_best", F.lit(0))["down"]
    confidence = F.when(top_score >= 100, "HIGH").when(top_score >= 80, "MED").otherwise("LOW")
    hits = hits.select("id", confidence.alias("confidence"), hit)
    hits = hits.select("id", "confidence", (F.col("rank") + 1).alias("rank"), F.col("_hit.file").alias("file"), (-F.col("_hit.down")).alias("score"), F.col("_hit.reason").alias("reason"))
    empty = [F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in ("rank", "file", "score", "reason")]
    return hits.unionByName(rest.select("id", F.lit("NONE").alias("confidence"), *empty))


# -- coverage and follow-up ------------------------------------------------------------------------------------------
def plate_coverage(plates: DataFrame, files: DataFrame) -> DataFrame:
    """Active plates against file plates: file plates found, their files and bytes, and policy plates covered.

    ``plates``: plate (without blanks); ``files``: plate, length. A file plate is found when it lies inside a plate.
    """
    per_plate = files.filter("plate is not null").groupBy("plate").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    pairs = contained_pairs(per_plate.select(F.col("plate").alias("key")), plates.select(F.col("plate").alias("text")).filter("text <> ''").distinct())
    found = pairs.select(F.col("key").alias("plate")).distinct().join(per_plate, "plate")
    covered = pairs.agg(F.count_distinct("text").alias("covered_plates"))
    totals = found.agg(
        F.count("*").alias("file_plates"), F.coalesce(F.sum("files"), F.lit(0)).cast("long").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes")
    )
    return totals.join(F.broadcast(covered))  # one row on each side


def already_linked(links: DataFrame, policies: DataFrame, attachments: DataFrame) -> DataFrame:
    """``linked`` per file: a main file when every match has a document; another when every match has one of that name.

    ``links``: path, name, doc_kind, policy_id.
    """
    has = policies.groupBy(F.col("id").alias("policy_id")).agg(F.bool_and(F.col("pdf_url").isNotNull()).alias("_has")).filter("_has")
    has = has.select("policy_id", F.lit(True).alias("_main"), F.lit("").alias("_what"))
    named = attachments.select("policy_id", F.lit(False).alias("_main"), F.col("pdf_filename").alias("_what")).distinct()
    there = has.unionByName(named).withColumn("_there", F.lit(True))  # one side, so a link is looked up once
    main = F.coalesce(F.col("doc_kind") == "main", F.lit(False))
    asked = links.filter("policy_id is not null").withColumns({"_main": main, "_what": F.when(main, "").otherwise(F.col("name"))})
    done = F.coalesce("_there", F.lit(False))
    joined = asked.join(there, ["policy_id", "_main", "_what"], "left").withColumn("_done", done)
    return joined.groupBy("path", "name", "doc_kind").agg(F.bool_and("_done").alias("linked"))


def documents_of(policies: DataFrame) -> DataFrame:
    """policy_id, ``has`` (every row of the policy has a document) and ``names`` of its documents, for ``has_document_of``."""
    return policies.groupBy(F.col("id").alias("policy_id")).agg(F.bool_and(F.col("pdf_url").isNotNull()).alias("has"), F.collect_set("pdf_filename").alias("names"))


def has_document_of(doc_kind: Column, name: Column, told: Column) -> Column:
    """``already_linked`` for a file with one policy, ``told`` being that policy's row of ``documents_of``."""
    return F.coalesce(F.when(doc_kind == "main", told["has"]).otherwise(F.array_contains(told["names"], name)), F.lit(False))


def sole_link_action(doc: Column, policy_type: Column) -> Column:
    """``link_actions`` for a file with one policy."""
    return (
        F.when(doc == "main", "link")
        .when((doc == "prb") & (policy_type == "P"), "link")
        .when(doc.isin("prb", "endorsement", "other"), "attach")
    )


def link_actions(links: DataFrame, policies: DataFrame) -> DataFrame:
    """One row per write: path, policy_id, action (link / attach) and doc_type.

    main links every match. prb links matches of type P and attaches to those of type M, else attaches to the first
    match. endorsement and other attach to the first match. ``links``: path, doc_kind, policy_id, place (1 is first).
    """
    kind = policies.select(F.col("id").alias("policy_id"), F.upper("policy_type").alias("_type"))
    rows = links.filter("policy_id is not null").join(kind, "policy_id", "left")
    vehicle = F.bool_or(F.coalesce(F.col("_type").isin("M", "P"), F.lit(False))).over(W.partitionBy("path"))  # links are made once
    rows = rows.withColumn("_vehicle", vehicle)
    doc, first = F.col("doc_kind"), F.col("place") == 1
    action = (
        F.when(doc == "main", "link")
        .when((doc == "prb") & (F.col("_type") == "P"), "link")
        .when((doc == "prb") & (F.col("_type") == "M"), "attach")
        .when((doc == "prb") & ~F.col("_vehicle") & first, "attach")
        .when(doc.isin("endorsement", "other") & first, "attach")
    )
    return rows.withColumn("action", action).filter("action is not null").select("path", "policy_id", "action", F.col("doc_kind").alias("doc_type"))
