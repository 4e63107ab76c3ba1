"""Table changes as change sets: compute what to write, then write a new snapshot.

Nothing here updates in place. A caller writes the result to a new folder and switches a pointer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.operators.windows import last_per_key


def align(df: DataFrame, schema_of: DataFrame) -> DataFrame:
    """Columns of the target table; missing ones null, unknown ones dropped."""
    return df.select(
        *[
            F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema_of.schema.fields
        ]
    )


def insert_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(align(rows, table))


def update_rows(table: DataFrame, condition: Column | None, **values: Column) -> DataFrame:
    """Set columns where the condition holds. No condition is refused."""
    if condition is None:
        raise ValueError("an update needs a condition")
    hit = F.coalesce(condition, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def touched(table: DataFrame, condition: Column) -> DataFrame:
    """How many rows a condition hits, so that zero is never silent."""
    return table.agg(F.count_if(F.coalesce(condition, F.lit(False))).alias("touched"))


def delete_with_children(parents: DataFrame, children: DataFrame, keys: DataFrame, fk: str = "policy_id") -> tuple[DataFrame, DataFrame]:
    """(parents without the keys, children of the parents that stay)."""
    keys = keys.select("id").distinct()
    return parents.join(keys, "id", "left_anti"), children.join(keys.withColumnRenamed("id", fk), fk, "left_anti")


def protected_upsert(table: DataFrame, incoming: DataFrame, key: str, position: str, insert_only: bool = False) -> DataFrame:
    """``action`` per incoming or existing key.

    insert, update, skipped (insert-only mode), protected (edited by hand), failed (no key), kept (existing only).
    The last incoming row of a key wins. One full outer join of one row per key on each side.
    """
    payload = [c for c in incoming.columns if c not in (key, position)]
    news = last_per_key(incoming.filter(F.col(key).isNotNull()), [key], F.col(position), payload).select(
        key, F.struct(*payload).alias("incoming")
    )
    olds = table.groupBy(key).agg(F.bool_or(F.coalesce("manually_edited", F.lit(False))).alias("_protected"))
    joined = olds.join(news, key, "full_outer")
    action = (
        F.when(F.col("incoming").isNull(), "kept")
        .when(F.col("_protected").isNull(), "insert")
        .when(F.lit(insert_only), "skipped")
        .when(F.col("_protected"), "protected")
        .otherwise("update")
    )
    result = joined.select(key, action.alias("action"), "incoming")
    failed = incoming.filter(F.col(key).isNull()).select(
        F.col(key), F.lit("failed").alias("action"), F.struct(*payload).alias("incoming")
    )
    return result.unionByName(failed)


def apply_upsert(table: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """The table after a plan: updates overlay the incoming columns, inserts are added, the rest stays."""
    fields = [f.name for f in plan.schema["incoming"].dataType.fields if f.name in table.columns and f.name != "manually_edited"]
    updates = plan.filter("action = 'update'").select(key, F.col("incoming").alias("_in"))
    kept = table.join(updates, key, "left")
    kept = kept.withColumns({c: F.when(F.col("_in").isNotNull(), F.col(f"_in.{c}")).otherwise(F.col(c)) for c in fields}).drop("_in")
    added = plan.filter("action = 'insert'").select(key, *[F.col(f"incoming.{c}").alias(c) for c in fields])
    if "manually_edited" in table.columns:
        added = added.withColumn("manually_edited", F.lit(False))
    return kept.select(*table.columns).unionByName(align(added, table))


def action_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("rows"))


def insert_pairs(policies: DataFrame, attachments: DataFrame, existing: DataFrame, position: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(policies to add, their attachments, rejected policies).

    Identity is (policy_number, company or ''). The first of a batch wins; one that exists or repeats is an error for
    that pair only. Attachments follow their policy by ``pair_id``.
    """
    identity = ["policy_number", "_company"]
    company = F.coalesce("company_code", F.lit(""))
    rows = policies.withColumn("_company", company)
    taken = existing.select("policy_number", company.alias("_company")).distinct()
    heads = rows.groupBy(*identity).agg(F.min(position).alias("_first"))
    marked = rows.join(heads, identity).join(taken.withColumn("_taken", F.lit(True)), identity, "left")
    reason = F.when(F.col("_taken"), "exists").when(F.col(position) != F.col("_first"), "repeated")
    marked = marked.withColumn("reason", reason).drop("_company", "_first", "_taken")
    added = marked.filter("reason is null").drop("reason")
    return added, attachments.join(added.select("pair_id"), "pair_id", "left_semi"), marked.filter("reason is not null")


def sparse_patch(table: DataFrame, patch: DataFrame, key: str, position: str, columns: list[str]) -> DataFrame:
    """Non-empty patch values over the table's, by key; later patch rows of a key win per column.

    Adds ``patched``. A patch key the table lacks changes nothing.
    """
    def filled(c: str) -> Column:
        return F.nullif(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(""))

    values = patch.groupBy(key).agg(
        *[F.max_by(F.when(filled(c).isNotNull(), filled(c)), F.when(filled(c).isNotNull(), F.col(position))).alias(f"_{c}") for c in columns]
    )
    joined = table.join(values, key, "left")
    changed = F.coalesce(*[F.col(f"_{c}") for c in columns]).isNotNull()
    out = joined.withColumn("patched", changed).withColumns({c: F.coalesce(f"_{c}", F.col(c)) for c in columns})
    return out.select(*table.columns, "patched")


def exact_corrections(table: DataFrame, corrections: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(report, table after). Each correction must hit exactly one row; if any misses, the table comes back unchanged.

    The report has one row per correction: hits, value before, value after. ``corrections``: key, new_value.
    """
    hits = table.groupBy(key).agg(F.count("*").alias("hits"), F.min(column).alias("before"))
    report = corrections.join(hits, key, "left").select(
        key, F.coalesce("hits", F.lit(0)).alias("hits"), "before", F.col("new_value").alias("after")
    )
    verdict = report.agg(F.coalesce(F.bool_and(F.col("hits") == 1), F.lit(True)).alias("_all_exact"))
    once = corrections.groupBy(key).agg(F.count("*").alias("_n"), F.min("new_value").alias("_new"))
    joined = table.join(once, key, "left").join(F.broadcast(verdict))  # one row by construction
    value = F.when(F.col("_all_exact") & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col(column))
    return report, joined.withColumn(column, value).select(*table.columns)


def stub_parents(references: DataFrame, table: DataFrame, key, note: str) -> DataFrame:
    """One minimal parent per referenced number that the table lacks, with an id derived from the number."""
    have = table.select(key("policy_number").alias("_key")).distinct()
    wanted = references.withColumn("_key", key("policy_number")).filter("_key <> ''")
    missing = wanted.join(have, "_key", "left_anti").groupBy("_key").agg(F.min("policy_number").alias("policy_number"))
    return missing.select(
        F.sha2("_key", 256).alias("id"), "policy_number", F.lit(True).alias("manually_edited"), F.lit(note).alias("notes")
    )


def clear_links(table: DataFrame, names: DataFrame, columns: list[str], name: str = "pdf_filename") -> DataFrame:
    """Null the document columns of rows whose file name is listed; adds ``cleared``."""
    listed = names.select(name).distinct().withColumn("_hit", F.lit(True))
    joined = table.join(listed, name, "left").withColumn("cleared", F.coalesce("_hit", F.lit(False)))
    return joined.withColumns({c: F.when(~F.col("cleared"), F.col(c)) for c in columns}).drop("_hit").select(*table.columns, "cleared")


def drop_unlinked(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a document, counts before / deleted / after)."""
    linked = F.col("pdf_url").isNotNull()
    counts = table.agg(F.count("*").alias("before"), F.count_if(~linked).alias("deleted"), F.count_if(linked).alias("after"))
    return table.filter(linked), counts


def relocate(table: DataFrame, marker: str, new_base: str, url: str = "pdf_url") -> DataFrame:
    """Rows whose URL holds the legacy marker get the new base with the same key; adds ``old_url``."""
    key = F.nullif(F.regexp_extract(F.col(url), r"\Q" + marker + r"\E[^/?#]+/([^?#]+)", 1), F.lit(""))
    hits = table.filter(F.col(url).contains(marker)).withColumn("old_url", F.col(url)).withColumn("_key", key)
    moved = F.concat(F.lit(new_base.rstrip("/") + "/"), F.col("_key"))
    return hits.withColumn(url, F.coalesce(moved, F.col(url))).withColumn("moved", F.col("_key").isNotNull()).drop("_key")


def expired_backups(listing: DataFrame, today, days: int, date_in_name: bool = False) -> DataFrame:
    """Backups older than ``days`` by modification time, or by the yyyymmdd / yyyy-mm-dd date in the name."""
    named = F.regexp_replace(F.regexp_extract("name", r"(\d{4}-?\d{2}-?\d{2})", 1), "-", "")
    day = (
        F.concat_ws("-", F.substring(named, 1, 4), F.substring(named, 5, 2), F.substring(named, 7, 2)).try_cast("date")
        if date_in_name
        else F.to_date("modified")
    )
    return listing.withColumn("backup_day", day).filter(F.datediff(F.lit(today), "backup_day") > days)


def presence(ids: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Each id asked for with ``found``."""
    have = table.select(key).distinct().withColumn("_have", F.lit(True))
    return ids.select(key).distinct().join(have, key, "left").select(key, F.coalesce("_have", F.lit(False)).alias("found"))


def ledger_state(events: DataFrame, key: str, position: str) -> DataFrame:
    """Latest state per key of an append-only ledger (states: done, failed, removed)."""
    return last_per_key(events, [key], F.col(position), ["state"]).filter("state <> 'removed'")


def delete_with_objects(ids: DataFrame, table: DataFrame, key_of, columns: list[str]) -> DataFrame:
    """One row per id asked for: ``plan`` delete / not_found, the object key to remove, and the chosen columns."""
    picked = table.select("id", key_of("pdf_url").alias("object_key"), *columns, F.lit(True).alias("_have"))
    plan = F.when(F.col("_have"), "delete").otherwise("not_found")
    return ids.select("id").distinct().join(picked, "id", "left").withColumn("plan", plan).drop("_have")


def bad_references(children: DataFrame, parents: DataFrame, allowed: list[str], fk: str = "policy_id") -> DataFrame:
    """Children that break the foreign key or the closed set of types, with the reasons."""
    have = parents.select(F.col("id").alias(fk)).distinct().withColumn("_have", F.lit(True))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_have").isNull(), F.lit("orphan")),
            F.when(~F.coalesce(F.col("doc_type").isin(allowed), F.lit(False)), F.lit("doc_type")),
        )
    )
    return children.join(have, fk, "left").withColumn("errors", reasons).drop("_have").filter(F.size("errors") > 0)
