"""Incremental intake as Structured Streaming jobs. Every job resumes from its checkpoint and ends when caught up."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerloom.operators.windows import first_seen


def read_arrivals(spark: SparkSession, folder: str, schema: T.StructType, per_trigger: int | None = None) -> DataFrame:
    """New parquet files of a folder, each once."""
    reader = spark.readStream.schema(schema)
    if per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def process_new(arrivals: DataFrame, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch through ``step`` to a folder named by its id. A batch replayed after a failure overwrites its
    own folder, so nothing is written twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(arrivals: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Files seen and the latest per batch. Each micro-batch writes the batches it changed to a folder of its own id, so a
    replayed one overwrites itself; ``read_progress`` takes the newest row of each batch."""
    counts = arrivals.groupBy("batch_id").agg(F.count("*").alias("done"), F.max("expected").alias("total"), F.max("file_id").alias("current"))

    def write(changed: DataFrame, at: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/at={at}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_progress(spark: SparkSession, target: str) -> DataFrame:
    """(batch_id, done, total, current) as of the newest micro-batch."""
    rows = spark.read.parquet(target)
    return rows.groupBy("batch_id").agg(F.max_by(F.struct("done", "total", "current"), "at").alias("_row")).select("batch_id", "_row.*")


def first_arrivals(arrivals: DataFrame, key: str = "sha256") -> DataFrame:
    """The first file of each content hash, across runs. State is one row per hash."""
    return arrivals.dropDuplicates([key])


def with_pointers(batch: DataFrame, seen: DataFrame | None) -> DataFrame:
    """``same_file_as`` for a table of new files: the file seen earlier with the same hash, in ``seen`` (sha256, file_id;
    one row per hash) first."""
    marked = first_seen(batch, ["sha256"], "file_id", "file_id", "_here")
    if seen is None:
        return marked.withColumnRenamed("_here", "same_file_as")
    earlier = seen.select("sha256", F.col("file_id").alias("_before"))
    return marked.join(earlier, "sha256", "left").withColumn("same_file_as", F.coalesce("_before", "_here")).drop("_here", "_before")


def _first_file(kind: str) -> StatefulProcessor:
    """Made here so that the class travels to the workers by value."""

    class FirstFile(StatefulProcessor):
        """Keeps the first file of a content; every other file points at it. Of the first micro-batch that has the content
        the least file is the first, so only then are its file ids held until all are seen."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.first = handle.getValueState("first", f"file_id {kind}")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            if self.first.exists():
                first, parts = self.first.get()[0], rows
            else:
                parts = [part[["file_id"]] for part in rows]
                first = min(part["file_id"].min() for part in parts)
                self.first.update((first,))
            for part in parts:
                points = [None if file_id == first else first for file_id in part["file_id"]]
                yield pd.DataFrame({"file_id": part["file_id"], "sha256": key[0], "same_file_as": pd.Series(points, dtype=object, index=part.index)})

        def close(self) -> None:
            pass

    return FirstFile()


def pointed(arrivals: DataFrame) -> DataFrame:
    """(file_id, sha256, same_file_as) of every arriving file: the first file seen with the same content, null for that
    one and for a file without a hash. State is one file id per content, read for the contents of the micro-batch only.
    Needs the RocksDB state store; other columns follow by a join on file_id."""
    kind = arrivals.schema["file_id"].dataType.simpleString()
    rows = arrivals.select("file_id", "sha256")
    known = rows.filter("sha256 is not null").groupBy("sha256").transformWithStateInPandas(
        statefulProcessor=_first_file(kind), outputStructType=f"file_id {kind}, sha256 string, same_file_as {kind}", outputMode="Append", timeMode="None"
    )
    return known.unionByName(rows.filter("sha256 is null").withColumn("same_file_as", F.lit(None).cast(kind)))


def process_pointers(arrivals: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """``pointed`` files to ``target``, each micro-batch to a folder of its own id, so a replayed one overwrites itself."""
    return process_new(pointed(arrivals), lambda batch: batch, target, checkpoint)


COMPLETE_BATCH = "batch_id string, files int"
HELD = 256


def _barrier() -> StatefulProcessor:
    """Made here so that the class travels to the workers by value."""

    class Barrier(StatefulProcessor):
        """Holds the files of a batch until the expected number is there, then releases the batch once. Files are held by the
        hash of their id, some ``HELD`` to an entry as first expected: a call to the state store costs more than its bytes."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.files = handle.getMapState("files", "slot int", "file_ids array<string>")
            self.batch = handle.getValueState("batch", "n int, slots int, released boolean")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            expected, (count, slots, released) = 0, self.batch.get() or (0, 0, False)
            for part in rows:
                expected = max(expected, int(part["expected"].max()))
                slots = slots or max(1, expected // HELD)
                arrived: dict[int, set] = {}
                for file_id in part["file_id"]:
                    arrived.setdefault(zlib.crc32((file_id or "").encode()) % slots, set()).add(file_id)
                for slot, ids in arrived.items():
                    entry = self.files.getValue((slot,))
                    held = list(entry[0]) if entry else []
                    new = ids.difference(held)
                    if new:
                        self.files.updateValue((slot,), (held + list(new),))
                        count += len(new)
            done = count >= expected and not released
            self.batch.update((count, slots, released or done))
            if done:
                yield pd.DataFrame({"batch_id": [key[0]], "files": [count]})

        def close(self) -> None:
            pass

    return Barrier()


def complete_batches(arrivals: DataFrame) -> DataFrame:
    """Batches all of whose files have arrived (columns batch_id, file_id, expected). Needs the RocksDB state store.

    State is an entry per some files and a count per batch; of the entries only those are read that arriving files belong to. Files follow by a join on batch_id.
    """
    return arrivals.select("batch_id", "file_id", "expected").groupBy("batch_id").transformWithStateInPandas(
        statefulProcessor=_barrier(), outputStructType=COMPLETE_BATCH, outputMode="Append", timeMode="None"
    )


def complete_batches_once(files: DataFrame) -> DataFrame:
    """The same over a finished table: one aggregate."""
    sizes = files.groupBy("batch_id").agg(F.count_distinct("file_id").alias("files"), F.max("expected").alias("expected"))
    return sizes.filter(F.col("files") >= F.col("expected")).select("batch_id", "files")
