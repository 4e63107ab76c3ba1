"""Session defaults and lineage control."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where none is set on a local master."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^,\]]*)?\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir is not set; on a cluster it names a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, so a lost executor costs no recompute."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, kind: str = "step") -> DataFrame:
    """Like ``cut_lineage``, but as Parquet: a fraction of the bytes for wide rows, and a reader takes only its columns."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to several tasks a core. A file of few row groups else leaves costly work per row to as many tasks."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` and ``columns``, each computed once a row. A plain ``select`` is merged with the filters and expressions above it,
    which copies a costly column into every place that names it; a generated row of one is not."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
