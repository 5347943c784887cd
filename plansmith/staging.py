"""Staging in the shared folder, and dense row numbers over a staged order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where it is unset and the master is local (tests on one machine) a temporary folder is set for this session; a cluster
    must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="plansmith-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/plansmith-{name}-{uuid.uuid4().hex}"


#: A setting of Spark: the shuffle files of a finished query go at once, not when the driver next collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, path: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` once as Parquet in the shared folder and read it back: it cuts the lineage and survives lost executors.

    The written table is all that later plans read, so the write's own shuffle files are dropped when it ends.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    name = f"_{base}"
    while name in df.columns:
        name = f"_{name}"
    return name


def number_rows(df: DataFrame, order_by: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Add dense global row numbers in the order of ``order_by`` (nulls first) and return them with the number of rows.

    One range partitioning sorts the rows, which are staged so that both reads see the same order; only the count
    of each partition reaches the driver.
    """
    at, part_col, first_col = (free_name(df, x) for x in ("at", "part", "first"))
    ordered, _ = stage(df.sort(*[F.col(f"`{c}`").asc_nulls_first() for c in order_by]).withColumn(at, F.monotonically_increasing_id()), "order")
    part = F.shiftright(at, 33)
    counts = {r["part"]: r["n"] for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    first, starts = 0, []
    for p in sorted(counts):
        starts.append((p, first))
        first += counts[p]
    spark = df.sparkSession
    offsets = spark.createDataFrame(starts, f"`{part_col}` int, `{first_col}` long")  # one row a partition
    numbered = ordered.join(F.broadcast(offsets), part.cast("int") == F.col(part_col)).withColumn(name, F.col(first_col) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    return numbered.drop(part_col, first_col, at), first
