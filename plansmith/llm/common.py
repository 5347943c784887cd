"""Helpers shared by the operators of this subpackage: staging in the shared folder and labels of graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import new_path, shared_dir, stage  # noqa: F401


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a staged table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


BROADCAST_BYTES = 4 << 20


def array_bytes(column: str, each: int, rest: int) -> Column:
    """About how many bytes a row takes with an array of so large elements and so much else."""
    return F.greatest(F.size(column), F.lit(0)).cast("long") * each + rest


def small_side(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a staged table, marked for broadcast if its rows sum up to at most ``limit`` bytes; else as it is, for a shuffled join.

    ``row_bytes`` is a number for rows of a fixed width, a column that measures each row for others.
    """
    size = df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Label every node of an undirected graph with the smallest node it can reach.

    ``edges`` has two columns of one orderable type; edges from a node to itself and repeated
    edges are allowed, rows with a null end are ignored. Returns ``node`` and ``component`` for every
    node that has an edge. Large-star and small-star rounds run until every node is tied to one end.
    Each half round stages one smallest neighbour for each node, a grouping with partial minima, and joins it to the edges: by
    broadcast while it is small, else as a plain join of two shuffled sides, of which Spark splits a hub's edges over tasks.
    """
    spark = edges.sparkSession
    cur = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct()
    cur, path = stage(cur, "cc")
    for _ in range(max_rounds):
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour is tied to the smallest of the neighbourhood
        low, low_path = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-low")
        large = both.join(small_side(low, 24), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, large_path = stage(large.where(F.col("u") != F.col("v")).distinct(), "cc-large")
        # small star: a node and its smaller neighbours are tied to the smallest of them
        least, least_path = stage(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(small_side(least, 24), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        nxt, nxt_path = stage(small.where(F.col("u") != F.col("v")).distinct(), "cc")
        for p in (path, low_path, large_path, least_path):
            drop_path(spark, p)
        cur, path = nxt, nxt_path
        # settled: every node has one smaller neighbour, and that has none
        ends = cur.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionAll(cur.select("v", F.lit(None)).distinct())
        if ends.groupBy("x").agg(F.count("up").alias("up"), F.count("*").alias("n")).where("up > 1 OR (up > 0 AND n > up)").isEmpty():
            break
    else:
        raise RuntimeError(f"connected_components: not settled after {max_rounds} rounds")
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
