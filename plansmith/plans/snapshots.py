"""Finished rows kept under the digest of what they were made from, so that a later run makes only those of changed inputs anew.

A snapshot is Parquet in buckets of documents. A refresh reads which documents have other digests than theirs in the snapshot, computes these alone, and overwrites the buckets that hold any of them. Readers
take a document's rows from the snapshot if its digest is that of the input, and else fall back to fresh rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage

BUCKETS = 64
_BUCKET, _DIGEST = "snapshot_bucket", "input_digest"


def input_digests(inputs: DataFrame, key: str) -> DataFrame:
    """One row a document: key and ``input_digest`` over all its rows and columns, whatever their order; repeated rows count."""
    row = F.sha2(F.to_json(F.struct(*sorted(c for c in inputs.columns if c != key)), {"ignoreNullFields": "false"}), 256)
    each = inputs.select(key, row.alias("_row")).groupBy(key, "_row").agg(F.count("*").alias("_n"))
    return each.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "_row", "_n"))), ","), 256).alias(_DIGEST))


def _old(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # none yet, or one without rows
            raise
        return None


def refresh(inputs: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], path: str, buckets: int = BUCKETS) -> DataFrame:
    """Bring the snapshot at ``path`` up to ``inputs`` and return its rows, without digests.

    ``compute`` makes rows with the key from the inputs of the documents that changed or are new; documents that are gone from the inputs go. Only buckets with such documents are written, by
    overwriting their partitions; what a run adds in columns is null for older rows. A document without rows is computed again each time. Null keys are a document.
    """
    spark = inputs.sparkSession
    digests, _ = stage(input_digests(inputs, key), "digests")
    old = _old(spark, path)
    same = lambda a, b: a[key].eqNullSafe(b[key])
    if old is None:
        changed, gone = digests, None
    else:
        held = old.select(key, _DIGEST).distinct()
        d, h = digests.alias("d"), held.alias("h")
        changed, _ = stage(d.join(h, same(digests.alias("d"), held.alias("h")) & (F.col(f"d.{_DIGEST}") == F.col(f"h.{_DIGEST}")), "left_anti"), "changed")
        gone, _ = stage(h.join(d, F.col(f"h.{key}").eqNullSafe(F.col(f"d.{key}")) & (F.col(f"d.{_DIGEST}") == F.col(f"h.{_DIGEST}")), "left_anti"), "gone")
    c = changed.select(F.col(key).alias("_key"), _DIGEST)
    wanted = inputs.join(c.select("_key"), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    made = compute(wanted).join(c, F.col(key).eqNullSafe(F.col("_key"))).drop("_key").withColumn(_BUCKET, bucket)
    if old is not None:
        touched = changed.select(bucket.alias("_b")).union(gone.select(bucket.alias("_b"))).distinct()
        bad = gone.select(F.col(key).alias("_key"), F.lit(True).alias("_gone"))
        kept = old.join(F.broadcast(touched), F.col(_BUCKET) == F.col("_b"), "left_semi").join(bad, F.col(key).eqNullSafe(F.col("_key")), "left_anti")  # a row for each bucket at most
        made = kept.unionByName(made, allowMissingColumns=True)
        made, _ = stage(made, "buckets")
        emptied = touched.join(made.select(_BUCKET).distinct(), F.col("_b") == F.col(_BUCKET), "left_anti").select("_b").collect()  # at most the number of buckets
        _drop_buckets(spark, path, [r["_b"] for r in emptied])
    writer = made.repartition(buckets, _BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(_BUCKET).parquet(path)
    return spark.read.schema(made.schema).parquet(path).drop(_BUCKET, _DIGEST)


def _drop_buckets(spark, path: str, numbers: list[int]) -> None:
    jvm = spark.sparkContext._jvm
    for n in numbers:
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/{_BUCKET}={n}")
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def read_back(path: str, inputs: DataFrame, key: str, fresh: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of every document of the inputs: from the snapshot where its digest is the input's, made by ``fresh`` where it is not; ``from_snapshot`` says which. Without a snapshot all are fresh."""
    spark = inputs.sparkSession
    old = _old(spark, path)
    if old is None:
        return fresh(inputs).withColumn("from_snapshot", F.lit(False))
    digests = input_digests(inputs, key).select(F.col(key).alias("_key"), F.col(_DIGEST).alias("_digest"))
    good = old.join(digests, F.col(key).eqNullSafe(F.col("_key")) & (F.col(_DIGEST) == F.col("_digest")), "left_semi")
    have = good.select(F.col(key).alias("_key")).distinct()
    rest = inputs.join(have, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    return good.drop(_BUCKET, _DIGEST).withColumn("from_snapshot", F.lit(True)).unionByName(fresh(rest).withColumn("from_snapshot", F.lit(False)), allowMissingColumns=True)
