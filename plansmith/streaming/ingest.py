"""Documents as they arrive: a file stream whose batches go through the batch code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.docx import cells
from ..sources.plan_tables import parse_plans


def file_stream(spark: SparkSession, folder: str, glob: str = "*.docx", files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder as doc_id, name, size and content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "content")


def plans_to(path: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that parses plans and writes a batch's positions under its number, so that a repeated batch replaces itself."""

    def handle(batch: DataFrame, number: int) -> None:
        parse_plans(cells(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle


def ingest_plans(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Parse what is there and stop; run again for what has come since."""
    return files.writeStream.foreachBatch(plans_to(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
