"""Session and table helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for one machine; on a cluster the caller's own session is used instead."""
    b = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", shuffle_partitions)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    return b.config(map=defaults | conf).getOrCreate()


#: Rows that a task sorts or groups at most, but for those of one key.
TASK_ROWS = 1 << 19


def tasks_for(df: DataFrame) -> int | None:
    """As many tasks as keep each near TASK_ROWS rows of ``df``; None where the session's own number of tasks does."""
    tasks = -(-df.count() // TASK_ROWS)
    return tasks if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` shuffled by ``keys`` into as many tasks as keep each near TASK_ROWS rows; as it is where the session's own number of tasks does.

    So what a task holds in memory to sort or group its keys does not grow with the table.
    """
    tasks = tasks_for(df)
    return df.repartition(tasks, *keys) if tasks else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
