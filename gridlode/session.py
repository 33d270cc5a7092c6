"""A session with the settings that the operators assume."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gridlode", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew splitting, UTC and Arrow; everything else is the cluster's to say."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with a short lineage: columns in the session's shared folder where it names one, else persisted.

    A checkpoint writes whole rows without compression, many times as much. Files stay: a result may still read them.
    """
    spark, folder = df.sparkSession, df.sparkSession.sparkContext.getCheckpointDir()
    if not folder:
        return df.persist()
    path = f"{folder}/gridlode-cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_of(df: DataFrame, size: int = 4 << 20) -> int:
    """Tasks that have ``size`` bytes each of the files that are read; 1 where nothing is known of them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = [n for n in (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())) if n < 1 << 60]
    return max(1, -(-sum(known) // size))


def spread(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """Dealt by keys over all tasks of a shuffle, ``least`` at least: for few rows that become many or are costly, which adaptive execution would put in one task."""
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
