"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app_name: str = "factloom", **conf: str) -> SparkSession:
    """A session pinned to UTC with adaptive execution; ANSI mode stays on."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Recording a call site per expression costs more than building the plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return pin(builder.getOrCreate())


def pin(spark: SparkSession) -> SparkSession:
    """Settings that change results: time zone UTC for every truncation and cast."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, where
    every executor sees the same disk, falls back to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach.")
    folder = os.path.join(tempfile.gettempdir(), "factloom-checkpoints")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, safe from lost executors, free of lineage."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes a table made by ``stored`` that no later plan reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def handful(df: DataFrame, most: int) -> DataFrame:
    """A result of at most ``most`` rows by construction, as literal rows.

    Later steps then plan and run on a few constants instead of on its lineage.
    """
    rows = df.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"Expected at most {most} rows.")
    return df.sparkSession.createDataFrame(rows, df.schema)


SMALL_ROWS = 100_000


def gathered(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """A persisted aggregate in one partition if counting shows that it is small.

    What follows on a small aggregate then runs without further shuffles; a larger
    one stays distributed.
    """
    return df.coalesce(1) if df.count() <= limit else df
