"""File dispatch, typed Parquet and row JSON."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import is_temporal, iso_string
from factloom.session import pin
from factloom.sources.delimited import read_csv_strings
from factloom.sources.headers import ParseError
from factloom.sources.workbooks import read_xlsx_strings

# Accepted files and the message for others.
EXTENSIONS = ("csv", "xlsx")
UNSUPPORTED = "Upload a .csv or .xlsx file."
MANIFEST = "_files"  # a version that shares files with earlier ones lists all of its own here


def file_type(path: str) -> str:
    """The accepted extension of a path."""
    extension = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if extension not in EXTENSIONS:
        raise ParseError(UNSUPPORTED)
    return extension


def read_files(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """An all-string table from a CSV or XLSX file."""
    pin(spark)
    return read_xlsx_strings(spark, path) if (kind or file_type(path)) == "xlsx" else read_csv_strings(spark, path)


def write_typed(df: DataFrame, folder: str, partition_by: list[str] | None = None, name: str | None = None) -> str:
    """A new zstd Parquet version under ``folder``; returns its path.

    The old version is removed by ``drop_versions`` once the new one is in use. A
    ``name`` makes the write repeatable: the same name is overwritten.
    """
    path = f"{folder.rstrip('/')}/version={name or uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def committed_versions(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the versions under ``folder`` that were written to the end, oldest first."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        mark = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if status.getPath().getName().startswith("version=") and fs.exists(mark):
            found.append((fs.getFileStatus(mark).getModificationTime(), status.getPath().toString()))
    return [path for _, path in sorted(found)]


def _file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The Hadoop file system of a path, and the path."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def version_files(spark: SparkSession, path: str) -> list[str]:
    """The files that make up a version: those its manifest names, else all in its folder."""
    fs, root = _file_system(spark, path)
    manifest = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, MANIFEST)
    if fs.exists(manifest):
        return [r["value"] for r in spark.read.text(manifest.toString()).collect()]
    found, files = [], fs.listFiles(root, True)
    while files.hasNext():
        name = files.next().getPath().toString()
        if name.endswith(".parquet"):
            found.append(name)
    return sorted(found)


def purge_version(spark: SparkSession, folder: str, column: str, keys: DataFrame, name: str) -> str | None:
    """A new version without the rows of ``keys`` (one column), or None where there is no version yet.

    Copy on write: the key column alone is read, within the keys' bounds, to find the files that hold any; only those are
    rewritten, without the rows. The version is a manifest of the new files and of all others, which stay as they are. It
    counts once its success mark is there, the last thing written; a repeated call of the same name starts over.
    """
    versions = committed_versions(spark, folder)
    if not versions:
        return None
    files = version_files(spark, versions[-1])
    gone = keys.select(F.col(keys.columns[0]).alias(column)).distinct()
    low, high = gone.agg(F.min(column), F.max(column)).first()
    held = _data(spark, versions[-1], files).filter(F.col(column).between(low, high)) if low is not None else _data(spark, versions[-1], files).limit(0)
    held = held.select(column, F.col("_metadata.file_path").alias("__file")).join(gone, column, "left_semi")
    jvm = spark.sparkContext._jvm
    touched = {jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r[0])).toString() for r in held.select("__file").distinct().collect()}
    path = f"{folder.rstrip('/')}/version={name}"
    fs, root = _file_system(spark, path)
    fs.delete(root, True)
    fs.mkdirs(root)
    if touched:
        left = _data(spark, versions[-1], sorted(touched)).join(gone, column, "left_anti")
        writer = left.write.mode("append").option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        by = _partitions(files)
        (writer.partitionBy(*by) if by else writer).parquet(path)
    whole = version_files(spark, path) + [f for f in files if f not in touched]
    spark.createDataFrame([(f,) for f in whole], "value string").coalesce(1).write.text(f"{path}/{MANIFEST}")
    fs.create(jvm.org.apache.hadoop.fs.Path(root, "_SUCCESS")).close()
    return path


def _partitions(files: list[str]) -> list[str]:
    """The columns that the folders below a version stand for."""
    below = files[0].split("/version=", 1)[-1].split("/")[1:-1] if files else []
    return [f.split("=", 1)[0] for f in below]


def _data(spark: SparkSession, version: str, files: list[str]) -> DataFrame:
    """Some files of a version, in its schema; partition columns come from their folders."""
    if not files:
        return spark.read.parquet(version).limit(0)
    if not _partitions(files):
        return spark.read.parquet(*files)
    return spark.read.option("basePath", version.rstrip("/").rsplit("/", 1)[0]).parquet(*files).drop("version")


def drop_versions(spark: SparkSession, folder: str, keep: str) -> int:
    """Deletes every version under ``folder`` but ``keep``, all but the files that ``keep`` still names."""
    fs, root = _file_system(spark, folder)
    if not fs.exists(root):
        return 0
    kept = keep.rstrip("/").rsplit("/", 1)[-1]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    named = set(version_files(spark, keep)) if fs.exists(path(root, kept)) else set()
    dropped = 0
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if not name.startswith("version=") or name == kept:
            continue
        dropped += 1
        if not any(f"/{name}/" in f for f in named):
            fs.delete(status.getPath(), True)
            continue
        # No longer a version of its own, but the home of files that are still in use.
        fs.delete(path(status.getPath(), "_SUCCESS"), False)
        fs.delete(path(status.getPath(), MANIFEST), True)
        files = fs.listFiles(status.getPath(), True)
        while files.hasNext():
            file = files.next().getPath()
            if file.getName().endswith(".parquet") and file.toString() not in named:
                fs.delete(file, False)
    return dropped


def read_typed(spark: SparkSession, path: str, hot: bool = False) -> DataFrame:
    """A typed table; ``hot`` keeps it in memory, spilling to disk."""
    fs, root = _file_system(spark, path)
    manifest = fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, MANIFEST))
    df = _data(pin(spark), path, version_files(spark, path)) if manifest else pin(spark).read.parquet(path)
    return df.persist(StorageLevel.MEMORY_AND_DISK) if hot else df


def rows_json(df: DataFrame) -> DataFrame:
    """One ``json`` per row: ISO dates, integral doubles as integers, nulls kept."""
    pairs = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        if is_temporal(field.dataType):
            shown = F.concat(F.lit('"'), iso_string(c, field.dataType), F.lit('"'))
        elif kind in ("double", "float"):
            exact = (c == F.floor(c)) & (F.abs(c) < float(2**53))
            shown = F.when(exact, c.try_cast("bigint").cast("string")).otherwise(c.cast("string"))
        elif kind in ("boolean", "byte", "short", "integer", "long"):
            shown = c.cast("string")
        else:
            text = F.to_json(F.struct(c.cast("string").alias("v")))
            shown = F.when(c.isNotNull(), text.substr(F.lit(6), F.length(text) - 6))
        name = '"' + field.name.replace("\\", "\\\\").replace('"', '\\"') + '":'
        pairs.append(F.concat(F.lit(name), F.coalesce(shown, F.lit("null"))))
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")).alias("json"))
