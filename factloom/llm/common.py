"""What the operators of this package share: words, row keys, written intermediates."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import checkpoint_dir

#: The white space that separates words and pads lines: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = 2**63 - 1


def named(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str = "text") -> Column:
    """The whole text; null is empty."""
    return F.coalesce(named(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def id_order(name: str = "doc_id") -> Column:
    """The id as a key that is never null: rows without an id come after all others, as one document."""
    return F.coalesce(named(name).cast("long"), F.lit(NO_ID))


def held_out(name: str = "doc_id") -> Column:
    """Rows that no model may learn labels from: crc32 of the id's text mod 5 is 0. A null id counts as held out."""
    return F.coalesce(F.crc32(named(name).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def others(df: DataFrame, *added: str) -> list[Column]:
    """The columns a result keeps beside those it adds; an input column that clashes with an added one gives way."""
    taken = {a.lower() for a in added}
    return [named(c) for c in df.columns if c.lower() not in taken]


def lean(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """The session with Arrow batches of at most ``rows`` rows: texts may be long, and a worker holds a batch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder that the cluster names in spark.checkpoint.dir."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, safe from lost executors, free of lineage."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes a table made by ``written`` that no later plan reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unsized(df: DataFrame) -> DataFrame:
    """A side of a join that Spark must not broadcast by its estimate: a written table counts as its compressed files, and
    what explodes as if each row gave one, so tables far beyond the driver's memory can seem small."""
    return df.hint("merge")


_KEPT: dict[Hashable, Any] = {}


def kept_alone(name: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker keeps from task to task under a name. Workers serve one stage after another and caches are large, so
    asking for another name drops what was kept before."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


class Slots(dict):
    """Numbers keys as they come and remembers the new ones."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self.fresh.append(key)
        self[key] = len(self)
        return self[key]
