"""CSV as strings (S1-S3) with Spark's reader, and its structural errors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import trimmed
from factloom.sources.headers import NO_HEADER, NO_ROWS, ParseError, normalize_columns

BAD = "_bad"
DIALECT = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "encoding": "UTF-8",
           "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _header(spark: SparkSession, path: str, multiline: bool) -> list[str | None]:
    """The first row of the file: one line is read."""
    first = spark.read.options(**DIALECT, multiLine=multiline).csv(path).limit(1).collect()
    if not first or all(not (v or "").strip() for v in first[0]):
        raise ParseError(NO_HEADER)
    cells = list(first[0])
    cells[0] = (cells[0] or "").removeprefix("﻿")
    return cells


def read_csv_strings(spark: SparkSession, path: str, multiline: bool | None = None, check: bool = True) -> DataFrame:
    """Every cell a string, short rows padded with null, names normalised.

    Files are read in splits, those with quoted newlines too: see ``records``. That way is only taken where the text
    shows such a newline (``multiline`` None looks). With ``check`` rows with extra cells or an unclosed quote raise a
    ``ParseError`` that names the row.
    """
    turning, widest = _shape(spark, path) if multiline is None or check else (0, 0)
    multiline = turning > 0 if multiline is None else multiline
    headers = _header(spark, path, multiline)
    fields = [T.StructField(f"_{i}", T.StringType()) for i in range(len(headers))]
    schema = T.StructType([*fields, T.StructField(BAD, T.StringType())])
    # Records are only numbered when the plain look found something; no record is put together before they are sound.
    if check and (turning or widest > len(headers)):
        problem = csv_problems(spark, path).first()
        if problem:
            raise ParseError(problem["message"])
    if multiline:
        parsed = F.from_csv("record", schema.simpleString(), {**DIALECT, "multiLine": "true", "columnNameOfCorruptRecord": BAD})
        rows = _body(records(spark, path)).select(parsed.alias("row")).select("row.*")
    else:
        options = {**DIALECT, "header": True, "enforceSchema": True, "columnNameOfCorruptRecord": BAD}
        rows = spark.read.schema(schema).options(**options).csv(path)
    body = drop_blank_rows(rows.select(*(f.name for f in fields)))
    if body.isEmpty():
        raise ParseError(NO_ROWS)
    return normalize_columns(body, headers)


def records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, record)``: the text of each CSV record, quoted newlines included, and its first line's number.

    A split tells how it turns the state at its start, inside quotes or not; splits are composed in order, so each line
    knows the record it belongs to, also where that began in an earlier split. Only lines of records that span lines are
    brought together, by record. Lines end with a newline or with a carriage return and one.
    """
    lines = numbered_lines(spark, path, "\n")
    single = lines.filter(~F.col("open") & ~F.col("turns")).select("file", F.col("line").alias("start"), F.col("text").alias("record"))
    spread = lines.filter(F.col("open") | F.col("turns"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    several = spread.groupBy("file", "start").agg(joined.alias("record"))
    return single.unionByName(several).withColumn("record", F.regexp_replace("record", r"\r$", ""))


def _body(found: DataFrame) -> DataFrame:
    """The records of each file after its header, the first that is not empty."""
    heads = found.filter("record <> ''").groupBy("file").agg(F.min("start").alias("head"))
    return found.join(F.broadcast(heads), "file").filter("start > head")


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """S3: without the rows whose cells are all null or white space."""
    filled = F.lit(False)
    for c in df.columns:
        filled = filled | (trimmed(F.col(f"`{c}`")) != "")
    return df.filter(F.coalesce(filled, F.lit(False)))


# ---------- structure ----------


def _lines(spark: SparkSession, path: str, end: str | None = None) -> DataFrame:
    """``(file, begin, text)``: lines with the split they are read in."""
    reader = spark.read.option("lineSep", end) if end else spark.read
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("begin"),
        F.regexp_replace(F.make_valid_utf8("value"), "^﻿", "").alias("text"),
    )


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def _outside(text: Column) -> Column:
    """The text with its quoted parts taken out."""
    return F.regexp_replace(text, r'"[^"]*"', "q")


def _commas(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))


def _shape(spark: SparkSession, path: str) -> tuple[int, int]:
    """Lines that open or close a quote across lines, and the most cells of any other
    line: one scan without a shuffle of lines."""
    even = _quotes(F.col("text")) % 2 == 0
    return tuple(
        _lines(spark, path)
        .agg(F.count_if(~even), F.coalesce(F.max(F.when(even, _commas(_outside(F.col("text"))) + 1)), F.lit(0)))
        .first()
    )


def _counted(lines: DataFrame) -> DataFrame:
    """Lines as they are read, with their number ``at`` in their split, from 0, and the numbers of the last lines up to them that
    follow an even and an odd number of quotes in it.

    A split is read by one task in order, so a few numbers carried from batch to batch tell this: nothing is shuffled or sorted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, state = None, (0, 0, -1, -1)
        for batch in batches:
            if not batch.num_rows:
                continue
            files, begins = batch.column("file"), batch.column("begin").to_numpy()
            coded = files.dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(coded) != 0) | (np.diff(begins) != 0)) + 1).tolist(), batch.num_rows]
            quotes = batch.column("quotes").to_numpy()
            found = []
            for a, b in zip(cuts, cuts[1:]):
                own = files[a].as_py(), begins[a]
                n, seen, even, odd = state if own == split else (0, 0, -1, -1)
                at = n + np.arange(b - a)
                sums = seen + np.cumsum(quotes[a:b])
                odds = (sums - quotes[a:b]) % 2 == 1
                evens_at = np.maximum(np.maximum.accumulate(np.where(odds, -1, at)), even)
                odds_at = np.maximum(np.maximum.accumulate(np.where(odds, at, -1)), odd)
                split, state = own, (n + b - a, int(sums[-1]) % 2, int(evens_at[-1]), int(odds_at[-1]))
                found.append((at, evens_at, odds_at))
            at, evens_at, odds_at = map(np.concatenate, zip(*found))
            told = pa.array(at), pa.array(evens_at, mask=evens_at < 0), pa.array(odds_at, mask=odds_at < 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], names=[*batch.schema.names, "at", "last_even", "last_odd"])

    fields = [T.StructField(c, T.LongType()) for c in ("at", "last_even", "last_odd")]
    return lines.mapInArrow(count, T.StructType([*lines.schema, *fields]))


def numbered_lines(spark: SparkSession, path: str, end: str | None = None) -> DataFrame:
    """``(file, line, text, open, turns, start)``: line numbers, whether a line starts inside quotes and whether it turns
    that, and the line its record starts on.

    A split is told by a few numbers for both states it may start in. Running sums over the splits of a file settle its
    state, its offset and the last record before it; the running sums inside a split stay in the task that reads it.
    """
    lines = _lines(spark, path, end).withColumn("quotes", _quotes(F.col("text")).cast("long"))
    # A line that follows an even number of quotes starts a record if the split starts outside quotes, else one that follows an odd number.
    totals = _counted(lines.drop("text")).groupBy("file", "begin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quotes").alias("q"), F.max("last_even").alias("split_even"), F.max("last_odd").alias("split_odd")
    )
    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "file", "begin", "split_even", "split_odd",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"),
        (F.coalesce(F.sum("q").over(before), F.lit(0)) % 2 == 1).alias("opened"),
    )
    last = F.when(F.col("opened"), F.col("split_odd")).otherwise(F.col("split_even")) + F.col("lines_before") + 1
    offsets = offsets.withColumn("carried", F.max(last).over(before)).drop("split_even", "split_odd")
    placed = _counted(lines).join(F.broadcast(offsets), ["file", "begin"])  # a row per split
    start = F.when(F.col("opened"), F.col("last_odd")).otherwise(F.col("last_even")) + F.col("lines_before") + 1
    return placed.select(
        "file", (F.col("lines_before") + F.col("at") + 1).alias("line"), "text",
        (F.col("opened") != F.col("at").eqNullSafe(F.col("last_odd"))).alias("open"),
        (F.col("quotes") % 2 == 1).alias("turns"), F.coalesce(start, "carried").alias("start"),
    )


def csv_problems(spark: SparkSession, path: str) -> DataFrame:
    """``(file, row, message)`` of the first structural error per file, or no row.

    Commas outside quotes are counted per line and added up per record, so no
    record is assembled. A file is at fault when a record has more cells than the
    header or a quote never closes; the first record of another width is named.
    """
    lines = numbered_lines(spark, path)
    # Inside quotes up to the first quote, between quotes, and after the last opening one.
    bare = F.when(F.col("open"), F.regexp_replace("text", r'^[^"]*"?', "")).otherwise(F.col("text"))
    bare = F.regexp_replace(_outside(bare), r'"[^"]*$', "q")
    whole_inside = F.col("open") & ~F.col("turns") & ~F.col("text").contains('"')
    commas = F.when(whole_inside, 0).otherwise(_commas(bare))
    filled = F.regexp_replace(bare, r"(?U)[\s,]", "") != ""
    counted = lines.select("file", "line", "open", "turns", "start", commas.alias("commas"), (filled | F.col("open")).alias("filled"))
    single = counted.filter(~F.col("open") & ~F.col("turns")).select(
        "file", F.col("line").alias("start"), F.col("line").alias("last"), (F.col("commas") + 1).alias("width"), "filled"
    )
    # Lines of records that span lines; a line that opens a quote starts its own.
    several = counted.filter(F.col("open") | F.col("turns")).groupBy("file", "start").agg(
        F.max("line").alias("last"),
        (F.sum("commas") + 1).alias("width"),
        F.lit(True).alias("filled"),
        (F.count_if("turns") % 2 == 1).alias("unclosed"),
    )
    records = single.withColumn("unclosed", F.lit(False)).unionByName(several).filter("filled")
    header = records.groupBy("file").agg(F.min_by("width", "start").alias("expected"))
    odd = (
        records.join(F.broadcast(header), "file")  # a row per file
        .filter(F.col("unclosed") | (F.col("width") != F.col("expected")))
        .groupBy("file", "expected")
        .agg(
            F.bool_or(F.col("unclosed") | (F.col("width") > F.col("expected"))).alias("broken"),
            F.min_by(F.struct("last", "width", "unclosed"), "start").alias("at"),
        )
        .filter("broken")
    )
    row = F.format_number(F.col("at.last"), 0)
    message = F.when(
        F.col("at.unclosed"), F.concat(F.lit("Row "), row, F.lit(" has an unclosed quote. Check the file's quoting."))
    ).otherwise(
        F.concat(F.lit("Row "), row, F.lit(" has "), F.col("at.width"), F.lit(" columns, expected "), F.col("expected"), F.lit("."))
    )
    return odd.select("file", F.col("at.last").alias("row"), message.alias("message")).orderBy("file")
