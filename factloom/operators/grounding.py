"""Grounding of written sentences (N1, N2): numbers must come from facts or be dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a number may be without a fact, in matching order.
MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
ALLOWED = (
    r"\{\{\w+\}\}",
    rf"\b{MONTH}\s+\d{{4}}\b",
    rf"\b{MONTH}\s+\d{{1,2}}(?:,\s*\d{{4}})?\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{1,2}:\d{2}\b",
    r"\b(?:19|20)\d{2}\b",
)
REFERENCE = r"\{\{(\w+)\}\}"
TELLING = r"[\d{]"  # every number and every reference holds one of these
NUMBER = r"[-+−]?\$?\d[\d,.]*\s?%?"
UNICODE = "(?U)"  # word, digit, space and boundary classes follow Unicode


def offenders(text: Column, known: Column) -> Column:
    """Unknown ``{{references}}`` first, then the numbers no allowed form covers.

    Texts without a digit or a brace are settled by one look.
    """
    cited = F.regexp_extract_all(text, F.lit(UNICODE + REFERENCE), F.lit(1))
    unknown = F.transform(
        F.filter(cited, lambda r: ~F.array_contains(known, r)), lambda r: F.concat(F.lit("{{"), r, F.lit("}}"))
    )
    rest = text
    for pattern in ALLOWED:
        rest = F.regexp_replace(rest, UNICODE + pattern, " ")
    numbers = F.regexp_extract_all(rest, F.lit(UNICODE + NUMBER), F.lit(0))
    found = F.concat(unknown, F.transform(numbers, lambda n: F.regexp_replace(n, r"(?U)^\s+|\s+$", "")))
    return F.when(text.isNull() | text.rlike(UNICODE + TELLING), found).otherwise(F.array().cast("array<string>"))


def ungrounded_numbers(sentences: DataFrame, facts: DataFrame | None = None, doc: str = "doc_id", text: str = "sentence") -> DataFrame:
    """The sentences with an ``offenders`` array.

    ``facts`` holds ``(doc, fact_id)``. Each fact list belongs to one document and
    is grouped before the join, so the long side is not repeated.
    """
    if facts is None:
        known = sentences.withColumn("_known", F.array().cast("array<string>"))
    else:
        lists = facts.groupBy(doc).agg(F.collect_set("fact_id").alias("_known"))
        known = sentences.join(lists, doc, "left").withColumn(
            "_known", F.coalesce("_known", F.array().cast("array<string>"))
        )
    return known.withColumn("offenders", offenders(F.col(text), F.col("_known"))).drop("_known")


def keep_grounded(sentences: DataFrame, facts: DataFrame | None = None, doc: str = "doc_id", text: str = "sentence") -> DataFrame:
    """Only the sentences without an offender."""
    return ungrounded_numbers(sentences, facts, doc, text).filter(F.size("offenders") == 0).drop("offenders")
