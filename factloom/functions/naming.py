"""Name heuristics and labels (H1-H5) as Column expressions over column names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name patterns, most telling measure names first.
MEASURE_TIERS = (
    r"revenue|sales|gmv",
    r"mrr|arr|recurring",
    r"amount|total|net|value",
    r"profit|margin",
    r"latency|duration|response_time|_ms$",
    r"price|cost",
    r"seats|quantity|units|qty",
)
AVERAGED = r"price|latency|duration|_ms$|rate|pct|percent|ratio|score|age|discount"
FLAGS = r"churn|cancel|error|fail|refund|return|bounce"
DURATIONS = r"latency|duration|_ms$"
PERCENTAGES = r"pct|percent"
MONEY = r"revenue|sales|gmv|mrr|arr|amount|price|cost|profit|total"
ACRONYMS = ("mrr", "arr", "gmv", "sku", "url", "id", "ip", "roi", "ltv", "cac")
AGGREGATION_WORDS = {
    "sum": "Total",
    "avg": "Average",
    "count": "Count of",
    "count_distinct": "Distinct",
    "min": "Minimum",
    "max": "Maximum",
}
FLAG_NOUNS = {
    "churn": "Churn",
    "cancel": "Cancellation",
    "error": "Error",
    "fail": "Failure",
    "refund": "Refund",
    "return": "Return",
    "bounce": "Bounce",
}


def _column(c: Column | str) -> Column:
    return F.lit(c) if isinstance(c, str) else c


def measure_tier(name: Column) -> Column:
    """H1: index of the first matching name pattern, 7 when none does."""
    return F.coalesce(
        *(F.when(name.rlike(pattern), F.lit(tier)) for tier, pattern in enumerate(MEASURE_TIERS)),
        F.lit(len(MEASURE_TIERS)),
    )


def is_flag(name: Column) -> Column:
    """H2: a boolean worth tracking over time."""
    return name.rlike(FLAGS)


def default_aggregation(name: Column) -> Column:
    """H3."""
    return F.when(name.rlike(AVERAGED), F.lit("avg")).otherwise(F.lit("sum"))


def value_format(name: Column, aggregation: Column | str) -> Column:
    """H4: number, duration_ms, percent or currency."""
    name = F.coalesce(name, F.lit(""))
    return (
        F.when(_column(aggregation).isin("count", "count_distinct"), F.lit("number"))
        .when(name.rlike(DURATIONS), F.lit("duration_ms"))
        .when(name.rlike(PERCENTAGES), F.lit("percent"))
        .when(name.rlike(MONEY), F.lit("currency"))
        .otherwise(F.lit("number"))
    )


def capitalised(text: Column) -> Column:
    """First letter up, the rest as is (``initcap`` would lower the rest)."""
    return F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def uncapitalised(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def phrase(name: Column) -> Column:
    """H5: "net_revenue" as "net revenue", "mrr" as "MRR" (mid-sentence form)."""
    text = F.regexp_replace(name, "_", " ")
    text = F.regexp_replace(text, r"(?s)^(.*?)\bpct\b", "$1%")
    text = F.regexp_replace(text, r"(?s)^(.*?)\bms\b", "$1")
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    shown = F.transform(words, lambda w: F.when(F.lower(w).isin(*ACRONYMS), F.upper(w)).otherwise(F.lower(w)))
    return F.array_join(shown, " ")


def humanize(name: Column) -> Column:
    return capitalised(phrase(name))


def flag_noun(name: Column) -> Column:
    """H5: "churned" as "Churn", "is_error" as "Error"."""
    return F.coalesce(
        *(F.when(name.rlike(word), F.lit(noun)) for word, noun in FLAG_NOUNS.items()),
        humanize(F.regexp_replace(name, r"^(is|has)_", "")),
    )


def measure_label(name: Column, aggregation: Column | str) -> Column:
    """H5: "Total revenue", "Average latency", "Rows"."""
    aggregation = _column(aggregation)
    word = F.coalesce(*(F.when(aggregation == k, F.lit(v)) for k, v in AGGREGATION_WORDS.items()))
    return F.when(name.isNull() | (name == "") | (aggregation == "count"), F.lit("Rows")).otherwise(
        F.concat_ws(" ", word, phrase(name))
    )


def entity_label(id_column: Column) -> Column:
    """H5: "order_id" as "Orders"."""
    base = F.regexp_replace(id_column, r"(?i)(_id|id_|^id)$", "")
    base = F.coalesce(F.nullif(F.btrim(F.regexp_replace(base, "_", " ")), F.lit("")), F.lit("record"))
    return capitalised(F.when(base.endswith("s"), base).otherwise(F.concat(base, F.lit("s"))))
