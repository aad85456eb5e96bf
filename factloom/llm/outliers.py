"""Quality rules: robust multivariate outliers among text statistics, in DataFrame functions only.

The statistic vectors of each language and source get a minimum-covariance-determinant estimate: from medians and
quartile ranges as a start, each concentration step keeps the rows within the group's ``share`` quantile of Mahalanobis
distance and takes mean and covariance of those. A document is rejected if its distance passes ``cutoff``.

Every step is a partial aggregate per group, so a hot source combines before the shuffle. Repeated words are found
inside each row by sorting its window hashes; texts are never exploded or shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import BLANKS, named, others, text_of, written

SYMBOLS = "#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The smallest standard deviation of each transformed statistic: size, word length, symbols, repeated lines, repeated words.
FLOORS = (0.7, 0.05, 0.04, 0.15, 0.15)
P = len(FLOORS)
GROUP = ["__lang", "__source"]


def _without(text: Column, chars: str) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x)), chars, text)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its statistics (long) and ``__n_lines``, the lines with a word."""
    t = text_of(text)
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = docs.select(*others(docs, *STATISTICS), t.alias("__text")).withColumn("__words", words)
    window = F.transform("__words", lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2)))
    df = df.withColumn("__windows", F.slice(window, 1, F.greatest(F.size("__words") - 2, F.lit(0))))
    # Only texts that repeat a window pay for sorting: equal hashes come to lie side by side.
    ordered = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__sorted", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), ordered))
    twice = lambda x, k: x["h"].eqNullSafe(F.get("__sorted", k - 1)["h"]) | x["h"].eqNullSafe(F.get("__sorted", k + 1)["h"])
    df = df.withColumn("__starts", F.sort_array(F.transform(F.filter("__sorted", twice), lambda x: x["i"])))
    # Each repeated window covers three words, less where the next one begins sooner.
    widths = F.transform("__starts", lambda s, k: F.least(F.lit(3), F.coalesce(F.get("__starts", k + 1) - s, F.lit(3))))
    df = df.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    chars = F.char_length(_without(F.col("__text"), BLANKS))
    return df.select(
        *others(docs, *STATISTICS),
        F.size("__words").cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        (F.octet_length("__text") - F.octet_length(_without(F.col("__text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(widths, F.lit(0), lambda n, w: n + w), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__lines").alias("__n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> list[Column]:
    part = lambda n, of: F.sqrt(F.col(n) / F.greatest(F.col(of), F.lit(1)))
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words"), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        part("n_symbols", "word_chars"), part("n_dup_lines", "__n_lines"), part("n_repeat_words", "n_words"),
    ]


def _distance(centre: list[Column], root: list[list[Column]]) -> Column:
    """The squared Mahalanobis distance of x0..x4: forward substitution through the covariance's Cholesky root."""
    z: list[Column] = []
    for j in range(P):
        rest = F.col(f"x{j}") - centre[j]
        for k in range(j):
            rest = rest - root[j][k] * z[k]
        z.append(rest / root[j][j])
    return reduce(lambda a, b: a + b, (x * x for x in z))


def _by_group(rows: DataFrame, groups: DataFrame, most: int = 50_000) -> DataFrame:
    """``rows`` with what ``groups`` has for theirs: broadcast up to ``most`` groups (some MB), else a join that splits hot ones."""
    return rows.join(F.broadcast(groups) if groups.count() <= most else groups, GROUP, "left")


def _measured(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``rows`` with ``d2``, the squared distance by the model of the row's group."""
    centre = [F.col(f"m{j}") for j in range(P)]
    root = [[F.col(f"l{j}{k}") for k in range(j + 1)] for j in range(P)]
    return _by_group(rows, model).withColumn("d2", _distance(centre, root)).drop(*(c for c in model.columns if c not in GROUP))


def _rooted(stats: DataFrame) -> DataFrame:
    """The model table from ``m*`` and ``s*`` (lower triangle of the covariance): one column of the root at a time."""
    for j in range(P):
        for i in range(j, P):
            left = F.col(f"s{i}{j}") + (F.lit(FLOORS[j] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # Rounding may leave a pivot below the floor that the covariance has by construction.
            stats = stats.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(FLOORS[j] ** 2))) if i == j else left / F.col(f"l{j}{j}"))
    return stats.select(*GROUP, *(f"m{j}" for j in range(P)), *(f"l{j}{k}" for j in range(P) for k in range(j + 1)))


def _start(rows: DataFrame) -> DataFrame:
    """Medians and quartile ranges of each group: the start that outliers cannot move."""
    q = rows.groupBy(*GROUP).agg(*(F.percentile_approx(f"x{j}", [0.25, 0.5, 0.75], 1000).alias(f"q{j}") for j in range(P)))
    spread = {f"s{j}{k}": ((F.col(f"q{j}")[2] - F.col(f"q{j}")[0]) / 1.349) ** 2 if j == k else F.lit(0.0) for j in range(P) for k in range(j + 1)}
    return _rooted(q.withColumns({**{f"m{j}": F.col(f"q{j}")[1] for j in range(P)}, **spread}))


def _concentrated(rows: DataFrame, model: DataFrame, share: float, widen: float, prior: int) -> DataFrame:
    """One concentration step. Each group is joined by ``prior`` rows of the whole table, so that few rows bind little."""
    near = _measured(rows, model)
    bound = near.groupBy(*GROUP).agg(F.percentile_approx("d2", share, 1000).alias("bound"))
    near = _by_group(near, written(bound, "bounds")).filter("d2 <= bound")
    names = {f"t{j}": F.col(f"x{j}") for j in range(P)} | {f"t{j}{k}": F.col(f"x{j}") * F.col(f"x{k}") for j in range(P) for k in range(j + 1)}
    sums = near.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), *(F.sum(e).alias(c) for c, e in names.items()))
    sums = written(sums, "group-sums")
    whole = sums.agg(F.sum("n").alias("an"), *(F.sum(c).alias(f"a{c}") for c in names))
    sums = sums.join(F.broadcast(whole))  # one row
    mean = lambda t, n: F.col(t) / F.col(n)
    out = {"w": F.col("n") / (F.col("n") + prior)}
    for j in range(P):
        out[f"m{j}"] = F.col("w") * mean(f"t{j}", "n") + (1 - F.col("w")) * mean(f"at{j}", "an")
        for k in range(j + 1):
            own = mean(f"t{j}{k}", "n") - mean(f"t{j}", "n") * mean(f"t{k}", "n")
            all_ = mean(f"at{j}{k}", "an") - mean(f"at{j}", "an") * mean(f"at{k}", "an")
            out[f"s{j}{k}"] = widen * (F.col("w") * own + (1 - F.col("w")) * all_)
    for name, c in out.items():
        sums = sums.withColumn(name, c)
    return _rooted(sums)


def with_verdict(docs: DataFrame, share: float = 0.75, widen: float = 1.41, cutoff: float = 40.0, steps: int = 3, prior: int = 100, text: str = "text") -> DataFrame:
    """``doc_id``, the statistics, ``base_failed`` and ``kept`` of each row of ``docs``.

    A null text has no words, a very long one is counted whole in its row; null languages and sources are groups of their own beside empty ones. ``widen`` makes the
    covariance of the inner ``share`` of a normal distribution in five dimensions that of the whole. Ties at a bound are
    inside. Repeated rows count each. Without rows that pass the base rules nothing is estimated and nothing is kept.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("="), named(c).cast("string")), F.lit(""))
    slim = docs.select("doc_id", named(text).alias("text"), key("lang").alias("__lang"), key("source").alias("__source"))
    found = with_statistics(slim, "text").drop("text").withColumn("base_failed", base_failed())
    found = written(found.withColumns({f"x{j}": c for j, c in enumerate(_vector())}), "statistics")
    rows = found.filter("not base_failed").select(*GROUP, *(f"x{j}" for j in range(P)))
    model = written(_start(rows), "model")
    for _ in range(steps):
        model = written(_concentrated(rows, model, share, widen, prior), "model")
    far = _by_group(found, model)
    centre = [F.col(f"m{j}") for j in range(P)]
    d2 = _distance(centre, [[F.col(f"l{j}{k}") for k in range(j + 1)] for j in range(P)])
    kept = ~F.col("base_failed") & F.coalesce(d2 <= cutoff, F.lit(False))
    return far.select("doc_id", *STATISTICS, "base_failed", kept.alias("kept"), d2.alias("distance2"))
