"""Quality classifier by compression: which of two dictionaries shortens a text more.

One zstandard dictionary is built from good texts, one from bad ones. The difference of the two compressed sizes, as a
share of the text, and the compressed share itself (repetition) become a score by logistic calibration on labelled texts
that built neither dictionary.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import kept_alone, held_out, lean, named, text_of

LEVEL = 3
_OPEN: dict[tuple[bytes, bytes], tuple[zstandard.ZstdCompressor, ...]] = {}


class Model:
    """Two dictionaries and the calibration of their difference."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = good, bad
        self.low = self.high = self.weights = None
        self.constant: float | None = None

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: size difference and smaller size as shares of the bytes, and the logarithm of the bytes."""
        key = (self.good, self.bad)
        if key not in _OPEN:
            both = [zstandard.ZstdCompressionDict(d) for d in key]
            for d in both:
                d.precompute_compress(level=LEVEL)
            _OPEN[key] = tuple(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False) for d in both)
        good, bad = _OPEN[key]
        out = np.empty((len(texts), 3))
        for k, text in enumerate(texts):
            raw = text.encode("utf-8", "surrogatepass")
            g, b, n = len(good.compress(raw)), len(bad.compress(raw)), max(1, len(raw))
            out[k] = (b - g) / n, np.log(min(g, b) / n), np.log(n)
        return out

    def _design(self, x: np.ndarray) -> np.ndarray:
        x = (np.clip(x, self.low, self.high) - self.low) / np.maximum(self.high - self.low, 1e-9)
        return np.column_stack([np.ones(len(x)), x, x**2, x[:, :1] * x[:, 1:], x[:, 1:2] * x[:, 2:]])

    def calibrate(self, texts: list[str], labels: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> Model:
        """Logistic regression by Newton steps."""
        x = self.features(texts)
        self.low, self.high = np.quantile(x, 0.001, 0), np.quantile(x, 0.999, 0)
        x = self._design(x)
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (labels - p) - ridge * w
            w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        self.weights = w
        return self

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None or not len(texts):
            return np.full(len(texts), self.constant or 0.0)
        return 1 / (1 + np.exp(-np.clip(self._design(self.features(texts)) @ self.weights, -30, 30)))


def _dictionary(texts: list[str], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, [t.encode("utf-8", "surrogatepass") for t in texts]).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their content itself
        return "\n".join(texts).encode("utf-8", "surrogatepass")[-size:]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_docs: int = 3000, fit_bytes: int = 24_000_000, size: int = 64 << 10, text: str = "text") -> Model:
    """The model of labelled rows that are not held out.

    The sample is bounded: at most ``fit_docs`` documents of each label, those with the smallest hash of their id, and
    ``fit_bytes`` bytes in all. Half of each label builds its dictionary (``size`` bytes), the other half calibrates. If
    one label is missing the score is the share of label 1 among the taught rows, and 0.5 without any. Of labels that
    disagree on a document the smaller counts.
    """
    taught = labels.select(named("doc_id").alias("doc_id"), named(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    taught = taught.filter(~held_out()).groupBy("doc_id").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["count"] for r in taught.groupBy("label").count().collect()}
    # Twice as many as wanted, as a label may have no document.
    order = F.xxhash64("doc_id")
    picked = [taught.filter(F.col("label") == k).orderBy(order, "doc_id").limit(2 * fit_docs) for k in (0, 1)]
    known = docs.select(named("doc_id").alias("doc_id"), text_of(text).alias("text")).filter(F.col("doc_id").isNotNull())
    sized = known.select("doc_id", F.octet_length("text").alias("bytes")).join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    sized = sized.groupBy("doc_id", "label").agg(F.max("bytes").alias("bytes")).orderBy(order, "doc_id").collect()
    chosen: dict[int, int] = {}
    room = {0: [fit_docs, fit_bytes // 2], 1: [fit_docs, fit_bytes // 2]}
    for row in sized:
        left = room[row["label"]]
        if left[0] > 0 and row["bytes"] <= left[1]:
            left[0], left[1] = left[0] - 1, left[1] - row["bytes"]
            chosen[row["doc_id"]] = row["label"]
    # An Arrow table needs no Python workers; a list is read by some that stay beside those of the functions.
    ids = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(list(chosen), pa.int64())}))
    texts = {r["doc_id"]: r["text"] for r in known.join(F.broadcast(ids), "doc_id").orderBy("text").collect()}
    sets = {k: [texts[i] for i, v in chosen.items() if v == k] for k in (0, 1)}
    if min(map(len, sets.values())) < 2:
        model = Model(b"", b"")
        model.constant = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
        return model
    build = {k: s[: len(s) // 2] for k, s in sets.items()}
    tell = {k: s[len(s) // 2 :] for k, s in sets.items()}
    model = Model(_dictionary(build[1], size), _dictionary(build[0], size))
    model.calibrate(tell[0] + tell[1], np.repeat([0.0, 1.0], [len(tell[0]), len(tell[1])]))
    # The sample is balanced, the labels are not: the prior moves the intercept.
    model.weights[0] += np.log(counts[1] / counts[0] * len(tell[0]) / len(tell[1]))
    return model


def _score(docs: DataFrame, model: Model, text: Column) -> Column:
    shared = lean(docs.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        kept_alone("quality", bool)
        return pd.Series(shared.value.score(texts.tolist()))

    return score(text)


def with_quality(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``. A null text scores as an empty one; columns that clash give way.

    Whole texts are compressed, however long; equal texts get equal scores, so repeated rows do; a score of ``threshold``
    itself is predicted 1.
    """
    kept = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    found = docs.select(*(named(c) for c in kept), held_out().alias("held_out"), _score(docs, model, text_of(text)).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_ones(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` that the classifier predicts to be good, in all their columns."""
    found = docs.select(*(named(c) for c in docs.columns), _score(docs, model, text_of()).alias("__score"))
    return found.filter(F.col("__score") >= threshold).select(*(named(c) for c in docs.columns))
