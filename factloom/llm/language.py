"""Language identification: Viterbi over the words of a text, within the languages its scripts allow.

A word scores by its letter trigrams under each language. Switching the language between two words costs a fixed
penalty, so the best path labels spans of mixed text; the language with the most letters wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Slots, held_out, lean, kept_alone, named, text_of

GRAMS = 1 << 16
#: A word's letters: numbers such as ½ or Ⅷ are none; marks, vowel signs among them, stay inside.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: The first code point of each script range.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
)
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_OF = np.array([NAMES.index(n) for _, n in SCRIPTS])


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of words with a space on either side, and the word each belongs to."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    mixed = points[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ points[2:] * np.uint64(0x165667B19E3779F9)
    mixed = (mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)
    inner = points[1:-1] != 32
    return mixed[inner].astype(np.int64), np.cumsum(points[:-2] == 32)[inner] - 1


def _scripts(words: list[str]) -> np.ndarray:
    """Each word's script: that of its first letter."""
    return SCRIPT_OF[np.searchsorted(STARTS, [ord(w[0]) for w in words], "right") - 1]


class Model:
    """Trigram scores per language and the scripts each language is written in."""

    def __init__(self, langs: list[str], table: np.ndarray, scripts: np.ndarray, penalty: float, level: np.ndarray | None = None, floor: float = -np.inf):
        self.langs, self.table, self.scripts, self.penalty = langs, table, scripts, penalty
        self.level = np.zeros(GRAMS, np.float32) if level is None else level  # log likelihood of a trigram where it is likeliest
        self.floor = floor  # of a text's mean level per letter, if it is in a language of the model
        self._forget()

    def _forget(self) -> None:
        """Drops the words met so far."""
        self.known = Slots()
        self.scores, self.letters, self.levels = np.zeros((0, len(self.langs)), np.float32), np.zeros(0, np.int32), np.zeros(0)

    def __reduce__(self):
        return Model, (self.langs, self.table, self.scripts, self.penalty, self.level, self.floor)

    def _learn(self, tokens: list[str]) -> None:
        """Scores of words not met before: the sum over their trigrams; languages of other scripts are out."""
        cut = [LETTERS.findall(t.lower()) for t in tokens]
        letters = np.array([sum(map(len, c)) for c in cut], np.int32)
        scores, levels = np.zeros((len(tokens), len(self.langs)), np.float32), np.zeros(len(tokens))
        parts, owner = [p for c in cut for p in c], np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        if parts:
            grams, word = _grams(parts)
            for k in range(len(self.langs)):
                scores[:, k] = np.bincount(owner[word], self.table[grams, k], len(tokens))
            fits = self.scripts[_scripts(parts)]
            levels = np.bincount(owner[word], np.where(fits.any(1)[word], self.level[grams], self.level.min()), len(tokens))
            fits |= ~fits.any(1, keepdims=True)  # a script that no language uses tells nothing
            np.subtract.at(scores, owner, np.where(fits, 0, 50).astype(np.float32))
        self.scores, self.letters = np.concatenate([self.scores, scores]), np.concatenate([self.letters, letters])
        self.levels = np.concatenate([self.levels, levels])

    def label(self, texts: list[str], most: int = 1 << 23) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the language of each word (split at white space) along the best path, and the words' letters."""
        for path, words in self._paths(texts, most):
            yield path, self.letters[words]

    def _paths(self, texts: list[str], most: int = 1 << 23, cached: int = 150_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the best path and the numbers of its words.

        Texts advance together in blocks of at most ``most`` words times languages, or one text. Words met are forgotten
        after the block in which they pass ``cached``; a block ends when it brings as many new ones.
        """
        block: list[np.ndarray] = []
        size = 0
        for text in texts:
            ids = np.fromiter(map(self.known.__getitem__, text.split()), np.int32)
            block.append(ids)
            size += ids.size
            if size > most // max(1, len(self.langs)) or len(self.known.fresh) > cached:
                yield from self._block(block)
                block, size = [], 0
                if len(self.known) > cached:
                    self._forget()
        yield from self._block(block)
        if len(self.known) > cached:
            self._forget()

    def _block(self, words: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self._learn(self.known.fresh)
        self.known.fresh = []
        lengths = np.array([w.size for w in words], np.int64)
        order = np.argsort(-lengths, kind="stable")
        # Word t of all texts that are that long lie side by side, the longest text first.
        active = len(words) - np.searchsorted(np.sort(lengths), np.arange(lengths.max(initial=0)), "right")
        first = np.concatenate([[0], np.cumsum(active)])
        ids = np.zeros(first[-1], np.int32)
        for k, text in enumerate(order):
            ids[first[: lengths[text]] + k] = words[text]
        path = self._best(ids, active, first)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        for k, w in enumerate(words):
            yield path[first[: w.size] + place[k]], w

    def _best(self, ids: np.ndarray, active: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best path through every text: one step takes a word of each text that still has one."""
        langs = np.arange(len(self.langs))
        path = np.zeros(ids.size, np.int16)
        if not ids.size or not langs.size:
            return path
        came = np.zeros((ids.size, langs.size), np.int8 if langs.size < 128 else np.int16)
        total = np.zeros((active[0], langs.size), np.float32)
        rows = np.arange(active[0])
        for t, m in enumerate(active):
            here = slice(first[t], first[t + 1])
            best = total[:m].argmax(1)
            jump = (total[rows[:m], best] - self.penalty)[:, None]
            came[here] = np.where(total[:m] < jump, best[:, None], langs)
            total[:m] = np.maximum(total[:m], jump) + self.scores[ids[here]]
        state = total.argmax(1)
        for t in range(len(active) - 1, -1, -1):
            m, here = active[t], slice(first[t], first[t + 1])
            path[here] = state[:m]
            state[:m] = came[here][rows[:m], state[:m]]
        return path

    def spans(self, text: str) -> list[tuple[str, str]]:
        """The runs of one language in a text: (language, words)."""
        out: list[tuple[str, str]] = []
        path, _ = next(self.label([text]))
        for k, w in zip(path.tolist(), text.split()):
            if out and out[-1][0] == self.langs[k]:
                out[-1] = (out[-1][0], f"{out[-1][1]} {w}")
            else:
                out.append((self.langs[k], w))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language with the most letters on the path (ties: the first in order) and its share of the letters."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """As ``predict``, and the mean level per letter: how likely the letters are in any language of the model."""
        langs, scores, levels = [], np.zeros(len(texts)), np.full(len(texts), -np.inf)
        for k, (path, words) in enumerate(self._paths(texts)):
            letters = self.letters[words]
            mass = np.bincount(path, letters, len(self.langs)) if self.langs else np.zeros(1)
            langs.append(self.langs[mass.argmax()] if mass.sum() else "und")
            if mass.sum():
                scores[k], levels[k] = mass.max() / mass.sum(), self.levels[words].sum() / mass.sum()
        return langs, scores, levels


def fit(docs: DataFrame, fit_docs: int = 1500, penalty: float = 12.0, text: str = "text", floor: bool = False, margin: float = 3.0) -> Model:
    """The model of the rows that may teach: not held out, with text and language.

    It is fitted on a sample of about ``fit_docs`` whole documents per language, picked by the hash of their id; every
    language with such rows is learned, at 256 KB each. Only trigram counts reach the driver. If asked, its floor is set
    ``margin`` nats a letter below the level that 99 % of the sample's documents reach.
    """
    taught = docs.select(named("doc_id").alias("doc_id"), named(text).alias("text"), named("lang").cast("string").alias("lang"))
    taught = taught.filter(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = taught.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return Model([], np.zeros((GRAMS, 0), np.float32), np.zeros((len(NAMES), 0), bool), penalty)
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, fit_docs / r["count"]))))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    sample = taught.filter(unit < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                words = [w for t in texts for w in LETTERS.findall(t.lower())]
                if words:
                    found = np.bincount(_grams(words)[0], minlength=GRAMS + len(NAMES))
                    np.add.at(found, GRAMS + _scripts(words), 1)
                    key = np.nonzero(found)[0]
                    yield pd.DataFrame({"lang": lang, "key": key, "n": found[key]})

    rows = sample.select("lang", "text").mapInPandas(counted, "lang string, key int, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((GRAMS + len(NAMES), len(langs)))
    counts[rows["key"], rows["lang"].map(langs.index).astype(int)] = rows["n"]
    table = counts[:GRAMS]
    logs = np.log((table + 0.3) / (table.sum(0) + 0.3 * (table.sum(1) > 0).sum()))
    level = logs.max(1)
    level[table.sum(1) == 0] = logs.min()
    logs -= logs.max(1, keepdims=True)
    logs[table.sum(1) == 0] = 0
    used = counts[GRAMS:] / np.maximum(1, counts[GRAMS:].sum(0))
    model = Model(langs, np.maximum(logs, -8).astype(np.float32), used >= 0.01, penalty, level.astype(np.float32))
    if floor:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        # A filter would be pushed below the function and judge each text there too, in a second worker of the same task.
        found, level = sample.select(_judged(shared, F.col("text")).getField("level").alias("level")), F.col("level")
        reached = found.agg(F.percentile_approx(F.when(level > -np.inf, level), 0.01)).first()[0]
        shared.destroy()
        model.floor = -np.inf if reached is None else reached - margin
    return model


def _judged(shared: Broadcast, text: Column) -> Column:
    """Language, share of letters and mean level of a text. A worker has the model, and the words it met, once."""

    @F.pandas_udf("lang string, s double, level double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        kept_alone("language", bool)
        langs, scores, levels = shared.value.judge(texts.tolist())
        return pd.DataFrame({"lang": langs, "s": scores, "level": levels})

    return judge(text)


def with_language(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: `und` and 0 for a null text or one without a letter.

    Whole texts are read, in Arrow batches; equal texts get equal answers. Columns that clash with the two give way.
    """
    shared = lean(docs.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("lang string, s double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        kept_alone("language", bool)
        langs, scores = shared.value.predict(texts.tolist())
        return pd.DataFrame({"lang": langs, "s": scores})

    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    found = docs.select(*(named(c) for c in kept), predict(text_of(text)).alias("__found"))
    return found.select(*(named(c) for c in kept), F.col("__found.lang").alias("lang_pred"), F.col("__found.s").alias("score"))


def known_language(docs: DataFrame, model: Model, min_score: float = 0.2) -> DataFrame:
    """``docs`` whose language is known: a letter at all, one language with ``min_score`` of the letters, and letters as
    likely as the model's floor asks. Words of a script that no language of the model uses count as the least likely."""
    lean(docs.sparkSession)
    found = docs.select(*(named(c) for c in docs.columns), _judged(docs.sparkSession.sparkContext.broadcast(model), text_of()).alias("__found"))
    known = (F.col("__found.lang") != "und") & (F.col("__found.s") >= min_score) & (F.col("__found.level") >= model.floor)
    return found.filter(known).select(*(named(c) for c in docs.columns))
