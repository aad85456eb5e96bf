"""Phrase collocations by prefix-free parsing.

A piece of text (between punctuation or line ends) is parsed into chunks that begin where two neighbouring words hash to
a trigger, so that equal passages are cut alike wherever they stand. Each chunk reaches ``WIDEST - 1`` words into the next
one: every phrase of up to ``WIDEST`` words lies inside the chunk that its first word belongs to, and is counted there
alone. The distinct chunks with their frequencies are the dictionary; phrases are counted inside it, weighted.

Two counts over the dictionary keep the rare phrases, nearly all there are, away from the network. The first adds up
64-bit hashes of word pairs; hashes with too low a sum are dropped, and the others fill a bitmap of bounded size. The
second counts phrases by their text, exactly, but only those all of whose pairs are in the bitmap. A pair of a frequent
phrase is frequent itself, so false hits cost rows and nothing else.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import named, text_of, written

WIDEST = 4
PUNCTUATION = b".,;:!?\x0b\x0c\r"
ENDS = bytes.maketrans(PUNCTUATION + b"\t", b"\n" * len(PUNCTUATION) + b" ")
AROUND_END, RUN = re.compile(rb" *\n[ \n]*"), re.compile(rb"  +")
BLOCK = 4_000_000


class Words:
    """The words of a buffer of pieces, one space or newline after each: numbers, places, hashes."""

    def __init__(self, buffer: bytes):
        points = np.frombuffer(buffer, np.uint8)
        gaps = np.nonzero((points == 32) | (points == 10))[0]
        self.start, self.stop = np.concatenate([[0], gaps[:-1] + 1]), gaps
        self.last = points[gaps] == 10  # of its piece
        ends = np.concatenate([[0], gaps + 1]).astype(np.int32)
        same = pa.Array.from_buffers(pa.binary(), gaps.size, [None, pa.py_buffer(ends), pa.py_buffer(buffer.replace(b"\n", b" "))])
        coded = same.dictionary_encode()
        self.id = coded.indices.to_numpy().astype(np.int64)
        self.words = [w[:-1] for w in coded.dictionary.to_pylist()]
        self.hash = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)

    def pairs(self, seed: np.ndarray | int = 0) -> np.ndarray:
        """A hash of each word and the next one; of the last word of the buffer anything."""
        own = self.hash[self.id]
        mixed = own * np.uint64(0x9E3779B97F4A7C15) ^ np.roll(own, -1) * np.uint64(0xC2B2AE3D27D4EB4F) ^ np.asarray(seed, np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return mixed ^ (mixed >> np.uint64(32))

    def left(self) -> np.ndarray:
        """How many words of its piece begin at each word, itself included."""
        ends = np.nonzero(self.last)[0]
        return ends[np.searchsorted(ends, np.arange(self.id.size))] + 1 - np.arange(self.id.size)


def _blocks(text: bytes) -> Iterator[bytes]:
    """A text cut at piece ends into parts of about ``BLOCK`` bytes (a longer piece is one part)."""
    at = 0
    while at < len(text):
        end = text.find(b"\n", at + BLOCK)
        end = len(text) if end < 0 else end + 1
        yield text[at:end]
        at = end


def _parsed(batches: Iterable[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """(lang, chunk, last, n): the chunks of texts (lang, text), counted per task as far as some 100,000 fit."""
    counts: Counter = Counter()

    def told() -> pa.RecordBatch:
        keys = list(counts)
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.binary()), pa.array([k[1] for k in keys]), pa.array(list(counts.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "chunk", "last", "n"])

    def parse(lang: str, buffer: bytes) -> None:
        buffer = RUN.sub(b" ", AROUND_END.sub(b"\n", buffer + b"\n")).lstrip(b" \n")
        if not buffer:
            return
        w = Words(buffer)
        first = np.concatenate([[True], w.last[:-1]])
        cut = np.concatenate([[False], (w.pairs()[:-1] % np.uint64(every)) == 0]) & (w.left() >= WIDEST - 1) & ~first
        begin = np.nonzero(cut | first)[0]
        # A chunk ends with its piece, or where the next one has brought in three more words.
        end = np.concatenate([begin[1:], [w.id.size]])
        inner = np.concatenate([cut[begin[1:]], [False]])
        stop = w.stop[np.where(inner, end + WIDEST - 1, end) - 1]
        for a, b, more in zip(w.start[begin].tolist(), stop.tolist(), inner.tolist()):
            counts[lang, not more, buffer[a:b]] += 1

    for batch in batches:
        waiting: dict[str, list[bytes]] = {}
        sizes: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for part in _blocks(text.lower().translate(ENDS)):
                waiting.setdefault(lang, []).append(part)
                sizes[lang] += len(part)
                if sizes[lang] >= BLOCK:
                    parse(lang, b"\n".join(waiting.pop(lang)))
                    sizes[lang] = 0
                    if len(counts) > 100_000:
                        yield told()
                        counts.clear()
        for lang, parts in waiting.items():
            parse(lang, b"\n".join(parts))
        if len(counts) > 100_000:
            yield told()
            counts.clear()
    if counts:
        yield told()


def _dictionary_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, Words, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Per language and about ``BLOCK`` bytes of chunks: words, each word's weight (0 where the next chunk counts its phrases) and words left."""

    def block(lang: str, chunks: list[bytes], last: list[bool], n: list[int]) -> tuple:
        buffer = b"\n".join(chunks) + b"\n"
        w = Words(buffer)
        ends = np.nonzero(w.last)[0]
        chunk = np.searchsorted(ends, np.arange(w.id.size))
        left = w.left()
        weight = np.where(np.array(last)[chunk] | (left > WIDEST - 1), np.array(n, np.int64)[chunk], 0)
        return lang, w, buffer, weight, left

    held: dict[str, tuple[list, list, list]] = {}
    size = 0
    for batch in batches:
        for lang, chunk, last, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "chunk", "last", "n"))):
            own = held.setdefault(lang, ([], [], []))
            own[0].append(chunk)
            own[1].append(last)
            own[2].append(n)
            size += len(chunk) + 1
            if size >= BLOCK:
                yield from (block(k, *v) for k, v in held.items())
                held, size = {}, 0
    yield from (block(k, *v) for k, v in held.items())


def _summed(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of one of each, and their weights added up."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    at = np.nonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))[0] if keys.size else np.zeros(0, np.int64)
    return ordered[at], order[at], np.add.reduceat(weight[order], at) if keys.size else np.zeros(0, np.int64)


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 7)


def _pair_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, w, _, weight, left in _dictionary_blocks(batches):
        own = (weight > 0) & (left > 1)
        keys, _, n = _summed(w.pairs(_seed(lang))[own], weight[own])
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["h", "n"])


def _bitmap(frequent: DataFrame, bits: int) -> np.ndarray:
    """Bits of the hashes in ``frequent.h``: ``2 ** bits`` of them, merged by Spark in blocks, and no more in the driver."""
    slot = F.shiftrightunsigned("h", 64 - bits)
    blocks = frequent.groupBy(F.shiftrightunsigned(slot, 15).alias("block")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros((max(1, 1 << bits >> 15), 4096), np.uint8)
    for row in blocks.toLocalIterator():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _phrases(batches: Iterable[pa.RecordBatch], bitmap: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """(lang, words, phrase, n): single words, and phrases all of whose pairs are in the bitmap."""
    for lang, w, buffer, weight, left in _dictionary_blocks(batches):
        slot = w.pairs(_seed(lang)) >> np.uint64(64 - bits)
        hot = (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool) & (left > 1)
        key, own = w.id, weight > 0
        for size in range(1, WIDEST + 1):
            if size > 1:
                # Phrases of one word less are numbered; with the number of the next word they tell the longer ones apart.
                own = own & np.concatenate([hot[size - 2 :], np.zeros(size - 2, bool)]) & (left >= size)
                dense = np.zeros(w.id.size, np.int64)
                dense[own] = np.unique(key[own], return_inverse=True)[1]
                key = dense * len(w.words) + np.roll(w.id, 1 - size)
            at = np.nonzero(own)[0]
            _, place, n = _summed(key[at], weight[at])
            at = at[place]
            found = [buffer[a:b] for a, b in zip(w.start[at].tolist(), w.stop[at + size - 1].tolist())]
            columns = [pa.array([lang] * len(found), pa.string()), pa.array(np.full(len(found), size, np.int32)), pa.array(found, pa.binary()), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "words", "phrase", "n"])


def dictionary(docs: DataFrame, every: int = 16, text: str = "text", lang: str = "lang") -> DataFrame:
    """The distinct chunks of ``docs``: ``lang`` (null: ``und``), ``chunk`` (words with one space between), ``last`` (of
    its piece; others hand their last three words on) and ``n``, how often the parse has it.

    About one pair of words in ``every`` is a trigger. Null and empty texts have no chunk; repeated rows count each.
    """
    rows = docs.select(F.coalesce(named(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).cast("binary").alias("text"))
    parsed = rows.mapInArrow(lambda batches: _parsed(batches, every), "lang string, chunk binary, last boolean, n long")
    return parsed.groupBy("lang", "chunk", "last").agg(F.sum("n").alias("n"))


def frequent_phrases(chunks: DataFrame, least: int = 30, bits: int = 27) -> tuple[DataFrame, DataFrame]:
    """Phrases (``lang``, ``words``, ``phrase``, ``f``) of one to four words with f >= ``least``, and (``lang``, ``n``), all words.

    ``bits`` bounds the bitmap of pairs (2 ** 27 bits are 16 MB, in the driver and in every worker). A fuller bitmap lets
    more rare phrases through to the exact count and changes no result.
    """
    sums = chunks.mapInArrow(_pair_hashes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    shared = chunks.sparkSession.sparkContext.broadcast(_bitmap(sums.filter(F.col("n") >= least).select("h"), bits))
    found = chunks.mapInArrow(lambda batches: _phrases(batches, shared.value, bits), "lang string, words int, phrase binary, n long")
    counted = found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f"))
    counted = written(counted.filter((F.col("f") >= least) | (F.col("words") == 1)), "phrase-counts")
    whole = counted.filter("words = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    return counted.filter(F.col("f") >= least).withColumn("phrase", F.col("phrase").cast("string")), whole


def _times(c: Column, by: int) -> Column:
    """An exact product: counts may pass 64 bits."""
    return c.cast("decimal(20,0)") * F.lit(by).cast("decimal(10,0)")


def collocations(docs: DataFrame, least: int = 30, share: int = 80, most: int = 2000, every: int = 16, text: str = "text", lang: str = "lang") -> DataFrame:
    """Per language the first ``most`` phrases of two to four words: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A phrase with a = f(phrase) >= ``least`` scores floor(2,000,000 a / (l + r)) at its weakest cut (ties: the first) into
    parts with f = l and f = r. It is dropped if a longer candidate holds its words side by side and has at least
    ``share`` percent of a. Order: score, a (both descending), phrase in byte order, so no two rows tie. Null texts are
    empty, null languages ``und``; repeated rows count each; an empty table has no rows. Columns besides ``text`` and
    ``lang`` are not read.
    """
    chunks = written(dictionary(docs, every, text, lang), "chunks")
    counted, whole = frequent_phrases(chunks, least)
    known = written(counted, "frequent-phrases")
    several = known.filter("words > 1").withColumnRenamed("f", "a")
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "words", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - words)").alias("rest"))
    part = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    exact = F.expr("cast(a as decimal(20,0)) * 2000000bd div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))
    inside = several.filter("words > 2").select("lang", "a", F.split("phrase", " ").alias("w"), F.explode(F.expr("sequence(2, words - 1)")).alias("size"))
    inside = inside.select("lang", "a", "w", "size", F.explode(F.expr("sequence(1, size(w) - size + 1)")).alias("at"))
    inside = inside.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (_times(F.col("longer"), 100) < _times(F.col("a"), share)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)
    return rows.join(whole, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
