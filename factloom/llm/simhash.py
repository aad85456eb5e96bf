"""SimHash near-dedup: exact links between fingerprints by vantage-point trees.

A vantage point sees one block of the 64 bits. The distances of two fingerprints to it, within the block, differ by at
most their own distance within the block (triangle inequality); blocks are disjoint, so the differences add up over the
levels of the tree to at most the distance of the two. A branch is pruned as soon as the sum passes the radius.

The first levels deal the distinct fingerprints to shards. A shard is also asked by the fingerprints of every other
shard within the bound, in one direction for each pair of shards. Inside a shard both sides walk the rest of the tree
together; leaves compare exactly. Links leave a shard as a forest, never as all pairs of a group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import kept_alone, lean, named, text_of, written
from factloom.llm.graph import components

BLOCKS, BLOCK = 8, 8
#: Any value serves as vantage point: fingerprints are hashes.
VANTAGE = 0x9E3779B97F4A7C15
LEAF = 1 << 18


def fingerprint_of(text: str, width: int = 4, seed: int = 42, batch: int = 1 << 16) -> int:
    """The fingerprint of one text; zero if it has no word. Memory is bounded by ``batch`` shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, blanks \x20 and \x09-\x0D
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, batch):
        part = words[at : at + batch + width - 1]
        shingles = zip(*(part[k:] for k in range(width))) if len(words) > width else [part]
        hashes = np.array([xxhash.xxh64_intdigest(s, seed) for s in map(b" ".join, shingles)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint's 64 bits as a long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        kept_alone("fingerprints", bool)
        return pd.Series(np.array([fingerprint_of(t, width) for t in texts], np.uint64).view(np.int64), dtype="int64")

    lean(docs.sparkSession)
    return docs.select("doc_id", fp(text_of()).alias("fp"))


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n by the pairs (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        for x in (i, j, before[i], before[j]):
            np.minimum.at(label, x, low)
        label = label[label]
        if (label == before).all():
            return label


def _walk(fps: np.ndarray, seen: np.ndarray, a: np.ndarray, b: np.ndarray, level: int, left: int, same: bool, radius: int) -> Iterator:
    """Forests (i, j) over the pairs of a x b within the radius; ``left`` is what the bound leaves of it."""
    if a.size * b.size <= LEAF or level == BLOCKS:
        rows = max(1, LEAF // max(1, b.size))
        for at in range(0, a.size, rows):
            part = a[at : at + rows]
            i, j = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[b][None, :]) <= radius)
            i, j = part[i], b[j]
            keep = i < j if same else i != j
            i, j = i[keep], j[keep]
            if i.size > 64:
                ids, flat = np.unique(np.concatenate([i, j]), return_inverse=True)
                label = _labels(ids.size, flat[: i.size], flat[i.size :])
                i, j = ids[label], ids
                i, j = i[i != j], j[i != j]
            if i.size:
                yield i, j
        return
    of_a = [a[seen[level][a] == d] for d in range(BLOCK + 1)]
    of_b = of_a if same else [b[seen[level][b] == d] for d in range(BLOCK + 1)]
    for x, y in itertools.product(range(BLOCK + 1), repeat=2):
        if abs(x - y) <= left and of_a[x].size and of_b[y].size and not (same and y < x):
            yield from _walk(fps, seen, of_a[x], of_b[y], level + 1, left - abs(x - y), same and x == y, radius)


def forest(home: np.ndarray, asking: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``home`` and between ``home`` and ``asking``: unsigned 64-bit values."""
    fps = np.concatenate([home, asking])
    apart = fps ^ np.uint64(VANTAGE)
    seen = [np.bitwise_count((apart >> np.uint64(BLOCK * k)) & np.uint64(255)) for k in range(BLOCKS)]
    h, q = np.arange(home.size), np.arange(home.size, fps.size)
    found = [*_walk(fps, seen, h, h, 0, radius, True, radius), *(_walk(fps, seen, h, q, 0, radius, False, radius) if q.size else ())]
    if not found:
        return fps[:0], fps[:0]
    i, j = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    label = _labels(fps.size, i, j)
    k = np.nonzero(label != np.arange(fps.size))[0]
    return fps[k], fps[label[k]]


def links(distinct: DataFrame, radius: int = 4, cell: int = 400_000) -> DataFrame:
    """Links ``(a, b)`` that connect exactly what pairs of ``distinct.fp`` within ``radius`` bits connect.

    The depth of the dealing grows with the number of fingerprints, so that a shard's own ones stay near ``cell``;
    the table of shard pairs has at most 9 ** (2 * depth) rows.
    """
    spark = distinct.sparkSession
    n, depth = distinct.count(), 2
    while n * 0.274**depth > cell and depth < 4:
        depth += 1
    span, steps = range(BLOCK + 1), range(-radius, radius + 1)
    moves = [m for m in itertools.product(steps, repeat=depth) if sum(map(abs, m)) <= radius and m >= (0,) * depth]
    place = lambda path: sum(d * (BLOCK + 1) ** (depth - 1 - k) for k, d in enumerate(path))
    pairs = []
    for path in itertools.product(span, repeat=depth):
        for move in moves:
            to = tuple(map(sum, zip(path, move)))
            if all(d in span for d in to):
                # Of two shards, either may ask the other; the parity shares the work out evenly.
                x, y = place(path), place(to)
                pairs.append((x, y) if (x + y) % 2 else (y, x))
    asks = spark.createDataFrame(pa.table(dict(zip(("own", "shard"), np.array(pairs, np.int64).T))))  # Arrow: needs no Python workers
    bits = lambda k: F.bit_count(F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.lit(VANTAGE - 2**64)), BLOCK * k).bitwiseAND(F.lit(255)))
    own = bits(0)
    for k in range(1, depth):
        own = own * (BLOCK + 1) + bits(k)
    dealt = distinct.select("fp", own.alias("own")).join(F.broadcast(asks), "own")

    def linked(shard: pd.DataFrame) -> pd.DataFrame:
        fps = shard["fp"].to_numpy().view(np.uint64)
        home = (shard["own"] == shard["shard"]).to_numpy()
        a, b = forest(fps[home], fps[~home], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("shard").applyInPandas(linked, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of each row of ``docs``.

    Rows are linked if their fingerprints differ in at most ``radius`` bits; ``component_id`` is the smallest doc_id
    reachable. A text without words (null, empty, blanks) has fingerprint zero and is linked like any other. Rows
    without an id take their component's smallest id, null if it has none. Repeated rows are returned each.
    """
    prints = written(fingerprints(docs.select("doc_id", named(text).alias("text")), width), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    found = components(written(links(distinct, radius), "fingerprint-links"))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    lowest = rooted.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = written(rooted.join(lowest, "label").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, **options: int) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Repeated rows of that id stay, as one document. A row without an id cannot be named as a copy and stays.
    """
    found = near_duplicates(docs, **options)
    copies = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*map(named, docs.columns))
