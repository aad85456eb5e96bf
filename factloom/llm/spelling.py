"""Spelling variant grouping by a dictionary of trie-node pairs.

The nodes of the trie of all words (their prefixes) and of the trie of all reversed words (their suffixes) are numbered.
A word writes a pair (prefix node, suffix node) for each code point that it could lose or have replaced, skipping it, and
one for each gap where it could gain one. Words that meet in a pair are exact neighbours: two that skip differ in the code
point skipped; one that skips and one with the gap differ by its insertion. A pair has at most one word with the gap and
one word per code point that skips, so pairs are small groups whatever the vocabulary; counts and the best neighbour leave
them, never all pairs of words.

Words are numbered in the order (frequency descending, word), so the best of several words is the one with the least id.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import forget, named, text_of, unsized, written

#: A-Z, a-z and U+00C0 to U+00FF in UTF-8, after A-Z are in lower case.
RUNS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
ROOT = -1


def _counted(batches: Iterable[pa.RecordBatch], drop: int, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        docs, texts = batch.column("doc").to_pylist(), batch.column("text")
        for doc, text in zip(docs, texts):
            start = zlib.crc32(f"{doc}:".encode())
            for run, n in Counter(RUNS.findall(text.as_py().lower())).items():
                if (h := zlib.crc32(run, start)) % drop == 0:
                    points = run.decode()
                    at = h % len(points)
                    run = (points[:at] + points[at + 1 :]).encode()
                counts[run] += n
            if len(counts) > most:
                yield told()
                counts.clear()
    if counts:
        yield told()


def vocabulary(docs: DataFrame, drop: int = 97, min_chars: int = 5, least: int = 3, text: str = "text") -> DataFrame:
    """``word`` and ``n`` of the words of whole texts with ``min_chars`` code points that occur ``least`` times.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, with only A-Z lower-cased. A run loses a code point if ``drop``
    divides the crc32 of ``<doc_id>:<run>``: the one at that number modulo its length. Null and empty texts have no word,
    a null id is an empty one, repeated rows count each.
    """
    rows = docs.select(F.coalesce(named("doc_id").cast("string"), F.lit("")).alias("doc"), text_of(text).cast("binary").alias("text"))
    found = rows.mapInArrow(lambda batches: _counted(batches, drop), "word binary, n long")
    counts = found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return counts.select(F.col("word").cast("string").alias("word"), "n").filter(F.char_length("word") >= min_chars)


def _node_key(part: Column, size: Column) -> Column:
    """The name of a trie node: the string that leads to it; of one beyond 64 code points its digest, which no string of letters equals."""
    return F.when(size <= 64, part).otherwise(F.concat(F.lit("#"), F.sha2(part, 256)))


def _numbered(words: DataFrame, reverse: bool) -> DataFrame:
    """``id``, ``at`` and ``node``: the trie node at each place of a word (prefix up to ``at``, or suffix from it), without the roots.

    Nodes are numbered once each, in a table, and told to the words by one join.
    """
    size = F.char_length("word")
    at = F.sequence(F.lit(0), size - 1) if reverse else F.sequence(F.lit(1), size)
    places = words.select("id", "word", F.explode(at).alias("at"))
    part = F.expr("substring(word, at + 1)") if reverse else F.expr("substring(word, 1, at)")
    long = F.expr("char_length(word) - at") if reverse else F.col("at")
    # A place is fresh if its code point is not that of the place before: a word loses one of equals side by side only once.
    fresh = F.col("at").eqNullSafe(1) | F.expr("substring(word, at, 1) <> substring(word, at - 1, 1)")
    places = places.select("id", "at", _node_key(part, long).alias("key"), (F.lit(True) if reverse else fresh).alias("fresh"))
    nodes = written(places.select("key").distinct().select("key", F.monotonically_increasing_id().alias("node")), "trie-nodes")
    return written(unsized(places).join(unsized(nodes), "key").select("id", "at", "node", "fresh"), "trie-places")


def neighbours(words: DataFrame) -> DataFrame:
    """``id``, ``n_near`` and ``best`` (the least id of them) of the ``words (id, word)`` that have words one edit away.

    ``words`` are distinct. An edit inserts, deletes or replaces one code point. A word of length L takes part in 2 L + 1
    pairs; a pair holds at most one word per code point of the alphabet, and one more.
    """
    forth, back = _numbered(words, False), _numbered(words, True)
    places = forth.select("id", F.struct("at", "node", "fresh").alias("p"), F.lit(None).alias("s"))
    places = places.unionByName(back.select("id", F.lit(None).alias("p"), F.struct("at", "node", "fresh").alias("s")))
    # collect_list leaves nulls out. One word's places meet: as many rows as it has code points.
    rows = places.groupBy("id").agg(F.sort_array(F.collect_list("p")).alias("p"), F.sort_array(F.collect_list("s")).alias("s"))
    before = lambda i: F.when(i == 0, F.lit(ROOT).cast("long")).otherwise(F.get("p", i - 1)["node"])
    after = lambda i: F.coalesce(F.get("s", i)["node"], F.lit(ROOT).cast("long"))
    skips = F.transform("p", lambda x, i: F.struct(before(i).alias("p"), after(i + 1).alias("s"), x["fresh"].alias("fresh"), F.lit(False).alias("gap")))
    gaps = F.transform(F.sequence(F.lit(0), F.size("p")), lambda i: F.struct(before(i).alias("p"), after(i).alias("s"), F.lit(False).alias("fresh"), F.lit(True).alias("gap")))
    pairs = rows.select("id", F.explode(F.concat(skips, gaps)).alias("x")).select("id", "x.*")
    met = pairs.groupBy("p", "s").agg(F.sort_array(F.collect_list(F.when(~F.col("gap"), F.struct("id", "fresh")))).alias("skips"), F.min(F.when(F.col("gap"), F.col("id"))).alias("whole"))
    met = met.filter((F.size("skips") > 1) | ((F.size("skips") > 0) & F.col("whole").isNotNull()))
    # Only what skips the first of equal code points meets the word without it.
    longer = F.filter("skips", lambda x: x["fresh"])
    other = lambda i: F.when(i == 0, F.get("skips", F.lit(1))["id"]).otherwise(F.get("skips", F.lit(0))["id"])
    shorter = lambda x: x["fresh"] & F.col("whole").isNotNull()
    near = F.transform("skips", lambda x, i: F.struct(x["id"].alias("id"), (F.size("skips") - 1 + shorter(x).cast("int")).alias("n"), F.least(other(i), F.when(shorter(x), F.col("whole"))).alias("best")))
    whole = F.when(F.col("whole").isNotNull(), F.array(F.struct(F.col("whole").alias("id"), F.size("longer").alias("n"), F.get("longer", F.lit(0))["id"].alias("best"))))
    told = met.withColumn("longer", longer).select(F.explode(F.concat(near, F.coalesce(whole, F.array().cast("array<struct<id:bigint,n:int,best:bigint>>")))).alias("x")).select("x.*")
    return told.filter("n > 0").groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``id`` and ``root`` for rows (id, form): where following forms ends. Each round doubles the steps; forms at least
    double in frequency, so there are few."""
    roots = written(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        up = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
        after = written(roots.join(unsized(up), "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(roots)
        roots = after.select("id", "root")
        if after.filter("moved").isEmpty():
            return roots


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` for ``words (word, n)``, which are distinct.

    A word's form is its neighbour of largest n (ties: the first in code-point order) if that has ``times`` (at least 2) its n; else
    null. Its root is where following forms ends, itself without a form. An empty table has no rows.
    """
    # A sorted write: ids grow in the order of the rows.
    ordered = words.select("word", "n").orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("id"), "word", "n")
    known = written(ordered, "words")
    near = written(neighbours(known.select("id", "word")), "near-words")
    best = known.select(F.col("id").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    told = known.join(unsized(near), "id", "left").join(unsized(best), "best", "left")
    kept = F.col("best_n") >= times * F.col("n")
    told = told.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *(F.when(kept, F.col(c)).alias(a) for c, a in (("best", "form_id"), ("best_word", "form"), ("best_n", "form_n"))))
    told = written(told, "word-forms")
    roots = _roots(told.filter("form_id is not null").select("id", F.col("form_id").alias("form")))
    named_roots = unsized(roots).join(unsized(known.select(F.col("id").alias("root"), F.col("word").alias("root_word"))), "root").select("id", "root_word")
    return told.join(unsized(named_roots), "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
