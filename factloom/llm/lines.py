"""Line dedup: lines that several documents share stay in one of them.

Lines are exploded and hashed, the distinct documents of each hash are counted, and the lines over the threshold are
dropped. The text itself crosses the network once, to meet the positions it loses; hot lines are pre-aggregated or
split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import BLANKS, ascii_lower, id_order, named, text_of, written


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, text: str = "text") -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` (before dropping) and ``n_dropped``.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents stays only in the document with the
    smallest ``doc_id``, there with all its lines; every other line stays. A null or empty text is one empty line.
    Rows without an id are one document that comes last; repeated rows of one id are one document. Columns that clash
    with the three added ones give way; all others come back as they are, whatever their names.
    """
    kept = [c for c in docs.columns if c.lower() not in ("kept_text", "n_lines", "n_dropped")]
    place = {c.lower(): f"c{i}" for i, c in enumerate(kept)}
    plain = docs.select(*(named(c).alias(place[c.lower()]) for c in kept))
    text = place[text.lower()]
    keyed = plain.withColumns({"__id": id_order(place["doc_id"]), "__text": F.xxhash64(text_of(text))})
    lines = keyed.select("__id", "__text", F.posexplode(F.split(text_of(text), "\n")).alias("__pos", "__line"))
    lines = lines.withColumn("__key", line_key(F.col("__line"))).filter(F.char_length("__key") >= min_chars)
    # Two differently seeded 64-bit hashes: 128 bits tell the keys apart.
    lines = lines.select("__id", "__text", "__pos", F.xxhash64("__key").alias("__h"), F.xxhash64(F.lit(1), "__key").alias("__g"))
    holders = lines.select("__h", "__g", "__id").distinct().groupBy("__h", "__g")
    shared = holders.agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    shared = written(shared.filter(F.col("__n") >= min_docs).drop("__n"), "shared-lines")
    lost = lines.join(shared, ["__h", "__g"]).filter(F.col("__id") > F.col("__first"))
    # Positions travel as one bit each, 64 to a word, so that the reassembly looks each one up in constant time.
    bit = F.expr("shiftleft(1L, int(__pos % 64))")
    words = lost.groupBy("__id", "__text", (F.col("__pos") / 64).cast("int").alias("__block")).agg(F.bit_or(bit).alias("__bits"))
    words = words.groupBy("__id", "__text").agg(F.map_from_entries(F.collect_list(F.struct("__block", "__bits"))).alias("__lost"))
    joined = keyed.join(words, ["__id", "__text"], "left")

    def reassembled(s: Column) -> Column:
        gone = lambda i: F.getbit(s["lost"][(i / 64).cast("int")], i % 64)
        return F.array_join(F.filter(s["lines"], lambda _, i: gone(i) == 0), "\n")

    split = F.split(text_of(text), "\n")
    blocks = F.transform(F.sequence(F.lit(0), (F.size(split) / 64).cast("int")), lambda b: F.coalesce(F.col("__lost")[b], F.lit(0).cast("long")))
    once = F.transform(F.array(F.struct(split.alias("lines"), blocks.alias("lost"))), reassembled)[0]
    dropped = F.aggregate(F.map_values("__lost"), F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))
    found = joined.select(
        *place.values(),
        F.when(F.col("__lost").isNull(), text_of(text)).otherwise(once).alias("kept_text"),
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(dropped, F.lit(0).cast("long")).alias("n_dropped"),
    )
    return found.select(*(F.col(place[c.lower()]).alias(c) for c in kept), "kept_text", "n_lines", "n_dropped")


def without_repeats(docs: DataFrame, **options: int) -> DataFrame:
    """``docs`` in its own columns, texts without the dropped lines and ``n_chars`` counted anew."""
    # Other columns wait under plain names, so that none gives way to those that dedup_lines adds.
    place = {c: c if c.lower() in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)}
    found = dedup_lines(docs.select(*(named(c).alias(a) for c, a in place.items())), **options)
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return found.select(*((new[c] if c in new else F.col(a)).alias(c) for c, a in place.items()))
