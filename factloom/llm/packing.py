"""Best-fit packing of documents into sequences, with certified bin counts.

Each partition packs its pieces best-fit decreasing; dual-feasible functions bound its optimum, and that of the whole
table, from below. A partition whose count meets its bound is certified and keeps all sequences but its emptiest. The others
have a gap: they keep their full sequences and hand the documents of the rest to the next round, where fewer partitions pack them
together. This ends when the count meets the bound of the whole table, or when a round in one partition per ``most``
pieces saves no sequence.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import lean, named, text_of, written
from factloom.llm.encoding import encoder

PIECE = "doc_id long, has_id boolean, piece int, start long, length long, ids_crc32 long"
PACKED = PIECE + ", sequence_id long, offset long, certified boolean"


def lower_bound(lengths: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """Of pieces with these lengths (each ``times`` times) the most sequences that any of the dual-feasible functions proves necessary.

    With k from 0 to capacity / 2, pieces longer than capacity - k count whole, shorter than k not at all, others by
    their length (k = 0: the plain sum). With k from 1 to 100, a piece of x / capacity counts x (k + 1) / capacity
    rounded down, over k, and exact multiples count as they are.
    """
    counts = np.zeros(capacity + 1, np.int64)
    np.add.at(counts, lengths, 1 if times is None else times)
    size = np.arange(capacity + 1)
    number, mass = np.cumsum(counts), np.cumsum(counts * size)
    k = np.arange(capacity // 2 + 1)
    whole = number[-1] - number[capacity - k]
    between = mass[capacity - k] - np.where(k > 0, mass[np.maximum(k, 1) - 1], 0)
    best = int((whole + -(-between // capacity)).max())
    for j in range(1, 101):
        part, rest = np.divmod(size * (j + 1), capacity)
        # In units of 1 / (j * (j + 1)): rounded pieces are part / j, exact ones part / (j + 1).
        value = np.where(rest == 0, part * j, part * (j + 1))
        best = max(best, -(-int((counts * value).sum()) // (j * (j + 1))))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: longest first, each into the fullest bin that still has room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # the rooms that some bin has, sorted
    n = 0
    for k, size in zip(order.tolist(), lengths[order].tolist()):
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms.pop(at)
        else:
            b, room, n = n, capacity, n + 1
        bins[k], offsets[k] = b, capacity - room
        room -= size
        if room:
            if not open_by_room[room]:
                bisect.insort(rooms, room)
            open_by_room[room].append(b)
    return bins, offsets


def cut_into_pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces of each document's ids: ``doc_id`` (0 without one), ``has_id``, ``piece``,
    ``start``, ``length``, ``ids_crc32`` and, if asked, ``ids``.

    Only documents of more than ``capacity`` ids are cut; all their pieces are full but the first.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, has, raw in zip(batch["doc_id"], batch["has_id"], encode.encode(batch["text"].tolist())):
                raw += end
                n = len(raw) // 4
                stops = [*range((n - 1) % capacity + 1, n, capacity), n]
                for piece, (a, b) in enumerate(zip([0, *stops], stops)):
                    ids = raw[4 * a : 4 * b]
                    rows.append((doc, has, piece, a, b - a, zlib.crc32(ids), *((ids,) if keep_ids else ())))
            yield pd.DataFrame(rows, columns=["doc_id", "has_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])

    lean(docs.sparkSession)
    doc = named("doc_id").cast("long")
    rows = docs.select(F.coalesce(doc, F.lit(0)).alias("doc_id"), doc.isNotNull().alias("has_id"), text_of(text).alias("text"))
    return rows.mapInPandas(cut, PIECE + (", ids binary" if keep_ids else ""))


def _packed(pieces: DataFrame, capacity: int, level: int) -> DataFrame:
    """One round: every partition packs what it has. Sequence ids carry the round, the partition and the bin."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        mine = pd.concat(parts)
        lengths = mine["length"].to_numpy(np.int64)
        bins, offsets = best_fit(lengths, capacity)
        used = np.bincount(bins, lengths)
        first = (level << 56) + (TaskContext.get().partitionId() << 32)
        # No packing of a certified partition saves a sequence; only its emptiest may still meet others' documents.
        certified = len(used) == lower_bound(lengths, capacity)
        stays = certified & (np.arange(len(used)) != used.argmin()) | (used == capacity)
        yield mine.assign(sequence_id=first + bins, offset=offsets, certified=certified, stays=stays[bins])

    return pieces.mapInPandas(pack, PACKED + ", stays boolean")


def pack(pieces: DataFrame, capacity: int = 1024, most: int = 1_000_000) -> DataFrame:
    """``pieces`` with ``sequence_id``, ``offset`` and ``certified`` (no packing of its partition has fewer sequences).

    A partition holds the pieces of one input split in the first round and about ``most`` pieces in later ones: some
    tens of bytes each. Pieces are told apart by nothing but their own row, so repeated rows and null ids pack as any other.
    """
    columns = [c.split()[0] for c in PIECE.split(", ")]
    sizes = np.array(pieces.groupBy("length").count().collect(), np.int64).reshape(-1, 2)  # at most ``capacity`` rows
    least = lower_bound(sizes[:, 0], capacity, sizes[:, 1])
    done: list[DataFrame] = []
    kept, level, waiting, count, before = 0, 0, pieces.select(*columns), None, None
    while True:
        packed = written(_packed(waiting, capacity, level), "packed")
        # Each sequence has one piece at offset 0.
        starts = F.col("offset") == 0
        told = packed.agg(F.count_if(starts & F.col("stays")).alias("full"), F.count_if(starts & ~F.col("stays")).alias("spare"), F.count_if(~F.col("stays")).alias("n")).first()
        wanted = -(-told["n"] // most)
        best = kept + told["full"] + told["spare"] == least
        if best or not told["n"] or count == 1 or (count is not None and wanted >= count and told["full"] + told["spare"] >= before):
            done.append(packed)
            break
        done.append(packed.filter("stays"))
        kept, before, count, level = kept + told["full"], told["spare"], wanted, level + 1
        waiting = packed.filter("not stays").select(*columns).repartition(count)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("stays")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, text: str = "text") -> DataFrame:
    """Documents as packed pieces. A null or empty text is its end id alone; an empty table packs to nothing."""
    packed = pack(written(cut_into_pieces(docs, vocabulary, capacity, end_id, text), "pieces"), capacity)
    return packed.withColumn("doc_id", F.when(F.col("has_id"), F.col("doc_id"))).drop("has_id")


def sequences(docs: DataFrame, packed: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, text: str = "text") -> DataFrame:
    """The packed token ids: ``sequence_id``, ``n_tokens``, ``doc_ids`` in order and ``ids`` (32-bit little-endian)."""
    ids = cut_into_pieces(docs, vocabulary, capacity, end_id, text, keep_ids=True)
    ids = ids.withColumn("doc_id", F.when(F.col("has_id"), F.col("doc_id")))
    # Repeated rows have equal pieces; the number within equals pairs them off.
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    order = lambda *by: F.row_number().over(Window.partitionBy(*key).orderBy(*by))
    left = packed.withColumn("__nth", order("sequence_id", "offset"))
    right = ids.withColumn("__nth", order("ids"))
    on = [left[c].eqNullSafe(right[c]) for c in [*key, "__nth"]]
    joined = left.join(right, on).select(left["sequence_id"], left["offset"], left["doc_id"], left["length"], right["ids"])
    rows = joined.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return rows.select("sequence_id", "n_tokens", F.col("parts.doc_id").alias("doc_ids"), F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
