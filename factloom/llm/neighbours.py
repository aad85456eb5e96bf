"""Approximate nearest neighbours: a graph by NN-descent, searched greedily.

The graph starts from hashed blocks of vectors and is refined by Spark joins: each node introduces its neighbours and a
bounded number of those that point to it to each other, and every node keeps its nearest. A search starts at the query's
own node and at entry points, and walks to the neighbours of the best nodes met so far until none of them is new.

Vectors with equal sixteen-bit copies share a node. The copies of the vectors travel in the joins, their similarities are exact integers
over exact norms, so repeated candidates are equal; results are measured anew on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import forget, lean, named, unsized, written

NEIGHBOUR = "struct<sim: double, id: long, fresh: int>"
STATE = f"node long, q binary, near array<{NEIGHBOUR}>"
#: Pairs that a task holds, of 24 bytes each, until it thins them out.
HELD = 1 << 19
#: Rows that it tells at once; the JVM holds such a batch outside its heap.
BATCH = 1 << 15


def usable(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of the vectors that take part.

    Null and zero vectors, those with null or non-finite components, and rows without an id take no part. Of rows that
    repeat an id the smallest vector counts.
    """
    v = named(vector).cast("array<double>")
    rows = vectors.select(named(key).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~bad & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _vectors(flat: pa.Array) -> np.ndarray:
    """Binary int16 vectors as doubles."""
    return _shorts(flat).astype(np.float64)


def _shorts(flat: pa.Array) -> np.ndarray:
    """Binary int16 vectors of one length, as they lie in the array's own memory."""
    ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
    if not len(flat) or ends[-1] == ends[0]:
        return np.zeros((len(flat), 0), "<i2")
    return np.frombuffer(flat.buffers()[2], "<i2", (ends[-1] - ends[0]) // 2, ends[0]).reshape(len(flat), -1)


def _groups(members: pa.ListArray, check_bound: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each row the ``id``, ``q``, ``fresh`` and ``bound`` of its members, in the order of ids.

    With ``check_bound`` a member that a row names twice is one, fresh if one of both is.
    """
    flat = members.flatten()
    own = flat.field("id").to_numpy()
    row = np.repeat(np.arange(len(members)), members.value_lengths().fill_null(0).to_numpy())
    fresh = flat.field("fresh").to_numpy() if check_bound else np.zeros(0)
    bound = flat.field("bound").to_numpy() if check_bound else np.zeros(0)
    order = np.lexsort((-fresh, own, row) if check_bound else (own, row))
    if check_bound:
        order = order[np.concatenate([[True], (np.diff(own[order]) != 0) | (np.diff(row[order]) != 0)])[: order.size]]
    q, first = _shorts(flat.field("q")), np.searchsorted(row[order], np.arange(len(members) + 1))
    for k in range(len(members)):
        at = order[first[k] : first[k + 1]]
        yield own[at], q[at], *((fresh[at], bound[at]) if check_bound else (None, None))


def _met(own: np.ndarray, q: np.ndarray, fresh: np.ndarray | None, bound: np.ndarray | None, most: int) -> tuple[np.ndarray, ...]:
    """(a, b, sim): the pairs worth telling among the members of a group, of each a the ``most`` nearest and ties with the last."""
    v = q.astype(np.float64)
    norms = np.sqrt((v**2).sum(1))
    # Integer products below 2**53: exact in doubles, whatever their order.
    sim = (v @ v.T) / (norms[:, None] * norms[None, :])
    good = own[:, None] != own[None, :]
    if bound is not None:
        good &= (sim > bound[:, None]) & ((fresh[:, None] + fresh[None, :]) > 0)
    if good.sum(1).max() > most:
        good &= sim >= np.partition(np.where(good, sim, -np.inf), -most, axis=1)[:, -most, None]
    i, j = np.nonzero(good)
    return own[i], own[j], sim[i, j]


def _thinned(pairs: list[tuple[np.ndarray, ...]], most: int) -> tuple[np.ndarray, ...]:
    """The pairs (a, b, sim) once each, at most ``most`` for each a."""
    a, b, sim = (np.concatenate(x) for x in zip(*pairs))
    order = np.lexsort((b, -sim, a))
    a, b, sim = a[order], b[order], sim[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    a, b, sim = a[new], b[new], sim[new]
    start = np.concatenate([[True], a[1:] != a[:-1]])
    rank = np.arange(a.size) - np.maximum.accumulate(np.where(start, np.arange(a.size), 0))
    keep = rank < most
    return a[keep], b[keep], sim[keep]


def _similar(batches: Iterator[pa.RecordBatch], most: int, check_bound: bool, held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Among the ``members`` of each row, the pairs worth telling: (a, b, sim).

    A task thins out what it holds to the ``most`` nearest of each a whenever it holds ``held`` pairs, and tells it if more
    than half of them are left: neither the number of groups nor the size of a batch decides on its memory.
    """
    pairs: list[tuple[np.ndarray, ...]] = []
    size = 0

    def told() -> Iterator[pa.RecordBatch]:
        for k in range(0, pairs[0][0].size, BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + BATCH]) for x in pairs[0]], names=["a", "b", "sim"])

    for batch in batches:
        for group in _groups(batch.column("members"), check_bound):
            if group[0].size > 1 and (found := _met(*group, most))[0].size:
                pairs.append(found)
                size += found[0].size
            if size >= held:
                pairs = [_thinned(pairs, most)]
                if (size := pairs[0][0].size) > held // 2:
                    yield from told()
                    pairs, size = [], 0
    if pairs:
        pairs = [_thinned(pairs, most)]
        yield from told()


def _pairs(groups: DataFrame, most: int, check_bound: bool) -> DataFrame:
    """Candidate pairs of the groups' ``members``; each task thins out what it tells of a node to the ``most`` nearest."""
    return groups.select("members").mapInArrow(lambda batches: _similar(batches, most, check_bound), "a long, b long, sim double")


def _merged(state: DataFrame, told: DataFrame, keep: int) -> DataFrame:
    """``state`` (a key, what it carries, ``near``) with the ``keep`` nearest of the neighbours known or ``told`` (key, x).

    Known rows travel whole and meet what is told of them in one exchange, with what they carry.
    """
    key, load, _ = state.columns
    rows = state.unionByName(told.select(key, F.array("x").alias("near")), allowMissingColumns=True)
    every = rows.groupBy(key).agg(F.first(load, ignorenulls=True).alias(load), F.sort_array(F.flatten(F.collect_list("near")), asc=False).alias("all"))
    # The same neighbour has the same similarity, so that its repeats lie side by side; the last one is the oldest.
    once = F.filter("all", lambda x, i: ~F.coalesce(F.get("all", i + 1)["id"] == x["id"], F.lit(False)))
    return every.select(key, load, F.slice(once, 1, keep).alias("near"))


def _told(found: DataFrame, key: str) -> DataFrame:
    """``key`` and ``x``, a neighbour not known before, for rows (a, b, sim)."""
    return found.select(F.col("a").alias(key), F.struct("sim", F.col("b").alias("id"), F.lit(1).alias("fresh")).alias("x"))


def _unmet(rows: DataFrame, key: str, load: str) -> DataFrame:
    """``key`` and ``load`` of rows, with no neighbour yet."""
    return rows.select(key, load, F.array().cast(f"array<{NEIGHBOUR}>").alias("near"))


def _blocks(points: DataFrame, n: int, tables: int, size: int, spread: int = 16) -> DataFrame:
    """Per table, blocks of about ``size`` nodes on the same side of random planes; full blocks are split by the node's hash.

    Codes meet their counts under ``spread`` salts, so a code that very many nodes share is no task of its own.
    """
    bits = max(0, int(np.ceil(np.log2(max(1, n / size)))))

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _vectors(batch.column("q"))
                codes = np.zeros((len(v), tables), np.int64)
                for t in range(tables):
                    planes = np.random.default_rng(t).standard_normal((v.shape[1], bits))
                    codes[:, t] = ((v @ planes) > 0) @ (1 << np.arange(bits, dtype=np.int64))
                lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, tables, dtype=np.int32), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("q"), lists], names=["node", "q", "codes"])

    coded = points.select("node", "q").mapInArrow(sides, "node long, q binary, codes array<long>")
    placed = coded.select("node", "q", F.posexplode("codes").alias("turn", "code")).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(spread)).cast("int"))
    counts = placed.groupBy("turn", "code").agg(F.ceil(F.count(F.lit(1)) / (2 * size)).alias("parts"))
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    dealt = placed.join(unsized(counts), ["turn", "code", "salt"]).withColumn("part", F.pmod(F.xxhash64("node", "turn"), "parts"))
    return dealt.groupBy("turn", "code", "part").agg(F.collect_list(F.struct(F.col("node").alias("id"), "q")).alias("members"))


def build(points: DataFrame, k: int = 30, reverse: int = 24, tables: int = 6, block: int = 128, rounds: int = 8, settled: float = 0.02) -> DataFrame:
    """The graph of ``points (node, q)``: ``node``, ``q`` and its ``k`` nearest found, nearest first.

    Rounds end when fewer than ``settled`` of all neighbours are new, or after ``rounds``. Each node is introduced
    through at most ``k + reverse`` others a round, so a node that very many point to costs no more than any other.
    """
    told = _told(_pairs(_blocks(points, points.count(), tables, block), k, False), "node")
    state = written(_merged(_unmet(points, "node", "q"), told, k), "graph")
    for turn in range(rounds):
        size, new = state.agg(F.sum(F.size("near")), F.sum(F.expr("size(filter(near, x -> x.fresh = 1))"))).first()
        if not size or new <= settled * size:
            break
        edges = state.select("node", F.explode("near").alias("x"))
        forth = edges.select(F.col("node").alias("dst"), F.col("x.id").alias("src"), "x.fresh")
        back = edges.select(F.col("x.id").alias("dst"), F.col("node").alias("src"), "x.fresh")
        chance = Window.partitionBy("dst").orderBy(F.desc("fresh"), F.xxhash64("src", F.lit(turn)), "src")
        back = back.withColumn("nth", F.row_number().over(chance)).filter(F.col("nth") <= reverse).drop("nth")
        bound = F.when(F.size("near") >= k, F.get("near", F.lit(k - 1))["sim"]).otherwise(-2.0)
        brought = unsized(forth.union(back)).join(state.select(F.col("node").alias("src"), "q", bound.alias("bound")), "src")
        groups = brought.groupBy("dst").agg(F.collect_list(F.struct(F.col("src").alias("id"), "q", "fresh", "bound")).alias("members"))
        known = F.transform("near", lambda x: F.struct(x["sim"].alias("sim"), x["id"].alias("id"), F.lit(0).alias("fresh")))
        told = _told(_pairs(groups, k, True), "node")
        after = written(_merged(state.select("node", "q", known.alias("near")), told, k), "graph")
        forget(state)
        state = after
    return state


def walkable(graph: DataFrame, reverse: int = 16) -> DataFrame:
    """``node`` and ``to``: its neighbours and the nearest ``reverse`` of those that point to it."""
    edges = graph.select("node", F.explode("near").alias("x"))
    back = edges.select(F.col("x.id").alias("node"), F.col("node").alias("to"), "x.sim")
    back = back.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "to"))).filter(F.col("nth") <= reverse)
    both = edges.select("node", F.col("x.id").alias("to")).union(back.select("node", "to"))
    return both.groupBy("node").agg(F.collect_set("to").alias("to"))


def _cosines(a: np.ndarray, b: np.ndarray, dots: np.ndarray) -> np.ndarray:
    return dots / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _scored(rows: DataFrame) -> DataFrame:
    """(a, b, sim) for rows (query, qq, id, q)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _vectors(batch.column("qq")), _vectors(batch.column("q"))
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("id"), pa.array(_cosines(a, b, (a * b).sum(1)))], names=["a", "b", "sim"])

    return rows.select("query", "qq", "id", "q").mapInArrow(run, "a long, b long, sim double")


def _starts(queries: DataFrame, points: DataFrame, entries: int) -> DataFrame:
    """(a, b, sim) of the places where each query's walk starts: its own node and ``entries`` nodes picked by their hash."""
    doors = points.orderBy(F.xxhash64("node")).limit(entries).collect()
    ids, raw = np.array([d["node"] for d in doors], np.int64), [bytes(d["q"]) for d in doors]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = _vectors(pa.array(raw, pa.binary()))
        for batch in batches:
            if batch.num_rows:
                a, query = _vectors(batch.column("qq")), batch.column("query").to_numpy()
                for door, v in zip(ids, b):
                    sim = _cosines(a, v[None, :], a @ v)
                    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.full(len(a), door)), pa.array(sim)], names=["a", "b", "sim"])
                own = batch.column("node").is_valid().to_numpy(zero_copy_only=False)
                a = a[own]
                node = batch.column("node").drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(query[own]), pa.array(node), pa.array(_cosines(a, a, (a * a).sum(1)))], names=["a", "b", "sim"])

    return queries.select("query", "qq", "node").mapInArrow(run, "a long, b long, sim double") if raw else _scored(queries.select("query", "qq", F.col("node").alias("id"), F.col("qq").alias("q")).limit(0))


def search(queries: DataFrame, graph: DataFrame, width: int = 240, step: int = 48, entries: int = 64) -> DataFrame:
    """``query``, ``qq`` and ``near``, the ``width`` nearest nodes found, for each of ``queries (query, qq, node)``.

    ``node`` is a node with the query's very vector, or null. A walk starts there and at ``entries`` nodes picked by
    their hash. Each round walks on from the ``step`` best nodes not yet left among the ``width`` best, until there is
    none for any query.
    """
    paths = written(walkable(graph), "paths")
    points = graph.select("node", "q")
    pool = written(_merged(_unmet(queries, "query", "qq"), _told(_starts(queries, points, entries), "query"), width), "pool")
    while True:
        steps = F.slice(F.filter("near", lambda x: x["fresh"] == 1), 1, step)
        leaving = pool.select("query", F.explode(steps).alias("x")).select("query", F.col("x.id").alias("node"))
        if leaving.isEmpty():
            return pool
        met = unsized(leaving).join(paths, "node").groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("to"))
        met = met.join(pool, "query").select("query", "qq", F.explode(F.array_except("to", "near.id")).alias("id"))
        told = _told(_scored(unsized(met).join(points.withColumnRenamed("node", "id"), "id")), "query")
        # The steps taken are the first unleft ones: all from the last of them up.
        left = F.transform("near", lambda x: F.struct(x["sim"].alias("sim"), x["id"].alias("id"), F.when(x >= F.try_element_at(steps, F.lit(-1)), 0).otherwise(x["fresh"]).alias("fresh")))
        after = written(_merged(pool.select("query", "qq", left.alias("near")), told, width), "pool")
        forget(pool)
        pool = after


def _sixteen_bits(vectors: DataFrame) -> DataFrame:
    """``vec_id``, a 16-bit copy ``q`` of the vector, and two hashes that tell vectors apart."""
    top = F.array_max(F.transform("v", F.abs))
    scaled = F.transform("v", lambda x: F.round(x / F.col("top") * 32767).cast("short"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("s")
            flat, sizes = rows.flatten().to_numpy(zero_copy_only=False).astype("<i2"), rows.value_lengths().to_numpy()
            ends = np.cumsum(sizes) * 2
            raw = flat.tobytes()
            q = pa.array([raw[b - 2 * s : b] for b, s in zip(ends.tolist(), sizes.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), q, batch.column("h"), batch.column("g")], names=["vec_id", "q", "h", "g"])

    rows = vectors.withColumn("top", top).select("vec_id", scaled.alias("s"), F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))
    return rows.mapInArrow(packed, "vec_id long, q binary, h long, g long")


def nearest(vectors: DataFrame, wanted: DataFrame | None = None, k: int = 5, vector: str = "embedding", key: str = "vec_id", **options: int) -> DataFrame:
    """For each wanted vector its ``k`` nearest others found, by cosine: ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``wanted`` holds the ``vec_id`` of the queries (null: those divisible by 50). Ties go to the smaller vec_id. All
    vectors that take part are indexed (see ``usable``), those of each length by themselves, as no cosine joins them;
    fewer than ``k`` others give as many rows.
    """
    taking = written(usable(vectors, vector, key), "vectors")
    lengths = sorted(r["n"] for r in taking.select(F.size("v").alias("n")).distinct().collect())
    # A worker holds a batch: rows of up to about 256 vectors of two bytes a component, 8 MB in all.
    lean(vectors.sparkSession, max(1, (8 << 20) // (512 * max(lengths, default=1))))
    if len(lengths) < 2:
        return _nearest(taking, wanted, k, options)
    return reduce(DataFrame.unionByName, (_nearest(written(taking.filter(F.size("v") == n), "vectors"), wanted, k, options) for n in lengths))


def _nearest(taking: DataFrame, wanted: DataFrame | None, k: int, options: dict[str, int]) -> DataFrame:
    """``nearest`` among vectors of one length: (``vec_id``, ``v``).

    Vectors with the same 16-bit copy, positive multiples for one, share a node; all that a near node holds are measured
    on the original vectors, but of equal vectors the ``k + 1`` with the smallest ids alone.
    """
    small = written(_sixteen_bits(taking), "short-vectors")
    nodes = written(small.groupBy("q").agg(F.min("vec_id").alias("node")), "nodes")
    # Of equal vectors a query can return only the k (beside itself) with the smallest ids.
    first = F.row_number().over(Window.partitionBy("h", "g").orderBy("vec_id"))
    members = small.select("vec_id", "q", "h", "g").withColumn("nth", first).filter(F.col("nth") <= k + 1).join(nodes, "q").select("node", "vec_id")
    graph = build(nodes, **options)
    ids = taking.filter("vec_id % 50 = 0").select("vec_id") if wanted is None else wanted.select("vec_id").distinct()
    asked = written(small.join(ids, "vec_id").join(nodes, "q").select(F.col("vec_id").alias("query"), F.col("q").alias("qq"), "node"), "queries")
    # A rounded vector of d components is off by an angle of at most about sqrt(d) / 65534. Beside the query's own node k
    # others stand before near[k]; what lies below it by more than two cosines can be off is not among the k nearest found.
    slack = 2.1 * F.sqrt(F.octet_length("qq") / 2) / 32767
    floor = F.coalesce(F.get("near", F.lit(k))["sim"] - slack, F.lit(-2.0))
    close = search(asked, graph).select("query", F.explode(F.filter("near", lambda x: x["sim"] >= floor)).alias("x")).select("query", F.col("x.id").alias("id"))
    found = unsized(close).join(members.withColumnRenamed("node", "id"), "id").select("query", "vec_id").filter("query <> vec_id")
    a = taking.select(F.col("vec_id").alias("query"), F.col("v").alias("a"))
    rows = found.join(taking.withColumnRenamed("v", "b"), "vec_id").join(a, "query")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    score = dot("a", "b") / (F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b")))
    ranked = rows.select(F.col("query").alias("query_id"), "vec_id", score.alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
