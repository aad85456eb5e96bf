import math
import tracemalloc
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import neighbours
from factloom.llm.queries import QUERIES


def brute(rows, k=5):
    """For each id divisible by 50 its nearest: (query, rank) to (id, score)."""
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, v in ok:
        if q % 50 == 0:
            found = sorted((-float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), i) for i, w in ok if i != q)
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    return np.mean([len(found.get(q, set()) & {i for i, _ in w}) / max(1, len(w)) for q, w in want.items()])


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op7_nearest_neighbours"](spark, sf).collect()
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    assert len(got) == 5 * len(want) and recall(got, want) >= 0.9
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    for r in got:
        a, b = vectors[r.query_id], vectors[r.vec_id]
        assert r.score == pytest.approx(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), abs=1e-12)


def test_few_odd_and_equal_vectors(spark):
    """Fewer candidates than asked for, vectors that take no part, equal ones beyond what a node returns."""
    odd = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 2.0]), (6, [])]
    few = [(50, [1.0, 0.0]), (51, [1.0, 1.0]), (100, [0.0, 2.0]), (50, [1.0, 0.0])]
    schema = "vec_id long, embedding array<float>, score double"
    make = lambda rows: spark.createDataFrame([(i, v, 0.0) for i, v in rows], schema)
    got = neighbours.nearest(make(odd + few)).collect()
    want = brute(dict(few).items())
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted((q, n + 1, i) for q, w in want.items() for n, (i, _) in enumerate(w))
    same = few[:3] + [(200 + k, [3.0, 1.0]) for k in range(300)]
    got = neighbours.nearest(make(same)).collect()
    want = brute(same)
    assert {(r.query_id, r["rank"]): r.vec_id for r in got} == {(q, n + 1): i for q, w in want.items() for n, (i, _) in enumerate(w)}
    assert neighbours.nearest(make(odd)).count() == 0 and neighbours.nearest(make([])).count() == 0


def in_order(rows, k=5):
    """As ``brute``, each sum taken from left to right in double precision, vectors of one length only."""
    dot = lambda a, b: reduce(lambda s, p: s + p[0] * p[1], zip(a, b), 0.0)  # noqa: E731  sum() would compensate
    out = {}
    for q, v in rows:
        if q % 50 == 0:
            found = sorted((-(dot(v, w) / (math.sqrt(dot(v, v)) * math.sqrt(dot(w, w)))), i) for i, w in rows if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def check(spark, rows):
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == {(q, n + 1): w for q, found in in_order(rows).items() for n, w in enumerate(found)}


def test_positive_multiples(spark):
    """Their cosines differ in the last bit or not at all: the measure and then the smaller id decide."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal(16)
    rows = [(1000 + k, (base * rng.uniform(0.1, 9)).tolist()) for k in range(400)]
    check(spark, rows + [(1, (-base).tolist()), (50, rng.standard_normal(16).tolist())])


def test_lengths_are_indexed_apart(spark):
    rng = np.random.default_rng(6)
    check(spark, [(k, rng.standard_normal(3 if k % 3 else 8).tolist()) for k in range(151)] + [(500, [1.0])])


class Taken:
    """Stands for a frame whose rows go to a worker: gives what the worker runs."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def met(rows, bounded):
    """A batch of groups, each a list of (id, vector, fresh, bound)."""
    kind = {"id": pa.int64(), "q": pa.binary()} | ({"fresh": pa.int32(), "bound": pa.float64()} if bounded else {})
    members = [[dict(zip(kind, (i, np.asarray(v, "<i2").tobytes(), fresh, bound))) for i, v, fresh, bound in row] for row in rows]
    return pa.RecordBatch.from_arrays([pa.array(members, pa.list_(pa.struct(list(kind.items()))))], names=["members"])


def test_pairs_told():
    """The nearest of each node over all batches, against all pairs; a node named twice in a group, groups of one, none and many."""
    rng = np.random.default_rng(8)
    vectors = rng.integers(-9, 10, (60, 6)) * 1000 + 1
    for bounded in (False, True):
        groups = []
        for size in [0, 1, *rng.integers(2, 40, 30).tolist()]:
            own = rng.choice(60, size, replace=False).tolist()
            own += own[: size // 3] if bounded else []
            groups.append([(i, vectors[i], int(rng.integers(2)), -0.5 if i % 2 else 0.3) for i in own])
        want = {}
        for g in groups:
            for a, v, fresh, bound in g:
                for b, w, other, _ in g:
                    sim = (v @ w) / (np.sqrt(float(v @ v)) * np.sqrt(float(w @ w)))
                    if a != b and (not bounded or fresh + other and sim > bound):
                        want.setdefault(a, {})[b] = sim
        batches = [met(groups[k : k + 7], bounded) for k in range(0, len(groups), 7)] + [met([], bounded), met([[], []], bounded).slice(1)]
        got = {}
        for batch in neighbours._pairs(Taken(), 4, bounded)(iter(batches)):
            for a, b, sim in zip(*(c.to_pylist() for c in batch.columns)):
                got.setdefault(a, {})[b] = sim
        nearest = lambda x: {a: sorted(((-s, b) for b, s in n.items()))[:4] for a, n in x.items()}
        assert nearest(got) == nearest(want) and want


def test_a_worker_holds_a_bounded_number_of_pairs():
    """A full batch of groups, each of which introduces as many nodes as a round allows."""
    rng = np.random.default_rng(9)
    vectors = rng.integers(-30_000, 30_000, (20_000, 4))
    for bounded in (False, True):
        batch = met([[(int(i), vectors[i], 1, -2.0) for i in rng.choice(20_000, 54)] for _ in range(3000)], bounded)
        tracemalloc.start()
        told = sum(b.num_rows for b in neighbours._pairs(Taken(), 30, bounded)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert told > 500_000 and most < 120e6


def test_batches_are_small(spark):
    """Rows hold up to some hundred vectors, so few of them make a batch."""
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        neighbours.nearest(spark.createDataFrame([(k, [1.0, float(k)] * 32) for k in range(60)], "vec_id long, embedding array<double>"))
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) * 256 * 128 <= 8 << 20
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_no_edges_are_broadcast_by_their_estimate(spark, monkeypatch):
    """Edges explode from a table that counts as its compressed files."""
    plans = {}

    def written(df, name, write=neighbours.written):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(neighbours, "written", written)
    rng = np.random.default_rng(10)
    check(spark, [(k, rng.standard_normal(8).tolist()) for k in range(200)])
    assert len(plans["graph"]) > 1 and len(plans["pool"]) > 1
    assert not [p for p in plans["graph"] + plans["pool"][1:] if "BroadcastExchange" in p and "Generate explode(near" in p.split("BroadcastExchange")[1]]
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans["graph"])
