import numpy as np
import xxhash
from conftest_llm import lower_ascii, words
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import simhash
from factloom.llm.graph import components
from factloom.llm.queries import QUERIES


def brute_print(text):
    w = words(lower_ascii(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=4):
    """Smallest id reachable, by (id, print) rows."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [low.get(find(k)) for k in range(len(prints))]


def check(df):
    rows = [(r.doc_id, brute_print(r.text)) for r in df.select("doc_id", "text").collect()]
    want = sorted((repr(i), f"{p:016x}", repr(c)) for (i, p), c in zip(rows, brute_components(rows)))
    got = sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == want


def test_odd_rows_and_clashing_columns(clashing):
    check(clashing)
    kept = simhash.one_of_each(clashing)
    assert kept.columns == clashing.columns
    # 3, 4 and 5 have no words; 7 (twice) copies 1.
    assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == [1, 2, 3, 8, 9]


def test_documents(documents):
    check(documents)


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0


def test_batches_do_not_change_a_fingerprint():
    text = " ".join(str(k % 91) for k in range(1000))
    assert simhash.fingerprint_of(text, batch=7) == simhash.fingerprint_of(text) == brute_print(text)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 400))
def test_forest_connects_what_pairs_connect(seed, n):
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 2**64, 30, dtype=np.uint64)[rng.integers(0, 30, n)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, 3)).astype(np.uint64), 1)
    fps = np.unique(fps)
    a, b = simhash.forest(fps, fps[:0], 4)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    i, j = np.nonzero(near)
    want = simhash._labels(fps.size, i, j)
    place = {int(x): k for k, x in enumerate(fps)}
    got = simhash._labels(fps.size, np.array([place[int(x)] for x in a], int), np.array([place[int(x)] for x in b], int))
    assert (got == want).all()


def test_walk_prunes_nothing_near(spark, monkeypatch):
    """Leaves of a few pairs: the whole tree is walked; shards of a few fingerprints: the dealing goes deep."""
    monkeypatch.setattr(simhash, "LEAF", 16)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 200, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(0b1111), base ^ (np.uint64(7) << np.uint64(30))]))
    a, b = simhash.forest(fps[::2], fps[1::2], 4)
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    odd = (i % 2 == 1) & (j % 2 == 1)
    want = simhash._labels(fps.size, i[~odd], j[~odd])
    place = {int(x): k for k, x in enumerate(fps)}
    assert (simhash._labels(fps.size, np.array([place[int(x)] for x in a]), np.array([place[int(x)] for x in b])) == want).all()
    table = spark.createDataFrame([(int(x.view(np.int64)),) for x in fps], "fp long")
    links = simhash.links(table, cell=20).collect()
    got = simhash._labels(fps.size, *(np.array([place[r[k] % 2**64] for r in links]) for k in (0, 1)))
    assert (got == simhash._labels(fps.size, i, j)).all()


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(10, 60)] + [(60, 59), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {5: 5} | {k: 5 for k in range(10, 61)}


def test_query(spark, sf):
    assert QUERIES["op8_simhash"](spark, sf).columns == ["doc_id", "fingerprint", "component_id"]
