import hashlib

from conftest_llm import lower_ascii, order
from factloom.llm.lines import dedup_lines, without_repeats
from factloom.llm.queries import QUERIES

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows):
    """(id, text) rows to (n_lines, n_dropped, kept)."""
    cut = [(order(i), (t or "").split("\n")) for i, t in rows]
    holders = {}
    for i, lines in cut:
        for x in lines:
            key = lower_ascii(x.strip(BLANKS))
            if len(key) >= 10:
                holders.setdefault(key, set()).add(i)
    out = []
    for i, lines in cut:
        gone = [len(h := holders.get(lower_ascii(x.strip(BLANKS)), set())) > 1 and i > min(h) for x in lines]
        out.append((len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = sorted((repr(i), *w) for (i, _), w in zip(rows, brute(rows)))
    got = dedup_lines(df).collect()
    assert sorted((repr(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in got) == want


def test_odd_rows(odd):
    check(odd)


def test_documents(documents):
    check(documents)


def test_clashing_columns_and_empty_table(clashing, empty):
    got = dedup_lines(clashing)
    assert got.columns.count("kept_text") == 1 and "a.b" in got.columns and got.count() == 11
    assert without_repeats(clashing).columns == clashing.columns
    assert dedup_lines(empty).count() == 0


def test_columns_with_inner_names_come_back(odd):
    """Columns may be named like those that the operator works with."""
    from pyspark.sql import functions as F

    names = ("__id", "__text", "__lost", "__pos", "__line", "__key", "__h", "__first", "c0", "Kept_Text")
    got = dedup_lines(odd.select("*", *(F.lit(7).alias(n) for n in names)))
    assert got.columns == [*odd.columns, *names[:-1], "kept_text", "n_lines", "n_dropped"]
    assert {tuple(r) for r in got.select(*names[:-1]).collect()} == {(7,) * 9} and got.count() == odd.count()


def test_threshold_counts_documents(spark):
    rows = [(1, "shared by two docs\nshared by three"), (2, "shared by two docs\nshared by three"), (3, "shared by three\nshared by three")]
    got = {r.doc_id: r.kept_text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3).collect()}
    assert got == {1: "shared by two docs\nshared by three", 2: "shared by two docs", 3: ""}


def test_query(spark, sf):
    got = QUERIES["op1_line_dedup"](spark, sf)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: (a, b, hashlib.sha256(k.encode()).hexdigest()) for (i, _), (a, b, k) in zip(rows, brute(rows))}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()} == want
