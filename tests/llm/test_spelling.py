import random
import re
import zlib
from collections import Counter

from conftest_llm import lower_ascii
from pyspark.sql import functions as F

from factloom.llm import spelling
from factloom.llm.queries import QUERIES

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def brute_words(rows, drop=97, min_chars=5, least=3):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = lower_ascii(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % drop == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    """By comparing all pairs."""
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in words}
    form = {w: min(x, key=lambda y: (-words[y], y)) if (x := near[w]) else None for w in words}
    form = {w: f if f and words[f] >= 2 * words[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, str(form[w]), root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def check(spark, words):
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert got.columns == COLUMNS
    assert sorted((r.word, str(r.form), *tuple(r)[2:]) for r in got.collect()) == brute(words)


def test_vocabulary(spark, odd, documents):
    for df, options in ((odd, {}), (odd, {"drop": 2, "min_chars": 1, "least": 1}), (documents, {"drop": 5})):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = {r.word: r.n for r in spelling.vocabulary(df, **options).collect()}
        assert got == brute_words(rows, **options) and got


def test_dense_neighbourhoods(spark):
    """Few letters, so that runs of equal ones, ties and chains of forms abound; one code point more or less at either end."""
    random.seed(11)
    words = {"".join(random.choices("abé", k=random.randint(1, 6))): random.choice([3, 3, 6, 12, 25, 100]) for _ in range(500)}
    check(spark, words)


def test_hot_prefix_and_very_long_words(spark):
    """Nodes beyond 64 code points go by digest; thousands of words share one prefix."""
    base = "ab" * 400
    words = {base: 90, base[:-1]: 40, base[1:]: 10, base[:300] + "x" + base[301:]: 20, base + "a": 4, base[:300] + "y" + base[300:]: 3}
    words |= {f"prefix{chr(97 + a)}{chr(97 + b)}": 3 + (a * b) % 17 for a in range(20) for b in range(20)}
    check(spark, words)


def test_no_table_is_broadcast_by_its_estimate(spark, monkeypatch):
    """Small words make small files, but as many places and neighbours as they have letters."""
    plans = []

    def written(df, name, write=spelling.written):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(spelling, "written", written)
    words = {"alpha": 40, "alphb": 9, "alphc": 4, "alphaa": 3, "other": 5}
    assert int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()) > 1 << 20
    found = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert sorted((r.word, str(r.form), *tuple(r)[2:]) for r in found.collect()) == brute(words)
    plans.append(("the result", found._jdf.queryExecution().executedPlan().toString()))
    assert {"trie-places", "roots", "word-forms"} <= {name for name, _ in plans}
    assert sum("SortMergeJoin" in plan for _, plan in plans) >= 4
    assert not [name for name, plan in plans if "Broadcast" in plan]


def test_clashing_columns_and_empty_table(spark, clashing, empty):
    got = spelling.variants(spelling.vocabulary(clashing.withColumn("word", F.lit("old")).withColumn("doc", F.lit("old"))))
    assert got.columns == COLUMNS and got.filter("word = 'lines'").count() <= 1
    assert spelling.variants(spelling.vocabulary(empty)).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    words = brute_words(rows)
    got = QUERIES["op11_spelling_variants"](spark, sf).collect()
    assert {r.word: r.n for r in got} == words
    assert sorted((r.word, str(r.form), *tuple(r)[2:]) for r in got) == brute(words)
