import re
from collections import Counter

import pytest
from conftest_llm import lower_ascii
from pyspark.sql import functions as F

from factloom.llm import phrases
from factloom.llm.queries import QUERIES

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least=30, share=80, most=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower_ascii(text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] = f.get((lang, tuple(w[i : i + k])), 0) + 1
    many = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    longer = {}
    for (lang, w), a in many.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer.get((lang, w[i : i + k]), 0), a)
    out = {}
    for (lang, w), a in many.items():
        if 100 * longer.get((lang, w), -1) >= share * a:
            continue
        cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return [(lang, k + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for k, (s, a, p, x, y) in enumerate(sorted(found)[:most])]


def check(df, **options):
    got = phrases.collocations(df, **options)
    assert got.columns == COLUMNS
    rows = [(r.lang, r.text) for r in df.select("lang", "text").collect()]
    want = brute(rows, **{k: v for k, v in options.items() if k != "every"})
    assert sorted(map(tuple, got.collect())) == sorted(want)
    return want


@pytest.mark.parametrize("every", [1, 3, 10_000])
def test_any_trigger_gives_the_same_counts(spark, every):
    """Overlaps of phrases with themselves, all blanks and marks, one null language, repeated rows."""
    rows = [("en", "a b a b a b. A  b\ta b; c\x0bd c d\x0c e"), (None, "a b a b"), ("und", "a b é É a b"), ("en", "a b a b a b. A  b\ta b; c\x0bd c d\x0c e"), ("en", None), ("en", ""), ("fr", " .,; \n\t! ")]
    assert check(spark.createDataFrame(rows, "lang string, text string"), least=2, every=every)


def test_odd_rows_and_documents(odd, documents):
    assert check(odd.select("lang", "text"), least=3)
    assert check(documents, least=10, most=50)


def test_a_passage_that_many_share_is_one_chunk(spark):
    """Equal pieces meet in the dictionary; a very long piece without punctuation is parsed whole."""
    passage = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([("en", f"{passage}. {passage}")] * 40 + [("en", "to be or not " * 30_000)], "lang string, text string")
    check(df)
    assert phrases.dictionary(df).agg(F.max("n")).first()[0] >= 80


def test_a_full_bitmap_changes_nothing(spark, documents):
    chunks = phrases.dictionary(documents)
    found = [{tuple(r) for r in phrases.frequent_phrases(chunks, 5, bits)[0].collect()} for bits in (15, 27)]
    assert found[0] == found[1] and found[0]


def test_clashing_columns_and_empty_table(clashing, empty):
    assert phrases.collocations(clashing.withColumn("phrase", F.lit(1)).withColumn("n", F.lit(1)), least=3).columns == COLUMNS
    assert phrases.collocations(empty).count() == 0


def test_query(spark, sf):
    got = QUERIES["op12_phrase_collocations"](spark, sf)
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))
