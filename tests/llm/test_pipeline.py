import corpus_pipeline
import pandas as pd
from pyspark import SparkContext
from pyspark.sql import functions as F
from test_tokens import check_packing

from factloom.llm import compression, language, lines, simhash
from factloom.llm.common import written


def test_stages(spark, sf):
    """Each stage by its operator's own decisions, the last by the texts that are left."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "line_dedup", "near_dedup", "packing"]
    kept = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, sf), name)
        assert after.columns == docs.columns
        if name == "language":
            found = language.with_language(docs, language.fit(docs)).collect()
            want = {r.doc_id: kept[r.doc_id] for r in found if r.lang_pred != "und" and r.score >= 0.2}
        elif name == "quality":
            model = compression.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            want = {r.doc_id: kept[r.doc_id] for r in compression.with_quality(docs, model).collect() if r.predicted}
        elif name == "line_dedup":
            want = {r.doc_id: r.kept_text for r in lines.dedup_lines(docs).collect()}
        else:
            want = {r.doc_id: kept[r.doc_id] for r in simhash.near_duplicates(docs).collect() if r.doc_id == r.component_id}
        got = {r.doc_id: r.text for r in after.collect()}
        assert got == want and all(r.n_chars == len(r.text) for r in after.collect())
        docs, kept = after, got
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect(), kept.items())
    check_packing(corpus_pipeline.run(spark, sf).collect(), kept.items())


def test_stages_stand_odd_rows(spark, odd, sf):
    """Nulls, empties, repeats, one very long text, an empty table and columns with clashing names, in every stage."""
    from pyspark.sql import functions as F

    names = ("kept_text", "n_lines", "fp", "score", "predicted", "lang_pred", "__id", "a.b")
    taught = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    more = odd.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("doc_id") + 10**9))
    docs = taught.unionByName(more).select("*", *(F.lit(f"old {n}").alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, sf), name)
        assert after.columns == docs.columns
        rows = after.collect()
        assert rows and all(r[f"{n}"] == f"old {n}" for r in rows for n in names)
        ids = [r.doc_id for r in rows]
        if name == "language":
            letters = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
            # The text in a language that nobody taught may go, those without a letter do.
            assert letters - {10**9 + 9} <= set(ids) <= letters
        elif name == "line_dedup":
            assert sorted(map(repr, ids)) == sorted(repr(r.doc_id) for r in docs.collect())
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    check_packing(packed, [(r.doc_id, r.text) for r in docs.collect()])


def test_stages_of_an_empty_table(spark, empty, sf):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, empty, sf)
        assert got.count() == 0 and (name == "packing" or got.columns == empty.columns)


def test_a_text_is_judged_once(spark, documents, monkeypatch):
    """A second evaluation in the same task would hold a second worker, with a model and words of its own."""
    seen = spark.sparkContext.accumulator(0)

    def judged(shared, text):
        @F.pandas_udf("lang string, s double, level double")
        def judge(texts: pd.Series) -> pd.DataFrame:
            seen.add(len(texts))
            langs, scores, levels = shared.value.judge(texts.tolist())
            return pd.DataFrame({"lang": langs, "s": scores, "level": levels})

        return judge(text)

    monkeypatch.setattr(language, "_judged", judged)
    blank = spark.createDataFrame([(10**9 + k, "1 2 3", "en", "a", 5) for k in range(20)], documents.schema)
    docs = documents.unionByName(blank)
    taught = [r.doc_id for r in docs.filter(~language.held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()).collect()]
    model = language.fit(docs, fit_docs=10**6, floor=True)
    assert any(i > 10**9 for i in taught) and seen.value == len(taught)
    seen.value = 0
    language.known_language(docs, model).collect()
    assert seen.value == docs.count()
    # Texts without a letter have no level and do not lower the floor.
    assert model.floor == language.fit(documents, fit_docs=10**6, floor=True).floor > -10**9


def test_small_tables_take_no_python_workers(spark, documents, sf, monkeypatch):
    """Rows handed over as a list are read by workers that stay, beside those of the functions."""
    labels, prints = spark.read.parquet(f"{sf}/labels.parquet"), simhash.fingerprints(documents).select("fp").distinct()
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **b: 1 / 0)
    assert compression.fit(documents, labels).weights is not None
    assert compression.fit(documents.limit(0), labels).constant is not None
    assert simhash.links(prints).columns == ["a", "b"]
