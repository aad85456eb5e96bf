"""Event logs, limits, purges and the streams over them."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from factloom.operators import jobs, limiter
from factloom.sources.headers import ParseError
from factloom.sources.tables import committed_versions, drop_versions, purge_version, read_typed, write_typed
from factloom.streaming import events as streams
from factloom.streaming import files

START = datetime.datetime(2025, 1, 1)


def accepted_one_by_one(events, limit, window):
    """Each event in turn against the accepted ones still young enough."""
    held, verdicts = {}, {}
    for event_id, key, at in sorted(events, key=lambda e: (e[2], e[0])):
        young = [t for t in held.get(key, []) if at - t < window]
        ok = len(young) < limit
        wait = None if ok else max(1, -((at - young[0] - window) // 1))
        held[key] = young + [at] if ok else young
        verdicts[event_id] = (ok, wait)
    return verdicts


def limiter_events():
    draw = random.Random(7)
    rows = [(i, "hot", draw.randrange(0, 20_000)) for i in range(1500)]
    rows += [(2000 + i, f"k{i % 40}", draw.randrange(0, 200_000)) for i in range(400)]
    rows += [(3000 + i, "same", 50 + i // 9) for i in range(40)]
    rows += [(4000 + i, "edge", 3600 * (i // 5)) for i in range(20)]
    return rows


def as_frame(spark, rows):
    df = spark.createDataFrame(rows, "id long, key string, s long")
    return df.select("id", "key", F.timestamp_seconds("s").alias("ts"))


@pytest.mark.parametrize("limit", [1, 5])
def test_rate_limit_equals_the_one_by_one_rule(spark, limit):
    rows = limiter_events()
    found = limiter.sliding_rate_limit(as_frame(spark, rows), "key", "ts", "id", limit, 3600).collect()
    assert {r["id"]: (r["accepted"], r["retry_after"]) for r in found} == accepted_one_by_one(rows, limit, 3600)


def test_rate_limit_retry_after(spark):
    rows = [(i, "d", i) for i in range(6)]
    found = {r["id"]: r for r in limiter.sliding_rate_limit(as_frame(spark, rows), "key", "ts", "id").collect()}
    assert [found[i]["accepted"] for i in range(6)] == [True] * 5 + [False]
    assert found[5]["retry_after"] == 3595


def test_rate_limit_stream(spark, tmp_path):
    rows = sorted(limiter_events(), key=lambda e: (e[2], e[0]))
    frame = as_frame(spark, rows)
    half = len(rows) // 2
    cut = rows[half][2]
    for name, part in (("a", frame.filter(F.col("ts") < F.timestamp_seconds(F.lit(cut)))), ("b", frame.filter(F.col("ts") >= F.timestamp_seconds(F.lit(cut))))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {}
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    limited = streams.rate_limit_stream(stream, "key", "ts", "id")
    streams.once(limited, lambda batch, _: got.update({r["id"]: (r["accepted"], r["retry_after"]) for r in batch.collect()}), str(tmp_path / "c"))
    assert got == accepted_one_by_one(rows, 5, 3600)


LOG = [("j1", 1, "queued", 0), ("j1", 2, "parsing", 10), ("j1", 2, "parsing", 10), ("j1", 4, "ready", 100), ("j1", 5, "ready", 100),
       ("j2", 3, "parsing", 20), ("j2", 1, "queued", 0), ("j2", 7, "profiling", 40)]


def log(spark, rows=LOG):
    stamped = [(*r, i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(stamped, "job_id string, seq long, stage string, progress int, place int")
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1735689600) + F.col("place") * 1800))


def test_latest_state(spark):
    found = {r["job_id"]: (r["seq"], r["stage"], r["done"]) for r in jobs.latest_job_state(log(spark).drop("ts")).collect()}
    assert found == {"j1": (5, "ready", True), "j2": (7, "profiling", False)}


def test_monotonic_events_stop_after_done(spark):
    kept = jobs.monotonic_events(log(spark), "job_id", "seq", ["ts", "place"], F.col("stage").isin("ready", "failed"))
    assert sorted((r["job_id"], r["place"]) for r in kept.collect()) == [("j1", 0), ("j1", 1), ("j1", 3), ("j2", 5), ("j2", 7)]


def test_monotonic_blocks_agree_with_one_window(spark):
    draw = random.Random(3)
    rows = [("hot" if draw.random() < 0.5 else f"j{draw.randrange(20)}", draw.randrange(500), "run", 0) for _ in range(2000)]
    expected, last = set(), {}
    for i, (key, seq, *_) in enumerate(rows):
        if seq > last.get(key, -1):
            last[key] = seq
            expected.add(i)
    kept = jobs.monotonic_events(log(spark, rows), "job_id", "seq", ["ts", "place"])
    assert {r["place"] for r in kept.collect()} == expected


def test_monotonic_stream(spark, tmp_path):
    frame = log(spark)
    frame.filter("place < 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame.filter("place >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    kept = streams.monotonic_stream(stream, "job_id", "seq", ["ts", "place"], "stage")
    streams.once(kept, lambda batch, _: got.extend((r["job_id"], r["place"]) for r in batch.collect()), str(tmp_path / "c"))
    assert sorted(got) == [("j1", 0), ("j1", 1), ("j1", 3), ("j2", 5), ("j2", 7)]


def test_stage_durations(spark):
    found = {(r["job_id"], r["mark"]): r["seconds"] for r in jobs.stage_durations(log(spark)).collect()}
    assert found == {("j1", "queued@0"): 0.0, ("j1", "parsing@10"): 1800.0, ("j1", "done"): 5400.0,
                     ("j2", "parsing@20"): 0.0, ("j2", "queued@0"): 1800.0, ("j2", "profiling@40"): 3600.0}


WORKSPACE = "0b0e6e0a-1111-2222-3333-444455556666"
MESSAGES = [f'{{"workspaceId": "{WORKSPACE}"}}', '{"workspaceId": "nope"}', "not json", '{"other": 1}', None]


def test_purge_ignores_malformed_messages(spark):
    keys = jobs.deleted_keys(spark.createDataFrame([(m,) for m in MESSAGES], "data string"))
    assert [r["key"] for r in keys.collect()] == [WORKSPACE]
    rows = spark.createDataFrame([(WORKSPACE, 1), ("other", 2), (None, 3)], "workspace string, n int")
    assert sorted(r["n"] for r in jobs.purge(rows, "workspace", keys).collect()) == [2, 3]


def test_purge_stream_rewrites_the_files_that_hold_the_key(spark, tmp_path):
    """Rows of one key in two of five files: the other three stay byte for byte, the two go, and a second purge finds the rest."""
    rows = [("other", k) for k in range(40)] + [(WORKSPACE, 40), (WORKSPACE, 41), ("third", 42)]
    df = spark.createDataFrame(rows, "workspace string, n int")
    part = F.when(F.col("n") == 40, 0).when(F.col("n") == 41, 1).otherwise(F.col("n") % 5)
    folder = str(tmp_path / "table")
    write_typed(df.repartitionById(5, part), folder)
    before = {f: f.read_bytes() for f in (tmp_path / "table").glob("version=*/*.parquet")}
    assert len(before) == 5

    def purged(key, name):
        spark.createDataFrame([(f'{{"workspaceId": "{key}"}}',)], "data string").write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema("data string").parquet(str(tmp_path / name))
        files.purge_stream(stream, folder, "workspace", str(tmp_path / f"c-{name}")).awaitTermination()
        (version,) = committed_versions(spark, folder)
        return sorted(r["n"] for r in read_typed(spark, version).collect())

    assert purged(WORKSPACE, "in") == [*range(40), 42]
    left = {f for f in before if f.exists()}
    assert len(left) == 3 and all(f.read_bytes() == before[f] for f in left)
    assert purged(WORKSPACE, "again") == [*range(40), 42] and all(f.exists() for f in left)


def test_purge_of_a_partitioned_version(spark, tmp_path):
    folder = str(tmp_path / "table")
    df = spark.createDataFrame([(k, f"p{k % 3}", k % 2) for k in range(30)], "n int, p string, version int")
    write_typed(df.drop("version"), folder, ["p"])
    gone = spark.createDataFrame([(4,), (7,)], "n int")
    version = purge_version(spark, folder, "n", gone, "one")
    drop_versions(spark, folder, version)
    assert sorted(map(tuple, read_typed(spark, version).select("n", "p").collect())) == [(k, f"p{k % 3}") for k in range(30) if k not in (4, 7)]
    assert purge_version(spark, str(tmp_path / "none"), "n", gone, "one") is None


def test_purge_stream_survives_a_stop_before_the_old_version_goes(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(WORKSPACE, 1), ("other", 2)], "workspace string, n int")
    folder = str(tmp_path / "table")
    write_typed(rows, folder)
    spark.createDataFrame([(m,) for m in MESSAGES], "data string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("data string").parquet(str(tmp_path / "in"))
    dropped = files.drop_versions
    for stop in (True, False):
        monkeypatch.setattr(files, "drop_versions", (lambda *_: 1 / 0) if stop else dropped)
        query = files.purge_stream(stream, folder, "workspace", str(tmp_path / "c"))
        if stop:
            with pytest.raises(Exception):
                query.awaitTermination()
            assert len(list((tmp_path / "table").iterdir())) == 2
        else:
            query.awaitTermination()
    assert [r["n"] for r in spark.read.parquet(f"{folder}/version=*").collect()] == [2]
    assert len(committed_versions(spark, folder)) == 1


def test_events_without_a_key_are_one_keys(spark):
    rows = [(None, k, k, f"2024-01-01 0{k}:00:00") for k in range(1, 4)] + [("a", 1, 9, None), ("a", 2, 8, "2024-01-01 01:00:00")]
    events = spark.createDataFrame(rows, "k string, id int, seq int, at string").withColumn("at", F.col("at").cast("timestamp"))
    kept = jobs.monotonic_events(events, "k", "seq", ["at", "id"], done=F.col("seq") == 2).collect()
    assert sorted(((r.k or ""), r.seq) for r in kept) == [("", 1), ("", 2), ("a", 9)]
    verdicts = limiter.sliding_rate_limit(events.filter("k is null"), "k", "at", "id", limit=2, window_seconds=86_400).collect()
    assert sorted((r.id, r.accepted) for r in verdicts) == [(1, True), (2, True), (3, False)]


def test_ingest_stream_isolates_failures(spark, tmp_path):
    """Each file once, a broken file does not stop the others, passing faults are retried."""
    incoming = tmp_path / "incoming"
    incoming.mkdir()
    for name in ("good.csv", "bad.csv", "flaky.csv", "hopeless.csv", "skip.txt", "loud.Csv"):
        (incoming / name).write_text("a,b\n1,2\n")
    calls = []

    def run(_, path, folder, key):
        name = path.rsplit("/", 1)[-1]
        calls.append(name)
        if name == "bad.csv":
            raise ParseError("Row 2 has 3 columns, expected 2.")
        if name == "hopeless.csv" or (name == "flaky.csv" and calls.count(name) < 3):
            raise RuntimeError("storage is away")

    store = str(tmp_path / "store")
    for _ in range(2):
        files.ingest_stream(spark, str(incoming), store, str(tmp_path / "c"), run=run).awaitTermination()
    outcomes = {r["path"].rsplit("/", 1)[-1]: (r["status"], r["attempts"], r["message"]) for r in spark.read.parquet(f"{store}/outcomes").collect()}
    assert outcomes == {"good.csv": ("ready", 1, None), "bad.csv": ("failed", 1, "Row 2 has 3 columns, expected 2."),
                        "flaky.csv": ("ready", 3, None), "hopeless.csv": ("failed", 3, files.FAILED), "loud.Csv": ("ready", 1, None)}
    assert calls.count("good.csv") == 1


def test_no_file_waits_for_a_slow_one(spark, tmp_path):
    """The slow file ends only when the outcomes of all others are there."""
    incoming, store = tmp_path / "incoming", tmp_path / "store"
    incoming.mkdir()
    for k in range(6):
        (incoming / f"{k}.csv").write_text("a,b\n1,2\n")
    pools = set()

    def run(session, path, folder, key):
        pools.add(session.sparkContext.getLocalProperty("spark.scheduler.pool"))
        if path.endswith("/0.csv"):
            until = time.time() + 60
            while len(list(store.glob("outcomes/*/file=*/_SUCCESS"))) < 5:
                assert time.time() < until
                time.sleep(0.1)

    files.ingest_stream(spark, str(incoming), str(store), str(tmp_path / "c"), run=run, workers=2).awaitTermination()
    assert {r["status"] for r in spark.read.parquet(f"{store}/outcomes").collect()} == {"ready"}
    assert pools == {"ingest-0", "ingest-1"}
