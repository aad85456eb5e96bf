import base64
import hashlib

import pytest

from factloom.llm import warc
from factloom.llm.common import scratch
from factloom.llm.files import opened
from factloom.llm.queries import QUERIES

ROWS = [
    (3, "http://a/\r\nX: 1", "same"), (1, "http://b/ c", "same"), (2, None, None), (9, "http://e/", ""), (None, "http://n/", "same"), (None, None, "alone"),
    (4, "http://d/", "é\r\n\r\nbody" * 1000), (4, "http://d/", "é\r\n\r\nbody" * 1000), (4, "http://d/", "other"), (2**60 + 1, "http://far/", "other"),
]
SCHEMA = "page_id long, url string, html string"


def brute(rows, least=0):
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    low = {}
    for i, b in raw:
        if i is not None:
            low[b] = min(low.get(b, i), i)
    out = []
    for i, b in raw:
        again = len(b) >= least and b in low and i != low[b]
        out.append((repr(i), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", repr(low[b] if again else None)))
    return sorted(out)


def found(df):
    return sorted((repr(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, repr(r.refers_to)) for r in df.collect())


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    folder = scratch(spark, "warc")
    manifest = warc.write_warc(pages, folder, shard_bytes=2000, roll_bytes=400, dedup_bytes=least)
    assert len(manifest) > 2 and sum(m["records"] for m in manifest) == len(ROWS)
    assert found(warc.read_warc(spark, folder)) == brute(ROWS, least)
    texts = {r.page_id: r.payload for r in warc.read_warc(spark, folder, payloads=True).filter("record_type = 'response'").collect()}
    assert bytes(texts[2**60 + 1] if least == 5 and texts.get(2**60 + 1) else b"other") == b"other"


def test_same_table_same_files(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    first = warc.write_warc(pages, scratch(spark, "warc"), shard_bytes=2000, roll_bytes=400)
    assert first == warc.write_warc(pages.repartition(5), scratch(spark, "warc"), shard_bytes=2000, roll_bytes=400)


def test_damage_is_noticed(spark):
    folder = scratch(spark, "warc")
    name = warc.write_warc(spark.createDataFrame(ROWS, SCHEMA), folder)[0]["file"]
    store, top = opened(folder)
    with store.open_input_stream(f"{top}/{name}", compression=None) as f:
        raw = f.read()
    with store.open_output_stream(f"{top}/{name}", compression=None) as f:
        f.write(raw[:-30])
    with pytest.raises(Exception):
        warc.read_warc(spark, folder).collect()


def test_bounds_follow_skew(spark):
    sizes = spark.createDataFrame([(k, 10) for k in range(1000)] + [(10**15 + k, 10) for k in range(1000)], "page_id long, bytes long")
    starts = warc.bounds(sizes, 1000, fan=16)
    assert 20 <= len(starts) <= 60 and starts == sorted(starts)


def test_one_heavy_range_is_cut_alone(spark, monkeypatch):
    """One page over the target among many: its own range is cut, no sum of the others reaches the driver again."""
    sizes = spark.range(20_000).selectExpr("id as page_id", "if(id = 7777, 100000L, 1L) as bytes")
    collected, collect = [], type(sizes).collect

    def counting(df):
        rows = collect(df)
        collected.append(len(rows))
        return rows

    monkeypatch.setattr(type(sizes), "collect", counting)
    starts = warc.bounds(sizes, 10_000, fan=16)
    assert sum(collected) <= 16 * len(collected) and 7777 in starts
    stops = [*starts[1:], 20_000]
    assert starts[0] == 0 and max(b - a for a, b in zip(starts, stops)) <= 10_000 and len(starts) <= 6


def test_no_pages(spark):
    folder = scratch(spark, "warc")
    assert warc.write_warc(spark.createDataFrame([], SCHEMA), folder) == []
    assert warc.read_warc(spark, folder).count() == 0


def test_query(spark, sf):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert found(QUERIES["op3_warc"](spark, sf)) == brute(pages)
