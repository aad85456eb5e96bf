"""A deterministic sharded WARC writer, and the reader of its archives.

Records are range-sorted by page_id into shards whose bounds follow from the bytes per id range alone, so the same table
always gives the same files. A shard's file is rolled by its compressed size. Headers, digests and record ids are made
anew from the record; files are written under temporary names, then renamed; the manifest, written last, names them.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import forget, lean, named, text_of, written
from factloom.llm.files import opened

RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the namespace of URLs in RFC 4122
DATE = "1970-01-01T00:00:00Z"


def bounds(sizes: DataFrame, target: int, fan: int = 1024) -> list[int]:
    """The first id of each shard: id ranges of about ``target`` bytes, from sums per range.

    Ranges over the target are cut again until they fit or hold one id. At most ``fan`` sums per open range reach the
    driver; the ranges depend on ids and bytes only.
    """
    low, high = sizes.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None:
        return []
    width = 1
    while (high - low) // width >= fan:
        width *= fan
    done: list[tuple[int, int]] = []  # (first id, bytes) of ranges
    open_ranges, first_pass = [low], True  # first ids; the first pass takes the whole table, later ones open ranges only
    while open_ranges:
        inside = sizes.filter(F.col("page_id").isNotNull())
        if not first_pass:
            wide = width * fan
            spans = sizes.sparkSession.createDataFrame([((lo - low) // wide,) for lo in open_ranges], "wide long")
            inside = inside.withColumn("wide", F.expr(f"(page_id - ({low})) div {wide}")).join(F.broadcast(spans), "wide")
        inside, first_pass = inside.withColumn("slot", F.expr(f"(page_id - ({low})) div {width}")), False
        sums = inside.groupBy("slot").agg(F.sum("bytes").alias("bytes")).collect()
        again = []
        for row in sums:
            first = low + row["slot"] * width
            if row["bytes"] > target and width > 1:
                again.append(first)
            else:
                done.append((first, row["bytes"]))
        open_ranges, width = again, max(1, width // fan)
    starts, filled = [], target
    for first, size in sorted(done):
        if filled + size > target:
            starts.append(first)
            filled = 0
        filled += size
    return starts


def _digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def _safe(url: str | None, page_id: object) -> str:
    """A URI for a header line: blanks and control characters escaped; a missing one is made from the id."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: object = None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record. A revisit carries the HTTP headers only; its payload's size and digest stay in its own."""
    digest = _digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_safe(url, page_id)}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_digest(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class _Roller:
    """The files of one shard: a new one begins when the last has reached the size."""

    def __init__(self, store, top: str, shard: int, roll: int):
        self.store, self.top, self.shard, self.roll = store, top, shard, roll
        self.files: list[tuple] = []
        self.out = None

    def _begin(self) -> None:
        self.name = f"part-{self.shard:06d}-{len(self.files):05d}.warc.gz"
        self.temporary = f"{self.top}/.{self.name}.{uuid.uuid4().hex}.tmp"
        self.out, self.size, self.records, self.sum = self.store.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
        info = b"software: factloom\r\nformat: WARC File Format 1.1\r\n"
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_record_id('file', self.name)}\r\nWARC-Date: {DATE}\r\nWARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
        self._put(_member(head.encode() + info + b"\r\n\r\n"))

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.sum.update(raw)
        self.size += len(raw)

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self._begin()
        self._put(_member(raw))
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.store.move(self.temporary, f"{self.top}/{self.name}")
            self.files.append((self.name, self.records, self.size, self.sum.hexdigest()))
            self.out = None


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = 64 << 20, roll_bytes: int = 32 << 20, dedup_bytes: int = 0) -> list[dict]:
    """Writes a record per row of ``pages`` (page_id, url, html) and returns the manifest.

    The payload is the html in UTF-8, null as empty. Of records with equal payloads of at least ``dedup_bytes`` bytes
    the one with the smallest page_id is the response (all rows of that id), the others are revisits of it. Rows without
    an id come first; they revisit a row with an id, and are responses if none has the payload. Equal ids are ordered by
    payload, then url. Only digests are compared across the table; the html is shuffled once, into its shards.
    """
    spark = lean(pages.sparkSession)
    rows = pages.select(named("page_id").cast("long").alias("page_id"), named("url").cast("string").alias("url"), text_of("html").alias("html"))
    prints = rows.select("page_id", F.octet_length("html").cast("long").alias("bytes"), F.sha1(F.col("html").cast("binary")).alias("sha"))
    prints = written(prints, "payload-digests")
    firsts = prints.filter(F.col("bytes") >= dedup_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = written(firsts.filter("n > 1 and first is not null").drop("n"), "first-payloads")
    again = prints.filter(F.col("bytes") >= dedup_bytes).join(firsts, "sha").filter("page_id is null or page_id <> first")
    marks = again.groupBy("page_id", "sha").agg(F.min("first").alias("first"))
    starts = bounds(prints.select("page_id", "bytes"), shard_bytes)
    # A mark travels to its page's shard ahead of the page, so that one shuffle brings both.
    marked = marks.select("page_id", F.lit(None).cast("string").alias("url"), F.col("sha").alias("html"), "first", F.lit(0).alias("kind"))
    both = marked.unionByName(rows.withColumns({"first": F.lit(None).cast("long"), "kind": F.lit(1)}))
    at = spark.sparkContext.broadcast(np.array(starts, np.int64))  # a number for each shard

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(0, np.searchsorted(at.value, ids, "right") - 1).astype(np.int32))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = opened(folder)
        roller, files, page, marks = None, [], object(), {}
        for batch in batches:
            for shard, page_id, url, html, first, kind in zip(batch["shard"], batch["name"], batch["url"], batch["html"], batch["of"], batch["kind"]):
                if roller is None or roller.shard != shard:
                    if roller:
                        roller.close()
                        files += roller.files
                    roller, marks, page = _Roller(store, top, shard, roll_bytes), {}, object()
                page_id = None if page_id is None else int(page_id)
                if page_id != page:
                    page, marks = page_id, {}
                if kind == 0:
                    marks[html] = int(first)
                    continue
                payload = html.encode("utf-8", "surrogatepass")
                first = marks.get(hashlib.sha1(payload).hexdigest()) if marks else None
                roller.add(record(page_id, url, payload, first, first is not None))
        if roller:
            roller.close()
            files += roller.files
        if files:
            yield pd.DataFrame(files, columns=["file", "records", "bytes", "sha256"])

    store, top = opened(folder)
    store.create_dir(top, recursive=True)
    # Ids travel as text: pandas has no nullable integers of its own.
    both = both.withColumns({"name": F.col("page_id").cast("string"), "of": F.col("first").cast("string")})
    dealt = both.withColumn("shard", shard_of(F.coalesce("page_id", F.lit(-(2**63))))).repartitionByRange(min(max(1, len(starts)), 20_000), "shard")
    dealt = dealt.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "kind", F.xxhash64("html"), "html", "url")
    found = dealt.select("shard", "name", "url", "html", "of", "kind").mapInPandas(write, "file string, records long, bytes long, sha256 string").collect()  # a row for each file
    manifest = [r.asDict() for r in sorted(found, key=lambda r: r["file"])]
    temporary = f"{top}/.manifest.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temporary) as out:
        out.write(json.dumps(manifest, indent=1).encode())
    store.move(temporary, f"{top}/manifest.json")
    forget(prints)
    forget(firsts)
    return manifest


def records(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzipped archive, one member at a time."""
    rest, unpack, raw = b"", zlib.decompressobj(31), []
    while True:
        chunk = rest or stream.read(1 << 20)
        if not chunk:
            break
        raw.append(unpack.decompress(chunk))
        rest = unpack.unused_data
        if unpack.eof:
            head, _, body = b"".join(raw).partition(b"\r\n\r\n")
            lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
            headers = dict(x.split(": ", 1) for x in lines)
            size = int(headers["Content-Length"])
            if body[size:] != b"\r\n\r\n":
                raise ValueError(f"Record {headers.get('WARC-Record-ID')} is damaged.")
            yield headers, body[:size]
            unpack, raw = zlib.decompressobj(31), []
    if raw and any(raw):
        raise ValueError("The archive ends inside a record.")


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """A row per page record of the manifest's files: ``RECORD`` and, if asked, ``url`` and ``payload`` (null for revisits).

    Digests of blocks and payloads are computed again and must be those of the headers.
    """
    store, top = opened(folder)
    with store.open_input_file(f"{top}/manifest.json") as f:
        names = [m["file"] for m in json.loads(f.read())]
    files = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, len(names)))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["url", "payload"] if payloads else [])]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = opened(folder)
        for name in (n for batch in batches for n in batch["file"]):
            rows: list[tuple] = []
            with store.open_input_stream(f"{top}/{name}", compression=None) as stream:
                for h, block in records(stream):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rsplit(b"Content-Length: ", 1)[1])
                    digest, revisit = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"] == "revisit"
                    if _digest(block) != h["WARC-Block-Digest"].removeprefix("sha1:") or not revisit and (_digest(payload) != digest or len(payload) != size):
                        raise ValueError(f"{name}: {h['WARC-Record-ID']} does not match its digests.")
                    ids = [int(h[k]) if k in h else None for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
                    rows.append((ids[0], size, digest, h["WARC-Type"], ids[1], *((h["WARC-Target-URI"], None if revisit else payload) if payloads else ())))
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    return files.mapInPandas(read, RECORD + (", url string, payload binary" if payloads else ""))
