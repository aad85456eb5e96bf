"""Token ids as flat binary files.

A dataset is a folder of shards in ascending doc_id order. ``part-N.bin`` holds the ids of its documents one after the
other as unsigned 16- or 32-bit little-endian integers, whichever the vocabulary needs. ``part-N.idx`` holds, for n
documents, n + 1 offsets into it, n doc_ids and n flags (1: has an id), all 64-bit integers. ``manifest.json``, written
last, lists the shards with their bases: the ids before each of them, by prefix sums.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import lean, named, text_of
from factloom.llm.encoding import encoder
from factloom.llm.files import committed, mapped, opened


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, text: str = "text") -> list[dict]:
    """Encodes every whole text (null: empty), appends ``end_id`` and writes the dataset; returns its manifest.

    Documents are range-sorted by doc_id, those without an id first; repeated ids are ordered by their text's hash and
    text. A task holds one batch of texts. A lost task writes its shard again under the same name.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary)
        kind = "<u2" if encode.size <= 1 << 16 else "<u4"
        store, top = opened(folder)
        part = TaskContext.get().partitionId()
        ids, lengths = [], []
        end = np.array([end_id], "<u4").tobytes()
        with committed(store, f"{top}/part-{part:05d}.bin") as out:
            for batch in batches:
                raw = [x + end for x in encode.encode(batch["text"].tolist())]
                out.write(np.frombuffer(b"".join(raw), "<u4").astype(kind).tobytes())
                lengths += [len(x) // 4 for x in raw]
                ids.append(batch[["id", "has"]].to_numpy(np.int64))
        if lengths:
            known = np.concatenate(ids)
            with committed(store, f"{top}/part-{part:05d}.idx") as out:
                out.write(np.concatenate([[0], np.cumsum(lengths), known[:, 0], known[:, 1]]).astype("<i8").tobytes())
            yield pd.DataFrame({"part": [part], "docs": [len(lengths)], "tokens": [sum(lengths)], "dtype": [kind]})

    lean(docs.sparkSession)
    opened(folder)[0].create_dir(opened(folder)[1], recursive=True)
    rows = docs.select(named("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    flat = ordered.select("text", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNotNull().cast("long").alias("has"))
    shards = flat.mapInPandas(write, "part int, docs long, tokens long, dtype string").collect()  # a row for each file
    manifest, base = [], 0
    for row in sorted(shards, key=lambda r: r["part"]):
        manifest.append(row.asDict() | {"base": base})
        base += row["tokens"]
    store, top = opened(folder)
    with committed(store, f"{top}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start`` (ids before the document), ``n_tokens`` and ``ids`` (32-bit little-endian) from the files."""
    store, top = opened(folder)
    with store.open_input_file(f"{top}/manifest.json") as f:
        manifest = json.loads(f.read())
    shards = spark.createDataFrame([(m["part"], m["docs"], m["dtype"], m["base"]) for m in manifest], "part int, docs long, dtype string, base long")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = opened(folder)
        for shard in (s for batch in batches for s in batch.itertuples(index=False)):
            ids = mapped(store, f"{top}/part-{shard.part:05d}.bin", shard.dtype)
            index = mapped(store, f"{top}/part-{shard.part:05d}.idx", "<i8")
            n = shard.docs
            for at in range(0, n, 2000):
                to = min(n, at + 2000)
                cut = index[at : to + 1].tolist()
                known = pd.array(np.array(index[n + 1 + at : n + 1 + to]), "Int64")
                known[np.array(index[2 * n + 1 + at : 2 * n + 1 + to]) == 0] = pd.NA
                yield pd.DataFrame({
                    "doc_id": known,
                    "start": shard.base + np.array(cut[:-1]),
                    "n_tokens": np.diff(cut),
                    "ids": [ids[a:b].astype("<u4").tobytes() for a, b in zip(cut, cut[1:])],
                })

    return shards.repartition(max(1, len(manifest))).mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def digests(tokens: DataFrame) -> DataFrame:
    """Each document's place, size and unsigned crc32 instead of its ids."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
