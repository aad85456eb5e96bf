import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factloom.llm import encoding, packing, tokens
from factloom.llm.common import scratch
from factloom.llm.queries import BYTE_BPE, QUERIES

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def brute(text):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


TEXTS = [
    "", " ", "\n", "a", "Hello world", "Hello  world\n", "a b\nc d", "a b\n\nc", "a \nb", "a\n b", " lead", "trail ", "tab\tin it here",
    "a b c", "x\x1cy z", "don't can't it's\nwe'll", "日本語 テキスト\nです", "a b\x85c", "퟿ \U0001f600 ok", "1,234 $5.00 <|endoftext|> end", "a b c " * 500,
]


def test_cached_encoding_is_the_librarys():
    want = [brute(t)[:-1].tobytes() for t in TEXTS]
    small = encoding.Encoder(BYTE_BPE, most=3)
    assert small.encode(TEXTS) == want and small.encode(TEXTS[::-1]) == want[::-1]
    assert encoding.encoder(BYTE_BPE).encode([]) == []


def test_a_full_cache_keeps_the_pieces_met_again(monkeypatch):
    small = encoding.Encoder(BYTE_BPE, most=40)
    asked, raw = [], small._raw
    monkeypatch.setattr(small, "_raw", lambda texts: asked.append(" ".join(texts)) or raw(texts))
    texts = [f"the one and\nthe other of w{k}x w{k}y w{k}z" for k in range(60)]
    assert [small.encode([t])[0] for t in texts] == [brute(t)[:-1].tobytes() for t in texts]
    assert len(small.pieces) <= 50 and sum(" other" in t for t in asked) == 1 and sum(" w7y" in t for t in asked) == 1


@pytest.mark.parametrize("name", ["odd", "clashing", "documents"])
def test_files_round_trip(spark, request, name):
    df = request.getfixturevalue(name)
    folder = scratch(spark, "tokens")
    manifest = tokens.write_tokens(df, folder, BYTE_BPE)
    rows = [(r.doc_id, brute(r.text)) for r in df.select("doc_id", "text").collect()]
    got = sorted(tokens.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and len(got) == len(rows) and [r.doc_id for r in got][len(rows) - len(known) :] == known
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert sorted((repr(r.doc_id), bytes(r.ids)) for r in got) == sorted((repr(i), x.tobytes()) for i, x in rows)
    assert [m["base"] for m in manifest] == [0, *np.cumsum([m["tokens"] for m in manifest])[:-1].tolist()]


def test_no_documents(spark, empty):
    folder = scratch(spark, "tokens")
    assert tokens.write_tokens(empty, folder, BYTE_BPE) == []
    assert tokens.read_tokens(spark, folder).count() == 0
    assert packing.pack_documents(empty, BYTE_BPE).count() == 0


def test_query(spark, sf, documents):
    got = {r.doc_id: r for r in QUERIES["op6_token_files"](spark, sf).collect()}
    start = 0
    for r in sorted(documents.collect(), key=lambda r: r.doc_id):
        ids = brute(r.text)
        assert got[r.doc_id] == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def check_packing(rows, texts, capacity=1024):
    """rows: packed pieces; texts: (id, text) of all documents. Returns the number of sequences."""
    want = []
    for i, text in texts:
        ids = brute(text)
        first = (len(ids) - 1) % capacity + 1
        stops = [0, *range(first, len(ids) + 1, capacity)]
        want += [(repr(i), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(stops, stops[1:]))]
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= capacity
    return len(filled)


@pytest.mark.parametrize("name", ["odd", "clashing", "documents"])
def test_packing(request, name):
    df = request.getfixturevalue(name)
    rows = packing.pack_documents(df, BYTE_BPE).collect()
    n = check_packing(rows, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    bound = packing.lower_bound(np.array([r.length for r in rows]), 1024)
    assert bound <= n <= bound * 1.01 + 1


def test_partitions_with_gaps_exchange(spark):
    """Partitions of one piece each, which only fit together across partitions."""
    rows = [(k, True, 0, 0, 600 if k < 9 else 424, 0) for k in range(18)]
    pieces = spark.createDataFrame(rows, packing.PIECE).repartitionByRange(18, "doc_id")
    packed = packing.pack(pieces, 1024).collect()
    assert len({r.sequence_id for r in packed}) == 9 and len(packed) == 18


def test_bounds_and_best_fit():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 300):
        lengths = rng.integers(1, 65, n)
        bins, offsets = packing.best_fit(lengths, 64)
        used = np.bincount(bins, lengths, minlength=1)
        assert used.max() <= 64 and packing.lower_bound(lengths, 64) <= len(set(bins.tolist()))
    assert packing.lower_bound(np.array([33, 33, 33]), 64) == 3 and packing.lower_bound(np.array([22] * 5), 64) == 3


def test_sequences_hold_the_ids(spark, odd):
    packed = packing.pack_documents(odd, BYTE_BPE)
    rows = packing.sequences(odd, packed, BYTE_BPE).collect()
    assert sum(r.n_tokens for r in rows) == sum(len(brute(r.text)) for r in odd.collect()) and all(len(r.ids) == 4 * r.n_tokens for r in rows)


def test_manifest_is_written_last(spark, documents):
    folder = scratch(spark, "tokens")
    tokens.write_tokens(documents, folder, BYTE_BPE)
    store, top = tokens.opened(folder)
    with store.open_input_file(f"{top}/manifest.json") as f:
        shards = json.loads(f.read())
    assert sum(s["docs"] for s in shards) == documents.count()


def test_added_tokens_are_the_librarys(spark):
    """The string of an added token is that token in both operators, next to a text without it and as part of a word."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "plain words here", "x<|endoftext|>y z", "<|endoftext|>", "<|endoftext|>\n<|endoftext|> <|endof text|>", "last one"]
    want = [np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for t in texts]
    assert 50256 in want[0] and 50256 in brute(texts[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    folder = scratch(spark, "tokens")
    tokens.write_tokens(docs, folder, BYTE_BPE)
    got = sorted(tokens.read_tokens(spark, folder).collect(), key=lambda r: r.doc_id)
    assert [bytes(r.ids) for r in got] == [x.tobytes() for x in want]
    assert [r.start for r in got] == [0, *np.cumsum([x.size for x in want])[:-1].tolist()]
    packed = sorted(packing.pack_documents(docs, BYTE_BPE).collect(), key=lambda r: r.doc_id)
    assert [(r.length, r.ids_crc32) for r in packed] == [(x.size, zlib.crc32(x.tobytes())) for x in want]
