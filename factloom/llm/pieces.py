"""SentencePiece encoding and decoding over an Aho-Corasick automaton of the pieces, by the model's type.

At each position of a text the automaton reports, along its output links, every piece that ends there. In a unigram model
scores are log probabilities: a single-pass Viterbi relaxes the best score of a piece's end by that of its start. In a BPE
model they are ranks of merges: of all neighbours that together are a piece the one with the highest score is merged
first. A character without a piece of its own falls back to its bytes.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import lean, named, text_of

SPACE = "▁"  # stands for a space inside pieces
RESULT = "ids binary, n_pieces long, score double, decoded string"


class Parts(dict):
    """Ids and score of the parts of texts met so far; a new one is cut as it is asked for."""

    def __init__(self, cut: Callable[[str], tuple[list[int], float]]):
        self.cut = cut

    def __missing__(self, part: str) -> tuple[bytes, float]:
        ids, score = self.cut(part)
        self[part] = found = struct.pack(f"<{len(ids)}I", *ids), score
        return found


class Pieces:
    """The pieces of a model file with their scores, and the automaton over them."""

    def __init__(self, path: str, most: int = 300_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
        kind, norm = proto.trainer_spec.model_type, proto.normalizer_spec
        # Texts are read as they are, after a space; what changes them or fixes pieces beforehand is the library's work.
        plainly = norm.add_dummy_prefix and norm.escape_whitespaces and not (norm.precompiled_charsmap or norm.remove_extra_whitespaces)
        plainly &= not proto.trainer_spec.treat_whitespace_as_suffix and not any(p.type in (p.USER_DEFINED, p.UNUSED) for p in proto.pieces)
        self.by_rank = kind == proto.trainer_spec.BPE
        plainly &= not self.by_rank or proto.trainer_spec.byte_fallback
        self.library = None if plainly and kind in (proto.trainer_spec.BPE, proto.trainer_spec.UNIGRAM) else model
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.score = [model.get_score(i) for i in range(n)]
        special = [i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)]
        self.unknown = model.unk_id()
        self.byte = {int(self.text[i][3:-1], 16): i for i in range(n) if model.is_byte(i)}
        plain = [i for i in range(n) if i not in set(special) and not model.is_byte(i)]
        self.fallback = min(self.score[i] for i in plain) - 10.0
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.text[i], (i, len(self.text[i]), self.score[i]))
        self.automaton.make_automaton()
        self.raw = [b""] * n
        for i in plain:
            self.raw[i] = self.text[i].replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.raw[self.unknown] = b" \xe2\x81\x87 "
        # A text may be cut wherever no piece can lie across: before a space after something else, and around newlines.
        cuts = not any(re.search(f"[^{SPACE}]{SPACE}|\n.|.\n", self.text[i], re.S) for i in plain)
        self.parts = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if cuts else ".+", re.S)
        self.most, self.known = most, (Parts(self.best), Parts(self.merged if self.by_rank else self.best))

    def best(self, text: str) -> tuple[list[int], float]:
        """The ids of the segmentation with the highest sum of scores; of equals the one with the shorter last piece."""
        n = len(text)
        score, came = [0.0] + [-np.inf] * n, [(-1, 0)] * (n + 1)
        done = 0  # positions up to here have their final score

        def settle(to: int) -> None:
            nonlocal done
            while done < to:
                done += 1
                if (not came[done][1] or came[done][0] < 0) and score[done - 1] + self.fallback > score[done]:
                    score[done], came[done] = score[done - 1] + self.fallback, (-1, 1)

        for end, (piece, size, value) in self.automaton.iter(text):
            settle(end)
            total = score[end + 1 - size] + value
            if total > score[end + 1] or total == score[end + 1] and size < came[end + 1][1]:
                score[end + 1], came[end + 1] = total, (piece, size)
        settle(n)
        out: list[int] = []
        at = n
        while at:
            piece, size = came[at]
            if piece >= 0:
                out.append(piece)
            else:
                raw = text[at - 1].encode("utf-8", "surrogatepass")
                out += [self.byte[b] for b in reversed(raw)] if all(b in self.byte for b in raw) else [self.unknown]
            at -= size
        return out[::-1], score[n]

    def merged(self, text: str) -> tuple[list[int], float]:
        """The ids after all merges, highest score first (ties: from the left), and the sum of their scores."""
        n, score = len(text), self.score
        wide = n + 1
        found = {(end + 1 - size) * wide + end + 1: piece for end, (piece, size, _) in self.automaton.iter(text)}
        stop, before = list(range(1, wide)), list(range(-1, n))  # of the symbol that starts here; stop 0: merged into another
        heap = [(-score[found[k]], b - 1, b, b + 1) for b in range(1, n) if (k := (b - 1) * wide + b + 1) in found]
        heapify(heap)
        while heap:
            _, a, b, end = heappop(heap)
            if stop[a] != b or stop[b] != end:
                continue
            stop[a], stop[b], before[end] = end, 0, a
            left = before[a]
            if left >= 0 and (piece := found.get(left * wide + end)) is not None:
                heappush(heap, (-score[piece], left, a, end))
            if end < n and (piece := found.get(a * wide + stop[end])) is not None:
                heappush(heap, (-score[piece], a, end, stop[end]))
        out: list[int] = []
        total, at = 0.0, 0
        while at < n:
            piece = found.get(at * wide + stop[at])
            if piece is not None:
                out.append(piece)
                total += score[piece]
            else:
                raw = text[at].encode("utf-8", "surrogatepass")
                out += [self.byte[b] for b in raw] if all(b in self.byte for b in raw) else [self.unknown]
                total += self.fallback
            at = stop[at]
        return out, total

    def encode(self, text: str, own: bool = False) -> tuple[bytes, float]:
        """Ids as little-endian unsigned 32-bit integers, and the sum of scores. An empty text has none.

        The segmentation is that of the model's type if ``own``, else the one with the highest sum of scores.
        """
        if not text:
            return b"", 0.0
        if own and self.library:
            ids = self.library.encode(text)
            return np.array(ids, "<u4").tobytes(), float(sum(map(self.score.__getitem__, ids)))
        known = self.known[own]
        if len(known) > self.most:
            known.clear()
        found = list(map(known.__getitem__, self.parts.findall(SPACE + text.replace(" ", SPACE))))
        return b"".join([f[0] for f in found]), sum([f[1] for f in found])

    def decode(self, ids: bytes) -> str:
        """The text of the ids; a space that began it is taken off again."""
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_pieces(docs: DataFrame, model: str, text: str = "text", decode: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (32-bit little-endian), ``n_pieces``, ``score`` and, if asked, ``decoded`` text.

    Whole texts, however long, are encoded by the model's own segmentation; null is empty and has no piece; repeated rows
    are encoded each. Of merges with equal scores the leftmost comes first, of paths with equal sums the one with the
    shorter last piece counts. The character that stands for a space decodes as one.
    Columns that clash with the added ones give way.
    """
    added = ("ids", "n_pieces", "score", "decoded")

    @F.pandas_udf(RESULT)
    def encode(texts: pd.Series) -> pd.DataFrame:
        book = pieces(model)
        found = [book.encode(t, own=True) for t in texts]
        back = [book.decode(ids) if decode else None for ids, _ in found]
        return pd.DataFrame({"ids": [f[0] for f in found], "n_pieces": [len(f[0]) // 4 for f in found], "score": [f[1] for f in found], "decoded": back})

    lean(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in added]
    found = docs.select(*(named(c) for c in kept), encode(text_of(text)).alias("__e"))
    return found.select(*(named(c) for c in kept), *(F.col(f"__e.{c}").alias(c) for c in added if decode or c != "decoded"))


def decode_pieces(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with the ``decoded`` text of its ids; null ids decode to null."""

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        book = pieces(model)
        for batch in batches:
            yield pd.Series([None if x is None else book.decode(x) for x in batch], dtype=object)

    udf = F.pandas_udf(decode, "string")
    return encoded.select(*(named(c) for c in encoded.columns if c.lower() != "decoded"), udf(named(ids)).alias("decoded"))
