"""Whole texts to token ids with the tokenizers library, each distinct word once per worker.

A byte-level BPE splits text before it merges. Between a character that is no white space and a following single space
or newline there is always a split, so a text may be cut there and the pieces' ids joined. The pieces of a batch are cut
and numbered by Arrow, and their ids copied from one array; those not met before are encoded by the library, many to a
text. Texts with any other white space, or with the string of an added token, go to it whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from factloom.llm.common import kept_alone

#: White space, separators and joiners that a tokenizer might read as white space, and the pairs that make runs.
UNUSUAL = re.compile(
    "[\t\x0b\x0c\r\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁯　﻿]"
)


PAIRS = ("  ", " \n", "\n ", "\n\n")


def _plainly_spaced(text: str) -> bool:
    """Words with one space or newline between, none around. Substring searches cost a tenth of one pattern for all."""
    return " " in text and text[0] not in " \n" and text[-1] not in " \n" and not any(p in text for p in PAIRS) and not UNUSUAL.search(text)


class Encoder:
    """``encode(texts)``: per text its ids as little-endian unsigned 32-bit integers.

    The string of an added token in a text becomes that token, as the library has it.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.size, self.most = self.tokenizer.get_vocab_size(), most
        vocabulary = self.tokenizer.get_vocab(False)
        self.bytes_of = np.zeros(self.size, np.int64)
        for word, i in vocabulary.items():
            self.bytes_of[i] = len(word)  # the byte-level alphabet has a character for each byte
        # Of pieces[k], met uses[k] times, the ids are ids[ends[k] : ends[k + 1]].
        self.pieces, self.uses = pa.array([], pa.large_string()), np.empty(0, np.int64)
        self.ids, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def _forget(self) -> None:
        """Keeps the pieces that were met more than once, the most used ones if they are over half of ``most``."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > self.most // 2:
            kept = np.sort(kept[np.argpartition(-self.uses[kept], self.most // 2)[: self.most // 2]])
        self.ids, stops = self._ids_of(kept)
        self.pieces, self.ends, self.uses = self.pieces.take(pa.array(kept)), np.concatenate([[0], stops]), self.uses[kept] // 2

    def _ids_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces at these places one after the other, and where each piece's end."""
        n = self.ends[places + 1] - self.ends[places]
        stops = np.cumsum(n)
        return self.ids[np.repeat(self.ends[places] - stops + n, n) + np.arange(n.sum())], stops

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: pa.Array, heads: pa.Array) -> None:
        """Encodes new pieces: heads alone, words many to a text, where the ids' byte lengths tell where each word ends."""
        spaced = [w if w[:1] == "\n" else " " + w for w in words.to_numpy(zero_copy_only=False)]
        raw = self._raw(["".join(spaced[k : k + 100]) for k in range(0, len(spaced), 100)])
        alone = self._raw([h[1:] for h in heads.to_numpy(zero_copy_only=False)])
        ids = np.frombuffer(b"".join(raw), "<u4")
        ends = np.cumsum(self.bytes_of[ids])
        sizes = np.cumsum(pc.binary_length(pa.array(spaced, pa.large_string())).to_numpy())
        cuts = np.searchsorted(ends, sizes)
        if ends[-1:].tolist() != sizes[-1:].tolist() or (ends[cuts] != sizes).any():
            raise ValueError("The tokenizer does not split before a space.")
        stops = np.concatenate([cuts + 1, len(ids) + np.cumsum([len(x) // 4 for x in alone], dtype=np.int64)])
        self.pieces = pa.concat_arrays([self.pieces, words, heads])
        self.ends = np.concatenate([self.ends, self.ends[-1] + stops])
        self.ids = np.concatenate([self.ids, ids, np.frombuffer(b"".join(alone), "<u4")])

    def encode(self, texts: list[str], chars: int = 2_000_000) -> list[bytes]:
        """Texts are taken in parts of about ``chars`` characters, so that their words are never held all at once."""
        out: list[bytes] = []
        part: list[str] = []
        size = 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= chars:
                out += self._encode(part)
                part, size = [], 0
        return out + self._encode(part)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > self.most:
            self._forget()
        plain = [k for k, t in enumerate(texts) if _plainly_spaced(t) and not self.added.search(t)]
        out: list[bytes | None] = [None] * len(texts)
        if plain:
            for k, raw in zip(plain, self._joined([texts[k] for k in plain])):
                out[k] = raw
        rest = [k for k, x in enumerate(out) if x is None]
        for k, raw in zip(rest, self._raw([texts[k] for k in rest])):
            out[k] = raw
        return out

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Plainly spaced texts: the ids of their pieces joined."""
        cut = pc.split_pattern(pa.array([t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        firsts = cut.offsets.to_numpy()
        coded = cut.values.dictionary_encode()
        index = coded.indices.to_numpy()
        # A text's first piece, its head, has no space before it; a space before its name tells it from words.
        head = np.zeros(len(index), bool)
        head[firsts[:-1]] = True
        met = np.zeros((2, len(coded.dictionary)), bool)
        met[0, index[~head]] = met[1, index[head]] = True
        words, heads = (coded.dictionary.filter(pa.array(m)) for m in met)
        heads = pa.array([" " + h for h in heads.to_numpy(zero_copy_only=False)], pa.large_string())
        known = pc.index_in(pa.concat_arrays([words, heads]), self.pieces).fill_null(-1).to_numpy()
        fresh = known < 0
        number = np.zeros(met.shape, np.int64)
        number[met] = np.where(fresh, len(self.pieces) + np.cumsum(fresh) - 1, known)
        if fresh.any():
            self._learn(words.filter(pa.array(fresh[: len(words)])), heads.filter(pa.array(fresh[len(words) :])))
        places = number[head.astype(np.int8), index]
        uses = np.bincount(places, minlength=len(self.pieces))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        ids, stops = self._ids_of(places)
        raw, cuts = ids.tobytes(), [0, *(4 * stops[firsts[1:] - 1]).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def encoder(path: str) -> Encoder:
    """One encoder, and so one cache, per worker and vocabulary file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
    return kept_alone(("encoder", path), lambda: Encoder(path))
