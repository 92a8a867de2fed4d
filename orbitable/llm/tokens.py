"""Token ids and counts of texts inside tasks, by the library that belongs to a vocabulary file.

A byte-level vocabulary without normaliser always cuts a text at certain places, whatever surrounds them:
before a single space between two visible characters, around a single line break there, and between an ASCII
letter and a mark behind it. A chunk of texts is cut there with numpy, Arrow finds its distinct
stretches by comparing their bytes, and only those are looked up; the library encodes the ones that this task has not met yet
(remembered up to a bound, then anew): plain words by its model alone, as the pre-tokenizer leaves them whole, others by
the whole tokenizer.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from orbitable.llm.arrays import text_buffer

REMEMBERED = 400_000
#: Text bytes that are cut and looked up together: fewer repeated look-ups than in smaller chunks.
CHUNK_BYTES = 3 << 20
MARKS = b".,!?;:"
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_MARK = np.isin(np.arange(256), list(MARKS))
_LETTER = np.isin(np.arange(256) | 32, np.arange(97, 123)) & (np.arange(256) < 128)
#: A word of Latin letters is one piece of the byte-level pre-tokenizer, with the space before it.
_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = dict(zip([*_PRINTABLE, *(b for b in range(256) if b not in _PRINTABLE)], [*_PRINTABLE, *range(256, 324)], strict=True))
#: UTF-8 of the white space beyond ASCII: no cut beside it.
_WIDE_BLANKS = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


@lru_cache(8)
def version(path: str) -> str:
    """Digest of the vocabulary file: the tokenizer version that stored counts belong to."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _visible(data: np.ndarray) -> np.ndarray:
    """Which bytes are no part of a white-space character."""
    seen = ~_BLANK[data]
    for lead in {b[0] for b in _WIDE_BLANKS}:
        at = np.flatnonzero(data == lead)
        for blank in (b for b in _WIDE_BLANKS if b[0] == lead):
            inside = at[at + len(blank) <= len(data)]
            for k, byte in enumerate(blank):
                inside = inside[data[inside + k] == byte]
            for k in range(len(blank)):
                seen[inside + k] = False
    return seen


def stretch_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where the texts of a buffer may be cut without a change of their ids, text starts included."""
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    if len(data) > 1:
        seen = _visible(data)
        alone = np.flatnonzero(seen[:-2] & ~seen[1:-1] & seen[2:]) + 1
        cut[alone[(data[alone] == 32) | (data[alone] == 10)]] = True
        cut[alone[data[alone] == 10] + 1] = True
        cut[np.flatnonzero(_MARK[data[1:]] & _LETTER[data[:-1]]) + 1] = True
    cut[len(data)] = False
    return np.flatnonzero(cut)


class Encoder:
    """Ids of whole texts, without begin, end or added special tokens."""

    def __init__(self, path: str):
        self.pieces = None
        self.forget()
        if path.endswith(".model"):
            import sentencepiece

            self.pieces, self.cuttable = sentencepiece.SentencePieceProcessor(model_file=path), False
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        self.cuttable = (spec.get("normalizer") is None and before.get("type") == "ByteLevel"
                         and before.get("use_regex", True) and not before.get("add_prefix_space")
                         and not any(t.get("lstrip") or t.get("rstrip") or set(t["content"].encode()) & {10, 32, *MARKS} for t in added))

        self.by_model = self.cuttable and spec["model"]["type"] == "BPE" and not any(_WORD.fullmatch(t["content"]) for t in added)
        self.model = self.tokenizer.model

    def forget(self) -> None:
        """Drop what is remembered; a task does so at its end, as its worker lives on. Start anew: `place` numbers the stretches, which lie at starts[place] in `ids`."""
        self.place: dict[bytes, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _library(self, texts: list[str]) -> list[list[int]]:
        if self.pieces is not None:
            return self.pieces.encode(texts, num_threads=1)
        return [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encoded(self, stretches: list[bytes]) -> list[list[int]]:
        """Ids of single stretches."""
        texts = [s.decode() for s in stretches]
        rest = [k for k, t in enumerate(texts) if not (self.by_model and _WORD.fullmatch(t))]
        found, tokenize, rests = [], self.model.tokenize, iter([*rest, -1])
        others, after = iter(self._library([texts[k] for k in rest])), next(rests)
        for k, s in enumerate(stretches):
            if k == after:
                found.append(next(others))
                after = next(rests)
            else:
                found.append([t.id for t in tokenize(s.decode("latin-1").translate(_BYTE_CHARS))])
        return found

    def _places(self, stretches: list[bytes]) -> np.ndarray:
        """Numbers of distinct stretches; new ones are encoded."""
        if len(self.place) > REMEMBERED:
            self.forget()
        new = [s for s in stretches if s not in self.place]
        if new:
            found = self._encoded(new)
            counts = np.fromiter(map(len, found), np.int64, len(found))
            self.starts = np.append(self.starts, len(self.ids) + np.cumsum(counts) - counts)
            self.ids = np.append(self.ids, np.array([i for ids in found for i in ids], np.uint32))
            self.counts = np.append(self.counts, counts)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        return np.fromiter(map(self.place.__getitem__, stretches), np.int64, len(stretches))

    def _stretches(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(place of every stretch, bounds of each text among them)."""
        data, offsets = text_buffer(column)
        starts = stretch_starts(data, offsets)
        ends = np.append(starts, len(data)).astype(np.int64)
        cut = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        coded = cut.dictionary_encode()
        places = self._places(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy(zero_copy_only=False)
        return (places[which] if len(which) else np.zeros(0, np.int64)), np.searchsorted(starts, offsets)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, bounds of each text in them) of a string column; null is empty."""
        if not self.cuttable:
            found = self._library(pc.fill_null(column, "").to_pylist())
            bounds = np.append(0, np.cumsum([len(x) for x in found], dtype=np.int64))
            return np.array([i for ids in found for i in ids], np.uint32), bounds
        places, texts = self._stretches(column)
        counts = self.counts[places]
        upto = np.append(0, np.cumsum(counts))
        ids = self.ids[np.repeat(self.starts[places] - upto[:-1], counts) + np.arange(upto[-1])]
        return ids, upto[texts]

    def count(self, column) -> np.ndarray:
        """Number of ids of each text."""
        if not self.cuttable:
            return np.array([len(x) for x in self._library(pc.fill_null(column, "").to_pylist())], np.int64)
        places, texts = self._stretches(column)
        return np.diff(np.append(0, np.cumsum(self.counts[places]))[texts])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder a Python worker keeps from task to task."""
    return Encoder(path)
