"""Byte and word repeats against plain versions."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from orbitable.llm.substring_dedup import remove_repeats
from orbitable.llm.suffix_dedup import bucket_pointers, remove_copied_bytes
from tests.llm.fixtures import WORD, messy, messy_texts, nothing


def plain_bytes(rows):
    first = {}
    for doc, text in rows:
        raw = (text or "").encode()
        if doc is not None:
            for p in range(len(raw) - 49):
                s = raw[p: p + 50]
                first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        if doc is not None:
            for p in range(len(raw) - 49):
                if first[raw[p: p + 50]] < doc:
                    gone[p: p + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) > 0).sum())
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def plain_words(rows, window=35):
    count = Counter()
    for _, text in rows:
        words = WORD.findall(text or "")
        count.update(tuple(words[i: i + window]) for i in range(len(words) - window + 1))
    out = []
    for doc, text in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if count[tuple(words[i: i + window])] > 1:
                gone[i: i + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_bytes_against_plain(spark, seed):
    got = remove_copied_bytes(messy(spark, seed)).drop("spans").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_bytes(messy_texts(seed)), key=repr)
    assert sum(r.n_removed for r in got) > 1000


def test_spans_are_the_removed_bytes(spark):
    for row in remove_copied_bytes(messy(spark)).collect():
        assert sum(s.length for s in row.spans) == row.n_removed and len(row.spans) == row.n_spans


@pytest.mark.parametrize("seed", [3, 4])
def test_words_against_plain(spark, seed):
    got = remove_repeats(messy(spark, seed)).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_words(messy_texts(seed)), key=repr)
    assert sum(r.n_removed for r in got) > 500


def test_many_batches(spark, monkeypatch):
    from orbitable.llm import batches

    monkeypatch.setattr(batches, "BATCH_BYTES", 3000)
    assert sorted(map(tuple, remove_copied_bytes(messy(spark)).drop("spans").collect()), key=repr) == sorted(plain_bytes(messy_texts()), key=repr)
    assert sorted(map(tuple, remove_repeats(messy(spark)).drop("kept_text").collect()), key=repr) == sorted(plain_words(messy_texts()), key=repr)


def test_empty(spark):
    assert remove_copied_bytes(nothing(spark)).count() == 0
    assert remove_repeats(nothing(spark)).count() == 0


def test_bucket_pointers_sort_suffixes():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 99, 4000).astype(np.uint8)
    left = np.arange(len(raw), 0, -1)
    places, pointer = bucket_pointers(raw, left, 20)
    text = raw.tobytes()
    order = sorted(places, key=lambda p: text[p: p + 20])
    ranks = dict(zip(places.tolist(), pointer.tolist()))
    assert all((text[a: a + 20] == text[b: b + 20]) == (ranks[a] == ranks[b]) for a, b in zip(order, order[1:]))
    assert [ranks[p] for p in order] == sorted(ranks[p] for p in order)
