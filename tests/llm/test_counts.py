"""Importance resampling, phrase mining and best-fit packing against plain versions."""

import hashlib
import math
import random
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from orbitable.llm import best_fit, collocations, importance
from tests.llm.fixtures import lower, messy, messy_texts, nothing, prose

BPE = public_tokenizers.path("byte_bpe_50k.json")
CLASHING = ("doc_id long, text string, lang string, rank long, score string, n_words int, weight long, phrase string, f long, part long, "
            "length long, task int, sequence_id long, n long, bucket long")


def table_with_clashes(spark, rows):
    return spark.createDataFrame([(i, t, lang, *[None] * 12) for i, t, lang in rows], CLASHING).repartition(3)


def plain_resample(docs, target):
    words = [(d, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))) for d, t in docs]
    features = lambda w: [zlib.crc32(" ".join(w[i: i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    ours = [(d, len(w), features(w)) for d, w in words]
    s = Counter(b for _, _, f in ours for b in f)
    t = Counter(b for x in target for b in features(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x or ""))))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)}
    rows = []
    for d, n, f in ours:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = len(fit) * 5 // 100
    ranks = {id(r): k + 1 for k, r in enumerate(fit[:drawn])}
    return sorted(((d, f, w, s, ranks.get(id(r))) for r in rows for d, _, f, w, s in [r]), key=repr)


@pytest.mark.parametrize("target", [["one two three", None, "the passage é 中文"], []])
def test_resample(spark, target):
    rows = messy_texts() + [(100 + i, prose(random.Random(i), 25)) for i in range(80)]
    docs = table_with_clashes(spark, [(i, t, "en") for i, t in rows])
    items = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, rank long")
    got = importance.resample(docs, items)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(rows, target)


def test_resample_of_nothing(spark):
    assert importance.resample(nothing(spark), nothing(spark)).collect() == []


def test_composed_checksums():
    rng = random.Random(4)
    for _ in range(200):
        a, b = rng.randbytes(rng.randrange(0, 9)), rng.randbytes(rng.choice([0, 1, 2, 3, 7, 300, 70_000]))
        both = importance.compose(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32),
                                  importance.append_tables(np.array([len(b)])), np.zeros(1, np.int64))
        assert int(both[0]) == zlib.crc32(a + b)


def plain_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f[lang].update(" ".join(words[i: i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        found, cover = [], Counter()
        for phrase, a in counts.items():
            w = phrase.split(" ")
            if a >= least:
                for m in range(2, len(w)):
                    for i in range(len(w) - m + 1):
                        inner = " ".join(w[i: i + m])
                        cover[inner] = max(cover[inner], a)
        for phrase, a in counts.items():
            w = phrase.split(" ")
            if len(w) == 1 or a < least or 100 * cover[phrase] >= 80 * a:
                continue
            cuts = [(counts[" ".join(w[:k])], counts[" ".join(w[k:])]) for k in range(1, len(w))]
            score, k = min((2000000 * a // (x + y), k) for k, (x, y) in enumerate(cuts))
            found.append((-score, -a, phrase.encode(), *cuts[k]))
        for rank, (score, a, phrase, x, y) in enumerate(sorted(found)[:top]):
            out.append((lang, rank + 1, phrase.decode(), -a, x, y, n[lang], -score))
    return sorted(out)


def phrase_rows(seed: int = 5):
    rng = random.Random(seed)
    rows = [(None if i % 11 == 0 else "und" if i % 13 == 0 else ("en", "de")[i % 2], t) for i, (_, t) in enumerate(messy_texts(seed))]
    common = " ".join(["New York", "is É big", "a\tb"])
    for i in range(150):
        parts = [prose(rng, rng.randrange(1, 30), 25), common if i % 3 else "new york", rng.choice([", ", ". ", " ", "\n", "\v"]), "new YORK city"]
        rng.shuffle(parts)
        rows.append(("en" if i % 3 else "de", " ".join(parts)))
    return rows


@pytest.mark.parametrize("cells", [(1 << 40, 1 << 40), (2000, 50), (300, 7)])
def test_collocations(spark, cells):
    rows = phrase_rows()
    docs = table_with_clashes(spark, [(i, t, lang) for i, (lang, t) in enumerate(rows)])
    for least, top in ((30, 2000), (5, 40)):
        got = collocations.collocations(docs, least, top, *cells)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        want = plain_collocations(rows, least, top)
        assert want and sorted(map(tuple, got.collect())) == want


def test_collocations_of_nothing(spark):
    assert collocations.collocations(nothing(spark)).collect() == []
    empty = spark.createDataFrame([(None, None), ("en", ""), ("en", " .,\t")], "lang string, text string")
    assert collocations.collocations(empty, 1).collect() == []


def test_trie_bursts_and_spills(monkeypatch):
    """Small limits: many containers, several spills, one prefix with nearly all windows."""
    monkeypatch.setattr(collocations, "BURST", 16)
    monkeypatch.setattr(collocations, "SPILL", 500)
    rng = random.Random(8)
    texts = ["x y " + prose(rng, 1, 3000) + " " + prose(rng, rng.randrange(0, 12), 3000) for _ in range(600)] + ["x y z w " * 300]
    counter, rows = collocations._Counter(3, np.full((collocations.PAIR_BUCKETS + collocations.WORD_BUCKETS) // 8, 255, np.uint8)), []
    trie = collocations.Trie()
    for k in range(0, len(texts), 20):
        counter.add(["en"] * len(texts[k: k + 20]), pa.array(texts[k: k + 20]))
        rows += counter.rows
        counter.rows = []
    counter.finish()
    rows += counter.rows
    assert len({r[1] for r in rows}) == 5 and len(rows) > 12
    assert sum(r[2] for r in rows if r[1] == -2) == sum(len(t.split()) for t in texts)
    high = np.array([rng.randrange(3) << 32 | rng.randrange(5) for _ in range(3000)], np.uint64)
    low = np.array([rng.randrange(50) for _ in range(3000)], np.uint64)
    for k in range(0, 3000, 100):
        trie.add(high[k: k + 100], low[k: k + 100])
    h, lo, n = trie.subtrees()
    assert len(trie.leaves) == 15 and trie.bounds == sorted(trie.bounds)
    assert Counter(dict(zip(zip(h.tolist(), lo.tolist()), n.tolist()))) == Counter(zip(high.tolist(), low.tolist()))
    want, words, seen, sums = Counter(), Counter(), Counter(), Counter()
    for t in texts:
        w = t.replace("\n", " \n ").split(" ")
        w = [x for x in w if x]
        for piece in " ".join(w).split("\n"):
            p = piece.split()
            words.update(p)
            want.update(tuple(p[i: i + 4]) for i in range(len(p) - 1))
    for _, part, n, listed, ids, counts in (r for r in rows if r[1] > -2):
        listed, counts = listed.split(b" "), collocations._numbers(counts, n)
        if part == -1:
            sums.update({w.decode(): c for w, c in zip(listed, counts.tolist())})
        else:
            for window, c in zip(collocations._numbers(ids, 4 * n).reshape(4, n).T.tolist(), counts.tolist()):
                seen[tuple(listed[i - 1].decode() for i in window if i)] += c
    assert seen == want and sums == words


def plain_bins(lengths, limit):
    rooms = []
    for n in sorted(lengths, reverse=True):
        k = bisect_left(rooms, n)
        insort(rooms, (rooms.pop(k) if k < len(rooms) else limit) - n)
    return len(rooms)


@pytest.mark.parametrize("limit", [2048, 64])
def test_best_fit(spark, limit):
    rows = messy_texts() + [(100 + i, "same text again") for i in range(150)]
    docs = table_with_clashes(spark, [(i, t, None) for i, t in rows])
    got = [tuple(r) for r in best_fit.pack_best_fit(docs, BPE, limit).collect()]
    encoded = [(d, [*x.ids, 0]) for (d, _), x in zip(rows, Tokenizer.from_file(BPE).encode_batch([t or "" for _, t in rows], add_special_tokens=False))]
    want = []
    for d, ids in encoded:
        first = len(ids) - (-(-len(ids) // limit) - 1) * limit
        cuts = [0, *range(first, len(ids) + 1, limit)]
        want += [(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r[:5] for r in got), key=repr) == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in got:
        sequences[r[5]].append((r[6], r[3]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= limit
    assert len(sequences) == plain_bins([r[3] for r in want], limit)


def test_best_fit_of_nothing(spark):
    assert best_fit.pack_best_fit(nothing(spark), BPE).collect() == []


def test_plan_equals_best_fit_decreasing():
    rng = random.Random(6)
    for _ in range(120):
        limit = rng.choice([7, 50, 2048])
        counts = {rng.randrange(1, limit + 1): rng.randrange(1, rng.choice([3, 60])) for _ in range(rng.randrange(0, 60))}
        ranks, bins = Counter(), defaultdict(list)
        for length, first, n, each, sequence, offset in best_fit.plan_slots(counts, limit):
            assert first == ranks[length]
            ranks[length] += n
            for k in range(n):
                bins[sequence + k // each].append((offset + k % each * length, length))
        assert ranks == Counter(counts) and sorted(bins) == list(range(len(bins)))
        for pieces in bins.values():
            pieces.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) <= limit
        assert len(bins) == plain_bins([n for n, c in counts.items() for _ in range(c)], limit)
