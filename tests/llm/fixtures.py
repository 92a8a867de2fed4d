"""Small tables with awkward rows, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, a long, batch string, _line_gone string, row string"


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    words = []
    for _ in range(n):
        k = rng.randrange(vocabulary)
        words.append("".join(chr(97 + (k * 7 + i * 11) % 26) for i in range(2 + k % 7)) + ("\n" if rng.random() < 0.03 else ""))
    return " ".join(words)


def messy_texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, nulls, empty and very long texts, odd characters, repeated rows."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(3, 160)) for _ in range(30)]
    rows = list(enumerate(base))
    passage = prose(rng, 70)
    for i in range(30, 42):
        rows.append((i, prose(rng, 30) + " " + passage + " " + prose(rng, 20)))
    for i in range(42, 52):
        words = base[5].split(" ") * 2
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(52, base[3]), (53, base[3]), (54, base[3].upper()), (55, None), (56, ""), (57, " \n\t "), (58, "one two"),
             (59, "ONE two"), (60, prose(rng, 30_000)), (61, "a" * 5000), (62, "a" * 300), (63, "éü 中文 \U0001f600 " * 40),
             (64, "!!! 123 ..."), (65, "x y " * 200), (None, base[3]), (None, None), (7, base[7]), (7, base[7]),
             (66, base[9] + " " + base[10]), (67, prose(rng, 40) + "\n" + base[11] + "\n" + base[12])]
    return rows


def messy(spark, seed: int = 3):
    rows = [(i, t, None if k % 7 == 0 else ("en", "de")[k % 2], f"s{k % 3}" if k % 5 else None, None, k, "x", None, "y")
            for k, (i, t) in enumerate(messy_texts(seed))]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text: str | None, size: int = 5) -> frozenset:
    words = WORD.findall(lower(text or ""))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i: i + size]) for i in range(len(words) - size + 1))


def least_reachable(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
