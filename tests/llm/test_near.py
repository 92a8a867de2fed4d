"""Near-duplicate documents, lines and vectors, and decontamination, against plain versions."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitable.llm import decontaminate, embedding_dedup, line_dedup, minhash
from orbitable.llm.components import components
from tests.llm.fixtures import least_reachable, messy, messy_texts, nothing, prose, shingle_set


def edit(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 500)] + [(5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = least_reachable({x for p in links for x in p}, links)
    assert all(got.get(n, n) == c for n, c in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_near(rows):
    sets = [(d, shingle_set(t)) for d, t in rows if d is not None and shingle_set(t)]
    links = [(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[:i] if 100 * len(s & t) >= 75 * len(s | t)]
    reach = least_reachable({d for d, _ in rows if d is not None}, links)
    return [(d, len(shingle_set(t)), reach.get(d), d is None or reach[d] == d) for d, t in rows]


@pytest.mark.parametrize("seed", [3, 4])
def test_minhash_against_plain(spark, seed):
    got = minhash.near_duplicates(messy(spark, seed)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_near(messy_texts(seed)), key=repr)


def test_minhash_near_copies_of_near_copies(spark):
    rng = random.Random(9)
    base, rows = prose(rng, 120).split(), []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(plain_near(rows))
    assert len({r.component_id for r in got}) > 1
    assert minhash.near_duplicates(nothing(spark)).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    for n in (1, 3, 40, 300):
        a, b = pool[:n], pool[n // 4: n // 4 + n]
        values, docs = np.concatenate([a, b]), np.repeat([0, 1], n)
        sig = minhash.superminhash(values, docs, 2)
        truth = len(set(a) & set(b)) / len(set(a) | set(b))
        assert abs((sig[0] == sig[1]).mean() - truth) < 0.16
        assert (sig != np.iinfo(np.uint64).max).all()


def test_bit_parallel_distance(spark):
    rng, pairs = random.Random(5), []
    for _ in range(300):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(0, 30)))
        b = list(a)
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(len(b) + 1)
            b[at: at + rng.randrange(2)] = rng.choice(["", "a", "c"])
        b = "".join(b)
        if abs(len(a) - len(b)) <= 2:
            pairs.append((a, b))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.edit_distance(F.col("a"), F.col("b")).alias("d"))
    for a, b, d in got.collect():
        want = edit(a, b)
        assert (d == want) if want <= 2 else d > 2, (a, b, d, want)


def plain_lines(rows):
    places = sorted({(d, t, p, s) for d, t in rows if d is not None and t is not None for p, s in enumerate(t.split("\n")) if len(s) >= 20})
    texts = sorted({s for *_, s in places})
    links = [(a, b) for i, a in enumerate(texts) for b in texts[:i] if abs(len(a) - len(b)) <= 2 and edit_close(a, b)]
    return least_reachable(texts, links)


def edit_close(a, b):
    if len(a) > 400:
        start = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        a, b = a[start:], b[start:]
        if len(a) > 400:
            return a[-300:] == b[-300:] and edit(a[:-300], b[:-300]) <= 2
    return edit(a, b) <= 2


def line_rows():
    rng, rows = random.Random(8), []
    lines = [prose(rng, rng.randrange(4, 14)).replace("\n", " ") for _ in range(25)]
    for i in range(40):
        picked = []
        for s in rng.sample(lines, 4):
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(s))
                s = s[:at] + rng.choice(["", "z", "qq"]) + s[at + rng.randrange(2):]
            picked.append(s)
        rows.append((i, "\n".join([*picked, "short", f"own line number {i * 7919 + 10 ** 9}"])))
    return rows + [(90, None), (91, ""), (92, "\n\n"), (None, rows[0][1]), (3, rows[3][1]), (93, rows[5][1])]


def test_lines_against_plain(spark):
    rows = line_rows()
    reach = plain_lines(rows)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, pos string")
    report = {(r.doc_id, r.n_lines): r for r in line_dedup.line_report(docs).collect()}
    links = {frozenset(x) for x in line_dedup.line_links(docs).collect()}
    texts = sorted(reach)
    assert len(links) == sum(edit(a, b) <= 2 for i, a in enumerate(texts) for b in texts[:i] if abs(len(a) - len(b)) <= 2) > 20
    classes, removed = {}, 0
    for doc, text in {r for r in rows if r[0] is not None and r[1] is not None}:
        for line in text.split("\n"):
            if len(line) >= 20:
                classes.setdefault(reach[line], []).append((doc, line))
                removed += 1
    assert sum(r.n_removed for r in report.values()) == removed - len(classes)
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns
    left = [(r.doc_id, s) for r in kept.dropDuplicates(["doc_id", "text"]).collect() if r.doc_id is not None and r.text for s in r.text.split("\n") if len(s) >= 20]
    assert len(left) == len(classes)
    assert {r.doc_id for r in kept.collect()} >= {90, 91, 92, None}


def test_lines_of_any_length(spark, tmp_path):
    import corpus_pipeline
    from orbitable.llm.queries import QUERIES

    rng, rows = random.Random(12), []
    lines = ["Les.", "x", "abcdefg", "abcdefgh", "All rights reserved", "aaaaaaaaaaaa", *["".join(rng.choice("abé ") for _ in range(n)) for n in range(5, 24)]]
    for i in range(150):
        s = rng.choice(lines)
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(s))
            s = s[:at] + rng.choice(["", "z", "q"]) + s[at + rng.randrange(2):] or "y"
        rows.append((i, f"\n{s}\n{rng.choice(lines)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    places = sorted((d, p, s) for d, t in rows for p, s in enumerate(t.split("\n")) if s)
    texts = sorted({s for *_, s in places})
    near = {frozenset((a, b)) for i, a in enumerate(texts) for b in texts[:i]
            if min(len(a), len(b)) >= 8 and edit(a, b) <= (2 if min(len(a), len(b)) >= 20 else 1)}
    assert len({s for x in near for s in x if len(s) < 20}) > 20 and any({len(s) for s in x} == {19, 20} for x in near)
    links = [frozenset(x) for x in line_dedup.line_links(docs, min_chars=line_dedup.ANY_LENGTH).collect()]
    assert len(links) == len(set(links)) == len(near)
    reach, seen, gone = least_reachable(texts, [tuple(x) for x in near]), set(), {}
    for d, p, s in places:
        if reach[s] in seen:
            gone.setdefault(d, []).append(p)
        seen.add(reach[s])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    report = {r.doc_id: r.removed for r in QUERIES["op2_line_dedup"](spark, str(tmp_path)).collect()}
    assert report == {d: gone.get(d, []) for d, _ in rows}
    kept = dict(map(tuple, corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()))
    assert kept == {d: "\n".join(s for p, s in enumerate(t.split("\n")) if p not in gone.get(d, [])) for d, t in rows}


def test_line_classes_are_components_of_all_links(spark, monkeypatch):
    rng, rows = random.Random(8), []
    sentence = prose(rng, 9).replace("\n", " ")
    for i in range(60):
        s = sentence if i % 3 else f"abcdefgh{rng.choice(['', 'ij', 'mnopq'])}"
        for _ in range(rng.choice([1, 1, 2, 3])):
            at = rng.randrange(len(s))
            s = s[:at] + rng.choice(["", "z", "qq"]) + s[at + rng.randrange(2):]
        rows.append((i, s))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = set(line_dedup.components(line_dedup.line_links(docs, min_chars=line_dedup.ANY_LENGTH)).collect())
    monkeypatch.setattr(line_dedup, "HUBS", 1)
    monkeypatch.setattr(line_dedup, "SPLIT_ROWS", 3)
    got = line_dedup.line_classes(docs, min_chars=line_dedup.ANY_LENGTH).collect()
    assert len(got) == len(want) > 20 and set(got) == want and len({r.component for r in got}) > 2


def test_near_copies_are_not_listed_in_pairs(spark, monkeypatch):
    """Lines that each have another word of one sentence in place are candidates of each other, but hardly any is a link."""
    rng, rows = random.Random(3), []
    word = lambda: "".join(rng.sample("thoner", 6))  # noqa: E731  equal letter counts
    words = [word() for _ in range(16)]
    for i in range(160):
        at = rng.randrange(len(words))
        rows.append((i, " ".join([*words[:at], word(), *words[at + 1:]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = line_dedup.components(line_dedup.line_links(docs)).collect()
    sizes, cut = [], line_dedup.cut_lineage

    def counted(df):
        sizes.append((out := cut(df)).count())
        return out

    monkeypatch.setattr(line_dedup, "cut_lineage", counted)
    monkeypatch.setattr(line_dedup, "HUBS", 2, raising=False)
    report = line_dedup.line_report(docs).collect()
    copies = len(rows) - len({s for _, s in rows})
    assert sum(r.n_removed for r in report) == copies + len(want) - len({r.component for r in want})
    assert max(sizes) <= 10 * len(rows)


def test_lines_of_messy_and_empty(spark):
    assert line_dedup.line_report(messy(spark)).count() == len(messy_texts())
    assert line_dedup.line_report(nothing(spark)).count() == 0
    assert line_dedup.dedup_lines(nothing(spark)).count() == 0
    assert line_dedup.dedup_lines(messy(spark)).columns == messy(spark).columns


def test_decontamination_against_plain(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randrange(1, 60))) for i in range(25)] + [(30, None), (31, ""), (None, "a b c d e f"), (32, "one two"), (4, "repeated id text of seven words here")]
    rows = messy_texts()
    for i in range(100, 130):
        item = items[rng.randrange(25)][1].split()
        cut = item[: max(1, int(len(item) * rng.choice([0.5, 0.8, 0.9, 1.0])))]
        rows.append((i, prose(rng, 200) + " " + " ".join(cut).upper() + " " + prose(rng, 300)))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want, held, sets = {}, {}, {}
    for i, t in items:
        if i is not None:
            held.setdefault(i, set()).update(shingle_set(t))
    for d, t in rows:
        if d is not None:
            for size in range(1, 6):  # an item of under five words is looked for as a run of its own length
                sets.setdefault(d, set()).update(x for x in shingle_set(t, size) if len(x) == size)
    for d, s in sets.items():
        for i, q in held.items():
            if q and len(q & s) >= 0.75 * len(q):
                want[d, i] = (len(q & s), len(q))
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontaminate.contained_items(docs, bench).collect()}
    assert got == want and len(want) > 10
    for a, b in ((nothing(spark), bench), (docs, bench.limit(0))):
        assert decontaminate.contaminated(a, b).count() == 0


def plain_vectors(rows, threshold=0.93):
    good = {}
    for i, v, label in rows:
        if v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        e = np.array(v, np.float32).astype(np.float64)
        if len(e) and e.any():
            good.setdefault(i, []).append((label, e / np.sqrt(e @ e)))
    links = {(i, j) for i in good for j in good if i != j and any(
        a == b and len(u) == len(w) and u @ w >= threshold for a, u in good[i] for b, w in good[j])}
    reach = least_reachable({r[0] for r in rows}, links)
    return sorted((i, sum(a == i for a, _ in links), reach[i], reach[i] == i) for i, _, _ in rows)


@pytest.mark.parametrize("small", [False, True])
def test_vectors_against_plain(spark, monkeypatch, small):
    rng = np.random.default_rng(3)
    if small:  # several lists, blocks and chunks
        for name, value in (("LIST_ROWS", 40), ("BLOCK_ROWS", 16), ("SAMPLE", 150)):
            monkeypatch.setattr(embedding_dedup, name, value)
    centres, rows = rng.normal(size=(12, 20)), []
    for i in range(300):
        v = centres[i % 12] + rng.normal(size=20) * rng.choice([0.05, 0.25, 0.4, 1])
        rows.append((i, [float(x) for x in v], int(i % 3)))
    rows += [(400 + i, rows[7][1], rows[7][2]) for i in range(20)]
    rows += [(500, None, 1), (501, [0.0] * 20, 1), (502, [float("nan")] * 20, 1), (503, [None, 1.0], 1), (504, [1.0, 2.0], 1),
             (505, [2.0, 4.0], 1), (506, rows[0][1], None), (507, [], 1), (508, [float("inf")] * 20, 0), (7, rows[7][1], rows[7][2])]
    table = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    got = sorted(map(tuple, embedding_dedup.near_vectors(table).collect()))
    want = plain_vectors([(i, v, c) for i, v, c in rows])
    assert got == want
    assert embedding_dedup.near_vectors(table.limit(0)).count() == 0


@pytest.mark.parametrize("single", [True, False])
def test_vectors_over_many_cells(spark, monkeypatch, single):
    """Cells of 16 vectors: lists that span cells, cells of several lists, several turns and one label of one cell."""
    for name, value in (("LIST_ROWS", 30), ("BLOCK_ROWS", 16), ("CELL_BYTES", 1), ("TURN_CELLS", 4), ("SAMPLE", 100)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(12)
    centres, rows = rng.normal(size=(9, 12)), []
    for i in range(420):
        v = (centres[i % 9] + rng.normal(size=12) * rng.choice([0.05, 0.2, 0.4, 1])).astype(np.float32)
        rows.append((i, [float(x) for x in v], 5 if i < 10 else 0 if i < 300 else 1))
    rows += [(500 + i, rows[40][1], 0) for i in range(30)]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{'float' if single else 'double'}>, label int")
    assert sorted(map(tuple, embedding_dedup.near_vectors(table).collect())) == plain_vectors(rows)


def test_vectors_are_sent_to_cells_not_to_lists(spark, monkeypatch, tmp_path):
    """A label that fits one cell is sent once, however many lists it has; bytes are those of single precision."""
    monkeypatch.setattr(embedding_dedup, "LIST_ROWS", 20)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=16).astype(np.float32)], i % 2) for i in range(400)]
    whole = embedding_dedup._search

    def counted(*args):
        def run(batches):
            def seen():
                for batch in batches:
                    (tmp_path / uuid.uuid4().hex).write_text(f"{len(batch)} {max(map(len, batch.column('raw').to_pylist()), default=0)}")
                    yield batch
            yield from whole(*args)(seen())
        return run

    monkeypatch.setattr(embedding_dedup, "_search", counted)
    embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    found = [list(map(int, f.read_text().split())) for f in tmp_path.iterdir()]
    assert sum(n for n, _ in found) == 400 and max(size for _, size in found) == 64


def test_double_vectors_keep_their_precision(spark, monkeypatch):
    """Sizes beyond single precision, and pairs that single precision would put on the other side of the threshold; over 64 lists."""
    monkeypatch.setattr(embedding_dedup, "LIST_ROWS", 2)
    rng, rows = np.random.default_rng(8), []
    for i in range(100):
        a = rng.normal(size=16)
        b = rng.normal(size=16)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        cosine = 0.93 + (1e-9 if i % 2 else -1e-9)
        near = cosine * a + np.sqrt(1 - cosine ** 2) * b
        scale = (1.0, 1e200, 1e-200)[i % 3]
        rows += [(2 * i, (a * scale).tolist(), i), (2 * i + 1, near.tolist(), i)]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {v: (v // 2) % 2 for v in range(200)}


def test_short_items_and_named_ids(spark):
    """Items under five words are found as runs in longer documents; ids may be text; ties go to the smaller id."""
    docs = spark.createDataFrame([("a", "x the Cat sat down on it now y"), ("b", "the cat"), ("c", "thecat sat"), ("d", "Yes"), ("e", None), ("f", "")],
                                 "doc_id string, text string")
    items = spark.createDataFrame([("two", "THE cat"), ("four", "cat sat down on"), ("one", "yes"), ("five", "the cat sat down on"), ("none", ""),
                                   ("copy", "the cat")], "item_id string, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, items).collect())
    assert got == [("a", "copy"), ("a", "five"), ("a", "four"), ("a", "two"), ("b", "copy"), ("b", "two"), ("d", "one")]
    worst = {r.doc_id: (r.n_items, r.worst_item, r.worst_share) for r in decontaminate.contaminated(docs, items).collect()}
    assert worst == {"a": (4, "copy", 1.0), "b": (2, "copy", 1.0), "d": (1, "one", 1.0)}
