"""Token counts, packing, language, quality and the pipeline."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orbitable.llm import langid, packing, quality, token_counts
from tests.llm.fixtures import messy, messy_texts, nothing, prose

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["  a  b", " \n x\ty z  ", "<|endoftext|> hi <|endoftext|>", "a <|endoftext|>b  c", "it's  we're x y\x85 z\x1c q", " a", "a ", " ", "　a b c d"]


def ids_of(texts):
    return [x.ids for x in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]


def rows_with_odd():
    return messy_texts() + [(200 + i, t) for i, t in enumerate(ODD)]


def test_token_counts(spark, tmp_path):
    rows = rows_with_odd()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens long")
    want = sorted(((d, len((t or "").encode()), len(i), len(i) > 1024) for (d, t), i in zip(rows, ids_of([t or "" for _, t in rows]))), key=repr)
    for _ in range(2):
        got = token_counts.count_tokens(docs, BPE, str(tmp_path / "cache"))
        assert sorted(map(tuple, got.collect()), key=repr) == want
    stored = spark.read.parquet(str(tmp_path / "cache"))
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in rows})
    more = spark.createDataFrame([(1, "new text"), (2, rows[0][1])], "doc_id long, text string")
    assert token_counts.count_tokens(more, BPE, str(tmp_path / "cache")).count() == 2
    assert spark.read.parquet(str(tmp_path / "cache")).count() == stored.count() + 1
    assert token_counts.count_tokens(nothing(spark), BPE, str(tmp_path / "cache2")).count() == 0


def test_other_vocabularies(spark, tmp_path):
    import sentencepiece

    piece = public_tokenizers.path("piece_bpe_32k.model")
    texts = [t for t in (t or "" for _, t in messy_texts()) if len(t) < 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, piece, str(tmp_path / "c")).collect()}
    reader = sentencepiece.SentencePieceProcessor(model_file=piece)
    assert got == {i: len(reader.encode(t)) for i, t in enumerate(texts)}
    word = public_tokenizers.path("word_bpe_49k.json")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, word, str(tmp_path / "c")).collect()}
    assert got == {i: len(x.ids) for i, x in enumerate(Tokenizer.from_file(word).encode_batch(texts, add_special_tokens=False))}


def check_packing(rows, got):
    ids = {}
    for (d, t), i in zip(rows, ids_of([t or "" for _, t in rows])):
        ids.setdefault(d, []).append(i + [1])
    by_doc, windows = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        if len(ids[d]) > 1:  # repeated ids: sizes only
            assert sum(p.length for p in pieces) == sum(map(len, ids[d]))
            continue
        whole, at = ids[d][0], 0
        for p in sorted(pieces, key=lambda p: p.start):
            part = np.array(whole[p.start: p.start + p.length], "<u4")
            assert p.start == at and p.length == len(part) > 0 and p.doc_tokens == len(whole)
            assert p.ids_crc32 == zlib.crc32(part.tobytes())
            at += p.length
        assert at == len(whole)
    padding = total = 0
    for pieces in windows.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= pieces[0].tier and len({p.tier for p in pieces}) == 1 and len({p.step_group for p in pieces}) == 1
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding, total


def test_packing(spark):
    rows = rows_with_odd()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start long").coalesce(1)
    padding, total = check_packing(rows, packing.pack(docs, BPE).collect())
    assert padding < 2048 and total > 10_000
    assert packing.pack(nothing(spark), BPE).count() == 0


def test_packing_in_blocks():
    packer, rng, sizes = packing._Packer(3), random.Random(1), []
    for i in range(4000):
        sizes.append(rng.choice([1, 20, 250, 256, 257, 600, 1500, 2048, 5000]))
        packer.add(i, np.arange(sizes[-1], dtype=np.uint32))
        if packer.tokens >= 1 << 17:
            packer.pack(last=False)
    packer.pack(last=True)
    assert sum(r[2] for r in packer.rows) == sum(sizes)
    fill, tier = {}, {}
    for r in packer.rows:
        fill[r[5]], tier[r[5]] = fill.get(r[5], 0) + r[2], r[7]
    assert sum(fill[s] != tier[s] for s in fill) <= 1
    assert {512, 1024, 2048} <= set(tier.values()) <= set(packing.TIERS)
    steps = {}
    for r in packer.rows:
        steps[r[8]] = steps.get(r[8], 0) + r[2]
    assert max(steps.values()) == packing.STEP_TOKENS and sum(v < packing.STEP_TOKENS for v in steps.values()) <= len(packing.TIERS)


def languages(spark, n=400):
    rng = random.Random(4)
    alphabet = {"aa": "abcdei", "bb": "nopqrs", "cc": "ßüöäxyz"}
    rows = []
    for i in range(n):
        lang = rng.choice(list(alphabet))
        rows.append((i, " ".join("".join(rng.choice(alphabet[lang]) for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(3, 60))), lang))
    return rows


def test_language_held_out_accuracy(spark):
    rows = languages(spark)
    docs = spark.createDataFrame([(*r, 0.5) for r in rows] + [(900, None, "aa", 0.1), (901, "", "aa", 0.1), (902, "12 !", "bb", 0.1), (903, "abc", None, 0.1)],
                                 "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.identify(docs, langid.learn(docs)).collect()}
    held = [(i, x) for i, _, x in rows if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert len(held) > 50 and np.mean([got[i].lang_pred == x for i, x in held]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].rejected for i in (900, 901, 902))
    assert got[903].lang_pred in {"aa", "bb", "cc"} and all(0 <= r.score <= 1 for r in got.values())
    assert not any(got[i].rejected for i, *_ in rows)
    # Labels of held-out rows change nothing.
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    again = {r.doc_id: r.score for r in langid.identify(other, langid.learn(other)).collect()}
    assert again == {i: r.score for i, r in got.items()}
    assert {r.lang_pred for r in langid.identify(messy(spark).withColumn("lang", F.lit(None).cast("string")), None).collect()} == {"und"}
    assert langid.identify(nothing(spark), langid.learn(nothing(spark))).count() == 0


def test_language_rejects_what_it_never_learned(spark):
    rng = random.Random(9)

    def text(alphabet, n):
        return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 9))) for _ in range(n))

    fresh = [(1000 + i, text("ghjkltuvw", rng.randrange(15, 60)), None) for i in range(40)] + [(1100 + i, text("жзиклмнопр", 20), None) for i in range(20)]
    mixed = [(1200 + i, text("abcdei", 12) + " " + text("nopqrs", 12), None) for i in range(20)]
    docs = spark.createDataFrame(languages(spark) + fresh + mixed, "doc_id long, text string, lang string")
    got = {r.doc_id: r.rejected for r in langid.identify(docs, langid.learn(docs)).collect()}
    assert all(got[i] for i, *_ in fresh)
    assert not any(got[i] for i, *_ in mixed)


def test_language_sample_has_every_label(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "ef"]) for _ in range(8)), "aa") for i in range(3000)]
    rows += [(5000 + i, " ".join(rng.choice(["xy", "zw", "uv"]) for _ in range(8)), "zz") for i in range(12)]
    docs = spark.createDataFrame(rows, "id long, text string, label string")
    model = langid.train(docs, 100)
    assert model.labels == ["aa", "zz"]
    got = langid.identify(docs.select(F.col("id").alias("doc_id"), "text"), model).collect()
    assert np.mean([r.lang_pred == ("zz" if r.doc_id >= 5000 else "aa") for r in got]) > 0.99
    assert sum(x[1] for x in langid._shares({"a": 5, "b": 5000, "c": 90, "d": 7000}, 400)) == 400


def test_quality(spark):
    rng, rows, marks = random.Random(7), [], []
    for i in range(1500):
        good, site = rng.random() < 0.6, rng.randrange(12)
        if site < 3:
            good = rng.random() < 0.95
        text = prose(rng, 40, 300) if good else " ".join(rng.choice(["BUY", "now!!", "$$$", "click", "free"]) for _ in range(40))
        if rng.random() < 0.3:
            text = ""  # nothing but the site speaks for these
        rows.append((i, text, f"h{site}", f"p{i % 2}", 0.1))
        if i % 3:
            marks.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string, score double")
    labels = spark.createDataFrame(marks + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels, F.col("host"), F.col("path")).collect()}
    assert set(got) == set(range(1500))
    held = [(i, y) for i, y in marks if got[i].held_out and rows[i][1]]
    assert np.mean([got[i].keep == bool(y) for i, y in held]) > 0.95
    silent = [i for i in got if not rows[i][1]]
    assert np.mean([got[i].score for i in silent if rows[i][2] in ("h0", "h1", "h2")]) > 0.1 + np.mean([got[i].score for i in silent if rows[i][2] in ("h5", "h6")])
    none = quality.score_quality(docs, labels.limit(0), F.col("host"), F.col("path"))
    assert {round(r.score, 6) for r in none.collect()} == {0.5}
    assert quality.score_quality(nothing(spark), labels, F.col("source"), F.col("lang")).count() == 0
    assert quality.score_quality(messy(spark), labels, F.col("source"), F.col("lang")).count() == len(messy_texts())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    alphabet = {"aa": "abcdei", "bb": "nopqrs"}

    def text(lang, n):
        return " ".join("".join(rng.choice(alphabet[lang]) for _ in range(rng.randrange(2, 9))) for _ in range(n))

    rows = [(i, text(("aa", "bb")[i % 2], 60), ("aa", "bb")[i % 2], "s", 1) for i in range(80)]
    item = text("aa", 20)
    near = rows[4][1].split()
    near[30] = "changed"
    extra = [(100, None, "aa", "s", 0), (101, "123", "aa", "s", 3), (102, rows[2][1] + "\n" + text("aa", 30), "aa", "s", 1),
             (103, " ".join(near), "aa", "s", 1), (104, text("aa", 50) + " " + item + " " + text("aa", 50), "aa", "s", 1), (105, rows[6][1], "aa", "s", 1)]
    folder = tmp_path / "t"
    spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(folder))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept.append({r.doc_id for r in docs.collect()})
    everything = set(range(80)) | {102, 103, 104}
    assert kept[0] == everything | {105}
    assert kept[1] == everything
    assert kept[2] == everything - {103}
    assert kept[3] == everything - {103, 104}
    got = corpus_pipeline.run(spark, str(folder)).collect()
    assert {r.doc_id for r in got} == kept[3]


@pytest.mark.parametrize("name", ["op5_packing", "op6_language_id"])
def test_registered(spark, name):
    import __spark_entry__ as entry

    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() >= 200
