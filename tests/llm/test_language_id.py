import zlib

import numpy as np
from strandwork.llm import language_id as S

DOCS = "doc_id bigint, text string, lang string, score int"


def test_held_out_accuracy_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in S.language_report(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    out = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in out) >= 0.98 * len(out)


def test_held_out_labels_are_never_learnt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "n_chars")
    lied = docs.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 'xx', lang) as lang")
    rows = [sorted((r.doc_id, r.lang_pred, r.score) for r in S.language_report(d).collect()) for d in (docs, lied)]
    assert rows[0] == rows[1]


def test_mixtures_are_told_apart():
    rng = np.random.default_rng(1)
    a = " ".join("".join(rng.choice(list("abcdefg"), 5)) for _ in range(400))
    b = " ".join("".join(rng.choice(list("stuvwxyz"), 5)) for _ in range(400))
    counts = np.array([S._features(a), S._features(b)]) + 0.1
    model = S.Model(["a", "b"], (counts / counts.sum(axis=1, keepdims=True)).T)
    assert list(S.infer(model, a[:200])) == ["a"]
    mixed = S.infer(model, a[:1200] + " " + b[:600])
    assert list(mixed) == ["a", "b"] and abs(mixed["a"] - 2 / 3) < 0.05


def test_long_texts_count_as_in_one_block(monkeypatch):
    text = "Grüße, 12 World! " * 50 + " éa  b"
    whole = S._features(text)
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(S, "BLOCK", size)
        assert (S._features(text) == whole).all(), size


def test_odd_rows(spark):
    rows = [(0, "the and of the", "en", 1), (7, "der die das und", "de", 1), (7, "der die das und", "de", 1), (3, None, "en", 1), (4, "12 34 !", "en", 1), (5, "", None, 1), (None, "the and", None, 1), (6, "the of and the", None, 1)]
    got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in S.language_report(spark.createDataFrame(rows, DOCS)).collect())
    assert [(a, b) for a, b, _ in got] == [("0", "en"), ("3", "und"), ("4", "und"), ("5", "und"), ("6", "en"), ("7", "de"), ("7", "de"), ("None", "en")]
    assert all(0 <= s <= 1 for *_, s in got)
    frame = spark.createDataFrame(rows, DOCS)
    assert S.language_report(frame.limit(0)).count() == 0
    assert {r.lang_pred for r in S.language_report(frame.where("lang is null")).collect()} == {"und"}
    assert S.known_language(frame).columns == frame.columns and S.known_language(frame).count() == 5
