import hashlib
import random
from collections import Counter

import numpy as np
from strandwork.llm import suffix_dedup as S

DOCS = "doc_id bigint, text string, row int"


def brute(rows, length=400):
    seen = Counter()
    data = [(t or "").encode() for _, t in rows]
    for d in data:
        seen.update(d[i : i + length] for i in range(len(d) - length + 1))
    out = []
    for (doc_id, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((str(doc_id), len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], DOCS)
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.repeated_strings(docs, **options).collect())


def corpus():
    rng = random.Random(8)

    def text(n):
        return "".join(rng.choice("abcdé fgh") for _ in range(n))

    a, b = text(3000), text(500)
    rows = [(1, a), (2, text(100) + a[500:1400] + text(50)), (3, text(700) + b + text(30)), (4, b + text(9) + b), (5, a[:399]), (6, None), (7, ""), (8, "x" * 1500), (9, text(2000))]
    edited = list(a)
    for at in (450, 900, 1300, 2500):
        edited[at] = "#"
    rows += [(10, "".join(edited)), (11, "".join(edited)), (12, a), (13, text(5) + a[1000:1400] + text(5)), (14, text(5) + a[1000:1399] + text(500)), (None, b[:450]), (15, "ab" * 700), (16, "y" + "ab" * 300 + "z"), (17, a[200:700] + a[1200:1700]), (17, text(300))]
    return rows


def test_any_two_residues_meet_in_the_cover_after_a_shift():
    for a in range(S.PERIOD):
        for b in range(S.PERIOD):
            assert any((a + k) % S.PERIOD in S.COVER and (b + k) % S.PERIOD in S.COVER for k in range(S.PERIOD))


def test_anchors_follow_content_and_cover_all_starts(monkeypatch):
    data = np.random.default_rng(1).integers(97, 101, 5000).astype(np.uint8)
    p, lo, hi = S.anchors(data)
    assert lo[0] == 0 and hi[-1] == len(data) - 400 and (lo[1:] == hi[:-1] + 1).all()
    assert ((p >= hi) & (p + S.GRAM <= lo + 400)).all()
    q, first, last = S.anchors(data[777:])
    mine = {(a, s) for a, x, y in zip(p - 777, lo - 777, hi - 777) for s in range(x, y + 1) if s >= 0}
    assert mine == {(a, s) for a, x, y in zip(q, first, last) for s in range(x, y + 1)}
    monkeypatch.setattr(S, "SEGMENT", 1000)
    q, first, last = S.anchors(data)
    assert {(a, s) for a, x, y in zip(p, lo, hi) for s in range(x, y + 1)} == {(a, s) for a, x, y in zip(q, first, last) for s in range(x, y + 1)}


def test_ranks_are_lexicographic():
    text = np.random.default_rng(2).integers(1, 3, 4002).astype(np.uint8)
    text[1000:2000] = text[:1000]
    text = np.concatenate([text, np.zeros(8, np.uint8)])
    at = [i for i in range(4002) if i % S.PERIOD in S.COVER]
    for depth in (5, 62, 398):
        rank = S.rank_cover(text, depth)
        keys = [bytes(text[i : i + depth]) for i in at]
        order = sorted(keys)
        first = {k: n for n, k in reversed(list(enumerate(order)))}
        assert [int(r) - 1 for r in rank] == [first[k] for k in keys]


def test_starts_of_any_residue_are_met(monkeypatch):
    rng = random.Random(6)
    base = bytes(rng.choice(b"abc") for _ in range(900))
    slices = [bytes(rng.choice(b"xyz") for _ in range(n)) + base[n : n + 500] for n in range(30)] + [b"q" * 450, b"ab" * 300, base[:400], base[100:499]]
    seen = Counter(s[i : i + 400] for s in slices for i in range(len(s) - 399))
    want = [(n, i) for n, s in enumerate(slices) for i in range(len(s) - 399) if seen[s[i : i + 400]] > 1]
    for bucket in (1 << 18, 100):
        monkeypatch.setattr(S, "BUCKET", bucket)
        number, start = S.repeated_starts(slices)
        assert list(zip(number.tolist(), start.tolist(), strict=True)) == want


def test_shared_grams_without_a_repeat(spark):
    rng = random.Random(9)
    rows = [(n, "".join(rng.choice("abcdefgh") for _ in range(450)) + "y" * 32 + "".join(rng.choice("abcdefgh") for _ in range(450))) for n in range(2)]
    got = found(spark, rows)
    assert got == brute(rows) and all(r[2] == 0 for r in got)
    a = np.empty(0, np.int64)
    assert all(len(x) == 0 for x in S._spans(a, a))


def test_strings_against_brute_force(spark):
    rows = corpus()
    assert found(spark, rows) == brute(rows)


def test_crowded_grams_give_the_same(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(S, "BLOCK", 2000)
    assert found(spark, rows, most=1) == brute(rows)
    assert found(spark, rows * 2, most=1) == brute(rows * 2)


def test_other_lengths_and_empty_table(spark):
    rows = corpus()
    assert found(spark, rows, length=333) == brute(rows, 333)
    assert S.repeated_strings(spark.createDataFrame([], DOCS)).count() == 0


def test_on_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.repeated_strings(docs).collect())
    assert got == brute(rows)


def test_rows_that_are_split_otherwise_at_each_read(spark, tmp_path, monkeypatch):
    """Files are split by how many cores there are, and executors come and go while a query runs."""
    rows, path = corpus(), str(tmp_path / "documents")
    spark.createDataFrame([(d, t, 1) for d, t in rows], DOCS).repartition(8).write.parquet(path)
    key, stage = "spark.sql.leafNodeDefaultParallelism", S.staged

    def staged(df, label):
        out = stage(df, label)
        spark.conf.set(key, 8)
        return out

    monkeypatch.setattr(S, "staged", staged)
    spark.conf.set(key, 1)
    try:
        got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.repeated_strings(spark.read.parquet(path)).collect())
    finally:
        spark.conf.unset(key)
    assert got == brute(rows)
