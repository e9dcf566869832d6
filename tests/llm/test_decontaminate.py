import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from strandwork.llm import decontaminate as S

DOCS, ITEMS = "doc_id bigint, text string, words string", "item_id bigint, text string"


def shingles(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(docs, items):
    """Every window of the item's size, not only those in line with a shingle."""
    out = {}
    for d, text in docs:
        w = (text or "").lower().split()
        for i, item in items:
            b = (item or "").lower().split()
            k = min(5, len(b))
            if d is None or i is None or not b or len(w) < k:
                continue
            want = shingles(b, k)
            for s in range(max(1, len(w) - len(b) + 1)):
                have = shingles(w[s : s + len(b)], k)
                similar = sum((have & want).values()) / sum((have | want).values())
                if similar >= 0.8:
                    out[d, i] = max(out.get((d, i), (0, 0)), (similar, -s))
    return sorted((d, i, -s, similar) for (d, i), (similar, s) in out.items())


def found(spark, docs, items):
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], DOCS)
    return sorted((r.doc_id, r.item_id, r.start_word, r.similarity) for r in S.leaks(frame, spark.createDataFrame(items, ITEMS)).collect())


def test_leaks_against_every_window(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    bench = [text(n) for n in (5, 7, 20, 45, 60, 90, 90)]
    items = [(i, " ".join(w)) for i, w in enumerate(bench)] + [(50, None), (51, "too few words"), (52, " ".join(["la"] * 30)), (None, " ".join(bench[3]))]
    docs = []
    for n, w in enumerate(bench * 4):
        changed = list(w)
        for _ in range(n // len(bench)):
            changed[rng.randrange(len(changed))] = "changed"
        docs.append((n, " ".join(text(30) + changed + text(n))))
    cut = bench[5]
    docs += [(100, " ".join(cut[:85])), (101, " ".join(cut[5:] + text(9))), (102, " ".join(text(9) + cut[:40] + ["new"] + cut[40:])), (103, None), (104, ""), (105, " ".join(bench[3]).upper().replace(" ", "\t\n")), (105, " ".join(bench[4])), (106, " ".join(["la"] * 200)), (None, " ".join(bench[2]))]
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    assert len(want) > 15


def test_fingerprints_within_the_radius_are_all_looked_up(spark):
    one = spark.range(1).select(S.simhash(F.array(F.lit(5).cast("bigint"), F.lit(7).cast("bigint"), F.lit(4).cast("bigint"))).alias("f")).first().f
    assert one == 5
    assert spark.range(1).select(S.simhash(F.array(F.lit(-1).cast("bigint"))).alias("f")).first().f == -1


def test_clean_documents_stay_and_empty_tables_work(spark):
    items = spark.createDataFrame([(1, "one two three four five six")], ITEMS)
    docs = spark.createDataFrame([(1, "x one two three four five six y", "a"), (2, "one two three four", "b"), (3, None, "c"), (None, "one two three four five six", "d")], DOCS)
    assert sorted(r.words for r in S.decontaminated(docs, items).collect()) == ["b", "c", "d"]
    assert S.leaks(docs.limit(0), items).count() == 0
    assert S.leaks(docs, items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.leaks(docs, items, similarity=0.5)


def test_a_large_index_is_joined_by_shuffle(spark, monkeypatch):
    items = spark.createDataFrame([(1, "one two three four five six")], ITEMS)
    docs = spark.createDataFrame([(1, "x one two three four five six y", "a")], DOCS)
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    assert [(r.start_word, r.differing_bits, r.similarity) for r in S.leaks(docs, items).collect()] == [(1, 0, 1.0)]


def test_passages_with_parts_moved_are_found(spark):
    item = [f"w{i}" for i in range(100)]
    docs = [(cut, " ".join([f"a{i}" for i in range(40)] + item[cut:] + item[:cut] + [f"z{i}" for i in range(40)])) for cut in (20, 30, 50)]
    want = brute(docs, [(1, " ".join(item))])
    assert [(d, s) for d, _, s, _ in want] == [(20, 40), (30, 40), (50, 40)]
    assert found(spark, docs, [(1, " ".join(item))]) == want


def test_short_items_are_found_word_for_word(spark):
    items = [(1, "Alpha beta"), (2, "one two three four"), (3, "solo"), (4, ""), (5, None), (6, "a b c d e f")]
    docs = [(1, "x alpha BETA y alpha beta"), (2, "one two three"), (3, "zero one two three four"), (4, "solo"), (5, "nothing"), (6, None), (7, "a b c d e f")]
    want = brute(docs, items)
    assert [(d, i, s) for d, i, s, _ in want] == [(1, 1, 1), (3, 2, 1), (4, 3, 0), (7, 6, 0)]
    assert found(spark, docs, items) == want


def test_an_item_meets_only_windows_that_hold_its_shingles(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, " ".join(f"i{i}w{rng.randrange(40)}" for _ in range(20))) for i in range(30)]
    docs = [(d, " ".join(["pre", "fix", *items[d % 30][1].split(), f"tail{d}"])) for d in range(60)]
    want = brute(docs, items)
    for bound in (200_000, 0):
        monkeypatch.setattr(S, "BROADCAST_ROWS", bound)
        assert found(spark, docs, items) == want


def test_columns_named_like_inner_ones_are_harmless(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six y", 1, 2), (2, "clean words only", 3, 4)], "doc_id bigint, text string, leaked int, row int")
    got = S.decontaminated(docs, spark.createDataFrame([(1, "one two three four five six")], ITEMS))
    assert got.columns == docs.columns and [r.doc_id for r in got.collect()] == [2]
