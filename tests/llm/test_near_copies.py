import random

import numpy as np
from strandwork.llm import simhash

DOCS = "doc_id bigint, text string"


def survivors(rows):
    """The first document of each group that similarities of 0.8 of distinct five-word shingles make, by all pairs."""
    sets = {i: set(simhash._hashes(t, 5).tolist()) for i, t in rows}
    least = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((least[i], least[j]))
                least = {k: a if v == b else v for k, v in least.items()}
    return {i for i in sets if least[i] == i}


def kept(spark, rows):
    return {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, DOCS)).collect()}


def test_equal_fingerprints_of_unlike_texts_are_no_copies(spark):
    line = " ".join(f"line{i}" for i in range(11))
    rows = [(d, " ".join([line] * 100 + [f"own{d}x{i}" for i in range(60)])) for d in range(2)]
    assert (simhash.fingerprint(rows[0][1], 5) ^ simhash.fingerprint(rows[1][1], 5)).bit_count() <= 4
    assert kept(spark, rows) == survivors(rows) == {0, 1}


def blocks_replaced(rng, base, length, texts):
    """Texts of one base, each with a block of so many words replaced somewhere."""
    out = []
    for _ in range(texts):
        at = rng.randrange(len(base) - length)
        out.append(base[:at] + [f"n{rng.random()}" for _ in range(length)] + base[at + length :])
    return out


def test_appended_and_replaced_blocks_are_all_met(spark):
    rng = random.Random(3)
    rows = []
    for n in range(150):
        base = [f"b{n}w{i}" for i in range(300)]
        other = base + [f"a{n}x{i}" for i in range(73)] if n % 2 else blocks_replaced(rng, base, 28, 1)[0]
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(other))]
    want = survivors(rows)
    assert len(want) == 150
    assert kept(spark, rows) == want


def test_large_groups_of_variants_lose_no_link(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = [(n, " ".join(w)) for n, w in enumerate(blocks_replaced(rng, base, 30, 60))]
    assert kept(spark, rows) == survivors(rows)


def test_links_of_later_members_count(spark):
    base = [f"w{i}" for i in range(300)]
    second = base[25:] + [f"x{i}" for i in range(25)]
    rows = [(0, " ".join(base)), (1, " ".join(second)), (2, " ".join(second[25:] + [f"y{i}" for i in range(25)]))]
    assert kept(spark, rows) == survivors(rows) == {0}


def test_forest_links_join_what_all_pairs_join():
    rng = np.random.default_rng(1)
    for _ in range(30):
        base = np.arange(40)
        sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(30, 40)], rng.integers(100, 130, rng.integers(0, 6))])) for _ in range(30)]
        parts = rng.integers(0, 25, 30)
        a, b = simhash.forest_links(sets, parts, 0.8)
        every = [(i, j) for i in range(30) for j in range(i) if parts[i] == parts[j]]
        near = [(i, j) for i in range(30) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
        assert {(max(p), min(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} <= set(near)
        labels = [simhash._forest(*np.array(e).reshape(-1, 2).T, 30) for e in (every + near, every + list(zip(a.tolist(), b.tolist(), strict=True)))]
        assert (labels[0] == labels[1]).all()


def test_positional_bytes_guarantee_a_minimum():
    rng = np.random.default_rng(4)
    for n in (1, 5, 90, 300, 2000):
        for _ in range(20):
            x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            drop = rng.integers(0, n // 9 + 1)
            y = np.unique(np.concatenate([x[drop:], rng.integers(0, 1 << 64, drop, dtype=np.uint64)]))
            p, q = simhash.positional_bytes(x), simhash.positional_bytes(y)
            width = min(len(p), len(q))
            agree = (simhash._folded(p, width) == simhash._folded(q, width)).sum()
            assert agree >= width - len(np.setxor1d(x, y))
            if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)):
                assert agree >= simhash._guaranteed(width, len(x), len(y), 0.8)


def test_tallies_pass_over_no_similar_pair():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(340, 400)], rng.integers(0, 1 << 64, rng.integers(0, 40), dtype=np.uint64)])) for _ in range(60)]
    sets += [np.unique(np.concatenate([base, rng.integers(0, 1 << 64, 1600 + k, dtype=np.uint64)])) for k in range(5)]
    sizes, parts = np.array([len(x) for x in sets]), np.arange(len(sets))
    a, b = simhash.tallied_pairs([simhash.positional_bytes(x) for x in sets], sizes, parts, 0.8)
    got = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    near = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert near <= got and len(near) > 20


def test_blocks_of_long_lists_lose_no_link(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = [(n, " ".join(w)) for n, w in enumerate(blocks_replaced(rng, base, 30, 60))]
    monkeypatch.setattr(simhash, "MEMBERS", 7)
    monkeypatch.setattr(simhash, "EACH", 1)
    assert kept(spark, rows) == survivors(rows)


def test_tallies_stop_beyond_the_most(spark):
    sets = [np.arange(100, dtype=np.uint64) << np.uint64(50)] * 40
    prints, sizes, parts = [simhash.positional_bytes(x) for x in sets], np.full(40, 100), np.arange(40)
    assert len(simhash.tallied_pairs(prints, sizes, parts, 0.8)[0]) == 780
    assert 50 < len(simhash.tallied_pairs(prints, sizes, parts, 0.8, most=50)[0]) < 780


def test_long_lists_of_several_groups_lose_no_link(spark):
    rng = random.Random(11)
    shared, rows = [f"s{i}" for i in range(60)], []
    for g in range(6):
        base = shared + [f"g{g}w{i}" for i in range(140)]
        rows += [(len(rows) + n, " ".join(w)) for n, w in enumerate(blocks_replaced(rng, base, 14, 12))]
    assert kept(spark, rows) == survivors(rows)


def test_sifting_loses_no_row_and_passes_few_others(spark, monkeypatch):
    marks = spark.range(20000).selectExpr("id", "xxhash64(id) AS mark", "string(id) AS t")
    marks = marks.union(spark.sql("SELECT id, id - 70 AS mark, string(id) FROM range(140)"))  # marks below zero, every bit of a word
    asked = marks.where("id % 40 = 0").selectExpr("id AS of", "mark AS marked")
    wanted = {(r["of"], r["marked"]) for r in asked.collect()}
    found = [(r["id"], r["mark"]) for r in simhash._sifted(marks, asked).select("id", "mark").collect()]
    assert wanted <= set(found) and len(found) == len(set(found)) < 2 * len(wanted)
    monkeypatch.setattr(simhash, "BITS", 64)  # a map that is full lets all rows pass
    assert simhash._sifted(marks, asked).count() == marks.count()
    assert simhash._sifted(marks, asked.limit(0)).count() == 0
