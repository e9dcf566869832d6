from itertools import combinations

import numpy as np
import xxhash
from strandwork.llm import simhash as S

DOCS = "doc_id bigint, text string"


def brute(text):
    words = (text or "").encode().translate(S.LOWER).split()
    if not words:
        return 0
    k = min(4, len(words))
    values = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def components(rows):
    fp = [brute(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= 4:
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    least = {x: min(rows[i][0] for i in range(len(rows)) if label[i] == x) for x in set(label)}
    return sorted((rows[i][0], f"{fp[i]:016x}", least[label[i]]) for i in range(len(rows)))


def test_triples_cover_any_four_positions():
    triples = S.position_triples()
    assert len(triples) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_lists_agree_with_all_pairs_dense_or_not():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 30, 3), dtype=np.uint64)
    fps = np.unique(np.concatenate([base, (base[:, None] ^ flips[..., 0] ^ flips[..., 1] ^ flips[..., 2]).ravel()]))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    want = S._forest(*np.nonzero(near), len(fps))
    assert (S._forest(*S._dense_links(fps), len(fps)) == want).all()
    assert (S._forest(*S._small_links(fps, 4), len(fps)) == want).all()


def test_near_duplicates_against_brute_force(spark):
    words = [f"w{i * i % 977}" for i in range(400)]
    long = " ".join(words)
    rows = [(5, long), (3, long.upper()), (9, long + " tail"), (7, " ".join(words[:200])), (1, None), (2, ""), (4, "one two"), (8, "One\tTWO"), (6, "  "), (11, "é ß ünï"), (11, "é ß ünï"), (12, long.replace("w4 ", "x "))]
    docs = spark.createDataFrame([(a, b, 0, "x", 1) for a, b in rows], DOCS + ", fp int, label string, component_id int")
    got = sorted(tuple(r) for r in S.near_duplicates(docs).collect())
    assert got == components(rows)


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], DOCS)
    assert S.near_duplicates(empty).count() == 0
    got = S.near_duplicates(spark.createDataFrame([(None, "a b"), (4, "a b"), (None, "c d")], DOCS)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("4", "4"), ("None", "4"), ("None", "None")]


def test_on_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in S.near_duplicates(docs).collect())
    assert got == components([(r.doc_id, r.text) for r in docs.collect()])


def test_shared_bytes_are_counted():
    x = np.array([0, 1, 0x0100, 0xFF00FF00FF00FF00, 0x8040201008040201, 1 << 63], np.uint64)
    assert S._shared_bytes(x).tolist() == [8, 7, 7, 4, 0, 7]
