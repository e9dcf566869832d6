import numpy as np
from strandwork.llm import ann_forest as S

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, asked, k):
    out = []
    use = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    for i, v in use:
        if i in asked:
            best = sorted((-float(np.dot(np.float32(v).astype(float), np.float32(w).astype(float))), j) for j, w in use if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_vectors_that_take_part(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(30)] + [(200, None), (201, [0.0] * 4), (202, [1.0, None, 1.0, 1.0]), (203, [float("nan")] * 4), (204, [float("inf"), 0.0, 0.0, 0.0]), (205, []), (None, [1.0] * 4), (5, rows[5][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    asked = {0, 20, 100, 200, 201, 203}
    got = S.nearest(frame, frame.where(frame.vec_id.isin(*asked)), k=5, block_rows=25, budget=float(S.TREES)).collect()
    want = brute(rows, asked, 5)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [w[:3] for w in want]
    assert np.allclose([r.score for r in sorted(got)], [w[3] for w in want], atol=1e-12)


def test_fewer_candidates_than_k_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.5, 0.5], 0), (3, [-1.0, 0.0], 0)], VECTORS)
    got = S.nearest(frame, frame.where("vec_id = 1")).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 2, 0.5), (2, 3, -1.0)]
    empty = frame.limit(0)
    assert S.nearest(empty, empty).count() == 0
    assert S.nearest(frame, empty).count() == 0


def test_ranges_ascend_together_until_they_hold_enough():
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(500, 8))
    forest = S.Forest(vectors, S.hyperplanes(9, 6, 10), 6, 10)
    lifted = np.column_stack([vectors, np.sqrt((vectors**2).sum(axis=1).max() - (vectors**2).sum(axis=1))])
    rows, queries = forest._keys(lifted), vectors[:20]
    keys = forest._keys(np.column_stack([queries, np.zeros(20)]))
    for q, got in enumerate(forest.candidates(queries, 100)):
        for level in range(11):
            match = rows >> level == keys[q] >> level
            if match.sum() >= 100:
                break
        assert got.tolist() == np.nonzero(match.any(axis=1))[0].tolist()


def test_recall_on_the_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    want = {(q, v) for q, _, v, _ in brute(rows, {i for i, _ in rows if i % 20 == 0}, 20)}
    got = {(r.query_id, r.vec_id) for r in S.nearest(frame, frame.where("vec_id % 20 = 0")).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_recall_of_the_forest_beyond_its_least_ranges(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 32))
    clustered = centres[rng.integers(0, 60, 3000)] + 0.5 * rng.normal(size=(3000, 32))
    for vectors, budget, least in ((rng.normal(size=(3000, 32)), S.BUDGET, 0.9), (clustered, 0.2, 0.9)):
        forest = S.Forest(vectors, S.hyperplanes(33))
        hits = scored = 0
        for q, found in enumerate(forest.candidates(vectors[:100], int(budget * 3000))):
            scores = vectors @ vectors[q]
            scores[q] = -np.inf
            best = np.argsort(-scores)[:20]
            hits += len(np.intersect1d(best, found))
            scored += len(found)
        assert hits >= least * 100 * 20
        assert scored < (0.7 if budget == S.BUDGET else 0.25) * 100 * 3000, scored
