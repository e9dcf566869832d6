import random

import numpy as np
import xxhash
from strandwork.llm import substring_dedup as S

DOCS = "doc_id bigint, text string, row int"


def slow_cuts(data, gear):
    ends, last = [], 0
    for i in range(len(data)):
        h = 0
        for b in data[max(0, i - S.WINDOW + 1) : i + 1]:
            h = (h * 2 + int(gear[b])) & 0xFFFFFFFF
        if h >> (32 - S.BITS) == 0 and i + 1 - last >= S.LEAST or i + 1 - last == S.MOST:
            ends.append(i + 1)
            last = i + 1
    return ends if last == len(data) else [*ends, len(data)]


def test_cuts_follow_the_rolling_hash():
    rng, gear = random.Random(1), S.gear_numbers()
    for data in (b"", b"a", b"a" * 5000, bytes(rng.randrange(256) for _ in range(4000)), bytes(rng.choice(b"ab ") for _ in range(3000))):
        assert S.cuts(data, gear) == slow_cuts(data, gear)


def test_cuts_resist_insertions():
    rng, gear = random.Random(2), S.gear_numbers()
    data = bytes(rng.randrange(97, 123) for _ in range(20000))
    other = data[:777] + b"inserted" + data[777:]
    chunks = [{d[a:b] for a, b in zip([0, *S.cuts(d, gear)], S.cuts(d, gear))} for d in (data, other)]
    assert len(chunks[0] - chunks[1]) < 8


def brute(rows):
    gear, first, out = S.gear_numbers(), {}, []
    cut = []
    for _, t in rows:
        d = (t or "").encode()
        ends = S.cuts(d, gear)
        cut.append([(a, b, xxhash.xxh3_128_digest(d[a:b])) for a, b in zip([0, *ends], ends)])
    for n, chunks in enumerate(cut):
        for k, (*_, x) in enumerate(chunks):
            first.setdefault(x, (n, k))
    for n, ((doc_id, t), chunks) in enumerate(zip(rows, cut, strict=True)):
        spans = []
        for k, (a, b, x) in enumerate(chunks):
            if first[x] != (n, k):
                if spans and spans[-1][1] == a:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
        spans = [(a, b) for a, b in spans if b - a >= S.RUN]
        out.append((str(doc_id), len((t or "").encode()), sum(b - a for a, b in spans), spans))
    return sorted(out)


def test_repeats_against_brute_force(spark):
    rng = random.Random(6)

    def text(n):
        return " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randrange(2, 9))) for _ in range(n))

    a, p = text(300), text(60)
    rows = [(1, a), (2, text(40) + p + text(40)), (3, text(90) + p), (4, a), (4, a), (5, None), (6, ""), (7, p + " x " + p), (8, "z" * 9000), (None, a[:700] + text(9)), (9, text(100))]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], DOCS).coalesce(1)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, [tuple(s) for s in r.spans]) for r in S.repeats(docs).collect())
    assert got == brute(rows)
    by_id = {r[0]: r for r in got}
    assert by_id["3"][2] > 150 and by_id["9"][2] == 0 and by_id["2"][2] == 0
    assert S.repeats(docs.limit(0)).count() == 0


def test_long_texts_are_cut_as_in_one_block():
    gear = S.gear_numbers()
    data = np.random.default_rng(5).integers(0, 256, (1 << 20) + 5000, dtype=np.uint8)
    ends = S.cuts(data.tobytes(), gear)
    at = [e for e in ends if (1 << 20) - 3000 < e]
    h = S.gear_hashes(data, gear)
    assert ends[-1] == len(data) and all(h[e - 1] >> np.uint32(32 - S.BITS) == 0 for e in at[:-1])


def test_without():
    assert S.without(b"abcdefgh", [(1, 3), (5, 6)]) == b"adegh"


def test_runs_of_at_least_so_many_bytes(spark):
    rng = random.Random(6)
    shared, own = ("".join(rng.choice("abcdefgh") for _ in range(400)) for _ in range(2))
    docs = spark.createDataFrame([(1, shared, 0), (2, own[:200] + shared, 0)], DOCS).coalesce(1)
    whole = {r.doc_id: r.n_removed for r in S.repeats(docs).collect()}
    assert whole[1] == 0 and 200 < whole[2] <= 400
    assert all(r.n_removed == 0 for r in S.repeats(docs, run=1000).collect())
