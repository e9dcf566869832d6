"""Exact substring dedup by blockwise suffix sorting with the ranks of a difference cover.

Wanted is every byte covered by a `length`-byte string that starts anywhere else too, so suffixes are sorted to that
depth. They are dealt to tasks in buckets that equal strings cannot leave: the anchor of a string is the leftmost of its
32-byte grams with the least hash, the strings of one anchor start in a run before it, and a bucket holds the slices of
text around all anchors with one gram. Equal slices are put together before they are shuffled and counted; buckets of a
single anchor, most of a corpus, never leave the first, narrow pass.

Within a task, buckets are taken as many at a time as a bound on bytes allows. The positions of their text in a
difference cover modulo 3 are ranked by prefix doubling, in steps that stay in the cover, to two bytes less than
`length`. Then the suffixes are sorted one bucket of leading bytes at a time: by their first eight bytes, and long ties
by the ranks. Any two suffixes have a shift of at most two bytes at which both lie in the cover, whatever their residues,
so a pass for each shift compares those that it brings there, by the bytes before it, the rank and the bytes behind.
Neighbours that tie to the full depth are repeats, and so is every string of a slice that occurs twice.

A bucket with more than `most` distinct slices (a passage in very many contexts) outgrows a block. It is refined to
single strings, whose digests are counted, spread over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

LENGTH, GRAM = 400, 32
#: A difference cover: any two residues are both in it after one of the shifts below PERIOD.
PERIOD, COVER = 3, (0, 1)
#: Bytes of slices sorted at a time, suffixes in a bucket of leading bytes, and distinct slices that a block can hold.
BLOCK, BUCKET, MOST = 3 << 19, 1 << 18, 1 << 11
SEGMENT = 1 << 22


def _least_in_windows(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours: running minima of blocks from both ends."""
    n = len(key) - width + 1
    blocks = -(-len(key) // width) * width
    padded = np.full(blocks, np.iinfo(np.int64).max)
    padded[: len(key)] = key
    square = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): runs of starts of `length`-byte strings of data that have one anchor."""
    width = length - GRAM + 1
    parts = []
    numbers = np.random.default_rng(23).integers(0, 1 << 64, 256, dtype=np.uint64)
    for at in range(0, max(1, len(data) - length + 1), SEGMENT):
        piece = data[at : at + SEGMENT + length - 1]
        if len(piece) < length:
            break
        h = numbers[piece]
        step = 1
        while step < GRAM:
            h[step:] += h[:-step] << np.uint64(step)
            step *= 2
        h = h[GRAM - 1 :] * np.uint64(0x9E3779B97F4A7C15)
        key = (h >> np.uint64(40) << np.uint64(39)).astype(np.int64) | np.arange(len(h))
        at_least = (_least_in_windows(key, width) & ((1 << 39) - 1)) + at
        first = np.concatenate([[0], np.nonzero(np.diff(at_least))[0] + 1])
        parts.append((at_least[first], first + at, np.append(first[1:] - 1, len(at_least) - 1) + at))
    if not parts:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _words(text: np.ndarray) -> np.ndarray:
    """Eight bytes from every position as a number that sorts as they do."""
    return np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, sorted keys) of keys of so many bits; places ride along in the low bits if there is room."""
    place = max(1, len(key).bit_length())
    if bits + place > 64:
        order = np.argsort(key)
        return order, key[order]
    both = np.sort(key << np.uint64(place) | np.arange(len(key), dtype=np.uint64))
    return (both & np.uint64((1 << place) - 1)).astype(np.int64), both >> np.uint64(place)


def _firsts(key: np.ndarray) -> np.ndarray:
    """For each place of a sorted key, the first place of its run."""
    first = np.zeros(len(key), np.int64)
    new = np.nonzero(key[1:] != key[:-1])[0] + 1
    first[new] = new
    return np.maximum.accumulate(first)


def rank_cover(text: np.ndarray, depth: int) -> np.ndarray:
    """For every position of the cover, in order, its rank among all by the `depth` bytes from it on.

    A rank is the number of positions that come before all of that rank, so positions without a tie are settled and
    only the others are sorted again. text ends with 8 bytes more than a multiple of PERIOD; bytes behind its end count
    as less than any.
    """
    n = (len(text) - 8) // PERIOD * PERIOD
    words = _words(text)
    lead = np.stack([words[c:n:PERIOD] for c in COVER], axis=1).astype(np.uint64).ravel()
    order, key = _sorted(lead >> np.uint64(24), 40)
    rank = np.empty(len(lead) + 1, np.int64)
    rank[order], rank[-1] = _firsts(key) + 1, 0  # the last stands for what is behind the end
    tied = np.sort(order[_tied(key)])
    half, reach = len(rank).bit_length(), 5
    while reach < depth and len(tied):
        step = min(reach // PERIOD, -(-(depth - reach) // PERIOD))
        old = rank[tied]
        on = rank[np.minimum(tied + step * len(COVER), len(lead))]
        order, key = _sorted((old << half | on).astype(np.uint64), 2 * half)
        before = (key >> np.uint64(half)).astype(np.int64)
        rank[tied[order]] = before + _firsts(key) - _firsts(before)
        tied = np.sort(tied[order[_tied(key)]])
        reach += step * PERIOD
    return rank[:-1]


def _deepest(length: int) -> int:
    """The depth of ranks: what the initial five bytes and whole periods make of at most length - PERIOD + 1."""
    return 5 + (length - PERIOD + 1 - 5) // PERIOD * PERIOD


def repeated_starts(slices: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(slice number, start), sorted: the strings of `length` bytes of the slices that start in two places or more."""
    sizes = np.fromiter(map(len, slices), np.int64, len(slices))
    ends = np.cumsum(sizes)
    total = -(-int(ends[-1]) // PERIOD) * PERIOD
    text = np.zeros(total + length + 8, np.uint8)
    text[: ends[-1]] = np.frombuffer(b"".join(slices), np.uint8)
    deep = _deepest(length)
    rank = rank_cover(text[: total + 8], deep)
    number = np.full(PERIOD, -1)
    number[list(COVER)] = np.arange(len(COVER))
    counts = np.maximum(sizes - length + 1, 0)
    who = np.repeat(np.arange(len(slices)), counts)
    inside = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (ends - sizes)[who] + inside
    lead = _words(text)[at].astype(np.uint64)
    found = np.zeros(len(at), bool)
    buckets = max(1, len(at) // BUCKET)
    splitters = np.sort(lead[::64])[np.arange(1, buckets) * len(lead[::64]) // buckets]
    dealt = np.searchsorted(splitters, lead, "right").astype(np.uint16)
    for b in range(buckets):
        own = np.nonzero(dealt == b)[0]
        own = own[np.argsort(lead[own])]
        own = own[_tied(lead[own])]
        for shift in range(PERIOD):
            x = at[own] + shift
            covered = number[x % PERIOD]
            here, x, covered = own[covered >= 0], x[covered >= 0], covered[covered >= 0]
            found[here[_equal(text, at[here], shift, rank[x // PERIOD * len(COVER) + covered], deep, length)]] = True
    return who[found], inside[found]


def _tied(key: np.ndarray) -> np.ndarray:
    """Which of sorted keys equal a neighbour."""
    out = np.zeros(len(key), bool)
    same = key[1:] == key[:-1]
    out[1:] |= same
    out[:-1] |= same
    return out


def _equal(text: np.ndarray, at: np.ndarray, shift: int, rank: np.ndarray, deep: int, length: int) -> np.ndarray:
    """Which strings at `at` equal another: by the bytes before the shift, the rank there and the bytes behind."""
    key = np.zeros(len(at), np.uint64)
    wide, bits = np.uint64(int(rank.max(initial=0)).bit_length()), 8 * (length - deep)
    for k in range(shift):
        key = key << np.uint64(8) | text[at + k]
    key = key << wide | rank.astype(np.uint64)
    for k in range(shift + deep, length):
        key = key << np.uint64(8) | text[at + k]
    order, key = _sorted(key, bits + int(wide))
    same = np.zeros(len(at), bool)
    same[order] = _tied(key)
    return same


def _spans(number: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring starts: (slice number, first, last); none for no starts."""
    new = np.ones(len(start), bool)
    new[1:] = (number[1:] != number[:-1]) | (start[1:] != start[:-1] + 1)
    begin = np.nonzero(new)[0]
    end = np.append(begin[1:], len(start))[: len(begin)] - 1
    return number[begin], start[begin], start[end]


def _bytes(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def _digest(piece: bytes, anchor: int) -> bytes:
    """Of a slice and where its anchor lies."""
    return xxhash.xxh3_128_digest(piece + anchor.to_bytes(4, "little"))


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "anchor", "first", "last", "gram"]
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_buffer().to_pybytes() if data.is_valid else b""
                if len(data) < length:
                    continue
                p, lo, hi = anchors(np.frombuffer(data, np.uint8), length)
                grams = np.array([xxhash.xxh3_64_intdigest(data[a : a + GRAM]) for a in p.tolist()], np.uint64).view(np.int64)
                for x, column in zip((np.full(len(p), row), p.astype(np.int32), lo.astype(np.int32), hi.astype(np.int32), grams), out, strict=True):
                    x_type = np.int64 if x.dtype == np.int64 else np.int32
                    column.append(x.astype(x_type))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)

    return run


def _slice_rows(length: int, wide: bool):
    """Slices of candidate texts: narrow, one for each anchor; wide, with bytes, a slice's second time without them.

    What a task meets more often than twice says nothing new, so equal slices are put together before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bytes], int] = {}
        for batch in (b.slice(at, 256) for b in batches for at in range(0, len(b), 256)):
            out, size = [], 0
            for row, data, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = data.as_buffer().to_pybytes()
                for f in found:
                    piece = data[f["first"] : f["last"] + length]
                    d = _digest(piece, f["anchor"] - f["first"])
                    times = 0
                    if wide:
                        if len(seen) > 200_000:
                            seen.clear()
                        times = seen.get((f["gram"], d), 0)
                        seen[f["gram"], d] = times + 1
                        if times > 1:
                            continue
                    hi, lo = int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
                    out.append((f["gram"], hi, lo, None if times else piece) if wide else (row, f["first"], f["last"], f["gram"], hi, lo))
                    size += 40 if times or not wide else len(piece)
                if size > 4 << 20:
                    yield _batch(out, wide)
                    out, size = [], 0
            if out:
                yield _batch(out, wide)

    return run


def _batch(rows: list[tuple], wide: bool) -> pa.RecordBatch:
    if wide:
        kinds = (("gram", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("piece", pa.binary()))
    else:
        kinds = (("row", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("gram", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])


def _bucket_rows(length: int):
    """Rows sorted by gram and digest to the repeated starts of each distinct slice."""

    def sort(held: list[list]) -> pa.RecordBatch:
        """held: (gram, hi, lo, slice, how often it came: once or more) of whole buckets."""
        grams = np.array([h[0] for h in held])
        several = np.zeros(len(held), bool)
        several[1:] = grams[1:] == grams[:-1]
        several[:-1] |= several[1:]
        many = np.array([h[4] > 1 for h in held])
        met = np.nonzero(several)[0]
        number, start = repeated_starts([held[n][3] for n in met.tolist()], length) if len(met) else (met, met)
        number, a, b = _spans(met[number], start)
        # Every string of a slice that came twice is repeated, whatever the other slices hold.
        alone = ~many[number]
        twice = np.nonzero(many)[0]
        number = np.concatenate([number[alone], twice])
        a = np.concatenate([a[alone], np.zeros(len(twice), np.int64)])
        b = np.concatenate([b[alone], np.array([len(held[n][3]) - length for n in twice.tolist()], np.int64)])
        columns = [pa.array([held[n][k] for n in number.tolist()], pa.int64()) for k in range(3)]
        columns += [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["gram", "hi", "lo", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        size = 0
        for batch in batches:
            for gram, hi, lo, piece in zip(*[batch.column(k).to_pylist() for k in range(3)], _bytes(batch.column(3)), strict=True):
                if held and held[-1][:3] == [gram, hi, lo]:
                    held[-1][4] += 1
                    held[-1][3] = held[-1][3] or piece
                    continue
                if size > BLOCK and held[-1][0] != gram:
                    yield sort(held)
                    held, size = [], 0
                held.append([gram, hi, lo, piece, 1])
                size += len(piece)
        if held:
            yield sort(held)

    return run


def _string_rows(length: int):
    """Digests of all strings of slices (gram, hi, lo, piece); slices without bytes are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for gram, hi, lo, piece in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                n = len(piece) - length + 1
                d = np.frombuffer(b"".join([digest(piece[i : i + length]) for i in range(n)]), "<i8").reshape(-1, 2)
                columns = [pa.array(np.full(n, v)) for v in (gram, hi, lo)] + [pa.array(np.arange(n, dtype=np.int32)), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "hi", "lo", "a", "dh", "dl"])

    return run


def _kept_rows(length: int):
    """Texts and the runs of starts found in them (row, data, runs) to what is removed and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept = [], [], []
            for data, runs in zip(_bytes(batch.column(1)), batch.column(2), strict=True):
                first, last = (runs.values.field(k).to_numpy() for k in range(2))
                order = np.argsort(first, kind="stable")
                start, end = first[order].astype(np.int64), np.maximum.accumulate(last[order].astype(np.int64) + length)
                new = np.concatenate([[True], start[1:] > end[:-1]])
                start, end = start[new], end[np.append(new[1:], True)]
                digest, at = hashlib.sha256(), 0
                for a, b in zip(start.tolist(), end.tolist(), strict=True):
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                kept.append(digest.hexdigest())
                removed.append(int((end - start).sum()))
                spans.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], ["row", "n_removed", "spans", "kept_sha256"])

    return run


def repeated_strings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, most: int = MOST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), a row for each row of docs.

    Texts count as UTF-8 bytes, a null text as empty. Every byte covered by a string of `length` bytes that starts at
    another place too, in the same or another row, is removed; strings are judged on the input, so all copies go.
    spans: array<struct<start,end>> of the maximal runs removed, in bytes. Rows that repeat a doc_id are rows of their
    own; copies of a whole text all go. Very long texts are worked on in segments of 4 MB while anchors are looked for, and
    in slices after. Only the named columns are read; an empty table gives an empty result. docs is read three times and its rows
    are numbered as they come, so it must be a table or something else that comes in the same order each time; files are
    split alike each time, however many executors there are by then.
    """
    if length < GRAM + PERIOD:
        raise ValueError(f"length must be at least {GRAM + PERIOD}")
    with _split_alike(docs.sparkSession):
        rows, candidates = _read(docs, text, doc_id, length)
    return _repeats(rows, candidates, length, most)


@contextmanager
def _split_alike(spark: SparkSession) -> Iterator[None]:
    """Holds the least number of splits of files at what it is now; else it follows the cores, and executors come and go."""
    key, cores = "spark.sql.files.minPartitionNum", spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, cores or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(key)


def _read(docs: DataFrame, text: str, doc_id: str, length: int) -> tuple[DataFrame, DataFrame]:
    """All that is read of docs, staged: (row, doc_id, n_bytes, sha) and, of texts that share grams, (row, data, found)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), body.alias("data"))
    rows = numbered.select("row", "doc_id", F.length("data").cast("bigint").alias("n_bytes"), F.sha2("data", 256).alias("sha"))
    rows = staged(rows, "rows")

    found = staged(numbered.select("row", "data").mapInArrow(_anchor_rows(length), "row bigint, anchor int, first int, last int, gram bigint"), "anchors")
    # Staged, so that the join has plain shuffles on both sides, of which large partitions can be split.
    shared = staged(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("gram").alias("g")), "grams")
    held = found.join(shared, F.col("gram") == F.col("g"), "left_semi").groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("anchor", "first", "last", "gram")).alias("found"))
    return rows, staged(numbered.select("row", "data").join(held, F.col("row") == F.col("of")).select("row", "data", "found"), "candidates")


def _repeats(rows: DataFrame, candidates: DataFrame, length: int, most: int) -> DataFrame:
    narrow = staged(candidates.mapInArrow(_slice_rows(length, False), "row bigint, first int, last int, gram bigint, hi bigint, lo bigint"), "slices")
    wide = candidates.mapInArrow(_slice_rows(length, True), "gram bigint, hi bigint, lo bigint, piece binary")
    key = ["gram", "hi", "lo"]
    kinds = narrow.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first(F.col("last") - F.col("first")).alias("b"))
    crowd = staged(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("gram"), "crowded")
    crowded = crowd.count() > 0
    calm = wide.join(crowd, "gram", "left_anti") if crowded else wide
    ranges = calm.repartition("gram").sortWithinPartitions(*key).mapInArrow(_bucket_rows(length), "gram bigint, hi bigint, lo bigint, a int, b int")
    if crowded:
        strings = wide.where("piece is not null").join(crowd, "gram", "left_semi").dropDuplicates(key)
        strings = staged(strings.mapInArrow(_string_rows(length), "gram bigint, hi bigint, lo bigint, a int, dh bigint, dl bigint"), "strings")
        often = strings.groupBy("gram", "dh", "dl").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        again = kinds.where("n > 1").join(crowd, "gram", "left_semi").select(*key, F.lit(0).alias("a"), "b")
        ranges = ranges.union(strings.join(often, ["gram", "dh", "dl"], "left_semi").select(*key, "a", F.col("a").alias("b"))).union(again)
    some = narrow.join(ranges, key).select("row", (F.col("first") + F.col("a")).alias("first"), (F.col("first") + F.col("b")).alias("last"))
    runs = some.groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    cut = candidates.select("row", "data").join(runs, F.col("row") == F.col("of")).select("row", "data", "runs")
    cut = cut.mapInArrow(_kept_rows(length), "row bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept_sha256 string")
    cut = cut.select(F.col("row").alias("of"), "n_removed", "spans", "kept_sha256")
    out = rows.join(cut, F.col("row") == F.col("of"), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    out = out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), spans.alias("spans"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256", "spans")
