"""SimHash near-duplicates: byte-position inverted index, count filtering, exact verification.

Two 64-bit fingerprints that differ in at most four bits differ in at most four of their eight bytes, so at least four
positional bytes are shared. The inverted index posts every distinct fingerprint under byte positions and their values;
since lists of single bytes hold a 256th of all rows each, postings are taken at triples of positions, chosen so that
any four shared positions contain a posted triple (20 of the 56 triples do). Lists then stay short as the corpus grows.
Within a list the shared positional bytes of each pair are tallied, pairs below four are passed over, and the rest are
verified by their differing bits. A list gives out a spanning forest of its links, not its pairs.

`near_duplicates` reports these components. `deduplicated` wants all near copies by shingle similarity, and few differing
bits of a fingerprint do not make two texts similar, nor many make them unlike. There the positional bytes are those of
the set of shingles: its hashes are dealt to as many parts as a power of two up to its size, and each part gives a byte.
Sets that differ in d shingles differ in d bytes at most, so the similarity wanted guarantees a minimum of shared bytes;
the tally is held against it before the exact share of common shingles verifies a pair. Lists are those of single
shingles instead of bytes: in one order of all shingles, two sets of similarity s share one among the first
n - ceil(s n) + 1 of each, so lists of those hold every pair wanted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, released, staged, unused

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SHINGLE, SEED, RADIUS, SHARED = 4, 42, 4, 4
#: From this many fingerprints on, a list is linked by shared two-bit neighbours instead of by comparing its pairs.
DENSE = 2048


def _hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included; of the whole sequence if it is shorter."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths) - 1
    k = min(words, len(found))
    hash64 = xxhash.xxh64_intdigest
    spans = zip((ends - lengths + 1)[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.array([hash64(joined[a:b], SEED) for a, b in spans], np.uint64)


def _majority(values: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):
        block = values[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text; null and wordless texts give 0."""
    return _majority(_hashes(text, words))


def set_digest(values: np.ndarray) -> int:
    """A signed digest of a sorted set of shingles; equal sets have equal digests."""
    return int(np.uint64(xxhash.xxh64_intdigest(values.tobytes(), SEED)).astype(np.int64))


def position_triples() -> list[tuple[int, int, int]]:
    """Byte triples such that any four of the eight positions contain one: Turan's construction over three groups."""
    group = {p: p % 3 for p in range(8)}

    def posted(t: tuple[int, ...]) -> bool:
        of = sorted(group[p] for p in t)
        return len(set(of)) == 1 or any(of.count(g) == 2 and (g + 1) % 3 in of for g in range(3))

    return [t for t in combinations(range(8), 3) if posted(t)]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the eight positional bytes of each xor are zero."""
    x = x | x >> np.uint64(4)
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return 8 - _popcount(x & np.uint64(0x0101010101010101))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n nodes reaches over links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _small_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within radius: shared bytes are tallied for all pairs, and pairs that have enough are verified."""
    left, right = [], []
    step = max(1, (1 << 20) // max(1, len(fps)))
    for at in range(0, len(fps), step):
        x = fps[at : at + step, None] ^ fps[None, at:]
        i, j = np.nonzero(np.triu(_shared_bytes(x) >= SHARED, 1))
        near = _popcount(x[i, j]) <= radius
        left.append(i[near] + at)
        right.append(j[near] + at)
    return np.concatenate(left), np.concatenate(right)


def _dense_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what lies within four bits: both of such a pair have a neighbour at two bits in common.

    All who share a neighbour lie within four bits of one another, so a star over each neighbour loses no component.
    Neighbours are taken slice by slice, by their value at a few of the bits in which the list differs, so memory is
    bounded and work is in proportion to the list.
    """
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    masks = np.concatenate([[np.uint64(0)], one, one[i] | one[j]])
    differ = np.bitwise_or.reduce(fps ^ fps[0])
    masks = masks[(masks & ~differ) == 0]
    open_bits = [b for b in range(64) if int(differ) >> b & 1][: max(0, (len(fps) * len(masks) >> 22).bit_length())]

    def at_bits(x: np.ndarray) -> np.ndarray:
        return sum(((x >> np.uint64(b) & np.uint64(1)).astype(np.int64) << n for n, b in enumerate(open_bits)), np.zeros(len(x), np.int64))

    own, flipped = at_bits(fps), at_bits(masks)
    order = np.argsort(own, kind="stable")
    bounds = np.searchsorted(own[order], np.arange((1 << len(open_bits)) + 1))
    kinds = {int(v): masks[flipped == v] for v in np.unique(flipped)}
    left, right = [], []
    for s in range(1 << len(open_bits)):
        found, at = [], []
        for v, some in kinds.items():
            who = order[bounds[s ^ v] : bounds[(s ^ v) + 1]]
            found.append((fps[who][:, None] ^ some[None, :]).ravel())
            at.append(np.repeat(who, len(some)))
        z, who = np.concatenate(found), np.concatenate(at)
        by = np.argsort(z, kind="stable")
        z, who = z[by], who[by]
        same = z[1:] == z[:-1]
        left.append(who[:-1][same])
        right.append(who[1:][same])
    return np.concatenate(left), np.concatenate(right)


def list_links(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint it reaches) for those of one list that have links."""
    fps = np.unique(fps)
    a, b = _dense_links(fps) if len(fps) > DENSE and radius == 4 else _small_links(fps, radius)
    label = _forest(a, b, len(fps))
    moved = np.nonzero(label != np.arange(len(fps)))[0]
    return fps[moved], fps[label[moved]]


def _lists(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key; a list that runs over the end of a batch is carried to the next."""

    def emit(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in chain(batches, (None,)):
        if batch is not None:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            whole = np.searchsorted(keys, keys[-1]) if len(keys) else 0
        else:
            whole = len(keys)
        k, f = keys[:whole], fps[:whole]
        keys, fps = keys[whole:], fps[whole:]
        if not len(k):
            continue
        starts = np.concatenate([[0], np.nonzero(k[1:] != k[:-1])[0] + 1])
        sizes = np.diff(np.concatenate([starts, [len(k)]]))
        for gap in range(1, 9):  # short lists all at once, by the distance of their members
            at = np.nonzero((k[gap:] == k[:-gap]) & (np.repeat(sizes, sizes)[gap:] <= 9))[0]
            if not len(at):
                continue
            x = f[at] ^ f[at + gap]
            enough = _shared_bytes(x) >= SHARED
            at, x = at[enough], x[enough]
            near = _popcount(x) <= radius
            if near.any():
                yield emit(f[at[near]], f[at[near] + gap])
        for s, n in zip(starts[sizes > 9], sizes[sizes > 9], strict=True):
            a, b = list_links(f[s : s + n], radius)
            if len(a):
                yield emit(a, b)


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links that span the components of the distinct fingerprints in column fp (bigint) within radius bits."""
    if not 0 <= radius <= 4:
        raise ValueError("the index guarantees its candidates for a radius of 0 to 4")
    triples = position_triples()

    def key(at: int, t: tuple[int, int, int]):
        value = F.lit(at << 24).cast("bigint")
        for n, p in enumerate(t):
            value = value.bitwiseOR(F.shiftleft(F.shiftright("fp", 8 * p).bitwiseAND(255), 8 * n))
        return value

    posted = fps.select(F.explode(F.array(*(key(i, t) for i, t in enumerate(triples)))).alias("key"), "fp")
    return posted.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _lists(it, radius), "a bigint, b bigint")


def _fingerprint_column(text: str) -> Column:
    @F.pandas_udf("bigint")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return simhash(F.col(text).cast("string"))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp) with fp as a signed bigint, for every row."""
    return docs.select(F.col(doc_id).alias("doc_id"), _fingerprint_column(text).alias("fp"))


def _labels(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, label) of the distinct fingerprints in column fp; label is the smallest fingerprint of the component."""
    parts = connected_components(near_links(fps, radius))
    return fps.join(parts, fps.fp == parts.node, "left").select("fp", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    A null text counts as empty; texts without words have the fingerprint zero and are linked like any other. Repeated
    rows keep a row each. component_id is the smallest non-null doc_id of the component (null where it has none). Other
    columns of docs are not read, so their names cannot clash. An empty table gives an empty result.
    """
    own = staged(fingerprints(docs, text, doc_id), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    labels = distinct.join(_labels(distinct.select("fp"), radius), "fp")
    least = labels.groupBy("label").agg(F.min("first").alias("component_id"))
    named = labels.join(least, "label").select(F.col("fp").alias("of"), "component_id")
    return own.join(named, F.col("fp") == F.col("of")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Members of a list up to which its pairs are taken at once; members of a block of a longer list; pairs that a block may
#: give for each member before it is compared by sets.
FEW, MEMBERS, EACH = 16, 4096, 16
#: Rounds in which each document is compared with one partner only, before all pairs of documents still apart are.
ROUNDS = 2
#: About so many rows are read for the common shingles; those in over so many of them count as common, so many at most.
SAMPLE, OFTEN, COMMON = 5000, 4, 50_000
#: Positional bytes of a set: as many as a power of two up to its shingles, and so many at least.
LEAST_BYTES = 128
#: Bits of the map by which rows are sifted before their texts are sent: at most BITS / 64 rows are broadcast.
BITS = 1 << 24


def _common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of shingles that many rows (mark, t) hold. They only set the order of shingles, so any choice is right."""

    @F.pandas_udf("array<bigint>")
    def distinct_shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(_hashes(t, words)).view(np.int64) for t in texts])

    every = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod("mark", F.lit(every)) == 0)
    often = some.select(F.explode(distinct_shingles("t")).alias("s")).groupBy("s").count().where(F.col("count") > OFTEN)
    top = often.orderBy(F.desc("count"), "s").limit(COMMON).toPandas()
    return np.sort(top["s"].to_numpy(np.int64).view(np.uint64))


def _prefix_length(n: int, similarity: float) -> int:
    """How many first shingles of a set of n hold one of every set that similar; all but the least number to share, and one."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _prefix(values: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a sorted set in the order that puts common ones last, as far as they have to be posted."""
    late = np.isin(values, common, assume_unique=True)
    return np.concatenate([values[~late], values[late]])[: _prefix_length(len(values), similarity)]


def positional_bytes(values: np.ndarray) -> np.ndarray:
    """A byte for each part of the hashes, set by the shingles of that part; sets that differ in d shingles differ in d bytes at most."""
    bits = max(LEAST_BYTES.bit_length() - 1, (len(values) // 2).bit_length())
    part = (values >> np.uint64(64 - bits)).astype(np.int64)
    value = (values & np.uint64(255)).astype(np.float64)
    return (np.bincount(part, value, 1 << bits).astype(np.int64) & 255).astype(np.uint8)


def _folded(x: np.ndarray, width: int) -> np.ndarray:
    """Positional bytes (the last axis) as they are for `width` parts."""
    return x.reshape(*x.shape[:-1], width, -1).sum(axis=-1, dtype=np.uint8)


def _guaranteed(width: int, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """The least number of shared bytes of `width` that similar sets of x and y shingles have."""
    return width - np.floor((x + y) * ((1 - similarity) / (1 + similarity)) + 1e-9)


def _runs(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[list[np.ndarray]]:
    """The columns of whole lists, from batches sorted by the key in the first columns; a list may run over batches."""
    held: list[np.ndarray] | None = None
    for batch in chain(batches, (None,)):
        if batch is None:
            if held is not None and len(held[0]):
                yield held
            return
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        last = np.logical_and.reduce([c == c[-1] for c in held[:keys]]) if len(held[0]) else np.empty(0, bool)
        whole = len(last) - int(last.sum())
        if whole:
            yield [c[:whole] for c in held]
            held = [c[whole:] for c in held]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start, and the end."""
    new = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.concatenate([[0], np.nonzero(new)[0] + 1, [len(keys[0])]])


def _met(nodes: DataFrame) -> DataFrame:
    """(key, a, b): pairs of the lists of nodes (node, prefix), and members (b null) of lists of over FEW."""
    posted = nodes.select(F.explode("prefix").alias("key"), "node")
    return posted.repartition("key").sortWithinPartitions("key").mapInArrow(_short_lists, "key bigint, a bigint, b bigint")


def _short_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs (without key) of lists of two to FEW; the members of longer ones, without a partner."""
    for keys, labels in _runs(batches):
        sizes = np.diff(_starts(keys))
        size = np.repeat(sizes, sizes)
        pairs = []
        for gap in range(1, FEW):
            at = np.nonzero((keys[gap:] == keys[:-gap]) & (size[gap:] <= FEW))[0]
            pairs.append(np.stack([np.minimum(labels[at], labels[at + gap]), np.maximum(labels[at], labels[at + gap])]))
        a, b = np.unique(np.concatenate(pairs, axis=1), axis=1)
        long = size > FEW
        n, m = int(long.sum()), len(a)
        none = np.zeros(max(n, m), np.int64)
        columns = [pa.array(np.concatenate([keys[long], none[:m]]), mask=np.arange(n + m) >= n), pa.array(np.concatenate([labels[long], a]))]
        columns.append(pa.array(np.concatenate([none[:n], b]), mask=np.arange(n + m) < n))
        if n + m:
            yield pa.RecordBatch.from_arrays(columns, ["key", "a", "b"])


def _similar(shared: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of x and y shingles that share so many are similar enough; empty sets are alike."""
    return shared / np.maximum(x + y - shared, 1) >= np.where(x + y > 0, similarity, 0)


def forest_links(sets: list[np.ndarray], parts: np.ndarray, similarity: float, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of similar sets that join, together with the parts given, all that similar pairs of these sets join.

    A set is compared with all those of other parts that have not been looked at before, so no similar pair is passed
    over but one whose ends are joined already. sides: only pairs of different sides are wanted.
    """
    sizes = np.array([len(x) for x in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, part = sizes[order], np.unique(parts[order], return_inverse=True)[1]
    side = np.arange(len(sets)) if sides is None else sides[order]
    values, tokens = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    held = np.zeros(len(values) + 1, np.int64)
    left, right = [], []
    for i in range(len(sets) - 1):
        # Sets come by size: those over a size's share are no partners.
        end = int(np.searchsorted(sizes, sizes[i] / similarity + 1e-6, "right"))
        if end <= i + 1 or (part[i + 1 : end] == part[i]).all():
            continue
        own = tokens[starts[i] : starts[i + 1]]
        held[own] = 1
        sums = np.concatenate([[0], np.cumsum(held[tokens[starts[i + 1] : starts[end]]])])
        held[own] = 0
        shared = np.diff(sums[starts[i + 1 : end + 1] - starts[i + 1]])
        for j in np.nonzero(_similar(shared, sizes[i + 1 : end], sizes[i], similarity) & (side[i + 1 : end] != side[i]))[0] + i + 1:
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
                left.append(order[i])
                right.append(order[j])
    return np.array(left, np.int64), np.array(right, np.int64)


def tallied_pairs(
    prints: list[np.ndarray], sizes: np.ndarray, parts: np.ndarray, similarity: float, sides: np.ndarray | None = None, most: float = math.inf
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of different parts whose positional bytes agree as often as similar sets guarantee.

    Beyond `most` pairs no more are looked for: a caller that gets over `most` has to compare the sets whole.
    """
    order = np.argsort(sizes, kind="stable")
    size, part = sizes[order], parts[order]
    side = np.arange(len(order)) if sides is None else sides[order]
    widths = np.array([len(prints[i]) for i in order])
    left, right, found = [], [], 0
    for width in np.unique(widths):
        own = np.nonzero(widths == width)[0]
        # Similar sets are within a factor of two, so partners have as many bytes or twice as many.
        others = np.nonzero((widths == width) | (widths == 2 * width))[0]
        table = np.stack([_folded(prints[order[j]], width) for j in others])
        for i in own:
            if found > most:
                break
            low = int(np.searchsorted(others, i + 1))
            high = int(np.searchsorted(size[others], size[i] / similarity + 1e-6, "right"))
            js = others[low:high]
            js = js[(part[js] != part[i]) & (side[js] != side[i])]
            if len(js):
                tally = (table[np.searchsorted(others, js)] == prints[order[i]]).sum(axis=1)
                js = js[tally >= _guaranteed(width, size[i], size[js], similarity)]
                left.append(np.full(len(js), order[i]))
                right.append(order[js])
                found += len(js)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _blocks(lists: DataFrame) -> DataFrame:
    """lists (key, node, ...) with x, y and side: a list of over MEMBERS is cut into blocks, and every two blocks meet once.

    (key, x, y) is what a task takes at a time. Where x and y differ, only pairs of different sides are wanted.
    """
    counts = lists.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks")).where("blocks > 1").withColumnRenamed("key", "of")
    dealt = lists.join(counts, F.col("key") == F.col("of"), "left").drop("of").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    both = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return both.withColumns({"x": F.least("side", "other"), "y": F.greatest("side", "other")}).drop("other", "blocks")


def _in_blocks(lists: DataFrame, columns: tuple[str, ...], run, schema: str) -> DataFrame:
    keys = ["key", "x", "y"]
    return lists.select(*keys, "side", "node", "part", *columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _sides(x: np.ndarray, y: np.ndarray, side: np.ndarray) -> np.ndarray | None:
    return None if x[0] == y[0] else side


def _forests(similarity: float):
    """Links of whole blocks (key, x, y, side, node, part, set as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, x, y, side, nodes, parts, sets in _runs(batches, 3):
            bounds = _starts(keys, x, y).tolist()
            for at, end in zip(bounds[:-1], bounds[1:], strict=True):
                own = slice(at, end)
                i, j = forest_links([np.frombuffer(t, np.int64) for t in sets[own]], parts[own], similarity, _sides(x[own], y[own], side[own]))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[own][i]), pa.array(nodes[own][j])], ["a", "b"])

    return run


def _long_links(long: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) similar members that join what similar pairs of each list (key, node, part) join, parts being joined."""
    rows = staged(_blocks(long), "blocks").join(sets, "node")
    return _in_blocks(rows, ("t",), _forests(similarity), "a bigint, b bigint").distinct()


def _tallies(similarity: float):
    """Pairs of whole blocks (key, x, y, side, node, part, n, bytes) with the size of the block, or the key alone where there are too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, x, y, side, nodes, parts, sizes, prints in _runs(batches, 3):
            bounds = _starts(keys, x, y).tolist()
            for at, end in zip(bounds[:-1], bounds[1:], strict=True):
                own = slice(at, end)
                i, j = tallied_pairs([np.frombuffer(t, np.uint8) for t in prints[own]], sizes[own], parts[own], similarity, _sides(x[own], y[own], side[own]), EACH * (end - at))
                if len(i) > EACH * (end - at):
                    yield pa.RecordBatch.from_arrays([pa.array([keys[at]]), pa.array([end - at]), *[pa.array([None], pa.int64())] * 2], ["key", "size", "a", "b"])
                elif len(i):
                    a, b = nodes[own][i], nodes[own][j]
                    columns = [np.full(len(i), keys[at]), np.full(len(i), end - at), np.minimum(a, b), np.maximum(a, b)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "size", "a", "b"])

    return run


def _reaching(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose positional bytes agree as often as similar sets guarantee."""

    @F.pandas_udf("boolean")
    def enough(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        out = []
        for p, q, k, j in zip(x, y, n, m, strict=True):
            p, q = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
            width = min(len(p), len(q))
            out.append(bool((_folded(p, width) == _folded(q, width)).sum() >= _guaranteed(width, k, j, similarity)))
        return pd.Series(out, dtype=bool)

    # Sizes first: most pairs that meet by chance are of unlike sizes, and bytes are not sent for those.
    for c in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}")), c)
    pairs = staged(pairs.where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6), "sized")
    left, right = (nodes.select(F.col("node").alias(c), F.col("bytes").alias(f"bytes_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").where(enough("bytes_a", "bytes_b", "n_a", "n_b")).select("a", "b")


def _hub_links(similarity: float):
    """Links of hubs (a, node, set as bytes), each with its own set and those of its partners, sorted by hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hubs, nodes, sets in _runs(batches):
            bounds = _starts(hubs).tolist()
            for at, end in zip(bounds[:-1], bounds[1:], strict=True):
                own, near = {n: np.frombuffer(t, np.uint64) for n, t in zip(nodes[at:end].tolist(), sets[at:end], strict=True)}, []
                hub = own.pop(int(hubs[at]))
                for node, x in own.items():
                    shared = np.intp(len(np.intersect1d(hub, x, assume_unique=True)))
                    if _similar(shared, len(hub), len(x), similarity):
                        near.append(node)
                if near:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), hubs[at])), pa.array(near, pa.int64())], ["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets share enough shingles; the set of an `a` travels once for all its partners."""
    sent = staged(pairs.select("a", F.col("b").alias("node")).union(pairs.select("a", "a").distinct()), "sent")
    met = sent.join(sets, "node").select("a", "node", "t")
    return met.repartition("a").sortWithinPartitions("a").mapInArrow(_hub_links(similarity), "a bigint, b bigint")


def _sifted(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of docs (mark, ...) whose mark may be one of asked (marked): every one that is, and few others.

    Marks are looked up in a map of BITS bits, at most BITS / 64 rows however many are asked, so it may be broadcast. Where
    it fills up more rows pass, in the end all.
    """

    def word(mark: Column) -> Column:
        return F.call_function("shiftright", F.pmod(mark, F.lit(BITS)), F.lit(6))

    def bit(mark: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(mark, F.lit(64)).cast("int"))

    marked = F.col("marked")
    bits = asked.groupBy(word(marked).alias("word")).agg(F.bit_or(bit(marked)).alias("bits"))
    met = docs.withColumn("word", word(F.col("mark"))).join(F.broadcast(bits), "word")
    return met.where(F.col("bits").bitwiseAND(bit(F.col("mark"))) != 0).drop("word", "bits")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int, repeated: bool) -> DataFrame:
    """(node, t): sorted shingles, as bytes, of the nodes (node, place) that are wanted; docs: (id, mark, t), with repeated rows or without."""

    @F.pandas_udf("binary")
    def shingle_bytes(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(_hashes(t, words)).tobytes() for t in texts])

    # Staged, here as elsewhere, so that a small table is known to be small and the large one need not be shuffled.
    asked = staged(nodes.join(wanted, "node", "left_semi").select("node", F.col("place.id").alias("of"), F.col("place.mark").alias("marked")), "asked")
    rows = _sifted(docs, asked).join(asked, F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("marked")))
    found = rows.select("node", shingle_bytes("t").alias("t"))
    found = staged(found.dropDuplicates(["node"]) if repeated else found, "shingles")
    released(docs.sparkSession, asked)
    return found


def _apart(nodes: DataFrame, pairs: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, part_a, part_b): the pairs whose ends the links leave in different parts."""
    parts = staged(_grouped(nodes.select("node"), links), "parts")
    for c in "ab":
        pairs = pairs.join(parts.select(F.col("node").alias(c), F.col("label").alias(f"part_{c}")), c)
    return staged(pairs.where("part_a <> part_b"), "apart")


def _pair_links(nodes: DataFrame, pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join what similar ones of the pairs join.

    Groups of copies have very many pairs, so in the first rounds each node takes the partner of the least part only; pairs
    within a part, and those that have failed, need no sets. Then all pairs left are verified.
    """
    links = pairs.limit(0)
    for turn in range(ROUNDS + 1):
        apart = _apart(nodes, pairs, links) if turn else pairs.withColumns({"part_a": F.col("a"), "part_b": F.col("b")})
        taken = apart.select("a", "b")
        if turn < ROUNDS:
            ends = apart.select("a", "part_b", "b").union(apart.select("b", "part_a", "a"))
            one = ends.groupBy("a").agg(F.min(F.struct("part_b", "b"))["b"].alias("b"))
            taken = staged(one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "taken")
            pairs = apart.select("a", "b").join(taken, ["a", "b"], "left_anti")
        links = links.union(staged(_verified(taken, sets, similarity), "links"))
    return links


def _candidates(lists: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(key, node, part): the members of lists (key, node, part) that tallies leave to be compared by sets.

    A pair that reaches the guaranteed minimum is left in the largest list that it met in, so that few lists are compared,
    and of these only the members of such pairs; a list with a block of very many pairs is compared whole.
    """
    printed = staged(_blocks(lists), "blocks").join(nodes.select("node", "n", "bytes"), "node")
    found = staged(_in_blocks(printed, ("n", "bytes"), _tallies(similarity), "key bigint, size bigint, a bigint, b bigint"), "tallied")
    best = found.where("a is not null").groupBy("a", "b").agg(F.max(F.struct("size", "key"))["key"].alias("key"))
    ends = staged(best.select("key", F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    whole = lists.join(found.where("a is null").select("key").distinct(), "key", "left_semi")
    left = staged(lists.join(ends, ["key", "node"], "left_semi").union(whole).distinct(), "left")
    released(nodes.sparkSession, found, ends)
    return left


def _joined(nodes: DataFrame, pairs: DataFrame, long: DataFrame, sets_of, similarity: float) -> DataFrame:
    """Links (a, b) between nodes that join all similar pairs that met: pairs (a, b), and any two of a list of long (key, node).

    sets_of(wanted) gives the sets (node, t) of nodes (node). First each node of a long list is tallied in one of its
    lists, and what that leaves is compared by sets, as the pairs are; this joins most of what belongs together. Then all
    lists that still hold several parts tally the pairs of different parts, and what that leaves is compared.
    """
    spark, ends = nodes.sparkSession, pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    if long.isEmpty():
        return _pair_links(nodes, pairs, sets_of(ends.distinct()), similarity)

    def held(lists: DataFrame) -> DataFrame:
        rows = staged(lists.join(_grouped(nodes.select("node"), links).withColumnRenamed("label", "part"), "node").select("key", "node", "part"), "long")
        mixed = rows.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
        return rows.join(mixed, "key", "left_semi")

    one = staged(long.groupBy("node").agg(F.min("key").alias("key")).select("key", "node", F.col("node").alias("part")), "one")
    near = _candidates(one, nodes, similarity)
    sets = sets_of(ends.union(near.select("node")).distinct())
    links = _pair_links(nodes, pairs, sets, similarity)
    links = links.union(staged(_long_links(held(near.select("key", "node")), sets, similarity), "links"))
    released(spark, one, near, sets)
    left = _candidates(staged(held(long), "mixed"), nodes, similarity)
    return links.union(staged(_long_links(left, sets_of(left.select("node").distinct()), similarity), "links"))


def _grouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (node, ...) with `label`, the smallest node of the component that the links make."""
    parts = connected_components(links).withColumnRenamed("node", "of")
    return nodes.join(parts, F.col("node") == F.col("of"), "left").withColumn("label", F.coalesce("label", "node")).drop("of")


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near copies: the one of smallest doc_id (rows without one come last).

    Rows of the same set of `words`-word shingles are one group; sets are met by the first shingles of each, which every
    two of `similarity` have in common (see above), and groups are joined by all pairs whose exact share of common
    shingles is `similarity` or more. A null text counts as empty; texts without words are one group, long ones count
    whole. All columns stay, whatever their names; rows that agree in everything count as one, and of rows with one
    doc_id the one of least hash comes first. An empty table stays empty.
    """
    mark = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    own_text = docs.select(F.col(doc_id).alias("id"), mark.alias("mark"), F.col(text).cast("string").alias("t"))
    common = _common_shingles(own_text, words)

    @F.pandas_udf("node bigint, n int, bytes binary, prefix array<bigint>")
    def prints(texts: pd.Series) -> pd.DataFrame:
        sets = [np.unique(_hashes(t, words)) for t in texts]
        first = [_prefix(x, common, similarity).view(np.int64) for x in sets]
        return pd.DataFrame({"node": [set_digest(x) for x in sets], "n": [len(x) for x in sets], "bytes": [positional_bytes(x).tobytes() for x in sets], "prefix": first})

    place = F.struct(F.col("id").isNull().alias("last"), "id", "mark").alias("place")
    own = staged(own_text.select(place, prints("t").alias("p")).select("place", "p.*"), "fingerprints")
    repeated = own.select("place").distinct().count() < own.count()
    first = staged(own.groupBy(F.col("node").alias("key")).agg(F.min("place").alias("at")), "first")
    nodes = own.join(first, (F.col("node") == F.col("key")) & F.col("place").eqNullSafe(F.col("at")), "left_semi")
    nodes = nodes.dropDuplicates(["node"]) if repeated else nodes
    met = staged(_met(nodes.select("node", "prefix")), "lists")
    nodes = staged(nodes.drop("prefix"), "groups")
    pairs = staged(met.where("b is not null").select("a", "b").distinct(), "met")
    pairs = staged(_reaching(pairs, nodes, similarity), "pairs")
    released(docs.sparkSession, own)
    long = met.where("b is null").select("key", F.col("a").alias("node"))
    final = _grouped(nodes, _joined(nodes, pairs, long, lambda wanted: _sets(own_text, nodes, wanted, words, repeated), similarity))
    best = staged(final.groupBy("label").agg(F.min("place").alias("place")).select("place.id", "place.mark"), "survivors")
    of, marked = unused(docs, "of", "marked")
    kept = docs.join(best.toDF(of, marked), docs[doc_id].eqNullSafe(F.col(of)) & (mark == F.col(marked)), "left_semi")
    return kept.dropDuplicates() if repeated else kept
