"""Benchmark decontamination with DataFrame functions only.

Texts are lower-cased and cut into words at white space; a shingle is five words in a row. Windows of an item's size are
laid over a document at every start; a window that reaches the similarity wanted holds so many shingles of the item
that counting them, by the positions at which the document holds one, says which windows need a fingerprint, whatever
the order of the passage's parts. Windows and items get 64-bit SimHash fingerprints of their shingles. Multi-index blocks
find all pairs within the radius: 23 bits spread over eight blocks leave one block with two differing bits at most, so
items are posted under every block value within two bits and windows look up their eight blocks. Pairs within the
radius are verified exactly: shingles weighted by their occurrences, sum of least over sum of greatest.

The whole word sequence is the one shingle of an item of under five words, and of the windows laid for it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, unused

WORDS, SIMILARITY, BLOCKS = 5, 0.8, 8
#: Rows of narrow tables (numbers only, under 64 bytes a row) up to which they are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _starts(n: Column, k: int) -> Column:
    """0 to n - k, or nothing."""
    return F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value; value is computed once, also where the optimizer copies the whole into a filter."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(words: Column, k: int) -> Column:
    """A hash for each shingle, repeats included."""

    def of(hashes: Column) -> Column:
        return F.transform(_starts(F.size(hashes), k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _shingles(words: Column, k: int) -> Column:
    """The shingles as text, repeats included."""
    return F.transform(_starts(F.size(words), k), lambda i: F.array_join(F.slice(words, i + 1, k), " "))


def simhash(values: Column) -> Column:
    """The 64-bit fingerprint of hashes: a bit is 1 where over half of them have it."""
    return F.coalesce(_let(values, _fingerprint), F.lit(0).cast("bigint"))


def _fingerprint(hashes: Column) -> Column:
    def bit(b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda acc, h: acc + F.getbit(h, b).cast("int"))
        return F.when(2 * ones > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(bit(b)))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the lesser over sum of the greater number of occurrences of each distinct shingle."""

    def count(of: Column, s: Column) -> Column:
        return F.size(F.filter(of, lambda x: x == s))

    zero = F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"))

    def step(acc: Column, s: Column) -> Column:
        x, y = count(a, s), count(b, s)
        return F.struct((acc["lo"] + F.least(x, y)).alias("lo"), (acc["hi"] + F.greatest(x, y)).alias("hi"))

    return F.aggregate(F.array_distinct(F.concat(a, b)), zero, step, lambda acc: F.when(acc["hi"] > 0, acc["lo"] / acc["hi"]).otherwise(0.0))


def _similarity(a: Column, b: Column, k: int) -> Column:
    return _let(F.struct(_shingles(a, k).alias("a"), _shingles(b, k).alias("b")), lambda x: weighted_similarity(x["a"], x["b"]))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _hits(own: DataFrame, item: DataFrame, k: int) -> DataFrame:
    """(doc_id, row, w, item_id, n_words, at): where each text holds shingles of k words of each item."""
    index = item.select("item_id", "n_words", F.explode("item_hashes").alias("s")).distinct()
    rows = index.count()
    key = ["doc_id", "row", "item_id", "n_words"]
    positions = F.sort_array(F.collect_set("pos")).alias("at")
    if rows <= BROADCAST_ROWS:
        met = own.select("doc_id", "row", "w", F.posexplode(shingle_hashes(F.col("w"), k)).alias("pos", "s")).join(F.broadcast(index), "s")
        return met.groupBy(*key).agg(positions, F.first("w").alias("w"))
    # The shingles go without their texts, which are met again by the few rows that have hits.
    met = own.select("doc_id", "row", F.posexplode(shingle_hashes(F.col("w"), k)).alias("pos", "s")).join(index, "s")
    return met.groupBy(*key).agg(positions).join(own.dropDuplicates(["doc_id", "row"]), ["doc_id", "row"])


def _windows(hits: DataFrame, k: int, similarity: float) -> DataFrame:
    """(doc_id, item_id, n_words, start_word, words, fp): the windows that hold enough positions of an item, each once."""
    n, size = F.col("n_words"), F.size("w")
    # Of x shingles of the window and y of the item, s (x + y) / (1 + s) have to be shared for a similarity of s.
    need = F.greatest(F.lit(1), F.ceil((F.least(n, size) + n - 2 * (k - 1)) * (similarity / (1 + similarity)) - 1e-9).cast("int"))
    hits = hits.withColumn("need", need).where(F.size("at") >= F.col("need"))

    def covering(i: Column) -> Column:  # starts of the windows that hold the positions from the i-th on, `need` of them
        lo = F.greatest(F.lit(0), F.get("at", i + F.col("need") - 1) - (n - k))
        hi = F.least(F.get("at", i), F.greatest(F.lit(0), size - n))
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    starts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), covering)))
    placed = hits.select("doc_id", "item_id", "w", "n_words", F.explode(starts).alias("start_word"))
    placed = placed.select("doc_id", "item_id", "n_words", "start_word", F.slice("w", F.col("start_word") + 1, n).alias("words"))
    return placed.withColumn("fp", simhash(shingle_hashes(F.col("words"), k)))


def _scored(windows: DataFrame, item: DataFrame, k: int, similarity: float) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, differing_bits, similarity) of the windows that are similar to their item."""
    within = 2  # bits in one block at most, for a radius of BLOCKS * (within + 1) - 1
    radius = BLOCKS * (within + 1) - 1
    flips = [0, *(sum(1 << b for b in c) for r in range(1, within + 1) for c in combinations(range(8), r))]

    def block(fp: Column, b: Column) -> Column:
        return F.call_function("shiftright", fp, 8 * b).bitwiseAND(255)

    blocks = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    prints = item.select("item_id", "n_words", F.xxhash64("item_words").alias("item_row"), simhash(F.col("item_hashes")).alias("item_fp"))
    posted = prints.select("*", F.explode(blocks).alias("b")).select("*", F.explode(F.array(*map(F.lit, flips))).alias("flip"))
    posted = posted.select("item_id", "n_words", "item_row", "item_fp", "b", block(F.col("item_fp"), F.col("b")).bitwiseXOR(F.col("flip")).alias("value"))
    # A window is looked up under the item whose shingles it holds, so postings of one length never meet all windows.
    looked = windows.select("*", F.explode(blocks).alias("b")).withColumn("value", block(F.col("fp"), F.col("b")))
    pairs = looked.join(_small(posted, item.count() * BLOCKS * len(flips)), ["item_id", "n_words", "b", "value"])
    bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))

    def near(b: Column) -> Column:  # a pair is taken from the first block that it shares within the bits allowed
        return F.bit_count(block(F.col("fp").bitwiseXOR(F.col("item_fp")), b)) <= within

    first = ~F.exists(F.filter(blocks, lambda x: x < F.col("b")), near)
    pairs = pairs.where((bits <= radius) & first).withColumn("differing_bits", bits).drop("n_words")
    texts = item.select(F.col("item_id").alias("of"), F.xxhash64("item_words").alias("of_row"), "n_words", "item_words")
    pairs = pairs.join(texts, (F.col("item_id") == F.col("of")) & (F.col("item_row") == F.col("of_row")))
    scored = pairs.select("doc_id", "item_id", "start_word", "n_words", "differing_bits", _similarity(F.col("words"), F.col("item_words"), k).alias("similarity"))
    return scored.where(F.col("similarity") >= similarity)


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, start_word, n_words, differing_bits, similarity): the best window of each document and item.

    Only windows whose similarity is at least `similarity` count; of equal ones the first is given. Rows without doc_id
    or item_id, and null or wordless texts, give nothing; rows with the same doc_id, or item_id, count as one document's
    or item's texts. An item of under `words` words has one shingle, all of it, so it is found where it stands word for
    word. Very long texts are searched whole. Only the named columns are read. Empty tables on either side give an empty
    result.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("the radius is laid out for a similarity of 0.8 or more")
    item = items.select(F.col(item_id).alias("item_id"), words_of(F.col(item_text)).alias("item_words")).where(F.col("item_id").isNotNull() & (F.size("item_words") > 0))
    item = item.withColumn("n_words", F.size("item_words")).dropDuplicates()
    own = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("w")).where(F.col("doc_id").isNotNull()).withColumn("row", F.xxhash64("w"))
    found = []
    # At most `words` sizes of shingles: all but the last are those of short items.
    for k in sorted(r.k for r in item.select(F.least("n_words", F.lit(words)).alias("k")).distinct().collect()) or [words]:
        some = item.where(F.least("n_words", F.lit(words)) == k).withColumn("item_hashes", shingle_hashes(F.col("item_words"), k))
        found.append(_scored(_windows(_hits(own, some, k), k, similarity), some, k, similarity))
    best = F.max_by(F.struct("start_word", "n_words", "differing_bits", "similarity"), F.struct("similarity", -F.col("start_word"))).alias("best")
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def decontaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that hold a window of an item; rows without doc_id stay, as do all columns."""
    name = unused(docs, "leaked")[0]
    bad = staged(leaks(docs, items, doc_id=doc_id, **options).select(F.col("doc_id").alias(name)).distinct(), "leaks")
    return docs.join(_small(bad, bad.count()), docs[doc_id] == F.col(name), "left_anti")
