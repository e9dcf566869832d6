"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text: after each byte it is doubled and the byte's random number added, so its 32
bits depend on the last 32 bytes. Where its highest bits are zero, and at least `least` bytes after the last cut, the
text is cut (and at the latest after `most` bytes). Cuts follow content, so they fall in line again soon after an
insertion. Chunks are deduplicated by a 128-bit digest: the first chunk of a digest in input order stays, all later ones
are repeats, and neighbouring ones make a run. Chunks of 32 bytes and up, 64 on average, hardly repeat by chance, and a
passage of some 200 bytes holds whole ones; `run` can ask for runs of so many bytes at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Cut bits (a cut every 2 ** BITS bytes after the least size), least and most bytes of a chunk, least bytes of a run.
BITS, LEAST, MOST, RUN = 5, 32, 1024, 0
WINDOW = 32


def gear_numbers(seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling the width that is summed up."""
    h = gear[data]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width) if len(h) > width else 0
        width *= 2
    return h


def cuts(data: bytes, gear: np.ndarray, bits: int = BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of data; the last is its length."""
    ends, last = [], 0
    block = 1 << 20
    for at in range(0, len(data), block):  # blocks overlap by a window, so memory is bounded on very long texts
        lead = min(at, WINDOW - 1)
        h = gear_hashes(np.frombuffer(data[at - lead : at + block], np.uint8), gear)[lead:]
        for c in (np.nonzero(h >> np.uint32(32 - bits) == 0)[0] + (at + 1)).tolist():
            while c - last > most:
                last += most
                ends.append(last)
            if c - last >= least:
                ends.append(c)
                last = c
    while len(data) - last > most:
        last += most
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


def chunks(docs: DataFrame, text: str = "text", bits: int = BITS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(row, start, size, hi, lo, again): the chunks of every text, `again` where a text holds the digest earlier on.

    row numbers the rows of docs in input order. A text without bytes has one chunk of size 0.
    """
    gear = gear_numbers()
    digest = xxhash.xxh3_128_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, sizes, digests, again = [], [], [], [], []
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = t.as_buffer().to_pybytes() if t.is_valid else b""
                ends = cuts(data, gear, bits, least, most) or [0]
                begins = [0, *ends[:-1]]
                own = [digest(data[a:b]) for a, b in zip(begins, ends, strict=True)]
                seen: set[int] = set()
                again += [x in seen or seen.add(x) is not None for x in own]
                digests += own
                rows.append(np.full(len(ends), row, np.int64))
                starts += begins
                sizes += [b - a for a, b in zip(begins, ends, strict=True)]
                if len(starts) > 1 << 17:
                    yield emit(rows, starts, sizes, digests, again)
                    rows, starts, sizes, digests, again = [], [], [], [], []
            if starts:
                yield emit(rows, starts, sizes, digests, again)

    def emit(rows: list, starts: list, sizes: list, digests: list, again: list) -> pa.RecordBatch:
        halves = np.frombuffer(b"".join([x.to_bytes(16, "little") for x in digests]), "<i8").reshape(-1, 2)
        arrays = [np.concatenate(rows), np.array(starts, np.int32), np.array(sizes, np.int32), halves[:, 1], halves[:, 0], np.array(again, bool)]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)) for a in arrays], ["row", "start", "size", "hi", "lo", "again"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").cast("binary").alias("text"))
    return numbered.mapInArrow(run, "row bigint, start int, size int, hi bigint, lo bigint, again boolean")


def _runs(found: Column, run: int) -> Column:
    """Neighbouring chunks (sorted structs of start and size) put together; runs of under `run` bytes left out."""

    def end(c: Column) -> Column:
        return c["start"] + c["size"]

    first = F.filter(found, lambda c, i: F.coalesce(end(F.get(found, i - 1)) != c["start"], F.lit(True)))
    last = F.filter(found, lambda c, i: F.coalesce(F.get(found, i + 1)["start"] != end(c), F.lit(True)))
    whole = F.zip_with(first, last, lambda a, b: F.struct(a["start"].alias("start"), end(b).alias("end")))
    return F.filter(whole, lambda r: r["end"] - r["start"] >= run) if run else whole


def repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", run: int = RUN, **sizes: int) -> DataFrame:
    """(doc_id, n_bytes, n_repeated, n_removed, n_spans, spans), a row for each row of docs.

    n_repeated counts the bytes in runs of chunks that occur elsewhere too, the first occurrences included; spans are the
    runs of bytes removed, as array<struct<start,end>>. A null text is empty. Of repeated rows the first in input order keeps
    its text. Very long texts are cut block by block. Other columns are not read; an empty table gives an empty result. docs is read more than once and its
    rows are numbered as they come, so it must be a table or something else that comes in the same order each time.
    """
    own = staged(chunks(docs, text, **sizes), "chunks")
    shared = own.groupBy("hi", "lo").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Staged, so that the join has plain shuffles on both sides, of which large partitions can be split.
    shared = staged(shared.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), "first"), "shared")
    met = own.where("size > 0").join(shared, (F.col("hi") == F.col("hi2")) & (F.col("lo") == F.col("lo2")))
    repeat = (F.col("row") != F.col("first")) | F.col("again")
    by_row = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "size", repeat.alias("later")))).alias("found"))
    by_row = by_row.select(F.col("row").alias("of"), _runs(F.col("found"), run).alias("shared"), _runs(F.filter("found", lambda c: c["later"]), run).alias("spans"))
    n_bytes = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("bigint")
    names = docs.select(F.monotonically_increasing_id().alias("at"), F.col(doc_id).alias("doc_id"), n_bytes.alias("n_bytes"))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    rows = names.join(by_row, F.col("at") == F.col("of"), "left")

    def total(runs: Column) -> Column:
        return F.aggregate(runs, F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])

    return rows.select("doc_id", "n_bytes", F.coalesce(total(F.col("shared")), F.lit(0)).cast("bigint").alias("n_repeated"), total(spans).alias("n_removed"), F.size(spans).cast("bigint").alias("n_spans"), spans.alias("spans"))


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """data without the bytes of spans (sorted, apart)."""
    at, out = 0, []
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])
