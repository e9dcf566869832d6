"""Token ids as fixed-stride binary shards in training order.

Documents are encoded, closed with an end mark, and packed into sequences of `length` ids, one input partition after the
other (the last sequence of a partition is padded with end marks). Sequences are numbered in corpus order, and a keyed Feistel network permutes the numbers: it is a bijection on
the next power of four, and numbers that leave the range walk on along their cycle until they are back in it. So every
sequence gets a slot of the training order by arithmetic alone, without a sort of the corpus or a list of it, and the
same key always gives the same order. Slot s lies in shard s // per_shard at offset (s % per_shard) * stride. Each task
holds one range of slots and writes its shard in one pass, first under a name of its own, then moved, so a task that is
run again leaves the same file. Reading on from any slot takes one seek.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import drop_path, shared_path

LENGTH, PER_SHARD, ROUNDS = 4096, 2048, 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """Keyed mixing of 64-bit numbers."""
    # Multipliers of the splitmix64 finaliser.
    x = x + np.uint64(key & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def slots(numbers: np.ndarray, total: int, key: int) -> np.ndarray:
    """The slot of each sequence number below total."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = np.asarray(numbers).astype(np.uint64)
    walking = np.ones(len(out), bool)
    while walking.any():
        left, right = out[walking] >> shift, out[walking] & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (_mix(right, key + (r + 1) * 0x9E3779B97F4A7C15) & mask)
        out[walking] = left << shift | right
        walking = out >= total
    return out.astype(np.int64)


def packed(docs: DataFrame, path: str, end: int, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, first_token, n_tokens, n_docs, data): sequences of the rows of each input partition, one after another.

    doc_id and first_token say where a sequence begins, n_docs how many documents it holds ids of. data holds ids in
    little-endian order, two bytes each (four if ids need it); only the last sequence of a partition can be short.
    """
    vocabulary = bpe.load_vocabulary(path)
    width = _width(vocabulary, end)
    sent = docs.sparkSession.sparkContext.broadcast(vars(vocabulary))
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe.Vocabulary(**sent.value)
        close, stride = end.to_bytes(width, "little"), length * width
        held, ids = bytearray(), None
        begins: deque[tuple[int, object]] = deque()  # (first id of the partition's stream, document) of what held has
        at = 0  # ids that have left held

        def cut(flush: bool) -> pa.RecordBatch:
            nonlocal at, held
            rows = []
            taken = 0
            while len(held) - taken >= stride or flush and taken < len(held):
                piece = bytes(held[taken : taken + stride])
                n = len(piece) // width
                while len(begins) > 1 and begins[1][0] <= at:
                    begins.popleft()
                docs_in = 1 + sum(1 for b, _ in islice(begins, 1, None) if b < at + n)
                rows.append((begins[0][1], at - begins[0][0], n, docs_in, piece))
                taken += len(piece)
                at += n
            held = held[taken:]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (ids, pa.int64(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "first_token", "n_tokens", "n_docs", "data"])

        for batch in batches:
            ids = batch.schema.field(1).type
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high in bpe.blocks(texts, 2 * bpe.BLOCK):
                flat, ends = bpe.encode_block(v, texts[low:high])
                data = flat.astype(f"<u{width}").tobytes()
                for name, a, b in zip(names[low:high], ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    begins.append((at + len(held) // width, name))
                    held += data[a * width : b * width]
                    held += close
                    if len(held) > 64 * stride:
                        yield cut(False)
        if held:
            yield cut(True)

    schema = f"doc_id {kind}, first_token bigint, n_tokens int, n_docs int, data binary"
    return docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).alias("doc_id")).mapInArrow(run, schema)


def _width(vocabulary: bpe.Vocabulary, end: int) -> int:
    return 4 if max(len(vocabulary.pieces), end + 1) > 1 << 16 else 2


def _numbered(table: DataFrame, per_shard: int, key: int) -> tuple[DataFrame, int]:
    """The table's rows with their shard and slot, data compressed for the way, and how many there are."""
    each = table.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r.p: r.n for r in each.collect()}  # a row for each input partition
    total = sum(counts.values())
    before, at = {}, 0
    for p in sorted(counts):
        before[p], at = at, at + counts[p]
    sent = table.sparkSession.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get(TaskContext.get().partitionId())
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            if number is None and len(batch):
                raise RuntimeError("the table was split in another way than when it was counted")
            for low in range(0, len(batch), 4096):
                part = batch.slice(low, 4096)
                slot = slots(np.arange(number, number + len(part)), total, key)
                number += len(part)
                data = pa.array([squeeze(x.as_buffer()) for x in part.column("data")], pa.binary())
                columns = [pa.array((slot // per_shard).astype(np.int32)), pa.array(slot), *[part.column(c) for c in ("doc_id", "first_token", "n_tokens", "n_docs")], data]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "slot", "doc_id", "first_token", "n_tokens", "n_docs", "data"])

    kind = table.schema["doc_id"].dataType.simpleString()
    return table.mapInArrow(run, f"shard int, slot bigint, doc_id {kind}, first_token bigint, n_tokens int, n_docs int, data binary"), total


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def materialised(docs: DataFrame, out: str, path: str, end: int, key: int = 2024, length: int = LENGTH, per_shard: int = PER_SHARD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write the shards of docs to the folder `out` (a URI that driver and executors share) and return their manifest.

    The manifest has a row for each sequence: (slot, shard, offset, doc_id, first_token, n_tokens, n_docs), where the
    sequence begins and what it holds. It is lazy in no way: shards are written when this returns. A null text counts
    as empty and gives an end mark; repeated rows are each written; an empty table writes no shard and gives an empty
    manifest. Only the named columns are read.
    """
    spark = docs.sparkSession
    held = shared_path(spark, "sequences")
    sequences = packed(docs, path, end, length, text, doc_id)
    sequences.write.option("compression", "zstd").parquet(held)
    table = spark.read.schema(sequences.schema).parquet(held)
    width = _width(bpe.load_vocabulary(path), end)
    rows, total = _numbered(table, per_shard, key)
    stride, pad = length * width, end.to_bytes(width, "little")
    shards = max(1, -(-total // per_shard))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(out)
        stream, open_shard, name = None, -1, ""
        unpack = zstandard.ZstdDecompressor().decompress

        def close() -> None:
            if stream is not None:
                stream.close()
                fs.move(name, f"{folder}/{shard_name(open_shard)}")

        for batch in batches:
            shard = batch.column(0).to_numpy()
            bounds = np.concatenate([[0], np.nonzero(np.diff(shard))[0] + 1, [len(shard)]])
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if hi > lo and shard[lo] != open_shard:
                    close()
                    open_shard = int(shard[lo])
                    name = f"{folder}/.{shard_name(open_shard)}.{uuid.uuid4().hex}"
                    stream = fs.open_output_stream(name)
                for piece in batch.column(6).slice(lo, hi - lo):
                    data = unpack(piece.as_buffer())
                    stream.write(data + pad * ((stride - len(data)) // width))
            offset = (batch.column(1).to_numpy() % per_shard) * stride
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(offset), *batch.columns[2:6]], ["slot", "shard", "offset", "doc_id", "first_token", "n_tokens", "n_docs"])
        close()

    pyarrow.fs.FileSystem.from_uri(out)[0].create_dir(pyarrow.fs.FileSystem.from_uri(out)[1], recursive=True)
    kind = table.schema["doc_id"].dataType.simpleString()
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "slot")
    manifest = dealt.mapInArrow(write, f"slot bigint, shard int, offset bigint, doc_id {kind}, first_token bigint, n_tokens int, n_docs int")
    listed = shared_path(spark, "manifest")
    manifest.write.parquet(listed)
    seen = spark.read.schema(manifest.schema).parquet(listed).agg(F.count(F.lit(1)).alias("n"), F.sum("slot").alias("s"), F.max("slot").alias("m")).first()
    if (seen.n, seen.s or 0) != (total, total * (total - 1) // 2) or (seen.m or 0) >= max(total, 1):
        raise RuntimeError("slots were not dealt out one to a sequence; the table must come in the same order each time")
    drop_path(spark, held)
    return spark.read.schema(manifest.schema).parquet(listed)


def read_sequences(out: str, start: int, stop: int, length: int = LENGTH, per_shard: int = PER_SHARD, width: int = 2) -> Iterator[np.ndarray]:
    """The ids of slots start to stop - 1, a seek and a sequential read for each shard."""
    fs, folder = pyarrow.fs.FileSystem.from_uri(out)
    stride = length * width
    while start < stop:
        shard, at = divmod(start, per_shard)
        n = min(stop - start, per_shard - at)
        with fs.open_input_file(f"{folder}/{shard_name(shard)}") as f:
            f.seek(at * stride)
            for _ in range(n):
                yield np.frombuffer(f.read(stride), "<u2" if width == 2 else "<u4")
        start += n
