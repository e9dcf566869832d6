"""PCM files as tables, and tables as PCM files.

`spark.read.format("pcm")` (after `register(spark)`) reads WAV and raw stereo files that Python can open; fixed-width
frames make every file splittable, so a long file is many partitions. `read_pcm` does the same over Spark's own binary
reader for stores that only Spark reaches (a file is a row there). Frames are right-justified 24-bit numbers.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

EXTENSIONS = (".flac", ".wav", ".wave", ".raw", ".pcm")
SCHEMA = "path string, frame bigint, l bigint, r bigint"
#: Frames of one partition, and the rate that raw files are taken to have.
SPLIT, RAW_RATE = 1 << 22, 48000


def format_of(head: Column, path: Column) -> Column:
    """flac, wav, raw or null: by the first bytes, else by the name's end in any case."""
    name = F.lower(path)
    return (
        F.when(F.substring(head, 1, 4) == F.lit(b"fLaC"), "flac")
        .when(F.substring(head, 1, 4) == F.lit(b"RIFF"), "wav")
        .when(name.endswith(".flac"), "flac")
        .when(name.endswith(".wav") | name.endswith(".wave"), "wav")
        .when(name.endswith(".raw") | name.endswith(".pcm"), "raw")
    )


@dataclass(frozen=True)
class Layout:
    """Where the frames of a file lie."""

    kind: str
    rate: int
    bits: int
    offset: int
    frames: int


class UnsupportedAudio(ValueError):
    """A file that isn't stereo PCM of 16, 24 or 32 bits."""


def wav_layout(head: bytes, size: int) -> Layout:
    """Walk the chunks of a RIFF file; chunks of odd size are padded. The data chunk may be cut off."""
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise UnsupportedAudio("not a WAVE file")
    at, shape = 12, None
    while at + 8 <= len(head):
        name, length = head[at : at + 4], struct.unpack_from("<I", head, at + 4)[0]
        if name == b"fmt ":
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", head, at + 8)
            if tag not in (1, 0xFFFE) or channels != 2 or bits not in (16, 24, 32):
                raise UnsupportedAudio(f"format {tag:#x}, {channels} channels, {bits} bits")
            shape = rate, bits
        elif name == b"data":
            if shape is None:
                raise UnsupportedAudio("data before fmt")
            return Layout("wav", *shape, at + 8, min(length, max(0, size - at - 8)) // (shape[1] // 4))
        at += 8 + length + (length & 1)
    raise UnsupportedAudio("no data chunk")


def layout_of(path: str, head: bytes, size: int) -> Layout:
    if head[:4] == b"fLaC" or path.lower().endswith(".flac"):
        raise UnsupportedAudio("FLAC needs a decoder that is not here")
    if head[:4] == b"RIFF" or path.lower().endswith((".wav", ".wave")):
        return wav_layout(head, size)
    if path.lower().endswith((".raw", ".pcm")):
        return Layout("raw", RAW_RATE, 24, 0, size // 8)
    raise UnsupportedAudio(path)


def frames_from(data: bytes, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Left and right samples, right-justified to 24 bits: 16-bit ones scaled up, 32-bit ones without their low byte."""
    if layout.kind == "raw":
        x = np.frombuffer(data, "<i4").astype(np.int64) >> 8
    elif layout.bits == 16:
        x = np.frombuffer(data, "<i2").astype(np.int64) << 8
    elif layout.bits == 32:
        x = np.frombuffer(data, "<i4").astype(np.int64) >> 8
    else:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int64)
        x = (b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16 ^ 0x800000) - 0x800000
    return x[0::2], x[1::2]


def packed(left: np.ndarray, right: np.ndarray, bits: int) -> bytes:
    """Frames as little-endian samples of 16, 24 or 32 bits (24 significant)."""
    x = np.empty(2 * len(left), np.int64)
    x[0::2], x[1::2] = left, right
    if bits == 16:
        return (x >> 8).astype("<i2").tobytes()
    if bits == 32:
        return (x << 8).astype("<i4").tobytes()
    return (x & 0xFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def wav_header(frames: int, rate: int, bits: int) -> bytes:
    size = frames * bits // 4
    return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, rate, rate * bits // 4, bits // 4, bits) + b"data" + struct.pack("<I", size)


def walk(root: str) -> Iterator[str]:
    """Files with known extensions below root, dot files left out, in byte order of their names."""
    if os.path.isfile(root):
        yield root
        return
    for name in sorted((n for n in os.listdir(root) if not n.startswith(".")), key=os.fsencode):
        path = os.path.join(root, name)
        if os.path.isdir(path):
            yield from walk(path)
        elif name.lower().endswith(EXTENSIONS):
            yield path


@dataclass
class Piece(InputPartition):
    path: str
    layout: Layout
    first: int
    count: int

    def __init__(self, path: str, layout: Layout, first: int, count: int) -> None:
        super().__init__((path, first))
        self.path, self.layout, self.first, self.count = path, layout, first, count


class PcmReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.split = options["path"], int(options.get("split", SPLIT))
        self.strict = options.get("strict", "true").lower() == "true"

    def partitions(self) -> list[Piece]:
        out = []
        for path in walk(self.root.removeprefix("file://")):
            size = os.path.getsize(path)
            with open(path, "rb") as f:
                head = f.read(1 << 16)
            try:
                layout = layout_of(path, head, size)
            except UnsupportedAudio:
                if self.strict:
                    raise
                continue
            out += [Piece(path, layout, at, min(self.split, layout.frames - at)) for at in range(0, max(layout.frames, 1), self.split)]
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        width = 8 if piece.layout.kind == "raw" else piece.layout.bits // 4
        with open(piece.path, "rb") as f:
            f.seek(piece.layout.offset + piece.first * width)
            at, end = piece.first, piece.first + piece.count
            while at < end:
                n = min(1 << 16, end - at)
                left, right = frames_from(f.read(n * width), piece.layout)
                yield pa.RecordBatch.from_arrays([pa.array([piece.path] * n), pa.array(np.arange(at, at + n)), pa.array(left), pa.array(right)], ["path", "frame", "l", "r"])
                at += n


class PcmWriter(DataSourceArrowWriter):
    """One WAV or raw file for each partition; its rows must be one file's frames in order."""

    def __init__(self, options: dict) -> None:
        self.folder = options["path"].removeprefix("file://")
        self.bits, self.rate, self.raw = int(options.get("bits", 24)), int(options.get("rate", RAW_RATE)), options.get("kind", "wav") == "raw"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        from pyspark import TaskContext

        context = TaskContext.get()
        final = os.path.join(self.folder, f"part-{context.partitionId():05d}.{'raw' if self.raw else 'wav'}")
        partial, frames = f"{os.path.dirname(final)}/.{os.path.basename(final)}.{context.taskAttemptId()}", 0
        with open(partial, "wb") as f:
            if not self.raw:
                f.write(wav_header(0, self.rate, self.bits))
            for batch in batches:
                left, right = batch.column("l").to_numpy(), batch.column("r").to_numpy()
                f.write(packed(left, right, 32 if self.raw else self.bits))
                frames += len(left)
            if not self.raw:
                f.seek(0)
                f.write(wav_header(frames, self.rate, self.bits))
        if frames:
            os.replace(partial, final)
        else:
            os.remove(partial)
        return WriterCommitMessage()


class PcmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PcmReader:
        return PcmReader(self.options)

    def writer(self, schema, overwrite: bool) -> PcmWriter:
        return PcmWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcmSource)


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """(path, format, bytes) of the files below root that carry a known name, in order of path, by Spark's reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    known = ~name.startswith(".") & F.coalesce(*(F.when(name.endswith(e), F.lit(True)) for e in EXTENSIONS), F.lit(False))
    return files.where(known).select("path", format_of(F.col("content"), F.col("path")).alias("format"), F.col("length").alias("bytes")).orderBy("path")


def read_pcm(spark: SparkSession, root: str) -> DataFrame:
    """SCHEMA rows of the WAV and raw files below root, by Spark's binary reader; unsupported files give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_buffer().to_pybytes()
                try:
                    layout = layout_of(path, data[: 1 << 16], len(data))
                except UnsupportedAudio:
                    continue
                width = 8 if layout.kind == "raw" else layout.bits // 4
                for at in range(0, layout.frames, 1 << 16):
                    n = min(1 << 16, layout.frames - at)
                    begin = layout.offset + at * width
                    left, right = frames_from(data[begin : begin + n * width], layout)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(at, at + n)), pa.array(left), pa.array(right)], ["path", "frame", "l", "r"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def write_files(frames: DataFrame, folder: str, rate: int = RAW_RATE, bits: int = 24, kind: str = "wav") -> DataFrame:
    """Write a WAV or raw file for each file_id (its frames go to one task, in order); (file_id, part) says which."""
    register(frames.sparkSession)
    names = frames.select("file_id").distinct().orderBy("file_id").collect()  # a row for each file to be written
    parts = frames.sparkSession.createDataFrame([(r.file_id, i) for i, r in enumerate(names)], "file_id bigint, part int")
    dealt = frames.join(F.broadcast(parts), "file_id").repartitionById(max(len(names), 1), F.col("part")).sortWithinPartitions("frame")
    rows = dealt.select(F.col("file_id").cast("string").alias("path"), "frame", "l", "r")
    rows.write.format("pcm").option("path", folder).option("bits", bits).option("rate", rate).option("kind", kind).mode("append").save()
    return parts


def write_blobs(blobs: DataFrame, folder: str) -> DataFrame:
    """Write each row's `data` to folder/<file_id>.bin (a URI that executors share); (file_id, path, size) says what."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            names = [f"{root}/{i}.bin" for i in batch.column(0).to_pylist()]
            data = [x or b"" for x in batch.column(1).to_pylist()]
            for name, content in zip(names, data, strict=True):
                with fs.open_output_stream(name) as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array([len(d) for d in data], pa.int64())], ["file_id", "path", "size"])

    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    done = blobs.select("file_id", "data").mapInArrow(run, "file_id bigint, path string, size bigint").collect()  # a row a file
    return blobs.sparkSession.createDataFrame(done, "file_id bigint, path string, size bigint")
