import random

import numpy as np
from pyspark.sql import functions as F
from strandwork.operators import control, render
from strandwork.sources.synthetic import OPENING_BITS, plant_bits
from strandwork.streaming import control as S

FRAMES = "file_id bigint, frame bigint, l bigint, r bigint"


def stored(spark, tmp_path, frames, column, step):
    """Files by range of a column, to be streamed one at a time."""
    top = frames.agg(F.max(column)).first()[0]
    for i, at in enumerate(range(0, top + 1, step)):
        frames.where(F.col(column).between(at, at + step - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        import os
        import time

        for name in os.listdir(tmp_path / "in"):
            path = tmp_path / "in" / name
            if name.endswith(".parquet") and not name.startswith("b"):
                os.utime(path, (time.time() - 1000 + i, time.time() - 1000 + i))
                os.rename(path, tmp_path / "in" / f"b{i:04d}.parquet")
    return spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drained(stream, tmp_path, spark):
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def planted(spark):
    rng = random.Random(3)
    rows = [(f, i, rng.randrange(-(1 << 23), 1 << 23), rng.randrange(-(1 << 23), 1 << 23)) for f in range(3) for i in range(400)]
    frames = spark.createDataFrame(rows, FRAMES)
    return plant_bits(frames.where("file_id < 2"), OPENING_BITS, F.col("file_id") * 90 + 20, 11).union(frames.where("file_id = 2"))


def test_streamed_packets_equal_batch(spark, tmp_path):
    frames = planted(spark).cache()
    batch = control.packets(control.channel_bits(frames, control.find_streams(frames)))
    got = drained(S.streaming_packets(stored(spark, tmp_path, frames, "frame", 100)), tmp_path, spark)
    assert sorted((r.file_id, r.offset, r.type, r.bits) for r in got.collect()) == sorted((r.file_id, r.offset, r.type, r.bits) for r in batch.where("type >= 0").collect())


def test_streamed_requantising_equals_batch(spark, tmp_path):
    rows = render.interpolate(planted(spark).where("file_id = 2"), 2).cache()
    want = sorted(tuple(r) for r in render.requantise(rows, 2).collect())
    got = drained(S.streaming_requantise(stored(spark, tmp_path, rows, "out_frame", 300), 2), tmp_path, spark)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_gaps_end_a_stream_and_sniffing_gives_up():
    s = S.Scanner()
    assert s.feed(np.arange(5), np.zeros(5, np.int64)) == []
    assert s.feed(np.arange(6, 9), np.zeros(3, np.int64))[0][-1] == "gap" and s.feed(np.arange(9, 12), np.zeros(3, np.int64)) == []
    sniff = S.Sniffer(100)
    assert [sniff.feed(np.arange(a, a + 40), np.zeros(40, np.int64)) for a in (0, 40, 80)] == ["SNIFFING", "SNIFFING", "PLAIN"]
    bits = np.array([control.MAGIC >> i & 1 for i in range(40)], np.int64) << 9
    assert S.Sniffer(100).feed(np.arange(40), bits) == "DECODING"
