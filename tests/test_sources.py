import struct

import numpy as np
import pytest
from strandwork.sources import pcm

FRAMES = "file_id bigint, frame bigint, l bigint, r bigint"


def rows_of(spark, n=1000):
    rng = np.random.default_rng(1)
    return [(f, i, int(a), int(b)) for f in (3, 5) for i, (a, b) in enumerate(rng.integers(-8388608, 8388608, (n, 2)))]


@pytest.mark.parametrize(("kind", "bits"), [("wav", 16), ("wav", 24), ("wav", 32), ("raw", 24)])
def test_files_round_trip(spark, tmp_path, kind, bits):
    rows = rows_of(spark)
    parts = pcm.write_files(spark.createDataFrame(rows, FRAMES), str(tmp_path / "out"), 44100, bits, kind)
    where = {r.part: r.file_id for r in parts.collect()}
    want = sorted((f, i, a >> 8 << 8, b >> 8 << 8) if bits == 16 else (f, i, a, b) for f, i, a, b in rows)

    def back(frame):
        return sorted((where[int(r.path.rsplit("part-")[1][:5])], r.frame, r.l, r.r) for r in frame.collect())

    split = spark.read.format("pcm").option("split", 300).load(str(tmp_path / "out"))
    assert split.rdd.getNumPartitions() == 8
    assert back(split) == want
    assert back(pcm.read_pcm(spark, str(tmp_path / "out"))) == want


def test_headers():
    extensible = b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<IHHIIHH", 40, 0xFFFE, 2, 96000, 0, 6, 24) + bytes(24) + b"data" + struct.pack("<I", 600)
    layout = pcm.wav_layout(extensible, len(extensible) + 60)
    assert (layout.rate, layout.bits, layout.frames) == (96000, 24, 10)
    for change in ({"tag": 3}, {"channels": 1}, {"bits": 8}):
        shape = {"tag": 1, "channels": 2, "bits": 16} | change
        head = b"RIFF" + bytes(4) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, shape["tag"], shape["channels"], 48000, 0, 4, shape["bits"]) + b"data" + bytes(4)
        with pytest.raises(pcm.UnsupportedAudio):
            pcm.wav_layout(head, len(head))
    with pytest.raises(pcm.UnsupportedAudio):
        pcm.layout_of("x.raw", b"fLaC", 4)


def test_catalogue(spark, tmp_path):
    for name, data in (("b.RAW", b"12345678"), ("a.wav", b"RIFF"), ("sub/c.pcm", b"fLaC"), (".hidden.wav", b"RIFF"), ("notes.txt", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = [(r.path.rsplit("/", 1)[1], r.format, r.bytes) for r in pcm.catalogue(spark, str(tmp_path)).collect()]
    assert got == [("a.wav", "wav", 4), ("b.RAW", "raw", 8), ("c.pcm", "flac", 4)]
    assert [p.rsplit("/", 1)[1] for p in pcm.walk(str(tmp_path))] == ["a.wav", "b.RAW", "c.pcm"]
    loose = spark.read.format("pcm").option("strict", "false").load(str(tmp_path / "b.RAW"))
    assert loose.count() == 1


def test_blobs(spark, tmp_path):
    blobs = spark.createDataFrame([(1, b"abc"), (2, b""), (3, None)], "file_id bigint, data binary")
    got = pcm.write_blobs(blobs, f"file://{tmp_path}/blobs").collect()
    assert sorted((r.file_id, r.size) for r in got) == [(1, 3), (2, 0), (3, 0)]
    assert (tmp_path / "blobs" / "1.bin").read_bytes() == b"abc"
