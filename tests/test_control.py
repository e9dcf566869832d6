import random

import numpy as np
from pyspark.sql import functions as F
from strandwork.functions import generators as G
from strandwork.operators import control as C
from strandwork.sources.synthetic import OPENING_BITS, plant_bits

FRAMES = "file_id bigint, frame bigint, l bigint, r bigint"


class Writer:
    """Packets as bits, for round trips."""

    def __init__(self):
        self.bits, self.position = [], 0

    def packet(self, kind, *fields, raw=()):
        own = [kind >> i & 1 for i in range(4)]
        for value, n in fields:
            own += [value >> i & 1 for i in range(n)]
        own += list(raw)
        reg = self.position & 15
        for b in own + [0] * (-len(own) % 32):
            reg = (reg >> 1 | b << 31) ^ G.CRC2_POLY * (reg & 1)
        own += [reg >> i & 1 for i in range(4)]
        self.bits += own
        self.position += len(own)

    def datasync(self, position=None):
        at = position is not None
        fields = [(C.MAGIC >> 4, 36), (int(at), 1), (1, 1), (10, 5), (8, 5), (8, 5), (0, 2), (2, 2), (0, 4), (0, 4), (9, 4), (2, 7)]
        fields += [(20 + 28 * at, 8), (11 + 23 * at, 8), (0, 8), (1, 8)]
        if at:
            fields.append((position, 32))
        fields += [(2, 2), (0, 4), (15, 7), (127, 7)] + ([(4096, 27), (0, 1)] if at else [])
        fields += [(25, 6), (0, 2), (1, 1), (1, 2)] + ([(3, 8), (1, 1), (-5 & 4095, 12), (0, 2)] if at else [])
        self.packet(5, *fields)


def parsed(bits):
    return list(C.parse_packets(np.array(bits, np.uint8)))


def test_opening_example():
    (p,) = parsed([int(b) for b in OPENING_BITS])
    assert p["type"] == 5 and p["bits"] == 147 and p["checksum"] == 14
    b = p["body"]
    assert (b["orig_rate"], b["src_rate"], b["render_filter"], b["render_bitdepth"], b["auth_level"], b["item_count"]) == (10, 8, 8, 2, 9, 2)
    assert b["items"][0]["fields"] == {"stage2_dither": 2, "gain_index": 0, "level": 15, "lag": 127}
    assert b["items"][1]["fields"] == {"scale_index": 25, "carrier_class": 0, "variant": 1, "salt_select": 1}


def test_all_packet_types_round_trip():
    w = Writer()
    w.datasync()
    w.packet(0, (7, 4), raw=[1] * 7)
    w.packet(0, (15, 4), (300, 12), raw=[0, 1] * 150)
    w.packet(1, (64, 12), raw=[1, 0] * 32)
    w.packet(2, (5, 8), (33, 12), raw=[1] * 33)
    w.packet(4, (9, 4), raw=[1, 1, 0, 0] * 768)
    w.packet(6, (3, 12), raw=[1, 0, 1])
    w.packet(7, (4, 7), (1, 1), (0, 12), (2, 8), (0x636261, 24))
    w.packet(8, (40, 12), (0xDEADBEEF, 32), raw=[1] * 8)
    w.packet(3, (1024, 17))
    got = parsed(w.bits)
    assert [p["type"] for p in got] == [5, 0, 0, 1, 2, 4, 6, 7, 8, 3]
    assert got[4]["body"] == {"unknown": 5, "size": 33} and got[5]["body"]["auth_level"] == 9 and len(got[5]["body"]["data"]) == 384
    assert got[7]["body"]["data"] == b"abc" and got[8]["body"] == {"size": 40, "unknown": 0xDEADBEEF} and got[9]["body"] == {"bits_to_end": 1024}
    assert sum(p["bits"] for p in got) == len(w.bits)
    for cut in (80, 146, 147, 400):
        assert [p["type"] for p in parsed(w.bits[:cut])] == [p["type"] for p in got if p["offset"] + p["bits"] <= cut]


def test_positions_seed_the_checks():
    w = Writer()
    w.position = 70001
    w.datasync(70001)
    w.packet(3, (5, 17))
    first, last = parsed(w.bits)
    assert first["body"]["stream_position"] == 70001 and first["seed"] == 70001 & 15
    assert first["body"]["items"][1]["fields"]["offset"] == -5 and first["body"]["items"][0]["fields"]["start_pos"] == 4096
    assert last["body"] == {"bits_to_end": 5}


def test_a_loss_starts_a_new_session_behind_what_was_buffered():
    first = Writer()
    first.datasync()
    first.packet(1, (64, 12), raw=[1, 0] * 32)
    bits = list(first.bits)
    bits[147 + 30] ^= 1
    second = Writer()
    second.datasync()
    second.packet(3, (1, 17))
    bits += [0] * (1024 - len(bits)) + [1, 0, 1] + second.bits
    got = parsed(bits)
    assert [(p["session"], p["type"]) for p in got] == [(0, 5), (0, -1), (1, 5), (1, 3)]
    assert got[2]["base"] == 1027 and got[2]["offset"] == 0
    hidden = first.bits[:147] + [1] * 20 + second.bits  # within the buffered bits: it is not found
    assert [p["type"] for p in parsed(hidden + [0] * 900)] == [5, -1]


def test_streams_are_found_at_every_bit_and_tie_to_the_lowest(spark):
    rng = random.Random(3)
    rows = [(f, i, rng.randrange(-(1 << 23), 1 << 23), rng.randrange(-(1 << 23), 1 << 23)) for f in range(9) for i in range(120)]
    frames = spark.createDataFrame(rows, FRAMES)
    magic = "".join(str(C.MAGIC >> i & 1) for i in range(40))
    parts = [plant_bits(frames.where(F.col("file_id") == f), magic, F.lit(7 * f), 8 + f) for f in range(8)]
    tied = plant_bits(plant_bits(frames.where("file_id = 8"), magic, F.lit(30), 12), magic, F.lit(30), 10)
    everything = tied
    for p in parts:
        everything = everything.union(p)
    got = sorted(tuple(r) for r in C.find_streams(everything).collect())
    assert got == [(f, 7 * f, 8 + f) for f in range(8)] + [(8, 30, 10)]
    assert C.find_streams(frames).count() == 0


def test_scan_looks_at_the_first_frames_only(spark):
    frames = spark.createDataFrame([(0, i, 0, 0) for i in range(400)], FRAMES)
    late = plant_bits(frames, OPENING_BITS, F.lit(200), 11)
    assert [r.found for r in C.scan(late, 200).collect()] == [False]
    (row,) = C.scan(late, None).collect()
    assert (row.sync_frame, row.k, row.orig_rate, row.auth_level, row.studio) == (200, 11, 10, 9, True)


def test_metadata_keeps_the_last_blob(spark):
    rows = [(0, 5, 3, 1, 0, b"early"), (0, 10, 3, 0, 0, b"ab"), (0, 20, 3, 1, 1, b"cd"), (0, 30, 4, 0, 0, b"ef"), (0, 40, 4, 1, 0, b""), (1, 1, 2, 0, 1, b"\x00\xff")]
    frame = spark.createDataFrame(rows, "file_id bigint, offset bigint, metadata_type int, fragment_number int, is_last int, data binary")
    got = {r.file_id: (r.metadata_type, r.size, r.complete, bytes(r.data)) for r in C.metadata(frame).collect()}
    assert got == {0: (4, 2, False, b"ef"), 1: (2, 2, True, b"\x00\xff")}
