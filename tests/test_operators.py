import numpy as np
import pytest
from pyspark.sql import functions as F
from strandwork.functions import fixedpoint as X
from strandwork.functions import generators as G
from strandwork.operators import control, generated, messages, render, samples, signalling
from strandwork.sources.synthetic import OPENING_BITS

from . import vectors as V

FRAMES = "file_id bigint, frame bigint, l bigint, r bigint"


def values(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def frames_of(spark, left, right):
    return spark.createDataFrame([(0, i, a, b) for i, (a, b) in enumerate(zip(left, right, strict=True))], FRAMES)


def test_fixed_point(spark):
    big = [F.lit(v).cast("bigint") for v in (2**31, -(2**31) - 1, 2**33 + 5, -1)]
    assert values(spark, *[X.wrap32(b) for b in big]) == [-(2**31), 2**31 - 1, 5, -1]
    pairs = [(0xFFFFFFFF, 0xFFFFFFFF), (0x12345678, 0x9ABCDEF0), (0, 7), (65536, 65537)]
    assert values(spark, *[X.times32(F.lit(a).cast("bigint"), F.lit(b).cast("bigint")) for a, b in pairs]) == [a * b & G.WORD for a, b in pairs]
    assert values(spark, X.hi32(-5, 7), X.clamp24(F.lit(-9000000))) == [-1, -8388608]


def test_rates_and_gains(spark):
    assert values(spark, *[G.rate_hz(F.lit(c)) for c in (0, 8, 10, 16, 24)], G.rate_code(F.lit(192000)), G.rate_code(F.lit(1))) == [44100, 48000, 192000, 64000, 0, 10, 31]
    assert values(spark, *[G.gain_index(F.lit(i)) for i in (0, 1, 15, 17)]) == [32768, 33486, 45348, 33486]
    assert values(spark, *[control.rate_name(F.lit(c)) for c in (0, 8, 10, 27)]) == ["44.1 kHz", "48 kHz", "192 kHz", "code 27"]
    assert [render.render_ratio(r, 48000) for r in (96000, 192000, 384000)] == [1, 2, 4]


def test_packet_check_of_the_opening_bits(spark):
    bits = F.array(*[F.lit(int(b)) for b in OPENING_BITS[:143]])
    assert values(spark, G.packet_check(bits, F.lit(0))) == [14]


def test_message_check_column_agrees_with_the_kernel(spark):
    data = [3, 255, 0, 17, 128]
    assert values(spark, G.message_check(F.array(*[F.lit(x).cast("bigint") for x in data]), F.lit(46))) == [messages.check_nibble(bytes(data), 46)]


def test_registers_walk_in_blocks(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 7, 4095, 4096, 4097, 9000)], "n bigint")
    walk = G.register_walk(G.CRC24_POLY, 0xFFFFFFFF, 9001)
    assert {r.n: r.s for r in G.walked(rows, G.CRC24_POLY, 0xFFFFFFFF, "n", "s").collect()} == {n: int(walk[n]) for n in (0, 1, 7, 4095, 4096, 4097, 9000)}


def test_annotation_and_read_back(spark):
    frames = frames_of(spark, [i * 37 - 4000 for i in range(64)], [900 - i * 11 for i in range(64)])
    marked = signalling.annotate(frames, signalling.stream_word(8, 10, 2, True)).orderBy("frame").collect()
    assert [r.l for r in marked][:48] == V.ANNOTATED["output_l"] and [r.r for r in marked][:48] == V.ANNOTATED["output_r"]
    read = signalling.read_back(signalling.correct_parity(frames)).orderBy("frame").collect()
    bits = [b >> 7 - i & 1 for b in (0, 4, 0x8C, 0x49, 0xE0, 0xAB, 0x2C) for i in range(8)]
    assert [r.signal for r in read] == [bits[i % 56] for i in range(64)]
    assert signalling.message_cycle(0)[6] == 0x2C


def test_rendering(spark):
    frames = frames_of(spark, V.RENDER["input_l"], V.RENDER["input_r"])
    plain = render.interpolate(frames, 2).orderBy("out_frame").collect()
    assert [r.l for r in plain][:48] == V.RENDER["plain_x2_l"] and [r.r for r in plain][:48] == V.RENDER["plain_x2_r"]
    shaped = render.requantise(render.interpolate(frames, 2, render.FILTER_8[2]), 2).orderBy("out_frame").collect()
    assert [r.l for r in shaped][:48] == V.RENDER["stream8_x2_l"] and [r.r for r in shaped][:48] == V.RENDER["stream8_x2_r"]
    assert render.interpolate(frames, 4).count() == 192 and render.interpolate(frames, 1).count() == 48


def test_run_in_and_float_samples(spark):
    frames = frames_of(spark, [1, 2], [3, 4])
    assert [(r.out_frame, r.l) for r in samples.run_in(frames, "hold").orderBy("out_frame").collect()] == [(0, 1), (1, 1), (2, 2), (3, 2)]
    with pytest.raises(ValueError):
        samples.run_in(frames, "other")
    assert values(spark, *[samples.float_sample(F.lit(x)) for x in (0.5, 2.0, -1.0, 1e-10)]) == [1 << 30, (1 << 31) - 1, -(1 << 31), 0]


def test_placed_values_are_the_nearest(spark):
    rng = np.random.default_rng(2)
    rows = [(int(s), int(b), int(t)) for s, b, t in zip(rng.integers(-8388608, 8388608, 300), rng.integers(0, 256, 300), rng.integers(0, 2, 300))] + [(8388607, 3, 1), (-8388608, 0, 0)]
    got = spark.createDataFrame(rows, "s bigint, b bigint, t bigint").select("*", samples.place(F.col("s"), F.col("b"), 9, F.col("t")).alias("p")).collect()
    for r in got:
        assert r.p & 255 == r.b and r.p >> 9 & 1 == r.t and r.p <= 8388607
        best = min(abs(r.s - (r.s // 1024 * 1024 + k * 1024 + r.t * 512 + r.b)) for k in (-1, 0, 1))
        assert abs(r.p - r.s) <= best or abs(r.s) > 8380000


def test_messages_come_back_through_the_channel(spark):
    w = messages.MessageWriter()
    w.record(25)
    w.message(5, b"abc" * 50)
    w.message(2, bytes(range(100)))
    w.pad_to(512)
    rows = [(0, i, b) for i, b in enumerate(w.wire())]
    data = generated.descramble(spark.createDataFrame(rows, "file_id bigint, offset bigint, byte bigint"))
    found = messages.messages(data, block=100)
    assert {(r.type, r.n) for r in messages.histogram(found).collect()} == {(0, 512 - 46 - 152 - 102), (2, 1), (4, 1), (5, 1)}
    assert {r.type: bytes(r.data) for r in messages.routed(found).collect()} == {5: b"abc" * 50, 2: bytes(range(100))}


def test_group_checks_act_one_word_late(spark):
    frames = frames_of(spark, [1, 0], [0, 0])
    step = G.zero_steps(G.CRC32_POLY, 32)[0]
    want = step
    for _ in range(2):
        want = int(np.bitwise_xor.reduce([im for b, im in enumerate(G.zero_steps(G.CRC32_POLY, 32)) if want >> b & 1]))
    assert [r.crc for r in generated.group_checks(frames).collect()] == [want]
