import numpy as np
import pytest
from strandwork.operators import control, decode, encode, kernels, messages
from strandwork.operators.conditioner import BitRing, Conditioner, Noise, lag_strength
from strandwork.operators.refine import DeltaPredictor, Quantiser

FRAMES = "file_id bigint, frame bigint, l bigint, r bigint"


def tones(n):
    t = np.arange(n)
    left = 0.45 * np.sin(0.011 * t) + 0.25 * np.sin(0.37 * t + 0.7) + 0.0002 * np.sin(1.9 * t + 1.9)
    right = 0.4 * np.sin(0.013 * t + 1) + 0.2 * np.sin(0.31 * t)
    return (8388607 * np.stack([left, right], axis=1)).astype(np.int64)


def decibels(error, signal):
    return 10 * np.log10((error.astype(float) ** 2).sum() / (signal.astype(float) ** 2).sum())


@pytest.fixture(scope="module")
def encoded():
    source = tones(2 * 4096 * 5 // 2)
    return source, encode.encode_frames(source)


def test_decoding_gives_the_source_back(encoded):
    source, carrier = encoded
    found = decode.decode_stream(carrier[:, 0], carrier[:, 1], 8, 8)
    out = np.array(found.pairs)
    assert found.frames == len(carrier) and out.shape == source.shape
    assert decibels(out[:512] - source[:512], source[:512]) < -20
    assert decibels(out[8192:] - source[8192:], source[8192:]) < -70


def test_resyncs_leave_decoding_as_it_is(monkeypatch):
    monkeypatch.setattr(encode, "TERMINATE_AHEAD", 0)
    source = tones(2 * 4096 * 5)
    carrier = encode.encode_frames(source, encode.Config(resync_blocks=2))
    bits = ((carrier[:, 0] ^ carrier[:, 1]) >> 8 & 1).astype(np.uint8)
    syncs = [p for p in control.parse_packets(bits) if p["type"] == 5]
    assert [p["body"]["stream_position"] for p in syncs] == [0, 2048, 10240]
    out = np.array(decode.decode_stream(carrier[:, 0], carrier[:, 1], 8, 8).pairs)
    assert decibels(out[8192:] - source[8192:], source[8192:]) < -70


def test_frames_around_a_stream_pass(encoded):
    _, carrier = encoded
    rng = np.random.default_rng(4)
    before, after = rng.integers(-1000, 1000, (100, 2)), rng.integers(-1000, 1000, (700, 2))
    whole = np.concatenate([before, carrier, after])
    pieces = list(decode.decode_file(whole[:, 0], whole[:, 1], 8))
    assert [(k, s, len(p)) for k, s, p in pieces] == [("passed", "ok", 100), ("decoded", "ok", 2 * len(carrier)), ("passed", "ok", 700)]
    assert pieces[0][2] == [tuple(x) for x in before.tolist()] and pieces[2][2] == [tuple(x) for x in after.tolist()]


def test_a_stream_that_is_cut_off_decodes_up_to_its_lookahead(encoded):
    _, carrier = encoded
    whole = decode.decode_stream(carrier[:, 0], carrier[:, 1], 8, 8)
    cut = decode.decode_stream(carrier[:6000, 0], carrier[:6000, 1], 8, 8)
    assert cut.frames == (6000 - 544) // 32 * 32 and cut.pairs == whole.pairs[: 2 * cut.frames]


def test_what_is_not_supported_is_declined_with_a_reason(encoded):
    _, carrier = encoded
    (piece,) = decode.decode_file(carrier[:, 0], carrier[:, 1], 0)
    assert piece[:2] == ("passed", "another rate than the file's") and len(piece[2]) == len(carrier)
    sync = next(control.parse_packets(((carrier[:, 0] ^ carrier[:, 1]) >> 8 & 1).astype(np.uint8)))["body"]
    sync["items"][1]["fields"]["carrier_class"] = 2
    with pytest.raises(decode.Declined, match="digits"):
        decode.opening_params(sync, 8, 8)
    sync["stream_pos_flag"] = 1
    with pytest.raises(decode.Declined, match="part way"):
        decode.opening_params(sync, 8, 8)


def test_a_broken_message_stops_corrections_only(encoded):
    source, carrier = encoded
    broken = carrier.copy()
    broken[5000, 0] ^= 1
    out = np.array(decode.decode_stream(broken[:, 0], broken[:, 1], 8, 8).pairs)
    assert len(out) == len(source)
    whole = np.array(decode.decode_stream(carrier[:, 0], carrier[:, 1], 8, 8).pairs)
    assert (out[:8000] == whole[:8000]).all() and not (out[12000:] == whole[12000:]).all()


def test_files_in_spark_and_the_report(spark):
    source = tones(4000)
    rows = [(f, i, int(a) >> f, int(b) >> f) for f in range(2) for i, (a, b) in enumerate(source)]
    frames = spark.createDataFrame(rows, FRAMES)
    out = decode.decode(encode.encode(frames))
    report = {r.file_id: r for r in encode.verify(frames, out).collect()}
    assert all(r.n_decoded == 3968 and r.n_passed == 0 and r.error_db < -20 for r in report.values())


def test_layer_and_extra(spark):
    rows = [(0, i, int(a), int(b)) for i, (a, b) in enumerate(tones(2400))]
    carrier = encode.encode(spark.createDataFrame(rows, FRAMES)).cache()
    out = decode.decode(carrier).orderBy("out_frame").collect()
    layer = decode.layer(carrier).orderBy("n").collect()
    assert len(layer) == carrier.count() == len(out) // 2 and any(r.p for r in layer)
    plain = decode.decode(carrier, baseline=True).orderBy("out_frame").collect()
    added = decode.extra(carrier).orderBy("out_frame").collect()
    assert [r.l for r in added] == [a.l - b.l for a, b in zip(out, plain, strict=True)] and any(r.l for r in added)


def test_backward_coder_is_read_forwards():
    rng = np.random.default_rng(12345)
    c, want = encode.BackwardCoder(), []
    for _ in range(3000):
        c.normalise()
        if rng.random() < 0.3:
            n = int(rng.integers(2, 4000))
            rest = int(rng.integers(0, n))
            c.divide(n, rest)
            want.append(("divide", n, rest))
        else:
            bits = int(rng.integers(1, 12))
            value = int(rng.integers(0, 1 << bits))
            c.field(bits, value)
            want.append(("field", bits, value))
    reader = kernels.RangeReader(c.finish() + bytes(8))
    for kind, x, y in want:
        reader.normalise()
        if kind == "field":
            assert reader.value & (1 << x) - 1 == y
            reader.range, reader.value = reader.range >> x, reader.value >> x
        else:
            quotient = reader.value * (0xFFFFFFFF // x) >> 32
            rest = reader.value - quotient * x
            assert (rest - x if rest >= x else rest) == y
            reader.range, reader.value = (0xFFFFFFFF // x * (reader.range - 1) >> 32) + 1, quotient


def test_analysis_inverts_the_filter():
    y = tones(2 * 600)[:, 0]
    carrier, split = encode.analyse(y, 500)
    tap, sign, out = kernels.ShortTap(), 1, []
    gain = kernels.Gain.of(1)
    for x, t in zip(np.rint(carrier).astype(int).tolist(), split.tolist(), strict=True):
        sign = -sign
        out += tap.step(kernels.Gain(2, 0x40000000, 0), sign, x, round(sign * (t - (x >> 1))), (0, 0))
    assert gain.scale == 1
    assert np.abs(np.array(out[100:900]) - y[100:900]).max() < 64


def test_packets_written_are_read():
    w = encode.PacketWriter()
    w.datasync(encode.Config())
    w.auth(9, bytes(range(256)) + bytes(128))
    w.metadata(3, bytes(300))
    for to in (2000, 2000 + 12, 2030, 2060, 6200, 10400, 10423, 10450):
        w.fill(max(to, len(w.bits)))
    w.terminate(len(w.bits) + 500)
    found = list(control.parse_packets(np.array(w.bits, np.uint8)))
    assert sum(p["bits"] for p in found) == len(w.bits) and all(p["type"] >= 0 for p in found)
    assert [p["body"]["size"] for p in found if p["type"] == 7] == [256, 44]
    end = found[-1]
    assert end["offset"] + end["bits"] + end["body"]["bits_to_end"] == len(w.bits) - end["bits"] + 500


def test_wrapping_keeps_the_upper_bits_and_opens_a_stream(spark):
    rows = [(0, i, int(a), int(b)) for i, (a, b) in enumerate(tones(900))]
    out = encode.wrap(spark.createDataFrame(rows, FRAMES)).orderBy("frame").collect()
    left, right = (np.array([getattr(r, c) for r in out]) for c in "lr")
    assert all(abs(r.l - x[2]) <= 256 and abs(r.r - x[3]) <= 128 for r, x in zip(out, rows, strict=True))
    data = np.stack([left & 255, right & 255], axis=1).astype(np.uint8).ravel() ^ messages.scrambler_bytes(1800)
    assert [m["type"] for m in messages.parse_messages(data.tobytes())] == [4] + [0] * (1800 - 46)
    assert [p["type"] for p in control.parse_packets(((left ^ right) >> 8 & 1).astype(np.uint8))][:3] == [5, 1, 3]


def written(total, config):
    """The container written from its first bit to its last: bits, and pairs of bytes."""
    writer, channel = encode.PacketWriter(), messages.MessageWriter()
    writer.datasync(config)
    channel.record(config.scale_index)
    if encode.TERMINATE_BITS < total - len(writer.bits) < 1 << 17:
        writer.terminate(total)
    writer.fill(total)
    channel.pad_to(2 * total)
    return np.array(writer.bits[:total]), np.frombuffer(channel.wire(), np.uint8)[: 2 * total].reshape(-1, 2)


def test_the_container_at_any_frames_is_the_one_written():
    for config in (encode.Config(), encode.Config(scale_index=7, auth_level=9)):
        container = encode.Container(config)
        for total in (1, 20, 23, 24, 150, *range(185, 260), *range(4119 + 165, 4119 + 260, 7), 40000, (1 << 17) + 100, (1 << 17) + 180, 140000):
            bits, pairs = written(total, config)
            frame = np.random.default_rng(total).permutation(total)
            assert (container.bits(frame, total) == bits[frame]).all() and (container.bytes(frame) == pairs[frame]).all()


def test_wrapping_sends_no_table_of_frames_to_the_driver(spark):
    """The lengths of files may be broadcast, the container of their frames may not, however short a list the files are."""
    from pyspark.sql import functions as F

    frames = spark.range(400_000).select((F.col("id") % 2).alias("file_id"), F.floor(F.col("id") / 2).alias("frame"), (F.col("id") * 37 % 65536).alias("l"), (F.col("id") * 91 % 65536).alias("r"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "6m")
    try:
        assert control.scan(encode.wrap(frames), None).where("found and sync_frame = 0").count() == 2
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_wrapping_keeps_files_apart_and_leaves_out_frames_that_are_none(spark):
    rows = [(f, i, 1000 * i, -70 * i) for f, n in ((0, 10), (1, 700), (2, 5000)) for i in range(n)]
    odd = [(0, 99, 5, 5), (0, None, 5, 5), (None, 0, 5, 5), (1, -1, 5, 5)]
    out = encode.wrap(spark.createDataFrame(rows + odd, FRAMES)).orderBy("file_id", "frame").collect()
    assert [(r.file_id, r.frame) for r in out] == [r[:2] for r in rows]
    for f, n in ((0, 12), (1, 701), (2, 5000)):
        bits, pairs = written(n, encode.Config())
        own = [r for r in out if r.file_id == f]
        assert [(r.l ^ r.r) >> 8 & 1 for r in own] == bits.tolist()[: len(own)]
        assert [[r.l & 255, r.r & 255] for r in own] == pairs.tolist()[: len(own)]


def test_conditioner_parts():
    ring = BitRing(8)
    for b in (1, 0, 1, 1):
        ring.append(b)
    assert ring.peek(4) == 13 and ring.behind() == 4
    ring.skip(6)
    assert ring.behind() == 6
    jumped, stepped = Noise(7), Noise(7)
    jumped.reseed(2, 5)
    stepped.reseed(2)
    for _ in range(5):
        stepped.draw()
    assert jumped.state == stepped.state
    assert lag_strength(0) == 0
    c = Conditioner(8, 2, 0, 256, 15 << 8, 0)
    a, b = c.run([1000 << 8] * 32, [-(1000 << 8)] * 32, BitRing())
    assert len(a) == 32 and c.count1 == c.count2 == 32 and not c.unsupported


def test_refinement_parts():
    p = DeltaPredictor(0)
    for d in (1, 0, 0, 0):
        p.push(d)
    assert p.next == p.taps[3] * 1
    q = Quantiser(203, -(1 << 28), 1, 3)
    assert q.radix_b == q.radix_a + 1 and q.k == 7
