import random

import numpy as np
from strandwork.functions import generators as G
from strandwork.operators import kernels as K
from strandwork.operators import messages as M
from strandwork.operators import samples as S

from . import vectors as V

GAIN = K.Gain(203, 0x50B59897, 7)


def test_gain_of_a_scale():
    assert K.Gain.of(203) == GAIN
    assert S.gain_of_scale(203) == (GAIN.gain, GAIN.shift)
    assert S.level_gain(0) == -(1 << 31) and S.level_gain(1 << 16) == -(1 << 30)


def test_generators():
    a, c = G.powers(1001, G.SCRAMBLER)[1000]
    assert (a * 0x12345678 + c) & G.WORD == V.GENERATOR_JUMP_1000
    x, seen = 0x12345678, []
    for _ in range(8):
        x = (x * G.RESEED[0] + G.RESEED[1]) & G.WORD
        seen.append(x)
    assert seen == V.GENERATOR["nr_from_0x12345678"]
    assert seen[1::2] == V.GENERATOR["scrambler_from_0x12345678"][:4]


def test_symbols():
    coder = K.RangeReader(bytes((i * 37 + 11) & 255 for i in range(256)))
    s = K.Symbols(coder, coder, GAIN, 0x0BADC0DE, 0x10000000, (0xF000, 0xE100, 0xD2F0, 0xC5C1))
    assert s.decode(16) == V.SYMBOLS
    assert V.SYMBOLS_AFTER == {"level": s.level, "variance": s.variance, "rng": s.rng, "range": coder.range, "value": coder.value, "cursor": coder.cursor, "taps": s.taps}


def test_predictor():
    p = K.Predictor(GAIN, 0x1111, 0x2222)
    assert p.run([i * 12345 - 90000 for i in range(16)], [70000 - i * 9876 for i in range(16)]) == V.PREDICTOR["residuals"]
    assert [p.y1] == V.PREDICTOR["y1_prev_after"] and [p.y2h] == V.PREDICTOR["y2h_prev_after"]


def test_short_reconstruction():
    left, right, sign, out = K.ShortTap(), K.ShortTap(), 1, ([], [])
    for i in range(8):
        sign = -sign
        for ch, tap, x, p, d in ((0, left, i * 9931 % 50000 - 25000, i * 613 % 900 - 450, [j * 131 - 900 for j in (2 * i, 2 * i + 1)]), (1, right, i * 7717 % 40000 - 20000, i * 419 % 700 - 350, [700 - j * 77 for j in (2 * i, 2 * i + 1)])):
            out[ch].extend(tap.step(GAIN, sign, x, p, tuple(d)))
    assert list(out) == [V.SHORT["output_l"], V.SHORT["output_r"]]


def test_long_reconstruction():
    a = [i * 7919 % 100000 - 50000 for i in range(40)]
    b = [i * 104729 % 90000 - 45000 for i in range(40)]
    sign, out, taps = -1, ([], []), (K.LongTap(), K.LongTap())
    for i in range(16):
        taps[0].prime(a[i], None)
        taps[1].prime(b[i], None)
    for i in range(24):
        sign = -sign
        l, r = [(j * 2711) % 700 - 350 for j in (2 * i, 2 * i + 1)], [(j * 1949) % 500 - 250 for j in (2 * i, 2 * i + 1)]
        out[0].extend(taps[0].step(GAIN, sign, a[16 + i], V.LONG["residual_p"][i], tuple(l)))
        out[1].extend(taps[1].step(GAIN, sign, b[16 + i], V.LONG["residual_q"][i], tuple(r)))
    assert list(out) == [V.LONG["output_l"], V.LONG["output_r"]]


def test_bins_agree_both_ways():
    for x in range(-600000, 600000, 4096):
        entry = K.bin_of(x)
        code = K.bin_position(entry, x)
        if entry[3]:
            assert K.bin_by_code(code) == entry


def test_scrambler_bytes():
    a = [(i * 0x010203 - 0x400000) & 255 for i in range(16)]
    b = [(i * 0x030201 + 0x100000) & 255 for i in range(16)]
    raw = np.array([x for pair in zip(a, b, strict=True) for x in pair], np.uint8)
    assert (raw ^ M.scrambler_bytes(32)).tolist() == V.DESCRAMBLER["bytes_from_fresh_state"]
    whole = M.scrambler_bytes(10000)
    assert (M.scrambler_bytes(3000, 5000) == whole[5000:8000]).all()


def test_messages_round_trip():
    rng = random.Random(1)
    w = M.MessageWriter()
    w.record(25, bytes(i + 1 for i in range(8)), bytes(0x40 + i for i in range(32)))
    symbols, refine = bytes((i * 7 + 3) & 255 for i in range(255)), bytes(200 - i for i in range(64))
    w.message(5, symbols)
    w.sync(2, 25, 0xDEADBEEF)
    w.message(2, refine)
    w.sync(5, 25)
    w.idle(3)
    w.message(9, bytes(rng.randrange(256) for _ in range(40)))
    w.pad_to(1024)
    got = list(M.parse_messages(bytes(w.data)))
    assert [m["type"] for m in got[:8]] == [4, 5, 3, 2, 3, 0, 0, 0] and all(m["check_ok"] for m in got)
    assert got[0]["stream_id"] == M.MessageWriter.stream_id(25) and got[0]["part_a"] == bytes(range(1, 9)) and len(got[0]["part_b"]) == 32
    assert got[1]["payload"] == symbols and got[3]["payload"] == refine
    assert got[2]["word"] == 0xDEADBEEF and got[2]["kind"] == 2 and got[4]["flag"] == 0
    assert sum(1 + M.HEADER_REST.get(m["type"], 1) + m["size"] for m in got if m["type"] != 3) + 8 + 4 == 1024
    broken = bytearray(w.data)
    broken[60] ^= 1
    assert [m["check_ok"] for m in M.parse_messages(bytes(broken))] == [True, False]
    other = M.MessageWriter()
    other.record(25)
    other.sync(2, 26, 1)
    assert [m["mismatch"] for m in M.parse_messages(bytes(other.data))] == [False, True]
    assert list(M.parse_messages(b"\x05\x00")) == [] and list(M.parse_messages(b"")) == []
