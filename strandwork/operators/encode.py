"""Encoding: frames at twice the rate to carrier frames with both hidden channels, one pass a file.

A block of 4096 carrier frames is analysed (the short filter run backwards in time, so that it contracts), placed,
put through a model of the decoder, and corrected: refinement digits pull the carrier back, residual symbols carry the
split of each carrier sample. Coders decode forwards, so they are written backwards: operations are noted in order and
the bytes come out last first. A block's bytes are spread over its frames in sixteenths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import generators as G
from . import control, kernels, messages
from .conditioner import BitRing, Conditioner
from .decode import BLOCK, CHANNEL_SALTS, CLASS_BOUND, DECAY, GROUP, HIGHEST_VARIANCE, LEVEL_STEPS, RATE_STEPS, REFINE_SALT, SCALES, VARIANT_LEVEL
from .kernels import Gain, Predictor, Symbols, i32
from .refine import Refiner, Ring
from .samples import level_gain

#: Taps looked at beyond a block: to solve symbols, and to start the analysis.
WARM_SYMBOLS, WARM_TAPS = 32, 64
RATES = {base << k: i << 3 | k for i, base in reversed(list(enumerate(G.RATE_BASES))) for k in range(8)}
# How far a terminate packet may lie ahead, and where a resync and its sync lie before a block.
TERMINATE_AHEAD, TERMINATE_BITS = 65536, 25
RESYNC_LEAD, RESYNC_SYNC = 2048, 1024
REACH = 500_000


@dataclass(frozen=True)
class Config:
    """What a stream is to be."""

    src_rate: int = 48000
    orig_rate: int = 96000
    xbit: int = 0
    render_filter: int = 8
    render_bitdepth: int = 2
    gain_index: int = 0
    stage2_dither: int = 2
    level: int = 15
    scale_index: int = 25
    salt_select: int = 1
    resync_blocks: int = 16
    auth_info: int = 0
    auth_level: int = 0


class PacketWriter:
    """Control packets as bits, each with its check."""

    def __init__(self) -> None:
        self.bits: list[int] = []
        self.ended = False

    def packet(self, kind: int, *fields: tuple[int, int], raw: list[int] | None = None) -> None:
        own = [b for value, n in ((kind, 4), *fields) for b in ((value >> i) & 1 for i in range(n))] + (raw or [])
        reader = control.Bits(np.array(own, np.uint8), 0, len(self.bits) & 15)
        while reader.pos < len(own):
            reader.take(min(32, len(own) - reader.pos))
        reader.zeros(-len(own) % 32)
        self.bits += own + [reader.check >> i & 1 for i in range(4)]

    def hole(self, size: int) -> None:
        fields = ((size, 4),) if size < 15 else ((15, 4), (size, 12))
        self.packet(0, *fields, raw=[0] * size)

    def fill(self, to: int) -> None:
        """Holes up to a position; a gap too short for one is passed by up to eleven bits."""
        while len(self.bits) < to:
            room = to - len(self.bits)
            if room < 12:
                self.hole(0)
            elif room < 27:
                self.hole(room - 12)
            elif room < 39:
                self.hole(0)
            else:
                self.hole(min(4095, room - 24))

    def datasync(self, c: Config, at: int = 0, consumed: int = 0) -> None:
        """A datasync, with a position if `at` is given, and the empty reconstruction packet that has to follow it."""
        extra = (28, 21) if at else (0, 0)
        fields = [(control.MAGIC >> 4, 36), (int(at > 0), 1), (1, 1), (RATES[c.orig_rate], 5), (RATES[c.src_rate], 5), (c.render_filter, 5), (0, 2), (c.render_bitdepth, 2), (0, 4), (c.auth_info, 4), (c.auth_level, 4), (2, 7)]
        fields += [(20 + extra[0], 8), (11 + extra[1], 8), (0, 8), (1, 8)] + ([(len(self.bits), 32)] if at else [])
        fields += [(c.stage2_dither, 2), (c.gain_index, 4), (c.level, 7), (127, 7)] + ([(at // GROUP, 27), (0, 1)] if at else [])
        fields += [(c.scale_index, 6), (0, 2), (1, 1), (c.salt_select, 2)] + ([(255, 8), (consumed & 1, 1), (consumed // 2 - at & 4095, 12)] if at else [])
        self.packet(5, *fields)
        self.packet(1, (0, 12))

    def terminate(self, total: int) -> None:
        self.packet(3, (total - len(self.bits) - TERMINATE_BITS, 17))
        self.ended = True

    def auth(self, level: int, data: bytes = bytes(384)) -> None:
        """An authentication packet; what a signer gives, or zeros, which claim nothing."""
        self.packet(4, (level, 4), *((b, 8) for b in data))

    def metadata(self, kind: int, data: bytes) -> None:
        """A blob in fragments of up to 256 bytes."""
        pieces = [data[i : i + 256] for i in range(0, max(len(data), 1), 256)]
        for n, piece in enumerate(pieces):
            self.packet(7, (kind, 7), (int(n == len(pieces) - 1), 1), (n, 12), (len(piece) - 1, 8), *((b, 8) for b in piece))


class CannotCode(ValueError):
    """Values that the coder's state cannot carry."""


class BackwardCoder:
    """Notes what a range decoder will do, and then finds the bytes that make it do so."""

    def __init__(self) -> None:
        self.start()

    def start(self) -> None:
        self.range, self.value, self.steps = 1, 0, []

    def normalise(self) -> None:
        while self.range <= 0xFFFFFF:
            self.steps.append(("byte", 0, 0))
            self.range *= 256

    def field(self, bits: int, value: int) -> None:
        self.steps.append(("field", bits, value & (1 << bits) - 1))
        self.range >>= bits

    def narrow(self, lo: int, hi: int) -> None:
        self.steps.append(("narrow", lo, hi - lo))
        self.range = ((self.range - hi >> 19) + 1) * (hi - lo)

    def divide(self, n: int, rest: int) -> None:
        self.steps.append(("divide", n, rest))
        self.range = (G.WORD // n * (self.range - 1) >> 32) + 1

    @staticmethod
    def _divided(quotient: int, n: int, rest: int) -> int:
        """A value whose quotient and rest, by the reciprocal, are these: the quotient can come out one low."""
        for extra in range(3):
            value = (quotient + extra) * n + rest
            got = value * (G.WORD // n) >> 32
            left = value - got * n
            if got == quotient and (left - n if left >= n else left) == rest:
                return value
        raise CannotCode("no value divides so")

    def finish(self) -> bytes:
        value, out = 0, bytearray()
        for kind, x, y in reversed(self.steps):
            if kind == "byte":
                out.append(value & 255)
                value >>= 8
            elif kind == "field":
                value = value << x | y
            elif kind == "narrow":
                if value // y >= 1 << 13:
                    raise CannotCode("state too large for an interval")
                value = value // y << 19 | x + value % y
            else:
                value = self._divided(value, x, y)
        if value:
            raise CannotCode("a block that does not start empty")
        return bytes(reversed(out))


class ChosenSymbols(Symbols):
    """The symbol decoder with its reads turned into choices towards targets."""

    def encode(self, targets: list[int]) -> list[int]:
        self.targets, self.done = targets, 0
        return self.decode(len(targets), True)

    def _candidate(self, k: int, dither: int, draw: int) -> tuple | None:
        """(begin, lo, hi, low residual, high residual) of one lattice index, if it can be coded."""
        begin = i32(self.level * (dither + 256 * k))
        end = i32(begin + self.level * 256)
        if not (-REACH <= begin <= REACH and -REACH <= end <= REACH):
            return None
        lo, hi = kernels.interval(begin, end)
        if hi <= lo or self.coder.range < hi:
            return None
        low, top = self._bounds(begin, draw)[2:]
        return (begin, lo, hi, low, top) if top > low else None

    def _magnitude(self, dither: int, draw: int) -> tuple[int, int]:
        target = self.targets[self.done]
        self.done += 1
        back = self._gridded(i32(-sum(self._forecast())))
        away, scale = target - draw - back, self.gain.scale
        self.want = (abs(away) + scale // 2) // scale * (1 if away >= 0 else -1) if scale else 0
        reach = 600_000 // max(256 * self.level, 256) + 2
        tried: dict[int, tuple | None] = {}

        def candidate(k: int) -> tuple | None:
            if k not in tried:
                tried[k] = self._candidate(k, dither, draw)
            return tried[k]

        def above(k: int) -> bool:
            c = candidate(k)
            return c[3] + c[4] >= 2 * self.want if c else k >= 0

        # The first index above what is wanted, searched outwards from where the scale puts it.
        middle = ((self.want * scale + draw) << 16) // max(self.variance, 1) // max(self.level, 1)
        lo, hi, step = -reach, reach, 1
        k = min(max((middle - 128 - dither) // 256 + 1, lo), hi)
        while lo < hi:
            if above(k):
                hi = k
                k = max(hi - step, lo) if step else (lo + hi) // 2
            else:
                lo = k + 1
                k = min(k + step, hi - 1) if step else (lo + hi) // 2
            step = step * 2 if step and step < 8 else 0

        def cost(c: tuple) -> tuple[int, int]:
            outside = max(c[3] + 1 - self.want, self.want - c[4], 0)
            return outside, abs(2 * self.want - c[3] - c[4])

        near = [c for k in (lo - 1, lo, lo + 1, 0) if (c := candidate(k))]
        if not near:
            raise CannotCode("no magnitude can be coded")
        begin, *codes = min(near, key=cost)[:3]
        self.coder.narrow(*codes)
        return begin, kernels.bin_of(begin)[4] + kernels.bin_of(i32(begin + 256 * self.level))[4]

    def _inside(self, low: int, top: int) -> int:
        r = max(low + 1, min(top, self.want))
        if top - low > 1:
            self.coder.normalise()
            self.coder.divide(top - low, top - r)
        return r


class ResidualWriter:
    """Residual layers of blocks to symbol bytes, and what a decoder makes of them."""

    def __init__(self, scale_index: int) -> None:
        self.coder, self.record = BackwardCoder(), Gain.of(SCALES[scale_index])
        self.records = [[ChosenSymbols(self.coder, self.coder, self.record, 0, 0x10000000, DECAY, 0xE6) for _ in range(2)] for _ in range(2)]
        self.predictors = [Predictor(self.record, 0, 0) for _ in range(2)]
        self.counter = 0

    def _solve(self, c: int, want: list[int], pairs: int, total: int) -> tuple[list[int], list[int]]:
        """Symbols that make the predictor give `want`, from the last pair to the first."""
        gain, scale = self.record, self.record.scale
        noise = list(self.predictors[c].noise)
        k0, k1, k2 = (k / 4294967296 for k in (kernels.K0, kernels.K1, kernels.K2))

        def near(x: int) -> int:
            return (abs(x) + scale // 2) // scale * scale * (1 if x >= 0 else -1)

        terms = []
        for i in range(total):
            dx, dy = (n * scale >> 32 for n in noise)
            noise = [(n * G.SCRAMBLER[0] + G.SCRAMBLER[1]) & G.WORD for n in noise]
            whole, odd = want[2 * i] + want[2 * i + 1], want[2 * i + 1]
            y1 = dx + gain.to_grid(i32(near(whole - dx)))
            h2 = dy - (y1 >> 1) + near(odd - dy)
            terms.append((dx + near(whole - dx), h2, y1, dy - (y1 >> 1) + gain.to_grid(i32(h2 - dy + (y1 >> 1)))))
        a, b = float(terms[-1][0]), float(terms[-1][1])
        out_a, out_b = [0] * pairs, [0] * pairs
        for i in range(total - 1, 0, -1):
            ea, eb = a - terms[i - 1][2], b - terms[i - 1][3]
            a, b = terms[i][0] - k1 * eb - k0 * ea, terms[i][1] - k2 * ea - k0 * eb
            if i - 1 < pairs:
                out_a[i - 1], out_b[i - 1] = int(a), int(b)
        return out_a, out_b

    def _begin(self, symbols: list[tuple[list[int], list[int]]]) -> None:
        block, bound = self.counter // BLOCK, 4 * CLASS_BOUND
        self.coder.normalise()
        self.coder.field(3, 0)
        floor = 8 * 256 * self.record.scale // bound
        for c, salt in enumerate(CHANNEL_SALTS):
            for i, r in enumerate(self.records[c]):
                size = (sum(s * s for s in symbols[c][i]) / max(len(symbols[c][i]), 1)) ** 0.5
                ladder = [((LEVEL_STEPS[n & 3] << (n >> 2)) >> 8, n) for n in range(HIGHEST_VARIANCE + 1)]
                fits = [v for v in ladder if v[0] <= max(int(size / 2 + 1), floor) and v[0] < 2 * r.variance]
                variance, low = max(fits, key=lambda v: (v[0], -v[1]), default=(1, 0))
                r.rng = (salt + block + 32 * (i + 1)) ** 2 & G.WORD
                r.rate, r.level = RATE_STEPS[0], LEVEL_STEPS[0] if block else 0x200
                self.coder.normalise()
                self.coder.field(11 if block else 7, low)
                r.variance, r.limits = variance, (bound >> 2, bound)
                if self.counter == 0:
                    r.level = bound

    def block(self, layers: list[list[int]], taps: int) -> tuple[bytes, list[list[int]]]:
        pairs = taps // 2
        self.coder.start()
        block = self.counter // BLOCK
        for c, salt in enumerate(CHANNEL_SALTS):
            seed = salt + block
            first = ((seed * seed & G.WORD) * G.RESEED[0] + G.RESEED[1]) & G.WORD
            self.predictors[c].noise = [first, (first * G.RESEED[0] + G.RESEED[1]) & G.WORD]
        symbols = [self._solve(c, layers[c], pairs, len(layers[c]) // 2) for c in range(2)]
        self._begin(symbols)
        got: list[list[int]] = [[], []]
        for at in range(0, pairs, GROUP // 2):
            for c in range(2):
                a, b = (self.records[c][i].encode(symbols[c][i][at : at + GROUP // 2]) for i in range(2))
                got[c] += self.predictors[c].run(a, b)
            self.counter += GROUP
        return self.coder.finish(), got


class RefineWriter(Refiner):
    """The refiner with its digits chosen towards a wanted carrier."""

    def __init__(self, gain: int, param: int, index: int, step: int) -> None:
        super().__init__(Ring(1), gain, param, index, REFINE_SALT)
        self.set_step(step)
        self.digits: list[tuple[int, int]] = []
        self.wanted: list[float] = []

    def toward(self, a: list[int], b: list[int], want_a: np.ndarray, want_b: np.ndarray) -> tuple[list[int], list[int]]:
        self.wanted = [*want_a.tolist(), *want_b.tolist()]
        self.wanted.reverse()
        return self.group(a, b)

    def _choose(self, c, at: int, first: bool | None) -> int:
        s = self.quantiser
        radix = s.radix_a if first else s.radix_b
        top = radix << c.coarse_bits if first is None else radix
        symbol = max(0, min(int((at - self.wanted.pop()) / self.step + 0.5), top - 1))
        self.digits += [(1 << c.coarse_bits, symbol // radix), (radix, symbol % radix)] if first is None else [(radix, symbol)]
        return symbol

    def finish(self) -> bytes:
        """The block's bytes, last first: one is shed wherever the state passes what a decoder holds."""
        value, out = 16, bytearray()
        for i in range(len(self.digits) - 1, -1, -1):
            radix, symbol = self.digits[i]
            value = value * radix + symbol
            while value >= 4096 or i == 0 and value:
                out.append(value & 255)
                value >>= 8
        self.digits = []
        return bytes(reversed(out))


def analyse(y: np.ndarray, taps: int) -> tuple[np.ndarray, np.ndarray]:
    """(carrier, split) that the short filter would turn into the frames y (two for each tap), solved backwards."""
    total = len(y) // 2
    halves = []
    for off, (a, b) in enumerate(((kernels.C[0], kernels.C[1]), (kernels.C[2], kernels.C[3]))):
        own = y[off::2].astype(float).tolist()
        a, b = a / 4294967296, b / 4294967296
        x = [0.0] * total
        late, later = own[total - 1], own[total - 2]
        for i in range(total - 1, 1, -1):
            x[i - 2] = own[i] - 2 * (a * (late - own[i - 2]) + b * (later - own[i - 1]))
            late, later = later, x[i - 2]
        halves.append(np.array(x[:taps]))
    return halves[0] + halves[1], halves[1]


class Encoder:
    """Source frames (24-bit pairs at twice the carrier's rate) to carrier frames."""

    def __init__(self, config: Config, total: int) -> None:
        self.config, self.total = config, total
        self.packets, self.channel = PacketWriter(), messages.MessageWriter()
        self.packets.datasync(config)
        self.channel.record(config.scale_index)
        rate = RATES[config.src_rate]
        root = round(2 ** ((config.gain_index & 15) / 32) * 32768)
        gain2 = root >> 7 - config.xbit or 256 << config.xbit
        self.conditioner = Conditioner(rate, config.stage2_dither, config.xbit, gain2, config.level << 8, 0)
        gain = -level_gain(0x30000 - (config.level << 8) + VARIANT_LEVEL[1])
        self.refiner = RefineWriter(gain, 1 << config.xbit, min(3, (rate & 7) * 3 + (rate >> 3)), SCALES[config.scale_index])
        self.model_gain = -2.0 * self.conditioner.gain / 4294967296 * (gain2 / 256) * 16.0 * gain / 4294967296
        self.residuals, self.sign, self.at, self.ring = ResidualWriter(config.scale_index), 1, 0, BitRing()

    def _reserve(self, to: int) -> None:
        bits = self.packets
        if not bits.ended and self.total > len(bits.bits) + TERMINATE_BITS and self.at + TERMINATE_AHEAD + 2 * BLOCK >= self.total:
            bits.terminate(self.total)
        bits.fill(to)

    def _resync(self, boundary: int) -> None:
        """A point to join at the next block: its datasync goes into this one, its (empty) marker into the model."""
        bits, place, at = self.packets, boundary - RESYNC_LEAD, boundary - RESYNC_SYNC
        if len(bits.bits) > place or bits.ended or boundary + TERMINATE_BITS + TERMINATE_AHEAD + BLOCK >= self.total:
            return
        bits.fill(place)
        bits.datasync(self.config, at, 2 * boundary)
        self.conditioner.set_marker(at, [0])

    def _pace(self, refinement: bytes, symbols: bytes, taps: int) -> None:
        base = len(self.channel.data)
        self.channel.sync(5, self.config.scale_index)
        for n in range(1, 17):
            for kind, data in ((2, refinement), (5, symbols)):
                share = data[len(data) * (n - 1) // 16 : len(data) * n // 16]
                for i in range(0, len(share), messages.PAYLOAD):
                    self.channel.message(kind, share[i : i + messages.PAYLOAD])
            self.channel.pad_to(base + 2 * taps * n // 16)

    def block(self, source: np.ndarray, taps: int) -> np.ndarray:
        """Carrier frames (without data bytes) of one block; source holds its frames and those that follow."""
        solve = min(taps + 2 * WARM_SYMBOLS, len(source) // 2)
        carrier, split = zip(*(analyse(source[:, c], solve) for c in range(2)), strict=True)
        c = self.config
        if c.resync_blocks and taps == BLOCK and (self.at + taps) // BLOCK % c.resync_blocks == 1 % c.resync_blocks:
            self._resync(self.at + taps)
        self._reserve(self.at + taps)
        ideal = np.stack([x[:taps] / self.model_gain for x in carrier], axis=1)
        whole = np.trunc(ideal + np.where(ideal < 0, -0.5, 0.5)).astype(np.int64)
        k = 8 + c.xbit
        right = place(whole[:, 1], 128, 8, np.zeros(taps, np.int64))
        bits = np.array(self.packets.bits[self.at : self.at + taps], np.int64)
        left = place(whole[:, 0], 128, k + 1, (bits ^ right >> k & 1) << k)
        modelled: list[list[int]] = [[], []]
        for at in range(0, taps, GROUP):
            a, b = self.conditioner.run((left[at : at + GROUP] & ~255).tolist(), (right[at : at + GROUP] & ~255).tolist(), self.ring)
            a, b = self.refiner.toward(a, b, carrier[0][at : at + len(a)], carrier[1][at : at + len(a)])
            modelled[0] += a
            modelled[1] += b
        layers = []
        signs = np.where(np.arange(solve) % 2 == 0, -self.sign, self.sign)
        for ch in range(2):
            real = np.array([*modelled[ch], *np.trunc(carrier[ch][taps:solve]).astype(np.int64).tolist()], np.int64)
            p = signs * (split[ch] + (real - carrier[ch]) / 2 - (real >> 1))
            layers.append(np.trunc(p + np.where(p < 0, -0.5, 0.5)).astype(np.int64).tolist())
        symbols, _ = self.residuals.block(layers, taps)
        self._pace(self.refiner.finish(), symbols, taps)
        if taps % 2:
            self.sign = -self.sign
        self.at += taps
        return np.stack([left, right], axis=1)


def place(s: np.ndarray, byte: int, low_bits: int, wanted: np.ndarray) -> np.ndarray:
    """The nearest values whose low byte is `byte` and whose `low_bits` low bits else are `wanted`; of two the lower."""
    step = 1 << low_bits
    inside = (s & -step) + wanted + byte
    below = np.where(inside > s, inside - step, inside)
    above = below + step
    near = np.where(s - below <= above - s, below, above)
    return np.where(above > 8388607, below, np.where(below < -8388607, above, near))


def encode_frames(source: np.ndarray, config: Config = Config()) -> np.ndarray:
    """Carrier frames of source frames (n x 2, 24-bit, at twice the rate); a remainder under a group is left out."""
    taps = len(source) // 2 // GROUP * GROUP
    if not taps:
        return np.empty((0, 2), np.int64)
    padded = np.concatenate([source, np.zeros((2 * (2 * WARM_SYMBOLS + WARM_TAPS) + 64, 2), np.int64)])
    encoder, out = Encoder(config, taps), []
    for at in range(0, taps, BLOCK):
        n = min(BLOCK, taps - at)
        out.append(encoder.block(padded[2 * at : 2 * (at + n + 2 * WARM_SYMBOLS + WARM_TAPS)], n))
    frames = np.concatenate(out)
    encoder.channel.pad_to(2 * taps)
    wire = np.frombuffer(encoder.channel.wire(), np.uint8)[: 2 * taps].reshape(-1, 2).astype(np.int64)
    return frames & ~255 | wire


def encode(frames: DataFrame, config: Config = Config()) -> DataFrame:
    """(file_id, frame, l, r): carrier frames of whole files at twice the rate, each file one ordered pass."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = encode_frames(frame.sort_values("frame")[["l", "r"]].to_numpy().astype(np.int64), config)
        return pd.DataFrame({"file_id": int(frame["file_id"].iat[0]), "frame": range(len(out)), "l": out[:, 0], "r": out[:, 1]})

    return frames.groupBy("file_id").applyInPandas(run, "file_id bigint, frame bigint, l bigint, r bigint")


class Container:
    """Both channels of a stream that carries nothing, at any frames: their number and the file's length determine them.

    Behind its head the control channel is holes of one size, which differ in their checks only, and a shorter rest.
    """

    HOLE = 4095 + 24

    def __init__(self, config: Config) -> None:
        self.config, self.known = config, {}
        channel = messages.MessageWriter()
        channel.record(config.scale_index)
        self.record = np.frombuffer(bytes(channel.data), np.uint8)
        self.checks = np.array([self._behind(seed, self.HOLE)[-4:] for seed in range(16)])

    @staticmethod
    def _behind(at: int, room: int) -> np.ndarray:
        """The bits that fill so much room from a position on; they depend on its low four bits."""
        writer = PacketWriter()
        writer.bits = [0] * (at & 15)
        writer.fill(room + (at & 15))
        return np.array(writer.bits[at & 15 :], np.int64)

    def _ends(self, total: int) -> tuple[np.ndarray, int, np.ndarray]:
        """The head's bits, the number of whole holes, the bits behind them."""
        if total not in self.known:
            if len(self.known) > 256:
                self.known.clear()
            writer = PacketWriter()
            writer.datasync(self.config)
            if TERMINATE_BITS < total - len(writer.bits) < 1 << 17:
                writer.terminate(total)
            head = np.array(writer.bits, np.int64)
            holes = max(0, total - len(head)) // self.HOLE
            at = len(head) + holes * self.HOLE
            self.known[total] = head, holes, self._behind(at, total - at)
        return self.known[total]

    def bits(self, frame: np.ndarray, total: int) -> np.ndarray:
        head, holes, rest = self._ends(total)
        at = frame - len(head)
        hole, inside = np.divmod(at, self.HOLE)
        out = ((inside >= 4) & (inside < 20)).astype(np.int64)
        check = inside >= self.HOLE - 4
        out[check] = self.checks[(len(head) + hole * self.HOLE)[check] & 15, (inside - self.HOLE + 4)[check]]
        out[at < 0] = head[frame[at < 0]]
        behind = (at >= 0) & (hole >= holes)
        out[behind] = rest[(at - holes * self.HOLE)[behind]]
        return out

    def bytes(self, frame: np.ndarray) -> np.ndarray:
        """The two bytes of each frame (n x 2): the record, then idle messages of a byte each, under the scrambler."""
        at = 2 * frame[:, None] + np.arange(2)
        data = ((at & 15) << 4).astype(np.uint8)
        first = at < len(self.record)
        data[first] = self.record[at[first]]
        return (data ^ messages.scrambler_at(at)).astype(np.int64)


def wrap(frames: DataFrame, config: Config = Config()) -> DataFrame:
    """Existing carrier frames (file_id, frame, l, r) as a stream that carries nothing: the container, placed by columns.

    Frames are met by the length of their file only, a row for each file, so no table of frames is joined.
    """
    from pyspark.sql import functions as F

    from .samples import place_frame

    @F.pandas_udf("bit bigint, left bigint, right bigint")
    def channels(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        container = Container(config)
        for at, totals in batches:
            frame, total = at.to_numpy().astype(np.int64), totals.to_numpy()
            bits, pair = np.zeros(len(frame), np.int64), container.bytes(frame)
            for n in np.unique(total).tolist():
                bits[total == n] = container.bits(frame[total == n], n)
            yield pd.DataFrame({"bit": bits, "left": pair[:, 0], "right": pair[:, 1]})

    sizes = frames.groupBy("file_id").agg(F.count(F.lit(1)).alias("__n"))
    rows = frames.select("file_id", "frame", "l", "r").join(sizes, "file_id").where((F.col("frame") >= 0) & (F.col("frame") < F.col("__n")))
    rows = rows.withColumn("__c", channels("frame", "__n"))
    return place_frame(rows, 8 + config.xbit, F.col("__c.bit"), F.col("__c.left"), F.col("__c.right")).select("file_id", "frame", "l", "r")


def verify(source: DataFrame, decoded: DataFrame) -> DataFrame:
    """(file_id, n_decoded, n_passed, error_db): how far decoded frames lie from their source, in dB of its power."""
    from pyspark.sql import functions as F

    names = {c: f"{c}0" for c in "lr"}
    pairs = decoded.join(source.select("file_id", F.col("frame").alias("out_frame"), *[F.col(c).alias(n) for c, n in names.items()]), ["file_id", "out_frame"], "left")
    power = sum((F.pow(F.col(n).cast("double"), F.lit(2.0)) for n in names.values()), F.lit(0.0))
    error = sum((F.pow((F.col(c) - F.col(n)).cast("double"), F.lit(2.0)) for c, n in names.items()), F.lit(0.0))
    good = F.col("kind") == "decoded"
    rows = pairs.groupBy("file_id").agg(F.count_if(good).alias("n_decoded"), F.count_if(~good).alias("n_passed"), F.sum(F.when(good, error)).alias("e"), F.sum(F.when(good, power)).alias("p"))
    return rows.select("file_id", "n_decoded", "n_passed", (10 * F.log10(F.col("e") / F.col("p"))).alias("error_db"))
