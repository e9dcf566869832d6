"""Whole-stream decoding: carrier frames and their hidden channels to frames at twice the rate, one pass a file.

The prescribed order of effects is kept without buffers. The control channel runs 512 frames ahead of the group it
acts on, and the data channel 480 frames, so both are parsed whole first; each packet item and each message then takes
effect at the group that could first have seen it. What is left is three recurrences in a row over groups of 32 frames:
conditioning, refinement with residuals, reconstruction. Frames outside a stream pass as they are, marked `passed`.

Carrier class 0 is supported with both filters. Other classes, streams joined part way, and whatever else the format
reserves are declined with a reason in `status`; such frames pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import generators as G
from . import control, messages
from .conditioner import BitRing, Conditioner, lag_strength
from .kernels import Gain, LongTap, Predictor, RangeReader, ShortTap, Symbols, i16
from .refine import Refiner
from .samples import level_gain

# Scales by index, level and rate steps, salts of the stages, offsets of the refinement level by filter.
SCALES = (
    0, 1, 2, 4, 8, 11, 16, 21, 25, 32, 35, 41, 45, 51, 57, 64, 71, 81, 91, 101, 115, 128, 143, 161, 181, 203, 229, 256, 287, 323, 363, 407,
    457, 512, 575, 645, 725, 813, 913, 1024, 1149, 1291, 1449, 1625, 1825, 2048, 2299, 2581, 2897, 3251, 3649, 4096, 4597, 5161, 5793, 6501, 7299, 8192, 9195, 10321, 11585, 13003, 14597, 16384,
)
LEVEL_STEPS, RATE_STEPS = (256, 304, 362, 431), (4176, 4256, 4416, 4704)
CHANNEL_SALTS, REFINE_SALT = (0xA1E24BBA, 0xA1E24CBA), 0x3895AFE1
DITHER_SALTS = {0: 0, 1: 0xF807B7DF, 2: 0xE9D30005, 3: 0xE9D30005}
VARIANT_LEVEL = {1: -0x10000, 0: -0x95AE}
CLASS_BOUND = 0x29
DECAY = (0xF000, 0xE100, 0xD2F0, 0xC5C1)
NEUTRAL = Gain(2, 0x40000000, 0)
GROUP, BLOCK, AHEAD, SEEN = 32, 4096, 480, 512
HIGHEST_VARIANCE = 0x5B


class Declined(Exception):
    """A stream that needs a path that is not implemented; the reason is the text."""


@dataclass
class Params:
    """What the opening packet says."""

    rate_code: int
    level: int
    lag: int
    dither_mode: int
    gain2: int
    shift: int
    scale_index: int
    variant: int
    salt_select: int
    markers: dict[int, list[tuple[int, list[int]]]] = field(default_factory=dict)


def _nr(x: int) -> int:
    return (x * G.RESEED[0] + G.RESEED[1]) & G.WORD


def opening_params(sync: dict, k: int, rate_code: int) -> Params:
    """Parameters of a stream from the body of its first packet and the bit k that it lies in."""
    if sync["stream_pos_flag"]:
        raise Declined("joined part way")
    if sync["src_rate"] != rate_code:
        raise Declined("another rate than the file's")
    items = {i["type"]: i["fields"] for i in sync["items"]}
    if 0 not in items or 1 not in items:
        raise Declined("no parameters")
    base, low = items[0], items[1]
    if low["carrier_class"]:
        raise Declined("a carrier class with digits")
    shift = k - 8
    root = round(2 ** ((base["gain_index"] & 15) / 32) * 32768)
    gain2 = root >> 7 - shift or 256 << shift
    lag = 0
    if base["lag"] != 127:
        lag = max(0, (base["lag"] << 8) + (base["level"] << 8) - lag_strength((root >> 7 - shift) << 8 - shift))
    return Params(rate_code, base["level"] << 8, lag, base["stage2_dither"], gain2, shift, low["scale_index"], low["variant"], low["salt_select"])


class ResidualChannel:
    """Two symbol records and a predictor of one channel."""

    def __init__(self, coder: RangeReader, salt: int, scale: int) -> None:
        self.coder, self.salt = coder, salt
        self.records = [Symbols(coder, coder, Gain(0, 0, 0), 0, 0x10000000, DECAY, 0xE6, scale=scale) for _ in range(2)]
        self.predictor = Predictor(NEUTRAL, 0, 0)

    def begin_block(self, block: int, rate: int) -> bool:
        """Read the block's levels; whether they make sense."""
        seed = self.salt + block
        self.predictor.noise[0] = _nr(seed * seed & G.WORD)
        self.predictor.noise[1] = _nr(self.predictor.noise[0])
        fine = True
        for i, r in enumerate(self.records):
            r.rng = (seed + 32 * (i + 1)) ** 2 & G.WORD
            self.coder.normalise()
            v = self.coder.bits(11 if block else 7)
            r.level, r.rate, low = 0x200, rate, v & 127
            if block:
                r.level = LEVEL_STEPS[-(v >> 7) & 3] >> ((v >> 7) + 3 >> 2)
            variance = (LEVEL_STEPS[low & 3] << (low >> 2)) >> 8
            fine &= low <= HIGHEST_VARIANCE and variance < 2 * r.variance
            r.variance = variance
        return fine

    def run(self, count: int, on: bool, with_residual: bool) -> list[int]:
        a, b = (r.decode(count, with_residual) if on else [0] * count for r in self.records)
        return self.predictor.run(a, b)


class Residuals:
    """The residual stage of class 0: everything comes from the symbol bytes of the data channel."""

    def __init__(self, data: bytes, scale_index: int) -> None:
        self.coder = RangeReader(data or b"\0")
        self.scale_index, self.record = scale_index, Gain.of(SCALES[scale_index])
        self.channels = [ResidualChannel(self.coder, s, self.record.scale) for s in CHANNEL_SALTS]
        self.counter, self.mode, self.fresh, self.seek, self.index, self.spread = 0, 0, False, -1, (0, 0), 0
        self.on = False

    def configure(self, indices: tuple[int, int], start: int, part_a: bytes = b"") -> None:
        self.index, self.seek, self.fresh = indices, start, True
        if self.mode == 0:
            self.mode = 1
            if len(part_a) == 8 and self.counter == 0:
                for c, ch in enumerate(self.channels):
                    ch.predictor.before = [self.record.scale * i16(int.from_bytes(part_a[4 * c + 2 * i : 4 * c + 2 * i + 2], "little")) for i in range(2)]

    def _reset(self) -> None:
        self.mode, self.on = 0, False
        for ch in self.channels:
            for r in ch.records:
                r.gain = Gain(0, r.gain.gain, r.gain.shift)
            ch.predictor.gain = NEUTRAL

    def _distribute(self) -> None:
        own = self.index == (self.scale_index, self.scale_index)
        gains = [self.record if i == self.scale_index else Gain(0, self.record.gain, self.record.shift) if i == 0 else Gain.of(SCALES[i]) for i in self.index]
        for ch in self.channels:
            for r, g in zip(ch.records, gains, strict=True):
                r.gain = g
            ch.predictor.gain = self.record if own else NEUTRAL
        if self.seek >= 0:
            self.coder.cursor = self.seek % len(self.coder.data)
        self.fresh = False

    def _begin_block(self) -> None:
        if self.mode == 0:
            return
        c = self.coder
        c.value, c.range = 0, 1
        self.mode, self.on = 2, True
        c.normalise()
        v = c.bits(3)
        self.spread = CLASS_BOUND >> 1 if v & 4 else 0
        fine = [ch.begin_block(self.counter // BLOCK, RATE_STEPS[v & 3]) for ch in self.channels]
        if not all(fine):
            self._reset()

    def group(self, count: int) -> tuple[list[int], list[int]]:
        if self.counter % BLOCK == 0:
            if self.fresh:
                self._distribute()
            self._begin_block()
        for ch in self.channels:
            for r, bound in zip(ch.records, (4 * CLASS_BOUND - self.spread, 4 * CLASS_BOUND + self.spread), strict=True):
                r.limits = (bound >> 2, bound)
                if self.counter == 0:
                    r.level = bound
        out = [ch.run(count // 2, self.on, self.mode == 2) for ch in self.channels]
        self.counter += GROUP
        return out[0], out[1]


class Output:
    """Dithered reconstruction of refined frames."""

    def __init__(self, params: Params) -> None:
        self.long = params.variant == 0
        shape = min(3, (params.rate_code & 7) * 3 + (params.rate_code >> 3))
        self.taps = [LongTap(shape), LongTap(shape)] if self.long else [ShortTap(), ShortTap()]
        self.sign, self.skip = (-1, 8) if self.long else (1, 0)
        self.gain, self.salt = Gain.of(SCALES[params.scale_index]), DITHER_SALTS[params.salt_select]
        self.counter, self.noise = 0, [0, 0]

    def history(self, part_b: bytes) -> None:
        """Start the short filter from the record's samples."""
        if self.long:
            return
        words = np.frombuffer(part_b.ljust(32, b"\0")[:32], "<i4").tolist()
        for tap, w in zip(self.taps, (words[:4], words[4:]), strict=True):
            tap.resume([w[1], w[0]], [w[3], w[2]])

    def _dither(self) -> list[tuple[int, int]]:
        if self.counter % G.DITHER_FRAMES == 0:
            self.noise[0] = _nr((self.salt + self.counter // G.DITHER_FRAMES) ** 2 & G.WORD)
            self.noise[1] = _nr(self.noise[0])
        self.counter += 1
        if self.salt == 0:
            return [(0, 0), (0, 0)]
        out: list[tuple[int, int]] = []
        for ch in range(2):
            pair = []
            for _ in range(2):
                pair.append(self.noise[ch] * self.gain.scale >> 32)
                self.noise[ch] = (self.noise[ch] * G.SCRAMBLER[0] + G.SCRAMBLER[1]) & G.WORD
            out.append((pair[0], pair[1]))
        return out

    def group(self, a: list[int], b: list[int], p: list[int], q: list[int]) -> list[tuple[int, int]]:
        out = []
        for x, y, u, v in zip(a, b, p, q, strict=True):
            if self.skip:
                self.taps[0].prime(x, u)
                self.taps[1].prime(y, v)
                self.skip -= 1
                if not self.skip and self.counter == 0:
                    for tap in self.taps:
                        tap.settle()
                continue
            dl, dr = self._dither()
            self.sign = -self.sign
            left = self.taps[0].step(self.gain, self.sign, x, u, dl)
            right = self.taps[1].step(self.gain, self.sign, y, v, dr)
            out += [tuple(max(-0x800000, min(0x7FFFFF, s)) for s in pair) for pair in zip(left, right, strict=True)]
        return out


def _marker_words(item: dict, bits: np.ndarray) -> list[int]:
    """The bits of a positioned item beyond its 48 bits of fields, as words."""
    extra = bits[48 : item["size"]].tolist()
    return [sum(b << i for i, b in enumerate(extra[at : at + 32])) for at in range(0, max(len(extra), 1), 32)][:6]


def control_effects(found: list[dict], bits: np.ndarray) -> tuple[list[int], int | None, dict[int, list[tuple[int, list[int]]]]]:
    """(payload bits, end of the stream, markers by the channel bit at which they are known) of the first session."""
    payload: list[int] = []
    end, markers = None, {}
    for p in (p for p in found if p["session"] == 0 and p["type"] >= 0):
        if p["type"] == 1:
            payload += bits[p["offset"] + 16 : p["offset"] + 16 + p["body"]["size"]].tolist()
        elif p["type"] == 3:
            end = p["position"] + p["bits"] + p["body"]["bits_to_end"]
        elif p["type"] == 5 and p["body"]["stream_pos_flag"]:
            for item in p["body"]["items"]:
                if item["type"] == 0:
                    at = item["fields"]["start_pos"] * 32
                    markers.setdefault(item["ready"], []).append((at, _marker_words(item, bits[item["ready"] - item["size"] : item["ready"]])))
    return payload, end, markers


def message_effects(data: bytes) -> tuple[bytes, bytes, list[tuple[int, str, dict]]]:
    """(symbol bytes, refinement bytes, effects as (group, kind, values)) of the data channel."""
    symbols, refinement, effects = bytearray(), bytearray(), []
    for n, m in enumerate(messages.parse_messages(data)):
        end = m["offset"] + 1 + (m["size"] + messages.HEADER_REST.get(m["type"], 1) if m["type"] != 3 else 0)
        group = max(0, -(-(-(-end // 2) - AHEAD) // GROUP))
        if m["mismatch"]:
            effects.append((group, "end", {}))
            break
        if m["type"] == 4:
            symbols.clear()
            refinement.clear()
            effects.append((group, "record", m))
        elif m["type"] == 5:
            symbols += m["payload"][: messages.PAYLOAD]
        elif m["type"] == 2:
            refinement += m["payload"][: messages.PAYLOAD]
        elif m["type"] == 3 and n > 3 and m.get("kind") in (2, 5):
            effects.append((group, "sync", m | {"symbols": len(symbols), "refinement": len(refinement)}))
        if not m["check_ok"]:
            effects.append((group, "lost", {}))
            break
    return bytes(symbols), bytes(refinement), effects


class _Bytes:
    """Refinement bytes read in order; past the end come zeros."""

    def __init__(self, data: bytes) -> None:
        self.data, self.cursor = data, 0

    def take(self) -> int:
        self.cursor += 1
        return self.data[self.cursor - 1] if self.cursor <= len(self.data) else 0


@dataclass
class Decoded:
    """One stream: output pairs, how many carrier frames they stand for, and the residual layer if asked for."""

    pairs: list[tuple[int, int]]
    frames: int
    layer: list[tuple[int, int]]


def decode_stream(left: np.ndarray, right: np.ndarray, k: int, rate_code: int, baseline: bool = False) -> Decoded:
    """Decode a stream that opens at frame 0; its end is announced, or 544 frames before the input's.

    baseline: with the same parameters and dither, but neither residuals nor refinement.
    """
    bits = ((left ^ right) >> k & 1).astype(np.uint8)
    found = list(control.parse_packets(bits))
    if not found or found[0]["type"] != 5:
        raise Declined("no opening packet")
    params = opening_params(found[0]["body"], k, rate_code)
    if not any(p["type"] == 1 and p["offset"] + 4 <= SEEN for p in found):
        raise Declined("not aligned")
    payload, end, markers = control_effects(found, bits)
    total = len(left)
    announced = end is not None and end <= total
    if not announced:
        end = max(0, (total - (SEEN + GROUP)) // GROUP * GROUP)
    heard = end if announced else total
    data = np.stack([left[:heard] & 255, right[:heard] & 255], axis=1).astype(np.uint8).ravel()
    symbols, refinement, effects = message_effects((data ^ messages.scrambler_bytes(len(data))).tobytes())

    ring = BitRing(max(len(payload) + 64, 64))
    for b in payload:
        ring.append(b)
    conditioner = Conditioner(params.rate_code, params.dither_mode, params.shift, params.gain2, params.level, params.lag)
    index = min(3, (rate_code & 7) * 3 + (rate_code >> 3))
    gain = level_gain(0x30000 - params.level + VARIANT_LEVEL[params.variant])
    refiner = Refiner(_Bytes(refinement), -gain, 1 << params.shift, index, REFINE_SALT)
    residuals, output = Residuals(symbols, params.scale_index), Output(params)
    out, layer, carriers = [], [], []
    pending = sorted(markers.items())
    for at in range(0, end, GROUP):
        while pending and pending[0][0] <= at + SEEN:
            for position, words in pending.pop(0)[1]:
                if at < position:
                    conditioner.set_marker(position, words)
        a, b = ((x[at : min(at + GROUP, end)] & ~255).tolist() for x in (left, right))
        carriers.append(conditioner.run(a, b, ring))
        if conditioner.unsupported:
            raise Declined("ramping")
    for n, (a, b) in enumerate(carriers):
        while effects and effects[0][0] <= n:
            kind, m = effects[0][1:]
            effects.pop(0)
            if kind == "record":
                ident = m["stream_id"]
                refiner.counter = 0
                if not baseline:
                    refiner.ask(SCALES[ident >> 6 & 63], 0)
                residuals.configure((ident >> 12 & 63, ident >> 18 & 63), -1, m["part_a"])
                output = Output(params)
                if not messages._same_stream(ident, messages.MessageWriter.stream_id(params.scale_index)):
                    output.gain = Gain.of(3)
                output.history(m["part_b"])
            elif kind == "sync" and m["kind"] == 2:
                refiner.counter = n * GROUP
                if not baseline:
                    refiner.ask(SCALES[m["stream_id"] >> 6 & 63], m["refinement"])
            elif kind == "sync":
                residuals.configure((m["stream_id"] >> 12 & 63, m["stream_id"] >> 18 & 63), m["symbols"])
            elif kind == "lost":
                refiner.lose()
            else:
                return Decoded(out, n * GROUP, layer)
        a, b = refiner.group(a, b)
        p, q = ([0] * GROUP, [0] * GROUP) if baseline else residuals.group(len(a))
        layer += list(zip(p, q, strict=True))[: len(a)]
        out += output.group(a, b, p[: len(a)], q[: len(a)])
    return Decoded(out, end, layer)


def decode_file(left: np.ndarray, right: np.ndarray, rate_code: int, baseline: bool = False, layer: bool = False) -> Iterator[tuple[str, str, list[tuple[int, int]]]]:
    """(kind, status, pairs) pieces of a whole file: `passed` frames as they are, `decoded` ones at twice the rate.

    layer: pieces of kind `layer` follow the decoded ones, the residuals of each carrier frame.
    """
    magic = bytes(control.MAGIC >> i & 1 for i in range(32))
    at, total = 0, len(left)
    while at < total:
        difference = left[at:] ^ right[at:]
        hits = [(p, k) for k in control.BITS if (p := (difference >> k & 1).astype(np.uint8).tobytes().find(magic)) >= 0]
        start, k = min(hits, default=(total - at, 8))
        if start:
            yield "passed", "ok", list(zip(left[at : at + start].tolist(), right[at : at + start].tolist(), strict=True))
            at += start
        if at >= total:
            return
        try:
            found = decode_stream(left[at:], right[at:], k, rate_code, baseline)
        except Declined as e:
            yield "passed", str(e), list(zip(left[at:].tolist(), right[at:].tolist(), strict=True))
            return
        if not found.frames:
            yield "passed", "too short", list(zip(left[at:].tolist(), right[at:].tolist(), strict=True))
            return
        yield "decoded", "ok", found.pairs
        if layer:
            yield "layer", "ok", found.layer
        at += found.frames


def _pieces(frames: DataFrame, rate_code: int, baseline: bool, kinds: tuple[str, ...]) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("frame")
        left, right = (frame[c].to_numpy().astype(np.int64) for c in "lr")
        rows = [(kind, status, *pair) for kind, status, pairs in decode_file(left, right, rate_code, baseline, "layer" in kinds) if kind in kinds for pair in pairs]
        out = pd.DataFrame(rows, columns=["kind", "status", "l", "r"])
        out["file_id"], out["out_frame"] = int(frame["file_id"].iat[0]), range(len(out))
        return out[["file_id", "out_frame", "l", "r", "kind", "status"]]

    return frames.groupBy("file_id").applyInPandas(run, "file_id bigint, out_frame bigint, l bigint, r bigint, kind string, status string")


def decode(frames: DataFrame, rate_code: int = 8, baseline: bool = False) -> DataFrame:
    """(file_id, out_frame, l, r, kind, status) of whole files (file_id, frame, l, r): each file is one ordered pass."""
    return _pieces(frames, rate_code, baseline, ("passed", "decoded"))


def layer(frames: DataFrame, rate_code: int = 8) -> DataFrame:
    """(file_id, n, p, q): the residual layer of each file's streams, a row for each carrier frame decoded."""
    found = _pieces(frames, rate_code, False, ("layer",))
    return found.selectExpr("file_id", "out_frame as n", "l as p", "r as q")


def extra(frames: DataFrame, rate_code: int = 8) -> DataFrame:
    """(file_id, out_frame, l, r): what the hidden channel adds: decoded frames less the baseline's."""
    whole = decode(frames, rate_code).where("kind = 'decoded'")
    plain = decode(frames, rate_code, True).where("kind = 'decoded'").selectExpr("file_id", "out_frame", "l as bl", "r as br")
    return whole.join(plain, ["file_id", "out_frame"]).selectExpr("file_id", "out_frame", "l - bl as l", "r - br as r")
