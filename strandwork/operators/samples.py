"""Operators of single frames: frames in, frames with more columns out. Everything stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixedpoint import big, bit_at, hi32, shr, times32, word, wrap32

# Levels, digits for a byte, and reciprocal word of the carrier classes.
CLASS_LEVELS, CLASS_DIGITS, CLASS_RECIPROCALS = (1, 3, 4, 8), (1, 5, 4, 2), (0, 0x55555556, 0x40000000, 0x20000000)
DIGIT_BIAS = 0x690000
FULL = 8388607


def control_bit(k: int, l: str = "l", r: str = "r") -> Column:
    """The control bit that a frame carries if the channel lies at bit k."""
    return bit_at(F.col(l).bitwiseXOR(F.col(r)), k)


def low_bytes(frames: DataFrame) -> DataFrame:
    """The data bytes of every frame, and the samples without them."""
    cut = {f"{c}_byte": F.col(c).bitwiseAND(big(255)) for c in "lr"} | {f"{c}_cleared": F.col(c).bitwiseAND(big(-256)) for c in "lr"}
    return frames.withColumns(cut)


def digit(sample: Column, shift: int, cls: int) -> Column:
    """The carrier digit of a sample: its remainder in the class's base, by the reciprocal's fraction."""
    v = word(shr(sample, shift + 8) + DIGIT_BIAS)
    return shr(times32(v, CLASS_RECIPROCALS[cls]) * CLASS_LEVELS[cls], 32)


def digits(frames: DataFrame, cls: int, shift: int = 0) -> DataFrame:
    """(file_id, n, digit): left then right digit of every frame, n counting both."""
    pair = F.array(*[F.struct(F.lit(i).cast("bigint").alias("ch"), digit(F.col(c), shift, cls).alias("digit")) for i, c in enumerate("lr")])
    return frames.select("file_id", "frame", F.explode(pair).alias("d")).select("file_id", (F.col("frame") * 2 + F.col("d.ch")).alias("n"), "d.digit")


def digit_bytes(found: DataFrame, cls: int) -> DataFrame:
    """(file_id, n, byte): digits packed from n = 0 on, the highest first; an unfilled last byte is left out."""
    per, base = CLASS_DIGITS[cls], CLASS_LEVELS[cls]
    place = F.pow(F.lit(float(base)), per - 1 - F.col("n") % per).cast("bigint")
    packed = found.groupBy("file_id", F.floor(F.col("n") / per).alias("byte_n")).agg(F.sum(F.col("digit") * place).alias("byte"), F.count(F.lit(1)).alias("have"))
    return packed.where(F.col("have") == per).select("file_id", F.col("byte_n").alias("n"), F.col("byte").bitwiseAND(big(255)).alias("byte"))


def dither_round(x: Column, noise: Column) -> Column:
    """x rounded to a multiple of 256 with the noise byte as subtractive dither, the noise put back."""
    return wrap32((x + 128 - noise).bitwiseAND(big(-256)) + noise)


def fold(out: Column, taken: Column, full: int) -> tuple[Column, Column]:
    """(value, folded): near full scale an output is turned back towards the input it came from; bit 9 is cleared."""
    o, i, sign = (x.bitwiseAND(big(-512)) for x in (big(out), big(taken), shr(out, 31)))
    over = wrap32(wrap32(i * 2 - o).bitwiseXOR(sign) - full)
    folded = over > 0
    return F.when(folded, wrap32(out + over.bitwiseXOR(sign))).otherwise(big(out)).bitwiseAND(big(-513)), folded


def gain_step(x: Column, gain: int, shift: int, scale: int) -> Column:
    """scale * ((gain * x) >> (32 + shift)), the last product wrapping."""
    return wrap32(shr(hi32(gain, x), shift) * scale)


def gain_of_scale(scale: int) -> tuple[int, int]:
    """(gain, shift) of a scale of 1 or more: the shift is floor(log2(scale - 1)), 0 for scales up to 2."""
    shift = max(0, (scale - 1).bit_length() - 1)
    return (1 << 32 + shift) // (2 * scale), shift


def level_gain(level: int) -> int:
    """2 ** (-level / 65536) in Q31 by its quadratic approximation."""
    frac, exponent = level << 16 & 0xFFFFFFFF, level >> 16
    t = 0x55555555 * frac >> 32
    total = t + 0x80000000 - ((t * frac >> 32) >> 2) & 0xFFFFFFFF
    signed = total - (1 << 32) if total >> 31 else total
    return signed >> exponent


def refine_scaled(x: Column, gain: int) -> Column:
    """A carrier sample scaled for refinement."""
    return hi32(wrap32(big(x) * 16), gain)


def place(sample: Column, byte: Column, k: int | None = None, bit: Column | None = None) -> Column:
    """The 24-bit value nearest to sample whose low byte is `byte` (and whose bit k is `bit`); of two the lower."""
    step = 256 if k is None else 1 << k + 1
    wanted = big(byte).bitwiseAND(big(255)) + (big(0) if k is None else big(bit).bitwiseAND(big(1)) * (1 << k))
    inside = big(sample).bitwiseAND(big(-step)) + wanted
    below = F.when(inside > sample, inside - step).otherwise(inside)
    above = below + step
    return F.when(above > FULL, below).when(below < -FULL, above).when(sample - below <= above - sample, below).otherwise(above)


def place_frame(frames: DataFrame, k: int, bit: Column, left: Column, right: Column) -> DataFrame:
    """frames with data bytes in both samples and a control bit in bit k of their difference."""
    moved = frames.withColumn("r", place(F.col("r"), right))
    return moved.withColumn("l", place(F.col("l"), left, k, big(bit).bitwiseXOR(bit_at(F.col("r"), k))))


def pair_ring(frames: DataFrame, gain: int, depth: int = 16) -> DataFrame:
    """frames with `ring`: the scaled pairs of the last `depth` frames, oldest first, zeros before the first."""
    order = Window.partitionBy("file_id").orderBy("frame")
    scaled = frames.withColumns({f"p{c}": shr(F.col(c) * gain, 16) for c in "lr"})
    lags = [F.struct(*[F.lag(f"p{c}", n, 0).over(order).cast("bigint").alias(c) for c in "lr"]) for n in range(depth - 1, -1, -1)]
    return scaled.withColumn("ring", F.array(*lags)).drop("pl", "pr")


def headroom(frames: DataFrame, measured_at: int = 0) -> DataFrame:
    """(file_id, peak, index): the largest magnitude of a file's carrier, measured at one gain index, and the first
    index (15 if none) whose gain, in steps of 1/256, brings it under 0.999 of full scale; 0 for silence."""
    gains = [round(2 ** (i / 32) * 32768) >> 7 for i in range(16)]
    fits = [F.when(F.col("peak") / (g / gains[measured_at]) <= FULL * 0.999, F.lit(i)) for i, g in enumerate(gains)]
    found = frames.groupBy("file_id").agg(F.max(F.greatest(F.abs("l"), F.abs("r"))).alias("peak"))
    return found.withColumn("index", F.when(F.col("peak") <= 0, 0).otherwise(F.coalesce(*fits, F.lit(15))).cast("bigint"))


def auth_blocks(frames: DataFrame, size: int = 65536, window: int = 327680) -> DataFrame:
    """(file_id, block, n_frames, complete, until_end): tumbling blocks of frames and how long each one vouches for."""
    block = shr(F.col("frame"), size.bit_length() - 1)
    found = frames.groupBy("file_id", block.alias("block")).agg(F.count(F.lit(1)).alias("n_frames"))
    done = F.col("n_frames") == size
    return found.select("file_id", "block", "n_frames", done.alias("complete"), F.when(done, F.lit(window)).otherwise(0).cast("bigint").alias("until_end"))


def indicator(auth_byte: Column, until_end: Column, needed: Column) -> Column:
    """How a stream authenticated: 3 studio, 2 signed, 5 unsigned, 0 where the window ends too early."""
    return F.when(until_end < needed, 0).when(auth_byte > 143, 3).when(auth_byte <= 15, 5).otherwise(2).cast("bigint")


def run_in(frames: DataFrame, policy: str) -> DataFrame:
    """Frames before a stream is known: `hold` repeats each one, `drop` drops them, `raw` passes them as they are."""
    if policy == "hold":
        return frames.select("file_id", "frame", "l", "r", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("copy")).select("file_id", (F.col("frame") * 2 + F.col("copy")).alias("out_frame"), "l", "r")
    if policy == "drop":
        return frames.where(F.lit(False)).select("file_id", F.col("frame").alias("out_frame"), "l", "r")
    if policy == "raw":
        return frames.select("file_id", F.col("frame").alias("out_frame"), "l", "r")
    raise ValueError(f"unknown policy {policy!r}")


def float_sample(x: Column) -> Column:
    """A float sample as a 32-bit integer: clamped to one, rounded half to even."""
    scaled = F.rint(F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)) * 2147483648.0)
    return F.least(scaled, F.lit(2147483647.0)).cast("bigint")


