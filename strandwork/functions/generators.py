"""Position-only generators: congruential sequences, reseeded dithers, shift registers, checks.

The scrambler's generator is the reseeding generator applied twice, and the two channels take its even and odd terms,
so one table of affine powers (of bounded size, whatever the input) gives every term from its position alone: term j of
a block is powers[j + 1] applied to the block's seed, (salt + block)^2.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixedpoint import WORD, big, shr, times32, word

# Multiplier and increment of the two generators, salts of the consumers, register polynomials.
SCRAMBLER = (0x17385CA9, 0x47502932)
RESEED = (0x19660D, 0x3C6EF35F)
DESCRAMBLER_SALT = 0x2082352C
CRC32_POLY, CRC24_POLY, CRC2_POLY = 0xEDB88320, 0x8100C9, 3
RATE_BASES = (44100, 48000, 64000)
#: Frames between reseeds of the output dither, and batches of the descrambler in byte pairs.
DITHER_FRAMES, BATCH_PAIRS = 2048, 2048


def step(state: Column, constants: tuple[int, int] = SCRAMBLER) -> Column:
    """One step of a generator over words."""
    return word(word(state) * constants[0] + constants[1])


def powers(count: int, constants: tuple[int, int] = RESEED) -> list[tuple[int, int]]:
    """(a, c) such that n steps take x to a * x + c modulo 2^32, for n from 0 to count - 1."""
    out, (a, c) = [], (1, 0)
    for _ in range(count):
        out.append((a, c))
        a, c = a * constants[0] & WORD, (c * constants[0] + constants[1]) & WORD
    return out


def power_table(spark: SparkSession, count: int, constants: tuple[int, int] = RESEED) -> DataFrame:
    """powers() as a table (n, a, c), for broadcast: count is a constant of the operator."""
    return F.broadcast(spark.createDataFrame([(n, a, c) for n, (a, c) in enumerate(powers(count, constants))], "n bigint, a bigint, c bigint"))


def jumped(state: Column, a: Column, c: Column) -> Column:
    """The state after the steps that (a, c) stand for."""
    return word(times32(word(state), a) + c)


def block_seed(salt: Column | int, block: Column) -> Column:
    """(salt + block)^2 modulo 2^32: what a block's generators start from."""
    s = word(big(salt) + block)
    return times32(s, s)


def draw(state: Column, scale: Column | int) -> Column:
    """A dither draw: the high word of state * scale, from 0 to scale - 1."""
    return shr(big(state) * big(scale), 32)


def rate_hz(code: Column) -> Column:
    """The sample rate of a 5-bit rate code: a base (none for 3) times a power of two."""
    base = F.element_at(F.array(*map(F.lit, (*RATE_BASES, 0))), shr(code, 3).cast("int") + 1)
    return base.cast("bigint") * F.call_function("shiftleft", big(1), big(code).bitwiseAND(big(7)).cast("int"))


def rate_code(hz: Column) -> Column:
    """The first code that names a rate, 31 if none does."""
    codes = [(b << k, i << 3 | k) for i, b in enumerate(RATE_BASES) for k in range(8)]
    return F.coalesce(*(F.when(hz == rate, F.lit(code)) for rate, code in codes), F.lit(31)).cast("bigint")


def gain_index(index: Column) -> Column:
    """2 ** (index / 32) in Q15, for the low four bits of index."""
    return F.round(F.pow(F.lit(2.0), big(index).bitwiseAND(big(15)) / 32) * 32768).cast("bigint")


def register_table(poly: int) -> np.ndarray:
    """256 entries of a reflected shift register fed with zeros."""
    r = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        r = np.where(r & 1, r >> 1 ^ np.uint32(poly), r >> 1)
    return r


def register_walk(poly: int, start: int, count: int) -> np.ndarray:
    """The states of a register stepped a byte of zeros at a time: start, then count - 1 more."""
    table, out = register_table(poly).tolist(), []
    for _ in range(count):
        out.append(start)
        start = table[start & 255] ^ start >> 8
    return np.array(out, np.uint32)


def zero_steps(poly: int, steps: int, bits: int = 32) -> list[int]:
    """Where each single bit of a register goes in so many bit steps of zeros (the register is linear)."""
    out = []
    for b in range(bits):
        r = 1 << b
        for _ in range(steps):
            r = r >> 1 ^ poly if r & 1 else r >> 1
        out.append(r)
    return out


def linear(x: Column, images: list[int]) -> Column:
    """A linear map of a word over GF(2), from the images of its bits."""
    out = big(0)
    for b, image in enumerate(images):
        out = out.bitwiseXOR(shr(x, b).bitwiseAND(big(1)) * image)
    return out


def word_check(words: Column, start: Column | int = 0) -> Column:
    """The CRC-32 word register over array<bigint>: four zero bytes, then the word (which acts one word late)."""
    images = zero_steps(CRC32_POLY, 32)
    return F.aggregate(words, big(start), lambda acc, w: linear(acc, images).bitwiseXOR(word(w)))


def packet_check(bits: Column, seed: Column) -> Column:
    """The check nibble of a packet's bits (array of 0 and 1): fed bit by bit, padded to words with zeros."""
    pad = F.pmod(-F.size(bits), F.lit(32))
    zeros = F.array_repeat(F.lit(0), pad)

    def feed(acc: Column, bit: Column) -> Column:
        low = acc.bitwiseAND(big(1))
        return shr(acc, 1).bitwiseOR(big(bit) * (1 << 31)).bitwiseXOR(low * CRC2_POLY)

    return F.aggregate(F.concat(bits, zeros), big(seed), feed).bitwiseAND(big(15))


def message_check(data: Column, seed: Column) -> Column:
    """The check nibble of the bytes of a message after its first (array<bigint>), seeded with its offset."""
    images = register_table(CRC2_POLY).tolist()
    table = F.array(*[big(x) for x in images])

    def feed(acc: Column, byte: Column) -> Column:
        return word(big(byte) * (1 << 24)).bitwiseOR(shr(acc, 8)).bitwiseXOR(F.element_at(table, acc.bitwiseAND(big(255)).cast("int") + 1))

    return F.aggregate(data, word(seed), feed).bitwiseAND(big(15))


WALK_BLOCK = 4096


def walked(rows: DataFrame, poly: int, start: int, steps: str, out: str) -> DataFrame:
    """rows with `out`: the register's state after rows[steps] byte steps of zeros from `start`.

    The register is linear. Steps split into whole blocks, whose states are one table (a row for each 4096 steps of the
    longest walk), and the rest, whose linear maps are another (4096 rows, the images of 32 bits each).
    """
    spark = rows.sparkSession
    table = register_table(poly).astype(np.int64)
    images = np.array([1 << b for b in range(32)], np.int64)
    maps = []
    for _ in range(WALK_BLOCK):
        maps.append(images.tolist())
        images = table[images & 255] ^ images >> 8
    longest = rows.agg(F.max(steps)).first()[0] or 0
    states, state = [], start
    for h in range(longest // WALK_BLOCK + 1):
        states.append((h, state))
        state = int(np.bitwise_xor.reduce(images[[b for b in range(32) if state >> b & 1]], initial=0))
    rest = F.broadcast(spark.createDataFrame(list(enumerate(maps)), "__lo bigint, __maps array<bigint>"))
    whole = spark.createDataFrame(states, "__hi bigint, __state bigint")
    joined = rows.withColumns({"__hi": shr(F.col(steps), 12), "__lo": F.col(steps).bitwiseAND(big(WALK_BLOCK - 1))}).join(whole, "__hi").join(rest, "__lo")
    moved = F.zip_with(F.sequence(F.lit(0), F.lit(31)), F.col("__maps"), lambda b, image: F.getbit(F.col("__state"), b).cast("bigint") * image)
    return joined.withColumn(out, F.aggregate(moved, big(0), lambda acc, x: acc.bitwiseXOR(x))).drop("__hi", "__lo", "__state", "__maps")
