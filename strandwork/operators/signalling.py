"""Annotation: messages for a renderer in the parity of frames, and their read-back.

The register that spreads the changes runs on its own, and the message is a cycle of six records, so a frame's change
follows from its number alone: a table of the register's walk and one of the message's bits turn it into a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import generators as G
from ..functions.fixedpoint import big

# The changes by register and parity (left, right), the identifier record, the profiles.
CHANGES = ((0, 0), (0, 1), (0, 0), (1, 0), (0, 0), (0, -1), (0, 0), (-1, 0), (1, 1), (0, 1), (1, -1), (1, 0), (-1, -1), (0, -1), (-1, 1), (-1, 0))
IDENTIFIER, PROFILES = (0x8C, 0x49, 0xE0, 0xAB), (4, 8, 16)
UNKNOWN_STREAM = 31 << 20


def stream_word(render_filter: int, orig_rate: int, render_bitdepth: int, authenticated: bool) -> int:
    """The configuration word that the second record carries."""
    return render_filter & 31 | (256 if authenticated else 0) | (orig_rate & 31) << 20 | (render_bitdepth & 3) << 25


def stream_word_column(render_filter: Column, orig_rate: Column, render_bitdepth: Column, authenticated: Column) -> Column:
    return render_filter.bitwiseAND(big(31)) + F.when(authenticated, 256).otherwise(0) + orig_rate.bitwiseAND(big(31)) * (1 << 20) + render_bitdepth.bitwiseAND(big(3)) * (1 << 25)


def record_check(record: bytes) -> int:
    """The check byte: whole words fold in after four zero steps, single bytes one step each, then three more steps."""
    table, reg = G.register_table(G.CRC32_POLY).tolist(), 0
    whole = len(record) // 4 * 4

    def zero(r: int) -> int:
        return table[r & 255] ^ r >> 8

    for i in range(0, whole, 4):
        for _ in range(4):
            reg = zero(reg)
        reg ^= int.from_bytes(record[i : i + 4], "little")
    for b in record[whole:]:
        reg = table[reg & 255] ^ (reg >> 8 | b << 24)
    for _ in range(3):
        reg = zero(reg)
    return reg & 255


def message_cycle(config: int, config2: int = 0) -> bytes:
    """The records of one cycle with their checks."""
    bodies = [bytes([0, 4, *IDENTIFIER]), bytes([1, 4]) + config.to_bytes(4, "little"), bytes([2, 2]) + config2.to_bytes(2, "little"), *(bytes([4, 1, p]) for p in PROFILES)]
    return b"".join(b + bytes([record_check(b)]) for b in bodies)


def _carrying(frames: DataFrame, message_bytes: bytes) -> DataFrame:
    """frames whose parity carries the bytes over and over, highest bit first, from each file's frame 0 on."""
    bits = [b >> 7 - i & 1 for b in message_bytes for i in range(8)]
    table = F.array(*[F.struct(F.lit(a).cast("bigint").alias("l"), F.lit(b).cast("bigint").alias("r")) for a, b in CHANGES])
    message = F.element_at(F.array(*map(F.lit, bits)), (F.col("frame") % len(bits)).cast("int") + 1)
    carried = F.col("l").bitwiseXOR(F.col("r")).bitwiseXOR(message.cast("bigint")).bitwiseAND(big(1))
    rows = G.walked(frames, G.CRC24_POLY, 0xFFFFFFFF, "frame", "__walk")
    change = F.element_at(table, (F.col("__walk").bitwiseAND(big(14)) + carried + 1).cast("int"))
    return rows.withColumn("__c", change).withColumns({c: F.col(c) + F.col(f"__c.{c}") for c in "lr"}).drop("__c", "__walk")


def annotate(frames: DataFrame, config: int = UNKNOWN_STREAM) -> DataFrame:
    """frames that carry the message cycle of one stream."""
    return _carrying(frames, message_cycle(config))


def correct_parity(frames: DataFrame, segment: bytes = bytes([0, 4, *IDENTIFIER, 0x2C])) -> DataFrame:
    """frames that carry one record (by default the identifier with its check) over and over."""
    return _carrying(frames, segment[: segment[1] + 3])


def read_back(frames: DataFrame) -> DataFrame:
    """frames with `signal`, the message bit that a renderer reads."""
    return frames.withColumn("signal", F.col("l").bitwiseXOR(F.col("r")).bitwiseAND(big(1)))
