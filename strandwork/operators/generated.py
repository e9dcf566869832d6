"""Operators that need nothing but positions: descrambling, output dither, checks over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import generators as G
from ..functions.fixedpoint import big, shr, word


def channel_bytes(frames: DataFrame) -> DataFrame:
    """(file_id, offset, byte): the raw low bytes in channel order, left then right."""
    pair = F.array(F.col("l"), F.col("r"))
    rows = frames.select("file_id", "frame", F.posexplode(pair).alias("ch", "x"))
    return rows.select("file_id", (F.col("frame") * 2 + F.col("ch")).alias("offset"), F.col("x").bitwiseAND(big(255)).alias("byte"))


def descramble(data: DataFrame) -> DataFrame:
    """Channel bytes with the scrambler's byte taken off (or put on: it is its own inverse).

    Byte i of a batch of 4096 is hidden under the top byte of term i + 1 from the batch's seed.
    """
    batch = 2 * G.BATCH_PAIRS
    table = G.power_table(data.sparkSession, batch + 1)
    rows = data.withColumn("n", F.col("offset") % batch + 1).join(table, "n")
    state = G.jumped(G.block_seed(G.DESCRAMBLER_SALT, F.floor(F.col("offset") / batch).cast("bigint")), F.col("a"), F.col("c"))
    return rows.select("file_id", "offset", F.col("byte").bitwiseXOR(shr(state, 24)).alias("byte"))


def output_dither(frames: DataFrame, salt: int, scale: int) -> DataFrame:
    """(file_id, frame, l0, l1, r0, r1): the dither of the two output frames of each frame; zeros for salt 0."""
    names = ("l0", "r0", "l1", "r1")
    if salt == 0:
        return frames.select("file_id", "frame", *[big(0).alias(n) for n in ("l0", "l1", "r0", "r1")])
    table = G.power_table(frames.sparkSession, 4 * G.DITHER_FRAMES + 1)
    seed = G.block_seed(salt, shr(F.col("frame"), 11))
    rows = frames.select("file_id", "frame", seed.alias("state"), (F.col("frame") % G.DITHER_FRAMES * 4 + 1).alias("n")).join(table, "n")
    rows = rows.withColumn("t0", G.jumped(F.col("state"), F.col("a"), F.col("c")))
    for i in range(1, 4):
        rows = rows.withColumn(f"t{i}", G.step(F.col(f"t{i - 1}"), G.RESEED))
    drawn = {n: G.draw(F.col(f"t{i}"), scale) for i, n in enumerate(names)}
    return rows.select("file_id", "frame", *[drawn[n].alias(n) for n in ("l0", "l1", "r0", "r1")])


def group_checks(frames: DataFrame, group: int = 32) -> DataFrame:
    """(file_id, block, crc): the CRC-32 word register over the pairs of each group of frames, started from zero."""
    words = F.array(word(F.col("l")), word(F.col("r")))
    rows = frames.groupBy("file_id", F.floor(F.col("frame") / group).alias("block")).agg(F.array_sort(F.collect_list(F.struct("frame", words.alias("w")))).alias("all"))
    return rows.select("file_id", "block", G.word_check(F.flatten(F.col("all.w"))).alias("crc"))


def stepped(frames: DataFrame, state: Column, steps: Column, most: int, constants: tuple[int, int] = G.SCRAMBLER) -> DataFrame:
    """frames with `state`, the generator's state after `steps` (below `most`) from `state`."""
    table = G.power_table(frames.sparkSession, most, constants)
    rows = frames.withColumns({"__s": word(state), "n": steps}).join(table, "n")
    return rows.withColumn("state", G.jumped(F.col("__s"), F.col("a"), F.col("c"))).drop("__s", "n", "a", "c")
