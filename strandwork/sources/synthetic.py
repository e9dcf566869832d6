"""Frames made from ordinary tables, for data that holds no audio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the field-coded opening packet that planted streams carry, 147 bits in channel order.
OPENING_BITS = "101010111110000001001001100011001000100001010100001000010000100000000100101000000010100011010000000000001000000001000011110001111111100110001100111"


def event_frames(spark: SparkSession, sf_dir: str, files: int = 16) -> DataFrame:
    """frames(file_id, frame, l, r): right-justified 24-bit pairs in order of event_id, dealt out to files by user."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    mixed = [((F.col("event_id") * a + F.col("user_id") * b + c).bitwiseAND(F.lit(16777215)) - 8388608) for a, b, c in ((1664525, 1013904223, 12345), (22695477, 69069, 1))]
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("event_id")) - 1
    rows = events.select((F.col("user_id") % files).alias("file_id"), "event_id", mixed[0].alias("l"), mixed[1].alias("r"))
    return rows.select("file_id", place.cast("bigint").alias("frame"), "l", "r")


def plant_bits(frames: DataFrame, bits: str, start: Column, k: int) -> DataFrame:
    """frames with a bit string written into bit k of l xor r, from frame `start` of each file on."""
    at = F.col("frame") - start
    wanted = F.substring(F.lit(bits), (at + 1).cast("int"), F.lit(1)).cast("bigint")
    have = F.shiftright(F.col("l").bitwiseXOR(F.col("r")), k).bitwiseAND(F.lit(1).cast("bigint"))
    flip = F.when((at >= 0) & (at < len(bits)) & (wanted != have), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return frames.withColumn("l", F.col("l").bitwiseXOR(flip))
