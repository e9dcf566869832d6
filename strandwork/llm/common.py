"""Helpers that the training-data operators share: stage tables and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandwork-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/strandwork/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # the session may be gone by now; a local folder can be removed without it
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stage tables that are read no more, and let the driver find the shuffles that nothing refers to any longer.

    Shuffle files are deleted when the driver's collector meets what stood for them; with little garbage that is late.
    """
    for path in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        drop_path(spark, path)
    spark.sparkContext._jvm.System.gc()


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lost executors recompute nothing before it."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """(node, label) of every node of the undirected edges, label being the smallest node reachable.

    Alternating large-star and small-star rounds, of which a graph takes about the logarithm of its size; every round is
    staged, nothing is collected but two sums. Self
    edges and repeated edges are harmless; null ends are dropped; no edges give an empty table.
    """
    x, y = F.col(a), F.col(b)
    links = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.least(x, y).alias("v"), F.greatest(x, y).alias("u"))
    links = staged(links.distinct(), "links")
    none = links.select(F.col("v").alias("node"), F.col("v").alias("label"))
    if links.isEmpty():
        return none
    seen = None
    for _ in range(rounds):
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        links = staged(small.where("u <> v").distinct(), "links")
        now = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if seen == now:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node").union(links.select("v", "v").distinct())


def crc_fold(doc_id: Column, folds: int = 3) -> Column:
    """crc32 of doc_id as text, modulo folds; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
