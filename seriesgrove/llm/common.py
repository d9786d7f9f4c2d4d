"""Shared pieces: table reading, scratch tables, row identity, graph components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_folder, release, scratch, stored

__all__ = ["components", "fits", "new_folder", "release", "scratch", "small", "stored", "table", "with_row_id", "without"]

#: The ASCII white space of the contracts, as a character class body.
WS = "\\x20\\x09-\\x0D"

#: Tables of more stored bytes are joined by shuffling.
BROADCAST_BYTES = 32 << 20
#: Rows (a few numbers each) that a file of a small intermediate table holds, so that rounds over few rows don't write a tiny file per shuffle partition.
FILE_ROWS = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fits(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the stored table ``df`` takes ``most`` bytes of files or less."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most  # noqa: SLF001


def small(df: DataFrame) -> DataFrame:
    """The stored table ``df``, broadcast if it ``fits``."""
    return F.broadcast(df) if fits(df) else df


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """Adds a row identity that tells repeated rows apart.

    Equal across two uses of the same file scan (partition number and position
    in it): the scan's splits are pinned here, since by default they follow the
    number of cores, which changes when executors are lost.  Use on scans, or
    store the result before using it twice.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return df.withColumn(name, F.monotonically_increasing_id())


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The file scan ``docs`` without the rows in ``dropped`` (_row).

    Both sides are dealt by row at every size, so the cost follows the input
    and a task holds only its share of the dropped rows.
    """
    return with_row_id(docs).join(dropped.select("_row").hint("shuffle_hash"), "_row", "left_anti").drop("_row")


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has about ``rows`` rows, in a partition for each ``FILE_ROWS`` of them, or in those it has if they are fewer."""
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (u, v: long).

    Contraction: in each round every node moves to the neighbour (or itself)
    with the least hash, and edges between the same pair merge.  Hashes change
    by the round, so even a chain shrinks by a constant share.  All state is in
    stored tables, in files in proportion to their rows; the driver sees only a count per round.  Minimum by node is
    pre-aggregated before the shuffle, so a hub does not gather its neighbours.
    """
    links = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    links = stored(spark, links, "links")
    maps: list[DataFrame] = []
    while n := links.count():
        salt = len(maps)
        ends = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("h"), F.col(c).alias("n"))
        best = ends.groupBy("u").agg(F.min(order("v")).alias("m"))
        moved = best.select(F.col("u").alias("node"), F.least(order("u"), F.col("m"))["n"].alias("root"))
        moved = stored(spark, sized(moved, 2 * n), "moved")
        maps.append(moved)
        left = moved.select(F.col("node").alias("u"), F.col("root").alias("a"))
        right = moved.select(F.col("node").alias("v"), F.col("root").alias("b"))
        new = links.join(left, "u").join(right, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        links = stored(spark, sized(new.distinct(), n), "links")
    if not maps:
        return spark.createDataFrame([], "node long, root long")
    out = maps[0]
    for m in maps[1:]:
        step = m.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
