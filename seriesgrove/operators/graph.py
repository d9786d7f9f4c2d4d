"""Components of graphs whose edges are rows, each within a key such as a series and channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored

#: Rows that a file of a round's table holds, so that rounds over few rows don't write a tiny file per shuffle partition.
FILE_ROWS = 1 << 17


def sized(df: DataFrame, rows: int) -> DataFrame:
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def contract(spark: SparkSession, edges: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """(keys, node, root) for every node of the undirected ``edges`` (keys, u, v), and the number of rounds.

    In a round every node moves to the neighbour, or itself, of least hash, which
    halves even a chain or better on average, since hashes change by the round;
    edges between the same two nodes merge.  Rounds grow with the logarithm of
    the longest chain.  State is in stored tables; the driver sees a count per
    round.  Root is one of the component's nodes, not a special one.
    """
    links = edges.where("u <> v").select(*keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    links, maps = stored(spark, links, "links"), []
    while n := links.count():
        order = lambda c: F.struct(F.xxhash64(*keys, c, F.lit(len(maps))).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        ends = links.unionByName(links.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        best = ends.groupBy(*keys, "u").agg(F.min(order("v")).alias("m"))
        moved = stored(spark, sized(best.select(*keys, F.col("u").alias("node"), F.least(order("u"), "m")["n"].alias("root")), 2 * n), "moved")
        maps.append(moved)
        left, right = (moved.select(*keys, F.col("node").alias(end), F.col("root").alias(to)) for end, to in (("u", "a"), ("v", "b")))
        new = links.join(left, [*keys, "u"]).join(right, [*keys, "v"]).where("a <> b")
        links = stored(spark, sized(new.select(*keys, F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), n), "links")
    if not maps:
        return links.select(*keys, F.col("u").alias("node"), F.col("v").alias("root")), 0
    out = maps[0]
    for m in maps[1:]:
        step = m.select(*keys, F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(step, [*keys, "root"], "left").select(*keys, "node", F.coalesce("next", "root").alias("root"))
    return out, len(maps)
