"""Region-of-interest name matching: ordered patterns against names."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ROIMatchingError
from ..functions.strings import full_match


class ROIMatchStrategy(str, Enum):
    MERGE = "merge"
    KEEP_FIRST = "keep_first"
    SEPARATE = "separate"


class ROIMatchFailurePolicy(str, Enum):
    IGNORE = "ignore"
    WARN = "warn"
    ERROR = "error"


def normalize_map(match_map: object = None) -> dict[str, list[str]]:
    if match_map is None:
        return {"ROI": [".*"]}
    if isinstance(match_map, str):
        return {"ROI": [match_map]}
    if isinstance(match_map, list):
        return {"ROI": list(match_map)}
    return {k: [v] if isinstance(v, str) else list(v) for k, v in dict(match_map).items()}  # type: ignore[call-overload]


def pattern_rows(spark: SparkSession, match_map: object) -> DataFrame:
    rows = [(i, k, j, p) for i, (k, ps) in enumerate(normalize_map(match_map).items()) for j, p in enumerate(ps)]
    return spark.createDataFrame(rows, "key_pos int, key string, pat_pos int, pattern string")


def matches(rois: DataFrame, patterns: DataFrame, ignore_case: bool = True) -> DataFrame:
    """series, key_pos, key, pat_pos, roi: every (pattern, name) that matches whole.

    The pattern table is the user's configuration; it is attached to each name
    as an array and exploded after the filter, so no pair that fails leaves the row.
    """
    table = patterns.agg(F.array_sort(F.collect_list(F.struct("key_pos", "pat_pos", "key", "pattern"))).alias("p")).head().p
    held = F.array(*[F.struct(F.lit(p.key_pos).alias("key_pos"), F.lit(p.pat_pos).alias("pat_pos"), F.lit(p.key).alias("key"), full_match(F.col("roi"), p.pattern, ignore_case).alias("ok")) for p in table])
    hit = rois.select("series", "roi", F.explode(F.filter(held, lambda p: p["ok"])).alias("p"))
    return hit.select("series", "p.key_pos", "p.key", "p.pat_pos", "roi")


def match(rois: DataFrame, patterns: DataFrame, strategy: ROIMatchStrategy = ROIMatchStrategy.MERGE, ignore_case: bool = True, allow_multi: bool = True) -> DataFrame:
    """series, key, roi_names, image_id in the order of keys, patterns and sorted names."""
    hit = matches(rois.select("series", "roi").distinct(), patterns, ignore_case)
    order = ["key_pos", "pat_pos", "roi"]
    if strategy == ROIMatchStrategy.KEEP_FIRST and not allow_multi:
        return _greedy(hit)
    if not allow_multi:
        hit = hit.withColumn("_n", F.row_number().over(Window.partitionBy("series", "roi").orderBy(*order))).where("_n = 1").drop("_n")
    if strategy == ROIMatchStrategy.SEPARATE:
        return hit.select("series", "key_pos", "key", F.array("roi").alias("roi_names"), F.concat("key", F.lit("__["), "roi", F.lit("]")).alias("image_id"))
    if strategy == ROIMatchStrategy.KEEP_FIRST:
        first = hit.withColumn("_n", F.row_number().over(Window.partitionBy("series", "key_pos").orderBy(*order))).where("_n = 1")
        return first.select("series", "key_pos", "key", F.array("roi").alias("roi_names"), F.col("key").alias("image_id"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pat_pos", "roi"))), lambda x: x["roi"])
    return hit.groupBy("series", "key_pos", "key").agg(listed.alias("roi_names")).withColumn("image_id", F.col("key"))


def _greedy(hit: DataFrame) -> DataFrame:
    """Each key in turn takes its first name that no earlier key took."""
    per_key = hit.groupBy("series", "key_pos", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pat_pos", "roi"))), lambda x: x["roi"]).alias("r"))
    keys = per_key.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("key_pos", "key", "r"))).alias("keys"))
    none = F.array().cast("array<struct<key_pos:int,key:string,roi:string>>")

    def take(acc, k):  # noqa: ANN001, ANN202
        free = F.filter(k["r"], lambda x: ~F.exists(acc, lambda a: a["roi"] == x))
        return F.concat(acc, F.transform(F.slice(free, 1, 1), lambda x: F.struct(k["key_pos"].alias("key_pos"), k["key"].alias("key"), x.alias("roi"))))

    taken = keys.select("series", F.explode(F.aggregate("keys", none, take)).alias("t"))
    return taken.select("series", "t.key_pos", "t.key", F.array("t.roi").alias("roi_names"), F.col("t.key").alias("image_id"))


def require_matches(found: DataFrame, policy: ROIMatchFailurePolicy) -> DataFrame:
    if policy == ROIMatchFailurePolicy.ERROR and found.isEmpty():
        raise ROIMatchingError("no region matches any pattern")
    return found
