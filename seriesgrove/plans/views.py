"""The imaging model seen in the driver's tables.

customer = patient, orders = series, lineitem = instances, part = region names,
embeddings = 4x4x4 volumes, events = header fields, pages = file paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.voxel import explode_volume


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modality(key: str):  # noqa: ANN201
    names = ["CT", "CT", "MR", "PT", "SEG", "RTSTRUCT", "RTDOSE", "RTPLAN"]
    return F.get(F.array(*[F.lit(m) for m in names]), (F.col(key) % 8).cast("int"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, pid, modality, ref: references by windows over the patient's series, without a self join."""
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("pid"), modality("o_orderkey").alias("modality"))
    whole = Window.partitionBy("pid")
    before = whole.orderBy("uid").rangeBetween(Window.unboundedPreceding, -1)
    image = F.max(F.when(F.col("modality").isin("CT", "MR", "PT"), F.col("uid"))).over(before)
    plan = F.max(F.when(F.col("modality") == "RTSTRUCT", F.col("uid"))).over(before)
    ct = F.min(F.when(F.col("modality") == "CT", F.col("uid"))).over(whole)
    ref = F.when(F.col("modality").isin("SEG", "RTSTRUCT", "RTDOSE"), image).when(F.col("modality") == "PT", ct).when(F.col("modality") == "RTPLAN", plan)
    return s.withColumn("ref", ref)


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instance rows; a path names its lineitem, so that first-file-wins is defined."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("SeriesInstanceUID"),
        F.col("l_linenumber").cast("string").alias("AcquisitionNumber"),
        F.concat_ws(".", F.col("l_orderkey"), F.col("l_partkey")).alias("SOPInstanceUID"),
        F.concat_ws("/", F.col("l_orderkey"), F.concat(F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit("_"), F.col("l_partkey"), F.lit("_"), F.col("l_suppkey"), F.lit("_"), F.date_format("l_shipdate", "yyyyMMdd"))).alias("path"),
    )
    return line


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_volume(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 4, 4)


def channels() -> dict:
    v = F.col("value")
    return {1: v > 0.1, 2: v > 0.2, 3: v < -0.1}


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.voxel import mask_channels

    return mask_channels(voxels(spark, sf_dir), channels())


def rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("series"), F.col("p_name").alias("roi")).distinct()


# --- the same views for DuckDB ----------------------------------------------

SERIES = """series AS (SELECT o_orderkey sid, o_custkey pid,
   CASE o_orderkey % 8 WHEN 0 THEN 'CT' WHEN 1 THEN 'CT' WHEN 2 THEN 'MR' WHEN 3 THEN 'PT'
        WHEN 4 THEN 'SEG' WHEN 5 THEN 'RTSTRUCT' WHEN 6 THEN 'RTDOSE' ELSE 'RTPLAN' END m FROM orders)"""
IDX = (
    SERIES
    + """,
idx AS (SELECT s.sid, s.pid, s.m, CASE
   WHEN s.m IN ('SEG','RTSTRUCT','RTDOSE') THEN max(CASE WHEN p.m IN ('CT','MR','PT') AND p.sid<s.sid THEN p.sid END)
   WHEN s.m='PT' THEN min(CASE WHEN p.m='CT' THEN p.sid END)
   WHEN s.m='RTPLAN' THEN max(CASE WHEN p.m='RTSTRUCT' AND p.sid<s.sid THEN p.sid END) END AS ref
 FROM series s JOIN series p ON s.pid=p.pid GROUP BY s.sid, s.pid, s.m)"""
)
PATHS = (
    IDX
    + """,
paths AS (SELECT pid, sid AS root, [sid] AS u, [m] AS k FROM idx WHERE m IN ('CT','MR') OR (m='PT' AND ref IS NULL)
  UNION ALL SELECT p.pid, p.root, list_append(p.u, i.sid), list_append(p.k, i.m) FROM paths p JOIN idx i ON i.ref = p.u[-1] WHERE NOT list_contains(p.u, i.sid))"""
)
LINES = """line AS (SELECT l_orderkey AS sid, CAST(l_linenumber AS VARCHAR) AS acq, l_orderkey || '.' || l_partkey AS sop,
  l_orderkey || '/' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '_' || l_partkey || '_' || l_suppkey || '_' || strftime(l_shipdate, '%Y%m%d') AS path FROM lineitem)"""
VOX = """vox AS (SELECT vec_id AS series, (i // 16)::BIGINT AS z, ((i // 4) % 4)::BIGINT AS y, (i % 4)::BIGINT AS x, embedding[i + 1]::DOUBLE AS value
  FROM embeddings, range(64) t(i))"""
MASK = (
    VOX
    + """,
mask AS (SELECT series, 1 AS channel, z, y, x FROM vox WHERE value > 0.1 UNION ALL SELECT series, 2, z, y, x FROM vox WHERE value > 0.2
  UNION ALL SELECT series, 3, z, y, x FROM vox WHERE value < -0.1)"""
)
ROIS = "rois AS (SELECT DISTINCT p_brand AS series, p_name AS roi FROM part)"
