"""From instance rows to the series index: grouping, reference resolution, dedup, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DUPLICATE_KEYS, INDEX_KEYS, INSTANCE_KEYS
from ..storage import large

REFERENCING = ("SEG", "RTSTRUCT", "RTDOSE", "RTPLAN")
#: Those whose references are found by SOP unless a dose's are asked for too.
BY_SOP = tuple(m for m in REFERENCING if m != "RTDOSE")


def sub_series(acquisition: str = "AcquisitionNumber"):  # noqa: ANN201
    c = F.col(acquisition).cast("string")
    return F.when(c.isNull() | c.isin("", "None"), "1").otherwise(c)


def sop_map(instances: DataFrame) -> DataFrame:
    """SOP to series; the last path wins."""
    return instances.groupBy("SOPInstanceUID").agg(F.max_by("SeriesInstanceUID", "path").alias("SeriesInstanceUID"))


def group_series(instances: DataFrame) -> DataFrame:
    """One row per (series, subseries): the first path's metadata and the count of distinct SOPs."""
    rows = instances.withColumn("SubSeries", sub_series())
    keep = [c for c in rows.columns if c not in ("SeriesInstanceUID", "SubSeries", "SOPInstanceUID", "AcquisitionNumber")]
    grouped = rows.groupBy("SeriesInstanceUID", "SubSeries").agg(F.min_by(F.struct(*keep), "path").alias("m"), F.count_distinct("SOPInstanceUID").cast("int").alias("instances"))
    return grouped.select("SeriesInstanceUID", "SubSeries", "m.*", "instances")


def instance_counts(instances: DataFrame) -> DataFrame:
    """Distinct SOPs per series, over its subseries."""
    return instances.groupBy("SeriesInstanceUID").agg(F.count_distinct("SOPInstanceUID").alias("n_instances"))


def frame_map(series: DataFrame) -> DataFrame:
    return series.groupBy("FrameOfReferenceUID").agg(F.count_distinct("SeriesInstanceUID").alias("n_series"), F.min("SeriesInstanceUID").alias("first_series"))


def resolve_by_sop(series: DataFrame, sops: DataFrame, modalities: tuple[str, ...] = REFERENCING) -> DataFrame:
    """(SeriesInstanceUID, SubSeries, resolved): the least series that holds a referenced SOP."""
    open_ = series.where(F.col("Modality").isin(*modalities) & (F.coalesce("ReferencedSeriesUID", F.lit("")) == ""))
    asked = open_.select("SeriesInstanceUID", "SubSeries", F.explode("ReferencedSOPUIDs").alias("SOPInstanceUID"))
    found = asked.join(sops.withColumnRenamed("SeriesInstanceUID", "resolved"), "SOPInstanceUID")
    return found.groupBy("SeriesInstanceUID", "SubSeries").agg(F.min("resolved").alias("resolved"))


def resolve_by_frame(series: DataFrame) -> DataFrame:
    """(SeriesInstanceUID, SubSeries, resolved): the least CT with a PT's frame of reference."""
    ct = series.where("Modality = 'CT'").groupBy("FrameOfReferenceUID").agg(F.min("SeriesInstanceUID").alias("resolved"))
    return series.where("Modality = 'PT'").join(ct, "FrameOfReferenceUID").select("SeriesInstanceUID", "SubSeries", "resolved")


def resolve(series: DataFrame, sops: DataFrame, rtdose_sops: bool = False) -> DataFrame:
    by_sop = resolve_by_sop(series, sops, REFERENCING if rtdose_sops else BY_SOP)
    found = by_sop.unionByName(resolve_by_frame(series))
    out = series.join(found, ["SeriesInstanceUID", "SubSeries"], "left")
    return out.withColumn("ReferencedSeriesUID", F.coalesce("resolved", F.nullif("ReferencedSeriesUID", F.lit("")))).drop("resolved")


def referenced_modality(series: DataFrame) -> DataFrame:
    """Adds ReferencedModality; a ;-joined list of references gives the members' modalities in order."""
    kinds = series.groupBy(F.col("SeriesInstanceUID").alias("_uid")).agg(F.min("Modality").alias("_m"))
    parts = series.select("SeriesInstanceUID", "SubSeries", F.posexplode(F.split("ReferencedSeriesUID", ";")).alias("_i", "_uid"))
    named = parts.join(kinds, "_uid").groupBy("SeriesInstanceUID", "SubSeries").agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_a"))
    named = named.select("SeriesInstanceUID", "SubSeries", F.array_join(F.transform("_a", lambda x: x["_m"]), ";").alias("ReferencedModality"))
    return series.drop("ReferencedModality").join(named, ["SeriesInstanceUID", "SubSeries"], "left")


def reference_modalities(references: DataFrame, kinds: DataFrame) -> DataFrame:
    """Adds ReferencedModality to (series, subseries, ReferencedSeriesUID), from the modality of each series."""
    parts = references.select("*", F.posexplode(F.split("ReferencedSeriesUID", ";")).alias("_i", "_uid"))
    parts = parts.join(kinds.select(F.col("SeriesInstanceUID").alias("_uid"), F.struct("Modality").alias("_m")), "_uid", "left")
    there = F.when(F.col("_m").isNotNull(), F.struct("_i", F.col("_m.Modality").alias("_m")))
    named = parts.groupBy(*references.columns).agg(F.array_sort(F.collect_list(there)).alias("_a"))
    return named.select(*references.columns, F.when(F.size("_a") > 0, F.array_join(F.transform("_a", lambda x: x["_m"]), ";")).alias("ReferencedModality"))


def keep_first(index: DataFrame, keys: list[str] | None = None, order: str = "SubSeries") -> DataFrame:
    """Rows that differ only in ``order``: the first stays."""
    keys = keys or DUPLICATE_KEYS
    return index.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def build_index(instances: DataFrame) -> DataFrame:
    """Instance rows to index rows; of their headers only the index's columns travel."""
    rows = instances.select(*[c for c in instances.columns if c in INSTANCE_KEYS])
    spark = instances.sparkSession
    grouped = large(spark, group_series(rows), "grouped")
    resolved = large(spark, resolve(grouped, sop_map(rows)), "resolved")
    return keep_first(with_folder(referenced_modality(resolved)).select(*INDEX_KEYS))


def with_folder(series: DataFrame) -> DataFrame:
    return series.withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))


def report(series: DataFrame, patient: str, study: str, uid: str, modality: str) -> DataFrame:
    """Counts by modality, by patient and over all, in one pass."""
    sets = series.groupingSets([[F.col(modality)], [F.col(patient)], []], F.col(modality), F.col(patient))
    return sets.agg(F.count_distinct(study).alias("n_studies"), F.count_distinct(uid).alias("n_series"), F.grouping_id().alias("level"))
