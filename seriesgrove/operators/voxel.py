"""Voxel statistics, masks and intensity transforms over voxel rows (series, z, y, x, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import OverlappingMasksError, TooManyComponentsError


def explode_volume(volumes: DataFrame, key: str, values: str, nx: int, ny: int) -> DataFrame:
    """key, z, y, x, value from a flat array in z, y, x order."""
    rows = volumes.select(F.col(key).alias("series"), F.posexplode(values).alias("i", "v"))
    return rows.select("series", F.expr(f"i div {nx * ny}").alias("z"), F.expr(f"(i div {nx}) % {ny}").alias("y"), F.expr(f"i % {nx}").cast("long").alias("x"), F.col("v").cast("double").alias("value"))


def fingerprint(voxels: DataFrame) -> DataFrame:
    v = F.col("value")
    return voxels.groupBy("series").agg(F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.sum(v).alias("v_sum"), F.avg(v).alias("v_mean"), F.stddev_samp(v).alias("v_std"), F.var_samp(v).alias("v_var"), F.count(v).alias("n_voxels"))


def clip_intensity(v: Column, lower: float, upper: float) -> Column:
    if lower > upper:
        raise ValueError("lower exceeds upper")
    return F.least(F.greatest(v, F.lit(lower)), F.lit(upper))


def window_intensity(v: Column, window: float, level: float) -> Column:
    if window <= 0:
        raise ValueError("window must be positive")
    return clip_intensity(v, level - window / 2, level + window / 2)


def rescale_abs(v: Column, factor: Column | None) -> Column:
    return F.abs(v * F.coalesce(factor, F.lit(1.0)) if factor is not None else v)


def crop_centre(voxels: DataFrame, centre: tuple[int, int, int], size: tuple[int, int, int], full: tuple[int, int, int]) -> DataFrame:
    """Voxels in the window of ``size`` about ``centre`` (x, y, z), clipped to the image; 0 keeps the axis."""
    if any(not 0 <= c < n for c, n in zip(centre, full, strict=True)):
        raise ValueError("the centre lies outside the image")
    keep = F.lit(True)
    for axis, c, s, n in zip("xyz", centre, size, full, strict=True):
        low = 0 if s == 0 else max(0, c - s // 2)
        high = n if s == 0 else min(n, low + s)
        keep = keep & F.col(axis).between(low, high - 1)
    return voxels.where(keep)


def mask_channels(voxels: DataFrame, channels: dict[int, Column]) -> DataFrame:
    """series, channel, z, y, x of the voxels for which a channel's condition holds."""
    n = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in channels.items()]))
    return voxels.withColumn("channel", F.explode(n)).select("series", "channel", "z", "y", "x")


def per_voxel(mask: DataFrame) -> DataFrame:
    one = F.expr("shiftleft(1L, cast(channel as int) - 1)")
    return mask.groupBy("series", "z", "y", "x").agg(F.count(F.lit(1)).alias("n"), F.max("channel").alias("top"), F.bit_or(one).alias("region"))


def has_overlap(mask: DataFrame) -> DataFrame:
    return per_voxel(mask).groupBy("series").agg(F.max(F.col("n") > 1).alias("has_overlap"), F.count_if(F.col("n") > 1).alias("n_overlap"))


def to_label(mask: DataFrame) -> DataFrame:
    rows = per_voxel(mask)
    if not rows.where("n > 1").isEmpty():
        raise OverlappingMasksError("a label image cannot hold overlapping masks")
    return rows.select("series", "z", "y", "x", F.col("top").alias("label"))


def to_sparse(mask: DataFrame) -> DataFrame:
    return per_voxel(mask).select("series", "z", "y", "x", F.col("top").alias("label"))


def to_region(mask: DataFrame, n_channels: int) -> DataFrame:
    if n_channels > 32:
        raise TooManyComponentsError("a region mask holds at most 32 channels")
    return per_voxel(mask).select("series", "z", "y", "x", "region")


def background(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    return voxels.select("series", "z", "y", "x").join(mask, ["series", "z", "y", "x"], "left_anti")


def bounding_box(mask: DataFrame) -> DataFrame:
    """Per (series, channel): minimum, exclusive maximum and voxel count."""
    aggs = [f(F.col(a)).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", lambda c: F.max(c) + 1)) for a in "xyz"]
    return mask.groupBy("series", "channel").agg(*aggs, F.count(F.lit(1)).alias("n_voxels"))


def centroid(mask: DataFrame) -> DataFrame:
    return mask.groupBy("series", "channel").agg(*[F.avg(a).alias(f"c_{a}") for a in "xyz"])


def sphere_radius(n: Column, voxel_volume: float = 1.0) -> Column:
    return F.cbrt(n * voxel_volume * 3 / (4 * F.pi()))


def covariance(mask: DataFrame) -> DataFrame:
    pairs = [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")]
    return mask.groupBy("series", "channel").agg(*[F.covar_pop(a, b).alias(f"c_{a}{b}") for a, b in pairs])


def slices(voxels: DataFrame, axis: str, every: int) -> DataFrame:
    """Every n-th slice, normalised per series to 0..255."""
    ends = voxels.groupBy("series").agg(F.min("value").alias("_low"), F.max("value").alias("_high"))  # a row per series
    span = F.col("_high") - F.col("_low")
    scaled = voxels.where(F.col(axis) % every == 0).join(ends, "series")
    return scaled.withColumn("shade", F.when(span > 0, (F.col("value") - F.col("_low")) / span * 255).otherwise(0.0)).drop("_low", "_high")


def success_rate(results: DataFrame, ok: Column) -> DataFrame:
    return results.agg(
        F.count_if(ok).alias("n_success"), F.count_if(~ok).alias("n_failure"), F.count(F.lit(1)).alias("n_total"), F.coalesce(F.avg(ok.cast("int")) * 100, F.lit(0.0)).alias("success_rate")
    )
