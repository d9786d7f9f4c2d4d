"""Synthetic volumes as voxel rows, from index arithmetic over a range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("sphere", "noisy_sphere", "grid", "gradient_x", "gradient_y", "gradient_z", "gradient_radial", "cross", "rod", "checkerboard", "ct")


def volume(
    spark: SparkSession, kind: str, size: tuple[int, int, int], *, radius: float = 20.0, step: int = 8, width: int = 4, low: float = 0.0, high: float = 1.0, noise: float = 0.1, seed: int = 42
) -> DataFrame:
    """id, x, y, z, value of a volume about its centre voxel (size // 2)."""
    nx, ny, nz = size
    rows = spark.range(nx * ny * nz).select("id", (F.col("id") % nx).alias("x"), F.expr(f"(id div {nx}) % {ny}").alias("y"), F.expr(f"id div {nx * ny}").alias("z"))
    off = {a: F.col(a) - n // 2 for a, n in zip("xyz", size, strict=True)}
    r = F.sqrt(sum((F.pow(off[a], 2) for a in "xyz"), F.lit(0.0)))
    near = {a: F.abs(off[a]) <= width for a in "xyz"}
    count = sum((near[a].cast("int") for a in "xyz"), F.lit(0))
    pick = lambda c: F.when(c, F.lit(high)).otherwise(F.lit(low))
    along = lambda a, n: F.col(a) / max(n - 1, 1) * (high - low) + low
    value = {
        "sphere": lambda: pick(r <= radius),
        "noisy_sphere": lambda: pick(r <= radius) + F.randn(seed) * noise,
        "grid": lambda: pick((F.col("x") % step == 0) | (F.col("y") % step == 0) | (F.col("z") % step == 0)),
        "gradient_x": lambda: along("x", nx),
        "gradient_y": lambda: along("y", ny),
        "gradient_z": lambda: along("z", nz),
        "gradient_radial": lambda: F.greatest(F.lit(0.0), 1 - r / max(max(size) / 2, 1)) * (high - low) + low,
        "cross": lambda: pick(count >= 2),
        "rod": lambda: pick(near["x"] & near["y"]),
        "checkerboard": lambda: pick((F.expr(f"x div {step}") + F.expr(f"y div {step}") + F.expr(f"z div {step}")) % 2 == 1),
        "ct": lambda: F.when(r <= radius * 0.4, 700.0).when(r <= radius * 0.8, 40.0).when(r <= radius, -100.0).otherwise(-1000.0),
    }[kind]()
    return rows.withColumn("value", value.cast("double"))
