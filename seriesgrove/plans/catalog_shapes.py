"""Queries over the shape of masks (components across blocks, surfaces, principal axes), spline interpolation and volumes in blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import blocks, shapes, volumes
from ..storage import spread
from . import views as V
from .catalog import query, r4
from .views import table

#: A sparse mask of 16 voxels a side for each supplier, from the keys of its line items.
LINES = "vox AS (SELECT DISTINCT l_suppkey AS series, l_partkey % 16 AS x, l_orderkey % 16 AS y, (l_orderkey // 16) % 16 AS z FROM lineitem)"


def supplier_masks(spark, sf):  # noqa: ANN001, ANN201
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("series"), F.lit(1).alias("channel"), F.expr("(l_orderkey div 16) % 16").alias("z"), (F.col("l_orderkey") % 16).alias("y"), (F.col("l_partkey") % 16).alias("x")
    )
    return rows  # repeated voxels count once in Shapes


@query(
    "component_sizes",
    f"""WITH RECURSIVE {LINES}, v AS (SELECT series, x, y, z, x + 16 * y + 256 * z AS i FROM vox),
e AS (SELECT a.series, a.i, b.i AS j FROM v a JOIN v b ON a.series = b.series AND ((a.x = b.x AND a.y = b.y AND abs(a.z - b.z) = 1) OR (a.x = b.x AND abs(a.y - b.y) = 1 AND a.z = b.z) OR (abs(a.x - b.x) = 1 AND a.y = b.y AND a.z = b.z))),
reach AS (SELECT series, i, i AS j FROM v UNION SELECT r.series, r.i, e.j FROM reach r JOIN e ON r.series = e.series AND r.j = e.i),
least AS (SELECT series, i, min(j) AS first FROM reach GROUP BY ALL)
SELECT series::VARCHAR AS series, (first // 256)::BIGINT AS z, ((first // 16) % 16)::BIGINT AS y, (first % 16)::BIGINT AS x, count(*)::BIGINT AS n_voxels FROM least GROUP BY ALL""",
)
def component_sizes(spark, sf):  # noqa: ANN001, ANN201
    found = shapes.Shapes(supplier_masks(spark, sf), side=6, voxels=True).labelled()
    return found.groupBy("series", "component").agg(F.count(F.lit(1)).alias("n_voxels")).select("series", *shapes.coordinates("component"), "n_voxels")


STEPS = "d(k, dx, dy, dz) AS (VALUES " + ", ".join(f"({k}, {x}, {y}, {z})" for k, (x, y, z) in enumerate(shapes.DIRECTIONS)) + ")"
RUNS = (
    "run AS (SELECT m.series, m.channel, d.k, count(*) AS n FROM mask m CROSS JOIN d LEFT JOIN mask p ON p.series = m.series AND p.channel = m.channel "
    "AND p.x = m.x - d.dx AND p.y = m.y - d.dy AND p.z = m.z - d.dz WHERE p.series IS NULL GROUP BY ALL)"
)


@query("intercepts", f"WITH {V.MASK}, {STEPS}, {RUNS} SELECT series::VARCHAR AS series, channel, string_agg(n, ',' ORDER BY k) AS runs FROM run GROUP BY ALL")
def intercepts(spark, sf):  # noqa: ANN001, ANN201
    found = shapes.Shapes(V.masks(spark, sf), side=4).sums()
    return found.select("series", "channel", F.array_join(F.transform("runs", lambda n: n.cast("string")), ",").alias("runs"))


SPACING = (2.0, 1.0, 0.5)  # x, y, z
WEIGHTS = [4 * float(np.prod(SPACING)) / float(np.linalg.norm(np.array(d) * SPACING)) * shapes.SHARES[sum(map(abs, d)) - 1] for d in shapes.DIRECTIONS]


@query(
    "roundness",
    f"WITH {V.MASK}, {STEPS}, {RUNS}, s AS (SELECT series, channel, sum(n * [{', '.join(map(repr, WEIGHTS))}][k + 1]::DOUBLE) AS p FROM run GROUP BY ALL), "
    "v AS (SELECT series, channel, cbrt(count(*) * 3 / (4 * pi())) AS r FROM mask GROUP BY ALL) "
    "SELECT series::VARCHAR AS series, channel, round(p, 4) AS perimeter, round(r, 4) AS spherical_radius, round(4 * pi() * r * r, 4) AS spherical_perimeter, round(4 * pi() * r * r / p, 4) AS roundness FROM s JOIN v USING (series, channel)",
)
def roundness(spark, sf):  # noqa: ANN001, ANN201
    found = shapes.Shapes(V.masks(spark, sf), side=4).statistics(SPACING)
    return found.select("series", "channel", *[r4(c).alias(c) for c in ("perimeter", "spherical_radius", "spherical_perimeter", "roundness")])


#: Eigenvalues by Newton's rounds from above and a square root: another way than the engine's.
AXES = """m AS (SELECT series, channel, count(*)::DOUBLE AS n, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(z, z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM mask GROUP BY ALL),
c AS (SELECT *, xx + yy + zz AS t, xx * yy + xx * zz + yy * zz - xy * xy - xz * xz - yz * yz AS s, xx * yy * zz + 2 * xy * xz * yz - xx * yz * yz - yy * xz * xz - zz * xy * xy AS d FROM m),
high AS (SELECT *, list_reduce(list_concat([t + 1e-9], range(60)::DOUBLE[]), lambda e, k: CASE WHEN abs(3 * e * e - 2 * t * e + s) < 1e-300 THEN e ELSE e - (((e - t) * e + s) * e - d) / (3 * e * e - 2 * t * e + s) END) AS e3 FROM c),
rest AS (SELECT *, sqrt(greatest((t - e3) * (t - e3) / 4 - (s - e3 * (t - e3)), 0)) AS w FROM high),
e AS (SELECT series, channel, n, greatest((t - e3) / 2 - w, 0) AS e1, greatest((t - e3) / 2 + w, 0) AS e2, e3 FROM rest)"""


@query(
    "shape_ratios",
    f"WITH {V.MASK}, {AXES} SELECT series::VARCHAR AS series, channel, round(CASE WHEN e2 > 1e-6 * (e1 + e2 + e3) THEN sqrt(e3 / e2) ELSE 0 END, 3) AS elongation, round(CASE WHEN e1 > 1e-6 * (e1 + e2 + e3) THEN sqrt(e2 / e1) ELSE 0 END, 3) AS flatness FROM e",
)
def shape_ratios(spark, sf):  # noqa: ANN001, ANN201
    m = shapes.Shapes(V.masks(spark, sf), side=4).statistics()
    return m.select("series", "channel", F.round("elongation", 3).alias("elongation"), F.round("flatness", 3).alias("flatness"))


# --- splines and blocks -----------------------------------------------------------

#: Every embedding as 64 voxels in a row, sampled at steps of 0.75 by the cubic spline through its samples (the results are stored in 32 bits); a coefficient is the sum of the mirrored samples, each weighed by the inverse filter's answer at its distance.
LINE = f"""s AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i)),
c AS (SELECT s.vec_id, k, sum(v * w) AS c FROM (SELECT k, 63 - abs(63 - ((k + j) % 126 + 126) % 126) AS i, sqrt(3) * pow(sqrt(3) - 2, abs(j)) AS w FROM range(64) a(k), range(-45, 46) b(j)) f JOIN s USING (i) GROUP BY ALL),
p AS (SELECT o, o * 0.75::DOUBLE AS x, floor(o * 0.75::DOUBLE)::BIGINT AS low FROM range(85) t(o)),
r AS (SELECT vec_id, o, sum(c * CASE j WHEN -1 THEN pow(1 - (x - low), 3) WHEN 0 THEN 3 * pow(x - low, 3) - 6 * pow(x - low, 2) + 4 WHEN 1 THEN -3 * pow(x - low, 3) + 3 * pow(x - low, 2) + 3 * (x - low) + 1 ELSE pow(x - low, 3) END) / 6 AS v
  FROM p, range(-1, 3) t(j) JOIN c ON c.k = 63 - abs(63 - ((low + j) % 126 + 126) % 126) GROUP BY ALL)"""


def placed_sum(rows):  # noqa: ANN001, ANN201
    """vec_id, total and a total that weighs places, of volumes of one row."""
    found = volumes.map_rows(rows.withColumn("at", F.lit(None).cast("double")), lambda r: {"at": float((volumes.array_of(r["voxels"], r["size"]).astype(float).ravel() * np.arange(int(np.prod(r["size"])))).sum())})
    return volumes.fingerprint(found, ("at",)).select(F.col("series").cast("long").alias("vec_id"), F.round("v_sum", 3).alias("total"), F.round("at", 2).alias("placed"))


@query("resample_bspline", f"WITH {LINE} SELECT vec_id, round(sum(v::FLOAT::DOUBLE), 3) AS total, round(sum(v::FLOAT::DOUBLE * o), 2) AS placed FROM r GROUP BY vec_id")
def resample_bspline(spark, sf):  # noqa: ANN001, ANN201
    v = volumes.pack(spread(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id"), "vec_id", "embedding", (64, 1, 1))
    return placed_sum(volumes.resample(v, (0.75, 0.0, 0.0), "bspline"))


@query("resample_blocks", f"WITH {LINE} SELECT vec_id, round(sum(v::FLOAT::DOUBLE), 3) AS total, round(sum(v::FLOAT::DOUBLE * o), 2) AS placed FROM r GROUP BY vec_id")
def resample_blocks(spark, sf):  # noqa: ANN001, ANN201
    """The same from and to blocks of 32 voxels a side."""
    v = volumes.pack(spread(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id"), "vec_id", "embedding", (64, 1, 1))
    return placed_sum(blocks.merge(blocks.resample(blocks.split(v, 32), (0.75, 0.0, 0.0), "bspline", side=32), 32).withColumn("error", F.lit(None).cast("string")))


# --- bias -------------------------------------------------------------------------


def phantom(embedding, k: int) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Two tissues in cubes of 4 voxels, by the embedding's signs, and the log of a smooth field: a slope, a bow or a wave by k."""
    a = np.where(np.asarray(embedding, np.float64).reshape(4, 4, 4) > 0, 200.0, 100.0).repeat(4, 0).repeat(4, 1).repeat(4, 2)
    z, y, x = (np.indices(a.shape) + 0.5) / 16 - 0.5
    field = (0.5 * x - 0.3 * z, 0.8 * (x * x + y * y) - 0.2 * y, 0.25 * np.sin(3 * x) * np.cos(2 * y) + 0.2 * z)[k % 3]
    return a, field - field.mean()


@query("bias_field", "SELECT vec_id, true AS mended FROM embeddings")
def bias_field(spark, sf):  # noqa: ANN001, ANN201
    """Whether the correction takes the field off (below a third of its spread), for each embedding's phantom."""

    def made(r: dict) -> dict:
        a, field = phantom(np.frombuffer(r["voxels"], "<f4"), int(r["series"]))
        return {"size": [16] * 3, "voxels": (a * np.exp(field)).astype("<f4").tobytes()}

    rows = spread(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id")  # a small file is much work here
    v = volumes.pack(rows, "vec_id", "embedding", (4, 4, 4)).withColumn("plain", F.col("voxels")).withColumn("mended", F.lit(None).cast("boolean"))

    def judged(r: dict) -> dict:
        a, field = phantom(np.frombuffer(r["plain"], "<f4"), int(r["series"]))
        left = np.log(volumes.array_of(r["voxels"], r["size"])) - np.log(a)
        return {"mended": bool(left.std() < field.std() / 3)}

    done = volumes.map_rows(volumes.bias_correct(volumes.map_rows(v, made), levels=2, rounds=15, bins=100), judged)
    return done.select(F.col("series").cast("long").alias("vec_id"), "mended")
