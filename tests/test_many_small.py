"""Many small rows: dealt to several tasks, passed on in bounded batches, with the same results."""

import numpy as np
from pyspark.sql import functions as F

from seriesgrove.operators import volumes


def test_contours_are_dealt_to_tasks(spark):
    square = [0.5, 0.5, 2.0, 3.5, 0.5, 2.0, 3.5, 3.5, 2.0, 0.5, 3.5, 2.0]
    rows = spark.createDataFrame([(str(i), "roi", [square if i else square[:5]]) for i in range(300)], "series string, roi string, contours array<array<double>>").coalesce(1)
    got = volumes.rasterise(rows, (8, 8, 4)).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in got}) > 1
    assert [(r.series, r.z) for r in got if r.error] == [("0", None)]
    of = {}
    for r in got:
        if not r.error:
            of.setdefault(r.series, []).append((r.z, r.y, r.x))
    want = sorted(map(tuple, np.argwhere(volumes.contour_mask([square], (8, 8, 4))).tolist()))
    assert len(of) == 299 and all(sorted(v) == want for v in of.values())


def test_groups_across_batches(spark):
    """Groups come whole, however they lie in batches; results hold a bounded number of rows."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(3000).select((F.col("id") % 311).cast("string").alias("k"), (F.col("id") % 2).cast("int").alias("c"), "id").coalesce(1)
        rows = rows.unionByName(spark.range(40).select(F.lit(None).cast("string").alias("k"), F.lit(0).alias("c"), "id"))
        out = volumes.in_groups(rows, ["k", "c"], lambda g: (g["k"].iloc[0], g["c"].iloc[0], len(g), g["id"].sum()), "k string, c int, n long, total long")
        got = {(r.k, r.c): (r.n, r.total) for r in out.collect()}
        assert out.count() == len(got)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == {(r.k, r.c): (r.n, r.total) for r in rows.groupBy("k", "c").agg(F.count("*").alias("n"), F.sum("id").alias("total")).collect()}
    assert [len(b) for b in volumes.batched(((i,) for i in range(2500)), ["n"])] == [1024, 1024, 452]


def test_a_bias_field_is_summed_by_steps():
    """The field equals the spline of refined controls, as it was computed before."""
    from seriesgrove.operators import splines

    rng = np.random.default_rng(3)
    z, y, x = np.indices((12, 11, 10)) / 10
    log = np.where(rng.random(z.shape) > 0.5, 5.3, 4.6) + 0.3 * x - 0.2 * z * y
    inside = rng.random(z.shape) > 0.1
    controls, spans = np.zeros((4, 4, 4)), (1, 1, 1)
    for level in range(2):
        if level:
            controls, spans = splines.refined(controls), (2, 2, 2)
        for _ in range(10):
            left = log - splines.surface(controls, log.shape)
            step = splines.approximate(left - volumes.sharpened(left, inside, 100), inside, spans)
            controls = controls + step
            change = np.exp(splines.surface(step, log.shape)[inside])
            if change.std() <= 1e-3 * change.mean():
                break
    field = splines.surface(controls, log.shape)
    assert np.abs(volumes.bias_field(log, inside, 2, 10, 100) - (field - field[inside].mean())).max() < 1e-6
    made = len(splines._kept)  # matrices are made once, not in every round
    volumes.bias_field(log, inside, 2, 10, 100)
    assert 0 < made == len(splines._kept)


def test_series_and_regions_are_dealt_to_tasks(spark, tmp_path):
    """A table of one row group is encoded by all tasks; a file search makes no task of every few files."""
    from seriesgrove.plans import catalog_images
    from seriesgrove.sources import files

    spark.createDataFrame([(i, [0.5] * 64, i % 3) for i in range(64)], "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = catalog_images.read_back(spark, str(tmp_path), lambda r: catalog_images.image_headers(r, "CT"))
    assert rows.where("error is null").count() == 64
    assert catalog_images.embeddings(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 1
    for i in range(300):
        (tmp_path / f"{i}.dcm").write_bytes(b"x")
    found = files.find_dicoms(spark, str(tmp_path)).select("path")
    assert found.count() == 300 and found.select(F.spark_partition_id()).distinct().count() <= 4
