"""Collections of many files: what the driver may not hold, and what is computed once."""

import pytest
from pyspark.sql import functions as F

from seriesgrove import storage
from seriesgrove.plans import catalog_files, nnunet, pipeline
from seriesgrove.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A collection of 24 patients."""
    sf = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, [(i + j) % 7 / 7 for j in range(64)], i % 3) for i in range(24)], "vec_id long, embedding array<double>, label int").write.parquet(f"{sf}/embeddings.parquet")
    return catalog_files.collection(spark, str(sf))


def test_tasks_list_the_files(spark, tmp_path):
    """No reader indexes the files in the driver, and the files are those that a reader finds."""
    for i in range(40):
        at = tmp_path / f"p{i}" / ("_hidden" if i == 7 else ".dot" if i == 8 else "_k=v" if i == 9 else "CT")
        at.mkdir(parents=True)
        for name in ("1.dcm", "2.DCM", ".3.dcm", "_4.dcm", "5.txt", "6 %20é.dcm"):
            (at / name).write_bytes(b"x" * (i + 1))
    (tmp_path / "top.dcm").write_bytes(b"top")
    found = files.find_dicoms(spark, str(tmp_path))
    assert len(found.inputFiles()) < 40
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][cC][mM]").option("recursiveFileLookup", "true").load(str(tmp_path))
    assert read.count() == 38 * 3 + 1
    rows = lambda df: sorted((r.path, r.modificationTime, r.length, bytes(r.content)) for r in df.collect())
    assert rows(found.select("path", F.date_trunc("second", "modificationTime").alias("modificationTime"), "length", "content")) == rows(read.withColumn("modificationTime", F.date_trunc("second", "modificationTime")))
    names = lambda *a, **k: sorted(r.path.rpartition("/")[2] for r in files.find_dicoms(spark, *a, **k).collect())
    assert names(str(tmp_path), recursive=False) == ["top.dcm"]
    assert names(f"{tmp_path}/p1/*", case_sensitive=True) == ["1.dcm", "6 %20é.dcm"]
    assert names(f"{tmp_path}/p1/CT/2.DCM") == ["2.DCM"]
    assert names(f"{tmp_path}/p1/CT", extension="TXT") == ["5.txt"]
    (tmp_path / "none").mkdir()
    assert names(f"{tmp_path}/none") == []
    with pytest.raises(FileNotFoundError):
        files.find_dicoms(spark, f"{tmp_path}/missing")


def test_large_tables_are_not_broadcast(spark):
    """Repeated headers take few bytes in a file and many in memory."""
    header = F.create_map(*[F.lit(x) for i in range(60) for x in (f"field {i}", "a value that every series has")])
    rows = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).substr(1, 12).alias("uid"), header.alias("hdr"))
    few = spark.range(1000)
    assert "BroadcastHashJoin" not in plan(rows.select("id").join(storage.large(spark, rows, "t"), "id", "left"))
    assert "BroadcastHashJoin" in plan(storage.large(spark, few, "t").join(rows, "id"))  # a small table may be


def test_volumes_of_samples_are_not_broadcast(spark, folder, monkeypatch):
    monkeypatch.setattr(storage, "SMALL", 0, raising=False)
    loader = pipeline.SampleLoader(spark, folder, storage.new_folder(spark, "crawl"), ["CT", "RTSTRUCT"], {"GTV": "gtv.*"})
    rows = loader.load(storage.stored(spark, loader.query(), "samples"))
    assert "BroadcastHashJoin" not in plan(rows.where("kind = 'image'"))
    assert rows.where("kind = 'image'").count() == 24


def test_masks_are_encoded_once(spark, folder):
    p = nnunet.NNUNetPipeline(spark, folder, storage.new_folder(spark, "nnunet"), ["CT", "RTSTRUCT"], {"GTV": ["gtv.*"]}, "sparse")
    rows = storage.stored(spark, p.loader.load(storage.stored(spark, p.loader.query(first=1), "samples")), "rows")
    laid = p.laid_out(rows)
    assert "MapInPandas" not in plan(laid) and laid.where("error is null and DirType = 'labels'").count() == sum(n % 7 > 0 and n % 11 > 0 for n in range(24))
