"""An index that follows its files equals the one of all files, in any order of arrival."""

import random

import pytest
from pyspark.sql import functions as F
from seriesgrove.operators import crawl
from seriesgrove.schemas import INDEX_KEYS, INSTANCE
from seriesgrove.storage import new_folder
from seriesgrove.streaming import live


def instances():
    """CTs, PTs by frame, structures by SOP and by series, plans of structures, a list of references, targets that never come."""
    rows = []

    def add(series, modality, n=1, frame="", ref="", sops=(), study="S", acquisition="1"):
        for k in range(n):
            rows.append((f"{series}/{k:02d}.dcm", "P", study, series, f"{series}.{k}", modality, acquisition if k % 2 == 0 else "2", frame, ref, list(sops)))

    add("ct1", "CT", 3, frame="F1")
    add("ct0", "CT", 2, frame="F1")
    add("ct2", "CT", 2, frame="F2")
    add("pt1", "PT", 2, frame="F1")
    add("pt2", "PT", 1, frame="F9")
    add("rs1", "RTSTRUCT", 1, sops=["ct1.1", "ct1.2"])
    add("rs2", "RTSTRUCT", 1, ref="ct2")
    add("rs3", "RTSTRUCT", 1, sops=["none.0"])
    add("seg", "SEG", 1, sops=["ct2.0", "ct0.1"])
    add("plan", "RTPLAN", 1, sops=["rs1.0"])
    add("dose", "RTDOSE", 1, ref="plan", sops=["ct1.0"])
    add("sr", "SR", 1, ref="ct1;pt1;gone")
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_gives_the_same_index(spark, seed):
    rng, rows = random.Random(seed), instances()
    rng.shuffle(rows)
    batches, at = [], 0
    while at < len(rows):
        n = rng.randrange(3, 9)
        batches.append([(*r, None) for r in rows[at : at + n]])
        at += n
    index = live.LiveIndex(spark, new_folder(spark, "live"), 4)
    schema = INSTANCE + ", error string"
    for n, b in enumerate(batches):
        index.apply(spark.createDataFrame([*b, (f"bad{n}", *[None] * 9, "unreadable")], schema), n)
        if n == 1:  # a batch that is repeated
            index.apply(spark.createDataFrame(b, schema), n)
    want = crawl.build_index(spark.createDataFrame(rows, INSTANCE)).select(*INDEX_KEYS)
    assert sorted(map(str, index.read().collect())) == sorted(map(str, want.collect()))
    last = {r.SeriesInstanceUID for r in spark.read.parquet(f"{index.folder}/index/batch={len(batches) - 1}").select("SeriesInstanceUID").collect()}
    assert {r[3] for r in batches[-1]} <= last and len(last) < 12  # only touched series


def test_late_changes_and_empty_frames(spark):
    """A PT without a frame before its CT, a first path that comes late, a SOP in two series, a series that goes on and repeats a SOP."""
    row = lambda path, series, sop, modality, frame="", ref="", sops=(), acquisition="1": (path, "P", "S", series, sop, modality, acquisition, frame, ref, list(sops))
    batches = [
        [row("pt/1", "pt", "pt.1", "PT"), row("rs/1", "rs", "rs.1", "RTSTRUCT", sops=["x.1"]), row("b/2", "b", "b.2", "MR", "F"), row("dose/1", "dose", "dose.1", "RTDOSE", sops=["b.2"]), row("sr/1", "sr", "sr.1", "SR", ref="b;later")],
        [row("ct/1", "ct", "ct.1", "CT"), row("x/1", "x", "x.1", "CT", "F"), row("seg/1", "seg", "seg.1", "SEG", sops=["b.2"])],
        [row("b/1", "b", "b.1", "CT", "G"), row("b/3", "b", "b.2", "CT", "G"), row("y/1", "y", "x.1", "MR"), row("x/0", "x", "x.0", "CT", "H", acquisition="2")],
        [row("later/1", "later", "later.1", "PT", "G"), row("rs/0", "rs", "rs.0", "RTSTRUCT", sops=["b.1"])],
    ]
    index, schema = live.LiveIndex(spark, new_folder(spark, "live"), 2), INSTANCE + ", error string"
    for n, rows in enumerate(batches):
        index.apply(spark.createDataFrame([(*r, None) for r in rows], schema), n)
    want = crawl.build_index(spark.createDataFrame([r for rows in batches for r in rows], INSTANCE)).select(*INDEX_KEYS)
    assert sorted(map(str, index.read().collect())) == sorted(map(str, want.collect()))


def test_instances_move_once(spark):
    """Rows that travel between tasks or are written, by the instances of three batches: one each, and what a row per series takes."""
    series = F.concat_ws(".", F.lit("1.2.840"), F.col("id"))
    kinds = F.array(*[F.lit(m) for m in ("RTSTRUCT", "PT", "SEG", "CT", "MR")])
    rows = spark.range(0, 400, numPartitions=4).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(29)))).select(
        F.concat_ws("/", series, "k").alias("path"), F.lit("P").alias("PatientID"), F.lit("S").alias("StudyInstanceUID"), series.alias("SeriesInstanceUID"), F.concat_ws(".", series, "k").alias("SOPInstanceUID"), F.get(kinds, (F.col("id") % 5).cast("int")).alias("Modality"),
        F.lit("1").alias("AcquisitionNumber"), (F.col("id") / 10).cast("int").cast("string").alias("FrameOfReferenceUID"), F.lit("").alias("ReferencedSeriesUID"), F.array(F.concat_ws(".", F.lit("1.2.840"), F.col("id") + 2, F.lit("0"))).alias("ReferencedSOPUIDs"), F.lit(None).cast("string").alias("error"),
    )
    jvm = spark.sparkContext._jvm

    def moved():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() + stages.apply(i).outputRecords() for i in range(stages.size())}

    before = moved()
    index = live.LiveIndex(spark, new_folder(spark, "live"), 4)
    for n, among in enumerate((("RTSTRUCT", "PT"), ("SEG",), ("CT", "MR"))):
        index.apply(rows.where(F.col("Modality").isin(*among)), n)
    assert index.read().count() == 400
    n = sum(v for k, v in moved().items() if k not in before)
    assert 0 < n < 5 * 400 * 30, n


def test_a_dead_writers_lock_expires(spark, tmp_path):
    import os
    import time

    from seriesgrove.errors import WriterIndexError
    from seriesgrove.operators.outputs import IndexStore

    at = tmp_path / "index"
    at.mkdir()
    (at / "_lock").touch()
    rows = spark.createDataFrame([("a", "1")], "filepath string, n string")
    with pytest.raises(WriterIndexError):
        IndexStore(spark, f"file://{at}", wait=0.5).upsert(rows)
    past = time.time() - 7200
    os.utime(at / "_lock", (past, past))
    assert IndexStore(spark, f"file://{at}", wait=5).upsert(rows).count() == 1
    assert not list(at.glob("_lock*"))
