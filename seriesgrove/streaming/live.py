"""An index that follows arriving files: references wait for their targets, and a batch updates only the series that it touches.

Below a folder there are append-only tables, a part per batch, so a batch
that is repeated replaces its own part and nothing else:

* ``series``: a row per series and subseries of a batch, with the first path's
  metadata and the SOPs, in buckets by series.  Where a series goes on from an
  earlier batch, a second step holds it as a whole, so the last version counts;
* ``asks``: the targets that a series asks for (SOPs, a PT's frame, series), and
  ``offers``: what it has (its SOPs, the frame of a CT) and whether that had been
  asked for, both in buckets by target;
* ``known``: the offers that were asked for, before or after they arrived;
* ``index``: the index rows of the series that a batch touched.  The last batch
  of a series counts.

A batch touches its own series, those that asked for what it offers, however
long ago, and those that asked for anything else of its series.  Their rows are
made by the functions of the whole crawl, from their own rows and those of the
series that they refer to; where a batch's keys are few they prune the buckets
that are read.  So the index after any order of arrival equals that of all files
at once.

Only the batch's own instances travel row by row, once as offers; earlier ones
do when a later batch asks for SOPs in such numbers that these can't be
broadcast.  All else moves a row per series.  The SOPs of one series make one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import storage
from ..operators import crawl
from ..schemas import INDEX, INDEX_KEYS
from .incremental import stream_instances

BUCKETS = 64
UID = "SeriesInstanceUID"
KEYS = [UID, "SubSeries"]
#: What is kept of the first path of a series.
HEAD = ["path", "PatientID", "StudyInstanceUID", "Modality", "FrameOfReferenceUID", "ReferencedSeriesUID", "ReferencedSOPUIDs"]
SERIES = (
    "SeriesInstanceUID string, SubSeries string, path string, PatientID string, StudyInstanceUID string, Modality string, FrameOfReferenceUID string, "
    "ReferencedSeriesUID string, ReferencedSOPUIDs array<string>, sops array<struct<sop: string, path: string>>, instances int"
)
LINK = "kind string, target string, series string"
TABLES = {"series": SERIES + ", batch int, step int", "asks": LINK + ", batch int", "offers": LINK + ", path string, asked boolean, batch int", "known": LINK + ", path string, batch int", "index": INDEX + ", batch int"}


def bucket(c: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int").alias("bucket")


def gathered(rows: DataFrame) -> DataFrame:
    """Instances to a row per series and subseries."""
    rows = rows.withColumn("SubSeries", crawl.sub_series())
    sop = F.when(F.col("SOPInstanceUID").isNotNull(), F.struct(F.col("SOPInstanceUID").alias("sop"), "path"))
    return counted(rows.groupBy(*KEYS).agg(F.min_by(F.struct(*HEAD), "path").alias("m"), F.collect_set(sop).alias("sops")))


def merged(rows: DataFrame) -> DataFrame:
    """Several rows of a series and subseries to one."""
    return counted(rows.groupBy(*KEYS).agg(F.min_by(F.struct(*HEAD), "path").alias("m"), F.array_distinct(F.flatten(F.collect_list("sops"))).alias("sops")))


def counted(rows: DataFrame) -> DataFrame:
    n = F.size(F.array_distinct(F.transform("sops", lambda x: x["sop"])))
    return rows.select(*KEYS, "m.*", "sops", n.alias("instances"))


def latest(rows: DataFrame) -> DataFrame:
    """Of each series the rows of its last version."""
    version = F.struct("batch", "step")
    return rows.withColumn("_last", F.max(version).over(Window.partitionBy(UID))).where(version == F.col("_last")).drop("_last")


def offers(series: DataFrame) -> DataFrame:
    """(kind, target, series, path): SOPs, and the frames of CTs."""
    uid = F.col(UID).alias("series")
    sop = series.select(uid, F.explode("sops").alias("s")).select(F.lit("sop").alias("kind"), F.col("s.sop").alias("target"), "series", F.col("s.path").alias("path"))
    frame = series.where("Modality = 'CT'").select(F.lit("frame").alias("kind"), F.col("FrameOfReferenceUID").alias("target"), uid, "path")
    return sop.unionByName(frame).where("target is not null")


def questions(series: DataFrame) -> DataFrame:
    """(kind, target, series) of what series ask for: SOPs, a PT's frame, series."""
    uid = F.col(UID).alias("series")
    asked = series.where(F.col("Modality").isin(*crawl.BY_SOP) & (F.coalesce("ReferencedSeriesUID", F.lit("")) == ""))
    sop = asked.select(F.lit("sop").alias("kind"), F.explode("ReferencedSOPUIDs").alias("target"), uid)
    frame = series.where("Modality = 'PT'").select(F.lit("frame").alias("kind"), F.col("FrameOfReferenceUID").alias("target"), uid)
    named = series.select(F.lit("series").alias("kind"), F.explode(F.split("ReferencedSeriesUID", ";")).alias("target"), uid).where("target <> ''")
    return sop.unionByName(frame).unionByName(named).where("target is not null").distinct()


def renamed(series: DataFrame, c: str = "series") -> DataFrame:
    return series.select(F.col(c).alias(UID))


class LiveIndex:
    """The tables below ``folder``; ``apply`` takes batches in order, each as often as need be."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _table(self, name: str, among: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(TABLES[name] + ", bucket int").parquet(f"{self.folder}/{name}")
        return rows if among is None else rows.where(F.col("bucket").isin(among))

    def _among(self, keys: DataFrame, column: str) -> list[int] | None:
        """The buckets of the keys, no more than there are buckets; none if these are all."""
        found = [r[0] for r in keys.select(bucket(column, self.buckets)).distinct().collect()]
        return found if len(found) < self.buckets else None

    def _write(self, rows: DataFrame, name: str, part: str, key: str) -> None:
        """Files by bucket, from the tasks that hold the rows."""
        rows.withColumn("bucket", bucket(key, self.buckets)).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/{name}/{part}")

    def apply(self, batch: DataFrame, n: int) -> None:
        self._write(gathered(batch.where("error is null")), "series", f"batch={n}/step=0", UID)
        fresh = self._table("series").where(f"batch = {n} and step = 0")
        if fresh.isEmpty():
            return
        self._link(fresh, n)
        whole = self._continued(fresh, n)
        rest = storage.stored(self.spark, self._asking(fresh, n), "rest")
        older = self._table("series", self._among(rest, UID)).where(f"batch < {n}").drop("sops")
        rest = storage.stored(self.spark, latest(older.join(rest, UID, "left_semi")).drop("batch", "step", "bucket"), "touched")
        touched = whole.select(*rest.columns).unionByName(rest)
        self._write(self._rows(touched, n).select(*INDEX_KEYS), "index", f"batch={n}", UID)

    def _link(self, fresh: DataFrame, n: int) -> None:
        """Writes what the batch asks for and offers, and the offers that it made known."""
        self._write(questions(fresh), "asks", f"batch={n}", "target")
        asks = self._table("asks").where(f"batch <= {n}")
        keys = ["bucket", "kind", "target"]
        offered = offers(fresh).withColumn("bucket", bucket("target", self.buckets))
        offered = offered.join(asks.select(*keys, F.lit(True).alias("asked")).distinct(), keys, "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        self._write(offered, "offers", f"batch={n}", "target")
        known = self._table("offers").where(f"batch = {n} and asked")
        new = asks.where(f"batch = {n} and kind <> 'series'")
        if n > 0 and not new.isEmpty():
            old = self._table("offers", self._among(new, "target")).where(f"batch < {n} and not asked")
            known = known.unionByName(old.join(new, keys, "left_semi"))
        self._write(known.drop("asked", "batch"), "known", f"batch={n}", "target")

    def _continued(self, fresh: DataFrame, n: int) -> DataFrame:
        """The batch's series, those that go on from earlier batches as a whole."""
        older = self._table("series", self._among(fresh, UID)).where(f"batch < {n}")
        on = storage.stored(self.spark, older.select(UID).join(fresh.select(UID), UID, "left_semi").distinct(), "on")
        if on.isEmpty():
            at = f"{self.folder}/series/batch={n}/step=1"
            storage.hadoop(self.spark, at).delete(storage.hadoop_path(self.spark, at), True)
            return fresh
        before = latest(older.join(on, UID, "left_semi")).select(fresh.columns)
        self._write(merged(fresh.join(on, UID, "left_semi").select(fresh.columns).unionByName(before)), "series", f"batch={n}/step=1", UID)
        return fresh.join(on, UID, "left_anti").unionByName(self._table("series").where(f"batch = {n} and step = 1"))

    def _asking(self, fresh: DataFrame, n: int) -> DataFrame:
        """The other series that asked for the batch's ones, or for anything that these offer or offered."""
        own = fresh.select(F.col(UID).alias("series"))
        told = self._table("known").where(f"batch <= {n}").join(own, "series", "left_semi").select("kind", "target")
        told = told.unionByName(own.select(F.lit("series").alias("kind"), F.col("series").alias("target")))
        asks = self._table("asks").where(f"batch < {n}").join(told, ["kind", "target"], "left_semi")
        return renamed(asks).distinct().join(fresh.select(UID), UID, "left_anti")

    def _rows(self, touched: DataFrame, n: int) -> DataFrame:
        """Index rows of the touched series, from theirs and the series that they refer to."""
        asked = storage.stored(self.spark, questions(touched), "asked")
        near = self._table("known", self._among(asked, "target")).where(f"batch <= {n}").join(asked, ["kind", "target"], "left_semi").select("kind", "target", "series", "path")
        near = storage.stored(self.spark, near.distinct(), "near")
        others = renamed(near).unionByName(renamed(asked.where("kind = 'series'"), "target")).distinct().join(touched.select(UID), UID, "left_anti")
        others = storage.stored(self.spark, others, "others")
        narrow = [*KEYS, "Modality", "FrameOfReferenceUID"]
        theirs = self._table("series", self._among(others, UID)).where(f"batch < {n}").select(*narrow, "batch", "step").join(others, UID, "left_semi")
        seen = touched.select(*narrow).unionByName(latest(theirs).select(*narrow))
        sops = crawl.sop_map(near.where("kind = 'sop'").select(F.col("target").alias("SOPInstanceUID"), F.col("series").alias(UID), "path"))
        found = crawl.resolve_by_sop(touched, sops, crawl.BY_SOP).unionByName(crawl.resolve_by_frame(seen)).withColumn("own", F.lit(None).cast("string"))
        found = found.unionByName(touched.where("ReferencedSeriesUID <> ''").select(*KEYS, F.lit(None).cast("string").alias("resolved"), F.col("ReferencedSeriesUID").alias("own")))
        found = found.groupBy(*KEYS).agg(F.coalesce(F.max("resolved"), F.max("own")).alias("ReferencedSeriesUID"))
        named = crawl.reference_modalities(found, seen.groupBy(UID).agg(F.min("Modality").alias("Modality")))
        # joined by series alone, which deals the rows for the last two steps too
        named = named.groupBy(UID).agg(F.collect_list(F.struct("SubSeries", "ReferencedSeriesUID", "ReferencedModality")).alias("found"))
        mine = F.get(F.filter("found", lambda x: x["SubSeries"] == F.col("SubSeries")), 0)
        rows = touched.drop("ReferencedSeriesUID", "ReferencedSOPUIDs").join(named, UID, "left").withColumn("found", mine).select("*", "found.ReferencedSeriesUID", "found.ReferencedModality")
        return crawl.keep_first(crawl.with_folder(rows).select(*INDEX_KEYS))

    def read(self) -> DataFrame:
        """The index rows as of now: of each series those of the last batch that touched it."""
        last = F.max("batch").over(Window.partitionBy(UID))
        return self._table("index").withColumn("_last", last).where("batch = _last").select(*INDEX_KEYS)


def start(spark: SparkSession, directory: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps the index of a growing directory below ``folder``."""
    live = LiveIndex(spark, folder)
    return stream_instances(spark, directory).writeStream.foreachBatch(live.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
