"""Pipelines: directory to index, index to samples, samples to written volumes, file sorting."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CrawlResultsNotAvailableError, InvalidDICOMKeyError, NoValidSamplesError
from ..functions import strings as X
from ..operators import crawl, forest, outputs, roi, volumes
from ..schemas import DUPLICATE_KEYS, INDEX
from ..sources import actions, dicom, series, structures, writers
from ..sources.dicom_tags import similar_tags, tag_exists
from .. import storage
from ..storage import large, stored, write_bytes
from . import validators


@dataclass
class Crawler:
    """Crawls a directory into stored instance rows and an index; reuses them unless forced."""

    spark: SparkSession
    dicom_dir: str
    output_dir: str
    force: bool = False

    def _stored(self, name: str, build) -> DataFrame:  # noqa: ANN001
        path = f"{self.output_dir}/{name}.parquet"
        if not self.force:
            try:
                return storage.unless_small(self.spark, self.spark.read.parquet(path), path)
            except Exception as e:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        build().write.mode("overwrite").parquet(path)
        return storage.unless_small(self.spark, self.spark.read.parquet(path), path)

    def instances(self) -> DataFrame:
        return self._stored("instances", lambda: dicom.crawl(self.spark, self.dicom_dir))

    def index(self) -> DataFrame:
        return self._stored("index", lambda: crawl.build_index(self.instances().where("error is null")))

    def series_info(self, uid: str) -> dict:
        """The index row of a series' first subseries; an unknown UID is a ValueError."""
        found = self.index().where(F.col("SeriesInstanceUID") == uid).orderBy("SubSeries").head()
        if found is None:
            raise ValueError(f"no series {uid!r}")
        return found.asDict()

    def modality(self, uid: str) -> str:
        return self.series_info(uid)["Modality"]

    def folder(self, uid: str) -> str:
        return self.series_info(uid)["folder"]

    def files(self, uid: str, sub_series: str | None = None) -> DataFrame:
        """The files of a series, or of one subseries, in order of path."""
        rows = self.instances().where((F.col("error").isNull()) & (F.col("SeriesInstanceUID") == uid)).withColumn("SubSeries", crawl.sub_series())
        return rows.where(F.col("SubSeries") == sub_series if sub_series is not None else F.lit(True)).select("path", "SOPInstanceUID", "SubSeries").orderBy("path")

    def write_sinks(self) -> None:
        """crawl-cache (headers as found), sop_map and crawl_db (series after resolution) as JSON lines, and the index as CSV."""
        if not _readable(self.spark, f"{self.output_dir}/instances.parquet"):
            raise CrawlResultsNotAvailableError("crawl first: instances() or index()")
        good = self.instances().where("error is null")
        grouped, sops = stored(self.spark, crawl.group_series(good), "grouped"), stored(self.spark, crawl.sop_map(good), "sops")
        out = lambda df, name: df.write.mode("overwrite").json(f"{self.output_dir}/{name}.json")
        out(grouped, "crawl-cache")
        out(sops, "sop_map")
        out(crawl.referenced_modality(crawl.resolve(grouped, sops)), "crawl_db")
        self.index().orderBy("PatientID", "SeriesInstanceUID", "SubSeries").write.mode("overwrite").option("header", True).csv(f"{self.output_dir}/index.csv")


def _readable(spark: SparkSession, path: str) -> bool:
    return bool(storage.hadoop(spark, path).exists(storage.hadoop_path(spark, path)))


def forest_of(index: DataFrame) -> forest.SeriesForest:
    forest.check_duplicates(index, DUPLICATE_KEYS)
    rows = index.select(F.col("SeriesInstanceUID").alias("uid"), F.col("PatientID").alias("pid"), F.col("Modality").alias("modality"), F.col("ReferencedSeriesUID").alias("ref"), "SubSeries")
    return forest.SeriesForest(rows, order="SubSeries")


def samples(index: DataFrame, query: str = "*", first: int = 0) -> DataFrame:
    """sample_number, pid, root, members for a query, numbered by patient."""
    grouped = forest.group_by_root(forest_of(index).query(query))
    if grouped.isEmpty():
        valid = sorted(r.query for r in forest_of(index).valid_queries().collect())  # at most one per modality set
        raise NoValidSamplesError(f"no sample for {query!r}; valid queries are {valid}")
    rows = grouped.select("pid", F.col("first.uid").alias("root"), F.concat(F.array("first"), "others").alias("members"))
    return forest.numbered(rows, "pid", "root", first)


def load_index(spark: SparkSession, source: object) -> DataFrame:
    """The index from a CSV path or a DataFrame; empty text counts as null."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str):
        return spark.read.schema(INDEX).option("header", True).csv(source)
    raise TypeError(f"an index is a CSV path or a DataFrame, not {type(source).__name__}")


@dataclass
class SampleLoader:
    """Images and masks of samples as volume rows, from a directory of DICOM files.

    Per sample the reference series (CT before MR before PT, then the first) and
    the other members are read; further series of the reference's modality are
    left aside.  Structure sets and segmentations become masks of their matched
    regions on the reference's grid.  What can't be loaded is a row with
    ``error``; nothing is dropped.
    """

    spark: SparkSession
    directory: str
    output_dir: str
    modalities: list[str] | None = None
    roi_match_map: object = None
    roi_strategy: roi.ROIMatchStrategy = roi.ROIMatchStrategy.MERGE
    roi_ignore_case: bool = True
    roi_allow_multi: bool = True
    roi_on_missing: roi.ROIMatchFailurePolicy = roi.ROIMatchFailurePolicy.IGNORE
    update_crawl: bool = False
    load_subseries: bool = False
    pet_image_type: series.PETImageType = series.PETImageType.SUV

    def __post_init__(self) -> None:
        validators.directory(self.spark, self.directory)
        self.roi_match_map = roi.normalize_map(self.roi_match_map)
        self.crawler = Crawler(self.spark, self.directory, self.output_dir, self.update_crawl)

    def query(self, first: int = 0) -> DataFrame:
        return samples(self.crawler.index(), forest.query_text(self.modalities), first)

    def members(self, numbered: DataFrame) -> DataFrame:
        """sample_number, pid, pos, series, modality, is_reference; extra series of the reference's modality are not members."""
        each = numbered.select("sample_number", "pid", F.posexplode("members").alias("pos", "m"))
        each = each.select("sample_number", "pid", "pos", F.col("m.uid").cast("string").alias("series"), F.col("m.modality").alias("modality"))
        best = forest.reference_series(each, "sample_number", "modality", "pos").select("sample_number", F.col("pos").alias("_p"), F.col("modality").alias("_m"))
        each = each.join(best, "sample_number", "left").withColumn("is_reference", F.coalesce(F.col("pos") == F.col("_p"), F.lit(False)))
        return each.where(F.col("is_reference") | F.col("_m").isNull() | (F.col("modality") != F.col("_m"))).drop("_p", "_m")

    def load(self, numbered: DataFrame) -> DataFrame:
        """Volume rows: sample_number, pid, series, modality, kind (image, mask), is_reference, image_id, roi_key, matched_rois, channel, geometry, voxels, meta, error."""
        spark = self.spark
        each = large(spark, self.members(numbered), "members")
        found = self.crawler.instances().where("error is null").withColumnRenamed("SeriesInstanceUID", "series")
        used = lambda kinds: found.join(each.where(F.col("modality").isin(*kinds)).select("series").distinct(), "series", "left_semi")
        read = series.load_series(used(series.READERS).withColumnRenamed("series", "SeriesInstanceUID"), self.load_subseries, self.pet_image_type)
        read = large(spark, read.drop("modality"), "images")
        images = each.where(F.col("modality").isin(*series.READERS)).join(read, "series", "left")
        gone = F.when(F.col("sub_series").isNull(), F.lit("LoadError: the series has no files"))
        none = lambda kind: F.lit(None).cast(kind)
        images = images.select(
            "sample_number", "pid", "series", "modality", F.lit("image").alias("kind"), "is_reference", F.col("modality").alias("image_id"), none("string").alias("roi_key"),
            none("string").alias("matched_rois"), none("int").alias("channel"), "size", "spacing", "origin", "direction", "voxels", "meta", F.coalesce("error", gone).alias("error"),
        )
        grids = images.where("is_reference and error is null").select("sample_number", "size", "spacing", "origin", "direction")
        masked = each.where(F.col("modality").isin("RTSTRUCT", "SEG")).select("sample_number", "pid", "series", "modality")
        regions = large(spark, structures.read_regions(used(("RTSTRUCT", "SEG")).withColumnRenamed("series", "SeriesInstanceUID")), "regions")
        matched = roi.match(regions.where("roi is not null"), roi.pattern_rows(spark, self.roi_match_map), self.roi_strategy, self.roi_ignore_case, self.roi_allow_multi)
        if self.roi_strategy == roi.ROIMatchStrategy.KEEP_FIRST:
            matched = matched.withColumn("image_id", F.concat("key", F.lit("__["), F.get("roi_names", F.lit(0)), F.lit("]")))
        # A series may be in several samples, so (sample, series) names a mask.
        name = F.concat_ws("\x1f", "sample_number", "series")
        own = masked.withColumn("_id", name)
        by = lambda df: own.select("_id", "series").join(df, "series").drop("series").withColumnRenamed("_id", "series")
        drawn = structures.masks(by(regions), by(matched), grids.join(own, "sample_number").select(F.col("_id").alias("series"), "size", "origin", "spacing", "direction"))
        drawn = drawn.withColumnRenamed("series", "_id").join(own, "_id").drop("_id")
        meta = used(("RTSTRUCT", "SEG")).groupBy("series").agg(F.min_by("hdr", "path").alias("meta"))
        drawn = drawn.join(meta, "series", "left")
        wrong = by(regions.where("roi is null")).groupBy("series").agg(F.min("error").alias("error")).withColumnRenamed("series", "_id").join(own, "_id").drop("_id")
        if self.roi_on_missing == roi.ROIMatchFailurePolicy.ERROR:
            got = by(matched).select(F.col("series").alias("_id")).distinct()
            lost = own.join(got, "_id", "left_anti").drop("_id").withColumn("error", F.lit("ROIMatchingError: no region matches any pattern"))
            wrong = wrong.unionByName(lost.join(wrong.select("sample_number", "series"), ["sample_number", "series"], "left_anti"))
        drawn = drawn.withColumn("matched_rois", F.array_join("roi_names", "|")).drop("roi_names")
        drawn = drawn.unionByName(wrong, allowMissingColumns=True).withColumn("kind", F.lit("mask")).withColumn("is_reference", F.lit(False))
        return images.unionByName(drawn, allowMissingColumns=True)


@dataclass
class Transformer:
    """Transforms a sample's images: the reference is resampled, the others go onto its new grid (masks by nearest value), then intensities are changed.

    ``window``, ``clip`` and bias correction touch images only.  What fails is
    a row with ``error``.
    """

    spacing: tuple[float, float, float] = (1.0, 1.0, 0.0)
    interpolation: str = "linear"
    window: float | None = None
    level: float | None = None
    clip: tuple[float, float] | None = None
    correct_bias: bool = False
    steps: list = field(default_factory=list)  # callables (array) -> array of the same size, for images

    def __post_init__(self) -> None:
        if self.window is not None and self.window <= 0:
            raise ValueError("window must be positive")
        if self.clip is not None and self.clip[0] > self.clip[1]:
            raise ValueError("lower exceeds upper")
        if not all(callable(f) for f in self.steps):
            raise ValueError("every step must be callable")

    def __call__(self, spark: SparkSession, rows: DataFrame) -> DataFrame:
        first = volumes.resample(rows.where("is_reference"), self.spacing, self.interpolation)
        first = large(spark, first, "references")
        grid = first.where("error is null").select("sample_number", volumes.geometry(first).alias("ref"))
        rest = rows.where("not is_reference").join(grid, "sample_number", "left")
        lost = F.when(F.col("ref").isNull(), F.lit("TransformError: the sample has no reference image"))
        rest = volumes.like(rest.withColumn("error", F.coalesce("error", lost)), self.interpolation).drop("ref")
        out = first.unionByName(rest)
        if self.correct_bias:
            out = volumes.bias_correct(out)
        low_high = [(self.level - self.window / 2, self.level + self.window / 2)] if self.window is not None and self.level is not None else []
        steps = [*self.steps, *[lambda a, x=x: a.clip(*x) for x in [*([self.clip] if self.clip else []), *low_high]]]
        if not steps:
            return out

        def one(r: dict) -> dict:
            if r["kind"] == "mask":
                return {}
            a = volumes.array_of(r["voxels"], r["size"])
            for f in steps:
                b = np.asarray(f(a))
                if b.shape != a.shape:
                    raise ValueError("a step changed the size of the image")
                a = b
            return {"voxels": a.astype("<f4").tobytes()}

        return volumes.map_rows(out, one)


DEFAULT_FORMAT = "{SampleNumber}__{PatientID}/{Modality}_Series-{SeriesInstanceUID}/{ImageID}.nii.gz"
SIMPLIFIED = ["filepath", "SampleNumber", "PatientID", "Modality", "SeriesInstanceUID", "ImageID", "matched_rois", "size", "spacing", "origin", "direction"]


@dataclass
class Autopipeline:
    """Directory to NIfTI files with an index and reports: load, transform, save; every sample gets a result row."""

    spark: SparkSession
    input_directory: str
    output_directory: str
    filename_format: str = DEFAULT_FORMAT
    existing_file_mode: str = "fail"
    modalities: list[str] | None = None
    spacing: tuple[float, float, float] = (1.0, 1.0, 0.0)
    window: float | None = None
    level: float | None = None
    roi_match_map: object = None
    roi_strategy: roi.ROIMatchStrategy = roi.ROIMatchStrategy.MERGE
    roi_ignore_case: bool = True
    roi_allow_multi: bool = True
    roi_on_missing: roi.ROIMatchFailurePolicy = roi.ROIMatchFailurePolicy.IGNORE
    update_crawl: bool = False
    context: dict[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        crawl_dir = f"{self.output_directory.rstrip('/')}/.crawl"
        self.loader = SampleLoader(
            self.spark, self.input_directory, crawl_dir, self.modalities, self.roi_match_map, self.roi_strategy, self.roi_ignore_case, self.roi_allow_multi, self.roi_on_missing, self.update_crawl
        )
        self.transformer = Transformer(self.spacing, window=self.window, level=self.level)
        self.writer = writers.Writer(
            self.spark, self.output_directory, self.filename_format, self.existing_file_mode, self.context, index_path=f"{self.output_directory.rstrip('/')}/.index"
        )

    def run(self) -> DataFrame:
        """One stored row per sample: SampleID, PatientID, success, error_type, error_message, output_files, input_series, processing_time."""
        began = time.monotonic()
        numbered = large(self.spark, self.loader.query(), "samples")
        rows = self.transformer(self.spark, self.loader.load(numbered))
        done = self.save(rows)
        return stored(self.spark, sample_results(numbered, self.loader.members(numbered), done, time.monotonic() - began), "results")

    def save(self, rows: DataFrame) -> DataFrame:
        named = rows.withColumnsRenamed({"sample_number": "SampleNumber", "pid": "PatientID", "series": "SeriesInstanceUID", "modality": "Modality", "image_id": "ImageID"})
        done = self.writer.save(named)
        return done.withColumnsRenamed({"SampleNumber": "sample_number", "SeriesInstanceUID": "series"})

    def write_reports(self, results: DataFrame) -> dict:
        return write_reports(self.spark, results, self.output_directory, self.writer.index_path, SIMPLIFIED)


def sample_results(numbered: DataFrame, members: DataFrame, done: DataFrame, seconds: float) -> DataFrame:
    """Result rows of samples: a failed reference or no file at all fails the sample; missing series are told but what loaded is kept."""
    asked = members.groupBy("sample_number").agg(F.first("pid").alias("pid"), F.array_sort(F.collect_set("series")).alias("input_series"))
    files = F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.col("filepath"))))
    per = done.groupBy("sample_number").agg(
        files.alias("output_files"), F.min(F.when(F.col("is_reference"), F.col("error"))).alias("reference_error"), F.min("error").alias("any_error"),
        F.array_sort(F.collect_set(F.when(F.col("error").isNull(), F.col("series")))).alias("loaded"),
    )
    every = numbered.select("sample_number").join(asked, "sample_number", "left").join(per, "sample_number", "left")
    none = F.array().cast("array<string>")
    every = every.withColumn("output_files", F.coalesce("output_files", none)).withColumn("loaded", F.coalesce("loaded", none)).withColumn("input_series", F.coalesce("input_series", none))
    lost = F.array_except("input_series", "loaded")
    ok = F.size("output_files") > 0
    said = F.coalesce("reference_error", "any_error")
    partly = F.when(ok & (F.size(lost) > 0), F.concat(F.lit("ROIMatchError: not loaded: "), F.array_join(lost, ", ")))
    failed = F.when(~ok, F.coalesce(said, F.lit("LoadError: no CT, MR or PT series was loaded")))
    message = F.coalesce(F.when(~ok, failed), F.when(said.isNotNull() & ok, said), partly)
    return every.select(
        F.col("sample_number").alias("SampleID"), F.col("pid").alias("PatientID"), ok.alias("success"), F.nullif(F.regexp_extract(message, r"^(\w+):", 1), F.lit("")).alias("error_type"),
        message.alias("error_message"), "output_files", "input_series", F.lit(float(seconds)).alias("processing_time"),
    )


def write_reports(spark: SparkSession, results: DataFrame, output_dir: str, index_path: str | None, columns: list[str]) -> dict:
    """Writes success and failure reports (JSON lines), the simplified index (CSV) and a summary; returns the summary."""
    folder = f"{output_dir.rstrip('/')}/reports"
    results.where("success").write.mode("overwrite").json(f"{folder}/success")
    results.where("not success or error_message is not null").write.mode("overwrite").json(f"{folder}/failure")
    index = outputs.IndexStore(spark, index_path).read() if index_path else None
    if index is not None:
        outputs.simplified(index, columns).write.mode("overwrite").option("header", True).csv(f"{folder}/simplified_index")
    summary = json.loads(report(results))
    write_bytes(f"{storage.qualified(spark, folder)}/summary.json", json.dumps(summary).encode())
    return summary


def report(results: DataFrame) -> str:
    """Counts and success rate as JSON."""
    from ..operators.voxel import success_rate

    return json.dumps(success_rate(results, F.col("success")).head().asDict())


def plan_sort(instances: DataFrame, pattern: str, truncate: int = 5) -> DataFrame:
    """source, target of a file sort; unknown fields in the pattern are an error, missing values ``Unknown``."""
    keys = X.template_keys(pattern, letters_only=True)
    bad = [k for k in keys if not tag_exists(k)]
    if bad:
        raise InvalidDICOMKeyError("; ".join(f"{k}: did you mean {similar_tags(k)}?" for k in bad))
    rows = dicom.read_tags(instances, keys, truncate, default="")
    values = {k: F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit("Unknown")) for k in keys}
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(F.col("path").alias("source"), F.concat(X.sanitize_file_name(X.template(pattern, values, letters_only=True)), F.lit("/"), name).alias("target"))


def sort_duplicates(plan: DataFrame) -> DataFrame:
    return outputs.duplicate_targets(plan, "target", "source")


def sort_files(spark: SparkSession, source: str, pattern: str, target: str, action: str = "copy", overwrite: bool = False, dry_run: bool = False, truncate: int = 5) -> DataFrame:
    """Finds, resolves and acts: a stored row (source, target, status, error) per file; two files for one target are a ValueError before anything is done.

    ``dry_run`` gives the plan with the names unique to each directory level counted by ``outputs.unique_children``.
    """
    rows = dicom.crawl(spark, source, tuple(X.template_keys(pattern, letters_only=True))).where("error is null")
    plan = plan_sort(rows, pattern, truncate).withColumn("target", F.concat(F.lit(storage.qualified(spark, target) + "/"), F.col("target")))
    plan = stored(spark, plan, "sort-plan")
    twice = sort_duplicates(plan).head(3)
    if twice:
        raise ValueError(f"several files for one target: {[r.target for r in twice]}")
    return plan if dry_run else actions.act(spark, plan, action, overwrite)
