"""The nnU-Net variant of the pipeline: one mask per sample with all keys, its image, the dataset's layout and manifest."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..errors import MaskSavingStrategyError
from ..operators import outputs, roi
from ..sources import structures, writers
from ..storage import large, stored
from . import pipeline

#: The image channels of the layout, and its file name.
CHANNELS = {"CT": "0000", "MR": "0001"}
LAYOUT = "{DirType}{SplitType}/{Dataset}_{SampleID}.nii.gz"
ALLOWED = tuple(frozenset((image, mask)) for image in ("CT", "MR") for mask in ("SEG", "RTSTRUCT"))


class MaskSavingStrategy(str, Enum):
    LABEL_IMAGE = "label"
    SPARSE_MASK = "sparse"
    REGION_MASK = "region"


def check_modalities(asked: list[str]) -> None:
    """One image and one mask modality: CT or MR with SEG or RTSTRUCT."""
    if frozenset(asked) not in ALLOWED:
        raise ValueError(f"modalities {asked} are not allowed; one of {sorted(','.join(sorted(a)) for a in ALLOWED)}")


def used_ids(spark: SparkSession, raw: str) -> list[int]:
    fs, at = storage.hadoop(spark, raw), storage.hadoop_path(spark, raw)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return [int(m[1]) for n in names if (m := re.match(r"Dataset(\d{3})", n))]


@dataclass
class NNUNetPipeline:
    """Directory to a training dataset: regions merge by key, a sample without a match or without all keys fails."""

    spark: SparkSession
    input_directory: str
    output_directory: str
    modalities: list[str]
    roi_match_map: object
    mask_saving_strategy: MaskSavingStrategy | str = MaskSavingStrategy.LABEL_IMAGE
    existing_file_mode: str = "fail"
    spacing: tuple[float, float, float] = (0.0, 0.0, 0.0)
    window: float | None = None
    level: float | None = None
    roi_ignore_case: bool = True
    roi_allow_multi: bool = True
    update_crawl: bool = False

    def __post_init__(self) -> None:
        check_modalities(self.modalities)
        try:
            self.mask_saving_strategy = MaskSavingStrategy(self.mask_saving_strategy)
        except ValueError as e:
            raise MaskSavingStrategyError(f"no strategy {self.mask_saving_strategy!r}") from e
        root = self.output_directory.rstrip("/")
        self.keys = list(roi.normalize_map(self.roi_match_map))
        self.dataset = re.sub(r"[^A-Za-z0-9]+", "_", self.input_directory.rstrip("/").rpartition("/")[2]) or "Dataset"
        raw = f"{root}/nnUNet_raw"
        for folder in ("nnUNet_results", "nnUNet_preprocessed", "nnUNet_raw"):
            storage.hadoop(self.spark, root).mkdirs(storage.hadoop_path(self.spark, f"{root}/{folder}"))
        taken = F.array(*[F.lit(i) for i in used_ids(self.spark, raw)]).cast("array<int>")
        self.dataset_id = self.spark.range(1).select(outputs.free_dataset_id(taken).alias("i")).head().i
        self.folder = f"{raw}/Dataset{self.dataset_id:03d}_{self.dataset}"
        self.loader = pipeline.SampleLoader(
            self.spark, self.input_directory, f"{root}/.crawl", self.modalities, self.roi_match_map, roi.ROIMatchStrategy.MERGE, self.roi_ignore_case, self.roi_allow_multi,
            roi.ROIMatchFailurePolicy.ERROR, self.update_crawl,
        )
        self.transformer = pipeline.Transformer(self.spacing, window=self.window, level=self.level)
        self.writer = writers.Writer(self.spark, self.folder, LAYOUT, self.existing_file_mode, {"Dataset": self.dataset, "SplitType": "Tr"}, index_path=f"{root}/.index-{self.dataset_id:03d}")

    def run(self) -> DataFrame:
        """Result rows as the general pipeline's; writes images, labels, the manifest and the scripts."""
        numbered = large(self.spark, self.loader.query(first=1), "samples")
        rows = large(self.spark, self.transformer(self.spark, self.loader.load(numbered)), "transformed")
        done = self.writer.save(self.laid_out(rows))
        done = done.withColumnsRenamed({"SampleNumber": "sample_number", "SeriesInstanceUID": "series"})
        results = stored(self.spark, pipeline.sample_results(numbered, self.loader.members(numbered), done, 0.0), "results")
        self.finalize(done)
        return results

    def laid_out(self, rows: DataFrame) -> DataFrame:
        """One image per CT or MR series and the first mask with all keys per sample; a sample without such a mask has only an error."""
        drawn = rows.where("kind = 'mask' and roi_key is not null").withColumn("roi_names", F.split("matched_rois", r"\|"))
        masks = large(self.spark, structures.encode_mask(drawn, self.keys, self.mask_saving_strategy.value), "encoded")
        bad = rows.where("kind = 'mask' and roi_key is null").select("sample_number", "series", "error").where("error is not null")
        masks = masks.unionByName(bad, allowMissingColumns=True)
        ranked = masks.groupBy("sample_number").agg(F.min(F.struct(F.col("error").isNotNull().alias("a"), F.col("series").alias("b"))).alias("m"))
        best = large(self.spark, masks.join(ranked, "sample_number").where(F.col("series") == F.col("m.b")).drop("m"), "masks")
        good = best.where("error is null").select("sample_number")
        images = rows.where("kind = 'image'").join(good, "sample_number", "left_semi")
        lost = rows.where("is_reference").select("sample_number", "series", "error").join(best.select("sample_number"), "sample_number", "left_anti")
        lost = lost.withColumn("error", F.coalesce("error", F.lit("NoSegmentationImagesError: no mask was loaded")))
        failed = best.where("error is not null").select("sample_number", "series", "error").unionByName(lost).withColumn("kind", F.lit("mask"))
        channel = F.element_at(F.create_map(*[F.lit(x) for kv in CHANNELS.items() for x in kv]), F.col("modality"))
        images = images.where(F.col("modality").isin(*CHANNELS)).withColumn("DirType", F.lit("images")).withColumn("SampleID", F.concat_ws("_", "sample_number", channel))
        labels = best.where("error is null").withColumn("DirType", F.lit("labels")).withColumn("SampleID", F.col("sample_number")).withColumn("kind", F.lit("mask"))
        labels = labels.withColumn("meta", F.transform_keys("roi_names", lambda k, _: F.concat(F.lit("roi_matches."), k))).drop("roi_names")
        unread = rows.where("is_reference and error is not null").select("sample_number", "series", "error", "is_reference", F.lit("image").alias("kind"))
        out = images.unionByName(labels, allowMissingColumns=True).unionByName(failed, allowMissingColumns=True).unionByName(unread, allowMissingColumns=True)
        out = out.withColumn("is_reference", F.coalesce("is_reference", F.lit(False)))
        return out.withColumnsRenamed({"sample_number": "SampleNumber", "series": "SeriesInstanceUID", "modality": "Modality"})

    def finalize(self, done: DataFrame) -> None:
        """dataset.json and the two scripts that preprocess and train."""
        good = done.where("status is not null")
        kinds = [r.Modality for r in good.where("DirType = 'images'").select("Modality").distinct().collect()]  # CT, MR
        n = good.where("DirType = 'images'").count()
        regions = self.mask_saving_strategy == MaskSavingStrategy.REGION_MASK
        manifest = json.loads(outputs.dataset_manifest(kinds, self.keys, n, regions))
        if regions:
            manifest["regions_class_order"] = list(range(1, len(self.keys) + 1))
        at = storage.qualified(self.spark, self.folder)
        storage.write_bytes(f"{at}/dataset.json", json.dumps(manifest, indent=2).encode())
        head = f'#!/bin/bash\nset -e\nexport nnUNet_raw="{at.rpartition("/")[0]}"\n'
        for name, line in (("preprocess", f"nnUNetv2_plan_and_preprocess -d {self.dataset_id} --verify_dataset_integrity"), ("train", f"nnUNetv2_train {self.dataset_id} 3d_fullres ${{1:-0}}")):
            storage.write_bytes(f"{at}/nnunet_{name}.sh", (head + line + "\n").encode())
