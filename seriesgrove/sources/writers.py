"""Templated file writing from a DataFrame, repeatable under lost tasks, and the index of what was written.

Tasks write files under names of their own attempt and report them; only what
the committed manifest names is then published, by renaming, into its place.
Publishing twice gives the same result, so a retried task, a lost executor or a
second action on the result does no harm: ``save`` runs once and returns stored
rows.
"""

from __future__ import annotations

import gzip
import io
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import storage
from ..errors import MissingPlaceholderValueError, WriterIndexError
from ..functions import strings as X
from ..operators import outputs, volumes
from . import nifti

MODES = ("fail", "skip", "overwrite")


def npz(arrays: dict[str, np.ndarray], compressed: bool = True) -> bytes:
    out = io.BytesIO()
    (np.savez_compressed if compressed else np.savez)(out, **arrays)
    return out.getvalue()


def encoded(r: dict, form: str, level: int) -> bytes:
    """The bytes of a volume row: ``nii``, ``nii.gz`` or ``npz`` (one array, or those of the row's ``arrays``); masks are unsigned bytes or wider."""
    a = volumes.array_of(r["voxels"], r["size"])
    if r.get("kind") == "mask":
        top = int(a.max(initial=0))
        a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)
    if form == "npz":
        return npz({"image_array": a, **{k: np.array(r[k], float) for k in ("spacing", "origin", "direction")}}, level > 0)
    data = nifti.encode(a, tuple(r["spacing"]), tuple(r["origin"]), tuple(r["direction"]), level)
    return data if form == "nii.gz" else gzip.decompress(data)


@dataclass
class Writer:
    """Writes volume rows below ``root`` under names made by ``filename_format`` from their columns, their ``meta``, ``context`` and saved_time.

    ``existing``: fail (the row gets an error), skip or overwrite.  The index
    (all context, or only what the pattern names) is upserted by file path.
    """

    spark: SparkSession
    root: str
    filename_format: str
    existing: str = "fail"
    context: dict[str, object] = field(default_factory=dict)
    sanitize: bool = True
    compression_level: int = 9
    truncate_uids: int = 8
    include_all_context: bool = True
    absolute_paths: bool = False
    index_path: str | None = None

    def __post_init__(self) -> None:
        if self.existing not in MODES:
            raise ValueError(f"unknown mode {self.existing!r}; one of {MODES}")
        if not 0 <= self.compression_level <= 9:
            raise ValueError("the compression level is 0 to 9")
        self.root = storage.qualified(self.spark, self.root)
        self.keys = X.template_keys(self.filename_format)
        self.form = next((f for f in ("nii.gz", "nii", "npz") if self.filename_format.endswith("." + f)), None)
        if self.form is None:
            raise ValueError("the file name must end in .nii, .nii.gz or .npz")

    def value(self, rows: DataFrame, key: str, saved: str) -> Column:
        """A context value as text: a column, else a fixed value, else an entry of ``meta``."""
        fixed = self.context | {"saved_time": saved}
        if key in rows.columns:
            return F.col(f"`{key}`").cast("string")
        if key in fixed:
            return F.lit(str(fixed[key]))
        if "meta" in rows.columns:
            return F.element_at("meta", F.lit(key))
        raise MissingPlaceholderValueError(f"nothing gives a value for {key!r}")

    def targets(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their ``target``, a path below the root, null where a value is missing; UIDs are cut in the path only."""
        saved = time.strftime("%Y-%m-%d:%H:%M:%S", time.gmtime())
        values = {k: self.value(rows, k, saved) for k in self.keys}
        values = {k: X.truncate_uid(v, self.truncate_uids) if k.endswith("UID") else v for k, v in values.items()}
        whole = X.template(self.filename_format, values)
        known = F.lit(True)
        for v in values.values():
            known = known & v.isNotNull()
        return rows.withColumn("target", F.when(known, X.sanitize_file_name(whole) if self.sanitize else whole))

    def preview(self, rows: DataFrame) -> DataFrame:
        """target and what would happen to it (write, skip, overwrite or fail); nothing is written or deleted."""
        root, mode = self.root, self.existing

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                act = [None if t is None else mode if storage.exists(f"{root}/{t}") else "write" for t in b["target"]]
                yield pd.DataFrame({"target": b["target"], "action": act})

        return self.targets(rows).select("target").mapInPandas(run, "target string, action string")

    def save(self, rows: DataFrame) -> DataFrame:
        """Writes the volumes; returns stored rows: every column but the voxels, target, filepath, status (written, skipped) and error."""
        spark, root, form, level, mode = self.spark, self.root.rstrip("/"), self.form, self.compression_level, self.existing
        parts = f"{root}/.parts-{storage.attempt_name()}"
        planned = self.targets(rows)
        if "error" not in planned.columns:
            planned = planned.withColumn("error", F.lit(None).cast("string"))
        missing = F.when(F.col("target").isNull(), F.lit("SaveError: MissingPlaceholderValueError: a value of the file name is missing"))
        planned = planned.withColumn("error", F.coalesce("error", missing)).withColumn("part", F.lit(None).cast("string"))

        def one(r: dict) -> dict:
            name = f"{parts}/{storage.attempt_name()}-{hash(r['target']) & 0xFFFFFFFFFFFF:x}-{time.monotonic_ns():x}"
            storage.write_bytes(name, encoded(r, form, level))
            return {"part": name, "voxels": b""}

        made = storage.stored(spark, volumes.map_rows(planned, one, "SaveError").drop("voxels"), "manifest")
        made = storage.spread(made, "target").withColumn("_first", F.min("part").over(Window.partitionBy("target")))
        twice = F.when(F.col("part") != F.col("_first"), F.lit("SaveError: FileExistsError: another row has the same target"))
        made = made.withColumn("error", F.coalesce("error", twice)).drop("_first")
        names = [*made.columns, "filepath", "status"]

        def publish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for r in b.itertuples(index=False):
                    row, status, error = dict(zip(names, r, strict=False)), None, r.error if isinstance(r.error, str) else None
                    goal = None if error else f"{root}/{row['target']}"
                    if error is None and storage.exists(row["part"]):
                        there = storage.exists(goal)
                        if there and mode == "fail":
                            error = f"SaveError: FileExistsError: {goal}"
                        elif there and mode == "skip":
                            status = "skipped"
                        else:
                            storage.move(row["part"], goal)
                            status = "written"
                    elif error is None:
                        status = "written"  # an earlier attempt has published it
                    out.append((*r, None if error else goal, status))
                    out[-1] = tuple(error if n == "error" else v for n, v in zip(names, out[-1], strict=True))
                yield pd.DataFrame(out, columns=names)

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
        done = storage.large(spark, made.mapInPandas(publish, f"{kinds}, filepath string, status string"), "saved").drop("part")
        storage.hadoop(spark, parts).delete(storage.hadoop_path(spark, parts), True)
        if self.index_path:
            self.index(done)
        return done

    def index(self, done: DataFrame) -> None:
        """Upserts the index rows of written files."""
        good = done.where("status = 'written'")
        try:
            skip = {"target", "status", "error", "filepath", "part", "meta"}
            flat = [F.col(f.name).cast("string").alias(f.name) for f in good.schema if f.name not in skip]
            if self.include_all_context:
                more = sorted(r.k for r in good.select(F.explode(F.map_keys("meta")).alias("k")).distinct().collect()) if "meta" in good.columns else []  # header fields
                more = [k for k in more if k not in good.columns]
                cols = [*flat, *[F.element_at("meta", F.lit(k)).alias(k) for k in more], *[F.lit(str(v)).alias(k) for k, v in self.context.items() if k not in good.columns]]
            else:
                cols = [self.value(good, k, "").alias(k) for k in self.keys]
            path = F.col("filepath") if self.absolute_paths else F.col("target")
            outputs.IndexStore(self.spark, self.index_path).upsert(good.select(path.alias("filepath"), *cols))
        except Exception as e:
            raise WriterIndexError(f"the index {self.index_path} was not written: {e}") from e
