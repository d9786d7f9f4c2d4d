"""Output index: upsert, schema merge, path resolution, dataset layout."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..errors import IndexSchemaMismatchError, WriterIndexError


def upsert_index(existing: DataFrame, new: DataFrame, key: str = "filepath", merge_columns: bool = True) -> DataFrame:
    """New rows replace existing ones of the same key; columns are the sorted union, all text, missing ones empty."""
    if not merge_columns and set(existing.columns) != set(new.columns):
        raise IndexSchemaMismatchError(f"{sorted(existing.columns)} against {sorted(new.columns)}")
    text = lambda d: d.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in d.columns])
    both = text(existing).join(text(new).select(key), key, "left_anti").unionByName(text(new), allowMissingColumns=True)
    return filled(both, key)


def filled(rows: DataFrame, key: str) -> DataFrame:
    """The key, then the other columns by name, missing values empty."""
    rest = sorted(c for c in rows.columns if c != key)
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in (key, *rest)])


def simplified(index: DataFrame, columns: list[str]) -> DataFrame:
    """The asked columns, missing ones null, in order of the file path."""
    out = index.select(*[F.col(c) if c in index.columns else F.lit(None).cast("string").alias(c) for c in columns])
    return out.orderBy("filepath") if "filepath" in columns else out


def duplicate_targets(plan: DataFrame, target: str, source: str) -> DataFrame:
    return plan.groupBy(target).agg(F.count(F.lit(1)).alias("n"), F.min(source).alias("first_source")).where("n > 1")


def unique_children(paths: DataFrame, path: str) -> DataFrame:
    """Distinct names at each directory depth."""
    parts = paths.select(F.posexplode(F.filter(F.split(path, "/"), lambda p: p != "")).alias("depth", "part"))
    return parts.groupBy("depth").agg(F.count_distinct("part").alias("n_unique"))


def free_dataset_id(used: Column) -> Column:
    return F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(999)), used))


def region_labels(index: int, n: int) -> list[int]:
    """Region mask values in which channel ``index`` takes part."""
    return [v for v in range(1, 2**n) if v >> index & 1]


def label_rows(names: DataFrame, name: str) -> DataFrame:
    """(name, label): distinct names in order, labelled from 1; region names are a few."""
    listed = names.agg(F.array_sort(F.collect_set(name)).alias("n"))
    return listed.select(F.posexplode("n").alias("i", name)).select(name, (F.col("i") + 1).cast("long").alias("label"))


def region_label_rows(names: DataFrame, name: str) -> DataFrame:
    """(name, labels): the values of a region mask in which each name takes part."""
    listed = names.agg(F.array_sort(F.collect_set(name)).alias("n"))
    rows = listed.select(F.size("n").alias("k"), F.posexplode("n").alias("i", name))
    values = F.filter(F.sequence(F.lit(1), F.expr("shiftleft(1, k) - 1")), lambda v: F.expr("1").bitwiseAND(F.call_function("shiftright", v, F.col("i"))) == 1)
    return rows.select(name, F.array_join(F.transform(values, lambda v: v.cast("string")), ",").alias("labels"))


def channel_rows(modalities: DataFrame, modality: str) -> DataFrame:
    """(channel, modality): CT, then MR, of those that occur, numbered from 0."""
    held = modalities.agg(F.collect_set(modality).alias("m"))
    wanted = F.filter(F.array(F.lit("CT"), F.lit("MR")), lambda x: F.array_contains("m", x))
    return held.select(F.posexplode(wanted).alias("channel", modality)).select(F.col("channel").cast("long").alias("channel"), modality)


def dataset_manifest(modalities: list[str], roi_keys: list[str], n_training: int, regions: bool = False) -> str:
    channels = {str(i): m for i, m in enumerate(m for m in ("CT", "MR") if m in modalities)}
    labels: dict = {"background": 0} | {k: region_labels(i, len(roi_keys)) if regions else i + 1 for i, k in enumerate(roi_keys)}
    return json.dumps({"channel_names": channels, "labels": labels, "numTraining": n_training, "file_ending": ".nii.gz"})


class IndexStore:
    """An index table that several writers upsert: versions below a folder, one writer at a time.

    A writer creates the lock file, which the file system lets only one do,
    writes the next version whole, and removes the lock.  Readers take the
    last whole version, so they never see half of one.  A lock older than
    ``stale`` seconds is one of a dead writer: it is moved away, which again only
    one can do, and the next writer goes on from the last whole version.
    """

    def __init__(self, spark: SparkSession, path: str, wait: float = 60.0, stale: float = 3600.0):
        self.spark, self.path, self.wait, self.stale = spark, path.rstrip("/"), wait, stale

    def _drop_stale(self, fs, lock) -> None:  # noqa: ANN001
        """Moves a lock of a dead writer away; one that another writer has made meanwhile is put back."""
        old = lambda at: time.time() - fs.getFileStatus(at).getModificationTime() / 1000 > self.stale
        try:
            if not old(lock):
                return
            aside = storage.hadoop_path(self.spark, f"{self.path}/_lock-{uuid.uuid4().hex}")
            if fs.rename(lock, aside):
                if old(aside):
                    fs.delete(aside, False)
                else:
                    fs.rename(aside, lock)
        except Exception:  # noqa: BLE001  another writer has moved or removed it
            return

    def versions(self) -> list[int]:
        fs = storage.hadoop(self.spark, self.path)
        root = storage.hadoop_path(self.spark, self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        whole = [n for n in names if n.startswith("v") and fs.exists(storage.hadoop_path(self.spark, f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in whole)

    def read(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{found[-1]:06d}") if found else None

    def upsert(self, new: DataFrame, key: str = "filepath", merge_columns: bool = True) -> DataFrame:
        """New rows replace those of the same key; returns the new version."""
        fs, lock = storage.hadoop(self.spark, self.path), storage.hadoop_path(self.spark, f"{self.path}/_lock")
        until = time.monotonic() + self.wait
        while True:
            try:
                fs.create(lock, False).close()
                break
            except Exception as e:
                self._drop_stale(fs, lock)
                if time.monotonic() > until:
                    raise WriterIndexError(f"{self.path}/_lock is held by another writer") from e
                time.sleep(0.2)
        try:
            found = self.versions()
            old = self.read()
            text = new.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in new.columns])
            rows = upsert_index(old, text, key, merge_columns) if old is not None else filled(text, key)
            at = (found[-1] if found else 0) + 1
            rows.write.mode("overwrite").parquet(f"{self.path}/v{at:06d}")
            for v in found[:-1]:  # the version before stays for those who read it
                fs.delete(storage.hadoop_path(self.spark, f"{self.path}/v{v:06d}"), True)
            return self.read()
        finally:
            fs.delete(lock, False)

    def to_csv(self, folder: str) -> None:
        rows = self.read()
        if rows is not None:
            rows.write.mode("overwrite").option("header", True).csv(folder)
