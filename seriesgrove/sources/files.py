"""Finding files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators.volumes import batched


def path_filter(path: str, terms: list[str]) -> Column:
    """All terms occur in the path."""
    return reduce(lambda a, b: a & b, [F.contains(F.col(path), F.lit(t)) for t in terms], F.lit(True))


def has_magic(content: str = "content") -> Column:
    return F.substring(F.col(content), 129, 4) == F.lit(b"DICM")


def path_has_magic() -> Callable[[Column], Column]:
    """Whether the file at a path has the magic bytes, from its head alone; a file that can't be opened hasn't."""
    from pyspark.sql.functions import pandas_udf

    def run(paths: pd.Series) -> pd.Series:
        def one(path: str) -> bool:
            try:
                return storage.read_bytes(path, 132)[128:] == b"DICM"
            except OSError:
                return False

        return paths.map(one)

    return pandas_udf(run, "boolean")


def listed(spark: SparkSession, directory: str, recursive: bool = True) -> DataFrame:
    """path, modified (microseconds), length of the files below a folder, names that begin with a dot or an underscore left out as by Spark's readers.

    Tasks list the folders of a level, dealt among them, so that the driver
    holds no file; a reader's own index holds them all there.
    """
    fs, at = storage.hadoop(spark, directory), storage.hadoop_path(spark, directory)
    tops = [fs.getFileStatus(at)] if fs.exists(at) else list(fs.globStatus(at) or [])
    if not tops:
        raise FileNotFoundError(f"PATH_NOT_FOUND: {directory}")
    kind = "path string, modified long, length long, is_folder boolean"
    top = [(t.getPath().toString(), t.getModificationTime() * 1000, t.getLen(), t.isDirectory()) for t in tops]
    found = [spark.createDataFrame(top, kind)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def shown(path: str) -> bool:
            name = path.rpartition("/")[2]
            return not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))

        for b in batches:
            yield from batched((e for path in b["path"] for e in storage.entries(path) if shown(e[0])), ["path", "modified", "length", "is_folder"])

    while True:
        folders = found[-1].where("is_folder")
        if (len(found) > 1 and not recursive) or folders.isEmpty():
            break
        found.append(storage.stored(spark, storage.spread(folders, "path").mapInPandas(run, kind), "listing"))
    return reduce(DataFrame.unionByName, found).where("not is_folder").drop("is_folder")


def find_dicoms(
    spark: SparkSession,
    directory: str,
    recursive: bool = True,
    check_header: bool = False,
    extension: str = "dcm",
    case_sensitive: bool = False,
    limit: int | None = None,
    search_input: list[str] | None = None,
) -> DataFrame:
    """path, modificationTime, length, content of the files, ordered by path when limited; content is read only if used.

    Files are dealt to as many tasks as the session's shuffles have.
    ``check_header`` opens each file for its first 132 bytes.
    """
    ending = "." + (extension if case_sensitive else extension.lower())
    name = F.element_at(F.split("path", "/"), -1)
    found = listed(spark, directory, recursive).where(F.endswith(name if case_sensitive else F.lower(name), F.lit(ending)))
    if search_input:
        found = found.where(path_filter("path", search_input))
    found = storage.spread(found, "path")
    if check_header:
        found = found.where(path_has_magic()(F.col("path")))
    content = F.udf(storage.read_bytes, "binary", useArrow=False)
    found = found.select("path", F.timestamp_micros("modified").alias("modificationTime"), "length", content("path").alias("content"))
    return found.orderBy("path").limit(limit) if limit else found
