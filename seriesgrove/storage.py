"""Stored intermediate tables, and files of any file system, read and written by tasks and the driver."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL = 1 << 20  # stored bytes up to which a table that grows with a collection may be broadcast

_local: list[str] = []
_made: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, ``spark.checkpoint.dir``; only a local session may lack it."""
    shared = spark.conf.get("spark.checkpoint.dir", "") or ""
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        folder = tempfile.mkdtemp(prefix="seriesgrove-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local.append("file://" + folder)
    return _local[0]


def new_folder(spark: SparkSession, tag: str) -> str:
    _made.append(f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def stored(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut and sizes are known."""
    path = new_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def large(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """``stored`` for tables that grow with a collection: joins sort and shuffle them once they are more than ``SMALL`` bytes.

    The optimizer broadcasts by the bytes of files, of which repeated text takes
    few; in memory headers of series take many times that.
    """
    return unless_small(spark, stored(spark, df, tag), _made[-1])


def unless_small(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """``df``, read from ``path``, kept from being broadcast if it is more than ``SMALL`` bytes."""
    return df.hint("merge") if hadoop(spark, path).getContentSummary(hadoop_path(spark, path)).getLength() > SMALL else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys to as many tasks as the session's shuffles have.

    For rows that are small but stand for much work (paths of files, contours
    to be drawn): by their bytes they would be coalesced into one task; a number
    that is asked for isn't.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def release(spark: SparkSession) -> None:
    """Deletes this process's intermediate tables; call it when the results are written."""
    while _made:
        hadoop(spark, _made[-1]).delete(hadoop_path(spark, _made.pop()), True)


def hadoop_path(spark: SparkSession, path: str) -> Any:  # noqa: ANN401
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001


def hadoop(spark: SparkSession, path: str) -> Any:  # noqa: ANN401
    """The driver's file system of ``path``."""
    return hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system's scheme, so that tasks open what the driver means."""
    at = hadoop_path(spark, path)
    return str(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()).rstrip("/")  # noqa: SLF001


# --- files in tasks -------------------------------------------------------------


def located(uri: str) -> tuple[Any, str]:
    """(pyarrow file system, path) of a URI or a plain path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def exists(uri: str) -> bool:
    from pyarrow import fs

    system, path = located(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound


def entries(uri: str) -> list[tuple[str, int, int, bool]]:
    """(path, microseconds of the last change, length, is a folder) of what a folder holds."""
    from pyarrow import fs

    system, path = located(uri)
    root = uri.rstrip("/")
    return [(f"{root}/{i.base_name}", (i.mtime_ns or 0) // 1000, i.size or 0, i.type == fs.FileType.Directory) for i in system.get_file_info(fs.FileSelector(path))]


def read_bytes(uri: str, most: int | None = None) -> bytes:
    """The file's first ``most`` bytes, or all."""
    system, path = located(uri)
    with system.open_input_file(path) as f:
        return f.read(most) if most else f.read()


def write_bytes(uri: str, data: bytes) -> None:
    system, path = located(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as f:
        f.write(data)


def publish(uri: str, data: bytes) -> None:
    """Writes a file under a name of this attempt and renames it, so that it is there whole or not at all."""
    system, path = located(uri)
    part = f"{path}.{attempt_name()}.part"
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(part, compression=None) as f:
        f.write(data)
    system.move(part, path)


def move(source: str, target: str) -> None:
    """Renames a file, making the target's folder; replaces a target that is there."""
    system, path = located(source)
    goal = located(target)[1]
    system.create_dir(goal.rpartition("/")[0], recursive=True)
    system.move(path, goal)


def attempt_name() -> str:
    """A name that no other attempt of a task uses."""
    from pyspark import TaskContext

    c = TaskContext.get()
    return f"{c.partitionId()}-{c.taskAttemptId()}" if c else uuid.uuid4().hex


def row_offsets(df: DataFrame, order: list[Any], name: str) -> DataFrame:
    """Adds the position of each row in ``order``, from 0, without ordering all rows in one task.

    Rows are range-partitioned and sorted; each partition's count moves the
    positions of those after it.  The counts are a row per partition.  The ranges
    are stored first, so that both uses see the same ones.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = stored(spark, placed, "ordered").withColumn("_part", F.shiftright("_place", 33))
    counts = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())
    before, total = {}, 0
    for part, n in counts:
        before[part], total = total, total + n
    if not before:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("_place", "_part")
    offsets = spark.createDataFrame(list(before.items()), "_part long, _before long")  # a row per partition
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_place", "_part", "_before")
