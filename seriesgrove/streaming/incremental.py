"""Incremental crawl: new files become index rows through a streaming file source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.strings import case_insensitive_glob
from ..operators import crawl
from ..sources.dicom import parse_rows


def stream_instances(spark: SparkSession, directory: str) -> DataFrame:
    """Instance rows of files as they arrive, from their heads; each file is read once (the checkpoint remembers it)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", f"*.{case_insensitive_glob('dcm')}").option("recursiveFileLookup", "true")
    return parse_rows(files.load(directory).drop("content"))


def start(spark: SparkSession, directory: str, instances: str, checkpoint: str) -> StreamingQuery:
    """Appends new instance rows to a Parquet table; exactly once, by batch folders that a repeated batch overwrites."""

    def save(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{instances}/batch={n}")

    return stream_instances(spark, directory).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index(spark: SparkSession, instances: str) -> DataFrame:
    return crawl.build_index(spark.read.parquet(instances).where("error is null").drop("batch"))
