"""Operator 5: token counts by a separator scan over flat token files.

Token files are flat and unindexed: little-endian ids (two or four bytes) with
an end-of-document id after each document.  The scan cuts each file into blocks
of ``block_tokens``, finds the separators of a block with one vectorised
comparison, and keeps what a block knows by itself: tokens before its first
separator, the gaps between separators, and the place of the last one.  A
prefix scan over blocks (a running count of separators and a running maximum of
the last separator's place, in two levels so that one huge file is not one
task) then numbers the documents and completes those that span blocks.

``write_shards`` makes such files from texts with a public byte-level BPE
vocabulary, whose path is a parameter; the driver reads it and sends it to the
tasks.  Files carry their task attempt's name, and only those in the committed
manifest are read, so lost executors and retries do no harm.

Defined cases: a vocabulary that holds the end-of-document id, or ids that
don't fit the width, is a ValueError; null and empty texts have 0 tokens; tokens after the last
separator of a file are a document of their own only if ``open_end`` is set;
repeated rows each give a row; empty files and tables give no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, stored, table
from .files import opened, own_file

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EOD = 50256
BLOCK_TOKENS = 1 << 20
TASK_BYTES = 128 << 20  # read by a task of the scan beyond one wave of tasks
SUPER = 256  # blocks per group in the prefix scan


def encoding(raw: bytes, pattern: str = PATTERN):  # noqa: ANN201
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_shards(spark: SparkSession, docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, width: int = 2) -> DataFrame:
    """Writes ``docs`` as token files; returns the committed manifest (file, ord, doc_id)."""
    with open(vocabulary, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())  # a vocabulary file: under 2 MB
    kind = {2: np.dtype("<u2"), 4: np.dtype("<u4")}[width]
    ids = [int(line.split()[1]) for line in raw.value.splitlines() if line]
    if EOD in ids or max(ids, default=0) >= 1 << 8 * width or EOD >= 1 << 8 * width:
        raise ValueError(f"the vocabulary holds the end-of-document id {EOD} or an id that {width} bytes can't hold")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, name, done, out = encoding(raw.value).encode_ordinary, own_file(folder, ".tok"), 0, None
        for b in batches:
            out = out or opened(name, "w")
            for text in b.column(1):
                ids = encode(text.as_py()) if text.is_valid else []
                out.write(np.array([*ids, EOD], dtype=kind).tobytes())
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]] * n, pa.string()), pa.array(np.arange(done, done + n)), b.column(0)], names=["file", "ord", "doc_id"])
            done += n
        if out:
            out.close()

    return stored(spark, docs.select("doc_id", "text").mapInArrow(run, "file string, ord long, doc_id long"), "manifest")


def scan(spark: SparkSession, files: DataFrame, width: int = 2, eod: int = EOD, block_tokens: int = BLOCK_TOKENS, open_end: bool = False) -> DataFrame:
    """(path, ord, n_tokens) for every document in ``files`` (path, length)."""
    kind, step = {2: np.dtype("<u2"), 4: np.dtype("<u4")}[width], block_tokens * width
    blocks = files.where("length > 0").withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {step}"))))
    total = files.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")).first()  # two numbers
    some = max(spark.sparkContext.defaultParallelism, (total["bytes"] or 0) // TASK_BYTES)
    tasks = max(1, min(some, total["files"] + (total["bytes"] or 0) // step))
    blocks = blocks.repartition(tasks, "path", "blk")  # a number that is asked for isn't coalesced

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, blk in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with opened(path, "r") as f:
                    ids = np.frombuffer(f.read_at(step, blk * step), dtype=kind)
                at = np.flatnonzero(ids == eod)
                begin, n = blk * block_tokens, len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([blk]), pa.array([n]), pa.array([begin + int(at[0]) if n else None], pa.int64()),
                     pa.array([begin + int(at[-1]) if n else None], pa.int64()), pa.array([begin + len(ids)]), pa.array([(np.diff(at) - 1).tolist()], pa.list_(pa.int64()))],
                    names=["path", "blk", "n", "head", "tail", "end", "gaps"],
                )

    found = blocks.select("path", "blk").mapInArrow(run, "path string, blk long, n long, head long, tail long, end long, gaps array<long>")
    found = stored(spark, found.withColumn("sup", F.expr(f"blk div {SUPER}")), "separators")
    before = lambda *part: Window.partitionBy(*part).orderBy("blk" if len(part) > 1 else "sup").rowsBetween(Window.unboundedPreceding, -1)
    totals = found.groupBy("path", "sup").agg(F.sum("n").alias("n"), F.max("tail").alias("tail"))
    totals = totals.select("path", "sup", F.sum("n").over(before("path")).alias("n0"), F.max("tail").over(before("path")).alias("t0"))
    local = found.withColumns({"n1": F.sum("n").over(before("path", "sup")), "t1": F.max("tail").over(before("path", "sup"))}).join(totals, ["path", "sup"])
    zero = F.lit(0)
    ready = local.where("n > 0").select(
        "path",
        (F.coalesce("n0", zero) + F.coalesce("n1", zero)).alias("ord0"),
        F.concat(F.array(F.col("head") - F.coalesce("t1", "t0", F.lit(-1)) - 1), "gaps").alias("gaps"),
    )
    out = ready.select("path", "ord0", F.posexplode("gaps").alias("i", "n_tokens")).select("path", (F.col("ord0") + F.col("i")).alias("ord"), "n_tokens")
    if open_end:
        ends = found.groupBy("path").agg(F.sum("n").alias("ord"), (F.max("end") - F.coalesce(F.max("tail"), F.lit(-1)) - 1).alias("n_tokens"))
        out = out.unionByName(ends.where("n_tokens > 0"))
    return out


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    manifest = write_shards(spark, table(spark, sf_dir, "documents"), folder)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    named = files.withColumn("file", F.element_at(F.split("path", "/"), -1))
    committed = manifest.select("file").distinct()
    found = scan(spark, named.join(committed, "file", "left_semi"))
    found = found.withColumn("file", F.element_at(F.split("path", "/"), -1))
    # a row per document on either side, however well its file compresses: never broadcast
    return manifest.join(found.hint("merge"), ["file", "ord"]).select("doc_id", "n_tokens")


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLE: dict[str, str] = {}
