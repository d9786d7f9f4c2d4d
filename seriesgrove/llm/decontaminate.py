"""Operator 6: benchmark decontamination by MinHash containment search.

Words are lower-cased runs of letters and digits; shingles are five words (a
shorter text is one shingle).  A document is contaminated by an item if it
holds at least ``share`` of the item's distinct shingles.

Containment is searched from the short side, so a document's length does not
dilute it: items are partitioned by size (powers of two of their shingle
count), and each partition keeps the least k shingle hashes of its items, with
k one more than the number of shingles that an item of that size may miss.  A
contaminated document therefore holds at least one of the k (no recall is
lost).  Documents' shingle hashes are probed against these signatures; the
candidate pairs are then verified by exact containment of the shingles' words.

Only built-in functions.  Signatures, candidates and items are stored, and
broadcast up to a size in bytes (``common.BROADCAST_BYTES``); beyond it they are
shuffled, the signatures in ``SALTS`` copies, so that a shingle common to all
documents is spread over as many tasks.  A document is probed once with each of
its distinct shingles.

Defined cases: null and empty texts have no shingles, so such items match
nothing and such documents are clean; a repeated doc_id gives one row per item
with the largest containment; repeated items count by item_id; empty tables
give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fits, small, stored, table, with_row_id

WORDS, SHARE = 5, 0.8
SALTS = 16


def words(text: str) -> F.Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(rows: DataFrame, n: int) -> DataFrame:
    """Adds ``h``, a row per shingle, to rows with ``words``; a shorter text is one shingle."""
    rows = rows.withColumn("wh", F.transform("words", lambda w: F.xxhash64(w))).drop("words").where(F.size("wh") > 0)
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.size("wh") - n, F.lit(0)))))
    whole = F.xxhash64(*[F.get("wh", F.col("i") + k) for k in range(n)])  # absent words are skipped
    return rows.withColumn("h", whole).drop("wh", "i")


def shingles(n: int) -> F.Column:
    """Distinct shingles as strings, of ``words``."""
    at = F.sequence(F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(1)))
    return F.when(F.size("words") > 0, F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice("words", i, n), " ")))).otherwise(F.array().cast("array<string>"))


def signatures(items: DataFrame, n: int, share: float) -> DataFrame:
    """(item_id, h): the least k hashes of each item, k by its size partition."""
    h = shingle_hashes(items.select("item_id", words("text").alias("words")), n)
    sets = h.groupBy("item_id").agg(F.array_sort(F.collect_set("h")).alias("s"))
    top = F.expr("cast(shiftleft(1L, cast(ceil(log2(size(s))) as int)) as double)")  # largest size of the partition
    miss = F.floor(top * (1 - share) + 1e-9).cast("int")
    return sets.select("item_id", F.explode(F.slice("s", F.lit(1), miss + 1)).alias("h"))



def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, n: int = WORDS, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment), one row per contaminated pair."""
    return pairs(spark, docs, items, n, share).groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"), F.max("containment").alias("containment"))


def pairs(spark: SparkSession, docs: DataFrame, items: DataFrame, n: int, share: float) -> DataFrame:
    sig = stored(spark, signatures(items, n, share), "signatures")
    rows = with_row_id(docs.select("doc_id", "text"))
    probed = shingle_hashes(rows.select("_row", words("text").alias("words")), n)
    if fits(sig):
        hits = probed.join(F.broadcast(sig), "h")
    else:
        salted = sig.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = probed.withColumn("salt", (F.pmod(F.xxhash64("_row"), F.lit(SALTS))).cast("int")).join(salted, ["h", "salt"])
    found = stored(spark, hits.select("_row", "item_id").distinct(), "candidates")
    held = stored(spark, found.select("_row").distinct(), "candidate-rows")
    texts = rows.join(small(held), "_row").withColumn("words", words("text")).select("_row", "doc_id", shingles(n).alias("have"))
    wanted = items.withColumn("words", words("text")).select("item_id", F.explode(shingles(n)).alias("s"))
    wanted = wanted.groupBy("item_id").agg(F.collect_set("s").alias("want"))
    both = texts.join(small(found), "_row").join(small(stored(spark, wanted, "items")), "item_id")
    both = both.withColumn("n_shared", F.size(F.array_intersect("want", "have")).cast("long")).withColumn("n_item", F.size("want").cast("long"))
    both = both.withColumn("containment", F.col("n_shared") / F.col("n_item"))
    return both.where(F.col("n_shared") >= F.lit(share) * F.col("n_item") - 1e-9).select("_row", "doc_id", "item_id", "n_shared", "n_item", "containment")


def keep(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows; ``docs`` must be a file scan."""
    out = stored(spark, pairs(spark, docs, items, WORDS, SHARE).select("_row").distinct(), "contaminated")
    return with_row_id(docs).join(out, "_row", "left_anti").drop("_row")


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_benchmark_leaks": op6_benchmark_leaks}
ORACLE = {
    "op6_benchmark_leaks": r"""
WITH w AS (SELECT doc_id AS id, 0 AS kind, row_number() OVER () AS r, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT item_id, 1, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark),
s AS (SELECT DISTINCT id, kind, r, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT id, kind, r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
i AS (SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS n_item FROM (SELECT DISTINCT id, s FROM s WHERE kind = 1)),
p AS (SELECT d.id AS doc_id, d.r, i.item_id, count(*) AS n_shared, any_value(i.n_item) AS n_item FROM s d JOIN i ON d.s = i.s WHERE d.kind = 0 GROUP BY ALL)
SELECT doc_id, item_id, max(n_shared) AS n_shared, max(n_item) AS n_item, max(n_shared::DOUBLE / n_item) AS containment
FROM p WHERE n_shared >= 0.8::DOUBLE * n_item - 1e-9::DOUBLE GROUP BY ALL"""
}
