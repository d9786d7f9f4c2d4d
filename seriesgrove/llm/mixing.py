"""Operator 3: mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and
share the total size; none gets more than ``repeats`` times its own size, the
excess going to the others by weight (water filling, solved in closed form
over the sources' aggregate rows).

Schedule: each source's documents, in the order of a hash of doc_id, form one
stream, cut into blocks of ``block`` words.  A source needs one slot per block
until its target is met; slot numbers 0..M-1 are dealt to sources through the
cumulative slot counts, and a slot's time is the van der Corput point (bit
reversal) of its number, which spreads every source evenly over time.  Slots
are ranked per source by time; rank r reads block r mod blocks, in epoch
r div blocks, and the join with the blocks' pieces gives the words taken.  The
last slot of a source is cut to the words still missing.  ``sequence`` gives the
mix in the order of slots, ``mix`` the slot at which each document begins.

Sources are rows of one task, which sorts them a few times and spills what
exceeds its memory: meant for names of collections, up to some ten million.

Ranks and stream positions are prefix sums over two levels (inside hash
buckets, then over bucket totals), each level about the square root of the
rows, so a source with a third of all rows is never ordered in one task.

Defined cases: null text has size 0; null source is a source of its own, last;
a null doc_id hashes as the empty string; documents of size 0 take 0 words;
repeated rows count separately; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WS, stored, table, with_row_id

BLOCK, REPEATS = 1024, 3
CHUNK = 1024


def prefix(rows: DataFrame, part: str, bucket: str, order: list[F.Column], value: F.Column, name: str) -> DataFrame:
    """Adds the exclusive running sum of ``value`` by ``part`` in (bucket, order); two levels."""
    inner = Window.partitionBy(part, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(part, bucket).agg(F.sum(value).alias("_t"))
    totals = totals.select(part, bucket, F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_before"))
    local = rows.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return local.join(totals.hint("merge"), [part, bucket]).withColumn(name, F.col("_before") + F.col("_in")).drop("_before", "_in")


def targets(sizes: DataFrame, block: int, repeats: int) -> DataFrame:
    """Per source: no, source, source_size, target, goal (whole words), blocks, slots, first slot, bits of the slot numbers."""
    every = Window.partitionBy()
    named = Window.orderBy(F.col("source").asc_nulls_last())
    up = Window.orderBy("full_at", "no")
    s = sizes.withColumn("no", F.row_number().over(named) - 1)
    s = s.withColumn("weight", (F.col("no") % 3 + 1).cast("long")).withColumn("total", F.sum("source_size").over(every))
    s = s.withColumn("full_at", F.col("source_size") * float(repeats) / F.col("weight"))
    s = s.withColumn("rest", F.col("total") - F.coalesce(F.sum(F.col("source_size") * repeats).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("rest_weight", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("open", F.when(F.col("full_at") > F.col("rest") / F.col("rest_weight"), F.struct("full_at", "no", "rest", "rest_weight")))
    s = s.withColumn("open", F.min("open").over(every))
    share = (F.col("open.rest") * F.col("weight")).cast("double") / F.col("open.rest_weight")
    s = s.withColumn("target", F.coalesce(F.least(share, F.col("source_size") * float(repeats)), F.col("source_size") * float(repeats)))
    s = s.withColumn("goal", F.floor("target").cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    epochs, rest = F.expr("goal div source_size"), F.col("goal") % F.col("source_size")
    s = s.withColumn("slots", F.when(F.col("source_size") > 0, epochs * F.col("blocks") + F.ceil(rest / block)).otherwise(0).cast("long"))
    s = s.withColumn("first", F.coalesce(F.sum("slots").over(Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("bits", F.length(F.bin(F.greatest(F.sum("slots").over(every) - 1, F.lit(1)))))
    return s.select("no", "source", "source_size", "target", "goal", "blocks", "slots", "first", "bits")


def schedule(sources: DataFrame) -> DataFrame:
    """One row per slot: no, time, rank, epoch, blk, and goal, source_size of its source."""
    parts = sources.where("slots > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {CHUNK}"))))
    parts = parts.repartition(F.col("no"), F.col("chunk"))
    low = F.col("first") + F.col("chunk") * CHUNK
    slots = parts.withColumn("i", F.explode(F.sequence(low, F.least(low + CHUNK, F.col("first") + F.col("slots")) - 1)))
    slots = slots.withColumn("time", F.expr("cast(conv(reverse(lpad(bin(i), bits, '0')), 2, 10) as long)"))
    slots = slots.withColumn("part", F.expr("shiftright(time, cast(bits div 2 as int))"))
    slots = prefix(slots, "no", "part", [F.col("time")], F.lit(1), "rank")
    return slots.select("no", "time", "rank", F.expr("rank div blocks").alias("epoch"), (F.col("rank") % F.col("blocks")).alias("blk"), "goal", "source_size")


def mix(spark: SparkSession, docs: DataFrame, block: int = BLOCK, repeats: int = REPEATS) -> DataFrame:
    """One row per document: _row, doc_id, source, size, source_size, target, taken, first_slot (place in the mix of the first words taken, null if none)."""
    rows, used = planned(spark, docs, block, repeats)
    taken = used.groupBy("_row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    rows = rows.join(taken.hint("merge"), "_row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return rows.select("_row", "doc_id", "source", "size", "source_size", "target", "taken", "first_slot")


def sequence(spark: SparkSession, docs: DataFrame, block: int = BLOCK, repeats: int = REPEATS) -> DataFrame:
    """The mix itself: slot, at (place in the slot's block), doc_id, source, start (first word, from 0), words; read in order of slot and at."""
    rows, used = planned(spark, docs, block, repeats)
    return used.join(rows.select("_row", "doc_id", "source", F.col("at").alias("_at")), "_row").select(
        "slot", (F.col("low") % block).alias("at"), "doc_id", "source", (F.col("low") - F.col("_at")).alias("start"), "words"
    )


def planned(spark: SparkSession, docs: DataFrame, block: int, repeats: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source's stream, and the pieces of them that slots take (_row, slot, low, words)."""
    size = F.coalesce(F.regexp_count("text", F.lit(f"[^{WS}]+")), F.lit(0)).cast("long")
    base = with_row_id(docs.select("doc_id", "source", "text")).select("_row", "doc_id", "source", size.alias("size"))
    base = stored(spark, base.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "sizes")
    sources = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), block, repeats)
    sources = stored(spark, sources.coalesce(1), "sources")  # a row per source
    named = base.join(sources.select("no", F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    digits = max(1, round(math.log(max(base.count(), 1), 16) / 2))
    rows = named.withColumn("bucket", F.substring("h", 1, digits))
    rows = prefix(rows, "no", "bucket", [F.col("h"), F.col("doc_id"), F.col("size"), F.col("_row")], F.col("size"), "at")
    rows = stored(spark, rows.select("_row", "doc_id", "source", "no", "size", "source_size", "target", "at"), "streams")
    pieces = rows.where("size > 0").withColumn("blk", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))))
    pieces = pieces.select(
        "_row", "no", "blk", F.greatest("at", F.col("blk") * block).alias("low"), F.least(F.col("at") + F.col("size"), (F.col("blk") + 1) * block).alias("high")
    )
    last = F.expr("goal - epoch * source_size")  # in stream positions of that epoch
    words = F.least("high", last) - F.col("low")
    used = pieces.join(schedule(sources).hint("merge"), ["no", "blk"]).select("_row", F.col("time").alias("slot"), "low", words.alias("words"))
    return rows, used.where("words > 0")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


QUERIES = {"op3_mix_sources": op3_mix_sources}

#: The same words by interval arithmetic: whole epochs, then the overlap with the last one.
MIX_SQL = r"""
d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM {docs}),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS no FROM d GROUP BY source),
s1 AS (SELECT *, no % 3 + 1 AS weight, (sum(source_size) OVER ())::BIGINT AS total, source_size * 3.0::DOUBLE / (no % 3 + 1) AS full_at FROM s0),
s2 AS (SELECT *,
   total - coalesce(sum(source_size * 3) OVER (ORDER BY full_at, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
   (sum(weight) OVER (ORDER BY full_at, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest_weight FROM s1),
o AS (SELECT rest, rest_weight FROM s2 WHERE full_at > rest::DOUBLE / rest_weight ORDER BY full_at, no LIMIT 1),
s AS (SELECT source, source_size, CASE WHEN o.rest IS NULL THEN source_size * 3.0::DOUBLE
   ELSE least((o.rest * weight)::DOUBLE / o.rest_weight, source_size * 3.0::DOUBLE) END AS target FROM s2 LEFT JOIN o ON true),
p AS (SELECT d.doc_id, d.source, d.size, s.source_size, s.target, floor(s.target)::BIGINT AS goal,
   coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low
   FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
mixed AS (SELECT doc_id, source, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE
   (goal // source_size) * size + greatest(least(low + size, goal % source_size) - low, 0) END::BIGINT AS taken FROM p)"""
#: The schedule, slot by slot.
SLOT_SQL = r"""
b AS (SELECT p.*, dense_rank() OVER (ORDER BY source ASC NULLS LAST) - 1 AS no FROM p),
n0 AS (SELECT no, any_value(source_size) AS source_size, any_value(goal) AS goal, (any_value(source_size) + 1023) // 1024 AS blocks FROM b GROUP BY no),
n1 AS (SELECT *, CASE WHEN source_size > 0 THEN (goal // source_size) * blocks + (goal % source_size + 1023) // 1024 ELSE 0 END AS slots FROM n0),
n AS (SELECT *, coalesce(sum(slots) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first,
   length(bin(greatest((sum(slots) OVER ())::BIGINT - 1, 1))) AS bits FROM n1),
t AS (SELECT no, blocks, goal, source_size, list_sum(list_transform(range(bits), lambda k: ((i >> k) & 1) << (bits - 1 - k)))::BIGINT AS time
   FROM (SELECT *, unnest(range(first, first + slots::BIGINT)) AS i FROM n)),
u AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY time) - 1 AS rank FROM t),
x AS (SELECT *, unnest(range(low // 1024, (low + size - 1) // 1024 + 1)) AS blk FROM b WHERE size > 0),
first_taken AS (SELECT x.doc_id, x.no, x.low, x.size, min(u.time) AS first_slot FROM x JOIN u ON u.no = x.no AND u.rank % u.blocks = x.blk
   WHERE least(x.low + x.size, (x.blk + 1) * 1024, u.goal - (u.rank // u.blocks) * u.source_size) > greatest(x.low, x.blk * 1024) GROUP BY ALL)"""
ORACLE = {
    "op3_mix_sources": "WITH "
    + MIX_SQL.replace("{docs}", "documents").replace("SELECT doc_id, source, size, source_size, target, CASE", "SELECT doc_id, source, size, low, source_size, target, CASE")
    + ","
    + SLOT_SQL
    + "\nSELECT m.doc_id, m.size, m.source_size, m.target, m.taken, f.first_slot FROM mixed m"
    + "\nLEFT JOIN first_taken f ON m.doc_id IS NOT DISTINCT FROM f.doc_id AND m.low = f.low AND m.size = f.size"
    + "\n  AND f.no = (SELECT any_value(b.no) FROM b WHERE b.source IS NOT DISTINCT FROM m.source)"
}
