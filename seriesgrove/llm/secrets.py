"""Operator 7: secret scan by fixed patterns and character Markov models.

Base spans come from three patterns (leftmost, not overlapping per kind).  The
method adds spans of kind ``markov``: runs of ``MIN_RUN`` or more characters of
the key alphabet whose log-likelihood ratio per transition between a
first-order Markov model of random strings and one of ordinary identifiers
exceeds ``MIN_RATIO`` and that have ``MIN_DISTINCT`` different characters, where
they overlap no base span.

Both models are transition counts, backed off to character counts, trained from
labelled samples.  ``random`` are strings made by a rule: hex, base64, letters
and digits in one or both cases, lower-case letters alone, and UUIDs.
``ordinary`` are words and the identifiers that a rule makes of them
(snake_case, camelCase, CONSTANTS, paths, numbered names, dates).  A run of
letters counts as a word, its label, if it occurs in ``WORD_TEXTS`` different
texts at least, of ``TRAIN_DOCS`` documents (least hash of doc_id) without their
base matches, and is among the ``WORDS`` of least hash; a secret that no pattern knows stands in one text and its copies
and so does not train the ordinary model.  The model is a table of alphabet x
alphabet numbers, whatever the size of the corpus; it is inlined as a constant.
``MIN_RATIO`` is set on held-out samples of both labels; recall by form and
false alarms are in the README.

Only built-in functions.  A match's position is the summed length of all pieces
(``split``) and matches before it: a running sum in code points over the few
rows that matches make.

Defined cases: a corpus with too few recurring words to know what is ordinary
(under ``MIN_TRANSITIONS`` transitions) gets base spans only; null text equals
empty text (no spans); repeated rows each give
a row; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, with_row_id

#: Fixed values of the contract; the bounds of access and hex are in the pattern, which gives the same runs.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
NO_HEX, NO_RUN = "(?<![0-9a-f])", "(?<![A-Za-z0-9+/_-])"  # a run matches from its start or not at all, so no place inside it is tried

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
MIN_RUN, MIN_RATIO, MIN_DISTINCT = 16, 0.5, 8
RUN = rf"[A-Za-z0-9+/_-]{{{MIN_RUN},}}"
TRAIN_DOCS, TRAIN_RANDOM, WORD_TEXTS, WORDS, WORD_GROUPS = 2000, 1000, 3, 4096, 64
MIN_TRANSITIONS = 1000
BACKOFF = 8.0


def _counts(samples: DataFrame) -> dict[tuple[str, str], int]:
    """Transition counts of ``s``; at most alphabet x alphabet rows reach the driver."""
    chars = samples.where(F.length("s") > 1).select(F.split("s", "").alias("c"))
    pairs = chars.select(F.explode(F.zip_with("c", F.slice("c", F.lit(2), F.size("c")), lambda a, b: F.concat(a, b))).alias("p")).where("p is not null")
    known = F.substring("p", 1, 1).isin(*ALPHABET) & F.substring("p", 2, 1).isin(*ALPHABET)
    return {(r.p[0], r.p[1]): r["count"] for r in pairs.groupBy("p").count().where(known).collect()}


def random_samples(spark: SparkSession, n: int, seed: str = "seed") -> DataFrame:
    """(form, s): strings labelled random, ``n`` of each form, by a rule."""
    x = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    rows = spark.range(n).select(x.alias("x"), F.sha2(x, 256).alias("y"))
    many = F.regexp_replace(F.base64(F.unhex(F.concat("x", "y"))), "[+/=]", "")
    lower = lambda bits: F.translate(bits, "0123456789abcdef", "qwzrtypkdhgabcde")  # noqa: E731  half of the letters
    other = lambda bits: F.translate(bits, "0123456789abcdef", "fijlmnosuvxbcaeh")  # noqa: E731  the other half
    letters = F.array_join(F.zip_with(F.split("x", ""), F.split("y", ""), lambda a, b: F.when(b < "8", lower(a)).otherwise(other(a))), "")
    forms = {
        "hex": F.substring("x", 1, 40),
        "base64": F.regexp_replace(F.base64(F.unhex("x")), "=+$", ""),
        "base62": F.substring(many, 1, 40),
        "upper": F.substring(F.upper(many), 1, 40),
        "lower_digits": F.substring(F.lower(many), 1, 40),
        "lower": F.substring(letters, 1, 40),
        "uuid": F.concat_ws("-", *[F.substring("x", i, k) for i, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
    }
    return rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("s")) for k, v in forms.items()])).alias("r")).select("r.form", "r.s")


def ordinary_samples(rows: DataFrame) -> DataFrame:
    """(form, s): words and the identifiers a rule makes of them, of ``rows`` with ``text``."""
    text = F.col("text")
    for p in (ASSIGN, ACCESS, HEX):
        text = F.regexp_replace(text, p, " ")
    plain = rows.select(F.xxhash64("text").alias("t"), F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z]{2,20}"), 0)).alias("w"))
    words = plain.dropDuplicates(["t"]).select(F.explode("w").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= WORD_TEXTS)
    words = words.orderBy(F.xxhash64("w"), "w").limit(WORDS)
    # Words meet others by rank of their hashes, in small groups.
    groups = words.withColumn("g", F.pmod(F.xxhash64("w"), F.lit(WORD_GROUPS))).groupBy("g").agg(F.array_sort(F.collect_set("w")).alias("ws"))
    each = groups.select("ws", F.posexplode("ws").alias("i", "a"))
    at = lambda k: F.get("ws", (F.col("i") * k + k) % F.size("ws"))
    each = each.select("a", at(3).alias("b"), at(7).alias("c"), F.pmod(F.xxhash64("a"), F.lit(1000)).cast("string").alias("d"))
    low = [F.lower(c) for c in "abc"]
    forms = {
        "word": F.col("a"),
        "snake": F.concat_ws("_", *low),
        "kebab": F.concat_ws("-", *low),
        "camel": F.concat(low[0], F.initcap("b"), F.initcap("c")),
        "constant": F.upper(F.concat_ws("_", "a", "b")),
        "path": F.concat(F.lit("/"), F.concat_ws("/", *low)),
        "numbered": F.concat(F.concat_ws("_", low[0], low[1]), F.lit("-"), "d"),
        "dated": F.concat(low[0], F.lit("-20"), F.substring(F.concat("d", F.lit("24")), 1, 2), F.lit("-01-"), F.lpad(F.substring("d", 1, 2), 2, "0")),
    }
    return each.select(F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("s")) for k, v in forms.items()])).alias("r")).select("r.form", "r.s")


def sampled(docs: DataFrame) -> DataFrame:
    """(text) of the training documents."""
    rows = with_row_id(docs.select("doc_id", "text"))
    picked = rows.select("_row", F.xxhash64("doc_id").alias("h")).orderBy("h", "_row").limit(TRAIN_DOCS).select("_row")
    return rows.join(F.broadcast(picked), "_row", "left_semi").select(F.coalesce("text", F.lit("")).alias("text"))  # TRAIN_DOCS rows


def train(spark: SparkSession, docs: DataFrame) -> list[float]:
    """Row-major log-likelihood ratios of transitions, random over ordinary."""
    up, down = _counts(random_samples(spark, TRAIN_RANDOM)), _counts(ordinary_samples(sampled(docs)))
    if sum(down.values()) < MIN_TRANSITIONS:
        return [-1.0] * len(ALPHABET) ** 2

    def logs(n: dict[tuple[str, str], int]) -> list[list[float]]:
        seen = {b: sum(n.get((a, b), 0) for a in ALPHABET) for b in ALPHABET}
        every = sum(seen.values()) + len(ALPHABET)
        back = {b: (seen[b] + 1) / every for b in ALPHABET}  # for transitions out of a rare character
        out = []
        for a in ALPHABET:
            total = sum(n.get((a, b), 0) for b in ALPHABET) + BACKOFF
            out.append([math.log((n.get((a, b), 0) + BACKOFF * back[b]) / total) for b in ALPHABET])
        return out

    return [round(x - y, 6) for p, q in zip(logs(up), logs(down), strict=True) for x, y in zip(p, q, strict=True)]


def ratio(s: str, model: list[float]) -> F.Column:
    """Mean log-likelihood ratio per transition of column ``s``; the string is split once, so the work is linear in its length."""
    table_ = F.from_json(F.lit(json.dumps(model)), "array<double>")
    codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    add = lambda acc, c: F.struct(
        (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(F.get(table_, acc["last"] * len(ALPHABET) + c))).alias("sum"), c.alias("last")
    )
    return F.aggregate(codes, F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last")), add, lambda acc: acc["sum"] / (F.length(s) - 1))


def _matches(pattern: str, group: int) -> F.Column:
    """All pieces of ``text`` between matches with the match that follows (null after the last): lengths in code points and the asked group."""
    whole, length = F.regexp_extract_all("text", F.lit(pattern), 0), F.char_length
    found = F.zip_with(F.split("text", pattern, -1), whole, lambda p, m: F.struct(length(p).alias("p"), length(m).alias("f"), m.alias("m")))
    if group:
        found = F.zip_with(found, F.regexp_extract_all("text", F.lit(pattern), group), lambda x, m: F.struct(x["p"].alias("p"), x["f"].alias("f"), m.alias("m")))
    return F.when(F.col("text").rlike(pattern), found)


def find(spark: SparkSession, docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """One row per document: _row, doc_id, spans (array of kind, s, e in order)."""
    model = train(spark, docs) if model is None else model
    rows = with_row_id(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    every = [_matches(p, g) for p, g in ((ASSIGN, 2), (ACCESS, 0), (NO_HEX + HEX, 0), (NO_RUN + RUN, 0))]  # one scan for all kinds
    each = rows.select("_row", F.posexplode(F.array(*every)).alias("kind", "found")).where("found is not null").select("_row", "kind", F.posexplode("found").alias("i", "x"))
    end = F.sum(F.col("x.p") + F.coalesce("x.f", F.lit(0))).over(Window.partitionBy("_row", "kind").orderBy("i"))
    each = each.withColumn("e", end).where("x.m is not null")
    each = each.select("_row", "kind", (F.col("e") - F.col("x.f")).alias("s"), "e", F.col("x.m").alias("m"))
    varied = F.size(F.array_distinct(F.split("m", ""))) >= MIN_DISTINCT  # a repeated character is not random
    random = F.when(varied, ratio("m", model) > MIN_RATIO)
    found = each.where(F.when(F.col("kind") == 0, F.char_length("m") >= 8).when(F.col("kind") == 3, random).otherwise(F.lit(True)))
    spans = stored(spark, found.select("_row", "kind", "s", "e"), "spans")
    w = Window.partitionBy("_row").orderBy("s")
    before = F.max(F.when(F.col("kind") < 3, F.col("e"))).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("kind") < 3, F.col("s"))).over(w.rangeBetween(0, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(-1)) <= F.col("s")) & (F.coalesce(after, F.col("e")) >= F.col("e"))
    spans = spans.withColumn("free", free).where("kind < 3 or free")
    by_row = spans.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("s", "kind", "e"))).alias("spans"))
    none = F.array().cast("array<struct<s:bigint,kind:int,e:bigint>>")
    ids = with_row_id(docs.select("doc_id", "text")).select("_row", "doc_id")
    return ids.join(by_row, "_row", "left").select("_row", "doc_id", F.coalesce("spans", none).alias("spans"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark, table(spark, sf_dir, "documents"))
    name = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1)
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(text(F.filter("spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 7's result that SQL can express: counts and digest of the base spans."""
    return op7_secret_scan(spark, sf_dir).drop("spans")


def _oracle() -> str:
    kinds = ((0, ASSIGN, 2, 8), (1, ACCESS, 0, 16), (2, HEX, 0, 32))
    found = "\nUNION ALL ".join(
        f"SELECT doc_id, {k} AS kind, {least} AS least, string_split_regex(text, {q}) AS p, regexp_extract_all(text, {q}, 0) AS f, regexp_extract_all(text, {q}, {g}) AS m FROM t"
        for k, pattern, g, least in kinds
        for q in ["'" + pattern.replace("'", "''") + "'"]
    )
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS ({found}),
e AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM k WHERE len(f) > 0),
s AS (SELECT doc_id, kind, least, m[i] AS m, length(f[i]) AS n,
  list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS s FROM e),
b AS (SELECT doc_id, kind, s::BIGINT AS s, (s + n)::BIGINT AS e FROM s WHERE length(m) >= least),
a AS (SELECT doc_id, count_if(kind = 0) AS a, count_if(kind = 1) AS b, count_if(kind = 2) AS c,
  string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans FROM b GROUP BY doc_id)
SELECT t.doc_id, coalesce(a.a, 0)::BIGINT AS n_assign, coalesce(a.b, 0)::BIGINT AS n_access, coalesce(a.c, 0)::BIGINT AS n_hex, sha256(coalesce(a.spans, '')) AS base_sha256
FROM t LEFT JOIN a ON a.doc_id IS NOT DISTINCT FROM t.doc_id"""


QUERIES = {"op7_secret_scan": op7_secret_scan, "secret_base_spans": secret_base_spans}
ORACLE = {"secret_base_spans": _oracle()}
