"""Operator 8: language identification with hyperdimensional profiles.

Every letter has a random vector of -1 and 1 (drawn from its code point); an
n-gram binds the permuted (rolled) vectors of its letters by multiplication; a
text bundles (adds) its n-grams' vectors, and a language prototype bundles the
texts of that language.  A document gets the language with the greatest cosine
between its vector and the prototype.

Texts are lower-cased whole; runs of other characters count as one space, also
at both ends.  Bundling is linear, so a training task adds up n-gram counts and
sends one vector per language.  Prototypes stand in a stored table, sorted by
language and cut into blocks of ``LANG_BLOCK`` languages; a block (``LANG_BLOCK``
x ``DIM`` numbers at most, 16 MB) goes to the prediction tasks.  With one block, the usual
case, that is one pass; with more, each block gives every document its best
language there, and the best of the blocks wins, so any number of languages
works in the same memory.  Prediction needs only the products of n-grams with
prototypes, which a task keeps; the length of a document's vector is taken as
its expected value, ``sqrt(DIM)`` times the length of its counts.

Unrelated n-grams give a cosine with a standard deviation of 1 / sqrt(DIM),
0.011, whatever the length of the text.  ``keep`` asks for ``MIN_SCORE``, 4.5
times that, of short texts and for ``LONG`` times as much of long ones, where
texts of a learned language score far higher than at a few words.

Defined cases: null text or text without a letter gives ``und`` and score 0,
as does a corpus with no labelled text; ties go to the language that sorts
first; a null doc_id hashes as the empty string; repeated rows each give a row;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, with_row_id

DIM, GRAM, SEED = 8192, 3, 7
LANG_BLOCK = 512
LAST_LETTER = 0x33479  # end of the last block of letters in Unicode 17; what lies beyond is none
LETTERS = 1 << 12  # letter vectors kept by a task
CHUNK = 512  # n-gram vectors built at once
CACHE = 1 << 22  # products kept by a task
#: The least score of texts up to FEW different n-grams; from LONG * FEW on it is LONG times as much.
MIN_SCORE, FEW, LONG = 0.05, 32, 3


class Encoder:
    """Counts n-grams of texts and turns counts into vectors."""

    def __init__(self) -> None:
        self.letter = np.array([chr(i).isalpha() for i in range(LAST_LETTER + 2)])
        self.vectors: dict[int, np.ndarray] = {}

    def count(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Packed n-grams and their counts; None without a letter."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = self.letter[np.minimum(points, len(self.letter) - 1)]
        if not is_letter.any():
            return None
        points = np.where(is_letter, points, 32).astype(np.int64)
        points = points[is_letter | np.append(True, is_letter[:-1])]
        points = np.concatenate([[32] if points[0] != 32 else [], points, [32] if points[-1] != 32 else []]).astype(np.int64)
        code = points[: len(points) - GRAM + 1]
        for k in range(1, GRAM):
            code = (code << 21) | points[k : len(points) - GRAM + 1 + k]
        return np.unique(code, return_counts=True)

    def bind(self, codes: np.ndarray) -> np.ndarray:
        """One vector for each of at most ``CHUNK`` n-grams."""
        if len(self.vectors) > LETTERS:
            self.vectors = {}
        out = np.ones((len(codes), DIM), dtype=np.int8)
        for k in range(GRAM):
            points, at = np.unique((codes >> (21 * k)) & ((1 << 21) - 1), return_inverse=True)
            for p in points.tolist():
                if p not in self.vectors:
                    self.vectors[p] = (np.random.default_rng([SEED, p]).integers(0, 2, DIM) * 2 - 1).astype(np.int8)
            out *= np.roll(np.stack([self.vectors[p] for p in points.tolist()]), k, axis=1)[at]
        return out

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(DIM)
        for i in range(0, len(codes), CHUNK):
            out += counts[i : i + CHUNK].astype(np.float32) @ self.bind(codes[i : i + CHUNK]).astype(np.float32)
        return out


class Products:
    """Cosines of n-gram vectors with the prototypes; keeps those it has seen, up to ``CACHE`` numbers."""

    def __init__(self, matrix: np.ndarray):
        self.encoder, self.matrix = Encoder(), matrix.T.astype(np.float32) / np.float32(DIM**0.5)
        self.most = max(CACHE // max(len(matrix), 1), 1)
        self.codes, self.near = np.zeros(0, np.int64), np.zeros((0, len(matrix)), np.float32)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """A row for each of ``codes``, which are distinct and sorted."""
        if len(self.codes) + len(codes) > self.most:
            self.codes, self.near = self.codes[:0], self.near[:0]
        new = np.setdiff1d(codes, self.codes, assume_unique=True)
        if len(new):
            parts = [self.encoder.bind(new[i : i + CHUNK]).astype(np.float32) @ self.matrix for i in range(0, len(new), CHUNK)]
            every = np.concatenate([self.codes, new])
            order = np.argsort(every)
            self.codes, self.near = every[order], np.concatenate([self.near, *parts])[order]
        return self.near[np.searchsorted(self.codes, codes)]

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Texts x languages."""
        codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        near, out = self.of(codes), np.zeros((len(found), self.near.shape[1]))
        start = 0
        for i, (c, n) in enumerate(found):
            n = n.astype(np.float64)
            out[i] = n @ near[at[start : start + len(c)]] / np.linalg.norm(n)
            start += len(c)
        return out


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame) -> DataFrame:
    """(lang, v): prototypes from documents that are not held out and have a label; stored."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums, seen = Encoder(), {}, {}

        def settle() -> None:
            for lang, n in seen.items():
                codes, counts = np.fromiter(n, np.int64, len(n)), np.fromiter(n.values(), np.float64, len(n))
                sums[lang] = sums.get(lang, 0) + encoder.bundle(codes, counts)
            seen.clear()

        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                if (found := encoder.count(text.as_py())) is not None:
                    n = seen.setdefault(lang.as_py(), Counter())
                    for c, k in zip(found[0].tolist(), found[1].tolist(), strict=True):
                        n[c] += k
            if sum(map(len, seen.values())) > 1 << 18:
                settle()
        settle()
        langs = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([sums[x].tolist() for x in langs], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = rows.mapInArrow(run, "lang string, v array<double>")
    each = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    whole = each.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return stored(docs.sparkSession, whole, "prototypes")


def blocks(prototypes: DataFrame, size: int = LANG_BLOCK) -> Iterator[dict[str, np.ndarray]]:
    """The prototypes, scaled to unit length, in order of language, at most ``size`` at a time; none at all is one empty block."""
    last, first = None, True
    while True:
        rows = prototypes if last is None else prototypes.where(F.col("lang") > last)
        got = {r.lang: np.array(r.v) / max(np.linalg.norm(r.v), 1e-12) for r in rows.orderBy("lang").limit(size).collect()}
        if got or first:
            yield got
        if len(got) < size:
            return
        last, first = max(got), False


def predict(docs: DataFrame, prototypes: DataFrame | dict[str, np.ndarray], size: int = LANG_BLOCK) -> DataFrame:
    """``docs`` (a file scan) with lang_pred, score and n_grams (different n-grams) added."""
    every = iter([prototypes] if isinstance(prototypes, dict) else blocks(prototypes, size))
    one, two = next(every), next(every, None)
    if two is None:
        return predict_block(docs, one)
    spark, parts = docs.sparkSession, []
    rows = with_row_id(docs.select("doc_id", "text")).select("_row", "text")
    for block in (b for part in ([one, two], every) for b in part):
        parts.append(stored(spark, predict_block(rows, block).drop("text"), "best-of-block"))
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    # The least of these has the highest score; a tie goes to the language that sorts first.
    rank = F.struct((F.col("lang_pred") == "und").alias("a"), (-F.col("score")).alias("b"), F.col("lang_pred").alias("c"))
    best = scored.groupBy("_row").agg(F.min(rank).alias("m"), F.max("score").alias("score"), F.max("n_grams").alias("n_grams"))
    best = best.select("_row", F.col("m.c").alias("lang_pred"), "score", "n_grams")
    return with_row_id(docs).join(best.hint("shuffle_hash"), "_row").drop("_row")


def predict_block(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """``predict`` with the prototypes of one block."""
    langs = sorted(prototypes)
    matrix = np.array([prototypes[x] for x in langs]).reshape(len(langs), DIM)
    schema = docs.schema
    at = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, products = Encoder(), Products(matrix)
        for b in batches:
            pred, score, size = ["und"] * len(b), np.zeros(len(b)), np.zeros(len(b), np.int64)
            ids, found, held = [], [], 0

            def settle() -> None:
                near = products.scores(found)
                for i, row in zip(ids, near, strict=True):  # noqa: B023
                    k = int(np.argmax(row))
                    pred[i], score[i] = langs[k], min(max(row[k], 0.0), 1.0)  # noqa: B023
                ids.clear()  # noqa: B023
                found.clear()  # noqa: B023

            for i, text in enumerate(b.column(at)):
                grams = encoder.count(text.as_py()) if text.is_valid and langs else None
                if grams is not None:
                    ids.append(i)
                    found.append(grams)
                    size[i] = len(grams[0])
                    held += len(grams[0])
                if found and held > min(1 << 18, products.most):
                    settle()
                    held = 0
            if found:
                settle()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(size)], names=[*b.schema.names, "lang_pred", "score", "n_grams"])

    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "lang_pred string, score double, n_grams long"])
    return docs.mapInArrow(run, out)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learns from the same table."""
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, train(docs)).drop("text", "n_grams")


def keep(docs: DataFrame) -> DataFrame:
    """``docs`` without those that have no letter or resemble no learned language (a score under ``MIN_SCORE``, or up to ``LONG`` times that for long texts)."""
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    least = F.lit(MIN_SCORE) * F.least(F.greatest(F.col("n_grams") / FEW, F.lit(1.0)), F.lit(float(LONG)))
    return predict(rows, train(docs)).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).drop("lang_pred", "score", "n_grams")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op8_language_id": op8_language_id}
ORACLE: dict[str, str] = {}
