"""Operator 12: fill-in-the-middle transformation by DuckDB inside ``mapInArrow``.

A task registers each Arrow batch (pieces of ``PIECE`` bytes of text, or one
longer document) with an in-memory DuckDB connection of its own and gets Arrow
back from one SQL text; no row passes through Python.  A text is cut into n
units, a word with the white space before it or the white space at the end.
SHA-256 of ``seed:doc_id`` gives four numbers: two cut points in 0 to n, whether
the document is transformed, and which order it takes.

* plain: the text.
* psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle.
* spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.

A text that is empty or holds one of the marks stays plain, so the first mark
found in an output is always the one that was put there and ``restored``, which
is read from output and form alone, is the exact text.

There is no shuffle and no state: a lost executor's tasks run again with the
same result.  A document's choices depend on its doc_id alone.

Defined cases: a null text counts as empty (plain, n = 0); a null doc_id is
hashed as an empty one; repeated rows each give a row and make equal choices; an
empty table gives an empty result; texts of any length are taken whole; other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import table

SEED, RATE, SPM_RATE = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Bytes of text that a task hands to DuckDB at once, and what DuckDB may hold.
PIECE, MEMORY = 4 << 20, "600MB"

DIGESTS = {"output_sha256": "sha256(output)", "restored_sha256": "sha256(restored)"}
TEXTS = {"prefix": "prefix", "middle": "middle", "suffix": "suffix", "output": "output"}
FIXED = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def sql(source: str, more: dict[str, str], seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> str:
    """The transformation of ``source`` (doc_id, text) with the columns ``more`` besides the fixed ones."""
    part = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::UBIGINT"
    joined = lambda a, b: f"array_to_string(list_slice(u, {a}, {b}), '')"
    marked = " OR ".join(f"contains(text, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    at = lambda m: f"strpos(output, '{m}')"
    p, s, m = len(PREFIX), len(SUFFIX), len(MIDDLE)
    columns = "".join(f", {x} AS {name}" for name, x in more.items())
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM {source}),
u AS (SELECT doc_id, text, regexp_extract_all(text, '{UNIT}') AS u, {part(0)} AS h1, {part(1)} AS h2, {part(2)} AS h3, {part(3)} AS h4 FROM t),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS b,
  CASE WHEN text = '' OR {marked} OR h3 % 100 >= {rate} THEN 'plain' WHEN h4 % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT doc_id, text, n, form, CASE WHEN form <> 'plain' THEN {joined(1, "a")} END AS prefix, CASE WHEN form <> 'plain' THEN {joined("a + 1", "b")} END AS middle,
  CASE WHEN form <> 'plain' THEN {joined("b + 1", "n")} END AS suffix FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
  ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output FROM s),
r AS (SELECT *, CASE form WHEN 'plain' THEN output
  WHEN 'psm' THEN substr(output, {p + 1}, {at(SUFFIX)} - {p + 1}) || substr(output, {at(MIDDLE)} + {m}) || substr(output, {at(SUFFIX)} + {s}, {at(MIDDLE)} - {at(SUFFIX)} - {s})
  ELSE substr(output, {at(PREFIX)} + {p}, {at(MIDDLE)} - {at(PREFIX)} - {p}) || substr(output, {at(MIDDLE)} + {m}) || substr(output, {s + 1}, {at(PREFIX)} - {s + 1}) END AS restored FROM o)
SELECT doc_id, n::BIGINT AS n, form, length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars{columns} FROM r"""


def pieces(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``most`` bytes in a column each; a longer row stands alone."""
    upto, i = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while i < batch.num_rows:
        j = max(int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, side="right")), i + 1)
        yield batch.slice(i, j - i)
        i = j


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, texts: bool = True, piece: int = PIECE) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars of every document, with the parts and the output as texts or with digests of output and restored text."""
    more = TEXTS if texts else DIGESTS
    text = sql("batch", more, seed, rate, spm_rate)
    schema = pa.schema([(n, pa.int64()) if k == "long" else (n, pa.string()) for n, k in (x.split() for x in FIXED.split(", "))] + [(n, pa.string()) for n in more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        for b in batches:
            for part in pieces(b, 1, piece):
                con.register("batch", pa.Table.from_batches([part]))
                found = con.sql(text).to_arrow_table().cast(schema)
                con.unregister("batch")
                yield from found.to_batches()
        con.close()

    return docs.select("doc_id", "text").mapInArrow(run, f"{FIXED}, " + ", ".join(f"{n} string" for n in more))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform(table(spark, sf_dir, "documents"), texts=False)


QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
ORACLE = {"op12_fill_in_middle": sql("documents", DIGESTS)}
