"""Fill-in-the-middle against a plain Python version."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from seriesgrove.llm import fim

WORDS = ["<P", ">", "<", "<S>", "<M>", "a", "é", " x", " ", "\n", "\t \r", "word", "\x00", "𝒳", "'", "%", "<S", "P>"]


def cut(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def wanted(doc_id, text):
    *start, output = cut(doc_id, text)
    return (doc_id, *start, sha(output), sha(text or ""))


@pytest.fixture(scope="module")
def con():
    import duckdb

    return duckdb.connect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(1 << 62), 1 << 62)), st.one_of(st.none(), st.lists(st.sampled_from(WORDS), max_size=12).map("".join))), max_size=20))
def test_sql_equals_python(con, rows):
    import pyarrow as pa

    con.register("batch", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    assert sorted(con.execute(fim.sql("batch", fim.DIGESTS)).fetchall(), key=str) == sorted((wanted(*r) for r in rows), key=str)


def test_spark(spark):
    rows = [(i, "".join(WORDS[(i * 7 + k * k) % len(WORDS)] for k in range(i % 40)), "other") for i in range(400)]
    rows += [(None, "a b c d", "x"), (None, None, "x"), (5, None, "x"), (6, "", "x"), (7, "word " * 300_000, "x"), (7, "word " * 300_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, prefix string")
    found = fim.transform(docs, texts=False, piece=1000)
    assert sorted(map(tuple, found.collect()), key=str) == sorted((wanted(*r[:2]) for r in rows), key=str)
    forms = {r["form"] for r in found.select("form").collect()}
    assert forms == {"plain", "psm", "spm"}
    whole = fim.transform(docs)
    assert sorted((r["doc_id"] or 0, r["output"]) for r in whole.collect()) == sorted((r[0] or 0, cut(*r[:2])[-1]) for r in rows)
    for r in whole.where("form <> 'plain'").collect():
        assert (len(r["prefix"]), len(r["middle"])) == (r["prefix_chars"], r["middle_chars"])
        text = r["prefix"] + r["middle"] + r["suffix"]
        assert r["output"] == (f"<S>{r['suffix']}<P>{r['prefix']}<M>{r['middle']}" if r["form"] == "spm" else f"<P>{r['prefix']}<S>{r['suffix']}<M>{r['middle']}")
        assert cut(r["doc_id"], text)[-1] == r["output"]
    assert fim.transform(docs.limit(0)).count() == 0
