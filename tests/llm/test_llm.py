"""The first ten operators and the pipeline on small tables with odd cases, against brute force."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from seriesgrove.llm import decontaminate, exact_dedup, html_text, langid, licenses, mixing, registry, secrets, simhash, token_counts, warc
from seriesgrove.llm.common import components, new_folder

WORDS = "the of and to in that was his with for you are be this have from one had by word but not what all were".split()
FR = "le la les des une que pour dans qui sur avec pas plus par être cette été".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, digest string, _row long, fp string"


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ing", str(rng.randrange(50))]) for _ in range(n))


def documents():
    rng, out = random.Random(3), []
    for i in range(60):
        out.append((i, prose(rng, rng.randrange(1, 200), FR if i % 3 == 0 else WORDS), "fr" if i % 3 == 0 else "en", f"s{i % 4}"))
    long_ = prose(rng, 20_000)
    out += [(100, long_, "en", "s0"), (101, long_.replace("the", "THE", 1), "en", "s1"), (102, long_ + " end", "en", None)]
    out += [(110, None, "en", "s2"), (111, "", None, "s2"), (112, " \t\n", "en", "s2"), (113, "12 34 !?", "en", "s3"), (114, "é", "fr", None)]
    out += [(200 + i, "same  text here\n" if i % 2 else "same text here", "en", "s0") for i in range(40)]
    out += [(300, "repeated row", "en", "s1")] * 3
    out += [(None, "no id", "en", "s1"), (None, "same text here", None, None)]
    out += [(400, "x" * 5000, "en", "s2"), (401, "password = \"abcdEFGH1234\" token:short AKIA" + "Z9" * 8 + " " + "0123456789abcdef" * 2, "en", "s2")]
    out += [(402, "password: token: abcdefgh1 é api_key='AAAAbbbb.cc' key q7Zt0Kd92LmXv4RbYp81 done", "en", "s2")]
    return [(i, t, lang, s, None, "clash", "clash", 7, "clash") for i, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark):
    path = new_folder(spark, "test-docs")
    spark.createDataFrame(documents(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    path = new_folder(spark, "test-none")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def key(v):
    return tuple((x is None, str(x)) for x in v)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)


def test_names():
    names = list(registry.queries())
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names)


# --- exact dedup -----------------------------------------------------------------


def exact(docs):
    groups = {}
    for n, (i, t, *_) in enumerate(docs):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, n, i))
    out = []
    for g, members in groups.items():
        best = min(members)
        out += [(m[4], best[4], len(members), m is best, hashlib.sha256(g.encode()).hexdigest()) for m in members]
    return sorted(out, key=key)


@pytest.mark.parametrize("heavy", [2, 10**6])
def test_exact_dedup(spark, docs, heavy):
    got = exact_dedup.decide(spark, docs, heavy=heavy)
    assert rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == exact(documents())


def test_exact_dedup_keep(spark, docs, none):
    kept = exact_dedup.keep(spark, docs).collect()
    assert sorted(map(str, (r.doc_id for r in kept))) == sorted(str(r[0]) for r in exact(documents()) if r[3])
    assert exact_dedup.decide(spark, none).count() == 0


# --- mixing ----------------------------------------------------------------------


def test_mix(spark, docs, none):
    got = mixing.mix(spark, docs, block=64)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = {}
    for r in got.collect():
        by.setdefault(r.source, []).append(r)
    total = sum(size(d[1]) for d in documents())
    have = {}
    for d in documents():
        have[d[3]] = have.get(d[3], 0) + size(d[1])
    names = sorted(k for k in have if k is not None) + [None]
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    target, open_ = {}, set(names)
    while True:  # reshare the excess until no source is above its limit
        rest = total - sum(target.values())
        share = {n: rest * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = [n for n in open_ if share[n] > 3 * have[n]]
        if not over:
            target |= share
            break
        for n in over:
            target[n] = 3 * have[n]
            open_.discard(n)
    for n, group in by.items():
        assert all(abs(r.target - target[n]) < 1e-6 and r.source_size == have[n] for r in group)
        assert 0 <= target[n] - sum(r.taken for r in group) < 1 + 1e-6
        assert all(r.taken <= 3 * r.size for r in group)
    cols = ("doc_id", "source", "size", "target", "taken")
    assert rows(got, *cols) == rows(mixing.mix(spark, docs, block=1000), *cols)
    assert mixing.mix(spark, none).count() == 0


def test_schedule_spreads_sources(spark):
    sizes = spark.createDataFrame([("a", 64_000), ("b", 64_000), ("c", 64_000)], "source string, source_size long")
    slots = mixing.schedule(mixing.targets(sizes, 64, 3)).collect()
    assert sorted((s.no, s.rank) for s in slots) == [(n, r) for n in range(3) for r in range(max(s.rank for s in slots if s.no == n) + 1)]
    early = [s.no for s in sorted(slots, key=lambda s: s.time)[:120]]
    assert abs(early.count(0) - 20) < 6 and abs(early.count(1) - 40) < 6


# --- SimHash ---------------------------------------------------------------------


def brute_groups(values, radius=3):
    f = np.array(values, dtype=np.uint64)
    lab = list(range(len(f)))
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= radius):
            a, b = lab[i], lab[int(j)]
            if a != b:
                lab = [min(a, b) if x in (a, b) else x for x in lab]
    return lab


def plain_fingerprint(text, words=3):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(spark, docs, none):
    d = [x for x in documents() if x[0] != 100]  # the 20,000-word texts are near copies; two are enough here
    got = simhash.near_groups(spark, docs.where("doc_id is null or doc_id <> 100"))
    fps = [plain_fingerprint(x[1]) for x in d]
    lab = brute_groups(fps)
    least = {}
    for x, g in zip(d, lab, strict=True):
        if x[0] is not None:
            least[g] = min(least.get(g, x[0]), x[0])
    want = sorted(((x[0], f - (1 << 64) if f >> 63 else f, least.get(g)) for x, f, g in zip(d, fps, lab, strict=True)), key=key)
    assert rows(got, "doc_id", "fp", "component_id") == want
    assert got.where("_row = first_row").count() == len(set(lab))
    assert simhash.near_groups(spark, none).count() == 0


@pytest.mark.parametrize("block", [4, 1 << 14])
def test_index_on_dense_group(spark, block):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(80)}
    fps |= {f ^ 0b1111 for f in list(fps)[:20]}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {r.node & ((1 << 64) - 1): r.root for r in simhash.link(spark, df, block=block).collect()}
    lab = brute_groups(fps)
    groups = {}
    for f, g in zip(fps, lab, strict=True):
        groups.setdefault(g, set()).add(f)
    for members in groups.values():
        roots = {got.get(f) for f in members}
        assert len(roots) == 1 and (None in roots) == (len(members) == 1)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {}
    for r in components(spark, spark.createDataFrame(edges, "u long, v long")).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(41)), list(range(100, 160)), [200, 201]]


def test_near_copies_of_the_stage(spark, none):
    rng, texts, first = random.Random(21), {}, {}
    for i in range(60):  # one to eight words changed of 200 or so: similarities from 0.66 to 0.95
        w = prose(rng, 200 + rng.randrange(100)).split()
        texts[10 * i] = " ".join(w)
        for k in range(1, 3):
            v = list(w)
            for at in rng.sample(range(10, len(w) - 10), rng.randrange(1, 9)):
                v[at] = f"new{rng.randrange(10**6)}"
            texts[10 * i + k] = " ".join(v)
    w = prose(rng, 300).split()
    texts |= {1000 + k: " ".join([*w[:k], "odd", *w[k + 1 :]]) for k in range(150)}  # one large group
    texts |= {2000: "one two three", 2001: "One  two three", 2002: "one two four"}
    sh = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(max(len(t.split()) - 4, 1))} for i, t in texts.items()}
    ids = sorted(texts)
    for i in ids:
        first[i] = i
    low = 0
    for i in ids:
        for j in ids:
            n = len(sh[i] & sh[j])
            if i < j and n >= 0.8 * (len(sh[i]) + len(sh[j]) - n) - 1e-9:
                low += n < 0.9 * (len(sh[i]) + len(sh[j]) - n)
                a, b = sorted((first[i], first[j]))
                first = {k: a if v == b else v for k, v in first.items()}
    assert low > 20
    path = new_folder(spark, "test-near")
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4).write.parquet(path)
    got = {r.doc_id for r in simhash.keep(spark, spark.read.parquet(path)).collect()}
    assert got == set(first.values())
    assert simhash.keep(spark, none).count() == 0


# --- decontamination ---------------------------------------------------------------


def test_decontaminate(spark, none):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randrange(14, 60))) for i in range(12)] + [(90, None), (91, ""), (92, "two words")]
    texts = {}
    for i, (_, t) in enumerate(items[:12]):
        w = t.split()
        texts[i] = prose(rng, 3000) + " " + t.upper() + "! " + prose(rng, 3000)  # whole, other case
        texts[100 + i] = " ".join([*w[: len(w) // 2], "changed", *w[len(w) // 2 + 1 :]])  # one word changed
        texts[200 + i] = prose(rng, 50) + " " + " ".join(w[: len(w) // 2])  # half of it
    texts |= {300: None, 301: "", 302: "TWO words"}
    d = spark.createDataFrame([(k, v, 1) for k, v in texts.items()] + [(0, texts[0], 2)], "doc_id long, text string, item_id long")
    path = new_folder(spark, "test-leaks")
    d.write.parquet(path)
    split = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    sh = lambda w: {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    want = set()
    for k, t in texts.items():
        for i, q in items:
            s = sh(split(q))
            if s and len(s & sh(split(t))) >= 0.8 * len(s) - 1e-9:
                want.add((k, i, len(s & sh(split(t))), len(s)))
    q = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(spark, spark.read.parquet(path), q)
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got.collect()} == want
    assert {k for k, *_ in want} >= set(range(12)) | {302} and not {k for k, *_ in want} & set(range(200, 212))
    assert {r.doc_id for r in decontaminate.keep(spark, spark.read.parquet(path), q).collect()} == set(texts) - {k for k, *_ in want}
    assert decontaminate.contaminated(spark, none, q).count() == 0


# --- secrets -----------------------------------------------------------------------


def test_secrets(spark, docs, none):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    rng = random.Random(8)
    plain = spark.createDataFrame([(i, " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(2000))) for i in range(5)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.find(spark, docs, secrets.train(spark, plain)).collect()}
    for i, t, *_ in documents():
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        if i is not None:
            assert [tuple(s) for s in got[i] if s.kind < 3] == sorted(want)
    extra = {documents()[[d[0] for d in documents()].index(i)][1][s.s : s.e] for i, ss in got.items() if i is not None for s in ss if s.kind == 3}
    assert extra == {"q7Zt0Kd92LmXv4RbYp81"}
    assert secrets.find(spark, none).count() == 0


# --- language ID ---------------------------------------------------------------------


def test_language(spark, docs, none):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    real = [d for d in documents() if d[0] is not None and d[0] < 60 and len(d[1].split()) > 3]
    assert sum(got[d[0]].lang_pred == d[2] for d in real) >= 0.97 * len(real)
    assert {got[i].lang_pred for i in (110, 111, 112, 113)} == {"und"} and got[113].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(docs).count() == docs.count()
    assert langid.identify(none).count() == 0
    unlabelled = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_unlearned_languages_go(spark):
    rng = random.Random(12)
    known = [(i, prose(rng, 200, FR if i % 3 == 0 else WORDS), "fr" if i % 3 == 0 else "en") for i in range(60)]
    short = [(1000 + i, prose(rng, rng.randrange(3, 8), FR if i % 2 else WORDS), None) for i in range(60)]
    spans = {"cyrillic": (0x430, 0x44F), "greek": (0x3B1, 0x3C9), "chinese": (0x4E00, 0x9000)}
    other = [" ".join("".join(chr(rng.randint(*s)) for _ in range(rng.randrange(2, 9))) for _ in range(n)) for s in spans.values() for n in (3, 20, 60, 200) for _ in range(12)]
    other += ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "Bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar",
              "Все люди рождаются свободными и равными в своем достоинстве и правах", "人人生而自由在尊严和权利上一律平等"]
    rows_ = known + short + [(2000 + i, t, None) for i, t in enumerate(other)]
    df = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows_], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in langid.keep(df).collect()}
    assert got == {i for i, *_ in known + short}


def test_bundling_is_binding():
    e = langid.Encoder()
    codes, counts = e.count("Ab, ab!")
    assert counts.sum() == 5  # " ab ab " has seven characters
    by_hand = sum(k * np.prod([np.roll(e.vectors[(c >> (21 * j)) & 0x1FFFFF].astype(int), j) for j in range(3)], axis=0) for c, k in [(int(c), int(k)) for c, k in zip(codes, counts, strict=True)] if e.bundle(codes, counts) is not None)
    assert np.allclose(by_hand, e.bundle(codes, counts))


# --- licences ------------------------------------------------------------------------


def test_licenses(spark, none):
    mit = dict(licenses.KNOWN[::-1])["MIT"]
    text = next(t for i, t in licenses.KNOWN if i == "MIT" and len(t) > 200)
    d = [
        (1, text), (2, "Copyright (c) 2020 Someone\n" + text.upper().replace("SUBLICENSE", "sub-licence")), (3, text + " extra"), (4, "prose\nReleased under the MIT Licence\nmore\nreleased under the mit license."),
        (5, None), (6, ""), (1, text),
    ]
    got = licenses.scan(spark.createDataFrame(d, "doc_id long, text string"), licenses.known_texts(spark))
    assert rows(got, "doc_id", "unit", "license", "n_units") == [(1, "line", "MIT", 2), (1, "text", "MIT", 2), (2, "line", "MIT", 1), (2, "text", "MIT", 1), (4, "line", "MIT", 2)]
    assert mit and licenses.scan(none, licenses.known_texts(spark)).count() == 0


def test_whole_licenses(spark):
    import os

    mit = next(t for i, t in licenses.KNOWN if i == "MIT" and len(t) > 200).removeprefix("MIT License ")
    isc = next(t for i, t in licenses.KNOWN if i == "ISC")
    d, want = [(1, mit), (2, f"The MIT License (MIT)\n\n© 2020 Someone\n\n{mit}"), (3, f"ISC License\n{isc}"), (4, f"Other title\n{mit}")], {(1, "MIT"), (2, "MIT"), (3, "ISC")}
    for n, file in enumerate(sorted(os.listdir(licenses.TEXTS))):
        with open(os.path.join(licenses.TEXTS, file), encoding="utf-8") as f:
            text = f.read()
        d += [(10 * n + 10, text), (10 * n + 11, text.strip().split("\n\n", 1)[1].upper()), (10 * n + 12, text + " and more")]
        want |= {(10 * n + 10, file[:-4]), (10 * n + 11, file[:-4])}
    apache = next(t for i, t in d if i == 10)
    d += [(900, apache[: apache.index("APPENDIX")]), (901, apache[: apache.index("END OF TERMS")])]
    want |= {(900, "Apache-2.0"), (901, "Apache-2.0")}
    got = licenses.scan(spark.createDataFrame(d, "doc_id long, text string"), licenses.known_texts(spark))
    assert {(r.doc_id, r.license) for r in got.where("unit = 'text'").collect()} == want


# --- token counts ----------------------------------------------------------------------


def test_token_counts(spark, docs, none):
    with open(token_counts.VOCABULARY, "rb") as f:
        enc = token_counts.encoding(f.read())
    folder = new_folder(spark, "test-tokens")
    manifest = token_counts.write_shards(spark, docs, folder)
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    want = sorted((d[0], len(enc.encode_ordinary(d[1] or ""))) for d in documents() if d[0] is not None)
    for block in (64, 1 << 20):
        found = token_counts.scan(spark, files, block_tokens=block).withColumn("file", F.element_at(F.split("path", "/"), -1))
        got = manifest.join(found, ["file", "ord"]).where("doc_id is not null")
        assert rows(got, "doc_id", "n_tokens") == sorted(want, key=key)
        assert found.count() == docs.count()
    assert token_counts.write_shards(spark, none, new_folder(spark, "test-no-tokens")).count() == 0


def test_scan_of_raw_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 9, 5000).astype("<u4")
    ids.tofile(tmp_path / "a.tok")
    np.zeros(0, "<u4").tofile(tmp_path / "empty.tok")
    np.full(40, 5, "<u4").tofile(tmp_path / "none.tok")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    got = {}
    for r in token_counts.scan(spark, files, width=4, eod=0, block_tokens=16, open_end=True).collect():
        got[(r.path.rpartition("/")[2], r.ord)] = r.n_tokens
    at = np.flatnonzero(ids == 0)
    want = {("a.tok", i): int(n) for i, n in enumerate(np.diff(np.append(-1, at)) - 1)} | {("none.tok", 0): 40}
    if len(ids) - at[-1] > 1:
        want[("a.tok", len(at))] = int(len(ids) - at[-1] - 1)
    assert got == want


# --- WARC --------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/x", "same é"), (2, "http://a/y", "same é"), (7, None, "same é"), (7, "http://b/", "same é"), (3, "http://a/z", None), (4, "http://a/w", "one\r\n\r\ntwo"), (None, "u", "same é"), (5, "http://long/", "é" * 3_000_000)]
    path = new_folder(spark, "test-pages")
    spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, original string").write.parquet(path)
    df = spark.read.parquet(path)
    archives = warc.write(spark, df, new_folder(spark, "test-warc"))
    whole = warc.assemble(warc.read(archives, with_payload=True)).collect()
    got = sorted(
        ((r.metadata.fields.get("page-id"), r.metadata.fields["payload-bytes"], r.capture.payload_digest, r.type, r.original and r.original.fields["page-id"]) for r in whole), key=key
    )
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = []
    for i, _, t in pages:
        again = t == "same é" and i != 7
        want.append((None if i is None else str(i), str(len((t or "").encode())), digest(t), "revisit" if again else "response", "7" if again else None))
    assert got == sorted(want, key=key)
    assert all(r.request for r in whole) and next(r for r in whole if r.metadata.fields.get("page-id") == "4").capture.payload == b"one\r\n\r\ntwo"
    none = new_folder(spark, "test-no-pages")
    df.limit(0).write.parquet(none)
    assert warc.write(spark, spark.read.parquet(none), new_folder(spark, "test-no-warc")).count() == 0


def test_min_bytes(spark):
    path = new_folder(spark, "test-pages")
    spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc" * 9), (4, "u", "abc" * 9)], "page_id long, url string, html string").write.parquet(path)
    assert [r.original for r in warc.roles(spark, spark.read.parquet(path), min_bytes=5).collect()] == [4]


# --- HTML ----------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li>Menu<li>More</ul></nav><div class="promo-box ad">Buy</div>
<article><h1>Head &amp; shoulders {0}</h1><p>First&nbsp;para {0} <b>bold
text</b><br>next<p>Second &eacute; {0}<ul><li>one<li>two</ul><div class="comments"><p>Reader says</p></div><aside>side</aside></article>
<div><p>House notice of this site.</p></div><footer>&copy; us</footer></body></html>"""


def test_html_text():
    assert html_text.text_of(PAGE.format("x"), set()) == "Head & shoulders x\nFirst para x bold text next\nSecond é x\none\ntwo"
    assert html_text.text_of(None, set()) == html_text.text_of("", set()) == ""
    assert html_text.text_of("plain <b>text", set()) == "plain text"
    assert html_text.text_of("<p>a<p>b</div></section><p title='x>y'>c", set()) == "a\nb\nc"


def test_site_templates(spark):
    rng = random.Random(4)
    page = "<html><body><div><p>Welcome to the site, all rules apply.</p></div><p>{}</p><p>{}</p><div><span>Follow the newsroom daily</span></div></body></html>"
    texts = [(prose(rng, 30), prose(rng, 30)) for _ in range(12)]
    pages = [(i, "http://h.example/x", page.format(*t)) for i, t in enumerate(texts)] + [(50 + i, "http://h.example/copy", page.format(*texts[0])) for i in range(30)]
    pages += [(90, None, None), (91, "bad", ""), (92, "http://other.example/", page.format("alone " * 9, prose(rng, 30)))]
    path = new_folder(spark, "test-html")
    spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, keys string").write.parquet(path)
    got = {r.page_id: r for r in html_text.extract(spark, spark.read.parquet(path)).collect()}
    assert got[3].text == "\n".join(texts[3]) and got[60].text == "\n".join(texts[0])
    assert got[90].text == got[91].text == "" and got[90].n_chars == 0
    assert "alone" in got[92].text and got[3].n_chars == len(got[3].text)


def test_rotating_templates_go(spark):
    rng = random.Random(6)
    page = "<html><body><div>{}</div><article><h1>{}</h1><div><p>{}</p><p>{}</p><table><tr><td>Yes</td><td>{}</td></tr></table></div></article></body></html>"
    texts = {i: [prose(rng, 6), prose(rng, 30), prose(rng, 30)] for i in range(80)}
    texts |= {100 + i: [prose(rng, 6), *texts[0][1:]] for i in range(8)}  # the same article under other headings
    pages = [(i, f"http://big.example/{i}", page.format(f"<p>Notice number {i % 8} of the house.</p>", *t, i)) for i, t in texts.items()]
    path = new_folder(spark, "test-rotating")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(path)
    got = {r.page_id: r.text for r in html_text.extract(spark, spark.read.parquet(path)).collect()}
    assert got == {i: "\n".join([*t, "Yes", str(i)]) for i, t in texts.items()}
    bare = page.replace("article", "div")
    pages = [(i, f"http://big.example/{i}", bare.format(f"<p>Notice number {i % 8} of the house.</p>", *t, i)) for i, t in texts.items() if i < 80]
    path = new_folder(spark, "test-rotating")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(path)
    assert not any("Notice" in r.text for r in html_text.extract(spark, spark.read.parquet(path)).collect())


def test_slugs_are_no_boilerplate():
    page = """<body><article><h2 id="related-work">Related work</h2><p class="notice">One</p><section id="notice-periods"><h3>Notice</h3><p>Two</p></section>
<div class="social-science"><p>Three</p></div><section id="navigation"><p>Four</p></section><div class="share-buttons">Tweet</div><div class="post sidebar">Aside</div></article></body>"""
    assert html_text.text_of(page, set()) == "Related work\nOne\nNotice\nTwo\nThree\nFour"
    assert html_text.text_of('<body><h2 id="related-work">Title</h2><p>Text</p><div id="comments">Reader</div></body>', set()) == "Title\nText"


# --- the pipeline -----------------------------------------------------------------------------


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline as P

    d, q = str(tmp_path), [(1, documents()[5][1])]
    docs.select(*P.COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(q, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = P.run(spark, d)
    pred = {(r.doc_id, r.text): r for r in langid.predict(docs.select("doc_id", "text"), langid.train(docs)).collect()}
    left = [x for x in documents() if pred[(x[0], x[1])].lang_pred != "und" and pred[(x[0], x[1])].score >= langid.MIN_SCORE]
    first = {}
    for x in sorted(left, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]", "", x[1]), x)
    left = list(first.values())
    lab, best = brute_groups([plain_fingerprint(x[1]) for x in left]), {}
    for x, g in zip(left, lab, strict=True):
        best[g] = min(best.get(g, x), x, key=lambda x: (x[0] is None, x[0] or 0))
    left = list(best.values())
    split = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    sh = lambda w: {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    want = sh(split(q[0][1]))
    left = [x for x in left if len(want & sh(split(x[1]))) < 0.8 * len(want)]
    assert rows(got, "doc_id") == sorted(((x[0],) for x in left), key=key)
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "mix"]
