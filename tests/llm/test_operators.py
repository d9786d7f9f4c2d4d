"""The queries themselves, and each operator's method against brute force."""

import os
import random
import re
import subprocess
import sys
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from seriesgrove.llm import common, decontaminate, html_text, langid, licenses, mixing, registry, secrets, simhash, token_counts
from seriesgrove.llm.common import new_folder

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark conversations embeddings".split()
COLUMNS = {
    "op1_license_scan": "doc_id unit license n_units",
    "op2_html_text": "page_id url text n_chars n_template",
    "op3_mix_sources": "doc_id size source_size target taken first_slot",
    "op4_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op5_token_counts": "doc_id n_tokens",
    "op6_benchmark_leaks": "doc_id item_id n_shared n_item containment",
    "op7_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op8_language_id": "doc_id held_out lang_pred score",
    "op9_warc_roundtrip": "page_id payload_bytes payload_digest record_type refers_to url has_request",
    "op10_simhash_groups": "doc_id fingerprint component_id",
    "op11_prefix_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op12_fill_in_middle": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "op13_embedding_groups": "vec_id n_links component_id kept",
}
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def table_of(spark, rows, schema):
    path = new_folder(spark, "test")
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.read.parquet(path)


def cell(v):
    return "" if v is None or v != v else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@needs_tables
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns == COLUMNS[name].split()
    found = df.collect()
    one_row_each = {"op1_license_scan": None, "op6_benchmark_leaks": None, "op11_prefix_trie": None, "op13_embedding_groups": "embeddings", "op2_html_text": "pages", "op9_warc_roundtrip": "pages"}.get(name, "documents")
    if one_row_each:
        assert len(found) == duck.execute(f"SELECT count(*) FROM {one_row_each}").fetchone()[0]
    if name in registry.oracle_sql():
        want = duck.execute(registry.oracle_sql()[name])
        at = [[d[0] for d in want.description].index(c) for c in df.columns]
        assert sorted(tuple(map(cell, r)) for r in found) == sorted(tuple(cell(r[i]) for i in at) for r in want.fetchall())


@needs_tables
def test_secret_query_text(spark, duck):
    import hashlib

    got = {r.doc_id: r for r in registry.queries()["op7_secret_scan"](spark, SF).collect()}
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    for i, t in duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall():
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(base))
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= {*got[i].spans.split(","), ""}


# --- secrets: the models -------------------------------------------------------------------

VOWELS, OTHERS = "aeiou", "bcdfghklmnprstvw"


def syllables(rng, n):
    return "".join(rng.choice(OTHERS) + rng.choice(VOWELS) + rng.choice(["", "", "n", "r", "s"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(21)
    words = [syllables(rng, rng.randrange(1, 5)) for _ in range(800)]
    return words, table_of(spark, [(i, " ".join(rng.choices(words, k=400))) for i in range(60)], "doc_id long, text string")


def brute_ratio(model, s):
    n = len(secrets.ALPHABET)
    at = [secrets.ALPHABET.index(c) for c in s]
    return sum(model[a * n + b] for a, b in zip(at, at[1:], strict=False)) / (len(s) - 1)


def test_added_spans_equal_brute_force(spark, corpus):
    words, docs = corpus
    model, rng = secrets.train(spark, docs), random.Random(22)
    any_ = lambda n: "".join(rng.choice(secrets.ALPHABET) for _ in range(n))
    texts = []
    for i in range(60):
        parts = rng.choices(words, k=30) + [any_(rng.randrange(10, 60)), "_".join(rng.choices(words, k=4)), "token=" + any_(20).replace("/", "x"), "é" * 3, "a" * 40]
        rng.shuffle(parts)
        texts.append((i, " ".join(parts)))
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.find(spark, table_of(spark, texts, "doc_id long, text string"), model).collect()}
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    added = 0
    for i, t in texts:
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        runs = [m for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}", t) if len(set(m[0])) >= secrets.MIN_DISTINCT and brute_ratio(model, m[0]) > secrets.MIN_RATIO]
        free = [(m.start(), 3, m.end()) for m in runs if not any(s < m.end() and m.start() < e for s, _, e in base)]
        added += len(free)
        assert got[i] == sorted(base + free)
    assert added >= 30


def test_recall_and_false_alarms(spark, corpus):
    _, docs = corpus
    half = docs.where("doc_id % 2 = 0")
    model = secrets.train(spark, half)
    share = F.avg((secrets.ratio("s", model) > secrets.MIN_RATIO).cast("int")).alias("share")
    planted = secrets.random_samples(spark, 300, "others").withColumn("s", F.substring("s", 1, 24))
    found = {r.form: r.share for r in planted.groupBy("form").agg(share).collect()}
    assert set(found) == {"hex", "base64", "base62", "upper", "lower_digits", "lower", "uuid"} and min(found.values()) >= 0.95
    plain = secrets.ordinary_samples(secrets.sampled(docs.where("doc_id % 2 = 1"))).where("length(s) >= 16")
    assert plain.agg(share).first()[0] <= 0.002


def test_long_runs_are_linear(spark, corpus):
    model = secrets.train(spark, corpus[1])
    rng = random.Random(23)
    rows = [(1, "x " + "".join(rng.choices(secrets.ALPHABET, k=1_000_000)) + " y")]
    docs = table_of(spark, rows, "doc_id long, text string")
    began = time.time()
    assert [tuple(s) for s in secrets.find(spark, docs, model).first().spans] == [(2, 3, 1_000_002)]
    assert time.time() - began < 15  # 2 s alone; a quadratic form takes an hour


def test_no_words_no_added_spans(spark):
    docs = table_of(spark, [(1, "q7Zt0Kd92LmXv4RbYp81 internationalisation password=abcdefgh1")], "doc_id long, text string")
    assert [tuple(s) for s in secrets.find(spark, docs).first().spans] == [(42, 0, 60)]


# --- language ID ---------------------------------------------------------------------------


def brute_vector(text):
    """The bundled vector of a text, letter by letter."""
    plain = re.sub(r"[\W\d_]+", " ", f" {text.lower()} ")
    of = lambda c: np.random.default_rng([langid.SEED, ord(c)]).integers(0, 2, langid.DIM) * 2 - 1
    letters = {c: of(c) for c in set(plain)}
    out = np.zeros(langid.DIM)
    for i in range(len(plain) - 2):
        out += np.prod([np.roll(letters[plain[i + 2 - k]], k) for k in range(3)], axis=0)
    return out


def languages():
    rng = random.Random(31)
    kinds = {"aa": [syllables(rng, 2) for _ in range(30)], "bb": [syllables(rng, 3)[::-1] for _ in range(30)], "cc": ["".join(rng.choices("xyzqäöü", k=5)) for _ in range(30)]}
    return [(i, " ".join(rng.choices(kinds[k], k=12)), k) for i, k in enumerate(rng.choices(sorted(kinds), k=60))]


def test_language_equals_brute_force(spark):
    docs = languages()
    got = {r.doc_id: r for r in langid.identify(table_of(spark, docs, "doc_id long, text string, lang string")).collect()}
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in docs}
    proto = {k: sum(brute_vector(t) for i, t, x in docs if x == k and not held[i]) for k in ("aa", "bb", "cc")}
    for i, t, _ in docs:
        v = brute_vector(t)
        near = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for k, p in proto.items()}
        best = max(sorted(near), key=near.get)
        assert got[i].held_out == held[i] and got[i].lang_pred == best
        assert abs(got[i].score - near[best]) < 0.03  # the length of a text's vector is its expected value


def test_more_languages_than_a_block(spark):
    docs = table_of(spark, languages() + [(1000 + i, f"only {chr(0x4E00 + i)}{chr(0x4F00 + i)}{chr(0x5000 + i)}", f"l{i:03d}") for i in range(12)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    one = {r.doc_id: (r.lang_pred, round(r.score, 5)) for r in langid.predict(docs, model).collect()}
    assert {r.doc_id: (r.lang_pred, round(r.score, 5)) for r in langid.predict(docs, model, 2).collect()} == one
    assert [len(b) for b in langid.blocks(model, 2)][:2] == [2, 2]


def test_rare_letters_are_letters(spark):
    docs = table_of(spark, [(1, "\U00030000\U000323af words", "aa"), (2, "\U00030000\U00030001", "aa"), (3, "\U000f0000 1", "aa")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, {"aa": np.ones(langid.DIM)}).collect()}
    assert got == {1: "aa", 2: "aa", 3: "und"}


# --- HTML ------------------------------------------------------------------------------------

SITE = """<html><head><title>{0}</title></head><body class="site"><nav><ul>{1}</ul></nav><div class="x-top"><b>{2}</b></div>
<div class="content"><p>{3}</p><p>{4}</p>{5}</div><div class="foot-line"><span>{2} {0}</span></div></body></html>"""


def site_pages(n=12):
    rng = random.Random(41)
    line = lambda k: " ".join(syllables(rng, 2) for _ in range(k))
    out = []
    for i in range(n):
        menu = "".join(f'<li><a href="/{k}">{line(1)}</a></li>' for k in range(rng.randrange(3, 7)))
        more = "".join(f"<p>{line(20)}</p>" for _ in range(rng.randrange(0, 4)))
        out.append((i, "http://one.example/" + str(i), SITE.format(line(3), menu, line(4), line(30), line(25), more)))
    return out + [(100, "http://two.example/", out[0][2]), (101, "http://two.example/2", out[1][2]), (102, None, None), (103, "http://one.example/c", out[3][2])]


def test_shell_recurs_though_its_words_differ(spark):
    pages = site_pages()
    df = table_of(spark, pages, "page_id long, url string, html string")
    _, often = html_text.templates(spark, df, 5, 0.01)
    found = {(r.host, r.key) for r in often.collect()}
    # The same counts in plain Python.
    seen, whole = defaultdict(Counter), defaultdict(set)
    for _, url, html in pages:
        if html is not None:
            page, shells, copies = html_text.subtrees(html)
            if page not in whole[html_text.host_of(url)]:
                whole[html_text.host_of(url)].add(page)
                seen[html_text.host_of(url)].update([(True, k) for k in shells] + [(False, k) for k in copies])
    want = {
        (h, k) for h, n in seen.items() for (shell, k), c in n.items() if c >= (html_text.SHELL_PAGES if shell else 5) and c >= min(0.01 * len(whole[h]), len(whole[h]) ** 0.5)
    }
    assert found == want and len(want) >= 3 and {h for h, _ in want} == {"one.example"}
    got = {r.page_id: r for r in html_text.extract(spark, df).collect()}
    assert all(got[i].n_template >= 3 for i in range(12)) and got[100].n_template == 0
    paragraphs = lambda html: "\n".join(re.findall(r"<p>(.*?)</p>", html))
    assert {i: got[i].text for i in range(12)} == {i: paragraphs(h) for i, _, h in pages[:12]}


def test_repeats_inside_an_article_stay(spark):
    rng = random.Random(42)
    page = '<body><article><h1>T{0}</h1><p>para {0} {1}</p><ul><li>Serves four people</li></ul><table><tr><th>Price</th><td>{0}</td></tr></table><div class="share-price">own {0}</div></article></body>'
    pages = [(i, f"http://h.example/{i}", page.format(i, syllables(rng, 20))) for i in range(10)]
    got = {r.page_id: r.text.split("\n") for r in html_text.extract(spark, table_of(spark, pages, "page_id long, url string, html string")).collect()}
    assert all(len(x) == 6 and x[2:] == ["Serves four people", "Price", str(i), f"own {i}"] for i, x in got.items())


def texts_of(spark, pages):
    return {r.page_id: r.text for r in html_text.extract(spark, table_of(spark, pages, "page_id long, url string, html string")).collect()}


def test_posts_stay_below_longer_comments(spark):
    rng = random.Random(7)
    line = lambda k: " ".join(syllables(rng, 2) for _ in range(k))
    post = {i: [line(12) for _ in range(3)] for i in range(8)}
    paragraphs = lambda xs: "".join(f"<p>{x}</p>" for x in xs)
    page = '<body><div class="post">{}</div><div class="comments">{}</div></body>'
    pages = [(i, f"http://blog.example/{i}", page.format(paragraphs(x), paragraphs(line(30) for _ in range(6)))) for i, x in post.items()]
    assert texts_of(spark, pages) == {i: "\n".join(x) for i, x in post.items()}
    # Nor do they go where no class tells the comments.
    pages = [(i, u, h.replace('"comments"', '"below"')) for i, u, h in pages]
    assert all(t.startswith("\n".join(post[i])) and t.count("\n") == 8 for i, t in texts_of(spark, pages).items())


def test_articles_split_over_siblings_stay_whole(spark):
    rng = random.Random(8)
    line = lambda k: " ".join(syllables(rng, 2) for _ in range(k))
    parts = {i: [line(9), *[line(25) for _ in range(4)], line(11)] for i in range(8)}
    page = '<body><div class="lead"><p>{0}</p></div><div class="x1"><p>Buy two and pay for one only here.</p></div><div class="story"><p>{1}</p><p>{2}</p><p>{3}</p></div><div class="more"><p>{4}</p><p>{5}</p></div></body>'
    pages = [(i, f"http://news.example/{i}", page.format(*x)) for i, x in parts.items()]
    assert texts_of(spark, pages) == {i: "\n".join(x) for i, x in parts.items()}
    alone = texts_of(spark, [(1, "http://one.example/", page.format(*parts[0]))])
    assert alone == {1: "\n".join([parts[0][0], "Buy two and pay for one only here.", *parts[0][1:]])}


def test_adverts_inside_articles_go(spark):
    """Whole copies in 12 pages of a site, counted here from the markup itself."""
    rng = random.Random(9)
    line = lambda k: " ".join(syllables(rng, 2) for _ in range(k))
    adverts = [f'<div class="y{k}"><p>{line(6)}</p></div>' for k in range(3)]
    texts = {i: [line(5), line(30), line(20)] for i in range(12)}
    html = {i: f"<body><article><h1>{t[0]}</h1><p>{t[1]}</p>{adverts[i % 3]}<p>{t[2]}</p></article></body>" for i, t in texts.items()}
    pages = [(i, f"http://ads.example/{i}", h) for i, h in html.items()]
    counts = Counter(x for h in set(html.values()) for x in set(re.findall(r'<div class="y\d">.*?</div>', h)))
    gone = {x for x, n in counts.items() if n >= 5}
    assert gone == set() and all(len(t.split("\n")) == 4 for t in texts_of(spark, pages).values())
    pages += [(100 + i, f"http://ads.example/more/{i}", f"<body><article><h1>{line(5)}</h1><p>{line(30)}</p>{adverts[0]}</article></body>") for i in range(2)]
    got = texts_of(spark, pages)
    counts.update({adverts[0]: 2})
    gone = {x for x, n in counts.items() if n >= 5}
    assert gone == {adverts[0]}
    assert [i for i, t in sorted(got.items()) if len(t.split("\n")) == (4 if i < 100 else 3)] == [i for i in sorted(texts) if adverts[i % 3] not in gone]


def test_an_article_printed_often_stays(spark):
    rng = random.Random(10)
    line = lambda k: " ".join(syllables(rng, 2) for _ in range(k))
    body = "".join(f"<div><p>{line(20)}</p></div>" for _ in range(6))
    pages = [(i, f"http://print.example/{i}", f"<body><p>{line(8)}</p>{body}</body>") for i in range(9)]
    assert all(t.count("\n") == 6 for t in texts_of(spark, pages).values())


def test_comments_go_whatever_the_case():
    for name in ("commentList", "CommentThread", "COMMENTS", "user-comments", "comments_section", "reader-comments"):
        assert html_text.text_of(f'<body><article><p>Text</p><div class="{name}"><p>Reader</p></div></article></body>', set()) == "Text", name


def test_very_large_page(spark):
    body = "".join(f"<div><p>para {i} &amp; more</p></div>" for i in range(60_000)) + "<div>" * 3000 + "deep"
    rows = [(1, "http://h.example/", f"<body><article>{body}</article></body>")]
    got = html_text.extract(spark, table_of(spark, rows, "page_id long, url string, html string")).first()
    assert got.text.split("\n") == [f"para {i} & more" for i in range(60_000)] + ["deep"]


# --- SimHash: the search's memory ------------------------------------------------------------

PEAK = """
import resource, sys
sys.path.insert(0, {0!r})
import numpy as np
from seriesgrove.llm.simhash import link_runs
bits = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 16384, dtype=np.uint64))
rank = bits.copy()
for s in (1, 2, 4, 8, 16, 32):
    rank ^= rank >> np.uint64(s)
bits = bits[np.argsort(rank)]
link_runs(bits[:64], np.zeros(1, np.int64), 3)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
link_runs(bits, np.zeros(1, np.int64), 3)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_dense_run_in_bounded_memory():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = subprocess.run([sys.executable, "-c", PEAK.format(root)], capture_output=True, text=True, check=True)
    assert int(said.stdout) < 150


def test_run_over_many_blocks(spark):
    rng = random.Random(51)
    lead = 0x1234 << 48
    fps = sorted({lead | rng.getrandbits(48) for _ in range(300)})
    fps += [f ^ (1 << rng.randrange(48)) ^ (1 << rng.randrange(48)) for f in fps[:40]]
    df = spark.createDataFrame([(f if f < 1 << 63 else f - (1 << 64),) for f in dict.fromkeys(fps)], "fp long")
    got = defaultdict(set)
    for r in simhash.link(spark, df, block=32).collect():
        got[r.root].add(r.node)
    alone = {f: f for f in fps}

    def find(x):
        while alone[x] != x:
            x = alone[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                alone[find(a)] = find(b)
    want = defaultdict(set)
    for f in fps:
        want[find(f)].add(f)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


@pytest.mark.parametrize(("pairs", "own", "same"), [(400, 40, 12), (20, 40, 12), (300, 60, 37)])
def test_mates_in_dense_families(spark, monkeypatch, pairs, own, same):
    """Documents that share most of their text but lie below the similarity, each with one mate above it."""
    monkeypatch.setattr(simhash, "RUN_ROWS", 64)
    rng = random.Random(pairs)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    common, rows = [word() for _ in range(260)], []
    for k in range(pairs):
        first = [word() for _ in range(own)]
        rows += [(2 * k, " ".join(common + first)), (2 * k + 1, " ".join(common + first[:same] + [word() for _ in range(own - same)]))]
    sets = {i: set(simhash.stage_shingles(t.encode()).tolist()) for i, t in rows}
    near = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert all(near(2 * k, 2 * k + 1) >= 0.8 for k in range(pairs)) and max(near(0, 2 * k) for k in range(1, pairs)) < 0.79
    got = {r.doc_id: r.root for r in simhash.similar(spark, table_of(spark, rows, "doc_id long, text string")).collect()}
    found = sum(got.get(2 * k, -1) == got.get(2 * k + 1, -2) for k in range(pairs))
    assert found >= 0.99 * pairs
    assert len({got[2 * k] for k in range(pairs) if 2 * k in got}) >= found  # families stay apart


def test_stage_finds_its_candidates_by_the_index(spark, monkeypatch):
    """Pairs just above the similarity; without the index's links only equal fingerprints would meet."""
    rng, rows = random.Random(91), []
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    for k in range(150):
        w = [word() for _ in range(200)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:180] + [word() for _ in range(20)]))]
    for k in range(150, 300):  # four of five shingles
        w = [word() for _ in range(9)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:8]))]
    docs, link, asked = table_of(spark, rows, "doc_id long, text string"), simhash.link, []

    def watched(spark, fps, radius, **kw):
        asked.append((radius, kw["bands"], kw["tag"]))
        return link(spark, fps, radius, **kw)

    monkeypatch.setattr(simhash, "link", watched)
    got = {r.doc_id: r.root for r in simhash.similar(spark, docs).collect()}
    assert asked == [(simhash.STAGE_RADIUS, simhash.BANDS, simhash.TAG)]
    assert sum(2 * k in got and got[2 * k] == got.get(2 * k + 1) for k in range(300)) >= 296 and len(set(got.values())) >= 296
    monkeypatch.setattr(simhash, "link", lambda spark, fps, *a, **kw: link(spark, fps, *a, **kw).where("false"))
    assert simhash.similar(spark, docs).count() < 20


@pytest.mark.parametrize("block", [8, 1 << 14])
def test_index_of_tables(spark, block):
    """Links of one table that agree on a band and lie within the radius, against all pairs."""
    rng = random.Random(92)
    fps = [t << 60 | rng.getrandbits(60) for t in (0, 1, 15) for _ in range(60)]
    for f in fps[:150]:
        g = f
        for _ in range(rng.randrange(1, 13)):
            g ^= 1 << rng.randrange(60)
        fps += [g, g ^ 1 << 60]
    fps = sorted(set(fps))
    band = lambda f, g: any(not (f ^ g) >> 12 * k & 4095 for k in range(5))
    lab = {f: f for f in fps}
    for i, f in enumerate(fps):
        for g in fps[:i]:
            if f >> 60 == g >> 60 and (f ^ g).bit_count() <= 11 and band(f, g) and lab[f] != lab[g]:
                a, b = sorted((lab[f], lab[g]))
                lab = {k: a if v == b else v for k, v in lab.items()}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got, want = defaultdict(set), defaultdict(set)
    for r in simhash.link(spark, df, 11, block=block, bands=5, tag=4).collect():
        got[r.root].add(r.node & ((1 << 64) - 1))
    for f, a in lab.items():
        want[a].add(f)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_jaccard_of_blocks():
    rng = np.random.default_rng(2)
    x, y = ([np.unique(rng.integers(0, 300, n)) for n in rng.integers(1, 200, k)] for k in (7, 9))
    want = [[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for b in y] for a in x]
    assert np.allclose(simhash.jaccard(x, y, 50), want) and np.allclose(simhash.jaccard(x, y), want)


def test_candidates_do_not_depend_on_the_ranges(spark, monkeypatch):
    """One key of a third of the rows, and others; the same links, by row and by doc_id, however the rows are cut."""
    monkeypatch.setattr(simhash, "BANDS", 3)
    rng = random.Random(71)
    docs = [(i, 1000 + i, [7 if i % 3 == 0 else rng.randrange(40), 8 if i % 6 == 0 else rng.randrange(30), rng.randrange(20)]) for i in range(600)]
    schema = "_row long, doc_id long, keys array<long>"
    ord_ = {r.doc_id: r.o for r in spark.createDataFrame(docs, schema).select("doc_id", F.xxhash64("doc_id").alias("o")).collect()}
    rows = sorted((k[b], k[(b + 1) % 3], ord_[d], i) for i, d, k in docs for b in range(3))
    want, key_first, both_first = set(), {}, {}
    for n, (k, x, _, i) in enumerate(rows):
        links = [key_first.setdefault(k, i), both_first.setdefault((k, x), i)] + ([rows[n - 1][3]] if n and rows[n - 1][0] == k else [])
        want |= {(min(i, j), max(i, j)) for j in links if i != j}
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "5", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert {(r.a, r.b) for r in simhash.candidates(spark, spark.createDataFrame(docs, schema)).collect()} == want, n
        shuffled = docs[:]
        rng.shuffle(shuffled)
        other = {i: d for i, (_, d, _) in enumerate(shuffled)}
        got = simhash.candidates(spark, spark.createDataFrame([(i, d, k) for i, (_, d, k) in enumerate(shuffled)], schema)).collect()
        assert {frozenset((other[r.a] - 1000, other[r.b] - 1000)) for r in got} == {frozenset(p) for p in want}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# --- the rest -----------------------------------------------------------------------------------


def test_mix_sequence(spark):
    rng = random.Random(61)
    docs = [(i, " ".join("w" for _ in range(rng.randrange(0, 900))), rng.choice(["a", "b", None, "c"])) for i in range(200)] + [(7, None, "a"), (None, "x y", "b")]
    df = table_of(spark, docs, "doc_id long, text string, source string")
    every = mixing.sequence(spark, df, block=64).collect()
    mixed = mixing.mix(spark, df, block=64).collect()
    assert sum(r.words for r in every) == sum(r.taken for r in mixed)
    assert Counter((r.doc_id, r.words > 0) for r in every).keys() == {(r.doc_id, True) for r in mixed if r.taken}
    sizes = {r.doc_id: r.size for r in mixed}
    assert all(0 <= r.start and r.start + r.words <= sizes[r.doc_id] for r in every if r.doc_id not in (7, None))
    places = sorted({(r.slot, r.at, r.source) for r in every}, key=lambda r: r[:2])
    assert len(places) == len(every)  # no two pieces share a place
    assert len({r.slot: r.source for r in every}) == len({(r.slot, r.source) for r in every})  # a slot has one source
    # Any stretch of the mix holds the sources about as the targets say.
    target = {r.source: r.target for r in mixed}
    half = [r for r in every if r.slot <= np.median([x.slot for x in every])]
    for s, t in target.items():
        assert abs(sum(r.words for r in half if r.source == s) / sum(r.words for r in half) - t / sum(target.values())) < 0.06
    first = {}
    for r in every:
        first[r.doc_id] = min(first.get(r.doc_id, r.slot), r.slot)
    assert all(r.first_slot == first.get(r.doc_id) for r in mixed if r.doc_id != 7)


def test_license_spellings_and_spaces(spark):
    known = spark.createDataFrame([("X", "licence licence licence of the X • work")], "license string, text string")
    docs = [(1, "• License license «licence» of the X… work"), (2, "license of the X work")]
    got = licenses.scan(spark.createDataFrame([(*d, "clash", "clash") for d in docs], "doc_id long, text string, license string, digest string"), known)
    assert {(r.doc_id, r.unit, r.license) for r in got.collect()} == {(1, "text", "X"), (1, "line", "X")}


def test_a_shingle_of_all_documents(spark, monkeypatch):
    docs = [(i, "the very same five words " + f"and {i} others of its own") for i in range(200)]
    items = [(1, "the very same five words"), (2, "and 7 others of its own")]
    args = table_of(spark, docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(i, 1) for i in range(200)} | {(7, 2)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, *args).collect()} == want
    monkeypatch.setattr(decontaminate, "fits", lambda df: False)
    monkeypatch.setattr(decontaminate, "small", lambda df: df)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, *args).collect()} == want


def test_scratch_needs_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: "")

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        common.scratch(Session)


def test_vocabulary_must_leave_room(spark, tmp_path, monkeypatch):
    path = tmp_path / "v"
    path.write_bytes(b"YQ== 50256\n")
    with pytest.raises(ValueError, match="end-of-document"):
        token_counts.write_shards(spark, table_of(spark, [(1, "a")], "doc_id long, text string"), new_folder(spark, "t"), str(path))


@pytest.mark.parametrize("empty", ["documents", "benchmark"])
def test_pipeline_on_empty_tables(spark, tmp_path, empty):
    import corpus_pipeline as P

    docs = [(i, t, k, "s", len(t)) for i, t, k in languages()]
    spark.createDataFrame([] if empty == "documents" else docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([] if empty == "benchmark" else [(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert (P.run(spark, str(tmp_path)).count() > 0) == (empty == "benchmark")
