"""Operator 2: main text of HTML pages with site template removal.

The text's scope is the richest ``article`` or ``main`` element, else the whole
body: siblings that share an article between them all belong to it.  What is
boilerplate by its meaning (menus, forms, scripts, notices, comments and so on)
is set aside first, so that it can't decide what the article is; inside the
article only a class of a container says so, never an id.

Site templates are found by hashes of element subtrees, which Spark counts per
host, each in how many different pages it occurs; exact copies of a page count
once.  A page has two kinds of them:

* ``shell``: the subtrees beside the way from the root to the core, the least
  element that holds all running text of the scope (paragraphs, headings,
  tables, quotes, and blocks of ``LONG`` characters of their own).  They are
  hashed by structure alone: the tags and classes above them, their own and
  those of their children, runs of equal children as one, text only by its
  presence.  So a bar, line of links or byline around the article recurs although
  its words differ from page to page; by definition it holds no running text, so
  no page can lose its article by it.
* ``copy``: subtrees of the scope hashed with their whole text and children, but
  for headings, paragraphs, lists, tables and their parts inside an article, and
  for what holds half of the scope's text.  Adverts inside the article and
  notices among sibling blocks go by it.  If the copies of a page hold half of
  its paragraphs' text or more, they are no template but the article itself,
  printed several times by the site, and stay.

A shell subtree goes if it recurs in ``SHELL_PAGES`` pages of the host at least,
a copy in ``MIN_PAGES``, and either in ``SHARE`` of the host's pages or, on hosts
of more than ``1 / SHARE ** 2`` pages, in the square root of their number.
Hosts of one or two pages rest on tags and class words alone.

Character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined by one newline in page order.

Only subtrees that may be deleted are counted, copies only if they are no
boilerplate anyhow.  Counts are pre-aggregated by (host, hash), so a host with a third of all pages
is spread over its subtrees; a page receives only its own deletions.

Defined cases: null or empty html gives an empty text; a null or unparsable url
is a host of its own (the empty one); repeated rows each give a row; an empty
table gives an empty result; broken markup is read as far as it goes (unclosed
elements end with their parent).
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, with_row_id

MIN_PAGES, SHELL_PAGES, SHARE, LONG = 5, 3, 0.01, 80

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li "
    "main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROP = frozenset("nav footer aside form script style noscript template iframe button select option textarea input menu dialog svg canvas object embed head title label".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
DROP_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation "
    "newsletter notice pagination pager popup promo promoted recommended related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "caption"}
#: An opening tag ends an open element of these tags, up to the scope's tags.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset("html body article main".split())
KEPT = HEADINGS | frozenset("p blockquote pre".split())
#: Running text: what holds it is no shell.
RUNNING = KEPT | frozenset("table ul ol dl figure".split())
#: Inside the article these recur by chance.
ITEMS = KEPT | frozenset("ul ol dl li dt dd table tr td th thead tbody tfoot caption figure figcaption".split())
#: Words that a class of a boilerplate container may hold besides DROP_WORDS.
PARTS = frozenset("area bar block box button buttons container icons inner item link links list posts reader readers replies reply section thread user users wrap wrapper".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Node:
    __slots__ = ("tag", "attrs", "items", "key", "weight", "words", "links", "shell", "gone", "around", "up")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.items, self.key, self.weight, self.words, self.links = tag, attrs, [], 0, 0, 0, 0
        self.shell, self.gone, self.around, self.up = None, False, None, None


def parse(text: str) -> Node:
    root = Node("#root")
    stack, at, n = [root], 0, len(text)
    while at < n:
        m = TOKEN.search(text, at)
        if m is None:
            stack[-1].items.append(text[at:])
            break
        if m.start() > at:
            stack[-1].items.append(text[at : m.start()])
        at, name = m.end(), m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "body") and tag not in ("html", "body", "article", "main"):
                    break  # a stray end tag doesn't leave these
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in ENDS:
            ended, scope = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended:
                    del stack[i:]
                    break
                if stack[i].tag in scope:
                    break
        node = Node(tag, m[3])
        stack[-1].items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
            node.items.append(text[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(node.attrs)} if node.attrs else {}


def order(root: Node) -> list[Node]:
    """Nodes, parents before children."""
    out = [root]
    for node in out:
        out.extend(x for x in node.items if not isinstance(x, str))
    return out


def hashed(nodes: list[Node], core: Node) -> None:
    """Sets ``key``, equal for equal subtrees, and ``shell`` of those around the core, equal for equal structure and place."""
    import xxhash

    shape: dict[Node, bytes] = {}
    for node in reversed(nodes):
        name = node.tag.encode() + (b"." + attributes(node).get("class", "").encode() if "class" in node.attrs.lower() else b"")
        h, g, last = xxhash.xxh64(name), xxhash.xxh64(name, 1), None
        for x in node.items:
            if isinstance(x, str):
                h.update(b"\x00" + x.strip().encode("utf-8", "replace"))
                mark = b"\x00" if x.strip() else None
            else:
                h.update(b"\x01" + x.key.to_bytes(8, "little"))
                mark = shape[x]
            if mark is not None and mark != last:
                g.update(mark)
                last = mark
        node.key, shape[node] = h.intdigest(), g.digest()
    way = [core]
    while way[-1].up is not None:
        way.append(way[-1].up)
    place = b""
    for node, inner in zip(reversed(way), [*reversed(way[:-1])], strict=False):
        place = xxhash.xxh64(place + node.tag.encode() + attributes(node).get("class", "").encode(), 1).digest()
        for x in node.items:
            if not isinstance(x, str) and x is not inner and x.tag not in WHOLE:
                x.shell = xxhash.xxh64(place + shape[x], 1).intdigest()


def boilerplate(node: Node, inside: bool) -> bool:
    if node.tag in DROP or (node.tag == "header" and not inside):
        return True
    if not node.attrs:
        return False
    a = attributes(node)
    if node.tag not in ("html", "body", "main", "article") and named(node, a, inside):
        return True
    return "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "") in DROP_ROLES or "display:none" in a.get("style", "").replace(" ", "").lower()


def named(node: Node, a: dict[str, str], inside: bool) -> bool:
    """Whether class or id name boilerplate; ids of headings, paragraphs and sections name their subject."""
    words = lambda text: set(re.split(r"[^a-z]+", CAMEL.sub("-", text).lower())) - {""}
    titled = node.tag == "section" and any(x.tag in HEADINGS for x in order(node))
    if not inside:
        return bool((words(a.get("class", "")) | (set() if titled or node.tag in KEPT else words(a.get("id", "")))) & DROP_WORDS)
    if node.tag in KEPT or titled:
        return False
    return any(w & DROP_WORDS and w <= DROP_WORDS | PARTS for w in map(words, a.get("class", "").split()))


def survey(root: Node) -> tuple[list[Node], Node, Node]:
    """All nodes, parents before children, the scope and the core; sets ``gone`` of boilerplate, ``around`` of nodes in an article or main element, and the weights of the rest."""
    nodes = order(root)
    for node in nodes:
        if not node.gone and (node.tag in ("article", "main") or ("main" in node.attrs and attributes(node).get("role") == "main")):
            node.around = node
        for x in node.items:
            if not isinstance(x, str):
                x.up, x.around = node, node.around
                x.gone = node.gone or boilerplate(x, node.around is not None)
    for node in reversed(nodes):
        live = [x for x in node.items if isinstance(x, str) or not x.gone]
        node.weight = sum(len(x.strip()) if isinstance(x, str) else x.weight for x in live)
        inner = [x for x in live if not isinstance(x, str)]
        node.words = node.weight if node.tag == "p" else sum(x.words for x in inner)
        node.links = node.weight if node.tag == "a" else sum(x.links for x in inner)
    live = [x for x in nodes if not x.gone]
    scope = None
    for tags in (("article",), ("main",)):
        found = [x for x in live if x.tag in tags or (tags == ("main",) and x.around is x and x.tag != "article")]
        best = max(found, key=lambda x: x.weight, default=None)
        if best is not None and best.weight:
            scope = best
            break
    if scope is not None:
        return nodes, scope, scope
    scope = next((x for x in live if x.tag == "body"), root)
    rich = {x for x in live if 2 * x.links < x.weight and (x.tag in RUNNING or (x.tag in BLOCK and sum(len(y.strip()) for y in x.items if isinstance(y, str)) >= LONG))}
    held = dict.fromkeys(rich, 1)
    for node in reversed(nodes):
        if node in held and node.up is not None:
            held[node.up] = held.get(node.up, 0) + held[node]
    core = scope
    while core not in rich:
        inner = [x for x in core.items if not isinstance(x, str) and not x.gone and held.get(x)]
        if len(inner) != 1:
            break
        core = inner[0]
    return nodes, scope, core.up if core in rich and core.up is not None and core is not scope else core


def copies_of(scope: Node) -> Iterator[Node]:
    """The subtrees of the scope that may be deleted as copies, parents before children."""
    work = [scope]
    while work:
        for x in work.pop().items:
            if isinstance(x, str) or x.gone:
                continue
            if x.tag in BLOCK and x.tag not in WHOLE and 2 * x.weight < scope.weight and not (x.around and (x.tag in ITEMS or 2 * x.weight >= x.around.weight)):
                yield x
            work.append(x)


def prune(scope: Node, nodes: list[Node], recurring: set[int]) -> None:
    """Marks what a template deletes as gone."""
    for x in nodes:
        if x.shell in recurring:
            x.gone = True
    hits = [x for x in copies_of(scope) if x.key in recurring]
    inside, words = set(), 0
    for x in hits:  # of nested hits the outer one counts
        up = x.up
        while up is not None and up not in inside:
            up = up.up
        if up is None:
            inside.add(x)
            words += x.words
    if not words or 2 * words < scope.words:
        for x in inside:
            x.gone = True


def blocks(node: Node) -> list[str]:
    out, line = [], []

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    work: list = [node]
    while work:
        x = work.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(entities.unescape(x) if "&" in x else x)
        elif x.tag == "br":
            line.append(" ")
        else:
            edge = x.tag in BLOCK
            if edge:
                flush()
                work.append(None)
            work.extend(y for y in reversed(x.items) if isinstance(y, str) or not y.gone)
    flush()
    return out


def text_of(html: str | None, recurring: set[int]) -> str:
    if not html:
        return ""
    nodes, scope, core = survey(parse(html))
    if recurring:
        hashed(nodes, core)
        prune(scope, nodes, recurring)
    return "\n".join(blocks(scope))


def subtrees(html: str) -> tuple[int, list[int], list[int]]:
    """Hashes of a page: whole, shell and copies, as signed integers."""
    nodes, scope, core = survey(parse(html))
    hashed(nodes, core)
    shells = {x.shell for x in nodes if x.shell is not None}
    copies = {x.key for x in copies_of(scope)}
    signed = lambda keys: [k - (1 << 63) for k in sorted(keys)]
    return nodes[0].key - (1 << 63), signed(shells), signed(copies)


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def templates(spark: SparkSession, pages: DataFrame, min_pages: int, share: float, shell_pages: int = SHELL_PAGES) -> tuple[DataFrame, DataFrame]:
    """The subtrees of each page (_row, host, page, shells, copies) and those that are template of a host (host, key)."""
    rows = with_row_id(pages.select("page_id", "url", "html")).where("html is not null").select("_row", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long, longs = pa.int64(), pa.list_(pa.int64())
        for b in batches:
            found = [subtrees(html.as_py()) for html in b.column(2)]
            cols = zip(*found, strict=True) if found else [()] * 3
            keys = [pa.array(list(c), of) for c, of in zip(cols, (long, longs, longs), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([host_of(u) for u in b.column(1).to_pylist()], pa.string()), *keys], names=["_row", "host", "page", "shells", "copies"])

    seen = stored(spark, rows.mapInArrow(run, "_row long, host string, page long, shells array<long>, copies array<long>"), "subtrees")
    firsts = seen.groupBy("host", "page").agg(F.min("_row").alias("_row"))  # copies of a page count once
    hosts = firsts.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    marked = lambda c, shell: F.transform(c, lambda k: F.struct(F.lit(shell).alias("shell"), k.alias("key")))
    each = seen.join(firsts.select("_row").hint("shuffle_hash"), "_row", "left_semi").select("host", F.explode(F.concat(marked("shells", True), marked("copies", False))).alias("k"))
    counted = each.groupBy("host", "k.shell", "k.key").agg(F.count(F.lit(1)).alias("n"))
    many = F.col("n") >= F.when(F.col("shell"), F.lit(shell_pages)).otherwise(F.lit(min_pages))
    often = counted.where(many).join(hosts, "host").where(F.col("n") >= F.least(share * F.col("pages"), F.sqrt("pages"))).select("host", "key")
    return seen, stored(spark, often, "templates")


def recurring(spark: SparkSession, pages: DataFrame, min_pages: int, share: float, shell_pages: int = SHELL_PAGES) -> DataFrame:
    """(_row, keys): hashes of template subtrees in the page, for pages that have any."""
    seen, often = templates(spark, pages, min_pages, share, shell_pages)
    hits = seen.select("_row", "host", F.explode(F.concat("shells", "copies")).alias("key")).join(often, ["host", "key"])
    return stored(spark, hits.groupBy("_row").agg(F.collect_list("key").alias("keys")), "deletions")


def extract(spark: SparkSession, pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, shell_pages: int = SHELL_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every page, and n_template, the template subtrees found in it; ``pages`` must be a file scan."""
    drop = recurring(spark, pages, min_pages, share, shell_pages)
    # Deletions grow with the pages: shuffled at every size, never broadcast.
    rows = with_row_id(pages.select("page_id", "url", "html")).join(drop.hint("shuffle_hash"), "_row", "left").select("page_id", "url", "html", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [{k + (1 << 63) for k in ks or ()} for ks in b.column(3).to_pylist()]
            found = [text_of(h.as_py(), ks) for h, ks in zip(b.column(2), keys, strict=True)]
            n = pa.array([len(ks) for ks in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), n], names=["page_id", "url", "text", "n_template"])

    rows = rows.mapInArrow(run, "page_id long, url string, text string, n_template long")
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_template")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_text": op2_html_text}
ORACLE: dict[str, str] = {}
