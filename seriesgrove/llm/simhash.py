"""Operator 10: SimHash near-dedup on a Gray-order hierarchical index.

Fingerprints: ASCII-lower-cased text, words without ASCII white space, shingles
of ``words`` consecutive words (repeats count), XXH64 with seed 42; a bit is 1
if set in more than half of the hashes.

Links at ``radius`` or fewer differing bits, without all-pairs work.  Equal
fingerprints merge first.  Two linked fingerprints agree on at least one of
``radius + 1`` equal bands, so each distinct fingerprint appears once per band,
rotated so that the band leads.  Rows are range-partitioned and sorted by the
Gray rank of the rotated bits; a band value is then a contiguous run and close
patterns lie side by side.  Over each run a task builds a tree whose nodes hold
the bits all their members share.  A search walks the tree level by level with
the differences accumulated so far: a node whose shared bits already differ in
more than ``radius`` places is pruned whole, and a node that cannot exceed the
radius is accepted whole.  A run that is longer than a block, or that lies
across tasks, is cut into blocks; pairs of blocks of one run are searched too
unless their shared bits rule them out, so a group of any size is neither
gathered in one task nor cut off.  A search holds at most ``STATES`` states of
each level.  Tasks emit spanning links, not pairs.

Defined cases: null text equals empty text (fingerprint 0, linked like any
other); texts with fewer words than a shingle are one shingle; component_id is
the smallest non-null doc_id of the component, null if it has none; repeated
rows each give a row; an empty table gives an empty result.

The near_dedup stage of the pipeline (``keep``) has a setting of its own:
five-word shingles and Jaccard similarity of 0.8 or more, where a bit of two
fingerprints differs with a probability of up to 0.15, ten of 64.  So a document
has ``TABLES`` fingerprints of 60 bits there, by independent hashes, and the same
index links those of one table that agree on one of ``BANDS`` bands and lie
within ``STAGE_RADIUS`` bits.  Rows whose fingerprints are in one component of a
table are candidates; a document is dropped only after an exact comparison of
the shingle sets.  All rows of such a component are compared, unless they are
in one component of near copies already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, small, stored, table, with_row_id, without

WORDS, RADIUS = 3, 3
#: The pipeline's stage: fingerprints of 64 - TAG bits below the number of their table.
STAGE_WORDS, SIMILARITY, TABLES, TAG, BANDS, STAGE_RADIUS, STAGE_SEED = 5, 0.8, 12, 4, 5, 9, 11
SHORT, MORE, FOLD = 40, 4, 4  # texts of so few shingles have so many more tables, with so many hashes of a shingle: few votes are often tied
BLOCK = 1 << 14
RUN_ROWS, RUN_HASHES = 256, 1 << 18  # of a block in which long runs of the stage are compared
FAN = 8
ASKED, STATES = 1 << 13, 1 << 16  # patterns that start a search together; search states of one level


# --- fingerprints -----------------------------------------------------------


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The fingerprint as an unsigned integer."""
    import xxhash

    w = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(_row, doc_id, fp) with fp as a signed 64-bit integer."""
    rows = with_row_id(docs.select("doc_id", "text")).select("_row", "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in b.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found)], names=["_row", "doc_id", "fp"])

    return rows.mapInArrow(run, "_row long, doc_id long, fp long")


# --- the index over sorted runs ---------------------------------------------


def roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Least node of each node's component, by hooking and pointer jumping."""
    lab = np.arange(n) if label is None else label
    while len(a):
        x, y = lab[a], lab[b]
        live = x != y
        if not live.any():
            break
        a, b, x, y = a[live], b[live], x[live], y[live]
        np.minimum.at(lab, np.maximum(x, y), np.minimum(x, y))
        while True:
            nxt = lab[lab]
            if (nxt == lab).all():
                break
            lab = nxt
    return lab


class Forest:
    """A tree over each run of sorted bit patterns; ``start`` are the runs' first positions."""

    def __init__(self, bits: np.ndarray, start: np.ndarray):
        self.bits, n = bits, len(bits)
        begin = start.astype(np.int64)
        length = np.diff(np.append(begin, n))
        run = np.repeat(np.arange(len(begin)), length)
        inside = np.arange(n) - begin[run]
        depth = 1
        while len(length) and FAN**depth < length.max():
            depth += 1
        self.levels = []  # from the top: first, end (positions), shared bits, their values
        below = np.zeros(n, dtype=np.int64)
        for d in range(depth, 0, -1):
            key = inside // FAN**d
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (run[1:] != run[:-1]))) if n else below[:0]
            end = np.append(first[1:], n) if n else first
            low, high = np.bitwise_and.reduceat(bits, first), np.bitwise_or.reduceat(bits, first)
            self.levels.append((first, end, ~(low ^ high), low))
        self.run = run

    def search(self, asked: np.ndarray, top: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Links of ``asked`` patterns, each to be looked up in top node ``top``: (index in asked, first, end) position ranges."""
        for i in range(0, len(asked), ASKED):
            q = np.arange(i, min(i + ASKED, len(asked)), dtype=np.int32)
            yield from self._down(asked, q, top[i : i + ASKED], np.zeros(len(q), np.uint8), np.zeros(len(q), np.uint64), 0, radius)

    def _down(self, asked, q, node, acc, seen, level, radius):  # noqa: ANN001, PLR0913
        """One level of the walk: at most ``STATES`` states (``ASKED`` at the top), and no more below before it goes deeper."""
        first, end, shared, value = self.levels[level]
        mask = shared[node] & ~seen  # bits that no upper node has counted
        acc = acc + np.bitwise_count((asked[q] ^ value[node]) & mask)
        seen = seen | mask
        whole = acc + np.bitwise_count(~seen) <= radius
        if whole.any():
            yield q[whole], first[node[whole]], end[node[whole]]
        go = (acc <= radius) & ~whole
        del mask, whole
        q, node, acc, seen = q[go], node[go], acc[go], seen[go]
        if not len(q):
            return
        bottom = level + 1 == len(self.levels)
        if bottom:
            a, b = first[node], end[node]
        else:
            kids = self.levels[level + 1][0]
            a, b = np.searchsorted(kids, first[node]), np.searchsorted(kids, end[node])
        for part in pieces(b - a, STATES):
            at, child = members(a[part], b[part])
            if bottom:
                near = np.bitwise_count(asked[q[part]][at] ^ self.bits[child]) <= radius
                if near.any():
                    yield q[part][at[near]], child[near], child[near] + 1
            else:
                yield from self._down(asked, q[part][at], child, acc[part][at], seen[part][at], level + 1, radius)


def pieces(width: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices whose widths add up to ``most`` at most; a wider entry stands alone."""
    upto, i = np.cumsum(width), 0
    while i < len(width):
        j = max(int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, side="right")), i + 1)
        yield slice(i, j)
        i = j


def members(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, position) for every position of the ranges."""
    width = end - first
    at = np.repeat(np.arange(len(first)), width)
    return at, np.repeat(first - np.append(0, np.cumsum(width)[:-1]), width) + np.arange(len(at))


def link_runs(bits: np.ndarray, start: np.ndarray, radius: int) -> np.ndarray:
    """Root position of each position, linking inside runs."""
    tree, n = Forest(bits, start), len(bits)
    lab = np.arange(n)
    for q, first, end in tree.search(bits, tree_tops(tree), radius):
        at, member = members(first, end)
        lab = roots(n, q[at].astype(np.int64), member, lab)
    return lab


def tree_tops(tree: Forest) -> np.ndarray:
    """The top node of each position's run."""
    return np.searchsorted(tree.levels[0][0], np.arange(len(tree.bits)), side="right") - 1


OUT = "kind int, a long, b long, band int, lead int, fps array<long>, low long, high long, block long"


def gray_rank(x: F.Column) -> F.Column:
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x


def rotated(fp: F.Column, n: int, tag: int = 0) -> F.Column:
    """The bits below the first ``tag`` turned to the left by ``n``."""
    if n == 0:
        return fp
    low = (1 << (64 - tag)) - 1 if tag else -1
    x = fp.bitwiseAND(F.lit(low))
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - tag - n)).bitwiseAND(F.lit(low)).bitwiseOR(fp.bitwiseAND(F.lit(~low)))


def link(spark: SparkSession, fps: DataFrame, radius: int = RADIUS, block: int = BLOCK, bands: int | None = None, tag: int = 0) -> DataFrame:
    """(node, root) over distinct fingerprints ``fp`` that have a link; all links within ``radius`` bits.

    With fewer ``bands`` than ``radius`` + 1, those links whose ends agree on a
    band.  Fingerprints link only if their first ``tag`` bits are equal.
    """
    bands = bands or radius + 1
    turn = (64 - tag) // bands
    width = tag + turn
    turned = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("band"), rotated(F.col("fp"), k * turn, tag).alias("bits")) for k in range(bands)])).alias("t"))
    turned = turned.select("t.band", "t.bits", gray_rank(F.col("t.bits")).bitwiseXOR(F.lit(-(1 << 63))).alias("rank"))
    placed = turned.repartitionByRange("band", "rank").sortWithinPartitions("band", "rank")

    def back(bits: np.ndarray, band: np.ndarray) -> np.ndarray:
        n, low = (band * turn).astype(np.uint64), np.uint64((1 << (64 - tag)) - 1)
        x = bits & low
        return np.where(n == 0, bits, (x >> n) | (x << ((np.uint64(64 - tag) - n) & np.uint64(63))) & low | bits & ~low).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 24

        def finish(band: np.ndarray, bits: np.ndarray, ends_open: tuple[bool, bool]) -> Iterator[pa.RecordBatch]:
            nonlocal serial
            lead = (bits >> np.uint64(64 - width)).astype(np.int64)
            start = np.flatnonzero(np.append(True, (band[1:] != band[:-1]) | (lead[1:] != lead[:-1])))
            lab = link_runs(bits, start, radius)
            moved = np.flatnonzero(lab != np.arange(len(lab)))
            yield rows(a=back(bits[moved], band[moved]), b=back(bits[lab[moved]], band[moved]))
            edge = ([0] if ends_open[0] else []) + ([len(start) - 1] if ends_open[1] else [])
            for k in dict.fromkeys(edge):
                i, j = start[k], start[k + 1] if k + 1 < len(start) else len(bits)
                part = bits[i:j]
                ends = [np.bitwise_and.reduce(part), np.bitwise_or.reduce(part)]
                low, high = (np.array([x]).view(np.int64) for x in ends)
                serial += 1
                fps = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part.view(np.int64)))
                yield rows(band=[band[i]], lead=[lead[i]], fps=fps, low=low, high=high, block=[serial])

        def rows(**known: object) -> pa.RecordBatch:
            n = len(next(iter(known.values())))
            kind = 1 if "block" in known else 0
            cols = {"kind": pa.array(np.full(n, kind), pa.int32())}
            for name, of in (("a", pa.int64()), ("b", pa.int64()), ("band", pa.int32()), ("lead", pa.int32()), ("fps", pa.list_(pa.int64())), ("low", pa.int64()), ("high", pa.int64()), ("block", pa.int64())):
                x = known.get(name)
                cols[name] = pa.nulls(n, of) if x is None else x if isinstance(x, pa.Array) else pa.array(x, of)
            return pa.RecordBatch.from_pydict(cols)

        band, bits, first = np.zeros(0, np.int64), np.zeros(0, np.uint64), True
        for batch in batches:
            band = np.append(band, batch.column(0).to_numpy().astype(np.int64))
            bits = np.append(bits, batch.column(1).to_numpy().view(np.uint64))
            while len(bits) > 2 * block:
                # Cut at the last run that ends inside the block; a longer run is cut anywhere and stays open on both sides.
                lead = bits[: block + 1] >> np.uint64(64 - width)
                steps = np.flatnonzero((lead[1:] != lead[:-1]) | (band[1 : block + 1] != band[:block])) + 1
                cut = int(steps[-1]) if len(steps) else block
                yield from finish(band[:cut], bits[:cut], (first, not len(steps)))
                band, bits, first = band[cut:], bits[cut:], not len(steps)
        if len(bits):
            yield from finish(band, bits, (first, True))

    found = stored(spark, placed.select("band", "bits").mapInArrow(run, OUT), "gray")
    blocks = found.where("kind = 1").select("band", "lead", "low", "high", "block")
    other = blocks.select("band", "lead", *[F.col(c).alias(c + "2") for c in ("low", "high", "block")])
    apart = F.bit_count(F.expr("(low ^ low2) & ~(low ^ high) & ~(low2 ^ high2)"))
    pairs = blocks.join(other, ["band", "lead"]).where((F.col("block") < F.col("block2")) & (apart <= radius)).select("band", "block", "block2")
    # The pairs are names; each fetches its patterns, so the pairs of one run are searched by as many tasks as it has blocks.
    bits = found.where("kind = 1").select("block", "fps")
    pairs = pairs.join(bits, "block").join(bits.select(F.col("block").alias("block2"), F.col("fps").alias("fps2")).hint("shuffle_merge"), "block2")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (batch.column(c)[i].values.to_numpy().view(np.uint64) for c in (1, 2))
                tree, n = Forest(y, np.zeros(1, np.int64)), len(x)
                lab = np.arange(n + len(y))
                for q, first, end in tree.search(x, np.zeros(n, np.int64), radius):
                    at, member = members(first, end)
                    lab = roots(len(lab), q[at].astype(np.int64), member + n, lab)
                every = back(np.append(x, y), np.full(len(lab), batch.column(0)[i].as_py()))
                moved = np.flatnonzero(lab != np.arange(len(lab)))
                yield pa.RecordBatch.from_arrays([pa.array(every[moved]), pa.array(every[lab[moved]])], names=["u", "v"])

    edges = found.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return components(spark, edges.unionByName(pairs.select("band", "fps", "fps2").mapInArrow(cross, "u long, v long")))


def near_groups(spark: SparkSession, docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per document: _row, doc_id, fp (signed), component_id, first_row (the row that represents the component)."""
    rows = stored(spark, fingerprints(docs, words), "fingerprints")
    least = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("_row").alias("c"))
    fps = stored(spark, rows.groupBy("fp").agg(F.min(least).alias("m")), "distinct")
    linked = link(spark, fps.select("fp"), radius).withColumnRenamed("node", "fp")
    named = stored(spark, fps.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "m"), "roots")
    best = named.groupBy("root").agg(F.min("m").alias("best"))
    named = named.join(best, "root").select("fp", F.col("best.b").alias("component_id"), F.col("best.c").alias("first_row"))
    return rows.join(named, "fp").select("_row", "doc_id", "fp", "component_id", "first_row")


# --- the pipeline's stage: near copies by five-word similarity -----------------


def stage_shingles(text: bytes, words: int = STAGE_WORDS) -> np.ndarray:
    """Distinct hashes of a text's shingles, words as in ``fingerprint``; a shorter or empty text is one shingle."""
    import xxhash

    w = text.lower().split()
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, 42) for s in shingles), dtype=np.uint64))


def sketch_of(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The fingerprints of a text with these distinct shingles, in all its tables; ``seeds`` are of TABLES + MORE tables and FOLD hashes."""
    found = stage_fingerprints(hashes, seeds[:TABLES])
    if len(hashes) > SHORT:
        return found
    folded = (hashes[:, None] ^ seeds[TABLES + MORE :]).ravel()
    return np.append(found, stage_fingerprints(folded, seeds[TABLES : TABLES + MORE], TABLES))


def stage_fingerprints(hashes: np.ndarray, seeds: np.ndarray, first: int = 0) -> np.ndarray:
    """A fingerprint for each table: its number, then a bit for each place set in more than half of the hashes, mixed with the table's seed."""
    ones = np.zeros(64 * len(seeds), dtype=np.int64)
    for i in range(0, len(hashes), 1 << 10):
        h = hashes[i : i + (1 << 10), None] ^ seeds
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):
            ones += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    found = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")
    return (found >> np.uint64(TAG) | np.arange(first, first + len(seeds), dtype=np.uint64) << np.uint64(64 - TAG)).view(np.int64)


def candidates(spark: SparkSession, keys: DataFrame) -> DataFrame:
    """(a, b) with a < b, of ``keys`` (_row, doc_id, keys): rows that share a key, as spanning links.

    Rows are ordered by (key, the row's next key, hash of doc_id, row).  A row is
    linked to the first row of its key, to the first that shares both keys, and
    to the one before it with the same key.  Tasks hold ranges of that order, so
    runs may lie across them: of a task's first run only the rows are told, and
    they are linked when the tasks' outer rows (four for each task) have shown
    where the run begins.  The links don't depend on where the ranges are cut.
    """
    turn = F.transform("keys", lambda k, i: F.struct(k.alias("key"), F.get("keys", (i + 1) % F.size("keys")).alias("next")))
    order = ["key", "next", "ord", "_row"]
    placed = keys.select("_row", F.xxhash64("doc_id").alias("ord"), F.explode(turn).alias("t")).select("t.key", "t.next", "ord", "_row")
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["kind", "key", "next", "ord", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: int, key: np.ndarray, nxt: np.ndarray, ord_: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), *map(pa.array, (key, nxt, ord_, a, b))], names=names)

        last = head = begun = None  # the row before; the task's first row; the first rows of the present run of the key and of both keys
        for batch in batches:
            key, nxt, ord_, row = (c.to_numpy() for c in batch.columns)
            if not len(row):
                continue
            every = np.stack([key, nxt, ord_, row])
            fresh = last is None
            if fresh:
                head, last, begun = every[:, 0], every[:, 0], (every[:, 0], every[:, 0])
            new = np.append(key[0] != last[0], key[1:] != key[:-1])
            part = new | np.append(nxt[0] != last[1], nxt[1:] != nxt[:-1])
            at = np.arange(len(row))

            def first(starts: np.ndarray, before: np.ndarray, at: np.ndarray = at, every: np.ndarray = every) -> np.ndarray:
                since = np.maximum.accumulate(np.where(starts, at, -1))
                return np.where(since < 0, before[:, None], every[:, since])

            whole, both = first(new, begun[0]), first(part, begun[1])
            open_key = key == head[0]
            open_both = open_key & (nxt == head[1])
            prior = np.where(new, row, np.append(last[3], row[:-1]))
            pairs = np.stack([np.concatenate([whole[3][~open_key], both[3][~open_both], prior]), np.concatenate([row[~open_key], row[~open_both], row])])
            pairs = np.unique(np.sort(pairs[:, pairs[0] != pairs[1]], axis=0), axis=1)
            none = np.zeros(pairs.shape[1], np.int64)
            yield rows(0, none, none, none, pairs[0], pairs[1])
            for kind, held in ((1, open_key), (2, open_both)):
                if held.any():
                    yield rows(kind, key[held], nxt[held], ord_[held], row[held], row[held])
            last, begun = every[:, -1], (whole[:, -1], both[:, -1])
        if last is not None:
            for kind, x in ((3, head), (4, begun[0]), (4, begun[1]), (5, last)):
                yield rows(kind, x[:1], x[1:2], x[2:3], x[3:], x[3:])

    found = stored(spark, placed.mapInArrow(run, "kind int, key long, next long, ord long, a long, b long"), "bands")
    ends = found.where("kind >= 3").select("kind", "key", "next", "ord", F.col("a").alias("first"))  # four rows for each task
    of_key = ends.groupBy("key").agg(F.min(F.struct("next", "ord", "first"))["first"].alias("first"))
    of_both = ends.groupBy("key", "next").agg(F.min(F.struct("ord", "first"))["first"].alias("first"))
    by_key = found.where("kind = 1").select("key", "a").join(F.broadcast(of_key), "key").select("a", F.col("first").alias("b"))
    by_both = found.where("kind = 2").select("key", "next", "a").join(F.broadcast(of_both), ["key", "next"]).select("a", F.col("first").alias("b"))
    before = Window.orderBy("key", "next", "ord", "first", "kind")  # over two rows for each task
    over = ends.where("kind <> 4").select("kind", "key", F.col("first").alias("a"), F.lag("key").over(before).alias("k"), F.lag("first").over(before).alias("b"))
    over = over.where("kind = 3 and k = key").select("a", "b")
    links = by_key.unionByName(by_both).unionByName(over).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found.where("kind = 0").select("a", "b").unionByName(links).distinct()


def jaccard(x: list[np.ndarray], y: list[np.ndarray], part: int = 1 << 14) -> np.ndarray:
    """Similarities of two lists of sets of distinct hashes, by products of incidence matrices, ``part`` shared hashes at a time."""
    (u, at), (v, to) = ((np.concatenate(z), np.repeat(np.arange(len(z)), [len(w) for w in z])) for z in (x, y))
    both = np.intersect1d(u, v)
    shared = np.zeros((len(x), len(y)))
    for i in range(0, len(both), part):
        seen = both[i : i + part]
        marks = []
        for h, r, n in ((u, at, len(x)), (v, to, len(y))):
            k = np.minimum(np.searchsorted(seen, h), len(seen) - 1)
            hit = seen[k] == h
            m = np.zeros((n, len(seen)), np.float32)
            m[r[hit], k[hit]] = 1
            marks.append(m)
        shared += marks[0] @ marks[1].T
    size = lambda z: np.array([len(w) for w in z], float)
    return shared / (size(x)[:, None] + size(y)[None] - shared)


def links_in_runs(spark: SparkSession, keys: DataFrame, held: DataFrame, joined: DataFrame) -> DataFrame:
    """(u, v): links between the components ``joined`` (_row, root) that rows with a common key still have.

    ``candidates`` compares a row of a long run with a few others.  Here the
    rest is compared, exactly: in every run of more than three rows (fewer have
    all been compared) that holds several components, each row outside of the
    run's largest component meets all rows of other components.  So a run of
    copies of one text costs nothing, whatever its length.  Runs are cut into
    blocks in order of set size; blocks whose sizes rule out the similarity don't
    meet, and pairs of blocks are dealt to tasks.  Links are told as spanning links of components.
    """
    tagged = keys.join(joined, "_row", "left").select("_row", F.coalesce("root", "_row").alias("root"), F.explode("keys").alias("key"))
    runs = tagged.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    runs = stored(spark, runs.where("n > 3 and low <> high").select("key"), "runs")
    inside = stored(spark, tagged.join(small(runs), "key"), "inside")
    largest = inside.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    sizes = held.select("_row", F.size("s").alias("n"))
    order = ["key", "rest", "n", "_row"]
    rows = inside.join(small(stored(spark, largest, "largest")), "key").join(sizes, "_row").select("key", (F.col("root") == F.col("main")).alias("rest"), "n", "_row", "root")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial, now, total, count = TaskContext.get().partitionId() << 32, None, 0, 0
        for b in batches:
            key, rest, n, row, root = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            block = np.zeros(len(row), np.int64)
            for i, at in enumerate(zip(key.tolist(), rest.tolist(), strict=True)):
                total += int(n[i])
                count = count + 1 if at == now else RUN_ROWS + 1
                if count > RUN_ROWS or total > RUN_HASHES:
                    serial, now, total, count = serial + 1, at, int(n[i]), 1
                block[i] = serial
            yield pa.RecordBatch.from_arrays([pa.array(block), *b.columns], names=["block", *order[:3], "_row", "root"])

    cuts = stored(spark, rows.mapInArrow(cut, "block long, key long, rest boolean, n int, _row long, root long"), "cuts")
    blocks = cuts.groupBy("block").agg(F.first("key").alias("key"), F.first("rest").alias("rest"), F.min("n").alias("low"), F.max("n").alias("high"))
    blocks = stored(spark, blocks, "blocks")
    other = blocks.select("key", *[F.col(c).alias(c + "2") for c in ("block", "rest", "low", "high")])
    met = (F.col("rest2") | (F.col("block") <= F.col("block2"))) & (F.col("high") >= SIMILARITY * F.col("low2") - 1e-9) & (F.col("high2") >= SIMILARITY * F.col("low") - 1e-9)
    pairs = blocks.where("not rest").join(other, "key").where(met).select("block", "block2")
    sets = cuts.join(held, "_row").groupBy("block").agg(F.collect_list(F.struct("root", "s")).alias("x"))  # RUN_ROWS at most, RUN_HASHES or one row
    both = pairs.join(sets, "block").join(sets.select(F.col("block").alias("block2"), F.col("x").alias("y")).hint("shuffle_merge"), "block2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                sides = []
                for c in (0, 1):
                    at = b.column(c)[i].values
                    s = at.field("s")
                    flat, ends = s.values.to_numpy(), s.offsets.to_numpy()
                    sides.append((at.field("root").to_numpy(), [flat[p:q] for p, q in zip(ends, ends[1:], strict=False)]))
                (u, x), (v, y) = sides
                p, q = np.nonzero((jaccard(x, y) >= SIMILARITY - 1e-9) & (u[:, None] != v[None]))
                if len(p):
                    ends = np.unique(np.stack([np.minimum(u[p], v[q]), np.maximum(u[p], v[q])]), axis=1)
                    nodes, at = np.unique(ends, return_inverse=True)
                    at = at.reshape(ends.shape)
                    label = roots(len(nodes), at[0], at[1])
                    moved = np.flatnonzero(label != np.arange(len(nodes)))
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["u", "v"])

    return both.select("x", "y").mapInArrow(compare, "u long, v long")


def near_keys(spark: SparkSession, made: DataFrame) -> DataFrame:
    """(_row, doc_id, keys), of ``made`` (_row, doc_id, fps), for rows that share a component of a table of the index: the components' names in the order of tables."""
    each = made.select("_row", F.explode("fps").alias("fp"))
    fps = stored(spark, each.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "patterns")
    linked = link(spark, fps.select("fp"), STAGE_RADIUS, bands=BANDS, tag=TAG).withColumnRenamed("node", "fp")
    cells = fps.join(linked, "fp", "left").where("root is not null or n > 1").select("fp", F.coalesce("root", "fp").alias("key"))
    shared = each.join(small(stored(spark, cells, "cells")), "fp").groupBy("_row").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # TABLES + MORE at most
    return made.select("_row", "doc_id").join(shared, "_row")


def similar(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(_row, doc_id, root) for every row of ``docs`` with a near copy: components of pairs whose Jaccard similarity reaches ``SIMILARITY``."""
    rows = with_row_id(docs.select("doc_id", "text")).select("_row", "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    seeds = np.random.default_rng(STAGE_SEED).integers(0, 1 << 63, TABLES + MORE + FOLD, dtype=np.uint64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sketch_of(stage_shingles(t.as_py()), seeds) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64()))], names=["_row", "doc_id", "fps"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [stage_shingles(t.as_py()).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["_row", "s"])

    made = stored(spark, rows.mapInArrow(sketch, "_row long, doc_id long, fps array<long>"), "sketches")
    keys = stored(spark, near_keys(spark, made), "keys")
    pairs = stored(spark, candidates(spark, keys), "candidates")
    named = pairs.select(F.explode(F.array("a", "b")).alias("_row")).distinct()
    held = rows.select("_row", "text").join(named.hint("shuffle_hash"), "_row", "left_semi")
    held = stored(spark, held.mapInArrow(sets, "_row long, s array<long>"), "shingles")
    side = lambda a, s: held.select(F.col("_row").alias(a), F.col("s").alias(s))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    near = both.where(shared >= F.lit(SIMILARITY) * (F.size("x") + F.size("y") - shared) - 1e-9)
    first = stored(spark, components(spark, near.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "_row"), "first")
    more = stored(spark, links_in_runs(spark, keys, held, first), "more")
    merged = components(spark, more).select(F.col("node").alias("root"), F.col("root").alias("top"))
    # Rows that the second step alone has linked are components of their own before it.
    alone = merged.join(first.select("root").distinct(), "root", "left_anti").select(F.col("root").alias("_row"), F.col("top").alias("root"))
    whole = first.join(merged, "root", "left").select("_row", F.coalesce("top", "root").alias("root")).unionByName(alone)
    return whole.join(keys.select("_row", "doc_id"), "_row")


def keep(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one document, the smallest doc_id, of each component of ``similar``; ``docs`` must be a file scan."""
    groups = stored(spark, similar(spark, docs), "similar")
    least = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("_row").alias("c"))
    best = groups.groupBy("root").agg(F.min(least)["c"].alias("first_row"))
    return without(docs, stored(spark, groups.join(best, "root").where("_row <> first_row").select("_row"), "dropped"))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(spark, table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash_groups": op10_simhash_groups}
ORACLE: dict[str, str] = {}
