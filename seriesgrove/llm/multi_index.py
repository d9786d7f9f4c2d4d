"""Operator 13: embedding near-dedup on an inverted multi-index.

Vectors link at a cosine of ``COSINE`` or more, computed in double precision.

1. Equal vectors become one class with a weight.
2. A sample of ``SAMPLE`` classes (those of least hash) fits the index: a codebook
   for each half of the vector, so ``k * k`` cells of about ``CELL`` classes.  The
   same sample shows balls: middles of many vectors within half of the linking
   angle.  Members of a ball are all linked to each other, so a group of near
   copies of any size is counted without being compared.
3. Every class goes to its ball or its cell.  A vector that is near enough to a
   ball to link with a member asks for that ball's members; here none is missed.
4. Classes are ordered by cell over ranges and cut into blocks of ``BLOCK``, so a
   full cell is spread over tasks.
5. A multi-sequence traversal meets the cells of the grid in the order of how far
   the vector must move to get there: a half's code i costs the squared distance
   to the plane between it and the nearest code, and the halves' sorted costs are
   merged.  It goes on to the cost within which ``TARGET`` of sample vectors that
   are turned by just the linking angle are found.  Only the vectors that visit
   a cell travel to it, bundled by block.
6. A bundle is compared with the blocks of its cell, a block with itself and with
   the others of its cell.  The visitor counts what it meets; what it meets
   counts the visitor unless it visits the visitor's cell itself.  Tasks tell
   counts and spanning links, never pairs.
7. Components of the links; counts are summed by class.

Recall is below one only where two linked vectors lie in cells that neither
visits.  Codebooks, balls and the number of visits are bounded by constants, and
index every class; the sample decides cost and recall only, never whether a pair
that was met is a link.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite
component links with nothing; vectors of different lengths never link; a row is
its own vector, so repeated rows link with each other; component_id is the
smallest non-null vec_id, null if there is none, and ``kept`` compares them with
null equal to null; an empty table gives an empty result; other columns, labels
among them, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import components, stored, table, with_row_id
from .simhash import roots

COSINE, TARGET = 0.95, 0.99
SAMPLE, CELL, CODES, ROUNDS, SEED = 1 << 13, 512, 1024, 8, 13
BALLS, BALL_LEAST = 128, 16  # at most so many, of so many sample vectors at least
BLOCK, STEP, SUMS, HEAVY = 2048, 1024, 1 << 21, 1024
CAUTION = 1e-6  # radians by which a ball's bounds are drawn in or out


# --- vectors --------------------------------------------------------------------


def by_size(sizes: np.ndarray, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their vectors as a double matrix) for each length of non-null vectors."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(sizes) - sizes
    for m in np.unique(sizes):
        rows = np.flatnonzero(sizes == m)
        yield int(m), rows, flat[begin[rows, None] + np.arange(m)]


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which rows have a direction."""
    top = np.abs(x).max(axis=1, initial=0)
    valid = np.isfinite(top) & (top > 0)
    scaled = x / np.where(valid, top, 1)[:, None]
    scaled[~valid] = 0
    return scaled / np.where(valid, np.linalg.norm(scaled, axis=1), 1)[:, None], valid


def described(rows: DataFrame) -> DataFrame:
    """(_row, vec_id, size, digest): the digest is null if the vector has no direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sizes = pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            digests = np.full(b.num_rows, None, object)
            for m, at, x in by_size(sizes, b.column(2)):
                if m:
                    valid = units(x)[1]
                    digests[at[valid]] = [xxhash.xxh3_128_digest(v.tobytes()) for v in x[valid] + 0.0]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary())], names=["_row", "vec_id", "size", "digest"])

    return rows.select("_row", "vec_id", "embedding").mapInArrow(run, "_row long, vec_id long, size int, digest binary")


# --- the index ------------------------------------------------------------------


def distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of rows and codes."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (codes * codes).sum(axis=1)[None] - 2 * x @ codes.T, 0)


def codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """At most ``k`` codes of the rows by Lloyd's rounds, along their main axis, so that near codes have near numbers."""
    codes = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = np.concatenate([distances(x[i : i + STEP], codes).argmin(axis=1) for i in range(0, len(x), STEP)])
        n = np.bincount(near, minlength=len(codes))
        total = np.zeros_like(codes)
        np.add.at(total, near, x)
        codes = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], codes)
    if len(codes) > 1 and codes.shape[1]:
        axis = np.linalg.svd(codes - codes.mean(axis=0), full_matrices=False)[2][0]
        codes = codes[np.argsort(codes @ axis, kind="stable")]
    return codes


@dataclass
class Index:
    """Codebooks of both halves, the cost up to which cells are visited, and the balls' middles, for vectors of one length."""

    first: np.ndarray
    second: np.ndarray
    most: float
    balls: np.ndarray

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return distances(x[:, :cut], self.first), distances(x[:, cut:], self.second)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row and its squared distance to the cell's codes."""
        a, b = self.halves(x)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1), a.min(axis=1) + b.min(axis=1)

    def costs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per half, the squared distance of each row to the plane between its nearest code and every other."""
        out = []
        for d, codes in zip(self.halves(x), (self.first, self.second), strict=True):
            near = d.argmin(axis=1)
            apart = np.sqrt(distances(codes, codes))[near]
            gap = (d - d.min(axis=1)[:, None]) / np.maximum(2 * apart, 1e-12)
            out.append(np.where(np.arange(len(codes)) == near[:, None], 0.0, gap * gap))
        return out[0], out[1]

    def traverse(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): the cells that each row visits, its own first, by merging the sorted costs of both halves up to ``most``."""
        costs = self.costs(x)
        order = [np.argsort(c, axis=1, kind="stable") for c in costs]
        ranked = [np.take_along_axis(c, o, axis=1) for c, o in zip(costs, order, strict=True)]
        reach = [int((c <= self.most).sum(axis=1).max(initial=1)) for c in ranked]
        step, found = max(1, SUMS // (reach[0] * reach[1])), []
        for k in range(0, len(x), step):
            total = ranked[0][k : k + step, : reach[0], None] + ranked[1][k : k + step, None, : reach[1]]
            row, i, j = np.nonzero(total <= self.most)
            by = np.lexsort((total[row, i, j], row))
            row, i, j = row[by] + k, i[by], j[by]
            found.append((row, order[0][row, i] * len(self.second) + order[1][row, j]))
        rows, cells = zip(*found, strict=True)
        return np.concatenate(rows), np.concatenate(cells)

    def calibrate(self, x: np.ndarray, cosine: float, target: float, rng: np.random.Generator) -> None:
        """Sets ``most`` so that ``target`` of the rows meet the cell of a vector turned from them by just the linking angle."""
        noise = rng.standard_normal(x.shape)
        noise -= (noise * x).sum(axis=1)[:, None] * x
        y = cosine * x + np.sqrt(1 - cosine**2) * units(noise)[0]
        at = np.arange(len(x))
        cost = sum(c[at, d.argmin(axis=1)] for c, d in zip(self.costs(x), self.halves(y), strict=True))
        self.most = float(np.quantile(cost, target, method="higher")) * (1 + 1e-9)


def find_balls(x: np.ndarray, angle: float) -> np.ndarray:
    """Middles of balls of half the ``angle`` that hold ``BALL_LEAST`` rows or more, the fullest first."""
    close, near = np.cos(angle), np.cos(angle / 2)
    left, found = np.ones(len(x), bool), []
    crowd = np.concatenate([(x[i : i + STEP] @ x.T >= near).sum(axis=1) for i in range(0, len(x), STEP)])
    for i in np.argsort(-crowd, kind="stable"):
        if crowd[i] < BALL_LEAST or len(found) == BALLS:
            break
        if not left[i]:
            continue
        middle = units(x[left & (x @ x[i] >= close)].mean(axis=0)[None])[0][0]
        inside = left & (x @ middle >= near)
        left[i] = False
        if inside.sum() >= BALL_LEAST:
            found.append(middle)
            left &= ~inside
    return np.array(found).reshape(len(found), x.shape[1])


def fit(sample: list[tuple[int, np.ndarray]], n: int, cosine: float, target: float, cell: int) -> dict[int, Index]:
    """An index for each vector length of the sample; ``n`` classes are to be indexed."""
    k, out = int(np.clip(round((n / cell) ** 0.5), 1, CODES)), {}
    for m, x in sample:
        rng = np.random.default_rng(SEED)
        cut = (m + 1) // 2
        index = Index(codebook(x[:, :cut], k, rng), codebook(x[:, cut:], k if m > 1 else 1, rng), 0.0, find_balls(x, float(np.arccos(cosine))))
        index.calibrate(x[: SAMPLE // 4], cosine, target, rng)
        out[m] = index
    return out


# --- placing, blocks, comparison ------------------------------------------------


PLACED = "node long, weight long, size int, cell long, far double"
CUT = "block long, size int, cell long, nodes array<long>, weights array<long>, vectors binary, row array<int>, visits array<long>"
BUNDLE = "size int, cell long, own long, nodes array<long>, weights array<long>, vectors binary"


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def of_length(indexes: dict[int, Index], m: int) -> Index:
    """The index of a length; one of a length that the sample lacks has one cell."""
    return indexes.get(m) or Index(np.zeros((1, (m + 1) // 2)), np.zeros((1, m // 2)), 0.0, np.zeros((0, m)))


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))


def place(vectors: DataFrame, indexes: dict[int, Index], cosine: float) -> DataFrame:
    """Every class in its cell.

    The members of a ball b are in cell -1 - b, and those that ask for it are in
    cell -1 - BALLS - b, besides the cell or ball where they are.
    """
    of = vectors.schema["embedding"].dataType.simpleString()
    angle = float(np.arccos(cosine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, weight, sizes = (b.column(i).to_numpy() for i in range(3))
            for m, at, x in by_size(sizes, b.column(3)):
                x, index = units(x)[0], of_length(indexes, m)
                for i in range(0, len(at), STEP):
                    y, who = x[i : i + STEP], at[i : i + STEP]
                    cell, far = index.cells(y)
                    parts = []
                    if len(index.balls):
                        apart = np.arccos(np.clip(y @ index.balls.T, -1, 1))
                        ball = np.where(apart.min(axis=1) <= angle / 2 - CAUTION, apart.argmin(axis=1), -1)
                        q, asked = np.nonzero((apart <= angle * 1.5 + CAUTION) & ((ball < 0)[:, None] | (ball[:, None] > np.arange(len(index.balls)))))
                        parts.append((who[q], -1 - BALLS - asked, apart[q, asked]))
                        cell = np.where(ball < 0, cell, -1 - ball)
                    for rows, c, f in [*parts, (who, cell, far)]:
                        yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(weight[rows]), pa.array(np.full(len(rows), m), pa.int32()), pa.array(c), pa.array(f), b.column(3).take(pa.array(rows))], names=[*names(PLACED), "embedding"])

    return vectors.select("node", "weight", "size", "embedding").mapInArrow(run, f"{PLACED}, embedding {of}")


def blocks(placed: DataFrame, indexes: dict[int, Index], block: int) -> DataFrame:
    """The classes of one cell in rows of ``block`` at most, with the other cells that each visits."""
    order = ["size", "cell", "far", "node"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("size", "cell", "node", "weight", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial, held, have = TaskContext.get().partitionId() << 32, [], 0

        def cut(whole: bool) -> Iterator[pa.RecordBatch]:
            """The blocks of what is held, without the last one unless ``whole``."""
            nonlocal serial, held, have
            t = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([t.column(i).to_numpy() for i in range(2)])
            new = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
            begin = [s for i, j in zip(new, [*new[1:], t.num_rows], strict=True) for s in range(i, j, block)]
            end = [*begin[1:], t.num_rows]
            done = len(begin) if whole else len(begin) - 1
            for i, j in zip(begin[:done], end[:done], strict=True):
                b = t.slice(i, j - i).combine_chunks().to_batches()[0]
                serial += 1
                size, cell, x = int(key[0, i]), int(key[1, i]), b.column(4).flatten().to_numpy()
                row, visits = np.zeros(0, np.int32), np.zeros(0, np.int64)
                if cell >= 0:
                    unit, found = units(x.astype(np.float64).reshape(j - i, size))[0], []
                    for k in range(0, j - i, STEP):
                        r, c = of_length(indexes, size).traverse(unit[k : k + STEP])
                        found.append((r[c != cell] + k, c[c != cell]))
                    row, visits = (np.concatenate(z) for z in zip(*found, strict=True))
                cols = [pa.array([serial]), b.column(0)[:1], b.column(1)[:1], lists([b.column(2).to_numpy()], pa.int64()), lists([b.column(3).to_numpy()], pa.int64()), pa.array([x.tobytes()]), lists([row.astype(np.int32)], pa.int32()), lists([visits], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=names(CUT))
            rest = t.slice(begin[done]) if done < len(begin) else None
            held = rest.to_batches() if rest is not None else []
            have = rest.num_rows if rest is not None else 0

        for b in batches:
            if b.num_rows:
                held.append(b)
                have += b.num_rows
            if have > 2 * block:
                yield from cut(False)
        if held:
            yield from cut(True)

    return ordered.mapInArrow(run, CUT)


def bundles(cut: DataFrame, single: bool) -> DataFrame:
    """The vectors of each block by the cell that they visit; what asks for a ball goes to its members."""
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                size, own = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                nodes, weights, row, visits = (b.column(k)[i].values.to_numpy() for k in (2, 3, 5, 6))
                x = np.frombuffer(b.column(4)[i].as_buffer(), kind).reshape(len(nodes), size)
                if own < 0:
                    to, who = [own + BALLS], [np.arange(len(nodes))]
                else:
                    by = np.argsort(visits, kind="stable")
                    to, first = np.unique(visits[by], return_index=True)
                    who = np.split(row[by], first[1:])
                if not len(to):
                    continue
                n = len(to)
                cols = [pa.array(np.full(n, size), pa.int32()), pa.array(np.array(to, np.int64)), pa.array(np.full(n, own), pa.int64()), lists([nodes[w] for w in who], pa.int64()), lists([weights[w] for w in who], pa.int64()), pa.array([x[w].tobytes() for w in who])]
                yield pa.RecordBatch.from_arrays(cols, names=names(BUNDLE))

    asking = cut.where(f"cell >= 0 or cell < {-BALLS}")
    return asking.select("size", "cell", "nodes", "weights", "vectors", "row", "visits").mapInArrow(run, BUNDLE)


def compare(pairs: DataFrame, cosine: float, single: bool) -> DataFrame:
    """(u, v, n): spanning links (n null) and counts of links of u (v null) of each row's visitors and block.

    ``own`` is the visitors' cell: members of the block that visit it have counted
    there.  A row without it compares two blocks of a cell; one without a second block a block with itself.
    """
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(b: pa.RecordBatch, i: int, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            nodes, weights = (b.column(c + k)[i].values.to_numpy() for k in (0, 1))
            return nodes, weights, units(np.frombuffer(b.column(c + 2)[i].as_buffer(), kind).astype(np.float64).reshape(len(nodes), -1))[0]

        for b in batches:
            for i in range(b.num_rows):
                u, wu, x = side(b, i, 1)
                same, own = not b.column(4)[i].is_valid, b.column(0)[i].as_py()
                v, wv, y = (u, wu, x) if same else side(b, i, 4)
                hits = x @ y.T >= cosine
                if same:
                    np.fill_diagonal(hits, False)
                if not hits.any():
                    continue
                p, q = np.nonzero(hits)
                label, every = roots(len(u) + len(v), p, q + len(u)), np.append(u, v)
                counts = [(u, hits @ wv)]
                if not same:
                    back = wu @ hits
                    if own is not None and own >= 0:
                        row, visits = (b.column(k)[i].values.to_numpy() for k in (7, 8))
                        back[row[visits == own]] = 0
                    counts.append((v, back))
                got = [(n[k > 0], k[k > 0]) for n, k in counts]
                moved = every != every[label]  # in one block a row and a column have one name
                left, right = every[moved], every[label[moved]]
                k = sum(len(n) for n, _ in got)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([left, *[n for n, _ in got]])), pa.concat_arrays([pa.array(right), pa.nulls(k, pa.int64())]),
                                                  pa.concat_arrays([pa.nulls(len(left), pa.int64()), pa.array(np.concatenate([c for _, c in got]).astype(np.int64))])], names=["u", "v", "n"])

    return pairs.select("own", "nodes", "weights", "vectors", "nodes2", "weights2", "vectors2", "row2", "visits2").mapInArrow(run, "u long, v long, n long")


def meetings(cut: DataFrame, single: bool) -> DataFrame:
    """What ``compare`` takes: bundles with the blocks of their cells, blocks of one cell with each other and with themselves."""
    data = cut.select("nodes", "weights", "vectors", "row", "visits")
    as_second = [F.col(c).alias(c + "2") for c in data.columns]
    columns = ["own", "nodes", "weights", "vectors", "nodes2", "weights2", "vectors2", "row2", "visits2"]
    visited = bundles(cut, single).join(cut.select("size", "cell", *as_second).where(f"cell >= {-BALLS}"), ["size", "cell"]).select(*columns)
    grid = cut.where("cell >= 0")
    named = grid.select("size", "cell", "block")
    pairs = named.join(named.withColumnRenamed("block", "block2"), ["size", "cell"]).where("block < block2").select("block", "block2")
    first, second = grid.select("block", "nodes", "weights", "vectors"), grid.select(F.col("block").alias("block2"), *as_second)
    beside = pairs.join(first, "block").join(second.hint("shuffle_merge"), "block2").withColumn("own", F.lit(None).cast("long")).select(*columns)
    none = second.where("false").drop("block2")
    alone = grid.select(F.lit(None).cast("long").alias("own"), "nodes", "weights", "vectors", *[F.lit(None).cast(t).alias(c) for c, t in none.dtypes]).select(*columns)
    return visited.unionByName(beside).unionByName(alone)


def near(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE, target: float = TARGET, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """_row, vec_id, n_links, component_id of every row of the file scan ``vectors`` (vec_id, embedding)."""
    rows = with_row_id(vectors.select("vec_id", "embedding"))
    of = rows.schema["embedding"].dataType
    single = isinstance(of, ArrayType) and isinstance(of.elementType, FloatType)
    rows = rows.withColumn("embedding", F.col("embedding").cast("array<float>" if single else "array<double>"))
    ids = stored(spark, described(rows), "described")
    classes = ids.where("digest is not null").groupBy("size", "digest").agg(F.min("_row").alias("node"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    classes = stored(spark, classes, "classes")
    n = classes.count()
    chosen = classes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("node")
    held = lambda c: rows.select(F.col("_row").alias("node"), "embedding").join(c.hint("shuffle_hash"), "node")
    sample = held(chosen).orderBy("node").select(F.size("embedding").alias("size"), "embedding").toArrow() if n else None
    drawn = [(m, units(x)[0]) for m, _, x in by_size(sample.column(0).to_numpy(), sample.column(1).combine_chunks())] if n else []
    indexes = fit(drawn, n, cosine, target, cell)
    cut = stored(spark, blocks(place(held(classes.select("node", "weight", "size")), indexes, cosine), indexes, block), "blocks")
    found = stored(spark, compare(meetings(cut, single), cosine, single), "found")

    members = cut.where(f"cell < 0 and cell >= {-BALLS}").select("size", "cell", F.explode(F.arrays_zip("nodes", "weights")).alias("m")).select("size", "cell", F.col("m.nodes").alias("node"), F.col("m.weights").alias("weight"))
    balls = members.groupBy("size", "cell").agg(F.min("node").alias("u"), F.sum("weight").alias("all"))  # no more than BALLS for each length of the sample
    members = members.join(F.broadcast(balls), ["size", "cell"])
    links = found.where("n is null").select("u", "v").unionByName(members.select("u", F.col("node").alias("v")))
    grouped = components(spark, links).withColumnRenamed("node", "_node")
    counts = found.where("n is not null").select(F.col("u").alias("node"), "n").unionByName(members.select("node", (F.col("all") - F.col("weight")).alias("n"))).groupBy("node").agg(F.sum("n").alias("n"))
    known = classes.join(grouped, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node")).drop("_node")
    known = known.join(counts, "node", "left").withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("weight") - 1)
    known = stored(spark, known.select("size", "digest", "weight", "root", "least", "n_links"), "known")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = stored(spark, known.join(least, "root").select("size", "digest", "weight", "n_links", "component_id"), "components")

    # Classes of more than one HEAVY-th of all rows are fewer than HEAVY.
    many = F.col("weight") > ids.count() // HEAVY
    key = ["size", "digest"]
    heavy = known.where(many).drop("weight").withColumnsRenamed({"n_links": "n1", "component_id": "c1"}).withColumn("is_heavy", F.lit(True))
    light = known.where(~many).drop("weight").withColumnsRenamed({"n_links": "n2", "component_id": "c2"}).withColumn("is_light", F.lit(True))
    first = ids.join(F.broadcast(heavy), key, "left")
    plain = first.where("is_heavy is null").join(light.hint("shuffle_hash"), key, "left").select(
        "_row", "vec_id", F.coalesce("n2", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("is_light"), F.col("c2")).otherwise(F.col("vec_id")).alias("component_id")
    )
    return plain.unionByName(first.where("is_heavy").select("_row", "vec_id", F.col("n1").alias("n_links"), F.col("c1").alias("component_id")))


def op13_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near(spark, table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES = {"op13_embedding_groups": op13_embedding_groups}
#: All pairs, for ids that occur once and vectors of one length; too slow for large tables.
ORACLE = {
    "op13_embedding_groups": f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, p.v FROM reach r JOIN p ON p.u = r.v),
c AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM p GROUP BY u)
SELECT c.u AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.u = c.component_id AS kept FROM c LEFT JOIN n ON n.u = c.u"""
}
