"""Shape of masks of any size: voxel rows (series, channel, z, y, x) worked on in blocks.

A voxel goes to its block of ``side`` voxels a side, and to the neighbouring
blocks that it touches, as their halo.  A task so has all neighbours of a
block's voxels, and no task has more than a block.  One shuffle of the voxels
serves

* components: voxels that share faces are labelled inside a block; pairs of
  labels that meet at block faces are the edges of a small graph, which is
  contracted in Spark (``graph.contract``);
* intercepts: along each of 13 directions, the voxels whose predecessor is not
  in the mask, that is the number of runs; the mask's surface is estimated from
  their sums;
* moments: sums and products of the coordinates, from which Spark's functions
  give the principal axes.

Coordinates are 0 to 2 ** 21 - 1.  A component's name is the place of its first
voxel in z, y, x order, as one number (``place``).  Repeated voxels count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .graph import contract

SIDE = 48
CELLS = 1 << 21  # of blocks with halo that are worked on at once
KEYS = ["series", "channel"]
#: The 13 directions to half of a voxel's 26 neighbours, as x, y, z.
DIRECTIONS = [(x, y, z) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (z, y, x) > (0, 0, 0)]
#: The share of the unit sphere nearest to a direction and its opposite, for neighbours by face, edge and corner.
SHARES = (2 * 0.04577789120476, 2 * 0.03698062787608, 2 * 0.03519563978232)
#: A principal moment of a smaller share of their sum counts as zero; the solution of the cubic is no more exact.
FLAT = 1e-6
COMPONENT, BELOW, ABOVE, VOXEL, FACTS = range(5)
OUT = "series string, channel int, kind int, axis int, place long, label long, facts array<long>"


def place(z: Any, y: Any, x: Any) -> Any:  # noqa: ANN401
    return (z << 42) | (y << 21) | x


def coordinates(name: str) -> list[Column]:
    """z, y and x of a place."""
    return [F.shiftright(name, 42).alias("z"), F.shiftright(name, 21).bitwiseAND((1 << 21) - 1).alias("y"), F.col(name).bitwiseAND((1 << 21) - 1).alias("x")]


def in_blocks(mask: DataFrame, side: int) -> DataFrame:
    """The voxels with their block (bz, by, bx) and those of the blocks that they touch."""
    rows = mask.select(F.col("series").cast("string").alias("series"), F.col("channel").cast("int").alias("channel"), *[F.col(c).cast("int").alias(c) for c in "zyx"])
    for c in "zyx":
        at = lambda d, c=c: F.floor((F.col(c) + d) / side).cast("int")
        rows = rows.withColumn("b" + c, F.explode(F.array_distinct(F.array(at(-1), at(0), at(1)))))
    return rows


def label(solid: np.ndarray) -> np.ndarray:
    """Of each true cell, in order, the number of the first one that is linked to it by faces, along the last three axes."""
    at = np.full(solid.shape, -1, np.int64)
    n = int(solid.sum())
    at[solid] = np.arange(n)
    a, b = [], []
    for axis in range(solid.ndim - 3, solid.ndim):
        low, high = ([slice(None)] * solid.ndim for _ in range(2))
        low[axis], high[axis] = slice(None, -1), slice(1, None)
        both = solid[tuple(low)] & solid[tuple(high)]
        a.append(at[tuple(low)][both])
        b.append(at[tuple(high)][both])
    a, b, root = np.concatenate(a), np.concatenate(b), np.arange(n)
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def facts_of(g: np.ndarray, at: np.ndarray, low: np.ndarray, side: int, voxels: bool) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Of many blocks that begin at ``low``, from their own and halo voxels ``at`` (z, y, x) of blocks ``g``: the blocks with own voxels, their sums, and (kind, axis, blocks, places, labels): components, voxels met at faces, and all voxels if asked."""
    solid = np.zeros((len(low), *(side + 2,) * 3), bool)
    solid[(g, *(at - low[g] + 1).T)] = True
    own = solid[:, 1:-1, 1:-1, 1:-1]
    cell = np.argwhere(own)
    g, p = cell[:, 0], cell[:, 1:] + low[cell[:, 0]]
    named, first = place(p[:, 0], p[:, 1], p[:, 2]), label(own)
    labels = named[first]
    held, begin, n = np.unique(g, return_index=True, return_counts=True)
    runs = [(own & ~solid[(slice(None), *(slice(1 - d, 1 - d + side) for d in direction[::-1]))]).sum(axis=(1, 2, 3))[held] for direction in DIRECTIONS]
    products = [p[:, i] * p[:, j] for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))]
    sums = np.stack([*runs, n, *(np.add.reduceat(x, begin) if len(begin) else x for x in (*p.T, *products))], axis=1)
    top = first == np.arange(len(first))
    parts = [(COMPONENT, -1, g[top], named[top], named[top])]
    whole = np.full(own.shape, -1, np.int64)
    whole[own] = labels
    for axis in range(3):
        for kind, edge, beyond in ((BELOW, side - 1, side + 1), (ABOVE, 0, 0)):
            face, other = np.take(whole, edge, axis + 1), np.take(solid[(slice(None), *(slice(None) if i == axis else slice(1, -1) for i in range(3)))], beyond, axis + 1)
            met = np.argwhere((face >= 0) & other)
            where = np.insert(met[:, 1:], axis, edge, axis=1) + low[met[:, 0]]
            parts.append((kind, axis, met[:, 0], place(where[:, 0], where[:, 1], where[:, 2]) + ((1 << 21 * (2 - axis)) if kind == BELOW else 0), face[tuple(met.T)]))
    if voxels:
        parts.append((VOXEL, -1, g, named, labels))
    return held, sums, parts


def worker(side: int, voxels: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """OUT rows of blocks whose voxels (series, channel, bz, by, bx, z, y, x) stand together; blocks of ``CELLS`` cells in all are worked on at once."""
    names = [c.split()[0] for c in OUT.split(", ")]
    most = max(1, CELLS // (side + 2) ** 3)

    def work(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(starts) - 1, most):
            ends = starts[i : i + most + 1]
            yield from together(t.slice(ends[0], ends[-1] - ends[0]), ends - ends[0])

    def together(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        series, channel = t.column(0).take(pa.array(starts[:-1])).combine_chunks(), t.column(1).to_numpy()[starts[:-1]]
        block, at = (np.stack([t.column(i).to_numpy() for i in of], axis=1).astype(np.int64) for of in ((2, 3, 4), (5, 6, 7)))
        held, sums, parts = facts_of(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), at, block[starts[:-1]] * side, side, voxels)
        if not len(held):
            return
        n = [len(x[2]) for x in parts]
        g, places, labels = (np.concatenate([x[k] for x in parts]) for k in (2, 3, 4))
        kind, axis = (np.repeat([x[k] for x in parts], n) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([series.take(pa.array(g)), pa.array(channel[g], pa.int32()), pa.array(kind, pa.int32()), pa.array(axis, pa.int32()), pa.array(places), pa.array(labels), pa.nulls(len(g), pa.list_(pa.int64()))], names=names)
        zero, none = pa.array(np.zeros(len(held), np.int64)), pa.array(np.full(len(held), -1), pa.int32())
        facts = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
        yield pa.RecordBatch.from_arrays([series.take(pa.array(held)), pa.array(channel[held], pa.int32()), pa.array(np.full(len(held), FACTS), pa.int32()), none, zero, zero, facts], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])]).combine_chunks()
            if t.num_rows < 2:
                rest = t
                continue
            new = np.zeros(t.num_rows - 1, bool)
            for i in range(5):
                c = t.column(i).combine_chunks()
                new |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            starts = np.append(0, np.flatnonzero(new) + 1)
            if len(starts) > 1:
                yield from work(t, starts)
            rest = t.slice(starts[-1]).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from work(rest, np.array([0, rest.num_rows]))

    return run


class Shapes:
    """Components, intercepts and moments of every (series, channel) of ``mask``."""

    def __init__(self, mask: DataFrame, side: int = SIDE, voxels: bool = False):
        self.spark = mask.sparkSession
        block = [*KEYS, "bz", "by", "bx"]
        rows = in_blocks(mask, side).select(*block, "z", "y", "x").repartition(*block).sortWithinPartitions(*block)
        self.parts = stored(self.spark, rows.mapInArrow(worker(side, voxels), OUT), "blocks")
        self.rounds = 0

    def _of(self, kind: int) -> DataFrame:
        return self.parts.where(F.col("kind") == kind)

    def names(self) -> DataFrame:
        """(series, channel, label, component) of the labels of all blocks."""
        low = self._of(BELOW).select(*KEYS, "axis", "place", F.col("label").alias("u"))
        high = self._of(ABOVE).select(*KEYS, "axis", "place", F.col("label").alias("v"))
        edges = low.join(high, [*KEYS, "axis", "place"]).select(*KEYS, "u", "v")
        roots, self.rounds = contract(self.spark, edges, KEYS)
        least = roots.groupBy(*KEYS, "root").agg(F.least(F.min("node"), F.col("root")).alias("component"))
        named = roots.join(least, [*KEYS, "root"]).select(*KEYS, F.col("node").alias("label"), "component")
        return self._of(COMPONENT).select(*KEYS, "label").join(named, [*KEYS, "label"], "left").withColumn("component", F.coalesce("component", "label"))

    def count(self) -> DataFrame:
        """(series, channel, n_components)."""
        first = self.names().where("label = component")
        return first.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_components"))

    def labelled(self) -> DataFrame:
        """(series, channel, z, y, x, component) of every voxel; needs ``voxels``."""
        return self._of(VOXEL).join(self.names(), [*KEYS, "label"]).select(*KEYS, *coordinates("place"), "component")

    def sums(self) -> DataFrame:
        """(series, channel, runs by direction, n, moments)."""
        rows = self._of(FACTS)
        n = len(DIRECTIONS)
        fields = ["n", "sz", "sy", "sx", "szz", "syy", "sxx", "szy", "szx", "syx"]
        cols = [F.sum(F.get("facts", F.lit(i))).alias(f"r{i}") for i in range(n)] + [F.sum(F.get("facts", F.lit(n + i))).alias(c) for i, c in enumerate(fields)]
        return rows.groupBy(*KEYS).agg(*cols).withColumn("runs", F.array(*[f"r{i}" for i in range(n)])).drop(*[f"r{i}" for i in range(n)])

    def statistics(self, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
        """n_voxels, runs, volume, perimeter, the radius and perimeter of the sphere of equal volume, roundness, principal moments, elongation, flatness and the diameters of the ellipsoid of equal moments."""
        rows = self.sums()
        volume = F.col("n") * float(np.prod(spacing))
        radius = F.cbrt(volume * 3 / (4 * np.pi))
        rows = rows.select(*KEYS, F.col("n").alias("n_voxels"), "runs", volume.alias("volume"), perimeter(F.col("runs"), spacing).alias("perimeter"), radius.alias("spherical_radius"), (radius * radius * 4 * np.pi).alias("spherical_perimeter"),
                           principal(spacing).alias("moments"))
        low, middle, high = (F.get("moments", F.lit(i)) for i in range(3))
        least = (low + middle + high) * FLAT
        ratio = lambda a, b: F.when(b > least, F.sqrt(a / b)).otherwise(0.0)
        unit = F.when(low > least, F.cbrt(F.col("volume") * 6 / np.pi / F.sqrt(low * middle * high))).otherwise(0.0)
        return rows.select(
            *rows.columns,
            (F.col("spherical_perimeter") / F.col("perimeter")).alias("roundness"),
            ratio(high, middle).alias("elongation"),
            ratio(middle, low).alias("flatness"),
            F.transform("moments", lambda m: unit * F.sqrt(m)).alias("diameters"),
        )


def perimeter(runs: Column, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Column:
    """The surface by Crofton's formula: lines of all directions cross it in proportion to its area.

    A run has two borders; lines of a direction lie a voxel's volume by the step
    along it apart; each direction stands for its share of the sphere.
    """
    total, volume = F.lit(0.0), float(np.prod(spacing))
    for i, d in enumerate(DIRECTIONS):
        step = float(np.linalg.norm(np.array(d) * spacing))
        total = total + F.get(runs, F.lit(i)) * (4 * volume / step * SHARES[sum(map(abs, d)) - 1])
    return total


def principal(spacing: tuple[float, float, float]) -> Column:
    """The covariance of the voxels' places as its three eigenvalues in ascending order, from the trigonometric solution of its cubic."""
    scale = dict(zip("xyz", spacing, strict=True))
    n = F.col("n").cast("double")

    def c(a: str, b: str) -> Column:
        return (F.col(f"s{a}{b}") / n - F.col(f"s{a}") / n * (F.col(f"s{b}") / n)) * (scale[a] * scale[b])

    zz, yy, xx, zy, zx, yx = (c(*p) for p in ("zz", "yy", "xx", "zy", "zx", "yx"))
    m = (xx + yy + zz) / 3
    spread = F.sqrt(F.greatest(((xx - m) * (xx - m) + (yy - m) * (yy - m) + (zz - m) * (zz - m) + 2 * (zy * zy + zx * zx + yx * yx)) / 6, F.lit(0.0)))
    a, b, d = xx - m, yy - m, zz - m
    det = a * (b * d - zy * zy) - yx * (yx * d - zy * zx) + zx * (yx * zy - b * zx)
    half = F.when(spread > 1e-12, F.greatest(F.least(det / (2 * spread * spread * spread), F.lit(1.0)), F.lit(-1.0))).otherwise(1.0)
    angle = F.acos(half) / 3
    high, low = m + 2 * spread * F.cos(angle), m + 2 * spread * F.cos(angle + 2 * np.pi / 3)
    return F.transform(F.array(low, 3 * m - high - low, high), lambda v: F.greatest(v, F.lit(0.0)))
