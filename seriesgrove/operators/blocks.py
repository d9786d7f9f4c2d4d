"""Volumes larger than a task: rows of blocks that are resampled, scaled and rotated with pieces of their neighbours.

A block row has its volume's series, size, spacing, origin and direction, the
block's number along each axis (bz, by, bx) and its float32 voxels in z, y, x
order; ``side`` voxels a side, fewer at the end.  A map takes every index of the
new grid to an index of the old one by a matrix and a shift.  Each block finds
the new blocks that need some of it, sends each just that piece, and a new block
is computed from the pieces of its region: what its voxels map to, and around
that a margin for the interpolation and the smoothing before it.  So a shuffle
moves the volume and its margins once, a task holds a region, and the result
equals that of the whole volume (for ``bspline`` up to 1e-9 of the values' range).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import splines, volumes

SIDE = 64
GRID = "series string, size array<int>, spacing array<double>, origin array<double>, direction array<double>"
BLOCK = f"{GRID}, bz int, by int, bx int, voxels binary"
PIECE = f"{GRID}, bz int, by int, bx int, old_size array<int>, low array<int>, high array<int>, map array<double>, at array<int>, voxels binary"
NAMES, PIECES = ([c.split()[0] for c in kind.split(", ")] for kind in (BLOCK, PIECE))

#: (size, spacing, origin, direction) in x, y, z to the same of the new grid, matrix and shift of the map, and the smoothing before it.
Plan = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[float, float, float]]]


def split(rows: DataFrame, side: int = SIDE) -> DataFrame:
    """Volume rows as rows of blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts(r: tuple) -> Iterator[tuple]:
            a = volumes.array_of(r.voxels, r.size)
            for z, y, x in product(*[range(0, n, side) for n in a.shape]):
                yield r.series, r.size, r.spacing, r.origin, r.direction, z // side, y // side, x // side, np.ascontiguousarray(a[z : z + side, y : y + side, x : x + side]).tobytes()

        for b in batches:
            yield from volumes.batched((p for r in b.itertuples(index=False) for p in parts(r)), NAMES)

    whole = rows.where("error is null") if "error" in rows.columns else rows
    return whole.select(*[c.split()[0] for c in GRID.split(", ")], "voxels").mapInPandas(run, BLOCK)


def merge(blocks: DataFrame, side: int = SIDE) -> DataFrame:
    """Volume rows of blocks, each of which must fit a task."""

    def one(pdf: pd.DataFrame) -> tuple:
        first = pdf.iloc[0]
        a = np.zeros(tuple(first["size"])[::-1], "<f4")
        for r in pdf.itertuples(index=False):
            z, y, x = r.bz * side, r.by * side, r.bx * side
            part = a[z : z + side, y : y + side, x : x + side]
            part[...] = np.frombuffer(r.voxels, "<f4").reshape(part.shape)
        return first["series"], first["size"], first["spacing"], first["origin"], first["direction"], a.tobytes()

    return volumes.in_groups(blocks, ["series"], one, volumes.VOLUME)


def corners(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The eight outer index points (x, y, z) of cells low to high - 1."""
    return np.array(list(product(*zip(low, high - 1, strict=True))), float)


def region(low: np.ndarray, high: np.ndarray, matrix: np.ndarray, shift: np.ndarray, margin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The old cells that the new cells low to high - 1 need."""
    p = corners(low, high) @ matrix.T + shift
    return np.clip(np.floor(p.min(axis=0)).astype(int) - margin, 0, size), np.clip(np.ceil(p.max(axis=0)).astype(int) + 1 + margin, 0, size)


def warp(blocks: DataFrame, plan: Plan, how: str = "linear", outside: float = 0.0, side: int = SIDE) -> DataFrame:
    """Blocks of the volumes on the grids of ``plan``."""
    if how not in volumes.INTERPOLATIONS:
        raise ValueError(f"the interpolation must be one of {', '.join(volumes.INTERPOLATIONS)}, not {how!r}")

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pieces(r: tuple) -> Iterator[tuple]:
            *grid, matrix, shift, sigma = plan(*[np.array(v) for v in (r.size, r.spacing, r.origin, r.direction)])
            margin = np.array([volumes.reach(s) for s in sigma]) + (splines.HALO if how == "bspline" else 2)
            told = [*np.ravel(matrix).tolist(), *np.ravel(shift).tolist(), *map(float, sigma)]
            new, old = grid[0], np.array(r.size)
            count = -(-new // side)
            low = np.array([r.bx, r.by, r.bz]) * side
            high = np.minimum(low + side, old)
            a = np.frombuffer(r.voxels, "<f4").reshape(tuple(high - low)[::-1])
            # The new blocks that may need a cell of this one, by the inverse map; the first block tells all new ones that they are there.
            p = (corners(low - margin - 1, high + margin + 1) - shift) @ np.linalg.inv(matrix).T
            first, last = np.maximum(np.floor(p.min(axis=0)).astype(int) // side, 0), np.minimum(np.ceil(p.max(axis=0)).astype(int) // side, count - 1)
            everywhere = not low.any()
            for b in product(*[range(n) if everywhere else range(i, j + 1) for n, i, j in zip(count, first, last, strict=True)]):
                start = np.array(b) * side
                lo, hi = region(start, np.minimum(start + side, new), matrix, shift, margin, old)
                i, j = np.maximum(lo, low), np.minimum(hi, high)
                some = (i < j).all()
                if some or everywhere:
                    i, j = (i, j) if some else (low, low)
                    k, m = i - low, j - low
                    piece = np.ascontiguousarray(a[k[2] : m[2], k[1] : m[1], k[0] : m[0]]).tobytes()
                    yield (r.series, *[g.tolist() for g in grid], *b[::-1], old.tolist(), lo.tolist(), hi.tolist(), told, [*i.tolist(), *j.tolist()], piece)

        for b in batches:
            yield from volumes.batched((p for r in b.itertuples(index=False) for p in pieces(r)), PIECES)

    def make(pdf: pd.DataFrame) -> tuple:
        r = pdf.iloc[0]
        low, high, old, new = (np.array(r[c]) for c in ("low", "high", "old_size", "size"))
        start = np.array([r["bx"], r["by"], r["bz"]]) * side
        end = np.minimum(start + side, new)
        shape = tuple(end - start)[::-1]
        if (low < high).all():
            a = np.zeros(tuple(high - low)[::-1], np.float32)
            for at, piece in zip(pdf["at"], pdf["voxels"], strict=True):
                i, j = np.array(at[:3]) - low, np.array(at[3:]) - low
                if (i < j).all():
                    a[i[2] : j[2], i[1] : j[1], i[0] : j[0]] = np.frombuffer(piece, "<f4").reshape(tuple(j - i)[::-1])
            told = np.array(r["map"])
            matrix, shift, sigma = told[:9].reshape(3, 3), told[9:12], tuple(told[12:])
            points = (volumes.grid(tuple(end - start)) + start) @ matrix.T + shift
            out = volumes.sample(volumes.smooth(a, sigma), points, how, outside, tuple(old), tuple(low)).reshape(shape)
        else:
            out = np.full(shape, outside)
        return *[r[c] for c in NAMES[:8]], out.astype("<f4").tobytes()

    return volumes.in_groups(blocks.mapInPandas(send, PIECE), ["series", "bz", "by", "bx"], make, BLOCK)


# --- plans ------------------------------------------------------------------------


def smoothing(scale: np.ndarray, how: str, anti_alias: bool = True) -> tuple[float, float, float]:
    return tuple(float(s) if anti_alias and how != "nearest" and s > 1 else 0.0 for s in scale)


def resample(blocks: DataFrame, spacing: tuple[float, float, float] | float, how: str = "linear", anti_alias: bool = True, side: int = SIDE) -> DataFrame:
    """``volumes.resample`` by blocks."""
    want = np.array((spacing,) * 3 if isinstance(spacing, int | float) else spacing, float)

    def plan(size, old, origin, direction):  # noqa: ANN001, ANN202
        new = np.where(want == 0, old, want)
        scale = new / old
        return np.rint(size * old / new).astype(int), new, origin, direction, np.diag(scale), np.zeros(3), smoothing(scale, how, anti_alias)

    return warp(blocks, plan, how, side=side)


def resize(blocks: DataFrame, size: tuple[int, int, int], how: str = "linear", side: int = SIDE) -> DataFrame:
    """``volumes.resize`` by blocks."""

    def plan(old, spacing, origin, direction):  # noqa: ANN001, ANN202
        new = np.where(np.array(size) == 0, old, size)
        scale = old / new
        return new, spacing * scale, origin, direction, np.diag(scale), np.zeros(3), smoothing(scale, how)

    return warp(blocks, plan, how, side=side)


def zoom(blocks: DataFrame, factor: float, how: str = "linear", side: int = SIDE) -> DataFrame:
    """``volumes.zoom`` by blocks."""

    def plan(size, spacing, origin, direction):  # noqa: ANN001, ANN202
        return size, spacing, origin, direction, np.eye(3) / factor, (size - 1) / 2 * (1 - 1 / factor), (0.0, 0.0, 0.0)

    return warp(blocks, plan, how, side=side)


def rotate(blocks: DataFrame, centre: tuple[float, float, float], angles: tuple[float, float, float], how: str = "linear", side: int = SIDE) -> DataFrame:
    """``volumes.rotate`` by blocks."""
    m = volumes.euler(angles)

    def plan(size, spacing, origin, direction):  # noqa: ANN001, ANN202
        matrix = m * spacing[None] / spacing[:, None]
        return size, spacing, origin, direction, matrix, np.array(centre) - matrix @ centre, (0.0, 0.0, 0.0)

    return warp(blocks, plan, how, side=side)
