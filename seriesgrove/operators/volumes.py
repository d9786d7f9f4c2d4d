"""Dense volumes in rows: packing, resampling, rotation, contours, shape statistics.

A volume row has size, spacing, origin, direction (row-major) and float32 voxels
in z, y, x order, and any other columns.  One volume is one row; tasks pass
volumes on in batches of ``BATCH_BYTES`` at most, or one volume.  A volume that
a function fails on keeps its row, with ``error`` set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import spread
from . import splines

VOLUME = "series string, size array<int>, spacing array<double>, origin array<double>, direction array<double>, voxels binary"
IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
BATCH_BYTES = 32 << 20
BATCH_ROWS = 1 << 10
BATCH_VOXELS = 1 << 16  # rows of voxels that a task passes on together
INTERPOLATIONS = ("nearest", "linear", "bspline")


def array_of(voxels: bytes, size: list[int]) -> np.ndarray:
    return np.frombuffer(voxels, "<f4").reshape(tuple(size)[::-1])


def batched(rows: Iterable[tuple], names: list[str], weigh: Callable[[tuple], int] | None = None) -> Iterator[pd.DataFrame]:
    """Data frames of ``BATCH_ROWS`` rows at most whose ``voxels`` or ``content``, or what ``weigh`` gives, add up to ``BATCH_BYTES`` at most, one row at least."""
    at = [i for i, n in enumerate(names) if n in ("voxels", "content")]
    held, size = [], 0
    for r in rows:
        mine = weigh(r) if weigh else sum(len(r[i]) for i in at if isinstance(r[i], bytes))
        if held and (size + mine > BATCH_BYTES or len(held) == BATCH_ROWS):
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
        held.append(r)
        size += mine
    if held:
        yield pd.DataFrame(held, columns=names)


def pack(rows: DataFrame, key: str, values: str, size: tuple[int, int, int], spacing: tuple = (1.0, 1.0, 1.0)) -> DataFrame:
    """Volume rows of flat arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = ((str(k), list(size), list(spacing), [0.0] * 3, list(IDENTITY), np.asarray(v, "<f4").tobytes()) for k, v in zip(b[key], b[values], strict=True))
            yield from batched(made, ["series", "size", "spacing", "origin", "direction", "voxels"])

    return rows.select(key, values).mapInPandas(run, VOLUME)


def in_groups(rows: DataFrame, keys: list[str], f: Callable[[pd.DataFrame], tuple], kind: str) -> DataFrame:
    """The row f(group) of every group of ``keys``, which hold no null numbers.

    Groups are dealt as by ``spread`` and stand together in a task, which holds a
    batch and one group: a small group costs neither an Arrow stream nor a result
    batch of its own.
    """
    names = [c.split()[0] for c in kind.replace("map<string,string>", "map").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def groups() -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []  # parts of the group that may go on
            whole = lambda: held[0] if len(held) == 1 else pd.concat(held)
            for b in batches:
                if not len(b):
                    continue
                new = np.zeros(len(b), bool)
                for k in keys:
                    v = b[k].to_numpy()
                    new[1:] |= v[1:] != v[:-1]
                    new[0] |= bool(held) and held[-1][k].iloc[-1] != v[0]
                at = [*np.flatnonzero(new).tolist(), len(b)]
                if at[0]:
                    held.append(b.iloc[: at[0]])
                for i, j in zip(at, at[1:], strict=False):
                    if held:
                        yield whole()
                    held = [b.iloc[i:j]]
            if held:
                yield whole()

        yield from batched((f(g) for g in groups()), names)

    return spread(rows, *keys).sortWithinPartitions(*keys).mapInPandas(run, kind)


def map_rows(rows: DataFrame, f: Callable[[dict], dict], kind: str = "TransformError") -> DataFrame:
    """Replaces columns of every volume row without an error by what f(row) gives; what f raises becomes the row's ``error``."""
    if "error" not in rows.columns:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each(b: pd.DataFrame) -> Iterator[tuple]:
            for r in b.itertuples(index=False):
                row = dict(zip(names, r, strict=True))
                if not isinstance(row["error"], str):
                    try:
                        row = row | f(row)
                    except Exception as e:  # noqa: BLE001  a bad volume is data here
                        row["error"] = f"{kind}: {type(e).__name__}: {e}"
                yield tuple(row[n] for n in names)

        for b in batches:
            yield from batched(each(b), names)

    return rows.mapInPandas(run, T.StructType(rows.schema.fields))


def map_volumes(rows: DataFrame, f: Callable[[np.ndarray, tuple, tuple], tuple[np.ndarray, tuple, tuple]]) -> DataFrame:
    """Applies f(array, spacing, origin) to every volume: the hook for user transforms."""

    def one(r: dict) -> dict:
        a, spacing, origin = f(array_of(r["voxels"], r["size"]), tuple(r["spacing"]), tuple(r["origin"]))
        return {"size": list(a.shape[::-1]), "spacing": [float(x) for x in spacing], "origin": [float(x) for x in origin], "voxels": a.astype("<f4").tobytes()}

    return map_rows(rows, one)


def map_images(rows: DataFrame, f: Callable[..., np.ndarray], *, keep_geometry: bool = True, **options: object) -> DataFrame:
    """Applies any callable(array, **options) that gives an array; unless ``keep_geometry`` the grid becomes the unit grid."""

    def call(a: np.ndarray, spacing: tuple, origin: tuple) -> tuple[np.ndarray, tuple, tuple]:
        out = np.asarray(f(a, **options))
        if keep_geometry and out.shape != a.shape:
            raise ValueError("the result has another size, so the geometry can't be kept")
        return (out, spacing, origin) if keep_geometry else (out, (1.0,) * 3, (0.0,) * 3)

    return map_volumes(rows, call)


def _kernel(sigma: float) -> np.ndarray:
    r = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return k / k.sum()


def reach(sigma: float) -> int:
    """How far a smoothing looks."""
    return len(_kernel(sigma)) // 2 if sigma > 0 else 0


def smooth(a: np.ndarray, sigma: tuple[float, float, float]) -> np.ndarray:
    """Gaussian along x, y, z with the edge value continued; 0 leaves an axis."""
    for axis, s in zip((2, 1, 0), sigma, strict=True):
        if s > 0:
            k = _kernel(s)
            r = len(k) // 2
            p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in range(3)], mode="edge")
            a = np.apply_along_axis(lambda v, k=k: np.convolve(v, k, mode="valid"), axis, p)
    return a


def sample(a: np.ndarray, points: np.ndarray, how: str = "linear", outside: float = 0.0, size: tuple[int, int, int] | None = None, start: tuple[int, int, int] = (0, 0, 0)) -> np.ndarray:
    """Values at (n, 3) index points in x, y, z by ``nearest``, ``linear`` or ``bspline`` (cubic); points outside the grid give ``outside``.

    ``a`` may be the part of a grid of ``size`` that begins at ``start``; it must
    hold what lies about the points, for ``bspline`` ``splines.HALO`` voxels more.
    """
    if how not in INTERPOLATIONS:
        raise ValueError(f"the interpolation must be one of {', '.join(INTERPOLATIONS)}, not {how!r}")
    whole, begin = np.array(size or a.shape[::-1]), np.array(start)
    inside = ((points >= -0.5) & (points <= whole - 0.5)).all(axis=1)
    if how == "bspline":
        out = np.full(len(points), float(outside))
        if inside.any():
            out[inside] = splines.evaluate(splines.coefficients(a), points[inside] - begin)
        return out
    part = np.array(a.shape[::-1])
    p = np.clip(np.clip(points, 0, whole - 1) - begin, 0, part - 1)
    if how == "nearest":
        i = np.minimum(np.floor(p + 0.5).astype(int), part - 1)
        return np.where(inside, a[i[:, 2], i[:, 1], i[:, 0]], outside)
    low = np.minimum(np.floor(p).astype(int), np.maximum(part - 2, 0))
    t, high = p - low, np.minimum(low + 1, part - 1)
    out = np.zeros(len(p))
    for dx in (0, 1):
        for dy in (0, 1):
            for dz in (0, 1):
                w = np.prod([t[:, k] if d else 1 - t[:, k] for k, d in enumerate((dx, dy, dz))], axis=0)
                i = [(high if d else low)[:, k] for k, d in enumerate((dx, dy, dz))]
                out += w * a[i[2], i[1], i[0]]
    return np.where(inside, out, outside)


def grid(size: tuple[int, int, int]) -> np.ndarray:
    z, y, x = np.meshgrid(*[np.arange(n) for n in size[::-1]], indexing="ij")
    return np.stack([x.ravel(), y.ravel(), z.ravel()], axis=1).astype(float)


def resample(rows: DataFrame, spacing: tuple[float, float, float] | float, how: str = "linear", anti_alias: bool = True) -> DataFrame:
    """To a new spacing (0 keeps an axis); smooths first where it gets coarser."""
    want = (spacing,) * 3 if isinstance(spacing, int | float) else tuple(spacing)

    def f(a: np.ndarray, old: tuple, origin: tuple):  # noqa: ANN202
        new = tuple(o if w == 0 else w for o, w in zip(old, want, strict=True))
        size = tuple(int(np.rint(n * o / w)) for n, o, w in zip(a.shape[::-1], old, new, strict=True))
        scale = np.array(new) / np.array(old)
        if anti_alias and how != "nearest" and (scale > 1).any():
            a = smooth(a, tuple(s if s > 1 else 0 for s in scale))
        return sample(a, grid(size) * scale, how).reshape(size[::-1]), new, origin

    return map_volumes(rows, f)


def resize(rows: DataFrame, size: tuple[int, int, int], how: str = "linear") -> DataFrame:
    def f(a: np.ndarray, old: tuple, origin: tuple):  # noqa: ANN202
        want = tuple(n if s == 0 else s for n, s in zip(a.shape[::-1], size, strict=True))
        scale = np.array(a.shape[::-1]) / np.array(want)
        b = smooth(a, tuple(s if s > 1 else 0 for s in scale)) if how != "nearest" else a
        return sample(b, grid(want) * scale, how).reshape(want[::-1]), tuple(np.array(old) * scale), origin

    return map_volumes(rows, f)


def zoom(rows: DataFrame, factor: float, how: str = "linear") -> DataFrame:
    """Scales about the centre on the same grid."""

    def f(a: np.ndarray, spacing: tuple, origin: tuple):  # noqa: ANN202
        size = a.shape[::-1]
        centre = (np.array(size) - 1) / 2
        return sample(a, (grid(size) - centre) / factor + centre, how).reshape(a.shape), spacing, origin

    return map_volumes(rows, f)


def euler(angles: tuple[float, float, float]) -> np.ndarray:
    """The rotation about x, y, z by ``angles``: y first, then x, then z."""
    (cx, cy, cz), (sx, sy, sz) = np.cos(angles), np.sin(angles)
    return np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]]) @ np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]]) @ np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]])


def rotate(rows: DataFrame, centre: tuple[float, float, float], angles: tuple[float, float, float], how: str = "linear") -> DataFrame:
    """Euler rotation (radians about x, y, z) about an index."""
    m = euler(angles)

    def f(a: np.ndarray, spacing: tuple, origin: tuple):  # noqa: ANN202
        s = np.array(spacing)
        p = (grid(a.shape[::-1]) - centre) * s
        return sample(a, (p @ m.T) / s + centre, how).reshape(a.shape), spacing, origin

    return map_volumes(rows, f)


def summarise(rows: DataFrame) -> DataFrame:
    """series, nx, ny, nz, v_min, v_max, v_mean of the volumes without an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a = [array_of(v, s) for v, s in zip(b["voxels"], b["size"], strict=True)]
            n = np.array([x.shape[::-1] for x in a]).reshape(-1, 3)
            stat = lambda f: [round(float(f(x, dtype=np.float64) if f is np.mean else f(x)), 4) for x in a]  # noqa: B023, E731
            yield pd.DataFrame({"series": b["series"], "nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2], "v_min": stat(np.min), "v_max": stat(np.max), "v_mean": stat(np.mean)})

    whole = rows.where("error is null") if "error" in rows.columns else rows
    return whole.select("series", "size", "voxels").mapInPandas(run, "series string, nx int, ny int, nz int, v_min double, v_max double, v_mean double")


def fingerprint(rows: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Per volume: hash, size, n_voxels, spacing, origin, direction, dtype and min, max, sum, mean, std, variance (sample) of the values, and the columns ``also``; dense, without a row per voxel."""
    kept = [c for c in ("sample_number", "series", "sub_series", "modality", "image_id") if c in rows.columns] + list(also)
    stats = "v_min double, v_max double, v_sum double, v_mean double, v_std double, v_var double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[[*kept, "size", "spacing", "origin", "direction", "hash", "n_voxels", "dtype"]].copy()
            a = [np.frombuffer(v, "<f4").astype(np.float64) for v in b["voxels"]]
            some = lambda f, least=1: [float(f(x)) if len(x) >= least else None for x in a]  # noqa: B023, E731
            out["v_min"], out["v_max"], out["v_sum"], out["v_mean"] = some(np.min), some(np.max), some(np.sum), some(np.mean)
            out["v_std"], out["v_var"] = some(lambda x: np.std(x, ddof=1), 2), some(lambda x: np.var(x, ddof=1), 2)
            yield out

    whole = rows.where("error is null") if "error" in rows.columns else rows
    n = F.aggregate("size", F.lit(1).cast("long"), lambda acc, x: acc * x)
    whole = whole.select(*kept, "size", "spacing", "origin", "direction", F.sha1("voxels").alias("hash"), n.alias("n_voxels"), F.lit("float32").alias("dtype"), "voxels")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.drop("voxels").schema)
    return whole.mapInPandas(run, f"{kinds}, {stats}")


# --- geometry -------------------------------------------------------------------


def geometry(rows: DataFrame) -> Column:
    """size, origin, spacing and direction of a volume row as one struct."""
    return F.struct("size", "origin", "spacing", "direction")


def to_index(points: np.ndarray, origin: list[float], spacing: list[float], direction: list[float], continuous: bool = False) -> np.ndarray:
    """Index points (x, y, z) of physical points, rounded half up unless ``continuous``."""
    at = np.linalg.solve(np.array(direction, float).reshape(3, 3), (points - np.array(origin, float)).T).T / np.array(spacing, float)
    return at if continuous else np.floor(at + 0.5)


def to_physical(index: np.ndarray, origin: list[float], spacing: list[float], direction: list[float]) -> np.ndarray:
    return np.asarray(index, float) * np.array(spacing, float) @ np.array(direction, float).reshape(3, 3).T + np.array(origin, float)


def crop_box(rows: DataFrame, low: str = "box_min", high: str = "box_max") -> DataFrame:
    """Crops every volume to the box in its columns (x, y, z arrays, maximum exclusive); the origin moves to the box's minimum.

    A box that leaves the image is an error in the row.
    """

    def one(r: dict) -> dict:
        a, lo, hi = array_of(r["voxels"], r["size"]), [int(v) for v in r[low]], [int(v) for v in r[high]]
        if any(not 0 <= i < j <= n for i, j, n in zip(lo, hi, r["size"], strict=True)):
            raise ValueError(f"box {lo} to {hi} leaves the image of size {list(r['size'])}")
        out = a[lo[2] : hi[2], lo[1] : hi[1], lo[0] : hi[0]]
        return {"size": list(out.shape[::-1]), "origin": to_physical(np.array(lo), r["origin"], r["spacing"], r["direction"]).tolist(), "voxels": np.ascontiguousarray(out).tobytes()}

    return map_rows(rows, one, "CropError")


def like(rows: DataFrame, how: str = "linear", outside: float = 0.0, ref: str = "ref") -> DataFrame:
    """Resamples every volume to the grid in its struct column ``ref`` (as ``geometry`` makes it); null leaves it as it is."""

    def one(r: dict) -> dict:
        g = r[ref]
        if g is None:
            return {}
        g = g if isinstance(g, dict) else g.asDict() if hasattr(g, "asDict") else dict(zip(("size", "origin", "spacing", "direction"), g, strict=True))
        points = to_physical(grid(tuple(g["size"])), g["origin"], g["spacing"], g["direction"])
        at = to_index(points, r["origin"], r["spacing"], r["direction"], continuous=True)
        mode = "nearest" if r.get("kind") == "mask" else how
        a = sample(array_of(r["voxels"], r["size"]), at, mode, outside).reshape(tuple(g["size"])[::-1])
        return {k: list(g[k]) for k in ("size", "origin", "spacing", "direction")} | {"voxels": a.astype("<f4").tobytes()}

    return map_rows(rows, one)


def bias_correct(rows: DataFrame, levels: int = 4, rounds: int = 50, bins: int = 200) -> DataFrame:
    """Removes a smooth multiplicative field from MR volumes; others, and volumes without positive values, stay as they are.

    By N4: the log-intensity histogram is sharpened by deconvolution, and a cubic
    B-spline fitted to the differences to the sharpened values is taken off, again
    and again, until the field hardly changes; every level has twice the spline's
    pieces along each axis.
    """

    def one(r: dict) -> dict:
        if "modality" in r and r["modality"] != "MR":
            return {}
        a = array_of(r["voxels"], r["size"]).astype(np.float64)
        inside = a > 0
        if not inside.any():
            return {}
        return {"voxels": np.where(inside, a / np.exp(bias_field(np.log(np.where(inside, a, 1)), inside, levels, rounds, bins)), a).astype("<f4").tobytes()}

    return map_rows(rows, one)


def bias_field(log: np.ndarray, inside: np.ndarray, levels: int = 4, rounds: int = 50, bins: int = 200, threshold: float = 1e-3) -> np.ndarray:
    """The smooth part of log intensities, with mean 0 inside; a level ends when the field's ratio to the one before varies by less than ``threshold``."""
    spans, field = (1, 1, 1), np.zeros(log.shape)
    for level in range(levels):
        if level:
            spans = tuple(2 * s for s in spans)
        total = splines.asked_weights(inside, spans)
        for _ in range(rounds):
            left = log - field
            step = splines.surface(splines.approximate(left - sharpened(left, inside, bins), inside, spans, total), log.shape)
            field = field + step  # the splines of a level hold those of the level before, so their sum is one
            change = np.exp(step[inside])
            if change.std() <= threshold * change.mean():
                break
    return field - field[inside].mean()


def sharpened(v: np.ndarray, inside: np.ndarray, bins: int, width: float = 0.15, noise: float = 0.01) -> np.ndarray:
    """The expected value of each voxel before a blur of the histogram by a Gaussian of full width ``width``."""
    low, high = v[inside].min(), v[inside].max()
    if high - low < 1e-9:
        return v
    step = (high - low) / (bins - 1)
    n = 2 * bins
    count = np.bincount(((v[inside] - low) / step + 0.5).astype(np.int64), minlength=bins)[:bins].astype(float)
    at = np.minimum(np.arange(n), n - np.arange(n)) * step
    blur = np.exp(-4 * np.log(2) * (at / width) ** 2)
    f = np.fft.rfft(blur / blur.sum())
    sharp = np.fft.irfft(np.fft.rfft(count, n) * np.conj(f) / (np.abs(f) ** 2 + noise), n).clip(0)
    centre = low + np.arange(n) * step
    centre[bins + bins // 2 :] -= n * step  # positions below the least bin
    up = np.fft.irfft(np.fft.rfft(sharp * centre) * f, n)
    down = np.fft.irfft(np.fft.rfft(sharp) * f, n)
    expected = np.where(down > 1e-9 * max(down.max(), 1e-300), up / np.where(down == 0, 1, down), centre)[:bins]
    return np.interp(v, low + np.arange(bins) * step, expected)


# --- contours -------------------------------------------------------------------


def fill_polygon(xy: np.ndarray, nx: int, ny: int) -> np.ndarray:
    """Even-odd fill of voxel centres, those on the outline included; (ny, nx).

    Each edge marks, on the rows it crosses, the columns left of it; parities
    are summed once from the right.
    """
    cross, edge = np.zeros((ny, nx + 1), np.int64), np.zeros((ny, nx), bool)
    for (x0, y0), (x1, y1) in zip(xy, np.roll(xy, -1, axis=0), strict=True):
        low, high = min(y0, y1), max(y0, y1)
        if low == high:
            if low == np.rint(low) and 0 <= low < ny:
                edge[int(low), max(int(np.ceil(min(x0, x1))), 0) : max(int(np.floor(max(x0, x1))) + 1, 0)] = True
            continue
        y = np.arange(max(int(np.ceil(low)), 0), min(int(np.floor(high)) + 1, ny))
        x = (x1 - x0) * (y - y0) / (y1 - y0) + x0
        open_ = y < high
        np.add.at(cross, (y[open_], np.clip(np.ceil(x[open_]), 0, nx).astype(int)), 1)
        on = (np.abs(x - np.rint(x)) < 1e-9) & (np.rint(x) >= 0) & (np.rint(x) < nx)
        edge[y[on], np.rint(x[on]).astype(int)] = True
    return (cross[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:] % 2 == 1) | edge


def contour_mask(contours: list, size: tuple[int, int, int], tolerance: float = 1e-3) -> np.ndarray:
    """Contours (flat index-space x, y, z lists) OR-ed per slice."""
    nx, ny, nz = size
    out = np.zeros((nz, ny, nx), bool)
    for c in contours:
        if len(c) % 3 or len(c) < 9:
            raise ValueError("UnexpectedContourPoints: a contour needs three or more points of three numbers")
        p = np.asarray(c, float).reshape(-1, 3)
        if np.ptp(p[:, 2]) > tolerance:
            raise ValueError("ContourPointsAcrossSlices: a contour spans slices")
        z = p[0, 2]
        if abs(z - np.rint(z)) > tolerance:
            raise ValueError(f"NonIntegerZSliceIndex: {z}")
        if not 0 <= np.rint(z) < nz:
            raise ValueError(f"MaskArrayOutOfBounds: slice {z} of {nz}")
        out[int(np.rint(z))] |= fill_polygon(p[:, :2], nx, ny)
    return out


def rasterise(rois: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """(series, roi, z, y, x, error) of (series, roi, contours); a bad region is one row with an error."""

    def told(held: list[tuple[str, str, np.ndarray]]) -> pd.DataFrame:
        n, at = [len(a) for _, _, a in held], np.concatenate([a for _, _, a in held])
        series, roi = (np.repeat(np.array([r[i] for r in held], object), n) for i in (0, 1))
        return pd.DataFrame({"series": series, "roi": roi, "z": at[:, 0], "y": at[:, 1], "x": at[:, 2], "error": None})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held, count, bad = [], 0, []
            for r in b.itertuples(index=False):
                try:
                    at = np.argwhere(contour_mask(list(r.contours), size))
                except ValueError as e:
                    bad.append((r.series, r.roi, None, None, None, str(e)))
                    continue
                held.append((r.series, r.roi, at))
                count += len(at)
                if count > BATCH_VOXELS:
                    yield told(held)
                    held, count = [], 0
            if held:
                yield told(held)
            if bad:
                yield pd.DataFrame(bad, columns=["series", "roi", "z", "y", "x", "error"])

    return spread(rois.select("series", "roi", "contours"), "series", "roi").mapInPandas(run, "series string, roi string, z int, y int, x int, error string")


# --- shapes ----------------------------------------------------------------------


def label_components(mask: np.ndarray) -> int:
    """Number of face-connected components."""
    lab = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        new = lab.copy()
        for axis in range(3):
            for step in (1, -1):
                other = np.roll(lab, step, axis)
                edge = [slice(None)] * 3
                edge[axis] = 0 if step == 1 else -1
                other[tuple(edge)] = 0
                new = np.where(mask & (other > 0), np.minimum(new, other), new)
        if (new == lab).all():
            return len(np.unique(lab[mask]))
        lab = new


def farthest(points: np.ndarray) -> float:
    """The greatest squared distance of two points, exactly.

    A point can be an end of it only if it is the last of its line along every
    axis; the rest are dropped, what is left is ordered by distance from the
    centre, and pairs that can't reach the best distance so far are not tried.
    """
    p = points
    for axis in range(3):
        if len(p) < 3:
            break
        other = [i for i in range(3) if i != axis]
        order = np.lexsort((p[:, axis], p[:, other[1]], p[:, other[0]]))
        p = p[order]
        new = np.append(True, (np.diff(p[:, other], axis=0) != 0).any(axis=1))
        p = p[new | np.append(new[1:], True)]
    if len(p) < 2:
        return 0.0
    r = np.sqrt(((p - p.mean(axis=0)) ** 2).sum(axis=1))
    order = np.argsort(-r, kind="stable")
    p, r, best = p[order], r[order], 0.0
    for i in range(len(p)):
        if (r[i] + r[0]) ** 2 < best:
            break
        n = np.searchsorted(-r, r[i] - np.sqrt(best), side="right")  # those with r >= sqrt(best) - r[i]
        best = max(best, float(((p[i] - p[: max(n, 1)]) ** 2).sum(axis=1).max()))
    return best


def shape_statistics(mask: DataFrame, size: tuple[int, int, int], spacing: tuple = (1.0, 1.0, 1.0)) -> DataFrame:
    """Per (series, channel): components, Feret diameter, elongation, flatness, ellipsoid diameters.

    One mask is one group; a mask's voxels fit one task (it is one region of one
    series).
    """

    def one(pdf: pd.DataFrame) -> tuple:
        at = np.stack([pdf[c].to_numpy() for c in "xyz"], axis=1)
        m = np.zeros(size[::-1], bool)
        m[at[:, 2], at[:, 1], at[:, 0]] = True
        p = at * np.array(spacing)
        inner = m.copy()
        for axis in range(3):
            for step in (1, -1):
                other = np.roll(m, step, axis)
                edge = [slice(None)] * 3
                edge[axis] = 0 if step == 1 else -1
                other[tuple(edge)] = False
                inner &= other
        shell = p[~inner[at[:, 2], at[:, 1], at[:, 0]]]
        far = farthest(shell)
        e = np.sort(np.linalg.eigvalsh(np.cov(p.T, bias=True) if len(p) > 1 else np.zeros((3, 3))).clip(0))
        ratio = lambda a, b: float(np.sqrt(a / b)) if b > 1e-12 else 0.0
        volume = len(at) * float(np.prod(spacing))
        root = float(np.prod(np.sqrt(e))) if (e > 1e-12).all() else 0.0
        unit = (volume * 6 / np.pi / root) ** (1 / 3) if root else 0.0
        return pdf["series"].iloc[0], pdf["channel"].iloc[0], label_components(m), far**0.5, ratio(e[2], e[1]), ratio(e[1], e[0]), [float(unit * s) for s in np.sqrt(e)]

    rows = mask.select(F.col("series").cast("string").alias("series"), F.col("channel").cast("int").alias("channel"), "z", "y", "x")
    return in_groups(rows, ["series", "channel"], one, "series string, channel int, n_components long, feret double, elongation double, flatness double, diameters array<double>")
