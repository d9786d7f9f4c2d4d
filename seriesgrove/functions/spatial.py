"""Vectors, directions, region boxes and grid geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def vec(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def each(f, *vs: Column) -> Column:  # noqa: ANN001
    return vec(*[f(*[v[a] for v in vs]) for a in AXES])


def size_of(low: Column, high: Column) -> Column:
    return each(lambda a, b: b - a, low, high)


def volume(size: Column) -> Column:
    return size["x"] * size["y"] * size["z"]


def floor_div(size: Column, n: int) -> Column:
    return each(lambda a: F.floor(a / n), size)


def box(low: Column, high: Column) -> Column:
    return F.struct(low.alias("min"), high.alias("max"))


def settle(low: Column, high: Column) -> Column:
    """A negative minimum moves its excess to the maximum."""
    return box(each(lambda a: F.greatest(a, F.lit(0)), low), each(lambda a, b: b + F.greatest(-a, F.lit(0)), low, high))


def pad(b: Column, n: int, both: bool = True) -> Column:
    return settle(each(lambda a: a - n, b["min"]) if both else b["min"], each(lambda a: a + n, b["max"]))


def expand_to_min_size(b: Column, size: int | Column) -> Column:
    """Grows axes below ``size``: half the lack rounded up at the minimum, the rest at the maximum."""
    lack = lambda lo, hi: F.greatest(F.lit(size) - (hi - lo) if isinstance(size, int) else size - (hi - lo), F.lit(0))
    low = each(lambda lo, hi: lo - F.ceil(lack(lo, hi) / 2).cast("int"), b["min"], b["max"])
    high = each(lambda lo, hi: hi + F.floor(lack(lo, hi) / 2).cast("int"), b["min"], b["max"])
    return settle(low, high)


def expand_to_cube(b: Column, desired: int | None = None) -> Column:
    side = F.greatest(*[b["max"][a] - b["min"][a] for a in AXES])
    return expand_to_min_size(b, desired if desired is not None else side)


def clamp(b: Column, size: Column) -> Column:
    """A maximum beyond the image moves its excess to the minimum."""
    over = lambda hi, n: F.greatest(hi - n, F.lit(0))
    return box(each(lambda lo, hi, n: lo - over(hi, n), b["min"], b["max"], size), each(lambda hi, n: F.least(hi, n), b["max"], size))


def flip_axis(direction: Column, axis: int) -> Column:
    return F.transform(direction, lambda v, i: F.when(F.floor(i / 3) == axis, -v).otherwise(v))


def row_norms(direction: Column) -> Column:
    return F.transform(F.array(*[F.lit(k) for k in range(3)]), lambda k: F.sqrt(F.aggregate(F.slice(direction, k * 3 + 1, F.lit(3)), F.lit(0.0), lambda a, v: a + v * v)))


def normalize(direction: Column) -> Column:
    norms = row_norms(direction)
    return F.transform(direction, lambda v, i: v / F.get(norms, F.floor(i / 3).cast("int")))


def is_normalized(direction: Column, tolerance: float = 1e-6) -> Column:
    return F.forall(row_norms(direction), lambda n: F.abs(n - 1) <= tolerance)


def point_to_index(point: Column, origin: Column, spacing: Column) -> Column:
    """Nearest index of a physical point on an axis-aligned grid, as (z, y, x)."""
    i = [F.floor((point[a] - origin[a]) / spacing[a] + 0.5).cast("long") for a in AXES]
    return F.struct(i[2].alias("z"), i[1].alias("y"), i[0].alias("x"))


def index_to_point(index: Column, origin: Column, spacing: Column) -> Column:
    return each(lambda i, o, s: o + i * s, index, origin, spacing)


def resampled_size(size: Column, old: Column, new: Column) -> Column:
    """Size at a new spacing; 0 keeps the axis; half rounds to even."""
    return each(lambda n, a, b: F.when(b == 0, n).otherwise(F.rint(n * a / F.nullif(b, F.lit(0.0))).cast("long")), size, old, new)


# --- vectors, boundaries and directed grids -----------------------------------------


def vec3(x: float | Column, y: float | Column, z: float | Column) -> Column:
    """A vector of three doubles."""
    return vec(*[(F.lit(v) if isinstance(v, int | float) else v).cast("double") for v in (x, y, z)])


def parse_vec3(text: Column) -> Column:
    """``a,b,c`` as a vector of three doubles, null unless it is three numbers."""
    parts = F.transform(F.split(text, ","), lambda p: p.try_cast("double"))
    return F.when((F.size(parts) == 3) & F.forall(parts, lambda p: p.isNotNull()), vec(*[F.get(parts, F.lit(k)) for k in range(3)]))


def boundaries(size: Column, origin: Column | None = None) -> Column:
    """The box of a whole image from index 0, or from its origin in world coordinates (sizes stay voxel counts)."""
    low = origin if origin is not None else each(lambda n: F.lit(0).cast("int"), size)
    return box(low, each(lambda a, n: a + n, low, size))


def centroid_box(centroid: Column, desired: int | None = None) -> Column:
    """A cube about a centroid's index (x, y, z)."""
    return expand_to_cube(box(centroid, centroid), desired)


def _inverse(direction: Column) -> list[list[Column]]:
    """The rows of a 3 x 3 matrix's inverse, by cofactors."""
    m = [[F.get(direction, F.lit(3 * i + j)) for j in range(3)] for i in range(3)]
    minor = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    det = sum((m[0][j] * minor(0, j) for j in range(1, 3)), m[0][0] * minor(0, 0))
    return [[minor(j, i) / det for j in range(3)] for i in range(3)]


def directed_index(point: Column, origin: Column, spacing: Column, direction: Column, continuous: bool = False) -> Column:
    """Index (z, y, x) of a physical point on a grid with a direction; rounded half up unless ``continuous``."""
    off = [point[a] - origin[a] for a in AXES]
    at = [(row[0] * off[0] + row[1] * off[1] + row[2] * off[2]) / spacing[a] for row, a in zip(_inverse(direction), AXES, strict=True)]
    at = at if continuous else [F.floor(i + 0.5).cast("long") for i in at]
    return F.struct(at[2].alias("z"), at[1].alias("y"), at[0].alias("x"))


def directed_point(index: Column, origin: Column, spacing: Column, direction: Column) -> Column:
    """The physical point (x, y, z) of an index on a grid with a direction."""
    step = [index[a] * spacing[a] for a in AXES]
    return vec(*[origin[a] + sum((F.get(direction, F.lit(3 * i + j)) * step[j] for j in range(1, 3)), F.get(direction, F.lit(3 * i)) * step[0]) for i, a in enumerate(AXES)])


def cropped_origin(box_: Column, origin: Column, spacing: Column, direction: Column) -> Column:
    """Where the origin moves when an image is cropped to a box."""
    return directed_point(box_["min"], origin, spacing, direction)


def is_ordered(b: Column) -> Column:
    """Whether a box's minimum doesn't exceed its maximum, axis after axis (lexicographically)."""
    return F.struct(*[b["min"][a] for a in AXES]) <= F.struct(*[b["max"][a] for a in AXES])
