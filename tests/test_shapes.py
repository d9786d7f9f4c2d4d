"""Shapes of masks in blocks against whole arrays."""

import numpy as np
import pytest
from seriesgrove.operators import shapes


def mask_rows(spark, masks):
    rows = [(name, channel, *map(int, p)) for (name, channel), a in masks.items() for p in np.argwhere(a)]
    return spark.createDataFrame(rows, "series string, channel int, z int, y int, x int")


def flood(a):
    """{first place: voxels} by flood fill."""
    left, out = {tuple(map(int, p)) for p in np.argwhere(a)}, {}
    while left:
        start = min(left)
        work, seen = [start], {start}
        while work:
            p = work.pop()
            for axis in range(3):
                for step in (-1, 1):
                    q = tuple(v + step * (i == axis) for i, v in enumerate(p))
                    if q in left and q not in seen:
                        seen.add(q)
                        work.append(q)
        out[shapes.place(*start)] = seen
        left -= seen
    return out


def ball(radius):
    """About a voxel's centre."""
    n = 2 * radius + 5
    z, y, x = np.indices((n, n, n)) - n // 2
    return z * z + y * y + x * x <= radius * radius


def serpentine(n):
    """One path that fills every second row of every second plane."""
    a = np.zeros((n, n, n), bool)
    for z in range(0, n, 2):
        a[z, ::2, :] = True
        for k, y in enumerate(range(1, n - 1, 2)):
            a[z, y, -1 if k % 2 == 0 else 0] = True
        if z + 2 < n:
            rows = len(range(0, n, 2))
            last = 0 if (z // 2) % 2 else 2 * (rows - 1)
            a[z + 1, last, 0 if rows % 2 == 0 else -1] = True
    return a


@pytest.mark.parametrize("side", [2, 5, 16])
def test_components_equal_flood_fill(spark, side):
    rng = np.random.default_rng(side)
    masks = {("a", 1): rng.random((13, 11, 12)) < 0.35, ("a", 2): rng.random((9, 14, 10)) < 0.25, ("b", 1): np.ones((6, 7, 8), bool), ("c", 7): rng.random((12, 3, 30)) < 0.5}
    found = shapes.Shapes(mask_rows(spark, masks), side, voxels=True)
    got = {}
    for r in found.labelled().collect():
        got.setdefault((r["series"], r["channel"]), {}).setdefault(r["component"], set()).add((r["z"], r["y"], r["x"]))
    assert got == {k: flood(a) for k, a in masks.items()}
    counts = {(r["series"], r["channel"]): r["n_components"] for r in found.count().collect()}
    assert counts == {k: len(flood(a)) for k, a in masks.items()}


def test_serpentine_takes_few_rounds(spark):
    a = serpentine(24)
    parts = flood(a)
    found = shapes.Shapes(mask_rows(spark, {("s", 1): a}), 4)
    assert found.count().head()["n_components"] == len(parts)
    assert found.rounds <= 14


def test_runs_equal_brute_force(spark):
    a = np.random.default_rng(3).random((7, 9, 8)) < 0.4
    solid = {tuple(map(int, p)) for p in np.argwhere(a)}
    want = [sum((z - d[2], y - d[1], x - d[0]) not in solid for z, y, x in solid) for d in shapes.DIRECTIONS]
    for side in (3, 20):
        twice = mask_rows(spark, {("a", 1): a}).unionAll(mask_rows(spark, {("a", 1): a}))  # repeated voxels count once
        assert shapes.Shapes(twice, side).sums().head()["runs"] == want


@pytest.mark.parametrize("radius", [5, 8, 12, 40])
def test_spheres(spark, radius):
    s = shapes.Shapes(mask_rows(spark, {("a", 1): ball(radius)})).statistics().head()
    assert s["perimeter"] == pytest.approx(4 * np.pi * radius**2, rel=0.03)
    assert s["roundness"] == pytest.approx(1, abs=0.03)
    assert s["spherical_radius"] == pytest.approx(radius, rel=0.02)
    assert s["diameters"] == pytest.approx([2 * radius] * 3, rel=0.02)


def test_box_and_spacing(spark):
    a = np.zeros((20, 20, 20), bool)
    a[2:6, 3:13, 1:17] = True
    s = shapes.Shapes(mask_rows(spark, {("a", 1): a}), 6).statistics((2.0, 1.0, 0.5)).head()
    p = np.argwhere(a)[:, ::-1] * (2.0, 1.0, 0.5)
    e = np.linalg.eigvalsh(np.cov(p.T, bias=True))
    assert s["moments"] == pytest.approx(e.tolist())
    assert s["elongation"] == pytest.approx(np.sqrt(e[2] / e[1])) and s["flatness"] == pytest.approx(np.sqrt(e[1] / e[0]))
    assert s["volume"] == pytest.approx(4 * 10 * 16)
    one = np.zeros((3, 3, 3), bool)
    one[1, 1, 1] = True
    s = shapes.Shapes(mask_rows(spark, {("a", 1): one})).statistics().head()
    assert (s["n_voxels"], s["elongation"], s["flatness"], s["diameters"]) == (1, 0.0, 0.0, [0.0] * 3)


def test_empty(spark):
    found = shapes.Shapes(mask_rows(spark, {("a", 1): np.ones((1, 1, 1), bool)}).limit(0))
    assert found.count().count() == 0 and found.statistics().count() == 0
