"""B-splines, and volumes in blocks against whole ones."""

import numpy as np
import pytest
from seriesgrove.operators import blocks, splines, volumes


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    made = []
    for name, size, spacing in (("a", (23, 17, 11), (1.0, 0.5, 2.0)), ("b", (9, 30, 14), (0.7, 1.3, 1.0)), ("c", (5, 4, 1), (1.0, 1.0, 1.0))):
        made.append((name, list(size), list(spacing), [1.0, 2.0, 3.0], list(volumes.IDENTITY), bytearray(rng.random(size[::-1]).astype("<f4").tobytes())))
    return spark.createDataFrame(made, volumes.VOLUME).cache()


def arrays(found):
    return {r.series: (list(r.size), np.round(r.spacing, 9).tolist(), volumes.array_of(r.voxels, r.size)) for r in found.collect()}


def same(whole, parts):
    a, b = arrays(whole), arrays(parts)
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][:2] == b[k][:2]
        assert np.abs(a[k][2] - b[k][2]).max() < 1e-6, k


@pytest.mark.parametrize("side", [4, 7, 64])
def test_split_and_merge(rows, side):
    same(rows, blocks.merge(blocks.split(rows, side), side))


@pytest.mark.parametrize(("side", "how"), [(5, "linear"), (8, "bspline"), (6, "nearest"), (40, "bspline")])
def test_blocks_equal_whole_volumes(rows, side, how):
    cut = blocks.split(rows, side)
    same(volumes.resample(rows, (1.7, 0.6, 0.0), how), blocks.merge(blocks.resample(cut, (1.7, 0.6, 0.0), how, side=side), side))
    if side == 8:
        same(volumes.rotate(rows, (5.0, 6.0, 2.0), (0.1, 0.4, 0.7), how), blocks.merge(blocks.rotate(cut, (5.0, 6.0, 2.0), (0.1, 0.4, 0.7), how, side=side), side))
    if side == 5:
        same(volumes.zoom(rows, 0.5, how), blocks.merge(blocks.zoom(cut, 0.5, how, side=side), side))
        same(volumes.resize(rows, (10, 0, 3), how), blocks.merge(blocks.resize(cut, (10, 0, 3), how, side=side), side))


def test_spline_meets_samples_and_cubics():
    rng = np.random.default_rng(0)
    a = rng.random((5, 6, 7))
    z, y, x = np.indices(a.shape)
    points = np.stack([x.ravel(), y.ravel(), z.ravel()], axis=1).astype(float)
    assert splines.evaluate(splines.coefficients(a), points) == pytest.approx(a.ravel())
    t = np.arange(60) / 10
    p = rng.uniform(20, 40, 100)
    cubic = lambda v: 0.3 * v**3 - v**2 + 2 * v - 1
    for axis in range(3):
        shape, at = [1, 1, 1], np.zeros((100, 3))
        shape[2 - axis], at[:, axis] = 60, p
        assert splines.evaluate(splines.coefficients(cubic(t).reshape(shape)), at) == pytest.approx(cubic(p / 10), abs=1e-9)
    mixed = (x - 3.0) ** 2 * (y + 1) - 0.5 * z**3 * 0  # edges are mirrored, so only the samples are met exactly there
    assert splines.evaluate(splines.coefficients(mixed), points) == pytest.approx(mixed.ravel())


def test_refined_splines_and_approximation():
    rng = np.random.default_rng(1)
    c = rng.random((4, 5, 6))
    assert np.abs(splines.surface(c, (11, 9, 13)) - splines.surface(splines.refined(c), (11, 9, 13))).max() < 1e-12
    z, y, x = np.indices((20, 16, 18)) / 20
    smooth = np.sin(2 * x) + y * z
    fit, spans = np.zeros_like(smooth), (1, 1, 1)
    for _ in range(5):  # every level fits what is left
        fit = fit + splines.surface(splines.approximate(smooth - fit, np.ones_like(smooth, bool), spans), smooth.shape)
        spans = tuple(2 * s for s in spans)
    assert np.abs(fit - smooth).mean() < 0.01


def test_unknown_interpolation(rows):
    assert volumes.resample(rows, 1.0, "cubic").where("error is null").count() == 0
    with pytest.raises(ValueError, match="interpolation"):
        blocks.resample(rows, 1.0, "cubic")
