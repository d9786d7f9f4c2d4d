"""Embedding near-dedup against all pairs."""

import math

import numpy as np
import pytest
from seriesgrove.llm import multi_index
from seriesgrove.llm.common import new_folder


def brute(rows, cosine=0.95):
    """{row number: (n_links, component_id)} by all pairs."""
    def unit(x):
        if not x or any(v is None or not math.isfinite(v) for v in x) or not any(x):
            return None
        a = np.array(x, np.float64)
        a /= np.abs(a).max()
        return a / np.linalg.norm(a)

    u = [unit(x) for _, x in rows]
    label, n = list(range(len(rows))), [0] * len(rows)
    for m in {len(x) for x in u if x is not None}:
        at = [i for i, x in enumerate(u) if x is not None and len(x) == m]
        near = np.stack([u[i] for i in at]) @ np.stack([u[i] for i in at]).T >= cosine
        for i, j in zip(*np.nonzero(near), strict=True):
            if i != j:
                n[at[i]] += 1
                a, b = at[i], at[j]
                while label[a] != a:
                    a = label[a]
                while label[b] != b:
                    b = label[b]
                label[max(a, b)] = min(a, b)
    least = {}
    for i, (v, _) in enumerate(rows):
        r = i
        while label[r] != r:
            r = label[r]
        label[i] = r
        least[r] = min((x for x in (least.get(r), v) if x is not None), default=None)
    return [(v, n[i], least[label[i]]) for i, (v, _) in enumerate(rows)]


def found(spark, rows, kind="float", **options):
    path = new_folder(spark, "test")
    spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, cell string").write.parquet(path)
    got = multi_index.near(spark, spark.read.parquet(path), **options).select("vec_id", "n_links", "component_id")
    return sorted(map(tuple, got.collect()), key=str)


def near_copies(rng, x, n, noise):
    y = x + rng.standard_normal((n, len(x))) * noise * np.linalg.norm(x) / math.sqrt(len(x))
    return y.astype(np.float32).astype(float)


@pytest.mark.parametrize(("options", "least"), [({}, 0.99), ({"cell": 20, "block": 16, "target": 1.0}, 0.97)])
def test_recall_and_counts(spark, options, least):
    """A hot group, groups of a few, exact copies and single vectors."""
    rng = np.random.default_rng(5)
    parts = [rng.standard_normal((400, 16)), near_copies(rng, rng.standard_normal(16), 300, 0.1)]
    parts += [near_copies(rng, rng.standard_normal(16), 3, s) for s in rng.uniform(0.05, 0.3, 100)]
    x = np.concatenate(parts).astype(np.float32).astype(float)
    x = np.concatenate([x, np.repeat(x[[3, 450]], 40, axis=0), -x[:5]])
    rows = [(int(i) * 7 % 100003, x[i].tolist()) for i in rng.permutation(len(x))]
    want, got = sorted(brute(rows), key=str), found(spark, rows, **options)
    assert [r[0] for r in got] == [r[0] for r in want]
    links, all_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert least * all_links <= links <= all_links
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1:] == w[1:] for g, w in zip(got, want, strict=True)) >= least * len(want)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.1]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]),
            (None, [1.0, 0.0]), (None, [5.0, 5.0]), (12, [1e300, 0.0]), (13, [1e-300, -0.0]), (2, [2.0, 0.0]), (3, None), (14, [3.0]), (15, [4.0]), (16, [-4.0])]
    assert found(spark, rows, kind="double") == sorted(brute(rows), key=str)
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1), (2, 0, 2)]


def test_balls_split_over_tasks(spark):
    """A group of near copies in several blocks, with vectors at its edge that link with some of it."""
    rng = np.random.default_rng(8)
    middle = rng.standard_normal(8)
    x = np.concatenate([near_copies(rng, middle, 500, 0.08), near_copies(rng, middle, 60, 0.33), rng.standard_normal((200, 8))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want, got = sorted(brute(rows), key=str), found(spark, rows, kind="double", block=64, target=1.0)
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.99 * len(want)
    assert abs(sum(r[1] for r in got) - sum(r[1] for r in want)) <= 0.002 * sum(r[1] for r in want)


def test_traversal_meets_the_cells_within_reach():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((50, 6))
    index = multi_index.Index(rng.standard_normal((7, 3)), rng.standard_normal((5, 3)), 0.5, np.zeros((0, 6)))
    row, cells = index.traverse(x)
    for k, v in enumerate(x):
        cost = []
        for half, codes in ((v[:3], index.first), (v[3:], index.second)):
            d = ((half - codes) ** 2).sum(axis=1)
            own = codes[d.argmin()]
            # The squared distance to the plane that halves the way from the own code to another.
            cost.append([0.0 if (c == own).all() else (np.dot(half - (c + own) / 2, c - own) / np.linalg.norm(c - own)) ** 2 for c in codes])
        sums = np.add.outer(*map(np.array, cost)).ravel()
        got = cells[row == k]
        assert set(got) == set(np.flatnonzero(sums <= 0.5)) and got[0] == index.cells(x)[0][k]
        assert (np.diff(sums[got]) >= -1e-12).all()
