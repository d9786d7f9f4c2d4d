"""Blocks of a mask are worked on together, with the same result as one at a time."""

import random

import pytest
from seriesgrove.operators import shapes


@pytest.mark.parametrize("side", [3, 6])
def test_many_blocks_at_once(monkeypatch, side):
    import numpy as np
    import pyarrow as pa

    rng, rows = random.Random(side), []
    voxels = {(str(rng.randrange(40)), rng.randrange(9), rng.randrange(9), rng.randrange(9)) for _ in range(4000)}
    for s, *v in sorted(voxels):
        around = {tuple((c + d - 1) // side for c, d in zip(v, step, strict=True)) for step in np.ndindex(3, 3, 3)}
        rows += [(s, 1, *block, *v) for block in around]
    rows.sort(key=lambda r: r[:5])
    names = ["series", "channel", "bz", "by", "bx", "z", "y", "x"]
    table = pa.table([pa.array(c, pa.string() if i == 0 else pa.int32()) for i, c in enumerate(zip(*rows, strict=True))], names=names)
    label, calls = shapes.label, []
    monkeypatch.setattr(shapes, "label", lambda solid: calls.append(len(solid)) or label(solid))

    def run():
        calls.clear()
        found = [tuple(map(str, r.values())) for b in shapes.worker(side, True)(iter(table.to_batches(max_chunksize=1000))) for r in b.to_pylist()]
        return sorted(found), len(calls)

    together, few = run()
    monkeypatch.setattr(shapes, "CELLS", 1)
    alone, many = run()
    assert together == alone and few < many / 4
    n = {(r[0], r[4]) for r in alone if r[2] == str(shapes.VOXEL)}
    assert n == {(s, str(shapes.place(*v))) for s, *v in voxels}
