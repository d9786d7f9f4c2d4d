import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from seriesgrove.errors import OverlappingMasksError, ROIMatchingError, TooManyComponentsError
from seriesgrove.operators import outputs, roi, synthetic, volumes, voxel
from seriesgrove.operators.roi import ROIMatchFailurePolicy, ROIMatchStrategy

NAMES = ["Liver", "liver dome", "Kidney L", "Kidney R", "kidney cyst", "Spleen", "", "Heart_atrium", "heart", "Colon (asc.)", "node-3"]
MAP = {"abdomen": ["liver.*", "spleen"], "kidneys": ["kidney [LR]", "Kidney.*"], "any": [".*e.*", "node-[0-9]"], "heart": ["HEART"], "none": ["lung.*"]}


def brute(names, table, strategy, ignore_case, multi):
    """The matches key by key, one name at a time."""
    flags, out, taken = re.IGNORECASE if ignore_case else 0, [], set()
    for key, patterns in table.items():
        hits = [n for p in patterns for n in sorted(names) if re.fullmatch(p, n, flags) and (multi or n not in taken)]
        if not multi:
            hits = list(dict.fromkeys(hits))
        if strategy == ROIMatchStrategy.KEEP_FIRST:
            hits = hits[:1]
        taken |= set(hits)
        if strategy == ROIMatchStrategy.SEPARATE:
            out += [(key, f"{key}__[{n}]", [n]) for n in hits]
        elif hits:
            out.append((key, key, hits))
    return sorted(out)


@pytest.fixture(scope="module")
def rois(spark):
    return spark.createDataFrame([("s", n) for n in NAMES], "series string, roi string")


@pytest.mark.parametrize("strategy", list(ROIMatchStrategy))
@pytest.mark.parametrize("ignore_case", [True, False])
@pytest.mark.parametrize("multi", [True, False])
def test_matching_equals_brute_force(spark, rois, strategy, ignore_case, multi):
    got = roi.match(rois, roi.pattern_rows(spark, MAP), strategy, ignore_case, multi)
    assert sorted((r.key, r.image_id, r.roi_names) for r in got.collect()) == brute(NAMES, MAP, strategy, ignore_case, multi)


def test_a_taken_name_leaves_the_next_free(spark):
    names, table = ["lobe a", "lobe b", "vessel"], {"first": ["lobe.*"], "second": ["lobe.*"], "tube": ["vessel"]}
    r = spark.createDataFrame([("s", n) for n in names], "series string, roi string")
    got = roi.match(r, roi.pattern_rows(spark, table), ROIMatchStrategy.KEEP_FIRST, allow_multi=False)
    assert {x.key: x.roi_names for x in got.collect()} == {"first": ["lobe a"], "second": ["lobe b"], "tube": ["vessel"]}
    with pytest.raises(ROIMatchingError):
        roi.require_matches(roi.match(r, roi.pattern_rows(spark, "zzz")), ROIMatchFailurePolicy.ERROR)


def test_maps():
    assert roi.normalize_map() == {"ROI": [".*"]} and roi.normalize_map("a") == {"ROI": ["a"]} and roi.normalize_map(["a", "b"]) == {"ROI": ["a", "b"]}
    assert roi.normalize_map({"k": "a", "l": ("b",)}) == {"k": ["a"], "l": ["b"]}


def test_masks(spark):
    m = spark.createDataFrame([("s", 1, 0, 0, 0), ("s", 2, 0, 0, 0), ("s", 2, 0, 0, 1)], "series string, channel int, z int, y int, x int")
    assert voxel.has_overlap(m).head().has_overlap
    assert {(r.x, r.label) for r in voxel.to_sparse(m).collect()} == {(0, 2), (1, 2)}
    assert {(r.x, r.region) for r in voxel.to_region(m, 2).collect()} == {(0, 3), (1, 2)}
    with pytest.raises(OverlappingMasksError):
        voxel.to_label(m)
    with pytest.raises(TooManyComponentsError):
        voxel.to_region(m, 33)
    with pytest.raises(ValueError):
        voxel.window_intensity(F.lit(1.0), 0, 0)


def test_contours():
    square = [1.5, 1.5, 2, 4.5, 1.5, 2, 4.5, 4.5, 2, 1.5, 4.5, 2]
    assert volumes.contour_mask([square], (8, 8, 4)).sum() == 9
    for bad in ([1, 1, 0.5] * 3, [1, 1, 9] * 3, [1, 1, 0, 2, 2, 1, 3, 3, 0], [1, 2]):
        with pytest.raises(ValueError):
            volumes.contour_mask([bad], (8, 8, 4))


def test_shapes_and_resampling(spark):
    v = synthetic.volume(spark, "sphere", (16, 16, 16), radius=5.0).where("value > 0").select(F.lit("s").alias("series"), F.lit(1).alias("channel"), "z", "y", "x")
    s = volumes.shape_statistics(v, (16, 16, 16)).head()
    assert s.n_components == 1 and abs(s.feret - 10) < 1 and abs(s.elongation - 1) < 0.05
    assert all(abs(d - 10) < 1 for d in s.diameters)
    two = np.zeros((3, 3, 3), bool)
    two[0, 0, 0] = two[2, 2, 2] = True
    assert volumes.label_components(two) == 2
    flat = spark.createDataFrame([("a", [5.0] * 64)], "k string, v array<double>")
    r = volumes.summarise(volumes.resample(volumes.pack(flat, "k", "v", (4, 4, 4)), (2.0, 2.0, 0.0))).head()
    assert (r.nx, r.ny, r.nz, r.v_min, r.v_max) == (2, 2, 4, 5.0, 5.0)


def test_outputs(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "filepath string, x string")
    new = spark.createDataFrame([("b", "9")], "filepath string, y string")
    assert sorted(map(tuple, outputs.upsert_index(old, new).collect())) == [("a", "1", ""), ("b", "", "9")]
    assert outputs.region_labels(1, 3) == [2, 3, 6, 7]
    assert '"numTraining": 3' in outputs.dataset_manifest(["CT"], ["GTV"], 3)
