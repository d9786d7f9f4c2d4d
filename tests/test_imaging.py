"""Volumes, structure sets, segmentations, writers and the pipelines on encoded files."""

import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from seriesgrove import cli, errors, storage, util
from seriesgrove.operators import outputs, roi, volumes
from seriesgrove.plans import nnunet, pipeline, validators
from seriesgrove.sources import actions, dicom, dicom_tags, nifti, remote, render, series, structures, writers

NX, NY, NZ = 8, 6, 5
SPACING, ORIGIN = (2.0, 3.0, 4.0), (10.0, -20.0, 30.0)


def pixels(seed=0):
    return np.random.default_rng(seed).integers(0, 1000, (NZ, NY, NX)).astype("<i2")


def slices(uid, modality, a, patient="P1", orientation=(1, 0, 0, 0, 1, 0), frame="9", **more):
    """Headers of the slices of a volume; slice i lies at ORIGIN plus i gaps along the slice axis."""
    normal = np.cross(orientation[:3], orientation[3:])
    for i, plane in enumerate(a):
        at = np.array(ORIGIN) + i * SPACING[2] * normal
        yield {
            "PatientID": patient, "StudyInstanceUID": f"{patient}.1", "SeriesInstanceUID": uid, "SOPInstanceUID": f"{uid}.{i}", "Modality": modality, "FrameOfReferenceUID": frame,
            "AcquisitionNumber": "1", "InstanceNumber": str(i), "Rows": NY, "Columns": NX, "BitsAllocated": 16, "PixelRepresentation": 1, "SamplesPerPixel": 1,
            "PixelSpacing": [str(SPACING[1]), str(SPACING[0])], "ImagePositionPatient": [str(x) for x in at], "ImageOrientationPatient": [str(x) for x in orientation],
            "SliceThickness": str(SPACING[2]), "PixelData": plane.tobytes(),
        } | more


def square(x0, y0, x1, y1, z):
    """A contour in physical points of a square of voxel indices."""
    return [str(ORIGIN[k] + SPACING[k] * v) for p in ((x0, y0, z), (x1, y0, z), (x1, y1, z), (x0, y1, z)) for k, v in enumerate(p)]


def structure(uid, ref, rois, patient="P1"):
    contour = lambda c: {"ContourGeometricType": c.get("kind", "CLOSED_PLANAR"), "ContourData": c["points"]}
    return {
        "PatientID": patient, "StudyInstanceUID": f"{patient}.1", "SeriesInstanceUID": uid, "SOPInstanceUID": f"{uid}.0", "Modality": "RTSTRUCT",
        "StructureSetROISequence": [{"ROINumber": str(i + 1), "ROIName": n} for i, (n, _) in enumerate(rois)],
        "ROIContourSequence": [{"ReferencedROINumber": str(i + 1), **({} if cs is None else {"ContourSequence": [contour(c) for c in cs]})} for i, (_, cs) in enumerate(rois)],
        "ReferencedFrameOfReferenceSequence": [{"RTReferencedStudySequence": [{"RTReferencedSeriesSequence": [{"SeriesInstanceUID": ref, "ContourImageSequence": [{"ReferencedSOPInstanceUID": f"{ref}.0"}]}]}]}],
    }


def segmentation(uid, ref, labels, masks, patient="P1", kind="BINARY"):
    """masks: label position to (slice, plane) pairs."""
    frames = [(k, z, m) for k, ms in enumerate(masks) for z, m in ms]
    bits = np.concatenate([m.ravel() for _, _, m in frames]) if frames else np.zeros(0, np.uint8)
    return {
        "PatientID": patient, "StudyInstanceUID": f"{patient}.1", "SeriesInstanceUID": uid, "SOPInstanceUID": f"{uid}.0", "Modality": "SEG", "SegmentationType": kind, "Rows": NY, "Columns": NX,
        "BitsAllocated": 1, "SamplesPerPixel": 1, "NumberOfFrames": str(len(frames)), "SegmentSequence": [{"SegmentNumber": i + 1, "SegmentLabel": n, "SegmentDescription": f"about {n}"} for i, n in enumerate(labels)],
        "ReferencedSeriesSequence": [{"SeriesInstanceUID": ref}],
        "SharedFunctionalGroupsSequence": [{"PixelMeasuresSequence": [{"PixelSpacing": ["3.0", "2.0"], "SliceThickness": "4.0"}], "PlaneOrientationSequence": [{"ImageOrientationPatient": list("100010")}]}],
        "PerFrameFunctionalGroupsSequence": [
            {"SegmentIdentificationSequence": [{"ReferencedSegmentNumber": k + 1}], "PlanePositionSequence": [{"ImagePositionPatient": [str(ORIGIN[0]), str(ORIGIN[1]), str(ORIGIN[2] + 4.0 * z)]}]}
            for k, z, _ in frames
        ],
        "PixelData": np.packbits(bits, bitorder="little").tobytes(),
    }


def lay(folder, headers):
    os.makedirs(folder, exist_ok=True)
    for i, h in enumerate(headers):
        with open(f"{folder}/{i:03d}.dcm", "wb") as f:
            f.write(dicom.encode(h))


PLANE = np.zeros((NY, NX), np.uint8)
PLANE[1:3, 2:5] = 1


@pytest.fixture(scope="module")
def collection(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("dicom"))
    lay(f"{root}/P1/ct", list(slices("1.1", "CT", pixels(1), RescaleSlope="2", RescaleIntercept="-100"))[::-1])
    rois = [("GTV 1", [{"points": square(1, 1, 3, 3, 2)}, {"points": square(2, 2, 5, 4, 3)}]), ("GTV 2", [{"points": square(5, 3, 6, 4, 2)}]), ("cord", [{"points": square(0, 0, 0, 0, 0), "kind": "POINT"}]), ("none", None)]
    lay(f"{root}/P1/rt", [structure("1.2", "1.1", rois)])
    lay(f"{root}/P1/seg", [segmentation("1.3", "1.1", ["lesion", "other"], [[(1, PLANE), (2, PLANE)], [(2, 1 - PLANE)]])])
    lay(f"{root}/P1/pt", slices("1.4", "PT", pixels(2) - 500, **{"70531000": "0.5", "70531009": "3"}))
    dose = {k: v for k, v in next(slices("1.5", "RTDOSE", pixels(3))).items() if k != "SliceThickness"}
    lay(f"{root}/P1/dose", [dose | {"NumberOfFrames": str(NZ), "PixelData": pixels(3).tobytes(), "DoseGridScaling": "0.01", "DoseUnits": "GY", "DoseType": "PHYSICAL", "GridFrameOffsetVector": [str(4.0 * i) for i in range(NZ)],
                                    "ReferencedImageSequence": [{"ReferencedSOPInstanceUID": "1.1"}], "ReferencedRTPlanSequence": [{"ReferencedSOPInstanceUID": "7.7"}]}])
    lay(f"{root}/P2/ct", slices("2.1", "CT", pixels(4), patient="p2"))
    lay(f"{root}/P2/rt", [structure("2.2", "2.1", [("liver", [{"points": square(1, 1, 2, 2, 1)}])], patient="p2")])
    lay(f"{root}/P3/ct", [h | {"PixelData": b"\x00\x00"} for h in slices("3.1", "CT", pixels(5), patient="P3")])
    lay(f"{root}/P3/rt", [structure("3.2", "3.1", [("GTV", [{"points": square(1, 1, 2, 2, 1)}])], patient="P3")])
    return root


@pytest.fixture(scope="module")
def instances(spark, collection):
    return dicom.crawl(spark, collection)


def only(df, uid):
    return df.where(F.col("SeriesInstanceUID") == uid)


def test_series_to_volumes(spark, instances):
    got = {r.series: r for r in series.load_series(instances.where("Modality in ('CT', 'PT', 'RTDOSE')")).collect()}
    a = lambda uid: volumes.array_of(got[uid].voxels, got[uid].size)
    assert (a("1.1") == pixels(1).astype("f4") * 2 - 100).all()
    assert (a("1.4") == np.abs((pixels(2) - 500).astype("f4") * np.float32(0.5))).all()
    assert np.allclose(a("1.5"), pixels(3) * 0.01) and got["1.5"].meta["DoseUnits"] == "GY"
    for uid in ("1.1", "1.4", "1.5"):
        assert tuple(got[uid].size) == (NX, NY, NZ) and tuple(got[uid].spacing) == SPACING and tuple(got[uid].origin) == ORIGIN and tuple(got[uid].direction) == volumes.IDENTITY
    assert got["3.1"].error.startswith("LoadError: InvalidDicomError")
    act = series.load_series(only(instances, "1.4"), pet_image_type=series.PETImageType.ACT).head()
    assert (volumes.array_of(act.voxels, act.size) == np.abs((pixels(2) - 500).astype("f4") * 3)).all()


def test_direction_and_flip():
    tilted = [dicom.parse(dicom.encode(h), pixels=True) for h in slices("1", "MR", pixels(), orientation=(0, 1, 0, 0, 0, 1))]
    a, spacing, origin, d, _ = series.read_auto(tilted[::-1])
    assert d == [0, 0, 1, 1, 0, 0, 0, 1, 0] and (a == pixels()).all() and spacing == list(SPACING) and origin == list(ORIGIN)
    down = [dicom.parse(dicom.encode(h), pixels=True) for h in slices("1", "CT", pixels(), orientation=(1, 0, 0, 0, -1, 0), SpacingBetweenSlices="-4")]
    assert series.read_auto(down)[3] == [1, 0, 0, 0, -1, 0, 0, 0, 1]
    plain = [dicom.parse(dicom.encode(h), pixels=True) for h in slices("1", "CT", pixels(), orientation=(1, 0, 0, 0, -1, 0))]
    assert series.read_auto(plain)[3][8] == -1
    with pytest.raises(ValueError, match="modality"):
        series.read_auto(plain, "SR")
    assert (series.read_pet([{"Rows": 1, "Columns": 1, "BitsAllocated": 8, "PixelData": b"\x05"}])[0] == 5).all()


def test_subseries(spark):
    two = [dicom.encode(h | {"AcquisitionNumber": str(1 + i % 2)}) for i, h in enumerate(slices("1", "CT", pixels()))]
    rows = [(f"f{i}", "1", str(1 + i % 2), c) for i, c in enumerate(two)]
    df = spark.createDataFrame(rows, "path string, SeriesInstanceUID string, AcquisitionNumber string, content binary")
    assert sorted((r.sub_series, r.size[2]) for r in series.load_series(df, load_subseries=True).collect()) == [("1", 3), ("2", 2)]
    assert [r.size[2] for r in series.load_series(df).collect()] == [5]


def test_regions(spark, instances):
    found = structures.read_regions(instances.where("Modality in ('RTSTRUCT', 'SEG')"))
    got = {(r.series, r.roi): r for r in found.collect()}
    assert got["1.2", "GTV 1"].error is None and len(got["1.2", "GTV 1"].contours) == 2
    assert "POINT" in got["1.2", "cord"].error and "no ContourSequence" in got["1.2", "none"].error
    assert got["1.3", "lesion"].description == "about lesion" and len(got["1.3", "lesion"].frames) == 2
    assert {r.roi for r in structures.region(found, "GTV 1").collect()} == {"GTV 1"} and {r.roi for r in structures.region(found, slice(0, 2)).collect()} >= {"GTV 1", "GTV 2"}
    for bad in ("nothing", -1, 2.5, 99):
        with pytest.raises(errors.MissingROIError):
            structures.region(found, bad)


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({"SegmentationType": ""}, "SegmentationError"), ({"SegmentationType": "LABELMAP"}, "SegmentationTypeUnsupportedError"), ({"SegmentationType": "FRACTIONAL"}, "SegmentationError"),
        ({"SegmentSequence": [{"SegmentNumber": 1, "SegmentLabel": "a"}] * 2}, "SegmentDuplicateError"),
        ({"PerFrameFunctionalGroupsSequence": [], "SharedFunctionalGroupsSequence": []}, "SegmentReferenceIndicesError"), ({"PerFrameFunctionalGroupsSequence": []}, "SegmentReferenceIndicesError"),
    ],
)
def test_bad_segmentations(spark, change, error):
    h = segmentation("1", "2", ["a", "b"], [[(0, PLANE)], [(1, PLANE)]]) | change
    row = structures.read_regions(spark.createDataFrame([("f", dicom.encode(h))], "path string, content binary")).head()
    assert row.error.startswith(error) and row.roi is None


def test_segment_without_frames(spark):
    h = segmentation("1", "2", ["a", "b"], [[(0, PLANE)], []])
    got = {r.roi: r.error for r in structures.read_regions(spark.createDataFrame([("f", dicom.encode(h))], "path string, content binary")).collect()}
    assert got["a"] is None and got["b"].startswith("SegmentDataMissingError")


def brute_fill(points, nx, ny):
    """Voxel centres inside a polygon or on its outline, one by one."""
    out = np.zeros((ny, nx), bool)
    n = len(points)
    for y in range(ny):
        for x in range(nx):
            inside = False
            for i in range(n):
                (x0, y0), (x1, y1) = points[i], points[(i + 1) % n]
                if abs((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) < 1e-9 and min(x0, x1) <= x <= max(x0, x1) and min(y0, y1) <= y <= max(y0, y1):
                    out[y, x] = True
                if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                    inside = not inside
            out[y, x] |= inside
    return out


def test_polygon_fill_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        p = rng.integers(-2, 12, (rng.integers(3, 9), 2)).astype(float) + rng.choice([0.0, 0.5, 0.25])
        assert (volumes.fill_polygon(p, 10, 9) == brute_fill(p.tolist(), 10, 9)).all()


def test_masks_on_the_grid(spark, instances):
    regions = structures.read_regions(instances.where("Modality in ('RTSTRUCT', 'SEG') and SeriesInstanceUID like '1.%'"))
    grid = spark.createDataFrame([(s, [NX, NY, NZ], list(SPACING), list(ORIGIN), list(volumes.IDENTITY)) for s in ("1.2", "1.3")], "series string, size array<int>, spacing array<double>, origin array<double>, direction array<double>")
    matched = roi.match(regions.where("roi is not null"), roi.pattern_rows(spark, {"tumour": ["gtv.*", "lesion"], "rest": ["other"]}))
    got = {(r.series, r.roi_key): r for r in structures.masks(regions, matched, grid).collect()}
    want = np.zeros((NZ, NY, NX), bool)
    want[2, 1:4, 1:4] = want[3, 2:5, 2:6] = want[2, 3:5, 5:7] = True
    assert (volumes.array_of(got["1.2", "tumour"].voxels, [NX, NY, NZ]) > 0).tolist() == want.tolist() and got["1.2", "tumour"].roi_names == ["GTV 1", "GTV 2"]
    want = np.zeros((NZ, NY, NX), bool)
    want[1:3] = PLANE > 0
    assert (volumes.array_of(got["1.3", "tumour"].voxels, [NX, NY, NZ]) > 0).tolist() == want.tolist()
    assert (got["1.3", "tumour"].channel, got["1.3", "rest"].channel) == (1, 2)
    rows = structures.masks(regions, matched, grid)
    sparse = structures.to_voxels(rows.where("series = '1.3'"))
    assert sparse.where("channel = 1").count() == int(want.sum()) and sparse.where("channel = 2").count() == NX * NY - int(PLANE.sum())
    code = structures.encode_mask(rows.where("series = '1.3'"), ["tumour", "rest"], "region").head()
    assert np.unique(volumes.array_of(code.voxels, code.size)).tolist() == [0, 1, 2]
    assert structures.encode_mask(rows.where("series = '1.2'"), ["tumour", "rest"]).head().error.startswith("MissingROIsError")
    outside = grid.withColumn("size", F.array(F.lit(NX), F.lit(NY), F.lit(2)))
    bad = structures.masks(regions, matched, outside).where("series = '1.2'").head()
    assert bad.error.startswith("MaskError") and "MaskArrayOutOfBounds" in bad.error


def test_overlap_is_an_error_row(spark):
    cube = np.ones(8, "<f4").tobytes()
    rows = [("s", k, [k], [2, 2, 2], [1.0] * 3, [0.0] * 3, list(volumes.IDENTITY), cube, None) for k in ("a", "b")]
    df = spark.createDataFrame(rows, "series string, roi_key string, roi_names array<string>, size array<int>, spacing array<double>, origin array<double>, direction array<double>, voxels binary, error string")
    assert structures.encode_mask(df, ["a", "b"]).head().error.startswith("OverlappingMasksError")
    value = lambda how: float(volumes.array_of((r := structures.encode_mask(df, ["a", "b"], how).head()).voxels, r.size).max())
    assert value("sparse") == 2 and value("region") == 3
    with pytest.raises(errors.TooManyComponentsError):
        structures.encode_mask(df, [str(i) for i in range(33)], "region")


# --- geometry and transforms -----------------------------------------------------------


@pytest.fixture(scope="module")
def volume(spark):
    a = pixels(9).astype("<f4")
    turned = [0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    rows = [("a", [NX, NY, NZ], list(SPACING), list(ORIGIN), list(volumes.IDENTITY), a.tobytes()), ("b", [NX, NY, NZ], list(SPACING), list(ORIGIN), turned, a.tobytes())]
    return spark.createDataFrame(rows, volumes.VOLUME)


def test_crop_moves_the_origin(spark, volume):
    box = volume.withColumn("box_min", F.array(F.lit(1), F.lit(2), F.lit(3))).withColumn("box_max", F.array(F.lit(4), F.lit(5), F.when(F.col("series") == "a", 5).otherwise(9)))
    got = {r.series: r for r in volumes.crop_box(box).collect()}
    assert (volumes.array_of(got["a"].voxels, got["a"].size) == pixels(9)[3:5, 2:5, 1:4]).all() and got["a"].origin == [12.0, -14.0, 42.0]
    assert got["b"].error.startswith("CropError")
    inside = volumes.crop_box(box.withColumn("box_max", F.array(F.lit(4), F.lit(5), F.lit(5)))).where("series = 'b'").head()
    assert inside.origin == [10 + 3 * 4.0, -20 + 1 * 2.0, 30 + 2 * 3.0]


def test_index_and_point_are_inverse():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    p = rng.normal(size=(20, 3)) * 50
    back = volumes.to_physical(volumes.to_index(p, ORIGIN, SPACING, q.ravel(), continuous=True), ORIGIN, SPACING, q.ravel())
    assert np.allclose(back, p) and volumes.to_index(np.array([[11.0, -20, 30]]), ORIGIN, SPACING, volumes.IDENTITY).tolist() == [[1, 0, 0]]


def test_failing_volumes_are_rows(spark, volume):
    def f(a, spacing, origin, corner=float(pixels(9)[0, 0, 0])):
        if a[0, 0, 0] == corner:
            raise RuntimeError("no")
        return a, spacing, origin

    got = volumes.map_volumes(volume.withColumn("note", F.lit("kept")), f).collect()
    assert all(r.error == "TransformError: RuntimeError: no" and r.note == "kept" for r in got)
    assert volumes.map_images(volume, lambda a, k: a * k, k=2).where("error is null").count() == 2
    assert volumes.map_images(volume, lambda a: a[1:]).where("error is null").count() == 0


def test_fingerprint(volume):
    r = volumes.fingerprint(volume).where("series = 'a'").head()
    a = pixels(9).astype(float)
    assert (r.v_min, r.v_max, r.v_sum, r.n_voxels, r.dtype) == (a.min(), a.max(), a.sum(), a.size, "float32") and np.allclose([r.v_mean, r.v_std, r.v_var], [a.mean(), a.std(ddof=1), a.var(ddof=1)])
    import hashlib

    assert r.hash == hashlib.sha1(a.astype("<f4").tobytes()).hexdigest() and r.spacing == list(SPACING)


def test_resample_like(spark, volume):
    ref = F.struct(F.array(F.lit(3), F.lit(3), F.lit(2)).alias("size"), F.array(F.lit(12.0), F.lit(-17.0), F.lit(34.0)).alias("origin"), F.array(F.lit(4.0), F.lit(3.0), F.lit(8.0)).alias("spacing"), F.col("direction"))
    got = volumes.like(volume.withColumn("ref", ref)).where("series = 'a'").head()
    assert (volumes.array_of(got.voxels, got.size) == pixels(9)[1:4:2, 1:4, 1:6:2]).all() and got.spacing == [4.0, 3.0, 8.0]


def test_bias_correction(spark):
    z, y, x = np.meshgrid(*[np.linspace(-1, 1, 20)] * 3, indexing="ij")
    true = np.where(x**2 + y**2 + z**2 < 0.3, 200.0, 100.0)
    a = np.where(x**2 + y**2 + z**2 < 0.95, true * np.exp(0.4 * x + 0.2 * y), 0)
    rows = [(m, [20] * 3, [1.0] * 3, [0.0] * 3, list(volumes.IDENTITY), a.astype("<f4").tobytes(), m) for m in ("MR", "CT")]
    df = spark.createDataFrame(rows, volumes.VOLUME + ", modality string")
    got = {r.series: volumes.array_of(r.voxels, r.size) for r in volumes.bias_correct(df).collect()}
    core = true == 200
    assert got["MR"][core].std() / got["MR"][core].mean() < 0.02 < a[core].std() / a[core].mean() and (got["CT"] == a.astype("f4")).all()


def test_farthest_equals_all_pairs():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 300):
        p = np.unique(rng.integers(0, 12, (n, 3)), axis=0) * np.array([1.0, 2.0, 0.5])
        assert volumes.farthest(p) == ((p[:, None] - p[None]) ** 2).sum(axis=-1).max()


# --- writers -------------------------------------------------------------------------------


def test_writer_is_repeatable(spark, volume, tmp_path):
    rows = volume.withColumn("PatientID", F.lit("Pat 1")).withColumn("meta", F.create_map(F.lit("Modality"), F.lit("CT")))
    w = writers.Writer(spark, str(tmp_path / "out"), "{PatientID}/%Modality/%site/{series}.nii.gz", context={"site": "x"}, index_path=str(tmp_path / "index"))
    assert {r.action for r in w.preview(rows).collect()} == {"write"}
    done = w.save(rows)
    assert {r.status for r in done.collect()} == {"written"} == {r.status for r in done.collect()}  # two actions
    path = tmp_path / "out/Pat_1/CT/x/b.nii.gz"
    a, spacing, origin, direction = nifti.decode_image(path.read_bytes())
    assert (a == pixels(9)).all() and spacing == SPACING and np.allclose(origin, ORIGIN) and np.allclose(direction, [0, 0, 1, 1, 0, 0, 0, 1, 0])
    assert {r.action for r in w.preview(rows).collect()} == {"fail"} and path.exists()
    assert all("FileExistsError" in r.error for r in w.save(rows).collect())
    before = path.read_bytes()
    for mode, status in (("skip", "skipped"), ("overwrite", "written")):
        w.existing = mode
        assert {r.status for r in w.save(rows).collect()} == {status} and path.read_bytes() == before
    index = {r.filepath: r for r in outputs.IndexStore(spark, str(tmp_path / "index")).read().collect()}
    assert set(index) == {"Pat_1/CT/x/a.nii.gz", "Pat_1/CT/x/b.nii.gz"} and index["Pat_1/CT/x/a.nii.gz"].site == "x"
    assert not [f for f in os.listdir(tmp_path / "out") if f.startswith(".")]
    back = nifti.read_images(spark.createDataFrame([(str(path), {"Modality": "CT", "hash": "z", "mask.x": "1"})], "path string, meta map<string,string>"), "meta", mask=True).head()
    assert back.meta == {"Modality": "CT"} and back.warning and back.size == [NX, NY, NZ]


def test_publishing_twice(spark, tmp_path, volume):
    """A publishing task that died after renaming finds its files in place."""
    w = writers.Writer(spark, str(tmp_path), "{series}.npz")
    same = volume.withColumn("series", F.lit("one"))
    got = w.save(same).collect()
    assert sorted(str(r.status) for r in got) == ["None", "written"] and any("another row" in (r.error or "") for r in got)
    with np.load(tmp_path / "one.npz") as z:
        assert z["image_array"].shape == (NZ, NY, NX) and z["direction"].shape == (9,)
    bad = writers.Writer(spark, str(tmp_path), "{series}_{meta_key}.nii", context={})
    with pytest.raises(errors.MissingPlaceholderValueError):
        bad.save(volume)
    lost = bad.save(volume.withColumn("meta", F.create_map(F.lit("a"), F.lit("b")))).collect()
    assert all("MissingPlaceholderValueError" in r.error for r in lost)
    for args in (("x.png",), ("{a}.nii", "replace")):
        with pytest.raises(ValueError):
            writers.Writer(spark, str(tmp_path), *args)


def test_index_store(spark, tmp_path):
    store = outputs.IndexStore(spark, str(tmp_path / "i"), wait=0.3)
    row = lambda **k: spark.createDataFrame([tuple(k.values())], list(k))
    assert store.read() is None
    store.upsert(row(filepath="a", x="1"))
    store.upsert(row(filepath="b", y="2"))
    got = store.upsert(row(filepath="a", x="3"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "3", ""), ("b", "", "2")] and got.columns == ["filepath", "x", "y"]
    with pytest.raises(errors.IndexSchemaMismatchError):
        store.upsert(row(filepath="c", z="1"), merge_columns=False)
    assert len(store.versions()) <= 2
    (tmp_path / "i/_lock").write_text("")
    with pytest.raises(errors.WriterIndexError):
        store.upsert(row(filepath="c", x="1"))


@pytest.mark.parametrize("action", ["copy", "move", "symlink", "hardlink"])
def test_file_actions(spark, tmp_path, action):
    source, target = tmp_path / "a.txt", tmp_path / "deep/b.txt"
    source.write_text("x")
    plan = spark.createDataFrame([(str(source), str(target)), (str(tmp_path / "gone"), str(tmp_path / "c"))], "source string, target string")
    got = {os.path.basename(r.source): r for r in actions.act(spark, plan, action).collect()}
    assert got["a.txt"].status == "done" and target.read_text() == "x" and "FileNotFoundError" in got["gone"].error
    assert source.exists() == (action != "move") and os.path.islink(target) == (action == "symlink")
    again = actions.act(spark, plan.limit(1), action).head()
    assert "FileExistsError" in again.error if action == "copy" else again.status == "already"
    assert actions.act(spark, plan.limit(1), action, overwrite=True).head().error is None
    with pytest.raises(ValueError, match="no action"):
        actions.act(spark, plan, "burn")


# --- pipelines ---------------------------------------------------------------------------------


def test_autopipeline(spark, collection, tmp_path):
    p = pipeline.Autopipeline(spark, collection, str(tmp_path), modalities=["CT", "RTSTRUCT"], spacing=(4.0, 0.0, 0.0), roi_match_map={"GTV": "gtv.*"}, window=200.0, level=100.0)
    got = {r.PatientID: r for r in p.run().collect()}
    assert got["P1"].success and sorted(os.path.basename(f) for f in got["P1"].output_files) == ["CT.nii.gz", "GTV.nii.gz"]
    assert got["p2"].success and got["p2"].error_type == "ROIMatchError" and "2.2" in got["p2"].error_message
    assert not got["P3"].success and got["P3"].error_type == "LoadError"
    assert [got[k].SampleID for k in ("P1", "p2", "P3")] == ["0000", "0001", "0002"]
    read = lambda name: nifti.decode_image(storage.read_bytes(next(f for f in got["P1"].output_files if f.endswith(name))))
    image, mask = read("CT.nii.gz"), read("GTV.nii.gz")
    assert image[0].shape == mask[0].shape == (NZ, NY, 4) and image[1] == (4.0, 3.0, 4.0) and image[0].max() <= 200 and image[0].min() >= 0
    assert mask[0].dtype == np.uint8 and set(np.unique(mask[0])) == {0, 1}
    said = p.write_reports(spark.createDataFrame(list(got.values())))
    assert said["n_success"] == 2 and json.loads((tmp_path / "reports/summary.json").read_text()) == said
    index = outputs.IndexStore(spark, p.writer.index_path).read()
    assert index.count() == 3 and index.where("ImageID = 'GTV'").head().matched_rois == "GTV 1|GTV 2"


def test_segmentations_and_other_images(spark, collection, tmp_path):
    loader = pipeline.SampleLoader(spark, collection, str(tmp_path), ["CT", "SEG"], {"L": "lesion", "O": "other"}, roi.ROIMatchStrategy.SEPARATE)
    rows = {(r.series, r.image_id): r for r in loader.load(loader.query()).collect()}
    assert set(rows) == {("1.1", "CT"), ("1.3", "L__[lesion]"), ("1.3", "O__[other]")} and rows["1.1", "CT"].is_reference
    dose = pipeline.SampleLoader(spark, collection, str(tmp_path), ["CT", "RTDOSE"])
    assert {r.series for r in dose.load(dose.query()).collect()} == {"1.1", "1.5"}
    strict = pipeline.SampleLoader(spark, collection, str(tmp_path), ["CT", "RTSTRUCT"], {"x": "nothing"}, roi_on_missing=roi.ROIMatchFailurePolicy.ERROR)
    assert {r.error.split(":")[0] for r in strict.load(strict.query()).where("kind = 'mask'").collect()} == {"ROIMatchingError"}
    c = loader.crawler
    assert c.modality("1.4") == "PT" and c.files("1.1").count() == NZ and c.series_info("1.5")["ReferencedModality"] == "CT"
    with pytest.raises(ValueError, match="no series"):
        c.series_info("nope")
    c.write_sinks()
    assert pipeline.load_index(spark, f"{tmp_path}/index.csv").count() == c.index().count()
    with pytest.raises(TypeError):
        pipeline.load_index(spark, 5)


def test_nnunet(spark, collection, tmp_path):
    out = tmp_path / "nn"
    (out / "nnUNet_raw/Dataset001_old").mkdir(parents=True)
    p = nnunet.NNUNetPipeline(spark, collection, str(out), ["CT", "RTSTRUCT"], {"GTV": ["gtv.*"]}, "region")
    got = {r.PatientID: r for r in p.run().collect()}
    name = p.dataset
    folder = out / f"nnUNet_raw/Dataset002_{name}"
    assert got["P1"].success and not got["p2"].success and not got["P3"].success
    assert got["p2"].error_type == "ROIMatchingError" and got["P1"].SampleID == "0001"
    assert sorted(os.listdir(folder / "imagesTr")) == [f"{name}_0001_0000.nii.gz"] and sorted(os.listdir(folder / "labelsTr")) == [f"{name}_0001.nii.gz"]
    manifest = json.loads((folder / "dataset.json").read_text())
    assert manifest["channel_names"] == {"0": "CT"} and manifest["labels"] == {"background": 0, "GTV": [1]} and manifest["numTraining"] == 1 and manifest["regions_class_order"] == [1]
    assert (folder / "nnunet_train.sh").exists()
    with pytest.raises(ValueError, match="not allowed"):
        nnunet.NNUNetPipeline(spark, collection, str(out), ["CT", "PT"], {})
    with pytest.raises(errors.MaskSavingStrategyError):
        nnunet.NNUNetPipeline(spark, collection, str(out), ["CT", "SEG"], {"a": "b"}, "other")


# --- commands and small parts ------------------------------------------------------------------


def test_commands(spark, collection, tmp_path, capsys):
    run = lambda *a: (cli.main(list(a), spark), capsys.readouterr().out)
    assert run("index", "--dicom-dir", collection, "--output-dir", str(tmp_path / "crawl")) == (0, "9 series\n")
    code, out = run("query", collection, "-q", "CT,RTSTRUCT", "--output-dir", str(tmp_path / "crawl"), "--tree", "--html", str(tmp_path / "t.html"))
    assert code == 0 and "CT:1.1,RTSTRUCT:1.2" in out and "P1\n  CT 1.1\n    RTSTRUCT 1.2\n" in out and "    PT 1.4\n" in out and "<b>SEG</b> 1.3" in (tmp_path / "t.html").read_text()
    assert run("find", collection, "P1/ct", "--count")[1] == f"{NZ}\n"
    assert [x.rpartition("/")[2] for x in run("find", collection, "P1/ct", "--sort")[1].split()] == [f"{i:03d}.dcm" for i in range(NZ)]
    assert "level" in run("sort", collection, "%PatientID/%Modality/{SOPInstanceUID}", str(tmp_path / "s"), "--dry-run")[1] and not (tmp_path / "s").exists()
    assert run("sort", collection, "%PatientID/%Modality/{SOPInstanceUID}", str(tmp_path / "s"))[0] == 0 and (tmp_path / "s/P1/RTSTRUCT/1.2.0/000.dcm").exists()
    with pytest.raises(ValueError, match="one target"):
        cli.main(["sort", collection, "%Modality", str(tmp_path / "s")], spark)
    path = f"{collection}/P1/rt/000.dcm"
    assert json.loads(run("show", path)[1])["Modality"] == "RTSTRUCT"
    assert json.loads(run("show", f"{path}::StructureSetROISequence[1].(3006,0026)")[1]) == "GTV 2" and json.loads(run("show", f"{path}::A[0].B")[1]) is None
    code, out = run("autopipeline", collection, str(tmp_path / "auto"), "--modalities", "CT,SEG", "-rmap", "L:les.*", "--spacing", "0,0,0")
    assert code == 0 and json.loads(out)["n_success"] == 1
    code, out = run("nnunet", collection, str(tmp_path / "nn"), "--modalities", "CT,SEG", "-rmap", "L:les.*", "--mask-saving-strategy", "sparse")
    assert code == 0 and json.loads(out)["n_success"] == 1


def test_region_maps(tmp_path):
    (tmp_path / "m.yaml").write_text("# map\nGTV:\n  - 'gtv.*'\n  - tumou?r\nPTV: [ptv1, \"ptv2\"]\ncord: cord # spine\n")
    assert cli.roi_map(["PTV:p.*,q"], str(tmp_path / "m.yaml")) == {"GTV": ["gtv.*", "tumou?r"], "PTV": ["p.*", "q"], "cord": ["cord"]}
    assert cli.roi_map(None) is None
    with pytest.raises(ValueError):
        cli.roi_map(["broken"])


def test_slices(spark, volume, tmp_path):
    import struct
    import zlib

    one = volume.where("series = 'a'")
    mask = one.withColumn("voxels", F.lit((pixels(9) > 500).astype("<f4").tobytes()))
    got = render.slice_images(one, mask, every=2, alpha=0.5).collect()
    assert [r.position for r in got] == [0, 2, 4]
    data = got[1].content
    assert struct.unpack(">II", data[16:24]) == (NX, NY)
    raw = np.frombuffer(zlib.decompress(data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8]), np.uint8).reshape(NY, 1 + 3 * NX)[:, 1:].reshape(NY, NX, 3)
    a = pixels(9).astype(float)
    grey = (a[2] - a.min()) / (a.max() - a.min()) * 255
    assert np.abs(raw[..., 1] - np.where(a[2] > 500, grey / 2, grey)).max() <= 0.51 and np.abs(raw[..., 0] - np.where(a[2] > 500, grey / 2 + 127.5, grey)).max() <= 0.51
    assert all(os.path.exists(r.path.removeprefix("file:")) for r in render.export(render.slice_images(one, axis="x", every=4), str(tmp_path)).collect())


def test_release_download(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/x.txt", "hello")
    doc = {"assets": [{"name": "a.zip", "browser_download_url": (tmp_path / "a.zip").as_uri(), "size": 1}, {"name": "b.txt", "browser_download_url": (tmp_path / "none").as_uri()}]}
    (tmp_path / "release.json").write_text(json.dumps(doc))
    found = remote.assets((tmp_path / "release.json").as_uri())
    assert remote.download(found[:1], str(tmp_path / "d")) == {"a.zip": [str(tmp_path / "d/in/x.txt")]} and (tmp_path / "d/in/x.txt").read_text() == "hello"
    with pytest.raises(OSError):
        remote.download(found[1:], str(tmp_path / "d"), delay=0.0)


def test_projections(spark):
    assert dicom_tags.keys_of("nm") == sorted(dicom_tags.BASE) and "SEG" in dicom_tags.supported_modalities()
    with pytest.raises(errors.ExistingExtractorError):
        dicom_tags.register("ct", ())
    p = dicom.project(dicom.parse(dicom.encode(segmentation("1", "2", ["a"], [[(0, PLANE)]]))))
    assert p["SegSpacing"] == "[3.0, 2.0, 4.0]" and p["SegDirection"] == "[1.0, 0.0, 0.0, 0.0, 1.0, 0.0]" and p["ROINames"] == "[a]" and p["ReferencedSeriesUID"] == "2"
    sr = {"Modality": "SR", "CurrentRequestedProcedureEvidenceSequence": [{"ReferencedSeriesSequence": [{"SeriesInstanceUID": u, "ReferencedSOPSequence": [{"ReferencedSOPInstanceUID": u + ".1"}]} for u in ("2", "1")]}]}
    h = dicom.parse(dicom.encode(sr))
    assert dicom.references(h) == ("1;2", ["1.1", "2.1"], []) and dicom.project(h)["ReferencedSeriesUID"] == "[1, 2]"
    dose = {"Modality": "RTDOSE", "ReferencedRTPlanSequence": [{"ReferencedSOPInstanceUID": "p"}], "ReferencedImageSequence": [{"ReferencedSOPInstanceUID": "s"}]}
    assert dicom.dose_references(dicom.parse(dicom.encode(dose))) == ("p", "", "s")


def test_heads_are_enough(spark, tmp_path):
    h = next(slices("1", "CT", pixels())) | {"PixelData": b"\x00\x01" * 300_000}
    (tmp_path / "a.dcm").write_bytes(dicom.encode(h))
    got = dicom.read_header(str(tmp_path / "a.dcm"), head=64)
    assert got["SeriesInstanceUID"] == "1" and "PixelData" not in got
    assert dicom.parse_rows(spark.createDataFrame([(str(tmp_path / "a.dcm"),)], "path string")).head().Modality == "CT"


def test_validators(spark, tmp_path):
    assert validators.jobs(None, 8) == 6 and validators.jobs(99, 8) == 8 and validators.jobs(3, 8) == 3 and validators.jobs(0, 1) == 1
    assert validators.spacing("1,2,0.5") == (1, 2, 0.5) and validators.modalities("CT,SEG") == ["CT", "SEG"] and validators.modalities("*") is None
    with pytest.raises(ValueError):
        validators.spacing("1,2")
    with pytest.raises(ValueError):
        validators.directory(spark, str(tmp_path / "no"))
    assert os.path.isdir(validators.directory(spark, str(tmp_path / "yes"), create=True)) and validators.max_path_length() > 100 and validators.max_name_length() > 50


def test_util(capsys):
    said = []
    with util.timed("work", said.append) as so_far:
        assert so_far() >= 0
    assert said[0].startswith("work took") and util.timer("f")(lambda x: x + 1)(1) == 2
    assert util.optional_import("json")[1] and util.optional_import("no_such_module") == (None, False)
    with pytest.raises(ImportError, match="needs it"):
        util.optional_import("no_such_module", needed=True)
