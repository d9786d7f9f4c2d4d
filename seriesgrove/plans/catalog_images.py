"""Queries over encoded DICOM files: each embedding becomes a series of 4 x 4 x 4 voxels, encoded, read back and worked on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spatial as G
from ..operators import forest, roi, volumes, voxel
from ..sources import dicom, pixels, series, structures
from ..storage import spread
from . import views as V
from .catalog import query, r4
from .views import table

#: The stored values and the place of a voxel.
STORED = """st AS (SELECT vec_id, i, (i // 16)::BIGINT AS z, ((i // 4) % 4)::BIGINT AS y, (i % 4)::BIGINT AS x,
  floor(embedding[i + 1]::DOUBLE * 1000 + 0.5::DOUBLE)::BIGINT AS v FROM embeddings, range(64) t(i))"""
GAP, ORIGIN = 2.5, (-10.0, 5.0, 100.0)


def stored_values(embedding) -> np.ndarray:  # noqa: ANN001
    return np.floor(np.asarray(embedding, np.float64) * 1000 + 0.5).astype("<i2").reshape(4, 4, 4)


def image_headers(r: dict, modality: str, flip: bool = False, **more: object) -> list[dict]:
    """Headers of the slices of an embedding, from the last slice to the first."""
    a, uid = stored_values(r["embedding"]), f"1.{r['vec_id']}"
    orientation = ["1", "0", "0", "0", "-1", "0"] if flip else ["1", "0", "0", "0", "1", "0"]
    base = {
        "SeriesInstanceUID": uid, "Modality": modality, "AcquisitionNumber": "1", "Rows": 4, "Columns": 4, "BitsAllocated": 16, "PixelRepresentation": 1, "SamplesPerPixel": 1,
        "PixelSpacing": ["1.5", "0.5"], "ImageOrientationPatient": orientation, "SliceThickness": str(GAP),
    } | more
    place = lambda z: [str(ORIGIN[0]), str(ORIGIN[1]), str(ORIGIN[2] + (-GAP if flip else GAP) * z)]
    return [base | {"SOPInstanceUID": f"{uid}.{z}", "InstanceNumber": str(z), "ImagePositionPatient": place(z), "PixelData": a[z].tobytes()} for z in (3, 1, 2, 0)]


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Dealt to all tasks: a small file is much work here."""
    return spread(table(spark, sf, "embeddings").select("vec_id", "embedding", "label"), "vec_id")


def read_back(spark: SparkSession, sf: str, headers, **options: object) -> DataFrame:  # noqa: ANN001
    return series.load_series(series.encode_slices(embeddings(spark, sf), headers), **options)


def numbered(rows: DataFrame) -> DataFrame:
    """With vec_id in place of the series UID."""
    return rows.withColumn("vec_id", F.regexp_extract("series", r"^1\.(\d+)", 1).cast("long")).drop("series")


@query(
    "dicom_ct_volume",
    f"WITH {STORED} SELECT vec_id, min(v * 2 - 100)::DOUBLE AS v_min, max(v * 2 - 100)::DOUBLE AS v_max, sum(v * 2 - 100)::DOUBLE AS v_sum, sum((v * 2 - 100) * (z + 1) * (y + 2) * (x + 3))::DOUBLE AS placed, "
    "'0.5,1.5,2.5' AS spacing, '-10.0,5.0,100.0' AS origin, count(*)::BIGINT AS n_voxels FROM st GROUP BY vec_id",
)
def dicom_ct_volume(spark, sf):  # noqa: ANN001, ANN201
    rows = read_back(spark, sf, lambda r: image_headers(r, "CT", RescaleSlope="2", RescaleIntercept="-100"))
    z, y, x = np.meshgrid(np.arange(4) + 1, np.arange(4) + 2, np.arange(4) + 3, indexing="ij")
    weight = (z * y * x).astype("<f8")
    placed = volumes.map_rows(rows.withColumn("placed", F.lit(None).cast("double")), lambda r: {"placed": float((volumes.array_of(r["voxels"], r["size"]).astype(float) * weight).sum())})
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return numbered(volumes.fingerprint(placed, ("placed",)).select("series", "placed", text("spacing").alias("spacing"), text("origin").alias("origin"), "v_min", "v_max", "v_sum", "n_voxels"))


def encapsulated_headers(r: dict) -> list[dict]:
    """Slices by run lengths, lossless JPEG of any prediction, deflated and big-endian, in turn by series."""
    k = r["vec_id"] % 10
    out = []
    for h in image_headers(r, "CT", RescaleSlope="2", RescaleIntercept="-100"):
        a = np.frombuffer(h["PixelData"], "<i2").reshape(4, 4)
        stored = a.view("<u2")
        syntax, data = (
            (pixels.LOSSLESS, pixels.encapsulated([pixels.encode_lossless(stored, k + 1)])) if k < 7 else (pixels.RUN_LENGTH, pixels.encapsulated([pixels.encode_runs(stored)])) if k == 7
            else (pixels.DEFLATED, a.tobytes()) if k == 8 else (pixels.BIG, a.astype(">i2").tobytes())
        )
        out.append(h | {"TransferSyntaxUID": syntax, "PixelData": data})
    return out


def values_of(rows: DataFrame) -> DataFrame:
    """series, n_voxels, least, greatest and total of the values, and a total that weighs places."""
    z, y, x = np.meshgrid(np.arange(4) + 1, np.arange(4) + 2, np.arange(4) + 3, indexing="ij")
    weight = (z * y * x).astype("<f8")
    placed = volumes.map_rows(rows.withColumn("placed", F.lit(None).cast("double")), lambda r: {"placed": float((volumes.array_of(r["voxels"], r["size"]).astype(float) * weight).sum())})
    return volumes.fingerprint(placed, ("placed",)).select("series", "placed", "v_min", "v_max", "v_sum", "n_voxels")


@query(
    "dicom_compressed_volume",
    f"WITH {STORED} SELECT vec_id, min(v * 2 - 100)::DOUBLE AS v_min, max(v * 2 - 100)::DOUBLE AS v_max, sum(v * 2 - 100)::DOUBLE AS v_sum, sum((v * 2 - 100) * (z + 1) * (y + 2) * (x + 3))::DOUBLE AS placed, "
    "count(*)::BIGINT AS n_voxels FROM st GROUP BY vec_id",
)
def dicom_compressed_volume(spark, sf):  # noqa: ANN001, ANN201
    return numbered(values_of(read_back(spark, sf, encapsulated_headers)))


@query(
    "dicom_uneven_series",
    "SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'steps between slices from 2.5 to 5' WHEN 1 THEN '1 slices stand at another''s place' WHEN 2 THEN 'the slices'' orientations differ' END AS geometry FROM embeddings",
)
def dicom_uneven_series(spark, sf):  # noqa: ANN001, ANN201
    def headers(r: dict) -> list[dict]:
        k, out = r["vec_id"] % 4, image_headers(r, "CT")
        if k == 0:
            return [h for h in out if h["InstanceNumber"] != "1"]
        if k == 1:
            return [*out, out[1] | {"SOPInstanceUID": "again"}]
        return [h | {"ImageOrientationPatient": ["0", "1", "0", "1", "0", "0"]} if k == 2 and h["InstanceNumber"] == "3" else h for h in out]

    return numbered(read_back(spark, sf, headers).select("series", F.element_at("meta", F.lit("geometry")).alias("geometry")))


@query("dicom_scan_direction", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN '1,0,0,0,-1,0,0,0,1' WHEN vec_id % 3 = 1 THEN '1,0,0,0,-1,0,0,0,-1' ELSE '1,0,0,0,1,0,0,0,1' END AS direction FROM embeddings")
def dicom_scan_direction(spark, sf):  # noqa: ANN001, ANN201
    def headers(r: dict) -> list[dict]:
        k = r["vec_id"] % 3
        return image_headers(r, "MR", flip=k < 2, SpacingBetweenSlices="-2.5" if k == 0 else "2.5")

    rows = read_back(spark, sf, headers)
    return numbered(rows.select("series", F.array_join(F.transform("direction", lambda v: F.rint(v).cast("int").cast("string")), ",").alias("direction")))


@query("dicom_pet_suv", f"WITH {STORED} SELECT vec_id, sum(abs(v * (vec_id % 4 + 1) * 0.25::DOUBLE)) AS v_sum, min(abs(v * (vec_id % 4 + 1) * 0.25::DOUBLE)) AS v_min FROM st GROUP BY vec_id")
def dicom_pet_suv(spark, sf):  # noqa: ANN001, ANN201
    rows = read_back(spark, sf, lambda r: image_headers(r, "PT", **{"70531000": str((r["vec_id"] % 4 + 1) * 0.25), "70531009": "9"}))
    return numbered(volumes.fingerprint(rows).select("series", "v_sum", "v_min"))


@query("dicom_pet_act", f"WITH {STORED} SELECT vec_id, sum(abs(v * 1.0::DOUBLE)) AS v_sum FROM st GROUP BY vec_id")
def dicom_pet_act(spark, sf):  # noqa: ANN001, ANN201
    rows = read_back(spark, sf, lambda r: image_headers(r, "PT", **{"70531000": "5"}), pet_image_type=series.PETImageType.ACT)
    return numbered(volumes.fingerprint(rows).select("series", "v_sum"))


@query("dicom_dose", f"WITH {STORED} SELECT vec_id, sum(v * 0.125::DOUBLE) AS v_sum, max(v * 0.125::DOUBLE) AS v_max, 'GY' AS units FROM st GROUP BY vec_id")
def dicom_dose(spark, sf):  # noqa: ANN001, ANN201
    def headers(r: dict) -> list[dict]:
        first = image_headers(r, "RTDOSE")[-1]
        return [first | {"NumberOfFrames": "4", "PixelData": stored_values(r["embedding"]).tobytes(), "DoseGridScaling": "0.125", "DoseUnits": "GY", "DoseType": "PHYSICAL", "GridFrameOffsetVector": ["0", "2.5", "5", "7.5"]}]

    rows = read_back(spark, sf, headers).withColumn("units", F.element_at("meta", F.lit("DoseUnits")))
    return numbered(volumes.fingerprint(rows, ("units",)).select("series", "v_sum", "v_max", "units"))


@query("dicom_subseries", f"WITH {STORED} SELECT vec_id, (z % 2 + 1)::VARCHAR AS sub_series, sum(v)::DOUBLE AS v_sum, count(*)::BIGINT AS n_voxels FROM st GROUP BY ALL")
def dicom_subseries(spark, sf):  # noqa: ANN001, ANN201
    def headers(r: dict) -> list[dict]:
        return [h | {"AcquisitionNumber": str(int(h["InstanceNumber"]) % 2 + 1)} for h in image_headers(r, "CT")]

    return numbered(volumes.fingerprint(read_back(spark, sf, headers, load_subseries=True)).select("series", "sub_series", "v_sum", "n_voxels"))


@query("dicom_load_errors", "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'InvalidDicomError' WHEN vec_id % 5 = 1 THEN 'ValueError' END AS error FROM embeddings")
def dicom_load_errors(spark, sf):  # noqa: ANN001, ANN201
    def headers(r: dict) -> list[dict]:
        k = r["vec_id"] % 5
        return [h | ({"PixelData": b"\x00\x00"} if k == 0 else {}) for h in image_headers(r, "OT" if k == 1 else "CT")]

    rows = read_back(spark, sf, headers)
    return numbered(rows.select("series", F.nullif(F.regexp_extract("error", r"^LoadError: (\w+)", 1), F.lit("")).alias("error")))


# --- structure sets and segmentations -----------------------------------------


def structure_header(r: dict) -> list[dict]:
    """Squares of a side from the label: two on one region, one on another, a point as a third."""
    k = int(r["label"]) % 3

    def square(x: int, side: int, z: int) -> list[str]:
        corners = ((x, 0), (x + side, 0), (x + side, side), (x, side))
        return [str(v) for i, j in corners for v in (ORIGIN[0] + 0.5 * i, ORIGIN[1] + 1.5 * j, ORIGIN[2] + GAP * z)]

    closed = lambda p: {"ContourGeometricType": "CLOSED_PLANAR", "ContourData": p}
    contours = [[closed(square(0, k, 0)), closed(square(0, 1, 2))], [closed(square(1, 2, 1))], [{"ContourGeometricType": "POINT", "ContourData": ["0", "0", "0"]}]]
    names = ["gtv main", "gtv node", "marker"]
    return [{
        "SeriesInstanceUID": f"1.{r['vec_id']}", "SOPInstanceUID": f"1.{r['vec_id']}.0", "Modality": "RTSTRUCT", "AcquisitionNumber": "1",
        "StructureSetROISequence": [{"ROINumber": str(i + 1), "ROIName": n} for i, n in enumerate(names)],
        "ROIContourSequence": [{"ReferencedROINumber": str(i + 1), "ContourSequence": c} for i, c in enumerate(contours)],
    }]


def segment_header(r: dict) -> list[dict]:
    """Two segments: embeddings above 0.1 and below -0.1, a frame per slice that holds any."""
    a = np.asarray(r["embedding"], np.float64).reshape(4, 4, 4)
    frames = [(k, z, m[z]) for k, m in enumerate((a > 0.1, a < -0.1)) for z in range(4) if m[z].any()]
    bits = np.concatenate([m.ravel() for _, _, m in frames]).astype(np.uint8) if frames else np.zeros(0, np.uint8)
    place = lambda z: [str(ORIGIN[0]), str(ORIGIN[1]), str(ORIGIN[2] + GAP * z)]
    return [{
        "SeriesInstanceUID": f"1.{r['vec_id']}", "SOPInstanceUID": f"1.{r['vec_id']}.0", "Modality": "SEG", "AcquisitionNumber": "1", "SegmentationType": "BINARY", "Rows": 4, "Columns": 4, "BitsAllocated": 1,
        "NumberOfFrames": str(len(frames)), "SegmentSequence": [{"SegmentNumber": 1, "SegmentLabel": "high"}, {"SegmentNumber": 2, "SegmentLabel": "low"}],
        "PerFrameFunctionalGroupsSequence": [
            {"SegmentIdentificationSequence": [{"ReferencedSegmentNumber": k + 1}], "PlanePositionSequence": [{"ImagePositionPatient": place(z)}]} for k, z, _ in frames
        ],
        "PixelData": np.packbits(bits, bitorder="little").tobytes(),
    }]


def regions(spark: SparkSession, sf: str, header) -> DataFrame:  # noqa: ANN001
    return structures.read_regions(series.encode_slices(embeddings(spark, sf), header))


def grids(spark: SparkSession, sf: str) -> DataFrame:
    fixed = lambda vs, kind: F.array(*[F.lit(v) for v in vs]).cast(f"array<{kind}>")
    uid = F.concat(F.lit("1."), F.col("vec_id").cast("string")).alias("series")
    return table(spark, sf, "embeddings").select(uid, fixed((4, 4, 4), "int").alias("size"), fixed(ORIGIN, "double").alias("origin"), fixed((0.5, 1.5, GAP), "double").alias("spacing"), fixed(volumes.IDENTITY, "double").alias("direction"))


def masks(spark: SparkSession, sf: str, header, names: dict) -> DataFrame:  # noqa: ANN001
    found = regions(spark, sf, header)
    matched = roi.match(found.where("roi is not null"), roi.pattern_rows(spark, names))
    return structures.masks(found, matched, grids(spark, sf))


@query("rtstruct_regions", "SELECT vec_id, roi, CASE WHEN roi = 'marker' THEN 'ROIContourExtractionError' END AS error, n::BIGINT AS n_contours FROM embeddings, (VALUES ('gtv main', 2), ('gtv node', 1), ('marker', NULL)) t(roi, n)")
def rtstruct_regions(spark, sf):  # noqa: ANN001, ANN201
    found = regions(spark, sf, structure_header)
    error = F.nullif(F.regexp_extract("error", r"^(\w+)", 1), F.lit(""))
    return numbered(found.select("series", "roi", error.alias("error"), F.when(F.col("contours").isNotNull(), F.size("contours")).cast("long").alias("n_contours")))


#: Voxels of the squares: outlines count; slice 1 holds a square of side 2 from x = 1, cut by nothing.
SQUARES = "WITH k AS (SELECT vec_id, label % 3 AS k FROM embeddings)"


@query("rtstruct_masks", SQUARES + " SELECT vec_id, 'gtv' AS roi_key, 'gtv main|gtv node' AS roi_names, ((k + 1) * (k + 1) + 4 + 9)::BIGINT AS n_voxels, 1 AS channel FROM k")
def rtstruct_masks(spark, sf):  # noqa: ANN001, ANN201
    rows = masks(spark, sf, structure_header, {"gtv": ["gtv.*"], "none": ["marker"]})
    count = structures.to_voxels(rows).groupBy("series").agg(F.count(F.lit(1)).alias("n_voxels"))
    return numbered(rows.select("series", "roi_key", F.array_join("roi_names", "|").alias("roi_names"), "channel").join(count, "series"))


@query(
    "rtstruct_reordered",
    "SELECT vec_id, roi, CASE WHEN roi = 'marker' OR (roi = 'gtv node' AND vec_id % 3 = 0) THEN 'ROIContourExtractionError' END AS error, CASE WHEN vec_id % 3 > 0 OR n = 2 THEN n END::BIGINT AS n_contours "
    "FROM embeddings, (VALUES ('gtv main', 2), ('gtv node', 1), ('marker', NULL)) t(roi, n)",
)
def rtstruct_reordered(spark, sf):  # noqa: ANN001, ANN201
    """Contour items in another order than the names, or without those of one region."""

    def header(r: dict) -> list[dict]:
        h = structure_header(r)[0]
        main, node, marker = h["ROIContourSequence"]
        return [h | {"ROIContourSequence": ([marker, main], [marker, node, main], [main, node, marker])[r["vec_id"] % 3]}]

    found = regions(spark, sf, header)
    error = F.nullif(F.regexp_extract("error", r"^(\w+)", 1), F.lit(""))
    return numbered(found.select("series", "roi", error.alias("error"), F.when(F.col("contours").isNotNull(), F.size("contours")).cast("long").alias("n_contours")))


SEGMENTS = "(SELECT vec_id, i, CASE WHEN embedding[i + 1]::DOUBLE > 0.1::DOUBLE THEN 'high' WHEN embedding[i + 1]::DOUBLE < -0.1::DOUBLE THEN 'low' END AS roi_key FROM embeddings, range(64) t(i))"


@query("seg_masks", f"SELECT vec_id, roi_key, count(*)::BIGINT AS n_voxels, sum(i)::BIGINT AS place FROM {SEGMENTS} WHERE roi_key IS NOT NULL GROUP BY ALL")
def seg_masks(spark, sf):  # noqa: ANN001, ANN201
    rows = masks(spark, sf, segment_header, {"high": ["high"], "low": ["low"]})
    place = F.sum(F.col("z") * 16 + F.col("y") * 4 + F.col("x")).alias("place")
    count = structures.to_voxels(rows).groupBy("series", "channel").agg(F.count(F.lit(1)).alias("n_voxels"), place)
    return numbered(rows.select("series", "roi_key", "channel").join(count, ["series", "channel"]).drop("channel"))


@query("seg_label_image", f"SELECT vec_id, sum(CASE roi_key WHEN 'high' THEN 1 WHEN 'low' THEN 2 END * (i + 1))::DOUBLE AS total FROM {SEGMENTS} WHERE roi_key IS NOT NULL GROUP BY vec_id HAVING count(DISTINCT roi_key) = 2")
def seg_label_image(spark, sf):  # noqa: ANN001, ANN201
    made = structures.encode_mask(masks(spark, sf, segment_header, {"high": ["high"], "low": ["low"]}), ["high", "low"]).where("error is null")
    total = volumes.map_rows(made.withColumn("total", F.lit(None).cast("double")), lambda r: {"total": float((np.frombuffer(r["voxels"], "<f4").astype(float) * (np.arange(64) + 1)).sum())})
    return numbered(total.select("series", "total"))


@query("mask_crop", f"WITH {V.VOX} SELECT series AS vec_id, round(sum(value), 4) AS total, -9.5::DOUBLE AS x, 8.0::DOUBLE AS y, 102.5::DOUBLE AS z FROM vox WHERE x BETWEEN 1 AND 2 AND y BETWEEN 2 AND 3 AND z BETWEEN 1 AND 3 GROUP BY series")
def mask_crop(spark, sf):  # noqa: ANN001, ANN201
    v = volumes.pack(table(spark, sf, "embeddings"), "vec_id", "embedding", (4, 4, 4), (0.5, 1.5, GAP)).withColumn("origin", F.array(*[F.lit(x) for x in ORIGIN]))
    cut = volumes.crop_box(v.withColumn("box_min", F.array(F.lit(1), F.lit(2), F.lit(1))).withColumn("box_max", F.array(F.lit(3), F.lit(4), F.lit(4))))
    at = [F.get("origin", F.lit(i)).alias(a) for i, a in enumerate("xyz")]
    return volumes.fingerprint(cut).select(F.col("series").cast("long").alias("vec_id"), r4("v_sum").alias("total"), *at)


@query(
    "fingerprint_dense",
    f"WITH {V.VOX} SELECT series AS vec_id, min(value) AS v_min, max(value) AS v_max, round(sum(value), 4) AS v_sum, round(stddev_samp(value), 4) AS v_std, count(*)::BIGINT AS n_voxels, '4,4,4' AS size FROM vox GROUP BY series",
)
def fingerprint_dense(spark, sf):  # noqa: ANN001, ANN201
    f = volumes.fingerprint(volumes.pack(table(spark, sf, "embeddings"), "vec_id", "embedding", (4, 4, 4)))
    return f.select(F.col("series").cast("long").alias("vec_id"), "v_min", "v_max", r4("v_sum").alias("v_sum"), r4("v_std").alias("v_std"), "n_voxels", F.array_join(F.transform("size", lambda n: n.cast("string")), ",").alias("size"))


# --- geometry -------------------------------------------------------------------


@query("centroid_box", f"WITH {V.MASK}, c AS (SELECT series, channel, floor(avg(x) + 0.5) AS x, floor(avg(y) + 0.5) AS y, floor(avg(z) + 0.5) AS z FROM mask GROUP BY ALL) "
       "SELECT series, channel, greatest(x - 2, 0)::BIGINT AS x0, (x + 1 + greatest(2 - x, 0))::BIGINT AS x1, greatest(z - 2, 0)::BIGINT AS z0, (z + 1 + greatest(2 - z, 0))::BIGINT AS z1 FROM c")  # fmt: skip
def centroid_box(spark, sf):  # noqa: ANN001, ANN201
    c = voxel.centroid(V.masks(spark, sf))
    at = G.vec(*[F.floor(F.col(f"c_{a}") + 0.5).cast("long") for a in "xyz"])
    b = c.select("series", "channel", G.centroid_box(at, 3).alias("b"))
    return b.select("series", "channel", F.col("b.min.x").alias("x0"), F.col("b.max.x").alias("x1"), F.col("b.min.z").alias("z0"), F.col("b.max.z").alias("z1"))


@query("image_boundaries", "SELECT p_partkey, 0 AS x0, p_size AS x1, (p_retailprice + 2 * p_size)::DOUBLE AS world_z1 FROM part")
def image_boundaries(spark, sf):  # noqa: ANN001, ANN201
    p = table(spark, sf, "part")
    size = G.vec(F.col("p_size"), F.col("p_size") + 1, F.col("p_size") * 2)
    world = G.boundaries(size, G.vec3(0.0, 0.0, F.col("p_retailprice")))
    return p.select("p_partkey", G.boundaries(size)["min"]["x"].alias("x0"), G.boundaries(size)["max"]["x"].alias("x1"), world["max"]["z"].alias("world_z1"))


@query(
    "directed_index",
    "SELECT l_orderkey, l_linenumber, floor((l_quantity - 3) / 2 + 0.5)::BIGINT AS x, floor((l_tax * 100 - 1) / 4 + 0.5)::BIGINT AS y, floor((l_discount * 100 + 5) / 0.5 + 0.5)::BIGINT AS z FROM lineitem",
)
def directed_index(spark, sf):  # noqa: ANN001, ANN201
    point = G.vec3(F.rint(F.col("l_discount") * 100), F.col("l_quantity"), F.rint(F.col("l_tax") * 100))  # physical x, y, z are index z, x, y
    d = F.array(*[F.lit(float(v)) for v in (0, 0, 1, 1, 0, 0, 0, 1, 0)])
    at = G.directed_index(point, G.vec3(-5.0, 3.0, 1.0), G.vec3(2.0, 4.0, 0.5), d)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", at["x"].alias("x"), at["y"].alias("y"), at["z"].alias("z"))


@query("parse_spacing", "SELECT c_custkey, c_acctbal AS x, (c_custkey % 7)::DOUBLE AS y, 0.5::DOUBLE AS z FROM customer")
def parse_spacing(spark, sf):  # noqa: ANN001, ANN201
    text = F.concat_ws(",", F.col("c_acctbal").cast("string"), (F.col("c_custkey") % 7).cast("string"), F.lit("0.5"))
    return table(spark, sf, "customer").select("c_custkey", G.parse_vec3(text).alias("v")).select("c_custkey", "v.x", "v.y", "v.z")


@query("roots_by_patient", f"WITH {V.IDX} SELECT pid, string_agg(m || ':' || sid, ',' ORDER BY sid) AS roots FROM idx WHERE m IN ('CT','MR') OR (m = 'PT' AND ref IS NULL) GROUP BY pid")
def roots_by_patient(spark, sf):  # noqa: ANN001, ANN201
    found = forest.by_patient(forest.SeriesForest(V.index(spark, sf)).roots())
    return found.select("pid", forest.members_text("roots").alias("roots"))


@query("header_projection", "SELECT vec_id, '[3.0, 2.0, 4.0]' AS spacing, '2' AS rois, vec_id::VARCHAR || '.9' AS reference FROM embeddings")
def header_projection(spark, sf):  # noqa: ANN001, ANN201
    def headers(r: dict) -> list[dict]:
        h = {"SeriesInstanceUID": f"1.{r['vec_id']}", "Modality": "SEG", "ReferencedSeriesSequence": [{"SeriesInstanceUID": f"{r['vec_id']}.9"}], "SegmentSequence": [{"SegmentNumber": i, "SegmentLabel": f"s{i}"} for i in (1, 2)],
             "SharedFunctionalGroupsSequence": [{"PixelMeasuresSequence": [{"PixelSpacing": ["3.0", "2.0"], "SliceThickness": "4"}]}]}
        return [h]

    rows = dicom.parse_rows(series.encode_slices(embeddings(spark, sf), headers))
    found = rows.select(F.col("SeriesInstanceUID").alias("series"), F.element_at("hdr", F.lit("SegSpacing")).alias("spacing"), F.size("ROINames").cast("string").alias("rois"), F.col("ReferencedSeriesUID").alias("reference"))
    return numbered(found)
