"""Queries that write a collection of DICOM files to the shared folder and run the engine on it, and those over headers and transforms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import nested
from ..functions import spatial as G
from ..functions import strings as X
from ..operators import outputs, volumes
from ..sources import dicom, files, series
from . import nnunet, pipeline
from . import views as V
from .catalog import query
from .catalog_images import embeddings, image_headers, structure_header
from .views import table

#: Every 7th patient has no region that matches, every 11th a CT that can't be read.
KINDS = "k AS (SELECT vec_id, 'p' || vec_id AS pid, '1.' || vec_id AS ct, '2.' || vec_id AS rt, vec_id % 7 = 0 AS unmatched, vec_id % 11 = 0 AS broken FROM embeddings)"
NUMBERED = KINDS + ", n AS (SELECT *, lpad((row_number() OVER (ORDER BY pid) - 1 + {first})::VARCHAR, 4, '0') AS sample FROM k)"


def patient(r: dict) -> list[dict]:
    """The headers of a patient: a CT of four slices and a structure set that refers to it."""
    n = r["vec_id"]
    who = {"PatientID": f"p{n}", "StudyInstanceUID": f"9.{n}", "FrameOfReferenceUID": f"8.{n}"}
    scans = [h | who | ({"PixelData": b"\x00\x00"} if n % 11 == 0 else {}) for h in image_headers(r, "CT")]
    rt = structure_header(r)[0] | who | {"SeriesInstanceUID": f"2.{n}", "SOPInstanceUID": f"2.{n}.0"}
    if n % 7 == 0:
        rt["StructureSetROISequence"] = [x | {"ROIName": f"other {i}"} for i, x in enumerate(rt["StructureSetROISequence"])]
    ref = [{"SeriesInstanceUID": f"1.{n}", "ContourImageSequence": [{"ReferencedSOPInstanceUID": f"1.{n}.0"}]}]
    return [*scans, rt | {"ReferencedFrameOfReferenceSequence": [{"RTReferencedStudySequence": [{"RTReferencedSeriesSequence": ref}]}]}]


def collection(spark: SparkSession, sf: str) -> str:
    """A folder with the files of every patient, PATIENT/MODALITY/NUMBER.dcm."""
    folder = storage.qualified(spark, storage.new_folder(spark, "collection"))
    rows = embeddings(spark, sf)
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = 0
            for r in b.itertuples(index=False):
                for i, h in enumerate(patient(dict(zip(names, r, strict=True)))):
                    storage.publish(f"{folder}/{h['PatientID']}/{h['Modality']}/{i}.dcm", dicom.encode(h))
                    n += 1
            yield pd.DataFrame({"n": [n]})

    storage.stored(spark, rows.mapInPandas(run, "n long"), "collection-counts")
    return folder


@query("find_dicoms", "SELECT vec_id, 4::BIGINT AS n_files FROM embeddings")
def find_dicoms(spark, sf):  # noqa: ANN001, ANN201
    found = files.find_dicoms(spark, collection(spark, sf), extension="DCM", check_header=True, search_input=["/CT/", "p"])
    return found.select(F.regexp_extract("path", r"/p(\d+)/CT/", 1).cast("long").alias("vec_id")).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n_files"))


@query(
    "crawl_index",
    f"WITH {KINDS} SELECT pid AS patient, ct AS series, 'CT' AS modality, NULL::VARCHAR AS reference, NULL::VARCHAR AS reference_modality, 4 AS instances FROM k "
    "UNION ALL SELECT pid, rt, 'RTSTRUCT', ct, 'CT', 1 FROM k",
)
def crawl_index(spark, sf):  # noqa: ANN001, ANN201
    c = pipeline.Crawler(spark, collection(spark, sf), storage.new_folder(spark, "crawl"))
    return c.index().select(
        F.col("PatientID").alias("patient"), F.col("SeriesInstanceUID").alias("series"), F.col("Modality").alias("modality"), F.col("ReferencedSeriesUID").alias("reference"),
        F.col("ReferencedModality").alias("reference_modality"), "instances",
    )


@query("crawl_sinks", f"WITH {KINDS} SELECT ct || '.' || z AS sop, ct AS series FROM k, range(4) t(z) UNION ALL SELECT rt || '.0', rt FROM k")
def crawl_sinks(spark, sf):  # noqa: ANN001, ANN201
    out = storage.new_folder(spark, "crawl")
    c = pipeline.Crawler(spark, collection(spark, sf), out)
    c.instances()
    c.write_sinks()
    return spark.read.json(f"{out}/sop_map.json").select(F.col("SOPInstanceUID").alias("sop"), F.col("SeriesInstanceUID").alias("series"))


@query("index_from_csv", f"WITH {V.IDX} SELECT m AS modality, count(*) AS n, count(ref) AS n_ref FROM idx GROUP BY m")
def index_from_csv(spark, sf):  # noqa: ANN001, ANN201
    folder = storage.new_folder(spark, "index-csv")
    ix = V.index(spark, sf)
    text = lambda c: F.col(c).cast("string")
    blank = F.lit("1")
    rows = ix.select(
        text("pid").alias("PatientID"), blank.alias("StudyInstanceUID"), text("uid").alias("SeriesInstanceUID"), blank.alias("SubSeries"), F.col("modality").alias("Modality"),
        F.lit(None).cast("string").alias("ReferencedModality"), text("ref").alias("ReferencedSeriesUID"), F.lit(1).alias("instances"), F.lit("f").alias("folder"),
    )
    rows.write.option("header", True).csv(folder)
    return pipeline.load_index(spark, folder).groupBy(F.col("Modality").alias("modality")).agg(F.count(F.lit(1)).alias("n"), F.count("ReferencedSeriesUID").alias("n_ref"))


def auto(spark: SparkSession, sf: str) -> pipeline.Autopipeline:
    return pipeline.Autopipeline(spark, collection(spark, sf), storage.new_folder(spark, "auto"), modalities=["CT", "RTSTRUCT"], roi_match_map={"GTV": "gtv.*"}, spacing=(0.0, 0.0, 0.0))


@query(
    "autopipeline_results",
    f"WITH {NUMBERED.format(first=0)} SELECT sample, pid AS patient, NOT broken AS success, CASE WHEN broken THEN 'LoadError' WHEN unmatched THEN 'ROIMatchError' END AS error_type, "
    "CASE WHEN broken THEN 0 WHEN unmatched THEN 1 ELSE 2 END AS n_files FROM n",
)
def autopipeline_results(spark, sf):  # noqa: ANN001, ANN201
    r = auto(spark, sf).run()
    return r.select(F.col("SampleID").alias("sample"), F.col("PatientID").alias("patient"), "success", "error_type", F.size("output_files").alias("n_files"))


@query(
    "autopipeline_index",
    f"WITH {NUMBERED.format(first=0)} SELECT sample || '__' || pid || '/CT_Series-' || right(ct, 8) || '/CT.nii.gz' AS filepath, 'CT' AS image, '' AS rois FROM n WHERE NOT broken "
    "UNION ALL SELECT sample || '__' || pid || '/RTSTRUCT_Series-' || right(rt, 8) || '/GTV.nii.gz', 'GTV', 'gtv main|gtv node' FROM n WHERE NOT broken AND NOT unmatched",
)
def autopipeline_index(spark, sf):  # noqa: ANN001, ANN201
    p = auto(spark, sf)
    p.run()
    return outputs.IndexStore(spark, p.writer.index_path).read().select("filepath", F.col("ImageID").alias("image"), F.col("matched_rois").alias("rois"))


@query(
    "nnunet_results",
    f"WITH {NUMBERED.format(first=1)} SELECT sample, pid AS patient, NOT broken AND NOT unmatched AS success, "
    "CASE WHEN broken THEN 'LoadError' WHEN unmatched THEN 'ROIMatchingError' END AS error_type, CASE WHEN broken OR unmatched THEN 0 ELSE 2 END AS n_files FROM n",
)
def nnunet_results(spark, sf):  # noqa: ANN001, ANN201
    p = nnunet.NNUNetPipeline(spark, collection(spark, sf), storage.new_folder(spark, "nnunet"), ["CT", "RTSTRUCT"], {"GTV": ["gtv.*"]}, "sparse")
    r = p.run()
    return r.select(F.col("SampleID").alias("sample"), F.col("PatientID").alias("patient"), "success", "error_type", F.size("output_files").alias("n_files"))


@query("file_sort", f"WITH {KINDS} SELECT pid || '/CT/' || ct || '.' || z || '/' AS folder, 'done' AS status FROM k, range(4) t(z) UNION ALL SELECT pid || '/RTSTRUCT/' || rt || '.0/', 'done' FROM k")
def file_sort(spark, sf):  # noqa: ANN001, ANN201
    out = storage.qualified(spark, storage.new_folder(spark, "sorted"))
    done = pipeline.sort_files(spark, collection(spark, sf), "%PatientID/%Modality/{SOPInstanceUID}", out, "hardlink", truncate=0)
    return done.select(F.regexp_extract(F.expr(f"substring(target, {len(out) + 2})"), r"^(.*/)[^/]*$", 1).alias("folder"), "status")


# --- headers -----------------------------------------------------------------------


def order_headers(spark: SparkSession, sf: str, header) -> DataFrame:  # noqa: ANN001
    rows = storage.spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return dicom.parse_rows(series.encode_slices(rows, lambda r: [header(r)]))


@query("read_tags", "SELECT o_custkey::VARCHAR AS patient, right('1.2.840.' || o_orderkey, 5) AS uid, 'none' AS part FROM orders")
def read_tags(spark, sf):  # noqa: ANN001, ANN201
    rows = order_headers(spark, sf, lambda r: {"PatientID": str(r["o_custkey"]), "SeriesInstanceUID": f"1.2.840.{r['o_orderkey']}", "Modality": "CT"})
    return dicom.read_tags(rows, ["PatientID", "SeriesInstanceUID", "BodyPartExamined"], 5, "none").select(
        F.col("PatientID").alias("patient"), F.col("SeriesInstanceUID").alias("uid"), F.col("BodyPartExamined").alias("part")
    )


@query(
    "reference_uids",
    "SELECT o_orderkey::VARCHAR AS series, CASE o_orderkey % 4 WHEN 0 THEN 'a' || o_custkey WHEN 1 THEN 'd' || o_custkey WHEN 2 THEN '' ELSE 'r' || o_custkey || ';s' || o_custkey END AS reference, "
    "CASE o_orderkey % 4 WHEN 0 THEN 'x,y' WHEN 1 THEN 'p,q' WHEN 2 THEN 't' ELSE 'u,v' END AS sops FROM orders",
)
def reference_uids(spark, sf):  # noqa: ANN001, ANN201
    def header(r: dict) -> dict:
        k, c = r["o_orderkey"] % 4, r["o_custkey"]
        sop = lambda *xs: [{"ReferencedSOPInstanceUID": x} for x in xs]
        more = {
            0: {"Modality": "RTSTRUCT", "ReferencedFrameOfReferenceSequence": [{"RTReferencedStudySequence": [{"RTReferencedSeriesSequence": [{"SeriesInstanceUID": f"a{c}", "ContourImageSequence": sop("x", "y")}]}]}]},
            1: {"Modality": "RTDOSE", "ReferencedImageSequence": sop(f"d{c}"), "ReferencedRTPlanSequence": sop("p"), "ReferencedStructureSetSequence": sop("q")},
            2: {"Modality": "RTPLAN", "ReferencedStructureSetSequence": sop("t")},
            3: {"Modality": "SR", "CurrentRequestedProcedureEvidenceSequence": [{"ReferencedSeriesSequence": [{"SeriesInstanceUID": f"{p}{c}", "ReferencedSOPSequence": sop(s)} for p, s in (("s", "v"), ("r", "u"))]}]},
        }[k]
        return {"SeriesInstanceUID": str(r["o_orderkey"])} | more

    rows = order_headers(spark, sf, header)
    return rows.select(F.col("SeriesInstanceUID").alias("series"), F.col("ReferencedSeriesUID").alias("reference"), F.array_join("ReferencedSOPUIDs", ",").alias("sops"))


@query("header_keys", "SELECT o_orderkey::VARCHAR AS series, CASE o_orderkey % 3 WHEN 0 THEN 67 WHEN 1 THEN 64 ELSE 39 END AS n_keys, o_orderkey % 3 = 0 AS has_kvp FROM orders")
def header_keys(spark, sf):  # noqa: ANN001, ANN201
    rows = order_headers(spark, sf, lambda r: {"SeriesInstanceUID": str(r["o_orderkey"]), "Modality": ("CT", "mr", "XX")[r["o_orderkey"] % 3], "KVP": "120"})
    keys = F.map_keys("hdr")
    return rows.where(F.array_sort(keys) == keys).select(F.col("SeriesInstanceUID").alias("series"), F.size("hdr").alias("n_keys"), F.map_contains_key("hdr", "KVP").alias("has_kvp"))


@query("dicom_magic", "SELECT vec_id, vec_id % 2 = 0 AS magic FROM embeddings")
def dicom_magic(spark, sf):  # noqa: ANN001, ANN201
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"vec_id": b["vec_id"], "content": [dicom.encode({"Modality": "CT", "PatientID": "x" * 200}, preamble=n % 2 == 0) for n in b["vec_id"]]})

    made = table(spark, sf, "embeddings").select("vec_id").mapInPandas(run, "vec_id long, content binary")
    return made.select("vec_id", files.has_magic().alias("magic"))


@query(
    "convert_datetimes",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS study_date, strftime(o_orderdate, '%H:%M:%S') AS study_time, 'soon' AS series_date, ((o_orderkey % 9)::DOUBLE + 0.5)::VARCHAR AS echo_time, "
    "o_custkey::VARCHAR AS patient FROM orders",
)
def convert_datetimes(spark, sf):  # noqa: ANN001, ANN201
    o = table(spark, sf, "orders")
    fields = {"StudyDate": F.date_format("o_orderdate", "yyyyMMdd"), "StudyTime": F.date_format("o_orderdate", "HHmmss"), "SeriesDate": F.lit("soon"), "EchoTime": ((F.col("o_orderkey") % 9) + 0.5).cast("double").cast("string"),
              "PatientID": F.col("o_custkey").cast("string")}
    rows = o.select("o_orderkey", X.convert_datetimes(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])).alias("h"))
    at = lambda k: F.element_at("h", F.lit(k))
    return rows.select("o_orderkey", at("StudyDate").alias("study_date"), at("StudyTime").alias("study_time"), at("SeriesDate").alias("series_date"), at("EchoTime").alias("echo_time"), at("PatientID").alias("patient"))


@query("cleanse_rows", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS price, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS day FROM orders")
def cleanse_rows(spark, sf):  # noqa: ANN001, ANN201
    o = table(spark, sf, "orders")
    return nested.cleanse(o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("price"), F.col("o_orderdate").alias("day")))


# --- vectors, boxes and transforms --------------------------------------------------


@query(
    "vector_arithmetic",
    "SELECT p_partkey, p_size + 3 AS x, p_size - (p_partkey % 5)::INT AS y, (p_size * (p_size + 1) * 4)::BIGINT AS volume, (p_size // 3)::BIGINT AS third, p_size <= 20 OR p_size = 20 AS ordered FROM part",
)
def vector_arithmetic(spark, sf):  # noqa: ANN001, ANN201
    p = table(spark, sf, "part")
    v = G.vec(F.col("p_size"), F.col("p_size"), F.lit(2))
    w = G.vec(F.lit(3), -(F.col("p_partkey") % 5).cast("int"), F.lit(0))
    both = G.each(lambda a, b: a + b, v, w)
    size = G.vec(F.col("p_size"), F.col("p_size") + 1, F.lit(4))
    ordered = G.is_ordered(G.box(v, G.vec(F.lit(20), F.lit(0), F.lit(2)))) | (F.col("p_size") == 20)
    return p.select("p_partkey", both["x"].alias("x"), both["y"].alias("y"), G.volume(size).cast("long").alias("volume"), G.floor_div(size, 3)["x"].cast("long").alias("third"), ordered.alias("ordered"))


@query(
    "box_min_size",
    "WITH b AS (SELECT p_partkey, (p_size % 7)::INT AS lo, (p_size % 7 + p_partkey % 9 + 1)::INT AS hi FROM part), g AS (SELECT *, greatest(6 - (hi - lo), 0) AS lack FROM b) "
    "SELECT p_partkey, greatest(lo - (lack + 1) // 2, 0)::BIGINT AS lo, (hi + lack // 2 + greatest((lack + 1) // 2 - lo, 0))::BIGINT AS hi FROM g",
)
def box_min_size(spark, sf):  # noqa: ANN001, ANN201
    lo = (F.col("p_size") % 7).cast("int")
    hi = (F.col("p_size") % 7 + F.col("p_partkey") % 9 + 1).cast("int")
    b = G.expand_to_min_size(G.box(G.vec(lo, lo, lo), G.vec(hi, hi, hi)), 6)
    return table(spark, sf, "part").select("p_partkey", b["min"]["x"].cast("long").alias("lo"), b["max"]["x"].cast("long").alias("hi"))


#: The sum of values by weight of their place tells where each went.
WEIGHT = "(x + 1) * (y + 5) * (z + 7)"


def placed(rows: DataFrame) -> DataFrame:
    def one(r: dict) -> dict:
        a = volumes.array_of(r["voxels"], r["size"]).astype(float)
        z, y, x = np.meshgrid(*[np.arange(n) for n in a.shape], indexing="ij")
        return {"placed": float((a * (x + 1) * (y + 5) * (z + 7)).sum())}

    out = volumes.map_rows(rows.withColumn("placed", F.lit(None).cast("double")), one)
    return out.select(F.col("series").cast("long").alias("vec_id"), F.round("placed", 4).alias("placed"))


def packed(spark: SparkSession, sf: str) -> DataFrame:
    return volumes.pack(table(spark, sf, "embeddings"), "vec_id", "embedding", (4, 4, 4))


@query("resize_nearest", f"WITH {V.VOX} SELECT series AS vec_id, round(sum(value * (x // 2 + 1) * (y // 2 + 5) * (z + 7)), 4) AS placed FROM vox WHERE x % 2 = 0 AND y % 2 = 0 GROUP BY series")
def resize_nearest(spark, sf):  # noqa: ANN001, ANN201
    return placed(volumes.resize(packed(spark, sf), (2, 2, 0), "nearest"))


@query(
    "zoom_nearest",
    f"WITH {V.VOX}, g AS (SELECT a.i AS x, b.i AS y, c.i AS z, [1, 1, 2, 2][a.i + 1] AS fx, [1, 1, 2, 2][b.i + 1] AS fy, [1, 1, 2, 2][c.i + 1] AS fz FROM range(4) a(i), range(4) b(i), range(4) c(i)) "
    f"SELECT v.series AS vec_id, round(sum(v.value * (g.x + 1) * (g.y + 5) * (g.z + 7)), 4) AS placed FROM g JOIN vox v ON v.x = fx AND v.y = fy AND v.z = fz GROUP BY v.series",
)
def zoom_nearest(spark, sf):  # noqa: ANN001, ANN201
    return placed(volumes.zoom(packed(spark, sf), 2.0, "nearest"))


@query("rotate_quarter", f"WITH {V.VOX} SELECT series AS vec_id, round(sum(value * (y + 1) * (3 - x + 5) * (z + 7)), 4) AS placed FROM vox GROUP BY series")
def rotate_quarter(spark, sf):  # noqa: ANN001, ANN201
    return placed(volumes.rotate(packed(spark, sf), (1.5, 1.5, 1.5), (0.0, 0.0, float(np.pi / 2)), "nearest"))


@query("transform_callable", f"WITH {V.VOX} SELECT series AS vec_id, round(sum(least(greatest(value, -0.125::DOUBLE), 0.125::DOUBLE) * {WEIGHT}), 4) AS placed FROM vox GROUP BY series")
def transform_callable(spark, sf):  # noqa: ANN001, ANN201
    return placed(volumes.map_images(packed(spark, sf), lambda a, low, high: np.clip(a.astype(float), low, high), low=-0.125, high=0.125))


# --- an index that follows its files ------------------------------------------------


@query(
    "live_index",
    f"WITH {V.SERIES}, held AS (SELECT s.* FROM series s WHERE sid IN (SELECT l_orderkey FROM lineitem)), ct AS (SELECT pid, min(sid::VARCHAR) AS ct FROM held WHERE m = 'CT' GROUP BY pid) "
    "SELECT h.sid::VARCHAR AS series, h.m AS modality, CASE WHEN h.m IN ('SEG', 'RTSTRUCT', 'RTPLAN') THEN p.sid::VARCHAR WHEN h.m = 'PT' THEN ct.ct END AS reference, CASE WHEN h.m IN ('SEG', 'RTSTRUCT', 'RTPLAN') THEN p.m WHEN h.m = 'PT' AND ct.ct IS NOT NULL THEN 'CT' END AS referenced "
    "FROM held h LEFT JOIN held p ON p.sid = h.sid - 1 AND p.sid IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) LEFT JOIN ct ON ct.pid = h.pid",
)
def live_index(spark, sf):  # noqa: ANN001, ANN201
    """Line items as instances that arrive in three batches, those that refer to others first."""
    from ..streaming.live import LiveIndex

    uid = F.col("l_orderkey").cast("string")
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("string").alias("PatientID")), "l_orderkey")
    sop = lambda series, n: F.concat_ws(".", series.cast("string"), n.cast("string"))
    rows = line.select(
        F.concat_ws("/", uid, F.lpad(F.col("l_linenumber").cast("string"), 2, "0")).alias("path"), "PatientID", F.lit("S").alias("StudyInstanceUID"), uid.alias("SeriesInstanceUID"), sop(F.col("l_orderkey"), F.col("l_linenumber")).alias("SOPInstanceUID"),
        V.modality("l_orderkey").alias("Modality"), F.lit("1").alias("AcquisitionNumber"), F.col("PatientID").alias("FrameOfReferenceUID"), F.lit("").alias("ReferencedSeriesUID"), F.array(sop(F.col("l_orderkey") - 1, F.lit(1))).alias("ReferencedSOPUIDs"), F.lit(None).cast("string").alias("error"),
    )
    index = LiveIndex(spark, storage.new_folder(spark, "live"), 8)
    for n, among in enumerate((("RTPLAN", "RTSTRUCT", "PT"), ("SEG", "RTDOSE"), ("CT", "MR"))):
        index.apply(rows.where(F.col("Modality").isin(*among)), n)
    found = index.read()
    return found.select(F.col("SeriesInstanceUID").alias("series"), F.col("Modality").alias("modality"), F.col("ReferencedSeriesUID").alias("reference"), F.nullif("ReferencedModality", F.lit("")).alias("referenced")).distinct()
