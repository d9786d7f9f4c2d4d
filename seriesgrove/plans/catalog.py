"""The registered queries of the engine and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import spatial as G
from ..functions import strings as X
from ..operators import crawl, forest, outputs, roi, synthetic, voxel
from ..operators.forest import SeriesForest, members_text
from ..storage import spread
from . import views as V
from .views import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}

MAP = {"GTV": ["red .*"], "PTV": ["blue .*", ".* widget"], "TV": ["red .*", "green .*"]}
PATTERNS = [(i, k, j, p) for i, (k, ps) in enumerate(MAP.items()) for j, p in enumerate(ps)]
PATS = "pats(kp, key, pp, pat) AS (VALUES " + ", ".join(f"({i}, '{k}', {j}, '{p}')" for i, k, j, p in PATTERNS) + ")"
HITS = V.ROIS + ", " + PATS + ", hit AS (SELECT series, kp, key, pp, roi FROM rois, pats WHERE regexp_full_match(roi, pat, 'i'))"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _ORACLE[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import catalog_files, catalog_images, catalog_shapes  # noqa: F401  register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalog_files, catalog_images, catalog_shapes  # noqa: F401

    return dict(_ORACLE)


def r4(c: str | F.Column) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 4) + 0.0  # no negative zero


def _forest(spark: SparkSession, sf: str) -> SeriesForest:
    return SeriesForest(V.index(spark, sf))


# --- crawl -------------------------------------------------------------------


@query("index_slim", f"WITH {V.LINES} SELECT sid AS series, acq AS sub_series, min(path) AS first_path, count(DISTINCT sop) AS instances FROM line GROUP BY ALL")
def index_slim(spark, sf):  # noqa: ANN001, ANN201
    g = crawl.group_series(V.instances(spark, sf))
    return g.select(F.col("SeriesInstanceUID").alias("series"), F.col("SubSeries").alias("sub_series"), F.col("path").alias("first_path"), F.col("instances").cast("long").alias("instances"))


@query(
    "index_dedup_keep_first",
    f"WITH {V.LINES}, g AS (SELECT sid AS series, acq AS sub_series, count(DISTINCT sop) AS instances FROM line GROUP BY ALL) "
    "SELECT series, instances, min(sub_series) AS sub_series FROM g GROUP BY ALL",
)
def index_dedup(spark, sf):  # noqa: ANN001, ANN201
    g = index_slim(spark, sf).drop("first_path")
    return crawl.keep_first(g, ["series", "instances"], "sub_series")


@query("duplicate_rows", f"WITH {V.LINES}, g AS (SELECT sid AS series, acq, count(DISTINCT sop) AS instances FROM line GROUP BY ALL) SELECT series, instances, count(*) AS n FROM g GROUP BY ALL HAVING count(*) > 1")
def duplicate_rows(spark, sf):  # noqa: ANN001, ANN201
    return forest.duplicate_rows(index_slim(spark, sf), ["series", "instances"])


@query("sop_map", f"WITH {V.LINES} SELECT sop, max_by(sid, path) AS series FROM line GROUP BY sop")
def sop_map(spark, sf):  # noqa: ANN001, ANN201
    return crawl.sop_map(V.instances(spark, sf)).select(F.col("SOPInstanceUID").alias("sop"), F.col("SeriesInstanceUID").alias("series"))


@query("instance_count", f"WITH {V.LINES} SELECT sid AS series, count(DISTINCT sop) AS n_instances FROM line GROUP BY sid")
def instance_count(spark, sf):  # noqa: ANN001, ANN201
    return crawl.instance_counts(V.instances(spark, sf)).withColumnRenamed("SeriesInstanceUID", "series")


def _series(spark, sf):  # noqa: ANN001, ANN202
    ix = V.index(spark, sf)
    return ix.select(
        F.col("uid").alias("SeriesInstanceUID"), F.lit("1").alias("SubSeries"), F.col("modality").alias("Modality"), F.col("pid").alias("FrameOfReferenceUID"), F.col("ref").alias("ReferencedSeriesUID")
    )


@query("frame_map", f"WITH {V.SERIES} SELECT pid AS frame, count(DISTINCT sid) AS n_series, min(sid) AS first_series FROM series GROUP BY pid")
def frame_map(spark, sf):  # noqa: ANN001, ANN201
    return crawl.frame_map(_series(spark, sf)).withColumnRenamed("FrameOfReferenceUID", "frame")


@query(
    "resolve_sop_reference",
    f"WITH {V.SERIES}, {V.LINES}, sops AS (SELECT sop, max_by(sid, path) AS sid FROM line GROUP BY sop), "
    "asked AS (SELECT DISTINCT l_orderkey AS sid, (l_orderkey - 1) || '.' || l_partkey AS sop FROM lineitem UNION SELECT DISTINCT l_orderkey, l_orderkey || '.' || l_partkey FROM lineitem) "
    "SELECT a.sid AS series, min(s.sid) AS resolved FROM asked a JOIN series x ON a.sid = x.sid JOIN sops s ON a.sop = s.sop WHERE x.m IN ('SEG','RTSTRUCT','RTDOSE','RTPLAN') GROUP BY a.sid",
)
def resolve_sop_reference(spark, sf):  # noqa: ANN001, ANN201
    line = table(spark, sf, "lineitem")
    own = lambda k: F.concat_ws(".", (F.col("l_orderkey") - k).cast("string"), F.col("l_partkey").cast("string"))
    asked = line.groupBy(F.col("l_orderkey").alias("SeriesInstanceUID")).agg(F.array_union(F.collect_set(own(1)), F.collect_set(own(0))).alias("ReferencedSOPUIDs"))
    series = asked.withColumn("Modality", V.modality("SeriesInstanceUID")).withColumn("SubSeries", F.lit("1")).withColumn("ReferencedSeriesUID", F.lit(""))
    found = crawl.resolve_by_sop(series, crawl.sop_map(V.instances(spark, sf)))
    return found.select(F.col("SeriesInstanceUID").alias("series"), "resolved")


@query("pt_ct_frame_join", f"WITH {V.SERIES} SELECT p.sid AS series, min(c.sid) AS resolved FROM series p JOIN series c ON p.pid = c.pid AND c.m = 'CT' WHERE p.m = 'PT' GROUP BY p.sid")
def pt_ct_frame_join(spark, sf):  # noqa: ANN001, ANN201
    return crawl.resolve_by_frame(_series(spark, sf)).select(F.col("SeriesInstanceUID").alias("series"), "resolved")


@query("referenced_modality", f"WITH {V.IDX} SELECT i.sid AS series, p.m AS referenced_modality FROM idx i LEFT JOIN series p ON i.ref = p.sid")
def referenced_modality(spark, sf):  # noqa: ANN001, ANN201
    s = _series(spark, sf)
    s = s.select(*[F.col(c).cast("string").alias(c) for c in s.columns])
    return crawl.referenced_modality(s).select(F.col("SeriesInstanceUID").cast("long").alias("series"), F.col("ReferencedModality").alias("referenced_modality"))


# --- forest ------------------------------------------------------------------


@query("forest_roots", f"WITH {V.IDX} SELECT sid AS uid, pid, m AS modality FROM idx WHERE m IN ('CT','MR') OR (m = 'PT' AND ref IS NULL)")
def forest_roots(spark, sf):  # noqa: ANN001, ANN201
    return _forest(spark, sf).roots().select("uid", "pid", "modality")


@query("forest_edges", f"WITH {V.IDX} SELECT i.sid AS uid, i.m AS modality, p.sid AS parent, p.m AS parent_modality FROM idx i JOIN idx p ON i.ref = p.sid")
def forest_edges(spark, sf):  # noqa: ANN001, ANN201
    return _forest(spark, sf).edges()


@query("forest_paths", f"WITH RECURSIVE {V.PATHS} SELECT pid, root, array_to_string(list_transform(range(1, len(u) + 1), lambda i: k[i] || ':' || u[i]), ',') AS path, len(u)::BIGINT AS depth FROM paths")
def forest_paths(spark, sf):  # noqa: ANN001, ANN201
    return _forest(spark, sf).paths().select("pid", "root", members_text("path").alias("path"), F.size("path").cast("long").alias("depth"))


def _path_sql(asked: list[str]) -> str:
    q = "[" + ", ".join(f"'{m}'" for m in asked) + "]"
    has = " AND ".join(f"list_contains(k, '{m}')" for m in asked)
    special = [m for m in asked if m in ("SEG", "RTSTRUCT")]
    parent = " AND ".join(f"len(list_filter(range(2, len(k) + 1), lambda i: k[i] = '{m}' AND NOT list_contains({q}, k[i - 1]))) = 0" for m in special) or "true"
    return (
        f"WITH RECURSIVE {V.PATHS}, hit AS (SELECT DISTINCT pid, list_filter(range(1, len(u) + 1), lambda i: list_contains({q}, k[i])) AS pos, u, k FROM paths WHERE {has} AND {parent}), "
        "res AS (SELECT DISTINCT pid, array_to_string(list_transform(pos, lambda i: k[i] || ':' || u[i]), ',') AS members, len(pos)::BIGINT AS n, u[pos[1]] AS first, list_transform(pos[2:], lambda i: k[i] || ':' || u[i]) AS rest FROM hit) "
    )


def _path_query(text: str) -> None:
    name = "query_" + text.lower().replace(",", "_")

    @query(name, _path_sql(forest.parse_query(text)) + "SELECT pid, members, n FROM res")
    def run(spark, sf):  # noqa: ANN001, ANN202
        return _forest(spark, sf).query(text).select("pid", members_text("members").alias("members"), F.size("members").cast("long").alias("n"))


for _text in ("CT,RTSTRUCT", "CT,PT,RTSTRUCT", "PT,RTSTRUCT", "MR,SEG", "CT,RTDOSE", "CT,MR,RTSTRUCT"):
    _path_query(_text)

LEAVES = f"WITH RECURSIVE {V.PATHS}, leaf AS (SELECT * FROM paths WHERE u[-1] NOT IN (SELECT ref FROM idx WHERE ref IS NOT NULL)), al AS (SELECT DISTINCT pid, list_filter(range(1, len(u) + 1), lambda i: k[i] <> 'RTPLAN') AS pos, u, k FROM leaf) "


@query("query_all", LEAVES + "SELECT DISTINCT pid, array_to_string(list_transform(pos, lambda i: k[i] || ':' || u[i]), ',') AS members FROM al")
def query_all(spark, sf):  # noqa: ANN001, ANN201
    return _forest(spark, sf).query("*").select("pid", members_text("members").alias("members"))


@query(
    "query_all_discovered",
    LEAVES + ", f AS (SELECT pid, array_to_string(list_transform(pos, lambda i: k[i] || ':' || u[i]), ',') AS members, min(u) AS u FROM al GROUP BY ALL) SELECT pid, members, row_number() OVER (ORDER BY u, pid) - 1 AS discovery FROM f",
)
def query_all_discovered(spark, sf):  # noqa: ANN001, ANN201
    return _forest(spark, sf).discovered("*").select("pid", members_text("members").alias("members"), "discovery")


@query(
    "query_grouped_by_root",
    _path_sql(["CT", "RTSTRUCT"]) + ", ex AS (SELECT DISTINCT pid, first, unnest(rest) AS member FROM res) SELECT pid, first AS root, string_agg(member, ',' ORDER BY split_part(member, ':', 2)::BIGINT) AS others, count(*) AS n_others FROM ex GROUP BY ALL",
)
def query_grouped_by_root(spark, sf):  # noqa: ANN001, ANN201
    g = forest.group_by_root(_forest(spark, sf).query("CT,RTSTRUCT"))
    return g.select("pid", F.col("first.uid").alias("root"), members_text("others").alias("others"), F.size("others").cast("long").alias("n_others"))


@query(
    "valid_queries",
    LEAVES + ", n AS (SELECT DISTINCT list_transform(pos, lambda i: k[i]) AS m FROM al) SELECT DISTINCT array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), ',') AS query FROM n "
    "WHERE len(list_filter(m, lambda x: x NOT IN ('CT','MR','PT','SEG','RTSTRUCT','RTDOSE'))) = 0 AND (NOT (list_contains(m,'RTSTRUCT') OR list_contains(m,'RTDOSE')) OR list_contains(m,'CT') OR list_contains(m,'MR') OR list_contains(m,'PT')) "
    "AND (NOT list_contains(m,'SEG') OR list_contains(m,'CT') OR list_contains(m,'MR'))",
)
def valid_queries(spark, sf):  # noqa: ANN001, ANN201
    return _forest(spark, sf).valid_queries()


@query("forest_summary", f"WITH {V.IDX} SELECT count(DISTINCT pid) AS n_patients, count(*) AS n_series, count_if(m IN ('CT','MR') OR (m = 'PT' AND ref IS NULL))::BIGINT AS n_roots, count(ref) AS n_series_with_references FROM idx")
def forest_summary(spark, sf):  # noqa: ANN001, ANN201
    return _forest(spark, sf).summary()


_REPORT = "SELECT m AS modality, pid AS patient, count(DISTINCT pid || '-' || y) AS n_studies, count(DISTINCT sid) AS n_series, GROUPING(m, pid)::BIGINT AS level FROM (SELECT s.*, year(o_orderdate) AS y FROM series s JOIN orders ON sid = o_orderkey) GROUP BY GROUPING SETS ((m), (pid), ())"


def _studies(spark, sf):  # noqa: ANN001, ANN202
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("sid"), F.col("o_custkey").alias("patient"), V.modality("o_orderkey").alias("modality"), F.concat_ws("-", "o_custkey", F.year("o_orderdate")).alias("study"))


@query("database_report_grouping_sets", f"WITH {V.SERIES} {_REPORT}")
def database_report_grouping_sets(spark, sf):  # noqa: ANN001, ANN201
    return crawl.report(_studies(spark, sf), "patient", "study", "sid", "modality").withColumn("level", F.col("level").cast("long"))


@query("database_report", f"WITH {V.SERIES} SELECT m AS modality, count(*) AS n_series, count(DISTINCT pid) AS n_patients FROM series GROUP BY m")
def database_report(spark, sf):  # noqa: ANN001, ANN201
    return _studies(spark, sf).groupBy("modality").agg(F.count("sid").alias("n_series"), F.count_distinct("patient").alias("n_patients"))


@query(
    "patient_modalities",
    f"WITH {V.SERIES} SELECT c_custkey AS patient, count(sid) AS n_series, coalesce(string_agg(DISTINCT m, ',' ORDER BY m), '') AS modalities FROM customer LEFT JOIN series ON pid = c_custkey GROUP BY c_custkey",
)
def patient_modalities(spark, sf):  # noqa: ANN001, ANN201
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("patient"))
    g = _studies(spark, sf).groupBy("patient").agg(F.count("sid").alias("n"), F.array_join(F.array_sort(F.collect_set("modality")), ",").alias("m"))
    return c.join(g, "patient", "left").select("patient", F.coalesce("n", F.lit(0)).alias("n_series"), F.coalesce("m", F.lit("")).alias("modalities"))


@query(
    "sample_number",
    f"WITH {V.IDX} SELECT sid AS uid, pid, CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS sample_number FROM (SELECT sid, pid, row_number() OVER (ORDER BY lower(pid::VARCHAR), sid) - 1 AS n FROM idx WHERE m = 'CT')",
)
def sample_number(spark, sf):  # noqa: ANN001, ANN201
    return forest.numbered(V.index(spark, sf).where("modality = 'CT'").select("uid", "pid"), "pid", "uid")


@query(
    "reference_series_top1",
    f"WITH {V.SERIES} SELECT pid, sid AS uid, m AS modality FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY CASE m WHEN 'CT' THEN 1 WHEN 'MR' THEN 2 ELSE 3 END, sid) AS n FROM series WHERE m IN ('CT','MR','PT')) WHERE n = 1",
)
def reference_series_top1(spark, sf):  # noqa: ANN001, ANN201
    return forest.reference_series(V.index(spark, sf).select("pid", "uid", "modality"), "pid", "modality", "uid")


@query("missing_series_anti", "SELECT o_orderkey AS series FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_series_anti(spark, sf):  # noqa: ANN001, ANN201
    held = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("series"))
    return forest.missing_series(table(spark, sf, "orders").select(F.col("o_orderkey").alias("series")), held)


@query("loaded_series_semi", "SELECT o_orderkey AS series FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def loaded_series_semi(spark, sf):  # noqa: ANN001, ANN201
    held = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("series"))
    return forest.loaded_series(table(spark, sf, "orders").select(F.col("o_orderkey").alias("series")), held)


# --- regions -----------------------------------------------------------------


def _match(spark, sf, strategy, multi=True):  # noqa: ANN001, ANN202
    m = roi.match(V.rois(spark, sf), roi.pattern_rows(spark, MAP), strategy, allow_multi=multi)
    return m.select("series", "key", F.array_join("roi_names", "|").alias("roi_names"), "image_id")


@query("roi_match_merge", f"WITH {HITS} SELECT series, key, string_agg(roi, '|' ORDER BY pp, roi) AS roi_names, key AS image_id FROM hit GROUP BY series, key")
def roi_match_merge(spark, sf):  # noqa: ANN001, ANN201
    return _match(spark, sf, roi.ROIMatchStrategy.MERGE)


@query("roi_match_keep_first", f"WITH {HITS} SELECT series, key, roi AS roi_names, key AS image_id FROM (SELECT *, row_number() OVER (PARTITION BY series, kp ORDER BY pp, roi) AS n FROM hit) WHERE n = 1")
def roi_match_keep_first(spark, sf):  # noqa: ANN001, ANN201
    return _match(spark, sf, roi.ROIMatchStrategy.KEEP_FIRST)


@query("roi_match_separate", f"WITH {HITS} SELECT series, key, roi AS roi_names, key || '__[' || roi || ']' AS image_id FROM hit")
def roi_match_separate(spark, sf):  # noqa: ANN001, ANN201
    return _match(spark, sf, roi.ROIMatchStrategy.SEPARATE)


@query(
    "roi_match_exclusive",
    f"WITH {HITS}, e AS (SELECT *, row_number() OVER (PARTITION BY series, roi ORDER BY kp, pp) AS n FROM hit) SELECT series, key, string_agg(roi, '|' ORDER BY pp, roi) AS roi_names, key AS image_id FROM e WHERE n = 1 GROUP BY series, key",
)
def roi_match_exclusive(spark, sf):  # noqa: ANN001, ANN201
    return _match(spark, sf, roi.ROIMatchStrategy.MERGE, False)


@query(
    "roi_keep_first_exclusive",
    f"WITH {HITS}, a AS (SELECT series, roi FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY pp, roi) n FROM hit WHERE kp = 0) WHERE n = 1), "
    "b AS (SELECT series, roi FROM (SELECT h.*, row_number() OVER (PARTITION BY h.series ORDER BY pp, h.roi) n FROM hit h WHERE kp = 1 AND NOT EXISTS (SELECT 1 FROM a WHERE a.series = h.series AND a.roi = h.roi)) WHERE n = 1), "
    "c AS (SELECT series, roi FROM (SELECT h.*, row_number() OVER (PARTITION BY h.series ORDER BY pp, h.roi) n FROM hit h WHERE kp = 2 AND NOT EXISTS (SELECT 1 FROM a WHERE a.series = h.series AND a.roi = h.roi) "
    "AND NOT EXISTS (SELECT 1 FROM b WHERE b.series = h.series AND b.roi = h.roi)) WHERE n = 1) "
    "SELECT series, 'GTV' AS key, roi AS roi_names, 'GTV' AS image_id FROM a UNION ALL SELECT series, 'PTV', roi, 'PTV' FROM b UNION ALL SELECT series, 'TV', roi, 'TV' FROM c",
)
def roi_keep_first_exclusive(spark, sf):  # noqa: ANN001, ANN201
    return _match(spark, sf, roi.ROIMatchStrategy.KEEP_FIRST, False)


# --- scalars -----------------------------------------------------------------

EV = "ev AS (SELECT event_id, strftime(ts, '%Y%m%d') AS d, strftime(ts, '%H%M%S') || '.' || lpad((event_id % 1000000)::VARCHAR, 6, '0') AS t, props FROM events)"


def _events(spark, sf):  # noqa: ANN001, ANN202
    e = table(spark, sf, "events")
    micros = F.lpad((F.col("event_id") % 1000000).cast("string"), 6, "0")
    return e.select("event_id", F.date_format("ts", "yyyyMMdd").alias("d"), F.concat(F.date_format("ts", "HHmmss"), F.lit("."), micros).alias("t"), "props")


@query("date_parse", f"WITH {EV} SELECT event_id, strftime(strptime(d, '%Y%m%d'), '%Y-%m-%d') AS parsed, d[1:7] || 'x' AS raw_bad, NULL::VARCHAR AS parsed_bad FROM ev")
def date_parse(spark, sf):  # noqa: ANN001, ANN201
    e = _events(spark, sf).withColumn("raw_bad", F.concat(F.substring("d", 1, 7), F.lit("x")))
    text = lambda c: F.date_format(X.dicom_date(F.col(c)), "yyyy-MM-dd")
    return e.select("event_id", text("d").alias("parsed"), "raw_bad", text("raw_bad").alias("parsed_bad"))


@query("time_parse", f"WITH {EV} SELECT event_id, (t[1:2]::BIGINT * 3600 + t[3:4]::BIGINT * 60 + t[5:6]::BIGINT) * 1000000 + t[8:13]::BIGINT AS micros FROM ev")
def time_parse(spark, sf):  # noqa: ANN001, ANN201
    return _events(spark, sf).select("event_id", X.dicom_time_micros(F.col("t")).alias("micros"))


@query("header_datetime", f"WITH {EV} SELECT event_id, d[1:4] || '-' || d[5:6] || '-' || d[7:8] AS content_date, t[1:2] || ':' || t[3:4] || ':' || t[5:6] AS content_time FROM ev")
def header_datetime(spark, sf):  # noqa: ANN001, ANN201
    return _events(spark, sf).select("event_id", X.header_value("ContentDate", F.col("d")).alias("content_date"), X.header_value("ContentTime", F.col("t")).alias("content_time"))


@query(
    "sanitize_filename",
    r"WITH a AS (SELECT page_id, regexp_replace(url || ' - ' || page_id || '?', '^([^A-Za-z0-9 ._/\-])+|([^A-Za-z0-9 ._/\-])+$', '', 'g') AS s FROM pages) "
    r"SELECT page_id, regexp_replace(regexp_replace(replace(trim(s), ' - ', '-'), '\s+', '_', 'g'), '([^A-Za-z0-9 ._/\-])+', '_', 'g') AS name FROM a",
)
def sanitize_filename(spark, sf):  # noqa: ANN001, ANN201
    p = table(spark, sf, "pages")
    return p.select("page_id", X.sanitize_file_name(F.concat("url", F.lit(" - "), F.col("page_id").cast("string"), F.lit("?"))).alias("name"))


@query("truncate_uid", "SELECT o_orderkey, CASE WHEN length(u) <= 8 THEN u ELSE right(u, 8) END AS short FROM (SELECT o_orderkey, '1.2.840.' || o_orderkey || '.' || o_custkey AS u FROM orders)")
def truncate_uid(spark, sf):  # noqa: ANN001, ANN201
    u = F.concat(F.lit("1.2.840."), F.col("o_orderkey").cast("string"), F.lit("."), F.col("o_custkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", X.truncate_uid(u, 8).alias("short"))


RESOLVED = "SELECT o_orderkey, o_custkey || '/' || year(o_orderdate) || '-' || replace(o_orderpriority, ' ', '_') || '/' || (o_orderkey % 100) || '.dcm' AS target FROM orders"


@query("resolve_path", RESOLVED)
def resolve_path(spark, sf):  # noqa: ANN001, ANN201
    o = table(spark, sf, "orders")
    values = {"PatientID": F.col("o_custkey"), "Year": F.year("o_orderdate"), "Priority": F.replace("o_orderpriority", F.lit(" "), F.lit("_")), "N": F.col("o_orderkey") % 100}
    return o.select("o_orderkey", X.template("%PatientID/{Year}-{Priority}/%N.dcm", values).alias("target"))


@query("path_duplicates", f"SELECT target, count(*) AS n, min(o_orderkey) AS first_source FROM ({RESOLVED}) GROUP BY target HAVING count(*) > 1")
def path_duplicates(spark, sf):  # noqa: ANN001, ANN201
    return outputs.duplicate_targets(resolve_path(spark, sf), "target", "o_orderkey")


@query("dir_unique_counts", "WITH p AS (SELECT list_filter(string_split(url, '/'), lambda x: x <> '') AS a FROM pages), q AS (SELECT unnest(range(1, len(a) + 1)) AS i, a FROM p) SELECT (i - 1)::BIGINT AS depth, count(DISTINCT a[i]) AS n_unique FROM q GROUP BY i")
def dir_unique_counts(spark, sf):  # noqa: ANN001, ANN201
    return outputs.unique_children(table(spark, sf, "pages"), "url").withColumn("depth", F.col("depth").cast("long"))


@query("find_files", "SELECT url AS path FROM pages WHERE contains(url, 'example') AND contains(url, '/en/')")
def find_files(spark, sf):  # noqa: ANN001, ANN201
    from ..sources.files import path_filter

    return table(spark, sf, "pages").where(path_filter("url", ["example", "/en/"])).select(F.col("url").alias("path"))


@query(
    "natural_sort_key",
    r"SELECT page_id, array_to_string(list_transform(regexp_extract_all(url, '\d+|\D+'), lambda t: CASE WHEN regexp_full_match(t, '\d+') THEN lpad(t, 20, '0') ELSE lower(t) END), '|') AS sort_key FROM pages",
)
def natural_sort_key(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "pages").select("page_id", F.array_join(X.natural_sort_key(F.col("url")), "|").alias("sort_key"))


@query("limit_sorted", "SELECT url, page_id FROM pages ORDER BY url, page_id LIMIT 25")
def limit_sorted(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "pages").select("url", "page_id").orderBy("url", "page_id").limit(25)


@query("json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path(spark, sf):  # noqa: ANN001, ANN201
    from ..functions.nested import lookup

    return table(spark, sf, "events").select("event_id", lookup("props", "k").alias("k"))


@query("flatten_props", "SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def flatten_props(spark, sf):  # noqa: ANN001, ANN201
    from ..functions.nested import flatten_json

    return flatten_json(table(spark, sf, "events").select("event_id", "props"), "props")


@query("fuzzy_free_regex_group", r"SELECT page_id, coalesce(nullif(regexp_extract(url, '/([a-z]{2})/(\d+)', 1), ''), regexp_extract(url, '#(\w+)', 1)) AS part FROM pages")
def regex_group(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "pages").select("page_id", X.captured(F.col("url"), (r"/([a-z]{2})/(\d+)", 1), (r"#(\w+)", 1)).alias("part"))


# --- volumes -----------------------------------------------------------------


@query(
    "volume_fingerprint",
    f"WITH {V.VOX} SELECT series, round(min(value), 4) AS v_min, round(max(value), 4) AS v_max, round(sum(value), 4) AS v_sum, round(avg(value), 4) AS v_mean, round(stddev_samp(value), 4) AS v_std, round(var_samp(value), 4) AS v_var, count(*) AS n_voxels FROM vox GROUP BY series",
)
def volume_fingerprint(spark, sf):  # noqa: ANN001, ANN201
    f = voxel.fingerprint(V.voxels(spark, sf))
    return f.select("series", *[r4(c).alias(c) for c in ("v_min", "v_max", "v_sum", "v_mean", "v_std", "v_var")], "n_voxels")


def _sums(rows):  # noqa: ANN001, ANN202
    return rows.groupBy("series").agg(r4(F.sum("value")).alias("total"), F.count(F.lit(1)).alias("n"))


_SUM = "SELECT series, round(sum(value), 4) AS total, count(*) AS n FROM {} GROUP BY series"


@query("clip_intensity", f"WITH {V.VOX}, c AS (SELECT series, least(greatest(value, -0.1), 0.15) AS value FROM vox) " + _SUM.format("c"))
def clip_intensity(spark, sf):  # noqa: ANN001, ANN201
    return _sums(V.voxels(spark, sf).withColumn("value", voxel.clip_intensity(F.col("value"), -0.1, 0.15)))


@query("window_intensity", f"WITH {V.VOX}, c AS (SELECT series, least(greatest(value, -0.1), 0.2) AS value FROM vox) " + _SUM.format("c"))
def window_intensity(spark, sf):  # noqa: ANN001, ANN201
    return _sums(V.voxels(spark, sf).withColumn("value", voxel.window_intensity(F.col("value"), 0.3, 0.05)))


@query("crop_centre", f"WITH {V.VOX}, c AS (SELECT series, value FROM vox WHERE x BETWEEN 1 AND 2 AND y BETWEEN 0 AND 2) " + _SUM.format("c"))
def crop_centre(spark, sf):  # noqa: ANN001, ANN201
    return _sums(voxel.crop_centre(V.voxels(spark, sf), (2, 1, 1), (2, 3, 0), (4, 4, 4)))


@query("rescale_abs", "WITH v AS (SELECT vec_id AS series, unnest(embedding)::DOUBLE * (label + 1) AS v FROM embeddings) SELECT series, round(sum(abs(v)), 4) AS total, count(*) AS n FROM v GROUP BY series")
def rescale_abs(spark, sf):  # noqa: ANN001, ANN201
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("series"), "label", F.explode("embedding").alias("v"))
    return _sums(e.withColumn("value", voxel.rescale_abs(F.col("v").cast("double"), F.col("label") + 1.0)))


@query("mask_overlap", f"WITH {V.MASK}, v AS (SELECT series, z, y, x, count(*) AS n FROM mask GROUP BY ALL) SELECT series, max(n > 1) AS has_overlap, count_if(n > 1)::BIGINT AS n_overlap FROM v GROUP BY series")
def mask_overlap(spark, sf):  # noqa: ANN001, ANN201
    return voxel.has_overlap(V.masks(spark, sf))


@query("mask_label", f"WITH {V.MASK} SELECT series, z, y, x, channel::BIGINT AS label FROM mask WHERE channel IN (2, 3)")
def mask_label(spark, sf):  # noqa: ANN001, ANN201
    return voxel.to_label(V.masks(spark, sf).where("channel in (2, 3)")).withColumn("label", F.col("label").cast("long"))


@query("mask_sparse", f"WITH {V.MASK} SELECT series, z, y, x, max(channel)::BIGINT AS label FROM mask GROUP BY ALL")
def mask_sparse(spark, sf):  # noqa: ANN001, ANN201
    return voxel.to_sparse(V.masks(spark, sf)).withColumn("label", F.col("label").cast("long"))


@query("mask_region", f"WITH {V.MASK} SELECT series, z, y, x, bit_or((1 << (channel - 1))::BIGINT) AS region FROM mask GROUP BY ALL")
def mask_region(spark, sf):  # noqa: ANN001, ANN201
    return voxel.to_region(V.masks(spark, sf), 3)


@query("mask_background", f"WITH {V.MASK} SELECT series, count(*) AS n_background FROM vox v WHERE NOT EXISTS (SELECT 1 FROM mask m WHERE (m.series, m.z, m.y, m.x) = (v.series, v.z, v.y, v.x)) GROUP BY series")
def mask_background(spark, sf):  # noqa: ANN001, ANN201
    return voxel.background(V.voxels(spark, sf), V.masks(spark, sf)).groupBy("series").agg(F.count(F.lit(1)).alias("n_background"))


BBOX = V.MASK + ", bb AS (SELECT series, channel, min(x)::BIGINT AS min_x, min(y)::BIGINT AS min_y, min(z)::BIGINT AS min_z, max(x)::BIGINT + 1 AS max_x, max(y)::BIGINT + 1 AS max_y, max(z)::BIGINT + 1 AS max_z, count(*) AS n FROM mask GROUP BY series, channel)"
_OUT = "min_x, min_y, min_z, max_x, max_y, max_z"


def _boxes(spark, sf, f=lambda b: b):  # noqa: ANN001, ANN202
    b = voxel.bounding_box(V.masks(spark, sf))
    v = lambda n: G.vec(*[F.col(f"{n}_{a}") for a in "xyz"])
    b = b.withColumn("box", f(G.box(v("min"), v("max"))))
    return b.select("series", F.col("channel").cast("long").alias("channel"), *[F.col(f"box.{n}.{a}").cast("long").alias(f"{n}_{a}") for n in ("min", "max") for a in "xyz"])


@query("mask_bbox", f"WITH {BBOX} SELECT series, channel::BIGINT AS channel, {_OUT} FROM bb")
def mask_bbox(spark, sf):  # noqa: ANN001, ANN201
    return _boxes(spark, sf)


def _each(f: str) -> str:
    return ", ".join(f.replace("#", a) for a in "xyz")


@query("bbox_pad", f"WITH {BBOX} SELECT series, channel::BIGINT AS channel, {_each('greatest(min_# - 1, 0) AS min_#')}, {_each('max_# + 1 + greatest(1 - min_#, 0) AS max_#')} FROM bb")
def bbox_pad(spark, sf):  # noqa: ANN001, ANN201
    return _boxes(spark, sf, lambda b: G.pad(b, 1))


_CUBE = (
    BBOX + ", s AS (SELECT *, greatest(max_x - min_x, max_y - min_y, max_z - min_z) AS side FROM bb), "
    f"e AS (SELECT series, channel, {_each('min_# - (side - (max_# - min_#) + 1) // 2 AS lo_#')}, {_each('max_# + (side - (max_# - min_#)) // 2 AS hi_#')} FROM s), "
    f"c AS (SELECT series, channel, {_each('greatest(lo_#, 0) AS min_#')}, {_each('hi_# + greatest(-lo_#, 0) AS max_#')} FROM e)"
)


@query("bbox_cube", f"WITH {_CUBE} SELECT series, channel::BIGINT AS channel, {_OUT} FROM c")
def bbox_cube(spark, sf):  # noqa: ANN001, ANN201
    return _boxes(spark, sf, G.expand_to_cube)


@query("bbox_clamp", f"WITH {_CUBE} SELECT series, channel::BIGINT AS channel, {_each('min_# - greatest(max_# - 3, 0) AS min_#')}, {_each('least(max_#, 3) AS max_#')} FROM c")
def bbox_clamp(spark, sf):  # noqa: ANN001, ANN201
    return _boxes(spark, sf, lambda b: G.clamp(G.expand_to_cube(b), G.vec(F.lit(3), F.lit(3), F.lit(3))))


@query("mask_centroid", f"WITH {V.MASK} SELECT series, channel::BIGINT AS channel, round(avg(x), 4) AS c_x, round(avg(y), 4) AS c_y, round(avg(z), 4) AS c_z FROM mask GROUP BY series, channel")
def mask_centroid(spark, sf):  # noqa: ANN001, ANN201
    return voxel.centroid(V.masks(spark, sf)).select("series", F.col("channel").cast("long").alias("channel"), *[r4(f"c_{a}").alias(f"c_{a}") for a in "xyz"])


@query("sphere_radius", f"WITH {BBOX} SELECT series, channel::BIGINT AS channel, round(cbrt(n * 3 / (4 * pi())), 4) AS radius FROM bb")
def sphere_radius(spark, sf):  # noqa: ANN001, ANN201
    b = voxel.bounding_box(V.masks(spark, sf))
    return b.select("series", F.col("channel").cast("long").alias("channel"), r4(voxel.sphere_radius(F.col("n_voxels"))).alias("radius"))


@query("mask_covariance", f"WITH {V.MASK} SELECT series, channel::BIGINT AS channel, " + ", ".join(f"round(covar_pop({a}, {b}), 12) + 0.0 AS c_{a}{b}" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")) + " FROM mask GROUP BY series, channel")
def mask_covariance(spark, sf):  # noqa: ANN001, ANN201
    c = voxel.covariance(V.masks(spark, sf))
    return c.select("series", F.col("channel").cast("long").alias("channel"), *[(F.round(x, 12) + 0.0).alias(x) for x in c.columns[2:]])


@query("slice_extract", f"WITH {V.VOX}, s AS (SELECT *, min(value) OVER (PARTITION BY series) AS lo, max(value) OVER (PARTITION BY series) AS hi FROM vox) SELECT series, z, round(sum((value - lo) / (hi - lo) * 255), 2) AS shade FROM s WHERE z % 2 = 0 GROUP BY series, z")
def slice_extract(spark, sf):  # noqa: ANN001, ANN201
    return voxel.slices(V.voxels(spark, sf), "z", 2).groupBy("series", "z").agg(F.round(F.sum("shade"), 2).alias("shade"))


@query("direction_flip", "SELECT vec_id, array_to_string(list_transform(range(1, 10), lambda i: round(CASE WHEN (i - 1) // 3 = 2 THEN -embedding[i]::DOUBLE ELSE embedding[i]::DOUBLE END * 1000)::BIGINT), ',') AS flipped FROM embeddings")
def direction_flip(spark, sf):  # noqa: ANN001, ANN201
    d = F.transform(F.slice("embedding", 1, 9), lambda v: v.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(F.transform(G.flip_axis(d, 2), lambda v: F.round(v * 1000).cast("long").cast("string")), ",").alias("flipped"))


@query("direction_norms", "SELECT vec_id, " + ", ".join(f"round(sqrt(embedding[{3 * k + 1}]::DOUBLE ** 2 + embedding[{3 * k + 2}]::DOUBLE ** 2 + embedding[{3 * k + 3}]::DOUBLE ** 2), 4) AS n{k}" for k in range(3)) + " FROM embeddings")
def direction_norms(spark, sf):  # noqa: ANN001, ANN201
    d = F.transform(F.slice("embedding", 1, 9), lambda v: v.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", *[r4(F.get(G.row_norms(d), k)).alias(f"n{k}") for k in range(3)])


@query("point_to_index", "SELECT vec_id, " + ", ".join(f"floor((embedding[{i}]::DOUBLE + 1) / {s} + 0.5)::BIGINT AS {a}" for i, s, a in ((1, 0.5, "x"), (2, 0.25, "y"), (3, 0.125, "z"))) + " FROM embeddings")
def point_to_index(spark, sf):  # noqa: ANN001, ANN201
    at = G.vec(*[F.element_at("embedding", i + 1).cast("double") for i in range(3)])
    found = G.point_to_index(at, G.vec(F.lit(-1.0), F.lit(-1.0), F.lit(-1.0)), G.vec(F.lit(0.5), F.lit(0.25), F.lit(0.125)))
    return table(spark, sf, "embeddings").select("vec_id", found.alias("i")).select("vec_id", "i.x", "i.y", "i.z")


@query("resample_size", "SELECT o_orderkey, round_even((o_orderkey % 512 + 1) * 0.5 / 0.75, 0)::BIGINT AS x, round_even((o_custkey % 512 + 1) * 0.5 / 1.0, 0)::BIGINT AS y, (o_orderkey % 64 + 1) AS z FROM orders")
def resample_size(spark, sf):  # noqa: ANN001, ANN201
    o = table(spark, sf, "orders")
    size = G.vec(F.col("o_orderkey") % 512 + 1, F.col("o_custkey") % 512 + 1, F.col("o_orderkey") % 64 + 1)
    n = G.resampled_size(size, G.vec(F.lit(0.5), F.lit(0.5), F.lit(3.0)), G.vec(F.lit(0.75), F.lit(1.0), F.lit(0.0)))
    return o.select("o_orderkey", n.alias("n")).select("o_orderkey", "n.x", "n.y", "n.z")


# --- outputs -----------------------------------------------------------------

_UP = "WITH old AS (SELECT o_orderkey::VARCHAR AS filepath, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey::VARCHAR AS filepath, o_orderpriority AS priority FROM orders WHERE o_orderkey % 2 = 0) "


def _old_new(spark, sf):  # noqa: ANN001, ANN202
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string").alias("filepath")
    return o.where("o_orderkey % 3 <> 0").select(key, F.col("o_orderstatus").alias("status")), o.where("o_orderkey % 2 = 0").select(key, F.col("o_orderpriority").alias("priority"))


@query("index_upsert", _UP + "SELECT filepath, '' AS priority, status FROM old WHERE filepath NOT IN (SELECT filepath FROM new) UNION ALL SELECT filepath, priority, '' FROM new")
def index_upsert(spark, sf):  # noqa: ANN001, ANN201
    return outputs.upsert_index(*_old_new(spark, sf))


@query("index_schema_merge", _UP + "SELECT filepath, NULL::VARCHAR AS priority, status FROM old UNION ALL SELECT filepath, priority, NULL FROM new")
def index_schema_merge(spark, sf):  # noqa: ANN001, ANN201
    old, new = _old_new(spark, sf)
    return old.unionByName(new, allowMissingColumns=True).select("filepath", "priority", "status")


@query("simplified_index", _UP + "SELECT filepath, NULL::VARCHAR AS missing, status FROM old ORDER BY filepath")
def simplified_index(spark, sf):  # noqa: ANN001, ANN201
    return outputs.simplified(_old_new(spark, sf)[0], ["filepath", "missing", "status"]).orderBy("filepath")


@query("nnunet_labels", f"WITH {V.ROIS} SELECT roi, (row_number() OVER (ORDER BY roi))::BIGINT AS label FROM (SELECT DISTINCT roi FROM rois)")
def nnunet_labels(spark, sf):  # noqa: ANN001, ANN201
    return outputs.label_rows(V.rois(spark, sf), "roi")


@query(
    "nnunet_region_labels",
    "WITH k AS (SELECT DISTINCT c_mktsegment AS roi FROM customer), n AS (SELECT roi, row_number() OVER (ORDER BY roi) - 1 AS i, count(*) OVER () AS k FROM k) "
    "SELECT roi, string_agg(v::VARCHAR, ',' ORDER BY v) AS labels FROM n, range(1, 65536) b(v) WHERE v < (1::BIGINT << k) AND (v >> i) & 1 = 1 GROUP BY roi",
)
def nnunet_region_labels(spark, sf):  # noqa: ANN001, ANN201
    return outputs.region_label_rows(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("roi")), "roi")


@query("nnunet_channels", f"WITH {V.SERIES} SELECT (row_number() OVER (ORDER BY m) - 1)::BIGINT AS channel, m AS modality FROM (SELECT DISTINCT m FROM series WHERE m IN ('CT','MR'))")
def nnunet_channels(spark, sf):  # noqa: ANN001, ANN201
    return outputs.channel_rows(V.index(spark, sf), "modality")


@query("next_dataset_id", "SELECT c_nationkey, (SELECT min(i) FROM range(1, 1000) t(i) WHERE NOT list_contains(used, i))::BIGINT AS next_id FROM (SELECT c_nationkey, list(DISTINCT (c_custkey % 50 + 1)) AS used FROM customer GROUP BY c_nationkey)")
def next_dataset_id(spark, sf):  # noqa: ANN001, ANN201
    used = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.collect_set((F.col("c_custkey") % 50 + 1).cast("int")).alias("used"))
    return used.select("c_nationkey", outputs.free_dataset_id(F.col("used")).cast("long").alias("next_id"))


@query("pipeline_success_rate", "SELECT count_if(quality = 1 AND toxic = 0)::BIGINT AS n_success, count_if(NOT (quality = 1 AND toxic = 0))::BIGINT AS n_failure, count(*) AS n_total, round(coalesce(avg((quality = 1 AND toxic = 0)::INT) * 100, 0), 4) AS success_rate FROM labels")
def pipeline_success_rate(spark, sf):  # noqa: ANN001, ANN201
    ok = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return voxel.success_rate(table(spark, sf, "labels"), ok).withColumn("success_rate", r4("success_rate"))


@query("slice_order", "SELECT conv_id AS series, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS n_slices FROM conversations GROUP BY conv_id")
def slice_order(spark, sf):  # noqa: ANN001, ANN201
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("series"))
    return c.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("roles"), F.count(F.lit(1)).alias("n_slices"))


@query("keyword_lookup", "SELECT * FROM (VALUES ('PatientID', '00100020'), ('Modality', '00080060'), ('NotATag', NULL)) t(keyword, tag)")
def keyword_lookup(spark, sf):  # noqa: ANN001, ANN201
    from ..sources.dicom_tags import tag_table

    asked = spark.createDataFrame([("PatientID",), ("Modality",), ("NotATag",)], "keyword string")
    return asked.join(F.broadcast(tag_table(spark)), "keyword", "left").select("keyword", "tag")


@query("similar_tags")
def similar_tags(spark, sf):  # noqa: ANN001, ANN201
    from ..sources.dicom_tags import similar_tags as similar

    return spark.createDataFrame([(k, i, t) for k in ("PatientsID", "Modalty") for i, t in enumerate(similar(k))], "keyword string, rank int, suggestion string")


# --- synthetic volumes -------------------------------------------------------


@query("synthetic_sphere", "SELECT i AS id, CASE WHEN sqrt((i % 16 - 8) ** 2 + ((i // 16) % 16 - 8) ** 2 + ((i // 256) - 8) ** 2) <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM range(4096) t(i)")
def synthetic_sphere(spark, sf):  # noqa: ANN001, ANN201
    return synthetic.volume(spark, "sphere", (16, 16, 16), radius=5.0).select("id", "value")


@query("synthetic_checkerboard", "SELECT i AS id, ((i % 16) // 4 + ((i // 16) % 16) // 4 + (i // 256) // 4) % 2 * 1.0::DOUBLE AS value FROM range(4096) t(i)")
def synthetic_checkerboard(spark, sf):  # noqa: ANN001, ANN201
    return synthetic.volume(spark, "checkerboard", (16, 16, 16), step=4).select("id", "value")


@query("synthetic_gradient", "SELECT i AS id, round((i % 16) / 15.0::DOUBLE, 6) AS value FROM range(4096) t(i)")
def synthetic_gradient(spark, sf):  # noqa: ANN001, ANN201
    return synthetic.volume(spark, "gradient_x", (16, 16, 16)).select("id", F.round("value", 6).alias("value"))


@query("synthetic_cross", "SELECT i AS id, CASE WHEN ((abs(i % 16 - 8) <= 2)::INT + (abs((i // 16) % 16 - 8) <= 2)::INT + (abs(i // 256 - 8) <= 2)::INT) >= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM range(4096) t(i)")
def synthetic_cross(spark, sf):  # noqa: ANN001, ANN201
    return synthetic.volume(spark, "cross", (16, 16, 16), width=2).select("id", "value")


# --- files and arrays (no SQL form; see tests) ---------------------------------


@query(
    "dicom_roundtrip",
    "SELECT o_custkey::VARCHAR AS \"PatientID\", '1.2.' || o_orderkey AS \"SeriesInstanceUID\", '1.2.' || o_orderkey || '.1' AS \"SOPInstanceUID\", 'CT' AS \"Modality\", NULL::VARCHAR AS error FROM orders",
)
def dicom_roundtrip(spark, sf):  # noqa: ANN001, ANN201
    from ..sources import dicom

    head = lambda r: {"PatientID": str(r.o_custkey), "SeriesInstanceUID": f"1.2.{r.o_orderkey}", "SOPInstanceUID": f"1.2.{r.o_orderkey}.1", "Modality": "CT", "AcquisitionNumber": "1"}
    made = dicom.encode_rows(spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey"), head)
    return dicom.parse_rows(made).select("PatientID", "SeriesInstanceUID", "SOPInstanceUID", "Modality", "error")


@query("nifti_roundtrip", "SELECT vec_id::VARCHAR AS series, len(embedding)::BIGINT AS n_voxels, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 4) AS total FROM embeddings")
def nifti_roundtrip(spark, sf):  # noqa: ANN001, ANN201
    from ..sources import nifti

    v = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("series"), "embedding")
    return nifti.roundtrip(v, (4, 4, 4))


@query("polygon_fill", "SELECT p_partkey::VARCHAR AS series, ((p_size % 8 + 1) * (p_size % 8 + 1))::BIGINT AS n_voxels FROM part")
def polygon_fill(spark, sf):  # noqa: ANN001, ANN201
    from ..operators import volumes

    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("series"), F.lit("roi").alias("roi"), F.col("p_size"))
    side = (F.col("p_size") % 8 + 1).cast("double")
    square = F.array(*[c.cast("double") for xy in ((F.lit(0.5), F.lit(0.5)), (side + 0.5, F.lit(0.5)), (side + 0.5, side + 0.5), (F.lit(0.5), side + 0.5)) for c in (*xy, F.lit(2.0))])
    filled = volumes.rasterise(rows.select("series", "roi", F.array(square).alias("contours")), (16, 16, 4))
    return filled.where("error is null").groupBy("series").agg(F.count(F.lit(1)).alias("n_voxels"))


#: A Gaussian of the scale, cut at three of it, with the edge value continued, then every other voxel along x and y.
RESAMPLED = (
    V.VOX + ", o AS (SELECT o, exp(-0.5::DOUBLE * (o / 2.0) ** 2) AS g FROM range(-6, 7) t(o)), k AS (SELECT o, g / (SELECT sum(g) FROM o) AS w FROM o), "
    "w AS (SELECT p, greatest(least(2 * p + o, 3), 0) AS i, sum(w) AS w FROM k, range(2) q(p) GROUP BY ALL), "
    "r AS (SELECT v.series, a.p AS x, b.p AS y, v.z, sum(v.value * a.w * b.w)::FLOAT AS value FROM vox v JOIN w a ON v.x = a.i JOIN w b ON v.y = b.i GROUP BY ALL)"
)


@query(
    "resample_linear",
    f"WITH {RESAMPLED} SELECT series::VARCHAR AS series, 2 AS nx, 2 AS ny, 4 AS nz, round(min(value)::DOUBLE, 4) AS v_min, round(max(value)::DOUBLE, 4) AS v_max, round(avg(value::DOUBLE), 4) AS v_mean FROM r GROUP BY series",
)
def resample_linear(spark, sf):  # noqa: ANN001, ANN201
    from ..operators import volumes

    v = volumes.pack(spread(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id"), "vec_id", "embedding", (4, 4, 4))
    return volumes.summarise(volumes.resample(v, (2.0, 2.0, 1.0)))


#: Every voxel of a mask reaches its face neighbours; a component counts at its first voxel.
REACH = (
    V.MASK + ", m AS (SELECT series, channel, x + 4 * y + 16 * z AS i, x, y, z FROM mask), "
    "e AS (SELECT a.series, a.channel, a.i, b.i AS j FROM m a JOIN m b ON a.series = b.series AND a.channel = b.channel AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1), "
    "reach AS (SELECT series, channel, i, i AS j FROM m UNION SELECT r.series, r.channel, r.i, e.j FROM reach r JOIN e ON r.series = e.series AND r.channel = e.channel AND r.j = e.i)"
)


@query(
    "connected_components",
    f"WITH RECURSIVE {REACH}, least AS (SELECT series, channel, i, min(j) AS j FROM reach GROUP BY ALL) "
    "SELECT series::VARCHAR AS series, channel, count_if(i = j)::BIGINT AS n_components FROM least GROUP BY series, channel",
)
def connected_components(spark, sf):  # noqa: ANN001, ANN201
    from ..operators import shapes

    return shapes.Shapes(V.masks(spark, sf), side=3).count()


@query(
    "feret",
    f"WITH {V.MASK} SELECT a.series::VARCHAR AS series, a.channel, round(sqrt(max((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)), 4) AS feret "
    "FROM mask a JOIN mask b ON a.series = b.series AND a.channel = b.channel GROUP BY a.series, a.channel",
)
def feret(spark, sf):  # noqa: ANN001, ANN201
    from ..operators import volumes

    return volumes.shape_statistics(V.masks(spark, sf), (4, 4, 4)).select("series", "channel", r4("feret").alias("feret"))


