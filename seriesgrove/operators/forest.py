"""Series forest: linking series by reference, root-to-node paths, modality queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DuplicateRowError, MissingDependencyModalityError, UnsupportedModalityError
from ..schemas import IMAGING, MODALITIES
from ..storage import large, row_offsets, stored


def parse_query(query: str) -> list[str]:
    """Modalities in canonical order; the names are not trimmed."""
    asked = query.split(",")
    unknown = sorted(set(asked) - set(MODALITIES))
    if unknown:
        raise UnsupportedModalityError(f"unsupported modalities {unknown}; valid are {list(MODALITIES)}")
    for child, parents in (("RTSTRUCT", {"CT", "MR", "PT"}), ("RTDOSE", {"CT", "MR", "PT"}), ("SEG", {"CT", "MR"})):
        if child in asked and not parents & set(asked):
            raise MissingDependencyModalityError(f"{child} needs one of {sorted(parents)}")
    return [m for m in MODALITIES if m in asked]


def is_root() -> Column:
    return F.col("modality").isin("CT", "MR") | ((F.col("modality") == "PT") & F.col("ref").isNull())


class SeriesForest:
    """Lazily planned queries over an index with columns uid, pid, modality, ref.

    An empty reference counts as none.  Of several rows with one uid the last
    (by ``order``) counts.  Since a series has one parent, a path is the way up
    from its last node; every node joins its way with that of the node where it
    ends, so ways double in a round and paths of any length take a logarithmic
    number of joins over stored tables.  A way ends before a node that is on it.
    """

    def __init__(self, index: DataFrame, order: str | None = None):
        rows = index.withColumn("ref", F.nullif(F.col("ref").cast("string"), F.lit("")).cast(dict(index.dtypes)["uid"]))
        if order is not None:
            last = Window.partitionBy("uid").orderBy(F.col(order).desc())
            rows = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1")
        self.nodes = rows.select("uid", "pid", "modality", "ref", F.col(order or "uid").alias("place"))
        self._paths: DataFrame | None = None
        self.rounds = 0

    def roots(self) -> DataFrame:
        return self.nodes.where(is_root())

    def edges(self) -> DataFrame:
        parent = self.nodes.select(F.col("uid").alias("ref"), F.col("modality").alias("parent_modality"))
        return self.nodes.where("ref is not null").join(parent, "ref").select("uid", "modality", F.col("ref").alias("parent"), "parent_modality")

    def paths(self) -> DataFrame:
        """pid, root, path (array of uid, modality), one row per root-to-node prefix; found once and kept."""
        return self._placed().drop("places")

    def _placed(self) -> DataFrame:
        """The paths with the places of their nodes in the index."""
        if self._paths is None:
            self._paths = self._grow()
        return self._paths

    def _grow(self) -> DataFrame:
        spark = self.nodes.sparkSession
        one = F.struct("uid", "modality", "pid", "place", is_root().alias("is_root"))
        ways = large(spark, self.nodes.select("uid", F.array(one).alias("way"), F.col("ref").alias("to")), "ways")
        self.rounds = 0
        while not ways.where("to is not null").isEmpty():
            on = ways.select(F.col("uid").alias("to"), F.col("way").alias("_way"), F.col("to").alias("_to"))
            going = ways.where("to is not null").join(on, "to", "left").select("uid", F.concat("way", F.coalesce("_way", F.slice("way", 1, 0))).alias("way"), "_to")
            uids = F.transform("way", lambda n: n["uid"])
            again = F.size(F.array_distinct(uids)) < F.size("way")
            cut = F.array_min(F.filter(F.transform("way", lambda n, i: F.when(F.array_position(uids, n["uid"]) <= i, i)), lambda i: i.isNotNull()))
            way = F.when(again, F.slice("way", F.lit(1), cut)).otherwise(F.col("way"))
            going = going.select("uid", way.alias("way"), F.when(~again, F.col("_to")).alias("to"))
            ways = large(spark, ways.where("to is null").unionByName(going), "ways")
            self.rounds += 1
        starts = ways.select(F.posexplode("way").alias("i", "top"), "way").where("top.is_root")
        down = F.reverse(F.slice("way", F.lit(1), F.col("i") + 1))
        steps = starts.select("top.pid", F.col("top.uid").alias("root"), down.alias("down"))
        path = F.transform("down", lambda n: F.struct(n["uid"].alias("uid"), n["modality"].alias("modality")))
        return stored(spark, steps.select("pid", "root", path.alias("path"), F.transform("down", lambda n: n["place"]).alias("places")), "paths")

    def query(self, query: str) -> DataFrame:
        """pid, members: distinct queried-modality paths."""
        return self._found(query).select("pid", "members").distinct()

    def discovered(self, query: str) -> DataFrame:
        """``query`` with ``discovery``, the number, from 0, of the walk that goes down from each root in the order of the index and finds these members first.

        A walk meets paths in the lexicographic order of their nodes' places, so
        the numbers come from a sort over ranges.
        """
        first = self._found(query).groupBy("pid", "members").agg(F.min("places").alias("places"))
        return row_offsets(first, ["places", "pid"], "discovery").select("pid", "members", "discovery")

    def _found(self, query: str) -> DataFrame:
        if query in ("*", "all"):
            return self._leaves()
        asked = parse_query(query)
        q = F.array(*[F.lit(m) for m in asked])
        mods = F.transform("path", lambda p: p["modality"])
        special = [m for m in ("SEG", "RTSTRUCT") if m in asked]
        parent_ok = F.forall(
            F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))),
            lambda i: F.coalesce(~F.get(mods, i).isin(*special), F.lit(True)) | F.array_contains(q, F.get(mods, i - 1)) if special else F.lit(True),
        )
        found = self._placed().where(F.forall(q, lambda m: F.array_contains(mods, m)) & parent_ok)
        return found.select("pid", F.filter("path", lambda p: F.array_contains(q, p["modality"])).alias("members"), "places")

    def _leaves(self) -> DataFrame:
        inner = self.edges().select(F.col("parent").alias("_last")).distinct()
        leaves = self._placed().withColumn("_last", F.element_at("path", -1)["uid"]).join(inner, "_last", "left_anti")
        return leaves.select("pid", F.filter("path", lambda p: p["modality"] != "RTPLAN").alias("members"), "places")

    def query_all(self) -> DataFrame:
        """pid, members: distinct leaf paths without RTPLAN."""
        return self._leaves().select("pid", "members").distinct()

    def valid_queries(self) -> DataFrame:
        """query: distinct modality strings of leaf paths that a query may ask for."""
        names = self.query_all().select(F.array_distinct(F.transform("members", lambda p: p["modality"])).alias("m")).distinct()
        has = lambda *ms: F.arrays_overlap("m", F.array(*[F.lit(m) for m in ms]))
        ok = F.forall("m", lambda m: m.isin(*MODALITIES)) & (~has("RTSTRUCT", "RTDOSE") | has("CT", "MR", "PT")) & (~has("SEG") | has("CT", "MR"))
        return names.where(ok).select(F.concat_ws(",", "m").alias("query")).distinct()

    def summary(self) -> DataFrame:
        roots = self.roots().select(F.lit(1).alias("is_root"), F.col("uid"))
        rows = self.nodes.join(roots, "uid", "left")
        return rows.agg(
            F.count_distinct("pid").alias("n_patients"),
            F.count(F.lit(1)).alias("n_series"),
            F.count("is_root").alias("n_roots"),
            F.count("ref").alias("n_series_with_references"),
        )


def group_by_root(samples: DataFrame) -> DataFrame:
    """One sample per first member: it, then the others, distinct and sorted."""
    first = F.element_at("members", 1)
    rest = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.slice("members", 2, F.greatest(F.size("members"), F.lit(1)))))))
    return samples.groupBy("pid", first.alias("first")).agg(rest.alias("others"))


def members_text(members: Column | str) -> Column:
    return F.array_join(F.transform(members, lambda p: F.concat_ws(":", p["modality"], p["uid"].cast("string"))), ",")


def check_duplicates(index: DataFrame, keys: list[str]) -> None:
    if not duplicate_rows(index, keys, "_n").isEmpty():
        raise DuplicateRowError("the index has duplicate rows")


def duplicate_rows(index: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return index.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)


def numbered(samples: DataFrame, patient: str, tie: str, first: int = 0) -> DataFrame:
    """Samples in order of the lower-case patient, numbered with four digits or more."""
    rows = row_offsets(samples, [F.lower(F.col(patient).cast("string")), F.col(tie)], "_at")
    at = F.col("_at") + first
    return rows.withColumn("sample_number", F.when(at < 10000, F.lpad(at.cast("string"), 4, "0")).otherwise(at.cast("string"))).drop("_at")


def by_patient(roots: DataFrame) -> DataFrame:
    """pid, roots (array of uid, modality): the roots of each patient, ordered by patient."""
    listed = F.array_sort(F.collect_list(F.struct("uid", "modality"))).alias("roots")
    return roots.groupBy("pid").agg(listed).orderBy("pid")


def query_text(modalities: list[str] | None = None) -> str:
    """The query string of a list of modalities; none asks for everything."""
    return ",".join(modalities) if modalities else "*"


def missing_series(asked: DataFrame, loaded: DataFrame, key: str = "series") -> DataFrame:
    """Asked series that were not loaded."""
    return asked.join(loaded.select(key).distinct(), key, "left_anti")


def loaded_series(asked: DataFrame, loaded: DataFrame, key: str = "series") -> DataFrame:
    """Asked series that were loaded."""
    return asked.join(loaded.select(key).distinct(), key, "left_semi")


def reference_series(members: DataFrame, sample: str, modality: str, pos: str) -> DataFrame:
    """The sample's reference series: CT before MR before PT, then the first."""
    rank = F.array_position(F.array(F.lit("CT"), F.lit("MR"), F.lit("PT")), F.col(modality))
    top = Window.partitionBy(sample).orderBy(rank, pos)
    return members.where(F.col(modality).isin(*IMAGING)).withColumn("_n", F.row_number().over(top)).where("_n = 1").drop("_n")


def extra_reference_series(members: DataFrame, sample: str, modality: str, pos: str) -> DataFrame:
    """Further series of the reference series' modality, which a sample leaves aside."""
    first = reference_series(members, sample, modality, pos).select(sample, F.col(modality).alias("_m"), F.col(pos).alias("_p"))
    return members.join(first, sample).where((F.col(modality) == F.col("_m")) & (F.col(pos) != F.col("_p"))).drop("_m", "_p")
