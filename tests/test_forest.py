import pytest
from seriesgrove.errors import DuplicateRowError, MissingDependencyModalityError, UnsupportedModalityError
from seriesgrove.operators import crawl, forest
from seriesgrove.operators.forest import SeriesForest, members_text, parse_query

ROWS = [
    ("c1", "P", "CT", None), ("p1", "P", "PT", "c1"), ("r1", "P", "RTSTRUCT", "p1"), ("r2", "P", "RTSTRUCT", "c1"), ("d1", "P", "RTDOSE", "c1"), ("l1", "P", "RTPLAN", "r2"),
    ("m1", "P", "MR", ""), ("s1", "P", "SEG", "m1"), ("p2", "P", "PT", ""), ("x1", "P", "SEG", "zz"), ("sr1", "P", "SR", "c1;m1"), ("y1", "P", "RTSTRUCT", "y1"),
]


@pytest.fixture(scope="module")
def tree(spark):
    return SeriesForest(spark.createDataFrame(ROWS, "uid string, pid string, modality string, ref string"))


def found(df):
    return sorted(r.m for r in df.select(members_text("members").alias("m")).collect())


def test_queries_follow_one_chain(tree):
    assert found(tree.query("CT,PT,RTSTRUCT")) == ["CT:c1,PT:p1,RTSTRUCT:r1"]
    assert found(tree.query("CT,RTSTRUCT")) == ["CT:c1,RTSTRUCT:r2"]
    assert found(tree.query("MR,SEG")) == ["MR:m1,SEG:s1"]
    assert found(tree.query("CT,RTSTRUCT,RTDOSE")) == []


def test_all_paths_without_plans_orphans_or_cycles(tree):
    assert found(tree.query("*")) == ["CT:c1,PT:p1,RTSTRUCT:r1", "CT:c1,RTDOSE:d1", "CT:c1,RTSTRUCT:r2", "MR:m1,SEG:s1", "PT:p2"]


def test_group_by_root(tree):
    g = forest.group_by_root(tree.query("CT,RTDOSE"))
    assert [(r["first"].uid, [o.uid for o in r.others]) for r in g.collect()] == [("c1", ["d1"])]


@pytest.mark.parametrize(("q", "error"), [("PT,SEG", MissingDependencyModalityError), ("RTSTRUCT,RTDOSE", MissingDependencyModalityError), ("CT, SEG", UnsupportedModalityError), ("XX", UnsupportedModalityError)])
def test_bad_queries(q, error):
    with pytest.raises(error):
        parse_query(q)


def test_parse_order():
    assert parse_query("RTSTRUCT,CT,CT") == ["CT", "RTSTRUCT"]


def test_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1)], "u string, n int")
    with pytest.raises(DuplicateRowError):
        forest.check_duplicates(df, ["u", "n"])


def test_index_from_instances(spark):
    schema = "path string, PatientID string, StudyInstanceUID string, SeriesInstanceUID string, SOPInstanceUID string, Modality string, AcquisitionNumber string, FrameOfReferenceUID string, ReferencedSeriesUID string, ReferencedSOPUIDs array<string>"
    rows = [
        ("d/a.dcm", "P", "S", "c1", "i1", "CT", "", "F", "", []), ("d/b.dcm", "P", "S", "c1", "i2", "CT", "None", "F", "", []), ("e/c.dcm", "P", "S", "p1", "i3", "PT", "1", "F", "", []),
        ("f/d.dcm", "P", "S", "g1", "i4", "SEG", "2", "G", "", ["i2", "nope"]), ("h/e.dcm", "P", "S", "r1", "i5", "SR", "1", "G", "c1;p1", []),
    ]
    got = {r.SeriesInstanceUID: r for r in crawl.build_index(spark.createDataFrame(rows, schema)).collect()}
    assert (got["c1"].instances, got["c1"].SubSeries, got["c1"].folder) == (2, "1", "d")
    assert (got["p1"].ReferencedSeriesUID, got["p1"].ReferencedModality) == ("c1", "CT")
    assert (got["g1"].ReferencedSeriesUID, got["g1"].ReferencedModality) == ("c1", "CT")
    assert got["r1"].ReferencedModality == "CT;PT"


def test_deep_chains_and_cycles(spark):
    chain = [("n0", "P", "CT", None)] + [(f"n{i}", "P", "PT" if i % 2 else "CT", f"n{i - 1}") for i in range(1, 40)]
    chain = [(u, p, "SEG" if i else "CT", r) for i, (u, p, _, r) in enumerate(chain)]
    cycle = [("q", "Q", "MR", "s"), ("r", "Q", "SEG", "q"), ("s", "Q", "SEG", "r")]
    t = SeriesForest(spark.createDataFrame(chain + cycle, "uid string, pid string, modality string, ref string"))
    sizes = sorted(len(r.path) for r in t.paths().collect())
    assert sizes == sorted([*range(1, 41), 1, 2, 3])
    assert [len(r.members) for r in t.query("*").collect() if r.pid == "P"] == [40]


def test_sample_numbers(spark):
    rows = [(p, i) for i, p in enumerate(["b", "A", "a", "C", "c", "b"])]
    df = spark.createDataFrame(rows, "pid string, root int").repartition(3)
    got = {(r.pid, r.root): r.sample_number for r in forest.numbered(df, "pid", "root", 1).collect()}
    want = {x: f"{n:04d}" for n, x in enumerate(sorted(rows, key=lambda x: (x[0].lower(), x[1])), 1)}
    assert got == want and forest.numbered(df.limit(0), "pid", "root").count() == 0


def test_patients_and_extra_series(spark, tree):
    assert [(r.pid, [x.uid for x in r.roots]) for r in forest.by_patient(tree.roots()).collect()] == [("P", ["c1", "m1", "p2"])]
    members = spark.createDataFrame([("s", "MR", 1), ("s", "CT", 2), ("s", "CT", 3), ("s", "SEG", 4), ("t", "PT", 1)], "sample string, modality string, pos int")
    assert {(r.sample, r.pos) for r in forest.reference_series(members, "sample", "modality", "pos").collect()} == {("s", 2), ("t", 1)}
    assert [(r.sample, r.pos) for r in forest.extra_reference_series(members, "sample", "modality", "pos").collect()] == [("s", 3)]
    assert forest.query_text(["CT", "SEG"]) == "CT,SEG" and forest.query_text() == "*"


def walk(rows):
    """Leaf paths in the order of a walk down from each root, children and roots in the order of the rows."""
    kids, out = {}, []
    for uid, _, _, ref in rows:
        kids.setdefault(ref, []).append(uid)
    kind = {uid: m for uid, _, m, _ in rows}

    def down(path):
        below = kids.get(path[-1], [])
        if not below:
            m = ",".join(f"{kind[u]}:{u}" for u in path if kind[u] != "RTPLAN")
            if m not in out:
                out.append(m)
        for u in below:
            if u not in path:
                down([*path, u])

    for uid, _, m, ref in rows:
        if m in ("CT", "MR") or (m == "PT" and not ref):
            down([uid])
    return out


def test_discovery_order(spark):
    rows = [("z1", "P", "CT", None), ("b1", "P", "RTSTRUCT", "z1"), ("a1", "P", "CT", None), ("k1", "P", "RTSTRUCT", "a1"), ("c1", "P", "PT", "z1"), ("y1", "P", "RTPLAN", "b1"), ("d1", "P", "RTSTRUCT", "c1"), ("e1", "P", "RTDOSE", "c1"),
            ("a0", "P", "RTPLAN", "b1"), ("x1", "P", "RTDOSE", "a1"), ("g1", "P", "RTSTRUCT", "c1"), ("m2", "Q", "MR", None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "uid string, pid string, modality string, ref string, n int")
    tree = SeriesForest(df, order="n")
    got = tree.discovered("*").select("discovery", members_text("members").alias("m")).collect()
    assert [r.m for r in sorted(got)] == walk(rows) and [r.discovery for r in sorted(got)] == list(range(len(got)))
    some = [r.m for r in sorted(tree.discovered("CT,RTSTRUCT").select("discovery", members_text("members").alias("m")).collect())]
    assert some == ["CT:z1,RTSTRUCT:b1", "CT:a1,RTSTRUCT:k1"]


def test_a_long_chain_takes_few_rounds(spark):
    n = 300
    rows = [("u0", "P", "CT", None)] + [(f"u{i}", "P", "RTDOSE", f"u{i - 1}") for i in range(1, n)] + [("t0", "P", "MR", "t2"), ("t1", "P", "RTDOSE", "t0"), ("t2", "P", "RTDOSE", "t1"), ("t3", "P", "SEG", "t1")]
    tree = SeriesForest(spark.createDataFrame(rows, "uid string, pid string, modality string, ref string"))
    got = {(r.root, tuple(p.uid for p in r.path)) for r in tree.paths().collect()}
    want = {("u0", tuple(f"u{j}" for j in range(i + 1))) for i in range(n)} | {("t0", ("t0", "t1", "t2")[: k + 1]) for k in range(3)} | {("t0", ("t0", "t1", "t3"))}
    assert got == want and tree.rounds <= 10
