import datetime

import pytest
from pyspark.sql import functions as F
from seriesgrove.errors import InvalidPatternError, MissingPlaceholderValueError
from seriesgrove.functions import nested, spatial as G, strings as X


def one(spark, column):
    return spark.range(1).select(column.alias("v")).head().v


@pytest.mark.parametrize(("raw", "want"), [("a b.txt", "a_b.txt"), ("a - b", "a-b"), ("<>:valid?", "valid"), ("   <>:?*|   valid.txt   ", "__valid.txt"), ("x/y z", "x/y_z")])
def test_sanitize(spark, raw, want):
    assert one(spark, X.sanitize_file_name(F.lit(raw))) == want


def test_dates_and_times(spark):
    assert one(spark, X.dicom_date(F.lit("20231015"))) == datetime.date(2023, 10, 15)
    assert one(spark, X.dicom_date(F.lit("20231345"))) is None
    assert one(spark, X.dicom_date(F.lit("2023-10-15"))) is None
    assert one(spark, X.dicom_time_micros(F.lit("110234.982284"))) == 39754982284
    assert one(spark, X.dicom_time_micros(F.lit("2511"))) is None
    assert one(spark, X.header_value("ContentTime", F.lit("111131"))) == "11:11:31"
    assert one(spark, X.header_value("StudyDate", F.lit("None"))) is None


def test_uids_patterns_and_keys(spark):
    assert one(spark, X.truncate_uid(F.lit("1.2.345678"), 5)) == "45678"
    assert one(spark, X.truncate_uid(F.lit("1.2"), 5)) == "1.2"
    assert one(spark, X.truncate_uid(F.lit("1.2.3"), 0)) == "1.2.3"
    assert one(spark, X.template("%A/{B}.nii", {"A": F.lit("x"), "B": F.lit(2)})) == "x/2.nii"
    with pytest.raises(InvalidPatternError):
        X.template("plain", {})
    with pytest.raises(MissingPlaceholderValueError):
        X.template("%A", {})
    assert one(spark, X.natural_sort_key(F.lit("img10_A2"))) == ["img", "0" * 18 + "10", "_a", "0" * 19 + "2"]
    assert X.case_insensitive_glob("dcm") == "[dD][cC][mM]"


def vec(x, y, z):
    return G.vec(F.lit(x), F.lit(y), F.lit(z))


def flat(r):
    return tuple(r.min) + tuple(r.max)


def test_boxes(spark):
    b = G.box(vec(12, 13, 14), vec(21, 23, 25))
    cube = G.expand_to_cube(b, 13)
    assert flat(one(spark, cube)) == (10, 11, 13, 23, 24, 26)
    assert flat(one(spark, G.clamp(cube, vec(20, 20, 20)))) == (7, 7, 7, 20, 20, 20)
    assert flat(one(spark, G.pad(G.box(vec(5, 5, 5), vec(10, 10, 10)), 5))) == (0, 0, 0, 15, 15, 15)
    assert flat(one(spark, G.pad(G.box(vec(5, 5, 5), vec(10, 10, 10)), 5, both=False))) == (5, 5, 5, 15, 15, 15)


def test_directions_and_sizes(spark):
    d = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)])
    assert one(spark, G.flip_axis(d, 2))[8] == -1
    assert one(spark, G.is_normalized(d)) is True
    assert tuple(one(spark, G.resampled_size(vec(5, 3, 7), vec(0.5, 0.5, 1.0), vec(1.0, 1.0, 0.0)))) == (2, 2, 7)
    assert one(spark, G.floor_div(vec(5, 6, 7), 2)) == (2, 3, 3)


def test_nested(spark):
    df = spark.createDataFrame([('{"a":{"b":[1,2]},"c":"x"}',)], "j string")
    assert df.select(nested.lookup("j", "a.b[1]")).head()[0] == "2"
    assert {r.key for r in nested.flatten_json(df, "j").collect()} == {"a", "c"}
    n = spark.sql("select named_struct('x', 1, 'y', named_struct('z', 2)) as s, double('NaN') as d")
    f = nested.flatten_struct(n)
    assert f.columns == ["s.x", "s.y.z", "d"]
    assert nested.expand_struct(f).head().s.y.z == 2
    assert nested.cleanse(n).head().d is None
