from pyspark.sql import functions as F

from geoweave.functions import pgcompat as pg
from geoweave.operators.relational import classify_bands
from geoweave.plans.fixed import VOLTAGE_BANDS


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_substring_before_one_consumes_length(spark):  # T1
    assert one(spark, pg.pg_substring(F.lit("abcdef"), 0, 5)) == "abcd"
    assert one(spark, pg.pg_substring(F.lit("abcdef"), -2, 5)) == "ab"
    assert one(spark, pg.pg_substring(F.lit("abcdef"), 2, 3)) == "bcd"


def test_concat_ignores_null(spark):  # T2
    assert one(spark, pg.pg_concat(F.lit("a"), F.lit(None).cast("string"), F.lit("b"))) == "ab"


def test_iri_encoding(spark):  # T3
    assert one(spark, pg.iri_encode(F.lit("a b/c*~-_."))) == "a%20b%2Fc%2A~-_."
    assert one(spark, pg.replace_chain(F.lit("a b/c"), [(" ", "%20"), ("/", "%2F")])) == "a%20b%2Fc"


def test_trim_split_json(spark):
    assert one(spark, pg.trim_leading(F.lit("000120"), "0")) == "120"
    assert one(spark, pg.split_part(F.lit("way/1"), "/", 2)) == "1"
    assert one(spark, pg.json_path_text(F.lit('[{"rel": "r1"}]'), "$[0].rel")) == "r1"


def test_to_number_is_lenient(spark):  # T15
    vals = ["3.55", "123456", "-3", "12.5", "1,234.5", "3.5-", "abc"]
    df = spark.createDataFrame([(v,) for v in vals], "s string").select(pg.pg_to_number("s").alias("n"))
    assert [r["n"] for r in df.collect()] == [3.55, 123456.0, -3.0, 12.5, 1234.5, -3.5, None]


def test_voltage_band_boundaries(spark):  # FIXTURES §2, T5
    vals = [0, 1, 34, 35, 229, 230, None]
    df = spark.createDataFrame([(v,) for v in vals], "v int").select(classify_bands("v", VOLTAGE_BANDS).alias("b"))
    assert [r["b"] for r in df.collect()] == [None, "M", "M", "H", "H", "S", None]


def test_path_helpers(spark):  # X15
    assert one(spark, pg.sanitise_filename(F.lit("abc/efg/+Hello()World-123.csv"))) == "_Hello__World_123.csv"
    assert one(spark, pg.strip_extension(F.lit("abc/efg/123.csv"))) == "123"
    assert one(spark, pg.strip_extension(F.lit(".hidden"))) == ".hidden"
    assert one(spark, pg.replace_extension(F.lit("a/b.csv"), "json")) == "a/b.json"
    cases = [("/", "", True, True), ("/", "", True, False), ("/", "", False, True), ("", "", False, False),
             ("/path/", "path", True, True), ("/path", "path", True, False), ("path/", "path", False, True),
             ("path", "path", False, False), ("/path/", "/path/", True, True), ("path", "/path/", False, False),
             ("/path/file/", "path/file", True, True)]
    for expected, value, lead, trail in cases:
        assert one(spark, pg.fix_slashes(F.lit(value), lead, trail)) == expected, (value, lead, trail)


def test_date_label_runs():  # T8
    assert pg.label_cuts("yyyymmdd") == [4, 6, 6]
    assert pg.label_cuts("yyyyddmmz") == [4, 6, 8]


def test_split_date_label(spark):  # X17
    assert one(spark, pg.split_date_label(F.lit("20240203"), "yyyymmdd")) == "2024/02/03"
    assert one(spark, pg.split_date_label(F.lit("202402"), "yyyymm")) == "2024/02"
    assert one(spark, pg.split_date_label(F.lit("2024020312"), "yyyyddmmz")) == "2024/02/03:12"
    assert one(spark, pg.split_date_label(F.lit("20240203"), "xxxxxxxx")) == "20240203"


def test_parse_datetime_defaults(spark):  # X16, X18
    import datetime as dt
    assert one(spark, pg.parse_datetime(F.lit("2024"), "yyyy")) == dt.datetime(2024, 1, 1)
    assert one(spark, pg.parse_datetime(F.lit("2024-03-05 10"), "yyyy-MM-dd HH", "Europe/London")) == dt.datetime(2024, 3, 5, 10)
    assert one(spark, pg.parse_datetime(F.lit("2024-07-05 10"), "yyyy-MM-dd HH", "Europe/London")) == dt.datetime(2024, 7, 5, 9)
    assert one(spark, pg.time_from_name(F.lit("rain_2024020312_v1.nc"), r".*([0-9]{10}).*", "yyyyMMddHH")) == \
        dt.datetime(2024, 2, 3, 12)


def test_stable_uuid_is_deterministic(spark):
    a = one(spark, pg.stable_uuid(F.lit("x"), prefix="building_"))
    assert a == one(spark, pg.stable_uuid(F.lit("x"), prefix="building_"))
    assert a.startswith("building_") and len(a) == len("building_") + 36
