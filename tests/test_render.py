import datetime as dt
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.render import csv_line, json_line, normalize, number_text
from tallyspark.sinks.text import csv_lines, json_array_lines


def test_number_text_like_javascript(spark):
    vals = [300.0, 12345678.9, 1e-5, -0.0, float("nan"), None, 1e21, 1e-7, 0.1, -2.5, 123456789012345680000.0, 1.5e300]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.t for r in df.select(number_text(F.col("x"), T.DoubleType()).alias("t")).collect()]
    assert got == ["300", "12345678.9", "0.00001", "0", None, None, "1e+21", "1e-7", "0.1", "-2.5",
                   "123456789012345680000", "1.5e+300"]


def test_csv_lines_quote_what_needs_it(spark):
    rows = [(5, "plain", "x"), (4, "comma, and", '"'), (6, "line\nbreak", "a\"b\"c")]
    lines = [r.value for r in csv_lines(spark.createDataFrame(rows, "no long, left string, right string"), [F.col("no")]).collect()]
    assert lines == ["no,left,right", '4,"comma, and",""""', "5,plain,x", '6,"line\nbreak","a""b""c"']


def test_csv_quoting_rules(spark):
    df = spark.createDataFrame(
        [(1, "a\rb", True, None, 2.0), (2, "", False, float("nan"), 0.5), (3, "x\ny", None, 1.0, None)],
        "id long, s string, b boolean, d double, e double",
    )
    got = [r.v for r in df.orderBy("id").select(csv_line(df).alias("v")).collect()]
    assert got == ["1,a\rb,true,,2", "2,,false,null,0.5", '3,"x\ny",,1,']


def test_json_line_keeps_nulls_and_order(spark):
    df = spark.createDataFrame([(2, "pending", None, dt.datetime(2024, 2, 1, 10, 20, 30))],
                               "id long, status string, note string, at timestamp")
    line = df.select(json_line(df).alias("j")).first().j
    assert line == '{"id":2,"status":"pending","note":null,"at":"2024-02-01T10:20:30.000Z"}'
    assert json.loads(line)["note"] is None


def test_json_nested_and_escapes(spark):
    schema = "id long, tags array<string>, doc struct<a:double,b:string>, m map<string,long>"
    df = spark.createDataFrame([(1, ["x", None, 'q"'], (300.0, "t\tab"), {"k": 1})], schema)
    line = df.select(json_line(df).alias("j")).first().j
    assert line == '{"id":1,"tags":["x",null,"q\\""],"doc":{"a":300,"b":"t\\tab"},"m":{"k":1}}'


def test_json_array_lines(spark):
    schema = "k long, flag boolean"
    assert [r.value for r in json_array_lines(spark.createDataFrame([], schema), [F.col("k")]).collect()] == ["[]"]
    three = spark.createDataFrame([(30, None), (-4, True), (9, False)], schema)
    lines = [r.value for r in json_array_lines(three, [F.col("k")]).collect()]
    assert lines == ['[{"k":-4,"flag":true}', ',{"k":9,"flag":false}', ',{"k":30,"flag":null}', "]"]


def test_csv_empty_input_has_no_header(spark):
    empty = spark.createDataFrame([], "id long, status string")
    assert csv_lines(empty, [F.col("id")]).count() == 0


def test_times_become_text_at_any_depth(spark):
    day, at = dt.date(1999, 12, 31), dt.datetime(2031, 7, 8, 9, 0, 1, 5000)
    schema = "tag string, day date, stops array<struct<at:timestamp,n:int>>, due map<string,timestamp>"
    r = normalize(spark.createDataFrame([("t", day, [(at, 1), (None, 2)], {"x": at})], schema)).first()
    text = "2031-07-08T09:00:01.005Z"
    assert (r.tag, r.day, r.due) == ("t", "1999-12-31T00:00:00.000Z", {"x": text})
    assert [tuple(s) for s in r.stops] == [(text, 1), (None, 2)]


def test_iso_truncates_micros(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 7, 179575),)], "ts timestamp_ntz")
    assert normalize(df).first().ts == "2024-01-01T00:00:07.179Z"


def test_number_text_more_magnitudes(spark):
    vals = [1.2345678901234567e-6, 0.001, 0.00099, 1e7, 12345678.25, 9007199254740993.0, 1e20, 123e-20, -1e-7]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.t for r in df.select(number_text(F.col("x"), T.DoubleType()).alias("t")).collect()]
    assert got == ["0.0000012345678901234567", "0.001", "0.00099", "10000000", "12345678.25", "9007199254740992",
                   "100000000000000000000", "1.23e-18", "-1e-7"]


def test_csv_leaves_carriage_return_hash_and_blanks_unquoted(spark):
    df = spark.createDataFrame([("#tag",), (" lead",), ("",), ("a\rb",), (None,)], "s string")
    assert [r.v for r in df.select(csv_line(df).alias("v")).collect()] == ["#tag", " lead", "", "a\rb", ""]


def test_odd_column_names_render(spark, workdir):
    df = spark.createDataFrame([(1, "x", 2.0)], "id long, `a.b` string, `with space` double")
    lines = [r.value for r in csv_lines(df, [F.col("id")]).collect()]
    assert lines == ["id,a.b,with space", "1,x,2"]
    assert json.loads(df.select(json_line(df).alias("j")).first().j) == {"id": 1, "a.b": "x", "with space": 2}
    assert normalize(df).columns == ["id", "a.b", "with space"]


def test_number_text_large_integers_use_fewest_digits(spark):
    vals = [3.509279706980837e18, 1.940495815998049e18, 7.651706268464958e18, 2.0 ** 63, 2.0 ** 64, 2.0 ** 53 + 2, 5e16]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.t for r in df.select(number_text(F.col("x"), T.DoubleType()).alias("t")).collect()]
    assert got == ["3509279706980837000", "1940495815998049000", "7651706268464958000", "9223372036854776000",
                   "18446744073709552000", "9007199254740994", "50000000000000000"]
