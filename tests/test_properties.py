"""Property tests: each example is a whole generated batch, checked in one Spark job."""

import csv
import io
import math

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.render import csv_line, number_text
from tallyspark.operators import reduce as R
from tallyspark.operators.ordering import number_rows
from tallyspark.spec import Metric, ReduceSpec

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

finite = st.floats(allow_nan=False, allow_infinity=False, width=64)


def js_number_text(v: float) -> str:
    """Number::toString as JavaScript defines it, from Python's shortest round-trip digits."""
    from decimal import Decimal

    if v == 0:
        return "0"
    r = repr(v)
    if 1e-6 <= abs(v) < 1e21:
        text = format(Decimal(r), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    mantissa, exp = (r.split("e") + ["0"])[:2]
    mantissa = mantissa[:-2] if mantissa.endswith(".0") else mantissa
    return f"{mantissa}e{'+' if int(exp) > 0 else '-'}{abs(int(exp))}"


@SETTINGS
@given(st.lists(finite, min_size=1, max_size=200))
def test_number_text_round_trips_in_javascript_form(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = [r.t for r in df.select(number_text(F.col("x"), T.DoubleType()).alias("t")).collect()]
    for x, t in zip(xs, got):
        assert float(t) == x or (x == 0 and float(t) == 0)
        if 1e-6 <= abs(x) < 1e21:
            assert t == js_number_text(x)  # exact JavaScript text inside the plain range
        elif x != 0:
            assert "e" in t and "E" not in t


text = st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\r\x00"), max_size=30)


@SETTINGS
@given(st.lists(st.tuples(text, text), min_size=1, max_size=50))
def test_csv_lines_parse_back(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string")
    lines = [r.v for r in df.select(csv_line(df).alias("v")).collect()]
    for (a, b), line in zip(rows, lines):
        parsed = next(csv.reader(io.StringIO(line + "\n")))
        assert parsed == [a, b]


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.one_of(st.none(), st.integers(-10**6, 10**6))),
                min_size=1, max_size=300))
def test_reduce_matches_pandas(spark, rows):
    df = spark.createDataFrame(rows, "g string, v long")
    spec = ReduceSpec(group_by=("g",), metrics=(Metric("count", "n"), Metric("sum", "s", "v"), Metric("min", "lo", "v"),
                                                Metric("max", "hi", "v"), Metric("avg", "m", "v")))
    got = {r.g: (r.n, r.s, r.lo, r.hi, r.m) for r in R.reduce(df, spec).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v"]).astype({"v": "Int64"})
    want = {}
    for g, part in pdf.groupby(pdf["g"].astype(object).where(pdf["g"].notna(), "__null__"), dropna=False):
        vals = part["v"].dropna()
        key = None if g == "__null__" else g
        want[key] = (len(part), int(vals.sum()) if len(vals) else 0, int(vals.min()) if len(vals) else None,
                     int(vals.max()) if len(vals) else None, (float(vals.sum()) / len(vals)) if len(vals) else None)
    assert set(got) == set(want)
    for k in want:
        n, s, lo, hi, m = got[k]
        assert (n, s, lo, hi) == want[k][:4]
        assert (m is None and want[k][4] is None) or math.isclose(m, want[k][4], rel_tol=1e-12)


@SETTINGS
@given(st.sets(st.integers(-10**9, 10**9), min_size=1, max_size=400), st.integers(1, 7))
def test_number_rows_matches_row_number(spark, keys, parts):
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(parts)
    got = number_rows(df, [F.col("k")]).select("k", "rn")
    want = df.select("k", F.row_number().over(Window.orderBy("k")).alias("rn"))
    assert got.exceptAll(want).count() == 0 and got.count() == len(keys)


json_text = st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=40)


@SETTINGS
@given(st.lists(json_text, min_size=1, max_size=100))
def test_json_strings_escape_like_json_stringify(spark, values):
    import json

    from tallyspark.functions.render import json_string

    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r.j for r in df.select(json_string(F.col("s")).alias("j")).collect()]
    assert got == [json.dumps(v, ensure_ascii=False) for v in values]
