"""Rendering as Column expressions.

Every function here builds a JVM-side expression from the schema, so rendering stays inside
whole-stage codegen: no Python UDF touches a row.

Text rules follow JavaScript, the language the reports were specified in:
numbers print as ``Number.prototype.toString`` does (``300``, not ``300.0``), dates as
``toISOString`` (UTC, milliseconds, ``Z``), rows as ``JSON.stringify`` (compact, nulls kept,
column order kept).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Output text formats.
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
CSV_SPECIALS = (",", '"', "\n")  # a cell holding any of these is quoted
JSON_ESCAPED = '[\\x00-\\x1f"\\\\]'  # characters JSON text must escape
HEX_LETTER_CONTROLS = "[\\x0b\\x0e\\x0f\\x1a-\\x1f]"  # controls escaped as \u00XX with a hex letter

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def qcol(name: str) -> Column:
    """A column by its exact name (dots, spaces and backticks in source names stay literal)."""
    return F.col("`" + name.replace("`", "``") + "`")
FRACTIONAL = (T.FloatType, T.DoubleType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def iso_text(c: Column, dtype: T.DataType | None = None) -> Column:
    """ISO-8601 in UTC with millisecond precision (micros are truncated)."""
    if isinstance(dtype, T.DateType):
        c = c.cast("timestamp_ntz")
    return F.date_format(c, ISO_FORMAT)


def number_text(c: Column, dtype: T.DataType) -> Column:
    """A number as JavaScript prints it; NULL for null, NaN and infinities
    (``JSON.stringify`` writes those as ``null``).

    The common case is cheap: the JVM already prints ``1e-3 <= |x| < 1e7`` in plain
    notation, so only a trailing ``.0`` goes.  Other magnitudes take the slower routes:
    integral values through DECIMAL(38,0), other values in JavaScript's plain range through
    a DECIMAL wide enough for 17 significant digits, and outside it the exponent is
    rewritten (``1.0E-7`` -> ``1e-7``, ``1.0E21`` -> ``1e+21``).  Doubles cast to DECIMAL
    through their shortest decimal text, so no binary noise digits appear."""
    if isinstance(dtype, INTEGRAL):
        return c.cast("string")
    if isinstance(dtype, T.DecimalType):
        text = c.cast("string")
        return F.when(F.instr(text, ".") > 0, F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    if not isinstance(dtype, FRACTIONAL):
        raise TypeError(f"number_text on {dtype.simpleString()}")
    x = c.cast("double")
    absx = F.abs(x)
    java = x.cast("string")  # Double.toString: plain for 1e-3 <= |x| < 1e7, else 1.0E-7 / 1.5E21
    common = F.when(java.endswith(".0"), F.substr(java, F.lit(1), F.length(java) - F.lit(2))).otherwise(java)
    strip = lambda t: F.regexp_replace(t.cast("string"), r"\.?0+$", "")
    # Integral and >= 1e7: the JVM prints d.dddE<n>; shift the point by padding the digits
    # with zeros (a DECIMAL cast would keep the binary expansion's noise digits).
    sci = r"^(-?)([0-9])\.([0-9]+)E([0-9]+)$"
    digits = F.concat(F.regexp_extract(java, sci, 2), F.regexp_replace(F.regexp_extract(java, sci, 3), "0+$", ""))
    integral_sci = F.concat(
        F.regexp_extract(java, sci, 1), F.rpad(digits, F.regexp_extract(java, sci, 4).cast("int") + F.lit(1), F.lit("0"))
    )
    # From 2^53 on every double is an integer, and Double.toString (before Java 19) may print
    # more digits than needed.  Take the exact integer (a BIGINT cast below 2^63; above it every
    # double is a multiple of 2048), round it in DECIMAL to 15, 16 or 17 significant digits and
    # keep the fewest that parse back to x -- JavaScript's rule.  The result is already the
    # plain integer text JavaScript prints below 1e21.
    dec = T.DecimalType(38, 0)
    exact = F.when(absx < F.lit(2.0 ** 63), x.cast("long").cast(dec)).otherwise(
        (x / F.lit(2048.0)).cast("long").cast(dec) * F.lit(2048).cast(dec)
    )

    def fewest_digits(e: Column) -> Column:  # e: the exact integer, bound once by transform()
        n_digits = F.length(F.abs(e).cast("string"))

        def to_digits(k: int) -> Column:
            scale = F.concat(F.lit("1"), F.repeat(F.lit("0"), F.greatest(n_digits - F.lit(k), F.lit(0)))).cast(dec)
            return (F.round(e / scale, 0) * scale).cast(dec)

        candidates = F.array(to_digits(15), to_digits(16), to_digits(17))  # 17 digits always round-trip
        return F.filter(candidates, lambda c: c.cast("double") == x).getItem(0).cast("string")

    big_integral = F.transform(F.array(exact), fewest_digits).getItem(0)
    rare = (
        F.when(x == F.lit(0.0), F.lit("0"))
        .when((absx >= F.lit(2.0 ** 53)) & (absx < F.lit(1e21)), big_integral)
        .when((absx >= F.lit(1e7)) & (absx < F.lit(1e21)) & (F.rint(x) == x), integral_sci)
        .when((absx < F.lit(1e21)) & (F.rint(x) == x), x.cast(T.DecimalType(38, 0)).cast("string"))
        # non-integral: |x| < 2^53, at most 17 significant digits
        .when((absx >= F.lit(1e-6)) & (absx < F.lit(1e-3)), strip(x.cast(T.DecimalType(38, 30))))
        .when((absx >= F.lit(1e7)) & (absx < F.lit(1e21)), strip(x.cast(T.DecimalType(38, 18))))
        .otherwise(F.replace(F.regexp_replace(F.regexp_replace(java, r"\.0E", "E"), r"E([0-9])", "e+$1"), F.lit("E-"), F.lit("e-")))
    )
    return (
        F.when(F.isnan(x) | (absx == F.lit(float("inf"))), F.lit(None).cast("string"))
        .when((absx >= F.lit(1e-3)) & (absx < F.lit(1e7)), common)
        .otherwise(rare)
    )


def json_string(c: Column) -> Column:
    """A JSON string literal for a string value, escaped as ``JSON.stringify`` escapes.

    Text with nothing to escape (no quote, backslash or control character) is just quoted;
    the rest goes through the JVM's JSON writer.  That writer prints ``\\u001F`` where
    ``JSON.stringify`` prints ``\\u001f``, so the few control characters whose escape has a hex
    letter get their escapes lowered (never touching an escaped backslash before ``u001F``)."""
    arr = F.to_json(F.array(c))  # ["..."]
    escaped = F.substr(arr, F.lit(2), F.length(arr) - F.lit(2))
    lowered = escaped
    for code in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"):
        lowered = F.regexp_replace(lowered, r"(?<!\\)((?:\\\\)*)\\u00" + code, r"$1\\u00" + code.lower())
    return (
        F.when(~c.rlike(JSON_ESCAPED), F.concat(F.lit('"'), c, F.lit('"')))
        .when(c.rlike(HEX_LETTER_CONTROLS), lowered)
        .otherwise(escaped)
    )


def json_value(c: Column, dtype: T.DataType) -> Column:
    """X2 for one value: its JSON text, ``null`` included (never SQL NULL)."""
    if isinstance(dtype, T.StringType):
        return F.when(c.isNull(), F.lit("null")).otherwise(json_string(c))
    if isinstance(dtype, T.BooleanType):
        return F.when(c.isNull(), F.lit("null")).otherwise(F.when(c, F.lit("true")).otherwise(F.lit("false")))
    if isinstance(dtype, (*INTEGRAL, *FRACTIONAL, T.DecimalType)):
        return F.coalesce(number_text(c, dtype), F.lit("null"))
    if isinstance(dtype, TEMPORAL):
        return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), iso_text(c, dtype), F.lit('"')))
    if isinstance(dtype, T.ArrayType):
        items = F.transform(c, lambda x: json_value(x, dtype.elementType))
        return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
    if isinstance(dtype, T.StructType):
        return F.when(c.isNull(), F.lit("null")).otherwise(json_object([(f.name, c.getField(f.name), f.dataType) for f in dtype.fields]))
    if isinstance(dtype, T.MapType):
        if not isinstance(dtype.keyType, T.StringType):
            raise TypeError("only string-keyed maps render as JSON objects")
        entries = F.transform(
            F.map_entries(c),
            lambda e: F.concat(json_value(e["key"], T.StringType()), F.lit(":"), json_value(e["value"], dtype.valueType)),
        )
        return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")))
    if isinstance(dtype, T.BinaryType):
        return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), F.base64(c), F.lit('"')))
    raise TypeError(f"cannot render {dtype.simpleString()} as JSON")


def _key_text(name: str) -> str:
    import json

    return json.dumps(name, ensure_ascii=False) + ":"


def json_object(fields: list[tuple[str, Column, T.DataType]]) -> Column:
    parts: list[Column] = []
    for i, (name, c, dtype) in enumerate(fields):
        parts.append(F.lit(("," if i else "") + _key_text(name)))
        parts.append(json_value(c, dtype))
    return F.concat(F.lit("{"), *parts, F.lit("}")) if parts else F.lit("{}")


def json_line(df: DataFrame, columns: list[str] | None = None) -> Column:
    """``JSON.stringify(row)`` -- compact, nulls kept, column order kept."""
    cols = columns or df.columns
    return json_object([(n, qcol(n), df.schema[n].dataType) for n in cols])


def cell_text(c: Column, dtype: T.DataType) -> Column:
    """Text of one CSV cell before quoting: null -> empty, string as is, dates as ISO,
    anything else as its JSON text (so NaN prints ``null``)."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(c, F.lit(""))
    if isinstance(dtype, TEMPORAL):
        return F.coalesce(iso_text(c, dtype), F.lit(""))
    if isinstance(dtype, (*INTEGRAL, T.DecimalType)):
        return F.coalesce(number_text(c, dtype), F.lit(""))
    if isinstance(dtype, FRACTIONAL):
        return F.coalesce(number_text(c, dtype), F.when(c.isNull(), F.lit("")).otherwise(F.lit("null")))
    return F.when(c.isNull(), F.lit("")).otherwise(json_value(c, dtype))


def csv_escape(text: Column) -> Column:
    """Quote iff the text has a comma, a double quote or a newline; double the quotes."""
    special = functools.reduce(lambda a, b: a | b, [F.instr(text, ch) > 0 for ch in CSV_SPECIALS])
    return F.when(special, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_cell(c: Column, dtype: T.DataType) -> Column:
    """Escaped cell.  Numbers, booleans and ISO dates never hold a comma, a quote or a
    newline, so only strings and nested values pay for the quoting test."""
    text = cell_text(c, dtype)
    if isinstance(dtype, (*INTEGRAL, *FRACTIONAL, T.DecimalType, T.BooleanType, *TEMPORAL)):
        return text
    return csv_escape(text)


def csv_line(df: DataFrame, columns: list[str] | None = None) -> Column:
    """One CSV record (without its line end)."""
    cols = columns or df.columns
    return F.concat_ws(",", *[csv_cell(qcol(n), df.schema[n].dataType) for n in cols])


def csv_header(columns: list[str]) -> str:
    """K1 header: the column names joined as they are (names are restricted to safe names)."""
    return ",".join(columns)


def normalize_value(c: Column, dtype: T.DataType) -> Column:
    """Dates to ISO text, recursively through arrays, structs and maps; the rest as is."""
    if isinstance(dtype, TEMPORAL):
        return iso_text(c, dtype)
    if isinstance(dtype, T.ArrayType):
        if not _has_temporal(dtype.elementType):
            return c
        return F.transform(c, lambda x: normalize_value(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        if not _has_temporal(dtype):
            return c
        return F.when(c.isNull(), F.lit(None)).otherwise(
            F.struct(*[normalize_value(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields])
        )
    if isinstance(dtype, T.MapType):
        if not _has_temporal(dtype.valueType):
            return c
        return F.transform_values(c, lambda _k, v: normalize_value(v, dtype.valueType))
    return c


def _has_temporal(dtype: T.DataType) -> bool:
    if isinstance(dtype, TEMPORAL):
        return True
    if isinstance(dtype, T.ArrayType):
        return _has_temporal(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_has_temporal(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.MapType):
        return _has_temporal(dtype.valueType)
    return False


def normalize(df: DataFrame) -> DataFrame:
    """P3 on a whole frame (column names and order kept)."""
    return df.select(*[normalize_value(qcol(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def sha256_hex(c: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, lowercase hex."""
    return F.sha2(c, 256)


def utf8_bytes(c: Column) -> Column:
    """UTF-8 byte length."""
    return F.octet_length(c)
