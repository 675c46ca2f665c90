"""Canonical values and hashes: equal across engines wherever the values mean the same.

Text loses trailing spaces (CHAR padding), a date is the timestamp of its midnight, true is 1, floats are rounded to six
digits, from ``BIG`` on they have ten digits and an exponent; NaN, the infinities and null all differ; a null differs from
empty text. Values within arrays, structs and maps are treated alike, and a map's entries are sorted. Fields are
length-prefixed, so no two rows share an encoding.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types that a checksum leaves out by default, because engines hand them over by reference.
LARGE = (T.BinaryType,)
BIG = 1e15


def canonical(col: Column, kind: T.DataType) -> Column:
    """The value as text; null stays null."""
    if isinstance(kind, T.BooleanType):
        return col.cast("int").cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        x = col.cast("double")
        odd = F.when(F.isnan(x), "NaN").when(F.abs(x) == math.inf, F.when(x > 0, "Infinity").otherwise("-Infinity")).otherwise(F.format_string("%.9e", x))
        # one test decides for almost all values; NaN is above all
        return F.when(F.abs(x) < BIG, F.round(x, 6).cast("decimal(38,6)").cast("string")).when(x.isNotNull(), odd)
    if isinstance(kind, T.DecimalType):
        return F.regexp_replace(F.regexp_replace(col.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(col))
    if isinstance(kind, T.StructType):
        fields = [_field(col.getField(f.name), f.dataType) for f in kind.fields]
        return F.when(col.isNotNull(), F.concat(F.lit("{"), *fields, F.lit("}")))
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(col, lambda x: _field(x, kind.elementType)), ""), F.lit("]"))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(col), lambda e: F.concat(_field(e["key"], kind.keyType), _field(e["value"], kind.valueType)))
        return F.concat(F.lit("("), F.array_join(F.array_sort(entries), ""), F.lit(")"))
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return F.rtrim(col)
    return col.cast("string")


def _field(col: Column, kind: T.DataType) -> Column:
    """length:value, or N for null."""
    v = canonical(col, kind)
    return F.coalesce(F.concat(F.char_length(v).cast("string"), F.lit(":"), v), F.lit("N"))


def encoded(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The row as one text: each field as length:value, or N for null."""
    kinds = {f.name: f.dataType for f in df.schema}
    return F.concat(*(_field(F.col(f"`{c}`"), kinds[c]) for c in columns or df.columns))


def row_hash(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """60 bits of MD5 as a long."""
    return F.conv(F.substring(F.md5(encoded(df, columns)), 1, 15), 16, 10).cast("long")
