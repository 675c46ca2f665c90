"""Types of untyped cells: classification, reduction over a column, coercion. Regular expressions and casts only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
STAMP = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[ T][0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2})?$"
TIME = r"^[0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2})?$"
#: Whole and other numbers. Fixed values.
INT, FLOAT = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$"


def as_date(v: Column) -> Column:
    """A real date of the form y-m-d, padded or not."""
    return F.when(v.rlike(DATE), F.try_to_timestamp(v, F.lit("y-M-d"))).cast("date")


def as_timestamp(v: Column) -> Column:
    t = F.regexp_replace(v, "T", " ")
    return F.coalesce(
        F.when(t.rlike(STAMP) & (F.size(F.split(t, ":")) == 3), F.try_to_timestamp(t, F.lit("y-M-d H:m:s"))),
        F.when(t.rlike(STAMP) & (F.size(F.split(t, ":")) == 2), F.try_to_timestamp(t, F.lit("y-M-d H:m"))),
    ).cast("timestamp_ntz")


def is_time(v: Column) -> Column:
    p = F.split(v, ":")
    part = lambda i, top: F.coalesce(F.get(p, F.lit(i)), F.lit("0")).try_cast("int").between(0, top)
    return v.rlike(TIME) & part(0, 23) & part(1, 59) & part(2, 59)


def kind_of(cell: Column) -> Column:
    """null, bool, int, float, datetime, date, time or string. A leading zero keeps a number text."""
    v = F.trim(cell)
    zero = v.rlike("^[+-]?0[0-9]")
    return (
        F.when(v.isNull() | (v == ""), "null")
        .when(F.lower(v).isin("true", "yes", "false", "no"), "bool")
        .when(~zero & v.rlike(INT), "int")
        .when(~zero & v.rlike(FLOAT), "float")
        .when(as_timestamp(v).isNotNull(), "datetime")
        .when(as_date(v).isNotNull(), "date")
        .when(is_time(v), "time")
        .otherwise("string")
    )


def combined(kinds: Column) -> Column:
    """The one kind that holds a set of kinds (an array without nulls' kind); conflicts become string."""
    some = F.array_distinct(F.filter(kinds, lambda k: k != "null"))
    within = lambda *ks: F.size(F.array_except(some, F.array(*map(F.lit, ks)))) == 0
    return (
        F.when(F.size(some) == 0, "null")
        .when(F.size(some) == 1, F.get(some, F.lit(0)))
        .when(within("int", "float", "decimal"), F.when(F.array_contains(some, "decimal"), "decimal").otherwise("float"))
        .when(within("date", "datetime"), "datetime")
        .otherwise("string")
    )


def infer(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row for each column: kind, conflict, longest text, most digits. One pass with an aggregate of small sets."""
    names = columns or df.columns
    figures = []
    for i, c in enumerate(names):
        v = F.col(f"`{c}`").cast("string")
        figures += [F.collect_set(kind_of(v)).alias(f"k{i}"), F.max(F.char_length(v)).alias(f"w{i}"), F.max(F.char_length(F.regexp_replace(v, "[^0-9]", ""))).alias(f"d{i}")]
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"k{i}").alias("kinds"), F.col(f"w{i}").alias("widest"), F.col(f"d{i}").alias("digits")) for i, c in enumerate(names)))
    out = df.agg(*figures).select(F.explode(rows).alias("x")).select("x.*")
    kind = combined(F.col("kinds"))
    return out.select("column", kind.alias("kind"), ((kind == "string") & (F.size(F.filter("kinds", lambda k: k != "null")) > 1)).alias("conflict"), "widest", "digits")


def coerce(cell: Column, kind: str) -> Column:
    """A struct (value, bad): the typed value, or the raw text if it cannot be one."""
    v = F.trim(cell)
    truth = F.when(F.lower(v).isin("true", "yes"), True).when(F.lower(v).isin("false", "no"), False)
    number = F.when(truth.isNotNull(), truth.cast("int").cast("string")).when(v.rlike(FLOAT), v)
    value = {
        "numeric": number.try_cast("decimal(38,10)"),
        "float": number.try_cast("double"),
        "int": number.try_cast("decimal(38,10)").try_cast("long"),
        "bool": F.coalesce(truth, F.when(v.rlike(FLOAT), v.try_cast("double") != 0)),
        "datetime": F.coalesce(as_timestamp(v), as_date(v).cast("timestamp_ntz")),
        "date": as_date(v),
        "string": cell,
    }[kind]
    blank = cell.isNull() | (v == "")
    return F.struct(value.alias("value"), F.when(value.isNull() & ~blank, cell).alias("bad"))
