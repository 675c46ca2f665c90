"""Documents to relations: observed shapes, flattened objects, child tables of arrays."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import kept
from .shards import numbered


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Objects become columns named by their path, keys sorted within an object; arrays stay as they are."""

    def walk(path: list[str], kind: T.DataType) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [c for f in sorted(kind.fields, key=lambda f: f.name) for c in walk([*path, f.name], f.dataType)]
        return [F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path))]

    return df.select(*(c for f in df.schema for c in walk([f.name], f.dataType)))


def child_table(df: DataFrame, array: str, parent_key: str, child_key: str, ordered: bool = True) -> DataFrame:
    """A row for each element of an array: child_key, parent_key, and `value` or the element's fields.

    A null or empty array has no rows; an element that is itself an array is refused, not unwound twice.
    """
    kind = df.schema[array].dataType
    if not isinstance(kind, T.ArrayType):
        raise ValueError(f"{array} is no array")
    if isinstance(kind.elementType, T.ArrayType):
        raise ValueError(f"{array} holds arrays")
    rows = df.select(F.col(parent_key), F.posexplode(array).alias("__pos", "value"))
    if isinstance(kind.elementType, T.StructType):
        rows = rows.select(parent_key, "__pos", *(F.col(f"value.`{f}`").alias(f) for f in sorted(kind.elementType.names)))
    return (numbered(rows, [parent_key, "__pos"], child_key) if ordered else rows.withColumn(child_key, F.xxhash64(parent_key, "__pos"))).select(child_key, *(c for c in rows.columns if c != "__pos"))


INT_MAX = 2**31 - 1


def kind_of(json: Column) -> Column:
    """The kind of a JSON value: null, bool, int, long, double, string, array or object; null text is missing."""
    v = F.trim(json)
    whole = v.rlike("^-?[0-9]+$")
    return (
        F.when(v.isNull(), "missing")
        .when(v == "null", "null")
        .when(v.isin("true", "false"), "bool")
        .when(whole & F.abs(v.try_cast("decimal(38,0)")).between(0, INT_MAX), "int")
        .when(whole, "long")
        .when(v.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "double")
        .when(v.startswith("{"), "object")
        .when(v.startswith("["), "array")
        .otherwise("string")
    )


def observed(df: DataFrame, kind: Column, by: Sequence[str] = ()) -> DataFrame:
    """The most frequent kind of values present (ties: the first by name), how many values there are, nulls, and kinds."""
    counts = df.groupBy(*by, kind.alias("kind")).agg(F.count("*").alias("n"))
    present = ~F.col("kind").isin("missing", "null")
    # negative counts, so that the smallest name wins a tie
    best = F.min(F.when(present, F.struct((-F.col("n")).alias("n"), "kind")))["kind"]
    return counts.groupBy(*by).agg(best.alias("dominant"), F.sum("n").alias("docs"), F.sum(F.when(present, 0).otherwise(F.col("n"))).alias("absent"), F.count(F.when(present, True)).alias("kinds"))


def json_leaf(col: Column, kind: T.DataType) -> Column:
    """A leaf as a portable value: nested rests become JSON text, binary stays."""
    return F.to_json(col) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else col


def path_value(json: Column, *path: str) -> Column:
    """The value at a path of a JSON text; null if any step is missing."""
    return F.get_json_object(json, "$" + "".join(f"['{p}']" for p in path))


def path_tree(df: DataFrame, json: str, order: Sequence[str] = ()) -> DataFrame:
    """What the documents of a JSON column hold at each path; a field is `a.b`, the elements of an array are `a[]`.

    path; shape, the most frequent of object, array and scalar, and shapes, how many of them there are; type, the most frequent
    kind of scalars (int, long, double, bool, string and so on), and types; present, nulls, absent (documents or objects around
    the path that lack it) and nullable; widest, the length of the longest string. Among equally frequent ones the first seen
    wins, by the columns of `order` and the place within arrays; without an order, the first by name. Null values have no shape
    or type. Text that is no JSON is skipped; a document that is no object has the path "".

    One level of nesting is taken apart at a time, and only what nests further is kept for the next. Values are counted by path
    and kind before they are shuffled.
    """
    first = F.struct(*(F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)), F.array().cast("array<int>").alias("at")).alias("seen")
    doc = df.select(F.try_parse_json(json).alias("v"), first).filter("v IS NOT NULL").withColumns({"path": F.lit(""), "above": F.lit(None).cast("string")})
    counts, level = [], _typed(doc)
    while True:
        level = kept(level, "level")
        counts.append(level.groupBy("above", "path", "kind").agg(F.count("*").alias("n"), F.min("seen").alias("seen"), F.max("width").alias("width")))
        inner = level.filter("kind IN ('object', 'array')")
        if inner.isEmpty():
            break
        view = f"nested_{uuid.uuid4().hex}"
        inner.createOrReplaceTempView(view)
        place = ", ".join([*(f"'o{i}', seen.o{i}" for i in range(len(order))), "'at', if(kind = 'array', array_append(seen.at, pos), seen.at)"])
        name = "if(kind = 'array', concat(path, '[]'), if(path = '', key, concat(path, '.', key)))"
        level = _typed(df.sparkSession.sql(f"SELECT x.value AS v, named_struct({place}) AS seen, {name} AS path, path AS above FROM {view}, LATERAL variant_explode(v) AS x"))
        df.sparkSession.catalog.dropTempView(view)
    found = kept(_union(counts), "kinds")
    shape = F.when(F.col("kind").isin("object", "array"), F.col("kind")).when(F.col("kind") != "null", "scalar")
    tie = ["seen"] if order else ["name"]

    def best(column: str) -> DataFrame:
        sums = found.withColumn("name", shape if column == "shape" else F.when(shape == "scalar", F.col("kind"))).filter("name IS NOT NULL")
        sums = sums.groupBy("path", "name").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
        return sums.groupBy("path").agg(F.min_by("name", F.struct((-F.col("n")).alias("n"), *tie)).alias(column), F.count("*").alias(f"{column}s"))

    all_ = found.groupBy("path").agg(F.min("above").alias("above"), F.sum("n").alias("present"), F.sum(F.when(F.col("kind") == "null", F.col("n")).otherwise(0)).alias("nulls"), F.max("width").alias("widest"))
    around = all_.select(F.col("path").alias("above"), F.col("present").alias("around"))
    out = all_.join(around, "above", "left").join(best("shape"), "path", "left").join(best("type"), "path", "left")
    absent = F.when(F.endswith("path", F.lit("[]")) | F.col("above").isNull(), 0).otherwise(F.col("around") - F.col("present"))
    out = out.withColumn("absent", absent)
    return out.filter("path <> '' OR shape IS NULL OR shape <> 'object' OR shapes > 1").select("path", "shape", F.coalesce("shapes", F.lit(0)).alias("shapes"), "type", F.coalesce("types", F.lit(0)).alias("types"), "present", "nulls", "absent", ((F.col("nulls") > 0) | (F.col("absent") > 0)).alias("nullable"), "widest")


def _typed(values: DataFrame) -> DataFrame:
    """v, seen, path, above, the value's kind and the width of a string."""
    text = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
    number = F.try_variant_get("v", "$", "decimal(38,0)")
    kind = (
        F.when(text == "VOID", "null").when(text == "OBJECT", "object").when(text == "ARRAY", "array").when(text == "STRING", "string").when(text == "BOOLEAN", "bool")
        .when((text == "BIGINT") & number.between(-INT_MAX - 1, INT_MAX), "int").when(text == "BIGINT", "long").when(text.isin("DECIMAL", "DOUBLE", "FLOAT"), "double").otherwise(F.lower(text))
    )
    return values.select("v", "seen", "path", "above", kind.alias("kind")).withColumn("width", F.when(F.col("kind") == "string", F.char_length(F.try_variant_get("v", "$", "string"))))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merged_shape(df: DataFrame, json: str) -> DataFrame:
    """(path, kind): the one shape that all documents of a JSON column fit, merged by Spark; [] stands for an array's elements.

    Kinds that exclude each other become VARIANT, numbers the wider one; text that is no JSON has no shape.
    """
    shape = df.agg(F.schema_of_variant_agg(F.try_parse_json(json)).alias("s")).first()["s"]  # one type for the table
    rows: list[tuple[str, str]] = []

    def walk(text: str, at: int, path: str) -> int:
        """Reads one type of the description from a place on, and returns the place behind it."""
        name = re.compile(r"[A-Z]+(\([0-9,]+\))?").match(text, at)[0]
        rows.append((path, name))
        at += len(name)
        if name == "ARRAY":
            return walk(text, at + 1, f"{path}[]") + 1
        if name == "OBJECT" and text[at : at + 1] == "<":
            at += 1
            while text[at] != ">":
                field = re.compile(r"`((?:[^`]|``)*)`: |([^:>]+): ").match(text, at)
                key = field[1].replace("``", "`") if field[1] is not None else field[2]
                at = walk(text, field.end(), f"{path}.{key}" if path else key)
                at += 2 if text[at : at + 2] == ", " else 0
            return at + 1
        return at

    if shape:
        walk(shape, 0, "")
    return df.sparkSession.createDataFrame([r for r in rows if r[0]], "path string, kind string")
