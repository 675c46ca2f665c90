"""Pivot types: the common type vocabulary that columns of all engines are mapped through, and its Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

TYPE = re.compile(r"^\s*([A-Za-z_0-9 ]+?)\s*(?:\(\s*(\*|\d+)\s*(?:[A-Za-z]+\s*)?(?:,\s*(-?\d+)\s*)?\)\s*(.*))?$")

#: Types without parameters. Fixed values.
PLAIN = {
    "CLOB": T.StringType(), "NCLOB": T.StringType(), "LONG": T.StringType(), "XMLTYPE": T.StringType(), "VARCHAR2": T.StringType(), "NVARCHAR2": T.StringType(), "VARCHAR": T.StringType(), "CHAR": T.StringType(), "NCHAR": T.StringType(),
    "BLOB": T.BinaryType(), "LONG RAW": T.BinaryType(), "RAW": T.BinaryType(), "BFILE": T.BinaryType(), "DATE": T.TimestampNTZType(), "TIMESTAMP": T.TimestampNTZType(), "FLOAT": T.DoubleType(), "BINARY_DOUBLE": T.DoubleType(), "BINARY_FLOAT": T.FloatType(), "BOOLEAN": T.BooleanType(),
}


def to_spark(pivot: str) -> tuple[T.DataType, str | None]:
    """(the Spark type of a pivot type, a remark where something is lost)."""
    name = " ".join(pivot.upper().split())
    if name.startswith("TIMESTAMP") and "TIME ZONE" in name:
        return T.TimestampType(), None
    if name.startswith("INTERVAL YEAR"):
        return T.YearMonthIntervalType(), None
    if name.startswith("INTERVAL DAY"):
        return T.DayTimeIntervalType(), None
    m = TYPE.match(name)
    base, p, s = (m[1], m[2], m[3]) if m else (name, None, None)
    if base in ("NUMBER", "NUMERIC", "DECIMAL", "INTEGER", "INT"):
        if p is None or p == "*":
            return (T.LongType(), None) if base in ("INTEGER", "INT") else (T.DecimalType(38, 10), "no precision: 38 digits, 10 of them decimals")
        p, s = int(p), int(s or 0)
        if s > 0:
            return T.DecimalType(min(p, 38), min(s, 38)), None if p <= 38 else f"{p} digits do not fit 38"
        if s < 0:
            return T.DecimalType(min(p - s, 38), 0), None if p - s <= 38 else f"{p - s} digits do not fit 38"
        kind = next((k for top, k in ((4, T.ShortType()), (9, T.IntegerType()), (18, T.LongType())) if p <= top), None)
        return (kind, None) if kind else (T.DecimalType(min(p, 38), 0), None if p <= 38 else f"{p} digits do not fit 38")
    if base in ("ROWID", "UROWID"):
        return T.StringType(), "row addresses mean nothing elsewhere"
    if base in PLAIN:
        return PLAIN[base], None
    return T.StringType(), f"unknown type {pivot}"


#: (pattern, pivot type) by engine; \\1 and \\2 are the parameters. Fixed values.
FROM = {
    "mysql": [
        (r"tinyint\(1\)", "BOOLEAN"), (r"tinyint.*", "NUMBER(3)"), (r"smallint.*", "NUMBER(5)"), (r"mediumint.*", "NUMBER(7)"), (r"bigint.*", "NUMBER(19)"), (r"int.*", "NUMBER(10)"), (r"(?:decimal|numeric)\((\d+),\s*(\d+)\).*", r"NUMBER(\1,\2)"), (r"(?:decimal|numeric)\((\d+)\).*", r"NUMBER(\1)"), (r"(?:decimal|numeric).*", "NUMBER(10,0)"),
        (r"double.*", "BINARY_DOUBLE"), (r"float.*", "BINARY_FLOAT"), (r"year.*", "NUMBER(4)"), (r"datetime.*|timestamp.*", "TIMESTAMP(6)"), (r"date", "DATE"), (r"time.*", "VARCHAR2(20)"), (r"bit\(1\)", "BOOLEAN"), (r"(?:var)?char\((\d+)\).*", r"VARCHAR2(\1)"), (r".*text|json", "CLOB"), (r".*blob|(?:var)?binary.*", "BLOB"),
    ],
    "postgresql": [
        (r"smallint|int2", "NUMBER(5)"), (r"integer|int4", "NUMBER(10)"), (r"bigint|int8", "NUMBER(19)"), (r"numeric\((\d+),\s*(\d+)\)", r"NUMBER(\1,\2)"), (r"numeric\((\d+)\)", r"NUMBER(\1)"), (r"numeric", "NUMBER"), (r"double precision|float8", "BINARY_DOUBLE"), (r"real|float4", "BINARY_FLOAT"), (r"money", "NUMBER(19,4)"), (r"boolean|bool", "BOOLEAN"),
        (r"uuid", "VARCHAR2(36)"), (r"jsonb?|text|xml|.*\[\]", "CLOB"), (r"(?:character varying|varchar)\((\d+)\)", r"VARCHAR2(\1)"), (r"character varying|varchar", "CLOB"), (r"(?:character|char|bpchar)\((\d+)\)", r"CHAR(\1)"), (r"bytea", "BLOB"), (r"date", "DATE"), (r"timestamp.* with time zone|timestamptz.*", "TIMESTAMP WITH TIME ZONE"), (r"timestamp.*", "TIMESTAMP(6)"), (r"inet|cidr|macaddr", "VARCHAR2(43)"),
    ],
    "sqlserver": [
        (r"tinyint", "NUMBER(3)"), (r"smallint", "NUMBER(5)"), (r"int", "NUMBER(10)"), (r"bigint", "NUMBER(19)"), (r"(?:decimal|numeric)\((\d+),\s*(\d+)\)", r"NUMBER(\1,\2)"), (r"money", "NUMBER(19,4)"), (r"smallmoney", "NUMBER(10,4)"), (r"bit", "BOOLEAN"), (r"float.*", "BINARY_DOUBLE"), (r"real", "BINARY_FLOAT"),
        (r"n?varchar\(max\)|n?text|xml|sql_variant|hierarchyid", "CLOB"), (r"n?varchar\((\d+)\)", r"VARCHAR2(\1)"), (r"n?char\((\d+)\)", r"CHAR(\1)"), (r"uniqueidentifier", "VARCHAR2(36)"), (r"rowversion|timestamp", "RAW(8)"), (r"varbinary.*|binary.*|image", "BLOB"), (r"datetimeoffset.*", "TIMESTAMP WITH TIME ZONE"), (r"datetime.*|smalldatetime", "TIMESTAMP(6)"), (r"date", "DATE"),
    ],
    "db2": [
        (r"smallint", "NUMBER(5)"), (r"int|integer", "NUMBER(10)"), (r"bigint", "NUMBER(19)"), (r"(?:decimal|numeric|dec)\((\d+),\s*(\d+)\)", r"NUMBER(\1,\2)"), (r"decfloat.*", "NUMBER"), (r"real", "BINARY_FLOAT"), (r"double(?: precision)?|float", "BINARY_DOUBLE"), (r"(?:char|character|graphic)\((\d+)\).*", r"CHAR(\1)"),
        (r"(?:varchar|vargraphic)\((\d+)\).*", r"VARCHAR2(\1)"), (r"dbclob.*|clob.*", "CLOB"), (r"(?:var)?binary\((\d+)\)", r"RAW(\1)"), (r"blob.*", "BLOB"), (r"date", "DATE"), (r"timestamp.*", "TIMESTAMP"), (r"time", "VARCHAR2(20)"), (r"boolean", "BOOLEAN"), (r"xml", "XMLTYPE"), (r"rowid", "ROWID"),
    ],
    "mongodb": [
        (r"string\(([1-9]\d{0,2}|[1-3]\d{3}|4000)\)", r"VARCHAR2(\1)"), (r"string.*", "CLOB"), (r"int", "NUMBER(9)"), (r"long", "NUMBER(19)"), (r"double", "BINARY_DOUBLE"), (r"decimal", "NUMBER(38,10)"), (r"bool", "BOOLEAN"), (r"date", "TIMESTAMP"), (r"objectid", "ROWID"), (r"bindata", "BLOB"), (r"null", "VARCHAR2(4000)"),
    ],
    "spreadsheet": [(r"int\(([1-9])\)", "NUMBER(9)"), (r"int\((1[0-8])\)", "NUMBER(18)"), (r"int.*", "NUMBER(38)"), (r"float", "BINARY_DOUBLE"), (r"decimal", "NUMBER(38,10)"), (r"bool", "BOOLEAN"), (r"date", "DATE"), (r"datetime", "TIMESTAMP(6)"), (r"time", "VARCHAR2(8)"), (r"null|string.*", "VARCHAR2(4000)")],
}


def from_engine(engine: str, declared: str) -> tuple[str, str | None]:
    """(pivot type, remark) of a type as its engine declares it."""
    text = " ".join(declared.lower().split())
    unsigned = " unsigned" in text
    text = text.replace(" unsigned", "")
    for pattern, pivot in FROM[engine]:
        if m := re.fullmatch(pattern, text):
            return m.expand(pivot), "unsigned is dropped" if unsigned else None
    return "CLOB", f"unknown type {declared}"


#: Types of the targets: (up to 4, 9 and 18 digits, other numbers, bare number, text of n, long text, binary, time, zoned time, double, float, boolean). Fixed values.
TO = {
    "postgresql": ("SMALLINT", "INTEGER", "BIGINT", "NUMERIC", "NUMERIC", "VARCHAR({})", "TEXT", "BYTEA", "TIMESTAMP", "TIMESTAMPTZ", "DOUBLE PRECISION", "REAL", "BOOLEAN"),
    "mysql": ("SMALLINT", "INT", "BIGINT", "DECIMAL", "DECIMAL(65,30)", "VARCHAR({})", "LONGTEXT", "LONGBLOB", "DATETIME(6)", "DATETIME(6)", "DOUBLE", "FLOAT", "TINYINT(1)"),
    "sqlserver": ("SMALLINT", "INT", "BIGINT", "DECIMAL", "DECIMAL(38,10)", "NVARCHAR({})", "NVARCHAR(MAX)", "VARBINARY(MAX)", "DATETIME2", "DATETIMEOFFSET", "FLOAT", "REAL", "BIT"),
    "db2": ("SMALLINT", "INTEGER", "BIGINT", "DECIMAL", "DECIMAL(31,9)", "VARCHAR({})", "CLOB", "BLOB", "TIMESTAMP", "TIMESTAMP", "DOUBLE", "REAL", "BOOLEAN"),
    "oracle": ("NUMBER(4)", "NUMBER(9)", "NUMBER(18)", "NUMBER", "NUMBER", "VARCHAR2({})", "CLOB", "BLOB", "TIMESTAMP(6)", "TIMESTAMP WITH TIME ZONE", "BINARY_DOUBLE", "BINARY_FLOAT", "BOOLEAN"),
}


def to_engine(engine: str, pivot: str) -> tuple[str, str | None]:
    """(the type of a target engine for a pivot type, a remark where something is lost)."""
    small, medium, large, number, bare, text, long_text, binary, stamp, zoned, double, single, boolean = TO[engine]
    kind, remark = to_spark(pivot)
    m = TYPE.match(" ".join(pivot.upper().split()))
    if isinstance(kind, T.DecimalType):
        if not m or m[2] in (None, "*"):
            return bare, "no precision"
        return f"{number}({m[2]},{m[3] or 0})", remark
    if isinstance(kind, T.StringType) and m and m[2] and m[1] not in ("CLOB", "NCLOB"):
        return text.format(m[2]), remark
    plain = {T.ShortType: small, T.IntegerType: medium, T.LongType: large, T.StringType: long_text, T.BinaryType: binary, T.TimestampNTZType: stamp, T.TimestampType: zoned, T.DoubleType: double, T.FloatType: single, T.BooleanType: boolean}
    return plain.get(type(kind), long_text), remark if type(kind) in plain else f"{pivot} becomes text"
