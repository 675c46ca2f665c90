"""Identifiers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Marks around an identifier by engine.
QUOTES = {"spark": "``", "mysql": "``", "sqlserver": "[]", "oracle": '""', "postgresql": '""', "db2": '""'}


def quoted(name: str, engine: str = "spark") -> str:
    left, right = QUOTES[engine]
    return left + name.replace(right, 2 * right) + right


def sanitized(name: Column, fallback: str = "column", limit: int = 63) -> Column:
    """A column of names as identifiers: other characters become _, no _ at the ends, none before a digit, limited length."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
    s = F.when(s == "", fallback).when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)
    return F.substring(s, 1, limit)


def sanitize(name: str | None, fallback: str = "column", limit: int = 63) -> str:
    s = re.sub("^_+|_+$", "", re.sub("[^A-Za-z0-9_]+", "_", name or "")) or fallback
    return ("_" + s if s[0].isdigit() else s)[:limit]


def headers(raw: Sequence[str | None]) -> list[str]:
    """Column names for a header row: sanitized, blanks by position, repeats numbered."""
    out: list[str] = []
    for i, r in enumerate(raw, 1):
        base = sanitize(r, f"column_{i}")
        name, n = base, 2
        while name.upper() in {o.upper() for o in out}:
            name, n = f"{base}_{n}", n + 1
        out.append(name)
    return out


def fitted(name: str, limit: int) -> str:
    """The name, or its beginning and a digest where it is too long."""
    return name if len(name) <= limit else f"{name[: limit - 9]}_{hashlib.sha256(name.encode()).hexdigest()[:8]}"
