"""Functions of other SQL dialects as column expressions with those dialects' meaning.

Where Spark has the function with the same meaning, use Spark's. Here are those that Spark lacks or means otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date parts and their aliases. Fixed values.
PARTS = {
    "year": "YEAR", "yy": "YEAR", "yyyy": "YEAR", "quarter": "QUARTER", "qq": "QUARTER", "q": "QUARTER", "month": "MONTH", "mm": "MONTH", "m": "MONTH",
    "dayofyear": "DAYOFYEAR", "dy": "DAYOFYEAR", "y": "DAYOFYEAR", "day": "DAY", "dd": "DAY", "d": "DAY", "week": "WEEK", "wk": "WEEK", "ww": "WEEK",
    "weekday": "DAYOFWEEK", "dw": "DAYOFWEEK", "hour": "HOUR", "hh": "HOUR", "minute": "MINUTE", "mi": "MINUTE", "n": "MINUTE", "second": "SECOND", "ss": "SECOND", "s": "SECOND",
    "millisecond": "MILLISECOND", "ms": "MILLISECOND", "microsecond": "MICROSECOND", "mcs": "MICROSECOND",
}
#: Tokens of date masks and their patterns. Fixed values.
MASKS = {
    "YYYY": "yyyy", "RRRR": "yyyy", "YY": "yy", "RR": "yy", "MONTH": "MMMM", "MON": "MMM", "MM": "MM", "DAY": "EEEE", "DY": "EEE", "DDD": "DDD", "DD": "dd",
    "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "AM": "a", "PM": "a",
}
TOKEN = re.compile("|".join(sorted(MASKS, key=len, reverse=True)) + "|[A-Z]", re.IGNORECASE)


def _said(text: str) -> str:
    """Text that stands for itself in a date pattern."""
    return re.sub("[A-Za-z']*[A-Za-z][A-Za-z']*", lambda m: "'" + m[0].replace("'", "''") + "'", text) if re.search("[A-Za-z]", text) else text.replace("'", "''")


def pattern(mask: str) -> str:
    """A date mask as a date pattern; letters that are no token stand for themselves."""
    return re.sub("(?<=[A-Za-z])''(?=[A-Za-z])", "", TOKEN.sub(lambda m: MASKS.get(m[0].upper(), f"'{m[0]}'"), mask))


def decode(value: Column, *pairs: Column) -> Column:
    """decode(v, s1, r1, s2, r2, ..., [default]); null meets null."""
    out = pairs[-1] if len(pairs) % 2 else F.lit(None)
    for s, r in reversed(list(zip(pairs[::2], pairs[1::2], strict=False))):
        out = F.when(value.eqNullSafe(s), r).otherwise(out)
    return out


def instr(text: Column, part: Column, start: int = 1, nth: int = 1) -> Column:
    """The place of the nth occurrence at or after start, else 0; a start below 0 counts from the end and searches backwards."""
    if start < 0:
        at = F.call_function("locate", F.reverse(part), F.reverse(text), F.greatest(F.lit(1), F.lit(1 - start) - F.char_length(part)))
        for _ in range(nth - 1):
            at = F.when(at > 0, F.call_function("locate", F.reverse(part), F.reverse(text), at + 1)).otherwise(0)
        return F.when(at > 0, F.char_length(text) - at - F.char_length(part) + 2).otherwise(at)
    at = F.call_function("locate", part, text, F.lit(start))
    for _ in range(nth - 1):
        at = F.when(at > 0, F.call_function("locate", part, text, at + 1)).otherwise(0)
    return at


def length(text: Column) -> Column:
    """Characters without trailing spaces."""
    return F.char_length(F.rtrim(text))


def concat(*parts: Column) -> Column:
    """Concatenation for which null is empty text."""
    return F.concat(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def stuff(text: Column, start: int, n: int, new: Column) -> Column:
    return F.when((F.lit(start) >= 1) & (F.lit(start) <= F.char_length(text)), F.overlay(text, new, F.lit(start), F.lit(n)))


def choose(index: Column, *values: Column) -> Column:
    return F.get(F.array(*values), index - 1)


def trunc_number(x: Column, digits: int = 0) -> Column:
    """Towards zero at so many decimals, cut from the decimal digits; numbers too large for them have no decimals to cut."""
    exact = x.try_cast("decimal(38,15)")
    cut = F.when(exact < 0, F.ceil(exact, F.lit(digits))).otherwise(F.floor(exact, F.lit(digits)))
    return F.coalesce(cut.cast("double"), x.cast("double"))


def add_months(d: Column, n: int) -> Column:
    """The last day of a month stays a last day."""
    return F.when(d == F.last_day(d), F.last_day(F.add_months(d, n))).otherwise(F.add_months(d, n))


def date_diff(part: str, a: Column, b: Column) -> Column:
    """The number of boundaries of the part between a and b."""
    unit = PARTS[part.lower()]
    if unit == "YEAR":
        return F.year(b) - F.year(a)
    if unit in ("QUARTER", "MONTH"):
        n = 3 if unit == "QUARTER" else 1
        per = F.quarter if unit == "QUARTER" else F.month
        return (F.year(b) - F.year(a)) * (12 // n) + per(b) - per(a)
    if unit in ("DAY", "DAYOFYEAR", "DAYOFWEEK"):
        return F.datediff(b.cast("date"), a.cast("date"))
    if unit == "WEEK":  # weeks begin on Sunday
        sunday = lambda d: F.date_sub(d.cast("date"), F.dayofweek(d) - 1)
        return (F.datediff(sunday(b), sunday(a)) / 7).cast("int")
    if unit in ("MILLISECOND", "MICROSECOND"):
        micros = lambda d: F.unix_micros(d.cast("timestamp"))
        n = 1000 if unit == "MILLISECOND" else 1
        return F.floor(micros(b) / n).cast("long") - F.floor(micros(a) / n).cast("long") if n > 1 else micros(b) - micros(a)
    seconds = {"HOUR": 3600, "MINUTE": 60, "SECOND": 1}[unit]
    at = lambda d: F.unix_seconds(F.date_trunc(unit, d).cast("timestamp"))
    return ((at(b) - at(a)) / seconds).cast("long")


def date_add(part: str, n: int, d: Column) -> Column:
    unit = PARTS[part.lower()]
    return F.timestamp_add("DAY" if unit in ("DAYOFYEAR", "DAYOFWEEK") else unit, F.lit(n), d)


def date_part(part: str, d: Column) -> Column:
    """A part of a date; weekdays count from Sunday, 1, and fractions of a second are those beyond it."""
    unit = PARTS[part.lower()]
    if unit in ("MILLISECOND", "MICROSECOND"):
        micros = F.pmod(F.unix_micros(d.cast("timestamp")), F.lit(1_000_000))
        return F.floor(micros / 1000).cast("long") if unit == "MILLISECOND" else micros
    return F.extract(F.lit({"DAYOFYEAR": "DOY", "DAYOFWEEK": "DAYOFWEEK"}.get(unit, unit)), d)


def to_char(d: Column, mask: str) -> Column:
    return F.date_format(d, pattern(mask))


def to_date(text: Column, mask: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern(mask))).cast("timestamp_ntz")


def lob_substr(text: Column, amount: int, offset: int = 1) -> Column:
    return F.substring(text, offset, amount)


def regexp_instr(text: Column, regex: str, nth: int = 1) -> Column:
    """The place of the nth match, else 0. Matches do not overlap."""
    first = F.regexp_instr(text, F.lit(regex))
    if nth == 1:
        return first
    parts = F.split(text, regex, nth + 1)
    found = F.regexp_extract_all(text, F.lit(f"({regex})"), F.lit(1))
    before = lambda xs, n: F.aggregate(F.slice(xs, 1, n), F.lit(0), lambda a, x: a + F.char_length(x))
    return F.when(F.size(found) >= nth, before(parts, nth) + before(found, nth - 1) + 1).otherwise(F.when(text.isNotNull(), 0))


#: Words of defaults that mean the present. Fixed values.
NOW = ("current_timestamp", "current_timestamp()", "now()", "sysdate", "systimestamp", "getdate()", "sysdatetime()", "localtimestamp")
TODAY = ("current_date", "current_date()", "curdate()")


def default_value(text: str | None, kind: str) -> tuple[Column | None, str]:
    """A column default's text as a value of a Spark type, for coalesce; (None, the reason) where there is none.

    Known are null, numbers, quoted and bare text, booleans as words, digits or bits, and the present. A date of zeros is no
    date, and a function that is not known is left out.
    """
    raw = (text or "").strip()
    while raw.startswith("(") and raw.endswith(")"):
        raw = raw[1:-1].strip()
    bare = raw[1:-1].replace("''", "'") if len(raw) > 1 and raw[0] == raw[-1] == "'" else re.sub(r"(?i)^[bn]'(.*)'$", r"\1", raw)
    low, quoted = bare.lower(), bare != raw
    if text is None or low == "null" and not quoted:
        return None, "no default"
    if not quoted and low in NOW + TODAY:
        return (F.current_date() if low in TODAY else F.current_timestamp()).cast(kind), ""
    if not quoted and re.search(r"\w\s*\(", raw):
        return None, f"the function of {raw} is not known"
    if kind == "boolean":
        known = {"1": True, "true": True, "t": True, "y": True, "0": False, "false": False, "f": False, "n": False}
        return (F.lit(known[low]), "") if low in known else (None, f"{raw} is no boolean")
    if kind.startswith(("date", "timestamp")) and re.match(r"0000-00-00|\d{4}-00|\d{4}-\d\d-00", bare):
        return None, "a date of zeros"
    if kind == "string":
        return F.lit(bare), ""
    return F.lit(bare).try_cast(kind), ""


#: Percent tokens of date masks and their date patterns. Fixed values.
PERCENT = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS",
    "p": "a", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "j": "DDD", "T": "HH:mm:ss", "r": "hh:mm:ss a",
}


def percent_pattern(mask: str) -> str:
    """A date mask with percent tokens as a date pattern; other letters, and unknown tokens' letters, stand for themselves."""
    out, plain = [], ""
    for token, other in [*re.findall(r"%(.)|([^%])", mask, flags=re.S), ("", "")]:
        if other or token and token not in PERCENT:
            plain += other or token
            continue
        out.append(_said(plain) + PERCENT.get(token, ""))
        plain = ""
    return "".join(out)


def date_format(d: Column, mask: str) -> Column:
    return F.date_format(d, percent_pattern(mask))


def str_to_date(text: Column, mask: str) -> Column:
    """Null where the text does not fit the mask."""
    return F.try_to_timestamp(text, F.lit(percent_pattern(mask))).cast("timestamp_ntz")


def ceiling(x: Column) -> Column:
    return F.ceil(x)


def to_number(text: Column, mask: str | None = None) -> Column:
    """Text as a number with ten digits after the point, or by a mask of 9, 0, D, G, S, MI, PR and currency; null where it does not fit."""
    if mask is None:
        return F.trim(text).try_cast("decimal(38,10)")
    return F.try_to_number(F.trim(text), F.lit(re.sub("(?i)^FM", "", mask).upper().replace("L", "$")))


#: Type names in conversions and the Spark types that hold them. Fixed values.
CONVERTED = {
    "bit": "boolean", "tinyint": "smallint", "smallint": "smallint", "int": "int", "integer": "int", "bigint": "bigint", "real": "float", "float": "double", "money": "decimal(19,4)",
    "smallmoney": "decimal(10,4)", "date": "date", "datetime": "timestamp_ntz", "datetime2": "timestamp_ntz", "smalldatetime": "timestamp_ntz", "datetimeoffset": "timestamp",
    "uniqueidentifier": "string", "text": "string", "ntext": "string", "binary": "binary", "varbinary": "binary", "image": "binary",
}
UNSIZED = 30  # characters of a conversion to text whose type names no length


def convert(type_name: str, x: Column) -> Column:
    """CONVERT and CAST by another engine's type name; null where the value does not fit. Text is cut to the type's length."""
    name, _, size = type_name.strip().lower().rstrip(")").partition("(")
    name = name.strip()
    if name in ("char", "nchar", "varchar", "nvarchar"):
        text = x.cast("string")
        return text if size.strip() == "max" else F.substring(text, 1, int(size or UNSIZED))
    if name in ("decimal", "numeric", "dec"):
        return x.try_cast(f"decimal({size or '18,0'})")
    if name not in CONVERTED:
        raise ValueError(f"no type for {type_name}")
    return x.try_cast(CONVERTED[name])
