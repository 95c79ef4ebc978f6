"""SQL text fragments: quoting, whole-string regex, glob scopes."""

from __future__ import annotations

import fnmatch
import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.model import DEFAULT_SEVERITY_FILTER


def quote(name: str) -> str:
    """Back-tick an identifier. Spark resolves names case-insensitively, so the case is kept."""
    name = name.strip()
    if len(name) > 1 and name[0] == name[-1] and name[0] in '"`':
        name = name[1:-1]
    return "`" + name.replace("`", "``") + "`"


def quote_fqn(fqn: str) -> str:
    return ".".join(quote(part) for part in fqn.split(".") if part)


def string_literal(value: object) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def number_literal(value: object) -> str:
    """A numeric bound. Whole numbers stay integral so that Spark need not cast the column to
    double, which would lose the parquet pushdown."""
    number = float(value)  # type: ignore[arg-type]
    if number.is_integer() and abs(number) < 2**53:
        return f"{int(number)}L" if abs(number) >= 2**31 else str(int(number))
    return f"{number!r}D"


def timestamp_literal(moment: datetime) -> str:
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc)
        return f"TIMESTAMP '{moment:%Y-%m-%d %H:%M:%S.%f}+00:00'"
    return f"TIMESTAMP '{moment:%Y-%m-%d %H:%M:%S.%f}'"


DIGEST_CHARS = 64


def grouping_key(frame: DataFrame, key: str) -> Column:
    """The key expression to group by. Text of 64 bytes and more is replaced by its SHA-256, which
    is 64 characters long: equal texts and only equal texts share a group, short keys stay as they
    are and can never meet a digest, and whole documents need not travel through the shuffle."""
    column = F.expr(key)
    if frame.select(column).schema.fields[0].dataType != T.StringType():
        return column
    return F.when(F.octet_length(column) < DIGEST_CHARS, column).otherwise(F.sha2(column, 256))


def full_match(pattern: str) -> str:
    """Anchor a regex to the whole string. ``$`` would also accept a trailing newline."""
    return rf"\A(?:{pattern})\z"


def scope_patterns(scope: str | None) -> list[str]:
    return [p.strip().upper() for p in (scope or "").split(",") if p.strip()]


def listed_severities(severity_filter: str | None) -> list[str]:
    listed = severity_filter or DEFAULT_SEVERITY_FILTER
    return list(dict.fromkeys(s.strip().upper() for s in listed.split(",") if s.strip()))


def glob_body(pattern: str) -> str:
    """A glob as a regular expression, not anchored."""
    return fnmatch.translate(pattern).removesuffix(r"\Z").removesuffix(r"\z")


def glob_prefix(pattern: str) -> str:
    """The literal characters a glob begins with."""
    return re.split(r"[*?\[]", pattern, maxsplit=1)[0]


def in_scope(table_fqn: Column, scope: str | None) -> Column:
    """Glob match of a table name against a comma list; an empty list matches everything."""
    patterns = scope_patterns(scope)
    if not patterns:
        return F.lit(True)
    body = "|".join(glob_body(p) for p in patterns)
    return F.upper(table_fqn).rlike(full_match(body))


def contains_any(text: Column, fragments: tuple[str, ...]) -> Column:
    """True when any of the literal fragments occurs in the text."""
    return text.rlike("|".join(re.escape(fragment) for fragment in fragments))


def fixed(value: Column, places: int) -> Column:
    """Fixed-point text without thousands separators, rounded half to even."""
    pattern = "0." + "0" * places if places else "0"
    return F.call_function("format_number", value, F.lit(pattern))


def significant(value: Column, digits: int = 6) -> Column:
    """General number text: ``digits`` significant digits, trailing zeros dropped, an exponent for
    very large or very small values."""
    size = F.abs(value)
    exponent = F.floor(F.log10(size)).cast("int")
    mantissa = F.round(value / F.pow(F.lit(10.0), exponent), digits - 1)
    carried = F.abs(mantissa) >= 10
    exponent = F.when(carried, exponent + 1).otherwise(exponent)
    mantissa = F.when(carried, mantissa / 10).otherwise(mantissa)
    plain = F.bround(mantissa * F.pow(F.lit(10.0), exponent), 12).cast("decimal(38,12)").cast("string")
    trim = lambda text: F.regexp_replace(text, r"\.?0+$", "")
    mantissa_text = trim(F.bround(mantissa, digits - 1).cast("decimal(38,12)").cast("string"))
    sign = F.when(exponent < 0, "-").otherwise("+")
    scientific = F.concat(mantissa_text, F.lit("e"), sign, F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return (
        F.when(value == 0, F.lit("0"))
        .when((exponent < -4) | (exponent >= digits), scientific)
        .otherwise(trim(plain))
    )
