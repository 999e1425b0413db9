"""Coercion of loosely typed fields to columns. A missing value stays null: it is never turned into zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of truth and falsehood.
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "y"), ("false", "0", "no", "n", "", "none", "null")
# Milliseconds in each unit name.
UNIT_MS = {"ns": 1e-6, "nanosecond": 1e-6, "nanoseconds": 1e-6, "us": 1e-3, "µs": 1e-3, "microsecond": 1e-3, "microseconds": 1e-3, "ms": 1.0, "millisecond": 1.0, "milliseconds": 1.0, "s": 1e3, "sec": 1e3, "secs": 1e3, "second": 1e3, "seconds": 1e3}
# Error statuses and what an absent error looks like.
ERROR_STATUS = ("error", "failed", "failure", "cancelled", "canceled")
NO_ERROR = ("", "0", "none", "null", "false", "False", "{}")
# Fields of an error object, first one wins.
ERROR_FIELDS, SOME_ERROR = ("type", "error_type", "code", "class", "status", "message", "error"), "error_present"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The double, or null if it is NaN or infinite."""
    x = as_column(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def number(c: Column | str) -> Column:
    """Text as a finite double; booleans and other text give null."""
    x = as_column(c).cast("string")
    return finite(F.when(~F.lower(F.trim(x)).isin("true", "false"), x.try_cast("double")))


def whole(c: Column | str) -> Column:
    """Text as a long: integers exactly, other numbers cut toward zero."""
    x = F.trim(as_column(c).cast("string"))
    return F.coalesce(F.when(x.rlike(r"^[+-]?\d+$"), x.try_cast("long")), F.when(F.abs(number(x)) < 9.2e18, number(x)).try_cast("long"))


def integral(c: Column | str) -> Column:
    """Text as a long only if it is a whole number."""
    d = number(c)
    return F.when(d == F.floor(d), whole(c))


def truth(c: Column | str) -> Column:
    """Three-valued boolean from text, or from a number that isn't zero."""
    x = F.lower(F.trim(as_column(c).cast("string")))
    return F.when(x.isin(*TRUE_WORDS), True).when(x.isin(*FALSE_WORDS), False).otherwise(number(x) != 0)


def text_or_null(c: Column | str) -> Column:
    """Trimmed text; blank gives null."""
    x = F.trim(as_column(c).cast("string"))
    return F.when(x != "", x)


def canonical_name(c: Column | str) -> Column:
    """A field name in lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(as_column(c)), "[^a-z0-9]+", "")


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; null if either is null or b is zero."""
    x, y = as_column(a).cast("double"), as_column(b).cast("double")
    return F.when(y != 0, x / F.when(y != 0, y))


def difference(a: Column | str, b: Column | str) -> Column:
    return as_column(a) - as_column(b)


def path_unit(path: Column | str) -> Column:
    """The time unit in the last word of a field path, tried from the shortest unit; null if there is none."""
    p = F.lower(as_column(path))
    case = None
    for unit in ("ns", "us", "ms", "s"):
        words = "|".join(sorted((u for u, ms in UNIT_MS.items() if ms == UNIT_MS[unit]), key=len, reverse=True))
        hit = p.rlike(rf"(^|[._])({words})($|[._])")
        case = F.when(hit, unit) if case is None else case.when(hit, unit)
    return case


def known_unit(unit: Column | str) -> Column:
    """The unit in lower case if it is one, else null."""
    u = F.lower(F.trim(as_column(unit).cast("string")))
    return F.when(u.isin(*UNIT_MS), u)


def unit_factor(unit: Column | str) -> Column:
    """Milliseconds in a unit; an unknown or missing unit counts as milliseconds."""
    u = F.lower(F.trim(as_column(unit)))
    table = F.create_map(*(F.lit(x) for kv in UNIT_MS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.coalesce(u, F.lit(""))), F.lit(1.0))


def duration_ms(value: Column | str, unit: Column | str | None = None, path: Column | str | None = None) -> Column:
    """A duration in milliseconds by its sibling unit, else by its path."""
    named = known_unit(unit) if unit is not None else F.lit(None).cast("string")
    from_path = path_unit(path) if path is not None else F.lit(None).cast("string")
    return number(value) * unit_factor(F.coalesce(named, from_path))


def epoch_ns(value: Column | str, unit: Column | str | None = None, path: Column | str | None = None) -> Column:
    """A time stamp in nanoseconds. Integers named as nanoseconds or of at least 1e17 pass exactly, never through a
    double; others are scaled by unit, by path, or by size (below 1e11 s, 1e14 ms, 1e17 us)."""
    x = F.trim(as_column(value).cast("string"))
    exact = F.when(x.rlike(r"^[+-]?\d+$"), x.try_cast("long"))
    u = F.coalesce(known_unit(unit) if unit is not None else F.lit(None).cast("string"), path_unit(path) if path is not None else F.lit(None).cast("string"))
    d, size = number(x), F.abs(number(x))
    by_size = F.when(size < 1e11, 1_000_000_000).when(size < 1e14, 1_000_000).when(size < 1e17, 1_000).otherwise(1)
    scale = F.when(u.isNull(), by_size).otherwise((unit_factor(u) * 1e6).cast("long"))
    scaled_exact = F.try_multiply(exact, scale.cast("long"))
    return F.when(exact.isNotNull() & ((u == "ns") | (F.abs(exact) >= 10**17)), exact).otherwise(F.coalesce(scaled_exact, F.round(d * scale).try_cast("long")))


def error_present(error: Column | str, status: Column | str | None = None) -> Column:
    """Whether an error field (text or JSON text) or a status says that the request failed."""
    e = as_column(error).cast("string")
    bad = e.isNotNull() & ~e.isin(*NO_ERROR)
    return bad if status is None else bad | F.coalesce(F.lower(F.trim(as_column(status))).isin(*ERROR_STATUS), F.lit(False))


def error_category(error: Column | str, status: Column | str | None = None) -> Column:
    """The status in lower case, else the first telling field of an error object (its first line), else the error's
    text, 200 characters of it."""
    e = as_column(error).cast("string")
    value = lambda f: F.get_json_object(e, f"$.{f}")
    fields = F.coalesce(*(F.when(value(f) != "", F.split_part(value(f), F.lit("\n"), F.lit(1))) for f in ERROR_FIELDS), F.lit(SOME_ERROR))
    said = F.when(F.trim(e).startswith("{"), fields).otherwise(text_or_null(e))
    first = F.coalesce(*([F.lower(text_or_null(status))] if status is not None else []), F.substring(said, 1, 200), F.lit(SOME_ERROR))
    return F.when(error_present(error, status), first)
