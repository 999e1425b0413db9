"""Sequences: common prefixes, fingerprints, first of several."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelane.functions.coerce import as_column


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """How many leading elements two arrays share; null if either is null."""
    x, y = as_column(a), as_column(b)
    n = F.least(F.size(x), F.size(y))
    same = F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p.eqNullSafe(q))
    first = F.array_position(same, False)
    return F.when(x.isNotNull() & y.isNotNull(), F.when(n == 0, 0).when(first > 0, first - 1).otherwise(n).cast("long"))


def fingerprint(c: Column | str) -> Column:
    """SHA-256 of an array's JSON text."""
    return F.sha2(F.to_json(as_column(c)), 256)


def row_fingerprint(columns: Sequence[str]) -> Column:
    """SHA-256 of a row's chosen columns as JSON, in name order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def first_present(variant: Column | str, paths: Sequence[str], kind: str = "string") -> Column:
    """The first of several paths that a variant has, as the kind."""
    return F.coalesce(*(F.try_variant_get(as_column(variant), f"$.{p}", kind) for p in paths))
