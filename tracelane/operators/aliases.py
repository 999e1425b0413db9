"""Fields of loosely typed JSON records by ordered aliases.

A record is flattened to leaves: dotted paths with scalars, lists as JSON text with sorted keys. An alias fits a whole
path, else the last name of a path, else the name before a closing ``value`` or ``val``, each without case and
punctuation; of several paths the record's first one counts, and the first alias that fits anything decides, also when
it finds null. Records are read once, whatever the number of fields and aliases, and aliases are looked up once for all
records that have the same paths.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: What is known of a field: its text, its path, the text of its unit and the kind of its value.
PARTS = ("value", "path", "unit", "kind")
_NAMES: dict[str, str] = {}
#: Paths of record shapes that a task keeps at most, and those of one record more.
SHAPE_PATHS = 50_000


def plain_name(name: str) -> str:
    """name in small letters without anything but letters and digits."""
    known = _NAMES.get(name)
    if known is None:
        known = re.sub("[^a-z0-9]+", "", name.lower())
        if len(_NAMES) < 100_000:
            _NAMES[name] = known
    return known


def leaves(record: object) -> dict[str, object]:
    """Dotted paths and their scalars, in the record's order; an empty object has none."""
    plain = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True) if isinstance(v, list) else v
    if not isinstance(record, dict):
        return {"": plain(record)}
    out: dict[str, object] = {}
    open_ = [("", iter(record.items()))]
    while open_:
        above, items = open_[-1]
        for k, v in items:
            path = above + k
            if isinstance(v, dict):
                open_.append((f"{path}." if path else "", iter(v.items())))
                break
            out[path] = plain(v) if isinstance(v, list) else v
        else:
            open_.pop()
    return out


class Leaves:
    """The leaves of one record with what aliases may fit. flat: record is its leaves already."""

    def __init__(self, record: object, flat: bool = False) -> None:
        self.flat = record if flat else leaves(record)
        self.tiers: tuple[dict[str, str], ...] = ({}, {}, {})
        for path in self.flat:
            whole, last, parent = self.tiers
            parts = path.rsplit(".", 2)
            whole.setdefault(plain_name(path), path)
            tail = plain_name(parts[-1])
            last.setdefault(tail, path)
            if len(parts) > 1 and tail in ("value", "val"):
                parent.setdefault(plain_name(parts[-2]), path)

    def path(self, aliases: Sequence[str]) -> str | None:
        return next((tier[a] for a in aliases for tier in self.tiers if a in tier), None)

    def unit_path(self, path: str, near: bool) -> str | None:
        """Where the unit beside a metric's value would be; near: beside any field, found like an alias."""
        above = path.rpartition(".")[0]
        if near:
            return self.path([plain_name(f"{above or path}.unit")]) or ""
        return f"{above}.unit" if path.endswith((".value", ".val")) else None

    def unit(self, path: str, near: bool) -> object:
        return self.flat.get(self.unit_path(path, near))


class Shape:
    """Where the fields are in all records with the same paths in the same order: for each field its place among the
    leaves, its path and the place of its unit; and the same path and unit for the fields that may be whole objects."""

    def __init__(self, paths: Sequence[str], fields: Mapping[str, Sequence[str]], objects: Sequence[str], near: bool) -> None:
        at = Leaves(dict.fromkeys(paths), flat=True)
        place = {p: k for k, p in enumerate(paths)}
        unit = lambda p: place.get(at.unit_path(p, near))
        found = {f: at.path(aliases) for f, aliases in fields.items()}
        self.leaves = [(f, place[p], p, unit(p)) for f, p in found.items() if p is not None]
        self.objects = [(f, place.get(found[f]), unit(f)) for f in objects if f in fields]


class Alike:
    """The records of a batch that have one shape and the same whole objects. values: what their fields and the units of
    those need of each record, whole objects after the leaves."""

    def __init__(self, shape: Shape, n_paths: int, whole: Mapping[str, int | None]) -> None:
        self.fields = [x for x in shape.leaves if x[0] not in whole] + [(f, n_paths + k, f, unit) for k, (f, unit) in enumerate(whole.items())]
        self.places = sorted({k for _, place, _, unit in self.fields for k in (place, unit) if k is not None})
        self.rows: list[int] = []
        self.values: list[list] = []

    def known(self) -> Iterator[tuple[str, Sequence, str, Sequence | None]]:
        """For each field: its values, their path and what stands where their units would."""
        columns = dict(zip(self.places, zip(*self.values, strict=True), strict=True))
        for f, place, path, unit in self.fields:
            yield f, columns[place], path, None if unit is None else columns[unit]


_KINDS: dict[type, tuple[str, Callable[[object], str | None]]] = {
    type(None): ("null", lambda v: v), str: ("text", lambda v: v), bool: ("boolean", json.dumps), int: ("number", int.__repr__), float: ("number", lambda v: repr(v) if math.isfinite(v) else json.dumps(v)),
}
_OBJECT = ("object", lambda v: json.dumps(v, ensure_ascii=False))


def _parts(names: Sequence[str], values: Sequence, path: str, units: Sequence | None) -> list[list]:
    """The named PARTS of values that stand at one path."""
    kinds = {t: _KINDS.get(t, _OBJECT) for t in set(map(type, values))}
    made = {
        "value": lambda: [*map(next(iter(kinds.values()))[1], values)] if len(kinds) == 1 else [kinds[type(v)][1](v) for v in values], "path": lambda: [path] * len(values),
        "unit": lambda: [u if isinstance(u, str) else None for u in units] if units else [None] * len(values), "kind": lambda: [kinds[type(v)][0] for v in values],
    }
    return [made[n]() for n in names]


def _structs(found: Mapping[str, list[list]], none: np.ndarray, kind: pa.StructType) -> pa.StructArray:
    """One struct for each row, with a struct for each field: found says what is known of which rows; a field that isn't
    there is of the kind null, and none marks the rows without a record."""
    n, columns = len(none), []
    blank = {p: pa.repeat(pa.scalar("null" if p == "kind" else None, pa.string()), n) for p in PARTS}
    for f in kind:
        names, known = [p.name for p in f.type], found[f.name]
        if known:
            at = np.zeros(n, np.int64)
            at[known[0]] = np.arange(1, len(known[0]) + 1)
            parts = [pa.array(["null" if p == "kind" else None, *column], pa.string()).take(pa.array(at)) for p, column in zip(names, known[1:], strict=True)]
        else:
            parts = [blank[p] for p in names]
        columns.append(pa.StructArray.from_arrays(parts, fields=list(f.type)))
    return pa.StructArray.from_arrays(columns, fields=list(kind), mask=pa.array(none))


def resolved(df: DataFrame, json_text: str, fields: Mapping[str, Sequence[str]], objects: Sequence[str] = (), near_units: bool = False, split: Callable[[object], list] | None = None, keep: Sequence[str] | None = None, parts: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """df with a column found: for each field value, path, unit and kind (text, number, boolean, object, null).

    objects: fields that, if nothing else fits, may be a whole object of that name at the top of the record. split: gives
    the records of one JSON text, each a row of its own; df then gets object_no (from 0, null for a text that is no JSON
    or has none). keep: columns of df to keep, all by default. parts: those of PARTS that found has of a field, all for
    fields that it doesn't name; what nobody reads is then neither made nor moved. A text that isn't JSON gives a row of
    nulls.
    """
    plain = {f: [plain_name(a) for a in aliases] for f, aliases in fields.items()}
    wanted = {f: tuple((parts or {}).get(f, PARTS)) for f in fields}
    kept = [c for c in (df.columns if keep is None else keep)]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("object_no", T.IntegerType()), T.StructField("found", T.StructType([T.StructField(f, T.StructType([T.StructField(p, T.StringType()) for p in wanted[f]])) for f in fields]))])
    want = to_arrow_schema(schema)
    shapes: dict[tuple[str, ...], Shape] = {}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, numbers = [], []
            alike: dict[tuple, Alike] = {}
            for k, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                try:
                    record = json.loads(text) if text is not None else None
                except ValueError:
                    record = None
                records = [record] if split is None else split(record)
                for n, part in enumerate(records):
                    flat = leaves(part)
                    paths, values = tuple(flat), list(flat.values())
                    shape = shapes.get(paths)
                    if shape is None:
                        if sum(map(len, shapes)) > SHAPE_PATHS:
                            shapes.clear()
                        shape = shapes[paths] = Shape(paths, plain, objects, near_units)
                    whole = {}
                    if shape.objects and isinstance(part, dict):
                        whole = {f: unit for f, place, unit in shape.objects if (place is None or values[place] is None) and isinstance(part.get(f), (dict, list))}
                        values += [part[f] for f in whole]
                    same = alike.get((paths, *whole))
                    if same is None:
                        same = alike[paths, *whole] = Alike(shape, len(paths), whole)
                    same.rows.append(len(take))
                    same.values.append([values[p] for p in same.places])
                    take.append(k)
                    numbers.append(n)
                if not records:
                    take.append(k)
                    numbers.append(None)
            found: dict[str, list[list]] = {f: [] for f in fields}  # of each field: rows and the wanted parts of it in them
            for same in alike.values():
                for f, values, path, units in same.known():
                    if not found[f]:
                        found[f] = [[] for _ in range(1 + len(wanted[f]))]
                    for column, more in zip(found[f], [same.rows, *_parts(wanted[f], values, path, units)], strict=True):
                        column += more
            picked = pa.array(take, pa.int64())
            columns = [batch.column(i).take(picked).cast(want.field(i).type) for i in range(len(kept))]
            none = np.array([n is None for n in numbers], bool)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int32()), _structs(found, none, want.field("found").type)], schema=want)

    out = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{json_text}`").cast("string").alias("json_text_")).mapInArrow(rows, schema)
    return out if split is not None else out.drop("object_no")
