"""Removal of repeated byte strings by suffix order, in buckets, with a difference cover.

Every byte covered by a string of ``length`` bytes that also starts anywhere else in the table is removed. Two
suffixes share such a string exactly if they are in one class of the suffix order cut at that depth (200 bytes).

1. Cover sample. Positions whose place in their document, modulo v = 133, is in a difference cover D of 12
   residues are the sample. For any two positions i and j there is a d < v with i+d and j+d both in the sample,
   so a repeated 200-byte string holds a repeated sample string of 200 - 132 = 68 bytes. A suffix can only be
   repeated if a repeated sample string begins within its first v bytes; other suffixes are never sorted.
2. Suffix buckets. The suffixes left go to buckets, which are sorted one after another, each spread over all tasks
   in slices of bounded size. In a bucket suffixes meet by fingerprint. Long ties are resolved by the suffix before:
   where all suffixes of one fingerprint follow suffixes of one fingerprint, and end with the same byte, they are
   equal if those before are. All others, the first suffixes of repeats above all, are compared by their bytes.
3. Every document is cut by the repeated suffixes found in it.

Fingerprints of 63 bits choose where strings meet and rule out those that meet no other, since equal strings have
equal fingerprints; what repeats is decided by bytes. Step 2 is sound because every chain of suffixes, each one byte
after the other, begins with one compared by its bytes. If texts differ under one fingerprint, the suffixes that
follow these are compared by their bytes too, round by round, until none is left (``hashed`` of few values does that
in the tests). So a collision costs time, not text.

Equal strings of one block are sent once, with a mark, so a string that fills a third of the table costs one entry
for each block. The passes over the table don't grow with it: a bucket is at most 7/4 of the texts, so there are
10 at most, and slices, and with them tasks, grow instead.

Null text counts as empty. Matches never cross documents; rows with equal text repeat each other. Removal is by
bytes: what is left of a character cut in two is dropped from the kept text, but not from its digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelane.llm.common import arrow_schema, by_bytes, flat_text, list_array, mix, registered, renamed_clashes, scratch, shared_dir, shuffles_dropped, staged, struct_of, tidy

LENGTH, PERIOD = 200, 133
BLOCK_BYTES = 2 << 20
#: Classes, and bytes of text, in one slice of a sort.
PER_TASK, TEXT_PER_TASK = 1_000_000, 32 << 20
#: What a suffix is sent as: its class, the class before, and its last byte.
SENT_BYTES = 17
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


@lru_cache(maxsize=4)
def difference_cover(v: int) -> tuple[int, ...]:
    """Residues such that every difference modulo v occurs: Singer's set for v = q*q + q + 1 with q prime, the
    powers of a primitive element of GF(q^3) that lie on one line; for other v a ladder of about 2 * sqrt(v)."""
    q = next((q for q in range(2, v) if q * q + q + 1 >= v), 2)
    if q * q + q + 1 == v and all(q % p for p in range(2, q)):
        for c in range(1, q**3):
            c0, c1, c2 = c % q, c // q % q, c // q // q
            x, powers = (1, 0, 0), []
            for _ in range(v):
                powers.append(x)
                x = (x[2] * c0 % q, (x[0] + x[2] * c1) % q, (x[1] + x[2] * c2) % q)
            if c0 and x[1] == x[2] == 0 and not any(p[1] == p[2] == 0 for p in powers[1:]):
                return tuple(i for i, p in enumerate(powers) if p[2] == 0)
    r = int(np.ceil(np.sqrt(v)))
    return tuple(sorted({*range(r), *range(0, v, r)}))


_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, for all places that have as many."""
    n = len(raw) - 7
    out = np.empty(max(n, 0), np.uint64)
    for k in range(min(8, n)):
        m = (n - k + 7) // 8
        out[k::8] = np.frombuffer(raw[k : k + 8 * m].tobytes(), np.uint64)
    return out


def prefix_classes(raw: np.ndarray, length: int, segment: int = 1 << 15) -> np.ndarray:
    """Fingerprints of the length bytes from each place (fewer places than bytes: the last length - 1 have none).

    Fingerprints of 8, 16, 32, ... bytes are made by joining two of half the size; the length's binary digits
    say which to join, and the last eight bytes cover what is left. Segments keep the work in cache.
    """
    n = len(raw) - length + 1
    out = np.empty(max(n, 0), np.uint64)
    if length < 8:
        for k in range(length if n > 0 else 0):
            out[:] = mix(raw[k : k + n] + np.uint64(1)) if k == 0 else _joined(out, raw[k : k + n] + np.uint64(1))
        return mix(out)
    for a in range(0, max(n, 0), segment):
        b = min(a + segment, n)
        words = _words(raw[a : b + length - 1])
        level, size, got, have = mix(words), 8, None, 0
        while True:
            if length & size:
                part = level[have : have + b - a]
                got = part if got is None else _joined(got, part)
                have += size
            if size * 2 > length:
                break
            level = _joined(level[:-size], level[size:])
            size *= 2
        if have < length:
            got = _joined(got, words[length - 8 : length - 8 + b - a])
        out[a:b] = mix(got)
    return out


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * _ODD[0]
    z ^= z >> np.uint64(32)
    z += y
    z *= _ODD[1]
    z ^= z >> np.uint64(29)
    return z


def text_blocks(df: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, rows (the documents' other columns), data (their texts as bytes) and ends (offsets of their ends)."""
    rows = T.StructType([f for f in df.schema.fields if f.name != text])
    if not rows.fields:
        raise ValueError("the table needs a column besides the text")
    schema = T.StructType([T.StructField("block", T.LongType(), False), T.StructField("rows", T.ArrayType(rows, True), False), T.StructField("data", T.BinaryType(), False), T.StructField("ends", T.ArrayType(T.LongType(), False), False)])
    want = arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, table in enumerate(by_bytes(batches, text, block_bytes)):
            raw, off = flat_text(table[text])
            one = lambda v: list_array(v, np.array([0, len(v)]))
            columns = [pa.array([(part << 32) + k]), one(struct_of(table, rows)), pa.array([raw.tobytes()], pa.binary()), one(pa.array(off[1:]))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, want, strict=True)], schema=want)

    return df.mapInArrow(tidy(pack), schema)


def _starts(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], ends[:-1]]).astype(np.int64)


def sample_places(ends: np.ndarray, cover: tuple[int, ...], period: int, length: int) -> np.ndarray:
    """Places of the cover sample: all whose string of the given length stays inside the document."""
    first = _starts(ends)
    room = ends - first - length + 1
    size = int(max(room.max(initial=0), 0))
    offsets = (np.arange(0, size + period, period)[:, None] + np.array(sorted(cover))).ravel()
    n = np.searchsorted(offsets, np.maximum(room, 0), side="left")
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first, n) + offsets[step]


def candidate_places(marked: np.ndarray, ends: np.ndarray, period: int, length: int) -> np.ndarray:
    """Places whose length-byte string stays in its document and has a marked place among its first period ones."""
    total = int(ends[-1]) if len(ends) else 0
    near = np.zeros(total + period + 1, np.int32)
    first = _starts(ends)
    doc = np.searchsorted(ends, marked, side="right")
    np.add.at(near, np.maximum(marked - period + 1, first[doc]), 1)
    np.add.at(near, marked + 1, -1)
    open_ = np.cumsum(near[:total]) > 0
    for a, b in zip(np.maximum(ends - length + 1, first), ends, strict=True):
        open_[a:b] = False
    return np.flatnonzero(open_)


def _pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def _unpack(bits: pa.Scalar | bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits if isinstance(bits, bytes) else bits.as_buffer(), np.uint8), count=n).astype(bool)


def _numbers(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _ddl(kinds: dict[str, pa.DataType]) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{n} {names[t]}" for n, t in kinds.items())


_CLASSES = {"block": pa.int64(), "slice": pa.int32(), "classes": pa.binary(), "twice": pa.binary()}
_SUFFIXES = _CLASSES | {"before": pa.binary(), "last": pa.binary(), "mixed": pa.binary()}
_STRINGS = {"block": pa.int64(), "slice": pa.int32(), "n": pa.int32(), "classes": pa.binary(), "texts": pa.binary(), "twice": pa.binary()}
#: What comes back for a row that was sent: a bit for each class or string, and how many bits of b are set.
_BACK = "block long, slice int, n long, a binary, b binary"
#: The class before a suffix that follows none.
NONE = np.uint64(1 << 63)


def _answer(table: pa.Table, sizes: list[int], a: np.ndarray, b: np.ndarray) -> pa.Table:
    cuts = np.cumsum(sizes)[:-1]
    a, b = np.split(a, cuts), np.split(b, cuts)
    return pa.table({"block": table["block"], "slice": table["slice"], "n": pa.array([int(x.sum()) for x in b]), "a": pa.array([_pack(x) for x in a], pa.binary()), "b": pa.array([_pack(x) for x in b], pa.binary())})


def _slice_edges(kinds: np.ndarray, slices: int) -> np.ndarray:
    """Where each slice of the range of 63-bit classes begins among these sorted ones."""
    return np.searchsorted((kinds >> np.uint64(31)).astype(np.int64), (1 << 32) * np.arange(slices + 1) // slices)


def _ordered(values: np.ndarray) -> np.ndarray:
    """Places in the order of the values. Classes are sorted by their first bits with the place in the last ones, which
    is several times faster than sorting places; where these bits are too few, places are sorted."""
    if values.dtype == np.uint64:
        low = np.uint64(max(len(values) - 1, 1).bit_length())
        packed = np.sort(values >> low << low | np.arange(len(values), dtype=np.uint64))
        order = (packed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
        if (values[order[1:]] >= values[order[:-1]]).all():
            return order
    return np.argsort(values)


class Classes:
    """The distinct values of an array in order, how often each occurs, and the places of each."""

    def __init__(self, values: np.ndarray) -> None:
        self.order = _ordered(values)
        ordered = values[self.order]
        self.new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(values) else np.zeros(0, bool)
        self.first = np.flatnonzero(self.new)
        self.kinds = ordered[self.first]
        self.times = np.diff(np.append(self.first, len(values)))

    def of_places(self, marks: np.ndarray) -> np.ndarray:
        """For each place the mark of its value."""
        out = np.empty(len(self.order), marks.dtype)
        out[self.order] = np.repeat(marks, self.times)
        return out

    def any_of(self, marks: np.ndarray) -> np.ndarray:
        """For each value whether any of its places, given in order of the values, is marked."""
        return np.logical_or.reduceat(marks, self.first) if len(self.first) else np.zeros(0, bool)

    def differ(self, *arrays: np.ndarray) -> np.ndarray:
        """For each value whether its places have different entries in one of the arrays."""
        out = np.zeros(len(self.order), bool)
        for x in arrays:
            x = x[self.order]
            out[1:] |= (x[1:] != x[:-1]) & ~self.new[1:]
        return self.any_of(out)

    def answered(self, slices: int, back: dict[int, dict], name: str) -> np.ndarray:
        """For each value the bit that came back for it."""
        out, edges = np.zeros(len(self.kinds), bool), _slice_edges(self.kinds, slices)
        for s in np.flatnonzero(np.diff(edges)):
            if int(s) in back:
                out[edges[s] : edges[s + 1]] = _unpack(back[int(s)][name], edges[s + 1] - edges[s])
        return out


def _send_classes(block: int, classes: np.ndarray, slices: int) -> list[tuple]:
    """The block's distinct classes by slice, and which occur twice in it."""
    kinds, times = np.unique(classes, return_counts=True)
    edges = _slice_edges(kinds, slices)
    return [(block, int(s), kinds[edges[s] : edges[s + 1]].tobytes(), _pack(times[edges[s] : edges[s + 1]] > 1)) for s in np.flatnonzero(np.diff(edges))]


def _sorted_classes(sent: DataFrame) -> DataFrame:
    """Sort each slice of classes over all blocks; bit a: the class occurs twice in a block or in two blocks."""

    def sort(table: pa.Table) -> pa.Table:
        classes = _numbers(table["classes"], np.uint64)
        twice = [c[_unpack(x, len(c))] for c, x in zip(classes, table["twice"], strict=True)]
        ordered = np.sort(np.concatenate(classes + twice))
        shared = ordered[1:][ordered[1:] == ordered[:-1]]
        found = np.concatenate([_isin(c, shared) for c in classes])  # both in order
        return _answer(table, [len(c) for c in classes], found, np.zeros(len(found), bool))

    return sent.groupBy("slice").applyInArrow(sort, _BACK)


def _send_suffixes(block: int, classes: np.ndarray, before: np.ndarray, last: np.ndarray, slices: int, own: range) -> list[tuple]:
    """The block's distinct classes of its own slices, what stands before and last in each, and which have several such."""
    of = Classes(classes)
    mixed = of.differ(before, last)
    some = of.order[of.first]
    edges, rows = _slice_edges(of.kinds, slices), []
    for s in np.flatnonzero(np.diff(edges)):
        if int(s) in own:
            cut = slice(edges[s], edges[s + 1])
            rows.append((block, int(s), of.kinds[cut].tobytes(), _pack(of.times[cut] > 1), before[some[cut]].tobytes(), last[some[cut]].tobytes(), _pack(mixed[cut])))
    return rows


def _sorted_suffixes(sent: DataFrame) -> DataFrame:
    """Sort each slice of suffixes over all blocks. Bit a: the class occurs twice in a block or in two blocks; bit b:
    it does, and its suffixes don't all follow one class and end with one byte."""

    def sort(table: pa.Table) -> pa.Table:
        classes = _numbers(table["classes"], np.uint64)
        bits = lambda name: np.concatenate([_unpack(x, len(c)) for c, x in zip(classes, table[name], strict=True)])
        of = Classes(np.concatenate(classes))
        before, last = (np.concatenate(_numbers(table[n], t)) for n, t in (("before", np.uint64), ("last", np.uint8)))
        shared = (of.times > 1) | of.any_of(bits("twice")[of.order])
        mixed = of.differ(before, last) | of.any_of((bits("mixed") | (before == NONE))[of.order])
        return _answer(table, [len(c) for c in classes], of.of_places(shared), of.of_places(shared & mixed))

    return sent.groupBy("slice").applyInArrow(sort, _BACK)


def _isin(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def _windows(raw: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(raw, width)[at]


def distinct_strings(raw: np.ndarray, at: np.ndarray, width: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct strings among those at these places, and for each place which of them it has. Strings
    are compared with the first of their class as bytes; those that differ from it are a further round."""
    firsts, which, left = [], np.empty(len(at), np.int64), np.arange(len(at))
    while len(left):
        _, first, of = np.unique(classes[left], return_index=True, return_inverse=True)
        same = np.empty(len(left), bool)
        for a in range(0, len(left), 1 << 15):
            part = slice(a, a + (1 << 15))
            same[part] = (_windows(raw, at[left[part]], width) == _windows(raw, at[left[first[of[part]]]], width)).all(1)
        which[left[same]] = of[same] + sum(map(len, firsts))
        firsts.append(at[left[first]])
        left = left[~same]
    return np.concatenate(firsts) if firsts else np.zeros(0, np.int64), which


class Strings:
    """The distinct strings of a block at some places, by slice and, in a slice, in the order of their bytes."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, width: int, classes: np.ndarray, slices: int) -> None:
        self.raw, self.at, self.width = raw, at, width
        self.first, self.which = distinct_strings(raw, at, width, classes)
        self.times = np.bincount(self.which, minlength=len(self.first))
        self.classes = np.zeros(len(self.first), np.uint64)
        self.classes[self.which] = classes
        slice_ = ((self.classes >> np.uint64(31)).astype(np.int64) * slices) >> 32
        self.order = np.argsort(slice_, kind="stable")
        self.edges = np.searchsorted(slice_[self.order], np.arange(slices + 1))

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(slice, numbers of its distinct strings in the order of their bytes, the strings)."""
        for s in np.flatnonzero(np.diff(self.edges)):
            own = self.order[self.edges[s] : self.edges[s + 1]]
            texts = np.ascontiguousarray(_windows(self.raw, self.first[own], self.width)).view(f"S{self.width}").ravel()
            order = np.argsort(texts)
            yield int(s), own[order], texts[order]

    def rows(self, block: int, own: range) -> Iterator[tuple]:
        zstd = pa.Codec("zstd", 1)
        for s, numbers, texts in self.parts():
            if s in own:
                yield block, s, len(numbers), self.classes[numbers].tobytes(), zstd.compress(texts.tobytes(), asbytes=True), _pack(self.times[numbers] > 1)

    def answered(self, back: dict[int, dict], name: str) -> np.ndarray:
        """The places whose string's bit came back."""
        found = np.zeros(len(self.first), bool)
        for s, numbers, _ in self.parts():
            if s in back:
                found[numbers] = _unpack(back[s][name], len(numbers))
        return self.at[found[self.which]]


def _sorted_strings(sent: DataFrame, width: int) -> DataFrame:
    """Sort the strings of each slice as bytes. Bit a: the string is repeated; bit b: its class has other strings too."""

    def sort(table: pa.Table) -> pa.Table:
        zstd, n = pa.Codec("zstd", 1), table["n"].to_pylist()
        data = b"".join(zstd.decompress(t.as_buffer(), k * width, asbytes=True) for t, k in zip(table["texts"], n, strict=True))
        texts = np.frombuffer(data, f"S{width}")
        order = np.argsort(texts)
        rank = np.empty(len(texts), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], texts[order[1:]] != texts[order[:-1]]]))
        of = Classes(rank)
        twice = np.concatenate([_unpack(t, k) for t, k in zip(table["twice"], n, strict=True)])
        found = of.of_places((of.times > 1) | of.any_of(twice[of.order]))
        by_class = Classes(np.concatenate(_numbers(table["classes"], np.uint64)))
        return _answer(table, n, found, by_class.of_places(by_class.differ(rank)))

    return sent.groupBy("slice").applyInArrow(sort, _BACK)


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch, int]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("block")[i].as_py(), np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8), batch, i


def _ends(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column("ends")[i].values.to_numpy()


def _answers(batch: pa.RecordBatch, i: int, name: str) -> dict[int, dict]:
    return {r["slice"]: r for r in batch.column(name)[i].as_py() or ()}


def _joined_back(blocks: DataFrame, back: DataFrame, name: str) -> DataFrame:
    """blocks with what came back for each: a list of (slice, bits), no more than there are slices."""
    return blocks.join(back.groupBy("block").agg(F.collect_list(F.struct("slice", "a", "b")).alias(name)), "block", "left")


def marked(places: np.ndarray, n: int) -> np.ndarray:
    """For each of n places, and the one after the last, whether it is among these."""
    out = np.zeros(n + 1, bool)
    out[places] = True
    return out


def _runs(places: np.ndarray) -> bytes:
    """Sorted places as runs: pairs of first and end."""
    if not len(places):
        return b""
    edge = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1] + 1]))
    return np.column_stack([places[edge], np.append(places[edge[1:] - 1], places[-1]) + 1]).astype(np.int32).tobytes()


def _places(runs: pa.Scalar) -> np.ndarray:
    if not runs.is_valid or not len(runs.as_buffer()):
        return np.zeros(0, np.int64)
    r = np.frombuffer(runs.as_buffer(), np.int32).reshape(-1, 2).astype(np.int64)
    n = r[:, 1] - r[:, 0]
    return np.repeat(r[:, 0] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def cut_repeats(df: DataFrame, text: str = "text", length: int = LENGTH, period: int = PERIOD, keep_text: bool = False, block_bytes: int = BLOCK_BYTES, per_task: int = PER_TASK, text_per_task: int = TEXT_PER_TASK, hashed: Callable[[np.ndarray, int], np.ndarray] = prefix_classes) -> DataFrame:
    """df without the text, with n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256; keep_text adds
    kept_text. Columns named like a result get the suffix ``_in``. hashed: gives the fingerprints of all strings of
    a length; the results are the same for any."""
    with scratch() as keep:
        return _cut_repeats(df, text, length, period, keep_text, block_bytes, per_task, text_per_task, hashed, keep)


def _cut_repeats(df, text, length, period, keep_text, block_bytes, per_task, text_per_task, hashed, keep) -> DataFrame:
    spark = df.sparkSession
    results = RESULTS[: 5 if keep_text else 4]
    df = renamed_clashes(df, results, keep=[text])
    while period > length:
        period = period // 2 or 1
    cover, depth = difference_cover(period), length - period + 1
    blocks = keep(staged(text_blocks(df, text, block_bytes), "texts"))
    n_bytes = blocks.where(F.size("ends") > 0).agg(F.sum(F.element_at("ends", -1)).alias("n")).first().n or 0
    slices = max(8, -(-n_bytes * len(cover) // period // per_task))
    class_of = lambda raw, size: hashed(raw, size) >> np.uint64(1)

    # 1. which sample strings have a fingerprint of their own
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, raw, batch, i in _blocks_of(batches):
            at = sample_places(_ends(batch, i), cover, period, depth)
            if len(at):
                yield _table(_send_classes(block, class_of(raw, depth)[at], slices), _CLASSES)

    text_columns = blocks.select("block", "data", "ends")
    shared = staged(_sorted_classes(text_columns.mapInArrow(tidy(sample), _ddl(_CLASSES))), "sample")

    # the suffixes that can be repeated, by block, as runs of places
    def remain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, raw, batch, i in _blocks_of(batches):
            ends = _ends(batch, i)
            at = sample_places(ends, cover, period, depth)
            if len(at):
                of = Classes(class_of(raw, depth)[at])
                left = candidate_places(at[of.of_places(of.answered(slices, _answers(batch, i, "shared"), "a"))], ends, period, length)
                if len(left):
                    yield _table([(block, len(left), _runs(left), raw.tobytes())], {"block": pa.int64(), "n": pa.int64(), "runs": pa.binary(), "data": pa.binary()})

    left = keep(staged(_joined_back(text_columns, shared, "shared").mapInArrow(tidy(remain), "block long, n long, runs binary, data binary"), "suffixes"))
    n_left = left.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-n_left * SENT_BYTES * 4 // max(1, n_bytes * 7)))
    parts = max(8, -(-n_left // buckets // per_task))

    # 2. the suffix buckets
    def suffixes(batch: pa.RecordBatch, i: int, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = _places(batch.column("runs")[i])
        return at, class_of(raw, length)[at]

    path = shared_dir(spark, "classes")
    for k in range(buckets):
        own = range(k * parts, (k + 1) * parts)

        def sort_bucket(batches: Iterator[pa.RecordBatch], own: range = own) -> Iterator[pa.RecordBatch]:
            for block, raw, batch, i in _blocks_of(batches):
                at, classes = suffixes(batch, i, raw)
                top = ((classes >> np.uint64(31)).astype(np.int64) * (parts * buckets)) >> 32
                here = np.flatnonzero((top >= own.start - 1) & (top <= own.stop))  # edges are exact in _send_suffixes
                before = np.where(at[here] - 1 == at[here - 1], classes[here - 1], NONE)
                rows = _send_suffixes(block, classes[here], before, raw[at[here] + length - 1], parts * buckets, own)
                if rows:
                    yield _table(rows, _SUFFIXES)

        with shuffles_dropped(spark):
            _sorted_suffixes(left.select("block", "runs", "data").mapInArrow(tidy(sort_bucket), _ddl(_SUFFIXES))).write.mode("append").parquet(path)
    sorted_ = keep(registered(spark.read.schema(_BACK).parquet(path), path))
    found = _joined_back(left.select("block", "runs", "data"), sorted_, "sorted")

    # strings compared by their bytes: round by round, and in parts where they are many times the input
    n_open = sorted_.agg(F.sum("n")).first()[0] or 0
    plan: list[tuple[int, int]] = []  # slices of each round and of one part of it

    def verdict(batch: pa.RecordBatch, i: int, raw: np.ndarray, rounds: int, answers: dict[int, dict[int, dict]]) -> tuple[np.ndarray, Strings | None]:
        """The places known to be repeated after so many rounds, and the strings of the next."""
        at, classes = suffixes(batch, i, raw)
        of = Classes(classes)
        back = _answers(batch, i, "sorted")
        shared, open_ = (of.answered(parts * buckets, back, n) for n in "ab")
        sure, now = of.of_places(shared & ~open_), of.of_places(open_)
        for r in range(rounds):
            asked = Strings(raw, at[now], length, classes[now], plan[r][0])
            sure |= marked(asked.answered(answers.get(r, {}), "a"), len(raw))[at]
            several = asked.answered(answers.get(r, {}), "b")  # places of strings whose class has others
            now = np.zeros(len(at), bool)
            if len(several):
                after = marked(several + 1, len(raw))[at]
                now = of.of_places(of.any_of((after & of.of_places(shared & ~open_))[of.order]))
                open_ |= of.any_of(now[of.order])
                sure &= ~now
        asked = Strings(raw, at[now], length, classes[now], plan[rounds][0]) if rounds < len(plan) else None
        return at[sure], asked

    def by_round(batch: pa.RecordBatch, i: int) -> dict[int, dict[int, dict]]:
        out: dict[int, dict[int, dict]] = {}
        for r in batch.column("back")[i].as_py() or ():
            out.setdefault(r["round"], {})[r["slice"]] = r
        return out

    texts = shared_dir(spark, "compared")
    answered = lambda: found.join(spark.read.schema(f"{_BACK}, round int").parquet(texts).groupBy("block").agg(F.collect_list(F.struct("round", "slice", "a", "b")).alias("back")), "block", "left") if plan[1:] else found.withColumn("back", F.lit(None).cast("array<struct<round int, slice int, a binary, b binary>>"))
    while n_open:
        r, turns = len(plan), max(1, -(-n_open * length // max(1, 4 * n_bytes)))
        size = max(8, -(-n_open * length // turns // text_per_task))
        plan.append((turns * size, size))
        for k in range(turns):
            own = range(k * size, (k + 1) * size)

            def send(batches: Iterator[pa.RecordBatch], own: range = own, r: int = r) -> Iterator[pa.RecordBatch]:
                for block, raw, batch, i in _blocks_of(batches):
                    for row in verdict(batch, i, raw, r, by_round(batch, i))[1].rows(block, own):
                        yield _table([row], _STRINGS)

            with shuffles_dropped(spark):
                _sorted_strings(answered().mapInArrow(tidy(send), _ddl(_STRINGS)), length).withColumn("round", F.lit(r)).write.mode("append").parquet(texts)
        n_open = spark.read.schema(f"{_BACK}, round int").parquet(texts).where(F.col("round") == r).agg(F.sum("n")).first()[0] or 0
    rounds = len(plan)
    if rounds:
        keep(registered(spark.read.schema(f"{_BACK}, round int").parquet(texts), texts))
    back = found.join(spark.read.schema(f"{_BACK}, round int").parquet(texts).groupBy("block").agg(F.collect_list(F.struct("round", "slice", "a", "b")).alias("back")), "block", "left") if rounds else found.withColumn("back", F.lit(None).cast("array<struct<round int, slice int, a binary, b binary>>"))

    fields = blocks.schema["rows"].dataType.elementType.fields
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.StringType()]
    schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in zip(results, kinds, strict=False))])
    want = arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw, batch, i in _blocks_of(batches):
            ends = _ends(batch, i)
            hit = verdict(batch, i, raw, rounds, by_round(batch, i))[0] if batch.column("runs")[i].is_valid else np.zeros(0, np.int64)
            edge = np.zeros(len(raw) + 1, np.int32)
            edge[hit] += 1
            edge[hit + length] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            first = _starts(ends)
            inner = first[first < ends]
            begin[inner] = gone[inner]
            upto = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
            removed, spans = upto(gone), upto(begin)
            data, keep = raw.tobytes(), ~gone
            digests, kept = [], []
            for a, b in zip(first, ends, strict=True):
                rest = raw[a:b][keep[a:b]].tobytes() if removed[b] > removed[a] else data[a:b]
                digests.append(hashlib.sha256(rest).hexdigest())
                if keep_text:
                    kept.append(rest.decode("utf-8", "ignore"))
            out = [*batch.column("rows")[i].values.flatten(), pa.array(ends - first), pa.array(removed[ends] - removed[first]), pa.array(spans[ends] - spans[first]), pa.array(digests, pa.string()), *([pa.array(kept, pa.string())] if keep_text else [])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, want, strict=True)], schema=want)

    return blocks.join(back.select("block", "runs", "sorted", "back"), "block", "left").mapInArrow(tidy(cut), schema)
