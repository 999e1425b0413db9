"""Benchmark decontamination with a distributed positional inverted index.

The training table becomes blocks of whole documents, about ``block_bytes`` of text each. A block's index lists
its terms, how often each occurs, and the word positions of every term one list after another (its postings).
The index is a table: it is written once and can be searched for any benchmark.

A phrase is found by intersecting postings: the positions of its rarest term in the block, less the term's
offset in the phrase, are the possible starts, and those not in the offset-adjusted list of the next rarest
term are struck off, until no start or no term is left. A phrase with a term that the block lacks costs
nothing. Hits are exact: terms are compared as bytes, every term is intersected, documents are never crossed.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered. An item's phrases are its windows
of 13 consecutive words; an item of fewer, but at least one, is one phrase; an item without words is never found.
A document word inside any occurrence of a phrase is hit. Null texts have no words. Item ids appear as strings,
a null id as the empty string; rows of one id are one item. Other columns are kept; one named like a result gets
the suffix ``_in``.

The benchmark is sent to the tasks in chunks of about ``chunk_bytes`` of text, measured first; with more than one
chunk the index is read once for each, and only the hits of the documents that have any are brought together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelane.llm.common import LARGE_ROWS, arrow_schema, by_bytes, flat_text, list_array, renamed_clashes, split_words, staged, struct_of, tidy

WINDOW = 13
BLOCK_BYTES, CHUNK_BYTES = 2 << 20, 8 << 20
#: Postings of rarest terms looked at together in one block.
BUDGET = 1 << 20
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_POSTINGS = [("doc_starts", T.IntegerType()), ("counts", T.IntegerType()), ("positions", T.IntegerType())]


def build_index(df: DataFrame, text: str = "text", keep_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The positional index of df: block, rows (the documents' other columns), doc_starts, terms, counts, positions."""
    df = renamed_clashes(df, RESULTS, keep=[text])
    rows = T.StructType([f for f in df.schema.fields if keep_text or f.name != text])
    if not rows.fields:
        raise ValueError("the table needs a column besides the text")
    lists = [T.StructField(n, T.ArrayType(t, False), False) for n, t in _POSTINGS]
    schema = T.StructType([T.StructField("block", T.StringType(), False), T.StructField("rows", T.ArrayType(rows, True), False), T.StructField("terms", T.ArrayType(T.BinaryType(), False), False), *lists])
    names = arrow_schema(schema)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, table in enumerate(by_bytes(batches, text, block_bytes)):
            words, starts = split_words(*flat_text(table[text]))
            term = words.indices.to_numpy()
            order = np.argsort(term, kind="stable").astype(np.int32)
            counts = np.bincount(term, minlength=len(words.dictionary)).astype(np.int32)
            one = lambda v: list_array(v, np.array([0, len(v)]))
            columns = [pa.array([f"{part}-{k}"]), one(struct_of(table, rows)), one(words.dictionary), one(pa.array(starts.astype(np.int32))), one(pa.array(counts)), one(pa.array(order))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, names, strict=True)], schema=names)

    return df.mapInArrow(tidy(index), schema)


@dataclass
class Phrases:
    """Phrases as term numbers: one row each, padded with -1 on the right."""

    vocabulary: pa.Array
    terms: np.ndarray
    length: np.ndarray
    item: np.ndarray
    item_ids: list[str]

    @classmethod
    def of(cls, items: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
        raw, off = flat_text(pa.array([t for _, t in items], pa.string()))
        words, starts = split_words(raw, off)
        term = words.indices.to_numpy().astype(np.int64)
        found, item = [], []
        names = ["" if i is None else str(i) for i, _ in items]
        number = {name: k for k, name in enumerate(dict.fromkeys(names))}
        for name, a, b in zip(names, starts[:-1], starts[1:], strict=True):
            for s in range(a, max(a + 1, b - window + 1)) if b > a else ():
                found.append(term[s : min(b, s + window)])
                item.append(number[name])
        terms = np.full((len(found), window), -1, np.int64)
        for k, f in enumerate(found):
            terms[k, : len(f)] = f
        if len(found):
            terms, where = np.unique(np.column_stack([np.array(item), terms]), axis=0, return_index=True)
            item, terms = terms[:, 0], terms[:, 1:]
        return cls(words.dictionary, terms, (terms >= 0).sum(1), np.array(item, np.int64), list(number))


class Block:
    """One block's postings, ready for intersection."""

    def __init__(self, terms: pa.Array, counts: np.ndarray, positions: np.ndarray, doc_starts: np.ndarray) -> None:
        self.terms, self.counts, self.positions, self.doc_starts = terms, counts.astype(np.int64), positions, doc_starts
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.sorted: np.ndarray | None = None

    def numbers(self, vocabulary: pa.Array) -> np.ndarray:
        """The block's number of each vocabulary term, -1 for those it lacks; one more -1 stands for padding."""
        return np.append(pc.fill_null(pc.index_in(vocabulary, value_set=self.terms), -1).to_numpy().astype(np.int64), -1)

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each term has a posting at the position."""
        if self.sorted is None:
            self.sorted = (np.repeat(np.arange(len(self.counts)), self.counts) << 32) | self.positions
        want = (term << 32) | position
        at = np.minimum(np.searchsorted(self.sorted, want), len(self.sorted) - 1)
        return self.sorted[at] == want

    def postings(self, phrase: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) for each posting of each phrase's term."""
        n = self.counts[term]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(phrase, n), self.positions[np.repeat(self.first[term], n) + step].astype(np.int64)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_starts, position, side="right") - 1

    def rarest_first(self, phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The phrases whose terms the block all has, in groups of about ``BUDGET`` postings of rarest terms: the
        phrases' numbers, the block's numbers of their terms, their offsets with the rarest term first, and for each
        posting of a rarest term the phrase (its place in the group) and the position."""
        if not len(self.positions) or not len(phrases.terms):
            return
        term = self.numbers(phrases.vocabulary)[phrases.terms]
        live = np.flatnonzero(((term >= 0) | (phrases.terms < 0)).all(1))
        if not len(live):
            return
        count = np.where(phrases.terms[live] < 0, np.iinfo(np.int64).max, self.counts[term[live]])
        rarest = np.argsort(count, axis=1, kind="stable")
        turn = np.cumsum(self.counts[term[live, rarest[:, 0]]]) // BUDGET
        for group in np.split(np.arange(len(live)), np.flatnonzero(np.diff(turn)) + 1):
            own, first = live[group], rarest[group]
            yield own, term[own], first, *self.postings(np.arange(len(own)), term[own, first[:, 0]])

    def exact(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of every occurrence inside one document."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for own, term, rarest, k, at in self.rarest_first(phrases):
            start = at - rarest[k, 0]
            k, start = k[start >= 0], start[start >= 0]
            for r in range(1, phrases.terms.shape[1]):
                offset = rarest[k, r]
                done = phrases.terms[own[k], offset] < 0
                keep = done | self.holds(np.where(done, 0, term[k, offset]), start + offset)
                k, start = k[keep], start[keep]
            within = start + phrases.length[own[k]] <= self.doc_starts[self.document(start) + 1]
            found.append((own[k[within]], start[within]))
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def near(self, phrases: Phrases, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) where every term lies within slop words of its place, counted from the rarest term, in one
        document; a start before the document is its first word."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for own, term, rarest, k, at in self.rarest_first(phrases):
            start = at - rarest[k, 0]
            self.holds(np.zeros(1, np.int64), np.zeros(1, np.int64))
            doc = self.document(at)
            for r in range(1, phrases.terms.shape[1]):
                offset = rarest[k, r]
                done = phrases.terms[own[k], offset] < 0
                of = np.where(done, 0, term[k, offset])
                low = np.maximum(start + offset - slop, self.doc_starts[doc])
                high = np.minimum(start + offset + slop, self.doc_starts[doc + 1] - 1)
                least, most = (of << 32) | np.maximum(low, 0), (of << 32) | np.maximum(high, 0)
                found_at = self.sorted[np.minimum(np.searchsorted(self.sorted, least), len(self.sorted) - 1)]
                keep = done | ((least <= found_at) & (found_at <= most))
                k, start, doc = k[keep], start[keep], doc[keep]
            found.append((own[k], np.maximum(start, self.doc_starts[doc])))
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def chunks(benchmark: DataFrame, item: str, text: str, n: int) -> Iterator[list[tuple]]:
    """The items in n lists of about one size; only one list at a time is on the driver."""
    items = benchmark.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text"))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, r.text) for r in part.toLocalIterator()]


_FOUND = [T.StructField("block", T.StringType()), T.StructField("doc", T.IntegerType()), T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))]


def search(index: DataFrame, phrases: Phrases, slop: int | None = None, only_hits: bool = False, then: tuple[Work, T.StructType] | None = None) -> DataFrame:
    """A row for each document: row (a struct of its columns), block, doc (its place in the block), n_words, hits (flat
    pairs of first word and end, merged) and items. slop: proximity matches instead of exact phrases. only_hits:
    documents that have one, without row. then: what is made of these rows at once, and its schema."""
    sent = index.sparkSession.sparkContext.broadcast(phrases)
    rows = [] if only_hits else [T.StructField("row", index.schema["rows"].dataType.elementType)]
    schema = T.StructType([*rows, *_FOUND])
    want = arrow_schema(schema)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i].values  # noqa: B023, E731
                starts = get("doc_starts").to_numpy().astype(np.int64)
                block = Block(get("terms"), get("counts").to_numpy(), get("positions").to_numpy(), starts)
                phrase, at = block.exact(use) if slop is None else block.near(use, slop)
                n = len(starts) - 1
                hits: list[list[int]] = [[] for _ in range(n)]
                items: list[list[str]] = [[] for _ in range(n)]
                if len(phrase):
                    doc = block.document(at)
                    for d, it in np.unique(np.column_stack([doc, use.item[phrase]]), axis=0):
                        items[d].append(use.item_ids[it])
                    end = np.minimum(at + use.length[phrase], starts[doc + 1])
                    at = np.maximum(at, starts[doc])
                    edge = np.zeros(int(starts[-1]) + 2, np.int32)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, end, -1)
                    covered = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
                    covered_from = np.flatnonzero(covered[1:] & ~covered[:-1])
                    covered_to = np.flatnonzero(~covered[1:] & covered[:-1])
                    for a, b in zip(covered_from, covered_to, strict=True):
                        while a < b:  # a run of hit words may go on into the next document
                            d = int(block.document(np.array([a]))[0])
                            stop = min(b, int(starts[d + 1]))
                            hits[d] += [int(a - starts[d]), int(stop - starts[d])]
                            a = stop
                out = [pa.array([batch.column("block")[i].as_py()] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.diff(starts)), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                out = [*(() if only_hits else [get("rows")]), *out]
                made = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, want, strict=True)], schema=want)
                yield made.filter(pa.array([bool(x) for x in items], pa.bool_())) if only_hits else made

    columns = ["block", "doc_starts", "terms", "counts", "positions", *([] if only_hits else ["rows"])]
    if then is None:
        return index.select(*columns).mapInArrow(tidy(match), schema)
    made, result = then  # in the same Python worker: a second mapInArrow would be a second worker for each task

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return made(match(batches))

    return index.select(*columns).mapInArrow(tidy(both), result)


def _verdicts(fields: list[T.StructField], threshold: int) -> tuple[Work, T.StructType]:
    """Makes counts and digest from row, n_words, hits (a list of merged pairs, or of several such lists joined) and
    items; and the schema of the result."""
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])
    want = arrow_schema(schema)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, n_items, digest = [], [], []
            for hits, items in zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True):
                total = upto = 0
                for a, b in sorted(zip(hits[::2], hits[1::2], strict=True)):
                    total += max(0, b - max(a, upto))
                    upto = max(upto, b)
                n_hit.append(total)
                items = sorted(set(items))
                n_items.append(len(items))
                digest.append(hashlib.sha256(",".join(items).encode()).hexdigest())
            hit, words = pa.array(n_hit, pa.int64()), batch.column("n_words")
            bad = pc.and_(pc.greater(hit, 0), pc.greater_equal(pc.multiply(hit, threshold), words))
            out = [*batch.column("row").flatten(), words, hit, pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), bad]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, want, strict=True)], schema=want)

    return judge, schema


def contamination(index: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, threshold: int = 20, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """For each indexed document its columns and n_words, n_hit, n_items (items with a phrase in it), items_sha256
    (of their ids sorted as strings) and contaminated: n_hit > 0 and threshold * n_hit >= n_words."""
    judge, schema = _verdicts(index.schema["rows"].dataType.elementType.fields, threshold)
    size = benchmark.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64)).first()[0] or 0
    n = max(1, -(-size // chunk_bytes))
    if n == 1:
        return search(index, Phrases.of(next(chunks(benchmark, item, text, 1)), window), then=(judge, schema))
    if not hasattr(index, "_staged_at"):
        index = staged(index, "postings", **LARGE_ROWS)  # blocks must bear the same names in every search
    hits = None
    for items in chunks(benchmark, item, text, n):
        part = search(index, Phrases.of(items, window), only_hits=True)
        hits = part if hits is None else hits.unionByName(part)
    # no document has more hits or items than the benchmark gives it: one list for each chunk and document
    hits = hits.groupBy("block", "doc").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
    documents = search(index, Phrases.of([], window)).drop("hits", "items")
    none = lambda c: F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c)
    found = documents.join(hits, ["block", "doc"], "left").select("row", "n_words", none("hits"), none("items"))
    return found.mapInArrow(tidy(judge), schema)


def decontaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", keep_text: bool = False, **how) -> DataFrame:
    """Index df in the shared folder and judge every document."""
    return contamination(staged(build_index(df, text, keep_text), "postings", **LARGE_ROWS), benchmark, **how)
