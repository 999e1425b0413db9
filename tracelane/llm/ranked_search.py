"""Ranked lexical search by TPUT (three-phase uniform threshold) over term-partitioned postings.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of the whole text with A-Z lowered. With N
documents that have a term, L terms in all of them, n terms in a document, df documents that hold a term and tf its
occurrences in one: w = floor(1000 * ln((2N + 2) / (2df + 1))), m = 25 + 75 * n * N div L, and the term's impact on the
document is u = 10^9 * tf div (1000 * tf + 8m). A document's score is the sum of w * u over the item's terms, repeats
included; all but w is integer arithmetic.

The index is a table of lists: blocks of documents become postings inside tasks, which are shuffled by term and joined
to long lists there. A term that many documents of a block hold is dealt over several slices, in proportion to the
share of documents that hold it, so that no term is one task's. Lists keep tf and n; impacts follow from N and L.

A search works on one chunk of items at a time (``chunk_bytes`` of text, measured first; the driver holds one chunk):

0. The asked terms' lists are ordered by impact.
1. The first ``heads`` postings of each list give partial sums. The k-th best of an item, a lower bound of its k-th
   score, divided by its lists and taken to ``slack`` percent, is its threshold T for every list.
2. Every list gives the postings of a contribution of T and more, dealt out by document. Partial sums there have an
   upper bound: T - 1 more for each list that gave nothing. Documents seen nowhere have less than the k-th score.
   Those whose upper bound is below the k-th partial sum go.
3. The lists give the exact contributions of the documents left (looked up in groups of about ``lookups``).

A lower slack fetches more postings and leaves fewer documents to look up; no choice of heads, slack or sizes changes
the result. Rows are documents of their own, also where they repeat an id; a null text has no terms; item rows of one id
are one item, null being one id. Of equal scores the smaller doc_id comes first, a null id last. Scores of 0 (a term
that every document holds) don't count. Other columns aren't kept. The table should be a scan or staged, so that a task
that is run again numbers its rows the same.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelane.llm.common import IN_WORD, arrow_schema, by_bytes, flat_text, list_array, split_words, staged, tidy

BLOCK_BYTES, CHUNK_BYTES = 8 << 20, 1 << 20
HEADS, SLACK, LOOKUPS = 100, 50, 1 << 20
#: Postings of one bucket of documents in phase 2, of which there are as many as shuffle partitions at least.
BUCKET = 1 << 19
_ITEM_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass
class Index:
    """lists: term, rows (numbers of documents), tfs, lens; the term '' lists every document and its id."""

    lists: DataFrame
    n_docs: int
    n_terms: int

    def documents(self) -> DataFrame:
        """row, doc_id."""
        found = self.lists.where(F.col("term") == "").select(F.inline(F.arrays_zip("rows", "ids")))
        return found.select(F.col("rows").alias("row"), F.col("ids").alias("doc_id"))


def build_index(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Index:
    df = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    lists = [("rows", T.LongType()), ("tfs", T.IntegerType()), ("lens", T.IntegerType()), ("ids", df.schema["doc_id"].dataType)]
    schema = T.StructType([T.StructField("term", T.StringType(), False), T.StructField("slice", T.IntegerType(), False), *[T.StructField(n, T.ArrayType(t, n == "ids"), False) for n, t in lists]])
    want = arrow_schema(schema)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        done = 0
        for k, table in enumerate(by_bytes(batches, "text", block_bytes)):
            words, starts = split_words(*flat_text(table["text"]), IN_WORD)
            n_docs, n_terms = len(table), max(1, len(words.dictionary))
            lens = np.diff(starts).astype(np.int32)
            term_doc, tf = np.unique(words.indices.to_numpy().astype(np.int64) * n_docs + np.repeat(np.arange(n_docs), lens), return_counts=True)
            term, doc = term_doc // n_docs, term_doc % n_docs
            row = (part << 33) + done + np.arange(n_docs)
            done += n_docs
            df_ = np.bincount(term, minlength=n_terms)[: len(words.dictionary)]
            # a document has some dozens of terms: a list of more than a sixteenth of a partition's share is sliced
            slices = np.maximum(1, df_ * parts // (16 * n_docs))
            at = ((part * 1_000_003 + k) * 2_654_435_761 % (1 << 32)) % slices
            ends = np.concatenate([[0], np.cumsum(df_)])
            none = np.zeros(len(df_) + 1, np.int64)
            columns = [words.dictionary.cast(pa.string()), at, list_array(pa.array(row[doc]), ends), list_array(pa.array(tf), ends), list_array(pa.array(lens[doc]), ends), list_array(table["doc_id"].combine_chunks().slice(0, 0), none)]
            made = [pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(columns, want, strict=True)], schema=want)]
            one = np.array([0, n_docs])
            ids = table["doc_id"].combine_chunks()
            ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
            columns = [pa.array([""]), pa.array([(part * 31 + k) % parts]), list_array(pa.array(row), one), list_array(pa.array(np.zeros(n_docs, np.int32)), one), list_array(pa.array(lens), one), list_array(ids, one)]
            made.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, want, strict=True)], schema=want))
            for batch in made:
                for s in range(0, batch.num_rows, 4096):
                    yield batch.slice(s, 4096)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbours of one term and slice become one list: their values follow each other already."""
        for batch in batches:
            if not batch.num_rows:
                continue
            term = batch.column("term").dictionary_encode().indices.to_numpy().astype(np.int64)
            key = np.column_stack([term, batch.column("slice").to_numpy()])
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
            take = pa.array(first)
            columns = [batch.column("term").take(take), batch.column("slice").take(take)]
            for name, _ in lists:
                column = batch.column(name)
                off = column.offsets.to_numpy()
                columns.append(list_array(column.flatten(), np.append(off[first], off[-1]) - off[0]))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, want, strict=True)], schema=want)

    dealt = df.mapInArrow(tidy(post), schema).repartition("term", "slice").sortWithinPartitions("term", "slice")
    index = staged(dealt.mapInArrow(tidy(joined), schema), "lists")
    lens = index.where(F.col("term") == "").select(F.explode("lens").alias("n"))
    found = lens.agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
    return Index(index, found.n_docs, found.n_terms)


class Items:
    """The items of one chunk and their lists: for each list its item, term and how often the item has the term."""

    def __init__(self, texts: list[tuple[object, str | None]]) -> None:
        found: dict[object, Counter] = {}
        for name, text in texts:
            found.setdefault(name, Counter()).update(_ITEM_TERM.findall((text or "").translate(_LOW)))
        self.ids = list(found)
        self.terms = sorted({t for c in found.values() for t in c})
        number = {t: k for k, t in enumerate(self.terms)}
        flat = [(i, number[t], c) for i, name in enumerate(self.ids) for t, c in found[name].items()]
        self.item, self.term, self.times = (np.array([x[k] for x in flat], np.int64) for k in range(3))

    def weigh(self, df: dict[int, int], n_docs: int) -> None:
        """Keep the lists that have postings and a weight."""
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
        self.weight = self.times * np.array([w.get(t, 0) for t in self.term.tolist()], np.int64)
        keep = self.weight > 0
        self.item, self.term, self.weight = self.item[keep], self.term[keep], self.weight[keep]
        self.lists = np.bincount(self.item, minlength=len(self.ids))

    def limit(self, lower: dict[int, int], slack: int) -> None:
        """Thresholds from the k-th best partial sums: for items, for lists (a least impact) and for terms."""
        self.lower = np.array([lower.get(i, 0) for i in range(len(self.ids))], np.int64)
        self.least = np.maximum(1, -(-self.lower * slack // (100 * np.maximum(1, self.lists))))
        self.cut = -(-self.least[self.item] // self.weight)
        self.term_cut = np.full(len(self.terms), np.iinfo(np.int64).max)
        np.minimum.at(self.term_cut, self.term, self.cut)


def _chunks(items: DataFrame, item: str, text: str, chunk_bytes: int) -> Iterator[Items]:
    items = items.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text"))
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    n = -(-size // chunk_bytes)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        yield Items([(r.item, r.text) for r in part.toLocalIterator()])


def _asked(index: Index, items: Items) -> DataFrame:
    """t (the term's number), rows and impacts of the asked lists, the highest impact first."""
    spark = index.lists.sparkSession
    schema = "t int, rows array<bigint>, impacts array<int>"
    want = arrow_schema(T._parse_datatype_string(schema))
    n_docs, n_terms = index.n_docs, max(1, index.n_terms)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            off = batch.column("rows").offsets.to_numpy().astype(np.int64)
            rows, tf, n = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("rows", "tfs", "lens"))
            impact = 10**9 * tf // (1000 * tf + 8 * (25 + 75 * n * n_docs // n_terms))
            turn = np.lexsort((rows, -impact, np.repeat(np.arange(batch.num_rows), np.diff(off))))
            columns = [batch.column("t"), list_array(pa.array(rows[turn]), off - off[0]), list_array(pa.array(impact[turn]), off - off[0])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, want, strict=True)], schema=want)

    numbers = spark.createDataFrame(list(enumerate(items.terms)), "t int, term string")
    found = index.lists.where(F.col("term") != "").join(F.broadcast(numbers), "term").select("t", "rows", "tfs", "lens")
    return staged(found.mapInArrow(tidy(order), schema), "asked")


def _lower_bounds(asked: DataFrame, items: Items, k: int, heads: int) -> dict[int, int]:
    """Phase 1: the k-th best partial sum of each item that has so many."""
    weights = asked.sparkSession.createDataFrame(list(zip(items.item.tolist(), items.term.tolist(), items.weight.tolist(), strict=True)), "item int, t int, weight bigint")
    first = asked.select("t", F.inline(F.arrays_zip(F.slice("rows", 1, heads).alias("row"), F.slice("impacts", 1, heads).alias("impact"))))
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("impact"), "row"))).where(F.col("place") <= heads)
    sums = first.join(F.broadcast(weights), "t").groupBy("item", "row").agg(F.sum(F.col("weight") * F.col("impact")).alias("partial"))
    return _kth(sums, k)


def _kth(sums: DataFrame, k: int) -> dict[int, int]:
    best = sums.select("item", "partial", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("partial"))).alias("place")).where(F.col("place") <= k)
    return {r.item: r.partial for r in best.where(F.col("place") == k).select("item", "partial").toLocalIterator()}


def _candidates(asked: DataFrame, items: Items, k: int, total: int, bucket: int) -> DataFrame:
    """Phase 2: item, row, partial (sum of what the lists gave) and upper (bound) of documents not ruled out."""
    buckets = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // bucket)
    sent = asked.sparkSession.sparkContext.broadcast(items)
    dealt_schema = "bucket int, t int, rows array<bigint>, impacts array<int>"
    dealt_want = arrow_schema(T._parse_datatype_string(dealt_schema))
    found_schema = "item int, row bigint, partial bigint, upper bigint"
    found_want = arrow_schema(T._parse_datatype_string(found_schema))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            n = np.diff(batch.column("rows").offsets.to_numpy().astype(np.int64))
            rows, impacts = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("rows", "impacts"))
            t = np.repeat(batch.column("t").to_numpy().astype(np.int64), n)
            keep = impacts >= use.term_cut[t]
            rows, impacts, t = rows[keep], impacts[keep], t[keep]
            to = rows % buckets
            turn = np.lexsort((t, to))
            rows, impacts, t, to = rows[turn], impacts[turn], t[turn], to[turn]
            at = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (to[1:] != to[:-1]))) if len(t) else np.zeros(0, np.int64)
            off = np.append(at, len(t))
            columns = [pa.array(to[at]), pa.array(t[at]), list_array(pa.array(rows), off), list_array(pa.array(impacts), off)]
            made = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, dealt_want, strict=True)], schema=dealt_want)
            for s in range(0, made.num_rows, 4096):
                yield made.slice(s, 4096)

    def bound(table: pa.Table) -> pa.Table:
        use = sent.value
        table = table.combine_chunks()
        lists = table["rows"]
        n = np.concatenate([np.diff(c.offsets.to_numpy()) for c in lists.chunks]).astype(np.int64)
        t = np.repeat(table["t"].to_numpy().astype(np.int64), n)
        rows, impacts = (np.concatenate([c.flatten().to_numpy() for c in table[x].chunks]).astype(np.int64) for x in ("rows", "impacts"))
        turn = np.argsort(t, kind="stable")
        t, impacts = t[turn], impacts[turn]
        docs, at = np.unique(rows[turn], return_inverse=True)
        start = np.searchsorted(t, np.arange(len(use.terms) + 1))
        order = np.argsort(use.item, kind="stable")
        edges = np.searchsorted(use.item[order], np.arange(len(use.ids) + 1))
        out: list[list[np.ndarray]] = [[], [], [], []]
        for i in range(len(use.ids)):
            partial, seen = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            for x in order[edges[i] : edges[i + 1]]:
                a, b = start[use.term[x]], start[use.term[x] + 1]
                if a < b:
                    keep = impacts[a:b] >= use.cut[x]
                    where = at[a:b][keep]  # a list has a document once
                    partial[where] += use.weight[x] * impacts[a:b][keep]
                    seen[where] += 1
            upper = partial + (use.lists[i] - seen) * (use.least[i] - 1)
            best = np.partition(partial, -k)[-k] if len(docs) >= k else 0
            left = np.flatnonzero((seen > 0) & (upper >= max(best, use.lower[i])))
            for o, v in zip(out, (np.full(len(left), i), docs[left], partial[left], upper[left]), strict=True):
                o.append(v)
        return pa.table([pa.array(np.concatenate(o)) for o in out], names=found_want.names).cast(found_want)

    dealt = asked.mapInArrow(tidy(fetch), dealt_schema)
    return staged(dealt.groupBy("bucket").applyInArrow(bound, found_schema), "candidates")


def _exact(asked: DataFrame, items: Items, left: DataFrame, n_left: int, lookups: int) -> DataFrame:
    """Phase 3: item, row and score of the documents left, looked up in the lists."""
    schema = "item int, row bigint, score bigint"
    want = arrow_schema(T._parse_datatype_string(schema))
    spark = asked.sparkSession
    groups = max(1, -(-n_left // lookups))
    out = None
    for g in range(groups):
        part = left if groups == 1 else left.where(F.pmod(F.xxhash64("item", "row"), F.lit(groups)) == g)
        table = part.select("item", "row").orderBy("item", "row").toArrow()
        sent = spark.sparkContext.broadcast((items, table["item"].to_numpy().astype(np.int64), table["row"].to_numpy()))

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            use, item, row = sent.value
            edges = np.searchsorted(item, np.arange(len(use.ids) + 1))
            order = np.argsort(use.term, kind="stable")
            lists = np.searchsorted(use.term[order], np.arange(len(use.terms) + 1))
            for batch in batches:
                found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
                for t, values, impacts in zip(batch.column("t").to_pylist(), batch.column("rows"), batch.column("impacts"), strict=True):
                    held, impact = values.values.to_numpy(), impacts.values.to_numpy().astype(np.int64)
                    turn = np.argsort(held)
                    held, impact = held[turn], impact[turn]
                    for x in order[lists[t] : lists[t + 1]]:
                        i = use.item[x]
                        ask = row[edges[i] : edges[i + 1]]
                        at = np.minimum(np.searchsorted(held, ask), len(held) - 1)
                        hit = held[at] == ask
                        for f, v in zip(found, (np.full(hit.sum(), i), ask[hit], use.weight[x] * impact[at[hit]]), strict=True):
                            f.append(v)
                i, r, s = (np.concatenate(f) for f in found)
                turn = np.lexsort((r, i))
                i, r, s = i[turn], r[turn], s[turn]
                first = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (r[1:] != r[:-1]))) if len(i) else np.zeros(0, np.int64)
                columns = [i[first], r[first], np.add.reduceat(s, first) if len(first) else s]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, want, strict=True)], schema=want)

        found = asked.mapInArrow(tidy(look), schema).groupBy("item", "row").agg(F.sum("score").alias("score"))
        out = found if out is None else out.unionByName(found)
    return out


def search(index: Index, items: DataFrame, item: str = "item_id", text: str = "text", k: int = 10, heads: int = HEADS, slack: int = SLACK, chunk_bytes: int = CHUNK_BYTES, bucket: int = BUCKET, lookups: int = LOOKUPS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each item, all with a score above 0."""
    spark = index.lists.sparkSession
    id_type = items.select(F.col(item).alias("item_id")).schema["item_id"]
    out = None
    for chunk in _chunks(items, item, text, chunk_bytes):
        asked = _asked(index, chunk)
        df = {r.t: r.df for r in asked.groupBy("t").agg(F.sum(F.size("rows")).alias("df")).toLocalIterator()}
        chunk.weigh(df, index.n_docs)
        if not len(chunk.item):
            continue
        chunk.limit(_lower_bounds(asked, chunk, k, heads), slack)
        seen = _candidates(asked, chunk, k, sum(df.values()), bucket)
        bounds = _kth(seen, k)
        known = spark.createDataFrame([(i, bounds.get(i, 0)) for i in range(len(chunk.ids))], "item int, bound bigint")
        left = seen.join(F.broadcast(known), "item").where(F.col("upper") >= F.col("bound")).select("item", "row")
        n_left = left.count()
        exact = staged(_exact(asked, chunk, left, n_left, lookups), "exact")
        named = index.documents().join(F.broadcast(exact) if n_left <= lookups else exact, "row")
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
        ranked = named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(chunk.ids)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", id_type.dataType)]))
        part = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        schema = T.StructType([T.StructField("item_id", id_type.dataType), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", index.lists.schema["ids"].dataType.elementType), T.StructField("score", T.LongType())])
        out = spark.createDataFrame([], schema)
    return out


def ranked(df: DataFrame, items: DataFrame, **how) -> DataFrame:
    """Index df in the shared folder and search it for every item."""
    return search(build_index(df), items, **how)
