"""Divergence between the sources of a language, from a term index with corrections to a baseline.

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of the whole text with A-Z lowered. A language keeps the V terms that at
least ``min_docs`` of its documents hold; a group is a (lang, source), with or without terms. A group's share of a kept
term with count occurrences is p = 1 + floor(10^9 * (count + 1) / (N + V)), N its occurrences of all kept terms. The
divergence of two shares is f(p, q) = floor((p - q) * (p - q) / q), of two groups its sum over all kept terms.

Most terms are missing from most groups, so a pair of groups starts at V times f of the shares of a zero count, and the
index corrects that. A term of one group alone changes f by what depends on its count and the other group only: such
corrections are made once for each (group, count) with the number of terms that have it. What is left over, terms that
both groups hold, comes from their postings, which meet by (lang, term); no other pair of term and groups is ever formed.
All numbers are integers, so the sum equals the one over all terms.

Null text, lang and source count as ''. Rows are documents of their own, also where they repeat. Languages without
kept terms give pairs of value 0. An empty table gives no rows. Columns other than text, lang and source aren't read.

Blocks of text become counts inside tasks; these are summed up to ``held_rows`` rows before they are shuffled by
(lang, term). A frequent term has one row for each source there, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelane.llm.common import IN_TERM, arrow_schema, by_bytes, discard, empty_if_null, flat_text, split_words, staged, tidy

BLOCK_BYTES, HELD_ROWS = 8 << 20, 1 << 20
SCALE = 10**9
COUNTS = "lang string, source string, term string, count bigint, docs bigint"


def _block_counts(table: pa.Table, text: str) -> pa.Table:
    """Counts of one block; the term '' has a group's number of documents."""
    pairs = pa.StructArray.from_arrays([table["lang"].combine_chunks(), table["source"].combine_chunks()], ["lang", "source"])
    names = pa.Table.from_arrays([table["lang"], table["source"]], ["lang", "source"]).group_by(["lang", "source"]).aggregate([])
    known = {(a, b): k for k, (a, b) in enumerate(zip(names["lang"].to_pylist(), names["source"].to_pylist(), strict=True))}
    group = np.array([known[x["lang"], x["source"]] for x in pairs.to_pylist()], np.int64)
    words, starts = split_words(*flat_text(table[text]), IN_TERM)
    n_terms = len(words.dictionary)
    doc = np.repeat(np.arange(len(group)), np.diff(starts))
    held, times = np.unique(doc * max(n_terms, 1) + words.indices.to_numpy(), return_counts=True)
    key = group[held // max(n_terms, 1)] * max(n_terms, 1) + held % max(n_terms, 1)
    order = np.argsort(key, kind="stable")
    at = np.flatnonzero(np.diff(key[order], prepend=-1))
    count = np.add.reduceat(times[order], at) if len(at) else np.zeros(0, np.int64)
    docs = np.diff(np.append(at, len(key)))
    key = key[order][at]
    of, term = key // max(n_terms, 1), key % max(n_terms, 1)
    everyone = np.bincount(group, minlength=len(known))
    of = pa.array(np.append(of, np.arange(len(known))))
    terms = pa.concat_arrays([words.dictionary.cast(pa.string()).take(pa.array(term)), pa.array([""] * len(known), pa.string())])
    numbers = [np.append(count, np.zeros(len(known), np.int64)), np.append(docs, everyone)]
    return pa.table({"lang": names["lang"].combine_chunks().take(of), "source": names["source"].combine_chunks().take(of), "term": terms, "count": numbers[0].astype(np.int64), "docs": numbers[1].astype(np.int64)})


def term_counts(df: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES, held_rows: int = HELD_ROWS) -> DataFrame:
    """(lang, source, term, count, docs) of blocks of documents, to be summed; term '': all documents of the group."""
    schema = T._parse_datatype_string(COUNTS)
    want = arrow_schema(schema)

    def summed(parts: list[pa.Table]) -> pa.Table:
        all_ = pa.concat_tables(parts)
        if len(parts) == 1:
            return all_
        out = all_.group_by(["lang", "source", "term"]).aggregate([("count", "sum"), ("docs", "sum")])
        return out.select(["lang", "source", "term", "count_sum", "docs_sum"]).rename_columns(want.names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for table in by_bytes(batches, text, block_bytes):
            held.append(_block_counts(table, text))
            if sum(map(len, held)) > held_rows:
                held = [summed(held)]
                if len(held[0]) > held_rows // 2:  # little left to sum
                    yield from held.pop().cast(want).to_batches(max_chunksize=65536)
        if held:
            yield from summed(held).cast(want).to_batches(max_chunksize=65536)

    cut = df.select(*[empty_if_null(F.col(c).cast("string")).alias(c) for c in ("lang", "source")], F.col(text).cast("string").alias(text))
    return cut.mapInArrow(tidy(count), schema)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), by decimals, so that no count is too large."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", top, (total + terms).cast("decimal(20,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


class TermIndex:
    """The kept terms of each language and how often each group has them, as staged tables.

    postings: lang, term, source, count and p, p0 (the group's share of the term and of a zero count) and all (the
    language's share of the term). groups: lang, source, terms (V) and p0 (null without kept terms)."""

    def __init__(self, df: DataFrame, text: str = "text", min_docs: int = 3, **how) -> None:
        term = Window.partitionBy("lang", "term")
        counts = term_counts(df, text, **how).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
        counts = counts.withColumns({"held_by": F.sum("docs").over(term), "all_count": F.sum("count").over(term), "lead": F.row_number().over(term.orderBy("source"))})
        kept = staged(counts.where((F.col("term") == "") | (F.col("held_by") >= min_docs)).select("lang", "term", "source", "count", "all_count", (F.col("lead") == 1).alias("lead")), "kept")
        terms = kept.where(F.col("term") != "")
        sizes = terms.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.sum(F.col("lead").cast("long")).alias("terms"))
        named = kept.where(F.col("term") == "").select("lang", "source").join(sizes, ["lang", "source"], "left")
        lang = Window.partitionBy("lang")
        named = named.withColumns({"total": F.coalesce("total", F.lit(0)), "terms": F.coalesce(F.sum("terms").over(lang), F.lit(0)), "all_total": F.coalesce(F.sum("total").over(lang), F.lit(0))})
        p0 = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))
        self.groups = staged(named.withColumn("p0", p0), "groups")
        shares = {"p": share(F.col("count"), F.col("total"), F.col("terms")), "all": share(F.col("all_count"), F.col("all_total"), F.col("terms"))}
        self.postings = staged(terms.join(self.groups, ["lang", "source"]).withColumns(shares).select("lang", "term", "source", "count", "p", "p0", "all"), "shares")
        discard(kept)

    def pairs(self) -> DataFrame:
        """lang, source, item (each other source of the language) and value, the divergence of the two."""
        f = divergence
        p, p0, q, q0 = (F.col(c) for c in ("p", "p0", "q", "q0"))
        one = self.groups.select("lang", "source", "terms", "p0")
        other = self.groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
        both = one.join(other, "lang").where(F.col("source") != F.col("item"))
        key = ["lang", "source", "item"]
        zero = both.select(*key, F.coalesce(F.col("terms") * f(p0, q0), F.lit(0)).alias("value"))
        times = self.postings.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
        mine = times.join(other, "lang").where(F.col("source") != F.col("item")).select(*key, (F.col("n") * (f(p, q0) - f(p0, q0))).alias("value"))
        theirs = times.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"), "n").join(one, "lang").where(F.col("source") != F.col("item"))
        theirs = theirs.select(*key, (F.col("n") * (f(p0, q) - f(p0, q0))).alias("value"))
        left = self.postings.select("lang", "term", "source", "p", "p0")
        right = self.postings.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
        shared = left.join(right, ["lang", "term"]).where(F.col("source") != F.col("item"))
        shared = shared.select(*key, (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)).alias("value"))
        parts = [x.groupBy(*key).agg(F.sum("value").alias("value")) for x in (mine, theirs, shared)]
        return zero.unionByName(parts[0]).unionByName(parts[1]).unionByName(parts[2]).groupBy(*key).agg(F.sum("value").alias("value"))

    def terms(self, most: int = 200) -> DataFrame:
        """lang, source, item (terms that the group has more of than its language), value and rank up to most."""
        found = self.postings.where(F.col("p") > F.col("all")).select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("all")).alias("value"))
        return _ranked(found).where(F.col("rank") <= most)


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(df: DataFrame, text: str = "text", most: int = 200, min_docs: int = 3, **how) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank (by value, then item) of every group."""
    index = TermIndex(df, text, min_docs, **how)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pair = _ranked(index.pairs()).withColumn("part", F.lit("pair")).select(*columns)
    return pair.unionByName(index.terms(most).withColumn("part", F.lit("term")).select(*columns))
