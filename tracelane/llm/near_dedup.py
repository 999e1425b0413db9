"""Near-duplicate detection by order MinHash.

Words are split as in ``common.split_words``; the k-mers are runs of five words, each labelled with how often it
occurred before in its text. For each of ``sketches`` hash functions the ``least`` labelled k-mers of smallest
hash are sampled and put back into the order of the text: two texts agree in a sketch only if they share these
k-mers in the same order, so agreement follows edit similarity, not just overlap.

Texts that agree in a sketch are candidates, verified by banded alignment: with m the most k-mers that can be
aligned in order, the similarity is m / (n1 + n2 - m), and 0.8 or more is a link. The band is the number of
unaligned k-mers that such a similarity allows, so the band never changes a verdict.

Pairs are never formed within a whole group (the texts that share one sketch). First every text is compared with
its group's smallest id only; links give components, and a group whose texts are all in one component is done. In
the other groups the k-mers that only one of their texts has are counted: they can't be aligned to anything, so
they bound a text's similarity to every other. Then every text outside the component of the group's most typical
text (the one with the smallest share of such k-mers) is compared with that text, and at last with all texts of
other components that sizes and bounds allow, whatever their number, in cells of bounded size. Every pair left out is in one component
already or provably below the threshold, so the classes equal those of comparing all pairs of every group.

Texts with equal words are copies: they are one text from the start. A text without words (null or empty too)
is its own class. A text of fewer than five words has one k-mer: the whole of it. Ids are the class labels: rows
that repeat an id are one document, and count once; of unequal texts under one id the one with the smallest
digest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelane.llm.common import by_bytes, flat_text, free_name, mix, scratch, split_words, staged, tidy
from tracelane.llm.components import components

WORDS, SIMILAR = 5, 0.8
SKETCHES, LEAST = 20, 4
BATCH_BYTES = 1 << 20


def _order(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.lexsort((values, keys))


def kmers(raw: np.ndarray, off: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and their offsets, k-mer hashes and their offsets, of all texts."""
    words, starts = split_words(raw, off)
    kinds = np.array([xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)
    word = kinds[words.indices.to_numpy()] if len(kinds) else np.zeros(0, np.uint64)
    n_words = np.diff(starts)
    n = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(starts[:-1] - at[:-1], n) + np.arange(at[-1])
    stop = np.repeat(starts[1:], n)
    out = np.zeros(len(first), np.uint64)
    padded = np.append(word, np.zeros(k, np.uint64))
    for j in range(k):
        step = np.where(first + j < stop, padded[first + j], np.uint64(0))
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + step + np.uint64(j + 1))
    return word, starts, out, at


def labelled(kmer: np.ndarray, at: np.ndarray) -> np.ndarray:
    """k-mers joined with the number of their earlier occurrences in the text."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.argsort(mix(kmer + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), kind="stable")
    same = np.zeros(len(kmer), bool)
    same[1:] = (kmer[order][1:] == kmer[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    begin = np.flatnonzero(~same)
    seen = np.arange(len(kmer)) - np.repeat(begin, np.diff(np.append(begin, len(kmer))))
    out = np.empty_like(kmer)
    out[order] = kmer[order] + seen.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return mix(out)


def order_sketches(items: np.ndarray, sketches: int = SKETCHES, least: int = LEAST) -> np.ndarray:
    """For each hash function one value: the least items of smallest hash, in the order of the text."""
    salts = mix(np.arange(1, sketches + 1, dtype=np.uint64))[:, None]
    hashed = (items[None, :] ^ salts) * np.uint64(0xFF51AFD7ED558CCD)
    hashed ^= hashed >> np.uint64(32)
    if len(items) > least:
        where = np.sort(np.argpartition(hashed, least - 1, axis=1)[:, :least], axis=1)
    else:
        where = np.broadcast_to(np.arange(len(items)), (sketches, len(items)))
    out = salts[:, 0].copy()
    for j in range(where.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + items[where[:, j]])
    return out


def digests(word: np.ndarray, starts: np.ndarray) -> list[bytes | None]:
    """Of each text a digest of its words in order, null without words."""
    return [xxhash.xxh3_128_digest(word[a:b].tobytes()) if b > a else None for a, b in zip(starts[:-1], starts[1:], strict=True)]


def signatures(df: DataFrame, key: str, text: str, words: int = WORDS, sketches: int = SKETCHES, least: int = LEAST) -> DataFrame:
    """id, digest (of the words in order), n (k-mers), kmers (four bytes each) and sketches of every row."""
    kind = df.schema[key].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_bytes(batches, "text", BATCH_BYTES):
            word, starts, kmer, at = kmers(*flat_text(table["text"]), k=words)
            items, short = labelled(kmer, at), kmer.astype(np.uint32)
            blob, sketch = [], []
            for i in range(table.num_rows):
                a, b = at[i], at[i + 1]
                blob.append(short[a:b].tobytes())
                sketch.append(order_sketches(items[a:b], sketches, least).view(np.int64) if b > a else [])
            yield pa.RecordBatch.from_arrays([table["id"].combine_chunks(), pa.array(digests(word, starts), pa.binary()), pa.array(np.diff(at)), pa.array(blob, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))], names=["id", "digest", "n", "kmers", "sketches"])

    return df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(sign), f"id {kind}, digest binary, n long, kmers binary, sketches array<long>")


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The most elements of a and b that can be paired in order, pairs being at most band places apart.

    Equal ends are paired at once. The rest is the bit-parallel recurrence for common subsequences, one row of
    the alignment matrix at a time as one integer, with matches outside the band masked.
    """
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[len(a) - n + head :][::-1] != b[len(b) - n + head :][::-1])
    tail = int(differ[0]) if len(differ) else n - head
    x, y = a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist()
    if not x or not y:
        return head + tail
    places: dict[int, int] = {}
    for i, v in enumerate(x):
        places[v] = places.get(v, 0) | 1 << i
    full = (1 << len(x)) - 1
    window = (1 << (2 * band + 1)) - 1
    row = full
    for j, v in enumerate(y):
        match = places.get(v, 0)
        if match:
            match &= window << (j - band) if j >= band else window >> (band - j)
            hit = row & match
            row = ((row + hit) | (row - hit)) & full
    return head + tail + len(x) - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """Aligned k-mers over all k-mers; exact where it is least or more."""
    total = len(a) + len(b)
    m = aligned(a, b, int(total * (1 - least) / (1 + least)) + 1)
    return m / (total - m) if total else 0.0


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that are similar. texts: rep and kmers of each text."""
    left = texts.select(F.col("rep").alias("a"), F.col("kmers").alias("x")).hint("merge")
    right = texts.select(F.col("rep").alias("b"), F.col("kmers").alias("y")).hint("merge")
    both = pairs.join(right, "b").join(left, "a")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similarity(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32), least) >= least for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(tidy(verify), pairs.select("a", "b").schema)


def _alone(body: DataFrame) -> DataFrame:
    """(rep, alone): how many k-mers of each text no other of these texts has."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(np.frombuffer(x.as_buffer(), np.uint32), return_counts=True) for x in batch.column("kmers")]
            if own:
                rep = batch.column("rep").take(pa.array(np.repeat(np.arange(len(own)), [len(k) for k, _ in own])))
                yield pa.RecordBatch.from_arrays([rep, pa.array(np.concatenate([k for k, _ in own]).astype(np.int64)), pa.array(np.concatenate([c for _, c in own]))], names=["rep", "kmer", "times"])

    kind = body.schema["rep"].dataType.simpleString()
    seen = body.mapInArrow(tidy(numbers), f"rep {kind}, kmer long, times long")
    single = seen.groupBy("kmer").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"), F.max("times").alias("times")).where(F.col("rep") == F.col("other"))
    return single.groupBy("rep").agg(F.sum("times").alias("alone"))


CELL = 512


def _rest(members: DataFrame, group: list[str], least: float) -> DataFrame:
    """Links between texts of different components of a group, at least one being outside the group's main one.

    Groups are cut into cells of about CELL texts on each side, so none has to fit into a task. A pair that shares
    several sketches is looked at in the first of their groups only. What can't reach the threshold by size, by
    k-mers that no other text has, or by k-mers in common, is not aligned; nothing but links leaves a cell.
    """
    sizes = members.groupBy(*group).agg(F.count("*").alias("all"), F.count_if(F.col("part") != F.col("centre")).alias("outside"))
    members = members.join(sizes, group).withColumns({"m_cells": F.ceil(F.col("all") / CELL).cast("int"), "o_cells": F.ceil(F.col("outside") / CELL).cast("int")})
    columns = [*group, "rep", "n", "part", "fits", "sketches", "kmers"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    outside = members.where(F.col("part") != F.col("centre")).withColumn("o", own("o_cells")).withColumn("m", every("m_cells")).select(*(F.col(c).alias(c) for c in (*columns, "o", "m")))
    inside = members.where("o_cells > 0").withColumn("m", own("m_cells")).withColumn("o", every("o_cells")).select(*(F.col(c).alias(c) for c in (*columns, "o", "m")))
    keys = [*group, "o", "m"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if left.num_rows and right.num_rows:
            no = left["no"][0].as_py()
            get = lambda t, c: t[c].to_numpy()
            sketches = [np.array(t["sketches"].to_pylist(), np.int64) for t in (left, right)]
            kmer = [[np.frombuffer(x.as_buffer(), np.uint32) for x in t["kmers"]] for t in (left, right)]
            reps, n, part, fits = get(right, "rep"), get(right, "n"), get(right, "part"), get(right, "fits")
            flat = np.concatenate(kmer[1])
            edge = np.concatenate([[0], np.cumsum([len(x) for x in kmer[1]])[:-1]])
            for i, (rep, n_i, part_i, fits_i) in enumerate(zip(*(get(left, c) for c in ("rep", "n", "part", "fits")), strict=True)):
                m = np.minimum(fits, fits_i)
                look = (part != part_i) & (m >= (least - 1e-9) * (n + n_i - m)) & (np.argmax(sketches[1] == sketches[0][i], axis=1) == no)
                if not look.any():
                    continue
                known = np.unique(kmer[0][i])
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                m = np.minimum(m, np.add.reduceat((known[at] == flat).astype(np.int64), edge))
                for j in np.flatnonzero(look & (m >= (least - 1e-9) * (n + n_i - m))):
                    if similarity(kmer[0][i], kmer[1][j], least) >= least:
                        out_a.append(min(rep, reps[j]))
                        out_b.append(max(rep, reps[j]))
        kind = left.schema.field("rep").type
        return pa.table({"a": pa.array(out_a, kind), "b": pa.array(out_b, kind)})

    kind = members.schema["rep"].dataType.simpleString()
    return outside.groupBy(*keys).cogroup(inside.groupBy(*keys)).applyInArrow(compare, f"a {kind}, b {kind}")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR, words: int = WORDS, sketches: int = SKETCHES, least: int = LEAST) -> DataFrame:
    """id and class_id (the smallest id of its class) of each id that isn't null."""
    with scratch() as keep:
        signed = staged(signatures(df.where(F.col(key).isNotNull()), key, text, words, sketches, least), "signatures")
        # nulls come first in Spark's order, so an id's row without words would win over others: they come last here
        one = F.min(F.struct(F.col("digest").isNull().alias("empty"), F.col("digest").alias("digest")))
        documents = staged(signed.groupBy("id").agg(one.alias("x")).select("id", F.col("x.digest").alias("digest")), "ids")
        # sides that grow with the input are never broadcast, so a plan is the same at every size: hence the hints
        copies = documents.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("rep"))
        chosen = copies.select(F.col("rep").alias("id"), F.col("digest").alias("own"))
        of_rep = lambda *columns: signed.join(chosen.hint("merge"), "id").where(F.col("digest") == F.col("own")).select(F.col("id").alias("rep"), *columns)

        texts = of_rep("n", "sketches").dropDuplicates(["rep"])
        texts = staged(texts.select("rep", "n", F.posexplode("sketches").alias("no", "sketch")), "sketches")
        group = ["no", "sketch"]
        groups = staged(texts.groupBy(*group).agg(F.min("rep").alias("first"), F.count("*").alias("size")).where(F.col("size") > 1), "sizes")  # apart, as below
        member = staged(texts.join(groups.hint("merge"), group).select(*group, "rep", "n", "first"), "groups")
        grouped = member.select(F.col("rep").alias("id")).distinct()
        body = staged(signed.select("id", "digest", "kmers").join(grouped.hint("merge"), "id", "left_semi").join(chosen.hint("merge"), "id").where(F.col("digest") == F.col("own")).groupBy(F.col("id").alias("rep")).agg(F.first("kmers").alias("kmers")), "kmers")

        fitting = lambda a, b: F.least(a, b) >= F.lit(similar) * F.greatest(a, b)
        size_of = member.where(F.col("rep") == F.col("first")).select(*group, F.col("n").alias("m"))
        pairs = member.where(F.col("rep") != F.col("first")).join(size_of, group).where(fitting(F.col("n"), F.col("m"))).select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
        links = staged(_verified(pairs, body, similar), "links")

        def parted(links: DataFrame) -> DataFrame:
            """The groups that hold texts of different components, with each text's component."""
            out = member.join(components(links).withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep"))
            open_ = out.groupBy(*group).agg(F.min("part").alias("p"), F.max("part").alias("q")).where(F.col("p") != F.col("q")).select(*group)
            return staged(out.join(open_, group).select(*group, "rep", "n", "first", "part"), "open")

        rest = parted(links)
        alone = staged(_alone(body.join(rest.select("rep").distinct(), "rep", "left_semi")), "alone")
        bounded = lambda df: df.join(alone, "rep", "left").withColumn("fits", F.col("n") - F.coalesce("alone", F.lit(0)))
        # m is at most what fits of either text; m / (n1 + n2 - m) grows with m
        most = lambda x, y: F.least(F.col(f"{x}.fits"), F.col(f"{y}.fits"))
        possible = lambda x, y: fitting(F.col(f"{x}.n"), F.col(f"{y}.n")) & (most(x, y) >= F.lit(similar - 1e-9) * (F.col(f"{x}.n") + F.col(f"{y}.n") - most(x, y)))
        same_group = lambda x, y: (F.col(f"{x}.no") == F.col(f"{y}.no")) & (F.col(f"{x}.sketch") == F.col(f"{y}.sketch"))
        ordered = [F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")]

        typical = lambda df: df.groupBy(*group).agg(F.min_by(F.struct("rep", "n", "fits", "part"), F.struct(F.col("fits") / F.col("n") * -1, "rep")).alias("t")).select(*group, "t.*")
        able = bounded(rest).where(F.col("fits") >= F.lit(similar - 1e-9) * F.col("n"))  # others can't be similar to any text
        more = able.alias("x").join(typical(able).alias("y"), same_group("x", "y") & (F.col("x.part") != F.col("y.part")) & possible("x", "y")).select(*ordered).distinct()
        links = staged(links.unionByName(_verified(more, body, similar)).distinct(), "links")
        able = bounded(parted(links)).where(F.col("fits") >= F.lit(similar - 1e-9) * F.col("n"))
        centre = typical(able).select(*group, F.col("part").alias("centre"))
        whole = texts.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("no", "sketch"))).getField("sketch").alias("sketches"))  # one entry for each hash function
        members = staged(able.join(centre, group).join(whole, "rep").join(body, "rep"), "members")
        links = staged(links.unionByName(_rest(members, group, similar)).distinct(), "links")
        found = components(links)

        reps = copies.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("class_id"))
        classed = keep(staged(documents.join(reps, "digest", "left").select("id", F.coalesce("class_id", "id").alias("class_id")), "classes"))
    return classed


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row for each id: the id, class_id (the smallest id of its class), class_size and kept (id = class_id).
    Rows whose id is null are left out."""
    classed = classes(df, key, text, **how)
    sizes = staged(classed.groupBy("class_id").agg(F.count("*").alias("class_size")), "sizes")  # apart, so that the join can be split where a class is large
    return classed.join(sizes.hint("merge"), "class_id").select(F.col("id").alias(key), "class_id", "class_size", (F.col("id") == F.col("class_id")).alias("kept"))


def one_of_each_id(df: DataFrame, key: str, text: str) -> DataFrame:
    """Of each id the row whose text near_duplicates judges it by; of several such rows the first by text, then by all columns."""
    name, whole = free_name(df, "digest_"), T.StructType(df.schema.fields)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_bytes(batches, text, BATCH_BYTES):
            word, starts, _, _ = kmers(*flat_text(table[text]))
            yield from table.append_column(name, pa.array(digests(word, starts), pa.binary())).to_batches()

    signed = df.mapInArrow(tidy(sign), T.StructType([*whole.fields, T.StructField(name, T.BinaryType())]))
    row = F.struct(*(F.col(f"`{f.name}`") for f in whole.fields))
    order = F.struct(F.col(name).isNull().alias("empty"), F.col(name).alias("digest"), F.col(text).alias("text"), F.to_json(row).alias("row"))
    return signed.groupBy(key).agg(F.min_by(row, order).alias(name)).select(f"{name}.*")


def first_of_each_class(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """df without the rows of documents that are not the first of their class, and of each repeated id the row whose
    text its class was decided by."""
    name = free_name(df, "drop_")
    drop = classes(df, key, text, **how).where(F.col("id") != F.col("class_id")).select(F.col("id").alias(name))
    left = df.join(drop, F.col(key) == F.col(name), "left_anti")
    known = left.where(F.col(key).isNotNull())
    repeated = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(name)).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(name).hint("merge")
    once = known.join(repeated, F.col(key) == F.col(name), "left_anti")
    several = known.join(repeated, F.col(key) == F.col(name), "left_semi")
    return once.unionByName(one_of_each_id(several, key, text)).unionByName(left.where(F.col(key).isNull()))
