"""Approximate nearest neighbours by a permutation index.

Pivots are a sample of the vectors, picked by a hash of the id: about 9 * sqrt(n) of n vectors, 256 to ``PIVOTS``
(4096), and never more than a quarter. A vector is represented by its ``nearest`` nearest pivots, nearest first.
Vectors are dealt to blocks by a hash of their id; in a block every pivot has an inverted file: the vectors that have
it, and at which place. The files are made once and stored with the index. A query visits the files of its own nearest
pivots only and adds up the footrule distance (the sum of differences of place, a missing pivot standing at the last
place + 1) of the vectors posted there. Over all blocks about ``rerank`` vectors (or 18 * sqrt(n), if that is more, but
never more than half of the table) that are nearest by footrule are ranked again by the exact measure on the original
vectors, each block taking its share and a quarter more, ``LEAST`` at least, ties included; the blocks' best are merged.
So the index decides at every size. Equal vectors have equal scores, so copies are ranked by id alone.
``exact_nearest`` ranks every vector by the exact measure.

Nearness is the largest inner product in double precision, ties to the smaller id; products beyond its range are
infinite, and one that is no number is ranked last. For pivots, vectors get one more component that brings them to the
largest norm (0 for queries), so near by distance is near by product.

Every valid row is indexed. Rows without id, and vectors that are null, empty, zero or hold null or non-finite
components, take no part; vectors of different length never meet (``LENGTHS`` lengths at most, else ValueError).
Rows that repeat an id are all candidates (but not for their own id); as a query an id counts once, with its smallest
vector. Query blocks meet vector blocks by a join on block numbers, so neither side passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelane.llm.common import staged, tidy

PIVOTS, NEAREST, RERANK, LEAST = 4096, 64, 4096, 64
VECTOR_BLOCK, QUERY_BLOCK, LENGTHS = 16384, 2048, 1024


def valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, vector (doubles) and size of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    ok = F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(key).cast("long").alias("id"), v.alias("vector")).where(ok & F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def permutations(x: np.ndarray, pivots: np.ndarray, largest: float, nearest: int, query: bool) -> np.ndarray:
    """Each row's nearest pivots, nearest first, ties to the earlier pivot."""
    fill = lambda m: np.sqrt(np.maximum(largest**2 - (m * m).sum(1), 0))
    product = x @ pivots.T
    if not query:
        product = product + fill(x)[:, None] * fill(pivots)[None, :]
    # all pivots now have the largest norm, so the nearest has the largest product
    product = -product
    if nearest < product.shape[1]:
        first = np.sort(np.argpartition(product, nearest - 1, axis=1)[:, :nearest], axis=1)
    else:
        first = np.broadcast_to(np.arange(product.shape[1]), product.shape)
    order = np.argsort(np.take_along_axis(product, first, 1), axis=1, kind="stable")
    return np.take_along_axis(first, order, 1).astype(np.int16)


def posted(places: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's inverted files one after another: the vectors that have each pivot, nearest - place for each, and where
    each pivot's file begins."""
    nearest = places.shape[1]
    order = np.argsort(places.ravel(), kind="stable")
    edge = np.searchsorted(places.ravel()[order], np.arange(pivots + 1))
    return (order // nearest).astype(np.int32), (nearest - order % nearest).astype(np.int16), edge.astype(np.int64)


class InvertedFiles:
    """The stored files of a block of n vectors."""

    def __init__(self, who: np.ndarray, weight: np.ndarray, edge: np.ndarray, n: int) -> None:
        self.who, self.weight, self.edge, self.n = who, weight, edge, n
        self.nearest = len(who) // max(n, 1)

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Distances of all vectors to the query's permutation."""
        shared = np.zeros(self.n, np.int32)
        for place, pivot in enumerate(query):
            a, b = self.edge[pivot], self.edge[pivot + 1]
            shared[self.who[a:b]] += np.minimum(self.weight[a:b], self.nearest - place)
        return self.nearest * (self.nearest + 1) - 2 * shared


def n_pivots(n: int, most: int = PIVOTS) -> int:
    """About 9 * sqrt(n), as a power of two, from 256 to most, but no more than a quarter of n."""
    return max(1, min(most, max(256, 1 << int(9 * n**0.5).bit_length()), n // 4))


class Pivots:
    """The pivots of each dimension, how many vectors it has and their largest norm. Two jobs, whatever the number of
    dimensions, which share the pivots that the driver holds."""

    def __init__(self, rows: DataFrame, most: int) -> None:
        square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
        found = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("m")).limit(LENGTHS + 1).collect()
        if len(found) > LENGTHS:
            raise ValueError(f"vectors of more than {LENGTHS} lengths")
        self.counts = {r.dim: r.n for r in found}
        self.norms = {r.dim: float(r.m) ** 0.5 for r in found}
        most = max(most // max(len(found), 1), min(most, 16))
        picked = rows.withColumn("turn", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id"))).where(F.col("turn") <= most).select("dim", "turn", "vector")
        own: dict[int, list] = {}
        for r in picked.toLocalIterator():
            own.setdefault(r.dim, []).append((r.turn, r.vector))
        self.vectors = {dim: np.unique(np.array([v for _, v in sorted(x)[: n_pivots(self.counts[dim], most)]], np.float64), axis=0) for dim, x in own.items()}


def _packed(rows: DataFrame, per_block: int, pivots: Pivots, nearest: int, query: bool) -> DataFrame:
    """Blocks of at most per_block rows of one dimension: block, dim, and as bytes ids and vectors, with a query's
    permutations (places) or the vectors' inverted files (who, weight, edge)."""
    names = ["places"] if query else ["who", "weight", "edge"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, x = (np.concatenate(v) for v in zip(*held.pop(dim), strict=True))
            made += 1
            places = permutations(x, pivots.vectors[dim], pivots.norms[dim], nearest, query)
            last = (places,) if query else posted(places, len(pivots.vectors[dim]))
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made]), pa.array([dim], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (ids, x, *last))], names=["block", "dim", "ids", "vectors", *names])

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                ids, x = own.column("id").to_numpy(), _matrix(own.column("vector"), dim)
                for a in range(0, len(ids), per_block):
                    held.setdefault(dim, []).append((ids[a : a + per_block], x[a : a + per_block]))
                    if sum(len(i) for i, _ in held[dim]) >= per_block:
                        yield flush(dim)
        for dim in list(held):
            yield flush(dim)

    return rows.mapInArrow(tidy(pack), f"block long, dim int, ids binary, vectors binary, {', '.join(f'{n} binary' for n in names)}")


def nearest_vectors(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, pivots: int = PIVOTS, nearest: int = NEAREST, rerank: int | None = RERANK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query row's k nearest other rows. rerank: about how many vectors
    are ranked by the exact measure for each query, None for all."""
    rows = valid(df, key, vector)
    chosen = Pivots(rows, pivots)
    index = staged(_packed(rows.repartition(F.xxhash64("id")), VECTOR_BLOCK, chosen, nearest, False), "permutations")
    asked = valid(df.where(is_query), key, vector).groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
    asked = staged(_packed(asked, QUERY_BLOCK, chosen, nearest, True), "queries")
    asked = asked.select(F.col("block").alias("q_block"), "dim", *(F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "places")))
    pairs = index.select("block", "dim").join(asked.select("q_block", "dim"), "dim").select("block", "q_block")  # numbers only
    grid = pairs.join(asked.drop("dim"), "q_block").join(index, "block")  # queries move, the index is shuffled once
    sizes = {dim: len(v) for dim, v in chosen.vectors.items()}
    shares = {dim: 1.0 if rerank is None else 1.25 * min(max(rerank, 18 * n**0.5) / n, 0.5) for dim, n in chosen.counts.items()}
    return _merged(grid.mapInArrow(tidy(_searcher(sizes, shares, k, nearest)), "query_id long, ids array<long>, scores array<double>"), k)


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, each from its own row alone: equal vectors score equally wherever they stand."""
    return (x * q).sum(1)


def near_best(x: np.ndarray, q: np.ndarray, k: int, largest: float) -> np.ndarray:
    """Places of all rows that can be among the k best by inner. A matrix product finds them; it rounds equal rows
    differently by their place, so what is within twice both roundings of the k-th best stays."""
    if len(x) <= k:
        return np.arange(len(x))
    rough = x @ q
    slack = 4 * len(q) * np.finfo(np.float64).eps * largest * np.sqrt(q @ q)
    return np.flatnonzero(~(rough < np.partition(rough, len(x) - k)[len(x) - k] - slack))


def _searcher(pivots: dict[int, int], shares: dict[int, float], k: int, nearest: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                get = lambda c, t: np.frombuffer(batch.column(c)[i].as_buffer(), t)  # noqa: B023, E731
                ids, x = get("ids", np.int64), get("vectors", np.float64).reshape(-1, dim)
                q_ids, q = get("q_ids", np.int64), get("q_vectors", np.float64).reshape(-1, dim)
                width = min(nearest, pivots[dim])
                files = InvertedFiles(get("who", np.int32), get("weight", np.int16), get("edge", np.int64), len(ids))
                own = get("q_places", np.int16).reshape(-1, width)
                largest = np.sqrt((x * x).sum(1).max())
                most = min(len(ids), max(k + 1, LEAST, int(np.ceil(shares[dim] * len(ids)))))
                out_ids, out_scores = [], []
                for n in range(len(q_ids)):
                    if most < len(ids):
                        away = files.footrule(own[n])
                        at = np.flatnonzero(away <= np.partition(away, most - 1)[most - 1])
                    else:
                        at = np.arange(len(ids))
                    at = at[ids[at] != q_ids[n]]
                    at = at[near_best(x[at], q[n], k, largest)]
                    score = inner(x[at], q[n])
                    best = np.lexsort((ids[at], -score))[:k]
                    out_ids.append(ids[at][best])
                    out_scores.append(score[best])
                yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(out_ids, pa.list_(pa.int64())), pa.array(out_scores, pa.list_(pa.float64()))], names=["query_id", "ids", "scores"])

    return search


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best k of all blocks' best for each query: lists are joined, sorted and cut, at most k from each block."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for q, ids, scores in zip(batch.column("query_id").to_pylist(), batch.column("ids"), batch.column("scores"), strict=True):
                i, s = ids.values.to_numpy(), scores.values.to_numpy()
                if q in best:
                    i, s = np.concatenate([best[q][0], i]), np.concatenate([best[q][1], s])
                top = np.lexsort((i, -s))[:k]
                best[q] = (i[top], s[top])
        for q, (i, s) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), q, np.int64)), pa.array(np.arange(1, len(i) + 1, dtype=np.int32)), pa.array(i), pa.array(s)], names=["query_id", "rank", "vec_id", "score"])

    return found.repartition(F.col("query_id")).mapInArrow(tidy(merge), "query_id long, rank int, vec_id long, score double")


def exact_nearest(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """The same by reranking every vector: for measuring recall."""
    return nearest_vectors(df, is_query, key, vector, k, rerank=None)
