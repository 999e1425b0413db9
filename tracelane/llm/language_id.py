"""Language ID by rank-order profiles.

A language's profile is the ranked list of its most frequent n-grams of 1 to 3 letters, counted over all
training rows. A document's own most frequent n-grams are ranked likewise and each language gets the
out-of-place distance: the sum of the differences of rank, with the profile's length for an n-gram that the
profile lacks. The nearest language wins, ties to the first in order.

Letters are lowered and every other character is a word edge, so n-grams never cross words; an edge counts as
a letter of bigrams and trigrams. A document that is null or has no letter gets ``und`` with score 0. Training
rows with null language, null text or no letter teach nothing; with no training row left every document gets
``und``. Of equally frequent n-grams those of three come first, from the highest code points down, then single
letters, then those of two, both from the lowest up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelane.llm.common import by_bytes, flat_text, renamed_clashes, tidy

PROFILE, ORDERS = 400, 3
BATCH_BYTES = 1 << 20
_SHIFT = np.int64(21)  # bits of a code point


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lowered letter, or 0 where it is none; a letter whose lower case is longer keeps itself."""
    table = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _points(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts and their offsets in points."""
    lead = (raw & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    return np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32), before[off]


def grams(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """For each text the packed n-grams of all its words, one value for each occurrence.

    Words are runs of letters with one edge (0) on each side. A packed n-gram holds its letters from the left,
    shifted by 21 bits each, so three fit into 63 bits; edges alone are left out.
    """
    points, at = _points(raw, off)
    table = _letters()
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        x = np.zeros(b - a + 2, np.int64)
        x[1:-1] = table[points[a:b]]
        x = x[np.concatenate([[True], (x[1:] > 0) | (x[:-1] > 0)])]  # one edge between words
        one = x[x > 0]
        two = (x[:-1] << _SHIFT) | x[1:]
        three = (x[:-2] << (2 * _SHIFT)) | (x[1:-1] << _SHIFT) | x[2:]
        out.append(np.concatenate([one, two[(x[:-1] > 0) | (x[1:] > 0)] + (np.int64(1) << 62), -three[x[1:-1] > 0]]) if len(one) else one)
    return out


def ranked(values: np.ndarray, most: int) -> np.ndarray:
    """The most frequent values, most frequent first, ties by value."""
    values = np.sort(values)
    edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    count = np.diff(np.append(edge, len(values)))
    kinds = values[edge]
    if len(kinds) > most:
        least = np.partition(count, len(count) - most)[len(count) - most]
        keep = count >= least
        kinds, count = kinds[keep], count[keep]
    return kinds[np.lexsort((kinds, -count))][:most]


def learn_profiles(df: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """Ranked n-grams of each language over all rows; what reaches the driver is languages x size numbers.

    Each task adds up its own n-grams first; the most frequent are picked within slices of the n-grams before
    they meet by language.
    """
    schema = "lang string, gram long, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def fold(of: str) -> None:
            values, n = np.concatenate([v for v, _ in held[of]]), np.concatenate([c for _, c in held[of]])
            kinds, where = np.unique(values, return_inverse=True)
            held[of] = [(kinds, np.bincount(where, n, len(kinds)).astype(np.int64))]

        for table in by_bytes(batches, text, BATCH_BYTES):
            langs = np.array(table[lang].to_pylist(), object)
            per_text = grams(*flat_text(table[text]))
            for of in set(langs):
                kinds, n = np.unique(np.concatenate([per_text[i] for i in np.flatnonzero(langs == of)]), return_counts=True)
                held.setdefault(of, []).append((kinds, n))
                if len(held[of]) >= 16:
                    fold(of)
        for of in held:
            fold(of)
            kinds, n = held[of][0]
            if len(kinds):
                yield pa.RecordBatch.from_arrays([pa.array([of] * len(kinds)), pa.array(kinds), pa.array(n)], names=["lang", "gram", "n"])

    known = df.select(F.col(text).alias(text), F.col(lang).cast("string").alias(lang)).where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sums = known.mapInArrow(tidy(count), schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    sliced = sums.withColumn("r", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(*order))).where(F.col("r") <= size)
    top = sliced.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= size)
    out: dict[str, list[int]] = {}
    for row in top.select("lang", "r", "gram").orderBy("lang", "r").toLocalIterator():
        out.setdefault(row.lang, []).append(row.gram)
    return out


class Ranker:
    """Out-of-place distances of ranked n-grams to every profile at once."""

    def __init__(self, profiles: dict[str, list[int]], size: int) -> None:
        self.langs, self.size = sorted(profiles), size
        self.kinds = np.unique(np.concatenate([np.array(p, np.int64) for p in profiles.values()])) if profiles else np.zeros(0, np.int64)
        self.rank = np.full((len(self.kinds), len(self.langs)), -1, np.int64)
        for k, of in enumerate(self.langs):
            self.rank[np.searchsorted(self.kinds, np.array(profiles[of], np.int64)), k] = np.arange(len(profiles[of]))

    def best(self, values: np.ndarray) -> tuple[str, float]:
        if not len(values) or not self.langs:
            return "und", 0.0
        own = ranked(values, self.size)
        at = np.minimum(np.searchsorted(self.kinds, own), len(self.kinds) - 1)
        rank = np.where((self.kinds[at] == own)[:, None], self.rank[at], -1)
        away = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own))[:, None])).sum(0)
        k = int(np.argmin(away))
        return self.langs[k], float(1 - away[k] / (self.size * len(own)))


def with_language(df: DataFrame, profiles: dict[str, list[int]], text: str = "text", size: int = PROFILE, keep_text: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """df with the predicted language and a score: 1 less the distance over the largest possible one."""
    df = renamed_clashes(df, names, keep=[text])
    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    kept = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(profiles, size)
        for table in by_bytes(batches, text, BATCH_BYTES):
            found = [ranker.best(g) for g in grams(*flat_text(table[text]))]
            out = table.select(kept).append_column(names[0], pa.array([x[0] for x in found], pa.string()))
            yield from out.append_column(names[1], pa.array([x[1] for x in found], pa.float64())).to_batches()

    return df.mapInArrow(tidy(predict), schema)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a row is kept from training: the CRC-32 of its id as text leaves 1 when divided by 3."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def rejected(lang: str = "lang_pred", score: str = "score") -> Column:
    """Documents that the operator can't place: no letters, or no n-gram near any profile."""
    return (F.col(lang) == "und") | (F.col(score) <= 0)
