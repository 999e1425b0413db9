"""Helpers shared by the training-data operators: staged tables, text blocks, word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Where the session has none, a local one is set if Spark runs in one
    process (tests); on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tracelane-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of the queries run inside go when each query ends."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


_scratch: list[list[DataFrame]] = []


#: For tables whose rows are blocks of megabytes. Spark decodes up to 4096 rows of a row group at once, and Parquet's writer
#: first looks at how much it holds after 100 rows: a task would hold hundreds of blocks, as many as its share of the input has.
LARGE_ROWS = {"parquet.block.row.count.limit": "1"}


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and executors can be lost. options: of the writer."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with shuffles_dropped(spark):
        df.write.options(compression="zstd", **options).parquet(path)
    return registered(spark.read.schema(df.schema).parquet(path), path)


def registered(df: DataFrame, path: str) -> DataFrame:
    """df, which reads a folder of shared_dir that was written in parts, to be deleted as staged tables are."""
    df._staged_at = path
    if _scratch:
        _scratch[-1].append(df)
    return df


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged inside are deleted at the end, but for those passed through the function that it gives: they
    belong to the scratch around this one, if there is any."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scratch.append(made)
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _scratch.remove(made)
        discard(*(t for t in made if all(t is not k for k in kept)))
        if _scratch:
            _scratch[-1].extend(kept)


_kept: dict[str, list] = {}


def kept(most: int) -> Callable[[Callable], Callable]:
    """lru_cache for what a Python worker keeps from task to task. It goes when a task of another operator (module)
    begins in the worker: workers live as long as the application, and each would hold what every operator keeps."""

    def keep(make: Callable) -> Callable:
        found = functools.lru_cache(maxsize=most)(make)
        _kept.setdefault(make.__module__, []).append(found)
        return found

    return keep


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _let_go(but: str) -> None:
    """Drop what modules but one keep in this worker."""
    held = [f for module, found in _kept.items() if module != but for f in found if f.cache_info().currsize]
    for f in held:
        f.cache_clear()
    if held:
        _trim()


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work, before which the Python worker lets go of what other operators keep in it, and after which it gives the
    memory it no longer uses back to the system: workers live on from task to task and would keep the most that any of
    them took."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        _let_go(work.__module__)
        try:
            yield from work(batches)
        finally:
            _trim()

    return run


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def renamed_clashes(df: DataFrame, made: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """df with its columns that share a name with a made column renamed to <name>_in; those in keep stay."""
    made, keep = {c.lower() for c in made}, {c.lower() for c in keep}
    for c in df.columns:
        if c.lower() in made and c.lower() not in keep:
            new = f"{c}_in"
            while new.lower() in {x.lower() for x in df.columns} | made:
                new += "_"
            df = df.withColumnRenamed(c, new)
    return df


def by_bytes(batches: Iterable[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.Table]:
    """Regroup record batches into tables of about limit text bytes each; a longer text is a table alone."""
    parts: list[pa.Table] = []
    held = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        size = pc.fill_null(pc.binary_length(table[text]), 0).to_numpy().astype(np.int64)
        at = 0
        ends = np.cumsum(size)
        while at < len(size):
            done = ends[at - 1] if at else 0
            stop = int(np.searchsorted(ends, done + limit - held, side="right"))
            if stop == at and not held:
                stop = at + 1
            if stop > at:
                parts.append(table.slice(at, stop - at))
                held += int(ends[stop - 1] - done)
                at = stop
            if at < len(size) or held >= limit:
                if parts:
                    yield pa.concat_tables(parts).combine_chunks()
                parts, held = [], 0
    if parts:
        yield pa.concat_tables(parts).combine_chunks()


def flat_text(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes one after another and their n+1 offsets; null counts as empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    array = pc.fill_null(array.cast(pa.large_string()), "")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.zeros(0, np.uint8)
    return raw, off - off[0]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[128:] = True
    return low, word


LOWER, IN_WORD = _tables()
IN_TERM = IN_WORD.copy()  # without digits
IN_TERM[48:58] = False


def split_words(raw: np.ndarray, off: np.ndarray, in_word: np.ndarray = IN_WORD) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the texts with A-Z lowered, and where each text's words begin.
    in_word: which bytes, once lowered, words are made of.

    Every byte of a character beyond ASCII is 0x80 or more, so classes of bytes are classes of characters.
    Returns a dictionary array over all words in order and n+1 word offsets.
    """
    low = LOWER[raw]
    inside = in_word[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = off[:-1][off[:-1] < len(raw)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    kept = low[inside]
    begins = np.cumsum(inside, dtype=np.int64)[starts] - 1 if len(starts) else np.zeros(0, np.int64)
    offsets = np.append(begins, len(kept)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))])
    return words.dictionary_encode(), np.searchsorted(starts, off, side="left")


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def list_array(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def struct_of(table: pa.Table, schema: T.StructType) -> pa.StructArray:
    """The table's rows as one struct array in the Arrow types of schema."""
    want = arrow_schema(schema)
    arrays = [pa.concat_arrays(table[f.name].chunks).cast(f.type) if table[f.name].num_chunks else pa.array([], f.type) for f in want]
    return pa.StructArray.from_arrays(arrays, fields=list(want))


def empty_if_null(c) -> F.Column:
    return F.coalesce(c, F.lit(""))
