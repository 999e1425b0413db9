"""Chat formatting by columnar byte assembly.

Each turn is five segments: a header, the escaped role, a line end, the escaped text, a footer. numpy computes
the segments' lengths, cumulative offsets and scatter indices, and headers, roles and texts of all turns are
copied into one preallocated buffer, which becomes the data buffer of the Arrow column.

Template: ``[INST] role\\n text [/INST]\\n`` for other turns and ``<s>role\\n text</s>\\n`` for the assistant's.
Inside roles and texts every backslash is doubled and every control string gets a backslash after its first
character, so none occurs literally; ``unescaped`` undoes it. In roles a line end is escaped too.

Rows of a conversation go by turn, ties by role and then text, nulls first. Null text or role counts as empty;
a null conversation id is one conversation. An empty table gives no conversation. One conversation is one
output value and so is held by one task, as long as it is; conversations themselves are spread by their id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import tidy

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
HEADS = (b"[INST] ", b"<s>")
FEET = (b" [/INST]\n", b"</s>\n")
LEARNED = "assistant"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
FORMATTED = "formatted string, turn_starts array<long>, text_starts array<long>, text_ends array<long>, learned array<boolean>"


def escaped(texts: pa.Array, lines: bool = False) -> pa.Array:
    texts = pc.replace_substring(texts, "\\", "\\\\")
    for c in CONTROLS:
        texts = pc.replace_substring(texts, c, c[0] + "\\" + c[1:])
    return pc.replace_substring(texts, "\n", "\\\n") if lines else texts


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), off


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns' bytes in one buffer; the turns' starts (n+1), each text's start and end in it, and the loss mask."""
    roles, texts = (pc.fill_null(x.cast(pa.large_string()), "") for x in (roles, texts))
    learned = pc.equal(roles, LEARNED).to_numpy(zero_copy_only=False).astype(np.intp)
    roles, texts = escaped(roles, lines=True), escaped(texts)
    role_data, role_off = _bytes_of(roles)
    text_data, text_off = _bytes_of(texts)
    length = np.stack([np.array([len(h) for h in HEADS])[learned], np.diff(role_off), np.ones(len(roles), np.int64), np.diff(text_off), np.array([len(f) for f in FEET])[learned]], axis=1)
    at = np.concatenate([[0], np.cumsum(length.ravel())])
    start = at[:-1].reshape(length.shape)
    out = np.empty(int(at[-1]), np.uint8)

    def put(data: np.ndarray, src: np.ndarray, to: np.ndarray, size: np.ndarray) -> None:
        total = int(size.sum())
        if total:
            step = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(to, size) + step] = data[np.repeat(src, size) + step]

    for k in (0, 1):
        of = np.flatnonzero(learned == k)
        for constant, column in ((HEADS[k], 0), (FEET[k], 4)):
            out[start[of, column][:, None] + np.arange(len(constant))] = np.frombuffer(constant, np.uint8)
    put(role_data, role_off[:-1], start[:, 1], length[:, 1])
    out[start[:, 2]] = 10
    put(text_data, text_off[:-1], start[:, 3], length[:, 3])
    return out, np.append(start[:, 0], at[-1]), start[:, 3], start[:, 3] + length[:, 3], learned.astype(bool)


def _conversations(table: pa.Table, key: str, parts: np.ndarray) -> pa.RecordBatch:
    out, turn, text, end, learned = assemble(table["role"].combine_chunks(), table["text"].combine_chunks())
    first = np.append(parts, table.num_rows)
    offsets = turn[first]
    base = np.repeat(offsets[:-1], np.diff(first))
    formatted = pa.Array.from_buffers(pa.large_string(), len(parts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
    lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(v)) for v in (turn[:-1] - base, text - base, end - base, learned)]
    return pa.RecordBatch.from_arrays([table[key].take(pa.array(parts)).combine_chunks(), formatted.cast(pa.string()), *lists], names=[key, "formatted", "turn_starts", "text_starts", "text_ends", "learned"])


def formatted_chats(df: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row for each conversation: its id, the formatted text, and by turn the byte offsets of the turn and of
    its text and whether the text is under the loss mask."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias(key), F.col(turn).alias("turn_"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition(F.col(key)).sortWithinPartitions(F.col(key).asc_nulls_first(), F.col("turn_").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            last = table[key][-1]
            ids = table[key].combine_chunks()
            same = pc.fill_null(pc.equal(ids, last), last.as_py() is None) if last.is_valid else pc.is_null(ids)
            stop = int(np.argmax(same.to_numpy(zero_copy_only=False)))
            if stop:
                done = pa.concat_tables([*held, table.slice(0, stop)]).combine_chunks()
                yield _conversations(done, key, _parts(done[key]))
                held = []
            elif held and not _same(held[-1][key][-1], table[key][0]):
                done = pa.concat_tables(held).combine_chunks()
                yield _conversations(done, key, _parts(done[key]))
                held = []
            held.append(table.slice(stop))
        if held:
            done = pa.concat_tables(held).combine_chunks()
            yield _conversations(done, key, _parts(done[key]))

    return rows.mapInArrow(tidy(build), f"`{key}` {kind}, {FORMATTED}")


def _same(a: pa.Scalar, b: pa.Scalar) -> bool:
    return a.as_py() == b.as_py()


def _parts(ids: pa.ChunkedArray) -> np.ndarray:
    """Where each run of one id begins; the ids are sorted, nulls first."""
    x = ids.combine_chunks()
    null = pc.is_null(x).to_numpy(zero_copy_only=False)
    if len(x) < 2:
        return np.zeros(len(x), np.int64)
    differ = pc.fill_null(pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)), True).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], differ & ~(null[1:] & null[:-1])]))


_TURN = re.compile(r"\[INST\] ((?:[^\\\n]|\\.)*)\n(.*?) \[/INST\]\n|<s>((?:[^\\\n]|\\.)*)\n(.*?)</s>\n", re.DOTALL)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        role, text = (found[1], found[2]) if found[1] is not None else (found[3], found[4])
        out.append((unescaped(role), unescaped(text)))
        at = found.end()
    return out


def chat_digests(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """Read formatted conversations back: turns and digests of the turns and of all text under the loss mask."""
    kind = chats.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[] for _ in range(5)]
            for text, starts, ends, learned in zip(*(batch.column(c).to_pylist() for c in ("formatted", "text_starts", "text_ends", "learned")), strict=True):
                turns = parsed(text)
                whole = text.encode()
                masked = [unescaped(whole[a:b].decode()) for a, b, under in zip(starts, ends, learned, strict=True) if under]
                digest, loss = hashlib.sha256(), hashlib.sha256()
                for role, said in turns:
                    digest.update(f"{role}\n{said}\n".encode())
                for said in masked:
                    loss.update(said.encode())
                for to, value in zip(made, (len(turns), digest.hexdigest(), sum(map(len, masked)), loss.hexdigest(), len(text)), strict=True):
                    to.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(v, t) for v, t in zip(made, kinds, strict=True))], names=[key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.mapInArrow(tidy(read), schema)
