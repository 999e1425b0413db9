"""Token counts: batch encoding in Arrow functions that return lengths only.

Rows are regrouped into calls of about ``batch_bytes`` of text. A text longer than ``piece_bytes`` is cut
where no token can span: before a single white-space character between two other characters. A byte-level
pre-tokeniser starts a new word there, whatever follows, and no added token holds such a space.

Null text counts as empty (0 bytes, 0 tokens). Any other column is kept; one named like a result gets the
suffix ``_in``. An empty table gives an empty result. A text without a cut place is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracelane.llm.common import by_bytes, kept, renamed_clashes, tidy

CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
BATCH_BYTES, PIECE_BYTES = 1 << 20, 1 << 16


@kept(4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@lru_cache(maxsize=4)
def can_cut(path: str) -> bool:
    """Whether texts may be cut: a byte-level model that splits words itself, without prefix space or normaliser."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    return (
        pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        and spec.get("normalizer") is None
        and not any(re.search(r"\s", a["content"]) or a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in added)
    )


def pieces(text: str, limit: int) -> list[str]:
    """The text cut at safe places into pieces of at most about limit characters, where such places exist."""
    out, at = [], 0
    while len(text) - at > limit:
        found = CUT.search(text, at + limit)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    out.append(text[at:])
    return out


def count_texts(texts: list[str], path: str, piece_bytes: int = PIECE_BYTES) -> list[int]:
    cut = can_cut(path)
    flat, owner = [], []
    for i, text in enumerate(texts):
        for piece in pieces(text, piece_bytes) if cut and len(text) > piece_bytes else [text]:
            flat.append(piece)
            owner.append(i)
    counts = [0] * len(texts)
    for i, found in zip(owner, tokenizer(path).encode_batch_fast(flat, add_special_tokens=False), strict=True):
        counts[i] += len(found)
    return counts


def with_token_counts(df: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 512, batch_bytes: int = BATCH_BYTES, keep_text: bool = False) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit (n_tokens > limit); the text itself stays only if keep_text."""
    df = renamed_clashes(df, ["n_bytes", "n_tokens", "over_limit"], keep=[text])
    if text.lower() in ("n_bytes", "n_tokens", "over_limit"):
        raise ValueError(f"rename the text column {text}")
    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    names = [f.name for f in fields]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_bytes(batches, text, batch_bytes):
            found = pc.fill_null(table[text], "")
            n_bytes = pc.cast(pc.binary_length(found), pa.int64())
            n_tokens = pa.array(count_texts(found.to_pylist(), tokenizer_path), pa.int64())
            out = table.select(names).append_column("n_bytes", n_bytes).append_column("n_tokens", n_tokens)
            yield from out.append_column("over_limit", pc.greater(n_tokens, limit)).to_batches()

    return df.mapInArrow(tidy(count), schema)
