"""SentencePiece encoding and decoding by a merge-type prefix table.

For each prefix of a word the table stores its last token, which is unique: candidates are the pieces that an
Aho-Corasick automaton finds ending there, longest first, and the one that holds is the one that forms a
compatible pair with the last token of the prefix before it (two tokens are compatible if merging their joined
text gives just these two). Ids are then recovered backwards from the end of the word.

Words: no piece of such a model has a space mark after another character, so a text falls apart before each
run of marks; words repeat, and each worker keeps the ids of those it met lately (2 * ``CACHE`` words at most, from task
to task of this operator). Their digits and texts are looked up for a batch at a time.
A character that is no piece is written as its UTF-8 bytes; it merges with nothing.

Null text counts as empty: no ids, empty decoded text. Texts may hold anything, the space mark too (it decodes
to a space, as the library does). Other columns stay; one named like a result gets the suffix ``_in``.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracelane.llm.common import by_bytes, kept, list_array, renamed_clashes, tidy

MARK = "▁"
#: Words of one generation. On the check input 25,000 of a megabyte's 156,000 words were not kept with 160,000, 15,000 with 400,000.
CACHE, PAIRS = 400_000, 640_000
BATCH_BYTES = 1 << 20
_WORD = re.compile(f"{MARK}+[^{MARK}]*")
#: A word longer than this is not kept in the cache.
KEPT_CHARS = 64


class PieceCoder:
    """Encoder and decoder for one merge-type model file."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id = [-1] * 256
        self.surface: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i):
                self.surface.append(b"")
            elif model.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.ids[piece] = i
                self.score[piece] = model.get_score(i)
                self.surface.append(piece.replace(MARK, " ").encode())
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece spans words: this model's texts can't be split at space marks")
        if model.encode(" a  b ", out_type=str) != self._pieces_like_library(model, " a  b "):
            raise ValueError("this model normalises texts: only identity models are supported")
        self.text_of = {i: p for p, i in self.ids.items()}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.halves: dict[str, tuple[str, str]] = {}
        for piece, i in self.ids.items():
            if self.merged(piece) == [piece]:  # else no text is ever encoded to it
                self.automaton.add_word(piece, (len(piece), i))
        # where scores fall from parts to wholes, merges happen in order of score, and edges tell all; a whole that
        # scores better than a part is merged at once when the part appears, and its pairs are merged out in full
        self.odd = {w for w, parts in self.halves.items() if any(len(x) > 1 and self.score[x] <= self.score[w] for x in parts)}
        self.edges: dict[tuple[int, int], list[tuple[str, float]]] = {}
        self.automaton.make_automaton()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.neighbours = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.lines_apart = self.byte_id[10] >= 0 and not any("\n" in p for p in self.ids)
        self.digits = pa.array([b"%d" % i for i in range(model.get_piece_size())], pa.large_binary())
        self.surfaces = pa.array(self.surface, pa.large_binary())

    @staticmethod
    def _pieces_like_library(model, text: str) -> list[str]:
        return model.id_to_piece(model.encode(MARK.join(text.split(" "))))

    def merged(self, text: str) -> list[str]:
        """Best-scored merges first, leftmost on ties: the definition, used on short strings only."""
        parts = list(text)
        last = None
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if last and len(parts) == 1:
            self.halves[text] = last
        return parts

    def edge(self, token: int, side: int) -> list[tuple[str, float]]:
        """The pieces that stood at a token's left (0) or right (1) edge while it was merged, with the score of the
        merge that ended each: the token itself is never ended."""
        key = (token, side)
        found = self.edges.get(key)
        if found is None:
            piece, ended, found = self.text_of[token], float("-inf"), []
            while True:
                found.append((piece, ended))
                if piece not in self.halves:
                    break
                ended, piece = self.score[piece], self.halves[piece][side]
            self.edges[key] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._stay_apart(left, right)
        return found

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border: none whose two pieces stand at the edges when its turn comes. Of equal
        merges the left one comes first."""
        apart = True
        for a, until_a in self.edge(left, 1):
            for b, until_b in self.edge(right, 0):
                s = self.score.get(a + b)
                if a in self.odd or b in self.odd or s is not None and s >= min(self.merge_score(a), self.merge_score(b)):
                    whole = [self.text_of[left], self.text_of[right]]
                    return self.merged("".join(whole)) == whole
                if s is not None and s > until_a and s >= until_b:
                    apart = False
        return apart

    def merge_score(self, piece: str) -> float:
        """The score of the merge that makes a piece; single characters are there from the start."""
        return float("inf") if len(piece) == 1 else self.score[piece]

    def word_ids(self, word: str) -> tuple[int, ...]:
        """The ids of one word by its prefix table."""
        last = [-1] * (len(word) + 1)  # of each prefix: its last token, -1 for a character that is no piece
        length = [1] * (len(word) + 1)
        pairs, settled = self.pairs, -1
        for end, (size, token) in self.automaton.iter(word):  # by end, the longest piece first
            if end == settled:
                continue
            before = last[end + 1 - size]
            if before >= 0 and size <= end:
                fits = pairs.get(before << 20 | token)
                if fits is None:
                    fits = self.compatible(before, token)
                if not fits:
                    continue
            last[end + 1], length[end + 1] = token, size
            settled = end
        out: list[int] = []
        end = len(word)
        while end:
            if last[end] >= 0:
                out.append(last[end])
            else:
                out.extend(self.byte_id[b] for b in reversed(word[end - 1].encode()))
            end -= length[end]
        return tuple(reversed(out))

    @staticmethod
    def given(ids: tuple[int, ...]) -> bytes:
        return array("i", ids).tobytes()

    def known(self, key: str) -> bytes:
        """The ids of a word (key: the word without its first mark; or a line end and what follows it) as four bytes
        each. Words are kept in two generations, the older dropped when the younger is full."""
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is None:
                cuts = self.cuts(key)
                if cuts:
                    got = self.joined([key[a:b] for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True)])
                elif key[:1] == "\n" and self.lines_apart:
                    got = self.given((self.byte_id[10], *self.word_ids(key[1:])))
                else:
                    got = self.given(self.word_ids(MARK + key))
            if len(key) <= KEPT_CHARS:
                if len(self.young) >= CACHE:
                    self.old, self.young = self.young, {}
                self.young[key] = got
        return got

    def cuts(self, key: str) -> list[int]:
        """Places between characters that no piece joins, so no merge crosses them: all of a long word, of a short one
        those before its last characters (marks, mostly), whose rest other words share."""
        pairs, end = self.neighbours, len(key)
        if end > KEPT_CHARS:
            return [i for i in range(1, end) if key[i - 1 : i + 1] not in pairs]
        while end > 2 and key[end - 2 : end] not in pairs:
            end -= 1
        return list(range(end, len(key)))

    def joined(self, parts: list[str]) -> bytes:
        """The ids of a word that falls into these parts; only the first bears the word's mark or line end."""
        made = {c: self.given(self.word_ids(c)) for c in set(parts[1:])}
        return b"".join([self.young.get(parts[0]) or self.known(parts[0]), *map(made.__getitem__, parts[1:])])

    def keys_of(self, word: str) -> list[str]:
        """A word cut before its line ends, which are pieces of their own if the model has none with a line end."""
        if "\n" not in word or not self.lines_apart:
            return [word]
        first, *rest = word.split("\n")
        return [first, *("\n" + x for x in rest)]

    def packed(self, text: str) -> bytes:
        """The ids of the text as four bytes each."""
        if not text:
            return b""
        if self.lines_apart and text[0] != " " and "  " not in text and " \n" not in text and MARK not in text:
            keys = text.replace("\n", " \n").split(" ")  # single spaces: each word bears one mark
        else:
            keys = [k for w in _WORD.findall(MARK + text.replace(" ", MARK)) for k in self.keys_of(w[1:])]
        young = self.young
        return b"".join([young.get(k) or self.known(k) for k in keys])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        return self.text(b"".join(map(self.surface.__getitem__, ids)))

    @staticmethod
    def text(tokens: bytes) -> str:
        """The text of joined tokens: without the space that the encoder put first."""
        return (tokens[1:] if tokens[:1] == b" " else tokens).decode("utf-8", "replace")


@kept(2)
def coder(path: str) -> PieceCoder:
    return PieceCoder(path)


RESULTS = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType(), False), "ids_sha256": T.StringType(), "decoded": T.StringType(), "decoded_sha256": T.StringType()}


def with_pieces(df: DataFrame, model_path: str, text: str = "text", results: tuple[str, ...] = ("n_tokens", "ids", "decoded"), batch_bytes: int = BATCH_BYTES, keep_text: bool = False) -> DataFrame:
    """df with the named results of encoding each whole text and decoding its ids again.

    results: any of n_tokens, ids, decoded, ids_sha256 (of the ids in decimal, joined by commas) and
    decoded_sha256 (of the decoded text's UTF-8), both in lowercase hex.
    """
    df = renamed_clashes(df, results, keep=[text])
    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, *(T.StructField(r, RESULTS[r]) for r in results)])
    kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.field("element", pa.int32(), nullable=False))}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = coder(model_path)
        for table in by_bytes(batches, text, batch_bytes):
            packed = [use.packed(value) for value in pc.fill_null(table[text], "").to_pylist()]
            made: dict[str, list] = {"n_tokens": [len(x) // 4 for x in packed]}
            ids, at = pa.array(np.frombuffer(b"".join(packed), np.int32)), np.cumsum([0, *made["n_tokens"]])
            told = lambda of, mark: pc.binary_join(list_array(of.take(ids), at), pa.scalar(mark, pa.large_binary()))  # noqa: B023, E731
            if "ids" in results:
                made["ids"] = [np.frombuffer(x, np.int32) for x in packed]
            if "ids_sha256" in results:
                made["ids_sha256"] = [hashlib.sha256(x.as_buffer()).hexdigest() for x in told(use.digits, b",")]
            if "decoded" in results or "decoded_sha256" in results:
                made["decoded"] = [use.text(x) for x in told(use.surfaces, b"").to_pylist()]
            if "decoded_sha256" in results:
                made["decoded_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in made["decoded"]]
            out = table.select(names)
            for r in results:
                out = out.append_column(r, pa.array(made[r], kinds.get(r, pa.string())))
            yield from out.to_batches()

    return df.mapInArrow(tidy(code), schema)
