"""License scans by sentence rules.

A text is cut into sentences. Each is normalised (lower case, words only, the thing that it is about as "it") and
looked up in a map from known licence sentences to their identifiers; sentences with open places are looked up by
their first three words. A sentence or line can also name a licence: "... licensed under the X", "X License" alone,
"X licensed", or an SPDX tag, whose licences are looked up in a map of names. In an unknown sentence over several
lines each line is tried. The identifiers of a text, in order, are then matched against the ordered rules: a rule
names a licence and the identifiers that must follow each other; unknown sentences end a run, except that ``gap`` of
them in a row are let through. At a place the longest rule wins, then the first in the list; matches don't overlap.
Rights that are merely reserved count only where no licence is found.

Null or empty texts, and texts without a known sentence, have no match and get empty lists. Texts are scanned
whole. Other columns stay; those named like a result get the suffix ``_in``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracelane.llm import license_texts
from tracelane.llm.common import by_bytes, kept, renamed_clashes, tidy

BATCH_BYTES, GAP = 1 << 20, 1

# Every known sentence has one of these; between words there may be any marks or line breaks.
_CUE = re.compile(r"licen[sc]|permi[st]|copyright|warrant|redistribut|free[^a-z0-9]+software|public[^a-z0-9]+domain|rights[^a-z0-9]+reserved|endorse|liab|misrepresent|source[^a-z0-9]+(?:distribution|version)|advertising|anyone[^a-z0-9]+is[^a-z0-9]+free|creative[^a-z0-9]+commons|mpl|hope[^a-z0-9]+that|wtf|you[^a-z0-9]+want|confidential|prohibited", re.IGNORECASE)
# The same, as parts of words, for whole texts.
_HINTS = ("licen", "permi", "copyright", "warrant", "redistribut", "software", "domain", "reserved", "endorse", "liab", "misrepresent", "source", "advertising", "anyone", "creative", "mpl", "hope", "wtf", "want", "confidential", "prohibited")
_END = re.compile(r"(?<=[.!?])[\"')\]]*(?:[ \t]*\n\s*|[ \t]+(?!\d)|[^\S \t\n]\s*)|\n[ \t]*(?:[#*/;%<>!-]+[ \t]*)?\n")
_SHORT = re.compile(r"(?:^|[^a-z0-9.])(?:v|ver|no|inc|ltd|corp|co|e\.g|i\.e|[a-z])\.$|(?:^|\n)[^a-z0-9\n]*[a-z0-9]{1,2}\.$", re.IGNORECASE)
_WORD = re.compile(r"[a-z0-9]+")
_VERSION = re.compile(r"\bv(?=\d)")
_LINE = re.compile(r"[^\n]+")
_SPDX = re.compile(r"spdx-license-identifier:\s*([^\n*]+)", re.IGNORECASE)
_THIS = re.compile(rf"\bthis (?:free software |font |source code )?(?:{'|'.join(license_texts.THINGS)})\b")
_VERB = re.compile(r"^(?:\w+ ){0,9}?(?:licensed|released|distributed|available|provided|published|covered|offered|shared|redistributed|is|are) under (?:the |a |an |terms |of |conditions |and |either )*")
_MONTH = r"(?:january|february|march|april|may|june|july|august|september|october|november|december)"
_DATE = re.compile(rf" (?:\d{{1,2}} {_MONTH}|{_MONTH}(?: \d{{1,2}}(?:st|nd|rd|th)?)?) \d{{4}}$")
_DROPPED = {"the", "license", "licenses", "version", "v", "agreement"}
#: Words that may follow a licence's name in a sentence.
_AFTER = {"see", "for", "which", "you", "with", "in", "as", "and", "or", "by", "at", "unless", "a", "is", "found", "available", "copyright", "c", "http", "https", "is", "terms"}
LONGEST_NAME = 14


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the sentences: they end at a sentence mark before white space, but not after an abbreviation or
    the number of a list, nor before a digit; or at a line that is empty but for comment marks."""
    at = 0
    for m in _END.finditer(text):
        if text[m.start()] != "\n" and _SHORT.search(text, max(0, m.start() - 8), m.start()):
            continue
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def normal(sentence: str) -> str:
    """Words of a sentence, without the number of a list before it."""
    words = _WORD.findall(_VERSION.sub("v ", sentence.lower().replace("licence", "license")))
    if len(words) > 3 and (words[0].isdigit() or len(words[0]) == 1 and words[0] != "a"):
        words = words[1:]
    return _THIS.sub("this it", " ".join(words))


def name_key(words: list[str]) -> list[str]:
    """Words of a licence's name without those that don't tell licences apart; gplv3 is gpl 3."""
    return re.sub(r"\b([al]?gpl|mpl|epl)v?(\d)", r"\1 \2", " ".join(w for w in words if w not in _DROPPED)).split()


class Recogniser:
    """known: (id, words) of the sentences; rules: (licence, ids); names: licence by name (own sentences have none)."""

    def __init__(self, known: list[tuple[str, str]] | None = None, rules: list[tuple[str, tuple[str, ...]]] | None = None, gap: int = GAP) -> None:
        self.cue = _CUE if known is None else re.compile("")  # the caller's own sentences may hold any words
        self.names = license_texts.known_names() if known is None else {}
        self.exact: dict[str, str] = {}
        self.open: dict[tuple[str, ...], list[tuple[re.Pattern, str]]] = {}
        for name, words in license_texts.known_sentences() if known is None else known:
            if "..." in words:
                first = tuple(words.split("...")[0].split()[:3])
                self.open.setdefault(first, []).append((re.compile(re.escape(words).replace(r"\ \.\.\.\ ", " (?:.* )?").replace(r"\ \.\.\.", "(?: .*)?").replace(r"\.\.\.\ ", "(?:.* )?")), name))
            else:
                self.exact.setdefault(words, name)
        self.gap = gap
        self.by_first: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
        for licence, ids in sorted(rules if rules is not None else license_texts.known_rules(), key=lambda r: -len(r[1])):
            self.by_first.setdefault(ids[0], []).append((licence, ids))

    def named(self, words: list[str]) -> str | None:
        """The licence whose name these words are, or begin with before a word that may follow it."""
        key = name_key(words)
        for n in range(min(len(key), LONGEST_NAME), 0, -1):
            licence = self.names.get(" ".join(key[:n]))
            if licence:
                return licence if n == len(key) or key[n] in _AFTER else None
        return None

    def mention(self, words: str) -> str | None:
        """The licence that a sentence or line names."""
        under = _VERB.match(words)
        if under:
            return self.named(words[under.end() :].split())
        title = _DATE.sub("", words).split()
        if len(title) <= LONGEST_NAME and ("license" in title or "unlicense" in title or title[:2] == ["creative", "commons"]):
            return self.names.get(" ".join(name_key(title)))
        if title and title[-1] == "licensed":
            return next((x for n in range(1, 6) if (x := self.names.get(" ".join(name_key(title[-1 - n : -1]))))), None)
        return None

    def identify(self, sentence: str) -> list[str]:
        """The identifiers of a sentence: of a known sentence its own, of a name the licence after under:."""
        if not self.cue.search(sentence):
            return []
        tag = _SPDX.search(sentence) if self.names else None
        if tag:
            named = (self.named(normal(re.sub(r"[-+]", lambda m: " or later" if m[0] == "+" else " ", x)).split()) for x in re.split(r"[()]|\b(?:AND|OR|WITH)\b", tag[1]) if x.strip())
            return [f"under:{x}" for x in named if x]
        words = normal(sentence)
        found = self.exact.get(words) or next((name for p, name in self.open.get(tuple(words.split()[:3]), self.open.get(tuple(words.split()[:1]), ())) if p.fullmatch(words)), None)
        if found:
            return [found]
        if self.names and (licence := self.mention(words)):
            return [f"under:{licence}"]
        return []

    def scan(self, text: str) -> tuple[list[str], list[tuple[str, int, int]]]:
        """Identifiers in order, and (licence, start, end) of the matches."""
        if self.cue is _CUE:
            low = text.lower()
            if not any(h in low for h in _HINTS) or not self.cue.search(text):
                return [], []
        found = []
        for k, span in enumerate(sentences(text)):
            names = self.identify(text[span[0] : span[1]])
            if not names and "\n" in text[span[0] : span[1]]:  # a heading or a lone line without a sentence mark
                for m in _LINE.finditer(text, *span):
                    found += [(k, name, m.span()) for name in self.identify(m[0])]
            found += [(k, name, span) for name in names]
        matches, i = [], 0
        while i < len(found):
            for licence, ids in self.by_first.get(found[i][1], ()):
                run = found[i : i + len(ids)]
                if len(run) == len(ids) and all(r[1] == x for r, x in zip(run, ids, strict=True)) and all(b[0] - a[0] <= self.gap + 1 for a, b in zip(run, run[1:], strict=False)):
                    matches.append((licence, run[0][2][0], run[-1][2][1]))
                    i += len(ids) - 1
                    break
            else:
                if found[i][1].startswith("under:"):
                    matches.append((found[i][1][6:], *found[i][2]))
            i += 1
        if any(m[0] not in license_texts.WEAK for m in matches):
            matches = [m for m in matches if m[0] not in license_texts.WEAK]
        return [name for _, name, _ in found], matches


@kept(1)
def standard(gap: int) -> Recogniser:
    return Recogniser(gap=gap)


def with_licenses(df: DataFrame, text: str = "text", known: list[tuple[str, str]] | None = None, rules: list | None = None, gap: int = GAP, keep_text: bool = False) -> DataFrame:
    """df with sentence_ids (known sentences and names in order), licenses (sorted, distinct) and matches (license,
    start, end in characters). known and rules: own sentences, (id, words as normalised, ... for any words), and rules
    for them instead of the standard ones."""
    results = ("sentence_ids", "licenses", "matches")
    df = renamed_clashes(df, results, keep=[text])
    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    names = [f.name for f in fields]
    strings = T.ArrayType(T.StringType())
    span = T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*fields, T.StructField("sentence_ids", strings), T.StructField("licenses", strings), T.StructField("matches", T.ArrayType(span))])
    spans = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = standard(gap) if known is None else Recogniser(known, rules or [], gap)
        for table in by_bytes(batches, text, BATCH_BYTES):
            found = [use.scan(t) for t in pc.fill_null(table[text], "").to_pylist()]
            out = table.select(names).append_column("sentence_ids", pa.array([i for i, _ in found], pa.list_(pa.string())))
            out = out.append_column("licenses", pa.array([sorted({m[0] for m in ms}) for _, ms in found], pa.list_(pa.string())))
            out = out.append_column("matches", pa.array([[{"license": a, "start": b, "end": c} for a, b, c in ms] for _, ms in found], spans))
            yield from out.to_batches()

    return df.mapInArrow(tidy(scan), schema)
