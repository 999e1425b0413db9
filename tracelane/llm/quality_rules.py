"""Quality rules: a table of thresholds compiled into one projection of Spark functions, without any user function.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; a null text has none. For each document:

n_words, word_chars (code points in words), n_symbols (characters of ``[#*$%&|<>]``), n_lines (lines with a word, cut at
\\n only), n_dup_lines (of those, the ones equal to an earlier one), n_repeat_words (words inside windows of three words
that the text has twice or more, the first included), n_stop_words (words that are stop words, in small letters, with a capital or in capitals),
n_bullet_lines and n_ellipsis_lines; base_failed; failed_rules (names of the rules of the table that the document
breaks, whether or not base_failed); kept: neither.

A text whose windows' hashes all differ repeats none. Otherwise one array of 64-bit values is sorted, each a window's
hash above its position, and neighbours with one hash are compared word by word; should two different windows ever share
a hash, that text's windows are sorted as text instead: hashes decide nothing. Work is in proportion to n log n words.

Rows are judged one by one: nothing is shuffled, and repeated rows each get their row. A column of the table that is
named like a result gets the suffix ``_in``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import free_name, renamed_clashes

SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
#: The most common function words of each language that the corpus is in.
STOP_WORDS = (
    "the of and to in a is that it for as with was on be by this are or an at from which not have has but they you his her",  # English
    "der die das und in zu den von mit ist im für auf des dem nicht ein eine sich als auch es an aus bei nach wie er sie",  # German
    "le la les de des et un une en que est pour dans du qui sur pas au par il elle ne se plus avec ce son sont ou",  # French
    "el la los las de y que en un una es por con para se no del al lo como más pero sus su o este ha son",  # Spanish
)
MIN_WORDS, REPEAT_PERCENT = 50, 50
RESULTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines", "base_failed", "failed_rules", "kept")


@dataclass(frozen=True)
class Rule:
    """A ratio of two counts that must lie between two bounds, given in thousandths; None: no bound."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None

    def broken(self) -> Column:
        """Compared without a division; a ratio to nothing breaks no rule."""
        part, whole = F.col(self.part) * 1000, F.col(self.whole)
        tests = [part < self.least * whole] * (self.least is not None) + [part > self.most * whole] * (self.most is not None)
        return (whole > 0) & F.greatest(F.lit(False), F.lit(False), *tests)


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2_500, 15_000),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 100),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 20, None),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", None, 500),
    Rule("bullet_line_ratio", "n_bullet_lines", "n_lines", None, 900),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", None, 300),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often and inside whatever lambda it is read."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    bare = F.trim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE_CLASS}]+"))


def without(text: Column, characters: str) -> Column:
    return F.regexp_replace(text, f"[{characters}]+", "")


def stop_words() -> list[str]:
    """In small letters, with a capital and in capitals."""
    return sorted({v for line in STOP_WORDS for w in line.split() for v in (w, w.capitalize(), w.upper())})


def covered(positions: Column, window: int) -> Column:
    """How many words windows of that many words cover, given their first positions, sorted."""
    start = F.struct(F.lit(-window).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(positions, start, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(window).cast("long"), p - a["at"])).alias("n")), lambda a: a["n"])


def repeat_words(words: Column, window: int = 3, hashed: Callable[..., Column] = F.xxhash64) -> Column:
    """The words inside windows that occur twice or more. words: a bound array (see let)."""
    none = F.lit(0).cast("long")
    last = F.size(words) - window
    starts = F.sequence(F.lit(0), last)

    def slots(p: Column) -> list[Column]:
        return [words[p.cast("int") + d] for d in range(window)]

    def by_text() -> Column:
        rows = F.transform(starts, lambda p: F.struct(F.concat_ws(" ", *slots(p)).alias("t"), p.cast("long").alias("p")))
        at = lambda x: x["p"]
        return let(F.array_sort(rows), lambda s: let(pairs(s, lambda a, b: a["t"] == b["t"]), lambda found: covered(places(found, at), window)))

    def pairs(s: Column, same: Callable[[Column, Column], Column]) -> Column:
        """Each item of the sorted array that is the same as the one before, after that one, in one flat array."""
        held = F.transform(s, lambda x, j: F.when((j > 0) & same(x, F.get(s, j - 1)), F.array(F.get(s, j - 1), x)))
        return F.flatten(F.filter(held, lambda x: x.isNotNull()))

    def places(found: Column, at: Callable[[Column], Column]) -> Column:
        return F.sort_array(F.array_distinct(F.transform(found, at)))

    def by_hash(hashes: Column, bits: Column) -> Column:
        keys = F.transform(hashes, lambda h, p: F.call_function("shiftleft", h, bits).bitwiseOR(p.cast("long")))
        at = lambda x: F.call_function("shiftrightunsigned", F.call_function("shiftleft", x, 64 - bits), 64 - bits)
        same = lambda a, b: F.call_function("shiftright", a.bitwiseXOR(b), bits) == 0

        def judged(found: Column) -> Column:
            differ = lambda x, j: (j % 2 == 1) & F.greatest(*[a != b for a, b in zip(slots(at(x)), slots(at(F.get(found, j - 1))), strict=True)])
            mixed = F.size(F.filter(found, differ)) > 0
            return F.when(F.size(found) == 0, none).when(mixed, by_text()).otherwise(covered(places(found, at), window))

        return let(F.sort_array(keys), lambda s: let(pairs(s, same), judged))

    def searched(hashes: Column) -> Column:
        bits = let(F.length(F.bin(last.cast("long"))), lambda bits: by_hash(hashes, bits))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(bits)

    return F.when(last < 1, none).otherwise(let(F.slice(F.transform(words, lambda w, p: hashed(w, *[F.get(words, p + d) for d in range(1, window)])), 1, last + 1), searched))


def measures(text: Column) -> Column:
    """A struct of all counts of a text."""
    text = F.coalesce(text, F.lit(""))
    long = lambda c: c.cast("long")

    def of_words(words: Column) -> list[Column]:
        stop = F.filter(words, lambda w: w.isin(*stop_words()))
        return [long(F.size(words)).alias("n_words"), repeat_words(words).alias("n_repeat_words"), long(F.size(stop)).alias("n_stop_words")]

    def of_lines(lines: Column) -> list[Column]:
        bullets = F.filter(lines, lambda x: F.substring(F.ltrim(x, F.lit(SPACES)), 1, 1).isin("-", "*", "•", "●", "‣"))
        dots = F.filter(lines, lambda x: F.rtrim(x, F.lit(SPACES)).endswith("...") | F.rtrim(x, F.lit(SPACES)).endswith("…"))
        return [long(F.size(lines)).alias("n_lines"), long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"), long(F.size(bullets)).alias("n_bullet_lines"), long(F.size(dots)).alias("n_ellipsis_lines")]

    def of_text(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
        return F.struct(
            let(words_of(t), lambda w: F.struct(*of_words(w))).alias("words"),
            let(lines, lambda x: F.struct(*of_lines(x))).alias("lines"),
            long(F.length(without(t, SPACE_CLASS))).alias("word_chars"),
            long(F.length(t) - F.length(without(t, SYMBOLS))).alias("n_symbols"),
        )

    return let(text, of_text)


def judged(df: DataFrame, text: str = "text", rules: Iterable[Rule] = RULES, min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT, keep_text: bool = False) -> DataFrame:
    """df's columns (the text only if keep_text) with all RESULTS; each rule is one more condition of one projection."""
    df = renamed_clashes(df, RESULTS, keep=[text])
    own = [c for c in df.columns if keep_text or c != text]
    made = free_name(df, "measured")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    failed = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(r.broken(), F.lit(r.name)) for r in rules]))
    counts = df.withColumn(made, measures(F.col(text))).select(*own, f"{made}.words.*", f"{made}.lines.*", f"{made}.word_chars", f"{made}.n_symbols")
    out = counts.withColumns({"base_failed": base, "failed_rules": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).select(*own, *RESULTS)
