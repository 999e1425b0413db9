"""The divergence audit against sums over all kept terms."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from tracelane.llm import divergence


def brute(rows, most):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held, count, groups = defaultdict(set), defaultdict(Counter), set()
    for k, (text, lang, source) in enumerate(rows):
        g = (lang or "", source or "")
        groups.add(g)
        for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low)):
            held[g[0], w].add(k)
            count[g][w] += 1
    out = set()
    for lang, source in groups:
        kept = sorted(w for (x, w), d in held.items() if x == lang and len(d) >= 3)
        of = lambda gs: {w: sum(count[g][w] for g in gs) for w in kept}  # noqa: B023, E731
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // q
        p, whole = share(of([(lang, source)])), share(of([g for g in groups if g[0] == lang]))
        pairs = [(-sum(f(p[w], q[w]) for w in kept), s) for x, s in groups if x == lang and s != source for q in [share(of([(x, s)]))]]
        terms = [(-f(p[w], whole[w]), w.encode()) for w in kept if count[lang, source][w] and p[w] > whole[w]]
        out |= {(lang, source, "pair", s, -v, k) for k, (v, s) in enumerate(sorted(pairs, key=lambda x: (x[0], x[1].encode())), 1)}
        out |= {(lang, source, "term", w.decode(), -v, k) for k, (v, w) in enumerate(sorted(terms)[:most], 1)}
    return out


def test_audit_equals_sums_over_all_terms(spark):
    rng = random.Random(6)
    words = ["The", "the", "of", "a1b", "É", "é", "中文", "x", "rare", "z9", "q"]
    rows = [(" ".join(rng.choice(words[: rng.randrange(1, 12)]) for _ in range(rng.randrange(30))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", "", None])) for _ in range(120)]
    rows += [(None, "de", "s1"), ("", "de", "s2"), ("one two", "de", "s3"), ("12 !?", "en", "silent"), (("the end " * 40000), "en", "s1"), *[("same text", "en", "s2")] * 3]
    df = spark.createDataFrame([(t, a, b, k, 0) for k, (t, a, b) in enumerate(rows)], "text string, lang string, source string, term int, `count` int").repartition(3)
    for block, held in ((8 << 20, 1 << 20), (300, 10)):
        got = {tuple(r) for r in divergence.audit(df, most=4, block_bytes=block, held_rows=held).collect()}
        assert got == brute(rows, 4)


def test_audit_of_nothing(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(df).count() == 0
