"""Ranked search against scores of every document, whatever the depth of heads, slack and sizes."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from tracelane.llm import ranked_search

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, []).extend(terms(t))
    out = set()
    for item, words in asked.items():
        scores = []
        for doc_id, c in held:
            m = 100 - 75 + 75 * sum(c.values()) * n_docs // n_terms if c else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words if c[t])
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        out |= {(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)}
    return out


def corpus(rng, n):
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(300)] + ["É", "日本", "The", "the", "7"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for k in range(n)]
    docs += [(1000, None), (1001, ""), (1002, "??"), (None, "w1 w2 the"), (1003, "w1 " * 30000), (1004, "w1 w2 the"), (1005, "w1 w2 the"), (1006, "w1 w2 the"), (1006, "w1 w2 the"), (1006, "w1 w3")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 15)))) for i in range(12)]
    return docs, items + [(50, None), (51, ""), (52, "nowhere"), (53, "w1 w1 W1 the The"), (None, "w1 w2"), (54, "w1"), (54, "w2 w2")]


@pytest.mark.parametrize("how", [{}, {"heads": 1, "slack": 100}, {"heads": 3, "slack": 1, "bucket": 50, "chunk_bytes": 300, "lookups": 7}])
def test_search_equals_scores_of_all_documents(spark, how):
    docs, items = corpus(random.Random(9), 300)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).sortWithinPartitions("doc_id").withColumnsRenamed({}).selectExpr("doc_id", "text", "doc_id AS rank", "1 AS score")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in ranked_search.search(ranked_search.build_index(df, block_bytes=1500), benchmark, k=5, **how).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items, 5)


def test_search_of_nothing(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id string, text string")
    assert ranked_search.ranked(none, asked).count() == 0
    assert ranked_search.ranked(one, asked.limit(0)).count() == 0
    assert ranked_search.ranked(one.selectExpr("doc_id", "CAST(NULL AS STRING) AS text"), asked).count() == 0
    assert [tuple(r) for r in ranked_search.ranked(one.union(one).union(spark.createDataFrame([(2, "c")], one.schema)), asked).select("rank", "doc_id").orderBy("rank").collect()] == [(1, 1), (2, 1)]
