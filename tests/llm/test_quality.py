"""Quality rules against a plain count, and every query of the subpackage that has SQL against DuckDB."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracelane.llm import quality_rules as q

ODD = [None, "", " \t\n\x0b\f\r ", "one", "a b", "a b c", "a b c a b c", "x x x x", "a b c d\na b c d\n\n \na b c d", " lead and trail \n", "# * $ % & | < >", "…\n - dot…\n* x...", "é中 文🙂 é中", "a\x00b\xa0c d", "tick " * 20000, ("w" * 100_000) + " end"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_counts_equal_a_plain_count(spark):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(["a", "b", "c ", " ", "\n", "#", " a b c ", "é", "\t"]) for _ in range(rng.randrange(200))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, i, i) for i, t in enumerate(texts)], "doc_id long, text string, N_words int, kept int")
    out = q.judged(df, keep_text=True).collect()
    assert len(out) == len(texts)
    for r in out:
        n, chars, symbols, dups, repeats = brute(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeats), r.doc_id
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert r.kept == (not r.base_failed and not r.failed_rules) and r.kept_in == r.N_words_in == r.doc_id


def test_windows_that_share_a_hash_are_told_apart(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(60))) for _ in range(50)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for hashed in (lambda *c: F.lit(7).cast("long"), lambda *c: F.xxhash64(*c).bitwiseAND(F.lit(3).cast("long"))):
        got = df.select("text", q.let(q.words_of(F.col("text")), lambda w: q.repeat_words(w, hashed=hashed)).alias("n"))  # noqa: B023
        assert [r.n for r in got.collect()] == [brute(t)[4] for t in texts]


def test_rules_are_one_projection_without_python(spark):
    df = spark.createDataFrame([(1, "### " * 60), (2, " ".join(f"the word{i}" for i in range(60))), (3, "x" * 20 + " the" * 60)], "doc_id long, text string")
    own = (q.Rule("symbols", "n_symbols", "n_words", None, 100), q.Rule("length", "word_chars", "n_words", 3_200, None))
    out = {r.doc_id: r for r in q.judged(df, rules=own, repeat_percent=100).collect()}
    assert out[1].failed_rules == ["symbols", "length"] and out[2].kept and out[3].kept
    assert q.judged(df, rules=()).where("doc_id = 2").first().kept
    plan = q.judged(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert q.judged(df.limit(0)).count() == 0


def test_clean_prose_is_kept(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    judged = q.judged(docs).join(labels, "doc_id").where("NOT base_failed")
    good, kept, bad, dropped = judged.selectExpr("sum(quality)", "sum(quality * int(kept))", "sum(1 - quality)", "sum((1 - quality) * int(NOT kept))").toDF("a", "b", "c", "d").first()
    assert kept >= 0.98 * good and dropped >= 0.8 * bad


@pytest.fixture(scope="module")
def duck(data):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_quality_rules", "op13_divergence_audit"])
def test_query_equals_its_sql(spark, duck, data, name):
    from tracelane.llm import queries

    df = queries.QUERIES[name](spark, data)
    found = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    at = [found.columns.index(c) for c in df.columns]
    got = sorted(tuple(map(str, r)) for r in df.collect())
    assert got == sorted(tuple(str(r[i]) for i in at) for r in found.fetchall())
