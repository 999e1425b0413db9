"""Suffix dedup, near duplicates, decontamination, neighbours, the pipeline: against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracelane.llm import ann, decontaminate, near_dedup, queries, suffix_dedup
from tracelane.llm.common import scratch, staged
from tracelane.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def docs(spark, texts):
    rows = [(i, t, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, block long").repartition(3)


# --- suffix dedup


def brute_cut(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(a for a, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def cut(spark, texts, **how):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.cut_repeats(docs(spark, texts), **how).collect()}
    return [got[i] for i in range(len(texts))]


def test_difference_covers():
    for v in (1, 2, 7, 13, 31, 57, 64, 100, 133, 183):
        d = suffix_dedup.difference_cover(v)
        assert {(a - b) % v for a in d for b in d} == set(range(v)) and len(d) <= 2 * v**0.5 + 2
    assert len(suffix_dedup.difference_cover(133)) == 12


def test_prefix_classes_are_of_the_text_alone():
    raw = np.frombuffer(b"abcabcabcabd" * 30, np.uint8)
    for length in (1, 2, 3, 7, 8, 9, 12, 16, 23, 68, 200):
        got = suffix_dedup.prefix_classes(raw, length, segment=50)
        want = [raw[i : i + length].tobytes() for i in range(len(raw) - length + 1)]
        assert len(got) == len(want) and len(set(got.tolist())) == len(set(want))
        assert len(set(zip(got.tolist(), want))) == len(set(want))


def hashes(kind):
    """Fingerprints of many values, of seven, and of one."""
    few = lambda raw, n: suffix_dedup.prefix_classes(raw, n) % np.uint64(7) << np.uint64(61) | np.uint64(3)
    one = lambda raw, n: np.zeros(max(len(raw) - n + 1, 0), np.uint64)
    some = lambda raw, n: suffix_dedup.prefix_classes(raw, n) % np.uint64(199) << np.uint64(56) | np.uint64(3)
    return {"many": suffix_dedup.prefix_classes, "some": some, "few": few, "one": one}[kind]


@pytest.mark.parametrize(("length", "period", "seed", "hashed"), [(20, 13, 1, "many"), (20, 13, 3, "many"), (20, 7, 3, "few"), (200, 133, 2, "many"), (200, 133, 1, "few"), (5, 133, 1, "many"), (20, 13, 2, "one"), (20, 13, 5, "some"), (200, 133, 6, "some")])
def test_cut_repeats_on_random_texts(spark, length, period, seed, hashed):
    rng = random.Random(length + seed)
    passage = ["".join(rng.choice("ab é\n") for _ in range(length + k)) for k in (-1, 0, 1, 30, 300)]
    texts = ["".join(rng.choice([*passage, *["".join(rng.choice("abcdefgh") for _ in range(40))] * 3]) for _ in range(rng.randrange(5))) for _ in range(25)]
    texts += [None, "", "x" * (length - 1), "z" * (length + 60), "z" * (length + 1), "a", texts[0], texts[0], "".join(passage) * 3, "\x00" * (length + 5)]
    texts += ["q" + "".join(passage)[1:], "".join(passage) + "\x00", "".join(passage) + "\x00\x00"]
    assert cut(spark, texts, length=length, period=period, block_bytes=900, per_task=70, text_per_task=5000, hashed=hashes(hashed)) == brute_cut(texts, length)


def test_cut_keeps_other_columns_and_text(spark):
    df = spark.createDataFrame([(1, "ab" * 200 + "é", "k", 5), (1, "ab" * 200 + "Y", None, 6), (None, None, "z", 7)], "doc_id long, text string, n_spans string, rows int")
    out = suffix_dedup.cut_repeats(df, keep_text=True).collect()
    assert sorted((r.rows, r.kept_text, r.n_spans_in, r.n_spans) for r in out) == [(5, "é", "k", 1), (6, "Y", None, 1), (7, "", "z", 0)]


def test_cut_of_an_empty_table(spark):
    assert suffix_dedup.cut_repeats(docs(spark, []).select("doc_id", "text")).count() == 0


def test_suffix_folders_go_with_the_result(spark):
    """Nothing but the kept result stays in the shared folder, suffix buckets and compared strings included."""
    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = {p.name for p in base.iterdir()}
    passage = "".join(chr(97 + k * k % 26) + str(k) for k in range(120))
    with scratch() as keep:
        kept = keep(staged(suffix_dedup.cut_repeats(docs(spark, [passage + " a", "b " + passage, "c"]).select("doc_id", "text")), "result"))
        during = {p.name.split("-")[0] for p in base.iterdir() if p.name not in before}
    assert {"classes", "compared"} <= during
    assert {p.name.split("-")[0] for p in base.iterdir() if p.name not in before} == {"result"}
    assert kept.where("n_removed > 0").count() == 2
    assert cut(spark, [None]) == brute_cut([None], 200)


# --- decontamination


def brute_hits(text, items, window=13):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        iw = words(t)
        for s in range(max(1, len(iw) - window + 1)) if iw else ():
            p = iw[s : s + window]
            for a in range(len(w) - len(p) + 1):
                if w[a : a + len(p)] == p:
                    hit |= set(range(a, a + len(p)))
                    found.add("" if i is None else str(i))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("chunk", [1 << 20, 200])
def test_decontamination(spark, chunk):
    rng = random.Random(6)
    vocab = ["the", "of", "Cat", "é", "dog", "x1", "run", "Blue"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, say(n)) for k, n in enumerate((20, 13, 12, 5, 1, 30, 14))] + [(100, None), (101, "!?"), (102, say(3)), (3, say(16)), (None, say(2)), (None, say(4)), (0, None)]
    items += items[:3]
    texts = []
    for _ in range(40):
        body = say(rng.randrange(80))
        extra = rng.choice(items)[1] or ""
        texts.append(f"{body} {extra.upper() if rng.random() < 0.3 else extra}, {say(rng.randrange(30))}")
    texts += [None, "", "...", items[0][1], items[0][1], " ".join(items[0][1].split()[:12])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(decontaminate.build_index(docs(spark, texts).drop("block"), block_bytes=600), bench, chunk_bytes=chunk).collect()}
    for i, t in enumerate(texts):  # rows that share an id, or repeat, are one item
        assert tuple(got[i])[1:][-5:] == brute_hits(t, items), t


def test_chunks_keep_columns_and_name_clashes(spark):
    bench = spark.createDataFrame([(1, "a b c"), (1, "c d e"), (2, "d e f")], "item_id long, text string")
    df = docs(spark, ["a b c d e f", "x", None]).withColumnRenamed("block", "items").withColumn("doc", F.lit("mine"))
    for chunk in (1 << 20, 70):
        out = {r.doc_id: r for r in decontaminate.decontaminated(df, bench, chunk_bytes=chunk).collect()}
        assert [(out[i].n_words, out[i].n_hit, out[i].n_items) for i in range(3)] == [(6, 6, 2), (1, 0, 0), (0, 0, 0)]
        assert [(out[i].doc, out[i]["items"]) for i in range(3)] == [("mine", 0), ("mine", 1), ("mine", 2)]


def test_a_task_of_decontamination_needs_one_python_worker(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    out = decontaminate.decontaminated(docs(spark, ["a b c d", "x", None]).drop("block"), bench, keep_text=True)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.doc_id, r.text, r.n_hit) for r in out.collect()) == [(0, "a b c d", 3), (1, "x", 0), (2, None, 0)]


def test_an_index_is_written_and_read_block_by_block(spark):
    """Spark decodes a whole row group at once; a block is about as large as a text here."""
    bench = spark.createDataFrame([(1, "x y"), (2, "y z")], "item_id long, text string")
    df = docs(spark, ["a b c " * 200_000, "x y " + "a b c " * 200_000, "a b c " * 200_000 + "y z"]).drop("block").coalesce(1)
    for out in (decontaminate.decontaminated(df, bench, keep_text=True), decontaminate.contamination(decontaminate.build_index(df), bench, chunk_bytes=70)):
        assert sorted((r.doc_id, r.n_words, r.n_hit) for r in out.select("doc_id", "n_words", "n_hit").collect()) == [(0, 600_000, 0), (1, 600_002, 2), (2, 600_002, 2)]
        groups = [m.row_group(k).num_rows for f in out.inputFiles() if "postings" in f for m in [pq.read_metadata(f.removeprefix("file:").replace("//", "/"))] for k in range(m.num_row_groups)]
        assert groups == [1, 1, 1]


def test_the_pipeline_reads_its_index_block_by_block(spark, tmp_path):
    import corpus_pipeline

    item = "a b c d e f g h i j k l m"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = "x y z " * 200_000
    df = docs(spark, [long, long + item, item]).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}).coalesce(1)
    out = corpus_pipeline.decontamination_stage(spark, df, str(tmp_path))
    assert {r.doc_id: r.text for r in out.collect()} == {0: long, 1: long + item}
    for f in out.inputFiles():
        m = pq.read_metadata(f.removeprefix("file:").replace("//", "/"))
        assert m.num_rows > 1 and all(m.row_group(k).num_rows == 1 for k in range(m.num_row_groups))


def test_phrases_never_cross_documents(spark):
    item = "a b c d e f g h i j k l m"
    out = decontaminate.decontaminated(docs(spark, ["a b c d e f g", "h i j k l m", item]).coalesce(1).drop("block"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_hit) for r in out) == [(0, 0), (1, 0), (2, 13)]


def test_proximity(spark):
    index = decontaminate.build_index(docs(spark, ["one two big three", "one two three", "three two one", "one x x x two x x x three"]).drop("block"))
    near = decontaminate.search(index, decontaminate.Phrases.of([(1, "one two three")]), slop=1).where(F.size("items") > 0)
    assert sorted(r.row.doc_id for r in near.collect()) == [0, 1]


def test_proximity_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BUDGET", 40)
    rng, slop = random.Random(12), 2
    say = lambda n: " ".join(rng.choice("a b c d e f g h".split()) for _ in range(n))
    texts, items = [say(rng.randrange(60)) for _ in range(40)], [(k, say(rng.randrange(2, 7))) for k in range(12)]

    def close(w, p):
        count = Counter(words(" ".join(texts)))
        for first in range(len(p)):  # any term that may be the rarest of its block
            for at in (i for i, x in enumerate(w) if x == p[first]):
                if all(any(w[j] == x for j in range(max(0, at - first + k - slop), min(len(w), at - first + k + slop + 1))) for k, x in enumerate(p) if k != first):
                    yield count[p[first]]

    index = decontaminate.build_index(docs(spark, texts).drop("block"))  # one block for each of three tasks
    got = {r.row.doc_id: set(r["items"]) for r in decontaminate.search(index, decontaminate.Phrases.of(items), slop=slop).collect()}
    for i, t in enumerate(texts):
        able = {str(k) for k, x in items if list(close(words(t), words(x)))}
        assert got[i] <= able
        exact = {str(k) for k, x in items if brute_hits(t, [(k, x)])[2]}
        assert exact <= got[i]


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.decontaminated(docs(spark, []).drop("block"), bench).count() == 0
    assert decontaminate.decontaminated(docs(spark, ["a b"]).drop("block"), bench.limit(0)).first().contaminated is False
    clash = docs(spark, ["a b c"]).withColumn("n_hit", F.lit("mine")).drop("block")
    r = decontaminate.decontaminated(clash, bench, keep_text=True).first()
    assert (r.n_hit_in, r.n_hit, r.text) == ("mine", 2, "a b c")


# --- near duplicates


def shingles(t):
    w = words(t)
    return list(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else [tuple(w)] if w else []


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def test_alignment_is_exact_at_the_threshold():
    rng = random.Random(8)
    for _ in range(300):
        a = [rng.randrange(6 if rng.random() < 0.5 else 400) for _ in range(rng.randrange(1, 60))]
        b = [x for x in a if rng.random() > 0.1]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(400))
        if not b:
            continue
        m = longest_common(a, b)
        exact = m / (len(a) + len(b) - m)
        got = near_dedup.similarity(np.array(a, np.uint32), np.array(b, np.uint32))
        assert got <= exact + 1e-12 and (exact < 0.8 or abs(got - exact) < 1e-12)


def brute_classes(texts):
    s = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if s[i] and s[j] and min(len(s[i]), len(s[j])) >= 0.8 * max(len(s[i]), len(s[j])):
            m = longest_common(s[i], s[j])
            if m >= 0.8 * (len(s[i]) + len(s[j]) - m):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def near_texts():
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(4):
        base = [rng.choice(vocab) for _ in range(rng.choice((60, 90)))]
        texts.append(" ".join(base))
        for _ in range(14):  # copies with none to many changes: classes chain, and outliers stay outside
            c = base[:]
            for _ in range(rng.choice((0, 1, 1, 2, 3, 5, 8))):
                at = rng.randrange(len(c))
                c[at : at + rng.randrange(2)] = [rng.choice(vocab)] * rng.randrange(2)
            texts.append(" ".join(c))
    return [*texts, None, "", "...", "one two", "One, two!", "one three", "x y z " * 40, "x y z " * 41, "a " * 5000]


@pytest.mark.parametrize("cell", [3, 512])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(near_dedup, "CELL", cell)
    texts = near_texts()
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs(spark, texts).drop("block")).collect()}
    want = brute_classes(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    sizes = Counter(want)
    assert all(got[i].class_size == sizes[want[i]] and got[i].kept == (want[i] == i) for i in range(len(texts)))


def test_near_duplicates_of_odd_tables(spark):
    assert near_dedup.near_duplicates(docs(spark, []).drop("block")).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, "a b c d e f", "z"), (3, None, "n"), (4, None, "n")], "doc_id long, text string, class_id string")
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in near_dedup.near_duplicates(df).collect()) == [(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 1)]
    left = near_dedup.first_of_each_class(df)
    assert left.columns == df.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 3, 4]


def test_an_id_with_two_texts_keeps_the_one_it_was_judged_by(spark):
    texts = ["a b c d e f g", "h i j k l m n", "o p q r s t u", "v w x y z a b", " !"]
    digest = {r.id: r.digest for r in near_dedup.signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").collect()}
    judged = texts[min(range(4), key=digest.get)]
    for rows in (texts, texts[::-1], texts[2:] + texts[:2]):
        # 5 copies the judged text and goes; 2 copies another text of id 1, which id 1 is not judged by, and stays
        other = next(t for t in texts[:4] if t != judged)
        df = spark.createDataFrame([*((1, t, "x") for t in rows), (1, judged, "w"), (2, other, "y"), (5, judged, "z"), (6, "c c d d e e f f", "p"), (6, "c c d d e e f f", "p")], "doc_id long, text string, source string").coalesce(1)
        left = near_dedup.first_of_each_class(df)
        assert left.columns == df.columns
        assert sorted(left.collect()) == [(1, judged, "w"), (2, other, "y"), (6, "c c d d e e f f", "p")]


def test_components(spark):
    links = [(1, 2), (2, 1), (3, 2), (9, 8), (8, 7), (7, 6), (5, 5), (None, 1), (20, 9)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k < 100} == {1: 1, 2: 1, 3: 1, 9: 6, 8: 6, 7: 6, 6: 6, 20: 6}
    assert {v for k, v in got.items() if k >= 100} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [5.0, 5.0]), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (41, [3.0, 2.0, 1.0])]
    got = ann.nearest_vectors(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=3).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r.query_id].append((r.vec_id, r.score))
    assert by[0] == [(9, 5.0), (1, 1.0), (2, 1.0)]
    assert by[20] == [(9, 10.0), (0, 0.0), (1, 0.0)]
    assert by[40] == [(41, 10.0)] and set(by) == {0, 20, 40}
    twice = ann.nearest_vectors(vectors(spark, [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0])]), F.col("vec_id") == 0, k=5).collect()
    assert [(r.vec_id, r.score) for r in sorted(twice, key=lambda r: r["rank"])] == [(1, 2.0), (1, 2.0)]
    assert ann.nearest_vectors(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("scaled", [False, True])
def test_recall(spark, scaled):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x = x * rng.uniform(0.2, 3, size=(3000, 1)).astype(np.float32) if scaled else x / np.linalg.norm(x, axis=1, keepdims=True)
    got = ann.nearest_vectors(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 20 == 0).collect()
    found = defaultdict(set)
    for r in got:
        found[r.query_id].add(r.vec_id)
        assert abs(r.score - float(x[r.vec_id].astype(float) @ x[r.query_id].astype(float))) < 1e-9
    recall = []
    for q in range(0, 3000, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        recall.append(len(found[q] & set(np.lexsort((np.arange(3000), -s))[:20])) / 20)
    assert np.mean(recall) >= 0.9


def test_copies_tie_whatever_their_place(spark):
    """A matrix product rounds equal rows differently by their place; copies have to score equally all the same."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1203, 64)).astype(np.float32)
    x[rng.random(1203) < 0.4] = x[7]
    x[rng.random(1203) < 0.1] = 3 * x[7]
    got = defaultdict(list)
    for r in sorted(ann.exact_nearest(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 20 == 0).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    wide = x.astype(float)
    for q in range(0, 1203, 20):
        s = (wide * wide[q]).sum(1)
        s[q] = -np.inf
        assert got[q] == [(i, s[i]) for i in np.lexsort((np.arange(1203), -s))[:20]]


def test_footrule_is_the_sum_of_place_differences():
    rng = np.random.default_rng(1)
    places = np.argsort(rng.random((30, 12)), axis=1)[:, :5].astype(np.int16)
    got = ann.InvertedFiles(*ann.posted(places, 12), len(places)).footrule(places[7])

    def rank(p):
        return [list(p).index(k) + 1 if k in p else 6 for k in range(12)]

    assert got.tolist() == [sum(abs(a - b) for a, b in zip(rank(places[7]), rank(p))) for p in places]


# --- the pipeline


def test_pipeline_against_brute_force(spark, data):
    import corpus_pipeline
    import public_tokenizers
    import sentencepiece

    from tracelane.llm import language_id

    base = spark.read.parquet(f"{data}/documents.parquet").limit(120)
    docs_ = base.unionByName(base.limit(5).withColumn("doc_id", F.col("doc_id") + 10_000)).unionByName(spark.createDataFrame([(20_000, "12 34", "en", "s", 5), (20_001, None, None, None, None)], base.schema))
    frame, steps = docs_, {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, data)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-{name}"
        frame.write.mode("overwrite").parquet(path)
        frame = spark.read.parquet(path)
        steps[name] = {r.doc_id: r for r in frame.collect()}
    before = {r.doc_id: r for r in docs_.collect()}
    assert before.keys() - steps["language_id"].keys() == {20_000, 20_001}
    ids = sorted(steps["language_id"])
    classes = brute_classes([before[i].text for i in ids])
    assert sorted(steps["near_dedup"]) == [ids[k] for k, c in enumerate(classes) if c == k]
    left = sorted(steps["near_dedup"])
    for (n, gone, _, sha), i in zip(brute_cut([before[i].text for i in left], 200), left):
        text = steps["suffix_dedup"][i].text
        assert len(text.encode()) <= n - gone and steps["suffix_dedup"][i].n_chars == len(text)
        if gone == 0:
            assert hashlib.sha256(text.encode()).hexdigest() == sha
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert steps["suffix_dedup"].keys() - steps["decontamination"].keys() == {i for i, r in steps["suffix_dedup"].items() if brute_hits(r.text, items)[4]}
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, r in steps["piece_coding"].items():
        assert r.n_tokens == len(lib.encode(steps["decontamination"][i].text))
    assert steps["piece_coding"].keys() == steps["decontamination"].keys()
    assert language_id.PROFILE == 400


def test_queries_run_over_whole_tables(spark, data):
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    for name in ("op1_token_counts", "op5_license_scan", "op9_piece_coding", "op10_language_id"):
        assert queries.QUERIES[name](spark, data).count() == n


def test_recall_of_the_index_in_small_tables(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 24))
    df = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    found, exact = ({(r.query_id, r.vec_id) for r in f(df, F.col("vec_id") % 20 == 0).collect()} for f in (ann.nearest_vectors, ann.exact_nearest))
    assert len(found) == len(exact) == 600 and len(found & exact) >= 0.9 * 600
