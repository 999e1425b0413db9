"""Hand-computed request records, ids, keys and text."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelane.functions import aggregates as ag, arrays as ar, coerce as co, ids, text as tx
from tracelane.operators import keys, matching, pairing, requests as rq, rollups
from tracelane.sources import lines as ln, profiles


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first().asDict()


def lit(x):
    return F.lit(x)


def test_units(spark):
    got = one(spark, a=co.duration_ms(lit("1.25"), lit("s")), b=co.duration_ms(lit(750000), lit("us")), c=co.duration_ms(lit(10000000), lit("ns")), d=co.duration_ms(lit(5), path=lit("x.latency_s")), e=co.duration_ms(lit(5)), f=co.duration_ms(lit(True)), g=co.duration_ms(lit(5), lit(" Secs ")), h=co.duration_ms(lit(5000), lit("µs")), i=co.duration_ms(lit(5), lit("parsec"), lit("x_s")), j=co.duration_ms(lit(5), path=lit("x-s")))
    assert got == {"a": 1250.0, "b": pytest.approx(750.0), "c": pytest.approx(10.0), "d": 5000.0, "e": 5.0, "f": None, "g": 5000.0, "h": pytest.approx(5.0), "i": 5000.0, "j": 5.0}


def test_nanoseconds_stay_exact(spark):
    n = 1784630947472644248
    got = one(spark, a=co.epoch_ns(lit(n)), b=co.epoch_ns(lit(str(n)), lit("ns")), c=co.epoch_ns(lit(1784630947)), d=co.epoch_ns(lit(1784630947472)), e=co.epoch_ns(lit("1784630947.5")), f=co.epoch_ns(lit("x")))
    assert got == {"a": n, "b": n, "c": 1784630947 * 10**9, "d": 1784630947472 * 10**6, "e": 1784630947500000000, "f": None}


def test_coercion(spark):
    got = one(spark, a=co.number(lit(" 12 ")), b=co.number(lit("nan")), c=co.number(lit("inf")), d=co.number(lit(True)), e=co.whole(lit("-3.9")), f=co.integral(lit("3.9")), g=co.integral(lit("4.0")), h=co.truth(lit(" YES ")), i=co.truth(lit("0.0")), j=co.truth(lit("maybe")), k=co.truth(lit("")), m=co.whole(lit("9223372036854775807")))
    assert got == {"a": 12.0, "b": None, "c": None, "d": None, "e": -3, "f": None, "g": 4, "h": True, "i": False, "j": None, "k": False, "m": 9223372036854775807}


def test_ratios_need_both_sides(spark):
    got = one(spark, a=co.ratio(lit(1.0), lit(0.0)), b=co.ratio(lit(None), lit(2)), c=co.ratio(lit(1), lit(2)))
    assert got == {"a": None, "b": None, "c": 0.5}


def test_errors(spark):
    got = one(spark, a=co.error_present(lit("[]")), b=co.error_present(lit("{}")), c=co.error_present(lit(None).cast("string"), lit(" Failed")), d=co.error_category(lit('{"message":"late\\nmore"}')), e=co.error_category(lit("x" * 300)))
    assert got == {"a": True, "b": False, "c": True, "d": "late", "e": "x" * 200}
    got = one(spark, a=co.error_present(lit(None).cast("string"), lit("timeout")), b=co.error_category(lit("x"), lit(" Failed ")), c=co.error_category(lit('{"other":1}')), d=co.error_category(lit("a\nb")), e=co.error_present(lit("none")), f=co.error_present(lit(" ")), g=co.error_category(lit(" ")))
    assert got == {"a": False, "b": "failed", "c": "error_present", "d": "a\nb", "e": False, "f": True, "g": "error_present"}


FORMS = {"abc": "root", "abc::sa:agent_001": "subagent_main", "abc::sa:agent:fa:000": "fanout", "abc::sa:agent:aux:000": "auxiliary", "abc::sa:agent:wg:001_002": "worker_group", "abc::fa:000": "fanout", "abc::aux:000": "auxiliary"}


def test_conversation_ids(spark):
    df = spark.createDataFrame([(k,) for k in FORMS], "c string").select("c", ids.root_id("c").alias("root"), ids.branch_class("c").alias("branch"), ids.branch_path("c").alias("path"))
    got = {r.c: r for r in df.collect()}
    assert all(r.root == "abc" and r.branch == FORMS[c] for c, r in got.items())
    assert got["abc::sa:agent:fa:000"].path == "abc::sa:agent" and got["abc::fa:000"].path == "abc"


# conversation id: (root, suffix, class, rule, path)
PARSED = {
    "abc": ("abc", "root", "root", "identity", "abc"),
    " abc ": ("abc", "root", "root", "identity", "abc"),
    "abc::sa:agent_001": ("abc", "::sa:agent_001", "subagent_main", "split_before_first_sa", "abc::sa:agent_001"),
    "abc::sa:agent:FA:000": ("abc", "::sa:agent:FA:000", "fanout", "split_before_first_sa", "abc::sa:agent"),
    "abc::sa:": ("abc", "::sa:", "unknown", "split_before_first_sa", None),
    "abc::sa::x": ("abc", "::sa::x", "unknown", "split_before_first_sa", "abc::sa:x"),
    "::sa:x": (None, "::sa:x", "unknown", "invalid_empty_root_before_sa", None),
    "abc::fa:003": ("abc", "::fa:003", "fanout", "split_direct_fanout_suffix", "abc"),
    "abc::aux:1": ("abc", "::aux:1", "auxiliary", "split_direct_auxiliary_suffix", "abc"),
    "a::wg:1::fa:2": ("a::wg:1", "::fa:2", "fanout", "split_direct_fanout_suffix", "a::wg:1"),
    "::fa:1": ("::fa:1", "root", "root", "identity", "::fa:1"),
    "": (None, None, "unknown", "missing_conversation_id", None),
    None: (None, None, "unknown", "missing_conversation_id", None),
}


def test_parsed_conversation_ids(spark):
    df = spark.createDataFrame([(k,) for k in PARSED], "c string")
    got = df.select("c", ids.root_id("c"), ids.branch_suffix("c"), ids.branch_class("c"), ids.root_rule("c"), ids.branch_path("c")).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == PARSED


ROOTS = {
    "abc": ["abc"], "abc__replay_7": ["abc__replay_7", "abc"], "abc#dup-2": ["abc#dup-2", "abc"], "abc|repeat3": ["abc|repeat3", "abc"], "abc__DUP_2_3": ["abc__DUP_2_3", "abc"], "abc::session:9": ["abc::session:9", "abc"],
    "abc__worker-a_b": ["abc__worker-a_b", "abc"], "abc#instance4": ["abc#instance4", "abc"], "abc__copy": ["abc__copy"], "abc__replay_": ["abc__replay_"], "__dup1": ["__dup1"], "abc__replayx!": ["abc__replayx!"], "::sa:x": [], None: [],
}


def test_candidate_roots(spark):
    df = spark.createDataFrame([(k,) for k in ROOTS], "c string").select("c", ids.candidate_roots("c").alias("x"))
    assert {r.c: [x.root for x in r.x] for r in df.collect()} == ROOTS


NAMES = {
    "agentic_conc8_x": ("raw_agentic", 8), "bmk-agentic-conc16": ("aggregated_agentic", 16), "bmkagentic": ("aggregated_agentic", None), "x_agentic_8conc": ("raw_agentic", 8), "server_logs_c8": ("server_log", 8), "results_bmk": ("run_summary", None),
    "run-stats": ("run_summary", None), "concurrency-4.c_4": ("other", 4), "c.8": ("other", 8), "conc8_16concurrent": ("other", None), "users16": ("other", None), "abc8": ("other", None), "conc0": ("other", None), "conc008": ("other", 8), "": ("other", None), None: ("other", None),
}


def test_artifact_names(spark):
    df = spark.createDataFrame([(k,) for k in NAMES], "c string").select("c", ids.artifact_category("c"), ids.name_concurrency("c"))
    assert {r[0]: tuple(r[1:]) for r in df.collect()} == NAMES


COUNTED = {
    "batch_size=8 Batch-Size: 9": [("batch_size", 8.0, True), ("batch_size", 9.0, True)], "running-requests=7": [("running_requests", 7.0, True)], "num_running_reqs: 3.5": [("running_requests", 3.5, True)],
    "max waiting reqs: 4": [("configured_max_waiting_requests", 4.0, False)], "max-running-requests=9 running requests = 2": [("configured_max_running_requests", 9.0, False), ("running_requests", 2.0, True)],
    "tokens=5 token_usage: 0.25 num_tokens=-1": [("token_load", 5.0, True), ("token_load", -1.0, True), ("token_usage", 0.25, True)], "xrunning_requests=1 queue_reqs=2": [], "": [], None: None,
}


def test_counters(spark):
    df = spark.createDataFrame([(k,) for k in COUNTED], "c string").select("c", tx.counters("c").alias("x"))
    assert {r.c: r.x and [tuple(x) for x in r.x] or r.x for r in df.collect()} == COUNTED


def test_replay_suffix_needs_a_known_root(spark):
    df = spark.createDataFrame([("abc__replay_7::sa:a",), (None,)], "c string")
    known = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = {r.c: r for r in ids.resolve_roots(df, known("abc", "zzz"), "c").collect()}
    assert (got["abc__replay_7::sa:a"].root_trace_id, got["abc__replay_7::sa:a"].root_known) == ("abc", True)
    assert got[None].root_trace_id is None and not got[None].root_known
    assert ids.resolve_roots(df, known("zzz"), "c").where("c is not null").first().root_trace_id == "abc__replay_7"


def test_explicit_root_wins(spark):
    df = spark.createDataFrame([("abc", "given"), ("abc", " ")], "c string, m string")
    got = sorted(r.root_trace_id for r in ids.resolve_roots(df, spark.createDataFrame([("abc",)], "id string"), "c", "m").collect())
    assert got == ["abc", "given"]


def test_names(spark):
    got = one(spark, a=ids.name_concurrency(lit("run-conc8-raw")), b=ids.name_concurrency(lit("conc8_users4")), c=ids.name_concurrency(lit("none")), d=ids.artifact_category(lit("bmk_agentic_x")), e=ids.path_concurrency(lit("/x/conc2/y/c4/f.json")))
    assert got == {"a": 8, "b": 8, "c": None, "d": "aggregated_agentic", "e": 4}


GOOD = {"benchmark_phase": "profiling", "error_present": False, "was_cancelled": False, "input_tokens": 100.0, "output_tokens": 11.0, "ttft_ms": 100.0, "e2e_ms": 600.0, "itl_ms": 50.0}


def requests(spark, *changes):
    rows = [json.dumps({**GOOD, "record_ordinal": i, **c}) for i, c in enumerate(changes)]
    schema = "record_ordinal long, benchmark_phase string, error_present boolean, was_cancelled boolean, input_tokens double, output_tokens double, ttft_ms double, e2e_ms double, itl_ms double, concurrency int, root_trace_id string, conversation_id string, session_num long, turn_index long, artifact_id string, request_start_ns long, source_file_path string"
    return spark.createDataFrame([(r,) for r in rows], "v string").select(F.from_json("v", schema).alias("x")).select("x.*")


def test_filter_reasons(spark):
    df = requests(spark, {}, {"benchmark_phase": "warmup"}, {"error_present": True}, {"was_cancelled": True}, {"input_tokens": -1.0}, {"benchmark_phase": None}, {"ttft_ms": None}, {"ttft_ms": 0.0}, {"e2e_ms": None}, {"e2e_ms": -1.0}, {"output_tokens": None}, {"itl_ms": None})
    reasons = [r.exclusion_reason for r in rq.with_reasons(df).orderBy("record_ordinal").collect()]
    assert reasons == [None, "not_profiling_phase", "error_present", "was_cancelled", "negative_token_count", None, "missing_ttft", "nonpositive_ttft", "missing_e2e", "nonpositive_e2e", "missing_token_count", None]
    strict = [r.exclusion_reason for r in rq.with_reasons(df, require_phase=True, require_itl=True).orderBy("record_ordinal").collect()]
    assert (strict[5], strict[11]) == ("missing_benchmark_phase", "missing_itl")


def test_duplicates_are_opt_in_and_ignore_the_origin(spark):
    df = requests(spark, {}, {"source_file_path": "other"}, {"session_num": 1}, {"artifact_id": "x"})
    assert rq.profiled(df).count() == 4
    assert [r.exclusion_reason for r in rq.with_reasons(df, exclude_duplicates=True).orderBy("record_ordinal").collect()] == [None, "exact_duplicate", None, None]
    assert [r.seen_before for r in rq.with_fingerprint(df).orderBy("record_ordinal").collect()] == [False, True, False, False]


def test_metrics(spark):
    a, b, c = rq.add_metrics(requests(spark, {}, {"input_tokens": 1.0, "output_tokens": 1.0, "ttft_ms": 50.0, "e2e_ms": 40.0, "itl_ms": 0.0}, {"e2e_ms": None})).orderBy("record_ordinal").collect()
    assert (a.ttft_s, a.post_ttft_ms, a.itl_tps, a.post_ttft_tps, a.e2e_tps, a.input_per_ttft_s) == pytest.approx((0.1, 500.0, 20.0, 20.0, 11 / 0.6, 1000.0))
    assert b.ttft_exceeds_e2e and b.itl_tps is None and b.post_ttft_tps is None and b.post_ttft_ms == 0
    assert c.post_ttft_ms is None and c.e2e_tps is None and c.ttft_exceeds_e2e is None


def test_summary_measures(spark):
    df = requests(spark, {"output_tokens": 3.0, "itl_ms": 10.0, "e2e_ms": 30.0}, {"output_tokens": 5.0, "itl_ms": 20.0, "e2e_ms": 100.0})
    df = df.withColumns({"request_start_ns": F.col("record_ordinal") * 10, "request_end_ns": F.when(F.col("record_ordinal") == 0, 30 * 10**9).otherwise(40 * 10**9)})
    r = rollups.summarize(df, []).first()
    assert r.weighted_itl_ms == pytest.approx((10 * 2 + 20 * 4) / 6) and r.output_tps == pytest.approx(8 / 40) and r.n_requests == 2


def test_sums_of_nothing(spark):
    none = spark.createDataFrame([(None,)], "x double")
    assert none.agg(ag.sum_or_zero("x").alias("a"), ag.sum_or_null("x").alias("b"), ag.exact_percentile("x", 0.5).alias("c")).first() == (0.0, None, None)


def test_percentile_is_linear(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,), (float("nan"),)], "x double")
    assert df.agg(ag.exact_percentile("x", [0.5, 0.9]).alias("p")).first().p == pytest.approx([2.0, 3.6])


def test_weighted_quantiles_never_interpolate(spark):
    df = spark.createDataFrame([(1, 99), (9, 1), (5, 0)], "v int, w int")
    assert ag.weighted_quantiles(df, [], "v", "w", {"a": 0.95, "b": 0.99, "c": 0.995}).first() == (1, 1, 9)


def test_spearman_guards(spark):
    df = spark.createDataFrame([("k", 1.0, 2.0), ("k", 2.0, 2.0), ("k", 3.0, 2.0), ("m", 1.0, 3.0), ("m", 2.0, 2.0), ("m", 2.0, 1.0), ("n", 1.0, 1.0)], "g string, x double, y double")
    got = {r.g: r.rho for r in ag.spearman(df, ["g"], "x", "y").collect()}
    assert got["k"] is None and got["n"] is None and got["m"] == pytest.approx(-0.8660254)


def test_identity_and_source_keys(spark):
    got = one(spark, a=ids.source_key(lit("abc"), lit(4), lit(None)), b=ids.source_key(lit(None), lit(4), lit(1)), c=ids.joined_key(lit("x"), lit(None)))
    assert got == {"a": "abc|4|-1", "b": None, "c": "x|<null>"}


def test_common_prefix(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<long>")
    got = one(spark, a=ar.common_prefix(arr(), arr()), b=ar.common_prefix(arr(1, 2, 3), arr(1, 2, 4)), c=ar.common_prefix(arr(1), arr(2)), d=ar.common_prefix(arr(0, 1), arr(0, 1, 2)), e=ar.common_prefix(F.lit(None).cast("array<long>"), arr(1)))
    assert got == {"a": 0, "b": 2, "c": 0, "d": 2, "e": None}


def test_only_unique_keys_match(spark):
    left = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "k string, n int")
    right = spark.createDataFrame([("a", 10), ("b", 20), ("b", 21), (None, 30)], "k string, v int")
    got = {r.k: (r.val, r.turn_matched) for r in matching.exact_turns(left, right, {"k": "k"}, {"v": "val"}).collect()}
    assert got == {"a": (10, True), "b": (None, False), None: (None, False)}


def test_loader_join(spark):
    req = spark.createDataFrame([("abc", "abc", "abc", 4, None, 9, 100.0, 5.0), ("abc", "abc", "abc", 5, None, 9, 1.0, 5.0), ("zzz", "zzz", None, None, None, 1, 1.0, 1.0)], "root_trace_id string, request_path string, source_trace_id string, source_outer_idx long, source_inner_idx long, turn_index long, input_tokens double, output_tokens double")
    src = spark.createDataFrame([("abc", "abc", 0, 4, None, 100, 5, "root"), ("abc", "abc", 1, 5, None, 100, 6, "root")], "root_trace_id string, source_conversation_path string, source_branch_request_index long, source_outer_request_index long, source_inner_request_index long, source_input_tokens long, source_output_tokens long, source_branch_type string")
    got = {(r.source_outer_idx): (r.loader_key, r.match_class, r.input_same, r.output_same) for r in matching.match_turns(req, src).collect()}
    assert got[4] == ("abc|4|-1", "exact_turn_match", True, True)
    assert got[5] == ("abc|5|-1", "loader_metadata_turn_match", False, False)
    assert got[None][1] == "unmatched"


def test_coverage(spark):
    seen = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("unmatched", 2)], "root string, c int")
    got = {r.root: (r.n_1, r.n_2) for r in matching.presence_matrix(spark.createDataFrame([("a",), ("b",), ("c",)], "u string"), seen, "root", "c", [1, 2]).collect()}
    assert got == {"a": (2, 0), "b": (0, 1), "c": (0, 0), "unmatched": (0, 1)}


def test_pairs(spark):
    df = spark.createDataFrame([("k", 8, 4.0, 10.0, 5.0), ("k", 12, 4.0, 20.0, 10.0)], "key string, concurrency int, output_tokens double, ttft_ms double, itl_ms double")
    p = pairing.pair_ratios(pairing.strict_flags(pairing.all_pairs(df, ["key"], "concurrency", ["output_tokens", "ttft_ms", "itl_ms"])), ["ttft_ms", "itl_ms"]).collect()
    assert len(p) == 1 and p[0].ttft_ms_ratio == 2 and p[0].strict_decode and p[0].strict_ttft
    b = pairing.against_baseline(df, ["key"], "concurrency", ["ttft_ms"], keep_self=False).collect()
    assert [(r.concurrency, r.baseline_concurrency, r.ttft_ms_ratio) for r in b] == [(12, 8, 2.0)]
    s = pairing.compare_systems(df.where("concurrency = 12"), df.where("concurrency = 12"), "key", ["ttft_ms"], (1, 2)).first()
    assert s.worker_normalized_ratio == 0.5


def test_null_keys_pair_only_if_asked(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0)], "key string, g int, v double")
    assert pairing.all_pairs(df, ["key"], "g", ["v"]).count() == 0 and pairing.all_pairs(df, ["key"], "g", ["v"], null_safe=True).count() == 1


def test_bootstrap_is_repeatable(spark):
    df = spark.createDataFrame([(1, f"c{k % 5}", 1.0 + k / 10) for k in range(20)] + [(1, "c9", None), (1, "c9", -1.0)], "g int, c string, v double")
    a, b = (pairing.bootstrap_ratio(df, "c", "v", ["g"], 50).first() for _ in range(2))
    assert a == b and a.n_clusters == 5 and a.ci_low <= a.median_ratio <= a.ci_high


def test_bootstrap_against_copies(spark):
    """Every draw as a copy of its cluster's rows; ties, ranges of few values, a cluster with most rows."""
    rows = [(g, f"c{(k * k) % 11 if k % 3 else 4}", float((k * 37) % 90 + 1)) for g in (1, 2) for k in range(150 * g)]
    df = spark.createDataFrame([*rows, (1, None, 5.0), (3, "c", None)], "g int, c string, v double")
    got = {r.g: r for r in pairing.bootstrap_ratio(df, "c", "v", ["g"], 40, width=4).collect()}
    assert set(got) == {1, 2}
    for g, r in got.items():
        names = sorted({c for h, c, _ in rows if h == g})
        medians = []
        for rep in range(40):
            drawn = [names[int(hashlib.md5(f"7|{g}|{rep}|{slot}".encode()).hexdigest()[:8], 16) % len(names)] for slot in range(len(names))]
            medians.append(np.median([v for name in drawn for h, c, v in rows if (h, c) == (g, name)]))
        want = (sum(h == g for h, _, _ in rows), len(names), np.median([v for h, _, v in rows if h == g]), *np.quantile(medians, [0.025, 0.975]))
        assert tuple(r)[1:] == pytest.approx(want)


COMPLETED = '2026-08-08T04:51:24.454472Z request completed request_id=a1b2-c3 x_request_id="d4e5-f6" prefill_worker_id=2787 decode_worker_id=2792'
WAITED = '2026-08-08T04:51:25.454472Z dynamo_kv_router::scheduling::queue: refreshed overlap scores after long queue wait request_id="a1b2-c3" wait_ms=13932'


def test_scheduler_lines(spark):
    got = one(spark, c=tx.counters(lit("\x1b[31mmax_running_requests=200 running_requests=7 waiting_reqs: 2 running_requests=7\x1b[0m")), d=tx.completion(lit(COMPLETED)), e=tx.queue_wait(lit(WAITED)), f=tx.line_stamp(lit("at 2024-01-01T00:00:00.5Z x")))
    assert sorted((r.name, r.value, r.observed) for r in got["c"]) == [("configured_max_running_requests", 200, False), ("running_requests", 7, True), ("waiting_requests", 2, True)]
    assert tuple(got["d"]) == ("a1b2-c3", "d4e5-f6", "2787", "2792") and tuple(got["e"]) == ("a1b2-c3", 13932.0) and got["f"] == "2024-01-01T00:00:00.5Z"


def test_labels(spark):
    got = one(spark, a=tx.index_ranges(F.array(*map(F.lit, (5, 1, 2, 3)))), b=tx.model_list(lit('["x","y"]')), c=tx.model_list(lit("z")), d=tx.precision(lit("w-FP8-kv")), e=tx.component(lit("backend")), f=tx.rank_label(lit("1"), lit(None)))
    assert got == {"a": "1-3;5", "b": ["x", "y"], "c": ["z"], "d": "fp8", "e": "decode", "f": "tp1"}


RECORDS = [
    {"metadata": {"conversation_id": "trace-a::sa:agent:fa:000", "benchmark_phase": "profiling", "request_start_ns": 1784630947472644248, "session_num": 3}, "metrics": {"input_sequence_length": {"value": 100, "unit": "tokens"}, "output_sequence_length": {"value": 5}, "time_to_first_token": {"value": 1.25, "unit": "s"}, "request_latency": {"value": 750000, "unit": "us"}, "decode_duration": {"value": 40, "unit": "ms"}}, "error": None},
    {"metadata": {"benchmark_phase": "warmup"}, "metrics": {}, "error": None},
    {"metadata": {"benchmark_phase": "profiling"}, "metrics": {}, "error": {"type": "Timeout"}},
    {"metadata": {"benchmark_phase": "profiling", "was_cancelled": True}, "metrics": {}},
    {"metadata": {"conversation_id": "t"}, "metrics": {"input_sequence_length": 1, "output_sequence_length": 2, "time_to_first_token": 3, "request_latency": 4, "inter_token_latency": 1}},
]


def test_profiles(spark, tmp_path):
    folder = tmp_path / "run" / "conc4"
    folder.mkdir(parents=True)
    (folder / "profile_export.jsonl").write_text("\n".join([json.dumps(RECORDS[0]), "", "not json", "[1]", *map(json.dumps, RECORDS[1:])]) + "\n")
    p = profiles.read_profiles(spark, str(tmp_path))
    r = p.orderBy("record_ordinal").first()
    assert (r.record_ordinal, r.concurrency, r.root_trace_id, r.branch_type, r.request_start_ns, r.ttft_ms, r.e2e_ms, r.itl_ms) == (1, 4, "trace-a", "fanout", 1784630947472644248, 1250.0, pytest.approx(750.0), 10.0)
    got = {x.record_ordinal: x.exclusion_reason for x in rq.with_reasons(p).collect()}
    assert got == {1: None, 5: "not_profiling_phase", 6: "error_present", 7: "was_cancelled", 8: None}
    found = ln.issues(ln.numbered(spark, str(folder))).orderBy("line_no").collect()
    assert [(x.line_no, x.issue) for x in found] == [(3, "malformed_json"), (4, "not_an_object")]
    with pytest.raises(Exception, match="malformed_json"):
        ln.json_lines(ln.numbered(spark, str(folder)), strict=True).collect()


def test_line_numbers_across_splits(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {k} {'x' * (k % 50)}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = ln.numbered(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 5000 and all(r.value.split()[1] == str(r.line_no - 1) for r in rows)
    found = {r.name: r for r in ln.evidence(ln.numbered(spark, str(tmp_path)), {"a": "line 42 ", "b": "absent"}).collect()}
    assert (found["a"].status, found["a"].line_no, found["b"].status) == ("found", 43, "not_found")


def test_key_rules(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "k string, v int")
    assert [r.k for r in keys.only_unique(df, ["k"]).collect()] == ["b"]
    assert {r.k: r.v for r in keys.last_per_key(df, ["k"], ["v"]).collect()} == {"a": 2, "b": 1, None: 1}
    assert keys.conflicts(df, "k", ["v"]).first().k == "a"
    with pytest.raises(ValueError, match="repeated key"):
        keys.require_unique(df, ["k"])
