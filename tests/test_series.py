"""Hand-computed intervals, rank gauges, traces, reconciliation, sources and sinks, streams."""

from __future__ import annotations

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelane.operators import intervals as iv, pairing, ranks as rk, reconcile as rc, relations, routing, schema_inventory as si, traces as tr
from tracelane.sources import files, sinks
from tracelane.sources.lines import numbered


def lanes(spark, *rows):
    data = [(i, 1, s, e, b[0] if b else None) for i, (s, e, *b) in enumerate(rows)]
    return spark.createDataFrame(data, "id long, lane int, request_start_ns long, request_end_ns long, source_branch_type string")


def test_ends_come_before_starts(spark):
    df = lanes(spark, (0, 10), (10, 20))
    st = iv.states(df, ["lane"]).orderBy("at_ns").collect()
    assert [(r.at_ns, r.in_flight) for r in st] == [(0, 1), (10, 1), (20, 0)]
    c = iv.contexts(df, ["lane"], "id").orderBy("id").collect()
    assert (c[1].before_start, c[1].at_start) == (0, 1)


def test_starts_at_one_time_share_their_context(spark):
    c = iv.contexts(lanes(spark, (0, 20), (10, 30), (10, 40)), ["lane"], "id").orderBy("id").collect()
    assert [(r.before_start, r.at_start) for r in c] == [(0, 1), (1, 3), (1, 3)]
    assert [(r.before_end, r.after_end) for r in c] == [(3, 2), (2, 1), (1, 0)]


@pytest.mark.parametrize("chunk", [None, 7, 1000])
def test_time_weighted_load(spark, chunk):
    df = lanes(spark, (0, 100), (0, 10))
    s = iv.load_summary(iv.state_intervals(df, ["lane"], chunk_ns=chunk), ["lane"]).first()
    assert (s["max"], s["mean"], s["p50"], s["p90"]) == (2, pytest.approx(1.1), 1, 1)
    top = iv.states(lanes(spark, (0, 30, "root"), (5, 20, "subagent"), (10, 15, "fanout")), ["lane"], chunk_ns=chunk).agg(F.max("in_flight"), F.max("in_flight_root"), F.max("in_flight_subagent")).first()
    assert tuple(top) == (3, 1, 2)


def test_contexts_of_all_requests(spark, data):
    from tracelane.plans import registry
    from tracelane.plans.adapter import requests

    r = requests(spark, data).where("request_end_ns > request_start_ns").select("record_ordinal", "concurrency", "request_start_ns", "request_end_ns").collect()
    lane: dict = {}
    for x in r:
        lane.setdefault(x.concurrency, []).append((x.record_ordinal, x.request_start_ns, x.request_end_ns))
    want = {}
    for x in r:
        o, s, e = x.record_ordinal, x.request_start_ns, x.request_end_ns
        others = lane[x.concurrency]
        want[o] = (
            sum(b < s < f for _, b, f in others), sum(b <= s < f for _, b, f in others),
            sum(b < e and (f > e or f == e and k >= o) for k, b, f in others),
        )
    got = registry.QUERIES["all_request_contexts"](spark, data).collect()
    assert len(got) == len(want)
    assert {x.record_ordinal: (x.before_start, x.at_start, x.before_end) for x in got} == want


def test_invalid_intervals(spark):
    df = lanes(spark, (0, 10), (10, 10), (20, 15), (30, None))
    assert [r.reason for r in df.orderBy("id").select(iv.invalid_reason().alias("reason")).collect()] == [None, "nonpositive_request_interval", "nonpositive_request_interval", "missing_request_end_ns"]
    assert iv.contexts(df, ["lane"], "id").count() == 1


@pytest.mark.parametrize("width", [1, 3, 10, 1000])
def test_overlaps(spark, width):
    a = spark.createDataFrame([(0, 10, 2), (10, 20, 4)], "s long, e long, v int")
    b = spark.createDataFrame([(5, 15, 3)], "s long, e long, v int")
    o = iv.overlaps(a, b, "s", "e", width, take=["v"]).orderBy("start").collect()
    assert [(r.start, r.end, r.duration, r.v_a + r.v_b) for r in o] == [(5, 10, 5, 5), (10, 15, 5, 7)]
    assert iv.self_overlap_count(a.withColumn("k", F.lit(1)), ["k"], "s", "e").first().n_overlapping == 0


def test_buckets_flags_and_verdicts(spark):
    from tracelane.operators import matching, rollups

    df = spark.createDataFrame([(-1,), (0,), (1,), (2,), (32,), (33,), (2048,), (2049,), (None,)], "x long")
    assert [r[0] for r in df.select(rollups.length_bucket("x")).collect()] == [None, "1", "1", "2-32", "2-32", "33-128", "513-2048", ">2048", None]
    assert [r[0] for r in df.select(rollups.load_bucket("x")).collect()] == [None, "1-4", "1-4", "1-4", "25+", "25+", "25+", "25+", None]
    df = spark.createDataFrame([(-1.0,), (31999.5,), (32000.0,), (128000.0,), (200000.0,), (256000.0,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(rollups.input_bucket("x")).collect()] == ["<32k", "<32k", "32-64k", "128-192k", "192-256k", "256k+", None]
    df = spark.createDataFrame([(9, 3), (4, 1), (5, 5), (5, 0), (2, None)], "n_requests long, n_sessions long")
    assert [r[0] for r in df.select(rollups.quality_flag()).collect()] == ["ok", "low_request_count;single_session_num_group_unvalidated", "session_num_unique_per_profiled_row", "missing_session_num_group", "low_request_count;missing_session_num_group"]
    assert [r[0] for r in df.select(rollups.sparse_status("n_sessions")).collect()] == ["comparative_sample_size_available", "suppressed_n_lt_3_descriptive_only", "comparative_sample_size_available", "suppressed_n_lt_3_descriptive_only", "suppressed_n_lt_3_descriptive_only"]
    df = spark.createDataFrame([(True, True), (True, False), (None, False), (True, None), (None, None)], "p boolean, t boolean")
    assert [r[0] for r in df.select(matching.match_validation(F.col("p"), F.col("t"))).collect()] == ["high_confidence_exact", "key_match_validation_conflict", "key_match_validation_conflict", "key_match_validation_missing", "key_match_validation_missing"]


def test_clipping(spark):
    df = spark.createDataFrame([(0, 5), (4, 12), (20, 30)], "s long, e long")
    assert [tuple(r) for r in iv.clipped(df, "s", "e", 3, 10).orderBy("s").collect()] == [(3, 5), (4, 10)]


def gauges(spark, values, ranks=8):
    rows = [("w", sl, str(r), float(v[r]) if v[r] is not None else None) for sl, v in enumerate(values) for r in range(len(v)) if r < ranks]
    return spark.createDataFrame(rows, "worker string, slice int, rank string, v double")


def test_rank_grids(spark):
    equal, off = [1] * 8, [1] * 7 + [2]
    df = gauges(spark, [equal, off])
    v = rk.validation(df, ["worker"], ["slice"], "rank", "v", 8).first()
    assert (v.equal_ratio, v.max_spread, v.status) == (0.5, 1.0, "exact_all_rank_timestamp_alignment")
    d = {r.slice: r.value for r in rk.deduplicated(df, ["worker", "slice"], "rank", "v", 8).collect()}
    assert d == {0: 1.0, 1: None}
    s = {r.slice: r.value for r in rk.shard_sum(gauges(spark, [equal, [1] * 7]), ["worker", "slice"], "rank", "v", 8).collect()}
    assert s == {0: 8.0, 1: None}
    assert rk.validation(gauges(spark, [[1] * 7]), ["worker"], ["slice"], "rank", "v", 8).first().status == "rank_count_mismatch"
    assert rk.shard_sum(df, ["worker", "slice"], "rank", "v", 8, "worker", ["other"]).count() == 0
    p = rk.rank_pairs(df, ["worker"], ["slice"], "rank", "v")
    assert p.count() == 28 and p.where("rank_left = '0' and rank_right = '7'").first().match_percent == 50.0
    assert "0-7" in json.loads(rk.pairs_json(p, ["worker"], "match_percent").first().match_percent_json)


def test_ranks_go_by_number(spark):
    df = spark.createDataFrame([("w", 0, r, 1.0) for r in ("10", "9", "x")], "worker string, slice int, rank string, v double")
    got = {(r.rank_left, r.rank_right) for r in rk.rank_pairs(df, ["worker"], ["slice"], "rank", "v").collect()}
    assert got == {("9", "10"), ("9", "x"), ("10", "x")}


def test_cluster_sums_need_every_worker(spark):
    df = spark.createDataFrame([("a", 0, 2), ("b", 0, 3), ("a", 1, 4)], "worker string, bin int, v int")
    assert {r.bin: r.cluster_value for r in rk.worker_sum(df, ["a", "b"], ["bin"], "worker", "v").collect()} == {0: 5, 1: None}
    g = rk.guarded_sum(df.where("worker = 'a'"), df.where("worker = 'b'"), ["bin"], "v", False)
    assert {r.status for r in g.collect()} == {"Unknown"} and rk.guarded_sum(df.where("worker = 'a'"), df.where("worker = 'b'"), ["bin"], "v", True).first().stage_sum == 5


def test_crosscheck_of_bins(spark):
    a = spark.createDataFrame([("w", 0, 1.0), ("w", 1, 0.0), ("w", 2, 3.0)], "worker string, bin long, mean_value double")
    b = spark.createDataFrame([("w", 0, 1.0), ("w", 1, 2.0), ("x", 2, 9.0)], "worker string, bin long, mean_value double")
    r = rk.crosscheck(a, b, ["worker"]).first()
    assert (r.n_common, r.n_only_y, r.gap_max, r.same_fraction) == (2, 1, 2.0, 0.5)


def test_bins_before_the_start_are_negative(spark):
    df = spark.createDataFrame([(-1, 1.0), (0, 2.0), (9, 4.0), (10, 5.0)], "t long, v double")
    assert {r.bin: (r.mean_value, r.n_samples) for r in rk.binned(df, [], "t", 0, 10, "v").collect()} == {-1: (1.0, 1), 0: (3.0, 2), 1: (5.0, 1)}


TRACE = {
    "id": "abc", "models": ["big", "small"], "block_size": 64,
    "requests": [
        {"t": 0.0, "model": "big", "in": 128, "out": 4, "hash_ids": [0, 1]},
        {"t": 0.5, "type": "subagent", "agent_id": "agent_001", "subagent_type": "Subagent", "requests": [{"t": 0.5, "model": "small", "in": 192, "out": 3, "hash_ids": [10, 11, 12]}, {"t": 0.75, "model": "small", "in": 256, "out": 5, "hash_ids": [10, 11, 12, 13]}]},
        {"t": 1.0, "model": "big", "in": 192, "out": 6, "hash_ids": [0, 1, 2]},
        {"type": "subagent", "agent_id": "none", "requests": []},
    ],
}


def test_traces(spark):
    lines = spark.createDataFrame([(json.dumps(TRACE),), ("",), (json.dumps({"id": "empty", "requests": []}),)], "value string")
    flat = tr.flatten(lines)
    rows = tr.branch_state(flat.where("row_no is not null")).orderBy("row_no").collect()
    assert [r.source_branch_type for r in rows] == ["root", "subagent", "subagent", "root"]
    assert [(r.source_outer_request_index, r.source_inner_request_index) for r in rows] == [(0, None), (1, 0), (1, 1), (2, None)]
    assert rows[1].source_conversation_path == "abc::sa:agent_001"
    assert (rows[3].shared_blocks, rows[3].cached_tokens, rows[3].new_tokens, rows[3].rollback_blocks) == (2, 128, 64, 0)
    assert rows[3].cached_ratio == pytest.approx(128 / 192) and (rows[2].shared_blocks, rows[2].cached_tokens) == (3, 192)
    assert rows[0].shared_blocks is None and rows[1].shared_blocks is None
    s = {r.root_trace_id: r for r in tr.root_summary(flat, spark.createDataFrame([("abc", ["small", "x"])], "root_trace_id string, declared_models array<string>")).collect()}
    assert (s["abc"].n_requests, s["abc"].n_containers, s["abc"].input_tokens, s["abc"].output_tokens, s["abc"].models) == (4, 2, 768, 18, ["small", "x", "big"])
    assert (s["empty"].n_requests, s["empty"].n_containers) == (0, 0)
    c = tr.trace_check(lines.where("value <> ''")).first()
    assert (c.n_traces, c.n_ids, c.top_level_keys) == (2, 2, "block_size;id;models;requests")


def test_malformed_and_repeated_traces_are_errors(spark):
    for bad in ("{", '{"requests": []}', '{"id": "a"}'):
        with pytest.raises(Exception):  # noqa: B017
            tr.flatten(spark.createDataFrame([(bad,)], "value string")).collect()
    with pytest.raises(Exception, match="repeated trace id"):
        tr.require_unique_roots(spark.createDataFrame([('{"id":"a"}',), ('{"id":"a"}',)], "value string")).collect()


def test_deep_traces_need_no_recursion(spark):
    node = {"in": 1, "out": 1}
    for k in range(300):
        node = {"agent_id": f"a{k}", "requests": [node]}
    rows = list(tr.walk(json.dumps({"id": "x", "requests": [node]})))
    assert len(rows) == 1 and rows[0][2].count("::sa:") == 300 and rows[0][-1] == 300


def test_reconciliation(spark):
    df = spark.createDataFrame([("mean_ttft_ms", 100.0, 100.9), ("requests", 5.0, 5.0), ("requests", 5.0, 6.0), ("output_tps", 100.0, 101.5), ("derived_input_tokens", 10.0, 10.9), ("x", 1.0, None)], "metric string, raw_value double, published_value double")
    assert [r.validation_status for r in rc.compared(df).collect()] == ["pass", "pass", "mismatch", "pass", "pass", "not_comparable"]
    got = spark.range(1).select(rc.label_status(F.lit("org/M-1"), F.lit("m 1"), (("org/m-1", "M1"),)).alias("a"), rc.label_status(F.lit("x"), F.lit(None)).alias("b")).first()
    assert tuple(got) == ("pass_alias_equivalent", "not_comparable")


def test_schema_inventory(spark):
    rows = [{"a": {"value": 1, "unit": "s"}, "l": [1], "n": None}, {"a": {"value": 3, "unit": "ms"}, "e": {}}, {"A_": {"b": {"c": "x"}}}]
    flat = si.flattened(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "id int, v string"), ["id"], "v")
    got = {r.path: r for r in si.inventory(flat, 3).collect()}
    assert set(got) == {"a.value", "a.unit", "l", "n", "A_.b.c"}
    assert (got["a.value"].min_value, got["a.value"].max_value, got["a.value"].units, got["a.value"].null_rate) == (1.0, 3.0, "ms:1;s:1", pytest.approx(1 / 3))
    found = {r.id: (r.value, r.path) for r in si.lookup(flat, ["id"], ["zzz", "A", "c"]).collect()}
    assert found == {0: ("1", "a.value"), 1: ("3", "a.value"), 2: ("x", "A_.b.c")}


def test_log_archives_and_routing(spark, tmp_path):
    done = '2026-08-08T04:51:24.454472Z request completed request_id=a1b2-c3 x_request_id="d4e5-f6" prefill_worker_id=2787 decode_worker_id=2792'
    wait = '2026-08-08T04:51:25.454472Z dynamo_kv_router::scheduling::queue: refreshed overlap scores after long queue wait request_id="a1b2-c3" wait_ms=13932'
    text = f"\x1b[32m{done}\x1b[0m\n{wait}\n\xff\n".encode("latin-1")
    with tarfile.open(tmp_path / "logs.tar.gz", "w:gz") as tar:
        for name in ("./worker-8_frontend_0.out", "a/skip.txt"):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text))
    lines = files.log_lines(spark, str(tmp_path))
    assert lines.count() == 3
    r = routing.routed(spark.createDataFrame([("d4e5-f6",), ("r2",)], "x_request_id string"), lines).orderBy("x_request_id").collect()
    assert (r[0].prefill_worker, r[0].decode_worker, r[0].max_wait_ms, r[0].n_checkpoints, r[1].decode_worker) == ("2787", "2792", 13932.0, 1, None)
    assert (r[0].routing_match_status, r[1].routing_match_status, r[0].queue_checkpoint_source_file, r[0].queue_checkpoint_source_line) == ("exact", "unmatched", "./worker-8_frontend_0.out", 2)
    twice = lines.unionByName(lines)
    assert routing.completions(twice).count() == 0
    with pytest.raises(Exception, match="several completions of d4e5-f6"):
        routing.completions(twice, strict=True).collect()
    assert routing.completions(lines.withColumn("member", F.lit("other.out"))).count() == 0


@pytest.mark.parametrize("kind", ["tar", "tar.gz", "tar.bz2"])
def test_large_log_archives_in_blocks(spark, tmp_path, kind):
    """The same rows from blocks as from whole archives: empty members, long lines, a directory, a last line without an
    end, names of more than 100 characters, two archives."""
    texts = {"a.log": "".join(f"{k} \x1b[31mred\x1b[0m\n" for k in range(3000)), "empty.out": "", f"{'d' * 120}/b.out": "x" * 5000 + "\nlast", "skip.txt": "no\n", "c.out": "\r\n\r\n"}
    for name in ("one, [two]", "three"):
        with tarfile.open(tmp_path / f"{name}.{kind}", f"w:{kind[4:]}") as tar:
            tar.addfile(tarfile.TarInfo("folder.log/") if name == "three" else tarfile.TarInfo("x.bin"))
            for member, text in texts.items():
                info = tarfile.TarInfo(member)
                info.size = len(text)
                tar.addfile(info, io.BytesIO(text.encode()))
    whole, blocks = (sorted(map(tuple, files.log_lines(spark, str(tmp_path), whole_bytes=n).collect())) for n in (1 << 30, 0))
    assert whole == blocks and len(whole) == 2 * (3000 + 2 + 2)
    want = [(m, k, t.replace("\x1b[31m", "").replace("\x1b[0m", "").rstrip("\r")) for m, text in texts.items() if m.endswith(("log", "out")) for k, t in enumerate(text.removesuffix("\n").split("\n") if text else [], 1)]
    assert sorted(x[1:] for x in whole if "three" in x[0]) == sorted(want)


def test_named_objects(spark, tmp_path):
    series = {"description": "br{ace \"q\" }", "series": [{"endpoint_url": "u", "labels": {"worker": "w"}, "stats": {"avg": 1.0, "p50_estimate": 2.0}, "timeslices": [{"start_ns": 0, "end_ns": 5, "avg": 1.5}]}]}
    path = tmp_path / "metrics.json"
    path.write_text(json.dumps({"phase": {"x": 1}, "metrics": {"skip": {"series": []}, "gauge": series}}, indent=2))
    got = files.named_objects(spark, str(path), ["gauge"])
    assert json.loads(got.first().value) == series
    assert files.time_slices(got).first().avg == 1.5 and files.series_stats(got).first().p50 == 2.0
    with pytest.raises(Exception, match="no object absent"):
        files.named_objects(spark, str(path), ["absent"]).collect()


@pytest.mark.parametrize("size", ["1000", "70", "100000"])
def test_named_objects_across_splits(spark, tmp_path, size):
    want = {f"m:{k}": {"text": 'a "quoted } { [ \\\\" ' * (k % 4), "n": [[k], {"deep": {"er": k}}], "é": "x" * (k * 13)} for k in range(20)}
    path = tmp_path / "metrics.json"
    path.write_text(json.dumps({"summary": {"phase_time_ranges": {"profiling": {"start_ns": 1784630947472644248, "end_ns": 5}}}, "metrics": {**want, "m:3": want["m:3"], "other": {"m:5": {"late": 1}}}, "end": {"m:1": {"later": 2}}}, indent=2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {r.name: json.loads(r.value) for r in files.named_objects(spark, str(path), list(want)).collect()}
        begins = {r.name for r in files.named_objects(spark, str(path), ["m:1", "oth", "zz"], prefix=True).collect()}
        window = tuple(files.phase_window(spark, str(path)).first())
        assert tuple(files.phase_window(spark, str(path), "warmup").first()) == (None, None)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want and begins == {"m:1", "other", *(f"m:1{k}" for k in range(10))} and window == (1784630947472644248, 5)


def test_ragged_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text('comment\nName,Type,Note\na,gauge,x\nb\nc,"ga,uge",y,more,"z ""q"""\n\n')
    got = files.ragged_csv(numbered(spark, str(tmp_path)), "Name,", ["name", "type", "note"]).orderBy("line_no").collect()
    assert [tuple(r) for r in got] == [(3, "a", "gauge", "x"), (4, "b", None, None), (5, "c", "ga,uge", 'y,more,z "q"')]


def test_tables_and_inventories(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType())])
    assert files.read_table(spark, str(tmp_path / "none.parquet"), schema).count() == 0
    (tmp_path / "t.csv").write_text("a\n5\n")
    assert files.read_table(spark, str(tmp_path / "t.parquet"), schema).first().a == 5
    assert files.read_inventory(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "inv.json").write_text(json.dumps({"artifacts": [{"id": 7, "name": "n", "workflow_run": {"head_sha": "s"}}]}))
    assert tuple(files.read_inventory(spark, str(tmp_path / "inv.json")).first()) == ("7", "n", "s")


def test_config_subset():
    assert files._plain_config("a: 1\nb:\n  c: x # note\n  d:\n    - 1\n    - y\ne: 2.5\nf: true\n") == {"a": 1, "b": {"c": "x", "d": [1, "y"]}, "e": 2.5, "f": True}


def test_sinks_swap_whole_tables(spark, tmp_path):
    path = str(tmp_path / "out.parquet")
    schema = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.StringType())])
    sinks.write_parquet(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"), path, schema)
    assert sorted((r.x is None, r.y) for r in spark.read.parquet(path).collect()) == [(False, None), (True, None)]
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("double").alias("x"))
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_parquet(bad, path, schema)
    assert spark.read.parquet(path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["out.parquet"]
    sinks.write_empty(spark, path, schema)
    assert spark.read.parquet(path).count() == 0
    sinks.write_blocked(spark, {"t": schema}, str(tmp_path / "b"), "no input")
    assert json.loads(spark.read.text(str(tmp_path / "b/status")).first().value)["status"] == "blocked"
    with pytest.raises(FileNotFoundError):
        sinks.write_empty(spark, path, schema, "error")


def test_p_values():
    assert relations.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert relations.t_two_sided(0.0, 5) == 1.0 and relations.t_two_sided(12.706205, 1) == pytest.approx(0.05, abs=1e-6)


def test_streamed_load_equals_batch(spark, tmp_path):
    from tracelane.streaming import requests as sr

    s = 1_000_000_000
    rows = [("a", k * s, (k + 3) * s, k) for k in range(1, 31)] + [("b", 5 * s, 9 * s, 99), ("a", 10**15, 10**15 + s, 100)]
    src = tmp_path / "in"
    schema = "lane string, request_start_ns long, request_end_ns long, record_ordinal long"
    for part in (rows[:10], rows[10:], [("z", 2 * 10**15, 2 * 10**15 + s, 101)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = sr.request_stream(spark, str(src), spark.read.parquet(str(src)).schema)
    q = sr.in_flight(stream, "lane", "10 seconds").writeStream.format("memory").queryName("load").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.lane, r.at_ns): r.in_flight for r in spark.table("load").collect()}
    want = {(r.lane, r.at_ns): r.in_flight for r in iv.states(spark.createDataFrame(rows, schema).withColumn("source_branch_type", F.lit(None).cast("string")), ["lane"]).collect()}
    assert got and got.items() <= want.items() and {k for k in want if k[1] < 10**14} <= got.keys()


def test_streamed_split_and_bins(spark, tmp_path):
    from tracelane.streaming import requests as sr

    base = spark.createDataFrame([(k, "profiling" if k % 3 else "warmup", False, False, 1.0, 2.0, 3.0, 9.0, k * 10**9) for k in range(60)], "record_ordinal long, benchmark_phase string, error_present boolean, was_cancelled boolean, input_tokens double, output_tokens double, ttft_ms double, e2e_ms double, request_start_ns long")
    base.write.parquet(str(tmp_path / "in"))
    good, bad = sr.split(sr.request_stream(spark, str(tmp_path / "in"), base.schema))
    for name, df in (("good", sr.without_repeats(good, ["record_ordinal"])), ("bad", bad), ("bins", sr.binned(good, ["benchmark_phase"], "ttft_ms", "10 seconds"))):
        mode = "complete" if name == "bins" else "append"
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert (spark.table("good").count(), spark.table("bad").count(), spark.table("bins").agg(F.sum("n_samples")).first()[0]) == (40, 20, 40)


def test_aggregate_files(spark, tmp_path):
    for name in ("agg_conc4.json", "results_conc8.json", "run_summary.json", "other.json"):
        (tmp_path / name).write_text('{"conc": 1}')
    found = {r.name for r in files.aggregate_files(spark, str(tmp_path)).collect()}
    assert found == {"agg_conc4.json", "results_conc8.json"}
    only = tmp_path / "only"
    only.mkdir()
    (only / "run_summary.json").write_text("{}")
    assert {r.name for r in files.aggregate_files(spark, str(only)).collect()} == {"run_summary.json"}


def test_attach_by_ordinal(spark):
    df = spark.createDataFrame([(1, 1000), (2, 5000), (3, 1)], "ordinal long, t long")
    raw = spark.createDataFrame([(1, "a", 1400), (2, "b", 5000)], "ordinal long, rid string, raw_t long")
    out = {r.ordinal: r.rid for r in routing.attach_by_ordinal(df, raw, "ordinal", ["rid"], ("t", "raw_t"), 512).collect()}
    assert out == {1: "a", 2: "b", 3: None}
    with pytest.raises(Exception, match="times differ"):
        routing.attach_by_ordinal(df, raw, "ordinal", ["rid"], ("t", "raw_t"), 100).collect()


def test_worker_verdicts_and_inventory(spark):
    rows = [("p", m, r, s, 1.0 if m == "a" else float(s)) for m in ("a", "b") for r in range(2) for s in range(3)] + [("q", "a", r, 0, 1.0) for r in range(2)] + [("u", m, r, 0, float(r) if m == "b" else 1.0) for m in ("a", "b") for r in range(2)]
    g = spark.createDataFrame(rows, "worker string, metric string, rank int, slice int, v double")
    checks = rk.validation(g, ["worker", "metric"], ["slice"], "rank", "v", 2)
    got = {r.worker: r for r in rk.worker_verdicts(checks, "worker", "metric", ["a", "b"], 2, True).collect()}
    assert (got["p"].verdict, got["p"].status, got["p"].evidence) == ("validated_duplicate_worker_gauge", "Validated reconstruction", "a: ranks=2/2; complete=1.0; exact=1.0 | b: ranks=2/2; complete=1.0; exact=1.0")
    assert (got["q"].verdict, got["q"].status) == ("unresolved", "Unknown") and "missing:b" in got["q"].evidence and got["u"].verdict == "unresolved"
    assert rk.worker_verdicts(checks, "worker", "metric", ["a"], 2, False).where("verdict = 'likely_duplicate_worker_gauge' AND status = 'Strong inference'").count() == 3
    csv = spark.createDataFrame([(1, "m", "Histogram", "d", "5"), (2, "sglang:num_running_reqs", "gauge", None, "nan"), (3, "skip", "gauge", "x", "1")], "line_no int, M string, T string, D string, avg string")
    m = rk.metric_inventory(csv, ["m", "sglang:num_running_reqs"], {"metric": "M", "type": "T", "description": "D", "avg": "avg"}).orderBy("line_no").collect()
    assert [(r.component, r.avg, r.worker) for r in m] == [("csv_histogram_labels_unparsed", None, None), ("unlabeled", None, None)] and m[1].meaning.startswith("explicit SGLang running-request gauge")


def test_draws_are_dealt_in_lists_not_one_by_one(spark):
    from hashlib import md5

    rows = [("a", 1, k, 7) for k in range(7)] + [("b", 2, k, 3) for k in range(3)]
    clusters = spark.createDataFrame(rows, "g string, h int, i_ long, c_ long")
    lists = pairing._drawn(clusters.coalesce(1), ["g", "h"], 50, 3)
    got = lists.collect()
    assert len(got) == 10  # one list for each cluster of a batch, not one row for each of 500 draws
    want = {}
    for g, h, slot, c in rows:
        for rep in range(50):
            want.setdefault((g, h, int(md5(f"3|{g}|{h}|{rep}|{slot}".encode()).hexdigest()[:8], 16) % c), []).append(rep)
    assert {(r.g, r.h, r.i_): sorted(r.reps) for r in got} == {k: sorted(v) for k, v in want.items()}
