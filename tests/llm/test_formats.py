"""Chats and WARC: exact round trips, damage, odd values."""

from __future__ import annotations

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracelane.llm import chat_format, queries, warc
from tracelane.llm.common import shared_dir

SCHEMA = "conv_id long, turn int, role string, text string"


def digests(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r.conv_id: r for r in chat_format.chat_digests(chat_format.formatted_chats(df)).collect()}


def test_round_trip_of_odd_chats(spark):
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\n", " ", "a", "é🙂", "\\s", "<\\s>", " [/INST]\n", None]
    rng = random.Random(2)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 7)):
            text = None if rng.random() < 0.1 else "".join(x for _ in range(rng.randrange(8)) if (x := rng.choice(bits)))
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "od\nd [/INST]\\"]), text))
    got = digests(spark, rows)
    for c in range(60):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_control_strings_never_occur_in_texts(spark):
    df = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], SCHEMA)
    r = chat_format.formatted_chats(df).first()
    assert r.formatted.count("[INST]") == 1 and r.formatted.count("</s>") == 1 and r.learned == [False, True]
    whole = r.formatted.encode()
    assert [chat_format.unescaped(whole[a:b].decode()) for a, b in zip(r.text_starts, r.text_ends)] == ["</s>[INST] ok [/INST]"] * 2


def test_ties_long_chats_and_empty_table(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "x")] + [(7, i, "assistant", "t" * 50) for i in range(25_000)]
    got = digests(spark, rows)
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nuser\na\nuser\nb\n").hexdigest()
    assert got[None].n_turns == 1 and (got[7].n_turns, got[7].loss_chars) == (25_000, 1_250_000)
    assert digests(spark, []) == {}


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, extra int")


def test_warc_round_trip(spark):
    rows = [(3, "http://a b\r\n", "same", 1), (1, None, "same", 1), (2, "u", None, 1), (9, "u", "", 1), (5, "u", "é" * 70000, 1), (None, "u", "own", 1), (4, "u", "x\r\n\r\ny\x1f\x8b\x08 WARC/1.1\r\n", 1), (1, "u", "same", 1)]
    path = shared_dir(spark, "warc")
    warc.write_warc(pages(spark, rows), path, archive_bytes=200)
    got = warc.read_warc(spark, path).where("record_type in ('response', 'revisit')").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.record_id, []).append(r)
    assert [r.record_type for r in by["<urn:x-page:1>"]] == ["response"] * 2
    assert (by["<urn:x-page:3>"][0].record_type, by["<urn:x-page:3>"][0].refers_to, by["<urn:x-page:3>"][0].payload_length) == ("revisit", "<urn:x-page:1>", 4)
    assert by["<urn:x-page:9>"][0].record_type == "revisit" and by["<urn:x-page:2>"][0].record_type == "response"
    assert bytes(by["<urn:x-page:5>"][0].payload).decode() == "é" * 70000
    assert bytes(by["<urn:x-page:4>"][0].payload).decode() == rows[6][2]
    assert by["<urn:x-page:>"][0].record_type == "response"
    assert warc.read_warc(spark, path).where("kind = 'gap'").count() == 0


def test_warc_keeps_small_payloads_if_asked(spark):
    path = shared_dir(spark, "warc")
    warc.write_warc(pages(spark, [(1, "u", "ab", 0), (2, "u", "ab", 0)]), path, min_revisit_bytes=3)
    assert [r.record_type for r in warc.read_warc(spark, path).where("target_uri = 'u'").collect()] == ["response"] * 2


def test_empty_warc(spark):
    path = shared_dir(spark, "warc")
    warc.write_warc(pages(spark, []), path)
    assert warc.read_warc(spark, path).where("record_type = 'response'").count() == 0


def archive(n: int, zipped: bool) -> list[bytes]:
    parts = [warc.page_record(i, f"http://x/{i}", f"payload {i} ".encode() * 40, None, False, warc.DATE) for i in range(n)]
    return [warc.member(p) for p in parts] if zipped else parts


def numbers(found) -> list[int]:
    return [int(h["warc-record-id"][len("<urn:x-page:") : -1]) for _, _, h, _, _ in found if h]


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    parts = archive(5, zipped)
    whole = b"".join(parts)
    assert numbers(list(warc.read_archive(whole))) == [0, 1, 2, 3, 4]
    damaged = bytearray(parts[2])
    damaged[len(damaged) // 2] ^= 0xFF
    for broken, left in ((b"".join(parts[:2]) + bytes(damaged) + b"".join(parts[3:]), [0, 1, 3, 4]), (b"".join(parts[:2]) + parts[2][:-20] + b"".join(parts[3:]), [0, 1, 3, 4]), (b"junk" + whole, [0, 1, 2, 3, 4]), (whole[:-30], [0, 1, 2, 3]), (whole + b"tail", [0, 1, 2, 3, 4])):
        found = list(warc.read_archive(bytes(broken)))
        assert numbers(found) == left
        gaps = [f for f in found if f[2] is None]
        assert gaps and all(g[4] for g in gaps)
        assert sum(f[1] for f in found) == len(broken)  # every byte is in a record or a gap


def test_salvage_random_damage():
    rng, parts = random.Random(4), archive(6, True)
    whole = b"".join(parts)
    for _ in range(60):
        data = bytearray(whole)
        for _ in range(rng.randrange(1, 4)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        found = list(warc.read_archive(bytes(data)))
        assert sum(f[1] for f in found) == len(data)
        for f in found:
            if f[2] is not None:
                i = int(f[2]["warc-record-id"][len("<urn:x-page:") : -1])
                assert gzip.decompress(bytes(data[f[0] : f[0] + f[1]])) == gzip.decompress(parts[i])


def test_warc_query(spark, data):
    out = queries.op8_warc(spark, data)
    want = spark.read.parquet(f"{data}/pages.parquet").select("page_id", F.octet_length("html").cast("long").alias("payload_bytes"))
    assert out.select("page_id", "payload_bytes").exceptAll(want).count() == 0 and out.count() == want.count()


def test_records_beyond_the_limit_are_gaps():
    for zipped, why in ((True, "gzip: too large"), (False, "block too large")):
        whole = b"".join(archive(3, zipped))
        found = list(warc.read_archive(whole, max_record_bytes=100))
        assert [(f[0], f[1], f[2], f[4]) for f in found] == [(0, len(whole), None, why)]


def test_marks_are_found_across_chunks():
    record = archive(1, False)[0]
    for shift in range(-8, 3):
        data = b"x" * ((1 << 20) + shift) + record
        assert [(f[0], f[2] is None) for f in warc.read_archive(data)] == [(0, True), ((1 << 20) + shift, False)]


@pytest.mark.parametrize("size", [(1 << 20) - 40, 1 << 20, (3 << 20) + 7])
def test_long_headers_read_alike_plain_and_zipped(size):
    """Headers longer than one read of the file; without their end the record is a gap and the next one is found."""
    long = warc.record([("WARC-Type", "metadata"), ("X-Long", "h" * size)], b"block")
    short = warc.record([("WARC-Type", "metadata")], b"next")
    for data in (long + short, gzip.compress(long) + gzip.compress(short)):
        found = list(warc.read_archive(data))
        assert [(f[2] is None, f[3]) for f in found] == [(False, b"block"), (False, b"next")] and len(found[0][2]["x-long"]) == size
    cut = long.split(b"\r\nWARC-Block", 1)[0]
    assert [f[4] for f in warc.read_archive(cut)] == ["headers don't end"]
    assert [(f[2] is None, f[3]) for f in warc.read_archive(cut + short)][-1] == (False, b"next")
