"""One query for each training-data operator, over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.llm import ann, chat_format, decontaminate, divergence, language_id, license_scan, near_dedup, piece_coding, quality_rules, ranked_search, suffix_dedup, token_counts, warc
from tracelane.llm.common import shared_dir
from tracelane.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sentence_ids and licenses as comma-joined text."""
    found = license_scan.with_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.size("matches").cast("long").alias("n_matches"), F.array_join("licenses", ",").alias("licenses"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], chats.schema)
    return chat_format.chat_digests(chat_format.formatted_chats(chats.unionByName(probe)))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    found = warc.read_warc(spark, path, payloads=False)
    kind = F.when(F.col("kind") == "gap", F.raise_error(F.concat(F.lit("damage in "), "archive", F.lit(": "), "reason"))).otherwise(F.col("record_type"))
    found = found.withColumn("record_type", kind).where(F.col("record_type").isin("response", "revisit"))
    return found.select(warc.page_number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", warc.page_number("refers_to").alias("refers_to"))


def op9_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_coding.with_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), results=("n_tokens", "ids_sha256", "decoded_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language_id.learn_profiles(docs.where(~language_id.held_out()))
    return language_id.with_language(docs.select("doc_id", "text", language_id.held_out().alias("held_out")), profiles)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search.ranked(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """failed_rules as comma-joined text."""
    found = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("failed_rules", F.array_join("failed_rules", ","))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_decontamination, op3_near_dedup, op4_nearest_neighbours, op5_license_scan, op6_chat_format, op7_suffix_dedup, op8_warc, op9_piece_coding, op10_language_id, op11_ranked_search, op12_quality_rules, op13_divergence_audit)
}

# DuckDB numbers the letters of base32 from the 160 bits of the digest in groups of five.
_BASE32 = """
list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (list_aggregate(list_transform(range(5), lambda b:
    (get_bit(CAST(unhex(d) AS BIT), CAST(i * 5 + b AS INTEGER)) << CAST(4 - b AS INTEGER))), 'sum') + 1)::BIGINT, 1)), 'string_agg', '')
"""


def _quality_sql() -> str:
    """The threshold table as SQL."""
    rules = []
    for r in quality_rules.RULES:
        tests = [f"1000 * {r.part} < {r.least} * {r.whole}"] * (r.least is not None) + [f"1000 * {r.part} > {r.most} * {r.whole}"] * (r.most is not None)
        rules.append(f"CASE WHEN {r.whole} > 0 AND ({' OR '.join(tests)}) THEN '{r.name}' END")
    stop = ", ".join(f"'{w}'" for w in quality_rules.stop_words())
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS x FROM t),
places AS (SELECT doc_id, s, w[s:s + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM w WHERE len(w) > 2)),
again AS (SELECT doc_id, s FROM places JOIN (SELECT doc_id, g FROM places GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)),
repeats AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([s, s + 1, s + 2]) AS k FROM again) GROUP BY doc_id),
counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(x) AS BIGINT) AS n_lines, CAST(len(x) - len(list_distinct(x)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(w, lambda v: v IN ({stop}))) AS BIGINT) AS n_stop_words,
    CAST(len(list_filter(x, lambda v: regexp_matches(v, '^[\x20\x09-\x0D]*[-*•●‣]'))) AS BIGINT) AS n_bullet_lines,
    CAST(len(list_filter(x, lambda v: regexp_matches(v, '([.][.][.]|…)[\x20\x09-\x0D]*$'))) AS BIGINT) AS n_ellipsis_lines
  FROM w LEFT JOIN repeats USING (doc_id)),
judged AS (
  SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.REPEAT_PERCENT} * n_words AS base_failed, concat_ws(',', {', '.join(rules)}) AS failed_rules
  FROM counts)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM judged
"""


ORACLE_SQL = {
    "op11_ranked_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL),
whole AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
tf AS (SELECT d, doc_id, n, term, count(*) AS tf FROM (SELECT d, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole),
scores AS (
  SELECT item_id, d, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN weights USING (term), whole GROUP BY item_id, d, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
""",
    "op12_quality_rules": _quality_sql(),
    "op13_divergence_audit": r"""
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
words AS (SELECT d, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 3),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 1) // (coalesce(n, 0) + v) AS BIGINT) AS p
  FROM groups g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (
  SELECT lang, term, CAST(1 + CAST(1000000000 AS HUGEINT) * (c + 1) // (sum(c) OVER (PARTITION BY lang) + v) AS BIGINT) AS q
  FROM (SELECT lang, term, sum(c) AS c FROM counts GROUP BY ALL) JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS s FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares JOIN whole USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200
""",
    "op2_decontamination": r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS phrase, least(13, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc_words, sizes WHERE len(w) >= n)),
found AS (SELECT p.doc_id, p.s, p.n, x.item_id FROM places p JOIN windows x ON p.phrase = x.phrase AND p.n = x.n),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS i FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op6_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '<s>', '<' || chr(92) || 's>'), '</s>', '<' || chr(92) || '/s>'),
    '[INST]', '[' || chr(92) || 'INST]'), '[/INST]', '[' || chr(92) || '/INST]') AS e FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(e) + CASE WHEN role = 'assistant' THEN 18 ELSE 17 + length(role) END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
""",
    "op8_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
""",
}
