"""Identifiers: conversation ids, branches, composite keys, artifact names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.functions.coerce import as_column, number, text_or_null

# The mark of an agent, the marks of branches with their class and the rule that finds them, other rules.
AGENT = "::sa:"
BRANCHES = (("fa", "fanout", "split_direct_fanout_suffix"), ("aux", "auxiliary", "split_direct_auxiliary_suffix"), ("wg", "worker_group", "split_direct_worker_group_suffix"))
AGENT_RULE, EMPTY_RULE, SELF_RULE, MISSING_RULE = "split_before_first_sa", "invalid_empty_root_before_sa", "identity", "missing_conversation_id"
# Suffixes of replayed and copied roots, with the rules' names.
ROOT_SUFFIXES = (
    ("strip_replay_suffix", r"(?i)(?:::|__|[#|])(?:replay|instance|session|worker|copy|dup)(?:[:_\-]?[a-z0-9])+$"),
    ("strip_loader_dup_suffix", r"(?i)(?:__|[#|])(?:dup|repeat)(?:[_\-]?\d)+$"),
)
UUID = r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}"
# Words for a concurrency in a name.
CONCURRENCY = r"(?:conc(?:urrency)?|concurrent)"


def _before(c: Column, mark: str) -> Column:
    """What stands before the first mark; null if there is no mark or nothing before it."""
    head = F.split_part(c, F.lit(mark), F.lit(1))
    return F.when(c.contains(mark) & (head != ""), head)


def _by_branch(c: Column, pick) -> list[tuple[Column, Column]]:
    """(condition, result) for each branch mark that stands directly on a root."""
    return [(_before(c, f"::{mark}:").isNotNull(), pick(f"::{mark}:", name, rule)) for mark, name, rule in BRANCHES]


def _first(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = F.when(*cases[0])
    for test, result in cases[1:]:
        out = out.when(test, result)
    return out.otherwise(otherwise)


def root_id(conversation: Column | str) -> Column:
    """The id before an agent suffix (null if nothing stands there), else before a branch suffix, else the id itself."""
    c = text_or_null(conversation)
    return _first([(c.contains(AGENT), _before(c, AGENT)), *_by_branch(c, lambda mark, *_: _before(c, mark))], c)


def root_rule(conversation: Column | str) -> Column:
    """How root_id found its answer."""
    c = text_or_null(conversation)
    agent = F.when(_before(c, AGENT).isNotNull(), AGENT_RULE).otherwise(EMPTY_RULE)
    return _first([(c.isNull(), F.lit(MISSING_RULE)), (c.contains(AGENT), agent), *_by_branch(c, lambda mark, name, rule: F.lit(rule))], F.lit(SELF_RULE))


def branch_suffix(conversation: Column | str) -> Column:
    """What follows the root, with its mark; root for a root, null for a missing id."""
    c = text_or_null(conversation)
    cut = lambda mark: F.substr(c, F.position(F.lit(mark), c))
    return _first([(c.isNull(), F.lit(None).cast("string")), (c.contains(AGENT), cut(AGENT)), *_by_branch(c, lambda mark, *_: cut(mark))], F.lit("root"))


def branch_class(conversation: Column | str) -> Column:
    """root, subagent_main, fanout, auxiliary, worker_group or unknown, from the suffix."""
    c = text_or_null(conversation)
    suffix = F.lower(branch_suffix(c))
    agent = _first([(suffix.contains(f":{mark}:"), F.lit(name)) for mark, name, _ in BRANCHES], F.when(suffix.rlike("^::sa:[^:]"), "subagent_main").otherwise("unknown"))
    return _first([(c.isNull(), F.lit("unknown")), (c.contains(AGENT), F.when(_before(c, AGENT).isNull(), "unknown").otherwise(agent)), *_by_branch(c, lambda mark, name, rule: F.lit(name))], F.lit("root"))


def branch_path(conversation: Column | str, root: Column | str | None = None) -> Column:
    """The path of the source branch: the root (the given one, if there is one) with the agent's id, without what
    follows that; null without a root or an agent's id."""
    c = text_or_null(conversation)
    source = F.coalesce(text_or_null(root), root_id(c)) if root is not None else root_id(c)
    marks = "|".join(mark for mark, *_ in BRANCHES)
    agent = F.regexp_replace(F.regexp_replace(F.regexp_extract(c, "::sa:(.*)$", 1), f"(?i):({marks}):.*$", ""), "^:+|:+$", "")
    return F.when(c.isNull(), None).when(~c.contains(AGENT), source).when(agent != "", F.concat(source, F.lit(AGENT), agent))


def candidate_roots(conversation: Column | str) -> Column:
    """(root, rule) under which the root may be known, in order: itself, without a replay suffix, without a copy
    suffix; a root stands once, and none is empty."""
    root = root_id(conversation)
    found = F.array(F.struct(root.alias("root"), root_rule(conversation).alias("rule")))
    for rule, pattern in ROOT_SUFFIXES:
        cut = F.regexp_replace(root, pattern, "")
        new = (cut != "") & ~F.array_contains(F.transform(found, lambda x: x["root"]), cut)
        found = F.when(new, F.array_append(found, F.struct(cut.alias("root"), F.lit(rule).alias("rule")))).otherwise(found)
    return F.when(root.isNotNull(), found).otherwise(F.slice(found, 1, 0))


def joined_key(*columns: Column | str, missing: str = "<null>") -> Column:
    """Columns as text joined by bars, with a mark where one is null."""
    return F.concat_ws("|", *(F.coalesce(as_column(c).cast("string"), F.lit(missing)) for c in columns))


def source_key(root: Column | str, outer: Column | str, inner: Column | str) -> Column:
    """root|outer|inner, -1 for no inner index; null without root or outer index."""
    o = as_column(outer)
    return F.when(as_column(root).isNotNull() & o.isNotNull(), F.concat_ws("|", as_column(root), o.cast("long").cast("string"), F.coalesce(as_column(inner).cast("long"), F.lit(-1)).cast("string")))


def whole_key(c: Column | str) -> Column:
    """A number as a long key if it is whole to within 1e-9, else null."""
    x = number(c)
    return F.when(F.abs(x - F.round(x)) < 1e-9, F.round(x).cast("long"))


def same_number(a: Column | str, b: Column | str, tolerance: float = 1e-9) -> Column:
    return F.abs(number(a) - number(b)) <= tolerance


def resolve_roots(df: DataFrame, known: DataFrame, conversation: str = "conversation_id", explicit: str | None = None) -> DataFrame:
    """df with root_trace_id (the explicit one if given, else the first candidate that is known, else the primary
    one), root_known and root_source (metadata, or the rule that gave the root). known: one column of ids."""
    ids = known.select(F.col(known.columns[0]).alias("known_")).where("known_ is not null").distinct()
    candidates = df.select(F.col(conversation).alias("conv_")).distinct().select("conv_", F.posexplode(candidate_roots("conv_")).alias("pos_", "cand_"))
    best = candidates.join(ids, F.col("cand_.root") == F.col("known_")).groupBy("conv_").agg(F.min_by("cand_", "pos_").alias("best_"))
    out = df.join(best, F.col(conversation).eqNullSafe(F.col("conv_")), "left")
    given = text_or_null(explicit) if explicit else F.lit(None).cast("string")
    out = out.withColumn("root_trace_id", F.coalesce(given, "best_.root", root_id(conversation)))
    out = out.withColumn("root_source", F.when(given.isNotNull(), "metadata").otherwise(F.coalesce("best_.rule", root_rule(conversation))))
    return out.withColumn("root_known", F.col("best_").isNotNull()).drop("conv_", "best_")


def resolve_prefixes(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Each wanted id (column wanted) against known ids that begin with it: unique, ambiguous or not_found, the
    candidates joined by semicolons. A wanted id is at least 4 characters for the join to be by its first 4."""
    w = wanted.select("wanted").distinct().withColumn("head_", F.substring("wanted", 1, 4))
    k = known.select(F.col(known.columns[0]).alias("id_")).distinct().withColumn("head_", F.substring("id_", 1, 4))
    found = w.join(k, "head_", "left").where(F.col("id_").isNull() | F.col("id_").startswith(F.col("wanted")))
    found = found.groupBy("wanted").agg(F.count("id_").alias("n"), F.array_join(F.array_sort(F.collect_set("id_")), ";").alias("candidates"))
    found = w.select("wanted").join(found, "wanted", "left")
    n = F.coalesce("n", F.lit(0))
    return found.select("wanted", n.alias("n_candidates"), F.when(n == 0, "not_found").when(n == 1, "unique").otherwise("ambiguous").alias("resolution"), F.when(n == 1, F.col("candidates")).alias("resolved_id"), F.coalesce("candidates", F.lit("")).alias("candidates"))


def artifact_category(name: Column | str) -> Column:
    """The kind of an artifact by its name; aggregates come before raw records, whose word they hold too."""
    n = F.replace(F.lower(F.trim(as_column(name))), F.lit("-"), F.lit("_"))
    word = lambda w: n.rlike(f"(^|_){w}(_|$)")
    # Categories and the words that tell them
    return (
        F.when(word("bmk_?agentic"), "aggregated_agentic").when(word("agentic"), "raw_agentic").when(n.contains("server") & n.contains("log"), "server_log")
        .when(n.contains("results_bmk") | n.contains("run_stats"), "run_summary").otherwise("other")
    )


def _plain(name: Column) -> Column:
    """name in lower case without UUIDs, as Spark puts into the names of its files: -c817- may be a part of one."""
    return F.regexp_replace(F.lower(F.trim(name)), UUID, "")


def _concurrencies(plain: Column) -> Column:
    """The concurrencies that a plain name says, each once."""
    patterns = (rf"(?<![a-z0-9]){CONCURRENCY}[_.-]?(\d+)(?!\d)", rf"(?<![a-z0-9])(\d+)[_.-]?{CONCURRENCY}(?![a-z0-9])", r"(?:^|[_.-])c[_.-]?(\d+)(?:$|[_.-])")
    texts = F.flatten(F.array(*(F.regexp_extract_all(plain, F.lit(p), 1) for p in patterns)))
    return F.array_distinct(F.filter(F.transform(texts, lambda x: x.try_cast("int")), lambda x: x > 0))


def _first_concurrency(names: Column) -> Column:
    """The concurrency of the first of several names that has one. A step over a list reads the step before once, where
    nested expressions would match the same patterns again."""
    found = F.transform(F.transform(names, _plain), _concurrencies)
    return F.try_element_at(F.filter(found, lambda x: F.size(x) == 1), F.lit(1))[0]


def name_concurrency(name: Column | str) -> Column:
    """The concurrency in a name (conc8, 8conc or c8 between marks); null if there is none or names disagree. A UUID
    says nothing."""
    return _first_concurrency(F.array(as_column(name)))


def path_concurrency(path: Column | str) -> Column:
    """The concurrency of the innermost path part that has one."""
    parts = F.reverse(F.split(as_column(path), "/"))
    return _first_concurrency(F.filter(parts, lambda x: F.lower(x).contains("c") & x.rlike("[0-9]")))  # no others have one
