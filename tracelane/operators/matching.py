"""Joins of requests to source turns, with the class of every match stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.functions.coerce import number
from tracelane.functions.ids import same_number, source_key
from tracelane.operators.keys import only_unique


def member_flag(df: DataFrame, column: str, ids: DataFrame, name: str) -> DataFrame:
    """df with a flag: whether the column's value is among the ids (one column)."""
    known = ids.select(F.col(ids.columns[0]).alias("known_")).where("known_ is not null").distinct()
    return df.join(known, F.col(column) == F.col("known_"), "left").withColumn(name, F.col("known_").isNotNull()).drop("known_")


def has_branch(df: DataFrame, source: DataFrame, root: str, path: str, name: str = "branch_known") -> DataFrame:
    pairs = source.select(F.col(root).alias("r_"), F.col(path).alias("p_")).where("r_ is not null and p_ is not null").distinct()
    return df.join(pairs, (F.col(root) == F.col("r_")) & (F.col(path) == F.col("p_")), "left").withColumn(name, F.col("r_").isNotNull()).drop("r_", "p_")


def exact_turns(left: DataFrame, right: DataFrame, on: dict[str, str], take: dict[str, str]) -> DataFrame:
    """left with columns of the one right row whose key is equal; ambiguous and incomplete right keys match nothing.

    on: left column -> right column; take: right column -> new name. Adds turn_matched.
    """
    unique = only_unique(right, list(on.values())).select(*(F.col(r).alias(f"k{i}_") for i, r in enumerate(on.values())), *(F.col(c).alias(n) for c, n in take.items()))
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & (F.col(c) == F.col(f"k{i}_"))
    return left.join(unique, same, "left").withColumn("turn_matched", F.col("k0_").isNotNull()).drop(*(f"k{i}_" for i in range(len(on))))


def match_class(loader: Column, input_same: Column, turn: Column, branch: Column, root: Column) -> Column:
    """The best statement about a match. A loader match overrides an earlier turn match, and counts as exact only if
    the input sizes agree."""
    return (
        F.when(loader & F.coalesce(input_same, F.lit(False)), "exact_turn_match").when(loader, "loader_metadata_turn_match").when(turn, "exact_turn_match")
        .when(branch, "branch_match_unverified").when(root, "root_match_only").otherwise("unmatched")
    )


def loader_join(df: DataFrame, source: DataFrame) -> DataFrame:
    """df joined to source turns by (root, outer, inner): adds loader_key, loader_matched, source sizes, input_same and
    output_same. Source rows with unknown input size or an ambiguous key match nothing."""
    keyed = df.withColumn("loader_key", source_key("source_trace_id", "source_outer_idx", "source_inner_idx"))
    src = source.where(F.col("source_input_tokens").isNotNull()).withColumn("k_", source_key("root_trace_id", "source_outer_request_index", "source_inner_request_index"))
    src = only_unique(src, ["k_"]).select("k_", "source_input_tokens", "source_output_tokens", "source_conversation_path", "source_branch_type")
    out = keyed.join(src, F.col("loader_key") == F.col("k_"), "left").withColumn("loader_matched", F.col("k_").isNotNull()).drop("k_")
    return out.withColumns({"input_same": same_number("input_tokens", "source_input_tokens"), "output_same": same_number("output_tokens", "source_output_tokens")})


def match_turns(df: DataFrame, source: DataFrame) -> DataFrame:
    """Requests with their source turn by loader metadata, else by (root, path, index, input size), and match_class."""
    out = loader_join(df.drop("source_conversation_path", "source_branch_type"), source)
    turns = {"root_trace_id": "root_trace_id", "request_path": "source_conversation_path", "turn_index": "source_branch_request_index", "input_tokens": "source_input_tokens"}
    out = exact_turns(out, source, turns, {"source_output_tokens": "turn_output_tokens"})
    pairs = source.select(F.col("root_trace_id").alias("r_"), F.col("source_conversation_path").alias("p_")).distinct()
    out = out.join(pairs, (F.col("root_trace_id") == F.col("r_")) & (F.col("request_path") == F.col("p_")), "left").withColumn("branch_known", F.col("r_").isNotNull()).drop("r_", "p_")
    out = member_flag(out, "root_trace_id", source.select("root_trace_id"), "root_known")
    return out.withColumn("match_class", match_class(F.col("loader_matched"), F.col("input_same"), F.col("turn_matched"), F.col("branch_known"), F.col("root_known")))


def match_validation(path_same: Column, turn_same: Column) -> Column:
    """An exact key match judged by whether source paths and turn indexes agree too (null: one side lacks it)."""
    bad, good = (F.coalesce(x, F.lit(False)) for x in (~path_same | ~turn_same, path_same & turn_same))
    # verdicts
    return F.when(bad, "key_match_validation_conflict").when(good, "high_confidence_exact").otherwise("key_match_validation_missing")


def presence_matrix(universe: DataFrame, observed: DataFrame, key: str, column: str, values: list) -> DataFrame:
    """A row for each id of the universe or observed, a column n_<value> of counts for each value, 0 where none."""
    ids = universe.select(F.col(universe.columns[0]).alias(key)).unionByName(observed.select(key)).where(F.col(key).isNotNull()).distinct()
    counts = observed.groupBy(key).agg(*(F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values))
    return ids.join(counts, key, "left").na.fill(0, [f"n_{v}" for v in values])


def observed_flags(universe: DataFrame, observed: DataFrame, key: str, column: str, values: list) -> DataFrame:
    """Every (id, value) of the universe and a fixed short list of values, with whether it was observed."""
    listed = universe.withColumn(column, F.explode(F.array(*map(F.lit, values))))
    seen = observed.select(key, column).distinct().withColumn("seen_", F.lit(True))
    return listed.join(seen, [key, column], "left").withColumn("observed", F.coalesce("seen_", F.lit(False))).drop("seen_")


def set_sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of two id sets (first columns), their intersection, differences and Jaccard index, in one pass."""
    x = a.select(F.col(a.columns[0]).alias("id")).where("id is not null").distinct().withColumn("in_a", F.lit(1))
    y = b.select(F.col(b.columns[0]).alias("id")).where("id is not null").distinct().withColumn("in_b", F.lit(1))
    both = x.join(y, "id", "full_outer")
    n = both.agg(F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("n_both"), F.count("*").alias("n_either"))
    return n.select("n_a", "n_b", "n_both", (F.col("n_a") - F.col("n_both")).alias("only_a"), (F.col("n_b") - F.col("n_both")).alias("only_b"), F.when(F.col("n_either") > 0, F.col("n_both") / F.col("n_either")).alias("jaccard"))


def tolerant(a: str, b: str, limit: float) -> Column:
    return F.abs(number(a) - number(b)) <= limit
