"""Precision-weighted measures of linkage, all macro averages over the entity list, not over pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f_beta(hits: Column, predicted: Column, gold: Column, beta2: float = 0.25) -> Column:
    """F-beta of counts; both empty: 1, one empty or nothing in common: 0."""
    p, r = hits / F.greatest(predicted, F.lit(1)), hits / F.greatest(gold, F.lit(1))
    return F.when((predicted == 0) & (gold == 0), 1.0).when(hits == 0, 0.0).otherwise((1 + beta2) * p * r / F.greatest(beta2 * p + r, F.lit(1e-300)))


def entity_counts(entities: DataFrame, predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """entities with n_pred, n_gold and n_hit, from pairs (s1_id, cand_id)."""
    pairs = predicted.select("s1_id", "cand_id", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(gold.select("s1_id", "cand_id", F.lit(0).alias("x"), F.lit(1).alias("y")))
    pairs = pairs.groupBy("s1_id", "cand_id").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    by = pairs.groupBy("s1_id").agg(F.sum("x").alias("n_pred"), F.sum("y").alias("n_gold"), F.sum(F.col("x") * F.col("y")).alias("n_hit"))
    return entities.join(by, "s1_id", "left").fillna(0, ["n_pred", "n_gold", "n_hit"])


def entity_scores(counts: DataFrame) -> DataFrame:
    """precision (1 of an empty prediction), recall (of empty gold: 1 if the prediction is empty) and f05 for each entity."""
    p = F.when(F.col("n_pred") == 0, 1.0).otherwise(F.col("n_hit") / F.greatest(F.col("n_pred"), F.lit(1)))
    r = F.when(F.col("n_gold") == 0, (F.col("n_pred") == 0).cast("double")).otherwise(F.col("n_hit") / F.greatest(F.col("n_gold"), F.lit(1)))
    return counts.withColumns({"precision": p, "recall": r, "f05": f_beta(F.col("n_hit"), F.col("n_pred"), F.col("n_gold"))})


def macro(scores: DataFrame, *by: str) -> DataFrame:
    """Averages over entities, and the share of singletons (no gold) that stay single."""
    single = F.when(F.col("n_gold") == 0, (F.col("n_pred") == 0).cast("double"))
    return scores.groupBy(*by).agg(
        F.count("*").alias("entities"), F.round(F.avg("precision"), 6).alias("macro_precision"), F.round(F.avg("recall"), 6).alias("macro_recall"),
        F.round(F.avg("f05"), 6).alias("macro_f05"), F.round(F.avg(single), 6).alias("singleton_accuracy"),
    )


def error_ledger(gold: DataFrame, packed: DataFrame, assigned: DataFrame, threshold: float, keep: Column) -> DataFrame:
    """Each gold pair and its outcome: blocking_miss, hit, below_threshold, cap_cut, or umc_or_alpha, the first that holds."""
    have = packed.select("s1_id", "cand_id", "p", keep.alias("_keep"), (F.col("rank_source") > 0).alias("_seen"))
    won = assigned.select("s1_id", "cand_id", F.lit(True).alias("_won"))
    both = gold.join(have, ["s1_id", "cand_id"], "left").join(won, ["s1_id", "cand_id"], "left")
    outcome = F.when(F.col("_seen").isNull(), "blocking_miss").when(F.col("_won"), "hit").when(F.col("p") < threshold, "below_threshold").when(~F.col("_keep"), "cap_cut").otherwise("umc_or_alpha")
    return both.withColumn("outcome", outcome).drop("_keep", "_seen", "_won")


def prediction_sanity(entities: DataFrame, predicted: DataFrame, by: str = "country") -> DataFrame:
    n = predicted.groupBy("s1_id").agg(F.count("*").alias("n"))
    rows = entities.join(n, "s1_id", "left").fillna(0, ["n"])
    return rows.groupBy(by).agg(F.count("*").alias("entities"), F.round(F.avg((F.col("n") == 0).cast("double")), 6).alias("singleton_rate"), F.round(F.avg("n"), 6).alias("mean_list"))


def typed_errors(predicted: DataFrame, gold: DataFrame, blocked: DataFrame) -> DataFrame:
    """s1_id, other_id, error_type and in_candidates of wrong and missed pairs.

    A link of an entity without gold is a singleton_false_merge, another wrong one a false_positive; a missed pair is a
    blocking_miss if it was never a candidate, else a false_negative.
    """
    have = gold.select("s1_id").distinct().withColumn("_has", F.lit(True))
    seen = blocked.select("s1_id", "cand_id").distinct().withColumn("_seen", F.lit(True))
    wrong = predicted.select("s1_id", "cand_id").join(gold, ["s1_id", "cand_id"], "left_anti").join(have, "s1_id", "left")
    wrong = wrong.withColumn("error_type", F.when(F.col("_has"), "false_positive").otherwise("singleton_false_merge")).drop("_has")
    missed = gold.select("s1_id", "cand_id").join(predicted, ["s1_id", "cand_id"], "left_anti").withColumn("error_type", F.lit(None).cast("string"))
    both = wrong.unionByName(missed).join(seen, ["s1_id", "cand_id"], "left").withColumn("in_candidates", F.coalesce("_seen", F.lit(False)))
    kind = F.coalesce("error_type", F.when(F.col("in_candidates"), "false_negative").otherwise("blocking_miss"))
    return both.select("s1_id", F.col("cand_id").alias("other_id"), kind.alias("error_type"), "in_candidates")


def examples(errors: DataFrame, n: int = 15) -> DataFrame:
    """The first n errors of each type, for a report."""
    from linkloom.operators.retrieval import top

    return top(errors, ["error_type"], [F.asc("s1_id"), F.asc("other_id")], n)
