"""Checks of submissions: one row for each rule broken, with how often and up to five examples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.sources.tables import parse_ids


def check_lists(rows: DataFrame, entities: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """rows: s1_id and ids (comma list); entities: s1_id that must stand there; known: ids that may be listed.

    rule, n and examples for duplicate_row, duplicate_id, self_match, wrong_prefix, unknown_id, missing_entity and extra_entity.
    """
    split = rows.select("s1_id", parse_ids("ids").alias("ids"))
    listed = split.select("s1_id", F.explode("ids").alias("id"))
    have, want = split.select("s1_id").distinct(), entities.select("s1_id").distinct()
    found = {
        "duplicate_row": split.groupBy("s1_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("s1_id").alias("x")),
        "duplicate_id": split.where(F.size("ids") > F.size(F.array_distinct("ids"))).select(F.col("s1_id").alias("x")),
        "self_match": listed.where(F.col("id").startswith("S1-")).select(F.concat_ws(":", "s1_id", "id").alias("x")),
        "wrong_prefix": listed.where(~F.col("id").rlike("^S[123]-")).select(F.concat_ws(":", "s1_id", "id").alias("x")),
        "missing_entity": want.join(have, "s1_id", "left_anti").select(F.col("s1_id").alias("x")),
        "extra_entity": have.join(want, "s1_id", "left_anti").select(F.col("s1_id").alias("x")),
    }
    if known is not None:
        found["unknown_id"] = listed.join(known.select(F.col(known.columns[0]).alias("id")).distinct(), "id", "left_anti").select(F.concat_ws(":", "s1_id", "id").alias("x"))
    every = reduce(DataFrame.unionByName, [df.withColumn("rule", F.lit(k)) for k, df in found.items()])
    from linkloom.operators.retrieval import top

    counted = every.groupBy("rule").agg(F.count("*").alias("n"))
    first = top(every.distinct(), ["rule"], [F.asc("x")], 5).groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("x")), " ").alias("examples"))
    return counted.join(first, "rule")


def not_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches (s1_id, cand_id) that aren't candidates."""
    return matches.select("s1_id", "cand_id").join(candidates.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")
