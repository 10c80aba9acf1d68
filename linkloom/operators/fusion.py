"""Fusion of ranked lists (query_id, cand_id, list_name, rank) and their recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.retrieval import top

#: Fixed values.
RRF_K, KEEP_SHARE, KEEP_MOST, RESERVED = 60, 0.99, 30, 8


def rrf(lists: DataFrame, k: int = 100) -> DataFrame:
    """Sum of 1 / (60 + rank) over lists, best k; of equals the least candidate."""
    summed = lists.groupBy("query_id", "cand_id").agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 12).alias("rrf"))
    return top(summed, ["query_id"], [F.desc("rrf"), F.asc("cand_id")], k)


def reserved(fused: DataFrame, extra: DataFrame, keep: int = 25, slots: int = RESERVED) -> DataFrame:
    """fused up to keep, then up to `slots` candidates of extra (with list_order) that aren't among them, scored 1 / (60 + slot)."""
    base = fused.where(F.col("rank") <= keep).select("query_id", "cand_id", "rrf", "rank")
    new = extra.join(base.select("query_id", "cand_id"), ["query_id", "cand_id"], "left_anti")
    new = new.groupBy("query_id", "cand_id").agg(F.min(F.struct("list_order", "rank")).alias("_at"))
    new = top(new, ["query_id"], [F.asc("_at"), F.asc("cand_id")], slots, "_slot")
    new = new.select("query_id", "cand_id", (1 / (RRF_K + F.col("_slot"))).alias("rrf"), (F.lit(keep) + F.col("_slot")).alias("rank"))
    return base.unionByName(new)


def recall_curve(gold: DataFrame, fused: DataFrame, at: list[int]) -> DataFrame:
    """k and recall: gold pairs (query_id, cand_id) found among the first k of their query, by all gold pairs."""
    found = gold.join(fused.select("query_id", "cand_id", "rank"), ["query_id", "cand_id"], "left")
    one = found.agg(*[F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(str(k)) for k in at])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.round(F.col(str(k)), 6).alias("recall")) for k in at])).alias("_x")).select("_x.*")


def choose_keep(curves: list[dict[int, float]], share: float = KEEP_SHARE, most: int = KEEP_MOST) -> int:
    """The least k whose recall is the share of the last point's on every curve, at most `most`."""
    return min([k for k in sorted(curves[0]) if all(c[k] >= share * c[max(c)] for c in curves)] + [most])
