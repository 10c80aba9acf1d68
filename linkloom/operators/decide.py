"""Which scored pairs (s1_id, cand_id, source, p) become links."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Caps of the sources 2 and 3, and the score that passes caps.
SOURCE_CAPS, EXEMPT = {2: 5, 3: 6}, 0.99
RULE = {"threshold": 0.74, "alpha": 0.5, "gate": 0.0, "cap": 6}

def _entity():
    return Window.partitionBy("s1_id")


def pack(pairs: DataFrame) -> DataFrame:
    """Ranks among the entity's pairs and among those of the source, and the best scores of both."""
    order = [F.desc("p"), F.asc("cand_id")]
    source = Window.partitionBy("s1_id", "source")
    return pairs.withColumns(
        {
            "rank_entity": F.row_number().over(_entity().orderBy(*order)).cast("long"),
            "rank_source": F.row_number().over(source.orderBy(*order)).cast("long"),
            "best_entity": F.max("p").over(_entity()),
            "best_source": F.max("p").over(source),
        }
    )


def keep(rule: dict, exempt: float = EXEMPT, caps: dict[int, int] | None = None) -> Column:
    """A packed pair stays if the entity's best passes the gate, its score the threshold and alpha times the best, and its source rank the cap, from which only a score of `exempt` frees."""
    caps = SOURCE_CAPS if caps is None else caps
    cap = F.coalesce(*[F.when(F.col("source") == s, F.least(F.lit(c), F.lit(rule["cap"]))) for s, c in caps.items()], F.lit(rule["cap"]))
    return (
        (F.col("best_entity") >= rule["gate"]) & (F.col("p") >= rule["threshold"]) & (F.col("p") >= rule["alpha"] * F.col("best_entity")) & ((F.col("rank_source") <= cap) | (F.col("p") >= exempt))
    )


def keep_probe(rule: dict) -> Column:
    """The same with a cap on the entity's rank and no exemption."""
    return (F.col("best_entity") >= rule["gate"]) & (F.col("p") >= rule["threshold"]) & (F.col("p") >= rule["alpha"] * F.col("best_entity")) & (F.col("rank_entity") <= rule["cap"])


def cascade(pairs: DataFrame, n: int, floor: float) -> DataFrame:
    """The n best of each entity, and all from the floor on."""
    rank = F.row_number().over(_entity().orderBy(F.desc("p"), F.asc("cand_id")))
    return pairs.withColumn("_rank", rank).where((F.col("_rank") <= n) | (F.col("p") >= floor)).drop("_rank")


def select_a(pairs: DataFrame, threshold: float, alpha: float, gate: float, cap: int) -> DataFrame:
    """Empty if the best is below the gate; cut at the lower of threshold and alpha times the best; at most cap. Of a pair that repeats the best score counts."""
    best = F.row_number().over(Window.partitionBy("s1_id", "cand_id").orderBy(F.desc("p"), *[F.asc(c) for c in pairs.columns if c != "p"]))
    packed = pack(pairs.withColumn("_best", best).where("_best = 1").drop("_best"))
    return packed.where((F.col("best_entity") >= gate) & (F.col("p") >= F.least(F.lit(threshold), alpha * F.col("best_entity"))) & (F.col("rank_entity") <= cap)).select(*pairs.columns)


def unique_mapping(pairs: DataFrame) -> DataFrame:
    """Each candidate goes to the entity that scores it highest; of equals the least. Only candidates are exclusive, so one ranking settles all."""
    best = F.row_number().over(Window.partitionBy("cand_id").orderBy(F.desc("p"), F.asc("s1_id")))
    return pairs.withColumn("_best", best).where("_best = 1").drop("_best")


def grid(thresholds: list[float], alphas: list[float], gates: list[float], caps: list[int]) -> list[dict]:
    return [dict(zip(("threshold", "alpha", "gate", "cap"), x)) for x in product(thresholds, alphas, gates, caps)]


def grid_search(pairs: DataFrame, gold: DataFrame, rules: list[dict]) -> DataFrame:
    """index and macro F0.5 of each rule over the entities of gold (s1_id, n_gold), before mapping.

    Rules are one aggregate's columns: pairs (with is_gold) are read and shuffled once for all rules.
    """
    packed = pack(pairs)
    rows = [(F.sum(F.when(keep(r), 1).otherwise(0)).alias(f"n{i}"), F.sum(F.when(keep(r) & F.col("is_gold"), 1).otherwise(0)).alias(f"h{i}")) for i, r in enumerate(rules)]
    by = packed.groupBy("s1_id").agg(*[c for two in rows for c in two])
    both = gold.join(by, "s1_id", "left")
    from linkloom.operators.metrics import f_beta

    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    one = both.agg(*[F.avg(f_beta(zero(f"h{i}"), zero(f"n{i}"), F.col("n_gold"))).alias(f"f{i}") for i in range(len(rules))])
    return one.select(F.posexplode(F.array(*[F.col(f"f{i}") for i in range(len(rules))])).alias("rule", "f05")).withColumn("f05", F.round("f05", 6))


def split_of(key: Column, modulus: int = 10, salt: str = "") -> Column:
    """A stable bucket of an id: the first 8 hex digits of its salted MD5, modulo."""
    return F.pmod(F.conv(F.left(F.md5(F.concat(F.lit(salt), key)), F.lit(8)), 16, 10).cast("long"), F.lit(modulus))


def stratified(df: DataFrame, strata: list[str], key: str, size: int, salt: str = "13") -> DataFrame:
    """About size rows: of each stratum its share, at least one, those of least salted MD5."""
    order = F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))
    whole = df.groupBy(*strata).agg(F.count("*").alias("_n"))
    total = whole.agg(F.sum("_n").alias("_all"))
    quota = whole.crossJoin(F.broadcast(total)).select(*strata, F.greatest(F.lit(1), F.floor(F.col("_n") * size / F.col("_all") + 0.5)).alias("_quota"))  # one row
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy(*strata).orderBy(order, key)))
    return ranked.join(F.broadcast(quota) if len(strata) == 0 else quota, strata).where("_k <= _quota").select(*df.columns)
