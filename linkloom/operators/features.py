"""Features of candidate pairs for scorers, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import similarity as S
from linkloom.functions import text as T
from linkloom.operators import mining

#: The stacker's features in their order, and defaults of a pair without a reverse lookup.
STACKER = (
    "matcher_p rank_source gap_to_best blank_address nonce_like domain_like name_prefix house_conflict name_claimants addr_claimants source "
    "log_name_claimants log_addr_claimants"
).split()
NO_REVERSE = {"reverse_rank": 99, "reverse_gap": 0.0, "reverse_claimants": 0}


def claimant_features(pairs: DataFrame, entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """pairs (s1_id, cand_id, ...) with flags of the candidate, of the two names and houses, and how many entities could claim it.

    entities and candidates: id, name, address. Parsed once a record, then joined; counts are per distinct name and key.
    """
    parsed = lambda df: df.select("id", "name", "address", T.parse_address("address").alias("_a"), mining.address_key("address").alias("addr_key"))
    left = parsed(entities).select(F.col("id").alias("s1_id"), F.col("name").alias("_ln"), F.col("_a.house").alias("_lh"), "addr_key")
    right = parsed(candidates)
    names = mining.name_claimants(right, left.select("s1_id", F.col("_ln").alias("name"))).withColumnRenamed("claimants", "name_claimants")
    right = mining.address_claimants(right.join(names, "name"), left.select("addr_key"))
    right = right.select(F.col("id").alias("cand_id"), F.col("name").alias("_rn"), F.col("address").alias("_ra"), F.col("_a.house").alias("_rh"), "name_claimants", "addr_claimants")
    both = pairs.join(left.drop("addr_key"), "s1_id").join(right, "cand_id")
    flag = lambda c: c.cast("int")
    own, other = T.content_tokens("_rn"), T.content_tokens("_ln")
    return both.withColumns(
        {
            "blank_address": flag(F.trim("_ra") == ""),
            "nonce_like": flag(T.is_nonce("_rn")),
            "domain_like": flag(T.is_domain("_rn")),
            "name_prefix": flag((F.size(own) > 0) & (F.size(F.array_except(own, other)) == 0)),
            "house_conflict": flag((F.col("_lh") != "") & (F.col("_rh") != "") & (F.col("_lh") != F.col("_rh"))),
        }
    ).drop("_ln", "_lh", "_rn", "_ra", "_rh")


def stacker_matrix(pairs: DataFrame, reverse: DataFrame | None = None) -> DataFrame:
    """The stacker's columns from packed pairs with claimant features; with the reverse lookup's three more."""
    df = pairs.withColumns(
        {
            "matcher_p": F.col("p"),
            "gap_to_best": F.col("best_entity") - F.col("p"),
            "log_name_claimants": F.log1p("name_claimants"),
            "log_addr_claimants": F.log1p("addr_claimants"),
        }
    )
    if reverse is None:
        return df.select("s1_id", "cand_id", *STACKER)
    found = reverse.withColumnRenamed("query_id", "s1_id")
    return df.join(found, ["s1_id", "cand_id"], "left").fillna(NO_REVERSE).select("s1_id", "cand_id", *STACKER, *NO_REVERSE)


def pair_vector(left_name: Column, right_name: Column, left_address: Column, right_address: Column, full: bool = False) -> dict[str, Column]:
    """Similarities of normalised names and addresses; the full vector adds the string ratios, which run in Python."""
    out = {}
    for k, a, b in (("name", left_name, right_name), ("address", left_address, right_address)):
        x, y = T.tokens(a), T.tokens(b)
        out |= {
            f"{k}_jaccard": S.jaccard(x, y),
            f"{k}_trigrams": S.jaccard(S.char_ngrams(a), S.char_ngrams(b)),
            f"{k}_digits": S.jaccard(F.filter(x, lambda t: t.rlike("[0-9]")), F.filter(y, lambda t: t.rlike("[0-9]"))),
            f"{k}_equal": ((a == b) & (a != "")).cast("int"),
        }
        if full:
            out |= {f"{k}_jw": S.jaro_winkler(a, b), f"{k}_ratio": S.ratio(a, b), f"{k}_sorted": S.token_sort_ratio(a, b), f"{k}_partial": S.partial_ratio(a, b)}
    return out | {"acronym": S.acronym_hit(T.tokens(left_name), T.tokens(right_name)).cast("int")}


def loss_kind(left_name: Column, right_name: Column, right_address: Column) -> Column:
    """Why a pair is hard: the first of indic, domain, blank_addr, nonce_alias, near_miss."""
    apart = ~F.arrays_overlap(T.content_tokens(left_name), T.content_tokens(right_name))
    return (
        F.when(T.is_indic(right_name), "indic").when(T.is_domain(right_name), "domain").when(F.trim(right_address) == "", "blank_addr").when(apart, "nonce_alias").otherwise("near_miss")
    )


def augment(pairs: DataFrame, key: Column, label: str = "label", address: str = "address", country: str = "country", seed: int = 13) -> DataFrame:
    """Training pairs with addresses of 15 % of positives and countries of 20 % left blank, by a hash of the key."""
    draw = lambda k: F.pmod(F.xxhash64(F.lit(seed + k), key), F.lit(100))
    return pairs.withColumns(
        {address: F.when((F.col(label) == 1) & (draw(0) < 15), "").otherwise(F.col(address)), country: F.when(draw(1) < 20, "").otherwise(F.col(country))}
    )


def bucket_recovery(pairs: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """Pairs above the threshold before and after, by bucket: columns old and new are scores."""
    over = lambda c: F.sum((F.col(c) >= threshold).cast("int"))
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), over("old").alias("old"), over("new").alias("new"))
