"""Dictionaries and counts mined from linked records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.session import written


def majority(pairs: DataFrame, key: str, value: str, support: int, purity: float) -> DataFrame:
    """The most frequent value of each key with its count, if it has the support and the share; of equals the least."""
    counted = pairs.groupBy(key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    ranked = counted.withColumns({"_all": F.sum("n").over(w), "_k": F.row_number().over(w.orderBy(F.desc("n"), F.asc(value)))})
    return ranked.where((F.col("_k") == 1) & (F.col("n") >= support) & (F.col("n") >= purity * F.col("_all"))).select(key, value, "n")


def positional_pairs(rows: DataFrame, left: Column, right: Column) -> DataFrame:
    """key and value at the same positions of two token arrays of one length."""
    both = rows.select(left.alias("l"), right.alias("r")).where(F.size("l") == F.size("r"))
    return both.select(F.explode(F.arrays_zip("l", "r")).alias("x")).select(F.col("x.l").alias("key"), F.col("x.r").alias("value"))


def unigrams(rows: DataFrame, name: Column) -> DataFrame:
    return rows.select(F.explode(T.tokens(name)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def segments(stems: DataFrame, counts: DataFrame) -> DataFrame:
    """stem and words: distinct stems, cut by all the unigrams (token, n). Each stem meets its own pieces' counts by a join, so no vocabulary is gathered."""
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("vocabulary"))
    known = stems.select("stem", F.explode(T.pieces("stem")).alias("token")).join(counts, "token")
    known = known.groupBy("stem").agg(F.collect_list(F.struct("token", "n")).alias("known"))
    rows = stems.join(known, "stem", "left").crossJoin(F.broadcast(size))  # one row
    words, n = F.coalesce(F.col("known.token"), F.array().cast("array<string>")), F.coalesce(F.col("known.n"), F.array().cast("array<long>"))
    return rows.select("stem", F.array_join(T.segment_by("stem", words, n, "total", "vocabulary"), " ").alias("words"))


def name_claimants(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """name and the number of entities whose content tokens hold all of the name's: 0 for a name without any.

    Entities are looked up by the name's rarest token alone and then checked, so common words meet nothing.
    candidates: name; entities: s1_id, name.
    """
    owned = entities.select("s1_id", F.array_distinct(T.content_tokens("name")).alias("have"))
    posts = owned.select("s1_id", "have", F.explode("have").alias("token"))
    df = posts.groupBy("token").agg(F.count("*").alias("df"))
    names = candidates.select("name").distinct().withColumn("want", F.array_distinct(T.content_tokens("name")))
    tokens = names.select("name", "want", F.explode("want").alias("token")).join(df, "token", "left")
    # a token that no entity has counts as the rarest
    rarest = tokens.groupBy("name").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("r"), F.first("want").alias("want"))
    hits = rarest.select("name", "want", F.col("r.token").alias("token")).join(posts, "token").where(F.size(F.array_except("want", "have")) == 0)
    return names.select("name").join(hits.groupBy("name").agg(F.count("*").alias("claimants")), "name", "left").fillna(0, ["claimants"])


def address_claimants(candidates: DataFrame, entities: DataFrame, key: str = "addr_key") -> DataFrame:
    """candidates with the number of entities of the same non-empty address key."""
    n = entities.where(F.col(key) != "").groupBy(key).agg(F.count("*").alias("addr_claimants"))
    return candidates.join(n, key, "left").fillna(0, ["addr_claimants"])


def address_key(c: Column | str) -> Column:
    """house|street of an address; "" unless it has both."""
    a = T.parse_address(c)
    return F.when((a["house"] != "") & (a["street_core"] != ""), F.concat_ws("|", a["house"], a["street_core"])).otherwise("")


def similar_tokens(pairs: DataFrame, left: Column, right: Column, low: float = 55.0, high: float = 99.0) -> DataFrame:
    """Tokens of linked records' two sides that are alike but not equal, with their count: a source of abbreviations.

    Distinct token pairs are scored, not their occurrences.
    """
    from linkloom.functions.similarity import ratio

    a = pairs.select(F.array_except(left, right).alias("l"), F.array_except(right, left).alias("r"))
    counted = a.select(F.explode("l").alias("left"), "r").select("left", F.explode("r").alias("right")).groupBy("left", "right").agg(F.count("*").alias("n"))
    return counted.withColumn("similarity", F.round(ratio("left", "right"), 6)).where(F.col("similarity").between(low, high))


def model_one(pairs: DataFrame, rounds: int = 6) -> DataFrame:
    """Translation probabilities p(native | latin) by expectation maximisation over (latin, native) token arrays.

    Each round is an equi-join and two aggregates. The table is written, so its plan stays one round long.
    """
    rows = pairs.select(F.monotonically_increasing_id().alias("row"), "latin", "native").select("row", F.explode("latin").alias("l"), "native").select("row", "l", F.explode("native").alias("n"))
    rows = rows.groupBy("row", "l", "n").agg(F.count("*").alias("c"))
    rows = written(rows, "aligned")
    t = rows.select("l", "n").distinct().withColumn("p", F.lit(1.0))
    for _ in range(rounds):
        e = rows.join(t, ["l", "n"]).withColumn("share", F.col("c") * F.col("p") / F.sum(F.col("p")).over(Window.partitionBy("row", "n")))
        got = e.groupBy("l", "n").agg(F.sum("share").alias("s"))
        t = written(got.select("l", "n", (F.col("s") / F.sum("s").over(Window.partitionBy("l"))).alias("p")), "model")
    return t
