"""Shards that all match the mixture of sources, by proportional stratified interleaving.

Rows of each source are put in a seeded random order; row k of n gets the fractional rank (k - 1 + u) / n, u being a
seeded number of its source; all rows sorted by it are cut into equal runs. Any run of the order then holds each
source's share to within one row, and a source of a single row can land anywhere.

Neither order is made in one task: hashes (and fractions) fall evenly into about sqrt(rows) buckets, ranks are
counted within (source, bucket), and the sizes of the buckets before are added. A hot source is dealt over all buckets.

Defined results: null text has size 16 and checksum 0; null source is a source of its own; rows repeated as a whole
get different places by their order in ties, which doesn't change any count; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import root_buckets, table, unit

SHARDS = 40
SEED = 20


def interleave(rows: DataFrame, rows_count: int, shards: int = SHARDS, by: str = "source", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """rows with shard and slot; counts of shards are at most one apart."""
    buckets = root_buckets(rows_count)
    df = rows.withColumn("_s_h", unit(F.lit(seed), F.col(key), F.col(by)))
    df = df.withColumn("_s_by", F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")))
    df = df.withColumn("_s_b", F.floor(F.col("_s_h") * buckets).cast("int"))
    sizes = df.groupBy("_s_by", "_s_b").count()
    whole = Window.partitionBy("_s_by")
    before = whole.orderBy("_s_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_s_by", "_s_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_s_before"), F.sum("count").over(whole).alias("_s_n"))
    df = df.withColumn("_s_k", F.row_number().over(Window.partitionBy("_s_by", "_s_b").orderBy("_s_h", key, "text_crc32", "size")))
    df = df.join(sizes, ["_s_by", "_s_b"])
    frac = (F.col("_s_before") + F.col("_s_k") - 1 + unit(F.lit(seed + 1), "_s_by")) / F.col("_s_n")
    df = df.withColumn("_s_f", frac).withColumn("_s_b", F.least(F.floor(F.col("_s_f") * buckets).cast("int"), F.lit(buckets - 1)))
    # one row for each of about sqrt(rows) buckets
    totals = df.groupBy("_s_b").count()
    totals = totals.select("_s_b", F.coalesce(F.sum("count").over(Window.orderBy("_s_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s_start"))
    place = F.row_number().over(Window.partitionBy("_s_b").orderBy("_s_f", "_s_by", "_s_h", key, "text_crc32", "size"))
    df = df.drop("_s_before").withColumn("_s_k", place).join(totals, "_s_b").withColumn("_s_at", F.col("_s_start") + F.col("_s_k") - 1)
    df = df.withColumn("shard", F.expr(f"_s_at * {shards} DIV {max(rows_count, 1)}").cast("int"))
    first = F.expr(f"(shard * {max(rows_count, 1)}L + {shards - 1}) DIV {shards}")
    return df.withColumn("slot", (F.col("_s_at") - first).cast("long")).drop(*[c for c in df.columns if c.startswith("_s_")])


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = interleave(rows, docs.count())
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
