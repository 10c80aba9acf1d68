"""Extension: candidates for a stream of records against a fixed index. Nothing of the kind is in the batch linkage itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_postings(records: DataFrame, key: str, keys: Column, posts: DataFrame) -> DataFrame:
    """query_id, cand_id and _key for each record of the stream: a stream-static join with posts (cand_id, _key), stateless."""
    probes = records.select(F.col(key).alias("query_id"), F.explode(F.array_distinct(keys)).alias("_key")).where("_key <> ''")
    return probes.join(posts, "_key").select("query_id", "cand_id", "_key")


def first_seen(pairs: DataFrame, time: str, late: str = "10 minutes") -> DataFrame:
    """Each (query_id, cand_id) once, with state for `late` after the watermark only."""
    return pairs.withWatermark(time, late).dropDuplicatesWithinWatermark(["query_id", "cand_id"])
