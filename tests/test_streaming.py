from pyspark.sql import functions as F

from linkloom.streaming.lookup import first_seen, stream_postings


def test_stream_lookup(spark, tmp_path):
    schema = "id string, ks array<string>, ts timestamp"
    rows = [("q1", ["a", "b"], "2024-01-01 00:00:00"), ("q2", ["z"], "2024-01-01 00:00:01"), ("q1", ["a"], "2024-01-01 00:00:02")]
    spark.createDataFrame(rows, "id string, ks array<string>, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    posts = spark.createDataFrame([("d1", "a"), ("d2", "b"), ("d3", "c")], "cand_id string, _key string")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    found = stream_postings(stream, "id", F.col("ks"), posts).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    q = first_seen(found, "ts").writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        assert sorted((r["query_id"], r["cand_id"]) for r in spark.table("found").collect()) == [("q1", "d1"), ("q1", "d2")]
    finally:
        q.stop()
