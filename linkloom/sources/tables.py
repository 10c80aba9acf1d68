"""Readers and writers of linkage tables: tab-separated sources, truth, submissions, pair tables, mined tables, reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
TRUTH_COLUMNS = ["source1_entity_id", "matched_entity_ids"]


def parse_ids(c: Column | str) -> Column:
    """'a, b,,c' as [a, b, c]: trimmed, without empties, repeats kept."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")


def _tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings by the file's header; a missing column is an error, null is ""."""
    df = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("escape", "").option("inferSchema", False).csv(path)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])


def read_source(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """entity_id, business_name, business_address, country. Strict: trimmed, and a repeated id fails the job that reads it."""
    df = _tsv(spark, path, SOURCE_COLUMNS)
    if not strict:
        return df
    df = df.select(*[F.trim(c).alias(c) for c in SOURCE_COLUMNS])
    repeats = df.groupBy("entity_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.min("entity_id").alias("_twice"))
    checked = df.crossJoin(F.broadcast(repeats))  # one row
    return checked.where(F.when(F.col("_twice").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("repeated id "), F.col("_twice"))).cast("boolean"))).drop("_twice")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """s1_id and matches (array)."""
    df = _tsv(spark, path, TRUTH_COLUMNS)
    return df.select(F.trim("source1_entity_id").alias("s1_id"), parse_ids("matched_entity_ids").alias("matches"))


def gold_pairs(truth: DataFrame) -> DataFrame:
    return truth.select("s1_id", F.explode("matches").alias("cand_id")).distinct()


def load_split(spark: SparkSession, folder: str, split: str, strict: bool = True) -> dict[str, DataFrame]:
    out = {f"source{k}": read_source(spark, f"{folder}/{split}_source{k}.tsv", strict) for k in (1, 2, 3)}
    try:
        out["truth"] = read_truth(spark, f"{folder}/{split}_ground_truth.tsv")
    except Exception as e:  # a split for scoring has no truth
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return out


def submission(entities: DataFrame, pairs: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """A row for each entity (s1_id): its candidates as a comma list, sorted and each once, "" for none."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias("_ids"))
    return entities.select("s1_id").join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce("_ids", F.lit("")).alias(column))


def write_submission(rows: DataFrame, path: str) -> None:
    """Tab-separated parts with headers, sorted by entity."""
    rows.orderBy(rows.columns[0]).write.option("sep", "\t").option("header", True).option("emptyValue", "").option("quote", "").mode("overwrite").csv(path)


def write_pairs(pairs: DataFrame, path: str, by: str = "split") -> None:
    pairs.write.mode("overwrite").partitionBy(by).parquet(path)


def score_shards(pairs: DataFrame, path: str, score, shards: int = 16) -> DataFrame:
    """Scores pairs shard by shard of their entity. A shard's folder is marked when it is whole: a run leaves out those that are, and writes others anew."""
    spark = pairs.sparkSession
    pairs = pairs.withColumn("shard", F.pmod(F.xxhash64("s1_id"), F.lit(shards)).cast("int"))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for k in range(shards):
        folder = f"{path}/shard={k}"
        mark = hadoop.Path(f"{folder}/_SUCCESS")  # the committer's last file
        if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
            score(pairs.where(F.col("shard") == k)).drop("shard").write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(folder)
    return spark.read.parquet(path)


def write_mined(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def read_mined(spark: SparkSession, path: str, schema: str, default: list[tuple] = ()) -> DataFrame:
    """A mined table, or the default rows where there is none."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame(list(default), schema)


def write_report(row: DataFrame, path: str) -> dict:
    """A one-row aggregate as a JSON file on the driver."""
    out = row.first().asDict(recursive=True)
    Path(path).write_text(json.dumps(out, indent=2, default=str))
    return out


def read_rule(paths: list[str]) -> dict:
    """The rule of the first decision file that has one."""
    for p in map(Path, paths):
        if p.exists() and "rule" in (found := json.loads(p.read_text())):
            return found["rule"]
    raise FileNotFoundError("no decision file has a rule")


def inspect(tables: dict[str, DataFrame]) -> dict[str, dict]:
    """Rows, columns and, of the first source, countries."""
    out = {k: {"rows": df.count(), "columns": df.columns} for k, df in tables.items()}
    if "source1" in tables:
        out["source1"]["countries"] = [r[0] for r in tables["source1"].select("country").distinct().orderBy("country").collect()]
    return out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of the files of a folder."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
