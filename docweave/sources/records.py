"""Readers and writers of papers, pair labels, predictions, feature shards and summaries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAPERS = "paper_id string, title string, abstract string, venue string, publication_year string, reference_count string, reference_titles array<string>, node_path string, split_index int"
PAIR_LABELS = "pair_id string, paper_a_id string, paper_b_id string, label string, split string, paper_a_title string, paper_b_title string, paper_a_node_path string, paper_b_node_path string"
PREDICTIONS = "pair_id string, split string, paper_a_id string, paper_b_id string, paper_a_title string, paper_b_title string, true_label string, predicted_label string, method string, prob_A_TO_B double, prob_B_TO_A double, prob_PEER double, prob_NONE double"
SHARDS = "pair_id string, paper_a_id string, paper_b_id string, label string, y int, slot int, mask boolean, x array<float>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object on each line; blank lines are skipped, malformed ones stop the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, PAPERS).withColumn("split_index", F.coalesce("split_index", F.lit(0)))


def read_pair_labels(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, PAIR_LABELS)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_predictions(spark: SparkSession, path: str | None, labels: DataFrame) -> DataFrame:
    """(paper_a_id, paper_b_id, predicted_label); without a file the true labels stand for predictions."""
    if path is None or not exists(spark, path):
        return labels.select("paper_a_id", "paper_b_id", F.col("label").alias("predicted_label"))
    return read_jsonl(spark, path, PREDICTIONS).select("paper_a_id", "paper_b_id", "predicted_label")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_json_document(spark: SparkSession, document: dict, path: str) -> None:
    """One small document, indented, with parents made; on any file system that Spark writes to."""
    text = json.dumps(document, indent=2, ensure_ascii=False) + "\n"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_json_document(spark: SparkSession, path: str) -> dict:
    """A document, {} where there is none."""
    if not exists(spark, path):
        return {}
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def write_comparison_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_shards(df: DataFrame, path: str) -> None:
    """Feature rows by split and shard."""
    df.write.mode("overwrite").partitionBy("split", "shard_id").parquet(path)


def read_shards(spark: SparkSession, path: str, split: str, shards: int) -> DataFrame:
    """All shards of a split in their order; a missing one stops the read."""
    parts = [f"{path}/split={split}/shard_id={k}" for k in range(shards)]
    missing = [p for p in parts if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    return spark.read.option("basePath", path).parquet(*parts)
