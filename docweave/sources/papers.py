"""Papers made of the documents table: the view that all queries of the catalogue start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper for each document: the first line is its title, the second its abstract, the others its references."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = F.split("text", "\n")
    references = F.slice(lines, 3, F.size(lines))
    path = F.when(F.col("doc_id") % 3 == 0, F.lit("all")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("all > "), "lang")).otherwise(F.concat(F.lit("all > "), "lang", F.lit(" > "), "source"))
    return d.select(
        F.col("doc_id").alias("paper_id"),
        F.col("doc_id").alias("split_index"),
        F.when(F.col("doc_id") % 5 == 4, "valid").otherwise("train").alias("split"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.split_part("text", F.lit("\n"), F.lit(2)).alias("abstract"),
        references.alias("reference_titles"),
        F.size(references).cast("long").alias("reference_count"),
        F.col("source").alias("venue"),
        F.when(F.col("doc_id") % 17 != 0, 2000 + F.col("doc_id") % 25).alias("publication_year"),
        path.alias("node_path"),
        "lang",
    )


#: The same view for the oracle.
PAPERS_SQL = """papers AS (
  SELECT doc_id AS paper_id, doc_id AS split_index, CASE WHEN doc_id % 5 = 4 THEN 'valid' ELSE 'train' END AS split,
    split_part(text, chr(10), 1) AS title, split_part(text, chr(10), 2) AS abstract, string_split(text, chr(10))[3:] AS reference_titles,
    len(string_split(text, chr(10))[3:])::BIGINT AS reference_count, source AS venue,
    CASE WHEN doc_id % 17 <> 0 THEN 2000 + doc_id % 25 END AS publication_year,
    CASE WHEN doc_id % 3 = 0 THEN 'all' WHEN doc_id % 3 = 1 THEN 'all > ' || lang ELSE 'all > ' || lang || ' > ' || source END AS node_path, lang
  FROM documents)"""
