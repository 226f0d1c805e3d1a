"""The relation graph of predicted labels, by linear scan or from an index's candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(rows: DataFrame, label: str = "predicted_label") -> DataFrame:
    """(source, target): A to B, or B to A."""
    forward = F.col(label) == "A_TO_B"
    return rows.where(F.col(label).isin("A_TO_B", "B_TO_A")).select(F.when(forward, F.col("paper_a_id")).otherwise(F.col("paper_b_id")).alias("source"), F.when(forward, F.col("paper_b_id")).otherwise(F.col("paper_a_id")).alias("target"))


def peers(rows: DataFrame, label: str = "predicted_label") -> DataFrame:
    """(left_id, right_id) of peers, the smaller id first."""
    return rows.where(F.col(label) == "PEER").select(F.least("paper_a_id", "paper_b_id").alias("left_id"), F.greatest("paper_a_id", "paper_b_id").alias("right_id"))


def head(items: DataFrame, most: int = 20) -> DataFrame:
    return items.orderBy(*items.columns).limit(most)


def comparison(rows: DataFrame) -> DataFrame:
    """One row: pairs, edges and peers by linear scan and by candidates; a linear scan predicts every pair."""
    return comparison_of(rows.withColumn("n", F.lit(1)))


def comparison_of(counted: DataFrame) -> DataFrame:
    """comparison of rows that stand for n pairs each."""

    def total(which, name: str):
        return F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).cast("long").alias(name)

    linear, indexed, true = F.col("predicted_label"), F.col("system_label"), F.col("true_label")
    n = counted.agg(
        total(F.lit(True), "linear_pairs"), total(F.col("is_candidate"), "indexed_pairs"), total(linear.isin("A_TO_B", "B_TO_A"), "linear_edges"), total(indexed.isin("A_TO_B", "B_TO_A"), "indexed_edges"),
        total(linear == "PEER", "linear_peers"), total(indexed == "PEER", "indexed_peers"), total(linear == true, "linear_right"), total(indexed == true, "indexed_right"),
    )
    share = lambda c: F.when(F.col("linear_pairs") > 0, F.col(f"{c}_right") / F.col("linear_pairs")).alias(f"{c}_accuracy")
    n = n.select("linear_pairs", "indexed_pairs", "linear_edges", "indexed_edges", "linear_peers", "indexed_peers", share("linear"), share("indexed"))
    return n.withColumn("pair_reduction", F.when(F.col("linear_pairs") > 0, 1.0 - F.col("indexed_pairs") / F.col("linear_pairs")).otherwise(0.0))
