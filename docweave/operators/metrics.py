"""Confusion matrices and what follows from them; all labels appear, with or without rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import LABELS


def label_grid(spark: SparkSession, labels: tuple[str, ...] = LABELS) -> DataFrame:
    return spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "ordinal int, label string")


def confusion(rows: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(true_label, predicted_label, n) for every two labels."""
    return confusion_of(rows.select("true_label", "predicted_label", F.lit(1).alias("n")), labels)


def confusion_of(counted: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """confusion of rows that stand for n pairs each."""
    grid = label_grid(counted.sparkSession, labels)
    cells = grid.select(F.col("label").alias("true_label")).join(F.broadcast(grid.select(F.col("label").alias("predicted_label"))))
    counts = counted.groupBy("true_label", "predicted_label").agg(F.sum("n").alias("n"))
    return cells.join(counts, ["true_label", "predicted_label"], "left").select("true_label", "predicted_label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _share(part, whole):
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def per_class(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support); a zero denominator gives 0."""
    rows = matrix.select(F.explode(F.array(F.struct(F.col("true_label").alias("label"), F.lit("t").alias("side"), "n", (F.col("true_label") == F.col("predicted_label")).alias("hit")), F.struct(F.col("predicted_label").alias("label"), F.lit("p").alias("side"), "n", F.lit(False).alias("hit")))).alias("x")).select("x.*")
    sums = rows.groupBy("label").agg(F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("side") == "t", F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("side") == "p", F.col("n")).otherwise(0)).alias("predicted"))
    sums = sums.withColumn("precision", _share(F.col("tp"), F.col("predicted"))).withColumn("recall", _share(F.col("tp"), F.col("support")))
    return sums.select("label", "precision", "recall", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def summary(matrix: DataFrame) -> DataFrame:
    """One row: accuracy and the means over all labels, those without support included as 0."""
    total = matrix.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0)).alias("right"))
    means = per_class(matrix).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    return total.join(means).select(_share(F.col("right"), F.col("total")).alias("accuracy"), "macro_precision", "macro_recall", "macro_f1")


def label_counts(rows: DataFrame, label: str = "true_label", labels: tuple[str, ...] = LABELS) -> DataFrame:
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return label_grid(rows.sparkSession, labels).join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_weights(rows: DataFrame, label: str = "true_label", labels: tuple[str, ...] = LABELS) -> DataFrame:
    """total / (labels * count), 0 for a label without rows."""
    return weights_of(label_counts(rows, label, labels))


def weights_of(counts: DataFrame) -> DataFrame:
    """class_weights of (label, n) for every label."""
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("labels"))
    return counts.join(F.broadcast(total)).select("label", F.when(F.col("n") > 0, F.col("total") / (F.col("labels") * F.col("n"))).otherwise(0.0).alias("weight"))


def leaderboard(scores: DataFrame) -> DataFrame:
    """Methods by macro F1, the best first; equal ones by name."""
    from pyspark.sql import Window

    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.col("macro_f1").desc(), "method")))


def backend_comparison(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each backend of left with its counterpart in right, if any, and the differences."""
    other = right.select("method", F.col("accuracy").alias("other_accuracy"), F.col("macro_f1").alias("other_macro_f1"))
    return left.join(other, "method", "left").select("method", "accuracy", "macro_f1", "other_accuracy", "other_macro_f1", (F.col("accuracy") - F.col("other_accuracy")).alias("accuracy_delta"), (F.col("macro_f1") - F.col("other_macro_f1")).alias("macro_f1_delta"))


def best_method(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.col("macro_f1").desc(), "method").limit(1)
