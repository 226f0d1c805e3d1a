"""The whole static flow: papers and labels to features, classifiers, predictions, metrics and a leaderboard.

    python -m docweave.plans.classify TRAIN_PAPERS TRAIN_LABELS VALID_PAPERS VALID_LABELS OUTPUT [BACKENDS]
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import LABELS, label_ordinal, ordinal_label
from docweave.operators import metrics, pairs, tfidf
from docweave.operators.backends import run_backends
from docweave.sources import records, runs

KEYS = ("pair_id", "paper_a_id", "paper_b_id", "true_label")


def examples(papers: DataFrame, labels: DataFrame, train_tokens: DataFrame, most_references: int = 80) -> DataFrame:
    """The eleven scaled features of labelled pairs; the idf is that of training papers."""
    return pair_features(papers, labels, tfidf.idf_table(train_tokens), tfidf.default_idf(train_tokens), most_references)


def pair_features(papers: DataFrame, labels: DataFrame, idf: DataFrame, unknown: DataFrame, most_references: int = 80) -> DataFrame:
    """The same by an idf table and the idf of unknown tokens, which a saved model has."""
    tokens = tfidf.with_tokens(papers.withColumn("split", F.lit("")), most_references)
    weighted = tfidf.weights(tfidf.term_frequency(tokens), idf, unknown)
    rows = labels.select("pair_id", "paper_a_id", "paper_b_id", F.col("label").alias("true_label"))
    raw = pairs.raw_features(pairs.with_both(rows, pairs.paper_features(papers, most_references)), KEYS)
    cosines = tfidf.cosines(rows.select("paper_a_id", "paper_b_id").distinct(), weighted)
    out = pairs.scaled_features(raw.join(cosines, ["paper_a_id", "paper_b_id"]), KEYS)
    return out.withColumn("y", label_ordinal(F.col("true_label")))


def run(spark: SparkSession, train: tuple[DataFrame, DataFrame], valid: tuple[DataFrame, DataFrame], output: str, backends: str = "mlp,random_forest,extra_trees", most_references: int = 80, options: dict | None = None, **common) -> dict[str, dict]:
    """Writes each method's predictions and metrics to the output folder; returns the metrics by method.  options: those of
    each backend by its name; common: those of all."""
    tokens = tfidf.with_tokens(train[0].withColumn("split", F.lit("train")), most_references)
    features = list(pairs.FEATURES)
    own = {"train": examples(*train, tokens, most_references), "valid": examples(*valid, tokens, most_references)}
    scaled = {s: pairs.standardized(e, own["train"], tuple(features), (*KEYS, "y")).persist() for s, e in own.items()}
    skipped: list[str] = []
    for name in (x.strip() for x in backends.split(",")):
        done, missing = run_backends(name, scaled["train"], scaled["valid"], features, **((options or {}).get(name, {}) | common))
        skipped += missing
        for method, out in done.items():
            out = out.select(*KEYS, ordinal_label(F.col("prediction").cast("int")).alias("predicted_label"), F.lit(method).alias("method"), *[F.coalesce(F.get("p", i), F.lit(0.0)).alias(f"prob_{x}") for i, x in enumerate(LABELS)])
            records.write_jsonl(out, f"{output}/{method}/valid_predictions")
            matrix = metrics.confusion(records.read_jsonl(spark, f"{output}/{method}/valid_predictions", records.PREDICTIONS))
            runs.append_result(spark, f"{output}/partial", method, metrics.summary(matrix).first().asDict())
    found = runs.results(spark, f"{output}/partial")
    records.write_json_document(spark, {"methods": dict(sorted(found.items(), key=lambda x: (-x[1]["macro_f1"], x[0]))), "skipped": sorted(skipped)}, f"{output}/all_metrics.json")
    return found


def main(arguments: list[str]) -> None:
    spark = SparkSession.builder.appName("classify").getOrCreate()
    p, l, vp, vl, output = arguments[:5]
    run(spark, (records.read_papers(spark, p), records.read_pair_labels(spark, l)), (records.read_papers(spark, vp), records.read_pair_labels(spark, vl)), output, *arguments[5:6])


if __name__ == "__main__":
    main(sys.argv[1:])
