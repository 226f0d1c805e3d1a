"""Command lines of the whole flows.

    spark-submit -m docweave.plans.commands COMMAND [FLAGS]      (or: python -m docweave.plans.commands COMMAND --help)

Flags that only a neural-network library has a use for (batch size, learning rate, weight decay, dropout, workers, device)
are taken and written to the results, but Spark's perceptron and trees have no use for them.
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import LABELS, label_ordinal, ordinal_label
from docweave.operators import backends, chunks, index, metrics, pairs, taxonomy
from docweave.operators.texts import labelled_text
from docweave.plans import classify, reconstruct
from docweave.sources import records, runs

NEURAL = {"batch-size": 1024, "lr": 1e-3, "weight-decay": 1e-4, "dropout": 0.1, "num-workers": 8, "device": "cpu"}
DATASET = {"papers": "dataset/train_papers.jsonl", "labels": "dataset/train_labels.jsonl"}
INDEX = {"leaf-size": 16, "base": 2.0, "seed": 13, "max-features": 20_000, "ngram-max": 2, "n-init": 20}

COMMANDS: dict[str, tuple[Callable, dict]] = {}


def command(name: str, **flags):
    def known(run: Callable) -> Callable:
        COMMANDS[name] = (run, {k.replace("_", "-"): v for k, v in flags.items()})
        return run

    return known


def _split(spark: SparkSession, folder: str, split: str) -> tuple[DataFrame, DataFrame]:
    return records.read_papers(spark, f"{folder}/{split}_papers.jsonl"), records.read_pair_labels(spark, f"{folder}/{split}_labels.jsonl")


def _options(a: argparse.Namespace) -> dict[str, dict]:
    trees = {"trees": a.tree_estimators, "seed": a.seed}
    return {"mlp": {"hidden": a.hidden_size, "epochs": a.epochs, "seed": a.seed}, "random_forest": trees, "extra_trees": trees}


@command("weak-methods", dataset_dir="dataset", output_dir="outputs/weak_methods", max_reference_titles=80, epochs=120, hidden_size=64, tabular_backends="random_forest,extra_trees", tree_estimators=300, seed=13, **NEURAL)
def weak_methods(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Static features, the perceptron and tree backends, predictions, metrics and a leaderboard."""
    return classify.run(spark, _split(spark, a.dataset_dir, "train"), _split(spark, a.dataset_dir, "valid"), a.output_dir, f"mlp,{a.tabular_backends}", a.max_reference_titles, options=_options(a))


@command("run-all", epochs=int(os.environ.get("EPOCHS", "80")), device=os.environ.get("DEVICE", "cpu"), output_dir=os.environ.get("OUTPUT_DIR", "outputs/weak_methods"))
def run_all(spark: SparkSession, a: argparse.Namespace) -> dict:
    """weak-methods with defaults of the environment; further flags go through."""
    return main(["weak-methods", "--epochs", str(a.epochs), "--device", a.device, "--output-dir", a.output_dir, *a.rest], spark)


@command("train-pair-model", train_papers="dataset/train_papers.jsonl", train_labels="dataset/train_labels.jsonl", valid_papers="dataset/valid_papers.jsonl", valid_labels="dataset/valid_labels.jsonl",
         output_dir="outputs/pair_model", max_reference_titles=80, tree_estimators=300, num_workers=8, seed=13)
def train_pair_model(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Extra trees on static features, saved with idf and scaling, and their metrics on the validation pairs."""
    train = records.read_papers(spark, a.train_papers), records.read_pair_labels(spark, a.train_labels)
    valid = records.read_papers(spark, a.valid_papers), records.read_pair_labels(spark, a.valid_labels)
    about = reconstruct.train_pair_model(spark, train, f"{a.output_dir}/model", a.max_reference_titles, a.tree_estimators, a.seed)
    found = reconstruct.predict_pairs(spark, f"{a.output_dir}/model", valid[0], valid[1].select(*reconstruct.PAIR))
    rows = valid[1].select(*reconstruct.PAIR, F.col("label").alias("true_label")).join(found, list(reconstruct.PAIR))
    out = {"model": about, "valid_metrics": metrics.summary(metrics.confusion(rows)).first().asDict()}
    records.write_json_document(spark, out, f"{a.output_dir}/model_summary.json")
    return out


def _index_options(a: argparse.Namespace) -> dict:
    return {"leaf_size": a.leaf_size, "base": a.base, "seed": a.seed, "max_features": a.max_features, "ngram_max": a.ngram_max, "starts": a.n_init}


@command("dynamic-index", **DATASET, predictions="", output_dir="outputs/dynamic_index", beam_sizes="1,2,3", limit=0, **INDEX)
def dynamic_index(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Replay of all arrivals for each width of the beam; without predictions the true labels stand for them."""
    papers, labels = reconstruct.first_papers(records.read_papers(spark, a.papers), a.limit), records.read_pair_labels(spark, a.labels)
    predictions = records.read_predictions(spark, a.predictions or None, labels)
    beams = tuple(int(b) for b in a.beam_sizes.split(",") if b.strip())
    out = {"config": {**vars(a), "paper_count": papers.count(), "schedule": index.level_schedule(papers.count(), a.leaf_size, a.base)}, "runs": reconstruct.evaluate(papers, labels, predictions, beams, **_index_options(a))}
    records.write_json_document(spark, out, f"{a.output_dir}/dynamic_insertion_eval.json")
    return out


@command("end-to-end", **DATASET, model_path="outputs/pair_model/model", output_dir="outputs/end_to_end", beam_size=2, limit_papers=0, log_every_seconds=5.0, reuse_linear_from="", **INDEX)
def end_to_end(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The graph by linear scan and through the index with a saved model, with timings."""
    papers, labels = reconstruct.first_papers(records.read_papers(spark, a.papers), a.limit_papers), records.read_pair_labels(spark, a.labels)
    linear = records.read_json_document(spark, a.reuse_linear_from).get("linear_scan") if a.reuse_linear_from else None
    with runs.progress(spark, every=a.log_every_seconds, name="end-to-end"):
        out = reconstruct.end_to_end(spark, papers, labels, a.model_path, a.beam_size, linear=linear, **_index_options(a))
    records.write_json_document(spark, {"config": vars(a), **out}, f"{a.output_dir}/end_to_end_reconstruction.json")
    return out


def _encoder(name: str, width: int) -> tuple[Callable, int]:
    """A factory of encoders by module:function, or the hashing stand-in."""
    if not name:
        return (lambda: chunks.hashing_encoder(width)), width
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function), width


@command("extract-features", split="train", dataset_dir="dataset", output_dir="outputs/features", encoder="", width=16, max_length=512, chunks_per_side=5, dtype="fp16", num_shards=1, shard_id=0, limit_pairs=0,
         reference_count=1, reference_titles=1, max_reference_titles=0)
def extract_features(spark: SparkSession, a: argparse.Namespace) -> dict:
    """One shard of the dense pair tensors: chunks of both papers' texts, encoded, in fixed slots with zeros and a mask."""
    papers, labels = _split(spark, a.dataset_dir, a.split)
    labels = labels.limit(a.limit_pairs) if a.limit_pairs else labels
    mine = labels.where(F.pmod(F.crc32(F.col("pair_id").cast("binary")), F.lit(a.num_shards)) == a.shard_id)
    needed = taxonomy.needed_papers(papers, mine)
    text = labelled_text(bool(a.reference_count), bool(a.reference_titles), a.max_reference_titles)
    tokens = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    make, width = _encoder(a.encoder, a.width)
    table = index.settle(chunks.encode(chunks.chunk_table(needed, tokens, a.max_length - 2, a.chunks_per_side), make))
    slots = chunks.pair_slots(mine.select(*reconstruct.PAIR), table.withColumn("chunk", F.col("embedding")), a.chunks_per_side).withColumnRenamed("chunk", "embedding")
    out = chunks.pair_tensors(slots, mine, width, a.chunks_per_side).join(mine.select("pair_id", *reconstruct.PAIR, "label", label_ordinal(F.col("label")).alias("y")), list(reconstruct.PAIR))
    path = f"{a.output_dir}/split={a.split}/shard_id={a.shard_id}"
    out.write.mode("overwrite").parquet(path)
    rows = runs.written_rows(spark, path)
    size, gib = chunks.tensor_bytes(rows, 2 * a.chunks_per_side, width, 2 if a.dtype == "fp16" else 4)
    about = {"config": vars(a), "pairs": rows, "shape": [rows, 2 * a.chunks_per_side, width], "bytes": size, "gib": gib, "chunks": chunks.diagnostics(needed, tokens, a.max_length - 2, a.chunks_per_side).first().asDict()}
    records.write_json_document(spark, about, f"{a.output_dir}/{a.split}_shard{a.shard_id:02d}of{a.num_shards:02d}_summary.json")
    return about


@command("combine-shards", feature_dir="outputs/features", num_shards=4)
def combine_shards(spark: SparkSession, a: argparse.Namespace) -> dict:
    """All shards of both splits as one table each."""
    out = {}
    for split in ("train", "valid"):
        records.read_shards(spark, a.feature_dir, split, a.num_shards).write.mode("overwrite").parquet(f"{a.feature_dir}/combined/{split}")
        out[split] = {"pairs": runs.written_rows(spark, f"{a.feature_dir}/combined/{split}"), "shards": a.num_shards}
    records.write_json_document(spark, out, f"{a.feature_dir}/combined_summary.json")
    return out


def _dense(spark: SparkSession, folder: str, split: str) -> tuple[DataFrame, list[str]]:
    """Combined tensors with a column for each place."""
    table = spark.read.parquet(f"{folder}/combined/{split}")
    width = table.select(F.max(F.size("x")).alias("n")).first()["n"] or 0
    names = [f"x{i}" for i in range(width)]
    return table.select("pair_id", *reconstruct.PAIR, F.col("label").alias("true_label"), "y", *[F.col("x")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


@command("feature-backends", feature_dir="outputs/features", static_metrics="", output_dir="outputs/feature_backends", backends="mlp,random_forest,extra_trees", epochs=80, hidden_size=128, tree_estimators=300, write_train_predictions=0, seed=13, **NEURAL)
def feature_backends(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Backends on dense pair tensors, and their comparison with the static ones."""
    (train, names), (valid, _) = _dense(spark, a.feature_dir, "train"), _dense(spark, a.feature_dir, "valid")
    keep = (*classify.KEYS, "y")
    own = {s: pairs.standardized(t, train, tuple(names), keep).persist() for s, t in (("train", train), ("valid", valid))}
    out = {"features": len(names), **backends.spread(pairs.feature_stats(train, tuple(names))).first().asDict(), "methods": {}}
    for name in sorted(x.strip() for x in a.backends.split(",") if x.strip()):
        for split in ("train", "valid") if a.write_train_predictions else ("valid",):
            done, _ = backends.run_backends(name, own["train"], own[split], names, **_options(a).get(name, {}))
            for method, rows in done.items():
                rows = rows.select(*classify.KEYS, ordinal_label(F.col("prediction").cast("int")).alias("predicted_label"), F.lit(method).alias("method"), *[F.coalesce(F.get("p", i), F.lit(0.0)).alias(f"prob_{x}") for i, x in enumerate(LABELS)])
                records.write_jsonl(rows, f"{a.output_dir}/{method}/{split}_predictions")
                if split == "valid":
                    out["methods"][method] = metrics.summary(metrics.confusion(records.read_jsonl(spark, f"{a.output_dir}/{method}/valid_predictions", records.PREDICTIONS))).first().asDict()
    static = records.read_json_document(spark, a.static_metrics).get("methods", {}) if a.static_metrics else {}
    rows = [(m, s["accuracy"], s["macro_f1"]) for m, s in out["methods"].items()]
    others = [(m, s["accuracy"], s["macro_f1"]) for m, s in static.items()]
    kind = "method string, accuracy double, macro_f1 double"
    table = metrics.backend_comparison(spark.createDataFrame(rows, kind), spark.createDataFrame(others, kind)).orderBy("method")
    records.write_comparison_csv(table.select("method", "accuracy", "macro_f1", "other_accuracy", "other_macro_f1", "macro_f1_delta"), f"{a.output_dir}/bert_vs_static")
    records.write_json_document(spark, out, f"{a.output_dir}/all_metrics.json")
    return out


@command("mlp-backends", dataset_dir="dataset", feature_dir="outputs/features", output_dir="outputs/mlp_backends", epochs=80, hidden_size=128, max_reference_titles=80, seed=13, **NEURAL)
def mlp_backends(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Class-weighted perceptrons on static and on dense features, saved with their sizes and losses."""
    from docweave.operators import tfidf

    train, valid = _split(spark, a.dataset_dir, "train"), _split(spark, a.dataset_dir, "valid")
    tokens = tfidf.with_tokens(train[0].withColumn("split", F.lit("train")), a.max_reference_titles)
    static = {s: classify.examples(*t, tokens, a.max_reference_titles) for s, t in (("train", train), ("valid", valid))}
    tables = {"static": (static["train"], static["valid"], list(pairs.FEATURES))}
    if records.exists(spark, f"{a.feature_dir}/combined/train"):
        (dense, names), (other, _) = _dense(spark, a.feature_dir, "train"), _dense(spark, a.feature_dir, "valid")
        tables["dense"] = (dense, other, names)
    out = {}
    for name, (fitted, checked, names) in tables.items():
        own = [pairs.standardized(t, fitted, tuple(names), (*classify.KEYS, "y")) for t in (fitted, checked)]
        model = backends.fit_perceptron(own[0], names, hidden=a.hidden_size, epochs=a.epochs, seed=a.seed, balanced=True)
        model.write().overwrite().save(f"{a.output_dir}/{name}/model")
        rows = backends.scored(model, own[1], names).select("true_label", ordinal_label(F.col("prediction").cast("int")).alias("predicted_label"))
        out[name] = {"parameters": backends.parameters(len(names), a.hidden_size), "losses": backends.loss_history(model), "valid_metrics": metrics.summary(metrics.confusion(rows)).first().asDict()}
    records.write_json_document(spark, {"config": vars(a), "models": out}, f"{a.output_dir}/summary.json")
    return out


def main(arguments: list[str], spark: SparkSession | None = None) -> dict:
    name, *rest = arguments or ["--help"]
    if name not in COMMANDS:
        raise SystemExit("commands: " + ", ".join(COMMANDS))
    run, flags = COMMANDS[name]
    parser = argparse.ArgumentParser(prog=name, description=run.__doc__)
    for flag, default in flags.items():
        parser.add_argument(f"--{flag}", type=type(default), default=default)
    known, further = parser.parse_known_args(rest)
    if name == "run-all":
        known.rest = further
    elif further:
        parser.error(f"unknown flags: {' '.join(further)}")
    return run(spark or SparkSession.builder.appName(name).getOrCreate(), known)


if __name__ == "__main__":
    main(sys.argv[1:])
