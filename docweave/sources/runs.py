"""Results of runs: partial results, reuse, progress events, timings, saved models with their statistics."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from docweave.sources.records import exists, read_json_document, write_json_document


def append_result(spark: SparkSession, path: str, method: str, metrics: dict) -> None:
    """One method's metrics, kept as soon as the method ends; a method that runs again replaces its own."""
    spark.createDataFrame([(method, json.dumps(metrics))], "method string, metrics string").coalesce(1).write.mode("overwrite").parquet(f"{path}/method={method}")


def results(spark: SparkSession, path: str) -> dict[str, dict]:
    """All methods' metrics so far."""
    if not exists(spark, path):
        return {}
    return {r["method"]: json.loads(r["metrics"]) for r in spark.read.option("basePath", path).parquet(path).collect()}


def reused(spark: SparkSession, path: str | None, key: str, make) -> dict:
    """The part `key` of an earlier result document, or what make() returns where there is none."""
    earlier = read_json_document(spark, path) if path else {}
    return earlier[key] if key in earlier else make()


@contextmanager
def progress(spark: SparkSession, say: Callable[[dict], None] = lambda event: print(json.dumps(event), flush=True), every: float = 5.0, **about) -> Iterator[None]:
    """Events of what runs inside: tasks done and known so far every so many seconds, and one at the end.

    It reads Spark's status tracker from another thread and leaves the session as it is.  (An Observation would put a
    manager into the session that models cannot be sent to executors with.)
    """
    tracker, group, done, start = spark.sparkContext.statusTracker(), f"docweave-{uuid.uuid4().hex}", threading.Event(), time.monotonic()

    def event(name: str) -> dict:
        tasks = {"tasks": 0, "done": 0}
        for job in tracker.getJobIdsForGroup(group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else []:
                now = tracker.getStageInfo(stage)
                if now:
                    tasks["tasks"] += now.numTasks
                    tasks["done"] += now.numCompletedTasks
        return {"event": name, **about, **tasks, "elapsed_seconds": time.monotonic() - start}

    def watch() -> None:
        while not done.wait(every):
            say(event("progress"))

    thread = threading.Thread(target=watch, daemon=True)
    before = spark.sparkContext.getLocalProperty("spark.jobGroup.id")
    spark.sparkContext.setJobGroup(group, str(about.get("name", "")))
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", before)
        say(event("done"))


def written_rows(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table that has been written, from its files' footers."""
    return spark.read.parquet(path).count()


class PairTimer:
    """Seconds of features and of models over pairs, and what follows from them."""

    def __init__(self):
        self.pairs, self.feature_seconds, self.model_seconds, self.start = 0, 0.0, 0.0, time.perf_counter()

    def timing(self, wall: float | None = None) -> dict:
        wall = time.perf_counter() - self.start if wall is None else wall
        both, n = self.feature_seconds + self.model_seconds, self.pairs
        each = {"feature": self.feature_seconds, "model": self.model_seconds, "feature_plus_model": both, "wall": wall}
        out = {"pair_predictions": n, "feature_seconds": self.feature_seconds, "model_seconds": self.model_seconds, "feature_plus_model_seconds": both, "wall_seconds": wall}
        out |= {f"avg_ms_per_pair_{k}": 1000 * v / n if n else 0.0 for k, v in each.items()}
        return out | {"pairs_per_second_wall": n / wall if wall else 0.0}


def save_model(spark: SparkSession, path: str, model: PipelineModel, idf: DataFrame, stats: DataFrame, about: dict) -> None:
    """A fitted pipeline, its idf and scaling tables and its options."""
    model.write().overwrite().save(f"{path}/model")
    idf.write.mode("overwrite").parquet(f"{path}/idf")
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    write_json_document(spark, about, f"{path}/about.json")


def save_forest(spark: SparkSession, path: str, trees: list[str], idf: DataFrame, stats: DataFrame, about: dict) -> None:
    """Grown trees with the idf and scaling tables and the options that they were grown with."""
    spark.createDataFrame(list(enumerate(trees)), "number int, tree string").coalesce(1).write.mode("overwrite").parquet(f"{path}/forest")
    idf.write.mode("overwrite").parquet(f"{path}/idf")
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    write_json_document(spark, about, f"{path}/about.json")


def load_forest(spark: SparkSession, path: str) -> tuple[list[str], DataFrame, DataFrame, dict]:
    about = {"feature_set": "static", "max_reference_titles": 80} | read_json_document(spark, f"{path}/about.json")
    trees = [r["tree"] for r in spark.read.parquet(f"{path}/forest").orderBy("number").collect()]
    return trees, spark.read.parquet(f"{path}/idf"), spark.read.parquet(f"{path}/stats"), about


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame, DataFrame, dict]:
    about = {"feature_set": "static", "max_reference_titles": 80} | read_json_document(spark, f"{path}/about.json")
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/idf"), spark.read.parquet(f"{path}/stats"), about
