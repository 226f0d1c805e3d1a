"""The hierarchical cluster index: schedule, centroids, representatives, bounded assignment, beam routing, building."""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.vectors import dot, doubles, normalized, squared_distance
from docweave.operators.kmeans import bounded, closest, cost, lloyd, nearest

#: Rows whose leaves one k-means finds, rows that k-means of few centers is fitted on, starts of a task.
CELL, FIT, TOGETHER = 16_384, 100_000, 4


def level_schedule(n: int, leaf: int = 16, base: float = 2.0) -> list[int]:
    """Clusters of each level from the leaves, ceil(n / leaf), up to the one root; k clusters lie below the rounded-up
    logarithm of k, one fewer at least."""

    def upwards(k: int) -> list[int]:
        return [k] if k == 1 else [k, *upwards(max(1, min(k - 1, math.ceil(math.log(k, base)))))]

    return upwards(math.ceil(n / leaf)) if n > 0 else []


def schedules(spark, most: int, leaf: int = 16, base: float = 2.0) -> DataFrame:
    """(n, schedule) for 0 to most papers."""
    return spark.createDataFrame([(n, ",".join(map(str, level_schedule(n, leaf, base)))) for n in range(most + 1)], "n long, schedule string")


def schedule_changes(table: DataFrame) -> DataFrame:
    """The sizes at which an insert changes the schedule and the index is rebuilt."""
    w = Window.orderBy("n")
    return table.withColumn("before", F.lag("schedule").over(w)).where("n > 0 and schedule <> before").select("n", "before", "schedule")


def normalized_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("vector", normalized(doubles(F.col("vector"))))


def centroids(members: DataFrame, by: str = "node_id") -> DataFrame:
    """(by, centroid): the normalised mean of the members' vectors, summed by place with partial aggregation."""
    sums = members.select(by, F.posexplode("vector").alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("x"))
    rows = sums.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))
    return rows.select(by, normalized(F.col("centroid")).alias("centroid"))


def representatives(members: DataFrame, nodes: DataFrame, by: str = "node_id", item: str = "item_id", digits: int = 6) -> DataFrame:
    """(by, item, score): the member nearest to its node's centroid; of equal ones (to so many digits) the smallest."""
    scored = members.join(nodes, by).select(by, item, F.round(dot(F.col("vector"), F.col("centroid")), digits).alias("score"))
    return scored.groupBy(by).agg(F.max(F.struct(F.col("score"), (-F.col(item)).alias("i"))).alias("best")).select(by, (-F.col("best.i")).alias(item), F.col("best.score").alias("score"))


def distances(items: DataFrame, centers: DataFrame, digits: int = 6) -> DataFrame:
    """(item_id, center_id, distance) of every item to every center of a level, which are items / leaf at most."""
    near = few(centers.select("center_id", F.col("vector").alias("c")))
    return items.select("item_id", "vector").join(near).select("item_id", "center_id", F.round(squared_distance(F.col("vector"), F.col("c")), digits).alias("distance"))


def preferences(near: DataFrame) -> DataFrame:
    """Each item's centers by distance: rank 1 is the nearest."""
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("distance", "center_id")))


def margins(ranked: DataFrame) -> DataFrame:
    """(item_id, margin): how much farther the second center is than the first; infinite with one center."""
    return ranked.groupBy("item_id").agg(
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("distance"))) - F.max(F.when(F.col("rank") == 1, F.col("distance"))), F.lit(float("inf"))).alias("margin")
    )


def capacities(n: int, k: int) -> list[int]:
    return [n // k + (i < n % k) for i in range(k)]


def few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df to be broadcast if a count finds so many rows at most; else Spark joins it as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def capacity_assign(items: DataFrame, centers: DataFrame, rooms: list[int] | None = None) -> DataFrame:
    """(item_id, center_id): items in the order of their margins take the nearest center with room (rooms: of each center
    in the order of center_id, else even ones).

    That serial order equals deferred acceptance in which all centers rank items alike: in each round every item
    without a place proposes to its next center, and each center keeps its best proposals up to its capacity.  A
    round is one aggregation over the open proposals; the last is when none is refused, which comes as there is room
    for all and nobody asks a center twice.
    """
    ranked = preferences(distances(items, centers)).persist()
    order = margins(ranked)
    n, k = items.count(), centers.count()
    if not n:
        return ranked.select("item_id", "center_id").limit(0)
    room = items.sparkSession.createDataFrame([(i, c) for i, c in enumerate(rooms or capacities(n, k))], "place long, room int")
    numbered = centers.select("center_id").withColumn("place", F.row_number().over(Window.orderBy("center_id")) - 1).join(room, "place").select("center_id", "room")
    wishes = ranked.join(order, "item_id").join(few(numbered), "center_id").persist()
    turn = items.select("item_id", F.lit(1).alias("turn"))
    while True:
        asked = wishes.join(turn, ["item_id"]).where("rank = turn")
        place = F.row_number().over(Window.partitionBy("center_id").orderBy(F.col("margin").desc(), "item_id"))
        judged = settle(asked.select("item_id", "center_id", "turn", (place > F.col("room")).alias("refused")))
        if not judged.where("refused").limit(1).count():
            break
        turn = judged.select("item_id", (F.col("turn") + F.col("refused").cast("int")).alias("turn"))
    ranked.unpersist()
    wishes.unpersist()
    return judged.select("item_id", "center_id")


def shared_folder(spark) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir")
    if not top:
        import re
        import tempfile

        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="docweave-")
    return top


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a round in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def beam_route(queries: DataFrame, nodes: DataFrame, beam: int, levels: int, digits: int = 6) -> DataFrame:
    """(query_id, rank, leaf_id, score, visited): the leaves that a beam search from the root reaches.

    nodes: node_id, parent_id (null: root), rep (vector).  Each level is one join of the beam with its children by
    parent and a ranking per query by the mean score of the path, then its sum, then the node; visited is the number of
    nodes whose representatives the query was compared with.
    """
    root = nodes.where("parent_id is null").select(F.col("node_id").alias("at"))
    children = nodes.where("parent_id is not null").select("node_id", F.col("parent_id").alias("at"), "rep")
    beams = queries.select(F.col("item_id").alias("query_id"), "vector").join(F.broadcast(root)).withColumn("total", F.lit(0.0)).withColumn("visited", F.lit(0).cast("long"))
    children = few(children)
    for depth in range(1, levels + 1):
        step = beams.join(children, "at").select("query_id", "vector", "visited", F.col("node_id").alias("at"), (F.col("total") + dot(F.col("vector"), F.col("rep"))).alias("total"))
        score = F.round(F.col("total") / depth, digits)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(score.desc(), "at"))
        seen = F.col("visited") + F.count(F.lit(1)).over(Window.partitionBy("query_id"))
        beams = step.withColumn("score", score).withColumn("rank", rank).withColumn("visited", seen).where(F.col("rank") <= max(1, beam))
    return beams.select("query_id", "rank", F.col("at").alias("leaf_id"), "score", "visited")


def route_candidates(routes: DataFrame, members: DataFrame) -> DataFrame:
    """(query_id, item_id, rank) of the leaves' members, each once, with the rank of the first leaf that has it."""
    rows = routes.join(members.select(F.col("node_id").alias("leaf_id"), "item_id"), "leaf_id")
    return rows.groupBy("query_id", "item_id").agg(F.min("rank").alias("rank"))


def kmeans_labels(vectors: DataFrame, k: int, seed: int = 13, starts: int = 20) -> DataFrame:
    """(item_id, label) of the best of several k-means runs; one cluster for k <= 1."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    if k <= 1 or n <= 1:
        return vectors.select("item_id", F.lit(0).alias("label"))
    rows = vectors.select("item_id", array_to_vector(doubles(F.col("vector"))).alias("features"))
    rows = rows.coalesce(1 + n // 20_000).persist()  # many short iterations: no more tasks than the rows are worth
    fit = inheritable_thread_target(vectors.sparkSession)(lambda i: KMeans(k=min(k, n), seed=seed + i, maxIter=300).fit(rows))
    with ThreadPoolExecutor(8) as pool:  # short jobs side by side
        models = list(pool.map(fit, range(starts)))
    best = min(models, key=lambda m: m.summary.trainingCost)
    rows.unpersist()
    return best.transform(rows).select("item_id", F.col("prediction").alias("label"))


def _packed(items: DataFrame, *by: str) -> DataFrame:
    """(by, blob): the items of a group in the order of their ids, with their vectors as a matrix."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("item_id").combine_chunks()
        vectors = table["vector"].combine_chunks()
        blob = pickle.dumps((table["item_id"].combine_chunks(), np.asarray(vectors.flatten()).reshape(len(vectors), -1)), protocol=5)
        return pa.table([*[table[c].slice(0, 1) for c in by], pa.array([blob], pa.binary())], names=[*by, "blob"])

    kinds = dict(items.dtypes)
    return settle(items.select(*by, "item_id", doubles(F.col("vector")).alias("vector")).groupBy(*by).applyInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in by], "blob binary"])))


def fitted(cells: DataFrame, k, seed: int, starts: int, groups: int) -> DataFrame:
    """(cell, centers): of each cell's k(cell) means, those of the best start; a task makes some starts of a cell."""

    def run(batches):
        for batch in batches:
            for cell, first, blob in zip(*[batch[c].to_pylist() for c in ("cell", "first", "blob")], strict=True):
                points = pickle.loads(blob)[1].astype(np.float32)
                for start in range(first, min(starts, first + TOGETHER)):
                    rows = np.random.default_rng([seed, cell, start]).choice(len(points), min(k(cell), len(points)), replace=False)
                    centers = lloyd(points, points[rows])
                    yield pa.record_batch([pa.array([cell], pa.int32()), pa.array([start], pa.int32()), pa.array([cost(points, centers)]), pa.array([pickle.dumps(centers.astype(float))], pa.binary())], names=["cell", "start", "cost", "centers"])

    tasks = cells.select("cell", F.explode(F.sequence(F.lit(0), F.lit(starts - 1), F.lit(TOGETHER))).alias("first"), "blob")
    tasks = tasks.repartition(min(10_000, 4 * groups * -(-starts // TOGETHER)), "cell", "first")
    return tasks.mapInArrow(run, "cell int, start int, cost double, centers binary").groupBy("cell").agg(F.min_by("centers", F.struct("cost", "start")).alias("centers"))


def _means_of(items: DataFrame, n: int, k: int, seed: int, starts: int) -> np.ndarray:
    """Centers of few clusters, fitted on FIT items at most: those with the smallest hashes of their ids."""
    known = items if n <= FIT else items.orderBy(F.xxhash64("item_id"), "item_id").limit(FIT)
    found = fitted(_packed(known.withColumn("cell", F.lit(0)), "cell"), lambda _: k, seed, starts, 1)
    return pickle.loads(found.first()["centers"])


def means_labels(items: DataFrame, k: int, seed: int = 13, starts: int = 20) -> DataFrame:
    """(item_id, label): the nearest of k means."""
    n = items.count()
    if k <= 1 or n <= 1:
        return items.select("item_id", F.lit(0).alias("label"))
    centers = _means_of(items, n, k, seed, starts)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                points = np.asarray(batch["vector"].flatten()).reshape(batch.num_rows, -1)
                yield pa.record_batch([batch["item_id"], pa.array(closest(points, centers).astype(np.int32))], names=["item_id", "label"])

    return settle(items.select("item_id", doubles(F.col("vector")).alias("vector")).mapInArrow(run, f"item_id {dict(items.dtypes)['item_id']}, label int"))


def bounded_leaves(vectors: DataFrame, k: int, seed: int = 13, starts: int = 20, cell: int = CELL) -> DataFrame:
    """(item_id, center_id): k leaves of even sizes by k-means and greedy assignment, as capacity_assign does it.

    More rows than a cell holds are first divided into cells, by the same assignment to a mean for each cell with the
    room of its leaves; each cell then has its own leaves.  So the work grows with the rows, not with their square.
    """
    n = vectors.count()
    m, sizes = -(-n // cell), capacities(n, k)
    firsts = [j * k // m for j in range(m + 1)]
    if m == 1:
        cells = vectors.withColumn("cell", F.lit(0))
    else:
        centers = _means_of(vectors, n, m, seed, starts)
        near = vectors.sparkSession.createDataFrame([(j, c.tolist()) for j, c in enumerate(centers)], "center_id int, vector array<double>")
        own = capacity_assign(vectors, near, [sum(sizes[a:b]) for a, b in zip(firsts, firsts[1:], strict=False)])
        cells = vectors.join(own.withColumnRenamed("center_id", "cell"), "item_id")

    def place(batches):
        for batch in batches:
            for at, blob, centers in zip(*[batch[c].to_pylist() for c in ("cell", "blob", "centers")], strict=True):
                (ids, points), first = pickle.loads(blob), firsts[at]
                label = bounded(np.round(nearest(points, pickle.loads(centers)), 6), sizes[first : firsts[at + 1]])
                yield pa.record_batch([ids, pa.array((first + label).astype(np.int32))], names=["item_id", "center_id"])

    cells = _packed(cells, "cell")
    best = fitted(cells, lambda at: firsts[at + 1] - firsts[at], seed, starts, m)
    kind = dict(vectors.dtypes)["item_id"]
    return settle(cells.join(best, "cell").select("cell", "blob", "centers").repartition(4 * m, "cell").mapInArrow(place, f"item_id {kind}, center_id int"))


def inner_centroids(below: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Centroids of nodes, the mean of all items below each, and those items.

    below: node_id and child; members: node_id (the child) and the items with their vectors.
    """
    held = members.withColumnRenamed("node_id", "child").join(below.select("node_id", "child"), "child").drop("child")
    return centroids(held), held


def build_index(vectors: DataFrame, leaf: int = 16, base: float = 2.0, seed: int = 13, starts: int = 20) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): leaves by bounded k-means, upper levels by k-means of the centroids below.

    nodes: node_id, level, parent_id, centroid (of all items below), rep_id, rep (that of the child nearest to the
    centroid).  Empty clusters shrink a level.  One job series per level; rows beyond CELL have their leaves in cells, and
    upper levels beyond FIT nodes are fitted on so many.  Every row is in a leaf.
    """
    vectors = settle(normalized_vectors(vectors.select("item_id", "vector")))
    plan = level_schedule(vectors.count(), leaf, base)
    below, members, nodes = None, None, []
    for level, k in enumerate(plan):
        if level == 0:
            items = vectors
            own = bounded_leaves(vectors, k, seed, starts) if k > 1 else vectors.select("item_id", F.lit(0).alias("center_id"))
        else:
            items = below.select(F.col("node_id").alias("item_id"), F.col("centroid").alias("vector"))
            own = means_labels(items, k, seed + level, starts).withColumnRenamed("label", "center_id")
        number = F.dense_rank().over(Window.orderBy("center_id")) - 1
        names = own.select("center_id").distinct().withColumn("node_id", F.concat(F.lit(f"L{level}_"), number.cast("string")))
        placed = settle(own.join(names, "center_id").join(items, "item_id").select("node_id", "item_id", "vector"))
        if level == 0:
            members, held, center = placed.select("node_id", "item_id"), placed, centroids(placed)
            best = representatives(placed, center).select("node_id", F.col("item_id").alias("rep_id"))
            now = center.join(best, "node_id").join(vectors.select(F.col("item_id").alias("rep_id"), F.col("vector").alias("rep")), "rep_id")
        else:
            up = placed.select("node_id", F.col("item_id").alias("child"), "vector")
            center, held = inner_centroids(up, held)
            held = settle(held)
            up = up.join(center, "node_id")
            score = F.round(dot(F.col("vector"), F.col("centroid")), 6)
            best = up.groupBy("node_id").agg(F.min_by("child", F.struct(-score, F.col("child"))).alias("child"))
            now = center.join(best, "node_id").join(below.select(F.col("node_id").alias("child"), "rep_id", "rep"), "child").drop("child")
            parents = placed.select(F.col("item_id").alias("node_id"), F.col("node_id").alias("up"))
            nodes[-1] = nodes[-1].drop("parent_id").join(parents, "node_id").withColumnRenamed("up", "parent_id")
        below = settle(now.select("node_id", F.lit(level).alias("level"), F.lit(None).cast("string").alias("parent_id"), "centroid", "rep_id", "rep"))
        nodes.append(below)
    table = None
    for n in nodes:
        n = n.select("node_id", "level", "parent_id", "centroid", "rep_id", "rep")
        table = n if table is None else table.unionByName(n)
    return table, members


def index_stats(nodes: DataFrame, members: DataFrame, leaf: int = 16, base: float = 2.0) -> DataFrame:
    """One row: items, schedule, nodes of each level from the leaves up, and the leaves' sizes."""
    n = members.count()
    levels = nodes.groupBy("level").agg(F.count(F.lit(1)).alias("n")).agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "n"))), lambda x: x["n"]).alias("level_counts"))
    known = [F.lit(n).cast("long").alias("items"), F.array(*map(F.lit, level_schedule(n, leaf, base))).cast("array<int>").alias("schedule")]
    return leaf_stats(members).join(levels).select(*known, "level_counts", "leaves", "min_size", "max_size", "mean_size", "median_size")


def leaf_stats(members: DataFrame, by: str = "node_id") -> DataFrame:
    sizes = members.groupBy(by).agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(F.count(F.lit(1)).alias("leaves"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.avg("size").alias("mean_size"), F.median("size").alias("median_size"))
