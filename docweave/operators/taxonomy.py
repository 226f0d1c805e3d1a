"""Labels by taxonomy paths, dataset statistics, needed papers and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = " > "


def relation(a: Column, b: Column) -> Column:
    """Label of two node paths: a proper ancestor at any distance, the reverse, the same node, or none."""
    return (
        F.when(F.startswith(b, F.concat(a, F.lit(SEPARATOR))), "A_TO_B")
        .when(F.startswith(a, F.concat(b, F.lit(SEPARATOR))), "B_TO_A")
        .when(a == b, "PEER")
        .otherwise("NONE")
    )


def node_level(path: Column) -> Column:
    return (F.size(F.split(path, SEPARATOR)) - 1).cast("int")


def node_name(path: Column) -> Column:
    return F.element_at(F.split(path, SEPARATOR), -1)


def ancestors(path: Column) -> Column:
    """Paths of all proper ancestors of a node."""
    parts = F.split(path, SEPARATOR)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), SEPARATOR))).otherwise(F.array().cast("array<string>"))


def pair_labels(papers: DataFrame) -> DataFrame:
    """(split, label, n) of all ordered pairs of distinct papers in a split.

    Papers of equal path are counted first and meet the counts of their ancestors by path: no pair of papers is made, and
    none of nodes that have nothing to do with each other, which are what is left of all pairs.
    """
    nodes = papers.groupBy("split", "node_path").agg(F.count(F.lit(1)).alias("n"))
    above = nodes.select("split", F.explode(ancestors(F.col("node_path"))).alias("node_path"), F.col("n").alias("below")).groupBy("split", "node_path").agg(F.sum("below").alias("below"))
    sums = nodes.join(above, ["split", "node_path"], "left").groupBy("split").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("peers"), F.sum(F.col("n") * F.coalesce("below", F.lit(0))).alias("down")
    )
    n = {"A_TO_B": F.col("down"), "B_TO_A": F.col("down"), "PEER": F.col("peers"), "NONE": F.col("n") * (F.col("n") - 1) - F.col("peers") - 2 * F.col("down")}
    return sums.select("split", F.inline(F.array(*[F.struct(F.lit(k).alias("label"), v.cast("long").alias("n")) for k, v in n.items()])))


def block_labels(papers: DataFrame, block: tuple[str, ...] = ("lang", "venue")) -> DataFrame:
    """(label, n) of the pairs of pairs.block_pairs, the later paper as A, without making a pair.

    Under each node, papers of the node meet in order of arrival those of the nodes below it: the later one of two is A.
    Rows of (paper, ancestor) are all that is shuffled; papers without a block or an id have no pairs.
    """
    from pyspark.sql import Window

    known = papers.select(*block, "split_index", "paper_id", "node_path").dropna(subset=[*block, "split_index", "paper_id"])
    sizes = lambda *by: known.dropna(subset=[*by]).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("n"))
    paths = F.array_append(ancestors(F.col("node_path")), F.col("node_path"))
    rows = known.select(*block, "split_index", "paper_id", "node_path", F.explode(paths).alias("node")).withColumn("own", (F.col("node_path") == F.col("node")).cast("int"))
    order = Window.partitionBy(*block, "node").orderBy("split_index", "paper_id")
    before = lambda x: F.sum(x).over(order.rowsBetween(Window.unboundedPreceding, -1))
    met = rows.select("own", before(F.col("own")).alias("up"), before(1 - F.col("own")).alias("down"))
    sums = met.agg(F.coalesce(F.sum(F.when(F.col("own") == 1, F.col("down"))), F.lit(0)).alias("down"), F.coalesce(F.sum(F.when(F.col("own") == 0, F.col("up"))), F.lit(0)).alias("up"))
    one = sizes(*block).select(F.col("n").alias("pairs")).join(sizes(*block, "node_path").select(F.col("n").alias("peers"))).join(sums)
    n = {"A_TO_B": F.col("down"), "B_TO_A": F.col("up"), "PEER": F.col("peers"), "NONE": F.col("pairs") - F.col("peers") - F.col("down") - F.col("up")}
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("label"), v.cast("long").alias("n")) for k, v in n.items()])))


def node_statistics(papers: DataFrame) -> DataFrame:
    """(node_path, node_name, node_level, papers, train, valid)."""
    return papers.groupBy("node_path").agg(
        F.count(F.lit(1)).alias("papers"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "valid").alias("valid")
    ).select("node_path", node_name(F.col("node_path")).alias("node_name"), node_level(F.col("node_path")).alias("node_level"), "papers", "train", "valid")


def without_nodes(papers: DataFrame, removed: DataFrame) -> DataFrame:
    """Papers whose node_path is not in removed."""
    return papers.join(removed.select("node_path").distinct(), "node_path", "left_anti")


def needed_papers(papers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Papers on either side of a pair."""
    ids = pairs.select(F.col("paper_a_id").alias("paper_id")).union(pairs.select(F.col("paper_b_id").alias("paper_id")))
    return papers.join(ids, "paper_id", "left_semi")


def shard_of(row_index: Column, shards: int) -> Column:
    if shards <= 0:
        raise ValueError("the number of shards must be positive")
    return F.pmod(row_index, F.lit(shards)).cast("int")


def shard(rows: DataFrame, row_index: str, shard_id: int, shards: int) -> DataFrame:
    if not 0 <= shard_id < shards:
        raise ValueError("shard_id must be from 0 to shards - 1")
    return rows.where(shard_of(F.col(row_index), shards) == shard_id)


def combined(shards: list[DataFrame]) -> DataFrame:
    """Shards one after the other, with their number."""
    out = None
    for k, own in enumerate(shards):
        own = own.withColumn("shard_id", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of the rows with equal keys the last one in the order."""
    from pyspark.sql import Window

    return rows.withColumn("_last", F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]))).where("_last = 1").drop("_last")
