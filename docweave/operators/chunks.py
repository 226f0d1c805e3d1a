"""Fixed chunks of token sequences, their diagnostics, pooling, and the slots of a pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windows(tokens: Column, size: int) -> Column:
    """Consecutive pieces of so many tokens, the last one shorter; none of no tokens."""
    return F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / size).cast("int")), lambda i: F.slice(tokens, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


def needed(count: Column, size: int) -> Column:
    return F.when(count > 0, F.ceil(count / size)).otherwise(F.lit(0)).cast("long")


def chunk_table(rows: DataFrame, tokens: Column, size: int = 510, most: int = 5) -> DataFrame:
    """(paper_id, chunk_index, chunk) of the first chunks of each paper."""
    return rows.select("paper_id", F.posexplode(F.slice(windows(tokens, size), 1, most)).alias("chunk_index", "chunk"))


def diagnostics(rows: DataFrame, tokens: Column, size: int = 510, most: int = 5) -> DataFrame:
    """One row: chunks needed and used, papers cut off, the most that one needs."""
    n = rows.select(needed(F.size(tokens), size).alias("needed"))
    return n.agg(F.sum("needed").alias("needed"), F.sum(F.least("needed", F.lit(most))).alias("used"), F.count_if(F.col("needed") > most).alias("truncated"), F.max("needed").alias("most_needed"))


def mean_pool(values: DataFrame, by: list[str], mask: str = "mask", value: str = "value") -> DataFrame:
    """Masked mean: the sum of kept values over their number, one at least."""
    return values.groupBy(*by).agg((F.sum(F.when(F.col(mask), F.col(value)).otherwise(0.0)) / F.greatest(F.count_if(mask), F.lit(1))).alias("pooled"))


def pair_slots(pairs: DataFrame, chunks: DataFrame, per_side: int = 5) -> DataFrame:
    """(paper_a_id, paper_b_id, slot, chunk): A's chunks in slots from 0, B's from per_side; chunks beyond do not fit."""
    own = chunks.where(F.col("chunk_index") < per_side)
    a = pairs.join(own.select(F.col("paper_id").alias("paper_a_id"), F.col("chunk_index").alias("slot"), "chunk"), "paper_a_id")
    b = pairs.join(own.select(F.col("paper_id").alias("paper_b_id"), (F.col("chunk_index") + per_side).alias("slot"), "chunk"), "paper_b_id")
    columns = ["paper_a_id", "paper_b_id", "slot", "chunk"]
    return a.select(*columns).unionByName(b.select(*columns))


def first_pool(values: DataFrame, by: list[str], place: str = "token", value: str = "value") -> DataFrame:
    """The value of the first token, whatever the mask says (CLS pooling)."""
    return values.groupBy(*by).agg(F.min_by(value, place).alias("pooled"))


def collate(chunks: DataFrame, tokens: str = "chunk", most: int = 512, padding: str = "") -> DataFrame:
    """chunks with their tokens padded to `most` places, and the mask of those that are real."""
    held = F.slice(F.col(tokens), 1, most)
    mask = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: i <= F.size(held))
    return chunks.withColumn("mask", mask).withColumn(tokens, F.concat(held, F.array_repeat(F.lit(padding), F.lit(most) - F.size(held))))


def pair_tensors(slots: DataFrame, pairs: DataFrame, width: int, per_side: int = 5) -> DataFrame:
    """(paper_a_id, paper_b_id, x, chunk_mask): the embeddings of all slots one after the other, zeros where a slot has
    none, and which slots have one; slots: the pairs' slots with a column embedding."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), width)
    held = slots.groupBy("paper_a_id", "paper_b_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "embedding"))).alias("held"))
    out = pairs.select("paper_a_id", "paper_b_id").join(held, ["paper_a_id", "paper_b_id"], "left")
    places = F.sequence(F.lit(0), F.lit(2 * per_side - 1))
    own = F.coalesce("held", F.create_map().cast(f"map<int, array<float>>"))
    return out.select(
        "paper_a_id", "paper_b_id", F.flatten(F.transform(places, lambda i: F.coalesce(F.try_element_at(own, i), zeros))).alias("x"),
        F.transform(places, lambda i: F.map_contains_key(own, i)).alias("chunk_mask"),
    )


def tensor_bytes(rows: int, slots: int, width: int, bytes_each: int = 2) -> tuple[int, float]:
    """Size of a tensor in bytes and in GiB."""
    size = rows * slots * width * bytes_each
    return size, size / (1 << 30)


def hashing_encoder(width: int = 16) -> Callable[[pd.Series], list[list[float]]]:
    """A deterministic stand-in for a transformer: counts of hashed tokens, of length one."""
    import zlib

    def encode(chunks: pd.Series) -> list[list[float]]:
        out = []
        for chunk in chunks:
            v = [0.0] * width
            for token in chunk:
                v[zlib.crc32(token.encode()) % width] += 1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return encode


def encode(chunks: DataFrame, make: Callable[[], Callable[[pd.Series], list[list[float]]]]) -> DataFrame:
    """chunks with the column embedding; make() runs once for each task and loads the encoder there."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make()
        for batch in batches:
            yield pd.Series(encoder(batch))

    return chunks.withColumn("embedding", run("chunk"))
