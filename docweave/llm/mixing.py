"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks by a hash of its rows, and its blocks are permuted.  A source's quota is a number of
blocks: the mix draws its permuted blocks in order, over again from the first where the target exceeds the source, and
of the last block only the part, cut by the rows' hashes, with which the words drawn come nearest to the target (found
by sums over bins, finer from level to level, so that no source is ever sorted in one place).  The quotas are then
split between two halves of the output shards, the halves between their halves and so on; each split is a
multivariate-hypergeometric draw, so shards get exact, disjoint ranges of every source's permuted blocks.  A row is
drawn into the shards whose ranges hold its block.  A shard orders its rows by a hash.

A split follows from its place in the tree alone, so tasks walk only to the shards of the rows that they have, and
neither the driver nor a task holds the quotas of all shards.  Blocks are as many as the input asks for.

Targets: sources by code point, null last, weigh `weights` in turn and share `ratio` times all words; what is above
`most` times a source's words is shared again by weight among the others.

Defined results: a null or empty text has no words; a null source is a source of its own; rows with equal id and text
are taken alike, null ids too; an empty table gives an empty mix; a source without words has target 0 and its rows are
not drawn; very long texts are only counted, rows are drawn as they are; mix() returns the columns of docs, whatever
their names, and mix_draws() its own columns and no others.  The driver holds a row for each source and open bin.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

#: Bits of a block's number at least, of a row's place in its block, and of the bins of a level; bytes of text in a
#: shard; partitions that shards are written in at most; splits that a worker remembers.
BLOCK_BITS, FINE_BITS, LEVEL_BITS, SHARD_BYTES, WRITTEN, REMEMBERED = 12, 24, 12, 64 << 20, 50_000, 100_000


def targets(sizes: dict, ratio: float = 1.5, weights: tuple = (5, 2, 1), most: float = 2.0) -> dict:
    """Words of each source in the mix."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, set(order), ratio * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not above:
            out |= {s: left * weight[s] / total for s in free}
            break
        out |= {s: most * sizes[s] for s in above}
        left -= sum(out[s] for s in above)
        free -= above
    return out


def split(quotas: np.ndarray, lo: int, hi: int, seed: int) -> np.ndarray:
    """Of the shards from lo to hi and their quotas of each source, the quotas of the first half."""
    draws = int(quotas.sum()) * ((lo + hi) // 2 - lo) // (hi - lo)
    rng = np.random.default_rng([seed, lo, hi])
    return rng.multivariate_hypergeometric(quotas, draws, method="marginals") if draws else np.zeros_like(quotas)


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows); columns sum to the quotas."""
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.asarray(quotas, np.int64))]
    while todo:
        lo, hi, own = todo.pop()
        if hi - lo == 1:
            out[lo] = own
            continue
        left = split(own, lo, hi, seed)
        todo += [(lo, (lo + hi) // 2, left), ((lo + hi) // 2, hi, own - left)]
    return out


@dataclass
class Plan:
    """What every row's draws follow from."""

    sources: dict  # source -> number
    quotas: np.ndarray  # blocks of each source in the mix
    cut: np.ndarray  # of the last block rows are drawn whose places are below it
    words: np.ndarray
    target: np.ndarray
    shards: int
    bits: int  # of a block's number
    seed: int
    known: dict = field(default_factory=dict)  # splits of the tree that this worker has made

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def place(self, source: np.ndarray, key: np.ndarray) -> np.ndarray:
        """A row's place in its source: its block's rank in the permutation, then the rest of the hash."""
        key = key.view(np.uint64)
        mask, half = np.uint64((1 << self.bits) - 1), np.uint64(self.bits // 2)
        x = key >> np.uint64(64 - self.bits)
        own = kit.mix(source.astype(np.uint64) + np.uint64(self.seed << 32))
        for step in range(3):  # each step is a bijection of the blocks
            turn = kit.mix(own + np.uint64(step))
            x = (x + (turn >> np.uint64(32))) & mask
            x ^= x >> half
            x = (x * (turn | np.uint64(1))) & mask
        fine = (key >> np.uint64(64 - self.bits - FINE_BITS)) & np.uint64((1 << FINE_BITS) - 1)
        return ((x << np.uint64(FINE_BITS)) | fine).astype(np.int64)

    def numbers(self, sources: list) -> np.ndarray:
        return np.fromiter((self.sources[s] for s in sources), np.int64, len(sources))

    def shard_of(self, source: np.ndarray, index: np.ndarray) -> np.ndarray:
        """The shards whose ranges hold some blocks of the sources' draws, down the tree; -1 beyond the quotas."""
        out = np.full(len(index), -1)
        todo = [(0, self.shards, self.quotas, np.zeros_like(self.quotas), np.flatnonzero(index < self.quotas[source]))]
        while todo:
            lo, hi, own, begin, rows = todo.pop()
            if not len(rows):
                continue
            if hi - lo == 1:
                out[rows] = lo
                continue
            left = self.known.get((lo, hi))
            if left is None:
                left = split(own, lo, hi, self.seed)
                if len(self.known) < REMEMBERED:
                    self.known[lo, hi] = left
            first = index[rows] < (begin + left)[source[rows]]
            mid = (lo + hi) // 2
            todo += [(lo, mid, left, begin, rows[first]), (mid, hi, own - left, begin + left, rows[~first])]
        return out


def _sizes(batches):
    for batch in batches:
        raw, offs = kit.flat(batch["text"])
        size = np.zeros(len(offs) - 1, np.int64)
        for i, j in kit.slices(offs):
            size[i:j] = np.diff(kit.Words(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]).at)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], batch["key"], pa.array(size)], names=["doc_id", "source", "key", "size"])


def _bins(plan: Plan, shift: int, above: int):
    """(source, bin of the place, words); finer levels look at the source's open bin of the level above only."""

    def run(batches):
        for batch in batches:
            source = plan.numbers(batch["source"].to_pylist())
            place = plan.place(source, np.asarray(batch["key"]))
            own = np.flatnonzero(place >> above == plan.cut[source] >> above)
            bins = (place[own] >> shift) & ((1 << above - shift) - 1)
            name, which = np.unique(source[own] << LEVEL_BITS | bins, return_inverse=True)
            yield pa.record_batch([pa.array(name >> LEVEL_BITS), pa.array(name & ((1 << LEVEL_BITS) - 1)), pa.array(np.bincount(which, np.asarray(batch["size"])[own], len(name)).astype(np.int64))], names=["source", "bin", "words"])

    return run


def make_plan(sizes: DataFrame, ratio: float, weights: tuple, most: float, shards: int, seed: int, bits: int) -> Plan:
    """sizes: source, key and size of each row."""
    by = {r["source"]: int(r["words"]) for r in sizes.groupBy("source").agg(F.sum("size").alias("words")).collect()}
    order = sorted(by, key=lambda s: (s is None, s or ""))
    words = np.array([by[s] for s in order], np.int64)
    goal = targets(by, ratio, weights, most)
    target = np.array([goal[s] for s in order], float)
    whole = np.where(words > 0, np.floor(np.divide(target, words, out=np.zeros(len(words)), where=words > 0) + 1e-9), 0).astype(np.int64)
    plan = Plan({s: i for i, s in enumerate(order)}, np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), words, target, shards, bits, seed)
    need = np.maximum(target - whole * words, 0)  # words beyond the whole draws
    above = bits + FINE_BITS
    while above:
        shift = max(0, above - LEVEL_BITS)
        found = sizes.mapInArrow(kit.lean(_bins(plan, shift, above)), "source long, bin long, words long").groupBy("source", "bin").agg(F.sum("words").alias("words")).toArrow()
        source, place, count = (np.asarray(found[c]).astype(np.int64) for c in ("source", "bin", "words"))
        sort = np.lexsort((place, source))
        source, place, count = source[sort], place[sort], count[sort]
        ends = np.searchsorted(source, np.arange(len(order) + 1))
        for s in range(len(order)):
            own = slice(ends[s], ends[s + 1])
            total = np.cumsum(count[own])
            if not len(total) or need[s] <= 0:
                continue
            at = int(np.searchsorted(total, need[s], "right"))
            before = total[at - 1] if at else 0
            if at == len(total):  # all of it
                at -= 1
                before = total[at - 1] if at else 0
            plan.cut[s] += int(place[own][at]) << shift
            if not shift:
                plan.cut[s] += int(total[at] - need[s] <= need[s] - before)
            need[s] -= before
        above = shift
    plan.quotas = whole * (1 << bits) + -(-plan.cut >> FINE_BITS)
    return plan


def _draws(plan: Plan):
    """Appends size of the source, its target, and the draws of each row: which time, shard, order in the shard."""
    kind = pa.list_(pa.field("element", pa.struct([("draw", pa.int32()), ("shard", pa.int32()), ("order", pa.int64())])))

    def run(batches):
        for batch in batches:
            source = plan.numbers(batch["source"].to_pylist())
            key = np.asarray(batch["key"])
            place = plan.place(source, key)
            block, shards = place >> FINE_BITS, []
            for draw in range(int((plan.quotas >> plan.bits).max(initial=0)) + 1):
                index = block + (draw << plan.bits)
                shard = plan.shard_of(source, index)
                shard[(index == plan.quotas[source] - 1) & (plan.cut[source] > 0) & (place >= plan.cut[source])] = -1  # the last block's rest
                shards.append(shard)
            row, draw = np.nonzero(np.stack(shards, 1) >= 0)
            at = np.searchsorted(row, np.arange(len(key) + 1))
            order = kit.mix(key[row].view(np.uint64) + np.uint64(plan.seed) + draw.astype(np.uint64)).view(np.int64)
            draws = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(draw.astype(np.int32)), pa.array(np.stack(shards, 1)[row, draw].astype(np.int32)), pa.array(order)], ["draw", "shard", "order"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(plan.words[source]), pa.array(plan.target[source]), draws.cast(kind)], names=[*batch.schema.names, "source_size", "target", "draws"])

    return run


_DRAWS = "array<struct<draw: int, shard: int, order: long>>"


def _planned(docs: DataFrame, ratio: float, weights: tuple, most: float, shards: int | None, seed: int) -> tuple[DataFrame, Plan]:
    keyed = docs.select("doc_id", "source", "text", F.xxhash64("doc_id", "text").alias("key"))
    sizes = kit.settled(keyed.mapInArrow(kit.lean(_sizes), f"doc_id {dict(docs.dtypes)['doc_id']}, source string, key long, size long"))
    volume = int(ratio * kit.volume(docs)[1])
    shards = shards or kit.pieces(volume, SHARD_BYTES, docs.sparkSession)
    bits = max(BLOCK_BITS, (4 * volume // SHARD_BYTES).bit_length())  # a block is smaller than a shard
    return sizes, make_plan(sizes, ratio, weights, most, shards, seed, bits)


def mix_draws(docs: DataFrame, ratio: float = 1.5, weights: tuple = (5, 2, 1), most: float = 2.0, shards: int | None = None, seed: int = 7) -> DataFrame:
    """doc_id, source, key, size, source_size, target and draws of each row, without the texts."""
    sizes, plan = _planned(docs, ratio, weights, most, shards, seed)
    return sizes.mapInArrow(kit.lean(_draws(plan)), kit.with_fields(sizes, source_size="long", target="double", draws=_DRAWS))


def mix(docs: DataFrame, ratio: float = 1.5, weights: tuple = (5, 2, 1), most: float = 2.0, shards: int | None = None, seed: int = 7) -> DataFrame:
    """The mixed rows of docs: a partition for each shard or several, in the order of the shards."""
    _, plan = _planned(docs, ratio, weights, most, shards, seed)
    rows, names = kit.packed(docs)
    rows = rows.select("row", F.col("row.source").alias("source"), F.xxhash64("row.doc_id", "row.text").alias("key"))
    out = rows.mapInArrow(kit.lean(_draws(plan)), kit.with_fields(rows, source_size="long", target="double", draws=_DRAWS))
    out = out.select("row", F.explode("draws").alias("one"))
    out = out.repartition(min(plan.shards, WRITTEN), "one.shard").sortWithinPartitions("one.shard", "one.order")
    return out.select(*[F.col("row")[n].alias(n) for n in names])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix_draws(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.size("draws").alias("n_draws"), "source", F.col("draws.shard").alias("shards"))
