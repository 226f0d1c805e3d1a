"""Quality classifier: perplexity under an n-gram model of trusted text.

The model is an interpolated modified Kneser-Ney model of order 5 over the bytes of UTF-8 text, so that every script is
told apart; a byte that UTF-8 never has stands before a text and ends it.  It is trained on trusted text: documents
labelled as of good quality, all but one in APART of them by a hash of their ids (given `sample_rows`, of so many of
them).  All trusted documents that it is not trained on set the means and thresholds.

Counts of n-grams are summed and joined with the statistics of their contexts and with the probabilities of their
suffixes as tables that are sharded by n-gram, one order after the other.  The model is then dealt into shards by the
two nearest context bytes, so that a shard has all orders from 3 on of its n-grams (orders 1 and 2 have 256 and 65,536
rows at most and go along as one small array).  Documents are cut into blocks.  A block asks each shard about each of
its distinct n-grams once; the answers meet the block's text again, and its documents' sums are taken.  Each shard is
there several times, as many as the input asks for, and blocks ask copies by their names: no shard is a hot key.

Texts are scanned twice, for the questions and for the sums; blocks are named by their contents and places, and a
block whose answers are not all there ends the job.  So docs must come in the same order from both scans, as files, checkpoints
and persisted tables do.

A document's perplexity per byte is smoothed by `prior` bytes at its language's trusted mean, as very short texts
vary more.  It is rejected if that exceeds the `keep` quantile of trusted documents of its language (of all languages
where a language has fewer than `least` of them); quantiles are right within one rank in 10,000.  Of fewer rows than
1 / (1 - keep) the quantile is but the largest one; there the limit is that many times the language's own mean
perplexity as the quantile of all languages' ratios to their means says, if that is more.

Defined results: an empty, blank or null text has a null perplexity and is rejected; a null language is a language of
its own; a null id is scored as any; rows with equal ids are scored each for itself, and a trusted id sets thresholds
with all its rows; equal texts have equal perplexities; without trusted text every document with words is kept; an
empty table gives an empty one.  Columns named perplexity, threshold or kept are replaced, all others stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

ORDER, SYMBOLS, EDGE = 5, 256, 0xFF
KEEP, PRIOR, LEAST, APART = 0.995, 64, 30, 5
#: Trusted ids that are broadcast at most; more of them meet the documents in a shuffle.
NEAR = 4_000_000
#: Text of a block, and of what is turned into n-grams at a time; shards of the model; text whose questions one task answers; n-grams that a counting task holds.
BLOCK_BYTES, SLICE, SHARDS, TASK_BYTES, HELD = 4 << 20, 1 << 20, 64, 16 << 20, 1 << 20
LOWER = 2


def _grams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of all bytes and ends of some texts as numbers, and where each text's begin."""
    size = np.diff(offs)
    at = offs + np.arange(len(offs))
    line = np.full(at[-1] + 8, EDGE, np.uint8)  # EDGE bytes, then each text and its end
    solid = np.ones(at[-1], bool)
    solid[at[1:] - 1] = False
    line[ORDER - 1 : ORDER - 1 + at[-1]][solid] = raw
    out = np.ndarray(at[-1], ">u8", line, strides=(1,)).astype(np.uint64)
    out >>= np.uint64(8 * (8 - ORDER))
    for j in range(ORDER - 1):  # a context does not reach over the start of its text
        out[at[:-1][size >= j] + j] |= np.uint64(sum(EDGE << 8 * d for d in range(j + 1, ORDER)))
    return out, at


def _count(batches):
    """(n-gram, count), of many texts at a time."""
    held: list = []

    def rows():
        gram = np.concatenate([g for g, _ in held])
        order = np.argsort(gram)
        gram = gram[order]
        head = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        return gram[head], np.add.reduceat(np.concatenate([c for _, c in held])[order], head)

    def batch():
        gram, count = rows()
        held.clear()
        return pa.record_batch([pa.array(gram.astype(np.int64)), pa.array(count.astype(np.int64))], names=["gram", "c"])

    for part in batches:
        raw, offs = kit.flat(part["text"])
        for i, j in kit.slices(offs, SLICE):
            held.append(np.unique(_grams(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[0], return_counts=True))
            if sum(len(g) for g, _ in held) > 4 * HELD:
                held[:] = [rows()]
                if len(held[0][0]) > HELD:
                    yield batch()
    if held:
        yield batch()


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Of n-grams seen once, twice and more often, from the counts of counts."""
    n = counts.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first()
    if min(n) < 5:
        return 0.5, 0.75, 1.0
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1 * k), 0.95 * k) for k in (1, 2, 3))


def _probabilities(counts: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of each order from 1 on: (gram, p) of known n-grams, (context, back) of backing off."""
    orders = [counts]
    for order in range(ORDER - 1, 0, -1):  # lower orders count the different symbols before
        orders.insert(0, orders[0].groupBy((F.col("gram") % SYMBOLS**order).alias("gram")).agg(F.count(F.lit(1)).alias("c")))
    known, back = [], []
    for order, table in enumerate(orders, 1):
        d1, d2, d3 = _discounts(table)
        cut = F.when(F.col("c") >= 3, d3).when(F.col("c") == 2, d2).otherwise(d1)
        table = table.select("gram", "c", F.expr(f"gram div {SYMBOLS}").alias("context"), cut.alias("cut"))
        contexts = table.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("cut") / F.sum("c")).alias("back"))
        joined = table.join(contexts, "context")
        if order == 1:
            joined = joined.withColumn("below", F.lit(1.0 / SYMBOLS))
        else:
            below = known[-1].select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
            joined = joined.join(below, F.col("gram") % SYMBOLS ** (order - 1) == F.col("suffix"))
        known.append(kit.settled(joined.select("gram", ((F.col("c") - F.col("cut")) / F.col("total") + F.col("back") * F.col("below")).alias("p"))))
        back.append(contexts.select("context", "back"))
    return known, back


def _lower_orders(known: list[DataFrame], back: list[DataFrame]) -> np.ndarray:
    """Probability of each symbol after each symbol, by the two lowest orders: SYMBOLS x SYMBOLS, whatever the input."""
    p = np.full(1, 1 / SYMBOLS)
    for order in range(1, LOWER + 1):
        full = np.ones(SYMBOLS ** (order - 1))
        found = back[order - 1].toArrow()
        full[np.asarray(found["context"]).astype(np.int64)] = np.asarray(found["back"])
        p = np.multiply.outer(full, np.broadcast_to(p, SYMBOLS)).ravel()
        found = known[order - 1].toArrow()
        p[np.asarray(found["gram"]).astype(np.int64)] = np.asarray(found["p"])
    return p.astype(np.float32)


def _shard_of(context):
    """Shard of a context, by its two nearest bytes."""
    return kit.bucket_of(kit.mix((context & np.uint64(SYMBOLS**2 - 1)) + np.uint64(0x9D)), SHARDS)


_MODEL = "shard int, backs boolean, key long, value float"
_PACKED = pa.schema([("shard", pa.int32()), ("grams", pa.binary()), ("probabilities", pa.binary()), ("contexts", pa.binary()), ("backs", pa.binary())])


def _model_rows(order: int, backs: bool):
    def run(batches):
        for batch in batches:
            key = np.asarray(batch.column(0)).view(np.uint64)
            shard = _shard_of(key if backs else key >> np.uint64(8))
            yield pa.record_batch([pa.array(shard.astype(np.int32)), pa.array(np.full(len(key), backs)), pa.array((key | np.uint64(order << 56)).view(np.int64)), batch.column(1).cast(pa.float32())], names=["shard", "backs", "key", "value"])

    return run


def _pack(table: pa.Table) -> pa.Table:
    """A shard of the model: n-grams of all its orders with their probabilities, contexts with their weights."""
    backs = np.asarray(table["backs"].combine_chunks())
    key, value = np.asarray(table["key"]).view(np.uint64), np.asarray(table["value"])
    row = [table["shard"][0].as_py()]
    for own in (np.flatnonzero(~backs), np.flatnonzero(backs)):
        own = own[np.argsort(key[own])]
        row += [key[own].tobytes(), value[own].tobytes()]
    return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, _PACKED, strict=True)], schema=_PACKED)


def trained_shards(texts: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The model's shards (one row each), and the probabilities of its two lowest orders."""
    counts = kit.settled(texts.mapInArrow(kit.lean(_count), "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")))
    known, back = _probabilities(counts)
    rows = None
    for order in range(LOWER + 1, ORDER + 1):
        for table, backs in ((known[order - 1], False), (back[order - 1], True)):
            own = table.mapInArrow(kit.lean(_model_rows(order, backs)), _MODEL)
            rows = own if rows is None else rows.union(own)
    packed = rows.groupBy("shard").applyInArrow(kit.lean(_pack), "shard int, grams binary, probabilities binary, contexts binary, backs binary")
    return kit.settled(packed), _lower_orders(known, back)


def _asked(table: pa.Table, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of a block, their order by shard, and where each shard's begin."""
    raw, offs = kit.flat(table[text])
    keys = [kit.distinct(_grams(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[0]) for i, j in kit.slices(offs, SLICE)]
    keys = kit.distinct(np.concatenate(keys)) if len(keys) > 1 else keys[0]
    shard = _shard_of(keys >> np.uint64(8))
    order = np.argsort(shard, kind="stable")
    return keys, order, np.searchsorted(shard[order], np.arange(SHARDS + 1))


def _named(batches, text: str, size: int):
    """Blocks of a partition with their names: by contents, and by place so that equal blocks stay apart."""
    from pyspark import TaskContext

    partition = TaskContext.get().partitionId()
    for serial, table in enumerate(kit.blocks(batches, size, text)):
        yield kit.name_of(table.select([text]), partition, serial), table


_ASK = pa.schema([("shard", pa.int32()), ("copy", pa.int32()), ("block", pa.int64()), ("keys", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("logs", pa.binary())])


def _ask(text: str, size: int, copies: int):
    def run(batches):
        for block, table in _named(batches, text, size):
            keys, order, cuts = _asked(table, text)
            full = np.flatnonzero(np.diff(cuts))
            rows = [(b, block % copies, block, kit.squeeze(kit.pack_sorted(keys[order[cuts[b] : cuts[b + 1]]]))) for b in full.tolist()]
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ASK, strict=True)], schema=_ASK)

    return run


def _looked_up(table: np.ndarray, values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are in a sorted table, and their values."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, values[at]


def _answer(lower: np.ndarray):
    """Log-probabilities of the n-grams that blocks ask a shard about."""

    def run(asks: pa.Table, model: pa.Table) -> pa.Table:
        if not asks.num_rows:
            return _ANSWER.empty_table()
        blob = [np.zeros(0, t) for t in (np.uint64, np.float32) * 2]
        if model.num_rows:
            blob = [np.frombuffer(model[n][0].as_py(), t) for n, t in zip(_PACKED.names[1:], (np.uint64, np.float32) * 2, strict=True)]
        asked = [kit.unpack_sorted(kit.unsqueeze(x)[0]) for x in asks["keys"].to_pylist()]
        keys = kit.distinct(np.concatenate(asked))
        p = lower[(keys & np.uint64(SYMBOLS**LOWER - 1)).astype(np.int64)]
        for order in range(LOWER + 1, ORDER + 1):
            gram = keys & np.uint64(SYMBOLS**order - 1)
            tag = np.uint64(order << 56)
            hit, back = _looked_up(blob[2], blob[3], (gram >> np.uint64(8)) | tag)
            p = np.where(hit, back, 1.0) * p
            hit, value = _looked_up(blob[0], blob[1], gram | tag)
            p = np.where(hit, value, p)
        logs = np.log(p).astype(np.float32)
        blobs = [logs[np.searchsorted(keys, own)].tobytes() for own in asked]
        return pa.Table.from_arrays([asks["block"], asks["shard"], pa.array(blobs, pa.binary())], schema=_ANSWER)

    return run


def _freeze(text: str, size: int):
    def run(batches):
        for block, table in _named(batches, text, size):
            yield pa.record_batch([[block], [kit.frozen(table)]], names=["block", "rows"])

    return run


def _finish(text: str, keep: list[str]):
    """Blocks of rows with the sum of log-probabilities and the number of symbols, null where a text has no words."""

    def one(table: pa.Table, answers: dict) -> pa.Table:
        keys, order, cuts = _asked(table, text)
        logs = np.full(len(keys), np.nan, np.float32)
        for b, blob in answers.items():
            logs[order[cuts[b] : cuts[b + 1]]] = np.frombuffer(blob, np.float32)
        if np.isnan(logs).any():
            raise RuntimeError("the blocks of two scans differ: write docs to files or checkpoint them before they are scored")
        raw, offs = kit.flat(table[text])
        total, words = np.zeros(len(offs) - 1), np.zeros(len(offs) - 1, bool)
        for i, j in kit.slices(offs, SLICE):
            part, own = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            gram, at = _grams(part, own)
            sums = np.r_[0, np.cumsum(logs[np.searchsorted(keys, gram)], dtype=float)]
            total[i:j] = sums[at[1:]] - sums[at[:-1]]
            solid = np.r_[0, np.cumsum(~kit.SPACE[part])]
            words[i:j] = solid[own[1:]] > solid[own[:-1]]
        columns = [table[n] for n in keep]
        return pa.table([*columns, pa.array(total, mask=~words), pa.array(np.diff(offs) + 1, mask=~words)], names=[*keep, "log_p", "n_symbols"])

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        found = dict(zip(answers["shard"].to_pylist(), answers["logs"].to_pylist(), strict=True))
        out = [kit.frozen(one(kit.thawed(x), found)) for x in blocks["rows"].to_pylist()]
        if not out:
            raise RuntimeError("the blocks of two scans differ: write docs to files or checkpoint them before they are scored")
        return pa.table({"rows": pa.array(out, pa.binary())})

    return run


def _thaw(names: list[str]):
    def run(batches):
        for batch in batches:
            for blob in batch["rows"]:
                yield from kit.thawed(blob.as_py()).select(names).to_batches(max_chunksize=1 << 12)

    return run


class Scored:
    """Rows with their scores, in compressed blocks; columns() gives some of their columns."""

    def __init__(self, blocks: DataFrame, kinds: DataFrame):
        self.blocks, self.kinds = blocks, kinds

    def columns(self, *names: str) -> DataFrame:
        own = [n for n in names if n not in ("log_p", "n_symbols")]
        order = [*own, "log_p", "n_symbols"]
        return self.blocks.mapInArrow(kit.lean(_thaw(order)), kit.with_fields(self.kinds.select(*own), log_p="double", n_symbols="long"))


def scored(docs: DataFrame, texts: DataFrame, text: str = "text", keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> Scored:
    """The columns `keep` of docs with log_p and n_symbols, under a model that is trained on texts (column text).

    Scores are computed once and written to the shared folder with those columns, as compressed blocks.
    """
    shards, lower = trained_shards(texts)
    copies = max(1, -(-kit.volume(docs, text)[1] // (SHARDS * TASK_BYTES)))
    asks = docs.mapInArrow(kit.lean(_ask(text, block_bytes, copies)), "shard int, copy int, block long, keys binary")
    model = shards.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    answers = asks.groupBy("shard", "copy").cogroup(model.groupBy("shard", "copy")).applyInArrow(kit.lean(_answer(lower)), "block long, shard int, logs binary")
    blocks = docs.mapInArrow(kit.lean(_freeze(text, block_bytes)), "block long, rows binary")
    keep = docs.columns if keep is None else keep
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(kit.lean(_finish(text, keep)), "rows binary")
    return Scored(kit.settled(out), docs.select(*keep))


def perplexities(docs: DataFrame, labels: DataFrame, sample_rows: int | None = None, keep: float = KEEP, prior: float = PRIOR, least: int = LEAST, columns: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (or some columns of it) with perplexity, threshold and kept."""
    spark = docs.sparkSession
    kit.bounded_batches(spark)
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("trusted_id")).agg(F.min("quality").alias("q")).where("q = 1").select("trusted_id")
    good = kit.settled(good)
    some = good if sample_rows is None else good.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(sample_rows)
    train = kit.small(kit.settled(some.where(F.pmod(F.xxhash64("trusted_id", F.lit(1)), F.lit(APART)) != 0)), NEAR)
    apart = kit.small(kit.settled(good.join(train, "trusted_id", "left_anti")))
    names = [c for c in columns or docs.columns if c.lower() not in ("perplexity", "threshold", "kept")]
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").alias("of_lang"), F.col("text").alias("body"), *[docs[n].alias(f"c{k}") for k, n in enumerate(names) if n != "text"])
    own = {n: "body" if n == "text" else f"c{k}" for k, n in enumerate(names)}
    texts = rows.join(train, F.col("id") == F.col("trusted_id")).select(F.col("body").alias("text"))
    found = scored(rows, texts, "body", list(dict.fromkeys(["id", "of_lang", *own.values()])), block_bytes)
    seen = kit.settled(found.columns("id", "of_lang").where("log_p is not null").join(apart, F.col("id") == F.col("trusted_id")).select("of_lang", "log_p", "n_symbols"))
    mean = kit.settled(seen.groupBy("of_lang").agg(F.count(F.lit(1)).alias("n"), (F.sum("log_p") / F.sum("n_symbols")).alias("mean")))
    total = seen.agg((F.sum("log_p") / F.sum("n_symbols")).alias("mean")).first()["mean"]
    total = -float(np.log(SYMBOLS)) if total is None else total

    def smooth(mean):
        return F.exp(-(F.col("log_p") + prior * mean) / (F.col("n_symbols") + prior))

    same = F.col("of_lang").eqNullSafe(F.col("of"))
    each = seen.join(kit.small(mean.select(F.col("of_lang").alias("of"), "mean")), same).select("of_lang", smooth(F.col("mean")).alias("x"), (smooth(F.col("mean")) * F.exp("mean")).alias("ratio"))
    every = seen.select(smooth(F.lit(total)).alias("x")).agg(F.percentile_approx("x", F.lit(keep), F.lit(10_000)).alias("x")).first()["x"]
    every = float("inf") if every is None else every
    ratio = each.agg(F.percentile_approx("ratio", F.lit(keep), F.lit(10_000)).alias("x")).first()["x"] or 0.0
    limits = each.groupBy("of_lang").agg(F.percentile_approx("x", F.lit(keep), F.lit(10_000)).alias("limit"))
    limits = mean.select(F.col("of_lang").alias("of"), "mean", "n").join(limits, same).where(F.col("n") >= least)
    few = F.col("n") * (1 - keep) < 1
    limits = limits.select("of", "mean", F.when(few, F.greatest("limit", ratio * F.exp(-F.col("mean")))).otherwise(F.col("limit")).alias("limit"))
    out = found.columns("of_lang", *own.values()).join(kit.small(kit.settled(limits)), same, "left").withColumn("perplexity", smooth(F.coalesce("mean", F.lit(total)))).withColumn("threshold", F.coalesce("limit", F.lit(every)))
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept")
    return out.select(*[F.col(own[n]).alias(n) for n in names], "perplexity", "threshold", kept)


def keep_quality(docs: DataFrame, labels: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    inner, names = kit.packed(docs)
    inner = inner.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), F.col("row.lang").alias("lang"), F.col("row").dropFields(*[n for n in names if n == "text"]).alias("rest"))
    out = perplexities(inner, labels, block_bytes=block_bytes).where("kept")
    return out.select(*[F.col("text") if n == "text" else F.col("rest")[n].alias(n) for n in names])


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return perplexities(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), columns=["doc_id", "lang"])
