"""Language-model scores by context-tree weighting over bytes.

Every byte is eight binary decisions; each decision has a node for every context of 0 to `depth` preceding bytes.
A node holds the Krichevsky-Trofimov estimate of its training counts and weighs it, by halves as context-tree
weighting does, against the product of its children (the contexts that are one byte longer).  Texts are scored by
the fixed tree: the probability of a bit mixes the estimates of all depths on its path with the nodes' posterior
weights, and a context that training never saw predicts one half.  -log2 of that, over the bytes, is the code
length per byte.  The baseline beside it is a unigram word model with add-one-half smoothing.

Nothing about the corpus is gathered in one place.  Training texts become counts of (context, byte) strings and of
words, dealt by the two last context bytes and by word; a dealt bucket computes the tree below its contexts; the
two uppermost levels have at most 65,536 nodes and are computed from the buckets' sums.  Chunks of documents ask
the buckets about each distinct string and word once.

Defined results: a null text is as an empty one (it still has its end); the crc32 of a null id is that of an empty
string; rows with the same id or text are scored each for itself and each counts; extra columns are ignored; a very long
text is held whole by one task (2 GB at most); an empty table gives an empty one.  Texts are lower-cased (A-Z) and end in a byte
that UTF-8 never has.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

CHUNK_BYTES, BUCKET_BYTES, FLUSH_BYTES = 6 << 20, 16 << 20, 32 << 20
END = 0xFF
END_WORD = np.uint64(0x656E64206F662074)
WORDS, STRINGS = 0, 1


def held_out(ids: np.ndarray, by: int, rest: int) -> np.ndarray:
    texts = (b"" if i == kit.NO_ID else b"%d" % i for i in ids.tolist())
    import zlib

    return np.fromiter((zlib.crc32(x) % by == rest for x in texts), bool, len(ids))


def strings(raw: np.ndarray, offs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte of the texts, and one for each end: the nearest context byte first, the byte itself last.

    Contexts that reach over the start of a text hold END bytes there.
    """
    folded = np.full(len(raw) + 16, END, np.uint8)
    folded[depth : depth + len(raw)] = kit.FOLD[raw]
    before = np.ndarray(len(raw) + 1, "<u8", folded, strides=(1,))  # eight bytes from each place on, the last ones highest
    before = (before & np.uint64((1 << 8 * depth) - 1)) << np.uint64(8)
    ends = before[offs[1:]] | np.uint64(END)
    out = before[:-1]
    out |= folded[depth : depth + len(raw)]
    size = np.diff(offs)
    for j in range(depth):
        beyond = np.uint64(((1 << 8 * (depth - j)) - 1) << 8)
        out[offs[:-1][size > j] + j] |= beyond
        ends[size == j] |= beyond
    return out, ends


def _bucket(keys: np.ndarray, kind: int, depth: int, buckets: int) -> np.ndarray:
    """Strings are dealt by the two nearest context bytes."""
    return kit.bucket_of(keys if kind == WORDS else kit.mix((keys >> np.uint64(8 * (depth - 1))) + np.uint64(77)), buckets)


def _blobs(keys: np.ndarray, kind: int, depth: int, buckets: int):
    """Sorted keys, bucket by bucket: the order of the dealt keys, and where each bucket's begin."""
    bucket = _bucket(keys, kind, depth, buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _count(depth: int, buckets: int, by: int, rest: int):
    """Counts of words and strings of training texts, a row for each bucket and FLUSH_BYTES of text."""

    def dealt(found: dict):
        for kind, (keys, counts) in found.items():
            order, cuts = _blobs(keys, kind, depth, buckets)
            rows = [(kind, b, kit.pack_sorted(keys[o]), kit.narrow(counts[o].astype(np.uint64))) for b in np.flatnonzero(np.diff(cuts)).tolist() for o in [order[cuts[b] : cuts[b + 1]]]]
            if rows:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["kind", "bucket", "keys", "counts"])

    def run(batches):
        found, seen = {}, 0
        for batch in batches:
            ids = kit.long_ids(batch["doc_id"])
            raw, offs = kit.flat(batch["text"])
            train = ~held_out(ids, by, rest)
            for i, j in kit.slices(offs):
                part, at = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                w = kit.Words(part, at)
                own = np.repeat(train[i:j], np.diff(w.at))
                words = np.unique(np.r_[w.hashes(fold=True)[own], np.full(train[i:j].sum(), END_WORD)], return_counts=True)
                keys, ends = strings(part, at, depth)
                keys = np.unique(np.r_[keys[np.repeat(train[i:j], np.diff(at))], ends[train[i:j]]], return_counts=True)
                for kind, new in ((WORDS, words), (STRINGS, keys)):
                    found[kind] = _summed([found[kind], new]) if kind in found else new
                seen += len(part)
                if seen >= FLUSH_BYTES:
                    yield from dealt(found)
                    found, seen = {}, 0
        yield from dealt(found)

    return run


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts]).astype(np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts[order], head) if len(head) else counts


def _total(table: pa.Table) -> pa.Table:
    keys, counts = _summed([(kit.unpack_sorted(k), kit.widen(c)) for k, c in zip(table["keys"].to_pylist(), table["counts"].to_pylist(), strict=True)])
    row = {"kind": table["kind"][0].as_py(), "bucket": table["bucket"][0].as_py(), "keys": kit.pack_sorted(keys), "counts": kit.narrow(counts.astype(np.uint64)), "distinct": len(keys), "total": int(counts.sum())}
    return pa.Table.from_pylist([row], schema=_TOTAL)


_TOTAL = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("distinct", pa.int64()), ("total", pa.int64())])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, with the argument raised to 8 at least."""
    x = np.asarray(x, float)
    low = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        if not small.any():
            break
        low[small] += np.log(y[small])
        y[small] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - low


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any sequence with so many zeros and ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def _steps(x: np.ndarray):
    """The eight decisions of each byte: node (1 to 255) and bit."""
    for i in range(8):
        yield (np.uint64(1 << i) | (x >> np.uint64(8 - i))), (x >> np.uint64(7 - i)) & np.uint64(1)


class _Tree:
    """Nodes of depths from `top` to `depth` over some strings with counts, in which `top` context bytes are never mixed."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int):
        self.depth, self.levels = depth, {}
        below = None
        for d in range(depth, top - 1, -1):
            context, x = self.at(keys, d)
            nodes, ones, number = [], [], []
            for node, bit in _steps(x):
                nodes.append((context << np.uint64(8)) | node)
                ones.append(np.where(bit == 1, counts, 0))
                number.append(counts)
            node = np.concatenate(nodes)
            name, which = np.unique(node, return_inverse=True)
            n = np.bincount(which, np.concatenate(number), len(name))
            n1 = np.bincount(which, np.concatenate(ones), len(name))
            estimate = weighted = kt_log(n - n1, n1)
            stop = np.ones(len(name))
            if below is not None:
                child, child_log = below
                parent = ((child >> np.uint64(16)) << np.uint64(8)) | (child & np.uint64(255))
                product = np.bincount(np.searchsorted(name, parent), child_log, len(name))
                weighted = np.logaddexp(estimate, product) - math.log(2)
                stop = np.exp(estimate - math.log(2) - weighted)
            self.levels[d] = (name, n, n1, stop, weighted)
            below = (name, weighted)

    def at(self, keys: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """The d nearest context bytes, and the byte that follows."""
        return keys >> np.uint64(8 * (self.depth + 1 - d)) if d else np.zeros(len(keys), np.uint64), keys & np.uint64(255)

    def bits(self, keys: np.ndarray):
        """For each of the eight decisions: node, bit, and the mixed probability of the bit from `top` on."""
        x = keys & np.uint64(255)
        for node, bit in _steps(x):
            p = np.full(len(keys), 0.5)
            for d, (name, n, n1, stop, _) in self.levels.items():  # the deepest first
                if not len(name):
                    continue
                key = (self.at(keys, d)[0] << np.uint64(8)) | node
                where = np.minimum(np.searchsorted(name, key), len(name) - 1)
                known = name[where] == key
                ones = n1[where]
                estimate = (np.where(bit == 1, ones, n[where] - ones) + 0.5) / (n[where] + 1.0)
                p = np.where(known, stop[where] * estimate + (1 - stop[where]) * p, 0.5)
            yield node, bit, p


def _upper_sums(depth: int):
    """What the two uppermost levels need of a bucket: sums over its nodes of depth 2."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts = kit.unpack_sorted(table["keys"][0].as_py()), kit.widen(table["counts"][0].as_py()).astype(np.int64)
        name, n, n1, _, weighted = _Tree(keys, counts, depth, 2).levels[2]
        near = ((name >> np.uint64(16)) << np.uint64(8)) | (name & np.uint64(255))
        head, which = np.unique(near, return_inverse=True)
        sums = [np.bincount(which, x, len(head)) for x in (n, n1, weighted)]
        return pa.table({"node": head.astype(np.int64), "n": sums[0], "n1": sums[1], "product": sums[2]})

    return run


def _upper_levels(sums) -> tuple[np.ndarray, np.ndarray]:
    """Weight of stopping and estimate of a one, for nodes of depth 0 (row 256) and 1 (rows by context byte)."""
    stop, one = np.ones((257, 256)), np.full((257, 256), 0.5)
    n, n1, product = np.zeros((257, 256)), np.zeros((257, 256)), np.zeros((257, 256))
    for row in sums:
        at = (row["node"] >> 8, row["node"] & 255)
        n[at], n1[at], product[at] = row["n"], row["n1"], row["product"]
    n[256], n1[256] = n[:256].sum(0), n1[:256].sum(0)
    for rows in (slice(0, 256), slice(256, 257)):
        estimate = kt_log(n[rows] - n1[rows], n1[rows])
        if rows.start:
            product[256] = weighted.sum(0)
        weighted = np.logaddexp(estimate, product[rows]) - math.log(2)
        stop[rows] = np.exp(estimate - math.log(2) - weighted)
    one = (n1 + 0.5) / (n + 1.0)
    return stop, one


class _Asked:
    """A chunk's documents and the distinct words and strings that it asks about."""

    def __init__(self, table: pa.Table, depth: int, buckets: int, places: bool = False):
        """places: remember where each string occurs."""
        ids = kit.long_ids(table["doc_id"])
        order = np.lexsort((np.asarray(table["row"].combine_chunks()), ids))
        table = table.take(pa.array(order))
        self.ids = ids[order]
        self.raw, self.offs = kit.flat(table["text"])
        self.words = kit.Words(self.raw, self.offs)
        self.word = self.words.hashes(fold=True)
        self.places, found = [], []
        for i, j in kit.slices(self.offs):
            keys = np.concatenate(strings(self.raw[self.offs[i] : self.offs[j]], self.offs[i : j + 1] - self.offs[i], depth))
            if places:
                order = np.argsort(keys)
                ordered = keys[order]
                head = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
                found.append(ordered[head])
                self.places.append((i, j, order.astype(np.uint32), np.diff(np.r_[head, len(keys)]), found[-1]))
            else:
                found.append(kit.distinct(keys))
        words = kit.distinct(np.r_[self.word, np.full(min(1, len(self.ids)), END_WORD)])
        self.keys = {WORDS: words, STRINGS: kit.distinct(np.concatenate(found)) if found else np.zeros(0, np.uint64)}
        self.dealt = {k: _blobs(v, k, depth, buckets) for k, v in self.keys.items()}


def _ask(depth: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        c = _Asked(table, depth, buckets)
        chunk = table["chunk"][0].as_py()
        rows = [(kind, b, chunk, kit.pack_sorted(c.keys[kind][order[cuts[b] : cuts[b + 1]]])) for kind, (order, cuts) in c.dealt.items() for b in np.flatnonzero(np.diff(cuts)).tolist()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["kind", "bucket", "chunk", "keys"])

    return run


_ANSWER = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("values", pa.binary())])


def _answer(depth: int, stop: np.ndarray, one: np.ndarray):
    def run(asks: pa.Table, totals: pa.Table) -> pa.Table:
        rows = []
        if asks.num_rows:
            kind, bucket = asks["kind"][0].as_py(), asks["bucket"][0].as_py()
            known, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if totals.num_rows:
                known, counts = kit.unpack_sorted(totals["keys"][0].as_py()), kit.widen(totals["counts"][0].as_py()).astype(np.int64)
            asked = [kit.unpack_sorted(x) for x in asks["keys"].to_pylist()]
            keys = kit.distinct(np.concatenate(asked))
            if kind == WORDS:
                where = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
                values = np.where(known[where] == keys, counts[where], 0) if len(known) else np.zeros(len(keys), np.int64)
            else:
                values = np.zeros(len(keys))
                near = (keys >> np.uint64(8 * depth)).astype(np.int64)
                for node, bit, p in _Tree(known, counts, depth, 2).bits(keys):
                    for row in (near, 256):
                        s, e = stop[row, node.astype(np.int64)], one[row, node.astype(np.int64)]
                        p = s * np.where(bit == 1, e, 1 - e) + (1 - s) * p
                    values += np.log10(p)
                values = values.astype(np.float32)
            for chunk, own in zip(asks["chunk"].to_pylist(), asked, strict=True):
                mine = values[np.searchsorted(keys, own)]
                rows.append((chunk, kind, bucket, kit.narrow(mine.astype(np.uint64)) if kind == WORDS else mine.tobytes()))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ANSWER, strict=True)], schema=_ANSWER) if rows else _ANSWER.empty_table()

    return run


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("known_log", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])


def _finish(depth: int, buckets: int, by: int, rest: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _SCORED.empty_table()
        c = _Asked(docs, depth, buckets, places=True)
        values = {WORDS: np.zeros(len(c.keys[WORDS]), np.int64), STRINGS: np.zeros(len(c.keys[STRINGS]))}
        for kind, b, blob in zip(*(answers[x].to_pylist() for x in ("kind", "bucket", "values")), strict=True):
            order, cuts = c.dealt[kind]
            values[kind][order[cuts[b] : cuts[b + 1]]] = kit.widen(blob).astype(np.int64) if kind == WORDS else np.frombuffer(blob, np.float32)
        count = values[WORDS][np.searchsorted(c.keys[WORDS], c.word)]
        end = values[WORDS][np.searchsorted(c.keys[WORDS], END_WORD)]
        del c.word
        logs, known = np.r_[0, np.cumsum(np.log10(count + 0.5))], np.r_[0, np.cumsum(count > 0)]
        at = c.words.at
        score = np.empty(len(c.ids))
        for i, j, order, times, keys in c.places:
            logs_of = np.empty(len(order))
            logs_of[order] = np.repeat(values[STRINGS][np.searchsorted(c.keys[STRINGS], keys)], times)
            offs = c.offs[i : j + 1] - c.offs[i]
            sums = np.r_[0, np.cumsum(logs_of[: offs[-1]])]
            score[i:j] = sums[offs[1:]] - sums[offs[:-1]] + logs_of[offs[-1] :]
        columns = [kit.id_column(c.ids), pa.array(held_out(c.ids, by, rest)), pa.array(np.diff(at) + 1), pa.array(known[at[1:]] - known[at[:-1]] + (end > 0)), pa.array(logs[at[1:]] - logs[at[:-1]] + math.log10(end + 0.5)), pa.array(score), pa.array(np.diff(c.offs) + 1)]
        return pa.Table.from_arrays(columns, schema=_SCORED)

    return run


def code_lengths(docs: DataFrame, depth: int = 5, by: int = 5, rest: int = 1, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Scores of all documents by a tree that learns from those whose crc32(doc_id) modulo `by` is not `rest`.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row.
    """
    spark = docs.sparkSession
    if not 2 <= depth <= 7:
        raise ValueError("depth must be 2 to 7 bytes")
    rows = kit.check_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    _, size = kit.volume(rows)
    buckets, chunks = kit.pieces(size, BUCKET_BYTES, spark), kit.pieces(size, chunk_bytes, spark)
    counted = rows.mapInArrow(kit.lean(_count(depth, buckets, by, rest)), "kind int, bucket int, keys binary, counts binary")
    totals = kit.settled(counted.groupBy("kind", "bucket").applyInArrow(kit.lean(_total), "kind int, bucket int, keys binary, counts binary, distinct long, total long"))
    known = totals.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    distinct, total = int(known[0]), int(known[1])
    near = totals.where(F.col("kind") == STRINGS).groupBy("bucket").applyInArrow(kit.lean(_upper_sums(depth)), "node long, n double, n1 double, product double")
    stop, one = _upper_levels(near.groupBy("node").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.sum("product").alias("product")).toLocalIterator())
    dealt = rows.select(kit.piece_of(chunks, "doc_id", "text").alias("chunk"), "doc_id", F.xxhash64("text").alias("row"), "text").repartition(min(chunks, kit.PARTITIONS), "chunk")
    asks = dealt.groupBy("chunk").applyInArrow(kit.lean(_ask(depth, buckets)), "kind int, bucket int, chunk int, keys binary")
    answers = asks.groupBy("kind", "bucket").cogroup(totals.groupBy("kind", "bucket")).applyInArrow(kit.lean(_answer(depth, stop, one)), "chunk int, kind int, bucket int, values binary")
    out = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        kit.lean(_finish(depth, buckets, by, rest)), "doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, score double, n_bytes long"
    )
    each = math.log10(total + 0.5 * (distinct + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("known_log") - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score",
        (-F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op4_context_tree(spark, sf_dir: str) -> DataFrame:
    return code_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet"))
