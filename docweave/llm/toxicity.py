"""Toxicity scores from class-conditional Kneser-Ney models.

Toxic and ordinary text each have an interpolated Kneser-Ney model of order 4 over the bytes of running words (one space
between them, A-Z in lower case): within a word an n-gram knows inflected and compounded expressions by their stems, and
at its beginning it reaches back into the word before, as expressions of several words do.  The highest order counts
occurrences in a class, every lower order the different bytes before an n-gram.  Both models back off to counts of the
lowest order that they share, which smooth what is rare.  A document's score is a logistic function of the difference
of the two log-likelihoods per word.

Training uses a bounded sample of labelled documents (`per_class` rows and `max_bytes` of text), chosen by a hash of
the id among those whose crc32(doc_id) modulo 5 is 1, 2 or 3; those with remainder 4 set the logistic function;
those with remainder 0 are held out.  The models' size is bounded by that sample, so they are broadcast; every
whole text is scored, by table look-ups.

Defined results: a null, empty or blank text has a difference of 0; rows with equal ids or texts are scored each for
itself, and a labelled id trains with all its rows; extra columns are ignored; a null id is not held out unless the crc32 of an empty
string says so; of several labels of one id the largest holds; without labels of both kinds all scores are equal.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit
from .context_tree import held_out

#: Longest n-gram; discount; bounds of the sample.
ORDER, DISCOUNT, PER_CLASS, ORDINARY_TIMES, MAX_BYTES = 4, 0.75, 4000, 2, 96 << 20
FOLDS = 5


#: Bytes of a word that are spelled with the end of the word before it, ORDER - 1 at least.
HEAD = 4


def _grams(spelled: np.ndarray, where: np.ndarray, order: int) -> np.ndarray:
    out = np.zeros(len(where), np.uint64)
    for back in range(order - 1, -1, -1):
        out = (out << np.uint64(8)) | spelled[where - back]
    return out


def _heads(part: np.ndarray, w: kit.Words) -> np.ndarray:
    """Of each word the last bytes of the word before it, a space and its first bytes, as a big-endian number."""
    size = w.ends - w.starts
    folded = np.full(len(part) + 16, 0x20, np.uint8)
    folded[8:-8] = kit.FOLD[part]
    eight = np.ndarray(len(part) + 9, ">u8", folded, strides=(1,))
    tail = _spaced(eight[w.ends].astype(np.uint64) & np.uint64(0xFFFFFF), kit.LOW_BYTES[np.minimum(size, 3)], 3)
    begin = _spaced(eight[w.starts + 8].astype(np.uint64) >> np.uint64(32), ~kit.LOW_BYTES[HEAD - np.minimum(size, HEAD)], HEAD)
    before = np.full(len(size), 0x202020, np.uint64)
    before[1:] = tail[:-1]
    before[w.at[:-1][np.diff(w.at) > 0]] = 0x202020
    return (before << np.uint64(40)) | np.uint64(0x20 << 32) | begin


def _spaced(x: np.ndarray, keep: np.ndarray, n: int) -> np.ndarray:
    return (x & keep) | (np.uint64(int.from_bytes(b" " * n)) & ~keep)


def _head_places(head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of heads, the places that are predicted (up to HEAD bytes, or a short word and the space after it), their head."""
    spelled = head.astype(">u8").view(np.uint8)
    rows = spelled.reshape(-1, 8)[:, HEAD:]
    asked = np.ones(rows.shape, bool)
    asked[:, 1:] = np.cumsum(rows == 0x20, 1)[:, :-1] == 0
    which, step = np.nonzero(asked)
    return spelled, which * 8 + HEAD + step, which


def _rest_places(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of words with a space after each, the places that are predicted (all beyond a word's head), their word."""
    size = ends - starts
    begin = np.r_[0, np.cumsum(size + 1)]
    spelled = np.full(begin[-1], 0x20, np.uint8)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    spelled[np.repeat(begin[:-1], size) + step] = kit.FOLD[raw[np.repeat(starts, size) + step]]
    n = np.maximum(size + 1 - HEAD, 0)
    word = np.repeat(np.arange(len(size)), n)
    return spelled, np.repeat(begin[:-1] + HEAD, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), word


def _gram_counts(batches):
    """(n-gram of the highest order, its occurrences in ordinary and in toxic text) of training texts."""
    for batch in batches:
        label = np.asarray(batch["toxic"])
        raw, offs = kit.flat(batch["text"])
        for i, j in kit.slices(offs):
            part = raw[offs[i] : offs[j]]
            w = kit.Words(part, offs[i : j + 1] - offs[i])
            if not len(w):
                continue
            toxic = np.repeat(label[i:j], np.diff(w.at)) == 1
            found = []
            head, which = np.unique(_heads(part, w), return_inverse=True)
            found.append((_head_places(head), which, len(head)))
            _, first, which = np.unique(w.hashes(fold=True), return_index=True, return_inverse=True)
            found.append((_rest_places(part, w.starts[first], w.ends[first]), which, len(first)))
            for (spelled, where, unit), which, n in found:
                name, number = np.unique(_grams(spelled, where, ORDER), return_inverse=True)
                times = [np.bincount(which, own, n)[unit] for own in (~toxic, toxic)]
                yield pa.record_batch([pa.array(name.view(np.int64)), *(pa.array(np.bincount(number, t, len(name))) for t in times)], names=["gram", "ordinary", "toxic"])


class Tables:
    """Log-likelihood differences (toxic less ordinary) of known n-grams of each order, and of backing off from contexts."""

    def __init__(self, name: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray):
        """The n-grams of the highest order, ascending, and their counts in ordinary and toxic text."""
        counts = {ORDER: (name, ordinary, toxic)}
        for order in range(ORDER - 1, 0, -1):  # lower orders count the different bytes before, in each class
            name, *both = counts[order + 1]
            short, which = np.unique(name & np.uint64((1 << 8 * order) - 1), return_inverse=True)
            counts[order] = (short, *(np.bincount(which, c > 0, len(short)) for c in both))
        self.known, self.back = {}, {}
        lower, *both = counts[1]
        shared = both[0] + both[1]
        low = (shared + 0.5) / (shared.sum() + 128)
        p = [low, low]
        for order in range(2, ORDER + 1):
            name, *both = counts[order]
            context, which = np.unique(name >> np.uint64(8), return_inverse=True)
            suffix = np.searchsorted(lower, name & np.uint64((1 << 8 * (order - 1)) - 1))
            now, weights = [], []
            for c, below in zip(both, p, strict=True):
                total = np.bincount(which, c, len(context))
                cut = np.minimum(c, DISCOUNT)
                back = np.where(total > 0, np.bincount(which, cut, len(context)) / np.maximum(total, 1e-9), 1.0)
                now.append((c - cut) / np.where(total > 0, total, 1)[which] + back[which] * below[suffix])
                weights.append(np.log(back))
            self.known[order] = (name, np.log(now[1] / now[0]))
            self.back[order] = (context, weights[1] - weights[0])
            lower, p = name, now

    def differences(self, spelled: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Of each predicted byte, by the longest known n-gram."""
        out = np.zeros(len(where))
        rest = np.arange(len(where))
        for order in range(ORDER, 1, -1):
            name, value = self.known[order]
            gram = _grams(spelled, where[rest], order)
            at = np.minimum(np.searchsorted(name, gram), max(0, len(name) - 1))
            hit = name[at] == gram if len(name) else np.zeros(len(gram), bool)
            out[rest[hit]] += value[at[hit]]
            rest, gram = rest[~hit], gram[~hit] >> np.uint64(8)
            context, value = self.back[order]
            at = np.minimum(np.searchsorted(context, gram), max(0, len(context) - 1))
            hit = context[at] == gram if len(context) else np.zeros(len(gram), bool)
            out[rest[hit]] += value[at[hit]]
        return out


def _values(tables: Tables, places: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    spelled, where, which = places
    return np.bincount(which, tables.differences(spelled, where), n)


def difference_per_word(raw: np.ndarray, offs: np.ndarray, tables: Tables) -> np.ndarray:
    """Difference of the log-likelihoods per word of each text; 0 without words."""
    out = np.zeros(len(offs) - 1)
    for i, j in kit.slices(offs, 2 * kit.SLICE):
        part = raw[offs[i] : offs[j]]
        w = kit.Words(part, offs[i : j + 1] - offs[i])
        value = np.zeros(len(w))
        head, which = np.unique(_heads(part, w), return_inverse=True)
        own = np.zeros(len(head))
        for a in range(0, len(head), 1 << 16):
            some = head[a : a + (1 << 16)]
            own[a : a + len(some)] = _values(tables, _head_places(some), len(some))
        value += own[which]
        _, first, which = np.unique(w.hashes(fold=True), return_index=True, return_inverse=True)
        own = np.zeros(len(first))
        for a in range(0, len(first), 1 << 16):
            some = first[a : a + (1 << 16)]
            own[a : a + len(some)] = _values(tables, _rest_places(part, w.starts[some], w.ends[some]), len(some))
        value += own[which]
        sums = np.r_[0, np.cumsum(value)]
        out[i:j] = (sums[w.at[1:]] - sums[w.at[:-1]]) / np.maximum(np.diff(w.at), 1)
    return out


def _score(model, a: float, b: float):
    def run(batches):
        for batch in batches:
            ids = kit.long_ids(batch["doc_id"])
            per_word = difference_per_word(*kit.flat(batch["text"]), model.value)
            score = 1 / (1 + np.exp(-np.clip(a * per_word + b, -700, 700)))
            yield pa.record_batch([kit.id_column(ids), pa.array(held_out(ids, FOLDS, 0)), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(per_word)], names=["doc_id", "held_out", "score", "predicted", "per_word"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept by damped Newton steps on the penalised likelihood."""
    if not len(x) or y.min() == y.max():
        return 10.0, -4.0
    a = b = 0.0
    def loss(a, b):
        z = a * x + b
        return np.logaddexp(0, np.where(y, -z, z)).sum() + ridge * a * a / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
        w = p * (1 - p)
        g = np.array([((p - y) * x).sum() + ridge * a, (p - y).sum()])
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step, size, before = np.linalg.solve(h, g), 1.0, loss(a, b)
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > before:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(size * step).max() < 1e-8:
            break
    return float(a), float(b)


def _sample(docs: DataFrame, labels: DataFrame, rests: tuple[int, ...], per_class: int, max_bytes: int) -> DataFrame:
    """Labelled documents by the order of a hash of their ids: a bounded number of rows and bytes of each class."""
    spark = docs.sparkSession
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).where(rest.isin(*rests))
    first = [known.where(F.col("toxic") == k).withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id").limit(n) for k, n in ((0, per_class * ORDINARY_TIMES), (1, per_class))]
    chosen = first[0].union(first[1])
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(F.broadcast(chosen), "doc_id").collect()
    left, ids = {0: max_bytes * 2 // 3, 1: max_bytes // 3}, []
    for row in sorted(sizes, key=lambda r: (r["rank"], r["doc_id"])):
        if row["size"] <= left[row["toxic"]]:
            left[row["toxic"]] -= row["size"]
            ids.append((row["doc_id"], row["toxic"]))
    chosen = spark.createDataFrame(sorted(set(ids)), "doc_id long, toxic int")
    return docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")


def trained(train: DataFrame) -> Tables:
    """The models of a bounded sample: toxic (0 or 1) and text."""
    grams = train.select("toxic", "text").mapInArrow(kit.lean(_gram_counts), "gram long, ordinary double, toxic double")
    found = grams.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")).toArrow()
    name = np.asarray(found["gram"]).astype(np.int64).view(np.uint64)
    order = np.argsort(name)
    return Tables(name[order], *(np.asarray(found[c]).astype(float)[order] for c in ("ordinary", "toxic")))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, held_out, score, predicted and the difference of log-likelihoods per word, for each row of docs."""
    spark = docs.sparkSession
    kit.bounded_batches(spark)
    rows = kit.check_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    train = _sample(rows, labels, (1, 2, 3), per_class, max_bytes)
    model = spark.sparkContext.broadcast(trained(train))
    check = _sample(rows, labels, (4,), per_class, max_bytes)
    seen = check.select("toxic", "doc_id", "text").mapInArrow(kit.lean(_per_word(model)), "toxic int, per_word double").toArrow()
    a, b = logistic(np.asarray(seen["per_word"]), np.asarray(seen["toxic"]) == 1)
    return rows.mapInArrow(kit.lean(_score(model, a, b)), "doc_id long, held_out boolean, score double, predicted int, per_word double")


def _per_word(model):
    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch["toxic"], pa.array(difference_per_word(*kit.flat(batch["text"]), model.value))], names=["toxic", "per_word"])

    return run


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
