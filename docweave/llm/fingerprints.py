"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, those into longer phrases and so on.  Each level turns the symbols' names
into small labels by deterministic coin tossing: a symbol's label is the lowest bit in which it differs from the
symbol before it, with that bit's value, again and again until there are at most six labels; neighbours in a text
always differ, as runs of one symbol are first joined.  A phrase begins at each local maximum of the labels, so it
has a bounded length and its borders depend on a bounded neighbourhood alone: equal substrings get equal phrases in
their interior, wherever they stand.  A phrase's name is a hash of its symbols' names.

The fingerprint keeps the SIZE smallest hashed names of phrases from level FROM on and of the text's topmost phrases
(a bottom sketch); the likeness of two fingerprints estimates the Jaccard similarity of their sets of names.

Defined results: a null text is as an empty one, whose fingerprint is empty; two empty fingerprints are alike (1), an
empty one and another are not (0); equal texts have equal fingerprints, whatever their ids; a very long text is parsed
whole by one task (2 GB at most); extra columns are ignored; an empty table gives an empty one.  In the query rows
follow one another by id, then by a hash of the text; null ids come last, and after the last row the first follows.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

SIZE, FROM, LEVELS = 64, 3, 40
BUCKET_BYTES = 8 << 20


def _coin(symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Twice the lowest bit in which two different symbols differ, plus the symbol's value of that bit."""
    low = symbol ^ before
    low &= ~low + np.uint64(1)
    bit = (np.frexp(low.astype(np.float64))[1] - 1).astype(np.uint64)
    return (bit << np.uint64(1)) | ((symbol >> bit) & np.uint64(1))


def _small_coins(width: int) -> np.ndarray:
    """Labels of all pairs of symbols below width; equal symbols get 0."""
    a, b = np.meshgrid(np.arange(width, dtype=np.uint64), np.arange(width, dtype=np.uint64), indexing="ij")
    return np.where(a == b, 0, _coin(a, np.where(a == b, a ^ np.uint64(1), b))).astype(np.uint8)


BYTE_COINS, COINS = _small_coins(256), _small_coins(128)


def _labels(symbol: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Labels 0 to 5 of symbols that differ from their neighbours; the first of a text starts from its own low bits."""
    n = len(symbol)
    if symbol.dtype == np.uint8:
        label = np.empty(n, np.uint8)
        label[1:] = BYTE_COINS.ravel()[(symbol[1:].astype(np.uint32) << 8) | symbol[:-1]]
    else:
        label = np.empty(n, np.uint8)
        label[1:] = _coin(symbol[1:], np.where(symbol[1:] == symbol[:-1], symbol[1:] ^ np.uint64(1), symbol[:-1])).astype(np.uint8)
    label[head] = (symbol[head] & 1).astype(np.uint8)
    for _ in range(3):  # from 128 labels to 14, 8 and 6 at most; as often everywhere, or equal texts could differ
        new = np.empty(n, np.uint8)
        new[1:] = COINS.ravel()[(label[1:].astype(np.uint32) << 7) | label[:-1]]
        new[head] = label[head] & 1
        label = new
    return label


def _next_level(symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of each text, and where each text's begin."""
    n = len(symbol)
    size = np.diff(at)
    head = at[:-1][size > 0]
    first = np.zeros(n, bool)
    first[head] = True
    # runs of one symbol become one symbol
    start = first.copy()
    start[1:] |= symbol[1:] != symbol[:-1]
    where = np.flatnonzero(start)
    run = np.diff(np.r_[where, n])
    base = symbol[where]
    wide = base.astype(np.uint64)
    long = run > 1
    if long.any() or symbol.dtype != np.uint8:
        wide = np.where(long, kit.mix(kit.mix(wide + np.uint64(0x2D)) + run.astype(np.uint64)), wide)
        plain = not long.any() and symbol.dtype == np.uint8
    else:
        plain = True
    first = first[where]
    label = _labels(base if plain else wide, np.flatnonzero(first))
    # a phrase begins at a text's first symbol and at local maxima that do not follow another beginning at once
    peak = first.copy()
    last = np.r_[first[1:], True]
    peak[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:]) & ~first[1:-1] & ~first[:-2] & ~last[1:-1]
    begin = np.flatnonzero(peak)
    length = np.diff(np.r_[begin, len(wide)])
    step = np.arange(len(wide)) - np.repeat(begin, length)
    total = np.r_[np.uint64(0), np.cumsum(kit.mix(kit.mix(wide + np.uint64(0x51)) ^ (np.uint64(kit.SECOND_BASE) * step.astype(np.uint64))))]
    name = kit.mix(total[begin + length] - total[begin] + length.astype(np.uint64))
    new_at = np.searchsorted(begin, np.searchsorted(where, at))
    return name, new_at


def _sketches(raw: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """The smallest hashed names of each text, ascending."""
    texts = len(offs) - 1
    names, owners = [], []
    symbol, at = raw, offs
    for level in range(1, LEVELS):
        symbol, at = _next_level(symbol, at)
        count = np.diff(at)
        owner = np.repeat(np.arange(texts), count)
        take = np.ones(len(symbol), bool) if level >= FROM else count[owner] == 1
        names.append(kit.mix(symbol[take] ^ np.uint64(0xF1)) >> np.uint64(16))
        owners.append(owner[take])
        if (count <= 1).all():
            break
        if (count == 1).any():  # done: their one phrase has been taken
            rest = count > 1
            symbol = symbol[rest[owner]]
            at = np.r_[0, np.cumsum(np.where(rest, count, 0))]
    name, owner = np.concatenate(names), np.concatenate(owners)
    order = np.argsort((owner.astype(np.uint64) << np.uint64(48)) | name) if texts < 1 << 16 else np.lexsort((name, owner))
    name, owner = name[order], owner[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
    name, owner = name[new], owner[new]
    begin = np.searchsorted(owner, np.arange(texts + 1))
    return [name[a : min(b, a + size)] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def sketches(raw: np.ndarray, offs: np.ndarray, size: int = SIZE) -> list[np.ndarray]:
    out = []
    for i, j in kit.slices(offs, kit.SLICE):
        out += _sketches(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)
    return out


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity of the sets behind two sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = np.sort(np.concatenate([a, b]))
    twice = least[1:] == least[:-1]
    union = least[np.r_[True, ~twice]][:size]
    both = least[1:][twice]
    return float(np.searchsorted(both, union[-1], "right") / len(union))


def text_of(sketch: np.ndarray) -> str:
    """A fingerprint as text: twelve hexadecimal digits for each name."""
    return sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def fingerprint(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id and fingerprint of each row."""
    rows = kit.check_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch["doc_id"], pa.array([text_of(s) for s in sketches(*kit.flat(batch["text"]), size)], pa.string())], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(kit.lean(run), "doc_id long, fingerprint string")


def with_next(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows by ranges of ids, in order, each range with the first row of the next one behind it: (bucket, own, i, doc_id, h, text).

    The ranges' borders are quantiles of the ids, PARTITIONS at most; rows without an id come last and have ranges of
    their own, by the texts' hashes.  The driver holds a row for each range.
    """
    spark = docs.sparkSession
    rows = kit.check_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    count = min(kit.PARTITIONS, kit.pieces(kit.volume(rows)[1], bucket_bytes, spark))
    borders = sorted(set(rows.select(F.percentile_approx("doc_id", [i / count for i in range(1, count)], 100_000).alias("q")).first()["q"] or [])) if count > 1 else []
    edges = np.array(borders, np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series, h: pd.Series) -> pd.Series:
        i, h = ids.to_numpy(np.int64), h.to_numpy(np.int64)
        last = len(edges) + 1 + ((h >> 1).astype(np.float64) / 2.0**63 + 0.5) * count  # h from its smallest to its largest value
        return pd.Series(np.where(i == kit.NO_ID, np.minimum(last, len(edges) + count), np.searchsorted(edges, i)).astype(np.int32))

    rows = rows.withColumn("i", F.coalesce("doc_id", F.lit(int(kit.NO_ID)))).withColumn("h", F.xxhash64("text"))
    rows = rows.select(bucket("i", "h").alias("bucket"), "i", "h", "doc_id", "text")
    # the first row of each bucket also goes to the last bucket before it that has rows
    first = rows.groupBy("bucket").agg(F.min(F.struct("i", "h")).alias("first")).orderBy("bucket").collect()
    links = [(b["bucket"], b["first"]["i"], b["first"]["h"], a["bucket"]) for a, b in zip(first[:-1], first[1:], strict=True)]
    links = F.broadcast(spark.createDataFrame(links, "b int, first_i long, first_h long, before int"))  # twice PARTITIONS rows at most
    rows = rows.join(links, (F.col("bucket") == F.col("b")) & (F.col("i") == F.col("first_i")) & (F.col("h") == F.col("first_h")), "left")
    own = F.struct(F.col("bucket"), F.lit(True).alias("own"))
    rows = rows.withColumn("place", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(False).alias("own"))))))
    rows = rows.select("place.bucket", "place.own", "i", "doc_id", "h", "text").repartition(count, "bucket")
    return rows.sortWithinPartitions("bucket", F.col("own").desc(), "i", "h")


_EDITED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _edit(first: str):
    """first: the text of the first row of all, which follows the last.

    Rows come in order; the one after a row is the next of its bucket, whether the bucket's own or not.  Only the last row
    of a batch waits for the next batch.
    """

    def results(rows: list[tuple], texts: list[str]) -> pa.RecordBatch:
        """rows: id and text of each; texts: the one that follows each."""
        mine = [t for _, t in rows]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(mine, texts, strict=True)]
        coded = [t.encode() for t in (*mine, *edited, *texts)]
        offs = np.r_[0, np.cumsum([len(t) for t in coded])].astype(np.int64)
        chain = [k + 1 < len(mine) and texts[k] is mine[k + 1] for k in range(len(mine))]  # that one's sketch is made already
        n = len(mine)
        alone = [2 * n + k for k in range(n) if not chain[k]]
        found = sketches(np.frombuffer(b"".join(coded[: 2 * n]), np.uint8), offs[: 2 * n + 1])
        rest = [coded[k] for k in alone]
        others = iter(sketches(np.frombuffer(b"".join(rest), np.uint8), np.r_[0, np.cumsum([len(t) for t in rest])].astype(np.int64)) if rest else [])
        now, changed = found[:n], found[n:]
        then = [now[k + 1] if chain[k] else next(others) for k in range(n)]
        return pa.RecordBatch.from_arrays(
            [
                kit.id_column(np.array([i for i, _ in rows], np.int64)), pa.array([len(t) for t in mine], pa.int64()), pa.array([sha256(t).hexdigest() for t in coded[n : 2 * n]], pa.string()),
                pa.array(map(text_of, now), pa.string()), pa.array(map(text_of, changed), pa.string()),
                pa.array([likeness(a, b) for a, b in zip(now, changed, strict=True)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(now, then, strict=True)], pa.float64()),
            ],
            schema=_EDITED,
        )

    def run(batches):
        waiting: tuple | None = None  # bucket, id and text of a row whose next one has not come
        for batch in batches:
            rows, texts = [], []
            for bucket, own, i, text in zip(batch["bucket"].to_pylist(), batch["own"].to_pylist(), batch["i"].to_pylist(), batch["text"].to_pylist(), strict=True):
                text = text or ""
                if waiting:
                    rows.append(waiting[1:])
                    texts.append(text if waiting[0] == bucket else first)
                waiting = (bucket, i, text) if own else None
            if rows:
                yield results(rows, texts)
        if waiting:
            yield results([waiting[1:]], [first])

    return run


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    first = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).limit(1).collect()
    first = (first[0]["text"] or "") if first else ""
    return with_next(docs).mapInArrow(kit.lean(_edit(first)), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
