"""Substring deduplication by relative Lempel-Ziv parsing over an index that is dealt into blocks.

The reference of a document is every document with a smaller id.  The index of its k-word phrases is cut into blocks
by a hash that is independent of the phrase's own; a block knows where each of its phrases stands first: the smallest
document that has it and the word at which it begins there.  Documents are dealt into chunks.  A chunk asks each block
about each of its distinct phrases once (so copies inside a chunk never travel) and gets the places of those that occur
earlier.  Each document is then parsed greedily: a factor starts at the first position that has a place, and is
extended word by word as long as the next position's place is the next word of the same reference document.  At its
end the next position is looked at: if it has another place, the next factor starts there, and as it overlaps the last
one by k - 1 words no window at the boundary is lost; if it has none, a boundary of a duplicate span is reached.  So a
factor is a copy of the reference's words from `ref_start` on, is k words long at least, and a word goes if a factor
covers it.

Every document meets the whole index by way of its phrases, instead of every block of reference text, which would be a
join of all documents with all documents.  Phrases are compared by a 64-bit hash inside a block that was chosen by
another hash, so by 64 + log2(blocks) bits; the number of blocks grows with the input.

Defined results: a null, empty or blank text has no words; a row with a null id comes after all others (it never removes
anything from rows with ids); rows with the same id, or without one, never remove each other's words, and `ref_start`
then is a place in one of them; of equal phrases in one document the first is the place; very long texts are
held whole by the task that has their chunk (2 GB at most); an empty table gives an empty one; extra columns are
ignored, or returned if they are asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

CHUNK_BYTES, BLOCK_BYTES = 4 << 20, 8 << 20


class _Chunk:
    """A chunk's documents by id, their phrases, and the questions that it asks about them."""

    def __init__(self, table: pa.Table, k: int, blocks: int):
        ids = kit.long_ids(table["doc_id"])
        order = np.lexsort((np.asarray(table["row"].combine_chunks()), ids))
        table = table.take(pa.array(order))
        self.ids, self.table = ids[order], table
        raw, offs = kit.flat(table["text"])
        self.words = w = kit.Words(raw, offs)
        hashes = w.hashes()
        self.pos = kit.inside(w.at, k)
        grams = kit.gram_hashes(hashes, k)[self.pos] if len(self.pos) else np.zeros(0, np.uint64)
        second = kit.gram_hashes(hashes, k, kit.SECOND_BASE)[self.pos] if len(self.pos) else np.zeros(0, np.uint64)
        del hashes
        self.doc = np.searchsorted(w.at, self.pos, "right") - 1
        order = np.argsort(grams, kind="stable")
        ordered = grams[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]] if len(ordered) else np.zeros(0, bool)
        self.which = np.empty(len(order), np.int32)  # each phrase's number among the distinct ones
        self.which[order] = np.cumsum(new) - 1
        del ordered
        first = order[new]  # the first place of each: its smallest id in this chunk
        self.keys, self.first_doc = grams[first], self.doc[first]
        self.first_at = self.pos[first] - w.at[self.first_doc]
        block = kit.bucket_of(second[first], blocks).astype(np.int64)
        self.asked = np.lexsort((first, block))
        block = block[self.asked]
        head = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
        ends = np.r_[head, len(block)][1:]
        self.blocks = {b: (i, j) for b, i, j in zip(block[head].tolist(), head.tolist(), ends.tolist(), strict=True)}

    def of(self, block: int) -> np.ndarray:
        """The distinct phrases that a block is asked about."""
        return self.asked[slice(*self.blocks[block])]


def _ask(k: int, blocks: int):
    def ask(table: pa.Table) -> pa.Table:
        c = _Chunk(table, k, blocks)
        rows: dict[str, list] = {"block": [], "chunk": [], "keys": [], "docs": [], "counts": [], "places": []}
        chunk = table["chunk"][0].as_py()
        for b in c.blocks:
            own = c.of(b)
            docs, counts = np.unique(c.ids[c.first_doc[own]], return_counts=True)
            rows["block"].append(b)
            rows["chunk"].append(chunk)
            rows["keys"].append(c.keys[own].tobytes())
            rows["docs"].append(int(docs[0]).to_bytes(8, "little", signed=True) + kit.narrow(np.diff(docs).astype(np.uint64)))
            rows["counts"].append(kit.narrow(counts.astype(np.uint64)))
            rows["places"].append(_steps(c.first_at[own]))
        return pa.table(rows, schema=_ASK)

    return ask


_ASK = pa.schema([("block", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int32()), ("block", pa.int32()), ("found", pa.binary()), ("refs", pa.binary()), ("codes", pa.binary()), ("places", pa.binary())])


def _steps(x: np.ndarray) -> bytes:
    """Numbers that mostly ascend by little, as differences of either sign."""
    step = np.diff(x, prepend=0)
    return kit.squeeze(kit.narrow(((step << 1) ^ (step >> 63)).astype(np.uint64)))


def _from_steps(blob: bytes) -> np.ndarray:
    x = kit.widen(kit.unsqueeze(blob)[0]).astype(np.int64)
    return np.cumsum((x >> 1) ^ -(x & 1))


def _docs_of(docs: bytes, counts: bytes) -> np.ndarray:
    first = int.from_bytes(docs[:8], "little", signed=True)
    ids = first + np.r_[0, np.cumsum(kit.widen(docs[8:]).astype(np.int64))]
    return np.repeat(ids, kit.widen(counts).astype(np.int64))


def _answer(table: pa.Table) -> pa.Table:
    """For each question: is there a smaller id than the chunk's own, which is the smallest, and where the phrase is in it."""
    chunks, block = table["chunk"].to_pylist(), table["block"][0].as_py()
    docs = [_docs_of(d, n) for d, n in zip(table["docs"].to_pylist(), table["counts"].to_pylist(), strict=True)]
    key, doc = np.concatenate([np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]), np.concatenate(docs)
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[starts, len(key)])
    del key
    doc = doc[order]
    least = np.repeat(np.minimum.reduceat(doc, starts), size)
    place = np.concatenate([_from_steps(x) for x in table["places"].to_pylist()])[order]
    place[doc != least] = kit.NO_ID
    place = np.repeat(np.minimum.reduceat(place, starts), size)
    best, where = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    best[order], where[order] = least, place
    del least, place, doc
    rows: dict[str, list] = {n: [] for n in _ANSWER.names}
    at = 0
    for c, d in zip(chunks, docs, strict=True):
        mine, from_ = best[at : at + len(d)], where[at : at + len(d)]
        at += len(d)
        found = mine < d
        if found.any():
            refs, codes = np.unique(mine[found], return_inverse=True)
            rows["chunk"].append(c)
            rows["block"].append(block)
            rows["found"].append(np.packbits(found).tobytes())
            rows["refs"].append(refs.astype(np.int64).tobytes())
            rows["codes"].append(kit.narrow(codes.astype(np.uint64)))
            rows["places"].append(_steps(from_[found]))
    return pa.table(rows, schema=_ANSWER)


def factors(pos: np.ndarray, doc: np.ndarray, ref: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy parse of the positions that have a place: the first and last position of each factor."""
    if not len(pos):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    extended = (pos[1:] == pos[:-1] + 1) & (doc[1:] == doc[:-1]) & (ref[1:] == ref[:-1]) & (place[1:] == place[:-1] + 1)
    head = np.flatnonzero(np.r_[True, ~extended])
    return head, np.r_[head[1:], len(pos)] - 1


def _finish(k: int, blocks: int, layout: bool, extra: list[str]):
    def finish(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _result(extra, docs.schema).empty_table()
        c = _Chunk(docs, k, blocks)
        ref, place = c.ids[c.first_doc], c.first_at.copy()  # of each distinct phrase
        for row in range(answers.num_rows):
            b, found, refs, codes, places = (answers[n][row].as_py() for n in ("block", "found", "refs", "codes", "places"))
            own = c.of(b)
            hit = own[np.unpackbits(np.frombuffer(found, np.uint8), count=len(own)).astype(bool)]
            ref[hit] = np.frombuffer(refs, np.int64)[kit.widen(codes).astype(np.int64)]
            place[hit] = _from_steps(places)
        hit = np.flatnonzero(ref[c.which] < c.ids[c.doc])
        pos, doc, ref, place = c.pos[hit], c.doc[hit], ref[c.which[hit]], place[c.which[hit]]
        head, tail = factors(pos, doc, ref, place)
        f_doc, f_from, f_to, f_ref, f_place = doc[head], pos[head], pos[tail] + k, ref[head], place[head]
        del pos, doc, ref, place, hit
        w = c.words
        cover = np.zeros(len(w) + 1, np.int32)  # factors that meet or overlap at a boundary make one span
        np.add.at(cover, f_from, 1)
        np.add.at(cover, f_to, -1)
        kept = np.cumsum(cover[:-1]) == 0
        keep, offs = _kept_bytes(w, kept, layout)
        n_words = np.diff(w.at)
        gone = np.r_[0, np.cumsum(~kept)]
        cuts = np.searchsorted(f_doc, np.arange(len(n_words) + 1))
        spans = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(f_from - w.at[f_doc]), pa.array(f_to - f_from), pa.array(f_ref), pa.array(f_place)], ["start", "words", "ref", "ref_start"]))
        columns = {"doc_id": kit.id_column(c.ids), "n_words": pa.array(n_words), "n_removed": pa.array(gone[w.at[1:]] - gone[w.at[:-1]]), "kept": kit.text_column(keep, offs), "spans": spans}
        columns |= {n: c.table[n] for n in extra}
        schema = _result(extra, docs.schema)
        return pa.table([columns[f.name].cast(f.type) for f in schema], schema=schema)

    return finish


def _kept_bytes(w: kit.Words, kept: np.ndarray, layout: bool) -> tuple[np.ndarray, np.ndarray]:
    """The kept words' bytes, document by document: each after one space, or with the white space that followed it."""
    raw = w.raw.copy() if not layout else w.raw
    n = len(raw)
    step = np.zeros(n + 1, np.int8)
    doc_end = np.repeat(w.offs[1:], np.diff(w.at))
    if layout:  # a word goes with the white space up to the next word; what stands before the first word stays
        until = np.minimum(np.r_[w.starts[1:], n], doc_end) if len(w) else w.ends
        take = np.ones(n, bool)
        lost = ~kept
        np.add.at(step, w.starts[lost], 1)
        np.add.at(step, until[lost], -1)
        take = np.cumsum(step[:-1], dtype=np.int8) == 0
    else:
        last = np.zeros(len(w), bool)  # a document's last kept word has no space after it
        where = np.flatnonzero(kept)
        doc = np.searchsorted(w.at, where, "right") - 1
        if len(where):
            last[where[np.r_[doc[1:] != doc[:-1], True]]] = True
        raw[w.ends[kept & ~last]] = 0x20
        np.add.at(step, w.starts[kept], 1)
        np.add.at(step, w.ends[kept] + ~last[kept], -1)
        take = np.cumsum(step[:-1], dtype=np.int8) > 0
    kept_words = raw[take]
    before = np.cumsum(take, dtype=np.int32 if len(take) < 1 << 31 else np.int64)
    return kept_words, np.where(w.offs > 0, before[np.maximum(w.offs, 1) - 1], 0) if len(take) else w.offs


def _result(extra: list[str], schema: pa.Schema) -> pa.Schema:
    span = pa.list_(pa.field("element", pa.struct([("start", pa.int64()), ("words", pa.int64()), ("ref", pa.int64()), ("ref_start", pa.int64())])))
    return pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", span), *[(n, schema.field(n).type) for n in extra]])


def remove_repeats(docs: DataFrame, k: int = 13, layout: bool = False, extra: tuple[str, ...] = (), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Documents without the words that a k-word phrase of a document with a smaller id covers.

    Returns doc_id, n_words, n_removed, kept (the text that stays: its words joined by one space, or with
    layout=True with the white space that they had), spans (factors: start and length in words, reference id and the
    word at which the copied words begin there) and the extra columns.
    """
    spark = docs.sparkSession
    _, size = kit.volume(docs)
    chunks, blocks = kit.pieces(size, chunk_bytes, spark), kit.pieces(size, BLOCK_BYTES, spark)
    rows = kit.check_columns(docs, "doc_id", "text", *extra).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.select(kit.piece_of(chunks, "doc_id", "text").alias("chunk"), F.xxhash64("text").alias("row"), *rows.columns).repartition(min(chunks, kit.PARTITIONS), "chunk")
    asks = rows.groupBy("chunk").applyInArrow(kit.lean(_ask(k, blocks)), "block int, chunk int, keys binary, docs binary, counts binary, places binary")
    answers = asks.groupBy("block").applyInArrow(kit.lean(_answer), "chunk int, block int, found binary, refs binary, codes binary, places binary")
    kinds = dict(rows.dtypes)
    out = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start: long, words: long, ref: long, ref_start: long>>" + "".join(f", `{n}` {kinds[n]}" for n in extra)
    finish = _finish(k, blocks, layout, list(extra))
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(kit.lean(finish), out)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
