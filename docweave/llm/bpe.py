"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

A scan cuts each text into pre-tokens and numbers them: a block of documents keeps, for each position, the rank of
its word among the block's distinct ones by frequency.  The distinct words of all blocks are dealt by value, each is encoded once
for the whole corpus, and its ids go back to the blocks that asked, where texts are reassembled by position.
Decoding joins ids with the token-byte table; the vocabulary's size is fixed, so that table is broadcast.

Blocks are named by their contents and place.  If a lost task is repeated over rows that come in another order, its
blocks have other names and the job ends with an error instead of mixing them up; files and checkpoints always come in
the same order.

Defined results: a null or empty text has no tokens, a blank one those of its white space; rows with equal or null ids
and repeated rows are encoded each for itself; a very long text is cut into pre-tokens by parts; extra columns are
ignored; an empty table gives an empty one; surrogates cannot occur in Spark strings; special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

BLOCK_BYTES, BUCKET_BYTES, TOKENIZE_BYTES, SLICE_WORDS, SLICE_IDS = 12 << 20, 16 << 20, 1 << 19, 1 << 18, 1 << 18
POSITIONS = -1

_ROW = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_ROW_DDL = "bucket long, block long, a binary, b binary, c binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@cache
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


class Vocabulary:
    """Ranks that make their encoder where they are used."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self._encoder = ranks, pattern, None

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern, "_encoder": None}

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        if self._encoder is None:
            import tiktoken

            self._encoder = tiktoken.Encoding("vocabulary", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return self._encoder._encode_single_piece(word)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens, and where each token's begin."""
        tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        return np.frombuffer(b"".join(tokens), np.uint8), np.r_[0, np.cumsum([len(t) for t in tokens])].astype(np.int64)


def _pretokens(find, text: str):
    """Lists of a text's pre-tokens; those of a long one come by parts."""
    if len(text) <= TOKENIZE_BYTES:
        yield find.findall(text)
        return
    matches = (m[0] for m in find.finditer(text))
    while part := list(islice(matches, SLICE_WORDS)):
        yield part


def _tokenize(pattern: str, buckets: int, block_bytes: int):
    """Blocks: a row of positions, and for each bucket a row of words with their numbers in the block."""

    def run(batches):
        from hashlib import blake2b

        from pyspark import TaskContext

        find = _pattern(pattern)
        partition, serial = TaskContext.get().partitionId(), 0

        def close():
            nonlocal found, counts, docs, size, serial
            block = int.from_bytes(seen.digest(), "little") >> 2
            yield from _block(block, found, counts, docs, buckets)
            found, counts, docs, size, serial = [], [], [], 0, serial + 1

        found, counts, docs, size = [], [], [], 0
        for batch in batches:
            ids = kit.long_ids(batch["doc_id"])
            raw, offs = kit.flat(batch["text"])
            raw = np.ascontiguousarray(raw)
            for i, j in kit.slices(offs, min(block_bytes, TOKENIZE_BYTES)):  # few tokens at a time are Python strings
                if not docs:
                    seen = blake2b(repr((partition, serial)).encode(), digest_size=8)
                seen.update(raw[offs[i] : offs[j]])
                seen.update(offs[i : j + 1] - offs[i])
                seen.update(ids[i:j])
                tokens, count = [], np.zeros(j - i, np.int64)
                for k, text in enumerate(batch["text"].slice(i, j - i).to_pylist()):
                    if text:
                        for own in _pretokens(find, text):
                            count[k] += len(own)
                            tokens += own
                            if len(tokens) >= SLICE_WORDS:
                                found.append(pa.array(tokens, pa.string()))
                                tokens = []
                found.append(pa.array(tokens, pa.string()))
                counts.append(count)
                docs.append(ids[i:j])
                size += int(offs[j] - offs[i])
                del tokens
                if size >= block_bytes:
                    yield from close()
        if docs:
            yield from close()

    return run


def _block(block: int, found: list, counts: list, docs: list, buckets: int):
    """A block's rows: its positions, and its distinct words by bucket with their ranks."""
    coded = pa.concat_arrays(found).dictionary_encode()
    found.clear()
    numbers = np.asarray(coded.indices)
    frequent = np.argsort(-np.bincount(numbers, minlength=len(coded.dictionary)), kind="stable")
    rank = np.empty(len(frequent), np.int32)
    rank[frequent] = np.arange(len(frequent), dtype=np.int32)
    yield pa.record_batch([[POSITIONS - block], [block], [kit.pack_ranks(rank[numbers])], [np.concatenate(docs).tobytes()], [kit.narrow(np.concatenate(counts).astype(np.uint64))]], schema=_ROW)
    chars, at = kit.flat(coded.dictionary.take(pa.array(frequent)))
    del coded, numbers
    bucket = kit.bucket_of(_word_hashes(chars, at), buckets)
    order = np.argsort(bucket, kind="stable")
    heads, cuts = np.unique(bucket[order], return_index=True)
    rows = []
    for b, own in zip(heads.tolist(), np.split(order, cuts[1:]), strict=True):
        text, size = _gather(chars, at, own)
        rows.append((b, block, kit.squeeze(kit.narrow(np.diff(own, prepend=0).astype(np.uint64))), kit.squeeze(text.tobytes()), kit.squeeze(kit.narrow(size.astype(np.uint64)))))
    if rows:
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)


def _word_hashes(chars: np.ndarray, at: np.ndarray) -> np.ndarray:
    words = kit.Words.__new__(kit.Words)
    words.raw, words.starts, words.ends = chars, at[:-1], at[1:]
    return words.hashes()


def _gather(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items at these numbers of a flat table, one after the other, and their sizes."""
    size = at[which + 1] - at[which]
    done = np.r_[0, np.cumsum(size)]
    small = np.int32 if max(len(flat), done[-1]) < 1 << 31 else np.int64
    place = np.repeat((at[which] - done[:-1]).astype(small), size)
    place += np.arange(done[-1], dtype=small)
    return flat[place], size


def _encode(vocabulary):
    """Encodes each distinct word of a bucket once; rows of positions pass."""

    def run(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            return table
        blobs, sizes = [kit.unsqueeze(x)[0] for x in table["b"].to_pylist()], [kit.widen(kit.unsqueeze(x)[0]).astype(np.int64) for x in table["c"].to_pylist()]
        words = pa.concat_arrays([kit.text_column(np.frombuffer(x, np.uint8), np.r_[0, np.cumsum(n)], pa.binary()) for x, n in zip(blobs, sizes, strict=True)]).dictionary_encode()
        encode = vocabulary.value.encode_word
        ids = [encode(w) for w in words.dictionary.to_pylist()]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for own in ids for x in own), np.int64, int(count.sum()))
        at, which = np.r_[0, np.cumsum(count)], np.asarray(words.indices)
        b, c, begin = [], [], 0
        for n in map(len, sizes):
            own, size = _gather(flat, at, which[begin : begin + n])
            begin += n
            b.append(kit.squeeze(kit.narrow(own.astype(np.uint64))))
            c.append(kit.squeeze(kit.narrow(size.astype(np.uint64))))
        return pa.Table.from_arrays([table["bucket"], table["block"], table["a"], pa.array(b, pa.binary()), pa.array(c, pa.binary())], schema=_ROW)

    return run


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.field("element", pa.int32())))])


def _reassemble(finish):
    """Ids of a block's texts by position; finish: what becomes of some texts' ids, a table of doc_id and ids."""

    def run(table: pa.Table) -> pa.Table:
        bucket = np.asarray(table["bucket"])
        places = np.flatnonzero(bucket < 0)
        if not len(places):
            raise RuntimeError("a block was cut anew while its words were encoded: write docs to files or checkpoint them first")
        place = int(places[0])
        numbers = kit.unpack_ranks(table["a"][place].as_py()).astype(np.int32)
        docs = np.frombuffer(table["b"][place].as_py(), np.int64)
        count = kit.widen(table["c"][place].as_py()).astype(np.int64)
        which, flat, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k in np.flatnonzero(bucket >= 0).tolist():
            a, b, c = (kit.widen(kit.unsqueeze(table[x][k].as_py())[0]) for x in "abc")
            which.append(np.cumsum(a.astype(np.int64)))
            flat.append(b.astype(np.int32))
            sizes.append(c.astype(np.int64))
        which, flat, sizes = np.concatenate(which), np.concatenate(flat), np.concatenate(sizes)
        if len(which) != numbers.max(initial=-1) + 1:
            raise RuntimeError("a block was cut anew while its words were encoded: write docs to files or checkpoint them first")
        order = np.argsort(which)  # the block's words by number
        words, _ = _gather(flat, np.r_[0, np.cumsum(sizes)], order)
        begin = np.r_[0, np.cumsum(sizes[order])]
        del flat, which
        at, out = np.r_[0, np.cumsum(count)], []
        for i, j in kit.slices(at, SLICE_WORDS):
            ids, size = _gather(words, begin, numbers[at[i] : at[j]])
            offs = np.r_[0, np.cumsum(size)][at[i : j + 1] - at[i]]
            lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids)).cast(_IDS.field("ids").type)
            out.append(finish(pa.Table.from_arrays([kit.id_column(docs[i:j]), lists], schema=_IDS)))
        return pa.concat_tables(out)

    return run


def vocabulary_of(spark, path: str, pattern: str):
    return spark.sparkContext.broadcast(Vocabulary(read_ranks(path), pattern))


def encode(docs: DataFrame, vocabulary, block_bytes: int = BLOCK_BYTES, finish=None, types: str = "doc_id long, ids array<int>") -> DataFrame:
    """doc_id and ids (array of int) of each row; vocabulary: from vocabulary_of().

    finish, with its result's types, takes tables of doc_id and ids where they are made, for what needs no more than
    that; it saves a pass of all ids between processes.
    """
    spark = docs.sparkSession
    rows = kit.check_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    buckets = kit.pieces(kit.volume(rows)[1], BUCKET_BYTES, spark)
    dealt = rows.mapInArrow(kit.lean(_tokenize(vocabulary.value.pattern, buckets, block_bytes)), _ROW_DDL)
    encoded = dealt.groupBy("bucket").applyInArrow(kit.lean(_encode(vocabulary)), _ROW_DDL)
    return encoded.groupBy("block").applyInArrow(kit.lean(_reassemble(finish or (lambda table: table))), types)


def _decoded(ids: np.ndarray, offs: np.ndarray, table: tuple[np.ndarray, np.ndarray]):
    """Bytes of each text's ids: for some texts at a time the first and last, the bytes, and where each begins."""
    for i, j in kit.slices(offs, SLICE_IDS):
        text, size = _gather(*table, ids[offs[i] : offs[j]])
        yield i, j, text, np.r_[0, np.cumsum(size)][offs[i : j + 1] - offs[i]]


def _decode(vocabulary):
    def run(batches):
        table = vocabulary.value.table()
        for batch in batches:
            for i, j, text, where in _decoded(*_lists(batch["ids"]), table):
                rest = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, kit.text_column(text, where, pa.binary())], names=[*batch.schema.names, "decoded"])

    return run


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    offs = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values)[offs[0] : offs[-1]], offs - offs[0]


def decode(encoded: DataFrame, vocabulary) -> DataFrame:
    """encoded with the column decoded (binary): the bytes of its ids."""
    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(kit.lean(_decode(vocabulary)), kit.with_fields(encoded, decoded="binary"))


def _digests(vocabulary):
    """Digests of the ids, as decimals with one space between, and of the bytes that they decode to."""
    tables: list = []

    def run(table: pa.Table) -> pa.Table:
        from hashlib import sha256

        if not tables:
            names = [b"%d " % i for i in range(len(vocabulary.value.table()[1]) - 1)]
            tables.extend([(np.frombuffer(b"".join(names), np.uint8), np.r_[0, np.cumsum([len(x) for x in names])]), vocabulary.value.table()])
        ids, offs = _lists(table["ids"].combine_chunks())
        digests = []
        for own, cut in zip(tables, (1, 0), strict=True):
            digests.append([])
            for _, _, text, where in _decoded(ids, offs, own):
                data, where = memoryview(text), where.tolist()
                digests[-1] += [sha256(data[a : max(a, b - cut)]).hexdigest() for a, b in zip(where[:-1], where[1:], strict=True)]
        return pa.table({"doc_id": table["doc_id"], "n_tokens": np.diff(offs), "ids_sha256": pa.array(digests[0], pa.string()), "decoded_sha256": pa.array(digests[1], pa.string())})

    return run


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = vocabulary_of(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, vocabulary, finish=_digests(vocabulary), types="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
