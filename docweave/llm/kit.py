"""Array building blocks that the training-data operators share.

Texts reach these functions as Arrow string columns and are worked on as one flat byte array with document
offsets, so that no Python object is made for a word.  A word is a maximal run of bytes other than the six
ASCII white space bytes (the pattern ``[^\\x20\\x09-\\x0D]+``); UTF-8 never uses those bytes inside a character.

Rows are dealt between tasks as packed arrays: one row for each (origin, bucket) with a binary column that holds
the keys, instead of one row for each key.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into arrays at a time.
SLICE = 1 << 21
#: Stands for a null id, after all others.
NO_ID = np.iinfo(np.int64).max

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

GRAM_BASE, SECOND_BASE = 0xD1342543DE82EF95, 0xA24BAED4963EE407


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Even buckets of mixed keys, in the order of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def text_column(raw: np.ndarray, offs: np.ndarray, kind=None) -> pa.Array:
    """The reverse of flat()."""
    if len(raw) >= 1 << 31:
        raise ValueError("over 2 GB of text in one piece: take smaller pieces")
    return pa.Array.from_buffers(kind or pa.string(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def slices(offs: np.ndarray, limit: int = SLICE):
    """Ranges of documents of about so many bytes, one document at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


class Words:
    """Words of some documents: their bytes from starts to ends, and where each document's words begin in them."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        self.raw, self.offs = raw, offs
        solid = ~SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offs] = True
        first, last = solid.copy(), solid.copy()
        if len(raw):
            first[1:] &= ~solid[:-1] | edge[1:-1]
            last[:-1] &= ~solid[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.starts, offs)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def doc(self) -> np.ndarray:
        """Each word's document."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def hashes(self, fold: bool = False) -> np.ndarray:
        """64-bit hashes of the words; fold: with A-Z in lower case.

        Each eight bytes of a word are mixed with their place before they are added up.  (A polynomial modulo 2^64 would
        give equal hashes to regular words, as those of Thue and Morse, whatever its base.)
        """
        out = np.empty(len(self), np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + SLICE, "right")))
            lo, hi = int(self.starts[i]), int(self.ends[j - 1])
            out[i:j] = _piece_sums(self.raw[lo:hi], self.starts[i:j] - lo, self.ends[i:j] - lo, fold)
            i = j
        return out


#: Masks of the lowest 0 to 8 bytes.
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _piece_sums(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    padded = np.zeros(len(part) + 8, np.uint8)
    padded[: len(part)] = FOLD[part] if fold else part
    eight = np.ndarray(len(part) + 1, "<u8", padded, strides=(1,))  # the bytes from each place on
    size = ends - starts
    out = mix((eight[starts] & LOW_BYTES[np.minimum(size, 8)]) + np.uint64(GRAM_BASE) * size.astype(np.uint64))
    long = np.flatnonzero(size > 8)
    for step in range(0, len(long), 1 << 16):  # a single word may be huge: its pieces are taken by parts
        own = long[step : step + (1 << 16)]
        more = (size[own] - 1) >> 3
        if more.max() > 1 << 16:
            for w in own.tolist():
                for at in range(8, int(size[w]), SLICE):
                    where = np.arange(at, min(at + SLICE, int(size[w])), 8)
                    out[w : w + 1] += _pieces(eight, starts[w] + where, size[w] - where, where >> 3).sum(dtype=np.uint64, keepdims=True)
            continue
        begin = np.cumsum(more) - more
        number = np.arange(more.sum()) - np.repeat(begin, more) + 1
        where = np.repeat(starts[own], more) + 8 * number
        out[own] += np.add.reduceat(_pieces(eight, where, np.repeat(ends[own], more) - where, number), begin)
    return mix(out)


def _pieces(eight: np.ndarray, where: np.ndarray, left: np.ndarray, number: np.ndarray) -> np.ndarray:
    return mix((eight[where] & LOW_BYTES[np.minimum(left, 8)]) ^ (np.uint64(SECOND_BASE) * number.astype(np.uint64)))


def _joined(x: np.ndarray, y: np.ndarray, base: int) -> np.ndarray:
    """Hashes of x followed by y.  The shift keeps the whole from being a polynomial modulo 2^64; every joint has a base of
    its own, or words could change places."""
    out = x >> np.uint64(29)
    out ^= x
    out *= np.uint64(base)
    out += y
    return out


def gram_hashes(word: np.ndarray, k: int, base: int = GRAM_BASE) -> np.ndarray:
    """Hash of the k words from each position on, by doubling; positions without k words are left out at the end."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, step = np.empty(n, np.uint64), 1 << 19
    for i in range(0, n, step):
        power, span = word[i : i + step + k - 1], 1  # hashes of `span` words, doubled in turn
        m = len(power) - k + 1
        whole, done = None, 0
        while True:
            if k & span:  # the words of this power of two come after those that are done
                own = power[done : done + m]
                whole = own.copy() if whole is None else _joined(whole, own, pow(base, 2 * span.bit_length(), 1 << 64))
                done += span
            span *= 2
            if span > k:
                break
            power = _joined(power[: len(power) - span // 2], power[span // 2 :], pow(base, 2 * span.bit_length() + 1, 1 << 64))
        out[i : i + m] = mix(whole + np.uint64(k))
    return out


def inside(at: np.ndarray, k: int) -> np.ndarray:
    """Positions from which k words of one document follow; at: where each document's words begin."""
    count = np.maximum(np.diff(at) - k + 1, 0)
    return np.repeat(at[:-1] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())


def long_ids(column) -> np.ndarray:
    """Ids as 64-bit numbers, NO_ID for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(pc.fill_null(column.cast(pa.int64()), int(NO_ID)))


def id_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def distinct(x: np.ndarray) -> np.ndarray:
    """Ascending distinct numbers, by a sort (np.unique without further results takes a slower hash table)."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def narrow(x: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes as the largest needs: first how many, then all lowest bytes, all next ones, ..."""
    most = int(x.max()) if len(x) else 0
    size = max(1, (most.bit_length() + 7) // 8)
    return bytes([size]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def widen(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : blob[0]] = planes.T
    return out.view("<u8").ravel()


def squeeze(*parts: bytes) -> bytes:
    """Parts in one value, each entropy-coded by itself."""
    import struct

    import zstandard

    coder = zstandard.ZstdCompressor(level=3)
    coded = [coder.compress(p) for p in parts]
    return struct.pack(f"<{len(parts) + 1}Q", len(parts), *map(len, coded)) + b"".join(coded)


def unsqueeze(blob: bytes) -> list[bytes]:
    import struct

    import zstandard

    coder = zstandard.ZstdDecompressor()
    n = struct.unpack_from("<Q", blob)[0]
    sizes, at, out = struct.unpack_from(f"<{n}Q", blob, 8), 8 * (n + 1), []
    for size in sizes:
        out.append(coder.decompress(blob[at : at + size]))
        at += size
    return out


def pack_ranks(x: np.ndarray) -> bytes:
    """Numbers of which small ones are the most frequent: a byte for each below 255, the others apart."""
    large = x >= 255
    head = np.where(large, 255, x).astype(np.uint8)
    rest = narrow(x[large].astype(np.uint64) - np.uint64(255))
    each = len(rest) // rest[0] if large.any() else 0
    return squeeze(head.tobytes(), rest[:1], *(rest[1 + k * each : 1 + (k + 1) * each] for k in range(rest[0] if each else 0)))


def unpack_ranks(blob: bytes) -> np.ndarray:
    head, *rest = unsqueeze(blob)
    out = np.frombuffer(head, np.uint8).astype(np.int64)
    large = out == 255
    if large.any():
        out[large] += widen(b"".join(rest)).astype(np.int64)
    return out


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return narrow(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(widen(blob), dtype=np.uint64)


def blocks(batches, limit: int, column: str = "text", rows: int = 1 << 16):
    """Tables of the rows as they come, each closed by the row that brings it to so many bytes of text or so many rows;
    where a batch ends makes no difference."""
    held, size, count = [], 0, 0
    for batch in batches:
        _, offs = flat(batch[column])
        i, n = 0, batch.num_rows
        while i < n:
            j = int(np.searchsorted(offs, offs[i] + limit - size, "left"))
            j = min(max(j, i + 1), i + rows - count, n)
            held.append(batch.slice(i, j - i))
            size, count, i = size + int(offs[j] - offs[i]), count + j - i, j
            if size >= limit or count >= rows:
                yield pa.Table.from_batches(held)
                held, size, count = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def frozen(table: pa.Table) -> bytes:
    """A table as one entropy-coded value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def thawed(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def name_of(table: pa.Table, *place: int) -> int:
    """A number for a table's contents and place; equal ones get equal numbers, however they are laid out in memory."""
    from hashlib import blake2b

    seen = blake2b(repr(place).encode(), digest_size=8)
    for column in table.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            raw, offs = flat(column)
            seen.update(np.ascontiguousarray(raw))
            seen.update(offs)
            seen.update(np.packbits(np.asarray(pc.is_null(column.combine_chunks()))))
        else:
            seen.update(long_ids(column))
    return int.from_bytes(seen.digest(), "little", signed=True)


#: Bytes of an Arrow batch between the JVM and Python: long texts make small batches.
BATCH_BYTES = 4 << 20


def bounded_batches(spark) -> None:
    """Long texts must not make large batches; every operator of this subpackage asks for it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trim() -> None:
    """Gives freed memory back to the system: a Python worker outlives its task and others share its executor."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """run, a function of one or two arguments that returns a table or yields batches, with trim() after it."""
    import inspect

    def ended(out):
        if not inspect.isgenerator(out):
            trim()
            return out

        def each():
            try:
                yield from out
            finally:
                trim()

        return each()

    if run.__code__.co_argcount == 2:
        return lambda a, b: ended(run(a, b))
    return lambda a: ended(run(a))


def small(df, most: int = 500_000):
    """df to be broadcast if it has at most so many rows, by a count; else as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= most else df


def volume(docs, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of text of a table."""
    from pyspark.sql import functions as F

    bounded_batches(docs.sparkSession)
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text))).alias("b")).first()
    return row["n"], row["b"] or 0


def parts(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark, name: str) -> str:
    """A fresh folder in the one that all executors share; where spark.checkpoint.dir is unset and all runs in one process,
    as in tests, one of this machine."""
    import uuid

    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        found = sc._jsc.sc().getCheckpointDir()
        top = found.get() if found.isDefined() else None
    if not top:
        import re
        import tempfile

        if not re.match(r"local(\[|$)", sc.master):  # a folder of one machine is of no use to others
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="docweave-"))
        top = sc._jsc.sc().getCheckpointDir().get()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ensure_checkpoint(spark) -> None:
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark, "checkpoint"))


def settled(df):
    """df, written once to the shared folder and read from there by all that follows."""
    ensure_checkpoint(df.sparkSession)
    return df.checkpoint()


#: Partitions that pieces are dealt to at most; a partition then has several pieces, one after the other.
PARTITIONS = 50_000


def piece_of(pieces: int, *columns: str):
    """The piece of a row; rows with null or equal ids are dealt by their texts too."""
    from pyspark.sql import functions as F

    return F.pmod(F.xxhash64(*columns), F.lit(pieces)).cast("int")


def pieces(total: int, each: int, spark) -> int:
    """In how many pieces of about `each` bytes to deal: grows with the input, the session's partitions at least."""
    return max(parts(spark), math.ceil(total / each))


def packed(df, *add: str):
    """df's columns in one struct `row`, without those that an operator adds; columns then cannot clash.

    Gives the columns' names too.  Of equal names (in any case) the operator's own column stays.
    """
    from pyspark.sql import functions as F

    own = {a.lower() for a in add}
    keep = [c for c in df.columns if c.lower() not in own]
    return df.select(F.struct(*[df[c] for c in keep]).alias("row")), keep


def with_fields(df, **types: str):
    """df's schema with further columns."""
    from pyspark.sql.types import StructType

    return StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"{n} {t}" for n, t in types.items())).fields])


def check_columns(df, *names: str):
    """Only the named columns, whatever else the table has."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[df[n] for n in names])
