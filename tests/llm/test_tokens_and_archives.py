import gzip
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from docweave.llm import bpe, fingerprints, jpeg, kit, media, warc

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def vocabulary(spark):
    return bpe.vocabulary_of(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_bpe_is_the_librarys(odd, odd_rows, vocabulary):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.value.ranks, special_tokens={})
    out = bpe.decode(bpe.encode(odd, vocabulary, block_bytes=5000), vocabulary).collect()
    expected = Counter((r[0], tuple(enc.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in odd_rows)
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in out) == expected


def test_bpe_of_an_empty_table(empty, vocabulary):
    assert bpe.decode(bpe.encode(empty, vocabulary), vocabulary).count() == 0


def test_op1_gives_the_contract(spark, odd, odd_rows, vocabulary):
    """The query's own columns, over a table with odd rows, as the library and hashlib give them."""
    odd.write.mode("overwrite").parquet(folder := kit.shared_folder(spark, "docs") + "/documents.parquet")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.value.ranks, special_tokens={})
    expected = Counter()
    for r in odd_rows:
        ids = enc.encode_ordinary(r[1] or "")
        expected[r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    got = bpe.op1_bpe(spark, folder.removesuffix("/documents.parquet")).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == expected


def test_long_texts_are_cut_alike_by_parts(monkeypatch):
    import regex

    find = regex.compile(P.PATTERN)
    text = "It's 12345 long-ish \n\n words é\u4e2d and  spaces " * 50
    whole = find.findall(text)
    monkeypatch.setattr(bpe, "TOKENIZE_BYTES", 100)
    monkeypatch.setattr(bpe, "SLICE_WORDS", 7)
    parts = list(bpe._pretokens(find, text))
    assert max(map(len, parts)) == 7 and [t for p in parts for t in p] == whole


def test_blocks_that_were_cut_anew_end_the_job(vocabulary):
    import pyarrow as pa

    found, counts, docs = [pa.array(["a", "b", "a"])], [np.array([3])], [np.array([1])]
    rows = pa.Table.from_batches(list(bpe._block(9, found, counts, docs, 4)))
    finish = bpe._reassemble(lambda table: table)
    with pytest.raises(RuntimeError):
        finish(rows.slice(0, 1))
    with pytest.raises(RuntimeError):
        finish(rows.slice(1))


def test_packing():
    x = np.array([0, 5, 254, 255, 256, 70_000, 3], np.int64)
    assert kit.unpack_ranks(kit.pack_ranks(x)).tolist() == x.tolist()
    assert kit.unpack_ranks(kit.pack_ranks(x[:0])).tolist() == []
    keys = np.array([3, 3, 9, 2**63, 2**64 - 1], np.uint64)
    assert kit.unpack_sorted(kit.pack_sorted(keys)).tolist() == keys.tolist()


def pages(spark):
    rows = [(3, "u", "x" * 150), (1, "v v", "x" * 150), (2, None, None), (4, "w", "y" * 50), (5, "w", "y" * 50), (None, "n", "x" * 150), (6, "z", "é" * 80), (6, "z", "é" * 80), (7, "m", "\x1f\x8b\x08" * 60), (8, "r", "WARC/1.1\r\n\r\n" * 20)]
    return rows, spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("split", [1, 13, 100, 1 << 20])
def test_warc_round_trip(spark, split):
    rows, df = pages(spark)
    path = kit.shared_folder(spark, "warc")
    warc.write_warc(df, path)
    got = warc.read_warc(spark, path, split_bytes=split).collect()
    first = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    expected = Counter()
    for i, _, h in rows:
        body = (h or "").encode()
        own = first.get(h) if len(body) >= 100 else None
        revisit = own is not None and own != i
        expected[i, "revisit" if revisit else "response", own if revisit else None, hashlib.sha256(body).hexdigest(), len(body), None if revisit else body] += 1
    assert Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_digest"], r["payload_bytes"], None if r["payload"] is None else bytes(r["payload"])) for r in got) == expected


def test_warc_is_plain_gzip(spark):
    _, df = pages(spark)
    path = kit.shared_folder(spark, "warc")
    warc.write_warc(df.coalesce(1), path)
    files = spark.read.format("binaryFile").load(path).where("path like '%.gz'").collect()
    assert sum(gzip.decompress(bytes(f["content"])).count(b"WARC-Type:") for f in files) == 10
    false = b"\x1f\x8b\x08" + b"junk" * 10 + bytes(files[0]["content"])
    assert len(list(warc._records_in(lambda p, n: false[p : p + n], 0, len(false)))) == gzip.decompress(bytes(files[0]["content"])).count(b"WARC-Type:")


def test_warc_of_an_empty_table(spark):
    _, df = pages(spark)
    path = kit.shared_folder(spark, "warc")
    warc.write_warc(df.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


def test_media_round_trip():
    rng = np.random.default_rng(0)
    payloads = [bytes(64), bytes(range(256)), rng.integers(0, 256, 64 * 333).astype(np.uint8).tobytes(), b"text " * 640]
    stored = media.store(payloads)
    images, coefficients = media.load(stored)
    assert [media.payload_of(i, coefficients) for i in images] == payloads
    assert media.store(payloads[1:2]) == stored[1:2]
    for rgb, p in zip(media.tensors(images, coefficients), payloads, strict=True):
        rows, columns = media.shape_of(len(p) // 64)
        assert rgb.shape == (rows * 16, columns * 16, 3)


def test_inverse_transform():
    """A block with a DC coefficient alone is flat; the basis is orthonormal."""
    assert np.allclose(jpeg.BASIS @ jpeg.BASIS.T, np.eye(64), atol=1e-5)
    assert np.allclose(np.eye(64)[:1] * 8 @ jpeg.BASIS, 1.0)


def scalar_scans(blocks, restart, rng):
    """A plain encoder of one component with zero runs, runs of ended bands and refinement; bits as text."""
    tables = {k: jpeg.Table(*v) for k, v in jpeg.DEFAULT_TABLES.items()}

    def code(table, symbol):
        return format(int(table.code[symbol]), f"0{int(table.size[symbol])}b")

    def extra(v):
        n = abs(v).bit_length()
        return "" if not n else format(v if v > 0 else (1 << n) - 1 + v, f"0{n}b")

    def dc(own):
        out, before = "", 0
        for b in own:
            v = int(b[0]) >> 1
            d, before = v - before, v
            out += code(tables[0, 0], abs(d).bit_length()) + extra(d)
        return out

    def run_code(length):
        n = length.bit_length() - 1
        return code(tables[1, 0], n << 4) + (format(length - (1 << n), f"0{n}b") if n else "")

    def first(own, lo, hi):
        out, ended = "", 0
        for b in own:
            v = [int(np.sign(x)) * (abs(int(x)) >> 1) for x in b[lo : hi + 1]]
            zeros = 0
            for x in v:
                if not x:
                    zeros += 1
                    continue
                if ended:
                    out, ended = out + run_code(ended), 0
                while zeros > 15:
                    out, zeros = out + code(tables[1, 0], 0xF0), zeros - 16
                out += code(tables[1, 0], zeros << 4 | abs(x).bit_length()) + extra(x)
                zeros = 0
            if zeros:
                ended += 1
        return out + (run_code(ended) if ended else "")

    def refine(own, lo, hi):
        out, ended, waiting = "", 0, ""
        for b in own:
            v = [int(x) for x in b[lo : hi + 1]]
            last = max((p for p, x in enumerate(v) if abs(x) == 1), default=-1)
            zeros, bits = 0, ""
            for p, x in enumerate(v):
                if abs(x) > 1:
                    bits += str(abs(x) & 1)
                    continue
                if not x:
                    zeros += 1
                    if zeros == 16 and p < last:
                        if ended:
                            out, ended, waiting = out + run_code(ended) + waiting, 0, ""
                        out, zeros, bits = out + code(tables[1, 0], 0xF0) + bits, 0, ""
                    continue
                if ended:
                    out, ended, waiting = out + run_code(ended) + waiting, 0, ""
                out += code(tables[1, 0], zeros << 4 | 1) + ("1" if x > 0 else "0") + bits
                zeros, bits = 0, ""
            if zeros or bits:
                ended, waiting = ended + 1, waiting + bits
        return out + (run_code(ended) + waiting if ended else "")

    def packed(make, *band):
        parts = [blocks[i : i + restart] for i in range(0, len(blocks), restart)] if restart else [blocks]
        out = b""
        for k, own in enumerate(parts):
            bits = make(own, *band)
            bits += "1" * (-len(bits) % 8)
            out += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
            if k + 1 < len(parts):
                out += bytes([0xFF, 0xD0 + k % 8])
        return out

    return [((0, 0, 0, 1), packed(dc)), ((1, 9, 0, 1), packed(first, 1, 9)), ((10, 63, 0, 1), packed(first, 10, 63)), ((0, 0, 1, 0), packed(lambda own: "".join(str(int(b[0]) & 1) for b in own))), ((1, 63, 1, 0), packed(refine, 1, 63))]


@pytest.mark.parametrize("restart", [0, 3])
def test_decoder_against_a_plain_encoder(restart):
    rng = np.random.default_rng(restart)
    images, expected = [], []
    for rows, columns in ((2, 3), (1, 1), (4, 4)):
        n = rows * columns
        blocks = rng.integers(-9, 10, (n, 64)) * (rng.random((n, 64)) < rng.choice([0.02, 0.3, 0.9], (n, 1)))
        blocks[rng.random(n) < 0.3, 1:] = 0
        frame = b"\x08" + bytes([0, rows * 8, 0, columns * 8]) + bytes([1, 1, 0x11, 0])
        tables = b"".join(bytes([kind << 4 | k]) + bytes(c) + bytes(s) for (kind, k), (c, s) in jpeg.DEFAULT_TABLES.items())
        data = b"\xff\xd8" + jpeg._segment(0xDB, b"\0" + b"\x01" * 64) + jpeg._segment(0xC2, frame) + jpeg._segment(0xC4, tables) + jpeg._segment(0xDD, bytes([0, restart]))
        for (lo, hi, high, low), body in scalar_scans(blocks, restart, rng):
            data += jpeg._segment(0xDA, bytes([1, 1, 0, lo, hi, high << 4 | low])) + body
        images.append(jpeg.parse(data + b"\xff\xd9"))
        expected.append(blocks)
    assert np.array_equal(jpeg.decode_coefficients(images), np.concatenate(expected))


def test_media_columns(odd):
    from pyspark.sql import functions as F

    rows = odd.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("payload"), F.lit(1).alias("media"))
    got = media.open_media(media.store_media(rows)).select("payload", "height", "width", "rgb").collect()
    assert Counter(bytes(r["payload"]) for r in got) == Counter(bytes(r["payload"]) for r in rows.collect())
    assert all(len(r["rgb"]) == r["height"] * r["width"] * 3 for r in got)
    assert media.open_media(media.store_media(rows.limit(0))).count() == 0


def test_parsing_is_local():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 110, 4000).astype(np.uint8).tobytes()
    for ahead in (0, 1, 5, 64):
        texts = [body, rng.integers(97, 110, ahead).astype(np.uint8).tobytes() + body]
        offs = np.cumsum([0] + [len(t) for t in texts])
        a, b = fingerprints.sketches(np.frombuffer(b"".join(texts), np.uint8), offs, 1 << 20)
        assert len(np.intersect1d(a, b)) > 0.9 * len(a)


def test_fingerprints_do_not_depend_on_neighbours():
    texts = [b"", b"a", b"aaaaaaaa", b"abab" * 9, "é ü ".encode() * 30, bytes(range(97, 123)) * 4]
    offs = np.cumsum([0] + [len(t) for t in texts])
    together = fingerprints.sketches(np.frombuffer(b"".join(texts), np.uint8), offs)
    for t, s in zip(texts, together, strict=True):
        alone = fingerprints.sketches(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
        assert alone.tolist() == s.tolist()
    assert fingerprints.likeness(together[0], together[0]) == 1.0 and fingerprints.likeness(together[0], together[1]) == 0.0
    assert fingerprints.likeness(together[4], together[4]) == 1.0


MASK = 2**64 - 1


def plain_mix(x):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ (x >> 33)) * factor) & MASK
    return x ^ (x >> 33)


def plain_coin(x, before):
    bit = ((x ^ before) & -(x ^ before)).bit_length() - 1
    return 2 * bit + (x >> bit & 1)


def plain_level(symbols):
    """One level of locally consistent parsing, symbol by symbol."""
    joined = []
    for k, x in enumerate(symbols):
        if k and x == symbols[k - 1]:
            joined[-1][1] += 1
        else:
            joined.append([x, 1])
    own = [x if n == 1 else plain_mix((plain_mix((x + 0x2D) & MASK) + n) & MASK) for x, n in joined]
    label = [own[0] & 1] + [plain_coin(x, b) for b, x in zip(own, own[1:], strict=False)]
    for _ in range(3):
        label = [label[0] & 1] + [plain_coin(x, b) if x != b else 0 for b, x in zip(label, label[1:], strict=False)]
    borders = [0] + [k for k in range(2, len(own) - 1) if label[k - 1] < label[k] >= label[k + 1]] + [len(own)]
    names = []
    for a, b in zip(borders, borders[1:], strict=False):
        total = sum(plain_mix(plain_mix((x + 0x51) & MASK) ^ (kit.SECOND_BASE * step & MASK)) for step, x in enumerate(own[a:b]))
        names.append(plain_mix((total + b - a) & MASK))
    return names


def plain_sketch(text):
    names, symbols = set(), list(text)
    for level in range(1, fingerprints.LEVELS):
        if not symbols:
            break
        symbols = plain_level(symbols)
        if level >= fingerprints.FROM or len(symbols) == 1:
            names.update(plain_mix(x ^ 0xF1) >> 16 for x in symbols)
        if len(symbols) == 1:
            break
    return sorted(names)[: fingerprints.SIZE]


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    union = sorted(set(a) | set(b))[: fingerprints.SIZE]
    return len(set(union) & set(a) & set(b)) / len(union)


def test_parsing_against_a_plain_parser():
    rng = np.random.default_rng(2)
    texts = [b"", b"a", b"ab", b"aaaaab", b"abab" * 20, "é ü 中文 ".encode() * 40, bytes(rng.integers(97, 105, 3000).astype(np.uint8)), b"x" * 500]
    offs = np.cumsum([0] + [len(t) for t in texts])
    got = fingerprints.sketches(np.frombuffer(b"".join(texts), np.uint8), offs)
    assert [s.tolist() for s in got] == [plain_sketch(t) for t in texts]


def test_op6_gives_the_contract(spark, odd_rows):
    """The query over rows in the order of ids, the last followed by the first, against the plain parser."""
    from pyspark.sql import functions as F

    rows = [(r[0], (r[1] or "")[:600] if r[1] is not None else None) for r in odd_rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df.write.mode("overwrite").parquet(folder := kit.shared_folder(spark, "docs") + "/documents.parquet")
    order = [(r["doc_id"], r["text"] or "") for r in df.withColumn("h", F.xxhash64("text")).orderBy(F.col("doc_id").asc_nulls_last(), "h").collect()]
    expected = Counter()
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, changed, then = (plain_sketch(t.encode()) for t in (text, edited, after))
        hexes = ["".join(f"{x:012x}" for x in s) for s in (own, changed)]
        expected[i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *hexes, round(plain_likeness(own, changed), 9), round(plain_likeness(own, then), 9)] += 1
    got = fingerprints.op6_fingerprints(spark, folder.removesuffix("/documents.parquet")).collect()
    assert Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got) == expected
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in fingerprints.with_next(df, 300).where("own").collect()) == sorted((i is None, i or 0) for i, _ in rows)


def test_op6_of_an_empty_table(spark, empty):
    empty.write.mode("overwrite").parquet(folder := kit.shared_folder(spark, "docs") + "/documents.parquet")
    assert fingerprints.op6_fingerprints(spark, folder.removesuffix("/documents.parquet")).count() == 0


def test_crc_of_the_query(spark, sf_dir):
    row = media.op7_media(spark, sf_dir).first()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").where(f"doc_id = {row['doc_id']}").first()["text"].encode()
    padded = text + bytes(-len(text) % 64)
    assert row["tail_crc32"] == zlib.crc32(padded[-64:]) and row["payload_sha256"] == hashlib.sha256(padded).hexdigest()
