"""Progressive JPEG in numpy: a decoder for any number of images at once, and an encoder of given coefficients.

Decoder: the scans of all images are cut at restart markers into streams that are independent of each other, and all
streams of like scans are decoded in lockstep, one Huffman symbol of each at a time.  First scans set coefficients of
their band, refining scans add a bit to known ones and set new ones (ITU-T T.81, annex G: spectral selection and
successive approximation, end-of-band runs included), until the coefficient arrays hold all scans.  They are then
dequantised and inverse-transformed by one matrix product, chroma is upsampled to full resolution and converted to RGB.

Encoder: 4:2:0 images whose coefficients all have a magnitude of 2 at least, as scans of DC, bands of AC and their
refinements, with a restart marker after every RESTART units.  For such coefficients every scan is regular, so the
bits of many images are made together.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: Units between restart markers.
RESTART = 8


def _zigzag() -> np.ndarray:
    """Raster place of each coefficient in scan order: along the anti-diagonals, upwards on even ones."""
    return np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """Rows: coefficients in scan order; columns: the pixels of a block."""
    x = np.arange(8)
    cosine = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(0.125), 0.5)[:, None]
    return np.einsum("ux,vy->uvxy", cosine, cosine).reshape(64, 64)[ZIGZAG].astype(np.float32)


BASIS = _basis()

# ---------------------------------------------------------------- Huffman tables


def huffman_bits(weights: dict[int, float]) -> tuple[list[int], list[int]]:
    """Counts of codes of 1 to 16 bits, and the symbols by length: an optimal code limited to 16 bits without all ones."""
    groups = [(w, [s]) for s, w in weights.items()] + [(0.0, [-1])]  # the last stands for the code of all ones
    length = dict.fromkeys([*weights, -1], 0)
    while len(groups) > 1:
        groups.sort(key=lambda g: g[0])
        (a, x), (b, y) = groups[:2]
        for s in x + y:
            length[s] += 1
        groups = [(a + b, x + y), *groups[2:]]
    counts = [0] * (max(length.values()) + 1)
    for n in length.values():
        counts[n] += 1
    for n in range(len(counts) - 1, 16, -1):  # too long: a pair becomes one shorter code, a prefix elsewhere is split
        while counts[n] > 0:
            j = n - 2
            while counts[j] == 0:
                j -= 1
            counts[n] -= 2
            counts[n - 1] += 1
            counts[j + 1] += 2
            counts[j] -= 1
    counts = (counts + [0] * 17)[:17]
    counts[max(n for n in range(17) if counts[n])] -= 1
    symbols = sorted(weights, key=lambda s: (length[s], s))
    return counts[1:], symbols


class Table:
    """Codes by symbol, and for each 16 bits ahead the symbol and the length of its code."""

    def __init__(self, counts: list[int], symbols: list[int]):
        self.code, self.size = np.zeros(256, np.uint64), np.zeros(256, np.int64)
        self.symbol_at, self.size_at = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        code, k = 0, 0
        for n, count in enumerate(counts, 1):
            for symbol in symbols[k : k + count]:
                self.code[symbol], self.size[symbol] = code, n
                first = code << (16 - n)
                self.symbol_at[first : first + (1 << (16 - n))] = symbol
                self.size_at[first : first + (1 << (16 - n))] = n
                code += 1
            k += count
            code <<= 1


def _default_tables() -> dict[tuple[int, int], tuple[list[int], list[int]]]:
    """DC and AC tables by a rule: runs and sizes are the rarer the longer."""
    dc = huffman_bits({s: 2.0 ** -abs(s - 4) for s in range(12)})
    ac = {(r << 4) | s: 2.0 ** -(abs(s - 3) + 2 * r + 1) for r in range(16) for s in range(1, 11)}
    ac |= {0x00: 0.5, 0xF0: 1e-6} | {n << 4: 2.0 ** -(n + 4) for n in range(1, 15)}
    return {(0, 0): dc, (1, 0): huffman_bits(ac)}


DEFAULT_TABLES = _default_tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


# ---------------------------------------------------------------- encoder

#: Components, first and last coefficient, high and low bit of each scan.
SCRIPT = (((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0,), 6, 63, 0, 1), ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0))


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack_bits(value: np.ndarray, size: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items of at most 32 bits to bytes; start: first item of each stream.  A stream ends in one bits up to a byte."""
    done = np.r_[0, np.cumsum(size)]
    bits = np.diff(done[np.r_[start, len(size)]])
    length = -(-bits // 8)
    at = np.r_[0, np.cumsum(length)]
    offset = done[:-1] + np.repeat(at[:-1] * 8 - done[start], np.diff(np.r_[start, len(size)]))
    fill = length * 8 - bits
    end = at[:-1] * 8 + bits
    words = np.zeros((at[-1] + 15) // 8 + 1, np.uint64)
    for off, val, n in ((offset, value.astype(np.uint64), size), (end[fill > 0], (np.uint64(1) << fill[fill > 0].astype(np.uint64)) - np.uint64(1), fill[fill > 0])):
        if not len(off):
            continue
        word = off >> 6
        shift = 64 - (off & 63) - n
        over = shift < 0
        here = np.where(over, val >> np.maximum(-shift, 0).astype(np.uint64), val << np.maximum(shift, 0).astype(np.uint64))
        head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[head]] += np.add.reduceat(here, head)
        words[word[over] + 1] += val[over] << (64 + shift[over]).astype(np.uint64)
    return words.astype(">u8").view(np.uint8)[: at[-1]], at


def _stuffed(raw: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Streams with a zero after each 0xFF, and a restart marker after each but the last of an image (first: each image's
    first stream); where each image's bytes begin."""
    full = raw == 0xFF
    extra = np.r_[0, np.cumsum(full)]
    streams = len(at) - 1
    last = np.zeros(streams, bool)
    last[np.r_[first[1:], streams] - 1] = True
    length = np.diff(at + extra[at]) + 2 * ~last
    to = np.r_[0, np.cumsum(length)]
    out = np.zeros(to[-1], np.uint8)
    place = np.arange(len(raw)) + extra[:-1] + np.repeat(to[:-1] - (at + extra[at])[:-1], np.diff(at))
    out[place] = raw
    number = np.arange(streams) - np.repeat(first, np.diff(np.r_[first, streams]))
    out[to[1:][~last] - 2] = 0xFF
    out[to[1:][~last] - 1] = 0xD0 + number[~last] % 8
    return out, to[np.r_[first, streams]]


def encode(coefficients: list[tuple[np.ndarray, np.ndarray, np.ndarray]], shape: list[tuple[int, int]], notes: list[bytes]) -> list[bytes]:
    """Images of (rows, columns) 16-pixel units: blocks of Y, Cb and Cr with 64 coefficients each in scan order, all of
    magnitude 2 or more; notes go into a comment segment."""
    dc, ac = (Table(*DEFAULT_TABLES[k]) for k in ((0, 0), (1, 0)))
    images = len(shape)
    counts = [np.array([len(c[k]) for c in coefficients]) for k in range(3)]
    blocks = [np.concatenate([c[k] for c in coefficients]) for k in range(3)]
    parts: list[list[bytes]] = [[] for _ in range(images)]
    tables = b"".join(bytes([kind << 4 | k]) + bytes(c) + bytes(s) for (kind, k), (c, s) in DEFAULT_TABLES.items())
    for k, ((rows, columns), note) in enumerate(zip(shape, notes, strict=True)):
        frame = struct.pack(">BHHB", 8, rows * 16, columns * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        parts[k] += [b"\xff\xd8", _segment(0xFE, note), _segment(0xDB, bytes([0]) + b"\x01" * 64), _segment(0xC2, frame), _segment(0xC4, tables), _segment(0xDD, struct.pack(">H", RESTART))]
    for components, lo, hi, high, low in SCRIPT:
        if lo == 0:
            data, units, per = _dc_items(blocks, counts, shape, high, low, dc)
        else:
            units, per = counts[components[0]], None
            data = _ac_items(blocks[components[0]][:, lo : hi + 1], high, low, ac)
        value, size, each = data
        begin = np.cumsum(units) - units
        streams = -(-units // RESTART)
        first = np.cumsum(streams) - streams
        unit = np.repeat(begin, streams) + (np.arange(streams.sum()) - np.repeat(first, streams)) * RESTART
        out, at = _stuffed(*pack_bits(value, size, unit * each), first)
        head = _segment(0xDA, bytes([len(components)]) + b"".join(bytes([c + 1, 0]) for c in components) + bytes([lo, hi, high << 4 | low]))
        out = out.tobytes()
        for k in range(images):
            parts[k] += [head, out[at[k] : at[k + 1]]]
    return [b"".join([*p, b"\xff\xd9"]) for p in parts]


def unit_order(rows: int, columns: int) -> np.ndarray:
    """Y blocks (by number in raster order) of each 16-pixel unit."""
    r, c = np.divmod(np.arange(rows * columns), columns)
    top = 2 * r * 2 * columns + 2 * c
    return np.stack([top, top + 1, top + 2 * columns, top + 2 * columns + 1], 1)


def _dc_items(blocks, counts, shape, high: int, low: int, table: Table):
    values, starts = [], [np.cumsum(c) - c for c in counts]
    for k, (rows, columns) in enumerate(shape):
        y = unit_order(rows, columns) + starts[0][k]
        c = np.arange(rows * columns)
        values.append(np.concatenate([blocks[0][y, 0], blocks[1][c + starts[1][k], 0][:, None], blocks[2][c + starts[2][k], 0][:, None]], 1))
    units = np.array([len(v) for v in values])
    value = np.concatenate(values).astype(np.int64)
    if high:
        return ((value & 1).ravel().astype(np.uint64), np.ones(value.size, np.int64), 6), units, 6
    value >>= low
    within = np.arange(len(value)) - np.repeat(np.cumsum(units) - units, units)
    before = np.empty_like(value)
    before[:, 1:4] = value[:, :3]
    before[1:, 0], before[1:, 4:] = value[:-1, 3], value[:-1, 4:]
    reset = within % RESTART == 0
    before[reset, 0] = 0
    before[reset, 4:] = 0
    code, size = _sized((value - before).ravel(), table, 0)
    return (code, size, 6), units, 6


def _sized(value: np.ndarray, table: Table, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of values: the symbol of run and size, then the value's bits, inverted if it is negative."""
    magnitude = np.abs(value)
    size = bit_length(magnitude)
    bits = np.where(value < 0, (1 << size) - 1 - magnitude, magnitude).astype(np.uint64)
    symbol = (run << 4) | size
    return (table.code[symbol] << size.astype(np.uint64)) | bits, table.size[symbol] + size


def _ac_items(band: np.ndarray, high: int, low: int, table: Table):
    n, width = band.shape
    if not high:
        value = band.astype(np.int64).ravel()
        return (*_sized(np.sign(value) * (np.abs(value) >> low), table, 0), width)
    bits = (np.abs(band) & 1).astype(np.uint64)
    half = width // 2
    parts = [(bits[:, a:b] << np.arange(b - a - 1, -1, -1, dtype=np.uint64)).sum(1) for a, b in ((0, half), (half, width))]
    value = np.stack([np.full(n, table.code[0]), *parts], 1).ravel()
    return value, np.tile([int(table.size[0]), half, width - half], n), 3


# ---------------------------------------------------------------- decoder


@dataclass
class Component:
    number: int
    h: int
    v: int
    table: int
    rows: int = 0  # of blocks that the image covers
    columns: int = 0
    padded_rows: int = 0  # of whole units
    padded_columns: int = 0
    at: int = 0  # first block in the coefficient array


@dataclass
class Image:
    data: bytes
    height: int = 0
    width: int = 0
    components: list = field(default_factory=list)
    quantizers: dict = field(default_factory=dict)
    comment: bytes = b""
    scans: list = field(default_factory=list)


@dataclass
class Scan:
    components: list
    lo: int
    hi: int
    high: int
    low: int
    dc: dict
    ac: dict
    restart: int
    start: int
    end: int
    cuts: np.ndarray  # places of restart markers


_tables: dict[bytes, Table] = {}


def parse(data: bytes) -> Image:
    """Segments of an image; its scans with the tables that hold for each."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    image, raw = Image(data), np.frombuffer(data, np.uint8)
    full = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] != 0) & (raw[1:] != 0xFF))
    marks = raw[full + 1]
    ends, restarts = full[(marks < 0xD0) | (marks > 0xD7)], full[(marks >= 0xD0) & (marks <= 0xD7)]
    dc, ac, restart, at = {}, {}, 0, 2
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        marker = data[at + 1]
        if marker == 0xD9:
            return image
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                image.quantizers[body[k] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.float32)
                k += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = 17 + sum(body[k + 1 : k + 17])
                table = body[k + 1 : k + n]
                if table not in _tables:
                    _tables[table] = Table(list(table[:16]), list(table[16:]))
                (ac if body[k] >> 4 else dc)[body[k] & 15] = _tables[table]
                k += n
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            precision, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("only 8-bit samples are supported")
            image.components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            high, wide = max(c.v for c in image.components), max(c.h for c in image.components)
            for c in image.components:
                c.rows, c.columns = -(-image.height * c.v // (8 * high)), -(-image.width * c.h // (8 * wide))
                c.padded_rows, c.padded_columns = -(-image.height // (8 * high)) * c.v, -(-image.width // (8 * wide)) * c.h
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only progressive Huffman frames are supported")
        elif marker == 0xDA:
            n = body[0]
            by = {c.number: c for c in image.components}
            used = [(by[body[1 + 2 * k]], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n)]
            lo, hi, bits = body[1 + 2 * n : 4 + 2 * n]
            end = int(ends[np.searchsorted(ends, at)])
            cuts = restarts[np.searchsorted(restarts, at) : np.searchsorted(restarts, end)]
            image.scans.append(Scan(used, lo, hi, bits >> 4, bits & 15, dict(dc), dict(ac), restart, at, end, cuts))
            at = end


class _Bits:
    """The entropy-coded bytes of all streams without stuffing, and a place in bits for each stream."""

    def __init__(self, images: list[Image], streams: list[tuple[int, int, int]]):
        raw = np.frombuffer(b"".join(i.data for i in images) + b"\0" * 16, np.uint8)
        base = np.cumsum([0] + [len(i.data) for i in images])
        keep = np.ones(len(raw), bool)
        keep[1:] = (raw[1:] != 0) | (raw[:-1] != 0xFF)
        at = np.r_[0, np.cumsum(keep)]
        self.raw = np.r_[raw[keep], np.zeros(16, np.uint8)]
        self.view = np.ndarray(len(self.raw) - 8, ">u8", self.raw, strides=(1,))
        self.place = at[np.array([base[i] + a for i, a, _ in streams], np.int64)] * 8

    def peek(self, place: np.ndarray) -> np.ndarray:
        """57 bits at least, from the highest on."""
        return self.view[place >> 3].astype(np.uint64) << (place & 7).astype(np.uint64)


def _take(word: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits (0 to 32) after skip bits."""
    return ((word << skip.astype(np.uint64)) >> np.uint64(1) >> (63 - n).astype(np.uint64)).astype(np.int64)


def _extend(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where((n > 0) & (bits < (1 << np.maximum(n - 1, 0))), bits - (1 << n) + 1, bits)


def decode_coefficients(images: list[Image]) -> np.ndarray:
    """Coefficients of all blocks of all images and components, in scan order."""
    blocks = 0
    for image in images:
        for c in image.components:
            c.at = blocks
            blocks += c.padded_rows * c.padded_columns
    out = np.zeros((blocks, 64), np.int16)
    for turn in range(max((len(i.scans) for i in images), default=0)):
        like: dict[tuple, list[int]] = {}
        for k, image in enumerate(images):
            if turn < len(image.scans):
                s = image.scans[turn]
                tables = tuple((id(s.dc.get(d)) if not s.lo else 0, id(s.ac.get(a)) if s.lo else 0) for _, d, a in s.components)
                shape = tuple((c.h, c.v) for c, _, _ in s.components)
                like.setdefault((s.lo, s.hi, s.high, s.low, tables, shape), []).append(k)
        for own in like.values():
            _decode_scans([images[k] for k in own], turn, out)
    return out


def _decode_scans(images: list[Image], turn: int, out: np.ndarray) -> None:
    scan = images[0].scans[turn]
    streams, first, count, owner = [], [], [], []
    for k, image in enumerate(images):
        s = image.scans[turn]
        if len(s.components) == 1:
            c = s.components[0][0]
            units = c.rows * c.columns
        else:
            c = s.components[0][0]
            units = (c.padded_rows // c.v) * (c.padded_columns // c.h)
        each = s.restart or units
        starts = [s.start, *(s.cuts + 2).tolist()]
        for n, at in enumerate(starts):
            streams.append((k, at, 0))
            first.append(n * each)
            count.append(min(each, units - n * each))
            owner.append(k)
    bits = _Bits(images, streams)
    first, count, owner = np.array(first), np.array(count), np.array(owner)
    if scan.lo == 0:
        _decode_dc(images, turn, scan, bits, first, count, owner, out)
    else:
        c = [i.scans[turn].components[0][0] for i in images]
        at, columns, padded = (np.array([getattr(x, n) for x in c])[owner] for n in ("at", "columns", "padded_columns"))
        table = scan.ac[scan.components[0][2]]

        def block(which: np.ndarray, unit: np.ndarray) -> np.ndarray:
            r, col = np.divmod(first[which] + unit, columns[which])
            return at[which] + r * padded[which] + col

        (_refine_ac if scan.high else _first_ac)(scan, table, bits, count, block, out)


def _decode_dc(images, turn, scan, bits, first, count, owner, out) -> None:
    parts = [(j, v, h) for j, (c, _, _) in enumerate(scan.components) for v in range(c.v) for h in range(c.h)] if len(scan.components) > 1 else [(0, 0, 0)]
    own = [[i.scans[turn].components[j][0] for i in images] for j in range(len(scan.components))]
    at, padded = ([np.array([getattr(c, n) for c in cs])[owner] for cs in own] for n in ("at", "padded_columns"))
    if len(scan.components) > 1:
        wide = np.array([c.padded_columns // c.h for c in own[0]])[owner]
    else:
        wide = np.array([c.columns for c in own[0]])[owner]
    before = [np.zeros(len(count), np.int64) for _ in own]
    for unit in range(int(count.max(initial=0))):
        which = np.flatnonzero(count > unit)
        row, col = np.divmod(first[which] + unit, wide[which])
        for j, v, h in parts:
            c = scan.components[j][0]
            tall, broad = (c.v, c.h) if len(scan.components) > 1 else (1, 1)
            block = at[j][which] + (row * tall + v) * padded[j][which] + col * broad + h
            word = bits.peek(bits.place[which])
            if scan.high:
                out[block, 0] |= ((word >> np.uint64(63)).astype(np.int64) << scan.low).astype(np.int16)
                bits.place[which] += 1
            else:
                table = scan.dc[scan.components[j][1]]
                ahead = (word >> np.uint64(48)).astype(np.int64)
                size, n = table.size_at[ahead], table.symbol_at[ahead]
                before[j][which] += _extend(_take(word, size, n), n)
                out[block, 0] = (before[j][which] << scan.low).astype(np.int16)
                bits.place[which] += size + n


def _first_ac(scan, table, bits, count, block, out) -> None:
    """One symbol of every stream at a time."""
    live = np.flatnonzero(count > 0)
    unit = np.zeros(len(live), np.int64)
    k = np.full(len(live), scan.lo)
    place, many = bits.place[live], count[live]
    target = block(live, unit) * 64
    flat = out.reshape(-1)
    while len(live):
        word = bits.peek(place)
        ahead = (word >> np.uint64(48)).astype(np.int64)
        size, symbol = table.size_at[ahead], table.symbol_at[ahead]
        run, n = symbol >> 4, symbol & 15
        some = n > 0
        if some.all():
            k += run
            value = _extend(_take(word, size, n), n) << scan.low
            flat[target + k] = value
            k += 1
            place += size + n
            skip = None
        else:
            k[some] += run[some]
            flat[target[some] + k[some]] = _extend(_take(word[some], size[some], n[some]), n[some]) << scan.low
            k += np.where(some, 1, np.where(run == 15, 16, 0))
            band = ~some & (run < 15)  # the end of this band, and of so many more blocks
            length = np.where(band, run, 0)
            skip = np.where(band, (1 << length) + _take(word, size, length), 0)
            place += size + np.where(some, n, length)
        done = k > scan.hi
        if skip is not None:
            done |= skip > 0
        if done.any():
            unit += np.where(done, 1 if skip is None else np.maximum(skip, 1), 0)
            k[done] = scan.lo
            left = unit < many
            if not left.all():
                live, unit, k, place, many, target, done = (x[left] for x in (live, unit, k, place, many, target, done))
            target[done] = block(live[done], unit[done]) * 64


def _refine_ac(scan, table, bits, count, block, out) -> None:
    """One symbol of every stream at a time, with the correction bits of the known coefficients that it passes."""
    lo, hi, one = scan.lo, scan.hi, 1 << scan.low
    live = np.flatnonzero(count > 0)
    unit, k, rest = np.zeros(len(live), np.int64), np.full(len(live), lo), np.zeros(len(live), np.int64)
    place, many = bits.place[live], count[live]
    column = np.arange(64)
    while len(live):
        at = block(live, unit)
        have = out[at]
        known = have != 0
        ended = rest > 0  # blocks inside a run of ended bands have no symbol
        word = bits.peek(place)
        ahead = (word >> np.uint64(48)).astype(np.int64)
        size, symbol = table.size_at[ahead], table.symbol_at[ahead]
        run, n = symbol >> 4, symbol & 15
        size, n = np.where(ended, 0, size), np.where(ended, 0, n)
        band = ~ended & (n == 0) & (run < 15)
        length = np.where(band, run, 0)
        rest = np.where(band, (1 << length) + _take(word, size, length), rest)
        used = size + length + n
        positive = _take(word, size, n) > 0
        place = place + used
        ended |= band
        # where the symbol stops: the coefficient after `run` unknown ones, or the band's end
        open_ = ~known & (column >= k[:, None]) & (column <= hi)
        passed = np.cumsum(open_, 1)
        hit = open_ & (passed == (run + 1)[:, None])
        stop = np.where(hit.any(1) & ~ended, hit.argmax(1), hi + 1)
        fix = known & (column >= k[:, None]) & (column < stop[:, None])
        rank = np.cumsum(fix, 1) - fix
        where = (place[:, None] + rank)[fix]
        bit = (bits.raw[where >> 3] >> (7 - (where & 7)).astype(np.uint8)) & 1
        change = np.zeros_like(have)
        change[fix] = np.where(have[fix] > 0, one, -one) * bit
        have += change
        place = place + fix.sum(1)
        new = (n > 0) & (stop <= hi)
        have[np.flatnonzero(new), stop[new]] = np.where(positive[new], one, -one)
        out[at] = have
        k = np.where(ended, hi + 1, stop + 1)
        done = k > hi
        rest = np.where(done & ended, rest - 1, rest)
        unit = unit + done
        k = np.where(done, lo, k)
        left = unit < many
        if not left.all():
            live, unit, k, rest, place, many = (x[left] for x in (live, unit, k, rest, place, many))


def to_rgb(image: Image, pixels: list[np.ndarray]) -> np.ndarray:
    """The full-resolution RGB tensor; pixels: blocks of 64 samples of each component."""
    high, wide = max(c.v for c in image.components), max(c.h for c in image.components)
    planes = []
    for c, own in zip(image.components, pixels, strict=True):
        plane = own.reshape(c.padded_rows, c.padded_columns, 8, 8).swapaxes(1, 2).reshape(c.padded_rows * 8, c.padded_columns * 8)
        if (c.v, c.h) != (high, wide):
            plane = plane.repeat(high // c.v, 0).repeat(wide // c.h, 1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(np.clip(np.rint(planes[0] + 128), 0, 255).astype(np.uint8)[:, :, None], 3, 2)
    y, cb, cr = planes
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    rgb += np.float32(128.5)
    return np.clip(rgb, 0, 255).astype(np.uint8)


def samples(image: Image, coefficients: np.ndarray) -> list[np.ndarray]:
    """Inverse-transformed blocks of each component, about zero."""
    out = []
    for c in image.components:
        own = coefficients[c.at : c.at + c.padded_rows * c.padded_columns]
        out.append((own * image.quantizers[c.table]) @ BASIS)
    return out
