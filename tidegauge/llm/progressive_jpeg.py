"""Media columns as progressive JPEG: scans add up in coefficient arrays, which become full-resolution RGB tensors.

``decode`` reads any progressive (or sequential) Huffman-coded JPEG of 8-bit samples with one or three components:
spectral selection, successive approximation, restart intervals, interleaved scans, subsampled chroma. Entropy-coded
intervals of many images are decoded side by side: one step reads one symbol of every interval, as numpy arrays.

``encode`` stores bytes without loss. The unit is the quantised coefficient: byte b becomes the coefficient b if
b >= 128, else b - 255, so its 8 low bits (as JPEG codes magnitudes) are b itself; all steps of quantisation are 1.
64 bytes make a block. Blocks fill 4:2:0 images in rows of units (four luma blocks, one of each chroma); blocks that
the payload does not reach hold byte 0.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

BLOCK = 64
# Blocks in a restart interval of our scans, and units (of 16 x 16 samples) in a row of an image.
INTERVAL = 8
UNITS_ACROSS = 64
MOST_UNITS = 65535 // 16  # of an image's side
# The successive approximation of our first scans leaves this many low bits to one refining scan.
LOW_BITS = 1

# Fixed values of the format: the zigzag order of an 8 x 8 block, by rising diagonals of alternating direction.
ZIGZAG = np.array(
    [r * 8 + c for s in range(15) for r, c in sorted(((r, s - r) for r in range(8) if 0 <= s - r < 8), reverse=s % 2 == 0)]
)


class BadJpeg(ValueError):
    pass


# ---------------------------------------------------------------- transform

_SCALE = 1 << 13


def _basis() -> np.ndarray:
    """Rows: zigzag coefficients; columns: samples of the block. Whole numbers, so that sums in doubles are exact."""
    k, n = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    one = np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * n + 1) * k * np.pi / 16)
    one = np.rint(one * _SCALE)
    return np.kron(one, one)[ZIGZAG]


_BASIS = _basis()


def samples(coefficients: np.ndarray) -> np.ndarray:
    """(blocks, 64) dequantised coefficients in zigzag order -> (blocks, 8, 8) samples, 0 to 255."""
    flat = np.floor(coefficients.astype(np.float64) @ _BASIS / (_SCALE * _SCALE) + 128.5)
    return np.clip(flat, 0, 255).astype(np.int32).reshape(-1, 8, 8)


def to_rgb(planes: list[np.ndarray]) -> np.ndarray:
    """Component planes of one size -> (height, width, 3) bytes; one plane is grey. Whole-number BT.601, full range."""
    y = planes[0]
    if len(planes) == 1:
        return np.repeat(y[..., None], 3, axis=2).astype(np.uint8)
    cb, cr = planes[1] - 128, planes[2] - 128
    half = 1 << 15
    red = y + ((91881 * cr + half) >> 16)  # fixed values: 1.402, 0.344136, 0.714136 and 1.772 in 65536ths
    green = y - ((22554 * cb + 46802 * cr + half) >> 16)
    blue = y + ((116130 * cb + half) >> 16)
    return np.clip(np.stack((red, green, blue), axis=2), 0, 255).astype(np.uint8)


# ---------------------------------------------------------------- container


@dataclass
class Component:
    name: int
    h: int
    v: int
    table: int
    across: int = 0  # blocks in a row and rows of blocks, for whole units
    down: int = 0
    own_across: int = 0  # the same for the component alone
    own_down: int = 0
    base: int = 0  # first block in the coefficient array of the call


@dataclass
class Scan:
    parts: list[tuple[int, int, int]]  # component index, DC and AC table
    first: int
    last: int
    high: int
    low: int
    restart: int
    tables: dict[int, np.ndarray]
    data: list[bytes]  # one per restart interval, stuffing removed


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """Per 16-bit window: symbol and code length (symbol * 32 + length); 0 where no code starts so."""
    table, code = np.zeros(1 << 16, np.int32), 0
    at = 0
    for length in range(1, 17):
        for symbol in symbols[at : at + counts[length - 1]]:
            table[code << (16 - length) : (code + 1) << (16 - length)] = symbol * 32 + length
            code += 1
        at += counts[length - 1]
        code <<= 1
    return table


_LOOKUPS: dict[tuple[bytes, bytes], np.ndarray] = {}


def parse(data: bytes) -> Image:
    """Markers and entropy-coded intervals of one image."""
    if data[:2] != b"\xff\xd8":
        raise BadJpeg("no start of image")
    image, at, tables, restart = Image(), 2, {}, 0
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 2 > len(data) or data[at] != 0xFF:
            raise BadJpeg("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            return image
        size = int.from_bytes(data[at + 2 : at + 4])
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                image.quant[name] = np.frombuffer(body, ">u2" if wide else ">u1", 64, 1).astype(np.int32)
                body = body[1 + 64 * (wide + 1) :]
        elif marker in (0xC0, 0xC1, 0xC2):
            if body[0] != 8:
                raise BadJpeg("only 8-bit samples")
            image.height, image.width, n = struct.unpack(">HHB", body[1:6])
            parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
            image.components = [Component(p[0], p[1] >> 4, p[1] & 15, p[2]) for p in parts]
            high, wide = max(c.v for c in image.components), max(c.h for c in image.components)
            for c in image.components:
                units = -(-image.width // (8 * wide)), -(-image.height // (8 * high))
                c.across, c.down = units[0] * c.h, units[1] * c.v
                c.own_across = -(-(-(-image.width * c.h // wide)) // 8)
                c.own_down = -(-(-(-image.height * c.v // high)) // 8)
        elif 0xC3 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise BadJpeg("a coding that is not read here")
        elif marker == 0xC4:
            while body:
                counts, n = body[1:17], sum(body[1:17])
                key = counts, body[17 : 17 + n]
                if key not in _LOOKUPS:
                    if len(_LOOKUPS) > 256:
                        _LOOKUPS.clear()
                    _LOOKUPS[key] = _lookup(*key)
                tables = {**tables, body[0]: _LOOKUPS[key]}
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(body)
        elif marker == 0xFE:
            image.comment += body
        elif marker == 0xDA:
            names = [c.name for c in image.components]
            n = body[0]
            parts = [(names.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            intervals, start, end = [], at, at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise BadJpeg("a scan has no end")
                if data[end + 1] == 0:
                    end += 2
                elif 0xD0 <= data[end + 1] <= 0xD7:
                    intervals.append(data[start:end])
                    start = end = end + 2
                elif data[end + 1] == 0xFF:
                    end += 1
                else:
                    break
            intervals.append(data[start:end])
            intervals = [x.replace(b"\xff\x00", b"\xff") for x in intervals]
            image.scans.append(Scan(parts, first, last, bits >> 4, bits & 15, restart, tables, intervals))
            at = end


# ---------------------------------------------------------------- entropy decoding


class Bits:
    """Windows of 32 bits at any bit of many intervals laid end to end, with ones after each as the format pads."""

    def __init__(self, intervals: list[bytes]):
        joined = b"".join(x + b"\xff" * 8 for x in intervals)
        octets = np.frombuffer(joined + b"\xff" * 8, np.uint8)
        wide = octets.astype(np.uint64)
        self.words = wide[:-4] << np.uint64(32)
        for i in range(1, 5):
            self.words |= wide[i : len(wide) - 4 + i] << np.uint64(32 - 8 * i)
        self.octets = octets
        sizes = np.array([len(x) + 8 for x in intervals], np.int64)
        self.starts = 8 * np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.ends = self.starts + 8 * (sizes - 8)

    def window(self, place: np.ndarray) -> np.ndarray:
        """The 32 bits from each place on."""
        return (self.words[place >> 3] >> (8 - (place & 7)).astype(np.uint64)).astype(np.int64) & 0xFFFFFFFF

    def run(self, place: int, n: int) -> np.ndarray:
        return np.unpackbits(self.octets[place >> 3 : (place + n + 7) >> 3])[place & 7 : (place & 7) + n]


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)


@lru_cache(maxsize=4096)
def _alone(across: int, own_across: int, own_down: int) -> np.ndarray:
    return (np.arange(own_down)[:, None] * across + np.arange(own_across)[None, :]).ravel()


@lru_cache(maxsize=4096)
def _interleaved(parts: tuple[tuple[int, int, int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Per block of the scan: its component's place in the scan and its number in the component."""
    whose, rows = [], []
    for number, (h, v, across, down) in enumerate(parts):
        y, x = np.divmod(np.arange(across * down // (h * v)), across // h)
        for j in range(v):
            for i in range(h):
                rows.append((y * v + j) * across + x * h + i)
                whose.append(number)
    return np.tile(np.array(whose), len(rows[0])), np.stack(rows, axis=1).ravel()


def _blocks(image: Image, scan: Scan) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks of the scan in coded order (rows of the coefficient array), their kind, and blocks in an interval.

    A kind is 16 times the component's place in the scan and its DC table.
    """
    chosen = [image.components[number] for number, *_ in scan.parts]
    if len(chosen) == 1:
        c = chosen[0]
        rows = _alone(c.across, c.own_across, c.own_down) + c.base
        return rows, np.full(len(rows), scan.parts[0][1]), scan.restart or len(rows)
    whose, rows = _interleaved(tuple((c.h, c.v, c.across, c.down) for c in chosen))
    base = np.array([c.base for c in chosen])
    kinds = np.array([16 * i + dc for i, (_, dc, _) in enumerate(scan.parts)])
    unit = sum(c.h * c.v for c in chosen)
    return rows + base[whose], kinds[whose], (scan.restart or len(rows) // unit) * unit


@dataclass
class Lanes:
    """Intervals of one kind of scan, of one or many images, to be decoded side by side."""

    data: list[bytes]
    rows: list[np.ndarray]
    kinds: list[np.ndarray]
    tables: list[dict[int, np.ndarray]]


def _dc(lanes: Lanes, low: int, out: np.ndarray) -> None:
    bits = Bits(lanes.data)
    sizes = np.array([len(r) for r in lanes.rows])
    offset = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    rows = np.concatenate(lanes.rows)
    stacked, kinds = [], np.empty(len(rows), np.int64)
    slots: dict[int, int] = {}
    for o, n, own, tables in zip(offset, sizes, lanes.kinds, lanes.tables):
        slot = np.zeros(16, np.int64)
        for name, table in tables.items():
            if name < 16:
                if id(table) not in slots:
                    slots[id(table)] = len(stacked)
                    stacked.append(table)
                slot[name] = slots[id(table)]
        kinds[o : o + n] = slot[own & 15] * 256 + (own >> 4)
    tables = np.concatenate(stacked)
    place, last = bits.starts.copy(), np.zeros((len(sizes), 4), np.int64)
    for step in range(int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > step)
        at = offset[live] + step
        kind = kinds[at]
        window = bits.window(place[live])
        found = tables[(kind >> 8) * 65536 + (window >> 16)]
        length, size = found & 31, found >> 5
        if not length.all() or size.max() > 15:
            raise BadJpeg("no such DC code")
        value = (window >> (32 - length - size)) & ((1 << size) - 1)
        last[live, kind & 255] += _signed(value, size)
        out[rows[at], 0] = last[live, kind & 255] << low
        place[live] += length + size


def _ac(lanes: Lanes, table: np.ndarray, first: int, last: int, low: int, out: np.ndarray) -> None:
    bits = Bits(lanes.data)
    sizes = np.array([len(r) for r in lanes.rows], np.int64)
    rows = np.append(np.concatenate(lanes.rows), 0)
    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    end, place, k = at + sizes, bits.starts.copy(), np.full(len(sizes), first, np.int64)
    flat = out.reshape(-1)
    live = at < end
    at, end, place, k = at[live], end[live], place[live], k[live]
    while len(at):
        window = bits.window(place)
        found = table[window >> 16]
        length, symbol = found & 31, found >> 5
        if not length.all():
            raise BadJpeg("no such AC code")
        run, size = symbol >> 4, symbol & 15
        plain = size > 0
        if plain.all():
            k += run
            value = (window >> (32 - length - size)) & ((1 << size) - 1)
            if k.max() > last:
                raise BadJpeg("a run leaves its block")
            flat[rows[at] * BLOCK + k] = _signed(value, size) << low
            k += 1
            place += length + size
        else:
            ends = ~plain & (run < 15)
            extra = np.where(ends, run, size)
            value = (window >> (32 - length - extra)) & ((1 << extra) - 1)
            k = k + np.where(ends, 0, run)
            if (k[plain] > last).any():
                raise BadJpeg("a run leaves its block")
            flat[rows[at[plain]] * BLOCK + k[plain]] = _signed(value[plain], size[plain]) << low
            k = k + np.where(ends, 0, 1)
            place = place + length + extra
            at = at + np.where(ends, (1 << run) + value, 0)
            k[ends] = first
        over = k > last
        if over.any():
            at[over] += 1
            k[over] = first
        done = at >= end
        if done.any():
            keep = ~done
            at, end, place, k = at[keep], end[keep], place[keep], k[keep]


def _refine(data: bytes, rows: np.ndarray, table: np.ndarray, first: int, last: int, low: int, out: np.ndarray) -> None:
    """One interval of an AC refining scan. A run of blocks without new coefficients is corrected in one go."""
    ended = data + b"\xff" * 8  # ones after the end, as the format pads
    octets = np.frombuffer(ended, np.uint8)
    place, bit, flat = 0, 1 << low, out.reshape(-1)

    def window(place: int) -> int:
        at = min(place >> 3, len(data))
        return int.from_bytes(ended[at : at + 5]) >> (8 - (place & 7)) & 0xFFFFFFFF

    def correct(cells: np.ndarray) -> None:
        nonlocal place
        if not len(cells):
            return
        old = flat[cells]
        here = octets[place >> 3 : (place + len(cells) + 7) >> 3]
        bits = np.unpackbits(here)[place & 7 : (place & 7) + len(cells)].astype(bool)
        fix = np.flatnonzero(bits & (np.abs(old) & bit == 0))
        flat[cells[fix]] = old[fix] + np.sign(old[fix]) * bit
        place += len(cells)

    def read(n: int) -> int:
        nonlocal place
        value = window(place) >> (32 - n) if n else 0
        place += n
        return value

    block, k = 0, first
    while block < len(rows):
        found = int(table[window(place) >> 16])
        if not found:
            raise BadJpeg("no such AC code")
        place += found & 31
        run, size = found >> 9, found >> 5 & 15
        if size == 0 and run < 15:
            blocks = min((1 << run) + read(run), len(rows) - block)
            cells = rows[block : block + blocks, None] * BLOCK + np.arange(first, last + 1)[None, :]
            cells = cells.ravel()[k - first :]
            correct(cells[flat[cells] != 0])
            block, k = block + blocks, first
            continue
        new = bit * (1 if read(1) else -1) if size else 0
        cells = rows[block] * BLOCK + np.arange(k, last + 1)
        zeros = np.flatnonzero(flat[cells] == 0)
        stop = int(zeros[run]) if run < len(zeros) else len(cells)
        passed = cells[:stop]
        correct(passed[flat[passed] != 0])
        if new and stop < len(cells):
            flat[cells[stop]] = new
        k += stop + 1
        if k > last:
            block, k = block + 1, first


def coefficients(images: list[Image]) -> np.ndarray:
    """All scans of all images, added up: (blocks, 64) in zigzag order. Sets each component's first block."""
    total = 0
    for image in images:
        for c in image.components:
            c.base, total = total, total + c.across * c.down
    out = np.zeros((total, BLOCK), np.int32)
    for number in range(max((len(i.scans) for i in images), default=0)):
        dc: dict[int, Lanes] = {}
        ac: dict[tuple, Lanes] = {}
        for image in images:
            if number >= len(image.scans):
                continue
            scan = image.scans[number]
            rows, kinds, step = _blocks(image, scan)
            cuts = range(0, len(rows), step) if len(rows) else []
            if len(cuts) > len(scan.data):
                raise BadJpeg("intervals are missing")
            pairs = [(d, rows[c : c + step], kinds[c : c + step]) for d, c in zip(scan.data, cuts)]
            if scan.first == 0 and scan.high:
                for d, r, _ in pairs:
                    bit = np.unpackbits(np.frombuffer(d, np.uint8), count=len(r)).astype(np.int32)
                    out[r, 0] |= bit << scan.low
                continue
            if scan.first == 0 and scan.last == 0:
                lanes = dc.setdefault(scan.low, Lanes([], [], [], []))
                lanes.tables += [scan.tables] * len(pairs)
            elif scan.first == 0:
                raise BadJpeg("sequential scans are not read here")
            else:
                table = scan.tables[16 + scan.parts[0][2]]
                if scan.high:
                    for d, r, _ in pairs:
                        _refine(d, r, table, scan.first, scan.last, scan.low, out)
                    continue
                lanes = ac.setdefault((id(table), scan.first, scan.last, scan.low), Lanes([], [], [], []))
                lanes.tables = [table]
            lanes.data += [d for d, *_ in pairs]
            lanes.rows += [r for _, r, _ in pairs]
            lanes.kinds += [k for *_, k in pairs]
        for low, lanes in dc.items():
            _dc(lanes, low, out)
        for (_, first, last, low), lanes in ac.items():
            _ac(lanes, lanes.tables[0], first, last, low, out)
    return out


def tensors(images: list[Image], found: np.ndarray) -> list[np.ndarray]:
    """Each image's tensor (height, width, 3) from the coefficients of the call; chroma is replicated to full size.

    Blocks of all images and components that share a quantisation are transformed together.
    """
    spans: dict[bytes, list[tuple[int, int]]] = {}
    for image in images:
        for c in image.components:
            spans.setdefault(image.quant[c.table].tobytes(), []).append((c.base, c.base + c.across * c.down))
    blocks = np.empty(found.shape, np.int32)
    for quant, parts in spans.items():
        rows = np.concatenate([np.arange(a, b) for a, b in parts]) if len(spans) > 1 else slice(None)
        blocks[rows] = samples(found[rows] * np.frombuffer(quant, np.int32)[None, :]).reshape(-1, BLOCK)
    return [_tensor(image, blocks) for image in images]


def rgb(image: Image, found: np.ndarray) -> np.ndarray:
    """One image's tensor."""
    return tensors([image], found)[0]


def _tensor(image: Image, blocks: np.ndarray) -> np.ndarray:
    planes = []
    wide, high = max(c.h for c in image.components), max(c.v for c in image.components)
    for c in image.components:
        own = blocks[c.base : c.base + c.across * c.down]
        plane = own.reshape(c.down, c.across, 8, 8).transpose(0, 2, 1, 3).reshape(c.down * 8, c.across * 8)
        plane = plane.repeat(high // c.v, axis=0).repeat(wide // c.h, axis=1)
        planes.append(plane[: image.height, : image.width])
    return to_rgb(planes)


# ---------------------------------------------------------------- encoding


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + struct.pack(">H", len(body) + 2) + body


def _codes(lengths: list[tuple[int, int]]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A table's body from (symbol, code length) pairs in rising length, and symbol -> (code, length)."""
    counts, code, before, found = bytearray(16), 0, 0, {}
    for symbol, length in lengths:
        code <<= length - before
        found[symbol] = code, length
        code, before = code + 1, length
        counts[length - 1] += 1
    return bytes(counts) + bytes(s for s, _ in lengths), found


# DC differences by size; AC: one code of 1 bit for a coefficient of 8 - LOW_BITS bits after no zeros, so that code and
# magnitude fill a byte; runs of blocks without new coefficients for the refining scan.
_DC_BODY, _DC_CODES = _codes([(s, 4) for s in range(12)])
_AC_BODY, _AC_CODES = _codes([(8 - LOW_BITS, 1), *((r << 4, 5) for r in range(15))])
_HEAD_TABLES = _segment(0xDB, bytes(1) + bytes([1]) * 64) + _segment(0xC4, b"\x00" + _DC_BODY) + _segment(0xC4, b"\x10" + _AC_BODY)


def _packed(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Bits of the values, first bit highest, padded with ones and stuffed."""
    total = int(lengths.sum())
    index = np.repeat(np.arange(len(values)), lengths)
    place = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    bits = (values[index] >> (lengths[index] - 1 - place) & 1).astype(np.uint8)
    pad = np.ones(-total % 8, np.uint8)
    return np.packbits(np.concatenate((bits, pad))).tobytes().replace(b"\xff", b"\xff\x00")


def _scan(parts: bytes, first: int, last: int, high: int, low: int, body: bytes) -> bytes:
    return _segment(0xDA, bytes([len(parts)]) + b"".join(bytes((p, 0)) for p in parts) + bytes((first, last, high << 4 | low))) + body


def _restarts(intervals: list[bytes]) -> bytes:
    out = [intervals[0]]
    for i, x in enumerate(intervals[1:]):
        out += [bytes((0xFF, 0xD0 + i % 8)), x]
    return b"".join(out)


def _geometry(blocks: int) -> tuple[int, int]:
    units = max(1, -(-blocks // 6))
    across = min(units, max(UNITS_ACROSS, -(-units // MOST_UNITS)))
    return across, -(-units // across)


@lru_cache(maxsize=4096)
def _order(across: int, down: int) -> list[np.ndarray]:
    """For each component, the payload block in each of its places: six blocks a unit, four of them luma."""
    unit = np.arange(across * down).reshape(down, across)
    luma = np.stack([unit * 6 + i for i in range(4)], axis=-1).reshape(down, across, 2, 2)
    return [luma.transpose(0, 2, 1, 3).ravel(), (unit * 6 + 4).ravel(), (unit * 6 + 5).ravel()]


def encode(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose coefficients hold ``payload`` (a positive multiple of 64 bytes).

    Scans: interleaved DC with its low bit left out; per component the coefficients 1 to 5 and 6 to 63 likewise; the
    low bits of the coefficients 1 to 63 per component; the low bits of the DC. A comment holds the payload's size.
    """
    if not payload or len(payload) % BLOCK:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    across, down = _geometry(len(payload) // BLOCK)
    if across > MOST_UNITS:
        raise ValueError("the payload is too large for one image")
    octets = np.zeros((across * down * 6, BLOCK), np.uint8)
    octets.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    order = _order(across, down)
    dc = np.where(octets[:, 0] >= 128, octets[:, 0].astype(np.int64), octets[:, 0].astype(np.int64) - 255)

    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload))), _HEAD_TABLES]
    frame = struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes((1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))
    out.append(_segment(0xC2, frame))

    # DC: differences within a component, in the order of units; one unit is six blocks.
    high = (dc >> LOW_BITS).reshape(-1, 6)
    steps = np.empty_like(high)
    steps[:, 1:4] = high[:, 1:4] - high[:, 0:3]
    steps[:, 0] = high[:, 0] - np.concatenate(([0], high[:-1, 3]))
    for c in (4, 5):
        steps[:, c] = high[:, c] - np.concatenate(([0], high[:-1, c]))
    begins = np.arange(0, len(high), INTERVAL)
    for c, own in ((0, 0), (4, 4), (5, 5)):
        steps[begins, c] = high[begins, own]
    flat = steps.ravel()
    size = np.zeros(len(flat), np.int64)
    for s in range(11):
        size += np.abs(flat) >= 1 << s
    magnitude = np.where(flat < 0, flat + (1 << size) - 1, flat)
    code = np.array([_DC_CODES[s][0] for s in range(12)])[size]
    bits = np.array([_DC_CODES[s][1] for s in range(12)])[size]
    values, lengths = code << size | magnitude, bits + size
    intervals = [_packed(values[a : a + 6 * INTERVAL], lengths[a : a + 6 * INTERVAL]) for a in range(0, len(flat), 6 * INTERVAL)]
    out.append(_segment(0xDD, struct.pack(">H", INTERVAL)))
    out.append(_scan(b"\x01\x02\x03", 0, 0, 0, LOW_BITS, _restarts(intervals)))

    # AC: the code is a 0 and the magnitude the byte's high bits, so a coefficient is the byte shifted, never 255.
    moved = octets >> LOW_BITS
    for first, last in ((1, 5), (6, 63)):
        for name, blocks in enumerate(order, 1):
            band = moved[blocks, first : last + 1]
            body = [band[a : a + INTERVAL].tobytes() for a in range(0, len(band), INTERVAL)]
            out.append(_scan(bytes([name]), first, last, 0, LOW_BITS, _restarts(body)))
    out.append(_segment(0xDD, struct.pack(">H", 0)))
    # Refining: all coefficients are known to be other than 0, so runs of whole blocks hold one bit each. A negative
    # coefficient's magnitude is 255 less the byte.
    low = np.where(octets >= 128, octets & 1, 1 - (octets & 1)).astype(np.uint8)
    for name, blocks in enumerate(order, 1):
        parts = []
        for a in range(0, len(blocks), (1 << 15) - 1):
            own = blocks[a : a + (1 << 15) - 1]
            run = len(own).bit_length() - 1
            code, length = _AC_CODES[run << 4]
            head = code << run | (len(own) - (1 << run))
            parts += [np.array([head >> i & 1 for i in range(length + run - 1, -1, -1)], np.uint8), low[own, 1:].ravel()]
        bits = np.concatenate(parts)
        bits = np.concatenate((bits, np.ones(-len(bits) % 8, np.uint8)))
        out.append(_scan(bytes([name]), 1, 63, 1, 0, np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")))
    bits = (dc & 1).astype(np.uint8)
    bits = np.concatenate((bits, np.ones(-len(bits) % 8, np.uint8)))
    out.append(_scan(b"\x01\x02\x03", 0, 0, 1, 0, np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")))
    return b"".join(out) + b"\xff\xd9"


def payload(image: Image, found: np.ndarray) -> bytes:
    """The bytes that ``encode`` stored, from decoded coefficients."""
    luma, blue, _ = image.components
    order = _order(blue.across, blue.down)
    values = np.empty((blue.across * blue.down * 6, BLOCK), np.uint8)
    for c, blocks in zip(image.components, order):
        own = found[c.base : c.base + c.across * c.down]
        if ((np.abs(own) > 255) | ((own < 128) & (own > -128))).any():
            raise BadJpeg("no payload")
        values[blocks] = np.where(own > 0, own, own + 255)
    return values.tobytes()[: struct.unpack(">Q", image.comment)[0]]
