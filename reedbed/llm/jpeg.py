"""Progressive JPEG in numpy: many images side by side.

Reading: every scan (a band of coefficients at a bit position) adds to coefficient arrays. The intervals between
restart markers are independent, so all intervals of a scan, of all images with the same scans and tables, are decoded in
step: each numpy operation takes one symbol from every interval. Coefficients are dequantised, transformed by one
64 x 64 matrix, chroma is repeated to full resolution, and samples become RGB.

Writing: blocks of 64 bytes are the coefficients (less 128) of a 4:2:0 image whose quantisation steps are 1, so the bytes
come back exactly. A restart interval is one block (one unit in the scans of all components).
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np


def zigzag() -> np.ndarray:
    """Raster place of each coefficient in zigzag order."""
    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * y + x for y, x in order])


ZIGZAG = zigzag()


def inverse_matrix() -> np.ndarray:
    """Zigzag coefficients -> 64 samples in raster order."""
    k = np.arange(8)
    c = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)  # sample, frequency
    return np.einsum("yv,xu->vuyx", c, c).reshape(64, 64)[ZIGZAG].astype(np.float32)


INVERSE = inverse_matrix()

# --- Huffman tables -------------------------------------------------------------------------------------------------


def canonical(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """DHT body (16 counts, symbols), and code and length for each of 256 symbols."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(lengths[s] == n for s in symbols) for n in range(1, 17))
    return (body := counts + bytes(symbols)), *codes(body)


def codes(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    value, size = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            value[body[at]], size[body[at]] = code, n
            code, at = code + 1, at + 1
        code <<= 1
    return value, size


def lookup(body: bytes) -> np.ndarray:
    """For each 16 bits ahead: symbol << 8 | code length (0: no such code)."""
    value, size = codes(body)
    table = np.zeros(1 << 16, dtype=np.int64)
    for s in np.flatnonzero(size).tolist():
        low = int(value[s]) << (16 - int(size[s]))
        table[low : low + (1 << (16 - int(size[s])))] = s << 8 | int(size[s])
    return table


DC_BODY, DC_CODE, DC_SIZE = canonical({s: 4 for s in range(12)})
AC_BODY, AC_CODE, AC_SIZE = canonical({**{s: 4 for s in range(8)}, **{r << 4 | s: 8 for r in range(1, 16) for s in range(8)}})
FIX_BODY, FIX_CODE, FIX_SIZE = canonical({0: 2, **{r << 4 | s: 6 for r in range(16) for s in (0, 1) if r or s}})

# --- Writing --------------------------------------------------------------------------------------------------------

#: Components (blocks per unit across and down) and scans (components, first, last, high bit, low bit).
SAMPLING = ((2, 2), (1, 1), (1, 1))
SCANS = [((0, 1, 2), 0, 0, 0, 1), *[((c,), a, b, 0, 1) for c in range(3) for a, b in ((1, 5), (6, 63))], ((0, 1, 2), 0, 0, 1, 0), *[((c,), 1, 63, 1, 0) for c in range(3)]]


def shape_of(blocks: int) -> tuple[int, int]:
    """Units across and down for so many blocks (six in a unit)."""
    units = -(-blocks // 6)
    across = max(1, int(np.ceil(np.sqrt(units))))
    return across, -(-units // across)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _headers() -> tuple[bytes, list[bytes]]:
    """What every file has: tables up front, and the head of each scan."""
    start = _segment(0xDB, b"\x00" + bytes([1] * 64))
    tables = _segment(0xC4, b"\x00" + DC_BODY) + _segment(0xC4, b"\x10" + AC_BODY) + _segment(0xC4, b"\x11" + FIX_BODY) + _segment(0xDD, b"\x00\x01")
    scans = []
    for components, first, last, high, low in SCANS:
        chosen = b"".join(bytes([c + 1, 0x01 if first and high else 0x00]) for c in components)
        scans.append(_segment(0xDA, bytes([len(components)]) + chosen + bytes([first, last, high << 4 | low])))
    return start + tables, scans


TABLES, SCAN_HEADS = _headers()


class Bits:
    """Symbols (value, length, lane) put together to the bytes of each lane, filled with ones."""

    def __init__(self, lanes: int):
        self.lanes, self.parts = lanes, []
        self.ready: tuple[np.ndarray, np.ndarray] | None = None  # lanes of equal size that are packed already

    def add(self, lane, order, value, size):
        """``order`` sorts the symbols of a lane."""
        self.parts.append((np.asarray(lane), np.asarray(order), np.asarray(value), np.asarray(size)))

    def pack(self) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, lane by lane, and how many each lane has."""
        lane, order, value, size = (np.concatenate(p) for p in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, dtype=np.int64),) * 4
        if len(self.parts) > 1:
            by = np.argsort(lane * (1 << 12) + order, kind="stable")
            lane, value, size = lane[by], value[by], size[by]
        bits = np.bincount(lane, weights=size, minlength=self.lanes).astype(np.int64)
        need = (bits + 7) // 8
        if self.ready:
            need[self.ready[0]] = self.ready[1].shape[1]
        start = np.concatenate(([0], np.cumsum(need)[:-1])) if self.lanes else need
        running = np.cumsum(size) - size
        first = np.concatenate(([0], np.cumsum(bits)[:-1])) if self.lanes else bits
        at = start[lane] * 8 + running - first[lane]
        total = int(need.sum())
        reach = (int(size.max(initial=1)) + 14) // 8  # bytes that a symbol can touch
        shifted = value << (8 * reach - (at & 7) - size)
        out, first_byte = np.zeros(total + reach), at >> 3
        for k in range(reach):
            out += np.bincount(first_byte + k if k else first_byte, weights=(shifted >> (8 * (reach - 1 - k))) & 255, minlength=total + reach)
        data = out[:total].astype(np.uint8)
        spare = need * 8 - bits
        last = start + need - 1
        some = (spare > 0) & (bits > 0)
        data[last[some]] |= ((1 << spare[some]) - 1).astype(np.uint8)
        if self.ready:
            data[start[self.ready[0]][:, None] + np.arange(self.ready[1].shape[1])] = self.ready[1]
        return data, need


#: Bits of a number up to 1023.
SIZE_OF = np.array([n.bit_length() for n in range(1024)], dtype=np.int64)


def magnitude(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size, bits) of signed values as JPEG writes them."""
    size = SIZE_OF[np.abs(values)]
    return size, np.where(values < 0, values + (1 << size) - 1, values)


def dc_first(coefficients: np.ndarray, low: int) -> Bits:
    """``coefficients``: DC values (lanes, blocks in a unit) with the component of each column in ``UNIT``."""
    out, v = Bits(len(coefficients)), coefficients >> low
    before = np.zeros_like(v)
    before[:, 1:4] = v[:, :3]  # luma follows luma; chroma is alone in its unit
    size, bits = magnitude(v - before)
    lane = np.repeat(np.arange(len(v)), v.shape[1])
    size, bits = size.ravel(), bits.ravel()
    out.add(lane, np.tile(np.arange(v.shape[1]), len(v)), DC_CODE[size] << size | bits, DC_SIZE[size] + size)
    return out


def ac_first(blocks: np.ndarray, low: int) -> Bits:
    """``blocks``: the band's coefficients (lanes, band)."""
    lanes, width = blocks.shape
    out = Bits(lanes)
    v = np.sign(blocks) * (np.abs(blocks) >> low)
    lane, k = np.nonzero(v)
    new = np.concatenate(([True], lane[1:] != lane[:-1])) if len(lane) else np.zeros(0, dtype=bool)
    run = k - np.where(new, -1, np.concatenate(([0], k[:-1]))) - 1 if len(k) else k
    size, bits = magnitude(v[lane, k])
    symbol = (run & 15) << 4 | size
    out.add(lane, k * 8 + 7, AC_CODE[symbol] << size | bits, AC_SIZE[symbol] + size)
    for more in range(1, int(run.max(initial=0)) // 16 + 1):  # runs of 16 zeros, rare
        far = run >= 16 * more
        out.add(lane[far], k[far] * 8 + more, np.full(far.sum(), AC_CODE[0xF0]), np.full(far.sum(), AC_SIZE[0xF0]))
    open_ = np.flatnonzero(v[:, -1] == 0)
    out.add(open_, np.full(len(open_), width * 8 + 8), np.full(len(open_), AC_CODE[0]), np.full(len(open_), AC_SIZE[0]))
    return out


def ac_refine(blocks: np.ndarray) -> Bits:
    """Last bits: corrections of coefficients known so far, and coefficients that are now 1 or -1."""
    lanes, width = blocks.shape
    out, a = Bits(lanes), np.abs(blocks)
    full = (a > 1).all(1)
    if full.any() and width == 63:
        # one end-of-block symbol (two bits) and 63 corrections, then ones to the byte's end
        bits = np.ones((int(full.sum()), 72), dtype=np.uint8)
        bits[:, 0], bits[:, 1] = FIX_CODE[0] >> 1, FIX_CODE[0] & 1
        bits[:, 2:65] = a[full] & 1
        out.ready = np.flatnonzero(full), np.packbits(bits, axis=1)
    else:
        full[:] = False
    plain = ~(a == 1).any(1) & ~full
    own = np.flatnonzero(plain)
    lane, k = np.nonzero(a[own] > 1)
    # all that was known keeps its place and follows one end-of-block symbol
    unfinished = own
    out.add(unfinished, np.zeros(len(unfinished), dtype=np.int64), np.full(len(unfinished), FIX_CODE[0]), np.full(len(unfinished), FIX_SIZE[0]))
    out.add(own[lane], k + 1, a[own][lane, k] & 1, np.ones(len(k), dtype=np.int64))
    rows = []
    for at in np.flatnonzero(~plain & ~full).tolist():
        waiting, run, order = [], 0, 0
        last = int(np.flatnonzero(a[at] == 1)[-1])

        def put(value, size, at=at):
            nonlocal order
            rows.append((at, order, value, size))
            order += 1

        for i, x in enumerate(a[at].tolist()):
            if not x:
                run += 1
                continue
            while run > 15 and i <= last:
                put(int(FIX_CODE[0xF0]), int(FIX_SIZE[0xF0]))
                for bit in waiting:
                    put(bit, 1)
                waiting, run = [], run - 16
            if x > 1:
                waiting.append(x & 1)
                continue
            put(int(FIX_CODE[run << 4 | 1]), int(FIX_SIZE[run << 4 | 1]))
            put(int(blocks[at, i] > 0), 1)
            for bit in waiting:
                put(bit, 1)
            waiting, run = [], 0
        if run or waiting:
            put(int(FIX_CODE[0]), int(FIX_SIZE[0]))
            for bit in waiting:
                put(bit, 1)
    if rows:
        out.add(*np.array(rows, dtype=np.int64).T)
    return out


def _with_restarts(data: np.ndarray, need: np.ndarray, lanes: list[int]) -> list[bytes]:
    """The bytes of each image's lanes: stuffed, with a restart marker between lanes."""
    owner = np.repeat(np.arange(len(need)), need)
    stuffed = np.bincount(owner, weights=data == 255, minlength=len(need)).astype(np.int64)
    count = np.array(lanes)
    ends = np.cumsum(count)
    number = np.arange(len(need)) - np.repeat(ends - count, count)
    final = np.zeros(len(need), dtype=bool)
    final[ends - 1] = True
    size = need + stuffed + np.where(final, 0, 2)
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    full = (data == 255).astype(np.int64)
    shift = np.cumsum(full) - full
    base = np.cumsum(need) - need
    skipped = np.cumsum(stuffed) - stuffed
    place = start[owner] + np.arange(len(data)) - base[owner] + shift - skipped[owner]
    out[place] = data
    mark = start + need + stuffed
    out[mark[~final]] = 255
    out[mark[~final] + 1] = 0xD0 + number[~final] % 8
    raw, edge = out.tobytes(), [0, *(start + size)[ends - 1].tolist()]
    return [raw[a:b] for a, b in zip(edge, edge[1:], strict=False)]


def write(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload, whose length is a positive multiple of 64."""
    if not payloads:
        return []
    blocks = [len(p) // 64 for p in payloads]
    shapes = [shape_of(b) for b in blocks]
    units = [w * h for w, h in shapes]
    all_ = np.zeros((sum(units) * 6, 64), dtype=np.int16)
    at = 0
    for p, b, u in zip(payloads, blocks, units, strict=True):
        all_[at : at + b] = np.frombuffer(p, dtype=np.uint8).reshape(b, 64).astype(np.int16) - 128
        at += 6 * u
    unit = all_.reshape(-1, 6, 64)
    bodies = []
    for components, first, last, high, low in SCANS:
        per = 4 if components == (0,) else 1
        if first == 0:
            dc = unit[:, :, 0].astype(np.int64)
            bits = Bits(len(dc))
            if high:
                bits.add(np.repeat(np.arange(len(dc)), 6), np.tile(np.arange(6), len(dc)), dc.ravel() & 1, np.ones(dc.size, dtype=np.int64))
            else:
                bits = dc_first(dc, low)
        else:
            own = (luma(unit, shapes) if components == (0,) else unit[:, 3 + components[0]])[:, first : last + 1].astype(np.int64)
            bits = ac_refine(own) if high else ac_first(own, low)
        bodies.append(_with_restarts(*bits.pack(), [u * per for u in units]))
    out = []
    for i, (w, h) in enumerate(shapes):
        frame = struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + b"".join(bytes([c + 1, x << 4 | y, 0]) for c, (x, y) in enumerate(SAMPLING))
        head = b"\xff\xd8" + _segment(0xFE, b"blocks=%d" % blocks[i]) + _segment(0xC2, frame) + TABLES
        out.append(head + b"".join(s + body[i] for s, body in zip(SCAN_HEADS, bodies, strict=True)) + b"\xff\xd9")
    return out


def luma_order(w: int, h: int) -> np.ndarray:
    """Places (unit * 4 + part) of luma blocks in raster order."""
    return np.arange(4 * w * h).reshape(h, w, 2, 2).transpose(0, 2, 1, 3).ravel()


def luma(unit: np.ndarray, shapes: list[tuple[int, int]]) -> np.ndarray:
    flat, at, order = unit[:, :4].reshape(-1, 64), 0, []
    for w, h in shapes:
        order.append(at + luma_order(w, h))
        at += 4 * w * h
    return flat[np.concatenate(order)]


# --- Reading --------------------------------------------------------------------------------------------------------


@dataclass
class Image:
    """A parsed file: its frame, the scans with their entropy-coded bytes, and comments."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, quantisation table
    quantisation: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[tuple] = field(default_factory=list)  # components, first, last, high, low, tables, restart interval
    bodies: list[np.ndarray] = field(default_factory=list)
    comment: bytes = b""

    @property
    def units(self) -> tuple[int, int]:
        across, down = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return -(-self.width // (8 * across)), -(-self.height // (8 * down))


def parse(data: bytes) -> Image:
    image, at = Image(), 2
    raw = np.frombuffer(data, dtype=np.uint8)
    ff = np.flatnonzero(raw[:-1] == 255)
    follow = raw[ff + 1]
    marks = ff[(follow != 0) & ((follow < 0xD0) | (follow > 0xD7))].tolist()
    tables: dict[int, bytes] = {}
    interval = 0
    while data[at + 1] != 0xD9:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quantisation[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker in (0xC0, 0xC1, 0xC2):
            if marker != 0xC2 or body[0] != 8:
                raise ValueError("not a progressive JPEG of 8-bit samples")
            image.height, image.width = struct.unpack(">HH", body[1:5])
            image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            n = body[0]
            names = [c[0] for c in image.components]
            chosen = tuple(names.index(body[1 + 2 * i]) for i in range(n))
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            used = tuple(tables.get(body[2 + 2 * i] & 15 | 16 if first else body[2 + 2 * i] >> 4, b"") for i in range(n))
            end = marks[bisect_left(marks, at)]
            image.scans.append((chosen, first, last, bits >> 4, bits & 15, used, interval))
            image.bodies.append(raw[at:end])
            at = end
    return image


class Reader:
    """Bits of lanes, each with a position of its own."""

    def __init__(self, bodies: list[np.ndarray]):
        data = np.concatenate(bodies)
        owner_start = np.cumsum([0, *[len(b) for b in bodies]])
        ff = np.flatnonzero(data[:-1] == 255)
        nxt = data[ff + 1]
        restart = ff[(nxt >= 0xD0) & (nxt <= 0xD7)]
        keep = np.ones(len(data), dtype=bool)
        keep[ff[nxt == 0] + 1] = False
        keep[restart] = keep[restart + 1] = False
        place = np.cumsum(keep) - keep
        starts = np.sort(np.concatenate((owner_start[:-1], restart + 2)))
        self.lanes_of = np.diff(np.searchsorted(starts, owner_start))
        kept = np.concatenate((data[keep], np.zeros(8, dtype=np.uint8))).astype(np.uint32)
        self.bytes = kept
        self.words = (kept[:-3] << 24 | kept[1:-2] << 16 | kept[2:-1] << 8 | kept[3:]).astype(np.int64)
        self.at = place[np.minimum(starts, len(data) - 1)].astype(np.int64) * 8

    def peek(self, lanes: np.ndarray) -> np.ndarray:
        p = self.at[lanes]
        return self.words[p >> 3] >> (16 - (p & 7)) & 0xFFFF

    def take(self, lanes: np.ndarray, n) -> np.ndarray:
        p = self.at[lanes]
        self.at[lanes] = p + n
        return (self.words[p >> 3] >> (32 - (p & 7) - n)) & ((1 << n) - 1)

    def symbol(self, lanes: np.ndarray, table: np.ndarray) -> np.ndarray:
        found = table[self.peek(lanes)]
        self.at[lanes] += found & 255
        return found >> 8


_LOOKUPS: dict[bytes, np.ndarray] = {}
_VALUES: dict[bytes, tuple[np.ndarray, ...]] = {}


def values_of(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 16 bits ahead that hold a whole coefficient: bits used (0: something else), zeros before it, its value."""
    if body not in _VALUES:
        if len(_VALUES) > 16:
            _VALUES.clear()
        found, ahead = table_of(body), np.arange(1 << 16)
        length, run, size = found & 255, found >> 12, found >> 8 & 15
        whole = (length > 0) & (size > 0) & (length + size <= 16)
        bits = ahead >> np.maximum(16 - length - size, 0) & ((1 << size) - 1)
        _VALUES[body] = np.where(whole, length + size, 0), np.where(whole, run, 0), np.where(whole, extended(bits, size), 0)
    return _VALUES[body]


def table_of(body: bytes) -> np.ndarray:
    if body not in _LOOKUPS:
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        _LOOKUPS[body] = lookup(body)
    return _LOOKUPS[body]


def extended(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)


def read_dc(reader: Reader, scan: tuple, blocks: np.ndarray, columns: list[int], unit_of_lane: np.ndarray, units: np.ndarray, out: np.ndarray) -> None:
    """``blocks``: block numbers (units, columns); lanes read ``units`` units each from ``unit_of_lane``."""
    _, _, _, high, low, tables, _ = scan
    lanes, before = np.arange(len(units)), np.zeros((len(units), max(columns) + 1), dtype=np.int64)
    for step in range(int(units.max(initial=0))):
        lanes = lanes[units[lanes] > step]
        for j, component in enumerate(columns):
            where = blocks[unit_of_lane[lanes] + step, j]
            if high:
                out[where, 0] |= (reader.take(lanes, 1) << low).astype(np.int16)
            else:
                size = reader.symbol(lanes, table_of(tables[sorted(set(columns)).index(component)]))
                before[lanes, component] += extended(reader.take(lanes, size), size)
                out[where, 0] = before[lanes, component] << low


def read_ac(reader: Reader, scan: tuple, first_block: np.ndarray, count: np.ndarray, order: np.ndarray, out: np.ndarray) -> None:
    """Lanes read ``count`` blocks each, ``order[first_block + i]``."""
    _, first, last, high, low, tables, _ = scan
    if not high and count.max(initial=0) <= 1:
        return read_single(reader, tables[0], order[first_block], first, last, low, out)
    table, lanes = table_of(tables[0]), np.arange(len(count))
    block, k, skip = first_block.copy(), np.full(len(count), first), np.zeros(len(count), dtype=np.int64)
    end = first_block + count
    band = np.arange(64)
    while len(lanes):
        ready = skip[lanes] == 0
        own = lanes[ready]
        done = np.zeros(len(count), dtype=bool)
        symbol = reader.symbol(own, table)
        run, size = symbol >> 4, symbol & 15
        ends = (size == 0) & (run < 15)
        stop = own[ends]
        if len(stop):
            n = run[ends]
            skip[stop] = (1 << n) + reader.take(stop, n)
        go, run, size = own[~ends], run[~ends], size[~ends]
        if not high:
            k[go] += run
            value = extended(reader.take(go, size), size)
            some_ = size > 0
            out[order[block[go[some_]]], k[go[some_]]] = value[some_] << low
            k[go] += 1
        elif len(go):
            sign = np.where(size > 0, reader.take(go, np.minimum(size, 1)) * 2 - 1, 0)
            rows = order[block[go]]
            own_band = (band >= k[go][:, None]) & (band <= last)
            zero = (out[rows] == 0) & own_band
            hit = zero & (np.cumsum(zero, axis=1) == run[:, None] + 1)
            target = np.where(hit.any(1), hit.argmax(1), last + 1)
            correct(reader, go, rows, own_band & (band < target[:, None]), low, out)
            put = (sign != 0) & (target <= last)
            out[rows[put], target[put]] = sign[put] << low
            k[go] = target + 1
        done[go[k[go] > last]] = True
        resting = lanes[skip[lanes] > 0]
        if len(resting):
            if high:
                rows = order[block[resting]]
                correct(reader, resting, rows, (band >= k[resting][:, None]) & (band <= last), low, out)
            skip[resting] -= 1
            done[resting] = True
        over = lanes[done[lanes]]
        block[over] += 1
        k[over] = first
        lanes = lanes[block[lanes] < end[lanes]]


def read_single(reader: Reader, body: bytes, rows: np.ndarray, first: int, last: int, low: int, out: np.ndarray) -> None:
    """A first pass over a band where each lane has one block: a coefficient is one lookup."""
    used, runs, values = values_of(body)
    table, words, flat = table_of(body), reader.words, out.reshape(-1)
    at, k, base = reader.at.copy(), np.full(len(rows), first, dtype=np.int64), rows.astype(np.int64) * 64
    while len(at):
        ahead = words[at >> 3] >> (16 - (at & 7)) & 0xFFFF
        n = used[ahead]
        if n.all():
            k += runs[ahead]
            flat[base + k] = values[ahead] << low
            at += n
            k += 1
        else:
            whole = n > 0
            k[whole] += runs[ahead[whole]]
            flat[base[whole] + k[whole]] = values[ahead[whole]] << low
            k[whole] += 1
            at += n
            odd = np.flatnonzero(~whole)
            found = table[ahead[odd]]
            at[odd] += found & 255
            run, size = found >> 12, found >> 8 & 15
            value = extended((words[at[odd] >> 3] >> (32 - (at[odd] & 7) - size)) & ((1 << size) - 1), size)
            at[odd] += size
            k[odd] += run
            some_ = size > 0
            flat[base[odd[some_]] + k[odd[some_]]] = value[some_] << low
            k[odd] += 1
            k[odd[(size == 0) & (run < 15)]] = last + 1  # the block ends
        if (k > last).any():
            stay = k <= last
            at, k, base = at[stay], k[stay], base[stay]


def correct(reader: Reader, lanes: np.ndarray, rows: np.ndarray, where: np.ndarray, low: int, out: np.ndarray) -> None:
    """Read one bit for each known coefficient in ``where`` (lanes x 64) and move it away from zero if it is set."""
    known = where & (out[rows] != 0)
    lane, k = np.nonzero(known)
    per = known.sum(1)
    rank = np.arange(len(lane)) - np.repeat(np.cumsum(per) - per, per)
    p = reader.at[lanes][lane] + rank
    bit = (reader.bytes[p >> 3] >> (7 - (p & 7)).astype(np.uint32)) & 1
    reader.at[lanes] += per
    lane, k = lane[bit == 1], k[bit == 1]
    own = out[rows[lane], k]
    out[rows[lane], k] = own + (np.sign(own) << low).astype(np.int16)


@lru_cache(maxsize=4096)
def scan_order(width: int, height: int, w: int, h: int, across: tuple, components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Blocks in the order of a scan, (units, blocks of a unit), each counted within its component; the components."""
    raster = [np.arange(w * h * across[c][0] * across[c][1]) for c in components]
    if len(components) > 1:
        parts = [r.reshape(h, across[c][1], w, across[c][0]).transpose(0, 2, 1, 3).reshape(w * h, -1) for c, r in zip(components, raster, strict=True)]
        return np.concatenate(parts, axis=1), np.repeat(components, [p.shape[1] for p in parts])
    c = components[0]
    # a scan of one component leaves out blocks beyond the picture's edge
    wide = -(-(-(-width * across[c][0] // max(a for a, _ in across))) // 8)
    high = -(-(-(-height * across[c][1] // max(d for _, d in across))) // 8)
    return raster[0].reshape(h * across[c][1], w * across[c][0])[:high, :wide].reshape(-1, 1), np.array([c])


def coefficients(images: list[Image]) -> list[np.ndarray]:
    """For each component the coefficients (blocks of all images, 64) in zigzag order, each image in raster order.
    The images have the same scans and components."""
    one = images[0]
    shapes = [i.units for i in images]
    across = [(c[1], c[2]) for c in one.components]
    if len(one.components) == 1:
        across = [(1, 1)]
    counts = np.array([[w * h * a * d for a, d in across] for w, h in shapes])
    starts = np.cumsum(counts, axis=0) - counts
    base = np.concatenate(([0], np.cumsum(counts.sum(0))))
    out = np.zeros((int(base[-1]), 64), dtype=np.int16)
    for number, scan in enumerate(one.scans):
        components, first, interval = scan[0], scan[1], scan[6]
        reader = Reader([i.bodies[number] for i in images])
        per_image = []
        for at, image in enumerate(images):
            own, which = scan_order(image.width, image.height, *shapes[at], tuple(across), components)
            per_image.append(own + (base[which] + starts[at, which]))
        order = np.concatenate(per_image)
        sizes = np.array([len(own) for own in per_image])
        step = np.full(len(sizes), interval) if interval else sizes
        begin = np.cumsum(sizes) - sizes
        lanes = reader.lanes_of
        number_in_image = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        offset = number_in_image * np.repeat(step, lanes)
        lane_first = np.repeat(begin, lanes) + offset
        lane_count = np.minimum(np.repeat(step, lanes), np.repeat(sizes, lanes) - offset)
        if first == 0:
            columns = [c for c in components for _ in range(across[c][0] * across[c][1] if len(components) > 1 else 1)]
            read_dc(reader, scan, order, columns, lane_first, lane_count, out)
        else:
            read_ac(reader, scan, lane_first, lane_count, order[:, 0], out)
    return [out[base[c] : base[c + 1]] for c in range(len(one.components))]


def tensors(images: list[Image], found: list[np.ndarray]) -> list[np.ndarray]:
    """RGB tensors (height, width, 3) of unsigned bytes at full resolution."""
    one = images[0]
    planes = []
    for c, blocks in zip(one.components, found, strict=True):
        samples = (blocks.astype(np.float32) * one.quantisation[c[3]]) @ INVERSE + np.float32(128)
        planes.append(np.clip(np.rint(samples), 0, 255).astype(np.float32))
    most = max(c[1] for c in one.components), max(c[2] for c in one.components)
    at, out = [0] * len(planes), []
    for image in images:
        w, h = image.units
        full = []
        for j, c in enumerate(one.components):
            a, d = (c[1], c[2]) if len(planes) > 1 else (1, 1)
            n = w * h * a * d
            own = planes[j][at[j] : at[j] + n].reshape(h * d, w * a, 8, 8).transpose(0, 2, 1, 3).reshape(h * d * 8, w * a * 8)
            at[j] += n
            if len(planes) > 1 and (a, d) != most:
                own = own.repeat(most[1] // d, axis=0).repeat(most[0] // a, axis=1)
            full.append(own[: image.height, : image.width])
        if len(full) == 1:
            rgb = np.stack(full * 3, axis=2)
        else:
            y, cb, cr = full[0], full[1] - 128, full[2] - 128
            rgb = np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), axis=2)
        out.append(np.clip(np.rint(rgb), 0, 255).astype(np.uint8))
    return out


def read(files: list[bytes]) -> list[tuple[Image, list[np.ndarray], np.ndarray]]:
    """(image, coefficients by component, RGB tensor) of each file; files with the same scans are read together."""
    images = [parse(f) for f in files]
    groups: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        groups.setdefault((tuple(image.scans), tuple(image.components), tuple((k, q.tobytes()) for k, q in image.quantisation.items())), []).append(i)
    out: list = [None] * len(files)
    for own in groups.values():
        some = [images[i] for i in own]
        found = coefficients(some)
        rgb = tensors(some, found)
        at = [0] * len(found)
        for i, image, tensor in zip(own, some, rgb, strict=True):
            w, h = image.units
            sizes = [w * h * (c[1] * c[2] if len(found) > 1 else 1) for c in image.components]
            out[i] = (image, [f[a : a + n] for f, a, n in zip(found, at, sizes, strict=True)], tensor)
            at = [a + n for a, n in zip(at, sizes, strict=True)]
    return out


def payload(image: Image, found: list[np.ndarray]) -> bytes:
    """The bytes that ``write`` was given."""
    w, h = image.units
    unit = np.empty((w * h, 6, 64), dtype=np.int16)
    unit.reshape(w * h, 6, 64)[:, :4] = found[0][np.argsort(luma_order(w, h))].reshape(w * h, 4, 64)
    unit[:, 4], unit[:, 5] = found[1], found[2]
    blocks = int(image.comment.partition(b"=")[2])
    return (unit.reshape(-1, 64)[:blocks] + 128).astype(np.uint8).tobytes()
