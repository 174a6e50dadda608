"""Media columns in progressive JPEG: a batched numpy decoder, and an encoder that carries payloads in coefficients.

The decoder takes any baseline-precision progressive file (SOF2, 8 bits, 1 to 4 components, integer sampling
ratios): it accumulates DC and AC scans, first passes and refinements, in coefficient arrays, inverts the
transform, upsamples chroma and gives RGB tensors of full resolution. All restart segments of all images of a
batch that have the same scan parameters and tables are lanes that are decoded in step, so numpy works on
thousands of segments at a time; an image without restart markers is a single lane. The transform runs on
integers held in float64, so a tensor does not depend on what it was batched with.

The encoder stores bytes without loss as coefficients, 64 a block in zigzag order: the DC coefficient is
byte + 256, an AC coefficient has the size 128 + (byte mod 128) and the sign of byte >= 128. 4:2:0 sampling;
blocks go to luma, then to the two chroma planes, the rest is filled with byte 0. Scans: DC first pass, two
luma bands and one band for each chroma plane with one bit held back, then refinements of all.

`store_media` writes the files as a binary column, and `media_digests` reads that column back: payloads from the
coefficients, and the tensors themselves as a column beside what is computed from them. The query's own files are
plain on purpose (one code a table, a restart after every block), so that thousands of segments run in step; the
decoder takes run-length codes, prediction across blocks and runs of ended bands as well.

Defined results: a null text is empty; an empty payload is padded to one block; rows alike give rows alike; media
of broken form raise MediaError; an empty table gives no rows; columns other than doc_id and text do not matter.
Batches are worked off in chunks of about CHUNK_BYTES.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tilewright.llm.columns import byte_sizes
from tilewright.llm.common import Scratch, chunks, tidy

BLOCK, MCU_BLOCKS = 64, 6
WIDTH_MCUS, HEIGHT_MCUS = 32, 4000
CHUNK_BYTES = 3_000_000


class MediaError(ValueError):
    """A media value that breaks its format."""


def _zigzag() -> np.ndarray:
    """Natural index of each zigzag place."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


def _inverse_matrix() -> np.ndarray:
    """Zigzag coefficients -> samples, times 2 ** 14, in whole numbers."""
    basis = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
    whole = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)  # row: 8 * vertical + horizontal frequency
    return np.rint(whole[ZIGZAG] * (1 << 14))


INVERSE = _inverse_matrix()


# ---- encoder ----------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code_table(kind: int, name: int, symbol: int) -> bytes:
    """A Huffman table of one symbol, code 0."""
    return bytes([kind << 4 | name, 1]) + bytes(15) + bytes([symbol])


_TABLES = _segment(0xDB, bytes(1) + b"\1" * 64)
_CODES = _segment(0xC4, _one_code_table(0, 0, 8) + _one_code_table(1, 0, 7) + _one_code_table(1, 1, 0)) + _segment(0xDD, struct.pack(">H", 1))
#: (component, first, last, high, low) of each scan; component 0 is luma.
SCRIPT = (
    (0, 0, 0, 0, 1), (1, 0, 0, 0, 1), (2, 0, 0, 0, 1),
    (0, 1, 5, 0, 1), (0, 6, 63, 0, 1), (1, 1, 63, 0, 1), (2, 1, 63, 0, 1),
    (0, 1, 63, 1, 0), (1, 1, 63, 1, 0), (2, 1, 63, 1, 0),
    (0, 0, 0, 1, 0), (1, 0, 0, 1, 0), (2, 0, 0, 1, 0),
)


def _scan_header(component: int, first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([1, component + 1, 1 if first and high else 0, first, last, high << 4 | low]))


_SCAN_HEADERS = [_scan_header(*x) for x in SCRIPT]


def _entropy(blocks: np.ndarray, first: int, last: int, high: int) -> np.ndarray:
    """The entropy-coded bytes of each block (a row of bytes of payload) in one scan, before stuffing."""
    if first == 0:
        if high:
            return ((blocks[:, :1] & 1) << 7) | 0x7F
        v = blocks[:, 0].astype(np.int32) + 256
        return np.stack([v >> 2, ((v >> 1) & 1) << 7 | 0x7F], axis=1).astype(np.uint8)
    if high:
        bits = np.concatenate([np.zeros((len(blocks), 1), np.uint8), blocks[:, 1:] & 1], axis=1)
        return np.packbits(bits, axis=1)
    band = blocks[:, first : last + 1]
    size = 64 + ((band & 127) >> 1)
    return np.where(band >= 128, size, size ^ 0x7F).astype(np.uint8)


def grid(payload_bytes: int) -> tuple[int, int]:
    """(columns, rows) of MCUs for a payload."""
    mcus = max(1, -(-payload_bytes // (BLOCK * MCU_BLOCKS)))
    rows = min(HEIGHT_MCUS, -(-mcus // WIDTH_MCUS))
    columns = -(-mcus // rows)
    return columns, -(-mcus // columns)


def encode(payloads: list[bytes], notes: list[bytes]) -> list[bytes]:
    """Progressive JPEG files that carry the payloads (each a positive multiple of 64 bytes) and a comment each."""
    grids = [grid(len(p)) for p in payloads]
    planes: tuple[list, list, list] = ([], [], [])
    for payload, (columns, rows) in zip(payloads, grids):
        n = columns * rows
        whole = np.zeros((MCU_BLOCKS * n, BLOCK), np.uint8)
        whole.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
        for plane, part in zip(planes, (whole[: 4 * n], whole[4 * n : 5 * n], whole[5 * n :])):
            plane.append(part)
    stacked = [np.concatenate(p) for p in planes]
    counts = [np.array([len(x) for x in p]) for p in planes]
    scans: list[list[bytes]] = []
    for component, first, last, high, _ in SCRIPT:
        body = _entropy(stacked[component], first, last, high)
        n = counts[component]
        starts = np.cumsum(n) - n
        restart = (np.arange(len(body)) - np.repeat(starts, n)) % 8
        flat = np.concatenate([body, np.full((len(body), 1), 0xFF, np.uint8), (0xD0 + restart[:, None]).astype(np.uint8)], axis=1)
        stuffed = flat == 0xFF
        stuffed[:, -2] = False
        sizes = flat.shape[1] + stuffed.sum(axis=1)
        stuffed = stuffed.ravel()
        out = np.zeros(sizes.sum(), np.uint8)
        out[np.arange(flat.size) + np.cumsum(stuffed) - stuffed] = flat.ravel()
        ends = np.cumsum(np.add.reduceat(sizes, starts))
        data = out.tobytes()
        scans.append([data[a : b - 2] for a, b in zip([0, *ends.tolist()], ends.tolist())])
    files = []
    for i, (columns, rows) in enumerate(grids):
        frame = _segment(0xC2, struct.pack(">BHHB", 8, 16 * rows, 16 * columns, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        parts = [b"\xff\xd8", _segment(0xFE, notes[i]), _TABLES, frame, _CODES]
        for header, scan in zip(_SCAN_HEADERS, scans):
            parts += [header, scan[i]]
        files.append(b"".join([*parts, b"\xff\xd9"]))
    return files


# ---- decoder ----------------------------------------------------------------------------------------------


@dataclass
class Component:
    name: int
    h: int
    v: int
    table: int
    base: int = 0  # first block among those of the batch
    across: int = 0  # blocks in a row, whole MCUs
    wide: int = 0  # blocks in a row and rows that hold samples
    high: int = 0


@dataclass
class Scan:
    components: list[int]
    tables: tuple  # code tables as bytes: DC and AC for each component
    first: int
    last: int
    high: int
    low: int
    restart: int
    start: int
    end: int


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comments: list[bytes] = field(default_factory=list)


_LUTS: dict[bytes, np.ndarray] = {}


def _lut(table: bytes) -> np.ndarray:
    """Of each 16 bits ahead: code length * 256 + symbol; 0 where no code fits."""
    if table not in _LUTS:
        lut, code, at = np.zeros(1 << 16, np.int32), 0, 16
        for size in range(1, 17):
            for _ in range(table[size - 1]):
                lut[code << (16 - size) : (code + 1) << (16 - size)] = size << 8 | table[at]
                code, at = code + 1, at + 1
            code <<= 1
        _LUTS[table] = lut
    return _LUTS[table]


def _parse(data: bytes, offset: int, markers: np.ndarray) -> Image:
    """The headers and scans of one file, which stands at `offset` of the batch's bytes."""
    image, dc, ac, restart, at = Image(), {}, {}, 0, 2
    if data[:2] != b"\xff\xd8":
        raise MediaError("no start of image")
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 2 > len(data) or data[at] != 0xFF:
            raise MediaError("no marker where one is due")
        marker = data[at + 1]
        if marker == 0xD9:
            return image
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            p = 0
            while p < len(body):
                wide = body[p] >> 4
                image.quant[body[p] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, p + 1).astype(np.float64)
                p += 1 + (128 if wide else 64)
        elif marker == 0xC4:
            p = 0
            while p < len(body):
                n = sum(body[p + 1 : p + 17])
                (ac if body[p] >> 4 else dc)[body[p] & 15] = body[p + 1 : p + 17 + n]
                p += 17 + n
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xC2:
            bits, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not n or not image.height or not image.width:
                raise MediaError("a frame of another kind")
            image.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise MediaError("not progressive with Huffman codes")
        elif marker == 0xDA:
            n = body[0]
            names = [c.name for c in image.components]
            picked = [names.index(body[1 + 2 * i]) for i in range(n)]
            tables = tuple((dc.get(body[2 + 2 * i] >> 4), ac.get(body[2 + 2 * i] & 15)) for i in range(n))
            first, last, steps = body[1 + 2 * n : 4 + 2 * n]
            i = np.searchsorted(markers, offset + at)
            if i == len(markers):
                raise MediaError("a scan without an end")
            end = int(markers[i]) - offset
            image.scans.append(Scan(picked, tables, first, last, steps >> 4, steps & 15, restart, offset + at, offset + end))
            at = end


def _units(image: Image, scan: Scan) -> np.ndarray:
    """Block numbers in the order of the scan; an interleaved scan has a row for each MCU."""
    if len(scan.components) == 1:
        c = image.components[scan.components[0]]
        return (c.base + np.arange(c.high)[:, None] * c.across + np.arange(c.wide)).reshape(-1, 1)
    top_h, top_v = max(c.h for c in image.components), max(c.v for c in image.components)
    columns, rows = -(-image.width // (8 * top_h)), -(-image.height // (8 * top_v))
    parts = []
    for i in scan.components:
        c = image.components[i]
        for y in range(c.v):
            for x in range(c.h):
                parts.append((c.base + (np.arange(rows)[:, None] * c.v + y) * c.across + np.arange(columns) * c.h + x).ravel())
    return np.stack(parts, axis=1)


class _Lanes:
    """Entropy-coded segments that are decoded in step."""

    def __init__(self, words: np.ndarray, at: np.ndarray, end: np.ndarray):
        self.words, self.at, self.end = words, at, end

    def ahead(self, lanes: np.ndarray) -> np.ndarray:
        at = self.at[lanes]
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def symbols(self, lanes: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, code length, what is ahead of the code) of each lane; the code isn't consumed yet."""
        ahead = self.ahead(lanes)
        found = lut[(ahead >> np.uint64(48)).astype(np.int32)]
        if not found.all():
            raise MediaError("a code that is in no table")
        return found & 255, found >> 8, ahead


def _bits(ahead: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n bits (0 to 32) after the first `skip` of what is ahead."""
    return (((ahead << skip.astype(np.uint64)) >> np.uint64(32)) >> (32 - n).astype(np.uint64)).astype(np.int64)


def _extend(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << np.maximum(n - 1, 0)), bits - (1 << n) + 1, bits)


def _scan(coefs: np.ndarray, lanes: _Lanes, units: np.ndarray, counts: np.ndarray, scan: Scan, slots: list[int]) -> None:
    """One scan of all lanes. units: lanes x most units of a lane x blocks of an MCU; counts: units of each lane."""
    every = np.arange(len(counts))
    run = np.zeros(len(counts), np.int64)
    before = np.zeros((len(counts), len(scan.components)), np.int64)
    for u in range(units.shape[1]):
        here = every[counts > u] if u else every
        for j in range(units.shape[2]):
            blocks, slot = units[here, u, j], slots[j]
            if scan.first == 0 and not scan.high:
                size, length, ahead = lanes.symbols(here, _lut(scan.tables[slot][0]))
                before[here, slot] += _extend(_bits(ahead, length, size), size)
                lanes.at[here] += length + size
                coefs[blocks, 0] = before[here, slot] << scan.low
            elif scan.first == 0:
                coefs[blocks, 0] |= ((lanes.ahead(here) >> np.uint64(63)) << np.uint64(scan.low)).astype(np.int16)
                lanes.at[here] += 1
            elif not scan.high:
                _ac_first(coefs, lanes, here, blocks, run, scan)
            else:
                _ac_refine(coefs, lanes, here, blocks, run, scan)
    if (lanes.at > lanes.end).any():
        raise MediaError("a segment shorter than its blocks")


def _ac_first(coefs, lanes: _Lanes, here: np.ndarray, blocks: np.ndarray, run: np.ndarray, scan: Scan) -> None:
    waiting = run[here] > 0
    if waiting.any():
        run[here[waiting]] -= 1
        here, blocks = here[~waiting], blocks[~waiting]
    k, lut = np.full(len(here), scan.first), _lut(scan.tables[0][1])
    while len(here):
        symbol, length, ahead = lanes.symbols(here, lut)
        zeros, size = symbol >> 4, symbol & 15
        plain = size > 0
        if plain.all():
            k += zeros
            if k.max() > scan.last:
                raise MediaError("a coefficient beyond its band")
            coefs[blocks, k] = _extend(_bits(ahead, length, size), size) << scan.low
            lanes.at[here] += length + size
            k += 1
        else:
            stop = ~plain & (zeros < 15)
            extra = np.where(stop, zeros, size)
            bits = _bits(ahead, length, extra)
            lanes.at[here] += length + extra
            run[here[stop]] = (1 << zeros[stop]) + bits[stop] - 1
            k += np.where(plain, zeros, 16)
            if (k[plain] > scan.last).any():
                raise MediaError("a coefficient beyond its band")
            coefs[blocks[plain], k[plain]] = _extend(bits[plain], size[plain]) << scan.low
            k[plain] += 1
            k[stop] = 64
        if k.max(initial=0) > scan.last:
            going = k <= scan.last
            here, blocks, k = here[going], blocks[going], k[going]


def _ac_refine(coefs, lanes: _Lanes, here: np.ndarray, blocks: np.ndarray, run: np.ndarray, scan: Scan) -> None:
    lut, bit = _lut(scan.tables[0][1]), 1 << scan.low
    places = np.arange(64)
    k = np.full(len(here), scan.first)
    while len(here):
        # what comes next for each lane: the rest of a run of ended bands, or a symbol
        ended = run[here] > 0
        skip, value = np.full(len(here), 64), np.zeros(len(here), np.int64)
        ask = np.flatnonzero(~ended)
        if len(ask):
            who = here[ask]
            symbol, length, ahead = lanes.symbols(who, lut)
            zeros, size = symbol >> 4, symbol & 15
            if (size > 1).any():
                raise MediaError("a new coefficient of more than a bit")
            stop = (size == 0) & (zeros < 15)
            extra = np.where(stop, zeros, size)
            bits = _bits(ahead, length, extra)
            lanes.at[who] += length + extra
            run[who[stop]] = (1 << zeros[stop]) + bits[stop]
            skip[ask] = np.where(stop, 64, zeros)
            value[ask] = np.where(size == 1, np.where(bits > 0, bit, -bit), 0)
        held = coefs[blocks]
        open_ = (places >= k[:, None]) & (places <= scan.last)
        known = open_ & (held != 0)
        empty = open_ & (held == 0)
        order = np.cumsum(empty, axis=1)
        target = np.where((order == skip[:, None] + 1).any(axis=1), (order > skip[:, None]).argmax(axis=1), scan.last + 1)
        known &= places < target[:, None]
        row, col = np.nonzero(known)
        if len(row):
            number = np.cumsum(known, axis=1)[row, col] - 1
            at = lanes.at[here][row] + number
            set_ = ((lanes.words[at >> 3] << (at & 7).astype(np.uint64)) >> np.uint64(63)).astype(np.int16)
            old = held[row, col]
            coefs[blocks[row], col] = old + np.where((set_ == 1) & ((np.abs(old) & bit) == 0), np.sign(old) * bit, 0).astype(np.int16)
            lanes.at[here] += known.sum(axis=1)
        new = (value != 0) & (target <= scan.last)
        coefs[blocks[new], target[new]] = value[new]
        k = target + 1
        over = run[here] > 0
        run[here[over]] -= 1
        k[over] = 64
        going = k <= scan.last
        here, blocks, k = here[going], blocks[going], k[going]


def coefficients(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """The parsed images of a batch, and all their blocks' coefficients in zigzag order."""
    whole = np.frombuffer(b"".join(files), np.uint8)
    mark = np.flatnonzero(whole[:-1] == 0xFF)
    after = whole[mark + 1]
    restarts = mark[(after >= 0xD0) & (after <= 0xD7)]
    markers = mark[(after != 0) & (after != 0xFF) & ((after < 0xD0) | (after > 0xD7))]
    images, offset, blocks = [], 0, 0
    for data in files:
        image = _parse(data, offset, markers)
        offset += len(data)
        if not image.components:
            raise MediaError("no frame")
        top_h, top_v = max(c.h for c in image.components), max(c.v for c in image.components)
        for c in image.components:
            if top_h % c.h or top_v % c.v:
                raise MediaError("a sampling ratio that is no whole number")
            c.across = -(-image.width // (8 * top_h)) * c.h
            c.wide = -(-image.width * c.h // (8 * top_h))
            c.high = -(-image.height * c.v // (8 * top_v))
            c.base = blocks
            blocks += c.across * -(-image.height // (8 * top_v)) * c.v
        images.append(image)
    coefs = np.zeros((blocks, 64), np.int16)
    keep = np.ones(len(whole), bool)
    keep[mark[after == 0] + 1] = False
    place = np.concatenate([[0], np.cumsum(keep)])
    clean = np.concatenate([whole[keep], np.full(16, 0xFF, np.uint8)])
    words = np.zeros(len(clean) - 8, np.uint64)
    for j in range(8):
        words |= clean[j : j + len(words)].astype(np.uint64) << np.uint64(56 - 8 * j)
    for step in range(max(len(i.scans) for i in images)):
        groups: dict[tuple, list[tuple[Image, Scan]]] = {}
        for image in images:
            if step < len(image.scans):
                s = image.scans[step]
                shape = tuple((image.components[i].h, image.components[i].v) for i in s.components) if len(s.components) > 1 else ()
                groups.setdefault((s.tables, s.first, s.last, s.high, s.low, tuple(s.components), shape, bool(s.restart)), []).append((image, s))
        for members in groups.values():
            _decode_group(members, coefs, words, place, restarts)
    return images, coefs


def _decode_group(members: list[tuple[Image, Scan]], coefs: np.ndarray, words: np.ndarray, place: np.ndarray, restarts: np.ndarray) -> None:
    starts, ends, rows, counts = [], [], [], []
    for image, scan in members:
        units = _units(image, scan)
        each = scan.restart or len(units)
        inner = restarts[np.searchsorted(restarts, scan.start) : np.searchsorted(restarts, scan.end)]
        n = -(-len(units) // each)
        if len(inner) != n - 1:
            raise MediaError(f"{len(inner)} restart markers where {n - 1} are due")
        starts.append(np.concatenate([[scan.start], inner + 2]))
        ends.append(np.concatenate([inner, [scan.end]]))
        rows.append(units)
        counts.append(np.minimum(each, len(units) - each * np.arange(n)))
    counts_all = np.concatenate(counts)
    flat = np.concatenate(rows)
    most = int(counts_all.max())
    index = (np.cumsum(counts_all) - counts_all)[:, None] + np.arange(most)
    units = flat[np.minimum(index, len(flat) - 1)]
    image, scan = members[0]
    slots = [j for j, i in enumerate(scan.components) for _ in range(image.components[i].h * image.components[i].v)] if len(scan.components) > 1 else [0]
    lanes = _Lanes(words, place[np.concatenate(starts)] * 8, place[np.concatenate(ends)] * 8)
    _scan(coefs, lanes, units, counts_all, scan, slots)


def tensors(images: list[Image], coefs: np.ndarray) -> list[np.ndarray]:
    """Full-resolution RGB tensors, height x width x 3 bytes."""
    out = []
    first = images[0]
    same = all(i.quant.keys() == first.quant.keys() and all((i.quant[k] == first.quant[k]).all() for k in i.quant) and [c.table for c in i.components] == [c.table for c in first.components] for i in images[1:]) and len({c.table for c in first.components}) == 1
    shared = _samples(coefs, first.quant[first.components[0].table]) if same else None
    for image in images:
        top_h, top_v = max(c.h for c in image.components), max(c.v for c in image.components)
        planes = []
        for c in image.components:
            n = c.across * -(-image.height // (8 * top_v)) * c.v
            part = shared[c.base : c.base + n] if same else _samples(coefs[c.base : c.base + n], image.quant[c.table])
            plane = part.reshape(-1, c.across, 8, 8).swapaxes(1, 2).reshape(-1, 8 * c.across)
            for axis, ratio in ((0, top_v // c.v), (1, top_h // c.h)):
                if ratio > 1:
                    plane = plane.repeat(ratio, axis)
            planes.append(plane[: image.height, : image.width])
        out.append(_rgb(planes))
    return out


def _samples(coefs: np.ndarray, quant: np.ndarray) -> np.ndarray:
    value = coefs.astype(np.float64) @ (INVERSE * quant[:, None])
    value *= 2.0**-14
    value += 128.5
    np.floor(value, out=value)
    return np.clip(value, 0, 255, out=value).astype(np.uint8)


def _rgb(planes: list[np.ndarray]) -> np.ndarray:
    if len(planes) != 3:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y, cb, cr = planes[0].astype(np.int32), planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    out = np.empty((*y.shape, 3), np.uint8)
    for i, value in enumerate((y + ((91881 * cr + 32768) >> 16), y - ((22554 * cb + 46802 * cr + 32768) >> 16), y + ((116130 * cb + 32768) >> 16))):
        out[:, :, i] = np.clip(value, 0, 255)
    return out


def payload_of(image: Image, coefs: np.ndarray, size: int) -> bytes:
    """The payload that the encoder put in an image's coefficients."""
    end = image.components[-1]
    blocks = coefs[image.components[0].base : end.base + end.across * -(-image.height // (8 * max(c.v for c in image.components))) * end.v][: size // BLOCK]
    values = (np.abs(blocks) & 127).astype(np.uint8) | (blocks > 0).astype(np.uint8) << 7
    values[:, 0] = (blocks[:, 0] - 256).astype(np.uint8)
    return values.tobytes()


# ---- columns ----------------------------------------------------------------------------------------------


def padded(data: bytes) -> bytes:
    """data and bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text's bytes as a progressive JPEG; its comment holds the unpadded and padded sizes."""

    def run(batches):
        for batch in batches:
            names, column = batch.column("doc_id"), batch.column("text")
            for a, b in chunks(byte_sizes(column), CHUNK_BYTES):
                raw = [x or b"" for x in column.slice(a, b - a).cast(pa.large_binary()).to_pylist()]
                payloads = [padded(x) for x in raw]
                files = encode(payloads, [struct.pack(">QQ", len(x), len(p)) for x, p in zip(raw, payloads)])
                yield pa.RecordBatch.from_arrays([names.slice(a, b - a), pa.array(files, pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, media binary")


def store_media(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """`encode_texts` as a table of the shared folder, read back."""
    return scratch.write(encode_texts(docs), "media", compression="zstd")


def decode_media(media: DataFrame) -> DataFrame:
    """(doc_id, media) of any progressive files -> doc_id, height, width, rgb (height x width x 3 bytes)."""

    def run(batches):
        for batch in batches:
            names, files = batch.column("doc_id"), batch.column("media").to_pylist()
            for a, b in chunks([len(x) for x in files], CHUNK_BYTES):
                found = tensors(*coefficients(files[a:b]))
                yield pa.RecordBatch.from_arrays([names.slice(a, b - a), pa.array([x.shape[0] for x in found], pa.int32()), pa.array([x.shape[1] for x in found], pa.int32()), pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "height", "width", "rgb"])

    return media.select("doc_id", "media").mapInArrow(tidy(run), "doc_id long, height int, width int, rgb binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, rgb binary"


def media_digests(media: DataFrame) -> DataFrame:
    """DIGEST of media that encode_texts made: payloads read back from coefficients, RGB tensors and features of these."""
    names = [x.split()[0] for x in DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches):
        for batch in batches:
            ids, column = batch.column("doc_id").to_pylist(), batch.column("media")
            for a, b in chunks(byte_sizes(column), CHUNK_BYTES):
                rows, files = [], column.slice(a, b - a).to_pylist()
                images, coefs = coefficients(files)
                for name, data, image, rgb in zip(ids[a:b], files, images, tensors(images, coefs)):
                    n, size = struct.unpack(">QQ", image.comments[0])
                    payload = payload_of(image, coefs, size)
                    means = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (rgb.shape[0] * rgb.shape[1])
                    feature = f"{rgb.shape[1]}x{rgb.shape[0]} " + " ".join(f"{x:.3f}" for x in means)
                    rows.append((name, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature, *rgb.shape[:2], rgb.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    return media.select("doc_id", "media").mapInArrow(tidy(run), DIGEST)
