"""The batched decoder against progressive files from a plain encoder of one coefficient at a time."""

import random
import struct

import numpy as np
import pytest

from tilewright.llm import media


class Bits:
    def __init__(self):
        self.out, self.held, self.n = bytearray(), 0, 0

    def put(self, value, size):
        for i in reversed(range(size)):
            self.held = self.held << 1 | value >> i & 1
            self.n += 1
            if self.n == 8:
                self.out.append(self.held)
                if self.held == 0xFF:
                    self.out.append(0)
                self.held = self.n = 0

    def end(self):
        while self.n:
            self.put(1, 1)
        return bytes(self.out)


SYMBOLS = list(range(256))
TABLE = bytes([0] * 8 + [255, 1] + [0] * 6) + bytes(SYMBOLS)  # 255 codes of 9 bits and one of 10


def code(symbol):
    return (symbol, 9) if symbol < 255 else (2 * 255, 10)


def magnitude(v):
    size = abs(v).bit_length()
    return size, v if v >= 0 else v + (1 << size) - 1


def ac_first(bits, blocks, first, last, low):
    run = 0

    def flush():
        nonlocal run
        if run:
            r = run.bit_length() - 1
            bits.put(*code(r << 4))
            bits.put(run - (1 << r), r)
            run = 0

    for block in blocks:
        zeros = 0
        for k in range(first, last + 1):
            v = int(np.sign(block[k])) * (abs(int(block[k])) >> low)
            if not v:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                bits.put(*code(0xF0))
                zeros -= 16
            size, extra = magnitude(v)
            bits.put(*code(zeros << 4 | size))
            bits.put(extra, size)
            zeros = 0
        if zeros:
            run += 1
            if run == 0x7FFF:
                flush()
    flush()


def ac_refine(bits, blocks, first, last, low):
    run, kept = 0, []

    def flush():
        nonlocal run, kept
        if run:
            r = run.bit_length() - 1
            bits.put(*code(r << 4))
            bits.put(run - (1 << r), r)
        for b in kept:
            bits.put(b, 1)
        run, kept = 0, []

    for block in blocks:
        v = [abs(int(x)) >> low for x in block]
        end = max((k for k in range(first, last + 1) if v[k] == 1), default=first - 1)
        zeros, held = 0, []
        for k in range(first, last + 1):
            if v[k] > 1:
                if zeros > 15 and k <= end:
                    pass
                held.append(v[k] & 1)
                continue
            if v[k] == 0:
                if k <= end:
                    zeros += 1
                    if zeros == 16:
                        rest = [j for j in range(k + 1, end + 1)]
                        if rest:
                            flush()
                            bits.put(*code(0xF0))
                            for b in held:
                                bits.put(b, 1)
                            zeros, held = 0, []
                continue
            flush()
            bits.put(*code(zeros << 4 | 1))
            bits.put(1 if block[k] > 0 else 0, 1)
            for b in held:
                bits.put(b, 1)
            zeros, held = 0, []
        if end < last:
            run += 1
            kept += held
    flush()


def write(width, height, sampling, planes, quant, restart, script):
    """planes: blocks of each component, padded to whole MCUs, row by row."""
    top_h, top_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    columns, rows = -(-width // (8 * top_h)), -(-height // (8 * top_v))
    seg = media._segment
    out = [b"\xff\xd8", seg(0xDB, b"\0" + bytes(quant)), seg(0xC2, struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))]
    out += [seg(0xC4, b"\x00" + TABLE + b"\x10" + TABLE), seg(0xDD, struct.pack(">H", restart))]
    for comps, first, last, high, low in script:
        units = []
        if len(comps) == 1:
            h, v = sampling[comps[0]]
            across, wide, tall = columns * h, -(-width * h // (8 * top_h)), -(-height * v // (8 * top_v))
            units = [[(comps[0], y * across + x)] for y in range(tall) for x in range(wide)]
        else:
            units = [[(c, (my * sampling[c][1] + y) * columns * sampling[c][0] + mx * sampling[c][0] + x) for c in comps for y in range(sampling[c][1]) for x in range(sampling[c][0])] for my in range(rows) for mx in range(columns)]
        out.append(seg(0xDA, bytes([len(comps)]) + b"".join(bytes([c + 1, 0]) for c in comps) + bytes([first, last, high << 4 | low])))
        step = restart or len(units)
        for n, at in enumerate(range(0, len(units), step)):
            bits, part = Bits(), units[at : at + step]
            if first == 0:
                before = dict.fromkeys(comps, 0)
                for unit in part:
                    for c, i in unit:
                        dc = int(planes[c][i][0])
                        if high:
                            bits.put(dc >> low & 1, 1)
                        else:
                            size, extra = magnitude((dc >> low) - before[c])
                            before[c] = dc >> low
                            bits.put(*code(size))
                            bits.put(extra, size)
            else:
                (ac_refine if high else ac_first)(bits, [planes[c][i] for unit in part for c, i in unit], first, last, low)
            if n:
                out.append(bytes([0xFF, 0xD0 + (n - 1) % 8]))
            out.append(bits.end())
    return b"".join([*out, b"\xff\xd9"])


SCRIPT = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 2), ((2,), 1, 63, 0, 1), ((1,), 1, 63, 0, 1), ((0,), 6, 63, 0, 2), ((0,), 1, 63, 2, 1), ((0, 1, 2), 0, 0, 1, 0), ((2,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((0,), 1, 63, 1, 0)]


def picture(rng, width, height, sampling, restart, dense):
    top_h, top_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    columns, rows = -(-width // (8 * top_h)), -(-height // (8 * top_v))
    planes = []
    for h, v in sampling:
        blocks = np.zeros((columns * h * rows * v, 64), int)
        for block in blocks:
            block[0] = rng.randint(-300, 300)
            for k in range(1, 64):
                if rng.random() < dense:
                    block[k] = rng.choice([1, -1, 2, -3, 5, -9, 40])
        planes.append(blocks)
    quant = [rng.randint(1, 9) for _ in range(64)]
    return planes, quant, write(width, height, sampling, planes, quant, restart, SCRIPT)


def in_scan_order(image, planes, sampling):
    """Blocks that hold samples; a non-interleaved scan leaves the AC part of the others empty."""
    return [(c.base, c.across, c.wide, c.high, plane) for c, plane in zip(image.components, planes)]


@pytest.mark.parametrize("restart", [0, 1, 3])
@pytest.mark.parametrize("dense", [0.0, 0.04, 0.3])
def test_scans_accumulate(restart, dense):
    rng = random.Random(100 * dense + restart)
    made = []
    for width, height, sampling in ((16, 16, ((2, 2), (1, 1), (1, 1))), (37, 21, ((2, 2), (1, 1), (1, 1))), (30, 9, ((2, 1), (1, 1), (1, 1))), (17, 40, ((1, 1), (1, 1), (1, 1)))):
        made.append((width, height, sampling, *picture(rng, width, height, sampling, restart, dense)))
    images, coefs = media.coefficients([m[-1] for m in made])
    for image, (width, height, sampling, planes, quant, _) in zip(images, made):
        assert (image.width, image.height) == (width, height)
        for c, plane in zip(image.components, planes):
            for y in range(c.high):
                for x in range(c.wide):
                    assert (coefs[c.base + y * c.across + x] == plane[y * c.across + x]).all()
    for rgb, (width, height, *_) in zip(media.tensors(images, coefs), made):
        assert rgb.shape == (height, width, 3)


def test_samples_are_the_inverse_transform():
    rng = np.random.default_rng(3)
    coefs = rng.integers(-60, 60, (5, 64)).astype(np.int16)
    quant = rng.integers(1, 4, 64).astype(np.float64)
    natural = np.zeros((5, 64))
    natural[:, media.ZIGZAG] = coefs * quant
    basis = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
    want = np.clip(np.floor(np.einsum("nuv,ux,vy->nxy", natural.reshape(5, 8, 8), basis, basis).reshape(5, 64) + 128.5), 0, 255)
    assert np.abs(media._samples(coefs, quant).astype(int) - want).max() <= 1


def test_broken_media():
    good = media.encode([bytes(64)], [bytes(16)])[0]
    for bad in (b"", b"no image", good[:200], good[:-2], good.replace(b"\xff\xc2", b"\xff\xc0")):
        with pytest.raises((media.MediaError, IndexError, ValueError, struct.error)):
            media.coefficients([bad])
