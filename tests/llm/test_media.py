"""JPEGs of a plain encoder (colour, subsampling, restart markers, odd sizes) in the operator's decoder, and the operator's JPEGs in a plain decoder."""

import random
import struct

import pytest

pytest.importorskip("matchloom.llm")

import numpy as np

from matchloom.llm import jpeg

#: A Huffman table of its own kind: 4 codes of 3 bits and more of 8, for DC sizes and AC symbols.
DC_COUNTS, DC_SYMBOLS = [0, 0, 4, 0, 0, 0, 0, 8] + [0] * 8, list(range(12))
AC_SYMBOLS = [0x00, 0x01, 0x02, 0xF0, 0x11, 0x12, 0x21, 0x03, 0x13, 0x04, 0x22, 0x51]


def codes_of(counts, symbols):
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = format(code, f"0{length}b")
            code, at = code + 1, at + 1
        code <<= 1
    return out


def bits_of(v):
    return "" if v == 0 else format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b")


def plain_encode(width, height, parts, quantisation, interval, planes):
    """``parts``: (h, v) of each component; ``planes``: its blocks by (row, column) as 64 coefficients in zigzag order."""
    dc, ac = codes_of(DC_COUNTS, DC_SYMBOLS), codes_of(DC_COUNTS, AC_SYMBOLS)
    hm, vm = max(h for h, _ in parts), max(v for _, v in parts)
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    seg = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0extra") + seg(0xDB, bytes([0]) + bytes(quantisation))
    head += seg(0xC0, struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(parts)))
    head += seg(0xC4, bytes([0, *DC_COUNTS, *DC_SYMBOLS])) + seg(0xC4, bytes([0x10, *DC_COUNTS, *AC_SYMBOLS])) + (seg(0xDD, struct.pack(">H", interval)) if interval else b"")
    head += seg(0xDA, bytes([len(parts)]) + b"".join(bytes([i + 1, 0]) for i in range(len(parts))) + bytes([0, 63, 0]))
    out, bits, last, n = bytearray(), "", [0] * len(parts), 0

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        for k in range(0, len(bits), 8):
            out.append(int(bits[k : k + 8], 2))
            if out[-1] == 0xFF:
                out.append(0)

    units = [(0, 0, r, c) for r in range(-(-height // 8)) for c in range(-(-width // 8))] if len(parts) == 1 else None
    groups = [[u] for u in units] if units else [[(i, 0, r * v + y, c * h + z) for i, (h, v) in enumerate(parts) for y in range(v) for z in range(h)] for r in range(down) for c in range(across)]
    for group in groups:
        if interval and n and n % interval == 0:
            flush(bits)
            out += bytes([0xFF, 0xD0 + (n // interval - 1) % 8])
            bits, last = "", [0] * len(parts)
        for i, _, r, c in group:
            block = planes[i][(r, c)]
            d = block[0] - last[i]
            last[i] = block[0]
            bits += dc[abs(d).bit_length()] + bits_of(d)
            run = 0
            end = max((k for k in range(1, 64) if block[k]), default=0)
            for k in range(1, end + 1):
                if block[k] == 0:
                    run += 1
                    continue
                while run > 15:
                    bits, run = bits + ac[0xF0], run - 16
                bits += ac[run << 4 | abs(block[k]).bit_length()] + bits_of(block[k])
                run = 0
            if end < 63:
                bits += ac[0x00]
        n += 1
    flush(bits)
    return head + bytes(out) + b"\xff\xd9"


def plain_decode(data):
    """(width, height, blocks of 64 coefficients) of a grey-scale JPEG."""
    at, tables, interval = 2, {}, 0
    while True:
        marker, n = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xC0:
            height, width = struct.unpack(">HH", body[1:5])
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                tables[body[0]] = {v: k for k, v in codes_of(counts, list(body[17 : 17 + sum(counts)])).items()}
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            break
    bits, place, last, out = [""], 0, 0, []
    while data[at] != 0xFF or data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
        if data[at] == 0xFF and data[at + 1]:
            bits.append("")
            at += 2
            continue
        bits[-1] += format(data[at], "08b")
        at += 2 if data[at] == 0xFF else 1
    total = -(-width // 8) * -(-height // 8)
    part = 0

    def symbol(table):
        nonlocal place
        for length in range(1, 17):
            if (code := bits[part][place : place + length]) in table:
                place += length
                return table[code]
        raise AssertionError

    def number(size):
        nonlocal place
        raw = bits[part][place : place + size]
        place += size
        return 0 if not size else int(raw, 2) if raw[0] == "1" else int(raw, 2) - (1 << size) + 1

    for n in range(total):
        if interval and n and n % interval == 0:
            part, place, last = part + 1, 0, 0
        block = [0] * 64
        last += number(symbol(tables[0x00]))
        block[0], k = last, 1
        while k < 64:
            s = symbol(tables[0x10])
            if s == 0:
                break
            k += s >> 4
            if s & 15:
                block[k] = number(s & 15)
            k += 1
        out.append(block)
    return width, height, out


@pytest.mark.parametrize("body", [b"", b"a", bytes(range(256)) * 3, b"text " * 200, bytes(5000), bytes([255] * 777)])
def test_own_images_by_a_plain_decoder(body):
    payload = jpeg.padded(body)
    width, height, blocks = plain_decode(jpeg.encode([payload])[0])
    stored = bytes(v for b in blocks for v in b)
    assert stored[: len(payload)] == payload and not any(stored[len(payload) :]) and width * height == 64 * len(blocks)


@pytest.mark.parametrize(("size", "parts", "interval"), [((16, 16), [(1, 1)], 0), ((37, 21), [(1, 1)], 2), ((33, 17), [(2, 2), (1, 1), (1, 1)], 0), ((40, 9), [(2, 1), (1, 1), (1, 1)], 1), ((24, 24), [(1, 1)] * 3, 3)])
def test_images_of_a_plain_encoder(size, parts, interval):
    rnd = random.Random(str((size, parts)))
    width, height = size
    hm, vm = max(h for h, _ in parts), max(v for _, v in parts)
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    planes = []
    for h, v in parts:
        rows, cols = (down * v, across * h) if len(parts) > 1 else (-(-height // 8), -(-width // 8))
        plane = {}
        for r in range(rows):
            for c in range(cols):
                block = [0] * 64
                block[0] = rnd.randint(-60, 60)
                for k, value in ((1, rnd.choice([0, 1, -1, 3])), (3, rnd.choice([0, -2, 1])), (25, rnd.choice([0, 0, 1]))):
                    block[k] = value if not (k == 25 and (block[3] == 0)) else 0
                if block[25]:  # a run of 21 zeros: F0, then 5 more
                    block[25] = 1
                plane[(r, c)] = block
        planes.append(plane)
    quantisation = [11] + [3] * 63
    data = plain_encode(width, height, parts, quantisation, interval, planes)
    (im, coefficients), (again, _) = jpeg.decode([data, data])
    assert (im.width, im.height) == size == (again.width, again.height)
    wanted = np.array([[min(255, max(0, round(planes[0][(r, c)][0] * 11 / 8) + 128)) for c in range(-(-width // 8))] for r in range(-(-height // 8))])
    found = jpeg.thumbnail(im, coefficients)
    assert found.shape == wanted.shape and np.abs(found.astype(int) - wanted).max() <= 1  # a half may be rounded either way


def test_broken_images():
    for data in (b"", b"no image", jpeg.encode([bytes(64)])[0].replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises((ValueError, IndexError)):
            jpeg.decode([data])
