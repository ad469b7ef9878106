"""Media columns: baseline JPEG, parsed and decoded in numpy.

``decode`` reads any number of baseline grey-scale or interleaved colour JPEGs:
it parses the markers, removes the stuffed bytes of each scan, splits it at its
restart markers and decodes the Huffman codes of all restart intervals of a
block of images in lockstep, one code of each interval at a time. ``thumbnails``
reconstructs the luminance from the DC coefficients alone, and ``describe`` adds
dimensions and the hash of the thumbnail to a table of images.

``encode`` stores bytes losslessly in such a file: each 64 bytes are the 64
quantised coefficients of one block, in zigzag order, as numbers from 0 to 255.
Blocks are laid out about square; an application segment tells how many bytes
belong to the payload. A restart interval has ``INTERVAL`` blocks.

Defined results: null counts as empty; an empty payload is one block of zeros;
a null image has null features, and one that is not a baseline JPEG raises.
Repeated rows get one row each, with equal values. Texts of any length are
stored whole, in one image. Added columns replace those
of the same name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm import common

#: Blocks between restart markers.
INTERVAL = 8
#: Bytes of images that are coded or decoded at once, unless one has more.
IMAGE_BYTES = 1 << 20
THUMB = 8
APP_TAG = b"payload\0"


def ac_spec() -> tuple[list[int], list[int]]:
    """Code counts by length (1..16) and symbols for coefficients: sizes 7, 6 and 8 without a run first, as text has them."""
    first = [0x07, 0x06, 0x08]
    rest = [s for s in [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))] if s not in first]
    counts = [0] * 16
    counts[0], counts[1], counts[2] = 1, 1, 1
    counts[10] = len(rest)
    return counts, first + rest


def dc_spec() -> tuple[list[int], list[int]]:
    counts = [0] * 16
    counts[3] = 12
    return counts, list(range(12))


def codes(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Canonical code and its length for each of 256 symbols; length 0: none."""
    code, at = 0, 0
    value, length = np.zeros(256, np.uint64), np.zeros(256, np.int32)
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            value[symbols[at]], length[symbols[at]] = code, bits
            code, at = code + 1, at + 1
        code <<= 1
    return value, length


def lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """For each 16 bits ahead: code length << 8 | symbol; 0: no code."""
    table = np.zeros(1 << 16, np.uint32)
    value, length = codes(counts, symbols)
    for s in symbols:
        n = int(length[s])
        table[int(value[s]) << (16 - n) : (int(value[s]) + 1) << (16 - n)] = n << 8 | s
    return table


AC, DC = ac_spec(), dc_spec()
#: Codes and lengths of the 256 AC symbols, then of the DC sizes.
CODE, LENGTH = (np.concatenate(x) for x in zip(codes(*AC), codes(*DC), strict=True))
SIZE_OF = np.array([int(x).bit_length() for x in range(2048)], np.int32)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(width: int, height: int, n_payload: int) -> bytes:
    tables = b"".join(bytes([kind, *counts, *symbols]) for kind, (counts, symbols) in ((0x00, DC), (0x10, AC)))
    return b"".join([
        b"\xff\xd8", segment(0xEB, APP_TAG + struct.pack(">Q", n_payload)), segment(0xDB, bytes([0, *[1] * 64])),
        segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0])), segment(0xC4, tables),
        segment(0xDD, struct.pack(">H", INTERVAL)), segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload, whose length is a positive multiple of 64."""
    n_blocks = np.array([len(p) // 64 for p in payloads], np.int64)
    wide = np.ceil(np.sqrt(n_blocks)).astype(np.int64)
    high = -(-n_blocks // wide)
    padded = wide * high
    starts = np.concatenate([[0], np.cumsum(padded)])
    coef = np.zeros((int(starts[-1]), 64), np.int16)
    flat = coef.reshape(-1)
    for p, s in zip(payloads, starts, strict=False):
        flat[s * 64 : s * 64 + len(p)] = np.frombuffer(p, np.uint8)
    # the DC coefficients are differences within a restart interval
    index = np.arange(len(coef)) - np.repeat(starts[:-1], padded)
    dc = coef[:, 0].copy()
    dc[1:] -= np.where(index[1:] % INTERVAL != 0, coef[:-1, 0], 0)
    coef[:, 0] = dc
    coded = coef != 0
    coded[:, 0] = True  # a DC coefficient has a code even if it is 0
    place = np.flatnonzero(coded)
    v = flat[place].astype(np.int32)
    k = (place & 63).astype(np.int32)
    first = k == 0
    run = np.diff(k, prepend=0) - 1
    run[first] = 0
    size = SIZE_OF[np.abs(v)]
    bits = np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)
    entry = np.where(first, 256 + size, ((run & 15) << 4) | size)
    value, length = (CODE[entry] << size.astype(np.uint64)) | bits, LENGTH[entry] + size
    # runs of 16 zeros and ends of blocks are codes of their own, before and after
    long_runs = run >> 4
    eob = np.append(first[1:], True) & (k != 63)
    interval_of_block = np.cumsum(index % INTERVAL == 0) - 1
    n_intervals = int(interval_of_block[-1]) + 1
    times = long_runs + 1 + eob
    if long_runs.any() or eob.any():
        at = np.cumsum(times) - 1
        more_value, more_length = np.full(int(times.sum()), CODE[0xF0], np.uint64), np.full(int(times.sum()), LENGTH[0xF0], np.int32)
        own = at - eob
        more_value[own], more_length[own] = value, length
        more_value[at[eob]], more_length[at[eob]] = CODE[0x00], LENGTH[0x00]
        value, length, place = more_value, more_length, np.repeat(place, times)
    # each restart interval starts at a byte of its own and is padded with ones
    first_block = np.flatnonzero(index % INTERVAL == 0)
    head = np.append(np.searchsorted(place, first_block * 64), len(place))
    before = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    n_bits = before[head[1:]] - before[head[:-1]]
    n_bytes = (n_bits + 7) // 8
    byte_start = np.concatenate([[0], np.cumsum(n_bytes)])
    position = before[:-1] + np.repeat(byte_start[:-1] * 8 - before[head[:-1]], np.diff(head))
    packed = bits_to_bytes(position, value, length, int(byte_start[-1]))
    packed[byte_start[1:] - 1] |= ((1 << (n_bytes * 8 - n_bits)) - 1).astype(np.uint8)
    body = packed.tobytes()
    # stuff a zero byte after each 255 and put the restart markers in
    index_in_image = interval_of_block[starts[:-1]]
    last_interval = np.concatenate([index_in_image[1:], [n_intervals]])
    out = []
    for i, p in enumerate(payloads):
        a, b = int(index_in_image[i]), int(last_interval[i])
        parts = [header(int(wide[i]) * 8, int(high[i]) * 8, len(p))]
        edges = byte_start[a : b + 1].tolist()
        for n, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
            if n:
                parts.append(bytes([0xFF, 0xD0 + (n - 1) % 8]))
            parts.append(body[s:e].replace(b"\xff", b"\xff\0"))
        parts.append(b"\xff\xd9")
        out.append(b"".join(parts))
    return out


def bits_to_bytes(position: np.ndarray, value: np.ndarray, length: np.ndarray, n_bytes: int) -> np.ndarray:
    """Put values of up to 32 bits at ascending bit positions, each where no other is."""
    word = position >> 6
    shift = 64 - (position & 63) - length  # negative: the value goes on in the next word
    over = np.flatnonzero(shift < 0)
    upper = value << np.maximum(shift, 0).astype(np.uint64)
    upper[over] = value[over] >> (-shift[over]).astype(np.uint64)
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    words = np.zeros(n_bytes // 8 + 2, np.uint64)
    words[word[heads]] = np.bitwise_or.reduceat(upper, heads)
    words[word[over] + 1] |= value[over] << (64 + shift[over]).astype(np.uint64)  # one value at most runs into a word
    return words.byteswap().view(np.uint8)[:n_bytes]


@dataclass
class Image:
    width: int
    height: int
    components: list[tuple[int, int, int, int]]  # id, horizontal and vertical sampling, quantisation table
    quantisation: dict[int, np.ndarray]
    huffman: dict[int, np.ndarray]
    scan: list[tuple[int, int]]  # component index, DC and AC tables as one byte
    interval: int
    n_payload: int | None
    start: int  # of the scan's bytes


def parse(data: bytes) -> Image:
    """Read the markers up to the scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, im = 2, Image(0, 0, [], {}, {}, [], 0, None, 0)
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                im.quantisation[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC0:
            _, im.height, im.width, n_parts = struct.unpack(">BHHB", body[:6])
            im.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n_parts)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                symbols = body[17 : 17 + sum(counts)]
                im.huffman[body[0]] = _cached_lookup(bytes(counts), bytes(symbols))
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            im.interval = struct.unpack(">H", body)[0]
        elif marker == 0xEB and body.startswith(APP_TAG):
            im.n_payload = struct.unpack(">Q", body[len(APP_TAG) :])[0]
        elif marker == 0xDA:
            ids = [c[0] for c in im.components]
            im.scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            im.start = at
            return im


_TABLES: dict[tuple[bytes, bytes], np.ndarray] = {}


def _cached_lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    key = (counts, symbols)
    if key not in _TABLES:
        if len(_TABLES) > 64:
            _TABLES.clear()
        _TABLES[key] = lookup(list(counts), list(symbols))
    return _TABLES[key]


def block_grid(im: Image) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Of each component: its blocks across and down in the scan, and those that the image covers."""
    hmax, vmax = max(c[1] for c in im.components), max(c[2] for c in im.components)
    across, down = -(-im.width // (8 * hmax)), -(-im.height // (8 * vmax))
    if len(im.scan) == 1:
        _, h, v, _ = im.components[im.scan[0][0]]
        own = (-(-(-(-im.width * h // hmax)) // 8), -(-(-(-im.height * v // vmax)) // 8))
        return [own], [own]
    grids = [(across * im.components[i][1], down * im.components[i][2]) for i, _ in im.scan]
    return grids, [(-(-(-(-im.width * im.components[i][1] // hmax)) // 8), -(-(-(-im.height * im.components[i][2] // vmax)) // 8)) for i, _ in im.scan]


def decode(images: list[bytes]) -> list[tuple[Image, list[np.ndarray]]]:
    """Header and coefficients (blocks x 64, zigzag order, still quantised) of the components in the scan of each image."""
    parsed = [parse(d) for d in images]
    chunks, tables = [], {}
    interval_blocks, interval_bytes, kinds_of, n_blocks = [], [], [], []
    for d, im in zip(images, parsed, strict=True):
        grids, _ = block_grid(im)
        per_mcu = [1] if len(im.scan) == 1 else [im.components[i][1] * im.components[i][2] for i, _ in im.scan]
        n_mcu = grids[0][0] * grids[0][1] // per_mcu[0]
        kinds = []  # the tables of each block of an MCU
        for (_, t), n in zip(im.scan, per_mcu, strict=True):
            pair = (id(im.huffman[t >> 4]), id(im.huffman[0x10 | t & 15]))
            if pair not in tables:
                tables[pair] = (len(tables), im.huffman[t >> 4], im.huffman[0x10 | t & 15])
            kinds += [tables[pair][0]] * n
        end = d.rfind(b"\xff\xd9")
        body = np.frombuffer(d, np.uint8)[im.start : end]
        # a 255 is followed by a stuffed zero, or by a restart marker that ends an interval
        ff = np.flatnonzero(body[:-1] == 0xFF)
        follow = body[ff + 1]
        drop = np.ones(len(body), np.bool_)
        drop[ff[follow == 0] + 1] = False
        marks = ff[(follow >= 0xD0) & (follow <= 0xD7)]
        drop[marks] = drop[marks + 1] = False
        kept = np.concatenate([[0], np.cumsum(drop)])
        edges = np.concatenate([[0], kept[marks], [kept[-1]]])
        interval_bytes += np.diff(edges).tolist()
        step = im.interval or n_mcu
        sizes = [min(step, n_mcu - i) * len(kinds) for i in range(0, n_mcu, step)]
        if len(sizes) != len(edges) - 1:
            raise ValueError("restart markers are missing")
        interval_blocks += sizes
        kinds_of += [kinds] * len(sizes)
        n_blocks.append(n_mcu * len(kinds))
        chunks.append(body[drop])
    if not chunks:
        return []
    coef = _decode_intervals(np.concatenate(chunks), np.array(interval_bytes, np.int64), np.array(interval_blocks, np.int64), kinds_of, [(a, b) for _, a, b in sorted(tables.values(), key=lambda x: x[0])])
    out, at = [], 0
    for im, n in zip(parsed, n_blocks, strict=True):
        own = coef[at : at + n]
        at += n
        per_mcu = [1] if len(im.scan) == 1 else [im.components[i][1] * im.components[i][2] for i, _ in im.scan]
        mcus = own.reshape(-1, sum(per_mcu), 64)
        parts, c = [], 0
        step = im.interval or len(mcus)
        for (i, _), n_own in zip(im.scan, per_mcu, strict=True):
            part = mcus[:, c : c + n_own].copy()
            c += n_own
            for s in range(0, len(part), step):  # DC coefficients are differences within an interval
                part[s : s + step, :, 0] = np.cumsum(part[s : s + step, :, 0].reshape(-1)).reshape(-1, n_own)
            if len(im.scan) > 1:  # from the order of MCUs to rows of blocks
                h, v = im.components[i][1], im.components[i][2]
                across = -(-im.width // (8 * max(x[1] for x in im.components)))
                part = part.reshape(-1, across, v, h, 64).transpose(0, 2, 1, 3, 4)
            parts.append(part.reshape(-1, 64))
        out.append((im, parts))
    return out


def _decode_intervals(data: np.ndarray, n_bytes: np.ndarray, n_blocks: np.ndarray, kinds_of: list[list[int]], tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """All coefficients, the DC ones as differences; each step decodes one code of every interval that is not done."""
    padded = np.concatenate([data, np.full(8, 0xFF, np.uint8)]).astype(np.int64)
    n = len(data) + 1
    ahead = (padded[0:n] << 32) | (padded[1 : n + 1] << 24) | (padded[2 : n + 2] << 16) | (padded[3 : n + 3] << 8) | padded[4 : n + 4]
    lut = np.concatenate([t for pair in tables for t in pair]).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(n_bytes)])
    coef = np.zeros(int(n_blocks.sum()) * 64, np.int16)
    at = starts[:-1] * 8
    place = (np.cumsum(n_blocks) - n_blocks) * 64  # of the next coefficient
    last = place + n_blocks * 64
    limit = starts[1:] * 8
    plain = len(tables) == 1
    if not plain:
        width = max(map(len, kinds_of))
        kind = np.array([k * (width // len(k)) + k[: width % len(k)] for k in kinds_of])
        cycle = np.array([len(k) for k in kinds_of])
    first = place.copy()
    live = np.arange(len(at))
    while len(live):
        k = place & 63
        table = np.where(k == 0, 0, 1 << 16)
        if not plain:
            nth = ((place - first) >> 6) % cycle[live]
            table = table + (kind[live, nth] << 17)
        window = (ahead[at >> 3] >> (8 - (at & 7))) & 0xFFFFFFFF  # 32 bits from here on
        entry = lut[table + (window >> 16)]
        length, symbol = entry >> 8, entry & 255
        if not length.all():
            raise ValueError("a Huffman code is not in the table")
        size = symbol & 15
        run = np.where(k == 0, 0, symbol >> 4)
        full = 1 << size
        bits = (window >> (32 - length - size)) & (full - 1)
        value = np.where(2 * bits < full, bits - full + 1, bits)  # of size 0: 0
        target = place + run
        if ((k + run > 63) & (size > 0)).any():
            raise ValueError("a run leaves its block")
        hit = size > 0
        if hit.all():
            coef[target] = value
        else:
            coef[target[hit]] = value[hit]
        end_of_block = (k > 0) & (symbol == 0)
        place = np.where(end_of_block, (place | 63) + 1, target + 1)
        at = at + length + size
        more = place < last
        if (at > limit + 32).any():
            raise ValueError("a scan ends early")
        if not more.all():
            live, at, place, last, limit, first = live[more], at[more], place[more], last[more], limit[more], first[more]
    return coef.reshape(-1, 64)


def thumbnail(im: Image, parts: list[np.ndarray]) -> np.ndarray:
    """The luminance of each block from its DC coefficient, as bytes."""
    grids, covered = block_grid(im)
    across, down = grids[0]
    q = int(im.quantisation[im.components[im.scan[0][0]][3]][0])
    level = np.clip(np.rint(parts[0][:, 0].astype(np.int64) * q / 8) + 128, 0, 255).astype(np.uint8)
    return level.reshape(down, across)[: covered[0][1], : covered[0][0]]


def average_hash(thumb: np.ndarray) -> str:
    """64 bits as hex: the thumbnail averaged onto THUMB x THUMB cells, each above the mean or not."""
    rows, cols = (np.minimum(np.arange(THUMB + 1) * n // THUMB, n - 1) for n in thumb.shape)
    sums = np.pad(np.cumsum(np.cumsum(thumb.astype(np.int64), 0), 1), ((1, 0), (1, 0)))
    r1, c1 = np.maximum((np.arange(1, THUMB + 1) * thumb.shape[0]) // THUMB, rows[:-1] + 1), np.maximum((np.arange(1, THUMB + 1) * thumb.shape[1]) // THUMB, cols[:-1] + 1)
    cells = (sums[r1][:, c1] - sums[rows[:-1]][:, c1] - sums[r1][:, cols[:-1]] + sums[rows[:-1]][:, cols[:-1]]) / ((r1 - rows[:-1])[:, None] * (c1 - cols[:-1])[None, :])
    return np.packbits(cells > thumb.mean()).tobytes().hex()


def payload(im: Image, parts: list[np.ndarray]) -> bytes:
    """The bytes that :func:`encode` stored."""
    return parts[0].astype(np.uint8).tobytes()[: im.n_payload]


def padded(body: bytes) -> bytes:
    """A text's bytes and zero bytes up to a positive multiple of 64."""
    return body + bytes(-len(body) % 64 if body else 64)


def _by_bytes(column: pa.Array) -> Iterator[list[bytes]]:
    sizes = np.concatenate([[0], np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in column])])
    for i, j in common.blocks(sizes, IMAGE_BYTES):
        yield column.slice(i, j - i).to_pylist()


def stored(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with the text's padded bytes as a JPEG, and ``n_bytes`` of the text."""

    def run(texts: pa.Array) -> list[pa.Array]:
        data, offsets = common.utf8(texts)
        out = []
        for i, j in common.blocks(offsets, IMAGE_BYTES):
            out += encode([padded(data[offsets[r] : offsets[r + 1]].tobytes()) for r in range(i, j)])
        return [pa.array(out, pa.binary()), pa.array(np.diff(offsets), pa.int64())]

    return common.with_columns_by_batch(docs, [text], [(media, T.BinaryType()), ("n_bytes", T.LongType())], run)


def describe(images: DataFrame, media: str = "media") -> DataFrame:
    """``images`` with width, height, the luminance thumbnail (bytes by rows), its shape and its hash ``feature``."""
    added = [("width", T.IntegerType()), ("height", T.IntegerType()), ("thumb", T.BinaryType()), ("thumb_width", T.IntegerType()), ("feature", T.StringType())]

    def run(column: pa.Array) -> list[pa.Array]:
        rows: list[tuple] = []
        for block in _by_bytes(column):
            known = iter(decode([d for d in block if d is not None]))
            for d in block:
                if d is None:
                    rows.append((None,) * 5)
                    continue
                im, parts = next(known)
                t = thumbnail(im, parts)
                rows.append((im.width, im.height, t.tobytes(), t.shape[1], average_hash(t)))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.string())
        return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

    return common.with_columns_by_batch(images, [media], added, run)


def read_back(images: DataFrame, media: str = "media") -> DataFrame:
    """``images`` of :func:`stored` with digests of the payload that their bytes hold, and the thumbnail's hash."""
    added = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]

    def run(column: pa.Array) -> list[pa.Array]:
        rows = []
        for block in _by_bytes(column):
            for d, (im, parts) in zip(block, decode(block), strict=True):
                body = payload(im, parts)
                rows.append((len(body), sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(d), sha256(d).hexdigest(), f"{im.width}x{im.height}:{average_hash(thumbnail(im, parts))}"))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

    return common.with_columns_by_batch(images, [media], added, run)


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as a JPEG, read the stored bytes back and describe them."""
    kept = stored(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    return read_back(kept.drop("text")).drop("media")
