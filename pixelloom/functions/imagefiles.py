"""JPEG and lossless WebP files of pictures, written with numpy: transforms and symbols of all blocks or pixels at once, prefix
codes from the picture's own counts, and bits packed in one pass."""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: Quantisation of luminance and chrominance at quality 50, rows of a block (ITU-T T.81, Annex K); fixed values.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, *[99] * 38)
#: Order in which the lengths of the lengths' own codes are stored in lossless WebP; fixed values.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a prefix code for symbols with counts, none above ``most``; 0 for symbols that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    weights = counts[used].astype(np.int64)
    while True:
        heap = [(int(n), k, (k,)) for k, n in enumerate(weights)]
        heapq.heapify(heap)
        depth, serial = np.zeros(len(used), np.int64), len(used)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            both = a[2] + b[2]
            depth[list(both)] += 1
            heapq.heappush(heap, (a[0] + b[0], serial, both))
            serial += 1
        if len(used) == 0 or depth.max() <= most:
            break
        weights = (weights + 1) // 2  # flatter counts, shorter codes
    out[used] = np.maximum(depth, 1)
    return out


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then by symbol."""
    out, code, last = np.zeros(len(lengths), np.int64), 0, 0
    for k in sorted(np.flatnonzero(lengths), key=lambda k: (lengths[k], k)):
        code <<= int(lengths[k]) - last
        out[k], last = code, int(lengths[k])
        code += 1
    return out


def packed_bits(codes: np.ndarray, lengths: np.ndarray, low_first: bool = False) -> np.ndarray:
    """The bits of codes one after the other, highest first, or each code's lowest first."""
    lengths = lengths.astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
    shift = place if low_first else np.repeat(lengths, lengths) - 1 - place
    return ((np.repeat(codes, lengths) >> shift) & 1).astype(np.uint8)


def _zigzag() -> np.ndarray:
    cells = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([i * 8 + j for i, j in cells])


def quality_table(base: tuple[int, ...], quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


def jpeg_bytes(width: int, height: int, rgb: np.ndarray, quality: int) -> bytes:
    """A baseline JPEG of an array (height, width, 3), all channels at full size, with prefix codes of its own."""
    if not 1 <= quality <= 100:
        raise ValueError("quality must lie in 1..100")
    px = np.pad(rgb.astype(np.float32), ((0, -height % 8), (0, -width % 8), (0, 0)), "edge")
    r, g, b = px[..., 0], px[..., 1], px[..., 2]
    planes = (0.299 * r + 0.587 * g + 0.114 * b, -0.168736 * r - 0.331264 * g + 0.5 * b + 128, 0.5 * r - 0.418688 * g - 0.081312 * b + 128)
    k = np.arange(8)
    dct = (np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) * np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5)).astype(np.float32)
    tables, order = [quality_table(t, quality) for t in (LUMINANCE, CHROMINANCE)], _zigzag()
    blocks = []
    for c, plane in enumerate(planes):
        cells = (plane - 128).reshape(px.shape[0] // 8, 8, px.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        flat = (dct @ cells @ dct.T).reshape(-1, 64) / tables[min(c, 1)]
        blocks.append(np.rint(flat).astype(np.int64)[:, order])
    n = len(blocks[0])
    coef = np.stack(blocks, 1).reshape(3 * n, 64)  # a block of each channel in turn
    channel = np.tile(np.arange(3), n)
    dc = coef[:, 0].reshape(n, 3)
    dc = np.diff(np.concatenate([np.zeros((1, 3), np.int64), dc]), axis=0).reshape(-1)
    # symbols in the order (block, place): lengths of DC differences, zeros before a value and its length, 16 zeros, end of block
    row, col = np.nonzero(coef[:, 1:])
    col = col + 1
    before = np.where(np.concatenate([[True], row[1:] != row[:-1]]), 0, np.concatenate([[0], col[:-1]])) if len(row) else col
    zeros = col - before - 1
    value = coef[row, col]
    size = lambda v: np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
    extra = lambda v, s: np.where(v < 0, v + (np.int64(1) << s) - 1, v)
    skips = zeros // 16
    last = np.zeros(3 * n, np.int64)
    np.maximum.at(last, row, col)
    short = np.flatnonzero(last < 63)
    s_dc, s_ac = size(dc), size(value)
    at = np.concatenate([np.arange(3 * n) * 200, row * 200 + col * 3 + 2, np.repeat(row * 200 + col * 3 + 1, skips), short * 200 + 199])
    symbol = np.concatenate([s_dc, (zeros % 16) * 16 + s_ac, np.full(int(skips.sum()), 0xF0), np.zeros(len(short), np.int64)])
    bits, more = np.concatenate([extra(dc, s_dc), extra(value, s_ac), np.zeros(len(symbol) - len(s_dc) - len(s_ac), np.int64)]), np.concatenate([s_dc, s_ac, np.zeros(len(symbol) - len(s_dc) - len(s_ac), np.int64)])
    kind = np.minimum(channel[at // 200], 1) * 2 + np.concatenate([np.zeros(3 * n, np.int64), np.ones(len(symbol) - 3 * n, np.int64)])
    turn = np.argsort(at, kind="stable")
    symbol, bits, more, kind = symbol[turn], bits[turn], more[turn], kind[turn]
    lengths, huffman = [], b""
    for t in range(4):
        counts = np.bincount(symbol[kind == t], minlength=257)
        counts[256] = 1  # keeps the code of all ones free
        own = code_lengths(counts, 16)
        longest = np.flatnonzero(own == own.max())[-1]
        own[256], own[longest] = own[longest], own[256]
        lengths.append(own)
        listed = sorted((s for s in np.flatnonzero(own) if s < 256), key=lambda s: (own[s], s))
        huffman += bytes([(t % 2) << 4 | t // 2]) + bytes(int(sum(own[s] == k for s in listed)) for k in range(1, 17)) + bytes(int(s) for s in listed)
    table_len, table_code = np.stack(lengths), np.stack([codes_of(x) for x in lengths])
    codes, sizes = np.empty(2 * len(symbol), np.int64), np.empty(2 * len(symbol), np.int64)
    codes[0::2], sizes[0::2], codes[1::2], sizes[1::2] = table_code[kind, symbol], table_len[kind, symbol], bits, more
    stream = packed_bits(codes, sizes)
    stream = np.packbits(np.concatenate([stream, np.ones(-len(stream) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")
    part = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    head = part(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + b"".join(part(0xDB, bytes([t]) + bytes(int(v) for v in q[order])) for t, q in enumerate(tables))
    frame = struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([c + 1, 0x11, min(c, 1)]) for c in range(3))
    scan = bytes([3]) + b"".join(bytes([c + 1, min(c, 1) * 0x11]) for c in range(3)) + bytes([0, 63, 0])
    return b"\xff\xd8" + head + part(0xC0, frame) + part(0xC4, huffman) + part(0xDA, scan) + stream + b"\xff\xd9"


def webp_bytes(width: int, height: int, rgba: np.ndarray) -> bytes:
    """A lossless WebP of an array (height, width, 4): green, red, blue and alpha of each pixel by prefix codes of their own."""
    if not (1 <= width <= 16384 and 1 <= height <= 16384):
        raise ValueError("WebP pictures have sides of 1 to 16384 pixels")
    head = [(width - 1, 14), (height - 1, 14), (int((rgba[..., 3] != 255).any()), 1), (0, 3), (0, 1), (0, 1), (0, 1)]  # no transform, cache or groups
    channels = [rgba[..., c].ravel() for c in (1, 0, 2, 3)]
    parts, codes, sizes = [], np.zeros((4, len(channels[0])), np.int64), np.zeros((4, len(channels[0])), np.int64)
    for c, values in enumerate(channels):
        counts = np.bincount(values, minlength=280 if c == 0 else 256)
        used = np.flatnonzero(counts)
        if len(used) <= 2:  # one or two values: a code of no bits, or of one
            parts += [(1, 1), (len(used) - 1, 1), (1, 1), *[(int(v), 8) for v in used]]
            sizes[c], codes[c] = len(used) - 1, values == used[-1]
            if len(used) == 1:
                codes[c] = 0
            continue
        lengths = code_lengths(counts, 15)
        own = code_lengths(np.bincount(lengths, minlength=19), 7)
        if np.count_nonzero(own) == 1:  # all symbols have one length: its code has no bits
            said = np.zeros(19, np.int64)
        else:
            said = own
        parts += [(0, 1), (15, 4), *[(int(own[k]), 3) for k in LENGTH_ORDER], (0, 1)]
        mine = _reversed(codes_of(own), own)
        parts += [(int(mine[v]), int(said[v])) for v in lengths]
        table = _reversed(codes_of(lengths), lengths)
        codes[c], sizes[c] = table[values], lengths[values]
    parts += [(1, 1), (0, 1), (0, 1), (0, 1)]  # distances: never used
    first = head + parts
    all_codes = np.concatenate([[v for v, _ in first], codes.T.ravel()])
    all_sizes = np.concatenate([[n for _, n in first], sizes.T.ravel()])
    body = b"\x2f" + np.packbits(packed_bits(all_codes.astype(np.int64), all_sizes, True), bitorder="little").tobytes()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def _reversed(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Codes with their bits the other way round."""
    return np.array([int(f"{int(c):0{int(n)}b}"[::-1], 2) if n else 0 for c, n in zip(codes, lengths, strict=True)], np.int64)
