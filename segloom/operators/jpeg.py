"""Writing JPEG files: baseline, no subsampling, Huffman codes made for each image."""

from __future__ import annotations

import heapq
import struct
from collections import Counter
from itertools import count

import numpy as np

# The quantisation tables that the JPEG standard proposes, for brightness and for colour, row by row.
BRIGHTNESS = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
COLOUR = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    *[99] * 32,
)
QUALITY = 90

_ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_K = np.arange(8)
_DCT = np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16))


def scaled(table: tuple[int, ...], quality: int) -> np.ndarray:
    percent = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * percent + 50) // 100, 1, 255)


def _blocks(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised coefficients of each block of 8 by 8, in zigzag order; the edges go on with their last pixels."""
    h, w = plane.shape
    full = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128.0
    cut = full.reshape(full.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
    return np.rint((_DCT @ cut @ _DCT.T).reshape(-1, 64) / table).astype(np.int64)[:, _ZIGZAG]


def _symbols(blocks: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each block (symbol, bits, number of bits): the step of the mean first, then runs of zeros with what follows them."""
    steps = np.diff(blocks[:, 0], prepend=0)
    out = []
    rows, at = np.nonzero(blocks[:, 1:])
    values = blocks[rows, at + 1]
    ends = np.searchsorted(rows, np.arange(len(blocks) + 1)).tolist()
    at, values = (at + 1).tolist(), values.tolist()
    for b, step in enumerate(steps.tolist()):
        size = abs(step).bit_length()
        own, last = [(size, step if step > 0 else step + (1 << size) - 1, size)], 0
        for k in range(ends[b], ends[b + 1]):
            gap, value = at[k] - last - 1, values[k]
            own += [(0xF0, 0, 0)] * (gap // 16)
            size = abs(value).bit_length()
            own.append((gap % 16 << 4 | size, value if value > 0 else value + (1 << size) - 1, size))
            last = at[k]
        out.append(own if last == 63 else [*own, (0, 0, 0)])
    return out


def _code(counts: Counter) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """How many codes have each length from 1 to 16, and each symbol's code and length, in the order of the codes."""
    counts = Counter(counts)
    while True:
        tick = count()
        heap = [(n, next(tick), [s]) for s, n in counts.items()] + [(0, next(tick), [-1])]  # -1 takes the code of ones only
        heapq.heapify(heap)
        lengths: Counter = Counter()
        while len(heap) > 1:
            (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            lengths.update(a + b)
            heapq.heappush(heap, (n + m, next(tick), a + b))
        if max(lengths.values()) <= 16:
            break
        counts = Counter({s: (n + 1) // 2 for s, n in counts.items()})
    codes, code, before = {}, 0, 0
    for symbol in sorted((s for s in lengths if s >= 0), key=lambda s: (lengths[s], s)):
        code <<= lengths[symbol] - before
        before = lengths[symbol]
        codes[symbol] = code, before
        code += 1
    return [sum(1 for _, n in codes.values() if n == k) for k in range(1, 17)], codes


def jpeg(pixels: np.ndarray, quality: int = QUALITY) -> bytes:
    """An RGB image as a JPEG file."""
    h, w, _ = pixels.shape
    red, green, blue = (pixels[..., k].astype(np.float64) for k in range(3))
    light = 0.299 * red + 0.587 * green + 0.114 * blue
    tables = scaled(BRIGHTNESS, quality), scaled(COLOUR, quality)
    planes = [(light, 0), (128 + 0.564 * (blue - light), 1), (128 + 0.713 * (red - light), 1)]
    coded = [_symbols(_blocks(p, tables[t])) for p, t in planes]
    part = lambda marker, data: struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data
    out = [b"\xff\xd8", part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    out += [part(0xDB, bytes([t]) + bytes(tables[t][_ZIGZAG].tolist())) for t in (0, 1)]
    out.append(part(0xC0, struct.pack(">BHHB", 8, h, w, 3) + b"".join(bytes([k + 1, 0x11, t]) for k, (_, t) in enumerate(planes))))
    codes = {}
    for t in (0, 1):
        own = [c for c, (_, u) in zip(coded, planes, strict=True) if u == t]
        for kind, seen in ((0, Counter(b[0][0] for c in own for b in c)), (1, Counter(s[0] for c in own for b in c for s in b[1:]))):
            lengths, codes[kind, t] = _code(seen)
            out.append(part(0xC4, bytes([kind << 4 | t, *lengths, *codes[kind, t]])))
    out.append(part(0xDA, b"\3" + b"".join(bytes([k + 1, t << 4 | t]) for k, (_, t) in enumerate(planes)) + b"\0\x3f\0"))
    bits: list[str] = []
    for blocks in zip(*coded, strict=True):
        for block, (_, t) in zip(blocks, planes, strict=True):
            for k, (symbol, extra, size) in enumerate(block):
                code, length = codes[min(k, 1), t][symbol]
                bits.append(f"{code << size | extra:0{length + size}b}")
    stream = "".join(bits)
    stream += "1" * (-len(stream) % 8)
    data = int(stream, 2).to_bytes(len(stream) // 8, "big") if len(stream) <= 1 << 16 else bytes(np.packbits(np.frombuffer(stream.encode(), np.uint8) - 48))
    return b"".join(out) + data.replace(b"\xff", b"\xff\0") + b"\xff\xd9"
