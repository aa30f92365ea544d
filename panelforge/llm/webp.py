"""Lossless WebP (the public VP8L bit stream) in NumPy: a writer, a full reader, and a media column on DataFrames."""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, small_batches

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: The order in which lengths of the code-length code are stored.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
HASH = 0x1E35A7BD  # fixed value: the colour cache's multiplier
LONGEST_CODE = 12
WINDOW = 15  # bits that a look-up of several literals sees


@lru_cache(maxsize=1)
def near_places() -> list[tuple[int, int]]:
    """(dx, dy) of the 120 short distance codes: nearest first, then by |dx|, the left-hand one first."""
    places = [(dx, dy) for dy in range(8) for dx in range(-7, 9) if dy or dx > 0]
    return sorted(places, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


# ---- bits ---------------------------------------------------------------------------------------------------------


def pack_bits(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Fields of at most 32 bits, least significant bit first."""
    ends = np.cumsum(widths)
    total = int(ends[-1]) if len(ends) else 0
    at = ends - widths
    shifted = values.astype(np.uint64) << (at & 31).astype(np.uint64)
    words = total // 32 + 2
    low = np.bincount(at >> 5, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(float), minlength=words)
    high = np.bincount((at >> 5) + 1, weights=(shifted >> np.uint64(32)).astype(float), minlength=words)
    return (low[:words] + high[:words]).astype("<u4").tobytes()[: (total + 7) // 8]


class Bits:
    """Reads fields from bytes; zeros follow the end, and reading far past it is an error."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.count = data, 0, 0, 0

    def fill(self) -> None:
        if self.at > len(self.data) + 64:
            raise ValueError("the stream ends early")
        self.held |= int.from_bytes(self.data[self.at : self.at + 24], "little") << self.count
        self.at += 24
        self.count += 192

    def read(self, n: int) -> int:
        if self.count < n:
            self.fill()
        x = self.held & ((1 << n) - 1)
        self.held >>= n
        self.count -= n
        return x


# ---- prefix codes -------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int) -> list[int]:
    """Huffman code lengths of at most ``longest``; rarer symbols are counted as commoner until that holds."""
    used = np.nonzero(counts)[0].tolist()
    lengths = [0] * len(counts)
    if len(used) < 2:
        for s in used:
            lengths[s] = 1
        return lengths
    floor = 1
    while True:
        heap = [(max(int(counts[s]), floor), i, (s,)) for i, s in enumerate(used)]
        heapq.heapify(heap)
        depth = dict.fromkeys(used, 0)
        order = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], order, a[2] + b[2]))
            order += 1
        if max(depth.values()) <= longest:
            for s, d in depth.items():
                lengths[s] = d
            return lengths
        floor *= 2


@lru_cache(maxsize=512)
def codes(lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Canonical codes as the stream holds them (first bit lowest), and their widths; a lone symbol takes no bits."""
    value, width = np.zeros(len(lengths), dtype=np.int64), np.array(lengths, dtype=np.int64)
    if np.count_nonzero(width) < 2:
        return value, np.zeros(len(lengths), dtype=np.int64)
    code, last = 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        value[s], last = int(f"{code:0{n}b}"[::-1], 2), n
        code += 1
    if code != 1 << last:
        raise ValueError("not a complete prefix code")
    return value, width


@lru_cache(maxsize=256)
def decoding_table(lengths: tuple[int, ...]) -> tuple[list[int], int]:
    """Look-up by the next bits: symbol << 4 | width; and the mask of those bits."""
    value, width = codes(lengths)
    if not width.any():
        lone = next((s for s, n in enumerate(lengths) if n), 0)
        return [lone << 4], 0
    size = 1 << int(width.max())
    table = np.zeros(size, dtype=np.int64)
    for s in np.nonzero(width)[0].tolist():
        table[int(value[s]) :: 1 << int(width[s])] = s << 4 | int(width[s])
    return table.tolist(), size - 1


@lru_cache(maxsize=4)
def literal_runs(lengths: tuple[int, ...]) -> tuple[list[bytes], list[int]]:
    """For each ``WINDOW`` bits: the literals that they hold whole, up to six, and their width; none: another symbol is first."""
    table, mask = decoding_table(lengths)
    runs, widths = [], []
    for bits in range(1 << WINDOW):
        out, used = b"", 0
        while len(out) < 6:
            e = table[(bits >> used) & mask]
            if e >> 4 >= LITERALS or used + (e & 15) > WINDOW or not e & 15:
                break
            out += bytes([e >> 4])
            used += e & 15
        runs.append(out)
        widths.append(used)
    return runs, widths


@lru_cache(maxsize=512)
def write_code(lengths: tuple[int, ...]) -> list[tuple[int, int]]:
    """A prefix code's own fields."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        first = used[0] if used else 0
        fields = [(1, 1), (max(0, len(used) - 1), 1), (int(first > 1), 1), (first, 8 if first > 1 else 1)]
        return fields + [(s, 8) for s in used[1:]]
    steps: list[tuple[int, int, int]] = []  # symbol, extra value, extra width
    i = 0
    while i < len(lengths):
        run = 1
        while i + run < len(lengths) and lengths[i + run] == lengths[i]:
            run += 1
        i += run
        if lengths[i - 1]:
            steps.append((lengths[i - 1], 0, 0))
            run -= 1
        while run:
            zero = not lengths[i - 1]
            n = min(run, 138 if zero else 6)
            if n < 3:
                steps += [(lengths[i - 1], 0, 0)] * n
            else:
                steps.append((18, n - 11, 7) if zero and n > 10 else (17, n - 3, 3) if zero else (16, n - 3, 2))
            run -= n
    own = code_lengths(np.bincount([s for s, _, _ in steps], minlength=19), 7)
    value, width = codes(tuple(own))
    kept = max(4, 1 + max(i for i, s in enumerate(LENGTH_ORDER) if own[s]))
    fields = [(0, 1), (kept - 4, 4), *((own[s], 3) for s in LENGTH_ORDER[:kept]), (0, 1)]
    for s, extra, n in steps:
        fields += [(int(value[s]), int(width[s])), (extra, n)]
    return fields


def read_code(bits: Bits, alphabet: int) -> tuple[int, ...]:
    """A prefix code's lengths."""
    lengths = [0] * alphabet
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return tuple(lengths)
    own = [0] * 19
    for s in LENGTH_ORDER[: 4 + bits.read(4)]:
        own[s] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    table, mask = decoding_table(tuple(own))
    i, last = 0, 8
    while i < alphabet and left:
        left -= 1
        if bits.count < 16:
            bits.fill()
        e = table[bits.held & mask]
        bits.read(e & 15)
        s = e >> 4
        if s < 16:
            lengths[i] = s
            i += 1
            last = s or last
            continue
        n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
        if i + n > alphabet:
            raise ValueError("a run of code lengths is too long")
        lengths[i : i + n] = [last if s == 16 else 0] * n
        i += n
    return tuple(lengths)


def prefix_value(value: int) -> tuple[int, int, int]:
    """``(symbol, extra value, extra width)`` of a length or distance code from 1."""
    if value <= 4:
        return value - 1, 0, 0
    top = (value - 1).bit_length() - 1
    second = (value - 1) >> (top - 1) & 1
    return 2 * top + second, (value - 1) & ((1 << (top - 1)) - 1), top - 1


def _read_value(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


# ---- entropy-coded images -----------------------------------------------------------------------------------------


def repeats(samples: np.ndarray, least: int = 20) -> list[tuple[int, int, int]]:
    """Greedy back-references ``(start, length, distance)`` to the nearest earlier repeat.

    Windows of 16 samples are hashed, and those whose hash ends in two zero bits are anchors: both places of a repeat
    have the same ones. A stable sort puts equal anchors side by side, earlier ones first; a match then grows both ways.
    """
    if len(samples) < 32:
        return []
    x = samples.astype(np.uint64)
    for span in (1, 2, 4, 8):
        x = (x[:-span] * np.uint64(0x9E3779B97F4A7C15 ^ span)) ^ (x[span:] >> np.uint64(7)) ^ (x[span:] << np.uint64(29))
    anchors = np.nonzero(x & np.uint64(3) == 0)[0]
    x = x[anchors]
    order = np.argsort(x, kind="stable")
    same = np.nonzero(x[order[1:]] == x[order[:-1]])[0]
    if not len(same):
        return []
    sources = dict(zip(anchors[order[same + 1]].tolist(), anchors[order[same]].tolist()))
    out, end = [], 0
    for at in sorted(sources):
        if at < end:
            continue
        back = at - sources[at]
        most = min(2048, at - end, at - back)
        if most:
            before = np.nonzero(samples[at - most : at] != samples[at - back - most : at - back])[0]
            at = at - most + (int(before[-1]) + 1 if len(before) else 0)
        most = min(4096, len(samples) - at)
        differs = np.nonzero(samples[at : at + most] != samples[at - back : at - back + most])[0]
        length = int(differs[0]) if len(differs) else most
        if length >= least:
            out.append((at, length, back))
            end = at + length
    return out


def cache_hits(pixels: np.ndarray, bits: int, covered: np.ndarray) -> np.ndarray:
    """For every pixel the cache entry that holds it just then, or -1; ``covered`` pixels are copied and only fill the cache."""
    place = ((pixels.astype(np.uint64) * np.uint64(HASH)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)
    held: dict[int, int] = {}
    out = np.full(len(pixels), -1)
    for i, (p, k) in enumerate(zip(pixels.tolist(), place.tolist())):
        if held.get(k, 0) == p and not covered[i]:
            out[i] = k
        held[k] = p
    return out


@lru_cache(maxsize=64)
def lone_header(green: tuple[int, ...], rest: int, main: bool) -> tuple[tuple[int, int], ...]:
    """Header of an image without cache or copies in which only green varies."""
    lone = [tuple(int(s == rest >> shift & 255) for s in range(256)) for shift in (16, 0, 24)]
    codes_ = [f for lengths in (green, *lone, (0,) * DISTANCES) for f in write_code(lengths)]
    return ((0, 1), *[(0, 1)] * main, *codes_)


@lru_cache(maxsize=256)
def _columns(fields: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([v for v, _ in fields], dtype=np.int64), np.array([w for _, w in fields], dtype=np.int64)


def write_image(
    pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0, copies: list[tuple[int, int, int]] = (), given: tuple[int, ...] | None = None
) -> tuple[tuple[tuple[int, int], ...], np.ndarray, np.ndarray]:
    """Header fields, then token values and widths, of ARGB ``pixels``. ``given``: the green code's lengths, else fitted."""
    rest = pixels & np.uint32(0xFFFF00FF)
    if given is not None and not cache_bits and not copies and (rest == rest[0]).all():
        header = lone_header(given, int(rest[0]), main)
        green = pixels >> np.uint32(8) & np.uint32(255)
        value, bits = codes(given)
        return header, value[green], bits[green]
    n = len(pixels)
    keep = np.ones(n, dtype=bool)
    for start, length, _ in copies:
        keep[start : start + length] = False
        keep[start] = True
    channels = [(pixels >> s & 255).astype(np.int64) for s in (8, 16, 0, 24)]  # green, red, blue, alpha
    alphabets = [LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES]
    symbols = [c.copy() for c in channels]
    literal = np.ones(n, dtype=bool)
    extra, distance, far, copied = {}, {}, {}, []
    near = {dx + dy * width: i + 1 for i, (dx, dy) in reversed([*enumerate(near_places())])} if copies else {}
    for start, length, back in copies:
        s, value, bits = prefix_value(length)
        symbols[0][start], extra[start], literal[start] = LITERALS + s, (value, bits), False
        s, value, bits = prefix_value(near.get(back, back + 120))
        distance[start], far[start] = s, (value, bits)
        copied.append(start)
    if cache_bits:
        hit = cache_hits(pixels, cache_bits, ~keep | ~literal)
        at = hit >= 0
        symbols[0][at] = LITERALS + LENGTHS + hit[at]
        literal &= ~at
    literal &= keep
    counts = [np.bincount(symbols[0][keep], minlength=alphabets[0])]
    counts += [np.bincount(c[literal], minlength=256) for c in symbols[1:]]
    counts.append(np.bincount([*distance.values()], minlength=DISTANCES) if distance else np.zeros(DISTANCES, dtype=np.int64))
    lengths = [tuple(code_lengths(c, LONGEST_CODE)) if given is None or i else given for i, c in enumerate(counts)]
    header = [(1, 1), (cache_bits, 4)] if cache_bits else [(0, 1)]
    header += [(0, 1)] if main else []
    made = []
    for own in lengths:
        header += write_code(own)
        made.append(codes(own))
    value, bits = np.zeros((4, n), dtype=np.int64), np.zeros((4, n), dtype=np.int64)
    value[0], bits[0] = made[0][0][symbols[0]], made[0][1][symbols[0]]
    for k in (1, 2, 3):
        if made[k][1].any():
            value[k, literal], bits[k, literal] = made[k][0][symbols[k][literal]], made[k][1][symbols[k][literal]]
    for start in copied:
        value[1, start], bits[1, start] = extra[start]
        value[2, start], bits[2, start] = made[4][0][distance[start]], made[4][1][distance[start]]
        value[3, start], bits[3, start] = far[start]
    value, bits = value[:, keep].T.ravel(), bits[:, keep].T.ravel()
    return tuple(header), value[bits > 0], bits[bits > 0]


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB pixels of an entropy-coded image: prefix codes, back-references and colour cache."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, group_of, shift, across = 1, None, 0, 0
    if main and bits.read(1):
        shift = 2 + bits.read(3)
        across = -(-width >> shift)
        chosen = read_image(bits, across, -(-height >> shift), False)
        group_of = (chosen >> 8 & 0xFFFF).tolist()
        groups = max(group_of) + 1
    alphabets = [LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES]
    lengths = [[read_code(bits, a) for a in alphabets] for _ in range(groups)]
    tables = [[decoding_table(x) for x in own] for own in lengths]
    total = width * height
    plain = all(len(t) == 1 for t, _ in tables[0][1:4])
    if main and groups == 1 and not cache_bits and plain and len(tables[0][0][0]) > 1:
        green = _read_green(bits, lengths[0][0], tables[0][0], tables[0][4], width, total)
        rest = tables[0][3][0][0] >> 4 << 24 | tables[0][1][0][0] >> 4 << 16 | tables[0][2][0][0] >> 4
        return green.astype(np.uint32) << np.uint32(8) | np.uint32(rest)
    out: list[int] = []
    cache, cached = ([0] * (1 << cache_bits) if cache_bits else []), 0

    def symbol(table: tuple[list[int], int]) -> int:
        if bits.count < 16:
            bits.fill()
        e = table[0][bits.held & table[1]]
        bits.held >>= e & 15
        bits.count -= e & 15
        return e >> 4

    while len(out) < total:
        at = len(out)
        own = tables[group_of[(at // width >> shift) * across + (at % width >> shift)] if group_of else 0]
        s = symbol(own[0])
        if s < LITERALS:
            red, blue = symbol(own[1]), symbol(own[2])
            out.append(symbol(own[3]) << 24 | red << 16 | s << 8 | blue)
        elif s < LITERALS + LENGTHS:
            length = _read_value(bits, s - LITERALS)
            back = _distance(_read_value(bits, symbol(own[4])), width)
            if back > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out.append(out[-back])
        else:
            while cached < at:
                p = out[cached]
                cache[(p * HASH & 0xFFFFFFFF) >> (32 - cache_bits)] = p
                cached += 1
            out.append(cache[s - LITERALS - LENGTHS])
    return np.array(out, dtype=np.uint32)


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = near_places()[code - 1]
    return max(1, dx + dy * width)


def _read_green(bits: Bits, lengths: tuple[int, ...], table: tuple[list[int], int], far: tuple[list[int], int], width: int, total: int) -> np.ndarray:
    """An image of which only green varies: several literals for each look-up, back-references as they come."""
    # a table of runs pays off for codes that many pictures share, and for large pictures
    shared = lengths == text_code() or total > 1 << 17
    runs, widths = literal_runs(lengths) if shared else ([b""], [0])
    out, mask = bytearray(), (1 << WINDOW) - 1 if shared else 0
    held, count = bits.held, bits.count
    while len(out) < total:
        if count < 32:
            bits.held, bits.count = held, count
            bits.fill()
            held, count = bits.held, bits.count
        i = held & mask
        run = runs[i]
        if run:
            out += run
            held >>= widths[i]
            count -= widths[i]
            continue
        e = table[0][held & table[1]]
        bits.held, bits.count = held >> (e & 15), count - (e & 15)
        if e >> 4 < LITERALS:
            out.append(e >> 4)
        else:
            length = _read_value(bits, (e >> 4) - LITERALS)
            if bits.count < 16:
                bits.fill()
            e = far[0][bits.held & far[1]]
            bits.read(e & 15)
            back = _distance(_read_value(bits, e >> 4), width)
            if back > len(out) or len(out) + length > total:
                raise ValueError("a back-reference leaves the image")
            while length > 0:
                piece = out[len(out) - back : len(out) - back + length]
                out += piece
                length -= len(piece)
        held, count = bits.held, bits.count
    return np.frombuffer(bytes(out[:total]), dtype=np.uint8)


# ---- transforms ---------------------------------------------------------------------------------------------------


def _average(a, b):
    return (a + b) >> 1


def predicted(mode: int, left, top, corner, right):
    """One prediction from neighbours, channel by channel on (..., 4) integers (alpha, red, green, blue)."""
    if mode == 0:
        return np.array([255, 0, 0, 0])
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode in (6, 7, 8, 9):
        return _average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        to_left = np.abs(top - corner).sum(axis=-1, keepdims=True)
        to_top = np.abs(left - corner).sum(axis=-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = _average(left, top)
        # halves are cut towards zero
        return np.clip(mean + np.fix((mean - corner) / 2).astype(np.int64), 0, 255)
    raise ValueError("no such predictor")


def predict(image: np.ndarray, modes: np.ndarray, size_bits: int, inverse: bool) -> np.ndarray:
    """Residuals of (height, width, 4) by the blocks' modes, or the image of residuals."""
    height, width, _ = image.shape
    out = image.astype(np.int64)
    source = out if inverse else out.copy()
    black = np.array([255, 0, 0, 0])
    sign = 1 if inverse else -1
    for y in range(height) if inverse else range(height - 1, -1, -1):
        row, above = source[y], source[y - 1] if y else None
        if y == 0:
            guess = np.concatenate([black[None], row[:-1]])
            out[0] = np.concatenate([out[0, :1] + black, out[0, 1:]]).cumsum(axis=0) & 255 if inverse else (out[0] - guess) & 255
            continue
        own = modes[y >> size_bits][np.arange(width) >> size_bits]
        own[0] = 2
        right = np.concatenate([above[1:], row[:1]]) if not inverse else None
        if inverse:
            right = np.concatenate([above[1:], above[:1]])
            first = (out[y, 0] + above[0]) & 255
            right[-1] = first  # the last pixel's upper right is the row's own first pixel
        corner = np.concatenate([above[:1], above[:-1]])
        if inverse and (own[1:] == 1).all():
            out[y, 0] += above[0]
            out[y] = out[y].cumsum(axis=0) & 255
            continue
        if inverse and np.isin(own, (1, 5, 6, 7, 10, 11, 12, 13)).any():
            for x in range(width):
                left = out[y, x - 1] if x else above[0]
                out[y, x] = (out[y, x] + predicted(int(own[x]), left, above[x], corner[x], right[x])) & 255
            continue
        left = np.concatenate([above[:1], row[:-1]])
        guess = np.empty_like(row)
        for mode in np.unique(own).tolist():
            at = own == mode
            guess[at] = predicted(mode, left[at], above[at], corner[at], right[at])
        out[y] = (out[y] + sign * guess) & 255
    return out.astype(np.uint8)


def cross_colour(image: np.ndarray, factors: np.ndarray, size_bits: int, inverse: bool) -> np.ndarray:
    """Red and blue less (or plus) their blocks' shares of green and red; ``factors``: red from green, blue from green, blue from red."""
    height, width, _ = image.shape
    own = factors[np.arange(height)[:, None] >> size_bits, np.arange(width)[None] >> size_bits].astype(np.int8).astype(np.int64)
    out = image.astype(np.int64)
    signed = lambda x: x.astype(np.uint8).astype(np.int8).astype(np.int64)
    sign = 1 if inverse else -1
    green = signed(out[..., 2])
    before = signed(out[..., 1])
    red = (out[..., 1] + sign * (own[..., 0] * green >> 5)) & 255
    whole = signed(red) if inverse else before  # blue's share is of the true red
    out[..., 3] = (out[..., 3] + sign * ((own[..., 1] * green >> 5) + (own[..., 2] * whole >> 5))) & 255
    out[..., 1] = red
    return out.astype(np.uint8)


def subtract_green(image: np.ndarray, inverse: bool) -> np.ndarray:
    out = image.copy()
    for k in (1, 3):
        out[..., k] = out[..., k] + out[..., 2] if inverse else out[..., k] - out[..., 2]
    return out


def bundle_bits(colours: int) -> int:
    """log2 of how many palette indexes share a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def to_palette(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(colours, image of indexes in green, bundled)`` of an image of at most 256 colours."""
    height, width, _ = image.shape
    argb = _argb(image)
    colours, index = np.unique(argb, return_inverse=True)
    bits = bundle_bits(len(colours))
    per, depth = 1 << bits, 8 >> bits
    padded = np.zeros((height, -(-width // per) * per), dtype=np.int64)
    padded[:, :width] = index.reshape(height, width)
    green = (padded.reshape(height, -1, per) << (depth * np.arange(per))).sum(axis=2)
    out = np.zeros((*green.shape, 4), dtype=np.uint8)
    out[..., 0], out[..., 2] = 255, green
    return colours, out


def from_palette(image: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    bits = bundle_bits(len(colours))
    per, depth = 1 << bits, 8 >> bits
    index = (image[..., 2].astype(np.int64)[..., None] >> (depth * np.arange(per)) & ((1 << depth) - 1)).reshape(len(image), -1)[:, :width]
    known = np.append(colours, np.zeros(256, dtype=np.uint32))  # indexes beyond the palette are transparent black
    return _channels(known[index])


def _argb(image: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(image).view(">u4")[..., 0].astype(np.uint32)


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(argb.astype(">u4")).view(np.uint8).reshape(*argb.shape, 4)


# ---- files --------------------------------------------------------------------------------------------------------


def encode(image: np.ndarray, transforms: list[tuple] = (), cache_bits: int = 0, copy: bool = True, given: tuple[int, ...] | None = None) -> bytes:
    """A WebP file of (height, width, 4) samples in the order alpha, red, green, blue.

    ``transforms`` are applied in order: ``(PREDICTOR, modes, size_bits)``, ``(CROSS_COLOUR, factors, size_bits)``,
    ``(SUBTRACT_GREEN,)``, ``(PALETTE,)``.
    """
    height, width, _ = image.shape
    header = [(0x2F, 8), (width - 1, 14), (height - 1, 14), (int((image[..., 0] < 255).any()), 1), (0, 3)]
    values, widths = [], []

    def put(fields: list[tuple[int, int]], value: np.ndarray = np.zeros(0, np.int64), bits: np.ndarray = np.zeros(0, np.int64)) -> None:
        own = _columns(tuple(fields))
        values.extend([own[0], value])
        widths.extend([own[1], bits])

    put(header)
    for kind, *how in transforms:
        put([(1, 1), (kind, 2)])
        if kind == SUBTRACT_GREEN:
            image = subtract_green(image, False)
        elif kind == PALETTE:
            colours, image = to_palette(image)
            put([(len(colours) - 1, 8)])
            parts = _channels(colours).astype(np.int64)
            deltas = np.concatenate([parts[:1], np.diff(parts, axis=0) & 255]).astype(np.uint8)
            put(*write_image(_argb(deltas), len(colours), False))
        else:
            data, size_bits = how
            put([(size_bits - 2, 3)])
            image = (predict if kind == PREDICTOR else cross_colour)(image, data, size_bits, False)
            sub = np.zeros((*data.shape[:2], 4), dtype=np.uint8)
            sub[..., 0] = 255
            if kind == PREDICTOR:
                sub[..., 2] = data
            else:
                sub[..., 3], sub[..., 2], sub[..., 1] = data[..., 0], data[..., 1], data[..., 2]
            put(*write_image(_argb(sub).ravel(), sub.shape[1], False))
    put([(0, 1)])
    pixels = _argb(image).ravel()
    put(*write_image(pixels, image.shape[1], True, cache_bits, repeats(pixels) if copy else [], given))
    body = pack_bits(np.concatenate(values), np.concatenate(widths))
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) samples (alpha, red, green, blue) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image")
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        at += 8 + size + size % 2
    bits = Bits(data[at + 8 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")])
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless image")
    full, height = 1 + bits.read(14), 1 + bits.read(14)
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    width, undo = full, []
    while bits.read(1):
        kind = bits.read(2)
        if kind == SUBTRACT_GREEN:
            undo.append((kind, None, 0, width))
        elif kind == PALETTE:
            n = 1 + bits.read(8)
            deltas = _channels(read_image(bits, n, 1, False)).astype(np.int64)
            undo.append((kind, _argb((deltas.cumsum(axis=0) & 255).astype(np.uint8)), 0, width))
            width = -(-width >> bundle_bits(n))
        else:
            size_bits = 2 + bits.read(3)
            across, down = -(-width >> size_bits), -(-height >> size_bits)
            sub = _channels(read_image(bits, across, down, False)).reshape(down, across, 4)
            undo.append((kind, sub[..., 2] & 15 if kind == PREDICTOR else sub[..., [3, 2, 1]], size_bits, width))
    image = _channels(read_image(bits, width, height, True)).reshape(height, width, 4)
    for kind, own, size_bits, before in reversed(undo):
        if kind == SUBTRACT_GREEN:
            image = subtract_green(image, True)
        elif kind == PALETTE:
            image = from_palette(image, own, before)
        else:
            image = (predict if kind == PREDICTOR else cross_colour)(image, own, size_bits, True)
    return image


# ---- media columns ------------------------------------------------------------------------------------------------

UNIT = 64
BLOCK = 9  # log2 of a predictor block's side
TALLEST = 1 << 14
STRIP = UNIT * TALLEST  # samples of a picture


@lru_cache(maxsize=1)
def text_code() -> tuple[int, ...]:
    """Green code lengths for prose, by rule: common letters first. One code for all texts keeps its look-up tables at hand."""
    weight = np.ones(LITERALS + LENGTHS)
    weight[LITERALS:] = 4.0
    weight[128:192] = 20.0
    weight[0x20:0x7F] = 30.0
    weight[ord("A") : ord("Z") + 1] = 60.0
    for rank, c in enumerate("etanoirshdlucmfgwpvbykqxjz"):
        weight[ord(c)] = 9_000 / (rank + 4)
    weight[ord(" ")], weight[0xC3], weight[ord(",")], weight[ord(".")] = 3_500, 300, 250, 250
    return tuple(code_lengths((weight * 16).astype(np.int64), LONGEST_CODE))


@lru_cache(maxsize=1)
def _text_costs() -> np.ndarray:
    """Bits of each literal under the prose code."""
    return np.array(text_code()[:LITERALS], dtype=np.int64)


def payload(raw: bytes) -> bytes:
    """Bytes with zeros added, up to a positive multiple of 64."""
    return raw + b"\0" * (-len(raw) % UNIT or UNIT * (not raw))


def _own_bits(counts: np.ndarray) -> float:
    """About what literals cost with a code of their own: their entropy, and five bits for each symbol of the code."""
    some = counts[counts > 0]
    return float((some * np.log2(some.sum() / some)).sum()) + 5 * len(some)


def store(data: bytes) -> bytes:
    """Grey pictures with one sample for each byte, 64 to a row: one of up to 1 MB each, one after the other.

    Red and blue are green, which the subtract-green transform folds away; what is left has one channel, so that a literal is one symbol and neither
    a colour cache nor cross-colour could save a bit. The samples decide the rest: a palette for few values, a predictor where differences to the
    left or upper sample save a tenth, a code of their own where it saves a quarter of what the prose code needs (that code's look-up tables are at hand, others are made for each picture).
    """
    return b"".join(_picture(data[at : at + STRIP]) for at in range(0, len(data), STRIP))


def _picture(data: bytes) -> bytes:
    grey = np.frombuffer(data, dtype=np.uint8).reshape(-1, UNIT)
    image = np.stack([np.full_like(grey, 255), grey, grey, grey], axis=2)
    counts = np.bincount(grey.ravel(), minlength=256)
    if np.count_nonzero(counts) <= 16:
        return encode(image, [(PALETTE,)])
    prose, own = int(counts @ _text_costs()[:256]), _own_bits(counts)
    flat = grey.ravel()
    costs = [_own_bits(np.bincount(flat[k:] - flat[:-k], minlength=256)) * len(flat) / (len(flat) - k) for k in (1, UNIT) if len(flat) > k]
    if costs and min(costs) < 0.9 * min(prose, own):
        modes = np.full((-(-len(grey) >> BLOCK), 1), 1 + int(np.argmin(costs)), dtype=np.int64)  # left or upper
        return encode(image, [(SUBTRACT_GREEN,), (PREDICTOR, modes, BLOCK)])
    return encode(image, [(SUBTRACT_GREEN,)], given=text_code() if 0.75 * prose <= own else None)


def pictures(data: bytes) -> Iterator[bytes]:
    """The files that :func:`store` put one after the other."""
    at = 0
    while at < len(data):
        size = 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + size]
        at += size


def features(samples: np.ndarray) -> str:
    """Mean, entropy in bits, and a 64-bit difference hash of 8 x 9 cell means, from decoded samples."""
    flat = samples.ravel()
    share = np.bincount(flat, minlength=256) / flat.size
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    edges = np.arange(73) * flat.size // 72
    sums = np.append(0, np.cumsum(flat, dtype=np.int64))
    means = ((sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(1, np.diff(edges))).reshape(8, 9)
    bits = np.packbits(means[:, 1:] > means[:, :-1]).tobytes().hex()
    return f"{flat.mean():.3f}:{abs(entropy):.4f}:{bits}"


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, n_bytes, payload_bytes, media)``: each whole text as lossless WebP pictures; null text is empty.

    A picture holds up to 1 MB of a text (16,384 rows of 64 samples), longer ones are several, so memory is bounded by that and the text itself. Equal
    texts have equal media; repeated rows stay repeated, null ids stay null; extra columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            raw = [x or b"" for x in as_bytes(batch, "text")]
            sizes = [pa.array([len(x) for x in raw], pa.int64()), pa.array([len(payload(x)) for x in raw], pa.int64())]
            media = pa.array([store(payload(x)) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *sizes, media], names=["doc_id", "n_bytes", "payload_bytes", "media"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """Rows ``(doc_id, n_bytes, payload_bytes, media, payload_sha256, tail_crc32, feature)`` from decoded pictures, one for each row of :func:`to_media`.

    Equal media give equal values; repeated rows and null ids stay; media of several pictures are one payload; an empty table gives an empty result; other
    columns are ignored. A few MB of media are decoded at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "media"):
            back, seen = [], []
            for data, size in zip(as_bytes(batch, "media"), batch.column("payload_bytes").to_pylist()):
                samples = np.concatenate([decode(p)[..., 2].ravel() for p in pictures(data)])
                back.append(samples.tobytes()[:size])
                seen.append(features(samples))
            columns = {
                "payload_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                "tail_crc32": pa.array([zlib.crc32(x[-UNIT:]) for x in back], pa.int64()),
                "feature": pa.array(seen, pa.string()),
            }
            kept = ["doc_id", "n_bytes", "payload_bytes", "media"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *columns.values()], names=[*kept, *columns])

    schema = "doc_id long, n_bytes long, payload_bytes long, media binary, payload_sha256 string, tail_crc32 long, feature string"
    return media.mapInArrow(run, schema)
