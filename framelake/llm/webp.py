"""Lossless WebP: an encoder and a decoder of whole images, and texts stored as grey images.

The decoder reads prefix codes, back-references and the colour cache, and inverts the palette, predictor,
cross-colour and subtract-green transforms. Where one group of prefix codes and no cache is used, every bit offset is
looked up at once, and only the chain of offsets at which symbols really begin is followed one by one.

Texts are padded with zero bytes to a positive multiple of 64 and stored as grey images 64 wide, or wider if they would
be taller than the format allows; beyond one image's size as several files one after another. Each file has a
form that its samples alone decide. Nulls are empty texts; an empty table gives no rows; repeated rows give equal values;
texts of any length are stored whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from framelake.llm.common import map_batches, table

# Fixed values of the format.
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
LARGEST = 1 << 14
#: Multipliers by which green predicts equal red and blue, for values below 128; and one file in so many has the predictor.
GREY, SHARE = 0x2020, 256
#: Near places by distance code: nearest first, then by |x|, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class Bits:
    """Reads bits, the lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        at, self.at = self.at, self.at + n
        return (int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)


def code_lengths(counts: dict[int, int], most: int = 15) -> dict[int, int]:
    """Huffman code lengths, none above ``most``: counts are flattened until the tree is shallow enough."""
    if len(counts) == 1:
        return {next(iter(counts)): 1}
    floor = 0
    while True:
        heap = [(max(c, floor), s, None) for s, c in counts.items()]
        heapq.heapify(heap)
        k = 1 << 20
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], k, (a, b)))
            k += 1
        out, todo = {}, [(heap[0], 0)]
        while todo:
            (_, s, kids), d = todo.pop()
            if kids:
                todo += [(kids[0], d + 1), (kids[1], d + 1)]
            else:
                out[s] = d
        if max(out.values()) <= most:
            return out
        floor = max(2 * floor, sum(counts.values()) >> most, 1)


_REVERSED = np.array([int(f"{i:015b}"[::-1], 2) for i in range(1 << 15)], np.int64)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by symbol, as they are written from the lowest bit, for lengths of 0 (none) to 15."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    own = lengths[order].astype(np.int64)
    codes = np.zeros(len(lengths), np.int64)
    if len(order):
        start = np.concatenate([[0], np.cumsum(1 << (15 - own))[:-1]])  # left-aligned canonical codes
        codes[order] = _REVERSED[start]
    return codes


class Code:
    """A prefix code as a table by the next ``bits`` bits: symbols and lengths. One symbol alone takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.only = int(used[0]) if len(used) == 1 else None
        if len(used) < 2:
            self.bits, self.symbol, self.size = 0, np.array([self.only or 0]), np.array([0])
            return
        own = lengths[used].astype(np.int64)
        order = np.lexsort((used, own))
        used, own = used[order], own[order]
        self.bits = top = int(own[-1])
        n = 1 << (top - own)
        if int(n.sum()) != 1 << top:
            raise ValueError("the prefix code isn't complete")
        at = _REVERSED[np.arange(1 << top)] >> (15 - top)
        self.symbol, self.size = np.repeat(used, n)[at], np.repeat(own, n)[at]

    def read(self, bits: Bits) -> int:
        at = bits.at
        k = (int.from_bytes(bits.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)) & ((1 << self.bits) - 1)
        bits.at += int(self.size[k])
        return int(self.symbol[k])


def read_code(bits: Bits, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    small = np.zeros(19, np.int64)
    for k in range(4 + bits.read(4)):
        small[LENGTH_ORDER[k]] = bits.read(3)
    code = Code(small)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    symbol, size, mask, data = code.symbol.tolist(), code.size.tolist(), (1 << code.bits) - 1, bits.data
    at, k, last = bits.at, 0, 8
    while k < alphabet and left:
        left -= 1
        x = int.from_bytes(data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)
        s, n = symbol[x & mask], size[x & mask]
        at += n
        x >>= n
        if s < 16:
            if s:
                lengths[k] = last = s
            k += 1
            continue
        extra, base, value = ((2, 3, last), (3, 3, 0), (7, 11, 0))[s - 16]
        n = base + (x & ((1 << extra) - 1))
        at += extra
        if value:
            lengths[k : k + n] = value
        k += n
    bits.at = at
    return Code(lengths)


def _value(prefix: int, bits: Bits) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def read_pixels(bits: Bits, width: int, height: int, outer: bool) -> np.ndarray:
    """An entropy-coded image as 32-bit pixels (alpha, red, green, blue from the top)."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    meta, shift = None, 0
    if outer and bits.read(1):
        shift = bits.read(3) + 2
        w, h = (width + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift
        meta = (read_pixels(bits, w, h, False).reshape(h, w) >> 8) & 0xFFFF
    groups = [[read_code(bits, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(int(meta.max()) + 1 if meta is not None else 1)]
    if len(groups) == 1 and not cache_bits:
        return _parallel(bits, groups[0], width, width * height)
    return _serial(bits, groups, meta, shift, cache_bits, width, width * height)


def _serial(bits: Bits, groups: list, meta, shift: int, cache_bits: int, width: int, n: int) -> np.ndarray:
    out, cache, k, cached = [0] * n, [0] * (1 << cache_bits if cache_bits else 0), 0, 0
    while k < n:
        g = groups[int(meta[(k // width) >> shift, (k % width) >> shift]) if meta is not None else 0]
        s = g[0].read(bits)
        if s < 256:
            red = g[1].read(bits)
            blue = g[2].read(bits)
            out[k] = g[3].read(bits) << 24 | red << 16 | s << 8 | blue
            k += 1
        elif s < 280:
            length = _value(s - 256, bits)
            distance = _distance(_value(g[4].read(bits), bits), width)
            if distance > k or k + length > n:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out[k] = out[k - distance]
                k += 1
        else:
            while cached < k:
                cache[(CACHE_FACTOR * out[cached] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[cached]
                cached += 1
            out[k] = cache[s - 280]
            k += 1
    return np.array(out, np.int64)


def _parallel(bits: Bits, group: list[Code], width: int, n: int, span: int = 1 << 20) -> np.ndarray:
    """As _serial, by windows of ``span`` bits in which the symbol at every offset is looked up at once."""
    out, k, at = np.zeros(n, np.int64), 0, bits.at
    green, red, blue, alpha, far = group
    plain = all(c.bits == 0 for c in (red, blue, alpha))
    base = int(alpha.symbol[0]) << 24 | int(red.symbol[0]) << 16 | int(blue.symbol[0])
    if green.bits == 0 and plain and (green.only or 0) < 256:
        out[:] = base | (green.only or 0) << 8
        return out
    refs = bool((green.symbol >= 256).any())
    data = np.frombuffer(bits.data, np.uint8)
    while k < n:
        first = at >> 3
        raw = np.zeros(min(len(data) - first, span >> 3) + 24, np.uint32)
        own = data[first : first + len(raw) - 4]
        raw[: len(own)] = own
        word = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
        ahead = (word[:, None] >> np.arange(8, dtype=np.uint32)).reshape(-1)
        room = len(ahead)
        here = ahead & np.uint32((1 << green.bits) - 1)
        size = green.size.astype(np.int32)[here]
        after = np.arange(room, dtype=np.int32) + size
        if not plain:
            for c in (red, blue, alpha):
                after = np.minimum(after, room - 1)
                after += c.size.astype(np.int32)[ahead[after] & np.uint32((1 << c.bits) - 1)]
        if refs:
            some = np.flatnonzero(green.symbol[here] >= 256)
            p = some + size[some]
            prefix = green.symbol[here[some]] - 256
            p += np.where(prefix < 4, 0, (prefix - 2) >> 1)
            p = np.minimum(p, room - 1)
            x = ahead[p] & np.uint32((1 << far.bits) - 1)
            p += far.size[x] + np.where(far.symbol[x] < 4, 0, (far.symbol[x] - 2) >> 1)
            after[some] = p
        end = room - 160 if first + (span >> 3) < len(data) else room
        at, q = _chain(np.minimum(after, room - 1), at - first * 8, end)
        symbol = green.symbol[here[q]]
        if refs:
            is_ref = symbol >= 256
            j = np.flatnonzero(is_ref)
            length, p = _values(symbol[j] - 256, ahead, q[j] + size[q[j]])
            x = ahead[p] & np.uint32((1 << far.bits) - 1)
            code, _ = _values(far.symbol[x], ahead, p + far.size[x])
            ends = np.ones(len(q), np.int64)
            ends[j] = length
            stop = int(np.searchsorted(np.cumsum(ends), n - k)) + 1
        else:
            stop = n - k
        if not len(q):
            raise ValueError("the image ends early")
        if stop < len(q):
            at, q, symbol = int(q[stop]), q[:stop], symbol[:stop]
        at += first * 8
        pixel = base | symbol << 8
        if not plain:
            r = q + size[q]
            pixel = symbol << 8
            for c, up in ((red, 16), (blue, 0), (alpha, 24)):
                x = ahead[r] & np.uint32((1 << c.bits) - 1)
                pixel |= c.symbol[x] << up
                r = r + c.size[x]
        if not refs:
            out[k : k + len(q)] = pixel
            k += len(q)
            continue
        last = 0
        for i, n_, d in [*((i, n_, _distance(d, width)) for i, n_, d in zip(j.tolist(), length.tolist(), code.tolist(), strict=True) if i < len(q)), (len(q), 0, 0)]:
            out[k : k + i - last] = pixel[last:i]
            k += i - last
            last = i + 1
            if not n_:
                continue
            if d > k or k + n_ > n:
                raise ValueError("a back-reference leaves the image")
            out[k : k + n_] = out[k - d : k - d + n_] if d >= n_ else np.resize(out[k - d : k], n_)
            k += n_
    bits.at = at
    return out


def _chain(after: np.ndarray, at: int, end: int) -> tuple[int, np.ndarray]:
    """(the first place not below ``end``, the places before) on the way from ``at``: eight steps at a time, then those between."""
    steps = [after]
    for _ in range(3):
        steps.append(steps[-1][steps[-1]])
    jump, far = memoryview(steps[3]), []
    p = at
    while p < end:
        far.append(p)
        q = jump[p]
        if q == p:
            break
        p = q
    q = np.array(far, np.int64)
    for step in steps[2::-1]:
        q = np.stack([q, step[q]], 1).reshape(-1)
    if p < end:  # the last place leads to itself
        p = end
    beyond = np.flatnonzero(q >= end)
    n = int(beyond[0]) if len(beyond) else len(q)
    return int(q[n]) if n < len(q) else int(p), q[:n]


def _values(prefix: np.ndarray, ahead: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of length or distance symbols whose extra bits begin at ``at``, and where these end."""
    extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    at = np.minimum(at, len(ahead) - 1)
    low = ahead[at].astype(np.int64) & ((1 << extra) - 1)
    return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << extra) + low) + 1, np.minimum(at + extra, len(ahead) - 1)


def _channels(x: np.ndarray) -> list[np.ndarray]:
    return [(x >> up) & 255 for up in (24, 16, 8, 0)]


def _joined(a, r, g, b) -> np.ndarray:
    return a << 24 | r << 16 | g << 8 | b


def _added(x: int, y: int) -> int:
    return ((x & 0xFF00FF00) + (y & 0xFF00FF00)) & 0xFF00FF00 | ((x & 0x00FF00FF) + (y & 0x00FF00FF)) & 0x00FF00FF


def _mean(x: int, y: int) -> int:
    return (((x ^ y) & 0xFEFEFEFE) >> 1) + (x & y)


def _bytes4(x: int) -> tuple[int, int, int, int]:
    return x >> 24, x >> 16 & 255, x >> 8 & 255, x & 255


def _clip(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _chosen(left: int, top: int, corner: int) -> int:
    to_left = sum(abs(t - c) for t, c in zip(_bytes4(top), _bytes4(corner), strict=True))
    to_top = sum(abs(t - c) for t, c in zip(_bytes4(left), _bytes4(corner), strict=True))
    return left if to_left < to_top else top


def predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The predictor's guess from the left, top, top-right and top-left pixels."""
    if mode in (0, 14, 15):
        return 0xFF000000
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode <= 10:
        return (
            lambda: _mean(_mean(left, right), top),
            lambda: _mean(left, corner),
            lambda: _mean(left, top),
            lambda: _mean(corner, top),
            lambda: _mean(top, right),
            lambda: _mean(_mean(left, corner), _mean(top, right)),
        )[mode - 5]()
    if mode == 11:
        return _chosen(left, top, corner)
    if mode == 12:
        parts = [_clip(a + b - c) for a, b, c in zip(_bytes4(left), _bytes4(top), _bytes4(corner), strict=True)]
    else:
        m = _mean(left, top)
        parts = [_clip(a + int((a - c) / 2)) for a, c in zip(_bytes4(m), _bytes4(corner), strict=True)]
    return parts[0] << 24 | parts[1] << 16 | parts[2] << 8 | parts[3]


def _guess(out: list[int], k: int, width: int, modes: np.ndarray, shift: int) -> int:
    y, x = divmod(k, width)
    if not y:
        return out[k - 1] if x else 0xFF000000
    if not x:
        return out[k - width]
    return predicted(int(modes[y >> shift, x >> shift]), out[k - 1], out[k - width], out[k - width + 1], out[k - width - 1])


def _delta(by: np.ndarray, colour: np.ndarray) -> np.ndarray:
    return (by.astype(np.uint8).view(np.int8).astype(np.int64) * colour.astype(np.uint8).view(np.int8)) >> 5


def _cross(x: np.ndarray, by: np.ndarray, sign: int) -> np.ndarray:
    """Colours with (sign 1) or without (-1) what green and red say of them; by: a transform pixel for each."""
    a, r, g, b = _channels(x)
    _, red_blue, green_blue, green_red = _channels(by)
    new = (r + sign * _delta(green_red, g)) & 255
    return _joined(a, new, g, (b + sign * (_delta(green_blue, g) + _delta(red_blue, new if sign > 0 else r))) & 255)


def _spread(small: np.ndarray, shift: int, width: int, height: int) -> np.ndarray:
    return small[np.arange(height)[:, None] >> shift, np.arange(width)[None, :] >> shift].reshape(-1)


def decode(file: bytes) -> np.ndarray:
    """Pixels (height, width) of one file, as 32-bit alpha, red, green, blue."""
    if file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L" or file[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(file[21 : 20 + int.from_bytes(file[16:20], "little")])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(4)
    steps, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            w, h = (inner + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift
            steps.append((kind, shift, read_pixels(bits, w, h, False).reshape(h, w), inner))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colours = read_pixels(bits, n, 1, False)
            colours = _joined(*(np.cumsum(c) & 255 for c in _channels(colours)))
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, pack, colours, inner))
            inner = (inner + (1 << pack) - 1) >> pack
        else:
            steps.append((kind, 0, None, inner))
    x = read_pixels(bits, inner, height, True)
    for kind, shift, small, w in reversed(steps):
        if kind == SUBTRACT_GREEN:
            a, r, g, b = _channels(x)
            x = _joined(a, (r + g) & 255, g, (b + g) & 255)
        elif kind == CROSS_COLOUR:
            x = _cross(x, _spread(small, shift, w, height), 1)
        elif kind == PALETTE:
            each = 8 >> shift
            k = ((x >> 8) & 255).reshape(height, -1)
            k = ((k[:, :, None] >> (np.arange(1 << shift) * each)) & ((1 << each) - 1)).reshape(height, -1)[:, :w]
            x = np.concatenate([small, np.zeros(256, np.int64)])[k].reshape(-1)
        else:
            out, modes, diff = [0] * len(x), (small >> 8) & 15, x.tolist()
            for i, d in enumerate(diff):
                out[i] = _added(d, _guess(out, i, w, modes, shift))
            x = np.array(out, np.int64)
    return x.reshape(height, width)


class Writer:
    """Collects (value, bits) and packs them, the lowest bit first."""

    def __init__(self):
        self.values, self.sizes, self.waiting = [], [], []

    def put(self, value: int, size: int) -> None:
        self.waiting.append((value, size))

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        if self.waiting:
            pairs = np.array(self.waiting, np.int64)
            self.values.append(pairs[:, 0])
            self.sizes.append(pairs[:, 1])
            self.waiting = []
        self.values.append(values)
        self.sizes.append(sizes)

    def packed(self) -> bytes:
        self.many(np.zeros(1, np.int64), np.zeros(1, np.int64))
        values, sizes = np.concatenate(self.values).astype(np.uint64), np.concatenate(self.sizes)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        words = np.zeros((int(ends[-1]) >> 5) + 2, np.uint64)
        at, shifted = starts >> 5, values << (starts & 31).astype(np.uint64)
        heads = np.flatnonzero(np.diff(at, prepend=-1))
        words[at[heads]] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), heads)
        words[at[heads] + 1] += np.add.reduceat(shifted >> np.uint64(32), heads)
        return words.astype("<u4").tobytes()[: (int(ends[-1]) + 7) >> 3]


def _put_code(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        own = used.tolist() or [0]
        w.put(1 | (len(own) - 1) << 1 | 1 << 2 | own[0] << 3, 11)
        if len(own) == 2:
            w.put(own[1], 8)
        return
    out, last = [], 8
    for value, same in groupby(lengths[: used[-1] + 1].tolist()):
        n = len(list(same))
        if value and value != last:
            out.append((value, 0, 0))
            last, n = value, n - 1
        while n >= 3:
            k = min(n, 138 if not value else 6)
            out.append((18, k - 11, 7) if not value and k >= 11 else (17, k - 3, 3) if not value else (16, k - 3, 2))
            n -= k
        out += [(value, 0, 0)] * n
    counts: dict[int, int] = {}
    for s, _, _ in out:
        counts[s] = counts.get(s, 0) + 1
    small = np.zeros(19, np.int64)
    for s, n in code_lengths(counts, 7).items():
        small[s] = n
    keep = max(k for k in range(19) if small[LENGTH_ORDER[k]] or k < 4) + 1
    w.put(keep - 4 << 1, 5)
    for k in range(keep):
        w.put(int(small[LENGTH_ORDER[k]]), 3)
    w.put(1, 1)
    nbits = max(2, (len(out) - 2).bit_length() + 1 & ~1)
    w.put((nbits - 2) // 2 | (len(out) - 2) << 3, 3 + nbits)
    codes, sizes = canonical(small).tolist(), small.tolist() if len(counts) > 1 else [0] * 19
    for s, extra, n in out:
        w.put(codes[s] | extra << sizes[s], sizes[s] + n)


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra value and extra bits of lengths or distances from 1."""
    v = value - 1
    top = np.maximum(np.floor(np.log2(np.maximum(v, 1))).astype(np.int64), 1)
    extra = np.where(v < 4, 0, top - 1)
    symbol = np.where(v < 4, v, 2 * top + ((v >> (top - 1)) & 1))
    return symbol, np.where(v < 4, 0, v - ((2 + (symbol & 1)) << extra)), extra


def repeats(x: np.ndarray, least: int = 24, most: int = 4096) -> list[tuple[int, int, int]]:
    """(place, length, distance) of passages that occurred before, looked for after each line feed or full stop."""
    raw = x.astype(np.uint8).tobytes()
    starts = np.flatnonzero((x[:-1] == 10) | (x[:-1] == 46)) + 1
    seen: dict[bytes, int] = {}
    out, done = [], 0
    for k in starts.tolist():
        key = raw[k : k + least]
        if k >= done and len(key) == least and (before := seen.get(key)) is not None:
            n, room = least, min(most, len(raw) - k)
            while n < room and raw[before + n : before + n + 64] == raw[k + n : k + n + 64] and n + 64 <= room:
                n += 64
            while n < room and raw[before + n] == raw[k + n]:
                n += 1
            out.append((k, n, k - before))
            done = k + n
        seen[key] = k
    return out


def _put_pixels(w: Writer, x: np.ndarray, width: int, outer: bool, cache_bits: int = 0, meta: np.ndarray | None = None, shift: int = 0, refs: list | None = None) -> None:
    """Writes an entropy-coded image. meta: a group number for each block of 2^shift pixels a side."""
    w.put(1 | cache_bits << 1, 5) if cache_bits else w.put(0, 1)
    if outer:
        if meta is None:
            w.put(0, 1)
        else:
            w.put(1 | shift - 2 << 1, 4)
            _put_pixels(w, meta.reshape(-1) << 8, meta.shape[1], False)
    one = not len(x) or bool((x & 0xFFFF00FF == int(x[0]) & 0xFFFF00FF).all())  # only green varies
    a, r, g, b = (None, None, (x >> 8) & 255, None) if one else _channels(x)
    green, literal, alive = g, np.ones(len(x), bool), np.ones(len(x), bool)
    refs = refs or []
    far = np.zeros(len(x), np.int64)
    if refs:
        at, length, distance = (np.array(c, np.int64) for c in zip(*refs, strict=True))
        extra = np.zeros((len(refs), 4), np.int64)  # value and bits after the length symbol, then after the distance symbol
        green[at], extra[:, 0], extra[:, 1] = _prefix(length)
        green[at] += 256
        far[at], extra[:, 2], extra[:, 3] = _prefix(distance + 120)
        literal[at] = False
        for k, n in zip(at.tolist(), length.tolist(), strict=True):
            alive[k + 1 : k + n] = False
    if cache_bits:
        cache = [None] * (1 << cache_bits)
        for k, p in enumerate(x.tolist()):
            slot = (CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)
            if literal[k] and alive[k] and cache[slot] == p:
                green[k], literal[k] = 280 + slot, False
            cache[slot] = p
    group = None if meta is None else _spread(meta, shift, width, len(x) // width)
    columns = []
    is_ref = (green >= 256) & (green < 280)
    for k in range(int(group.max()) + 1 if meta is not None else 1):
        own = alive & (group == k) if group is not None else alive if refs else None
        for col, symbols, mask, alphabet in ((0, green, None, 280 + (1 << cache_bits if cache_bits else 0)), (1, r, literal, 256), (2, b, literal, 256), (3, a, literal, 256), (4, far, is_ref, 40)):
            if col and one and not (col == 4 and refs):
                w.put(5 | (int(x[0]) >> (0, 16, 0, 24, 0)[col] & 255 if col < 4 else 0) << 3, 11)
                continue
            some = own if mask is None or not (refs or cache_bits or col == 4) else mask if own is None else own & mask
            s = symbols if some is None else symbols[some]
            counts = np.bincount(s, minlength=alphabet)
            used = np.flatnonzero(counts)
            lengths = np.zeros(alphabet, np.int64)
            if len(used):
                for i, n in code_lengths(dict(zip(used.tolist(), counts[used].tolist(), strict=True)), 12).items():
                    lengths[i] = n
            _put_code(w, lengths)
            if len(used) > 1:
                codes = canonical(lengths)
                if some is None:
                    columns.append((col, codes[s], lengths[s]))
                else:
                    full = np.zeros((2, len(x)), np.int64)
                    full[:, some] = codes[s], lengths[s]
                    columns.append((col, *full))
    if refs:
        full = {c: (v, n) for c, v, n in columns}
        none = np.zeros(len(x), np.int64)
        (value, size), (far_value, far_size) = full.get(0, (none, none)), full.get(4, (none, none))
        places = np.flatnonzero(is_ref[alive]) + 1
        at = np.flatnonzero(is_ref)
        places = np.repeat(places, 3)
        w.many(
            np.insert(value[alive], places, np.stack([extra[:, 0], far_value[at], extra[:, 2]], 1).reshape(-1)),
            np.insert(size[alive], places, np.stack([extra[:, 1], far_size[at], extra[:, 3]], 1).reshape(-1)),
        )
    elif columns:
        by = [[x for x in columns if x[0] == c] for c in sorted({x[0] for x in columns})]
        by = [(sum(x[1] for x in own), sum(x[2] for x in own)) for own in by]  # groups don't overlap
        w.many(np.stack([v for v, _ in by], 1).reshape(-1), np.stack([n for _, n in by], 1).reshape(-1))


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (SUBTRACT_GREEN,), cache_bits: int = 0, mode: int = 11, cross: int = 0x00100810, meta: int = 0, refs: bool = True) -> bytes:
    """A file of the pixels (height, width). mode, cross: predictor and colour multipliers, for the whole image; meta:
    groups of prefix codes, by turns over blocks of 16 pixels a side."""
    height, width = pixels.shape
    x, w = pixels.reshape(-1).astype(np.int64), Writer()
    w.put(0x2F | (width - 1) << 8 | (height - 1) << 22 | 1 << 36, 40)
    wide, shift = width, 4
    for kind in transforms:
        w.put(1 | kind << 1, 3)
        blocks = ((wide + 15) >> 4, (height + 15) >> 4)
        if kind == SUBTRACT_GREEN:
            a, r, g, b = _channels(x)
            x = _joined(a, (r - g) & 255, g, (b - g) & 255)
        elif kind == PALETTE:
            colours, k = np.unique(x, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("too many colours for a palette")
            w.put(len(colours) - 1, 8)
            _put_pixels(w, _joined(*(np.diff(c, prepend=0) & 255 for c in _channels(colours))), len(colours), False)
            pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            full = np.zeros((height, -(-wide // (1 << pack)) << pack), np.int64)
            full[:, :wide] = k.reshape(height, wide)
            wide = full.shape[1] >> pack
            x = 0xFF000000 | ((full.reshape(height, wide, -1) << (np.arange(1 << pack) * (8 >> pack))).sum(2).reshape(-1) << 8)
        elif kind == CROSS_COLOUR:
            w.put(shift - 2, 3)
            small = np.full(blocks[::-1], cross | 0xFF000000, np.int64)
            _put_pixels(w, small.reshape(-1), blocks[0], False)
            x = _cross(x, _spread(small, shift, wide, height), -1)
        else:
            w.put(shift - 2, 3)
            modes = np.full(blocks[::-1], mode, np.int64)
            _put_pixels(w, 0xFF000000 | modes.reshape(-1) << 8, blocks[0], False)
            own = x.tolist()
            guess = np.array([_guess(own, k, wide, modes, shift) for k in range(len(own))], np.int64)
            x = _joined(*((c - d) & 255 for c, d in zip(_channels(x), _channels(guess), strict=True)))
    w.put(0, 1)
    groups = (np.arange(-(-height // 16))[:, None] + np.arange(-(-wide // 16))[None, :]) % meta if meta else None
    found = repeats((x >> 8) & 255) if refs and meta == 0 and not cache_bits and (x & 0xFFFF00FF == x[0] & 0xFFFF00FF).all() else []
    _put_pixels(w, x, wide, True, cache_bits, groups, shift, found)
    data = w.packed()
    data += b"\0" * (len(data) & 1)
    return b"RIFF" + (len(data) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (64 - len(raw) if not raw else -len(raw) % 64), len(raw)


def stored(payload: bytes) -> bytes:
    """Files of grey images, one after another, that hold the payload (a multiple of 64 bytes)."""
    out = []
    for k in range(0, len(payload), LARGEST * 1024):
        part = payload[k : k + LARGEST * 1024]
        width = 64
        while len(part) > width * LARGEST:
            width *= 2
        grey = np.frombuffer(part + b"\0" * (-len(part) % width), np.uint8).astype(np.int64)
        pixels = (0xFF000000 | grey * 0x10101).reshape(-1, width)
        out.append(encode(pixels, **form_of(grey)))
    return b"".join(out)


def form_of(grey: np.ndarray) -> dict:
    """How grey samples are stored, by their content alone, whatever their number.

    Samples of at most 16 values are indexes of a palette, several to a pixel. Of the others one file in SHARE, by checksum,
    has the predictor and one the colour cache, which take longer and seldom less room for text. The rest leave one channel:
    where all samples are below 128, as in ASCII, green predicts red and blue by the colour transform; else it is subtracted.
    """
    if len(np.unique(grey)) <= 16:
        return {"transforms": (PALETTE,)}
    kind = zlib.crc32(grey.astype(np.uint8).tobytes())
    if kind % SHARE == 0:
        return {"transforms": (PREDICTOR, SUBTRACT_GREEN), "mode": 1 + kind // SHARE % 2}
    if kind % SHARE == 1:
        return {"transforms": (SUBTRACT_GREEN,), "cache_bits": 4}
    return {"transforms": (CROSS_COLOUR,), "cross": GREY} if grey.max() < 128 else {"transforms": (SUBTRACT_GREEN,)}


def restored(media: bytes, size: int) -> bytes:
    out, at = [], 0
    while at < len(media):
        n = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append((decode(media[at : at + n]) & 255).astype(np.uint8).tobytes())
        at += n
    return b"".join(out)[:size]


def features(payload: bytes) -> str:
    """Of the samples: 16 shares of equal bands of values in thousandths, mean, and mean step between neighbours."""
    x = np.frombuffer(payload, np.uint8)
    shares = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    return ",".join(map(str, shares.tolist())) + f";{x.mean():.4f};{np.abs(np.diff(x.astype(np.int16))).mean():.4f}"


def media(docs: DataFrame) -> DataFrame:
    """Each text stored as a grey image and read back; the columns are those of op1_webp."""

    def f(batch: dict[str, list]) -> dict[str, list]:
        rows = []
        for text in batch["text"]:
            payload, n = padded(text)
            file = stored(payload)
            back = restored(file, len(payload))
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(file), hashlib.sha256(file).hexdigest(), features(back)))
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        return {"doc_id": batch["doc_id"]} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(docs, f, schema, ["doc_id", "text"])


def op1_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(table(spark, sf_dir, "documents"))
