"""Lossless WebP (the VP8L format of RFC 9649): a full decoder, and an encoder for byte payloads and test images.

Pixels are 32-bit ARGB numbers. The decoder knows prefix codes, meta prefix codes, back-references, the colour cache and
all four transforms. Where red, blue and alpha have one value each (an image of single samples) it looks up as many
symbols at once as 16 bits hold; the tables are kept by code lengths, so that images with the same code share them.
"""

from __future__ import annotations

import functools
import heapq
import struct

import numpy as np

LENGTH_CODES, DISTANCE_CODES = 24, 40
# Fixed values of the format: the order of code length codes.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
# Fixed values of the format: the pixels, as (x to the left, y above), that the 120 short distance codes stand for.
NEAR = [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
        (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
        (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
        (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
        (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
        (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7)]
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
MAX_SIDE = 1 << 14


class BadImage(ValueError):
    pass


class Bits:
    """Reads numbers from the lowest bit on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data + bytes(8), at

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data):
            raise BadImage("the data end early")
        return v


def reversed_bits(v: int, n: int) -> int:
    return int(f"{v:0{n}b}"[::-1], 2) if n else 0


def canonical(lengths) -> dict[int, tuple[int, int]]:
    """{symbol: (code with its first bit lowest, length)}."""
    code, out, last = 0, {}, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out[s] = (reversed_bits(code, n), n)
        code, last = code + 1, n
    return out


class Prefix:
    """A prefix code, decoded by a table on its longest length; only one symbol takes no bits."""

    def __init__(self, lengths: tuple[int, ...]):
        self.lengths = lengths
        used = [s for s, n in enumerate(lengths) if n]
        self.only = used[0] if len(used) == 1 else None
        if not used:
            raise BadImage("a prefix code without symbols")
        if self.only is not None:
            self.width = 0
            return
        self.width = max(lengths)
        if sum(1 << (self.width - lengths[s]) for s in used) != 1 << self.width:
            raise BadImage("an incomplete prefix code")
        symbols, sizes = np.zeros(1 << self.width, np.int32), np.zeros(1 << self.width, np.int32)
        for s, (c, n) in canonical(lengths).items():
            symbols[c :: 1 << n], sizes[c :: 1 << n] = s, n
        self.symbols, self.sizes = symbols, sizes
        self._lists = None

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self._lists is None:
            self._lists = self.symbols.tolist(), self.sizes.tolist()
        w = bits.peek(self.width)
        bits.at += self._lists[1][w]
        return self._lists[0][w]

    @functools.cached_property
    def runs(self) -> tuple[list[bytes], list[int], list[int]]:
        """For each 16 bits: the literal bytes that they hold from the start, and the bits and bytes of those."""
        w = np.arange(1 << 16, dtype=np.int64)
        text, used, going = np.zeros((1 << 16, 8), np.uint8), np.zeros(1 << 16, np.int64), np.ones(1 << 16, bool)
        count = np.zeros(1 << 16, np.int64)
        for k in range(8):
            rest = (w >> used) & ((1 << self.width) - 1)
            s, n = self.symbols[rest], self.sizes[rest]
            going &= (s < 256) & (used + n <= 16)
            text[:, k] = np.where(going, s, 0)
            used += np.where(going, n, 0)
            count += going
        flat, c = text.tobytes(), count.tolist()
        return [flat[8 * i : 8 * i + c[i]] for i in range(1 << 16)], used.tolist(), c


@functools.lru_cache(maxsize=64)
def prefix(lengths: tuple[int, ...]) -> Prefix:
    return Prefix(lengths)


def read_prefix(bits: Bits, size: int) -> Prefix:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        for symbol in [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else []):
            if symbol >= size:
                raise BadImage("a symbol outside its alphabet")
            lengths[symbol] = 1
        return prefix(tuple(lengths))
    outer = [0] * 19
    for i in range(4 + bits.read(4)):
        outer[CODE_LENGTH_ORDER[i]] = bits.read(3)
    code = prefix(tuple(outer))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at, last = at + 1, s or last
            continue
        value, n = (last, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
        if at + n > size:
            raise BadImage("too many code lengths")
        lengths[at : at + n] = [value] * n
        at += n
    return prefix(tuple(lengths))


def extended(bits: Bits, code: int) -> int:
    """The number that a length or distance symbol and its extra bits stand for."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def cells(n: int, bits: int) -> int:
    return -(-n // (1 << bits))


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Decode an entropy-coded image; main: it may have several groups of prefix codes."""
    total = width * height
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise BadImage("a colour cache of over 11 bits")
    groups, where, tile = 1, None, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        where = (read_image(bits, cells(width, tile), cells(height, tile), False) >> 8) & 0xFFFF
        groups = int(where.max()) + 1
    cache_size = (1 << cache_bits) if cache_bits else 0
    codes = [[read_prefix(bits, n) for n in (256 + LENGTH_CODES + cache_size, 256, 256, 256, DISTANCE_CODES)] for _ in range(groups)]
    if groups == 1 and not cache_bits and all(c.only is not None for c in codes[0][1:4]) and codes[0][0].only is None:
        return read_samples(bits, width, total, codes[0])
    out = [0] * total
    cache = [0] * cache_size
    shift = 32 - cache_bits
    at = 0
    row = cells(width, tile) if where is not None else 0
    where = where.tolist() if where is not None else None
    while at < total:
        g = codes[where[(at // width >> tile) * row + (at % width >> tile)]] if where else codes[0]
        s = g[0].read(bits)
        if s < 256:
            red, blue, alpha = g[1].read(bits), g[2].read(bits), g[3].read(bits)
            pixels = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 256 + LENGTH_CODES:
            n = extended(bits, s - 256)
            d = distance(extended(bits, g[4].read(bits)), width)
            if d > at or at + n > total:
                raise BadImage("a back-reference outside the image")
            for i in range(at, at + n):
                out[i] = out[i - d]
            pixels = out[at : at + n]
        else:
            pixels = [cache[s - 256 - LENGTH_CODES]]
        out[at : at + len(pixels)] = pixels
        at += len(pixels)
        if cache_size:
            for p in pixels:
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> shift] = p
        if bits.at > 8 * len(bits.data):
            raise BadImage("the data end early")
    return np.array(out, np.uint32)


def read_samples(bits: Bits, width: int, total: int, codes: list[Prefix]) -> np.ndarray:
    """An image in which only green varies."""
    green, fixed = codes[0], codes[3].only << 24 | codes[1].only << 16 | codes[2].only
    runs, used, count = green.runs
    a = np.frombuffer(bits.data, np.uint8).astype(np.uint32)
    view = (a[:-3] | a[1:-2] << np.uint32(8) | a[2:-1] << np.uint32(16) | a[3:] << np.uint32(24)).tolist()
    last = len(view) * 8
    out, n, at = [], 0, bits.at
    put = out.append
    while n < total:
        if at >= last:
            raise BadImage("the data end early")
        w = (view[at >> 3] >> (at & 7)) & 0xFFFF
        k = count[w]
        if k and n + k <= total:
            put(runs[w])
            at += used[w]
            n += k
            continue
        bits.at = at
        s = green.read(bits)
        if s < 256:
            put(bytes([s]))
            n += 1
        else:
            length = extended(bits, s - 256)
            d = distance(extended(bits, codes[4].read(bits)), width)
            if d > n or n + length > total:
                raise BadImage("a back-reference outside the image")
            if d == 1 and out[-1:]:
                put(out[-1][-1:] * length)
            else:
                so_far = b"".join(out)
                piece = so_far[n - d : n - d + length]
                put((piece * (length // len(piece) + 1))[:length])
                out[:-1] = [so_far]
            n += length
        at = bits.at
    bits.at = at
    return np.frombuffer(b"".join(out), np.uint8).astype(np.uint32) << np.uint32(8) | np.uint32(fixed)


def channels(p: np.ndarray) -> np.ndarray:
    """uint8 array (..., 4) of blue, green, red, alpha."""
    return np.ascontiguousarray(p.astype("<u4")).view(np.uint8).reshape(*p.shape, 4)


def pixels(c: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(c.astype(np.uint8)).view("<u4").reshape(c.shape[:-1]).astype(np.uint32)


def predicted(mode: int, left, top, top_right, top_left):
    """The prediction of one pixel, from tuples of four channels."""
    half = lambda a, b: tuple((x + y) >> 1 for x, y in zip(a, b, strict=True))
    clamp = lambda v: 0 if v < 0 else 255 if v > 255 else v
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return half(half(left, top_right), top)
    if mode == 6:
        return half(left, top_left)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(top_left, top)
    if mode == 9:
        return half(top, top_right)
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return tuple(clamp(x + y - c) for x, y, c in zip(left, top, top_left, strict=True))
    if mode == 13:
        return tuple(clamp(m + int((m - c) / 2)) for m, c in zip(half(left, top), top_left, strict=True))
    return (0, 0, 0, 255)


def predict(p: np.ndarray, width: int, height: int, modes: np.ndarray, size: int, undo: bool) -> np.ndarray:
    """Add predictions to residuals (undo), or take them from pixels."""
    src = [tuple(x) for x in channels(p).reshape(-1, 4).tolist()]
    out = list(src)
    known = out if undo else src
    row = cells(width, size)
    for y in range(height):
        for x in range(width):
            i = y * width + x
            if not y:
                guess = known[i - 1] if x else (0, 0, 0, 255)
            elif not x:
                guess = known[i - width]
            else:
                guess = predicted(int(modes[(y >> size) * row + (x >> size)]), known[i - 1], known[i - width], known[i - width + 1], known[i - width - 1])
            out[i] = tuple((a + g) & 255 if undo else (a - g) & 255 for a, g in zip(src[i], guess, strict=True))
    return pixels(np.array(out, np.uint8))


def cross(p: np.ndarray, width: int, height: int, elements: np.ndarray, size: int, undo: bool) -> np.ndarray:
    c = channels(p).reshape(height, width, 4).astype(np.int32)
    ys, xs = np.arange(height) >> size, np.arange(width) >> size
    e = channels(elements).reshape(-1, cells(width, size), 4)[ys][:, xs].view(np.int8).astype(np.int32)
    green_to_red, green_to_blue, red_to_blue = e[..., 0], e[..., 1], e[..., 2]
    signed = lambda v: v.astype(np.uint8).view(np.int8).astype(np.int32)
    green, red = signed(c[..., 1]), c[..., 2]
    sign = 1 if undo else -1
    new_red = (red + sign * (green_to_red * green >> 5)) & 255
    true_red = signed(new_red if undo else red)
    c[..., 0] = (c[..., 0] + sign * ((green_to_blue * green >> 5) + (red_to_blue * true_red >> 5))) & 255
    c[..., 2] = new_red
    return pixels(c.reshape(-1, 4))


def bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def unbundle(p: np.ndarray, width: int, height: int, table: np.ndarray) -> np.ndarray:
    bits = bundle_bits(len(table))
    packed = ((p >> 8) & 255).reshape(height, -1)
    depth = 8 >> bits
    x = np.arange(width)
    index = (packed[:, x >> bits] >> ((x & ((1 << bits) - 1)) * depth).astype(np.uint32)) & ((1 << depth) - 1)
    full = np.zeros(256, np.uint32)  # an index outside the table is transparent black
    full[: len(table)] = table
    return full[index].ravel()


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(name, body) of the chunks of a WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise BadImage("not a WebP file")
    out, at, end = [], 12, min(len(data), 8 + struct.unpack("<I", data[4:8])[0])
    while at + 8 <= end:
        n = struct.unpack("<I", data[at + 4 : at + 8])[0]
        out.append((data[at : at + 4], data[at + 8 : min(end, at + 8 + n)]))
        at += 8 + n + (n & 1)
    return out


def decode(data: bytes) -> np.ndarray:
    """The ARGB pixels of a lossless WebP file, height x width."""
    stream = next((body for name, body in chunks(data) if name == b"VP8L"), b"")
    if len(stream) < 5 or stream[0] != 0x2F:
        raise BadImage("not a lossless WebP file")
    bits = Bits(stream[1:])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise BadImage("an unknown version")
    transforms, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [t[0] for t in transforms]:
            raise BadImage("a transform comes twice")
        if kind in (PREDICTOR, CROSS):
            size = bits.read(3) + 2
            transforms.append((kind, inner, size, read_image(bits, cells(inner, size), cells(height, size), False)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = pixels(np.cumsum(channels(read_image(bits, n, 1, False)), axis=0, dtype=np.uint64).astype(np.uint8))
            transforms.append((kind, inner, 0, table))
            inner = cells(inner, bundle_bits(n))
        else:
            transforms.append((kind, inner, 0, None))
    p = read_image(bits, inner, height, True)
    for kind, w, size, extra in reversed(transforms):
        if kind == PREDICTOR:
            p = predict(p, w, height, (extra >> 8) & 15, size, True)
        elif kind == CROSS:
            p = cross(p, w, height, extra, size, True)
        elif kind == GREEN:
            c = channels(p)
            c[:, 0] += c[:, 1]
            c[:, 2] += c[:, 1]
            p = pixels(c)
        else:
            p = unbundle(p, w, height, extra)
    return p.reshape(height, width)


# --- writing ---


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def code_lengths(weights, most: int = 15) -> tuple[int, ...]:
    """Huffman code lengths of at most `most` bits; small weights are raised until that holds."""
    weights = list(weights)
    some = [s for s, w in enumerate(weights) if w]
    if len(some) == 1:
        return tuple(int(s == some[0]) for s in range(len(weights)))
    floor = 1
    while True:
        heap = [(max(weights[s], floor), s, (s,)) for s in some]
        heapq.heapify(heap)
        lengths = [0] * len(weights)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(lengths) <= most:
            return tuple(lengths)
        floor *= 2


def write_prefix(out: Writer, lengths: tuple[int, ...]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and max(used, default=0) < 256:
        used = used or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(int(used[0] > 1), 1)
        out.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            out.put(used[1], 8)
        return
    items, i = [], 0  # (symbol, extra value, extra bits)
    while i < len(lengths):
        j = i
        while j < len(lengths) and lengths[j] == lengths[i]:
            j += 1
        n = j - i
        if not lengths[i]:
            while n >= 11:
                k = min(n, 138)
                items.append((18, k - 11, 7))
                n -= k
            if n >= 3:
                items.append((17, n - 3, 3))
                n = 0
        else:
            items.append((lengths[i], 0, 0))
            n -= 1
            while n >= 3:
                k = min(n, 6)
                items.append((16, k - 3, 2))
                n -= k
        items += [(lengths[i], 0, 0)] * n
        i = j
    weights = [0] * 19
    for s, _, _ in items:
        weights[s] += 1
    if sum(map(bool, weights)) == 1:
        weights[0 if not weights[0] else 1] += 1
    outer = code_lengths(weights, 7)
    out.put(0, 1)
    last = max(i for i, s in enumerate(CODE_LENGTH_ORDER) if outer[s] or i < 4)
    out.put(last + 1 - 4, 4)
    for s in CODE_LENGTH_ORDER[: last + 1]:
        out.put(outer[s], 3)
    out.put(0, 1)
    codes = canonical(outer)
    for s, v, n in items:
        out.put(*codes[s])
        out.put(v, n)


def prefixed(value: int) -> tuple[int, int, int]:
    """The symbol, extra value and extra bits of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    high = value.bit_length() - 1
    second = (value >> (high - 1)) & 1
    return 2 * high + second, value & ((1 << (high - 1)) - 1), high - 1


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + bytes(len(body) & 1)


def riff(stream: bytes, extended: tuple[int, int, int] | None = None) -> bytes:
    """A file with one image; extended: (width, height, length) gives the extended layout with a chunk for the length."""
    body = b"WEBP"
    if extended:
        width, height, length = extended
        body += _chunk(b"VP8X", bytes(4) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little"))
    body += _chunk(b"VP8L", b"\x2f" + stream)
    if extended:
        body += _chunk(LENGTH, struct.pack("<Q", length))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def write_image(out: Writer, p: np.ndarray, width: int, main: bool, cache_bits: int = 0, lz: bool = False, tile: int = 0) -> None:
    """Write pixels; lz: with back-references to equal pixels; tile: with one group of prefix codes for each of two
    halves of the tiles of that size in bits. For small images: symbol by symbol."""
    height = len(p) // width
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    groups, where = 1, None
    if main:
        out.put(int(tile > 0), 1)
        if tile:
            out.put(tile - 2, 3)
            cw, ch = cells(width, tile), cells(height, tile)
            where = np.arange(cw * ch) % 2
            groups = 2 if cw * ch > 1 else 1
            write_image(out, (where.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000), cw, False)
    items, cache, seen, i, values = [], {}, {}, 0, p.tolist()
    while i < len(values):
        x, y = i % width, i // width
        g = int(where[(y >> tile) * cells(width, tile) + (x >> tile)]) if where is not None else 0
        v, n, d = values[i], 0, 0
        if lz and v in seen:
            d = i - seen[v]
            while i + n < len(values) and n < 4096 and values[i + n] == values[i + n - d]:
                n += 1
        key = (0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if n >= 3:
            near = next((k + 1 for k, (dx, dy) in enumerate(NEAR) if max(1, dx + dy * width) == d), d + 120)
            items.append((g, "copy", prefixed(n), prefixed(near)))
        elif cache_bits and cache.get(key) == v:
            items.append((g, "cache", key))
            n = 1
        else:
            items.append((g, "pixel", v))
            n = 1
        for j in range(i, i + n):
            seen[values[j]] = j
            if cache_bits:
                cache[(0x1E35A7BD * values[j] & 0xFFFFFFFF) >> (32 - cache_bits)] = values[j]
        i += n
    weights = [[[0] * n for n in (256 + LENGTH_CODES + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)] for _ in range(groups)]
    steps = []
    for g, kind, *rest in items:
        w = weights[g]
        if kind == "pixel":
            v = rest[0]
            parts = [(0, v >> 8 & 255), (1, v >> 16 & 255), (2, v & 255), (3, v >> 24)]
            extras = [(0, 0)] * 4
        elif kind == "cache":
            parts, extras = [(0, 256 + LENGTH_CODES + rest[0])], [(0, 0)]
        else:
            parts, extras = [(0, 256 + rest[0][0]), (4, rest[1][0])], [rest[0][1:], rest[1][1:]]
        for c, s in parts:
            w[c][s] += 1
        steps.append((g, parts, extras))
    lengths = [[code_lengths(w) if any(w) else (1, *[0] * (len(w) - 1)) for w in ws] for ws in weights]
    for ls in lengths:
        for one in ls:
            write_prefix(out, one)
    codes = [[canonical(one) if sum(map(bool, one)) > 1 else None for one in ls] for ls in lengths]
    for g, parts, extras in steps:
        for (c, s), (v, n) in zip(parts, extras, strict=True):
            if codes[g][c] is not None:
                out.put(*codes[g][c][s])
            out.put(v, n)


def encode(image: np.ndarray, transforms=(), cache_bits: int = 0, lz: bool = False, tile: int = 0, size: int = 3, mode: int = 11, element=(16, -9, 5)) -> bytes:
    """A lossless WebP file of ARGB pixels (height x width), with the transforms named, in that order."""
    height, width = image.shape
    p, out, inner = image.ravel().astype(np.uint32), Writer(), width
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    for kind in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        n = cells(inner, size) * cells(height, size)
        if kind == PREDICTOR:
            out.put(size - 2, 3)
            modes = (mode + np.arange(n)) % 14
            write_image(out, (modes.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000), cells(inner, size), False)
            p = predict(p, inner, height, modes, size, False)
        elif kind == CROSS:
            out.put(size - 2, 3)
            red, green, blue = (v & 255 for v in element)
            e = np.full(n, 0xFF000000 | red << 16 | green << 8 | blue, np.uint32)
            write_image(out, e, cells(inner, size), False)
            p = cross(p, inner, height, e, size, False)
        elif kind == GREEN:
            c = channels(p)
            c[:, 0] -= c[:, 1]
            c[:, 2] -= c[:, 1]
            p = pixels(c)
        else:
            table, index = np.unique(p, return_inverse=True)
            out.put(len(table) - 1, 8)
            c = channels(table)
            write_image(out, pixels(np.diff(c.astype(np.int32), axis=0, prepend=np.zeros((1, 4), np.int32)) & 255), len(table), False)
            bits = bundle_bits(len(table))
            packed = np.zeros((height, cells(inner, bits)), np.uint32)
            grid = index.reshape(height, inner)
            for x in range(inner):
                packed[:, x >> bits] |= (grid[:, x] << ((x & ((1 << bits) - 1)) * (8 >> bits))).astype(np.uint32)
            p, inner = (packed.ravel() << np.uint32(8)) | np.uint32(0xFF000000), packed.shape[1]
    out.put(0, 1)
    write_image(out, p, inner, True, cache_bits, lz, tile)
    return riff(out.bytes())


# --- byte payloads: images of single samples, written with one of a few codes ---

ROW, RUN, LONGEST = 64, 8, 4096


def _model(kind: str) -> list[int]:
    """Weights of the symbols of green for a kind of text, by classes of bytes."""
    w = [2] * 256 + [1] * LENGTH_CODES
    w[0] = 4
    for c in b" \n.,'-":
        w[c] = 400
    w[32] = {"flat": 400, "upper": 2500}.get(kind, 4500)
    letters, others = (range(97, 123), range(65, 91)) if kind != "upper" else (range(65, 91), range(97, 123))
    for i in letters:
        w[i] = 250
    for i in others:
        w[i] = 40 if kind != "upper" else 60
    frequent = b"etaonhirsd" if kind != "upper" else b"ETAONHIRSD"
    for place, c in enumerate(frequent):
        w[c] = 2600 - 200 * place
    for c in range(48, 58):
        w[c] = 60
    if kind == "flat":
        w = [100] * 256 + [1] * LENGTH_CODES
    if kind == "utf8":
        for c in range(128, 192):
            w[c] = 60
        w[0xC3] = 900
        for c in b"\xa0\xa1\xa4\xa7\xa8\xa9\xaa\xad\xb1\xb3\xb6\xbc\x9f\xba":
            w[c] = 180
    if kind == "signs":
        for c in b"!#$%&*|":
            w[c] = 900
    return w


KINDS = ("prose", "utf8", "signs", "upper", "flat")


@functools.cache
def payload_code(kind: str):
    """(lengths, codes and sizes by byte, the stream's bits between the image's size and its pixels)."""
    lengths = code_lengths(_model(kind))
    codes = canonical(lengths)
    head = Writer()
    head.put(0, 1)  # no transform
    head.put(0, 1)  # no colour cache
    head.put(0, 1)  # one group of prefix codes
    write_prefix(head, lengths)
    for symbol, size in ((0, 256), (0, 256), (255, 256), (1, DISTANCE_CODES)):  # red, blue, alpha; distance code 2, the pixel before
        write_prefix(head, tuple(int(s == symbol) for s in range(size)))
    code = np.array([codes[s][0] for s in range(256)], np.uint64)
    size = np.array([codes[s][1] for s in range(256)], np.int64)
    return lengths, codes, code, size, head


#: The chunk that holds a payload's length, where the image has more samples; bytes of a payload in one image at most.
LENGTH, MOST = b"PLEN", MAX_SIDE * MAX_SIDE


def payload_shape(n: int) -> tuple[int, int]:
    """Width and height of the image of n bytes, a positive multiple of 64 up to MOST."""
    rows = n // ROW
    wide = -(-rows // MAX_SIDE)
    return ROW * wide, -(-rows // wide)


def encode_payload(payload: bytes) -> bytes:
    """A payload (a positive multiple of 64 bytes) as green samples; one file, or above MOST bytes several in a row."""
    return b"".join(_encode_part(payload[i : i + MOST]) for i in range(0, len(payload), MOST))


def _bits(a: np.ndarray) -> tuple[int, str]:
    """The bits that samples take in the code that suits them best, and its name."""
    hist = np.bincount(a, minlength=256)
    return min((int(hist @ payload_code(k)[3]), KINDS.index(k), k) for k in KINDS)[::2]


def _encode_part(payload: bytes) -> bytes:
    """Runs become back-references; a payload of up to 16 values gets a palette, several samples to a pixel, if that is
    shorter."""
    width, height = payload_shape(len(payload))
    a = np.frombuffer(payload + bytes(width * height - len(payload)), np.uint8)
    first = Writer()
    for v, n in ((width - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
        first.put(v, n)
    cost, kind = _bits(a)
    table = np.flatnonzero(np.bincount(a, minlength=256))
    if len(table) <= 16:
        bits = bundle_bits(len(table))
        index = np.zeros(256, np.uint8)
        index[table] = np.arange(len(table))
        grid = index[a].reshape(height, -1, 1 << bits)
        packed = (grid << (np.arange(1 << bits) * (8 >> bits)).astype(np.uint8)).sum(axis=2, dtype=np.uint8).ravel()
        packed_cost, packed_kind = _bits(packed)
        if packed_cost + 12 * len(table) + 60 < cost:
            a, kind = packed, packed_kind
            colours = channels((table.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000))
            for v, n in ((1, 1), (PALETTE, 2), (len(table) - 1, 8)):
                first.put(v, n)
            write_image(first, pixels(np.diff(colours.astype(np.int32), axis=0, prepend=np.zeros((1, 4), np.int32)) & 255), len(table), False)
    _, codes, code, size, head = payload_code(kind)
    first.put(head.value, head.n)
    values, sizes = code[a], size[a]
    edges = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    spans = np.diff(np.append(edges, len(a)))
    keep = None
    for start, n in zip(edges[spans > RUN].tolist(), spans[spans > RUN].tolist(), strict=True):
        if keep is None:
            keep, values, sizes = np.ones(len(a), bool), values.copy(), sizes.copy()
        at, left = start + 1, n - 1
        while left:
            k = min(left, LONGEST)
            s, extra, bits = prefixed(k)
            c, ln = codes[256 + s]
            values[at], sizes[at] = c | extra << ln, ln + bits
            keep[at + 1 : at + k] = False
            at, left = at + k, left - k
    if keep is not None:
        values, sizes = values[keep], sizes[keep]
    ends = np.cumsum(sizes) + first.n
    starts = ends - sizes
    word, shift = starts >> 6, (starts & 63).astype(np.uint64)
    lead = np.frombuffer(first.bytes() + bytes(-len(first.bytes()) % 8), np.uint64)
    out = np.zeros(max(len(lead), int(ends[-1] >> 6) + 2), np.uint64)
    begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[begin]] |= np.bitwise_or.reduceat(values << shift, begin)
    over = np.flatnonzero((starts & 63) + sizes > 64)
    out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    out[: len(lead)] |= lead
    stream = out.tobytes()[: (int(ends[-1]) + 7) // 8]
    return riff(stream, None if width * height == len(payload) else (width, height, len(payload)))


def decode_payload(data: bytes) -> tuple[bytes, list[np.ndarray]]:
    """The payload that files hold, by what they say of its length, and their samples as images."""
    payload, images, at = [], [], 0
    while at < len(data) or not images:
        end = at + 8 + struct.unpack("<I", data[at + 4 : at + 8])[0] if len(data) >= at + 8 else len(data) + 1
        if end > len(data):
            raise BadImage("the data end early")
        image = ((decode(data[at:end]) >> np.uint32(8)) & np.uint32(255)).astype(np.uint8)
        length = next((struct.unpack("<Q", body)[0] for name, body in chunks(data[at:end]) if name == LENGTH), image.size)
        payload.append(image.tobytes()[:length])
        images.append(image)
        at = end
    return b"".join(payload), images
