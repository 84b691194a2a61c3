"""Lossless WebP in numpy: a reader of the whole lossless format and a writer that can use each of its tools.

The reader decodes prefix codes (simple and normal, one or many groups), back-references and the colour
cache, and inverts the predictor, cross-colour, subtract-green and palette transforms. Images in which green
alone varies, as the writer makes of 8-bit samples, are decoded in stretches: the symbol, reference and length
that would begin at every bit are tabled at once, the bits at which one really begins follow by hops of
eight, and only copies run one by one. All other images are decoded symbol by symbol.

The writer picks its tools per image. Samples go through a palette or, where that leaves less entropy, the
predictor, and take back-references where they cost fewer bits than literals; a colour cache and the
cross-colour transform gain nothing in one channel, and are weighed by `encode_smallest` for whole pixels.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

MAX_SIDE = 16384
# fixed values of the format: the order of code-length codes, and the neighbours of the short distance codes as (x, y)
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD


# ---- prefix codes


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of an optimal prefix code for the counts, none above `most`; one symbol has length 1 here."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        out[used] = 1
        return out
    order = np.argsort(counts[used], kind="stable")
    weights = counts[used][order].tolist()
    while True:
        # the lightest two of the leaves left and the nodes made so far, both of which come in order
        n = len(weights)
        nodes, parent, leaf, inner = weights + [1 << 62], [0] * (2 * n - 1), 0, n + 1
        for k in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if leaf < n and (inner > k or nodes[leaf] <= nodes[inner]):
                    total += nodes[leaf]
                    parent[leaf] = k
                    leaf += 1
                else:
                    total += nodes[inner]
                    parent[inner - 1] = k
                    inner += 1
            nodes.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if depth[0] <= most:
            out[used[order]] = depth[:n]
            return out
        weights = [(w + 1) // 2 for w in weights]


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol with its bits reversed, as they stand in the stream."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    spans = 1 << (15 - lengths[order])
    # a code, filled up to 15 bits, is the space of the codes before it
    codes[order] = _reversed(15)[(np.cumsum(spans) - spans) & 0x7FFF]
    return codes


class Code:
    """A prefix code as a table over the next `bits` bits: symbol and length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.only = int(used[0]) if len(used) == 1 else -1
        if len(used) == 0:
            self.only = 0
        if self.only >= 0:
            self.bits, self.symbol, self.length = 0, np.array([self.only]), np.zeros(1, np.int64)
            return
        if int((1 << (15 - lengths[used])).sum()) != 1 << 15:
            raise ValueError("a prefix code is not complete")
        self.bits = int(lengths[used].max())
        size = 1 << self.bits
        if self.bits <= 7:
            own = lengths[used].tolist()
            symbol, length, at = [0] * size, [0] * size, 0
            back = _reversed_list(self.bits)
            for n, k in sorted(zip(own, used.tolist(), strict=True)):
                begin, step = back[at], 1 << n
                symbol[begin::step] = [k] * (size >> n)
                length[begin::step] = [n] * (size >> n)
                at += size >> n
            self.symbol, self.length = np.array(symbol), np.array(length)
            return
        # canonical codes in order fill the table of unreversed bits from the left
        order = used[np.argsort(lengths[used], kind="stable")]
        spans = 1 << (self.bits - lengths[order])
        back = _reversed(self.bits)
        self.symbol, self.length = np.empty(size, np.int64), np.empty(size, np.int64)
        self.symbol[back] = np.repeat(order, spans)
        self.length[back] = np.repeat(lengths[order], spans)


@lru_cache(4096)
def _length_code(lengths: tuple[int, ...]) -> tuple[int, list[int], list[int]]:
    """Mask, symbols and sizes of a code of code lengths."""
    code = Code(np.array(lengths))
    return (1 << code.bits) - 1, code.symbol.tolist(), code.length.tolist()


@lru_cache(1)
def _flat8() -> Code:
    """The code of 8 bits for each of 256 symbols, which palettes are written with."""
    return Code(np.concatenate([np.full(256, 8), np.zeros(24, np.int64)]))


@lru_cache(256)
def _single(symbol: int) -> Code:
    return Code(np.bincount([symbol], minlength=symbol + 1))


_reversals: dict[int, np.ndarray] = {}


def _reversed(bits: int) -> np.ndarray:
    if bits not in _reversals:
        x, out = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
        for k in range(bits):
            out |= ((x >> k) & 1) << (bits - 1 - k)
        _reversals[bits] = out
    return _reversals[bits]


@lru_cache(16)
def _reversed_list(bits: int) -> list[int]:
    return _reversed(bits).tolist()


# ---- bits


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        k = self.at >> 3
        return (int.from_bytes(self.data[k : k + 9], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the image ends too early")
        return v

    def symbol(self, code: Code) -> int:
        if code.only >= 0:
            return code.only
        v = self.peek(code.bits)
        self.at += int(code.length[v])
        if self.at > self.end:
            raise ValueError("the image ends too early")
        return int(code.symbol[v])


class Writer:
    def __init__(self):
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values.extend(values.tolist())
        self.sizes.extend(sizes.tolist())


def packed(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Values of up to 16 bits each, one after the other, lowest bit first."""
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    n = int(at[-1] + 7) >> 3
    at = at[:-1]
    spread = values.astype(np.int64) << (at & 7)
    k = at >> 3
    out = np.bincount(k, spread & 255, n + 3) + np.bincount(k + 1, (spread >> 8) & 255, n + 3) + np.bincount(k + 2, spread >> 16, n + 3)
    return out[:n].astype(np.uint8).tobytes()


# ---- reading


def read_code(r: Reader, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.int64)
    if r.read(1):
        two = r.read(1)
        symbol = r.read(8 if r.read(1) else 1)
        lengths[symbol] = 1
        if not two:
            return _single(symbol)
        lengths[r.read(8)] = 1
        return Code(lengths)
    own = [0] * 19
    count = 4 + r.read(4)
    packed_ = r.peek(3 * count)
    r.read(3 * count)
    for i, k in enumerate(LENGTH_ORDER[:count]):
        own[k] = (packed_ >> (3 * i)) & 7
    mask, symbols, sizes = _length_code(tuple(own))
    left = alphabet
    if r.read(1):
        left = 2 + r.read(2 + 2 * r.read(3))
    # at most 14 bits a length: the whole list from one number
    first = r.at
    bits = int.from_bytes(r.data[first >> 3 : (first + 14 * alphabet + 15) >> 3], "little") >> (first & 7)
    out, before, used = [], 8, 0
    while len(out) < alphabet and left:
        left -= 1
        v = bits & mask
        s, n = symbols[v], sizes[v]
        bits >>= n
        used += n
        if s < 16:
            out.append(s)
            before = s or before
            continue
        n, least, fill = ((2, 3, before), (3, 3, 0), (7, 11, 0))[s - 16]
        out += [fill] * (least + (bits & ((1 << n) - 1)))
        bits >>= n
        used += n
    r.at += used
    if len(out) > alphabet:
        raise ValueError("too many code lengths")
    if r.at > r.end:
        raise ValueError("the image ends too early")
    lengths[: len(out)] = out
    flat = alphabet == 280 and (lengths[:256] == 8).all() and not lengths[256:].any()
    return _flat8() if flat else Code(lengths)


def _value(r: Reader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEIGHBOURS):
        return code - len(NEIGHBOURS)
    x, y = NEIGHBOURS[code - 1]
    return max(1, x + y * width)


@lru_cache(64)
def _near(width: int) -> np.ndarray:
    """The distance of each short code, from code 1."""
    return np.array([max(1, x + y * width) for x, y in NEIGHBOURS])


@lru_cache(64)
def _near_codes(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distances that short codes can say, in order, and the first code of each from 0."""
    return np.unique(_near(width), return_index=True)


def _extra(prefix: np.ndarray) -> np.ndarray:
    """How many bits follow a prefix."""
    return np.where(prefix < 4, 0, (prefix - 2) >> 1)


def _values(prefix: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The lengths or distance codes of prefixes and the bits behind them."""
    n = _extra(prefix)
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << n) + (bits & ((1 << n) - 1)) + 1)


#: Bytes decoded together, so few that the tables over their bits stay in cache, and how many more one token may reach into.
STRETCH, MARGIN = 1 << 11, 16


def _green_pixels(r: Reader, codes: list[Code], n: int, width: int) -> np.ndarray | None:
    """Pixels of an image in which green alone varies, without a colour cache; None if it isn't one."""
    green, *rest, far = codes
    if any(c.only < 0 for c in rest):
        return None
    base = (rest[2].only << 24) | (rest[0].only << 16) | rest[1].only
    if green.only >= 0:
        return np.full(n, base | (green.only << 8), np.uint32) if green.only < 256 else None
    every = np.frombuffer(r.data + bytes(MARGIN), np.uint8)
    out = np.zeros(n, np.uint8)
    done, at = 0, r.at
    copying = green.symbol >= 256
    references = bool(copying.any())
    while done < n:
        first = at >> 3
        data = every[first : first + min(STRETCH, 8 * (n - done) + 8) + MARGIN].astype(np.uint32)
        if len(data) <= MARGIN:
            raise ValueError("the image ends too early")
        words = data[:-3] | (data[1:-2] << 8) | (data[2:-1] << 16) | (data[3:] << 24)
        ahead = (words[:, None] >> np.arange(8, dtype=np.uint32)).reshape(-1)  # 25 bits from every bit
        peek = (ahead & ((1 << green.bits) - 1)).astype(np.intp)
        length = green.length.take(peek)
        top, limit = len(ahead) - 1, 8 * (len(data) - MARGIN)
        after = np.arange(top + 1) + length
        if references:
            begins = copying.take(peek).nonzero()[0]
            bits = np.minimum(after[begins], top)
            behind = np.minimum(bits + _extra(green.symbol[peek[begins]] - 256), top)
            way = ahead[behind] & ((1 << far.bits) - 1)
            after[begins] = behind + far.length[way] + _extra(far.symbol[way])
        hop = np.minimum(after, top)
        two = hop.take(hop)
        four = two.take(two)
        eight = memoryview(four.take(four))
        p, heads = at - 8 * first, []
        add = heads.append
        left = n - done
        while p < limit and len(heads) * 8 < left:
            add(p)
            p = eight[p]
        tokens = np.empty((len(heads), 8), np.int64)
        tokens[:, 0] = heads
        tokens[:, 1] = hop[tokens[:, 0]]
        tokens[:, 2:4] = two[tokens[:, :2]]
        tokens[:, 4:] = four[tokens[:, :4]]
        tokens = tokens.reshape(-1)
        tokens = tokens[: np.searchsorted(tokens, limit)]
        kind = green.symbol[peek[tokens]]
        copies = np.flatnonzero(kind >= 256)
        run = np.ones(len(tokens), np.int64)
        if len(copies):
            prefix, bits = kind[copies] - 256, tokens[copies] + length[tokens[copies]]
            run[copies] = _values(prefix, ahead[bits])
        ends = done + np.cumsum(run)
        many = int(np.searchsorted(ends, n)) + 1
        tokens, kind, run, ends = tokens[:many], kind[:many], run[:many], ends[:many]
        begin = ends - run
        if int(ends[-1]) > n:
            raise ValueError("a reference leaves the image")
        plain = kind < 256
        out[begin[plain]] = kind[plain]
        copies = copies[: np.searchsorted(copies, many)]
        if len(copies):
            prefix = kind[copies] - 256
            behind = np.minimum(tokens[copies] + length[tokens[copies]] + _extra(prefix), top)
            way = ahead[behind] & ((1 << far.bits) - 1)
            bits = np.minimum(behind + far.length[way], top)
            back = _values(far.symbol[way], ahead[bits])
            near = _near(width)
            back = np.where(back > len(near), back - len(near), near[np.minimum(back, len(near)) - 1])
            if (back > begin[copies]).any():
                raise ValueError("a reference leaves the image")
            pixels = memoryview(out)
            for k, m, d in zip(begin[copies].tolist(), run[copies].tolist(), back.tolist(), strict=True):
                pixels[k : k + m] = pixels[k - d : k - d + m] if d >= m else (bytes(pixels[k - d : k]) * (m // d + 1))[:m]
        done, at = int(ends[-1]), 8 * first + int(after[tokens[-1]])
    if at > r.end:
        raise ValueError("the image ends too early")
    r.at = at
    return (out.astype(np.uint32) << 8) | np.uint32(base)


def _small_pixels(r: Reader, codes: list[Code], n: int) -> np.ndarray:
    """Pixels of a small image of literals, from one number."""
    bits = int.from_bytes(r.data[r.at >> 3 : (r.at + 60 * n + 15) >> 3], "little") >> (r.at & 7)
    tables = [((1 << c.bits) - 1, c.symbol.tolist(), c.length.tolist(), shift) for c, shift in zip(codes[:4], (8, 16, 0, 24), strict=True)]
    fixed = sum(symbol[0] << shift for mask, symbol, _, shift in tables if not mask)
    tables = [t for t in tables if t[0]]
    out, used = [], 0
    for _ in range(n):
        pixel = fixed
        for mask, symbol, length, shift in tables:
            v = bits & mask
            pixel |= symbol[v] << shift
            size = length[v]
            bits >>= size
            used += size
        out.append(pixel)
    r.at += used
    if r.at > r.end:
        raise ValueError("the image ends too early")
    return np.array(out, np.uint32)


def read_pixels(r: Reader, width: int, height: int, outer: bool) -> np.ndarray:
    """The ARGB values of an entropy-coded image; only the outer one may have several groups of codes."""
    cache_bits = r.read(4) if r.read(1) else 0
    groups, block, entropy = 1, 0, None
    if outer and r.read(1):
        block = r.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        entropy = (read_pixels(r, across, (height + (1 << block) - 1) >> block, False) >> 8) & 0xFFFF
        groups = int(entropy.max()) + 1
    sets = [[read_code(r, k) for k in (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    n = width * height
    if groups == 1 and not cache_bits and (plain := _green_pixels(r, sets[0], n, width)) is not None:
        return plain
    if n <= 512 and groups == 1 and not cache_bits and not (sets[0][0].symbol >= 256).any():
        return _small_pixels(r, sets[0], n)
    out, cache, done = [0] * n, [0] * (1 << cache_bits), 0
    k = x = y = 0
    while k < n:
        codes = sets[int(entropy[(y >> block) * across + (x >> block)])] if entropy is not None else sets[0]
        s = r.symbol(codes[0])
        if s < 256:
            red, blue, alpha = r.symbol(codes[1]), r.symbol(codes[2]), r.symbol(codes[3])
            out[k] = (alpha << 24) | (red << 16) | (s << 8) | blue
            run = 1
        elif s < 280:
            run = _value(r, s - 256)
            back = _distance(_value(r, r.symbol(codes[4])), width)
            if back > k or k + run > n:
                raise ValueError("a reference leaves the image")
            for j in range(k, k + run):
                out[j] = out[j - back]
        else:
            for j in range(done, k):  # the cache follows the pixels so far
                cache[((CACHE_FACTOR * out[j]) & 0xFFFFFFFF) >> (32 - cache_bits)] = out[j]
            done = k
            out[k] = cache[s - 280]
            run = 1
        k += run
        y, x = divmod(k, width)
    return np.array(out, np.uint32)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def predicted(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The prediction from the neighbours (channels in the last axis): left, top, top right, top left."""
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([255, 0, 0, 0]), left.shape)
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode <= 9:
        return _average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        nearer = np.abs(top - corner).sum(-1, keepdims=True) < np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    half = _average(left, top)
    gap = half - corner
    return np.clip(half + np.where(gap < 0, -(-gap // 2), gap // 2), 0, 255)


def channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([(argb >> s) & 255 for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def joined(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return (c[..., 0] << 24) | (c[..., 1] << 16) | (c[..., 2] << 8) | c[..., 3]


def _take_predictions(c: np.ndarray, width: int, height: int, bits: int, modes: np.ndarray) -> np.ndarray:
    """Residuals of the pixels (channels last): all neighbours are known, so each mode is one step."""
    across = (width + (1 << bits) - 1) >> bits
    own = modes[((np.arange(height) >> bits)[:, None] * across + (np.arange(width) >> bits)[None]).reshape(-1)]
    before = lambda k: np.concatenate([np.zeros((min(k, len(c)), 4), np.int64), c[: max(0, len(c) - k)]])
    left, top, right, corner = before(1), before(width), before(max(1, width - 1)) if width > 1 else c, before(width + 1)
    p = np.empty_like(c)
    for mode in np.unique(own):
        at = np.flatnonzero(own == mode)
        p[at] = predicted(int(mode), left[at], top[at], right[at], corner[at])
    x = np.arange(len(c)) % width
    p[x == 0] = top[x == 0]
    p[:width] = left[:width]
    p[0] = (255, 0, 0, 0)
    return c - p


#: Modes whose prediction doesn't need the pixel on the left.
_FREE = frozenset((0, 2, 3, 4, 8, 9))


def _add_predictions(c: np.ndarray, width: int, height: int, bits: int, modes: np.ndarray) -> np.ndarray:
    """Pixels from residuals, row by row: at once where the left pixel isn't needed or is all that is, else one by one."""
    across = (width + (1 << bits) - 1) >> bits
    out = np.zeros_like(c)
    out[:width] = np.cumsum(c[:width], axis=0)
    out[:width, 0] += 255
    out[:width] &= 255
    for y in range(1, height):
        k = y * width
        out[k] = (c[k] + out[k - width]) & 255
        x = 1
        while x < width:
            mode = int(modes[(y >> bits) * across + (x >> bits)])
            end = min(width, ((x >> bits) + 1) << bits)
            a, b = k + x, k + end
            if mode in _FREE or mode > 13:
                out[a:b] = (c[a:b] + predicted(mode, out[a:b], out[a - width : b - width], out[a - width + 1 : b - width + 1], out[a - width - 1 : b - width - 1])) & 255
            elif mode == 1:
                out[a:b] = (out[a - 1] + np.cumsum(c[a:b], axis=0)) & 255
            else:
                for j in range(a, b):
                    out[j] = (c[j] + predicted(mode, out[j - 1], out[j - width], out[j - width + 1], out[j - width - 1])) & 255
            x = end
    return out


def _apply_predictor(pixels: np.ndarray, width: int, height: int, bits: int, modes: np.ndarray, back: bool) -> np.ndarray:
    """Adds predictions to residuals (back), or takes them from pixels."""
    return joined((_add_predictions if back else _take_predictions)(channels(pixels), width, height, bits, modes))


def _signed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64) & 255
    return np.where(x > 127, x - 256, x)


def _apply_cross(pixels: np.ndarray, width: int, height: int, bits: int, elements: np.ndarray, back: bool) -> np.ndarray:
    c = channels(pixels)
    across = (width + (1 << bits) - 1) >> bits
    at = ((np.arange(height) >> bits)[:, None] * across + (np.arange(width) >> bits)[None]).reshape(-1)
    e = channels(elements)[at]
    red_to_blue, green_to_blue, green_to_red = (_signed(e[:, k]) for k in (1, 2, 3))
    sign = 1 if back else -1
    green, red = _signed(c[:, 2]), c[:, 1]
    moved = (red + sign * ((green_to_red * green) >> 5)) & 255
    blue = c[:, 3] + sign * (((green_to_blue * green) >> 5) + ((red_to_blue * _signed(moved if back else red)) >> 5))
    c[:, 1], c[:, 3] = moved, blue & 255
    return joined(c)


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """The ARGB pixels (height, width) of the lossless image at the start of data, and where its file ends."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    end = 8 + struct.unpack("<I", data[4:8])[0]
    size = struct.unpack("<I", data[16:20])[0]
    r = Reader(data[20 : 20 + size])
    if r.read(8) != 0x2F:
        raise ValueError("the signature is wrong")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    transforms, now = [], width
    while r.read(1):
        kind = r.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            transforms.append((kind, bits, now, read_pixels(r, (now + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits, False)))
        elif kind == PALETTE:
            colours = r.read(8) + 1
            table = joined(np.cumsum(channels(read_pixels(r, colours, 1, False)), axis=0))
            bits = _bundle_bits(colours)
            transforms.append((kind, bits, now, table))
            now = (now + (1 << bits) - 1) >> bits
        else:
            transforms.append((kind, 0, now, None))
    pixels = read_pixels(r, now, height, True)
    for kind, bits, wide, extra in reversed(transforms):
        if kind == PREDICTOR:
            pixels = _apply_predictor(pixels, wide, height, bits, (extra >> 8) & 15, True)
        elif kind == CROSS_COLOUR:
            pixels = _apply_cross(pixels, wide, height, bits, extra, True)
        elif kind == SUBTRACT_GREEN:
            green = (pixels >> 8) & 255
            pixels = (pixels & 0xFF00FF00) | ((pixels + green) & 255) | ((((pixels >> 16) + green) & 255) << 16)
        else:
            index = ((pixels >> 8) & 255).reshape(height, -1)
            if bits:
                each = 8 >> bits
                index = ((index[:, :, None] >> (each * np.arange(1 << bits, dtype=np.uint32))) & ((1 << each) - 1)).reshape(height, -1)[:, :wide]
            full = np.zeros(256, np.uint32)
            full[: len(extra)] = extra
            pixels = full[index].reshape(-1)
    return pixels.reshape(height, width), end + (end & 1)


# ---- writing


def write_single(w: Writer, symbol: int) -> None:
    """The code of one symbol, which takes no bits."""
    for value, n in ((1, 1), (0, 1), (int(symbol > 1), 1), (symbol, 8 if symbol > 1 else 1)):
        w.put(value, n)


def write_code(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and (not used or used[-1] < 256):
        w.put(1, 1)
        w.put(int(len(used) == 2), 1)
        first = used[0] if used else 0
        w.put(int(first > 1), 1)
        w.put(first, 8 if first > 1 else 1)
        if len(used) == 2:
            w.put(used[1], 8)
        return
    tokens, k, values = [], 0, lengths[: used[-1] + 1].tolist()
    n = len(values)
    while k < n:
        run = k
        while run < n and values[run] == values[k]:
            run += 1
        run -= k
        if values[k] == 0 and run >= 3:
            run = min(run, 138)
            tokens.append((17, run - 3, 3) if run <= 10 else (18, run - 11, 7))
        elif k and values[k] == values[k - 1] and values[k] and run >= 3:
            run = min(run, 6)
            tokens.append((16, run - 3, 2))
        else:
            run = 1
            tokens.append((values[k], 0, 0))
        k += run
    own = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    codes = codes_of(own)
    single = np.count_nonzero(own) == 1
    last = max(i for i, k in enumerate(LENGTH_ORDER) if own[k])
    w.put(0, 1)
    w.put(max(0, last + 1 - 4), 4)
    for k in LENGTH_ORDER[: max(4, last + 1)]:
        w.put(int(own[k]), 3)
    w.put(1, 1)  # the number of tokens follows
    need = max(2, (len(tokens) - 2).bit_length())
    need += need & 1
    w.put((need - 2) // 2, 3)
    w.put(len(tokens) - 2, need)
    for s, extra, size in tokens:
        if not single:
            w.put(int(codes[s]), int(own[s]))
        if size:
            w.put(extra, size)


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix code, extra bits' value, their number) of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = (v >> (high - 1)) & 1
    return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1


def write_pixels(w: Writer, pixels: np.ndarray, width: int, outer: bool, cache_bits: int = 0, references: bool = False, groups: tuple[int, np.ndarray] | None = None) -> None:
    """An entropy-coded image. groups: block bits and the group of each block."""
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if outer:
        w.put(int(groups is not None), 1)
        if groups:
            w.put(groups[0] - 2, 3)
            write_pixels(w, groups[1].reshape(-1).astype(np.uint32) << 8, groups[1].shape[1], False)
    if not cache_bits and not references and not groups:
        c = channels(pixels)
        lengths = [code_lengths(np.bincount(c[:, k], minlength=m), 15) for k, m in ((2, 280), (1, 256), (3, 256), (0, 256))]
        for x in [*lengths, np.zeros(40, np.int64)]:
            write_code(w, x)
        parts = [(codes_of(x)[c[:, k]], x[c[:, k]]) for x, k in zip(lengths, (2, 1, 3, 0), strict=True) if np.count_nonzero(x) > 1]
        if parts:
            w.many(np.stack([p[0] for p in parts], 1).reshape(-1), np.stack([p[1] for p in parts], 1).reshape(-1))
        return
    flat, steps, k = pixels.tolist(), [], 0
    seen: dict[tuple, int] = {}
    cache = [0] * (1 << cache_bits)
    while k < len(flat):
        run = back = 0
        key = tuple(flat[k : k + 3])
        if references and len(key) == 3 and key in seen:
            back = k - seen[key]
            while run < 4096 and k + run < len(flat) and flat[k + run] == flat[k + run - back]:
                run += 1
        slot = ((CACHE_FACTOR * flat[k]) & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if run >= 3:
            code = next((i + 1 for i, (x, y) in enumerate(NEIGHBOURS) if max(1, x + y * width) == back), back + len(NEIGHBOURS))
            steps.append((k, 256 + _prefix(run)[0], _prefix(run), _prefix(code)))
        elif cache_bits and k and cache[slot] == flat[k]:
            steps.append((k, 280 + slot, None, None))
            run = 1
        else:
            steps.append((k, (flat[k] >> 8) & 255, None, None))
            run = 1
        for j in range(k, k + run):
            seen[tuple(flat[j : j + 3])] = j
            if cache_bits:
                cache[((CACHE_FACTOR * flat[j]) & 0xFFFFFFFF) >> (32 - cache_bits)] = flat[j]
        k += run
    group = lambda k: int(groups[1][(k // width) >> groups[0], (k % width) >> groups[0]]) if groups else 0
    n = 1 + int(groups[1].max()) if groups else 1
    counts = [[np.zeros(m, np.int64) for m in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(n)]
    for k, s, _, far in steps:
        own = counts[group(k)]
        own[0][s] += 1
        if s < 256:
            for j, shift in ((1, 16), (2, 0), (3, 24)):
                own[j][(flat[k] >> shift) & 255] += 1
        elif far:
            own[4][far[0]] += 1
    lengths = [[code_lengths(x, 15) for x in own] for own in counts]
    for own in lengths:
        for x in own:
            write_code(w, x)
    codes = [[codes_of(x) for x in own] for own in lengths]

    def put(g: int, j: int, s: int) -> None:
        if np.count_nonzero(lengths[g][j]) > 1:
            w.put(int(codes[g][j][s]), int(lengths[g][j][s]))

    for k, s, length, far in steps:
        g = group(k)
        put(g, 0, s)
        if s < 256:
            for j, shift in ((1, 16), (2, 0), (3, 24)):
                put(g, j, (flat[k] >> shift) & 255)
        elif far:
            w.put(length[1], length[2])
            put(g, 4, far[0])
            w.put(far[1], far[2])


def _file(w: Writer) -> bytes:
    values, sizes = np.array(w.values, np.int64), np.array(w.sizes, np.int64)
    body = packed(values, sizes)
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", len(body) + 12) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


def _header(width: int, height: int) -> Writer:
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError("the sides of an image are 1 to 16384 pixels")
    w = Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)
    return w


def encode(argb: np.ndarray, predictor: tuple[int, np.ndarray] | None = None, cross: tuple[int, np.ndarray] | None = None, subtract_green: bool = False, palette: bool = False, **coding) -> bytes:
    """The file of an ARGB image (height, width). predictor, cross: block bits and the modes or elements of the blocks."""
    height, width = argb.shape
    pixels, w, now = argb.reshape(-1).astype(np.uint32), _header(width, height), width
    if palette:
        table, index = np.unique(pixels, return_inverse=True)
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(table) - 1, 8)
        write_pixels(w, joined(np.diff(channels(table), axis=0, prepend=0)), len(table), False)
        bits = _bundle_bits(len(table))
        now = (width + (1 << bits) - 1) >> bits
        if bits:
            wide = np.zeros((height, now << bits), np.int64)
            wide[:, :width] = index.reshape(height, width)
            index = (wide.reshape(height, now, 1 << bits) << ((8 >> bits) * np.arange(1 << bits))).sum(-1)
        pixels = (index.reshape(-1).astype(np.uint32) << 8) | np.uint32(0xFF000000)
    if subtract_green:
        w.put(1, 1)
        w.put(SUBTRACT_GREEN, 2)
        green = (pixels >> 8) & 255
        pixels = (pixels & 0xFF00FF00) | ((pixels - green) & 255) | ((((pixels >> 16) - green) & 255) << 16)
    for kind, given in ((PREDICTOR, predictor), (CROSS_COLOUR, cross)):
        if given:
            bits, blocks = given
            w.put(1, 1)
            w.put(kind, 2)
            w.put(bits - 2, 3)
            write_pixels(w, (blocks.reshape(-1).astype(np.uint32) << 8) if kind == PREDICTOR else blocks.reshape(-1), blocks.shape[1], False)
            pixels = (_apply_predictor if kind == PREDICTOR else _apply_cross)(pixels, now, height, bits, blocks.reshape(-1), False)
    w.put(0, 1)
    write_pixels(w, pixels, now, True, **coding)
    return _file(w)


_COUNTS = np.arange(1 << 14)
_COUNT_BITS = _COUNTS * np.log2(np.maximum(_COUNTS, 1))


def _entropy(counts: np.ndarray) -> float:
    """Bits that symbols of these counts take at least."""
    total = int(counts.sum())
    if not total:
        return 0.0
    own = _COUNT_BITS[counts] if total < len(_COUNTS) else counts * np.log2(np.maximum(counts, 1))
    return float(total * np.log2(total) - own.sum())


#: The shortest copy worth a reference (as long as a 64-bit key), the longest that one reference holds, and the farthest it reaches.
SHORTEST, LONGEST, FARTHEST = 8, 4096, (1 << 20) - 120


def _repeats(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose next SHORTEST samples stood before, in order, and the last place where they did."""
    n = len(x) - SHORTEST + 1
    keys = np.ndarray(n, np.uint64, np.ascontiguousarray(x), strides=(1,)).copy()
    if n <= 1 << 20:
        # one fast sort of hashes with their places in the low bits; what a hash confuses is dropped
        place = np.sort((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20) << np.uint64(20) | np.arange(n, dtype=np.uint64))
        order = (place & np.uint64((1 << 20) - 1)).astype(np.int64)
    else:
        order = np.argsort(keys, kind="stable")
    own = keys[order]
    same = np.flatnonzero(own[1:] == own[:-1])
    before = np.full(n, -1)
    before[order[same + 1]] = order[same]
    later = np.flatnonzero(before >= 0)
    return later, before[later]


def matches(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where, how long and how far back: copies of at least SHORTEST samples, as long as they keep their distance."""
    none = np.zeros(0, np.int64)
    if len(x) <= SHORTEST:
        return none, none, none
    later, earlier = _repeats(x)
    back = later - earlier
    ok = back <= FARTHEST
    later, back = later[ok], back[ok]
    if not len(later):
        return none, none, none
    # places in a row with one distance are one copy, which from each of them reaches to its end
    last = np.append(((later[1:] != later[:-1] + 1) | (back[1:] != back[:-1])).nonzero()[0], len(later) - 1)
    many = last + 1
    many[1:] -= last[:-1] + 1
    run = np.minimum(later[last].repeat(many) - later + SHORTEST, LONGEST)
    following = memoryview(np.searchsorted(later, later + run))
    chosen, k = [], 0
    while k < len(later):
        chosen.append(k)
        k = following[k]
    return later[chosen], run[chosen], back[chosen]


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, extra bits' value, their number) of lengths or distance codes."""
    v = np.maximum(values - 1, 1)
    high = np.frexp(v.astype(float))[1] - 1
    small = values <= 4
    size = np.where(small, 0, high - 1)
    return np.where(small, values - 1, 2 * high + ((v >> np.maximum(high - 1, 0)) & 1)), np.where(small, 0, v & ((1 << size) - 1)), size


def _distance_codes(back: np.ndarray, width: int) -> np.ndarray:
    own, first = _near_codes(width)
    k = np.minimum(np.searchsorted(own, back), len(own) - 1)
    return np.where(own[k] == back, first[k] + 1, back + len(NEIGHBOURS))


def write_greens(w: Writer, x: np.ndarray, width: int, alpha: int = 255) -> tuple[np.ndarray, np.ndarray, float]:
    """The outer image, of green values alone: its codes into w, and its data, (values, sizes), to follow them, with about how many bits that takes."""
    w.put(0, 1)  # no colour cache
    w.put(0, 1)  # one group of codes
    counts = np.bincount(x, minlength=280)
    cost = _entropy(counts)
    at, run, back = matches(x)
    symbols = x.astype(np.int64)
    lengths, far, begins = None, np.zeros(40, np.int64), np.zeros(0, np.int64)
    if len(at):
        edges = np.zeros(len(x) + 1, np.int64)
        edges[at] += 1
        edges[at + run] -= 1
        literal = np.cumsum(edges[:-1]) == 0
        (size_code, size_bits, size_n), (far_code, far_bits, far_n) = _prefixes(run), _prefixes(_distance_codes(back, width))
        symbols[at] = 256 + size_code
        literal[at] = True
        begins = np.flatnonzero(literal)
        symbols = symbols[begins]
        shorter = np.bincount(symbols, minlength=280)
        far = np.bincount(far_code, minlength=40)
        copied = _entropy(shorter) + _entropy(far) + float(size_n.sum() + far_n.sum()) + 200
        if copied < cost:
            counts, cost = shorter, copied
        else:
            symbols, far, at = x.astype(np.int64), np.zeros(40, np.int64), at[:0]
    lengths, far_lengths = code_lengths(counts, 15), code_lengths(far, 15)
    write_code(w, lengths)
    for only in (0, 0, alpha):
        write_single(w, only)
    if len(at):
        write_code(w, far_lengths)
    else:
        write_single(w, 0)
    several = np.count_nonzero(lengths) > 1
    values = codes_of(lengths)[symbols] if several else np.zeros(len(symbols), np.int64)
    sizes = lengths[symbols] if several else np.zeros(len(symbols), np.int64)
    if not len(at):
        return (values, sizes, cost) if several else (values[:0], sizes[:0], cost)
    # behind each length symbol: its bits, the distance symbol and its bits
    place = np.searchsorted(begins, at)
    own = np.count_nonzero(far_lengths) > 1
    columns = [(size_bits, size_n), (codes_of(far_lengths)[far_code], far_lengths[far_code] if own else np.zeros(len(at), np.int64)), (far_bits & 0xFFFF, np.minimum(far_n, 16)), (far_bits >> 16, np.maximum(far_n - 16, 0))]
    later = np.zeros(len(values), np.int64)
    later[place[place + 1 < len(values)] + 1] = len(columns)
    put = np.arange(len(values)) + np.cumsum(later)
    both = np.empty((2, len(values) + len(columns) * len(at)), np.int64)
    both[0, put], both[1, put] = values, sizes
    behind = put[place] + 1
    for k, (v, n) in enumerate(columns):
        both[0, behind + k], both[1, behind + k] = v, n
    return both[0], both[1], cost


def _finished(w: Writer, values: np.ndarray, sizes: np.ndarray) -> bytes:
    body = packed(np.concatenate([np.array(w.values, np.int64), values]), np.concatenate([np.array(w.sizes, np.int64), sizes]))
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", len(body) + 12) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


#: Blocks of 2**5 pixels share a mode of the predictor, one of these for samples.
MODE_BITS, MODES = 5, (1, 2, 3, 4, 8, 9)


def best_modes(argb: np.ndarray, bits: int = MODE_BITS, modes: tuple[int, ...] = MODES) -> np.ndarray:
    """The mode of each block that leaves the smallest residuals."""
    height, width = argb.shape
    across, down = (width + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
    block = ((np.arange(height) >> bits)[:, None] * across + (np.arange(width) >> bits)[None]).reshape(-1)
    c = channels(argb.reshape(-1))
    costs = [np.bincount(block, np.abs(_signed(_take_predictions(c, width, height, bits, np.full(across * down, m)))).sum(-1), across * down) for m in modes]
    return np.array(modes)[np.argmin(costs, axis=0)].reshape(down, across)


@lru_cache(1)
def _flat_codes() -> tuple[list[int], list[int]]:
    """The bits of the codes of a palette image: every green step takes 8 bits, and the first alpha may differ from the others."""
    w = Writer()
    w.put(0, 1)  # no colour cache
    write_code(w, np.concatenate([np.full(256, 8), np.zeros(24, np.int64)]))
    write_single(w, 0)
    write_single(w, 0)
    for value, n in ((0b11, 2), (0, 1), (0, 1), (255, 8)):  # a code of two symbols, 0 and 255
        w.put(value, n)
    write_single(w, 0)
    return w.values, w.sizes


def _write_palette(w: Writer, steps: np.ndarray) -> None:
    """A palette of opaque greens by its steps."""
    values, sizes = _flat_codes()
    w.values += values
    w.sizes += sizes
    for k, code in enumerate(_reversed(8)[steps].tolist()):
        w.values += (code, int(k == 0))
        w.sizes += (8, 1)


def _predicted_samples(samples: np.ndarray) -> bytes:
    height, width = samples.shape
    w = _header(width, height)
    argb = (samples.astype(np.uint32) << 8) | np.uint32(0xFF000000)
    modes = best_modes(argb)
    for value, n in ((1, 1), (PREDICTOR, 2), (MODE_BITS - 2, 3)):
        w.put(value, n)
    write_pixels(w, modes.reshape(-1).astype(np.uint32) << 8, modes.shape[1], False)
    residual = _apply_predictor(argb.reshape(-1), width, height, MODE_BITS, modes.reshape(-1), False)
    w.put(0, 1)
    # alpha is predicted in full: its residual is 0
    return _finished(w, *write_greens(w, ((residual >> 8) & 255).astype(np.uint8), width, alpha=0)[:2])


def encode_samples(samples: np.ndarray) -> bytes:
    """The file of 8-bit samples (height, width) as green values: by the palette of those that occur or, where that leaves less, by the predictor."""
    height, width = samples.shape
    flat = samples.reshape(-1)
    w = _header(width, height)
    w.put(1, 1)
    table = np.flatnonzero(np.bincount(flat, minlength=256))
    w.put(PALETTE, 2)
    w.put(len(table) - 1, 8)
    _write_palette(w, np.diff(table, prepend=0))
    bits = _bundle_bits(len(table))
    place = np.zeros(256, np.uint8)
    place[table] = np.arange(len(table))
    index, now = place[flat], width
    if bits:
        now = (width + (1 << bits) - 1) >> bits
        wide = np.zeros((height, now << bits), np.int64)
        wide[:, :width] = index.reshape(height, width)
        index = (wide.reshape(height, now, 1 << bits) << ((8 >> bits) * np.arange(1 << bits))).sum(-1).reshape(-1).astype(np.uint8)
    w.put(0, 1)  # no more transforms
    values, sizes, cost = write_greens(w, index, now)
    steps = min(_entropy(np.bincount(np.diff(samples, axis=k).reshape(-1), minlength=256)) + 8 * n for k, n in ((0, width), (1, height)))
    if steps + 400 < 0.9 * cost:
        return _predicted_samples(samples)
    return _finished(w, values, sizes)


def cross_elements(argb: np.ndarray, bits: int = MODE_BITS) -> np.ndarray:
    """For each block the multipliers, by least squares, that take green out of red, and green and red out of blue."""
    height, width = argb.shape
    across, down = (width + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
    out = np.zeros((down, across, 4), np.int64)
    out[..., 0] = 255
    c = _signed(channels(argb))
    for y in range(down):
        for x in range(across):
            red, green, blue = (c[y << bits : (y + 1) << bits, x << bits : (x + 1) << bits, k].reshape(-1).astype(float) for k in (1, 2, 3))
            out[y, x, 3] = np.clip(round(32 * float(green @ red) / (float(green @ green) + 1)), -128, 127)
            out[y, x, 2] = np.clip(round(32 * float(green @ blue) / (float(green @ green) + 1)), -128, 127)
    return joined(out)


def encode_smallest(argb: np.ndarray) -> bytes:
    """The smallest of the files of an ARGB image that the writer's tools make, alone and together."""
    tools: list[dict] = [{}, {"subtract_green": True}]
    if len(np.unique(argb)) <= 256:
        tools.append({"palette": True})
    else:
        modes = (MODE_BITS, best_modes(argb, modes=tuple(range(1, 14))))
        tools += [{"predictor": modes}, {"predictor": modes, "subtract_green": True}]
        residual = _apply_predictor(argb.reshape(-1).astype(np.uint32), argb.shape[1], argb.shape[0], MODE_BITS, modes[1].reshape(-1), False)
        tools.append({"predictor": modes, "cross": (MODE_BITS, cross_elements(residual.reshape(argb.shape)))})
    files = [encode(argb, **t, **coding) for t in tools for coding in ({}, {"references": True}, {"references": True, "cache_bits": 6})]
    return min(files, key=len)
