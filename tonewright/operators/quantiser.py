"""The quantiser of Layer III over several granules at once.

``Quantiser`` measures the noise of every useful step of every band once; an attempt at some noise offset then reads the steps off a table, tries the
variants of scale and preflag (with window gains in short blocks) for all granules together, and keeps of each granule the one that clips
least, then costs least, then comes first. Nothing depends on how many granules are looked at together.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ..functions.tables import PRETAB, SLEN1, SLEN2, band_edges
from .layer3 import Codes, layout

MOST_VALUE = 8206
ROUND_UP = 0.4054
#: Steps from the finest codable one to where every value is 0: 16/3 log2 of (8206.5 / 0.5946).
STEPS = 76
COARSEST, NOTHING_ASKED = 60, 45
#: (scale, preflag) in the order in which they are tried.
VARIANTS_LONG, VARIANTS_SHORT = ((0, 0), (1, 0), (0, 1), (1, 1)), ((0, 0), (1, 0))
_FAR = 1 << 20


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    return np.arange(MOST_VALUE + 1) ** (4 / 3)


@lru_cache(maxsize=32)
def cells(rate: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines in bit-stream order their band (band and window in short blocks); where each of these starts; the largest scalefactor of each, -1 in the band that has none; its window (0 in long blocks)."""
    band, window = layout(rate, int(short))
    cell = band * 3 + np.maximum(window, 0) if short else band
    starts = np.searchsorted(cell, np.arange(39 if short else 22))
    b = np.arange(len(starts)) // (3 if short else 1)
    most = np.where(b < (6 if short else 11), 15, 7)
    most[b == (12 if short else 21)] = -1
    return cell, starts, most, np.arange(len(starts)) % 3 if short else np.zeros(22, int)


class Books:
    """Code tables turned round: words by values, and the bits that each value pair or quadruple costs in each table, signs included."""

    def __init__(self, codes: Codes):
        self.numbers = np.array(sorted(t for t in codes.pairs if t))
        n = len(self.numbers)
        self.costs, self.words, self.lengths = np.full((n, 16, 16), _FAR, np.int32), np.zeros((n, 16, 16), np.int64), np.zeros((n, 16, 16), np.int64)
        self.linbits, self.reach = np.zeros(n, int), np.zeros(n, int)
        for k, t in enumerate(self.numbers):
            self.linbits[k], book = codes.pairs[t]
            for (length, word), (x, y) in book.items():
                self.words[k, x, y], self.lengths[k, x, y] = word, length
                self.costs[k, x, y] = length + (x > 0) + (y > 0) + self.linbits[k] * ((x == 15) + (y == 15))
            top = max(max(v) for v in book.values())
            self.reach[k] = top + (1 << self.linbits[k]) - 1 if self.linbits[k] else top
        self.quad_costs, self.quad_words, self.quad_lengths = (np.zeros((2, 16), np.int64) for _ in range(3))
        for k, book in enumerate(codes.quads):
            for (length, word), v in book.items():
                i = v[0] << 3 | v[1] << 2 | v[2] << 1 | v[3]
                self.quad_words[k, i], self.quad_lengths[k, i], self.quad_costs[k, i] = word, length, length + sum(v)


def ends(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 576) magnitudes to where the pairs end and where the quadruples of at most one end."""
    held, over = size > 0, size > 1
    end = np.where(held.any(axis=1), 576 - held[:, ::-1].argmax(axis=1), 0)
    big = np.where(over.any(axis=1), (575 - over[:, ::-1].argmax(axis=1)) // 2 * 2 + 2, 0)
    fours = np.maximum(-(-(end - big) // 4), 0)
    spills = big + 4 * fours > 576
    big = np.where(spills, end + end % 2, big)
    return big, np.where(spills, big, big + 4 * fours)


def fours_of(size: np.ndarray, big: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The quadruples of each row as numbers of four bits, and which of the 144 places hold one."""
    at = big[:, None] + 4 * np.arange(144)
    wide = np.c_[size, np.zeros((len(size), 4), size.dtype)]
    row = np.arange(len(size))[:, None]
    value = sum(wide[row, np.minimum(at + k, 579)] << 3 - k for k in range(4))
    inside = at < end[:, None]
    return np.where(inside, value, 0), inside


@lru_cache(maxsize=1)
def _splits() -> tuple:
    """The 128 pairs of region counts, the distinct ranges of bands that they give, and of each pair the three ranges."""
    r0, r1 = np.indices((16, 8)).reshape(2, -1)
    one, two = np.minimum(r0 + 1, 22), np.minimum(r0 + r1 + 2, 22)
    spans = sorted({*zip([0] * 128, one.tolist()), *zip(one.tolist(), two.tolist()), *zip(two.tolist(), [22] * 128)})
    lo, hi = np.array(spans).T
    place = np.zeros((23, 23), int)
    place[lo, hi] = np.arange(len(lo))
    return r0, r1, lo, hi, (place[0, one], place[one, two], place[two, 22])


def choose(ix: np.ndarray, rate: int, block_type: int, books: Books) -> dict[str, np.ndarray]:
    """Tables, region counts and bits of rows of lines of one kind of block; the first of equal choices. ``tables`` are indexes of ``books.numbers``, -1 for silence."""
    size = np.abs(ix)
    big, end = ends(size)
    long, short = band_edges(rate)
    inside = np.arange(288) < big[:, None] // 2
    x, y = (np.where(inside, size[:, k::2], 0) for k in (0, 1))
    cost = books.costs[:, np.minimum(x, 15), np.minimum(y, 15)] * inside
    edges = np.array([0, (3 * short[3] if block_type == 2 else long[8]) // 2] if block_type else [e // 2 for e in long[:-1]])
    sums = np.concatenate([np.zeros((*cost.shape[:2], 1), np.int64), np.cumsum(np.add.reduceat(cost, edges, axis=2), axis=2)], axis=2)
    each = np.maximum.reduceat(np.maximum(x, y), edges, axis=1)

    def best(lo: np.ndarray, hi: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, ranges): bits and table of the bands from lo to hi, whose largest value is top."""
        bits = np.where(books.reach[:, None, None] >= top, sums[:, :, hi] - sums[:, :, lo], _FAR)
        at = bits.argmin(axis=0)
        return np.where(top > 0, np.take_along_axis(bits, at[None], 0)[0], 0), np.where(top > 0, at, -1)

    if block_type:
        bits, tables = best(np.array([0, 1]), np.array([1, 2]), each)
        out = {"tables": tables, "region0_count": np.full(len(ix), 8 if block_type == 2 else 7), "region1_count": np.full(len(ix), 36), "bits": bits.sum(axis=1)}
    else:
        r0, r1, lo, hi, parts = _splits()
        tops = np.zeros((len(ix), 23, 23), int)
        for k in range(17):
            tops[:, k, k + 1 :] = np.maximum.accumulate(each[:, k:], axis=1)
        tops[:, :22, 22] = np.maximum.accumulate(each[:, ::-1], axis=1)[:, ::-1]
        bits, tables = best(lo, hi, tops[:, lo, hi])
        total = sum(bits[:, p] for p in parts)
        k = total.argmin(axis=1)  # the first of equal choices
        row = np.arange(len(ix))
        out = {"tables": np.stack([tables[row, p[k]] for p in parts], axis=1), "region0_count": r0[k], "region1_count": r1[k], "bits": total[row, k]}
    value, held = fours_of(size, big, end)
    counts = (books.quad_costs[:, value] * held).sum(axis=2)
    return out | {"big_values": big // 2, "end": end, "count1_table": (counts[1] < counts[0]).astype(int), "bits": out["bits"] + counts.min(axis=0)}


@lru_cache(maxsize=4)
def _lengths(short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bits and scalefac_compress by the longest scalefactor of the two groups, the cheapest and first that holds them."""
    n, cut = (18, 18) if short else (11, 10)
    found = [[min((n * a + cut * b, k) for k, (a, b) in enumerate(zip(SLEN1, SLEN2)) if a >= x and b >= y) for y in range(4)] for x in range(5)]
    return np.array(found)[:, :, 0], np.array(found)[:, :, 1]


def scalefactor_coding(sf: np.ndarray, short: bool, lsf: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of scalefactors (without the highest band) to bits, scalefac_compress, and the length of each."""
    sizes = ([9] * 4 if short else [6, 5, 5, 5]) if lsf else ([18, 18] if short else [11, 10])
    cuts = np.cumsum([0, *sizes[:-1]])
    need = np.ceil(np.log2(np.maximum.reduceat(sf[:, : sum(sizes)], cuts, axis=1) + 1)).astype(int)
    if lsf:
        return need @ np.array(sizes), (need[:, 0] * 5 + need[:, 1]) << 4 | need[:, 2] << 2 | need[:, 3], np.repeat(need, sizes, axis=1)
    bits, compress = (t[need[:, 0], need[:, 1]] for t in _lengths(short))
    return bits, compress, np.repeat(np.stack([np.array(SLEN1)[compress], np.array(SLEN2)[compress]], axis=1), sizes, axis=1)


class Rows:
    """Granules of one kind of block (0 plain, 1 switched and long, 2 short): lines (bit-stream order), allowances, and the noise of every step of every band."""

    def __init__(self, kind: int, x: np.ndarray, allowed: np.ndarray, rate: int):
        self.kind, self.rate, self.x, self.allowed = kind, rate, x, allowed
        self.cell, starts, self.most, self.window = cells(rate, kind == 2)
        size = np.abs(x)
        self.root = size**0.75
        top = np.maximum.reduceat(size, starts, axis=1)
        self.energy, self.sound = np.add.reduceat(size**2, starts, axis=1), top > 0
        finest = 4 * np.log2(np.where(self.sound, top, 1.0)) - 16 / 3 * np.log2(MOST_VALUE + 0.5)
        self.finest = np.ceil(finest).astype(int)
        steps = self.finest[:, :, None] + np.arange(STEPS)
        fine, wide = (2.0 ** (steps * f) for f in (-3 / 16, 1 / 4))
        noise = []
        for r in range(len(x)):
            ix = np.minimum(np.floor(self.root[r][:, None] * fine[r][self.cell] + ROUND_UP), MOST_VALUE).astype(np.int32)
            error = size[r][:, None] - _powers()[ix] * wide[r][self.cell]
            noise.append(np.add.reduceat(error * error, starts, axis=0))
        self.noise = np.array(noise)

    def required(self, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The coarsest step of each band whose noise is allowed (the finest if none is), which bands ask for one, and the finest step that the others must not pass, over the row."""
        asks = self.sound & (self.most >= 0) & (self.energy > allowed)
        fits = self.noise <= allowed[:, :, None]
        steps = self.finest + np.where(fits.any(axis=2), STEPS - 1 - fits[:, :, ::-1].argmax(axis=2), 0)
        floor = np.where(self.sound & ~asks, self.finest, -(1 << 20)).max(axis=1)
        return np.minimum(steps, COARSEST), asks, floor

    def variants(self, steps: np.ndarray, asks: np.ndarray, floor: np.ndarray, tried: tuple) -> dict[str, np.ndarray]:
        """Gains, scalefactors and whole numbers under each (scale, preflag), variant by variant."""
        v, short, low = len(tried), self.kind == 2, -(1 << 20)
        steps, asks, floor, root, x = (np.concatenate([a] * v) for a in (steps, asks, floor, self.root, self.x))
        scale, preflag = (np.repeat([t[k] for t in tried], len(self.x)) for k in (0, 1))
        m, n, most = np.where(scale, 4, 2)[:, None], len(steps), np.maximum(self.most, 0)
        pre = np.zeros((1, len(most)), int) if short else np.array(PRETAB) * preflag[:, None]
        base = np.full((n, 3), low)
        for w in range(3 if short else 1):
            mine = asks & (self.window == w)
            coarsest = np.where(mine, steps, low).max(axis=1)
            base[:, w] = np.minimum(coarsest, np.where(mine, steps + m * (most + pre), 1 << 20).min(axis=1))
        wanted = base.max(axis=1)
        gain = np.clip(np.maximum(np.where(wanted > low, wanted, NOTHING_ASKED), floor) + 210, 0, 255)
        gain = np.where(asks.any(axis=1) | (floor > low), gain, 0)  # a silent granule
        windows = np.where((base > low) & short, np.clip((gain[:, None] - 210 - base) // 8, 0, 7), 0)
        down = 8 * windows[:, self.window] if short else 0
        need = np.where(asks, np.maximum(-((steps - (gain[:, None] - 210 - down)) // m) - pre, 0), 0)
        sf = np.minimum(need, most)
        while True:
            step = gain[:, None] - 210 - down - m * (sf + pre)
            ix = np.floor(root * (2.0 ** (-3 / 16 * step))[:, self.cell] + ROUND_UP)
            over = (ix.max(axis=1) > MOST_VALUE) & (gain < 255)
            if not over.any():
                break
            gain = gain + over
        ix = (np.sign(x) * np.minimum(ix, MOST_VALUE)).astype(np.int64)
        return {"ix": ix, "global_gain": gain, "scalefactors": sf, "subblock_gain": windows, "scalefac_scale": scale, "preflag": preflag, "clipped": (need > sf).any(axis=1)}

    def attempt(self, offset: float, books: Books) -> list[dict]:
        """Each granule quantised with its allowance raised by ``offset`` dB, in its best variant: what ``variants`` and ``choose`` give, and the scalefactors' coding."""
        lsf = self.rate < 32000
        asked = self.required(self.allowed * 10 ** (offset / 10))
        tried = self.variants(*asked, VARIANTS_SHORT if self.kind == 2 or lsf else VARIANTS_LONG)
        n = len(self.x)
        clips = tried["clipped"].reshape(-1, n)
        rows = np.flatnonzero((~clips | clips.all(axis=0)).reshape(-1))  # what clips loses to what does not, whatever its bits
        of = {k: v[rows] for k, v in tried.items()}
        of |= choose(of["ix"], self.rate, self.kind, books)
        bits, of["scalefac_compress"], of["lengths"] = scalefactor_coding(of["scalefactors"], self.kind == 2, lsf)
        of["part2_3_length"] = of["bits"] + bits
        cost, place = np.full(clips.size, 1 << 40), np.zeros(clips.size, int)
        cost[rows], place[rows] = of["part2_3_length"], np.arange(len(rows))
        order = cost.reshape(-1, n).argmin(axis=0)  # the first of equal ones
        return [{k: v[place[o * n + r]] for k, v in of.items()} for r, o in enumerate(order)]


class Quantiser:
    """The granules (block_type, lines in bit-stream order, allowance) of a frame."""

    def __init__(self, granules: list[tuple], rate: int, books: Books):
        self.books, self.rows, self.n, self.tried = books, [], len(granules), {}
        kind = np.array([t if t in (0, 2) else 1 for t, *_ in granules])
        for k in (0, 1, 2):
            at = np.flatnonzero(kind == k)
            if len(at):
                self.rows.append((at, Rows(k, *(np.array([granules[i][c] for i in at], float) for c in (1, 2)), rate)))

    def attempt(self, offset: float) -> tuple[list[dict], int, bool]:
        """All granules at a noise offset, their bits, and whether a frame can hold them."""
        if offset in self.tried:
            return self.tried[offset]
        out: list = [None] * self.n
        for at, rows in self.rows:
            for i, q in zip(at, rows.attempt(offset, self.books)):
                out[i] = q
        done = self.tried[offset] = out, int(sum(q["part2_3_length"] for q in out)), all(q["part2_3_length"] <= 4095 and q["big_values"] <= 288 for q in out)
        return done

    def fit(self, target_of, rounds: int = 9) -> list[dict]:
        """The quietest noise that meets the target, which follows from the bits at the mask."""
        done, demand, fits = self.attempt(0.0)
        target = target_of(demand)
        if fits and demand == target:
            return done
        if fits and demand <= target:
            best, low, high = done, -30.0, 0.0
            done, bits, fits = self.attempt(low)
            if fits and bits <= target:
                return done
        else:
            low, high = 0.0, 60.0
            best, bits, fits = self.attempt(high)
            if not fits or bits > target:
                while (not fits or bits > target) and high < 200:
                    high += 20.0
                    best, bits, fits = self.attempt(high)
                return best
        for _ in range(rounds):
            mid = (low + high) / 2
            done, bits, fits = self.attempt(mid)
            if fits and bits <= target:
                best, high = done, mid
            else:
                low = mid
        return best


def granule_bits(q: dict, rate: int, block_type: int, books: Books) -> tuple[np.ndarray, np.ndarray]:
    """Scalefactors, pairs and quadruples of one granule as numbers and their lengths in bits, in order."""
    long, short = band_edges(rate)
    ix, big = q["ix"], 2 * int(q["big_values"])
    if block_type:
        cuts = [3 * short[3] if block_type == 2 else long[8]]
    else:
        cuts = [long[min(int(q["region0_count"]) + 1, 22)], long[min(int(q["region0_count"]) + int(q["region1_count"]) + 2, 22)]]
    place = np.arange(0, big, 2)
    table = q["tables"][np.searchsorted(np.array(cuts), place, side="right")]
    pairs = table >= 0
    table, x, y = table[pairs], ix[:big:2][pairs], ix[1:big:2][pairs]
    small = [np.minimum(np.abs(v), 15) for v in (x, y)]
    linbits = books.linbits[table]
    parts = [(books.words[(table, *small)], books.lengths[(table, *small)])]
    for v in (x, y):
        size = np.abs(v)
        far = (linbits > 0) & (size >= 15)
        parts += [(np.where(far, size - 15, 0), np.where(far, linbits, 0)), ((v < 0).astype(np.int64), (v != 0).astype(np.int64))]
    coded = [np.stack(c, axis=1).reshape(-1) for c in zip(*parts)]
    values, held = fours_of(np.abs(ix)[None], np.array([big]), np.array([int(q["end"])]))
    n = int(held.sum())
    k, four = int(q["count1_table"]), values[0, :n]
    lines = np.r_[ix, np.zeros(4, np.int64)][big : big + 4 * n].reshape(-1, 4)
    quads = [(books.quad_words[k, four], books.quad_lengths[k, four]), *(((lines[:, c] < 0).astype(np.int64), (lines[:, c] != 0).astype(np.int64)) for c in range(4))]
    fours = [np.stack(c, axis=1).reshape(-1) for c in zip(*quads)]
    return np.r_[q["scalefactors"][: len(q["lengths"])], coded[0], fours[0]], np.r_[q["lengths"], coded[1], fours[1]]


def packed(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Numbers of so many bits each in a row, filled with zeros to a whole byte."""
    most = int(lengths.max(initial=0))
    shift = lengths[:, None] - 1 - np.arange(most)
    return np.packbits((values[:, None] >> np.maximum(shift, 0) & 1).astype(np.uint8)[shift >= 0]).tobytes()
