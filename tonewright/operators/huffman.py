"""Layer III main data of many granules at once: bit positions of all of them as one array, one search for a code word of each per step.

Scalefactors have known places, so they are cut out in one go; pairs and quadruples go in lock-step, the k-th of every granule that has
one. A code word is found among all words of all tables, sorted by table and by bits from the left. What a granule gives does not depend on its neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from ..functions.scalefactors import GROUPS_LSF, SCFSI_GROUPS
from ..functions.tables import PRETAB, SLEN1, SLEN2, band_edges
from ..sources.sideinfo import parse
from .layer3 import Codes, header_facts, layout, lsf_lengths, order, stereo

QUADS = 64
_U = np.uint64


class Words:
    """All code words, sorted; table 0 has one of no bits, count-1 tables are 64 and 65."""

    def __init__(self, codes: Codes):
        rows = [(0, 0, 0, 0, 0, 0, 0)]
        for t, (_, book) in codes.pairs.items():
            rows += [(t, word << 32 - n, n, *v, 0, 0) for (n, word), v in book.items() if t]
        for k, book in enumerate(codes.quads):
            rows += [(QUADS + k, word << 32 - n, n, *v) for (n, word), v in book.items()]
        rows.sort()
        table, first, self.length, *values = (np.array(c, np.int64) for c in zip(*rows))
        self.keys, self.last = (table << 32 | first).astype(_U), (table << 32 | first + (1 << 32 - self.length) - 1).astype(_U)
        self.values = np.stack(values)
        self.linbits = np.zeros(QUADS + 2, np.int64)
        for t, (linbits, _) in codes.pairs.items():
            self.linbits[t] = linbits if t else 0

    def find(self, table: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of 64 bits ahead the word that they begin with, and whether there is one."""
        key = table.astype(_U) << _U(32) | ahead >> _U(32)
        at = np.maximum(np.searchsorted(self.keys, key, side="right") - 1, 0)
        return at, (key >= self.keys[at]) & (key <= self.last[at])


class Tape:
    """Bytes behind each other, of which every position's next 57 bits can be seen."""

    def __init__(self, parts: list[bytes]):
        self.starts = np.cumsum([0, *map(len, parts)])[:-1] * 8
        data = np.frombuffer(b"".join(parts) + bytes(16), np.uint8).astype(_U)
        self.wide = np.zeros(len(data) - 8, _U)
        for k in range(8):
            self.wide |= data[k : k + len(self.wide)] << _U(56 - 8 * k)

    def ahead(self, at: np.ndarray) -> np.ndarray:
        return self.wide[np.minimum(at >> 3, len(self.wide) - 1)] << (at & 7).astype(_U)

    def take(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Numbers of n bits (up to 32)."""
        return np.where(n > 0, self.ahead(at) >> (_U(64) - np.maximum(n, 1).astype(_U)), _U(0)).astype(np.int64)


def _number(ahead: np.ndarray, n: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next n bits where asked for: numbers, what is ahead behind them, and how many bits went."""
    n = np.where(where, n, 0)
    got = np.where(n > 0, ahead >> (_U(64) - np.maximum(n, 1).astype(_U)), _U(0)).astype(np.int64)
    return got, ahead << n.astype(_U), n


def read_values(tape: Tape, at: np.ndarray, end: np.ndarray, tables: np.ndarray, cuts: np.ndarray, big: np.ndarray, count1: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers (n, 576) from bit ``at`` to ``end`` of each granule; which cannot be read; and which end exactly at their end.

    tables: (n, 3) of the regions of pairs that end at cuts (n, 2) and big. A quadruple that runs over the end is dropped.
    """
    rank = np.argsort(-big, kind="stable")
    at, end, tables, cuts, big, count1 = (x[rank].copy() for x in (at, end, tables, cuts, big, count1))
    n, one = len(at), np.ones(len(at), np.int64)
    out, bad = np.zeros((n, 576), np.int64), np.zeros(n, bool)
    live = np.searchsorted(-big, -np.arange(289), side="left")  # granules with more than k pairs
    for k in range(int(big.max(initial=0))):
        m = live[k]
        table = tables[np.arange(m), (k >= cuts[:m, 0]).astype(int) + (k >= cuts[:m, 1])]
        w, fits = words.find(table, ahead := tape.ahead(at[:m]))
        used = words.length[w]
        ahead = ahead << used.astype(_U)
        x, y = words.values[0, w], words.values[1, w]
        linbits = words.linbits[table]
        for column, v in ((2 * k, x), (2 * k + 1, y)):
            more, ahead, bits = _number(ahead, linbits, v == 15)
            used = used + bits
            v = v + more
            minus, ahead, bits = _number(ahead, one[:m], v > 0)
            used = used + bits
            out[:m, column] = np.where(minus == 1, -v, v)
        at[:m] += used
        bad[:m] |= ~fits | (at[:m] > end[:m])
        at[:m] = np.where(bad[:m], end[:m], at[:m])
    exact = ~bad
    place, open_ = 2 * big, np.flatnonzero(~bad & (at < end))
    while len(open_ := open_[(place[open_] + 4 <= 576) & (at[open_] < end[open_])]):
        w, fits = words.find(QUADS + count1[open_], ahead := tape.ahead(at[open_]))
        used = words.length[w]
        ahead = ahead << used.astype(_U)
        four = []
        for c in range(4):
            v = words.values[c, w]
            minus, ahead, bits = _number(ahead, one[: len(open_)], v > 0)
            used = used + bits
            four.append(np.where(minus == 1, -v, v))
        fits &= at[open_] + used <= end[open_]
        good = open_[fits]
        out[good[:, None], place[good][:, None] + np.arange(4)] = np.stack(four, axis=1)[fits]
        exact[open_[~fits]] = False
        at[good] += used[fits]
        place[good] += 4
        open_ = good
    exact &= at == end
    back = np.argsort(rank)
    return out[back], bad[back], exact[back]


@lru_cache(maxsize=4096)
def scalefactor_plan(kind: int, lsf: bool, compress: int, right: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bands, windows (3 long), and widths of the scalefactors in order; the position that each band may not use."""
    long = range(21) if kind == 0 else range(0 if kind == 1 else 6 if lsf else 8)
    places = [(b, 3) for b in long] + [(b, w) for b in range({0: 13, 1: 0, 2: 3}[kind], 12) for w in range(3)]
    most = np.full((22, 4), 0 if lsf else 7)
    if lsf:
        lengths, row = lsf_lengths(compress, right)
        widths = [n for n, k in zip(lengths, GROUPS_LSF[row][kind]) for _ in range(k)][: len(places)]
        for (x, w), n in zip(places, widths):
            most[x, w] = (1 << n) - 1
    else:
        widths = [SLEN1[compress] if (x < 11 if w == 3 else x < 6) else SLEN2[compress] for x, w in places]
    bands, windows = (np.array([p[k] for p in places[: len(widths)]], int) for k in (0, 1))
    return bands, windows, np.array(widths, int), most


@dataclass
class Spectrum:
    """What a frame gives: rows (granule, channel, block_type, mixed, exact, 576 lines in subband order), or why it cannot be read; its bits and whether all codes end where they should."""

    rows: list[tuple]
    error: str | None
    bits: int
    exact: bool


def kind_of(g: dict) -> int:
    return (2 if g["mixed_block"] else 1) if g["block_type"] == 2 else 0


def spectra(frames: list[tuple[bytes, list[dict], bytes]], words: Words) -> list[Spectrum]:
    """Frames of one stream's kind as (bytes, side information, main data), all granules together."""
    if not frames:
        return []
    facts = [header_facts(f) for f, _, _ in frames]
    tape = Tape([m for _, _, m in frames])
    errors: list[str | None] = [None] * len(frames)
    owner, side, starts = [], [], []
    for k, (_, rows, main) in enumerate(frames):
        at = 0
        for g in rows:
            if at + g["part2_3_length"] > 8 * len(main):
                errors[k] = "part2_3_length beyond the main data"
            owner.append(k)
            side.append(g)
            starts.append(at)
            at += g["part2_3_length"]
    owner, n = np.array(owner), len(side)
    field = lambda name: np.array([g[name] for g in side])
    start = tape.starts[owner] + np.array(starts)
    end = start + field("part2_3_length")
    kinds = np.array([kind_of(g) for g in side])

    plans = [scalefactor_plan(int(kind), facts[k]["lsf"], g["scalefac_compress"], g["channel"] == 1 and facts[k]["intensity"]) for k, g, kind in zip(owner, side, kinds)]
    widths, places = np.zeros((n, 39), np.int64), np.zeros((n, 39), np.int64)
    shared = np.zeros((n, 39), bool)
    for r, (bands, windows, wide, _) in enumerate(plans):
        widths[r, : len(wide)], places[r, : len(wide)] = wide, bands * 4 + windows
        if side[r]["granule"] and kinds[r] == 0:
            for (lo, hi), flag in zip(SCFSI_GROUPS, side[r]["scfsi"]):
                shared[r, lo:hi] |= bool(flag)
    widths[shared] = 0
    offsets = np.cumsum(widths, axis=1)
    values = tape.take((start[:, None] + offsets - widths).reshape(-1), widths.reshape(-1)).reshape(n, 39)
    sf = np.zeros((n, 88), np.int64)
    used = np.zeros((n, 39), bool)
    for r, (bands, *_) in enumerate(plans):
        used[r, : len(bands)] = True
    sf[np.nonzero(used)[0], places[used]] = values[used]
    channels = np.array([facts[k]["channels"] for k in owner])
    for r in np.flatnonzero(shared.any(axis=1)):  # the granule before of the same channel
        at = places[r][shared[r]]
        sf[r, at] = sf[r - channels[r], at]
    sf = sf.reshape(n, 22, 4)
    data = start + offsets[:, -1]
    bad = data > end

    long, short = (np.array(e) for e in band_edges(facts[0]["rate"]))
    big, switched, types = field("big_values"), field("window_switching"), field("block_type")
    r0, r1 = field("region0_count"), field("region1_count")
    plain = np.stack([long[np.minimum(r0 + 1, 22)], long[np.minimum(r0 + r1 + 2, 22)]], axis=1)
    fixed = np.stack([np.where((types == 2) & (field("mixed_block") == 0), 3 * short[3], long[8]), np.full(n, 576)], axis=1)
    tables = np.array([[*g["table_select"], 0][:3] for g in side])
    lines, unread, exact = read_values(tape, np.where(bad, end, data), end, tables, np.where(switched[:, None] > 0, fixed, plain) // 2, np.where(bad, 0, big), field("count1_table"), words)
    bad |= unread
    for k in np.unique(owner[bad]):
        errors[k] = errors[k] or "codes that cannot be read"

    gain, scale = field("global_gain") - 210, np.where(field("scalefac_scale") > 0, 4, 2)
    lsf = np.array([facts[k]["lsf"] for k in owner])
    pre = (field("preflag") > 0) | lsf & (field("scalefac_compress") >= 500) & ~np.array([g["channel"] == 1 and facts[k]["intensity"] for k, g in zip(owner, side)])
    windows = 8 * np.array([[*g["subblock_gain"], 0] for g in side])
    x = np.zeros((n, 576))
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        band, window = layout(facts[0]["rate"], int(kind))
        up = sf[at][:, band, np.where(window < 0, 3, window)] + np.where(window < 0, np.array(PRETAB)[np.minimum(band, 21)], 0) * pre[at, None]
        step = gain[at, None] - np.where(window >= 0, windows[at][:, window], 0) - scale[at, None] * up
        x[at] = np.sign(lines[at]) * np.abs(lines[at]) ** (4 / 3) * 2.0 ** (step / 4)
    pairs = np.array([facts[k]["ms"] or facts[k]["intensity"] for k in owner]) & (channels == 2)
    left = np.flatnonzero(pairs & (field("channel") == 0))
    ms = left[[not facts[owner[r]]["intensity"] for r in left]] if len(left) else left
    l, r = x[ms], x[ms + 1]
    x[ms], x[ms + 1] = (l + r) / 2**0.5, (l - r) / 2**0.5
    for r in left[[facts[owner[r]]["intensity"] for r in left]] if len(left) else ():
        if errors[owner[r]] is None:
            x[r], x[r + 1] = stereo(x[r], x[r + 1], side[r + 1], sf[r + 1], plans[r + 1][3], facts[owner[r]])
    y = np.zeros((n, 576))
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        y[at[:, None], order(facts[0]["rate"], int(kind))] = x[at]
    out, edges = [], np.searchsorted(owner, np.arange(len(frames) + 1))
    for k, error in enumerate(errors):
        a, b = edges[k], edges[k + 1]
        bits = int(sum(g["part2_3_length"] for g in side[a:b]))
        rows = [] if error else [(side[r]["granule"], side[r]["channel"], int(types[r]), side[r]["mixed_block"], bool(exact[r]), y[r]) for r in range(a, b)]
        out.append(Spectrum(rows, error, bits, bool(exact[a:b].all())))
    return out


def frame_spectra(frames: list[tuple[bytes, bytes]], words: Words) -> list[Spectrum]:
    """(bytes, main data) of frames to what they give."""
    return spectra([(f, parse(f), m) for f, m in frames], words)
