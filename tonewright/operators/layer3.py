"""Layer III decoding as steps over DataFrames.

    main_data  a frame's main data joined with the bytes of earlier frames it points into (rows of a stream in order, at most 511 bytes kept)
    spectrum   scalefactors and Huffman codes of each granule, requantised and stereo-processed: a frame alone, any partition
    hybrid     antialias and inverse transforms per granule; halves of neighbours added by a window
    decode     all of them and the polyphase filterbank

The code tables have no formula and are a parameter: ``Codes.load`` reads them from a file. So is the prototype of the filterbank.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.tables import PRETAB, SAMPLE_RATES, SLEN1, SLEN2, band_edges
from ..functions.scalefactors import GROUPS_LSF, SCFSI_GROUPS
from ..sources.layer12 import frame_crc
from ..sources.sideinfo import Bits, parse
from . import filterbank

RESERVOIR = 511
# The eight coefficients of the antialias butterflies.
ANTIALIAS = np.array([-0.6, -0.535, -0.33, -0.185, -0.095, -0.041, -0.0142, -0.0037])


PEEK = 10


@dataclass
class Codes:
    """pairs: table number to (linbits, {(length, word): (x, y)}); quads: the two count-1 tables, {(length, word): (v, w, x, y)}."""

    pairs: dict[int, tuple[int, dict]]
    quads: tuple[dict, dict]

    @staticmethod
    def load(path: str) -> Codes:
        """From JSON: {"pairs": {number: {"linbits": n, "codes": [[length, word, x, y], ...]}}, "quads": [[[length, word, v, w, x, y], ...], ...]}.

        ValueError where a word begins another one, values repeat, a pair of the table's square is missing, or linbits stand at a table that does not reach 15.
        """
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        pairs = {int(k): (t["linbits"], {(c[0], c[1]): tuple(c[2:]) for c in t["codes"]}) for k, t in raw["pairs"].items()}
        quads = tuple({(c[0], c[1]): tuple(c[2:]) for c in t} for t in raw["quads"])
        for name, book, values in (*((f"table {k}", b, 2) for k, (_, b) in pairs.items() if k), *((f"count-1 table {k}", b, 4) for k, b in enumerate(quads))):
            check_book(name, book, values)
        for k, (linbits, book) in pairs.items():
            if linbits and max(map(max, book.values())) != 15:
                raise ValueError(f"table {k}: linbits, but values only to {max(map(max, book.values()))}")
        return Codes(pairs, quads)

    @cached_property
    def looked_up(self) -> dict:
        """For each table (count-1 tables as -1 and -2) what the next ``PEEK`` bits say: (length, values), None where the word is longer."""
        books = {k: b for k, (_, b) in self.pairs.items() if k} | {-1 - k: b for k, b in enumerate(self.quads)}
        out = {}
        for k, book in books.items():
            table = out[k] = [None] * (1 << PEEK)
            for (length, word), values in book.items():
                if length <= PEEK:
                    at = word << PEEK - length
                    table[at : at + (1 << PEEK - length)] = [(length, values)] * (1 << PEEK - length)
        return out

    def symbol(self, bits: Bits, number: int) -> tuple:
        """The next code word's values; ValueError where none fits or the bits end."""
        left = bits.left
        ahead = (bits.value >> left - PEEK if left >= PEEK else bits.value << PEEK - left) & (1 << PEEK) - 1
        hit = self.looked_up[number][ahead]
        if hit is not None:
            bits.left = left - hit[0]
            if bits.left < 0:
                raise ValueError("ran past the end")
            return hit[1]
        book, word = self.quads[-1 - number] if number < 0 else self.pairs[number][1], 0
        for length in range(1, 33):
            word = word << 1 | bits.take(1)
            if (length, word) in book:
                return book[length, word]
        raise ValueError("no such code word")


def check_book(name: str, book: dict, values: int) -> None:
    """ValueError unless no word begins another and every combination of values up to the largest has one word."""
    words = sorted(f"{word:0{length}b}" for length, word in book)
    if any(b.startswith(a) for a, b in zip(words, words[1:])):
        raise ValueError(f"{name}: a code word begins another one")
    top = max(map(max, book.values()), default=0)
    if len(set(book.values())) != len(book) or len(book) != (top + 1) ** values:
        raise ValueError(f"{name}: {len(set(book.values()))} of {(top + 1) ** values} values have a word")


def header_facts(frame: bytes) -> dict:
    word = int.from_bytes(frame[:4], "big")
    version = word >> 19 & 3
    lsf, mono = version != 3, word >> 6 & 3 == 3
    joint = word >> 6 & 3 == 1
    return {
        "rate": SAMPLE_RATES[word >> 10 & 3] // {3: 1, 2: 2, 0: 4}[version], "lsf": lsf, "channels": 1 if mono else 2, "ms": joint and bool(word >> 5 & 1), "intensity": joint and bool(word >> 4 & 1),
        "start": (4 if word >> 16 & 1 else 6) + ((9 if mono else 17) if lsf else (17 if mono else 32)),
    }


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames in order of stream and number, each with its main data; null where it points before the stream."""
    stream, held = None, b""
    for b in batches:
        out = []
        for sid, no, frame in zip(*(b.column(k).to_pylist() for k in range(3))):
            if sid != stream:
                stream, held = sid, b""
            try:
                side = parse(frame)
            except ValueError:
                out.append((sid, no, frame, None))  # adds nothing to the reservoir
                continue
            own, begin = frame[header_facts(frame)["start"] :], side[0]["main_data_begin"]
            out.append((sid, no, frame, held[len(held) - begin :] + own if begin <= len(held) else None))
            held = (held + own)[-RESERVOIR:]
        cols = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["stream_id", "frame_no", "bytes", "main"])


def main_data(frames: DataFrame) -> DataFrame:
    """(stream_id, frame_no, bytes) to the same with ``main``, the main data from where the frame says it begins."""
    rows = frames.select("stream_id", "frame_no", "bytes").repartition("stream_id").sortWithinPartitions("stream_id", "frame_no")
    return rows.mapInArrow(_gather, "stream_id string, frame_no bigint, bytes binary, main binary")


@lru_cache(maxsize=32)
def layout(rate: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Band and window (-1 long) of each of 576 coded lines; kind 0 long, 1 short, 2 mixed."""
    long, short = band_edges(rate)
    band, window = np.zeros(576, int), np.full(576, -1)
    at = 0
    if kind != 1:
        for b, (lo, hi) in enumerate(zip(long, long[1:])):
            if kind == 0 or hi <= 36:
                band[lo:hi] = b
                at = hi
    if kind:
        for b, (lo, hi) in enumerate(zip(short, short[1:])):
            if kind == 1 or 3 * lo >= 36:
                for w in range(3):
                    band[at : at + hi - lo], window[at : at + hi - lo] = b, w
                    at += hi - lo
    return band, window


@lru_cache(maxsize=32)
def order(rate: int, kind: int) -> np.ndarray:
    """Where each coded line of short windows goes: lines of a band interleaved by window, six to a subband."""
    band, window = layout(rate, kind)
    place = np.arange(576)
    if kind:
        lines = np.zeros(576, int)
        for w in range(3):
            mine = np.flatnonzero(window == w)
            lines[mine] = np.arange(len(mine))
        first = int(np.argmax(window >= 0))
        place = np.where(window < 0, place, first + lines // 6 * 18 + window * 6 + lines % 6)
    return place


def read_scalefactors(bits: Bits, g: dict, facts: dict, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Scalefactors (long 22, or short 13 x 3, by [band, window]; window 3 is long) and the position that each band may not use."""
    kind = (2 if g["mixed_block"] else 1) if g["block_type"] == 2 else 0
    long = list(range(21)) if kind == 0 else ([] if kind == 1 else list(range(6 if facts["lsf"] else 8)))
    places = [(b, 3) for b in long] + [(b, w) for b in range({0: 13, 1: 0, 2: 3}[kind], 12) for w in range(3)]
    if facts["lsf"]:
        lengths, row = lsf_lengths(g["scalefac_compress"], g["channel"] == 1 and facts["intensity"])
        widths = [n for n, k in zip(lengths, GROUPS_LSF[row][kind]) for _ in range(k)]
    else:
        a, b = SLEN1[g["scalefac_compress"]], SLEN2[g["scalefac_compress"]]
        widths = [a if (x < 11 if w == 3 else x < 6) else b for x, w in places]
    shared = {x for (lo, hi), flag in zip(SCFSI_GROUPS, g["scfsi"]) if flag for x in range(lo, hi)} if g["granule"] and kind == 0 and before is not None else set()
    sf, most = np.zeros((22, 4), int), np.full((22, 4), 7 if not facts["lsf"] else 0)
    for (x, w), n in zip(places, widths):
        sf[x, w] = before[x, w] if w == 3 and x in shared else bits.take(n)
        if facts["lsf"]:
            most[x, w] = (1 << n) - 1
    return sf, most


def lsf_lengths(s: int, right: bool) -> tuple[list[int], int]:
    if right:
        v = s >> 1
        if v < 180:
            return [v // 36, v % 36 // 6, v % 6, 0], 3
        return ([(v - 180) % 64 >> 4, (v - 180) % 16 >> 2, (v - 180) % 4, 0], 4) if v < 244 else ([(v - 244) // 3, (v - 244) % 3, 0, 0], 5)
    if s < 400:
        return [(s >> 4) // 5, (s >> 4) % 5, s % 16 >> 2, s % 4], 0
    return ([(s - 400 >> 2) // 5, (s - 400 >> 2) % 5, (s - 400) % 4, 0], 1) if s < 500 else ([(s - 500) // 3, (s - 500) % 3, 0, 0], 2)


def read_lines(bits: Bits, g: dict, rate: int, codes: Codes) -> tuple[np.ndarray, bool]:
    """576 quantised lines, and whether the codes end exactly where the granule's bits do."""
    long, short = band_edges(rate)
    big = 2 * g["big_values"]
    if g["window_switching"]:
        cuts = [3 * short[3] if g["block_type"] == 2 and not g["mixed_block"] else long[8], 576]
    else:
        cuts = [long[min(g["region0_count"] + 1, 22)], long[min(g["region0_count"] + g["region1_count"] + 2, 22)]]
    out, at = np.zeros(576, int), 0
    sign = lambda v: -v if v and bits.take(1) else v
    for stop, number in zip((*(min(c, big) for c in cuts), big), (*g["table_select"], 0, 0)):
        linbits = codes.pairs[number][0] if number else 0
        for k in range(at, stop, 2) if number else ():
            for d, v in enumerate(codes.symbol(bits, number)):
                out[k + d] = sign(v + bits.take(linbits) if linbits and v == 15 else v)
        at = max(at, stop)
    exact = True
    while at + 4 <= 576 and bits.left > 0:
        try:
            out[at : at + 4] = [sign(v) for v in codes.symbol(bits, -1 - g["count1_table"])]
        except ValueError:  # a word cut off by the end is dropped
            out[at : at + 4] = 0
            return out, False
        at += 4
    return out, exact and bits.left == 0


def requantised(lines: np.ndarray, g: dict, sf: np.ndarray, rate: int, lsf: bool, right: bool = False) -> np.ndarray:
    kind = (2 if g["mixed_block"] else 1) if g["block_type"] == 2 else 0
    band, window = layout(rate, kind)
    pre = g["preflag"] or (lsf and g["scalefac_compress"] >= 500 and not right)  # right: of intensity stereo
    up = sf[band, np.where(window < 0, 3, window)] + np.where((window < 0) & bool(pre), np.array(PRETAB)[band], 0)
    gain = g["global_gain"] - 210 - np.where(window >= 0, 8 * np.array([*g["subblock_gain"], 0])[window], 0) - (4 if g["scalefac_scale"] else 2) * up
    return np.sign(lines) * np.abs(lines) ** (4 / 3) * 2.0 ** (gain / 4)


def _factors(position: int, most: int, lsf: bool, low_bit: int) -> tuple[float, float] | None:
    if lsf:
        io = 0.5 ** (0.5 if low_bit else 0.25)
        if position == most:
            return None
        return (io ** ((position + 1) // 2), 1.0) if position % 2 else (1.0, io ** (position // 2))
    if position >= 7:
        return None
    t = np.tan(position * np.pi / 12)
    return (1.0, 0.0) if position == 6 else (t / (1 + t), 1 / (1 + t))


def stereo(left: np.ndarray, right: np.ndarray, g: dict, sf: np.ndarray, most: np.ndarray, facts: dict) -> tuple[np.ndarray, np.ndarray]:
    """Mid/side over the lines that are not intensity-coded; those are the bands above the last that the right channel holds.

    The highest band has no position of its own and goes on with the one below if that is coded, else with 0.
    """
    kl, kr, coded = np.ones(576), np.ones(576), np.zeros(576, bool)
    if facts["intensity"]:
        kind = (2 if g["mixed_block"] else 1) if g["block_type"] == 2 else 0
        band, window = layout(facts["rate"], kind)
        silent = not right[window >= 0].any()
        for w in (3, 0, 1, 2):
            mine = (window == -1) if w == 3 else (window == w)
            if not mine.any() or w == 3 and kind == 2 and not silent:
                continue
            top, held = (21 if w == 3 else 12), band[mine & (right != 0)]
            first = int(held.max()) + 1 if len(held) else int(band[mine].min())
            for b in range(first, int(band[mine].max()) + 1):
                last = b == top
                position, limit = (sf[b - 1, w], most[b - 1, w]) if last and b > first else (0, 255) if last else (sf[b, w], most[b, w])
                k = _factors(int(position), int(limit), facts["lsf"], g["scalefac_compress"] & 1)
                if k:
                    at = mine & (band == b)
                    kl[at], kr[at], coded[at] = *k, True
    m, s = (left + right) / 2**0.5, (left - right) / 2**0.5
    plain_l, plain_r = (m, s) if facts["ms"] else (left, right)
    return np.where(coded, left * kl, plain_l), np.where(coded, left * kr, plain_r)


def frame_spectrum(frame: bytes, main: bytes, codes: Codes) -> list[tuple]:
    """(granule, channel, block_type, mixed, exact, lines in subband order) of a frame; ValueError if it cannot be read."""
    facts, rows, at, kept = header_facts(frame), [], 0, {}
    side = parse(frame)
    for n in range(side[-1]["granule"] + 1):
        done = []
        for g in (x for x in side if x["granule"] == n):
            if at + g["part2_3_length"] > 8 * len(main):
                raise ValueError("part2_3_length beyond the main data")
            whole = int.from_bytes(main, "big") >> (8 * len(main) - at - g["part2_3_length"]) & ((1 << g["part2_3_length"]) - 1)
            bits = Bits(b"")
            bits.value, bits.left = whole, g["part2_3_length"]
            at += g["part2_3_length"]
            sf, most = read_scalefactors(bits, g, facts, kept.get(g["channel"]))
            kept[g["channel"]] = sf
            lines, exact = read_lines(bits, g, facts["rate"], codes)
            done.append([g, sf, most, exact, requantised(lines, g, sf, facts["rate"], facts["lsf"], g["channel"] == 1 and facts["intensity"])])
        if len(done) == 2 and (facts["ms"] or facts["intensity"]):
            done[0][4], done[1][4] = stereo(done[0][4], done[1][4], *done[1][:3], facts)
        for g, _, _, exact, x in done:
            kind = (2 if g["mixed_block"] else 1) if g["block_type"] == 2 else 0
            y = np.zeros(576)
            y[order(facts["rate"], kind)] = x
            rows.append((n, g["channel"], g["block_type"], g["mixed_block"], exact, y))
    return rows


SPECTRUM = "stream_id string, frame_no bigint, granule int, channel int, block_type int, mixed int, exact boolean, x array<float>, concealed boolean"


def crc_holds(frame: bytes) -> bool:
    """Whether the CRC word, if there is one, fits the second half of the header and the side information."""
    if frame[1] & 1:
        return True
    covered = frame[2:4] + frame[6 : header_facts(frame)["start"]]
    return frame_crc(0xFFFF, int.from_bytes(covered, "big"), 8 * len(covered)) == int.from_bytes(frame[4:6], "big")


def spectrum(mains: DataFrame, codes: Codes, check_crc: bool = False) -> DataFrame:
    """``main_data`` rows to one row per granule and channel. A frame that cannot be read (or whose CRC fails, if checked) is silence, ``concealed``."""
    shared = mains.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.float32()), pa.bool_())
        names = [c.split()[0] for c in SPECTRUM.split(", ")]
        for b in batches:
            out = []
            for sid, no, frame, main in zip(*(b.column(k).to_pylist() for k in range(4))):
                try:
                    if main is None:
                        raise ValueError("main data before the stream")
                    if check_crc and not crc_holds(frame):
                        raise ValueError("the frame CRC does not match")
                    out += [(sid, no, *r[:5], r[5].astype(np.float32), False) for r in frame_spectrum(frame, main, shared.value)]
                except (ValueError, KeyError, IndexError):
                    facts = header_facts(frame)
                    out += [(sid, no, g, c, 0, 0, False, np.zeros(576, np.float32), True) for g in range(1 if facts["lsf"] else 2) for c in range(facts["channels"])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([bool(v) if k == pa.bool_() else v for v in c], k) for c, k in zip(zip(*out), kinds)], names=names)

    return mains.mapInArrow(run, SPECTRUM)


@lru_cache(maxsize=1)
def _transforms() -> tuple[np.ndarray, np.ndarray]:
    """36 x 18 matrices, window included, of the four block types; cs and ca of the butterflies."""
    i, k = np.arange(36)[:, None], np.arange(18)[None, :]
    long, half = np.cos(np.pi / 72 * (2 * i + 19) * (2 * k + 1)), np.sin(np.pi / 36 * (np.arange(36) + 0.5))
    six = np.sin(np.pi / 12 * (np.arange(12) + 0.5))
    start = np.r_[half[:18], np.ones(6), six[6:], np.zeros(6)]
    short = np.zeros((36, 18))
    ii, kk = np.arange(12)[:, None], np.arange(6)[None, :]
    for w in range(3):
        short[6 + 6 * w : 18 + 6 * w, 6 * w : 6 * w + 6] = np.cos(np.pi / 24 * (2 * ii + 7) * (2 * kk + 1)) * six[:, None]
    scale = np.sqrt(1 + ANTIALIAS**2)
    return np.stack([long * half[:, None], long * start[:, None], short, long * start[::-1, None]]), np.stack([1 / scale, ANTIALIAS / scale])


def inverse_hybrid(x: np.ndarray, block_type: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """(n, 576) lines in subband order to (n, 32, 36) windowed samples: butterflies, then the transform of each subband's kind."""
    matrices, (cs, ca) = _transforms()
    x = x.reshape(-1, 32, 18).copy()
    short = block_type == 2
    edges = np.where(~short, 31, np.where(mixed == 1, 1, 0))
    for sb in range(1, 32):
        use = edges >= sb
        up, down = x[use, sb - 1, :9:-1][:, :8], x[use, sb, :8]
        x[use, sb - 1, 17:9:-1], x[use, sb, :8] = up * cs - down * ca, down * cs + up * ca
    kind = np.repeat(block_type[:, None], 32, axis=1)
    kind[(mixed == 1), :2] = 0
    out = np.zeros((len(x), 32, 36))
    for t in range(4):
        at = kind == t
        out[at] = x[at] @ matrices[t].T
    return out


def hybrid(spectra: DataFrame) -> DataFrame:
    """(stream_id, frame_no, granule, channel, block_type, mixed, x) to (stream_id, channel, slot, s): eighteen subband slots per granule.

    The second half of the granule before is added by a window; it starts anew where a stream's channels change.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = inverse_hybrid(np.array(b.column("x").to_pylist()), b.column("block_type").to_numpy(), b.column("mixed").to_numpy())
                halves = [pa.array(list(h.reshape(len(y), 576)), pa.list_(pa.float64())) for h in (y[:, :, :18], y[:, :, 18:])]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("stream_id", "frame_no", "granule", "channel", "channels")), *halves], names=["stream_id", "frame_no", "granule", "channel", "channels", "head", "tail"])

    t = spectra.withColumn("channels", F.count(F.lit(1)).over(Window.partitionBy("stream_id", "frame_no", "granule")).cast("int"))
    t = t.select("stream_id", "frame_no", "granule", "channel", "channels", "block_type", "mixed", "x")
    t = t.mapInArrow(run, "stream_id string, frame_no bigint, granule int, channel int, channels int, head array<double>, tail array<double>")
    o = Window.partitionBy("stream_id", "channel").orderBy("frame_no", "granule")
    before = F.when(F.lag("channels").over(o) == F.col("channels"), F.lag("tail").over(o))
    t = t.withColumn("before", before).withColumn("at", (F.row_number().over(o) - 1).cast("bigint"))
    added = F.when(F.col("before").isNull(), F.col("head")).otherwise(F.zip_with("head", "before", lambda a, b: a + b))
    t = t.select("stream_id", "channel", "at", added.alias("v"))
    t = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(17))))
    one = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda sb: F.get("v", sb * 18 + F.col("i")) * F.when((sb % 2 == 1) & (F.col("i") % 2 == 1), -1.0).otherwise(1.0))
    return t.select("stream_id", "channel", (F.col("at") * 18 + F.col("i")).alias("slot"), one.cast("array<float>").alias("s"))


def decode(frames: DataFrame, codes: Codes, prototype: np.ndarray) -> DataFrame:
    """Layer III frames to (stream_id, channel, slot, s: 32 samples)."""
    from . import playback

    return playback.played(playback.ordered_rows(frames, codes), prototype).drop("concealed")
