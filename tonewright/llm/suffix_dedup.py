"""Exact substring dedup by a difference-cover suffix sort of bounded depth.

A byte goes when it lies in a ``LENGTH``-byte string that also starts earlier. The difference
cover ``COVER`` modulo ``PERIOD`` samples the positions of each document: of any two positions both
become sampled after the same step of fewer than ``PERIOD`` bytes. The sampled suffixes of the corpus are sorted by their first
``HEAD`` bytes, as bytes; equal heads stand next to each other. The other suffixes need no sort of their own: each
reaches a sampled neighbour within ``PERIOD - 1`` bytes, so two equal strings meet as neighbours with equal heads, and
what the head leaves out of them, up to ``PERIOD - 1`` bytes on either side, is compared byte by byte between
adjacent rows. The length asked for bounds the depth, so names need no recursion: heads and the bytes
around them span every string. (The cover modulo 3 with triples of symbols would sort three and a half times as many rows.)

Two reductions come first, so that text that cannot matter is not sorted:

* segments between content-defined cuts, with the 99 bytes after them, that equal
  an earlier segment (128-bit hash) are removed whole, and leave the sort;
* every 66 bytes are represented by their least 32-byte gram (winnowing); a string that holds 66 bytes whose gram occurs once among the
  remaining strings cannot repeat. Grams are told by 64-bit hashes; a collision costs a needless comparison, nothing else.

Order is (doc_id, hash of the text, start). Null texts are empty. Texts under 100 bytes keep all.
Repeated rows (same id and text) are one document and get the same result; rows that share an id alone are documents of their own. Rows
without an id have no place in the order: they take nothing from others and lose what repeats within them. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bytewise
from .bytewise import Texts, mix
from .common import drop, materialize

LENGTH = 100
GRAM = 32
GRAMS = LENGTH - GRAM + 1
WINDOW = 35
#: A perfect difference set; the differences of its members give every remainder.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
SIDE = PERIOD - 1
HEAD = LENGTH - SIDE
CUT_MASK, CUT_VALUE = 0x3F, 0x2B
CHUNK = 1 << 20
PAIRED = 8  # groups of fewer equal heads are compared pair by pair


def grams(data: np.ndarray, size: int = GRAM, seed: int = 0x100000001B3) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes at each position; size is a power of two."""
    h = data.astype(np.uint64) + np.uint64(1)
    if len(h) < size:
        return h[:0]
    n, m = 1, seed
    while n < size:
        h = h[:-n] * np.uint64(m) + h[n:]
        m = m * m % 2**64
        n *= 2
    return mix(h)


def _sliding(f, a: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        a = f(a[:-n], a[n:])
        n *= 2
    return f(a[: len(a) - (width - n)], a[width - n :]) if width > n else a


def _strings(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the positions of each text at which a whole string starts."""
    return edges[:-1], np.maximum(edges[1:] - LENGTH + 1, edges[:-1])


def _covered(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """True for the positions below n in any of the intervals."""
    v = np.zeros(n + 1, np.int64)
    np.add.at(v, np.clip(starts, 0, n), 1)
    np.subtract.at(v, np.clip(stops, 0, n), 1)
    return np.cumsum(v[:-1]) > 0


def _edges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of True."""
    at = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return at[::2], at[1::2]


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments between cuts, which depend on the 32 bytes after them alone; ``own`` marks those that repeat within their document."""
    from xxhash import xxh3_128_digest

    for b in batches:
        ids, th = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        for t in bytewise.texts(b.column(2), CHUNK):
            cuts = np.flatnonzero((grams(t.data) & np.uint64(CUT_MASK)) == CUT_VALUE)
            lo, hi = _strings(t.edges)
            part = np.split(cuts, np.searchsorted(cuts, t.edges[1:-1]))
            raw, hashes, rows, starts, stops, own = t.data.tobytes(), [], [], [], [], []
            for k, (base, stop, inside) in enumerate(zip(lo.tolist(), hi.tolist(), part)):
                if stop <= base:
                    continue
                edges = [base, *inside[(inside > base) & (inside < stop)].tolist(), stop]
                seen = set()
                for x, y in zip(edges, edges[1:]):
                    h = xxh3_128_digest(raw[x : y + LENGTH - 1])
                    hashes.append(h)
                    own.append(h in seen)
                    seen.add(h)
                rows += [k] * (len(edges) - 1)
                starts += edges[:-1]
                stops += edges[1:]
            if rows:
                pair, row = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2), np.array(rows)
                base = t.edges[row]
                cols = [pair[:, 0].copy(), pair[:, 1].copy(), ids[t.first + row], th[t.first + row], (np.array(starts) - base).astype(np.int32), (np.array(stops) - base).astype(np.int32), np.array(own)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h1", "h2", "doc_id", "th", "start", "stop", "own"])


def _packed(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of row k of a list of intervals, each start * 2^32 + stop."""
    x = column[k]
    v = np.asarray(x.values, np.int64) if x.is_valid else np.zeros(0, np.int64)
    return v >> 32, v & 0xFFFFFFFF


def _fresh(t: Texts, copies: pa.Array) -> np.ndarray:
    """True where a string starts that is in no copied segment."""
    fresh = np.zeros(t.edges[-1], bool)
    for k, (lo, hi) in enumerate(zip(*_strings(t.edges))):
        fresh[lo:hi] = True
        if copies[t.first + k].is_valid:
            starts, stops = _packed(copies, t.first + k)
            fresh[lo:hi] &= ~_covered(hi - lo, starts, stops)
    return fresh


def _surplus(key: np.ndarray) -> np.ndarray:
    """True for all but the first two rows of each key."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    third = np.zeros(len(key), bool)
    third[order[2:]] = k[2:] == k[:-2]
    return third


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text, copies) to the anchors of strings outside copied segments: grams that are least in a window within one.

    Of a gram that one run of rows holds more than twice, two rows tell all other tasks; the rest are known to
    repeat and travel under a key of their own, so no task gets a frequent gram's rows.
    """
    for b in batches:
        ids, th, copies = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(3)
        for t in bytewise.texts(b.column(2), CHUNK):
            h = grams(t.data)
            if len(h) < GRAMS:
                continue
            least = _sliding(np.minimum, h, WINDOW)
            seen, x = np.cumsum(np.r_[0, _fresh(t, copies)]), np.arange(len(least))
            least[seen[x + 1] == seen[np.maximum(x - (GRAMS - WINDOW), 0)]] = 0  # in no string that counts
            pad = np.zeros(WINDOW - 1, np.uint64)
            at = np.flatnonzero((_sliding(np.maximum, np.r_[pad, least, pad], WINDOW) == h) & (h > 0))
            doc = np.searchsorted(t.edges, at, side="right") - 1
            gram, place, row = h[at].view(np.int64), at - t.edges[doc], t.first + doc
            known = _surplus(gram)
            gram = np.where(known, mix((ids[row] * 1_000_003 + place).astype(np.uint64)).view(np.int64), gram)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, known, ids[row], th[row], place.astype(np.int32))], names=["gram", "known", "doc_id", "th", "at"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of anchors sorted by gram, those whose neighbour has the same gram, and those known to repeat."""
    held, last = None, None
    names = ["doc_id", "th", "at"]
    for b in batches:
        if not b.num_rows:
            continue
        rows = [b.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        if held is not None:
            rows = [np.r_[x, y] for x, y in zip(held, rows)]
        g = rows[0]
        before = np.r_[last is not None and g[0] == last, g[1:] == g[:-1]]
        if len(g) > 1:
            keep = before[:-1] | (g[1:] == g[:-1]) | rows[1][:-1]
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep]) for x in rows[2:]], names=names)
            last = g[-2]
        held = [x[-1:] for x in rows]
    if held is not None and (held[1][0] or held[0][0] == last):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[2:]], names=names)


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text, copies, anchors that repeat) to the stretches of bytes whose strings may repeat: every window's least gram does."""
    for b in batches:
        ids, th, copies, anchors = b.column(0), b.column(1), b.column(3), b.column(4)
        for t in bytewise.texts(b.column(2), CHUNK):
            h = grams(t.data)
            if len(h) < GRAMS:
                continue
            again = np.unique(np.concatenate([h[np.asarray(anchors[t.first + k].values) + t.edges[k]] for k in range(t.after - t.first)]))
            least = _sliding(np.minimum, h, WINDOW)
            found = again[np.minimum(np.searchsorted(again, least), len(again) - 1)] == least
            every = _sliding(np.minimum, found.view(np.int8), GRAMS - WINDOW + 1) > 0
            live = _fresh(t, copies)
            live[: len(every)] &= every
            live[len(every) :] = False
            lo, hi = _edges(live)
            cut = np.searchsorted(t.edges, lo, side="right") - 1
            raw = t.data.tobytes()
            pieces = [raw[x : y + LENGTH - 1] for x, y in zip(lo.tolist(), hi.tolist())]
            if pieces:
                row = pa.array(t.first + cut)
                yield pa.RecordBatch.from_arrays([ids.take(row), th.take(row), pa.array(lo - t.edges[cut]), pa.array(pieces, pa.binary())], names=["doc_id", "th", "start", "piece"])


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _unbinary(column: pa.Array, width: int) -> np.ndarray:
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[first : first + width * len(column)].reshape(-1, width)


_SAMPLE = "head binary, sides binary, doc_id bigint, th bigint, at int, reach int"
TOLD = 1 << 16


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces to their sampled positions: head, the bytes on its sides, and how far the piece reaches.

    reach is 256 times the bytes after the position plus those before it, as far as they can matter. A row that equals an earlier one of
    its batch in all this is known to repeat, says so (``TOLD``) and travels under a head of its own.
    """
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    for b in batches:
        if not b.num_rows:
            continue
        doc_id, th, first = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        for t in bytewise.texts(b.column(3), CHUNK // 2):
            size = np.diff(t.edges)
            places = size - HEAD + 1
            which = np.repeat(np.arange(len(size)), places)
            q = np.arange(len(which)) - np.repeat(np.cumsum(places) - places, places)
            at = q + first[t.first + which]
            keep = cover[at % PERIOD]
            which, q, at = which[keep], q[keep], at[keep].astype(np.int32)
            left, right = np.minimum(q, SIDE), np.minimum(size[which] - q, LENGTH)
            fits = left + right >= LENGTH
            which, q, at, left, right = (x[fits] for x in (which, q, at, left, right))
            if not len(q):
                continue
            data = np.r_[np.zeros(SIDE, np.uint8), t.data, np.zeros(LENGTH, np.uint8)]
            x = t.edges[which] + q  # in data, where the bytes before the position start
            span = np.lib.stride_tricks.sliding_window_view(data, SIDE + LENGTH)[x]
            ids, hashes, reach = doc_id[t.first + which], th[t.first + which], right * 256 + left
            g = grams(data, 64)
            h = mix(g[x] + mix(g[x + 64] + mix(g[x + SIDE + LENGTH - 64])) + reach.astype(np.uint64))
            order = np.lexsort((at, hashes, ids, h))
            a, z = order[1:], order[:-1]
            told = np.zeros(len(q), bool)
            told[a] = (h[a] == h[z]) & (reach[a] == reach[z]) & ((ids[a] != ids[z]) | (hashes[a] != hashes[z]) | (at[a] != at[z])) & (span[a] == span[z]).all(axis=1)
            head, sides = span[:, SIDE:LENGTH].copy(), np.c_[span[:, :SIDE], span[:, LENGTH:]]
            head[told, :8] = mix((ids[told] * 1_000_003 + at[told]).astype(np.uint64)).view(np.uint8).reshape(-1, 8)
            cols = [_binary(head), _binary(sides), *(pa.array(c) for c in (ids, hashes, at, (reach + told * TOLD).astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(cols, names=["head", "sides", "doc_id", "th", "at", "reach"])


def _matched(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many columns from the first on are equal, per row."""
    differ = np.c_[a != b, np.ones(len(a), bool)]
    return differ.argmax(axis=1)


def pair_hits(sides: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bytes before, bytes after its position) of the strings that equal one of an earlier row of the group; every two rows are compared."""
    out = []
    for lag in range(1, PAIRED):
        t = np.flatnonzero(group[lag:] == group[:-lag]) + lag
        if not len(t):
            break
        s = t - lag
        before = np.minimum(_matched(sides[t, SIDE - 1 :: -1], sides[s, SIDE - 1 :: -1]), np.minimum(left[t], left[s]))
        after = np.minimum(HEAD + _matched(sides[t, SIDE:], sides[s, SIDE:]), np.minimum(right[t], right[s]))
        hit = before + after >= LENGTH
        out.append((t[hit], before[hit], after[hit]))
    return out


def class_hits(sides: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same for large groups: for each step back the strings fall into classes, and all but the first of a class are hits."""
    found = np.zeros((len(group), SIDE + 3), np.int8)
    name = np.ascontiguousarray(group.astype(">i8")).view(np.uint8).reshape(-1, 8)
    for back in range(SIDE + 1):
        there = np.flatnonzero((left >= back) & (right >= LENGTH - back))
        if len(there):
            key = np.ascontiguousarray(np.c_[name[there], sides[there, SIDE - back : 2 * SIDE - back]])
            _, one = np.unique(key.view(f"V{key.shape[1]}").ravel(), return_index=True)
            found[there, back + 1] = 1
            found[there[one], back + 1] = 0
    row, edge = np.nonzero(np.diff(found, axis=1))
    return [(row[::2], edge[1::2] - 1, LENGTH - edge[::2])]


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by head, document and position: the intervals of bytes that equal earlier ones, as (doc_id, th, start * 2^32 + stop).

    Of the group of equal heads that a batch ends in, one row per distinct sides and reach is carried on.
    """
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = [_unbinary(b.column(0), HEAD), _unbinary(b.column(1), 2 * SIDE), *(b.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6))]
        old = 0 if held is None else len(held[0])
        if old:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        head, sides, doc_id, th, at, reach = rows
        new = np.r_[True, (head[1:] != head[:-1]).any(axis=1)]
        same = np.r_[False, ~new[1:] & np.all([x[1:] == x[:-1] for x in rows[2:]], axis=0)]  # a repeated row of the table
        group, told = np.cumsum(new), reach >= TOLD
        left, right = reach & 0xFF, (reach >> 8) & 0xFF
        out = [(x, left[x], right[x]) for x in [np.flatnonzero(told & (np.arange(len(at)) >= old))]]
        live = np.flatnonzero(~told & ~same)
        count = np.bincount(group[live], minlength=group[-1] + 1)[group[live]]
        for x, hits in ((live[(count > 1) & (count < PAIRED)], pair_hits), (live[count >= PAIRED], class_hits)):
            if len(x):
                out += [(x[r], p, q) for r, p, q in hits(sides[x], left[x], right[x], group[x])]
        row, before, after = (np.concatenate(c) for c in zip(*out))
        mine = row >= old
        row, before, after = row[mine], before[mine], after[mine]
        start = at[row].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(doc_id[row]), pa.array(th[row]), pa.array((start - before) << 32 | (start + after))], names=["doc_id", "th", "span"])
        tail = live[group[live] == group[-1]]
        if len(tail) >= PAIRED:
            key = np.ascontiguousarray(np.c_[sides[tail], left[tail].astype(np.uint8), right[tail].astype(np.uint8)])
            tail = tail[np.sort(np.unique(key.view(f"V{key.shape[1]}").ravel(), return_index=True)[1])]
        held = [x[tail] for x in rows]


def own_repeats(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The intervals of one text's bytes that repeat within it."""
    n = len(raw) - LENGTH + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g, k = grams(raw, 64), grams(raw, 64, 0x5851F42D4C957F2D)
    a, b = g[:n] + mix(k[LENGTH - 64 :][:n]), k[:n] ^ mix(g[LENGTH - 64 :][:n])
    order = np.lexsort((np.arange(n), b, a))
    hit = order[1:][(a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])]
    return hit, hit + LENGTH


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, copies, later) to what is left of each text."""
    for b in batches:
        ids, text, copies, later = b.columns
        text = text.fill_null("").cast(pa.binary())
        unnamed, hit = ids.is_null().to_numpy(zero_copy_only=False), (copies.is_valid().to_numpy(zero_copy_only=False) | later.is_valid().to_numpy(zero_copy_only=False))
        size = np.diff(np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]).astype(np.int64) if len(text) else np.zeros(0, np.int64)
        gone, spans, kept = np.zeros(b.num_rows, np.int64), [[]] * b.num_rows, {}
        for k in np.flatnonzero(hit | unnamed).tolist():
            raw = np.frombuffer(text[k].as_buffer() or b"", np.uint8)
            if unnamed[k]:
                starts, stops = own_repeats(raw)
            else:
                (a, c), (x, y) = _packed(copies, k), _packed(later, k)
                starts, stops = np.r_[a, x], np.r_[c + LENGTH - 1, y]
            if len(starts):
                cut = _covered(len(raw), starts, stops)
                gone[k], kept[k] = cut.sum(), raw[~cut].tobytes()
                spans[k] = [{"start": p, "stop": q} for p, q in zip(*(e.tolist() for e in _edges(cut)))]
        at, left = np.arange(b.num_rows), pa.array(list(kept.values()), pa.binary())
        at[list(kept)] = b.num_rows + np.arange(len(kept))
        cols = [ids, pa.array(size), pa.array(gone), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.concat_arrays([text, left]).take(pa.array(at))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def _copies(cuts: DataFrame) -> DataFrame:
    """Segments to (doc_id, th, copies) of those that an earlier document, or the same one earlier, holds."""
    once, key, found = cuts.where("not own"), ["h1", "h2"], ["doc_id", "th", "start", "stop"]
    counted = once.groupBy(*key).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.min("th").alias("t0"), F.max("th").alias("t1"))
    counted = counted.where("first_doc < last_doc or t0 < t1").hint("shuffle_hash")
    held = materialize(once.join(counted, key).select(*key, *found, (F.col("doc_id") > F.col("first_doc")).alias("later")), "held")
    first = held.where("not later")
    tied = first.groupBy(*key).agg(F.min("th").alias("t0"), F.max("th").alias("t1")).where("t0 < t1").drop("t1")
    again = held.where("later").select(*found).union(first.join(tied, key).where("th > t0").select(*found)).union(cuts.where("own").select(*found))
    span = F.shiftleft(F.col("start").cast("bigint"), 32) + F.col("stop")
    copies = materialize(again.groupBy("doc_id", "th").agg(F.collect_set(span).alias("copies")), "copies")
    drop(held)
    return copies


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (start, stop) removed, kept (the remaining bytes)."""
    text, key = F.col("text").cast("string"), ["doc_id", "th"]
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    named = docs.where("doc_id is not null")
    cuts = materialize(named.mapInArrow(_segment_rows, "h1 bigint, h2 bigint, doc_id bigint, th bigint, start int, stop int, own boolean"), "segments")
    copies = _copies(cuts)
    drop(cuts)
    copies_of = copies.hint("shuffle_hash")

    known = named.join(copies_of, key, "left").select(*key, "text", "copies")
    anchored = known.mapInArrow(_anchor_rows, "gram bigint, known boolean, doc_id bigint, th bigint, at int")
    anchored = anchored.repartition("gram").sortWithinPartitions("gram")
    wanted = anchored.mapInArrow(_repeated, "doc_id bigint, th bigint, at int").groupBy(*key).agg(F.collect_set("at").alias("anchors"))
    wanted = materialize(wanted, "anchors")
    pieces = named.join(wanted.hint("shuffle_hash"), key).join(copies_of, key, "left").select(*key, "text", "copies", "anchors")
    pieces = materialize(pieces.mapInArrow(_piece_rows, "doc_id bigint, th bigint, start bigint, piece binary"), "pieces")
    drop(wanted)

    sampled = pieces.mapInArrow(_samples, _SAMPLE).repartition("head").sortWithinPartitions("head", *key, "at", "reach")
    later = sampled.mapInArrow(_later, "doc_id bigint, th bigint, span bigint").groupBy(*key).agg(F.collect_set("span").alias("later"))
    later = materialize(later, "later")
    drop(pieces)
    done = docs.join(copies_of, key, "left").join(later.hint("shuffle_hash"), key, "left").select("doc_id", "text", "copies", "later")
    return done.mapInArrow(_cut_rows, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")
