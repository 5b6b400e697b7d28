"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences is hashed (96 bits): from each sentence on, the fewest that
have ``WORDS`` words. A run that a document with a smaller id holds too is removed, whole sentences
as they stand; of a run that repeats within a document the first occurrence stays.

A sentence ends after a word that ends in ``.``, ``!`` or ``?``, or at a line break. Long sentences, and text without
marks, are cut further: in every ``PIECE`` words without such an end the word of least hash starts a new
sentence. Cuts thus follow from at most ``PIECE`` words around them, and so texts that share 50 words share a
whole run: the first cut that both have lies within 15 words of the passage's start, its run has at most
27 words, and cuts are the same up to 7 words before the passage's end. A text of fewer than
``WORDS`` words but ``FEWEST`` or more is one run. Words are compared with A-Z folded; white space between them does not count.

Runs meet in one shuffle by hash. Of a run that many rows of a block of some megabytes hold, one row goes there; the
others are known to be later already. So a run that a third of all documents hold costs one row per block.

A row is known by its doc_id and a 64-bit hash of its text. Rows equal in both are one document and are treated alike; of rows that
share a doc_id alone, that with the smaller hash counts as earlier. A row without an id keeps all but what repeats
within it and takes nothing from others. Null texts stay null, empty ones empty. Extra columns pass through ``clean_documents``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import bytewise
from .bytewise import Texts
from .common import materialize, sliced, unused

WORDS = 20
PIECE = 8
FEWEST = 3
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_U64 = np.uint64


class Runs(NamedTuple):
    """Sentences and runs of some texts.

    starts: where each sentence starts in the bytes; edges: each text's first sentence and the end of the last's.
    first, after, doc, h1, h2: of each run its sentences, its text and its hash.
    """

    starts: np.ndarray
    edges: np.ndarray
    first: np.ndarray
    after: np.ndarray
    doc: np.ndarray
    h1: np.ndarray
    h2: np.ndarray


def sentence_starts(t: Texts, w: bytewise.Words, h: np.ndarray) -> np.ndarray:
    """The words that start a sentence."""
    n = len(h)
    begins = np.zeros(n + 1, bool)
    begins[1:] = _STOP[t.data[w.ends - 1]]
    begins[np.searchsorted(w.starts, np.flatnonzero(t.data == 10))] = True
    begins[w.edges] = True
    value = np.where(begins[:n], _U64(0), h | _U64(1))
    if n >= PIECE:
        least = value
        for k in (1, 2, 4):  # eight words
            least = np.minimum(least[:-k], least[k:])
        pad = np.zeros(PIECE - 1, _U64)
        most = np.r_[pad, least, pad]
        for k in (1, 2, 4):
            most = np.maximum(most[:-k], most[k:])
        begins[:n] |= most == value
    return np.flatnonzero(begins[:n])


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[_U64(1), np.full(max(n, 1) - 1, base, _U64)])


def runs(t: Texts) -> Runs:
    """Each sentence's run, and of a text of fewer words the one of all."""
    w = bytewise.words(t)
    h = bytewise.hash_ranges(bytewise.fold(t.data), w.starts, w.ends)
    n = len(h)
    cut = sentence_starts(t, w, h)
    ends = np.r_[cut, n]
    stop = w.edges[np.searchsorted(w.edges, cut, side="right")]  # where the words of each sentence's text end
    begin = w.edges[np.searchsorted(w.edges, cut, side="right") - 1]
    whole = (begin == cut) & (stop - begin < WORDS) & (stop - begin >= FEWEST)
    after = np.searchsorted(ends, np.where(whole, stop, cut + WORDS))
    first = np.flatnonzero(whole | (cut + WORDS <= stop))
    after = after[first]
    a, b = cut[first], ends[after]
    hashes = []
    for base in _BASES:
        up, down = _powers(base, n), _powers(pow(base, -1, 1 << 64), n)
        total = np.r_[_U64(0), np.cumsum(h * up[:n])]
        hashes.append(bytewise.mix((total[b] - total[a]) * down[a] + (b - a).astype(_U64)) if len(a) else np.zeros(0, _U64))
    return Runs(w.starts[cut], np.searchsorted(cut, w.edges), first, after, np.searchsorted(w.edges, a, side="right") - 1, *hashes)


def _again(r: Runs) -> np.ndarray:
    """True for a run that stands before in its text, where the first such run has ended."""
    order = np.lexsort((r.first, r.h1, r.doc))
    doc, h = r.doc[order], r.h1[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])][: len(order)]
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    out = np.zeros(len(order), bool)
    out[order] = r.first[order] >= r.after[head]
    return out


_UNIT = "h1 bigint, h2 int, doc_id bigint, th bigint, kind byte"
SHARED, LATER, OWN = 0, 1, 2
BLOCK = 1 << 17


def _merged(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    """Runs of some rows as a batch. Of a run that several rows hold, the first goes to where other tasks' rows meet it; the others are known to be later and travel under a key of their own."""
    h1, h2, ids, th, null, own = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((th, ids, h2, h1, null | own))
    h1, h2, ids, th, null, own = (c[order] for c in (h1, h2, ids, th, null, own))
    new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])] | null | own
    first = np.maximum.accumulate(np.where(new, np.arange(len(h1)), 0))
    same = ~new & (ids == ids[first]) & (th == th[first])  # a repeated row of the table
    kind = np.where(own, OWN, np.where(new, SHARED, LATER)).astype(np.int8)
    keep = ~same & ~(null & ~own)
    cols = [h1.view(np.int64), h2, pa.array(ids, mask=null), th, kind]
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], names=["h1", "h2", "doc_id", "th", "kind"]).filter(pa.array(keep))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text) to the runs of each text, each once; a second row of kind ``OWN`` for those that repeat within it."""
    for b in batches:
        ids, th = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
        null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        parts, held = [], 0
        for t in bytewise.texts(b.column(2)):
            r = runs(t)
            if not len(r.h1):
                continue
            order = np.lexsort((r.h1, r.doc))
            doc, h = r.doc[order], r.h1[order]
            one = order[np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]]
            at = np.r_[one, np.flatnonzero(_again(r))]
            row = t.first + r.doc[at]
            parts.append([r.h1[at], (r.h2[at] >> _U64(32)).astype(np.uint32).view(np.int32), ids[row], th[row], null[row], np.arange(len(at)) >= len(one)])
            held += len(at)
            if held >= BLOCK:
                yield _merged(parts)
                parts, held = [], 0
        if parts:
            yield _merged(parts)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by hash and row, those whose first row is another one; and those known before."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, th, kind = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3, 4))
        ids = b.column(2).fill_null(0).to_numpy(zero_copy_only=False)
        new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        first = np.maximum.accumulate(np.where(new, np.arange(len(h1)), 0))
        lead_id, lead_th = ids[first], th[first]
        if last is not None and last[:2] == (h1[0], h2[0]):
            lead_id[first == 0], lead_th[first == 0] = last[2:]
        hit = (ids != lead_id) | (th != lead_th) | (kind != SHARED)
        last = h1[-1], h2[-1], lead_id[-1], lead_th[-1]
        yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), b.column(0), b.column(4)], names=["doc_id", "th", "h1", "kind"]).filter(pa.array(hit))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), found and own: first halves of the hashes of runs that an earlier document holds, or that repeat within."""
    units = _keyed(docs).mapInArrow(_units, _UNIT)
    # a key of their own for rows that need not meet others
    spread = F.when(F.col("kind") == SHARED, F.col("h1")).otherwise(F.xxhash64("doc_id", "th", "h1"))
    met = units.repartition(spread).sortWithinPartitions("h1", "h2", "kind", "doc_id", "th")
    hits = met.mapInArrow(_later, "doc_id bigint, th bigint, h1 bigint, kind byte")
    own = F.col("kind") == OWN
    sets = [F.collect_set(F.when(o, F.col("h1"))).alias(n) for o, n in ((~own, "found"), (own, "own"))]
    return materialize(hits.groupBy("doc_id", "th").agg(*sets), "repeats")


def strip(t: Texts, found: list[np.ndarray], own: list[np.ndarray]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Of each text what is left, its sentences, and those removed.

    found: hashes (uint64) of the runs that go wherever they stand; own: of those whose first occurrence stays.
    """
    r = runs(t)
    edges = np.searchsorted(r.doc, np.arange(len(found) + 1))
    again, gone = _again(r), np.zeros(len(r.h1), bool)
    for k, (f, o) in enumerate(zip(found, own)):
        x = slice(edges[k], edges[k + 1])
        gone[x] = np.isin(r.h1[x], f) | (np.isin(r.h1[x], o) & again[x])
    cover = np.zeros(len(r.starts) + 1, np.int64)
    np.add.at(cover, r.first[gone], 1)
    np.subtract.at(cover, r.after[gone], 1)
    cover = np.cumsum(cover[:-1]) > 0
    kept, removed = [], np.add.reduceat(np.r_[cover, False], np.minimum(r.edges[:-1], len(cover))) if len(r.edges) > 1 else r.edges[:0]
    removed = np.where(np.diff(r.edges) > 0, removed, 0)
    raw = t.data.tobytes()
    for k, n in enumerate(removed):
        a, b, lo, hi = t.edges[k], t.edges[k + 1], r.edges[k], r.edges[k + 1]
        if not n:
            kept.append(raw[a:b])
            continue
        at = np.r_[a, r.starts[lo:hi], b].tolist()
        keep = [True, *(~cover[lo:hi]).tolist()]
        kept.append(b"".join(raw[x:y] for x, y, stays in zip(at, at[1:], keep) if stays))
    return kept, np.diff(r.edges), removed


def _hashes(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x.values if x.is_valid else [], np.int64).view(np.uint64) for x in column]


def _strip_batches(names: tuple[str, str, str], results: tuple[str, str]):
    """Rows with text, found and own (by their names, the last columns) to the rows with what is left and the number of sentences that went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1024):
            text, found, own = (b.column(b.schema.get_field_index(n)) for n in names)
            hit = np.flatnonzero((found.is_valid()).to_numpy(zero_copy_only=False))
            gone = np.zeros(b.num_rows, np.int64)
            if len(hit):
                part, f, o = text.take(pa.array(hit)), _hashes(found.take(pa.array(hit))), _hashes(own.take(pa.array(hit)))
                kept, removed = [], []
                for t in bytewise.texts(part):
                    out, _, n = strip(t, f[t.first : t.after], o[t.first : t.after])
                    kept += out
                    removed.append(n)
                gone[hit] = np.concatenate(removed)
                touched = np.flatnonzero(gone > 0)
                mine = dict(zip(hit.tolist(), kept))
                at = np.arange(b.num_rows)
                at[touched] = b.num_rows + np.arange(len(touched))
                left = pa.array([mine[k].decode("utf-8", "surrogatepass") for k in touched.tolist()], text.type)
                text = pa.concat_arrays([text, left]).take(pa.array(at))
            cut = [k for k in range(b.num_columns) if b.schema.names[k] not in names]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in cut), text, pa.array(gone)], names=[*(b.schema.names[k] for k in cut), *results])

    return run


def _stripped(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, str, str]:
    """``columns`` of docs with what is left of the text and the number of sentences that went, and the names of these two."""
    key, th, text, found, own, left, gone = unused(docs.columns, "key", "th", "text", "found", "own", "left", "gone")
    hits = repeated_spans(docs).select(F.col("doc_id").alias(key + "_"), F.col("th").alias(th + "_"), F.col("found").alias(found), F.col("own").alias(own))
    said = F.col("text").cast("string")
    rows = docs.select(*columns, F.col("doc_id").cast("bigint").alias(key), F.xxhash64(said).alias(th), said.alias(text))
    joined = rows.join(hits.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col(key + "_")) & (F.col(th) == F.col(th + "_")), "left").select(*columns, text, found, own)
    schema = joined.drop(text, found, own).schema.add(left, T.StringType()).add(gone, T.LongType())
    return joined.mapInArrow(_strip_batches((text, found, own), (left, gone)), schema), left, gone


def remove_repeated_spans(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_removed (sentences), text (what is left)."""
    done, left, gone = _stripped(docs.select("doc_id", "text"), ["doc_id"])
    return done.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(gone).alias("n_removed"), F.col(left).alias("text"))


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents with repeated spans taken out of text; those of which nothing is left go."""
    done, left, gone = _stripped(docs, [c for c in docs.columns if c != "text"])
    done = done.where((F.col(gone) == 0) | F.col(left).rlike(r"[^\x20\x09-\x0D]"))
    counted = F.when(F.col(gone) > 0, F.length(left))
    kept = {"text": F.col(left).alias("text")}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.coalesce(counted.cast(docs.schema["n_chars"].dataType), F.col("n_chars")).alias("n_chars")
    return done.select(*(kept.get(c, F.col(c)) for c in docs.columns))
