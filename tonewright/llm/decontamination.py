"""Benchmark decontamination by a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of a benchmark item (all words of a shorter item); it is the set of its shingles of
``SHINGLE`` words (one shingle if it has fewer words). A document holds a window only if it holds every shingle
of it, so a prefix of one shingle is enough to find it, and the rarest one costs the least:

1. shingles of the windows are counted in all documents; of each window the rarest is its prefix, and a window
   with a shingle that no document holds is out;
2. documents give the places of prefix shingles, each with the words that a window around it may cover;
3. place and prefix meet by join. Positional bound: the window starts as many words before the place as the shingle
   stands inside it, so not before the document does. Length bound: it ends no later than the document;
4. what passes is compared word by word. Shingles meet by 64-bit hash, so no pair is lost and none is taken on a hash alone.

Words are runs of 0-9, letters with A-Z folded, and all beyond ASCII. Null and empty texts have no words; an item without
words has no window. A row is known by its doc_id and a 64-bit hash of its text; repeated rows get the same result, rows that share an id
alone their own. An item without an id counts under the empty string, items that share an id are one. Extra columns are ignored.

At scale: two passes over the texts. A filter of bits (at most 2^``MOST_BITS``, 32 MB, whatever the benchmark) leaves of the documents' shingles
those that windows may hold; what passes wrongly finds no partner. Counts are added up in the tasks first. Joins broadcast the side of the benchmark only where
its counted size is below ``SMALL`` rows; else they shuffle, and Spark splits partitions of frequent shingles. What is gathered per document is
bounded by its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bytewise
from .bytewise import Texts
from .common import drop, materialize
from .importance import alphanumeric

WINDOW = 10
SHINGLE = 5
SMALL = 100_000
LEAST_BITS, MOST_BITS, CHUNK_BITS = 20, 28, 20
#: Distinct shingles that a counting task holds before it sends them on.
HELD = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Stands for a word of a document that is longer than all words of the benchmark.
_NO_WORD = b"!"


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """From the hashes of consecutive words those of all runs of n, wherever texts end."""
    if len(h) < n:
        return h[:0]
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total = total * _ODD + h[k : len(h) - n + 1 + k]
    return bytewise.mix(total)


def _words(t: Texts) -> tuple[Texts, bytewise.Words, np.ndarray]:
    t = alphanumeric(t)
    w = bytewise.words(t)
    return t, w, bytewise.hash_ranges(t.data, w.starts, w.ends)


def _item_windows(window: int, shingle: int):
    """(id, text) of items to their windows: item, words of the window, their number, hashes of its shingles in order, its longest word in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for t in bytewise.texts(b.column(1)):
                t, w, h = _words(t)
                words = [t.data[a:z].tobytes() for a, z in zip(w.starts, w.ends)]
                rows = []
                for k, (a, z) in enumerate(zip(w.edges, w.edges[1:])):
                    n = min(window, z - a)
                    for at in range(a, z - n + 1 if n else a):
                        m = min(shingle, n)
                        said = words[at : at + n]
                        rows.append((ids[t.first + k], b" ".join(said).decode(), n, shingle_hashes(h[at : at + n], m).view(np.int64).tolist(), max(map(len, said))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.int32()))], names=["item", "window", "n", "tokens", "longest"])

    return run


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The windows of all items, written: item, window, n, tokens, longest."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(_item_windows(window, shingle), "item string, window string, n int, tokens array<bigint>, longest int").distinct(), "windows")


def bit_filter(tokens: DataFrame) -> np.ndarray:
    """Bits (as bytes) set for the distinct values of the column ``token``: sixteen a token, as far as ``MOST_BITS`` allow. Each piece is made in a task of its own."""
    n = tokens.count()
    bits = min(max(LEAST_BITS, (16 * n).bit_length()), MOST_BITS)

    def piece(table: pa.Table) -> pa.Table:
        on = np.zeros(1 << CHUNK_BITS, bool)
        on[table.column("place").to_numpy() & ((1 << CHUNK_BITS) - 1)] = True
        return pa.table({"piece": table.column("piece")[:1], "bits": pa.array([np.packbits(on).tobytes()], pa.binary())})

    place = F.shiftrightunsigned("token", 64 - bits)
    made = tokens.select(place.alias("place")).distinct().withColumn("piece", F.shiftright("place", CHUNK_BITS).cast("int"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in made.groupBy("piece").applyInArrow(piece, "piece int, bits binary").collect():  # 32 MB at most
        out[r.piece << CHUNK_BITS - 3 :][: 1 << CHUNK_BITS - 3] = np.frombuffer(r.bits, np.uint8)
    return out


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _found(t: Texts, bits: np.ndarray, lengths: list[int]):
    """The words of some texts, and of each length of shingle the first words and hashes of those that pass the filter inside one text."""
    t, w, h = _words(t)
    after = np.repeat(w.edges[1:], np.diff(w.edges))  # where the text of each word ends
    out = []
    for n in lengths:
        g = shingle_hashes(h, n)
        at = np.flatnonzero(_passes(bits, g))
        at = at[at + n <= after[at]]
        out.append((n, at, g[at]))
    return t, w, out


def _counts(bits: np.ndarray, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["token", "n"])

        for b in batches:
            for t in bytewise.texts(b.column(0)):
                for _, _, g in _found(t, bits, lengths)[2]:
                    for k, n in zip(*(x.tolist() for x in np.unique(g.view(np.int64), return_counts=True))):
                        held[k] = held.get(k, 0) + n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return run


_PLACES = "doc_id bigint, th bigint, n_words int, token bigint, before int, around string, places array<int>"


def _places(bits: np.ndarray, lengths: list[int], window: int, shingle: int, longest: int):
    """(doc_id, th, text) to one row per document with n_words, and one per prefix shingle and words around it with the places where it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, th = b.column(0), b.column(1)
            for t in bytewise.texts(b.column(2)):
                t, w, found = _found(t, bits, lengths)
                rows: dict[tuple, list[int]] = {}
                for n, at, g in found:
                    doc = np.searchsorted(w.edges, at, side="right") - 1
                    more = window - n if n == shingle else 0  # a shorter shingle is all of its window
                    lo, hi = np.maximum(at - more, w.edges[doc]), np.minimum(at + n + more, w.edges[doc + 1])
                    for k, d, a, x, y in zip(g.view(np.int64).tolist(), doc.tolist(), at.tolist(), lo.tolist(), hi.tolist()):
                        around = b" ".join(t.data[p:q].tobytes() if q - p <= longest else _NO_WORD for p, q in zip(w.starts[x:y], w.ends[x:y]))
                        rows.setdefault((d, k, a - x, around), []).append(a - w.edges[d])
                n_docs, n_words = t.after - t.first, np.diff(w.edges)
                row = np.r_[np.arange(n_docs), np.fromiter((d for d, *_ in rows), np.int64, len(rows))]
                pick, none = pa.array(t.first + row), [None] * n_docs
                cols = [ids.take(pick), th.take(pick), pa.array(n_words[row], pa.int32())]
                cols += [pa.array(none + [r[1] for r in rows], pa.int64()), pa.array(none + [r[2] for r in rows], pa.int32()), pa.array(none + [r[3].decode() for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(none + list(rows.values()), pa.list_(pa.int32()))], names=["doc_id", "th", "n_words", "token", "before", "around", "places"])

    return run


def _covered(spans):
    """Words under spans (start, n) that are sorted by start."""
    step = lambda s, x: F.struct(F.greatest(s["end"], x["start"] + x["n"]).alias("end"), (s["total"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(s["end"], x["start"]))).alias("total"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")), step, lambda s: s["total"].cast("bigint"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, small: int = SMALL) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside a window of the benchmark), spans (start, n; in words), items (ids as sorted strings)."""
    shingle = min(shingle, window)
    windows = item_windows(items, window, shingle)
    shape = windows.groupBy(F.least(F.col("n"), F.lit(shingle)).alias("n")).agg(F.max("longest").alias("longest")).collect()  # a row for each length of shingle, ``shingle`` at most
    lengths, longest = sorted(r.n for r in shape), max((r.longest for r in shape), default=0)
    fits = lambda df: F.broadcast(df) if df.count() <= small else df

    # windows with the same items are one class, named by the least window
    held = windows.groupBy("window").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.array_sort(F.collect_set("item")).alias("items"))
    held = materialize(held, "held")
    classes = materialize(held.groupBy("items").agg(F.min("window").alias("class")), "classes")
    named = held.join(fits(classes), "items").select("window", "n", "tokens", "class")

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    bits = bit_filter(held.select(F.explode("tokens").alias("token")).distinct())
    rarity = texts.select("text").mapInArrow(_counts(bits, lengths), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("seen"))
    tokens = named.select("window", "n", "class", F.posexplode("tokens").alias("at", "token")).join(rarity, "token", "left")
    rarest = F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token", "at")).alias("r")
    prefix = tokens.groupBy("window").agg(rarest, F.first("n").alias("n"), F.first("class").alias("class")).where("r.seen > 0")
    prefix = materialize(prefix.select(F.col("r.token").alias("token"), F.col("r.at").alias("at"), "n", "window", "class"), "prefix")

    bits = bit_filter(prefix.select("token").distinct())
    seen = materialize(texts.mapInArrow(_places(bits, lengths, window, shingle, longest), _PLACES), "places")
    base = seen.where(F.col("token").isNull()).select("doc_id", "th", F.col("n_words").cast("bigint").alias("n_words"))
    pairs = seen.where(F.col("token").isNotNull()).join(fits(prefix), "token").where(F.col("before") >= F.col("at"))
    around = F.slice(F.split("around", " "), F.col("before") - F.col("at") + 1, F.col("n"))
    same = pairs.where(F.array_join(around, " ") == F.col("window"))
    spans = F.transform("places", lambda p: F.struct((p - F.col("at")).alias("start"), F.col("n").alias("n")))
    hits = same.groupBy("doc_id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(spans)))).alias("spans"), F.collect_set("class").alias("classes"))
    hits = materialize(hits, "hits")
    listed = hits.select("doc_id", "th", F.explode("classes").alias("class")).join(fits(classes), "class")
    listed = listed.groupBy("doc_id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({"doc_id": "id", "th": "h"}).hint("shuffle_hash")
        return left.join(right, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h")), "left").drop("id", "h")

    whole = joined(base, joined(hits.select("doc_id", "th", "spans"), listed))
    empty = F.array().cast("array<struct<start: int, n: int>>")
    out = whole.select("doc_id", "n_words", F.coalesce("spans", empty).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    drop(windows)
    return out.select("doc_id", "n_words", _covered(F.col("spans")).alias("n_hit"), "spans", "items")


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
runs AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, runs.n, item_id FROM runs JOIN windows USING (x)),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
