"""SimHash near-duplicates by vantage-point trees.

Fingerprints (64 bits) link when at most ``RADIUS`` bits differ. In the whole
64-bit space a vantage-point tree prunes nearly nothing at that radius (distances of
unlike texts stand at 32 with a deviation of 4, so a query enters 1.7 of 2
branches at each level). The trees here therefore stand over four 16-bit blocks:
of two linked fingerprints at least one block differs in at most RADIUS // 4
bits, so each block has its own tree with that search radius and the triangle
bound prunes well.

1. The distinct fingerprints of the corpus are found first; copies are never compared.
2. A bounded sample gives each block's upper tree. Every fingerprint goes to its
   home shard and, by the triangle bound, to each shard its ball overlaps.
3. Each shard is searched with deeper vantage points down to small leaves, where
   pairs are compared exactly over all 64 bits. Where a block cannot tell
   fingerprints apart, the search goes on in the whole space.
4. A shard reports a spanning set of its links; components are found on the distributed links.

Null and empty texts have fingerprint zero and are linked like any other.
Repeated rows share their component. Rows without an id are linked too, but lend no component their id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import drop, materialize, unused
from .components import connected_components

SHINGLE = 4
SEED = 42
RADIUS = 4
BLOCKS = 4
SHARD_ROWS = 16_384
MOST_SHARDS = 1 << 16  # a block has no more values
SAMPLE = 65_536
LEAF_PAIRS = 1 << 18
WHOLE = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the lower-cased word shingles, as a signed 64-bit number; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    one = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        h = np.array([one(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.r_[0, ends[:-1] + 1]
        h = np.array([one(joined[a:b], SEED) for a, b in zip(begins[: -shingle + 1].tolist(), ends[shingle - 1 :].tolist())], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, ...) to (doc_id, fp, ...)."""
    for b in batches:
        prints = pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), prints, *b.columns[2:]], names=["doc_id", "fp", *b.schema.names[2:]])


def distance(a: np.ndarray, b, mask: np.uint64 = WHOLE) -> np.ndarray:
    return np.bitwise_count((a ^ b) & mask).astype(np.int16)


def block_masks(blocks: int = BLOCKS) -> list[np.uint64]:
    width = 64 // blocks
    return [np.uint64(((1 << width) - 1) << (width * k)) for k in range(blocks)]


def _split(points: np.ndarray, mask: np.uint64, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that divide the points best, of a few tried; None if none divides them."""
    best = None
    for vantage in points[rng.integers(0, len(points), 4)]:
        d = np.sort(distance(points, vantage, mask))
        cut = int(d[(len(d) - 1) // 2])
        for c in (cut, cut - 1):
            inside = int(np.searchsorted(d, c, side="right"))
            if 0 < inside < len(d) and (best is None or abs(2 * inside - len(d)) < best[0]):
                best = abs(2 * inside - len(d)), vantage, c
    return best and best[1:]


def build_tree(points: np.ndarray, mask: np.uint64, leaves: int, rng: np.random.Generator, first: int = 0):
    """Nested (vantage, radius, inside, outside); a leaf is its number. Returns the tree and the next free number."""
    cut = _split(points, mask, rng) if leaves > 1 and len(points) > 1 else None
    if cut is None:
        return first, first + 1
    inside = distance(points, cut[0], mask) <= cut[1]
    left, n = build_tree(points[inside], mask, leaves // 2, rng, first)
    right, n = build_tree(points[~inside], mask, leaves - leaves // 2, rng, n)
    return (*cut, left, right), n


def route(fps: np.ndarray, tree, mask: np.uint64, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, positions at home, positions that only overlap it) for every leaf that is reached."""

    def walk(node, home, visit):
        if not isinstance(node, tuple):
            if len(home) or len(visit):
                yield node, home, visit
            return
        vantage, cut, left, right = node
        dh, dv = distance(fps[home], vantage, mask), distance(fps[visit], vantage, mask)
        inside = dh <= cut
        yield from walk(left, home[inside], np.r_[home[~inside & (dh <= cut + radius)], visit[dv <= cut + radius]])
        yield from walk(right, home[~inside], np.r_[home[inside & (dh > cut - radius)], visit[dv > cut - radius]])

    yield from walk(tree, np.arange(len(fps)), np.zeros(0, np.int64))


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of links a-b as stars: each node with the least position of its component."""
    nodes, inv = np.unique(np.r_[a, b], return_inverse=True)
    u, v = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def search(fps: np.ndarray, home: np.ndarray, visit: np.ndarray, mask: np.uint64, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (positions) of the links between home points and all points of a shard."""
    rng = np.random.default_rng(len(home))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def compare(p, q):
        nonlocal held
        step = max(1, LEAF_PAIRS // max(len(p), 1))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            near = distance(fps[p][:, None], fps[part][None, :]) <= RADIUS
            i, j = np.nonzero(near)
            if not len(i):
                continue
            first = near.argmax(axis=0)
            lead = first[j]  # the first point that a query links to stands for all its points
            links = np.unique(np.r_[part[np.unique(j)] << 32 | p[first[np.unique(j)]], p[i] << 32 | p[lead]])
            a, b = links >> 32, links & 0xFFFFFFFF
            a, b = a[a != b], b[a != b]
            if len(a):
                found.append((a, b))
                held += len(a)
        if held > 1 << 20:
            shrink()

    def shrink():
        nonlocal held
        a, b = spanning(*(np.concatenate(x) for x in zip(*found)))
        found[:] = [(a, b)]
        held = 0

    stack = [(home, np.r_[home, visit], mask, radius)]
    while stack:
        p, q, m, r = stack.pop()
        if not len(p) or not len(q):
            continue
        cut = _split(fps[p], m, rng) if len(p) * len(q) > LEAF_PAIRS else None
        if cut is None and m != WHOLE and len(p) * len(q) > LEAF_PAIRS:
            stack.append((p, q, WHOLE, RADIUS))
            continue
        if cut is None:
            compare(p, q)
            continue
        dp, dq = distance(fps[p], cut[0], m), distance(fps[q], cut[0], m)
        left, right = q[dq <= cut[1] + r], q[dq > cut[1] - r]
        if len(left) + len(right) > 1.9 * len(q):  # the bound prunes nothing here
            if m != WHOLE:
                stack.append((p, q, WHOLE, RADIUS))
            else:
                compare(p, q)
            continue
        stack += [(p[dp <= cut[1]], left, m, r), (p[dp > cut[1]], right, m, r)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shrink()
    return found[0]


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that span every component within RADIUS bits."""
    n = distinct.count()
    leaves = int(min(MOST_SHARDS, max(1, -(-n // SHARD_ROWS))))
    part = min(1.0, 1.2 * SAMPLE / max(n, 1))
    picked = distinct.where(F.abs(F.xxhash64("fp", F.lit(5)) % 1_000_000) < int(part * 1_000_000) + 1).orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()
    sample = np.array([r["fp"] for r in picked], dtype=np.int64).view(np.uint64)
    rng = np.random.default_rng(3)
    masks, radius = block_masks(), RADIUS // BLOCKS
    trees = distinct.sparkSession.sparkContext.broadcast([build_tree(sample, m, leaves, rng)[0] for m in masks])  # at most as many nodes as the sample has points

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signed = b.column(0).to_numpy(zero_copy_only=False)
            fps = signed.view(np.uint64)
            for t, (tree, mask) in enumerate(zip(trees.value, masks)):
                for leaf, home, visit in route(fps, tree, mask, radius):
                    where = np.r_[home, visit]
                    cols = [np.full(len(where), t * MOST_SHARDS + leaf), np.arange(len(where)) < len(home), signed[where]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["shard", "home", "fp"])

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["home", "fp"], kind="stable")
        fps = rows["fp"].to_numpy(np.int64)
        own = rows["home"].to_numpy(bool)
        a, b = search(fps.view(np.uint64), np.flatnonzero(own), np.flatnonzero(~own), masks[int(rows["shard"].iloc[0]) // MOST_SHARDS], radius)
        return pd.DataFrame({"a": fps[a], "b": fps[b]})

    dealt = distinct.select("fp").mapInArrow(deal, "shard bigint, home boolean, fp bigint")
    return dealt.groupBy("shard").applyInPandas(link, "a bigint, b bigint").where("a <> b")


def _classes(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with doc_id and fp to (fp, root, least), root being one number per component and least a fingerprint's smallest doc_id; and the components' (root, component_id)."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = connected_components(link_fingerprints(distinct))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    drop(distinct, roots)
    return rooted, rooted.groupBy("root").agg(F.min("least").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp (signed), component_id (smallest doc_id reachable)."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    prints = materialize(rows.mapInArrow(_fingerprints, "doc_id bigint, fp bigint"), "fp")
    rooted, lowest = _classes(prints)
    return prints.join(rooted.join(lowest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest doc_id (rows without an id last), of rows that share it that with the smallest hash of the text.

    Of rows equal in id and text that with the least hash of all its columns stays. Only ids and hashes travel to find out what
    goes; texts are moved at most once, and not at all where Spark finds the keys few enough to broadcast.
    """
    doc_id, said = F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    rows = docs.select(doc_id.alias("doc_id"), said.alias("text"), F.xxhash64(said).alias("th"))
    prints = materialize(rows.mapInArrow(_fingerprints, "doc_id bigint, fp bigint, th bigint"), "fp")
    rooted, lowest = _classes(prints)
    keys = prints.groupBy("doc_id", "th", "fp").agg(F.count(F.lit(1)).alias("n")).join(rooted.select("fp", "root"), "fp").join(lowest, "root")
    keys = materialize(keys.select("root", "doc_id", "th", "n", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("least")), "keys")
    heads = keys.where("least").groupBy("root").agg(F.min("th").alias("head"))
    g, th, first, many = unused(docs.columns, "g", "th", "first", "many")
    told = keys.join(heads, "root").select(F.col("doc_id").alias(g), F.col("th").alias(th), (F.col("least") & (F.col("th") == F.col("head"))).alias(first), (F.col("n") > 1).alias(many))
    told = materialize(told.where(~F.col(first) | F.col(many)), "told")
    drop(prints, rooted, keys)
    same = doc_id.eqNullSafe(F.col(g)) & (F.xxhash64(said) == F.col(th))
    kept = docs.join(told, same, "left_anti")
    several = told.where(first)
    if several.isEmpty():
        return kept
    plain = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    one = docs.join(several, same, "left_semi").groupBy(doc_id.alias(g), F.xxhash64(said).alias(th))
    return kept.unionByName(one.agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias(first)).select(f"{first}.*"))
