"""Source divergence audit with mergeable radix tries.

Every task counts the terms of its documents in a byte trie per language, whose leaves have a counter per source and the number of documents.
A trie leaves its task in pre-order, which is the order of the terms' UTF-8 bytes, one leaf a row. Leaves are dealt by ranges of
(language, term), so ranges of prefixes, and each range merges what all tries have of it. A second traversal of the merged
tries gives every source the divergence from each other source of its language, and the terms that it uses more than its language does.

Terms are runs of letters with A-Z folded and all beyond ASCII. Null text, lang and source are ''. A row is a document, with or
without an id, repeated or not. Languages keep the terms that ``least_docs`` of their documents hold; a language without such terms has pairs of value 0.
Ties go to the smaller item by UTF-8 bytes. An empty table gives an empty result. Extra columns are ignored.

All arithmetic is on whole numbers: p = 1 + floor(SCALE (count + 1) / (N + V)) by long division, three decimal digits at a time.

At scale: one pass over the texts; a task's trie is sent on and begun anew at ``LEAVES`` leaves. A term that every document holds costs a row
per task. The list of (lang, source) groups is read by the driver and goes with the tasks: the result has their square within a language, so it is
always by far the smaller. A traversing task holds one table of sources by sources for each language that its range touches, and ``top`` terms a source.
"""

from __future__ import annotations

import gc
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from . import bytewise
from .common import materialize

LEAVES = 320_000
SCALE = 1_000_000_000
#: Bytes of texts whose terms are counted before they enter the trie, and merged terms that are judged at a time.
PIECE, ROWS = 1 << 23, 2048
STRIDE = 3
#: Bytes that stand in no term become spaces, A-Z small letters.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Trie:
    """A radix trie over bytes. A node is [label, children by first byte or None, counters or None]; a term's node, which may be an inner one, has counters.

    Counters are one flat list: documents, then pairs of a source's number and its count. The first ``STRIDE`` bytes are one step.
    """

    __slots__ = ("tops", "leaves")

    def __init__(self):
        self.tops, self.leaves = {}, 0

    def add(self, term: bytes, counts: list[int]) -> None:
        """Add to a term's counters; the list is the trie's own from then on."""
        top = term[:STRIDE]
        node, at, end = self.tops.get(top), len(top), len(term)
        if node is None:
            node = self.tops[top] = [top, None, None]
        while at < end:
            kids = node[1]
            if kids is None:
                node[1] = {term[at]: [term[at:], None, counts]}
                self.leaves += 1
                return
            kid = kids.get(term[at])
            if kid is None:
                kids[term[at]] = [term[at:], None, counts]
                self.leaves += 1
                return
            label = kid[0]
            if not term.startswith(label, at):
                same, most = 1, min(len(label), end - at)
                while same < most and label[same] == term[at + same]:
                    same += 1
                fork = kids[term[at]] = [label[:same], {label[same]: kid}, None]
                kid[0] = label[same:]
                kid = fork
                label = kid[0]
            node, at = kid, at + len(label)
        held = node[2]
        if held is None:
            node[2] = counts
            self.leaves += 1
            return
        held[0] += counts[0]
        for k in range(1, len(counts), 2):
            for j in range(1, len(held), 2):
                if held[j] == counts[k]:
                    held[j + 1] += counts[k + 1]
                    break
            else:
                held += counts[k : k + 2]

    def merge(self, other: Trie) -> None:
        """Add all that another trie has."""
        for term, counts in other.walk():
            self.add(term, counts)

    def walk(self) -> Iterator[tuple[bytes, list[int]]]:
        """Terms and counters in the order of bytes."""
        stack = [(b"", self.tops[top]) for top in sorted(self.tops, reverse=True)]
        while stack:
            before, (label, kids, counts) = stack.pop()
            term = before + label
            if counts is not None:
                yield term, counts
            if kids is not None:
                if len(kids) == 1:
                    stack.append((term, *kids.values()))
                else:
                    stack += [(term, kids[b]) for b in sorted(kids, reverse=True)]


_LEAF = "lang int, term binary, docs bigint, groups array<int>, counts array<bigint>"


def _leaves(lang: int, terms: list[bytes], counts: list[list[int]]) -> pa.RecordBatch:
    edges = np.cumsum([0, *(len(c) // 2 for c in counts)])
    flat = np.fromiter(chain.from_iterable(counts), np.int64)
    heads = edges[:-1] * 2 + np.arange(len(counts))
    pairs = np.delete(flat, heads)
    lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(pairs[k::2], kind)) for k, kind in ((0, pa.int32()), (1, pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), lang, np.int32)), pa.array(terms, pa.binary()), pa.array(flat[heads]), *lists], names=["lang", "term", "docs", "groups", "counts"])


def _walked(tries: dict[int, Trie]) -> Iterator[pa.RecordBatch]:
    for lang in sorted(tries):
        leaves = tries[lang].walk()
        while part := list(islice(leaves, 20_000)):
            yield _leaves(lang, *zip(*part))


def _tries(groups: dict[tuple[str, str], tuple[int, int]], most: int):
    """(lang, source, text) to the leaves of tries; groups: number of language and of group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nodes are in no cycles, and there are many
        tries = defaultdict(Trie)
        for b in batches:
            known = [groups[k] for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            for t in bytewise.texts(b.column(2), PIECE):
                data, of = t.data.tobytes(), defaultdict(lambda: defaultdict(list))
                for (lang, group), a, z in zip(known[t.first : t.after], t.edges.tolist(), t.edges[1:].tolist()):
                    of[lang][group].append(data[a:z].translate(_LETTERS).split())
                for lang, by in of.items():
                    docs = Counter(chain.from_iterable(map(set, chain.from_iterable(by.values()))))
                    merged = {term: [n] for term, n in docs.items()}
                    for group, texts in by.items():
                        for term, n in Counter(chain.from_iterable(texts)).items():
                            merged[term] += group, n
                    add = tries[lang].add
                    for term, counts in merged.items():
                        add(term, counts)
                if sum(t.leaves for t in tries.values()) >= most:
                    yield from _walked(tries)
                    tries = defaultdict(Trie)
        yield from _walked(tries)
        gc.enable()

    return run


def _summed(b: pa.RecordBatch, n_groups: int) -> pa.RecordBatch:
    """Sorted leaves with those of one term as one."""
    lang, term = b.column(0).to_numpy(), b.column(1)
    new = np.r_[True, (lang[1:] != lang[:-1]) | pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)]
    run, first = np.cumsum(new) - 1, np.flatnonzero(new)
    sizes = np.diff(np.asarray(b.column(3).offsets))
    cell = np.repeat(run, sizes) * n_groups + b.column(3).flatten().to_numpy()
    order = np.argsort(cell, kind="stable")
    cell, counts = cell[order], b.column(4).flatten().to_numpy()[order]
    head = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][: len(cell)])
    edges = pa.array(np.searchsorted(cell[head], np.arange(len(first) + 1) * n_groups), pa.int32())
    lists = [pa.ListArray.from_arrays(edges, x) for x in (pa.array(cell[head] % n_groups, pa.int32()), pa.array(np.add.reduceat(counts, head) if len(head) else counts, pa.int64()))]
    pick = pa.array(first)
    return pa.RecordBatch.from_arrays([b.column(0).take(pick), term.take(pick), pa.array(np.add.reduceat(b.column(2).to_numpy(), first), pa.int64()), *lists], names=b.schema.names)


def _merge(n_groups: int, least_docs: int):
    """Leaves in order to the merged leaves that enough documents hold. What may go on in the next batch waits, summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait = None
        for b in batches:
            if not b.num_rows:
                continue
            if wait is not None:
                b = pa.Table.from_batches([wait, b.cast(wait.schema)]).combine_chunks().to_batches()[0]
            b = _summed(b, n_groups)
            wait = b.slice(b.num_rows - 1)
            b = b.slice(0, b.num_rows - 1)
            yield b.filter(pc.greater_equal(b.column(2), least_docs))
        if wait is not None:
            yield wait.filter(pc.greater_equal(wait.column(2), least_docs))

    return run


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (count + 1) / whole), exactly, for counts below whole."""
    rest, out = count + 1, np.zeros(np.broadcast(count, whole).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class _Best:
    """The highest values of a group, ties to the smaller term."""

    def __init__(self, top: int):
        self.top, self.rows, self.least = top, [], -1

    def offer(self, values: np.ndarray, terms: list[bytes]) -> None:
        self.rows = sorted([*self.rows, *((-v, t) for v, t in zip(values.tolist(), terms))])[: self.top]
        if len(self.rows) == self.top:
            self.least = -self.rows[-1][0]


_FOUND = "g int, item binary, value bigint, sums array<bigint>"


def _judge(members: dict[int, list[int]], totals: dict[int, list[int]], kept: dict[int, int], top: int):
    """Merged leaves to each group's sums over them against all groups of its language, and its highest terms.

    members: the groups of a language, in order; totals: their counts in all; kept: terms of a language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        best = defaultdict(lambda: _Best(top))
        for whole in batches:
            for b in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
                langs = b.column(0).to_numpy()
                for lang in np.unique(langs).tolist():
                    part = b.filter(pa.array(langs == lang))
                    mine = np.array(members[lang])
                    n, v = np.array(totals[lang]), kept[lang]
                    count = np.zeros((part.num_rows, len(mine)), np.int64)
                    row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(part.column(3).offsets)))
                    count[row, np.searchsorted(mine, part.column(3).flatten().to_numpy())] = part.column(4).flatten().to_numpy()
                    p, q = shares(count, n + v), shares(count.sum(axis=1), n.sum() + v)
                    total = sums.setdefault(lang, np.zeros((len(mine), len(mine)), np.int64))
                    for i in range(len(mine)):
                        total[i] += divergence(p[:, i : i + 1], p).sum(axis=0)
                        value = divergence(p[:, i], q)
                        held = best[int(mine[i])]
                        at = np.flatnonzero((count[:, i] > 0) & (p[:, i] > q) & (value >= held.least))
                        if len(at) > top:  # the rest of the terms cannot be among the first
                            at = at[value[at] >= np.partition(value[at], -top)[-top]]
                        if len(at):
                            held.offer(value[at], part.column(1).take(pa.array(at)).to_pylist())
        for lang, total in sums.items():
            g = len(total)
            yield _rows(members[lang], [None] * g, [None] * g, total.tolist())
        for g, x in best.items():
            if x.rows:
                yield _rows([g] * len(x.rows), [t for _, t in x.rows], [-v for v, _ in x.rows], [None] * len(x.rows))

    def _rows(g, items, values, totals) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((g, items, values, totals), kinds)], names=["g", "item", "value", "sums"])

    return run


def _added(table: pa.Table) -> pa.Table:
    """The element-wise sum of a group's lists: a row for each task."""
    rows = table.column("sums").combine_chunks()
    total = rows.flatten().to_numpy().reshape(len(rows), -1).sum(axis=0)
    return pa.table({"g": table.column("g")[:1], "sums": pa.array([total], pa.list_(pa.int64()))})


def merged_tries(docs: DataFrame, numbers: dict[tuple[str, str], tuple[int, int]], least_docs: int = 3, most: int = LEAVES) -> DataFrame:
    """The kept leaves of all documents' tries in ranges of (lang, term): lang, term, docs, groups, counts; languages and groups by their numbers."""
    leaves = materialize(docs.select("lang", "source", "text").mapInArrow(_tries(numbers, most), _LEAF), "leaves")
    dealt = leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return materialize(dealt.mapInArrow(_merge(len(numbers), least_docs), _LEAF), "trie")


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200, leaves: int = LEAVES) -> DataFrame:
    """lang, source, part, item, value, rank: of every (lang, source) all other sources of the language (part pair) and its ``top`` terms (part term)."""
    spark = docs.sparkSession
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = sorted((r.lang, r.source) for r in docs.select("lang", "source").distinct().collect())
    langs = {lang: k for k, lang in enumerate(sorted({x for x, _ in found}))}
    numbers = {x: (langs[x[0]], g) for g, x in enumerate(found)}
    members = defaultdict(list)
    for lang, g in numbers.values():
        members[lang].append(g)
    trie = merged_tries(docs, numbers, least_docs, leaves)
    kept = {k: 0 for k in members} | {r.lang: r["count"] for r in trie.groupBy("lang").count().collect()}
    n = {r.g: r.n for r in trie.select(F.explode(F.arrays_zip("groups", "counts")).alias("x")).groupBy(F.col("x.groups").alias("g")).agg(F.sum("x.counts").alias("n")).collect()}
    totals = {lang: [n.get(g, 0) for g in mine] for lang, mine in members.items()}
    judged = materialize(trie.mapInArrow(_judge(dict(members), totals, kept, top), _FOUND), "judged")

    groups = spark.createDataFrame([(g, lang, source, members[numbers[lang, source][0]][0], len(members[numbers[lang, source][0]])) for g, (lang, source) in enumerate(found)], "g int, lang string, source string, first int, size int")
    sums = judged.where(F.col("sums").isNotNull()).groupBy("g").applyInArrow(_added, "g int, sums array<bigint>")
    pairs = groups.join(sums, "g", "left").select("g", "lang", "source", "first", F.posexplode(F.coalesce("sums", F.array_repeat(F.lit(0).cast("bigint"), F.col("size")))).alias("j", "value"))
    others = groups.select(F.col("g").alias("other"), F.col("source").alias("item"))
    pairs = pairs.withColumn("other", F.col("first") + F.col("j")).where(F.col("other") != F.col("g")).join(others, "other").select("g", "lang", "source", F.lit("pair").alias("part"), "item", "value")
    by_rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("value"), "item"))
    terms = judged.where(F.col("item").isNotNull()).withColumn("item", F.col("item").cast("string")).withColumn("rank", by_rank).where(F.col("rank") <= top)
    terms = terms.join(groups, "g").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.withColumn("rank", by_rank).drop("g").select("lang", "source", "part", "item", "value", "rank").unionByName(terms)


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
counted AS (
  SELECT doc_id, lang, source, t, count(*) AS n
  FROM (SELECT doc_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM docs) GROUP BY ALL),
kept AS (SELECT lang, t, sum(n)::BIGINT AS n FROM counted GROUP BY lang, t HAVING count(*) >= 3),
sizes AS (SELECT lang, sum(n)::BIGINT AS n_lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
held AS (SELECT lang, source, t, sum(counted.n)::BIGINT AS n FROM counted JOIN kept USING (lang, t) GROUP BY ALL),
cells AS (
  SELECT lang, source, t, coalesce(held.n, 0) AS n, 1 + 1000000000 * (kept.n + 1) // (n_lang + v) AS q, v, sum(coalesce(held.n, 0)) OVER (PARTITION BY lang, source)::BIGINT AS n_all
  FROM groups JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN held USING (lang, source, t)),
shares AS (SELECT lang, source, t, n, q, 1 + 1000000000 * (n + 1) // (n_all + v) AS p FROM cells),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, t AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms) WHERE rank <= 200
"""
