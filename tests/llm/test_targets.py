"""Importance resampling, decontamination and the divergence audit against SQL and plain forms."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tonewright.llm import bytewise, decontamination, divergence, importance
from tonewright.llm.queries import oracle_sql, queries

from ..conftest import SF

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
DOCS = [  # doc_id, text, lang, source
    (1, None, "en", "a"), (2, "", "en", None), (3, "word", None, "a"), (4, "word", "en", "a"), (4, "word", "en", "a"), (None, "word", "en", "a"),
    (4, "another text under the same id " + ITEM, "en", "b"), (5, "x\x00y\x7fz" * 30, "xx", "b"), (6, f"Before, {ITEM.upper()}! after " * 3, "en", "hot"), (7, ITEM.replace("zeta", "zeta zeta"), "en", "hot"),
    (8, "Zażółć gęślą jaźń. " * 300, "de", "hot"), (9, "the tail: " + ITEM[-56:], "en", "hot"), (10, "of " * 4000, "en", "hot"), (11, "long" * 20000 + " short item", "en", "hot"),
    (None, ITEM + " nobody", "en", "hot"), (12, " ".join(f"w{k % 7} beta" for k in range(200)), "en", "b"), (13, "ÀÉ àé aA", "", ""),
]
ITEMS = [(1, ITEM), (2, "Short  ITEM"), (3, None), (4, "!?"), (None, "beta"), (10, "zz " + ITEM), (1, "one two three four five six seven"), (5, "never " * 12), (6, "zażółć gęślą jaźń zażółć gęślą jaźń")]


def fold(text, pattern):
    return pattern.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string, source string").selectExpr("*", "1 AS n_words", "'x' AS item", "2 AS score", "3 AS token", "4 AS rank", "'t' AS id")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string").selectExpr("*", "1 AS window", "2 AS n")


@pytest.mark.parametrize("name", ["op11_importance", "op12_decontamination", "op13_divergence_audit"])
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in os.listdir(SF):
        duck.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    got = queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want, key=repr)


@given(st.lists(st.binary(min_size=1, max_size=70), max_size=20))
@settings(max_examples=60, deadline=None)
def test_crc_of_ranges(parts):
    ends = np.cumsum([len(p) for p in parts]).astype(np.int64)
    got = importance.crc32_ranges(np.frombuffer(b"".join(parts), np.uint8), ends - np.array([len(p) for p in parts], np.int64), ends)
    assert got.tolist() == [zlib.crc32(p) for p in parts]


def plain_resample(docs, items, longest=1, buckets=10000, percent=10, least=20):
    def features(text):
        w = fold(text, ALNUM)
        return w, [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(w) - n + 1)]

    found = [features(t) for _, t, *_ in docs]
    s, t = Counter(b for _, f in found for b in f), Counter(b for _, x in items for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in s}
    rows = []
    for (i, *_), (w, f) in zip(docs, found):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    may = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    for k, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize("longest, percent", [(1, 40), (2, 60), (3, 100), (1, 0)])
def test_importance_on_edges(spark, docs, items, longest, percent):
    got = importance.resample(docs, items, longest=longest, percent=percent).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_resample(DOCS, ITEMS, longest, percent=percent), key=repr)


def test_importance_ranks_over_many_ranges_and_blocks(spark, monkeypatch):
    """Many repeated scores and ids: ranks are 1, 2, 3... whatever the ranges; small blocks give the same matrix."""
    rows = [(k % 300, " ".join(f"w{(k * j) % 50}" for j in range(20 + k % 3)), "en", "a") for k in range(900)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(7)
    target = spark.createDataFrame([(1, "w1 w2 w3")], "item_id bigint, text string")
    got = importance.resample(table, target, percent=37).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 900 * 37 // 100 + 1))
    assert sorted(map(tuple, got), key=repr) == sorted(plain_resample(rows, [(1, "w1 w2 w3")], percent=37), key=repr)


def test_empty_tables(spark, docs, items):
    no_docs, no_items = docs.limit(0), items.limit(0)
    for d, i in ((no_docs, items), (no_docs, no_items)):
        assert importance.resample(d, i).count() == 0
        assert decontamination.contamination(d, i).count() == 0
    assert divergence.audit(no_docs).count() == 0
    clean = decontamination.contamination(docs, no_items).collect()
    assert len(clean) == len(DOCS) and all(r.n_hit == 0 and r["items"] == [] for r in clean)
    assert sorted(map(tuple, importance.resample(docs, no_items, percent=50).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == sorted(plain_resample(DOCS, [], percent=50), key=repr)


def plain_contamination(docs, items, window=10):
    out = []
    for i, text, *_ in docs:
        w, hit, found = fold(text, ALNUM), set(), set()
        for item, x in items:
            v = fold(x, ALNUM)
            n = min(window, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == v[a : a + n]:
                        hit |= set(range(k, k + n))
                        found.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("window, shingle, small", [(10, 5, 100_000), (10, 5, 0), (10, 10, 100_000), (4, 2, 0), (3, 5, 100_000), (10, 1, 0)])
def test_contamination_on_edges(spark, docs, items, window, shingle, small):
    """Against all windows at all places; small=0 shuffles both sides of every join."""
    short = [(i, t and t[:9000], *rest) for i, t, *rest in DOCS if i != 11] + [(11, "long" * 20000 + " short item", "en", "hot")]
    table = spark.createDataFrame(short, "doc_id bigint, text string, lang string, source string")
    got = decontamination.contamination(table, items, window, shingle, small).select("doc_id", "n_words", "n_hit", "items").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_contamination(short, ITEMS, window), key=repr)


def test_contamination_with_hashes_that_collide(spark, docs, items, monkeypatch):
    """Four values for all words, and a filter that lets nearly all pass: the comparison of words decides, and nothing is lost."""
    made = bytewise.hash_ranges
    few = spark.createDataFrame([d for d in DOCS if d[1] is None or len(d[1]) < 2000], "doc_id bigint, text string, lang string, source string")
    want = plain_contamination([d for d in DOCS if d[1] is None or len(d[1]) < 2000], ITEMS)
    monkeypatch.setattr(bytewise, "hash_ranges", lambda *a: made(*a) & np.uint64(3))
    bits = np.full((1 << 20) // 8, 255, np.uint8)
    import pyarrow as pa

    # the functions of the tasks, run here, where the patch holds
    windows = [r for b in decontamination._item_windows(10, 5)(iter([pa.record_batch({"item": pa.array([None if i is None else str(i) for i, _ in ITEMS]).fill_null(""), "text": pa.array([t for _, t in ITEMS])})])) for r in b.to_pylist()]
    rows = [r for b in decontamination._places(bits, [1, 2, 5], 10, 5, 100)(iter([pa.record_batch({"doc_id": pa.array([d[0] for d in DOCS if d[1] is None or len(d[1]) < 2000]), "th": pa.array(range(few.count())), "text": pa.array([d[1] for d in DOCS if d[1] is None or len(d[1]) < 2000])})])) for r in b.to_pylist()]
    base = {r["th"]: r for r in rows if r["token"] is None}
    hit, found = defaultdict(set), defaultdict(set)
    for r in rows:
        for x in windows if r["token"] is not None else ():
            for at, token in enumerate(x["tokens"]):
                words = r["around"].split(" ")[max(r["before"] - at, 0) :][: x["n"]]
                if token == r["token"] and at <= r["before"] and " ".join(words) == x["window"]:
                    for p in r["places"]:
                        hit[r["th"]] |= set(range(p - at, p - at + x["n"]))
                    found[r["th"]].add(x["item"])
    got = [(b["doc_id"], b["n_words"], len(hit[k]), sorted(found[k])) for k, b in base.items()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@given(st.lists(st.tuples(st.text("abé中", max_size=6), st.integers(0, 3), st.integers(1, 9)), max_size=60), st.integers(0, 60))
@settings(max_examples=80, deadline=None)
def test_tries(rows, cut):
    """Terms in the order of bytes, counts added up, and tries of two parts merged are that of the whole."""
    parts = divergence.Trie(), divergence.Trie()
    want = defaultdict(Counter)
    for k, (term, key, n) in enumerate(rows):
        parts[k >= cut].add(term.encode(), [1, key, n])
        want[term][key] += n
        want[term]["docs"] += 1
    parts[0].merge(parts[1])
    got = [(t, {"docs": c[0]} | dict(zip(c[1::2], c[2::2]))) for t, c in parts[0].walk()]
    assert got == [(t.encode(), dict(want[t])) for t in sorted(want, key=str.encode)] and parts[0].leaves == len(got)


def plain_audit(docs, least=3, top=200):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in docs:
        g = (lang or "", source or "")
        groups.add(g)
        terms = fold(text, LETTERS)
        counts[g].update(terms)
        held[g[0]].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= least]
        peers = [s for x, s in groups if x == lang]

        def share(sources):
            whole = sum(counts[lang, s][t] for s in sources for t in kept) + len(kept)
            return {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 1) // whole for t in kept}

        p, all_of = share([source]), share(peers)
        for part, rows, most in (
            ("pair", [(s, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)) for s in peers if s != source for q in [share([s])]], None),
            ("term", [(t, (p[t] - all_of[t]) ** 2 // all_of[t]) for t in kept if counts[lang, source][t] and p[t] > all_of[t]], top),
        ):
            rows.sort(key=lambda r: (-r[1], r[0].encode()))
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(rows[:most], 1)]
    return out


@pytest.mark.parametrize("least, top, leaves", [(3, 200, 150_000), (1, 200, 3), (1, 2, 150_000)])
def test_audit_on_edges(spark, docs, least, top, leaves):
    """Also with tries of three leaves, so that every term is merged from many."""
    got = divergence.audit(docs.repartition(5), least, top, leaves).collect()
    assert sorted(map(tuple, got)) == sorted(plain_audit(DOCS, least, top))


def test_audit_counts_beyond_doubles():
    """Long division at counts where count times scale leaves 64 bits."""
    count, whole = np.array([0, 5, 10**15, 4 * 10**15]), np.array([4 * 10**15 + 7] * 4)
    assert divergence.shares(count, whole).tolist() == [1 + 10**9 * (int(c) + 1) // int(w) for c, w in zip(count, whole)]
