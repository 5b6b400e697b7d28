"""The ten operators against brute force, on the smallest tables and on a table of edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tonewright.llm import bytewise, chat, chroma, language_id, mixing, packing, quality_classifier, quality_rules, sentence_spans, simhash, suffix_dedup
from tonewright.llm.components import connected_components
from tonewright.llm.queries import oracle_sql, queries, tokenizer_file

from ..conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SENTENCES = "One passage that is copied here. It has a second sentence too. And then it has a third one. "
EDGES = [  # doc_id, text, lang, source, n_chars
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "word", None, "a", 4), (4, "word", "en", "a", 4), (4, "word", "en", "a", 4),
    (5, "   x\x1cy\x85z", "xx", "b", 9), (6, "Same line.\nSame line.\n \nother", "en", "b", 30), (7, "a b c a b c a b c", "en", "b", 17),
    (8, "Zażółć gęślą jaźń. " * 300, "de", "hot", 5700), (9, SENTENCES + "Then something else follows.", "en", "hot", 0), (10, "First comes this. " + SENTENCES + "The end of it.", "en", "hot", 0),
    (11, SENTENCES + "Then something else follows.", "en", "hot", 0), (12, "of " * 4000, "en", "hot", 12000), (13, "long" * 20000, "en", "hot", 80000), (14, "<|endoftext|> </s>[INST] \\x", "en", "b", 20),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    """The edge cases, with columns whose names operators use themselves."""
    t = spark.createDataFrame(EDGES, SCHEMA)
    return t.selectExpr("*", "1 AS n_words", "'x' AS fp", "2.0 AS score", "'k' AS key", "7 AS size", "'g' AS gram")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(name="documents"):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/{name}.parquet'").fetchall())


def base_statistics(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            inside |= {k, k + 1, k + 2}
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_quality_rules(spark, docs, nothing):
    got = queries()["op1_quality_rules"](spark, SF).collect()
    texts = texts_of()
    assert len(got) == len(texts)
    for r in got:
        n, *_ = want = base_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 50 or 100 * want[4] > 50 * n)
        assert not (r.kept and r.base_failed)
    edge = quality_rules.quality_rules(docs).collect()
    assert len(edge) == len(EDGES) and all(r.base_failed for r in edge if r.doc_id in (1, 2, 3, 12))
    for r in edge:
        want = base_statistics(next(e[1] for e in EDGES if e[0] == r.doc_id))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
    assert quality_rules.quality_rules(nothing).count() == 0


def plain_em(votes, rounds=2000):
    """EM document by document, without a table of patterns: posteriors."""
    n, rules = votes.shape
    post = [0.97 if (v == 0).sum() == 0 else 0.4 if (v == 0).sum() == 1 else 0.05 for v in votes]
    for _ in range(rounds):
        share = (sum(post) + 1) / (n + 2)
        acc = []
        for c, (x, y) in ((0, (2.0, 2.0)), (1, (4.0, 1.0))):
            weight = np.array(post) if c else 1 - np.array(post)
            right, wrong = (weight[:, None] * (votes == c)).sum(axis=0), (weight[:, None] * (votes == 1 - c)).sum(axis=0)
            acc.append((right + x) / (right + wrong + x + y))
        new = []
        for v in votes:
            good, bad = share, 1 - share
            for k in range(rules):
                if v[k] == 1:
                    good, bad = good * acc[1][k], bad * (1 - acc[0][k])
                elif v[k] == 0:
                    good, bad = good * (1 - acc[1][k]), bad * acc[0][k]
            new.append(good / (good + bad))
        moved, post = np.abs(np.array(new) - post).max(), new
        if moved < 1e-9:
            break
    return np.array(post)


def test_posteriors_equal_a_plain_em(spark):
    got = {r.doc_id: r for r in queries()["op1_quality_rules"](spark, SF).collect()}
    texts = texts_of()
    votes = quality_rules.rule_votes(np.array([quality_rules.text_statistics(t) for t in texts.values()]))
    post = dict(zip(texts, plain_em(votes)))
    assert all(abs(got[i].posterior - post[i]) < 1e-5 and got[i].kept == (not got[i].base_failed and post[i] >= 0.5) for i in texts)


def test_posterior_keeps_good_documents_that_one_rule_refuses(spark):
    sf = SF.replace("0.001", "0.01")
    texts, labels = (dict(duckdb.sql(f"SELECT doc_id, {c} FROM '{sf}/{t}.parquet'").fetchall()) for c, t in (("text", "documents"), ("quality", "labels")))
    refused = {i for i, v in zip(texts, quality_rules.rule_votes(np.array([quality_rules.text_statistics(t) for t in texts.values()]))) if (v == 0).any()}
    kept = {r.doc_id: r.kept for r in queries()["op1_quality_rules"](spark, sf).collect()}
    assert sum(kept[i] for i in refused) >= 20 and not any(kept[i] for i in refused if labels.get(i) == 0)
    assert np.mean([kept[i] == bool(y) for i, y in labels.items() if y == 0 or base_statistics(texts[i])[0] >= 50]) > 0.95


def test_rule_accuracies_find_the_planted_class():
    r, rules = np.random.default_rng(1), len(quality_rules.RULES)
    good = r.random(4000) < 0.85
    votes = np.where(good[:, None], r.random((4000, rules)) < 0.9, r.random((4000, rules)) < 0.45).astype(int)  # 1 good, 0 bad
    votes[r.random((4000, rules)) < 0.2] = quality_rules.ABSTAIN
    code = ((votes + 1) * 3 ** np.arange(rules)).sum(axis=1)
    patterns, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    post, _, share = quality_rules.fit_accuracies(patterns, counts)
    assert abs(share - 0.85) < 0.05 and ((post[inverse] >= 0.5) == good).mean() > 0.95


def fingerprint(text):
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[k : k + 4]).encode(), seed=42).intdigest() for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    """doc_id -> smallest reachable, by comparing all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, docs, nothing):
    got = {r.doc_id: r for r in queries()["op2_simhash"](spark, SF).collect()}
    prints = {i: fingerprint(t) for i, t in texts_of().items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == components(prints)
    edge = simhash.near_duplicates(docs).collect()
    want = components({e[0]: fingerprint(e[1]) for e in EDGES})
    assert len(edge) == len(EDGES) and all(r.component_id == want[r.doc_id] for r in edge)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_first(nothing).count() == 0


def test_tree_search_equals_all_pairs():
    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 1500, dtype=np.uint64)
    near = base[r.integers(0, 1500, 1500)]
    for _ in range(4):
        near = near ^ (np.uint64(1) << r.integers(0, 64, 1500).astype(np.uint64))
    fps = np.unique(np.r_[base, near])
    far = np.triu(simhash.distance(fps[:, None], fps[None, :]) <= 4, 1)
    want = set(zip(*simhash.spanning(*np.nonzero(far))))
    a, b = [], []
    for mask in simhash.block_masks():
        tree, leaves = simhash.build_tree(fps, mask, 16, r)
        assert leaves > 8
        for _, home, visit in simhash.route(fps, tree, mask, 1):
            x, y = simhash.search(fps, home, visit, mask, 1)
            a.append(x)
            b.append(y)
    assert set(zip(*simhash.spanning(np.concatenate(a), np.concatenate(b)))) == want


def test_components_of_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(200, 100), (100, 150), (7, 7), (3, 2)], "a bigint, b bigint")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {150: 100, 200: 100}
    assert connected_components(links.limit(0)).count() == 0


def test_quality_classifier(spark, docs, nothing):
    sf = SF.replace("0.001", "0.01")
    got = queries()["op3_quality_classifier"](spark, sf).collect()
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.9
    some = spark.createDataFrame([(3, 1), (4, 0), (6, None), (3, 1)], "doc_id bigint, quality int")
    edge = quality_classifier.classify_quality(docs, some).collect()
    assert len(edge) == len(EDGES) and len({r.score for r in edge if r.doc_id in (1, 2)}) == 1
    assert quality_classifier.classify_quality(nothing, some.limit(0)).count() == 0


def test_training_equals_plain_ftrl():
    r = np.random.default_rng(11)
    examples = [(np.unique(r.integers(0, 64, 9)), None, int(r.random() < 0.5), float(r.uniform(0.5, 2))) for _ in range(40)]
    examples = [(i, r.uniform(0.1, 1, len(i)), y, c) for i, _, y, c in examples]
    z, n, order = defaultdict(float), defaultdict(float), np.random.default_rng(7)

    def weight(i):
        if abs(z[i]) <= quality_classifier.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * quality_classifier.L1) / ((quality_classifier.BETA + n[i] ** 0.5) / quality_classifier.ALPHA + quality_classifier.L2)

    for _ in range(3):
        for k in order.permutation(len(examples)):
            index, value, y, c = examples[k]
            x = dict(zip(index.tolist(), value.tolist())) | {64: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = c * (p - y) * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality_classifier.ALPHA * w[i]
                n[i] += g * g
    assert np.allclose(quality_classifier.train_ftrl(examples, bits=6, epochs=3), [weight(i) for i in range(65)], atol=1e-12)


def test_scores_are_sparse_dot_products(spark):
    r = np.random.default_rng(12)
    weights = r.normal(0, 0.1, (1 << quality_classifier.BITS) + 1).astype(np.float32)
    texts = ["", None, "one two", "One  two\nthree, 4!", "word " * 70000]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for x in quality_classifier.score(t, weights).collect():
        data = (texts[x.doc_id] or "").encode()
        index, _ = quality_classifier.hashed_features(np.frombuffer(data, np.uint8), np.array([len(data)]))
        total = sum(float(weights[i]) for i in index.tolist()) / max(len(index), 1) ** 0.5
        assert abs(x.score - 1 / (1 + np.exp(-(total + float(weights[-1]))))) < 1e-6


def test_labels_that_disagree(spark):
    docs = spark.createDataFrame([(k, f"{'good prose here' if k % 2 else 'bad bad junk'} {k}") for k in range(1, 41)] + [(None, "x")], "doc_id bigint, text string")
    labels = [(k, k % 2) for k in range(1, 41)]
    same = quality_classifier.classify_quality(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    noisy = spark.createDataFrame(labels * 2 + [(k, 1 - k % 2) for k in range(1, 41)] + [(900, 1), (900, 0)], "doc_id bigint, quality int")
    a, b = ({x.doc_id: (x.score, x.held_out) for x in t.collect()} for t in (same, quality_classifier.classify_quality(docs, noisy)))
    assert a == b and a[None][1] is False


def test_hashed_features_do_not_cross_documents():
    data = b"Abc dEf" + b"ghi,jkl" + b"" + b"abc def"
    index, doc = quality_classifier.hashed_features(np.frombuffer(data, np.uint8), np.array([7, 14, 14, 21]))
    per = [sorted(index[doc == k]) for k in range(4)]
    assert per[0] == per[3] and len(per[0]) == 3 and len(per[1]) == 5 and not per[2]


def test_chroma_finds_excerpts_and_copies(spark):
    r = np.random.default_rng(3)
    tunes = [chroma.melody(r.normal(size=64)) for _ in range(30)]
    rows = [(k, chroma.RATE, bytearray(t.tobytes())) for k, t in enumerate(tunes)]
    noisy = (tunes[7] + r.normal(0, 1000, len(tunes[7]))).astype("<i2")
    rows += [(50, chroma.RATE, bytearray(tunes[3][256 * 12 :].tobytes())), (100, chroma.RATE, bytearray(noisy.tobytes())), (61, chroma.RATE, rows[5][2]), (62, chroma.RATE, None), (63, None, bytearray(b"abc")), (64, chroma.RATE, bytearray())]
    media = spark.createDataFrame([(*x, "z") for x in rows], "media_id bigint, rate int, pcm binary, codes string")
    got = {x.media_id: x for x in chroma.match_media(chroma.fingerprint_media(media)).collect()}
    assert len(got) == len(rows) and got[61].class_id == 5 and {got[k].class_id for k in (62, 63, 64)} == {62}
    assert [(x["class_id"], x["offset"]) for x in got[50].links][:1] == [(3, -12)]
    assert 7 in [x["class_id"] for x in got[100].links]
    assert chroma.match_media(chroma.fingerprint_media(media.limit(0))).count() == 0


def alignments(prints):
    """(asker, other) to the best (share of differing bits, -overlap) over all offsets, for ids divisible by 50."""
    best = {}
    for q, a in prints.items():
        for k, b in prints.items() if q % 50 == 0 else ():
            for off in range(-(len(b) - 16), len(a) - 15) if k != q else ():
                x, y = max(off, 0), max(-off, 0)
                n = min(len(a) - x, len(b) - y)
                if n >= 16:
                    best[q, k] = min(best.get((q, k), (1, 0)), (float(np.bitwise_count(a[x : x + n] ^ b[y : y + n]).sum()) / (32 * n), -n))
    return best


def test_chroma_links_equal_all_offsets_of_all_pairs(spark):
    r = np.random.default_rng(4)
    tunes = [chroma.melody(r.normal(size=64)) for _ in range(60)]
    rows = [(50 * k, chroma.RATE, bytearray(t.tobytes())) for k, t in enumerate(tunes)]
    for k in range(180):  # excerpts with noise, also cut between frames
        t = tunes[k % 60][int(r.integers(0, 20 * 256)) :][: 256 * int(r.integers(34, 60))]
        noisy = np.clip(t * r.uniform(0.4, 1.0) + r.normal(0, (300, 1000, 2000)[k % 3], len(t)), -32000, 32000).astype("<i2")
        rows.append((50 * k + 7, chroma.RATE, bytearray(noisy.tobytes())))
    rows += [(10**6 + k, chroma.RATE, bytearray(2 * (20000 + 500 * k))) for k in range(3)] + [(5 * 10**6, chroma.RATE, bytearray(2 * 30000))]
    prints = chroma.fingerprint_media(spark.createDataFrame(rows, "media_id bigint, rate int, pcm binary"))
    want = {k: v for k, v in alignments({x.media_id: np.array(x.codes, np.int32).view(np.uint32) for x in prints.collect()}).items() if v[0] <= chroma.MOST_ERRORS}
    got = {(x.media_id, y["class_id"]): y["bit_errors"] for x in chroma.match_media(prints).collect() if x.media_id % 50 == 0 and x.media_id == x.class_id for y in x.links or ()}
    assert set(got) <= set(want) and len(set(got)) >= 0.95 * len(want) > 150
    assert all(got[k] == want[k][0] for k in got)


def test_chroma_query_finds_the_excerpts(spark):
    """Each query of the table has its excerpt as its one link, where the excerpt starts."""
    got = {x.media_id: x for x in queries()["op4_chroma"](spark, SF.replace("0.001", "0.01")).collect()}
    asked = [k for k in got if k >= 0 and k % 50 == 0]
    found = {k: [x["class_id"] for x in got[k].links or ()] for k in asked}
    assert len(asked) >= 10 and np.mean([found[k] == [-1 - k] for k in asked]) >= 0.95
    assert all(got[k].links[0]["offset"] in range(7, 11) and got[k].links[0]["bit_errors"] <= chroma.MOST_ERRORS for k in asked if found[k])
    assert sum(k < 0 for k in got) == len([k for k in got if k >= 0 and k % chroma.EXCERPT_STEP == 0])


def test_chroma_alignment_breaks_ties():
    """Equal errors: the longer overlap, then the nearer, then the smaller offset."""
    a = np.full(40, 7, np.uint32)
    assert chroma.align(a, a, [3, -3, 0]) == (0, 40, 0.0)
    assert chroma.align(a, a, [3, -3]) == (-3, 37, 0.0)
    assert chroma.align(a[:20], a, [-5, 0, -20]) == (0, 20, 0.0) and chroma.align(a[:15], a, [0]) is None and chroma.align(a, ~a, [0]) is None


def test_chroma_refuses_unlike_tunes(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' LIMIT 300").fetchall()
    prints = {k: chroma.fingerprint(chroma.chroma(chroma.melody(np.array(v)) / 32768, chroma.RATE)) for k, v in rows}
    assert min(e for e, _ in alignments(prints).values()) > chroma.MOST_ERRORS + 0.05


def test_mixing_equals_sql_and_meets_targets(spark, docs, nothing):
    got = queries()["op5_mixing"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = c.sql(oracle_sql()["op5_mixing"]).df().sort_values("doc_id").reset_index(drop=True)
    assert (got[sorted(got)] == want[sorted(got)]).all().all()
    edge = mixing.mix_sources(docs).collect()
    assert len(edge) == len(EDGES) and all(0 <= r.taken <= 2 * r.size for r in edge)
    by = defaultdict(int)
    for r in edge:
        by[r.source] += r.taken
    assert all(abs(by[r.source] - r.target) <= 1 for r in edge)
    assert mixing.mix_sources(nothing).count() == 0
    assert mixing.repeat_documents(docs).columns == docs.columns and mixing.repeat_documents(nothing).count() == 0


def test_language_id(spark, docs, nothing):
    got = queries()["op6_language_id"](spark, SF).collect()
    declared = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    mine = [r for r in got if r.doc_id >= 0]
    assert len(mine) == len(declared) and np.mean([r.language == declared[r.doc_id] and r.kept for r in mine]) > 0.97
    assert len(got) - len(mine) == duckdb.sql(f"SELECT count(*) FROM '{SF}/pages.parquet'").fetchall()[0][0]
    edge = language_id.identify(language_id.of_documents(docs), docs.select("lang", "text")).collect()
    assert len(edge) == len(EDGES) and not any(r.kept for r in edge if r.doc_id in (1, 2))
    kept = language_id.accept_documents(docs)
    assert kept.columns == docs.columns and {1, 2}.isdisjoint(r.doc_id for r in kept.collect())
    assert language_id.accept_documents(nothing).count() == 0


FOREIGN = (
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "xq zkvj wpf qqz jxk vvbn zzkp qwx jfgh kkp xzq vbnm wqp zxcv jklh gfds qwrt", "Все люди рождаются свободными и равными в своем достоинстве и правах.",
)


def test_foreign_texts_go_and_wrong_declarations_do_not_matter(spark):
    known = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    wrong = known.where("doc_id % 3 = 0").selectExpr("doc_id + 1000000 AS doc_id", "text", "CASE lang WHEN 'en' THEN 'fr' ELSE 'en' END AS lang", "source", "n_chars")
    foreign = spark.createDataFrame([(-1 - k, t, ("en", "fr", None, "de")[k], "src0", 0) for k, t in enumerate(FOREIGN)], SCHEMA)
    table = known.union(wrong).union(foreign)
    got = {r.doc_id: r for r in language_id.identify(language_id.of_documents(table), table.select("lang", "text")).collect()}
    lang = dict(known.select("doc_id", "lang").collect())
    assert all(not got[-1 - k].kept and got[-1 - k].language == "other" for k in range(len(FOREIGN)))
    assert np.mean([got[i].kept and got[i].language == lang[i] for i in lang]) > 0.99
    assert np.mean([got[i].kept and got[i].language == lang[i - 10**6] for i in got if i >= 10**6]) > 0.97
    assert {r.doc_id for r in language_id.accept_documents(table).select("doc_id").collect()} == {i for i, r in got.items() if r.kept}


def plain_posteriors(rows):
    """Rows (host, declared, suffix, text evidence per class or None) to posteriors per class, one by one."""
    classes = language_id.CLASSES
    best = [None if t is None else next(c for c in classes if t[c] == max(t.values())) for *_, t in rows]
    domain = lambda host: ".".join(host.split(".")[::-1][:2])
    world = Counter(b for b in best if b)
    out = []
    for k, (host, declared, suffix, t) in enumerate(rows):
        others = [j for j in range(len(rows)) if j != k and best[j]]
        post = {}
        for c in classes:
            share = (world[c] + 1) / (sum(world.values()) + len(classes))
            near = [best[j] for j in others if domain(rows[j][0]) == domain(host)]
            here = [best[j] for j in others if rows[j][0] == host]
            wide = (near.count(c) + 4.0 * share) / (len(near) + 4.0)
            prior = (here.count(c) + 4.0 * wide) / (len(here) + 4.0)
            says = 1.0
            for col, value in ((1, declared), (2, suffix)):
                says *= (sum(best[j] == c and rows[j][col] == value for j in others) + 1) / (world[c] + len(classes))
            post[c] = (t[c] if t else 0.0) + np.log(prior) + np.log(says)
        top = max(post.values())
        mass = {c: np.exp(p - top) for c, p in post.items()}
        out.append({c: m / sum(mass.values()) for c, m in mass.items()})
    return out


def test_fused_evidence_equals_plain_bayes(spark):
    r = np.random.default_rng(7)
    rows, given = [], []
    for k in range(150):
        host = ["a.example.de", "b.example.de", "c.org", "", "d.org"][k % 5]
        declared, suffix = ["de", "en", ""][int(r.integers(3))], host.split(".")[-1]
        ll = None if k % 11 == 0 else [float(x) for x in np.round(r.normal(0, 3, 4) + [2.0 * (host[-2:] == "de"), 1.0, 0.0, 0.0], 3)]
        rows.append((k, declared, host, suffix, 0 if ll is None else 50, *(ll or [0.0] * 4)))
        given.append((host, declared, suffix, None if ll is None else dict(zip(language_id.CLASSES, [x / 3 for x in ll] + [0.0]))))
    scored = spark.createDataFrame(rows, "doc_id bigint, declared string, host string, suffix string, letters bigint, " + ", ".join(f"ll_{x} double" for x in language_id.LANGUAGES))
    want = plain_posteriors(given)
    for x in language_id.fuse(scored).collect():
        assert abs(x.posterior - max(want[x.doc_id].values())) < 1e-9 and abs(want[x.doc_id][x.language] - x.posterior) < 1e-9
        assert x.kept == (x.letters > 0 and x.language != "other" and x.posterior >= 0.5)


def test_pages_give_their_evidence(spark):
    rows = [(4, "https://user@Blog.Example.co.uk:80/x", '<HTML class=a LANG="de-AT"><p>x</p>'), (5, None, None), (6, "nonsense", "<p>lang=fr")]
    got = {r.doc_id: r for r in language_id.of_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert (got[-5].declared, got[-5].host, got[-5].suffix) == ("de", "Blog.Example.co.uk", "uk")
    assert [got[k].declared for k in (-6, -7)] == [None, None]


def test_chat_round_trip(spark):
    t = duckdb.sql(f"SELECT conv_id, role, text FROM '{SF}/conversations.parquet' ORDER BY conv_id, turn, role, text").fetchall()
    turns = defaultdict(list)
    for conv, role, text in t:
        turns[conv].append((role or "", text or ""))
    turns[-7] = [(role, "</s>[INST] ok [/INST]") for role in ("user", "assistant")]
    got = queries()["op7_chat_format"](spark, SF).collect()
    assert len(got) == len(turns)
    for r in got:
        said = turns[r.conv_id]
        loss = "".join(x for role, x in said if role == "assistant")
        assert r.n_turns == len(said) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("text", ["", "[INST]", "[\\INST]", "[\\\\/INST] </s", "<|endoftext|><\\|endoftext|>", "a[[INST]b</s></\\s>", "é́ \n\n  <\\/s>"])
def test_escape_is_reversible(text):
    marked = chat.escape(text)
    assert chat.unescape(marked) == text and not any(c in marked for c in chat.CONTROL)
    turns = [("user", text), ("assistant", text), (text, ""), ("assistant", ""), ("assistant", text + " \n")]
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    e = chat.encoder(tokenizer_file("byte_bpe_50k.json")).encode(formatted, add_special_tokens=False)
    at = np.array(e.offsets).reshape(-1, 2)
    mask = chat.loss_mask(at[:, 0], at[:, 1], spans)
    assert chat.masked_text(formatted, at[:, 0], at[:, 1], mask) == text + text + " \n"


def test_chat_edges(spark):
    rows = [(1, 2, "assistant", None, "x"), (1, None, None, "hi", "x"), (None, 1, "user", "q", "x"), (1, 2, "assistant", None, "x"), (2, 1, "assistant", "yes " * 20000, "x")]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, ids string"), tokenizer_file("byte_bpe_50k.json")).collect()}
    assert chat.parse(got[1].formatted) == [("", "hi"), ("assistant", ""), ("assistant", "")] and got[None].n_turns == 1 and sum(got[2].loss) > 10000
    assert chat.format_conversations(spark.createDataFrame([], "conv_id bigint, turn int, role string, text string"), tokenizer_file("byte_bpe_50k.json")).count() == 0


def plain_pieces(text):
    """(offsets at which sentences start, runs as (first, after, folded words)) by the rule, word by word."""
    found = list(WORD.finditer(text or ""))
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), m[0]).encode() for m in found]
    n = len(words)
    value = []
    for k, w in enumerate(words):
        ends = k == 0 or found[k - 1][0][-1] in ".!?" or "\n" in text[found[k - 1].end() : found[k].start()]
        value.append(0 if ends else int(bytewise.hash_ranges(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) | 1)
    cuts = [k for k in range(n) if value[k] == 0 or any(0 <= j and j + 8 <= n and value[k] == min(value[j : j + 8]) for j in range(k - 7, k + 1))]
    ends = [*cuts, n]
    spans = [(0, len(cuts), tuple(words))] if 3 <= n < 20 else []
    for f, c in enumerate(cuts):
        after = next((u for u in range(f + 1, len(ends)) if ends[u] - c >= 20), None)
        if after is not None:
            spans.append((f, after, tuple(words[c : ends[after]])))
    return [found[c].start() for c in cuts], spans


def plain_spans(rows):
    """What is left of each text, and how many sentences went; rows are in the order that decides which is earlier."""
    first, out = {}, []
    for k, (doc_id, text) in enumerate(rows):
        for _, _, h in plain_pieces(text)[1]:
            first.setdefault(h, rows.index((doc_id, text)) if doc_id is not None else None) if doc_id is not None else None
    for doc_id, text in rows:
        starts, spans = plain_pieces(text)
        gone, once = [False] * len(starts), {}
        for f, after, h in spans:
            once.setdefault(h, after)
            if (doc_id is not None and first[h] < rows.index((doc_id, text))) or f >= once[h]:
                gone[f:after] = [True] * (after - f)
        edges = [0, *starts, len(text or "")]
        out.append((text and "".join(text[a:b] for a, b, g in zip(edges, edges[1:], [False, *gone]) if not g), sum(gone)))
    return out


def test_sentence_spans(spark, docs, nothing):
    got = {r.doc_id: (r.text, r.n_removed) for r in queries()["op8_sentence_spans"](spark, SF).collect()}
    rows = sorted(texts_of().items())
    assert got == dict(zip([i for i, _ in rows], plain_spans(rows)))
    want = dict(zip(EDGE_ROWS, plain_spans(EDGE_ROWS)))
    edge = sentence_spans.remove_repeated_spans(docs).collect()
    assert len(edge) == len(EDGES) and all((r.text, r.n_removed) == want[r.doc_id, next(e[1] for e in EDGES if e[0] == r.doc_id)] for r in edge)
    kept = sentence_spans.clean_documents(docs)
    assert kept.columns == docs.columns and all((r.text or "").strip() or r.doc_id in (1, 2) for r in kept.collect())
    assert sentence_spans.remove_repeated_spans(nothing).count() == 0


EDGE_ROWS = sorted({(e[0], e[1]) for e in EDGES}, key=lambda e: e[0])


def surviving_stretches(texts, kept, n=50):
    """Stretches of n words or more that an earlier document holds and of which a document keeps n words in a row; and all such stretches."""
    seen, survive, stretches = set(), 0, 0
    for i, t in sorted(texts.items()):
        windows = [tuple(w) for w in zip(*(WORD.findall(t or "")[k:] for k in range(n)))]
        hit = np.flatnonzero([w in seen for w in windows])
        stretches += len(hit) and 1 + int((np.diff(hit) > 1).sum())
        left = set(zip(*(WORD.findall(kept[i] or "")[k:] for k in range(n))))
        survive += sum(windows[k] in left for k in hit)
        seen.update(windows)
    return survive, stretches


def test_no_stretch_of_fifty_words_survives(spark):
    sf = SF.replace("0.001", "0.01")
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    got = {r.doc_id: r.text for r in queries()["op8_sentence_spans"](spark, sf).collect()}
    survive, stretches = surviving_stretches(texts, got)
    assert stretches > 100 and survive == 0


def test_passages_of_any_borders(spark):
    r = np.random.default_rng(5)
    say = lambda n: " ".join(f"w{k}" for k in r.integers(0, 10**6, n))
    long, texts = say(50), {}
    for k in range(40):
        texts[k] = f"{say(int(r.integers(0, 30)))} {long.upper() if k % 3 else long} {say(int(r.integers(0, 30)))}"
    rows = [*texts.items(), (40, say(60)), (41, "a short text of one sentence"), (42, "A short  text of one sentence"), (43, "word"), (44, "word"), (45, None), (None, texts[3]), (46, say(200000)), (47, long * 2)]
    got = {x.doc_id: (x.text, x.n_removed) for x in sentence_spans.remove_repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    given = dict(rows)
    assert all(got[k] == (given[k], 0) for k in (0, 40, 41, 43, 44, 45, None, 46)) and got[42][0].strip() == ""
    for k in range(1, 40):
        assert got[k][1] and len(got[k][0].split()) >= len(texts[k].split()) - 50 and set(got[k][0].lower().split()) != set(texts[k].lower().split())


def test_rows_that_share_an_id_with_unlike_texts(spark):
    r = np.random.default_rng(6)
    say = lambda n: " ".join(f"w{k}" for k in r.integers(0, 10**6, n)) + ". "
    a, b, c = say(80), say(80), say(80)
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b + c), (None, a), (None, c), (None, c + "And more. " + c), (4, c), (4, None), (4, "")]
    t = spark.createDataFrame([(*x, "en", "s", 1) for x in rows], SCHEMA)
    of = lambda df, *cols: sorted(((x.doc_id, *(x[c] for c in cols)) for x in df.collect()), key=repr)
    spans = of(sentence_spans.remove_repeated_spans(t), "text")
    assert spans.count((2, b)) == 2 and spans.count((None, a)) == 1 and spans.count((None, c)) == 1 and spans.count((4, None)) == 1
    assert (1, a) in spans and (2, a) not in spans and all(len(x[1].split()) < 100 for x in spans if x[0] == 3)
    bytes_left = of(suffix_dedup.remove_repeats(t), "n_removed", "n_bytes")
    assert bytes_left.count((2, 0, len(b))) == 2 and (2, len(a), len(a)) in bytes_left and (None, 0, len(a)) in bytes_left and (None, 0, len(c)) in bytes_left
    assert [x[1] for x in bytes_left if x[0] is None and x[2] > len(a) + len(c)][0] >= len(c) - 2
    kept = of(simhash.keep_first(t), "text")
    assert [x for x in kept if x[1]] == sorted([(1, a), (2, b), (3, b + c), (4, c)], key=repr) and len(kept) == 5
    clashing = t.selectExpr("*", *(f"'{n}' AS {n}" for n in ("_gone", "_one", "_id", "key", "th", "found", "own", "left", "gone", "row", "copies", "copy", "rejected", "_kept", "g", "first", "many", "told", "size", "u", "tie")))
    for stage in (language_id.accept_documents, simhash.keep_first, sentence_spans.clean_documents, mixing.repeat_documents):
        done = stage(clashing)
        assert done.columns == clashing.columns and done.count() >= (0 if stage is language_id.accept_documents else 5)  # the words have no letters to tell a language by


def test_packing(spark, docs, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))

    def hold(pieces, texts):
        by, seqs = defaultdict(list), defaultdict(list)
        for p in pieces:
            by[p.doc_id].append(p)
            seqs[p.sequence_id].append((p.offset, p.length))
        assert set(by) == set(texts)
        for i, t in texts.items():
            ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
            at = 0
            for p in sorted(by[i], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids)
                assert (p.ids_crc32 if "ids_crc32" in p else zlib.crc32(bytes(p.ids))) == zlib.crc32(ids[at : at + p.length].tobytes())
                at += p.length
            assert at == len(ids)
        padded = total = 0
        for s in seqs.values():
            s.sort()
            n = sum(x for _, x in s)
            assert [o for o, _ in s] == np.r_[0, np.cumsum([x for _, x in s])[:-1]].tolist() and n <= 4096
            total += n
            padded += 0 if n & (n - 1) == 0 else 4096 - n
        assert padded <= 0.03 * total

    hold(queries()["op9_packing"](spark, SF).collect(), texts_of())
    hold(packing.pack_documents(docs.dropDuplicates(["doc_id"]).coalesce(1), tokenizer_file("word_bpe_49k.json")).collect(), {e[0]: e[1] for e in EDGES})
    assert packing.pack_documents(nothing, tokenizer_file("word_bpe_49k.json")).count() == 0


def test_text_encoder_equals_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    file = tokenizer_file("word_bpe_49k.json")
    tok, r = Tokenizer.from_file(file), np.random.default_rng(8)
    letters = list("abcXYZ'stdrv019 ,.;<|>éÉÄßÑ×÷ÞİΣσ́e \u0085\x1c\x7f\n\t漢字ſıŉ€😀 ")
    texts = ["".join(r.choice(letters, r.integers(0, 40))) for _ in range(1500)]
    texts += ["<|ENDOFTEXT|>", "a<|endoftext|>b", "<|startoftext|><|endoftext|> x", "it's don't WE'LL 'street", "x" * 100, "É" * 40, "", None, "Ünïted " * 3000]
    got = packing.TextEncoder(file)(pa.array(texts))
    assert [g.tolist() for g in got] == [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert packing.TextEncoder(file)(pa.array([], pa.string())) == []
    assert [g.tolist() for g in packing.TextEncoder(file)(pa.array([None, "", " \n"]))] == [[2]] * 3


def test_examples_keep_the_loss_limit(spark):
    r = np.random.default_rng(9)
    rows = [(k, r.integers(0, 49000, n).tolist(), None if k % 7 == 0 else (r.random(n) < 0.8).tolist(), "x") for k, n in enumerate(r.integers(0, 900, 200).tolist())] + [(None, None, None, "x")]
    examples = spark.createDataFrame(rows, "id bigint, ids array<int>, loss array<boolean>, ids_ string")
    got = packing.pack_examples(examples, 1024, 6, 500).collect()
    by, seqs = defaultdict(list), defaultdict(lambda: [0, 0, 0])
    given = {k: (ids, loss) for k, ids, loss, _ in rows}
    for p in sorted(got, key=lambda p: (p.doc_id, p.start)):
        ids, loss = given[p.doc_id]
        assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.start : p.start + p.length] and p.start == sum(by[p.doc_id]) and p.doc_tokens == len(ids)
        by[p.doc_id].append(p.length)
        bearing = p.length if loss is None else sum(loss[p.start : p.start + p.length])
        seqs[p.sequence_id] = [a + b for a, b in zip(seqs[p.sequence_id], (p.length, 1, bearing))]
    assert all(sum(by[k]) == len(ids) for k, (ids, _) in given.items() if ids)
    assert all(a <= 1024 and b <= 6 and c <= 500 for a, b, c in seqs.values())
    full = [s for s in seqs.values() if s[2] >= 495 and s[0] < 900]
    assert len(full) > len(seqs) / 2  # it is the loss that fills most sequences


def test_packing_keeps_all_three_limits():
    r = np.random.default_rng(2)
    p = packing.Packer(0, (256, 4, 100))
    want = {}
    for k in range(300):
        n = int(r.integers(1, 500))
        loss = (r.random(n) < r.random()).astype(np.int64)
        want[k] = loss
        p.add(k, np.arange(n, dtype="<u4"), loss)
        if k % 50 == 49:
            p.drain(last=k == 299)
    seqs, tokens = defaultdict(list), defaultdict(int)
    for doc, start, ids, _, seq, _ in p.placed:
        assert ids.tolist() == list(range(start, start + len(ids)))
        seqs[seq].append((len(ids), want[doc][start : start + len(ids)].sum()))
        tokens[doc] += len(ids)
    assert all(tokens[k] == len(v) for k, v in want.items())
    assert all(sum(n for n, _ in s) <= 256 and len(s) <= 4 and sum(x for _, x in s) <= 100 for s in seqs.values())


def removed(texts):
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 99):
            key = hash(b[s : s + 100])
            gone[s : s + 100] |= key in seen
            seen.add(key)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out[i] = (len(b), len(b) - len(kept), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, docs, nothing):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries()["op10_suffix_dedup"](spark, SF).collect()}
    assert got == removed(texts_of())
    edge = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert edge == removed({e[0]: e[1] for e in EDGES})
    assert suffix_dedup.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_sorted_suffixes_alone_find_every_repeat(seed):
    """The sort and its comparisons without the reductions before them: every text is one piece, so no hash decides anything."""
    import pyarrow as pa

    r = np.random.default_rng(seed)
    stock = [bytes(r.integers(97, 97 + (2 if seed % 2 else 26), int(r.integers(60, 400))).astype(np.uint8)) for _ in range(6)]
    texts = {}
    for k in range(40 if seed < 4 else 14):
        parts = [stock[int(r.integers(6))][int(r.integers(0, 50)) :] if r.random() < 0.6 else bytes(r.integers(97, 123, int(r.integers(0, 150))).astype(np.uint8)) for _ in range(int(r.integers(1, 5)))]
        texts[k] = b"".join(parts) + (b"ab" * 120 if seed == 5 else b"")
    pieces = [(k, 7, 0, t) for k, t in texts.items() if len(t) >= 100]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    batches = [pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*pieces[a : a + 9]), kinds)], names=["doc_id", "th", "start", "piece"]) for a in range(0, len(pieces), 9)]
    rows = [row for b in suffix_dedup._samples(iter(batches)) for row in zip(*(c.to_pylist() for c in b.columns))]
    rows.sort(key=lambda x: (x[0], *x[2:]))
    types = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    for step in (37, 1000):
        parts = [pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[a : a + step]), types)], names=["head", "sides", "doc_id", "th", "at", "reach"]) for a in range(0, len(rows), step)]
        gone = {k: np.zeros(len(t), bool) for k, t in texts.items()}
        for b in suffix_dedup._later(iter(parts)):
            for k, span in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                gone[k][span >> 32 : span & 0xFFFFFFFF] = True
        want = {k: np.zeros(len(t), bool) for k, t in texts.items()}
        seen = set()
        for k, t in texts.items():
            for at in range(len(t) - 99):
                if t[at : at + 100] in seen:
                    want[k][at : at + 100] = True
                seen.add(t[at : at + 100])
        assert all((gone[k] == want[k]).all() for k in texts) and any(w.any() for w in want.values())


def test_bytes_repeated_within_one_text():
    for raw in (b"", b"x" * 99, b"x" * 100, b"x" * 150, b"abc" * 90, bytes(np.random.default_rng(1).integers(0, 256, 300).astype(np.uint8)) * 2):
        starts, stops = suffix_dedup.own_repeats(np.frombuffer(raw, np.uint8))
        seen, want = set(), np.zeros(len(raw), bool)
        for at in range(len(raw) - 99):
            if raw[at : at + 100] in seen:
                want[at : at + 100] = True
            seen.add(raw[at : at + 100])
        assert (suffix_dedup._covered(len(raw), starts, stops) == want).all()


def test_rows_without_an_id(spark):
    t = spark.createDataFrame([(None, SENTENCES * 2, "en", None, 1), (None, None, None, None, None), (7, SENTENCES * 2, "en", "a", 1), (8, SENTENCES * 2, "en", "a", 1)], SCHEMA)
    labels = spark.createDataFrame([(None, 1), (7, 0), (8, 1)], "doc_id bigint, quality int")
    for df in (
        quality_rules.quality_rules(t), simhash.near_duplicates(t), quality_classifier.classify_quality(t, labels), mixing.mix_sources(t), language_id.identify(language_id.of_documents(t), t.select("lang", "text")),
        sentence_spans.remove_repeated_spans(t), suffix_dedup.remove_repeats(t),
    ):
        assert df.count() == 4
    assert {r.doc_id for r in packing.pack_documents(t, tokenizer_file("word_bpe_49k.json")).collect()} == {None, 7, 8}
    kept = {r.doc_id: len(r.kept) for r in suffix_dedup.remove_repeats(t).where("n_bytes > 0").collect()}
    assert kept[None] == 2 * len(SENTENCES) and kept[8] == 0 and kept[7] == 2 * len(SENTENCES)
    assert {r.doc_id for r in simhash.keep_first(t).collect()} >= {7} and simhash.keep_first(t).where("doc_id = 8").count() == 0


def test_verdicts_and_copies_are_a_row_s_own(spark):
    said = "The quick brown fox and all the others went over the hill to see what was there."
    rows = [(None, "", "en", "a", 0), (None, said, "en", "a", 1), (None, said + " More of it.", "en", "b", 1), (5, None, "en", "a", 0), (5, said + " Again and again.", "en", "a", 1)]
    kept = language_id.accept_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.text for r in kept) == sorted(r[1] for r in rows if r[1])
    rows = [(None if k % 2 else 3, "word " * (k + 1), "en", "abc"[k % 3], 1) for k in range(40)] + [(None, "", "en", "a", 0), (3, None, "en", "b", 0)]
    t = spark.createDataFrame(rows, SCHEMA)
    want = {r["size"]: r.copies for r in mixing.mix_sources(t).collect() if r.copies}
    assert len(want) > 20 and Counter(len(r.text.split()) for r in mixing.repeat_documents(t).collect()) == want


def test_markup_goes_in_one_pass():
    """Against the plain pattern, on random pages; and pages of megabytes that open and never close take seconds."""
    import random
    import time

    plain = re.compile(rb"<(script|style)(?![0-9A-Za-z_\x80-\xff]).*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;", re.S | re.I)
    pieces = [b"<", b">", b"<!--", b"-->", b"<script ", b"<SCRIPT>", b"</script>", b"</Script  >", b"<style", b"</style\n>", b"</style", b"&amp;", b"&", b"&#12;", b"word ", b"scripts", b"<scripts>", b"\xc3\xb6", b"--", b"!", b";"]
    r = random.Random(1)
    for _ in range(3000):
        page = b"".join(r.choice(pieces) for _ in range(r.randrange(25)))
        assert language_id.without_markup(page) == plain.sub(b" ", page), page
    began = time.time()
    for piece in (b"<script ", b"<!-- ", b"<", b"<style>x", b"&amp", b"<a>", b"</script ", b"<!-- <script "):
        language_id.without_markup(piece * (5_000_000 // len(piece)))
    assert time.time() - began < 120


def test_long_page(spark):
    """A page of five megabytes of open marks around its words."""
    page = "<html lang='en'>" + "the words of this page are there for the one that reads them and it is not a lot " * 40
    rows = [(1, "http://a.example.de/x", page + "<script " * 300_000), (2, "http://a.example.de/y", page + "<!-- " * 500_000), (3, None, "<html " * 800_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {x.doc_id: x for x in language_id.identify(language_id.of_pages(pages), docs.select("lang", "text")).collect()}
    assert got[-2].declared == "en" and got[-3].declared == "en" and got[-4].declared in ("", None) and len(got) == 3
