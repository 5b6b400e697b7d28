"""Quality rules by weak supervision.

Each rule looks at a document's statistics and votes good, bad, or abstains.
Expectation-maximisation over the table of vote patterns (at most 3^10 rows,
whatever the corpus size) estimates every rule's accuracy and the share of good
documents; a document is kept when its posterior of being good reaches the
threshold. The rules are crude on purpose: each speaks against some good documents, and what
the others say outvotes it. No rule alone removes a document, except the two hard base limits.

Null and empty texts have no words and fail the base limits; repeated rows are
scored alike, each on its own, with or without an id; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SPACES, materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: Very common words of the four languages, as evidence of prose.
STOP_WORDS = frozenset(
    w.encode()
    for w in (
        "the of and to in is that it was for on with as by at this are from or an be a "
        "der die das und ist von zu den mit im ein nicht auf für sich des dem "
        "le la les de des et un une que qui dans pour est en du sur avec "
        "el los las y en por con para del se su es una no lo"
    ).split()
)
RULES = ("length", "word_length", "symbols", "repeated_lines", "repeated_windows", "stop_words", "sentence_ends", "tables", "capitals", "digits")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_sentence_ends", "n_bars", "n_capitals", "n_digits", "n_bytes")
CAPITALS, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
GOOD, BAD, ABSTAIN = 1, 0, -1


def text_statistics(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop, n_ends, n_bars, n_capitals, n_digits, n_bytes of one text."""
    if not text:
        return (0,) * len(STATS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    ends = sum(x.rstrip(SPACES)[-1] in ".!?" for x in lines)
    low = Counter(words)
    stop = sum(c for w, c in low.items() if w.lower() in STOP_WORDS)
    return n, chars, symbols, dup_lines, repeated_words(words), len(lines), stop, ends, low.get(b"|", 0), *(len(data) - len(data.translate(None, x)) for x in (CAPITALS, DIGITS)), len(data)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which the text holds twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered = np.zeros(len(words), bool)
    at = np.flatnonzero(np.fromiter((seen[w] > 1 for w in windows), bool, len(windows)))
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def rule_votes(s: np.ndarray) -> np.ndarray:
    """Votes (rows x rules) of a matrix of statistics."""
    n, chars, symbols, dup, rep, lines, stop, ends, bars, capitals, digits, size = s.astype(float).T
    per_word, per_line = np.maximum(n, 1), np.maximum(lines, 1)

    def vote(good, bad):
        return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))

    mean = chars / per_word
    return np.stack(
        [
            vote(n >= 100, n < 60),
            vote((mean >= 3) & (mean <= 10), (mean < 2.5) | (mean > 12)),
            vote(symbols <= 0.02 * n, symbols > 0.1 * n),
            vote((dup == 0) & (lines >= 2), dup >= 1),
            vote((rep <= 0.1 * n) & (n >= 20), rep > 0.25 * n),
            vote(stop >= 0.06 * n, (stop < 0.04 * n) & (n >= 20)),
            vote(ends >= 0.5 * per_line, (ends < 0.25 * per_line) & (lines >= 2) & (n >= 20)),
            vote((bars == 0) & (n >= 20), bars > 0.05 * n),
            vote(capitals <= 0.06 * size, capitals > 0.2 * size),
            vote(digits <= 0.01 * size, digits > 0.05 * size),
        ],
        axis=1,
    )


def _score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        s = np.array([text_statistics(t.as_py()) for t in b.column(1)], dtype=np.int64).reshape(-1, len(STATS))
        code = ((rule_votes(s) + 1) * 3 ** np.arange(len(RULES))).sum(axis=1)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s[:, i]) for i in range(len(STATS))), pa.array(code.astype(np.int64))], names=["doc_id", *STATS, "pattern"])


def fit_accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: posterior of each pattern, accuracies (2 x rules: on bad, on good documents), share of good.

    A rule that votes is right with its own probability on good and on bad
    documents; an abstention says nothing. The Beta priors are worth a few documents, so the patterns
    seen decide; they and the start, which counts the votes against, keep class 1 "good".
    """
    votes = (patterns[:, None] // 3 ** np.arange(len(RULES))) % 3 - 1
    good, bad = votes == GOOD, votes == BAD
    prior = np.array([[2.0, 2.0], [4.0, 1.0]])
    post = np.array([0.97, 0.4, 0.05])[np.minimum(bad.sum(axis=1), 2)]
    acc, share = np.full((2, len(RULES)), 0.5), 0.5
    for _ in range(rounds):
        on_good, on_bad = (post * counts)[:, None], ((1 - post) * counts)[:, None]
        right = np.stack([(on_bad * bad).sum(axis=0), (on_good * good).sum(axis=0)])
        wrong = np.stack([(on_bad * good).sum(axis=0), (on_good * bad).sum(axis=0)])
        acc = (right + prior[:, :1]) / (right + wrong + prior.sum(axis=1, keepdims=True))
        share = float(((post * counts).sum() + 1) / (counts.sum() + 2))
        says_good = np.log(acc[1]) - np.log1p(-acc[0])
        says_bad = np.log1p(-acc[1]) - np.log(acc[0])
        logit = np.log(share) - np.log1p(-share) + (good * says_good + bad * says_bad).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(logit, -700, 700)))
        done, post = np.abs(new - post).max(initial=0) < 1e-9, new
        if done:
            break
    return post, acc, share


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: statistics, posterior probability of good quality, base_failed, kept."""
    spark = docs.sparkSession
    schema = ", ".join(["doc_id bigint", *(f"{c} bigint" for c in STATS), "pattern bigint"])
    scored = materialize(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_score_batches, schema), "rules")
    table = scored.groupBy("pattern").count().collect()  # at most 3^10 rows
    patterns, counts = (np.array([r[k] for r in table], dtype=np.int64) for k in ("pattern", "count"))
    post, _, _ = fit_accuracies(patterns, counts)
    found = spark.createDataFrame([(int(p), float(q)) for p, q in zip(patterns, post)], "pattern bigint, posterior double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        scored.join(F.broadcast(found), "pattern")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
        .drop("pattern")
    )
