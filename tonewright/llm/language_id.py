"""Language ID by Bayesian evidence fusion.

Text likelihoods (hashed character trigrams, counted per language over the whole
training table) meet three other pieces of evidence: the declared language, the
address suffix, and a prior of the host that is smoothed towards its domain's,
and the domain's towards the corpus's. How far each can be trusted is itself
counted, against the languages that the texts alone suggest, by grouped
aggregation; a row's own vote is taken out of its host's and domain's counts.

Beside the languages stands the class ``other``: letters as frequent as in the corpus, but in no language's order. Text in
another language, or gibberish, is likelier there. The training texts are dealt into two halves by a
hash of the text, and each half is scored by what the other taught, so a row's declaration is no evidence twice.

A row is kept when it has letters, its best class is a language, and the posterior of that reaches
the threshold; of equal posteriors the first class in the order of ``CLASSES`` is the best. Null and empty texts have no text evidence and are not kept;
null or unknown declarations, hosts and suffixes are evidence of nothing but their
own kind. Repeated rows and rows without an id each count. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import drop, materialize, unused

LANGUAGES = ("de", "en", "es", "fr")
BUCKETS = 1 << 15
OTHER = "other"
CLASSES = (*LANGUAGES, OTHER)
FOLDS = 2
BASE = 2000.0  # trigrams that the letters' frequencies alone stand for in each language's table
NOISE = 0.1  # the share of any text's trigrams that follow no language: names, keys, numbers
TEMPER = 1 / 3  # overlapping trigrams tell each letter three times
SMOOTH = 4.0
THRESHOLD = 0.5
SALTS = 16
CHUNK = 1 << 20
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[np.r_[0:65, 91:97, 123:128]] = 32  # digits, marks and white space are one border
_MARK = re.compile(rb"<|&[a-z#0-9]+;", re.I)
_RAW = re.compile(rb"<(script|style)(?![0-9A-Za-z_\x80-\xff])", re.I)
_RAW_ENDS = {b"script": re.compile(rb"</script\s*>", re.I), b"style": re.compile(rb"</style\s*>", re.I)}


def without_markup(page: bytes) -> bytes:
    """A page with a space in place of each tag, comment, script, style sheet and entity; what is opened and never closed stays as text.

    One pass: closing marks are looked for from the last place on, and no more once there is none behind.
    """
    out, at, none = [], 0, set()

    def end_of(kind: bytes, start: int) -> int | None:
        """Behind the next closing mark of a kind."""
        if kind in none:
            return None
        if kind in _RAW_ENDS:
            found = _RAW_ENDS[kind].search(page, start)
            stop = found.end() if found else 0
        else:
            stop = page.find(kind, start) + len(kind)
            stop = 0 if stop < len(kind) else stop
        if not stop:
            none.add(kind)
        return stop or None

    while found := _MARK.search(page, at):
        start = found.start()
        if page[start] != 60:
            stop = found.end()
        else:
            raw, stop = _RAW.match(page, start), None
            if raw:
                stop = end_of(raw[1].lower(), raw.end())
            elif page.startswith(b"<!--", start):
                stop = end_of(b"-->", start + 4)
            stop = stop or end_of(b">", start + 1)
        if stop is None:
            out.append(page[at : start + 1])
            at = start + 1
        else:
            out += page[at:start], b" "
            at = stop
    return b"".join([*out, page[at:]])


def trigrams(data: np.ndarray) -> np.ndarray:
    """Buckets of the folded byte trigrams of a text; those with two borders or more say nothing and are left out."""
    if len(data) < 1:
        return np.zeros(0, np.int64)
    f = _FOLD[np.r_[np.uint8(32), data, np.uint8(32)]]
    code, counts = _codes(f[:-2], f[1:-1], f[2:])
    return code[counts]


def _codes(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of folded trigrams, and which of them count."""
    code = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    borders = (a == 32).astype(np.uint8) + (b == 32) + (c == 32)
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (code >> np.uint32(17)).astype(np.int64), borders < 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language number, fold, text) to counts per table and bucket, one row each per task; buckets from ``BUCKETS`` on count folded bytes."""
    total = np.zeros((len(LANGUAGES) * FOLDS, BUCKETS + 256), np.int64)
    for b in batches:
        for k, fold, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            data = np.frombuffer((text.as_py() or "").encode("utf-8", "replace"), np.uint8)
            for at in range(0, len(data), CHUNK):
                part, row = data[at : at + CHUNK], total[k * FOLDS + fold]
                row[:BUCKETS] += np.bincount(trigrams(part), minlength=BUCKETS)
                row[BUCKETS:] += np.bincount(_FOLD[part], minlength=256)
    table, bucket = np.nonzero(total)
    if len(table):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (table, bucket, total[table, bucket])], names=["tab", "bucket", "n"])


def _fold(text: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(FOLDS))


def letters_alone(frequency: np.ndarray) -> np.ndarray:
    """The share of each bucket among trigrams of independent folded bytes."""
    known = np.unique(_FOLD).astype(np.uint8)
    share = np.zeros(256)
    share[known] = (frequency[known] + 0.5) / (frequency[known] + 0.5).sum()
    out, two = np.zeros(BUCKETS), share[known][:, None] * share[known]
    for first in known:
        # the trigrams of first, x, y for all x and y: borders of a lone text are left out as in trigrams()
        f = [np.full(two.shape, first, np.uint32), np.broadcast_to(known[:, None], two.shape).astype(np.uint32), np.broadcast_to(known, two.shape).astype(np.uint32)]
        code, counts = _codes(*f)
        out += np.bincount(code[counts], weights=(share[first] * two)[counts], minlength=BUCKETS)
    return out / out.sum()


def train(texts: DataFrame) -> np.ndarray:
    """From a table (lang, text), counted over all its rows: how much likelier a trigram is in a language than its letters alone make it (logs; folds x languages x buckets).

    The tables of a fold are counted over the texts of all others.
    """
    number = F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("lang")) - 1
    text = F.col("text").cast("string")
    rows = texts.where(F.col("lang").isin(*LANGUAGES)).select(number.cast("bigint").alias("k"), _fold(text).cast("bigint").alias("f"), text.alias("text"))
    counts = rows.mapInArrow(_count, "tab bigint, bucket bigint, n bigint").groupBy("tab", "bucket").agg(F.sum("n").alias("n"))
    table = np.zeros((len(LANGUAGES) * FOLDS, BUCKETS + 256))
    found = counts.toPandas()  # at most languages x folds x buckets rows
    table[found["tab"].to_numpy(int), found["bucket"].to_numpy(int)] = found["n"].to_numpy(float)
    table = table.reshape(len(LANGUAGES), FOLDS, -1).swapaxes(0, 1)
    out = []
    for f in range(FOLDS):
        seen = np.delete(table, f, axis=0).sum(axis=0)
        alone = np.maximum(letters_alone(seen[:, BUCKETS:].sum(axis=0)), 1e-12)
        c = seen[:, :BUCKETS]
        likelier = (c + BASE * alone) / (c.sum(axis=1, keepdims=True) + BASE) / alone
        out.append(np.log((1 - NOISE) * likelier + NOISE))
    return np.array(out, np.float32)


def score_texts(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """(doc_id, text, markup, declared, host, suffix) to the same without text and markup, with letters and ll (per language, against ``other``).

    ``markup`` says that the text is a page, whose tags are taken out.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.ascontiguousarray(t.T) for t in shared.value]
        for b in batches:
            out, letters = np.zeros((b.num_rows, len(LANGUAGES))), np.zeros(b.num_rows, np.int64)
            for r, (text, markup, fold) in enumerate(zip(b.column(1), b.column(2).to_pylist(), b.column(6).to_pylist())):
                s = (text.as_py() or "").encode("utf-8", "replace")
                data = np.frombuffer(without_markup(s) if markup else s, np.uint8)
                for at in range(0, len(data), CHUNK):
                    seen = trigrams(data[at : at + CHUNK])
                    out[r] += tables[fold][seen].sum(axis=0, dtype=np.float64)
                    letters[r] += len(seen)
            cols = [b.column(0), *(b.column(k) for k in (3, 4, 5)), pa.array(letters), *(pa.array(out[:, k]) for k in range(len(LANGUAGES)))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "declared", "host", "suffix", "letters", *(f"ll_{x}" for x in LANGUAGES)])

    schema = "doc_id bigint, declared string, host string, suffix string, letters bigint, " + ", ".join(f"ll_{x} double" for x in LANGUAGES)
    return rows.select("doc_id", "text", "markup", "declared", "host", "suffix", _fold(F.col("text")).cast("int").alias("fold")).mapInArrow(run, schema)


def _votes(keys: list[str], t: DataFrame, name: str) -> DataFrame:
    return t.groupBy(*keys).agg(*(F.sum((F.col("best") == x).cast("double") * F.col("votes")).alias(f"{name}_{x}") for x in CLASSES))


def _total(name: str) -> Column:
    return sum((F.col(f"{name}_{x}") for x in CLASSES), F.lit(0.0))


def fuse(scored: DataFrame) -> DataFrame:
    """Scored rows to doc_id, language, posterior, kept and the evidence.

    Likelihoods of a declaration or suffix under a language are smoothed counts
    over all rows; their tables, and those of hosts and domains, are aggregated first
    and joined with salt, so a host with a third of all rows spreads over tasks.
    """
    text = {x: F.col(f"ll_{x}") * TEMPER for x in LANGUAGES} | {OTHER: F.lit(0.0)}
    top = F.greatest(*text.values())
    t = scored.withColumn("top", top)
    for x in CLASSES:
        t = t.withColumn(f"t_{x}", text[x] - F.col("top"))
    best = F.coalesce(*(F.when(F.col(f"t_{x}") >= 0, x) for x in CLASSES))
    t = t.withColumn("best", F.when(F.col("letters") > 0, best)).withColumn("votes", (F.col("letters") > 0).cast("double"))
    t = t.withColumn("declared", F.coalesce(F.lower(F.substring("declared", 1, 2)), F.lit("")))
    t = t.withColumn("suffix", F.coalesce(F.lower("suffix"), F.lit(""))).withColumn("host", F.coalesce(F.lower("host"), F.lit("")))
    t = t.withColumn("domain", F.concat_ws(".", F.slice(F.reverse(F.split("host", r"\.")), 1, 2)))
    t = t.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    kinds = t.groupBy("host", "domain", "declared", "suffix", "best").agg(F.sum("votes").alias("votes"))
    kinds = materialize(kinds.where("best is not null"), "evidence")
    hosts = _votes(["host", "domain"], kinds, "h")
    domains = _votes(["domain"], kinds, "d")
    declared, suffix = _votes(["declared"], kinds, "c"), _votes(["suffix"], kinds, "s")
    overall = kinds.groupBy().agg(*(F.coalesce(F.sum((F.col("best") == x).cast("double") * F.col("votes")), F.lit(0.0)).alias(f"g_{x}") for x in CLASSES)).first()
    world = {x: (overall[f"g_{x}"] + 1) / (sum(overall) + len(CLASSES)) for x in CLASSES}
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    places = hosts.join(domains, "domain").drop("domain").withColumn("salt", spread)
    for side, keys in ((places, ["host", "salt"]), (declared.withColumn("salt", spread), ["declared", "salt"]), (suffix.withColumn("salt", spread), ["suffix", "salt"])):
        t = t.join(side, keys, "left")
    for name in "hdcs":
        t = t.fillna(0.0, [f"{name}_{x}" for x in CLASSES])

    mine = {x: F.coalesce((F.col("best") == x).cast("double"), F.lit(0.0)) for x in CLASSES}
    own = sum(mine.values(), F.lit(0.0))
    logs = {}
    for x in CLASSES:
        domain = (F.col(f"d_{x}") - mine[x] + SMOOTH * world[x]) / (_total("d") - own + SMOOTH)
        prior = (F.col(f"h_{x}") - mine[x] + SMOOTH * domain) / (_total("h") - own + SMOOTH)
        n = overall[f"g_{x}"]
        says = lambda name: F.log((F.col(f"{name}_{x}") - mine[x] + 1.0) / (n + len(CLASSES)))  # noqa: E731, B023
        logs[x] = F.col(f"t_{x}") + F.log(F.greatest(prior, F.lit(1e-9))) + says("c") + says("s")
    t = t.select("doc_id", "declared", "host", "suffix", "letters", "best", *(logs[x].alias(f"p_{x}") for x in CLASSES))
    t = materialize(t, "fused")  # in one expression with what follows, the generated code outgrows the compiler
    drop(kinds)
    most = F.greatest(*(F.col(f"p_{x}") for x in CLASSES))
    mass = sum((F.exp(F.col(f"p_{x}") - most) for x in CLASSES), F.lit(0.0))
    language = F.coalesce(*(F.when(F.col(f"p_{x}") >= most, x) for x in CLASSES))
    t = t.withColumn("language", language).withColumn("posterior", 1 / mass)
    kept = (F.col("letters") > 0) & (F.col("language") != OTHER) & (F.col("posterior") >= THRESHOLD)
    return t.select("doc_id", "language", "posterior", kept.alias("kept"), F.col("best").alias("text_language"), "declared", "host", "suffix", "letters")


def of_documents(docs: DataFrame) -> DataFrame:
    """Documents as evidence: the lang column declares, the source is the host."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(False).alias("markup"),
        F.col("lang").cast("string").alias("declared"), F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("suffix"),
    )


def of_pages(pages: DataFrame) -> DataFrame:
    """Pages as evidence: the html element's lang declares; host and suffix come from the address. doc_id is -1 - page_id."""
    host = F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    empty = lambda c: F.when(c != "", c)
    return pages.select(
        (-1 - F.col("page_id").cast("bigint")).alias("doc_id"), F.col("html").cast("string").alias("text"), F.lit(True).alias("markup"),
        empty(F.regexp_extract(F.regexp_extract(F.col("html").cast("string"), "(?i)<html([^>]*)", 1), r"""(?i)\slang\s*=\s*["']?([a-zA-Z]{2})""", 1)).alias("declared"),
        empty(host).alias("host"), empty(F.regexp_extract(host, r"\.([^.]+)$", 1)).alias("suffix"),
    )


def identify(rows: DataFrame, training: DataFrame) -> DataFrame:
    """Languages of evidence rows; ``training``: (lang, text)."""
    scored = materialize(score_texts(rows, train(training)), "languages")
    done = fuse(scored)
    drop(scored)  # what fuse returns reads its own table
    return done


def accept_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language is told with enough certainty."""
    rows = of_documents(docs)
    # a verdict follows from the evidence alone, so it goes by a hash of that; ids may be null or shared
    key = lambda names: F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names))
    found = identify(rows.withColumn("doc_id", key(("text", "declared", "host"))), docs.select("lang", "text"))
    (name,) = unused(docs.columns, "rejected")
    rejected = materialize(found.where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct(), "rejected")
    return docs.join(rejected, key(("text", "lang", "source")) == F.col(name), "left_anti")
