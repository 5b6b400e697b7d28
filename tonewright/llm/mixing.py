"""Mixing sources to target weights by weighted sampling without replacement.

Efraimidis-Spirakis: every document draws an exponential key, ``-ln(u) / w``,
where u is a hash of its id and w its quality weight; taking a source's documents
in order of their keys is weighted sampling without replacement. A source takes
complete epochs of all its documents first, and the rest of its target from the
head of that order, cut where the target is met.

DataFrame and SQL operations only. The prefix sums run in two levels: a source's
keys fall into buckets of about ``BUCKET_ROWS`` rows, whose sums are added up per
source, so no task holds the rows of a large source.

Null and empty texts have size 0 and are never taken; a null source is a source
of its own. Repeated rows, and rows without an id, count each on its own. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize, unused

SHARES = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_EPOCHS = 2
BUCKET_ROWS = 2048
SALTS = 64
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def quality_weight(text: Column) -> Column:
    """0.5 to 1: half the weight goes to texts as their symbols near one in ten characters."""
    marks = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.coalesce(F.lit(1.0) - F.least(F.lit(0.5), F.lit(5.0) * marks / F.greatest(F.length(text), F.lit(1))), F.lit(1.0))


def uniform(doc_id: Column, text: Column) -> Column:
    """(0, 1) from 52 bits of an MD5 of seed and id, or of the text where there is no id."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), F.md5(text)), F.lit("null"))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), name)), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source, source_size, ...) with each source's target, by water-filling in closed form.

    Sources sorted by cap per weight: those before the water line get their cap,
    the others share what is left by weight.
    """
    n = len(SHARES)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.element_at(F.array(*(F.lit(x) for x in SHARES)), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * MOST_EPOCHS)
    t = t.withColumn("budget", F.sum("source_size").over(everything) * TOTAL_SHARE)
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    t = t.withColumn("shares", F.sum("weight").over(after))
    t = t.withColumn("open", F.col("left") * F.col("weight") < F.col("cap") * F.col("shares"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("left").alias("l"), F.col("shares").alias("s")))).over(everything)
    t = t.withColumn("level", level)
    target = F.when(F.col("open"), F.col("level.l") * F.col("weight") / F.col("level.s")).otherwise(F.col("cap").cast("double"))
    return t.select(*sizes.columns, target.cast("double").alias("target"))


def mix_sources(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, weight, source_size, target, taken (words), copies (whole copies, the cut one rounded)."""
    return _mixed(docs, [])


def _mixed(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``mix_sources`` with columns of docs carried along."""
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("bigint")
    rows = docs.select(
        doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"),
        quality_weight(text).alias("weight"), F.xxhash64(text).alias("tie"), uniform(doc_id, text).alias("u"), *carried,
    )
    rows = materialize(rows.withColumn("key", -F.log("u") / F.col("weight")).drop("u"), "mix")
    rows = rows.withColumn("sk", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    totals = rows.groupBy("sk", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = source_targets(totals)

    # exp(-key) lies in (0, 1): equal slices of it hold a source's rows in key order
    slices = F.greatest(F.ceil(F.col("n") / BUCKET_ROWS), F.lit(1))
    # the rows of a large source meet copies of its one row of figures in SALTS places
    spread = targets.drop("source").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = rows.withColumn("salt", F.pmod("tie", F.lit(SALTS)).cast("int")).join(spread, ["sk", "salt"]).drop("salt")
    placed = placed.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * slices))
    buckets = placed.groupBy("sk", "bucket").agg(F.sum("size").alias("bucket_size"))
    run = Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("base", F.coalesce(F.sum("bucket_size").over(run), F.lit(0))).drop("bucket_size")
    within = Window.partitionBy("sk", "bucket").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(buckets, ["sk", "bucket"])

    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("base") - F.col("inside")))
    placed = placed.withColumn("epochs", epochs.cast("bigint")).withColumn("rest", rest).withColumn("part", part)
    return placed.select(
        "doc_id", "source", "size", "weight", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
        F.when(F.col("size") > 0, F.col("epochs") + (2 * F.col("part") >= F.col("size")).cast("int")).otherwise(0).alias("copies"), *carried,
    )


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The documents, each row as many times as its own ``copies``, whether or not ids are null or shared; texts without words are not taken."""
    row, copies, copy = unused([*docs.columns, "doc_id", "source", "size", "weight", "tie", "u", "key"], "row", "copies", "copy")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    counts = _mixed(rows, [row]).select(F.col(row).alias(copy), F.col("copies").cast("int").alias(copies)).where(F.col(copies) > 0)
    taken = rows.join(counts.hint("shuffle_hash"), F.col(row) == F.col(copy)).drop(copy)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    coalesce(1.0 - least(0.5, 5.0 * (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g'))) / greatest(length(text), 1)), 1.0) AS weight,
    (CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null' || md5(text), 'null')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
        CAST(sum(source_size) OVER () AS BIGINT) * 1.5 AS budget FROM s),
c AS (SELECT *, 2 * source_size AS cap,
        budget - coalesce(CAST(sum(2 * source_size) OVER r AS BIGINT), 0) AS lft,
        CAST(sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS shares
      FROM w WINDOW r AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, lft * weight < cap * shares AS open FROM c),
lv AS (SELECT arg_min(lft, cap / weight) AS l, arg_min(shares, cap / weight) AS sh FROM o WHERE open),
t AS (SELECT source, source_size, CASE WHEN open THEN CAST(l * weight / sh AS DOUBLE) ELSE CAST(cap AS DOUBLE) END AS target FROM o, (SELECT max(l) AS l, max(sh) AS sh FROM lv)),
k AS (SELECT d.*, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
        coalesce(CAST(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / weight, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS base
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(round(target - epochs * source_size) AS BIGINT) - base)) AS BIGINT) AS taken
FROM k
"""
