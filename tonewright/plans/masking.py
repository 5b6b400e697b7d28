"""Masking, transient and measurement queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import measures as M, psychoacoustics as P
from .registry import SQL, query, sql_list, table
from ..functions.tables import LONG_44
from ..functions.psychoacoustics import bark, spreading

EDGES = LONG_44[: next(k for k, e in enumerate(LONG_44) if e >= 64) + 1]  # the bands that a vector of 64 lines reaches; zeros fill the last one
LINE_HZ = 44100 / 1152
_B = list(zip(EDGES, EDGES[1:]))
_Z = [bark((a + b) * 0.5 * LINE_HZ) for a, b in _B]
_SPREAD = []
for _i, (_a, _b) in enumerate(_B):
    _raw = [spreading(_Z[_i] - z) for z in _Z]
    _norm = sum(r * (b - a) for r, (a, b) in zip(_raw, _B)) / (_b - _a)
    _SPREAD += [(_i, j, r / _norm) for j, r in enumerate(_raw) if r]

_BANDS = f"""lines AS (SELECT vec_id, k, coalesce(CAST(embedding[k + 1] AS DOUBLE), 0) AS x FROM embeddings, (SELECT unnest(range({EDGES[-1]})) AS k)),
  dim AS (SELECT unnest(range({len(_B)})) AS band, unnest({sql_list(a for a, _ in _B)}) AS lo, unnest({sql_list(b for _, b in _B)}) AS hi, unnest({sql_list(map(repr, _Z))}) AS z),
  bands AS (SELECT vec_id, band, z, hi - lo AS width, sum(x * x) AS energy, exp(avg(ln(x * x + 1e-30))) AS geo FROM lines JOIN dim ON k >= lo AND k < hi GROUP BY ALL),
  ton AS (SELECT *, CASE WHEN energy <= 1e-30 THEN 0 ELSE least(greatest(10 * log10(geo / (energy / width)) / -25, 0), 1) END AS tonality FROM bands),
  spr AS (SELECT unnest({sql_list(b for b, _, _ in _SPREAD)}) AS band, unnest({sql_list(j for _, j, _ in _SPREAD)}) AS masker, unnest({sql_list(repr(w) for _, _, w in _SPREAD)}) AS weight),
  sums AS (SELECT e.vec_id, s.band, sum(e.energy * s.weight) AS spread FROM bands e JOIN spr s ON e.band = s.masker GROUP BY 1, 2),
  masks AS (SELECT t.vec_id, t.band, t.width, t.energy, t.tonality, greatest(s.spread * pow(10, -(t.tonality * (14.5 + t.z) + (1 - t.tonality) * 5.5) / 10), 1e-9) AS threshold FROM ton t JOIN sums s ON t.vec_id = s.vec_id AND t.band = s.band)"""


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = F.transform(F.sequence(F.lit(0), F.lit(EDGES[-1] - 1)), lambda k: F.coalesce(F.get("embedding", k).cast("double"), F.lit(0.0)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(filled).alias("k", "x"))


@query(f"WITH {_BANDS} SELECT vec_id, CAST(band AS INTEGER) AS band, round(energy, 7) AS energy, round(tonality, 6) + 0.0 AS tonality FROM ton")
def band_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.band_statistics(spectrum(spark, sf_dir), ["vec_id"], EDGES, LINE_HZ)
    return t.select("vec_id", "band", F.round("energy", 7).alias("energy"), (F.round("tonality", 6) + 0.0).alias("tonality"))


@query(f"WITH {_BANDS} SELECT vec_id, CAST(band AS INTEGER) AS band, round(threshold, 7) AS threshold FROM masks")
def masking_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.thresholds(P.band_statistics(spectrum(spark, sf_dir), ["vec_id"], EDGES, LINE_HZ), ["vec_id"], EDGES, LINE_HZ, quiet=F.lit(1e-9))
    return t.select("vec_id", "band", F.round("threshold", 7).alias("threshold"))


@query(f"WITH {_BANDS} SELECT vec_id, round(sum(CASE WHEN energy > threshold THEN width * log2(1 + sqrt(energy / threshold)) ELSE 0 END), 5) AS entropy FROM masks GROUP BY vec_id")
def perceptual_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.thresholds(P.band_statistics(spectrum(spark, sf_dir), ["vec_id"], EDGES, LINE_HZ), ["vec_id"], EDGES, LINE_HZ, quiet=F.lit(1e-9))
    return P.entropy(t, ["vec_id"]).select("vec_id", F.round("entropy", 5).alias("entropy"))


@query(
    f"""WITH {_BANDS}, m AS (SELECT vec_id // 2 AS pair, band, min(threshold) AS threshold, count(*) AS n FROM masks GROUP BY 1, 2),
    p AS (SELECT vec_id // 2 AS pair, k, (max(CASE WHEN vec_id % 2 = 0 THEN x END) + max(CASE WHEN vec_id % 2 = 1 THEN x END)) / sqrt(2) AS m, (max(CASE WHEN vec_id % 2 = 0 THEN x END) - max(CASE WHEN vec_id % 2 = 1 THEN x END)) / sqrt(2) AS s FROM lines GROUP BY 1, 2),
    e AS (SELECT pair, band, hi - lo AS width, sum(m * m) AS em, sum(s * s) AS es FROM p JOIN dim ON k >= lo AND k < hi GROUP BY ALL),
    ms AS (SELECT pair, sum(CASE WHEN em > threshold THEN width * log2(1 + sqrt(em / threshold)) ELSE 0 END + CASE WHEN es > threshold THEN width * log2(1 + sqrt(es / threshold)) ELSE 0 END) AS pe FROM e JOIN m USING (pair, band) GROUP BY 1),
    lr AS (SELECT vec_id // 2 AS pair, sum(CASE WHEN energy > threshold THEN width * log2(1 + sqrt(energy / threshold)) ELSE 0 END) AS pe FROM masks GROUP BY 1)
    SELECT CAST(pair AS BIGINT) AS pair, round(ms.pe, 4) AS pe_ms, round(lr.pe, 4) AS pe_lr, ms.pe < lr.pe AS mid_side FROM ms JOIN lr USING (pair) WHERE ms.pe IS NOT NULL"""
)
def mid_side_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mid/side where its entropy under the lower of both thresholds is less than left/right's."""
    lines = spectrum(spark, sf_dir).withColumn("pair", F.floor(F.col("vec_id") / 2)).withColumn("ch", F.col("vec_id") % 2)
    t = P.mid_side_choice(lines, ["pair"], "ch", EDGES, LINE_HZ, quiet=F.lit(1e-9))
    return t.select("pair", F.round("pe_ms", 4).alias("pe_ms"), F.round("pe_lr", 4).alias("pe_lr"), "mid_side")


_SEGMENTS = """d AS (SELECT event_id, event_id // 64 AS seg, CAST(round(value * 100) AS BIGINT) AS v FROM events),
  x AS (SELECT event_id, seg, v - coalesce(lag(v) OVER (PARTITION BY seg ORDER BY event_id), 0) AS h FROM d),
  e AS (SELECT seg // 157 AS stream, seg, CAST(sum(h * h) AS BIGINT) AS energy FROM x GROUP BY 1, 2),
  p AS (SELECT *, CAST(sum(energy) OVER w AS BIGINT) AS past_sum, count(*) OVER w AS past_n FROM e WINDOW w AS (PARTITION BY stream ORDER BY seg ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)),
  a AS (SELECT *, energy > 64 AND 10 * energy * greatest(past_n, 1) > 11 * greatest(coalesce(past_sum, energy), 6 * greatest(past_n, 1)) AS attack FROM p)"""


@query(f"WITH {_SEGMENTS} SELECT CAST(stream AS BIGINT) AS stream, CAST(seg AS BIGINT) AS seg, energy, coalesce(past_sum, energy) AS past_sum, attack FROM a")
def transient_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energies of differences in segments of 64 against the mean of the nine before; whole numbers, so sums are exact."""
    return P.transients(_pcm(spark, sf_dir), factor=(11, 10), floor=64).select("stream", "seg", "energy", "past_sum", "attack")


def _pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 64).alias("seg"), F.round(F.col("value") * 100).cast("bigint").alias("v"))
    return t.withColumn("stream", F.floor(F.col("seg") / 157))


@query(
    f"""WITH RECURSIVE {_SEGMENTS}, g AS (SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY seg) AS n, attack, coalesce(lead(attack) OVER (PARTITION BY stream ORDER BY seg), false) AS next FROM a),
    r AS (SELECT stream, n, CASE WHEN attack OR next THEN 1 ELSE 0 END AS kind FROM g WHERE n = 1
      UNION ALL SELECT g.stream, g.n, CASE WHEN g.attack AND r.kind IN (1, 2) THEN 2 WHEN r.kind = 1 THEN 2 WHEN r.kind = 2 AND g.next THEN 2 WHEN r.kind = 2 THEN 3 WHEN g.attack OR g.next THEN 1 ELSE 0 END FROM r JOIN g ON g.stream = r.stream AND g.n = r.n + 1)
    SELECT CAST(stream AS BIGINT) AS stream, CAST(n AS INTEGER) AS n, CAST(kind AS INTEGER) AS kind FROM r"""
)
def block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The automaton normal 0, start 1, short 2, stop 3 over each stream's attacks: an ordered fold."""
    t = P.transients(_pcm(spark, sf_dir), factor=(11, 10), floor=64)
    return P.block_types(t, ["stream"], "seg", "attack").select("stream", "n", "kind")


@query(SQL["block_types"])
def block_types_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a parallel prefix over chunks of fifty granules."""
    t = P.transients(_pcm(spark, sf_dir), factor=(11, 10), floor=64).withColumn("at", F.col("seg") % 157)
    return P.block_type_scan(t, ["stream"], "at", "attack", 50).select("stream", (F.col("at") + 1).cast("int").alias("n"), "kind")


_CHAINS = "c AS (SELECT event_id // 500 AS stream, event_id % 500 AS n, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) AS k, event_id % 11 = 0 AS short, 1 + abs(value) AS allowed, CAST(floor(abs(value) * 100) AS BIGINT) % 401 - 200 AS change FROM events)"


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    return t.select(F.floor(F.col("event_id") / 500).alias("stream"), (F.col("event_id") % 500).alias("n"), "event_id", "value")


@query(
    f"""WITH RECURSIVE {_CHAINS}, r AS (SELECT stream, n, k, short, allowed AS held FROM c WHERE k = 1
      UNION ALL SELECT c.stream, c.n, c.k, c.short, CASE WHEN c.short OR r.short THEN c.allowed ELSE greatest(least(c.allowed, 2 * r.held), 5.0) END FROM r JOIN c ON c.stream = r.stream AND c.k = r.k + 1)
    SELECT CAST(stream AS BIGINT) AS stream, CAST(n AS BIGINT) AS n, held FROM r"""
)
def pre_echo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed noise held to twice that of the granule before, itself held; a short block clears the memory. Chunks of sixty-four granules, composed."""
    from ..operators import codec

    t = _chains(spark, sf_dir)
    masks = t.select(F.col("stream").cast("string").alias("stream_id"), F.lit(0).alias("channel"), F.col("n").alias("granule"), F.when(F.col("event_id") % 11 == 0, 2).otherwise(0).alias("block_type"), F.array().cast("array<float>").alias("x"), F.array(1 + F.abs("value")).alias("allowed"))
    done = codec.pre_echo(masks, [5.0], 64)
    return done.select(F.col("stream_id").cast("bigint").alias("stream"), F.col("granule").alias("n"), F.get("allowed", F.lit(0)).alias("held"))


@query(
    f"""WITH RECURSIVE {_CHAINS}, r AS (SELECT stream, n, k, greatest(0, least(change, 511)) AS level FROM c WHERE k = 1
      UNION ALL SELECT c.stream, c.n, c.k, greatest(0, least(r.level + c.change, 511)) FROM r JOIN c ON c.stream = r.stream AND c.k = r.k + 1)
    SELECT CAST(stream AS BIGINT) AS stream, CAST(n AS BIGINT) AS n, CAST(level AS BIGINT) AS level FROM r"""
)
def reservoir_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free bytes of the reservoir behind each frame, chunks of sixty-four frames, composed."""
    from ..operators import streams

    t = _chains(spark, sf_dir).withColumn("change", F.floor(F.abs("value") * 100) % 401 - 200)
    return streams.reservoir_levels(t.select("stream", "n", "change"), ["stream"], "n", "change", 511, 64).select("stream", "n", "level")


@query(
    """WITH p AS (SELECT event_id // 256 AS segment, CAST(round(value * 1000) AS BIGINT) AS v, CAST(round(value * 1000) AS BIGINT) // 8 * 8 AS ref FROM events),
    e AS (SELECT segment, count(*) AS n, CAST(sum((v - ref) * (v - ref)) AS BIGINT) AS err, max(abs(v - ref)) AS worst, CAST(sum(v * v) AS BIGINT) AS power FROM p GROUP BY 1)
    SELECT CAST(segment AS BIGINT) AS segment, n, round(sqrt(err / CAST(n AS DOUBLE)) / 1000000, 12) AS rms, worst / 1000000.0 AS worst, round(10 * log10(power / CAST(nullif(err, 0) AS DOUBLE)), 6) AS snr,
      CASE WHEN sqrt(err / CAST(n AS DOUBLE)) / 1000000 < pow(2, -15) / sqrt(12) AND worst / 1000000.0 <= pow(2, -14) THEN 'full' WHEN sqrt(err / CAST(n AS DOUBLE)) / 1000000 < pow(2, -11) / sqrt(12) THEN 'limited' ELSE 'FAIL' END AS verdict FROM e"""
)
def conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMS and greatest error of a signal against a coarser copy of itself, with the verdict of the standard's bounds."""
    v = F.round(F.col("value") * 1000).cast("bigint")
    t = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 256).alias("segment"), v.alias("v"), (F.floor(v / 8) * 8).alias("ref"))
    return M.judge(t, ["segment"], "v", "ref", scale=1_000_000)


@query(
    f"""WITH {_BANDS}, r AS (SELECT vec_id % 10 AS stream, 10 * log10(energy * 0.05 / threshold) AS nmr FROM masks WHERE energy > 0),
    o AS (SELECT stream, nmr, row_number() OVER (PARTITION BY stream ORDER BY nmr) AS rank, count(*) OVER (PARTITION BY stream) AS n FROM r)
    SELECT CAST(stream AS BIGINT) AS stream, CAST(max(n) AS BIGINT) AS n, round(avg(nmr), 6) AS mean_db, round(max(CASE WHEN rank = n * 95 // 100 + 1 THEN nmr END), 6) AS p95_db, round(avg(CASE WHEN nmr > 0 THEN 1.0 ELSE 0 END), 6) AS share_over FROM o GROUP BY 1"""
)
def noise_to_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise-to-mask ratio of a noise at a twentieth of the energy: mean, 95th percentile by rank, share over the mask."""
    t = P.thresholds(P.band_statistics(spectrum(spark, sf_dir), ["vec_id"], EDGES, LINE_HZ), ["vec_id"], EDGES, LINE_HZ, quiet=F.lit(1e-9)).where("energy > 0")
    return M.noise_to_mask(t.select((F.col("vec_id") % 10).alias("stream"), (F.col("energy") * 0.05).alias("noise"), "threshold"), ["stream"])


@query(
    """SELECT l_partkey, round(13 * atan(0.00076 * f) + 3.5 * atan(pow(f / 7500.0, 2)), 8) AS bark, round(least(3.64 * pow(greatest(f, 20.0) / 1000, -0.8) - 6.5 * exp(-0.6 * pow(greatest(f, 20.0) / 1000 - 3.3, 2)) + 0.001 * pow(greatest(f, 20.0) / 1000, 4), 110), 7) AS quiet_db
    FROM (SELECT DISTINCT l_partkey, CAST(l_partkey * 9 AS DOUBLE) AS f FROM lineitem)"""
)
def hearing_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bark value and threshold in quiet of frequencies."""
    from ..functions.psychoacoustics import bark_column, quiet_db_column

    t = table(spark, sf_dir, "lineitem").select("l_partkey").distinct().withColumn("f", (F.col("l_partkey") * 9).cast("double"))
    return t.select("l_partkey", F.round(bark_column(F.col("f")), 8).alias("bark"), F.round(quiet_db_column(F.col("f")), 7).alias("quiet_db"))
