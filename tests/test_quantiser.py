"""The quantiser against a plain one that tries every step, every variant and every split; prefixes against one pass in order; the model against its DataFrame form."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright.functions.tables import PRETAB, SLEN1, SLEN2, band_edges
from tonewright.operators import analysis, codec, encoder, filterbank, layer3, ordered, psychoacoustics as P, quantiser
from tonewright.operators.quantiser import MOST_VALUE, ROUND_UP
from tonewright.sources import sideinfo

from .test_layer3 import codes


def plain_choose(ix, rate, kind, book):
    """Fewest bits over all splits and tables, value by value."""
    size = [abs(int(v)) for v in ix]
    end = max((k + 1 for k, v in enumerate(size) if v), default=0)
    big = max((k // 2 * 2 + 2 for k, v in enumerate(size) if v > 1), default=0)
    fours = -(-max(end - big, 0) // 4)
    if big + 4 * fours > 576:
        big, fours = end + end % 2, 0
    long, short = band_edges(rate)

    def region(a, b):
        a, b = min(a, big), min(b, big)
        if not any(size[a:b]):
            return 0
        best = None
        for t in sorted(book.pairs):
            linbits, words = book.pairs[t]
            lengths = {v: n for (n, _), v in words.items()}
            if not t or max(size[a:b]) > (max(map(max, lengths)) + (1 << linbits) - 1 if linbits else max(map(max, lengths))):
                continue
            bits = sum(lengths[min(x, 15), min(y, 15)] + (x > 0) + (y > 0) + linbits * ((x >= 15) + (y >= 15)) * (linbits > 0) for x, y in zip(size[a:b:2], size[a + 1 : b : 2]))
            best = bits if best is None or bits < best else best
        return best

    if kind:
        cut = 3 * short[3] if kind == 2 else long[8]
        pairs = region(0, cut) + region(cut, 576)
    else:
        pairs = min(region(0, long[min(a + 1, 22)]) + region(long[min(a + 1, 22)], long[min(a + b + 2, 22)]) + region(long[min(a + b + 2, 22)], 576) for a in range(16) for b in range(8))
    quads = [tuple((size + [0] * 4)[big + 4 * k : big + 4 * k + 4]) for k in range(fours)]
    return pairs + min(sum({v: n for (n, _), v in t.items()}[q] + sum(q) for q in quads) for t in book.quads)


def plain_quantise(x, allowed, rate, kind, book):
    """(clipped, bits, number of the variant) of the best variant, and all that it consists of."""
    short = kind == 2
    cell, _, most, window = quantiser.cells(rate, short)
    size, n = np.abs(x), len(most)
    noise = lambda at, s: float(((size[at] - np.minimum(np.floor(size[at] ** 0.75 * 2 ** (-3 * s / 16) + ROUND_UP), MOST_VALUE) ** (4 / 3) * 2 ** (s / 4)) ** 2).sum())
    steps, floor = {}, []
    for b in range(n):
        at = cell == b
        if not size[at].any():
            continue
        finest = int(np.ceil(4 * np.log2(size[at].max()) - 16 / 3 * np.log2(MOST_VALUE + 0.5)))
        if most[b] < 0 or (size[at] ** 2).sum() <= allowed[b]:
            floor.append(finest)
        else:
            steps[b] = max([s for s in range(finest, 61) if noise(at, s) <= allowed[b]], default=finest)
    found = []
    for order, (scale, pre) in enumerate([(0, 0), (1, 0)] if short or rate < 32000 else [(0, 0), (1, 0), (0, 1), (1, 1)]):
        m, tab = 4 if scale else 2, [PRETAB[b] * pre if not short else 0 for b in range(n)]
        base = {}
        for w in sorted({int(window[b]) for b in steps}):
            mine = [b for b in steps if window[b] == w]
            base[w] = min(max(steps[b] for b in mine), min(steps[b] + m * (int(most[b]) + tab[b]) for b in mine))
        gain = min(max(max([max(base.values(), default=45), *floor]) + 210, 0), 255) if steps or floor else 0
        windows = [min(max((gain - 210 - base[w]) // 8, 0), 7) if short and w in base else 0 for w in range(3)]
        sf, clipped = [0] * n, False
        for b, s in steps.items():
            need = max(-((s - (gain - 210 - 8 * windows[window[b]] * short)) // m) - tab[b], 0)
            sf[b], clipped = min(need, int(most[b])), clipped or need > most[b]
        while True:
            step = np.array([gain - 210 - 8 * windows[window[b]] * short - m * (sf[b] + tab[b]) for b in range(n)])
            ix = np.floor(size**0.75 * 2.0 ** (-3 * step[cell] / 16) + ROUND_UP)
            if ix.max() <= MOST_VALUE or gain >= 255:
                break
            gain += 1
        if rate < 32000:
            groups = np.split(np.array(sf[: 36 if short else 21]), [9, 18, 27] if short else [6, 11, 16])
            fac = sum(int(g.max()).bit_length() * len(g) for g in groups)
        else:
            k = 18 if short else 11
            need = [int(max(p)).bit_length() for p in (sf[:k], sf[k : 36 if short else 21])]
            fac = min(k * a + (18 if short else 10) * b for a, b in zip(SLEN1, SLEN2) if a >= need[0] and b >= need[1])
        found.append((clipped, fac + plain_choose(ix, rate, kind, book), order, gain, sf, windows, scale, pre, (np.sign(x) * np.minimum(ix, MOST_VALUE)).astype(int).tolist()))
    return min(found, key=lambda f: f[:3])


@pytest.mark.parametrize("rate", [44100, 22050])
def test_variants_against_all(tmp_path, rate):
    """The best variant of random granules, alone and beside others; every variant wins somewhere."""
    book, r, won = codes(tmp_path), np.random.default_rng(rate), set()
    books = quantiser.Books(book)
    for kind in (0, 1, 2):
        granules = []
        for k in range(14):
            x = analysis.coded_order(r.normal(size=576) * np.exp(-np.arange(576) / r.integers(20, 200)) * 10 ** r.uniform(-3, 0), rate, kind)
            cell, starts, *_ = quantiser.cells(rate, kind == 2)
            energy = np.add.reduceat(x * x, starts)
            granules.append((kind, x, energy * 10 ** r.uniform(-5, 0.3, len(energy))))
        granules.append((kind, np.zeros(576), np.ones(39 if kind == 2 else 22)))
        granules.append((kind, np.full(576, 0.01), np.full(39 if kind == 2 else 22, 1e9)))
        together, bits, _ = quantiser.Quantiser(granules, rate, books).attempt(0.0)
        for g, q in zip(granules, together):
            want = plain_quantise(g[1], g[2], rate, kind, book)
            got = (bool(q["clipped"]), int(q["part2_3_length"]), int(q["global_gain"]), q["scalefactors"].tolist(), q["subblock_gain"].tolist(), int(q["scalefac_scale"]), int(q["preflag"]), q["ix"].tolist())
            assert got == (want[0], want[1], *want[3:])
            alone = quantiser.Quantiser([g], rate, books).attempt(0.0)[0][0]
            assert all(np.array_equal(alone[k], q[k]) for k in q)
            values, lengths = quantiser.granule_bits(q, rate, kind, books)
            assert lengths.sum() == q["part2_3_length"] and len(quantiser.packed(values, lengths)) == -(-int(lengths.sum()) // 8)
            won.add((kind == 2, int(q["scalefac_scale"]), int(q["preflag"])))
    assert {(True, 0, 0), (True, 1, 0), (False, 0, 0), (False, 1, 0)} <= won and (rate < 32000 or any(p for *_, p in won))


def test_side_information_says_the_variant(spark, tmp_path):
    book, r = codes(tmp_path), np.random.default_rng(3)
    rows = []
    for g in range(12):
        t = [0, 0, 1, 2, 3, 0][g % 6]
        x = r.normal(size=576) * np.exp(-np.arange(576) / 120) * 0.2
        share = 10 ** r.uniform(-5, -1, 39 if t == 2 else 22)
        rows.append(("s", g, 0, t, x.tolist(), (analysis.band_allowance(44100, t, x, 1.0) * share).tolist()))
    t = spark.createDataFrame(rows, "stream_id string, granule bigint, channel int, block_type int, x array<double>, allowed array<double>")
    frames = encoder.encode(t, book, 44100, None).orderBy("frame_no").collect()
    side = [g for f in frames for g in sideinfo.parse(bytes(f.bytes))]
    assert any(g["preflag"] for g in side) and any(g["scalefac_scale"] for g in side) and any(any(g["subblock_gain"]) for g in side)
    streams = spark.createDataFrame([("s", f.frame_no, f.bytes) for f in frames], "stream_id string, frame_no bigint, bytes binary")
    got = {(x.frame_no * 2 + x.granule): x for x in layer3.spectrum(layer3.main_data(streams), book).collect()}
    for _, g, _, kind, x, _ in rows:
        y = np.zeros(576)
        y[layer3.order(44100, int(kind == 2))] = analysis.coded_order(np.array(x), 44100, kind)
        assert got[g].exact and ((y - np.array(got[g].x)) ** 2).sum() < 0.2 * (y**2).sum()


@pytest.mark.parametrize("size", [1, 2, 7, 4096])
def test_block_types_as_prefix(spark, size):
    r = np.random.default_rng(4)
    rows = [(s, k, bool(v)) for s, n in (("a", 60), ("b", 1), (None, 13)) for k, v in enumerate(r.random(n) < 0.3)]
    t = spark.createDataFrame(rows, "stream string, at bigint, hit boolean")
    got = {(x.stream, x["at"]): x.kind for x in P.block_type_scan(t, ["stream"], "at", "hit", size).collect()}
    want = {(x.stream, x.n - 1): x.kind for x in P.block_types(t, ["stream"], "at", "hit").collect()}
    assert got == want and len(got) == len(rows)


@pytest.mark.parametrize("size", [1, 3, 8, 512])
def test_pre_echo_as_prefix(spark, size):
    r, floor = np.random.default_rng(5), [1e-3] * 22
    rows, want = [], {}
    for s in "ab":
        last = None
        for g in range(40):
            kind = int(r.choice([0, 0, 0, 0, 1, 2, 3]))
            allowed = (10 ** r.uniform(-4, 2, 39 if kind == 2 else 22)).tolist()
            rows.append((s, 0, g, kind, [0.0], allowed))
            held = allowed if kind == 2 or last is None else [max(min(a, 2 * p), f) for a, p, f in zip(allowed, last, floor)]
            last, want[s, g] = None if kind == 2 else held, held
    t = spark.createDataFrame(rows, "stream_id string, channel int, granule bigint, block_type int, x array<float>, allowed array<double>")
    got = {(x.stream_id, x.granule): list(x.allowed) for x in codec.pre_echo(t, floor, size).collect()}
    assert got == want


def test_runs_and_halos(spark):
    rows = [(k, n, float(n)) for k in (None, "a", "b") for n in range(25)]
    t = ordered.with_halo(spark.createDataFrame(rows, "k string, n bigint, v double"), ["k"], "n", 10, 3).collect()
    for k in (None, "a", "b"):
        assert {c: sorted(x.n for x in t if (x.k, x[ordered.CHUNK]) == (k, c)) for c in range(3)} == {0: list(range(10)), 1: list(range(7, 20)), 2: list(range(17, 25))}


def test_model_equals_its_dataframe_form(spark):
    r, rate = np.random.default_rng(6), 44100
    full = codec.full_scale(filterbank.designed_prototype())
    model = P.Model(rate, full, -2.0)
    x = r.normal(size=(3, 576)) * 10 ** r.uniform(-4, 0, (3, 1))
    x[2] = 0
    for short, edges, hertz in ((False, band_edges(rate)[0], rate / 1152), (True, band_edges(rate)[1], rate / 384)):
        lines = [(g, w, k, float(v)) for g in range(3) for w in range(3 if short else 1) for k, v in enumerate(x[g].reshape(32, 3, 6)[:, w].reshape(-1) if short else x[g])]
        t = spark.createDataFrame(lines, "g int, w int, k int, x double")
        quiet = F.get(F.array(*map(F.lit, P.quiet_energies(edges, hertz, full[short]))), F.col("band"))
        want = {(q.g, q.band, q.w): q.threshold * 10**-0.2 for q in P.thresholds(P.band_statistics(t, ["g", "w"], edges, hertz), ["g", "w"], edges, hertz, quiet).collect()}
        got = model.allowed(x, short).reshape(3, -1, 3 if short else 1)
        for (g, b, w), v in want.items():
            assert abs(got[g, b, w] - v) <= 1e-9 * v
    assert list(itertools.islice(model.floor, 3)) == [v * 10**-0.2 for v in P.quiet_energies(band_edges(rate)[0], rate / 1152, full[0])[:3]]


def test_settings_are_checked():
    d = filterbank.designed_prototype()
    for bad in ((44000, 128), (44100, 127), (44100, None), (22050, 320)):
        with pytest.raises(ValueError):
            codec.Settings(d, *bad)
    with pytest.raises(ValueError):
        codec.Settings(d, 44100, 128, channels=3)
    assert codec.Settings(d, 44100, None, quality=4).lowpass == 20000 - 2800 and codec.Settings(d, 44100, 320).lowpass == 20500
