"""Damaged Layer III streams: both kinds of silence, what does not add up, strict, a change of channels, trimming; batch and streaming alike."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright.operators import codec, encoder, filterbank, layer3, playback
from tonewright.operators.analysis import band_allowance
from tonewright.operators.huffman import Words
from tonewright.sources import sideinfo, tags
from tonewright.streaming.decode import StreamDecoder

from .test_layer3 import codes


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Code tables, and the frames of a stereo and a mono stream at 160 kb/s, with a reservoir."""
    book, r = codes(tmp_path_factory.mktemp("codes")), np.random.default_rng(5)
    rows = []
    for s, channels in (("s", 2), ("m", 1)):
        for g, t in enumerate([0, 0, 1, 2, 3, 0] * 3):
            for c in range(channels):
                x = r.normal(size=576) * np.exp(-np.arange(576) / 60) * 0.2
                rows.append((s, g, c, t, x.tolist(), band_allowance(44100, t, np.full(576, 0.003), 1.0).tolist()))
    t = spark.createDataFrame(rows, "stream_id string, granule bigint, channel int, block_type int, x array<double>, allowed array<double>")
    got = encoder.encode(t, book, 44100, 128).orderBy("frame_no").collect()
    return book, {s: [bytes(f.bytes) for f in got if f.stream_id == s] for s in "sm"}


def plain(frames, book, d):
    """The rule, frame by frame: sound per channel (zeros where a frame stands outside), and what is silent."""
    held, channels, overlap, slots, out, silent = b"", 0, {}, {}, {}, []
    for f in frames:
        facts = layer3.header_facts(f)
        n, rows = facts["channels"], None
        try:
            side = sideinfo.parse(f)
            own, begin = f[facts["start"] :], side[0]["main_data_begin"]
            main = held[len(held) - begin :] + own if begin <= len(held) else None
            held = (held + own)[-511:]
            rows = layer3.frame_spectrum(f, main, book) if main is not None else [(g, c, 0, 0, False, np.zeros(576)) for g in (0, 1) for c in range(n)]
            silent.append(main is None)
        except (ValueError, KeyError, IndexError):
            silent.append(True)
        if rows and n != channels:
            overlap, slots, channels = {}, {}, n
        for c in range(n):
            if rows is None:
                out.setdefault(c, []).append(np.zeros(1152))
            for _, _, kind, mixed, _, x in [r for r in rows or () if r[1] == c]:
                y = layer3.inverse_hybrid(x.astype(np.float32).astype(float)[None], np.array([kind]), np.array([mixed]))[0]
                v = y[:, :18] + overlap.get(c, 0)
                overlap[c] = y[:, 18:]
                v[1::2, 1::2] *= -1
                for s in v.T.astype(np.float32):
                    slots[c] = np.r_[slots.get(c, np.zeros((16, 32)))[1:], s[None]]
                    out.setdefault(c, []).append(filterbank.synthesise_slots(slots[c][None], d)[0])
    return {c: np.concatenate(v) for c, v in out.items()}, silent


def sound(rows, key=None):
    out = {}
    for c in {r.channel for r in rows}:
        mine = sorted((r for r in rows if r.channel == c), key=lambda r: r.slot)
        out[c] = np.array([r.slot for r in mine]), np.concatenate([r.s for r in mine])
    return out


def spoiled(frames):
    """Refused side information, lost main data at the start, codes that cannot be read, in turn."""
    bad = [bytearray(f) for f in frames]
    side = sideinfo.parse(bytes(bad[4]))
    side[0]["big_values"] = 400
    bad[4][4:36] = sideinfo.pack(side, False, False)
    late = sideinfo.parse(bytes(bad[6]))
    for g in late:
        g["table_select"] = [9] * len(g["table_select"])
    bad[6][4:36] = sideinfo.pack(late, False, False)
    first = [g | {"main_data_begin": 300} for g in sideinfo.parse(bytes(bad[0]))]
    bad[0][4:36] = sideinfo.pack(first, False, False)
    return [bytes(f) for f in bad]


def test_both_silences(spark, made):
    book, frames = made
    d, bad = filterbank.designed_prototype(), spoiled(frames["s"])
    t = spark.createDataFrame([("s", k, bytearray(f)) for k, f in enumerate(bad)], "stream_id string, frame_no bigint, bytes binary")
    want, silent = plain(bad, book, d)
    rows = playback.played(playback.ordered_rows(t, book), d).collect()
    for c, (slots, pcm) in sound(rows).items():
        assert slots.tolist() == list(range(36 * len(bad)))
        np.testing.assert_allclose(pcm, want[c], atol=2e-6)
    assert {r.slot // 36 for r in rows if r.concealed} == {k for k, x in enumerate(silent) if x} == {0, 4, 6}
    assert not any(any(r.s) for r in rows if r.slot // 36 in (4, 6)) and any(any(r.s) for r in rows if r.slot // 36 == 5)
    for size in (1, 100, 5000):
        decoder, data, got = StreamDecoder(), b"".join(bad), []
        for at in range(0, len(data), size):
            got += decoder.feed(data[at : at + size], book, d)
        got += decoder.feed(b"", book, d, last=True)
        for c in (0, 1):
            pcm = np.concatenate([s for ch, _, s, _ in sorted(got, key=lambda g: g[1]) if ch == c])
            np.testing.assert_allclose(pcm, want[c], atol=2e-6)
        assert {k // 36 for _, k, _, q in got if q} == {0, 4, 6}


def test_channels_change(spark, made):
    """Mono after stereo and back: the transforms start anew, and time goes on."""
    book, frames = made
    d, mixed = filterbank.designed_prototype(), frames["s"][:3] + frames["m"][:3] + frames["s"][3:6]
    t = spark.createDataFrame([("s", k, bytearray(f)) for k, f in enumerate(mixed)], "stream_id string, frame_no bigint, bytes binary")
    rows = playback.played(playback.ordered_rows(t, book), d).collect()
    want, _ = plain(mixed, book, d)
    got = sound(rows)
    assert got[1][0].tolist() == [*range(108), *range(216, 324)] and got[0][0].tolist() == list(range(324))
    for c in (0, 1):
        np.testing.assert_allclose(got[c][1], want[c], atol=2e-6)


def test_accounts(spark, made):
    book, frames = made
    clean = frames["s"]
    cases = {"clean": clean, "gap": clean[:3] + clean[4:], "late start": clean[5:], "spoiled": spoiled(clean)}
    short = [bytearray(f) for f in clean]
    side = sideinfo.parse(bytes(short[2]))
    side[-1]["part2_3_length"] += 9  # nine bits that no code fills
    short[2][4:36] = sideinfo.pack(side, False, False)
    cases["not exact"] = [bytes(f) for f in short]
    t = spark.createDataFrame([(k, n, bytearray(f)) for k, v in cases.items() for n, f in enumerate(v)], "stream_id string, frame_no bigint, bytes binary")
    got = {(r.stream_id, r.frame_no): r for r in playback.report(t, book).collect()}
    said = lambda name: {n: got[name, n].error for n in range(len(cases[name])) if got[name, n].error}
    assert said("clean") == {} and all(got["clean", n].exact and not got["clean", n].concealed for n in range(len(clean)))
    reach = {n for n, f in enumerate(clean) if sideinfo.parse(f)[0]["main_data_begin"]}
    assert reach & {4, 5} and set(said("not exact")) >= {2} and "part2_3_length" in said("not exact")[2]
    if 4 in reach:
        assert 3 in said("gap")
    if 5 in reach:
        assert 0 in said("late start") and got["late start", 0].concealed
    assert {0, 4, 6} <= set(said("spoiled"))
    for name, frames_of in cases.items():
        bad = bool(said(name))
        words, state = Words(book), playback.StreamState()
        if bad:
            with pytest.raises(ValueError):
                state.feed(frames_of, words, strict=True)
        else:
            state.feed(frames_of, words, strict=True)
        decoder, d = StreamDecoder(strict=True), filterbank.designed_prototype()
        if bad:
            with pytest.raises(ValueError):
                decoder.feed(b"".join(frames_of), book, d, last=True)
        else:
            assert decoder.feed(b"".join(frames_of), book, d, last=True)


def test_strict_chain(spark, made):
    book, frames = made
    d = filterbank.designed_prototype()
    t = spark.createDataFrame([("a", bytearray(b"".join(frames["s"])))], "stream_id string, content binary")
    assert codec.decode_streams(t, book, d, strict=True).count() == 2 * 36 * len(frames["s"])
    t = spark.createDataFrame([("a", bytearray(b"".join(spoiled(frames["s"]))))], "stream_id string, content binary")
    with pytest.raises(Exception, match="points before the start of the stream"):
        codec.decode_streams(t, book, d, strict=True).collect()


def test_trimming_in_the_stream(spark, made):
    """What remains of each slot, as in the batch."""
    book, frames = made
    d = filterbank.designed_prototype()
    rows = spark.createDataFrame([("s", k, bytearray(f)) for k, f in enumerate(frames["s"])], "stream_id string, frame_no bigint, bytes binary")
    tag = bytes(tags.tag_frames(rows, 50, 20000, 528, F.lit(1152 * len(frames["s"]) - 1057 - 700)).collect()[0].bytes)
    content = tag + b"".join(frames["s"])
    want = {(r.channel, r.slot): (r.keep_from, r.keep_to) for r in codec.decode_streams(spark.createDataFrame([("s", bytearray(content))], "stream_id string, content binary"), book, d).collect()}
    decoder, got = StreamDecoder(trim=True), {}
    for at in range(0, len(content), 321):
        got |= {(c, k): decoder.kept(k) for c, k, _, _ in decoder.feed(content[at : at + 321], book, d)}
    got |= {(c, k): decoder.kept(k) for c, k, _, _ in decoder.feed(b"", book, d, last=True)}
    assert got == want and len({v for v in want.values()}) > 3
    untrimmed = StreamDecoder()
    untrimmed.feed(content, book, d, last=True)
    assert untrimmed.kept(0) == (0, 32)


def test_excerpts(spark, made):
    """Every stretch equals that part of the whole, and few frames are read for it."""
    from tonewright.operators import seek

    book, frames = made
    d, n = filterbank.designed_prototype(), len(frames["s"])
    t = spark.createDataFrame([(s, k + 1, bytearray(f)) for s in "sm" for k, f in enumerate(frames[s])], "stream_id string, frame_no bigint, bytes binary")
    whole = {}
    for r in playback.played(playback.ordered_rows(t, book), d).collect():
        whole[r.stream_id, r.channel, r.slot] = r.s
    asked = [("s", f"frame {k}", 1152 * k, 1152 * (k + 1)) for k in range(n)] + [("m", "odd", 1000, 1033), ("m", "all", -5, 10**9), ("s", "one", 5000, 5001), ("s", "none", 70, 70), ("s", "behind", 10**8, 10**8 + 5), ("gone", "x", 0, 9)]
    a = spark.createDataFrame(asked, "stream_id string, excerpt_id string, start bigint, stop bigint")
    got = seek.excerpts(t, a, book, d).collect()
    limits = {e: (s, lo, hi) for s, e, lo, hi in asked}
    for e, (s, lo, hi) in limits.items():
        mine = {(r.channel, 32 * r.slot + k): v for r in got if r.excerpt_id == e for k, v in enumerate(r.s) if r.keep_from <= k < r.keep_to}
        want = {(c, 32 * slot + k): v for (x, c, slot), part in whole.items() if x == s for k, v in enumerate(part) if lo <= 32 * slot + k < hi}
        assert mine.keys() == want.keys() and all(abs(mine[k] - want[k]) < 1e-6 for k in want), e
    read = {r.excerpt_id: r["last"] - r["first"] + 1 for r in seek.needed(seek.numbered(t), a).collect()}
    assert read["one"] <= 3 + 4 and read["all"] == n and "none" not in read and "behind" not in read
