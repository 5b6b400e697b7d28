"""Lock-step decoding against the reader of one frame at a time, on whole, damaged and mixed frames."""

import numpy as np
import pytest

from tonewright.operators import huffman, layer3
from tonewright.sources import sideinfo

from .test_layer3 import Writer, codes, frame, granule


def both(frames, book):
    """What both readers give: rows or None."""
    words, want = huffman.Words(book), []
    for f, main in frames:
        try:
            want.append(layer3.frame_spectrum(f, main, book))
        except (ValueError, KeyError, IndexError):
            want.append(None)
    return want, huffman.frame_spectra(frames, words)


def same(want, got):
    for w, g in zip(want, got):
        assert (w is None) == (g.error is not None), g.error
        for a, b in zip(w or [], g.rows):
            assert a[:5] == b[:5]
            np.testing.assert_allclose(a[5], b[5], rtol=1e-12, atol=0)


def test_all_kinds_together(tmp_path):
    book, r, frames = codes(tmp_path), np.random.default_rng(1), []
    for n in range(40):
        kinds = [(0, 0), (1, 0), (2, 0), (2, 1), (3, 0)]
        parts = [granule(r, *kinds[r.integers(0, 5)], big=int(r.integers(0, 280)), table=int(r.choice([1, 2, 3, 5]))) for _ in range(4)]
        for g, *_ in parts[2:]:
            g["scfsi"] = [0, 0, 0, 0]
        frames.append(frame(parts, mode=1, ext=int(r.integers(0, 4))))
    want, got = both(frames, book)
    same(want, got)
    assert all(g.error is None and g.exact for g in got) and all(w is not None for w in want)
    for k in (0, 7, 39):  # neighbours change nothing
        alone = huffman.frame_spectra(frames[k : k + 1], huffman.Words(book))[0]
        assert all(np.array_equal(a[5], b[5]) for a, b in zip(alone.rows, got[k].rows))


def test_shared_scalefactors(tmp_path):
    """Granule 1 takes groups of granule 0's scalefactors and has no bits for them."""
    book, r, frames = codes(tmp_path), np.random.default_rng(2), []
    for n in range(12):
        parts = [granule(r, 0, 0, big=30) for _ in range(4)]
        for k in (2, 3):
            g, lines, sf, w = parts[k]
            flags = r.integers(0, 2, 4).tolist()
            first, second = layer3.SLEN1[g["scalefac_compress"]], layer3.SLEN2[g["scalefac_compress"]]
            total, v = w.size, Writer()
            at = 0
            for b in range(21):
                n_bits = first if b < 11 else second
                group = next(i for i, (lo, hi) in enumerate(layer3.SCFSI_GROUPS) if lo <= b < hi)
                if not flags[group]:
                    v.put(w.value >> (total - at - n_bits) & ((1 << n_bits) - 1), n_bits)
                at += n_bits
            rest = total - at
            v.put(w.value & ((1 << rest) - 1), rest)
            parts[k] = (g | {"scfsi": flags, "part2_3_length": v.size}, lines, sf, v)
            parts[k - 2] = (parts[k - 2][0] | {"scfsi": flags}, *parts[k - 2][1:])  # the flags stand once per channel
        frames.append(frame(parts))
    want, got = both(frames, book)
    same(want, got)
    assert all(g.error is None and g.exact for g in got)


@pytest.mark.parametrize("seed", range(4))
def test_damage(tmp_path, seed):
    """Random bits in place of main data, wrong lengths and tables: refused by both or read alike, and exact or not alike."""
    book, r, frames = codes(tmp_path), np.random.default_rng(seed), []
    for n in range(60):
        parts = [granule(r, int(r.choice([0, 2])), 0, big=int(r.integers(0, 200)), table=int(r.choice([1, 5]))) for _ in range(4)]
        for g, *_ in parts:
            if r.random() < 0.1:
                g["part2_3_length"] = int(max(0, g["part2_3_length"] + r.integers(-40, 40)))
            if r.random() < 0.05:
                g["table_select"][0] = int(r.choice([0, 1, 6, 9]))
            if r.random() < 0.05:
                g["big_values"] = int(r.integers(0, 289))
        head, main = frame(parts)
        main = bytearray(main)
        for _ in range(int(r.choice([0, 0, 1, 30]))):
            main[r.integers(0, len(main))] = r.integers(0, 256)
        frames.append((head, bytes(main[: r.integers(len(main) // 2, len(main) + 1)] if r.random() < 0.3 else main)))
    want, got = both(frames, book)
    same(want, got)
    assert any(w is None for w in want) and any(w is not None for w in want)


def test_lower_rates(tmp_path):
    """One granule of MPEG-2 with its own scalefactor lengths, intensity on the right channel too."""
    book, r, frames = codes(tmp_path), np.random.default_rng(9), []
    for n in range(30):
        rows, w = [], Writer()
        ext = int(r.integers(0, 4))
        for c in range(2):
            compress = int(r.integers(0, 512))
            lengths, row = layer3.lsf_lengths(compress, c == 1 and bool(ext & 1))
            start = w.size
            for n_bits, k in zip(lengths, layer3.GROUPS_LSF[row][0]):
                for _ in range(k):
                    w.put(int(r.integers(0, 1 << n_bits)), n_bits)
            big = int(r.integers(0, 40)) if c == 0 else int(r.integers(0, 10))
            for _ in range(big):
                x, y = (int(v) for v in r.integers(0, 15, 2))
                w.put(x << 4 | y, 8)
                for v in (x, y):
                    if v:
                        w.put(int(r.integers(0, 2)), 1)
            rows.append({"granule": 0, "channel": c, "main_data_begin": 0, "part2_3_length": w.size - start, "big_values": big, "global_gain": 190, "scalefac_compress": compress, "window_switching": 0, "block_type": 0, "mixed_block": 0, "table_select": [1, 1, 1], "subblock_gain": [0, 0, 0], "region0_count": 3, "region1_count": 3, "preflag": 0, "scalefac_scale": 0, "count1_table": 0, "scfsi": []})
        w.put(0, -w.size % 8)
        frames.append(((0xFFF3A000 | 1 << 6 | ext << 4).to_bytes(4, "big") + sideinfo.pack(rows, True, False), w.value.to_bytes(w.size // 8, "big")))
    want, got = both(frames, book)
    same(want, got)
    assert all(g.error is None for g in got)
