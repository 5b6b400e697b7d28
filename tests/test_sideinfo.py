"""Side information: pack and parse are inverse in all four layouts; refusals become errors."""

import random

import pytest

from tonewright.sources import sideinfo

HEADS = {(False, False): "FFFB9064", (False, True): "FFFB90C4", (True, False): "FFF39064", (True, True): "FFF390C4"}


def made(lsf, mono, r):
    rows = []
    scfsi = [[] if lsf else [r.randrange(2) for _ in range(4)] for _ in range(2)]
    for g in range(1 if lsf else 2):
        for c in range(1 if mono else 2):
            switch = r.randrange(2)
            x = {"granule": g, "channel": c, "main_data_begin": rows[0]["main_data_begin"] if rows else r.randrange(256), "scfsi": scfsi[c], "part2_3_length": r.randrange(4096), "big_values": r.randrange(289), "global_gain": r.randrange(256)}
            x |= {"scalefac_compress": r.randrange(512 if lsf else 16), "window_switching": switch, "block_type": r.randrange(1, 4) if switch else 0, "mixed_block": 0, "table_select": [r.randrange(4) for _ in range(2 if switch else 3)]}
            x |= {"subblock_gain": [r.randrange(8) if switch else 0 for _ in range(3)], "preflag": 0 if lsf else r.randrange(2), "scalefac_scale": r.randrange(2), "count1_table": r.randrange(2)}
            x |= {"region0_count": (8 if x["block_type"] == 2 else 7) if switch else r.randrange(16), "region1_count": 36 if switch else r.randrange(8)}
            rows.append(x)
    return rows


@pytest.mark.parametrize("lsf,mono", HEADS)
def test_round_trip(lsf, mono):
    r = random.Random(4)
    for _ in range(50):
        rows = made(lsf, mono, r)
        data = sideinfo.pack(rows, lsf, mono)
        assert len(data) == (9 if mono else 17) * (1 if lsf else 1) if lsf else len(data) == (17 if mono else 32)
        assert sideinfo.parse(bytes.fromhex(HEADS[lsf, mono]) + data) == rows


def test_rows_and_errors(spark):
    r = random.Random(1)
    good = bytes.fromhex("FFFB9064") + sideinfo.pack(made(False, False, r), False, False)
    bad = made(False, False, r)
    bad[1] |= {"big_values": 300}
    rows = [("a", 0, bytearray(good)), ("a", 1, bytearray(good[:20])), ("a", 2, bytearray(bytes.fromhex("FFFB9064") + sideinfo.pack(bad, False, False))), ("b", 0, bytearray(bytes.fromhex("FFFDA200") + bytes(40)))]
    got = sideinfo.side_info(spark.createDataFrame(rows, "stream_id string, frame_no bigint, bytes binary")).collect()
    assert len([x for x in got if x.frame_no == 0 and x.error is None]) == 4
    assert [x.error is not None for x in got if x.frame_no > 0] == [True, True] and not [x for x in got if x.stream_id == "b"]
