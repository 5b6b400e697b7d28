"""Frame headers as column expressions: 32 bits in, fields and geometry out.

Everything here is a pure function of one row, so header-only queries read no
payload and stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .tables import BITRATES_LSF, BITRATES_MPEG1, SAMPLE_RATES

FIELDS = {  # name: (lowest bit, bits)
    "sync": (21, 11), "version_code": (19, 2), "layer_code": (17, 2), "protection": (16, 1), "bitrate_index": (12, 4), "rate_index": (10, 2), "padding": (9, 1),
    "private": (8, 1), "mode": (6, 2), "mode_extension": (4, 2), "copyright": (3, 1), "original": (2, 1), "emphasis": (0, 2),
}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}


def word_of(data: Column, at: int | Column = 1) -> Column:
    """The header word that starts at byte ``at`` (from 1) of a binary column."""
    return F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("bigint")


def field(word: Column, name: str) -> Column:
    low, bits = FIELDS[name]
    return F.shiftright(word, low).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def is_sync(word: Column) -> Column:
    return field(word, "sync") == 2047


def is_valid(word: Column) -> Column:
    """Sync, and none of the reserved values: version 1, layer 0, bit rate 15, rate 3, emphasis 2."""
    return is_sync(word) & (field(word, "version_code") != 1) & (field(word, "layer_code") != 0) & (field(word, "bitrate_index") != 15) & (field(word, "rate_index") != 3) & (field(word, "emphasis") != 2)


def version(word: Column) -> Column:
    code = field(word, "version_code")
    return F.when(code == 3, "1").when(code == 2, "2").when(code == 0, "2.5")


def layer(word: Column) -> Column:
    return 4 - field(word, "layer_code")


def is_lsf(word: Column) -> Column:
    return field(word, "version_code") != 3


def has_crc(word: Column) -> Column:
    return field(word, "protection") == 0


def channels(word: Column) -> Column:
    return F.when(field(word, "mode") == 3, 1).otherwise(2)


def sample_rate(word: Column) -> Column:
    base = F.element_at(F.array(*map(F.lit, SAMPLE_RATES)), field(word, "rate_index") + 1)
    code = field(word, "version_code")
    return F.when(field(word, "rate_index") < 3, (base / F.when(code == 3, 1).when(code == 2, 2).otherwise(4)).cast("int"))


def bitrate(word: Column) -> Column:
    """Bits a second; 0 for free format, null for the forbidden index."""
    tables = F.array(*(F.lit(1000 * k) for t in (BITRATES_MPEG1, BITRATES_LSF) for row in t for k in row))
    at = F.when(is_lsf(word), 45).otherwise(0) + (layer(word) - 1) * 15 + field(word, "bitrate_index") + 1
    return F.when((field(word, "bitrate_index") < 15) & (field(word, "layer_code") > 0), F.get(tables, at - 1))


def samples(word: Column) -> Column:
    """Samples a channel: 384, 1152, or 1152 and 576 in Layer III."""
    lay = layer(word)
    return F.when(lay == 1, 384).when((lay == 3) & is_lsf(word), 576).otherwise(1152)


def frame_length(word: Column) -> Column:
    """Bytes, dividing as integers in the standard's order; null for free format."""
    br, fs, pad = bitrate(word), sample_rate(word), field(word, "padding")
    one = (F.floor(12 * br / fs) + pad) * 4
    other = F.floor((samples(word) / 8).cast("int") * br / fs) + pad
    return F.when(br > 0, F.when(layer(word) == 1, one).otherwise(other).cast("int"))


def header_length(word: Column) -> Column:
    return F.when(has_crc(word), 6).otherwise(4)


def side_info_length(word: Column) -> Column:
    mono = field(word, "mode") == 3
    return F.when(layer(word) == 3, F.when(is_lsf(word), F.when(mono, 9).otherwise(17)).otherwise(F.when(mono, 17).otherwise(32)))


def stream_key(word: Column) -> Column:
    """Equal for headers that may follow each other in one stream: version, layer, rate, free format or not."""
    return field(word, "version_code") * 32 + field(word, "layer_code") * 8 + field(word, "rate_index") * 2 + (field(word, "bitrate_index") == 0).cast("int")


def to_bytes(word: Column) -> Column:
    """The four bytes of a header word."""
    return F.unhex(F.lpad(F.hex(word), 8, "0"))


def build(**fields: Column) -> Column:
    """A header word from its fields; sync is set, protection is 1 where not given."""
    values = {"sync": F.lit(2047), "protection": F.lit(1)} | fields
    return sum((F.shiftleft(values[k].cast("bigint"), low) for k, (low, _) in FIELDS.items() if k in values), F.lit(0).cast("bigint"))


def measured_bitrate(length: Column, word: Column) -> Column:
    """Bit rate of a free-format frame from its length in bytes."""
    slots = F.when(layer(word) == 1, (length / 4).cast("int") - field(word, "padding")).otherwise(length - field(word, "padding"))
    per = F.when(layer(word) == 1, 12).otherwise((samples(word) / 8).cast("int"))
    return F.floor(slots.cast("bigint") * sample_rate(word) / per).cast("bigint")
