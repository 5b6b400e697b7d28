"""Fixed values of the MPEG audio standards, as short lists; everything that has a formula is computed."""

from __future__ import annotations

# Fixed values (ISO/IEC 11172-3 2.4.2.3, 13818-3 2.4.2.3): kbit/s by layer I, II, III and bitrate_index 0-14; 0 is free format.
BITRATES_MPEG1 = (
    (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
)
BITRATES_LSF = (
    (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
)
# Sampling rates of MPEG-1 by index; LSF halves and 2.5 quarters them.
SAMPLE_RATES = (44100, 48000, 32000)
# Fixed values (Table 3-B.8, 44.1 kHz): scalefactor band edges, long and short.
LONG_44 = (0, 4, 8, 12, 16, 20, 24, 30, 36, 44, 52, 62, 74, 90, 110, 134, 162, 196, 238, 288, 342, 418, 576)
SHORT_44 = (0, 4, 8, 12, 16, 22, 30, 40, 52, 66, 84, 106, 136, 192)
# Fixed values (Table 3-B.8, 13818-3 B.2, and MPEG-2.5 as publicly documented): edges at the other rates.
LONG_48 = (0, 4, 8, 12, 16, 20, 24, 30, 36, 42, 50, 60, 72, 88, 106, 128, 156, 190, 230, 276, 330, 384, 576)
LONG_32 = (0, 4, 8, 12, 16, 20, 24, 30, 36, 44, 54, 66, 82, 102, 126, 156, 194, 240, 296, 364, 448, 550, 576)
LONG_24 = (0, 6, 12, 18, 24, 30, 36, 44, 54, 66, 80, 96, 114, 136, 162, 194, 232, 278, 332, 394, 464, 540, 576)
LONG_LOW = (0, 6, 12, 18, 24, 30, 36, 44, 54, 66, 80, 96, 116, 140, 168, 200, 238, 284, 336, 396, 464, 522, 576)
LONG_8 = (0, 12, 24, 36, 48, 60, 72, 88, 108, 132, 160, 192, 232, 280, 336, 400, 476, 566, 568, 570, 572, 574, 576)
SHORT_48 = (0, 4, 8, 12, 16, 22, 28, 38, 50, 64, 80, 100, 126, 192)
SHORT_32 = (0, 4, 8, 12, 16, 22, 30, 42, 58, 78, 104, 138, 180, 192)
SHORT_22 = (0, 4, 8, 12, 18, 24, 32, 42, 56, 74, 100, 132, 174, 192)
SHORT_24 = (0, 4, 8, 12, 18, 26, 36, 48, 62, 80, 104, 136, 180, 192)
SHORT_LOW = (0, 4, 8, 12, 18, 26, 36, 48, 62, 80, 104, 134, 174, 192)
SHORT_8 = (0, 8, 16, 24, 36, 52, 72, 96, 124, 160, 162, 164, 166, 192)
# Fixed values (Table 3-B.6).
PRETAB = (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 3, 3, 3, 2, 0)
# Fixed values (2.4.2.7): scalefac_compress to slen1, slen2.
SLEN1 = (0, 0, 0, 0, 3, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4)
SLEN2 = (0, 1, 2, 3, 0, 1, 2, 3, 1, 2, 3, 1, 2, 3, 2, 3)
# Low-pass (Hz) at kbit/s per channel.
LOWPASS = ((8, 3000), (16, 5500), (24, 7500), (32, 10000), (40, 12000), (48, 14000), (56, 15000), (64, 16000), (80, 17500), (96, 18500), (112, 19500), (128, 20000))
# Fixed values (Tables 3-B.2, 13818-3 B.1): steps of the allocation classes, by table family and first subband of a row.
CLASSES_A = {0: (3, 7, 15, 31, 63, 127, 255, 511, 1023, 2047, 4095, 8191, 16383, 32767, 65535), 3: (3, 5, 7, 9, 15, 31, 63, 127, 255, 511, 1023, 2047, 4095, 8191, 65535), 11: (3, 5, 7, 9, 15, 31, 65535), 23: (3, 5, 65535)}
CLASSES_C = {0: (3, 5, 9, 15, 31, 63, 127, 255, 511, 1023, 2047, 4095, 8191, 16383, 32767), 2: (3, 5, 9, 15, 31, 63, 127)}
CLASSES_LSF = {0: (3, 5, 7, 9, 15, 31, 63, 127, 255, 511, 1023, 2047, 4095, 8191, 16383), 4: (3, 5, 9, 15, 31, 63, 127), 11: (3, 5, 9)}
SUBBANDS = {"A": 27, "B": 30, "C": 8, "D": 12, "LSF": 30}


def allocation_row(table: str, subband: int) -> tuple[int, ...]:
    """The steps that the allocation indexes 1, 2, ... of a subband select."""
    family = {"A": CLASSES_A, "B": CLASSES_A, "C": CLASSES_C, "D": CLASSES_C, "LSF": CLASSES_LSF}[table]
    return family[max(k for k in family if k <= subband)]


def band_edges(rate: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Long and short scalefactor band edges at a sampling rate."""
    long = {44100: LONG_44, 48000: LONG_48, 32000: LONG_32, 24000: LONG_24, 8000: LONG_8}.get(rate, LONG_LOW)
    short = {44100: SHORT_44, 48000: SHORT_48, 32000: SHORT_32, 22050: SHORT_22, 24000: SHORT_24, 8000: SHORT_8}.get(rate, SHORT_LOW)
    return long, short
