"""Encoding of streams whose samples arrive in chunks, with the state of each stream as typed values, lists and maps in Spark's state store.

A granule is analysed once its samples and 351 of the next granule are there (the look-ahead of the attack detector). What is kept:
some 1500 samples a channel, the subbands and masks of the granule before, granules of a frame that is not whole, frames whose slots later main data may still
fill, and chunks that came before their turn. What comes out does not depend on the chunking and equals the batch encoder's, byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.encoding import DECODER_DELAY, ENCODER_DELAY
from ..operators import analysis
from ..operators.analysis import AHEAD, BEFORE, LINES
from ..operators.codec import Settings, held_down
from ..operators.encoder import FrameEncoder
from ..operators.layer3 import Codes
from ..operators.psychoacoustics import attack, next_kind
from ..operators.quantiser import Books

SCHEMA = "stream_id string, frame_no bigint, bytes binary"
HEAD = "base bigint, total bigint, granule bigint, kind int, attack boolean, limit int, start bigint, end bigint, remainder bigint, frame_no bigint, turn bigint, last bigint"
SIGNAL = "samples array<array<double>>, energies array<array<double>>, before array<array<float>>, masks array<array<double>>, main binary"
HALF = "block_type int, x array<double>, allowed array<double>"
SLOT = "start bigint, head binary, size int"
LOOK_BACK = 480


class StreamEncoder:
    """Feed samples, get the frames that are complete."""

    def __init__(self, use: Settings, books: Books):
        self.use, n = use, use.channels
        self.frames = FrameEncoder(books, use.rate, use.kbps, use.joint)
        self.base, self.total, self.granule, self.kind, self.attack = 0, 0, 0, 0, False
        self.samples = [np.zeros(0) for _ in range(n)]
        self.energies, self.before = np.zeros((n, 9)), np.zeros((n, LINES), np.float32)
        self.masks: list[list[float] | None] = [None] * n
        self.half: list[tuple] = []

    def feed(self, pcm: np.ndarray) -> list[bytes]:
        """Interleaved samples, whole ones of all channels."""
        n = self.use.channels
        if len(pcm) % n:
            raise ValueError(f"{len(pcm)} values are no whole samples of {n} channels")
        for c in range(n):
            self.samples[c] = np.r_[self.samples[c], pcm[c::n]]
        self.total += len(pcm) // n
        return self._run(None)

    def flush(self) -> list[bytes]:
        """The rest with silence behind it, up to the whole frames that hold all samples and both delays."""
        per = LINES * self.frames.granules
        whole = -(-(self.total + ENCODER_DELAY + DECODER_DELAY) // per)
        return self._run(whole * self.frames.granules) + self.frames.finish()

    def _samples(self, c: int, start: int, end: int) -> np.ndarray:
        """Silence before the first and behind the last."""
        held = self.samples[c][max(start - self.base, 0) : max(end - self.base, 0)]
        lead = np.zeros(max(0, min(-start, end - start)))
        return np.r_[lead, held, np.zeros(end - start - len(lead) - len(held))]

    def _attack(self, g: int) -> bool:
        now = np.concatenate([analysis.energies_of(self._samples(c, LINES * g - BEFORE, LINES * g + AHEAD)) for c in range(self.use.channels)])
        hit = attack(self.energies, now, np.full(len(now), g)).any()
        self.energies = now
        return bool(hit)

    def _run(self, end: int | None) -> list[bytes]:
        out, per = [], self.frames.granules * self.use.channels
        while self.granule < end if end is not None else self.total >= LINES * (self.granule + 1) + AHEAD:
            g = self.granule
            now = self._attack(0) if g == 0 else self.attack
            self.attack = self._attack(g + 1) if end is None or g + 1 < end else False
            self.kind = next_kind(self.kind, now, self.attack)
            for c in range(self.use.channels):
                v = analysis.subbands_of(self._samples(c, LINES * g - LOOK_BACK, LINES * (g + 1)), self.use.prototype)
                x, (allowed,) = analysis.lines_of(np.c_[self.before[c : c + 1], v], np.array([self.kind]), self.use.model, self.use.lowpass)
                allowed = allowed.tolist()
                if self.kind != 2:
                    allowed = held_down(self.masks[c], allowed, self.use.model.floor)
                self.masks[c], self.before[c] = None if self.kind == 2 else allowed, v[0]
                self.half.append((self.kind, analysis.coded_order(x[0].astype(float), self.use.rate, self.kind), np.array(allowed)))
            if len(self.half) == per:
                out += self.frames.add(self.half)
                self.half = []
            self.granule = g + 1
            keep = min(max(LINES * (g + 1) - LOOK_BACK, 0), self.base + len(self.samples[0]))
            self.samples, self.base = [s[keep - self.base :] for s in self.samples], keep
        return out

    def state(self) -> tuple[tuple, tuple, list[tuple], list[tuple]]:
        """What is kept, as values of ``HEAD`` (without the counters of chunks and frames), ``SIGNAL``, ``HALF`` and ``SLOT``."""
        a = self.frames.assembly
        head = (self.base, self.total, self.granule, self.kind, self.attack, a.limit, a.start, a.end, self.frames.remainder)
        signal = ([s.tolist() for s in self.samples], self.energies.tolist(), self.before.tolist(), [m or [] for m in self.masks], bytes(a.data))
        return head, signal, [(int(t), x.tolist(), m.tolist()) for t, x, m in self.half], [(int(s), bytes(h), int(n)) for s, h, n in a.waiting]

    def restore(self, head: tuple, signal: tuple, half: list[tuple], slots: list[tuple]) -> None:
        a = self.frames.assembly
        self.base, self.total, self.granule, self.kind, self.attack, a.limit, a.start, a.end, self.frames.remainder = head
        samples, energies, before, masks, data = signal
        self.samples, self.energies, self.before = [np.array(s, float) for s in samples], np.array([list(e) for e in energies]), np.array([list(b) for b in before], np.float32)
        self.masks = [list(m) or None for m in masks]
        a.data, a.waiting = bytearray(data), [(s, bytes(h), n) for s, h, n in slots]
        self.half = [(t, np.array(x, float), np.array(m, float)) for t, x, m in half]


class _Encoding(StatefulProcessor):
    def __init__(self, use: Settings, codes: Codes, timeout_ms: int | None):
        self.use, self.codes, self.timeout_ms = use, codes, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.books = handle, Books(self.codes)
        self.head, self.signal = handle.getValueState("head", HEAD), handle.getValueState("signal", SIGNAL)
        self.half, self.slots = handle.getListState("half", HALF), handle.getListState("slots", SLOT)
        self.waiting = handle.getMapState("waiting", "chunk_no bigint", "pcm array<double>")

    def _load(self) -> tuple[StreamEncoder, int, int, int]:
        encoder, counters = StreamEncoder(self.use, self.books), (0, 0, -1)
        if self.head.exists():
            head = tuple(self.head.get())
            encoder.restore(head[:9], self.signal.get(), list(self.half.get()), list(self.slots.get()))
            counters = head[9:]
        return encoder, *counters

    def _save(self, encoder: StreamEncoder, *counters: int) -> None:
        head, signal, half, slots = encoder.state()
        self.head.update((*head, *counters))
        self.signal.update(signal)
        for state, rows in ((self.half, half), (self.slots, slots)):
            state.put(rows) if rows else state.clear()

    def _end(self) -> None:
        for state in (self.head, self.signal, self.half, self.slots, self.waiting):
            state.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        encoder, frame_no, turn, last = self._load()
        for p in rows:
            for r in p.itertuples():
                self.waiting.updateValue((int(r.chunk_no),), ([float(v) for v in r.pcm] if r.pcm is not None else [],))
                last = int(r.chunk_no) if r.last else last
        made = []
        while self.waiting.containsKey((turn,)):
            made += encoder.feed(np.array(self.waiting.getValue((turn,))[0], float))
            self.waiting.removeKey((turn,))
            turn += 1
        if 0 <= last < turn:
            made += encoder.flush()
            self._end()
        else:
            self._save(encoder, frame_no + len(made), turn, last)
            if self.timeout_ms is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        yield self._frames(key, frame_no, made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No chunk for so long: the stream ends with what came in turn."""
        encoder, frame_no, *_ = self._load()
        made = encoder.flush()
        self._end()
        yield self._frames(key, frame_no, made)

    def _frames(self, key, first: int, made: list[bytes]) -> pd.DataFrame:
        return pd.DataFrame({"stream_id": pd.Series([key[0]] * len(made), dtype=object), "frame_no": pd.Series(range(first, first + len(made)), dtype="int64"), "bytes": pd.Series(made, dtype=object)})

    def close(self) -> None:
        pass


def stream_encode(chunks: DataFrame, codes: Codes, use: Settings, timeout_ms: int | None = None) -> DataFrame:
    """Streaming (stream_id, chunk_no, pcm: interleaved samples, last) to frames (stream_id, frame_no, bytes), whatever the chunking.

    ``last`` ends a stream; with ``timeout_ms`` a stream that gets no chunk for so long ends too. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``), whose state can be read by the state data source.
    """
    return chunks.groupBy("stream_id").transformWithStateInPandas(_Encoding(use, codes, timeout_ms), SCHEMA, "append", "none" if timeout_ms is None else "processingTime")
