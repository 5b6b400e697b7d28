"""Decoding of streams whose bytes arrive in chunks, with the state of each stream as typed values, lists and maps in Spark's state store.

A stream's state is what framing has not consumed, at most 511 bytes of reservoir, half a granule of samples per
subband and channel, fifteen slots of the filterbank, and chunks that came before their turn: some tens of kilobytes. What
comes out does not depend on the chunking, and equals the batch decoder's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import layer3
from ..operators.huffman import Words
from ..operators.layer3 import Codes
from ..operators.playback import Played, StreamState, Voice
from ..sources import layer12, tags
from ..sources.framing import Framer
from ..sources.ranges import packed_lock, unpacked_lock

SCHEMA = "stream_id string, channel int, slot bigint, s array<float>, concealed boolean, keep_from int, keep_to int"
HEAD = "base bigint, lock bigint, free bigint, skipped bigint, frames bigint, slots bigint, skip bigint, length bigint, unused bigint, channels int, part int, at bigint, time bigint, voices_part int, turn bigint, last bigint"
HELD = "buffer binary, reservoir binary"
VOICE = "layer int, channel int, overlap array<double>, slots array<float>"


class StreamDecoder:
    """Feed bytes, get (channel, slot, 32 samples, concealed) of the frames they complete."""

    def __init__(self, strict: bool = False, check_crc: bool = False, trim: bool = False):
        self.framer, self.check_crc, self.strict, self.trim = Framer(strict), check_crc or strict, strict, trim
        self.frames, self.slots, self.keep = 0, 0, None
        self.reset()

    def reset(self) -> None:
        """Forget what earlier frames left, as after a seek: reservoir, overlap, filterbank."""
        self.state, self.part, self.voices = StreamState(), 0, {}

    def state_of(self) -> tuple[tuple, tuple, list[tuple]]:
        """What is kept, as values of ``HEAD`` (without the counters of chunks), ``HELD`` and ``VOICE``."""
        f, s = self.framer, self.state
        keep = (None, None) if self.keep is None else self.keep
        head = (f.base, packed_lock(f.locked), f.free, f.skipped, self.frames, self.slots, *keep, s.unused, s.channels, s.part, s.at, s.time, self.part)
        voices = [(layer, c, v.overlap.reshape(-1).tolist(), v.slots.reshape(-1).tolist()) for (layer, c), v in self.voices.items()]
        return head, (bytes(f.buffer), bytes(s.reservoir)), voices

    def restore(self, head: tuple, held: tuple, voices: list[tuple]) -> None:
        f, s = self.framer, self.state
        f.base, lock, f.free, f.skipped, self.frames, self.slots, skip, length, s.unused, s.channels, s.part, s.at, s.time, self.part = head
        f.locked, self.keep = unpacked_lock(lock), None if skip is None else (skip, length)
        f.buffer, s.reservoir = bytearray(held[0]), bytes(held[1])
        self.voices = {(layer, c): Voice(np.array(overlap, float).reshape(32, 18), np.array(slots, np.float32).reshape(-1, 32)) for layer, c, overlap, slots in voices}

    @property
    def skipped(self) -> int:
        return self.framer.skipped

    def kept(self, slot: int) -> tuple[int, int]:
        """The samples of a slot that remain after gapless trimming."""
        if self.keep is None:
            return 0, 32
        skip, length = self.keep
        inside = lambda at: min(max(at - 32 * slot, 0), 32)
        return inside(skip), 32 if length is None else inside(skip + length)

    def feed(self, data: bytes, codes: Codes | Words, prototype: np.ndarray, last: bool = False) -> list[tuple[int, int, np.ndarray, bool]]:
        words, out, three = codes if isinstance(codes, Words) else Words(codes), [], []
        prototype = np.asarray(prototype, float)
        for _, _, frame in self.framer.feed(data, last):
            layer, self.frames = 4 - (frame[1] >> 1 & 3), self.frames + 1
            if layer == 3:
                if self.frames == 1 and "kind" in tags.read_tag(frame):
                    self.keep = tags.gapless_of(frame) if self.trim else None
                else:
                    three.append(frame)
                continue
            try:
                bands, concealed = layer12.decode(frame, self.check_crc), False
            except (ValueError, IndexError):
                if self.strict:
                    raise
                bands, concealed = np.zeros((12 if layer == 1 else 36, layer3.header_facts(frame)["channels"], 32)), True
            for c in range(bands.shape[1]):
                s = bands[:, c].astype(np.float32)
                y = s if concealed else self.voices.setdefault((layer, c), Voice()).synthesise(s, prototype)
                out += [(c, self.slots + k, v, concealed) for k, v in enumerate(y)]
            self.slots += len(bands)
        for p in self.state.feed(three, words, self.check_crc, self.strict):
            out += self._sound(p, prototype)
        return out

    def _sound(self, p: Played, prototype: np.ndarray) -> list[tuple[int, int, np.ndarray, bool]]:
        if p.part != self.part:
            self.part, self.voices = p.part, {}
        out = []
        for c in range(p.channels):
            mine = [r for r in p.rows if r[1] == c]
            if mine:
                x = np.array([r[5] for r in mine]).astype(np.float32).astype(float)
                y = self.voices.setdefault((3, c), Voice()).play(x, *(np.array([r[k] for r in mine]) for k in (2, 3)), prototype)
            else:
                y = np.zeros((18 * p.granules, 32), np.float32)
            out += [(c, self.slots + k, v, p.concealed) for k, v in enumerate(y)]
        self.slots += 18 * p.granules
        return out


class _Decoding(StatefulProcessor):
    def __init__(self, words: Words, prototype: np.ndarray, options: dict, timeout_ms: int | None):
        self.words, self.prototype, self.options, self.timeout_ms = words, prototype, options, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head, self.held = handle.getValueState("head", HEAD), handle.getValueState("held", HELD)
        self.voices, self.waiting = handle.getListState("voices", VOICE), handle.getMapState("waiting", "chunk_no bigint", "bytes binary")

    def _load(self) -> tuple[StreamDecoder, int, int]:
        decoder, counters = StreamDecoder(**self.options), (0, -1)
        if self.head.exists():
            head = tuple(self.head.get())
            decoder.restore(head[:-2], tuple(self.held.get()), list(self.voices.get()))
            counters = head[-2:]
        return decoder, *counters

    def _end(self) -> None:
        for state in (self.head, self.held, self.voices, self.waiting):
            state.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        decoder, turn, last = self._load()
        for p in rows:
            for r in p.itertuples():
                self.waiting.updateValue((int(r.chunk_no),), (bytes(r.bytes or b""),))
                last = int(r.chunk_no) if r.last else last
        out = []
        while self.waiting.containsKey((turn,)):
            out += decoder.feed(bytes(self.waiting.getValue((turn,))[0]), self.words, self.prototype, last=turn == last)
            self.waiting.removeKey((turn,))
            turn += 1
        if 0 <= last < turn:
            self._end()
        else:
            head, held, voices = decoder.state_of()
            self.head.update((*head, turn, last))
            self.held.update(held)
            self.voices.put(voices) if voices else self.voices.clear()
            if self.timeout_ms is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        yield self._sound(key, decoder, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No chunk for so long: the stream ends with what came in turn, a last frame that is cut short too."""
        decoder, *_ = self._load()
        out = decoder.feed(b"", self.words, self.prototype, last=True)
        self._end()
        yield self._sound(key, decoder, out)

    def _sound(self, key, decoder: StreamDecoder, out: list[tuple]) -> pd.DataFrame:
        keep = [decoder.kept(o[1]) for o in out]
        column = lambda values, kind: pd.Series(values, dtype=kind)
        return pd.DataFrame({"stream_id": column([key[0]] * len(out), object), "channel": column([o[0] for o in out], "int32"), "slot": column([o[1] for o in out], "int64"), "s": column([o[2].tolist() for o in out], object), "concealed": column([bool(o[3]) for o in out], bool), "keep_from": column([k[0] for k in keep], "int32"), "keep_to": column([k[1] for k in keep], "int32")})

    def close(self) -> None:
        pass


def stream_decode(chunks: DataFrame, codes: Codes, prototype: np.ndarray, check_crc: bool = False, trim: bool = True, strict: bool = False, timeout_ms: int | None = None) -> DataFrame:
    """Streaming (stream_id, chunk_no, bytes, last) to slots of samples, whatever the chunking; ``last`` ends a stream and drops its state, and so does ``timeout_ms`` without a chunk.

    The options are those of the batch decoder; keep_from and keep_to say what gapless trimming leaves of a slot. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``), whose state can be read by the state data source.
    """
    options = {"strict": strict, "check_crc": check_crc, "trim": trim}
    processor = _Decoding(Words(codes), np.asarray(prototype, dtype=float), options, timeout_ms)
    return chunks.groupBy("stream_id").transformWithStateInPandas(processor, SCHEMA, "append", "none" if timeout_ms is None else "processingTime")
