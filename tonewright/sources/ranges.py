"""Long streams framed in byte ranges, so that one of any length spreads over many tasks.

    AudioRanges        a data source: files cut into ranges, each with ``LOOK_AHEAD`` bytes more than its own; format "audio_ranges"
    frames_of_ranges   the frames of ranges, equal to those of the reader of whole streams

A range is walked from its start without knowing what came before, until its end is reached. What it tells: where frames begin, where the walk leaves, and what it was locked
to. The framing rule depends on nothing but place, lock and free-format length, so two walks that meet in these go on alike; and the ranges of a stream are joined
in order, a row a range: the walk that leaves one range enters the next, and if it meets that range's own walk it leaves where that does. Where it does not (a seam inside a tag or noise, a
false header) the range is walked again from its true entry, in further rounds until none is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..scratch import written
from .framing import FRAME_SCHEMA, Framer

#: More than the longest frame, free format included, and a header behind it.
LOOK_AHEAD = 1 << 14
RANGE_SCHEMA = "stream_id string, range_no bigint, start bigint, size bigint, total bigint, content binary"
_STATE = "entry bigint, lock bigint, free bigint"
_WALK = f"stream_id string, range_no bigint, start bigint, stop bigint, {_STATE}, seen array<bigint>, leave bigint, lock_out bigint, free_out bigint"
_PLAN = f"stream_id string, range_no bigint, {_STATE}, first_no bigint, wanted boolean"


class _Range(InputPartition):
    def __init__(self, path: str, number: int, start: int, size: int, total: int):
        self.path, self.number, self.start, self.size, self.total = path, number, start, size, total


class AudioRanges(DataSource):
    """``spark.read.format("audio_ranges").load(folder or file)``; options: ``rangeBytes`` (32 MB), ``suffixes``. Paths are those of ``pyarrow.fs`` (local, hdfs, s3, gs)."""

    @classmethod
    def name(cls) -> str:
        return "audio_ranges"

    def schema(self) -> str:
        return RANGE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(self.options)


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("rangebytes", options.get("rangeBytes", 1 << 25)))
        self.suffixes = tuple(f".{x.strip()}" for x in options.get("suffixes", "mp1,mp2,mp3,mpa").split(","))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path)
        found = [system.get_file_info(path)]
        if found[0].type == fs.FileType.Directory:
            found = sorted((f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(self.suffixes)), key=lambda f: f.path)
        elif found[0].type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        return [_Range(f.path, k, at, min(self.step, f.size - at), f.size) for f in found for k, at in enumerate(range(0, max(f.size, 1), self.step))]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.path) as f:
            f.seek(partition.start)
            content = f.read(partition.size + LOOK_AHEAD)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        row = (partition.path, partition.number, partition.start, partition.size, partition.total, content)
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["stream_id", "range_no", "start", "size", "total", "content"])


def packed_lock(key: tuple | None) -> int | None:
    return None if key is None else key[0] << 8 | key[1] << 4 | key[2] << 1 | int(key[3])


def unpacked_lock(v: int | None) -> tuple | None:
    return None if v is None else (v >> 8, v >> 4 & 15, v >> 1 & 7, bool(v & 1))


def walk(content: bytes, start: int, size: int, total: int, entry: int, lock: int | None, free: int | None) -> tuple[list, int, int | None, int | None]:
    """Frames that begin in a range, from an entry on; where the walk leaves it, the lock and the free-format length then."""
    framer, found, at, stop = Framer(buffer=bytearray(content), base=start, locked=unpacked_lock(lock), free=free), [], entry - start, min(start + size, total) - start
    whole = start + len(content) >= total
    for last in (False, True) if whole else (False,):
        while at < stop and (step := framer._step(at, last, found)) is not None:
            at = step
    if at < stop and whole:
        at = len(content)  # the rest is skipped
    elif at < stop:
        at = framer._tag_end(at)  # a tag that is longer than what is here
    return found, start + at, packed_lock(framer.locked), framer.free


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _WALK.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 6, pa.list_(pa.int64()), *[pa.int64()] * 3]
    for b in batches:
        rows = []
        for sid, no, start, size, total, content, entry, lock, free in zip(*(b.column(k) if k == 5 else b.column(k).to_pylist() for k in range(9))):
            data = content.as_py()
            found, leave, lock_out, free_out = walk(data, start, size, total, entry, lock, free)
            begins = [total if kind == "truncated" else at for at, kind, _ in found]  # a last frame that is cut short tells no place
            rows.append((sid, no, start, min(start + size, total), entry, lock, free, begins, leave, lock_out, free_out))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks in order of stream and range (one or more a range) to the true entry of each range as far as it is known, and the walks that are wanted."""
    names, kinds = [c.split()[0] for c in _PLAN.split(", ")], [pa.string(), *[pa.int64()] * 5, pa.bool_()]
    stream, state, lost, held, out = None, None, False, [], []

    def settle() -> None:
        """The range whose walks are held."""
        nonlocal state, lost
        if not held:
            return
        sid, no, start, stop = held[0][:4]
        entry, lock, free, count = state
        if lost:
            if not any(w[7] for w in held) and not any(w[5:7] == (lock, free) for w in held):  # nothing in it but noise: walked as if the lock went on
                out.append((sid, no, start, lock, free, None, True))
            return
        if entry >= stop:
            out.append((sid, no, entry, lock, free, count, False))
            return
        for w in held:
            seen = w[7]
            if w[4:7] == (entry, lock, free):
                n = len(seen)
            elif w[9:11] == (lock, free) and lock is not None and (k := int(np.searchsorted(seen, entry))) < len(seen) and seen[k] == entry:
                n = len(seen) - k
            else:
                continue
            out.append((sid, no, entry, lock, free, count, False))
            state = (w[8], w[9], w[10], count + n)
            return
        out.append((sid, no, entry, lock, free, count, True))
        lost = True

    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in range(11))):
            if held and row[:2] != held[0][:2]:
                settle()
                held = []
            if row[0] != stream or state is None:
                stream, state, lost = row[0], (0, None, None, 0), False
            held.append(row)
        if len(out) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)
            out = []
    settle()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for sid, no, start, size, total, content, entry, lock, free, first in zip(*(b.column(k) if k == 5 else b.column(k).to_pylist() for k in range(10))):
            found = walk(content.as_py(), start, size, total, entry, lock, free)[0]
            for at in range(0, len(found), 4096):
                part = found[at : at + 4096]
                cols = [pa.array([sid] * len(part), pa.string()), pa.array(range(first + at, first + at + len(part)), pa.int64()), *(pa.array(list(c)) for c in zip(*part))]
                yield pa.RecordBatch.from_arrays(cols, names=["stream_id", "frame_no", "position", "kind", "bytes"])


def frames_of_ranges(ranges: DataFrame) -> DataFrame:
    """(stream_id, range_no, start, size, total, content: the range's bytes and at least ``LOOK_AHEAD`` behind, as far as the stream goes) to one row per frame, as ``framing.frames`` gives them.

    The ranges of a stream are numbered from 0 and cover it. What passes from range to range is a row, in tables in the shared folder; where Spark finds them small they go to the bytes, else they meet by shuffle.
    """
    base = ranges.select("stream_id", "range_no", "start", "size", "total", "content")
    none = F.lit(None).cast("bigint")
    walks = written(base.withColumns({"entry": F.col("start"), "lock": none, "free": none}).mapInArrow(_walks, _WALK), "walks")
    while True:
        plan = written(walks.repartition("stream_id").sortWithinPartitions("stream_id", "range_no").mapInArrow(_resolve, _PLAN), "plan")
        wanted = plan.where("wanted").drop("wanted", "first_no")
        if wanted.isEmpty():
            break
        again = base.join(wanted, ["stream_id", "range_no"]).select(*base.columns, "entry", "lock", "free")
        walks = walks.unionByName(written(again.mapInArrow(_walks, _WALK), "walks"))
    entries = plan.select("stream_id", "range_no", "entry", "lock", "free", "first_no")
    whole = base.join(entries, ["stream_id", "range_no"]).where(F.col("entry") < F.col("start") + F.col("size"))
    return whole.select(*base.columns, "entry", "lock", "free", "first_no").mapInArrow(_emit, FRAME_SCHEMA)


def read_frames(spark: SparkSession, path: str, range_bytes: int = 1 << 25) -> DataFrame:
    """The frames of a folder's streams, each stream cut into ranges."""
    spark.dataSource.register(AudioRanges)
    return frames_of_ranges(spark.read.format("audio_ranges").option("rangeBytes", range_bytes).load(path))


def cut(streams: DataFrame, step: int, look_ahead: int = LOOK_AHEAD) -> DataFrame:
    """(stream_id, content) held in cells to ranges of ``step`` bytes."""
    total = F.length("content").cast("bigint")
    t = streams.where("content IS NOT NULL").select("stream_id", "content", total.alias("total"))
    t = t.select("stream_id", "content", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("total") / step) - 1, F.lit(0)).cast("bigint"))).alias("range_no"))
    start = F.col("range_no") * step
    return t.select("stream_id", "range_no", start.alias("start"), F.least(F.lit(step), F.col("total") - start).cast("bigint").alias("size"), "total", F.substring("content", (start + 1).cast("int"), F.lit(step + look_ahead)).alias("content"))
