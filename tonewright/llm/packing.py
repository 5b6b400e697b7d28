"""Vector bin packing of token pieces into training sequences.

Every example is a vector: tokens, one segment, loss-bearing tokens. The
dot-product heuristic fills one sequence at a time: among the waiting pieces that
fit under all three limits it takes the one whose vector has the largest dot
product with what is still free. When no waiting piece fits, the largest is cut to fill the
sequence to its end, so padding arises only where the segment limit binds or at
the end of a partition, whose last tokens go into sequences of power-of-two
lengths.

Packing runs inside each input partition: nothing is shuffled, a partition holds
at most ``BLOCK`` waiting examples, and sequence ids carry the partition number.
A lost executor repeats its partitions with the same result.

Null and empty texts give the end id alone. Repeated rows, and rows without an id, are packed each on its
own. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import bytewise

SEQUENCE = 4096
END_ID = 2
MAX_SEGMENTS = 512
BLOCK = 512
BLOCK_BYTES = 1 << 22
STEP = 1 << 16
LONGEST = 32  # longer pieces of a word go to the tokenizers library
_NONE = 1 << 30


class TextEncoder:
    """Ids of whole texts by a byte-pair tokenizer that folds case, drops white space and tells runs of letters, single digits and runs of marks apart.

    A block of texts is cut into such pieces, and each distinct piece is encoded once. Pieces of ASCII and Latin-1 letters, digits and marks are
    merged here, all together, pair by pair in the order of the tokenizer's merges; words with anything else go to the tokenizers library as they stand.
    Nothing is kept from block to block.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.special[0]
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        model = json.loads(self.tokenizer.to_str())["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [(a, b) for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        key = np.array([vocabulary[a] << 16 | vocabulary[b] for a, b in pairs], np.uint32)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        plain = [k for k in range(256) if 33 <= k <= 126 or 161 <= k <= 172 or k >= 174]  # the bytes that byte-level tokenizers write as themselves
        names = {k: chr(k) for k in plain} | {k: chr(256 + n) for n, k in enumerate(k for k in range(256) if k not in plain)}
        self.inner = np.array([vocabulary[names[k]] for k in range(256)], np.int32)
        self.last = np.array([vocabulary[names[k] + end] for k in range(256)], np.int32)

    def _library(self, words: list[bytes]) -> list[np.ndarray]:
        """A few hundred words at a time, one special token between them; words that hold one alone."""
        texts, out = [w.decode("utf-8", "replace") for w in words], [None] * len(words)
        plain = [k for k, t in enumerate(texts) if not any(x in t for x in self.special)]
        for at in range(0, len(plain), 256):
            part = plain[at : at + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(texts[k] for k in part)], add_special_tokens=False)[0].ids, np.int32)
            cuts = [-1, *np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            for n, k in enumerate(part):
                out[k] = ids[cuts[n] + 1 : cuts[n + 1]]
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32) if o is None else o for t, o in zip(texts, out)]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; ``_NONE`` where there is no such merge, or no symbol."""
        key = a.astype(np.uint32) << np.uint32(16) | (b.astype(np.uint32) & np.uint32(0xFFFF))
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], _NONE)

    def _merge(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols (-1 behind the end) after all merges, each time the one of least rank, the first of equal ones."""
        out = np.full_like(symbols, -1)
        rows, width = np.arange(len(symbols)), symbols.shape[1]
        if width > 1:
            rank, cols = self._rank(symbols[:, :-1], symbols[:, 1:]), np.arange(width)
        while width > 1 and len(rows):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            done = best == _NONE
            if done.any():
                out[rows[done], : symbols.shape[1]] = symbols[done]
                rows, symbols, rank, at, best = (x[~done] for x in (rows, symbols, rank, at, best))
            if not len(rows):
                break
            line = np.arange(len(rows))
            symbols[line, at] = self.merged[best]
            symbols = np.take_along_axis(np.c_[symbols, np.full(len(rows), -1, np.int32)], cols + (cols > at[:, None]), axis=1)
            rank = np.take_along_axis(np.c_[rank, np.full(len(rows), _NONE, rank.dtype)], cols[:-1] + (cols[:-1] >= at[:, None]), axis=1)
            here = np.minimum(at, width - 2)
            rank[line, here] = np.where(at < width - 1, self._rank(symbols[line, here], symbols[line, here + 1]), rank[line, here])
            before = np.maximum(at - 1, 0)
            rank[line, before] = np.where(at > 0, self._rank(symbols[line, before], symbols[line, before + 1]), rank[line, before])
        return out if width > 1 else symbols

    def _distinct(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after the other, and where each starts and the last ends."""
        size, found = ends - starts, [np.zeros(0, np.int32)] * len(starts)
        odd = odd | (size > LONGEST)
        at, raw = np.flatnonzero(odd), body.tobytes()
        for k, ids in zip(at.tolist(), self._library([raw[starts[k] : ends[k]] for k in at.tolist()])):
            found[k] = ids
        count = np.array([len(x) for x in found], np.int64)
        parts = []
        for lo, hi in ((0, 4), (4, 8), (8, 16), (16, LONGEST)):
            at = np.flatnonzero(~odd & (size > lo) & (size <= hi))
            cols = np.arange(hi)
            inside = cols < size[at][:, None]
            byte = body[np.where(inside, starts[at][:, None] + cols, 0)]
            symbols = np.where(inside, np.where(cols == size[at][:, None] - 1, self.last[byte], self.inner[byte]), -1).astype(np.int32)
            symbols = self._merge(symbols)
            count[at] = (symbols >= 0).sum(axis=1)
            parts.append((at, symbols))
        edges = np.cumsum(np.r_[0, count])
        flat = np.zeros(edges[-1], np.int32)
        for at, symbols in parts:
            there = symbols >= 0
            flat[(edges[at][:, None] + np.arange(symbols.shape[1]))[there]] = symbols[there]
        for k in np.flatnonzero(odd).tolist():
            flat[edges[k] : edges[k + 1]] = found[k]
        return flat, edges

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a block, then the end id."""
        parts, base = [], 0
        last = np.zeros(len(column), np.int64)
        count = 0
        for t in bytewise.texts(column):
            body, starts, ends, odd = pieces(t)
            last[t.first : t.after] = count + np.searchsorted(starts, t.edges[1:])  # each text's pieces, then the end
            parts.append((body, bytewise.hash_ranges(body, starts, ends) ^ odd, (starts + base).astype(np.int32), (ends + base).astype(np.int32), odd))
            base, count = base + len(body), count + len(starts)
        if not parts:
            return []
        body, h, starts, ends, odd = (np.concatenate(c) for c in zip(*parts))
        del parts
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        which = which.astype(np.int32)
        if not all(same_ranges(body, starts, ends, one[which[k : k + STEP]], k) for k in range(0, count, STEP)):  # two pieces of one hash
            named = {}
            which = np.array([named.setdefault((bool(o), body[a:b].tobytes()), len(named)) for a, b, o in zip(starts.tolist(), ends.tolist(), odd)], np.int32)
            _, one = np.unique(which, return_index=True)
        flat, edges = self._distinct(body, starts[one], ends[one], odd[one])
        del body, h, starts, ends
        flat, edges = np.r_[flat, END_ID].astype("<u4"), np.r_[edges, edges[-1] + 1].astype(np.int32)
        which = np.insert(which, last, len(edges) - 2)
        size = np.diff(edges)[which]
        total = np.cumsum(size, dtype=np.int64)
        at = np.repeat((edges[which] - (total - size)).astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        return np.split(flat[at], total[last + np.arange(len(last))][:-1])


def pieces(t: bytewise.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with case folded, where pieces start and end, and which of them are whole words for the library (their bytes as they stand)."""
    w, d = bytewise.words(t), t.data
    body = bytewise.fold(d)
    lead = d == 0xC3
    behind = np.r_[False, lead[:-1]] & (d >= 0x80) & (d != 0x97) & (d != 0xB7)
    letter = ((body >= 97) & (body <= 122)) | behind | (lead & np.r_[behind[1:], False])
    digit = (d >= 48) & (d <= 57)
    mark = (d > 32) & (d < 127) & (d != 39) & ~letter & ~digit
    mark &= ~((d == 60) & np.r_[d[1:] == 124, False])  # what may begin a special token
    kind = letter * np.int8(1) + digit * np.int8(2) + mark * np.int8(3)
    solid = np.zeros(len(d) + 1, np.int8)
    solid[w.starts], solid[w.ends] = 1, 0
    inside = np.zeros(len(d) + 1, np.int64)
    inside[w.starts] += 1
    np.subtract.at(inside, w.ends, 1)
    within = np.cumsum(inside[:-1]) > 0
    strange = np.add.reduceat((within & (kind == 0)).astype(np.int32), w.starts) > 0 if len(w.starts) else np.zeros(0, bool)
    word = np.cumsum(np.bincount(w.starts, minlength=len(d))[: len(d)]) - 1
    plain = within & ~strange[np.maximum(word, 0)] if len(strange) else within
    begin = plain & ((kind != np.r_[np.int8(0), kind[:-1]]) | digit)
    begin[w.starts] = True
    starts = np.flatnonzero(begin)
    mine = word[starts]
    ends = np.minimum(np.r_[starts[1:], len(d)], w.ends[mine]) if len(starts) else starts
    body = np.where(plain, np.where(behind & (d <= 0x9E), body + np.uint8(32), body), d)
    return body, starts, ends, strange[mine] if len(starts) else np.zeros(0, bool)


def same_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, first: int) -> bool:
    """True if the ranges from ``first`` on hold the same bytes as the other ones named for them."""
    mine, stops = starts[other], ends[other]
    starts = starts[first : first + len(other)]
    size = ends[first : first + len(other)] - starts
    if (size != stops - mine).any():
        return False
    total = np.cumsum(size)
    off = np.arange(total[-1]) - np.repeat(total - size, size)
    return bool((data[np.repeat(starts, size) + off] == data[np.repeat(mine, size) + off]).all())


#: Encoders live as long as their Python worker; they hold the tokenizer and its merges, nothing of the texts.
_ENCODERS: dict[str, TextEncoder] = {}


def _encoder(tokenizer_file: str) -> TextEncoder:
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = TextEncoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


class Packer:
    """Pieces waiting for a sequence, and the sequences closed so far.

    limits: tokens, segments and loss-bearing tokens of a sequence. ``loss`` of an
    example is None where all its tokens bear loss, else one flag per token.
    """

    def __init__(self, first_sequence: int, limits: tuple[int, int, int]):
        self.limits = np.array(limits, dtype=float)
        self.sequence = first_sequence
        self.waiting: list[tuple] = []  # (doc_id, start, ids, loss, doc_tokens)
        self.needs: list[tuple[int, int, int]] = []  # their vectors
        self.placed: list[tuple] = []  # (doc_id, start, ids, doc_tokens, sequence, offset)
        self.tokens = 0

    @staticmethod
    def _reach(loss: np.ndarray | None, n: int, most: float) -> int:
        """How many of the first n tokens stay within ``most`` loss-bearing ones."""
        return int(min(n, most) if loss is None else np.searchsorted(np.cumsum(loss[:n]), most, side="right"))

    def _wait(self, piece: tuple) -> None:
        self.waiting.append(piece)
        n = len(piece[2])
        self.needs.append((n, 1, n if piece[3] is None else int(piece[3].sum())))
        self.tokens += n

    def add(self, doc_id, ids: np.ndarray, loss: np.ndarray | None = None) -> None:
        size, whole, at = int(self.limits[0]), len(ids), 0
        while at < whole:
            part = None if loss is None else loss[at : at + size]
            n = self._reach(part, min(size, whole - at), self.limits[2])
            if n == size:
                self.placed.append((doc_id, at, ids[at : at + n], whole, self.sequence, 0))
                self.sequence += 1
            else:
                self._wait((doc_id, at, ids[at : at + n], None if part is None else part[:n], whole))
            at += n

    def fill(self, capacity: int) -> None:
        """Close one sequence of at most ``capacity`` tokens."""
        free = np.array([capacity, self.limits[1], self.limits[2]], dtype=float)
        need = np.array(self.needs, dtype=float)
        scaled, offset, gone = need / self.limits**2, 0, set()
        while free[0] > 0 and free[1] > 0 and len(gone) < len(need):
            value = scaled @ free
            value[(need > free).any(axis=1)] = -1.0
            k = int(value.argmax())
            doc_id, start, ids, loss, whole = self.waiting[k]
            n = len(ids)
            if value[k] < 0:  # none fits: cut the largest
                k = int(np.where(need[:, 0] < np.inf, need[:, 0], -1.0).argmax())
                doc_id, start, ids, loss, whole = self.waiting[k]
                n = self._reach(loss, min(int(free[0]), len(ids)), free[2])
                if n == 0:
                    break
                rest = None if loss is None else loss[n:]
                self.waiting[k] = (doc_id, start + n, ids[n:], rest, whole)
                self.needs[k] = (len(ids) - n, 1, len(ids) - n if loss is None else int(rest.sum()))
                need[k] = self.needs[k]
                scaled[k] = need[k] / self.limits**2
            else:
                gone.add(k)
                need[k] = np.inf
                scaled[k] = 0.0
            self.placed.append((doc_id, start, ids[:n], whole, self.sequence, offset))
            offset += n
            free -= (n, 1, n if loss is None else int(loss[:n].sum()))
        self.sequence += 1
        self.tokens -= offset
        self.waiting = [p for k, p in enumerate(self.waiting) if k not in gone]
        self.needs = [p for k, p in enumerate(self.needs) if k not in gone]

    def drain(self, last: bool) -> None:
        """Close full sequences; at the end of a partition, also what is left, in power-of-two lengths."""
        size = int(self.limits[0])
        while self.tokens >= size:
            self.fill(size)
        while last and self.tokens:
            self.fill(1 << (self.tokens.bit_length() - 1))


SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def _rows(placed: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*placed))
    long = lambda x: pa.array(x, pa.int64())
    arrays = [long(cols[0]), long(cols[1]), long([len(x) for x in cols[2]]), long(cols[3]), long(cols[4]), long(cols[5]), pa.array([x.tobytes() for x in cols[2]], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def _packed(examples: Iterator[tuple], limits: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """(id, ids, loss) to pieces placed in sequences."""
    packer = Packer(TaskContext.get().partitionId() << 40, limits)
    for n, (doc_id, ids, loss) in enumerate(examples, 1):
        packer.add(doc_id, ids, loss)
        if n % BLOCK == 0:
            packer.drain(last=False)
        if len(packer.placed) >= BLOCK:
            yield _rows(packer.placed)
            packer.placed = []
    packer.drain(last=True)
    if packer.placed:
        yield _rows(packer.placed)


def pack_examples(examples: DataFrame, sequence: int = SEQUENCE, max_segments: int = MAX_SEGMENTS, max_loss: int = SEQUENCE) -> DataFrame:
    """``id``, ``ids`` (array of ints) and ``loss`` (array of booleans, one per id; null: all bear loss) to pieces, as ``pack_documents`` has them.

    Made for the output of ``chat.format_conversations``: no sequence holds more than ``max_loss`` loss-bearing tokens. Null ids of an example are none.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for b in batches:
                for example, ids, loss in zip(*b.columns):
                    got = np.asarray(ids.values if ids.is_valid else [], "<u4")
                    yield example.as_py(), got, np.asarray(loss.values.to_numpy(zero_copy_only=False), np.int64) if loss.is_valid else None

        yield from _packed(each(), (sequence, max_segments, max_loss))

    rows = examples.select(F.col("id").cast("bigint"), F.col("ids").cast("array<bigint>"), F.col("loss").cast("array<boolean>"))
    return rows.mapInArrow(pack, SCHEMA)


def pack_documents(docs: DataFrame, tokenizer_file: str, sequence: int = SEQUENCE, max_segments: int = MAX_SEGMENTS, max_loss: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    All tokens of a document bear loss.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            encode = _encoder(tokenizer_file)
            for b in batches:
                for t in bytewise.texts(b.column(1), BLOCK_BYTES):
                    rows = slice(t.first, t.after)
                    for doc_id, ids in zip(b.column(0)[rows].to_pylist(), encode(b.column(1)[rows])):
                        yield doc_id, ids, None

        yield from _packed(each(), (sequence, max_segments, max_loss))

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(pack, SCHEMA)
