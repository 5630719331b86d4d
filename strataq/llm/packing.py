"""Packing tokenized documents into fixed windows by minimum bin slack.

Every document is cut into full windows and one remainder. Remainders wait in a bounded pool; the pool is packed
greedily: take the longest piece, find by a bitset subset-sum over the other lengths (an integer's bit s says that s can
be reached) the multiset that leaves the least slack, read its counts back from the saved bitsets, and use it as often
as the counts allow. Pieces may be cut, so a window whose least slack is not zero is filled with a cut piece, and what
is left at the end of a task goes into windows of a power of two.

A task packs its own rows: nothing is shuffled, and memory is the pool whatever the table's size. Sequence ids are the
task's number (upper 31 bits) and a counter, so a rerun of a task gives its sequences the same ids.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

CAPACITY, POOL, END_ID = 2048, 4096, 1
PIECES = "doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def fill(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum comes closest to `room` from below: {length: how many}.

    lengths: the keys of counts in falling order. Later (shorter) lengths are not looked at once `room` is reached.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        if n > room:
            continue
        steps.append((n, reach))
        left, k = min(counts[n], room // n), 1
        while left:
            k = min(k, left)
            reach |= (reach << (n * k)) & mask
            left -= k
            k *= 2
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, {}
    for n, before in reversed(steps):
        k = 0
        while not before >> at & 1:  # the fewest of this length with which the rest was reachable before it
            at -= n
            k += 1
        if k:
            used[n] = k
    return used


class Packer:
    """Packs pieces (doc, doc_tokens, start, ids) into sequences; `emit(piece, sequence, offset)` gets every piece once."""

    def __init__(self, emit, first: int, capacity: int = CAPACITY, pool: int = POOL):
        self.emit, self.next, self.capacity, self.most = emit, first, capacity, pool
        self.by_length: dict[int, list] = defaultdict(list)
        self.held = 0

    def sequence(self, pieces: list) -> None:
        offset = 0
        for p in pieces:
            self.emit(p, self.next, offset)
            offset += len(p[3]) // tokens.ID_BYTES
        self.next += 1

    def add(self, doc, doc_tokens: int, ids: bytes) -> None:
        window = self.capacity * tokens.ID_BYTES
        full = len(ids) // window
        for k in range(full):
            self.sequence([(doc, doc_tokens, k * self.capacity, ids[k * window : (k + 1) * window])])
        if len(ids) > full * window:
            self.put((doc, doc_tokens, full * self.capacity, ids[full * window :]))
        if self.held >= self.most:
            self.drain(self.most // 4)

    def put(self, piece) -> None:
        self.by_length[len(piece[3]) // tokens.ID_BYTES].append(piece)
        self.held += 1

    def take(self, length: int):
        self.held -= 1
        piece = self.by_length[length].pop()
        if not self.by_length[length]:
            del self.by_length[length]
        return piece

    def drain(self, down_to: int) -> None:
        """Packs until at most `down_to` pieces wait; every sequence made here is full."""
        while self.held > down_to:
            lengths = sorted(self.by_length, reverse=True)
            longest = lengths[0]
            counts = {n: len(self.by_length[n]) for n in lengths}
            counts[longest] -= 1
            used = fill(counts, lengths, self.capacity - longest)
            total = longest + sum(n * k for n, k in used.items())
            used[longest] = used.get(longest, 0) + 1
            if total < self.capacity:
                rest = sum(counts.values()) + 1 - sum(used.values())
                if not rest:  # all that is left fits into one window
                    if down_to:
                        return
                    self.tail([self.take(n) for n, k in used.items() for _ in range(k)])
                    continue
                pieces = [self.take(n) for n, k in used.items() for _ in range(k)]
                self.sequence([*pieces, self.cut(min(self.by_length), self.capacity - total)])
                continue
            for _ in range(min(len(self.by_length[n]) // k for n, k in used.items())):
                self.sequence([self.take(n) for n, k in used.items() for _ in range(k)])

    def cut(self, length: int, size: int):
        """The first `size` ids of a waiting piece; the rest goes back. Every waiting piece is longer than the slack."""
        doc, n, start, ids = self.take(length)
        at = size * tokens.ID_BYTES
        if len(ids) > at:
            self.put((doc, n, start + size, ids[at:]))
        return doc, n, start, ids[:at]

    def tail(self, pieces: list) -> None:
        """The last pieces, less than one window in all, as sequences of falling powers of two: none needs padding."""
        total = sum(len(p[3]) for p in pieces) // tokens.ID_BYTES
        for bit in reversed(range(total.bit_length())):
            room, out = (total >> bit & 1) << bit, []
            while room:
                doc, n, start, ids = pieces.pop()
                size = min(room, len(ids) // tokens.ID_BYTES)
                out.append((doc, n, start, ids[: size * tokens.ID_BYTES]))
                if len(ids) > size * tokens.ID_BYTES:
                    pieces.append((doc, n, start + size, ids[size * tokens.ID_BYTES :]))
                room -= size
            if out:
                self.sequence(out)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", most_pieces: int = tokens.MOST) -> DataFrame:
    """One row per piece: doc_id, start (its document's ids before it), length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id and offset (gapless from 0 within a sequence).

    A null or empty text is its end id alone. Repeated rows are packed each. A very long text is cut into many pieces.
    Empty tables give no rows; other columns are ignored whatever their names. `most_pieces` bounds a worker's cache.
    """
    path = vocabulary or tokens.default_path()
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = tokens.encoder(path, most_pieces), np.array([end_id], "<u4").tobytes()
        out: list[list] = [[] for _ in range(7)]
        size = [0]
        id_type = [pa.int64()]

        def emit(piece, sequence: int, offset: int) -> None:
            doc, n, start, ids = piece
            for column, x in zip(out, (doc, start, len(ids) // tokens.ID_BYTES, ids, n, sequence, offset), strict=True):
                column.append(x)
            size[0] += len(ids)

        def flush() -> pa.RecordBatch:
            kinds = (id_type[0], pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            for column in out:
                column.clear()
            size[0] = 0
            return batch

        packer = Packer(emit, TaskContext.get().partitionId() << 32, capacity)
        for batch in batches:
            id_type[0] = batch.schema.field("doc_id").type
            ids = batch.column("doc_id").to_pylist()
            for k, texts in tokens.in_slices(batch.column("text")):
                for doc, found in zip(ids[k : k + len(texts)], encode(texts), strict=True):
                    found += end
                    packer.add(doc, len(found) // tokens.ID_BYTES, found)
                if size[0] > 1 << 24:
                    yield flush()
        packer.drain(0)
        if out[0]:
            yield flush()

    return d.mapInArrow(run, PIECES.format(kind=kind))


def with_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a crc32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
