"""Token-id files coded by an adaptive context-mixing range coder.

A file is a run of segments; a segment holds up to LANES blocks of BLOCK ids. Every block is coded on its own: all its
models start empty, it has its own code words and its own checksum, and nothing but the largest id is shared. For each
id three predictions are mixed: the id that last followed the two ids before (order 2), the id that last followed the
one before (order 1), and how often ids stood in the block so far (order 0). Order 0 keeps an id in the slot its hash
names; counts become frequencies at the steps of EPOCHS. An id that no slot holds is coded by its length and offset. The
weights of orders 2 and 1 are learned at the same steps, from how often a prediction of the same confidence came true.
The mixture's interval for the id narrows a 64-bit carry-less range coder.

Tables are coded in the JVM (`native`), block after block; Python makes the ids and the files. The same coder over arrays is
here too, for files outside Spark and sessions whose JVM is out of reach: it codes all blocks of a segment in step, one id
of each at a time, so a step is a few array operations. Both give the same words, and the same ids for a block when it is
coded alone. Layout, little-endian:

    file     magic "SQTK", version, then segments
    segment  header (ids, docs, blocks, largest id, section sizes), symbols, documents, block sizes, crcs, words
    sections documents deflated (doc_id, ids, ends) triples; block sizes, crcs and words plain 32-bit

A document may span blocks and segments; its entry says how many of its ids the segment holds and whether it ends there.
A segment may hold any number of different ids. Where one is 2**25 or more, as in no vocabulary, the ids' ranks are coded
instead and `symbols` lists the ids, as deflated deltas; elsewhere it is empty.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import native, tokens
from .common import Scratch
from .warc import storage

MAGIC, VERSION = b"SQTK", 2
PREFIX = MAGIC + struct.pack("<I", VERSION)
#: Blocks of a segment that the JVM codes: a row of 2 MB.
ROW_LANES = 64
#: Files that begin within so many ids share a task that reads them: each task starts processes and writes a file of rows.
READ_IDS = 1 << 20
BLOCK, LANES, STRETCH = 8192, 1536, 16
SLOTS0, SLOTS1, SLOTS2, CONFIDENT = 1024, 1024, 2048, 15
#: Units as powers of two: of the mixture, of order-0 frequencies, of the code of unseen ids and of its look-up.
BITS, COUNTS, LAW, GRAINS = 24, 12, 30, 12
ONE, ID_BITS = 1 << BITS, 25
#: Steps of a block after which counts become frequencies.
EPOCHS = (32, 64, 128, 256, 512, 1024, 1536, 2048, 3072, 4096, 6144)
HEADER = struct.Struct("<QIIIIIIII")  # ids, docs, blocks, largest id, sizes of five sections
U = np.uint64
WORD, LOW, LOW32 = U(32), U(0xFFFFFFFF), 0xFFFFFFFF
ONCE, FOUR, MOST = np.uint32(1), np.uint32(4), np.uint32(CONFIDENT)
HASH1, HASH2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
SHIFT0, SHIFT1, SHIFT2 = (np.uint32(33 - slots.bit_length()) for slots in (SLOTS0, SLOTS1, SLOTS2))


class Law:
    """How a block's unseen ids are coded: a share for each bit length up to the largest, equal ones for ids of a length."""

    def __init__(self, largest: int):
        lengths = np.arange(int(largest).bit_length() + 1)
        share = (lengths + 1) ** 2
        n = np.where(lengths > 0, 1 << np.maximum(lengths - 1, 0), 1)
        grain = 1 << LAW - GRAINS
        width = np.maximum(share * (1 << GRAINS) // share.sum(), 1) * grain  # of a length: whole grains, so that `find` is a look-up
        self.first, self.size, self.begin, self.largest = np.where(lengths > 0, n, 0), width // n, np.cumsum(width) - width, largest
        self.length = np.repeat(lengths, width // grain)
        self.length = np.pad(self.length, (0, (1 << GRAINS) - len(self.length)), mode="edge")

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, size) of ids in units of 2**-LAW."""
        b = np.frexp(x.astype(np.float64))[1]
        size = self.size.take(b)
        return self.begin.take(b) + (x - self.first.take(b)) * size, size

    def find(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, size) of the ids that points lie in."""
        b = self.length.take(v >> LAW - GRAINS)
        size, begin, first = self.size.take(b), self.begin.take(b), self.first.take(b)
        at = np.minimum((v - begin) // size, self.largest - first)
        return first + at, begin + at * size, size


class Models:
    """The models of all blocks of a segment, one lane each. Tables change at every step for orders 2 and 1, at EPOCHS for order 0."""

    def __init__(self, lanes: int, decoding: bool):
        self.lanes, self.decoding = lanes, decoding
        lane = np.arange(lanes, dtype=np.int64)
        self.t1, self.t2 = np.zeros(lanes * SLOTS1, np.uint32), np.zeros(lanes * SLOTS2, np.uint32)  # id + 1, confidence
        self.base1, self.base2, self.base_p = lane * SLOTS1, lane * SLOTS2, lane * (CONFIDENT + 1)
        self.base0, self.none = lane * (SLOTS0 + 1), lane * (SLOTS0 + 1) + SLOTS0
        self.held = np.zeros((lanes, SLOTS0 + 1), np.uint32)  # id + 1 of a slot; the last slot is for ids that none holds
        self.count = np.zeros((lanes, SLOTS0 + 1), np.int32)
        self.tried, self.true = np.zeros((2, 2, lanes, CONFIDENT + 1), np.int64)
        self.settle()

    def settle(self) -> None:
        """Counts to frequencies. A slot in use has at least one unit of 2**-COUNTS; what rounding leaves goes to unseen ids."""
        used = self.count > 0
        used[:, SLOTS0] = True
        total = self.count.sum(1, dtype=np.int64) + 1
        room = (1 << COUNTS) - used.sum(1)
        scaled = (self.count * (room / total).astype(np.float32)[:, None]).astype(np.int32)  # one rounded product, the same everywhere
        scaled += used
        scaled[:, SLOTS0] += (1 << COUNTS) - scaled.sum(1, dtype=np.int32)
        begin = np.cumsum(scaled, axis=1, dtype=np.int32)
        begin -= scaled
        both = begin << COUNTS + 1 | scaled
        self.t0 = (self.held.astype(np.int64) << 32 | both).ravel()  # id + 1, begin, size
        self.unseen = both[:, SLOTS0].astype(np.int64)
        if self.decoding:
            self.look = np.repeat(np.tile(np.arange(SLOTS0 + 1, dtype=np.uint16), self.lanes), scaled.ravel())
            self.base_look = np.arange(self.lanes, dtype=np.int64) << COUNTS
        prior = 2 * np.arange(CONFIDENT + 1) + 1
        chance = (2 * self.true + prior << BITS) // (2 * self.tried + 2 * (CONFIDENT + 3))
        chance[..., 0] = 0  # an empty entry predicts nothing
        self.p1, self.p2 = np.minimum(chance, ONE - (ONE >> 4)).reshape(2, -1)

    def contexts(self, last: np.ndarray, last2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of orders 1 and 2."""
        h = last * HASH1
        return (h >> SHIFT1) + self.base1, ((h ^ last2 * HASH2) >> SHIFT2) + self.base2

    def slots(self, ids: np.ndarray) -> np.ndarray:
        return (ids * HASH1 >> SHIFT0) + self.base0

    def learn(self, ids: np.ndarray, seen1: np.ndarray, seen2: np.ndarray) -> None:
        """ids: the steps coded since the last call; seen1, seen2: confidence * 2 + whether the prediction came true."""
        key, held, lane = self.slots(ids), self.held.ravel(), np.arange(self.lanes, dtype=np.int64) * (2 * CONFIDENT + 2)
        self.count[:, SLOTS0] += (held.take(key) != ids + ONCE).sum(0, dtype=np.int32)
        held[key] = ids + ONCE
        self.count += np.bincount(key.ravel(), minlength=self.count.size).reshape(self.count.shape).astype(np.int32)
        for k, seen in enumerate((seen1, seen2)):
            n = np.bincount((seen + lane).ravel(), minlength=self.lanes * (2 * CONFIDENT + 2)).reshape(self.lanes, CONFIDENT + 1, 2)
            self.true[k] += n[..., 1]
            self.tried[k] += n.sum(2)
        self.settle()


def _narrow(low: np.ndarray, span: np.ndarray, begin: np.ndarray, size: np.ndarray, bits: int) -> None:
    """Cuts the range to an interval in units of 2**-bits."""
    span >>= U(bits)
    low += span * begin.view(U)
    span *= size.view(U)


def _due(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes whose range has at most 32 bits left, and their upper 32 bits, which are shifted out. A range that could still
    carry into them is cut."""
    k = np.flatnonzero(span <= LOW)
    lw = low.take(k)
    span[k] = np.minimum(span.take(k), U(1 << 32) - (lw & LOW)) << WORD
    low[k] = lw << WORD
    return k, lw >> WORD


def encode_blocks(ids: np.ndarray, largest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Codes ids as blocks: (words of each block, code words of each block)."""
    lanes, steps = -(-len(ids) // BLOCK), min(BLOCK, len(ids))
    grid = np.zeros(lanes * steps, np.uint32)  # the last block is filled up with zeros
    grid[: len(ids)] = ids
    grid = np.vstack([np.zeros((2, lanes), np.uint32), grid.reshape(lanes, steps).T])  # a row for each step, after two of none
    law, m = Law(largest), Models(lanes, False)
    t1, t2 = m.t1, m.t2
    low, span = np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
    room = 2 * steps + 4
    home = np.arange(lanes) * room
    out, at = np.zeros(lanes * room, np.uint32), home.copy()
    seen1, seen2 = np.zeros((2, steps, lanes), np.uint8)

    def emit() -> None:
        k, word = _due(low, span)
        a = at.take(k)
        out[a] = word
        at[k] = a + 1

    learnt = 0
    for begun in range(0, steps, STRETCH):
        ended = min(begun + STRETCH, steps)
        # what no step of the stretch changes
        x = grid[begun + 2 : ended + 2]
        entry1, entry2 = m.contexts(grid[begun + 1 : ended + 1], grid[begun:ended])
        symbols = x + ONCE
        fresh = symbols << FOUR | ONCE
        slot = m.t0.take(m.slots(x))
        known = slot >> 32 == symbols
        slot = np.where(known, slot & LOW32, m.unseen)
        first = slot >> COUNTS + 1
        after = first + (slot & (2 << COUNTS) - 1)
        for r, t in enumerate(range(begun, ended)):
            i1, i2, symbol = entry1[r], entry2[r], symbols[r]
            e1, e2 = t1.take(i1), t2.take(i2)
            c1, c2 = e1 & MOST, e2 & MOST
            s1, s2 = e1 >> FOUR, e2 >> FOUR
            hit2, hit1 = s2 == symbol, s1 == symbol
            w2 = m.p2.take(m.base_p + c2)
            w1 = ((ONE - w2) * m.p1.take(m.base_p + c1) >> BITS) * (s1 != s2)
            both = w2 + w1
            rest = ONE - both
            begin = first[r] * rest >> COUNTS
            size = (after[r] * rest >> COUNTS) - begin
            begin += both
            by1 = hit1 & ~hit2
            np.copyto(begin, w2, where=by1)
            np.copyto(size, w1, where=by1)
            begin *= ~hit2
            np.copyto(size, w2, where=hit2)
            seen1[t], seen2[t] = (c1 << ONCE | by1) * ~hit2, c2 << ONCE | hit2  # order 1 is judged where order 2 failed
            t2[i2] = np.where(hit2, e2 + (c2 < MOST), fresh[r])
            t1[i1] = np.where(hit1, e1 + (c1 < MOST), fresh[r])
            _narrow(low, span, begin, size, BITS)
            emit()
            apart = np.flatnonzero(~(known[r] | hit2 | hit1))
            if len(apart):
                lw, sp = low.take(apart), span.take(apart)
                _narrow(lw, sp, *law.of(x[r].take(apart).astype(np.int64)), LAW)
                low[apart], span[apart] = lw, sp
                emit()
        if ended in EPOCHS:
            m.learn(grid[learnt + 2 : ended + 2], seen1[learnt:ended], seen2[learnt:ended])
            learnt = ended
    for _ in range(2):
        out[at] = low >> WORD
        at += 1
        low <<= WORD
    return at - home, [out[a:b] for a, b in zip(home, at, strict=True)]


def decode_blocks(total: int, largest: int, used: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The inverse: `total` ids from the blocks' code words, one block after another in `words`."""
    lanes, steps = len(used), min(BLOCK, total)
    law, m = Law(largest), Models(lanes, True)
    t1, t2 = m.t1, m.t2
    at = np.cumsum(used) - used
    words = np.concatenate([words, np.zeros(2, np.uint32)])
    low, span = np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
    code = words[at].astype(U) << WORD | words[at + 1]
    at += 2
    grid = np.zeros((steps + 2, lanes), np.uint32)
    seen1, seen2 = np.zeros((2, steps, lanes), np.uint8)
    learnt = 0

    def take_in() -> None:
        k, _ = _due(low, span)
        a = at.take(k)
        code[k] = code.take(k) << WORD | words.take(a)
        at[k] = a + 1

    for t in range(steps):
        i1, i2 = m.contexts(grid[t + 1], grid[t])
        e1, e2 = t1.take(i1), t2.take(i2)
        c1, c2 = e1 & MOST, e2 & MOST
        s1, s2 = e1 >> FOUR, e2 >> FOUR
        w2 = m.p2.take(m.base_p + c2)
        w1 = ((ONE - w2) * m.p1.take(m.base_p + c1) >> BITS) * (s1 != s2)
        both = w2 + w1
        rest = ONE - both
        v = np.minimum((code - low) // (span >> U(BITS)), U(ONE - 1)).view(np.int64)
        by2, by1 = v < w2, v < both
        by1 &= ~by2
        v -= both
        np.maximum(v, 0, out=v)
        key = m.look.take(m.base_look + ((v + 1 << COUNTS) - 1) // rest) + m.base0
        slot = m.t0.take(key)
        symbol = (slot >> 32).astype(np.uint32)
        slot &= LOW32
        first = slot >> COUNTS + 1
        begin = first * rest >> COUNTS
        size = ((first + (slot & (2 << COUNTS) - 1)) * rest >> COUNTS) - begin
        begin += both
        np.copyto(begin, w2, where=by1)
        np.copyto(size, w1, where=by1)
        begin *= ~by2
        np.copyto(size, w2, where=by2)
        _narrow(low, span, begin, size, BITS)
        take_in()
        np.copyto(symbol, s1, where=by1)
        np.copyto(symbol, s2, where=by2)
        apart = np.flatnonzero(symbol == 0)
        if len(apart):
            lw, sp = low.take(apart), span.take(apart)
            x, begin, size = law.find(np.minimum((code.take(apart) - lw) // (sp >> U(LAW)), U((1 << LAW) - 1)).view(np.int64))
            symbol[apart] = x + 1
            _narrow(lw, sp, begin, size, LAW)
            low[apart], span[apart] = lw, sp
            take_in()
        seen1[t], seen2[t] = (c1 << ONCE | by1) * ~by2, c2 << ONCE | by2
        fresh = symbol << FOUR | ONCE
        t2[i2] = np.where(by2, e2 + (c2 < MOST), fresh)
        t1[i1] = np.where(s1 == symbol, e1 + (c1 < MOST), fresh)
        np.subtract(symbol, ONCE, out=grid[t + 2])
        if t + 1 in EPOCHS:
            m.learn(grid[learnt + 2 : t + 3], seen1[learnt : t + 1], seen2[learnt : t + 1])
            learnt = t + 1
    return np.ascontiguousarray(grid[2:].T).ravel()[:total]


def described(ids: np.ndarray, docs: list[tuple[int, int, int]]) -> tuple[dict, np.ndarray]:
    """What a segment holds besides the coded ids, and these; docs: (doc_id, how many of its ids are here, whether it ends here)."""
    coded, symbols = ids, np.zeros(0, np.uint32)
    if int(ids.max()) >> ID_BITS:
        symbols, coded = np.unique(ids, return_inverse=True)
    data = ids.astype("<u4", copy=False).tobytes()
    crcs = np.array([zlib.crc32(data[k : k + 4 * BLOCK]) for k in range(0, len(data), 4 * BLOCK)], "<u4")
    symbols = zlib.compress(np.diff(symbols, prepend=np.uint32(0)).astype("<u4").tobytes())
    return {"total": len(ids), "n_docs": len(docs), "largest": int(coded.max()), "symbols": symbols, "docs": zlib.compress(np.array(docs, "<i8").tobytes()), "crcs": crcs.tobytes()}, coded


def joined(held: dict, used: bytes, words: bytes) -> bytes:
    """A segment of its parts."""
    sections = [held["symbols"], held["docs"], used, held["crcs"], words]
    return HEADER.pack(held["total"], held["n_docs"], len(used) // 4, held["largest"], *map(len, sections)) + b"".join(sections)


def pack_segment(ids: np.ndarray, docs: list[tuple[int, int, int]]) -> bytes:
    held, coded = described(ids, docs)
    used, words = encode_blocks(coded, held["largest"])
    return joined(held, used.astype("<u4").tobytes(), np.concatenate(words).astype("<u4").tobytes())


def raw_segment(f) -> dict | None:
    """The parts of the next segment as they are in the file, None at the end."""
    head = f.read(HEADER.size)
    if not head:
        return None
    try:
        total, n_docs, _, largest, *sizes = HEADER.unpack(head)
    except struct.error as e:
        raise ValueError("damaged segment") from e
    parts = dict(zip(("symbols", "docs", "used", "crcs", "words"), [f.read(k) for k in sizes], strict=True))
    return {"total": total, "n_docs": n_docs, "largest": largest, **parts}


def read_segment(f) -> tuple[np.ndarray, np.ndarray] | None:
    """(ids, docs) of the next segment, None at the end; damage anywhere in it raises ValueError."""
    held = raw_segment(f)
    if held is None:
        return None
    try:
        used = np.frombuffer(held["used"], "<u4").astype(np.int64)
        return checked(held, decode_blocks(held["total"], held["largest"], used, np.frombuffer(held["words"], "<u4")))
    except (zlib.error, IndexError) as e:
        raise ValueError("damaged segment") from e


def checked(held: dict, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, docs) of a segment whose blocks are decoded."""
    symbols = np.cumsum(np.frombuffer(zlib.decompress(held["symbols"]), "<u4"), dtype=np.uint32)
    docs = np.frombuffer(zlib.decompress(held["docs"]), "<i8").reshape(held["n_docs"], 3)
    crcs = np.frombuffer(held["crcs"], "<u4")
    ids = (symbols[ids] if len(symbols) else ids).astype("<u4", copy=False)
    data = ids.tobytes()
    for i in range(len(held["used"]) // 4):
        if zlib.crc32(data[4 * BLOCK * i : 4 * BLOCK * (i + 1)]) != crcs[i]:
            raise ValueError(f"damaged block {i}")
    return ids, docs


class Segments:
    """Gathers documents to segments, `put(ids, docs)` gets each; memory is one segment."""

    def __init__(self, put, most: int = BLOCK * LANES):
        self.put, self.most, self.parts, self.docs, self.held, self.total = put, most, [], [], 0, 0

    def add(self, doc: int, ids: np.ndarray) -> None:
        at = 0
        while True:
            take = min(len(ids) - at, self.most - self.held)
            self.parts.append(ids[at : at + take])
            at, self.held = at + take, self.held + take
            self.docs.append((doc, take, int(at == len(ids))))
            if self.held == self.most:
                self.flush()
            if at == len(ids):
                break
        self.total += len(ids)

    def flush(self) -> None:
        if self.held:
            self.put(np.concatenate(self.parts), self.docs)
        self.parts, self.docs, self.held = [], [], 0


class FileWriter(Segments):
    """A file of the documents added, coded over arrays."""

    def __init__(self, out, most: int = BLOCK * LANES):
        super().__init__(lambda ids, docs: out.write(pack_segment(ids, docs)), most)
        out.write(PREFIX)


class Documents:
    """(doc_id, ids, crc32 of its ids) of every document that ends in a segment; one may begin in an earlier one."""

    def __init__(self):
        self.n = self.crc = 0

    def of(self, ids: np.ndarray, docs: np.ndarray) -> Iterator[tuple[int, int, int]]:
        data, at = memoryview(ids.tobytes()), 0
        for doc, here, ends in docs.tolist():
            self.crc = zlib.crc32(data[4 * at : 4 * (at + here)], self.crc)
            at, self.n = at + here, self.n + here
            if ends:
                yield doc, self.n, self.crc
                self.n = self.crc = 0


def opened(f) -> None:
    if f.read(len(PREFIX)) != PREFIX:
        raise ValueError("not a token file")


def read_file(f) -> Iterator[tuple[int, int, int]]:
    """(doc_id, ids, crc32 of its ids) of every document of a file, a segment at a time."""
    opened(f)
    found = Documents()
    while segment := read_segment(f):
        yield from found.of(*segment)


NULL_ID = -(2**63)
SEGMENT = "total long, n_docs long, largest long, symbols binary, docs binary, crcs binary"
CODED = "total long, n_docs long, largest long, symbols binary, docs binary, used binary, crcs binary, words binary"  # as `raw_segment` gives them
CONSTANTS = {
    **{k: globals()[k] for k in ("BLOCK", "SLOTS0", "SLOTS1", "SLOTS2", "CONFIDENT", "BITS", "COUNTS", "LAW", "GRAINS", "SHIFT0", "SHIFT1", "SHIFT2")},
    "HASH1": f"0x{int(HASH1):X}", "HASH2": f"0x{int(HASH2):X}", "EPOCHS": ", ".join(map(str, EPOCHS)),
}


def write_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", most_pieces: int = tokens.MOST) -> DataFrame:
    """Writes ids in ascending doc_id order, a file for each range of ids, and returns (shard, file, n_ids) lazily.

    Ranges are dealt by Spark, so none holds more than its share; null ids come first. A file counts once the task that
    wrote it has reported its name, so a lost executor leaves nothing that is read. `most_pieces` bounds a worker's cache.
    """
    path = vocabulary or tokens.default_path()
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    order = ("doc_id", "hash", "row")  # the last two let rows that share an id fall into several ranges
    d = d.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    d = d.repartitionByRange(*order).sortWithinPartitions(*order)

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        encode, end = tokens.encoder(path, most_pieces), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for k, texts in tokens.in_slices(batch.column("text")):
                for doc, found in zip(ids[k : k + len(texts)], encode(texts), strict=True):
                    yield doc, np.frombuffer(found + end, "<u4")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = []
        gathered = Segments(lambda ids, docs: ready.append(described(ids, docs)), BLOCK * ROW_LANES)

        def out() -> Iterator[pa.RecordBatch]:
            for held, coded in ready:
                yield pa.RecordBatch.from_pydict({**{k: [x] for k, x in held.items()}, "ids": [coded.astype("<u4", copy=False).tobytes()]})
            ready.clear()

        for doc, ids in ids_of(batches):
            gathered.add(doc, ids)
            if ready:
                yield from out()
        gathered.flush()
        yield from out()

    def write(pieces: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        """pieces: (ids, bytes) of the file, after its prefix."""
        from pyspark import TaskContext

        files, base = storage(folder)
        name, out, total = f"{uuid.uuid4().hex}.ids", None, 0
        for n, data in pieces:
            if out is None:
                files.create_dir(base, recursive=True)
                out = files.open_output_stream(f"{base}/.{name}", compression=None)
                out.write(PREFIX)
            out.write(data)
            total += n
        if out:
            out.close()
            files.move(f"{base}/.{name}", f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "file": [name], "n_ids": [total]})

    def write_coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for k in range(len(batch)):
                    (held,) = batch.slice(k, 1).to_pylist()
                    cut = len(held["crcs"])  # as many blocks
                    yield held["total"], joined(held, held["coded"][:cut], held["coded"][cut:])

        return write(pieces())

    def write_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[int, bytes]]:
            ready = []
            gathered = Segments(lambda ids, docs: ready.append((len(ids), pack_segment(ids, docs))))
            for doc, ids in ids_of(batches):
                gathered.add(doc, ids)
                yield from ready
                ready.clear()
            gathered.flush()
            yield from ready

        return write(pieces())

    kind = "shard long, file string, n_ids long"
    coder = native.coder(docs.sparkSession, CONSTANTS)
    if coder is None:
        return d.mapInArrow(write_all, kind)
    held = d.mapInArrow(segments, SEGMENT + ", ids binary")
    with native.own_workers(docs.sparkSession, "files"):  # these never hold a tokenizer's cache
        return held.withColumn("coded", coder.encode(F.col("ids"), F.col("largest"))).drop("ids").mapInArrow(write_coded, kind)


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; manifest: file, first (ids in all files before it)."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def listed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for some in batched(rows, 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some, strict=True)], names)

    def placed(found: Iterator[tuple[int, int, int]], start: int) -> Iterator[tuple]:
        for doc, n, crc in found:
            yield None if doc == NULL_ID else doc, start, n, crc
            start += n

    def opened_files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        files, base = storage(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with files.open_input_file(f"{base}/{r['file']}") as f:
                    yield r["first"], f

    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return listed(row for first, f in opened_files(batches) for row in placed(read_file(f), first))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, f in opened_files(batches):
            opened(f)
            while held := raw_segment(f):
                yield pa.RecordBatch.from_pydict({"first": pa.array([first], pa.int64()), **{k: [x] for k, x in held.items()}})
                first = None

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            found, start = Documents(), 0
            for batch in batches:
                for k in range(len(batch)):
                    (held,) = batch.slice(k, 1).to_pylist()
                    if held["first"] is not None:
                        found, start = Documents(), held["first"]
                    for row in placed(found.of(*checked(held, np.frombuffer(held["ids"], "<u4"))), start):
                        yield row
                        start = row[1] + row[2]

        return listed(rows())

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long"
    coder = native.coder(manifest.sparkSession, CONSTANTS)
    if coder is None:
        return manifest.mapInArrow(read_all, kind)
    with native.own_workers(manifest.sparkSession, "files"):
        held = manifest.mapInArrow(segments, "first long, " + CODED)
        ids = coder.decode(F.col("total"), F.col("largest"), F.col("used"), F.col("words"))
        return held.withColumn("ids", ids).drop("words").mapInArrow(digests, kind)


def round_trip(docs: DataFrame, scratch: Scratch, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes all documents' ids and reads them back: one row per row of `docs`.

    A null or empty text is its end id alone. Null ids come first; equal ids stand side by side, ordered by their texts' hash. Empty tables
    write no file and give no rows. Other columns are ignored whatever their names.
    """
    folder = scratch.path("ids")
    rows = sorted(write_files(docs, folder, vocabulary, end_id).collect())  # a row per file
    first, out = 0, []
    for _, file, n in rows:
        out.append((first // READ_IDS, file, first))
        first += n
    spark = scratch.spark
    listed = spark.createDataFrame(out, "part long, file string, first long")
    return read_files(listed.repartition(max(1, len({part for part, *_ in out})), "part"), folder)
