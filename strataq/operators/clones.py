"""Duplicate detection on token streams: all maximal clones against first occurrences, and the greedy order-dependent scan."""

from __future__ import annotations

import os
import tempfile
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.scratch import Scratch


def _joined(a: str, b: str, step: int, join=F.xxhash64) -> Column:
    """Hashes of runs that are made of a run of column a and, `step` places on, one of column b."""
    left = F.greatest(F.least(F.size(a), F.size(b) - step), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), left), F.slice(b, F.lit(step + 1), left), lambda x, y: join(x, y))


def with_sliding_least(df: DataFrame, column: str, n: int, out: str) -> DataFrame:
    """Adds the least of every n neighbours of an array, from those of 2, 4, 8, ..."""
    keep, power, have = df.columns, column, 1
    while have * 2 <= n:
        df = df.withColumn(f"_l{have * 2}", _joined(power, power, have, F.least))
        power, have = f"_l{have * 2}", have * 2
    made = _joined(power, power, n - have, F.least) if have < n else F.col(power)
    return df.select(*keep, made.alias(out))


def with_run_hashes(df: DataFrame, hashes: str, n: int, out: str) -> DataFrame:
    """Adds the hash of every run of n tokens, from an array of token hashes: runs of 1, 2, 4, ... are joined to n.

    Each doubling is a column of its own, so none is computed twice.
    """
    keep = df.columns
    power, have, made, width = hashes, 1, None, 0
    while have <= n:
        if n & have:
            if made is None:
                made, width = power, have
            else:
                df, made, width = df.withColumn(f"_w{have}", _joined(made, power, width)), f"_w{have}", width + have
        if have * 2 <= n:
            df = df.withColumn(f"_p{have}", _joined(power, power, have))
            power = f"_p{have}"
        have *= 2
    return df.select(*keep, F.col(made).alias(out))


def window_clones(docs: DataFrame, window: int, id_col: str = "path", scratch: Scratch | None = None) -> DataFrame:
    """Maximal runs of at least `window` equal tokens between a text and the first text (by id, then position) that has
    them: (path, start, original, original_start, tokens), token positions from 0.

    docs: id_col, hashes (array of token hashes). A window's anchor is the least hash of its runs of half its length, so equal
    windows have equal anchors and neighbours mostly share one: what is counted over the corpus is a row for each stretch
    of windows with one anchor, a thirteenth of all for 50 tokens, and only windows whose anchor recurs go on. They are
    counted by hash and joined to the smallest occurrence only, so a very common window costs one row per occurrence, not
    one per pair. Neighbouring windows with the same offset to
    their original are one run. Overlapping matches inside one text don't count.
    """
    d = with_run_hashes(docs.select(F.col(id_col).alias("path"), "hashes"), "hashes", window, "windows")
    scratch, half = scratch or Scratch(docs.sparkSession), max(1, window // 2)
    span = window - half + 1
    d = with_sliding_least(with_run_hashes(d, "hashes", half, "grams"), "grams", span, "anchors")
    d = scratch.save(d.select("path", "windows", "anchors"), "windows")
    # outer, as the filter that a plain explode infers would be pushed down with all that makes its array
    fresh = F.zip_with("anchors", F.slice(F.concat(F.array(F.lit(None).cast("long")), "anchors"), F.lit(1), F.size("anchors")), lambda a, b: F.when(~a.eqNullSafe(b), a))
    # one place of a run anchors at most `span` windows, so windows so far apart with one anchor have it at two places
    left = F.greatest(F.size("anchors") - span, F.lit(0))
    again = F.zip_with(F.slice("anchors", F.lit(1), left), F.slice("anchors", F.lit(span + 1), left), lambda a, b: F.when(a == b, a))
    stretch = d.select(F.explode_outer(F.filter(F.concat(fresh, F.array_distinct(again)), lambda a: a.isNotNull())).alias("anchor")).where("anchor is not null")
    often = scratch.save(stretch.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    w = d.select("path", F.posexplode_outer(F.arrays_zip(F.col("windows").alias("h"), F.col("anchors").alias("anchor"))).alias("pos", "w")).select("path", "pos", "w.*")
    w = scratch.save(w.where("h is not null").join(often, "anchor", "left_semi").drop("anchor"), "recurring")
    first = w.groupBy("h").agg(F.min(F.struct("path", "pos")).alias("o"), F.count("*").alias("n")).where("n > 1").select("h", F.col("o.path").alias("original"), F.col("o.pos").alias("at"))
    m = w.join(first, "h").where((F.col("path") != F.col("original")) | (F.col("at") + window <= F.col("pos")))
    same = W.partitionBy("path", "original", F.col("pos") - F.col("at")).orderBy("pos")
    m = m.withColumn("island", F.col("pos") - F.row_number().over(same))
    return m.groupBy("path", "original", (F.col("pos") - F.col("at")).alias("offset"), "island").agg(
        F.min("pos").alias("start"), F.min("at").alias("original_start"), (F.max("pos") - F.min("pos") + window).alias("tokens")
    ).drop("offset", "island")


def trimmed_to_lines(clones: DataFrame, rows: DataFrame, least_tokens: int, least_lines: int) -> DataFrame:
    """Clones cut to whole lines: a first or last line shared with other code is dropped. rows: path, rows (line number of
    each token, from 0). Adds first_line and last_line (from 1)."""
    d = clones.join(rows, "path")
    last = F.col("start") + F.col("tokens") - 1
    line = lambda at: F.get("rows", at.cast("int"))
    inside = F.sequence(F.col("start"), last)
    begins = F.filter(inside, lambda k: F.coalesce(F.get("rows", (k - 1).cast("int")) != F.get("rows", k.cast("int")), F.lit(True)))
    ends = F.filter(inside, lambda k: F.coalesce(F.get("rows", (k + 1).cast("int")) != F.get("rows", k.cast("int")), F.lit(True)))
    d = d.withColumn("s", F.array_min(begins)).withColumn("e", F.array_max(ends)).where("s is not null and e is not null and e >= s")
    d = d.withColumn("kept", F.col("e") - F.col("s") + 1).withColumn("first_line", line(F.col("s")) + 1).withColumn("last_line", line(F.col("e")) + 1)
    return d.where((F.col("kept") >= least_tokens) & (F.col("last_line") - F.col("first_line") + 1 >= least_lines)).drop("rows", "s", "e")


def duplicated_lines(clones: DataFrame) -> DataFrame:
    """(path, lines): distinct lines of each file inside clones, on either side."""
    return clones.select("path", F.explode(F.sequence("first_line", "last_line")).alias("line")).distinct().groupBy("path").agg(F.count("*").alias("lines"))


def greedy_scan(files: list[tuple[str, list[int], list[int]]], window: int = 50, least_lines: int = 6, most_kept: int = 8) -> list[tuple]:
    """Clones of files (path, token hashes, token rows) in order: (path, first line, last line, original, its first line, its
    last line, tokens). A clone is skipped past; the first earlier occurrence that holds wins; windows without a match are
    remembered, a few of each. All files are held in memory; greedy_clones gives the same for any number of them."""
    known: dict[tuple, list[tuple[int, int]]] = {}
    out = []
    for f, (path, tokens, rows) in enumerate(files):
        at = 0
        while at + window <= len(tokens):
            key = tuple(tokens[at : at + window])
            clone = None
            for g, start in known.get(key, ()):
                other_path, other, other_rows = files[g]
                if g == f and start + window > at:
                    continue
                most = min(len(tokens) - at, at - start if g == f else len(other) - start)
                length = window
                while length < most and other[start + length] == tokens[at + length]:
                    length += 1
                lo, hi = at, at + length - 1
                while lo <= hi and lo and rows[lo - 1] == rows[lo]:
                    lo += 1
                while hi > lo and hi + 1 < len(rows) and rows[hi + 1] == rows[hi]:
                    hi -= 1
                if hi - lo + 1 >= window and rows[hi] - rows[lo] + 1 >= least_lines:
                    shift = start - at
                    clone = (path, rows[lo] + 1, rows[hi] + 1, other_path, other_rows[lo + shift] + 1, other_rows[hi + shift] + 1, hi - lo + 1)
                    break
            if clone:
                out.append(clone)
                at += length
                continue
            places = known.setdefault(key, [])
            if len(places) < most_kept:
                places.append((f, at))
            at += 1
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _mixed(x * np.uint64(0x9E3779B97F4A7C15) + y)


def _runs(x: np.ndarray, n: int, join) -> np.ndarray:
    """What `join` makes of every n neighbours, by runs of 1, 2, 4, ... as in with_run_hashes."""
    power, have, made, width = x, 1, None, 0
    while have <= n:
        if n & have:
            if made is None:
                made, width = power, have
            else:
                size = max(0, len(x) - width - have + 1)
                made, width = join(made[:size], power[width : width + size]), width + have
        if have * 2 <= n:
            power = join(power[: max(0, len(power) - have)], power[have:])
        have *= 2
    return made[: max(0, len(x) - n + 1)]


#: Tokens of texts that are worked on at once (a longer text is by itself), texts sent at once, and the most bits of the filter of anchors.
SLICE, TEXTS, FILTER_BITS = 1 << 19, 1000, 1 << 27


@contextmanager
def _small_batches(spark: SparkSession):
    """Rows are token lists here, so the usual 10,000 to an Arrow batch would be some 100 MB a task in the JVM and again here."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, str(min(TEXTS, int(usual)) if int(usual) > 0 else TEXTS))
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def _anchored(batch: pa.RecordBatch, window: int) -> Iterator[tuple]:
    """Slices of a batch: (first text, tokens of each text; of each window its text, its position there, its hash and its
    anchor; the first window of each piece). An anchor, as in window_clones, is mixed with the repository, whose texts alone
    count. A piece is a stretch of windows with one anchor; one place anchors at most `span` windows, so a longer one is cut."""
    half = max(1, window // 2)
    span = window - half + 1
    lists = batch["hashes"]
    sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    ends = np.cumsum(sizes)
    flat = np.asarray(lists.flatten()).view(np.uint64)
    seeds = np.array([0 if r is None else int.from_bytes(blake2b(r.encode(), digest_size=8).digest()) for r in batch["repository"].to_pylist()], np.uint64)
    lo = 0
    while lo < len(sizes):
        begin = ends[lo] - sizes[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, begin + SLICE, "right")))
        n = sizes[lo:hi]
        tokens = _mixed(flat[begin : ends[hi - 1]])
        text = np.repeat(np.arange(hi - lo), n)
        pos = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
        at = np.flatnonzero(pos <= n[text] - window)
        hashes = _runs(tokens, window, _pair)[at]
        anchors = _runs(_runs(tokens, half, _pair), span, np.minimum)[at]
        text, pos = text[at], pos[at]
        anchors = _mixed(anchors ^ seeds[lo:hi][text])
        if len(at):
            begins = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (anchors[1:] != anchors[:-1])])
            cuts = -(-np.diff(np.r_[begins, len(at)]) // span)
            nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            yield lo, n, text, pos, hashes, anchors, np.repeat(begins, cuts) + nth * span
        lo = hi


def _contents(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A hash of each piece's windows in their order."""
    sizes = np.diff(np.r_[begins, len(hashes)])
    nth = (np.arange(len(hashes)) - np.repeat(begins, sizes) + 1).astype(np.uint64)
    return _pair(np.add.reduceat(_pair(nth, hashes), begins), sizes.astype(np.uint64))


def _anchor_bits(tokens: DataFrame, window: int, scratch: Scratch):
    """Broadcast bits per value of an anchor's last bits: whether such an anchor may be at two places of its repository, and
    whether its pieces may then differ or hold a window twice."""
    span = window - max(1, window // 2) + 1
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max

    def count(batches):
        for batch in batches:
            for _, _, text, _, hashes, anchors, begins in _anchored(batch, window):
                low = _contents(hashes, begins).view(np.int64)
                high = low.copy()
                for d in range(1, span):
                    twice = np.flatnonzero(hashes[d:] == hashes[:-d])
                    twice = np.searchsorted(begins, twice[(text[twice + d] == text[twice])], "right") - 1
                    low[twice], high[twice] = least, most
                order = np.argsort(anchors[begins], kind="stable")
                each = anchors[begins][order]
                firsts = np.flatnonzero(np.r_[True, each[1:] != each[:-1]])
                columns = each[firsts].view(np.int64), np.diff(np.r_[firsts, len(each)]), np.minimum.reduceat(low[order], firsts), np.maximum.reduceat(high[order], firsts)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["anchor", "n", "low", "high"])

    counted = tokens.select("repository", "hashes").mapInArrow(count, "anchor long, n long, low long, high long").groupBy("anchor")
    counted = counted.agg(F.sum("n").alias("n"), (F.min("low") < F.max("high")).alias("differ"))
    with _small_batches(tokens.sparkSession):
        often = scratch.save(counted.where("n > 1").select("anchor", "differ"), "anchors")
    bits = min(FILTER_BITS, max(1 << 16, 1 << (32 * often.count()).bit_length()))
    page = min(bits, 1 << 20)

    def pack(table: pa.Table) -> pa.Table:
        slots = np.zeros((2, page), bool)
        slot, differ = (np.asarray(table[c]) for c in ("slot", "differ"))
        slots[0, slot % page] = True
        slots[1, slot[differ] % page] = True
        return pa.table({"page": table["page"][:1].cast(pa.int64()), **{c: pa.array([np.packbits(x).tobytes()], pa.binary()) for c, x in zip(("recurs", "differs"), slots, strict=True)}})

    slot = F.col("anchor").bitwiseAND(F.lit(bits - 1).cast("long"))
    pages = often.select(slot.alias("slot"), "differ").withColumn("page", F.floor(F.col("slot") / page).cast("long"))
    made = {c: np.zeros(bits // 8, np.uint8) for c in ("recurs", "differs")}
    for r in pages.groupBy("page").applyInArrow(pack, "page long, recurs binary, differs binary").toLocalIterator():
        for c, x in made.items():
            x[r["page"] * page // 8 : (r["page"] + 1) * page // 8] = np.frombuffer(r[c], np.uint8)
    return tokens.sparkSession.sparkContext.broadcast(tuple(x.tobytes() for x in made.values())), bits


SHARED = "repository string, path string, content long, n long, starts array<int>, lines array<int>, pos array<int>, windows array<int>, units array<long>, anchors array<long>"


def _sharing(tokens: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """Texts with windows whose anchor may recur, with the tokens that begin a line, its number, and units of such windows:
    whole pieces where all pieces of the anchor are alike, else single windows."""
    kept, bits = _anchor_bits(tokens, window, scratch)

    def select(batches):
        for batch in batches:
            recurs, differs = (np.frombuffer(x, np.uint8) for x in kept.value)
            lists = batch["rows"]
            ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64))
            rows = np.asarray(lists.flatten())
            for lo, n, text, pos, hashes, anchors, begins in _anchored(batch, window):
                slot = (anchors[begins] & np.uint64(bits - 1)).astype(np.int64)
                on, fine = ((x[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool) for x in (recurs, differs))
                if not on.any():
                    continue
                sizes = np.diff(np.r_[begins, len(pos)])
                single = np.flatnonzero(np.repeat(on & fine, sizes))
                whole = on & ~fine
                at = np.r_[begins[whole], single]
                order = np.argsort(at)
                units = np.r_[_contents(hashes, begins)[whole], hashes[single]][order]
                windows = np.r_[sizes[whole], np.ones(len(single), np.int64)][order]
                at = at[order]
                some, counts = np.unique(text[at], return_counts=True)
                firsts, lines = [], []
                for t in (lo + some).tolist():
                    r = rows[ends[t - 1] if t else 0 : ends[t]]
                    firsts.append(np.flatnonzero(np.r_[True, r[1:] != r[:-1]]).astype(np.int32))
                    lines.append(r[firsts[-1]].astype(np.int32))
                texts = pa.array(lo + some)
                offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                line_offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in lines])].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch[c].take(texts) for c in ("repository", "path", "content")]
                    + [pa.array(n[some]), *(pa.ListArray.from_arrays(line_offsets, np.concatenate(x)) for x in (firsts, lines))]
                    + [pa.ListArray.from_arrays(offsets, x) for x in (pos[at].astype(np.int32), windows.astype(np.int32), units.view(np.int64), anchors[at].view(np.int64))],
                    names=[x.split()[0] for x in SHARED.split(", ")],
                )

    found = tokens.select("repository", "path", F.xxhash64("hashes", "rows").alias("content"), "hashes", "rows").mapInArrow(select, SHARED)
    with _small_batches(tokens.sparkSession):
        return scratch.save(found.withColumn("file", F.monotonically_increasing_id()), "sharing")


class _Numbers:
    """Arrays of whole numbers in a sparse file of the machine, 0 where nothing was written; its end deletes it."""

    def __init__(self, width: int = 1):
        places = [x for x in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(x)]
        self.file, self.width = tempfile.TemporaryFile(dir=places[0] if places else None, buffering=0), width

    def read(self, at: int, n: int) -> np.ndarray:
        got = os.pread(self.file.fileno(), n * self.width * 8, at * self.width * 8)
        out = np.zeros(n * self.width, np.int64)
        out[: len(got) // 8] = np.frombuffer(got, np.int64, len(got) // 8)
        return out.reshape(n, self.width)

    def write(self, at: int, x: np.ndarray) -> None:
        view, at = memoryview(np.ascontiguousarray(x, np.int64)).cast("B"), at * self.width * 8
        while view:
            done = os.pwrite(self.file.fileno(), view, at)
            view, at = view[done:], at + done

    def gather(self, keys: np.ndarray, gap: int) -> np.ndarray:
        """The rows of ascending keys; neighbours up to `gap` apart are read at once."""
        out = np.zeros((len(keys), self.width), np.int64)
        cuts = np.r_[0, np.flatnonzero(np.diff(keys) > gap) + 1, len(keys)].tolist()
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                out[lo:hi] = self.read(int(keys[lo]), int(keys[hi - 1] - keys[lo]) + 1)[keys[lo:hi] - keys[lo]]
        return out

    def scatter(self, keys: np.ndarray, rows: np.ndarray) -> None:
        cuts = np.r_[0, np.flatnonzero(np.diff(keys) > 1) + 1, len(keys)].tolist()
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                self.write(int(keys[lo]), rows[lo:hi])


class _Scan:
    """The greedy scan of one repository, file by file, over windows that recur there. A window has a place (a number that
    ascends over files and positions) and a key (its first place). Keys by place and remembered places by key are on disk;
    memory holds one file and 16 bytes of each earlier one."""

    def __init__(self, window: int, least_lines: int, most_kept: int):
        self.window, self.least_lines, self.most_kept = window, least_lines, most_kept
        self.keys, self.first, self.more = _Numbers(), _Numbers(), _Numbers(max(1, most_kept - 1))
        self.bases, self.files = array("q"), array("q")

    def file(self, number: int, base: int, n: int, starts: list[int], lines: list[int], places: np.ndarray, keys: np.ndarray) -> Iterator[tuple]:
        """Its clones: (first line, last line, original's number, its first token, its last token, tokens)."""
        self.bases.append(base)
        self.files.append(number)
        if not len(places):
            return
        window, origin = self.window, int(places[0])
        own = np.zeros(int(places[-1]) - origin + 1, np.int64)
        own[places - origin] = keys + 1
        self.keys.write(origin, own)
        ends = np.r_[np.flatnonzero(np.diff(places) != 1) + 1, len(places)]
        further = (np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(len(places)) - 1).tolist()
        each, which = np.unique(keys, return_inverse=True)
        first = self.first.gather(each, 512)[:, 0]
        more = np.zeros((len(each), self.more.width), np.int64)
        old = np.flatnonzero(first)
        more[old] = self.more.gather(each[old], 64)
        count = ((first > 0) + (more > 0).sum(1)).tolist()
        changed: set[int] = set()
        at, which, i = places.tolist(), which.tolist(), 0
        while i < len(at):
            k, here = which[i], at[i]
            length = 0
            if count[k] and self.trimmed(here - base, window + further[i], n, starts, lines):
                for other in (first[k], *more[k, : count[k] - 1]):
                    other = int(other) - 1
                    if other >= base and other + window > here:
                        continue
                    most = min(further[i], here - other - window) if other >= base else further[i]
                    length = window + self.same(other, own if other >= base else None, origin, keys, i, most)
                    if found := self.trimmed(here - base, length, n, starts, lines):
                        break
                    length = 0
            if length:
                lo, hi, first_line, last_line = found
                g = bisect_right(self.bases, other) - 1
                shift = other - self.bases[g] - (here - base)
                yield first_line + 1, last_line + 1, self.files[g], lo + shift, hi + shift, hi - lo + 1
                i = bisect_left(at, here + length, i + 1)
                continue
            if count[k] < self.most_kept:
                if count[k]:
                    more[k, count[k] - 1] = here + 1
                else:
                    first[k] = here + 1
                count[k] += 1
                changed.add(k)
            i += 1
        new = np.array(sorted(changed), np.int64)
        self.first.scatter(each[new], first[new])
        new = new[more[new, 0] > 0]
        self.more.scatter(each[new], more[new])

    def same(self, other: int, own: np.ndarray | None, origin: int, keys: np.ndarray, i: int, most: int) -> int:
        """How many of the `most` windows after window i are those after the place `other`."""
        have, step = 0, 64
        while have < most:
            size = min(step, most - have)
            begin = other + 1 + have
            theirs = self.keys.read(begin, size)[:, 0] if own is None else own[begin - origin : begin - origin + size]
            unlike = np.flatnonzero(theirs != keys[i + 1 + have : i + 1 + have + size] + 1)
            if len(unlike):
                return have + int(unlike[0])
            have, step = have + size, step * 4
        return have

    def trimmed(self, at: int, length: int, n: int, starts: list[int], lines: list[int]) -> tuple | None:
        """(first token, last, their lines) of a match cut to whole lines, if it is long enough. A longer match never is
        where a shorter one at the same token isn't the worse."""
        lo, hi = at, at + length - 1
        j = bisect_left(starts, at)
        lo = min(starts[j] if j < len(starts) else n, hi + 1)
        if hi > lo and hi + 1 < n:
            hi = max(lo, starts[bisect_right(starts, hi + 1) - 1] - 1)
        if hi - lo + 1 < self.window:
            return None
        a, b = (lines[bisect_right(starts, x) - 1] for x in (lo, hi))
        return (lo, hi, a, b) if b - a + 1 >= self.least_lines else None


CLONES = "repository string, path string, first_line int, last_line int, original string, original_first int, original_last int, tokens int"


def greedy_clones(tokens: DataFrame, window: int = 50, least_lines: int = 6, most_kept: int = 8, scratch: Scratch | None = None) -> DataFrame:
    """The greedy scan (greedy_scan) of each repository's files in path order; files with the same path stand apart. tokens:
    repository, path, hashes, rows (ascending).

    Only windows that recur in their repository can match or be matched, so these are found first, over all files at once:
    by a filter of recurring anchors, then exactly by hash and anchor, a piece at a time where all of its copies are alike.
    The scan itself is sequential by definition, so a repository is one task, which reads them in order as a stream and
    keeps what it remembers on disk.
    """
    scratch = scratch or Scratch(tokens.sparkSession)
    d = _sharing(tokens, window, scratch)
    totals = d.groupBy("repository").agg(F.sum(F.col("n") + 1).alias("all"))
    origin = totals.select(F.col("repository").alias("_r"), (F.sum("all").over(W.orderBy("repository")) - F.col("all")).alias("origin"))
    before = F.sum(F.col("n") + 1).over(W.partitionBy("repository").orderBy("path", "content", "file").rowsBetween(W.unboundedPreceding, -1))
    bases = d.select("file", "repository", F.coalesce(before, F.lit(0)).alias("before")).join(F.broadcast(origin), F.col("repository").eqNullSafe(F.col("_r")))
    bases = scratch.save(bases.select("file", "origin", (F.col("origin") + F.col("before")).alias("base")), "bases")
    w = d.select("file", "pos", "windows", "units", "anchors").join(bases, "file").select("origin", "base", F.inline(F.arrays_zip("pos", "windows", "units", "anchors")))
    equal = W.partitionBy("anchors", "units", "windows")
    w = w.select("origin", "anchors", "units", "windows", (F.col("base") + F.col("pos")).alias("at"))
    w = w.select("origin", "at", "windows", F.min("at").over(equal).alias("key"), F.count("*").over(equal).alias("c")).where("c > 1").drop("c")
    files = d.join(bases, "file").select("origin", F.col("base").alias("at"), F.lit(None).cast("long").alias("key"), "repository", "file", "n", "path", "starts", "lines")
    stream = files.unionByName(w, allowMissingColumns=True)

    def run(batches):
        scan, repository, current, parts = None, None, None, []
        names = ["repository", "path", "first_line", "last_line", "file", "lo", "hi", "tokens"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

        def done():
            path, *file = current
            places, keys, windows = (np.concatenate(x) for x in zip(*parts, strict=True))
            nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            places, keys = (np.repeat(x, windows) + nth for x in (places, keys))
            rows = [(repository, path, *c) for c in scan.file(*file, places, keys)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names) if rows else None

        for batch in batches:
            places, keys, windows = np.asarray(batch["at"]), np.asarray(batch["key"].fill_null(-1)), np.asarray(batch["windows"].fill_null(0), np.int64)
            begins = np.flatnonzero(keys < 0).tolist()
            for lo, hi in zip([0, *begins], [*begins, len(keys)], strict=True):
                if lo < hi and keys[lo] < 0:
                    if current and (out := done()):
                        yield out
                    r = {c: batch[c][lo].as_py() for c in ("repository", "path", "file", "at", "n", "starts", "lines")}
                    if scan is None or r["repository"] != repository:
                        scan, repository = _Scan(window, least_lines, most_kept), r["repository"]
                    current, parts, lo = (r["path"], r["file"], r["at"], r["n"], r["starts"], r["lines"]), [(places[:0], keys[:0], windows[:0])], lo + 1
                if lo < hi:
                    parts.append((places[lo:hi].copy(), keys[lo:hi].copy(), windows[lo:hi]))
        if current and (out := done()):
            yield out

    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stream.repartition(parts, "origin").sortWithinPartitions("at", F.col("key").asc_nulls_first())
    found = scratch.save(found.mapInArrow(run, "repository string, path string, first_line int, last_line int, file long, lo int, hi int, tokens int"), "greedy")
    other = d.select("file", F.col("path").alias("original"), "starts", "lines")
    line = lambda at: F.element_at("lines", F.size(F.filter("starts", lambda s: s <= F.col(at)))) + 1
    return found.join(other, "file").select("repository", "path", "first_line", "last_line", "original", line("lo").alias("original_first"), line("hi").alias("original_last"), "tokens")
