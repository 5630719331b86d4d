"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

One weight vector serves all grades: P(grade <= j) = sigmoid(t_j - w.x) with thresholds t_0 < t_1 < ... Features are
hashed: which words and word beginnings a text has (letters and digits, lower case), and at what rate its words begin
with which letters, end in which two bytes or repeat the word before. The tail probability P(grade >= wanted) selects
documents; the expected grade ranks them.

A worker hashes a word once: weights of words and beginnings are kept by the word, so scoring is look-ups and sums.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, sliced

PRESENT, RATES = 1 << 18, 1 << 16
PREFIXES = (4, 6)
RATE_SCALE = 30.0
#: A text longer than FIT_SLICES * FIT_CHARS characters is learned from so many slices of it.
FIT_SLICES, FIT_CHARS = 8, 8000
TOKEN = re.compile(r"[^\W_]+")
SAME = b"="


@dataclass
class Model:
    weights: np.ndarray  # float32: PRESENT weights of words, then RATES weights of endings
    thresholds: np.ndarray  # ascending, one fewer than grades

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each j, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


class Hashed(dict):
    """What stands for each string, worked out once; forgotten when there are too many."""

    def __init__(self, make, most: int = 50_000):
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        found = self[key] = self.make(key)
        return found


def _present(start: int):
    return lambda word: crc32(word.encode("utf-8", "replace"), start) % PRESENT


class Reader:
    """The features of a text, as what `number` makes of their buckets."""

    def __init__(self, number=lambda bucket: bucket):
        self.words, *self.prefixes = (Hashed(lambda w, b=_present(n): number(b(w))) for n in (0, *PREFIXES))
        self.ends = Hashed(lambda e: number(PRESENT + crc32(e) % RATES))
        self.starts = Hashed(lambda w: number(PRESENT + crc32(w.encode("utf-8", "replace"), 1) % RATES))

    def __call__(self, text: str) -> tuple[list, list[tuple]]:
        """(of each distinct word and beginning, (of each ending and beginning, how often))."""
        found, words = TOKEN.findall(text.lower()), text.encode("utf-8", "replace").split()
        distinct = set(found)
        ends = Counter([SAME if a == b else a[-2:] for a, b in zip(words, [b"", *words], strict=False)])
        starts = Counter([w[: PREFIXES[0]] for w in found])
        seen = list(map(self.words.__getitem__, distinct))
        for n, cache in zip(PREFIXES, self.prefixes, strict=True):
            seen += map(cache.__getitem__, {w[:n] for w in distinct})
        return seen, [(self.ends[e], n) for e, n in ends.items()] + [(self.starts[w], n) for w, n in starts.items()]


class Scorer:
    def __init__(self, model: Model):
        self.read = Reader(model.weights.astype(float).__getitem__)

    def __call__(self, text: str | None) -> float:
        """w.x, the same on every run: sums are exactly rounded, so the order of a set does not matter."""
        seen, rated = self.read(text or "")
        return math.fsum(seen) + math.fsum(w * n for w, n in rated) / max(1, sum(n for _, n in rated))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of an Arrow list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]] if len(at) else np.zeros(0, np.int32), np.diff(at)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = Reader()
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            some = batch.slice(k, 64)
            found = [read(t or "") for t in some.column("text").to_pylist()]
            lists = [[sorted(s) for s, _ in found], [sorted(r) for _, r in found]]
            cols = [some.column("rated_id"), some.column("grade"), pa.array(lists[0], pa.list_(pa.int32()))]
            cols += [pa.array([[x[i] for x in r] for r in lists[1]], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, ["rated_id", "grade", "seen", "rated", "often"])


def fit(docs: DataFrame, ratings: DataFrame, grades: int, fit_rows: int = 8000, least: float = 5.0, rounds: int = 300, rate: float = 0.1, decay: float = 2e-4, against: bool = True, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fits on a bounded sample: the `fit_rows` rated ids with the smallest hash, and of each text at most FIT_SLICES *
    FIT_CHARS characters. An id with several ratings counts with its lowest, one with several texts with the smallest.

    Words whose counts on the two sides of every threshold are within `least` standard errors of chance get no weight.
    With `against`, words and beginnings can only count against a text: else length alone, which brings ever more of
    them, would raise grades. Null grades or ids are passed over; None if no rated document is found.
    """
    ids = ratings.select(F.col("doc_id").alias("rated_id"), F.col("grade").alias("grade")).where("rated_id is not null and grade is not null")
    ids = ids.groupBy("rated_id").agg(F.min("grade").cast("int").alias("grade")).orderBy(F.xxhash64("rated_id"), "rated_id").limit(fit_rows)
    base = docs.select(F.col(id_col).alias("rated_id"), sliced(F.col(text_col), FIT_SLICES, FIT_CHARS).alias("text")).join(F.broadcast(ids), "rated_id")
    base = base.groupBy("rated_id", "grade").agg(F.min("text").alias("text"))
    kind = base.schema["rated_id"].dataType.simpleString()
    found = base.mapInArrow(_buckets, f"rated_id {kind}, grade int, seen array<int>, rated array<int>, often array<int>")
    sample = found.orderBy("rated_id").select("grade", "seen", "rated", "often").toArrow()
    y = sample.column("grade").to_numpy()
    if not len(y):
        return None
    (a, n), (b, m), (times, _) = (_lists(sample.column(c)) for c in ("seen", "rated", "often"))
    count, often = np.bincount(a, minlength=PRESENT), np.zeros(PRESENT, bool)
    for j in range(grades - 1):
        share = (y > j).mean()
        above = np.bincount(a, np.repeat(y > j, n), PRESENT)
        beyond = least * np.sqrt(count * share * (1 - share) + 1e-9)
        often |= (count * share - above > beyond) | (not against) & (above - count * share > beyond)
    keep = often[a]
    rows, columns, values = [np.repeat(np.arange(len(y), dtype=np.int32), n)[keep]], [a[keep]], [np.ones(int(keep.sum()), np.float32)]
    row = np.repeat(np.arange(len(y), dtype=np.int32), m)
    rows.append(row)
    columns.append(b)
    values.append((times * (RATE_SCALE / np.maximum(np.bincount(row, times, len(y)), 1))[row]).astype(np.float32))
    del a, b, sample
    rows, columns, values = (np.concatenate(x) for x in (rows, columns, values))
    used, columns = np.unique(columns, return_inverse=True)
    n_words = int((used < PRESENT).sum())
    w, steps = np.zeros(len(used)), np.log(np.linspace(1, 2, grades - 1)) if grades > 2 else np.zeros(grades - 1)
    p = np.concatenate([w, [steps[0]], np.full(grades - 2, np.log(1.0))])  # first threshold, then logs of the gaps
    first, second = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        w, t = p[: len(used)], np.cumsum(np.concatenate([p[len(used) : len(used) + 1], np.exp(p[len(used) + 1 :])]))
        s = np.bincount(rows, w[columns] * values, len(y))
        cdf = 1 / (1 + np.exp(np.clip(s[:, None] - t[None, :], -40, 40)))
        full = np.concatenate([np.zeros((len(y), 1)), cdf, np.ones((len(y), 1))], axis=1)
        hi, lo = full[np.arange(len(y)), y + 1], full[np.arange(len(y)), y]
        mass = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / mass, lo * (1 - lo) / mass  # of log-likelihood by its two thresholds
        d_t = np.array([d_hi[y == j].sum() - d_lo[y == j + 1].sum() for j in range(grades - 1)]) / len(y)
        d_s = (d_lo - d_hi) / len(y)
        g_w = np.bincount(columns, d_s[rows] * values, len(used)) - decay * w / len(used) ** 0.5
        g_first, g_gaps = d_t.sum(), np.array([d_t[j:].sum() for j in range(1, grades - 1)]) * np.exp(p[len(used) + 1 :])
        g = np.concatenate([g_w, [g_first], g_gaps])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        p += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        if against:
            p[:n_words] = np.minimum(p[:n_words], 0)
    weights = np.zeros(PRESENT + RATES, np.float32)
    weights[used] = p[: len(used)]
    weights[PRESENT:] *= RATE_SCALE
    return Model(weights, np.cumsum(np.concatenate([p[len(used) : len(used) + 1], np.exp(p[len(used) + 1 :])])))


def classify(docs: DataFrame, model: Model | None, wanted: int, text_col: str = "text", names: tuple[str, str] = ("expected_grade", "tail_probability")) -> DataFrame:
    """`docs` with two more columns (`names`, replacing columns of those names): expected grade and P(grade >= wanted).

    A null text or one without words has grade 0 for certain. Without a model, every other text has tail 0.5. Rows keep
    their place, repeated ones included: no shuffle. Whole texts are read. An empty table gives no rows; other columns
    stay as they are, whatever their names.
    """
    keep = [c for c in docs.columns if c not in names]

    @F.arrow_udf("struct<e: double, p: double>")
    def grade(texts: pa.Array) -> pa.Array:
        score = kept(("quality", crc32(model.weights)), lambda: Scorer(model)) if model else (lambda text: 0.0)
        found, blank = np.zeros(len(texts)), np.zeros(len(texts), bool)
        for k in range(0, len(texts), 64):
            for i, t in enumerate(texts.slice(k, 64).to_pylist(), k):
                blank[i] = not t or not t.encode("utf-8", "replace").split()
                found[i] = 0 if blank[i] else score(t)
        if model is None:
            e, p = np.full(len(texts), float(wanted) / 2), np.full(len(texts), 0.5)
        else:
            tails = model.tails(found)
            e, p = tails.sum(axis=1), tails[:, wanted - 1]
        return pa.StructArray.from_arrays([pa.array(np.where(blank, 0.0, x).round(6)) for x in (e, p)], ["e", "p"])

    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), grade(F.col(f"`{text_col}`")).alias("g"))
    return d.select("row.*", F.col("g.e").alias(names[0]), F.col("g.p").alias(names[1]))


def ratings(labels: DataFrame) -> DataFrame:
    """Graded ratings of the labels table: 0 poor, 1 fluent but toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))
