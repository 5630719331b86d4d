"""Exact top-k inner-product search by Fagin's threshold algorithm.

Candidates stand in blocks; a block has one sorted list per dimension, sorted once when the block is packed. A query
reads its lists from the end its signs ask for (sorted access), scores every vector met (random access), and stops once
its kth best score beats the threshold: the best score that a vector not yet met could have, given where the lists stand.
Lists are not read in step: each read goes where it lowers the threshold most, so lists that weigh little in the query
are left almost unread. It starts with a stretch that meets a few times k vectors and reads GROWTH times as much in each round,
but never beyond the depths that its present kth score calls for. Where these lie so deep that the reads left cost more
than scoring what is left, as in many dimensions of equal weight, the rest is scored outright.

Vectors and queries meet block by block: each pair of a candidate block and a query block is one row of work, so memory
is two blocks whatever the table's size, and a pair's results are k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

CANDIDATES, QUERIES = 16384, 1024
#: Depths at which the lists are compared, the first stretch as a multiple of k, what a round reads more than the one before,
#: and how many reads for each vector left cost more than scoring it outright.
GRID, FIRST, GROWTH, DEAR = 64, 4, 8, 4
BLOCK = "block string, dims int, ids binary, data binary, lists binary"


def integer_vector(v: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, x as double; null if the vector is null or holds a null, NaN or infinity."""
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~bad, whole)


def _pack(kind: str, most: int):
    """Rows (id, vector) of a partition to blocks of at most `most` rows; candidates come with their sorted lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        ids: list[np.ndarray] = []
        vectors: list = []

        def block():
            nonlocal ids, vectors
            dims = max(map(len, vectors))
            data = np.zeros((len(vectors), dims), np.int64)  # shorter vectors count as padded with zeros
            for row, v in zip(data, vectors, strict=True):
                row[: len(v)] = v
            lists = sorted_lists(data).tobytes() if kind == "c" else b""
            out = [f"{kind}-{uuid.uuid4().hex}", dims, np.array(ids, np.int64).tobytes(), data.tobytes(), lists]
            ids, vectors = [], []
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, kinds, strict=True)], ["block", "dims", "ids", "data", "lists"])

        for batch in batches:
            flat, at = batch.column(1).values.to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
            for i, one in enumerate(batch.column(0).to_pylist()):
                ids.append(one)
                vectors.append(flat[at[i] : at[i + 1]])
                if len(ids) >= most:
                    yield block()
        if ids:
            yield block()

    return run


def sorted_lists(data: np.ndarray) -> np.ndarray:
    """A row for each dimension: the vectors' numbers, largest component first."""
    return np.ascontiguousarray(np.argsort(-data, axis=0, kind="stable").T.astype(np.int32))


def _worth(depth: np.ndarray, left: np.ndarray) -> np.ndarray:
    """By what each read of a step lowers a list's best component left, on average up to the best depth ahead. Falling in each list."""
    ahead = np.zeros((len(depth) - 1, left.shape[1]))
    for g in range(len(depth) - 1):
        ahead[g] = ((left[g] - left[g + 1 :]) / (depth[g + 1 :] - depth[g])[:, None]).max(0, initial=0)
    return np.minimum.accumulate(ahead, axis=0)


def _depths(worth: np.ndarray, enough) -> np.ndarray:
    """The least grid depths of the lists for which enough(depths) holds, taking steps in falling order of their worth.

    worth: (steps, lists), falling in each list, so that steps taken by worth are the first ones of their lists.
    """
    low, high = 0.0, float(worth.max(initial=0)) * 1.01 + 1e-9  # at `low` every step is taken
    for _ in range(12):
        level = (low + high) / 2
        if enough((worth >= level).sum(0)):
            low = level
        else:
            high = level
    short, far = (worth >= high).sum(0), (worth >= low).sum(0)
    low, high = 0, 64  # steps of one worth are taken in part
    while high - low > 1:
        part = (low + high) // 2
        if enough(short + (far - short) * part // 64):
            high = part
        else:
            low = part
    return short + (far - short) * high // 64


def threshold_search(ids: np.ndarray, data: np.ndarray, lists: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query id, candidate ids, scores, how many were scored) of every query's k best in one block, ties to the smaller id.

    Integers throughout; float32 or float64 hold them only where every sum is exact there.
    """
    n, dims = data.shape
    bound = float(np.abs(data).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(dims, 1)
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    values, asked = data.astype(kind), queries.astype(kind)
    wide = np.float64 if bound < 2**53 else np.int64
    depth = np.unique(np.concatenate([[0, n], np.geomspace(min(4, n), n, GRID).astype(np.int64)]))
    each = np.arange(dims)
    # the best component left in a list that has been read so far, from its large and from its small end
    large = data[lists[:, np.minimum(depth, n - 1)], each[:, None]].T.astype(wide)
    small = data[lists[:, np.maximum(n - 1 - depth, 0)], each[:, None]].T.astype(wide)
    by_large, by_small = _worth(depth, large), _worth(depth, -small)
    for qid, q, exact in zip(query_ids, asked, queries, strict=True):
        left = np.where(exact > 0, large, small) * exact.astype(wide)
        worth = np.where(exact > 0, by_large, by_small) * np.abs(exact)
        seen, own = np.zeros(n, bool), ids == qid
        score = np.zeros(n, kind)
        read, kth, budget = np.zeros(dims, np.int64), None, FIRST * k
        while not seen.all():
            needed = np.full(dims, len(worth))
            if 8 * budget > n and kth is not None:  # before, kth says little yet
                needed = np.maximum(read, _depths(worth, lambda to: left[to, each].sum() < kth))
                if depth[needed].sum() - depth[read].sum() > DEAR * (n - seen.sum()):  # or only an end settles ties
                    needed = read
            to = needed
            if depth[needed].sum() > budget:
                to = np.maximum(read, np.minimum(needed, _depths(worth, lambda to, most=budget: depth[to].sum() >= most)))
                to = needed if (to == read).all() else to
            met = [lists[d, depth[a] : depth[b]] if exact[d] > 0 else lists[d, n - depth[b] : n - depth[a]] for d, (a, b) in enumerate(zip(read, to, strict=True)) if a < b and exact[d]]
            new = np.unique(np.concatenate(met)) if met else np.flatnonzero(~seen)  # nothing is worth a read: all others are met
            new = new[~seen[new]]
            score[new] = values[new] @ q
            seen[new] = True
            read, budget = to, GROWTH * budget
            found = score[seen & ~own]
            if len(found) >= k:
                kth = np.partition(found, len(found) - k)[len(found) - k].astype(wide)
                if kth > left[read, each].sum():  # at equality an unmet vector with a smaller id could tie
                    break
        pool = np.flatnonzero(seen & ~own)
        if len(pool) > k:
            got = score[pool]
            pool = pool[got >= np.partition(got, len(got) - k)[len(got) - k]]
        best = pool[np.lexsort((ids[pool], -score[pool]))][:k]
        yield int(qid), ids[best], score[best].astype(np.int64), int(seen.sum())


def exact_topk(vectors: DataFrame, scratch: Scratch, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose id is divisible by `every`, ties to smaller ids.

    A query's own id is no candidate. Vectors that are null or hold null or non-finite components, and rows with a null
    id, take no part; shorter vectors count as padded with zeros. Of rows with the same id each is a candidate for
    others, but they are one query, which asks with the smallest of their vectors. Other columns are ignored whatever
    their names. Empty tables, and queries without candidates, give no rows.
    """
    rows = vectors.select(F.col(id_col).alias("id"), integer_vector(F.col(vector_col), scale).alias("v")).where("id is not null and v is not null")
    rows = scratch.save(rows, "vectors")
    n = rows.count()
    asked = scratch.save(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")), "queries")
    m = asked.count()
    blocks = {}
    for kind, df, count, most in (("c", rows, n, CANDIDATES), ("q", asked, m, QUERIES)):
        packed = df.repartition(max(1, -(-count // most)), "id").mapInArrow(_pack(kind, most), BLOCK)
        packed = scratch.save(packed, f"blocks-{kind}")
        number = packed.select("block").withColumn(f"{kind}_no", F.row_number().over(W.orderBy("block")) - 1)  # names only
        blocks[kind] = packed.join(number, "block").select(f"{kind}_no", *[F.col(x).alias(f"{kind}_{x}") for x in ("dims", "ids", "data", "lists")]), packed.count()
    (c, n_c), (q, n_q) = blocks["c"], blocks["q"]
    if not n_c or not n_q:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pairs = c.withColumn("q_no", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).join(q.withColumn("c_no", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)))), ["c_no", "q_no"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.select(["c_dims", "c_ids", "c_data", "c_lists", "q_dims", "q_ids", "q_data"]).to_pylist():
                side = {}
                width = max(r["c_dims"], r["q_dims"])
                for s in "cq":
                    data = np.frombuffer(r[f"{s}_data"], np.int64).reshape(-1, r[f"{s}_dims"]) if r[f"{s}_dims"] else np.zeros((len(r[f"{s}_ids"]) // 8, 0), np.int64)
                    side[s] = np.frombuffer(r[f"{s}_ids"], np.int64), np.pad(data, ((0, 0), (0, width - data.shape[1])))
                n = len(side["c"][0])
                lists = np.frombuffer(r["c_lists"], np.int32).reshape(r["c_dims"], n)
                if width > r["c_dims"]:  # components that all candidates lack
                    lists = np.vstack([lists, np.tile(np.arange(n, dtype=np.int32), (width - r["c_dims"], 1))])
                found = list(threshold_search(*side["c"], lists, *side["q"], k))
                out = [np.concatenate(x) for x in ([np.full(len(i), a) for a, i, _, _ in found], [i for _, i, _, _ in found], [s for _, _, s, _ in found])]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    hits = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
