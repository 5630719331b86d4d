"""Near-duplicate groups by banded MinHash with odd sketches.

1. A document's set of word shingles becomes 160 MinHash samples. The samples are folded into an odd sketch, a bitmap in
   which each sample flips one bit, and into 32 band keys of five samples.
2. Documents with equal sets form a class; one representative of each class goes on.
3. Representatives that share a band key are candidates. A pair is kept if its sizes allow the similarity and the
   population count of the XOR of its odd sketches doesn't put the similarity far below it; it is then confirmed on the
   full sets, which are sets of 64-bit hashes of shingles.
4. Each bucket is first tested as a star around its smallest member, which joins most groups. Buckets whose members
   still lie in different components are cut into blocks, bounded in members and in shingles; a block pair is one unit of work that holds its members'
   sketches, then the full sets of those with a likely partner, and gives out a spanning forest of its confirmed links.
   So every pair of a bucket is looked at, but no pair is ever a row unless it is likely (stars) or a link (blocks).
5. Links become components by alternating stars, until nothing changes.

Rows of a hot key (a band or a class that many documents share, a star's centre) meet what belongs to the key by
broadcast, or in salted copies where that is a set, so no task holds all rows of one.

A pair at similarity 0.8 shares no band with probability 3e-6 (at 0.85: 7e-9); the sketch filter is six standard
deviations wide.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, words

SAMPLES, BANDS, SKETCH_BITS, SEED = 160, 32, 512, 7
SLACK, BLOCK, BLOCK_SHINGLES = 0.25, 1024, 1 << 22
CHUNK = 8192
#: A key of more rows than HOT is met by broadcast, of at most HOT_KEYS keys; a hot centre stands in SALTS copies.
HOT, HOT_KEYS, SALTS = 1000, 100_000, 32


def hot_keys(counted: DataFrame, key: str, n: str) -> DataFrame:
    """The keys of more than HOT rows, or of ten, a hundred ... times as many, such that there are at most HOT_KEYS of them.
    counted: a saved table with a row per key."""
    least = HOT
    while (found := counted.where(F.col(n) > least).select(key)).count() > HOT_KEYS:
        least *= 10
    return F.broadcast(found)


def joined_by(rows: DataFrame, keyed: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the one row that `keyed` has for their key; those of hot keys stay where they are."""
    cold = rows.join(hot, key, "left_anti").join(keyed.join(hot, key, "left_anti"), key, how)
    return cold.unionByName(rows.join(F.broadcast(keyed.join(hot, key, "left_semi")), key))


def shingled(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(doc_id, shingles, more): distinct 64-bit hashes of runs of `size` words, A-Z lower-cased; with fewer words the whole
    sequence is one; no words, none."""
    lowered = F.translate(F.col(text_col), string.ascii_uppercase, string.ascii_lowercase)
    d = docs.select(F.struct(F.col(id_col).alias("doc_id"), *more).alias("row"), words(lowered).alias("w")).withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    runs = F.col("h")
    for k in range(1, size):
        left = F.greatest(F.size("h") - k, F.lit(0))
        runs = F.zip_with(F.slice(runs, 1, left), F.slice("h", k + 1, left), lambda a, b: F.xxhash64(a, b))
    short = F.when(F.size("w") > 0, F.array(F.xxhash64(F.concat_ws(" ", "w"), F.lit(size)))).otherwise(F.array().cast("array<bigint>"))
    return d.select("row.*", F.when(F.size("h") >= size, F.array_distinct(runs)).otherwise(short).alias("shingles"))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sketcher:
    def __init__(self, samples: int = SAMPLES, bands: int = BANDS, bits: int = SKETCH_BITS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 2**31, (samples, 1), dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 2**32, (samples, 1), dtype=np.uint32)
        self.samples, self.bands, self.bits = samples, bands, bits

    def minhash(self, h: np.ndarray) -> np.ndarray:
        """The smallest value of each of the hash functions over a set (uint64, not empty)."""
        x = (_mix(h) >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.samples, 2**32 - 1, np.uint32)
        for k in range(0, len(x), CHUNK):
            np.minimum(least, (self.a * x[None, k : k + CHUNK] + self.b).min(axis=1), out=least)
        return least

    def odd_sketches(self, sig: np.ndarray) -> np.ndarray:
        """(documents, words of 64 bits): each sample flips the bit that it and its number hash to."""
        n = len(sig)
        at = _mix(sig.astype(np.uint64) + (np.arange(self.samples, dtype=np.uint64) << np.uint64(32))) % np.uint64(self.bits)
        flat = (np.arange(n)[:, None] * self.bits + at.astype(np.int64)).ravel()
        odd = np.bincount(flat, minlength=n * self.bits).reshape(n, self.bits) & 1
        return np.packbits(odd.astype(np.uint8), axis=1).view(np.uint64).view(np.int64)

    def band_keys(self, sig: np.ndarray) -> np.ndarray:
        rows = sig.reshape(len(sig), self.bands, -1).astype(np.uint64)
        key = np.broadcast_to(np.arange(self.bands, dtype=np.uint64), rows.shape[:2]).copy()
        for j in range(rows.shape[2]):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j] + np.uint64(1))
        return key.view(np.int64)


def most_flips(similarity: float, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> int:
    """How many bits may differ between two odd sketches before their similarity is estimated below `similarity`:
    2 * samples * (1 - similarity) flips fall on `bits` places."""
    return math.floor(bits / 2 * (1 - (1 - 2 / bits) ** (2 * samples * (1 - similarity))))


SIGNATURE = "doc_id long, text_key long, n_shingles long, k1 long, k2 long, bands array<bigint>, sketch array<bigint>"


def signatures(sets: DataFrame) -> DataFrame:
    """Set size, a 128-bit digest of the set, band keys and odd sketch of each document; empty sets have no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher()
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                batch = whole.slice(k, 2048)
                lists = batch.column("shingles")
                at = lists.offsets.to_numpy()
                flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
                n = len(at) - 1
                sig, k1, k2 = np.zeros((n, sketcher.samples), np.uint32), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                sizes = np.diff(at)
                for i in np.flatnonzero(sizes):
                    h = flat[at[i] : at[i + 1]]
                    sig[i] = sketcher.minhash(h)
                    k1[i], k2[i] = _mix(h).sum(dtype=np.uint64), np.bitwise_xor.reduce(_mix(h + np.uint64(0x9E3779B97F4A7C15)))
                keys, sketches = sketcher.band_keys(sig), sketcher.odd_sketches(sig)
                empty = sizes == 0
                arrays = [
                    batch.column("doc_id"), batch.column("text_key"), pa.array(sizes.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(empty, 0, keys.shape[1]))]).astype(np.int32)), pa.array(keys[~empty].ravel())),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * sketches.shape[1]), pa.array(sketches.ravel())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "n_shingles", "k1", "k2", "bands", "sketch"])

    return sets.mapInArrow(run, SIGNATURE)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (a, b) can reach, by alternating large and small
    stars, until a round changes nothing; rounds grow as the logarithm of the nodes. A node's neighbours are only ever reduced to their minimum, so hubs are counted before the shuffle."""
    current = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "star")
    before = None
    while True:
        mark = current.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if mark[0] == 0 or mark == before:
            break
        before = mark
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: neighbours above a node go to its smallest neighbour
        large = current.select(F.col("v").alias("u"), F.col("u").alias("above")).join(least, "u").select(F.col("above").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        after = scratch.save(small.where("u > v").distinct(), "star")
        scratch.drop(current)
        current = after
    tops = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops).distinct()


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key of a partition that is sorted by its keys; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(k).to_numpy() for k in keys])
        starts = np.concatenate([[0], np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1])
        ends = np.concatenate([starts[1:], [batch.num_rows]])
        for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
            key = tuple(columns[:, lo].tolist())
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def likely_members(flips: int, percent: int):
    """For each block of a bucket, its members that have a likely partner in another component: sizes and odd sketches
    allow the similarity, and no earlier band has both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["band", "x", "y"]):
            m = g.num_rows
            side, comp, n = (g.column(c).to_numpy() for c in ("side", "comp", "n"))
            sketch, keys = _matrix(g.column("sketch"), m).view(np.uint64), _matrix(g.column("keys"), m)
            place, cross = g.column("place")[0].as_py(), g.column("x")[0].as_py() != g.column("y")[0].as_py()
            involved = np.zeros(m, bool)
            for lo in range(0, m, 64):
                i = np.arange(lo, min(m, lo + 64))
                ok = np.bitwise_count(sketch[i, None, :] ^ sketch[None, :, :]).sum(axis=2, dtype=np.int32) <= flips
                ok &= comp[i, None] != comp[None, :]
                ok &= 100 * np.minimum(n[i, None], n[None, :]) >= percent * np.maximum(n[i, None], n[None, :])
                ok &= (side[i, None] < side[None, :]) if cross else (i[:, None] < np.arange(m)[None, :])
                a, b = np.nonzero(ok)
                a = i[a]
                for k in range(0, len(a), 65536):
                    u, v = a[k : k + 65536], b[k : k + 65536]
                    new = ~(keys[u, :place] == keys[v, :place]).any(axis=1)
                    involved[u[new]] = involved[v[new]] = True
            if involved.any():
                yield from g.select(["band", "x", "y", "side", "rep", "comp"]).filter(pa.array(involved)).combine_chunks().to_batches()

    return run


def exact_links(percent: int):
    """For each block the links between components that the full sets confirm, thinned to a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["band", "x", "y"]):
            m = g.num_rows
            rep, side, comp = (g.column(c).to_numpy() for c in ("rep", "side", "comp"))
            sets = g.column("shingles").combine_chunks()
            n = np.diff(sets.offsets.to_numpy())
            row = np.repeat(np.arange(m), n)
            _, word, count = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
            shared = np.flatnonzero(count > 1)  # a shingle of one member adds to no intersection
            number = np.full(len(count), -1)
            number[shared] = np.arange(len(shared))
            at = number[word]
            order = np.argsort(at, kind="stable")
            row, at = row[order], at[order]
            common = np.zeros((m, m), np.float32)
            for k in range(0, len(shared), 4096):
                lo, hi = np.searchsorted(at, [k, k + 4096])
                has = np.zeros((m, min(4096, len(shared) - k)), np.float32)
                has[row[lo:hi], at[lo:hi] - k] = 1
                common += has @ has.T
            common = common.astype(np.int64)
            linked = (100 * common >= percent * (n[:, None] + n[None, :] - common)) & (comp[:, None] != comp[None, :])
            if g.column("x")[0].as_py() != g.column("y")[0].as_py():
                linked &= side[:, None] != side[None, :]
            seen, out = np.zeros(m, bool), []
            for first in range(m):
                if seen[first]:
                    continue
                seen[first], todo = True, [first]
                while todo:
                    u = todo.pop()
                    for v in np.flatnonzero(linked[u] & ~seen).tolist():
                        seen[v] = True
                        todo.append(v)
                        out.append((u, v))
            if out:
                u, v = np.array(out).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[u], rep[v])), pa.array(np.maximum(rep[u], rep[v]))], ["a", "b"])

    return run


class Linker:
    """Finds links between representatives. reps: node, n_shingles, sketch, bands, shingles of every candidate."""

    def __init__(self, reps: DataFrame, scratch: Scratch, percent: int):
        self.reps, self.scratch, self.percent, self.flips = reps, scratch, percent, most_flips(percent / 100 - SLACK)

    def side(self, x: str, *columns: str) -> DataFrame:
        return self.reps.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])

    def starred(self, pairs: DataFrame, hubs: DataFrame, *columns: str) -> DataFrame:
        """Pairs (a, b) with columns of both. A hot centre a stands in SALTS copies, and its pairs are dealt among them."""
        hot = hubs.withColumn("hot", F.lit(SALTS))
        salted = pairs.join(hot, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("hot", F.lit(1))).cast("int")).drop("hot")
        centres = self.side("a", *columns).join(hot, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("hot", F.lit(1)) - 1))).drop("hot")
        return salted.join(centres, ["a", "salt"]).join(self.side("b", *columns), "b")

    def likely(self, pairs: DataFrame, hubs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and odd sketches allow the similarity."""
        differ = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        fits = 100 * F.least("n_shingles_a", "n_shingles_b") >= self.percent * F.greatest("n_shingles_a", "n_shingles_b")
        return self.starred(pairs, hubs, "n_shingles", "sketch").where(fits & (differ <= self.flips)).select("a", "b")

    def confirm(self, pairs: DataFrame, hubs: DataFrame) -> DataFrame:
        """Pairs whose full sets reach the similarity."""
        common = F.size(F.array_intersect("shingles_a", "shingles_b"))
        return self.starred(pairs, hubs, "shingles").where(100 * common >= self.percent * (F.size("shingles_a") + F.size("shingles_b") - common)).select("a", "b")

    def run(self, buckets: DataFrame, bands: DataFrame) -> DataFrame:
        """buckets: (band, place, rep), of at least 2 members; bands: (band, a, n, bulk), their smallest member, members and
        shingles. Returns (node, component)."""
        hot = hot_keys(bands, "band", "n")
        # every bucket as a star around its smallest member: one test a member
        star = joined_by(buckets, bands.select("band", "a"), "band", hot).where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
        star = self.scratch.save(star, "star")
        hubs = hot_keys(self.scratch.save(star.groupBy("a").agg(F.count("*").alias("n")), "hubs"), "a", "n")
        likely = self.scratch.save(self.likely(star, hubs), "star-pairs")
        links = self.scratch.save(self.confirm(likely, hubs), "star-links")
        labels = self.scratch.save(components(links, self.scratch), "labels")
        # what still lies in different components, block against block
        rows = buckets.join(labels, F.col("rep") == F.col("node"), "left").select("band", "place", "rep", F.coalesce("component", "rep").alias("comp"))
        mixed = rows.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
        mixed = self.scratch.save(mixed.join(bands.where("n > 2").select("band", "n", "bulk"), "band"), "mixed")
        rows = live = self.scratch.save(joined_by(rows, mixed, "band", hot), "live")
        parts = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bulk") / BLOCK_SHINGLES)).cast("int")
        rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        block = [F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), (F.col("part") > F.col("other")).cast("int").alias("side")]
        rows = rows.select("band", "place", *block, "rep", "comp").join(self.side("rep", "n_shingles", "sketch", "bands"), "rep")
        rows = rows.select("band", "place", "x", "y", "side", "rep", "comp", F.col("n_shingles_rep").alias("n"), F.col("sketch_rep").alias("sketch"), F.col("bands_rep").alias("keys"))
        by = ["band", "x", "y"]
        found = rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(likely_members(self.flips, self.percent), "band long, x int, y int, side int, rep long, comp long")
        found = self.scratch.save(found, "members")
        exact = found.join(self.side("rep", "shingles"), "rep").select(*by, "side", "rep", "comp", F.col("shingles_rep").alias("shingles"))
        more = exact.repartition(*by).sortWithinPartitions(*by).mapInArrow(exact_links(self.percent), "a long, b long")
        more = self.scratch.save(more, "links")
        if not more.isEmpty():
            before, labels = labels, self.scratch.save(components(links.union(more), self.scratch), "labels")
            self.scratch.drop(before)
        self.scratch.drop(star, likely, links, mixed, live, found, more)
        return labels


def near_duplicates(docs: DataFrame, scratch: Scratch, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key, group) for every row: linked are texts whose shingle sets have a
    Jaccard similarity of at least percent / 100; component_id is the smallest id reachable; kept rows have that id.

    `text_key` is the 64-bit hash of the text and `group` a number that all rows of one component, and only those, share.
    Null and wordless texts have empty sets and are linked with nothing. Rows with a null id are linked with nothing, have
    a null component and group and are kept. Texts are linked by what they hold alone: rows that share an id but not a text
    are as apart as others, and repeated rows share a component; if they have its smallest id all of them are kept.
    Empty tables give no rows; other columns are ignored whatever their names.
    """
    key = F.xxhash64(text_col).alias("text_key")
    sets = shingled(docs.withColumn(id_col, F.col(id_col).cast("long")), size, id_col, text_col, key)
    sig = scratch.save(signatures(sets), "signatures")
    usable = sig.where("n_shingles > 0 and doc_id is not null").withColumn("class", F.struct("k1", "k2", "n_shingles"))
    classes = usable.groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.count("*").alias("copies"))
    classes = scratch.save(classes.select("class", "copies", "rep.*"), "classes")
    # an id names its class, unless it stands for several texts
    several = classes.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("several"))
    node = F.when(F.col("several"), F.xxhash64("doc_id", "text_key")).otherwise(F.col("doc_id")).alias("node")
    named = scratch.save(classes.join(several, "doc_id", "left").select("class", "copies", "doc_id", "text_key", node), "nodes")
    own = usable.select("doc_id", "text_key", "n_shingles", "sketch", "bands", "class").join(named.select("class", "doc_id", "text_key", "node"), ["class", "doc_id", "text_key"])
    own = scratch.save(own.drop("class").dropDuplicates(["node"]), "representatives")
    members = own.select(F.posexplode("bands").alias("place", "band"), F.col("node").alias("rep"), "n_shingles")
    bands = members.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("a"), F.sum("n_shingles").alias("bulk")).where("n > 1")
    bands = scratch.save(bands, "bands")
    buckets = scratch.save(joined_by(members.drop("n_shingles"), bands.select("band"), "band", hot_keys(bands, "band", "n")), "buckets")
    found = own.join(buckets.select(F.col("rep").alias("node")).distinct(), "node", "left_semi")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    text = text.join(found.select("doc_id", "text_key", "node"), ["doc_id", "text_key"])
    sets = shingled(text, size, "node", "text").withColumnRenamed("doc_id", "node").dropDuplicates(["node"])
    reps = scratch.save(found.select("node", "n_shingles", "sketch", "bands").join(sets, "node"), "candidates")
    labels = Linker(reps, scratch, percent).run(buckets, bands)
    scratch.drop(buckets, reps, own)
    # the smallest id of a component is that of one of its classes
    named = named.join(labels, "node", "left").withColumn("group", F.coalesce("component", "node"))
    linked = named.where("component is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    named = named.join(linked, "group", "left").select("class", "copies", "group", F.coalesce("component_id", "doc_id").alias("component_id"))
    named = scratch.save(named, "named")
    linked = joined_by(usable.select("doc_id", "n_shingles", "text_key", "class"), named.drop("copies"), "class", hot_keys(named, "class", "copies"))
    single = sig.where("n_shingles = 0 or doc_id is null")  # they meet no class, and share no key
    alone = single.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text_key", F.lit("alone"))).alias("group"))
    both = linked.select("doc_id", "n_shingles", "component_id", "text_key", "group").unionByName(alone)
    return both.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_key", "group")
