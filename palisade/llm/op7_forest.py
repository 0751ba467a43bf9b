"""Approximate nearest neighbours by a hash-prefix forest.

Rows are dealt into shards of about SHARD rows, each indexed once and written to the shared folder. In a shard every
tree is a sorted array of long hash strings: a random rotation of the vectors (less the shard's mean), cut into blocks
of BLOCK_DIMS coordinates, gives a symbol a block (the coordinate of largest magnitude and its sign), then symbols of
the blocks' runners-up, SYMBOLS in all. A query descends in each tree to its longest-prefix match; then all trees ascend
together, a symbol at a time and tree after tree, until the rows under the shared prefixes number wanted(n) of a shard's
n rows, a power of n below 1. These are the candidates, ranked by their exact distance. Equal vectors of a shard are one leaf.
Queries are broadcast in blocks of BLOCK; each block meets all shards, and the best k of all shards merge.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, as queries or as
candidates; vectors of another length than the query's aren't its candidates; rows of the query's own vec_id aren't
either; repeated query rows are answered once; ties go to the smaller vec_id; fewer candidates than k give fewer
rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.session import cut

K = 10
TREES, SYMBOLS, BLOCK_DIMS = 144, 6, 16
#: Bits of a symbol; a string of SYMBOLS fits 32 bits.
SYMBOL_BITS = 5
#: The ascent ends when the rows under the shared prefixes, over all trees, number FACTOR * rows ** POWER.
FACTOR, POWER = 18.0, 0.56
SHARD = 32_768
#: Queries of a broadcast.
BLOCK = 20_000


def wanted(rows: int, k: int, factor: float = FACTOR) -> int:
    return max(k + 1, int(np.ceil(factor * rows ** POWER)))


def rotation(tree: int, dims: int) -> np.ndarray:
    """The random rotation of a tree, the same in all shards."""
    return np.linalg.qr(np.random.default_rng((7, tree, dims)).standard_normal((dims, dims)))[0].astype(np.float32)


def strings(x: np.ndarray, tree: int) -> np.ndarray:
    """The hash strings of centred rows in a tree."""
    dims = x.shape[1]
    width = min(BLOCK_DIMS, dims)
    blocks = dims // width
    y = (x @ rotation(tree, dims))[:, :blocks * width].reshape(len(x), blocks, width)
    size, rows, cols = np.abs(y), np.arange(len(x))[:, None], np.arange(blocks)[None]
    symbols: list[np.ndarray] = []
    while len(symbols) < SYMBOLS:  # the largest of each block, then the next largest, and so on
        at = size.argmax(axis=2)
        symbols += list((at * 2 + (y[rows, cols, at] > 0)).T)
        size[rows, cols, at] = -1
    code = np.zeros(len(x), np.uint32)
    for s in symbols[:SYMBOLS]:
        code = code << np.uint32(SYMBOL_BITS) | s.astype(np.uint32)
    return code


class Forest:
    """Sorted hash strings of the distinct vectors of a shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, trees: int = TREES):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], np.ascontiguousarray(x[order] + 0.0)  # -0 is 0
        _, first, leaf = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        self.x, self.trees = x[first], trees
        self.by_leaf = ids[np.argsort(leaf, kind="stable")]
        self.leaf_start = np.concatenate([[0], np.cumsum(np.bincount(leaf, minlength=len(first)))])
        self.mean = self.x.mean(axis=0)
        low = (self.x - self.mean).astype(np.float32)
        codes = np.stack([strings(low, t) for t in range(trees)])
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.uint16 if len(first) <= 1 << 16 else np.uint32)
        self.sorted = np.take_along_axis(codes, self.order.astype(np.int64), axis=1)

    #: Arrays of an index as it is written.
    PARTS = ("x", "by_leaf", "leaf_start", "mean", "order", "steps")

    def dump(self) -> dict[str, bytes]:
        """The index as byte strings; of sorted strings their differences, which compress well."""
        steps = np.diff(self.sorted, axis=1, prepend=np.uint32(0))
        return {n: getattr(self, n).tobytes() for n in self.PARTS[:-1]} | {"steps": steps.tobytes()}

    @classmethod
    def load(cls, dims: int, leaves: int, parts: dict[str, bytes], trees: int = TREES) -> Forest:
        f = cls.__new__(cls)
        f.trees = trees
        f.x = np.frombuffer(parts["x"]).reshape(leaves, dims)
        f.by_leaf, f.leaf_start, f.mean = np.frombuffer(parts["by_leaf"], np.int64), np.frombuffer(parts["leaf_start"], np.int64), np.frombuffer(parts["mean"])
        f.order = np.frombuffer(parts["order"], np.uint16 if leaves <= 1 << 16 else np.uint32).reshape(trees, leaves)
        f.sorted = np.cumsum(np.frombuffer(parts["steps"], np.uint32).reshape(trees, leaves), axis=1, dtype=np.uint32)
        return f

    def descend(self, codes: np.ndarray) -> np.ndarray:
        """Symbols that each query's string (trees x queries) shares with its longest-prefix match in each tree."""
        best = np.zeros(codes.shape, np.int64)
        for t in range(self.trees):
            at = np.searchsorted(self.sorted[t], codes[t])
            for near in (np.maximum(at - 1, 0), np.minimum(at, self.sorted.shape[1] - 1)):
                differ = np.frexp((self.sorted[t][near] ^ codes[t]).astype(np.float64))[1]  # bits from the first that differs
                best[t] = np.maximum(best[t], (SYMBOLS * SYMBOL_BITS - differ) // SYMBOL_BITS)
        return best

    def under(self, codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows that share level symbols with each query's string begin and end, in each tree."""
        free = np.uint32((1 << SYMBOL_BITS * (SYMBOLS - level)) - 1)
        low = codes & ~free
        return tuple(np.stack([np.searchsorted(self.sorted[t], edge[t], side) for t in range(self.trees)]) for edge, side in ((low, "left"), (low | free, "right")))

    def search(self, q: np.ndarray, own: np.ndarray, k: int = K, factor: float = FACTOR) -> tuple[list[list[tuple[float, int]]], int]:
        """For every query (its vector, its own id) the k nearest candidates, (distance, vec_id), and how many vectors
        were compared in all."""
        low = (q - self.mean).astype(np.float32)
        codes = np.stack([strings(low, t) for t in range(self.trees)])
        want = wanted(len(self.x), k, factor)
        deepest = self.descend(codes).max(axis=0)
        out: list = [None] * len(q)
        left, compared = np.arange(len(q)), 0
        lower = np.zeros((2, *codes.shape), np.int64)  # what lies under the prefixes one symbol longer
        for depth in range(SYMBOLS, 0, -1):  # all trees ascend together
            here = left[deepest[left] >= depth]
            if not len(here):
                continue
            a, b = self.under(codes[:, here], depth)
            (c, d), n = lower[:, :, here], b - a
            reach = np.cumsum(n, axis=0) + (d - c).sum(axis=0) - np.cumsum(d - c, axis=0)  # rows when so many trees have ascended
            for j in np.flatnonzero(reach[-1] >= want):
                trees = int(np.argmax(reach[:, j] >= want)) + 1
                lo, hi = np.append(a[:trees, j], c[trees:, j]), np.append(b[:trees, j], d[trees:, j])
                seen = np.unique(np.concatenate([self.order[t, lo[t]:hi[t]] for t in np.flatnonzero(hi > lo)]))
                if self.leaf_start[seen + 1].sum() - self.leaf_start[seen].sum() > k:  # else the same few rows in every tree
                    i = here[j]
                    out[i] = self._nearest(q[i], own[i], seen, k)
                    compared += len(seen)
            lower[0][:, here], lower[1][:, here] = a, b
            left = np.array([i for i in left if out[i] is None], np.int64)
        for i in left:  # the root: all rows
            out[i] = self._nearest(q[i], own[i], np.arange(len(self.x)), k)
            compared += len(self.x)
        return out, compared

    def _nearest(self, q: np.ndarray, own: int, cand: np.ndarray, k: int) -> list[tuple[float, int]]:
        d = np.sqrt(((self.x[cand] - q) ** 2).sum(axis=1))
        if len(d) > 2 * k + 2:
            near = d <= np.partition(d, 2 * k + 1)[2 * k + 1]
            cand, d = cand[near], d[near]
        best: list[tuple[float, int]] = []
        for j in np.lexsort((cand, d)):
            if len(best) >= k and d[j] > best[k - 1][0]:
                break
            ids = self.by_leaf[self.leaf_start[cand[j]]:self.leaf_start[cand[j] + 1]][:k + 1]  # ascending
            best = sorted(best + [(float(d[j]), int(v)) for v in ids if v != own])[:k]
        return best


def valid(vectors: DataFrame) -> DataFrame:
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)


INDEX = "dims int, leaves int, " + ", ".join(f"{n} binary" for n in Forest.PARTS)


def index(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """Forests of shards of vectors (vec_id, embedding), a row each: of at most two times shard rows and one length."""
    rows = valid(vectors)
    rows = rows.repartition(max(1, -(-rows.count() // shard)))  # rows in turn: no key decides

    def run(batches):
        ids, flat = [], []
        for b in batches:
            ids += b.column("vec_id").to_pylist()
            flat += [v.values.to_numpy(zero_copy_only=False) for v in b.column("embedding")]
        size = np.fromiter(map(len, flat), np.int64, len(flat))
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            for part in np.array_split(at, max(1, round(len(at) / shard))):
                f = Forest(np.array([ids[i] for i in part], np.int64), np.stack([flat[i] for i in part]))
                got = f.dump()
                yield pa.RecordBatch.from_arrays([pa.array([int(n)], pa.int32()), pa.array([len(f.x)], pa.int32()), *[pa.array([got[p]], pa.binary()) for p in Forest.PARTS]], ["dims", "leaves", *Forest.PARTS])

    return rows.mapInArrow(run, INDEX)


def _blocks(queries: DataFrame, size: int):
    part = []
    for r in valid(queries).distinct().orderBy("vec_id", "embedding").toLocalIterator():
        part.append((r["vec_id"], np.array(r["embedding"], float)))
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def neighbours(forests: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found in an index for each row of queries (vec_id, embedding)."""
    spark, found = queries.sparkSession, None
    schema = "q long, query_id long, vec_id long, score double"
    for b, part in enumerate(_blocks(queries, block)):
        ref = spark.sparkContext.broadcast(part)

        def run(batches, ref=ref, base=b * block):
            own = np.array([i for i, _ in ref.value])
            dims = np.array([len(v) for _, v in ref.value])
            for batch in batches:
                for r in range(batch.num_rows):
                    n = batch.column("dims")[r].as_py()
                    at = np.flatnonzero(dims == n)
                    if not len(at):
                        continue
                    forest = Forest.load(n, batch.column("leaves")[r].as_py(), {p: batch.column(p)[r].as_py() for p in Forest.PARTS})
                    for lo in range(0, len(at), 512):
                        some = at[lo:lo + 512]
                        got, _ = forest.search(np.stack([ref.value[i][1] for i in some]), own[some], k, factor)
                        out = [(base + int(i), int(own[i]), v, d) for i, near in zip(some, got) for d, v in near]
                        yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["q", "query_id", "vec_id", "score"])

        one = forests.mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("q").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(cut(index(vectors), "forests"), vectors.where("vec_id % 100 = 0"))
