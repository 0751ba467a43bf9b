"""SimHash near-duplicates with BK-trees.

Distinct fingerprints are dealt into shards by keys that near ones must share, a BK-tree is grown in every shard
(children keyed by Hamming distance to the parent) and searched along the edges within the radius; each shard gives
spanning links only, and components tie them together. Exact copies have one fingerprint and are never paired.

The query's fingerprints have 64 bits and radius 3; ten keys of 25 bits each, the pairs of five blocks, make its search
exact (of five blocks two are the same in any two fingerprints at 3 bits) and keep shards small up to billions of
fingerprints. The trees of a shard go to the tasks that hold its rows; they are not broadcast to all, since all trees
together grow with the corpus. The pipeline stage takes five-word shingles and a similarity of
0.8: fingerprints of 256 bits over distinct shingles, with keys of MinHash bands. There a hit of the tree only proposes
a pair: first components of proposed pairs are built, then pairs within them are linked by the exact Jaccard similarity
of their distinct shingle hashes.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; texts of fewer words than a
shingle are one shingle; null ids take part but are no component's smallest unless all are null; repeated rows share
a component. Shards beyond TREE fingerprints are split into parts, each pair of which meets. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from palisade.llm.common import held, map_texts
from palisade.llm.components import components
from palisade.session import cut, drop_cut

SHINGLE, RADIUS = 3, 3
#: Fingerprints of one tree at most; larger shards are split.
TREE = 2048
#: Stage: words a shingle, 64-bit words a fingerprint, radius (a Jaccard similarity of 0.8 lies at 39 bits +- 6, of four
#: shingles against five at 48 +- 6), bands of two.
STAGE_SHINGLE, STAGE_WORDS, STAGE_RADIUS, STAGE_BANDS = 5, 4, 72, 10
#: Stage: fingerprints of one tree at most.
STAGE_TREE = 1024
#: Stage: texts in proposed pairs whose names are broadcast at most (some 100 MB); beyond, names and sets are shuffled together.
BROADCAST_NODES = 500_000
_STEP = 200_000
_ODD = [(2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64) | 1 for k in range(64)]


def shingle_hashes(text: str, n: int) -> np.ndarray:
    """XXH64 (seed 42) of the n-word shingles in order, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(words) - n + 1)
    xx = xxhash.xxh64_intdigest
    return np.fromiter((xx(joined[a:b], 42) for a, b in zip(starts[:k].tolist(), ends[-k:].tolist())), np.uint64, k)


def vote(h: np.ndarray) -> np.ndarray:
    """Bits set in over half the rows of a matrix of 64-bit words."""
    ones = np.zeros(h.shape[1] * 64, np.int64)
    for lo in range(0, len(h), _STEP):
        part = np.ascontiguousarray(h[lo:lo + _STEP]).astype("<u8", copy=False)
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        for a in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            ones += np.add.reduce(bits[a:a + 255], axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")


def fingerprint(text: str, n: int = SHINGLE) -> int:
    return int(vote(shingle_hashes(text, n)[:, None])[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class BKTree:
    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return
        at = 0
        while True:
            d = (self.values[at] ^ value).bit_count()
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return
            at = nxt

    def search(self, value: int, radius: int) -> list[int]:
        """Positions of all values within the radius."""
        out, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                out.append(at)
            kids = self.children[at]
            if len(kids) <= 2 * radius:
                stack += [c for e, c in kids.items() if -radius <= e - d <= radius]
            else:
                stack += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
        return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted arrays of distinct hashes have a Jaccard similarity of 0.8 or more."""
    low, high = sorted((len(a), len(b)))
    if 5 * low < 4 * high:
        return False
    both = np.concatenate([a, b])
    both.sort()
    return 9 * int((both[1:] == both[:-1]).sum()) >= 4 * (low + high)


def _spanning(left: list[int], right: list[int] | None, radius: int, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that span what lies within the radius among left, or between left and right: positions in left + right.

    With sets (of left + right), only pairs of similar sets are linked.
    """
    n = len(left) + len(right or ())
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    tree, links = BKTree(), []

    def meet(i: int, value: int) -> None:
        for j in tree.search(value, radius):
            a, b = find(i), find(j)
            if a != b and (sets is None or similar(sets[i], sets[j])):
                root[max(a, b)] = min(a, b)
                links.append((j, i))

    for i, v in enumerate(left):
        if right is None:
            meet(i, v)
        tree.add(v)
    for i, v in enumerate(right or ()):
        meet(len(left) + i, v)
    return links


def links(prints: DataFrame, keys: Column, radius: int, words: int, tree: int = TREE) -> DataFrame:
    """Spanning links (u, v) between the ids of prints (id, w array<long>) within the radius that share a key.

    keys: an array of longs a row. Where prints have sets (binary, sorted distinct 64-bit hashes), only similar ones are
    linked. Shards are streams of sorted rows, so a task holds one tree at a time.
    """
    exact = "sets" in prints.columns
    kind = prints.schema["id"].dataType
    arrow = to_arrow_type(kind)
    cols = ["id", "w", *(["sets"] if exact else [])]
    rows = prints.select(*cols, F.explode(F.array_distinct(keys)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, "key").withColumn("parts", F.ceil(F.col("n") / tree).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = rows.withColumn("own", own).select(*cols, "key", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.select(*cols, "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own")
    n = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    rows = rows.repartition(n, "key", "a", "b").sortWithinPartitions("key", "a", "b", "own", "id")

    def run(batches):
        shard, ids, left, right, sets = None, [], [], [], []

        def finish():
            got = _spanning(left, right if shard[1] != shard[2] else None, radius, sets if exact else None) if len(ids) > 1 else []
            return [(ids[i], ids[j]) for i, j in got]

        for b in batches:
            found = []
            cols = [b.column(c) for c in ("key", "a", "b", "own", "id")]
            flat = b.column("w").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words)
            values = [int(x) for x in flat[:, 0]] if words == 1 else [int.from_bytes(x.tobytes(), "little") for x in flat]
            packed = b.column("sets").to_pylist() if exact else [None] * len(values)
            for key, p, q, own_part, i, v, h in zip(*(c.to_pylist() for c in cols), values, packed):
                if (key, p, q) != shard:
                    if shard is not None:
                        found += finish()
                    shard, ids, left, right, sets = (key, p, q), [], [], [], []
                ids.append(i)
                if exact:
                    sets.append(np.frombuffer(h, "<u8"))
                (left if own_part == p else right).append(v)
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], arrow) for k in (0, 1)], ["u", "v"])
        if shard is not None:
            found = finish()
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], arrow) for k in (0, 1)], ["u", "v"])

    return rows.mapInArrow(run, f"u {kind.simpleString()}, v {kind.simpleString()}").where("u <> v").distinct()


def _blocks(fp: Column, radius: int) -> Column:
    """Keys of a 64-bit fingerprint, the pairs of radius + 2 blocks, of which two within the radius share one."""
    k = radius + 2
    cuts = [64 * i // k for i in range(k + 1)]
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    return F.array(*[(F.shiftleft(x, 26) + y) * (k * k) + i * k + j for i, x in enumerate(part) for j, y in enumerate(part) if i < j])


def near_duplicates(docs: DataFrame, n: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id of docs (doc_id, text)."""

    def make():
        return lambda texts: [[_signed(fingerprint(t, n)) for t in texts]]

    prints = cut(map_texts(docs.select("doc_id", "text"), make, "fp long"), "fingerprints")
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    found = links(reps.select(F.col("fp").alias("id"), F.array("fp").alias("w")), _blocks(F.col("id"), radius), radius, 1)
    roots = components(found).withColumnsRenamed({"node": "fp"})
    rooted = reps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    own = rooted.join(lows, "root").select("fp", "component_id")
    return prints.join(own, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_prints(text: str) -> tuple[bytes, list[int], list[int], bytes]:
    """Of the set of distinct shingle hashes: its name (128 bits), fingerprint words, MinHash band keys, and the sorted hashes."""
    h = np.unique(shingle_hashes(text, STAGE_SHINGLE))
    sets = h.astype("<u8").tobytes()
    name = xxhash.xxh3_128_digest(sets)
    if not len(h):
        return name, [0] * STAGE_WORDS, [0], sets
    with np.errstate(over="ignore"):
        mixed = [h * np.uint64(_ODD[k]) for k in range(STAGE_WORDS)]
        mixed = [(m ^ (m >> np.uint64(32))) * np.uint64(_ODD[k + 8]) for k, m in enumerate(mixed)]
        mixed = [m ^ (m >> np.uint64(29)) for m in mixed]
        low = [int((h * np.uint64(_ODD[16 + k])).min()) for k in range(2 * STAGE_BANDS)]
    fp = vote(np.stack(mixed, axis=1))
    keys = [xxhash.xxh64_intdigest(b"%d,%d,%d" % (k, low[2 * k], low[2 * k + 1])) for k in range(STAGE_BANDS)]
    return name, [_signed(int(x)) for x in fp], [_signed(k) for k in keys], sets


def _verified(prints: DataFrame) -> DataFrame:
    """(node, root) of the ids of prints (id, w, bands, sets; rows of one id are alike) tied by pairs of similar shingle sets.

    Sets are carried only by what some proposed pair touches, once where the proposed component fits a tree; a larger
    component is searched by the bands again.
    """
    reps = prints.groupBy("id").agg(F.min("w").alias("w"), F.min("bands").alias("bands"))
    coarse = cut(components(links(reps, F.col("bands"), STAGE_RADIUS, STAGE_WORDS, STAGE_TREE)), "stage-proposed")
    sizes = coarse.groupBy("root").agg(F.count("*").alias("size"))
    nodes = coarse.join(sizes, "root").select(F.col("node").alias("id"), "root", "size")
    if coarse.count() <= BROADCAST_NODES:
        nodes = F.broadcast(nodes)  # so that the sets of texts without a proposed pair stay where they are
    own = prints.join(nodes, "id").groupBy("id", "root", "size").agg(F.min("w").alias("w"), F.min("bands").alias("bands"), F.min("sets").alias("sets"))
    own = cut(own, "stage-sets")
    keys = F.when(F.col("size") <= STAGE_TREE, F.array(F.xxhash64("root"))).otherwise(F.col("bands"))
    roots = components(links(own, keys, STAGE_RADIUS, STAGE_WORDS, STAGE_TREE))
    drop_cut(own)
    return roots


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every group of near copies the row of the smallest doc_id stays (of equal ids the smallest text
    hash, null ids last). Null and texts without words are copies of each other; rows equal in id and text count once;
    all columns stay, whatever their names."""
    names = docs.columns
    plain = docs.toDF(*[f"__c{k}" for k in range(len(names))])
    doc_id, text = (f"__c{names.index(c)}" for c in ("doc_id", "text"))
    keyed = plain.withColumn("__t", F.xxhash64(F.coalesce(text, F.lit(""))))

    def make():
        held("near_dedup", dict)  # models of earlier stages go
        return lambda texts: [list(c) for c in zip(*(stage_prints(t) for t in texts))] if texts else [[], [], [], []]

    whole = cut(map_texts(keyed.select(F.col(doc_id).alias("d"), "__t", F.col(text).alias("text")), make, "id binary, w array<long>, bands array<long>, sets binary"), "stage-fingerprints")
    prints = cut(whole.select("d", "__t", "id"), "stage-ids")
    roots = _verified(whole).withColumnsRenamed({"node": "id"})
    drop_cut(whole)
    first = F.struct(F.col("d").isNull(), "d", "__t")
    own = prints.groupBy("id").agg(F.min(first).alias("first"), F.count("*").alias("n")).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    kept = own.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.d").alias("__d"), F.col("first.__t").alias("__h"))
    left = keyed.join(kept, F.col(doc_id).eqNullSafe(F.col("__d")) & (F.col("__t") == F.col("__h")), "left_semi")
    again = prints.groupBy("d", "__t").agg(F.count("*").alias("n")).where("n > 1").select(F.col("d").alias("__d"), F.col("__t").alias("__h"))
    same = F.col(doc_id).eqNullSafe(F.col("__d")) & (F.col("__t") == F.col("__h"))
    left = cut(left.drop("__d"), "stage-kept")
    out = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates([doc_id, "__t"]))
    return out.select(*[F.col(f"__c{k}").alias(c) for k, c in enumerate(names)])
