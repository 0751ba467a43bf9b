"""Product codes of vectors; the nearest entry of a part is found in a ball tree over the codebook of its position.

Vectors of whole numbers are cut into PARTS parts. A position's codebook of ENTRIES entries is a tree: a node has an
entry, a ball each for the nearer and the farther half of the rest, as a range of distances from the node's entry, and
subtrees of both. All parts of a batch go down together, each into its likelier half first; a half is visited unless
every distance in its range is out of reach of the best so far. Ranges and reaches are whole numbers rounded outwards, the test
is non-strict (an equal distance to a lower index wins), and distances themselves are exact, so the entry found is the
one that a comparison with all would give.

A round is one pass over the vectors, of which every task gives a row for each position and entry with its sums; at
most parts x entries rows reach the driver. Codes are written once, then errors are summed by label and joined back.

Edge cases: vectors that are null or hold null or non-finite components are left out; the others' common length is that
of the smallest vec_id's vector, and vectors of another length, or all of them where that is no multiple of the parts, keep a
row with null code and error; fewer vectors than entries give as many entries; an empty table gives no rows; null ids come
last among the first entries, equal ones are told apart by their vectors; an empty vector has code 0 in each part and error 0;
extra columns are ignored; components beyond 2 ** 25 after scaling are an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.vectors import floor_mean, matrix, sound, whole
from palisade.session import cut

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels whose sums are broadcast; more are shuffled.
BROADCAST_LABELS = 1_000_000


class Tree:
    """A ball tree over the entries of one position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        self.root = self._node(np.arange(len(entries)))

    def _node(self, members: np.ndarray):
        """(entry, cut, halves); a half is (least distance rounded down, greatest rounded up, node)."""
        if not len(members):
            return None
        spread = ((self.entries[members] - self.entries[members].sum(axis=0) // len(members)) ** 2).sum(axis=1)
        at = members[np.argmax(spread)]  # an outer entry separates the rest well
        rest = members[members != at]
        if not len(rest):
            return int(at), 0.0, []
        far = ((self.entries[rest] - self.entries[at]) ** 2).sum(axis=1)
        order = np.argsort(far, kind="stable")
        rest, far = rest[order], far[order]
        half = (len(rest) + 1) // 2
        halves = []
        for members, d in ((rest[:half], far[:half]), (rest[half:], far[half:])):
            if len(members):
                halves.append((_below(d[0]), _above(d[-1]), self._node(members)))
        return int(at), float(np.sqrt(far[half - 1])), halves

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of the nearest entry (ties: the lower index) of each row; and distances computed."""
        n = len(x)
        best, at = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        reach = np.full(n, np.inf)
        exact = x.dtype if np.array_equal(self.entries.astype(x.dtype).astype(np.int64), self.entries) else np.int64
        entries, x = self.entries.astype(exact), x.astype(exact, copy=False)
        compared = 0

        def visit(node, rows):
            nonlocal compared
            entry, cut_at, halves = node
            gap = x[rows] - entries[entry]
            d2 = np.einsum("ij,ij->i", gap, gap).astype(np.int64)
            compared += len(rows)
            nearer = (d2 < best[rows]) | ((d2 == best[rows]) & (entry < at[rows]))
            won = rows[nearer]
            best[won], at[won], reach[won] = d2[nearer], entry, _above(d2[nearer])
            if not halves:
                return
            low, high = _below(d2), _above(d2)
            inside = high <= cut_at
            for group, order in ((inside, halves), (~inside, halves[::-1])):
                mine, lo, hi = rows[group], low[group], high[group]
                for least, most, child in order:
                    if not len(mine):
                        break
                    near = (lo - reach[mine] <= most) & (hi + reach[mine] >= least)
                    if near.any():
                        visit(child, mine[near])

        if self.root is not None and n:
            visit(self.root, np.arange(n))
        return at, best, compared


def _below(d2):
    """A whole number at or below the distance of a square."""
    return np.maximum(np.floor(np.sqrt(d2)) - 1, 0)


def _above(d2):
    """A whole number at or above the distance of a square."""
    return np.ceil(np.sqrt(d2)) + 1


def _parts(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(p) for p in np.split(x, parts, axis=1)]


def _sums(trees: list[Tree], dims: int):
    """The mapInArrow function of a round: a row a position and entry with the number and sums of its parts in the task."""

    def run(batches):
        width = dims // len(trees)
        n = np.zeros((len(trees), len(trees[0].entries)), np.int64)
        sums = np.zeros((*n.shape, width), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            for p, x in enumerate(_parts(matrix(b.column("x"), dims), len(trees))):
                at, _, _ = trees[p].nearest(x)
                for e in np.unique(at):
                    rows = at == e
                    n[p, e] += rows.sum()
                    sums[p, e] += x[rows].sum(axis=0).astype(np.int64)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _codes(trees: list[Tree], dims: int, columns: list[str]):
    """The mapInArrow function that adds codes and errors to the given columns."""

    def run(batches):
        for b in batches:
            got = [t.nearest(x) for t, x in zip(trees, _parts(matrix(b.column("x"), dims), len(trees)))]
            code = np.stack([at for at, _, _ in got], axis=1).astype(np.uint8)
            text = pa.array([row.tobytes().hex() for row in code], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], text, pa.array(sum(d for _, d, _ in got), pa.int64())], [*columns, "code", "error"])

    return run


def train(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks, one a position, of rows (vec_id, x array<int> of dims)."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
    books = [np.array(b, np.int64) for b in _parts(np.array([r["x"] for r in first], np.int64).reshape(len(first), dims), parts)]
    width = dims // parts
    for _ in range(rounds if width else 0):
        made = rows.select("x").mapInArrow(_sums([Tree(b) for b in books], dims), "part int, entry int, n long, sums array<long>")
        total = [F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(width)]
        for r in made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # parts x entries rows
            books[r["part"]][r["entry"]] = [floor_mean(r[f"s{d}"], r["n"]) for d in range(width)]
    return books


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(codes, codebooks) of vectors (vec_id, embedding, label): vec_id, label, code string, error long a kept vector."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where(sound("embedding"))
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").select(F.size("embedding").alias("n")).limit(1).collect()
    empty = [F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")]
    dims = first[0]["n"] if first else 0
    if not first or dims % parts:
        return kept.select("vec_id", "label", *empty), []
    rows = cut(kept.where(F.size("embedding") == dims).select("vec_id", "label", whole("embedding", scale).alias("x")), "vectors")
    books = train(rows, dims, parts, entries, rounds)
    label = kept.schema["label"].dataType.simpleString()
    coded = rows.mapInArrow(_codes([Tree(b) for b in books], dims, ["vec_id", "label"]), f"vec_id long, label {label}, code string, error long")
    return coded.unionByName(kept.where(F.size("embedding") != dims).select("vec_id", "label", *empty)), books


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))
    rows = cut(coded, "codes")
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = cut(sums, "labels").withColumnRenamed("label", "of")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    digest = hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()
    both = rows.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB SQL that compares every part with every entry in every round."""
    gap = "list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c.x) + list_dot_product(c.x, c.x)"
    near = """a{r} AS (SELECT v.rid, v.part, v.x, arg_min(c.entry, ({gap}, c.entry)) AS entry, CAST(min({gap}) AS BIGINT) AS error FROM split v JOIN c{r} c USING (part) GROUP BY v.rid, v.part, v.x)"""
    mean = """m{r} AS (SELECT part, entry, pos, CAST(floor(CAST(sum(CAST(val AS BIGINT)) AS HUGEINT) / count(*)) AS DOUBLE) AS val
 FROM (SELECT part, entry, unnest(x) AS val, unnest(range(1, len(x) + 1)) AS pos FROM a{p}) GROUP BY part, entry, pos),
c{r} AS (SELECT c.part, c.entry, coalesce(list(m.val ORDER BY m.pos) FILTER (m.val IS NOT NULL), c.x) AS x FROM c{p} c LEFT JOIN m{r} m USING (part, entry) GROUP BY c.part, c.entry, c.x)"""
    steps = [near.format(r=0, gap=gap)]
    for r in range(1, rounds + 1):
        steps += [mean.format(r=r, p=r - 1), near.format(r=r, gap=gap)]
    return f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda v: floor(CAST(v AS DOUBLE) * {scale})) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
split AS (SELECT rid, part, x[CAST(part * (len(x) // {parts}) + 1 AS BIGINT):CAST((part + 1) * (len(x) // {parts}) AS BIGINT)] AS x FROM kept, range({parts}) p(part)),
c0 AS (SELECT part, CAST(rid - 1 AS INTEGER) AS entry, x FROM split WHERE rid <= {entries}),
{", ".join(steps)},
coded AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
book AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda v: CAST(v AS BIGINT)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT k.vec_id, d.code, d.error, CAST(sum(d.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, b.codebooks_sha256 FROM kept k JOIN coded d USING (rid), book b"""


ORACLE = oracle()
