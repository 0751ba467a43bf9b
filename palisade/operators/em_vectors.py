"""The iterating side of expectation-maximisation with weights as a vector.

References are numbered in their order. Alignments are dealt by read once and packed: a row of the cached table has some
ten thousand of them as flat arrays, read after read, so that an iteration is a few array operations a row, on arrays that
stay in a core's cache, and nothing is sorted, joined or shuffled by alignment again. Reads of a partition lie in the order
of their smallest reference, so that what a row looks up and adds to lies close together. An iteration sends the references' terms to the tasks and gets
back their sums of gamma in blocks of BLOCK references, dense or as pairs, whichever is smaller; where they are many, the
tasks' blocks are added up in tasks first. What reaches the driver is one number a reference.

Edge cases: a null reference has a weight and no alignments; null reads count as one read; a null score is no alignment,
unless it is its read's only one.
"""

from __future__ import annotations

import gc
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from palisade.session import cut, drop_cut

FLOOR = 1e-10
#: Alignments of a packed row, and of a partition.
ROW, PART = 30_000, 2_000_000
#: References of a block of sums; numbers from all tasks that the driver adds up itself; numbers shuffled until old shuffles are let go.
BLOCK, DIRECT, KEPT = 65_536, 8_000_000, 30_000_000
#: Bins of starts on a reference.
BINS = 8


def step_length(r2: float, v2: float, bound: float) -> float:
    return max(1.0, min(bound, math.sqrt(r2 / v2))) if v2 and r2 else 1.0


def _numbers(column) -> np.ndarray:
    return column.to_numpy().astype(np.float64)  # null: NaN


def _flat(value, kind) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _packing(keys, lens, coverage: bool, most: int):
    """One partition's alignments as rows (one, n, idx, base, first, bin, m): one tells reads with one alignment, first where
    reads begin, bin the bin of the start and m the places at which such an alignment can start."""

    def run(batches):
        t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if t is None:
            return
        idx = pc.index_in(t["ref_id"], keys.value.cast(t["ref_id"].type), skip_nulls=True)
        t = t.append_column("idx", idx).filter(pc.is_valid(idx))
        read = t["read_id"].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        idx = t["idx"].to_numpy().astype(np.int32)
        low = np.full(read.max(initial=-1) + 1, np.iinfo(np.int32).max, np.int32)
        np.minimum.at(low, read, idx)
        order = np.argsort(low[read].astype(np.int64) * len(low) + read, kind="stable")
        idx, base = idx[order], _numbers(t["base"])[order]
        alone = np.bincount(read)[read[order]] == 1
        more = {}
        if coverage:
            size, start, took = lens.value[idx], _numbers(t["tstart"])[order], _numbers(t["aln_len"])[order]
            at = np.nan_to_num(np.minimum(np.floor(start * BINS / size), BINS - 1), nan=BINS - 1)
            more = {"bin": np.maximum(at, -1).astype(np.int8), "m": np.fmax(size - took + 1, 1.0)}
        read = read[order]
        for one in (True, False):
            rows = np.flatnonzero(alone if one else ~alone & ~np.isnan(base))
            if not len(rows):
                continue
            new = np.r_[0, np.flatnonzero(np.diff(read[rows])) + 1]
            begin = 0
            for end in _ends(new, len(rows), most):
                part = rows[begin:end]
                first = (new[np.searchsorted(new, begin):np.searchsorted(new, end)] - begin).astype(np.int32)
                made = [idx[part], np.nan_to_num(base[part], nan=0.0) if one else base[part], first, *(more[c][part] for c in more)]
                yield pa.RecordBatch.from_arrays([pa.array([one]), pa.array([len(part)], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in made]], ["one", "n", "idx", "base", "first", *more])
                begin = end

    return run


def _ends(new: np.ndarray, n: int, most: int) -> list[int]:
    """Where packed rows end: at the first read that begins so many alignments or more after the last end."""
    out, at = [], 0
    while n - at > most and (k := np.searchsorted(new, at + most)) < len(new):
        at = int(new[k])
        out.append(at)
    return [*out, n]


def _softmax(score: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, float]:
    """Gammas of alignments, and the reads' summed log-likelihood."""
    n = np.diff(first, append=len(score))
    top = np.maximum.reduceat(score, first)
    e = np.exp(score - np.repeat(top, n))
    z = np.add.reduceat(e, first)
    return e / np.repeat(z, n), float(np.sum(top + np.log(z)))


def _blocks(total: np.ndarray, ll: float, size: int) -> pa.RecordBatch:
    """Rows (block, at, total, ll) of a vector: places and values, or no places and all values; blocks of zeros have none."""
    out, rest = [], ll
    for k in range(0, len(total), size):
        part = total[k:k + size]
        at = np.flatnonzero(part).astype(np.int32)
        if len(at) or k == 0:
            sparse = 3 * len(at) < 2 * len(part)
            out.append((k // size, at.tobytes() if sparse else None, (part[at] if sparse else part).tobytes(), rest))
            rest = 0.0
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.float64()))], ["block", "at", "total", "ll"])


def _add(total: np.ndarray, begin: int, at, values) -> None:
    v = _flat(values, np.float64)
    if at.is_valid:
        total[begin + _flat(at, np.int32)] += v
    else:
        total[begin:begin + len(v)] += v


def _summing(size: int):
    """Rows (block, at, total, ll) added up by block."""
    def run(batches):
        sums, ll = {}, 0.0
        for b in batches:
            ll += float(np.sum(b.column("ll").to_numpy()))
            for block, at, values in zip(b.column("block").to_pylist(), b.column("at"), b.column("total")):
                if block not in sums:
                    sums[block] = np.zeros(size)
                _add(sums[block], 0, at, values)
        for block, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([None], pa.binary()), pa.array([v.tobytes()], pa.binary()), pa.array([ll], pa.float64())], ["block", "at", "total", "ll"])
            ll = 0.0

    return run


def even(n_refs: int, idx: np.ndarray, g: np.ndarray, at: np.ndarray, m: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed gammas of references, and their weight by how well starts agree with uniform ones (coverage.adaptive_kl() and
    coverage_weight() of alignments); idx numbers references from 0, size has their lengths."""
    x, q = np.zeros((n_refs, BINS)), np.zeros((n_refs, BINS))
    inside = at >= 0
    np.add.at(x.reshape(-1), idx[inside].astype(np.int64) * BINS + at[inside], g[inside])
    for k in range(BINS):
        lo, hi = np.floor(k * size / BINS)[idx], np.floor((k + 1) * size / BINS)[idx]
        q[:, k] = np.bincount(idx, np.nan_to_num(g * np.maximum(np.fmin(hi, m) - lo, 0.0) / m), n_refs)
    sums, squares = np.bincount(idx, g, n_refs), np.bincount(idx, g * g, n_refs)
    seen = sums > 0
    n_eff = np.where(seen, sums ** 2 / np.where(seen, squares, 1.0), 0.0)
    b = np.where(n_eff <= 0, 6, np.where(n_eff < 8, 3, np.where(n_eff < 15, 6, 8)))
    kl = np.zeros(n_refs)
    for bins in (3, 6, 8):
        of = np.flatnonzero(b == bins)
        i, j = np.arange(BINS)[:, None], np.arange(bins)[None, :]
        part = np.maximum(np.minimum((i + 1) * bins, (j + 1) * BINS) - np.maximum(i * bins, j * BINS), 0) / bins
        p, u = x[of] @ part, q[of] @ part
        p = (p + 0.5 / bins) / (p.sum(1, keepdims=True) + 0.5)
        u = (u + 0.5 / bins) / (u.sum(1, keepdims=True) + 0.5)
        kl[of] = np.maximum((p * np.log(p / u)).sum(1), 0.0)
    gate = np.clip((n_eff - 8) / 12.0, 0.0, 1.0)
    weight = np.clip(np.exp(-0.1 * gate * np.maximum(2 * n_eff * kl - (b - 1), 0.0) / 2), 0.2, 1.0)
    return sums, np.where(seen, weight, 1.0)


class Vectors:
    """The iterating side of alignments (read_id, ref_id, base; tstart and aln_len for coverage); refs (ref_id, len) has all references."""

    def __init__(self, aln: DataFrame, refs: DataFrame, rows: int, alpha: float):
        self.spark, self.alpha = aln.sparkSession, alpha
        self.refs, self.schema = refs, refs.select("ref_id", "len").schema
        found = refs.select("ref_id", "len").toArrow().sort_by("ref_id").combine_chunks()
        self.table, self.size = found, found.num_rows
        self.coverage = "tstart" in aln.columns
        lens = _numbers(found["len"])
        self.half = 0.5 * np.log(np.fmax(lens, 1.0))
        context = self.spark.sparkContext
        self.lens = context.broadcast(lens)
        self.keys = context.broadcast(found["ref_id"].combine_chunks())
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 2, rows // PART)
        more = ", bin binary, m binary" if self.coverage else ""
        self.packed = aln.repartition(n, "read_id").mapInArrow(_packing(self.keys, self.lens, self.coverage, ROW), f"one boolean, n long, idx binary, base binary, first binary{more}").persist(StorageLevel.MEMORY_AND_DISK)
        cores = context.defaultParallelism
        self.tasks = min(n, cores * max(1, rows // (2 * PART * cores)))
        self.shuffled = 0
        size, block = self.size, BLOCK

        def run(batches):
            total, base = np.zeros(size), 0.0
            for batch in batches:
                for idx, b in zip(batch.column("idx"), batch.column("base")):
                    np.add.at(total, _flat(idx, np.int32), 1.0)
                    base += float(np.sum(_flat(b, np.float64)))
            yield _blocks(total, base, block)

        self.ones, self.ones_base = self._summed(self.packed.where("one").select("idx", "base"), run)

    def _summed(self, rows: DataFrame, run) -> tuple[np.ndarray, float]:
        """The sum of the vectors and numbers that run makes of the packed rows."""
        if not self.size:
            return np.zeros(0), 0.0
        kind = "block int, at binary, total binary, ll double"
        made = rows.coalesce(self.tasks).mapInArrow(run, kind)
        if self.tasks * self.size > DIRECT:
            made = made.repartition(min(self.tasks, -(-self.size // BLOCK)), "block").mapInArrow(_summing(BLOCK), kind)
            self._shuffles(self.tasks * self.size)
        total, ll = np.zeros(-(-self.size // BLOCK) * BLOCK), 0.0
        for b in made.toArrow().to_batches():
            ll += float(np.sum(b.column("ll").to_numpy()))
            for block, at, values in zip(b.column("block").to_pylist(), b.column("at"), b.column("total")):
                _add(total, block * BLOCK, at, values)
        return total[:self.size], ll

    def _shuffles(self, numbers: int) -> None:
        """Shuffles that nothing reads any more go when the driver's garbage is collected, which many small steps alone don't bring about."""
        self.shuffled += numbers
        if self.shuffled > KEPT:
            self.shuffled = 0
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()

    def uniform(self) -> np.ndarray:
        return np.full(self.size, 1.0 / max(1, self.size))

    def _prior(self, weights: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(weights, FLOOR)) - self.half

    def step(self, weights: np.ndarray) -> tuple[np.ndarray, float]:
        """The weights after one EM step, and the objective of the ones before."""
        prior, size, block = self._prior(weights), self.size, BLOCK
        side = self.spark.sparkContext.broadcast(prior)

        def run(batches):
            prior, total, ll = side.value, np.zeros(size), 0.0
            for b in batches:
                for idx, base, first in zip(b.column("idx"), b.column("base"), b.column("first")):
                    i = _flat(idx, np.int32)
                    gamma, more = _softmax(_flat(base, np.float64) + prior[i], _flat(first, np.int32))
                    np.add.at(total, i, gamma)
                    ll += more
            yield _blocks(total, ll, block)

        mass, ll = self._summed(self.packed.where("NOT one").select("idx", "base", "first"), run)
        side.destroy()
        objective = ll + float(self.ones @ prior) + self.ones_base
        if self.alpha != 1.0:
            objective += (self.alpha - 1) * float(np.sum(np.log(np.maximum(weights, FLOOR))))
        return _normalised(np.maximum(mass + self.ones + (self.alpha - 1), FLOOR)), objective

    def ahead(self, w0: np.ndarray, w1: np.ndarray, w2: np.ndarray, bound: float) -> tuple[np.ndarray, float, float]:
        """The weights extrapolated along two steps, the length of that, and how far the first step went."""
        d = w1 - w0
        v = w2 - w1 - d
        r2 = float(d @ d)
        length = step_length(r2, float(v @ v), bound)
        return _normalised(np.maximum(w0 + 2 * length * d + length ** 2 * v, FLOOR)), length, math.sqrt(r2)

    def blended(self, weights: np.ndarray, eta: float) -> np.ndarray:
        """Weights pulled towards references that their reads cover evenly."""
        sums, weight = np.zeros(self.size), np.ones(self.size)
        if self.size:
            side, lens = self.spark.sparkContext.broadcast(self._prior(weights)), self.lens

            def run(batches):
                prior = side.value
                for b in batches:
                    for one, idx, base, first, at, m in zip(*[b.column(c) for c in ("one", "idx", "base", "first", "bin", "m")]):
                        i = _flat(idx, np.int32)
                        g = np.ones(len(i)) if one.as_py() else _softmax(_flat(base, np.float64) + prior[i], _flat(first, np.int32))[0]
                        kept = np.flatnonzero(g >= 1e-6)
                        kept = kept[np.argsort(i[kept] // BLOCK, kind="stable")]
                        i, g, at, m = i[kept], g[kept], _flat(at, np.int8)[kept], _flat(m, np.float64)[kept]
                        cuts = np.searchsorted(i // BLOCK, np.arange(prior.size // BLOCK + 2))
                        for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
                            if z > a:
                                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *[pa.array([x[a:z].tobytes()], pa.binary()) for x in (i - k * BLOCK, g, at, m)]], ["block", "idx", "g", "bin", "m"])

            def weigh(batches):
                found = {}
                for b in batches:
                    for block, *x in zip(b.column("block").to_pylist(), *[b.column(c) for c in ("idx", "g", "bin", "m")]):
                        found.setdefault(block, []).append([_flat(v, t) for v, t in zip(x, (np.int32, np.float64, np.int8, np.float64))])
                for block, parts in found.items():
                    size = lens.value[block * BLOCK:(block + 1) * BLOCK]
                    got = even(len(size), *[np.concatenate(x) for x in zip(*parts)], size)
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in got]], ["block", "sums", "weight"])

            dealt = self.packed.mapInArrow(run, "block int, idx binary, g binary, bin binary, m binary").repartition(-(-self.size // BLOCK), "block")
            for block, *values in (r.values() for r in dealt.mapInArrow(weigh, "block int, sums binary, weight binary").toArrow().to_pylist()):
                at = slice(block * BLOCK, min((block + 1) * BLOCK, self.size))
                sums[at], weight[at] = (np.frombuffer(x, np.float64) for x in values)
            side.destroy()
            self._shuffles(KEPT)
        return _normalised(np.exp((1 - eta) * np.log(weights + 1e-300) + eta * np.log((sums + 1e-15) * weight + 1e-300)))

    def change(self, new: np.ndarray, old: np.ndarray) -> float:
        """The largest change of a weight, as a share of itself."""
        return float(np.max(np.abs(new - old) / np.maximum(old, 1e-15), initial=0.0))

    def frame(self, weights: np.ndarray) -> DataFrame:
        return cut(self.spark.createDataFrame(self.table.append_column("w", pa.array(weights)), self.schema.add("w", "double")), "em-w")

    def drop(self, weights: np.ndarray) -> None:
        pass

    def close(self) -> None:
        self.packed.unpersist()
        self.lens.destroy()
        self.keys.destroy()
        drop_cut(self.refs)


def _normalised(raw: np.ndarray) -> np.ndarray:
    return raw / (float(np.sum(raw)) or 1.0)
