"""Expectation-maximisation over multi-mapping reads.

score = log max(w, 1e-10) - log(len)/2 + scale * bits; gamma is its softmax within the read; new weights are
proportional to max(sum gamma + alpha - 1, 1e-10). The two states of a damaged alignment, ancient and modern, only add a
constant to its score (the log of their summed factors), so both models iterate alike and the states are told apart at
the end.

Reads with one alignment have gamma 1 whatever the weights: they are summed once and only the others iterate. Those are
dealt by read once and cached, on disk where memory is short. Up to BROADCAST_REFS references the weights are a vector that the
driver holds and sends to the tasks (em_vectors.py): an iteration reads packed alignments and takes the softmax where the
read lies; a vector comes back. Beyond, weights and alignments are shuffled together and every iteration's sums are written
to the shared folder, which ends the lineage there; only scalars reach the driver. Either way a lost executor costs no
earlier iteration.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.operators import coverage as C
from palisade.operators import em_vectors as V
from palisade.session import cut, drop_cut

FLOOR = V.FLOOR
#: References whose weights are a vector (16 MB); beyond, weights and alignments are shuffled together.
BROADCAST_REFS = 2_000_000


def _score(scale: float) -> Column:
    return F.log(F.greatest("w", F.lit(FLOOR))) - 0.5 * F.log(F.greatest("len", F.lit(1)).cast("double")) + F.lit(float(scale)) * F.col("bits")


def e_step(aln: DataFrame, weights: DataFrame, scale: float) -> DataFrame:
    """aln with score, gamma and the read's log-likelihood; softmax shifted by the read's maximum."""
    w = W.partitionBy("read_id")
    s = aln.join(weights, "ref_id").withColumn("score", _score(scale)).withColumn("top", F.max("score").over(w))
    s = s.withColumn("z", F.sum(F.exp(F.col("score") - F.col("top"))).over(w))
    return s.withColumn("gamma", F.exp(F.col("score") - F.col("top")) / F.col("z")).withColumn("ll", F.col("top") + F.log("z")).drop("top", "z")


def damage_terms(pi: float) -> tuple[Column, Column]:
    """Log-factors of the two states of an alignment with per-read damage probability p_read and likelihoods ll_a, ll_m."""
    p = F.least(F.greatest(F.col("p_read"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p) + F.col("ll_a"), F.log(1 - p) + F.col("ll_m")


def e_step_damage(aln: DataFrame, weights: DataFrame, scale: float) -> DataFrame:
    """Two states an alignment, ancient and modern: gamma, and gamma_ancient as its ancient part."""
    w = W.partitionBy("read_id")
    anc, mod = damage_terms(0.1)
    s = aln.join(weights, "ref_id").withColumn("score", _score(scale)).withColumn("sa", F.col("score") + anc).withColumn("sm", F.col("score") + mod)
    s = s.withColumn("top", F.max(F.greatest("sa", "sm")).over(w))
    s = s.withColumn("ea", F.exp(F.col("sa") - F.col("top"))).withColumn("em", F.exp(F.col("sm") - F.col("top")))
    s = s.withColumn("z", F.sum(F.col("ea") + F.col("em")).over(w))
    return s.withColumn("gamma", (F.col("ea") + F.col("em")) / F.col("z")).withColumn("gamma_ancient", F.col("ea") / F.col("z")).withColumn("ll", F.col("top") + F.log("z")).drop("sa", "sm", "top", "ea", "em", "z")


def m_step(gammas: DataFrame, weights: DataFrame, alpha: float = 1.0) -> DataFrame:
    mass = gammas.groupBy("ref_id").agg(F.sum("gamma").alias("g"))
    return _normalised(weights.select("ref_id", "len").join(mass, "ref_id", "left").withColumn("r", F.greatest(F.coalesce("g", F.lit(0.0)) + (alpha - 1), F.lit(FLOOR))))


def _normalised(raw: DataFrame) -> DataFrame:
    """(ref_id, len, w) from (ref_id, len, r), which is written once for its sum and its rows."""
    raw = cut(raw.select("ref_id", "len", "r"), "em-w")
    return raw.select("ref_id", "len", (F.col("r") / (raw.agg(F.sum("r")).first()[0] or 1.0)).alias("w"))


def base_score(scale: float, damage: bool) -> Column:
    """What of an alignment's score doesn't depend on the weights."""
    base = F.lit(float(scale)) * F.col("bits")
    if not damage:
        return base
    a, m = damage_terms(0.1)
    top = F.greatest(a, m)
    return base + top + F.log(F.exp(a - top) + F.exp(m - top))


class Shuffled:
    """The iterating side of an alignment table (read_id, ref_id, bits, tlen; with damage p_read, ll_a, ll_m; for coverage
    tstart, aln_len) with weights as tables (ref_id, len, w)."""

    def __init__(self, aln: DataFrame, refs: DataFrame, scale: float, alpha: float, damage: bool):
        self.aln, self.refs, self.scale, self.alpha = aln, refs, scale, alpha
        n = max(int(aln.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
        rows = aln.select("read_id", "ref_id", base_score(scale, damage).alias("base"))
        rows = cut(rows.withColumn("degree", F.count("*").over(W.partitionBy("read_id"))), "em-rows")
        self.single = cut(rows.where("degree = 1").groupBy("ref_id").agg(F.count("*").cast("double").alias("n1"), F.sum("base").alias("b1")), "em-single")
        self.multi = rows.where("degree > 1").select("read_id", "ref_id", "base").repartition(n, "read_id").sortWithinPartitions("read_id").persist(StorageLevel.MEMORY_AND_DISK)
        self.rows = rows

    def uniform(self) -> DataFrame:
        return cut(self.refs.select("ref_id", "len", F.lit(1.0 / max(1, self.refs.count())).alias("w")), "em-w")

    def step(self, weights: DataFrame) -> tuple[DataFrame, float]:
        """The weights after one EM step, and the objective of the ones before."""
        prior = weights.select("ref_id", "len", "w", (F.log(F.greatest("w", F.lit(FLOOR))) - 0.5 * F.log(F.greatest("len", F.lit(1)).cast("double"))).alias("prior"))
        side = prior.select("ref_id", "prior")
        w = W.partitionBy("read_id")
        e = self.multi.join(side, "ref_id").withColumn("score", F.col("base") + F.col("prior")).withColumn("top", F.max("score").over(w))
        e = e.withColumn("e", F.exp(F.col("score") - F.col("top"))).withColumn("z", F.sum("e").over(w))
        gamma = F.col("e") / F.col("z")
        mass = e.select("ref_id", gamma.alias("gamma"), (gamma * (F.col("top") + F.log("z"))).alias("ll"))  # gammas of a read sum to 1
        own = self.single.join(side, "ref_id").select("ref_id", F.col("n1").alias("gamma"), (F.col("n1") * F.col("prior") + F.col("b1")).alias("ll"))
        sums = mass.groupBy("ref_id").agg(F.sum("gamma").alias("gamma"), F.sum("ll").alias("ll")).unionByName(own).groupBy("ref_id").agg(F.sum("gamma").alias("g"), F.sum("ll").alias("ll"))
        raw = weights.select("ref_id", "len").join(sums, "ref_id", "left").select("ref_id", "len", "ll", F.greatest(F.coalesce("g", F.lit(0.0)) + (self.alpha - 1), F.lit(FLOOR)).alias("r"))
        raw = cut(raw, "em-w")
        total, ll = raw.agg(F.sum("r"), F.sum("ll")).first()
        objective = ll or 0.0
        if self.alpha != 1.0:
            objective += (self.alpha - 1) * weights.agg(F.sum(F.log(F.greatest("w", F.lit(FLOOR))))).first()[0]
        return raw.select("ref_id", "len", (F.col("r") / (total or 1.0)).alias("w")), objective

    def ahead(self, w0: DataFrame, w1: DataFrame, w2: DataFrame, bound: float) -> tuple[DataFrame, float, float]:
        """The weights extrapolated along two steps, the length of that, and how far the first step went."""
        j = w0.select("ref_id", "len", F.col("w").alias("w0")).join(w1.select("ref_id", F.col("w").alias("w1")), "ref_id").join(w2.select("ref_id", F.col("w").alias("w2")), "ref_id")
        j = j.withColumn("d", F.col("w1") - F.col("w0")).withColumn("v", F.col("w2") - F.col("w1") - F.col("d"))
        r2, v2 = j.agg(F.sum(F.col("d") ** 2), F.sum(F.col("v") ** 2)).first()
        length = V.step_length(r2 or 0.0, v2 or 0.0, bound)
        return _normalised(j.withColumn("r", F.greatest(F.col("w0") + 2 * length * F.col("d") + length ** 2 * F.col("v"), F.lit(FLOOR)))), length, math.sqrt(r2 or 0.0)

    def blended(self, weights: DataFrame, eta: float) -> DataFrame:
        """Weights pulled towards references that their reads cover evenly."""
        g = e_step(self.aln.select("read_id", "ref_id", "bits", "tstart", "aln_len", "tlen"), weights, self.scale).select("ref_id", "tstart", "aln_len", F.col("len").alias("tlen"), F.col("gamma").alias("g"))
        stats = C.adaptive_kl(g)
        weight = stats.select("ref_id", "sum_g").join(C.coverage_weight(stats, b=F.col("b")), "ref_id")
        reads = (F.coalesce("sum_g", F.lit(0.0)) + 1e-15) * F.coalesce("coverage_weight", F.lit(1.0))
        blend = F.exp((1 - eta) * F.log(F.col("w") + 1e-300) + eta * F.log(reads + 1e-300))
        return _normalised(weights.join(weight, "ref_id", "left").withColumn("r", blend))

    def change(self, new: DataFrame, old: DataFrame) -> float:
        """The largest change of a weight, as a share of itself."""
        return new.join(old.select("ref_id", F.col("w").alias("old")), "ref_id").agg(F.max(F.abs(F.col("w") - F.col("old")) / F.greatest("old", F.lit(1e-15)))).first()[0] or 0.0

    def frame(self, weights: DataFrame) -> DataFrame:
        return weights

    def drop(self, weights: DataFrame) -> None:
        drop_cut(weights)

    def close(self) -> None:
        self.multi.unpersist()
        drop_cut(self.rows)
        drop_cut(self.single)
        drop_cut(self.refs)


def problem_of(aln: DataFrame, scale: float, alpha: float = 1.0, damage: bool = False, coverage: bool = False) -> Shuffled | V.Vectors:
    """The iterating side of aln that fits its number of references."""
    refs = cut(aln.groupBy("ref_id").agg(F.max("tlen").alias("len"), F.count("*").alias("n")), "em-refs")
    n, rows = refs.agg(F.count("*"), F.sum("n")).first()
    if n > BROADCAST_REFS:
        return Shuffled(aln, refs, scale, alpha, damage)
    extra = ["tstart", "aln_len"] if coverage else []
    return V.Vectors(aln.select("read_id", "ref_id", base_score(scale, damage).cast("double").alias("base"), *extra), refs, rows or 0, alpha)


def plain_em(aln: DataFrame, iterations: int, scale: float, damage: bool = False, alpha: float = 1.0) -> DataFrame:
    """Weights after a fixed number of iterations."""
    problem = problem_of(aln, scale, alpha, damage)
    weights = problem.uniform()
    for _ in range(iterations):
        before = weights
        weights, _ = problem.step(before)
        problem.drop(before)
    out = problem.frame(weights)
    problem.close()
    return out


def squarem(aln: DataFrame, scale: float, alpha: float = 1.0, tol: float = 1e-4, max_iter: int = 100, warm_up: int = 4, strict: bool = False, damage: bool = False) -> tuple[DataFrame, list[float]]:
    """Accelerated EM. Returns the weights and the objective after each accepted step.

    Ends by tolerance, or after max_iter EM steps; with strict, the latter raises."""
    problem = problem_of(aln, scale, alpha, damage)
    weights, trace, settled = accelerated(problem, problem.uniform(), tol, max_iter, warm_up)
    if strict and not settled:
        raise RuntimeError(f"em did not converge in {max_iter} steps")
    out = problem.frame(weights)
    problem.close()
    return out, trace


def accelerated(problem: Shuffled | V.Vectors, start, tol: float = 1e-4, max_iter: int = 100, warm_up: int = 4) -> tuple:
    """Weights from start on, the objective after each accepted step, and whether the tolerance ended it; start is kept.

    After plain warm-up steps each cycle takes two EM steps, extrapolates along them (step length from the ratio of
    the squared differences, clamped to an adaptive bound), applies an EM step to stabilise, and falls back to the
    plain steps where the objective would drop.
    """
    weights = start
    trace: list[float] = []
    bound, it = 1.0, 0

    def replace(new, *others) -> None:
        nonlocal weights
        for old in (*([weights] if weights is not start else []), *others):
            problem.drop(old)
        weights = new

    while it < max_iter:
        w1, obj0 = problem.step(weights)
        it += 1
        trace.append(obj0)
        if it <= warm_up:
            replace(w1)
            continue
        w2, obj1 = problem.step(w1)
        it += 1
        ahead, length, moved = problem.ahead(weights, w1, w2, bound)
        w3, obj_ahead = problem.step(ahead)
        it += 1
        if obj_ahead >= obj1 - 1e-9:
            obj = obj_ahead
            replace(w3, w1, w2, ahead)
            if length >= bound:
                bound *= 4
        else:
            obj = obj1
            replace(w2, w1, w3, ahead)
            bound = max(1.0, bound / 4)
        if it >= 8 and abs(obj - obj0) <= tol * max(1.0, abs(obj0)) * 1e-3 and moved <= math.sqrt(tol):
            trace.append(obj)
            return weights, trace, True
    return weights, trace, False


def coverage_em(aln: DataFrame, scale: float, rounds: int = 5, eta: float = 0.5, tol: float = 0.01, inner: int | None = None, refit: bool = True) -> tuple[DataFrame, int]:
    """EM whose weights are pulled towards references that reads cover evenly; aln has tstart and aln_len too.

    Each round fits the EM from the last round's weights (inner steps, or until it settles), weighs every reference's
    reads by how well their starts agree with uniform ones, and blends: log w = (1 - eta) log w + eta log(reads * weight).
    Ends when no weight changes by more than tol of itself. Returns weights (after a last fit, with refit) and rounds."""
    problem, done = problem_of(aln, scale, coverage=True), 0
    start = problem.uniform()

    def fit(begin):
        if inner is None:
            return accelerated(problem, begin, max_iter=200)[0]
        w = begin
        for _ in range(inner):
            w = problem.step(w)[0]
        return w

    for done in range(1, rounds + 1):
        new = problem.blended(fit(start), eta)
        moved = problem.change(new, start)
        start = new
        if done > 1 and moved <= tol:
            break
    out = problem.frame(fit(start) if refit else start)
    problem.close()
    return out, done


def assignments(gammas: DataFrame) -> DataFrame:
    """Per alignment: whether it is the read's most likely (first by ref_id), the margin to the next and the effective number of references."""
    w = W.partitionBy("read_id")
    order = w.orderBy(F.desc("gamma"), "ref_id", *[c for c in ("sk", "ln", "aln_len", "bits") if c in gammas.columns])
    g = gammas.withColumn("rn", F.row_number().over(order)).withColumn("next", F.lead("gamma").over(order))
    best = g.withColumn("neff", 1.0 / F.sum(F.col("gamma") * F.col("gamma")).over(w)).where("rn = 1")
    return best.withColumn("em_margin", F.col("gamma") - F.coalesce("next", F.lit(0.0))).withColumnRenamed("neff", "em_ref_neff").drop("rn", "next")
