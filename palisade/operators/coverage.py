"""Coverage of references and its summaries; alignments are (ref_id, tstart from 0, aln_len, tlen, g).

Depth comes from boundary events and a running sum, never from one row a covered position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def span(aln: DataFrame) -> DataFrame:
    """Adds the clipped interval [lo, hi) on the reference."""
    lo = F.least(F.greatest("tstart", F.lit(0)), "tlen")
    return aln.withColumn("lo", lo).withColumn("hi", F.least(F.col("tstart") + F.col("aln_len"), F.col("tlen")))


def depth_segments(aln: DataFrame) -> DataFrame:
    """(ref_id, tlen, start, stop, depth): maximal segments of constant depth above zero."""
    s = span(aln).where("hi > lo")
    events = s.select("ref_id", "tlen", F.explode(F.array(F.struct(F.col("lo").alias("pos"), F.col("g").alias("d")), F.struct(F.col("hi").alias("pos"), (-F.col("g")).alias("d")))).alias("e"))
    sums = events.groupBy("ref_id", F.col("e.pos").alias("pos")).agg(F.max("tlen").alias("tlen"), F.sum("e.d").alias("d"), F.sum(F.when(F.col("e.d") > 0, 1).otherwise(-1)).alias("k"))
    w = W.partitionBy("ref_id").orderBy("pos")
    run = sums.withColumn("depth", F.sum("d").over(w)).withColumn("open", F.sum("k").over(w)).withColumn("stop", F.lead("pos").over(w))
    return run.where("open > 0").select("ref_id", "tlen", F.col("pos").alias("start"), "stop", "depth")


def depth_stats(aln: DataFrame) -> DataFrame:
    """ref_id, breadth, depth_mean, depth_std (population, zeros included) and depth_evenness (their ratio)."""
    n = F.col("stop") - F.col("start")
    s = depth_segments(aln).groupBy("ref_id").agg(F.max("tlen").alias("tlen"), F.sum(n).alias("cov"), F.sum(n * F.col("depth")).alias("d1"), F.sum(n * F.col("depth") ** 2).alias("d2"))
    mean = F.col("d1") / F.col("tlen")
    std = F.sqrt(F.greatest(F.col("d2") / F.col("tlen") - mean * mean, F.lit(0.0)))
    return s.select("ref_id", (F.col("cov") / F.col("tlen")).alias("breadth"), mean.alias("depth_mean"), std.alias("depth_std"), F.when(mean > 0, std / mean).otherwise(0.0).alias("depth_evenness"))


def positional_stats(aln: DataFrame) -> DataFrame:
    """ref_id, n_reads, n_unique_starts, start_diversity, start_span and positional_score (their geometric mean)."""
    s = aln.groupBy("ref_id").agg(F.count("*").alias("n_reads"), F.max("tlen").alias("tlen"), F.countDistinct("tstart").alias("n_unique_starts"), F.min("tstart").alias("a"), F.max("tstart").alias("b"))
    div = F.col("n_unique_starts") / F.least("n_reads", "tlen")
    rng = (F.col("b") - F.col("a") + 1) / F.col("tlen")
    return s.select("ref_id", "n_reads", "n_unique_starts", div.alias("start_diversity"), rng.alias("start_span"), F.sqrt(div * rng).alias("positional_score"))


def edge(length: Column) -> Column:
    return F.least(F.greatest(F.floor(length / 10), F.lit(1)), F.floor(length / 2))


def _overlap(lo: Column, hi: Column, a: Column, b: Column) -> Column:
    return F.greatest(F.least(hi, b) - F.greatest(lo, a), F.lit(0))


def expected_ratio(pairs: DataFrame) -> DataFrame:
    """(tl, rl, expected) for distinct pairs of reference and read length: terminal over middle coverage of uniform starts."""
    p = F.sequence(F.lit(0), F.col("tl") - 1)
    cover = F.transform(p, lambda x: F.greatest(F.least(x, F.col("tl") - F.col("rl")) - F.greatest(x - F.col("rl") + 1, F.lit(0)) + 1, F.lit(0)).cast("double"))
    e = edge(F.col("tl")).cast("int")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    left = total(F.slice(F.col("c"), F.lit(1), F.col("e")))
    right = total(F.slice(F.col("c"), F.col("tl") - F.col("e") + 1, F.col("e")))
    mid_n = F.col("tl") - 2 * F.col("e")
    mid = F.when(mid_n > 0, total(F.slice(F.col("c"), F.col("e") + 1, F.greatest(mid_n, F.lit(1)))) / mid_n).otherwise(0.0)
    rows = pairs.select("tl", "rl").distinct().where("tl >= 4 and rl > 0").withColumn("c", cover).withColumn("e", e)
    return rows.select("tl", "rl", F.when(mid > 0, (left + right) / (2 * F.col("e")) / mid).otherwise(F.lit(1.0)).alias("expected"))


def terminal_ratio(aln: DataFrame) -> DataFrame:
    """ref_id and terminal_middle_ratio by interval overlaps: min of the edges' mean depth over the middle's, divided by the expected ratio."""
    e = edge(F.col("tlen"))
    s = span(aln).withColumn("e", e)
    left = _overlap(F.col("lo"), F.col("hi"), F.lit(0), F.col("e")) * F.col("g")
    right = _overlap(F.col("lo"), F.col("hi"), F.col("tlen") - F.col("e"), F.col("tlen")) * F.col("g")
    mid = _overlap(F.col("lo"), F.col("hi"), F.col("e"), F.col("tlen") - F.col("e")) * F.col("g")
    got = s.groupBy("ref_id").agg(F.max("tlen").alias("tl"), F.max("e").alias("e"), F.count("*").alias("n"), F.sum(F.col("g") * F.col("aln_len")).alias("glen"), F.sum(left).alias("left_mass"), F.sum(right).alias("right_mass"), F.sum(mid).alias("m"))
    got = got.withColumn("rl", F.least(F.floor(F.col("glen") / F.col("n")), F.col("tl")))
    got = got.join(expected_ratio(got), ["tl", "rl"], "left").withColumn("expected", F.coalesce("expected", F.lit(1.0)))
    mid_n = F.col("tl") - 2 * F.col("e")
    low = F.least("left_mass", "right_mass") / F.col("e")
    mean = F.when(mid_n > 0, F.col("m") / mid_n).otherwise(0.0)
    ratio = F.when((F.col("tl") <= 0) | (F.col("e") <= 0), 0.0).when(mean > 0, low / mean).when(low > 0, F.lit(float("inf"))).otherwise(0.0)
    return got.select("ref_id", F.when(F.col("expected") > 0.01, ratio / F.col("expected")).otherwise(ratio).alias("terminal_middle_ratio"))


def bins(aln: DataFrame, b: int = 8) -> DataFrame:
    """Long form (ref_id, bin, x, q): observed starts and the expected mass of uniform starts, gamma-weighted; gammas under 1e-6 don't count."""
    a = aln.where("g >= 1e-6")
    k = F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    m = F.greatest(F.col("tlen") - F.col("aln_len") + 1, F.lit(1))
    start_bin = F.least(F.floor(F.col("tstart") * b / F.col("tlen")), F.lit(b - 1))
    rows = a.withColumn("m", m).withColumn("sb", start_bin).withColumn("bin", k)
    lo, hi = F.floor(F.col("bin") * F.col("tlen") / b), F.floor((F.col("bin") + 1) * F.col("tlen") / b)
    q = F.col("g") * F.greatest(F.least(hi, F.col("m")) - lo, F.lit(0)) / F.col("m")
    return rows.groupBy("ref_id", "bin").agg(F.sum(F.when(F.col("sb") == F.col("bin"), F.col("g")).otherwise(0.0)).alias("x"), F.sum(q).alias("q"))


def kl(aln: DataFrame, b: int = 8) -> DataFrame:
    """ref_id, n_eff, kl and deviance of start positions against uniform starts, with half-count smoothing."""
    z = bins(aln, b)
    w = W.partitionBy("ref_id")
    s = 0.5 / b
    z = z.withColumn("p", (F.col("x") + s) / (F.sum("x").over(w) + 0.5)).withColumn("u", (F.col("q") + s) / (F.sum("q").over(w) + 0.5))
    d = z.groupBy("ref_id").agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("u"))).alias("kl"))
    n = aln.where("g >= 1e-6").groupBy("ref_id").agg((F.sum("g") ** 2 / F.sum(F.col("g") ** 2)).alias("n_eff"))
    return d.join(n, "ref_id").select("ref_id", "n_eff", F.greatest("kl", F.lit(0.0)).alias("kl"), (2 * F.col("n_eff") * F.greatest("kl", F.lit(0.0))).alias("deviance"))


def adaptive_kl(aln: DataFrame) -> DataFrame:
    """ref_id, sum_g, n_eff, b, kl and deviance over as many bins as the effective reads bear: 3 under 8, 6 under 15, else 8.

    Starts are counted in eight bins once; fewer bins take their shares by overlap."""
    n = aln.where("g >= 1e-6").groupBy("ref_id").agg(F.sum("g").alias("sum_g"), (F.sum("g") ** 2 / F.sum(F.col("g") ** 2)).alias("n_eff"))
    n = n.withColumn("b", F.when(F.col("n_eff") <= 0, 6).when(F.col("n_eff") < 8, 3).when(F.col("n_eff") < 15, 6).otherwise(8))
    z = bins(aln, 8).join(n, "ref_id").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    part = F.greatest(F.least((F.col("bin") + 1) * F.col("b"), (F.col("j") + 1) * 8) - F.greatest(F.col("bin") * F.col("b"), F.col("j") * 8), F.lit(0)) / F.col("b")
    r = z.groupBy("ref_id", "sum_g", "n_eff", "b", "j").agg(F.sum(F.col("x") * part).alias("x"), F.sum(F.col("q") * part).alias("q"))
    w = W.partitionBy("ref_id")
    r = r.withColumn("p", (F.col("x") + 0.5 / F.col("b")) / (F.sum("x").over(w) + 0.5)).withColumn("u", (F.col("q") + 0.5 / F.col("b")) / (F.sum("q").over(w) + 0.5))
    d = r.groupBy("ref_id", "sum_g", "n_eff", "b").agg(F.greatest(F.sum(F.col("p") * F.log(F.col("p") / F.col("u"))), F.lit(0.0)).alias("kl"))
    return d.withColumn("deviance", 2 * F.col("n_eff") * F.col("kl"))


def coverage_weight(stats: DataFrame, tau: float = 0.1, low: float = 0.2, b: int | Column = 8) -> DataFrame:
    """ref_id, coverage_weight: exp(-tau * gate * excess deviance / 2), the gate rising from 0 at 8 to 1 at 20 effective reads, clamped to [low, 1]."""
    gate = F.least(F.greatest((F.col("n_eff") - 8) / 12.0, F.lit(0.0)), F.lit(1.0))
    w = F.exp(-tau * gate * F.greatest(F.col("deviance") - (b - 1), F.lit(0.0)) / 2)
    return stats.select("ref_id", F.least(F.greatest(w, F.lit(low)), F.lit(1.0)).alias("coverage_weight"))


def completeness(binned: DataFrame, n_eff: DataFrame, b: int = 8) -> DataFrame:
    """ref_id, completeness: f of f*b*(1 - exp(-n/f/b)) = occupied bins, by ten Newton steps."""
    occ = binned.groupBy("ref_id").agg(F.sum(F.when(F.col("x") >= 0.5, 1).otherwise(0)).cast("double").alias("k")).join(n_eff.select("ref_id", "n_eff"), "ref_id")
    n, k = F.col("n_eff"), F.col("k")

    def newton(f: Column, _: Column) -> Column:
        e = F.exp(-n / (f * b))
        g = f * b * (1 - e) - k
        dg = b * (1 - e) - n / f * e
        return F.least(F.greatest(f - F.when(F.abs(dg) > 1e-9, g / dg).otherwise(0.0), F.lit(1e-3)), F.lit(1.0))

    f = F.aggregate(F.sequence(F.lit(1), F.lit(10)), (k / b).cast("double"), newton)
    return occ.select("ref_id", F.when((k == 0) | (n < 1), 0.0).when(k == b, 1.0).otherwise(f).alias("completeness"))


def reference_stats(aln: DataFrame, pi: float = 0.10) -> DataFrame:
    """Statistics of a reference that count covered positions only: aln (ref_id, tstart, aln_len, tlen, g, fident, anc, mod).

    breadth, mean, spread and evenness (1 - spread / mean) of depth over covered positions, starts, the two ends' mean depth
    over the middle's, mean identity, and the log2 odds of ancient to modern mass beyond the prior's."""
    d = depth_segments(aln)
    n = F.col("stop") - F.col("start")
    s = d.groupBy("ref_id").agg(F.sum(n).alias("cov"), F.sum(n * F.col("depth")).alias("d1"), F.sum(n * F.col("depth") ** 2).alias("d2"))
    size = F.least(F.greatest(F.floor(F.col("tlen") / 10), F.lit(2)), F.floor(F.col("tlen") / 3))
    a = span(aln).withColumn("e", size)
    mass = lambda x, y: F.sum(_overlap(F.col("lo"), F.col("hi"), x, y) * F.col("g"))
    b = a.groupBy("ref_id").agg(
        F.count("*").alias("n_reads"), F.max("tlen").alias("tlen"), F.max("e").alias("e"), F.countDistinct("tstart").alias("starts"), (F.max("tstart") - F.min("tstart") + 1).alias("reach"), F.avg("fident").alias("avg_identity"),
        F.avg("aln_len").alias("avg_alignment_length"), F.sum("anc").alias("n_ancient"), F.sum("mod").alias("n_modern"), (mass(F.lit(0), F.col("e")) + mass(F.col("tlen") - F.col("e"), F.col("tlen"))).alias("ends"), mass(F.col("e"), F.col("tlen") - F.col("e")).alias("middle"))
    r = b.join(s, "ref_id", "left").fillna({"cov": 0, "d1": 0.0, "d2": 0.0})
    covered = F.col("cov") > 0
    mean = F.when(covered, F.col("d1") / F.col("cov")).otherwise(0.0)
    std = F.when(covered, F.sqrt(F.greatest(F.col("d2") / F.col("cov") - (F.col("d1") / F.col("cov")) ** 2, F.lit(0.0)))).otherwise(0.0)
    mid_n = F.col("tlen") - 2 * F.col("e")
    ratio = F.when(F.col("tlen") >= 6, (F.col("ends") / (2 * F.col("e")) + 0.01) / (F.when(mid_n > 0, F.col("middle") / mid_n).otherwise(0.0) + 0.01)).otherwise(1.0)
    div, reach = F.col("starts") / F.least("n_reads", "tlen"), F.col("reach") / F.col("tlen")
    odds = F.when((F.col("n_ancient") > 0) & (F.col("n_modern") > 0), F.log2(F.col("n_ancient") / F.col("n_modern")) - F.log2(F.lit(pi / (1 - pi)))).otherwise(0.0)
    return r.select("ref_id", "n_reads", (F.col("cov") / F.col("tlen")).alias("breadth"), mean.alias("depth_mean"), std.alias("depth_std"), F.when(mean > 0, 1 - std / mean).otherwise(0.0).alias("depth_evenness"), "avg_identity", "avg_alignment_length",
                    F.sqrt(div * reach).alias("positional_score"), ratio.alias("terminal_ratio"), odds.alias("damage_enrichment"))


def passes(min_reads: int = 3, min_breadth: float = 0.10, min_depth: float = 0.5, min_identity: float = 0.5, min_enrichment: float = 0.0, min_positional: float = 0.0, min_terminal: float = 0.0) -> Column:
    """Whether a row of reference_stats meets all seven thresholds."""
    return ((F.col("n_reads") >= min_reads) & (F.col("breadth") >= min_breadth) & (F.col("depth_mean") >= min_depth) & (F.col("avg_identity") >= min_identity)
            & (F.col("damage_enrichment") >= min_enrichment) & (F.col("positional_score") >= min_positional) & (F.col("terminal_ratio") >= min_terminal))
