"""Sample-level damage profile: mergeable counts by Spark, small model fits on the counts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSITIONS = 15


def terminal_counts(seqs: DataFrame, positions: int = POSITIONS) -> DataFrame:
    """(channel, pos, base, n): bases at the first (5p) and last (3p) positions, in one pass over the sequences' ends."""
    ends = F.array(F.struct(F.lit("5p").alias("channel"), F.substring("seq", 1, positions).alias("s")), F.struct(F.lit("3p").alias("channel"), F.reverse(F.expr(f"right(seq, {positions})")).alias("s")))
    rows = seqs.select(F.explode(ends).alias("e"))
    flat = rows.select("e.channel", F.posexplode(F.filter(F.split("e.s", ""), lambda c: c != "")).alias("pos", "base"))
    return flat.groupBy("channel", "pos", "base").agg(F.count("*").alias("n"))


def interior_counts(seqs: DataFrame) -> DataFrame:
    """(base, n) over the middle third of every sequence."""
    third = F.floor(F.length("seq") / 3).cast("int")
    mid = F.substr("seq", third + 1, F.floor(F.length("seq") * 2 / 3).cast("int") - third)
    count = lambda b: F.sum(F.length(mid) - F.length(F.replace(mid, F.lit(b), F.lit("")))).cast("long")
    one = seqs.agg(*[count(b).alias(b) for b in "ACGT"])
    return one.select(F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.col(b).alias("n")) for b in "ACGT"])).alias("r")).select("r.*")


def position_ratios(counts: DataFrame, key: list[str]) -> DataFrame:
    """Wide rows key + pos with tc = T/(T+C) and ag = A/(A+G), one half where nothing was seen."""
    s = counts.groupBy(*key, "pos").agg(*[F.sum(F.when(F.col("base") == b, F.col("n")).otherwise(0)).alias(b.lower()) for b in "ACGT"])
    ratio = lambda x, y: F.when(F.col(x) + F.col(y) > 0, F.col(x) / (F.col(x) + F.col(y))).otherwise(0.5)
    return s.withColumn("tc", ratio("t", "c")).withColumn("ag", ratio("a", "g"))


def fit_decay(rates: np.ndarray, weights: np.ndarray, baseline: float) -> tuple[float, float]:
    """Amplitude and rate of an exponential decay of rates above a baseline over positions, by weighted least squares on logs."""
    x = np.arange(len(rates), dtype=float)
    excess = np.asarray(rates, float) - baseline
    ok = (excess > 1e-6) & (x >= 1) & (x <= 9)
    if ok.sum() < 2:
        return max(0.0, float(excess[0]) if len(excess) else 0.0), 0.3
    w, y, x = np.asarray(weights, float)[ok], np.log(excess[ok]), x[ok]
    mx, my = np.average(x, weights=w), np.average(y, weights=w)
    slope = np.sum(w * (x - mx) * (y - my)) / max(np.sum(w * (x - mx) ** 2), 1e-12)
    rate = float(np.clip(-slope, 0.05, 0.5))
    return float(np.exp(my + rate * mx)), rate


def decay_llr(k: np.ndarray, n: np.ndarray, baseline: float, amplitude: float, rate: float) -> float:
    """Log-likelihood ratio of the decay against a constant rate over positions; negative if the decay is upside down."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    x = np.arange(len(k))
    ll = lambda p: float(np.sum(k * np.log(np.clip(p, 1e-9, 1 - 1e-9)) + (n - k) * np.log(1 - np.clip(p, 1e-9, 1 - 1e-9))))
    flat = np.full(len(k), k.sum() / max(n.sum(), 1))
    out = ll(baseline + amplitude * np.exp(-rate * x)) - ll(flat)
    return out if amplitude >= 0 else -abs(out)


def two_proportion(k1: float, n1: float, k2: float, n2: float) -> tuple[float, float]:
    """Shift of two proportions and its pooled z."""
    if n1 <= 0 or n2 <= 0:
        return 0.0, 0.0
    p = (k1 + k2) / (n1 + n2)
    se = math.sqrt(max(p * (1 - p) * (1 / n1 + 1 / n2), 1e-12))
    return k1 / n1 - k2 / n2, (k1 / n1 - k2 / n2) / se


def joint_fit(k: np.ndarray, n: np.ndarray, baseline: float) -> dict[str, float]:
    """Grid fit of (level, rate) of a terminal decay against no damage: BIC difference and probability of damage."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    x = np.arange(len(k))
    rates, levels = np.linspace(0.05, 0.5, 10), np.linspace(0, 1, 101)
    p = baseline + (1 - baseline) * levels[None, :, None] * np.exp(-rates[:, None, None] * x)
    p = np.clip(p, 1e-9, 1 - 1e-9)
    ll = (k * np.log(p) + (n - k) * np.log(1 - p)).sum(axis=2)
    i, j = np.unravel_index(ll.argmax(), ll.shape)
    null = ll[0, 0]
    delta = 2 * (ll[i, j] - null) - 2 * math.log(max(n.sum(), 2))
    return {"d_max": float(levels[j]), "rate": float(rates[i]), "llr": float(ll[i, j] - null), "delta_bic": float(delta), "p_damage": float(1 / (1 + math.exp(-max(-50.0, min(50.0, delta / 2)))))}


def sample_profile(seqs: DataFrame) -> dict:
    """Both ends' counts, baselines and fits of a sample; a few hundred counts reach the driver."""
    out: dict = {}
    rows = terminal_counts(seqs).collect()  # two ends x positions x bases
    mid = {r["base"]: r["n"] for r in interior_counts(seqs).collect()}
    for channel, up, other in (("5p", "T", "C"), ("3p", "A", "G")):
        c = {(r["pos"], r["base"]): r["n"] for r in rows if r["channel"] == channel}
        k = np.array([c.get((i, up), 0) for i in range(POSITIONS)], float)
        n = k + np.array([c.get((i, other), 0) for i in range(POSITIONS)], float)
        base = mid.get(up, 0) / max(1, mid.get(up, 0) + mid.get(other, 0))
        rate = np.divide(k, n, out=np.full(POSITIONS, base), where=n > 0)
        amp, lam = fit_decay(rate, n, base)
        shift, z = two_proportion(k[0], n[0], mid.get(up, 0), mid.get(up, 0) + mid.get(other, 0))
        out[channel] = {"rates": rate.tolist(), "baseline": base, "amplitude": amp, "rate": lam, "llr": decay_llr(k, n, base, amp, lam), "shift": shift, "z": z} | {f"joint_{a}": b for a, b in joint_fit(k, n, base).items()}
    out["d_max"] = max(0.0, min(1.0, (out["5p"]["joint_d_max"] + out["3p"]["joint_d_max"]) / 2))
    return out
