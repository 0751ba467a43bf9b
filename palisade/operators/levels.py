"""A sample's level of damage: joint model of three channels with an artefact term, decay fit, two components over GC,
the choice among estimates, the blend, and the second pass weighted by the reads' own damage.

All fits work on a sample's counts (a few thousand rows), so nothing here grows with the reads but the two passes over them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from palisade.operators import sample_counts as SC
from palisade.operators.read_damage import damage_prior

# Fixed values of the joint model: positions, decays, levels, artefact terms, least trials of a position and inside.
POSITIONS, DECAYS, LEVELS, ARTEFACT, TRIALS, INSIDE = 15, np.linspace(0.05, 0.5, 10), np.linspace(0, 0.6, 101), 0.3, 100, 1000
# Probability of damage from which it stands, and under which an artefact explains the ends.
SURE, UNLIKELY = 0.95, 0.05
# Fixed values of the two components: spread of the undamaged and of the damaged one, least noise of a bin.
SPREAD_0, SPREAD_1, NOISE = 0.01, 0.10, 0.02
# Least estimate that counts, scale of the stops' log-likelihood ratio, pull of a lower estimate, centre and spread of GC.
COUNTS, SCALE, DOWNWARD, GC_CENTRE, GC_SPREAD = 0.01, 50_000.0, 0.3, 0.5, 0.15
# Fixed values of the second pass: least level, gap between estimates, least damage of a read.
PASS_LEVEL, GAP, LEAST_READ = 0.15, 0.05, 0.01


def _log_likelihood(k: np.ndarray, n: np.ndarray, p: np.ndarray, least: float = 1e-10) -> np.ndarray:
    p = np.clip(p, least, 1 - least)
    return (k * np.log(p) + (n - k) * np.log(1 - p)).sum(axis=-1)


def joint_model(k: dict[str, np.ndarray], n: dict[str, np.ndarray], base: dict[str, float]) -> dict:
    """Level, decay and artefact term that best explain T at the start (channel tc), A at the start as control (ag) and codons
    turned stops (stop), with counts k of n by position and shares base inside the reads.

    Damage raises tc and stop, an artefact moves tc and ag alike; for every level and decay of the grid the artefact is the
    maximum of a one-dimensional search over all grid points at once. The null model has an artefact at the chosen decay, but no
    damage; delta_bic is its BIC less the other's, p_damage the probability that goes with it. valid: enough trials."""
    out = {"valid": bool(min(n["tc"].min(), n["ag"].min()) >= TRIALS and base.get("inside", INSIDE) >= INSIDE), "d_max": 0.0, "rate": 0.2, "artefact": 0.0, "delta_bic": 0.0, "p_damage": 0.0}
    if not out["valid"]:
        return out
    decay = np.exp(-DECAYS[:, None] * np.arange(POSITIONS))[:, None]  # decays x 1 x positions
    damage = LEVELS[None, :, None] * decay

    def ends(artefact, damage, decay):
        tc, ag = (np.clip(base[c] + artefact[..., None] * decay, 0.01, 0.99) for c in ("tc", "ag"))
        return _log_likelihood(k["tc"], n["tc"], tc + (1 - tc) * damage) + _log_likelihood(k["ag"], n["ag"], ag)

    def best_artefact(damage, decay, shape):
        low, high, gold = np.full(shape, -ARTEFACT), np.full(shape, ARTEFACT), (np.sqrt(5) - 1) / 2
        for _ in range(40):
            a, b = high - gold * (high - low), low + gold * (high - low)
            left = ends(a, damage, decay) > ends(b, damage, decay)
            low, high = np.where(left, low, a), np.where(left, b, high)
        return (low + high) / 2

    stops = lambda damage: _log_likelihood(k["stop"], n["stop"], base["stop"] + (1 - base["stop"]) * damage, 1e-3)
    artefact = best_artefact(damage, decay, damage.shape[:2])
    ll = ends(artefact, damage, decay) + stops(damage)
    i, j = np.unravel_index(ll.argmax(), ll.shape)
    only = decay[i, 0]
    none = np.zeros(POSITIONS)
    null_artefact = best_artefact(none, only, ())
    null = float(ends(null_artefact, none, only) + stops(none))
    delta = float(2 * (ll[i, j] - null) - np.log(sum(n[c].sum() for c in ("tc", "ag", "stop"))))
    return out | {"d_max": float(LEVELS[j]), "rate": float(DECAYS[i]), "artefact": float(artefact[i, j]), "delta_bic": delta, "p_damage": float(1 / (1 + np.exp(-np.clip(delta / 2, -500, 500))))}


def two_components(levels: np.ndarray, sites: np.ndarray, rounds: int = 50) -> dict:
    """Damaged and undamaged bins of GC: share of sites in the damaged component and its mean level, by EM over normal
    components of fixed spread with each bin's own sampling noise; found: at least two bins. d_mean is the mean over all sites."""
    levels, sites = (np.asarray(x, float) for x in (levels, sites))
    keep = sites > 0
    levels, sites = levels[keep], sites[keep]
    out = {"found": len(levels) >= 2, "d_mean": 0.0, "d_damaged": 0.0, "share": 0.0, "separated": False}
    if not out["found"]:
        return out
    noise = np.maximum(NOISE, np.sqrt(np.clip(levels, 1e-3, 0.999) * (1 - np.clip(levels, 1e-3, 0.999)) / sites))
    density = lambda mean, spread: np.exp(-0.5 * (levels - mean) ** 2 / (spread ** 2 + noise ** 2)) / np.sqrt(spread ** 2 + noise ** 2)
    share, mean = 0.2, max(0.05, 0.8 * levels.max())
    for _ in range(rounds):
        a, b = share * density(mean, SPREAD_1), (1 - share) * density(0.0, SPREAD_0)
        own = sites * a / np.maximum(a + b, 1e-300)
        weight = own / (SPREAD_1 ** 2 + noise ** 2)
        new_share = float(np.clip(own.sum() / sites.sum(), 1e-3, 0.999))
        new_mean = float(np.clip((weight * levels).sum() / max(weight.sum(), 1e-300), 0, 1))
        settled = abs(new_share - share) + abs(new_mean - mean) < 1e-9
        share, mean = new_share, new_mean
        if settled:
            break
    return out | {"d_mean": float(np.average(levels, weights=sites)), "d_damaged": mean, "share": share, "separated": mean > 0.02}


def decay_fit(rates: np.ndarray, counts: np.ndarray) -> dict:
    """Level and decay of rates by position over their mean from position 10 on: weighted least squares, the level in closed
    form for each decay from 0.05 to 2 (a fine scan, then halved), its share of the variance, and the likelihood-ratio p-value
    against no decay. Under 100 observations nothing is fitted."""
    rates, counts = np.asarray(rates, float), np.asarray(counts, float)
    out = {"d_max": 0.0, "rate": 0.3, "baseline": 0.0, "r2": 0.0, "p_value": 1.0, "fitted": bool(counts.sum() >= 100)}
    if not out["fitted"]:
        return out
    x, w = np.arange(len(rates)), np.sqrt(counts)
    base = float(np.average(rates[10:], weights=counts[10:])) if counts[10:].sum() > 0 else 0.0
    gap = rates - base

    def level(rate):
        e = np.exp(-np.atleast_1d(rate)[:, None] * x)
        d = np.maximum((w * gap * e).sum(axis=1) / np.maximum((w * e * e).sum(axis=1), 1e-12), 0)
        return d, (w * (gap - d[:, None] * e) ** 2).sum(axis=1)

    grid, step = np.linspace(0.05, 2, 196), 0.01
    at = grid[level(grid)[1].argmin()]
    while step > 1e-9:
        near = np.clip(np.array([at - step, at, at + step]), 0.05, 2)
        at, step = near[level(near)[1].argmin()], step / 2
    d = float(level(at)[0][0])
    left = rates - base - d * np.exp(-at * x)
    mean = np.average(rates, weights=counts)
    total = (counts * (rates - mean) ** 2).sum()
    seen = counts >= 1
    var = np.maximum(1e-3, base * (1 - base) / np.maximum(counts, 1))
    ratio = max(0.0, float(((gap ** 2 - left ** 2) / var)[seen].sum()))
    return out | {"d_max": d, "rate": float(at), "baseline": base, "r2": float(1 - (counts * left ** 2).sum() / total) if total > 0 else 0.0, "p_value": float(np.exp(-ratio / 2))}


@dataclass
class Evidence:
    """What the choice of a level rests on; levels are estimates of the named channels, None where there is none."""

    validated: bool = False
    artefact: bool = False
    inverted_5: bool = False
    inverted_3: bool = False
    adapter: bool = False
    single_stranded: bool = False
    asymmetric: bool = False
    p_damage: float | None = None
    start: float = 0.0
    end: float = 0.0
    stops: float | None = None
    mixture: float | None = None
    strata: float | None = None
    joint: float = 0.0

    def pooled(self) -> float:
        """Of the estimates over strata the first there is: mixture, mean over GC, joint model."""
        if self.mixture is not None and self.mixture > COUNTS:
            return self.mixture
        return self.joint if self.strata is None else self.strata


def arbitrate(e: Evidence) -> tuple[float, str]:
    """Level and its source: the first rule of the table that holds. A sample that isn't validated and has an inverted end takes
    the other one, as far as the rule left the ends standing; with both inverted it has no level."""
    both, one = e.inverted_5 and e.inverted_3, e.inverted_5 != e.inverted_3
    unreliable = both or e.adapter
    top, low = max(e.start, e.end), min(e.start, e.end)
    table = [  # holds, level, source, whether the ends' own levels stand
        (e.artefact, 0.0, "none", False),
        (e.validated and unreliable and (e.stops or 0) > COUNTS, e.stops, "stops", True),
        (e.validated and one and e.inverted_3, e.start, "start", True),
        (e.validated and one, e.end, "end", True),
        (e.validated, e.pooled(), "average", True),
        (e.p_damage is not None and e.p_damage > 0.5, e.pooled(), "average", True),
        (e.p_damage is not None and e.single_stranded, top, "single strand", True),
        (e.p_damage is not None, 0.0, "none", False),
        (e.stops is not None, e.stops, "stops", True),
        (e.asymmetric and e.single_stranded, top, "single strand", True),
        (e.asymmetric, low, "lower end", True),
        (True, (e.start + e.end) / 2, "average", True),
    ]
    level, source, stand = next((lv, s, k) for holds, lv, s, k in table if holds)
    if not e.validated and both:
        return 0.0, "none"
    if not e.validated and one:
        return ((e.end, "end") if e.inverted_5 else (e.start, "start")) if stand else (0.0, "end" if e.inverted_5 else "start")
    return float(level), source


def state(validated: bool, artefact: bool, stops_valid: bool, stops_llr: float) -> tuple[str, float]:
    """Validation state and the factor that damage of single reads is weighed with."""
    if validated:
        return "validated", 1.0
    if artefact or (stops_valid and stops_llr < -100):
        return "contradicted", 0.0
    return "unvalidated", 0.5


def blend(level: float, stops: float | None, stops_llr: float, validated: bool, strata: list[dict]) -> tuple[float, float]:
    """The level drawn to the stops' estimate by the trust in it (a logistic of its log-likelihood ratio; less if it is lower),
    or half as far to the bins' mean by closeness to GC_CENTRE and root of their reads, where stops give none; and the share
    drawn. strata: level, reads, bin. Samples that aren't validated keep their level."""
    if not validated:
        return level, 0.0
    trust = 1 / (1 + np.exp(-stops_llr / SCALE))
    if stops is not None and stops > COUNTS:
        share = trust if stops > level else DOWNWARD * trust
        return float(np.clip(level + share * (stops - level), 0, 1)), float(share)
    use = [b for b in strata if b["reads"] >= 100]
    weight = [np.sqrt(b["reads"]) * np.exp(-0.5 * (((b["bin"] + 0.5) / 10 - GC_CENTRE) / GC_SPREAD) ** 2) for b in use]
    target = float(np.average([b["level"] for b in use], weights=weight)) if use else level
    return float(np.clip(level + 0.5 * trust * (target - level), 0, 1)), float(0.5 * trust)


def wants_second_pass(level: float, validated: bool, inverted: bool, adapter: bool, stops: float | None) -> bool:
    """Whether the counts should be taken again, weighted by the reads' damage: damage stands, and the ends mislead."""
    return bool(validated and level > PASS_LEVEL and (inverted or adapter or abs((stops or 0.0) - level) > GAP))


def second_pass(seqs: DataFrame, fit, first: dict) -> dict:
    """fit over counts of seqs (seq) in which a read weighs as much as it is likely to be damaged under the first fit; reads
    under LEAST_READ don't count. The counts are one aggregation; only they reach the driver."""
    from pyspark.sql import functions as F

    rate = (first["5p"]["rate"] + first["3p"]["rate"]) / 2
    w = seqs.select("seq").withColumn("__w", damage_prior("seq", first["level"], rate, first["5p"]["artefact"], first["3p"]["artefact"])).where(F.col("__w") > LEAST_READ)
    return fit(SC.counts(w, "__w"))


def estimate(seqs: DataFrame, fit) -> dict:
    """The sample's fit, with level, source and blended; from a second pass where one is wanted (passes is 2 then)."""
    first = fit(SC.counts(seqs))
    if not wants_second_pass(first["level"], first["state"] == "validated", first["inverted_5"] or first["inverted_3"], first["5p"]["artefact"], first["stops_level"]):
        return first | {"passes": 1}
    again = second_pass(seqs, fit, first)
    return first | {"passes": 2, "level_first": first["level"], "level": again["level"], "blended": again["level"]}
