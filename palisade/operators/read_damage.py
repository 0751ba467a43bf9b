"""Damage of single reads under a sample's parameters.

Near its start a read has T where C was damaged, near its end A where G was. At a site whose bases are T or C (A or G) the
chance of the former is base + reach * level: base is its share inside the reads, reach what damage of a read of level 1 would
add at that distance. A read's level is the maximum of its likelihood, or of that and a Beta prior around the sample's
level; both are concave, so the maximum is where the slope changes sign, found by halving for a whole batch at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bases from an end, weight of the sample's level in bases, least length, weight of the sample's level for reads that tell nothing.
WINDOW, CONCENTRATION, LEAST, UNTOLD = 20, 20.0, 60, 0.2
# Fixed values of the percentage: bases from an end and least length, least level of a GC bin.
PERCENT_WINDOW, LEAST_LEVEL = 15, 0.005
# Fixed values of the plain signal: log-odds of T (or of C) at the first three places and of A (or G) at the last three, and of both ends.
SIGNAL_T, SIGNAL_C, SIGNAL_A, SIGNAL_G, SIGNAL_BOTH = (0.8, 0.35, 0.15), -0.3, (0.7, 0.3, 0.12), -0.25, 0.4
_DIGIT = np.full(256, 4, np.int8)
_DIGIT[np.frombuffer(b"ACGTacgt", np.uint8)] = [0, 1, 2, 3, 0, 1, 2, 3]
A_, C_, G_, T_ = range(4)


def _codes(seqs: list[str]) -> list[np.ndarray]:
    return [_DIGIT[np.frombuffer((s or "").encode("latin-1", "replace"), np.uint8)] for s in seqs]


def _ends(codes: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last bases of reads, from the end inwards; 4 beyond a read."""
    out = np.full((2, len(codes), window), 4, np.int8)
    for i, c in enumerate(codes):
        n = min(window, len(c))
        out[0, i, :n], out[1, i, :n] = c[:n], c[::-1][:n]
    return out[0], out[1]


def most_likely(hit: np.ndarray, base: np.ndarray, reach: np.ndarray, pull: tuple[float, float] = (0.0, 0.0), halvings: int = 50) -> np.ndarray:
    """The level of each row (in 0 to 1) that maximises the likelihood of its sites: hit or not, with chance base + reach * level,
    times level ** pull[0] * (1 - level) ** pull[1]. Sites without reach don't count."""
    low, high = np.zeros(len(hit)), np.ones(len(hit))
    for _ in range(halvings):
        level = (low + high) / 2
        chance = base + reach * level[:, None]
        slope = np.where(hit, reach / np.maximum(chance, 1e-12), -reach / np.maximum(1 - chance, 1e-12)).sum(axis=1)
        up = slope + pull[0] / level - pull[1] / (1 - level) > 0
        low, high = np.where(up, level, low), np.where(up, high, level)
    return (low + high) / 2


def _inside(codes: list[np.ndarray], window: int) -> np.ndarray:
    """Counts of A, C, G, T further than window from both ends, each with half a count more."""
    return np.stack([np.bincount(c[window:len(c) - window], minlength=5)[:4] for c in codes]) + 0.5


def _share(counts: np.ndarray, up: int, low: int) -> np.ndarray:
    return np.clip(counts[:, up] / (counts[:, up] + counts[:, low]), 0.01, 0.99)[:, None]


def prior(seqs: list[str], d_max: float, rate: float, skip_5: bool = False, skip_3: bool = False) -> np.ndarray:
    """Per read of LEAST bases or more: the chance that any of its sites is damaged, given the level its sites make likeliest
    under the sample's; drawn to a fifth of the sample's level as far as sites are lacking. A skipped first (last) place, an
    adapter's, moves the decay by one. Shorter reads, and samples without damage, have 0."""
    out = np.zeros(len(seqs))
    at = np.array([i for i, s in enumerate(seqs) if len(s or "") >= LEAST], int)
    if d_max < 0.01 or not len(at):
        return out
    codes = _codes([seqs[i] for i in at])
    inside, sites = _inside(codes, WINDOW), []
    for end, up, low, skip in zip(_ends(codes, WINDOW), (T_, A_), (C_, G_), (skip_5, skip_3)):
        base = np.broadcast_to(_share(inside, up, low), end.shape)
        live = ((end == up) | (end == low)) & (np.arange(WINDOW) >= skip)
        sites.append((end == up, base, np.where(live, (1 - base) * np.exp(-rate * np.maximum(np.arange(WINDOW) - skip, 0)), 0.0)))
    hit, base, reach = (np.concatenate(x, axis=1) for x in zip(*sites))
    a, b = d_max * CONCENTRATION, (1 - d_max) * CONCENTRATION
    more = float(min(a, b) <= 1)  # a prior without a mode gets one
    level = most_likely(hit, base, reach, (a + more - 1, b + more - 1))
    told = reach.sum(axis=1)
    any_ = 1 - np.prod(1 - np.minimum(level[:, None] * reach, 0.999999), axis=1)
    out[at] = (told * any_ + UNTOLD * d_max) / (told + 1)
    return out


def percentage(seqs: list[str], level: float, rates: tuple[float, float], shares: tuple[float, float], bins: dict[int, tuple[float, float]] | None = None, contradicted: bool = False) -> np.ndarray:
    """Per read of PERCENT_WINDOW bases or more: its level of damage in percent, that is the share of the sample's level that
    its sites make likeliest, times that level. shares: of T in T and C, of A in A and G, inside the reads. bins: level and
    share of T of tenths of GC that have their own; 0 where such a level is under LEAST_LEVEL, for contradicted samples, and
    for reads without a site."""
    out = np.zeros(len(seqs))
    at = np.array([i for i, s in enumerate(seqs) if len(s or "") >= PERCENT_WINDOW], int)
    if contradicted or not len(at):
        return out
    codes = _codes([seqs[i] for i in at])
    tenth = [_gc_tenth(c) for c in codes]
    own = np.array([(bins or {}).get(g, (level, shares[0])) for g in tenth])
    none = np.array([g in (bins or {}) for g in tenth]) & (own[:, 0] < LEAST_LEVEL)
    sites = []
    for end, up, low, share, rate in zip(_ends(codes, PERCENT_WINDOW), (T_, A_), (C_, G_), (own[:, 1], np.full(len(at), shares[1])), rates):
        base = np.broadcast_to(np.clip(share, 0.01, 0.99)[:, None], end.shape)
        reach = np.minimum(own[:, :1] * np.exp(-rate * np.arange(PERCENT_WINDOW)), 0.999) * (1 - base)
        sites.append((end == up, base, np.where((end == up) | (end == low), reach, 0.0)))
    hit, base, reach = (np.concatenate(x, axis=1) for x in zip(*sites))
    share = most_likely(hit, base, reach)
    out[at] = np.where(none | (reach.sum(axis=1) == 0), 0.0, 100 * np.clip(share * own[:, 0], 0, 1))
    return out


def _gc_tenth(code: np.ndarray) -> int:
    """Tenth of GC of a read, five bases from either end left out (as the sample's counts have it)."""
    inner = code[5:len(code) - 5]
    known = int((inner < 4).sum())
    return min(int(((inner == C_) | (inner == G_)).sum()) * 10 // known, 9) if known else 0


def terminal_sum(seqs: list[str], d_max: float, rates: tuple[float, float], factor: float = 1.0) -> np.ndarray:
    """Per read of 30 bases or more: the logistic of the expected number of damaged bases among its T within WINDOW of the start
    and its A within WINDOW of the end (each by its share inside the read, without one by the chance of damage alone in
    reads under 2 * WINDOW + 10 bases, which count whole), times the sample's factor; 0 for others and without damage."""
    out = np.zeros(len(seqs))
    for i, c in enumerate(_codes(list(seqs)) if d_max >= LEAST_LEVEL else ()):
        n = len(c)
        if n < 30:
            continue
        short = n < 2 * WINDOW + 10
        reach = n if short else WINDOW
        inside = None if short else _inside([c], WINDOW)[0]
        total = 0.0
        for end, up, low, rate in ((c, T_, C_, rates[0]), (c[::-1], A_, G_, rates[1])):
            p = d_max * np.exp(-rate * np.flatnonzero(end[:reach] == up))
            total += p.sum() if short else (inside[low] * p / (inside[low] * p + inside[up] * (1 - p))).sum()
        out[i] = factor / (1 + np.exp(-total))
    return out


def _column(fn):
    @F.pandas_udf(T.DoubleType())
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(fn(["" if x is None else x for x in s]), dtype=float)

    return run


def damage_prior(seq: str | Column, d_max: float, rate: float, skip_5: bool = False, skip_3: bool = False) -> Column:
    """Column of prior(); null sequences give 0."""
    return _column(lambda s: prior(s, d_max, rate, skip_5, skip_3))(F.col(seq) if isinstance(seq, str) else seq)


def damage_percentage(seq: str | Column, level: float, rates: tuple[float, float], shares: tuple[float, float], bins: dict[int, tuple[float, float]] | None = None, contradicted: bool = False) -> Column:
    """Column of percentage(); null sequences give 0."""
    return _column(lambda s: percentage(s, level, rates, shares, bins, contradicted))(F.col(seq) if isinstance(seq, str) else seq)


def damage_terminal(seq: str | Column, d_max: float, rates: tuple[float, float], factor: float = 1.0) -> Column:
    """Column of terminal_sum(); null sequences give 0."""
    return _column(lambda s: terminal_sum(s, d_max, rates, factor))(F.col(seq) if isinstance(seq, str) else seq)


def damage_signal(seq: str | Column) -> Column:
    """Signal of damage without a sample, from the three outer bases of either end: 0.05 to 0.95, 0.5 under ten bases, null for null."""
    s = F.upper(F.col(seq) if isinstance(seq, str) else seq)
    head = lambda i: F.substr(s, F.lit(i + 1), F.lit(1))
    tail = lambda i: F.substr(s, F.length(s) - i, F.lit(1))
    terms = [F.when(head(0) == "C", SIGNAL_C).otherwise(0.0), F.when(tail(0) == "G", SIGNAL_G).otherwise(0.0), F.when((head(0) == "T") & (tail(0) == "A"), SIGNAL_BOTH).otherwise(0.0)]
    terms += [F.when(head(i) == "T", w).otherwise(0.0) for i, w in enumerate(SIGNAL_T)] + [F.when(tail(i) == "A", w).otherwise(0.0) for i, w in enumerate(SIGNAL_A)]
    return F.when(F.length(s) < 10, 0.5).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(0.95), 1 / (1 + F.exp(-sum(terms[1:], terms[0]))))))


def stop_damage(codon: Column, start: Column, length: Column, d_max: float, rate: float) -> Column:
    """Probability that a stop codon at a place of a read came of damage: its T was a C near the start, or one of its A a G
    near the end (TGA from TGG, TAG from TGG)."""
    at = lambda x: d_max * F.exp(-rate * x.cast("double"))
    by_start = at(start)
    by_end = at(length - 1 - (start + 2))
    return F.when(codon == "TGA", F.greatest(by_start, by_end)).when(codon.isin("TAA", "TAG"), by_start).otherwise(0.0)
