"""Damage annotation of alignments from their aligned strings, and the decomposed Bayesian score.

An alignment is annotated from its own row, so nothing is shuffled: the aligned columns of an Arrow batch lie in flat
arrays, classes and hazards come from lookup tables, and sums are taken by row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palisade.functions.sequence import CODONS
from palisade.functions.stats import clamp, inv_logit, logit

# Residue substitutions that damage can cause (target, query, class, 1 for high confidence).
SUBSTITUTIONS = [
    ("R", "W", "C", 1), ("R", "C", "C", 1), ("R", "*", "C", 1), ("Q", "*", "C", 1), ("H", "Y", "C", 1), ("P", "S", "C", 0), ("P", "L", "C", 0), ("T", "I", "C", 0),
    ("T", "M", "C", 0), ("A", "V", "C", 0), ("S", "F", "C", 0), ("S", "L", "C", 0), ("Q", "X", "C", 1), ("R", "X", "C", 1),
    ("E", "K", "G", 1), ("D", "N", "G", 1), ("A", "T", "G", 0), ("G", "R", "G", 0), ("G", "S", "G", 0), ("V", "I", "G", 0), ("V", "M", "G", 0), ("R", "K", "G", 1),
    ("R", "Q", "G", 1), ("R", "H", "G", 1), ("G", "E", "G", 1), ("G", "D", "G", 1), ("S", "N", "G", 0), ("C", "Y", "G", 0), ("W", "*", "G", 0), ("W", "X", "G", 1),
]
BACKGROUND = 0.005


def _classes(kind: str) -> list[str]:
    return sorted({t for t, _, c, _ in SUBSTITUTIONS if c == kind})


_GAP = ord("-")
_HIT = np.zeros((256, 256), np.uint8)  # target, query: 1 for class C, 2 for class G
_HIGH = np.zeros((256, 256), bool)
for _t, _q, _c, _h in SUBSTITUTIONS:
    _HIT[ord(_t), ord(_q)], _HIGH[ord(_t), ord(_q)] = 1 + (_c == "G"), bool(_h)
_OPP = {c: np.isin(np.arange(256), [ord(x) for x in _classes(c)]) for c in "CG"}


class Columns:
    """The aligned columns of both residues of a batch of alignments, in flat arrays: row, q and t (residues), qpos and
    tpos (from 0), distances d5 and d3 in nucleotides, class of the hit (0: none), opportunity hazards of both classes."""

    def __init__(self, batch: pa.RecordBatch, rate: float):
        get = lambda c: np.nan_to_num(batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)).astype(np.int64)
        pairs = [((q or "").encode("latin-1", "replace"), (t or "").encode("latin-1", "replace")) for q, t in zip(batch.column("qaln").to_pylist(), batch.column("taln").to_pylist())]
        n = np.array([min(len(q), len(t)) for q, t in pairs], np.int64)
        self.q_all, self.t_all = (np.frombuffer(b"".join(p[k][:m] for p, m in zip(pairs, n)), np.uint8) for k in (0, 1))
        self.rows, self.row_all = len(pairs), np.repeat(np.arange(len(pairs)), n)
        self.start = np.cumsum(n) - n
        self.qstart, self.tstart, qlen = get("qstart"), get("tstart"), get("qlen")
        back = batch.column("reverse").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        qpos, tpos = (self._before(x != _GAP) + s[self.row_all] - 1 for x, s in ((self.q_all, self.qstart), (self.t_all, self.tstart)))
        self.at = np.flatnonzero((self.q_all != _GAP) & (self.t_all != _GAP))
        self.row, self.q, self.t, self.qpos, self.tpos = (x[self.at] for x in (self.row_all, self.q_all, self.t_all, qpos, tpos))
        five, length = 3 * self.qpos, qlen[self.row]
        three = np.where(self.qpos < length, 3 * (length - 1 - self.qpos), 0)
        turned = back[self.row]
        self.d5, self.d3 = np.where(turned, three, five), np.where(turned, five, three)
        self.hit, self.high = _HIT[self.t, self.q], _HIGH[self.t, self.q]
        self.e5, self.e3 = np.exp(-rate * self.d5), np.exp(-rate * self.d3)
        self.decay = np.maximum(np.where(_OPP["C"][self.t], self.e5, 0.0), np.where(_OPP["G"][self.t], self.e3, 0.0))
        self.opp = _OPP["C"][self.t] | _OPP["G"][self.t]
        self.dist = np.where(self.hit == 2, self.d3, self.d5)
        self.level = np.where(self.hit == 1, self.e5, np.where(self.hit == 2, self.e3, 0.0))

    def _before(self, present: np.ndarray) -> np.ndarray:
        """How many of the row's columns before each one are present."""
        upto = np.cumsum(present)
        ahead = upto - present
        return ahead - (ahead[self.start.clip(max=max(len(ahead) - 1, 0))][self.row_all] if len(ahead) else 0)

    def sums(self, values: np.ndarray | None, where: np.ndarray | None = None) -> np.ndarray:
        """By alignment, of all its aligned columns or of those picked out."""
        row = self.row if where is None else self.row[where]
        return np.bincount(row, None if values is None else values if where is None else values[where], minlength=self.rows)


#: Per alignment: counts, hazards, damage probability, evidence of both states, and statistics of the strings.
SUMMARY = ("aligned long, mismatches long, m long, k long, high_conf long, ct_sites long, ga_sites long, terminal_5 long, terminal_3 long, sum_decay double, sum_log double, "
           "max_p_damage double, damage_fraction double, p_damaged double, ll_a double, ll_m double, gap_opens long, qend long, tend long, end_mismatches long, end_hits long")


def _added(aln: DataFrame, ddl: str, make: Callable[[pa.RecordBatch], list], drop: tuple[str, ...] = ()) -> DataFrame:
    """aln's columns but those dropped or clashing, then the added ones, made batch by batch."""
    new = T._parse_datatype_string(ddl)
    keep = [f for f in aln.schema.fields if f.name not in new.names and f.name not in drop]
    out = T.StructType([*keep, *new.fields])
    arrow, names = to_arrow_schema(out), [f.name for f in keep]

    def run(batches):
        for b in batches:
            made = make(b)
            yield pa.RecordBatch.from_arrays([b.column(n).cast(arrow.field(k).type) for k, n in enumerate(names)] + [pa.array(c, arrow.field(len(names) + k).type) for k, c in enumerate(made)], schema=arrow)

    return aln.mapInArrow(run, out)


def annotate(aln: DataFrame, d_max: float, rate: float, max_dist: int | None = None) -> DataFrame:
    """aln (qaln, taln, qstart and tstart from 1, qlen, reverse, and more) with the columns of SUMMARY.

    Sites farther from their end than max_dist are no sites any more; mismatches, opportunities and evidence stay, and
    p_damaged without any site is 0 instead of one half. Null strings have no columns; null numbers count as 0.
    """

    def make(batch):
        c = Columns(batch, rate)
        site = (c.hit > 0) & (True if max_dist is None else c.dist <= max_dist)
        p = d_max * c.level
        k, mismatches = c.sums(None, site), c.sums(None, c.q != c.t)
        llr = c.sums(np.clip(np.log(np.maximum(p, 0.01) / 0.01), -3, 5), site)
        top = np.zeros(c.rows)
        np.maximum.at(top, c.row[site], p[site])
        keep = lambda x: np.clip(x, 1e-8, 1 - 1e-8)
        ll_a = np.where(c.hit > 0, np.log(keep(p + BACKGROUND)), np.log(keep(1 - (d_max * c.decay + BACKGROUND))))
        ll_m = np.where(c.hit > 0, np.log(BACKGROUND), np.log(1 - BACKGROUND))
        gaps = []
        for x in (c.q_all, c.t_all):
            g = x == _GAP
            first = np.ones(len(g), bool)
            first[1:] = ~g[:-1] | (c.row_all[1:] != c.row_all[:-1])
            gaps.append(np.bincount(c.row_all[g & first], minlength=c.rows))
        ends = [s - 1 + np.bincount(c.row_all[x != _GAP], minlength=c.rows) for x, s in ((c.q_all, c.qstart), (c.t_all, c.tstart))]
        return [c.sums(None), mismatches, c.sums(None, c.opp), k, c.sums(None, site & c.high), c.sums(None, site & (c.hit == 1)), c.sums(None, site & (c.hit == 2)),
                c.sums(None, site & (c.hit == 1) & (c.d5 < 9)), c.sums(None, site & (c.hit == 2) & (c.d3 < 9)), c.sums(c.decay, c.opp), c.sums(np.log((p + BACKGROUND) / BACKGROUND), site), top,
                np.where(mismatches > 0, k / np.maximum(mismatches, 1), 0.0), np.where(k > 0, 1 / (1 + np.exp(-np.clip(llr, -10, 10))), 0.5 if max_dist is None else 0.0),
                c.sums(ll_a, c.opp), c.sums(ll_m, c.opp), gaps[0] + gaps[1], *ends, *[c.sums(None, near & what) for near in (np.minimum(c.d5, c.d3) <= 9,) for what in (c.q != c.t, (c.q != c.t) & (c.hit > 0))]]

    return _added(aln, SUMMARY, make)


def site_rows(aln: DataFrame, d_max: float, rate: float, max_dist: int | None = None) -> DataFrame:
    """A row a site: the key columns of aln, query_pos and target_pos (from 0), residues, class, confidence, distances and p_damage."""
    fields = "query_pos long, target_pos long, target_aa string, query_aa string, damage_class string, high boolean, dist_5prime long, dist_3prime long, p_damage double"
    names = T._parse_datatype_string(fields).names

    def make(batch):
        c = Columns(batch, rate)
        site = np.flatnonzero((c.hit > 0) & (True if max_dist is None else c.dist <= max_dist))
        cols = [c.qpos[site], c.tpos[site], [chr(x) for x in c.t[site]], [chr(x) for x in c.q[site]], [" CG"[x] for x in c.hit[site]], c.high[site], c.d5[site], c.d3[site], d_max * c.level[site]]
        made: list[list] = [[] for _ in range(c.rows)]
        for row, *values in zip(c.row[site].tolist(), *[x.tolist() if isinstance(x, np.ndarray) else x for x in cols]):
            made[row].append(dict(zip(names, values)))
        return [made]

    got = _added(aln, f"sites array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>", make, ("qaln", "taln", "qstart", "tstart", "qlen", "reverse"))
    return got.select(*[c for c in got.columns if c != "sites"], F.explode("sites").alias("s")).select("*", "s.*").drop("s")


def corrected(aln: DataFrame) -> DataFrame:
    """aln with corrected: the query's residues, those of damage sites replaced by the target's."""

    def make(batch):
        c = Columns(batch, 0.0)
        fixed = c.q_all.copy()
        site = c.at[c.hit > 0]
        fixed[site] = c.t_all[site]
        ends = np.append(c.start[1:], len(fixed))
        return [[fixed[a:b][fixed[a:b] != _GAP].tobytes().decode("latin-1") for a, b in zip(c.start.tolist(), ends.tolist())]]

    return _added(aln, "corrected string", make)


def bayesian(rows: DataFrame, d_max: float, pi: float = 0.1, w0: float = 0.3, min_opp: int = 1, cap: float = 3.0, detectability: float = 1.0, channel_b: bool = True, identity: bool = True) -> DataFrame:
    """Adds log_bf_terminal, log_bf_sites, log_bf_identity, posterior, tier and damage_class of rows with p_read, m, k, sum_decay, sum_log, fident."""
    terminal = F.when(F.col("p_read") > 0.01, (logit("p_read") - logit(F.lit(0.10))) * detectability).otherwise(0.0)
    rate = 0.30 * d_max
    w = F.when(F.col("m") > 0, F.col("sum_decay") / F.col("m")).otherwise(0.12)
    above = rate > BACKGROUND
    q = rate * w + BACKGROUND if above else F.lit(BACKGROUND)
    s = F.col("k") * F.log(q / BACKGROUND) if above else F.when(F.col("k") > 0, F.col("sum_log")).otherwise(0.0)
    if channel_b and w0 > 0:
        s = s + F.when((F.col("m") > F.col("k")) & (q > BACKGROUND), w0 * (F.col("m") - F.col("k")) * F.log((1 - q) / (1 - BACKGROUND))).otherwise(0.0)
    s = F.when(F.col("m") >= min_opp, clamp(s, -cap, cap)).otherwise(0.0)
    i: Column = clamp(20 * (F.col("fident") - 0.90), -5, 5) if identity else F.lit(0.0)
    out = rows.withColumn("log_bf_terminal", terminal).withColumn("log_bf_sites", s).withColumn("log_bf_identity", i)
    out = out.withColumn("posterior", inv_logit(logit(F.lit(pi)) + F.col("log_bf_terminal") + F.col("log_bf_sites") + F.col("log_bf_identity")))
    tier = F.when((F.col("p_read") >= 0.5) & (F.col("k") > 0), "convergent").when(F.col("p_read") >= 0.5, "terminal").when(F.col("k") > 0, "sites").otherwise("none")
    return out.withColumn("tier", tier).withColumn("damage_call", F.when(F.col("posterior") >= 0.60, "ancient").when(F.col("posterior") <= 0.25, "modern").otherwise("uncertain"))


def detectability(d_max: float, artefact: bool, valid_b: bool, validated: bool, shift: float, llr: float) -> float:
    """Whether damage can be told at all in a sample, from 0 to 1."""
    if d_max <= 0 or artefact:
        return 0.0
    if not valid_b:
        return min(0.5, 3 * d_max)
    if not validated:
        return 0.0
    return max(0.5, (min(1.0, 5 * abs(shift)) + min(1.0, max(0.0, llr / 1e4)) + min(1.0, 5 * d_max)) / 3)


def estimate_d_max(annotated: DataFrame) -> DataFrame:
    """One row, d_max: twice what the damage-like share of mismatches within nine nucleotides of an end has over the rest's, at most one half."""
    t = annotated.agg(F.sum("end_mismatches").alias("em"), F.sum("end_hits").alias("eh"), F.sum("mismatches").alias("m"), F.sum("k").alias("k"))
    share = lambda k, n: F.when(n > 0, k / n).otherwise(0.0)
    return t.select(F.least(F.lit(0.5), 2 * F.greatest(share(F.col("eh"), F.col("em")) - share(F.col("k") - F.col("eh"), F.col("m") - F.col("em")), F.lit(0.0))).alias("d_max"))


def settings_from(annotated: DataFrame, default_prior: float = 0.1) -> DataFrame:
    """One row of what the data settle: the prior (mean p_read within 0.05 and 0.80, with 50 reads or more), whether both ends
    bear damage (end sites of 3' over 5' beyond 0.3), and the EM's damage term: `alignment` with any likelihood ratio,
    `read` if p_read differs within a read, else `none`."""
    per = annotated.groupBy("read_id").agg(F.max("p_read").alias("hi"), F.min("p_read").alias("lo"), F.sum("p_read").alias("p"), F.count("*").alias("n"), F.sum("terminal_5").alias("t5"), F.sum("terminal_3").alias("t3"), F.max(F.abs(F.col("ll_a") - F.col("ll_m"))).alias("llr"))
    one = per.agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("t5").alias("t5"), F.sum("t3").alias("t3"), F.max("llr").alias("llr"), F.max(F.col("hi") - F.col("lo")).alias("spread"))
    prior = F.when(F.col("n") >= 50, clamp(F.col("p") / F.col("n"), 0.05, 0.80)).otherwise(default_prior)
    both = F.when(F.col("t5") > 0, F.col("t3") / F.col("t5") > 0.3).otherwise(False)
    return one.select(prior.alias("prior"), both.cast("int").alias("both_ends"), F.when(F.col("llr") > 0, "alignment").when(F.col("spread") > 1e-6, "read").otherwise("none").alias("mode"))


def classify(informative: bool | Column, ancient: float = 0.60, modern: float = 0.25) -> Column:
    """Class of a row with posterior, fident, z_bpa and delta_bits: by the posterior where damage tells something, else likely
    if the alignment is good, well above its length bin and clear of the runner-up."""
    by = F.when(F.col("posterior") >= ancient, "ancient_confident").when(F.col("posterior") <= modern, "modern_confident").otherwise("undetermined")
    good = (F.col("fident") >= 0.90) & (F.col("z_bpa") >= 0.5) & (F.col("delta_bits") >= 5.0)
    return F.when(F.lit(informative) if isinstance(informative, bool) else informative, by).when(good, "ancient_likely").otherwise("undetermined")


def silent_codons(base: str, was: str, place: int) -> tuple[list[str], list[str]]:
    """Codons with base at a place whose residue stays, and changes, if it was another base."""
    back = {c: CODONS[c[:place] + was + c[place + 1:]] == CODONS[c] for c in CODONS if c[place] == base}
    return [c for c, same in back.items() if same], [c for c, same in back.items() if not same]


def silent_damage(seq: str, d_max: float, rate: float, codons: int = 5, least: float = 0.05) -> list[Column]:
    """Counts over the first and last whole codons of frame 0 of T (that may have been C) and A (that may have been G) where
    damage is likelier than least: silent_5, changing_5, silent_3, changing_3."""
    s, n = F.col(seq), F.floor(F.length(seq) / 3).cast("int")
    totals: dict[str, Column] = {}
    for end, base, was in (("5", "T", "C"), ("3", "A", "G")):
        for i in range(codons):
            codon = F.when(n > i, F.substr(s, (F.lit(i) if end == "5" else n - 1 - i) * 3 + 1, F.lit(3)))
            for place in range(3):
                if d_max * math.exp(-rate * (3 * i + (place if end == "5" else 2 - place))) < least:
                    continue
                for name, those in zip(("silent", "changing"), silent_codons(base, was, place)):
                    key = f"{name}_{end}"
                    totals[key] = totals.get(key, F.lit(0)) + F.coalesce(codon.isin(those).cast("long"), F.lit(0)) if those else totals.get(key, F.lit(0))
    return [totals.get(k, F.lit(0)).cast("long").alias(k) for k in ("silent_5", "changing_5", "silent_3", "changing_3")]


def index_records(seqs: DataFrame, d_max: float, rate: float, codons: int = 5) -> DataFrame:
    """A damage index of seqs (id, seq): p_damaged, and the first and last whole codons of frame 0 (from the end)."""
    from palisade.operators.read_damage import damage_prior

    n = F.floor(F.length("seq") / 3).cast("int")
    pick = lambda at: F.array_compact(F.array(*[F.when(n > i, F.substr("seq", at(i) * 3 + 1, F.lit(3))) for i in range(codons)]))
    return seqs.select("id", damage_prior("seq", d_max, rate).alias("p_damaged"), pick(lambda i: F.lit(i)).alias("codons_5"), pick(lambda i: n - 1 - i).alias("codons_3"))


def refit_d_max(gamma_k: Column, gamma_decay: Column) -> Column:
    """Damage level from summed hits over summed opportunity hazards."""
    return F.when(gamma_decay > 0, clamp(gamma_k / gamma_decay, 0, 1)).otherwise(0.0)
