"""Column functions on codons, residues and frame scores; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.sequence import AMINO, CODONS, STARTS, STOPS, col

#: Codons that an amino acid is written with.
BACK = {a: sorted(c for c, b in CODONS.items() if b == a) for a in sorted(set(AMINO))}


def is_stop(codon: str | Column) -> Column:
    return F.upper(col(codon)).isin(*STOPS)


def is_start(codon: str | Column) -> Column:
    return F.upper(col(codon)).isin(*STARTS)


def codon_number(codon: str | Column) -> Column:
    """0..63 with T, C, A, G as 0..3; 255 with any other letter."""
    c = col(codon)
    return F.when(c.rlike("^[ACGT]{3}$"), F.conv(F.translate(c, "TCAG", "0123"), 4, 10).cast("int")).otherwise(255)


def codon_of(number: str | Column) -> Column:
    """The codon of a number from 0 to 63; null otherwise."""
    n = col(number)
    letters = [F.substr(F.lit("TCAG"), (F.floor(n / d) % 4 + 1).cast("int"), F.lit(1)) for d in (16, 4, 1)]
    return F.when(n.between(0, 63), F.concat(*letters))


def composition(seq: str | Column) -> list[Column]:
    """Counts of A, C, G, T and of anything else."""
    s = F.upper(col(seq))
    n = {b: F.length(s) - F.length(F.replace(s, F.lit(b), F.lit(""))) for b in "ACGT"}
    return [*[n[b].cast("long").alias(b.lower()) for b in "ACGT"], (F.length(s) - n["A"] - n["C"] - n["G"] - n["T"]).cast("long").alias("other")]


def folded(protein: str | Column) -> Column:
    """Residues that damage turns into each other under one letter each: the targets of its substitutions for what they become."""
    return F.translate(col(protein), "WYKNIMVDQC", "RHEDTTAGRR")


def codons_of(residue: str | Column) -> Column:
    """The codons of an amino acid, comma-joined, in order; null for other letters."""
    return F.try_element_at(F.create_map(*[F.lit(x) for a, cs in BACK.items() for x in (a, ",".join(cs))]), col(residue))


def damaged_residue(codon: str | Column, base: str, to: str) -> Column:
    """What a codon codes for once the first base of a kind in it has become another; null if there is none."""
    c = col(codon)
    at = F.instr(c, base)
    hit = F.concat(F.substr(c, F.lit(1), at - 1), F.lit(to), F.substr(c, at + 1))
    return F.when(at > 0, F.try_element_at(F.create_map(*[F.lit(x) for kv in CODONS.items() for x in kv]), hit))


def stop_origin(codon: str | Column, start: str | Column, length: str | Column, near: int = 20) -> Column:
    """The residue behind a damaged stop: Q for TAA and TAG; of TGA R, or W when the end is closer than the start and near."""
    c, to_end = col(codon), col(length) - 3 - col(start)
    return F.when(c.isin("TAA", "TAG"), "Q").when(c == "TGA", F.when((to_end < col(start)) & (to_end < near), "W").otherwise("R")).otherwise("X")


def masked(protein: str | Column) -> Column:
    """A protein for searching: stops as X."""
    return F.translate(col(protein), "*", "X")


def positions(text: str | Column) -> Column:
    """Whole numbers of a comma-joined list; what doesn't parse is left out."""
    return F.filter(F.transform(F.split(col(text), ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def true_frame(protein: str | Column, frames: str | Column) -> Column:
    """The first of three frames' proteins (an array) that is, or begins with or begins, the truth; -1 for none or an empty truth."""
    p, f = col(protein), col(frames)
    agree = lambda x: (x == p) | F.startswith(x, p) | ((x != "") & F.startswith(p, x))
    return F.when(F.length(p) > 0, F.coalesce(*[F.when(agree(F.get(f, F.lit(i))), F.lit(i)) for i in range(3)], F.lit(-1))).otherwise(-1)


def posterior(scores: str | Column, temperature: float = 1.0) -> Column:
    """Softmax of an array of scores."""
    s = col(scores)
    e = F.transform(s, lambda x: F.exp((x - F.array_max(s)) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def entropy(shares: str | Column) -> Column:
    """Entropy in bits of an array of shares."""
    return -F.aggregate(col(shares), F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def strand_call(llr: str | Column) -> list[Column]:
    """Strand by the sign of a log-likelihood ratio, and the confidence in it."""
    x = col(llr)
    return [F.when(x >= 0, "+").otherwise("-").alias("strand"), (1.0 / (1.0 + F.exp(-F.abs(x)))).alias("confidence")]


def calibrated(score: str | Column, edges: list[float], values: list[float]) -> Column:
    """The value of the bin that a score falls into; scores outside take the nearest bin's. edges: lower edges, ascending."""
    out = F.lit(values[0])
    for e, v in zip(edges[1:], values[1:]):
        out = F.when(col(score) >= e, F.lit(v)).otherwise(out)
    return F.when(col(score).isNotNull(), out)


def mask_threshold(cost_mask: float, cost_keep: float) -> float:
    """Probability of damage from which masking a residue costs less than keeping it."""
    return cost_mask / (cost_mask + cost_keep)


def lowest(hashes: str | Column, n: int) -> Column:
    """The n smallest of an array, ascending."""
    return F.slice(F.array_sort(F.array_distinct(col(hashes))), 1, n)
