"""Everything that a sample's damage models need of its reads, as one mergeable table of counts.

counts() gives rows (channel, a, b, n); a batch of reads is counted in flat arrays and a task yields one set of sums, so
the shuffle carries a few thousand rows a task however many reads there are. Reads under 30 bases don't count.

Channels (a, b): 5p and 3p (position from the end, base); mid (0, base) over the middle third; phase5 and phase3 (position
mod 3, base) over the same ends; cpg (position, CG or TG) over the first five; stop and ox (position of a codon's first
base among the first fifteen, codon) and stop_in and ox_in (0, codon) over the inside of reads of 63 or more: codons that
damage (or oxidation) turns into stops, and those stops; gc (bin, `reads`) by tenths of the inside's GC, gc5 (bin * 100 +
position, T or C), gcmid (bin, T or C), gcstop (bin * 100 + position, `stop` or `pre`); hex5 and hexmid (code of a hexamer
at the start and in the middle of reads of 18 or more, empty).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENDS = 15
BASES = "ACGT"
#: Codons that become stops by C to T, and by G to T, with the stops they become.
STOPS = {"CAA": "TAA", "CAG": "TAG", "CGA": "TGA"}
OXIDISED = {"GAG": "TAG", "GAA": "TAA", "GGA": "TGA"}
_DIGIT = np.full(256, 4, np.int64)
_DIGIT[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def _codon(c: str) -> int:
    return BASES.index(c[0]) * 16 + BASES.index(c[1]) * 4 + BASES.index(c[2])


class _Sums:
    def __init__(self):
        self.n: dict[tuple[str, int, str], float] = {}

    def add(self, channel: str, a, b, weights: np.ndarray) -> None:
        """Counts of pairs of whole numbers a and names b (an array of places in a list of names, or one name)."""
        names, place = b if isinstance(b, tuple) else ([b], np.zeros(len(weights), np.int64))
        key = np.broadcast_to(a, place.shape).astype(np.int64) * len(names) + place
        got, at = np.unique(key, return_inverse=True)
        for k, w in zip(got.tolist(), np.bincount(at.ravel(), weights.ravel(), minlength=len(got)).tolist()):
            item = (channel, k // len(names), names[k % len(names)])
            self.n[item] = self.n.get(item, 0.0) + w


def _count(seqs: list[bytes], weights: np.ndarray, into: _Sums) -> None:
    length = np.array([len(s) for s in seqs], np.int64)
    data = _DIGIT[np.frombuffer(b"".join(seqs), np.uint8)]
    start = np.cumsum(length) - length
    row = np.repeat(np.arange(len(seqs)), length)
    place = np.arange(len(data)) - start[row]
    n, w = length[row], weights[row]
    base = (list(BASES), None)

    def bases(channel, a, pick):
        ok = pick & (data < 4)
        into.add(channel, a[ok] if isinstance(a, np.ndarray) else a, (base[0], data[ok]), w[ok])

    back = n - 1 - place
    third = (place >= n // 3) & (place < 2 * n // 3)
    bases("5p", place, place < ENDS)
    bases("3p", back, back < ENDS)
    bases("mid", 0, third)
    bases("phase5", place % 3, place < ENDS)
    bases("phase3", back % 3, back < ENDS)
    nxt = np.append(data[1:], 4)
    for kind, first in (("CG", 1), ("TG", 3)):
        ok = (place < 5) & (data == first) & (nxt == 2)
        into.add("cpg", place[ok], kind, w[ok])
    inside = (place >= 5) & (place < n - 5)
    gc = np.bincount(row[inside & ((data == 1) | (data == 2))], minlength=len(seqs))
    known = np.bincount(row[inside & (data < 4)], minlength=len(seqs))
    tenth = np.minimum(np.where(known > 0, gc * 10 // np.maximum(known, 1), 0), 9)
    into.add("gc", tenth, "reads", weights)
    for channel, a, pick in (("gc5", tenth[row] * 100 + place, place < ENDS), ("gcmid", tenth[row], third)):
        for name, d in (("C", 1), ("T", 3)):
            ok = pick & (data == d)
            into.add(channel, a[ok], name, w[ok])
    if len(data) >= 3:
        a, b, c = data[:-2], data[1:-1], data[2:]
        whole = (place[:-2] + 3 <= n[:-2]) & (a < 4) & (b < 4) & (c < 4)
        code = np.where(whole, a * 16 + b * 4 + c, 64)
        p, m, ww, t = place[:-2], n[:-2], w[:-2], tenth[row[:-2]]
        for channel, kinds in (("stop", STOPS), ("ox", OXIDISED)):
            for pre, stop in kinds.items():
                for name in (pre, stop):
                    is_ = code == _codon(name)
                    ok = is_ & (p < ENDS)
                    into.add(channel, p[ok], name, ww[ok])
                    ok = is_ & (m >= 63) & (p >= 30) & (p + 3 <= m - 30)
                    into.add(f"{channel}_in", 0, (["", name], np.ones(int(ok.sum()), np.int64)), ww[ok])
                    if channel == "stop":
                        ok = is_ & (p < ENDS)
                        into.add("gcstop", t[ok] * 100 + p[ok], "stop" if name == stop else "pre", ww[ok])
    for channel, at in (("hex5", np.zeros(len(seqs), np.int64)), ("hexmid", length // 2 - 3)):
        six = data[(start + np.maximum(at, 0))[:, None] + np.arange(6)]
        ok = (length >= 18) & (six < 4).all(axis=1)
        into.add(channel, (six[ok] * 4 ** np.arange(5, -1, -1)).sum(axis=1), "", weights[ok])


def counts(seqs: DataFrame, weight: str | None = None) -> DataFrame:
    """(channel, a, b, n) of seqs (seq, and the weight column if named; null sequences and weights don't count)."""
    cols = ["seq", *([weight] if weight else [])]

    def run(batches):
        sums = _Sums()
        for batch in batches:
            text = batch.column("seq").to_pylist()
            mass = batch.column(weight).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False) if weight else np.ones(len(text))
            kept = [(s.encode("latin-1", "replace"), w) for s, w in zip(text, mass.tolist()) if s and len(s) >= 30]
            for lo in range(0, len(kept), 512):
                part = kept[lo:lo + 512]
                _count([s for s, _ in part], np.array([w for _, w in part]), sums)
        keys = list(sums.n)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(sums.n.values()), pa.float64())], ["channel", "a", "b", "n"])

    return seqs.select(*cols).mapInArrow(run, "channel string, a long, b string, n double").groupBy("channel", "a", "b").agg(F.sum("n").alias("n"))
