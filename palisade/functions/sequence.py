"""Column functions over nucleotide and protein sequences; all stay inside the JVM but translation, which is a table
lookup over the bytes of an Arrow batch."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The standard genetic code, codons in TCAG order.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = dict(zip(("".join(c) for c in product("TCAG", repeat=3)), AMINO))
STOPS = ("TAA", "TAG", "TGA")
STARTS = ("ATG", "GTG", "TTG")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(seq: str | Column) -> Column:
    """Upper case without white space."""
    return F.upper(F.regexp_replace(col(seq), r"\s", ""))


def is_valid_dna(seq: str | Column) -> Column:
    return col(seq).rlike("^[ACGTNacgtn]*$")


def reverse_complement(seq: str | Column) -> Column:
    """Reverse complement; anything but A, C, G, T becomes N."""
    s = F.regexp_replace(F.upper(col(seq)), "[^ACGT]", "N")
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def gc_content(seq: str | Column) -> Column:
    """GC among A, C, G and T; 0 without any."""
    s = F.upper(col(seq))
    gc = F.length(F.regexp_replace(s, "[^GC]", ""))
    acgt = F.length(F.regexp_replace(s, "[^ACGT]", ""))
    return F.when(acgt > 0, gc / acgt).otherwise(F.lit(0.0))


def base_count(seq: str | Column, base: str) -> Column:
    s = col(seq)
    return (F.length(s) - F.length(F.replace(s, F.lit(base), F.lit("")))).cast("long")


def codons(seq: str | Column, frame: int = 0) -> Column:
    """Array of the whole codons of a frame."""
    return F.regexp_extract_all(F.substr(col(seq), F.lit(frame + 1)), F.lit("(...)"), F.lit(1))


_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"TCAG", np.uint8)] = range(4)
_AMINO = np.frombuffer(AMINO.encode(), np.uint8)
_PAIR = np.full(256, ord("N"), np.uint8)
_PAIR[np.frombuffer(b"ACGTacgt", np.uint8)] = np.frombuffer(b"TGCATGCA", np.uint8)


def residues(seqs: np.ndarray) -> np.ndarray:
    """The residue of the codon from each byte of a buffer on: stops *, codons with anything but A, C, G, T as X."""
    code = _CODE[seqs]
    if len(code) < 3:
        return np.zeros(0, np.uint8)
    a, b, c = code[:-2], code[1:-1], code[2:]
    out = _AMINO[((a << 4) | (b << 2) | c) & 63]
    out[((a | b | c) & 4) > 0] = ord("X")
    return out


def _proteins(seqs: pd.Series, frames: list[tuple[str, int]]) -> list[list[str | None]]:
    """Proteins of all sequences of a batch in each (strand, frame)."""
    whole = [None if x is None else x.encode("latin-1", "replace") for x in seqs]
    data = np.frombuffer(b"".join(x or b"" for x in whole), np.uint8)
    end = np.cumsum([len(x or b"") for x in whole])
    out = []
    for strand, frame in frames:
        aa = residues(data if strand == "+" else _PAIR[data[::-1]])
        rows = []
        for x, e in zip(whole, end.tolist()):
            at = e - len(x or b"") if strand == "+" else len(data) - e
            rows.append(None if x is None else aa[at + frame:max(at + frame, at + len(x) - 2):3].tobytes().decode())
        out.append(rows)
    return out


@F.pandas_udf(T.StringType())
def _translated(seqs: pd.Series, frame: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(seqs), dtype=object)
    for f in frame.unique():
        at = np.flatnonzero(frame == f)
        out.iloc[at] = _proteins(seqs.iloc[at], [("+", int(f))])[0]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _six(seqs: pd.Series) -> pd.Series:
    return pd.Series(list(map(list, zip(*_proteins(seqs, [(s, f) for s in "+-" for f in range(3)])))))


def translate(seq: str | Column, frame: int = 0) -> Column:
    """Protein of a frame, stops kept as *, unknown codons X."""
    return _translated(col(seq), F.lit(frame))


def six_frames(seq: str | Column) -> Column:
    """Proteins of the frames 0, 1, 2 of the sequence, then of its reverse complement."""
    return _six(col(seq))


def until_stop(protein: str | Column) -> Column:
    return F.substring_index(col(protein), "*", 1)


def internal_stops(protein: str | Column) -> Column:
    """Stops before the last residue."""
    p = col(protein)
    head = F.substr(p, F.lit(1), F.greatest(F.length(p) - 1, F.lit(0)))
    return base_count(head, "*")


def bases(seq: str | Column) -> Column:
    """Array of the characters; empty for an empty sequence."""
    return F.filter(F.split(col(seq), ""), lambda c: c != "")


def kmers(seq: str | Column, k: int) -> Column:
    """Array of overlapping k-mers, from the array of bases so that long sequences cost no rescans."""
    n = F.length(col(seq)) - k + 1
    # the array is bound once, as the outer function's argument; inside the inner one it would be built again for every k-mer
    made = F.transform(F.array(bases(seq)), lambda a: F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(a, i, k), "")))
    return F.when(n > 0, F.get(made, F.lit(0))).otherwise(F.array().cast("array<string>"))


def hexamer_code(kmer: str | Column) -> Column:
    """0..4095 with A, C, G, T as 0..3; null with any other character."""
    k = col(kmer)
    return F.when(k.rlike("^[ACGT]{6}$"), F.conv(F.translate(k, "ACGT", "0123"), 4, 10).cast("long"))


def strip_frame_suffix(read_id: str | Column) -> Column:
    """Read name without its _<strand>_<frame> suffix."""
    return F.regexp_replace(col(read_id), "_[+-]_[0-9]$", "")


def read_name(read_id: str | Column) -> Column:
    """Read name by its last two underscores, whatever follows."""
    return F.regexp_replace(col(read_id), "_[+-][^_]*_[^_]*$", "")


def strand(read_id: str | Column) -> Column:
    got = F.regexp_extract(col(read_id), "_([+-])_[0-9]+$", 1)
    return F.when(got == "", F.lit("+")).otherwise(got)


def frame(read_id: str | Column) -> Column:
    got = F.regexp_extract(col(read_id), "_[+-]_([0-9]+)$", 1)
    return F.when(got == "", F.lit(0)).otherwise(got.cast("int"))


def identity(a: str | Column, b: str | Column) -> Column:
    """Positional matches over the longer length."""
    x, y = bases(a), bases(b)
    same = F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce((p == q).cast("int"), F.lit(0))), F.lit(0), lambda s, v: s + v)
    longest = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.when(longest > 0, same / longest).otherwise(F.lit(0.0))


def wrap(seq: str | Column, width: int = 60) -> Column:
    return F.regexp_replace(F.regexp_replace(col(seq), f"(.{{{width}}})", "$1\n"), "\n$", "")


def decoy_codon_reverse(seq: str | Column) -> Column:
    """Decoy: the codons of frame 0 in reverse order, the rest of the sequence kept at the end."""
    s = col(seq)
    whole = (F.length(s) / 3).cast("int") * 3
    return F.concat(F.array_join(F.reverse(codons(s, 0)), ""), F.substr(s, whole + 1))
