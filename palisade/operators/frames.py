"""Scores of the six reading frames of sequences under a codon usage that is taken from the sequences themselves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.functions.sequence import STOPS

_DIGIT = np.full(256, 4, np.int64)
_DIGIT[np.frombuffer(b"ACGT", np.uint8)] = range(4)
_CODE = {a + b + c: i * 16 + j * 4 + k for i, a in enumerate("ACGT") for j, b in enumerate("ACGT") for k, c in enumerate("ACGT")}


def _codons(data: np.ndarray) -> np.ndarray:
    """The code of the codon from each base on, 64 with any other letter."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    a, b, c = data[:-2], data[1:-1], data[2:]
    return np.where((a < 4) & (b < 4) & (c < 4), a * 16 + b * 4 + c, 64)


def word_counts(seqs: DataFrame, k: int, step: int = 1) -> DataFrame:
    """(code, n): how often each word of k bases (base-4 code, A, C, G, T in order) begins at every step-th base of seqs (seq);
    words with other letters don't count. A task sends one count a word."""

    def run(batches):
        n = np.zeros(4 ** k, np.int64)
        for b in batches:
            for s in b.column("seq").to_pylist():
                d = _DIGIT[np.frombuffer((s or "").encode("latin-1", "replace"), np.uint8)]
                m = len(d) - k + 1
                if m < 1:
                    continue
                code, ok = np.zeros(m, np.int64), np.ones(m, bool)
                for i in range(k):
                    code = code * 4 + d[i:i + m]
                    ok &= d[i:i + m] < 4
                n += np.bincount(code[::step][ok[::step]], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at])], ["code", "n"])

    return seqs.select("seq").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def usage(seqs: DataFrame) -> np.ndarray:
    """Counts of the 64 codons (A, C, G, T in order) in frame 0 of all sequences; 64 rows reach the driver."""
    out = np.zeros(64)
    for r in word_counts(seqs, 3, 3).collect():
        out[r["code"]] = r["n"]
    return out


def frame_scores(seqs: DataFrame, counts: np.ndarray | None = None, penalty: float = 3.0) -> DataFrame:
    """(doc_id, strand, frame, n_codons, stops, score, rank) of seqs (doc_id, seq): the mean log-odds of a frame's codons
    against even use, plus the log of its length, less a penalty by the share of stops; rank 1 is the best frame. Stops and
    codons with other letters have no odds; frames without a codon have no row."""
    n = usage(seqs) if counts is None else counts
    odds = np.append(np.log((n + 0.5) / (n.sum() + 32) * 64), 0.0)
    stop = np.zeros(65, bool)
    stop[[_CODE[c] for c in STOPS]] = True
    odds[stop] = 0.0

    def run(batches):
        for b in batches:
            rows = []
            for i, s in enumerate(b.column("seq").to_pylist()):
                data = _DIGIT[np.frombuffer((s or "").encode("latin-1", "replace"), np.uint8)]
                for strand, part in (("+", data), ("-", np.where(data < 4, 3 - data, 4)[::-1])):
                    code = _codons(part)
                    for frame in range(min(3, len(code))):
                        own = code[frame::3]
                        k = int(stop[own].sum())
                        rows.append((i, strand, frame, len(own), k, float(odds[own].sum() / len(own) + np.log(len(own) + 1) - penalty * k / len(own))))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.float64())], ["doc_id", "strand", "frame", "n_codons", "stops", "score"])

    out = seqs.select("doc_id", "seq").mapInArrow(run, f"doc_id {seqs.schema['doc_id'].dataType.simpleString()}, strand string, frame int, n_codons long, stops long, score double")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc(F.round("score", 9)), "strand", "frame")))
