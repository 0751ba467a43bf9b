"""Functions on codons and frame scores, Markov models, entry point and scratch folders."""

import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade import session
from palisade.functions import codons as Q
from palisade.operators import clustering as K
from palisade.operators import frames as FR
from palisade.operators import markov as M


def test_codon_functions(spark):
    df = spark.createDataFrame([("TGA", "M"), ("ATN", "?"), ("CAA", "L")], "c string, a string")
    got = df.select("c", Q.is_stop("c").alias("stop"), Q.codon_number("c").alias("n"), Q.codon_of(Q.codon_number("c")).alias("again"), Q.damaged_residue("c", "C", "T").alias("ct"), Q.codons_of("a").alias("back"), Q.masked(F.lit("A*B")).alias("m"), Q.folded(F.lit("WYR")).alias("f")).collect()
    assert [(r["stop"], r["n"], r["again"]) for r in got] == [(True, 14, "TGA"), (False, 255, None), (False, 26, "CAA")]
    assert [r["ct"] for r in got] == [None, None, "*"] and [r["back"] for r in got] == ["ATG", None, "CTA,CTC,CTG,CTT,TTA,TTG"] and got[0]["m"] == "AXB" and got[0]["f"] == "RHR"


def test_lists_frames_and_scores(spark):
    df = spark.createDataFrame([("1, 2,x,-3,", "MK", ["AA", "MKL", ""], [0.0, float(np.log(3.0))], [5, 1, 5, 3])], "t string, p string, f array<string>, s array<double>, h array<int>")
    r = df.select(Q.positions("t").alias("at"), Q.true_frame("p", "f").alias("fr"), Q.true_frame(F.lit(""), "f").alias("none"), Q.posterior("s").alias("post"), Q.entropy(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0))).alias("bits"), Q.lowest("h", 2).alias("low"), *Q.strand_call(F.lit(-2.0)),
                  Q.calibrated(F.lit(0.55), [0.0, 0.5, 0.9], [0.1, 0.6, 0.95]).alias("cal")).first()
    assert (r["at"], r["fr"], r["none"], r["bits"], r["low"], r["strand"], r["cal"]) == ([1, 2, -3], 1, -1, 1.0, [1, 3], "-", 0.6)
    assert r["post"] == pytest.approx([0.25, 0.75]) and r["confidence"] == pytest.approx(1 / (1 + np.exp(-2))) and Q.mask_threshold(1, 3) == 0.25


def test_markov_models_find_the_phase(spark):
    rng = random.Random(5)
    genes = ["".join(rng.choice(["GCT", "GAA", "AAA", "CTG"]) for _ in range(50)) for _ in range(80)]
    df = spark.createDataFrame([(i, s[i % 3:]) for i, s in enumerate(genes)], "doc_id long, seq string")
    odds = M.model(M.counts(spark.createDataFrame([(s,) for s in genes], "seq string")))
    best = {r["doc_id"]: r["frame"] for r in M.scores(df, odds).groupBy("doc_id").agg(F.max_by("frame", "score").alias("frame")).collect()}
    assert best == {i: -i % 3 for i in range(80)}
    trained = M.train(df, 3)
    again = {r["doc_id"]: r["frame"] for r in M.scores(df, trained).groupBy("doc_id").agg(F.max_by("frame", "score").alias("frame")).collect()}
    assert len({(again[i] + i) % 3 for i in range(80)}) == 1  # one phase, whichever it is called
    assert M.counts(spark.createDataFrame([(None,), ("AC",), ("NNN",)], "seq string")).count() == 0
    words = {r["code"]: r["n"] for r in FR.word_counts(spark.createDataFrame([("ACACN",), (None,)], "seq string"), 2).collect()}
    assert words == {1: 2, 4: 1}


def test_neighbours_and_votes(spark):
    seeds = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 11), (3, 11), (4, 99)], "doc_id long, h long")
    got = {(r["a"], r["b"]): (r["score"], r["rank"]) for r in K.neighbours(seeds, 1).collect()}
    assert got[1, 2] == (pytest.approx(1.0), 1) and (1, 3) not in got and got[3, 1][1] == 1
    calls = spark.createDataFrame([(1, "x", "+", 0, 3.0), (1, "x", "-", 1, 2.0), (2, "x", "-", 1, 2.0), (3, "y", "+", 2, 1.0)], "doc_id long, c string, strand string, frame int, score double")
    assert {r["doc_id"]: (r["strand"], r["frame"], r["vote"]) for r in K.frame_vote(calls, "c").collect()} == {1: ("-", 1, 4.0), 2: ("-", 1, 4.0), 3: ("+", 2, 1.0)}


def test_components_carry_offsets(spark):
    rng = random.Random(9)
    place = {i: rng.randrange(-50, 50) for i in range(30)}
    order = list(range(30))
    rng.shuffle(order)
    edges = [(a, b, place[a] - place[b]) for a, b in zip(order, order[1:])] + [(100, 101, 5)]
    got = {r["node"]: (r["root"], r["offset"]) for r in K.components_with_offsets(spark.createDataFrame(edges, "u long, v long, d long")).collect()}
    assert got == {i: (0, place[i] - place[0]) for i in range(30)} | {100: (100, 0), 101: (100, -5)}
    seqs = {i: "ACGTACGTACGTACGT"[place[i] % 4:][:8] for i in range(30)}
    rows = [(0, place[i] - place[0] + k, c) for i, s in seqs.items() for k, c in enumerate(s)]
    top = K.consensus(spark.createDataFrame(rows, "cluster long, pos long, residue string"), ["cluster"]).collect()
    assert all(r["residue"] == "ACGT"[(r["pos"] + place[0]) % 4] and r["n"] == r["depth"] for r in top)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(Session())


def test_entry_without_the_training_data_operators(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "palisade.llm", None)
    monkeypatch.setitem(sys.modules, "palisade.llm.registry", None)
    names = entry.queries()
    assert "gene_summary" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and set(entry.oracle_sql()) <= set(names)
