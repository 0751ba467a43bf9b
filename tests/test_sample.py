"""Sample counts, damage models, per-read damage and frame scores against loops and simulated truth."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.operators import annotate as N
from palisade.operators import frames as FR
from palisade.operators import levels as LV
from palisade.operators import read_damage as RD
from palisade.operators import sample_counts as SC
from palisade.operators import sample_models as SM


def simulate(n, level, seed=1, rate=0.3):
    """Reads of random bases, damaged at both ends."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s = [rng.choice("ACGT") for _ in range(90)]
        for i in range(len(s)):
            if s[i] == "C" and rng.random() < level * math.exp(-rate * i):
                s[i] = "T"
            if s[-1 - i] == "G" and rng.random() < level * math.exp(-rate * i):
                s[-1 - i] = "A"
        out.append("".join(s))
    return out


def test_counts_equal_loops_and_merge(spark):
    rng = random.Random(7)
    seqs = ["".join(rng.choice("ACGTN" if k % 4 == 0 else "ACGT") for _ in range(rng.randrange(20, 110))) for k in range(80)] + [None, ""]
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    got = {(r["channel"], r["a"], r["b"]): r["n"] for r in SC.counts(df.repartition(4)).collect()}
    want: dict = {}

    def add(*key):
        want[key] = want.get(key, 0) + 1

    for s in seqs:
        if not s or len(s) < 30:
            continue
        n = len(s)
        for p in range(15):
            for channel, phase, c in (("5p", "phase5", s[p]), ("3p", "phase3", s[-1 - p])):
                if c in "ACGT":
                    add(channel, p, c)
                    add(phase, p % 3, c)
            codon = s[p:p + 3]
            for channel, kinds in (("stop", SC.STOPS), ("ox", SC.OXIDISED)):
                if codon in kinds or codon in kinds.values():
                    add(channel, p, codon)
        for c in s[n // 3:2 * n // 3]:
            if c in "ACGT":
                add("mid", 0, c)
        for p in range(30, n - 32):
            if n >= 63:
                for channel, kinds in (("stop_in", SC.STOPS), ("ox_in", SC.OXIDISED)):
                    if s[p:p + 3] in kinds or s[p:p + 3] in kinds.values():
                        add(channel, 0, s[p:p + 3])
        for p in range(5):
            if s[p:p + 2] in ("CG", "TG"):
                add("cpg", p, s[p:p + 2])
        inside = [c for c in s[5:n - 5] if c in "ACGT"]
        add("gc", min(sum(c in "GC" for c in inside) * 10 // max(len(inside), 1), 9) if inside else 0, "reads")
        for channel, k in (("hex5", s[:6]), ("hexmid", s[n // 2 - 3:n // 2 + 3])):
            if set(k) <= set("ACGT"):
                add(channel, sum("ACGT".index(c) * 4 ** (5 - i) for i, c in enumerate(k)), "")
    assert {k: v for k, v in got.items() if k[0] not in ("gc5", "gcmid", "gcstop")} == want
    twice = {(r["channel"], r["a"], r["b"]): r["n"] for r in SC.counts(df.withColumn("w", F.lit(2.0)), "w").collect()}
    assert twice == {k: 2 * v for k, v in got.items()}
    assert SC.counts(df.limit(0)).count() == 0


def test_models_tell_damage_from_none(spark):
    fits = {}
    for level in (0.0, 0.35):
        df = spark.createDataFrame([(s,) for s in simulate(6000, level)], "seq string")
        fits[level] = SM.fit(SC.counts(df))
    none, some = fits[0.0], fits[0.35]
    assert some["state"] == "validated" and abs(some["5p"]["joint"]["d_max"] - 0.35) < 0.08 and abs(some["d_max"] - 0.35) < 0.12 and some["source"] == "stops"
    assert some["stops"]["quantifiable"] and some["stops"]["llr"] > 10 and some["hexamer_llr"] > 0 and some["5p"]["z"] > 10
    assert abs(some["5p"]["briggs"]["delta_s"] - some["5p"]["rates"][0]) < 1e-9 and some["5p"]["briggs"]["r2"] > 0.5
    assert none["d_max"] < 0.05 and abs(none["5p"]["shift"]) < 0.03 and none["5p"]["joint"]["p_damage"] < 0.5 and not none["oxidation"]["detected"]
    levels = some["mixture"]["levels"]
    assert levels and all(abs(x - 0.35) < 0.15 for x in levels) and none["mixture"]["levels"] and max(none["mixture"]["levels"]) < 0.05


def test_terminal_artefact_moves_to_the_second_position():
    n = np.full(15, 1000.0)
    k = np.full(15, 400.0)
    k[0], k[1] = 350, 500
    got = SM.terminal(k, n, 4000, 10_000)
    assert got["artefact"] and got["shift"] == pytest.approx(0.1)
    assert not SM.terminal(np.full(15, 450.0), n, 4000, 10_000)["artefact"]


def plain_prior(s, d, rate):
    """The model read off a fine scan of the level's posterior, site by site."""
    if len(s) < 60 or d < 0.01:
        return 0.0
    inner = s[20:-20]
    n = {c: inner.count(c) + 0.5 for c in "ACGT"}
    ratio = lambda a, b: min(max(n[a] / (n[a] + n[b]), 0.01), 0.99)
    sites = [(ratio("T", "C"), i, c == "T") for i, c in enumerate(s[:20]) if c in "CT"] + [(ratio("A", "G"), i, c == "A") for i, c in enumerate(s[::-1][:20]) if c in "GA"]
    sites = [(b, (1 - b) * math.exp(-rate * i), y) for b, i, y in sites]
    if not sites:
        return 0.2 * d
    a, e = d * 20, (1 - d) * 20
    if min(a, e) <= 1:
        a, e = a + 1, e + 1
    at = np.arange(1, 100_000) / 100_000
    score = (a - 1) * np.log(at) + (e - 1) * np.log(1 - at) + sum(np.log(b + c * at) if y else np.log(1 - b - c * at) for b, c, y in sites)
    t = at[score.argmax()]
    told = sum(c for _, c, _ in sites)
    any_ = 1 - math.prod(1 - t * c for _, c, _ in sites)
    return told / (told + 1) * any_ + d * 0.2 / (told + 1)


def test_read_prior_equals_a_loop(spark):
    reads = simulate(40, 0.4, 3) + ["ACGT" * 10, "", "N" * 70, "A" * 59]
    assert RD.prior(reads, 0.3, 0.25) == pytest.approx([plain_prior(s, 0.3, 0.25) for s in reads], abs=2e-5)
    assert not RD.prior(reads, 0.001, 0.25).any()
    rows = spark.createDataFrame([("a", None), ("b", reads[0])], "id string, s string").select("id", RD.damage_prior("s", 0.3, 0.25).alias("p")).collect()
    assert {r["id"]: r["p"] for r in rows} == {"a": 0.0, "b": pytest.approx(plain_prior(reads[0], 0.3, 0.25), abs=2e-5)}
    hot, cold = (np.mean(RD.prior(simulate(300, x, 5), 0.3, 0.3)) for x in (0.5, 0.0))
    assert hot > cold + 0.01


def test_stop_damage(spark):
    df = spark.createDataFrame([("TAA", 0), ("TGA", 57), ("CAA", 0), ("TAG", 30)], "c string, at int")
    got = {(r["c"]): r["p"] for r in df.select("c", RD.stop_damage(F.col("c"), F.col("at"), F.lit(60), 0.4, 0.3).alias("p")).collect()}
    assert got["TAA"] == pytest.approx(0.4) and got["TGA"] == pytest.approx(0.4) and got["CAA"] == 0 and got["TAG"] < 1e-3


def test_frame_scores_find_the_coding_frame(spark):
    rng = random.Random(11)
    often = ["GCT", "GAA", "AAA", "CTG", "GGC", "ATC"]
    seqs = ["".join(rng.choice(often) for _ in range(40)) for _ in range(60)]
    df = spark.createDataFrame([(i, "G" * (i % 3) + s) for i, s in enumerate(seqs)], "doc_id long, seq string")
    counts = FR.usage(spark.createDataFrame([(s,) for s in seqs], "seq string"))
    best = {r["doc_id"]: (r["strand"], r["frame"]) for r in FR.frame_scores(df, counts).where("rank = 1").collect()}
    assert best == {i: ("+", i % 3) for i in range(60)}
    odd = FR.frame_scores(spark.createDataFrame([(1, None), (2, "AC"), (3, "NNNN")], "doc_id long, seq string"), counts).collect()
    assert {r["doc_id"] for r in odd} == {3} and all(np.isfinite(r["score"]) for r in odd)


def test_settings_and_classes(spark):
    rows = [(f"r{i}", 0.4, 5, 4, -1.0, -2.0) for i in range(60)]
    one = N.settings_from(spark.createDataFrame(rows, "read_id string, p_read double, terminal_5 long, terminal_3 long, ll_a double, ll_m double")).first()
    assert (one["prior"], one["both_ends"], one["mode"]) == (pytest.approx(0.4), 1, "alignment")
    few = [("a", 0.1, 5, 0, 0.0, 0.0), ("a", 0.3, 5, 0, 0.0, 0.0)]
    one = N.settings_from(spark.createDataFrame(few, "read_id string, p_read double, terminal_5 long, terminal_3 long, ll_a double, ll_m double")).first()
    assert (one["prior"], one["both_ends"], one["mode"]) == (0.1, 0, "read")
    df = spark.createDataFrame([(0.7, 0.95, 1.0, 9.0), (0.1, 0.95, 1.0, 9.0), (0.4, 0.5, 0.0, 0.0)], "posterior double, fident double, z_bpa double, delta_bits double")
    assert [r["c"] for r in df.select(N.classify(True).alias("c")).collect()] == ["ancient_confident", "modern_confident", "undetermined"]
    assert [r["c"] for r in df.select(N.classify(False).alias("c")).collect()] == ["ancient_likely", "ancient_likely", "undetermined"]


def test_silent_codons():
    silent, changing = N.silent_codons("T", "C", 2)
    assert "GCT" in silent and len(silent) + len(changing) == 16 and set(N.silent_codons("A", "G", 2)[1]) == {"ATA", "TGA"}


def test_percentage_is_the_maximum_of_a_fine_scan(spark):
    reads = simulate(60, 0.4, 8) + ["ACGT" * 3, "", "N" * 70, "A" * 15, "acgt" * 6]
    level, rates, shares, bins = 0.3, (0.25, 0.4), (0.45, 0.55), {5: (0.2, 0.4), 4: (0.004, 0.5)}

    def plain(s):
        s = s.upper()
        if len(s) < 15:
            return 0.0
        inner = [c for c in s[5:-5] if c in "ACGT"]
        own = bins.get(min(sum(c in "GC" for c in inner) * 10 // len(inner), 9) if inner else 0)
        if own and own[0] < 0.005:
            return 0.0
        d, t = own or (level, shares[0])
        sites = [(t, d * math.exp(-rates[0] * i), c == "T") for i, c in enumerate(s[:15]) if c in "CT"] + [(shares[1], d * math.exp(-rates[1] * i), c == "A") for i, c in enumerate(s[::-1][:15]) if c in "GA"]
        if not sites:
            return 0.0
        at = np.arange(100_001) / 100_000
        return 100 * d * at[sum(np.log(b + (1 - b) * e * at) if y else np.log((1 - b) * (1 - e * at)) for b, e, y in sites).argmax()]

    assert RD.percentage(reads, level, rates, shares, bins) == pytest.approx([plain(s) for s in reads], abs=1e-3)
    assert not RD.percentage(reads, level, rates, shares, contradicted=True).any()
    df = spark.createDataFrame([("a", None), ("b", reads[0])], "id string, s string")
    got = {r["id"]: (r["p"], r["t"], r["g"]) for r in df.select("id", RD.damage_percentage("s", level, rates, shares, bins).alias("p"), RD.damage_terminal("s", 0.3, rates, 0.5).alias("t"), RD.damage_signal("s").alias("g")).collect()}
    assert got["a"][:2] == (0.0, 0.0) and got["b"][0] == pytest.approx(plain(reads[0]), abs=1e-3) and 0.25 <= got["b"][1] <= 0.5
    hot, cold = (np.mean(RD.percentage(simulate(300, x, 5), 0.4, (0.3, 0.3), (0.5, 0.5))) for x in (0.4, 0.0))
    assert hot > cold + 3


def test_every_branch_of_the_level():
    """The table of the choice, branch by branch."""
    E = LV.Evidence
    ok = dict(start=0.3, end=0.2, joint=0.25, p_damage=0.99)
    table = [
        (E(artefact=True, **ok), (0.0, "none")),
        (E(validated=True, inverted_5=True, inverted_3=True, stops=0.4, **ok), (0.4, "stops")),
        (E(validated=True, adapter=True, stops=0.4, **ok), (0.4, "stops")),
        (E(validated=True, adapter=True, stops=0.005, mixture=0.22, **ok), (0.22, "average")),
        (E(validated=True, inverted_3=True, **ok), (0.3, "start")),
        (E(validated=True, inverted_5=True, **ok), (0.2, "end")),
        (E(validated=True, mixture=0.22, strata=0.1, **ok), (0.22, "average")),
        (E(validated=True, mixture=0.005, strata=0.1, **ok), (0.1, "average")),
        (E(validated=True, **ok), (0.25, "average")),
        (E(start=0.3, end=0.2, joint=0.25, p_damage=0.7), (0.25, "average")),
        (E(start=0.3, end=0.2, p_damage=0.2, single_stranded=True), (0.3, "single strand")),
        (E(start=0.3, end=0.2, p_damage=0.2), (0.0, "none")),
        (E(start=0.3, end=0.2, stops=0.15), (0.15, "stops")),
        (E(start=0.3, end=0.1, asymmetric=True, single_stranded=True), (0.3, "single strand")),
        (E(start=0.3, end=0.1, asymmetric=True), (0.1, "lower end")),
        (E(start=0.3, end=0.1), (0.2, "average")),
        (E(start=0.3, end=0.1, inverted_5=True), (0.1, "end")),
        (E(start=0.3, end=0.1, inverted_3=True), (0.3, "start")),
        (E(start=0.3, end=0.1, p_damage=0.2, inverted_3=True), (0.0, "start")),
        (E(start=0.3, end=0.1, inverted_5=True, inverted_3=True), (0.0, "none")),
    ]
    for evidence, want in table:
        assert LV.arbitrate(evidence) == (pytest.approx(want[0]), want[1]), evidence
    assert LV.state(True, False, True, -500) == ("validated", 1.0) and LV.state(False, True, False, 0) == ("contradicted", 0.0)
    assert LV.state(False, False, True, -101) == ("contradicted", 0.0) and LV.state(False, False, False, -101) == ("unvalidated", 0.5)
    assert LV.blend(0.2, 0.4, 0.0, True, []) == (pytest.approx(0.3), pytest.approx(0.5)) and LV.blend(0.4, 0.2, 0.0, True, [])[0] == pytest.approx(0.37)
    assert LV.blend(0.2, 0.4, 0.0, False, []) == (0.2, 0.0) and LV.blend(0.2, None, 0.0, True, [{"bin": 4, "level": 0.4, "reads": 900}])[0] == pytest.approx(0.25)
    assert LV.wants_second_pass(0.2, True, True, False, 0.2) and LV.wants_second_pass(0.2, True, False, False, 0.26) and not LV.wants_second_pass(0.2, True, False, False, 0.22)
    assert not LV.wants_second_pass(0.2, False, True, True, None) and not LV.wants_second_pass(0.1, True, True, True, None)


def test_joint_model_tells_damage_from_artefact():
    x, n = np.arange(15), np.full(15, 20_000.0)
    base = {"tc": 0.5, "ag": 0.45, "stop": 0.1}
    decay = np.exp(-0.3 * x)

    def counts(level, artefact):
        tc, ag = base["tc"] + artefact * decay, base["ag"] + artefact * decay
        return {"tc": n * (tc + (1 - tc) * level * decay), "ag": n * ag, "stop": n * (base["stop"] + (1 - base["stop"]) * level * decay)}

    ns = {c: n for c in base}
    damaged = LV.joint_model(counts(0.24, 0.0), ns, base)
    assert damaged["valid"] and abs(damaged["d_max"] - 0.24) < 0.01 and abs(damaged["rate"] - 0.3) < 0.01 and abs(damaged["artefact"]) < 0.01 and damaged["p_damage"] > 0.99
    fake = LV.joint_model(counts(0.0, 0.1), ns, base)
    assert fake["d_max"] < 0.01 and abs(fake["artefact"] - 0.1) < 0.01 and fake["p_damage"] < 0.05
    both = LV.joint_model(counts(0.18, -0.08), ns, base)
    assert abs(both["d_max"] - 0.18) < 0.015 and abs(both["artefact"] + 0.08) < 0.015
    assert not LV.joint_model(counts(0.2, 0), {c: np.full(15, 50.0) for c in base}, base)["valid"]


def test_decay_fit_and_components():
    x = np.arange(15)
    got = LV.decay_fit(0.02 + 0.3 * np.exp(-0.4 * x), np.full(15, 5000.0))
    assert abs(got["d_max"] - 0.3) < 0.02 and abs(got["rate"] - 0.4) < 0.05 and got["r2"] > 0.99 and got["p_value"] < 1e-6
    flat = LV.decay_fit(np.full(15, 0.1), np.full(15, 5000.0))
    assert flat["d_max"] < 1e-6 and flat["p_value"] > 0.5 and not LV.decay_fit(np.full(15, 0.1), np.full(15, 5.0))["fitted"]
    two = LV.two_components([0.0, 0.005, 0.01, 0.3, 0.32], [1e5, 1e5, 1e5, 1e5, 1e5])
    assert two["found"] and two["separated"] and abs(two["d_damaged"] - 0.31) < 0.03 and abs(two["share"] - 0.4) < 0.1 and abs(two["d_mean"] - 0.127) < 1e-9
    assert not LV.two_components([0.3], [10])["found"] and not LV.two_components([], [])["found"]


def test_second_pass_weighs_reads(spark):
    """Where the ends mislead, the counts are taken again by the reads' damage; elsewhere once."""
    df = spark.createDataFrame([(s,) for s in simulate(3000, 0.35)], "seq string")
    first = SM.fit(SC.counts(df))
    assert LV.estimate(df, SM.fit)["passes"] == (2 if LV.wants_second_pass(first["level"], first["state"] == "validated", first["inverted_5"] or first["inverted_3"], first["5p"]["artefact"], first["stops_level"]) else 1)
    again = LV.second_pass(df, SM.fit, first | {"level": 0.35})
    assert again["level"] > 0 and again["5p"]["rates"][0] >= first["5p"]["rates"][0] - 0.02
    assert abs(first["level"] - 0.35) < 0.15 and first["state"] == "validated"
