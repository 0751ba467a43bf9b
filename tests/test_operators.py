"""Scenarios with known answers for the operators on alignments, annotation and error rates."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.functions import sequence as S
from palisade.functions import stats
from palisade.operators import alignments as A
from palisade.operators import annotate as N
from palisade.operators import clustering as K
from palisade.operators import em as E
from palisade.operators import fdr as D
from palisade.operators import report as R
from palisade.operators.ranges import Ranges, lower_rank

ALN = "read_id long, ref_id long, bits double, fident double, aln_len int, tstart int, tlen int, p_read double, sk long, ln int"


def aln(spark, rows):
    return spark.createDataFrame([(r, t, float(b), 0.95, 20, 0, 100, 0.05, 0, i) for i, (r, t, b) in enumerate(rows)], ALN)


def test_best_hit_ties_and_singles(spark):
    got = {r["read_id"]: r for r in A.best_hits(aln(spark, [(1, 7, 50), (1, 5, 50), (2, 3, 10)])).collect()}
    assert (got[1]["ref_id"], got[1]["bits_second"], got[1]["delta_bits"], got[1]["degree"]) == (5, 50.0, 0.0, 2)
    assert (got[2]["bits_second"], got[2]["delta_bits"]) == (0.0, 0.0)


def test_unique_mappers(spark):
    got = A.unique_mappers(aln(spark, [(1, 7, 50), (1, 5, 50), (2, 3, 10)])).collect()
    assert [(r["read_id"], r["ref_id"]) for r in got] == [(2, 3)]


def random_aln(seed, reads=60, refs=8, damage=False):
    rng = random.Random(seed)
    rows = [(r, t, round(rng.uniform(0, 3), 3), rng.randrange(40), 10 + rng.randrange(30), 60 + 10 * t, rng.random(), -rng.random(), -rng.random()) for r in range(reads) for t in rng.sample(range(refs), rng.choice([1, 1, 2, 3]))]
    return rows, "read_id long, ref_id long, bits double, tstart int, aln_len int, tlen int, p_read double, ll_a double, ll_m double"


def plain_step(rows, w, damage):
    """One EM step by loops."""
    mass = dict.fromkeys(w, 0.0)
    by_read: dict = {}
    for r in rows:
        s = np.log(max(w[r[1]], 1e-10)) - 0.5 * np.log(max(x[5] for x in rows if x[1] == r[1])) + r[2]
        if damage:
            s += np.logaddexp(np.log(r[6]) + r[7], np.log(1 - r[6]) + r[8])
        by_read.setdefault(r[0], []).append((r[1], s))
    ll = 0.0
    for hits in by_read.values():
        top = np.logaddexp.reduce([s for _, s in hits])
        ll += top
        for t, s in hits:
            mass[t] += np.exp(s - top)
    total = sum(mass.values())
    return {t: m / total for t, m in mass.items()}, ll


@pytest.mark.parametrize("damage", [False, True])
def test_em_equals_plain_loops(spark, damage):
    rows, schema = random_aln(5)
    df = spark.createDataFrame(rows, schema)
    w = {t: 1 / len({r[1] for r in rows}) for t in {r[1] for r in rows}}
    for _ in range(3):
        w, _ = plain_step(rows, w, damage)
    got = {r["ref_id"]: r["w"] for r in E.plain_em(df, 3, 1.0, damage=damage).collect()}
    assert got == pytest.approx(w, abs=1e-9)


@pytest.mark.parametrize("damage", [False, True])
def test_accelerated_em_climbs_and_settles(spark, damage):
    rows, schema = random_aln(9)
    w, trace = E.squarem(spark.createDataFrame(rows, schema), 1.0, tol=1e-7, max_iter=200, strict=True, damage=damage)
    got = {r["ref_id"]: r["w"] for r in w.collect()}
    assert sum(got.values()) == pytest.approx(1) and all(b >= a - 1e-6 for a, b in zip(trace, trace[1:]))
    assert plain_step(rows, got, damage)[0] == pytest.approx(got, abs=1e-3)  # a fixed point


def test_em_without_broadcast_is_alike(spark, monkeypatch):
    rows, schema = random_aln(11)
    df = spark.createDataFrame(rows, schema)
    small = {r["ref_id"]: r["w"] for r in E.plain_em(df, 2, 1.0).collect()}
    monkeypatch.setattr(E, "BROADCAST_REFS", 0)
    assert {r["ref_id"]: r["w"] for r in E.plain_em(df, 2, 1.0).collect()} == pytest.approx(small)


def test_em_on_empty_and_repeated_rows(spark):
    rows, schema = random_aln(3, reads=4)
    df = spark.createDataFrame(rows, schema)
    assert E.plain_em(df.limit(0), 2, 1.0).count() == 0
    twice = {r["ref_id"]: r["w"] for r in E.plain_em(df.unionByName(df), 1, 1.0).collect()}
    assert sum(twice.values()) == pytest.approx(1)


def test_coverage_em_prefers_evenly_covered(spark):
    """Two references share all reads; on one they start everywhere, on the other at one place."""
    rows = [(r, t, 1.0, (r * 3) % 80 if t == 1 else 0, 20, 100, 0.1, 0.0, 0.0) for r in range(40) for t in (1, 2)]
    w, rounds = E.coverage_em(spark.createDataFrame(rows, random_aln(1)[1]), 1.0)
    got = {r["ref_id"]: r["w"] for r in w.collect()}
    assert got[1] > 0.9 and 1 <= rounds <= 5


def test_em_query_runs_until_it_settles(spark, monkeypatch):
    from palisade.plans import alignment_queries as Q

    rows = [(0, 1, 1.0)] + [(i, ref, 1.0) for i in range(1, 51) for ref in (1, 2)]  # the share of 2 falls by a fiftieth a step
    monkeypatch.setattr(Q, "soft_alignments", lambda spark, sf_dir: aln(spark, rows))
    got = {r["ref_id"]: r["w"] for r in Q.em_squarem(spark, "").collect()}
    assert got[1] > 0.99 and got[2] < 0.01
    with pytest.raises(RuntimeError):
        E.squarem(aln(spark, rows), 1.0, max_iter=8, strict=True)


def test_em_recovers_unique_mapper_shares(spark):
    rows = [(i, 1 if i < 6 else 2 if i < 9 else 3, 1.0) for i in range(10)]
    got = {r["ref_id"]: r["w"] for r in E.plain_em(aln(spark, rows), 2, 1.0).collect()}
    assert np.allclose([got[1], got[2], got[3]], [0.6, 0.3, 0.1])


AA = "ARNDCQEGHILKMFPSTWYV"


def walk(q, t, qstart, tstart, qlen, reverse, d_max, rate, max_dist):
    """The annotation of one alignment, column by column."""
    table = {(a, b): (c, h) for a, b, c, h in N.SUBSTITUTIONS}
    i, j, out = qstart - 1, tstart - 1, dict(aligned=0, mismatches=0, m=0, k=0, high_conf=0, ct_sites=0, ga_sites=0, sum_decay=0.0, ll_a=0.0, ll_m=0.0)
    llr, sites = 0.0, []
    for x, y in zip(q, t):
        if x != "-" and y != "-":
            five, three = 3 * i, 3 * (qlen - 1 - i) if i < qlen else 0
            d5, d3 = (three, five) if reverse else (five, three)
            e = {"C": np.exp(-rate * d5), "G": np.exp(-rate * d3)}
            mine = [c for c in "CG" if y in N._classes(c)]
            hit = table.get((y, x))
            out["aligned"] += 1
            out["mismatches"] += x != y
            if mine:
                decay = max(e[c] for c in mine)
                out["m"] += 1
                out["sum_decay"] += decay
                out["ll_a"] += np.log(np.clip(d_max * e[hit[0]] + 0.005 if hit else 1 - d_max * decay - 0.005, 1e-8, 1 - 1e-8))
                out["ll_m"] += np.log(0.005 if hit else 0.995)
            if hit and (max_dist is None or (d5 if hit[0] == "C" else d3) <= max_dist):
                p = d_max * e[hit[0]]
                out["k"] += 1
                out["high_conf"] += hit[1]
                out["ct_sites" if hit[0] == "C" else "ga_sites"] += 1
                llr += min(max(np.log(max(p, 0.01) / 0.01), -3), 5)
                sites.append((i, j, y, x, hit[0], d5, d3, p))
        i += x != "-"
        j += y != "-"
    out["p_damaged"] = 1 / (1 + np.exp(-min(max(llr, -10), 10))) if out["k"] else 0.5 if max_dist is None else 0.0
    out["qend"], out["tend"] = i, j
    return out, sites


def gapped(rng):
    t = "".join(rng.choice(AA) for _ in range(30))
    swap = {a: b for a, b, _, _ in N.SUBSTITUTIONS}
    q = "".join(swap.get(c, c) if rng.random() < 0.3 else rng.choice(AA) if rng.random() < 0.1 else c for c in t)
    q, t = list(q), list(t)
    for s in (q, t):
        if rng.random() < 0.6:
            at = rng.randrange(1, 25)
            s[at:at + 3] = "---"
    return "".join(q), "".join(t), rng.randrange(1, 5), rng.randrange(1, 50), len(q) + rng.randrange(5), rng.random() < 0.5


@pytest.mark.parametrize("max_dist", [None, 9])
def test_annotation_equals_a_walk(spark, max_dist):
    rng = random.Random(17)
    rows = [(k, *gapped(rng)) for k in range(120)] + [(900, None, "AR", 1, 1, 2, False), (901, "", "", 1, 1, 0, True), (902, "---", "ARN", 1, 1, 3, None)]
    df = spark.createDataFrame(rows, "id long, qaln string, taln string, qstart int, tstart int, qlen int, reverse boolean").repartition(3)
    got = {r["id"]: r for r in N.annotate(df, 0.3, 0.3, max_dist).collect()}
    sites: dict = {}
    for r in N.site_rows(df, 0.3, 0.3, max_dist).collect():
        sites.setdefault(r["id"], []).append((r["query_pos"], r["target_pos"], r["target_aa"], r["query_aa"], r["damage_class"], r["dist_5prime"], r["dist_3prime"], pytest.approx(r["p_damage"])))
    fixed = {r["id"]: r["corrected"] for r in N.corrected(df).collect()}
    for k, q, t, *rest in rows:
        want, at = walk(q or "", t or "", *[x or 0 for x in rest], 0.3, 0.3, max_dist)
        assert {c: got[k][c] for c in want} == pytest.approx(want), k
        assert sorted(sites.get(k, []), key=lambda s: s[0]) == at
        if max_dist is None and q and t and len(q) == len(t):
            mend = {i: y for i, _, y, *_ in at}
            assert fixed[k] == "".join(mend.get(rest[0] - 1 + i, c) for i, c in enumerate(q.replace("-", "")))
    assert N.annotate(df.limit(0), 0.3, 0.3).count() == 0


def test_threshold_equals_a_scan_of_the_grid(spark):
    rng = random.Random(23)
    for k in range(4):
        rows = [(i, round(rng.random() ** 2 * 3, 3), rng.random() < 0.15 + 0.1 * k) for i in range(200)]
        got = D.threshold_for_fdr(spark.createDataFrame(rows, "id long, score double, is_decoy boolean"), 0.12).collect()
        want = None
        for i in range(int(np.ceil(max(s for _, s, _ in rows) * 100)), -1, -1):
            over = [d for _, s, d in rows if np.floor(s * 100) >= i]
            if (sum(over) / len(over) if over else 0.0) <= 0.12:
                want = i / 100
        assert got[0]["threshold"] == pytest.approx(want)


def test_q_values_and_auc_equal_loops(spark):
    rng = random.Random(29)
    rows = [(i, rng.randrange(40) / 7, rng.random() < 0.3) for i in range(300)]
    got = {r["id"]: r["q"] for r in D.q_values(spark.createDataFrame(rows, "id long, score double, is_decoy boolean")).collect()}
    fdr = {s: sum(d for _, x, d in rows if x >= s) / sum(x >= s for _, x, _ in rows) for s in {s for _, s, _ in rows}}
    assert got == pytest.approx({i: min(f for t, f in fdr.items() if t <= s) for i, s, d in rows if not d})
    lab = [(i, s, int(not d)) for i, s, d in rows]
    df = spark.createDataFrame(lab, "id long, score double, label int")
    pos, neg = [s for _, s, y in lab if y], [s for _, s, y in lab if not y]
    assert D.auc(df).first()["auc"] == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg))
    order = [y for _, _, y in sorted((-s, i, y) for i, s, y in lab)]
    assert D.auc_by_rows(df).first()["auc"] == pytest.approx(sum(sum(order[:k]) for k, y in enumerate(order) if not y) / len(pos) / len(neg))
    strata = {(r["half"], r["threshold"]): r["fdr"] for r in D.fdr_by_stratum(spark.createDataFrame([(i % 2, s, d) for i, s, d in rows], "half long, score double, is_decoy boolean"), "half", [1.0, 3.0]).collect()}
    over = [d for i, s, d in rows if i % 2 and s >= 3.0]
    assert strata[1, 3.0] == pytest.approx(sum(over) / len(over))


def test_running_values_over_ranges(spark):
    rng = random.Random(31)
    xs = [rng.randrange(1000) / 10 for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for q in (0, 137, 499):
        assert lower_rank(df, "x", str(q)).first()["x"] == sorted(xs)[q]
    one = Ranges(df.distinct().withColumn("k", F.lit(1)), "x").previous("p", "x").sums(n="k").result().orderBy("x").collect()
    want = sorted(set(xs))
    assert [(r["x"], r["p"], r["n"]) for r in one] == [(x, want[i - 1] if i else None, i + 1) for i, x in enumerate(want)]


def test_minimizers_equal_loops(spark):
    rng = random.Random(37)
    seqs = [(i, "".join(rng.choice("ACGT" if i % 3 else "ACGTN") for _ in range(rng.randrange(0, 90)))) for i in range(30)] + [(99, None)]
    got: dict = {}
    for r in K.minimizers(spark.createDataFrame(seqs, "doc_id long, seq string"), k=5, window=6).collect():
        got.setdefault(r["doc_id"], set()).add(r["h"])
    for i, s in seqs:
        h = []
        for a in range(len(s or "") - 4):
            w = s[a:a + 5]
            codes = [sum("ACGT".index(c) * 4 ** (4 - n) for n, c in enumerate(x)) for x in (w, w[::-1].translate(str.maketrans("ACGT", "TGCA")))] if "N" not in w else None
            h.append(min(codes) * K.MULTIPLIER % K.PRIME if codes else float("inf"))
        low = sorted({min(h[a:a + 6]) for a in range(len(h) - 5)} - {float("inf")})[:4]
        assert got.get(i, set()) == set(low)


def test_six_frames_equal_codon_by_codon(spark):
    rng = random.Random(41)
    seqs = ["".join(rng.choice("ACGTN") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 30, 31)] + [None]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i long, s string").select("i", S.six_frames("s").alias("p")).collect()
    for r in got:
        s = seqs[r["i"]]
        if s is None:
            assert r["p"] == [None] * 6
            continue
        back = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert r["p"] == ["".join(S.CODONS.get(x[f + k:f + k + 3], "X") for k in range(0, len(x) - f - 2, 3)) for x in (s, back) for f in range(3)]


def test_validation_joins(spark):
    truth = spark.createDataFrame([("a", "+", 0), ("b", "-", 1), ("c", "+", 2)], "read_id string, strand string, frame int")
    calls = spark.createDataFrame([("a", "+", 1, 0.2), ("a", "+", 0, 0.1), ("b", "+", 1, 0.9), ("z", "+", 0, 0.5)], "read_id string, strand string, frame int, score double")
    got = {r["read_id"]: (r["hit"], r["strand_ok"], r["frame_ok"], r["best"]) for r in R.validated(truth, calls).collect()}
    assert got == {"a": (True, True, True, 0.2), "b": (True, False, False, 0.9), "c": (False, False, False, None)}
    assert [r["read_id"] for r in R.unexpected(truth, calls).collect()] == ["z"]


def test_settings_presets():
    s = R.Settings(min_identity=0.5).strict()
    assert s.min_reads == 5 and s.min_identity == 0.5 and s.loose().min_reads == 1
    assert (s.min_breadth, s.min_depth, s.calibrate, s.min_damage_sites) == (0.2, 1.0, True, 5) and s.min_positional == s.min_terminal == 0
    assert s.loose().min_damage_sites == 1 and R.Settings(min_positional=0.3).loose().min_positional == 0.3


def test_calibration_has_a_gate_and_only_raises(spark):
    rows = [(i, 12, 5, i / 200, 1 - i / 200) for i in range(120)] + [(500 + i, 3, 5, 0.0, 0.0) for i in range(50)]
    df = spark.createDataFrame(rows, "ref_id long, n_reads long, n_unique_starts long, positional_score double, terminal_middle_ratio double")
    got = R.calibrated(df, R.Settings(calibrate=True, min_positional=0.01))
    assert got.min_positional == sorted(i / 200 for i in range(120))[6] and got.min_terminal == pytest.approx(sorted(1 - i / 200 for i in range(120))[6])
    assert R.calibrated(df, R.Settings(calibrate=True, min_positional=0.9)).min_positional == 0.9 and R.calibrated(df, R.Settings()) == R.Settings()
    assert R.calibrated(df.where("ref_id < 99"), R.Settings(calibrate=True)) == R.Settings(calibrate=True)
    low = df.withColumn("terminal_middle_ratio", F.lit(0.1))
    assert R.calibrated(low, R.Settings(calibrate=True)).min_terminal == 0.20


def test_order_of_the_level(spark):
    hits = spark.createDataFrame([(1, "a_+_0", 7, 50.0, 0.9, 6, 1, 6, "WKYAAA", "RKHAAA", 1, 6)], "row_id long, query_id string, ref_id long, bits double, fident double, aln_len int, tstart long, tlen long, qaln string, taln string, qstart int, qlen int")
    s = R.Settings(d_max=0.1, rate=0.2)
    assert R.resolved(s, hits, {"d_max": 0.4, "rate": 0.5}, {"d_max": 0.3}, ("d_max",)) == s
    got = R.resolved(s, hits, {"d_max": 0.4, "rate": 0.5}, {"d_max": 0.3})
    assert (got.d_max, got.rate) == (0.4, 0.5) and R.resolved(s, hits, {"d_max": 0.4, "rate": 0.5}, given=("rate",)).rate == 0.2
    assert R.resolved(s, hits, {"d_max": 0.0}, {"d_max": 0.3, "rate": 0.0}).d_max == 0.3 and R.resolved(s, hits, None, {"d_max": 0.3, "rate": 0.0}).rate == 0.2
    assert 0 <= R.resolved(s, hits).d_max <= 0.5 and R.median_sites(hits) == 1 and R.median_sites(hits.limit(0)) == 3
    assert R.median_sites(hits.withColumn("qlen", F.lit(47))) == 4


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r["node"]: r["root"] for r in K.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[101] == 100


def test_sequence_functions(spark):
    r = spark.createDataFrame([("ATGTAAGN", "read_-_2")], "s string, id string").select(
        S.reverse_complement("s").alias("rc"), S.translate("s").alias("p"), S.kmers("s", 6).alias("k"), S.strand("id").alias("st"), S.frame("id").alias("fr"), S.strip_frame_suffix("id").alias("n")).first()
    assert (r["rc"], r["p"], r["k"], r["st"], r["fr"], r["n"]) == ("NCTTACAT", "M*", ["ATGTAA", "TGTAAG", "GTAAGN"], "-", 2, "read")


def test_numerics():
    assert np.allclose(stats.digamma(np.array([1.0, 5.0])), [-0.5772156649, 1.5061176684])
    assert np.allclose(stats.trigamma(np.array([1.0])), [np.pi ** 2 / 6])
    assert np.allclose(stats.lgamma(np.array([0.5, 10.0])), [np.log(np.pi) / 2, np.log(362880.0)])
    x = stats.beta_cdf(np.array([0.3, 0.9]), np.array([2.0, 2.0]), np.array([3.0, 3.0]))
    assert np.allclose(x, [1 - 0.7 ** 4 - 4 * 0.3 * 0.7 ** 3, 1 - 0.1 ** 4 - 4 * 0.9 * 0.1 ** 3])
    assert np.allclose(stats.beta_cdf(stats.beta_quantile(np.array([0.2]), 3.0, 4.0), 3.0, 4.0), 0.2)


def test_protein_damage_fit(spark):
    df = spark.createDataFrame([(20.0, 18.0, 17.0), (0.0, 0.0, 0.0)], "n double, k double, k2 double")
    high, empty = [r["x"] for r in df.select(stats.protein_damage("n", "k", "k2").alias("x")).collect()]
    assert high["p_damaged"] > 0.9 and high["ci_lower"] < high["delta_mle"] < high["ci_upper"] and empty["p_damaged"] == pytest.approx(0.5)


def test_protein_damage_equals_a_scan():
    """The maximum, the interval and the test by a fine scan with the standard library's log-gamma."""
    from math import erfc, lgamma

    for n, k, k2 in ((12, 5.5, 3.2), (40, 2.0, 0.4), (6, 6.0, 6.0), (25, 0.0, 0.0), (100, 61.0, 45.0)):
        got = {c: float(v[0]) for c, v in stats.fit_share(*(np.array([float(x)]) for x in (n, k, k2))).items()}
        guess = min(max((k + 1) / (n + 2), 0.01), 0.99)
        phi = min(max(guess * (1 - guess) / max(k2 / n - (k / n) ** 2, 1e-6) - 1, 2), 1000)
        lb = lambda a, b: lgamma(a) + lgamma(b) - lgamma(a + b)
        ts = [1e-6, *[i / 5000 for i in range(1, 5000)], 1 - 1e-6]
        ll = [lb(k + t * phi, n - k + (1 - t) * phi) - lb(t * phi, (1 - t) * phi) for t in ts]
        top = max(ll)
        inside = [t for t, v in zip(ts, ll) if top - v < 1.92]
        assert got["delta_mle"] == pytest.approx(ts[ll.index(top)], abs=3e-4)
        assert (got["ci_lower"], got["ci_upper"]) == pytest.approx((inside[0], inside[-1]), abs=5e-4)
        assert got["lrt_pvalue"] == pytest.approx(erfc(max(0.0, top - ll[0]) ** 0.5), abs=1e-4)


def test_metamorphic_partitions(spark):
    rows = [(i % 11, i % 5, float(i * 37 % 101)) for i in range(60)]
    a = A.best_hits(aln(spark, rows)).orderBy("read_id").select("read_id", "ref_id", "bits").collect()
    b = A.best_hits(aln(spark, rows).repartition(7, F.col("bits"))).orderBy("read_id").select("read_id", "ref_id", "bits").collect()
    assert a == b


def test_validation_table_has_every_column(spark):
    truth = spark.createDataFrame([("a", "+", 0, "MKVL", 15), ("b", "-", 1, "MK", 8), ("c", "+", 2, None, 9), ("d", "+", 0, "M", 4)], "read_id string, strand string, frame int, sequence string, length int")
    calls = spark.createDataFrame([("a", "+", 1, 0.2, 9.0, 0.1), ("a", "+", 0, 0.1, 8.0, 0.7), ("b", "+", 1, 0.9, 1.0, None), ("c", "+", 2, 0.5, 2.0, 0.3), ("z", "+", 0, 0.5, 0.0, 0.0)], "read_id string, strand string, frame int, score double, damage_pct double, damage_signal double")
    proteins = spark.createDataFrame([("a", "+", "MKIL"), ("a", "+", "MAAA"), ("a", "-", "MKVL"), ("b", "+", "MK"), ("c", "+", "M")], "read_id string, strand string, sequence string")
    rows = R.validation_rows(truth, calls, proteins)
    got = {r["read_id"]: tuple(r)[1:] for r in rows.collect()}
    assert rows.columns == R.VALIDATION and set(got) == {"a", "b", "c"}
    assert got["a"] == (15, "+", 1, "+", 0, 0.2, 9.0, 0.7, 1, 1, 1, 0.75) and got["b"] == (8, "+", 1, "-", 1, 0.9, 1.0, None, 0, 0, 0, None)
    assert R.validation_rows(truth.limit(0), calls, proteins).count() == 0


def test_enrichment_calls_and_flags(spark):
    df = spark.createDataFrame([(1, 40.0, 50.0, 0.9), (2, 0.0, 2.0, 0.05), (3, 5.0, 50.0, 0.5), (4, 0.0, 0.0, 0.0)], "ref_id long, n_ancient double, eff_reads double, breadth double")
    got = {r["ref_id"]: r for r in R.enrichment(df).collect()}
    assert (got[1]["enriched"], got[1]["low_count"], got[1]["low_breadth"]) == (1, 0, 0) and got[1]["theta_post"] == pytest.approx(41 / 60) and got[1]["theta_low"] < 41 / 60 < got[1]["theta_high"]
    assert (got[2]["enriched"], got[2]["low_count"], got[2]["low_breadth"]) == (0, 1, 1) and got[3]["enriched"] == 0 and got[3]["theta_raw"] == pytest.approx(0.1) and got[4]["theta_raw"] == 0
    grid = np.linspace(0, 1, 400_001)[1:-1]
    dens = np.exp(5 * np.log(grid) + 53 * np.log(1 - grid))
    assert got[3]["p_enriched"] == pytest.approx(dens[grid > 0.15].sum() / dens.sum(), abs=1e-3)


def test_target_profile_counts_both_ends(spark):
    reads = spark.createDataFrame([("r1", "TTGA"), ("r2", "ctgg"), ("r3", "A"), ("r4", None), ("r5", "TTTT")], "read_id string, seq string")
    targets = spark.createDataFrame([("r1", 1), ("r2", 1), ("r3", 2), ("r4", 2)], "read_id string, target long")
    got = {r["target"]: r for r in R.target_profile(reads, targets, 3).collect()}
    assert (got[1]["n_reads"], got[1]["tc_0"], got[1]["tc_1"], got[1]["tc_2"]) == (2, 0.5, 1.0, 0.5) and (got[1]["ag_0"], got[1]["ag_1"]) == (0.5, 0.0)
    assert (got[2]["n_reads"], got[2]["tc_0"], got[2]["ag_0"], got[2]["ag_1"]) == (2, 0.5, 1.0, 0.5)
    assert [r["target"] for r in R.target_profile(reads, targets, 3, 3).collect()] == [] and len(R.target_profile(reads, targets).columns) == 52


@pytest.mark.parametrize("direct", [0, 8_000_000])
def test_em_vectors_over_many_rows_and_blocks(spark, monkeypatch, direct):
    """Packed rows of a few alignments and blocks of three references give what plain loops give, without a table an iteration."""
    from palisade.operators import em_vectors as V

    for name, value in (("ROW", 7), ("BLOCK", 3), ("DIRECT", direct), ("KEPT", 50)):
        monkeypatch.setattr(V, name, value)
    rows, schema = random_aln(21)
    df = spark.createDataFrame(rows, schema)
    refs = sorted({r[1] for r in rows})
    problem, w = E.problem_of(df, 1.0), dict.fromkeys(refs, 1 / len(refs))
    x = problem.uniform()
    assert isinstance(problem, V.Vectors)
    for _ in range(3):
        w, ll = plain_step(rows, w, False)
        x, objective = problem.step(x)
        assert dict(zip(refs, x)) == pytest.approx(w, abs=1e-12) and objective == pytest.approx(ll)
    problem.close()


def test_coverage_em_vectors_and_tables_are_alike(spark, monkeypatch):
    from palisade.operators import em_vectors as V

    rows, schema = random_aln(23, reads=120)
    rows += [(500, None, 1.0, 1, 20, None, 0.1, -0.1, -0.1), (501, 2, 1.0, None, 20, 80, 0.1, -0.1, -0.1), (None, 3, 1.0, 4, None, 90, 0.1, -0.1, -0.1), (None, 1, 2.0, 4, 12, 70, 0.1, -0.1, -0.1)]
    df = spark.createDataFrame(rows, schema)
    monkeypatch.setattr(V, "BLOCK", 3)
    got = {r["ref_id"]: r["w"] for r in E.coverage_em(df, 1.0, rounds=2, tol=0.0, inner=2)[0].collect()}
    monkeypatch.setattr(E, "BROADCAST_REFS", 0)
    want = {r["ref_id"]: r["w"] for r in E.coverage_em(df, 1.0, rounds=2, tol=0.0, inner=2)[0].collect()}
    assert got == pytest.approx(want, abs=1e-9) and len(got) == 9
