"""Queries on alignments: filters, best hits, expectation-maximisation, coverage and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.functions.stats import beta_at, beta_below, wilson
from palisade.functions.stats import protein_damage as protein_fit
from palisade.operators import alignments as A
from palisade.operators import coverage as C
from palisade.operators import em as E
from palisade.operators.ranges import lower_rank
from palisade.plans.adapters import ALN, SOFT, alignments, soft_alignments
from palisade.session import cut, table
from palisade.streaming import incremental as I

R = 6
KEY = ["read_id", "ref_id", "bits", "fident", "aln_len", "sk", "ln"]


def r(name: str, digits: int = R):
    return F.round(name, digits).alias(name)


def _gammaed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments with g, the alignment's share of its read by identity: a stand-in for responsibilities."""
    a = alignments(spark, sf_dir)
    return a.withColumn("g", F.col("fident") / F.sum("fident").over(W.partitionBy("read_id")))


GAMMA = ALN + ", ga AS (SELECT *, fident/sum(fident) OVER (PARTITION BY read_id) AS g FROM aln)"


def filter_alignments(spark, sf_dir):
    return A.keep(alignments(spark, sf_dir), A.filters(0.9, 20.0, 10)).select(*KEY)


def filter_counts(spark, sf_dir):
    return A.first_failing(alignments(spark, sf_dir), A.filters(0.9, 20.0, 10))


def best_hit_top2(spark, sf_dir):
    return A.best_hits(alignments(spark, sf_dir)).select("read_id", "ref_id", "bits", "bits_second", r("delta_bits"), "degree")


def unique_mappers(spark, sf_dir):
    return A.unique_mappers(alignments(spark, sf_dir)).select(*KEY)


def qlen_quantiles(spark, sf_dir):
    return A.lower_rank_quantile(alignments(spark, sf_dir), "aln_len", 0.2, ["ref_id"])


def em_weights_3(spark, sf_dir):
    return E.plain_em(soft_alignments(spark, sf_dir), 3, 1.0).select("ref_id", F.round("w", 9).alias("w"))


def em_damage_weights_3(spark, sf_dir):
    return E.plain_em(soft_alignments(spark, sf_dir), 3, 1.0, damage=True).select("ref_id", F.round("w", 9).alias("w"))


def em_assignments(spark, sf_dir):
    a = soft_alignments(spark, sf_dir)
    g = E.e_step(a.drop("tlen"), E.plain_em(a, 1, 1.0), 1.0)
    return E.assignments(g).select("read_id", "ref_id", r("gamma"), r("em_margin"), r("em_ref_neff"))


def em_squarem(spark, sf_dir):
    """Converged weights, or an error; an iterative solver, so there is no SQL for it."""
    w, _ = E.squarem(soft_alignments(spark, sf_dir), 1.0, tol=1e-6, max_iter=200, strict=True)
    return w.select("ref_id", F.round("w", 6).alias("w"))


def coverage_em_2(spark, sf_dir):
    """Two rounds of coverage-aware EM with one inner step each, without the last fit."""
    w, _ = E.coverage_em(soft_alignments(spark, sf_dir), 1.0, rounds=2, tol=0.0, inner=1, refit=False)
    return w.select("ref_id", F.round("w", 9).alias("w"))


def coverage_kl_adaptive(spark, sf_dir):
    """Start positions against uniform ones over as many bins as each reference's reads bear."""
    k = C.adaptive_kl(_gammaed(spark, sf_dir))
    return k.join(C.coverage_weight(k, b=F.col("b")), "ref_id").select("ref_id", "b", r("n_eff"), r("kl"), r("deviance", 5), r("coverage_weight"))


def coverage_em(spark, sf_dir):
    """Coverage-aware weights, rounds and inner fits until they settle; iterative, so the unrolled rounds have SQL instead."""
    w, _ = E.coverage_em(soft_alignments(spark, sf_dir), 1.0)
    return w.select("ref_id", F.round("w", 6).alias("w"))


def em_squarem_damage(spark, sf_dir):
    """Converged weights of the two-state model; iterative, so the fixed steps of em_damage_weights_3 have SQL instead."""
    w, _ = E.squarem(soft_alignments(spark, sf_dir), 1.0, tol=1e-6, max_iter=200, strict=True, damage=True)
    return w.select("ref_id", F.round("w", 6).alias("w"))


def gene_coverage(spark, sf_dir):
    return C.depth_stats(_gammaed(spark, sf_dir)).select("ref_id", r("breadth"), r("depth_mean"), r("depth_std", 5), r("depth_evenness", 5))


def gene_positional(spark, sf_dir):
    return C.positional_stats(alignments(spark, sf_dir)).select("ref_id", "n_reads", "n_unique_starts", r("start_diversity"), r("start_span"), r("positional_score"))


def protein_terminal_ratio(spark, sf_dir):
    return C.terminal_ratio(_gammaed(spark, sf_dir)).select("ref_id", r("terminal_middle_ratio", 5))


def coverage_kl(spark, sf_dir):
    return C.kl(_gammaed(spark, sf_dir)).select("ref_id", r("n_eff"), r("kl"), r("deviance", 5))


def coverage_weight(spark, sf_dir):
    return C.coverage_weight(C.kl(_gammaed(spark, sf_dir))).select("ref_id", r("coverage_weight"))


def _summary(spark, sf_dir):
    a = cut(_gammaed(spark, sf_dir).select("ref_id", "tstart", "aln_len", "tlen", "g", "p_read", "fident"), "gammas")  # read by four aggregations
    dam = (F.col("p_read") > 0.04).cast("double")
    base = a.groupBy("ref_id").agg(
        F.count("*").alias("n_reads"), F.sum("g").alias("eff_reads"), F.sum(F.col("g") * dam).alias("n_ancient"), F.sum(F.col("g") * (1 - dam)).alias("n_modern"),
        (F.sum(F.col("g") * F.col("fident")) / F.sum("g")).alias("mean_identity"), (F.sum(F.col("g") * F.col("aln_len")) / F.sum("g")).alias("avg_aln_len"),
        (F.sum(F.col("g") * F.col("p_read")) / F.sum("g")).alias("mean_posterior"))
    low, high = wilson("n_ancient", "eff_reads")
    base = base.withColumn("ancient_frac", F.col("n_ancient") / F.col("eff_reads")).withColumn("ci_low", low).withColumn("ci_high", high)
    return base.join(C.depth_stats(a), "ref_id", "left").join(C.positional_stats(a).drop("n_reads"), "ref_id").join(C.terminal_ratio(a), "ref_id")


def gene_summary(spark, sf_dir):
    """Flagship: assignment, coverage, position and damage statistics of every reference."""
    s = _summary(spark, sf_dir)
    six = ["eff_reads", "n_ancient", "n_modern", "mean_identity", "avg_aln_len", "mean_posterior", "ancient_frac", "ci_low", "ci_high", "breadth", "depth_mean", "start_diversity", "start_span", "positional_score"]
    return s.select("ref_id", "n_reads", "n_unique_starts", *[r(c) for c in six], r("terminal_middle_ratio", 5))


def _failures(spark, sf_dir):
    s = _summary(spark, sf_dir)
    rules = [("n_reads", F.col("n_reads") >= 28), ("breadth", F.col("breadth") >= 0.9), ("depth", F.col("depth_mean") >= 1.5), ("positional", F.col("positional_score") >= 0.8), ("terminal", F.col("terminal_middle_ratio") >= 0.5)]
    why = F.concat_ws(",", F.array_compact(F.array(*[F.when(ok, F.lit(None)).otherwise(name) for name, ok in rules])))
    return s.withColumn("filter_fail", F.when(why == "", ".").otherwise(why))


def protein_filter_fail(spark, sf_dir):
    return _failures(spark, sf_dir).select("ref_id", "n_reads", "filter_fail", (F.col("filter_fail") == ".").cast("int").alias("pass_mapping_filter"))


def combined_outer(spark, sf_dir):
    """Full outer merge of the gene side (assignments) and the protein side (damaged reads) of each reference, with groups."""
    a = alignments(spark, sf_dir)
    genes = A.best_hits(a).groupBy("ref_id").agg(F.count("*").alias("n_reads"), F.sum("bits").alias("sum_bits"))
    proteins = a.where("p_read >= 0.07 and fident >= 0.94").groupBy("ref_id").agg(F.count("*").alias("n_damage"), F.max("p_read").alias("max_p"))
    j = genes.withColumn("g", F.lit(1)).join(proteins.withColumn("p", F.lit(1)), "ref_id", "full")
    groups = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref_id"), F.col("p_brand").alias("group_id"))
    j = j.join(groups, "ref_id", "left")
    fail = F.concat_ws(",", F.array_compact(F.array(F.when(F.col("g").isNull(), "no_gene"), F.when(F.col("p").isNull(), "no_protein"))))
    return j.select("ref_id", F.coalesce("group_id", F.lit(".")).alias("group_id"), F.coalesce("g", F.lit(0)).alias("gene_present"), F.coalesce("p", F.lit(0)).alias("protein_present"),
                    F.coalesce("n_reads", F.lit(0)).alias("n_reads"), F.round(F.coalesce("sum_bits", F.lit(0.0)), 6).alias("sum_bits"), F.coalesce("n_damage", F.lit(0)).alias("n_damage"),
                    F.coalesce("max_p", F.lit(0.0)).alias("max_p"), F.when(fail == "", ".").otherwise(fail).alias("filter_fail"))


def function_rollup(spark, sf_dir):
    """Groups of references: sums, means, spreads and the enrichment of damaged reads over the whole table's share."""
    a = _gammaed(spark, sf_dir)
    genes = a.groupBy("ref_id").agg(F.sum("g").alias("eff"), F.sum(F.when(F.col("p_read") > 0.04, F.col("g")).otherwise(0.0)).alias("anc"), (F.sum(F.col("g") * F.col("fident")) / F.sum("g")).alias("ident"), F.sum(F.col("g") * F.col("aln_len")).alias("bases"), F.max("tlen").alias("tlen"))
    genes = genes.withColumn("depth", F.col("bases") / F.col("tlen"))
    groups = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref_id"), F.col("p_brand").alias("function_id"))
    s = genes.join(groups, "ref_id").groupBy("function_id").agg(
        F.count("*").alias("n_genes"), F.sum(F.round("eff").cast("long")).alias("n_reads"), F.sum("eff").alias("eff"), F.sum("anc").alias("anc"), F.avg("depth").alias("coverage_mean"),
        F.sqrt(F.greatest(F.avg(F.col("depth") ** 2) - F.avg("depth") ** 2, F.lit(0.0))).alias("coverage_stdev"), F.avg("ident").alias("avg_identity"))
    totals = s.agg(F.sum("anc").alias("ta"), F.sum("eff").alias("te"))
    s = s.crossJoin(F.broadcast(totals))  # one row
    frac = F.col("anc") / F.col("eff")
    low, high = wilson("anc", "eff")
    return s.select("function_id", "n_genes", "n_reads", F.round(frac, R).alias("ancient_frac"), F.round(low, R).alias("ci_low"), F.round(high, R).alias("ci_high"),
                    F.round(frac / (F.col("ta") / F.col("te")), R).alias("damage_enrichment"), r("coverage_mean"), r("coverage_stdev", 5), r("avg_identity"))


def spurious_calibration(spark, sf_dir):
    """Fifth percentile (element n div 20) of the positional score of references with enough reads and starts; at least the floor."""
    p = C.positional_stats(alignments(spark, sf_dir)).where("n_reads >= 10 and n_unique_starts >= 3")
    return lower_rank(p, "positional_score", "n div 20").select(F.round(F.greatest("positional_score", F.lit(0.2)), R).alias("threshold"), F.col("n").alias("n_genes"))


def length_bin_z(spark, sf_dir):
    """Bits per aligned residue against the mean and population spread of the alignment's length bin."""
    b = A.best_hits(alignments(spark, sf_dir)).withColumn("bpa", F.col("bits") / F.col("aln_len"))
    b = b.withColumn("length_bin", F.when(F.col("aln_len") < 12, 0).when(F.col("aln_len") < 25, 1).when(F.col("aln_len") < 40, 2).otherwise(3))
    s = b.groupBy("length_bin").agg(F.count("*").alias("n"), F.avg("bpa").alias("m"), F.stddev_pop("bpa").alias("s"))
    z = F.when((F.col("n") >= 10) & (F.col("s") > 0), (F.col("bpa") - F.col("m")) / F.col("s")).otherwise(0.0)
    return b.join(F.broadcast(s), "length_bin").select("read_id", "ref_id", "length_bin", "bpa", F.round(z, 5).alias("z_bpa"))  # four rows


def _baseline(k, m):
    return F.least(F.greatest((k + 1) / (m + 200), F.lit(1e-4)), F.lit(0.02))


def modern_baseline(spark, sf_dir):
    """Posterior mean of the modern mismatch rate over reads of low damage (p_read within the 20th percentile, lower rank)."""
    a = alignments(spark, sf_dir)
    q = lower_rank(a, "p_read", "floor(0.2D * (n - 1))").select(F.least(F.greatest("p_read", F.lit(0.02)), F.lit(0.35)).alias("limit"))
    low = a.join(F.broadcast(q), a["p_read"] <= q["limit"])  # one row
    s = low.agg(F.sum(F.floor((1 - F.col("fident")) * 10)).alias("k"), F.sum("aln_len").alias("m"), F.count("*").alias("n"))
    return s.select(F.round(_baseline(F.col("k"), F.col("m")), 9).alias("baseline"), F.col("n").alias("n_proxy"))


def stratified_baseline(spark, sf_dir):
    """Baselines of four length strata shrunk towards the whole by n / (n + 100); stratum -1 is the whole."""
    a = alignments(spark, sf_dir).withColumn("stratum", F.least(F.floor(F.col("aln_len") / 13), F.lit(3)))
    s = a.rollup("stratum").agg(F.sum(F.floor((1 - F.col("fident")) * 10)).alias("k"), F.sum("aln_len").alias("m"), F.count("*").alias("n"))
    s = s.withColumn("b", _baseline(F.col("k"), F.col("m")))
    whole = s.where("stratum is null").select(F.col("b").alias("g"))
    lam = F.col("n") / (F.col("n") + 100)
    s = s.crossJoin(F.broadcast(whole))  # one row
    return s.select(F.coalesce("stratum", F.lit(-1)).alias("stratum"), "n", F.round(F.when(F.col("stratum").isNull(), F.col("b")).otherwise(lam * F.col("b") + (1 - lam) * F.col("g")), 9).alias("baseline"))


def wilson_intervals(spark, sf_dir):
    a = alignments(spark, sf_dir).groupBy("ref_id").agg(F.count("*").alias("n"), F.sum((F.col("p_read") > 0.04).cast("long")).alias("k"))
    low, high = wilson("k", "n")
    return a.select("ref_id", "n", "k", F.round(low, R).alias("ci_low"), F.round(high, R).alias("ci_high"))


def dictionary_ids(spark, sf_dir):
    """Dense ids of distinct names in sorted order."""
    return A.dictionary(table(spark, sf_dir, "part"), "p_name")


def event_counts(spark, sf_dir):
    """Hourly counts by type; an extension, as alignments have no event time."""
    return I.event_counts(table(spark, sf_dir, "events").where("ts is not null")).select("start", "event_type", "n", r("total", 4))


def completeness(spark, sf_dir):
    a = _gammaed(spark, sf_dir)
    return C.completeness(C.bins(a), C.kl(a)).select("ref_id", r("completeness", 5))


def protein_damage(spark, sf_dir):
    """Beta-binomial damage fit of every reference; numeric, so there is no SQL for it."""
    s = alignments(spark, sf_dir).groupBy("ref_id").agg(F.count("*").cast("double").alias("n"), F.sum("p_read").alias("k"), F.sum(F.col("p_read") ** 2).alias("k2"))
    return s.select("ref_id", protein_fit("n", "k", "k2").alias("f")).select("ref_id", *[F.round(f"f.{c}", 6).alias(c) for c in ("p_damaged", "delta_mle", "ci_lower", "ci_upper", "lrt_pvalue", "log_bf")])


def gene_posterior(spark, sf_dir):
    """Beta posterior of each reference's damaged share: mean, 95 % interval and probability of more than 15 %; numeric, no SQL."""
    s = alignments(spark, sf_dir).groupBy("ref_id").agg(F.sum((F.col("p_read") > 0.04).cast("double")).alias("k"), F.count("*").cast("double").alias("n"))
    a, b = F.col("k") + 1.0, F.col("n") - F.col("k") + 9.0
    s = s.withColumn("a", a).withColumn("b", b)
    at = lambda p: beta_at(F.lit(p), F.col("a"), F.col("b"))
    return s.select("ref_id", F.round(F.col("a") / (F.col("a") + F.col("b")), 6).alias("mean"), F.round(at(0.025), 6).alias("low"), F.round(at(0.975), 6).alias("high"), F.round(1 - beta_below(F.lit(0.15), F.col("a"), F.col("b")), 6).alias("p_enriched"))


def group_map(spark, sf_dir):
    """Reference to group, a repeated key's last row winning; here keys repeat through lineitem's supplier order."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ref_id"), F.col("l_suppkey").alias("grp"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity").alias("o"))
    return A.last_mapping(li, "ref_id", "grp", "o").select("ref_id", "grp")


BEST = """best AS (SELECT *, row_number() OVER w AS rn, lead(bits) OVER w AS nxt, count(*) OVER (PARTITION BY read_id) AS degree FROM aln
 WINDOW w AS (PARTITION BY read_id ORDER BY bits DESC, ref_id, sk, ln, aln_len, p_read))"""
SEGMENTS = """ev AS (SELECT ref_id, tlen, unnest([lo, hi]) AS pos, unnest([g, -g]) AS d, unnest([1, -1]) AS k FROM
 (SELECT ref_id, tlen, g, least(greatest(tstart,0),tlen) AS lo, least(tstart+aln_len, tlen) AS hi FROM ga) WHERE hi > lo),
sm AS (SELECT ref_id, pos, max(tlen) AS tlen, sum(d) AS d, sum(k) AS k FROM ev GROUP BY ALL),
rn AS (SELECT *, sum(d) OVER w AS depth, sum(k) OVER w AS op, lead(pos) OVER w AS stop FROM sm WINDOW w AS (PARTITION BY ref_id ORDER BY pos)),
ds AS (SELECT ref_id, max(tlen) AS tlen, sum(stop-pos) AS cov, sum((stop-pos)*depth) AS d1, sum((stop-pos)*depth*depth) AS d2 FROM rn WHERE op > 0 GROUP BY ref_id),
dst AS (SELECT ref_id, cov/tlen AS breadth, d1/tlen AS depth_mean, sqrt(greatest(d2/tlen - (d1/tlen)*(d1/tlen), 0)) AS depth_std FROM ds)"""
POSITIONAL = """ps AS (SELECT ref_id, count(*) AS n_reads, count(DISTINCT tstart) AS n_unique_starts, count(DISTINCT tstart)/least(count(*), max(tlen)) AS start_diversity,
 (max(tstart)-min(tstart)+1)/max(tlen) AS start_span FROM aln GROUP BY ref_id), pst AS (SELECT *, sqrt(start_diversity*start_span) AS positional_score FROM ps)"""
TERMINAL = """sp AS (SELECT *, least(greatest(tlen // 10, 1), tlen // 2) AS e, least(greatest(tstart,0),tlen) AS lo, least(tstart+aln_len, tlen) AS hi FROM ga),
tm AS (SELECT ref_id, max(tlen) AS tl, max(e) AS e, count(*) AS n, sum(g*aln_len) AS glen, sum(greatest(least(hi,e)-lo,0)*g) AS lm,
 sum(greatest(hi-greatest(lo,tlen-e),0)*g) AS rm, sum(greatest(least(hi,tlen-e)-greatest(lo,e),0)*g) AS m FROM sp GROUP BY ref_id),
tr AS (SELECT *, CAST(least(floor(glen/n), tl) AS BIGINT) AS rl FROM tm),
pos AS (SELECT tl, rl, e, unnest(range(0, tl)) AS p FROM (SELECT DISTINCT tl, rl, e FROM tr WHERE tl >= 4 AND rl > 0)),
cv AS (SELECT *, greatest(least(p, tl-rl) - greatest(p-rl+1, 0) + 1, 0) AS c FROM pos),
ex AS (SELECT tl, rl, (sum(CASE WHEN p < e OR p >= tl-e THEN c ELSE 0 END)/(2*max(e))) / nullif(sum(CASE WHEN p >= e AND p < tl-e THEN c ELSE 0 END)/(max(tl)-2*max(e)), 0) AS expected FROM cv GROUP BY tl, rl),
tx AS (SELECT tr.*, coalesce(expected, 1) AS ex FROM tr LEFT JOIN ex USING (tl, rl)),
ty AS (SELECT ref_id, ex, CASE WHEN m/(tl-2*e) > 0 THEN (least(lm,rm)/e)/(m/(tl-2*e)) WHEN least(lm,rm) > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END AS ratio FROM tx),
tz AS (SELECT ref_id, CASE WHEN ex > 0.01 THEN ratio/ex ELSE ratio END AS terminal_middle_ratio FROM ty)"""


def _wilson(k: str, n: str) -> tuple[str, str]:
    z = "CAST(1.96 AS DOUBLE)"
    den = f"(1+{z}*{z}/({n}))"
    mid = f"(({k})/({n})+{z}*{z}/(2*({n})))/{den}"
    half = f"{z}*sqrt(({k})/({n})*(1-({k})/({n}))/({n})+{z}*{z}/(4*({n})*({n})))/{den}"
    return f"CASE WHEN {n} > 0 THEN greatest({mid}-{half},0) ELSE 0 END", f"CASE WHEN {n} > 0 THEN least({mid}+{half},1) ELSE 0 END"


_LOW, _HIGH = _wilson("n_ancient", "eff_reads")
SUMMARY = f"""{GAMMA}, {SEGMENTS}, {POSITIONAL}, {TERMINAL},
bs AS (SELECT ref_id, count(*) AS n_reads, sum(g) AS eff_reads, sum(CASE WHEN p_read > 0.04 THEN g ELSE 0 END) AS n_ancient, sum(CASE WHEN p_read > 0.04 THEN 0 ELSE g END) AS n_modern,
 sum(g*fident)/sum(g) AS mean_identity, sum(g*aln_len)/sum(g) AS avg_aln_len, sum(g*p_read)/sum(g) AS mean_posterior FROM ga GROUP BY ref_id),
su AS (SELECT bs.*, n_ancient/eff_reads AS ancient_frac, {_LOW} AS ci_low, {_HIGH} AS ci_high, breadth, depth_mean, n_unique_starts, start_diversity, start_span, positional_score, terminal_middle_ratio
 FROM bs LEFT JOIN dst USING (ref_id) JOIN pst USING (ref_id) JOIN tz USING (ref_id))"""


def _em_sql(damage: bool, n: int) -> str:
    out = f"WITH {SOFT}, rf AS (SELECT ref_id, max(tlen) AS len FROM soft GROUP BY ref_id), w0 AS (SELECT ref_id, len, CAST(1 AS DOUBLE)/(SELECT count(*) FROM rf) AS w FROM rf)"
    for i in range(n):
        base = f"SELECT a.*, ln(greatest(w, 1e-10)) - CAST(0.5 AS DOUBLE)*ln(len) + bits AS sc FROM soft a JOIN w{i} USING (ref_id)"
        if damage:
            p = "least(greatest(p_read, 1e-6), 1-1e-6)"
            out += f", e{i} AS (SELECT *, sc + ln({p}) + ll_a AS sa, sc + ln(1-{p}) + ll_m AS sm FROM ({base})), f{i} AS (SELECT *, max(greatest(sa, sm)) OVER (PARTITION BY read_id) AS t FROM e{i})"
            out += f", g{i} AS (SELECT ref_id, (exp(sa-t)+exp(sm-t))/sum(exp(sa-t)+exp(sm-t)) OVER (PARTITION BY read_id) AS gamma FROM f{i})"
        else:
            out += f", e{i} AS ({base}), f{i} AS (SELECT *, max(sc) OVER (PARTITION BY read_id) AS t FROM e{i}), g{i} AS (SELECT *, exp(sc-t)/sum(exp(sc-t)) OVER (PARTITION BY read_id) AS gamma FROM f{i})"
        out += f", m{i} AS (SELECT ref_id, len, greatest(coalesce(s, 0), 1e-10) AS r FROM w{i} LEFT JOIN (SELECT ref_id, sum(gamma) AS s FROM g{i} GROUP BY ref_id) USING (ref_id))"
        out += f", w{i + 1} AS (SELECT ref_id, len, r/sum(r) OVER () AS w FROM m{i})"
    return out


_KL = f"""WITH {GAMMA}, z AS (SELECT *, greatest(tlen-aln_len+1,1) AS m, least(tstart*8//tlen, 7) AS sb, unnest(range(0,8)) AS bin FROM ga WHERE g >= 1e-6),
b AS (SELECT ref_id, bin, sum(CASE WHEN sb=bin THEN g ELSE 0 END) AS x, sum(g*greatest(least((bin+1)*tlen//8, m)-(bin*tlen//8),0)/m) AS q FROM z GROUP BY ref_id, bin),
p AS (SELECT *, (x+0.0625)/(sum(x) OVER (PARTITION BY ref_id)+0.5) AS p, (q+0.0625)/(sum(q) OVER (PARTITION BY ref_id)+0.5) AS u FROM b),
d AS (SELECT ref_id, greatest(sum(p*ln(p/u)),0) AS kl FROM p GROUP BY ref_id), n AS (SELECT ref_id, sum(g)*sum(g)/sum(g*g) AS n_eff FROM ga WHERE g >= 1e-6 GROUP BY ref_id),
k AS (SELECT ref_id, n_eff, kl, 2*n_eff*kl AS deviance FROM d JOIN n USING (ref_id))"""
def _adaptive_sql(source: str, k: int) -> str:
    """CTEs of the adaptive divergence of source (ref_id, tstart, aln_len, tlen, g)."""
    return f"""az{k} AS (SELECT *, greatest(tlen-aln_len+1,1) AS mm, least(tstart*8//tlen, 7) AS sb, unnest(range(0,8)) AS bin FROM {source} WHERE g >= 1e-6),
ab{k} AS (SELECT ref_id, bin, sum(CASE WHEN sb=bin THEN g ELSE 0 END) AS x, sum(g*greatest(least((bin+1)*tlen//8, mm)-(bin*tlen//8),0)/mm) AS q FROM az{k} GROUP BY ref_id, bin),
an{k} AS (SELECT *, CASE WHEN n_eff <= 0 THEN 6 WHEN n_eff < 8 THEN 3 WHEN n_eff < 15 THEN 6 ELSE 8 END AS b FROM (SELECT ref_id, sum(g) AS sum_g, sum(g)*sum(g)/sum(g*g) AS n_eff FROM {source} WHERE g >= 1e-6 GROUP BY ref_id)),
ar{k} AS (SELECT ref_id, sum_g, n_eff, b, j, sum(x*ov) AS x, sum(q*ov) AS q FROM (SELECT *, greatest(least((bin+1)*b,(j+1)*8)-greatest(bin*b,j*8),0)/b AS ov FROM ab{k} JOIN an{k} USING (ref_id), range(0,8) r(j) WHERE j < b) GROUP BY ALL),
ap{k} AS (SELECT *, (x+CAST(0.5 AS DOUBLE)/b)/(sum(x) OVER (PARTITION BY ref_id)+0.5) AS p, (q+CAST(0.5 AS DOUBLE)/b)/(sum(q) OVER (PARTITION BY ref_id)+0.5) AS u FROM ar{k}),
ad{k} AS (SELECT *, 2*n_eff*kl AS deviance FROM (SELECT ref_id, sum_g, n_eff, b, greatest(sum(p*ln(p/u)),0) AS kl FROM ap{k} GROUP BY ref_id, sum_g, n_eff, b)),
aw{k} AS (SELECT *, least(greatest(exp(CAST(-0.1 AS DOUBLE)*least(greatest((n_eff-8)/12,0),1)*greatest(deviance-(b-1),0)/2),0.2),1) AS cw FROM ad{k})"""


def _coverage_em_sql(n: int) -> str:
    out = f"WITH {SOFT}, rf AS (SELECT ref_id, max(tlen) AS len FROM soft GROUP BY ref_id), w0 AS (SELECT ref_id, len, CAST(1 AS DOUBLE)/(SELECT count(*) FROM rf) AS w FROM rf)"
    gamma = "SELECT ref_id, tstart, aln_len, len AS tlen, exp(sc-t)/sum(exp(sc-t)) OVER (PARTITION BY read_id) AS g FROM (SELECT *, max(sc) OVER (PARTITION BY read_id) AS t FROM (SELECT a.*, len, ln(greatest(w, 1e-10)) - CAST(0.5 AS DOUBLE)*ln(len) + bits AS sc FROM soft a JOIN {0} USING (ref_id)))"
    for i in range(n):
        out += f", g{i} AS ({gamma.format(f'w{i}')}), v{i} AS (SELECT ref_id, len, r/sum(r) OVER () AS w FROM (SELECT ref_id, len, greatest(coalesce(s,0),1e-10) AS r FROM w{i} LEFT JOIN (SELECT ref_id, sum(g) AS s FROM g{i} GROUP BY ref_id) USING (ref_id)))"
        out += f", h{i} AS ({gamma.format(f'v{i}')}), {_adaptive_sql(f'h{i}', i)}"
        out += f", w{i + 1} AS (SELECT ref_id, len, r/sum(r) OVER () AS w FROM (SELECT ref_id, len, exp(CAST(0.5 AS DOUBLE)*ln(w+1e-300)+CAST(0.5 AS DOUBLE)*ln((coalesce(sum_g,0)+1e-15)*coalesce(cw,1)+1e-300)) AS r FROM v{i} LEFT JOIN aw{i} USING (ref_id)))"
    return out


_KEYS = "read_id, ref_id, bits, fident, aln_len, sk, ln"
_FAIL = "CASE WHEN n_reads >= 28 THEN NULL ELSE 'n_reads' END, CASE WHEN breadth >= 0.9 THEN NULL ELSE 'breadth' END, CASE WHEN depth_mean >= 1.5 THEN NULL ELSE 'depth' END, CASE WHEN positional_score >= 0.8 THEN NULL ELSE 'positional' END, CASE WHEN terminal_middle_ratio >= 0.5 THEN NULL ELSE 'terminal' END"
_FL, _FH = _wilson("anc", "eff")
_WL, _WH = _wilson("k", "n")
_BASE = "least(greatest((k+1)/(m+200), 1e-4), 0.02)"

ORACLE = {
    "filter_alignments": f"WITH {ALN} SELECT {_KEYS} FROM aln WHERE fident >= CAST(0.9 AS DOUBLE) AND bits >= 20 AND aln_len >= 10",
    "filter_counts": f"WITH {ALN} SELECT CASE WHEN NOT fident >= CAST(0.9 AS DOUBLE) THEN 'identity' WHEN NOT bits >= 20 THEN 'bits' WHEN NOT aln_len >= 10 THEN 'length' ELSE 'passed' END AS reason, count(*) AS n FROM aln GROUP BY 1",
    "best_hit_top2": f"WITH {ALN}, {BEST} SELECT read_id, ref_id, bits, coalesce(nxt, 0) AS bits_second, round(CASE WHEN degree > 1 THEN bits-nxt ELSE 0 END, 6) AS delta_bits, degree FROM best WHERE rn = 1",
    "unique_mappers": f"WITH {ALN} SELECT {_KEYS} FROM (SELECT *, count(*) OVER (PARTITION BY read_id) AS n FROM aln) WHERE n = 1",
    "qlen_quantiles": f"WITH {ALN}, q AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY aln_len) AS rn, count(*) OVER (PARTITION BY ref_id) AS n FROM aln) SELECT ref_id, aln_len AS quantile FROM q WHERE rn = floor(CAST(0.2 AS DOUBLE)*(n-1))+1",
    "em_weights_3": _em_sql(False, 3) + " SELECT ref_id, round(w, 9) AS w FROM w3",
    "em_damage_weights_3": _em_sql(True, 3) + " SELECT ref_id, round(w, 9) AS w FROM w3",
    "coverage_em_2": _coverage_em_sql(2) + " SELECT ref_id, round(w, 9) AS w FROM w2",
    "coverage_kl_adaptive": f"WITH {GAMMA}, {_adaptive_sql('ga', 0)} SELECT ref_id, b, round(n_eff,6) AS n_eff, round(kl,6) AS kl, round(deviance,5) AS deviance, round(cw,6) AS coverage_weight FROM aw0",
    "em_assignments": _em_sql(False, 2) + """, o AS (SELECT *, row_number() OVER v AS rn, lead(gamma) OVER v AS nx, 1/sum(gamma*gamma) OVER (PARTITION BY read_id) AS neff FROM g1 WINDOW v AS (PARTITION BY read_id ORDER BY gamma DESC, ref_id, sk, ln, aln_len, bits))
 SELECT read_id, ref_id, round(gamma, 6) AS gamma, round(gamma-coalesce(nx,0), 6) AS em_margin, round(neff, 6) AS em_ref_neff FROM o WHERE rn = 1""",
    "gene_coverage": f"WITH {GAMMA}, {SEGMENTS} SELECT ref_id, round(breadth,6) AS breadth, round(depth_mean,6) AS depth_mean, round(depth_std,5) AS depth_std, round(CASE WHEN depth_mean > 0 THEN depth_std/depth_mean ELSE 0 END,5) AS depth_evenness FROM dst",
    "gene_positional": f"WITH {ALN}, {POSITIONAL} SELECT ref_id, n_reads, n_unique_starts, round(start_diversity,6) AS start_diversity, round(start_span,6) AS start_span, round(positional_score,6) AS positional_score FROM pst",
    "protein_terminal_ratio": f"WITH {GAMMA}, {TERMINAL} SELECT ref_id, round(terminal_middle_ratio,5) AS terminal_middle_ratio FROM tz",
    "coverage_kl": _KL + " SELECT ref_id, round(n_eff,6) AS n_eff, round(kl,6) AS kl, round(deviance,5) AS deviance FROM k",
    "coverage_weight": _KL + " SELECT ref_id, round(least(greatest(exp(CAST(-0.1 AS DOUBLE)*least(greatest((n_eff-8)/12,0),1)*greatest(deviance-7,0)/2),0.2),1),6) AS coverage_weight FROM k",
    "gene_summary": f"WITH {SUMMARY} SELECT ref_id, n_reads, n_unique_starts, " + ", ".join(f"round({c},6) AS {c}" for c in ("eff_reads", "n_ancient", "n_modern", "mean_identity", "avg_aln_len", "mean_posterior", "ancient_frac", "ci_low", "ci_high", "breadth", "depth_mean", "start_diversity", "start_span", "positional_score")) + ", round(terminal_middle_ratio,5) AS terminal_middle_ratio FROM su",
    "protein_filter_fail": f"WITH {SUMMARY}, f AS (SELECT ref_id, n_reads, concat_ws(',', {_FAIL}) AS x FROM su) SELECT ref_id, n_reads, CASE WHEN x = '' THEN '.' ELSE x END AS filter_fail, CAST(x = '' AS INT) AS pass_mapping_filter FROM f",
    "combined_outer": f"""WITH {ALN}, {BEST}, ge AS (SELECT ref_id, count(*) AS n_reads, sum(bits) AS sb, 1 AS g FROM best WHERE rn = 1 GROUP BY ref_id),
 pr AS (SELECT ref_id, count(*) AS nd, max(p_read) AS mp, 1 AS p FROM aln WHERE p_read >= CAST(0.07 AS DOUBLE) AND fident >= CAST(0.94 AS DOUBLE) GROUP BY ref_id), j AS (SELECT * FROM ge FULL JOIN pr USING (ref_id))
 SELECT ref_id, coalesce(p_brand, '.') AS group_id, coalesce(g,0) AS gene_present, coalesce(p,0) AS protein_present, coalesce(n_reads,0) AS n_reads, round(coalesce(sb,0),6) AS sum_bits, coalesce(nd,0) AS n_damage, coalesce(mp,0) AS max_p,
 CASE WHEN g IS NULL AND p IS NULL THEN 'no_gene,no_protein' WHEN g IS NULL THEN 'no_gene' WHEN p IS NULL THEN 'no_protein' ELSE '.' END AS filter_fail FROM j LEFT JOIN part ON p_partkey = ref_id""",
    "function_rollup": f"""WITH {GAMMA}, ge AS (SELECT ref_id, sum(g) AS eff, sum(CASE WHEN p_read > 0.04 THEN g ELSE 0 END) AS anc, sum(g*fident)/sum(g) AS ident, sum(g*aln_len)/max(tlen) AS depth FROM ga GROUP BY ref_id),
 s AS (SELECT p_brand AS function_id, count(*) AS n_genes, CAST(sum(round(eff)) AS BIGINT) AS n_reads, sum(eff) AS eff, sum(anc) AS anc, avg(depth) AS cm, sqrt(greatest(avg(depth*depth)-avg(depth)*avg(depth),0)) AS cs, avg(ident) AS ai FROM ge JOIN part ON p_partkey = ref_id GROUP BY 1)
 SELECT function_id, n_genes, n_reads, round(anc/eff,6) AS ancient_frac, round({_FL},6) AS ci_low, round({_FH},6) AS ci_high, round((anc/eff)/((SELECT sum(anc) FROM s)/(SELECT sum(eff) FROM s)),6) AS damage_enrichment, round(cm,6) AS coverage_mean, round(cs,5) AS coverage_stdev, round(ai,6) AS avg_identity FROM s""",
    "spurious_calibration": f"WITH {ALN}, {POSITIONAL}, q AS (SELECT positional_score, row_number() OVER (ORDER BY positional_score) - 1 AS rn, count(*) OVER () AS n FROM pst WHERE n_reads >= 10 AND n_unique_starts >= 3) SELECT round(greatest(positional_score, 0.2),6) AS threshold, n AS n_genes FROM q WHERE rn = n // 20",
    "length_bin_z": f"""WITH {ALN}, {BEST}, b AS (SELECT read_id, ref_id, bits/aln_len AS bpa, CASE WHEN aln_len < 12 THEN 0 WHEN aln_len < 25 THEN 1 WHEN aln_len < 40 THEN 2 ELSE 3 END AS length_bin FROM best WHERE rn = 1),
 s AS (SELECT length_bin, count(*) AS n, avg(bpa) AS m, stddev_pop(bpa) AS s FROM b GROUP BY 1) SELECT read_id, ref_id, length_bin, bpa, round(CASE WHEN n >= 10 AND s > 0 THEN (bpa-m)/s ELSE 0 END,5) AS z_bpa FROM b JOIN s USING (length_bin)""",
    "modern_baseline": f"""WITH {ALN}, q AS (SELECT p_read, row_number() OVER (ORDER BY p_read) - 1 AS rn, count(*) OVER () AS c FROM aln), l AS (SELECT least(greatest(p_read, CAST(0.02 AS DOUBLE)), 0.35) AS lim FROM q WHERE rn = floor(CAST(0.2 AS DOUBLE)*(c-1))),
 s AS (SELECT sum(floor((1-fident)*10)) AS k, sum(aln_len) AS m, count(*) AS n FROM aln, l WHERE p_read <= lim) SELECT round({_BASE},9) AS baseline, n AS n_proxy FROM s""",
    "stratified_baseline": f"""WITH {ALN}, s AS (SELECT CAST(least(aln_len // 13, 3) AS BIGINT) AS stratum, sum(floor((1-fident)*10)) AS k, sum(aln_len) AS m, count(*) AS n FROM aln GROUP BY ROLLUP (1)), b AS (SELECT *, {_BASE} AS b FROM s)
 SELECT coalesce(stratum,-1) AS stratum, n, round(CASE WHEN stratum IS NULL THEN b ELSE n/(n+100)*b + (1-n/(n+100))*(SELECT b FROM b WHERE stratum IS NULL) END,9) AS baseline FROM b""",
    "wilson_intervals": f"WITH {ALN}, s AS (SELECT ref_id, count(*) AS n, CAST(sum(CASE WHEN p_read > 0.04 THEN 1 ELSE 0 END) AS BIGINT) AS k FROM aln GROUP BY ref_id) SELECT ref_id, n, k, round({_WL},6) AS ci_low, round({_WH},6) AS ci_high FROM s",
    "dictionary_ids": "SELECT p_name, dense_rank() OVER (ORDER BY p_name) - 1 AS id FROM (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL)",
    "event_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "group_map": "SELECT l_partkey AS ref_id, l_suppkey AS grp FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1",
}
QUERIES = {name: globals()[name] for name in [*ORACLE, "em_squarem", "em_squarem_damage", "coverage_em", "completeness", "protein_damage", "gene_posterior"]}
