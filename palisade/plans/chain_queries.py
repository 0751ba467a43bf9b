"""The chain from hits to reads, references and groups, over hits with gaps and both strands made of the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from palisade.operators import annotate as N
from palisade.operators import report as R
from palisade.plans.alignment_queries import POSITIONAL, SEGMENTS, TERMINAL, _wilson
from palisade.plans.sequence_queries import _C, _G, _LG, _T2Q
from palisade.plans.adapters import SEQ, sequences
from palisade.session import table

# Columns of the hits, in order, in SQL that both engines read; each may use those before it.
_LAYERS = [
    ["(((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey) * 100 + CAST(l_quantity AS INT) AS row_id", "'r' || CAST(l_orderkey AS STRING) || CASE WHEN l_orderkey % 2 = 1 THEN '_-_' ELSE '_+_' END || CAST(l_orderkey % 3 AS STRING) AS query_id", "l_partkey AS ref_id",
     "l_extendedprice / CAST(1000.0 AS DOUBLE) / 100 * 3 AS bits", "CAST(0.86 AS DOUBLE) + l_discount AS fident", "CAST(20 + CAST(l_quantity AS INT) % 13 AS INT) AS aln_len", "CAST((l_suppkey * 7 + l_linenumber * 13) % 100 + 1 AS BIGINT) AS tstart",
     "120 + l_partkey % 50 AS tlen", "-CAST(CAST(l_quantity AS INT) AS DOUBLE) / 2 AS log10_evalue", "CAST(1 + l_suppkey % 3 AS INT) AS qstart", "CAST(l_linenumber % 5 AS INT) AS head", "CAST(l_suppkey % 4 AS INT) AS tail", "l_linenumber % 3 AS gap", "l_suppkey % 2 AS odd",
     "translate(md5(CAST(l_partkey AS STRING) || '-' || CAST(l_linenumber AS STRING)), '0123456789abcdef', 'RQHPTAEDGSVCWKLM') AS tb"],
    ["*", "translate(tb, 'RQHPTAEDGSVCW', 'W*YSIVKNRFIYX') AS mu"],
    ["*", "substr(mu, 1, head) || substr(tb, head + 1, aln_len - head - tail) || substr(mu, aln_len + 1 - tail, tail) AS q0"],
    ["*", "CASE WHEN odd = 0 THEN substr(q0, 1, 15) || 'M' || substr(q0, 17) ELSE q0 END AS q1"],
    ["row_id", "query_id", "ref_id", "bits", "fident", "aln_len", "tstart", "tlen", "log10_evalue", "qstart", "CAST(qstart - 1 + aln_len - CASE WHEN gap = 1 THEN 2 ELSE 0 END + ref_id % 4 AS INT) AS qlen",
     "CASE WHEN gap = 1 THEN substr(q1, 1, 10) || '--' || substr(q1, 13) ELSE q1 END AS qaln", "CASE WHEN gap = 2 THEN substr(tb, 1, 14) || '--' || substr(tb, 17, aln_len - 16) ELSE substr(tb, 1, aln_len) END AS taln"],
]
_INDEX = ["'r' || CAST(o_orderkey AS STRING) || '_+_' || CAST(o_orderkey % 3 AS STRING) AS query_id", "CAST(o_orderkey * 13 % 97 AS DOUBLE) / 100 AS p_damaged"]
SETTINGS = R.Settings(min_identity=0.88, min_bits=0.2, max_log10_evalue=-2.0, min_reads=12, min_breadth=0.6, min_depth=1.0, min_positional=0.6, min_terminal=0.4, em_min_prob=0.3, iterations=2)


def hits(spark, sf_dir):
    return reduce(lambda df, cols: df.selectExpr(*cols), _LAYERS, table(spark, sf_dir, "lineitem"))


def damage_index(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").selectExpr(*_INDEX)


def groups(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref_id"), F.col("p_brand").alias("group_id"))


def _scored(spark, sf_dir):
    return R.scored(hits(spark, sf_dir), damage_index(spark, sf_dir), SETTINGS)


def _rounded(df, digits=6, exact=()):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in exact else F.col(c) for c, t in df.dtypes])


def hit_filters(spark, sf_dir):
    """Hits charged to the first predicate that they fail: identity, bits, e-value."""
    reason = F.lit("passed")
    for name, rule in reversed(R.rules(SETTINGS)):
        reason = F.when(~rule, name).otherwise(reason)
    return hits(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def index_join(spark, sf_dir):
    """Damage probability of each hit's read, by names without strand and frame."""
    return R.read_damage(hits(spark, sf_dir).select("row_id", "query_id"), damage_index(spark, sf_dir)).select("row_id", "query_id", "p_read")


def gapped_annotation(spark, sf_dir):
    """Annotation of every hit: gaps, offsets and both strands."""
    h = hits(spark, sf_dir).withColumn("reverse", F.col("query_id").rlike("_-_[0-9]+$"))
    a = N.annotate(h, SETTINGS.d_max, SETTINGS.rate)
    return _rounded(a.select("row_id", *[c for c in a.columns if c in _SUMMARY]), 5)


_SUMMARY = ["aligned", "mismatches", "m", "k", "high_conf", "ct_sites", "ga_sites", "terminal_5", "terminal_3", "sum_decay", "sum_log", "max_p_damage", "damage_fraction", "p_damaged", "ll_a", "ll_m", "gap_opens", "qend", "tend"]


def chain_sites(spark, sf_dir):
    """A row a damage site of every hit."""
    h = hits(spark, sf_dir).withColumn("reverse", F.col("query_id").rlike("_-_[0-9]+$")).select("row_id", "ref_id", "qaln", "taln", "qstart", "tstart", "qlen", "reverse")
    s = N.site_rows(h, SETTINGS.d_max, SETTINGS.rate)
    return s.select("row_id", "ref_id", "query_pos", "target_pos", "target_aa", "query_aa", "damage_class", F.when(F.col("high"), "high").otherwise("medium").alias("confidence"), "dist_5prime", "dist_3prime", F.round("p_damage", 6).alias("p_damage"))


def corrected_proteins(spark, sf_dir):
    return N.corrected(hits(spark, sf_dir).withColumn("reverse", F.lit(False))).select("row_id", "corrected")


_EXACT = ("log10_evalue", "bits", "fident", "delta_bits", "bpa")  # alike to the last digit, and often half-way between two of five digits
READ_COLUMNS = ["read_id", "row_id", "ref_id", "log10_evalue", "bits", "fident", "aln_len", "mismatches", "k", "non_damage", "ct_sites", "ga_sites", "high_conf", "damage_fraction", "max_p_damage", "p_damaged", "p_read", "posterior", "is_damaged", "damage_call",
                "log_bf_terminal", "log_bf_sites", "log_bf_identity", "m", "tier", "delta_bits", "bpa", "length_bin", "z_bpa", "gamma", "gamma_ancient", "em_keep", "em_margin", "em_ref_neff", "degree"]


def chain_reads(spark, sf_dir):
    """A row a read: its best hit, annotation, posterior, and margins of bits and gamma."""
    return _rounded(R.reads(_scored(spark, sf_dir), SETTINGS).where("mismatches > 0").select(*READ_COLUMNS), 5, _EXACT)


GENE_COLUMNS = ["ref_id", "n_reads", "eff_reads", "n_damage_reads", "eff_damage_reads", "n_ancient", "n_modern", "n_undetermined", "ancient_frac", "ci_low", "ci_high", "mean_posterior", "mean_identity", "breadth", "abundance", "depth_std", "depth_evenness",
                "n_unique_starts", "start_diversity", "start_span", "positional_score", "terminal_middle_ratio", "avg_aln_len", "std_aln_len", "coverage_deviance", "coverage_weight", "abundance_adjusted"]


def chain_genes(spark, sf_dir):
    """A row a reference over all its hits, weighted by the EM's gamma."""
    return _rounded(R.genes(_scored(spark, sf_dir)).select(*GENE_COLUMNS), 4)


PROTEIN_COLUMNS = ["ref_id", "p_reads", "p_damage_reads", "n_damaged", "damage_sites", "terminal_5", "terminal_3", "max_p_damaged", "mean_p_damaged", "frac_damaged", "frac_damaged_all", "d_aa", "avg_delta_bits", "avg_bpa", "length_bin", "n_reads", "breadth", "pass_mapping_filter", "filter_fail"]


def _sides(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    g = R.genes(rows)
    return g, R.proteins(R.reads(rows, SETTINGS), g, SETTINGS)


def chain_proteins(spark, sf_dir):
    """A row a reference over the reads whose best hit it is, with the mapping filter's verdict."""
    return _rounded(_sides(spark, sf_dir)[1].select(*PROTEIN_COLUMNS), 4)


def chain_combined(spark, sf_dir):
    g, p = _sides(spark, sf_dir)
    return _rounded(R.combined(g, p, groups(spark, sf_dir), SETTINGS), 4)


def chain_functions(spark, sf_dir):
    return _rounded(R.functions(R.genes(_scored(spark, sf_dir)), groups(spark, sf_dir)), 4)


def chain_abundance(spark, sf_dir):
    g, p = _sides(spark, sf_dir)
    return _rounded(R.abundance(g, p, groups(spark, sf_dir)), 4)


REPORT = [(name, c) for name, c in R.PROTEIN_REPORT if c not in (*R._FIT.values(), "completeness_fhat")]


def chain_protein_report(spark, sf_dir):
    """The protein report but for its fits, which SQL can't express."""
    return _rounded(_sides(spark, sf_dir)[1].select(*[F.col(c).alias(name) for name, c in REPORT]), 4)


def chain_run(spark, sf_dir):
    """All tables of a run with the EM run until it settles, level and thresholds from the data: rows and sums of each table."""
    strict = R.Settings(min_identity=0.88, min_bits=0.2, max_log10_evalue=-2.0).strict()
    tables, s = R.run(hits(spark, sf_dir), damage_index(spark, sf_dir), groups(spark, sf_dir), strict, given=())
    out = None
    for name, df in tables.items():
        figures = [F.sum(F.col(c).cast("double")) for c, t in df.dtypes if t in ("double", "bigint", "int") and c not in ("ref_id", "target_id", "protein_id", "row_id") and not c.startswith("log10")]
        one = df.agg(F.count("*").alias("n"), F.round(sum(figures[1:], figures[0]), 3).alias("total")).select(F.lit(name).alias("report"), "n", "total")
        out = one if out is None else out.unionByName(one)
    return out.withColumns({"d_max": F.lit(round(s.d_max, 6)), "min_positional": F.lit(round(s.min_positional, 6)), "min_terminal": F.lit(round(s.min_terminal, 6)), "min_damage_sites": F.lit(s.min_damage_sites)})


def _truth(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0")
    truth = o.selectExpr("o_orderkey AS read_id", "CASE WHEN o_orderkey % 2 = 1 THEN '-' ELSE '+' END AS strand", "CAST(o_orderkey % 3 AS INT) AS frame")
    calls = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3 AND l_orderkey % 11 <> 0").selectExpr(
        "l_orderkey AS read_id", "CASE WHEN l_suppkey % 2 = 1 THEN '-' ELSE '+' END AS strand", "CAST(l_partkey % 3 AS INT) AS frame", "l_discount * 10 AS score")
    return truth, calls


def validation_join(spark, sf_dir):
    """Truth beside the predictions of each read: any call with the right strand, and frame."""
    v = R.validated(*_truth(spark, sf_dir))
    return v.select("read_id", "strand", "frame", *[F.col(c).cast("int").alias(c) for c in ("hit", "strand_ok", "frame_ok")], F.round("best", 6).alias("best"))


def validation_report(spark, sf_dir):
    """One row: totals, misses, strand and frame accuracy among reads with a call, and calls of unknown reads."""
    truth, calls = _truth(spark, sf_dir)
    n = lambda c: F.sum(F.col(c).cast("long"))
    one = R.validated(truth, calls).agg(F.count("*").alias("n_truth"), n("hit").alias("n_called"), n("strand_ok").alias("n_strand"), n("frame_ok").alias("n_frame"))
    more = R.unexpected(truth, calls).agg(F.count("*").alias("n_unexpected"))
    return one.crossJoin(more).select("n_truth", "n_called", (F.col("n_truth") - F.col("n_called")).alias("n_missed"), F.round(F.col("n_strand") / F.col("n_called"), 6).alias("strand_accuracy"), F.round(F.col("n_frame") / F.col("n_called"), 6).alias("frame_accuracy"), "n_unexpected")  # one row each


ENRICHMENT = ["ref_id", "theta_raw", "theta_post", "low_count", "low_breadth"]


def chain_enrichment(spark, sf_dir):
    """Raw and shrunken share of damaged reads of each reference, and its flags; intervals and calls are tested, as SQL has no Beta."""
    return _rounded(R.enrichment(R.genes(_scored(spark, sf_dir))).select(*ENRICHMENT), 4)


_TRUTH_ROW = ["o_orderkey AS read_id", "CASE WHEN o_orderkey % 2 = 1 THEN '-' ELSE '+' END AS strand", "CAST(o_orderkey % 3 AS INT) AS frame", "substr(md5(CAST(o_orderkey AS STRING)), 1, CAST(20 + o_orderkey % 11 AS INT)) AS sequence", "CAST(60 + o_orderkey % 31 AS INT) AS length"]
_CALL_ROW = ["l_orderkey AS read_id", "CASE WHEN l_suppkey % 2 = 1 THEN '-' ELSE '+' END AS strand", "CAST(l_partkey % 3 AS INT) AS frame", "l_discount * 10 AS score", "CAST(l_suppkey % 50 AS DOUBLE) AS damage_pct", "CAST(l_partkey % 97 AS DOUBLE) / 100 AS damage_signal",
             "CASE WHEN l_suppkey % 3 = 0 THEN substr(md5(CAST(l_orderkey AS STRING)), 1, 18) ELSE substr(md5(CAST(l_suppkey AS STRING)), 1, 25) END AS sequence"]


def validation_table(spark, sf_dir):
    """The validation table: predictions and proteins beside the truth of their reads."""
    truth = table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").selectExpr(*_TRUTH_ROW)
    calls = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3 AND l_orderkey % 11 <> 0").selectExpr(*_CALL_ROW)
    return _rounded(R.validation_rows(truth, calls.drop("sequence"), calls.select("read_id", "strand", "sequence")))


def target_profiles(spark, sf_dir):
    """Damage profile of 25 positions at either end of each target's reads, by their first hits."""
    first = hits(spark, sf_dir).groupBy(F.split("query_id", "_")[0].alias("read_id")).agg(F.min_by("ref_id", "row_id").alias("target"))
    reads = sequences(spark, sf_dir).select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("read_id"), "seq")
    return _rounded(R.target_profile(reads, first))


def _hits_sql() -> str:
    out, src = [], "lineitem"
    for k, cols in enumerate(_LAYERS):
        name = "hits" if k == len(_LAYERS) - 1 else f"h{k}"
        out.append(f"{name} AS (SELECT {', '.join(cols)} FROM {src})")
        src = name
    return ", ".join(out)


D = "CAST(0.3 AS DOUBLE)"
_HITS = "WITH " + _hits_sql()
_SITES = f"""c0 AS (SELECT row_id, query_id, ref_id, qstart, tstart, qlen, i, qaln[i] AS q, taln[i] AS t FROM (SELECT *, unnest(range(1, length(qaln)+1)) AS i FROM hits)),
c1 AS (SELECT *, qstart - 1 + sum(CASE WHEN q <> '-' THEN 1 ELSE 0 END) OVER w - CASE WHEN q <> '-' THEN 1 ELSE 0 END AS qp, tstart - 1 + sum(CASE WHEN t <> '-' THEN 1 ELSE 0 END) OVER w - CASE WHEN t <> '-' THEN 1 ELSE 0 END AS tp FROM c0 WINDOW w AS (PARTITION BY row_id ORDER BY i)),
c2 AS (SELECT *, CASE WHEN regexp_matches(query_id, '_-_[0-9]+$') THEN CASE WHEN qp < qlen THEN 3*(qlen-1-qp) ELSE 0 END ELSE 3*qp END AS d5, CASE WHEN regexp_matches(query_id, '_-_[0-9]+$') THEN 3*qp ELSE CASE WHEN qp < qlen THEN 3*(qlen-1-qp) ELSE 0 END END AS d3 FROM c1 WHERE q <> '-' AND t <> '-'),
c3 AS (SELECT c2.*, t IN ({_C}) AS co, t IN ({_G}) AS go, cls, high FROM c2 LEFT JOIN {_T2Q} ON tq = t || q),
sx AS (SELECT *, CASE WHEN co THEN exp(-{D}*d5) ELSE 0 END AS dc, CASE WHEN go THEN exp(-{D}*d3) ELSE 0 END AS dg, CASE cls WHEN 'C' THEN {D}*exp(-{D}*d5) WHEN 'G' THEN {D}*exp(-{D}*d3) END AS pd FROM c3)"""
_n = lambda c: f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"
_SU = f"""s0 AS (SELECT row_id, count(*) AS aligned, {_n('q <> t')} AS mismatches, {_n('co OR go')} AS m, {_n('cls IS NOT NULL')} AS k, {_n('high = 1')} AS high_conf, {_n("cls = 'C'")} AS ct_sites, {_n("cls = 'G'")} AS ga_sites,
 {_n("cls = 'C' AND d5 < 9")} AS terminal_5, {_n("cls = 'G' AND d3 < 9")} AS terminal_3, sum(CASE WHEN co OR go THEN greatest(dc,dg) ELSE 0 END) AS sum_decay, coalesce(sum(ln((pd+0.005)/0.005)),0) AS sum_log, coalesce(max(pd),0) AS max_p_damage,
 sum(least(greatest(ln(greatest(pd,0.01)/0.01),-3),5)) AS llr,
 coalesce(sum(CASE WHEN NOT (co OR go) THEN 0 WHEN cls IS NOT NULL THEN ln(least(greatest(pd+0.005,1e-8),1-1e-8)) ELSE ln(least(greatest(1-({D}*greatest(dc,dg)+0.005),1e-8),1-1e-8)) END),0) AS ll_a,
 coalesce(sum(CASE WHEN NOT (co OR go) THEN 0 WHEN cls IS NOT NULL THEN ln(CAST(0.005 AS DOUBLE)) ELSE ln(CAST(0.995 AS DOUBLE)) END),0) AS ll_m FROM sx GROUP BY row_id),
su AS (SELECT hits.*, s0.* EXCLUDE (row_id, llr), CASE WHEN mismatches > 0 THEN k/mismatches ELSE 0 END AS damage_fraction, CASE WHEN k > 0 THEN 1/(1+exp(-least(greatest(llr,-10),10))) ELSE 0.5 END AS p_damaged,
 CAST(len(regexp_extract_all(qaln,'-+')) + len(regexp_extract_all(taln,'-+')) AS BIGINT) AS gap_opens,
 CAST(qstart - 1 + length(replace(qaln,'-','')) AS BIGINT) AS qend, CAST(tstart - 1 + length(replace(taln,'-','')) AS BIGINT) AS tend FROM hits JOIN s0 USING (row_id))"""
_STRIP = "regexp_replace(query_id, '_[+-]_[0-9]$', '')"
_IDX = f"ix AS (SELECT {', '.join(_INDEX)} FROM orders WHERE o_orderkey % 5 <> 0), ixn AS (SELECT {_STRIP} AS name, arg_min(p_damaged, query_id) AS p FROM ix GROUP BY 1)"
_FILTER = "fident >= CAST(0.88 AS DOUBLE) AND bits >= CAST(0.2 AS DOUBLE) AND log10_evalue <= -2"
_EM = ["rows0 AS (SELECT su.* EXCLUDE (query_id), query_id AS read_id, coalesce(p, 0) AS p_read FROM su LEFT JOIN ixn ON name = " + _STRIP + f" WHERE {_FILTER})",
       "rf AS (SELECT ref_id, max(tlen) AS len FROM rows0 GROUP BY ref_id), w0 AS (SELECT ref_id, len, CAST(1 AS DOUBLE)/(SELECT count(*) FROM rf) AS w FROM rf)"]
for _i in range(3):
    _p = "least(greatest(p_read, 1e-6), 1-1e-6)"
    _EM.append(f"e{_i} AS (SELECT rows0.*, ln(greatest(w, 1e-10)) - CAST(0.5 AS DOUBLE)*ln(len) + bits + ln({_p}) + ll_a AS sa, ln(greatest(w, 1e-10)) - CAST(0.5 AS DOUBLE)*ln(len) + bits + ln(1-{_p}) + ll_m AS sm FROM rows0 JOIN w{_i} USING (ref_id))")
    _EM.append(f"f{_i} AS (SELECT *, max(greatest(sa, sm)) OVER (PARTITION BY read_id) AS top FROM e{_i}), g{_i} AS (SELECT * EXCLUDE (sa, sm, top), (exp(sa-top)+exp(sm-top))/sum(exp(sa-top)+exp(sm-top)) OVER (PARTITION BY read_id) AS gamma, exp(sa-top)/sum(exp(sa-top)+exp(sm-top)) OVER (PARTITION BY read_id) AS gamma_ancient FROM f{_i})")
    if _i < 2:
        _EM.append(f"m{_i} AS (SELECT ref_id, len, greatest(coalesce(s, 0), 1e-10) AS r FROM w{_i} LEFT JOIN (SELECT ref_id, sum(gamma) AS s FROM g{_i} GROUP BY ref_id) USING (ref_id)), w{_i + 1} AS (SELECT ref_id, len, r/sum(r) OVER () AS w FROM m{_i})")
_TEN = "CAST(0.1 AS DOUBLE)"
_POST = f"""b0 AS (SELECT *, {D}*{D}*CASE WHEN m > 0 THEN sum_decay/m ELSE 0.12 END + 0.005 AS qe FROM g2),
b1 AS (SELECT *, CASE WHEN p_read > 0.01 THEN {_LG.format('p_read')} - {_LG.format(_TEN)} ELSE 0 END AS log_bf_terminal,
 CASE WHEN m >= 1 THEN least(greatest(k*ln(qe/0.005) + CASE WHEN m > k AND qe > 0.005 THEN {D}*(m-k)*ln((1-qe)/0.995) ELSE 0 END,-3),3) ELSE 0 END AS log_bf_sites, least(greatest(20*(fident-CAST(0.9 AS DOUBLE)),-5),5) AS log_bf_identity FROM b0),
b2 AS (SELECT *, 1/(1+exp(-({_LG.format(_TEN)}+log_bf_terminal+log_bf_sites+log_bf_identity))) AS posterior, CASE WHEN p_read >= 0.5 AND k > 0 THEN 'convergent' WHEN p_read >= 0.5 THEN 'terminal' WHEN k > 0 THEN 'sites' ELSE 'none' END AS tier FROM b1),
sc AS (SELECT *, CASE WHEN posterior >= 0.6 THEN 'ancient' WHEN posterior <= 0.25 THEN 'modern' ELSE 'uncertain' END AS damage_call FROM b2)"""
_SCORED = f"{_HITS}, {_SITES}, {_SU}, {_IDX}, " + ", ".join(_EM) + f", {_POST}"
_READS = """r0 AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY bits DESC, ref_id, row_id) AS rn, lead(bits) OVER (PARTITION BY read_id ORDER BY bits DESC, ref_id, row_id) AS bits2, count(*) OVER (PARTITION BY read_id) AS degree,
 1/sum(gamma*gamma) OVER (PARTITION BY read_id) AS em_ref_neff, max(gamma) OVER (PARTITION BY read_id) - coalesce(nth_value(gamma, 2) OVER (PARTITION BY read_id ORDER BY gamma DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS em_margin FROM sc),
r1 AS (SELECT *, CASE WHEN degree > 1 THEN bits - bits2 ELSE 0 END AS delta_bits, bits/aln_len AS bpa, CASE WHEN aln_len < 25 THEN 0 WHEN aln_len < 40 THEN 1 WHEN aln_len < 60 THEN 2 ELSE 3 END AS length_bin FROM r0 WHERE rn = 1),
r2 AS (SELECT length_bin, count(*) AS bn, avg(bpa) AS bm, stddev_pop(bpa) AS bs FROM r1 GROUP BY 1),
rd AS (SELECT r1.*, CASE WHEN bn >= 10 AND bs > 0 THEN (bpa-bm)/bs ELSE 0 END AS z_bpa, mismatches - k AS non_damage, CAST(posterior >= 0.7 AS INT) AS is_damaged, CAST(gamma >= CAST(0.3 AS DOUBLE) AS INT) AS em_keep FROM r1 JOIN r2 USING (length_bin))"""
_GL, _GH = _wilson("n_ancient", "(n_ancient+n_modern)")
_is = lambda c: f"sum(CASE WHEN damage_call = '{c}' THEN gamma ELSE 0 END)"
_GENES = f"""aln AS (SELECT ref_id, tstart - 1 AS tstart, aln_len, tlen, gamma AS g FROM sc), ga AS (SELECT * FROM aln), {SEGMENTS}, {POSITIONAL}, {TERMINAL},
z AS (SELECT *, greatest(tlen-aln_len+1,1) AS mm, least(tstart*8//tlen, 7) AS sb, unnest(range(0,8)) AS bin FROM ga WHERE g >= 1e-6),
zb AS (SELECT ref_id, bin, sum(CASE WHEN sb=bin THEN g ELSE 0 END) AS x, sum(g*greatest(least((bin+1)*tlen//8, mm)-(bin*tlen//8),0)/mm) AS q FROM z GROUP BY ref_id, bin),
zp AS (SELECT *, (x+0.0625)/(sum(x) OVER (PARTITION BY ref_id)+0.5) AS p, (q+0.0625)/(sum(q) OVER (PARTITION BY ref_id)+0.5) AS u FROM zb),
kl AS (SELECT ref_id, n_eff, 2*n_eff*greatest(kl,0) AS deviance FROM (SELECT ref_id, sum(p*ln(p/u)) AS kl FROM zp GROUP BY ref_id) JOIN (SELECT ref_id, sum(g)*sum(g)/sum(g*g) AS n_eff FROM ga WHERE g >= 1e-6 GROUP BY ref_id) USING (ref_id)),
gb AS (SELECT ref_id, count(*) AS n_reads, sum(gamma) AS eff_reads, {_n('k > 0')} AS n_damage_reads, sum(CASE WHEN k > 0 THEN gamma ELSE 0 END) AS eff_damage_reads, {_is('ancient')} AS n_ancient, {_is('modern')} AS n_modern, {_is('uncertain')} AS n_undetermined,
 sum(gamma*posterior)/sum(gamma) AS mean_posterior, sum(gamma*fident)/sum(gamma) AS mean_identity, sum(gamma*aln_len)/sum(gamma) AS avg_aln_len, sqrt(greatest(sum(gamma*aln_len*aln_len)/sum(gamma) - (sum(gamma*aln_len)/sum(gamma))*(sum(gamma*aln_len)/sum(gamma)),0)) AS std_aln_len FROM sc GROUP BY ref_id),
gn AS (SELECT gb.*, CASE WHEN n_ancient+n_modern > 0 THEN n_ancient/(n_ancient+n_modern) ELSE 0 END AS ancient_frac, {_GL} AS ci_low, {_GH} AS ci_high, coalesce(breadth,0) AS breadth, coalesce(depth_mean,0) AS abundance, coalesce(depth_std,0) AS depth_std, coalesce(CASE WHEN depth_mean > 0 THEN depth_std/depth_mean ELSE 0 END,0) AS depth_evenness,
 n_unique_starts, start_diversity, start_span, positional_score, terminal_middle_ratio, coalesce(deviance,0) AS coverage_deviance, coalesce(least(greatest(exp(-{_TEN}*least(greatest((n_eff-8)/12,0),1)*greatest(deviance-7,0)/2),0.2),1),1) AS coverage_weight
 FROM gb LEFT JOIN dst USING (ref_id) JOIN pst USING (ref_id) JOIN tz USING (ref_id) LEFT JOIN kl USING (ref_id)),
gene AS (SELECT *, abundance*coverage_weight AS abundance_adjusted, concat_ws(',', CASE WHEN n_reads >= 12 THEN NULL ELSE 'n_reads' END, CASE WHEN breadth >= CAST(0.6 AS DOUBLE) THEN NULL ELSE 'breadth' END, CASE WHEN abundance >= 1 THEN NULL ELSE 'depth' END, CASE WHEN positional_score >= CAST(0.6 AS DOUBLE) THEN NULL ELSE 'positional' END,
 CASE WHEN terminal_middle_ratio >= CAST(0.4 AS DOUBLE) THEN NULL ELSE 'terminal' END) AS ff FROM gn)""".replace("SELECT *, sqrt(start_diversity*start_span) AS positional_score FROM ps", "SELECT ref_id, n_unique_starts, start_diversity, start_span, sqrt(start_diversity*start_span) AS positional_score FROM ps")
_PROT = """p0 AS (SELECT ref_id, count(*) AS p_reads, CAST(sum(CASE WHEN k > 0 THEN 1 ELSE 0 END) AS BIGINT) AS p_damage_reads, CAST(sum(CASE WHEN p_damaged > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_damaged, CAST(sum(k) AS BIGINT) AS damage_sites, CAST(sum(terminal_5) AS BIGINT) AS terminal_5, CAST(sum(terminal_3) AS BIGINT) AS terminal_3,
 max(p_damaged) AS max_p_damaged, avg(p_damaged) AS mean_p_damaged, avg(delta_bits) AS avg_delta_bits, avg(bpa) AS avg_bpa, sum(gamma) AS p_eff FROM rd WHERE mismatches > 0 GROUP BY ref_id),
pl AS (SELECT ref_id, length_bin FROM (SELECT ref_id, length_bin, row_number() OVER (PARTITION BY ref_id ORDER BY count(*) DESC, length_bin) AS rn FROM rd WHERE mismatches > 0 GROUP BY ref_id, length_bin) WHERE rn = 1),
prot AS (SELECT p0.*, length_bin, CASE WHEN p_damage_reads > 0 THEN n_damaged/p_damage_reads ELSE 0 END AS frac_damaged, n_damaged/p_reads AS frac_damaged_all, CASE WHEN p_eff > 0 THEN least((terminal_5+terminal_3)/(p_eff*CAST(1.05 AS DOUBLE)),1) ELSE 0 END AS d_aa,
 gene.* EXCLUDE (ref_id, ff), CASE WHEN ff = '' THEN '.' ELSE ff END AS filter_fail, CAST(ff = '' AS INT) AS pass_mapping_filter FROM p0 JOIN pl USING (ref_id) JOIN gene USING (ref_id))"""
_GRP = "grp AS (SELECT p_partkey AS ref_id, p_brand AS group_id FROM part)"


def _pick(cols, digits, floats):
    return ", ".join(f"round({c},{digits}) AS {c}" if c in floats else c for c in cols)


_RF = {"damage_fraction", "max_p_damage", "p_damaged", "p_read", "posterior", "log_bf_terminal", "log_bf_sites", "log_bf_identity", "z_bpa", "gamma", "gamma_ancient", "em_margin", "em_ref_neff"}
_GF = set(GENE_COLUMNS) - {"ref_id", "n_reads", "n_damage_reads", "n_unique_starts"}
_PF = {"max_p_damaged", "mean_p_damaged", "frac_damaged", "frac_damaged_all", "d_aa", "avg_delta_bits", "avg_bpa", "breadth"}
_FL, _FH = _wilson("na", "(na+nm)")
_TRUTH = """tr AS (SELECT o_orderkey AS read_id, CASE WHEN o_orderkey % 2 = 1 THEN '-' ELSE '+' END AS strand, CAST(o_orderkey % 3 AS INT) AS frame FROM orders WHERE o_orderkey % 7 <> 0),
ca AS (SELECT l_orderkey AS read_id, CASE WHEN l_suppkey % 2 = 1 THEN '-' ELSE '+' END AS strand, CAST(l_partkey % 3 AS INT) AS frame, l_discount*10 AS score FROM lineitem WHERE l_linenumber <= 3 AND l_orderkey % 11 <> 0),
va AS (SELECT tr.read_id, tr.strand, tr.frame, count(ca.read_id) > 0 AS hit, coalesce(bool_or(ca.strand = tr.strand),false) AS strand_ok, coalesce(bool_or(ca.strand = tr.strand AND ca.frame = tr.frame),false) AS frame_ok, max(score) AS best FROM tr LEFT JOIN ca USING (read_id) GROUP BY ALL)"""
ORACLE = {
    "hit_filters": f"{_HITS} SELECT CASE WHEN NOT fident >= CAST(0.88 AS DOUBLE) THEN 'identity' WHEN NOT bits >= CAST(0.2 AS DOUBLE) THEN 'bits' WHEN NOT log10_evalue <= -2 THEN 'evalue' ELSE 'passed' END AS reason, count(*) AS n FROM hits GROUP BY 1",
    "index_join": f"{_HITS}, {_IDX} SELECT row_id, query_id, coalesce(p, 0) AS p_read FROM hits LEFT JOIN ixn ON name = {_STRIP}",
    "gapped_annotation": f"{_HITS}, {_SITES}, {_SU} SELECT row_id, {_pick(_SUMMARY, 5, {'sum_decay', 'sum_log', 'max_p_damage', 'damage_fraction', 'p_damaged', 'll_a', 'll_m'})} FROM su",
    "chain_sites": f"{_HITS}, {_SITES} SELECT row_id, ref_id, CAST(qp AS BIGINT) AS query_pos, CAST(tp AS BIGINT) AS target_pos, t AS target_aa, q AS query_aa, cls AS damage_class, CASE WHEN high = 1 THEN 'high' ELSE 'medium' END AS confidence, CAST(d5 AS BIGINT) AS dist_5prime, CAST(d3 AS BIGINT) AS dist_3prime, round(pd,6) AS p_damage FROM sx WHERE cls IS NOT NULL",
    "corrected_proteins": f"{_HITS}, {_SITES}, x AS (SELECT c1.row_id, c1.i, CASE WHEN sub.cls IS NOT NULL THEN c1.t ELSE c1.q END AS a FROM c1 LEFT JOIN {_T2Q} ON tq = t || q WHERE q <> '-') SELECT row_id, string_agg(a, '' ORDER BY i) AS corrected FROM x GROUP BY row_id",
    "chain_reads": f"{_SCORED}, {_READS} SELECT {_pick(READ_COLUMNS, 5, _RF)} FROM rd WHERE mismatches > 0",
    "chain_genes": f"{_SCORED}, {_GENES} SELECT {_pick(GENE_COLUMNS, 4, _GF)} FROM gene",
    "chain_proteins": f"{_SCORED}, {_READS}, {_GENES}, {_PROT} SELECT {_pick(PROTEIN_COLUMNS, 4, _PF)} FROM prot",
    "chain_protein_report": f"{_SCORED}, {_READS}, {_GENES}, {_PROT} SELECT " + ", ".join(f"round({c},4) AS {n}" if c in _PF | _GF | {"p_eff"} else f"{c} AS {n}" for n, c in REPORT) + " FROM prot",
    "chain_combined": f"""{_SCORED}, {_READS}, {_GENES}, {_PROT}, {_GRP}, j AS (SELECT gene.*, prot.p_damage_reads, mean_p_damaged, d_aa, prot.ref_id IS NULL AS nop FROM gene LEFT JOIN prot USING (ref_id)), c AS (SELECT *, concat_ws(',', CASE WHEN nop THEN 'no_protein' END, CASE WHEN ff <> '' THEN ff END) AS f FROM j)
 SELECT ref_id, n_reads, round(eff_reads,4) AS eff_reads, round(abundance,4) AS abundance, round(breadth,4) AS breadth, round(mean_identity,4) AS mean_identity, round(mean_posterior,4) AS mean_posterior, round(positional_score,4) AS positional_score, round(terminal_middle_ratio,4) AS terminal_middle_ratio, coalesce(p_damage_reads,0) AS protein_n_damage_reads,
 round(coalesce(mean_p_damaged,0),4) AS protein_mean_p_damaged, round(coalesce(d_aa,0),4) AS protein_d_aa, coalesce(group_id,'.') AS group_id, CASE WHEN f = '' THEN '.' ELSE f END AS filter_fail, 1 AS gene_present, CASE WHEN nop THEN 0 ELSE 1 END AS protein_present, CAST(f = '' AS INT) AS pass_mapping_filter FROM c LEFT JOIN grp USING (ref_id)""",
    "chain_functions": f"""{_SCORED}, {_GENES}, {_GRP}, f AS (SELECT group_id, count(*) AS n_genes, CAST(sum(round(eff_reads)) AS BIGINT) AS n_reads, sum(n_ancient) AS na, sum(n_modern) AS nm, sum(n_undetermined) AS nu, sum(mean_posterior*round(eff_reads)) AS mp, {_n('n_ancient > n_modern')} AS nd,
 avg(abundance) AS cm, sqrt(greatest(avg(abundance*abundance)-avg(abundance)*avg(abundance),0)) AS cs, avg(mean_identity) AS ai, sqrt(greatest(avg(mean_identity*mean_identity)-avg(mean_identity)*avg(mean_identity),0)) AS si, avg(avg_aln_len) AS al, sqrt(greatest(avg(avg_aln_len*avg_aln_len)-avg(avg_aln_len)*avg(avg_aln_len),0)) AS sl FROM gene JOIN grp USING (ref_id) GROUP BY group_id)
 SELECT group_id, n_genes, n_reads, round(na,4) AS n_ancient, round(nm,4) AS n_modern, round(nu,4) AS n_undetermined, nd AS n_damaged_genes, round(cm,4) AS coverage_mean, round(cs,4) AS coverage_stdev, round(ai,4) AS avg_identity, round(si,4) AS stdev_identity, round(al,4) AS avg_read_length, round(sl,4) AS stdev_read_length,
 round(CASE WHEN na+nm > 0 THEN na/(na+nm) ELSE 0 END,4) AS ancient_frac, round({_FL},4) AS ci_low, round({_FH},4) AS ci_high, round(CASE WHEN n_reads > 0 THEN mp/n_reads ELSE 0 END,4) AS mean_posterior, round(nd/n_genes,4) AS damaged_gene_frac, round(CASE WHEN na+nm > 0 THEN na/(na+nm) ELSE 0 END/((SELECT sum(na) FROM f)/(SELECT sum(na+nm) FROM f)),4) AS damage_enrichment FROM f""",
    "chain_abundance": f"{_SCORED}, {_READS}, {_GENES}, {_PROT}, {_GRP} SELECT ref_id, group_id, round(abundance,4) AS abundance, round(abundance_adjusted,4) AS abundance_adjusted, CASE WHEN n_damaged > 0 THEN 'detected' ELSE 'not_detected' END AS detection FROM gene JOIN grp USING (ref_id) JOIN prot USING (ref_id) WHERE pass_mapping_filter = 1",
    "validation_join": f"WITH {_TRUTH} SELECT read_id, strand, frame, CAST(hit AS INT) AS hit, CAST(strand_ok AS INT) AS strand_ok, CAST(frame_ok AS INT) AS frame_ok, round(best,6) AS best FROM va",
    "chain_enrichment": f"{_SCORED}, {_GENES} SELECT ref_id, round(CASE WHEN eff_reads > 0 THEN n_ancient/eff_reads ELSE 0 END,4) AS theta_raw, round((1+n_ancient)/(10+n_ancient+greatest(eff_reads-n_ancient,0)),4) AS theta_post, CAST(eff_reads < 3 AS INT) AS low_count, CAST(breadth < {_TEN} AS INT) AS low_breadth FROM gene",
    "validation_table": f"""WITH tr AS (SELECT {', '.join(_TRUTH_ROW)} FROM orders WHERE o_orderkey % 7 <> 0), ca AS (SELECT {', '.join(_CALL_ROW)} FROM lineitem WHERE l_linenumber <= 3 AND l_orderkey % 11 <> 0),
 b AS (SELECT * FROM ca QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY score DESC, strand, frame, damage_pct) = 1), m AS (SELECT read_id, max(damage_signal) AS damage_signal FROM ca GROUP BY read_id),
 ok AS (SELECT tr.read_id, CAST(bool_or(ca.strand = tr.strand) AS INT) AS strand_correct, CAST(bool_or(ca.strand = tr.strand AND ca.frame = tr.frame) AS INT) AS frame_correct,
  max(CASE WHEN ca.strand = tr.strand THEN len(list_filter(range(1, least(length(ca.sequence), length(tr.sequence)) + 1), lambda i: substr(ca.sequence, i, 1) = substr(tr.sequence, i, 1))) / CAST(greatest(length(ca.sequence), length(tr.sequence)) AS DOUBLE) END) AS identity FROM tr JOIN ca USING (read_id) GROUP BY tr.read_id)
 SELECT tr.read_id, tr.length, b.strand AS pred_strand, b.frame AS pred_frame, tr.strand AS true_strand, tr.frame AS true_frame, round(b.score,6) AS score, b.damage_pct, m.damage_signal, strand_correct, frame_correct, strand_correct * frame_correct AS both_correct, round(identity,6) AS identity FROM tr JOIN b USING (read_id) JOIN m USING (read_id) JOIN ok USING (read_id)""",
    "target_profiles": f"{_HITS}, {SEQ}, f AS (SELECT split_part(query_id, '_', 1) AS rid, arg_min(ref_id, row_id) AS target FROM hits GROUP BY 1), j AS (SELECT target, seq FROM seqs JOIN f ON rid = 'r' || CAST(doc_id AS STRING)) SELECT target, count(*) AS n_reads, "
    + ", ".join(f"round(coalesce(CAST(count(*) FILTER ({up}) AS DOUBLE) / nullif(count(*) FILTER ({up} OR {low}), 0), 0.5), 6) AS {name}_{k}" for name, a, b in (("tc", "T", "C"), ("ag", "A", "G")) for k in range(25)
                for up, low in [tuple(f"length(seq) > {k} AND substr(seq, {'%d' % (k + 1) if name == 'tc' else 'length(seq) - %d' % k}, 1) = '{c}'" for c in (a, b))]) + " FROM j GROUP BY target",
    "validation_report": f"WITH {_TRUTH} SELECT count(*) AS n_truth, CAST(sum(CAST(hit AS INT)) AS BIGINT) AS n_called, CAST(count(*) - sum(CAST(hit AS INT)) AS BIGINT) AS n_missed, round(sum(CAST(strand_ok AS INT))/sum(CAST(hit AS INT)),6) AS strand_accuracy, round(sum(CAST(frame_ok AS INT))/sum(CAST(hit AS INT)),6) AS frame_accuracy, (SELECT count(DISTINCT read_id) FROM ca WHERE read_id NOT IN (SELECT read_id FROM tr)) AS n_unexpected FROM va",
}
QUERIES = {name: globals()[name] for name in [*ORACLE, "chain_run"]}
