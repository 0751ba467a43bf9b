"""Queries on sequences, annotation, error rates, profiles and clusters."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.functions import sequence as S
from palisade.operators import annotate as N
from palisade.operators import clustering as K
from palisade.operators import fdr as D
from palisade.operators import levels as LV
from palisade.operators import profile as P
from palisade.operators import read_damage as RD
from palisade.operators import sample_counts as SC
from palisade.operators import sample_models as SM
from palisade.operators.frames import word_counts
from palisade.plans.adapters import SEQ, sequences
from palisade.session import table


def revcomp(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", S.reverse_complement("seq").alias("rc"), F.round(S.gc_content("seq"), 6).alias("gc"))


def _frames(spark, sf_dir):
    six = F.posexplode(S.six_frames("seq")).alias("i", "protein")
    return sequences(spark, sf_dir).select("doc_id", six).select("doc_id", F.when(F.col("i") < 3, "+").otherwise("-").alias("strand"), (F.col("i") % 3).alias("frame"), "protein")


def translate_6frame(spark, sf_dir):
    return _frames(spark, sf_dir).select("doc_id", "strand", "frame", F.length("protein").alias("n_aa"), S.base_count("protein", "*").alias("n_stops"), F.md5("protein").alias("protein_md5"))


def orf_top_per_frame(spark, sf_dir):
    """Longest stop-free stretch of each frame, and the best frame of each strand by it."""
    orfs = F.transform(F.split("protein", r"\*"), lambda x: F.length(x))
    f = _frames(spark, sf_dir).select("doc_id", "strand", "frame", F.array_max(orfs).alias("orf_aa"))
    w = W.partitionBy("doc_id", "strand").orderBy(F.desc("orf_aa"), "frame")
    return f.withColumn("rank", F.row_number().over(w)).select("doc_id", "strand", "frame", "orf_aa", "rank")


def codon_usage(spark, sf_dir):
    c = word_counts(sequences(spark, sf_dir), 3, 3)
    codon = F.concat(*[F.substr(F.lit("ACGT"), (F.floor(F.col("code") / d) % 4 + 1).cast("int"), F.lit(1)) for d in (16, 4, 1)])
    return c.select(codon.alias("codon"), "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 9).alias("freq"))  # 64 rows


def gc_bins(spark, sf_dir):
    """Histogram of GC content in 100 bins with its running share."""
    b = sequences(spark, sf_dir).select(F.least(F.floor(S.gc_content("seq") * 100), F.lit(99)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return b.select("bin", "n", F.round(F.sum("n").over(W.orderBy("bin")) / F.sum("n").over(W.partitionBy()), 6).alias("upto"))


def kmer_df(spark, sf_dir):
    """How many 12-mers occur in how many sequences: the document frequencies' distribution."""
    k = sequences(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(S.kmers("seq", 12))).alias("kmer"))
    return k.groupBy("kmer").agg(F.count("*").alias("df")).groupBy("df").agg(F.count("*").alias("n_kmers"))


def hexamer_counts(spark, sf_dir):
    return word_counts(sequences(spark, sf_dir), 6)


def decoy_codon_reverse(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", F.md5(S.decoy_codon_reverse("seq")).alias("decoy_md5"))


def terminal_profile(spark, sf_dir):
    return P.terminal_counts(sequences(spark, sf_dir))


def damage_profile_by_target(spark, sf_dir):
    """T/(T+C) at the first 25 positions of each language's sequences."""
    s = sequences(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    bases = F.posexplode(F.filter(F.split(F.substring("seq", 1, 25), ""), lambda c: c != ""))
    counts = s.select("lang", bases.alias("pos", "base")).groupBy("lang", "pos", "base").agg(F.count("*").alias("n"))
    return P.position_ratios(counts, ["lang"]).select("lang", "pos", "t", "c", F.round("tc", 6).alias("tc"))


def sample_profile(spark, sf_dir):
    """Fitted damage profile of the whole sample; the fits are numeric, so there is no SQL for it."""
    p = P.sample_profile(sequences(spark, sf_dir))
    rows = [(c, float(p[c]["baseline"]), float(p[c]["amplitude"]), float(p[c]["rate"]), float(p[c]["llr"]), float(p[c]["joint_d_max"]), float(p[c]["joint_p_damage"])) for c in ("5p", "3p")]
    return spark.createDataFrame(rows, "channel string, baseline double, amplitude double, rate double, llr double, d_max double, p_damage double")


def sample_counts(spark, sf_dir):
    """All counts that the sample's damage models need."""
    return SC.counts(sequences(spark, sf_dir)).select("channel", "a", "b", F.col("n").cast("long").alias("n"))


def sample_models(spark, sf_dir):
    """The sample's fits, one row a named figure; numeric, so there is no SQL for it (its counts have)."""
    m = SM.fit(SC.counts(sequences(spark, sf_dir)))
    flat = {f"{e}_{k}": float(m[e][k]) for e in ("5p", "3p") for k in ("shift", "z", "baseline", "amplitude", "rate", "llr", "control_shift", "wobble")}
    flat |= {f"stops_{k}": float(m["stops"][k]) for k in ("baseline", "amplitude", "llr", "d_max", "slope")} | {f"oxidation_{k}": float(m["oxidation"][k]) for k in ("baseline", "uniformity", "level")}
    flat |= {"gc_d_max": m["gc"]["d_max"], "gc_peak": m["gc"]["peak"], "hexamer_llr": m["hexamer_llr"], "classes": float(len(m["mixture"]["levels"])), "factor": m["factor"], "d_max": float(m["d_max"])}
    return spark.createDataFrame([(k, round(v, 6)) for k, v in flat.items()], "name string, value double")


def read_damage(spark, sf_dir):
    """Each sequence's probability of bearing damage at fixed sample parameters; numeric, so there is no SQL for it."""
    return sequences(spark, sf_dir).select("doc_id", F.round(RD.damage_prior("seq", D_MAX, RATE), 6).alias("p_damaged"))


def _sample(spark, sf_dir) -> dict:
    return LV.estimate(sequences(spark, sf_dir), SM.fit)


def sample_level(spark, sf_dir):
    """The sample's level as agreed on: its source, state, blend, joint model, components, and whether a second pass was taken."""
    m = _sample(spark, sf_dir)
    text = {"source": m["level_source"], "state": m["state"]}
    figures = {"level": m["level"], "blended": m["blended"], "drawn": m["drawn"], "passes": m["passes"]} | {f"joint_{k}": m["joint"][k] for k in ("d_max", "rate", "artefact", "p_damage")} | {f"components_{k}": m["components"][k] for k in ("d_mean", "d_damaged", "share")}
    rows = [(k, v, None) for k, v in text.items()] + [(k, None, round(float(v), 6)) for k, v in figures.items()]
    return spark.createDataFrame(rows, "name string, text string, value double")


def read_damage_percent(spark, sf_dir):
    """Each sequence's own level of damage in percent, under the sample's fits, and its expected terminal damage."""
    m = _sample(spark, sf_dir)
    bins = {b["bin"]: (b["d_max"], b["baseline"]) for b in m["gc"]["bins"]}
    rates = m["5p"]["rate"], m["3p"]["rate"]
    percent = RD.damage_percentage("seq", m["level"], rates, (m["5p"]["baseline"], m["3p"]["baseline"]), bins, m["state"] == "contradicted")
    return sequences(spark, sf_dir).select("doc_id", F.round(percent, 6).alias("percent"), F.round(RD.damage_terminal("seq", D_MAX, rates, m["factor"]), 6).alias("terminal"))


def read_damage_signal(spark, sf_dir):
    """Signal of damage from the outer bases alone."""
    return sequences(spark, sf_dir).select("doc_id", F.round(RD.damage_signal("seq"), 6).alias("signal"))


def _pairs(spark, sf_dir):
    """Ungapped protein alignments: frame-0 proteins of consecutive documents, cut to the shorter; forward strand."""
    p = sequences(spark, sf_dir).select("doc_id", S.translate("seq").alias("protein"))
    q, t = p.select("doc_id", F.col("protein").alias("qp")), p.select((F.col("doc_id") - 1).alias("doc_id"), F.col("protein").alias("tp"))
    n = F.least(F.length("qp"), F.length("tp"))
    return q.join(t, "doc_id").select("doc_id", F.substr("qp", F.lit(1), n).alias("qaln"), F.substr("tp", F.lit(1), n).alias("taln"), F.lit(1).alias("qstart"), F.lit(1).alias("tstart"), n.alias("qlen"), F.lit(False).alias("reverse"))


D_MAX, RATE = 0.3, 0.3


def _annotated(spark, sf_dir, max_dist=None):
    return N.annotate(_pairs(spark, sf_dir), D_MAX, RATE, max_dist).where("aligned > 0")


def damage_sites(spark, sf_dir):
    return _annotated(spark, sf_dir).select("doc_id", "aligned", "mismatches", "m", "k", "high_conf", "ct_sites", "ga_sites", "terminal_5", "terminal_3", F.round("sum_decay", 6).alias("sum_decay"), F.round("max_p_damage", 6).alias("max_p_damage"), F.round("damage_fraction", 6).alias("damage_fraction"), F.round("p_damaged", 6).alias("p_damaged"))


def damage_sites_near(spark, sf_dir):
    """Sites of at most 12 nucleotides from their end."""
    return _annotated(spark, sf_dir, 12).select("doc_id", "k", "ct_sites", "ga_sites", F.round("p_damaged", 6).alias("p_damaged"))


def alignment_evidence(spark, sf_dir):
    return _annotated(spark, sf_dir).where("m > 0").select("doc_id", "k", "m", F.round("ll_a", 5).alias("ll_a"), F.round("ll_m", 5).alias("ll_m"))


def bayesian_score(spark, sf_dir):
    s = _annotated(spark, sf_dir).withColumn("p_read", 0.02 + (F.col("doc_id") % 97) / 100.0).withColumn("fident", 0.85 + (F.col("doc_id") % 15) / 100.0)
    b = N.bayesian(s, D_MAX)
    return b.select("doc_id", F.round("log_bf_terminal", 5).alias("log_bf_terminal"), F.round("log_bf_sites", 5).alias("log_bf_sites"), F.round("log_bf_identity", 5).alias("log_bf_identity"), F.round("posterior", 6).alias("posterior"), "tier", "damage_call")


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.select(F.col("event_id").alias("id"), F.col("value").alias("score"), (F.col("event_type") == "error").alias("is_decoy"))


def qvalues(spark, sf_dir):
    return D.q_values(_events(spark, sf_dir)).select("id", "score", F.round("q", 9).alias("q"))


def fdr_threshold(spark, sf_dir):
    return D.threshold_for_fdr(_events(spark, sf_dir), 0.2).select("threshold", F.round("fdr", 9).alias("fdr"))


def pep(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("score", F.col("score") / 100.0)
    return D.pep(e).select("id", F.round("pep", 6).alias("pep"))


def _labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select((F.col("n_chars") / 10000.0).alias("score"), F.col("quality").alias("label"))


def auc(spark, sf_dir):
    return D.auc(_labelled(spark, sf_dir)).select(F.round("auc", 9).alias("auc"), "n_pos", "n_neg")


def confusion_grid(spark, sf_dir):
    c = D.confusion(_labelled(spark, sf_dir), [i / 20 for i in range(1, 9)])
    return c.select("threshold", "tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


def minimizers(spark, sf_dir):
    return K.minimizers(sequences(spark, sf_dir))


def seed_pairs(spark, sf_dir):
    return K.seed_pairs(K.minimizers(sequences(spark, sf_dir)))


def components(spark, sf_dir):
    """Clusters of sequences that share a minimizer, through whatever chain."""
    return K.components(K.star_edges(K.minimizers(sequences(spark, sf_dir)))).select(F.col("node").alias("doc_id"), F.col("root").alias("cluster_id"))


def cluster_vote(spark, sf_dir):
    """Strand calls by language clusters: each sequence's purine excess, summed over its cluster."""
    s = sequences(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", "lang", "source").alias("cluster")), "doc_id")
    s = s.withColumn("score", (S.base_count("seq", "A") + S.base_count("seq", "G") - S.base_count("seq", "C") - S.base_count("seq", "T")).cast("double"))
    return K.vote(s, "cluster", "score").select("doc_id", "cluster", "score", "vote", "call")


def consensus_pileup(spark, sf_dir):
    """Majority base of each position of the first 100 columns' pileup by language and of all columns beyond by language alike."""
    s = sequences(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    rows = s.select("lang", F.posexplode(S.bases("seq")).alias("pos", "residue"))
    return K.consensus(rows, ["lang"])


_FRAMES = SEQ + """, st AS (SELECT doc_id, '+' AS strand, seq AS s FROM seqs UNION ALL SELECT doc_id, '-', translate(reverse(seq),'ACGT','TGCA') FROM seqs),
fr AS (SELECT doc_id, strand, frame, regexp_extract_all(s[CAST(frame AS INT)+1:], '...') AS cs FROM st, (SELECT unnest([0,1,2]) AS frame)),
pr AS (SELECT doc_id, strand, frame, array_to_string(list_transform(cs, lambda c: substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST((strpos('TCAG',c[1])-1)*16+(strpos('TCAG',c[2])-1)*4+strpos('TCAG',c[3]) AS INT), 1)), '') AS protein FROM fr)"""
_MIN = SEQ + """, km AS (SELECT doc_id, i, seq[i+1:i+15] AS k FROM (SELECT doc_id, seq, unnest(range(0, length(seq)-14)) AS i FROM seqs)),
kd AS (SELECT doc_id, i, list_reduce(list_transform(string_split(translate(k,'ACGT','0123'),''), lambda x: CAST(x AS BIGINT)), lambda a, x: a*4+x) AS f,
 list_reduce(list_transform(string_split(translate(reverse(k),'ACGT','3210'),''), lambda x: CAST(x AS BIGINT)), lambda a, x: a*4+x) AS b FROM km),
hh AS (SELECT doc_id, i, CAST((least(f,b)*2654435761) % 4294967291 AS BIGINT) AS h FROM kd),
lw AS (SELECT doc_id, i, min(h) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS low FROM hh),
mn AS (SELECT doc_id, low AS h FROM (SELECT DISTINCT doc_id, low FROM lw WHERE i >= 19) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY low) <= 4)"""
_T2Q = "(VALUES " + ", ".join(f"('{t}{q}','{c}',{h})" for t, q, c, h in N.SUBSTITUTIONS) + ") AS sub(tq, cls, high)"
_C = ",".join(f"'{x}'" for x in N._classes("C"))
_G = ",".join(f"'{x}'" for x in N._classes("G"))
_SITES = SEQ + f""", p0 AS (SELECT doc_id, regexp_extract_all(seq, '...') AS cs FROM seqs),
p1 AS (SELECT doc_id, list_transform(cs, lambda c: substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST((strpos('TCAG',c[1])-1)*16+(strpos('TCAG',c[2])-1)*4+strpos('TCAG',c[3]) AS INT), 1)) AS pr FROM p0),
pa AS (SELECT a.doc_id, a.pr AS qp, b.pr AS tp, least(len(a.pr), len(b.pr)) AS n FROM p1 a JOIN p1 b ON b.doc_id = a.doc_id + 1),
c0 AS (SELECT doc_id, n, i, qp[i+1] AS q, tp[i+1] AS t FROM (SELECT *, unnest(range(0, n)) AS i FROM pa)),
si AS (SELECT c0.*, 3*i AS d5, 3*(n-1-i) AS d3, t IN ({_C}) AS co, t IN ({_G}) AS go, cls, high FROM c0 LEFT JOIN {_T2Q} ON tq = t || q),
sx AS (SELECT *, CASE WHEN co THEN exp(CAST(-0.3 AS DOUBLE)*d5) ELSE 0 END AS dc, CASE WHEN go THEN exp(CAST(-0.3 AS DOUBLE)*d3) ELSE 0 END AS dg,
 CASE cls WHEN 'C' THEN CAST(0.3 AS DOUBLE)*exp(CAST(-0.3 AS DOUBLE)*d5) WHEN 'G' THEN CAST(0.3 AS DOUBLE)*exp(CAST(-0.3 AS DOUBLE)*d3) END AS pd FROM si)"""


def _summary_sql(source: str, no_site: str) -> str:
    n = lambda c: f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"
    return f""", su AS (SELECT doc_id, count(*) AS aligned, {n('q <> t')} AS mismatches, {n('co OR go')} AS m, {n('cls IS NOT NULL')} AS k, {n('high = 1')} AS high_conf, {n("cls = 'C'")} AS ct_sites, {n("cls = 'G'")} AS ga_sites,
 {n("cls = 'C' AND d5 < 9")} AS terminal_5, {n("cls = 'G' AND d3 < 9")} AS terminal_3, sum(greatest(dc,dg)) AS sum_decay, coalesce(max(pd),0) AS max_p_damage,
 sum(least(greatest(ln(greatest(pd,0.01)/0.01),-3),5)) AS llr, coalesce(sum(ln((pd+0.005)/0.005)),0) AS sum_log FROM {source} GROUP BY doc_id),
 sz AS (SELECT *, CASE WHEN mismatches > 0 THEN k/mismatches ELSE 0 END AS damage_fraction, CASE WHEN k > 0 THEN 1/(1+exp(-least(greatest(llr,-10),10))) ELSE {no_site} END AS p_damaged FROM su)"""


_EV = "ev AS (SELECT event_id AS id, value AS score, event_type = 'error' AS dec FROM events WHERE value IS NOT NULL)"
_LAB = "lb AS (SELECT n_chars/CAST(10000.0 AS DOUBLE) AS score, quality AS label FROM labels JOIN documents USING (doc_id))"
_LG = "ln(least(greatest({0},1e-9),1-1e-9)/(1-least(greatest({0},1e-9),1-1e-9)))"
_D4 = "list_reduce(list_transform(string_split(translate({0},'ACGT','0123'),''), lambda x: CAST(x AS BIGINT)), lambda a, x: a*4+x)"
_ENDS = "range(0,15) r(p)"
_SAMPLE = SEQ + """, sl AS (SELECT seq, length(seq) AS n, CAST(least(floor((length(seq[6:length(seq)-5])-length(translate(seq[6:length(seq)-5],'GC','')))*10/length(seq[6:length(seq)-5])),9) AS BIGINT) AS gb, seq[length(seq)//3+1:2*length(seq)//3] AS mid FROM seqs),
m AS (SELECT unnest(['A','C','G','T']) AS b), kd AS (SELECT * FROM (VALUES ('CAA','stop'),('CAG','stop'),('CGA','stop'),('TAA','stop'),('TAG','stop'),('TGA','stop'),('GAG','ox'),('GAA','ox'),('GGA','ox'),('TAA','ox'),('TAG','ox'),('TGA','ox')) v(cd, ch)),
co AS (SELECT ch, p, cd, gb FROM sl, range(0,15) r(p) JOIN kd ON cd = seq[p+1:p+3]), ci AS (SELECT ch, cd FROM (SELECT seq, unnest(range(30, n-32)) AS p FROM sl WHERE n >= 63) JOIN kd ON cd = seq[p+1:p+3])"""
_SAMPLE_ROWS = f"""SELECT '5p' AS channel, p AS a, seq[p+1] AS b FROM sl, {_ENDS} UNION ALL SELECT '3p', p, seq[n-p] FROM sl, {_ENDS} UNION ALL SELECT 'phase5', p % 3, seq[p+1] FROM sl, {_ENDS} UNION ALL SELECT 'phase3', p % 3, seq[n-p] FROM sl, {_ENDS}
 UNION ALL SELECT 'cpg', p, seq[p+1:p+2] FROM sl, range(0,5) r(p) WHERE seq[p+1:p+2] IN ('CG','TG') UNION ALL SELECT 'gc', gb, 'reads' FROM sl UNION ALL SELECT 'gc5', gb*100+p, seq[p+1] FROM sl, {_ENDS} WHERE seq[p+1] IN ('C','T')
 UNION ALL SELECT ch, p, cd FROM co UNION ALL SELECT ch || '_in', 0, cd FROM ci UNION ALL SELECT 'gcstop', gb*100+p, CASE WHEN cd IN ('TAA','TAG','TGA') THEN 'stop' ELSE 'pre' END FROM co WHERE ch = 'stop'
 UNION ALL SELECT 'hex5', {_D4.format('seq[1:6]')}, '' FROM sl UNION ALL SELECT 'hexmid', {_D4.format('seq[n//2-2:n//2+3]')}, '' FROM sl"""
ORACLE = {
    "sample_counts": f"WITH {_SAMPLE}, rw AS ({_SAMPLE_ROWS}), al AS (SELECT channel, a, b, count(*) AS n FROM rw GROUP BY ALL UNION ALL SELECT 'mid', 0, b, CAST(sum(length(mid)-length(replace(mid,b,''))) AS BIGINT) FROM sl, m GROUP BY b UNION ALL SELECT 'gcmid', gb, b, CAST(sum(length(mid)-length(replace(mid,b,''))) AS BIGINT) FROM sl, m WHERE b IN ('C','T') GROUP BY gb, b) SELECT channel, CAST(a AS BIGINT) AS a, b, n FROM al WHERE n > 0",
    "revcomp": f"WITH {SEQ} SELECT doc_id, translate(reverse(seq),'ACGT','TGCA') AS rc, round((length(seq)-length(translate(seq,'GC','')))/length(seq),6) AS gc FROM seqs",
    "translate_6frame": f"WITH {_FRAMES} SELECT doc_id, strand, CAST(frame AS INT) AS frame, CAST(length(protein) AS INT) AS n_aa, length(protein)-length(replace(protein,'*','')) AS n_stops, md5(protein) AS protein_md5 FROM pr",
    "orf_top_per_frame": f"WITH {_FRAMES}, o AS (SELECT doc_id, strand, CAST(frame AS INT) AS frame, CAST(list_max(list_transform(string_split(protein,'*'), lambda x: length(x))) AS INT) AS orf_aa FROM pr) SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, strand ORDER BY orf_aa DESC, frame) AS INT) AS rank FROM o",
    "codon_usage": f"WITH {SEQ}, c AS (SELECT codon, count(*) AS n FROM (SELECT unnest(regexp_extract_all(seq,'...')) AS codon FROM seqs) GROUP BY 1) SELECT codon, n, round(n/(SELECT sum(n) FROM c),9) AS freq FROM c",
    "gc_bins": f"WITH {SEQ}, b AS (SELECT CAST(least(floor((length(seq)-length(translate(seq,'GC','')))/length(seq)*100),99) AS BIGINT) AS bin, count(*) AS n FROM seqs GROUP BY 1) SELECT bin, n, round(sum(n) OVER (ORDER BY bin)/sum(n) OVER (),6) AS upto FROM b",
    "kmer_df": f"WITH {SEQ}, k AS (SELECT DISTINCT doc_id, seq[i+1:i+12] AS kmer FROM (SELECT doc_id, seq, unnest(range(0, length(seq)-11)) AS i FROM seqs)) SELECT df, count(*) AS n_kmers FROM (SELECT kmer, count(*) AS df FROM k GROUP BY 1) GROUP BY 1",
    "hexamer_counts": f"WITH {SEQ}, k AS (SELECT seq[i+1:i+6] AS k, count(*) AS n FROM (SELECT seq, unnest(range(0, length(seq)-5)) AS i FROM seqs) GROUP BY 1) SELECT list_reduce(list_transform(string_split(translate(k,'ACGT','0123'),''), lambda x: CAST(x AS BIGINT)), lambda a, x: a*4+x) AS code, n FROM k",
    "decoy_codon_reverse": f"WITH {SEQ} SELECT doc_id, md5(array_to_string(list_reverse(regexp_extract_all(seq,'...')),'') || seq[(length(seq)//3)*3+1:]) AS decoy_md5 FROM seqs",
    "terminal_profile": f"WITH {SEQ}, c AS (SELECT '5p' AS channel, CAST(p AS INT) AS pos, seq[p+1] AS base FROM seqs, range(0,15) r(p) UNION ALL SELECT '3p', CAST(p AS INT), seq[length(seq)-p] FROM seqs, range(0,15) r(p)) SELECT channel, pos, base, count(*) AS n FROM c GROUP BY ALL",
    "damage_profile_by_target": f"""WITH {SEQ}, c AS (SELECT lang, CAST(p AS INT) AS pos, seq[p+1] AS b FROM seqs JOIN documents USING (doc_id), range(0,25) r(p) WHERE p < length(seq)), s AS (SELECT lang, pos, CAST(sum(CASE WHEN b='T' THEN 1 ELSE 0 END) AS BIGINT) AS t, CAST(sum(CASE WHEN b='C' THEN 1 ELSE 0 END) AS BIGINT) AS c FROM c GROUP BY ALL)
 SELECT lang, pos, t, c, round(CASE WHEN t+c > 0 THEN t/(t+c) ELSE 0.5 END,6) AS tc FROM s""",
    "damage_sites": f"WITH {_SITES}{_summary_sql('sx', '0.5')} SELECT doc_id, aligned, mismatches, m, k, high_conf, ct_sites, ga_sites, terminal_5, terminal_3, round(sum_decay,6) AS sum_decay, round(max_p_damage,6) AS max_p_damage, round(damage_fraction,6) AS damage_fraction, round(p_damaged,6) AS p_damaged FROM sz",
    "damage_sites_near": f"""WITH {_SITES}, sn AS (SELECT doc_id, n, i, q, t, d5, d3, co, go, dc, dg, CASE WHEN far THEN NULL ELSE cls END AS cls, CASE WHEN far THEN NULL ELSE high END AS high, CASE WHEN far THEN NULL ELSE pd END AS pd
 FROM (SELECT *, coalesce(CASE cls WHEN 'C' THEN d5 WHEN 'G' THEN d3 END > 12, false) AS far FROM sx)){_summary_sql('sn', '0')} SELECT doc_id, k, ct_sites, ga_sites, round(p_damaged,6) AS p_damaged FROM sz""",
    "alignment_evidence": f"""WITH {_SITES} SELECT doc_id, CAST(sum(CASE WHEN cls IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS k, count(*) AS m,
 round(sum(CASE WHEN cls IS NOT NULL THEN ln(least(greatest(pd+0.005,1e-8),1-1e-8)) ELSE ln(least(greatest(1-(CAST(0.3 AS DOUBLE)*greatest(dc,dg)+0.005),1e-8),1-1e-8)) END),5) AS ll_a,
 round(sum(CASE WHEN cls IS NOT NULL THEN ln(CAST(0.005 AS DOUBLE)) ELSE ln(CAST(0.995 AS DOUBLE)) END),5) AS ll_m FROM sx WHERE co OR go GROUP BY doc_id""",
    "bayesian_score": f"""WITH {_SITES}{_summary_sql('sx', '0.5')}, b0 AS (SELECT *, CAST(0.02 AS DOUBLE)+(doc_id%97)/100 AS p_read, CAST(0.85 AS DOUBLE)+(doc_id%15)/100 AS fident, CAST(0.09 AS DOUBLE)*CASE WHEN m > 0 THEN sum_decay/m ELSE 0.12 END + 0.005 AS qe FROM sz),
 b1 AS (SELECT *, CASE WHEN p_read > 0.01 THEN {_LG.format('p_read')} - {_LG.format('CAST(0.1 AS DOUBLE)')} ELSE 0 END AS bt,
 CASE WHEN m >= 1 THEN least(greatest(k*ln(qe/0.005) + CASE WHEN m > k AND qe > 0.005 THEN CAST(0.3 AS DOUBLE)*(m-k)*ln((1-qe)/0.995) ELSE 0 END,-3),3) ELSE 0 END AS bs, least(greatest(20*(fident-CAST(0.9 AS DOUBLE)),-5),5) AS bi FROM b0),
 b2 AS (SELECT *, 1/(1+exp(-({_LG.format('CAST(0.1 AS DOUBLE)')}+bt+bs+bi))) AS posterior FROM b1)
 SELECT doc_id, round(bt,5) AS log_bf_terminal, round(bs,5) AS log_bf_sites, round(bi,5) AS log_bf_identity, round(posterior,6) AS posterior, CASE WHEN p_read >= 0.5 AND k > 0 THEN 'convergent' WHEN p_read >= 0.5 THEN 'terminal' WHEN k > 0 THEN 'sites' ELSE 'none' END AS tier,
 CASE WHEN posterior >= 0.6 THEN 'ancient' WHEN posterior <= 0.25 THEN 'modern' ELSE 'uncertain' END AS damage_call FROM b2""",
    "qvalues": f"""WITH {_EV}, c AS (SELECT score, sum(CASE WHEN dec THEN 0 ELSE 1 END) AS t, sum(CASE WHEN dec THEN 1 ELSE 0 END) AS d FROM ev GROUP BY score), r AS (SELECT score, sum(t) OVER w AS ct, sum(d) OVER w AS cd FROM c WINDOW w AS (ORDER BY score DESC)),
 q AS (SELECT score, min(cd/(ct+cd)) OVER (ORDER BY score) AS q FROM r) SELECT id, ev.score, round(q,9) AS q FROM ev JOIN q ON ev.score = q.score WHERE NOT dec""",
    "fdr_threshold": f"""WITH {_EV}, g AS (SELECT i, (SELECT count(*) FROM ev WHERE floor(score*100) >= i AND NOT dec) AS t, (SELECT count(*) FROM ev WHERE floor(score*100) >= i AND dec) AS d FROM range(0, (SELECT CAST(ceil(max(score)*100) AS BIGINT)+1 FROM ev)) r(i)),
 f AS (SELECT i, CASE WHEN t+d > 0 THEN d/(t+d) ELSE 0 END AS fdr FROM g) SELECT i/CAST(100 AS DOUBLE) AS threshold, round(fdr,9) AS fdr FROM f WHERE fdr <= 0.2 ORDER BY i LIMIT 1""",
    "pep": f"""WITH {_EV}, e AS (SELECT id, score/100 AS score, dec FROM ev), s AS (SELECT sum(CASE WHEN dec THEN 0 ELSE 1 END) AS nt, sum(CASE WHEN dec THEN 1 ELSE 0 END) AS nd, avg(CASE WHEN dec THEN score END) AS mu, var_pop(CASE WHEN dec THEN score END)+1e-6 AS v FROM e),
 z AS (SELECT *, least(greatest(nd/greatest(nt,1),0.01),0.99) AS pi0 FROM s), p AS (SELECT id, pi0*exp(-(score-mu)*(score-mu)/(2*v))/sqrt(2*CAST(3.141592653589793 AS DOUBLE)*v) AS a, (1-pi0)*2*exp(2*(score-1)) AS b FROM e, z WHERE NOT dec) SELECT id, round(a/(a+b),6) AS pep FROM p""",
    "auc": f"WITH {_LAB}, c AS (SELECT score, sum(CASE WHEN label=1 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN label=0 THEN 1 ELSE 0 END) AS n FROM lb GROUP BY score), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS w FROM c) SELECT round(sum(p*(w+n/2))/(sum(p)*sum(n)),9) AS auc, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg FROM b",
    "confusion_grid": f"""WITH {_LAB}, g AS (SELECT i/CAST(20 AS DOUBLE) AS threshold FROM range(1,9) r(i)), c AS (SELECT threshold, count(*) FILTER (label=1 AND score>=threshold) AS tp, count(*) FILTER (label=0 AND score>=threshold) AS fp, count(*) FILTER (label=1 AND score<threshold) AS fn, count(*) FILTER (label=0 AND score<threshold) AS tn FROM lb, g GROUP BY threshold)
 SELECT threshold, tp, fp, fn, tn, round(CASE WHEN tp+fp > 0 THEN tp/(tp+fp) ELSE 0 END,6) AS precision, round(CASE WHEN tp+fn > 0 THEN tp/(tp+fn) ELSE 0 END,6) AS recall, round(CASE WHEN tp > 0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END,6) AS f1 FROM c""",
    "minimizers": f"WITH {_MIN} SELECT doc_id, h FROM mn",
    "seed_pairs": f"WITH {_MIN}, s AS (SELECT * FROM mn WHERE h IN (SELECT h FROM mn GROUP BY h HAVING count(*) BETWEEN 2 AND 64)) SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL",
    "cluster_vote": f"""WITH {SEQ}, s AS (SELECT doc_id, concat_ws('-', lang, source) AS cluster, CAST(2*(length(seq)-length(translate(seq,'AG','')))-length(seq) AS DOUBLE) AS score FROM seqs JOIN documents USING (doc_id)), v AS (SELECT *, sum(score) OVER (PARTITION BY cluster) AS vote, sum(abs(score)) OVER (PARTITION BY cluster) AS w FROM s)
 SELECT doc_id, cluster, score, vote, CASE WHEN abs(vote) >= 0.6*w THEN CASE WHEN vote >= 0 THEN '+' ELSE '-' END WHEN score >= 0 THEN '+' ELSE '-' END AS call FROM v""",
    "consensus_pileup": f"""WITH {SEQ}, c AS (SELECT lang, pos, residue, count(*) AS n FROM (SELECT lang, seq[p+1] AS residue, CAST(p AS INT) AS pos FROM (SELECT lang, seq, unnest(range(0,length(seq))) AS p FROM seqs JOIN documents USING (doc_id))) GROUP BY ALL),
 r AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(n) OVER w,0) AS sec, sum(n) OVER (PARTITION BY lang, pos) AS depth FROM c WINDOW w AS (PARTITION BY lang, pos ORDER BY n DESC, residue)) SELECT lang, pos, residue, n, CAST(depth AS BIGINT) AS depth, CAST(depth >= 3 AND n >= 2*sec AS INT) AS candidate FROM r WHERE rn = 1""",
}
ORACLE["read_damage_signal"] = f"""WITH {SEQ}, odds AS (SELECT doc_id, CAST(CASE WHEN substr(seq, 1, 1) = 'T' THEN 0.8 ELSE 0 END
 + CASE WHEN substr(seq, 2, 1) = 'T' THEN 0.35 ELSE 0 END
 + CASE WHEN substr(seq, 3, 1) = 'T' THEN 0.15 ELSE 0 END
 + CASE WHEN substr(seq, length(seq) - 0, 1) = 'A' THEN 0.7 ELSE 0 END
 + CASE WHEN substr(seq, length(seq) - 1, 1) = 'A' THEN 0.3 ELSE 0 END
 + CASE WHEN substr(seq, length(seq) - 2, 1) = 'A' THEN 0.12 ELSE 0 END
 + CASE WHEN seq[1] = 'C' THEN -0.3 ELSE 0 END
 + CASE WHEN substr(seq, length(seq), 1) = 'G' THEN -0.25 ELSE 0 END
 + CASE WHEN seq[1] = 'T' AND substr(seq, length(seq), 1) = 'A' THEN 0.4 ELSE 0 END AS DOUBLE) AS x FROM seqs)
SELECT doc_id, round(greatest(0.05, least(0.95, 1 / (1 + exp(-x)))), 6) AS signal FROM odds"""
QUERIES = {name: globals()[name] for name in [*ORACLE, "sample_profile", "sample_models", "read_damage", "components", "sample_level", "read_damage_percent"]}
