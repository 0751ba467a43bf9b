"""Settings that the data decide, reference statistics, neighbours, votes, labels and frame scores."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from palisade.functions import codons as Q
from palisade.functions import sequence as S
from palisade.operators import annotate as N
from palisade.operators import clustering as K
from palisade.operators import coverage as C
from palisade.operators import fdr as D
from palisade.operators import markov as M
from palisade.operators import report as R
from palisade.operators.frames import frame_scores as score_frames
from palisade.operators.ranges import Ranges, lower_rank
from palisade.plans.adapters import ALN, SEQ, alignments, sequences
from palisade.plans.alignment_queries import SEGMENTS
from palisade.plans.chain_queries import _HITS, _IDX, _SITES, _STRIP, _SU, damage_index, hits
from palisade.plans.sequence_queries import _EV, _FRAMES, _MIN, D_MAX, RATE, _events, _frames
from palisade.session import table


def _annotated(spark, sf_dir):
    rows = R.read_damage(hits(spark, sf_dir), damage_index(spark, sf_dir)).withColumn("reverse", F.col("query_id").rlike("_-_[0-9]+$"))
    return N.annotate(rows, D_MAX, RATE).withColumnRenamed("query_id", "read_id")


def estimated_d_max(spark, sf_dir):
    return N.estimate_d_max(_annotated(spark, sf_dir)).select(F.round("d_max", 9).alias("d_max"))


def data_settings(spark, sf_dir):
    return N.settings_from(_annotated(spark, sf_dir)).select(F.round("prior", 6).alias("prior"), "both_ends", "mode")


def silent_damage(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", *N.silent_damage("seq", D_MAX, RATE))


def index_codons(spark, sf_dir):
    """The codons that a damage index keeps of each sequence."""
    r = N.index_records(sequences(spark, sf_dir).withColumnRenamed("doc_id", "id"), D_MAX, RATE)
    return r.select(F.col("id").alias("doc_id"), F.array_join("codons_5", ",").alias("codons_5"), F.array_join("codons_3", ",").alias("codons_3"))


def first_hits(spark, sf_dir):
    """Each read's first hit in the order of rows, beside the read."""
    h = hits(spark, sf_dir).groupBy(S.strip_frame_suffix("query_id").alias("read_name")).agg(F.min_by("ref_id", "row_id").alias("ref_id"))
    reads = table(spark, sf_dir, "orders").selectExpr("'r' || CAST(o_orderkey AS STRING) AS read_name", "o_orderstatus AS status")
    return h.join(reads, "read_name").select("read_name", "ref_id", "status")


def reference_stats(spark, sf_dir):
    a = alignments(spark, sf_dir).withColumn("g", F.lit(1.0)).withColumn("anc", F.when(F.col("p_read") > 0.04, 1.0).otherwise(0.0)).withColumn("mod", 1.0 - F.col("anc"))
    s = C.reference_stats(a).withColumn("passes", C.passes(min_reads=20, min_breadth=0.8, min_identity=0.9053, min_enrichment=0.011).cast("int"))
    return s.select(*[F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


def seed_neighbours(spark, sf_dir):
    return K.neighbours(K.minimizers(sequences(spark, sf_dir)), 5).select("a", "b", F.round("score", 6).alias("score"), "rank")


def frame_vote(spark, sf_dir):
    lang = table(spark, sf_dir, "documents").select("doc_id", "lang")
    calls = _frames(spark, sf_dir).join(lang, "doc_id").select("doc_id", "lang", "strand", "frame", (F.length("protein") - 20 * S.base_count("protein", "*")).cast("double").alias("score"))
    return K.frame_vote(calls, "lang").select("doc_id", "lang", "strand", "frame", "vote")


def auc_by_rows(spark, sf_dir):
    return D.auc_by_rows(_ids(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


def _ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("doc_id").alias("id"), (F.col("n_chars") / 10000.0).alias("score"), F.col("quality").alias("label"))


def fdr_by_type(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null").select(F.expr("event_id % 4").alias("stratum"), F.col("value").alias("score"), (F.col("event_type") == "error").alias("is_decoy"))
    return D.fdr_by_stratum(e, "stratum", [i * 10.0 for i in range(8)]).select("stratum", "threshold", "targets", "decoys", F.round("fdr", 9).alias("fdr"))


def fdr_labels(spark, sf_dir):
    return D.labels(_events(spark, sf_dir), 0.2).select("id", F.round("fdr", 9).alias("fdr"), F.col("is_correct").cast("int").alias("is_correct"))


def calibration_table(spark, sf_dir):
    """Precision by bins of length and language, with all marginals (`all` and -1)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"), F.least(F.floor(F.col("n_chars") / 1000), F.lit(9)).alias("length_bin"))
    c = table(spark, sf_dir, "labels").join(d, "doc_id").cube("lang", "length_bin").agg(F.count("*").alias("n"), F.sum(F.col("quality").cast("long")).alias("correct"))
    return c.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("length_bin", F.lit(-1).cast("long")).alias("length_bin"), "n", "correct", F.round(F.col("correct") / F.col("n"), 6).alias("precision"))


def gc_threshold(spark, sf_dir):
    """The lowest hundredth of GC content at which 70 % of the sequences are reached."""
    b = sequences(spark, sf_dir).select(F.least(F.floor(S.gc_content("seq") * 100), F.lit(99)).alias("bin"))
    return lower_rank(b, "bin", "greatest(floor(n * 0.7D) - 1, 0)").select((F.col("bin") / 100.0).alias("threshold"), "n")


def median_length(spark, sf_dir):
    return lower_rank(alignments(spark, sf_dir), "aln_len", "n div 2").select(F.col("aln_len").alias("median"), "n")


def frame_scores(spark, sf_dir):
    """Each sequence's six frames by the table's own codon usage, and the best."""
    f = score_frames(sequences(spark, sf_dir))
    return f.select("doc_id", "strand", "frame", "n_codons", "stops", F.round("score", 6).alias("score"), "rank")


def codon_panel(spark, sf_dir):
    """Functions on codons over the first six codons of each sequence."""
    c = sequences(spark, sf_dir).select("doc_id", F.length("seq").alias("n"), F.posexplode(S.codons(F.substring("seq", 1, 18))).alias("i", "codon"))
    aa = F.try_element_at(F.create_map(*[F.lit(x) for kv in S.CODONS.items() for x in kv]), F.col("codon"))
    return c.select("doc_id", "i", "codon", Q.is_stop("codon").cast("int").alias("is_stop"), Q.is_start("codon").cast("int").alias("is_start"), Q.codon_number("codon").alias("number"), Q.codon_of(Q.codon_number("codon")).alias("again"), Q.codons_of(aa).alias("synonyms"),
                    Q.damaged_residue("codon", "C", "T").alias("ct"), Q.damaged_residue("codon", "G", "A").alias("ga"), Q.stop_origin("codon", F.col("i") * 3, "n").alias("origin"))


def frame_posteriors(spark, sf_dir):
    """Softmax and entropy of each sequence's six frames, whose scores are their shares of stops."""
    six = _frames(spark, sf_dir).select("doc_id", (-20.0 * S.base_count("protein", "*") / F.greatest(F.length("protein"), F.lit(1))).alias("s"))
    f = six.groupBy("doc_id").agg(F.collect_list("s").alias("s")).select("doc_id", Q.posterior("s", 2.0).alias("p"))  # six scores each
    return f.select("doc_id", F.round(F.array_max("p"), 6).alias("best"), F.round(Q.entropy("p"), 6).alias("entropy"))


def base_composition(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", *Q.composition("seq"))


def decay_slope(spark, sf_dir):
    """Least-squares slope of T/(T+C) over the first six positions of each language's sequences."""
    s = sequences(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    c = s.select("lang", F.posexplode(S.bases(F.substring("seq", 1, 6))).alias("pos", "b")).groupBy("lang", "pos").agg(F.sum((F.col("b") == "T").cast("long")).alias("t"), F.sum((F.col("b") == "C").cast("long")).alias("c"))
    return c.where("t + c > 0").groupBy("lang").agg(F.round(F.regr_slope(F.col("t") / (F.col("t") + F.col("c")), F.col("pos")), 9).alias("slope"))


def markov_counts(spark, sf_dir):
    """How often each base follows each pair in each phase, by fifths of GC."""
    return M.counts(sequences(spark, sf_dir), 5)


def targets_by_reads(spark, sf_dir):
    """References by the number of their reads, the most first, with their rank."""
    c = alignments(spark, sf_dir).groupBy("ref_id").agg(F.count("*").alias("n_reads"))
    r = Ranges(c.select("ref_id", "n_reads", F.struct((-F.col("n_reads")).alias("n"), "ref_id").alias("o"), F.lit(1).cast("long").alias("one")), "o").sums(rank="one").result()
    return r.select("ref_id", "n_reads", "rank")


def moments(spark, sf_dir):
    """Mean and spread of bits by aligned length; a spread under 1e-4 counts as 1."""
    s = alignments(spark, sf_dir).groupBy("aln_len").agg(F.count("*").alias("n"), F.avg("bits").alias("mean"), F.sqrt(F.greatest(F.avg(F.col("bits") ** 2) - F.avg("bits") ** 2, F.lit(0.0))).alias("sd"))
    return s.select("aln_len", "n", F.round("mean", 6).alias("mean"), F.round(F.when(F.col("sd") < 1e-4, 1.0).otherwise(F.col("sd")), 5).alias("sd"))


def damage_profile_wide(spark, sf_dir):
    """T/(T+C) of the first ten and A/(A+G) of the last ten positions, a row a language."""
    s = sequences(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    ends = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(i).alias("i"), (F.substring("seq", i + 1, 1) if e == "tc" else F.substring("seq", -1 - i, 1)).alias("b")) for e in ("tc", "ag") for i in range(10)])
    rows = s.select("lang", F.explode(ends).alias("x")).select("lang", F.concat("x.e", F.lit("_"), "x.i").alias("k"), F.when(F.col("x.b").isin("T", "A"), 1).otherwise(0).alias("up"), F.when(F.col("x.e") == "tc", F.col("x.b").isin("T", "C")).otherwise(F.col("x.b").isin("A", "G")).alias("ok"))
    return rows.where("ok").groupBy("lang").pivot("k", [f"{e}_{i}" for e in ("tc", "ag") for i in range(10)]).agg(F.round(F.avg("up"), 6))


def _silent_sql() -> str:
    parts: dict[str, list[str]] = {}
    for end, base, was in (("5", "T", "C"), ("3", "A", "G")):
        for i in range(5):
            at = f"{3 * i + 1}" if end == "5" else f"(n-1-{i})*3+1"
            for place in range(3):
                if D_MAX * math.exp(-RATE * (3 * i + (place if end == "5" else 2 - place))) < 0.05:
                    continue
                for name, those in zip(("silent", "changing"), N.silent_codons(base, was, place)):
                    if those:
                        parts.setdefault(f"{name}_{end}", []).append(f"CASE WHEN n > {i} AND substr(seq, {at}, 3) IN ({', '.join(repr(c) for c in those)}) THEN 1 ELSE 0 END")
    return ", ".join(f"CAST({' + '.join(parts.get(k, ['0']))} AS BIGINT) AS {k}" for k in ("silent_5", "changing_5", "silent_3", "changing_3"))


_CODON = lambda end: "concat_ws(','," + ",".join(f"CASE WHEN n > {i} THEN substr(seq, {f'{3 * i + 1}' if end == 5 else f'(n-1-{i})*3+1'}, 3) END" for i in range(5)) + ")"
_N3 = SEQ + ", sn AS (SELECT doc_id, seq, length(seq)//3 AS n FROM seqs)"
_ANN = f"{_HITS}, {_SITES}, {_SU}, {_IDX}, an AS (SELECT su.*, coalesce(p,0) AS p_read FROM su LEFT JOIN ixn ON name = {_STRIP})"
ORACLE = {
    "estimated_d_max": f"{_HITS}, {_SITES}, t AS (SELECT sum(CASE WHEN least(d5,d3) <= 9 THEN 1 ELSE 0 END) AS em, sum(CASE WHEN least(d5,d3) <= 9 AND cls IS NOT NULL THEN 1 ELSE 0 END) AS eh, count(*) AS m, count(cls) AS k FROM sx WHERE q <> t) SELECT round(least(0.5, 2*greatest(eh/em - (k-eh)/(m-em), 0)),9) AS d_max FROM t",
    "data_settings": f"{_ANN} SELECT round(least(greatest(avg(p_read),0.05),0.8),6) AS prior, CAST(sum(terminal_3)/sum(terminal_5) > 0.3 AS INT) AS both_ends, CASE WHEN max(abs(ll_a-ll_m)) > 0 THEN 'alignment' ELSE 'none' END AS mode FROM an",
    "silent_damage": f"WITH {_N3} SELECT doc_id, {_silent_sql()} FROM sn",
    "index_codons": f"WITH {_N3} SELECT doc_id, {_CODON(5)} AS codons_5, {_CODON(3)} AS codons_3 FROM sn",
    "first_hits": f"{_HITS}, f AS (SELECT {_STRIP} AS read_name, arg_min(ref_id, row_id) AS ref_id FROM hits GROUP BY 1) SELECT read_name, ref_id, o_orderstatus AS status FROM f JOIN orders ON read_name = 'r' || CAST(o_orderkey AS STRING)",
    "reference_stats": f"""WITH {ALN}, ga AS (SELECT *, CAST(1 AS DOUBLE) AS g FROM aln), {SEGMENTS},
 sp AS (SELECT *, least(greatest(tlen // 10, 2), tlen // 3) AS e, least(greatest(tstart,0),tlen) AS lo, least(tstart+aln_len, tlen) AS hi FROM ga),
 b AS (SELECT ref_id, count(*) AS n, max(tlen) AS tl, max(e) AS e, count(DISTINCT tstart) AS st, max(tstart)-min(tstart)+1 AS reach, avg(fident) AS ai, avg(aln_len) AS al, sum(CASE WHEN p_read > 0.04 THEN 1 ELSE 0 END) AS na, sum(CASE WHEN p_read > 0.04 THEN 0 ELSE 1 END) AS nm,
 sum(greatest(least(hi,e)-lo,0) + greatest(hi-greatest(lo,tlen-e),0)) AS ends, sum(greatest(least(hi,tlen-e)-greatest(lo,e),0)) AS mid FROM sp GROUP BY ref_id),
 x AS (SELECT b.*, coalesce(cov,0) AS cov, CASE WHEN cov > 0 THEN d1/cov ELSE 0 END AS dm, CASE WHEN cov > 0 THEN sqrt(greatest(d2/cov-(d1/cov)*(d1/cov),0)) ELSE 0 END AS dsd FROM b LEFT JOIN ds USING (ref_id)),
 y AS (SELECT ref_id, n AS n_reads, cov/tl AS breadth, dm AS depth_mean, dsd AS depth_std, CASE WHEN dm > 0 THEN 1-dsd/dm ELSE 0 END AS depth_evenness, ai AS avg_identity, al AS avg_alignment_length, sqrt(st/least(n,tl)*(reach/tl)) AS positional_score, (ends/(2*e)+CAST(0.01 AS DOUBLE))/(mid/(tl-2*e)+CAST(0.01 AS DOUBLE)) AS terminal_ratio,
 CASE WHEN na > 0 AND nm > 0 THEN log2(na/nm)-log2(CAST(0.1 AS DOUBLE)/CAST(0.9 AS DOUBLE)) ELSE 0 END AS damage_enrichment FROM x)
 SELECT ref_id, n_reads, {', '.join(f'round({c},8) AS {c}' for c in ('breadth', 'depth_mean', 'depth_std', 'depth_evenness', 'avg_identity', 'avg_alignment_length', 'positional_score', 'terminal_ratio', 'damage_enrichment'))},
 CAST(n_reads >= 20 AND breadth >= CAST(0.8 AS DOUBLE) AND depth_mean >= CAST(0.5 AS DOUBLE) AND avg_identity >= CAST(0.9053 AS DOUBLE) AND damage_enrichment >= CAST(0.011 AS DOUBLE) AS INT) AS passes FROM y""",
    "seed_neighbours": f"""WITH {_MIN}, w AS (SELECT h, power(ln((SELECT count(DISTINCT doc_id) FROM mn)/count(*)),2) AS w FROM mn GROUP BY h HAVING count(*) BETWEEN 2 AND 64), s AS (SELECT mn.doc_id, h, w FROM mn JOIN w USING (h)), nm AS (SELECT doc_id, sum(w) AS nw FROM s GROUP BY doc_id),
 p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.w) AS raw FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL), q AS (SELECT a, b, raw/sqrt(greatest(u.nw,1e-6)*greatest(v.nw,1e-6)) AS score FROM p JOIN nm u ON u.doc_id = a JOIN nm v ON v.doc_id = b WHERE raw > 0)
 SELECT a, b, round(score,6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(score,9) DESC, b) AS rank FROM q) WHERE rank <= 5""",
    "frame_vote": f"""WITH {_FRAMES}, c AS (SELECT doc_id, lang, strand, CAST(frame AS INT) AS frame, CAST(length(protein)-20*(length(protein)-length(replace(protein,'*',''))) AS DOUBLE) AS score FROM pr JOIN documents USING (doc_id)), v AS (SELECT lang, strand, frame, sum(score) AS vote FROM c GROUP BY ALL),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(vote,6) DESC, strand, frame) AS rn FROM v) WHERE rn = 1) SELECT DISTINCT c.doc_id, c.lang, b.strand, b.frame, b.vote FROM c JOIN b USING (lang)""",
    "auc_by_rows": "WITH l AS (SELECT doc_id AS id, n_chars/CAST(10000.0 AS DOUBLE) AS score, quality AS label FROM labels JOIN documents USING (doc_id)), r AS (SELECT label, sum(CASE WHEN label=1 THEN 1 ELSE 0 END) OVER (ORDER BY score DESC, id) AS tp FROM l) SELECT round(sum(CASE WHEN label=0 THEN tp ELSE 0 END)/(sum(CASE WHEN label=1 THEN 1 ELSE 0 END)*sum(CASE WHEN label=0 THEN 1 ELSE 0 END)),9) AS auc FROM r",
    "fdr_by_type": "WITH e AS (SELECT event_id % 4 AS stratum, value AS score, event_type = 'error' AS d FROM events WHERE value IS NOT NULL), g AS (SELECT stratum, CAST(i*10 AS DOUBLE) AS threshold, count(*) FILTER (score >= i*10 AND NOT d) AS targets, count(*) FILTER (score >= i*10 AND d) AS decoys FROM e, range(0,8) r(i) GROUP BY stratum, i) SELECT *, round(CASE WHEN targets+decoys > 0 THEN decoys/(targets+decoys) ELSE 0 END,9) AS fdr FROM g",
    "fdr_labels": f"WITH {_EV}, r AS (SELECT id, dec, sum(CASE WHEN dec THEN 0 ELSE 1 END) OVER w AS t, sum(CASE WHEN dec THEN 1 ELSE 0 END) OVER w AS d FROM ev WINDOW w AS (ORDER BY score DESC, id)) SELECT id, round(d/greatest(t,1),9) AS fdr, CAST(NOT dec AND d/greatest(t,1) <= CAST(0.2 AS DOUBLE) AS INT) AS is_correct FROM r",
    "calibration_table": "SELECT coalesce(lang,'all') AS lang, coalesce(length_bin,-1) AS length_bin, count(*) AS n, CAST(sum(quality) AS BIGINT) AS correct, round(sum(quality)/count(*),6) AS precision FROM (SELECT coalesce(lang,'?') AS lang, CAST(least(n_chars // 1000, 9) AS BIGINT) AS length_bin, quality FROM labels JOIN documents USING (doc_id)) GROUP BY CUBE (lang, length_bin)",
    "gc_threshold": f"WITH {SEQ}, b AS (SELECT CAST(least(floor((length(seq)-length(translate(seq,'GC','')))/length(seq)*100),99) AS BIGINT) AS bin FROM seqs), r AS (SELECT bin, row_number() OVER (ORDER BY bin) AS rn, count(*) OVER () AS n FROM b) SELECT bin/CAST(100 AS DOUBLE) AS threshold, n FROM r WHERE rn = greatest(CAST(floor(n*CAST(0.7 AS DOUBLE)) AS BIGINT),1)",
    "codon_panel": f"""WITH {SEQ}, c AS (SELECT doc_id, length(seq) AS n, CAST(i AS INT) AS i, seq[3*i+1:3*i+3] AS codon FROM seqs, range(0,6) r(i)), g AS (SELECT cd, aa FROM (VALUES {', '.join(f"('{c}','{a}')" for c, a in S.CODONS.items())}) v(cd, aa)), y AS (SELECT aa, string_agg(cd, ',' ORDER BY cd) AS syn FROM g GROUP BY aa),
 d AS (SELECT *, CASE WHEN strpos(codon,'C') > 0 THEN codon[:strpos(codon,'C')-1] || 'T' || codon[strpos(codon,'C')+1:] END AS t, CASE WHEN strpos(codon,'G') > 0 THEN codon[:strpos(codon,'G')-1] || 'A' || codon[strpos(codon,'G')+1:] END AS a FROM c)
 SELECT doc_id, i, codon, CAST(codon IN ('TAA','TAG','TGA') AS INT) AS is_stop, CAST(codon IN ('ATG','GTG','TTG') AS INT) AS is_start, CAST((strpos('TCAG',codon[1])-1)*16+(strpos('TCAG',codon[2])-1)*4+strpos('TCAG',codon[3])-1 AS INT) AS number, codon AS again, syn AS synonyms, gt.aa AS ct, ga.aa AS ga,
 CASE WHEN codon IN ('TAA','TAG') THEN 'Q' WHEN codon = 'TGA' THEN CASE WHEN n-3-3*i < 3*i AND n-3-3*i < 20 THEN 'W' ELSE 'R' END ELSE 'X' END AS origin FROM d JOIN g ON g.cd = codon JOIN y ON y.aa = g.aa LEFT JOIN g gt ON gt.cd = t LEFT JOIN g ga ON ga.cd = a""",
    "frame_posteriors": f"WITH {_FRAMES}, s AS (SELECT doc_id, -CAST(20 AS DOUBLE)*(length(protein)-length(replace(protein,'*','')))/greatest(length(protein),1) AS sc FROM pr), e AS (SELECT doc_id, exp((sc-max(sc) OVER (PARTITION BY doc_id))/2) AS e FROM s), p AS (SELECT doc_id, e/sum(e) OVER (PARTITION BY doc_id) AS p FROM e) SELECT doc_id, round(max(p),6) AS best, round(-sum(CASE WHEN p > 0 THEN p*log2(p) ELSE 0 END),6) AS entropy FROM p GROUP BY doc_id",
    "base_composition": f"WITH {SEQ} SELECT doc_id, {', '.join(f"length(seq)-length(replace(seq,'{b}','')) AS {b.lower()}" for b in 'ACGT')}, CAST(0 AS BIGINT) AS other FROM seqs",
    "decay_slope": f"WITH {SEQ}, c AS (SELECT lang, p, sum(CASE WHEN seq[p+1]='T' THEN 1 ELSE 0 END) AS t, sum(CASE WHEN seq[p+1]='C' THEN 1 ELSE 0 END) AS c FROM seqs JOIN documents USING (doc_id), range(0,6) r(p) GROUP BY lang, p) SELECT lang, round(regr_slope(t/(t+c), p),9) AS slope FROM c WHERE t+c > 0 GROUP BY lang",
    "markov_counts": f"WITH {SEQ}, x AS (SELECT seq, CAST(least((length(seq)-length(translate(seq,'GC','')))*5//length(seq),4) AS INT) AS gc_bin FROM seqs), t AS (SELECT gc_bin, CAST(i % 3 AS INT) AS phase, seq[i-1:i+1] AS k, count(*) AS n FROM (SELECT seq, gc_bin, unnest(range(2, length(seq))) AS i FROM x) GROUP BY ALL) SELECT gc_bin, phase, CAST(list_reduce(list_transform(string_split(translate(k,'ACGT','0123'),''), lambda x: CAST(x AS BIGINT)), lambda a, x: a*4+x) AS INT) AS triple, n FROM t",
    "targets_by_reads": f"WITH {ALN} SELECT ref_id, n_reads, row_number() OVER (ORDER BY n_reads DESC, ref_id) AS rank FROM (SELECT ref_id, count(*) AS n_reads FROM aln GROUP BY ref_id)",
    "moments": f"WITH {ALN}, s AS (SELECT aln_len, count(*) AS n, avg(bits) AS mean, sqrt(greatest(avg(bits*bits)-avg(bits)*avg(bits),0)) AS sd FROM aln GROUP BY aln_len) SELECT aln_len, n, round(mean,6) AS mean, round(CASE WHEN sd < 1e-4 THEN 1 ELSE sd END,5) AS sd FROM s",
    "damage_profile_wide": f"WITH {SEQ} SELECT lang, {', '.join(f"round(avg(CASE WHEN seq[{i + 1}] = 'T' THEN 1 WHEN seq[{i + 1}] = 'C' THEN 0 END),6) AS tc_{i}" for i in range(10))}, {', '.join(f"round(avg(CASE WHEN seq[length(seq)-{i}] = 'A' THEN 1 WHEN seq[length(seq)-{i}] = 'G' THEN 0 END),6) AS ag_{i}" for i in range(10))} FROM seqs JOIN documents USING (doc_id) GROUP BY lang",
    "median_length": f"WITH {ALN}, r AS (SELECT aln_len, row_number() OVER (ORDER BY aln_len) - 1 AS rn, count(*) OVER () AS n FROM aln) SELECT aln_len AS median, n FROM r WHERE rn = n // 2",
    "frame_scores": f"""WITH {_FRAMES}, u AS (SELECT c, count(*) AS k FROM (SELECT unnest(regexp_extract_all(seq,'...')) AS c FROM seqs) GROUP BY c), t AS (SELECT c, ln((k+0.5)/((SELECT sum(k) FROM u)+32)*64) AS w FROM u),
 x AS (SELECT doc_id, strand, frame, unnest(cs) AS c FROM fr), s AS (SELECT doc_id, strand, CAST(frame AS INT) AS frame, count(*) AS n_codons, CAST(sum(CASE WHEN x.c IN ('TAA','TAG','TGA') THEN 1 ELSE 0 END) AS BIGINT) AS stops, sum(CASE WHEN x.c IN ('TAA','TAG','TGA') THEN 0 ELSE coalesce(w, ln(0.5/((SELECT sum(k) FROM u)+32)*64)) END) AS w FROM x LEFT JOIN t ON t.c = x.c GROUP BY ALL),
 f AS (SELECT *, w/n_codons + ln(n_codons+1) - CAST(3 AS DOUBLE)*stops/n_codons AS score FROM s) SELECT doc_id, strand, frame, n_codons, stops, round(score,6) AS score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(score,9) DESC, strand, frame) AS INT) AS rank FROM f""",
}
QUERIES = {name: globals()[name] for name in ORACLE}
