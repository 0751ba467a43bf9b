"""From filtered hits to per-read, per-reference and per-group tables.

Hits are (row_id, query_id, ref_id, bits, fident, aln_len, tstart from 1, tlen, qaln, taln, qstart, qlen, log10_evalue).
Each table is one or two partial aggregations by reference; nothing is gathered by reference but starts and boundaries.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.functions.sequence import identity, strip_frame_suffix
from palisade.functions.stats import beta_at, beta_below, protein_damage, wilson
from palisade.operators import annotate as N
from palisade.operators import coverage as C
from palisade.operators import em as E
from palisade.operators.ranges import lower_rank
from palisade.session import cut, drop_cut


@dataclass(frozen=True)
class Settings:
    """Options of the chain; the bundles only change the thresholds named, and later changes win."""

    min_identity: float = 0.0
    min_bits: float = 0.0
    max_log10_evalue: float = float("inf")
    min_reads: int = 1
    min_breadth: float = 0.0
    min_depth: float = 0.0
    min_positional: float = 0.0
    min_terminal: float = 0.0
    em_min_prob: float = 0.0
    damaged_from: float = 0.7
    d_max: float = 0.3
    rate: float = 0.3
    prior: float = 0.1
    scale: float = 1.0
    #: Sites of an alignment from which they count as evidence; None: a tenth of the median read length.
    min_damage_sites: int | None = None
    #: Whether damage is expected at both ends (double strands); None: by the sites found there.
    both_ends: bool | None = True
    #: Raise the positional and terminal thresholds to what 95 % of well-covered references reach.
    calibrate: bool = False
    #: EM steps; None: until it settles.
    iterations: int | None = None

    def loose(self) -> Settings:
        return replace(self, min_reads=1, min_breadth=0.0, min_depth=0.0, min_damage_sites=1)

    def strict(self) -> Settings:
        return replace(self, min_reads=5, min_breadth=0.2, min_depth=1.0, calibrate=True, min_damage_sites=5)


# Fixed values of the calibration: reads and starts of a reference that counts, references it takes, least terminal threshold.
CALIBRATE_READS, CALIBRATE_STARTS, CALIBRATE_REFS, CALIBRATE_TERMINAL = 10, 3, 100, 0.20


def resolved(s: Settings, hits: DataFrame, index_sample: dict | None = None, hits_sample: dict | None = None, given: tuple[str, ...] = ()) -> Settings:
    """s with d_max and rate from the first that has a level: what the user gave (names in given), the damage index's sample,
    that of the hits' file, or an estimate from the best hits' alignments. The rate comes with the level unless given."""
    if "d_max" in given:
        return s
    for sample in (index_sample, hits_sample):
        if sample and (sample.get("d_max") or 0) > 0:
            rate = sample.get("rate") or 0
            return replace(s, d_max=float(sample["d_max"]), rate=float(rate) if rate > 0 and "rate" not in given else s.rate)
    best = F.struct((-F.col("bits")).alias("b"), "ref_id", "row_id")
    cols = ["qaln", "taln", "qstart", "tstart", "qlen", "fident", "aln_len"]
    one = hits.groupBy("query_id").agg(F.min_by(F.struct("row_id", "ref_id", "bits", *cols), best).alias("x")).select("query_id", "x.*")
    found = N.estimate_d_max(N.annotate(one.withColumn("reverse", F.col("query_id").rlike("_-_[0-9]+$")), s.d_max, s.rate)).first()
    return replace(s, d_max=float(found["d_max"] or 0.0))


def median_sites(hits: DataFrame) -> int:
    """A tenth of the median read length (the upper of two), at least 1; 3 without reads."""
    row = lower_rank(hits.groupBy("query_id").agg(F.max("qlen").alias("qlen")), "qlen", "n div 2").first()
    return max(1, row["qlen"] // 10) if row else 3


def calibrated(gene_rows: DataFrame, s: Settings) -> Settings:
    """s with its positional and terminal thresholds raised to the element n div 20 of each among references with enough reads
    and starts (the terminal one at least CALIBRATE_TERMINAL); unchanged under CALIBRATE_REFS of them. gene_rows: a written table."""
    use = gene_rows.where((F.col("n_reads") >= CALIBRATE_READS) & (F.col("n_unique_starts") >= CALIBRATE_STARTS))
    if not s.calibrate or use.count() < CALIBRATE_REFS:
        return s
    at = {c: float(lower_rank(use, c, "n div 20").first()[c]) for c in ("positional_score", "terminal_middle_ratio")}
    return replace(s, min_positional=max(s.min_positional, at["positional_score"]), min_terminal=max(s.min_terminal, CALIBRATE_TERMINAL, at["terminal_middle_ratio"]))


def rules(s: Settings) -> list[tuple[str, Column]]:
    """Predicates on hits in the order in which a row is charged to the first that it fails."""
    return [("identity", F.col("fident") >= s.min_identity), ("bits", F.col("bits") >= s.min_bits), ("evalue", F.col("log10_evalue") <= s.max_log10_evalue)]


def read_damage(hits: DataFrame, index: DataFrame) -> DataFrame:
    """hits with p_read, the damage probability of the read that an index (query_id, p_damaged) records; 0 without one.

    Names are compared without their strand and frame; of several records of a read the first by name counts.
    """
    one = index.groupBy(strip_frame_suffix("query_id").alias("read_name")).agg(F.min_by("p_damaged", F.struct("query_id", "p_damaged")).alias("p_index"))
    named = hits.withColumn("read_name", strip_frame_suffix("query_id"))
    return named.join(one, "read_name", "left").withColumn("p_read", F.coalesce("p_index", F.lit(0.0))).drop("p_index", "read_name")


def scored(hits: DataFrame, index: DataFrame, s: Settings) -> DataFrame:
    """Hits that pass the filters, annotated, with gamma and gamma_ancient of the EM, and their
    own posterior and class. Written once; every table starts from it."""
    for _, rule in rules(s):
        hits = hits.where(rule)
    rows = read_damage(hits, index).withColumn("reverse", F.col("query_id").rlike("_-_[0-9]+$"))
    rows = cut(N.annotate(rows, s.d_max, s.rate).drop("qaln", "taln").withColumnRenamed("query_id", "read_id"), "chain-hits")
    weights = E.plain_em(rows, s.iterations, s.scale, damage=True) if s.iterations else E.squarem(rows, s.scale, damage=True, max_iter=200, strict=True)[0]
    done = cut(N.bayesian(E.e_step_damage(rows, weights, s.scale), s.d_max, s.prior), "chain-scored")
    drop_cut(rows)
    return done


LENGTH_BINS = (25, 40, 60)


def length_bin(length: Column) -> Column:
    a, b, c = LENGTH_BINS
    return F.when(length < a, 0).when(length < b, 1).when(length < c, 2).otherwise(3)


def with_bit_z(rows: DataFrame) -> DataFrame:
    """rows (bits, aln_len) with bpa, length_bin and z_bpa, against the mean and population spread of the bin (10 rows at least)."""
    b = rows.withColumn("bpa", F.col("bits") / F.col("aln_len")).withColumn("length_bin", length_bin(F.col("aln_len")))
    s = b.groupBy("length_bin").agg(F.count("*").alias("bin_n"), F.avg("bpa").alias("bin_mean"), F.stddev_pop("bpa").alias("bin_sd"))
    z = F.when((F.col("bin_n") >= 10) & (F.col("bin_sd") > 0), (F.col("bpa") - F.col("bin_mean")) / F.col("bin_sd")).otherwise(0.0)
    return b.join(F.broadcast(s), "length_bin").withColumn("z_bpa", z).drop("bin_n", "bin_mean", "bin_sd")  # four rows


def reads(rows: DataFrame, s: Settings) -> DataFrame:
    """A row a read: its best hit by bits (then reference, then row), with the margins of bits and gamma over its hits.

    One aggregation; what it collects of a read are the bits and gammas of its own hits."""
    best = F.struct((-F.col("bits")).alias("b"), "ref_id", "row_id")
    cols = [c for c in rows.columns if c != "read_id"]
    two = lambda c: F.slice(F.sort_array(F.collect_list(c), asc=False), 1, 2)
    got = rows.groupBy("read_id").agg(F.min_by(F.struct(*cols), best).alias("x"), F.count("*").alias("degree"), F.sum(F.col("gamma") * F.col("gamma")).alias("gg"), two("bits").alias("two_bits"), two("gamma").alias("two_gammas"))
    delta = F.when(F.col("degree") > 1, F.get("two_bits", F.lit(0)) - F.get("two_bits", F.lit(1))).otherwise(0.0)
    margin = F.get("two_gammas", F.lit(0)) - F.coalesce(F.get("two_gammas", F.lit(1)), F.lit(0.0))
    out = got.select("read_id", "x.*", "degree", delta.alias("delta_bits"), margin.alias("em_margin"), (1.0 / F.col("gg")).alias("em_ref_neff"))
    out = with_bit_z(out.withColumn("em_keep", (F.col("gamma") >= s.em_min_prob).cast("int")))
    return out.withColumn("non_damage", F.col("mismatches") - F.col("k")).withColumn("is_damaged", (F.col("posterior") >= s.damaged_from).cast("int"))


def genes(rows: DataFrame) -> DataFrame:
    """A row a reference over all its hits, weighted by gamma: counts by class, intervals, identity, coverage and starts."""
    g = F.col("gamma")
    is_ = lambda c: F.sum(F.when(F.col("damage_call") == c, g).otherwise(0.0))
    base = rows.groupBy("ref_id").agg(
        F.count("*").alias("n_reads"), F.sum("gamma").alias("eff_reads"), F.sum((F.col("k") > 0).cast("long")).alias("n_damage_reads"), F.sum(F.when(F.col("k") > 0, g).otherwise(0.0)).alias("eff_damage_reads"),
        is_("ancient").alias("n_ancient"), is_("modern").alias("n_modern"), is_("uncertain").alias("n_undetermined"), (F.sum(g * F.col("posterior")) / F.sum(g)).alias("mean_posterior"),
        (F.sum(g * F.col("fident")) / F.sum(g)).alias("mean_identity"), (F.sum(g * F.col("aln_len")) / F.sum(g)).alias("avg_aln_len"), (F.sum(g * F.col("aln_len") ** 2) / F.sum(g)).alias("len2"))
    called = F.col("n_ancient") + F.col("n_modern")
    low, high = wilson(F.col("n_ancient"), called)
    base = base.withColumn("ancient_frac", F.when(called > 0, F.col("n_ancient") / called).otherwise(0.0)).withColumn("ci_low", low).withColumn("ci_high", high)
    base = base.withColumn("std_aln_len", F.sqrt(F.greatest(F.col("len2") - F.col("avg_aln_len") ** 2, F.lit(0.0)))).drop("len2")
    a = rows.select("ref_id", (F.col("tstart") - 1).alias("tstart"), "aln_len", "tlen", F.col("gamma").alias("g"))
    fit = C.kl(a)
    out = base.join(C.depth_stats(a).withColumnRenamed("depth_mean", "abundance"), "ref_id", "left").join(C.positional_stats(a).drop("n_reads"), "ref_id").join(C.terminal_ratio(a), "ref_id")
    out = out.join(fit.select("ref_id", F.col("deviance").alias("coverage_deviance")), "ref_id", "left").join(C.coverage_weight(fit), "ref_id", "left").join(C.completeness(C.bins(a), fit).withColumnRenamed("completeness", "completeness_fhat"), "ref_id", "left")
    out = out.fillna({"breadth": 0.0, "abundance": 0.0, "depth_std": 0.0, "depth_evenness": 0.0, "coverage_deviance": 0.0, "coverage_weight": 1.0, "completeness_fhat": 0.0})
    return out.withColumn("abundance_adjusted", F.col("abundance") * F.col("coverage_weight"))


def failures(s: Settings) -> Column:
    """Names of the thresholds that a reference misses, comma-joined; `.` for none."""
    tests = [("n_reads", F.col("n_reads") >= s.min_reads), ("breadth", F.col("breadth") >= s.min_breadth), ("depth", F.col("abundance") >= s.min_depth),
             ("positional", F.col("positional_score") >= s.min_positional), ("terminal", F.col("terminal_middle_ratio") >= s.min_terminal)]
    why = F.concat_ws(",", F.array_compact(F.array(*[F.when(ok, F.lit(None)).otherwise(name) for name, ok in tests])))
    return F.when(why == "", ".").otherwise(why)


def proteins(read_rows: DataFrame, gene_rows: DataFrame, s: Settings) -> DataFrame:
    """A row a reference over the reads whose best hit it is and that have a mismatch, beside its gene's block."""
    r = read_rows.where("mismatches > 0")
    per_bin = F.struct(*[F.sum((F.col("length_bin") == b).cast("long")).alias(f"b{b}") for b in range(4)])
    p = r.groupBy("ref_id").agg(
        F.count("*").alias("p_reads"), F.sum((F.col("k") > 0).cast("long")).alias("p_damage_reads"), F.sum((F.col("p_damaged") > 0.5).cast("long")).alias("n_damaged"), F.sum("k").alias("damage_sites"),
        F.sum("terminal_5").alias("terminal_5"), F.sum("terminal_3").alias("terminal_3"), F.max("p_damaged").alias("max_p_damaged"), F.avg("p_damaged").alias("mean_p_damaged"), F.sum("p_damaged").alias("sum_p"),
        F.sum(F.col("p_damaged") ** 2).alias("sum_p2"), F.avg("delta_bits").alias("avg_delta_bits"), F.avg("bpa").alias("avg_bpa"), per_bin.alias("bins"), F.sum("gamma").alias("p_eff"))
    most = F.greatest(*[F.col(f"bins.b{b}") for b in range(4)])
    p = p.withColumn("length_bin", F.coalesce(*[F.when(F.col(f"bins.b{b}") == most, b) for b in range(4)])).drop("bins")
    share = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n)).otherwise(0.0)
    p = p.withColumn("frac_damaged", share("n_damaged", "p_damage_reads")).withColumn("frac_damaged_all", share("n_damaged", "p_reads"))
    both = s.both_ends if s.both_ends is not None else _both_ends(p)
    ends = F.col("p_eff") * (2 if both else 1) * 3 * 0.25 * 0.70
    seen = F.col("terminal_5") + F.col("terminal_3") if both else F.col("terminal_5")
    p = p.withColumn("d_aa", F.when(ends > 0, F.least(seen / ends, F.lit(1.0))).otherwise(0.0))
    out = p.join(gene_rows, "ref_id")
    return out.withColumn("filter_fail", failures(s)).withColumn("pass_mapping_filter", (F.col("filter_fail") == ".").cast("int"))


def _both_ends(p: DataFrame) -> bool:
    """Sites at the end are over 0.3 of those at the start."""
    t = p.agg(F.sum("terminal_5").alias("five"), F.sum("terminal_3").alias("three")).first()
    return bool(t["five"]) and t["three"] / t["five"] > 0.3


_FIT = {"p_damaged": "p_protein_damaged", "delta_mle": "delta_mle", "ci_lower": "ci_lower", "ci_upper": "ci_upper", "lrt_pvalue": "lrt_pvalue", "log_bf": "log_bf"}
#: Columns of the protein report in order: name in the report, column of proteins() with fits.
PROTEIN_REPORT = [
    ("protein_id", "ref_id"), ("n_reads", "p_reads"), ("eff_reads", "p_eff"), ("n_damage_reads", "p_damage_reads"), *[(c, c) for c in ("n_damaged", "damage_sites", "terminal_5", "terminal_3", "max_p_damaged", "mean_p_damaged", "frac_damaged", "frac_damaged_all", "p_protein_damaged")],
    ("combined_score", "p_protein_damaged"), *[(c, c) for c in ("delta_mle", "ci_lower", "ci_upper", "lrt_pvalue", "log_bf", "d_aa", "avg_delta_bits", "avg_bpa", "length_bin", "n_unique_starts", "start_diversity", "start_span", "positional_score", "terminal_middle_ratio", "avg_aln_len", "std_aln_len")],
    *[(f"assign_{c}", c) for c in ("n_reads", "eff_reads", "n_damage_reads", "eff_damage_reads", "n_ancient", "n_modern", "n_undetermined", "ancient_frac", "ci_low", "ci_high", "mean_posterior", "mean_identity", "breadth", "abundance", "depth_std", "depth_evenness")],
    *[(c, c) for c in ("coverage_deviance", "completeness_fhat", "coverage_weight", "abundance_adjusted", "pass_mapping_filter", "filter_fail")],
]


def with_fits(protein_rows: DataFrame) -> DataFrame:
    """proteins() with the beta-binomial fit of its reads' damage; ci_low and ci_high stay the gene's intervals."""
    p = protein_rows.withColumn("__fit", protein_damage(F.col("p_reads").cast("double"), "sum_p", "sum_p2"))
    return p.withColumns({name: F.col(f"__fit.{c}") for c, name in _FIT.items()}).drop("__fit")


def protein_report(protein_rows: DataFrame, passing: bool = False) -> DataFrame:
    """The protein report, all 52 columns; only those that pass the mapping filter if passing."""
    p = with_fits(protein_rows)
    return (p.where("pass_mapping_filter = 1") if passing else p).select(*[F.col(c).alias(name) for name, c in PROTEIN_REPORT])


COMBINED_REPORT = ["target_id", "group_id", "annotation_source", "gene_present", "protein_present", "n_reads", "eff_reads", "abundance", "breadth", "mean_identity", "mean_posterior", "protein_n_damage_reads", "protein_mean_p_damaged", "protein_p_protein_damaged", "protein_d_aa",
                   "positional_score", "terminal_middle_ratio", "pass_mapping_filter", "filter_fail"]
FUNCTION_REPORT = ["db", "function_id", "level", "n_genes", "n_reads", "n_ancient", "n_modern", "n_undetermined", "ancient_frac", "ci_low", "ci_high", "mean_posterior", "n_damaged_genes", "damaged_gene_frac", "damage_enrichment", "coverage_mean", "coverage_stdev", "avg_identity", "stdev_identity",
                   "avg_read_length", "stdev_read_length"]


def combined_report(gene_rows: DataFrame, protein_rows: DataFrame, groups: DataFrame, s: Settings, source: str = "annotation") -> DataFrame:
    """combined() with all 19 columns; source names the annotation."""
    p = with_fits(protein_rows).select("ref_id", F.col("p_protein_damaged").alias("protein_p_protein_damaged"))
    c = combined(gene_rows, protein_rows, groups, s).join(p, "ref_id", "left").fillna({"protein_p_protein_damaged": 0.0})
    return c.withColumn("annotation_source", F.lit(source)).withColumnRenamed("ref_id", "target_id").select(*COMBINED_REPORT)


def function_report(gene_rows: DataFrame, groups: DataFrame, db: str = "MAP") -> DataFrame:
    """functions() with all 21 columns; db names the mapping."""
    f = functions(gene_rows, groups).withColumnRenamed("group_id", "function_id")
    return f.withColumns({"db": F.lit(db), "level": F.lit("group")}).select(*FUNCTION_REPORT)


def run(hits: DataFrame, index: DataFrame, groups: DataFrame, s: Settings, index_sample: dict | None = None, hits_sample: dict | None = None, given: tuple[str, ...] = ("d_max",)) -> tuple[dict[str, DataFrame], Settings]:
    """All tables of a run from one pass of filters, annotation and EM, and the settings that the data have completed: level,
    sites, calibrated thresholds. Genes, reads and proteins are written once and shared by the reports."""
    s = resolved(s, hits, index_sample, hits_sample, given)
    if s.min_damage_sites is None:
        s = replace(s, min_damage_sites=median_sites(hits))
    rows = scored(hits, index, s)
    gene_rows = cut(genes(rows), "chain-genes")
    s = calibrated(gene_rows, s)
    read_rows = cut(reads(rows, s), "chain-reads")
    protein_rows = cut(proteins(read_rows, gene_rows, s), "chain-proteins")
    drop_cut(rows)
    return {
        "reads": read_rows.where("mismatches > 0"), "genes": gene_rows, "proteins": protein_report(protein_rows), "proteins_filtered": protein_report(protein_rows, True),
        "combined": combined_report(gene_rows, protein_rows, groups, s), "functions": function_report(gene_rows, groups), "abundance": abundance(gene_rows, protein_rows, groups),
    }, s


def combined(gene_rows: DataFrame, protein_rows: DataFrame, groups: DataFrame, s: Settings) -> DataFrame:
    """A row a reference that either side knows, with its group (`.` for none) and merged failures; groups: (ref_id, group_id)."""
    g = gene_rows.select("ref_id", "n_reads", "eff_reads", "abundance", "breadth", "mean_identity", "mean_posterior", "positional_score", "terminal_middle_ratio", failures(s).alias("gene_fail"))
    p = protein_rows.select("ref_id", F.col("p_damage_reads").alias("protein_n_damage_reads"), F.col("mean_p_damaged").alias("protein_mean_p_damaged"), F.col("d_aa").alias("protein_d_aa"))
    j = g.withColumn("g", F.lit(1)).join(p.withColumn("p", F.lit(1)), "ref_id", "full").join(groups, "ref_id", "left")
    fail = F.concat_ws(",", F.array_compact(F.array(F.when(F.col("g").isNull(), "no_gene"), F.when(F.col("p").isNull(), "no_protein"), F.when(F.col("gene_fail") != ".", F.col("gene_fail")))))
    zero = [c for c in j.columns if c not in ("ref_id", "group_id", "g", "p", "gene_fail")]
    out = j.withColumn("filter_fail", F.when(fail == "", ".").otherwise(fail)).withColumn("gene_present", F.coalesce("g", F.lit(0))).withColumn("protein_present", F.coalesce("p", F.lit(0)))
    out = out.withColumn("pass_mapping_filter", (F.col("filter_fail") == ".").cast("int")).withColumn("group_id", F.coalesce("group_id", F.lit("."))).drop("g", "p", "gene_fail")
    return out.fillna(0, subset=zero)


def functions(gene_rows: DataFrame, groups: DataFrame) -> DataFrame:
    """A row a group of references: sums by class, intervals, the enrichment of its damaged share over all groups', spreads."""
    g = gene_rows.join(groups, "ref_id").withColumn("reads", F.round("eff_reads").cast("long"))
    spread = lambda x: F.sqrt(F.greatest(F.avg(F.col(x) ** 2) - F.avg(x) ** 2, F.lit(0.0)))
    f = g.groupBy("group_id").agg(
        F.count("*").alias("n_genes"), F.sum("reads").alias("n_reads"), F.sum("n_ancient").alias("n_ancient"), F.sum("n_modern").alias("n_modern"), F.sum("n_undetermined").alias("n_undetermined"),
        F.sum(F.col("mean_posterior") * F.col("reads")).alias("mp"), F.sum((F.col("n_ancient") > F.col("n_modern")).cast("long")).alias("n_damaged_genes"),
        F.avg("abundance").alias("coverage_mean"), spread("abundance").alias("coverage_stdev"), F.avg("mean_identity").alias("avg_identity"), spread("mean_identity").alias("stdev_identity"),
        F.avg("avg_aln_len").alias("avg_read_length"), spread("avg_aln_len").alias("stdev_read_length"))
    called = F.col("n_ancient") + F.col("n_modern")
    low, high = wilson(F.col("n_ancient"), called)
    f = f.withColumn("ancient_frac", F.when(called > 0, F.col("n_ancient") / called).otherwise(0.0)).withColumn("ci_low", low).withColumn("ci_high", high)
    f = f.withColumn("mean_posterior", F.when(F.col("n_reads") > 0, F.col("mp") / F.col("n_reads")).otherwise(0.0)).withColumn("damaged_gene_frac", F.col("n_damaged_genes") / F.col("n_genes"))
    total = f.agg((F.sum("n_ancient") / F.sum(called)).alias("whole"))
    return f.crossJoin(F.broadcast(total)).withColumn("damage_enrichment", F.when(F.col("whole") > 0, F.col("ancient_frac") / F.col("whole")).otherwise(0.0)).drop("mp", "whole")  # one row


def abundance(gene_rows: DataFrame, protein_rows: DataFrame, groups: DataFrame) -> DataFrame:
    """References with a group that pass the mapping filter: coverage, and whether damage was detected."""
    p = protein_rows.where("pass_mapping_filter = 1").select("ref_id", F.when(F.col("n_damaged") > 0, "detected").otherwise("not_detected").alias("detection"))
    return gene_rows.join(groups, "ref_id").join(p, "ref_id").select("ref_id", "group_id", "abundance", "abundance_adjusted", "detection")


def validated(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """truth (read_id, strand, frame) with hit, strand_ok, frame_ok and best: whether any prediction (read_id, strand, frame,
    score) of the read exists, has its strand, and its frame too, and the read's best score (null without one)."""
    mine = predictions.groupBy("read_id").agg(F.max("score").alias("best"), F.collect_set(F.struct("strand", "frame")).alias("calls"))  # six calls a read at most
    j = truth.join(mine, "read_id", "left")
    calls = F.coalesce("calls", F.array().cast("array<struct<strand:string,frame:int>>"))
    return j.select(*truth.columns, F.col("calls").isNotNull().alias("hit"), F.exists(calls, lambda c: c["strand"] == F.col("strand")).alias("strand_ok"),
                    F.exists(calls, lambda c: (c["strand"] == F.col("strand")) & (c["frame"] == F.col("frame"))).alias("frame_ok"), "best")


def unexpected(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predicted reads that the truth doesn't know."""
    return predictions.join(truth, "read_id", "left_anti").select("read_id").distinct()


VALIDATION = ["read_id", "length", "pred_strand", "pred_frame", "true_strand", "true_frame", "score", "damage_pct", "damage_signal", "strand_correct", "frame_correct", "both_correct", "identity"]


def validation_rows(truth: DataFrame, predictions: DataFrame, proteins: DataFrame) -> DataFrame:
    """The validation table, a row a read of truth (read_id, strand, frame, sequence, length) that has a prediction (read_id,
    strand, frame, score, damage_pct, damage_signal): its best prediction (by score, then strand, frame and damage), the greatest damage
    signal of all, whether any has the right strand, and frame there, and the best identity of its proteins (read_id, strand,
    sequence) of the right strand with the truth (null without one). A read's predictions are six at most."""
    best = F.min_by(F.struct("strand", "frame", "score", "damage_pct"), F.struct((-F.col("score")).alias("s"), "strand", "frame", "damage_pct")).alias("x")
    mine = predictions.groupBy("read_id").agg(best, F.max("damage_signal").alias("damage_signal"), F.collect_set(F.struct("strand", "frame")).alias("calls"))
    same = proteins.join(truth.select("read_id", "strand", F.col("sequence").alias("own")), ["read_id", "strand"])
    alike = same.groupBy("read_id").agg(F.max(identity("sequence", "own")).alias("identity"))
    j = truth.select("read_id", "strand", "frame", "length").join(mine, "read_id").join(alike, "read_id", "left")
    right = F.exists("calls", lambda c: c["strand"] == F.col("strand"))
    framed = F.exists("calls", lambda c: (c["strand"] == F.col("strand")) & (c["frame"] == F.col("frame")))
    return j.select(
        "read_id", "length", F.col("x.strand").alias("pred_strand"), F.col("x.frame").alias("pred_frame"), F.col("strand").alias("true_strand"), F.col("frame").alias("true_frame"), "x.score", "x.damage_pct", "damage_signal",
        right.cast("int").alias("strand_correct"), framed.cast("int").alias("frame_correct"), (right & framed).cast("int").alias("both_correct"), "identity")


# Weight of the background in reads, its share of damage, how far beyond it counts, and the flags' least reads and breadth.
PRIOR_WEIGHT, BACKGROUND_SHARE, BEYOND, FLAG_READS, FLAG_BREADTH = 10.0, 0.10, 0.05, 3.0, 0.10


def enrichment(gene_rows: DataFrame) -> DataFrame:
    """gene_rows (n_ancient, eff_reads, breadth) with the raw and the shrunken share of damaged reads, its 95 % interval, the
    probability that it lies beyond the background, whether that reaches 0.95, and flags of few reads and low breadth."""
    anc, n = F.col("n_ancient"), F.col("eff_reads")
    g = gene_rows.withColumn("__a", PRIOR_WEIGHT * BACKGROUND_SHARE + anc).withColumn("__b", PRIOR_WEIGHT * (1 - BACKGROUND_SHARE) + F.greatest(n - anc, F.lit(0.0)))
    at = lambda p: beta_at(F.lit(p), F.col("__a"), F.col("__b"))
    g = g.withColumns({
        "theta_raw": F.when(n > 0, anc / n).otherwise(0.0), "theta_post": F.col("__a") / (F.col("__a") + F.col("__b")), "theta_low": at(0.025), "theta_high": at(0.975),
        "p_enriched": 1 - beta_below(F.lit(BACKGROUND_SHARE + BEYOND), F.col("__a"), F.col("__b")), "low_count": (n < FLAG_READS).cast("int"), "low_breadth": (F.col("breadth") < FLAG_BREADTH).cast("int"),
    })
    return g.withColumn("enriched", (F.col("p_enriched") >= 0.95).cast("int")).drop("__a", "__b")


PROFILE_POSITIONS = 25


def target_profile(reads: DataFrame, targets: DataFrame, positions: int = PROFILE_POSITIONS, min_reads: int = 1) -> DataFrame:
    """A row a target of targets (read_id, target): n_reads, then the share of T among T and C at each of the first positions
    of its reads (read_id, seq) and of A among A and G at each of the last, 0.5 without either; targets under min_reads go. One
    partial aggregation by target, whatever a target's reads."""
    at = lambda k, end: F.upper(F.substr("seq", F.lit(k + 1), F.lit(1)) if end else F.substr("seq", F.length("seq") - k, F.lit(1)))
    inside = lambda k, c, end: F.sum(((F.length("seq") > k) & (at(k, end) == c)).cast("long"))
    sums = {f"{c}{k}_{'5' if end else '3'}": inside(k, c, end) for end, pair in ((True, "TC"), (False, "AG")) for k in range(positions) for c in pair}
    n = reads.join(targets, "read_id").groupBy("target").agg(F.count("*").alias("n_reads"), *[v.alias(name) for name, v in sums.items()]).where(F.col("n_reads") >= min_reads)
    share = lambda up, low: F.when(F.col(up) + F.col(low) > 0, F.col(up) / (F.col(up) + F.col(low))).otherwise(0.5)
    return n.select("target", "n_reads", *[share(f"T{k}_5", f"C{k}_5").alias(f"tc_{k}") for k in range(positions)], *[share(f"A{k}_3", f"G{k}_3").alias(f"ag_{k}") for k in range(positions)])
