"""Target-decoy error rates and classifier metrics over score lists; orders are total (score descending, then id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.ranges import Ranges


def score_counts(scores: DataFrame) -> DataFrame:
    """(score, t, d) by distinct score: what running counts need, however many rows share a score."""
    return scores.groupBy("score").agg(F.sum((~F.col("is_decoy")).cast("long")).alias("t"), F.sum(F.col("is_decoy").cast("long")).alias("d"))


def q_values(scores: DataFrame) -> DataFrame:
    """Targets (id, score) with q: the least of decoys / all over every threshold that takes the score in."""
    r = Ranges(score_counts(scores), "score", descending=True).sums(ct="t", cd="d")
    r.rows = r.rows.withColumn("fdr", F.col("cd") / (F.col("ct") + F.col("cd")))
    q = r.least_from_here("q", "fdr").result()
    return scores.where(~F.col("is_decoy")).join(q.select("score", "q"), "score").select("id", "score", "q")


def threshold_for_fdr(scores: DataFrame, target: float, step: float = 0.01) -> DataFrame:
    """One row: the lowest threshold of a descending grid at which decoys / all is within the target (violations above don't
    end the scan). Thresholds between two occupied cells share the counts of the upper one, so only occupied cells are kept."""
    n = round(1 / step)
    cell = F.floor(F.col("score") * n)  # a score counts at every threshold up to its cell
    c = scores.groupBy(cell.alias("cell")).agg(F.sum((~F.col("is_decoy")).cast("long")).alias("t"), F.sum(F.col("is_decoy").cast("long")).alias("d")).where("cell >= 0")
    up = Ranges(c, "cell").previous("below", "cell").sums(bt="t", bd="d").result()
    total = c.agg(F.sum("t").alias("at"), F.sum("d").alias("ad"), F.max("cell").alias("last"))
    g = up.crossJoin(F.broadcast(total))  # one row
    t, d = F.col("at") - F.col("bt") + F.col("t"), F.col("ad") - F.col("bd") + F.col("d")
    g = g.select(F.coalesce(F.col("below") + 1, F.lit(0)).alias("cell"), F.when(t + d > 0, d / (t + d)).otherwise(0.0).alias("fdr"))
    top = scores.agg(F.ceil(F.max("score") * n).alias("top")).crossJoin(total).where("top > last").select((F.col("last") + 1).alias("cell"), F.lit(0.0).alias("fdr"))  # one row
    both = g.unionByName(top).where(F.col("fdr") <= target)
    return both.agg(F.min("cell").alias("cell"), F.min_by("fdr", "cell").alias("fdr")).select((F.col("cell") / n).alias("threshold"), "fdr")


def labels(scores: DataFrame, most: float = 0.01) -> DataFrame:
    """Scores (id, score, is_decoy) with fdr, decoys over targets down to the row (score descending, then id), and is_correct:
    a target within the limit."""
    order = F.struct((-F.col("score")).alias("s"), "id")
    rows = scores.select("id", "score", "is_decoy", order.alias("o"), (~F.col("is_decoy")).cast("long").alias("t"), F.col("is_decoy").cast("long").alias("d"))
    r = Ranges(rows, "o").sums(ct="t", cd="d").result().withColumn("fdr", F.col("cd") / F.greatest("ct", F.lit(1)))
    return r.select("id", "score", "fdr", (~F.col("is_decoy") & (F.col("fdr") <= most)).alias("is_correct"))


def pep(scores: DataFrame) -> DataFrame:
    """Targets with posterior error probabilities: a Gaussian null of the decoys against an exponential alternative."""
    s = scores.agg(F.sum((~F.col("is_decoy")).cast("long")).alias("nt"), F.sum(F.col("is_decoy").cast("long")).alias("nd"),
                   F.avg(F.when(F.col("is_decoy"), F.col("score"))).alias("mu"), F.var_pop(F.when(F.col("is_decoy"), F.col("score"))).alias("v"))
    s = s.withColumn("v", F.col("v") + 1e-6).withColumn("pi0", F.least(F.greatest(F.col("nd") / F.greatest("nt", F.lit(1)), F.lit(0.01)), F.lit(0.99)))
    null = F.exp(-F.pow(F.col("score") - F.col("mu"), 2) / (2 * F.col("v"))) / F.sqrt(2 * F.lit(3.141592653589793) * F.col("v"))
    alt = 2 * F.exp(2 * (F.col("score") - 1))
    p0, p1 = F.col("pi0") * null, (1 - F.col("pi0")) * alt
    return scores.where(~F.col("is_decoy")).crossJoin(F.broadcast(s)).select("id", "score", (p0 / (p0 + p1)).alias("pep"))  # one row


def auc(scores: DataFrame) -> DataFrame:
    """One row: area under the ROC of (score, label 0/1), by ranks with ties at half, over distinct scores."""
    c = scores.groupBy("score").agg(F.sum((F.col("label") == 1).cast("long")).alias("p"), F.sum((F.col("label") == 0).cast("long")).alias("n"))
    c = Ranges(c, "score").sums(upto="n").result()
    return c.agg((F.sum(F.col("p") * (F.col("upto") - F.col("n") / 2.0)) / (F.sum("p") * F.sum("n"))).alias("auc"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))


def auc_by_rows(scores: DataFrame) -> DataFrame:
    """One row: area under the ROC stepped row by row, score descending and then id; ties aren't merged, so it depends on ids."""
    order = F.struct((-F.col("score")).alias("s"), "id")
    rows = Ranges(scores.select(order.alias("o"), (F.col("label") == 1).cast("long").alias("p"), (F.col("label") == 0).cast("long").alias("n")), "o").sums(tp="p").result()
    return rows.agg((F.sum(F.col("n") * F.col("tp")) / (F.sum("p") * F.sum("n"))).alias("auc"))


def fdr_by_stratum(scores: DataFrame, stratum: str, thresholds: list[float]) -> DataFrame:
    """(stratum, threshold, targets, decoys, fdr) of scores with a stratum column, in one aggregation."""
    per = scores.groupBy(stratum).agg(*[F.sum(((F.col("score") >= t) & (F.col("is_decoy") == d)).cast("long")).alias(f"{'d' if d else 't'}{i}") for i, t in enumerate(thresholds) for d in (False, True)])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("targets"), F.col(f"d{i}").alias("decoys")) for i, t in enumerate(thresholds)]))
    r = per.select(stratum, rows.alias("r")).select(stratum, "r.*")
    return r.withColumn("fdr", F.when(F.col("targets") + F.col("decoys") > 0, F.col("decoys") / (F.col("targets") + F.col("decoys"))).otherwise(0.0))


def confusion(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and F1 at each threshold, in one aggregation."""
    hit = lambda label, over: F.sum(((F.col("label") == label) & over).cast("long"))
    aggs: list[Column] = []
    for i, t in enumerate(thresholds):
        over = F.col("score") >= t
        aggs += [hit(1, over).alias(f"tp{i}"), hit(0, over).alias(f"fp{i}"), hit(1, ~over).alias(f"fn{i}"), hit(0, ~over).alias(f"tn{i}")]
    one = scores.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), *[F.col(f"{x}{i}").alias(x) for x in ("tp", "fp", "fn", "tn")]) for i, t in enumerate(thresholds)]))
    c = one.select(rows.alias("r")).select("r.*")
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return c.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0))
