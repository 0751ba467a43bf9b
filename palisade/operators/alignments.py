"""Filters, best hits and assignments over an alignment table (read_id, ref_id, bits, fident, aln_len, tstart, tlen, ...).

Every arg-max has a total order: bits descending, then ref_id and the given tie columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TIES = ("ref_id", "sk", "ln", "aln_len", "p_read")


def filters(min_identity: float = 0.0, min_bits: float = 0.0, min_len: int = 0) -> list[tuple[str, Column]]:
    """Named predicates in the order in which a row is charged to the first that it fails; report.rules has those of hits
    with an e-value."""
    return [("identity", F.col("fident") >= min_identity), ("bits", F.col("bits") >= min_bits), ("length", F.col("aln_len") >= min_len)]


def keep(aln: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    for _, rule in rules:
        aln = aln.where(rule)
    return aln


def first_failing(aln: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(reason, n): rows charged to their first failed predicate; `passed` for the rest."""
    reason = F.lit("passed")
    for name, rule in reversed(rules):
        reason = F.when(~rule, name).otherwise(reason)
    return aln.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def best_hits(aln: DataFrame) -> DataFrame:
    """One row a read: its best alignment, the runner-up's bits (0 if none), their difference and the read's degree.

    One aggregation; what it collects of a read are the bits of its own alignments."""
    first = F.struct((-F.col("bits")).alias("b"), *TIES)
    cols = [c for c in aln.columns if c != "read_id"]
    two = F.slice(F.sort_array(F.collect_list("bits"), asc=False), 1, 2)
    got = aln.groupBy("read_id").agg(F.min_by(F.struct(*cols), first).alias("x"), two.alias("two"), F.count("*").alias("degree"))
    second = F.coalesce(F.get("two", F.lit(1)), F.lit(0.0))
    delta = F.when(F.col("degree") > 1, F.col("x.bits") - second).otherwise(0.0)
    return got.select(*["read_id" if c == "read_id" else f"x.{c}" for c in aln.columns], second.alias("bits_second"), "degree", delta.alias("delta_bits"))


def unique_mappers(aln: DataFrame) -> DataFrame:
    """Alignments of reads with a single alignment: a count and the only row, by partial aggregation without a window."""
    cols = [c for c in aln.columns if c != "read_id"]
    one = aln.groupBy("read_id").agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in cols]).where("n = 1")
    return one.select(*aln.columns)


def lower_rank_quantile(df: DataFrame, value: str, q: float, by: list[str]) -> DataFrame:
    """Lower nearest rank of a group: element floor(q * (n - 1)) in ascending order, from the counts of distinct values."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"))
    w = W.partitionBy(*by)
    c = c.withColumn("upto", F.sum("k").over(w.orderBy(value))).withColumn("n", F.sum("k").over(w))
    at = F.floor(F.lit(q) * (F.col("n") - 1))
    return c.where((F.col("upto") > at) & (F.col("upto") - F.col("k") <= at)).select(*by, F.col(value).alias("quantile"))


def dictionary(values: DataFrame, column: str) -> DataFrame:
    """Dense ids of distinct strings: ranges are numbered apart and offset, so no task sees all strings."""
    distinct = values.select(column).distinct().where(F.col(column).isNotNull())
    n = max(2, values.sparkSession.sparkContext.defaultParallelism)
    from palisade.session import cut

    parts = cut(distinct.repartitionByRange(n, column).withColumn("pid", F.spark_partition_id()), "dictionary")
    local = parts.withColumn("k", F.row_number().over(W.partitionBy("pid").orderBy(column)))
    sizes = sorted((r["pid"], r["count"]) for r in parts.groupBy("pid").count().collect())  # one row a partition
    base, rows = 0, []
    for pid, k in sizes:
        rows.append((pid, base))
        base += k
    offsets = values.sparkSession.createDataFrame(rows, "pid int, base long")
    return local.join(offsets, "pid").select(column, (F.col("base") + F.col("k") - 1).alias("id"))


def last_mapping(mapping: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key -> value where a repeated key's last row, by order, wins."""
    return mapping.groupBy(key).agg(F.max_by(value, order).alias(value))
