"""The driver's tables seen as alignments, sequences and score lists, in Spark and as SQL text for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.session import table


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order = read, part = reference, price = bit score, quantity = aligned length."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("read_id"), F.col("l_partkey").alias("ref_id"), (F.col("l_extendedprice") / 1000.0).alias("bits"),
        (0.86 + F.col("l_discount")).alias("fident"), F.col("l_quantity").cast("int").alias("aln_len"),
        ((F.col("l_suppkey") * 7 + F.col("l_linenumber") * 13) % 100).alias("tstart"), (100 + F.col("l_partkey") % 50).alias("tlen"),
        F.col("l_tax").alias("p_read"), F.col("l_suppkey").alias("sk"), F.col("l_linenumber").alias("ln"))


ALN = """aln AS (SELECT l_orderkey AS read_id, l_partkey AS ref_id, l_extendedprice/CAST(1000.0 AS DOUBLE) AS bits,
 CAST(0.86 AS DOUBLE)+l_discount AS fident, CAST(l_quantity AS INT) AS aln_len, (l_suppkey*7 + l_linenumber*13) % 100 AS tstart,
 100 + (l_partkey % 50) AS tlen, l_tax AS p_read, l_suppkey AS sk, l_linenumber AS ln FROM lineitem)"""


def soft_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments with a softer score and toy likelihoods, so that expectation-maximisation is not degenerate."""
    a = alignments(spark, sf_dir)
    return a.withColumn("bits", F.col("bits") / 100.0 * 3.0).withColumn("ll_a", -0.5 * F.col("fident")).withColumn("ll_m", -0.4 * F.col("fident"))


SOFT = ALN + """, soft AS (SELECT read_id, ref_id, bits/CAST(100.0 AS DOUBLE)*3 AS bits, fident, aln_len, tstart, tlen, p_read, sk, ln,
 CAST(-0.5 AS DOUBLE)*fident AS ll_a, CAST(-0.4 AS DOUBLE)*fident AS ll_m FROM aln)"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as nucleotide sequences of 30 bases or more: letters map to A, C, G, T in turn."""
    d = table(spark, sf_dir, "documents")
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return d.select("doc_id", F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC").alias("seq")).where(F.length("seq") >= 30)


SEQ = """seqs AS (SELECT doc_id, seq FROM (SELECT doc_id, translate(regexp_replace(lower(text),'[^a-z]','','g'),
 'abcdefghijklmnopqrstuvwxyz','ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents) WHERE length(seq) >= 30)"""


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as proteins: letters, of which those that aren't residues stand for others."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "BJOUXZ", "ACDEFG").alias("seq")).where(F.length("seq") > 0)


PROT = """prot AS (SELECT doc_id, seq FROM (SELECT doc_id, translate(upper(regexp_replace(text,'[^A-Za-z]','','g')),'BJOUXZ','ACDEFG') AS seq FROM documents) WHERE length(seq) > 0)"""
#: Residues of a fragment, and from one fragment's start to the next.
FRAGMENT, STRIDE = 40, 25


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole proteins as overlapping fragments: read_id (document and number), seq."""
    p = proteins(spark, sf_dir)
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil((F.length("seq") - FRAGMENT) / STRIDE), F.lit(0)).cast("int"))
    at = p.select("doc_id", "seq", F.explode(numbers).alias("i"))
    return at.select((F.col("doc_id") * 1_000_000 + F.col("i")).alias("read_id"), F.substr("seq", F.col("i") * STRIDE + 1, F.lit(FRAGMENT)).alias("seq"))


FRAG = PROT + f""", frag AS (SELECT doc_id * 1000000 + i AS read_id, substr(seq, i * {STRIDE} + 1, {FRAGMENT}) AS seq
 FROM (SELECT doc_id, seq, unnest(range(CAST(greatest(ceil((length(seq) - {FRAGMENT}) / CAST({STRIDE} AS DOUBLE)), 0) AS BIGINT) + 1)) AS i FROM prot))"""
