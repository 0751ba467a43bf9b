"""Readers and writers of the file formats: hit tables, FASTA and FASTQ, GFF3, maps, ground truth, summaries.

Readers are line-based Spark sources, so files split and codecs follow the extension; a gzip file doesn't split, and is one
block. Multi-line records are grouped by the position of their header line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.sequence import frame, strand, strip_frame_suffix, wrap

HITS = T.StructType([T.StructField(n, t) for n, t in (
    ("query", T.StringType()), ("target", T.StringType()), ("fident", T.DoubleType()), ("alnlen", T.IntegerType()), ("mismatch", T.IntegerType()), ("gapopen", T.IntegerType()),
    ("qstart", T.IntegerType()), ("qend", T.IntegerType()), ("tstart", T.IntegerType()), ("tend", T.IntegerType()), ("evalue", T.DoubleType()), ("bits", T.DoubleType()),
    ("qlen", T.IntegerType()), ("tlen", T.IntegerType()), ("qaln", T.StringType()), ("taln", T.StringType()))])


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """16-column hit table, with or without a header row that starts with `query`; numbers that don't parse are null."""
    return parsed(spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in HITS])).csv(path, sep="\t", quote=""))


def parsed(raw: DataFrame) -> DataFrame:
    """Hits from columns of strings."""
    rows = raw.where(~F.coalesce(F.col("query").startswith("query") & F.col("target").startswith("target"), F.lit(False)))
    return rows.select(*[F.col(f.name) if f.dataType == T.StringType() else F.expr(f"try_cast({f.name} AS {f.dataType.simpleString()})").alias(f.name) for f in HITS])


def write_table(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Tab-separated with a header; nulls are written as a point."""
    df.write.csv(path, sep="\t", header=True, nullValue=".", compression=compression, quote="", emptyValue="")


def write_reports(tables: dict[str, DataFrame], folder: str, compression: str | None = None) -> None:
    """Each table of a run (reads, sites, genes, proteins, combined, functions, abundance) as <folder>/<name>.tsv."""
    for name, df in tables.items():
        flat = df.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes if not t.startswith("struct")])
        write_table(flat, f"{folder}/{name}.tsv", compression)


def write_index(records: DataFrame, folder: str, **sample: float | str | bool) -> None:
    """A damage index: records (id, p_damaged, ...) and one row of what is known of the sample (d_max, rate, state and so on)."""
    records.write.parquet(f"{folder}/records")
    spark = records.sparkSession
    spark.createDataFrame([tuple(sample.values())], list(sample)).write.parquet(f"{folder}/sample")


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """Records of a damage index, and its sample's row."""
    return spark.read.parquet(f"{folder}/records"), spark.read.parquet(f"{folder}/sample").first().asDict()


def write_stats(stats: DataFrame, folder: str) -> None:
    """Reference statistics as a table and as JSON lines."""
    write_table(stats, f"{folder}/references.tsv")
    summary_json(stats).write.text(f"{folder}/references.json")


def write_hits_parquet(hits: DataFrame, path: str) -> None:
    """Columnar hits, dealt and sorted by read then score, so that scans of reads prune and joins on reads keep their place."""
    hits.repartition("query").sortWithinPartitions("query", F.desc("bits"), "target").write.parquet(path, compression="zstd")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, off, value): lines, the block of the file that they were read in, their number in it from 0, and an
    order inside the file. Numbers are given block by block, so a file lies in as many tasks as it has blocks."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("value"))
    n = F.row_number().over(W.partitionBy("file", "block").orderBy("id")) - 1
    rows = text.withColumn("n", n.cast("long"))
    return rows.select("file", "block", "n", F.struct("block", "n").alias("off"), "value")


def _carried(rows: DataFrame, aggregate: Column, over) -> DataFrame:
    """(f, b, carried) of what the blocks of a file before each one add up to; a row a block."""
    per = rows.groupBy(F.col("file").alias("f"), F.col("block").alias("b")).agg(aggregate.alias("own"))
    return per.select("f", "b", over(F.col("own")).over(W.partitionBy("f").orderBy("b").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))


def _split_header(header: Column) -> list[Column]:
    name = F.regexp_extract(header, r"^(\S*)", 1)
    rest = F.regexp_extract(header, r"^\S*\s+(.*)$", 1)
    return [name.alias("id"), rest.alias("description")]


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, sequence): multi-line records, grouped by the last header at or before each line; a block's first
    lines belong to the last header of the blocks before. A row is as long as its record."""
    rows = _lines(spark, path).withColumn("head", F.when(F.col("value").startswith(">"), F.col("off")))
    ahead = _carried(rows, F.max("head"), F.max)
    w = W.partitionBy("file", "block").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.last("head", ignorenulls=True).over(w)).join(ahead, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    rows = rows.withColumn("at", F.coalesce("own", "carried")).where(F.col("at").isNotNull())
    got = rows.groupBy("file", "at").agg(F.max(F.when(F.col("head").isNotNull(), F.expr("substring(value, 2)"))).alias("header"), F.sort_array(F.collect_list(F.when(F.col("head").isNull(), F.struct("off", "value")))).alias("parts"))
    seq = F.array_join(F.transform("parts", lambda p: F.trim(p["value"])), "")
    return got.select(*_split_header(F.col("header")), seq.alias("sequence"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, sequence, quality): records of four lines by their number in the file, which goes on over blocks."""
    rows = _lines(spark, path)
    ahead = _carried(rows, F.count("*"), F.sum)
    rows = rows.join(ahead, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).withColumn("k", F.col("n") + F.coalesce("carried", F.lit(0)))
    rows = rows.withColumn("rec", F.floor(F.col("k") / 4)).withColumn("part", F.col("k") % 4)
    pick = lambda i: F.max(F.when(F.col("part") == i, F.col("value")))
    got = rows.groupBy("file", "rec").agg(pick(0).alias("h"), pick(1).alias("sequence"), pick(3).alias("quality")).where("sequence is not null")
    return got.select(*_split_header(F.expr("substring(h, 2)")), "sequence", "quality")


def write_fastq(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Records (id, description, sequence, quality) of four lines each."""
    head = F.concat(F.lit("@"), "id", F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" "), "description")).otherwise(""))
    df.select(F.concat_ws("\n", head, "sequence", F.lit("+"), "quality").alias("value")).write.text(path, compression=compression)


def write_fasta(df: DataFrame, path: str, header: str | Column = "id", sequence: str = "sequence", width: int = 60) -> None:
    h = F.col(header) if isinstance(header, str) else header
    df.select(F.concat(F.lit(">"), h, F.lit("\n"), wrap(sequence, width)).alias("value")).write.text(path)


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF3 rows with their attributes as a map."""
    cols = ["seqid", "source", "type", "start", "stop", "score", "strand", "phase", "attributes"]
    raw = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    parts = F.split("value", "\t")
    rows = raw.select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(cols)])
    return rows.withColumn("start", F.expr("try_cast(start AS int)")).withColumn("stop", F.expr("try_cast(stop AS int)")).withColumn("attributes", F.str_to_map("attributes", F.lit(";"), F.lit("=")))


def write_gff(genes: DataFrame, path: str) -> None:
    """genes: seqid, start, stop, score, strand, phase and attributes (map of strings)."""
    attrs = F.array_join(F.transform(F.array_sort(F.map_keys("attributes")), lambda k: F.concat(k, F.lit("="), F.element_at("attributes", k))), ";")
    line = F.concat_ws("\t", "seqid", F.lit("palisade"), F.lit("CDS"), F.col("start").cast("string"), F.col("stop").cast("string"), F.coalesce(F.col("score").cast("string"), F.lit(".")), "strand", F.col("phase").cast("string"), attrs)
    genes.select(line.alias("value")).write.text(path)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """gene -> group; comments and a header that starts with `gene` are skipped, a repeated gene's last row wins."""
    rows = _lines(spark, path).where(~F.col("value").startswith("#") & ~F.col("value").startswith("gene") & F.col("value").contains("\t"))
    parts = F.split("value", "\t")
    return rows.groupBy(F.get(parts, F.lit(0)).alias("gene")).agg(F.max_by(F.get(parts, F.lit(1)), F.struct("file", "off")).alias("group"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth (read_id, strand, frame, sequence) with columns found by their names or other names in the header;
    those that are missing are null."""
    raw = spark.read.csv(path, sep="\t", header=True)
    by_name = {c.strip().lower(): c for c in raw.columns}
    pick = lambda names: next((F.col(f"`{by_name[n]}`") for n in names if n in by_name), F.lit(None).cast("string"))
    return raw.select(pick(("read_id", "read", "read_name", "id")).alias("read_id"), pick(("strand", "true_strand")).alias("strand"), pick(("frame", "true_frame")).try_cast("int").alias("frame"), pick(("sequence", "protein", "true_protein")).alias("sequence"))


def read_proteins(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, strand, frame, sequence) of a protein FASTA whose names end with strand and frame."""
    f = read_fasta(spark, path)
    return f.select(strip_frame_suffix("id").alias("read_id"), strand("id").alias("strand"), frame("id").alias("frame"), "sequence")


def unique_blast8(hits: DataFrame) -> DataFrame:
    """The 12 classic columns of queries with a single hit."""
    n = F.count("*").over(W.partitionBy("query"))
    one = hits.withColumn("n", n).where("n = 1")
    return one.select("query", "target", (F.col("fident") * 100).alias("pident"), "alnlen", "mismatch", "gapopen", "qstart", "qend", "tstart", "tend", "evalue", "bits")


def summary_json(row: DataFrame) -> DataFrame:
    return row.select(F.to_json(F.struct(*row.columns)).alias("value"))
