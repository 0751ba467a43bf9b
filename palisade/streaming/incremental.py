"""Incremental ingestion and profiles with Structured Streaming: counts merge, so they can be kept up over new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from palisade.operators.profile import terminal_counts
from palisade.sources.formats import HITS, parsed


def hits_stream(spark: SparkSession, path: str) -> DataFrame:
    """New hit tables of a folder as they come; header rows go, numbers that don't parse are null, as in read_hits."""
    raw = spark.readStream.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in HITS])).csv(path, sep="\t", quote="")
    return parsed(raw)


def ingest(hits: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append hits to a Parquet table, each file once; ends when nothing new is left."""
    return hits.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def profile_stream(seqs: DataFrame) -> DataFrame:
    """Running (channel, pos, base, n) over a stream of sequences, for output mode complete."""
    return terminal_counts(seqs)


def batch_monitor(stream: DataFrame, path: str, checkpoint: str, window: int = 10_000) -> StreamingQuery:
    """Per batch and window of reads: how many, and how many T and C at the first base. A batch is a folder of its own, so one
    that is run again replaces what it wrote; windows() merges the batches."""

    def put(batch: DataFrame, batch_id: int) -> None:
        first = F.substring("seq", 1, 1)
        (batch.groupBy(F.floor(F.col("read_id") / window).alias("window"))
         .agg(F.count("*").alias("n"), F.sum((first == "T").cast("long")).alias("t"), F.sum((first == "C").cast("long")).alias("c"))
         .write.mode("overwrite").parquet(f"{path}/batch={batch_id}"))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(spark: SparkSession, path: str) -> DataFrame:
    """(window, n, tc) over all batches of a monitor: tc is the share of T among T and C."""
    s = spark.read.parquet(path).groupBy("window").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("c").alias("c"))
    return s.select("window", "n", (F.col("t") / F.nullif(F.col("t") + F.col("c"), F.lit(0))).alias("tc"))


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by type and tumbling window; an extension, as alignments have no event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
