"""A corpus pipeline: each stage works on all rows its predecessor kept, written as Parquet and read again.

toxicity: documents predicted toxic go. language_id: documents that the language models reject go. near_dedup: of each
group of near copies (five-word shingles, similarity 0.8 or more) the row of the smallest doc_id stays. decontaminate:
documents that hold a benchmark passage go. pieces: the documents with the digests of their SentencePiece pieces.

Edge cases are those of the operators; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade.llm.op1_decontam import drop_contaminated
from palisade.llm.op5_langid import keep_identified
from palisade.llm.op6_simhash import drop_near_duplicates
from palisade.llm.op9_toxicity import drop_toxic
from palisade.llm.op10_pieces import encode_stage
from palisade.session import cut, drop_cut

STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_identified),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pieces", encode_stage),
]

#: Learned models and similarity groups aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's rows are written to the shared folder before the next one reads them, and
    go once that one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_cut(before)
        before = docs
    return docs
