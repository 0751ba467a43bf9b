"""Chat formatting with perspective rotation.

For every participant of a conversation (every distinct role) the dialogue is rendered with that speaker as the
assistant and all others as named users; mask spans mark what the assistant is trained on (its texts with their end
marks). A rendering is a sequence of parts of PART turns, with the place of each part's first character in the whole:
parts joined in order are the whole, and a part's spans moved by its place are the whole's spans, so no conversation
has to be gathered in one task; whole() gathers them where that is wanted. Turns are numbered by ranges of the sorted
table, so one long conversation lies in many tasks. The turns of a part are brought together once, and rendered for every
participant where they lie.

Edge cases: a null role is called `unknown`, a null text is empty, null conversation ids form one conversation; turns
are ordered by turn, role, text (nulls first); repeated rows are repeated turns; marks within texts are broken up.
Extra columns are ignored. A conversation always has a participant, so none is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.session import cut

PART = 256


def numbered(turns: DataFrame) -> DataFrame:
    """turns (key, turn, role, text) with pos, their place in the conversation from 0: places in the ranges of a sort, less
    the place of the conversation's first turn there, and the turns in the ranges before."""
    order = [F.col(c).asc_nulls_first() for c in ("key", "turn", "role", "text")]
    n = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    ranges = turns.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranges = cut(ranges.select("key", "role", "text", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i")), "chat-ranges")
    own = ranges.groupBy("key", "__p").agg(F.count("*").alias("n"), F.min("__i").alias("first"))  # a row a conversation and range
    before = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = own.select("key", "__p", (before - F.col("first")).alias("shift"))
    return ranges.join(shifts, ["key", "__p"]).select("key", "role", "text", (F.col("__i") + F.col("shift")).alias("pos"))


_ASSISTANT, _END = "<|assistant|>\n", "<|end|>"


def _head(role: Column, own: Column) -> Column:
    return F.when(own, F.lit(_ASSISTANT)).otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))


def _places(turns: DataFrame, part: int) -> DataFrame:
    """(key, part, people): every participant of the conversation with part_start, the characters of its rendering before the
    part, from counts and lengths alone."""
    own = F.length(_head(F.col("role"), F.lit(True))) - F.length(_head(F.col("role"), F.lit(False)))
    sizes = turns.groupBy("key", (F.col("pos") / part).cast("long").alias("part"), "role").agg(
        F.count("*").alias("n"), F.sum((F.length(_head(F.col("role"), F.lit(False))) + F.length("text") + len(_END) + 1).cast("long")).alias("size"), F.max(own).alias("own"))
    ahead = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = sizes.groupBy("key", "part").agg(F.sum("size").alias("size")).select("key", "part", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("others"))
    people = sizes.groupBy("key", "role").agg(F.max("own").alias("own"))
    grid = parts.join(people, "key").join(sizes.select("key", "part", "role", "n"), ["key", "part", "role"], "left")
    mine = F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy("key", "role").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = grid.select("key", "part", F.struct(F.col("role").alias("perspective"), (F.col("others") + mine * F.col("own")).alias("part_start")).alias("p"))
    return placed.groupBy("key", "part").agg(F.collect_list("p").alias("people"))


def rotate(conversations: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, perspective, part, n_turns, n_masked, text, mask_spans ("start-end" in characters of the part,
    comma-joined), part_start (characters of the whole before the part)."""
    turns = numbered(conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("?")).alias("key"), "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text")))
    parts = turns.groupBy("key", (F.col("pos") / part).cast("long").alias("part")).agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))  # at most part turns
    rows = parts.join(_places(turns, part), ["key", "part"]).select("key", "part", "turns", F.inline("people"))

    def mark(acc: Column, x: Column) -> Column:
        own = x["role"] == F.col("perspective")
        start = acc["at"] + F.length(_head(x["role"], own))
        stop = start + F.length(x["text"]) + len(_END)
        span = F.concat_ws("-", start.cast("string"), stop.cast("string"))
        return F.struct((stop + 1).cast("long").alias("at"), F.when(own, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    text = F.array_join(F.transform("turns", lambda x: F.concat(_head(x["role"], x["role"] == F.col("perspective")), x["text"], F.lit(_END + "\n"))), "")
    spans = F.aggregate("turns", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans")), mark)["spans"]
    return rows.select(F.when(F.col("key") != "?", F.expr("substring(key, 2)")).alias("conv_id"), "perspective", "part", F.size("turns").cast("long").alias("n_turns"),
                       F.size(F.filter("turns", lambda x: x["role"] == F.col("perspective"))).cast("long").alias("n_masked"), text.alias("text"), F.array_join(spans, ",").alias("mask_spans"), "part_start")


def whole(parts: DataFrame) -> DataFrame:
    """One row a conversation and perspective of what rotate() gives: n_turns, n_masked, text, mask_spans of the whole.

    A row is as long as its conversation.
    """
    shift = lambda start: lambda s: F.concat_ws("-", *[(F.split(s, "-")[k].cast("long") + start).cast("string") for k in (0, 1)])
    spans = F.when(F.col("mask_spans") == "", F.array().cast("array<string>")).otherwise(F.split("mask_spans", ","))
    rows = parts.withColumn("spans", F.transform(spans, shift(F.col("part_start"))))
    got = rows.groupBy("conv_id", "perspective").agg(F.sum("n_turns").alias("n_turns"), F.sum("n_masked").alias("n_masked"), F.sort_array(F.collect_list(F.struct("part", "text", "spans"))).alias("all"))
    return got.select("conv_id", "perspective", "n_turns", "n_masked", F.array_join(F.transform("all", lambda x: x["text"]), "").alias("text"),
                      F.array_join(F.flatten(F.transform("all", lambda x: x["spans"])), ",").alias("mask_spans"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = r"""
WITH turns AS (
  SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos FROM turns
), people AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM turns),
pieces AS (
  SELECT p.conv_id, q.perspective, CAST(p.pos // 256 AS BIGINT) AS part, p.pos, p.role = q.perspective AS own,
         CASE WHEN p.role = q.perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || p.role || '|>' || chr(10) END AS head,
         p.text || '<|end|>' AS body
  FROM placed p JOIN people q ON p.conv_id IS NOT DISTINCT FROM q.c
), offsets AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS s
  FROM pieces
), parts AS (SELECT conv_id, perspective, part, count(*) AS n_turns, CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) AS n_masked,
       string_agg(head || body || chr(10), '' ORDER BY pos) AS text,
       coalesce(string_agg(CASE WHEN own THEN CAST(s AS BIGINT) || '-' || CAST(s + length(body) AS BIGINT) END, ',' ORDER BY pos), '') AS mask_spans
FROM offsets GROUP BY conv_id, perspective, part)
SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, perspective ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS part_start FROM parts
"""
