"""Lines that many documents share, by levelled sorted runs of line hashes.

A run is a table of distinct line hashes with the number of documents that hold them, in buckets of the hash and sorted
within (a bucket join needs no shuffle). Batches of documents come in turn: a batch's hashes are counted, those that the
runs already show as frequent are dropped by a merge anti join, and the rest become a run of level 0. Two runs of a
level are merged into one of the next, so a hash is rewritten a logarithmic number of times, and at the end all levels
merge. A last pass drops the frequent lines: it shuffles places of lines, never texts, unless the documents that lose
lines are too many to broadcast.

Keys are two 64-bit hashes of the stripped and lower-cased line. Everything is DataFrame work in the JVM.

Edge cases: null and empty texts are one empty line; blank lines are never dropped; a line repeated in a document counts
once; repeated rows count as documents of their own, null ids too; a text all of whose lines go is empty; no rows give
no rows; extra columns stay, and those named like the added ones give way (strip()).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.session import cut, drop_cut, scratch_dir

LEAST_DOCS, LEAST_CHARS = 10, 1
#: Batches that a table is dealt into.
BATCHES = 4
#: Frequent keys, and documents and places of lines to drop, that are broadcast; more are joined by shuffles.
BROADCAST_KEYS, BROADCAST_DOCS, BROADCAST_PLACES = 500_000, 200_000, 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\x0c\r"
HASHES = ["h1", "h2"]


def lines(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.split(F.coalesce(t, F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    """The line stripped of blanks at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))  # lower() is A-Z only in ASCII


def hashes(value: Column, first: str = "h1", second: str = "h2") -> list[Column]:
    """128 bits of a string: two hashes of different seeds."""
    return [F.xxhash64(value).alias(first), F.xxhash64(F.lit("second"), value).alias(second)]


def document_keys(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(h1, h2, batch columns kept): one row a document and distinct line key of at least least_chars code points."""
    keys = F.array_distinct(F.transform(lines("text"), key))
    return docs.select(*[c for c in docs.columns if c != "text"], F.explode(keys).alias("key")).where(F.char_length("key") >= max(1, least_chars)).select(*[c for c in docs.columns if c != "text"], *hashes(F.col("key")))


class LineRuns:
    """Levelled runs of line hashes in the shared folder; add() takes batches, frequent() merges all."""

    def __init__(self, spark: SparkSession, least_docs: int = LEAST_DOCS, buckets: int | None = None):
        self.spark, self.least = spark, least_docs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def add(self, batch: DataFrame) -> None:
        """A batch (h1, h2), a row a document and line: what the runs show as frequent goes, the rest becomes a run."""
        own = batch.groupBy(*HASHES).agg(F.count("*").alias("n"))
        for run in self.runs():
            own = own.join(run.where(F.col("n") >= self.least).select(*HASHES).hint("merge"), HASHES, "left_anti")
        self._push(0, self._write(own))

    def frequent(self) -> DataFrame:
        """(h1, h2) of the lines of at least least_docs documents; the runs become one."""
        while sum(map(len, self.levels)) > 1:
            a, b = [t for level in self.levels for t in level][:2]  # the lowest levels hold the smallest runs
            merged = self._write(self._merge(a, b))
            self._drop(a), self._drop(b)
            self.levels = [[t for t in level if t not in (a, b)] for level in self.levels]
            self.levels[0].append(merged)
        left = self.runs()
        return left[0].where(F.col("n") >= self.least).select(*HASHES) if left else self.spark.createDataFrame([], "h1 long, h2 long")

    def close(self) -> None:
        for level in self.levels:
            for t in level:
                self._drop(t)
        self.levels = []

    def _push(self, level: int, run: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == 2:
            a, b = self.levels[level]
            merged = self._write(self._merge(a, b))
            self._drop(a), self._drop(b)
            self.levels[level] = []
            self._push(level + 1, merged)

    def _merge(self, a: str, b: str) -> DataFrame:
        x, y = self.spark.table(a), self.spark.table(b).withColumnRenamed("n", "m")
        return x.join(y.hint("merge"), HASHES, "full").select(*HASHES, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{scratch_dir(self.spark)}/{name}"
        rows.write.bucketBy(self.buckets, *HASHES).sortBy(*HASHES).option("path", path).format("parquet").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        files = self.spark.table(name)
        drop_cut(files)
        self.spark.sql(f"DROP TABLE {name}")


def frequent_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, batches: int = BATCHES) -> DataFrame:
    """(h1, h2) of the keys that at least least_docs rows of docs (text and others) hold, through batches of rows."""
    spark = docs.sparkSession
    dealt = docs.select(F.pmod(F.xxhash64(*[c for c in docs.columns]), F.lit(batches)).cast("int").alias("batch"), "text")
    whole = cut(document_keys(dealt, least_chars), "line-keys")
    runs = LineRuns(spark, least_docs)
    for b in range(batches):
        runs.add(whole.where(F.col("batch") == b).select(*HASHES))
    found = cut(runs.frequent(), "frequent-lines")
    runs.close()
    drop_cut(whole)
    return found


def _places(docs: DataFrame, frequent: DataFrame, least_chars: int) -> DataFrame:
    """(t1, t2, gone): hashes of the texts that lose lines, and the places of those lines, ascending."""
    each = docs.select(*hashes(F.coalesce("text", F.lit("")), "t1", "t2"), F.posexplode(lines("text")).alias("place", "line"))
    each = each.select("t1", "t2", "place", key(F.col("line")).alias("key")).where(F.char_length("key") >= max(1, least_chars))
    hit = each.select("t1", "t2", "place", *hashes(F.col("key"))).join(frequent, HASHES, "left_semi")
    return hit.groupBy("t1", "t2").agg(F.array_sort(F.collect_set("place")).alias("gone"))  # copies of a text meet as sets


def without(text: Column, gone: Column) -> Column:
    """The text less the lines at the given places; each array is bound once, so the work is linear in the lines."""
    def pick(all_lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), gone)
        return F.array_join(F.transform(kept, lambda p: F.element_at(all_lines, p + 1)), "\n")

    return F.transform(F.array(lines(text)), pick)[0]


def strip(docs: DataFrame, frequent: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs with n_lines, n_dropped and kept (the text of the lines that stay)."""
    few = frequent.count() <= BROADCAST_KEYS
    places = cut(_places(docs, F.broadcast(frequent) if few else frequent, least_chars), "lines-gone")
    size = places.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("places")).first()
    if size["docs"] <= BROADCAST_DOCS and size["places"] <= BROADCAST_PLACES:
        places = F.broadcast(places)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
    t1, t2 = hashes(F.coalesce("text", F.lit("")), "t1", "t2")
    plain = docs.select(F.struct(*names).alias("row"), "text").select("row", t1.alias("t1"), t2.alias("t2"))
    both = plain.join(places, ["t1", "t2"], "left")
    text = F.coalesce("row.text", F.lit(""))
    return both.select(
        *[F.col("row").getField(c).alias(c) for c in names],
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), text).otherwise(without(text, F.col("gone"))).alias("kept"),
    )


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = strip(docs, frequent_lines(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""WITH split AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
line AS (SELECT rid, place, parts[place] AS line, translate(trim(parts[place], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
 FROM (SELECT rid, parts, unnest(range(1, len(parts) + 1)) AS place FROM split)),
often AS (SELECT key FROM line WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
kept AS (SELECT l.rid, count(*) - count(o.key) AS n_kept, count(o.key) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (o.key IS NULL), '') AS kept FROM line l LEFT JOIN often o USING (key) GROUP BY l.rid)
SELECT s.doc_id, len(s.parts) AS n_lines, k.n_dropped, sha256(k.kept) AS kept_sha256 FROM split s JOIN kept k USING (rid)"""
