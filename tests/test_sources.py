"""Round trips of the formats and the incremental jobs."""

from palisade.sources import formats as S
from palisade.streaming import incremental as I


def hit_line(query, target, fident, bits, qaln="AC-D", taln="ACWD"):
    return "\t".join(map(str, (query, target, fident, len(qaln), 0, 1, 2, 4, 11, 14, 1e-3, bits, 6, 77, qaln, taln))) + "\n"


def test_hits(spark, tmp_path):
    head = "query\ttarget\t" + "\t".join("x" * 14) + "\n"
    (tmp_path / "h.tsv").write_text(head + hit_line("m1_-_2", "t5", 0.77, 31.5) + hit_line("m2", "t5", "n/a", 8) + hit_line("m2", "t6", 0.6, 7))
    hits = S.read_hits(spark, str(tmp_path / "h.tsv"))
    rows = {(r["query"], r["target"]): r for r in hits.collect()}
    assert len(rows) == 3 and rows["m1_-_2", "t5"]["bits"] == 31.5 and rows["m1_-_2", "t5"]["tstart"] == 11 and rows["m2", "t5"]["fident"] is None
    assert [r["query"] for r in S.unique_blast8(hits).collect()] == ["m1_-_2"]
    S.write_hits_parquet(hits, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3


def test_reports_and_index(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, ["a", "b"]), (2, None, [])], "ref_id long, x double, tags array<string>")
    S.write_reports({"genes": df, "reads": df.drop("tags")}, str(tmp_path / "run"))
    lines = sorted("".join(f.read_text() for f in (tmp_path / "run" / "genes.tsv").glob("part*")).split("\n"))
    assert "1\t0.5\ta,b" in lines and "2\t.\t" in lines
    S.write_index(df.select("ref_id"), str(tmp_path / "ix"), d_max=0.3, state="validated")
    rows, sample = S.read_index(spark, str(tmp_path / "ix"))
    assert rows.count() == 2 and sample == {"d_max": 0.3, "state": "validated"}
    S.write_stats(df.drop("tags"), str(tmp_path / "st"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "st" / "references.json")).collect()) == ['{"ref_id":1,"x":0.5}', '{"ref_id":2}']


def test_records_over_blocks(spark, tmp_path):
    """A FASTA and a FASTQ file that are read in many small blocks."""
    import random

    rng = random.Random(2)
    seqs = {f"s{i}": "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 400))) for i in range(60)}
    (tmp_path / "a.fa").write_text("".join(f">{k} about {k}\n" + "".join(v[i:i + 50] + "\n" for i in range(0, len(v), 50)) for k, v in seqs.items()))
    (tmp_path / "a.fq").write_text("".join(f"@{k}\n{v}\n+\n{'I' * len(v)}\n" for k, v in seqs.items()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert spark.read.text(str(tmp_path / "a.fa")).rdd.getNumPartitions() > 5
        fa = {r["id"]: (r["description"], r["sequence"]) for r in S.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
        fq = {r["id"]: (r["sequence"], r["quality"]) for r in S.read_fastq(spark, str(tmp_path / "a.fq")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert fa == {k: (f"about {k}", v) for k, v in seqs.items()} and fq == {k: (v, "I" * len(v)) for k, v in seqs.items()}
    S.write_fastq(S.read_fastq(spark, str(tmp_path / "a.fq")), str(tmp_path / "out"), compression="gzip")
    assert {r["id"]: r["sequence"] for r in S.read_fastq(spark, str(tmp_path / "out")).collect()} == seqs


def test_truth_and_proteins(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("Read_Name\tother\ttrue_frame\tstrand\nr1\tx\t2\t-\nr2\tx\tbad\t+\n")
    got = [(r["read_id"], r["strand"], r["frame"], r["sequence"]) for r in S.read_truth(spark, str(tmp_path / "t.tsv")).orderBy("read_id").collect()]
    assert got == [("r1", "-", 2, None), ("r2", "+", None, None)]
    (tmp_path / "p.fa").write_text(">r1_-_2\nMK\nL\n>r3_+_0 x\nA\n")
    assert sorted(tuple(r) for r in S.read_proteins(spark, str(tmp_path / "p.fa")).collect()) == [("r1", "-", 2, "MKL"), ("r3", "+", 0, "A")]


def test_fasta_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first one\nACGT\nAC\n>s2\nGG\n")
    got = {r["id"]: (r["description"], r["sequence"]) for r in S.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"s1": ("first one", "ACGTAC"), "s2": ("", "GG")}
    S.write_fasta(S.read_fasta(spark, str(tmp_path / "a.fa")), str(tmp_path / "out"), width=4)
    again = {r["id"]: r["sequence"] for r in S.read_fasta(spark, str(tmp_path / "out")).collect()}
    assert again == {"s1": "ACGTAC", "s2": "GG"}
    (tmp_path / "a.fq").write_text("@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+\n##\n")
    got = {r["id"]: (r["sequence"], r["quality"]) for r in S.read_fastq(spark, str(tmp_path / "a.fq")).collect()}
    assert got == {"r1": ("ACGT", "IIII"), "r2": ("GG", "##")}


def test_gff_and_map(spark, tmp_path):
    df = spark.createDataFrame([("c", 1, 9, None, "+", 0, {"ID": "g1", "frame": "0"})], "seqid string, start int, stop int, score double, strand string, phase int, attributes map<string,string>")
    S.write_gff(df, str(tmp_path / "g"))
    r = S.read_gff(spark, str(tmp_path / "g")).first()
    assert (r["start"], r["stop"], r["score"], r["attributes"]) == (1, 9, ".", {"ID": "g1", "frame": "0"})
    (tmp_path / "m.tsv").write_text("#c\ngene\tgroup\na\tK1\nb\tK2\na\tK3\n")
    assert {r["gene"]: r["group"] for r in S.read_map(spark, str(tmp_path / "m.tsv")).collect()} == {"a": "K3", "b": "K2"}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "h.tsv").write_text(hit_line("r", "t", 0.9, 5) + hit_line("r", "u", "bad", 5))
    for _ in range(2):  # the second run finds nothing new
        I.ingest(I.hits_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2  # a number that does not parse loses no row
    spark.createDataFrame([(0, "TACG"), (1, "CACG")], "read_id long, seq string").write.parquet(str(tmp_path / "seqs"))
    s = spark.readStream.schema("read_id long, seq string").parquet(str(tmp_path / "seqs"))
    I.profile_stream(s).writeStream.outputMode("complete").format("memory").queryName("prof").trigger(availableNow=True).start().awaitTermination()
    got = {(r["channel"], r["pos"], r["base"]): r["n"] for r in spark.table("prof").collect()}
    assert got["5p", 0, "T"] == got["5p", 0, "C"] == 1 and got["3p", 0, "G"] == 2
    I.batch_monitor(s, str(tmp_path / "mon"), str(tmp_path / "ck2")).awaitTermination()
    spark.createDataFrame([(5, "TTTT"), (10_000, "AAAA")], "read_id long, seq string").write.mode("append").parquet(str(tmp_path / "seqs"))
    I.batch_monitor(s, str(tmp_path / "mon"), str(tmp_path / "ck2")).awaitTermination()  # a window that goes on in a second batch
    assert sorted((r["window"], r["n"], r["tc"]) for r in I.windows(spark, str(tmp_path / "mon")).collect()) == [(0, 3, 2 / 3), (1, 1, None)]
