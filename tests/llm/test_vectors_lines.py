"""Ball k-means, line runs, product codes, and the mended corners of earlier operators."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import op1_decontam, op11_ballkmeans as op11, op12_lines as op12, op13_codes as op13
from palisade.llm import op2_tokens as op2
from palisade.llm import op5_langid as op5

VEC = "vec_id long, embedding array<float>, label int, cluster string"


def vectors(rng, n=400, dims=64):
    centres = rng.normal(size=(9, dims)) * 0.3
    rows = [(int(i), (centres[i % 9] + rng.normal(size=dims) * 0.1).astype(np.float32).tolist(), None if i % 11 == 0 else int(i % 4), "x") for i in range(n)]
    rows += [(n, rows[5][1], 1, "x"), (n + 1, rows[5][1], 1, "x"), (7, rows[9][1], 2, "x"), (None, rows[3][1], 3, "x")]  # repeated, equal ids, no id
    return rows + [(n + 2, None, 1, "x"), (n + 3, [], 1, "x"), (n + 4, [0.5] * 63, 1, "x"), (n + 5, [None] + [0.5] * 63, 1, "x"), (n + 6, [float("nan")] * 64, 1, "x"), (n + 7, [float("inf")] + [0.5] * 63, None, "x"), (n + 8, [0.0] * 64, 1, "x"), (n + 9, [-0.0] * 64, 1, "x")]


def sound(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def plain_kmeans(rows, clusters, rounds, dims=64):
    kept = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v, *_ in rows if sound(v) and len(v) == dims]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1].tolist()))
    centroids = [r[1] for r in order[:clusters]]
    near = lambda x: min((int(((x - c) ** 2).sum()), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        centroids = [sum(x for (_, x), o in zip(kept, own) if o == k) // own.count(k) if own.count(k) else c for k, c in enumerate(centroids)]
    return [(i, *near(x)[::-1]) for i, x in kept], centroids


@pytest.mark.parametrize("clusters,rounds", [(40, 5), (3, 2), (1000, 1)])
def test_ball_kmeans_equals_all_comparisons(spark, clusters, rounds):
    rows = vectors(np.random.default_rng(4), 200)
    df = spark.createDataFrame(rows, VEC).repartition(5)
    got, found = op11.ball_kmeans(df, clusters, rounds)
    want, centroids = plain_kmeans(rows, clusters, rounds)
    key = lambda r: (r[0] is None, r)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()), key=key) == sorted(want, key=key)
    assert [c["centroid"] for c in found] == [c.tolist() for c in centroids] and sum(c["n"] for c in found) == len(want)
    assert sum(c["cost"] for c in found) == sum(w[2] for w in want)
    assert op11.ball_kmeans(df.limit(0), clusters, rounds)[0].count() == 0


def test_balls_compare_few_and_break_ties_low():
    rng = np.random.default_rng(2)
    centres = (rng.normal(size=(40, 64)) * 100).astype(int)
    own = rng.integers(0, 40, 5000)
    x = (centres[own] + rng.normal(size=(5000, 64)) * 5).astype(np.int64)
    far = [int(np.sqrt(((x[own == k] - centres[k]) ** 2).sum(axis=1).max())) + 1 for k in range(40)]
    balls = op11.Balls(centres.tolist(), far)
    cluster, distance, compared = balls.assign(x, own.astype(np.int32))
    d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all() and compared < 0.05 * d.size
    same = op11.Balls([[0] * 64, [0] * 64, [2] + [0] * 63], [None] * 3)
    cluster, distance, _ = same.assign(np.array([[1] + [0] * 63, [2] + [0] * 63, [0] * 64]), np.array([2, 2, 1]))
    assert cluster.tolist() == [0, 2, 0] and distance.tolist() == [1, 0, 0]
    wide = op11.Balls([[1 << 24] * 64, [-(1 << 24)] * 64], [None] * 2)  # too wide for doubles
    assert wide.assign(np.array([[(1 << 24) - 1] * 64, [-1] * 64]), np.array([1, 0]))[1].tolist() == [64, 64 * ((1 << 24) - 1) ** 2]


def test_vectors_beyond_the_range_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e9] * 64, 0, "x")], VEC)
    with pytest.raises(Exception, match="beyond"):
        op11.ball_kmeans(df)


def test_ball_tree_equals_all_comparisons():
    rng = np.random.default_rng(6)
    for entries, dims, spread in ((16, 8, 300), (16, 8, 2), (1, 8, 9), (5, 1, 3), (64, 4, 10), (200, 16, 1000)):
        book, x = rng.integers(-spread, spread, (entries, dims)), rng.integers(-spread, spread, (3000, dims))
        book[entries // 2] = book[0]  # equal entries: the lower index wins
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        for kind in (np.float64, np.int64):
            at, best, compared = op13.Tree(book).nearest(x.astype(kind))
            assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all() and compared <= d.size
    tight = rng.integers(-1000, 1000, (64, 8)) * 20
    x = tight[rng.integers(0, 64, 4000)] + rng.integers(-3, 3, (4000, 8))
    assert op13.Tree(tight).nearest(x)[2] < 0.5 * 64 * 4000


def plain_codes(rows, parts, entries, rounds, scale=4096):
    kept = [(i, np.floor(scale * np.array(v, np.float64)).astype(np.int64), lab) for i, v, lab, *_ in rows if sound(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    dims = len(kept[0][1])
    fit = [r for r in kept if len(r[1]) == dims]
    books = [[r[1].reshape(parts, -1)[p] for r in fit[:entries]] for p in range(parts)]
    near = lambda x, p: min((int(((x - c) ** 2).sum()), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(r[1].reshape(parts, -1)[p], p)[1] for r in fit]
            books[p] = [sum(r[1].reshape(parts, -1)[p] for r, o in zip(fit, own) if o == k) // own.count(k) if own.count(k) else c for k, c in enumerate(books[p])]
    out = []
    for i, x, lab in kept:
        got = [near(x.reshape(parts, -1)[p], p) for p in range(parts)] if len(x) == dims else None
        out.append((i, lab, "".join(f"{k:02x}" for _, k in got) if got else None, sum(d for d, _ in got) if got else None))
    return out, [c.tolist() for b in books for c in b]


def test_codes_equal_all_comparisons(spark):
    rows = vectors(np.random.default_rng(8), 150)
    df = spark.createDataFrame(rows, VEC).repartition(4)
    coded, books = op13.encode(df)
    want, entries = plain_codes(rows, 8, 16, 6)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["vec_id"], r["label"], r["code"], r["error"]) for r in coded.collect()), key=key) == sorted(want, key=key)
    assert [e.tolist() for b in books for e in b] == entries
    few, _ = op13.encode(df.where("vec_id < 5"))
    assert sorted(r["error"] for r in few.collect()) == [0] * 5 or few.count() == 5
    odd, none = op13.encode(spark.createDataFrame([(1, [1.0, 2.0], 0, "x"), (2, [1.0] * 8, None, "x")], VEC))
    assert [(r["code"], r["error"]) for r in odd.collect()] == [(None, None)] * 2 and none == []
    assert op13.encode(df.limit(0))[0].count() == 0


def plain_lines(texts, least):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    df = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if df[key(x)] < least]
        out.append((t, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def corpus(rng, n=120):
    shared = ["Subscribe now", "  ÜBER uns \t", "é", "all rights reserved \r", "x"]
    texts = ["\n".join(rng.choice([*shared, *shared, "", " ", f"line {rng.randrange(400)}", "SUBSCRIBE NOW", "subscribe now  ", "Über uns"]) for _ in range(rng.randrange(1, 9))) for _ in range(n)]
    return texts + [None, "", "\n", "\n\n", texts[0], texts[0], "\n".join(["Subscribe now", "kept"] * 20_000), " y " * 30_000]


def test_lines_equal_a_plain_count(spark):
    """Through several batches and levels of runs, with copies, a long text and blank lines."""
    texts = corpus(random.Random(3))
    df = spark.createDataFrame([(i if i % 9 else None, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, n_lines int, other int").repartition(4)
    for least, batches in ((10, 4), (3, 7), (1, 1), (1000, 2)):
        out = op12.strip(df, op12.frequent_lines(df, least, batches=batches))
        assert out.columns == ["doc_id", "text", "other", "n_lines", "n_dropped", "kept"]
        got = sorted(((r["text"], r["n_lines"], r["n_dropped"], r["kept"]) for r in out.collect()), key=str)
        assert got == plain_lines(texts, least)
    few = df.limit(0)
    assert op12.strip(few, op12.frequent_lines(few)).count() == 0
    assert not spark.sql("SHOW TABLES").where("tableName like 'line_run%'").count()


def test_lines_by_shuffles(spark, monkeypatch):
    """The same without any broadcast."""
    for name in ("BROADCAST_KEYS", "BROADCAST_DOCS", "BROADCAST_PLACES"):
        monkeypatch.setattr(op12, name, -1)
    texts = corpus(random.Random(5))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = op12.strip(df, op12.frequent_lines(df, 10))
    assert sorted(((r["text"], r["n_lines"], r["n_dropped"], r["kept"]) for r in out.collect()), key=str) == plain_lines(texts, 10)


def test_runs_are_merged_by_level(spark):
    """Eight batches leave one run of the third level; a key that is frequent in a run isn't counted again."""
    runs = op12.LineRuns(spark, 5, 4)
    hot = spark.range(6).select(F.lit(1).cast("long").alias("h1"), F.lit(2).cast("long").alias("h2"))
    for b in range(8):
        runs.add(hot.unionByName(spark.createDataFrame([(b, 0), (99, 0)], "h1 long, h2 long")))
        assert sum(map(len, runs.levels)) == bin(b + 1).count("1")
    assert [len(x) for x in runs.levels] == [0, 0, 0, 1]
    n = {(r["h1"], r["h2"]): r["n"] for r in runs.runs()[0].collect()}
    assert n[1, 2] == 6 and n[99, 0] >= 5 and n[3, 0] == 1
    assert {(r["h1"], r["h2"]) for r in runs.frequent().collect()} == {(1, 2), (99, 0)}
    runs.close()


def test_letters_are_letters():
    assert [bool(op5.runs(t)) for t in ("²½", "③Ⅷ", "12_", "é", "aª", "日本", "ʰ")] == [False, False, False, True, True, True, True]
    assert all((op5.runs(c) == [c]) == c.isalpha() for c in map(chr, [*range(0x3000), *range(0x1D7C0, 0x1D800)]))


def test_token_cache_is_bounded_by_bytes(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(op2, "CACHE_BYTES", 200_000)
    enc = op2.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"x{i}\t" + "lorem ipsum " * 50 + f"{i}\r\n" + "字" * (i % 90) for i in range(3000)]
    for lo in range(0, len(texts), 100):
        got = enc(texts[lo:lo + 100])
        assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [e.ids for e in enc.tok.encode_batch(texts[lo:lo + 100], add_special_tokens=False)]
    assert sum(op2.ENTRY + 2 * len(k) + len(v) for k, v in enc.cache.items()) <= 210_000 and max(map(len, enc.cache)) <= op2.LONGEST


def test_repeating_text_is_searched_in_bounded_memory():
    import time
    import tracemalloc

    index = op1_decontam.Windows([(i, "a" * 400) for i in range(5)] + [(9, "ab" * 200), (10, " ".join(f"w{i}" for i in range(60)))])
    began = time.time()
    tracemalloc.start()
    text = "a" * 300_000 + " " + " ".join(f"w{i}" for i in range(60)) + " " + "ab" * 100_000
    got = op1_decontam.find(index, text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {g[0] for g in got} == {0, 1, 2, 3, 4, 9, 10} and peak < 500e6 and time.time() - began < 60
    assert min(g[1] for g in got if g[0] == 0) == 0 and 300_000 <= max(g[2] for g in got if g[0] == 0) <= 300_009


def test_slices_find_what_one_pass_finds(monkeypatch):
    rng = random.Random(1)
    words = [f"{rng.choice('abcdef')}{i % 37}" for i in range(4000)]
    items = [(k, " ".join(words[k * 90:k * 90 + 60])) for k in range(40)]
    text = " ".join(w if rng.random() > 0.02 else "zz" for w in words * 2)
    index = op1_decontam.Windows(items)
    whole = op1_decontam.find(index, text)
    monkeypatch.setattr(op1_decontam, "SLICE_HITS", 50)
    assert {g[0] for g in op1_decontam.find(index, text)} == {g[0] for g in whole} and len(whole) > 40


def test_licenses_that_a_word_tells_apart():
    from palisade.llm.op4_license import NOTICES, Scanner

    scan = Scanner()
    for text, label in (("licensed under CC BY-ND 4.0 ok", "cc-by-nd"), ("Licensed under cc by nc 4.0", "cc-by-nc"), ("licensed undr cc by-sa 4.0", "cc-by-sa"), ("licensed under cc-by-nc-sa 4.0", "cc-by-nc-sa"), ("licensed under the apache licence, version 2.0", "apache")):
        assert scan([text])[5] == [label]
    long = " ".join(list(NOTICES)[i % len(NOTICES)] for i in range(600))
    spans = scan.fuzzy(f" {long} ")
    assert len(spans) == 600 and all(e == 0 for *_, e in spans)
    words = f" {long} ".split(" ")
    at = scan.exact(f" {long} ")
    assert at and all(" ".join(words[1 + n:]).startswith(("mit license", "apache license", "general public license")) for n, _ in at)
