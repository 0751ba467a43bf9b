"""The operators against brute force, round trips and edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from palisade.llm import op1_decontam, op3_chat, op4_license, op5_langid, op7_forest, op8_lm, op9_toxicity, op10_pieces
from palisade.llm import op2_tokens as op2
from palisade.llm import op6_simhash as op6

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def write(path, docs, labels=(), benchmark=(), conversations=(), embeddings=()):
    """Small tables, documents with extra columns of clashing names."""
    ids, texts, langs = ([d[k] for d in docs] for k in range(3)) if docs else ([], [], [])
    n = len(docs)
    pq.write_table(pa.table({
        "doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()), "source": pa.array(["s"] * n, pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64()),
        "score": pa.array(["x"] * n, pa.string()), "labels": pa.array([None] * n, pa.int32()), "rid": pa.array([1] * n, pa.int64())}), f"{path}/documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([1] * len(labels), pa.int32()), "toxic": pa.array([x[1] for x in labels], pa.int32())}), f"{path}/labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([x[0] for x in benchmark], pa.int64()), "text": pa.array([x[1] for x in benchmark], pa.string())}), f"{path}/benchmark.parquet")
    pq.write_table(pa.table({k: pa.array([x[i] for x in conversations], t) for i, (k, t) in enumerate((("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())))}), f"{path}/conversations.parquet")
    pq.write_table(pa.table({"vec_id": pa.array([x[0] for x in embeddings], pa.int64()), "embedding": pa.array([x[1] for x in embeddings], pa.list_(pa.float32())), "label": pa.array([0] * len(embeddings), pa.int32())}), f"{path}/embeddings.parquet")
    return str(path)


ODD = [(1, None, "en"), (2, "", None), (None, "some plain words here", "en"), (3, "some plain words here", "en"), (3, "some plain words here", "en"), (4, "the end\n\n of  it ", "de"), (5, "12 345 !!", "en"), (6, "word " * 3000, "de"), (7, "日本語 😀", "en")]
BENCH = [(1, prose(1, 40)), (2, None), (3, ""), (4, "short")]
VECTORS = [(0, [1.0, 0.0]), (100, None), (200, [0.0, 0.0]), (300, [float("nan"), 1.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [1.0, 0.1]), (4, [None, 1.0]), (5, [1.0]), (400, [])]
CONV = [(1, 0, "user", "hi <|end|>"), (1, 1, None, None), (None, 0, "a", "x"), (None, 0, "a", "x"), (1, 1, "b", "yo")]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return write(tmp_path_factory.mktemp("odd"), ODD, [(1, 1), (2, 0), (3, 1), (3, None), (None, 1)], BENCH, CONV, VECTORS)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), [])


def queries():
    from palisade.llm import registry

    return registry.queries()


@pytest.mark.parametrize("name", [n for n in queries() if n != "pipeline"])
def test_odd_and_empty_tables(spark, odd, empty, name):
    q = queries()[name]
    got = q(spark, odd).toPandas()
    if name not in ("op1_decontam", "op3_chat", "op7_forest", "op11_ballkmeans", "op13_codes"):
        assert len(got) == len(ODD)
    assert len(q(spark, empty).toPandas()) == 0


def test_values_of_odd_rows(spark, odd):
    """Null and empty texts, repeated rows and null ids have the stated values."""
    q = queries()
    tokens = q["op2_tokens"](spark, odd).toPandas().sort_values("start")
    assert tokens.doc_id.isna().tolist() == [True] + [False] * 8 and tokens[tokens.doc_id.isin([1, 2])].n_tokens.tolist() == [1, 1]
    assert tokens.start.tolist() == [0, *tokens.n_tokens.cumsum().tolist()[:-1]] and tokens[tokens.doc_id == 3].ids_crc32.nunique() == 1
    lic = q["op4_license"](spark, odd).toPandas()
    assert (lic[lic.doc_id.isin([1, 2])].n_words == 0).all() and lic[lic.doc_id == 1].first_word.isna().all() and (lic[lic.doc_id == 1].base_labels == "").all()
    lang = q["op5_langid"](spark, odd).toPandas()
    assert set(lang[lang.doc_id.isin([1, 2, 5])].lang_pred) == {"und"} and (lang[lang.doc_id == 5].score == 0).all()
    sim = q["op6_simhash"](spark, odd).toPandas()
    assert sim[sim.doc_id.isin([1, 2])].fingerprint.tolist() == ["0" * 16] * 2 and sim[sim.doc_id.isin([1, 2])].component_id.tolist() == [1, 1]
    assert (sim[(sim.doc_id == 3) | sim.doc_id.isna()].component_id == 3).all()
    near = q["op7_forest"](spark, odd).toPandas().sort_values("rank")
    assert list(zip(near.query_id, near["rank"], near.vec_id)) == [(0, 1, 1), (0, 2, 3), (0, 3, 2)]
    lm = q["op8_lm"](spark, odd).toPandas()
    assert lm[lm.doc_id.isin([1, 2])].n_tokens.tolist() == [1, 1] and lm[lm.doc_id == 3].score.nunique() == 1 and np.isfinite(lm.score).all()
    tox = q["op9_toxicity"](spark, odd).toPandas()
    assert tox[tox.doc_id.isin([1, 2])].score.nunique() == 1 and tox.score.between(0, 1).all()
    pieces = q["op10_pieces"](spark, odd).toPandas()
    assert (pieces[pieces.doc_id.isin([1, 2])].n_tokens == 0).all() and set(pieces[pieces.doc_id == 1].ids_sha256) == {hashlib.sha256(b"").hexdigest()}
    chat = q["op3_chat"](spark, odd).toPandas()
    assert chat.conv_id.isna().sum() == 1 and chat[chat.conv_id.isna()].n_turns.tolist() == [2] and "unknown" in set(chat.perspective)


def test_stages_keep_rows_and_columns(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for stage in (op1_decontam.drop_contaminated, op5_langid.keep_identified, op6.drop_near_duplicates, op9_toxicity.drop_toxic):
        assert stage(spark, docs, odd).columns == docs.columns
    out = op10_pieces.encode_stage(spark, docs, odd)
    got = out.toPandas()
    assert out.columns[:len(docs.columns)] == docs.columns and len(got) == len(ODD) and got.text.isna().sum() == 1


def test_stages_drop_what_is_planted(spark, tmp_path):
    """Benchmark passages, near copies and toxic documents go, one of each group and all else stays."""
    toxic = ["you are a stupid idiot and a loser", "what a worthless moron you are"]
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        docs.append((i, prose(7000 + i, 30) + (f" {toxic[i // 4 % 2]} " if bad else " ") + prose(8000 + i, 20), "en"))
        labels.append((i, int(bad)))
    sf = write(tmp_path, docs, labels, [(1, prose(21, 60))])
    table = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in op9_toxicity.drop_toxic(spark, table, sf).collect()}
    assert kept == {i for i in range(400) if i % 4}
    extra = spark.createDataFrame([(1001, "x " + prose(21, 60)[100:300] + " y", "en"), (1002, "x " + prose(22, 60) + " y", "en")], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in op1_decontam.drop_contaminated(spark, extra, sf).collect()] == [1002]


def test_pipeline_odd_and_empty(spark, odd, empty):
    got = corpus_pipeline.run(spark, odd).toPandas()
    assert set(got.doc_id.dropna()) <= {1, 2, 3, 4, 5, 6, 7} and "ids_sha256" in got
    assert len(corpus_pipeline.run(spark, empty).toPandas()) == 0


def test_decontam_finds_edited_passage():
    index = op1_decontam.Windows(BENCH)
    passage = list(BENCH[0][1])
    for i in range(0, len(passage), 40):
        passage[i] = "q"
    assert {m[0] for m in op1_decontam.find(index, prose(9, 80) + " " + "".join(passage) + " " + prose(8, 30))} == {1}
    assert op1_decontam.find(index, prose(7, 300)) == []


def test_decontam_equals_brute_force():
    """Windows of which the whole text holds an occurrence within their budget, by plain dynamic programming."""
    items = [(1, prose(21, 30)), (2, prose(22, 60)), (3, "a tiny item"), (4, "x"), (5, prose(23, 8))]
    index = op1_decontam.Windows(items)
    rng = random.Random(3)

    def edited(t, n):
        t = list(t)
        for _ in range(n):
            i = rng.randrange(len(t))
            t[i:i + 1] = rng.choice(["", "q", t[i] + "z"])
        return "".join(t)

    def within(pattern, text, k):
        prev = [0] * (len(text) + 1)
        for i, c in enumerate(pattern, 1):
            cur = [i] + [0] * len(text)
            for j, d in enumerate(text, 1):
                cur[j] = min(prev[j - 1] + (c != d), prev[j] + 1, cur[j - 1] + 1)
            prev = cur
        return min(prev) <= k

    seen = set()
    for k in range(40):
        src = rng.choice(items[:2] + items[4:])[1]
        cut = rng.randrange(max(1, len(src) - 150))
        text = prose(300 + k, 12) + " " + edited(src[cut:cut + 150], rng.randrange(16)) + " A TINY, item" * (k % 3 == 0) + " xx " + prose(400 + k, 12)
        data = op1_decontam.normalise(text)
        want = {i for i, _, w in index.windows if within(w, data, op1_decontam.budget(len(w)))} | ({3} if k % 3 == 0 else set())
        got = {m[0] for m in op1_decontam.find(index, text)}
        assert got == want
        seen |= want
    assert seen == {1, 2, 3, 5}
    assert op1_decontam.find(index, "é x") == [(4, 3, 4, 0)] and op1_decontam.find(index, "tiny item") == []


def test_align_equals_plain_dynamic_programming():
    rng = random.Random(4)
    for _ in range(40):
        p = "".join(rng.choice("abcd") for _ in range(30))
        t = list("xxxxx" + p + "xxxxx")
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = rng.choice("abcd")
        t = "".join(t)
        prev = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            cur = [i] + [0] * len(t)
            for j, e in enumerate(t, 1):
                cur[j] = min(prev[j - 1] + (c != e), prev[j] + 1, cur[j - 1] + 1)
            prev = cur
        got = op1_decontam.align(p.encode(), t.encode(), 4, 0, 10)
        assert (got[0] if got else None) == (min(prev) if min(prev) <= 4 else None)


def test_token_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 3000):
        x = rng.integers(0, 50257, n).astype("u4")
        x[::17] = rng.integers(0, 2 ** 32 - 1, len(x[::17]))
        starts = list(range(0, n, 100))
        im = op2.Image(op2.pack(x, starts, [None, *range(1, len(starts))][:len(starts)]))
        assert (im.ids() == x).all() and im.has_id.tolist() == [0, *[1] * (len(starts) - 1)][:len(starts)]
        assert all((im.document(k) == x[a:a + 100]).all() for k, a in enumerate(starts))
        if n == 3000:
            assert (im.blocks(3, 5) == x[384:640]).all()


def test_tokens_query_equals_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = op2.op2_tokens(spark, SF).toPandas().sort_values("doc_id")
    docs = pq.read_table(f"{SF}/documents.parquet").to_pandas().sort_values("doc_id")
    at = 0
    for r, text in zip(got.itertuples(), docs.text):
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_chunks_equal_library():
    import public_tokenizers

    e = op2.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 14))) for chars in ("ab \n😀é .'1s\t　,!", "ab \né .'1sre²ª", "ab \n😀 Ā.1\x1c\x85") for _ in range(2000)] + ["don't <|endoftext|> it's"]
    for t, b in zip(texts, e(texts)):
        assert e.tok.encode(t, add_special_tokens=False).ids == np.frombuffer(b, "<u4").tolist(), repr(t)


def test_chat_parts_join_to_the_whole(spark):
    rows = [(1, i, "ab"[i % 2], f"t{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    key = ["perspective", "part"]
    whole = op3_chat.rotate(df).toPandas().set_index("perspective")
    parts = op3_chat.rotate(df, 3).toPandas().sort_values(key).groupby("perspective").text.sum()
    assert (parts == whole.text).all()
    joined = op3_chat.whole(op3_chat.rotate(df, 3)).toPandas().set_index("perspective")
    assert (joined.text == whole.text.reindex(joined.index)).all() and (joined.mask_spans == whole.mask_spans.reindex(joined.index)).all() and (joined.n_turns == 10).all()
    for who, r in whole.iterrows():
        spans = [tuple(map(int, s.split("-"))) for s in r.mask_spans.split(",")]
        assert [r.text[a:b] for a, b in spans] == [f"{t}<|end|>" for _, _, x, t in rows if x == who]


def test_license_places_and_fuzzy_spans():
    n, base, first, last, b, labels, score, spans = (c[0] for c in op4_license.Scanner()(["MIT License. The mit-license! licensed undr the Apache License, Version 2.0"]))
    assert (n, base, first, last, b, labels, score) == (13, 3, 0, 8, "apache,mit", "apache,mit", 1.0) and "apache:" in spans
    assert op4_license.Scanner()(["mit licenses, the license"])[1][0] == 0


def test_langid_accuracy(spark):
    got = op5_langid.op5_langid(spark, "/root/testdata/sf0.01").toPandas()
    lang = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pandas()[["doc_id", "lang"]]
    m = got.merge(lang, on="doc_id")
    assert (m[m.held_out].lang == m[m.held_out].lang_pred).mean() > 0.98 and m.rejected.mean() < 0.01


def test_kneser_ney_sums_to_one():
    counts = {"x": Counter(("\x02" * 4 + w + "\x03")[i:i + 5] for w in ("abab", "abba", "aab") for i in range(len(w) + 1))}
    m = op5_langid.KneserNey(["x"], counts)
    for context in ("\x02\x02ab", "baba", "\x02\x02\x02\x02", "zzzz"):
        codes = np.array([[ord(x) for x in context + c] for c in "ab\x02\x03?"], np.uint32)
        assert np.exp(m.logp(codes, 0)).sum() == pytest.approx(1.0)


def test_kneser_ney_equals_the_plain_recursion():
    words = ["banana", "bandana", "anna", "ban", "nab", "banana"]
    grams = Counter(("\x02" * 4 + w + "\x03")[i:i + 5] for w in words for i in range(len(w) + 1))
    m = op5_langid.KneserNey(["x"], {"x": grams})
    level = {5: dict(grams)}
    for n in (4, 3, 2, 1):
        level[n] = Counter(g[1:] for g in level[n + 1])
    size = len({c for g in grams for c in g}) + 1

    def p(gram):
        if not gram:
            return 1 / size
        cur = level[len(gram)]
        ones, twos = (sum(v == k for v in cur.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        beside = {g: v for g, v in cur.items() if g[:-1] == gram[:-1]}
        if not beside:
            return p(gram[1:])
        total = sum(beside.values())
        return max(beside.get(gram, 0) - d, 0) / total + d * len(beside) / total * p(gram[1:])

    for w in ("banana", "nanab", "zzz", "b"):
        want = sum(math.log(p(("\x02" * 4 + w + "\x03")[i:i + 5])) for i in range(len(w) + 1))
        assert m.words([w])[0, 0] == pytest.approx(want)


def test_language_sample_is_bounded_and_one_a_document(spark):
    rows = [(i, f"t{i}", "en") for i in range(3000)] + [(i, "z", "de") for i in range(40)] + [(7, "copy", "en")] * 500 + [(None, "n", "en")] * 50
    got = op5_langid._sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 100, 50).toPandas()
    en = got[got.lang == "en"]
    assert len(en) == 150 and en.doc_id.nunique() == 150 and en["__more"].sum() == 50 and (got.lang == "de").sum() == 40


def test_simhash_equals_brute_force(spark):
    got = op6.op6_simhash(spark, SF).toPandas()
    fp = [int(x, 16) for x in got.fingerprint]
    root = list(range(len(fp)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    low: dict = {}
    for i, d in enumerate(got.doc_id):
        low[find(i)] = min(low.get(find(i), d), d)
    assert [low[find(i)] for i in range(len(fp))] == got.component_id.tolist()


def test_split_shards_lose_no_link(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(5)]
    values = sorted({b ^ (1 << rng.randrange(60)) for b in base for _ in range(25)})
    df = spark.createDataFrame([(v, [v]) for v in values], "id long, w array<long>")
    from palisade.llm.components import components
    from pyspark.sql import functions as F

    def groups(tree):
        return {r["node"]: r["root"] for r in components(op6.links(df, op6._blocks(F.col("id"), 3), 3, 1, tree)).collect()}

    assert groups(4) == groups(2048) and len(groups(4)) == len(values)


def test_forest_recall_and_scores(spark):
    """Recall against brute force, of queries divisible by 50, which look at a part of the rows only."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((10_000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).astype(float)
    e = pd.DataFrame({"vec_id": np.arange(10_000), "embedding": [v.tolist() for v in x]})
    table = spark.createDataFrame(e, "vec_id long, embedding array<float>")
    got = op7_forest.neighbours(op7_forest.index(table), table.where("vec_id % 50 = 0")).toPandas()
    hits = []
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[e.vec_id == q][0]) ** 2).sum(axis=1))
        at = dict(zip(e.vec_id, d))
        d[(e.vec_id == q).to_numpy()] = np.inf
        hits.append(len(set(e.vec_id.to_numpy()[np.lexsort((e.vec_id, d))[:10]]) & set(g.vec_id)) / 10)
        assert np.allclose(g.score, [at[v] for v in g.vec_id], rtol=0, atol=1e-12)
    assert len(e) >= 10_000 and len(hits) == (e.vec_id % 50 == 0).sum() and np.mean(hits) >= 0.9
    forest = op7_forest.Forest(e.vec_id.to_numpy(), x)
    assert forest.search(x[:200], e.vec_id.to_numpy()[:200])[1] < 0.3 * 200 * len(x)


def test_forest_descent_and_stored_index():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 20))
    x[50:60] = x[7]
    f = op7_forest.Forest(np.arange(400), x, 8)
    g = op7_forest.Forest.load(20, len(f.x), f.dump(), 8)
    assert all((getattr(f, n) == getattr(g, n)).all() for n in ("x", "order", "sorted", "mean"))
    codes = np.stack([op7_forest.strings((x[:30] - f.mean).astype(np.float32), t) for t in range(8)])
    near = np.stack([op7_forest.strings((x[:30] + 0.3 - f.mean).astype(np.float32), t) for t in range(8)])
    assert (f.descend(codes) == op7_forest.SYMBOLS).all()

    def shared(a, b):
        return next((k for k in range(op7_forest.SYMBOLS) if a >> 5 * (op7_forest.SYMBOLS - 1 - k) != b >> 5 * (op7_forest.SYMBOLS - 1 - k)), op7_forest.SYMBOLS)

    for t in range(8):
        assert f.descend(near)[t].tolist() == [max(shared(int(c), int(s)) for s in f.sorted[t]) for c in near[t]]
    assert {v for _, v in f.search(x[7:8], np.array([7]))[0][0]} == set(range(50, 60))


def test_lm_base_scores_and_gain(spark):
    sf = "/root/testdata/sf0.01"
    got = op8_lm.op8_lm(spark, sf).toPandas().set_index("doc_id")
    docs = pq.read_table(f"{sf}/documents.parquet").to_pandas()
    c = Counter(t for i, x in zip(docs.doc_id, docs.text) if zlib.crc32(str(i).encode()) % 10 for t in op8_lm.tokens(x))
    n, v = sum(c.values()), len(c)
    for i, x in zip(docs.doc_id, docs.text):
        w = op8_lm.tokens(x)
        r = got.loc[i]
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w), rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[t] > 0 for t in w), n)
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum() + 0.05 * out.n_tokens.sum()  # the model gains on unseen documents


def _lm_pieces(seed=0):
    rng = np.random.default_rng(seed)
    s = op8_lm.CLASSES * op8_lm.PER_CLASS
    flat = op8_lm.GRU.initial(rng.random(s) + 0.1)
    flat += rng.standard_normal(len(flat)).astype(np.float32) * 0.2
    return op8_lm.GRU(flat), [rng.integers(0, s, n) for n in (5, 9, 1, 0, 9, 3)]


def test_lm_scores_equal_a_plain_recurrence():
    model, docs = _lm_pieces()
    p, k = {n: v.astype(float) for n, v in model.parts.items()}, op8_lm.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))
    want = []
    for d in docs:
        h, prev, total = np.zeros(k), 7, 0.0
        for s in d:
            x, hp = p["x"][prev], h @ p["h"]
            z, r = sig(x[:k] + hp[:k]), sig(x[k:2 * k] + hp[k:2 * k])
            n = np.tanh(x[2 * k:] + r * hp[2 * k:])
            h = (1 - z) * n + z * h
            a, c = h @ p["uc"] + p["bc"], s // op8_lm.PER_CLASS
            b = h @ p["uw"][c] + p["bw"][c]
            total += a[c] - np.log(np.exp(a).sum()) + b[s % op8_lm.PER_CLASS] - np.log(np.exp(b).sum())
            prev = s
        want.append(total)
    assert model.score(docs, 7) == pytest.approx(want, rel=1e-4)


def test_lm_gradient_equals_finite_differences():
    model, docs = _lm_pieces(1)
    packed = op8_lm.Packed(docs, 7)
    zero = np.zeros((len(docs), op8_lm.HIDDEN), np.float32)
    grad, _ = model.gradient(packed, 0, packed.steps, zero)
    rng = np.random.default_rng(2)
    for _ in range(5):
        way = rng.standard_normal(model.size).astype(np.float32)
        up, down = (op8_lm.GRU(model.flat[:model.size] + e * way).score(docs, 7).sum() for e in (1e-2, -1e-2))
        assert -(up - down) / 2e-2 / len(packed.symbols) == pytest.approx(float(grad @ way), rel=0.03, abs=0.02)


def test_toxicity_restores_and_tells_apart(spark):
    got = op9_toxicity.op9_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    lab = pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pandas()
    m = got.merge(lab, on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m.toxic).mean() > 0.95
    lm = op9_toxicity.CharModel(Counter(["idiot", "loser", "the", "word", "trash"] * 3))
    assert [op9_toxicity.restore(w, lm)[0] for w in ("1d10t", "l0s3r", "iiidiot", "tr@sh!!")] == ["idiot", "loser", "idiot", "trash"]
    assert op9_toxicity.unspaced("an i d i o t here") == ["idiot"]


def test_pieces_equal_library_and_cover_the_text(spark):
    e = op10_pieces.encoder(op10_pieces._path())
    docs = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    got = op10_pieces.op10_pieces(spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        ids = e.sp.encode(t)
        assert got.loc[i, "ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got.loc[i, "decoded_sha256"] == hashlib.sha256(e.sp.decode(ids).encode()).hexdigest()
    for t in ("a  b ", "日本語 😀 x", "\n", " é"):
        a, b = e.spans(t, e.sp.encode(t))
        assert a[0] == 0 and b[-1] == len(t.encode()) and (a[1:] == b[:-1]).all()


def test_normaliser_equals_library_on_a_compiled_map():
    """The library's own map of its default rule: normalised text and the place of every character's source."""
    import sentencepiece

    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    own = op10_pieces.Normaliser.of_model(lib.serialized_model_proto())
    assert len(own.units)
    rng = random.Random(6)
    texts = ["".join(rng.choice("aB ＡＢ½éﬁ　\u0301\u200b\t\n①ｶﾞ㌀Ⅷ…ẛ̣日😀") for _ in range(rng.randint(1, 20))) for _ in range(600)]
    for t in texts:
        want, places = lib.normalize(t, with_offsets=True)
        out, lo, hi = own(t)
        assert out.decode() == want, repr(t)
        if want:
            at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in t])]).tolist()
            first = np.cumsum([0, *[len(c.encode()) for c in want]])[:-1]
            assert [at.index(int(v)) for v in lo[first]][1:] == places[1:len(want)], repr(t)
            assert (lo <= hi).all()


def test_piece_spans_equal_library_offsets():
    e = op10_pieces.encoder(op10_pieces._path())
    rng = random.Random(8)
    for _ in range(800):
        t = "".join(rng.choice("ab é日.  \nthe of") for _ in range(rng.randint(1, 30)))
        pieces = e.sp.encode(t, out_type="proto").pieces
        a, b = e.spans(t, [p.id for p in pieces])
        plain = ~e.byte[[p.id for p in pieces]]
        assert (a[plain] == np.array([p.begin for p in pieces])[plain]).all() and (b[plain] == np.array([p.end for p in pieces])[plain]).all(), repr(t)
    e2 = op10_pieces.Encoder.__new__(op10_pieces.Encoder)
    e2.__dict__.update(e.__dict__)
    e2.size = e.size + 1  # as if pieces left open what they cover
    assert e2.spans("ab ab", e.sp.encode("ab ab"))[1][-1] == 5


def test_normaliser_longest_prefix():
    """A hand-made double array: "a" -> "x", "ab" -> "yz"."""
    units = np.zeros(512, np.uint32)
    root, blob = 0, b"x\0yz\0"

    def unit(label, offset, leaf):
        return label | (leaf << 8) | (offset << 10)

    units[root] = 1 << 10  # offset 1
    at_a = root ^ 1 ^ ord("a")
    off_a = 200
    units[at_a] = unit(ord("a"), off_a, 1)
    units[at_a ^ off_a] = 0 | (1 << 31)  # value 0: "x"
    at_b = at_a ^ off_a ^ ord("b")
    off_b = 150
    units[at_b] = unit(ord("b"), off_b, 1)
    units[at_b ^ off_b] = 2 | (1 << 31)  # value 2: "yz"
    n = op10_pieces.Normaliser((len(units) * 4).to_bytes(4, "little") + units.tobytes() + blob, dummy_prefix=False, escape=False)
    out, lo, hi = n("caabc")
    assert out == b"cxyzc" and lo.tolist() == [0, 1, 2, 2, 4] and hi.tolist() == [1, 2, 4, 4, 5]


def test_stage_keeps_one_of_each_group(spark, tmp_path):
    a, b = prose(1, 200), prose(2, 200)
    near = a.replace(a.split()[50], "changed", 1)
    sf = write(tmp_path, [(5, a, "en"), (2, near, "en"), (9, a, "en"), (7, b, "en"), (7, b, "en"), (8, prose(3, 200), "en")])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op6.drop_near_duplicates(spark, docs, sf)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [2, 7, 8]


def _jaccard(a, b):
    x, y = (set(op6.shingle_hashes(t, op6.STAGE_SHINGLE).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_stage_links_by_exact_similarity(spark, tmp_path):
    """Pairs just above 0.8 are all found, pairs just below are all kept, and chains do not tie what is below."""
    docs, want = [], set()
    for k in range(120):
        a = prose(1000 + k, 220).split()
        tail = prose(5000 + k, 80).split()
        near = next(a[:-m] + tail[:m] for m in range(40, 0, -1) if (_jaccard(" ".join(a), " ".join(a[:-m] + tail[:m])) >= 0.8) == (k % 2 == 0) and (k % 2 == 0 or _jaccard(" ".join(a), " ".join(a[:-m + 1] + tail[:m - 1])) >= 0.8))
        j = _jaccard(" ".join(a), " ".join(near))
        assert 0.79 < j < 0.82 and (j >= 0.8) == (k % 2 == 0)
        docs += [(2 * k, " ".join(a), "en"), (2 * k + 1, " ".join(near), "en")]
        want |= {2 * k} | ({2 * k + 1} if k % 2 else set())
    sf = write(tmp_path, docs)
    got = op6.drop_near_duplicates(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert {r["doc_id"] for r in got.collect()} == want


def test_toxicity_restores_spaced_lookalikes_and_several_words():
    lm = op9_toxicity.CharModel(Counter(["idiot", "stupid", "you", "are", "the", "a", "word", "trash"] * 3))
    cases = {
        "i d ! o t": ["idiot"], "$ t u p i d": ["stupid"], "so $ t u p ! d, he": ["stupid"], "(s t * p i d)": ["stupid"], "s*t*u*p*i*d": ["stupid"], "s  t  u  p  i  d": ["stupid"],
        "y o u s t u p i d i d i o t": ["you", "stupid", "idiot"], "y o u   a r e   a   1 d 1 0 t": ["you", "are", "a", "idiot"], "| - | - | - |": [], "1 2 3 4 5": []}
    assert {t: op9_toxicity.unspaced(t, lm) for t in cases} == cases
    assert op9_toxicity.unspaced("y o u s t u p i d i d i o t " * 4, lm) == ["you", "stupid", "idiot"] * 4
    assert "idiot" in op9_toxicity.restore("idi" + "o" * 60 + "t", lm)
    assert {"stupid", "idiot"} <= set(op9_toxicity.restore("youstupididiot" * 4 + "th3tr@sh", lm))
    assert "idiot" in op9_toxicity.restore("the-word-you-are-the-trash-word-the-1d10t-word", lm)
    blob = hashlib.sha512(b"x").hexdigest()
    assert op9_toxicity.restore(blob, lm) == [blob]
    s = op9_toxicity.Scorer(op9_toxicity.Model(lm, {"=stupid": 4.0, "=idiot": 5.0}, (0.0, 1.0, 0.0)))
    assert s.evidence("y o u $ t u p i d ! d i o t") == 9.0


def test_langid_rejects_unlearned_languages_and_random_letters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    score = op5_langid.Scorer(op5_langid.train(op5_langid.training_rows(docs).where("lang <> 'fr'")))
    d = pq.read_table("/root/testdata/sf0.1/documents.parquet").to_pandas()
    d = d[[zlib.crc32(str(i).encode()) % 4 == 2 for i in d.doc_id]]
    other, own = d[d.lang == "fr"].text[:200].tolist(), d[d.lang != "fr"].text[:300].tolist()
    rng = random.Random(3)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(k)) for k in (2, 5, 20, 200) for _ in range(10)]
    assert np.mean(score(other)[3]) > 0.95 and np.mean(score(noise)[3]) == 1
    assert np.mean(score(own)[3]) < 0.01 and np.mean(score([t[:80] for t in own])[3]) < 0.02


def test_license_fuzzy_equals_brute_force():
    """Notices with an occurrence within their budget, by plain dynamic programming over the whole text."""
    scan = op4_license.Scanner()
    rng = random.Random(12)

    def within(pattern, text, k):
        prev = [0] * (len(text) + 1)
        for i, c in enumerate(pattern, 1):
            cur = [i] + [0] * len(text)
            for j, d in enumerate(text, 1):
                cur[j] = min(prev[j - 1] + (c != d), prev[j] + 1, cur[j - 1] + 1)
            prev = cur
        return min(prev) <= k

    alone = 0
    for _ in range(60):
        notice = list(rng.choice(list(op4_license.NOTICES)))
        for _ in range(rng.randrange(9)):
            i = rng.randrange(len(notice))
            notice[i:i + 1] = rng.choice(["", "q", notice[i] + "z"])
        norm, _ = op4_license.normalise(prose(rng.randrange(99), 8) + " " + "".join(notice) + " " + prose(rng.randrange(99), 8))
        want = {n for n in op4_license.NOTICES if within(n, norm, op4_license.budget(n))}
        spans = scan.fuzzy(norm)
        assert {s[2] for s in spans} <= want and bool(spans) == bool(want)
        if len(want) == 1:  # of overlapping spans the one of fewest edits stands, so only a lone notice must be the one
            alone += 1
            assert {s[2] for s in spans} == want
        assert all(within(n, norm[a:b], e) for a, b, n, e in spans)
    assert alone > 20


def test_viterbi_equals_enumeration():
    """Of all letters that a lattice allows the likeliest under the character model and the channel's costs."""
    import itertools

    lm = op9_toxicity.CharModel(Counter(["idiot", "trash", "the", "loser"] * 3))
    for token in ("1d10t", "tr@sh", "l0$er", "th3", "!d!ot"):
        options = [[(x, -1.0) for x in op9_toxicity.LEET[c]] + [("", -9.0)] if c in op9_toxicity.LEET else [(c, 0.0)] for c in token]
        best = max(itertools.product(*options), key=lambda w: sum(c for _, c in w) + sum(lm.logp(p[i - 2:i], p[i]) for p in ["^^" + "".join(x for x, _ in w) + "$"] for i in range(2, len(p))))
        assert op9_toxicity.viterbi(token, lm) == "".join(x for x, _ in best)


def test_toxicity_training_counts_near_copies_once():
    def row(k, fam, toxic=1):
        return {"k": k, "toxic": toxic, "fam": fam}

    base = list(range(8))
    rows = [row(1, base), row(2, [0, 1, 2, 3, 4, 50, 60, 70]), row(3, [0, 10, 20, 30, 40, 50, 60, 70]), row(4, base, 0), row(5, [9, 10, 20, 30, 40, 50, 60, 71])]
    assert op9_toxicity._distinct(rows) == [1, 3, 4]


def test_license_finds_every_place_of_a_merged_window():
    scan = op4_license.Scanner()
    for words in ("licensed undr cc by nc 4 0 licensed under cc by nc 4 0", "licensed under cc by nc 4 0 licensed undr cc by nc 4 0", "licensed undr cc by nc 4 0 licensd under cc by nc 4 0 licensed under cc by nc 4 0 licensed unde cc by nc 4 0"):
        spans = [s for s in scan.fuzzy(op4_license.normalise(words)[0]) if s[2] == "licensed under cc by nc 4 0"]
        assert len(spans) == words.count("cc by nc") and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_lm_frequent_tokens_have_their_own_symbols():
    top = [(b"t%d" % i, 1000 - i) for i in range(512)]
    buckets: dict = {}
    for t, c in top:
        n, v = buckets.get(op8_lm.bucket(t), (0, 0))
        buckets[op8_lm.bucket(t)] = (n + c, v + 1)
    vocab = op8_lm.Vocabulary(top, sum(c for _, c in top), len(top), buckets)
    sym = vocab.symbols([t for t, _ in top])[0]
    assert len(set(sym.tolist())) == 512 and not set(sym.tolist()) & set(vocab.bucket_symbol.tolist())
