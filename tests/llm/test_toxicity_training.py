"""Training of operator 9 on all labelled documents."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.llm import op9_toxicity as op9

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(8))


@pytest.fixture(scope="module")
def tables(spark):
    """6,500 documents a class; 300 toxic ones hold a word of their own, the last by the hash of the id."""
    ids = spark.range(13000).orderBy(F.xxhash64("id"), "id").toPandas().id.tolist()
    toxic = [i for i in ids if i % 2]
    late = set(toxic[-300:])
    docs = [(i, prose(i) + (" zorgle" if i in late else " idiot" if i % 2 else "")) for i in ids]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")


def test_all_labelled_documents_train(spark, tables):
    docs, labels = tables
    model = op9.train(docs, labels)
    assert {"=idiot", "=zorgle"} <= set(model.weights)
    shuffled = op9.train(docs, labels, broadcast=0)
    assert shuffled.weights == pytest.approx(model.weights) and shuffled.coef == pytest.approx(model.coef, abs=1e-5)


def test_copies_are_those_of_a_plain_loop(spark):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        fam = [rng.randrange(3) for _ in range(8)] if k % 2 or k < 50 else list(rows[rng.randrange(len(rows))][3])
        for _ in range(rng.randrange(4)):
            fam[rng.randrange(8)] = 1000 + rng.randrange(500)
        rows.append((k, k * 7919 % 401, k % 3 // 2, fam))
    rows += [(400 + i, r[1], r[2], r[3]) for i, r in enumerate(rows[:30])]  # the same texts again
    df = spark.createDataFrame(rows, "rid long, k long, toxic int, fam array<long>")
    gone = {r["rid"] for r in op9.copies(df).collect()}
    assert all(r[0] in gone for r in rows[400:])
    want = op9._distinct([{"k": r[1], "toxic": r[2], "fam": r[3]} for r in rows[:400]])
    assert sorted(r[1] for r in rows if r[0] not in gone) == want and 50 < len(want) < 350


def test_curve_is_at_the_likelihoods_top(spark):
    z = [(0.0, 0, 90), (0.0, 1, 4), (3.0, 0, 3), (3.0, 1, 9), (9.0, 1, 20), (9.0, 0, 1)]
    w = op9._logistic(spark.createDataFrame(z, "z double, toxic int, n long"))

    def loss(w):
        import math
        out = 0.025 * sum(v * v for v in w)
        for x, y, n in z:
            m = w[0] + w[1] * math.log1p(x) + w[2] * (x > 0)
            out += n * math.log1p(math.exp(-m if y else m))
        return out

    for i in range(3):
        for e in (-0.01, 0.01):
            assert loss([v + e * (i == j) for j, v in enumerate(w)]) > loss(w)


def test_plain_tokens_have_one_reading():
    lm = op9.CharModel({"idiot": 3, "trash": 3, "the": 3})
    for token in ("idiot", "idiot,", "(trash)", "\"the\"", "naïve"):
        assert set(op9.restore(token, lm)) == {op9.plain(token)}
    assert [op9.plain(t) for t in ("1diot", "iiidiot", "$hit", "tr@sh", "", "...", "a" * 41)] == [None] * 7


def test_what_is_spaced_passes_the_first_look():
    rng, found = random.Random(3), 0
    for _ in range(20_000):
        text = "".join(rng.choice("aé1!*_.- \n\t#") if rng.random() < 0.9 else "ab" for _ in range(14))
        if op9._SPACED.search(text):
            found += 1
            assert op9._INNER.search(text)
    assert found > 100
