"""Toxicity with noisy-channel deobfuscation.

Tokens that carry an obfuscation mark (leet characters between letters, letters repeated three times or more, words
spaced out letter by letter) become a lattice of possible letters, decoded by Viterbi under a character trigram
model of ordinary words. Runs of spaced-out letters and glued tokens beyond MAX_TOKEN are decoded into several words,
by Viterbi over word boundaries under the words' frequencies. The restored words are scored: word and word-prefix weights (log-odds of documents that
hold them) found significant on labelled documents, their distinct sum put through a fitted logistic curve.
All labelled documents train: counts, weights and the curve's sums are Spark aggregations over them; only the models
(ordinary words, significant features, three coefficients) reach the driver.

Edge cases: null text counts as empty and gets the score of a text without any weighted word; repeated rows score
alike; tokens beyond MAX_TOKEN characters are decoded part by part, with parts still longer split into words unless
they are unlike words; without labelled rows of both classes every score is the base
rate. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import filter_texts, fold, held, map_texts, steps
from palisade.session import cut, drop_cut

#: A word is ordinary that two training documents hold, and one of so many. Words that are rarer teach no spelling.
ORDINARY = 6000
#: Evidence (G statistic) and log-odds from which a word or prefix counts.
MIN_G, MIN_LLR = 25.0, 3.0
PREFIXES = (3, 4, 5, 6)
MAX_TOKEN = 40
#: Log-probability of a letter outside known words, and of a letter from which a long token counts as words; readings kept.
OTHER, LIKE_WORDS, BEAM = -10.0, -3.0, 64
CACHE = 400_000
#: Transitions of the character model, and features or words of a training task, that a worker holds at once.
STEPS_HELD, COUNTS_HELD = 500_000, 200_000
#: Labels, or near copies that don't count, up to which they are broadcast; beyond, texts are shuffled to them.
BROADCAST = 1_000_000
#: Odd multipliers, each a mixing of shingle hashes; documents sharing the smallest hash under most of them count once in training.
FAMILIES = tuple(2 * k * 0x9E3779B97F4A7C15 % (1 << 64) | 1 for k in range(1, 9))
THRESHOLD = 0.3

# Common look-alikes of letters.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
WILD = "*#%"
_MARK = re.compile(r"[^\W\d_][0-9@$!|+(€£*#%]+[^\W\d_]|^[0-9@$!|+(€£]+[^\W\d_]|[^\W\d_][0-9@$|+€£]+$|([^\W\d_])\1\1|[^\W\d_][.\-_][^\W\d_]")
# Single letters, digits or look-alikes apart; wider gaps than the run's narrowest part words.
_UNIT, _GAP = r"[^\W_@$!|+(€£*#%]|[@$!|+(€£*#%]", r"[\s.\-_]{1,3}|\*"
_SPACED = re.compile(rf"(?<![\w'’@$!|+€£#%])(?:{_UNIT})(?:(?:{_GAP})(?:{_UNIT})(?![^\W_])){{3,}}")
_SPACED_PART = re.compile(rf"((?:{_GAP})?)({_UNIT})")
_DRAWN = re.compile(r"(.)\1{3,}", re.S)
_APART = re.compile(r"[^\w@$!|+(€£*#%]+|_+")
_PUNCT = ".,;:?\"'()"
_THRICE = re.compile(r"(.)\1\1")
# Whatever _SPACED finds holds this: its second and third unit between gaps.
_INNER = re.compile(r"[\s.\-_*]\S[\s.\-_*]{1,3}\S[\s.\-_*]")
_EDGE = ".,;:!?\"'()[]{}<>*#%&$|`~-_=+/\\"
_WORD = re.compile(r"[^\W\d_]+")


class CharModel:
    """Character trigrams with add-k smoothing and back-off weights fixed by interpolation."""

    def __init__(self, words: dict[str, int]):
        tri: dict[str, int] = {}
        bi: dict[str, int] = {}
        uni: dict[str, int] = {}
        for w, c in words.items():
            p = "^^" + w + "$"
            for i in range(2, len(p)):
                tri[p[i - 2:i + 1]] = tri.get(p[i - 2:i + 1], 0) + c
                bi[p[i - 1:i + 1]] = bi.get(p[i - 1:i + 1], 0) + c
                uni[p[i]] = uni.get(p[i], 0) + c
        self.tri, self.bi, self.uni = tri, bi, uni
        self.tri_n: dict[str, int] = {}
        self.bi_n: dict[str, int] = {}
        for g, c in tri.items():
            self.tri_n[g[:2]] = self.tri_n.get(g[:2], 0) + c
        for g, c in bi.items():
            self.bi_n[g[0]] = self.bi_n.get(g[0], 0) + c
        self.n = sum(uni.values()) or 1
        total = math.log(sum(words.values()) or 1)
        self.words = {w: math.log(c) - total for w, c in words.items()}
        self.sorted = sorted(self.words)
        self.letters = "".join(sorted(c for c in uni if c.isalpha()))
        self.steps: dict[str, float] = {}

    def begins(self, prefix: str) -> bool:
        """Whether some word begins so."""
        at = bisect.bisect_left(self.sorted, prefix)
        return at < len(self.sorted) and self.sorted[at].startswith(prefix)

    def logp(self, two: str, c: str) -> float:
        got = self.steps.get(two + c)
        if got is None:
            if len(self.steps) >= STEPS_HELD:
                self.steps.clear()
            got = self.steps[two + c] = self._logp(two, c)
        return got

    def _logp(self, two: str, c: str) -> float:
        p = 0.7 * self.tri.get(two + c, 0) / self.tri_n.get(two, 1) + 0.25 * self.bi.get(two[1] + c, 0) / self.bi_n.get(two[1], 1)
        return math.log(p + 0.05 * (self.uni.get(c, 0) + 0.5) / (self.n + 50))


def viterbi(token: str, lm: CharModel) -> str:
    """The likeliest plain word behind a token: look-alikes, wildcards, separators and repetitions are the channel."""
    letters = lm.letters
    states: dict[tuple[str, str], tuple[float, str]] = {("^^", ""): (0.0, "")}
    for at, c in enumerate(token):
        run = c * 3 in token[max(0, at - 2):at + 3]
        if c.isalpha():
            options = [(c, 0.0)]
        elif c in LEET:
            options = [(x, -1.0) for x in LEET[c]] + [("", -9.0)]
        elif c in WILD:
            options = [(x, -3.0) for x in letters] + [("", -3.0)]
        else:
            options = [("", -0.5)]
        new: dict[tuple[str, str], tuple[float, str]] = {}
        for (two, last), (lp, out) in states.items():
            for x, cost in options:
                if x == "":
                    cand, key = (lp + cost, out), (two, last)
                else:
                    cand, key = (lp + cost + lm.logp(two, x), out + x), (two[1] + x, x)
                if key not in new or cand[0] > new[key][0]:
                    new[key] = cand
                if run and x and x == last:  # a letter drawn out
                    rep = (lp + cost - 0.7, out)
                    if (two, last) not in new or rep[0] > new[(two, last)][0]:
                        new[(two, last)] = rep
        states = new
    return max(((lp + lm.logp(two, "$"), out) for (two, _), (lp, out) in states.items()), default=(0.0, ""))[1]


def segment(run: str, lm: CharModel) -> tuple[float, list[str]]:
    """The likeliest words behind a run without gaps, and their log-probability; what is no known word stays together."""
    letters = lm.letters
    best: list[tuple] = [(0.0, 0, "", True)] + [(-math.inf, 0, "", False)] * len(run)  # score, start, word, known
    for i in range(len(run)):
        score = best[i][0]
        if score + OTHER > best[i + 1][0]:
            best[i + 1] = (score + OTHER, i, run[i], False)
        states = {"": 0.0}
        for j in range(i, len(run)):
            c = run[j]
            drawn = c * 3 in run[max(0, j - 2):j + 3]
            if c in LEET:
                options = [(x, -1.0) for x in LEET[c]] + [("", -9.0)]
            elif c in WILD:
                options = [(x, -3.0) for x in letters] + [("", -3.0)]
            else:
                options = [(c, 0.0)] if c.isalpha() else [("", -0.5)]
            new: dict[str, float] = {}
            for prefix, lp in states.items():
                for x, cost in options:
                    if x and drawn and prefix.endswith(x):  # a letter drawn out
                        new[prefix] = max(new.get(prefix, -math.inf), lp + cost - 0.7)
                    word = prefix + x
                    if lp + cost > new.get(word, -math.inf) and (not x or lm.begins(word)):
                        new[word] = lp + cost
            if len(new) > BEAM:
                new = dict(sorted(new.items(), key=lambda s: (-s[1], s[0]))[:BEAM])
            states = new
            if not states or max(states, key=len) == "" and j - i > 2:
                break
            for word, lp in states.items():
                if word in lm.words and score + lp + lm.words[word] > best[j + 1][0]:
                    best[j + 1] = (score + lp + lm.words[word], i, word, True)
    out: list[tuple[str, bool]] = []
    at = len(run)
    while at:
        _, start, word, known = best[at]
        if not known and out and not out[-1][1]:
            out[-1] = (word + out[-1][0], False)
        else:
            out.append((word, known))
        at = start
    return best[-1][0], [w if known or len(w) > MAX_TOKEN or w.isalpha() else viterbi(w, lm) for w, known in reversed(out)]


def _part(token: str, lm: CharModel) -> list[str]:
    core = token.strip(_EDGE)
    return [viterbi(part, lm) if _MARK.search(part) else part for part in dict.fromkeys((core, token.strip(_PUNCT)))]


def plain(token: str) -> str | None:
    """The word of a token without any mark, of which it is the only reading."""
    core = token.strip(_EDGE)
    return core if core.isalpha() and len(token) <= MAX_TOKEN and (core == token or token.strip(_PUNCT) == core) and not _THRICE.search(core) else None


def restore(token: str, lm: CharModel) -> list[str]:
    """A token's readings: with its edges stripped and with edge look-alikes kept, each decoded if marked.

    Of a token beyond MAX_TOKEN: itself and the readings of its parts, letters drawn out shortened.
    """
    core = token.strip(_EDGE)
    if not core:
        return [core]
    if len(token) <= MAX_TOKEN:
        return _part(token, lm)
    short = _DRAWN.sub(r"\1\1\1", token)
    if len(short) <= MAX_TOKEN:
        return [core, *_part(short, lm)]
    out = [core]
    for part in dict.fromkeys(_APART.split(short)):
        if len(part) <= MAX_TOKEN:
            out += _part(part, lm) if part else []
        else:
            lp, words = segment(part, lm)
            out += words if lp >= LIKE_WORDS * len(part) else []
    return out


def unspaced(text: str, lm: CharModel | None = None) -> list[str]:
    """Words spelled with single letters apart, joined; with lm their look-alikes are decoded and several words told apart."""
    out: list[str] = []
    if not _INNER.search(text):
        return out
    for m in _SPACED.finditer(text):
        units = _SPACED_PART.findall(m.group(0))
        narrow, runs = min(len(g) for g, _ in units[1:]), [""]
        for k, (gap, c) in enumerate(units):
            if k and len(gap) > narrow:
                runs.append("")
            runs[-1] += c
        for run in runs:
            if any(c.isalpha() for c in run):
                out += [run] if lm is None else segment(_DRAWN.sub(r"\1\1\1", run), lm)[1]
    return out


class Model:
    def __init__(self, lm: CharModel, weights: dict[str, float], coef: tuple[float, float, float]):
        self.lm, self.weights, self.coef, self.key = lm, weights, coef, uuid.uuid4().hex


class Scorer:
    def __init__(self, model: Model):
        self.model, self.cache, self.heavy = model, {}, set()
        self.whole = {f[1:]: w for f, w in model.weights.items() if f[0] == "="}
        begun = {f[1:]: w for f, w in model.weights.items() if f[0] == "^"}
        self.begun = [(n, own) for n in PREFIXES if (own := {f: w for f, w in begun.items() if len(f) == n})]

        self.starts = {f[1:4] for f in model.weights}  # of all weighted words and prefixes

    def words(self, token: str) -> list[str]:
        word = plain(token)
        return [word] if word else [w for r in restore(token, self.model.lm) for w in _WORD.findall(r)]

    def features(self, token: str) -> set[str]:
        return {f for w in self.words(token) for f in ("=" + w, *["^" + w[:n] for n in PREFIXES if len(w) > n])}

    def weight(self, token: str) -> float:
        """The largest weight of a token's features, 0 at least."""
        best = 0.0
        for w in self.words(token):
            if w[:3] not in self.starts:
                continue
            best = max(best, self.whole.get(w, 0.0))
            for n, own in self.begun:
                if len(w) > n:
                    best = max(best, own.get(w[:n], 0.0))
        self.cache[token] = best
        if best:
            self.heavy.add(token)
        return best

    def evidence(self, text: str) -> float:
        """Sum of the weights of the distinct restored words."""
        if len(self.cache) > CACHE:
            self.cache.clear()
            self.heavy.clear()
        low = text.lower()
        tokens = {*low.split(), *unspaced(low, self.model.lm)}
        for t in tokens.difference(self.cache):
            self.weight(t)
        return math.fsum(self.cache[t] for t in tokens & self.heavy)

    def __call__(self, texts: list[str]) -> list:
        z = np.array([self.evidence(t) for t in texts], float)
        a, b, c = self.model.coef
        s = 1 / (1 + np.exp(-(a + b * np.log1p(z) + c * (z > 0))))
        return [s, (s >= THRESHOLD).astype(np.int32), z]


def _scorer(ref) -> Scorer:
    return held(("toxicity", ref.value.key), lambda: Scorer(ref.value))


def _families(text: str) -> list[int]:
    """Smallest hashes of the three-word shingles under FAMILIES mixings: near copies share most of them."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.array([xxhash.xxh64_intdigest(b" ".join(w[i:i + 3])) for i in range(max(1, len(w) - 2))], np.uint64)
    with np.errstate(over="ignore"):
        return [int((h * np.uint64(m)).min() >> np.uint64(1)) for m in FAMILIES]


def _distinct(rows: list) -> list[int]:
    """Keys of rows (k, toxic, fam) without an earlier one of their class that agrees in most smallest hashes: copies()
    of a few rows, by a plain loop."""
    rows = sorted(rows, key=lambda r: r["k"])
    alike = lambda a, b: a["toxic"] == b["toxic"] and 2 * sum(x == y for x, y in zip(a["fam"], b["fam"])) > len(FAMILIES)
    return [r["k"] for i, r in enumerate(rows) if not any(alike(r, q) for q in rows[:i])]


def copies(rows: DataFrame) -> DataFrame:
    """rid of the rows (rid, k, toxic, fam) that agree in most smallest hashes with an earlier one, by k, of their class.

    Two rows agree in most hashes if they share one of the sets of that many, so rows meet by such a set and all but its
    first go: linear in the rows, whatever the size of a family. Equal families are one row before that.
    """
    most = len(FAMILIES) // 2 + 1
    o = F.struct("k", "rid")
    first = rows.groupBy("toxic", "fam").agg(F.min(o).alias("o"))
    same = rows.join(first, ["toxic", "fam"]).where(o > F.col("o")).select("rid")
    sets = [F.xxhash64(F.lit(i), "toxic", *[F.col("fam")[j] for j in own]) for i, own in enumerate(itertools.combinations(range(len(FAMILIES)), most))]
    keys = first.select("o", F.explode(F.array(*sets)).alias("h"))
    shared = keys.groupBy("h").agg(F.min("o").alias("m"), F.count("*").alias("n")).where("n > 1").select("h", "m")
    near = keys.join(shared, "h").where("o > m").select(F.col("o.rid").alias("rid"))
    # all rows of a family go with its first
    near = rows.join(first, ["toxic", "fam"]).join(near.distinct().withColumnRenamed("rid", "gone"), F.col("o.rid") == F.col("gone"), "left_semi").select("rid")
    return same.unionByName(near).distinct()


def _small(df: DataFrame, most: int) -> DataFrame:
    """df to be broadcast, if it has so few rows."""
    return F.broadcast(df) if df.count() <= most else df


def _tallies(names: list[str], counts: list[dict]) -> pa.RecordBatch:
    keys = list(set().union(*counts))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([c.get(k, 0) for k in keys], pa.int64()) for c in counts]], names)


def _ordinary(batches):
    """Words of texts with the number of documents that hold them and of places."""
    docs, places = Counter(), Counter()
    for b in batches:
        for t in (t for _, _, texts in steps(b.column("text")) for t in texts):
            own = [w for w in (w.strip(_EDGE) for w in t.lower().split()) if w.isalpha()]
            places.update(own)
            docs.update(set(own))
            if len(docs) > COUNTS_HELD:
                yield _tallies(["w", "docs", "n"], [docs, places])
                docs, places = Counter(), Counter()
    yield _tallies(["w", "docs", "n"], [docs, places])


def _feature_counts(ref):
    def run(batches):
        s = Scorer(ref.value)
        cache: dict[str, tuple[str, ...]] = {}
        counts = [Counter(), Counter()]
        for b in batches:
            for t, y in zip((t for _, _, texts in steps(b.column("text")) for t in texts), b.column("toxic").to_pylist()):
                low = t.lower()
                tokens = {*low.split(), *unspaced(low, s.model.lm)}
                if len(cache) > COUNTS_HELD:
                    cache.clear()
                for tok in tokens.difference(cache):
                    cache[tok] = tuple(s.features(tok))
                counts[y == 0].update(set().union(*map(cache.__getitem__, tokens)))
                if len(counts[0]) + len(counts[1]) > 2 * COUNTS_HELD:
                    yield _tallies(["f", "pos", "neg"], counts)
                    counts = [Counter(), Counter()]
        yield _tallies(["f", "pos", "neg"], counts)

    return run


def train(docs: DataFrame, labels: DataFrame, broadcast: int = BROADCAST) -> Model:
    """Fit on all docs (doc_id, text) that labels (doc_id, toxic) marks. One document a family of copies counts."""
    spark = docs.sparkSession
    clean = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic in (0, 1)")
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(_small(clean, broadcast), "doc_id")
    rows = marked.select(F.monotonically_increasing_id().alias("rid"), F.xxhash64("text").alias("k"), "toxic", "text")
    labelled = cut(map_texts(rows, lambda: lambda texts: [[_families(t) for t in texts]], "fam array<long>", keep_text=True), "toxicity-labelled")
    again = cut(copies(labelled.select("rid", "k", "toxic", "fam")), "toxicity-copies")
    one = labelled.join(_small(again, broadcast), "rid", "left_anti").select("toxic", "text")
    sizes = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = float(sizes.get(1, 0)), float(sizes.get(0, 0))

    # ordinary words train the character model
    common = one.select("text").mapInArrow(_ordinary, "w string, docs long, n long").groupBy("w").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    common = common.where((F.col("docs") > 1) & (F.col("docs") * ORDINARY >= n1 + n0)).select("w", "n")
    lm = CharModel({r["w"]: r["n"] for r in common.toLocalIterator()})
    if not n1 or not n0:
        drop_cut(labelled)
        drop_cut(again)
        base = min(max((n1 + 0.5) / (n1 + n0 + 1), 1e-3), 1 - 1e-3)
        return Model(lm, {}, (math.log(base / (1 - base)), 0.0, 0.0))
    blank = spark.sparkContext.broadcast(Model(lm, {}, (0.0, 0.0, 0.0)))
    counts = one.mapInArrow(_feature_counts(blank), "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p = n1 / (n1 + n0)
    xlog = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    tot = F.col("pos") + F.col("neg")
    g = 2 * (xlog(F.col("pos"), tot * p) + xlog(F.col("neg"), tot * (1 - p)))
    llr = F.log((F.col("pos") + 0.5) / (n1 + 1)) - F.log((F.col("neg") + 0.5) / (n0 + 1))
    chosen = counts.withColumn("g", g).withColumn("llr", llr).where((F.col("g") >= MIN_G) & (F.col("llr") >= MIN_LLR))
    weights = {r["f"]: r["llr"] for r in chosen.select("f", "llr").collect()}  # features that enough documents bear out
    ref = spark.sparkContext.broadcast(Model(lm, weights, (0.0, 0.0, 0.0)))
    found = map_texts(one, lambda: _scorer(ref), "score double, predicted int, z double")
    coef = _logistic(cut(found.groupBy("z", "toxic").agg(F.count("*").alias("n")), "toxicity-evidence"))
    drop_cut(labelled)
    drop_cut(again)
    return Model(lm, weights, coef)


def _logistic(rows: DataFrame, ridge: float = 0.05) -> tuple[float, float, float]:
    """Ridge logistic regression on (1, log(1 + z), z > 0) over n rows of each (z, toxic), by Newton steps on their sums."""
    x = [F.lit(1.0), F.log1p("z"), (F.col("z") > 0).cast("double")]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + F.exp(-sum(float(v) * c for v, c in zip(w, x))))
        parts = rows.select("n", (F.col("toxic") - p).alias("e"), (p * (1 - p)).alias("v"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
        sums = parts.agg(*[F.sum(F.col("n") * F.col("e") * F.col(f"x{i}")) for i in range(3)], *[F.sum(F.col("n") * F.col("v") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).first()
        slope, curve = np.array(sums[:3]), np.zeros((3, 3))
        for (i, j), v in zip(pairs, sums[3:]):
            curve[i, j] = curve[j, i] = v
        step = np.linalg.solve(curve + ridge * np.eye(3), slope - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(round(float(v), 6) for v in w)  # sums in another order give the same curve


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs without text, with score, predicted and evidence."""
    ref = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda: _scorer(ref), "score double, predicted int, evidence double")


def _trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return train(docs.select("doc_id", "text").where(fold("doc_id", 4) != 2), labels.where(fold("doc_id", 4) != 2))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, _trained(spark, docs, sf_dir)).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "evidence")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go. Null and empty texts have no evidence and stay, repeated rows fare
    alike, all columns stay, whatever their names; without labels of both classes documents go by the base rate."""
    ref = spark.sparkContext.broadcast(_trained(spark, docs, sf_dir))
    return filter_texts(docs, lambda: _scorer(ref), "score double, predicted int, evidence double", "predicted = 0")
