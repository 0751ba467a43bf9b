"""Language identification with interpolated Kneser-Ney character models.

A model per language over the characters of words ("^^^^word$", order 5). All seen n-grams of a language lie in
sorted arrays of 64-bit hashes with their interpolated log-probability, all seen contexts with their back-off
weight. A text gets the language of the lowest cross-entropy per character; a text whose cross-entropy exceeds the
language's calibrated limit is marked rejected.

Edge cases: null text counts as empty; a text without any letter gets lang `und`, score 0 and is rejected; repeated
rows are scored each alike; ties between languages go to the alphabetically first; with no training rows every text
is `und`. Extra columns are ignored by the query and kept by identify().
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.llm.common import filter_texts, fold, held, map_texts
from palisade.session import cut

ORDER = 5
#: Training documents of each language at most (a bounded sample of labelled rows, chosen by hash of the id).
SAMPLE_PER_LANG = 1500
#: Further labelled documents of each language at most, which only calibrate rejection (also by hash of the id).
CALIBRATE_PER_LANG = 3000
#: Rejection: the quantile of the cross-entropies standardised by length, and the least limit in standard deviations.
QUANTILE, LEAST = 0.999, 8.0
#: Sampled ids that are broadcast to find their texts at most (those of some hundred languages); beyond, they are shuffled together.
BROADCAST_IDS = 1_000_000
#: Words whose scores a worker keeps.
CACHE = 400_000
# Of what \w takes in besides digits, some hundred signs (superscripts, fractions, numerals) aren't letters.
_SIGNS = frozenset(c for c in map(chr, range(0x80, 0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_APART = dict.fromkeys(map(ord, _SIGNS), " ")
_LETTERS = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xC2B2AE3D27D4EB4F)


def _gram_hash(codes: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of the rows of a matrix of character codes."""
    h = np.full(len(codes), (salt + 1) * 0x632BE59BD9B4E019 % (1 << 64), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(codes.shape[1]):
            h = (h ^ codes[:, k].astype(np.uint64)) * _MUL
            h ^= h >> np.uint64(29)
            h *= _MIX
            h ^= h >> np.uint64(32)
    return h


def _windows(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code matrix of all order-grams of the padded words, and the word that each belongs to."""
    pad = "\x02" * (order - 1)
    joined = "".join(pad + w + "\x03" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lens = np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lens + order - 1) - (lens + order - 1)
    owner = np.repeat(np.arange(len(words)), lens)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(starts, lens)
    return np.stack([codes[at + k] for k in range(order)], axis=1), owner


class KneserNey:
    """Interpolated Kneser-Ney models of several languages over one alphabet, in sorted hash arrays."""

    def __init__(self, langs: list[str], counts: dict[str, dict[str, int]], order: int = ORDER):
        self.langs, self.order = sorted(langs), order
        alphabet = {c for per in counts.values() for g in per for c in g}
        self.uniform = 1.0 / (len(alphabet) + 1)
        self.grams = [[] for _ in range(order + 1)]
        self.contexts = [[] for _ in range(order)]
        self.empty: list[float] = []
        for k, lang in enumerate(self.langs):
            self._add(k, counts.get(lang, {}))
        #: Centre, spread between documents, spread of a character, and limit in standard deviations.
        self.limits = {lang: (0.0, 1.0, 0.0, float("inf")) for lang in self.langs}

    def _add(self, k: int, top: dict[str, int]) -> None:
        level: dict[str, int] = dict(top)
        levels = {self.order: level}
        for n in range(self.order - 1, 0, -1):
            lower: dict[str, int] = {}
            for g in levels[n + 1]:  # continuation counts: distinct left neighbours
                lower[g[1:]] = lower.get(g[1:], 0) + 1
            levels[n] = lower
        prob: dict[str, float] = {}
        for n in range(1, self.order + 1):
            cur = levels[n]
            ones, twos = sum(v == 1 for v in cur.values()), sum(v == 2 for v in cur.values())
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            total: dict[str, int] = {}
            kinds: dict[str, int] = {}
            for g, c in cur.items():
                total[g[:-1]] = total.get(g[:-1], 0) + c
                kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
            bow = {h: d * kinds[h] / total[h] for h in total}
            new = {g: max(c - d, 0.0) / total[g[:-1]] + bow[g[:-1]] * (prob[g[1:]] if n > 1 else self.uniform) for g, c in cur.items()}
            if n == 1:
                self.empty.append(np.log(bow.get("", 1.0) * self.uniform))
            else:
                self._store(self.contexts[n - 1], k, bow)
            self._store(self.grams[n], k, new)
            prob = new

    @staticmethod
    def _store(into: list, k: int, values: dict[str, float]) -> None:
        keys = list(values)
        if not keys:
            into.append((np.zeros(0, np.uint64), np.zeros(0)))
            return
        codes = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(keys), -1)
        h = _gram_hash(codes, k)
        order = np.argsort(h)
        into.append((h[order], np.log(np.fromiter(values.values(), float, len(keys)))[order]))

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, vals = table
        if not len(keys):
            return np.zeros(len(h), bool), np.zeros(len(h))
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return keys[at] == h, vals[at]

    def logp(self, codes: np.ndarray, k: int) -> np.ndarray:
        """Natural log-probability of the last character of each row of codes after the others, under language k."""
        lp = np.zeros(len(codes))
        left = np.arange(len(codes))
        for n in range(self.order, 0, -1):
            part = codes[left, self.order - n:]
            hit, val = self._find(self.grams[n][k], _gram_hash(part, k))
            lp[left[hit]] += val[hit]
            left = left[~hit]
            if not len(left):
                break
            if n > 1:
                seen, bow = self._find(self.contexts[n - 1][k], _gram_hash(part[~hit][:, :-1], k))
                lp[left[seen]] += bow[seen]
            else:
                lp[left] += self.empty[k]
        return lp

    def words(self, words: list[str]) -> np.ndarray:
        """A row a word: the summed natural log-probability under each language, then the number of characters."""
        out = np.zeros((len(words), len(self.langs) + 1))
        if not words:
            return out
        codes, owner = _windows(words, self.order)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner, weights=self.logp(codes, k), minlength=len(words))
        out[:, -1] = np.bincount(owner, minlength=len(words))
        return out


def runs(text: str) -> list[str]:
    """The runs of letters of a text."""
    return _LETTERS.findall(text if text.isascii() or _SIGNS.isdisjoint(text) else text.translate(_APART))


def _tokens(text: str) -> list[str]:
    return text.lower().split()


class Scorer:
    """Cross-entropies of texts under every language; the scores of distinct tokens are kept."""

    def __init__(self, model: KneserNey):
        self.model, self.index, self.table, self.used = model, {}, np.zeros((1024, len(model.langs) + 1)), 0

    def _learn(self, tokens: list[str]) -> None:
        parts = [runs(t) for t in tokens]
        flat = [w for p in parts for w in p]
        rows = self.model.words(flat)
        sums = np.zeros((len(tokens), rows.shape[1]))
        np.add.at(sums, np.repeat(np.arange(len(tokens)), [len(p) for p in parts]), rows)
        if self.used + len(tokens) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(len(self.table), len(tokens)), rows.shape[1]))])
        self.table[self.used:self.used + len(tokens)] = sums
        self.index.update(zip(tokens, range(self.used, self.used + len(tokens))))
        self.used += len(tokens)

    def sums(self, texts: list[str]) -> np.ndarray:
        if self.used > CACHE:
            self.index, self.used = {}, 0
        docs = [_tokens(t) for t in texts]
        new = {t for d in docs for t in d}.difference(self.index)
        if new:
            self._learn(sorted(new))
        out = np.zeros((len(texts), len(self.model.langs) + 1))
        get = self.index.__getitem__
        for i, d in enumerate(docs):
            if d:
                out[i] = self.table[np.fromiter(map(get, d), np.int64, len(d))].sum(axis=0)
        return out

    def lengths(self, texts: list[str]) -> list:
        """Language, cross-entropy and number of characters of each text."""
        pred, _, low, _ = self(texts)
        return [pred, low, self.sums(texts)[:, -1]]

    def __call__(self, texts: list[str]) -> list:
        s, langs = self.sums(texts), self.model.langs
        n = s[:, -1]
        has = (n > 0) & bool(langs)
        if not langs:
            return [["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)]
        h = -s[:, :-1] / np.maximum(n, 1)[:, None]  # nats a character
        best = h.argmin(axis=1)
        low = h[np.arange(len(texts)), best]
        post = 1.0 / np.exp(np.minimum(-(h - low[:, None]) * np.minimum(n, 40)[:, None], 0.0)).sum(axis=1)
        mid, between, within, most = np.array([self.model.limits[x] for x in langs])[best].T
        limit = mid + most * spread(between, within, n)
        pred = [langs[b] if ok else "und" for b, ok in zip(best, has)]
        return [pred, np.where(has, post, 0.0), np.where(has, low, 0.0), ~has | (low > limit)]


def spread(between, within, n):
    """Standard deviation of the cross-entropy of texts of n characters."""
    return np.sqrt(between ** 2 + within ** 2 / np.maximum(n, 1))


def calibrate(xent: np.ndarray, n: np.ndarray) -> tuple[float, float, float, float]:
    """The limits of a language from the cross-entropies and lengths of its documents, by medians of deviations."""
    mid = float(np.median(xent))
    off, long = np.abs(xent - mid), n >= np.median(n)
    between = 1.4826 * float(np.median(off[long]))
    within = 1.4826 * float(np.median((off * np.sqrt(n))[~long if (~long).any() else long]))
    between = max(between, 0.02 * mid, 1e-3)
    z = (xent - mid) / spread(between, within, n)
    return mid, between, within, max(float(np.quantile(z, QUANTILE, method="higher")) if len(z) * (1 - QUANTILE) >= 1 else 0.0, LEAST)


def _scorer(ref) -> Scorer:
    """One scorer a worker and model."""
    return held(("language", ref.value[0]), lambda: Scorer(ref.value[1]))


def _sample(labelled: DataFrame, per_lang: int, more: int) -> DataFrame:
    """At most per_lang + more rows of each language, one a doc_id, by hash of the id, the latter marked __more.

    Ids first: from a language's number of ids follows a limit of the hash under which a fifth more than is wanted lies,
    so that only so many are ranked in one task. Then their texts, joined by id.
    """
    ids = labelled.where("doc_id is not null").select("lang", "doc_id").distinct().withColumn("__h", F.xxhash64("doc_id"))
    want = per_lang + more
    share = F.least((want * 1.2 + 100) / F.count("*"), F.lit(1.0))
    limits = ids.groupBy("lang").agg((F.lit(float(-(1 << 63))) + share * float(1 << 64)).alias("__limit"))
    low = ids.join(limits, "lang").where(F.col("__h").cast("double") <= F.col("__limit"))
    ranked = low.withColumn("__r", F.row_number().over(W.partitionBy("lang").orderBy("__h", "doc_id"))).where(F.col("__r") <= want)
    chosen = cut(ranked.select("lang", "doc_id", (F.col("__r") > per_lang).alias("__more")), "language-sample")
    if chosen.count() <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    return labelled.join(chosen, ["lang", "doc_id"]).groupBy("lang", "doc_id", "__more").agg(F.min("text").alias("text"))


def train(labelled: DataFrame, order: int = ORDER, per_lang: int = SAMPLE_PER_LANG) -> KneserNey:
    """Fit on labelled (doc_id, text, lang): n-gram counts are summed by Spark; a tenth of the sample and further rows calibrate the limits."""
    spark = labelled.sparkSession
    sample = _sample(labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang"), per_lang, CALIBRATE_PER_LANG)
    sample = sample.repartition(spark.sparkContext.defaultParallelism * 2, F.xxhash64("doc_id", "text"))
    part = sample.withColumn("__cal", F.col("__more") | (fold(F.col("doc_id"), 10) == 0))

    def count(batches):
        for b in batches:
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            per: dict = {}
            for t, lang in zip(texts, langs):
                grams = per.setdefault(lang, {})
                words: dict = {}
                for w in runs(t.lower()):
                    words[w] = words.get(w, 0) + 1
                for w, c in words.items():
                    p = "\x02" * (order - 1) + w + "\x03"
                    for i in range(len(p) - order + 1):
                        g = p[i:i + order]
                        grams[g] = grams.get(g, 0) + c
            rows = [(lang, g, c) for lang, grams in per.items() for g, c in grams.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "gram", "n"])

    grams = part.where("not __cal").select("text", "lang").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for r in grams.toLocalIterator():  # as many as the sample's languages have
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    model = KneserNey(list(counts), counts, order)
    if model.langs:
        ref = spark.sparkContext.broadcast((id(model), model))
        cal = map_texts(part.where("__cal").select("text", "lang"), lambda: _scorer(ref).lengths, "lang_pred string, xent double, n double")
        per: dict[str, list] = {}
        for r in cal.where("lang = lang_pred").select("lang", "xent", "n").collect():  # at most the sample
            per.setdefault(r["lang"], []).append((r["xent"], r["n"]))
        for lang, rows in per.items():
            model.limits[lang] = calibrate(*np.array(sorted(rows)).T)
        ref.unpersist()
    return model


def identify(docs: DataFrame, model: KneserNey) -> DataFrame:
    """docs without text, with lang_pred, score, xent (nats a character) and rejected."""
    ref = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))
    return map_texts(docs, lambda: _scorer(ref), "lang_pred string, score double, xent double, rejected boolean")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").where(fold("doc_id", 4) != 2)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(training_rows(docs))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "xent", "rejected")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the models reject go, and so do texts that are null or have no letter. Repeated rows
    fare alike, all columns stay, whatever their names; without labelled rows no language is known and all go."""
    ref = spark.sparkContext.broadcast((uuid.uuid4().hex, train(training_rows(docs))))
    return filter_texts(docs, lambda: _scorer(ref), "lang_pred string, score double, xent double, rejected boolean", ~F.col("rejected"))
