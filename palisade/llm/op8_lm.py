"""Scoring by a gated recurrent language model with a class-factored softmax.

Counts of all training tokens are summed by Spark. Texts are then read once more and become symbols, which are written
for the passes of training and scoring. The most frequent tokens are symbols of their own; any other token
belongs to a bucket symbol by its ending, and its probability is the bucket's times its smoothed share of the
bucket's counts, so every text has a proper log-probability. A GRU predicts symbols: class first, then symbol within
the class. It is trained in numpy by truncated backpropagation on all training documents, in rounds: every task
starts from the same weights, goes once through its part of the round's documents, and the weights are averaged.
Scoring carries the state through a whole document, window by window.

Edge cases: null text counts as empty and is the end token alone; repeated rows are scored alike; without training
documents the base score of any text is 0 and the model is untrained; null ids count as held out (remainder 0).
Extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import fold, schema_of, steps
from palisade.session import cut

HIDDEN, CLASSES, PER_CLASS, BUCKETS = 16, 24, 24, 64
#: Tokens broadcast with their counts at most; the counts of all others are joined.
TOP = 131_072
#: Training: parts (of 16) of the documents in each round, together all; segment, truncation and batch lengths; step size.
ROUNDS = (1, 1, 2, 4, 8)
SEGMENT, TRUNCATE, BATCH, RATE = 512, 16, 448, 0.08
#: Bytes of symbols whose documents are trained on or scored side by side; symbols whose states are held at once in scoring.
SIDE_BYTES, WINDOW = 4_000_000, 32_768
SMOOTH = 0.1
END = b""
_PUNCT = b".,;:!?\"'()[]"
_FLUSH = 600_000


def tokens(text: str) -> list[bytes]:
    """Words, then the end token."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def bucket(token: bytes) -> int:
    """The bucket of a token that is no symbol of its own: by its last three bytes, punctuation aside."""
    return zlib.crc32(token.rstrip(_PUNCT)[-3:]) % BUCKETS


class Vocabulary:
    """Symbols and the smoothed shares of tokens in their buckets."""

    def __init__(self, top: list[tuple[bytes, int]], total: int, distinct: int, buckets: dict[int, tuple[int, int]]):
        frequent = CLASSES * PER_CLASS - BUCKETS
        own = [t for t, _ in top[:frequent]]
        if END not in own and any(t == END for t, _ in top):
            own[-1] = END
        own_set = set(own)
        self.key = uuid.uuid4().hex
        self.total, self.distinct = total, distinct
        self.base_den = math.log10(total + SMOOTH * (distinct + 1))
        n = np.zeros(BUCKETS)
        v = np.zeros(BUCKETS)
        for b, (bn, bv) in buckets.items():
            n[b], v[b] = bn, bv
        for t, c in top:
            if t in own_set:
                n[bucket(t)] -= c
                v[bucket(t)] -= 1
        self.rare_den = np.log10(n + SMOOTH * (v + 1))
        by_freq = sorted([(c, i, t) for i, (t, c) in enumerate(top) if t in own_set] + [(float(n[b]), -1 - b, None) for b in range(BUCKETS)], key=lambda x: (-x[0], x[1]))
        by_freq += [(0.0, 0, None)] * (CLASSES * PER_CLASS - len(by_freq))
        self.freq = np.array([max(x[0], 0.0) for x in by_freq]) + 0.5
        self.bucket_symbol = np.zeros(BUCKETS, np.int64)
        symbol = {}
        for s, (_, i, t) in enumerate(by_freq):
            if t is not None:
                symbol[t] = s
            elif i < 0:
                self.bucket_symbol[-1 - i] = s
        self.end = symbol.get(END, 0)
        self.index = {t: k for k, (t, _) in enumerate(top)}
        lp = np.array([math.log10(c + SMOOTH) for _, c in top] or [0.0])
        self.base = lp - self.base_den
        self.symbol = np.array([symbol[t] if t in symbol else self.bucket_symbol[bucket(t)] for t, _ in top] or [0], np.int64)
        self.share = np.array([0.0 if t in symbol else lp[k] - self.rare_den[bucket(t)] for k, (t, _) in enumerate(top)] or [0.0])

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Symbols, places in the top list (-1: not there), and the buckets of those that aren't."""
        get = self.index.get
        at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        sym = self.symbol[at]
        rare = np.flatnonzero(at < 0)
        buckets = [bucket(words[i]) for i in rare]
        sym[rare] = self.bucket_symbol[buckets] if buckets else 0
        return sym, at, buckets


class Packed:
    """Symbols of sequences step by step, without padding: longest sequence first, so that those still going at a step
    are the first ones. start: where each step's symbols begin; before: the symbol before each; owner: its sequence."""

    def __init__(self, docs: list[np.ndarray], start: int):
        lens = np.fromiter(map(len, docs), np.int64, len(docs))
        self.order = np.argsort(-lens, kind="stable")
        lens = lens[self.order]
        self.steps = int(lens[0]) if len(lens) else 0
        live = len(lens) - np.cumsum(np.bincount(lens, minlength=self.steps + 1))[:-1]
        self.start = np.concatenate([[0], np.cumsum(live)])
        flat = np.concatenate([docs[i] for i in self.order]).astype(np.int64) if len(docs) else np.zeros(0, np.int64)
        first = np.cumsum(lens) - lens
        owner = np.repeat(np.arange(len(lens)), lens)
        at = self.start[np.arange(len(flat)) - first[owner]] + owner
        shifted = np.concatenate([[start], flat[:-1]])[:len(flat)]
        shifted[first[lens > 0]] = start
        self.symbols, self.before, self.owner = (np.empty(len(flat), np.int64) for _ in range(3))
        self.symbols[at], self.before[at], self.owner[at] = flat, shifted, owner


class GRU:
    """Parameters in one flat array: input projections by symbol, recurrence, class and symbol outputs."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        h, s, at = HIDDEN, CLASSES * PER_CLASS, 0
        self.parts = {}
        for name, shape in (("x", (s, 3 * h)), ("h", (h, 3 * h)), ("uc", (h, CLASSES)), ("bc", (CLASSES,)), ("uw", (CLASSES, h, PER_CLASS)), ("bw", (CLASSES, PER_CLASS))):
            n = int(np.prod(shape))
            self.parts[name] = flat[at:at + n].reshape(shape)
            at += n
        self.size = at

    @classmethod
    def initial(cls, freq: np.ndarray) -> np.ndarray:
        """Seeded weights whose outputs are the unigram distribution."""
        size = cls(np.zeros(10_000_000, np.float32)).size
        flat = (np.random.default_rng(11).standard_normal(size) * 0.1).astype(np.float32)
        p = cls(flat).parts
        f = freq.reshape(CLASSES, PER_CLASS)
        p["uc"][:], p["uw"][:] = 0, 0
        p["bc"][:] = np.log(f.sum(axis=1) / f.sum())
        p["bw"][:] = np.log(f / f.sum(axis=1, keepdims=True))
        return flat

    def run(self, packed: Packed, first: int, last: int, h: np.ndarray, kept: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States of the steps first to last, and the state after them; kept: arrays for what backpropagation needs."""
        k, at = HIDDEN, packed.start
        base = at[first]
        x = self.parts["x"][packed.before[base:at[last]]]
        states = np.empty((len(x), k), np.float32)
        for t in range(first, last):
            a, b = at[t] - base, at[t + 1] - base
            h = h[:b - a]
            hp = h @ self.parts["h"]
            zr = x[a:b, :2 * k] + hp[:, :2 * k]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            hn = hp[:, 2 * k:]
            n = zr[:, k:] * hn
            n += x[a:b, 2 * k:]
            np.tanh(n, out=n)
            if kept is not None:
                kept[0][a:b], kept[1][a:b], kept[2][a:b], kept[3][a:b] = zr, hn, n, h
            h = h - n
            h *= zr[:, :k]
            h += n
            states[a:b] = h
        return states, h

    def outputs(self, hs: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of the targets; with grads, adds to them and returns the states' gradient too."""
        cls, within = target // PER_CLASS, target % PER_CLASS
        rows = np.arange(len(hs))
        p = self.parts
        a = hs @ p["uc"]
        a += p["bc"]
        np.minimum(a, 60, out=a)
        own_logit = a[rows, cls]
        e = np.exp(a, out=a)
        total = e @ np.ones(CLASSES, np.float32)
        lp = own_logit - np.log(total)
        dh = None
        if grads is not None:
            e /= total[:, None]
            e[rows, cls] -= 1
            grads["uc"] += hs.T @ e
            grads["bc"] += e.sum(axis=0)
            dh = e @ p["uc"].T
        order = np.argsort(cls.astype(np.int8), kind="stable")
        edge = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        sorted_hs, sorted_in = hs[order], within[order]
        more, back = np.empty(len(hs), np.float32), np.empty_like(hs)
        ones = np.ones(PER_CLASS, np.float32)
        for c in range(CLASSES):
            lo, hi = edge[c], edge[c + 1]
            if lo == hi:
                continue
            part, inner = sorted_hs[lo:hi], sorted_in[lo:hi]
            b = part @ p["uw"][c]
            b += p["bw"][c]
            np.minimum(b, 60, out=b)
            own = rows[:hi - lo]
            own_logit = b[own, inner]
            e = np.exp(b, out=b)
            total = e @ ones
            more[lo:hi] = own_logit - np.log(total)
            if grads is not None:
                e /= total[:, None]
                e[own, inner] -= 1
                grads["uw"][c] += part.T @ e
                grads["bw"][c] += e.sum(axis=0)
                np.matmul(e, p["uw"][c].T, out=back[lo:hi])
        lp[order] += more
        if grads is not None:
            dh[order] += back
        return lp, dh

    def score(self, docs: list[np.ndarray], start: int) -> np.ndarray:
        """Natural log-probability of each document's symbols; states run through whole documents, longest first."""
        packed = Packed(docs, start)
        out = np.zeros(len(docs))
        h, t = np.zeros((len(docs), HIDDEN), np.float32), 0
        while t < packed.steps:
            last = max(t + 1, int(np.searchsorted(packed.start, packed.start[t] + WINDOW, "right")) - 1)
            states, h = self.run(packed, t, last, h)
            part = slice(packed.start[t], packed.start[last])
            lp, _ = self.outputs(states, packed.symbols[part])
            out += np.bincount(packed.owner[part], weights=lp, minlength=len(docs))
            t = last
        got = np.empty_like(out)
        got[packed.order] = out
        return got

    def gradient(self, packed: Packed, first: int, last: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the mean loss of the steps first to last (the state before them fixed), and the state after."""
        k, p, at = HIDDEN, self.parts, packed.start
        base, rows = at[first], int(at[last] - at[first])
        zr, hn, n, past = kept = tuple(np.empty((rows, w), np.float32) for w in (2 * k, k, k, k))
        states, after = self.run(packed, first, last, h, kept)
        g = GRU(np.zeros(self.size, np.float32))
        _, dh = self.outputs(states, packed.symbols[base:at[last]], g.parts)
        z, r = zr[:, :k], zr[:, k:]
        to_n = (1 - z) * (1 - n * n)
        to_z = (past - n) * z * (1 - z)
        to_r = hn * r * (1 - r)
        dx, dhp = np.empty((rows, 3 * k), np.float32), np.empty((rows, 3 * k), np.float32)
        back = np.ascontiguousarray(p["h"].T)
        carry = np.zeros((0, k), np.float32)
        for t in range(last - 1, first - 1, -1):
            a, b = at[t] - base, at[t + 1] - base
            d = dh[a:b]
            d[:len(carry)] += carry
            x, y = dx[a:b], dhp[a:b]
            np.multiply(d, to_n[a:b], out=x[:, 2 * k:])
            np.multiply(d, to_z[a:b], out=x[:, :k])
            np.multiply(x[:, 2 * k:], to_r[a:b], out=x[:, k:2 * k])
            y[:, :2 * k] = x[:, :2 * k]
            np.multiply(x[:, 2 * k:], r[a:b], out=y[:, 2 * k:])
            carry = y @ back
            carry += d * z[a:b]
        g.parts["h"] += past.T @ dhp
        ids = packed.before[base:at[last]]
        by = np.argsort(ids.astype(np.int16), kind="stable")
        ids = ids[by]
        edge = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        g.parts["x"][ids[edge]] += np.add.reduceat(dx[by], edge, axis=0)
        g.flat /= rows
        return g.flat, after

    def train(self, segments: list[np.ndarray], start: int, rate: float = RATE) -> None:
        """One pass of truncated backpropagation over segments, in batches of like length; Adagrad steps."""
        memory = np.full(self.size, 1e-2, np.float32)
        order = sorted(range(len(segments)), key=lambda i: len(segments[i]))
        batches = [order[i:i + BATCH] for i in range(0, len(order), BATCH)]
        np.random.default_rng(5).shuffle(batches)
        for batch in batches:
            packed = Packed([segments[i] for i in batch], start)
            h = np.zeros((len(batch), HIDDEN), np.float32)
            for t in range(0, packed.steps, TRUNCATE):
                grad, h = self.gradient(packed, t, min(t + TRUNCATE, packed.steps), h)
                memory += grad * grad * 1e3
                self.flat -= rate * grad / np.sqrt(memory) * np.float32(30 ** 0.5)


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, bucket, n) of docs (text): partial counts in the tasks, sums by Spark."""

    def run(batches):
        def rows(c):
            keys = list(c)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([bucket(k) for k in keys], pa.int32()), pa.array(list(c.values()), pa.int64())], ["token", "bucket", "n"])

        c: Counter = Counter()
        for b in batches:
            for _, _, texts in steps(b.column("text")):
                for t in texts:
                    c.update(tokens(t))
                if len(c) > _FLUSH:
                    yield rows(c)
                    c = Counter()
        if c:
            yield rows(c)

    return docs.select("text").mapInArrow(run, "token binary, bucket int, n long").groupBy("token", "bucket").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    buckets = {r["bucket"]: (r["n"], r["v"]) for r in counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}  # BUCKETS rows
    cell = F.floor(F.log2("n") * 8)  # a few hundred cells of like counts, the highest taken while TOP tokens hold
    taken, least = 0, None
    for r in sorted(counts.groupBy(cell.alias("cell")).agg(F.count("*").alias("k"), F.min("n").alias("least")).collect(), key=lambda r: -r["cell"]):
        taken += r["k"]
        if taken > TOP:
            break
        least = r["least"]
    rows = counts.where(F.col("n") >= least).select("token", "n").collect() if least is not None else []  # at most TOP
    top = sorted(((bytes(r["token"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))
    return Vocabulary(top, sum(n for n, _ in buckets.values()), sum(v for _, v in buckets.values()), buckets)


def _average(parts: DataFrame) -> DataFrame:
    """Weighted means of weight blocks (block, salt, w, weights) in two steps, so no group grows with the tasks."""

    def mean(pdf):
        w = pdf["w"].to_numpy(float)
        stack = np.stack([np.frombuffer(x, np.float32) for x in pdf["weights"]])
        got = (stack * (w / w.sum())[:, None].astype(np.float32)).sum(axis=0)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "w": [w.sum()], "weights": [got.astype(np.float32).tobytes()]})

    schema = "block int, w double, weights binary"
    return parts.groupBy("block", "salt").applyInPandas(mean, schema).groupBy("block").applyInPandas(mean, schema)


ENCODED = "rid long, doc_id long, training boolean, place int, n_tokens long, known long, base double, lm double, rare array<binary>, rare_n array<int>, symbols binary"


def encode(docs: DataFrame, vocab: Vocabulary, training: Column) -> DataFrame:
    """docs (doc_id, text) as symbols: what scoring needs of the counts, the tokens beyond the broadcast ones, and a
    place in training by a hash of id and text."""
    ref = docs.sparkSession.sparkContext.broadcast(vocab)
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(sum(ROUNDS))).cast("int")
    names = schema_of(ENCODED).names

    def run(batches):
        v, pid, row = ref.value, TaskContext.get().partitionId(), 0
        for b in batches:
            for lo, hi, texts in steps(b.column("text")):
                made: list[list] = [[] for _ in range(7)]
                for t in texts:
                    words = tokens(t)
                    sym, at, buckets = v.symbols(words)
                    known = at >= 0
                    rare = Counter(words[i] for i in np.flatnonzero(~known))
                    base = v.base[at[known]].sum() - len(buckets) * v.base_den
                    lm = v.share[at[known]].sum() - (v.rare_den[buckets].sum() if buckets else 0.0)
                    for c, x in zip(made, (len(words), int(known.sum()), base, lm, list(rare), list(rare.values()), sym.astype("<u2").tobytes())):
                        c.append(x)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary())
                rid = pa.array(range((pid << 33) + row, (pid << 33) + row + hi - lo), pa.int64())
                row += hi - lo
                yield pa.RecordBatch.from_arrays([rid, *[b.column(c).slice(lo, hi - lo) for c in ("doc_id", "training", "place")], *[pa.array(c, k) for c, k in zip(made, kinds)]], names)

    return docs.select("doc_id", "text", training.alias("training"), place.alias("place")).mapInArrow(run, ENCODED)


def train(encoded: DataFrame, vocab: Vocabulary, rounds: tuple[int, ...] = ROUNDS) -> np.ndarray:
    """Weights after one pass over all encoded training documents, dealt to rounds by their places."""
    spark = encoded.sparkSession
    flat = GRU.initial(vocab.freq)
    at, end, block = 0, vocab.end, 8192
    for share in rounds:
        ref = spark.sparkContext.broadcast(flat)
        part = encoded.where(F.col("training") & (F.col("place") >= at) & (F.col("place") < at + share)).select("symbols")
        at += share

        def run(batches, ref=ref):
            model, seen = GRU(ref.value.copy()), 0
            for b in batches:
                for _, _, docs in steps(b.column("symbols"), SIDE_BYTES):
                    syms = [np.frombuffer(d, "<u2") for d in docs]
                    seen += sum(map(len, syms))
                    model.train([s[i:i + SEGMENT] for s in syms for i in range(0, len(s), SEGMENT)], end)
            if seen:
                pid = TaskContext.get().partitionId()
                cuts = list(range(0, len(model.flat), block))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([pid % 64] * len(cuts), pa.int32()), pa.array([float(seen)] * len(cuts)), pa.array([model.flat[c:c + block].tobytes() for c in cuts], pa.binary())], ["block", "salt", "w", "weights"])

        got = sorted((r["block"], bytes(r["weights"])) for r in _average(part.mapInArrow(run, "block int, salt int, w double, weights binary")).collect())  # as many as weight blocks
        if got:
            flat = np.frombuffer(b"".join(w for _, w in got), np.float32).copy()
        ref.unpersist()
    return flat


def score(encoded: DataFrame, counts: DataFrame, vocab: Vocabulary, flat: np.ndarray) -> DataFrame:
    """Encoded documents scored: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    ref, end = encoded.sparkSession.sparkContext.broadcast(flat), vocab.end
    cols = ["rid", "doc_id", "n_tokens", "known", "base", "lm"]

    def run(batches):
        model = GRU(ref.value)
        for b in batches:
            for lo, hi, docs in steps(b.column("symbols"), SIDE_BYTES):
                got = model.score([np.frombuffer(d, "<u2") for d in docs], end) / math.log(10)
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(lo, hi - lo) for c in cols], pa.array(got)], [*cols, "gru"])

    done = encoded.select(*cols, "symbols").mapInArrow(run, "rid long, doc_id long, n_tokens long, known long, base double, lm double, gru double")
    rare = encoded.select("rid", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("rid", F.col("r.rare").alias("token"), F.col("r.rare_n").alias("k"))
    c = F.coalesce("n", F.lit(0))
    sums = rare.join(counts.select("token", "n"), "token", "left").groupBy("rid").agg(
        F.sum(F.col("k") * F.log10(c + SMOOTH)).alias("s"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("rare_known"))
    s = F.coalesce("s", F.lit(0.0))
    return done.join(sums, "rid", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + s).alias("base_score"), (F.col("lm") + F.col("gru") + s).alias("score"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counts = cut(count_tokens(docs.where(fold("doc_id", 10) != 0)), "lm-counts")
    vocab = vocabulary(counts)
    encoded = cut(encode(docs, vocab, fold("doc_id", 10) != 0), "lm-symbols")
    got = score(encoded, counts, vocab, train(encoded, vocab))
    return got.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
