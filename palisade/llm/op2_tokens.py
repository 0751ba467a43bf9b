"""Token-id output in patched frame-of-reference blocks.

Texts are encoded in ascending doc_id order and written as segments. A segment is a self-contained binary file image
(a row of a Parquet table, so that any store takes it and commits are atomic) of whole documents, SEGMENT ids or
more. Its blocks of 128 ids are stored less their minimum, packed at the width that holds the PERCENTILE of them;
wider values lie in an exception list; block starts are indexed, so any block can be decoded alone, and so are the
documents' starts and ids, so that an image alone gives back any document.

Layout, little-endian: magic "PFR2", u32 block size, u64 ids, u32 blocks, u64 exceptions, u32 documents; u64 start of
each document (with one more at the end), i64 its id, u8 whether it has one; then u64 start of each block's packed
words, u32 minimum, u8 width, u64 start of its exceptions (both starts with one more at the end); packed u32 words
(four lanes of 32 values); exceptions: u8 position, u32 value less the minimum.

Edge cases: null text counts as empty and gives the end id only; null ids sort first; rows of one id are ordered by a
hash of their text, then by the text; empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.llm.common import steps
from palisade.session import cut

BLOCK = 128
SEGMENT = 1 << 20
PERCENTILE = 0.9
END_ID = 2
#: Bytes of the pre-tokens and ids that a worker keeps at most, the first it meets, each with ENTRY bytes for its place;
#: those of more than LONGEST characters, and all others, are encoded anew.
CACHE_BYTES, ENTRY, LONGEST = 48_000_000, 160, 48
#: Bytes of text encoded at a time.
STEP = 1_000_000
_HEAD = struct.Struct("<4sIQIQI")
# The model's pre-tokens over characters of which the classes are beyond doubt (ASCII, letters of Latin-1, tabs, line feeds, carriage returns).
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_OTHER = re.compile(rf"[^ -~\t\n\r{_LETTER}]")
_PRE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
# Of any other text: runs that end before a space or line feed which follows no white space.
_ODD_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")
_RUN = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
# A pre-token that stays one whatever such stands beside it; its first id alone begins with the space's sign. So many are encoded at once.
_WORD, WORDS = re.compile(rf" [{_LETTER}]+"), 500


def _bits(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _lanes(width: int):
    """(first value of a row of four, word, offset, whether it runs over) for packing 128 values."""
    for i in range(32):
        bit = i * width
        yield 4 * i, bit >> 5, bit & 31, (bit & 31) + width > 32


def pack(ids: np.ndarray, starts_of: Iterable[int] = (), doc_ids: Iterable[int | None] = (), percentile: float = PERCENTILE) -> bytes:
    """File image of an array of unsigned 32-bit ids, and of the starts and ids of its documents."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:n] = ids
    if n:
        full[n:] = ids[-1]
    v = full.reshape(blocks, BLOCK)
    low = v.min(axis=1) if blocks else np.zeros(0, np.uint32)
    v = v - low[:, None]
    rank = min(BLOCK - 1, int(percentile * BLOCK))
    width = _bits(np.partition(v, rank, axis=1)[:, rank]) if blocks else np.zeros(0, np.int64)
    wide = (v.astype(np.uint64) >> width.astype(np.uint64)[:, None]) > 0
    starts = np.concatenate([[0], np.cumsum(4 * width)]).astype(np.uint64)
    exc = np.concatenate([[0], np.cumsum(wide.sum(axis=1))]).astype(np.uint64)
    words = np.zeros(int(starts[-1]), np.uint32)
    for w in np.unique(width):
        if w == 0:
            continue
        at = np.flatnonzero(width == w)
        part = v[at] & np.uint32((1 << int(w)) - 1)
        out = np.zeros((len(at), int(w), 4), np.uint32)
        for k, word, off, over in _lanes(int(w)):
            four = part[:, k:k + 4]
            out[:, word] |= four << np.uint32(off)
            if over:
                out[:, word + 1] |= four >> np.uint32(32 - off)
        words[starts[at].astype(np.int64)[:, None] + np.arange(4 * int(w))] = out.reshape(len(at), -1)
    pos = np.nonzero(wide)[1].astype(np.uint8)
    keys = list(doc_ids)
    docs = [np.array([*starts_of, n], "<u8"), np.array([k or 0 for k in keys], "<i8"), np.array([k is not None for k in keys], np.uint8)]
    return b"".join([_HEAD.pack(b"PFR2", BLOCK, n, blocks, len(pos), len(keys)), *[d.tobytes() for d in docs], starts.tobytes(), low.tobytes(), width.astype(np.uint8).tobytes(), exc.tobytes(), words.tobytes(), pos.tobytes(), v[wide].tobytes()])


class Image:
    """Reader of a file image."""

    def __init__(self, data: bytes):
        magic, self.block, self.n, blocks, n_exc, docs = _HEAD.unpack_from(data)
        if magic != b"PFR2":
            raise ValueError("not a PFR2 image")
        at = _HEAD.size

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.doc_starts, self.doc_ids, self.has_id = take("<u8", docs + 1).astype(np.int64), take("<i8", docs), take("u1", docs)
        self.starts, self.low, self.width = take("<u8", blocks + 1), take("<u4", blocks), take("u1", blocks)
        self.exc = take("<u8", blocks + 1)
        self.words = take("<u4", int(self.starts[-1]))
        self.pos, self.values = take("u1", n_exc), take("<u4", n_exc)

    def blocks(self, lo: int, hi: int) -> np.ndarray:
        """The ids of blocks lo to hi, the last one's padding included."""
        out = np.zeros((hi - lo, BLOCK), np.uint32)
        width = self.width[lo:hi]
        for w in np.unique(width):
            if w == 0:
                continue
            w = int(w)
            at = np.flatnonzero(width == w)
            packed = self.words[self.starts[lo + at].astype(np.int64)[:, None] + np.arange(4 * w)].reshape(len(at), w, 4)
            mask = np.uint32((1 << w) - 1)
            part = np.empty((len(at), BLOCK), np.uint32)
            for k, word, off, over in _lanes(w):
                four = packed[:, word] >> np.uint32(off)
                if over:
                    four = four | packed[:, word + 1] << np.uint32(32 - off)
                part[:, k:k + 4] = four & mask
            out[at] = part
        a, b = int(self.exc[lo]), int(self.exc[hi])
        owner = np.repeat(np.arange(hi - lo), np.diff(self.exc[lo:hi + 1].astype(np.int64)))
        out[owner, self.pos[a:b]] = self.values[a:b]
        return (out + self.low[lo:hi, None]).ravel()

    def ids(self) -> np.ndarray:
        return self.blocks(0, len(self.low))[:self.n]

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, of whose blocks alone are decoded."""
        a, b = int(self.doc_starts[k]), int(self.doc_starts[k + 1])
        first = a // BLOCK
        return self.blocks(first, -(-b // BLOCK))[a - first * BLOCK:b - first * BLOCK]


class Encoder:
    """Byte-level BPE of whole texts. Pre-tokens are encoded each by itself whatever stands around them, so the distinct
    ones go through the library once (words of letters after a space joined) and the first of them are kept, within CACHE_BYTES. Texts with characters outside _PRE's classes
    are cut before spaces only; those with a special token's string or other white space go to the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab()
        self.begins = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.cache: dict[str, bytes] = {}
        self.room = CACHE_BYTES

    def _library(self, parts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(parts), 20_000):
            out += [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(parts[lo:lo + 20_000], add_special_tokens=False)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """_library() of parts that are _WORD: joined, as a call a part costs more than its merges."""
        groups = [words[lo:lo + WORDS] for lo in range(0, len(words), WORDS)]
        out: list[bytes] = []
        for own, e in zip(groups, self.tok.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            starts = np.flatnonzero(self.begins[ids]).tolist()
            if len(starts) != len(own):  # not this model's way
                out += self._library(own)
                continue
            data = ids.tobytes()
            out += [data[4 * a:4 * b] for a, b in zip(starts, [*starts[1:], len(ids)])]
        return out

    def _parts(self, text: str) -> list[str]:
        if any(x in text for x in self.special):
            return [text]
        if not _OTHER.search(text):
            return _PRE.findall(text)
        return [text] if _ODD_SPACE.search(text) else _RUN.findall(text)

    def __call__(self, texts: list[str]) -> list[bytes]:
        parts = [self._parts(t) for t in texts]
        new = list(set().union(*parts).difference(self.cache))
        words = list(filter(_WORD.fullmatch, new))
        rest = list(set(new).difference(words))
        fresh = dict(zip(words, self._words(words))) | dict(zip(rest, self._library(rest)))
        self.cache.update(fresh)
        get = self.cache.__getitem__
        out = [b"".join(map(get, p)) for p in parts]
        if self.room <= 0:
            for p in fresh:
                del self.cache[p]
            return out
        for p, ids in fresh.items():
            if len(p) > LONGEST or self.room <= 0:
                del self.cache[p]
            else:
                self.room -= ENTRY + 2 * len(p) + len(ids)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


SEGMENTS = "pid int, seg int, n_ids long, image binary"


def segments(docs: DataFrame, path: str, end_id: int = END_ID, size: int = SEGMENT) -> DataFrame:
    """Segments of docs (doc_id, text) in ascending doc_id order; pid, then seg, is that order too."""
    rows = docs.select("doc_id", "text")
    n = max(rows.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism)
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    order = [F.col("doc_id").asc_nulls_first(), tie]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc, pid, seg = encoder(path), TaskContext.get().partitionId(), 0
        keys, starts, parts, held = [], [], [], 0

        def flush():
            nonlocal seg, held
            data = pack(np.frombuffer(b"".join(parts), "<u4"), starts, keys)
            out = pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([seg], pa.int32()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], ["pid", "seg", "n_ids", "image"])
            keys.clear(), starts.clear(), parts.clear()
            seg, held = seg + 1, 0
            return out

        for b in batches:
            for lo, hi, texts in steps(b.column("text"), STEP):
                for key, ids in zip(b.column("doc_id").slice(lo, hi - lo).to_pylist(), enc(texts)):
                    keys.append(key)
                    starts.append(held)
                    parts.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= size:
                        yield flush()
        if keys:
            yield flush()

    return rows.mapInArrow(run, SEGMENTS)


def documents_of(segs: DataFrame) -> DataFrame:
    """Per document of written segments: doc_id, start, n_tokens, ids_crc32 and its segment, from the images alone."""
    spark = segs.sparkSession
    sizes = segs.select("pid", "seg", "n_ids")
    totals = sorted((r["pid"], r["n"]) for r in sizes.groupBy("pid").agg(F.sum("n_ids").alias("n")).collect())  # one row a task that wrote
    before = np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before)], "pid int, base long")
    w = W.partitionBy("pid").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("own", F.coalesce(F.sum("n_ids").over(w), F.lit(0))).join(bases, "pid").select("pid", "seg", (F.col("own") + F.col("base")).alias("seg_start"))

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                image = Image(b.column("image")[r].as_py())
                ids, at = image.ids().astype("<u4", copy=False), image.doc_starts
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                k = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(c)[r].as_py()] * k, pa.int32()) for c in ("pid", "seg")] + [pa.array(image.doc_ids, mask=image.has_id == 0), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["pid", "seg", "doc_id", "local", "n_tokens", "ids_crc32"])

    rows = segs.mapInArrow(run, "pid int, seg int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["pid", "seg"]).select("doc_id", (F.col("seg_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "pid", "seg")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents_of(cut(segments(docs, public_tokenizers.path("byte_bpe_50k.json")), "token-segments"))
