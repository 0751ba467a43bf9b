"""SentencePiece encoding and decoding with offsets.

The normaliser walks the model's compiled character map by longest prefix and records, for every byte it writes, the
span of the original bytes behind it; escaping of spaces and the dummy prefix are recorded too. The library encodes
each whole text; every piece lies over a run of the normalised bytes and is projected back to its original byte span.

Edge cases: null text counts as empty and has no pieces; a byte piece of a character covers its own byte; where several
unknown pieces (of a model without byte fallback) leave open which bytes are whose, the library's spans are taken;
repeated rows are encoded alike. Extra columns are ignored by the query and kept by encode().
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from palisade.llm.common import add_to_texts, held, map_texts

MARK = "▁"


def _fields(buf: bytes):
    """(field number, value) of a protocol buffer message: ints, or bytes of length-delimited fields."""
    i = 0

    def varint():
        nonlocal i
        shift = out = 0
        while True:
            b = buf[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, buf[i:i + n]
            i += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, buf[i:i + n]
            i += n


class Normaliser:
    """Longest-prefix normalisation through a compiled character map, with source alignment."""

    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, squeeze: bool = False, escape: bool = True):
        self.dummy_prefix, self.squeeze, self.escape = dummy_prefix, squeeze, escape
        self.units, self.blob = np.zeros(0, np.uint32), b""
        if charsmap:
            (n,) = struct.unpack_from("<I", charsmap)
            self.units, self.blob = np.frombuffer(charsmap, np.uint32, n // 4, 4), charsmap[4 + n:]

    @classmethod
    def of_model(cls, model: bytes) -> Normaliser:
        spec = next((v for f, v in _fields(model) if f == 3), b"")
        got = dict(_fields(spec))
        return cls(got.get(2, b""), bool(got.get(3, 1)), bool(got.get(4, 1)), bool(got.get(5, 1)))

    def _longest(self, data: bytes, at: int) -> tuple[int, int]:
        """Length of the longest key of the trie at a position and its value; (0, -1) if none."""
        best, u = (0, -1), self.units
        unit = int(u[0])
        node = (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(u):
                break
            unit = int(u[node])
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                best = (k + 1 - at, int(u[node]) & 0x7FFFFFFF)
        return best

    def __call__(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Normalised bytes, and for each the start and end of the original bytes that it comes from."""
        data = text.encode("utf-8", "surrogatepass")
        space = MARK.encode() if self.escape else b" "
        if not data:
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.units) and not self.squeeze:  # identity map: all in array steps
            raw = np.frombuffer(data, np.uint8)
            gap = raw == 32
            size = np.where(gap, len(space), 1)
            lead = np.full(raw.shape, 0)
            char = (raw & 0xC0) != 0x80
            first = np.maximum.accumulate(np.where(char, np.arange(len(raw)), 0))
            ends = np.append(np.flatnonzero(char)[1:], len(raw))
            last = ends[np.cumsum(char) - 1]
            start, end = np.repeat(first + lead, size), np.repeat(last, size)
            pre = len(space) if self.dummy_prefix else 0
            return (space if pre else b"") + data.replace(b" ", space), np.concatenate([np.zeros(pre, np.int64), start]), np.concatenate([np.zeros(pre, np.int64), end])
        out, lo, hi, at = bytearray(), [], [], 0
        pending: tuple[int, int] | None = None

        def put(piece: bytes, a: int, b: int) -> None:
            out.extend(piece)
            lo.extend([a] * len(piece))
            hi.extend([b] * len(piece))

        started = False
        while at < len(data):
            n, value = self._longest(data, at) if len(self.units) else (0, -1)
            if n:
                norm = self.blob[value:self.blob.index(0, value)]
            else:
                n = next((k for k in range(1, 5) if at + k >= len(data) or data[at + k] & 0xC0 != 0x80), 1)
                norm = data[at:at + n]
            for k, word in enumerate(re.split(b"( )", norm)):
                if word == b" ":
                    if not self.squeeze:
                        if not started and self.dummy_prefix:
                            put(space, 0, 0)
                        started = True
                        put(space, at, at + n)
                    elif started:
                        pending = pending or (at, at + n)
                elif word:
                    if not started and self.dummy_prefix:
                        put(space, 0, 0)
                    started = True
                    if pending:
                        put(space, *pending)
                        pending = None
                    put(word, at, at + n)
            at += n
        return bytes(out), np.array(lo, np.int64), np.array(hi, np.int64)


class Encoder:
    """The library's encoding of whole texts, each piece projected to the original bytes."""

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            raw = f.read()
        self.norm = Normaliser.of_model(raw)
        self.byte = np.array([dict(_fields(v)).get(3, 1) == 6 for f, v in _fields(raw) if f == 1])
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.size = np.array([1 if b else len(p.encode()) for p, b in zip(pieces, self.byte)], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1) if texts else []

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each piece in the original bytes."""
        _, lo, hi = self.norm(text)
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        arr = np.asarray(ids)
        size = self.size[arr]
        end = np.cumsum(size)
        if end[-1] != len(lo):  # an unknown piece covers whatever lies between its neighbours
            unk = np.flatnonzero(arr == self.sp.unk_id())
            if len(unk) == 1:
                size[unk] += len(lo) - end[-1]
                end = np.cumsum(size)
            else:
                return self._library_spans(text)
        start = end - size
        a, b = lo[start], hi[end - 1]
        byte = self.byte[arr]  # a byte piece is its own byte of the character
        if byte.any() and not len(self.norm.units):
            within = np.arange(len(lo)) - np.maximum.accumulate(np.where(np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])), np.arange(len(lo)), 0))
            a = np.where(byte, lo[start] + within[start], a)
            b = np.where(byte, a + 1, b)
        return a, b

    def _library_spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        pieces = self.sp.encode(text, out_type="proto").pieces
        return np.array([p.begin for p in pieces], np.int64), np.array([p.end for p in pieces], np.int64)

    def __call__(self, texts: list[str]) -> list:
        cols: list[list] = [[], [], [], [], [], []]
        for t, ids in zip(texts, self.encode(texts)):
            a, b = self.spans(t, ids)
            cols[5].append(zlib.crc32(np.stack([a, b], axis=1).astype("<u4").tobytes()))
            cols[0].append(len(ids))
            cols[1].append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            cols[2].append(hashlib.sha256(self.sp.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            cols[3].append(int((b - a).sum()))
            cols[4].append(int(b[-1]) if len(b) else 0)
        return cols


def encoder(path: str) -> Encoder:
    """One a worker."""
    return held(("pieces", path), lambda: Encoder(path))


#: span_bytes: original bytes under all pieces; last_byte: where the last piece ends in the original; spans_crc32: of all
#: starts and ends, in turn, as little-endian unsigned 32-bit integers.
ADDED = "n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long, last_byte long, spans_crc32 long"


def digests(docs: DataFrame, path: str) -> DataFrame:
    """docs without text, with the digest columns of its pieces and their spans."""
    return map_texts(docs, lambda: encoder(path), ADDED)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs without text, with ids, starts and ends: each piece's span of the original bytes."""

    def make():
        e = encoder(path)

        def run(texts):
            got = [(ids, *e.spans(t, ids)) for t, ids in zip(texts, e.encode(texts))]
            return [[g[0] for g in got], [g[1].tolist() for g in got], [g[2].tolist() for g in got]]

        return run

    return map_texts(docs, make, "ids array<int>, starts array<long>, ends array<long>")


def _path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), _path())


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: all rows and columns (null texts stay null and count as empty), with the digests of their pieces."""
    return add_to_texts(docs, lambda: encoder(_path()), ADDED)
