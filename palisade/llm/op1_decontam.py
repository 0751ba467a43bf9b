"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping windows of WINDOW characters (shorter items are one window) of normalised
text. A window with at most k edits against a text shares at least window - q + 1 - k*q of its q-grams with it, all
within a diagonal band of width k: q-gram hits are counted in overlapping bands of 2k + 1 or more diagonals, regions
that reach the bound are kept, and a banded alignment verifies each and reports its span and edits.

Items under MIN_CHARS normalised characters leave the lemma no useful bound; they are found exactly, as whole words.

Items are dealt in blocks of at most BLOCK_BYTES of text, of which each is broadcast and indexed once a worker; there is
one pass over the documents a block, so a benchmark of any size is searched whole with bounded memory.

Hits of a text are taken in slices, so memory is bounded whatever repeats; where a text repeats itself every 16 characters
or fewer for long, n_windows counts the matches at the ends of that stretch only.

Edge cases: null and empty texts and items match nothing; items with the same text are reported each; repeated rows are
searched alike; null ids are kept. Extra columns are ignored.
"""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from palisade.llm.common import filter_texts, held, steps

Q = 10
WINDOW, STEP = 120, 60
#: Edits allowed: a share of the window's characters.
EDIT_RATE = 0.075
MIN_CHARS = 40
BLOCK_BYTES = 2_000_000
#: Hits of a text (a place and a window's place with its q-gram) that are held at once, about.
SLICE_HITS = 1_000_000
#: Periods of repeating text of which only the ends are searched, where a text has more hits than that.
PERIODS = range(1, 17)
#: Bits of the table that sorts out q-grams of no item.
TABLE_BITS = 22
# A-Z lower-cased; ASCII other than digits and letters separates words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normalise(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_TABLE).split())


def budget(n: int) -> int:
    """Edits allowed in a window of n characters; such that the lemma's bound stays positive."""
    return max(0, min(int(n * EDIT_RATE), (n - Q) // Q))


def bound(n: int) -> int:
    """q-grams that a window of n characters shares at least with what lies within its budget."""
    return n - Q + 1 - budget(n) * Q


def gram_hashes(data: bytes) -> np.ndarray:
    """Hashes of all q-grams of a byte string."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.ndarray((n + Q - 8,), "<u8", data, 0, (1,))  # the eight bytes from each position on
    with np.errstate(over="ignore"):
        h = words[:n] * _A
        h ^= h >> np.uint64(31)
        h += words[Q - 8:Q - 8 + n]
        h *= _B
        h ^= h >> np.uint64(29)
    return h


class Windows:
    """An index of the windows of benchmark items: sorted q-gram hashes with their windows and places."""

    def __init__(self, items: list[tuple[int, str]]):
        self.windows: list[tuple[int, int, bytes]] = []  # item, offset, text
        short: dict[str, list[int]] = {}
        for item, text in items:
            norm = normalise(text or "")
            if len(norm) < MIN_CHARS:
                if norm:
                    short.setdefault(norm.decode("utf-8", "surrogatepass"), []).append(item)
                continue
            last = max(0, len(norm) - WINDOW)
            for off in sorted({*range(0, last + 1, STEP), last}):
                self.windows.append((item, off, norm[off:off + WINDOW]))
        self.short = ahocorasick.Automaton() if short else None
        for norm, owners in short.items():
            self.short.add_word(f" {norm} ", (len(norm), owners))
        if short:
            self.short.make_automaton()
        hashes, owner, place = [], [], []
        for k, (_, _, w) in enumerate(self.windows):
            h = gram_hashes(w)
            hashes.append(h)
            owner.append(np.full(len(h), k, np.int32))
            place.append(np.arange(len(h), dtype=np.uint8))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        h = cat(hashes, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.owner, self.place = h[order], cat(owner, np.int32)[order], cat(place, np.uint8)[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        self.budgets = np.array([budget(len(w)) for _, _, w in self.windows], np.int64)
        self.bounds = np.array([bound(len(w)) for _, _, w in self.windows], np.int64)
        self.least = min((bound(len(w)) for _, _, w in self.windows), default=1)
        self.span = max((len(w) + budget(len(w)) for _, _, w in self.windows), default=1)


def align(pattern: bytes, text: bytes, k: int, low: int, high: int) -> tuple[int, int, int] | None:
    """Best approximate occurrence of pattern in text on the diagonals low to high: (edits, start, end) within k
    edits, None otherwise. Rows of the pattern are kept to the band and to cells that can still end within k."""
    m, n = len(pattern), len(text)
    at = text.find(pattern)
    if at >= 0:
        return 0, at, at + m
    big = k + 1
    prev = {j: (0, j) for j in range(max(0, low), min(n, high) + 1)}
    none = (big, 0)
    for i in range(1, m + 1):
        c, cur = pattern[i - 1], {}
        left = none
        for j in range(max(0, low + i), min(n, high + i) + 1):
            best, s = prev.get(j, none)
            best += 1
            if j:
                e, f = prev.get(j - 1, none)
                e += text[j - 1] != c
                if e <= best:
                    best, s = e, f
                if left[0] + 1 < best:
                    best, s = left[0] + 1, left[1]
            if best <= k:
                left = cur[j] = (best, s)
            else:
                left = none
        if not cur:
            return None
        prev = cur
    return min((e, s, j) for j, (e, s) in prev.items())


def find(index: Windows, text: str) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) of every window and short item found in the text, places in normalised bytes."""
    data = normalise(text)
    return sorted({*_windows_in(index, data), *_short_in(index, data)})


def _short_in(index: Windows, data: bytes) -> list[tuple[int, int, int, int]]:
    if index.short is None:
        return []
    text = f" {data.decode('utf-8', 'surrogatepass')} "
    found = [(e - n, n, owners) for e, (n, owners) in index.short.iter(text)]
    places = [len(text[:at].encode("utf-8", "surrogatepass")) for at, _, _ in found] if not text.isascii() else [at for at, _, _ in found]
    return [(item, at - 1, at - 1 + len(text[c:c + n].encode("utf-8", "surrogatepass")), 0) for at, (c, n, owners) in zip(places, found) for item in owners]


def _outside_repeats(h: np.ndarray, at: np.ndarray, longest: int) -> np.ndarray:
    """Which of the places at are to be searched: in a stretch of text that repeats itself every few characters (PERIODS) for
    more than longest, those within half of that from its ends; its middle only has the same matches again."""
    skip = np.zeros(len(h) + 1, np.int64)
    for p in PERIODS:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (h[p:] == h[:-p]).astype(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a > longest:
                skip[a + longest // 2] += 1
                skip[b - longest // 2] -= 1
    return np.cumsum(skip)[at] == 0


def _bands(index: Windows, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> set[tuple[int, int, int]]:
    """(window, least, greatest diagonal) of the overlapping bands whose hits at the places at reach the window's bound."""
    regions: set[tuple[int, int, int]] = set()
    count = hi - lo
    if not count.sum():
        return regions
    flat = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    pos, owner = np.repeat(at, count), index.owner[flat]
    diag = pos - index.place[flat].astype(np.int64)
    width, bounds = index.budgets[owner] + 1, index.bounds
    for shift in (0, 1):  # overlapping bands: two widths long, one width apart
        band = (diag + (1 << 20) * 64) // width
        band = (band + shift) // 2
        order = np.lexsort((pos, band, owner))
        o, b = owner[order], band[order]
        first = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (b[1:] != b[:-1])))
        n = np.diff(np.append(first, len(o)))
        for f, size in zip(first[n >= bounds[o[first]]].tolist(), n[n >= bounds[o[first]]].tolist()):
            d = diag[order[f:f + size]]
            regions.add((int(o[f]), int(d.min()), int(d.max())))
    return regions


def _windows_in(index: Windows, data: bytes) -> list[tuple[int, int, int, int]]:
    if len(data) < MIN_CHARS - budget(MIN_CHARS) or not index.windows:
        return []
    h = gram_hashes(data)
    hit = index.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
    at = np.flatnonzero(hit)
    if len(at) < index.least:
        return []
    near = at[index.least - 1:] - at[:len(at) - index.least + 1] <= index.span  # enough hits within a window's reach
    if not near.any():
        return []
    mark = np.zeros(len(at) + 1, np.int64)
    w = np.flatnonzero(near)
    np.add.at(mark, w, 1)
    np.add.at(mark, w + index.least, -1)
    at = at[np.cumsum(mark[:-1]) > 0]
    lo, hi = np.searchsorted(index.hashes, h[at], "left"), np.searchsorted(index.hashes, h[at], "right")
    if (hi - lo).sum() > SLICE_HITS:
        keep = _outside_repeats(h, at, 4 * index.span)
        at, lo, hi = at[keep], lo[keep], hi[keep]
    regions: set[tuple[int, int, int]] = set()
    upto, i = np.cumsum(hi - lo), 0
    while i < len(at):  # slices overlap by a window's reach, so every occurrence lies in one of them
        j = int(max(np.searchsorted(upto, upto[i] + SLICE_HITS, "right"), np.searchsorted(at, at[i] + 2 * index.span, "right")))
        regions |= _bands(index, at[i:j], lo[i:j], hi[i:j])
        i = len(at) if j >= len(at) else max(i + 1, int(np.searchsorted(at, at[j - 1] - index.span + 1)))
    out, done = [], {}
    for k, d, d2 in sorted(regions):
        item, off, window = index.windows[k]
        e = budget(len(window))
        a, b = max(0, d - e), min(len(data), d2 + len(window) + e)
        if b <= done.get(k, -1):  # regions of a window come by their start: an earlier one reaches as far
            continue
        done[k] = b
        got = align(window, data[a:b], e, d - e - a, d2 + e - a)
        if got:
            out.append((item, a + got[1], a + got[2], got[0]))
    return out


def _blocks(benchmark: DataFrame):
    """Items in blocks of BLOCK_BYTES of text at most (a longer item is a block of its own)."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if block and size + len(r["text"]) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block:
        yield block


def _index(ref) -> Windows:
    """The index of a broadcast block of items, one a worker."""
    key, items = ref.value
    return held(("benchmark", key), lambda: Windows(items))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, start, end, edits (fewest) for every item of which a window is found in a document."""
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item_id long, n_windows long, start long, `end` long, edits int"
    for block in _blocks(benchmark):
        ref = spark.sparkContext.broadcast((uuid.uuid4().hex, block))

        def run(batches, ref=ref):
            index = _index(ref)
            for b in batches:
                keys, rows = b.column("doc_id"), []
                for key, t in ((keys[lo + i].as_py(), t) for lo, _, texts in steps(b.column("text")) for i, t in enumerate(texts)):
                    per: dict[int, list] = {}
                    for item, s, e, k in find(index, t):
                        per.setdefault(item, []).append((s, e, k))
                    rows += [(key, item, len(v), min(x[0] for x in v), max(x[1] for x in v), min(x[2] for x in v)) for item, v in sorted(per.items())]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "item_id", "n_windows", "start", "end", "edits"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a window of a benchmark item, or a short item as whole words, go. Null and empty
    texts stay, repeated rows fare alike, all columns stay, whatever their names; an empty benchmark drops nothing."""
    for block in _blocks(spark.read.parquet(f"{sf_dir}/benchmark.parquet")):
        ref = spark.sparkContext.broadcast((uuid.uuid4().hex, block))
        docs = filter_texts(docs, lambda ref=ref: lambda texts: [[bool(find(_index(ref), t)) for t in texts]], "found boolean", "not found")
    return docs
