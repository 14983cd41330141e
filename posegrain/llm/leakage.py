"""Finding held-out passages inside a large corpus.

Every item is cut into windows of its leak size (``window`` words, or the whole item if it is shorter), and so is
every document.  A window's SimHash is the majority vote, bit by bit, of the hashes of its word shingles, each
weighted by how often it stands there.  Fingerprints within a Hamming radius are found through four blocks of 16
bits: two fingerprints that differ in at most r bits differ in at most r // 4 bits of some block, and every value
that near is looked up, so none is lost.  The candidates are then verified by the exact weighted-shingle
similarity (Jaccard over shingle counts).  The radius follows from window, shingle and similarity (``radius_for``).

Only windows that can reach the similarity are fingerprinted: of m shingles, a window must share 2 m s / (1 + s) with
an item, so at least as many must be known from some item.  That bound is exact and costs one lookup a shingle.

The items are the query set: their windows are indexed by the executors, in parts of bounded size that lie in the
shared folder, and equal windows are indexed once with the list of their items.  The corpus is read once, without any
shuffle of its texts; a task goes through the parts for each batch of documents.  All the work on a document is
vectorised over code points: no word becomes a Python object.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from math import comb
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from posegrain.llm.skeleton import skeleton
from posegrain.session import materialize, open_shared

_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
CHUNK_CHARS = 1 << 21
CHUNK_WINDOWS = 1 << 15
CHUNK_PAIRS = 1 << 20
#: Fingerprints are looked up by four blocks of 16 bits.
BLOCKS, BLOCK_BITS = 4, 16


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


@cache
def _is_word() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@cache
def _powers(n: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, _P, np.uint64)))) if n > 1 else np.ones(1, np.uint64)


@cache
def _near_values(errors: int) -> np.ndarray:
    """All 16-bit masks with at most ``errors`` bits."""
    every = np.arange(1 << BLOCK_BITS, dtype=np.uint64)
    return every[np.bitwise_count(every) <= errors]


def plain(text: str) -> str:
    """Same-looking characters made equal, case folded, accents joined to their letters."""
    import unicodedata

    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", skeleton(text).casefold())


@dataclass
class Words:
    """The words of some texts laid end to end: code points, begin and end of each word, its text and its hash."""

    points: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    def text(self, at: int, n: int) -> list[str]:
        return ["".join(map(chr, self.points[self.begin[i] : self.end[i]])) for i in range(at, at + n)]


def words_of(texts: list[str]) -> Words:
    """Words are unbroken runs of letters or digits of the plain texts."""
    plains = [plain(t) for t in texts]
    joined = "\n".join(plains) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_word = _is_word()[points]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], is_word, [False])).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    bounds = np.cumsum(np.fromiter((len(p) + 1 for p in plains), np.int64, len(plains)))
    doc = np.searchsorted(bounds, begin, side="right")
    if not len(begin):
        return Words(points, begin, end, doc, np.zeros(0, np.uint64))
    length = end - begin
    inside = np.flatnonzero(is_word)
    first = np.cumsum(length) - length
    place = np.arange(len(inside)) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        terms = (points[inside].astype(np.uint64) + np.uint64(1)) * _powers(1 << int(length.max()).bit_length())[place]
        h = _mix(np.add.reduceat(terms, first) + length.astype(np.uint64) * _M2)
    return Words(points, begin, end, doc, h)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(size):
            out = out * _P + h[i : i + n]
        return _mix(out)


def simhashes(s: np.ndarray, m: int, at: np.ndarray | None = None) -> np.ndarray:
    """SimHash of the runs of m shingles that begin at ``at`` (None: of all): bit b is set if more than half of them have it."""
    at = np.arange(max(0, len(s) - m + 1)) if at is None else at
    if m == 1:
        return s[at]
    out = np.empty(len(at), np.uint64)
    kind = np.uint8 if m < 128 else np.uint32
    for lo in range(0, len(at), CHUNK_WINDOWS):
        part = at[lo : lo + CHUNK_WINDOWS]
        count = np.zeros((len(part), 64), kind)
        for j in range(m):
            count += np.unpackbits(s[part + j].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[lo : lo + len(part)] = np.packbits(count * kind(2) > m, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def shared_needed(m: int, similarity: float) -> int:
    """Shingles that two windows of m shingles must share for a weighted Jaccard of ``similarity``."""
    return max(1, int(np.ceil(2 * m * similarity / (1 + similarity) - 1e-9)))


@cache
def radius_for(m: int, similarity: float, recall: float = 0.95) -> int:
    """Hamming radius within which two windows of m shingles that just reach the similarity lie with probability ``recall`` or more.

    A bit differs when the votes of the shingles that are not shared turn the majority; shingle hashes are random, so both
    counts are binomial.  The radius is raised as far as the block lookups cover it at no cost (to 3 modulo 4).
    """
    shared = shared_needed(m, similarity)
    other = m - shared
    odds = lambda n: [comb(n, k) / 2**n for k in range(n + 1)]
    own = odds(other)
    flip = 0.0
    for c, p in enumerate(odds(shared)):
        above = sum(q for k, q in enumerate(own) if 2 * (c + k) > m)
        flip += p * 2 * above * (1 - above)
    reached, r = 0.0, -1
    while reached < recall and r < 64:
        r += 1
        reached += comb(64, r) * flip**r * (1 - flip) ** (64 - r)
    return min(64, r // BLOCKS * BLOCKS + BLOCKS - 1)


def _ranges(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the range, place in it) over all ranges, at most CHUNK_PAIRS at once, however long one range is."""
    upto = np.cumsum(size)
    for lo in range(0, int(upto[-1]) if len(upto) else 0, CHUNK_PAIRS):
        i = np.arange(lo, min(int(upto[-1]), lo + CHUNK_PAIRS))
        r = np.searchsorted(upto, i, side="right")
        yield r, start[r] + i - (upto[r] - size[r])


def _sieve(values: np.ndarray) -> np.ndarray:
    """A table that says of a hash, by its low bits, whether it may be among the values: never wrongly no."""
    table = np.zeros(1 << min(26, max(16, int(32 * len(values)).bit_length())), bool)
    table[(values & np.uint64(len(table) - 1)).astype(np.int64)] = True
    return table


@dataclass
class Windows:
    """The different item windows of one size, indexed by the blocks of their fingerprints.

    ``at`` is where a window begins in ``words``; the items that hold window u are owner[first[u]:first[u + 1]].
    """

    size: int
    shingle: int
    words: np.ndarray
    at: np.ndarray
    prints: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    sieve: np.ndarray
    order: list[np.ndarray]
    starts: list[np.ndarray]

    def near(self, prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (index into prints, item window) within the radius, in batches; a pair may come in several batches."""
        masks = _near_values(radius // BLOCKS)
        step = max(1, CHUNK_PAIRS // len(masks))
        for lo in range(0, len(prints), step):
            part = prints[lo : lo + step]
            for b in range(BLOCKS):
                value = ((part >> np.uint64(BLOCK_BITS * b)) & np.uint64((1 << BLOCK_BITS) - 1))[:, None] ^ masks
                value = value.astype(np.int64).ravel()
                start = self.starts[b][value]
                size = self.starts[b][value + 1] - start
                has = np.flatnonzero(size)
                for r, place in _ranges(start[has], size[has]):
                    p = lo + has[r] // len(masks)
                    w = self.order[b][place]
                    close = np.bitwise_count(prints[p] ^ self.prints[w]) <= radius
                    if close.any():
                        yield p[close], w[close]


def item_windows(texts: list[str | None], window: int, shingle: int) -> list[Windows]:
    """The index over the items' windows, one part a window size.  Items without words have none."""
    parts: dict[int, list[tuple[int, np.ndarray]]] = {}
    for number, text in enumerate(texts):
        h = words_of([text or ""]).hash
        size = min(window, len(h))
        if size:
            parts.setdefault(size, []).append((number, h))
    out = []
    for size, found in sorted(parts.items()):
        words = np.concatenate([h for _, h in found])
        begin = np.cumsum([0, *(len(h) for _, h in found)])
        at = np.concatenate([np.arange(a, b - size + 1) for a, b in zip(begin, begin[1:], strict=False)])
        item = np.repeat([number for number, _ in found], [len(h) - size + 1 for _, h in found])
        content = shingles(words, size)[at]
        _, example, u = np.unique(content, return_index=True, return_inverse=True)
        held = np.unique(u.astype(np.int64) * len(texts) + item)  # an item holds a repeated window once
        first = np.searchsorted(held, np.arange(len(example) + 1) * len(texts))
        k = min(shingle, size)
        s = shingles(words, k)
        prints = simhashes(s, size - k + 1, at[example])
        inside = np.unique(s[(at[:, None] + np.arange(size - k + 1)).ravel()]) if len(at) * size < 1 << 26 else np.unique(s)
        order, starts = [], []
        for b in range(BLOCKS):
            key = ((prints >> np.uint64(BLOCK_BITS * b)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
            order.append(np.argsort(key, kind="stable").astype(np.int32))
            starts.append(np.concatenate(([0], np.cumsum(np.bincount(key, minlength=1 << BLOCK_BITS)))))
        out.append(Windows(size, k, words, at[example], prints, first, (held % len(texts)).astype(np.int32), _sieve(inside), order, starts))
    return out


def _numbered(codes: np.ndarray) -> np.ndarray:
    """Rows of shingle hashes with each made different from its earlier copies in the row: multisets become sets."""
    m = codes.shape[1]
    earlier = np.zeros(codes.shape, np.uint64)
    for j in range(1, m):
        earlier[:, j] = (codes[:, :j] == codes[:, j, None]).sum(1)
    with np.errstate(over="ignore"):
        return _mix(codes + earlier * _M2)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, sum of the smaller over sum of the larger shingle counts; both have the same number of shingles a row."""
    n, m = a.shape
    out = np.empty(n)
    step = max(1, (1 << 22) // (m * m))
    for lo in range(0, n, step):
        x, y = _numbered(a[lo : lo + step]), _numbered(b[lo : lo + step])
        both = (x[:, :, None] == y[:, None, :]).any(2).sum(1)
        out[lo : lo + step] = both / (2 * m - both)
    return out


def _best(keys: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with its largest similarity."""
    order = np.lexsort((-sim, keys))
    keys, sim = keys[order], sim[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], sim[first]


def _merged(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _best(np.concatenate([k for k, _ in rows]), np.concatenate([s for _, s in rows])) if rows else (np.zeros(0, np.int64), np.zeros(0))


def _scan_size(w: Words, s: np.ndarray, part: Windows, radius: int, similarity: float, n_items: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of the texts x n_items + item, similarity; 2.0 for the same words in order) of one window size."""
    m = part.size - part.shingle + 1
    if len(w.hash) < part.size:
        return _merged([])
    known = np.concatenate(([0], np.cumsum(part.sieve[(s & np.uint64(len(part.sieve) - 1)).astype(np.int64)])))
    whole = (w.doc[: len(w.doc) - part.size + 1] == w.doc[part.size - 1 :]) & (known[m:] - known[:-m] >= shared_needed(m, similarity))
    at = np.flatnonzero(whole)
    if not len(at):
        return _merged([])
    # equal windows of the texts are looked up once
    _, example, same_as = np.unique(shingles(w.hash, part.size)[at], return_index=True, return_inverse=True)
    spots = at[example]
    place, words = np.arange(m), np.arange(part.size)
    mine = shingles(part.words, part.shingle)
    got: list[tuple[np.ndarray, np.ndarray]] = []
    for p, u in part.near(simhashes(s, m, spots), radius):
        pair, _ = _best(p * len(part.at) + u, np.zeros(len(p)))
        p, u = pair // len(part.at), pair % len(part.at)
        sim = weighted_jaccard(s[spots[p][:, None] + place], mine[part.at[u][:, None] + place])
        p, u, pair, sim = (x[sim >= similarity] for x in (p, u, pair, sim))
        equal = (w.hash[spots[p][:, None] + words] == part.words[part.at[u][:, None] + words]).all(1)
        got.append((pair, np.where(equal, 2.0, sim)))
    pair, sim = _merged(got)
    # from different windows to all of them, and from item windows to their items
    p, u = pair // len(part.at), pair % len(part.at)
    by_example = np.argsort(same_as, kind="stable")
    bounds = np.searchsorted(same_as[by_example], np.arange(len(example) + 1))
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for r, i in _ranges(part.first[u], part.first[u + 1] - part.first[u]):
        key, best = _best(p[r] * n_items + part.owner[i], sim[r])
        rows.append((key, best))
    key, best = _merged(rows)  # (different window, item)
    p, item = key // n_items, key % n_items
    rows = []
    for r, i in _ranges(bounds[p], bounds[p + 1] - bounds[p]):
        rows.append((at[by_example[i]] * n_items + item[r], best[r]))
    return _merged(rows)


def scan(w: Words, index: list[Windows], similarity: float, n_items: int, radius: int | None = None) -> tuple[np.ndarray, ...]:
    """Text number, item number, windows of the text that hold a passage of the item, best similarity, whether one is word for word."""
    rows = []
    by_shingle: dict[int, np.ndarray] = {}
    for part in index:
        s = by_shingle.setdefault(part.shingle, shingles(w.hash, part.shingle))
        r = radius_for(part.size - part.shingle + 1, similarity) if radius is None else radius
        rows.append(_scan_size(w, s, part, r, similarity, n_items))
    key, sim = _merged(rows)  # an item has windows of one size
    pair = w.doc[key // n_items] * n_items + key % n_items
    order = np.argsort(pair, kind="stable")
    pair, sim = pair[order], sim[order]
    first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
    top = np.maximum.reduceat(sim, first) if len(first) else sim
    return pair[first] // n_items, pair[first] % n_items, np.diff(np.append(first, len(pair))), np.minimum(top, 1.0), top > 1


@lru_cache(maxsize=1)
def _load(uri: str) -> list[tuple[list, list[Windows]]]:
    """The parts of the index that one file holds."""
    import pyarrow.parquet as pq

    with open_shared(uri) as f:
        return [pickle.loads(x) for x in pq.read_table(f, columns=["data"]).column(0).to_pylist()]


def index_items(items: DataFrame, item_id: str, text: str, window: int, shingle: int, part_chars: int) -> list[str]:
    """Index the items in parts of about ``part_chars`` characters, one task a part; returns the files of the shared folder that hold them."""
    rows = items.select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t")).where("t is not null")
    n_parts = max(1, -(-(rows.agg(F.sum(F.length("t"))).first()[0] or 0) // part_chars))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((ids, item_windows(texts, window, shingle)))], pa.binary())], names=["data"])

    parts = materialize(rows.repartition(n_parts, F.xxhash64("i", "t", F.monotonically_increasing_id())).mapInArrow(build, "data binary"), "item-windows")
    return sorted(parts.inputFiles())


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = 12, shingle: int = 1, similarity: float = 0.8, radius: int | None = None, part_chars: int = 8_000_000) -> DataFrame:
    """(item_id, doc_id, n_windows, similarity, in_order): documents that hold a passage of an item.

    A passage is a window of ``window`` consecutive words of the item (the whole item if shorter).  A document holds it
    if one of its own windows of that size has a weighted-shingle similarity of ``similarity`` or more and a fingerprint
    within ``radius`` bits (None: as ``radius_for`` gives); ``n_windows`` counts these windows of the document,
    ``similarity`` is the best one, and ``in_order`` says that some window stands there word for word.

    Shingles of one word let a window of 12 words pass with one word exchanged, dropped or put in (11 of 13 are shared).
    With ``shingle`` 5 and 0.8 only equal windows of up to 12 words pass.  Case, punctuation, line breaks and same-looking
    characters do not matter.  Null texts and texts without words hold and are nothing; repeated items and documents
    each get their rows.  No item and no text comes to the driver, and a task holds one part of the index at a time.
    """
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    files = index_items(items, item_id, text, window, shingle, part_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            chunks = []
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= CHUNK_CHARS):
                    chars += len(texts[hi])
                    hi += 1
                chunks.append((lo, words_of(texts[lo:hi])))
                lo = hi
            for uri in files:
                for ids, index in _load(uri):
                    for lo, w in chunks:
                        d, i, n, sim, same = scan(w, index, similarity, len(ids), radius)
                        if len(d):
                            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in i], arrow), names.take(pa.array(lo + d)), pa.array(n, pa.int64()), pa.array(sim, pa.float64()), pa.array(same)], names=["i", "d", "n_windows", "similarity", "in_order"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(items.schema[item_id].dataType)
    corpus = docs.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t")).where("t is not null")
    found = corpus.mapInArrow(run, f"i {kinds[1]}, d {kinds[0]}, n_windows bigint, similarity double, in_order boolean")
    return found.select(F.col("i").alias(item_id), F.col("d").alias(doc_id), "n_windows", "similarity", "in_order")
