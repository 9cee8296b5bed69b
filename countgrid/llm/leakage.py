"""Passages of held-out items inside a corpus, found by SimHash fingerprints of windows.

Two sorts of windows find two sorts of leaks. Parts of items: each item is cut into all
its passages of ``window`` words, and every run of as many words of every document is
compared with them. Whole items with edits: item-sized windows, of the largest size in a
series of sizes (each about 1.4 times the one before) that an item holds, at its
begin and its end. Windows and passages get 64-bit SimHash fingerprints; an index of
``radius + 1`` bit blocks finds all passages within ``radius`` bits of a window (one block
must agree by the pigeonhole principle); each candidate is then verified by an exact
weighted-shingle similarity. The corpus is never shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countgrid.llm.words import batches, mix64, words_of
from countgrid.session import Scratch

WINDOW = 12
RADIUS = 2
SHINGLE = 5
#: Smallest item-sized window, and the radius that item-sized windows need: an edit rate of 2 % moves
#: a fingerprint by 64 / pi * sqrt(2 * 0.02) = 4 bits on average and by at most 7 in 95 of 100 windows.
ITEM_WINDOW = 24
ITEM_RADIUS = 7
#: Passages broadcast at once, at about 60 bytes each. More are searched in further passes over the corpus.
CHUNK_PASSAGES = 1_000_000
#: Words or candidates handled at once.
STEP = 4_000_000
_ONE = np.uint64(1)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The sum of two numbers per bit position, each given as planes of bits, lowest first."""
    out, carry = [], np.zeros_like(a[0])
    for k in range(max(len(a), len(b))):
        x = a[k] if k < len(a) else np.zeros_like(carry)
        y = b[k] if k < len(b) else np.zeros_like(carry)
        half = x ^ y
        out.append(half ^ carry)
        carry = (x & y) | (carry & half)
    return [*out, carry]


def simhash(hashes: np.ndarray, window: int) -> np.ndarray:
    """Fingerprints of all runs of ``window`` hashes: each bit is the majority of that bit.

    The 64 counts of a run are kept as bit planes and added up as in a carry
    tree, so a run costs a few dozen word operations whatever its 64 counters.
    """
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = {1: [hashes]}  # planes of the sums of runs of powers of two
    size = 1
    while size * 2 <= window:
        planes = sums[size]
        short = len(planes[0]) - size
        sums[size * 2] = _add([p[:short] for p in planes], [p[size:] for p in planes])
        size *= 2
    total, at = None, 0
    while size:
        if window & size:
            part = [p[at : at + n] for p in sums[size]]
            total = part if total is None else _add(total, part)
            at += size
        size //= 2
    # more than half: adding 2**k - threshold must carry out of k planes
    k = len(total)
    constant = (1 << k) - (window // 2 + 1)
    carry = np.zeros(n, np.uint64)
    for bit, plane in enumerate(total):
        carry = (plane | carry) if constant >> bit & 1 else (plane & carry)
    return carry


class Passages(NamedTuple):
    """Distinct passages of one size, and where they occur."""

    size: int
    start: np.ndarray  # place of the first occurrence in the library's words
    prints: np.ndarray
    bounds: np.ndarray  # of the occurrences of each passage
    text: np.ndarray  # item text of each occurrence
    place: np.ndarray  # first word of each occurrence in its text


class Library(NamedTuple):
    """Distinct item texts as one array of word hashes, with the weight of the shingle at each word, the begin of each text and its ids."""

    words: np.ndarray
    weights: np.ndarray
    starts: np.ndarray
    owner_bounds: np.ndarray
    owners: np.ndarray
    passages: list[Passages]


class BlockIndex:
    """Fingerprints by each of ``radius + 1`` bit blocks."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius, self.blocks = prints, radius, []
        edges = np.linspace(0, 64, radius + 2).astype(int)
        for low, high in zip(edges[:-1], edges[1:]):
            bits = min(int(high - low), 24)  # a longer block is looked up by 24 of its bits
            key = self._key(prints, int(low), bits)
            order = np.argsort(key, kind="stable")
            values, first, count = np.unique(key[order], return_index=True, return_counts=True)
            present = np.zeros(1 << bits, bool)
            present[values] = True
            self.blocks.append((int(low), bits, order, values, first, count, present))

    @staticmethod
    def _key(prints: np.ndarray, low: int, bits: int) -> np.ndarray:
        return ((prints >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (position, fingerprint number) within the radius, each pair once."""
        found = []
        for low, bits, order, values, first, count, present in self.blocks:
            key = self._key(prints, low, bits)
            hit = np.nonzero(present[key])[0]
            row = np.searchsorted(values, key[hit])
            # no more candidates at once than STEP, but for a single window
            total = np.cumsum(count[row])
            at = 0
            while at < len(hit):
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, side="right")))
                times = count[row[at:end]]
                left = np.repeat(hit[at:end], times)
                within = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
                right = order[np.repeat(first[row[at:end]], times) + within]
                close = np.bitwise_count(prints[left] ^ self.prints[right]) <= self.radius
                found.append(left[close].astype(np.int64) * len(self.prints) + right[close])
                at = end
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        m = max(len(self.prints), 1)
        return both // m, both % m


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``size`` words of each row."""
    size = min(size, words.shape[1])
    n = words.shape[1] - size + 1
    out = np.zeros((len(words), n), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(0x100000001B3) + words[:, k : k + n]
    return out


def weighted_similarity(a: np.ndarray, b: np.ndarray, weight: np.ndarray, in_a: np.ndarray | None = None, in_b: np.ndarray | None = None) -> np.ndarray:
    """Weighted Jaccard of the shingles of paired rows; ``weight`` holds b's shingle weights.

    A shingle of ``a`` that ``b`` lacks weighs as much as the mean one of ``b``. Rows of
    different lengths are padded; ``in_a`` and ``in_b`` then tell which shingles count.
    """
    sa, sb = shingles(a), shingles(b)
    in_a = np.ones(sa.shape, bool) if in_a is None else in_a
    in_b = np.ones(sb.shape, bool) if in_b is None else in_b
    keyed = lambda s: mix64(s + mix64(np.arange(len(s), dtype=np.uint64))[:, None])  # noqa: E731 - equal only within a row
    with np.errstate(over="ignore"):
        sa, sb = keyed(sa), keyed(sb)
    weight = np.where(in_b, weight, 0.0)
    common = (np.isin(sb, sa[in_a]) * weight).sum(axis=1)
    alien = (~np.isin(sa, sb[in_b]) & in_a).sum(axis=1) * (weight.sum(axis=1) / np.maximum(in_b.sum(axis=1), 1))
    return common / np.maximum(weight.sum(axis=1) + alien, 1e-300)


def item_words(items: DataFrame, item_id: str, text: str, least: int) -> DataFrame:
    """``item_id, words``: the hashes of the words of each item that has at least so many."""

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for first, texts in batches(frame.column(1)):
                found = words_of(texts)
                ids = frame.column(0).slice(first, len(texts))
                lists = pa.ListArray.from_arrays(pa.array(found.bounds.astype(np.int32)), pa.array(found.hashes.view(np.int64)))
                use = pa.array(np.diff(found.bounds) >= least)
                yield pa.RecordBatch.from_arrays([ids.filter(use), lists.filter(use)], ["item_id", "words"])

    wanted = items.select(F.col(f"`{item_id}`").cast("bigint").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return wanted.filter("item_id IS NOT NULL AND text IS NOT NULL").mapInArrow(cut, "item_id bigint, words array<bigint>")


def item_window(length: int) -> int:
    """The largest item-sized window that a text of so many words holds; 0 for none."""
    if length < ITEM_WINDOW:
        return 0
    k = int(2 * np.log2(length / ITEM_WINDOW) + 1)
    return max(w for w in (round(ITEM_WINDOW * 2 ** (i / 2)) for i in range(k + 1)) if w <= length)


def library(rows: pa.Table, window: int | None) -> Library:
    """The passages of the given items (``item_id, words``), of ``window`` words each or item-sized."""
    lists = rows["words"].combine_chunks()
    flat, bounds = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    ids = rows["item_id"].to_numpy()
    # equal texts once: by a 64-bit hash of all words, their length and first word
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(flat + np.uint64(0x9E3779B97F4A7C15) * (np.arange(len(flat), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64))), dtype=np.uint64)])
        whole = sums[bounds[1:]] - sums[bounds[:-1]]
    _, first, group = np.unique(np.stack([whole, np.diff(bounds).astype(np.uint64)], 1), axis=0, return_index=True, return_inverse=True)
    group = group.ravel()
    order = np.lexsort((ids, group))
    owner_bounds = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(first)))])
    sizes = np.diff(bounds)[first]
    words = np.concatenate([flat[bounds[i] : bounds[i + 1]] for i in first]) if len(first) else flat[:0]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    grams = shingles(words[None], SHINGLE)[0] if len(words) >= SHINGLE else np.zeros(0, np.uint64)
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    inside = text_of[: len(grams)] == text_of[SHINGLE - 1 :] if len(grams) else np.zeros(0, bool)
    weights = np.ones(len(words))
    _, back, count = np.unique(grams[inside], return_inverse=True, return_counts=True)
    weights[: len(grams)][inside] = 1.0 / (1.0 + np.log(count[back.ravel()])) if len(count) else 1.0
    made = []
    if window is not None:
        n = np.maximum(sizes - window + 1, 0)
        made.append((window, np.repeat(np.arange(len(sizes)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)))
    else:
        own = np.array([item_window(int(k)) for k in sizes], np.int64)
        for size in np.unique(own[own > 0]).tolist():
            texts = np.nonzero(own == size)[0]
            spots = np.unique(np.concatenate([np.stack([texts, np.zeros_like(texts)], 1), np.stack([texts, sizes[texts] - size], 1)]), axis=0)
            made.append((size, spots[:, 0], spots[:, 1]))
    return Library(words, weights, starts, owner_bounds, ids[order], [_passages(words, starts, *m) for m in made])


def _passages(words: np.ndarray, starts: np.ndarray, size: int, text: np.ndarray, place: np.ndarray) -> Passages:
    at = starts[text] + place
    prints = simhash(words, size)
    keys = shingles(words[None], size)[0] if len(words) >= size else np.zeros(0, np.uint64)
    _, first, group = np.unique(np.stack([keys[at], words[at]], 1), axis=0, return_index=True, return_inverse=True)
    group = group.ravel()
    order = np.lexsort((place, text, group))
    bounds = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(first)))])
    return Passages(size, at[first], prints[at[first]], bounds, text[order], place[order])


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "item_text",
    *,
    window: int | None = WINDOW,
    radius: int | None = None,
    min_similarity: float = 0.8,
    chunk_passages: int = CHUNK_PASSAGES,
) -> DataFrame:
    """One row per document and item with a shared passage: ``doc_id``, ``item_id``,
    ``windows`` (matching window pairs), ``similarity`` (of the best pair), and
    ``doc_word``, ``item_word`` (where the best pair begins).

    With a ``window`` in words, parts of items of that length are sought, within 2 bits unless
    ``radius`` says otherwise; with None, item-sized windows, within 7 bits. All windows within the
    radius are found; those are kept whose weighted similarity of 5-word shingles is at least
    ``min_similarity``, for item-sized windows that of the whole item to the run beside it. It is 1.0
    only where all words are equal one by one. At 0.8 one changed word needs 49 words and two need
    99, so 12-word windows find exact parts only and item-sized ones find edited copies of items from 49 words.

    Defined results for odd input: null ids and null, empty or short texts (under ``window`` words,
    or under 24 for item-sized windows) give no rows; repeated document rows or items in several
    suites each count for their own ids; empty tables give an empty result; other columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "leaks")
    radius = (ITEM_RADIUS if window is None else RADIUS) if radius is None else radius
    least = window or ITEM_WINDOW
    known = scratch.keep(item_words(items, item_id, item_text, least))
    count = F.size("words") - least + 1 if window else F.lit(2)
    total = known.agg(F.sum(count)).first()[0] or 0
    chunks = max(1, -(-total // chunk_passages))
    corpus = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{doc_text}`").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    schema = "doc_id bigint, item_id bigint, windows bigint, similarity double, doc_word bigint, item_word bigint"
    parts = []
    for chunk in range(chunks):
        # about chunk_passages rows: the bound of what is collected and broadcast; equal texts stay together
        own = known if chunks == 1 else known.filter(F.pmod(F.xxhash64("words"), F.lit(chunks)) == chunk)
        shared = spark.sparkContext.broadcast(library(own.toArrow(), window))
        parts.append(scratch.keep(corpus.mapInArrow(_search(shared, radius, min_similarity, window is None), schema)))
        shared.destroy()
    out = functools.reduce(DataFrame.unionByName, parts)
    # Only found rows are shuffled here: documents may come twice, and a leak may lie in several chunks.
    best = F.max(F.struct("similarity", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("b")
    out = out.groupBy("doc_id", "item_id").agg(F.sum("windows").alias("windows"), best)
    return out.select("doc_id", "item_id", "windows", "b.similarity", (-F.col("b.d")).alias("doc_word"), (-F.col("b.i")).alias("item_word"))


def _search(shared, radius: int, min_similarity: float, items: bool):
    state: dict = {}

    def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            state["library"] = shared.value
            state["index"] = [BlockIndex(p.prints, radius) for p in shared.value.passages]
        known = state["library"]
        for frame in frames:
            ids = frame.column(0).to_numpy(zero_copy_only=False)
            for first, texts in batches(frame.column(1)):
                found = words_of(texts)
                own = ids[first : first + len(texts)]
                hits = [_matches(found, known, p, index, min_similarity, items) for p, index in zip(known.passages, state["index"]) if len(p.prints)]
                yield _leaks(own, found, known, hits)

    return search


def _matches(found, known: Library, p: Passages, index: BlockIndex, min_similarity: float, items: bool) -> tuple[np.ndarray, ...]:
    """Text, item text, similarity, and places in both of every window that matches a passage.

    For ``items`` the whole item is compared with the run of the document that lies beside it where window and passage meet.
    """
    w = p.size
    prints = simhash(found.hashes, w)
    text_of = np.repeat(np.arange(len(found.bounds) - 1), np.diff(found.bounds))
    whole = np.nonzero(text_of[: len(prints)] == text_of[w - 1 :])[0] if len(prints) else np.zeros(0, np.int64)
    at, passage = index.near(prints[whole])
    at = whole[at]
    if not items:
        score = _scored(found.hashes, at, at + w, known, p.start[passage], p.start[passage] + w)
        good = score >= min_similarity
        at, passage, score = at[good], passage[good], score[good]
    times = p.bounds[passage + 1] - p.bounds[passage]
    rows = np.repeat(np.arange(len(at)), times)
    own = np.repeat(p.bounds[passage], times) + np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
    at, item, place = at[rows], p.text[own], p.place[own]
    text = text_of[at]
    if items:
        low, high = known.starts[item], known.starts[item + 1]
        begin = np.maximum(at - place, found.bounds[text])
        end = np.minimum(at - place + high - low, found.bounds[text + 1])
        score = _scored(found.hashes, begin, end, known, low, high)
        good = score >= min_similarity
        return text[good], item[good], score[good], (begin - found.bounds[text])[good], np.zeros(int(good.sum()), np.int64)
    return text, item, score[rows], at - found.bounds[text], place


def _scored(words: np.ndarray, begin: np.ndarray, end: np.ndarray, known: Library, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Similarity of runs of document words to runs of library words; 1 only where all words are equal."""
    out = np.zeros(len(begin))
    order = np.argsort(high - low, kind="stable")  # runs of like length share a padded block
    at = 0
    while at < len(order):
        width = int((high - low)[order[min(len(order), at + 4096) - 1]])
        part = order[at : at + min(4096, max(1, STEP // max(width, 1)))]
        at += len(part)
        width = max(int((high - low)[part].max()), SHINGLE)
        a_at, b_at = begin[part, None] + np.arange(width), low[part, None] + np.arange(width)
        in_a, in_b = a_at < end[part, None], b_at < high[part, None]
        a = np.where(in_a, words[np.minimum(a_at, len(words) - 1)], np.uint64(0))
        b = np.where(in_b, known.words[np.minimum(b_at, len(known.words) - 1)], np.uint64(0))
        n = width - SHINGLE + 1
        weight = known.weights[np.minimum(b_at[:, :n], len(known.weights) - 1)]
        score = weighted_similarity(a, b, weight, in_a[:, SHINGLE - 1 :], in_b[:, SHINGLE - 1 :])
        same = ((a == b) & (in_a == in_b)).all(axis=1)
        out[part] = np.where(same, 1.0, np.minimum(score, 1.0 - 1e-9))
    return out


def _leaks(ids: np.ndarray, found, known: Library, hits: list[tuple]) -> pa.RecordBatch:
    """The best match of each document and item text, for every item with that text."""
    text, item, score, spot, place = (np.concatenate(c) for c in zip(*hits)) if hits else [np.zeros(0, np.int64)] * 5
    order = np.lexsort((place, spot, -score, item, text))
    text, item, score, spot, place = (c[order] for c in (text, item, score, spot, place))
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
    head = np.nonzero(new)[0]
    windows = np.diff(np.concatenate([head, [len(text)]]))
    times = known.owner_bounds[item[head] + 1] - known.owner_bounds[item[head]]
    rows = np.repeat(np.arange(len(head)), times)
    owner = np.repeat(known.owner_bounds[item[head]], times) + np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
    at = head[rows]
    cols = [np.asarray(ids)[text[at]].astype(np.int64), known.owners[owner].astype(np.int64), windows[rows].astype(np.int64), score[at].astype(np.float64), spot[at].astype(np.int64), place[at].astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc_id", "item_id", "windows", "similarity", "doc_word", "item_word"])
