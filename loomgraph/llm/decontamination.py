"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. The document frequency of every n-gram of the items is counted over all documents.
2. An alignment at the threshold keeps at least `need` of its item's n-grams (see `least_shared`), so it keeps one of
   those that are left without the item's need - 1 most frequent ones: these are the item's seeds. The n-grams are as
   long as n allows while need is at least 1 for the shortest item (2 words at 0.6), so no copy is without a seed.
3. A document that holds a seed and need n-grams of the item is aligned with it around their places. First the share of
   the item's words that occur there bounds the score from above; then the local alignment (match 2, change -1, gap -1),
   divided by that of a full match, must reach `threshold`. Every pair that reaches it is found: a matched run that holds
   one of the shared n-grams lies in the ranges that are aligned, which reach as far to both sides of it as an alignment
   at the threshold can (the item's length and the gaps that its score allows).

Texts and items are first made NFKC and case-folded, in all scripts. Words are runs of ASCII letters and digits and of
all characters beyond ASCII in what comes of it; first_word and last_word count these. The documents' words are hashed
and stored once (8 bytes a word, in the shared folder). Items are joined in blocks of about `block_bytes` of text, which
bounds what the driver and a task hold whatever the items' number and length; every block meets all documents' hashes.
Items of exact_words to least_words - 1 words are too short for edits: they must stand whole. Shorter ones cannot be told
from chance and take no part.

Cases: null and empty texts and items meet nothing; very long texts are aligned whole, around the seeds, in overlapping
blocks that bound the memory whatever the text and item repeat. Repeated
documents are reported once for each id and item, with the best score; null ids are reported as null, as one. Repeated
items count once, and an id with several texts has the best of them. Other columns do not pass. Empty tables give an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w
from .licenses import _words as _plain_words
from .tables import stored

SCHEMA = "doc_id long, item_id long, score double, first_word long, last_word long"
BLOCK = 1 << 16  # words of text that are aligned at a time, besides an overlap
OWNERS = 1 << 20  # seeds met with their items at a time
SLIP = 1e-9  # what floating point may add to a whole number


def _folded(text: str) -> str:
    if text.isascii():
        return text.lower()
    return normalize("NFKC", normalize("NFKC", text).casefold())


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the folded texts, and each text's first word."""
    raw = (t.decode("utf-8", "surrogateescape") for t in pc.fill_null(texts, "").cast(pa.binary()).to_pylist())
    folded = pa.array([_folded(t).encode("utf-8", "surrogateescape") for t in raw], pa.large_binary())
    _, offsets, data = folded.buffers()
    _, _, hashes, first = _plain_words(pa.LargeStringArray.from_buffers(len(folded), offsets, data))
    return hashes, first


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of the whole of item with any part of text, and where it ends first: in text, in item."""
    row = np.zeros(len(text) + 1, np.int32)
    step = np.arange(len(text) + 1, dtype=np.int32)
    best, end, last = 0, 0, 0
    for k, word in enumerate(item):
        new = np.maximum(row - 1, 0)
        np.maximum(new[1:], row[:-1] + np.where(text == word, np.int32(2), np.int32(-1)), out=new[1:])
        row = np.maximum.accumulate(new + step) - step
        at = int(row.argmax())
        if row[at] > best:
            best, end, last = int(row[at]), at, k
    return best, end, last


def least_shared(size: int, n: int, threshold: float) -> int:
    """How many n-grams of an item of size words every alignment at the threshold keeps.

    m matches and e edits score 2m - e >= 2 * threshold * size, and stand in at most e + 1 runs. A run of l matches keeps
    l - n + 1 n-grams or none, so m - (n - 1)(e + 1) are kept or more, the least at m = size."""
    if n == 1:
        return ceil(threshold * size - SLIP)
    return ceil(size - (n - 1) * (2 * size * (1 - threshold) + 1) - SLIP)


class Seeds:
    """The items of a block and the places of their n-grams."""

    def __init__(self, items: list[tuple[int, str | None]], n: int, threshold: float, least_words: int, exact_words: int):
        split = [(i, _words(pa.array([t], pa.string()))[0]) for i, t in items]
        self.items = [(i, x) for i, x in split if len(x) >= max(1, min(least_words, exact_words))]
        self.least = [threshold if len(x) >= least_words else 1.0 for _, x in self.items]
        own = {(len(x), t) for (_, x), t in zip(self.items, self.least, strict=True)}
        self.n = max(k for k in range(1, n + 1) if k == 1 or all(k <= size and least_shared(size, k, t) >= 1 for size, t in own))
        grams = [w.mix(w.windows(x, self.n)) for _, x in self.items]
        self.every, self.gram = np.unique(np.concatenate([np.empty(0, np.uint64), *grams]), return_inverse=True)
        self.first = np.cumsum([0] + [len(g) for g in grams])  # of each item's places in self.gram
        self.need = np.array([max(1, least_shared(len(x), self.n, t)) for (_, x), t in zip(self.items, self.least, strict=True)], np.int64)

    def choose(self, frequency: np.ndarray) -> None:
        """frequency: of each gram of self.every."""
        owners = [np.empty((0, 2), np.int64)]
        for k, (a, b) in enumerate(zip(self.first[:-1], self.first[1:], strict=True)):
            rare = np.argsort(frequency[self.gram[a:b]], kind="stable")[: b - a - self.need[k] + 1]
            seeds = np.unique(self.gram[a:b][rare])
            owners.append(np.stack([seeds, np.full(len(seeds), k)], axis=1))
        owned = np.concatenate(owners)
        owned = owned[np.argsort(owned[:, 0], kind="stable")]
        self.owner = owned[:, 1]
        self.owned = np.searchsorted(owned[:, 0], np.arange(len(self.every) + 1))  # where each gram's owners begin


def _met(grams: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Number of the known gram, else -1."""
    if not len(known):
        return np.full(len(grams), -1)
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    return np.where(known[at] == grams, at, -1)


def _spread(first: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places first[k] to first[k + 1] of each key, and the number of the key that each is of."""
    size = first[keys + 1] - first[keys]
    own = np.repeat(np.arange(len(keys)), size)
    return np.arange(len(own)) + np.repeat(first[keys] - np.cumsum(size) + size, size), own


def _regions(low: np.ndarray, high: np.ndarray, reach: int, words: int) -> Iterator[tuple[int, int]]:
    """Ranges of text to align, from those of the seeds. Ranges that meet are one, which comes in blocks that overlap by
    the reach of an alignment, so that each alignment at the threshold lies whole in a block."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    cut = np.flatnonzero(low[1:] > high[:-1])
    for a, b in zip(low[np.append(0, cut + 1)].tolist(), high[np.append(cut, len(low) - 1)].tolist(), strict=True):
        a, b = max(0, a), min(words, b)
        for k in range(a, max(a + 1, b - reach), BLOCK):
            yield k, min(b, k + BLOCK + reach)


def contaminated(docs: DataFrame, items: DataFrame, n: int = 3, threshold: float = 0.6, least_words: int = 6, exact_words: int = 3, block_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score (0 to 1), first_word and last_word of the aligned stretch, for each pair at the threshold."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null").distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("b")).first()["b"]  # one number
    parts = max(1, -(-size // block_bytes))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                hashes, first = _words(part["text"])
                blobs = [hashes[a:b].astype("<u8").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(blobs, pa.binary())], names=["doc_id", "words"])

    words = stored(chosen.where("text is not null").mapInArrow(hashed, "doc_id long, words binary"))
    found = [_found(words, [tuple(r) for r in asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()], n, threshold, least_words, exact_words) for p in range(parts)]
    best = reduce(DataFrame.unionAll, found).groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "first_word", "last_word")).alias("b"))
    return best.select("doc_id", "item_id", "b.score", "b.first_word", "b.last_word")


def _unpacked(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and each row's first."""
    data, offs = w.flat_binary(blobs)
    return data.view("<u8") if len(data) else np.empty(0, np.uint64), offs // 8


def _found(docs: DataFrame, items: list[tuple[int, str]], n: int, threshold: float, least_words: int, exact_words: int) -> DataFrame:
    """Contaminated pairs of docs (doc_id, words) and the items of a block."""
    index = Seeds(items, n, threshold, least_words, exact_words)
    n = index.n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros(len(index.every), np.int64), max(1, len(index.every))
        for batch in batches:
            for part in w.slices(batch, "words"):
                hashes, first = _unpacked(part["words"])
                at, own = w.window_texts(first, n)
                if len(at):
                    met = _met(w.mix(w.windows(hashes, n)[at]), index.every)
                    doc = np.repeat(np.arange(len(own)), own)
                    pairs = np.unique(doc[met >= 0] * size + met[met >= 0])
                    total += np.bincount(pairs % size, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int64()), pa.array(total[total > 0])], names=["gram", "n"])

    frequency = np.zeros(len(index.every), np.int64)
    if len(index.every):
        for r in docs.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
            frequency[r["gram"]] = r["n"]
    index.choose(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "words"):
                rows = list(_aligned(part, index))
                if rows:
                    ids, item, score, low, high = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(item, pa.int64()), pa.array(score, pa.float64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["doc_id", "item_id", "score", "first_word", "last_word"])

    return docs.mapInArrow(run, SCHEMA)


def _candidates(doc: np.ndarray, met: np.ndarray, index: Seeds) -> Iterator[tuple[int, int]]:
    """Each (document, item) that share a seed and as many n-grams as the item needs, in order. Documents come in groups of
    about OWNERS items met; a single document meets at most all items of the block."""
    size = len(index.every)
    held = np.unique(doc[met >= 0] * size + met[met >= 0])
    met_by = np.cumsum((index.owned[1:] - index.owned[:-1])[held % size])
    ends = np.append(np.flatnonzero(np.diff(held // size)) + 1, len(held))  # of each document's grams
    a, done = 0, 0
    for k, b in enumerate(ends.tolist()):
        if b > a and (k + 1 == len(ends) or met_by[ends[k + 1] - 1] - done > OWNERS):
            at, own = _spread(index.owned, held[a:b] % size)
            pairs = np.unique((held[a:b] // size)[own] * len(index.items) + index.owner[at])
            for part in np.array_split(pairs, 1 + (index.first[pairs % len(index.items) + 1] - index.first[pairs % len(index.items)]).sum() // OWNERS):
                d, item = part // len(index.items), part % len(index.items)
                at, own = _spread(index.first, item)
                shared = np.bincount(own[_met(d[own] * size + index.gram[at], held[a:b]) >= 0], minlength=len(part))
                fit = shared >= index.need[item]
                yield from zip(d[fit].tolist(), item[fit].tolist(), strict=True)
            a, done = b, met_by[b - 1]


def _ranges(grams: np.ndarray, known: np.ndarray, need: int, slack: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a text that holds one of an item's n-grams, the range of text that an alignment through it can
    take. Places with fewer than need such places within reach, to both sides of them, are in none at the threshold."""
    own, at = np.unique(known, return_index=True)
    last = len(known) - 1 - np.unique(known[::-1], return_index=True)[1]
    kind = _met(grams, own)
    places = np.flatnonzero(kind >= 0)
    ahead = np.searchsorted(places, places + reach) - np.arange(len(places))  # places from each one on, within reach
    begins = np.zeros(len(places) + 1, np.int64)
    full = np.flatnonzero(ahead >= need)
    np.add.at(begins, full, 1)
    np.add.at(begins, full + ahead[full], -1)
    places = places[np.cumsum(begins[:-1]) > 0]
    return places - last[kind[places]] - slack, places - at[kind[places]] + len(known) + slack


def _aligned(part: pa.RecordBatch, index: Seeds) -> Iterator[tuple]:
    hashes, first = _unpacked(part["words"])
    at, own = w.window_texts(first, index.n)
    if not len(at) or not len(index.every):
        return
    met = _met(w.mix(w.windows(hashes, index.n)[at]), index.every)
    starts = np.concatenate(([0], np.cumsum(own)))
    for d, k in _candidates(np.repeat(np.arange(len(own)), own), met, index):
        (item_id, item), threshold = index.items[k], index.least[k]
        text = hashes[first[d] : first[d + 1]]
        slack = int(2 * len(item) * (1 - threshold) + SLIP) + 1
        low, high = _ranges(met[starts[d] : starts[d + 1]], index.gram[index.first[k] : index.first[k + 1]], int(index.need[k]), slack, len(item) + slack)
        best, key = (0, 0, 0), (0, 0, 0)
        for a, b in _regions(low, high + index.n - 1, len(item) + slack, len(text)) if len(low) else ():
            if np.isin(item, text[a:b]).sum() < threshold * len(item) - SLIP:
                continue
            value, end, last = align(item, text[a:b])
            if (value, -last, -a - end) > key:
                back = max(0, end - len(item) - slack)
                size = align(item[last::-1], text[a + back : a + end][::-1])[1]
                best, key = (value, a + end - size, a + end - 1), (value, -last, -a - end)
        if best[0] >= threshold * 2 * len(item) - SLIP:
            yield part["doc_id"][d].as_py(), item_id, best[0] / (2 * len(item)), best[1], best[2]


def op2_query(spark, sf_dir: str) -> DataFrame:
    from .tables import read

    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
