"""License scans: an exact set-similarity join of text blocks with license templates.

Base labels: places where a phrase's words stand consecutively. The method adds the labels of templates that a block
contains: with T the distinct words of a template and B those of a block, |T and B| >= threshold * |T|. Templates are a table
(id, label, text) of whole license texts and of notices (license_texts), or the caller's own.

All tokens are ordered by their global document frequency, counted over all documents, rarest first. A block that meets
the threshold has one of the first |T| - ceil(threshold * |T|) + 1 tokens of T (prefix filter), at least
ceil(threshold * |T|) tokens known to the templates (length filter), and from the first common token on enough tokens
on both sides (positional filter). What is left is counted exactly. Blocks are lines; a line of over 2 * STRIDE words is
also cut into windows of that many words, STRIDE apart. Besides, each stretch of ROOM times as many words in a row as the
template has is a block for it, wherever lines end, so notices wrapped over lines and templates of any length are met.
The whole text goes through the join first: what it does not contain, none of its blocks does.

Licenses share most of their words, so a block that meets the threshold is then checked. Pairs of adjacent words that a
template has, but no template of another label, tell it apart; at least OWN of these must stand in the block. And of the
templates found in a text, one whose words another one of a different label contains by the threshold, being larger, is
only a part of that one, and is left out.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, after lower-casing A-Z. The templates go with
the code to each task, so their words are at most MOST_WORDS in all (more are refused); documents are read in two passes,
for the counts and for the join, and nothing is shuffled but token counts.

Cases: null and empty texts have no words, no places and the score 0. Very long texts are scanned whole. Repeated rows and
null ids are scanned row by row. Other columns do not pass. An empty table gives an empty table; without templates and
phrases there are no labels.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w
from .license_texts import TEMPLATES

STRIDE = 64
MOST_WORDS = 5_000_000
ROOM = 2  # a template may be strewn with as many other words
OWN = 0.5  # the share of a template's own word pairs that a block needs

# The phrases of the base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

def word_mask(low: np.ndarray) -> np.ndarray:
    return ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)) | (low >= 128)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and hashes of words, and each text's first word."""
    data, offs = w.flat(texts)
    low = w.ascii_lower(data)
    starts, ends, first = w.spans(word_mask(low), offs)
    return low, starts, w.hashes(low, starts, ends), first


def _hashed(text: str) -> np.ndarray:
    return _words(pa.array([text]))[2]


class Templates:
    def __init__(self, templates: list[tuple[str, str, str]], threshold: float):
        self.names, self.labels = [name for name, _, _ in templates], [label for _, label, _ in templates]
        words = [_hashed(text) for _, _, text in templates]
        if sum(map(len, words)) > MOST_WORDS:
            raise ValueError(f"templates of more than {MOST_WORDS} words: scan them in parts")
        self.stretch = [ROOM * len(x) for x in words]
        self.sets = [np.unique(x) for x in words]
        self.tokens = np.unique(np.concatenate([np.empty(0, np.uint64), *self.sets]))
        self.need = [ceil(threshold * len(s)) for s in self.sets]
        pairs = [np.unique(w.windows(x, 2)) for x in words]
        other = [np.concatenate([np.empty(0, np.uint64), *[p for p, of in zip(pairs, self.labels, strict=True) if of != label]]) for label in self.labels]
        self.own = [p[~np.isin(p, rest)] for p, rest in zip(pairs, other, strict=True)]
        larger = lambda a, b: self.labels[a] != self.labels[b] and len(self.sets[b]) > len(self.sets[a]) and len(np.intersect1d(self.sets[a], self.sets[b])) >= self.need[a]
        self.within = [[b for b in range(len(words)) if larger(a, b)] for a in range(len(words))]

    def is_own(self, t: int, block: np.ndarray) -> bool:
        """Whether the block (hashes of its words in order) has enough of the word pairs that no other label has."""
        return len(np.intersect1d(w.windows(block, 2), self.own[t])) >= OWN * len(self.own[t])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the template token, else -1."""
        at = np.minimum(np.searchsorted(self.tokens, hashes), len(self.tokens) - 1)
        return np.where(self.tokens[at] == hashes, at, -1)

    def order(self, frequency: dict[int, int]) -> None:
        """Ranks by global frequency, rarest first; the index of prefix tokens."""
        ranked = sorted(range(len(self.tokens)), key=lambda i: (frequency.get(i, 0), i))
        self.rank = np.empty(len(ranked), np.int64)
        self.rank[ranked] = np.arange(len(ranked))
        self.sorted = [sorted(self.rank[np.searchsorted(self.tokens, s)].tolist()) for s in self.sets]
        self.prefix: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, tokens in enumerate(self.sorted):
            for place, r in enumerate(tokens[: len(tokens) - self.need[t] + 1]):
                self.prefix[r].append((t, place))
        self.is_prefix = np.zeros(len(ranked) + 1, bool)
        self.is_prefix[list(self.prefix)] = True

    def join(self, block: list[int]) -> Iterator[tuple[int, float]]:
        """Templates that the block (sorted distinct ranks) contains, with their containment."""
        tried, own = set(), set(block)
        for at, r in enumerate(block):
            for t, place in self.prefix.get(r, ()):
                if t in tried:
                    continue
                tried.add(t)  # r is the first common token
                if len(block) >= self.need[t] <= min(len(block) - at, len(self.sorted[t]) - place):
                    common = len(own.intersection(self.sorted[t]))
                    if common >= self.need[t]:
                        yield t, common / len(self.sorted[t])


def _stretches(places: list[int], tokens: list[int], stretch: int, need: int) -> Iterator[tuple[int, int, int]]:
    """First and last place and the number of distinct tokens of the stretches of so many words that hold `need` of them; of
    those that end at the same token the one that reaches farthest back."""
    inside: dict[int, int] = {}
    left = 0
    for at, token in zip(places, tokens, strict=True):
        inside[token] = inside.get(token, 0) + 1
        while places[left] <= at - stretch:
            gone = tokens[left]
            inside[gone] -= 1
            if not inside[gone]:
                del inside[gone]
            left += 1
        if len(inside) >= need:
            yield places[left], at, len(inside)


def _blocks(line: np.ndarray) -> Iterator[tuple[int, int]]:
    """Word ranges of the blocks of a text, from its words' line numbers."""
    cut = np.flatnonzero(np.diff(line, prepend=-1, append=-2))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield from ((i, min(b, i + 2 * STRIDE)) for i in range(a, max(a + 1, b - STRIDE), STRIDE))


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, template_ids of every row."""
    known = Templates(TEMPLATES if templates is None else templates, threshold)
    wanted = [(_hashed(p), label) for p, label in (PHRASES if phrases is None else phrases).items()]
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.tokens), np.int64)
        for batch in batches:
            for part in w.slices(batch, "text"):
                _, _, hashes, first = _words(part["text"])
                ids = known.ids(hashes)
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                pairs = np.unique(doc[ids >= 0] * len(total) + ids[ids >= 0])
                total += np.bincount(pairs % len(total), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int64()), pa.array(total[total > 0])], names=["token", "n"])

    if len(known.tokens):
        counts = chosen.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        known.order({r["token"]: r["n"] for r in counts.collect()})  # at most one row for each template token

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                yield _scanned(part, known, wanted)

    return chosen.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, template_ids string")


def _scanned(part: pa.RecordBatch, known: Templates, wanted: list[tuple[np.ndarray, str]]) -> pa.RecordBatch:
    low, starts, hashes, first = _words(part["text"])
    n = len(first) - 1
    end_of = np.repeat(first[1:], np.diff(first))  # of each word's text
    places: dict[int, list[tuple[int, str]]] = defaultdict(list)
    for phrase, label in wanted:
        size = len(phrase)
        hit = np.flatnonzero(hashes[: len(hashes) - size + 1] == phrase[0]) if len(hashes) >= size else np.empty(0, np.int64)
        for j in range(1, size):
            hit = hit[hashes[hit + j] == phrase[j]]
        hit = hit[hit + size <= end_of[hit]]
        for d, at in zip((np.searchsorted(first, hit, side="right") - 1).tolist(), hit.tolist(), strict=True):
            places[d].append((at - int(first[d]), label))
    more: dict[int, dict[str, float]] = defaultdict(dict)
    named: dict[int, set[str]] = defaultdict(set)
    if len(known.tokens) and len(hashes):
        ids = known.ids(hashes)
        rank = np.where(ids >= 0, known.rank[ids], -1)
        lines = np.cumsum(low == 10)
        hot = np.flatnonzero(known.is_prefix[rank] & (rank >= 0))
        for d in np.unique(np.searchsorted(first, hot, side="right") - 1).tolist():
            a, b = int(first[d]), int(first[d + 1])
            own = rank[a:b]
            whole = np.unique(own)
            tried = [t for t, _ in known.join(whole[whole >= 0].tolist())]
            if not tried:
                continue
            marks = np.concatenate(([0], np.cumsum(known.is_prefix[own] & (own >= 0))))
            found = []
            for i, j in _blocks(lines[starts[a:b]]):
                if marks[i] < marks[j]:
                    block = np.unique(own[i:j])
                    found.extend((t, share) for t, share in known.join(block[block >= 0].tolist()) if known.is_own(t, hashes[a + i : a + j]))
            for t in tried:
                held = np.flatnonzero(np.isin(own, known.sorted[t]))
                best = 0
                for i, j, met in _stretches(held.tolist(), own[held].tolist(), known.stretch[t], known.need[t]):
                    if met > best and known.is_own(t, hashes[a + i : a + j + 1]):
                        best = met
                if best:
                    found.append((t, best / len(known.sorted[t])))
            there = {t for t, _ in found}
            for t, share in found:
                if there.intersection(known.within[t]):
                    continue
                label = known.labels[t]
                named[d].add(known.names[t])
                more[d][label] = max(share, more[d].get(label, 0.0))
    base = [{label for _, label in places.get(d, ())} for d in range(n)]
    joined = lambda labels: ",".join(sorted(labels))
    return pa.RecordBatch.from_arrays(
        [
            part["doc_id"],
            pa.array(np.diff(first), pa.int64()),
            pa.array([len(places.get(d, ())) for d in range(n)], pa.int64()),
            pa.array([min(places[d])[0] if d in places else None for d in range(n)], pa.int64()),
            pa.array([max(places[d])[0] if d in places else None for d in range(n)], pa.int64()),
            pa.array([joined(base[d]) for d in range(n)]),
            pa.array([joined(base[d] | more.get(d, {}).keys()) for d in range(n)]),
            pa.array([1.0 if base[d] else max(more[d].values()) if d in more else 0.0 for d in range(n)]),
            pa.array([joined(named.get(d, ())) for d in range(n)]),
        ],
        names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "template_ids"],
    )


def op10_query(spark, sf_dir: str) -> DataFrame:
    from .tables import read

    return scan(read(spark, sf_dir, "documents"))
