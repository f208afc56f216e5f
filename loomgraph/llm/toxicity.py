"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learned from labelled documents: terms (whole words, or stems of 4 to 8 letters that stand for every word
they begin) that tell toxic documents from others, chosen one after another until each toxic document is covered a few
times, so that words of one group of copies do not enter. A word meets the lexicon exactly, or through its Levenshtein
automaton run along the lexicon's trie (distance 1 from 5 letters on, 2 from 12 on); terms that are near to words of clean
documents are left out of the trie. The context window of each hit tells quotation from abuse: hits whose line opens a
quotation shortly before and closes it shortly after (double or single marks), or starts with ">", count apart, and not in
the share of hits.

A logistic model of exact and near hits, quoted or not, gives the score. Labelled texts seldom hold misspelled or quoted
terms, so the model also learns from variants of the toxic ones: with a letter of each exact hit changed (still toxic),
and with each hit in quotation marks (not toxic). Unquoted hits never lower a score; quoted ones may.

Everything is learned from at most `max_train` labelled documents (a documented bound; they are those with the least
hashes), so the lexicon, its counts and the model are bounded by these: a term stands in `least_docs` toxic ones at
least, and all that do are looked at. Scoring reads every document whole.

Cases: null and empty texts have no hits and get the score of a text without any. Very long texts are scored whole.
Documents without a label, or with a null one, are not learned from; a document labelled more than once counts as toxic if
one label says so. Repeated rows are scored each; null ids are scored and held in (their remainder is null, held_out
false). An empty table of documents gives an empty table; without any labelled document of both kinds (or any label) the
score is the constant share of toxic labels, one half without labels. Other columns do not pass, but those in `passed`.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import slices

WORD = re.compile(r"[^\W_]+")
STEMS = (4, 5, 6, 7, 8)
OPEN, CLOSE = "“„«‹", "”“»›"  # besides the straight mark, which is both
MARK = re.compile(f'["{OPEN}{CLOSE}]')
SINGLE = re.compile(r"(?<!\w)(?P<o>['‘])(?=\w)|(?<=[\w.,!?])['’](?!\w)")  # no apostrophes within words
REACH = 80
CACHE = 200_000
VARIANT = 0.5  # how much a variant weighs in learning
UNQUOTED = [0, 2, 4, 5]  # features that never lower a score


@dataclass
class Model:
    words: dict[str, int] = field(default_factory=dict)
    stems: dict[str, int] = field(default_factory=dict)
    exact_only: set[str] = field(default_factory=set)
    weights: list[float] = field(default_factory=lambda: [0.0] * 6)
    bias: float = 0.0


class Trie:
    """Lexicon words, letter by letter; a node is [children, word or None]."""

    def __init__(self, words: list[str]):
        self.root: list = [{}, None]
        for word in words:
            node = self.root
            for c in word:
                node = node[0].setdefault(c, [{}, None])
            node[1] = word

    def near(self, word: str, most: int) -> tuple[str, int] | None:
        """The lexicon word within distance most of word (least distance, then alphabetical).

        The automaton's states are bit sets: bit i of row e says that i letters of word are read with e errors. An
        edge of the trie moves all states at once; a branch ends where no state is left."""
        n = len(word)
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << (i + 1)
        final, full = 1 << n, (1 << (n + 1)) - 1
        start = [((1 << (e + 1)) - 1) & full for e in range(most + 1)]
        best: tuple[int, str] | None = None
        stack = [(self.root, start)]
        while stack:
            (children, found), rows = stack.pop()
            if found is not None:
                for e, row in enumerate(rows):
                    if row & final:
                        if best is None or (e, found) < best:
                            best = (e, found)
                        break
            for c, child in children.items():
                hit = masks.get(c, 0)
                new, before = [], 0
                for e, row in enumerate(rows):
                    now = (row << 1) & hit
                    if e:  # an added letter, a changed one, or a letter of word skipped
                        now |= rows[e - 1] | (rows[e - 1] << 1) | (before << 1)
                    before = now & full
                    new.append(before)
                if new[-1]:
                    stack.append((child, new))
        return (best[1], best[0]) if best else None


class Matcher:
    """Kinds of words: 0 for none, 1 for an exact hit (whole word or stem), 2 for a near one."""

    def __init__(self, model: Model):
        self.words, self.stems = model.words, model.stems
        long = [w for w in (*model.words, *model.stems) if len(w) >= 5 and w not in model.exact_only]
        self.tries = {n: Trie([w for w in long if abs(len(w) - n) <= (2 if n >= 12 else 1)]) for n in range(5, max(map(len, long), default=0) + 3)}
        self.cache: dict[str, int] = {}

    def exact(self, word: str) -> bool:
        return word in self.words or any(word[:n] in self.stems for n in STEMS if len(word) >= n)

    def near(self, word: str) -> str | None:
        """The term that the automaton finds for a word that is no exact hit."""
        trie = self.tries.get(len(word))
        found = trie.near(word, 2 if len(word) >= 12 else 1) if trie else None
        return found[0] if found else None

    def kinds(self, words: set[str]) -> dict[str, int]:
        """Those of the words that hit."""
        cache = self.cache
        if new := [x for x in words if x not in cache]:
            if len(cache) > CACHE:
                cache.clear()
                new = list(words)
            for word in new:
                cache[word] = 1 if self.exact(word) else 2 if self.near(word) else 0
        return {w: k for w in words if (k := cache[w])}

    def features(self, text: str | None) -> list[float]:
        """Exact hits outside and inside quotation marks, near ones likewise, damped; the share of words that hit outside
        them; and whether any hits exactly there."""
        low = (text or "").lower()
        found = WORD.findall(low)
        kinds = self.kinds(set(found))
        if not kinds:
            return [0.0] * 6
        count = Counter()
        if marks := Quotes(low):
            for m in WORD.finditer(low):
                if k := kinds.get(m[0]):
                    count[k, marks.around(m.start(), m.end())] += 1
        else:
            for word, n in Counter(w for w in found if w in kinds).items():
                count[kinds[word], False] += n
        return [np.log1p(count[k, q]).item() for k in (1, 2) for q in (False, True)] + [min(1.0, 20 * (count[1, False] + count[2, False]) / len(found)), float(count[1, False] > 0)]

    def variants(self, text: str) -> list[tuple[int, str]]:
        """1 and the text with a letter of each exact hit changed; 0 and it, and the text, with each hit in quotation marks."""

        def changed(text: str, wrong: bool) -> str:
            kinds = self.kinds(set(WORD.findall(text.lower())))
            if wrong:
                return WORD.sub(lambda m: misspelled(m[0]) if kinds.get(m[0].lower()) == 1 and len(m[0]) >= 5 else m[0], text)
            return WORD.sub(lambda m: f'"{m[0]}"' if m[0].lower() in kinds else m[0], text)

        if not self.kinds(set(WORD.findall(text.lower()))):
            return []
        wrong = changed(text, True)
        return [(0, changed(text, False))] + ([(1, wrong), (0, changed(wrong, False))] if wrong != text else [])


def misspelled(word: str) -> str:
    """One letter of the word changed, doubled or left out, by its hash."""
    draw = crc32(word.encode())
    at = 1 + draw % (len(word) - 2)
    return word[:at] + ["x", word[at] * 2, ""][draw // 64 % 3] + word[at + 1 :]


class Quotes:
    """The quotation marks of a text, and its lines that start with ">"; straight marks open and close by turns within each
    line, single ones by what stands beside them."""

    def __init__(self, text: str):
        self.marks = [(m.start(), m[0]) for m in MARK.finditer(text)]
        self.single = [(m.start(), "‘" if m["o"] else "’") for m in SINGLE.finditer(text)] if "'" in text or "’" in text else []
        self.replies = {m.start(1) for m in re.finditer(r"^([ \t]*)>", text, re.M)} if ">" in text else set()
        self.lines = [m.start() for m in re.finditer("\n", text)] if self else []
        self.straight = [i for i, c in self.marks if c == '"']

    def __bool__(self) -> bool:
        return bool(self.marks or self.single or self.replies)

    def around(self, start: int, end: int) -> bool:
        """Whether a quotation opens before and closes after, within the context window and the line, or the line is one."""
        line = bisect_left(self.lines, start)
        low = self.lines[line - 1] if line else -1
        high = self.lines[line] if line < len(self.lines) else end + REACH
        if low + 1 in self.replies:
            return True
        left, right = self._beside(self.marks, start, end, low, high)
        if left == right == '"' and (bisect_left(self.straight, start) - bisect_left(self.straight, low)) % 2 == 1:
            return True
        return left in OPEN and right in CLOSE if left and right and left != '"' else self._beside(self.single, start, end, low, high) == ("‘", "’")

    @staticmethod
    def _beside(marks: list[tuple[int, str]], start: int, end: int, low: int, high: int) -> tuple[str, str]:
        """The marks before and after a hit; empty where they are too far."""
        after = bisect_left(marks, (start,))
        left = marks[after - 1][1] if after and marks[after - 1][0] >= max(low, start - REACH) else ""
        return left, marks[after][1] if after < len(marks) and marks[after][0] < min(high, end + REACH) else ""


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def _training(docs: DataFrame, labels: DataFrame, max_train: int, id_col: str, text_col: str) -> DataFrame:
    """toxic, text of the labelled documents to learn from, at most max_train, each distinct text once."""
    known = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and _id is not null")
    known = known.where(~held_out("_id")).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return texts.join(F.broadcast(chosen), "_id").groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("toxic", "text")


def _terms(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return {w for w in words if len(w) >= 3} | {f"{w[:n]}*" for w in words for n in STEMS if len(w) >= n}


def learn(docs: DataFrame, labels: DataFrame, max_train: int = 12_000, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The lexicon and the weights, from labelled documents that are not held out."""
    from .tables import stored

    train = stored(_training(docs, labels, max_train, id_col, text_col))
    total = {r["toxic"]: r["n"] for r in train.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        return Model(bias=float(np.log((n1 + 0.5) / (n0 + 0.5))) if n1 + n0 else 0.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                both = [Counter(), Counter()]
                for toxic, text in zip(part["toxic"].to_pylist(), part["text"].to_pylist(), strict=True):
                    both[int(toxic > 0)].update(_terms(text))
                for kind in (0, 1):
                    n, zero = pa.array(list(both[kind].values()), pa.int64()), pa.array([0] * len(both[kind]), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(list(both[kind]), pa.string()), n if kind else zero, zero if kind else n], names=["term", "n1", "n0"])

    counts = train.mapInArrow(count, "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
    best = counts.where(F.col("n1") >= least_docs).withColumn("odds", odds).where("odds > 1.5").orderBy(F.desc(F.col("n1") * F.col("odds")), "term")
    terms = [r["term"] for r in best.select("term").collect()]
    number = {t: i for i, t in enumerate(terms)}

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            met = [sorted(number[t] for t in _terms(x) if t in number) for x in batch["text"]]
            yield pd.DataFrame({"toxic": (batch["toxic"] > 0).astype("int32"), "met": met})

    rows = train.mapInPandas(meet, "toxic int, met array<int>").where("size(met) > 0").collect()
    model = Model()
    for term in _cover(terms, [(r["toxic"], r["met"]) for r in rows], n1):
        (model.stems if term.endswith("*") else model.words)[term.rstrip("*")] = 1

    model.exact_only = _near_to_clean(train, model, n0)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(model)
        for batch in batches:
            rows = []
            for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
                rows.append((int(toxic > 0), 1.0, matcher.features(text)))
                if toxic > 0:
                    rows += [(y, VARIANT, matcher.features(t)) for y, t in matcher.variants(text)]
            yield pd.DataFrame(rows, columns=["toxic", "weight", "x"])

    seen = train.mapInPandas(measure, "toxic int, weight double, x array<double>").collect()
    weights = _logistic(np.array([r["x"] for r in seen]), np.array([r["toxic"] for r in seen], float), np.array([r["weight"] for r in seen]))
    model.weights, model.bias = weights[:-1].tolist(), float(weights[-1])
    return model


def _near_to_clean(train: DataFrame, model: Model, n0: int, share: float = 0.002) -> set[str]:
    """Terms that words of clean documents are near to, in more than a few of them."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher, known = Matcher(model), {}
        for batch in batches:
            terms = []
            for text in batch["text"]:
                words = set(WORD.findall(text.lower()))
                known |= {x: None if matcher.exact(x) else matcher.near(x) for x in words if x not in known}
                terms += {t for x in words if (t := known[x])}
                if len(known) > CACHE:
                    known = {}
            yield pd.DataFrame({"term": pd.Series(terms, dtype="object")})

    near = train.where("toxic = 0").mapInPandas(find, "term string").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return {r["term"] for r in near.where(F.col("n") > max(1, share * n0)).collect()}  # terms of the lexicon alone


def _cover(terms: list[str], rows: list[tuple[int, list[int]]], n1: int, fade: float = 0.55) -> list[str]:
    """Terms by the toxic documents they newly cover, less those of clean ones; a covered document fades."""
    toxic = [met for y, met in rows if y]
    where: list[list[int]] = [[] for _ in terms]
    for d, met in enumerate(toxic):
        for t in met:
            where[t].append(d)
    clean = np.bincount([t for y, met in rows if not y for t in met], minlength=len(terms))
    places = [np.array(x, np.int64) for x in where]
    weight, out = np.ones(len(toxic)), []
    left = set(range(len(terms)))
    least = max(1.2, 0.0015 * n1)
    while left:
        gain = {t: (weight[places[t]].sum() - 3.0 * clean[t], len(terms[t]), terms[t]) for t in left}
        t = max(left, key=gain.__getitem__)
        if gain[t][0] < least:
            break
        out.append(terms[t])
        weight[places[t]] *= fade
        root = terms[t].rstrip("*")
        left = {u for u in left if gain[u][0] >= least and not root.startswith(r := terms[u].rstrip("*")) and not r.startswith(root)}
    return out


def _logistic(x: np.ndarray, y: np.ndarray, size: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton's method; the intercept is last and free of the penalty. A step that does not gain is halved."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((size * (np.logaddexp(0, z) - y * z)).sum() + w @ penalty @ w / 2)

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        free = np.ones(len(w), bool)
        slope = x.T @ (size * (y - p)) - penalty @ w
        free[UNQUOTED] = (w[UNQUOTED] > 0) | (slope[UNQUOTED] > 0)
        curve = (x[:, free] * (size * p * (1 - p))[:, None]).T @ x[:, free] + penalty[np.ix_(free, free)]
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(curve, slope[free])
        now, part = loss(w), 1.0
        while True:
            new = w + part * step
            new[UNQUOTED] = np.maximum(new[UNQUOTED], 0)  # an unquoted hit never speaks for a clean text
            if loss(new) <= now or part < 1e-6:
                break
            part /= 2
        moved, w = abs(new - w).max(), new
        if moved < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", passed: tuple[str, ...] = ()) -> DataFrame:
    """id_col, passed columns, held_out, score, predicted, n_exact_hits and n_near_hits of every row."""
    kept = [*dict.fromkeys([id_col, *passed])]
    chosen = docs.select(*kept, held_out(id_col).alias("_held"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, weights = Matcher(model), np.array(model.weights)
        for batch in batches:
            for part in slices(batch, "_text"):
                x = np.array([matcher.features(t) for t in part["_text"].to_pylist()]).reshape(-1, 6)
                value = 1 / (1 + np.exp(-np.clip(x @ weights + model.bias, -30, 30)))
                exact, near = (np.rint(np.expm1(x[:, [i]]) + np.expm1(x[:, [i + 1]]))[:, 0].astype(np.int64) for i in (0, 2))
                columns = [part[c] for c in kept] + [part["_held"].fill_null(False), pa.array(value), pa.array((value >= threshold).astype(np.int32)), pa.array(exact), pa.array(near)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "held_out", "score", "predicted", "n_exact_hits", "n_near_hits"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return chosen.mapInArrow(run, f"{schema}, held_out boolean, score double, predicted int, n_exact_hits long, n_near_hits long")


def op1_query(spark, sf_dir: str) -> DataFrame:
    from .tables import read

    docs = read(spark, sf_dir, "documents")
    return score(docs, learn(docs, read(spark, sf_dir, "labels")))
