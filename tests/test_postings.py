"""BM25 over blocks against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import postings, retrieval


def tokens(text):
    return [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]


def by_hand(docs, queries, k):
    bags = [(i, Counter(tokens(t))) for i, t in docs]
    n, sizes = len(docs), [len(tokens(t)) for _, t in docs if t is not None]
    mean = sum(sizes) / len(sizes)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for q, text in queries:
        scores = []
        for i, bag in bags:
            size = sum(bag.values())
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in set(tokens(text)) if w in bag)
            if s > 0:
                scores.append((-round(s, 9), i))
        out += [(q, rank, i, pytest.approx(-s, abs=2e-9)) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("block", [7, 64])
def test_bm25(spark, monkeypatch, block):
    monkeypatch.setattr(postings, "BUNDLE", 3)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(80)] + ["Éa", "naïve", "日本"]
    text = lambda n: " ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, text(rng.randint(1, 30))) for i in range(200)] + [(300, None), (301, ""), (302, "--"), (303, text(5000)), *[(400 + i, "same words twice") for i in range(20)]]
    queries = [(i, text(rng.randint(1, 12))) for i in range(12)] + [(20, None), (21, ""), (22, "unknown"), (23, "same"), (24, "w0 w1 W1"), (25, text(500))]
    d, q = spark.createDataFrame(docs, "chunk_id long, text string").repartition(3), spark.createDataFrame(queries, "qid long, text string")
    rows = postings.bm25_search(d, q, retrieval.tokens, 5, block_docs=block).withColumn("score", F.round("score", 9))
    got = [tuple(r) for r in retrieval.top_per(rows, 5, F.desc("score"), "chunk_id").select("qid", "rank", "chunk_id", "score").orderBy("qid", "rank").collect()]
    assert got == by_hand(docs, queries, 5)
    work = postings.bm25_search(d, q, retrieval.tokens, 5, block_docs=block, work=True).collect()
    assert all(r["n_scored"] <= r["n_postings"] for r in work) and (block > 7 or sum(r["n_scored"] for r in work) < sum(r["n_postings"] for r in work))


def test_bm25_of_nothing(spark):
    none = spark.createDataFrame([], "chunk_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "chunk_id long, text string")
    ask = spark.createDataFrame([(1, "a")], "qid long, text string")
    assert retrieval.bm25_search(none, ask).collect() == [] == retrieval.bm25_search(some, ask.limit(0)).collect()
    assert [(r["chunk_id"], r["rank"]) for r in retrieval.bm25_search(some, ask).collect()] == [(1, 1)]
