"""What keeps large tables small: rows are picked before they are shuffled, and results are as before."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from loomgraph.operators import build, goldset, lookups, postings, ppr
from loomgraph.plans import catalogue, more, rest, runs  # noqa: F401  (all add their queries to the catalogue)
from loomgraph.sources import versions
from loomgraph.sources.storage import stored
from loomgraph.sources.versions import VersionedTable


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_walk_in_many_cells(spark, monkeypatch):
    """Several segments, blocks and passes give what the linear system gives, and cells are not shuffled to meet the ranks."""
    monkeypatch.setattr(ppr, "SLOTS", 2)
    monkeypatch.setattr(ppr, "SPREAD", 1)
    monkeypatch.setattr(ppr, "BLOCKS", 2)
    rng = random.Random(3)
    n, edges = 40, {tuple(sorted(rng.sample(range(40), 2))) for _ in range(90)}
    walk = ppr.walk_of(spark.createDataFrame(sorted(edges), "a long, b long"), cell=45, name=lambda c: c, number=lambda c: c)
    assert walk.parts == 2
    a = np.zeros((n, n))
    for x, y in edges:
        a[x, y] = a[y, x] = 1
    w = a / np.maximum(a.sum(0), 1)
    asked = {q: [rng.randrange(n + 5) for _ in range(2)] for q in range(1, 7)}
    seeds = spark.createDataFrame([(q, s) for q, ss in asked.items() for s in set(ss)], "qid long, node long")
    got = {}
    for r in ppr.ppr(seeds, walk, tol=1e-6, top=5, stored=stored).collect():
        got.setdefault(r["qid"], {})[r["node"]] = r["score"]
    for q, ss in asked.items():
        known = [s for s in set(ss) if s < n and a[s].any()]
        if not known:
            assert q not in got
            continue
        v = np.zeros(n)
        v[known] = 1 / len(known)
        y = np.linalg.solve(np.eye(n) - 0.45 * w, 0.55 * v)
        y /= y.sum()
        assert len(got[q]) == min(5, (y > 1e-9).sum()) and all(abs(y[k] - s) < 1e-5 for k, s in got[q].items())
        assert min(got[q].values()) >= sorted(y)[-5] - 1e-5


def test_ties_within_a_block():
    """Of many documents of one score only the first k by key leave a block."""
    row, keys = np.array([1.0] * 900 + [2.0] * 3), [f"k{i:03d}" for i in range(903)][::-1]
    fit = postings._firsts(row, np.arange(903), keys, 5)
    assert sorted(keys[i] for i in fit if row[i] == 1) == ["k003", "k004", "k005", "k006", "k007"] and sum(row[fit] == 2) == 3


def test_few_rows_are_merged_where_they_belong(spark, tmp_path, monkeypatch):
    """A small update gives what a large one gives, null keys and nulls too, without a shuffle of the table."""
    out = []
    for few in (versions.FEW, -1):
        monkeypatch.setattr(versions, "FEW", few)
        table = VersionedTable(spark, str(tmp_path / f"t{few}"), spark.createDataFrame([], "k long, a string, b long").schema, ["k"], 4)
        frame = lambda *r: spark.createDataFrame(list(r), table.schema)  # noqa: B023, E731
        table.upsert(frame(*[(i, "x", i) for i in range(40)], (None, "null key", 0)), 0)
        sizes = table.upsert(frame((1, "y", None), (None, "again", 1), (99, None, 7)), 1, ["a"])
        out.append((rows(table.read()), sizes["before"], sizes["after"], table.count()))
    assert out[0] == out[1] and out[0][3] == 43
    monkeypatch.setattr(versions, "FEW", 100)
    few = stored(frame((2, "z", 2)))
    assert "Exchange hashpartitioning" not in plan(table._merged(table.read(), few, ["a", "b"], ["a"]))


def test_long_texts_are_searched_in_one_go(spark):
    """A text of 400,000 letters; with substrings from its beginning this took the square of them."""
    text = "".join(random.Random(5).choices("abcdefghij ", k=400_000))
    docs = spark.createDataFrame([("u1", text + " needle"), ("u2", "Needle"), ("u3", None)], "doc_url string, summary string")
    words = spark.createDataFrame([(1, "needle"), (2, "zzz")], "qid long, word string")
    began = time.time()
    assert rows(lookups.search_summaries(docs, words).select("qid", "doc_url")) == [(1, "u1"), (1, "u2")]
    assert time.time() - began < 30


def test_grounding_broadcasts_nothing(spark):
    r = spark.createDataFrame([("c", 0, "Pump", "Hall", "in")], "chunk_id string, pos int, subject string, object string, evidence string")
    out = build.validate_grounding(r, spark.createDataFrame([("c", "Pump in Hall")], "chunk_id string, text string"), spark.createDataFrame([("c", "pump")], "chunk_id string, name string"))
    assert "Broadcast" not in plan(out) and rows(out) == [("c", 0, "object")]


def test_ids_are_made_after_the_shuffle(spark, sf_dir):
    """b2_keys is made distinct by numbers; g1_entity_projection shuffles nothing."""
    queries = catalogue.queries()
    assert not [x for x in plan(queries["b2_keys"](spark, sf_dir)).splitlines() if "Exchange" in x and ("relation_id" in x or "chunk_id" in x)]
    assert "Exchange" not in plan(queries["g1_entity_projection"](spark, sf_dir))


def test_theme_and_subgraph_sizes(spark):
    proofs = spark.createDataFrame([("S", 1, 5, 1, 1, 1, 0.9), ("S", 1, 5, 2, 1, 1, 0.95), ("C", 3, 5, 1, 1, 1, 0.4), ("S", None, 6, 2, 2, 1, None)], "kind string, number long, part long, doc long, page int, split int, confidence double")
    sizes = goldset.theme_sizes(proofs, ["number", "part"], ["doc", "page", "split"], "kind")
    assert rows(sizes) == [("C", 1, 1), ("S", 2, 3)]
    number = lambda c: F.conv(F.hex(c), 16, 10).cast("long")
    marks = spark.sql("select 1").select(number(F.lit("P5")).alias("id"), F.lit(True).alias("stop"), F.lit(True).alias("hub"))
    got = rows(goldset.subgraph_sizes(proofs, marks, number).select("gid", "n_chunks", "n_hubs", "low", "stopped"))
    assert got == [(1, 2, 1, 0.4, True), (2, 3, 1, 0.95, False)]
