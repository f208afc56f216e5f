"""Graph operators against hand-computed tables and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import evaluate, fusion, goldset, graph, ingest, ppr, retrieval, routing
from loomgraph.sources.storage import read_jsonl, stored, write_jsonl


@pytest.fixture(scope="module")
def edges(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "b")]
    return spark.createDataFrame([(str(i), s, o) for i, (s, o) in enumerate(pairs)] + [("9", "a", "a")], "relation_id string, subject_key string, object_key string")


def test_projection_and_degrees(edges):
    assert {tuple(r) for r in graph.projection(edges).collect()} == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "c")}
    assert {r["entity_key"]: r["degree"] for r in graph.degrees(edges).collect()} == {"a": 2, "b": 3, "c": 2, "d": 1}


def test_ppr_mass_and_limit(spark, edges):
    seeds = spark.createDataFrame([(1, "a"), (2, "zzz")], "qid long, node string")
    rows = ppr.ppr(seeds, graph.projection(edges), top=None, stored=stored).collect()
    assert {r["qid"] for r in rows} == {1}
    assert abs(sum(r["score"] for r in rows) - 1) < 1e-6
    score = {r["node"]: r["score"] for r in rows}
    assert score["a"] > score["b"] > score["c"] > score["d"] > 0
    assert ppr.rounds(0.45) == 24 and ppr.rounds(0.7) == 54 and ppr.rounds(0.85) == 100


def test_rrf_counts_repeats_and_prefers_first_metadata(spark):
    schema = "qid long, source string, rank int, chunk_id string, content string, file_name string, page_number string, score double"
    one = spark.createDataFrame([(1, "g", 1, "x", "", "f", "1", 1.0), (1, "g", 2, "x", "", "f", "1", 1.0)], schema)
    two = spark.createDataFrame([(1, "t", 1, "x", "text", "f", "1", 1.0), (1, "t", 2, "", "c", "f", "2", 1.0)], schema)
    rows = {r["chunk_id"]: r for r in fusion.rrf([one, two]).collect()}
    assert abs(rows["x"]["score"] - (2 / 61 + 1 / 62)) < 1e-6 and rows["x"]["content"] == "text" and rows["x"]["sources"] == "g+t"
    assert "" in rows


def test_min_max_of_equal_values_is_one(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 3.0)], "qid long, v double")
    assert [r["s"] for r in graph.min_max(df, "v", "s").collect()] == [1.0, 1.0]


def test_upsert_is_idempotent(spark):
    target = spark.createDataFrame([("k1", "a", 1), ("k2", "b", 2)], "k string, v string, n int")
    new = spark.createDataFrame([("k2", "c", 2), ("k3", "d", 3)], "k string, v string, n int")
    once = ingest.upsert(target, new, "k", ["v", "n"])
    assert sorted(map(tuple, once.collect())) == [("k1", "a", 1), ("k2", "c", 2), ("k3", "d", 3)]
    assert sorted(map(tuple, ingest.upsert(once, new, "k", ["v", "n"]).collect())) == sorted(map(tuple, once.collect()))


def test_set_scores(spark):
    a = spark.createDataFrame([(1, ["x", "y"], 0.5, 2.0, 3, "t"), (2, [], 0.5, 1.0, 1, "t")], "qid long, refs array<string>, confidence double, elapsed double, graph_chunks int, answer string")
    rows = {r["qid"]: r for r in evaluate.ab_compare(a, a.withColumn("refs", F.slice("refs", 1, 1))).collect()}
    assert rows[1]["jaccard"] == 0.5 and rows[2]["jaccard"] is None and rows[1]["changed"] is False


def test_context_precision(spark):
    v = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 1), (2, 1, 0)], "qid long, rank int, verdict int")
    assert {r["qid"]: round(r["precision"], 6) for r in evaluate.context_precision(v).collect()} == {1: round((1 + 2 / 3) / 2, 6), 2: 0.0}


def test_citations(spark):
    answers = spark.createDataFrame([(1, "see [Source 2] and [1, 3] and [Source 99] [2024]"), (2, "none")], "answer_id long, text string")
    rows = sorted((r["answer_id"], r["position"], r["source"]) for r in fusion.cited_sources(answers, 6).collect())
    assert rows == [(1, 1, 2), (1, 2, 1), (1, 3, 3), *((2, i, i) for i in range(1, 6))]


def test_routing(spark):
    q = spark.createDataFrame([(1, "Fire-fighting and pumps")], "qid long, text string")
    d = spark.createDataFrame([("hse", ["fire fighting", "safety"]), ("mech", ["pumps", "pump"])], "domain string, keywords array<string>")
    assert {(r["domain"], r["hits"]) for r in routing.keyword_scores(q, d).collect()} == {("hse", 1), ("mech", 1)}


def test_phrase_and_fuzzy(spark):
    docs = spark.createDataFrame([("1", "main pump house"), ("2", "main x y z w pump"), ("3", "pump main")], "chunk_id string, text string")
    assert [r[0] for r in retrieval.phrase_match(docs, ["main", "pump"], 3).collect()] == ["1"]
    words = spark.createDataFrame([("pumps",), ("pump",), ("bumps",), ("lamps",)], "word string")
    terms = spark.createDataFrame([("pumps",)], "term string")
    assert {r["match"] for r in retrieval.fuzzy_terms(terms, words).collect()} == {"pumps", "pump", "bumps"}


def test_paths_are_simple(spark, edges):
    none = spark.createDataFrame([], "entity_key string")
    rows = goldset.sample_paths(edges, none, 10, 2, "s").collect()
    assert rows and all(len(set(r["path"].split(","))) == 2 for r in rows)


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"]), (2, [])], "qid long, keys array<string>")
    write_jsonl(df, str(tmp_path / "x"))
    assert sorted(map(tuple, read_jsonl(spark, str(tmp_path / "x"), df.schema).collect())) == [(1, ["a"]), (2, [])]


def test_bridge_rank(spark):
    from loomgraph.operators import evaluate

    ranked = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a")], "qid long, rank int, chunk_id string")
    proof = spark.createDataFrame([("a", "r1"), ("b", "r2"), ("b", "r3")], "chunk_id string, relation_id string")
    relations = spark.createDataFrame([("r1", "Pump", None), ("r2", "Gas Valve", "Pump"), ("r3", "x", "VALVES")], "relation_id string, subject string, object string")
    bridges = spark.createDataFrame([(1, "valve"), (2, "Valve"), (3, "Pump")], "qid long, bridge string")
    got = {r["qid"]: (r["bridge_rank"], r["relation_id"]) for r in evaluate.bridge_rank(ranked, proof, relations, bridges).collect()}
    assert got == {1: (2, "r2"), 2: (None, None), 3: (None, None)}


def test_context_precision_of_long_lists(spark):
    """Stretches of ranks give what one running sum gives, with big ids, ties, nulls and a hot question."""
    rng = random.Random(4)
    rows = [(1, 2**60 + i, rng.randrange(2)) for i in range(3000)] + [(None, i // 3, rng.choice([0, 1, None])) for i in range(90)] + [(2, 5, 0), (3, None, 1), (3, 7, 1), (4, None, None)]
    rng.shuffle(rows)
    got = {r["qid"]: r["precision"] for r in evaluate.context_precision(spark.createDataFrame(rows, "qid long, rank long, verdict int"), parts=7).collect()}
    for qid in (None, 1, 2, 3, 4):
        own = sorted((-1 if r is None else r, -1 if v is None else v) for q, r, v in rows if q == qid)
        hits = [i for i, (_, v) in enumerate(own, 1) if v == 1]
        assert abs(got[qid] - (sum(k / i for k, i in enumerate(hits, 1)) / len(hits) if hits else 0)) < 1e-8
    assert evaluate.context_precision(spark.createDataFrame([], "qid long, rank long, verdict int")).collect() == []


def test_large_pools_are_cut_in_shares(spark):
    relations = spark.range(2600).select(F.concat(F.lit("r"), "id").alias("relation_id"), F.lit("hub").alias("subject_key"), F.concat(F.lit("e"), "id").alias("object_key"))
    weights = spark.range(2600).select(F.concat(F.lit("r"), "id").alias("relation_id"), (F.col("id") % 7).cast("double").alias("aggregated_weight"))
    asked = spark.createDataFrame([(1, "hub"), (2, "e5")], "qid long, entity_key string")
    got = graph.local_relations(asked, relations, weights, graph.degrees(relations), 2000).where("qid = 1").orderBy("rank").collect()
    want = sorted((-(i % 7), f"r{i}") for i in range(2600))[:2000]
    assert [(r["rank"], r["relation_id"]) for r in got] == [(k, i) for k, (_, i) in enumerate(want, 1)]


def test_personas_of_communities(spark):
    from loomgraph.operators import goldset

    names = ["a", "ab", "pump", "steel pump", "umbrella", "", "tank farm"]
    terms = [(i, t) for i, t in enumerate(names + ["Pum", "nothing here", "farms"])]
    personas = [(f"p{i}", c) for i, c in enumerate(["pump", "Tank", "b", "farm gate"])]
    got = {(r["gid"], r["persona"]) for r in goldset.match_personas(spark.createDataFrame(terms, "gid long, term string"), spark.createDataFrame(personas, "persona string, concept string"), part=True).collect()}
    want = set()
    for gid, t in terms:
        met = [p for p, c in personas if t and (t.lower() in c.lower() or c.lower() in t.lower())]
        want |= {(gid, p) for p in met or [p for p, _ in personas]}
    assert got == want
    dealt = goldset.match_personas(spark.createDataFrame(terms, "gid long, term string"), spark.createDataFrame([*personas, (None, "none")], "persona string, concept string"), part=True, block=1)
    assert sorted(map(tuple, dealt.collect())) == sorted(want)
    assert goldset.match_personas(spark.createDataFrame(terms, "gid long, term string"), spark.createDataFrame([], "persona string, concept string")).collect() == []


def test_admit_and_prefilter(spark):
    from loomgraph.operators import goldset

    rows = [(1, "What is X?", None, "local"), (2, "what  is x", None, "local"), (3, "Y", None, "local"), (4, "Z", None, "local"), (5, "Y", "rejected", "global"), (6, None, None, "global")]
    reasons = goldset.admit(spark.createDataFrame(rows, "qid long, question string, reason string, mode string"), 2)
    assert {r["qid"]: r["reason"] for r in reasons.collect()} == {1: None, 2: "duplicate", 3: None, 4: "over quota", 5: "rejected", 6: None}
    assert {r["reason"]: r["n"] for r in goldset.reject_counts(reasons).collect()} == {"duplicate": 1, "over quota": 1, "rejected": 1}
    size = spark.createDataFrame([(1, 2, 0), (2, 2, 0), (3, 2, 0), (4, 1, 0)], "gid long, n_chunks long, n_hubs long")
    best = spark.createDataFrame([(1, 0.9), (2, 0.4)], "gid long, best double")
    joins = spark.createDataFrame([(1, " Contractor ", None), (3, "Pump", None)], "gid long, name string, hub boolean")
    assert {r["gid"]: r["reason"] for r in goldset.prefilter(size, best, connectors=joins).collect()} == {1: "stop connectors", 2: "low confidence", 3: None, 4: "few chunks"}
