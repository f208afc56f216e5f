"""Likeness of names, overlaps, containment, components and gold rows against plain Python, on tables with odd rows."""

import random

import pytest

from loomgraph.operators import goldset, linking, lookups, names, ppr


def words(seed, n, letters="aabcdefgh ", most=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choices(letters, k=rng.randint(1, most))) for _ in range(n)})


def test_jaro_winkler_over_batches():
    rng = random.Random(1)
    some = [*words(2, 400, "abcdeé ", 14), "", None, "x" * 300, "xy" * 150, "Aa" * 5, "aA" * 5, "日本", "日本語", "a\0", "a"]
    a, b = ([rng.choice(some) for _ in range(4000)] for _ in range(2))
    assert names.jaro_winkler_scores(a, b).tolist() == pytest.approx([linking.jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], abs=1e-12)
    assert names.jaro_winkler_scores([], []).tolist() == []


@pytest.mark.parametrize("least", [0.75, 0.9])
def test_near_names(spark, least):
    some = [*words(3, 150), "Abc", "abc", "ABC", "", "abcdefgh" * 4]
    got = {(r["a"], r["b"]): r["score"] for r in names.near_names(spark.createDataFrame([(x,) for x in [*some, some[0], None]], "name string"), least).where("a is not null and b is not null").collect()}
    want = {(x, y): linking.jaro_winkler(x, y) for x in some for y in some}
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items() if v >= least}


def overlaps(lists, least=0.05):
    count = {}
    for items in lists.values():
        for x in items:
            count[x] = count.get(x, 0) + 1
    gone = sorted(count, key=lambda x: (-count[x], x))[: max(1, int(len(count) * 0.05))]
    kept = {c: sorted(set(items) - set(gone)) for c, items in lists.items()}
    out = {}
    for x in sorted(kept):
        for y in sorted(kept):
            if x < y and kept[x] and kept[y]:
                met = sorted(f"{a}~{b}" for a in kept[x] for b in kept[y] if linking.jaro_winkler(a, b) >= 0.75)
                if len(met) / (len(kept[x]) * len(kept[y])) >= least:
                    out[x, y] = (round(len(met) / (len(kept[x]) * len(kept[y])), 9), met)
    return out


def test_overlap_edges(spark):
    rng = random.Random(5)
    some = [x.strip() for x in words(6, 120, "abcdefghijklm", 10)]
    lists = {f"c{i}": {"everywhere", "often" if i % 2 else "seldom", *rng.sample(some, rng.choice([1, 3, 8, 40]))} for i in range(40)} | {"only common": {"everywhere"}}
    rows = spark.createDataFrame([(c, f" {x} ") for c, items in lists.items() for x in items] + [("c1", " "), ("c1", "often"), ("c2", None)], "chunk_id string, name string")
    near = names.near_names(rows.selectExpr("trim(name) as name"), 0.75)
    got = {(r["src"], r["dst"]): (r["overlap"], r["matches"]) for r in goldset.overlap_edges(rows, near).collect()}
    assert got == overlaps(lists)


def test_hot_names_list_no_pairs_that_they_cannot_decide(spark):
    """Two large lists with one name in common are far below the score, so the common name does not bring them together."""
    lists = [(f"c{i:02d}", x) for i in range(12) for x in ["shared", "dropped", *(f"{'qwertzuiop'[i % 10]}{j}{'asdfghjkl'[j % 9]}{i}{j * 7919 % 997}" for j in range(30))]]
    rows = spark.createDataFrame(lists, "chunk_id string, name string")
    same = rows.selectExpr("name as a", "name as b").distinct()
    edges = goldset.overlap_edges(rows, same)
    assert edges.collect() == []


def test_no_overlaps(spark):
    none = spark.createDataFrame([], "chunk_id string, name string")
    assert goldset.overlap_edges(none, spark.createDataFrame([], "a string, b string")).collect() == []


def test_containing(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdeé\n", k=rng.randint(1, 7)))
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(120)] + [(200, None), (201, ""), (202, "unending"), (203, "the end"), (204, "x" * 50_000 + " tail of the long one")]
    whole = [t for _, t in texts if t and len(t) > 40]
    items = [(i, t[(at := rng.randrange(len(t) - 30)) : at + rng.randint(1, 30)]) for i, t in enumerate(rng.choices(whole, k=60))] + [(70, "end"), (71, "tail of the long one"), (72, "absent everywhere, quite"), (73, ""), (74, None), (75, "a"), (76, "x" * 40)]
    docs, asked = spark.createDataFrame(texts, "chunk_id long, text string"), spark.createDataFrame(items, "qid long, item string")
    got = sorted(tuple(r) for r in lookups.containing(docs, asked).collect())
    assert got == sorted((q, i) for q, item in items if item for i, t in texts if t and item in t)


def test_long_chains_of_labels(spark):
    n = 10_000
    edges = spark.range(n - 1).selectExpr("id as src", "id + 1 as dst")
    got = goldset.name_clusters(spark.range(n + 1).selectExpr("id as label"), edges, spark.createDataFrame([(7000, 3), (9, 3)], "label long, n long"))
    assert {tuple(r) for r in got.groupBy("cluster").count().collect()} == {(9, n), (n, 1)}


def test_scopes_have_their_own_hubs(spark):
    """A star of 60 in one domain, one of 80 in another, four relations in a third."""
    rows = [("a", f"x{i}", "one") for i in range(60)] + [("b", f"x{i}", "two") for i in range(80)] + [("c", f"y{i}", "few") for i in range(4)] + [("a", "a", "one")]
    relations = spark.createDataFrame([(f"r{i}", s, o, d) for i, (s, o, d) in enumerate(rows)], "relation_id string, subject_key string, object_key string, domain string")
    wanted = spark.createDataFrame([(1, "one"), (2, "two"), (3, "few"), (4, "one"), (4, "two"), (5, None), (6, "one")], "qid long, domain string")
    questions = spark.createDataFrame([(i,) for i in range(1, 8)], "qid long")
    of, kept, degree, hubs = ppr.scope_graph(questions, wanted, relations.drop("domain"), relations.select("relation_id", "domain"))
    scope = {r["qid"]: r["scope"] for r in of.collect()}
    assert scope[3] == scope[5] == scope[7] == ppr.WHOLE and scope[1] == scope[6] and len(set(scope.values())) == 4
    size = {r["scope"]: r["n"] for r in kept.groupBy("scope").agg({"*": "count"}).toDF("scope", "n").collect()}
    assert [size[scope[q]] for q in (1, 2, 4, 3)] == [61, 80, 141, 145]
    named = {}
    for r in hubs.collect():
        named.setdefault(r["scope"], set()).add(r["entity_key"])
    assert [named[scope[q]] for q in (1, 2)] == [{"a"}, {"b"}] and named[scope[3]] == {"b"}
    seeds = spark.createDataFrame([(1, "x0"), (2, "x0"), (2, "nowhere"), (3, "x0"), (7, "c")], "qid long, entity_key string")
    ranks = {(r["qid"], r["relation_id"]) for r in ppr.scoped_relations(seeds, of, kept, degree, hubs, 200).collect()}
    of_rows = {f"r{i}": d for i, (_, _, d) in enumerate(rows)}
    assert {of_rows[r] for q, r in ranks if q == 1} == {"one"} and {of_rows[r] for q, r in ranks if q == 2} == {"two"}
    assert {of_rows[r] for q, r in ranks if q == 3} == {"one", "two"} and {of_rows[r] for q, r in ranks if q == 7} == {"few"}


def test_merged_gold(spark):
    relations = spark.createDataFrame([("g", "a", "b"), ("n1", "b", "c"), ("n2", "d", "d"), ("n3", "e", "f")], "relation_id string, subject_key string, object_key string")
    proof = spark.createDataFrame([("n1", "p_1_chunk_2"), ("n1", "p_1_chunk_1"), ("n1", "p_1_chunk_1"), ("n2", "p_1_chunk_1"), ("n3", "p_9_chunk_1")], "relation_id string, chunk_id string")
    gold = spark.createDataFrame([(1, ["g"], ["b", "a"], ["p_1_chunk_1"]), (2, ["g"], ["a"], []), (3, [], None, None)], "qid long, relation_ids array<string>, entity_keys array<string>, chunk_ids array<string>")
    candidates = spark.createDataFrame([(1, 1, "n2"), (1, 2, "n3"), (1, 3, "n1"), (2, 1, "n3")], "qid long, rank int, relation_id string")
    verdicts = spark.createDataFrame([(1, "n1", True), (1, "n2", True), (1, "n2", True), (1, "n3", False), (2, "n3", None), (9, "n1", True)], "qid long, relation_id string, accepted boolean")
    rows = {r["qid"]: r for r in goldset.merge_gold(gold, candidates, verdicts, relations, proof).collect()}
    one = rows[1]
    assert (one["relation_ids"], one["entity_keys"], one["chunk_ids"]) == (["g", "n1", "n2"], ["a", "b", "c", "d"], ["p_1_chunk_1", "p_1_chunk_2"])
    assert (one["n_distinct_chunks"], one["n_considered"], one["candidate_ids"], one["added_ids"]) == (1, 3, ["n2", "n3", "n1"], ["n2", "n1"])
    source = {(p["kind"], p["id"]): p["source"] for p in one["provenance"]}
    assert source["entity", "b"] == "gold" == source["chunk", "p_1_chunk_1"] and source["chunk", "p_1_chunk_2"] == "n1" == source["entity", "c"] and source["entity", "d"] == "n2"
    assert (rows[2]["relation_ids"], rows[2]["added_ids"], rows[2]["n_considered"]) == (["g"], [], 1)
    assert (rows[3]["relation_ids"], rows[3]["chunk_ids"], rows[3]["n_distinct_chunks"], rows[3]["n_considered"]) == ([], [], 0, 0)
