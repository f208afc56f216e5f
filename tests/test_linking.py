"""Name resolution, linking scores, citations and samplers against plain Python."""

import random
from difflib import SequenceMatcher, get_close_matches

from pyspark.sql import functions as F

from loomgraph.operators import fusion, goldset, linking, lookups, retrieval, routing
from loomgraph.sources.storage import stored


def resolved(word, names):
    low = word.lower()
    for name in names:
        if low in name.lower() or name.lower() in low:
            return name
    found = get_close_matches(word, names, n=1, cutoff=0.6)
    return found[0] if found else None


def test_fuzzy_resolve(spark):
    rng = random.Random(1)
    names = {s: [" ".join(rng.choice(["Steel", "North", "Pump", "Gas", "Ab", "x", "Works", "Office"]) for _ in range(rng.randint(1, 3))) + str(rng.randint(0, 9)) for _ in range(12)] for s in (1, 2)}
    asked = []
    for i in range(80):
        scope, word = rng.choice([1, 2]), list(rng.choice(names[rng.choice([1, 2])]))
        for _ in range(rng.randint(0, 3)):
            word[rng.randrange(len(word))] = rng.choice(["", "e", "S", " "])
        asked.append((i, scope, "".join(word) or "q"))
    asked += [(100, 1, "zzzzzz"), (101, 2, "b"), (102, 3, "Pump")]
    got = {r["qid"]: r["name"] for r in lookups.fuzzy_resolve(spark.createDataFrame(asked, "qid long, scope long, asked string"), spark.createDataFrame([(s, o, n) for s, v in names.items() for o, n in enumerate(v)], "scope long, ord long, name string")).collect()}
    assert got == {i: resolved(w, names.get(s, [])) for i, s, w in asked}


def test_docs_by_entity_and_domain(spark):
    held = spark.createDataFrame([(1, 0, "Gulf Pump", d) for d in range(15)] + [(1, 1, "Pump", 99)], "scope long, ord long, name string, doc long")
    asked = spark.createDataFrame([(1, 1, "pump"), (2, 1, "Gulf Pmup"), (3, 2, "Pump")], "qid long, scope long, asked string")
    got = [(r["qid"], r["name"], r["doc"]) for r in lookups.docs_by_entity(asked, held).orderBy("qid", "rank").collect()]
    assert got == [(q, "Gulf Pump", d) for q in (1, 2) for d in range(10)]
    domains = spark.createDataFrame([("low", 0, "Valves", 7), ("high", 0, "Valve systems", 8)], "level string, ord long, name string, doc long")
    asked = spark.createDataFrame([(1, "low", "valve"), (2, "mid", "valve"), (3, "low", "valve systems"), (4, "low", "nothing")], "qid long, level string, asked string")
    got = {r["qid"]: (r["level"], r["doc"]) for r in lookups.docs_by_domain(asked, domains).collect()}
    assert got == {1: ("low", 7), 2: ("high", 8), 3: ("high", 8)}


def test_docs_by_entity_keeps_each_step(spark):
    """A name's first documents are picked before it is resolved, and no step holds the sorts of all joins at once."""
    kept = []

    def keep(df):
        kept.append((df._jdf.queryExecution().optimizedPlan().toString().count("Join "), stored(df)))
        return kept[-1][1]

    held = spark.createDataFrame([(1, o, n, d) for o, n in ((0, "Gulf Pump"), (1, "Valve"), (2, "Valve")) for d in list(range(15)) * 2], "scope long, ord long, name string, doc long")
    asked = spark.createDataFrame([(1, 1, "pump"), (2, 1, "Vavle"), (3, 1, "Gulf Pump of Oslo")], "qid long, scope long, asked string")
    got = sorted((r["qid"], r["rank"], r["name"], r["doc"]) for r in lookups.docs_by_entity(asked, held, 4, keep).collect())
    assert got == [(q, d + 1, n, d) for q, n in ((1, "Gulf Pump"), (2, "Valve"), (3, "Gulf Pump")) for d in range(4)]
    assert kept[0][1].count() == 12
    assert max(n for n, _ in kept) <= 6


def likeness(hint, name, base, mediated):
    clean = lambda x: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in x.lower()).split())
    h, n = clean(hint), clean(name)
    if h == n:
        return 1.0
    if h in n or n in h:
        return base + 0.08 * min(len(h), len(n)) / max(len(h), len(n))
    words = lambda x: {w for w in x.split() if mediated or len(w) >= 3}
    overlap, ratio = len(words(h) & words(n)), SequenceMatcher(None, h, n).ratio()
    if mediated:
        return max(overlap / max(1, len(words(h))), 0.9 * ratio)
    return 0.65 * overlap / max(1, len(words(h))) + 0.35 * ratio if overlap else 0.0


def test_linking_scores(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["safety", "valve", "of", "gas", "main", "Unit-7", "line"])
    hints = [(q, " ".join(word() for _ in range(rng.randint(1, 3)))) for q in range(4) for _ in range(2)]
    cands = [(q, f"e{i}", [" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(2)], float(rng.randint(1, 9)), rng.choice(["a", "b"]), rng.sample(["x", "y", "z"], 2)) for q in range(4) for i in range(9)]
    asked = spark.createDataFrame([(q, ["a"], ["x", "y"]) for q in range(4)], "qid long, categories array<string>, labels array<string>")
    table = spark.createDataFrame(cands, "qid long, entity_key string, names array<string>, ft_score double, category string, labels array<string>")
    got = {(r["qid"], r["entity_key"]): r["score"] for r in linking.score_candidates(table, spark.createDataFrame(hints, "qid long, hint string"), asked).collect()}
    for q, key, names, ft, category, labels in cands:
        m = {h: max(likeness(h, n, 0.90, False) for n in names) for k, h in hints if k == q}
        top = max(c[3] for c in cands if c[0] == q)
        want = 0.70 * ft / top + 0.20 * max(m.values()) + 0.05 * sum(v >= 0.52 for v in m.values()) + 0.03 * len({"x", "y"} & set(labels)) + 0.02 * (category == "a")
        assert abs(got[q, key] - want) < 1e-6
    ranked = spark.createDataFrame([(q, c, f"c{c}") for q in range(4) for c in range(25)], "qid long, rank long, chunk_id string")
    mentions = [(f"c{c}", f"e{c % 5}", cands[c % 5][2]) for c in range(25)] + [("c0", "e4", cands[4][2])]
    got = {(r["qid"], r["entity_key"]): r["score"] for r in linking.chunk_mediated(spark.createDataFrame(hints, "qid long, hint string"), ranked, spark.createDataFrame(mentions, "chunk_id string, entity_key string, names array<string>")).collect()}
    assert len(got) == 20
    for (q, key), score in got.items():
        best = max(likeness(h, n, 0.88, True) for k, h in hints if k == q for n in cands[int(key[1:])][2])
        assert abs(score - best * len({c for c, e, _ in mentions if e == key and int(c[1:]) <= 20})) < 1e-6


def test_citations(spark):
    rows = {1: ("a [Source 3] b [1, 3]", "a [Source 1] b [Source 2, Source 1]", [3, 1]), 2: ("[sources 2 and 4] [7]", "[Source 1, Source 2] [7]", [2, 4]), 3: ("x [Source 9] y [2024]", "x [Source 9] y [2024]", [1, 2]), 4: ("[Source 9][ 1 & Source 2 ].", "[Source 1, Source 2].", [1, 2]), 5: ("", "", [1, 2]), 6: ("[99999999999999999999] [1]", "[99999999999999999999] [Source 1]", [1])}
    got = {r["answer_id"]: (r["text"], r["sources"]) for r in fusion.remap_citations(spark.createDataFrame([(k, v[0]) for k, v in rows.items()], "answer_id long, text string"), 5, fallback=2).collect()}
    assert got == {k: (v[1], v[2]) for k, v in rows.items()}
    assert fusion.cited_sources(spark.createDataFrame([(1, "a [2]")], "answer_id long, text string"), 5).collect()[0]["source"] == 2


def test_keywords_by_token_and_phrase(spark):
    asked = spark.createDataFrame([(1, "a fire-fighting system near the main gate"), (2, "fire at night"), (3, "un-maingateway")], "qid long, text string")
    domains = spark.createDataFrame([("d1", ["fire", "Fire fighting"]), ("d2", ["main-gate", "n main", "the main gate"])], "domain string, keywords array<string>")
    got = {(r["qid"], r["domain"]): r["hits"] for r in routing.keyword_scores(asked, domains).collect()}
    assert got == {(1, "d1"): 1, (2, "d1"): 1, (1, "d2"): 2, (3, "d2"): 1}


def test_query_terms_are_trimmed(spark):
    row = retrieval.query_terms(spark.createDataFrame([(1, [" gas pump ", ""], ["valve", "gas pump"])], "qid long, entity_hints array<string>, high_level_keywords array<string>")).first()
    assert row["terms"] == '"gas pump" OR valve'


def test_themes_and_trees(spark):
    raw = ["```json\n{\"themes\": [\"Cost, \", \"cost\", \"Time\"]}\n```", "well: {\"themes\": [\"A\"]} ok", "Themes:\n- One\n• \"Two\",\n{", None, "{\"themes\": \"x\"}"]
    got = [r["t"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i long, x string").orderBy("i").select(goldset.parse_themes(F.col("x")).alias("t")).collect()]
    assert got[:4] == [["Cost", "Time"], ["A"], ["One", "Two"], []]


def test_communities_have_modularity(spark):
    """Two dense groups with a bridge: the communities' modularity is that of the groups, and better than chance."""
    edges = [(a, b, 0.9) for g in (0, 10) for a in range(g, g + 6) for b in range(a + 1, g + 6)] + [(5, 10, 0.5)]
    got = {r["node"]: r["community"] for r in goldset.communities(spark.createDataFrame(edges, "src long, dst long, weight double"), 0.4).collect()}
    assert len(set(got.values())) == 2 and len({got[i] for i in range(6)}) == 1
    total = sum(w for _, _, w in edges)
    degree = {n: sum(w for a, b, w in edges if n in (a, b)) for n in got}
    q = sum(w for a, b, w in edges if got[a] == got[b]) / total - sum(degree[a] * degree[b] for a in got for b in got if got[a] == got[b]) / (2 * total) ** 2
    assert q > 0.4


def test_slips_meet_few_names(spark, monkeypatch):
    """Names with a letter less or more are found among a few candidates each, not among all names alike; others as before."""
    rng = random.Random(4)
    names = [f"Supplier {i}" for i in range(400)] + ["Supplierr 7", "Suplier 12x", "ab", "abcdef"]
    asked = [f"Suplier {i}" for i in range(0, 400, 3)] + [f"Suppplier {i}" for i in range(1, 90, 7)] + [f"Supplire {i}" for i in range(5)] + ["a b", "abcde f", "axbxcxdxexf"]
    rng.shuffle(names)
    met, rated = [], lookups._ratios
    monkeypatch.setattr(lookups, "_ratios", lambda pairs, least: met.append(pairs.count()) or rated(pairs, least))
    rows = spark.createDataFrame([(1, x) for x in names], "scope long, name string")
    got = lambda words: {r["qid"]: r["name"] for r in lookups.close_matches(spark.createDataFrame([(i, 1, x) for i, x in enumerate(words)], "qid long, scope long, asked string"), rows, 0.6).collect()}
    close = lambda words: {i: f[0] for i, w in enumerate(words) if (f := get_close_matches(w, names, n=1, cutoff=0.6))}
    slips = [f"Suplier {i}" for i in range(400)]
    assert got(slips) == close(slips)
    assert sum(met) < 3 * len(slips)
    assert got(asked) == close(asked)


def test_words_meet_the_texts_that_hold_them(spark):
    """A long number is looked up by more than three of its digits."""
    texts = spark.createDataFrame([(f"supplier {i}",) for i in range(3000)], "low string")
    words = spark.createDataFrame([(str(i),) for i in (1, 77, 123, 2999, 5000)] + [("supplier 12",), ("plier 2",), ("r 2999",)], "want string")
    want = sorted((f"supplier {i}", w["want"]) for w in words.collect() for i in range(3000) if w["want"] in f"supplier {i}")
    for longest in (3, 8):
        assert sorted(tuple(r) for r in lookups.holding(texts, words, ["low"], "low", "want", longest=longest).collect()) == want
