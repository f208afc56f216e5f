"""URL filter, ranked search and centroid clustering against brute force and SQL, on tables with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from loomgraph.llm import orchard, ranked_search, registry, url_filter

TABLES = ("documents", "benchmark", "pages", "embeddings")


@pytest.mark.parametrize("name", ["op11_url_filter", "op12_ranked_search", "op13_orchard_clusters"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = registry.queries()[name](spark, sf_dir)
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    order = lambda rows: sorted(rows, key=repr)
    assert order(tuple(r[c] for c in rel.columns) for r in df.collect()) == order(rel.fetchall())


# 11


def url_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/EN/1", "https://a.example.net/en/1?x#y", "https://example.net/en", "ftp://net/x", "x://internet/x", "://org/fr/", "http://É.ORG/fr/2", "http://example.com#/de/", "http://example.com?a=/de/", "http://a.example.com/de/1/2/3/4/5/6", "http://h/" + "a/" * 20_000, "http://h/" + "b" * 100_000, "http://a://b/c", "http://h/a\nb?c", "http://" + "a." * 3000 + "org/fr/x"]


def rule_by_hand(host, path, rules):
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[2:] if fit else (None, None)


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash", 5, "r") for i, u in enumerate(URLS * 2)] + [(None, URLS[4], "", 1, None)], "page_id long, url string, host string, n int, rule string")
    rows = url_filter.judge(pages, url_filter.rule_table(spark, url_filter.RULES)).collect()
    assert len(rows) == pages.count()
    for r in rows:
        host, path = url_by_hand(URLS[4] if r["page_id"] is None else (URLS * 2)[r["page_id"]])
        rule, verdict = rule_by_hand(host, path, url_filter.RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or "allow")


def test_longer_rules_win_and_ends_are_labels(spark):
    rules = (("block", "b.org", "/x/"), ("allow", "a.b.org", "/"), ("block", "a.b.org", "/y"))
    urls = ["http://a.b.org/x/1", "http://a.b.org/yz", "http://c.b.org/x/1", "http://ab.org/x/1", "http://xa.b.org/y"]
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.rule_table(spark, rules)).collect()
    assert {r["page_id"]: r["rule"] for r in rows} == {0: "a.b.org/", 1: "a.b.org/y", 2: "b.org/x/", 3: None, 4: None}


def test_templates(spark):
    rng = random.Random(3)
    names = ["".join(rng.choices("abcdefghij", k=8)) for _ in range(60)]
    urls = [f"http://shop.example/item/{i}" for i in range(60)] + [f"http://shop.example/user/{n}/posts" for n in names] + [f"http://shop.example/{a}/{i}.html" for a in ("en", "es") for i in range(50)]
    marks = [("http://shop.example/item/9", 1)]
    rules = (("block", "shop.example", "/item/1"), ("block", "shop.example", "/item/2"), ("block", "shop.example", "/item/3"), ("allow", "shop.example", "/en/1"), ("block", "shop.example", "/user/a"), ("allow", "shop.example", "/user/b"))
    rows = {r["url"]: r for r in url_filter.judge(spark.createDataFrame([(u, u) for u in urls], "url string, page_id string"), url_filter.rule_table(spark, rules), id_col="url", url_col="page_id").collect()}
    item = rows[marks[0][0]]
    assert (item["rule"], item["verdict"], item["n_labelled"]) == (None, "block", sum(str(i)[0] in "123" for i in range(60)))
    assert all(rows[u]["verdict"] == "allow" for u in urls if "/es/" in u or "/en/" in u)
    assert {rows[u]["template"] for u in urls if "/user/" in u} == {"/user~/*/posts~"}
    assert all(r["verdict"] == "allow" for u, r in rows.items() if "/user/" in u and r["rule"] is None)


def test_alike_branches_merge_but_not_with_blocked_ones(spark):
    urls = [f"http://a.example.com/{x}/{i}" for x in ("en", "es", "fr", "de") for i in range(40)]
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.rule_table(spark, url_filter.RULES)).collect()
    assert {(r["path"][:3], r["template"], r["verdict"]) for r in rows} == {("/en", "/fr~/#~", "allow"), ("/es", "/fr~/#~", "allow"), ("/fr", "/fr~/#~", "allow"), ("/de", "/de/#~", "block")}


def test_no_urls_and_no_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, url_filter.rule_table(spark, url_filter.RULES)).collect() == []
    one = spark.createDataFrame([(1, "http://x.net/a")], "page_id long, url string")
    assert [(r["rule"], r["verdict"]) for r in url_filter.judge(one, url_filter.rule_table(spark, ())).collect()] == [(None, "allow")]


# 12

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def search_by_hand(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    full = [b for _, b in bags if b]
    n, total = len(full), sum(sum(b.values()) for b in full)
    df = Counter(t for b in full for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        scored = []
        for at, (i, b) in enumerate(bags):
            m = 25 + 75 * sum(b.values()) * n // total if total else 0
            s = sum(weight[t] * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, at))
        out += [(item, rank, None if no else i, -s) for rank, (s, no, i, _) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 3, "x", 9) for i, t in docs], "doc_id long, text string, score int, term string, block int").repartition(3)
    q = spark.createDataFrame([(i, t, "y", 1) for i, t in items], "item_id long, text string, doc_id string, rank int").repartition(2)
    return sorted([tuple(r) for r in ranked_search.search(d, q, **more).collect()], key=repr)


def test_ranked_search(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BUNDLE_ITEMS", 4)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["Éa", "éa", "naïve", "x2", "日本"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choices(words, weights=range(len(words), 0, -1), k=n))
    docs = [(i, text(rng.randint(1, 40))) for i in range(300)] + [(None, text(9)), (None, "w0 w1"), (7, "w0 w1 W1"), (7, "w0 w1 W1"), (400, None), (401, ""), (402, " -- "), (403, text(60_000)), (404, "w9 " * 5000)]
    docs += [(500 + i, "tie word") for i in range(30)]
    items = [(i, text(rng.randint(1, 30))) for i in range(25)] + [(None, "w1 w1 W1"), (3, "w1"), (3, "w1"), (90, None), (91, ""), (92, "nowhere"), (93, "tie"), (94, text(3000))]
    assert found(spark, docs, items) == search_by_hand(docs, items)
    assert found(spark, docs, items, k=3) == search_by_hand(docs, items, 3)


def test_ranked_search_of_nothing(spark):
    assert found(spark, [], [(1, "a")]) == [] == found(spark, [(1, "a")], [])
    assert found(spark, [(1, None), (2, " ")], [(1, "a")]) == []
    assert found(spark, [(1, "a")], [(1, "A a")]) == search_by_hand([(1, "a")], [(1, "A a")])


def test_large_lengths_are_exact():
    lengths = np.array([0, 1, 10**9, 10**12])
    n, total = 10**11, 10**15
    assert ranked_search._norms(lengths, n, total).tolist() == [25 + 75 * int(x) * n // total for x in lengths]


# 13


def clusters_by_hand(rows, k=16, dim=64, rounds=3, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    middle = [v for _, v in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        near = [min((square(v, c), j) for j, c in enumerate(middle)) for _, v in kept]
        for j in range(len(middle) if turn < rounds else 0):
            own = [v for (_, v), (_, c) in zip(kept, near, strict=True) if c == j]
            if own:
                middle[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    most = 2**63 - 1
    near = [(min(d, most), c) for d, c in near] if kept else []
    sums = Counter()
    for d, c in near:
        sums[c] += d
    return sorted(((i, c, d, min(sums[c], most), min(sum(sums.values()), most), hashlib.sha256(",".join(map(str, middle[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, near, strict=True)), key=repr)


def clustered(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance int").repartition(3)
    return sorted([tuple(r) for r in orchard.cluster(df, **more).collect()], key=repr)


def odd_vectors(wide):
    rng = random.Random(4)
    one = lambda size: [float(np.float32(rng.gauss(0, size))) for _ in range(64)]
    rows = [(i, one(10 ** rng.randint(-1, 2))) for i in range(150)] + [(None, one(1)), (None, one(1)), (5, one(2)), (5, one(3))]
    rows += [(200, None), (201, one(1)[:63]), (202, []), (203, [math.nan, *one(1)[1:]]), (204, [math.inf, *one(1)[1:]]), (205, [None, *one(1)[1:]]), (206, [0.0] * 64), (207, [0.0] * 64)]
    return rows + [(300 + i, one(1e35)) for i in range(9)] * wide


@pytest.mark.parametrize("wide", [0, 1])
def test_clusters(spark, wide):
    rows = odd_vectors(wide)
    assert clustered(spark, rows) == clusters_by_hand(rows)


def test_clusters_of_few(spark):
    assert clustered(spark, []) == [] == clustered(spark, [(1, None), (2, [1.0])])
    for n in (1, 2, 15, 17):
        rows = odd_vectors(0)[:n]
        assert clustered(spark, rows) == clusters_by_hand(rows)
    same = [(i, [1.0] * 64) for i in range(40)]  # all centroids alike: ties go to the smallest number
    assert clustered(spark, same) == clusters_by_hand(same)
    with pytest.raises(ValueError):
        orchard.centroids(spark.createDataFrame([], "vec_id long, embedding array<float>"), k=orchard.MOST_CENTROIDS + 1)


def test_orchard_search_stops_early():
    rng = np.random.default_rng(1)
    middle = rng.integers(-1000, 1000, (64, 4))
    x = middle[rng.integers(0, 64, 5000)] + rng.integers(-40, 40, (5000, 4))
    own, best, work = orchard.Centroids(middle.tolist()).nearest(x)
    far = ((x[:, None] - middle[None]) ** 2).sum(2)
    assert (far.argmin(1) == own).all() and (far.min(1) == best).all()
    assert work < 0.5 * x.shape[0] * 64
