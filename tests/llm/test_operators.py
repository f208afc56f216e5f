"""The ten operators against brute force, on small tables that hold nulls, ties, repeats, long texts and clashing names."""

import hashlib
import pathlib
import random
import re
import tracemalloc
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from loomgraph.llm import bpe, chat_format, decontamination, exact_topk, licenses, minhash_dedup, substring_dedup, token_counts, toxicity, warc
from loomgraph.llm.tables import read

WORD = r"[^\x20\x09-\x0D]+"
DOC = "doc_id long, text string, lang string, n_words long, score double, _text string, set_key long"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", 7, 0.5, "clash", 3) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOC)


def docs_of(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in read(spark, sf_dir, "documents").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(90)]

    def edited(rate):
        return " ".join(rng.choice(vocabulary) if rng.random() < rate else x for x in base)

    copies = [edited(r) for r in [0.0, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12] * 8]
    return [None, "", "  \n\t ", "one", "One two", "one two", *copies, " ".join(base), " ".join(base) + "\n" + " ".join(base), "For " * 3000, "\n".join(rng.choice(vocabulary) for _ in range(3000))]


# 6


def removed_by_hand(rows, k):
    words = {i: re.findall(WORD, t or "") for i, t in rows}
    met = Counter(tuple(v[j : j + k]) for v in words.values() for j in range(len(v) - k + 1))
    out = {}
    for i, v in words.items():
        gone = set()
        for j in range(len(v) - k + 1):
            if met[tuple(v[j : j + k])] > 1:
                gone.update(range(j, j + k))
        out[i] = (len(v), len(gone), " ".join(x for j, x in enumerate(v) if j not in gone))
    return out


@pytest.mark.parametrize("k", [5, 35])
def test_substring_dedup(spark, texts, k):
    rows = substring_dedup.remove_repeats(table(spark, texts), window=k).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in rows} == removed_by_hand(list(enumerate(texts)), k)


def test_op6_on_given_tables(spark, sf_dir):
    want = removed_by_hand(docs_of(spark, sf_dir), 35)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.op6_query(spark, sf_dir).collect()}
    assert got == {i: (n, m, hashlib.sha256(t.encode()).hexdigest()) for i, (n, m, t) in want.items()}


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.remove_repeats(table(spark, [])).collect() == []
    assert [r["n_removed"] for r in substring_dedup.remove_repeats(table(spark, [" ".join(map(str, range(40)))] * 2, [None, 1])).collect()] == [40, 40]


def test_equal_rows_are_dealt_over_buckets(spark, monkeypatch):
    text = " ".join(map(str, range(40)))
    docs = spark.createDataFrame([(None, text)] * 4000 + [(1, "a b")], DOC.split(", ")[0] + ", text string")
    spread = docs.select(F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(96)).alias("b")).groupBy("b").count()
    assert spread.agg(F.max("count")).first()[0] < 100
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == {(None, 40, 40, ""): 4000, (1, 2, 0, "a b"): 1}


# 9


def linked_by_hand(rows, k, percent):
    sets = {}
    for i, t in rows:
        v = re.findall(WORD, lower(t))
        sets[i] = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if len(v) >= k else ({tuple(v)} if v else set())
    above = {i: i for i in sets}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    ids = [i for i in sets if sets[i]]
    for a in ids:
        for b in ids:
            if a < b and percent * max(len(sets[a]), len(sets[b])) <= 100 * min(len(sets[a]), len(sets[b])):
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    above[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, texts, k, percent):
    rows = minhash_dedup.near_duplicates(table(spark, texts), shingle=k, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == linked_by_hand(list(enumerate(texts)), k, percent)


@pytest.mark.parametrize("percent", [60, 80, 85, 100])
def test_bands_of_the_threshold(spark, monkeypatch, percent):
    asked, signatures = [], minhash_dedup.signatures
    monkeypatch.setattr(minhash_dedup, "signatures", lambda docs, shingle, bands, rows, *more: asked.append((bands, rows)) or signatures(docs, shingle, bands, rows, *more))
    minhash_dedup.near_duplicates(table(spark, ["a b c"]), percent=percent)
    [(bands, rows)] = asked
    assert (1 - (percent / 100) ** rows) ** bands <= 1e-6


def test_near_duplicates_without_ids_and_rows(spark):
    assert minhash_dedup.near_duplicates(table(spark, [])).collect() == []
    rows = minhash_dedup.near_duplicates(table(spark, ["a b c d e f", "a b c d e f", None], [None, 4, 2])).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["component_id"], r["kept"]) for r in rows) == [((False, 2), 2, True), ((False, 4), 4, True), ((True, 0), None, True)]


def test_op9_on_given_tables(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.op9_query(spark, d).collect()}
    assert got == linked_by_hand(docs_of(spark, d), 3, 85)


def test_near_duplicates_of_repeated_rows_and_ids(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    near = " ".join([*base[:59], "other"])
    other = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(20)) for _ in range(300)]
    rows = [(1, " ".join(base))] * 3000 + [(1, " ".join(base).upper())] * 50 + [(2, near)] * 2000 + [(9, t) for t in other] + [(8, near)]
    sizes, cell = [], minhash_dedup._sets
    monkeypatch.setattr(minhash_dedup, "_sets", lambda *a: sizes.append(cell(*a)) or sizes[-1])
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(16)
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(docs, shingle=3, percent=85).collect())
    assert got == {(1, 1, True): 3050, (2, 1, False): 2000, (8, 1, False): 1, (9, 9, True): 300}
    assert sizes[0].count() == 2  # one set for each class, whatever its rows


def test_short_texts_are_sets_of_one(spark):
    texts = ["a b", "A  B", "b a", "c", "c", *[f"x{i}" for i in range(5000)]]
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(table(spark, texts)).collect()}
    assert rows == {i: (1, {1: 0, 4: 3}.get(i, i)) for i in range(len(texts))}


def test_sketches_fill_and_estimate():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(201, 1201, dtype=np.uint64)
    s = minhash_dedup.sketches(np.concatenate([a, b, a[:2]]), np.array([0, 1000, 2000, 2002]), 512)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.08
    assert (s != np.iinfo(np.uint64).max).all()


# 4


def test_bpe_is_the_library(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    odd = ["", None, "  ", "Don't WE'VE I'm", "ΣΑΣ İß ǅ ﬁ", "<|endoftext|> x<|startoftext|><|end", "a" * 700 + " " + "ab" * 90, "12² 漢字 \x1c\x85x", "🎉🎉 ok!!!", "é ₞"]
    odd += ["".join(chr(rng.choice([rng.randint(1, 300), rng.randint(0x300, 0x600), rng.randint(0x1E00, 0x2100)])) for _ in range(30)) for _ in range(200)]
    for rows in (list(enumerate(odd)), docs_of(spark, sf_dir)):
        out = {r["doc_id"]: r for r in bpe.encode_decode(table(spark, [t for _, t in rows], [i for i, _ in rows])).collect()}
        for i, text in rows:
            ids = other.encode(text or "", add_special_tokens=False).ids
            assert np.frombuffer(out[i]["ids"], "<u4").tolist() == ids and out[i]["n_tokens"] == len(ids)
            assert out[i]["decoded"] == other.decode(ids, skip_special_tokens=False)


def test_bpe_bounds_its_memory():
    coder, rng = bpe.Bpe(bpe.default_tokenizer()), random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop0123", k=20)) for _ in range(30_000)]
    tracemalloc.start()
    try:
        bpe.later_letters()
        assert tracemalloc.get_traced_memory()[1] < 10 << 20
        tracemalloc.reset_peak()
        found = coder.merged(words)
        assert tracemalloc.get_traced_memory()[1] < 24 << 20
    finally:
        tracemalloc.stop()
    assert all(found[w] == coder.merged([w])[w] for w in words[::1000])


# 1


def test_automaton_is_edit_distance():
    words = ["idiot", "clown", "worthless", "trash", "disgusting"]
    trie, rng = toxicity.Trie(words), random.Random(3)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(1500):
        word = list(rng.choice(words))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word))
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "x", "s"])
        word = "".join(word) or "x"
        for most in (1, 2):
            near = min((distance(word, v), v) for v in words)
            assert trie.near(word, most) == ((near[1], near[0]) if near[0] <= most else None)


def test_toxicity_learns_and_holds_out(spark, sf_dir):
    rows = toxicity.op1_query(spark, sf_dir.replace("sf0.001", "sf0.01")).join(read(spark, sf_dir.replace("sf0.001", "sf0.01"), "labels"), "doc_id").where("held_out").collect()
    hits = Counter((r["toxic"], r["predicted"]) for r in rows)
    assert hits[0, 1] <= 0.05 * (hits[0, 0] + hits[0, 1]) and hits[1, 1] >= 0.6 * (hits[1, 0] + hits[1, 1])


def test_toxicity_cases(spark):
    docs = table(spark, [f"you idiot number{i}" for i in range(30)] + [f"a kind word number{i}" for i in range(60)] + [None, "", "you idi0t", 'she said "idiot" to them', "kind " * 200_000, "kind " * 200_000 + "idiot", "you idiot number3"])
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(90)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    score = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(score) == 97 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in score.values())
    assert score[0]["predicted"] == 1 and score[40]["predicted"] == 0 and score[90]["score"] == score[91]["score"]
    assert score[92]["n_near_hits"] == 1 and score[92]["predicted"] == 1 and score[93]["n_exact_hits"] == 1 and score[93]["predicted"] == 0
    assert score[94]["score"] == score[91]["score"] < score[95]["score"] and score[96]["score"] == score[3]["score"]
    assert toxicity.score(docs.limit(0), model).collect() == []
    twice = toxicity.score(docs.where("doc_id = 3").unionAll(docs.where("doc_id = 3")), model, passed=("lang", "n_words")).collect()
    assert [(r["lang"], r["n_words"], r["score"]) for r in twice] == [("en", 7, score[3]["score"])] * 2
    unlabelled = toxicity.score(docs, toxicity.learn(docs, labels.where("toxic > 5"))).collect()
    assert {r["score"] for r in unlabelled} == {0.5} and len(unlabelled) == 97
    held = {r["doc_id"]: r["held_out"] for r in toxicity.score(docs.withColumn("doc_id", F.when(F.col("doc_id") != 5, F.col("doc_id"))), model).collect()}
    assert held == {None if i == 5 else i: i != 5 and zlib.crc32(str(i).encode()) % 3 == 1 for i in range(97)}


def test_quoting_lowers_and_misspelling_raises(spark):
    d = "/root/testdata/sf0.1"
    model = toxicity.learn(read(spark, d, "documents"), read(spark, d, "labels"))
    exact, exact_quoted, near, near_quoted = model.weights[:4]
    assert exact > 0 and near > 0 and exact_quoted < 0 and near_quoted < 0
    matcher = toxicity.Matcher(model)
    score = lambda t: float(np.dot(matcher.features(t), model.weights)) + model.bias
    plain = "the whole town says that nobody here is a %s and all go home"
    clean, abuse, wrong, quoted = (score(plain % x) for x in ("neighbour", "moron", "moronn", '"moron"'))
    assert quoted <= clean < wrong and clean < abuse and score(plain % '"moronn"') <= clean
    assert score(plain % '"moron" but a moron') > clean


def test_quotes():
    def quoted(text, word="idiot"):
        at = text.index(word)
        return toxicity.Quotes(text).around(at, at + len(word))

    assert quoted('said "idiot" to') and quoted("„idiot“ x") and quoted("“you idiot”") and quoted("«un idiot»")
    assert quoted("he said ‘you idiot’ to") and quoted("called 'an idiot' by it's owner") and quoted("> you idiot") and quoted("so:\n >> an idiot\nno") and quoted('"the dogs\' idiot"')
    assert not quoted("don't be an idiot, it's") and not quoted("the dogs' idiot") and not quoted("> a\nidiot") and not quoted("rock 'n' roll idiot") and not quoted("a > idiot")
    assert not quoted("an idiot here") and not quoted('"a" idiot "b"') and not quoted('"a\nidiot" x') and not quoted('a" ' + "x " * 60 + 'idiot "b')
    assert not quoted('token = "abc" idiot token = "def"') and not quoted('"idiot')


# 2


def best_alignment(item, text):
    """The best local alignment's score of word numbers, divided by a full match's; plain dynamic programming by rows."""
    row, best = np.zeros(len(text) + 1, np.int64), 0
    for x in item:
        new = np.maximum(0, row - 1)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(text == x, 2, -1))
        step = np.arange(len(new))
        row = np.maximum.accumulate(new + step) - step
        best = max(best, int(row.max()))
    return best / (2 * len(item))


def test_op2_by_hand(spark):
    d = "/root/testdata/sf0.01"
    numbers = {}

    def words(text):
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
        return np.array([numbers.setdefault(x, len(numbers)) for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)], np.int64)

    items = {r["item_id"]: words(r["text"]) for r in read(spark, d, "benchmark").collect()}
    assert min(map(len, items.values())) >= 6
    want = {}
    for i, text in docs_of(spark, d):
        own = words(text)
        for k, item in items.items():
            if np.isin(item, own).mean() >= 0.6 and (score := best_alignment(item, own)) >= 0.6:
                want[i, k] = score
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.op2_query(spark, d).collect()}
    assert got.keys() == want.keys() and len(want) >= 20 and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_decontamination_of_odd_rows(spark):
    rng = random.Random(3)
    passage = lambda n: " ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(300)) for _ in range(n))
    items = [(1, passage(20)), (1, passage(20)), (2, passage(4)), (3, "one two"), (4, passage(12)), (4, None), (None, passage(9)), (5, "")]
    edited = items[2][1].split()
    docs = [(1, f"x {items[0][1]} y"), (1, f"x {items[0][1]} y"), (1, items[1][1] + " tail"), (None, items[4][1]), (None, items[4][1] + " z"), (2, "a " + items[2][1]), (3, " ".join([edited[0], "other", *edited[2:]])), (4, "one two"), (5, None), (6, ""), (7, "q " * 300_000 + items[4][1]), (8, items[6][1])]
    df = spark.createDataFrame([(i, t, 3) for i, t in docs], "doc_id long, text string, item_id int")
    asked = spark.createDataFrame([(i, t, 0.5) for i, t in items], "item_id long, text string, score double")
    for block in (1 << 24, 200):
        got = sorted(map(tuple, decontamination.contaminated(df, asked, block_bytes=block).collect()), key=str)
        want = [(1, 1, 1.0, 1, 20), (None, 4, 1.0, 0, 11), (2, 2, 1.0, 1, 4), (7, 4, 1.0, 300_000, 300_011), (8, None, 1.0, 0, 8)]
        assert got == sorted(want, key=str)


def score_by_hand(text, item):
    a, b = (re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x)) for x in (item, text))
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j] - 1, new[-1] - 1, row[j - 1] + (2 if x == y else -1)))
        row, best = new, max(best, *new)
    return best / (2 * len(a))


def test_decontamination_of_edited_copies(spark):
    item = "the quick silver fox jumps over seven lazy dogs while nine old owls watch from a broken tower at dawn"
    edited = item.replace("seven", "eight").replace("old owls", "owls").replace("watch from", "look on from")
    docs = table(spark, ["filler words " * 50 + edited + " more filler" * 50, "filler " * 400, None, "", item.upper(), item])
    items = spark.createDataFrame([(1, item), (2, None), (3, "short"), (4, "")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.contaminated(docs, items).collect()}
    assert set(got) == {0, 4, 5} and got[5]["score"] == 1.0 and 0.6 <= got[0]["score"] < 1 and got[0]["first_word"] == 100
    assert abs(got[0]["score"] - score_by_hand("filler words " * 50 + edited, item)) < 1e-9
    assert decontamination.contaminated(docs.limit(0), items).collect() == [] and decontamination.contaminated(docs, items.limit(0)).collect() == []


def test_decontamination_of_long_repetitive_texts():
    """The memory does not grow with the product of a text's and an item's repeats; blocks change no result."""
    item = " ".join(["lorem ipsum"] * 20 + ["dolor sit amet"] * 7)
    index = decontamination.Seeds([(1, item)], 3, 0.6, 6, 3)
    index.choose(np.zeros(len(index.every), np.int64))

    def hashed(text):
        return pa.RecordBatch.from_pydict({"doc_id": [5], "words": [decontamination._words(pa.array([text]))[0].astype("<u8").tobytes()]})

    part = hashed("lorem ipsum " * 830_000 + item + " lorem ipsum" * 100)  # 10 MB
    tracemalloc.start()
    got = list(decontamination._aligned(part, index))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r[:3] + r[4:] for r in got] == [(5, 1, 1.0, 1_660_060)] and peak < 200 << 20, peak
    assert list(decontamination._aligned(hashed("lorem ipsum " * 100_000 + "dolor " * 100_000), index))[0][2] == score_by_hand("lorem ipsum " * 100 + "dolor " * 100, item)


def test_blocks_of_alignment_change_nothing(monkeypatch):
    rng = random.Random(8)
    item = " ".join(rng.choice("abcde") for _ in range(12))
    texts = [" ".join(rng.choice("abcdefgh" if k % 2 else "abcde") for _ in range(400)) for k in range(30)] + [item + " x" * 300 + " " + item, item]
    index = decontamination.Seeds([(1, item), (2, item[4:])], 3, 0.6, 6, 3)
    index.choose(np.zeros(len(index.every), np.int64))
    words = [decontamination._words(pa.array([t]))[0].astype("<u8").tobytes() for t in texts]
    part = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "words": words})
    whole = list(decontamination._aligned(part, index))
    assert {r[0]: r[2] for r in whole if r[1] == 1} == {i: s for i, t in enumerate(texts) if (s := score_by_hand(t, item)) >= 0.6}
    monkeypatch.setattr(decontamination, "BLOCK", 7)
    monkeypatch.setattr(decontamination, "OWNERS", 3)
    assert list(decontamination._aligned(part, index)) == whole


def test_decontamination_of_copies_with_most_trigrams_broken(spark):
    item = " ".join(f"t{i}" for i in range(20))
    changed = [" ".join(f"x{i}" if i in at else f"t{i}" for i in range(20)) for at in ((4, 9, 14), (3, 8, 13, 17), (2, 5, 8, 11, 14, 17))]
    stuffed = " ".join(f"t{i}" + (f" y{i}" if i % 2 else "") for i in range(20))
    rng = random.Random(11)
    mixed = [" ".join(y for i in range(20) for y in rng.choice([[f"t{i}"]] * 6 + [[f"z{i}"], [], [f"t{i}", "and"]])) for _ in range(60)]
    texts = [*changed, stuffed, *mixed]
    docs = table(spark, ["some other words " * 9 + t + " at the end" * 30 for t in texts])
    got = {r["doc_id"]: r["score"] for r in decontamination.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    want = {i: score_by_hand(t, item) for i, t in enumerate(texts)}
    assert got == {i: s for i, s in want.items() if s >= 0.6} and {0, 1, 3} <= set(got) and 2 not in got


def test_decontamination_of_upper_cased_copies(spark):
    items = {1: "été après été, où élèves et âmes zélées étaient à l’école ébahies", 2: "die größere straße über flüsse und bäche führt schließlich südwärts zu häusern", 3: "ο γρήγορος λύκος πηδά πάνω από τους τεμπέληδες σκύλους", 4: "plain words of one item that are written in full width"}
    texts = [items[1].upper(), items[2].upper(), items[3].upper(), "".join(chr(ord(c) + 0xFEE0) if c != " " else c for c in items[4]), "e\u0301te\u0301 apre\u0300s e\u0301te\u0301, ou\u0300 e\u0301le\u0300ves et a\u0302mes ze\u0301le\u0301es e\u0301taient a\u0300 l’e\u0301cole e\u0301bahies", "ÉTÉ ÂMES", "\U0001f389 " * 30]
    docs = table(spark, ["un mot " * 20 + t + " et puis" * 20 for t in texts])
    asked = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["score"]) for r in decontamination.contaminated(docs, asked).collect()}
    assert got == {(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 1, 1.0)}
    broken = docs.select("doc_id", F.expr("concat(text, cast(x'ff' as string))").alias("text"))
    assert decontamination.contaminated(broken, asked).count() == 5


# 3


@pytest.mark.parametrize(("block", "pivots"), [(8192, None), (40, 3)])
def test_exact_topk(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(exact_topk, "CANDIDATE_BLOCK", block)
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(300)]
    vectors += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [1.0, 2.0]), (None, [0.0] * 6), (304, vectors[5][1]), (305, vectors[5][1]), (306, [])]
    vectors += [(7, vectors[7][1]), (7, vectors[7][1]), (20, vectors[20][1]), (307, [4e7, 0.0, 0.0, 0.0, 0.0, 0.0]), (320, [1e8 + 0.5, -3e7, 1e8, 2e8, 1.0, 0.1]), (308, [1e8, 1e8, -1e8, 5.0, 1e7, 0.0]), (340, [1e17, 0.0, 1.0, 0.0, 0.0, 0.0]), (309, [-1e17, 1e17, 0.0, 0.0, 0.0, 1.0]), (310, [1.7e308] * 6)]
    df = spark.createDataFrame([(i, v, "clash", 5) for i, v in vectors], "vec_id long, embedding array<double>, data string, row int")
    got = sorted(tuple(r) for r in exact_topk.top_k(df, F.col("vec_id") % 20 == 0, k=7, pivots=pivots).collect())
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in vectors if i not in (None, 310) and v and all(x is not None and np.isfinite(x) for x in v)]
    want, most = [], 2**63 - 1
    for q, x in {(i, tuple(v)) for i, v in whole if i % 20 == 0}:
        scores = sorted((-max(-most - 1, min(most, sum(a * b for a, b in zip(x, v, strict=True)))), i) for i, v in whole if i != q and len(v) == len(x))
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:7], 1)]
    assert got == sorted(want) and len(got) == 17 * 7
    assert exact_topk.top_k(df.limit(0), F.lit(True)).collect() == [] and exact_topk.top_k(df, F.lit(False)).collect() == []
    one = exact_topk.top_k(df.where("vec_id in (0, 1)"), F.lit(True)).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in one) == [(0, 1), (1, 0)]


def test_topk_eliminates(spark):
    d = "/root/testdata/sf0.01"
    done = exact_topk.top_k(read(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, work=True).collect()
    assert len(done) == 25 and sum(r["n_evaluated"] for r in done) < 0.5 * sum(r["n_candidates"] for r in done)


def test_op3_is_sql(spark, sf_dir):
    duckdb.sql(f"create or replace view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    assert sorted(map(tuple, exact_topk.op3_query(spark, sf_dir).collect())) == sorted(duckdb.sql(exact_topk.OP3_SQL).fetchall())


# 5


def chats_by_hand(rows):
    """(conv_id, turn) -> reply_to, thread_root, depth, n_linked; and the messages' own words. One message a turn."""
    white = re.compile(r"[ \t\n\x0b\f\r]+")
    normal = lambda t: white.sub(" ", t.lower()).strip(" ")
    marks = re.compile(r"[ \t\x0b\f\r]{0,3}((?:>[ \t\x0b\f\r]?)+)")
    says = re.compile(r"\s*(On|Am|Le|El)\b.*(wrote|schrieb|écrit|escribió)\b.*:\s*$")

    def pieces(t):
        parts = [t, *re.split(r"\n[ \t\n\x0b\f\r]*\n", t), *t.split("\n"), *re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", t), *(y for x in t.split("\n") for y in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", x))]
        return {x for x in map(normal, parts) if x}

    def words(t):
        return (regex.sub(r"[^\p{L}\p{N}]+", " ", t.lower()).strip(" ") or normal(t)).split(" ")

    own, quotes = {}, {}
    for c, t, _, text in rows:
        lines = (text or "").split("\n")
        level = [m[1].count(">") if (m := marks.match(x)) else 0 for x in lines]
        after = lambda i: level[i + 1 : i + 2] != [0] and level[i + 1 : i + 2] or lines[i + 1 : i + 2] != [] and not lines[i + 1].strip(" ") and level[i + 2 : i + 3] not in ([], [0])  # noqa: B023, E731
        own[c, t] = "\n".join(x for i, x in enumerate(lines) if not level[i] and not (says.match(x) and after(i)))
        runs, last = [], None
        for i, n in enumerate(level):
            if n:
                if last != n:
                    runs.append((n, []))
                runs[-1][1].append(marks.sub("", lines[i], count=1))
            last = n
        quotes[c, t] = [(n, "\n".join(x)) for n, x in runs if normal("\n".join(x))]
    offered, stretches = {}, {}
    for (c, t), text in sorted(own.items(), key=lambda x: x[0][1] if None not in x[0] else -1):
        if c is not None and t is not None:
            for x in pieces(text):
                offered.setdefault((c, x), t)
            v = words(text)
            for size in range(1, chat_format.SHINGLE + 1):
                for i in range(len(v) - size + 1):
                    stretches.setdefault((c, tuple(v[i : i + size])), t)
    links = {}
    for (c, t), passages in quotes.items():
        found = []
        for level, text in passages if c is not None and t is not None else ():
            near = [(-len(x), offered[c, x]) for x in pieces(text) if offered.get((c, x), t) < t and len(x) >= 0.5 * len(normal(text))]
            if near:
                found.append((level, -min(near)[1]))
                continue
            v = words(text)
            size = chat_format.SHINGLE
            every = {(c, tuple(v[i : i + size])) for i in range(len(v) - size + 1)}
            votes = Counter(stretches[k] for k in every if stretches.get(k, t) < t)
            if votes and max(votes.values()) >= 0.5 * len(every):
                found.append((level, -min(votes, key=lambda s: (-votes[s], s))))
        if found:
            links[c, t] = (-min(found)[1], len(found))
    out = {}
    for c, t in own:
        root, depth = t, 0
        while (c, root) in links:
            root, depth = links[c, root][0], depth + 1
        out[c, t] = (links.get((c, t), (None,))[0], root, depth, links.get((c, t), (None, 0))[1])
    return out, {k: re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", x) for k, x in own.items()}


CHAT = "conv_id long, turn long, role string, text string"


def test_chat_format(spark):
    rows = [(1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "> Hello there\nfine"), (1, 2, "user", ">> hello  there\n> fine\nok, On it\n"), (1, 3, "user", "new topic"), (1, 4, "user", "On Monday X wrote:\n> new topic\nreply"), (2, 0, None, None), (1, 5, "user", "> not there\nz"), (2, 1, "user", ">"), (2, 1, "user", ">"), (None, 3, "user", "> x"), (3, 0, "user", "if a > b\nOn Monday he wrote:\nfoo"), (3, 1, "user", "On Monday he wrote:\nOn Tuesday she wrote:\n\n> if a > b\n <|end|> x")]
    df = spark.createDataFrame([(*r, 9) for r in rows], CHAT + ", depth int")
    found = chat_format.format_chats(df).collect()
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["thread_root"], r["depth"], r["text"]) for r in found}
    assert got[1, 1] == (0, 0, 1, "fine") and got[1, 2] == (1, 0, 2, "ok, On it") and got[1, 4] == (3, 3, 1, "reply")
    assert got[1, 5] == (None, 5, 0, "z") and got[2, 0] == (None, 0, 0, "") and got[2, 1] == (None, 1, 0, "")
    assert got[3, 0] == (None, 0, 0, rows[10][3]) and got[3, 1] == (0, 0, 1, "On Monday he wrote:\n\n <|end|> x")
    assert {r["formatted"] for r in found if r["conv_id"] == 3 and r["turn"] == 1} == {"<|user|>\nOn Monday he wrote:\n\n <\\|end|> x\n<|end|>"}
    assert len(found) == len(rows) and chat_format.format_chats(df.limit(0)).collect() == []
    whole = {(r["conv_id"], r["thread_root"]): r for r in chat_format.assemble(chat_format.format_chats(df)).collect()}
    assert whole[1, 0]["turns"] == [0, 1, 2] and whole[1, 0]["replies"] == [None, 0, 1] and whole[1, 0]["text"] == "<|user|>\nHello there\nHow are you?\n<|end|>\n<|assistant|>\nfine\n<|end|>\n<|user|>\nok, On it\n<|end|>"
    assert whole[2, 1]["n_messages"] == 1 and (None, 3) in whole and sum(r["n_messages"] for r in whole.values()) == len(rows) - 1
    assert chat_format.assemble(chat_format.format_chats(df.limit(0))).collect() == []


def test_hot_messages_and_long_texts(spark):
    rows = [(1, 0, "user", "the first of all\n" + "long words " * 200_000)] + [(1, i, "user", f"> the first of all\nanswer {i}") for i in range(1, 1500)] + [(2, 7, "user", f"same turn {i}") for i in range(2000)]
    found = chat_format.format_chats(spark.createDataFrame(rows, CHAT))
    assert found.where("conv_id = 1 and turn > 0 and reply_to = 0 and depth = 1 and thread_root = 0").count() == 1499
    parts = chat_format.assemble(found).collect()
    assert max(r["n_messages"] for r in parts) < 1400 and sum(r["n_messages"] for r in parts) == len(rows)
    assert {(r["conv_id"], r["part"], tuple(r["turns"])) for r in parts if r["conv_id"] == 1} == {(1, i, tuple(range(256 * i, min(1500, 256 * i + 256)))) for i in range(6)}


def test_op5_by_hand(spark):
    d = "/root/testdata/sf0.01"
    derived = chat_format.quoted_replies(read(spark, d, "conversations"))
    rows = [tuple(r) for r in derived.collect()]
    want, own = chats_by_hand(rows)
    found = chat_format.format_chats(derived).collect()
    assert {(r["conv_id"], r["turn"]): (r["reply_to"], r["thread_root"], r["depth"], r["n_linked"]) for r in found} == want
    assert {(r["conv_id"], r["turn"]): r["text"] for r in found} == own
    assert sum(x[0] is not None for x in want.values()) > 0.6 * len(rows) and max(x[2] for x in want.values()) >= 5 and max(x[3] for x in want.values()) >= 2
    threads = {}
    for r in sorted(found, key=lambda r: r["turn"]):
        threads.setdefault((r["conv_id"], r["thread_root"]), []).append(r)
    got = {(r["conv_id"], r["thread_root"]): (r["turns"], r["replies"], r["n_linked"], r["text"]) for r in chat_format.op5_query(spark, d).collect()}
    assert got == {k: ([r["turn"] for r in v], [r["reply_to"] for r in v], sum(r["n_linked"] for r in v), "\n".join(r["formatted"] for r in v)) for k, v in threads.items()}


def test_partial_quotes(spark):
    first = "one two three\nfour five six\nseven eight nine\n\nsecond part here. It goes on\n\nthird part, which is long and ends here"
    quotes = {2: "> one two three\n> four five six", 3: "> second part here. It goes on\n>\n> third part, which is long and ends here", 4: "> third part, which is", 5: "> It goes on", 6: "> eight", 7: "> one two three\n> seven eight nine", 8: "> goes on third part", 9: "> unlike all others"}
    rows = [(1, 0, "user", "unrelated talk"), (1, 1, "user", first), *((1, t, "user", q + f"\nanswer {t}") for t, q in quotes.items())]
    got = {r["turn"]: (r["reply_to"], r["text"]) for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {t: got[t] for t in quotes} == {t: (None if t in (6, 9) else 1, f"answer {t}") for t in quotes}


def test_quotes_from_elsewhere_stay_unlinked(spark):
    first = "Yes, we can do that on Monday. Kind regards\n\nThe plan has four steps, and the last of them is the hardest"
    quotes = {
        2: "> yes",
        3: "> According to the manual the valve must be closed before any of the work can start here.\n> Kind regards",
        4: "> A report says that the last of them was sold in spring, long after all others had left the yard",
        5: "> A poem of many lines, none of which was written here. Kind regards",
        6: "> the plan has four steps, and the last",
        7: "> Kind regards",
        8: "> can do",
    }
    rows = [(1, 0, "user", "yes"), (1, 1, "user", first), *((1, t, "user", q + f"\nanswer {t}") for t, q in quotes.items())]
    rows += [(2, 0, "user", "no"), (2, 1, "user", first), (2, 2, "user", "> yes\nanswer")]
    got = {(r["conv_id"], r["turn"]): r["reply_to"] for r in chat_format.format_chats(spark.createDataFrame(rows, CHAT)).collect()}
    assert {t: got[1, t] for t in quotes} == {2: 0, 3: None, 4: None, 5: None, 6: 1, 7: 1, 8: None} and got[2, 2] is None


def test_long_reply_chains(spark):
    rows = [(1, i, "user", f"> unique words {i - 1}\nunique words {i}" if i else "unique words 0") for i in range(40)]
    got = {r["turn"]: (r["reply_to"], r["thread_root"], r["depth"]) for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {i: (i - 1 if i else None, 0, i) for i in range(40)}


# 7


def test_op7_is_sql(spark, sf_dir):
    duckdb.sql(f"create or replace view pages as select * from '{sf_dir}/pages.parquet'")
    assert {tuple(r) for r in warc.op7_query(spark, sf_dir).collect()} == set(duckdb.sql(warc.OP7_SQL).fetchall())


def test_revisits(spark):
    schema = "record_id long, kind string, url string, ts long, etag string, last_modified string, headers map<string,string>, span string"
    rows = [
        (1, "response", "http://www.Ex.org/a/?ref=1", 5, "e1", None, {"A": "1", "Date": "x", "Content-Length": "9"}, ""),
        (2, "response", "https://ex.org:443/a", 200_000, "e2", "m", None, ""),
        (3, "revisit", "ex.org/a#f", 900_000, 'W/e2', None, {"Date": "y", "Content-Length": "0"}, ""),
        (4, "revisit", "ex.org/a", 6, "e1", None, {"Date": "z"}, ""),
        (5, "revisit", "ex.org/a", 5, "e1", None, None, ""),
        (6, "revisit", "ex.org/a", 7, "other", None, None, ""),
        (7, "revisit", None, 7, "e1", None, None, ""),
        (8, "revisit", "ex.org/a", 300_000, None, "m", None, ""),
        (9, "revisit", "ex.org/a", 300_001, None, None, None, ""),
    ]
    got = {r["record_id"]: (r["response_id"], r["status"], r["headers"]) for r in warc.resolve_revisits(spark.createDataFrame(rows, schema)).collect()}
    assert got[3][:2] == (2, "resolved") and got[4] == (1, "resolved", {"A": "1", "Date": "z", "Content-Length": "9"})
    assert got[5][:2] == (None, "unresolved") and got[6][:2] == (1, "mismatch") and got[7][:2] == (None, "unresolved")
    assert got[8][:2] == (2, "resolved") and got[9][:2] == (2, "unchecked") and len(got) == 7


def test_revisits_of_hot_urls(spark):
    schema = "record_id long, kind string, url string, ts long, etag string, last_modified string, headers map<string,string>, url_key string"
    rows = [(i, "response", "http://a.org/x", 10 + i // 500, f"e{i}", None, {"H": "v" * 50}, "") for i in range(2000)]
    rows += [(i, "revisit", "http://www.a.org/x/", 12, "e999", None, {"Date": str(i)}, "") for i in range(5000, 7000)]
    rows += [(9000, "revisit", "http://a.org/x", 11, "e499", None, {}, "")] * 3 + [(9001, "revisit", "http://a.org/" + "long/" * 20_000, 11, "e499", None, {}, "")]
    got = warc.resolve_revisits(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 2004 and {(r["response_id"], r["status"]) for r in got if r["ts"] == 12} == {(999, "resolved")}
    assert [(r["response_id"], r["status"], r["headers"]) for r in got if r["record_id"] == 9000] == [(499, "resolved", {"H": "v" * 50})] * 3
    assert [r["status"] for r in got if r["record_id"] == 9001] == ["unresolved"]
    assert warc.resolve_revisits(spark.createDataFrame([], schema)).collect() == []
    assert warc.resolve_revisits(spark.createDataFrame(rows[:5], schema)).collect() == []


# 8


def test_separator_scan(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    (tmp_path / "f").mkdir()
    want = {}
    for name in ("a", "b", "c", "d"):
        tokens = [9 if rng.random() < {"a": 0.00002, "b": 0.3, "c": 0, "d": 0.0001}[name] else rng.randint(10, 99) for _ in range({"c": 70_000}.get(name, 300_000))] + ([9] if name == "b" else [])
        (tmp_path / "f" / name).write_bytes(np.array(tokens, "<u2").tobytes())
        runs, n = [], 0
        for x in tokens:
            if x == 9:
                runs.append(n)
                n = 0
            else:
                n += 1
        want |= {(name, i): v for i, v in enumerate(runs + [n] * bool(n))}
    for size in (2, 1024):
        monkeypatch.setattr(token_counts, "SUPER", size)
        files = token_counts.listed(spark, f"file://{tmp_path}/f")
        got = {(r["file_id"].rsplit("/", 1)[-1], r["document"]): r["n_tokens"] for r in token_counts.separator_scan(files, separator=9).collect()}
        assert got == want


def test_op8(spark, sf_dir):
    import public_tokenizers

    encode = token_counts._encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).encode_ordinary
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.op8_query(spark, sf_dir).collect()}
    assert got == {i: len(encode(t or "")) for i, t in docs_of(spark, sf_dir)}


def test_token_files_of_odd_rows(spark):
    texts = ["one two", None, "", "one two", "many words " * 100_000, "x"]
    docs = table(spark, texts, [1, 2, 3, 1, 5, None]).unionAll(table(spark, ["one two"], [1])).withColumn("file_id", F.lit("clash"))
    files = token_counts.stored(token_counts.token_files(docs, token_counts.new_folder(spark)))
    assert files.where("bytes is not null").agg(F.sum("bytes")).first()[0] == 2 * (7 + 3 * 2 + 200_001 + 1)
    counts = token_counts.separator_scan(files.where("bytes is not null").select("file_id", "bytes"))
    names = files.where("bytes is null").select("file_id", F.posexplode("doc_ids").alias("i", "doc_id"), "number").withColumn("document", F.col("number") + F.col("i"))
    got = Counter((r["doc_id"], r["n_tokens"]) for r in names.join(counts, ["file_id", "document"]).collect())
    assert got == {(1, 2): 3, (2, 0): 1, (3, 0): 1, (5, 200_001): 1, (None, 1): 1}
    none = token_counts.stored(token_counts.token_files(docs.limit(0), token_counts.new_folder(spark)))
    assert token_counts.separator_scan(none.where("bytes is not null").select("file_id", "bytes")).collect() == []


# 10


def test_licenses(spark, sf_dir):
    rows = docs_of(spark, sf_dir) + [(-1, None), (-2, ""), (-3, "The MIT  license; mit-License"), (-4, "Redistribution and use in source or binary forms, with or without any modification are permitted provided that these following conditions are met"), (-5, "x " * 500 + "This work is licensed under a Creative Commons Attribution 4.0 International License " + "y " * 500)]
    got = {r["doc_id"]: r for r in licenses.scan(table(spark, [t for _, t in rows], [i for i, _ in rows])).collect()}
    for i, text in rows:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places = [(j, label) for p, label in licenses.PHRASES.items() for j in range(len(v)) if v[j : j + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(v), len(places), min(places)[0] if places else None, max(places)[0] if places else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and r["labels"] == ",".join(sorted({x for _, x in places} | contained(text)))
    assert got[-4]["labels"] == "bsd" and got[-5]["labels"] == "cc" and got[-3]["n_base"] == 2 and got[-5]["template_ids"] == "cc-by-4.0-notice,cc-by-sa-4.0-notice"
    assert licenses.scan(table(spark, [])).collect() == []
    twice = [tuple(r) for r in licenses.scan(table(spark, ["MIT License " * 3, "MIT License " * 3, "w " * 300_000 + "mit license"], [None, None, 4])).collect()]
    assert sorted(twice, key=str) == sorted([(None, 6, 3, 0, 4, "mit", "mit", 1.0, "")] * 2 + [(4, 300_002, 1, 300_000, 300_000, "mit", "mit", 1.0, "")], key=str)


def contained(text):
    """Labels of templates of which some stretch of twice their words, or some line's block, holds enough words and enough of
    the word pairs that no other label has; templates that are part of a larger one found are left out."""
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
    pairs = lambda x: set(zip(x, x[1:], strict=False))
    known = [(label, split(t)) for _, label, t in licenses.TEMPLATES]
    v = split(text or "")
    lines = [split(x) for x in (text or "").split("\n")]
    blocks = [x[i : i + 2 * licenses.STRIDE] for x in lines for i in range(0, max(1, len(x) - licenses.STRIDE), licenses.STRIDE)]
    found = []
    for label, words in known:
        own, size = set(words), 2 * len(words)
        if len(own.intersection(v)) < 0.8 * len(own):
            continue
        signs = pairs(words) - set().union(*(pairs(x) for other, x in known if other != label))
        stretches = blocks + [v[i : i + size] for i in range(len(v)) if v[i] in own]
        if any(len(own.intersection(x)) >= 0.8 * len(own) and len(signs & pairs(x)) >= 0.5 * len(signs) for x in stretches):
            found.append((label, own))
    return {label for label, own in found if not any(other != label and len(larger) > len(own) and len(own & larger) >= 0.8 * len(own) for other, larger in found)}


def test_labels_of_real_licenses_and_of_near_misses(spark):
    """Openings and notices of public licenses, in contexts that name other licenses too, and texts that only look like them."""
    text = {name: t for name, _, t in licenses.TEMPLATES}
    gpl = text["gpl-header"] + "\nThe GNU General Public License does not permit incorporating your program into proprietary programs. If this is what you want to do, use the GNU Lesser General Public License instead of this License." + " other words" * 120 + " Use with the GNU Affero General Public License."
    cases = [
        ("Released under the MIT License.", "mit"),
        ("Released under the BSD License.", ""),
        ("Distributed under the terms of the Artistic License", ""),
        ("Released under the Apple License", ""),
        ("Licensed under the Apache License, Version 2.0", "apache"),
        ("Licensed under the Academic License, Version 2.0", ""),
        (gpl, "gpl"),
        (text["lgpl-header"], "gpl,lgpl"),
        (text["agpl-header"], "agpl,gpl"),
        (text["lgpl-3.0-text"], "gpl,lgpl"),
        (text["mpl-1.1-header"], "mpl"),
        (text["apache-2.0-header"], "apache"),
        (text["gfdl-preamble"], "gfdl"),
        (text["artistic-1.0-preamble"], "artistic"),
        (text["cc0-1.0-text"], "cc0"),
        ("Permission is hereby granted to any person who obtains a copy of the key", ""),
    ]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(table(spark, [t for t, _ in cases])).collect()}
    assert [got[i] for i in range(len(cases))] == [label for _, label in cases]


def test_labels_of_the_systems_licenses(spark):
    want = {"Apache-2.0": "apache", "Artistic": "artistic", "BSD": "bsd", "CC0-1.0": "cc0", "GFDL-1.2": "gfdl,gpl", "GFDL-1.3": "gfdl,gpl", "GPL-1": "gpl", "GPL-2": "gpl", "GPL-3": "gpl", "LGPL-2": "gpl,lgpl", "LGPL-2.1": "gpl,lgpl", "LGPL-3": "gpl,lgpl", "MPL-1.1": "mpl", "MPL-2.0": "gpl,mpl"}
    folder = pathlib.Path("/usr/share/common-licenses")
    there = sorted(n for n in want if (folder / n).is_file())
    if not there:
        pytest.skip("no license files on this system")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(table(spark, [(folder / n).read_text(errors="replace") for n in there])).collect()}
    assert {n: got[i] for i, n in enumerate(there)} == {n: want[n] for n in there}


def test_whole_license_texts(spark):
    rows = list(licenses.TEMPLATES)
    wrapped = ["\n".join(" ".join(t.split()[i : i + 11]) for i in range(0, len(t.split()), 11)) for _, _, t in rows]
    docs = table(spark, ["plain words before\n" * 40 + t + "\nplain words after" * 40 for t in wrapped])
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, (name, label, _) in enumerate(rows):
        assert label in got[i]["labels"].split(",") and name in got[i]["template_ids"].split(",") and contained(docs.collect()[i]["text"]) <= set(got[i]["labels"].split(","))


def test_wrapped_and_long_licenses(spark):
    mit = "Copyright 2020 X\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin it"
    apache = "# you may not use this file except in compliance\n# with the License. You may obtain a copy of\n# the License at"
    gpl = "\n * ".join("This program is free software: you can redistribute it and/or|modify it under the terms of the GNU General Public License as|published by the Free Software Foundation".split("|"))
    far = "\n".join(x + " q" * 40 for x in dict((n, t) for n, _, t in licenses.TEMPLATES)["bsd-grant"].split())
    texts = [mit, apache, gpl, far, "a b " * 300 + "\n" + mit]
    got = {r["doc_id"]: (r["labels"], r["base_labels"]) for r in licenses.scan(table(spark, texts)).collect()}
    assert got == {0: ("mit", ""), 1: ("apache", ""), 2: ("gpl", "gpl"), 3: ("", ""), 4: ("mit", "")}
    long = [f"v{i}" for i in range(300)]
    wrapped = "\n".join(" ".join(long[i : i + 9]) for i in range(0, 300, 9))
    less = " ".join(x for i, x in enumerate(long) if i % 4)
    texts = ["k " * n + t for n in (0, 31, 64, 100) for t in (wrapped, " ".join(long), less)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(table(spark, texts), templates=[("a", "long", " ".join(long)), ("b", "two", "u1 u2")]).collect()}
    assert got == {i: ("", 0.0) if i % 3 == 2 else ("long", 1.0) for i in range(12)}


# pipeline


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = read(spark, sf_dir, "documents")
    toxic = {r["doc_id"] for r in toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels"))).where("predicted = 1").collect()}
    left = [(i, t) for i, t in docs_of(spark, sf_dir) if i not in toxic]
    near = linked_by_hand(left, 5, 80)
    left = [(i, t) for i, t in left if near[i][2]]
    cut = removed_by_hand(left, pipeline.REPEATED_WORDS)
    left = [(i, cut[i][2] if cut[i][1] else t) for i, t in left]
    items = [(r["item_id"], r["text"]) for r in read(spark, sf_dir, "benchmark").collect()]
    leaked = {r["doc_id"] for r in decontamination.contaminated(table(spark, [t for _, t in left], [i for i, _ in left]), read(spark, sf_dir, "benchmark")).collect()}
    assert {i for i, t in left for _, y in items if y in (t or "")} <= leaked
    got = {r["doc_id"]: r["n_tokens"] for r in pipeline.run(spark, sf_dir).collect()}
    coder = bpe.Bpe(bpe.default_tokenizer())
    assert got == {i: len(coder.encode([t])[0]) // 4 for i, t in left if i not in leaked}


def test_pipeline_of_repeated_rows_and_null_ids(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    passage = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(7)) for _ in range(n))
    twice, unnamed, one, other, copied, shared, leak = passage(80), passage(70), passage(60), passage(60), passage(90), passage(65), passage(30)
    rows = [(1, twice), (1, twice), (None, unnamed), (None, unnamed), (None, unnamed), (2, one), (2, other), (3, copied), (4, copied + " end"), (4, shared), (None, copied)]
    rows += [(5, passage(40)), (5, passage(10) + " " + leak + " " + passage(10)), (None, passage(12) + " " + leak), (6, None), (7, "")]
    fill = [(100 + i, passage(30)) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + fill], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in fill], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter((r["doc_id"], r["decoded_sha256"]) for r in pipeline.run(spark, str(tmp_path)).collect())
    left = [(1, twice), (None, unnamed), (2, one), (2, other), (3, copied), (4, shared), rows[11], (6, None), (7, ""), *fill]
    decoded = bpe.encode_decode(spark.createDataFrame(left, "doc_id long, text string")).select("doc_id", F.sha2(F.col("decoded").cast("binary"), 256))
    assert got == Counter(map(tuple, decoded.collect()))


def test_pipeline_stages_send_small_batches(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(5000).cast("long").alias("n_chars")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, before = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    try:
        for name, stage in pipeline.STAGES:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
            stage(spark, docs.limit(0), str(tmp_path))
            assert max(r["size"] for r in docs.mapInArrow(sizes, "size long").collect()) < 5 << 20, name
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
    assert pipeline.run(spark, str(tmp_path)).count() == 1
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    passage = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(7)) for _ in range(n))
    leak, long = passage(20), " ".join(f"é{i}" for i in range(100_000))
    toxic = [(100 + i, f"you idiot number{i} {passage(5)}", "en", "s", 3) for i in range(30)]
    clean = [(200 + i, passage(30), "en", "s", 3) for i in range(60)]
    odd = [(1, None, None, None, None), (None, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "", None, "s", 0), (3, " \n ", "en", None, 3), (4, long, "fr", "s", None)]
    twice = [(5, passage(70), "en", "s", 9)] * 2 + [(None, passage(70), "en", "s", 9)] * 2
    held = [(6, f"a {leak} b {passage(30)}", "en", "s", 1), (None, leak, "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [*odd, *twice, *held, *toxic, *clean]
    docs = spark.createDataFrame(rows, schema).select("*", *[F.lit(1).alias(c) for c in ("row_id", "score", "predicted", "set_key", "_text", "_bucket", "words", "ids", "held_out")])
    spark.createDataFrame([(r[0], 1, int(r in toxic)) for r in toxic + clean], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/in")
    docs, d = spark.read.parquet(f"{tmp_path}/in"), str(tmp_path)
    as_rows = lambda df: Counter(map(tuple, df.collect()))
    kept = [r for r in rows if r not in toxic]
    want = {
        "toxicity": Counter(kept),
        "minhash_near_dedup": Counter(rows) - Counter([twice[0], twice[2]]),
        "substring_dedup": Counter([*(r for r in rows if r not in twice), *((i, "", lang, s, 0) for i, _, lang, s, _ in twice)]),
        "decontamination": Counter(r for r in rows if r not in held),
    }
    for name, stage in pipeline.STAGES:
        out, none = stage(spark, docs, d), stage(spark, docs.limit(0), d)
        assert none.collect() == [] and none.columns == out.columns
        if name in want:
            assert out.columns == pipeline.COLUMNS and as_rows(out) == want[name], name
        else:
            got = {(r["doc_id"], r["lang"], r["n_tokens"]) for r in out.collect()}
            assert out.count() == len(rows) and {(1, None, 0), (None, "en", 0), (2, "en", 0)} <= got
