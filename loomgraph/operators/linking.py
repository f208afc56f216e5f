"""Linking of a question's hints to entities of the graph, and similarity scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import loose_name
from .graph import min_max
from .retrieval import top_per


def hint_variants(queries: DataFrame) -> DataFrame:
    """qid, hint, variant: separators as spaces, without separators, joined; distinct by normal form."""
    forms = F.array("hint", F.regexp_replace("hint", "[-_/.]+", " "), F.regexp_replace("hint", "[-_/.]+", ""), F.regexp_replace("hint", r"\s+", ""))
    rows = queries.select("qid", "hint", F.posexplode(forms).alias("pos", "variant")).withColumn("norm", loose_name(F.col("variant"))).where("norm <> ''")
    return top_per(rows, 1, "pos", by=["qid", "hint", "norm"], rank="_n").select("qid", "hint", "variant")


def jaro_winkler(a: str | None, b: str | None) -> float:
    """Jaro-Winkler similarity, case ignored; over 0.7 the common prefix of up to 4 letters counts 0.1 each."""
    a, b = (a or "").lower(), (b or "").lower()
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(left, (y for y, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(len(a), len(b), 4))
    return jaro + 0.1 * same * (1 - jaro) if jaro > 0.7 else jaro


def sequence_ratio(a: str | None, b: str | None) -> float:
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a or "", b or "").ratio()


def scored_pairs(pairs: DataFrame, score: Callable[[str | None, str | None], float]) -> DataFrame:
    """a, b, score of the distinct pairs; names repeat, so they are compared once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["score"] = [score(a, b) for a, b in zip(batch["a"], batch["b"], strict=True)]
            yield batch

    return pairs.select("a", "b").distinct().mapInPandas(run, "a string, b string, score double")


def scorer(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], column: str = "ce_score") -> DataFrame:
    """rows with a score column from a user's model, which load() gives once for each Python worker's task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            batch[column] = model(batch).astype("float64")
            yield batch

    return rows.mapInPandas(run, rows.withColumn(column, F.lit(0.0)).schema)


def fuse_seeds(channels: list[tuple[str, DataFrame]], k: int = 60, top: int = 50, lists: tuple[str, ...] = ("aliases", "hints", "chunks")) -> DataFrame:
    """qid, rank, entity_key, rrf, norm, sources and lists: reciprocal ranks added up, the greatest scaled score, and the
    channels' lists merged: distinct, in the order of the channels, of the ranks in each and of the lists themselves. A
    channel that lacks a list has an empty one. Lists are gathered for the `top` entities only."""
    every = None
    for place, (name, df) in enumerate(channels):
        own = [(F.col(c) if c in df.columns else F.array().cast("array<string>")).alias(c) for c in lists]
        ranked = top_per(df.select("qid", "entity_key", "score", *own), 2**31 - 1, F.desc("score"), "entity_key")
        part = min_max(ranked, "score", "norm").withColumn("source", F.lit(name)).withColumn("place", F.lit(place))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("qid", "entity_key").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"), F.round(F.max("norm"), 9).alias("norm"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))
    best = top_per(fused, top, F.desc("rrf"), "entity_key")
    held = every.join(best.select("qid", "entity_key"), ["qid", "entity_key"], "left_semi").groupBy("qid", "entity_key").agg(F.array_sort(F.collect_list(F.struct("place", "rank", *lists))).alias("r"))
    merged = lambda c: F.array_distinct(F.flatten(F.transform("r", lambda x: F.coalesce(x[c], F.array().cast("array<string>"))))).alias(c)
    return best.join(held, ["qid", "entity_key"]).select("qid", "rank", "entity_key", "rrf", "norm", "sources", *[merged(c) for c in lists])


def apply_matches(cands: DataFrame, verdicts: DataFrame, least: float = 0.8) -> DataFrame:
    """Candidates with a MATCH verdict of enough confidence; the first verdict of a key counts."""
    good = verdicts.where((F.col("decision") == "MATCH") & (F.col("confidence") >= least))
    first = top_per(good, 1, "pos", by=["qid", "entity_key"], rank="_n").select("qid", "entity_key", "confidence")
    return cands.join(first, ["qid", "entity_key"])


def apply_dedup(cands: DataFrame, kept: DataFrame, removed: DataFrame) -> DataFrame:
    key = ["qid", "entity_key"]
    rest = cands.join(kept.select(key), key, "left_anti").join(removed.select(key), key, "left_anti")
    return cands.join(kept.select(key), key, "left_semi").unionByName(rest)


def with_fallback(filtered: DataFrame, every: DataFrame) -> DataFrame:
    """filtered, and all rows of every for the questions of which nothing is left."""
    return filtered.unionByName(every.join(filtered.select("qid").distinct(), "qid", "left_anti"))


# Words that are no terms of a query.
STOP = ["the", "a", "an", "and", "or", "of", "to", "for", "in", "on", "with", "by", "from", "about", "requirement", "requirements", "related", "relevant"]


def loose_terms(queries: DataFrame) -> DataFrame:
    """qid, terms of questions (qid, pos, hint): the words of each hint's variants, fuzzy ones (~1) from five letters on, and
    their phrase (~3); distinct in order, joined by OR."""
    forms = hint_variants(queries.select("qid", "hint").distinct()).join(queries.groupBy("qid", "hint").agg(F.min("pos").alias("pos")), ["qid", "hint"])
    toks = F.filter(F.split(loose_name(F.col("variant")), " "), lambda x: (F.length(x) >= 3) & ~x.isin(STOP))
    rows = forms.withColumn("toks", toks).withColumn("first", F.when(F.col("variant") == F.col("hint"), 0).otherwise(1))
    phrase = F.when(F.size("toks") >= 2, F.array(F.concat(F.lit('"'), F.array_join("toks", " "), F.lit('"~3')))).otherwise(F.array().cast("array<string>"))
    terms = F.concat(F.transform("toks", lambda x: F.when(F.length(x) >= 5, F.concat(x, F.lit("~1"))).otherwise(x)), phrase)
    every = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "first", (-F.length("variant")).alias("n"), "variant", terms.alias("terms")))).alias("a"))
    return every.select("qid", F.array_join(F.array_distinct(F.flatten(F.transform("a", lambda x: x["terms"]))), " OR ").alias("terms"))


def enrich_entities(keys: DataFrame, mentions: DataFrame, relations: DataFrame, n_chunks: int = 2, n_labels: int = 8, n_near: int = 8, full: Callable[[str], Column] = F.col) -> DataFrame:
    """entity_key, chunks, labels, neighbours of the keys: chunks that mention it, its relations' labels, and entities at the
    other ends, outgoing ones first; each cut and in order. full: the id that a column's keys stand for."""
    asked = keys.select("entity_key").distinct()

    def few(df: DataFrame, most: int, name: str, *order: str) -> DataFrame:
        key = full(name) if name == "neighbour" else F.col(name)
        kept = top_per(df, most, *order, key, by="entity_key", rank="_n").withColumn(name, key)
        return kept.groupBy("entity_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", name))), lambda x: x[name]), ",").alias(f"{name}s"))

    out = relations.where("subject_key <> object_key").join(asked.withColumnRenamed("entity_key", "subject_key"), "subject_key").select(F.col("subject_key").alias("entity_key"), "label", F.col("object_key").alias("neighbour"), F.lit(0).alias("side"))
    back = relations.where("subject_key <> object_key").join(asked.withColumnRenamed("entity_key", "object_key"), "object_key").select(F.col("object_key").alias("entity_key"), "label", F.col("subject_key").alias("neighbour"), F.lit(1).alias("side"))
    near = out.unionAll(back)
    parts = [
        few(mentions.join(asked, "entity_key", "left_semi").select("entity_key", F.col("chunk_id").alias("chunk")).distinct(), n_chunks, "chunk"),
        few(near.select("entity_key", "label").distinct(), n_labels, "label"),
        few(near.groupBy("entity_key", "neighbour").agg(F.min("side").alias("side")), n_near, "neighbour", "side"),
    ]
    for part in parts:
        asked = asked.join(part, "entity_key", "left")
    return asked.na.fill("", ["chunks", "labels", "neighbours"])


def _tokens(name: Column, least: int) -> Column:
    return F.array_distinct(F.filter(F.split(name, " "), lambda x: F.length(x) >= least))


def _contained(n: Column, h: Column, base: float) -> Column:
    length = F.least(F.length(n), F.length(h)) / F.greatest(F.length(n), F.length(h))
    return F.when(n == h, F.lit(1.0)).when(F.contains(n, h) | F.contains(h, n), base + 0.08 * length)


def overlap_ratio(name: Column, hint: Column, least: int = 3) -> Column:
    """The share of the hint's words (of `least` letters and more) that the name has; both in their loose form."""
    x, y = _tokens(name, least), _tokens(hint, least)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(y), F.lit(1))


def lexical_score(name: Column, hint: Column, ratio: Column) -> Column:
    """1 for equal names, 0.90 and more for containment, else overlap and sequence ratio blended; 0 without a shared word."""
    n, h = loose_name(name), loose_name(hint)
    overlap = overlap_ratio(n, h)
    return F.coalesce(_contained(n, h, 0.90), F.when(overlap > 0, 0.65 * overlap + 0.35 * F.coalesce(ratio, F.lit(0.0))).otherwise(F.lit(0.0)))


def _rated(pairs: DataFrame, needed: Column) -> DataFrame:
    """pairs (hn, cn) with ratio, worked out once for each distinct pair for which it is needed."""
    rated = scored_pairs(pairs.where(needed).select(F.col("hn").alias("a"), F.col("cn").alias("b")), sequence_ratio)
    return pairs.join(rated.select(F.col("a").alias("hn"), F.col("b").alias("cn"), F.col("score").alias("ratio")), ["hn", "cn"], "left")


def _names_by_hints(cands: DataFrame, hints: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hint, hn, cn: each name of each candidate with each hint of its question; a candidate's names are few."""
    names = cands.select(*keys, F.explode(F.array_distinct(F.transform("names", loose_name))).alias("cn")).where("cn <> ''")
    return names.join(hints.select("qid", "hint", loose_name(F.col("hint")).alias("hn")).where("hn <> ''").distinct(), "qid")


def score_candidates(cands: DataFrame, hints: DataFrame, asked: DataFrame) -> DataFrame:
    """qid, rank, entity_key, score, best, n_matched of candidates (qid, entity_key, names, ft_score, category, labels), by the
    hints (qid, hint) and what is asked for (qid, categories, labels)."""
    pairs = _names_by_hints(cands, hints, ["qid", "entity_key"])
    n, h = F.col("cn"), F.col("hn")
    pairs = _rated(pairs, _contained(n, h, 0.90).isNull() & (overlap_ratio(n, h) > 0))
    per_hint = pairs.withColumn("m", lexical_score(n, h, F.col("ratio"))).groupBy("qid", "entity_key", "hint").agg(F.max("m").alias("m"))
    best = per_hint.groupBy("qid", "entity_key").agg(F.max("m").alias("best"), F.count_if(F.col("m") >= 0.52).alias("n_matched"))
    top = F.max("ft_score").over(Window.partitionBy("qid"))
    rows = cands.withColumn("ft", F.col("ft_score") / F.when(top > 0, top).otherwise(F.lit(1.0))).join(best, ["qid", "entity_key"], "left")
    rows = rows.join(asked.select("qid", "categories", F.col("labels").alias("wanted")), "qid", "left").na.fill(0, ["best", "n_matched"])
    hits = F.coalesce(F.size(F.array_intersect("labels", "wanted")), F.lit(0))
    hits = F.when(hits > 0, hits).otherwise(F.lit(0))
    score = 0.70 * F.col("ft") + 0.20 * F.col("best") + 0.05 * F.col("n_matched") + 0.03 * hits + F.when(F.array_contains("categories", F.col("category")), 0.02).otherwise(0.0)
    scored = rows.select("qid", "entity_key", F.round(score, 9).alias("score"), F.round("best", 9).alias("best"), "n_matched")
    return top_per(scored, 2**31 - 1, F.desc("score"), "entity_key").select("qid", "rank", "entity_key", "score", "best", "n_matched")


def chunk_mediated(hints: DataFrame, ranked: DataFrame, mentions: DataFrame, n_chunks: int = 20, top: int = 20) -> DataFrame:
    """qid, rank, entity_key, score, n_matched: entities that the first chunks of a question mention (chunk_id, entity_key,
    names), by the sum over chunks of their best likeness to a hint."""
    met = ranked.where(F.col("rank") <= n_chunks).select("qid", "chunk_id").distinct().join(mentions, "chunk_id")
    entities = met.groupBy("qid", "entity_key").agg(F.first("names").alias("names"), F.count_distinct("chunk_id").alias("n_chunks"))
    n, h = F.col("cn"), F.col("hn")
    pairs = _rated(_names_by_hints(entities, hints, ["qid", "entity_key"]), _contained(n, h, 0.88).isNull())
    overlap = F.size(F.array_intersect(_tokens(n, 1), _tokens(h, 1))) / F.greatest(F.size(_tokens(h, 1)), F.lit(1))
    m = F.coalesce(_contained(n, h, 0.88), F.greatest(overlap, 0.9 * F.col("ratio")))
    per_hint = pairs.withColumn("m", m).groupBy("qid", "entity_key", "hint").agg(F.max("m").alias("m"))
    best = per_hint.groupBy("qid", "entity_key").agg(F.max("m").alias("best"), F.count_if(F.col("m") >= 0.30).alias("n_matched"))
    scored = entities.join(best, ["qid", "entity_key"], "left").na.fill(0, ["best", "n_matched"])
    scored = scored.select("qid", "entity_key", F.round(F.col("best") * F.col("n_chunks"), 9).alias("score"), "n_matched")
    return top_per(scored, top, F.desc("score"), "entity_key").select("qid", "rank", "entity_key", "score", "n_matched")
