"""Domain routing by keywords, vectors and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import top_per


def keyword_scores(queries: DataFrame, domains: DataFrame) -> DataFrame:
    """qid, domain, hits: single words must be tokens of the question, as white space parts them; phrases and hyphenated
    keywords stand in it, where a hyphen is a space.

    Questions and phrases meet by the phrases' inner words (whole words of any question that holds the phrase), else, for
    phrases of two words, by all their pieces; so the join is an equi-join and only what shares a word is compared."""
    words = domains.select("domain", F.explode("keywords").alias("k")).withColumn("k", F.trim(F.lower("k"))).where("k <> ''").distinct()
    asked = queries.select("qid", F.lower("text").alias("t"))
    tokens = asked.select("qid", F.explode(F.array_distinct(F.split("t", r"\s+"))).alias("k"))
    words = words.withColumn("k", F.trim(F.when(F.col("k").rlike(r"[\s-]"), F.regexp_replace("k", "-", " ")).otherwise(F.col("k")))).where("k <> ''").distinct()
    plain = ~F.col("k").rlike(r"\s")
    single = tokens.join(words.where(plain), "k").select("qid", "domain", "k")
    phrases = words.where(~plain)
    spaced = asked.withColumn("t", F.regexp_replace("t", "-", " "))
    parts = F.filter(F.split("k", r"\s+"), lambda x: x != "")
    # a word within the phrase is whole in the question; the first may only end, and the last only begin, one there
    keyed = phrases.withColumn("p", parts).withColumn("key", F.when(F.size("p") > 2, F.concat(F.lit("w"), F.get("p", F.lit(1)))).otherwise(F.concat(F.lit("e"), F.substring(F.get("p", F.lit(0)), -3, 3))))
    one = F.filter(F.split("t", r"\s+"), lambda x: x != "")
    ends = F.transform(one, lambda x: F.concat(F.lit("e"), F.substring(x, -3, 3)))
    short = F.flatten(F.transform(one, lambda x: F.array(F.concat(F.lit("e"), F.substring(x, -1, 1)), F.concat(F.lit("e"), F.substring(x, -2, 2)))))
    keys = spaced.withColumn("key", F.explode(F.array_distinct(F.concat(F.transform(one, lambda x: F.concat(F.lit("w"), x)), ends, short))))
    met = keys.join(keyed, "key").where(F.contains("t", "k")).select("qid", "domain", "k")
    return single.unionAll(met).groupBy("qid", "domain").agg(F.count_distinct("k").alias("hits"))


def domain_rrf(lists: list[DataFrame], k: int = 10, top: int = 5) -> DataFrame:
    """qid, rank, domain, score of ranked domain lists, fused."""
    every = lists[0]
    for df in lists[1:]:
        every = every.unionByName(df)
    fused = every.groupBy("qid", "domain").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
    return top_per(fused, top, F.desc("score"), "domain").select("qid", "rank", "domain", "score")


def domain_vote(ranked: DataFrame, relation_domains: DataFrame, k: int = 5) -> DataFrame:
    """qid, domain, votes: the domain of most of the first k relations; ties go to the best rank, then the name."""
    votes = ranked.where(F.col("rank") <= k).join(relation_domains, "relation_id").groupBy("qid", "domain").agg(F.count(F.lit(1)).alias("votes"), F.min("rank").alias("best"))
    return top_per(votes, 1, F.desc("votes"), "best", "domain").select("qid", "domain", "votes")


def finalize_scope(pred: DataFrame, known: list[str]) -> DataFrame:
    """qid, domains: unknown names go; full or nothing gives none; a single scope keeps one name and a multiple one two;
    an emptied scope takes the first candidate."""
    kept = F.array_intersect("domains", F.array(*map(F.lit, known)))
    most = F.when(F.col("scope") == "single", 1).otherwise(2)
    some = F.when(F.size(kept) > 0, F.slice(kept, 1, most)).otherwise(F.slice("candidates", 1, 1))
    return pred.select("qid", F.when((F.col("scope") == "full") | (F.coalesce(F.size("domains"), F.lit(0)) <= 0), F.array().cast("array<string>")).otherwise(some).alias("domains"))


def norm_hints(queries: DataFrame, known: list[str], most: int = 10) -> DataFrame:
    from ..functions.text import snake

    hints = F.array_distinct(F.filter(F.transform("hints", snake), lambda x: x.isin(known)))
    return queries.select("qid", F.array_join(F.slice(hints, 1, most), ",").alias("hints"))


def single_domain_gate(pred: DataFrame, least: float = 0.5) -> DataFrame:
    """qid, passes: questions that are not complex and whose one domain is predicted with enough confidence."""
    none = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    return pred.select("qid", (~none("is_complex", False) & none("single_domain", False) & (none("confidence", 0.0) >= least)).alias("passes"))


def vote_domains(candidates: DataFrame, texts: DataFrame, domains: DataFrame, default: str = "GENERAL", relation: str | list[str] = "relation_id", of: str = "relation_id") -> DataFrame:
    """relation, domain: of each relation's candidates (relation, domain) the one whose keywords its text (of, text) hits most,
    ties by name; the default where none is hit. relation: the columns that name one; of: that of them by which texts are known.

    Candidates are dealt out once, by `of`, for the hits and for the vote."""
    keys = [relation] if isinstance(relation, str) else relation
    hits = keyword_scores(texts.select(F.col(of).alias("qid"), "text"), domains).select(F.col("qid").alias(of), "domain", "hits")
    lists = hits.groupBy(of).agg(F.collect_list(F.struct("domain", "hits")).alias("h"))
    own = F.get(F.filter("h", lambda x: x["domain"] == F.col("domain")), F.lit(0))["hits"]
    rated = candidates.join(lists, of, "left").select(*keys, F.struct((-own).alias("hits"), "domain").alias("r"))
    best = rated.groupBy(*keys).agg(F.min(F.when(F.col("r.hits").isNotNull(), F.col("r")))["domain"].alias("voted"))
    return best.select(*keys, F.coalesce("voted", F.lit(default)).alias("domain"))
