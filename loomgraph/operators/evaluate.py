"""Scores of ranked lists against gold sets, and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored


def recall_at_k(ranked: DataFrame, gold: DataFrame, ks: list[int], key: str = "chunk_id") -> DataFrame:
    """qid, n_gold and recall_at_k for each k, of every question with gold keys."""
    wanted = gold.select("qid", key).distinct()
    met = wanted.join(ranked.groupBy("qid", key).agg(F.min("rank").alias("rank")), ["qid", key], "left")
    return met.groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"), *[F.round(F.count_if(F.col("rank") <= k) / F.count(F.lit(1)), 9).alias(f"recall_at_{k}") for k in ks])


def mrr(ranked: DataFrame, gold: DataFrame, key: str = "chunk_id") -> DataFrame:
    wanted = gold.select("qid", key).distinct()
    first = wanted.join(ranked, ["qid", key], "left").groupBy("qid").agg(F.min("rank").alias("rank"))
    return first.select("qid", F.round(F.coalesce(1.0 / F.col("rank"), F.lit(0.0)), 9).alias("mrr"))


def hub_leakage(ranked: DataFrame, hubs: DataFrame, k: int, gold: DataFrame | None = None) -> DataFrame:
    """qid, leaked: hubs among the first k; gold ones are not counted if gold is given."""
    shown = ranked.where(F.col("rank") <= k).join(hubs.select(F.col("entity_key").alias("node"), F.lit(1).alias("hub")), "node", "left")
    if gold is not None:
        shown = shown.join(gold.select("qid", "node", F.lit(1).alias("gold")).distinct(), ["qid", "node"], "left").withColumn("hub", F.when(F.col("gold").isNull(), F.col("hub")))
    return shown.groupBy("qid").agg(F.count("hub").alias("leaked"))


def set_pr(pred: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """qid, n_common, precision and recall of the distinct keys; null where a side is empty."""
    both = pred.select("qid", key).distinct().withColumn("p", F.lit(1)).join(gold.select("qid", key).distinct().withColumn("g", F.lit(1)), ["qid", key], "full_outer")
    sums = both.groupBy("qid").agg(F.count("p").alias("np"), F.count("g").alias("ng"), F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("n_common"))
    share = lambda n: F.when(F.col(n) > 0, F.round(F.col("n_common") / F.col(n), 9))
    return sums.select("qid", "n_common", share("np").alias("precision"), share("ng").alias("recall"))


def slice_metrics(metrics: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    return metrics.cube(*by).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(v), 9).alias(f"avg_{v}") for v in values])


def gold_ranks(ranked: DataFrame, gold: DataFrame, key: str = "chunk_id") -> DataFrame:
    """qid, first_rank, n_found, n_missing, ranks of the gold keys."""
    met = gold.select("qid", key).distinct().join(ranked.groupBy("qid", key).agg(F.min("rank").alias("rank")), ["qid", key], "left")
    ranks = F.array_join(F.transform(F.array_sort(F.collect_list("rank")), lambda x: x.cast("string")), ",")
    return met.groupBy("qid").agg(F.min("rank").cast("long").alias("first_rank"), F.count("rank").alias("n_found"), F.count_if(F.col("rank").isNull()).alias("n_missing"), ranks.alias("ranks"))


def bridge_rank(ranked: DataFrame, proof: DataFrame, relations: DataFrame, bridges: DataFrame, key: str = "chunk_id") -> DataFrame:
    """qid, bridge_rank, relation_id of every question (qid, bridge): the first ranked chunk that asserts (proof: chunk_id,
    relation_id) a relation whose subject or object holds the bridge's name, without case; else null."""
    ends = F.lower(F.concat(F.coalesce("subject", F.lit("")), F.coalesce("object", F.lit(""))))
    rows = ranked.join(bridges.select("qid", F.lower("bridge").alias("bridge")), "qid").join(proof.select(key, "relation_id").distinct(), key)
    met = rows.join(relations.select("relation_id", ends.alias("ends")), "relation_id").where(F.contains("ends", "bridge"))
    first = met.groupBy("qid").agg(F.min(F.struct("rank", "relation_id")).alias("r"))
    return bridges.select("qid").join(first, "qid", "left").select("qid", F.col("r.rank").alias("bridge_rank"), "r.relation_id")


def noise_report(ranked: DataFrame, gold: DataFrame, boilerplate: Column, on_topic: Column, key: str = "chunk_id") -> DataFrame:
    """qid and counts of gold, boilerplate, on-topic and off-topic rows."""
    marked = ranked.join(gold.select("qid", key).distinct().withColumn("gold", F.lit(1)), ["qid", key], "left")
    kind = F.when(F.col("gold").isNotNull(), "gold").when(boilerplate, "boilerplate").when(on_topic, "on_topic").otherwise("off_topic")
    names = ["gold", "boilerplate", "on_topic", "off_topic"]
    return marked.withColumn("kind", kind).groupBy("qid").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in names])


def ab_compare(one: DataFrame, two: DataFrame) -> DataFrame:
    """qid, deltas of confidence, seconds and graph chunks, Jaccard of references (null if both are empty), changed."""
    both = one.alias("a").join(two.alias("b"), "qid")
    union, common = F.size(F.array_union("a.refs", "b.refs")), F.size(F.array_intersect("a.refs", "b.refs"))
    delta = lambda c: F.round(F.col(f"a.{c}") - F.col(f"b.{c}"), 9).alias(f"{c}_delta")
    return both.select("qid", delta("confidence"), delta("elapsed"), (F.col("a.graph_chunks") - F.col("b.graph_chunks")).alias("graph_chunks_delta"), F.when(union > 0, F.round(common / union, 9)).alias("jaccard"), (F.col("a.answer") != F.col("b.answer")).alias("changed"))


def domain_accuracy(results: DataFrame) -> DataFrame:
    """scope, n, n_correct, accuracy of predictions (scope, predicted, domain); full scope is not judged."""
    hit = F.when(F.col("scope") != "full", F.array_contains("predicted", F.col("domain")))
    return results.withColumn("hit", hit).groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("n_correct"), F.round(F.avg(F.col("hit").cast("int")), 9).alias("accuracy"))


def judge_summary(scores: DataFrame, dims: list[str], by: str = "run") -> DataFrame:
    long = scores.unpivot([by], dims, "dimension", "score")
    return long.groupBy(by, "dimension").agg(F.count("score").alias("n"), F.round(F.avg("score"), 9).alias("avg_score"))


def context_precision(verdicts: DataFrame, parts: int = 64) -> DataFrame:
    """qid, precision: average precision of 0/1 verdicts in the order of their ranks (any numbers; a null rank comes first,
    a null verdict counts as a place); 0 where none is 1. Equal ranks are placed by their verdict, 1 last.

    A question's rows are cut into about `parts` stretches of ranks, whose sizes and sums are added up first, so that no
    task holds a whole question."""
    rows = verdicts.select("qid", "rank", "verdict")
    bounds = stored(rows.groupBy(F.col("qid").alias("q")).agg(F.percentile_approx("rank", [i / parts for i in range(1, parts)]).alias("bounds")))  # read twice: kept as they are
    part = F.coalesce(F.size(F.filter("bounds", lambda x: x < F.col("rank"))), F.lit(0)).alias("part")
    rows = rows.join(bounds, F.expr("qid <=> q")).select("qid", "rank", "verdict", part)
    sums = rows.groupBy(F.col("qid").alias("q"), F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("verdict").alias("s"))
    before = Window.partitionBy("q").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # at most `parts` rows
    sums = sums.select("q", "p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("hits_before"))
    run = Window.partitionBy("qid", "part").orderBy("rank", "verdict")
    rows = rows.withColumn("n", F.row_number().over(run)).withColumn("hits", F.sum("verdict").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(sums, F.expr("qid <=> q and part = p")).withColumn("at", F.when(F.col("verdict") == 1, (F.col("hits") + F.col("hits_before")) / (F.col("n") + F.col("n_before"))))
    return rows.groupBy("qid").agg(F.round(F.coalesce(F.sum("at") / F.sum("verdict"), F.lit(0.0)), 9).alias("precision"))


def score_delta(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.select("qid", F.col("score").alias("a")).join(two.select("qid", F.col("score").alias("b")), "qid").select("qid", F.round(F.col("a") - F.col("b"), 9).alias("delta"))


def run_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("run").agg(F.count_if(F.col("error").isNull()).alias("n_ok"), F.count("error").alias("n_errors"), F.count("judged").alias("n_judged"), F.round(F.avg("elapsed"), 9).alias("avg_elapsed"), F.round(F.avg("judged"), 9).alias("avg_judged"))


def stage_latency(events: DataFrame) -> DataFrame:
    """run_id, stage, occurrence, status, seconds: the n-th start of a run's stage with its n-th end (done or error)."""
    start = F.col("status") == "start"
    number = F.row_number().over(Window.partitionBy("run_id", "stage", start).orderBy("ts", "event_id"))
    rows = events.withColumn("occurrence", number)
    both = rows.groupBy("run_id", "stage", "occurrence").agg(F.min(F.when(start, F.col("ts"))).alias("began"), F.min(F.when(~start, F.col("ts"))).alias("ended"), F.min(F.when(~start, F.col("status"))).alias("outcome"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return both.select("run_id", "stage", "occurrence", F.coalesce("outcome", F.lit("open")).alias("status"), F.round((micros("ended") - micros("began")) / 1e6, 6).alias("seconds"))
