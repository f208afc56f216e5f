"""One-hop and dual-level retrieval over the relation graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_whitespace
from ..sources.storage import stored
from .retrieval import top_per


def scope_relations(relations: DataFrame, relation_domains: DataFrame, domains: list[str] | None) -> DataFrame:
    if domains is None:
        return relations
    return relations.join(relation_domains.where(F.col("domain").isin(domains)), "relation_id", "left_semi")


def sources(relations: DataFrame, assertions: DataFrame, most: int = 3) -> DataFrame:
    """The relations with up to `most` asserting chunk ids, in order, as one string."""
    asked = assertions.join(relations.select("relation_id").distinct(), "relation_id", "left_semi").select("relation_id", "chunk_id").distinct()
    few = top_per(asked, most, "chunk_id", by="relation_id")
    lists = few.groupBy("relation_id").agg(F.array_join(F.array_sort(F.collect_list("chunk_id")), ",").alias("source_chunks"))
    return relations.join(lists, "relation_id", "left")


def local_relations(seeds: DataFrame, relations: DataFrame, weights: DataFrame, degrees: DataFrame, pool: int, tie: Column | str = "relation_id") -> DataFrame:
    """qid, rank, relation_id, weight: relations at a seed (qid, entity_key), by weight, then the ends' degrees, then tie.

    Pools over 1000, which Spark does not cut before the shuffle, are first cut within 16 shares of a question's relations."""
    ends = relations.select("relation_id", "subject_key", "object_key", F.explode(F.array("subject_key", "object_key")).alias("entity_key"))
    met = seeds.join(ends, "entity_key").select("qid", "relation_id", "subject_key", "object_key").dropDuplicates(["qid", "relation_id"])
    degree = lambda side: degrees.select(F.col("entity_key").alias(f"{side}_key"), F.col("degree").alias(f"{side}_degree"))
    met = met.join(weights.select("relation_id", F.col("aggregated_weight").alias("weight")), "relation_id", "left").join(degree("subject"), "subject_key", "left").join(degree("object"), "object_key", "left")
    met = met.withColumn("weight", F.round(F.coalesce("weight", F.lit(0.0)), 9)).withColumn("degrees", F.coalesce("subject_degree", F.lit(0)) + F.coalesce("object_degree", F.lit(0)))
    order = (F.desc("weight"), F.desc("degrees"), tie)
    if pool > 1000:
        met = top_per(met.withColumn("share", F.pmod(F.xxhash64("relation_id"), F.lit(16))), pool, *order, by=["qid", "share"])
    return top_per(met, pool, *order).select("qid", "rank", "relation_id", "weight")


def expand_context(wanted: DataFrame, chunks: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """wanted (chunk_id) with the texts of the chunks before and after in the same document, by sequence number.

    keep stores the wanted chunks where they are few, so that only their neighbours are joined."""
    own = wanted.join(chunks.select("chunk_id", "doc", "sequence_number", "text"), "chunk_id")
    if keep:
        own = keep(own)
    for name, step in (("prev_text", -1), ("next_text", 1)):
        near = chunks.select("doc", (F.col("sequence_number") - step).alias("sequence_number"), F.col("text").alias(name))
        if keep:
            near = near.join(own.select("doc", "sequence_number"), ["doc", "sequence_number"], "left_semi")
        own = own.join(near, ["doc", "sequence_number"], "left")
    return own


def relation_chunks_window(ranked: DataFrame, assertions: DataFrame, chunks: DataFrame, most: int, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """qid, rank, chunk_id, support and the window's texts: the chunks that assert most of a question's relations."""
    own = assertions.select("relation_id", "chunk_id").join(ranked.select("relation_id").distinct(), "relation_id", "left_semi")
    support = ranked.join(own.distinct(), "relation_id").groupBy("qid", "chunk_id").agg(F.count_distinct("relation_id").alias("support"))
    best = keep(top_per(support, most, F.desc("support"), "chunk_id"))
    texts = expand_context(best.select("chunk_id").distinct(), chunks, keep).select("chunk_id", "prev_text", "text", "next_text")
    return best.join(texts, "chunk_id").select("qid", "rank", "chunk_id", "support", "prev_text", "text", "next_text")


def window_to_ranked(windows: DataFrame) -> DataFrame:
    return windows.select("qid", "rank", "chunk_id", F.concat_ws("\n", "prev_text", "text", "next_text").alias("content"), F.col("support").cast("double").alias("score"))


def attach_weight(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """weight: the aggregated one, else the relation's, else a tenth of its strength, else 0."""
    joined = rows.join(weights.select("relation_id", "aggregated_weight"), "relation_id", "left")
    own = [F.col(c) for c in ("weight",) if c in rows.columns] + ([F.col("strength") / 10] if "strength" in rows.columns else [])
    return joined.withColumn("graph_weight", F.coalesce("aggregated_weight", *own, F.lit(0.0))).drop("aggregated_weight")


def min_max(df: DataFrame, column: str, out: str, by: str = "qid") -> DataFrame:
    """Scaled to 0..1 within each question; 1.0 where all values are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn(out, F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(F.lit(1.0)))


def blend_rerank(cands: DataFrame, alpha: float, k: int, key: str = "relation_id") -> DataFrame:
    """qid, rank, key, score: alpha * ce_score + (1 - alpha) * weight, both scaled."""
    scaled = min_max(min_max(cands, "ce_score", "_ce"), "weight", "_w")
    scored = scaled.withColumn("score", F.round(alpha * F.col("_ce") + (1 - alpha) * F.col("_w"), 9))
    return top_per(scored, k, F.desc("score"), key, rank="new_rank").select("qid", F.col("new_rank").alias("rank"), key, "score")


def dedup_channels(local: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Both channels' rows, each key once for a question; the local channel wins."""
    one = top_per(local, 1, "rank", by=["qid", key], rank="_n").drop("_n")
    two = top_per(other, 1, "rank", by=["qid", key], rank="_n").drop("_n").join(one.select("qid", key), ["qid", key], "left_anti")
    return one.withColumn("channel", F.lit("local")).unionByName(two.withColumn("channel", F.lit("global")))


def relation_context(ranked: DataFrame, relations: DataFrame, style: str = "list", sources: DataFrame | None = None) -> DataFrame:
    """qid, context: the relations in rank order, as a list, as plain lines, as blocks with source clauses or numbered with
    their evidence. sources: relation_id, chunk_id, file_name, page_number, text, shown by file, page and chunk."""
    name = lambda c, other: F.coalesce(c, F.lit(other))
    s, o, label, about = name("subject", "Unknown"), name("object", "Unknown"), name("label", "related_to"), name("description", "")
    rows = ranked.select("qid", "rank", "relation_id").join(relations.select("relation_id", "subject", "label", "object", "description"), "relation_id")
    if style in ("blocks", "numbered"):
        clause = F.concat(F.lit("Source clause ["), name("file_name", "Unknown"), F.lit("]:\n"), clean_whitespace(F.col("text")))
        if style == "numbered":
            clause = F.concat(F.lit("  evidence (chunk="), "chunk_id", F.lit(" | "), name("file_name", "Unknown"), F.lit(" p."), name(F.col("page_number").cast("string"), ""), F.lit("): "), F.substring(name("text", ""), 1, 600))
        shown = sources.join(rows.select("relation_id").distinct(), "relation_id", "left_semi").select("relation_id", F.struct("file_name", "page_number", "chunk_id", clause.alias("clause")).alias("r"))
        held = shown.groupBy("relation_id").agg(F.concat(F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["clause"]), "\n")).alias("proof"))
        rows = rows.join(held, "relation_id", "left")
    number = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "relation_id")).cast("string")
    line, gap = {
        "list": (lambda: F.concat(F.lit("- "), s, F.lit(" —["), label, F.lit("]→ "), o, F.lit(": "), about), "\n"),
        "plain": (lambda: F.concat(s, F.lit(" --"), label, F.lit("--> "), o, F.lit(": "), about), "\n"),
        "blocks": (lambda: F.concat(F.lit("<context>\nRelation: "), s, F.lit(" --"), label, F.lit("--> "), o, F.lit("\nDescription: "), about, name("proof", ""), F.lit("\n</context>")), "\n\n"),
        "numbered": (lambda: F.concat(F.lit("RELATION R"), number, F.lit(": "), s, F.lit(" --["), label, F.lit("]--> "), o, F.when(about != "", F.concat(F.lit("\n  meaning: "), about)).otherwise(""), name("proof", "")), "\n"),
    }[style]
    lined = rows.withColumn("line", line()).select("qid", F.struct("rank", "relation_id", "line").alias("r"))
    return lined.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["line"]), gap).alias("context"))


def degrees(relations: DataFrame, by: list[str] | None = None, once: bool = False) -> DataFrame:
    """entity_key, degree: relations at an entity, loops left out, parallel ones counted; by: within each scope's relations.

    once: no relation is in two rows, so rows are counted and ids are not shuffled."""
    by = by or []
    ends = relations.where("subject_key <> object_key").select(*by, "relation_id", F.explode(F.array("subject_key", "object_key")).alias("entity_key"))
    return ends.groupBy(*by, "entity_key").agg((F.count(F.lit(1)) if once else F.count_distinct("relation_id")).alias("degree"))


def hubs(degree: DataFrame, p: float = 0.99, floor: int = 50, by: list[str] | None = None) -> DataFrame:
    """Entities whose degree reaches max(floor, whole part of the percentile), of their own scope."""
    q = F.percentile("degree", F.lit(p)).alias("q")
    if by:
        least = F.greatest(F.lit(floor), F.floor(F.coalesce("q", F.lit(0.0))))
        return degree.join(degree.groupBy(*by).agg(q), by).where(F.col("degree") >= least).select(*by, "entity_key", "degree")
    found = degree.agg(q).first()["q"]  # one number
    return degree.where(F.col("degree") >= max(floor, int(found or 0))).select("entity_key", "degree")


def projection(relations: DataFrame, by: list[str] | None = None) -> DataFrame:
    """src, dst in both directions; loops left out, parallel edges once; by: within each scope's relations."""
    by = by or []
    one = relations.where("subject_key <> object_key").select(*by, F.col("subject_key").alias("src"), F.col("object_key").alias("dst"))
    return one.unionAll(one.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
