"""From extraction payloads to graph tables, and the graph's own aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.storage import stored

ENTITY = "struct<name:string,canonical_category:string,llm_category:string,description:string,aliases:array<string>>"
RELATION = "struct<subject:string,object:string,label:string,description:string,strength:string,keywords:array<string>,evidence:string,confidence:string>"
PAYLOAD = f"cleaning_status string, cleaned_chunk string, removed_spans array<string>, entities array<{ENTITY}>, relations array<{RELATION}>, broken string"


def parse_payloads(extractions: DataFrame) -> DataFrame:
    """chunk_id and the payload's fields; is_broken marks payloads that are no JSON. A payload is parsed once:
    as an exploded row, it is not parsed anew for every condition on its fields."""
    parsed = extractions.withColumn("p", F.explode(F.array(F.from_json("payload", PAYLOAD, {"columnNameOfCorruptRecord": "broken"}))))
    return parsed.select(*[c for c in extractions.columns if c != "payload"], "p.cleaning_status", "p.cleaned_chunk", "p.entities", "p.relations", F.coalesce(F.col("p.broken").isNotNull(), F.lit(True)).alias("is_broken"))


def drop_removed(parsed: DataFrame) -> DataFrame:
    return parsed.where("not is_broken and coalesce(cleaning_status, '') <> 'fully_removed'")


def payload_counters(parsed: DataFrame) -> DataFrame:
    removed = F.coalesce(F.col("cleaning_status") == "fully_removed", F.lit(False))
    return parsed.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if("is_broken").alias("n_broken"), F.count_if(removed).alias("n_removed"), F.count_if(~removed & ~F.col("is_broken")).alias("n_kept"))


def norm_category(df: DataFrame, ontology: list[str]) -> DataFrame:
    """canonical_category within the closed list, else 'other'; an empty llm_category takes the canonical one."""
    snake = t.snake(F.coalesce("canonical_category", F.lit("")))
    known = F.when(snake.isin(ontology), snake).otherwise(F.lit("other"))
    df = df.withColumn("canonical_category", known)
    return df.withColumn("llm_category", F.coalesce(F.nullif(t.snake(F.col("llm_category")), F.lit("")), F.col("canonical_category")))


def explode_entities(parsed: DataFrame) -> DataFrame:
    """chunk_id, pos, name, categories, description, aliases of the entities with a name."""
    rows = parsed.select("chunk_id", F.posexplode("entities").alias("pos", "e")).select("chunk_id", "pos", F.trim("e.name").alias("name"), "e.canonical_category", "e.llm_category", F.nullif(F.trim("e.description"), F.lit("")).alias("description"), F.filter(F.transform(F.coalesce("e.aliases", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "").alias("aliases"))
    return rows.where("name <> ''")


def explode_relations(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("chunk_id", F.posexplode("relations").alias("pos", "r")).select("chunk_id", "pos", *[F.trim(f"r.{c}").alias(c) for c in ("subject", "object", "label", "description")], "r.strength", "r.confidence", "r.evidence", "r.keywords")
    return rows.where("subject <> '' and object <> '' and label <> '' and description <> ''")


def endpoint_entities(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """chunk_id, name, description, is_new of both ends of each relation; an end takes the chunk's description of its name."""
    ends = relations.select("chunk_id", F.explode(F.array("subject", "object")).alias("name")).withColumn("norm", t.norm_name(F.col("name")))
    ends = ends.groupBy("chunk_id", "norm").agg(F.min("name").alias("name"))
    known = entities.withColumn("norm", t.norm_name(F.col("name"))).groupBy("chunk_id", "norm").agg(F.min_by("description", "pos").alias("description"), F.lit(True).alias("there"))
    return ends.join(known, ["chunk_id", "norm"], "left").select("chunk_id", "name", "description", F.col("there").isNull().alias("is_new"))


def dedup_first(df: DataFrame, key: str | list[str], order: list[str | Column]) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def relation_aggregates(assertions: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Support, average confidence (missing: 0.75) and strength (missing: the relation's, then 5), and their product.

    Without relations all of the assertions' count, and none has a strength of its own."""
    if relations is None:
        return _aggregates(assertions.withColumn("own", F.lit(None).cast("int")))
    own = relations.select("relation_id", F.col("strength").alias("own") if "strength" in relations.columns else F.lit(None).cast("int").alias("own"))
    return _aggregates(assertions.join(own, "relation_id"))


def _aggregates(joined: DataFrame) -> DataFrame:
    out = joined.groupBy("relation_id").agg(F.count(F.lit(1)).alias("support_count"), F.avg(F.coalesce("confidence", F.lit(0.75))).alias("avg_confidence"), F.avg(F.coalesce("strength", "own", F.lit(5))).alias("avg_strength"))
    return out.withColumn("aggregated_weight", F.col("support_count") * F.col("avg_strength") / 10 * F.col("avg_confidence"))


def validate_grounding(relations: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """chunk_id, pos, reason: null where the evidence stands in the chunk and both ends are among its entities.

    The joins are merged: rows that are made from payloads look small to Spark, which would broadcast all of them."""
    names = entities.select("chunk_id", t.norm_name(F.col("name")).alias("norm")).distinct().hint("merge")
    joined = relations.join(chunks.select("chunk_id", "text").hint("merge"), "chunk_id", "left")
    for end in ("subject", "object"):
        joined = joined.withColumn("norm", t.norm_name(F.col(end))).join(names.withColumn(f"has_{end}", F.lit(True)).hint("merge"), ["chunk_id", "norm"], "left").drop("norm")
    reason = F.when(~F.coalesce(F.contains("text", F.coalesce("evidence", F.lit(""))), F.lit(False)), "evidence").when(F.col("has_subject").isNull(), "subject").when(F.col("has_object").isNull(), "object")
    return joined.select("chunk_id", "pos", reason.alias("reason"))


def merge_jobs(entity_rows: DataFrame, low: int = 2, high: int = 70) -> DataFrame:
    """entity_key, n, name (most common, first seen on ties), descriptions of entities met low..high times with one description at least."""
    names = entity_rows.groupBy("entity_key", "name").agg(F.count(F.lit(1)).alias("c"), F.min("ord").alias("o"))
    best = names.groupBy("entity_key").agg(F.min_by("name", F.struct((-F.col("c")).alias("c"), "o", "name")).alias("name"), F.sum("c").alias("n")).where(F.col("n").between(low, high))
    texts = entity_rows.where("description is not null").join(best.select("entity_key"), "entity_key", "left_semi").groupBy("entity_key").agg(F.array_sort(F.collect_set("description")).alias("descriptions"))
    return best.join(texts, "entity_key").select("entity_key", "n", "name", "descriptions")


def apply_descriptions(entities: DataFrame, merged: DataFrame) -> DataFrame:
    new = merged.select("entity_key", F.nullif(F.trim("description"), F.lit("")).alias("new"))
    return entities.join(new, "entity_key", "left").withColumn("is_updated", F.col("new").isNotNull()).withColumn("description", F.coalesce("new", "description")).drop("new")


def missing_keywords(relations: DataFrame, assertions: DataFrame, limit: int, most: int = 2000) -> DataFrame:
    """relation_id, texts of relations without keywords: their asserting chunks' texts, in chunk order."""
    lacking = relations.where("coalesce(size(keywords), 0) <= 0").select("relation_id").orderBy("relation_id").limit(limit)
    texts = assertions.join(lacking, "relation_id").select("relation_id", "chunk_id", F.substring("evidence_text", 1, most).alias("t")).distinct()
    return texts.groupBy("relation_id").agg(F.array_sort(F.collect_set("t")).alias("texts"))


def relation_text(relations: DataFrame, style: str = "keywords", passed: tuple[str, ...] = ()) -> DataFrame:
    """relation_id, text and the passed columns."""
    if style == "keywords":
        words = F.array_join(F.coalesce("keywords", F.array("label")), ", ")
        text = F.concat(words, F.lit("\t"), F.col("subject"), F.lit(" "), F.col("object"), F.lit("\n"), F.col("description"))
    else:
        text = F.concat(F.concat_ws(" ", "subject", "label", "object"), F.lit(". "), F.col("description"))
    return relations.select("relation_id", text.alias("text"), *passed)


def attach_embeddings(relations: DataFrame, vectors: DataFrame, dim: int, key: str = "relation_id") -> DataFrame:
    """The relations with their vectors, by a key of both."""
    return relations.join(vectors.where(F.size("embedding") == dim).select(key, "embedding"), key)


def evidenced(relations: DataFrame, assertions: DataFrame) -> DataFrame:
    return relations.join(assertions.select("relation_id"), "relation_id", "left_semi")


def domain_candidates(assertions: DataFrame, doc_domains: DataFrame) -> DataFrame:
    """relation_id, domains: low domains of its documents and GENERAL; the middle tier where there is no low one."""
    docs = assertions.select("relation_id", "doc").distinct().join(doc_domains, "doc", "left")
    tiers = docs.groupBy("relation_id").agg(F.collect_set(F.when(F.col("tier") == "low", F.col("domain"))).alias("low"), F.collect_set(F.when(F.col("tier") == "mid", F.col("domain"))).alias("mid"))
    return tiers.select("relation_id", F.array_sort(F.array_union(F.when(F.size("low") > 0, F.col("low")).otherwise(F.col("mid")), F.array(F.lit("GENERAL")))).alias("domains"))


def classify_writeback(rows: DataFrame, assertions: DataFrame, doc_domains: DataFrame) -> DataFrame:
    """(relation_id, domain) rows whose domain an asserting document holds."""
    asked = rows.select("relation_id", "domain").distinct()
    met = asked.join(assertions.select("relation_id", "doc"), "relation_id")
    return met.join(doc_domains.select("doc", "domain"), ["doc", "domain"], "left_semi").select("relation_id", "domain").distinct()


def domain_coverage(relations: DataFrame, relation_domains: DataFrame, assertions: DataFrame, domains: DataFrame, thin: int = 10) -> DataFrame:
    """domain, n_relations, n_docs, state (zero, thin or ok) of every domain of the taxonomy."""
    n_rel = relation_domains.groupBy("domain").agg(F.count_distinct("relation_id").alias("n_relations"))
    n_doc = relation_domains.join(assertions.select("relation_id", "doc").distinct(), "relation_id").groupBy("domain").agg(F.count_distinct("doc").alias("n_docs"))
    out = domains.join(n_rel, "domain", "left").join(n_doc, "domain", "left").na.fill(0, ["n_relations", "n_docs"])
    return out.withColumn("state", F.when(F.col("n_relations") == 0, "zero").when(F.col("n_relations") < thin, "thin").otherwise("ok"))


def orphan_audit(relations: DataFrame, relation_domains: DataFrame, assertions: DataFrame, doc_domains: DataFrame) -> DataFrame:
    """Unclassified relations with evidence, by whether their documents offer a domain."""
    orphans = relations.join(relation_domains.select("relation_id"), "relation_id", "left_anti").select("relation_id")
    docs = assertions.select("relation_id", "doc").distinct().join(orphans, "relation_id", "left_semi")
    offered = docs.join(doc_domains.select("doc").distinct().withColumn("has", F.lit(1)), "doc", "left").groupBy("relation_id").agg(F.max("has").alias("has"))
    return offered.agg(F.count(F.lit(1)).alias("n_orphans"), F.count("has").alias("n_offered"), F.count_if(F.col("has").isNull()).alias("n_starved"))


def orphan_sample(relations: DataFrame, relation_domains: DataFrame, assertions: DataFrame, doc_domains: DataFrame, n: int, seed: str, full: Callable[[str], Column] = F.col, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """relation_id, subject, object, doc_domains of n unclassified relations with evidence, drawn by their ids (full: the id that
    a column's keys stand for). These n rows are stored and broadcast to their assertions and these to their documents' domains."""
    orphans = relations.join(relation_domains.select("relation_id"), "relation_id", "left_anti").join(assertions.select("relation_id"), "relation_id", "left_semi")
    chosen = keep(orphans.select("relation_id", "subject", "object").orderBy(F.md5(F.concat(F.lit(seed), full("relation_id"))), full("relation_id")).limit(n))
    docs = keep(assertions.select("relation_id", "doc").join(F.broadcast(chosen.select("relation_id")), "relation_id").distinct())
    held = docs.join(doc_domains.join(docs.select("doc"), "doc", "left_semi"), "doc", "left")
    sets = held.groupBy("relation_id").agg(F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("doc_domains"))
    return chosen.join(sets, "relation_id")
