"""The graph tables are stored as numbers; short keys stand for the ids; draws and walks do not shuffle all relations."""

import shutil
from pathlib import Path

from pyspark.sql import functions as F

from loomgraph.operators import build, goldset, graph, ingest
from loomgraph.plans import catalogue, runs
from loomgraph.sources.fixtures import _TABLES, Graph, full_id, named


def size(df):
    return sum(Path(f.removeprefix("file://")).stat().st_size for f in df.inputFiles())


def rows(df):
    return sorted(df.collect(), key=repr)


def test_stored_bytes(spark, sf_dir):
    g = Graph(spark, sf_dir)
    assert size(g.relations) < 25 * g.relations.count()
    assert size(g.assertions) < 50 * g.chunks.count()
    assert size(g.mentions) == size(g.chunks) == size(g.assertions)


def test_short_keys(spark, sf_dir):
    g = Graph(spark, sf_dir)
    for name in ("relations", "relations_once", "assertions", "mentions", "entities"):
        assert rows(named(getattr(g.short, name))) == rows(getattr(g, name))
    seeds = named(g.short.entities.select(g.short.key_of(F.col("name")).alias("entity_key")))
    assert rows(seeds) == rows(g.entities.select("entity_key"))


def test_odd_parts(spark, sf_dir, tmp_path):
    """Parts that are not there take their lines with them; repeated ones repeat them; the sequence counts what is left."""
    for f in Path(sf_dir).glob("*.parquet"):
        if f.name != "part.parquet":
            shutil.copy(f, tmp_path)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    extra = part.where("p_partkey = 7").withColumn("p_type", F.lit("other"))
    part.where("p_partkey <> 3").unionAll(extra).write.parquet(str(tmp_path / "part.parquet"))
    g = Graph(spark, str(tmp_path))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    times = F.when(F.col("l_partkey") == 3, 0).when(F.col("l_partkey") == 7, 2).otherwise(1)
    assert g.chunks.count() == lines.agg(F.sum(times)).first()[0]
    at = g.chunks.groupBy("doc").agg(F.max("sequence_number").alias("last"), F.count_distinct("sequence_number").alias("n"), F.count(F.lit(1)).alias("all"))
    assert at.where("last <> n or n <> all").count() == 0
    assert {r[0] for r in g.relations.where("label = 'supplies' and object = 'Part 7'").groupBy("relation_id").count().select("count").collect()} == {2}
    assert g.relations.where("object = 'Part 3'").count() == 0
    once = graph.degrees(g.relations_once, once=True)
    assert rows(once) == rows(graph.degrees(g.relations))


def test_degrees_shuffle_no_ids(spark, sf_dir):
    plan = catalogue.degrees(Graph(spark, sf_dir).short)._jdf.queryExecution().toString()
    assert "relation_id" not in plan
    counted = graph.degrees(Graph(spark, sf_dir).short.relations_once, once=True)._jdf.queryExecution().executedPlan().toString()
    assert counted.count("Exchange") == 1


def test_one_row_needs_no_join(spark, sf_dir):
    queries = catalogue.queries()
    for name in ("b20_relation_text", "a11_update_column"):
        assert "SortMergeJoin" not in queries[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_aggregates_without_relations(spark):
    a = spark.createDataFrame([("x", 0.5, None), ("x", None, 3), ("y", 1.0, 10)], "relation_id string, confidence double, strength int")
    r = spark.createDataFrame([("x",), ("y",)], "relation_id string")
    assert rows(build.relation_aggregates(a)) == rows(build.relation_aggregates(a, r))


def test_first_vectors(spark, sf_dir):
    """The first k relations of a vector are enough for k nearest ones."""
    g = Graph(spark, sf_dir)
    every = catalogue.vector_of(g).join(g.table("embeddings").select("vec_id", "embedding"), "vec_id").select("relation_id", "embedding")
    few = runs.relation_vectors(g, 2)
    assert few.count() < every.count()
    near = lambda v: rows(runs.runs.global_relations(v, catalogue.vector_queries(g), 2))
    assert near(few) == near(every)


def test_paths_from_known_nodes(spark):
    r = spark.createDataFrame([(f"r{i}", f"n{i % 7}", f"n{(i * 3 + 1) % 11}") for i in range(40)], "relation_id string, subject_key string, object_key string")
    hubs = spark.createDataFrame([("n1", 9)], "entity_key string, degree int")
    assert rows(goldset.sample_paths(r, hubs, 5, 2, "s", nodes=graph.degrees(r))) == rows(goldset.sample_paths(r, hubs, 5, 2, "s", keep=lambda df: df))


def test_ids_are_made_once(spark, sf_dir):
    """An id is worked out once for a row: names and keys have projections of their own, and no join makes the ids anew to drop null ones."""
    g = Graph(spark, sf_dir)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for df in (g.relations.select("relation_id"), g.assertions.select("relation_id"), named(g.short.relations.select("relation_id"))):
        assert plan(df).count("sha1(") <= 5
    attached = catalogue.queries()["b21_attach_embeddings"](spark, sf_dir)
    assert not any("Filter" in line and "conv(" in line for line in plan(attached).splitlines())
    odd = spark.createDataFrame([("S12>P34",), ("already an id",), (None,), ("S>P1",), ("S-1>P2",)], "relation_id string")
    assert rows(named(odd)) == rows(odd.select(full_id(F.col("relation_id")).alias("relation_id")))


def test_payloads_are_parsed_once(spark, sf_dir):
    for name in ("b4_norm_keywords", "b7_explode_relations", "b9_clamp_scores"):
        assert catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_constraints_are_counted_by_key(spark, sf_dir):
    """Repeated and missing keys, null ones too, without a join or a sort of all rows."""
    nodes = {"a": (spark.createDataFrame([("x",), ("x",), ("y",), (None,), (None,)], "k string"), "k"), "b": (spark.createDataFrame([], "i string"), "i")}
    e = spark.createDataFrame([("x", "1"), ("x", "1"), ("z", "2"), ("z", None), (None, "2")], "s string, o string")
    out = ingest.check_constraints(nodes, [("e", e, "s", "a"), ("e", e, "o", "b"), ("f", e.where("s = 'y'"), "s", "a")])
    assert rows(out) == sorted([("unique a", 2), ("unique b", 0), ("e.s in a", 3), ("e.o in b", 5), ("f.s in a", 0)], key=repr)
    plan = catalogue.queries()["a12_check_constraints"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Sort" not in plan


def test_pairs_from_lines(spark, sf_dir, tmp_path):
    """Pairs made from the stored lines are those of the given tables, and no orders are read for them."""
    for f in Path(sf_dir).glob("*.parquet"):
        if f.name != "part.parquet":
            shutil.copy(f, tmp_path)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    part.where("p_partkey <> 3").unionAll(part.where("p_partkey = 7").withColumn("p_type", F.lit("other"))).write.parquet(str(tmp_path / "part.parquet"))
    build = Graph._pairs.func.__wrapped__
    each = lambda df: rows(df.withColumn("domains", F.array_sort("domains")))
    given = each(build(Graph(spark, str(tmp_path))))
    catalogue.queries()["b15_distribution"](spark, str(tmp_path))
    assert [k[3] for k in _TABLES if k[2] == str(tmp_path)] == ["_lines", "_pairs"]
    made = build(Graph(spark, str(tmp_path)))
    assert each(made) == given
    assert not any("orders.parquet" in f for f in made.inputFiles())
