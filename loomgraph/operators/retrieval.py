"""Keyword and vector retrieval over chunks, for batches of questions keyed by qid."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import postings


def top_per(df: DataFrame, k: int, *order: Column | str, by: str | list[str] = "qid", rank: str = "rank") -> DataFrame:
    keys = [by] if isinstance(by, str) else by
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda x: x != "")


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, terms: hints and keywords, distinct in order, those of several words as phrases, joined by OR."""
    words = F.array_distinct(F.filter(F.transform(F.concat("entity_hints", "high_level_keywords"), lambda x: F.trim(x)), lambda x: x != ""))
    return queries.select("qid", F.array_join(F.transform(words, lambda x: F.when(F.contains(x, F.lit(" ")), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x)), " OR ").alias("terms"))


def bm25_search(docs: DataFrame, queries: DataFrame, k: int = 15, key: str = "chunk_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """qid, rank, key, score (BM25, any term) of docs (key, text) for queries (qid, text)."""
    scores = postings.bm25_search(docs, queries, tokens, k, key, k1, b)
    return top_per(scores.withColumn("score", F.round("score", 9)), k, F.desc("score"), key).select("qid", "rank", key, "score")


def fuzzy_terms(terms: DataFrame, vocabulary: DataFrame, least: int = 5) -> DataFrame:
    """term, match: vocabulary words within edit distance 1 of terms of `least` letters and more.

    Words and terms meet by the strings they have with one letter deleted, in an equi-join; the distance is then checked."""

    def keys(df: DataFrame, column: str) -> DataFrame:
        cut = F.transform(F.sequence(F.lit(1), F.length(column)), lambda i: F.concat(F.substring(F.col(column), F.lit(1), i - 1), F.substring(F.col(column), i + 1, F.length(column))))
        return df.where(F.length(column) >= least - 1).select(column, F.explode(F.array_union(F.array(column), cut)).alias("key"))

    left = keys(terms.select("term").distinct().where(F.length("term") >= least), "term")
    right = keys(vocabulary.select(F.col("word").alias("match")).distinct(), "match")
    return left.join(right, "key").select("term", "match").distinct().where(F.levenshtein("term", "match") <= 1)


def phrase_match(docs: DataFrame, phrase: list[str], slop: int = 3, key: str = "chunk_id") -> DataFrame:
    """Keys of docs that hold the phrase's words, in order, within a span of slop further words."""
    split = docs.select(key, tokens(F.col("text")).alias("t"))
    for word in phrase:
        split = split.where(F.array_contains("t", word))
    at = lambda word: F.filter(F.transform("t", lambda x, i: F.when(x == word, i)), lambda i: i.isNotNull())
    ends = F.transform(at(phrase[0]), lambda i: F.struct(i.alias("from"), i.alias("to")))
    for word in phrase[1:]:
        places = at(word)
        ends = F.filter(F.transform(ends, lambda e: F.struct(e["from"].alias("from"), F.array_min(F.filter(places, lambda j: j > e["to"])).alias("to"))), lambda e: e["to"].isNotNull())  # noqa: B023
    return split.where(F.exists(ends, lambda e: e["to"] - e["from"] <= len(phrase) - 1 + slop)).select(key)


def unit_vectors(df: DataFrame, key: str, vector: str = "embedding", more: tuple[str, ...] = ()) -> DataFrame:
    """key and v: vectors of norm 1 (null vectors left out, those of norm 0 as they are), with their length as dim."""
    v = df.where(F.col(vector).isNotNull()).select(key, *more, F.transform(vector, lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    v = v.withColumn("norm", norm)
    return v.select(key, *more, F.transform("v", lambda x: x / F.when(F.col("norm") > 0, F.col("norm")).otherwise(F.lit(1.0))).alias("v"), F.size("v").alias("dim"))


def matrix(rows: pa.Table, column: str = "v") -> np.ndarray:
    lists = rows[column].combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", block: int = 4096, scope: str | None = None) -> DataFrame:
    """qid, rank, key, score (cosine) of the k nearest vectors, exactly; with scope, of those of the question's own scope.

    Blocks of queries meet blocks of vectors in the cells of a grid; a cell is one matrix product and returns its best k
    of each query. No side is broadcast or collected, whatever its size."""
    n, m = vectors.count(), queries.count()
    rows, columns = max(1, -(-m // block)), max(8, -(-n // block))
    part = lambda name, count: F.pmod(F.xxhash64(name), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = [scope] if scope else []
    asked = unit_vectors(queries, "qid", more=tuple(own)).select("*", part("qid", rows).alias("i"), every(columns).alias("j"))
    held = unit_vectors(vectors, key, more=tuple(own)).select("*", part(key, columns).alias("j"), every(rows).alias("i"))
    schema = pa.schema([("qid", to_arrow_type(queries.schema["qid"].dataType)), (key, to_arrow_type(vectors.schema[key].dataType)), ("score", pa.float64())])

    def cell(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return schema.empty_table()
        score = np.round(matrix(one) @ matrix(two).T, 9) + 0.0
        size = min(k, two.num_rows)
        least = np.partition(score, -size, axis=1)[:, -size]
        at, to = np.nonzero(score >= least[:, None])  # with ties; the window below decides
        return pa.table([one["qid"].take(pa.array(at)), two[key].take(pa.array(to)), pa.array(score[at, to])], schema=schema)

    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, `{key}` {vectors.schema[key].dataType.simpleString()}, score double"
    cells = ["dim", "i", "j", *own]
    best = asked.groupBy(*cells).cogroup(held.groupBy(*cells)).applyInArrow(cell, kinds)
    return top_per(best, k, F.desc("score"), key).select("qid", "rank", key, "score")


def to_ranked(df: DataFrame, source: str) -> DataFrame:
    """The common shape of ranked rows, with defaults."""
    have = set(df.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    return df.select("qid", F.lit(source).alias("source"), "rank", "chunk_id", text("content").alias("content"), text("file_name").alias("file_name"), text("page_number").alias("page_number"), F.coalesce("score", F.lit(0.0)).alias("score"))


def score_gate(ranked: DataFrame, open_at: float = 0.1, least: float = 1.0) -> DataFrame:
    """Where a question's best score is over open_at, rows of least and more; else all of its rows."""
    best = F.max("score").over(Window.partitionBy("qid"))
    return ranked.withColumn("_best", best).where((F.col("_best") <= open_at) | (F.col("score") >= least)).drop("_best")


def domain_expand(queries: DataFrame, domains: DataFrame, most: int = 8) -> DataFrame:
    """qid, expanded: the question and the first keywords of its predicted domain."""
    joined = queries.join(domains.select("domain", "keywords"), "domain", "left")
    return joined.select("qid", F.concat_ws(" ", "text", F.array_join(F.slice("keywords", 1, most), " ")).alias("expanded"))
