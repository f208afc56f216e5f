"""Reading, ordering and keeping chunk and graph tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_of, is_number, page_of


def read_chunks(chunks: DataFrame, columns: list[str], tender_id: str | None = None) -> DataFrame:
    rows = chunks if tender_id is None else chunks.where(F.col("tender_id") == tender_id)
    return rows.select(*columns)


def file_facets(chunks: DataFrame, limit: int = 200) -> DataFrame:
    return chunks.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_chunks")).orderBy(F.desc("n_chunks"), "file_name").limit(limit)


def sequence_chunks(chunks: DataFrame) -> DataFrame:
    """sequence_number 1..n within each file: numbered pages first, then sheets by name, then the chunk's number."""
    page = page_of(F.col("chunk_id"))
    order = [~F.coalesce(is_number(page), F.lit(False)), F.when(is_number(page), page.try_cast("int")), page, chunk_of(F.col("chunk_id")), F.col("chunk_id")]
    return chunks.withColumn("sequence_number", F.row_number().over(Window.partitionBy("file_name").orderBy(*order)))


def resolve_doc_urls(files: DataFrame, docs: DataFrame) -> DataFrame:
    """file_name, doc_url: the first (least ord) URL that ends in the file's name at a slash; null if none does."""
    path = F.split(F.regexp_replace("doc_url", r"\\", "/"), "/")
    n = F.size(path)
    ends = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(path, i, n), "/"))
    suffixes = docs.select("doc_url", "ord", F.explode(ends).alias("suffix"))
    first = suffixes.groupBy("suffix").agg(F.min_by("doc_url", F.struct("ord", "doc_url")).alias("doc_url"))
    named = files.withColumn("suffix", F.regexp_replace(F.regexp_replace("file_name", r"\\", "/"), "^/+", ""))
    return named.join(first, "suffix", "left").select("file_name", "doc_url")


def split_short(chunks: DataFrame, least: int = 40) -> DataFrame:
    """With is_short: chunks too short to be extracted, which count as completed."""
    return chunks.withColumn("is_short", F.length(F.trim(F.coalesce("text", F.lit("")))) < least)


def pending(chunks: DataFrame, done_files: DataFrame, done_chunks: DataFrame) -> DataFrame:
    return chunks.join(done_files.select("file_name"), "file_name", "left_anti").join(done_chunks.select("chunk_id"), "chunk_id", "left_anti")


def retry_set(ledger: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id, status ('retry' or 'missing') of the failed ids."""
    failed = ledger.select("chunk_id").distinct()
    there = failed.join(chunks.select("chunk_id"), "chunk_id", "left_semi").withColumn("status", F.lit("retry"))
    return there.unionAll(failed.join(chunks.select("chunk_id"), "chunk_id", "left_anti").withColumn("status", F.lit("missing")))


def upsert(target: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """target with the listed columns taken from updates where a key is there, and new keys added."""
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_there"))
    both = target.join(new, key, "full_outer")
    return both.select(key, *[(F.when(F.col("_there"), F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)) if c in columns else F.col(c)).alias(c) for c in target.columns if c != key])


def valid_edges(updates: DataFrame, ends: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """The updates both of whose ends exist. ends: edge column -> (node table, key)."""
    for column, (nodes, node_key) in ends.items():
        updates = updates.join(nodes.select(F.col(node_key).alias(column)), column, "left_semi")
    return updates


def last_of(updates: DataFrame, key: str, order: str) -> DataFrame:
    """Of repeated updates of a key the one that comes last."""
    rest = [c for c in updates.columns if c not in (key, order)]
    return updates.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def upsert_edges(target: DataFrame, updates: DataFrame, key: str, columns: list[str], ends: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """upsert of the updates whose ends exist."""
    return upsert(target, valid_edges(updates, ends), key, columns)


def update_column(target: DataFrame, rows: DataFrame, key: str, column: str) -> DataFrame:
    new = rows.select(key, F.col(column).alias("_new"))
    return target.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def check_constraints(nodes: dict[str, tuple[DataFrame, str]], edges: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """check_name, violations: repeated keys of node tables, and edge ends that name no node. The rows of a node table and the
    ends that name it are counted by key together, so each is shuffled once, without a sort. Keys are dealt out before they are
    counted: most are there once, and counts of a task's share of a table would be as large as the share."""
    if unknown := {node for *_, node in edges} - set(nodes):
        raise KeyError(f"no node tables: {sorted(unknown)}")
    out = None
    for name, (df, key) in nodes.items():
        tables = [(df, key)] + [(e, column) for _, e, column, node in edges if node == name]
        checks = [f"unique {name}"] + [f"{e}.{column} in {node}" for e, _, column, node in edges if node == name]
        n = [f"n{i}" for i in range(len(tables))]
        rows = reduce(DataFrame.unionAll, [t.select(F.col(c).alias("key"), *[F.lit(int(i == j)).alias(x) for j, x in enumerate(n)]) for i, (t, c) in enumerate(tables)])
        counts = rows.repartition("key").groupBy("key").agg(*[F.sum(x).alias(x) for x in n])
        missing = F.col("key").isNull() | (F.col("n0") == 0)
        found = counts.agg(F.count_if(F.col("n0") > 1).alias("n0"), *[F.coalesce(F.sum(F.when(missing, F.col(x))), F.lit(0)).alias(x) for x in n[1:]])
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(x).alias("violations")) for c, x in zip(checks, n, strict=True)]))
        part = found.select(each.alias("r")).select("r.*")
        out = part if out is None else out.unionAll(part)
    return out


def graph_summary(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionAll(row)
    return out


def batch_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after, delta of two summaries (table_name, n)."""
    b, a = before.select(F.col("table_name").alias("metric"), F.col("n").alias("before")), after.select(F.col("table_name").alias("metric"), F.col("n").alias("after"))
    both = b.join(a, "metric", "full_outer").na.fill(0, ["before", "after"])
    return both.withColumn("delta", F.col("after") - F.col("before"))


def file_status(chunks: DataFrame, ledger: DataFrame) -> DataFrame:
    """file_name, n_chunks, n_failed, status of each file."""
    joined = chunks.join(ledger.select("chunk_id").distinct().withColumn("failed", F.lit(1)), "chunk_id", "left")
    return joined.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_chunks"), F.count("failed").alias("n_failed")).withColumn("status", F.when(F.col("n_failed") == 0, "complete").when(F.col("n_failed") < F.col("n_chunks"), "partial").otherwise("failed"))


def clean_chunks(pages: DataFrame, min_repeat: int = 3) -> DataFrame:
    """file_name, page, status, cleaned, removed of pages (file_name, page, text).

    Lines that go: page numbers, separators, dotted leaders of a table of contents, and lines that stand on min_repeat
    pages of the file or more. Only lines, not pages, are shuffled."""
    lines = pages.select("file_name", "page", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    junk = F.col("line").rlike(r"(?i)^(page\s*)?\d+(\s*(of|/)\s*\d+)?$") | F.col("line").rlike(r"^[-_=*.\s]{3,}$") | F.col("line").rlike(r"\.{4,}\s*\d+$")
    heads = lines.where("line <> ''").groupBy("file_name", "line").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= min_repeat).select("file_name", "line", F.lit(True).alias("head"))
    marked = lines.join(heads, ["file_name", "line"], "left").withColumn("gone", junk | F.coalesce("head", F.lit(False)))
    kept, lost = (F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pos", "line")))), lambda x: x["line"]), "\n") for c in (~F.col("gone"), F.col("gone")))
    out = marked.groupBy("file_name", "page").agg(F.trim(kept).alias("cleaned"), lost.alias("removed"), F.count_if("gone").alias("n_removed"))
    return out.withColumn("status", F.when(F.col("cleaned") == "", "fully_removed").when(F.col("n_removed") > 0, "cleaned").otherwise("unchanged"))


def distribution(df: DataFrame, column: str | Column) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value") if isinstance(column, str) else column.alias("value")).agg(F.count(F.lit(1)).alias("n"))
