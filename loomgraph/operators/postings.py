"""BM25 over blocks of postings: no task meets a term's whole list, and blocks that cannot enter a result are skipped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.storage import stored

BLOCK_DOCS, BLOCK_TOKENS, BUNDLE = 1024, 1 << 20, 256
HEAD = ""  # no term is empty
SLACK = 1e-8  # more than rounding moves a score


def _blocks(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `most` rows and about BLOCK_TOKENS tokens."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_TOKENS, side="right"))
        to = min(max(to, at + 1), at + most)
        yield at, to
        at = to


def _block(block: int, keys: pa.Array, tokens: pa.Array) -> pa.RecordBatch:
    """Rows of a block: its head (keys, lengths, counts) and a row for each of its terms."""
    lists = tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens
    size = np.array([-1 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
    words = lists.flatten().cast(pa.large_string()).dictionary_encode()
    doc = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    pair, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(size) + doc, return_counts=True)
    cut = np.flatnonzero(np.diff(pair // len(size), prepend=-1, append=len(words.dictionary)))
    doc = pair % len(size)
    most = np.maximum.reduceat(tf, cut[:-1]) if len(tf) else tf
    least = np.minimum.reduceat(size[doc], cut[:-1]) if len(tf) else tf
    blob = lambda values, kind, head: pa.array([head, *(values[a:b].astype(kind).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True))], pa.binary())
    n = len(cut)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, block)),
            pa.concat_arrays([pa.array([HEAD]), words.dictionary.cast(pa.string())]),
            pa.array([len(size), *np.diff(cut).tolist()], pa.int64()),
            pa.array([int((size >= 0).sum()), *most.tolist()], pa.int64()),
            pa.array([int(np.maximum(size, 0).sum()), *least.tolist()], pa.int64()),
            blob(doc, "<u2", np.maximum(size, 0).astype("<i8").tobytes()),
            blob(tf, "<u4", b""),
            pa.array([keys.to_pylist(), *[None] * (n - 1)], pa.list_(keys.type)),
        ],
        names=["block", "term", "n", "most", "least", "docs", "counts", "keys"],
    )


def _index(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = np.array([x or 0 for x in batch["t"].value_lengths().to_pylist()], np.int64)
            for a, b in _blocks(size, most):
                yield _block(block, batch["key"].slice(a, b - a), batch["t"].slice(a, b - a))
                block += 1

    return run


def _firsts(row: np.ndarray, fit: np.ndarray, keys: list, k: int) -> np.ndarray:
    """Of places with exactly the same score the k with the least keys (null first): others cannot be among k by score and key."""
    order = sorted(fit.tolist(), key=lambda i: (row[i], keys[i] is not None, "" if keys[i] is None else keys[i]))
    value = row[order]
    new = np.flatnonzero(np.diff(value, prepend=np.nan) != 0)
    nth = np.arange(len(order)) - np.repeat(new, np.diff(new, append=len(order)))
    return np.array(order)[nth < k]


def bm25_search(docs: DataFrame, queries: DataFrame, tokens: Callable[[Column], Column], k: int = 15, key: str = "chunk_id", k1: float = 1.2, b: float = 0.75, keep: Callable[[DataFrame], DataFrame] = stored, work: bool = False, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """qid, key, score (BM25, any term) of at least the k best docs (key, text) of each query (qid, text); of equal scores in a block the
    k least keys.

    1. Texts are taken apart once, in blocks of at most block_docs rows; a block has a row for each of its terms, with the
       postings, the greatest frequency and the least length. Only rows of the queries' terms are stored.
    2. The greatest frequency and least length bound what a term adds in a block, and the terms' sums a query's scores there.
       Each query scores its most promising block first; blocks whose bound is under its k-th score there are skipped.
    3. A cell is a block with a bundle of about BUNDLE queries; it adds up arrays and returns k rows a query.

    work: instead, qid, n_scored and n_postings, the query's postings that were scored and that there are."""
    kinds = {"qid": queries.schema["qid"].dataType, "key": docs.schema[key].dataType}
    asked = keep(queries.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")))
    bundles = max(1, -(-queries.select("qid").distinct().count() // BUNDLE))
    bundle = F.pmod(F.xxhash64("qid"), F.lit(bundles)).cast("int").alias("bundle")
    known = asked.select("term").distinct().unionAll(asked.sparkSession.range(1).select(F.lit(HEAD)))
    split = docs.select(F.col(key).alias("key"), tokens(F.col("text")).alias("t"))
    index = keep(split.mapInArrow(_index(block_docs), f"block long, term string, n long, most long, least long, docs binary, counts binary, keys array<{kinds['key'].simpleString()}>").join(known, "term", "left_semi"))
    heads, posts = index.where(F.col("term") == HEAD), index.where(F.col("term") != HEAD)
    n, texts, total = heads.agg(F.sum("n"), F.sum("most"), F.sum("least")).first()  # three numbers
    mean = (total or 0) / (texts or 1) or 1.0
    df = posts.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.log(1 + (F.lit(n or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = keep(asked.join(df, "term").select("qid", bundle, "term", weight.alias("idf")))
    gain = F.col("idf") * F.col("most") * (k1 + 1) / (F.col("most") + k1 * (1 - b + b * F.col("least") / mean))
    bounds = keep(posts.select("block", "term", "n", "most", "least").join(terms, "term").groupBy("qid", "bundle", "block").agg(F.sum(gain).alias("bound"), F.sum("n").alias("n")))
    schema = pa.schema([("qid", to_arrow_type(kinds["qid"])), ("key", to_arrow_type(kinds["key"])), ("score", pa.float64())])

    def score(wanted: pa.Table, held: pa.Table) -> pa.Table:
        names = held["term"].to_pylist()
        if not wanted.num_rows or HEAD not in names:
            return schema.empty_table()
        at = names.index(HEAD)
        lengths, keys = np.frombuffer(held["docs"][at].as_py(), "<i8"), held["keys"][at].as_py()
        norm = k1 * (1 - b + b * lengths / mean)
        gains = {}
        for name, docs_, counts in zip(names, held["docs"].to_pylist(), held["counts"].to_pylist(), strict=True):
            if name != HEAD:
                rows, tf = np.frombuffer(docs_, "<u2"), np.frombuffer(counts, "<u4").astype(np.float64)
                gains[name] = rows, tf * (k1 + 1) / (tf + norm[rows])
        out: dict[str, list] = {"qid": [], "key": [], "score": []}
        sums: dict = {}
        for qid, name, idf in zip(wanted["qid"].to_pylist(), wanted["term"].to_pylist(), wanted["idf"].to_pylist(), strict=True):
            if name in gains:
                rows, part = gains[name]
                if qid not in sums:
                    sums[qid] = np.zeros(len(lengths))
                sums[qid][rows] += idf * part
        for qid, row in sums.items():
            fit = np.flatnonzero(row > 0)
            if len(fit) > k:
                fit = fit[row[fit] >= np.partition(row, -k)[-k] - SLACK]
            if len(fit) > k:
                fit = _firsts(row, fit, keys, k)
            out["qid"] += [qid] * len(fit)
            out["key"] += [keys[i] for i in fit.tolist()]
            out["score"] += row[fit].tolist()
        return pa.table(out, schema=schema)

    def scored(cells: DataFrame) -> DataFrame:
        wanted = cells.select("qid", "block").join(terms, "qid").select("block", "bundle", "qid", "term", "idf")
        places = cells.select("block", "bundle").distinct()
        own = posts.join(terms.select("bundle", "term").distinct(), "term").join(places, ["block", "bundle"], "left_semi").select("block", "bundle", "term", "docs", "counts", "keys")
        held = own.unionAll(heads.join(places, "block").select("block", "bundle", "term", "docs", "counts", "keys"))
        held = held.toDF(*held.columns)
        return wanted.groupBy("block", "bundle").cogroup(held.groupBy("block", "bundle")).applyInArrow(score, f"qid {kinds['qid'].simpleString()}, key {kinds['key'].simpleString()}, score double")

    best = keep(bounds.groupBy("qid").agg(F.max_by("block", F.struct("bound", "block")).alias("block")))
    first = keep(scored(bounds.join(best, ["qid", "block"], "left_semi")))
    place = F.array_sort(F.collect_list("score"), lambda x, y: F.when(x > y, -1).when(x < y, 1).otherwise(0))
    kth = first.groupBy("qid").agg(F.get(place, F.lit(k - 1)).alias("kth"))  # a block's rows: k and ties
    rest = keep(bounds.join(best, ["qid", "block"], "left_anti").join(kth, "qid", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - SLACK)).select("qid", "bundle", "block", "n"))
    if work:
        done = rest.select("qid", "n").unionAll(bounds.join(best, ["qid", "block"], "left_semi").select("qid", "n")).groupBy("qid").agg(F.sum("n").alias("n_scored"))
        return done.join(bounds.groupBy("qid").agg(F.sum("n").alias("n_postings")), "qid")
    return first.unionAll(scored(rest)).withColumnRenamed("key", key)
