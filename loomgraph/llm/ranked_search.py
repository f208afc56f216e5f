"""Ranked keyword search by pipelined term partitioning.

The index is partitioned by term over owners. An item's bundle holds a sparse accumulator of scores and is carried through
the owners' stages one after another; each adds the whole-number contributions of its own terms to what has come so far,
and only the last one selects.

1. Documents are tokenised once, in blocks of at most BLOCK_DOCS documents and about BLOCK_BYTES of text. A block gives a
   row for each of its terms, with the documents' places and frequencies, and a head with their ids and lengths. Rows of
   terms that no item has are dropped by a semi-join before they are stored.
2. Document frequencies, N and L are sums over these rows. They give each term its weight and its owner: rare terms belong
   to the first stages, so that the accumulators that travel are few, and the commonest to the last.
3. Items are dealt into bundles of about BUNDLE_ITEMS. A cell is a bundle with a block of documents. In each stage the
   cells' accumulators are cogrouped with the owner's rows of the same bundle and block. A cell is never larger than its
   items times its documents, whatever the input's size, and no term's rows meet in one task.
4. The last stage returns a cell's k best documents of each item; a window ranks them over all cells.

Terms are maximal stretches of digits, letters A-Z and characters past ASCII; only A-Z are lower-cased.

Cases: null and empty texts have no terms, count neither for N nor L and are found by nothing; items without a known term
get no rows. Very long texts are tokenised whole, in a block of their own. Each row of items is an item and each row of
documents a document, repeated rows and ids included; ties go to the smaller id, null ids last. Other columns do not pass.
An empty table, of either kind, gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import top_per
from .tables import read, stored
from .words import ascii_lower, flat, slices, spans

BLOCK_DOCS, BLOCK_BYTES, BUNDLE_ITEMS = 4_096, 4 << 20, 128
#: A term's owner is the first whose share of the documents it does not exceed; the last one takes the rest.
OWNERS = (0.01, 0.1)
LONG = 2**63 - 1
HEAD = ""
INDEX = "block long, term string, n_docs long, n_words long, docs binary, counts binary, ids array<long>"
CELL = "bundle int, block long, ids array<long>, lengths binary, at binary, score binary"

_TERM = np.zeros(256, bool)
_TERM[128:] = True
for _low, _high in ("09", "AZ", "az"):
    _TERM[ord(_low) : ord(_high) + 1] = True


def _block(block: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """INDEX rows of some documents."""
    data, offs = flat(texts)
    inside = _TERM[data]
    starts, ends, first = spans(inside, offs)
    lengths = np.diff(first)
    size = ends - starts
    offsets = np.concatenate(([0], np.cumsum(size)))
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ascii_lower(data[inside]))]).dictionary_encode()
    doc = np.repeat(np.arange(len(texts)), lengths)
    key, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(texts) + doc, return_counts=True)
    terms = key // len(texts)
    cut = np.flatnonzero(np.diff(terms, prepend=-1, append=len(words.dictionary)))
    count = np.diff(cut)

    def blobs(values: np.ndarray, head: bytes) -> pa.Array:
        width = values.dtype.itemsize
        rows = np.concatenate(([0], len(head) + cut * width)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(rows), pa.py_buffer(head + values.tobytes())])

    n = len(cut)
    total = np.concatenate(([0], np.cumsum(tf)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, block)),
            pa.concat_arrays([pa.array([HEAD]), words.dictionary.cast(pa.string())]),
            pa.array(np.concatenate(([int((lengths > 0).sum())], count))),
            pa.array(np.concatenate(([int(lengths.sum())], total[cut[1:]] - total[cut[:-1]]))),
            blobs((key % len(texts)).astype("<u2"), lengths.astype("<i8").tobytes()),
            blobs(tf.astype("<u4"), b""),
            pa.array([ids.to_pylist(), *[None] * (n - 1)], pa.list_(pa.int64())),
        ],
        names=["block", "term", "n_docs", "n_words", "docs", "counts", "ids"],
    )


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch, "text", BLOCK_BYTES):
            for at in range(0, part.num_rows, BLOCK_DOCS):
                rows = part.slice(at, BLOCK_DOCS)
                yield _block(block, rows["doc_id"], rows["text"])
                block += 1


def terms_of(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offs, flat_values = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False)
    return [flat_values[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]


def _saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _norms(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """100 - 75 + 75 n N div L of each length, in whole numbers of any size."""
    safe = lengths <= LONG // (75 * n)
    out = 25 + 75 * np.where(safe, lengths, 0) * n // total
    for i in np.flatnonzero(~safe).tolist():
        out[i] = 25 + 75 * int(lengths[i]) * n // total
    return out


def _scores(cell: pa.Table, posts: pa.Table, n: int, total: int) -> tuple[np.ndarray, pa.Scalar, np.ndarray]:
    """The cell's scores by item and document after the owner's terms are added, its ids and lengths."""
    lengths = np.frombuffer(cell["lengths"][0].as_py(), "<i8")
    docs = len(lengths)
    at, old = np.frombuffer(cell["at"][0].as_py(), "<i8"), np.frombuffer(cell["score"][0].as_py(), "<i8")
    items, times = (_lists(posts[c]) for c in ("items", "times")) if posts.num_rows else ([], [])
    rows = max([int(at[-1]) // docs if len(at) else -1, *(int(x.max()) for x in items)], default=-1) + 1
    score = np.zeros(rows * docs, np.int64)
    score[at] = old
    score = score.reshape(rows, docs)
    norms = _norms(lengths, n, total)
    for places, tf, weight, own, often in zip(posts["docs"].to_pylist(), posts["counts"].to_pylist(), posts["weight"].to_pylist(), items, times, strict=True):
        here = np.frombuffer(places, "<u2").astype(np.int64)
        part = weight * _saturation(np.frombuffer(tf, "<u4"), norms[here])
        score[own[:, None], here] += often[:, None] * part
    return score, cell["ids"][0], lengths


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k highest-scoring documents with a score over 0."""
    spark = docs.sparkSession
    schema = f"item_id {items.schema[item_col].dataType.simpleString()}, rank int, doc_id long, score long"
    rows = stored(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")))
    bundles = max(1, -(-rows.count() // BUNDLE_ITEMS))
    rows = rows.withColumn("bundle", F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int"))
    numbered = top_per(rows, 2**31 - 1, "item", by="bundle", rank="place").withColumn("place", F.col("place") - 1)  # a bundle is small
    numbered = stored(numbered.select("bundle", "place", "item_id", "text"))
    asked = numbered.select("bundle", "place", F.explode(terms_of(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term", "bundle", "place").agg(F.count(F.lit(1)).alias("times"))
    asked = stored(asked.groupBy("term", "bundle").agg(F.collect_list(F.struct("place", "times")).alias("r")))  # a bundle's items at most
    known = asked.select("term").distinct().unionAll(spark.range(1).select(F.lit(HEAD).alias("term")))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    index = stored(texts.mapInArrow(_index, INDEX).join(known, "term", "left_semi"))
    heads = index.where(F.col("term") == HEAD)
    n, total = heads.agg(F.sum("n_docs"), F.sum("n_words")).first()  # two numbers
    if not n:
        return spark.createDataFrame([], schema)
    posts = index.where(F.col("term") != HEAD)
    df = posts.groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.ln((2.0 * n + 2) / (2 * F.col("df") + 1)))
    owner = F.lit(len(OWNERS))
    for i, share in reversed(list(enumerate(OWNERS))):
        owner = F.when(F.col("df") <= share * n, i).otherwise(owner)
    lists = [F.transform("r", lambda x: x["place"].cast("int")).alias("items"), F.transform("r", lambda x: x["times"]).alias("times")]
    weighed = stored(asked.join(df, "term").select("term", "bundle", weight.alias("weight"), owner.cast("int").alias("owner"), *lists))
    bundle = F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle")
    none = F.lit(b"").cast("binary")
    cells = heads.select(bundle, "block", "ids", F.col("docs").alias("lengths"), none.alias("at"), none.alias("score"))

    def carry(cell: pa.Table, posts: pa.Table) -> pa.Table:
        if not posts.num_rows or not cell.num_rows:
            return cell
        score, _, _ = _scores(cell, posts, n, total)
        at = np.flatnonzero(score.ravel())
        blobs = [pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (at, score.ravel()[at])]
        return pa.table([*(cell[c] for c in ("bundle", "block", "ids", "lengths")), *blobs], names=cell.schema.names)

    def select(cell: pa.Table, posts: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if cell.num_rows:
            score, ids, _ = _scores(cell, posts, n, total)
            ids = ids.as_py()
            order = np.array([LONG if i is None else i for i in ids])
            last = np.array([i is None for i in ids])
            bundle = cell["bundle"][0].as_py()
            for place in np.flatnonzero(score.any(axis=1)).tolist():
                row = score[place]
                fit = np.flatnonzero(row)
                if len(fit) > k:
                    fit = np.flatnonzero(row >= max(1, np.partition(row, -k)[-k]))
                best = fit[np.lexsort((order[fit], last[fit], -row[fit]))[:k]]
                out += [(bundle, place, ids[i], int(row[i])) for i in best.tolist()]
        columns = zip(*out, strict=True) if out else ((),) * 4
        return pa.table([pa.array(x, kind) for x, kind in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["bundle", "place", "doc_id", "score"])

    for i in range(len(OWNERS) + 1):
        own = posts.join(weighed.where(F.col("owner") == i), "term").select("bundle", "block", "weight", "items", "times", "docs", "counts")
        own = own.toDF(*own.columns)  # columns of its own, for both sides are read from the index
        pair = cells.groupBy("bundle", "block").cogroup(own.groupBy("bundle", "block"))
        cells = pair.applyInArrow(carry, CELL) if i < len(OWNERS) else pair.applyInArrow(select, "bundle int, place int, doc_id long, score long")
    best = top_per(cells, k, F.desc("score"), F.asc_nulls_last("doc_id"), by=["bundle", "place"])
    return best.join(numbered.select("bundle", "place", "item_id"), ["bundle", "place"]).select("item_id", "rank", "doc_id", "score")


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), q AS (
    SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), a AS (SELECT item, item_id, term, count(*) AS times FROM q GROUP BY ALL),
s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
p AS (SELECT row, doc_id, len(t) AS size, unnest(t) AS term FROM d),
tf AS (SELECT row, doc_id, size, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM a) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term),
r AS (
    SELECT item, item_id, doc_id, row, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * size * n) // total)))) AS BIGINT) AS score
    FROM a JOIN tf USING (term) JOIN w USING (term), s GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, row) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, row) <= 10
"""
