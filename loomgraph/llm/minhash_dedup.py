"""Near-duplicate documents: fast similarity sketching, banding, exact verification and connected components.

Sketch: an element is hashed in rounds. In each of the first k rounds it takes a bin at random, in round k + i the bin
i; a bin keeps the least (round, hash). By round 2k every bin is filled, mostly after a few rounds, and the sketch has
the concentration of k independent minima. Bands of `rows` coordinates make the candidates.

1. One scan gives each row its set of word shingles as a size, a 128-bit key (of the sorted 64-bit hashes of its shingles)
   and `bands` band values. Rows of equal size and key make one class, whatever their number; a class is numbered, and its
   set is read once, from the row or rows of its least id, repeated ones left out.
2. Classes that share a band value are candidates. In each bucket every class is first held against one pivot, which
   makes at most a pair for each class and bucket; pairs are confirmed by the exact intersection of the full sets.
3. Confirmed links join into components. Buckets whose classes lie in one component are done. The classes of the others
   are gathered in clusters (components of sharing a bucket), and a cluster is dealt into blocks of about BLOCK_ROWS
   classes or BLOCK_SHINGLES shingles. Two blocks meet in a cell, which counts all intersections of its classes by
   matrix products and returns only the links that join different components. So every pair that shares a bucket is
   either linked in effect or confirmed not to be a link, and no task or table holds the pairs of a group.

A pair at the threshold misses every bucket with probability (1 - threshold^rows)^bands. Unless bands are given, they are
as many as bring it to MISSED (35 of 5 rows at 0.8, 24 at 0.85).

Cases: null and empty texts have an empty set and are linked with nothing; texts shorter than a shingle are one shingle;
very long texts are read whole; repeated rows are rows of one class, and rows of one id may have different texts. Rows with
a null id stand apart: component null, kept. Other columns do not pass. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w
from .components import components
from .tables import stored

U = np.uint64
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1_000_000
MISSED = 1e-6


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after another, and where each text's begin."""
    data = w.ascii_lower(data)
    starts, ends, first = w.spans(w.is_space_free(data), offs)
    words = w.hashes(data, starts, ends)
    at, n = w.window_texts(first, k)
    values = w.mix(w.windows(words, k)[at]) if len(at) else np.empty(0, U)
    owner = np.repeat(np.arange(len(n)), n)
    count = np.diff(first)
    for size in range(1, k):  # texts shorter than a shingle, by their number of words
        short = np.flatnonzero(count == size)
        if len(short):
            whole = w.windows(words, size)[first[short]]
            values, owner = np.concatenate([values, w.mix(whole, 1 + size)]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.append(True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])) if len(values) else np.empty(0, bool)
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(n) + 1))


def sketches(values: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """A row of k coordinates for each text; rows of empty sets mean nothing."""
    n = len(first) - 1
    out = np.full(n * k, np.iinfo(np.uint64).max, U)
    size = np.diff(first)
    todo = np.flatnonzero(size > 0)
    for turn in range(2 * k):
        if not len(todo):
            break
        own = np.repeat(todo, size[todo])
        base = np.repeat(first[todo] - np.concatenate(([0], np.cumsum(size[todo])[:-1])), size[todo])
        hashed = w.mix(values[base + np.arange(len(own))], 101 + turn)
        bins = (hashed >> U(32)).astype(np.int64) * k >> 32 if turn < k else np.full(len(own), turn - k)
        low = (U(turn) << U(40)) | (w.mix(hashed, 57) >> U(24))
        np.minimum.at(out, own * k + bins, low)
        table = out.reshape(n, k)
        todo = todo[(table[todo] == np.iinfo(np.uint64).max).any(axis=1)]
    return out.reshape(n, k)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_high and set_low (the set's key; null for an empty set), band values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                values, first = shingle_sets(*w.flat(part["text"]), shingle)
                n = np.diff(first)
                high, low = zip(*(_key(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)), strict=True)
                table = sketches(values, first, bands * rows)
                band = np.zeros((len(n), bands), U)
                for r in range(rows):
                    band = w.mix(band ^ table[:, r::rows], r)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(band.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_hash"], pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), lists], names=["doc_id", "text_hash", "n_shingles", "set_high", "set_low", "band"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_high long, set_low long, band array<long>")


def _key(values: np.ndarray) -> tuple[int, int] | tuple[None, None]:
    if not len(values):
        return None, None
    digest = hashlib.md5(values.tobytes()).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """set_key (the class's number), shingles of the wanted (doc_id, text_hash, set_key, set_high, set_low), a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for part in w.slices(batch, "text"):
                values, first = shingle_sets(*w.flat(part["text"]), shingle)
                own = []
                for i, (key, high, low) in enumerate(zip(*(part[c].to_pylist() for c in ("set_key", "set_high", "set_low")), strict=True)):
                    if key not in done and _key(values[first[i] : first[i + 1]]) == (high, low):  # texts of one hash may differ
                        done.add(key)
                        own.append(i)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part["set_key"], lists], names=["set_key", "shingles"]).take(pa.array(own, pa.int64()))

    sets = stored(_rows(docs, id_col, text_col).join(wanted, ["doc_id", "text_hash"]).select("set_key", "set_high", "set_low", "text").mapInArrow(run, "set_key long, shingles array<long>"))
    size = sets.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("set_key").alias("d")).first()
    if size["n"] > size["d"]:  # copies of a much repeated row, dealt over several tasks
        sets = stored(sets.groupBy("set_key").agg(F.first("shingles").alias("shingles")))
    return sets


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets meet the threshold."""
    left = sets.select(F.col("set_key").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("set_key").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("x", "y")))
    return both.where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.size("x") + F.size("y") - F.col("i"))).select("a", "b")


def _intersections(values: np.ndarray, first: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets; only values of two sets or more are looked at."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.append(True, values[1:] != values[:-1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    out = np.zeros((n, n), np.float32)
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (low, low + width))
        part = np.zeros((n, width), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return out


def _cell_links(table: pa.Table, percent: int) -> pa.Table:
    """Links of a cell that join components, one for each two components that they join."""
    lists = table["shingles"].combine_chunks()
    values, first = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    size, keys, label = np.diff(first), table["set_key"].to_numpy(), table["component"].to_numpy()
    values, first = values[first[0] : first[-1]], first - first[0]
    common = _intersections(values, first).astype(np.int64)
    linked = 100 * common >= percent * (size[:, None] + size[None] - common)
    linked &= label[:, None] != label[None]
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while x in above:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        a, b = root(int(label[i])), root(int(label[j]))
        if a != b:
            above[max(a, b)] = min(a, b)
            out.append((int(keys[i]), int(keys[j])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _cluster_links(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components of the clusters of mixed (bucket, set_key, component, n)."""
    pivots = stored(mixed.groupBy("bucket").agg(F.min("set_key").alias("pivot")))
    cluster = components(mixed.join(pivots, "bucket").select("pivot", "set_key"), "pivot", "set_key").select(F.col("node").alias("set_key"), F.col("component").alias("cluster"))
    members = stored(mixed.select("set_key", "component", "n").distinct().join(stored(cluster), "set_key"))
    size = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    dealt = members.join(stored(size), "cluster").withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")))
    dealt = dealt.join(sets, "set_key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "set_key", "component", "shingles")
    return cells.groupBy("cluster", "i", "j").applyInArrow(lambda table: _cell_links(table, percent), "a long, b long")


def bands_for(percent: int, rows: int) -> int:
    """The least number of bands with which a pair at the threshold is missed with probability MISSED at most."""
    return 1 if percent >= 100 else ceil(log(MISSED) / log(1 - (percent / 100) ** rows))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int | None = None, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id that links reach), kept (doc_id = component_id) of every row."""
    signed = stored(signatures(docs, shingle, bands or bands_for(percent, rows), rows, id_col, text_col))
    key = ["set_high", "set_low", "n_shingles"]
    alone = F.col("set_high").isNull() | F.col("doc_id").isNull()
    classes = signed.where(~alone).groupBy(*key).agg(F.min(F.struct("doc_id", "text_hash")).alias("r"), F.first("band").alias("band"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("set_key"), *key, F.col("n_shingles").alias("n"), "r.doc_id", "r.text_hash", "band"))  # numbers hold once written
    cells = classes.select("set_key", "n", F.posexplode("band").alias("i", "value")).select("set_key", "n", F.xxhash64("i", "value").alias("bucket"))
    shared = stored(cells.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("set_key").alias("pivot")).where("size > 1"))
    cells = stored(cells.join(shared, "bucket"))
    tried = stored(cells.where("set_key != pivot").select(F.col("pivot").alias("a"), F.col("set_key").alias("b")).distinct())
    wanted = cells.select("set_key").distinct().join(classes.select("set_key", "set_high", "set_low", "doc_id", "text_hash"), "set_key")
    sets = _sets(docs, wanted, shingle, id_col, text_col)
    links = stored(_confirmed(tried, sets, percent))
    joined = stored(components(links))
    placed = cells.join(joined.withColumnRenamed("node", "set_key"), "set_key", "left").select("bucket", "set_key", "n", F.coalesce("component", "set_key").alias("component"))
    placed = stored(placed)
    split = stored(placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket"))
    mixed = stored(placed.join(split, "bucket"))
    if not mixed.isEmpty():
        links = links.unionAll(stored(_cluster_links(mixed, sets, percent)))
        joined = stored(components(links))
    named = classes.select("set_key", F.col("doc_id").alias("first")).join(joined.withColumnRenamed("node", "set_key"), "set_key")
    least = stored(named.groupBy("component").agg(F.min("first").alias("component_id")))
    groups = classes.select("set_key", *key, "doc_id").join(named.select("set_key", "component").join(least, "component").select("set_key", "component_id"), "set_key", "left")
    groups = stored(groups.select(*key, F.coalesce("component_id", "doc_id").alias("component_id")))
    grouped = signed.where(~alone).select("doc_id", *key).join(groups, key)
    out = grouped.select("doc_id", "n_shingles", "component_id").unionAll(signed.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_query(spark, sf_dir: str) -> DataFrame:
    from .tables import read

    return near_duplicates(read(spark, sf_dir, "documents"), shingle=3, percent=85)
