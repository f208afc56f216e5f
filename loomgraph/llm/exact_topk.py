"""Exact top-k inner products by pivot-table elimination.

Vectors become whole numbers, floor(scale * x). The pivot table holds each vector's distances to the origin and to many
pivots, far-apart vectors chosen from at most SAMPLE rows: each next one is the farthest from the flat through those
before. The distances to all pivots together give the greatest lower bound of |q - c| that they allow: with y the place
that they fix in the pivots' flat and h the height over it, |q - c|^2 >= |y_q - y_c|^2 + (h_q - h_c)^2. No bound of a
single pivot, | |q - p| - |c - p| |, is greater. In inner products it says q.c <= y_q.y_c + h_q * h_c. Candidates are
evaluated in the order of this bound, in batches, and a query stops at the first candidate whose bound is under its k-th
score so far. Bounds are raised by SLACK, more than rounding can lower them, so the result is exact, ties included.

1. Each query meets a first block of about CANDIDATE_BLOCK candidates, which gives it a k-th score to beat.
2. The other candidates are grouped by their nearest pivot, and large groups are cut into blocks. The table knows the
   range of distances to each pivot within a group; a query is sent to the groups alone that these ranges do not exclude
   for its k-th score, and it takes this score with it. Each cell (a block of queries with a block of candidates) returns
   only what reaches it. No cell grows with the input, and a cell lost with its executor is simply done again.

Cases: vectors that are null, hold null or non-finite components or get infinite by the scale take no part, nor do rows
with a null id. Vectors are compared with those of their own length. Rows of a query's own id are not its candidates.
Repeated rows are candidates each; as queries they are one (of one id, each vector is a query of its own). Ties go to the
smaller id. Scores are compared as whole numbers of any size; those beyond 64 bits are returned as the greatest or least
long. Other columns do not pass. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

QUERY_BLOCK, CANDIDATE_BLOCK, SAMPLE, SLACK = 4_096, 8_192, 4_096, 1e-5
LONG = 2**63 - 1
ROW = "row long, vec_id long, q boolean, dim int, data binary"
MEASURED = ROW + ", place binary, near int"


def _integers(vectors: pa.Array, scale: int) -> list[np.ndarray | None]:
    """Whole numbers of each row that takes part, as 32-bit integers where they fit, else as doubles."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    offs, flat = vectors.offsets.to_numpy(), vectors.values
    values = flat.to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(scale * values)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(whole))))
    wide = np.concatenate(([0], np.cumsum(np.abs(whole) >= 2.0**31)))
    null = pc.is_null(vectors).to_numpy(zero_copy_only=False)
    return [None if null[i] or bad[a] != bad[b] else whole[a:b].astype("<f8" if wide[a] != wide[b] else "<i4") for i, (a, b) in enumerate(zip(offs[:-1], offs[1:], strict=True))]


def _stacked(rows: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    blobs = rows.to_pylist()
    if all(len(x) == 4 * dim for x in blobs):
        return np.frombuffer(b"".join(blobs), "<i4").reshape(len(blobs), dim).astype(np.float64)
    return np.stack([np.frombuffer(x, "<i4" if len(x) == 4 * dim else "<f8").astype(np.float64) for x in blobs])


class Pivots:
    """Pivots of one length of vectors, and what the distances to them say."""

    def __init__(self, sample: np.ndarray, most: int):
        size = np.linalg.norm(sample, axis=1)
        rest = sample[size <= 4 * np.median(size)] if len(sample) else sample  # outliers would cost all others precision
        rest = np.unique(rest, axis=0)
        left, chosen = rest.copy(), []
        scale = np.linalg.norm(rest, axis=1).max(initial=0)
        while len(chosen) < most and len(left):
            height = np.linalg.norm(left, axis=1)
            at = int(height.argmax())
            if not height[at] > 0.05 * scale:
                break
            chosen.append(at)
            axis = left[at] / height[at]
            left = left - np.outer(left @ axis, axis)
        self.pivots = rest[chosen]
        self.square = (self.pivots**2).sum(1)
        self.lower = np.linalg.cholesky(self.pivots @ self.pivots.T) if chosen else np.empty((0, 0))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """To the origin, then to each pivot."""
        own = (x * x).sum(1)
        return np.sqrt(np.maximum(np.column_stack([own, own[:, None] + self.square[None] - 2 * x @ self.pivots.T]), 0))

    def places(self, far: np.ndarray) -> np.ndarray:
        """Coordinates in the pivots' flat, then the height over it, from the distances."""
        own = far[:, 0] ** 2
        along = (own[:, None] + self.square[None] - far[:, 1:] ** 2) / 2
        flat = np.linalg.solve(self.lower, along.T).T if len(self.pivots) else along
        return np.column_stack([flat, np.sqrt(np.maximum(own - (flat**2).sum(1), 0))])

    def distances_of(self, place: np.ndarray) -> np.ndarray:
        own = (place**2).sum(1)
        along = place[:, :-1] @ self.lower.T
        return np.sqrt(np.maximum(np.column_stack([own, own[:, None] + self.square[None] - 2 * along]), 0))


def _places(blobs: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), "<f4").reshape(len(blobs), -1)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of q with the rows of c: doubles while sums stay below 2^53, then integers of any size."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * len(q)
    if most < 2.0**53:
        return (c @ q).astype(np.int64)
    if most < 2.0**62:
        return c.astype(np.int64) @ q.astype(np.int64)
    whole = list(map(int, q.tolist()))
    return np.array([max(-LONG - 1, min(LONG, sum(map(int.__mul__, whole, map(int, row))))) for row in c.tolist()], np.int64)


def _bounds(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of all vectors at the places one and two; infinite where they are unsure."""
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.outer(np.linalg.norm(one.astype(np.float64), axis=1), np.linalg.norm(two.astype(np.float64), axis=1))
        out = one @ two.T + SLACK * size
    out[np.isnan(out)] = np.inf
    return np.maximum(out, -(2.0**63))


def _search(q: np.ndarray, bound: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """ids and scores of the best k candidates that reach least, and how many were evaluated.

    In the order of bounds, in batches that double, until no bound left reaches the k-th score."""
    order = np.flatnonzero(bound >= least)
    order = order[np.argsort(-bound[order], kind="stable")]
    bound = bound[order]
    found, score, at, size = order[:0], np.empty(0, np.int64), 0, 2 * k
    while at < len(order) and bound[at] >= least:
        batch = order[at : at + int((bound[at : at + size] >= least).sum())]
        found = np.concatenate([found, batch])
        score = np.concatenate([score, _products(q, c[batch])])
        at, size = at + len(batch), 2 * size
        if len(found) >= k:
            best = np.lexsort((ids[found], ~score))[:k]  # ~ turns the order round, the least long included
            found, score = found[best], score[best]
            least = max(int(score[-1]), least)
    keep = score >= least
    return ids[found[keep]], score[keep], at


def _cell(asked: pa.Table, held: pa.Table, dim: int, k: int, work: bool) -> pa.Table:
    """row, query_id, vec_id, score of a block of queries in a block of candidates; with work, the number evaluated as the
    score of a row without vec_id."""
    out: list[tuple] = []
    if asked.num_rows and held.num_rows:
        q, c = _stacked(asked["data"], dim), _stacked(held["data"], dim)
        one, two = _places(asked["place"]), _places(held["place"])
        rows, own, least = (asked[x].to_pylist() for x in ("row", "vec_id", "least"))
        ids = held["vec_id"].to_numpy()
        for low in range(0, len(q), 256):
            for i, bound in enumerate(_bounds(one[low : low + 256], two), low):
                bound[ids == own[i]] = -np.inf
                found, score, n = _search(q[i], bound, ids, c, k, least[i])
                out += [(rows[i], own[i], a, b) for a, b in zip(found.tolist(), score.tolist(), strict=True)]
                if work:
                    out.append((rows[i], own[i], None, n))
    columns = zip(*out, strict=True) if out else ((),) * 4
    return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("row", "query_id", "vec_id", "score"), columns, strict=True)})


def _pivots(ready: DataFrame, pivots: int | None) -> dict[int, Pivots]:
    """Of each length of vectors; the sample of SAMPLE rows is all that reaches the driver. A hash leaves about twice as many
    rows of each length before they are put in order, so no task sorts the table."""
    share = ready.groupBy("dim").agg((2.0 * SAMPLE / F.count(F.lit(1))).alias("share"))
    few = ready.join(share, "dim").where(F.pmod(F.xxhash64("row", F.lit(7)), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("row"), "row"))
    out: dict[int, list] = {}
    for r in few.select("dim", "data", place.alias("n")).where(F.col("n") <= SAMPLE).collect():
        out.setdefault(r["dim"], []).append(bytes(r["data"]))
    return {dim: Pivots(_stacked(pa.array(rows, pa.binary()), dim), pivots or -(-4 * dim // 5)) for dim, rows in out.items()}


def _ranges(measured: DataFrame, table: dict[int, Pivots]) -> dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]:
    """(count, least, greatest distances to the origin and the pivots) of each group; at most a row for each pivot."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[int, int], list] = {}
        for batch in batches:
            keys = np.column_stack([batch["dim"].to_numpy(), batch["near"].to_numpy()])
            for dim, near in np.unique(keys, axis=0).tolist():
                at = np.flatnonzero((keys == (dim, near)).all(axis=1))
                far = table[dim].distances_of(_places(batch["place"].take(pa.array(at))).astype(np.float64))
                n, low, high = met.get((dim, near), (0, np.inf, -np.inf))
                met[dim, near] = (n + len(at), np.minimum(low, far.min(0)), np.maximum(high, far.max(0)))
        yield _range_rows(met)

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        low, high = (np.array([np.frombuffer(x, "<f8") for x in rows[c].to_pylist()]) for c in ("low", "high"))
        return pa.Table.from_batches([_range_rows({(key[0].as_py(), key[1].as_py()): (sum(rows["n"].to_pylist()), low.min(0), high.max(0))})])

    schema = "dim int, near int, n long, low binary, high binary"
    rows = measured.select("dim", "near", "place").mapInArrow(partial, schema).groupBy("dim", "near").applyInArrow(merge, schema).collect()
    return {(r["dim"], r["near"]): (r["n"], np.frombuffer(r["low"], "<f8"), np.frombuffer(r["high"], "<f8")) for r in rows}


def _range_rows(met: dict[tuple[int, int], tuple]) -> pa.RecordBatch:
    columns = {"dim": pa.int32(), "near": pa.int32(), "n": pa.int64(), "low": pa.binary(), "high": pa.binary()}
    rows = [(d, g, n, low.astype("<f8").tobytes(), high.astype("<f8").tobytes()) for (d, g), (n, low, high) in met.items()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ((),) * 5, columns.values(), strict=True)], names=list(columns))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, pivots: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", work: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query row with the other rows.

    pivots: as many at most; four fifths of the vectors' length unless given. work: instead, n_evaluated and n_candidates
    of each query (row, query_id)."""
    chosen = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("vec_id is not null and v is not null")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _integers(batch["v"], scale)
            own = [i for i, x in enumerate(whole) if x is not None]
            yield pa.RecordBatch.from_arrays([batch["vec_id"].take(pa.array(own, pa.int64())), batch["q"].take(pa.array(own, pa.int64())), pa.array([len(whole[i]) for i in own], pa.int32()), pa.array([whole[i].tobytes() for i in own], pa.binary())], names=["vec_id", "q", "dim", "data"])

    ready = stored(chosen.mapInArrow(convert, "vec_id long, q boolean, dim int, data binary").select(F.monotonically_increasing_id().alias("row"), "*"))
    table = _pivots(ready, pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            place, near = [b""] * len(dims), np.zeros(len(dims), np.int32)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                with np.errstate(over="ignore", invalid="ignore"):
                    far = table[dim].distances(_stacked(batch["data"].take(pa.array(own)), dim))
                    places = table[dim].places(far).astype("<f4")
                near[own] = np.nan_to_num(far, nan=np.inf)[:, 1:].argmin(1) if far.shape[1] > 1 else 0
                for i, row in zip(own.tolist(), places, strict=True):
                    place[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("row", "vec_id", "q", "dim", "data")), pa.array(place, pa.binary()), pa.array(near)], names=["row", "vec_id", "q", "dim", "data", "place", "near"])

    measured = stored(ready.mapInArrow(measure, MEASURED))
    groups = _ranges(measured, table)
    total = sum(n for n, _, _ in groups.values())
    parts = max(1, total // CANDIDATE_BLOCK)
    in_first = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)) == 0
    n_queries = measured.where("q").count()
    rows = max(1, -(-n_queries // QUERY_BLOCK), min(24, n_queries // 64))
    row_block = F.pmod(F.xxhash64("row", F.lit(2)), F.lit(rows)).cast("int").alias("block")
    least = F.lit(-LONG - 1).cast("long").alias("least")
    queries = measured.where("q").dropDuplicates(["vec_id", "data"]) if n_queries else measured.where("q")
    queries = stored(queries.select("row", "vec_id", "dim", "data", "place", row_block))
    # 1: the first block
    first = measured.where(in_first).select("vec_id", "dim", "data", "place", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("block"))
    schema = "row long, query_id long, vec_id long, score long"
    cell = lambda key, asked, held: _cell(asked, held, key[0].as_py(), k, work)
    start = stored(queries.select("*", least).groupBy("dim", "block").cogroup(first.groupBy("dim", "block")).applyInArrow(cell, schema))
    # 2: the groups that a query's k-th score does not exclude
    kth = start.where("vec_id is not null").groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("row", "least")
    asked = queries.join(kth, "row", "left").na.fill({"least": -LONG - 1})
    blocks = {key: max(1, -(-n // CANDIDATE_BLOCK)) for key, (n, _, _) in groups.items()}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, score = batch["dim"].to_numpy(), batch["least"].to_numpy().astype(np.float64)
            for (dim, near), (_, low, high) in groups.items():
                own = np.flatnonzero(dims == dim)
                if not len(own):
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    far = table[dim].distances_of(_places(batch["place"].take(pa.array(own))).astype(np.float64))
                    size = far[:, 0] * high[0]
                    gap = np.maximum(np.maximum(low[None] - far, far - high[None]), 0).max(1)
                    most = np.minimum(size, (far[:, 0] ** 2 + high[0] ** 2 - gap**2) / 2) + 1e-3 * (far[:, 0] ** 2 + high[0] ** 2)
                sent = own[~(most < score[own])]
                for part in range(blocks[dim, near]):
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(sent)).columns, pa.array([near] * len(sent), pa.int32()), pa.array([part] * len(sent), pa.int32())], names=[*batch.schema.names, "near", "part"])

    sent = asked.mapInArrow(send, "row long, vec_id long, dim int, data binary, place binary, block int, least long, near int, part int")
    wide = [F.struct(F.lit(d).alias("dim"), F.lit(g).alias("near"), F.lit(n).alias("n")) for (d, g), n in blocks.items() if n > 1]
    part = F.lit(0)
    for w in wide:
        part = F.when((F.col("dim") == w["dim"]) & (F.col("near") == w["near"]), F.pmod(F.xxhash64("row", F.lit(3)), w["n"])).otherwise(part)
    held = measured.where(~in_first).select("vec_id", "dim", "data", "place", "near", part.cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("block"))
    key = ["dim", "block", "near", "part"]
    rest = sent.groupBy(key).cogroup(held.groupBy(key)).applyInArrow(cell, schema)
    every = start.unionAll(rest)
    if work:
        size = measured.groupBy("dim").agg((F.count(F.lit(1)) - 1).alias("n_candidates"))
        done = every.where("vec_id is null").groupBy("row", "query_id").agg(F.sum("score").alias("n_evaluated"))
        return done.join(queries.select("row", "dim"), "row").join(size, "dim").select("row", "query_id", "n_evaluated", "n_candidates")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_query(spark, sf_dir: str) -> DataFrame:
    from .tables import read

    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP3_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, q.e AS qe, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 20 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, qe ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
