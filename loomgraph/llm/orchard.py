"""Centroid clustering (Lloyd rounds) whose nearest centroids are found by Orchard search.

Each centroid has a list of the others, nearest first. A vector begins at one centroid and goes down its list; as soon as a
listed centroid is nearer, the search jumps to that one's list. Centroids met before are marked and not measured again. It
stops at the first listed centroid that is strictly farther from the list's owner than twice the vector's distance to the
owner: by the triangle inequality all further ones are strictly worse, so ties are still decided by the smaller number.

A round is one pass over the vectors' column: each task searches its rows, in lockstep over Arrow batches, and gives a
count and component sums of each centroid; Spark adds these up by (centroid, component). The driver gets the centroids
alone, at most MOST_CENTROIDS of them, and sends them with the next round. Nothing else is kept between rounds, so a lost
executor costs its own tasks only.

Vectors become whole numbers, floor(scale * x); distances and sums are exact whatever their size, 64-bit arithmetic being
left for Python's integers where it would not hold them.

Cases: vectors that are null, have another length, hold null or non-finite components or get infinite by the scale take no
part. Rows with a null id are clustered but start no centroid. Repeated rows count each. With fewer vectors than centroids
all of them start one. Of equal hashes (repeated ids) the lesser vector comes first. Distances and inertias over 64 bits are
given as the greatest long (a capped distance counts as that in the inertia). Other columns do not pass. An empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read, stored

MOST_CENTROIDS = 2_048
LONG, FAR, LIMB = 2**63 - 1, 2**62, 31
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _narrow(dim: int) -> int:
    """Components under this give squared distances under 2^60."""
    return math.isqrt(2**60 // max(dim, 1)) // 2


def whole_numbers(vectors: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their components as whole doubles."""
    lists = vectors.cast(pa.large_list(pa.float64()))
    offs = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(scale * flat)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    fit = (np.diff(offs) == dim) & (bad[offs[1:]] == bad[offs[:-1]]) & ~pc.is_null(vectors).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(fit)
    return rows, flat[offs[rows][:, None] + np.arange(dim)] if len(rows) else np.empty((0, dim))


def _square(one: list[int], two: list[int]) -> int:
    return sum((a - b) * (a - b) for a, b in zip(one, two, strict=True))


@dataclass
class Centroids:
    """Centroids as whole numbers, with the sorted neighbour list of each."""

    rows: list[list[int]]
    start: int = 0
    order: np.ndarray = field(init=False)
    reach: np.ndarray = field(init=False)
    between: np.ndarray = field(init=False)
    narrow: np.ndarray = field(init=False)
    matrix: np.ndarray = field(init=False)

    def __post_init__(self):
        k, dim = len(self.rows), len(self.rows[0])
        small = _narrow(dim)
        self.narrow = np.array([all(-small < x < small for x in row) for row in self.rows])
        self.matrix = np.array([row if near else [0] * dim for row, near in zip(self.rows, self.narrow, strict=True)], np.int64)
        far = np.stack([((self.matrix - row) ** 2).sum(1) for row in self.matrix])
        if not self.narrow.all():
            far = far.astype(object)
            for i in np.flatnonzero(~self.narrow).tolist():
                far[i] = far[:, i] = [_square(self.rows[i], row) for row in self.rows]
        order = np.argsort(far, axis=1, kind="stable")
        self.order = np.array([row[row != i] for i, row in enumerate(order)], np.int64).reshape(k, k - 1)
        self.reach = np.take_along_axis(far, self.order, axis=1)
        self.between = np.minimum(self.reach, FAR).astype(np.int64)
        far = np.minimum(far, FAR).astype(np.float64)
        usable = np.flatnonzero(self.narrow)
        if len(usable):  # begin in the middle
            self.start = int(usable[np.argmin(far[usable][:, usable].sum(1))])

    def measure(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Squared distances of narrow rows to centroids, row by row; at most FAR."""
        out = ((x - self.matrix[c]) ** 2).sum(1)
        for i in np.flatnonzero(~self.narrow[c]).tolist():
            out[i] = min(FAR, _square(x[i].tolist(), self.rows[c[i]]))
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each narrow row's nearest centroid, and how many distances were measured."""
        n, k = len(x), len(self.rows)
        own = np.full(n, self.start)
        best = self.measure(x, own)
        met = np.zeros((n, k), bool)
        met[:, self.start] = True
        place, live, work = np.zeros(n, np.int64), np.arange(n if k > 1 else 0), n
        while len(live):
            c, p = own[live], place[live]
            going = self.between[c, p] <= 4 * best[live]
            live, near = live[going], self.order[c, p][going]
            place[live] += 1
            fresh = ~met[live, near]
            at, near = live[fresh], near[fresh]
            met[at, near] = True
            far = self.measure(x[at], near)
            work += len(at)
            closer = (far < best[at]) | ((far == best[at]) & (near < own[at]))
            at = at[closer]
            own[at], best[at], place[at] = near[closer], far[closer], 0
            live = live[place[live] < k - 1]
        return own, best, work

    def nearest_of_one(self, row: list[int]) -> tuple[int, int]:
        """The same search for a row of any size."""
        k, own = len(self.rows), self.start
        best, met, place = _square(row, self.rows[own]), {own}, 0
        while place < k - 1 and int(self.reach[own, place]) <= 4 * best:
            near = int(self.order[own, place])
            place += 1
            if near not in met:
                met.add(near)
                far = _square(row, self.rows[near])
                if (far, near) < (best, own):
                    own, best, place = near, far, 0
        return own, best

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, list[int] | np.ndarray]:
        """Of whole doubles: cluster and exact squared distance of each row."""
        small = (np.abs(x) < _narrow(x.shape[1])).all(axis=1) & bool(self.narrow.any())
        own, best, _ = self.nearest(x[small].astype(np.int64))
        if small.all():
            return own, best
        cluster, far = np.zeros(len(x), np.int64), [0] * len(x)
        cluster[small] = own
        for i, d in zip(np.flatnonzero(small).tolist(), best.tolist(), strict=True):
            far[i] = d
        for i in np.flatnonzero(~small).tolist():
            cluster[i], far[i] = self.nearest_of_one([int(v) for v in x[i].tolist()])
        return cluster, far


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """Parts of a whole number of any size that 64-bit sums can add up over all tasks."""
    at = 0
    while abs(total) >= 1 << LIMB:
        yield at, total & ((1 << LIMB) - 1)
        total, at = total >> LIMB, at + 1
    yield at, total


def _table(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in columns.values()], names=list(columns))


def _seeds(vectors: DataFrame, k: int, dim: int, scale: int, salt: str) -> list[list[int]]:
    """The k vectors that take part whose ids have the least hashes: all that is collected."""
    fit = (F.size("v") == dim) & F.forall("v", lambda x: F.coalesce(F.abs(scale * x) < float("inf"), F.lit(False)))  # not so for NaN
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null and v is not null").where(fit).select("v", digest.alias("digest")).orderBy("digest", "v").limit(k).collect()
    return [[math.floor(scale * x) for x in r["v"]] for r in rows]


def _moved(vectors: DataFrame, old: Centroids, dim: int, scale: int) -> list[list[int]]:
    """The floors of the means of each centroid's vectors; centroids without any stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for batch in batches:
            _, x = whole_numbers(batch["v"], dim, scale)
            cluster, _ = old.assign(x)
            for c in np.unique(cluster).tolist():
                rows = x[cluster == c]
                small = np.abs(rows).max(initial=0) < 2**40
                part = rows.astype(np.int64).sum(0).tolist() if small else [sum(map(int, column)) for column in rows.T.tolist()]
                met = total.get(c)
                total[c] = [len(rows), *part] if met is None else [a + b for a, b in zip(met, [len(rows), *part], strict=True)]
        out = [(c, at, limb, value) for c, row in total.items() for at, whole in enumerate(row) for limb, value in _limbs(whole)]
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        yield _table({name: (list(col), kind) for name, col, kind in zip(("cluster", "at", "limb", "value"), columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)})

    parts = vectors.select("v").mapInArrow(sums, "cluster int, at int, limb int, value long")
    total = {c: [0] * (dim + 1) for c in range(len(old.rows))}
    for r in parts.groupBy("cluster", "at", "limb").agg(F.sum("value").alias("value")).collect():  # centroids times components
        total[r["cluster"]][r["at"]] += r["value"] << (LIMB * r["limb"])
    return [[s // n for s in sums] if n else row for (n, *sums), row in zip((total[c] for c in range(len(old.rows))), old.rows, strict=True)]


def centroids(vectors: DataFrame, k: int = 16, dim: int = 64, rounds: int = 3, scale: int = 64, salt: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> list[list[int]]:
    """The centroids after `rounds` rounds, from the k vectors whose ids have the least hashes of "salt:id"."""
    if not 1 <= k <= MOST_CENTROIDS:
        raise ValueError(f"k must be from 1 to {MOST_CENTROIDS}")
    rows = _columns(vectors, id_col, vector_col)
    found = _seeds(rows, k, dim, scale, salt)
    for _ in range(rounds if found else 0):
        found = _moved(rows, Centroids(found), dim, scale)
    return found


def _columns(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))


def assigned(vectors: DataFrame, found: list[list[int]], dim: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared) of each vector that takes part."""
    model = Centroids(found)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = whole_numbers(batch["v"], dim, scale)
            cluster, far = model.assign(x)
            far = far if isinstance(far, np.ndarray) else [min(d, LONG) for d in far]
            yield pa.RecordBatch.from_arrays([batch["vec_id"].take(pa.array(rows, pa.int64())), pa.array(cluster, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    return _columns(vectors, id_col, vector_col).mapInArrow(search, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, dim: int = 64, rounds: int = 3, scale: int = 64, salt: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that takes part."""
    spark = vectors.sparkSession
    found = centroids(vectors, k, dim, rounds, scale, salt, id_col, vector_col)
    if not found:
        return spark.createDataFrame([], OUT)
    rows = stored(assigned(vectors, found, dim, scale, id_col, vector_col))
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each centroid
    digest = lambda row: hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()
    about = spark.createDataFrame([(c, min(s, LONG), digest(found[c])) for c, s in sorted(sums.items())], "cluster int, cluster_inertia long, centroid_sha256 string")
    inertia = F.lit(min(sum(sums.values()), LONG)).cast("long").alias("inertia")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", inertia, "centroid_sha256")  # at most MOST_CENTROIDS rows


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings"))


def _sql(k: int = 16, dim: int = 64, rounds: int = 3, scale: int = 64) -> str:
    far = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"""v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS HUGEINT)) AS e FROM embeddings
            WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS c, e FROM v WHERE vec_id IS NOT NULL QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), e) <= {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS (SELECT v.row, v.vec_id, v.e, c.c, {far} AS d FROM v CROSS JOIN c{i} c QUALIFY row_number() OVER (PARTITION BY v.row ORDER BY {far}, c.c) = 1)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT c, j, sum(e[j]) AS s, count(*) AS n FROM a{i}, range(1, {dim + 1}) t(j) GROUP BY ALL)")
            parts.append(f"c{i + 1} AS (SELECT o.c, coalesce(m.e, o.e) AS e FROM c{i} o LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS HUGEINT) ORDER BY j) AS e FROM s{i} GROUP BY c) m ON m.c = o.c)")
    last = f"a{rounds}"
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
            CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
        FROM {last} a JOIN c{rounds} c ON c.c = a.c"""


OP13_SQL = _sql()
