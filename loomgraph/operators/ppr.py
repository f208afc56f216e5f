"""Hub-aware personalized PageRank over batches of questions, on the whole graph or on scopes of it."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources import storage
from .graph import degrees, hubs, projection
from .retrieval import top_per

Keep = Callable[[DataFrame], DataFrame]
#: The scope that stands for the whole graph.
WHOLE = ""
#: Edges of a cell, edges in a row of it, bytes of a block's ranks in a segment, questions of a block and blocks of a cell.
CELL, PIECE, RANKS, SLOTS, BLOCKS = 4_000_000, 1_000_000, 32 << 20, 64, 4
#: Cells, with their copies for more questions, that a walk is spread over.
SPREAD = 16


def rounds(alpha: float, tol: float = 1e-8, most: int = 100) -> int:
    """Rounds of plain iteration after which the ranks move by less than tol in all: a round's change is at most 2 * alpha^t."""
    return min(most, math.ceil(math.log(2 / tol) / math.log(1 / alpha)))


@dataclass
class Walk:
    """A graph to walk on, whose edges go both ways. Nodes are numbers (id) and lie in `parts` segments (segment, ids, weights: a
    node's share of a step); cells (i, j, part, a, b) are the edges between two segments, by the ends' places there. nodes (by,
    node, id) are their names, or name and number turn ids into them and back. by: columns (a scope) that tell nodes apart."""

    segments: DataFrame
    cells: DataFrame
    parts: int
    nodes: DataFrame | None = None
    by: list[str] = field(default_factory=list)
    name: Callable[[Column], Column] | None = None
    number: Callable[[Column], Column] | None = None

    def numbered(self, seeds: DataFrame) -> DataFrame:
        """qid, id of seeds (qid, by, node); ids that are not in the graph may be among them."""
        if self.number:
            return seeds.select("qid", self.number(F.col("node")).alias("id")).where("id is not null").distinct()
        return seeds.select("qid", *self.by, "node").distinct().join(self.nodes, [*self.by, "node"]).select("qid", "id")

    def named(self, df: DataFrame) -> DataFrame:
        """df with the nodes of its ids."""
        return df.withColumn("node", self.name(F.col("id"))) if self.name else df.join(self.nodes, "id")


def _segment(id_: Column | str, parts: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(parts)).cast("int")


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


def _binary(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def walk_of(edges: DataFrame, degree: DataFrame | None = None, stored: Keep | None = None, cell: int = CELL, **more) -> Walk:
    """The walk on edges (a, b) between numbers, each there once, in one direction. degree (id, degree), if known."""
    keep = stored or storage.stored
    parts = max(1, math.ceil(math.sqrt(2 * edges.count() / cell)))
    if degree is None:
        degree = edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))

    def segment(rows: pa.Table) -> pa.Table:
        ids = _numbers(rows["id"])
        order = np.argsort(ids)
        return pa.table({"segment": rows["segment"].slice(0, 1), "ids": [_binary(ids[order], "<i8")], "weights": [_binary(1.0 / _numbers(rows["degree"])[order], "<f8")]})

    segments = keep(degree.select(_segment("id", parts).alias("segment"), "id", "degree").groupBy("segment").applyInArrow(segment, "segment int, ids binary, weights binary"))
    one, two = _segment("a", parts), _segment("b", parts)
    swap = one > two
    rows = edges.select(F.least(one, two).alias("i"), F.greatest(one, two).alias("j"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])

    def pack(own: pa.Table, ends: pa.Table) -> pa.Table:
        if not own.num_rows:
            return schema.empty_table()
        i, j = own["i"][0].as_py(), own["j"][0].as_py()
        held = {s: (np.frombuffer(ids, "<i8"), w) for s, ids, w in zip(ends["segment"].to_pylist(), ends["ids"].to_pylist(), ends["weights"].to_pylist(), strict=True)}
        out = [(-1, held[i][1], held[j][1])]
        a, b = _numbers(own["a"]), _numbers(own["b"])
        for at in range(0, len(a), PIECE):
            out.append((at // PIECE, _binary(np.searchsorted(held[i][0], a[at : at + PIECE]), "<i4"), _binary(np.searchsorted(held[j][0], b[at : at + PIECE]), "<i4")))
        n = len(out)
        return pa.table([pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32()), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)]], schema=schema)

    cells = rows.groupBy("i", "j").cogroup(_sent(segments, parts).groupBy("i", "j")).applyInArrow(pack, "i int, j int, part int, a binary, b binary")
    return Walk(segments, keep(cells), parts, **more)


def _sent(rows: DataFrame, parts: int) -> DataFrame:
    """rows (segment) for each cell (i <= j) of their segment."""
    other = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_o")
    return rows.select("*", other).select(F.least("segment", "_o").alias("i"), F.greatest("segment", "_o").alias("j"), *rows.columns)


def walk_on(edges: DataFrame, by: list[str] | None = None, stored: Keep | None = None) -> Walk:
    """The walk on edges (by, src, dst), each in both directions; nodes of any kind are numbered, and stored as the walk is."""
    keep, by = stored or storage.stored, by or []
    ends = edges.select(*by, F.col("src").alias("node")).distinct()
    nodes = keep(ends.select(F.monotonically_increasing_id().alias("id"), *by, "node"))
    end = lambda column, name: nodes.select(*by, F.col("node").alias(column), F.col("id").alias(name))
    once = edges.where("src < dst").select(*by, "src", "dst")
    rows = keep(once.join(end("src", "a"), [*by, "src"]).join(end("dst", "b"), [*by, "dst"]).select("a", "b"))
    return walk_of(rows, stored=stored, nodes=nodes, by=by)


SEED = np.dtype([("place", "<i4"), ("slot", "<i4"), ("share", "<f8")])
STATE = "segment int, block int, slots int, x binary, p binary, seeds binary, moved double"
STATE_SCHEMA = pa.schema([("segment", pa.int32()), ("block", pa.int32()), ("slots", pa.int32()), ("x", pa.binary()), ("p", pa.binary()), ("seeds", pa.binary()), ("moved", pa.float64())])


def _found(seeds: DataFrame, walk: Walk) -> DataFrame:
    """qid, id of the seeds that are in the graph."""
    kind = seeds.schema["qid"].dataType.simpleString()

    def held(own: pa.Table, segment: pa.Table) -> pa.Table:
        if not segment.num_rows:
            return own.slice(0, 0).select(["qid", "id"])
        ids, asked = np.frombuffer(segment["ids"][0].as_py(), "<i8"), _numbers(own["id"])
        place = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
        return own.select(["qid", "id"]).filter(pa.array(ids[place] == asked))

    at = seeds.select("qid", F.col("id").cast("long").alias("id"), _segment(F.col("id").cast("long"), walk.parts).alias("segment"))
    near = walk.segments.join(F.broadcast(at.select("segment").distinct()), "segment", "left_semi").select("segment", "ids")
    return at.groupBy("segment").cogroup(near.groupBy("segment")).applyInArrow(held, f"qid {kind}, id long")


def ppr(seeds: DataFrame, walk: Walk | DataFrame, alpha: float = 0.45, tol: float = 1e-9, top: int | None = 80, stored: Keep | None = None, most: int = 100, tie: Column | str = "node") -> DataFrame:
    """qid, by, rank, node, score: walks that restart at the seeds (qid, by, node) with probability 1 - alpha; equal scores by tie.
    walk: a Walk, or edges (src, dst), each in both directions.

    Nodes lie in segments, and questions in blocks; a row is a block's ranks in a segment. In a round the segments are sent to the
    cells of their edges, which stay where they are and add up arrays; the cells' sums, one for each of a cell's two segments, are
    added to the restarts: y = alpha W x + restart. So a round moves nodes times the root of the number of cells, and no edges.
    Since edges go both ways, W has real eigenvalues in [-1, 1], and over-relaxed steps that look back one round shrink the error
    by about alpha / (1 + sqrt(1 - alpha^2)) a round, 0.24 instead of 0.45. What is left of it, at most alpha / (1 - alpha) *
    |y - x|, is measured while a round is stored; the walk ends when its sum over all questions is under tol, with a plain round.
    stored must write a table, for lineage and measure; the driver gets a number a round."""
    keep = stored or storage.stored
    if isinstance(walk, DataFrame):
        walk = walk_on(walk, stored=keep)
    met = keep(_found(walk.numbered(seeds), walk))
    size = met.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    n_asked, segment_bytes = size.count(), walk.segments.agg(F.max(F.length("ids"))).first()[0] or 8  # two numbers
    slots = max(1, min(SLOTS, RANKS // segment_bytes, n_asked))
    copies = max(1, min(SPREAD // (walk.parts * (walk.parts + 1) // 2), -(-n_asked // slots)))
    passes = max(1, -(-n_asked // (slots * copies * BLOCKS)))
    of = keep(top_per(size.withColumn("turn", F.pmod(F.xxhash64("qid"), F.lit(passes))), 2**31 - 1, "qid", by="turn", rank="place").select("qid", "n", "turn", F.floor((F.col("place") - 1) / slots).cast("int").alias("block"), ((F.col("place") - 1) % slots).cast("int").alias("slot")))
    n_cells = walk.parts * (walk.parts + 1) // 2 * copies
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")
    cells = _in_place(walk.cells.select("i", "j", copy, "part", "a", "b").repartition(n_cells, "i", "j", "copy"))
    try:
        outs = [keep(_walked(met.join(of.where(F.col("turn") == turn), "qid"), walk, cells, slots, copies, alpha, tol, top, keep, most)) for turn in range(passes)]
    finally:
        cells.unpersist()
    out = outs[0]
    for other in outs[1:]:
        out = out.unionAll(other)
    out = walk.named(out.select("qid", "id", F.round(F.col("y") / F.col("total"), 9).alias("score")).where("score > 0"))
    if top is None:
        return out.select("qid", *walk.by, "node", "score")
    return top_per(out, top, F.desc("score"), tie).select("qid", *walk.by, "rank", "node", "score")


def _in_place(df: DataFrame) -> DataFrame:
    """df kept on the executors' disks as it is dealt out, so that cogroups by its keys do not shuffle it; what is lost is read again."""
    conf, name = df.sparkSession.conf, "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    setting = conf.get(name)
    conf.set(name, "false")
    try:
        return df.persist(StorageLevel.DISK_ONLY)
    finally:
        conf.set(name, setting)


def _walked(seeds: DataFrame, walk: Walk, cells: DataFrame, slots: int, copies: int, alpha: float, tol: float, top: int | None, keep: Keep, most: int) -> DataFrame:
    """qid, id, y, total of the walks from seeds (qid, id, n, block, slot): at least the `top` largest y of a question, with all
    that are as large but for rounding."""
    kind = seeds.schema["qid"].dataType.simpleString()
    places = seeds.select(_segment("id", walk.parts).alias("segment"), "id", "n", "block", "slot").toDF("segment", "id", "n", "block", "slot")

    def begin(segment: pa.Table, own: pa.Table) -> pa.Table:
        ids, out = np.frombuffer(segment["ids"][0].as_py(), "<i8"), []
        place = np.searchsorted(ids, _numbers(own["id"])) if own.num_rows else np.zeros(0, int)
        for block in segment["block"].to_pylist():
            mine = np.flatnonzero(_numbers(own["block"]) == block) if own.num_rows else place
            held, x = np.zeros(len(mine), SEED), b""
            if len(mine):
                held["place"], held["slot"], held["share"] = place[mine], _numbers(own["slot"])[mine], 1.0 / _numbers(own["n"])[mine]
                full = np.zeros((slots, len(ids)))
                np.add.at(full, (held["slot"], held["place"]), held["share"])
                x = full.tobytes()
            out.append((segment["segment"][0].as_py(), block, slots, x, x, held.tobytes(), 0.0))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), STATE_SCHEMA, strict=True)], schema=STATE_SCHEMA)

    blocks = seeds.select("block").distinct().toDF("block")
    every = walk.segments.select("segment", "ids").crossJoin(F.broadcast(blocks))  # as many as there are blocks in a pass
    now = keep(every.groupBy("segment").cogroup(places.groupBy("segment")).applyInArrow(begin, STATE))
    sums = pa.schema([("segment", pa.int32()), ("block", pa.int32()), ("y", pa.binary())])

    def step(own: pa.Table, sent: pa.Table) -> pa.Table:
        if not own.num_rows or not sent.num_rows:
            return sums.empty_table()
        i, j = own["i"][0].as_py(), own["j"][0].as_py()
        parts, one, two = own["part"].to_pylist(), own["a"], own["b"]
        weight, pieces = {}, []
        for k, part in enumerate(parts):
            if part < 0:
                weight = {i: alpha * np.frombuffer(one[k].as_py(), "<f8"), j: alpha * np.frombuffer(two[k].as_py(), "<f8")}
            else:
                pieces.append((np.frombuffer(one[k].as_py(), "<i4"), np.frombuffer(two[k].as_py(), "<i4")))
        held: dict = {}
        for k, (block, segment) in enumerate(zip(sent["block"].to_pylist(), sent["segment"].to_pylist(), strict=True)):
            held.setdefault(block, {})[segment] = k
        out = []
        for block, rows in held.items():
            for to, here, there in ((i, 0, 1), (j, 1, 0)):
                start = j if to == i else i
                if start not in rows or (i == j and to is not i):
                    continue
                x = np.frombuffer(sent["x"][rows[start]].as_py(), "<f8").reshape(-1, len(weight[start])) * weight[start]
                y = np.zeros((len(x), len(weight[to])))
                for piece in pieces:
                    for slot in np.flatnonzero(x.any(axis=1)).tolist():
                        y[slot] += np.bincount(piece[here], x[slot][piece[there]], y.shape[1])
                        if i == j:
                            y[slot] += np.bincount(piece[there], x[slot][piece[here]], y.shape[1])
                out.append((to, block, y.tobytes()))
                if i == j:
                    break
        return pa.table([pa.array([o[k] for o in out], f.type) for k, f in enumerate(sums)], schema=sums)

    def added(state: pa.Table, parts: pa.Table) -> tuple[np.ndarray | None, np.ndarray]:
        """alpha W x + restart of a row of the state."""
        y, held = None, np.frombuffer(state["seeds"][0].as_py(), SEED)
        for k in range(parts.num_rows):
            part = np.frombuffer(parts["y"][k].as_py(), "<f8").reshape(slots, -1)
            y = part.copy() if y is None else y + part
        if len(held):
            y = np.zeros((slots, len(state["x"][0].as_py()) // 8 // slots)) if y is None else y
            np.add.at(y, (held["slot"], held["place"]), (1 - alpha) * held["share"])
        return y, held

    def turn_of(omega: float):
        def turn(state: pa.Table, parts: pa.Table) -> pa.Table:
            if not state.num_rows:
                return STATE_SCHEMA.empty_table()
            y, _ = added(state, parts)
            if y is None:
                return state.select(STATE_SCHEMA.names)
            full = lambda c: np.frombuffer(v, "<f8").reshape(y.shape) if (v := state[c][0].as_py()) else np.zeros(y.shape)
            x, p = full("x"), full("p")
            return pa.table([state["segment"], state["block"], state["slots"], pa.array([(omega * (y - p) + p).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), state["seeds"], pa.array([float(np.abs(y - x).sum())])], schema=STATE_SCHEMA)

        return turn

    def met(state: DataFrame) -> DataFrame:
        sent = _sent(state.where("length(x) > 0").select("segment", "block", "x"), walk.parts).select("i", "j", F.pmod("block", F.lit(copies)).cast("int").alias("copy"), "block", "segment", "x")
        key = ["i", "j", "copy"]
        return cells.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(step, "segment int, block int, y binary")

    omega, before = 2 / (1 + math.sqrt(1 - alpha * alpha)), math.inf
    for count in range(most):
        seen = Observation()
        key = ["segment", "block"]
        state = now.groupBy(*key).cogroup(met(now).groupBy(*key)).applyInArrow(turn_of(omega), STATE)
        now = keep(state.observe(seen, F.coalesce(F.sum("moved"), F.lit(0.0)).alias("moved")))
        left = seen.get["moved"]
        if left * alpha / (1 - alpha) <= tol:
            break
        omega = 1.0 if count > 1 and left > before else omega
        before = left
    last = pa.schema([("segment", pa.int32()), ("block", pa.int32()), ("slots", pa.int32()), ("y", pa.binary()), ("sums", pa.list_(pa.float64()))])

    def end(state: pa.Table, parts: pa.Table) -> pa.Table:
        y = added(state, parts)[0] if state.num_rows else None
        if y is None:
            return last.empty_table()
        return pa.table([state["segment"], state["block"], state["slots"], pa.array([y.tobytes()], pa.binary()), pa.array([y.sum(axis=1).tolist()], last.field("sums").type)], schema=last)

    ranks = keep(now.groupBy("segment", "block").cogroup(met(now).groupBy("segment", "block")).applyInArrow(end, "segment int, block int, slots int, y binary, sums array<double>"))
    total = ranks.select("block", F.posexplode("sums").alias("slot", "s")).groupBy("block", "slot").agg(F.sum("s").alias("total"))
    asked = seeds.select("qid", "block", "slot").distinct().join(total, ["block", "slot"])
    rows = ranks.select("segment", "block", "y").join(walk.segments.select("segment", "ids"), "segment")
    schema = pa.schema([("block", pa.int32()), ("slot", pa.int32()), ("id", pa.int64()), ("y", pa.float64())])

    def best(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch["ids"][k].as_py(), "<i8")
                for slot, y in enumerate(np.frombuffer(batch["y"][k].as_py(), "<f8").reshape(slots, -1)):
                    fit = np.flatnonzero(y > 0)
                    if top is not None and len(fit) > top:
                        fit = fit[y[fit] >= np.partition(y[fit], -top)[-top] - 2e-9]
                    for at in range(0, len(fit), 1 << 16):
                        some = fit[at : at + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array([batch["block"][k].as_py()] * len(some), pa.int32()), pa.array([slot] * len(some), pa.int32()), pa.array(ids[some]), pa.array(y[some])], schema=schema)

    return rows.mapInArrow(best, "block int, slot int, id long, y double").join(F.broadcast(asked), ["block", "slot"]).select(F.col("qid").cast(kind), "id", "y", "total")


def score_relations(ranks: DataFrame, relations: DataFrame, degree: DataFrame, hub_keys: DataFrame, k: int | None = 50, by: list[str] | None = None, tie: Column | str = "relation_id") -> DataFrame:
    """qid, rank, relation_id, score of relations at ranked entities: each end's rank over its degree (hubs) or the
    degree's root, and half the root of the ends' product; equal scores by tie. by: the scope's columns, which all tables have."""
    by = by or []
    marked = degree.join(hub_keys.select(*by, "entity_key", F.lit(True).alias("hub")), [*by, "entity_key"], "left")
    ease = marked.select(*by, "entity_key", F.when(F.col("hub"), F.col("degree").cast("double")).otherwise(F.sqrt("degree")).alias("ease"))
    own = ranks.select("qid", *by, F.col("node").alias("entity_key"), "score").join(ease, [*by, "entity_key"]).select("qid", *by, "entity_key", (F.col("score") / F.col("ease")).alias("v"))
    ends = relations.where("subject_key <> object_key").select(*by, "relation_id", F.explode(F.array("subject_key", "object_key")).alias("entity_key"))
    parts = own.join(ends, [*by, "entity_key"]).groupBy("qid", "relation_id").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("ends"), F.min("v").alias("a"), F.max("v").alias("b"))
    both = F.when(F.col("ends") > 1, F.sqrt(F.col("a") * F.col("b"))).otherwise(F.lit(0.0))
    scored = parts.select("qid", "relation_id", F.round(F.col("total") + 0.5 * both, 9).alias("score"))
    return scored if k is None else top_per(scored, k, F.desc("score"), tie).select("qid", "rank", "relation_id", "score")


def scopes(questions: DataFrame, wanted: DataFrame, relation_domains: DataFrame, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """qid, scope of all questions (qid), and scope, relation_id of what each scope keeps.

    A scope is a set of wanted domains (qid, domain); questions that want the same share it. Without a domain, or with fewer
    than `least` relations left, it is WHOLE, of which no relations are listed: it stands for all of them."""
    sets = wanted.where("domain is not null").groupBy("qid").agg(F.array_sort(F.collect_set("domain")).alias("domains"))
    asked = questions.select("qid").distinct().join(sets, "qid", "left").withColumn("scope", F.coalesce(F.sha1(F.to_json("domains")), F.lit(WHOLE)))
    each = asked.where(F.col("scope") != WHOLE).select("scope", F.explode("domains").alias("domain")).distinct()
    kept = each.join(relation_domains.select("relation_id", "domain"), "domain").select("scope", "relation_id").distinct()
    large = kept.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("scope", F.col("scope").alias("own"))
    of = asked.select("qid", "scope").join(large, "scope", "left").select("qid", F.coalesce("own", F.lit(WHOLE)).alias("scope"))
    return of, kept.join(large.select("scope"), "scope", "left_semi")


def scope_graph(questions: DataFrame, wanted: DataFrame, relations: DataFrame, relation_domains: DataFrame, least: int = 5, stored: Keep | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Questions' scopes (qid, scope), and of each scope that occurs the relations (with their ends), the degrees and the hubs,
    all with the column scope. The whole graph is listed once, and only if a question falls back to it."""
    keep = stored or storage.stored
    of, kept = scopes(questions, wanted, relation_domains, least)
    of = keep(of)
    ends = relations.select("relation_id", "subject_key", "object_key")
    whole = of.where(F.col("scope") == WHOLE).select("scope").limit(1)
    every = ends.withColumn("scope", F.lit(WHOLE)).join(whole, "scope", "left_semi").select("scope", "relation_id", "subject_key", "object_key")
    rows = keep(kept.join(ends, "relation_id").select("scope", "relation_id", "subject_key", "object_key").unionAll(every))
    degree = keep(degrees(rows, ["scope"]))
    return of, rows, degree, hubs(degree, by=["scope"])


def scope_kinds(questions: DataFrame, wanted: DataFrame, kinds: DataFrame, least: int = 5, stored: Keep | None = None) -> tuple[DataFrame, DataFrame]:
    """As scopes, of relations that are known by their sets of domains (kinds: domains, n relations): qid, scope of all questions, and
    scope, domains of the sets that each scope keeps; WHOLE keeps all sets. Few rows, whatever the number of relations."""
    keep = stored or storage.stored
    sets = wanted.where("domain is not null").groupBy("qid").agg(F.array_sort(F.collect_set("domain")).alias("wanted"))
    asked = questions.select("qid").distinct().join(sets, "qid", "left").withColumn("scope", F.coalesce(F.sha1(F.to_json("wanted")), F.lit(WHOLE)))
    each = asked.where(F.col("scope") != WHOLE).select("scope", "wanted").distinct()
    met = each.join(F.broadcast(kinds), F.coalesce(F.arrays_overlap("wanted", F.array_compact("domains")), F.lit(False)))
    large = met.groupBy("scope").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("scope", F.col("scope").alias("own"))
    of = keep(asked.select("qid", "scope").join(large, "scope", "left").select("qid", F.coalesce("own", F.lit(WHOLE)).alias("scope")))
    whole = of.where(F.col("scope") == WHOLE).select("scope").limit(1).crossJoin(F.broadcast(kinds.select("domains")))
    return of, keep(met.join(large.select("scope"), "scope", "left_semi").select("scope", "domains").unionAll(whole))


def scoped_relations(seeds: DataFrame, of: DataFrame, rows: DataFrame, degree: DataFrame, hub_keys: DataFrame, k: int = 50, stored: Keep | None = None, **more) -> DataFrame:
    """qid, rank, relation_id, score: the walk from the seeds (qid, entity_key) within each question's scope, and its relations
    by the scope's own degrees and hubs (see scope_graph)."""
    starts = seeds.join(of, "qid").select("qid", "scope", F.col("entity_key").alias("node"))
    ranks = ppr(starts, walk_on(projection(rows, ["scope"]), ["scope"], stored), stored=stored, **more)
    return score_relations(ranks, rows, degree, hub_keys, k, ["scope"])


def chunks_for_relations(ranked: DataFrame, assertions: DataFrame) -> DataFrame:
    """qid, chunk_id, n_relations, relation_ids of the chunks that assert ranked relations."""
    asked = ranked.select("qid", "relation_id").distinct()
    own = assertions.select("relation_id", "chunk_id").join(asked.select("relation_id").distinct(), "relation_id", "left_semi")
    met = asked.join(own.distinct(), "relation_id")
    return met.groupBy("qid", "chunk_id").agg(F.count(F.lit(1)).alias("n_relations"), F.array_join(F.array_sort(F.collect_set("relation_id")), ",").alias("relation_ids"))
