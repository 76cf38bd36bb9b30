"""Approximate nearest neighbours: a graph by NN-descent, searched greedily.

Equal vectors are one node. The graph starts from the nearest in random buckets of a few hyperplanes. A round of
NN-descent joins each node with its neighbours and with those whose neighbour it is, compares these with each other,
and gives each node the nearest it has met; it takes a few rounds of joins. A query walks the graph: in a step it
expands the nearest nodes that it knows and has not expanded, all queries at once, until those in its beam are all
expanded. Distances are in 64-bit floats and of the vectors themselves, which travel as 32-bit floats where that loses
nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm.common import drop_written, quoted, read, written

#: Neighbours of a node, reverse neighbours that a round takes besides, and rounds.
DEGREE, REVERSE, ROUNDS = 32, 16, 3
#: Sets of hyperplanes, nodes a bucket on average, and nodes that are compared with each other at most.
TREES, BUCKET, BLOCK = 4, 400, 1_024
#: Nodes that a query keeps open in a graph of up to BEAM_NODES nodes, and the power of the nodes by which they grow beyond.
BEAM, BEAM_NODES, BEAM_POWER = 192, 50_000, 0.5
#: The part of its beam that a query expands in a step: fewer nodes are met if a step is small, and more steps are taken.
STEP = 1 / 4
#: Copies of a vector that are told apart: one more than any query returns.
COPIES = 101

EDGE = "array<struct<d:double,v:bigint>>"


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct vectors of a partition with their smallest ids."""
    seen: dict[bytes, list[int]] = {}
    for batch in batches:
        lists = batch.column("vec")
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        for kid, row in zip(batch.column("id").to_pylist(), flat.reshape(batch.num_rows, -1), strict=True):
            seen.setdefault(row.tobytes(), []).append(kid)
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([sorted(ids)[:COPIES] for ids in seen.values()], pa.list_(pa.int64()))], ["vec", "ids"])


def usable(frame: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the vectors that take part: whole, finite, not zero, and of the most common length."""
    rows = frame.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).cast("array<double>").alias("vec")).where("id IS NOT NULL AND size(vec) > 0")
    fit = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.where(fit)
    common = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), "n").first()
    return rows.where(F.size("vec") == (common["n"] if common else 0))


def points(rows: DataFrame) -> DataFrame:
    """(node, vec, ids): distinct vectors as 64-bit floats, named by a hash of them, and the smallest COPIES of their ids."""
    local = rows.mapInArrow(_distinct, "vec binary, ids array<long>")
    merged = local.groupBy("vec").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, COPIES).alias("ids"))
    return merged.select(F.xxhash64("vec").alias("node"), "vec", "ids")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column("vec"), np.float64)
        if len(x):
            with np.errstate(over="ignore"):
                single = bool(((x.astype(np.float32) == x) & ((x == 0) | (np.abs(x) > 1e-11) & (np.abs(x) < 1e15))).all())  # and squares of differences are normal numbers
            dims = x.shape[1]
            yield pa.RecordBatch.from_pydict({"dim": np.arange(dims), "middle": np.median(x, axis=0), "single": np.full(dims, single), "n": np.full(dims, len(x))})


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    items = column.to_pylist()
    return np.frombuffer(b"".join(items), kind).reshape(len(items), -1) if items else np.zeros((0, 1), kind)


def _as(kind: type) -> Callable:
    """(node, h): vectors as floats of kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"), np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in x.astype(kind)] if batch.num_rows else [], pa.binary())], ["node", "h"])

    return run


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of two stacks of matrices."""
    d = (a * a).sum(-1)[..., :, None] + (b * b).sum(-1)[..., None, :] - 2 * a @ np.swapaxes(b, -1, -2)
    return np.maximum(d, 0)


def _measured(kind: type) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_matrix(batch.column(c), kind).astype(np.float64) for c in ("qh", "h"))
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("v"), pa.array(((a - b) ** 2).sum(1), pa.float64())], ["q", "v", "d"])

    return run


def beam_of(nodes: int) -> int:
    """Nodes that a query keeps open: they grow with the graph, or the walk sees an ever smaller share and recall falls."""
    return int(np.ceil(BEAM * max(1.0, nodes / BEAM_NODES) ** BEAM_POWER))


def walked(state: DataFrame, queries: DataFrame, beam: int, kind: type, width: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """What greedy search of the graph finds from each query node q, and the tables (q, v) of all that it met.

    Found: (q, v, d), each query's nearest beam nodes and those tied with the last. A step expands those of them that
    are not yet expanded, the nearest width at most; a query for which there are none is done, and the walk ends when
    all are.
    """
    width = width or max(1, int(np.ceil(beam * STEP)))
    halves = state.select(F.col("node").alias("v"), "h")
    links = state.select("node", F.explode("near").alias("e")).select(F.col("node").alias("a"), F.col("e.v").alias("b"))
    around = written(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "around")
    asked = written(queries.join(halves.withColumnRenamed("v", "q"), "q").select("q", F.col("h").alias("qh")), "asked")
    front = written(asked.select("q", F.col("q").alias("v"), F.lit(0.0).alias("d"), F.lit(False).alias("done"), F.lit(1).alias("turn")), "front")
    met = [written(asked.select("q", F.col("q").alias("v")), "met")]
    place, turn = F.rank().over(Window.partitionBy("q").orderBy("d")), F.row_number().over(Window.partitionBy("q", "done").orderBy("d", "v"))
    while not (chosen := front.where((F.col("turn") <= width) & ~F.col("done")).select("q", "v")).isEmpty():
        before = met[0]
        for more in met[1:]:
            before = before.unionAll(more)
        stepped = chosen.join(around.withColumnRenamed("a", "v"), "v").select("q", F.col("b").alias("v")).distinct()
        unknown = stepped.join(before, ["q", "v"], "left_anti").join(halves, "v").join(asked, "q")
        new = written(unknown.select("q", "v", "qh", "h").mapInArrow(_measured(kind), "q long, v long, d double"), "met")
        met.append(new.select("q", "v"))
        met[-1].quadrille_path = new.quadrille_path
        marked = front.select("q", "v", "d", (F.col("done") | (F.col("turn") <= width)).alias("done"))
        nearest = marked.unionAll(new.withColumn("done", F.lit(False))).withColumn("place", place).where(F.col("place") <= beam).drop("place")
        after = written(nearest.withColumn("turn", turn), "front")
        drop_written(front)
        front = after
    drop_written(around)
    drop_written(asked)
    return front.select("q", "v", "d"), met


#: Nodes of a shard, within these bounds, so that there are PARTS shards or more; and the planes by which a shard's entries are finer than its buckets.
SHARD_LEAST, SHARD_MOST, PARTS, FINER = 16_384, 65_536, 48, 4
#: Shards of a small table, so that tasks share the work, and nodes below which there is one.
FEW_PARTS, WHOLE = 6, 4_096
#: Neighbours of a node whose neighbours a round looks at, and how many of these; nodes or queries that are looked up at once.
NEAREST, THEIRS, LOOK = 16, 16, 128
#: Nodes of a query's bucket in each tree where its walk of a shard starts at most, its beam there, and pairs that are measured at once.
ENTRIES, SHARD_BEAM, PIECE = 64, 96, 2_048


def shards_of(nodes: int) -> int:
    if nodes <= WHOLE:
        return 1
    return max(FEW_PARTS, int(np.ceil(nodes / min(SHARD_MOST, max(SHARD_LEAST, nodes / PARTS)))))


def _lengths(x: np.ndarray, a: np.ndarray, b: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    """Squared distances of rows a of x and b of y, by their differences: near copies lose no precision."""
    out = np.empty(len(a))
    for i in range(0, len(a), PIECE):
        d = x[a[i : i + PIECE]] - (x if y is None else y)[b[i : i + PIECE]]
        out[i : i + PIECE] = np.einsum("nd,nd->n", d, d)
    return out


def _nearest(near: np.ndarray, far: np.ndarray, more: np.ndarray, more_far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of two lists of each row, nearest first; absent ones are -1, and what a row holds twice counts once."""
    v, d = np.concatenate([near, more], 1), np.concatenate([far, more_far], 1)
    order = np.argsort(v, axis=1, kind="stable")
    v, d = np.take_along_axis(v, order, 1), np.take_along_axis(d, order, 1)
    d[:, 1:][v[:, 1:] == v[:, :-1]] = np.inf
    if d.shape[1] > k:
        part = np.argpartition(d, k - 1, axis=1)[:, :k]
        v, d = np.take_along_axis(v, part, 1), np.take_along_axis(d, part, 1)
    order = np.argsort(d, axis=1, kind="stable")
    v, d = np.take_along_axis(v, order, 1), np.take_along_axis(d, order, 1)
    v[~np.isfinite(d)] = -1
    return v, d


def _reverse(near: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of those whose neighbour a node is, -1 where there are fewer."""
    u, at = np.nonzero(near >= 0)
    v, d = near[u, at], far[u, at]
    order = np.lexsort((u, d, v))
    u, v = u[order], v[order]
    place = np.arange(len(v)) - np.searchsorted(v, v)
    out = np.full((len(near), k), -1)
    first = place < k
    out[v[first], place[first]] = u[first]
    return out


def descended(x: np.ndarray, buckets: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """A graph by NN-descent of the rows of x: DEGREE neighbours of each, nearest first, -1 where there are fewer, and their squared distances.

    It starts from the nearest in each tree's bucket. In a round a node meets the neighbours of its nearest and of those
    whose neighbour it is; the rounds end early when few lists change.
    """
    n = len(x)
    near, far = np.full((n, DEGREE), -1), np.full((n, DEGREE), np.inf)
    for tree in buckets:
        order = np.argsort(tree, kind="stable")
        cuts = np.nonzero(np.append(True, tree[order][1:] != tree[order][:-1]))[0]
        for begin, end in zip(cuts, np.append(cuts[1:], n), strict=True):
            parts = -(-(end - begin) // BLOCK)
            for rows in (order[begin + p : end : parts] for p in range(parts)):
                if (k := min(DEGREE, len(rows) - 1)) > 0:
                    y = x[rows] - np.median(x[rows], axis=0)
                    d = squared(y, y)
                    np.fill_diagonal(d, np.inf)
                    at = np.argpartition(d, k - 1, axis=1)[:, :k]
                    more = rows[at]
                    near[rows], far[rows] = _nearest(near[rows], far[rows], more, _lengths(x, np.repeat(rows, k), more.ravel()).reshape(more.shape), DEGREE)
    for _ in range(rounds):
        around = np.concatenate([near[:, :NEAREST], _reverse(near, far, REVERSE)], 1)
        again, far_again, changed = near.copy(), far.copy(), 0
        for begin in range(0, n, LOOK):
            rows = np.arange(begin, min(begin + LOOK, n))
            own = around[rows]
            met = np.where(own[:, :, None] >= 0, near[own, :THEIRS], -1).reshape(len(rows), -1)
            met = np.sort(np.concatenate([met, own[:, NEAREST:]], 1), axis=1)
            good = (met >= 0) & (met != rows[:, None])
            good[:, 1:] &= met[:, 1:] != met[:, :-1]
            u, at = np.nonzero(good)
            d = np.full(met.shape, np.inf)
            d[u, at] = _lengths(x, rows[u], met[u, at])
            k = min(DEGREE, d.shape[1])
            part = np.argpartition(d, k - 1, axis=1)[:, :k]
            again[rows], far_again[rows] = _nearest(near[rows], far[rows], np.take_along_axis(met, part, 1), np.take_along_axis(d, part, 1), DEGREE)
            changed += (again[rows] != near[rows]).sum()
        near, far = again, far_again
        if changed < 0.01 * near.size:
            break
    return near, far


def _around(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node's neighbours and all whose neighbour it is: where a node's begin, and these side by side."""
    u, at = np.nonzero(near >= 0)
    v = near[u, at]
    a, b = np.concatenate([u, v]), np.concatenate([v, u])
    return np.append(0, np.cumsum(np.bincount(a, minlength=len(near)))), b[np.argsort(a, kind="stable")]


def greedy(x: np.ndarray, around: tuple[np.ndarray, np.ndarray], asked: np.ndarray, starts: list[np.ndarray], beam: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy search of a graph for rows of asked from nodes to start at: (query, node, squared distance) of each query's k nearest met and all tied with the last, and how many each met.

    A step expands the nearest nodes of a query's beam that are not yet expanded; the walk ends when all of them are.
    """
    (first, ends), n, m, width = around, len(x), len(asked), max(1, int(np.ceil(beam * STEP)))
    stamp = np.full(m * n, -1, np.int32)
    held, far, done = np.full((m, beam), -1), np.full((m, beam), np.inf), np.ones((m, beam), bool)
    told = []
    q, v = np.repeat(np.arange(m), [len(s) for s in starts]), np.concatenate(starts)
    while len(q):
        flat = q * n + v
        flat = flat[stamp[flat] < 0]
        stamp[flat] = np.arange(len(flat))
        flat = flat[stamp[flat] == np.arange(len(flat))]  # a place's last number stays: each pair once
        q, v = flat // n, flat % n
        d = _lengths(x, v, q, asked)
        told.append((q, v, d))
        size = np.bincount(q, minlength=m)
        wide = int(size.max()) if len(q) else 0
        new, new_far = np.full((m, wide), -1), np.full((m, wide), np.inf)
        place = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size)
        new[q, place], new_far[q, place] = v, d
        held, far, done = np.concatenate([held, new], 1), np.concatenate([far, new_far], 1), np.concatenate([done, new < 0], 1)
        part = np.argpartition(far, beam - 1, axis=1)[:, :beam]
        held, far, done = (np.take_along_axis(c, part, 1) for c in (held, far, done))
        waits = np.where(done, np.inf, far)
        at = np.argpartition(waits, width - 1, axis=1)[:, :width] if width < beam else np.broadcast_to(np.arange(beam), (m, beam))
        going = np.isfinite(np.take_along_axis(waits, at, 1))
        row, col = np.nonzero(going)
        col = at[row, col]
        done[row, col] = True
        low, size = first[held[row, col]], first[held[row, col] + 1] - first[held[row, col]]
        q = np.repeat(row, size)
        v = ends[np.arange(len(q)) - np.repeat(np.cumsum(size) - size - low, size)]
    q, v, d = (np.concatenate(c) for c in zip(*told, strict=True))
    last = np.sort(far, axis=1)[:, min(k, beam) - 1]
    good = d <= last[q]
    return q[good], v[good], d[good], np.bincount(q, minlength=m)


def _shard(kind: type, centre: np.ndarray, planes: np.ndarray, beam: int, k: int) -> Callable:
    """What all queries find in a shard, whose graph is made here: shard, q, v, d, and the nodes that q met."""

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        names = table.column("node").to_numpy()
        x = _matrix(table.column("h"), kind)
        names, x, asked_names, asked = names[~asks], x[~asks], names[asks], x[asks]
        order = np.argsort(names)  # the same graph whatever the order of rows
        names, x = names[order], x[order]
        cuts = max(0, int(np.ceil(np.log2(len(x) / BUCKET)))) if len(x) > BLOCK else 0
        used = planes[:, : cuts + FINER]
        sides = lambda y: np.einsum("nd,tbd->tnb", y - centre, used) > 0
        power = 1 << np.arange(used.shape[1])
        own, there = sides(x), sides(asked)
        near, far = descended(x, (own[:, :, :cuts] * power[:cuts]).sum(2))
        around = _around(near)
        fine, wanted = (own * power).sum(2), (there * power).sum(2)
        orders = [np.argsort(t, kind="stable") for t in fine]
        entries = np.unique(np.linspace(0, len(x) - 1, min(len(x), 32)).astype(np.int64))
        out = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0)] + [np.zeros(0, np.int64)]]
        for begin in range(0, len(asked) if len(x) else 0, LOOK):
            block = np.arange(begin, min(begin + LOOK, len(asked)))
            starts = [[entries] for _ in block]
            for t, o in enumerate(orders):
                low, high = (np.searchsorted(fine[t][o], wanted[t, block], side) for side in ("left", "right"))
                for s, a, b in zip(starts, low, high, strict=True):
                    s.append(o[a:b][:ENTRIES])
            q, v, d, met = greedy(x, around, asked[block], [np.concatenate(s) for s in starts], beam, k)
            out.append((asked_names[block[q]], names[v], d, met[q]))
        q, v, d, met = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"shard": pa.array(np.full(len(q), table.column("shard")[0].as_py()), pa.int32()), "q": pa.array(q, pa.int64()), "v": pa.array(v, pa.int64()), "d": pa.array(d, pa.float64()), "met": pa.array(met, pa.int64())})

    return run


def sharded(nodes: DataFrame, queries: DataFrame, count: int, kind: type, centre: np.ndarray, k: int, seed: int) -> DataFrame:
    """(shard, q, v, d, met): what each query node finds in each shard's graph, the k nearest there and those tied with the last.

    nodes: (node, h), which are dealt to shards at random. Every query walks every shard, so nothing is lost to the
    dealing; the walks' work grows with the queries times the shards.
    """
    shards = shards_of(count)
    most = -(-count // shards)
    cuts = max(0, int(np.ceil(np.log2(max(1, 2 * most) / BUCKET)))) + FINER
    planes = np.random.default_rng(seed).normal(size=(TREES, cuts, len(centre)))
    dealt = nodes.select(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(shards)).cast("int").alias("shard"), "node", "h", F.lit(False).alias("asks"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    asks = nodes.join(queries.withColumnRenamed("q", "node"), "node").select(parts, "node", "h", F.lit(True).alias("asks"))
    every = dealt.unionAll(asks).repartitionByRange(shards, "shard")  # a task a shard
    return written(every.groupBy("shard").applyInArrow(_shard(kind, centre, planes, SHARD_BEAM if shards > 1 else beam_of(count), k), "shard int, q long, v long, d double, met long"), "found")


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (_matrix(batch.column(c), np.float64) for c in ("qvec", "vec"))
        yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("ids"), pa.array(np.sqrt(((a - b) ** 2).sum(1)))], ["q", "ids", "score"])


def search(frame: DataFrame, wanted: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, seed: int = 11) -> DataFrame:
    """The k nearest found of each row for which wanted, a condition on id, holds: query_id, rank, vec_id, score, nearest first.

    Ties go to the smaller id; fewer than k candidates give as many rows. Vectors that are null, zero, of another length
    than most, or hold null or non-finite components take no part, and rows with a null id neither. Ids that repeat with
    different vectors are different candidates; rows that repeat both are one. k is below COPIES. Other columns are not read.
    """
    rows = usable(frame, id_col, vector_col)
    base = written(points(rows.distinct()), "points")
    moments = base.select("vec").mapInArrow(_moments, "dim long, middle double, single boolean, n long").groupBy("dim").agg(F.percentile_approx("middle", 0.5).alias("middle"), F.min("single").alias("single"), F.sum("n").alias("n")).orderBy("dim").toPandas()
    count = int(moments["n"].max()) if len(moments) else 0
    centre = moments["middle"].to_numpy() if count else np.zeros(1)
    kind = np.float32 if count and moments["single"].all() else np.float64
    nodes = written(base.select("node", "vec").mapInArrow(_as(kind), "node long, h binary"), "nodes")
    asked = rows.where(wanted).select("id", "vec").distinct()
    packed = asked.mapInArrow(_packed, "id long, vec binary")
    named = written(packed.join(base.select("vec", F.col("node").alias("q")), "vec").select(F.col("id").alias("query_id"), "q"), "queries")
    found = sharded(nodes, named.select("q").distinct(), count, kind, centre, 4 * k, seed)
    drop_written(nodes)
    few = written(found.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") <= min(k, count - 1)).select("q"), "few")
    closest = found.withColumn("n", F.rank().over(Window.partitionBy("q").orderBy("d"))).where(F.col("n") <= 4 * k).select("q", "v")
    if not few.isEmpty():  # their part of the graph has no k others: these queries are compared with all nodes
        closest = closest.join(few, "q", "left_anti").unionAll(few.crossJoin(base.select(F.col("node").alias("v"))))
    both = closest.join(base.select(F.col("node").alias("v"), "vec", "ids"), "v").join(base.select(F.col("node").alias("q"), F.col("vec").alias("qvec")), "q")
    scored = both.select("q", "qvec", "vec", "ids").mapInArrow(_scored, "q long, ids array<long>, score double").select("q", "score", F.explode("ids").alias("vec_id"))
    first = scored.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("n") <= k + 1).drop("n")
    told = named.join(first, "q").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy("score", "vec_id"))
    return told.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        packed = [r.tobytes() for r in flat.reshape(batch.num_rows, -1)] if batch.num_rows else []
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], ["id", "vec"])


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
