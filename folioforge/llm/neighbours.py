"""Approximate nearest neighbours by stable projections in kd-trees, with a chi-square stopping test.

Inner products become distances: every vector gets one more coordinate, sqrt(M^2 - |v|^2) with M the greatest norm, and
the query gets 0, so the largest inner product is the least distance. A Gaussian (2-stable) projection to DIMS
dimensions keeps distances in law: the squared projected distance over the true one is chi-square with DIMS degrees of
freedom. A query walks the leaves of a kd-tree over the projections from the nearest outwards and verifies the vectors
of each on the original ones; it stops when a vector nearer than the k-th best so far would, with probability SURE,
have shown up within the projected distance already walked.

Equal vectors are one entry with their least k + 1 ids, so groups of copies of any size cost one entry. The top of the
kd-tree is fitted on a bounded sample and cuts the entries into cells; a query first asks its own cell, and with the
k-th score found there only those cells whose box the stopping test leaves open.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import stored
from folioforge.llm.jaccard import by_group, flat, lists

DIMS, SURE, LEAF = 8, 0.95, 256
#: Entries of a cell, about; cells, at most (beyond, cells grow); projected entries that the cuts are fitted on, about:
#: SAMPLE, or PER_CELL for each cell where that is more. So the driver holds a million points of DIMS numbers at most.
CELL, CELLS, SAMPLE, PER_CELL = 8_192, 65_536, 20_000, 16


def chi2_quantile(p: float, k: int) -> float:
    """The p-quantile of the chi-square distribution with an even number k of degrees of freedom."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        x = (lo + hi) / 2
        term, total = 1.0, 1.0
        for i in range(1, k // 2):
            term *= x / 2 / i
            total += term
        lo, hi = (x, hi) if 1 - np.exp(-x / 2) * total < p else (lo, x)
    return hi


STOP = chi2_quantile(SURE, DIMS)


def projection(dim: int, dims: int = DIMS, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim + 1, dims))


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(top**2 - (x * x).sum(1), 0))[:, None]], 1)


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products row by row, in double precision and in one order of summation for equal rows."""
    return (x * q).sum(1)


def halves(p: np.ndarray, parts: int) -> list[tuple[int, float]]:
    """Splits (axis, cut) of a complete binary tree with `parts` leaves, level by level, at medians of the widest axis."""
    nodes, level = [], [np.arange(len(p))]
    while len(level) < parts:
        after = []
        for rows in level:
            axis = int(np.argmax(p[rows].max(0) - p[rows].min(0))) if len(rows) else 0
            cut = float(np.median(p[rows, axis])) if len(rows) else 0.0
            nodes.append((axis, cut))
            right = p[rows, axis] > cut
            after += [rows[~right], rows[right]]
        level = after
    return nodes


def cell_of(p: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(p), int)
    axes, cuts = np.array([a for a, _ in nodes] or [0]), np.array([c for _, c in nodes] or [np.inf])
    for _ in range((len(nodes) + 1).bit_length() - 1):
        at = 2 * at + 1 + (p[np.arange(len(p)), axes[at]] > cuts[at])
    return at - len(nodes)


class Tree:
    """A kd-tree over projections whose leaves hold LEAF entries, about; split at the median of the widest axis."""

    def __init__(self, p: np.ndarray):
        stack, leaves = [np.arange(len(p))], []
        while stack:
            rows = stack.pop()
            spread = p[rows].max(0) - p[rows].min(0)
            if len(rows) <= LEAF or not spread.max():
                leaves.append(rows)
                continue
            order = rows[np.argsort(p[rows, int(np.argmax(spread))], kind="stable")]
            stack += [order[: len(order) // 2], order[len(order) // 2 :]]
        self.order = np.concatenate(leaves) if leaves else np.zeros(0, int)
        self.ends = np.cumsum([len(r) for r in leaves])
        self.low, self.high = np.array([p[r].min(0) for r in leaves]), np.array([p[r].max(0) for r in leaves])

    def walk(self, q: np.ndarray):
        """(least squared projected distance, first place, last place + 1 in `order`) of the leaves, the nearest first."""
        gap = np.maximum(self.low - q, 0) + np.maximum(q - self.high, 0)
        d = (gap * gap).sum(1)
        for leaf in np.argsort(d, kind="stable").tolist():
            yield d[leaf], int(self.ends[leaf - 1]) if leaf else 0, int(self.ends[leaf])


def search(tree: Tree, x: np.ndarray, copies: np.ndarray, q: np.ndarray, qp: np.ndarray, top: float, k: int, known: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of at least the k nearest ids of one query; x and copies stand in the tree's order, `known` is a
    k-th score found elsewhere."""
    rows, scores, floor = [], [], known
    reach = top**2 + inner(q[None, :], q)[0]
    slack = 1e-9 * max(top**2, reach)
    for d, a, b in tree.walk(qp):
        # squared distance of the k-th best: |q|^2 + M^2 - 2 score
        if d > STOP * max(reach - 2 * floor, 0.0) and floor > -np.inf:
            break
        # a fast product leaves out what is clearly too far; the rest is summed in the one fixed order
        near = np.flatnonzero(x[a:b] @ q >= floor - slack)
        if len(near):
            near += a
            s = inner(x[near], q)
            near, s = near[s >= floor], s[s >= floor]
            rows.append(near)
            scores.append(s)
            if sum(map(len, rows)) >= 4 * k or floor == -np.inf:
                r, s = np.concatenate(rows), np.concatenate(scores)
                order = np.argsort(-s, kind="stable")
                r, s = r[order], s[order]
                full = np.searchsorted(np.cumsum(copies[r]), k)
                if full < len(r):
                    floor = max(floor, s[full])
                    keep = s >= floor
                    r, s = r[keep], s[keep]
                rows, scores = [r], [s]
    if not rows:
        return np.zeros(0, int), np.zeros(0)
    return np.concatenate(rows), np.concatenate(scores)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): for each query row the k nearest rows of `vectors` but itself by inner product.

    Ties go to the smaller key; with fewer candidates all are returned. Vectors that are null, zero, or hold null or
    non-finite components, or whose squares do not add up to a finite number, take no part, nor do rows with a null key or
    of another length than most. A repeated key is
    one candidate for each distinct vector that it has.
    """
    spark = vectors.sparkSession
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0) & (squares < float("inf"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where("id IS NOT NULL").where(usable)
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where("id IS NOT NULL").where(usable)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    dim = size.d
    rows, asked = rows.where(F.size("v") == dim), asked.where(F.size("v") == dim)

    # equal vectors: one entry with its least k + 1 ids, which the window limits before it shuffles
    code = F.xxhash64("v")
    ranked = rows.distinct().withColumn("_h", code).withColumn("_r", F.row_number().over(Window.partitionBy("_h", "v").orderBy("id"))).where(F.col("_r") <= k + 1)
    entries = stored(ranked.groupBy("_h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    asked = stored(asked.distinct().withColumn("_h", code))
    shapes = stored(asked.groupBy("_h", "v").agg(F.min("id").alias("q")))
    facts = entries.agg(F.count("*").alias("n"), F.max(norm).alias("top")).first()
    top, n = float(facts.top), facts.n
    g = projection(dim)

    cells = min(CELLS, 1 << max(0, int(np.ceil(np.log2(max(n, 1) / CELL)))))
    nodes: list[tuple[int, float]] = []
    if cells > 1:
        step = max(1, n // max(SAMPLE, PER_CELL * cells))

        def projected(batches):
            for batch in batches:
                p = lifted(flat(batch.column(0))[0].reshape(-1, dim), top) @ g
                yield pa.RecordBatch.from_arrays([lists(p.ravel(), np.arange(len(p) + 1) * DIMS)], ["p"])

        some = entries.where(F.pmod("_h", F.lit(step)) == 0).select("v").mapInArrow(projected, "p array<double>").toArrow()["p"]
        points = flat(some)[0].reshape(-1, DIMS)
        nodes = halves(points[np.lexsort(points.T)], cells)

    def placed(names: list[str], lift: bool):
        def run(batches):
            for batch in batches:
                v, b = flat(batch.column(0))
                x = v.reshape(-1, dim)
                p = (lifted(x, top) if lift else np.concatenate([x, np.zeros((len(x), 1))], 1)) @ g
                yield pa.RecordBatch.from_arrays([pa.array(cell_of(p, nodes)), *batch.columns, lists(p.ravel(), np.arange(len(p) + 1) * DIMS)], ["cell", *names, "p"])

        return run

    held = stored(entries.select("v", "ids").mapInArrow(placed(["v", "ids"], True), "cell long, v array<double>, ids array<long>, p array<double>"))
    sought = stored(shapes.select("v", "q").mapInArrow(placed(["v", "q"], False), "cell long, v array<double>, q long, p array<double>"))
    # the box of a cell: what its entries really cover
    boxes = held.groupBy("cell").agg(*[f(F.col("p")[i]).alias(f"{m}{i}") for i in range(DIMS) for m, f in (("lo", F.min), ("hi", F.max))]).toPandas()

    def body(t: pa.Table):
        cell, kind = t["cell"][0].as_py(), t["kind"].to_numpy(zero_copy_only=False)
        own = t.filter(pa.array(kind == 0))
        if not own.num_rows or not (kind == 1).any():
            return
        x, p = flat(own["v"])[0].reshape(-1, dim), flat(own["p"])[0].reshape(-1, DIMS)
        ids, bounds = flat(own["ids"])
        copies, tree = np.diff(bounds), Tree(p)
        x, copies = x[tree.order], copies[tree.order]
        ask = t.filter(pa.array(kind == 1))
        out_q, out_id, out_s = [], [], []
        for q, qv, qp, known in zip(ask["q"].to_pylist(), flat(ask["v"])[0].reshape(-1, dim), flat(ask["p"])[0].reshape(-1, DIMS), ask["known"].to_numpy(zero_copy_only=False)):
            at, s = search(tree, x, copies, qv, qp, top, k + 1, known)
            if not len(at):
                continue
            each = np.concatenate([ids[bounds[i] : bounds[i + 1]] for i in tree.order[at]])
            s = np.repeat(s, copies[at])
            keep = np.lexsort((each, -s))[: k + 1]
            out_q += [q] * len(keep)
            out_id.append(each[keep])
            out_s.append(s[keep])
            if sum(map(len, out_id)) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(np.concatenate(out_id)), pa.array(np.concatenate(out_s))], ["q", "id", "score"])
                out_q, out_id, out_s = [], [], []
        if out_q:
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(np.concatenate(out_id)), pa.array(np.concatenate(out_s))], ["q", "id", "score"])

    kept = held.select("cell", F.lit(0).alias("kind"), "v", "p", "ids", F.lit(None).cast("long").alias("q"), F.lit(None).cast("double").alias("known"))

    def asking(where: DataFrame) -> DataFrame:
        sent = kept.union(where.select("cell", F.lit(1), "v", "p", F.array().cast("array<long>"), "q", "known"))
        return sent.repartition("cell").sortWithinPartitions("cell", "kind", "q").mapInArrow(by_group([], body), "q long, id long, score double")

    near = stored(asking(sought.withColumn("known", F.lit(float("-inf")))))
    floor = near.groupBy("q").agg(F.count("*").alias("m"), F.min("score").alias("_s")).select("q", F.when(F.col("m") > k, F.col("_s")).otherwise(F.lit(float("-inf"))).alias("known"))
    low, high, names = boxes[[f"lo{i}" for i in range(DIMS)]].to_numpy(), boxes[[f"hi{i}" for i in range(DIMS)]].to_numpy(), boxes["cell"].to_numpy()

    def routed(batches):
        for batch in batches:
            v, p = flat(batch.column(1))[0].reshape(-1, dim), flat(batch.column(2))[0].reshape(-1, DIMS)
            known, home = batch.column(4).to_numpy(zero_copy_only=False), batch.column(0).to_numpy()
            reach = STOP * np.maximum(top**2 + (v * v).sum(1) - 2 * known, 0)
            gap = np.maximum(low[None] - p[:, None], 0) + np.maximum(p[:, None] - high[None], 0)
            i, j = np.nonzero(((gap * gap).sum(2) <= reach[:, None]) & (names[None, :] != home[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(names[j]), *(batch.column(c).take(pa.array(i)) for c in (1, 2, 3, 4))], ["cell", "v", "p", "q", "known"])

    start = sought.join(floor, "q", "left").select("cell", "v", "p", "q", F.coalesce("known", F.lit(float("-inf"))).alias("known"))
    far = asking(start.mapInArrow(routed, "cell long, v array<double>, p array<double>, q long, known double")) if cells > 1 else near.limit(0)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    # k + 1 of each distinct query vector, then each query without itself
    every = stored(near.union(far).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("_r", "id", "score"))).alias("best")))
    named = shapes.select("_h", "v", "q").join(every, "q").select("_h", "v", "best")
    done = asked.select("id", "_h", "v").join(named, ["_h", "v"]).select("id", F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k).alias("best"))
    return done.select(F.col("id").alias("query_id"), F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.id").alias(key), F.col("b.score").alias("score"))
