"""Nearest neighbours by inner product over vantage-point trees, one per shard.

Largest inner product is made a metric search: with M the largest norm, a vector x becomes
(x, sqrt(M^2 - |x|^2)) and a query q becomes (q, 0); then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the order by
Euclidean distance is the order by inner product. Rows go to the nearest of a bounded number of pivots; a
pivot's cell is dealt to shards of bounded size by a hash, and each shard is one tree: a node splits its points
at the median distance to its vantage point. A query first searches a shard of its nearest cell, which bounds
its k-th distance; it then goes only to the cells that the triangle inequality leaves, and within a shard only
to the leaves that it leaves. `factor` above one rules out more, one is exact.

Vectors are scaled by their largest component before anything is squared, and bounds allow for what the scores
lose to rounding, overflow and underflow, so finite vectors of any size are ordered by their double-precision
score. Every row is a point and a candidate of its own: a query row leaves out itself alone, and a repeated id
is answered row by row. Ties go to the smaller id. A score that is not a number (infinities of both signs) ranks
last. Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
without an id; vectors of different lengths have no inner product and are never each other's candidates. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlens.llm.common import saved

LEAF = 256
HUGE = float(np.finfo(np.float64).max)


def build(points: np.ndarray, seed: int = 1) -> list:
    """Nodes (vantage row, inner radius bounds, outer bounds, inner child, outer child) or leaf row indexes."""
    rng = np.random.default_rng(seed)
    nodes: list = []

    def grow(rows: np.ndarray) -> int:
        me = len(nodes)
        nodes.append(None)
        if len(rows) > LEAF:
            tries = rows[rng.integers(0, len(rows), 5)]
            some = points[rows[rng.integers(0, len(rows), 64)]]
            spread = [np.sqrt(((some - points[t]) ** 2).sum(1)).std() for t in tries]
            v = int(tries[int(np.argmax(spread))])
            d = np.sqrt(((points[rows] - points[v]) ** 2).sum(1))
            mu = np.median(d)
            inner = d < mu if (d < mu).any() else d <= mu
            if inner.any() and not inner.all():
                a, b = d[inner], d[~inner]
                left, right = grow(rows[inner]), grow(rows[~inner])
                nodes[me] = (v, (a.min(), a.max()), (b.min(), b.max()), left, right)
                return me
        nodes[me] = rows
        return me

    if len(points):
        grow(np.arange(len(points)))
    return nodes


def bounds(points: np.ndarray, nodes: list, queries: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(rows of each leaf, queries x leaves: the least distance that the rings on the way to the leaf allow)."""
    leaves, least = [], []
    todo = [(0, np.zeros(len(queries)))] if nodes else []
    while todo:
        at, gap = todo.pop()
        n = nodes[at]
        if not isinstance(n, tuple):
            leaves.append(n)
            least.append(gap)
            continue
        v, near, far, left, right = n
        d = np.sqrt(((queries - points[v]) ** 2).sum(1))
        for child, ring in ((left, near), (right, far)):
            todo.append((child, np.maximum(gap, np.maximum(ring[0] - d, d - ring[1]))))
    return leaves, np.stack(least, 1) if least else np.zeros((len(queries), 0))


def lifted(x: np.ndarray, big: float, top: float) -> np.ndarray:
    """Points of the metric: x / big with one more component that makes every squared norm `top`."""
    s = x / big
    return np.concatenate([s, np.sqrt(np.maximum(top - (s * s).sum(1), 0))[:, None]], 1)


class Asked:
    """Queries in a metric of scale `big` and squared norm `top`, and how far their scores bound a distance."""

    def __init__(self, queries: np.ndarray, big: float, top: float):
        self.most = np.abs(queries).max(1)
        self.unit = queries / self.most[:, None]  # a query's scale does not change its order
        self.big, self.top = big, top
        self.scale = np.sqrt(top) / np.sqrt((self.unit * self.unit).sum(1))
        # what a score may lose to underflow, in units of the metric
        with np.errstate(all="ignore"):
            lost = np.log10(queries.shape[1]) - 322 - np.log10(self.most) - np.log10(big)
        self.slack = 1e-9 + 4 * self.scale * 10.0 ** np.clip(lost, -300, 300)

    def points(self) -> np.ndarray:
        return np.concatenate([self.unit * self.scale[:, None], np.zeros((len(self.unit), 1))], 1)

    def reach(self, score: np.ndarray) -> np.ndarray:
        """Squared distance within which any vector of at least this score lies; no bound where it is no number."""
        with np.errstate(all="ignore"):
            s = np.clip(score, -HUGE, HUGE) / np.maximum(self.most, self.big) / np.minimum(self.most, self.big)
            d = np.maximum(2 * self.top - 2 * self.scale * s, 0) * (1 + 1e-9) + self.slack
        return np.where(np.isnan(d), np.inf, d)


def products(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component on, so that a score does not depend on how the sum is split."""
    with np.errstate(all="ignore"):
        return np.concatenate([np.zeros(0), *(np.cumsum(queries[i : i + 16384] * x[i : i + 16384], axis=1)[:, -1] for i in range(0, len(x), 16384))])


class Shard:
    """A shard's vectors with their tree, in a scale of its own."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray):
        self.rows, self.ids, self.x = rows, ids, x
        self.big = float(np.abs(x).max())
        s = x / self.big
        self.top = float((s * s).sum(1).max())
        self.points = lifted(x, self.big, self.top)
        self.nodes = build(self.points)

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, factor: float, limit: np.ndarray | None = None, refresh: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Each query's k best by (score, id): (query, place, score) and how many (query, leaf) visits it took.

        own: the queries' row numbers. limit: scores already reached by k others. Every query first visits the
        leaf of the least bound; a later leaf is visited by the queries whose k-th distance so far is not below
        factor x the leaf's bound, all of them at once.
        """
        none = np.zeros(0, np.int64)
        if not len(queries):
            return none, none, np.zeros(0), 0
        asked = Asked(queries, self.big, self.top)
        unit = asked.points()
        leaves, least = bounds(self.points, self.nodes, unit)
        start = asked.reach(np.full(len(queries), np.nan) if limit is None else limit)
        kth = start.copy()  # squared distances
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        kept = (none, none, np.zeros(0))
        visits = 0

        def visit(leaf: int, who: np.ndarray) -> None:
            nonlocal visits
            visits += len(who)
            at = leaves[leaf]
            for i in range(0, len(who), 1024):
                w = who[i : i + 1024]
                d = 2 * self.top - 2 * unit[w, :-1] @ self.points[at, :-1].T
                a, b = np.nonzero((d <= kth[w][:, None]) & (self.rows[at][None] != own[w][:, None]))
                if len(a) > 4 * k * len(w):  # nothing is ruled out yet: only the leaf's own best can be among the k best
                    cut = np.partition(d, min(k, d.shape[1] - 1), 1)[:, min(k, d.shape[1] - 1)]
                    on = d[a, b] <= cut[a] * (1 + 1e-9) + 2 * asked.slack[w][a]
                    a, b = a[on], b[on]
                parts.append((w[a], at[b]))

        def settle() -> None:
            nonlocal kept
            q = np.concatenate([kept[0], *(p[0] for p in parts)])
            r = np.concatenate([kept[1], *(p[1] for p in parts)])
            new = len(kept[0])
            score = np.concatenate([kept[2], products(queries[q[new:]], self.x[r[new:]])])
            parts.clear()
            order = np.lexsort((self.ids[r], np.where(np.isnan(score), np.inf, -score), q))
            q, r, score = q[order], r[order], score[order]
            first = np.searchsorted(q, q)
            on = np.arange(len(q)) - first < k
            kept = (q[on], r[on], score[on])
            last = np.flatnonzero((np.arange(len(q)) - first) == k - 1)
            reached = np.full(len(queries), np.nan)
            reached[q[last]] = score[last]
            np.minimum(start, asked.reach(reached), out=kth)

        if np.isinf(kth).any():
            first = np.where(np.isinf(kth), least.argmin(1), -1)
            for leaf in range(len(leaves)):
                visit(leaf, np.flatnonzero(first == leaf))
            settle()
        else:
            first = np.full(len(queries), -1)
        for n, leaf in enumerate(np.argsort(least.mean(0), kind="stable"), 1):
            visit(int(leaf), np.flatnonzero((first != leaf) & (factor * least[:, leaf] <= np.sqrt(kth))))
            if n % refresh == 0 or n == len(leaves):
                settle()
        return *kept, visits


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(row, id, vec array<double>) of the vectors that take part; row numbers hold once the table is written."""
    v = F.col("vec")
    ok = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & ok)
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "vec")


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


_PART = "shard string, slice int, kind int, rows binary, ids binary, x binary, limit double"


def _packed(rows: DataFrame) -> DataFrame:
    """One row for each shard of (shard, row, id, vec): its row numbers, ids and doubles."""

    def pack(key, table):
        rows, ids = table.column("row").to_numpy(), table.column("id").to_numpy()
        order = np.lexsort((rows, ids))
        x = _matrix(table.column("vec").combine_chunks())[order]
        return pa.table({"shard": pa.array([key[0].as_py()]), "rows": [rows[order].tobytes()], "ids": [ids[order].tobytes()], "x": [x.tobytes()]})

    return rows.select("shard", "row", "id", "vec").groupBy("shard").applyInArrow(pack, "shard string, rows binary, ids binary, x binary")


def _raw(batches):
    """(shard, row, id, vec, limit) with vectors as bytes."""
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column(3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([r.tobytes() for r in x], pa.binary()), b.column(4)], ["shard", "row", "id", "x", "limit"])


def _visit(base: DataFrame, asked: DataFrame, k: int, factor: float, slices: int, tasks: int, block: int) -> DataFrame:
    """(row, query_id, vec_id, score): the k best of each query (shard, row, id, vec, limit) within its shard.

    A (shard, slice of the queries) is read in order: the shard's vectors once, then its queries as they come, so
    a task holds one shard and one block of queries.
    """
    none = lambda t: F.lit(None).cast(t)
    ours = base.select("shard", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "rows", "ids", "x", none("double").alias("limit"), none("long").alias("row"), none("long").alias("id"))
    raw = asked.select("shard", "row", "id", "vec", F.col("limit").cast("double")).mapInArrow(_raw, "shard string, row long, id long, x binary, limit double")
    theirs = raw.select("shard", F.pmod(F.xxhash64(F.lit(5), "row"), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("kind"), none("binary").alias("rows"), none("binary").alias("ids"), "x", "limit", "row", "id")
    both = ours.unionByName(theirs).repartition(tasks, "shard", "slice").sortWithinPartitions("shard", "slice", "kind", "row")

    def run(batches):
        name, shard, wait = None, None, []

        def answer():
            own, ids, x, limit = (np.array(c) for c in zip(*((r, i, np.frombuffer(v), np.nan if s is None else s) for r, i, v, s in wait), strict=True))
            a, hit, score, _ = shard.search(own, x, k, factor, limit.astype(float))
            wait.clear()
            return pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(ids[a]), pa.array(shard.ids[hit]), pa.array(score)], ["row", "query_id", "vec_id", "score"])

        for b in batches:
            names, kinds = b.column("shard"), b.column("kind").to_pylist()
            for i, kind in enumerate(kinds):
                if kind == 0:
                    if wait:
                        yield answer()
                    raw = [b.column(c)[i].as_buffer() for c in ("rows", "ids", "x")]
                    rows, ids = (np.frombuffer(v, np.int64) for v in raw[:2])
                    name, shard = names[i].as_py(), Shard(rows, ids, np.frombuffer(raw[2]).reshape(len(rows), -1))
                elif names[i].as_py() == name:
                    wait.append((b.column("row")[i].as_py(), b.column("id")[i].as_py(), b.column("x")[i].as_py(), b.column("limit")[i].as_py()))
                    if len(wait) >= block:
                        yield answer()
        if wait:
            yield answer()

    return both.mapInArrow(run, "row long, query_id long, vec_id long, score double")


def _cells(rows: DataFrame, dim: int, big: float, pivots: np.ndarray, top: float) -> DataFrame:
    """rows with the cell of the nearest pivot and the distance to it."""
    centres = lifted(pivots, big, top)
    square = (centres * centres).sum(1)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            p = lifted(_matrix(b.column(b.schema.get_field_index("vec"))), big, top)
            cell = (square[None] - 2 * p @ centres.T).argmin(1)
            gap = np.sqrt(((p - centres[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(gap)], [*b.schema.names, "cell", "gap"])

    return rows.mapInArrow(run, "row long, id long, vec array<double>, asked boolean, cell int, gap double")


def _ask(big: float, top: float, pivots: np.ndarray, rings: dict[int, tuple[float, float]], factor: float, home: bool):
    """Queries (row, id, vec, limit) with the cells to visit: the nearest one alone, or all that their limit leaves."""
    cells = np.array(sorted(rings))
    centres = lifted(pivots[cells], big, top)
    near, far = (np.array([rings[c][i] for c in cells.tolist()]) for i in (0, 1))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            asked = Asked(_matrix(b.column(2)), big, top)
            p = asked.points()
            d = np.sqrt(np.maximum((p * p).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * p @ centres.T, 0))
            least = np.maximum(np.maximum(near - d, d - far), 0)
            if home:
                who, at = np.arange(len(p)), np.lexsort((d.T, least.T), axis=0)[0] if len(cells) > 1 else np.zeros(len(p), np.int64)
            else:
                limit = b.column(3).to_numpy(zero_copy_only=False).astype(float)
                who, at = np.nonzero(factor * least <= np.sqrt(asked.reach(limit))[:, None] + 1e-7)
            taken = b.take(pa.array(who))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells[at].astype(np.int32))], ["row", "id", "vec", "limit", "cell"])

    return run


def _of_length(rows: DataFrame, dim: int, n: int, big: float, k: int, factor: float, shard_rows: int, most_pivots: int, slices: int, block: int) -> DataFrame:
    """The search among the rows of one length that fill more than a shard."""
    size = F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x / big) * (x / big))
    top = rows.agg(F.max(size)).first()[0]
    picked = rows.select("vec").orderBy(F.xxhash64(F.lit(7), "row")).limit(min(most_pivots, -(-n // shard_rows))).collect()
    pivots = np.unique(np.array([r["vec"] for r in picked]), axis=0)
    placed = saved(_cells(rows, dim, big, pivots, top), "placed")
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("gap").alias("near"), F.max("gap").alias("far")).collect()  # most_pivots rows
    rings = {r["cell"]: (r["near"], r["far"]) for r in stats}
    subs = F.create_map(*(F.lit(v) for r in stats for v in (r["cell"], -(-r["n"] // shard_rows))))
    named = lambda sub: F.concat_ws("/", F.lit(str(dim)), "cell", sub)
    own = F.pmod(F.xxhash64(F.lit(1), "row"), F.element_at(subs, F.col("cell")))
    base = saved(_packed(placed.withColumn("shard", named(own))), "shards")
    tasks = slices * sum(-(-r["n"] // shard_rows) for r in stats)
    asked = placed.where("asked").select("row", "id", "vec", F.lit(None).cast("double").alias("limit"))
    to = "row long, id long, vec array<double>, limit double, cell int"
    first = asked.mapInArrow(_ask(big, top, pivots, rings, factor, True), to).withColumn("shard", named(own))
    near = saved(_visit(base, first, k, factor, slices, tasks, block), "nearest")
    kth = near.groupBy("row").agg(F.count("*").alias("n"), F.min(F.nanvl("score", F.lit(float("-inf")))).alias("limit")).where(F.col("n") == k).select("row", "limit")
    wide = asked.drop("limit").join(kth, "row", "left").select("row", "id", "vec", "limit").mapInArrow(_ask(big, top, pivots, rings, factor, False), to)
    wide = wide.withColumn("sub", F.explode(F.sequence(F.lit(0), F.element_at(subs, F.col("cell")) - 1))).withColumn("shard", named("sub"))
    seen = first.select("row", F.col("shard").alias("seen"))
    rest = wide.join(seen, "row").where("shard <> seen")
    return near.unionByName(_visit(base, rest, k, factor, slices, tasks, block))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, shard_bytes: int = 4 << 20, most_pivots: int = 256, block: int = 2048, most_asked: int = 16384, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score (inner product of the original vectors) of each query row's k nearest.

    is_query: a condition on `id`. shard_bytes: doubles of a shard. most_pivots: bounds the sample of rows that
    the cells are fitted on; every row is in a cell. most_asked: queries of a shard beyond which it is read by
    several tasks. Lengths that fill one shard at most are that shard.
    """
    rows = saved(usable(vectors, id_col, vec_col).withColumn("asked", F.coalesce(is_query, F.lit(False))), "vectors")
    most = F.array_max(F.transform("vec", F.abs))
    sizes = saved(rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(most).alias("big"), F.count_if("asked").alias("q")), "lengths")
    fits = lambda dim: F.lit(shard_bytes) / (F.lit(8) * dim)
    wide = sizes.where(F.col("n") > F.greatest(F.lit(64), fits(F.col("dim")))).collect()  # lengths, not rows
    total = sizes.agg(F.sum("q").alias("q"), F.count("*").alias("n")).first()
    slices = max(1, -(-(total["q"] or 0) // most_asked))
    few = rows.where(~F.size("vec").isin([r["dim"] for r in wide])).withColumn("shard", F.size("vec").cast("string"))
    out = _visit(saved(_packed(few), "shards"), few.where("asked").withColumn("limit", F.lit(None)), k, factor, slices, max(1, total["n"] - len(wide)) * slices, block)
    for r in wide:
        own = rows.where(F.size("vec") == r["dim"])
        out = out.unionByName(_of_length(own, r["dim"], r["n"], r["big"], k, factor, max(64, shard_bytes // (8 * r["dim"])), most_pivots, slices, block))
    w = Window.partitionBy("row").orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), F.isnan("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.r, q.vec_id AS query_id, v.vec_id, list_reduce([q.e[i] * v.e[i] FOR i IN range(1, len(v.e) + 1)], lambda a, b: a + b) AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.r <> v.r AND len(q.e) = len(v.e)),
n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM n WHERE k <= 20
"""
