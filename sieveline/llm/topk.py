"""Exact k nearest vectors of queries, with multi-resolution lower bounds.

A vector is cut into segments, and the means and deviations of the segments bound
the distance of two vectors from below:

    |x - y|^2 >= sum over segments of len * ((mean_x - mean_y)^2 + (dev_x - dev_y)^2)

More segments bound closer. Search goes from coarse to fine:

1. Equal vectors become one, with their k + 1 smallest ids: no result can hold more of
   them. So repeated rows, and a vector that very many rows share, cost one vector.
2. The coarsest statistics are points, grouped to cells around centres that are fitted
   on ``SAMPLE`` rows (any centres give the same result). Cells that lie together fill
   a block, and a cell of more than ``BLOCK`` vectors is cut over several.
3. Each query searches the block that it is in, which gives its radius: the distance of
   the k-th nearest so far. It then visits the blocks with a cell that may reach into
   its radius, and no others: the distance to the centre, less the cell's own radius,
   bounds the distance to all in it.
4. Within a block, vectors pass the bounds of ``LEVELS``, each over those left by the
   level before. At each level a query takes the exact distances of the vectors with the
   least bounds, which tightens its radius. Survivors get their exact distances.

Nothing within the radius is dropped, so the result is exact (rounding is allowed for).
Vectors are sent to their block once; a query is sent to the blocks that it visits, and
a block with more than ``VISITS`` queries is copied for each so many. All tasks have a
bounded size. Queries times the blocks that they can't rule out is what search costs:
where bounds rule out little, as for vectors without structure, that is quadratic.

Defined results: rows (vec_id, rank, neighbor_id, distance), rank from 1, Euclidean
distance rounded to 6 decimals, ties to the smaller neighbor_id. Queries are rows of the
table, all or those that ``asked`` selects; a vec_id is no neighbour of itself, and if it
has several rows its distance is the smallest over them. Rows without vec_id, and
embeddings that are null, empty, or hold a null, NaN or infinity, take no part. Vectors
meet only those of their own dimension; with fewer than k of them, all are listed. Other
columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

K = 10
#: Vectors of a block, and queries that meet it in one task.
BLOCK = 8192
VISITS = 32_768
#: Rows that centres are fitted on, and centres at most: a broadcast of 2 * LEVELS[0] numbers each.
SAMPLE = 8192
CELLS = 1024
_QUERIES = 256
#: Segments of the levels, coarse to fine.
LEVELS = (4, 16)
_EPS = 1e-9


def summaries(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, weighted so that squared differences sum to the bound."""
    d = x.shape[1]
    edges = np.linspace(0, d, min(segments, d) + 1).astype(int)
    size = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / size
    centred = x - np.repeat(mean, size, axis=1)
    dev = np.sqrt(np.add.reduceat(centred * centred, edges[:-1], axis=1) / size)
    weight = np.sqrt(size)
    return np.concatenate([mean * weight, dev * weight], axis=1)


def _squared(a: np.ndarray, b: np.ndarray, bb: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] + bb - 2 * (a @ b.T)


def _kth(d: np.ndarray, k: int) -> np.ndarray:
    """The k-th least of each row; infinite with fewer."""
    return np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)


def _best(r: np.ndarray, i: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest distinct ids of each row r, ties to the smaller id."""
    order = np.lexsort((d, i, r))
    r, i, d = r[order], i[order], d[order]
    keep = np.concatenate([[True], (r[1:] != r[:-1]) | (i[1:] != i[:-1])]) if len(r) else np.zeros(0, bool)
    r, i, d = r[keep], i[keep], d[keep]
    order = np.lexsort((i, d, r))
    r, i, d = r[order], i[order], d[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], i[keep], d[keep]


@dataclass
class Vectors:
    """Distinct vectors, each with the ids ids[first[j] : first[j + 1]], sorted."""

    x: np.ndarray
    ids: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Vectors:
        lists = table.column("embedding").combine_chunks()
        n = table.num_rows
        x = np.asarray(lists.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 1))
        ids = table.column("ids").combine_chunks()
        first = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(ids)), dtype=np.int64)]) if n else np.zeros(1, np.int64)
        return cls(x, np.asarray(ids.flatten()), first)


def nearest(q: np.ndarray, radius: np.ndarray, c: Vectors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, squared distance) of the k nearest distinct ids within each query's squared
    radius. ``radius`` is tightened in place."""
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(q) and len(c.x):
        # vectors that bring an id each, so that k of them have k distinct ids
        brings = np.zeros(len(c.x), bool)
        brings[np.unique(c.ids[c.first[:-1]], return_index=True)[1]] = True
        levels = [(summaries(q, s), summaries(c.x, s)) for s in LEVELS if s == LEVELS[0] or s < q.shape[1]]
        norms = [(b * b).sum(axis=1) for _, b in levels]
        own_norms = (c.x * c.x).sum(axis=1)
        slack = _EPS * (float((q * q).sum(axis=1).max()) + float(own_norms.max())) + 1e-12
        for at in range(0, len(q), _QUERIES):
            part, limit = q[at : at + _QUERIES], radius[at : at + _QUERIES]
            n = len(part)
            left = np.arange(len(c.x))
            for (a, b), bb in zip(levels, norms, strict=True):
                # the columns that any query of this part has left, and which queries have them
                bound = _squared(a[at : at + n], b[left], bb[left])
                new = np.flatnonzero(brings[left])
                if len(new) > k:
                    near = left[new[np.argpartition(bound[:, new], k - 1, axis=1)[:, :k]]]
                    np.minimum(limit, ((part[:, None, :] - c.x[near]) ** 2).sum(axis=2).max(axis=1), out=limit)
                on = bound <= (limit * (1 + _EPS) + slack)[:, None]
                some = on.any(axis=0)
                left, on = left[some], on[:, some]
            # distances of the survivors, and exactly of those that can be among the k nearest
            d = _squared(part, c.x[left], own_norms[left])
            d[~on] = np.inf
            top = np.minimum(limit, _kth(d[:, brings[left]], k) + slack)
            on &= d <= (top * (1 + _EPS) + 2 * slack)[:, None]
            r, s = np.nonzero(on)
            s = left[s]
            exact = np.zeros(len(r))
            for x in range(0, len(r), 1 << 14):  # in pieces, to bound memory
                y = slice(x, x + (1 << 14))
                exact[y] = ((part[r[y]] - c.x[s[y]]) ** 2).sum(axis=1)
            many = c.first[s + 1] - c.first[s]
            entry = np.repeat(c.first[s], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            r, i, d = _best(np.repeat(r, many), c.ids[entry], np.repeat(exact, many), k)
            last = np.flatnonzero(np.arange(len(r)) - np.searchsorted(r, r) == k - 1)
            limit[r[last]] = np.minimum(limit[r[last]], d[last])
            found.append((r + at, i, d))
    r, i, d = (np.concatenate(x) for x in zip(*found, strict=True))
    return r, i, d


@dataclass
class Cells:
    """The cells of one dimension: centres of coarse statistics, how far each reaches, and its blocks."""

    centre: np.ndarray
    reach: np.ndarray | None = None
    first: np.ndarray | None = None
    parts: np.ndarray | None = None

    def place(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its centre) of each point."""
        cell = np.zeros(len(s), np.int64)
        norm = (self.centre * self.centre).sum(axis=1)
        for at in range(0, len(s), 4096):
            cell[at : at + 4096] = _squared(s[at : at + 4096], self.centre, norm).argmin(axis=1)
        return cell, np.sqrt(((s - self.centre[cell]) ** 2).sum(axis=1))

    def visits(self, s: np.ndarray, radius: np.ndarray, home: int) -> list[list[int]]:
        """The blocks besides home that may hold a vector within the squared radius of each point."""
        live = np.flatnonzero(self.parts > 0)
        centre, out = self.centre[live], []
        norm = (centre * centre).sum(axis=1)
        for at in range(0, len(s), 4096):
            d = _squared(s[at : at + 4096], centre, norm)
            # what rounding may have added to a distance
            d = np.sqrt(np.maximum(0, d)) - np.sqrt(_EPS * (np.abs(d) + norm)) - self.reach[live] * (1 + _EPS)
            on = np.maximum(0, d) ** 2 <= radius[at : at + 4096, None] * (1 + _EPS) + 1e-12
            for row in on:
                blocks = {b for j in live[row] for b in range(self.first[j], self.first[j] + self.parts[j])}
                out.append(sorted(blocks - {home}))
        return out


def _centres(s: np.ndarray) -> np.ndarray:
    """Centres of a sample, in an order in which neighbours are near."""
    n = min(CELLS, max(1, len(s) // 8))
    points = np.unique(s, axis=0)
    centre = points[np.random.default_rng(0).permutation(len(points))[:n]]
    for _ in range(4):
        cell, _ = Cells(centre).place(points)
        size = np.bincount(cell, minlength=len(centre))
        total = np.stack([np.bincount(cell, weights=x, minlength=len(centre)) for x in points.T], axis=1)
        centre = np.where(size[:, None] > 0, total / np.maximum(1, size)[:, None], centre)
    return _in_order(centre)


def _in_order(x: np.ndarray) -> np.ndarray:
    """The points halved again and again along their widest side."""
    if len(x) <= 2:
        return x
    x = x[np.argsort(x[:, np.ptp(x, axis=0).argmax()], kind="stable")]
    half = len(x) // 2
    return np.concatenate([_in_order(x[:half]), _in_order(x[half:])])


def _place(cells):
    def run(batches):
        for batch in batches:
            lists = batch.column("embedding")
            dims = np.asarray(pc.list_value_length(lists))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                s = summaries(np.asarray(part.column("embedding").flatten(), np.float64).reshape(-1, dim), LEVELS[0])
                c = cells.value.get(dim) or Cells(np.zeros((1, s.shape[1])))
                cell, away = c.place(s)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.full(len(s), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(away)], names=[*part.schema.names, "dim", "cell", "away"]
                )

    return run


def _summed(batches):
    for batch in batches:
        dims = np.asarray(pc.list_value_length(batch.column("embedding")))
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            s = summaries(np.asarray(part.column("embedding").flatten(), np.float64).reshape(-1, dim), LEVELS[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), dim, np.int32)), pa.array(list(s), pa.list_(pa.float64()))], names=["dim", "s"])


_HOME = "uid long, embedding array<double>, radius double, neighbors array<long>, ds array<double>, visits array<int>"


def _home(k: int, cells):
    """A row a query of the block: the nearest of the block, and which blocks to visit."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block, dim = key[0].as_py(), table.column("dim")[0].as_py()
        asked = table.filter(table.column("asked"))
        v, q = Vectors.of(table), Vectors.of(asked).x
        radius = np.full(len(q), np.inf)
        r, i, d = nearest(q, radius, v, k)
        off = pa.array(np.searchsorted(r, np.arange(len(q) + 1)).astype(np.int32))
        visits = cells.value[dim].visits(summaries(q, LEVELS[0]), radius, block) if len(q) else []
        return pa.table(
            {
                "uid": asked.column("uid"),
                "embedding": asked.column("embedding"),
                "radius": pa.array(radius),
                "neighbors": pa.ListArray.from_arrays(off, pa.array(i)),
                "ds": pa.ListArray.from_arrays(off, pa.array(d)),
                "visits": pa.array(visits, pa.list_(pa.int32())),
            }
        )

    return run


def _visit(k: int):
    def run(queries: pa.Table, table: pa.Table) -> pa.Table:
        n = queries.num_rows
        q = np.asarray(queries.column("embedding").combine_chunks().flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 1))
        r, i, d = nearest(q, np.asarray(queries.column("radius"), np.float64).copy(), Vectors.of(table), k) if n else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"uid": np.asarray(queries.column("uid"))[r] if n else np.zeros(0, np.int64), "neighbor_id": i, "d": d})

    return run


def _blocks(stats: list, cells: dict[int, Cells]) -> int:
    """Fills in reach and blocks of all cells from rows (dim, cell, n, reach); the number of blocks."""
    block = 0
    for dim in sorted({r.dim for r in stats}):
        own = {r.cell: r for r in stats if r.dim == dim}
        c = cells.setdefault(dim, Cells(np.zeros((1, len(summaries(np.zeros((1, dim)), LEVELS[0])[0])))))
        m = len(c.centre)
        c.reach, c.first, c.parts = np.zeros(m), np.zeros(m, np.int64), np.zeros(m, np.int64)
        held = 0
        for j in sorted(own):
            n = own[j].n
            c.reach[j], c.parts[j] = own[j].reach, -(-n // BLOCK)
            if held and (c.parts[j] > 1 or held + n > BLOCK):
                block, held = block + 1, 0
            c.first[j] = block
            if c.parts[j] > 1:
                block += int(c.parts[j])
            else:
                held += n
        block += held > 0
    return block


def search(vectors: DataFrame, k: int = K, asked: Column | None = None) -> DataFrame:
    """``asked`` is a condition on vec_id that queries fulfil; all rows are queries without one."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad)
    # -0.0 equals 0.0
    v = v.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    sample: dict[int, list] = {}
    # SAMPLE rows of 2 * LEVELS[0] numbers
    for r in v.orderBy(F.xxhash64("embedding"), "vec_id").limit(SAMPLE).select("embedding").mapInArrow(_summed, "dim int, s array<double>").collect():
        sample.setdefault(r.dim, []).append(r.s)
    cells = {dim: Cells(_centres(np.array(s))) for dim, s in sample.items()}

    rows = v.groupBy("embedding", "vec_id").agg(F.lit(1).alias("one"))
    small = rows.withColumn("place", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    units = small.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    queries = (v if asked is None else v.filter(asked)).select("vec_id", "embedding").distinct()
    if asked is None:
        units = units.withColumn("asked", F.lit(True))
    else:
        wanted = queries.select(F.col("embedding").alias("e")).distinct()
        units = units.join(wanted, F.col("embedding") == F.col("e"), "left").select("embedding", "ids", F.col("e").isNotNull().alias("asked"))
    units = units.withColumn("uid", F.monotonically_increasing_id())
    units = scratch.save(units.mapInArrow(_place(sc.broadcast(dict(cells))), "embedding array<double>, ids array<long>, asked boolean, uid long, dim int, cell int, away double"), "topk-units")

    # a row a cell: CELLS at most for each dimension
    stats = units.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("reach")).collect()
    blocks = _blocks(stats, cells)
    if not blocks:
        return spark.createDataFrame([], "vec_id long, rank int, neighbor_id long, distance double")
    table = spark.createDataFrame([(dim, j, int(c.first[j]), int(c.parts[j])) for dim, c in cells.items() if c.parts is not None for j in range(len(c.parts)) if c.parts[j]], "d int, c int, first int, parts int")
    placed = units.join(F.broadcast(table), (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("c")))
    placed = placed.select("uid", "embedding", "ids", "asked", "dim", (F.col("first") + F.pmod(F.xxhash64("uid"), "parts")).cast("int").alias("block"))
    tasks = max(sc.defaultParallelism, min(3 * blocks, 20_000))
    home = scratch.save(placed.repartition(tasks, "block").groupBy("block").applyInArrow(_home(k + 1, sc.broadcast(cells)), _HOME), "topk-home")

    visits = home.select("uid", "embedding", "radius", F.explode("visits").alias("block"))
    # a row a block that more than VISITS queries visit
    busy = visits.groupBy("block").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("copies")).filter("copies > 1").select(F.col("block").alias("b"), "copies")
    visits = visits.join(F.broadcast(busy), F.col("block") == F.col("b"), "left").withColumn("copy", F.pmod(F.xxhash64("uid"), F.coalesce("copies", F.lit(1))).cast("int"))
    copied = placed.join(F.broadcast(busy), F.col("block") == F.col("b"), "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
    spread = lambda t, *columns: t.select("block", "copy", *columns).repartition(tasks, "block", "copy").groupBy("block", "copy")
    met = spread(visits, "uid", "embedding", "radius").cogroup(spread(copied, "embedding", "ids")).applyInArrow(_visit(k + 1), "uid long, neighbor_id long, d double")
    own = home.select("uid", F.explode(F.arrays_zip("neighbors", "ds")).alias("x")).select("uid", F.col("x.neighbors").alias("neighbor_id"), F.col("x.ds").alias("d"))
    found = own.unionAll(met).groupBy("uid", "neighbor_id").agg(F.min("d").alias("d"))
    order = lambda key: F.row_number().over(Window.partitionBy(key).orderBy("d", "neighbor_id"))
    found = found.withColumn("place", order("uid")).filter(F.col("place") <= k + 1).select(F.col("uid").alias("u"), "neighbor_id", "d")

    # from distinct vectors to the rows that asked
    who = queries.join(units.filter("asked").select("uid", F.col("embedding").alias("e")), F.col("embedding") == F.col("e")).select("vec_id", "uid")
    result = who.join(found, F.col("uid") == F.col("u")).filter("vec_id <> neighbor_id").groupBy("vec_id", "neighbor_id").agg(F.min("d").alias("d"))
    return result.withColumn("rank", order("vec_id")).filter(F.col("rank") <= k).select("vec_id", "rank", "neighbor_id", F.round(F.sqrt("d"), 6).alias("distance"))
