"""Exact top-k search by inner product as a Voronoi join.

Vectors belong to the cell of their nearest pivot and, within it, to a band by how far they stand off the pivot's
direction. Summaries of cells and bands give for every query a score that its k best surely reach, and the highest score
that any member of a band can have. A band is replicated only to the groups of queries of which one may need it. Groups
that need the same bands are merged, so where bounds exclude nothing the data is sent once per block of queries and not
once per cell. Blocks are solved locally, and the local lists are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import written

PIVOTS = 64
BANDS = 8
QUERY_BLOCK = 1000  # queries and
DATA_BLOCK = 20_000  # data rows that meet in one task, about
MOVED = 60  # sending a row costs about as much as this many products
LARGEST = (1 << 63) - 1


def quantised(rows: DataFrame) -> DataFrame:
    """vec_id, v: floor(256 x) of every component; vectors that are null or hold null or non-finite components, and rows without id, take no part.

    Shorter vectors are filled up with zeros.
    """
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    whole = rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad).select(
        F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(F.lit(256.0) * e.cast("double")).cast("long")).alias("v"))
    return whole


def _matrix(column: pa.ChunkedArray | pa.Array, kind=np.float64) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(a), -1)


def _off(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(along, off): each row's part along each pivot's direction, and the length of the rest."""
    length = np.linalg.norm(pivots, axis=1)
    along = x @ (pivots / np.where(length > 0, length, 1)[:, None]).T
    return along, np.sqrt(np.maximum((x * x).sum(1)[:, None] - along * along, 0))


def _assign(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """points with their cell, and the parts of them along and off its pivot; ties go to the first pivot."""
    half = (pivots * pivots).sum(1) / 2
    kind = points.schema["v"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                cell = (x @ pivots.T - half).argmax(1)  # the nearest
                along, off = _off(x, pivots)
                row = np.arange(len(x))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(along[row, cell]), pa.array(off[row, cell])], names=["vec_id", "v", "cell", "along", "off"])

    return points.select("vec_id", "v").mapInArrow(run, f"vec_id bigint, v {kind}, cell int, along double, off double")


class Summary:
    """What is known of cells and bands: pivots; per band its cell, rows, greatest and least part along, greatest part off; members near to pivots."""

    def __init__(self, pivots: np.ndarray, bands: list[tuple], near: list[tuple]):
        self.pivots = pivots
        self.cell, self.band, self.rows = (np.array([b[i] for b in bands], np.int64) for i in range(3))
        self.most, self.least, self.off = (np.array([b[i] for b in bands], float) for i in range(3, 6))
        self.near_cell, self.near_id = (np.array([n[i] for n in near], np.int64) for i in (0, 1))
        self.near_along, self.near_off = (np.array([n[i] for n in near], float) for i in (2, 3))

    def needed(self, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """For each query and band, whether one of the query's k best may be there.

        With u the query's part along a pivot and w its part off it, a member's score is at most along u + off w and at
        least along u - off w. Rows of the query's own id are no candidates and give no bound.
        """
        u, w = _off(q, self.pivots)
        sure = self.near_along * u[:, self.near_cell] - self.near_off * w[:, self.near_cell]
        sure[ids[:, None] == self.near_id] = -np.inf
        floor = np.partition(sure, sure.shape[1] - k, axis=1)[:, -k] if sure.shape[1] >= k else np.full(len(q), -np.inf)
        mine = u[:, self.cell]
        best = np.maximum(self.most * mine, self.least * mine) + self.off * w[:, self.cell]
        slack = 1e-9 * (1 + np.abs(best).max(1, initial=0, keepdims=True) + np.where(np.isfinite(floor), np.abs(floor), 0)[:, None])
        return best >= floor[:, None] - slack


def _wanted(queries: DataFrame, summary: Summary, k: int) -> list[tuple[int, int]]:
    """(cell of the queries, band) where one of the cell's queries needs the band; as many rows as cells times bands at most."""

    def run(batches):
        for batch in batches:
            cells = batch.column(2).to_numpy()
            need = summary.needed(batch.column(0).to_numpy(), _matrix(batch.column(1)), k) if len(cells) else None
            for c in np.unique(cells):
                at = np.flatnonzero(need[cells == c].any(0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(at.astype(np.int32))], names=["cell", "at"])

    return [(r["cell"], r["at"]) for r in queries.select("vec_id", "v", "cell").mapInArrow(run, "cell int, at int").distinct().collect()]


def merged_groups(need: dict[int, np.ndarray], queries: dict[int, int], rows: np.ndarray, limit: int = QUERY_BLOCK) -> list[tuple[list[int], np.ndarray]]:
    """(cells of queries, bands they need): two groups become one while that saves more in rows sent than it adds in products."""
    groups = [([c], need[c], queries[c]) for c in sorted(need)]
    cost = lambda n, q: n * (MOVED + q)
    while len(groups) > 1:
        size = [int(rows[g[1]].sum()) for g in groups]
        best = None
        for i, (_, a, qa) in enumerate(groups):
            for j in range(i + 1, len(groups)):
                _, b, qb = groups[j]
                if qa + qb <= limit:
                    gain = cost(size[i], qa) + cost(size[j], qb) - cost(int(rows[a | b].sum()), qa + qb)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, i, j)
        if best is None:
            break
        _, i, j = best
        (ca, a, qa), (cb, b, qb) = groups[i], groups[j]
        groups = [g for n, g in enumerate(groups) if n not in (i, j)] + [(ca + cb, a | b, qa + qb)]
    return [(c, n) for c, n, _ in groups]


def _solve(k: int, exact: bool):
    """Local search of one block: its queries against its data rows; ties go to the smaller id."""

    def run(block: pa.Table) -> pa.Table:
        kind = np.float64 if exact else object
        is_query = block.column("is_query").to_numpy()
        ids, v = block.column("vec_id").to_numpy(), _matrix(block.column("v"), kind)
        q_id, q = ids[is_query], v[is_query]
        order = np.argsort(ids[~is_query], kind="stable")
        d_id, d = ids[~is_query][order], v[~is_query][order]
        found = []
        for a in range(0, len(q_id), 128):
            score = q[a : a + 128] @ d.T
            lo, hi = np.searchsorted(d_id, q_id[a : a + 128], "left"), np.searchsorted(d_id, q_id[a : a + 128], "right")
            for row, query, l, h in zip(score, q_id[a : a + 128], lo, hi, strict=True):
                if h > l:
                    row[l:h] = -np.inf if exact else -(1 << 200)  # the query's own row
                if len(row) > k:
                    least = np.partition(row, len(row) - k)[len(row) - k] if exact else sorted(row)[-k]
                    spot = np.flatnonzero(row >= least)
                else:
                    spot = np.arange(len(row))
                spot = spot[(spot < l) | (spot >= h)]
                spot = spot[np.argsort(-row[spot], kind="stable")][:k]
                found += [(query, d_id[s], max(-LARGEST, min(LARGEST, int(row[s])))) for s in spot]
        return pa.table({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    return run


def _lookup(by: dict[int, list], kind: str, place: Column) -> Column:
    """by[place] as a column, empty where there is none."""
    most = max(by, default=-1) + 1
    lists = [by.get(j, []) for j in range(most)] or [[]]
    text = "array(" + ", ".join(f"from_json('{x}', 'array<{kind}>')" for x in map(str, lists)) + ")"
    return F.coalesce(F.try_element_at(F.expr(text), place + 1), F.array().cast(f"array<{kind}>"))


class _Join:
    """The join worked out: cells and queries as tables, groups of queries with the bands they need."""

    def __init__(self, rows: DataFrame, every: int, k: int, pivots: int):
        raw = written(quantised(rows), "vectors")
        self.dim, self.top = raw.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
        self.groups: list[tuple[list[int], np.ndarray]] = []
        if self.dim is None:
            return
        dim = self.dim
        narrow = "array<smallint>" if (self.top or 0) < 2**15 else "array<int>" if self.top < 2**31 else "array<bigint>"
        filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v")))
        v = F.when(F.size("v") < dim, filled).otherwise(F.col("v")) if dim else F.array(F.lit(0).cast("long"))
        points = raw.select("vec_id", v.cast(narrow).alias("v"))
        chosen = points.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).collect()  # of fixed number
        centre = np.unique(np.array([r["v"] for r in chosen], float), axis=0)
        placed = written(_assign(points, centre), "cells")
        wide = placed.agg(F.max("off")).first()[0] or 1.0
        self.cells = placed.withColumn("band", F.least(F.floor(F.col("off") / F.lit(wide) * BANDS), F.lit(BANDS - 1)).cast("int"))
        least = placed.where(F.pmod("vec_id", F.lit(every)) == 0)
        self.queries = written(least.groupBy("vec_id").agg(F.min(F.struct("v", "cell")).alias("s")).select("vec_id", "s.*"), "queries")
        # a row per cell and band, and k + 1 per cell, reach the driver
        bands = [tuple(r) for r in self.cells.groupBy("cell", "band").agg(F.count("*").alias("n"), F.max("along"), F.min("along"), F.max("off")).orderBy("cell", "band").collect()]
        close = placed.select("cell", "vec_id", "along", "off", F.expr("row_number() over (partition by cell order by off - along, vec_id)").alias("place")).where(F.col("place") <= k + 1)
        self.summary = Summary(centre, bands, [(r["cell"], r["vec_id"], r["along"], r["off"]) for r in close.collect()])
        self.many = {r["cell"]: r["n"] for r in self.queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        need = {c: np.zeros(len(bands), bool) for c in self.many}
        for c, at in _wanted(self.queries, self.summary, k):
            need[c][at] = True
        self.groups = merged_groups(need, self.many, self.summary.rows)

    def replication(self) -> float:
        """Rows sent to groups, of all rows."""
        return sum(int(self.summary.rows[n].sum()) for _, n in self.groups) / max(int(self.summary.rows.sum()), 1) if self.groups else 0.0


def replication(rows: DataFrame, every: int = 50, k: int = 5, pivots: int = PIVOTS) -> float:
    """How many times a row is sent on average, before blocks of queries are counted; groups of queries are the most it can be."""
    return _Join(rows, every, k, pivots).replication()


def top_k(rows: DataFrame, every: int = 50, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the highest integer inner product for each query, a row whose id every divides.

    A row with the query's own id is no candidate. Rows of a repeated id are candidates of their own; as a query, the id
    counts once, with its least vector. Equal scores are ranked by smaller id. Vectors of any size are exact; a score
    that passes the range of a long stays at its end. No queries or no vectors give an empty table.
    """
    join = _Join(rows, every, k, pivots)
    if not join.groups:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    to_query, to_data = {}, {}
    for g, (cells, bands) in enumerate(join.groups):
        q_parts = -(-sum(join.many[c] for c in cells) // QUERY_BLOCK)
        d_parts = max(1, -(-int(join.summary.rows[bands].sum()) // DATA_BLOCK))
        for c in cells:
            to_query[c] = [g, q_parts, d_parts]
        for at in np.flatnonzero(bands):
            to_data.setdefault(int(join.summary.cell[at] * BANDS + join.summary.band[at]), []).append([g, q_parts, d_parts])
    part = lambda n: F.pmod(F.xxhash64("vec_id", "v"), n)
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    w = F.col("w")
    sent_queries = join.queries.withColumn("w", _lookup(to_query, "bigint", F.col("cell"))).select(
        w[0].alias("g"), part(w[1]).alias("a"), to(w[2]).alias("b"), F.lit(True).alias("is_query"), "vec_id", "v")
    sent_data = join.cells.withColumn("w", F.explode(_lookup(to_data, "array<bigint>", F.col("cell") * BANDS + F.col("band")))).select(
        w[0].alias("g"), to(w[1]).alias("a"), part(w[2]).alias("b"), F.lit(False).alias("is_query"), "vec_id", "v")
    exact = float(join.top or 0) ** 2 * max(join.dim, 1) < 2**53
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("query_id", "vec_id", "score")])
    found = sent_queries.unionByName(sent_data).groupBy("g", "a", "b").applyInArrow(_solve(k, exact), schema)
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
