"""Exact top-k search by inner product over a pivot-distance index.

Inner product becomes distance: with a last component sqrt(M - |x|^2) for candidates (M the largest |x|^2) and 0 for
queries, |q - x|^2 = |q|^2 + M - 2 q.x, so the largest product is the nearest vector. Every candidate is keyed by its
nearest pivot and its distance to it, in rings (annuli) of distance. By the triangle inequality a ring [lo, hi] of pivot
p holds nothing nearer to q than max(lo - d(q, p), d(q, p) - hi, 0).

A query expands rings in the order of that bound: the nearest rings, until they hold enough rows, give a first k-th
score; then all rings whose bound does not exceed the distance of that score are searched, and no others. Bounds are taken with
slack for rounding, scores are exact integers. Rings are cut into blocks of bounded size, so that none is a single task.

Neighbouring blocks lie on a shelf. A query is sent once to each shelf that holds a block it has to search, whatever their number, and meets
the shelf in a cogroup, which Spark never broadcasts: a join of queries that were repeated for each block was taken for as small as the queries.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import map_batches, sampled, ship
from tallyloom.session import written

#: vectors that the pivots are fitted on, at most about
FIT_ROWS = 4096
PIVOTS = 48
RINGS = 12
BLOCK_ROWS = 2048
#: bytes of vectors on a shelf, and of the queries that meet it in one group; at least so many shelves where there are blocks enough
SHELF_BYTES, SHELVES = 8 << 20, 48
LEAST = np.iinfo(np.int64).min
#: queries that are scored at once, and tasks of a search at most
TILE_ROWS, MOST_TASKS = 1024, 2048
#: rows that the first rings of a query hold at least, as a multiple of k
FIRST_ROWS = 64


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component. Rows without id, and vectors that are null or hold null or non-finite components, are left out."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v")
    )


@dataclass(frozen=True)
class Space:
    """Pivots (with their last component), ring edges per pivot, and what bounds the data."""

    dim: int
    kind: str  # the shortest type that holds every component
    largest: int  # M
    pivots: np.ndarray
    edges: np.ndarray

    def width(self) -> int:
        return self.dim * np.dtype(self.kind).itemsize

    def matrix(self, packed: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(packed), self.kind).reshape(len(packed), self.dim)

    def slack(self) -> float:
        """What rounding can add to a distance: squares lose a few units of the last place of M for each component, and a small distance is the root of that."""
        return 4 * math.sqrt(16 * (self.dim + 8) * np.finfo(np.float64).eps * self.largest)

    def distances(self, v: np.ndarray, query: bool) -> np.ndarray:
        x = v.astype(np.float64)
        norm = (x * x).sum(axis=1)
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.largest - norm, 0))
        p = self.pivots
        square = (norm + last**2)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * (x @ p[:, :-1].T + np.outer(last, p[:, -1]))
        return np.sqrt(np.maximum(square, 0))


def fit(sample: np.ndarray, dim: int, kind: str, largest: int, pivots: int = PIVOTS, rings: int = RINGS, rounds: int = 6) -> Space:
    """Pivots by a few rounds of k-means from evenly spread rows; edges are quantiles of distance per pivot."""
    x = sample.astype(np.float64)
    x = np.c_[x, np.sqrt(np.maximum(largest - (x * x).sum(axis=1), 0))]
    if not len(x):
        x = np.zeros((1, dim + 1))
    x = np.unique(x, axis=0)
    centres = x[np.linspace(0, len(x) - 1, min(pivots, len(x))).astype(int)]
    for _ in range(rounds):
        owner = ((x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
        centres = np.array([x[owner == i].mean(0) if (owner == i).any() else c for i, c in enumerate(centres)])
    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T, 0))
    owner = d.argmin(1)
    share = np.arange(1, rings) / rings
    edges = np.array([np.quantile(d[owner == i, i] if (owner == i).any() else d[:, i], share) for i in range(len(centres))])
    return Space(dim, kind, largest, centres, edges)


@dataclass(frozen=True)
class Cells:
    """Rings that hold rows: at most pivots x rings, whatever the number of vectors."""

    pivot: np.ndarray
    ring: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def blocks(self) -> np.ndarray:
        return np.maximum(1, -(-self.rows // BLOCK_ROWS))

    def bounds(self, to_pivots: np.ndarray, slack: float) -> np.ndarray:
        """Smallest possible distance of each query to what each ring holds."""
        d = to_pivots[:, self.pivot]
        return np.maximum(np.maximum(self.low - d, d - self.high) - slack, 0)


@dataclass(frozen=True)
class Shelves:
    """Which blocks a query has to search, and how blocks lie on shelves: numbers of bounded size only."""

    space: Space
    cells: Cells
    k: int
    blocks: np.ndarray  # of each ring
    per: int  # blocks on a shelf

    @classmethod
    def of(cls, space: Space, cells: Cells, k: int) -> Shelves:
        blocks = cells.blocks()
        most = SHELF_BYTES // (BLOCK_ROWS * max(1, space.width()))
        return cls(space, cells, k, blocks, int(max(1, min(blocks.sum() // SHELVES, most))))

    def first_blocks(self) -> np.ndarray:
        return np.cumsum(self.blocks) - self.blocks

    def count(self) -> int:
        return max(1, math.ceil(self.blocks.sum() / self.per))

    def wanted(self, x: np.ndarray, floors: np.ndarray | None) -> np.ndarray:
        """Queries by blocks. Without floors: the first block of the nearest rings, until they hold enough rows."""
        bounds = self.cells.bounds(self.space.distances(x, query=True), self.space.slack())
        of_block = np.repeat(np.arange(len(self.blocks)), self.blocks)
        if floors is not None:
            norm = (x.astype(np.float64) ** 2).sum(axis=1) + self.space.largest
            reach = np.where(floors == LEAST, np.inf, norm - 2.0 * floors)
            return (bounds**2 <= (reach + 1e-9 * norm + 1e-6)[:, None])[:, of_block]
        order = np.argsort(bounds, axis=1, kind="stable")
        size = np.minimum(self.cells.rows, BLOCK_ROWS)[order]
        near = np.zeros(bounds.shape, bool)
        np.put_along_axis(near, order, np.cumsum(size, axis=1) - size < FIRST_ROWS * (self.k + 1), axis=1)
        return near[:, of_block] & np.isin(np.arange(len(of_block)), self.first_blocks())

    def best(self, ids: np.ndarray, x: np.ndarray, floors: np.ndarray, blocks: list[tuple], first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of queries, vec_ids and scores: the k best of each query in the blocks it has to search, if not below its floor."""
        wanted, floors = self.wanted(x, None if first else floors), floors.copy()
        at, found, score = (np.zeros(0, np.int64) for _ in range(3))
        for block, others, y in blocks:
            mine = np.flatnonzero(wanted[:, block])
            if not len(mine):
                continue
            p = products(x[mine], y)
            loose = np.flatnonzero(floors[mine] == LEAST)
            if len(loose) and len(others) > self.k:
                theirs = np.where(ids[mine[loose], None] == others, p.dtype.type(LEAST), p[loose])
                floors[mine[loose]] = np.partition(theirs, -self.k, axis=1)[:, -self.k].astype(np.int64)
            i, j = np.divmod(np.flatnonzero(p >= floors[mine].astype(p.dtype)[:, None]), len(others))  # few of very many: nonzero takes four times as long
            other = ids[mine[i]] != others[j]
            i, j = i[other], j[other]
            at, found, score = (np.concatenate(c) for c in ((at, mine[i]), (found, others[j]), (score, p[i, j].astype(np.int64))))
            order = np.lexsort((found, -score, at))
            at, found, score = at[order], found[order], score[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            last = place == self.k - 1
            floors[at[last]] = np.maximum(floors[at[last]], score[last])
            keep = place < self.k
            at, found, score = at[keep], found[keep], score[keep]
        return at, found, score


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products: by floating-point multiplication where no sum can leave the integers that it holds exactly."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * max(q.shape[1], 1)
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return q.astype(kind) @ x.astype(kind).T


def shortest(most: int) -> str:
    """The shortest type of whole numbers from -most - 1 to most."""
    return next(kind for kind in ("int16", "int32", "int64") if most <= np.iinfo(kind).max)


def _packed(df: DataFrame, dim: int, kind: str) -> DataFrame:
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))) if dim else F.col("v")

    def step(batch):
        values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)
        raw, width = values.tobytes(), dim * values.itemsize
        yield {"vec_id": batch.column(0), "x": [raw[i * width : (i + 1) * width] for i in range(batch.num_rows)]}

    return map_batches(df.select("vec_id", padded.alias("v")), step, "vec_id long, x binary")


def _search(queries: DataFrame, parts: int, blocks: DataFrame, shelves: Shelves, first: bool) -> DataFrame:
    """query_id, vec_id, score: the k best of each query (vec_id, x, part, floor) on each shelf it asks for, if not below its floor."""
    count = shelves.count()
    starts = np.arange(count) * shelves.per
    # queries at once: each may go to every shelf
    most = max(1, min(TILE_ROWS // 4, SHELF_BYTES // (count * max(1, shelves.space.width()))))

    def ask(batch):
        for begin in range(0, batch.num_rows, most):
            piece = batch.slice(begin, most)
            floors = pc.fill_null(piece.column(3), LEAST)
            wanted = shelves.wanted(shelves.space.matrix(piece.column(1).to_pylist()), None if first else floors.to_numpy())
            row, shelf = np.nonzero(np.logical_or.reduceat(wanted, starts, axis=1))
            at = pa.array(row)
            yield {"cell": piece.column(2).to_numpy()[row] * count + shelf, "vec_id": piece.column(0).take(at), "x": piece.column(1).take(at), "floor": floors.take(at)}

    def step(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] for _ in range(3)]
        if asked.num_rows and held.num_rows:
            ids, floors, packed = asked["vec_id"].to_numpy(), asked["floor"].to_numpy(), asked["x"].to_pylist()
            shelf = []
            for block, raw, x in zip(*(held[name].to_pylist() for name in ("block", "ids", "xs")), strict=True):
                others = np.frombuffer(raw, np.int64)
                shelf.append((block, others, np.frombuffer(x, shelves.space.kind).reshape(len(others), shelves.space.dim)))
            for begin in range(0, len(ids), TILE_ROWS):
                tile = slice(begin, begin + TILE_ROWS)
                at, found, score = shelves.best(ids[tile], shelves.space.matrix(packed[tile]), floors[tile], shelf, first)
                for column, values in zip(out, (ids[tile][at], found, score), strict=True):
                    column.append(values)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, out), strict=True)))

    tasks = min(parts * count, MOST_TASKS)
    asked = map_batches(queries.select("vec_id", "x", "part", "floor"), ask, "cell long, vec_id long, x binary, floor long")
    if first:
        blocks = blocks.where(F.col("block").isin(shelves.first_blocks().tolist()))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")
    held = blocks.select("*", every).withColumn("cell", F.col("part") * count + F.floor(F.col("block") / shelves.per)).drop("part")
    pairs = asked.repartition(tasks, "cell").groupBy("cell").cogroup(held.repartition(tasks, "cell").groupBy("cell"))
    return pairs.applyInArrow(step, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer products of each query with any other vector.

    ``vectors``: vec_id, embedding; ``is_query`` is a condition on vec_id. Equal scores go to the smaller vec_id. A query
    with fewer than k others gets all of them. Null ids, null vectors and null or non-finite components take no part; short
    vectors count as filled with zeros. Repeated rows count once, and a query is never matched with its own id. Of equal vectors
    the k + 1 smallest ids are indexed: no other can be among the k best of any query. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = quantised(vectors, scale).distinct()
    rows = written(rows, "vectors")
    norm = F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x.cast("decimal(19,0)") * x.cast("decimal(19,0)")).cast("decimal(38,0)"))
    dim, largest, most = rows.agg(F.max(F.size("v")), F.max(norm), F.max(F.greatest(F.array_max("v"), F.bitwise_not(F.array_min("v"))))).first()
    dim, largest, kind = dim or 0, int(largest or 0), shortest(most or 0)
    queries = _packed(rows.where(is_query), dim, kind)
    twins = Window.partitionBy("v").orderBy("vec_id")
    candidates = _packed(rows.withColumn("_n", F.row_number().over(twins)).where(F.col("_n") <= k + 1), dim, kind)
    # by id and vector: one id may have very many vectors
    sample = _packed(sampled(rows.withColumn("_key", F.xxhash64("vec_id", "v")), "_key", FIT_ROWS), dim, kind).toPandas()
    space = fit(np.frombuffer(b"".join(sample["x"]), kind).reshape(len(sample), dim), dim, kind, largest)

    def assign(batch):
        d = space.distances(space.matrix(batch.column(1).to_pylist()), query=False)
        pivot = d.argmin(axis=1)
        near = d[np.arange(len(d)), pivot]
        yield {"vec_id": batch.column(0), "x": batch.column(1), "pivot": pivot, "ring": (near[:, None] > space.edges[pivot]).sum(axis=1), "distance": near}

    index = written(map_batches(candidates, assign, "vec_id long, x binary, pivot int, ring int, distance double"), "index")
    found = index.groupBy("pivot", "ring").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count(F.lit(1)).alias("rows"))
    cell = found.orderBy("pivot", "ring").toPandas()  # pivots x rings rows at most
    cells = Cells(*[cell[n].to_numpy() for n in ("pivot", "ring", "low", "high", "rows")])
    shelves = Shelves.of(space, cells, k)
    pieces, first_block = shelves.blocks, shelves.first_blocks()

    def block_of(batch):
        keys = {(p, r): i for i, (p, r) in enumerate(zip(cells.pivot.tolist(), cells.ring.tolist(), strict=True))}
        at = np.array([keys[x] for x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], np.int64)
        spread = batch.column(4).to_numpy().astype(np.uint64) % pieces[at].astype(np.uint64) if len(at) else at
        yield {"block": first_block[at] + spread.astype(np.int64), "vec_id": batch.column(0), "x": batch.column(1)}

    def as_block(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(int(pdf["block"].iloc[0]), pdf["vec_id"].to_numpy(np.int64).tobytes(), b"".join(pdf["x"]))], columns=["block", "ids", "xs"])

    placed = map_batches(index.select("vec_id", "x", "pivot", "ring", F.xxhash64("vec_id", "x")), block_of, "block long, vec_id long, x binary")
    blocks = written(placed.groupBy("block").applyInPandas(as_block, "block long, ids binary, xs binary"), "blocks")

    parts = max(1, math.ceil(queries.count() * max(1, space.width()) / SHELF_BYTES))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("vec_id", "x"), F.lit(parts)))
    near = _ranked(_search(asked.withColumn("floor", F.lit(None).cast("long")), parts, blocks, shelves, True), k)
    floors = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    everything = _search(asked.join(floors, "vec_id", "left"), parts, blocks, shelves, False)
    return _ranked(everything, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
