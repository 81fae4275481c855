"""Exact nearest training row through a metric index.

Training rows belong to the cell of their nearest pivot and are sorted by their
distance from it, the gap. By the triangle inequality no row of a cell is nearer
to x than |d(x, pivot) - gap|. Each row first looks into its own pivot's cell; that
distance then rules out most other cells by their least and greatest gap, and most
rows of the cells that remain. What is left is compared in full, so the answer is
exact whatever the pivots are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haggle.session import scratch_path

#: Training rows of one task's piece of a cell, and scored rows that share a copy of it.
PIECE_ROWS, ASK_ROWS = 1 << 16, 1 << 16

#: Cells at least and at most, and rows that a cell is meant to have in between.
LEAST_CELLS, MOST_CELLS, CELL_ROWS = 8, 1024, 1 << 15

#: Numbers in all pivots at most (8 MB); the pivots are the only rows that tasks share.
PIVOT_NUMBERS = 1 << 20

#: Training rows compared first, those whose gap is most like the row's own.
FIRST_LOOK = 256

#: Asking rows of one matrix product, held rows of one at most, and numbers in a matrix of vectors at most (8 MB).
ASK_BLOCK, BLOCK_ROWS, MATRIX_NUMBERS = 256, 4096, 1 << 20

#: Room for rounding in bounds.
SLACK = 1e-9


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def padded(vec: Column, dim: int) -> Column:
    """Exactly `dim` numbers: components that are absent, null or not a number count as 0."""
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.coalesce(F.nanvl(F.try_element_at(vec.cast("array<double>"), i), F.lit(0.0)), F.lit(0.0)))


def component_scales(rows: DataFrame, vector: str, dim: int) -> list[float]:
    """Population standard deviation of each component; 1 where it does not vary."""
    parts = rows.select(F.posexplode(padded(F.col(vector), dim)).alias("i", "x"))
    found = {r["i"]: r["s"] for r in parts.groupBy("i").agg(F.stddev_pop("x").alias("s")).collect()}  # one row per component
    return [s if (s := found.get(i) or 0.0) > 1e-9 else 1.0 for i in range(dim)]


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


def _gaps(vecs: np.ndarray, pivots: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Distances of rows from all pivots, computed like any other distance."""
    return np.stack([np.sqrt((((vecs - p) / scale) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _place(pivots: np.ndarray, scale: np.ndarray, filled: np.ndarray | None = None):
    """Each row's nearest pivot, of the filled cells if they are known, and the distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _gaps(_vectors(batch, len(scale)), pivots, scale)
                home = (d if filled is None else np.where(filled, d, np.inf)).argmin(axis=1)
                yield _with(batch, cell=pa.array(home, pa.int32()), gap=pa.array(d[np.arange(len(d)), home], pa.float64()))

    return run


def _others(pivots: np.ndarray, scale: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Rows again for each cell but their own that may hold a row as near as `best`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            d = _gaps(_vectors(batch, len(scale)), pivots, scale)
            best = np.sqrt(batch.column("best").to_numpy())
            bound = np.maximum(low - d, d - high) * (1 - SLACK) - SLACK * d
            bound[np.arange(len(d)), batch.column("cell").to_numpy()] = np.inf
            row, cell = np.nonzero(bound <= best[:, None])
            again = batch.select(["id", "v", "best"]).take(pa.array(row))
            yield _with(again, cell=pa.array(cell, pa.int32()), gap=pa.array(d[row, cell], pa.float64()))

    return run


def _nearest(vecs: np.ndarray, ids: np.ndarray, asks: np.ndarray, scale: np.ndarray, best: np.ndarray, best_id: np.ndarray) -> None:
    """Lower best and best_id of a block of asking rows to the nearest of some held rows.

    One matrix product gives all distances but for rounding, which `room` bounds; only rows that
    may be the nearest within it are compared component by component, and these comparisons decide."""
    centre = vecs.mean(axis=0)
    x, y = (vecs - centre) / scale, (asks - centre) / scale
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    near = yy[:, None] + xx - 2.0 * (y @ x.T)
    room = (32 + 8 * len(scale)) * np.finfo(float).eps * (yy[:, None] + xx)
    bound = np.minimum(best * (1 + SLACK), (near + room).min(axis=1))
    row, col = np.nonzero(~(near - room > bound[:, None]))
    step = max(1, MATRIX_NUMBERS // len(scale))
    for at in range(0, len(row), step):
        r, c = row[at:at + step], col[at:at + step]
        d = (((vecs[c] - asks[r]) / scale) ** 2).sum(axis=1)
        order = np.lexsort((ids[c], d, r))
        r, c, d = r[order], c[order], d[order]
        first = np.append(True, r[1:] != r[:-1])
        r, c, d = r[first], c[first], d[first]
        less = (d < best[r]) | ((d == best[r]) & (ids[c] < best_id[r]))
        best[r[less]], best_id[r[less]] = d[less], ids[c[less]]


def _look(dim: int, scale: np.ndarray):
    """The nearest held row of every asking row of a piece, by squared distance, and how many were compared."""
    block = max(1, min(BLOCK_ROWS, MATRIX_NUMBERS // dim))

    def nearest(asks: np.ndarray, gap: np.ndarray, best: np.ndarray, held: tuple) -> tuple[np.ndarray, np.ndarray, int]:
        gaps, ids, vecs = held
        best, best_id, tested = best.copy(), np.full(len(best), np.iinfo(np.int64).max), 0

        def compare(a: int, b: int) -> None:
            nonlocal tested
            for at in range(a, b, block):
                end = min(b, at + block)
                _nearest(vecs[at:end], ids[at:end], asks, scale, best, best_id)
                tested += end - at

        # the block's rows are sorted by gap, and so are the held ones
        a = max(0, int(np.searchsorted(gaps, gap[0])) - FIRST_LOOK // 2)
        b = min(len(gaps), int(np.searchsorted(gaps, gap[-1])) + FIRST_LOOK // 2)
        compare(a, b)
        room = np.sqrt(best) * (1 + SLACK) + SLACK * gap
        compare(min(a, int(np.searchsorted(gaps, (gap - room).min(), "left"))), a)
        compare(b, max(b, int(np.searchsorted(gaps, (gap + room).max(), "right"))))
        return best, best_id, tested

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in ("cell", "piece", "copy", "asks")], axis=1)
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else []
            out: list[tuple] = []
            for a, b in zip(cuts, [*cuts[1:], len(keys)]):
                run_of, key = batch.slice(a, b - a), tuple(keys[a, :3])
                gaps, ids, vecs = run_of.column("gap").to_numpy(), run_of.column("id").to_numpy(), _vectors(run_of, dim)
                if key != at:
                    at, parts, held = key, [], None
                if keys[a, 3] == 0:
                    parts.append((gaps, ids, vecs))
                elif parts:
                    if held is None:
                        held = tuple(np.concatenate(x) for x in zip(*parts))
                    best = run_of.column("best").to_numpy()
                    for a in range(0, len(ids), ASK_BLOCK):
                        part = slice(a, a + ASK_BLOCK)
                        d, i, n = nearest(vecs[part], gaps[part], best[part], held)
                        out.append((ids[part], d, i, np.full(len(d), n)))
            kinds = {"id": pa.int64(), "distance": pa.float64(), "nearest_id": pa.int64(), "tested": pa.int64()}
            cols = [np.concatenate(x) for x in zip(*out)] if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds.values())], list(kinds))

    return run


def _visit(held: DataFrame, pieces: DataFrame, asking: DataFrame, dim: int, scale: np.ndarray) -> DataFrame:
    """Every asking row meets every piece of the cell it names. A cell with many rows has
    several pieces; one that many rows ask has several copies of each, so neither side gathers."""
    asking = _written(asking, "asking")
    asked = asking.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ASK_ROWS).cast("int").alias("copies"))
    plan = pieces.join(F.broadcast(asked), "cell").select("cell", "pieces", "copies")  # a row per cell, MOST_CELLS at most
    copies = F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    there = held.join(F.broadcast(plan), "cell").withColumn("copy", copies).withColumns(
        {"piece": F.pmod(F.xxhash64("id"), "pieces").cast("int"), "asks": F.lit(0), "best": F.lit(None).cast("double")})
    come = asking.join(F.broadcast(plan), "cell").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumns(
        {"copy": F.pmod(F.xxhash64("id"), "copies").cast("int"), "asks": F.lit(1)})
    order = ["cell", "piece", "copy", "asks", "gap"]
    both = there.select(*order, "id", "v", "best").unionByName(come.select(*order, "id", "v", "best"))
    met = both.repartition("cell", "piece", "copy").sortWithinPartitions(*order)
    return met.mapInArrow(_look(dim, scale), "id bigint, distance double, nearest_id bigint, tested bigint")


def _least(found: DataFrame) -> DataFrame:
    return found.groupBy("id").agg(F.min(F.struct("distance", "nearest_id")).alias("x"), F.sum("tested").alias("tested")).select("id", "x.*", "tested")


def nearest_row(train: DataFrame, rows: DataFrame, vector: str = "vec", cells: int | None = None) -> DataFrame:
    """id, nearest_id, distance and tested: for each of `rows` the training row at the least
    distance, ties to the lower id, and how many training rows it was compared with.

    Components are divided by their population standard deviation over the training
    rows (1 where that is at most 1e-9); absent and null ones count as 0. `distance` is
    squared, as sums of squares decide ties. Training rows without an id take no part; equal vectors are compared
    once. Without training rows nearest_id and distance are null. Both sides have
    unique ids and may be of any size; `cells` sets the number of pivots."""
    usable = train.where("id IS NOT NULL")
    size = usable.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("dim")).first()
    if not size["n"]:
        return rows.select("id", F.lit(None).cast("long").alias("nearest_id"), F.lit(None).cast("double").alias("distance"), F.lit(0).cast("long").alias("tested"))
    dim = max(size["dim"] or 0, 1)
    scale = np.array(component_scales(usable, vector, dim))
    distinct = _written(usable.select("id", padded(F.col(vector), dim).alias("v")).groupBy("v").agg(F.min("id").cast("long").alias("id")), "train").select("id", "v")
    n_cells = cells or max(LEAST_CELLS, min(MOST_CELLS, size["n"] // CELL_ROWS))
    n_cells = max(1, min(n_cells, PIVOT_NUMBERS // dim))
    picked = distinct.orderBy(F.xxhash64("id"), "id").limit(n_cells).collect()  # PIVOT_NUMBERS numbers at most
    pivots = np.array([r["v"] for r in picked])

    placed = "id bigint, v array<double>, cell int, gap double"
    held = _written(distinct.mapInArrow(_place(pivots, scale), placed), "cells")
    stats = held.groupBy("cell").agg(F.min("gap").alias("low"), F.max("gap").alias("high"), F.ceil(F.count(F.lit(1)) / PIECE_ROWS).cast("int").alias("pieces"))
    low, high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for r in stats.collect():  # a row per cell
        low[r["cell"]], high[r["cell"]] = r["low"], r["high"]
    pieces = stats.select("cell", "pieces")

    asked = rows.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), padded(F.col(vector), dim).alias("v"))
    home = _written(asked.mapInArrow(_place(pivots, scale, np.isfinite(low)), placed), "asked")
    first = _written(_least(_visit(held, pieces, home.withColumn("best", F.lit(float("inf"))), dim, scale)), "first")
    more = home.join(first.select("id", F.col("distance").alias("best")), "id").select("id", "v", "best", "cell")
    further = more.mapInArrow(_others(pivots, scale, low, high), "id bigint, v array<double>, best double, cell int, gap double")
    # a visit that finds nothing as near brings the bound itself and the greatest id
    every = first.unionByName(_visit(held, pieces, further, dim, scale))
    return _least(every)


def nearest_target(train: DataFrame, rows: DataFrame, vector: str = "vec", cells: int | None = None) -> DataFrame:
    """nearest_row with p: 0.8 where the nearest training row's target is 1, 0.2 where it is not, 0.5 without training rows."""
    near = nearest_row(train, rows, vector, cells)
    known = train.select(F.col("id").alias("nearest_id"), (F.coalesce(F.col("target"), F.lit(0)) != 0).alias("__hit"))
    p = F.when(F.col("nearest_id").isNull(), 0.5).when(F.col("__hit"), 0.8).otherwise(0.2)
    return near.join(known, "nearest_id", "left").select("id", "nearest_id", "distance", "tested", p.alias("p"))
