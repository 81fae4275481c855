"""Nearest neighbours by a block matrix join.

Rows are dealt to cells, and every query row goes to every cell. A task holds one
cell's rows and lets the query rows pass in blocks: products of int8 codes give all
distances of a tile at once, with a bound on what the codes lose. Pairs whose lower
bound is not beyond the query's k-th upper bound are computed from the vectors
themselves and kept in a heap; the cells' heaps are merged at the end."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haggle.llm.vectors import finite_vectors, matrix, n_cells, runs, stored

#: Query rows and cell rows of one tile.
TILE = 512, 4096

#: Elements of a cell at most: 320 MB of single precision vectors with their codes.
CELL_ELEMENTS = 1 << 26

#: Pairs computed at once.
PAIRS = 1 << 15

FOUND = "query_id bigint, vec_id bigint, score double"


class Coded:
    """A block of vectors with int8 codes: vec is about step * code, and off by `err` at most.

    `square` is the squared length of step * code; both allow for rounding."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray):
        self.ids, self.vecs = ids, vecs
        wide = vecs.astype(np.float64)
        self.step = np.abs(wide).max(axis=1) / 127
        with np.errstate(all="ignore"):
            codes = np.nan_to_num(np.rint(wide / self.step[:, None]), posinf=0, neginf=0)
            self.codes = np.clip(codes, -127, 127).astype(np.int8)
            near = self.step[:, None] * self.codes
            self.square = (near * near).sum(axis=1)
            self.err = np.sqrt(((wide - near) ** 2).sum(axis=1)) * (1 + 1e-9)

    def products(self, other: Coded) -> np.ndarray:
        """All products of codes, exact: single precision holds them up to 2^24."""
        kind = np.float32 if self.codes.shape[1] * 127 * 127 < 1 << 24 else np.float64
        return self.codes.astype(kind) @ other.codes.astype(kind).T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of a and b in double precision, squares added in order of the components."""
    gap = np.ascontiguousarray((a.astype(np.float64) - b.astype(np.float64)).T)
    total = np.zeros(len(a))
    with np.errstate(over="ignore"):
        for component in gap * gap:  # one after another, however many pairs there are
            total += component
    return np.sqrt(total)


class Search:
    """The k nearest of the rows seen so far, for a block of queries."""

    def __init__(self, queries: Coded, k: int):
        self.q, self.k = queries, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in queries.ids]
        self.far = np.full(len(queries.ids), np.inf)

    def see(self, rows: Coded) -> None:
        q = self.q
        with np.errstate(all="ignore"):
            size = q.square[:, None] + rows.square[None, :]
            square = size - 2 * q.step[:, None] * rows.step[None, :] * q.products(rows)
            slack, err = 1e-12 * size, q.err[:, None] + rows.err[None, :]
            own = q.ids[:, None] == rows.ids[None, :]
            limit = self.far.copy()
            empty = np.flatnonzero(np.isinf(limit))
            if len(empty) and len(rows.ids) > self.k:
                upper = np.sqrt(np.maximum(square[empty], 0) + slack[empty]) + err[empty]
                upper[own[empty] | np.isnan(upper)] = np.inf
                limit[empty] = np.partition(upper, self.k - 1, axis=1)[:, self.k - 1] * (1 + 1e-9)
            # not (lower > limit), so that what cannot be compared is computed
            beyond = square - slack > ((limit[:, None] + err) * (1 + 1e-9)) ** 2
        at, of = np.nonzero(~beyond & ~own)
        for i in range(0, len(at), PAIRS):
            self._keep(at[i : i + PAIRS], of[i : i + PAIRS], rows)

    def _keep(self, at: np.ndarray, of: np.ndarray, rows: Coded) -> None:
        d = distances(self.q.vecs[at], rows.vecs[of])
        near = d <= self.far[at]
        for i, x, v in zip(at[near].tolist(), d[near].tolist(), rows.ids[of[near]].tolist()):
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (-x, -v))
            elif (-x, -v) > heap[0]:
                heapq.heapreplace(heap, (-x, -v))
            if len(heap) == self.k:
                self.far[i] = -heap[0][0]

    def found(self) -> pa.RecordBatch:
        rows = [(int(q), -v, -x) for q, heap in zip(self.q.ids, self.heaps) for x, v in heap]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                           pa.array([r[2] for r in rows], pa.float64())], ["query_id", "vec_id", "score"])


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for (cell, dim, asks), part in runs(batches, "cell", "dim", "asks"):
            if at != (cell, dim):
                at, held = (cell, dim), []
            ids, vecs = part.column("id").to_numpy(), matrix(part, "vec", dim)
            size = TILE[asks == 0]
            for i in range(0, len(ids), size):
                block = Coded(ids[i : i + size], vecs[i : i + size])
                if not asks:
                    held.append(block)
                    continue
                search = Search(block, k)
                for rows in held:
                    search.see(rows)
                yield search.found()

    return run


def _merge(k: int):
    """The k least (score, vec_id) of each query, from rows that stand together by query."""

    def ranked(query: int, heap: list[tuple[float, int]]) -> list[tuple]:
        return [(query, i + 1, v, d) for i, (d, v) in enumerate(heapq.nsmallest(k, heap))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heap = None, []
        for batch in batches:
            out: list[tuple] = []
            for q, v, d in zip(*(batch.column(c).to_pylist() for c in ("query_id", "vec_id", "score"))):
                if q != at:
                    out += ranked(at, heap)
                    at, heap = q, []
                heap.append((d, v))
            yield _rows(out)
        yield _rows(ranked(at, heap))

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def nearest(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k rows nearest to each query row by Euclidean
    distance, exactly: nothing is sampled, every row is compared or shown to be too far.

    `is_query` is a condition on `id`. A query's own id is no candidate; of equal
    distances the smaller id comes first; with fewer candidates all of them return.
    Rows with a null id, and vectors that are null, empty, zero or hold null, infinite
    or not-a-number components take no part. Of rows with one id the least vector
    counts. Vectors of different length have no distance and do not meet. Long vectors
    make smaller cells. Other columns are not read; no rows, no result.

    Only the first k + 1 ids of a vector that many rows share can be in any answer;
    the rest leave before the join, in each task first, so a very common vector
    neither fills a cell nor a heap.
    """
    some = F.exists("vec", lambda x: x != 0)
    held = stored(finite_vectors(rows, id_col, vec_col).where(some), "vectors")
    size = held.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dim"), F.lit(0)).alias("elements")).first()
    cells = n_cells(size["n"], size["elements"], CELL_ELEMENTS)
    twins = Window.partitionBy("vec").orderBy("id")
    first = held.withColumn("nth", F.row_number().over(twins)).where(F.col("nth") <= k + 1).drop("nth")
    candidates = first.withColumns({"cell": F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int"), "asks": F.lit(0)})
    asking = held.where(is_query).withColumns({"cell": F.explode(F.sequence(F.lit(0), F.lit(cells - 1))), "asks": F.lit(1)})
    met = candidates.unionByName(asking).repartition(cells, "cell").sortWithinPartitions("cell", "dim", "asks")
    found = met.select("cell", "dim", "asks", "id", "vec").mapInArrow(_tiles(k), FOUND)
    together = found.repartition("query_id").sortWithinPartitions("query_id")
    return together.mapInArrow(_merge(k), "query_id bigint, rank int, vec_id bigint, score double")
