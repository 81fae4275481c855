"""Hard negatives by the threshold algorithm.

Rows are dealt to cells. A task holds a cell's rows and, for each dimension, their
order by that component. An anchor reads all orders from the end that its sign
prefers, to the same depth; rows met for the first time are scored in full, as
integers. No row below that depth can score more than the threshold, the anchor's
product with the components just read, so reading stops once the threshold is
strictly below what every window still needs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haggle.llm.vectors import finite_vectors, matrix, n_cells, runs, stored

#: Elements of a cell at most: 256 MB, four bytes each for the component and for its place in the order.
CELL_ELEMENTS = 1 << 25

#: Depth of the first read; each further one is twice as deep.
FIRST_READ = 32

#: Components are multiplied by this and rounded down.
SCALE = 256


class Best:
    """The first k of the scores seen within [low, high], higher first, then smaller id."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def see(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = np.ones(len(ids), bool) if self.low is None else (scores >= self.low) & (scores <= self.high)
        if len(self.ids) == self.k:
            fit &= scores >= self.scores[-1]
        if fit.any():
            s, v = np.append(self.scores, scores[fit]), np.append(self.ids, ids[fit])
            order = np.lexsort((v, -s))[: self.k]
            self.scores, self.ids = s[order], v[order]

    def needs(self, threshold: int) -> bool:
        """Whether a row that scores up to the threshold could still come in; one as high as the last could, by its id."""
        if self.low is not None and threshold < self.low:
            return False
        return len(self.ids) < self.k or threshold >= self.scores[-1]


class Cell:
    """A cell's rows with the order of each component, built when the first anchor asks."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.order: np.ndarray | None = None

    def add(self, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray) -> None:
        # 64-bit components only where 32 bits do not hold them
        small = len(vecs) == 0 or np.abs(vecs).max() < 1 << 31
        self.parts.append((ids, labels, vecs.astype(np.int32) if small else vecs))

    def _settle(self) -> None:
        self.ids, self.labels, self.vecs = (np.concatenate(x) for x in zip(*self.parts))
        self.order = np.argsort(self.vecs, axis=0, kind="stable").astype(np.int32)
        self.most = int(np.abs(self.vecs).max(initial=0))
        self.parts = []

    def scan(self, anchor: np.ndarray, own: int, label: int, same: bool, best: list[Best]) -> None:
        """Let every Best see the rows of the anchor's label, or of all others, that it may need."""
        if self.order is None:
            self._settle()
        n, dim = self.vecs.shape
        # doubles hold sums of products up to 2^53 exactly
        kind = np.float64 if self.most * int(np.abs(anchor).max()) * dim < 1 << 53 else np.int64
        weight = anchor.astype(kind)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if len(up) + len(down) == 0:
            up = np.array([0])  # all rows score 0; any one order meets them all
        seen = np.zeros(n, bool)
        depth, read = 0, FIRST_READ
        while depth < n:
            to = min(n, depth + read)
            met = np.concatenate((self.order[n - to : n - depth][:, up].ravel(), self.order[depth:to][:, down].ravel()))
            met = np.unique(met[~seen[met]])
            seen[met] = True
            fit = met[((self.labels[met] == label) == same) & (self.ids[met] != own)]
            if len(fit):
                scores = (self.vecs[fit].astype(kind) @ weight).astype(np.int64)
                for b in best:
                    b.see(scores, self.ids[fit])
            last = np.concatenate((self.vecs[self.order[n - to, up], up], self.vecs[self.order[to - 1, down], down])).astype(np.int64)
            threshold = int(last @ anchor[np.concatenate((up, down))])
            if not any(b.needs(threshold) for b in best):
                return
            depth, read = to, 2 * read


def _positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, Cell()
        for (label, no, dim, asks), part in runs(batches, "label", "cell", "dim", "asks"):
            if at != (label, no, dim):
                at, cell = (label, no, dim), Cell()
            ids, vecs = part.column("id").to_numpy(), matrix(part, "ints", dim)
            if not asks:
                cell.add(ids, np.full(len(ids), label), vecs)
            elif cell.parts or cell.order is not None:
                out = []
                for a, v in zip(ids.tolist(), vecs):
                    best = Best(k)
                    cell.scan(v, a, label, True, [best])
                    out.append((np.full(len(best.ids), a), best.ids, best.scores))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], ["anchor_id", "positive_id", "positive_score"])

    return run


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and greatest whole score s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _negatives(k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, Cell()
        for (no, dim, asks), part in runs(batches, "cell", "dim", "asks"):
            if at != (no, dim):
                at, cell = (no, dim), Cell()
            ids, labels, vecs = part.column("id").to_numpy(), part.column("label").to_numpy(), matrix(part, "ints", dim)
            if not asks:
                cell.add(ids, labels, vecs)
            elif cell.parts or cell.order is not None:
                out = [[np.zeros(0, np.int64)] * 4]
                for a, label, v, scores in zip(ids.tolist(), labels.tolist(), vecs, part.column("scores").to_pylist()):
                    wanted = {s: Best(k, *window(s, low, high)) for s in scores}
                    wanted = {s: b for s, b in wanted.items() if b.low <= b.high}
                    if wanted:
                        cell.scan(v, a, label, False, list(wanted.values()))
                    out += [[np.full(len(b.ids), a), np.full(len(b.ids), s), b.ids, b.scores] for s, b in wanted.items()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], ["anchor_id", "positive_score", "negative_id", "negative_score"])

    return run


def scored_rows(rows: DataFrame, label: Column, id_col: str, vec_col: str) -> DataFrame:
    """(id, label, ints, dim): vectors as whole numbers, floor(256 * x), of rows with a label.

    A score must fit 64 bits, so rows with a component beyond the root of 2^62 / dim take no part."""
    kept = finite_vectors(rows.where(label.isNotNull()), id_col, vec_col, label.cast("long").alias("label"))
    fits = F.forall("vec", lambda x: F.abs(x.cast("double")) * SCALE < F.sqrt(F.lit(2.0**62) / F.col("dim")) - 1)
    ints = F.transform("vec", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return kept.where(fits).select("id", "label", ints.alias("ints"), "dim")


def hard_negatives(rows: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    A row's score is its integer inner product with the anchor, components being
    floor(256 * x). An anchor's positives are the first rows of its label, other than
    itself, by higher score, then smaller id; for each of them the first rows of other
    labels return whose score lies from low to high hundredths of the positive's. A
    negative positive's score leaves that window empty. Nothing is sampled or cut:
    reading stops only where no further row can come in.

    `is_anchor` is a condition on `id`, `label` a column of rows. Rows with a null id or label or with a
    vector that is null, empty or holds null, infinite or not-a-number components
    take no part, nor do those whose scores would not fit 64 bits. Of rows with one id
    the least vector counts. Vectors of different length do not meet. Other columns
    are not read; no rows, no result.
    """
    held = stored(scored_rows(rows, label, id_col, vec_col), "scored-vectors")
    size = held.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dim"), F.lit(0)).alias("elements")).first()
    cells = n_cells(size["n"], size["elements"], CELL_ELEMENTS)
    every = F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    candidates = held.withColumns({"cell": F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int"), "asks": F.lit(0)})
    anchors = held.where(is_anchor)

    keys = ["label", "cell", "dim", "asks"]
    met = candidates.unionByName(anchors.withColumns({"cell": every, "asks": F.lit(1)}))
    met = met.repartition("label", "cell").sortWithinPartitions(*keys).select(*keys, "id", "ints")
    like = met.mapInArrow(_positives(positives), "anchor_id bigint, positive_id bigint, positive_score bigint")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    like = stored(like.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= positives).drop("nth"), "positives")

    # at most `positives` scores an anchor
    scores = like.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("scores"))
    asking = anchors.join(scores, "id").withColumns({"cell": every, "asks": F.lit(1)})
    met = candidates.withColumn("scores", F.lit(None).cast("array<bigint>")).unionByName(asking)
    met = met.repartition(cells, "cell").sortWithinPartitions("cell", "dim", "asks").select("cell", "dim", "asks", "id", "label", "ints", "scores")
    unlike = met.mapInArrow(_negatives(negatives, low, high), "anchor_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    nth = F.row_number().over(Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    unlike = unlike.withColumn("rank", nth).where(F.col("rank") <= negatives)
    return like.join(unlike, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
