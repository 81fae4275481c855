"""What the operators on vectors share: usable rows, cells of a block matrix join and their rows as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from haggle.session import scratch_path

#: Rows of a cell, unless its vectors would then fall short of a cell's share.
CELL_ROWS = 8192

#: Cells that rows are dealt to before cells grow; each cell sees every query row.
CELLS = 64


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def finite_vectors(rows: DataFrame, id_col: str, vec_col: str, *more: Column) -> DataFrame:
    """(id, vec, dim, ...) of rows with an id and a vector that is neither null nor empty and all
    of whose components are finite. Where rows share an id, the least row stands for them."""
    kind = rows.schema[vec_col].dataType
    vec = F.col(vec_col)
    if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)):
        vec = vec.cast("array<double>")
    # null components make forall null, which where() drops as well
    usable = F.col(id_col).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")) & x.isNotNull())
    picked = rows.where(usable).select(F.col(id_col).cast("long").alias("id"), F.struct(vec.alias("vec"), *more).alias("row"))
    return picked.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.*").withColumn("dim", F.size("vec"))


def n_cells(n_rows: int, n_elements: int, most: int) -> int:
    """How many cells rows are dealt to: CELLS at most, more only where a cell would pass `most` elements."""
    return max(1, min(CELLS, -(-n_rows // CELL_ROWS)), -(-n_elements // most))


def matrix(batch: pa.RecordBatch, col: str, dim: int) -> np.ndarray:
    """The vectors of a slice of a batch, all of `dim` components, one row each."""
    return batch.column(col).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of the batches over which all keys are equal; a run goes on in the next batch's first slice."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
            yield tuple(v[a].item() for v in values), batch.slice(a, b - a)
