"""Token ids of a corpus in files: ids ranked by frequency, in bytes, with their sizes apart.

Each id is replaced by its frequency rank and written in one to four whole bytes;
the sizes of four ids share one control byte, and control and data bytes stand in
separate streams, so a reader finds every id by one table look-up and one gather."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haggle.llm import library, pretokens
from haggle.llm.arrays import ragged, sums, text_slices
from haggle.session import scratch_path

#: Ids in a block of the file, unless one document alone has more.
BLOCK_IDS = 1 << 20

_SIZES = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], dtype=np.int64)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit integers; the last control byte may be part empty."""
    values = np.ascontiguousarray(values, dtype="<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    keep = np.arange(4) < size[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n integers of pack(): sizes by table look-up, then one gather per byte place."""
    size = _SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)))
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


@dataclass(frozen=True)
class TokenFiles:
    """Where one corpus of ids lies: blocks of documents and the table of ranks."""

    blocks: str
    ranks: str


def _encode(path: str, end_id: int | None, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = library.special_strings(path)
        for batch in batches:
            for i, j, data, offsets in text_slices(batch, "text"):
                tokens, bounds = pretokens.split(data, offsets, special)
                flat, lengths = library.encode_distinct(path, tokens.dictionary)
                index = tokens.indices.to_numpy(zero_copy_only=False)
                counts = lengths[index]
                ids = flat[ragged((np.cumsum(lengths) - lengths)[index], counts)]
                n = sums(counts, bounds)
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(n), end_id)
                    n = n + 1
                ends = np.concatenate(([0], np.cumsum(n))) * np.dtype(dtype).itemsize
                packed = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(ids.astype(dtype).tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), packed.cast(pa.binary())], ["doc_id", "ids"])

    return run


def _id_counts(dtype: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                total += np.bincount(np.frombuffer(ids.as_buffer(), dtype), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    return run


def _to_blocks(dtype: str, rank_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        docs: list = []
        parts: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            values = rank_of[np.concatenate(parts)] if parts else np.zeros(0, np.uint32)
            control, data = pack(values)
            columns = [pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([docs], pa.list_(pa.int64())),
                       pa.array([[len(x) for x in parts]], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "start", "doc_ids", "n_tokens", "control", "data"])

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                docs.append(doc)
                parts.append(np.frombuffer(ids.as_buffer(), dtype))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield block()
                    start, docs, parts, held = start + held, [], [], 0
        if docs:
            yield block()

    return run


BLOCK_SCHEMA = "part int, start bigint, doc_ids array<bigint>, n_tokens array<bigint>, control binary, data binary"


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encode every whole text by the tokenizers library and write the ids, in
    ascending id order, to the shared folder.

    Every distinct pre-token goes through the library, and a text's ids are put
    together from those. A null or empty text has no ids but the end id. Repeated
    ids keep one entry per row; null ids come first; other columns are not read;
    an empty table gives files without rows. Ids are ranked over all texts, equal
    counts by id. The range partitions of the id order make the files, and a block
    holds where it starts in its file, so places need no pass over the ids.
    """
    spark = docs.sparkSession
    size = max(library.vocabulary_size(tokenizer_path), (end_id or 0) + 1)
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    raw, files = scratch_path(spark, "ids"), TokenFiles(scratch_path(spark, "token-blocks"), scratch_path(spark, "token-ranks"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows.mapInArrow(_encode(tokenizer_path, end_id, dtype), "doc_id bigint, ids binary").write.option("compression", "zstd").parquet(raw)
    encoded = spark.read.parquet(raw)
    counts = encoded.select("ids").mapInArrow(_id_counts(dtype, size), "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    # at most one row per id of the vocabulary
    ranked = [r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()]
    spark.createDataFrame([(k, i) for k, i in enumerate(ranked)], "rank int, id int").coalesce(1).write.parquet(files.ranks)
    rank_of = np.zeros(size, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    ordered = encoded.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(_to_blocks(dtype, rank_of), BLOCK_SCHEMA).write.option("compression", "zstd").parquet(files.blocks)
    return files


def _from_blocks(id_of: np.ndarray, offset_of: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = np.array(row["n_tokens"], np.int64)
                ids = id_of[unpack(row["control"], row["data"], int(n.sum()))]
                ends = np.concatenate(([0], np.cumsum(n)))
                first = offset_of[row["part"]] + row["start"]
                raw = ids.astype("<u4").tobytes()
                view = memoryview(raw)
                ids_col = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((ends * 4).tobytes()), pa.py_buffer(raw)]).cast(pa.binary())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:])]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(first + ends[:-1]), pa.array(n), pa.array(crc, pa.int64()), ids_col]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return run


def read_tokens(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """Documents of written files: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 and ids (little-endian unsigned 32-bit integers)."""
    ranks = spark.read.parquet(files.ranks).orderBy("rank").collect()  # the vocabulary at most
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(files.blocks)
    per_part = blocks.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    offsets, total = {}, 0
    for r in sorted(per_part.collect()):  # one row per file
        offsets[r["part"]] = total
        total += r["n"]
    id_of = np.array([r["id"] for r in ranks] or [0], np.uint32)
    return blocks.mapInArrow(_from_blocks(id_of, offsets), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
