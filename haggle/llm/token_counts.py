"""Tokens per document, without ids: each distinct pre-token is counted once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haggle.llm import library, pretokens
from haggle.llm.arrays import text_slices
from haggle.session import scratch_path

#: The most frequent pre-tokens have their pieces in a table that every task holds:
#: so many rows of at most so many bytes, 18 MB in all with their counts.
HEAD, HEAD_BYTES = 1 << 18, 64

#: Distinct pre-tokens that a task holds before it hands them on, and how often it
#: must have seen one to hand it on. Only what is in the table depends on it, no count.
HELD, SEEN = 1 << 20, 2


def _distinct(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = library.special_strings(path)
        held: dict[bytes, int] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            often = {w: n for w, n in held.items() if n >= SEEN and len(w) <= HEAD_BYTES}
            words, counts = list(often), list(often.values())
            held.clear()
            for i in range(0, len(words), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 100_000], pa.binary()), pa.array(counts[i : i + 100_000], pa.int64())], ["token", "n"])

        for batch in batches:
            for _, _, data, offsets in text_slices(batch, "text"):
                tokens, _ = pretokens.split(data, offsets, special)
                counts = np.bincount(tokens.indices.to_numpy(zero_copy_only=False), minlength=len(tokens.dictionary))
                for w, n in zip(tokens.dictionary.to_pylist(), counts.tolist()):
                    held[w] = held.get(w, 0) + n
                if len(held) >= HELD:
                    yield from hand_on()
        yield from hand_on()

    return run


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("token").to_pylist()
            encoded = library.tokenizer(path).encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("n"), pa.array([len(e.ids) for e in encoded], pa.int32())], ["token", "n", "pieces"])

    return run


def _frequencies(path: str, head: pa.Table):
    """Each document's pre-token frequencies, joined to the pieces per pre-token and summed."""
    known, pieces = head.column("token").combine_chunks(), head.column("pieces").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = library.special_strings(path)
        for batch in batches:
            for i, j, data, offsets in text_slices(batch, "text"):
                tokens, bounds = pretokens.split(data, offsets, special)
                index = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                width = max(1, len(tokens.dictionary))
                doc = np.repeat(np.arange(j - i), np.diff(bounds))
                pairs, freq = np.unique(doc * width + index, return_counts=True)
                place = pc.fill_null(pc.index_in(tokens.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False)
                each = np.zeros(width, np.int64)
                frequent = np.flatnonzero(place >= 0)
                each[frequent] = pieces[place[frequent]]
                rare = np.flatnonzero(place < 0)
                each[rare] = library.encode_distinct(path, tokens.dictionary.take(pa.array(rare)))[1]
                total = np.bincount(pairs // width, weights=freq * each[pairs % width], minlength=j - i).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(offsets)), pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row, as the tokenizers library counts them.

    The frequencies of pre-tokens are summed over all texts and the most frequent
    ones go through the library once; their table, of bounded size, is joined inside
    the tasks to each document's pre-token frequencies. A rarer pre-token is counted
    where it stands, once for all documents of a slice and as long as the worker
    remembers it, so neither pairs of documents and pre-tokens nor ids are shuffled.
    A null or empty text has 0 bytes and 0 tokens. Special strings count as the
    library takes them. Repeated rows keep one result each, null ids too; other
    columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = rows.select("text").mapInArrow(_distinct(tokenizer_path), "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "token").limit(HEAD)
    path = scratch_path(spark, "pieces")
    top.mapInArrow(_pieces(tokenizer_path), "token binary, n bigint, pieces int").write.parquet(path)
    head = spark.read.parquet(path).select("token", "pieces").toArrow()
    return rows.mapInArrow(_frequencies(tokenizer_path, head), "doc_id bigint, n_bytes bigint, n_tokens bigint")
