"""Byte-pair encoding by a rank file, in two tiers, and decoding.

A pre-token that is itself in the vocabulary is found by a minimal perfect hash:
a few kilobytes of displacements map the keys onto their places without gaps, and
the stored key confirms the hit. Any other pre-token is merged over linked bytes,
with the pairs in a heap."""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haggle.llm import pretokens
from haggle.llm.arrays import mix, ragged, span_hashes, sums, text_slices

#: Merged pre-tokens that a worker remembers; beyond it the memory starts anew. Only speed depends on it.
MEMORY = 1 << 19

#: Bytes of text split at a time. The arrays of a split are some forty times as large, in each worker.
SPLIT_BYTES = 1 << 20


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks, from lines of base64 and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _place(hashes: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    return (mix(hashes + displacement.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


@dataclass(frozen=True)
class PerfectHash:
    """Keys on n places, one each. `displacement` has an entry per bucket of about four keys."""

    displacement: np.ndarray
    keys: np.ndarray
    offsets: np.ndarray
    ids: np.ndarray

    @staticmethod
    def build(ranks: dict[bytes, int]) -> PerfectHash:
        words = list(ranks)
        n = len(words)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        hashes = span_hashes(raw, np.concatenate(([0], ends[:-1])), ends)
        if len(np.unique(hashes)) < n:
            raise ValueError("two keys have one 64-bit hash")
        buckets = max(1, n // 4)
        bucket = (mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=buckets)
        begin = np.cumsum(size) - size
        taken, displacement, place = np.zeros(n, bool), np.zeros(buckets, np.int64), np.zeros(n, np.int64)
        for b in np.argsort(-size, kind="stable"):
            if not size[b]:
                break
            own, tried, step = order[begin[b] : begin[b] + size[b]], 0, 16
            while True:
                d = np.arange(tried, tried + step)
                at = _place(hashes[own][None, :], d[:, None], n)
                good = ~taken[at].any(axis=1)
                if size[b] > 1:
                    row = np.sort(at, axis=1)
                    good &= (row[:, 1:] != row[:, :-1]).all(axis=1)
                if good.any():
                    k = int(np.argmax(good))
                    displacement[b], place[own] = d[k], at[k]
                    taken[at[k]] = True
                    break
                tried, step = tried + step, min(step * 4, 1 << 16)
        by_place = np.argsort(place)
        lengths = np.array([len(words[i]) for i in by_place], np.int64)
        keys = np.frombuffer(b"".join(words[i] for i in by_place), np.uint8)
        return PerfectHash(displacement, keys, np.concatenate(([0], np.cumsum(lengths))), np.array([ranks[words[i]] for i in by_place], np.int64))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The id of each byte span that is a key, else -1."""
        if not len(starts) or not len(self.ids):
            return np.full(len(starts), -1, np.int64)
        hashes = span_hashes(data, starts, ends)
        bucket = (mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(len(self.displacement))).astype(np.int64)
        place = _place(hashes, self.displacement[bucket], len(self.ids))
        length = ends - starts
        same = np.flatnonzero((self.offsets[place + 1] - self.offsets[place]) == length)
        equal = self.keys[ragged(self.offsets[place[same]], length[same])] == data[ragged(starts[same], length[same])]
        same = same[sums(equal, np.concatenate(([0], np.cumsum(length[same])))) == length[same]]
        out = np.full(len(starts), -1, np.int64)
        out[same] = self.ids[place[same]]
        return out


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank, leftmost first, is joined
    until no pair is in the vocabulary. Bytes are linked both ways; a heap holds
    the pairs, and those that a join has changed are passed over when they come up."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it is joined to its left
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (left := before[i]) >= 0 and (r := ranks.get(word[left:stop])) is not None:
            heapq.heappush(heap, (r, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


_known: dict[str, dict[bytes, bytes]] = {}


def _encode(path: str, table: PerfectHash):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known = read_ranks(path), _known.setdefault(path, {})
        for batch in batches:
            for i, j, data, offsets in text_slices(batch, "text", SPLIT_BYTES):
                tokens, bounds = pretokens.split(data, offsets)
                words = tokens.dictionary
                at = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
                raw = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.zeros(0, np.uint8)
                whole = table.find(raw, at[:-1], at[1:])
                missing = np.flatnonzero(whole < 0)
                parts = []
                for w in words.take(pa.array(missing)).to_pylist():
                    ids = known.get(w)
                    if ids is None:
                        if len(known) >= MEMORY:
                            known.clear()
                        ids = known[w] = np.array(merge(w, ranks), "<i4").tobytes()
                    parts.append(ids)
                lengths = np.ones(len(words), np.int64)
                lengths[missing] = [len(p) // 4 for p in parts]
                flat = np.zeros(int(lengths.sum()), np.int32)
                begin = np.cumsum(lengths) - lengths
                found = np.flatnonzero(whole >= 0)
                flat[begin[found]] = whole[found]
                flat[ragged(begin[missing], lengths[missing])] = np.frombuffer(b"".join(parts), "<i4")
                index = tokens.indices.to_numpy(zero_copy_only=False)
                counts = lengths[index]
                ids = flat[ragged(begin[index], counts)]
                ends = np.concatenate(([0], np.cumsum(sums(counts, bounds)))).astype(np.int32)
                yield batch.slice(i, j - i).drop_columns(["text"]).append_column("ids", pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)))

    return run


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every whole text, special strings as ordinary text.

    A null or empty text has an empty array. Repeated rows keep one result each,
    null ids too; other columns are not read; an empty table gives an empty result.
    """
    table = PerfectHash.build(read_ranks(ranks_path))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode(ranks_path, table), "doc_id bigint, ids array<int>")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        lengths = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        words = [b""] * len(lengths)
        for w, r in ranks.items():
            lengths[r], words[r] = len(w), w
        keys, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
        for batch in batches:
            column = batch.column("ids")
            starts = column.offsets.to_numpy().astype(np.int64)
            ids = column.values.to_numpy(zero_copy_only=False)
            i = 0
            while i < len(column):  # some rows at a time, so that the gather stays small
                j = max(i + 1, int(np.searchsorted(starts, starts[i] + (1 << 20), side="right")) - 1)
                some = ids[starts[i] : starts[j]]
                size = lengths[some]
                text = keys[ragged(begin[some], size)]
                ends = np.concatenate(([0], np.cumsum(sums(size, starts[i : j + 1] - starts[i])))).astype(np.int32)
                decoded = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(text.tobytes())])
                yield batch.slice(i, j - i).append_column("decoded", decoded)
                i = j

    return run


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The rows of encode() with `decoded`, the bytes of their ids. An empty array gives no bytes."""
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(_decode(ranks_path), "doc_id bigint, ids array<int>, decoded binary")
