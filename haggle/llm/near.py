"""Near-duplicate documents: a Hamming join of MinHash signatures, confirmed on full shingle sets.

A signature has 40 places of 16 bits in 8 chunks. If two signatures differ in at most
15 places, some chunk differs in at most one (pigeonhole), so the two agree on a key
of that chunk with one place left out. Keys name every chunk and place left out:
all pairs within that distance meet under a key, and a pair at the threshold lies
beyond it once in several thousand.

Under each key a finer signature tells which pairs may be links; a spanning forest of
those is all that leaves the task, as clusters need no more. The texts of a cluster
then meet once, and full sets decide; a pair that confirmed links already connect is
not compared again. So neither step hands on a row for each pair."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haggle.llm.arrays import lower_ascii, mix, ragged, span_hashes, text_slices
from haggle.llm.components import components
from haggle.session import scratch_path

CHUNKS, CHUNK = 8, 5
PLACES = CHUNKS * CHUNK

#: Places of two bits that tell near pairs from the rest.
FINE = 256

#: Classes under one key that are compared at once; more are compared block by block.
BLOCK = 1 << 14

#: Bytes of text of one cluster that are compared at once; more are compared block by block.
BLOCK_BYTES = 16 << 20

#: Bytes of text whose shingles are hashed at once: arrays of 8 bytes a byte of text stand beside it.
TEXT_BYTES = 1 << 20

_FACTORS = mix(np.arange(1, PLACES + FINE + 1, dtype=np.uint64)) | np.uint64(1)
# Words are cut at space, tab, line feed, vertical tab, form feed and return.
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; a shorter text is one shingle, one without words has none."""
    low = np.frombuffer(data.tobytes().translate(lower_ascii()), np.uint8)
    solid = ~_WHITE[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    word = span_hashes(low, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    out = []
    rolled = np.zeros(len(word), np.uint64)
    n = max(0, len(word) - size + 1)
    for k in range(size):
        rolled[:n] = mix(rolled[:n] * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n])
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for k in range(a, b):
                one = mix(one * np.uint64(0x9E3779B97F4A7C15) + word[k : k + 1])
            out.append(mix(one + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two signatures of each non-empty set: bits of the least hash under each of many
    orders. The finer one has 32 places of two bits in each of its words."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), PLACES), np.uint16)
    fine = np.zeros((len(sets), FINE // 32), np.uint64)
    for k, factor in enumerate(_FACTORS):
        least = mix(np.minimum.reduceat(flat * factor, starts))
        if k < PLACES:
            out[:, k] = least & np.uint64(0xFFFF)
        else:
            word, place = divmod(k - PLACES, 32)
            fine[:, word] |= (least & np.uint64(3)) << np.uint64(2 * place)
    return out, fine


def fine_distance(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Places in which each of the others' finer signatures differs from one."""
    x = others ^ one
    x |= x >> np.uint64(1)
    x &= np.uint64(0x5555555555555555)
    return np.bitwise_count(x).sum(axis=1, dtype=np.int32)


def fine_reach(low: int, high: int) -> int:
    """Places of the finer signature in which a pair at the threshold differs at most,
    but for one pair in about 300,000 (four and a half standard deviations)."""
    apart = (1 - low / high) * (1 - 1 / 4)
    return int(np.ceil(FINE * apart + 4.5 * np.sqrt(FINE * apart * (1 - apart))))


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch, "text", TEXT_BYTES):
                sets = shingle_sets(data, offsets, size)
                full = [k for k, s in enumerate(sets) if len(s)]
                sig: list[bytes | None] = [None] * len(sets)
                fine: list[bytes | None] = [None] * len(sets)
                digest: list[bytes | None] = [None] * len(sets)
                if full:
                    for k, row, more in zip(full, *signatures([sets[k] for k in full])):
                        sig[k], fine[k], digest[k] = row.tobytes(), more.tobytes(), _digest(sets[k])
                columns = [batch.column("doc_id").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.diff(offsets)), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(fine, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "bytes", "digest", "sig", "fine"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
        for c in range(CHUNKS):
            for left_out in range(CHUNK):
                packed = np.zeros(len(sig), np.uint64)
                for p in range(CHUNK):
                    if p != left_out:
                        packed = packed << np.uint64(16) | sig[:, c, p]
                key = mix(packed ^ mix(np.array([c * CHUNK + left_out + 1], np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("c")], ["key", "c"])


def _in_blocks(rows: DataFrame, group: str, parts: Column, member: str = "c") -> DataFrame:
    """rows with the pairs of blocks (i, j) that they take part in, so that every two
    members of a group share one; `mine` is a row's own block of its group's `parts`."""
    mine = F.pmod(F.xxhash64(member, F.lit(7)), parts).cast("int")
    spread = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
    pairs = spread.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("other")
    return pairs.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def _runs(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of (group, i, j) and the bounds of these; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            held.append(batch)
            ends = [batch.slice(0, 1), batch.slice(batch.num_rows - 1)]
            if len(held) > 1 and all(x.column(c)[0] == held[0].column(c)[0] for x in ends for c in (group, "i", "j")):
                continue  # the whole batch goes on with what is held
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(len(rows) - 1, bool)
        for c in (group, "i", "j"):
            v = rows.column(c).to_numpy()
            same &= v[1:] == v[:-1]
        bounds = np.array([0, *(np.flatnonzero(~same) + 1), len(rows)])
        whole = bounds if batch is None else bounds[:-1]
        if len(whole) > 1:
            yield rows.slice(0, int(whole[-1])), whole
        held = rows.slice(int(whole[-1])).to_batches()


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are of block i, and which of block j."""
    return tuple(rows.column("mine").to_numpy() == rows.column(c).to_numpy() for c in ("i", "j"))


def _words(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), FINE // 32)


def _spanning(of_left: np.ndarray, of_right: np.ndarray, near) -> list[tuple[int, int]]:
    """A spanning forest of the graph between left and right (or inside left, if they
    are the same): `near(k, others)` gives those of the others that are tied to k."""
    left, right = np.flatnonzero(of_left), np.flatnonzero(of_right)
    inside = len(left) == len(of_left)
    unseen = np.ones(len(of_left), bool)
    edges = []
    for root in left:
        if not unseen[root]:
            continue
        unseen[root] = False
        queue = [root]
        while queue:
            k = queue.pop()
            others = left if inside else right if of_left[k] else left
            others = others[unseen[others]]
            if len(others):
                found = near(k, others)
                unseen[found] = False
                edges += [(int(k), int(o)) for o in found]
                queue += found.tolist()
    return edges


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _forest(low: int, high: int):
    """Edges that span the pairs under a key which sizes and finer signatures allow."""
    reach = fine_reach(low, high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _runs(batches, "key"):
            c, n, fine = rows.column("c").to_numpy(), rows.column("n").to_numpy(), _words(rows.column("fine"))
            lefts, rights = _sides(rows)

            def fits(a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
                return (np.minimum(n[a], n[b]) * high >= np.maximum(n[a], n[b]) * low) & (fine_distance(fine[a], fine[b]) <= reach)

            two = bounds[:-1][np.diff(bounds) == 2]
            two = two[fits(two, two + 1)]
            edges = [_edges(c[two], c[two + 1])]
            for x, y in zip(bounds[:-1], bounds[1:]):
                if y - x > 2:
                    tied = _spanning(lefts[x:y], rights[x:y], lambda k, others: others[fits(x + k, x + others)])
                    if tied:
                        u, v = x + np.array(tied).T
                        edges.append(_edges(c[u], c[v]))
            yield from pa.Table.from_batches(edges).combine_chunks().to_batches()

    return run


def _confirm(size: int, low: int, high: int):
    """Links that span the pairs of a cluster with low * |union| <= high * |intersection| on full sets."""
    reach = fine_reach(low, high)

    def of_cluster(rows: pa.Table) -> pa.RecordBatch | None:
        texts = pa.RecordBatch.from_arrays([rows.column("text").combine_chunks()], ["text"])
        sets = [s for _, _, data, offsets in text_slices(texts, "text", TEXT_BYTES) for s in shingle_sets(data, offsets, size)]
        digests = rows.column("digest").to_pylist()
        # rows that share an id come with the texts of all of them: one row of the class itself stays
        own = {c: k for k, c in enumerate(rows.column("c").to_pylist()) if _digest(sets[k]) == digests[k]}
        some = sorted(own.values())
        if len(some) < 2:
            return None
        rows, sets = rows.take(pa.array(some)), [sets[k] for k in some]
        fine = _words(rows.column("fine"))
        n = np.array([len(s) for s in sets])
        starts = np.cumsum(n) - n
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        marked = np.zeros(int(code.max()) + 1, bool)

        def near(k: int, others: np.ndarray) -> np.ndarray:
            others = others[np.minimum(n[others], n[k]) * high >= np.maximum(n[others], n[k]) * low]
            others = others[fine_distance(fine[k], fine[others]) <= reach]
            if not len(others):
                return others
            mine = code[starts[k] : starts[k] + n[k]]
            marked[mine] = True
            ends = np.cumsum(n[others])
            shared = np.add.reduceat(marked[code[ragged(starts[others], n[others])]], ends - n[others], dtype=np.int64)
            marked[mine] = False
            return others[high * shared >= low * (n[others] + n[k] - shared)]

        tied = _spanning(*_sides(rows), near)
        if not tied:
            return None
        u, v = np.array(tied).T
        c = rows.column("c").to_numpy()
        return _edges(c[u], c[v])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _runs(batches, "cluster"):
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                links = of_cluster(rows.slice(x, y - x))
                if links is not None:
                    yield links

    return run


def near_components(docs: DataFrame, size: int = 5, low: int = 80, high: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least id that links lead to) of every row.

    Shingles are `size` words between white space, A-Z lowered; two documents are
    linked if high * |intersection| >= low * |union|. A text with fewer words is one
    shingle; a null or empty text, or one without words, has none and no link.
    Equal sets are one class before anything is compared, so copies cost no pairs.
    Rows with shingles that share an id are one vertex. A null id is in no link and has a null
    component. Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    path = scratch_path(spark, "sketches")
    rows.mapInArrow(_sketch(size), "doc_id bigint, n bigint, bytes bigint, digest binary, sig binary, fine binary").write.parquet(path)
    sketches = spark.read.parquet(path)
    usable = sketches.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    # equal sets have equal sizes and signatures; the written number names a class from here on
    least = usable.groupBy("digest").agg(F.min("doc_id").alias("id"), F.max("bytes").alias("bytes"), *(F.max(x).alias(x) for x in ("n", "sig", "fine")))
    path = scratch_path(spark, "classes")
    least.withColumn("c", F.monotonically_increasing_id()).write.parquet(path)
    classes = spark.read.parquet(path)

    keys = classes.select("c", "sig").mapInArrow(_keys, "key bigint, c bigint")
    members = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = keys.join(members, "key").join(classes.select("c", "n", "fine"), "c")
    blocks = _in_blocks(shared, "key", F.ceil(F.col("members") / BLOCK)).select("key", "i", "j", "mine", "c", "n", "fine")
    path = scratch_path(spark, "edges")
    blocks.mapInArrow(_forest(low, high), "u bigint, v bigint").distinct().write.parquet(path)
    clusters = components(spark.read.parquet(path))
    path = scratch_path(spark, "clusters")
    clusters.select(F.col("v").alias("c"), F.col("component").alias("cluster")).join(classes.drop("sig", "n"), "c").write.parquet(path)
    placed = spark.read.parquet(path)

    weights = placed.groupBy("cluster").agg(F.sum("bytes").alias("weight"))
    texts = placed.join(weights, "cluster").join(rows.withColumnRenamed("doc_id", "id"), "id")
    blocks = _in_blocks(texts, "cluster", F.ceil((F.col("weight") + 1) / BLOCK_BYTES)).select("cluster", "i", "j", "mine", "c", "digest", "fine", "text")
    path = scratch_path(spark, "links")
    blocks.mapInArrow(_confirm(size, low, high), "u bigint, v bigint").write.parquet(path)
    links = spark.read.parquet(path)

    # rows that share an id tie their classes
    of_rows = usable.select("doc_id", "digest").join(classes.select("digest", "c"), "digest").groupBy("doc_id").agg(F.min("c").alias("u"), F.max("c").alias("w"))
    several = of_rows.where("u <> w").select("doc_id", "u")
    ties = usable.select("doc_id", "digest").join(several, "doc_id").join(classes.select("digest", F.col("c").alias("v")), "digest").select("u", "v")
    tied = components(links.unionByName(ties)).withColumnRenamed("v", "c")
    named = classes.select("digest", "id", "c").join(tied, "c", "left").withColumn("component", F.coalesce("component", "c"))
    lowest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    of_class = named.join(lowest, "component").select("digest", "component_id")
    found = sketches.select("doc_id", "n", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_first(docs: DataFrame, size: int = 5, low: int = 80, high: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near duplicates, that of the least id; all columns as they are."""
    found = near_components(docs, size, low, high, id_col, text_col)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
