"""Passages that repeat across documents: MinHash banding of paragraphs, exact Jaccard, components, removals.

A paragraph here is a sentence or a line, whichever ends first, or some short ones
in a row, cut by what they say, so that a passage has the same paragraphs wherever
it stands inside a text. Long ones are also cut into pieces, again by what they say,
so that a passage without an end of a sentence has the same pieces inside any other. Equal paragraphs are one
group. All groups that share a band meet, as near copies do in `near`: a finer
signature tells which may be alike, and full sets of five-word shingles decide;
linked groups are one cluster. The document of the least id keeps a
cluster's text, and runs of such paragraphs elsewhere are the removals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haggle.llm import near
from haggle.llm.arrays import lower_ascii, mix, ragged, sequence_hashes, span_hashes, text_slices
from haggle.llm.components import components
from haggle.session import cut_lineage, scratch_path

SHINGLE = 5
SIMILARITY = 0.8
#: The similarity as a fraction.
LOW, HIGH = 80, 100
#: Words of a paragraph at least; shorter ones neither make nor break a run.
PARAGRAPH_WORDS = 8
#: Paragraphs of so many words have pieces, cut by what they say, of at least so many words: as many as a shingle.
LONG_WORDS, PIECE_WORDS = 16, SHINGLE
#: Words of a removed run at least.
RUN_WORDS = 20
#: Chance that a pair at the similarity shares a band, at least.
RECALL = 0.99
#: Bits of the filter that spares a shuffle of paragraphs; its size is fixed, false hits cost only time.
FILTER_BITS = 1 << 24
#: Bytes of text that a task takes at once.
SLICE = 1 << 20
#: Band rows that a task holds to drop its own repetitions.
HELD = 1 << 18

# Quotes and brackets that may stand behind the end of a sentence.
_CLOSERS = [x.encode() for x in ('"', "'", ")", "]", "}", "\u201d", "\u2019", "\u00bb", "\u203a")]
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def bands(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = 3) -> int:
    """Bands of `rows` places so that a pair at the similarity shares one with the chance `recall`."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


def _unquoted(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ends of words without the quotes and brackets that close them."""
    ends = ends.copy()
    closing = np.zeros(256, bool)
    closing[[sign[-1] for sign in _CLOSERS]] = True
    for _ in range(4):
        # few words end like a closer; a word of closers only keeps one byte
        some = np.flatnonzero(closing[low[ends - 1]])
        for sign in _CLOSERS:
            at = some[ends[some] - starts[some] > len(sign)]
            same = np.ones(len(at), bool)
            for k, byte in enumerate(reversed(sign)):
                same &= low[ends[at] - 1 - k] == byte
            ends[at[same]] -= len(sign)
    return ends


def _cuts(words: np.ndarray) -> np.ndarray:
    """Words after which a long paragraph is cut: the hash of a word and the next is less
    than those of the PIECE_WORDS - 1 places on both sides (of equal ones the first counts)."""
    if len(words) < 2:
        return np.zeros(0, np.int64)
    h = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    least = np.ones(len(h), bool)
    for k in range(1, PIECE_WORDS):
        least[k:] &= h[k:] < h[:-k]
        least[:-k] &= h[:-k] <= h[k:]
    return np.flatnonzero(least)


class Paragraphs:
    """The paragraphs of a slice's texts and the pieces of the long ones: text, place in it,
    bytes, words and two hashes of each. Places count paragraphs that are not cut and
    pieces; a paragraph of pieces has the place of the first and its width is their number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int = PARAGRAPH_WORDS):
        low = np.frombuffer(data.tobytes().translate(lower_ascii()), np.uint8)
        solid = ~_WHITE[low]
        edge = np.zeros(len(low) + 1, bool)
        edge[offsets] = True
        begin, stop = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1] | edge[1:-1]
        stop[:-1] &= ~solid[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.words = span_hashes(low, starts, ends)
        lines = np.concatenate(([0], np.cumsum(low == 0x0A)))[starts] if len(starts) else np.zeros(0, np.int64)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        first = np.ones(len(starts), bool)
        if len(starts):
            closed = np.isin(low[_unquoted(low, starts, ends) - 1], [0x21, 0x2E, 0x3F])
            first[1:] = closed[:-1] | (lines[1:] != lines[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(first)
        tail = np.concatenate((head[1:], [len(starts)])).astype(np.int64) if len(head) else head
        if len(head):
            # short sentences in a row are one paragraph, cut after those whose hash says so
            short, of = tail - head < least, doc[head]
            one = sequence_hashes(self.words, head, tail)
            every = -(-3 * least // (tail - head))  # of so many sentences one: about three times the least length
            cut = ~short | (one % every.astype(np.uint64) == 0)
            new = np.concatenate(([True], ~short[1:] | cut[:-1] | (of[1:] != of[:-1])))
            last = np.concatenate((new[1:], [True]))
            head, tail = head[new], tail[last]
        good = tail - head >= least
        head, tail = head[good], tail[good]
        cut = _cuts(self.words)
        # at least PIECE_WORDS words before and behind, so that no word beyond the paragraph counts
        left, right = np.searchsorted(cut, head + PIECE_WORDS - 1), np.searchsorted(cut, tail - PIECE_WORDS)
        pieces = np.where(tail - head >= LONG_WORDS, np.maximum(right - left, 0), 0) + 1
        first = np.cumsum(pieces) - pieces
        unit = np.zeros(int(pieces.sum()), np.int64)
        inner = np.ones(len(unit), bool)
        inner[first] = False
        unit[first] = head
        unit[inner] = cut[ragged(left, pieces - 1)] + 1
        stop = np.concatenate((unit[1:], [0])).astype(np.int64)
        stop[first + pieces - 1] = tail
        many = np.flatnonzero(pieces > 1)
        self.head, self.tail = np.concatenate((unit, head[many])), np.concatenate((stop, tail[many]))
        self.doc = doc[self.head] if len(self.head) else np.zeros(0, np.int64)
        self.start, self.end = (starts[self.head], ends[self.tail - 1]) if len(self.head) else (self.head, self.head)
        self.start, self.end = self.start - offsets[self.doc], self.end - offsets[self.doc]
        self.n = self.tail - self.head
        at = self.doc[: len(unit)]
        place = np.arange(len(unit)) - np.searchsorted(at, at)
        self.place = np.concatenate((place, place[first[many]]))
        self.width = np.concatenate((np.ones(len(unit), np.int64), pieces[many]))
        one = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(self.words + np.uint64(7)), dtype=np.uint64)))
        self.h1 = sequence_hashes(self.words, self.head, self.tail)
        self.h2 = mix((one[self.tail] - one[self.head]) ^ self.h1)

    def shingles(self, some: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of these paragraphs in a row, and where each paragraph's begin."""
        n = max(0, len(self.words) - SHINGLE + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + self.words[k : k + n])
        counts = self.n[some] - SHINGLE + 1
        bounds = np.concatenate(([0], np.cumsum(counts)))
        at = np.arange(bounds[-1]) + np.repeat(self.head[some] - bounds[:-1], counts)
        return rolled[at], bounds


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Paragraphs]]:
    for batch in batches:
        for i, j, data, offsets in text_slices(batch, "text", SLICE):
            yield batch.slice(i, j - i), Paragraphs(data, offsets)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, p in _each(batches):
        yield pa.RecordBatch.from_arrays([pa.array(p.h1.view(np.int64)), pa.array(p.h2.view(np.int64)), rows.column("doc_id").take(pa.array(p.doc))], ["h1", "h2", "doc_id"])


def _band_keys(count: int, rows: int):
    factors = mix(np.arange(1, count * rows + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def hand_on() -> pa.RecordBatch:
            keys, ids = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.uint64),) * 2
            held.clear()
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
            return pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), pa.array(ids[new].view(np.int64))], ["key", "h1"])

        for _, p in _each(batches):
            if not len(p.head):
                continue
            _, one = np.unique(p.h1, return_index=True)
            one = one[p.n[one] >= PARAGRAPH_WORDS]
            if not len(one):
                continue
            flat, bounds = p.shingles(one)
            for b in range(count):
                key = np.full(len(one), b + 1, np.uint64)
                for factor in factors[b * rows : (b + 1) * rows]:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(flat * factor, bounds[:-1]))
                held.append((key, p.h1[one]))
            if sum(len(keys) for keys, _ in held) >= HELD:
                yield hand_on()
        yield hand_on()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The groups of keys that have more than one; rows come sorted by key. Inside a batch
    each group of a key goes out once; a key that goes on over batches may repeat some."""
    held: tuple[int, int] | None = None  # the last key with one of its groups, and whether it has others
    many = False
    for batch in batches:
        keys, ids = batch.column("key").to_numpy(), batch.column("h1").to_numpy()
        if not len(keys):
            continue
        if held is not None:
            keys, ids = np.concatenate(([held[0]], keys)), np.concatenate(([held[1]], ids))
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])))
        keys, ids = keys[new], ids[new]
        tied = np.zeros(len(keys) + 1, bool)
        tied[1:-1] = keys[1:] == keys[:-1]
        some = tied[1:] | tied[:-1]
        if held is not None and many:
            some |= keys == held[0]
        many = bool(some[-1])
        held = int(keys[-1]), int(ids[-1])
        yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(ids[some])], ["key", "h1"])


def hash_filter(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit table of the 64-bit `h1` of ids; `bits` bounds what comes to the driver."""
    place = F.pmod(F.col("h1"), F.lit(bits))
    words = ids.groupBy(F.shiftright(place, 5).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h1, {bits}) & 31 as int))")).alias("m")).toArrow()
    table = np.zeros(bits // 32, np.uint32)
    table[words.column("w").to_numpy()] = words.column("m").to_numpy().astype(np.uint32)
    return np.unpackbits(table.view(np.uint8), bitorder="little")


def _passes(table: np.ndarray, h1: np.ndarray) -> np.ndarray:
    return np.flatnonzero(table[np.mod(h1.view(np.int64), len(table))])


def _shingle_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """h1 of the ids, and the full set of shingles of the paragraphs of that name."""
    packed = np.packbits(hash_filter(ids), bitorder="little")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(packed, bitorder="little")
        for _, p in _each(batches):
            some = _passes(table, p.h1)
            if len(some):
                _, one = np.unique(p.h1[some], return_index=True)
                some = some[one]
                flat, bounds = p.shingles(some)
                of = np.repeat(np.arange(len(some)), np.diff(bounds))
                order = np.lexsort((flat, of))
                flat, of = flat[order], of[order]
                new = np.ones(len(flat), bool)
                new[1:] = (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])
                ends = np.concatenate(([0], np.cumsum(np.bincount(of[new], minlength=len(some))))).astype(np.int32) * 8
                found = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat[new])])
                yield pa.RecordBatch.from_arrays([pa.array(p.h1[some].view(np.int64)), found], ["h1", "shingles"])

    return docs.mapInArrow(sets, "h1 bigint, shingles binary").join(ids, "h1", "left_semi").groupBy("h1").agg(F.min("shingles").alias("shingles"))


def _unpacked(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets with their sizes and finer signatures."""
    for batch in batches:
        if batch.num_rows:
            sets = _unpacked(batch.column("shingles"))
            fine = [x.tobytes() for x in near.signatures(sets)[1]]
            yield pa.RecordBatch.from_arrays([batch.column("h1"), pa.array([len(x) for x in sets], pa.int64()), pa.array(fine, pa.binary()), batch.column("shingles")], ["c", "n", "fine", "shingles"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that span the pairs of a cluster with a Jaccard similarity of at least SIMILARITY on full sets."""
    reach = near.fine_reach(LOW, HIGH)

    def of_cluster(rows: pa.Table) -> pa.RecordBatch | None:
        fine, sets = near._words(rows.column("fine")), _unpacked(rows.column("shingles"))
        n = np.array([len(s) for s in sets])
        starts = np.cumsum(n) - n
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        marked = np.zeros(int(code.max()) + 1, bool)

        def close(k: int, others: np.ndarray) -> np.ndarray:
            others = others[np.minimum(n[others], n[k]) * HIGH >= np.maximum(n[others], n[k]) * LOW]
            others = others[near.fine_distance(fine[k], fine[others]) <= reach]
            if not len(others):
                return others
            mine = code[starts[k] : starts[k] + n[k]]
            marked[mine] = True
            ends = np.cumsum(n[others])
            shared = np.add.reduceat(marked[code[ragged(starts[others], n[others])]], ends - n[others], dtype=np.int64)
            marked[mine] = False
            return others[HIGH * shared >= LOW * (n[others] + n[k] - shared)]

        tied = near._spanning(*near._sides(rows), close)
        if not tied:
            return None
        u, v = np.array(tied).T
        c = rows.column("c").to_numpy()
        return near._edges(c[u], c[v])

    for rows, bounds in near._runs(batches, "cluster"):
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            links = of_cluster(rows.slice(x, y - x))
            if links is not None:
                yield links


def _links(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (u, v) that span the pairs of similar groups: all groups of a key meet, those whose finer
    signatures allow it are one cluster, and in a cluster every pair is held against full sets."""
    spark = docs.sparkSession
    path = scratch_path(spark, "paragraph-keys")
    keys.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key bigint, h1 bigint").write.parquet(path)
    shared = spark.read.parquet(path)
    path = scratch_path(spark, "paragraph-sets")
    _shingle_sets(shared.select("h1").distinct(), docs).mapInArrow(_sketch, "c bigint, n bigint, fine binary, shingles binary").write.parquet(path)
    sets = spark.read.parquet(path)
    members = shared.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    met = shared.withColumnRenamed("h1", "c").join(members, "key").join(sets.select("c", "n", "fine"), "c")
    blocks = near._in_blocks(met, "key", F.ceil(F.col("members") / near.BLOCK)).select("key", "i", "j", "mine", "c", "n", "fine")
    path = scratch_path(spark, "paragraph-edges")
    blocks.mapInArrow(near._forest(LOW, HIGH), "u bigint, v bigint").distinct().write.parquet(path)
    clusters = components(spark.read.parquet(path))
    path = scratch_path(spark, "paragraph-clusters")
    clusters.select(F.col("v").alias("c"), F.col("component").alias("cluster")).join(sets, "c").write.parquet(path)
    placed = spark.read.parquet(path)
    weights = placed.groupBy("cluster").agg(F.sum(F.col("n") * 8).alias("weight"))
    blocks = near._in_blocks(placed.join(weights, "cluster"), "cluster", F.ceil((F.col("weight") + 1) / near.BLOCK_BYTES)).select("cluster", "i", "j", "mine", "c", "fine", "shingles")
    return blocks.mapInArrow(_linked, "u bigint, v bigint")


def repeated_passages(docs: DataFrame, run_words: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removals: doc_id, start and end (bytes of its text), n_words, keep_ids.

    A removal is a run of paragraphs or pieces of doc_id, at least `run_words` words of them,
    whose clusters also stand in a document of a lesser id; keep_ids are the documents
    that keep them. A paragraph and its pieces are looked up each. Shorter paragraphs inside a run go with it. Copies of a document are whole
    repeated runs. Repetition inside one document, or in rows that share an id, is
    none across documents. A null or empty text has no paragraphs; a null id neither
    keeps nor loses any; other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    texts = rows.select("text")
    keys = texts.mapInArrow(_band_keys(bands(), 3), "key bigint, h1 bigint")
    clusters = cut_lineage(components(_links(keys, texts)))

    groups = rows.mapInArrow(_groups, "h1 bigint, h2 bigint, doc_id bigint").groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    placed = groups.join(clusters.select(F.col("v").alias("h1"), "component"), "h1", "left")
    groups_path = scratch_path(spark, "paragraph-groups")
    placed.where("component IS NOT NULL OR least <> most").write.parquet(groups_path)
    kept = spark.read.parquet(groups_path)
    spread = kept.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("cluster_least"), F.max("most").alias("cluster_most"))
    named = kept.join(spread, "component", "left").select("h1", "h2", F.coalesce("cluster_least", "least").alias("keep_id"), F.coalesce("cluster_most", "most").alias("most"))
    repeated = cut_lineage(named.where("keep_id <> most").select("h1", "h2", "keep_id"))
    packed = np.packbits(hash_filter(repeated), bitorder="little")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(packed, bitorder="little")
        for own, p in _each(batches):
            some = _passes(table, p.h1)
            at = pa.array(p.doc[some])
            columns = [own.column("row").take(at), own.column("doc_id").take(at), *(pa.array(x[some]) for x in (p.place, p.width, p.start, p.end, p.n)), pa.array(p.h1[some].view(np.int64)), pa.array(p.h2[some].view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "place", "width", "start", "end", "n", "h1", "h2"])

    schema = "row bigint, doc_id bigint, place bigint, width bigint, start bigint, end bigint, n bigint, h1 bigint, h2 bigint"
    removed = rows.mapInArrow(found, schema).join(repeated, ["h1", "h2"]).where("doc_id <> keep_id")
    # a run goes on while the next one begins no later than the last one ends; pieces of a removed paragraph add no words
    reach = F.max(F.col("place") + F.col("width")).over(Window.partitionBy("row").orderBy("place", F.desc("width")).rowsBetween(Window.unboundedPreceding, -1))
    placed = removed.withColumn("reach", F.coalesce(reach, F.lit(-1)))
    run = F.sum((F.col("place") > F.col("reach")).cast("int")).over(Window.partitionBy("row").orderBy("place", F.desc("width")).rowsBetween(Window.unboundedPreceding, 0))
    runs = placed.withColumn("run", run).groupBy("row", "run").agg(
        F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.sum(F.when(F.col("place") + F.col("width") > F.col("reach"), F.col("n")).otherwise(0)).alias("n_words"), F.array_sort(F.collect_set("keep_id")).alias("keep_ids"),
    )
    return runs.where(F.col("n_words") >= run_words).select("doc_id", "start", "end", "n_words", "keep_ids")


def without(docs: DataFrame, removals: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the removals' bytes cut out of their texts; all other columns as they are."""
    spans = removals.groupBy(F.col("doc_id").alias("__cut_id")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__cut"))
    raw = F.col(text_col).cast("binary")
    pieces = F.aggregate(
        F.col("__cut"), F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("kept")),
        lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["kept"], F.array(F.substring(raw, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")).cast("string"))).alias("kept")),
        lambda a: F.concat(F.array_join(a["kept"], ""), F.substring(raw, (a["at"] + 1).cast("int"), F.octet_length(raw)).cast("string")),
    )
    joined = docs.join(spans, docs[id_col] == spans["__cut_id"], "left")
    return joined.withColumn(text_col, F.when(F.col("__cut").isNull(), F.col(text_col)).otherwise(pieces)).drop("__cut", "__cut_id")
