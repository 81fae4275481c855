"""Benchmark passages in documents: one automaton over all windows of the items.

Texts are reduced to lower-case words with one space between them, as bytes; a
window stands in the automaton with a space on either side, so a match is a run of
whole words. Each document is scanned once per automaton, and the places of the
matches are mapped back to its words and to its own bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from haggle.llm.arrays import text_slices

WINDOW = 10

#: Bytes of normalised item text of one automaton: about 150 MB in a worker.
#: A larger benchmark is scanned for in several automata, each over all documents.
AUTOMATON_BYTES = 1 << 18

# Word characters are 0-9, a-z (A-Z are lowered) and all beyond ASCII.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def windows(item: bytes, size: int = WINDOW) -> set[bytes]:
    """The item's runs of `size` words; an item of fewer words, but not none, is one window."""
    w = words(item)
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


_built: dict[str, object] = {}


def _automaton(items: list[tuple[str, bytes]], size: int):
    """The automaton of some items; its values are (words of the window, item positions)."""
    import ahocorasick

    key = hashlib.sha256(repr((size, items)).encode()).hexdigest()
    if key not in _built:
        _built.clear()  # one at a time in a worker
        owners: dict[bytes, list[int]] = {}
        for k, (_, text) in enumerate(items):
            for w in windows(text, size):
                owners.setdefault(w, []).append(k)
        made = ahocorasick.Automaton()
        for w, ks in owners.items():
            made.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, ks))
        if owners:
            made.make_automaton()
        _built[key] = made if owners else None
    return _built[key]


def _word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin and end in a document's own bytes."""
    inside = np.concatenate(([False], np.frombuffer(_WORDS, np.uint8)[raw] != 32, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


SCHEMA = "row bigint, doc_id bigint, n_words bigint, hits array<bigint>, spans array<struct<start:bigint,end:bigint>>, item_ids array<string>"


def _scan(items: list[tuple[str, bytes]], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(items, size)
        for batch in batches:
            out: list[tuple] = []
            for _, _, data, offsets in text_slices(batch, "text"):
                for a, b in zip(offsets[:-1], offsets[1:]):
                    w = words(data[a:b].tobytes())
                    hit, found = np.zeros(0, np.int64), set()
                    spans: list[dict] = []
                    if automaton is not None and w:
                        text = f" {b' '.join(w).decode('latin-1')} "
                        matches = list(automaton.iter(text))
                        if matches:
                            blank = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
                            last = np.searchsorted(blank, [end for end, _ in matches])  # words before the closing space
                            mark = np.zeros(len(w) + 1, np.int64)
                            for stop, (_, (n, ks)) in zip(last, matches):
                                mark[stop - n] += 1
                                mark[stop] -= 1
                                found.update(ks)
                            hit = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                            begin, end = _word_spans(data[a:b])
                            runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
                            spans = [{"start": int(begin[r[0]]), "end": int(end[r[-1]])} for r in runs]
                    out.append((len(w), hit, spans, sorted(items[k][0] for k in found)))
            n, hits, spans, ids = zip(*out) if out else ((), (), (), ())
            columns = [batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int64())),
                       pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_words", "hits", "spans", "item_ids"])

    return run


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of bounded size; an item without words is in none. Only one block is held at a time."""
    held: list[tuple[str, bytes]] = []
    size = 0
    rows: Iterator[Row] = benchmark.toLocalIterator()
    for r in rows:
        text = b" ".join(words((r["text"] or "").encode()))
        if not text or r["item_id"] is None:
            continue
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append((r["item_id"], text))
        size += len(text)
    if held:
        yield held


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_cols: tuple[str, ...] = ("text",), window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """Benchmark windows in every whole document.

    doc_id, n_words, hits (positions of the words inside any occurrence of a window),
    spans (byte ranges of runs of hit words in the text itself), item_ids (strings,
    sorted). Questions and answers are separate columns in `item_text_cols`; a null
    item text has no words, nor has a null document. Rows of one item id are one item.
    Repeated documents keep a result each; null ids too; other columns are not read;
    an empty table of documents gives an empty result, an empty benchmark no hits.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = F.explode(F.array(*[F.col(c) for c in item_text_cols]))
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), texts.alias("text"))
    scanned = [rows.mapInArrow(_scan(block, window), SCHEMA) for block in _blocks(items, automaton_bytes)] or [rows.mapInArrow(_scan([], window), SCHEMA)]
    if len(scanned) == 1:
        one = scanned[0]
    else:
        every = scanned[0]
        for more in scanned[1:]:
            every = every.unionByName(more)
        one = every.groupBy("row").agg(
            F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.flatten(F.collect_list("item_ids")).alias("item_ids"),
        )
    return one.select("doc_id", "n_words", "hits", "spans", F.array_sort(F.array_distinct("item_ids")).alias("item_ids"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without those that hold a benchmark window; all columns as they are. Rows
    that share an id go together; a row without an id stays, since nothing names it."""
    gone = find_passages(docs, benchmark, id_col, text_col, **how).where(F.size("hits") > 0).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
