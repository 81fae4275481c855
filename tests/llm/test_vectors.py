"""Hard negatives, nearest neighbours and the manifest against brute force, with nulls, ties, repeated rows and odd columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from haggle.llm import hard_negatives, manifest, nearest, queries, vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, cell string, id string, row string, score string"


def odd_rows():
    """Vectors that take no part."""
    return [(9000, None, 1), (9100, [], 1), (9200, [0.1, None], 1), (9300, [float("nan"), 0.1], 1), (9400, [float("inf"), 0.1], 1), (None, [0.1, 0.2], 1), (9500, [0.0] * 6, None)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    made = [(i, rng.normal(0, 0.2, 6).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(700)]
    hot = [0.25, -0.5, 0.125, 0.0, 0.75, -0.25]
    made += [(i, hot, i % 3) for i in range(700, 1000)]  # one very common vector
    made += [(i, [round(float(x) * 4) / 4 for x in rng.normal(0, 0.5, 6)], int(rng.integers(0, 4))) for i in range(1000, 1300)]  # many ties
    made += [(i, rng.normal(0, 0.2, 3).astype(np.float32).tolist(), 1) for i in range(1300, 1330)]  # shorter vectors
    return made + made[5:8] + odd_rows()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "i", "r", "s") for r in rows], SCHEMA).repartition(4).cache()


def plain(rows, zero=False):
    found = {}
    for i, v, label in rows:
        if i is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v) or (not zero and not any(v)):
            continue
        found[i] = (v, label)
    return found


def nearest_by_force(rows, every, k):
    held, want = plain(rows), []
    for q, (a, _) in held.items():
        if q % every == 0:
            ranked = sorted((math.sqrt(sum_in_order([(x - y) * (x - y) for x, y in zip(a, b)])), i) for i, (b, _) in held.items() if i != q and len(b) == len(a))
            want += [(q, n + 1, i, d) for n, (d, i) in enumerate(ranked[:k])]
    return sorted(want)


def sum_in_order(values):
    total = 0.0
    for v in values:
        total += v
    return total


@pytest.mark.parametrize("cell_rows, tile", [(8192, (512, 4096)), (90, (7, 16))])
def test_nearest(rows, frame, monkeypatch, cell_rows, tile):
    monkeypatch.setattr(vectors, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(nearest, "TILE", tile)
    got = sorted(tuple(r) for r in nearest.nearest(frame, F.col("id") % 20 == 0, 10).collect())
    assert got == nearest_by_force(rows, 20, 10)


def test_nearest_of_few(spark, frame):
    few = frame.where("vec_id in (0, 20, 40)")
    assert nearest.nearest(few, F.col("id") % 20 == 0).count() == 6
    assert nearest.nearest(frame.limit(0), F.col("id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(0, [1e200, 1.0]), (1, [-1e200, 1.0]), (2, [1e-300, 0.0]), (3, [1e200, 2.0])], "vec_id bigint, embedding array<double>")
    got = [(r["query_id"], r["vec_id"]) for r in nearest.nearest(one, F.col("id") == 0, 3).orderBy("rank").collect()]
    assert got == [(0, 3), (0, 1), (0, 2)]  # squares beyond a double's range are ties


def test_code_bounds():
    """The tile keeps every pair that is nearer than the limit, for vectors of very different length."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=(40, 9)) * 10.0 ** rng.integers(-6, 6, (40, 1))
    b = np.concatenate((rng.normal(size=(300, 9)) * 10.0 ** rng.integers(-6, 6, (300, 1)), a[:20] + 1e-9))
    search = nearest.Search(nearest.Coded(np.arange(40), a), 5)
    for i in range(0, 320, 37):
        search.see(nearest.Coded(np.arange(100 + i, 100 + min(i + 37, 320)), b[i : i + 37]))
    for i, heap in enumerate(search.heaps):
        d = nearest.distances(np.repeat(a[i : i + 1], 320, axis=0), b)
        assert sorted((-x, -v) for x, v in heap) == sorted(zip(d.tolist(), range(100, 420)))[:5]


def negatives_by_force(rows, every, positives, negatives):
    held = {i: ([math.floor(256 * x) for x in v], label) for i, (v, label) in plain(rows, True).items() if label is not None}
    want = []
    for a, (v, label) in held.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, (w, _) in held.items() if i != a and len(w) == len(v))
        for s, p in [(s, i) for s, i in scored if held[i][1] == label][:positives]:
            fit = [(t, i) for t, i in scored if held[i][1] != label and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            want += [(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(fit)]
    return sorted(want)


@pytest.mark.parametrize("cell_rows, read", [(8192, 32), (100, 1)])
def test_hard_negatives(rows, frame, monkeypatch, cell_rows, read):
    monkeypatch.setattr(vectors, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(hard_negatives, "FIRST_READ", read)
    got = hard_negatives.hard_negatives(frame, F.col("id") % 25 == 0, F.col("label"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = negatives_by_force(rows, 25, 5, 10)
    assert len(want) > 500 and sorted(tuple(r) for r in got.collect()) == want


def test_hard_negatives_of_odd_numbers(spark):
    big, zero = 2.0**20 + 0.3, [0.0, 0.0]
    rows = [(0, [big, -big], 0), (1, [big, -1.0], 0), (2, [big / 2, 0.0], 1), (3, [1e300, 0.0], 1), (4, [-big, 0.0], 1), (10, zero, 2), (11, [1.0, 1.0], 2), (12, [5.0, 5.0], 3), (20, [1.0, 1.0], 4)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), F.col("id") % 10 == 0, F.col("label"))
    assert sorted(tuple(r) for r in got.collect()) == negatives_by_force([r for r in rows if r[0] != 3], 10, 5, 10)
    assert hard_negatives.hard_negatives(spark.createDataFrame([], "vec_id bigint, embedding array<double>, label int"), F.col("id") % 10 == 0, F.col("label")).count() == 0


def test_threshold_stops_early():
    """A cell is not read to its end where the threshold allows a stop, and the answer is the same."""
    rng = np.random.default_rng(1)
    vecs = np.floor(256 * rng.normal(0, 0.1, (5000, 2))).astype(np.int64)
    cell = hard_negatives.Cell()
    cell.add(np.arange(5000), np.zeros(5000, np.int64), vecs)
    met = []

    class Watched(hard_negatives.Best):
        def see(self, scores, ids):
            met.append(len(ids))
            super().see(scores, ids)

    best = Watched(5)
    cell.scan(np.array([30, -20]), -1, 0, True, [best])
    score = vecs @ np.array([30, -20])
    assert best.ids.tolist() == np.lexsort((np.arange(5000), -score))[:5].tolist() and sum(met) < 1000


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests):
    """The root, and for each leaf the (left, right) pairs on its way up."""
    ways, level, owners = [[] for _ in digests], list(digests), [[i] for i in range(len(digests))]
    while len(level) > 1:
        up, over = [], []
        for i in range(0, len(level), 8):
            run = level[i : i + 8]
            for j, leaves in enumerate(owners[i : i + 8]):
                for leaf in leaves:
                    ways[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(H(*run))
            over.append(sum(owners[i : i + 8], []))
        level, owners = up, over
    return level[0], ways


def manifest_by_force(rows):
    langs, out = {}, []
    for r in rows:
        langs.setdefault(r[2], []).append((H(*map(field, r)), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in order:
        langs[lang].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees.append(tree([leaf for leaf, _ in langs[lang]]))
    root, over = tree([t[0] for t in trees])
    for lang, (sub, ways), top in zip(order, trees, over):
        for (leaf, r), way in zip(langs[lang], ways):
            at = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                at = H(*map(field, r[:4]), field("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in way + top:
                at = H(left, at, right)
            out.append((r[0], leaf, sub, root, H(*[x for s in way + top for x in s]), at, at == root))
    return sorted(out, key=str)


DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, group string, pos string, path string, digest string, n string"


@pytest.mark.parametrize("langs", [["en"], ["en", None, "", "é", "de", "=", "zz", "a", "b", "c"], [f"l{i}" for i in range(90)]])
def test_manifest(spark, langs, monkeypatch, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice(["web", None, ""]), rng.choice(langs), rng.choice([None, 5, -1]), rng.choice([None, "", "Abc É", "abc", "X" * 3000])) for i in range(700)]
    rows += rows[40:44] + [(None, None, langs[0], None, "T"), (None, None, langs[0], None, None), (3, "a", langs[0], 1, "Other")]
    frame = spark.createDataFrame([(*r, "g", "p", "q", "d", "n") for r in rows], DOCS).repartition(3)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op13_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == manifest_by_force(rows)


def test_manifest_of_little(spark):
    one = spark.createDataFrame([(7, "s", "en", 1, "A")], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    cols = [F.col(c) for c in one.columns]
    got = manifest.manifest(one, cols, cols, F.lit(False)).collect()
    assert [(r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["verified"]) for r in got] == [(*[H("1:7", "1:s", "2:en", "1:1", "1:A")] * 3, H(), True)]
    assert manifest.manifest(one.limit(0), cols, cols, F.lit(False)).count() == 0
