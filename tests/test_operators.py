"""Operators on small literals with known results."""

from __future__ import annotations

import hashlib
import hmac
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from haggle.functions.scalar import partition_id
from haggle.operators import causal, guards, isotonic, lifecycle, models, money, neighbours, permutation, privacy, quality, split, tasks, text, threads
from haggle.operators.metrics import exact_median
from haggle.operators.rank import global_rank
from haggle.sources import files


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_off_policy_literals(spark):
    logs = spark.createDataFrame([("a", 0.5, 1.0), ("a", 0.5, 0.0), ("b", 0.5, 1.0), ("b", 0.5, 0.0)], "action string, propensity double, reward double")
    out = {r["estimator"]: r for r in causal.ope(logs, F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(0.0))).collect()}
    assert out["ips"]["value"] == pytest.approx(0.5)
    assert out["direct_method"]["value"] == pytest.approx(0.5)
    assert out["doubly_robust"]["value"] == pytest.approx(0.5)
    assert out["ips"]["effective_sample_size"] == pytest.approx(2.0)
    assert out["ips"]["support_violations"] == 0


def test_uplift_and_exact_permutations(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "treatment int, conversion int")
    assert causal.uplift(df, "treatment", "conversion").first()["ate"] == pytest.approx(0.5)
    p = permutation.permutation_test(df, "treatment", "conversion").first()
    assert (p["method"], p["samples"]) == ("exact_permutation_null", 6)
    assert p["null_mean"] == pytest.approx(0.0)


def test_thread_flags(spark):
    t = spark.createDataFrame(
        [("l", "b", 1, 0, 7, 5.0, 1), ("l", "b", 2, 2, 2, 6.0, 2), ("l", "c", 1, 0, 7, 9.0, 1), ("l", "c", 2, 1, 1, 9.5, 2), ("l", "c", 2, 2, 2, 9.6, 3)],
        "listing_id string, buyer_id string, event_time int, offer_type int, status_id int, offer_price double, ord int")
    got = rows(threads.thread_flags(t, ["ord"]), "buyer_id", "crit_counter", "crit_accept", "crit_duplicate_time", "max_offer")
    assert got == [("b", 0, 0, 0, 6.0), ("c", 1, 1, 1, 9.6)]


def test_agreement_label_families(spark):
    data = [("won", 1, 2), ("won", 2, 9), ("other", 1, 8), ("lost", 1, 7), ("lost", 2, 2), ("open", 1, 7)]
    t = spark.createDataFrame(data, "thread_id string, turn_index int, status_id int").withColumns({"action": F.lit("offer"), "status": F.lit("")})
    assert dict(rows(tasks.agreement_label(t), "thread_id", "label")) == {"won": "1", "other": None, "lost": "0", "open": None}


def test_campaign_sizes_small():
    assert split.campaign_sizes(1, 0.6, 0.2, 0.2, 0.0) == {"training": 1, "development": 0, "hidden": 0, "prospective": 0}
    assert split.campaign_sizes(3, 0.6, 0.2, 0.2, 0.0) == {"training": 1, "development": 1, "hidden": 1, "prospective": 0}
    assert sum(split.campaign_sizes(17, 0.6, 0.2, 0.2, 0.0).values()) == 17


def test_global_rank_is_partition_invariant(spark):
    data = [(random.Random(1).randint(0, 5), i) for i in range(200)]
    want = {x: i + 1 for i, x in enumerate(sorted(data))}
    for n in (1, 7, 64):
        df = spark.createDataFrame(data, "a int, b int").repartition(n)
        got = {(r["a"], r["b"]): r["rank"] for r in global_rank(df, ["a", "b"], partitions=n).collect()}
        assert got == want


def test_exact_median(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("b", 5.0, 3), ("b", 1.0, 4), ("b", 2.0, 5)], "g string, v double, id int")
    assert rows(exact_median(df, ["g"], "v", "id"), "g", "median") == [("a", 2.0), ("b", 2.0)]


def test_partition_number_and_hmac(spark):
    df = spark.createDataFrame([("abc",), ("x-1",)], "k string")
    for r in df.select("k", partition_id(F.col("k"), 97).alias("p"), privacy.hmac_sha256(b"key", F.col("k")).alias("h")).collect():
        assert r["p"] == int(hashlib.sha256(r["k"].encode()).hexdigest(), 16) % 97
        assert r["h"] == hmac.new(b"key", r["k"].encode(), hashlib.sha256).hexdigest()


def test_dialogue_acts(spark):
    df = spark.createDataFrame([("deal at $45",), ("how about 50.50, can deliver",), ("no thanks",), ("I walk away",), ("hello",), ("paid 5 then 6",)], "text string")
    got = [(r["act"], r["offer_amount"]) for r in text.dialogue_acts(df).collect()]
    assert got == [("accept", 45.0), ("counter", 50.5), ("reject", None), ("quit", None), ("other", None), ("propose", 6.0)]


def test_pii_schema_context(spark):
    df = spark.createDataFrame([], "buyer struct<handle:string,score:int>, customer_pseudonym string, product_name string, notes string")
    assert privacy.pii_schema_findings(df.schema) == ["$.buyer.handle", "$.notes"]


def test_drawdown(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([5, -2, 4, -6, -1, 3])], "k string, i int, v long")
    want = [(7, 2, 4)]
    assert rows(money.max_drawdown(df, ["i"], "v", ["k"]), "maximum_drawdown", "peak_index", "trough_index") == want
    assert rows(money.global_drawdown(df, ["i"], "v"), "maximum_drawdown", "peak_index", "trough_index") == want


def test_source_dates(spark):
    df = spark.createDataFrame([("01may2012 11:00:00", "9dec2013"), ("31feb2012 11:00:00", "01xyz2012"), ("", None)], "t string, d string")
    got = [(str(r[0]) if r[0] else None, str(r[1]) if r[1] else None) for r in df.select(quality.source_time("t").cast("string"), quality.source_date("d").cast("string")).collect()]
    assert got[0][0] == "2012-05-01 11:00:00" and got[1] == (None, None) and got[2] == (None, None)


def test_header_and_simple_source(spark, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text("anon_item_id,other\n1,2\n")
    with pytest.raises(ValueError, match="header"):
        files.read_threads(spark, str(bad))
    (tmp_path / "listings.csv").write_text(",".join(files.SIMPLE_LISTING) + "\nl1,s,c,new,10.5,,2024-01-01,2024-01-02\nl2,s,c,new,abc,,2024-01-01,2024-01-02\n")
    (tmp_path / "turns.csv").write_text(",".join(files.SIMPLE_TURN) + "\nt1,l1,b,s,1,buyer,offer,9,open,2024-01-01T10:00:00\n")
    listings, turns, rejected = files.read_simple(spark, str(tmp_path))
    assert (listings.count(), turns.count(), rejected.count()) == (1, 1, 1)


def test_term_expressions_are_checked(spark):
    assert len(models.term_columns(["log1p(a) * b", "if(a > 2, 1, 0)"], ["a", "b"])) == 2
    for bad in ["java_method(a)", "c + 1", "a; b"]:
        with pytest.raises(ValueError):
            models.term_columns([bad], ["a", "b"])


def test_feature_contract_and_reserved_names(spark):
    assert guards.contract_violations(["category", "final_sale_price", "oddity"]) == ["final_sale_price", "oddity"]
    df = spark.createDataFrame([], "a struct<label:string,x:int>, b array<struct<outcomes:int>>")
    assert guards.reserved_paths(df.schema) == ["a.label", "b[].outcomes"]


def test_isotonic_steps_and_monotone_pool(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.8, 1)], "p double, target int")
    got = {r["p"]: round(r["calibrated"], 6) for r in isotonic.isotonic(df).collect()}
    assert got == {0.1: 0.0, 0.2: 0.5, 0.3: 0.5, 0.8: 1.0}
    assert models._pool([0.5, 0.2, 0.9], [1, 3, 1]) == pytest.approx([0.275, 0.275, 0.9])


def curve_by_force(points):
    """The max-min formula on distinct x."""
    xs = sorted({x for x, _, _ in points})
    s = [sum(y * w for x, y, w in points if x == v) for v in xs]
    w = [sum(w for x, _, w in points if x == v) for v in xs]
    avg = lambda a, b: sum(s[a : b + 1]) / sum(w[a : b + 1])
    return {x: max(min(avg(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("shape", ["random", "rising", "falling", "waves"])
@pytest.mark.parametrize("ranges", [1, 4, 9])
def test_rising_blocks(spark, shape, ranges):
    rnd = random.Random(11)
    level = {"random": lambda i: rnd.random(), "rising": lambda i: i / 100, "falling": lambda i: -i / 100, "waves": lambda i: (i % 17) + i / 40}[shape]
    points = [(float(i // 2), level(i), rnd.choice([1.0, 2.5])) for i in range(110)]
    df = spark.createDataFrame([*points, (None, 1.0, 1.0), (3.0, None, 1.0), (3.0, 9.0, 0.0)], "x double, y double, w double").repartition(3)
    got = isotonic.rising_blocks(df, ranges).orderBy("lo").collect()
    want = curve_by_force(points)
    assert all(a["hi"] < b["lo"] and a["value"] < b["value"] for a, b in zip(got, got[1:]))
    for b in got:
        assert [want[x] for x in want if b["lo"] <= x <= b["hi"]] == pytest.approx([b["value"]] * sum(b["lo"] <= x <= b["hi"] for x in want))
    assert sum(b["weight"] for b in got) == pytest.approx(sum(w for _, _, w in points))


def test_isotonic_over_ranges(spark, hot):
    rows = [(None if i == 7 else i / 50, i % 3 % 2, i) for i in range(50)]
    got = {r["row"]: r["calibrated"] for r in isotonic.isotonic(spark.createDataFrame(rows, "p double, target int, row int")).collect()}
    want = curve_by_force([(p, y, 1.0) for p, y, _ in rows if p is not None])
    assert got == {i: pytest.approx(want[p]) if p is not None else None for p, _, i in rows}


def test_nearest_ratio_against_brute_force(spark):
    rnd = random.Random(3)
    cand = [(f"c{i}", f"k{i % 2}", rnd.random()) for i in range(40)]
    hist = [(f"h{i}", f"k{i % 3}", rnd.random(), "accept") for i in range(90)]
    got = rows(models.nearest_ratio(spark.createDataFrame(cand, "cand_id string, category string, ratio double"),
                                    spark.createDataFrame(hist, "hist_id string, category string, ratio double, label string"), 4), "cand_id", "nearest", "hist_id")
    want = []
    for c, k, r in cand:
        near = sorted((abs(x[2] - r), x[0]) for x in hist if x[1] == k)[:4]
        want += [(c, i + 1, h) for i, (_, h) in enumerate(near)]
    assert got == sorted(want)


def test_nearest_ratio_moves_no_row_per_position(spark):
    """Repeated ids share their k rows and carry all labels of their id; unique ones need no window over 2k rows a candidate."""
    cand, hist = "cand_id string, category string, ratio double", "hist_id string, category string, ratio double, label string"
    h = [(f"h{i:03}", "k", i / 100, "accept") for i in range(200)]
    out = models.nearest_ratio(spark.createDataFrame([("a", "k", 0.5), ("b", "k", 1.99)], cand), spark.createDataFrame(h, hist), 3)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode")[0]
    assert rows(out, "cand_id", "nearest", "hist_id") == [("a", 1, "h050"), ("a", 2, "h049"), ("a", 3, "h051"), ("b", 1, "h199"), ("b", 2, "h198"), ("b", 3, "h197")]
    twice = models.nearest_ratio(spark.createDataFrame([("a", "k", 0.5), ("a", "k", 0.501), (None, "k", 0.0), (None, "k", 1.0)], cand),
                                 spark.createDataFrame([*h, ("h050", "x", 0.1, "counter"), (None, "k", 0.5, "accept")], hist), 3)
    got = sorted(((r["cand_id"] or "", r["nearest"], r["hist_id"], r["h_ratio"]) for r in twice.collect()))
    assert got == [("", 1, "h100", 1.0), ("", 2, "h000", 0.0), ("", 3, "h001", 0.01), ("a", 1, "h050", 0.5), ("a", 2, "h050", 0.5), ("a", 3, "h050", 0.5)]
    assert {r["label"] for r in twice.collect() if r["cand_id"] == "a"} == {"accept", "counter"}


def test_histories_are_not_shuffled_by_round(spark):
    turns = spark.createDataFrame([(t, i, "buyer", "offer", float(i)) for t, n in (("x", 3), ("y", 1)) for i in range(1, n + 1)] + [("x", 2, "seller", "counter", 9.0)],
                                  "thread_id string, turn_index int, actor string, action string, amount double")
    cases = spark.createDataFrame([("x", 1, "a"), ("x", 2, "b"), ("x", 7, "c"), ("z", 1, "d"), (None, 1, "e")], "thread_id string, round_number int, row_id string")
    out = tasks.with_history(cases, turns)
    assert out.columns == ["thread_id", "round_number", "row_id", "observed_history"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning(" in x and "round_number" in x.split("hashpartitioning(")[1].split(")")[0] for x in plan.splitlines())
    got = sorted((r["row_id"], None if r["observed_history"] is None else [x["turn_index"] for x in r["observed_history"]]) for r in out.collect())
    assert got == [("a", [1]), ("b", [1, 2]), ("b", [1, 2, 2]), ("c", None), ("d", None), ("e", None)]


def test_tied_timestamps_stages_no_cases(spark):
    from haggle.plans import QUERIES, registry

    before = dict(registry._STAGED)
    out = QUERIES["tied_timestamps"].run(spark, "/root/testdata/sf0.001")
    assert registry._STAGED == before and "case-turns" not in "".join(out.inputFiles())


def nearest_by_force(train, new):
    """(id, nearest id, squared distance) in standardised space; absent components are 0."""
    dim = max(len(v or []) for _, v in train)
    full = lambda v: np.array([0.0 if i >= len(v or []) or v[i] is None else v[i] for i in range(dim)])
    ids, mat = np.array([i for i, _ in train]), np.array([full(v) for _, v in train])
    sd = mat.std(axis=0)
    sd[sd <= 1e-9] = 1.0
    want = []
    for i, v in new:
        d = (((mat - full(v)) / sd) ** 2).sum(axis=1)
        want.append((i, int(ids[d == d.min()].min()), float(d.min())))
    return sorted(want)


@pytest.mark.parametrize("cells, piece, look", [(None, 1 << 16, 256), (40, 50, 4), (1, 7, 2), (3000, 1 << 16, 8)])
def test_nearest_row(spark, monkeypatch, cells, piece, look):
    monkeypatch.setattr(neighbours, "PIECE_ROWS", piece)
    monkeypatch.setattr(neighbours, "ASK_ROWS", 30)
    monkeypatch.setattr(neighbours, "FIRST_LOOK", look)
    rnd = random.Random(5)
    grid = lambda i: [rnd.choice([0.0, 1.0, 2.0]) * 1000, rnd.choice([0.0, 0.5]), float(i % 7), 3.0]
    train = [(i, grid(i)) for i in range(600)] + [(i, [rnd.gauss(0, 900), rnd.random(), rnd.random() * 7, 3.0]) for i in range(600, 900)]
    train += [(900, None), (901, [1.0]), (902, [None, 2.0])] + [(i, [500.0, 0.1, 1.0, 3.0]) for i in range(1000, 1300)]  # one common vector
    new = [(i, grid(i)) for i in range(150)] + [(i, [500.0, 0.1, 1.0, 3.0]) for i in range(150, 250)] + [(250, None), (251, [1e6, 0.0, 0.0, 0.0])]
    t, r = (spark.createDataFrame(x, "id long, vec array<double>").repartition(3) for x in (train, new))
    got = sorted((x["id"], x["nearest_id"], x["distance"]) for x in neighbours.nearest_row(t, r, cells=cells).collect())
    want = nearest_by_force(train, new)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_nearest_row_skips_cells(spark):
    """Far cells are never visited: a row is compared with a small part of the training rows."""
    rnd = random.Random(6)
    train = [(i, [rnd.random() * 50, rnd.random() * 50], i % 2) for i in range(20_000)]
    t = spark.createDataFrame(train, "id long, vec array<double>, target int")
    got = neighbours.nearest_target(t, t.filter("id < 200").select("id", "vec"), cells=64).collect()
    assert all(x["id"] == x["nearest_id"] and x["distance"] == 0 and x["p"] == (0.8 if x["id"] % 2 else 0.2) for x in got) and len(got) == 200
    assert sum(x["tested"] for x in got) < 200 * 1000
    none = neighbours.nearest_target(t.limit(0), t.filter("id < 3").select("id", "vec")).collect()
    assert [(x["nearest_id"], x["p"]) for x in none] == [(None, 0.5)] * 3


@pytest.mark.parametrize("far, numbers", [(0.0, 1 << 20), (1e7, 64)])
def test_nearest_row_by_products_is_exact(monkeypatch, far, numbers):
    """A block of rows meets a block of training rows in one product (F19); rounding there decides nothing, ties go to the lower id, a bound keeps farther rows out."""
    monkeypatch.setattr(neighbours, "MATRIX_NUMBERS", numbers)
    rnd = np.random.default_rng(3)
    vecs = rnd.integers(0, 3, (300, 16)).astype(float) * 0.1 + far
    asks = np.concatenate([vecs[:20], vecs[:30] + 0.05, rnd.random((10, 16)) + far])
    ids, scale = rnd.permutation(300), rnd.random(16) + 0.5
    d = np.stack([(((vecs - a) / scale) ** 2).sum(axis=1) for a in asks])
    best, best_id = np.full(len(asks), np.inf), np.full(len(asks), np.iinfo(np.int64).max)
    best[-1] = d[-1].min() / 2
    neighbours._nearest(vecs, ids, asks, scale, best, best_id)
    assert best[:-1].tolist() == d.min(axis=1)[:-1].tolist()
    assert best_id[:-1].tolist() == [int(ids[x == x.min()].min()) for x in d[:-1]]
    assert (best[-1], best_id[-1]) == (d[-1].min() / 2, np.iinfo(np.int64).max)


def test_nearest_row_raw_space_would_be_wrong(spark):
    t = spark.createDataFrame([(1, [0.0, 1000.0]), (2, [5.0, 0.0])], "id long, vec array<double>")
    r = spark.createDataFrame([(0, [0.0, 400.0])], "id long, vec array<double>")
    assert [x["nearest_id"] for x in neighbours.nearest_row(t, r).collect()] == [1]


def test_bid_replay_against_loop(spark):
    rnd = random.Random(9)
    log = [(c, f"{i:03d}", f"a{i}", rnd.randint(1, 20) * 1.0, rnd.randint(1, 12) * 1.0) for c in (1, 2) for i in range(60)]
    df = spark.createDataFrame(log, "campaign_id long, ts string, auction_id string, value double, price double")
    got = rows(causal.replay_bids(df, {"half": causal.linear_bid(0.5)}, 50.0), "campaign_id", "reward", "spend", "regret")
    want = []
    for c in (1, 2):
        mine = [x for x in log if x[0] == c]

        def play(seq, hit):
            left, reward = 50.0, 0.0
            for _, _, _, v, p in seq:
                if hit(v, p, left) and left >= p:
                    left, reward = left - p, reward + v - p
            return reward, 50.0 - left

        r, s = play(mine, lambda v, p, left: min(v * 0.5, left) >= p)
        o, _ = play(sorted(mine, key=lambda x: (-(x[3] - x[4]), x[2])), lambda v, p, left: v > p)
        want.append((c, r, s, o - r))
    assert got == sorted(want)


def test_hot_transaction_replay(spark, hot):
    path = ["offer_submitted", "merchant_countered", "buyer_countered", "merchant_accepted", "checkout_created", "order_created", "paid", "return_opened", "return_closed", "mature"]
    ev = [("m", "big", f"e{i:03d}", i, i, s, "USD", False) for i, s in enumerate(path)] + [("m", "small", "z", 1, 1, "paid", "USD", False)]
    df = spark.createDataFrame(ev, "merchant_namespace string, transaction_id string, event_id string, occurred_at int, received_at int, transition_to string, currency string, has_conversion boolean").repartition(3)
    got = {r["transaction_id"]: (r["current_state"], r["applied"], r["pending"]) for r in lifecycle.transaction_states(lifecycle.replay_lifecycle(df)).collect()}
    assert got == {"big": ("mature", 10, 0), "small": ("", 0, 1)}


def test_json_keys_of_any_text(spark):
    """Nesting of a hundred thousand levels is a finding, not a crash; names inherit what stands above them."""
    texts = ["[" * 100_000 + "]" * 100_000, '{"a":' * 150 + '{"email":1}' + "}" * 150, '{"a":' * 60 + '{"email":1}' + "}" * 60, "no json", None, "", "7", "[]", "{}",
             '{"shopper":{"profile":{"ids":[1]}}, "hashed_email":2}', '{"item":{"profile":{"ids":[1]}}}', '[{"Customer-Name":1},{"customer.note":2}]', '{"shipping_address":{"line":1}}']
    got = dict(rows(privacy.pii_json_keys(spark.createDataFrame([(t,) for t in texts], "j string"), "j"), "key", "rows"))
    assert got == {privacy.TOO_DEEP: 2, "email": 1, "ids": 1, "customer-name": 1, "customer.note": 1, "shipping_address": 1}


def test_person_key_forms_agree(spark):
    names = [a + s + b for a in ("buyer", "email", "checkout", "hashed", "item", "ip", "Customer", "note") for s in ("_", ".", "-") for b in ("id", "url", "name", "gid", "memo", "x", "address")] + ["name", "user_id", "ID", ""]
    above = [[], ["person"], ["item", "user"]]
    df = spark.createDataFrame([(n, a) for n in names for a in above], "k string, a array<string>")
    got = {(r["k"], tuple(r["a"])): r["p"] for r in df.withColumn("p", privacy.person_key(F.col("k"), F.col("a"))).collect()}
    assert got == {(n, tuple(a)): privacy.key_is_pii(n, set(a)) for n in names for a in above}


def test_csv_records_with_quotes(spark, tmp_path, hot):
    """Quoted separators, quotes and line feeds; a header in each file; a quote that never closes."""
    (tmp_path / "a.csv").write_text('id,when,text\n1,2024-01-02,plain\n2,2024-01-03,"a, b"\n3,"2024-01-04","say ""hi, you""\nand\n\nmore"\nid,when,text\n4,x\n,,\n')
    (tmp_path / "b.csv").write_text("id,when,text\n5,2023-05-06,\"one\ntwo\"\n6,2023-05-07,\"never\n" + "closed\n" * 1200)
    got = quality.profile_csv(spark, str(tmp_path), 3, 1).first().asDict()
    size = sum(f.stat().st_size for f in tmp_path.glob("*.csv")) - 2 * len("id,when,text\n")
    assert (got["accepted_rows"], got["rejected_rows"], got["dated_rows"], got["bytes"]) == (6, 2, 4, size)
    assert (str(got["min_date"])[:10], str(got["max_date"])[:10]) == ("2023-05-06", "2024-01-04")
    assert got["header_hash"] == hashlib.sha256(b"id,when,text").hexdigest()
    cells = lambda t: spark.range(1).select(quality.csv_cells(F.lit(t))).first()[0]
    assert cells(',a,"b, ""c""",') == ["", "a", 'b, "c"', ""] and cells("") == [""]


def test_table_manifest(spark, tmp_path):
    """Every change of a row is found in its partition; the order of columns' values and files does not hide it."""
    path = str(tmp_path / "t")
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("part"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("v"))
    files.write_table(df, path, "id", 3)
    assert files.check_table(spark, path).count() == 0
    at = str(tmp_path / "u")
    df.repartition(2).write.partitionBy("part").parquet(at)
    files.write_manifest(spark, at)
    before = spark.read.parquet(f"{at}/_manifest").orderBy("partition").collect()
    assert [(r["partition"], r["rows"]) for r in before] == [("part=0", 1667), ("part=1", 1667), ("part=2", 1666)]
    one = [f for f in sorted((tmp_path / "u" / "part=1").glob("*.parquet"))][0]
    kept = spark.read.parquet(str(one)).toPandas()
    kept.loc[0, "v"] = "changed"
    kept.to_parquet(one)
    (tmp_path / "u" / "part=1" / f".{one.name}.crc").unlink()
    bad = files.check_table(spark, at).collect()
    assert [(r["partition"], r["failure"], r["listed_rows"], r["found_rows"]) for r in bad] == [("part=1", "hash_mismatch", 1667, 1667)]
    kept.iloc[1:].to_parquet(one)
    assert [(r["partition"], r["failure"]) for r in files.check_table(spark, at).orderBy("partition").collect()] == [("(table)", "row_sum_mismatch"), ("part=1", "row_count_mismatch")]


def test_partition_hashes_shuffle_no_rows(spark, tmp_path):
    """Leaves are hashed where they are read, to the hash of all rows in order, and the result is a table already."""
    path = str(tmp_path / "t")
    spark.range(2500).select("id", F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("v")).coalesce(1).write.parquet(path)
    found = quality.partition_hashes(spark, path)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [sha("\x1f".join([f'{{"v":{i}}}', f'{{"v":"{i}"}}' if i % 5 else "{}"])) for i in range(2500)]
    leaves = [sha("".join(rows[a:a + 1024])) for a in range(0, 2500, 1024)]
    assert [(r["rows"], r["sha256"]) for r in found.collect()] == [(2500, sha(sha("".join(leaves))))]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    # tasks that end inside a leaf hand on its pieces
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 700)
    try:
        assert quality.partition_hashes(spark, path).collect() == found.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = [list(range(0, 600)), list(range(600, 2500))]
    parts = [list(quality._runs(iter([pa.RecordBatch.from_pydict({"file": ["f"] * len(x), "row": x, "h": [rows[i] for i in x]})]))) for x in held]
    pieces = [p for bs in parts for b in bs for p in b.to_pylist()]
    assert [(p["leaf"], p["at"], p["rows"], p["h"]) for p in pieces] == [(0, 0, 600, None), (0, 600, 424, None), (1, 1024, 1024, leaves[1]), (2, 2048, 452, None)]


@pytest.mark.parametrize("size", [1, 3, 64])
def test_history_chunks_expand_to_the_array(spark, size):
    """Chunks and tails give the same histories as the arrays, and hold each turn once."""
    turns = spark.createDataFrame([(f"t{t}", i, "buyer" if i % 2 else "seller", "offer", float(i)) for t, n in enumerate((1, 3, 7, 200)) for i in range(1, n + 1)],
                                  "thread_id string, turn_index int, actor string, action string, amount double")
    cases = turns.select("thread_id", F.col("turn_index").alias("round_number"), F.concat_ws("-", "thread_id", "turn_index").alias("row_id"))
    chunks, tails = tasks.history_chunks(turns, size), tasks.with_history_tail(cases, turns, size)
    got = {r["row_id"]: r["observed_history"] for r in tasks.expand_history(tails, chunks, ["row_id"]).collect()}
    want = {r["row_id"]: r["observed_history"] for r in tasks.with_history(cases, turns).collect()}
    assert got == want and len(got) == 211
    assert sum(len(r["turns"]) for r in chunks.collect()) == 211 and max(len(r["tail"]) for r in tails.collect()) < max(size, 2)


def test_history_chunks_stay_with_their_thread(spark):
    """Turns and cases that lie by thread meet there: neither histories nor row ids are shuffled (F20). A case without its turn has no tail, repeated keys repeat chunks."""
    turns = spark.createDataFrame([(t, i, "buyer", "offer", float(i)) for t in ("a", "b") for i in range(1, 6)], "thread_id string, turn_index int, actor string, action string, amount double")
    cases = spark.createDataFrame([("a", 3, "x"), ("a", 3, "x"), ("a", 5, "y"), ("b", 4, "z"), ("b", 9, "none"), (None, 1, "null"), ("c", 1, "stranger")], "thread_id string, round_number int, row_id string")
    turns, cases = turns.repartition(4, "thread_id"), cases.repartition(4, "thread_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tails = tasks.with_history_tail(cases, turns, 2)
        df = tasks.expand_history(tails, tasks.history_chunks(turns, 2), ["row_id"])
        assert "ENSURE_REQUIREMENTS" not in df._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["row_id"], r["observed_history"] and [int(x["amount"]) for x in r["observed_history"]]) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [("none", None), ("null", None), ("stranger", None), ("x", [1, 2, 1, 2, 3]), ("x", [1, 2, 1, 2, 3]), ("y", [1, 2, 3, 4, 5]), ("z", [1, 2, 3, 4])]
    assert sorted((r["row_id"], r["chunks"], len(r["tail"])) for r in tails.distinct().collect() if r["chunks"] is not None) == [("x", 1, 1), ("y", 2, 1), ("z", 2, 0)]


def test_admit_meets_a_transaction_once(spark):
    """Events of a transaction are shuffled once, and folded as they are over ranges; odd rows included."""
    draw = random.Random(5)
    states = lifecycle.STATES[1:]
    schema = "merchant_namespace string, transaction_id string, event_id string, occurred_at timestamp, received_at timestamp, transition_to string, currency string, has_conversion boolean"
    at = lambda d: None if d == 9 else f"2024-01-{d + 1:02d} 00:00:00"
    path = ["offer_submitted", "merchant_accepted", "checkout_created", "order_created", "paid", "mature"]

    def event(t, i, d):
        to = path[d] if d < 6 and draw.random() < 0.8 else draw.choice(states)
        return ("m" if t % 7 else None, f"t{t}", None if draw.random() < 0.05 else f"e{i % 5 if draw.random() < 0.1 else i}", at(d), at(d), to, draw.choice(["USD", "USD", "EUR", None]), draw.choice([True, False, None]))

    history = [event(t, d, draw.choice([d, d, 9])) for t in range(60) for d in range(draw.randrange(0, 7))]
    new = [event(t, 20, draw.randrange(0, 7)) for t in range(60)]
    # one that undoes what was applied behind it
    history += [("m", "x", f"x{d}", at(d), at(d), to, "USD", False) for d, to in ((0, "offer_submitted"), (2, "merchant_accepted"), (3, "checkout_created"))]
    new.append(("m", "x", "x1", at(1), at(1), "cancelled", "USD", False))
    text = schema.replace("timestamp", "string")
    h, n = (spark.createDataFrame(x, text).withColumns({c: F.col(c).cast("timestamp") for c in ("occurred_at", "received_at")}) for x in (history, new))
    got = lifecycle.admit(h, n)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    rows = lambda df: sorted(map(str, df.collect()))
    known = lambda df: df.filter("merchant_namespace IS NOT NULL")
    assert rows(got) == rows(lifecycle._admit_long(known(h), known(n))) and 0 < got.filter("admitted").count() < got.count()
    assert [r["invalidated"] for r in got.filter("transaction_id = 'x'").collect()] == [2]
    timed = [x.filter("occurred_at IS NOT NULL AND event_id IS NOT NULL") for x in (h, n)]
    want = rows(lifecycle.admit(*timed))
    spark.conf.set("haggle.hot.rows", "4")
    try:
        assert rows(lifecycle.admit(*timed)) == want
    finally:
        spark.conf.unset("haggle.hot.rows")
