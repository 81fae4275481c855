"""Headers of every file, pilot files by manifest or stem, merchant actions, split audits, consent lineage, admission."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from haggle.operators import guards as G
from haggle.operators import privacy as V
from haggle.operators import split as P
from haggle.sources import files as S


def two_files(folder, second):
    for name, header in (("a.csv", list(S.THREAD_COLUMNS)), ("b.csv", second)):
        (folder / name).write_text(",".join(header) + "\n" + ",".join(str(i) for i in range(len(header))) + "\n")
    return str(folder)


def swapped():
    names = list(S.THREAD_COLUMNS)
    names[8], names[9] = names[9], names[8]
    return names


@pytest.mark.parametrize("use", ["count", "other", "swapped"])
def test_swapped_second_file_is_refused(spark, tmp_path, use):
    path = two_files(tmp_path, swapped())
    df = S.read_threads(spark, path)
    with pytest.raises(Exception, match="b.csv"):
        if use == "count":
            df.count()
        else:
            df.select("anon_item_id" if use == "other" else "status_id").collect()


def test_equal_files_are_read_and_reported(spark, tmp_path):
    path = two_files(tmp_path, list(S.THREAD_COLUMNS))
    assert S.read_threads(spark, path).count() == 2
    assert {r["order_matches"] for r in S.header_reports(spark, path, S.THREAD_COLUMNS).collect()} == {True}


def test_report_names_each_file(spark, tmp_path):
    path = two_files(tmp_path, ['"extra"' if n == "byr_us" else n for n in S.THREAD_COLUMNS])
    (tmp_path / "c.csv").write_text("﻿" + ",".join(swapped()) + "\r\n")
    (tmp_path / "d.csv").write_text("")
    got = {r["file"].rsplit("/", 1)[1]: (r["missing"], r["unexpected"], r["order_matches"]) for r in S.header_reports(spark, path, S.THREAD_COLUMNS).collect()}
    assert got == {"a.csv": ([], [], True), "b.csv": (["byr_us"], ["extra"], False), "c.csv": ([], [], False)}


def test_pilot_files_by_manifest_or_stem(spark, tmp_path):
    (tmp_path / "offers.csv").write_text("id\n1\n2\n")
    (tmp_path / "offers.json").write_text('[{"id": 9}]')
    (tmp_path / "fees.json").write_text('{"rows": [{"id": 1}, {"id": 2}, {"id": 3}]}')
    (tmp_path / "traffic.json").write_text('[{"id": 1}, {"id": 2}]')
    (tmp_path / "web.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    (tmp_path / "orders.csv").write_text("id\n1\n")
    (tmp_path / "inventory.csv").write_text("id\n1\n")
    found = S.read_pilot(spark, str(tmp_path), {"orders": "web.jsonl", "inventory": "absent.csv"})
    assert {n: df.count() for n, df in found.items()} == {"offers": 2, "orders": 2, "fees": 3, "traffic": 2}
    with pytest.raises(ValueError, match="unknown pilot"):
        S.read_pilot(spark, str(tmp_path), {"invoices": "x.csv"})


ACTIONS = [
    ("accept", {"store_id": " s1 "}, (None, "merchant_accepted", "s1", None, None)),
    ("decline", {"store_id": "s1"}, (None, "merchant_declined", "s1", None, None)),
    ("counter", {"store_id": "s1", "counter_amount": "12.5", "currency": "eur"}, (None, "merchant_countered", "s1", 1250, "EUR")),
    ("counter", {"store_id": "s1", "counter_amount": 12}, (None, "merchant_countered", "s1", 1200, "USD")),
    ("counter", {"store_id": "s1", "counter_amount": 0.07}, (None, "merchant_countered", "s1", 7, "USD")),
    ("counter", {"store_id": "s1", "counter_amount": "0.00"}, ("bad_amount", None, None, None, None)),
    ("counter", {"store_id": "s1", "counter_amount": "-3"}, ("bad_amount", None, None, None, None)),
    ("counter", {"store_id": "s1", "counter_amount": "012"}, ("bad_amount", None, None, None, None)),
    ("counter", {"store_id": "s1", "counter_amount": [5]}, ("bad_amount", None, None, None, None)),
    ("counter", {"store_id": "s1"}, ("bad_amount", None, None, None, None)),
    ("counter", {"store_id": "s1", "counter_amount": "5", "currency": None}, ("bad_currency", None, None, None, None)),
    ("counter", {"store_id": "s1", "counter_amount": "5", "currency": "euro"}, ("bad_currency", None, None, None, None)),
    ("accept", {"store_id": "s1", "currency": "USD"}, ("unexpected_field", None, None, None, None)),
    ("accept", {"store_id": 7}, ("bad_store_id", None, None, None, None)),
    ("accept", {"store_id": "x" * 256}, ("bad_store_id", None, None, None, None)),
    ("accept", {}, ("bad_store_id", None, None, None, None)),
    ("accept", [1], ("not_an_object", None, None, None, None)),
    ("accept", None, ("not_an_object", None, None, None, None)),
    ("refund", {"store_id": "s1"}, ("unknown_action", None, None, None, None)),
    (None, {"store_id": "s1"}, ("unknown_action", None, None, None, None)),
]


def test_merchant_actions(spark):
    rows = [(str(i), a, None if p is None else json.dumps(p)) for i, (a, p, _) in enumerate(ACTIONS)] + [("bad", "accept", "{not json")]
    got = {r["delivery_id"]: tuple(r)[1:] for r in S.normalize_merchant_actions(spark.createDataFrame(rows, "delivery_id string, action string, payload string")).collect()}
    assert {str(i): w for i, (_, _, w) in enumerate(ACTIONS)} | {"bad": ("not_an_object", None, None, None, None)} == got


def split_input(spark):
    rows = [("t", f"r{i:02}", i, f"l{i // 3}", f"s{i % 7}", None if i % 10 == 0 else f"b{i % 5}", "c", f"th{i}") for i in range(60)]
    return spark.createDataFrame(rows, "target string, row_id string, timestamp int, listing_id string, seller_id string, buyer_id string, category string, thread_id string")


def test_split_audit_counts_purged_and_missing_rows(spark):
    cases = split_input(spark)
    got = {r["split"]: r for r in P.split_audit(P.split_groups(cases, P.split_table(cases))).collect()}
    buyer, timed = got["buyer_disjoint"], got["chronological_listing_purged"]
    assert (buyer["rows"], buyer["purged_rows"], buyer["missing_identifier_rows"], buyer["purged_groups"]) == (54, 6, 6, 0)
    # 60 rows by threes: regions end at rows 36 and 48, on borders of listings
    assert (timed["rows"], timed["purged_rows"], timed["missing_identifier_rows"]) == (60, 0, 0)
    assert all(r["passed"] for r in got.values()) and len(got) == 5
    odd = cases.withColumn("listing_id", F.concat(F.lit("l"), F.floor(F.col("timestamp") / 5).cast("string")))
    timed = {r["split"]: r for r in P.split_audit(P.split_groups(odd, P.split_table(odd))).collect()}["chronological_listing_purged"]
    assert (timed["rows"], timed["purged_rows"], timed["purged_groups"], timed["passed"]) == (50, 10, 2, True)


def test_rows_without_listing_are_one_group(spark):
    cases = split_input(spark).withColumn("listing_id", F.when(F.col("timestamp") % 20 != 0, F.col("listing_id")))
    timed = {r["split"]: r for r in P.split_audit(P.split_groups(cases, P.split_table(cases))).collect()}["chronological_listing_purged"]
    assert (timed["purged_rows"], timed["purged_groups"], timed["missing_identifier_rows"], timed["passed"]) == (3, 1, 0, True)


def test_split_audit_finds_faults(spark):
    cases = split_input(spark)
    table = P.split_table(cases).cache()
    one = table.filter("split = 'seller_disjoint'").limit(1)
    flip = F.when(F.col("region") == "train", "hidden").otherwise("train")
    for faulty, column in ((table.unionByName(one), "no_duplicate_cases"), (table.unionByName(one.withColumn("region", flip)), "group_disjoint"),
                           (table.unionByName(one.withColumn("row_id", F.lit("new"))), "passed")):
        bad = {r["split"]: r for r in P.split_audit(P.split_groups(cases, faulty)).collect()}
        assert not bad["seller_disjoint"][column] and not bad["seller_disjoint"]["passed"]
        assert all(r["passed"] for s, r in bad.items() if s != "seller_disjoint")


def test_canaries(spark):
    df = spark.sql("SELECT 't' AS target, map('category', 'a') AS f UNION ALL SELECT 't', NULL")
    assert all(r["passed"] for r in G.canary_controls(df, "f", ["target"], ["category"]).collect())
    used = {r["control"]: r for r in G.canary_controls(df, "f", ["target"], ["category", "seller_id"]).collect()}
    assert not used["identifier_memorization_canary"]["passed"] and used["identifier_memorization_canary"]["identifiers_used"] == "seller_id"
    dirty = {r["control"]: r for r in G.canary_controls(df.unionByName(spark.sql("SELECT 't' AS target, map('status', 'x') AS f")), "f", ["target"]).collect()}
    assert not dirty["unchanged"]["passed"] and dirty["unchanged"]["rejected_rows"] == 1


def consents(spark, rows):
    return spark.createDataFrame(rows, "merchant_id string, store_id string, record_id string, granted_at timestamp, granted_purposes array<string>, prohibited_purposes array<string>, revoked_at timestamp")


def test_training_dataset_gates_and_lineage(spark):
    from datetime import datetime as D

    both = ["training", V.CROSS_MERCHANT]
    c = consents(spark, [("m1", "s", "r1", D(2024, 1, 1), both, [], None), ("m1", "s", "r2", D(2024, 1, 3), both, [], None),
                         ("m2", "s", "r3", D(2024, 1, 1), both, [], D(2024, 1, 9))])
    ev = spark.createDataFrame([("m1", "s", 1), ("m1", "s", 2), ("m2", "s", 3)], "merchant_id string, store_id string, event_id int")
    one = ev.filter("merchant_id = 'm1'")
    rows, data, behind = V.training_dataset(one, c, "training", "2024-01-05 00:00:00")
    assert rows.count() == 2 and [r["record_id"] for r in behind.collect()] == ["r2"] and data.first()["event_count"] == 2
    again = V.training_dataset(one.orderBy(F.desc("event_id")), c, "training", "2024-01-05 00:00:00")[1].first()
    assert again["dataset_id"] == data.first()["dataset_id"]
    assert V.training_dataset(one, c, V.CROSS_MERCHANT, "2024-01-05 00:00:00", cross=True)[1].first()["dataset_id"] != again["dataset_id"]
    with pytest.raises(ValueError, match="by default"):
        V.training_dataset(ev, c, V.CROSS_MERCHANT, "2024-01-05 00:00:00")
    with pytest.raises(ValueError, match="requires the cross-merchant purpose"):
        V.training_dataset(ev, c, "training", "2024-01-05 00:00:00", cross=True)
    assert V.training_dataset(ev, c, V.CROSS_MERCHANT, "2024-01-05 00:00:00", cross=True)[2].count() == 2
    with pytest.raises(ValueError, match="no active consent"):
        V.training_dataset(ev, c, V.CROSS_MERCHANT, "2024-01-10 00:00:00", cross=True)
    none = V.training_dataset(one.limit(0), c, "training", "2024-01-05 00:00:00")
    assert none[1].first()["event_count"] == 0 and none[1].first()["dataset_id"] and none[2].count() == 0
    stranger = spark.createDataFrame([("m9", "s", 1)], one.schema)
    with pytest.raises(ValueError, match="no active consent"):
        V.training_dataset(stranger, c, "training", "2024-01-05 00:00:00")


def test_case_turns_are_staged_once_a_turn(spark):
    """The staged input of splits and models has one row a turn, not one a case, and no case of another target is read."""
    from conftest import SF

    from haggle.operators import tasks as K
    from haggle.plans import learning as L

    turns = L.norm_turns(spark, SF)
    staged = K.case_turns(turns, L.norm_listings(spark, SF))
    known, _ = K.turns_with_listing(turns, L.norm_listings(spark, SF))
    assert staged.count() == known.count() < L.cases_of(spark, SF).count()
    one = L.cases_of(spark, SF, "agreement")
    assert "Generate" not in one._jdf.queryExecution().optimizedPlan().toString()
    assert one.exceptAll(L.fresh_cases(spark, SF).filter("target = 'agreement'")).count() == 0


def test_splits_by_borders_rank_no_case(spark, monkeypatch):
    """Regions come from the keys at the borders, with missing times first; cases are ranked only where equal ones lie on both sides."""
    ranked = []
    plain = P.rank_within
    monkeypatch.setattr(P, "rank_within", lambda df, part, order, weight=None: ranked.append(weight) or plain(df, part, order, weight))
    cases = split_input(spark).withColumn("timestamp", F.when(F.col("timestamp") % 9 != 0, F.floor(F.col("timestamp") / 4).cast("int"))).withColumn("listing_id", F.col("row_id"))
    for df, whole in ((cases, 0), (cases.unionByName(cases.withColumn("listing_id", F.concat(F.lit("x"), "listing_id"))).withColumn("row_id", F.lit("same")), 1)):
        ranked.clear()
        n = df.count()
        got = {r["region"]: r["count"] for r in P.timed_split(df).groupBy("region").count().collect()}
        want = {r["region"]: r["count"] for r in P.chronological_split(df.withColumn("timestamp", F.coalesce("timestamp", F.lit(-1))), "timestamp", "row_id").groupBy("region").count().collect()}
        assert got == want and sum(got.values()) == n and ranked.count(None) == whole


def test_groups_missing_from_a_required_split_are_an_error(spark):
    cases = split_input(spark).withColumn("seller_id", F.when(F.col("timestamp") != 5, F.col("seller_id")))
    with pytest.raises(Exception, match="missing group in a required split"):
        P.split_table(cases).count()


def test_header_reports_sort_no_lines(spark, tmp_path):
    """The first line of each file is found by its number: no line goes through a sort or an aggregate."""
    for name, head in (("a", S.THREAD_COLUMNS), ("b", ["x", *S.THREAD_COLUMNS[1:]])):
        (tmp_path / f"{name}.csv").write_text("\n".join([",".join(head), *(f"{i},z" for i in range(3000))]) + "\n")
    df = S.header_reports(spark, str(tmp_path), S.THREAD_COLUMNS)
    assert {r["file"].rsplit("/", 1)[1]: (r["unexpected"], r["order_matches"]) for r in df.collect()} == {"a.csv": ([], True), "b.csv": (["x"], False)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort [" not in plan


def test_text_source_is_packed_where_turns_lie(spark, tmp_path):
    """Rows that come twice stay two, and no text of turns is shuffled or stored unpacked."""
    from collections import Counter
    from datetime import datetime

    from haggle.plans import cleaning

    day = datetime(2024, 1, 1)
    spark.createDataFrame([(k, k % 3, "F", 10.0, day, "1-URGENT") for k in range(1, 9)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(k, 83 if n == 0 else k + n, 5, n, 3.0, 100.0, 0.5, 0.0 if k == 2 else 0.1, "N", "O", day) for k in range(1, 9) for n in range(3)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(str(tmp_path / "lineitem.parquet"))
    text = cleaning.raw_threads(spark, str(tmp_path))
    assert "RoundRobinPartitioning" not in text._jdf.queryExecution().executedPlan().toString() and "Union" not in text._jdf.queryExecution().executedPlan().toString()
    got = cleaning.staged_threads(spark, str(tmp_path))
    files = got.inputFiles()
    assert files and all(f.endswith(".csv.gz") for f in files)
    plain = lambda df: Counter(tuple(v or None for v in r) for r in df.collect())
    assert plain(got) == plain(text) and got.count() == 8 * 4 and sorted(plain(got).values()) == [1] * 16 + [2] * 8
