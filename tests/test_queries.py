"""Registered queries against their SQL on the smallest tables, also with every
group taken as hot. `python tests/oracle.py` checks all of them."""

from __future__ import annotations

import pytest
from conftest import SF
from oracle import compare, connect

import __spark_entry__ as entry

PLAIN = ["waterfall", "overlap_matrix", "moments", "denominator_audit", "task_manifest", "split_manifests", "chronological_split", "calibration_report", "threshold_rule",
         "regression_baselines", "policy_audit", "recommend", "financial_components", "money_summary", "pilot_audit", "ope", "compare_arms", "assign", "mature", "quarantine",
         "pseudonymize", "normalize_webhooks", "lifecycle_stream", "split_audit", "admit", "training_dataset", "normalize_merchant_actions", "canary_controls"]
HOT = ["thread_flags", "thread_summary", "build_cases", "normalize_turns", "max_drawdown", "refund_ledger", "return_exposure", "consent_as_of", "comparables_as_of", "supersession_check"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def check(spark, con, name):
    msg, ok = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, f"{name}: {msg}"


@pytest.mark.parametrize("name", PLAIN)
def test_query(spark, con, name):
    check(spark, con, name)


@pytest.mark.parametrize("name", HOT)
def test_query_with_hot_groups(spark, con, hot, name):
    check(spark, con, name)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 11
    assert set(entry.oracle_sql()) <= set(entry.queries())
