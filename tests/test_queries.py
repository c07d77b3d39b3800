"""Every named query against its SQL twin on the smallest tables."""

import pytest
from compare import connect, differences, types_differ

from __spark_entry__ import entry
from tallybook.plans.catalog import QUERIES
from tallybook.plans.oracle import ORACLE


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, folder, name):
    frame = QUERIES[name](spark, folder)
    found = duck.execute(ORACLE[name])
    shape = [(d[0], str(d[1])) for d in found.description]
    assert types_differ(frame.dtypes, shape) is None
    mine, theirs = frame.toPandas(), found.df()
    assert differences(mine, theirs) is None
    assert len(mine) > 0


def test_entry_totals(spark):
    """Golden totals of the flagship on the smallest tables."""
    rows = entry(spark).groupBy("status", "drift_reason").agg({"*": "count", "drift_tokens": "sum"})
    found = {(r[0], r[1]): (r["count(1)"], r["sum(drift_tokens)"]) for r in rows.collect()}
    assert found == {
        ("force_settled", "unsettled_timeout"): (183, 0),
        ("settled", None): (445, 0),
        ("settled_with_drift", "budget_truncated"): (50, 180),
        ("settled_with_drift", "client_disconnect_partial"): (50, 135),
        ("settled_with_drift", "gateway_crash_partial"): (26, 77),
        ("settled_with_drift", "provider_underreport"): (120, -354),
        ("settled_with_drift", "tokenizer_mismatch"): (124, 401),
    }
