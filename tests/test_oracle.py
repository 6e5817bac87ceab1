"""Every catalogue query against its DuckDB twin (the driver's gate, run locally at sf0.001)."""

import os

import pytest

from scripts.compare import compare

SF = os.environ.get("EVENTLENS_TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_all_queries_match_oracle(spark):
    status = compare(spark, SF, verbose=False)
    bad = {k: v for k, v in status.items() if v not in ("OK", "rows-only")}
    assert not bad, bad
    assert sum(v == "OK" for v in status.values()) >= 53


def test_entry_smoke(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    df = entry(spark)
    assert df.columns == ["source", "num_tweets", "event_title"]
    assert df.count() > 0
    assert set(oracle_sql()) <= set(queries())
