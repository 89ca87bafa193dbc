from __future__ import annotations

import pytest
from compare import check

from tilewright.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    check(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_returns_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_busiest_phase_counts_every_phase(spark, tmp_path):
    rows = [(i, i % 50, f"p{i:03}", float(i + 1), None) for i in range(300)]
    table = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp")
    table.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    check(spark, registry.QUERIES["busiest_phase"], registry.ORACLE_SQL["busiest_phase"], str(tmp_path))
