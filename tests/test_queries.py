"""Every core query against its SQL on the smallest tables, and all queries on empty tables."""

import pytest

from sozmill.plans import registry
from tests.oracle import connect, rows_of_frame, rows_of_sql

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(BASE)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, BASE)
    columns = sorted(df.columns)
    assert rows_of_frame(df, columns) == rows_of_sql(con, registry.oracle_sql()[name], columns)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, BASE).count() > 0


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    from pathlib import Path

    base = tmp_path_factory.mktemp("empty")
    for path in Path(BASE).glob("*.parquet"):
        spark.read.parquet(str(path)).limit(0).write.parquet(str(base / path.name))
    return str(base)


@pytest.mark.parametrize("name", ["p2_found", "prepare_summary", "manifest_summary", "source_hour_cap", "greedy_batches", "consolidate_intervals", "corpus_wer", "registry_upsert", "ranked_hours"])
def test_empty_tables(spark, empty, name):
    registry.queries()[name](spark, empty).collect()
