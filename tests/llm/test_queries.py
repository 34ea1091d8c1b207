"""llm queries against their SQL where there is some, and all of them over the smallest and over empty tables."""

from pathlib import Path

import pytest

from sozmill.llm import queries
from tests.oracle import connect, rows_of_frame, rows_of_sql

BASE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    df = queries.queries()[name](spark, BASE)
    columns = sorted(df.columns)
    assert rows_of_frame(df, columns) == rows_of_sql(connect(BASE), queries.oracle_sql()[name], columns)


FOUND = {
    "p1_found": ["record_kind", "record_key", "part_no", "lang"],
    "p3_found": ["id"],
    "p4_found": ["item_kind", "item_key"],
    "p5_found": ["id_a", "id_b"],
    "p6_found": ["id", "group_key"],
    "p7_found": ["doc_id", "item_id"],
    "p9_found": ["doc_id", "start_pos", "end_pos"],
}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("empty")
    for path in Path(BASE).glob("*.parquet"):
        spark.read.parquet(str(path)).limit(0).write.parquet(str(base / path.name))
    return str(base)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs_and_takes_empty_tables(spark, empty, name):
    df = queries.queries()[name](spark, BASE)
    rows = df.collect()
    if name in FOUND:
        assert df.columns == FOUND[name] and len(rows) == len(set(rows))
    queries.queries()[name](spark, empty).collect()
