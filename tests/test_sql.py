"""Queries held against their SQL over the same tables."""

from __future__ import annotations

import duckdb
import pytest

from gambrel.plans import queries as Q


@pytest.mark.parametrize("name", ["n3_edit_distance", "n12_match_table", "w2_clustered_walls", "w6_comb_patterns", "g8_best_rotation"])
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("part", "lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.execute(Q.ORACLE_SQL[name])
    columns = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    found = Q.QUERIES[name](spark, sf_dir)
    assert sorted(found.columns) == columns
    text = lambda row: [repr(round(v, 6)) if isinstance(v, float) else str(v) for v in row]
    assert sorted(text(r[c] for c in columns) for r in found.collect()) == sorted(text(r[k] for k in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["a1_a10_facade", "v5_page_rooms", "v3_largest_cluster", "g12_box_overlap", "w7_w8_nearest_walls"])
def test_further_query_equals_its_sql(spark, sf_dir, name):
    test_query_equals_its_sql(spark, sf_dir, name)
