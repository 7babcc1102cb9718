"""Rays through a shared edge: rounding decides alike in the operator and in the SQL."""

import duckdb
import pytest

from facetry.plans.catalogue import ORACLES, QUERIES

PARTS = "SELECT * REPLACE ((p_partkey + 7) % 20000 - 8000 AS p_partkey) FROM '/root/testdata/sf0.1/part.parquet' WHERE (p_partkey + 7) % 20000 BETWEEN 8000 AND 8499"


@pytest.mark.parametrize("name", ["ray_distances", "compatible_ray_hits"])
def test_rays_on_an_edge(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY ({PARTS}) TO '{tmp_path}/part.parquet'")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    want = sorted(con.execute(ORACLES[name]).fetchall())
    assert sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()) == want
