"""Mesh tables, whose files pack far below their size in memory, are not broadcast."""

import pytest

from facetry.plans.catalogue import QUERIES

NAMES = ["mesh_face_normals", "feature_size", "vertex_areas"]


@pytest.mark.parametrize("name", NAMES)
def test_no_vertex_table_is_broadcast(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "BroadcastExchange" not in plan
