"""Lifting along motion: the plan of one step stays small, as the driver holds a plan for each of a pyramid's steps."""

import pytest

from rippleframe.operators import temporal


@pytest.fixture
def tables(spark, tmp_path):
    spark.sql("SELECT 'a' AS clip, CAST(id AS INT) AS frame, 0 AS y, 0 AS x, CAST(id AS DOUBLE) AS v FROM range(3)").write.parquet(str(tmp_path / "f"))
    spark.sql("SELECT 'a' AS clip, CAST(f.id AS INT) AS frame, 0 AS y, 0 AS x, CAST(s.id AS INT) AS side, 0D AS mvx, 0D AS mvy, 1 AS m FROM range(3) f CROSS JOIN range(2) s").write.parquet(str(tmp_path / "m"))
    return spark.read.parquet(str(tmp_path / "f")), spark.read.parquet(str(tmp_path / "m"))


def test_a_step_needs_two_shuffles_and_no_join(spark, tables):
    frames, motion = tables
    high = frames.filter("frame = 1").selectExpr("clip", "CAST(frame div 2 AS INT) AS i", "y", "x", "v AS h")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        steps = (temporal.t_predict_along(frames, motion, ["clip"], 16, 16, 1, True), temporal.t_update_along(frames, high, motion, ["clip"], 16, 16, 1, True))
        plans = [s._jdf.queryExecution().executedPlan().toString() for s in steps]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in plans:
        assert plan.count("Exchange hashpartitioning") <= 2
        assert "Join" not in plan and plan.count("FileScan") <= 3
