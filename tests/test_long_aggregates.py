"""Wide or costly projections are written once and aggregated in parts; model passes start no task for an empty partition."""

from __future__ import annotations

import re

import numpy as np
import pytest

from termlens.operators import charts as CH
from termlens.operators import cluster_metrics as CM
from termlens.operators import mixture as MX


def test_density_grid_reads_written_points(spark):
    rows = [(0, float(i % 4), float(i % 2)) for i in range(40)] + [(1, 9.0, 9.0)] * 29 + [(None, 1.0, 1.0)] * 40
    out = CH.density_grid(spark.createDataFrame(rows, "mode_id int, x double, y double"), "x", "y", "mode_id", grid=10)
    assert any("termlens-points" in f for f in out.inputFiles())
    got = sorted(tuple(r) for r in out.collect())                  # 29 points are too few, no label is no cluster
    assert got == [(0, 0, 0, 10, 10.0, 10.0), (0, 1, 1, 10, 10.0, 10.0), (0, 2, 0, 10, 10.0, 10.0), (0, 3, 1, 10, 10.0, 10.0)]


@pytest.mark.parametrize("parent", [None, "mode"])
def test_top_features_are_aggregated_in_parts(spark, parent):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 20)) + np.arange(300)[:, None] % 6 * np.linspace(0, 2, 20)
    cols = [f"f{i}" for i in range(20)]
    rows = [(i % 6 // 3, i % 6, *v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, f"mode int, sub int, {', '.join(c + ' double' for c in cols)}")
    out = CM.cluster_top_features(df, "sub", cols, parent=parent)
    plan = out._jdf.queryExecution().optimizedPlan().toString()    # noqa: SLF001
    assert max(len(re.findall(r"avg\(|stddev_pop\(", line)) for line in plan.splitlines() if "Aggregate" in line) <= 2 * CM.FEATURES_AT_ONCE
    got = {(r["cluster_id"], r["rank"]): r for r in out.collect()}
    assert len(got) == 60
    for s in range(6):
        mine, whole = x[s::6], x[np.arange(300) % 6 // 3 == s // 3] if parent else x
        z = (mine.mean(axis=0) - whole.mean(axis=0)) / whole.std(axis=0)
        for rank, f in enumerate(np.argsort(-abs(z), kind="stable")[:10], 1):
            r = got[s, rank]
            assert (r["feature"], r["cluster_size"]) == (cols[f], 50) and r["cluster_pct"] == 50 / len(whole)
            assert r["z"] == pytest.approx(z[f]) and (not parent or r["mode"] == s // 3)


def test_a_model_pass_starts_no_tasks_for_empty_partitions(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 3)) for i in range(200)], "a double, b double").coalesce(2)
    table = MX.matrix(df, ["a", "b"])
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.sparkContext.setJobGroup("one-pass", "one pass")
    try:
        got = MX.summed(table, lambda blocks, _: {0: sum(np.array([len(x), *x.sum(axis=0)]) for _, _, x in blocks)}, None)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got[0].tolist() == [200.0, float(sum(i % 7 for i in range(200))), float(sum(i % 3 for i in range(200)))]
    track = spark.sparkContext.statusTracker()
    jobs = [track.getJobInfo(j) for j in track.getJobIdsForGroup("one-pass")]
    tasks = [track.getStageInfo(s).numTasks for j in jobs for s in j.stageIds if track.getStageInfo(s)]
    assert tasks and max(tasks) < 64
