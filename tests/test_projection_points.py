"""projection_points: labels carried along, nothing joined back, nothing but its columns cached."""

import re

from termlens import config as C
from termlens.operators import prep as PP
from termlens.plans import q_text as Q


def test_labels_are_carried_without_a_join(spark, monkeypatch):
    rows = [(str(i % 9), f"199{i % 4}", i % 3, 0.1 * (i % 7), "x" * i, *[float((i * (j + 3)) % 11) if i % 5 else None for j in range(len(C.DIM_COLS))]) for i in range(36)]
    df = spark.createDataFrame(rows, "entity_id string, period_key string, mode_id int, mode_pmax double, other string, "
                               + ", ".join(f"{d} double" for d in C.DIM_COLS))
    monkeypatch.setattr(Q.PR, "soft_labels", lambda t: df)
    got = Q.q_projection_points(spark, "none")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "other" not in re.search(r"InMemoryRelation \[(.*?)\]", plan).group(1)
    z = PP.zscore_matrix(df, Q.KEYS, C.DIM_COLS)
    want = PP.pca_project(z, Q.KEYS, C.DIM_COLS, 2).join(df.select(*Q.KEYS, "mode_id", "mode_pmax"), Q.KEYS)
    text = lambda f, p: sorted((r["entity_id"], r["period_key"], r["mode_id"], round(r["pc1"], 6), round(r["pc2"], 6), round(r[p], 9)) for r in f.collect())
    assert text(got, "opacity") == text(want.selectExpr("*", "0.15 + 0.85 * mode_pmax AS o"), "o") and got.count() == 36
