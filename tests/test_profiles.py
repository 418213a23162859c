"""Profiles from labels of a fit."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paths import SF_SMALL
from termlens import config as C
from termlens.operators import profiles as PR
from termlens.sources.tables import Tables


def test_profiles_take_the_labels_they_are_given(spark):
    t = Tables(spark, SF_SMALL)
    own = PR.soft_labels(t)
    given = own.select(*PR.KEYS, *PR.LABEL_COLS).withColumn("mode_id", F.lit(3)).withColumn("subtype_id", F.lit(301)).where("p_mode_0 < 0.2")
    got = PR.entity_profiles(t, labels=given)
    assert got.columns == PR.entity_profiles(t).columns and got.count() == given.count() < own.count()
    row = got.select("mode_id", "mode_name", "subtype_name").distinct().collect()
    assert [tuple(r) for r in row] == [(3, C.MODE_NAMES[3], C.SUBTYPE_NAMES[301])]
    same = PR.soft_labels(t, labels=given).select(*PR.KEYS, *C.DIM_COLS, *C.KEY_METRICS)
    assert same.exceptAll(own.select(*same.columns)).isEmpty()
    with pytest.raises(ValueError, match="mode_pmax"):
        PR.soft_labels(t, labels=given.drop("mode_pmax"))


def test_subtype_names_fall_back_to_the_id(spark):
    df = spark.createDataFrame([(101,), (999,), (None,)], "s int").select(PR.subtype_name_expr("s").alias("a"), PR.subtype_name_expr("s", True).alias("b"))
    assert [tuple(r) for r in df.collect()] == [(C.SUBTYPE_NAMES[101],) * 2, (None, "子类999"), (None, None)]


def test_all_levels_in_one_scan_equal_each_level(spark):
    p = PR.entity_profiles(Tables(spark, SF_SMALL))
    long = PR.level_profile_modes(p)
    assert {r["level"] for r in long.select("level").distinct().collect()} == set(C.GROUP_LEVELS)
    for level, col in C.GROUP_LEVELS.items():
        one = PR.group_profile_modes(p, col).withColumnRenamed(col, "group_name").withColumn("group_name", F.col("group_name").cast("string"))
        mine = long.where(F.col("level") == level).drop("level").select(*one.columns)
        assert mine.count() == one.count() and mine.exceptAll(one).isEmpty()
