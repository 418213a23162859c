"""The trees and thresholds of the personal-data operator are fitted on every certain candidate."""

from pyspark.sql import functions as F

from termlens.llm import pii


def test_all_certain_candidates_train_and_calibrate(spark, monkeypatch):
    seen = []

    class Spy(pii.GBTClassifier):
        def fit(self, df, params=None):
            seen.append(df.count())
            return super().fit(df, params)

    monkeypatch.setattr(pii, "GBTClassifier", Spy)
    i = F.col("id")
    cand = spark.range(90_000).select(
        i.alias("doc_id"), F.lit(0).cast("long").alias("_th"), F.lit("phone").alias("kind"), F.lit(0).alias("start"), F.lit(9).alias("end"),
        F.lit(False).alias("touch"), F.lit(True).alias("ok"), F.when(i % 10 > 0, (i % 2).cast("double")).alias("label"),
        *[((i % 2) if k == 0 else i % (k + 2)).cast("double").alias(c) for k, c in enumerate(pii.FEATURES)])
    even = F.pmod(F.xxhash64("doc_id", "_th"), F.lit(2)) == 0
    chosen = pii.selected(cand).select("doc_id").collect()
    assert seen == [cand.where(even & F.col("label").isNotNull()).count()]
    assert all(r["doc_id"] % 2 == 1 for r in chosen)
