"""The best rows of every feature come from a bounded part of the cells."""

from pyspark.sql import functions as F

from termlens.operators import quality as QL


def test_best_cells_hold_the_first_rows_of_every_feature(spark):
    rows = [(f"e{i:04d}", f"p{i % 3}", float(i % 7) if i % 5 else None, float(i), float("nan") if i in (3, 2000) else -1.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "e string, p string, a double, b double, c double").repartition(4)
    cells = QL.best_cells(df, ["e", "p"], ["a", "b", "c"], 10)
    assert cells.count() <= 4 * 3 * 10
    order = [F.desc("value"), F.asc("e"), F.asc("p")]
    got = QL.top_k_per_group(cells, "feature", order, 10, F.col("e"))
    long = df.select("e", "p", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in "abc"])).alias("r"))
    want = QL.top_k_per_group(long.select("e", "p", "r.*").where("value IS NOT NULL"), "feature", order, 10, F.col("e"))
    pick = lambda f: sorted((r["feature"], r["rank"], r["e"], r["p"], str(r["value"])) for r in f.collect())
    assert pick(got) == pick(want) and len(pick(got)) == 30
