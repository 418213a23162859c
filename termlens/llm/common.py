"""Shared helpers of the training-data operators: written stages, distributed ranks, connected components."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`; a scratch folder only in local mode when it is unset."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a shared folder for written stages")
        from termlens.session import ensure_checkpoint_dir
        d = ensure_checkpoint_dir(spark)
    return d.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a stage as Parquet in the shared folder and read it back: lineage ends there, so a lost executor costs
    only unfinished tasks, and later readers prune its columns."""
    path = f"{shared_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z only, whatever the locale."""
    return F.translate(c, UPPER, LOWERED)


def shielded(docs: DataFrame, *plain: str) -> DataFrame:
    """All columns as k_0, k_1, ... (safe from clashes with working columns) plus the `plain` ones under their names."""
    return docs.select(*[F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(docs.columns)], *[F.col(f"`{c}`") for c in plain])


def unshielded(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """Back to the columns of `docs`; `changed` replaces columns by name."""
    return df.select(*[changed.get(c, F.col(f"k_{i}")).alias(c) for i, c in enumerate(docs.columns)])


def chunk_count(n_rows: int) -> int:
    """Chunks for a distributed rank: about sqrt(n) chunks of about sqrt(n) rows, so that both the rows of one
    (key, chunk) group and the chunk totals of one key stay small, however many rows a key has."""
    return max(1, math.isqrt(max(0, n_rows - 1)) + 1)


def ranked(df: DataFrame, keys: list[str], order: list[str], chunk_on: list[str], n_rows: int, out: str) -> DataFrame:
    """Add `out`: 0, 1, 2, ... within each value of `keys`, with no gap, and with no task holding a whole key.

    Rows are dealt into hash chunks of `chunk_on`; a rank is the rows of the key's earlier chunks plus the row number
    inside the (key, chunk) group. Ties get any order. `df` should be a written stage (it is read twice).
    """
    c = df.withColumn("_chunk", F.pmod(F.xxhash64(*chunk_on), F.lit(chunk_count(n_rows))))
    totals = c.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_chunk").alias("_c"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    c = c.withColumn("_rn", F.row_number().over(inside) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_chunk") == F.col("_c")]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    return c.join(offsets, cond).withColumn(out, (F.col("_before") + F.col("_rn")).cast("long")).drop(
        "_chunk", "_c", "_rn", "_before", "_n", *[f"_{k}" for k in keys])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: edges (a, b) -> rows (node, component), component = smallest node.

    Alternating large-star / small-star contraction: every round joins nothing, it groups by node for a minimum and
    rewrites edges, so a hub costs one aggregate row per map task and no neighbour list is ever built. Stops when
    a round changes no edge.
    """
    cur = written(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                  .where("hi <> lo").distinct(), "edges")
    for _ in range(max_rounds):
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            cur.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # large star: neighbours larger than u point to the smallest node around u
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cur.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(m, "u").select(
            F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.where("hi <> lo").distinct()
        # small star: u and its smaller neighbours point to the smallest of them
        m2 = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.select(F.col("hi").alias("u"), F.col("lo").alias("v")).join(m2, "u")
        nxt = small.select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionByName(
            m2.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).where("hi <> lo").distinct()
        nxt = written(nxt, "edges")
        sig = [F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))]
        if cur.agg(*sig).first() == nxt.agg(*sig).first():
            break
        cur = nxt
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nxt.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component")).unionByName(
        nxt.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
