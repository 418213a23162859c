"""Id normalisation and resolution against a master id list.

All joins are equi-joins on normalised ids; the lower-case master map is an aggregate (max per lower-case id),
so each source id matches at most one master row and no join can multiply rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.functions.keys import looks_like_id, normalize_id
from termlens.sources.tables import Tables


def id_sources(t: Tables) -> DataFrame:
    """Binding: id-bearing fields of several tables as long rows (table, field, raw id). The spellings differ on
    purpose (case, quotes, `.0`, prefixes) as they do across the reference's source files."""
    name = lambda k: F.concat(F.lit("Customer#"), F.lpad(F.col(k).cast("string"), 9, "0"))
    o = t.orders
    parts = [
        o.select(F.lit("orders").alias("source_table"), F.lit("XSBH").alias("source_field"), name("o_custkey").alias("raw_id")),
        o.select(F.lit("orders").alias("source_table"), F.lit("SID").alias("source_field"),
                 F.concat(F.lit('"'), name("o_custkey"), F.lit('"')).alias("raw_id")),
        t.events.select(F.lit("events").alias("source_table"), F.lit("LOGIN_NAME").alias("source_field"),
                        F.lower(name("user_id")).alias("raw_id")),
        t.lineitem.select(F.lit("lineitem").alias("source_table"), F.lit("USERNUM").alias("source_field"),
                          F.concat(F.col("l_suppkey").cast("string"), F.lit(".0")).alias("raw_id")),
        t.part.select(F.lit("part").alias("source_table"), F.lit("KS_XH").alias("source_field"),
                      F.concat(F.lit("PJ"), F.col("p_partkey").cast("string")).alias("raw_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def master_ids(t: Tables) -> DataFrame:
    return t.customer.select(normalize_id("c_name").alias("xh")).where(F.col("xh") != "").distinct()


def distinct_ids(src: DataFrame) -> DataFrame:
    """Distinct non-empty normalised ids per (table, field); no caps."""
    return src.select("source_table", "source_field", normalize_id("raw_id").alias("source_id")) \
        .where(F.col("source_id") != "").distinct()


def id_resolution(src: DataFrame, master: DataFrame) -> DataFrame:
    """Exact match, else case-blind match, else flag ids that look like ids but are unknown; unmatched rows
    are kept with an empty master id."""
    ids = distinct_ids(src)
    exact = master.select(F.col("xh").alias("sid_exact"), F.col("xh").alias("xh_exact"))
    lower = master.groupBy(F.lower("xh").alias("sid_lower")).agg(F.max("xh").alias("xh_lower"))
    j = ids.join(exact, ids.source_id == exact.sid_exact, "left") \
           .join(lower, F.lower(ids.source_id) == lower.sid_lower, "left")
    xh = F.coalesce(F.col("xh_exact"), F.col("xh_lower"), F.lit(""))
    method = (F.when(F.col("xh_exact").isNotNull(), F.lit("exact"))
              .when(F.col("xh_lower").isNotNull(), F.lit("lower_exact"))
              .when(looks_like_id("source_id"), F.lit("xh_like_but_not_found")).otherwise(F.lit("")))
    conf = (F.when(F.col("xh_exact").isNotNull() | F.col("xh_lower").isNotNull(), F.lit("high"))
            .when(looks_like_id("source_id"), F.lit("low")).otherwise(F.lit("")))
    return j.select("source_table", "source_field", "source_id", xh.alias("xh"), method.alias("match_method"),
                    conf.alias("confidence"))


def unmatched_ids(src: DataFrame, master: DataFrame) -> DataFrame:
    """Ids with no master match (exact or case-blind): a left anti join."""
    ids = distinct_ids(src)
    lower = master.select(F.lower("xh").alias("l")).distinct()
    return ids.join(lower, F.lower(ids.source_id) == lower.l, "left_anti")


def id_match_coverage(resolved: DataFrame) -> DataFrame:
    """Per (table, field) distinct ids, matched ids, rate; grand total row via rollup (nulls = total)."""
    g = resolved.rollup("source_table", "source_field").agg(
        F.count(F.lit(1)).alias("n_distinct"), F.count_if(F.col("xh") != "").alias("n_matched"))
    g = g.where(F.col("source_field").isNotNull() | F.col("source_table").isNull())
    return g.select(F.coalesce("source_table", F.lit("__total__")).alias("source_table"),
                    F.coalesce("source_field", F.lit("__total__")).alias("source_field"), "n_distinct", "n_matched",
                    F.when(F.col("n_distinct") == 0, F.lit(0.0)).otherwise(F.col("n_matched") / F.col("n_distinct")).alias("rate"))
