"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

DataFrame and SQL functions only. The 64-bit hash of every five-word shingle is used once: its high bits name one of `BINS` bins,
the least hash of a bin is kept. One sentinel per bin (the bin's largest value) joins the hashes before the sort, so that
the first value of every bin gives a dense vector in which a sentinel marks an empty bin. An empty bin copies the
non-empty bin that comes first in a random order of its own (the same order for all documents). Of every bin the low `BITS`
bits are packed. The share of equal bins then holds chance agreements of 2^-BITS, which the likeness corrects.

Edge cases: null text = empty = no words; fewer words than a shingle: the whole sequence is one shingle; equal texts have
equal fingerprints; documents follow each other by descending doc_id (nulls last, ties by content hash); the only
document follows itself; repeated rows each get a row; an empty table gives no rows; very long texts are hashed whole (one array
of shingle hashes a text); only doc_id and text are read, so other columns of any name do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termlens.llm.common import text_or_empty, written

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
BITS = 8
_LOW = (1 << (64 - BIN_BITS)) - 1
_SENTINELS = [(((b - BINS // 2) << (64 - BIN_BITS)) | _LOW) for b in range(BINS)]


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once (a lambda variable, which no optimizer rule copies)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bin(h: Column) -> Column:
    return F.shiftright(h, 64 - BIN_BITS)


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    words = F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")

    def of(hw: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(hw) - n),
                           lambda i: F.xxhash64(*[F.get(hw, i + k) for k in range(n)]))
        return F.when(F.size(hw) >= n, many).otherwise(F.array(F.xxhash64(hw, F.size(hw))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def signature(text: Column) -> Column:
    """array<smallint> of BINS values below 2^BITS."""
    low = (1 << BITS) - 1

    def empty(x: Column) -> Column:
        return x.bitwiseAND(F.lit(_LOW)) == F.lit(_LOW)

    def dense(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))

    def filled(d: Column) -> Column:
        def fill(full: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                order = F.array_min(F.transform(full, lambda y: F.xxhash64(i, _bin(y)).bitwiseAND(F.lit(~low)).bitwiseOR(
                    y.bitwiseAND(F.lit(low)))))
                return F.when(empty(x), order).otherwise(x).bitwiseAND(F.lit(low)).cast("smallint")
            return F.transform(d, one)
        return let(F.filter(d, lambda x: ~empty(x)), fill)

    marks = F.array(*[F.lit(x) for x in _SENTINELS])
    return let(F.sort_array(F.concat(shingle_hashes(text), marks)), lambda s: let(dense(s), filled))


def packed(sig: Column) -> Column:
    """The signature as lower-case hex, BITS bits a bin."""
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x.cast("long")), BITS // 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: share of equal bins less chance agreement, between 0 and 1."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / BINS
    chance = 2.0 ** -BITS
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same - chance) / (1 - chance)))


def succession(rows: DataFrame) -> DataFrame:
    """doc_id, k1, k2, n_chars, rank, and the next row's n1, n2, next_rank: order by descending doc_id, the last is followed by the first.

    Ranges of ids are ranked on their own and shifted by the rows of the ranges before them; only ids and hashes move.
    """
    by = [F.col("doc_id").desc_nulls_last(), F.col("k1").asc(), F.col("k2").asc()]
    ids = rows.select("doc_id", "k1", "k2", "n_chars")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = written(ids.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()), "id-ranges")
    n = ids.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = n.select("_part", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))   # one row a range
    total = ids.count()
    ranked = ids.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1).join(before, "_part").select(
        "doc_id", "k1", "k2", "n_chars", (F.col("_before") + F.col("_rn")).alias("rank"))
    ranked = written(ranked, "ranks")
    nxt = ranked.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("rank").alias("next_rank"))
    return ranked.join(nxt, F.col("next_rank") == (F.col("rank") + 1) % F.lit(max(total, 1)))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (one row per input row)."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"),
                       F.length("text").cast("long").alias("n_chars"))
    chain = written(succession(rows), "succession")
    if not chain.groupBy("k1", "k2").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["k1", "k2"])           # repeated rows: the chain has one row for each of them
    # the texts are dealt by their key once: both joins below use the same columns and so the same exchange
    t = rows.select("text", "k1", "k2")
    # what the row before needs of a text: its first floor(n_chars / 3) code points
    want = chain.select("doc_id", "n1", "n2", F.col("k1").alias("p1"), F.col("k2").alias("p2"), "rank", "next_rank", "n_chars")
    heads = t.join(want, (F.col("k1") == F.col("n1")) & (F.col("k2") == F.col("n2"))).select(
        "doc_id", "p1", "p2", "rank", "next_rank", "n_chars", F.substring("text", F.lit(1), F.floor(F.col("n_chars") / 3).cast("int")).alias("head"))
    both = t.join(heads, (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2")))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.col("head"))
    sig = both.select("doc_id", "rank", "next_rank", "n_chars", "text", edited.alias("edited")).select(
        "doc_id", "rank", "next_rank", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        signature(F.col("text")).alias("sig"), signature(F.col("edited")).alias("edited_sig"))
    sig = written(sig, "signatures")
    nxt = sig.select(F.col("rank").alias("_r"), F.col("sig").alias("next_sig"))
    out = sig.join(nxt, F.col("next_rank") == F.col("_r"))
    return out.select("doc_id", "n_chars", "edited_sha256", packed(F.col("sig")).alias("fingerprint"),
                      packed(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
                      likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))
