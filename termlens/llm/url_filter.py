"""URL filter: host / path rules, then a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

The filter is a Spark table of blocks (block number, four 64-bit words). A URL's hash picks one block and one bit in each of its
words; building is `bit_or` per block (combined map-side, so a hot block costs nothing), probing is one broadcast
join on the block number and four ANDs, all in generated code. The number of blocks is bounded by `max_blocks`, which bounds the
broadcast; a list too long for it only passes more false positives to the exact join, never a wrong verdict.

Edge cases: a null URL or one without `://` has empty host and path, no rule, no canonical form and is allowed; an
empty list blocks nothing; repeated rows stay repeated; every input column is kept unless it clashes with an output
column, in which case the output wins; rules of equal length for one URL cannot differ in their verdict (a host and path name
one rule); very long URLs are judged whole by linear patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.llm.common import ascii_lower, written

BLOCK_WORDS = 4
URLS_PER_BLOCK = 24          # about 10.7 bits a URL
MAX_BLOCKS = 1 << 18         # 40 bytes a block: a broadcast of 10 MB at most
MAX_RULES = 256              # rules are inlined as one expression

#: fixed values: query parameters that only track visits
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid")
#: fixed values: host prefixes that serve the same page
MIRRORS = ("www.", "m.")


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2147483647))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def canonical(url: Column, host: Column, path: Column) -> Column:
    """host without mirror prefix + path without trailing slash + query without tracking parameters; scheme and
    fragment dropped. Null when the URL has no host."""
    h = F.regexp_replace(host, "^(?:" + "|".join(m.replace(".", r"\.") for m in MIRRORS) + ")", "")
    q = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    names = "|".join(TRACKING)
    q = F.array_join(F.filter(F.split(q, "&"), lambda p: (p != "") & ~p.rlike(f"^(?:{names})(?:=|$)")), "&")
    return F.when(host != "", F.concat(h, F.regexp_replace(path, "/+$", ""),
                                       F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))))


def rule_column(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict); rules are (verdict, host, path)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: list them as URLs instead")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _bits(key: Column, blocks: int) -> list[Column]:
    """Block number and one mask per word from two hashes of the key."""
    h1, h2 = F.xxhash64(key), F.xxhash64(key, F.lit(7))
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h2, 6 * i), F.lit(64)).cast("int"))
             for i in range(BLOCK_WORDS)]
    return [F.pmod(h1, F.lit(blocks)).cast("int").alias("blk")] + [m.alias(f"m{i}") for i, m in enumerate(masks)]


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(b_blk, w0..w3): the blocked Bloom filter of `keys`, at most `blocks` rows."""
    bits = keys.select(*_bits(F.col(key), blocks))
    return bits.groupBy(F.col("blk").alias("b_blk")).agg(
        *[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(BLOCK_WORDS)])


def url_filter(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id",
               url_col: str = "url", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Judge every URL: the longest fitting rule decides, else block exactly the listed canonical URLs.

    `listed` has one column `canonical`. Returns id, host, path, canonical, rule, verdict, possible (Bloom answer).
    """
    host, path = host_path(F.col(url_col))
    p = pages.select(F.col(id_col), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    p = p.withColumn("canonical", canonical(F.col("_url"), F.col("host"), F.col("path")))
    p = p.withColumn("_r", rule_column(F.col("host"), F.col("path"), rules)).drop("_url")
    listed = written(listed.select("canonical").where("canonical IS NOT NULL").distinct(), "listed")
    blocks = min(max_blocks, max(1, -(-listed.count() // URLS_PER_BLOCK)))
    bloom = bloom_blocks(listed, "canonical", blocks)      # at most `blocks` rows of 40 bytes: bounded broadcast
    probe = p.where("_r IS NULL AND canonical IS NOT NULL").select(id_col, "canonical", *_bits(F.col("canonical"), blocks))
    hit = F.lit(True)
    for i in range(BLOCK_WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) != 0)
    possible = probe.join(F.broadcast(bloom), F.col("blk") == F.col("b_blk")).where(hit).select("canonical").distinct()
    blocked = possible.join(listed, "canonical", "left_semi").withColumn("_blocked", F.lit(True))
    out = p.join(blocked, "canonical", "left")
    return out.select(
        id_col, "host", "path", "canonical", F.col("_r.rule").alias("rule"),
        F.coalesce(F.col("_r.verdict"), F.when(F.col("_blocked"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
