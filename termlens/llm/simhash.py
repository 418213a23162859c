"""SimHash near-duplicate detection with sharded BK-trees.

Fingerprints come from one pass over the texts. Only distinct fingerprints take part in the search. Two fingerprints
within `radius` bits agree on at least `blocks - radius` of `blocks` bit blocks, so a shard is one choice of agreeing
blocks with its value: pairs never leave their shards, and the search is exact. Each shard gets a BK-tree (children
keyed by the Hamming distance to the parent); a query follows only edges within the radius. Shards above `tile` are
split into tile pairs: every tile's tree meets the queries of every other tile of that shard, so no task holds more
than two tiles. A tile returns the edges of a spanning forest (fewer than its rows), never all pairs; the
components are found by star contraction in Spark.

Edge cases: null text = empty text = no words = fingerprint zero (linked like any other); fewer words than a shingle:
the whole sequence is the one shingle; repeated rows share a fingerprint; a null doc_id never becomes a component id unless all
ids of the component are null.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.llm.common import components, shielded, unshielded, written

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 2048
SHARD_ROWS = 64             # wanted rows of a shard if fingerprints were even
HASHES_AT_ONCE = 1 << 16


def shingle_hashes(text: bytes, n: int = SHINGLE) -> list[int]:
    """XXH64 (seed 42) of every n-word shingle of the lower-cased words, repeats included."""
    words = text.lower().split()             # bytes: A-Z and ASCII white space only
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= n:
        return [h(b" ".join(words), SEED)]
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return [h(line[a:b - 1], SEED) for a, b in zip(starts, ends[n - 1:])]


def _flush(hashes: list[int], sizes: list[int], out: list[int]) -> None:
    """Majority bits of each document's hashes."""
    if not sizes:
        return
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1) if hashes else np.zeros((0, 64), np.uint8)
    full = [k for k, n in enumerate(sizes) if n]
    got = np.zeros((len(sizes), 64), dtype=np.int64)
    if full:
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])[full]
        got[full] = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    major = got * 2 > np.array(sizes)[:, None]
    out += np.packbits(major, axis=1).reshape(-1, 8).view(">u8").ravel().astype(np.uint64).view(np.int64).tolist()


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[int] = []
        hashes: list[int] = []
        sizes: list[int] = []
        for t in b.column("_text"):
            got = shingle_hashes((t.as_py() or "").encode(), n)
            hashes += got
            sizes.append(len(got))
            if len(hashes) >= HASHES_AT_ONCE:
                _flush(hashes, sizes, out)
                hashes, sizes = [], []
        _flush(hashes, sizes, out)
        names = [c for c in b.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.int64())], names=[*names, "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text_col: str = "text") -> DataFrame:
    """The non-text columns of `docs` + fp (64-bit fingerprint as a signed long, in place of a column of that name)."""
    rest = [c for c in docs.columns if c not in (text_col, "fp", "component")]
    src = docs.select(*rest, F.col(text_col).cast("string").alias("_text"))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema), "fp long"])
    return src.mapInArrow(lambda it: _fingerprint_batches(it, shingle), ddl)


class BKTree:
    """Burkhard-Keller tree over 64-bit integers under Hamming distance."""

    def __init__(self):
        self.root: tuple[int, dict] | None = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ x).bit_count()
            child = node[1].get(d)
            if child is None:
                node[1][d] = (x, {})
                return
            node = child

    def within(self, x: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                found.append(value)
            if children:
                for k, child in children.items():
                    if d - radius <= k <= d + radius:
                        todo.append(child)
        return found


def _find(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def shard_forest(tree_side: list[int], query_side: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Spanning-forest edges of the links inside one tile (query_side None) or between two tiles."""
    parent: dict[int, int] = {}
    edges = []

    def link(a: int, b: int) -> None:
        ra, rb = _find(parent, parent.setdefault(a, a)), _find(parent, parent.setdefault(b, b))
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            edges.append((a, b))

    tree = BKTree()
    for x in tree_side:
        if query_side is None:
            for y in tree.within(x, radius):
                link(x, y)
        tree.add(x)
    for x in query_side or ():
        for y in tree.within(x, radius):
            link(x, y)
    return edges


def _search_shards(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, t1, t2, side): one run is one tile or tile pair (side 0 builds the tree, 1 queries)."""
    key, sides = None, ([], [])

    def done():
        if key is None or len(sides[0]) + len(sides[1]) < 2:
            return []
        t1, t2 = key[1], key[2]
        return shard_forest(sides[0], None if t1 == t2 else sides[1], radius)

    for b in batches:
        edges: list[tuple[int, int]] = []
        cols = [b.column(c).to_pylist() for c in ("shard", "t1", "t2", "side", "fp")]
        for shard, t1, t2, side, fp in zip(*cols):
            if (shard, t1, t2) != key:
                edges += done()
                key, sides = (shard, t1, t2), ([], [])
            sides[side].append(fp & 0xFFFFFFFFFFFFFFFF)
        yield _edge_batch(edges)
    yield _edge_batch(done())


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    arr = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(arr[:, 0]), pa.array(arr[:, 1])], names=["a", "b"])


def block_choices(n: int, radius: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Bit blocks (shift, width) and the block sets to agree on, so that even shards hold about SHARD_ROWS of n rows."""
    for agree in range(1, 7):
        blocks = radius + agree
        cuts = [64 * k // blocks for k in range(blocks + 1)]
        least = min(b - a for a, b in zip(cuts, cuts[1:])) * agree
        if n <= SHARD_ROWS << least or agree == 6:
            return [(a, b - a) for a, b in zip(cuts, cuts[1:])], list(itertools.combinations(range(blocks), agree))
    raise AssertionError


def near_edges(fps: DataFrame, n: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Spanning-forest edges (a, b) of all links between distinct fingerprints `fps` (one column fp, n rows)."""
    if radius == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    blocks, choices = block_choices(n, radius)
    keys = []
    for c, choice in enumerate(choices):
        parts = [F.shiftrightunsigned("fp", blocks[k][0]).bitwiseAND(F.lit((1 << blocks[k][1]) - 1)) for k in choice]
        keys.append(F.xxhash64(F.lit(c), *parts))
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("shard"))
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile).select(
        "shard", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    rows = rows.join(sizes, "shard", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("tiles")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("shard", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"),
                       (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")
    parts = fps.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = rows.repartition(int(parts), "shard", "t1", "t2").sortWithinPartitions("shard", "t1", "t2")
    return rows.mapInArrow(lambda it: _search_shards(it, radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, text_col: str = "text") -> DataFrame:
    """The non-text columns of `docs` + fp + component (a fingerprint), one row per input row."""
    fp = written(fingerprints(docs, shingle, text_col), "simhash")
    distinct = written(fp.select("fp").distinct(), "fps")
    edges = near_edges(distinct, distinct.count(), radius)
    comp = components(edges)
    return fp.join(comp.select(F.col("node").alias("_node"), "component"), F.col("fp") == F.col("_node"), "left").drop(
        "_node").withColumn("component", F.coalesce("component", "fp"))


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the component)."""
    got = written(near_duplicates(docs.select("doc_id", "text"), shingle, radius), "linked")
    least = got.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return got.join(least, "component").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each near-duplicate group (the smallest doc_id; one without doc_id only where no other is in the group),
    columns unchanged; of repeated rows one stays. Rows without doc_id are told apart by their texts."""
    th = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    got = near_duplicates(docs.select("doc_id", th.alias("_th"), "text"), shingle, radius)
    keep = got.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th")).alias("k")).select(
        F.col("k.doc_id").alias("_id"), F.col("k._th").alias("_kth"))
    rows = shielded(docs, "doc_id", "text").withColumn("_th", th).drop("text")
    kept = rows.join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_kth")), "left_semi")
    return unshielded(kept.dropDuplicates(["doc_id", "_th"]), docs)
