"""Centroid clustering of integer vectors on bit planes.

Every component becomes an integer floor(scale * x). Bit b of 64 components is one unsigned 64-bit number, a plane; the planes of
a vector are its two's complement digits, the topmost one with a negative weight. The dot product of two vectors is the
weighted sum of popcounts of the ANDs of their planes, exact in integers, and the squared distance follows from three dot
products. The vectors are packed once into a written table of planes (planes above the highest used one equal the sign plane,
are stored as zero and never read back); a round is one pass over it: tasks keep, for every cluster, how often each bit of each
plane is set, and return sums of fixed size (clusters x components), so copies of one vector cost nothing but their own
assignment. Nothing else is shuffled, and the driver only ever holds the centroids.

Edge cases: a null vector, another number of components, a null, NaN or infinite component: the row is left out; an empty
table gives no rows; fewer vectors than centroids: as many centroids; repeated rows are assigned each; equal distances: the
smaller centroid; equal vec_ids at the start are ordered by their components, null vec_ids come last; components beyond
+-(2^27 - 1) after scaling are held there; only vec_id and the vector are read, so other columns of any name do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.llm.common import written
from termlens.llm.vectors import integer_rows

PLANES = 28                  # planes of a component, sign included
WORD = 64                    # components of one plane number
ROWS_AT_ONCE = 1024


# ---------------------------------------------------------------- planes

def planes_of(q: np.ndarray, planes: int = PLANES) -> np.ndarray:
    """(rows, words, planes) unsigned 64-bit planes of integer rows (padded with zero components)."""
    n, d = q.shape
    words = -(-d // WORD)
    full = np.zeros((n, words * WORD), dtype=np.int64)
    full[:, :d] = q
    out = np.empty((n, words, planes), dtype=np.uint64)
    for b in range(planes):
        bits = ((full >> b) & 1).astype(np.uint8)
        out[:, :, b] = np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(n, words)
    return out


def integers_of(planes: np.ndarray, dims: int) -> np.ndarray:
    """Back from planes to integer rows."""
    n, words, count = planes.shape
    out = np.zeros((n, words * WORD), dtype=np.int64)
    for b in range(count):
        bits = np.unpackbits(np.ascontiguousarray(planes[:, :, b]).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").astype(np.int64)
        out += bits * (-(1 << b) if b == count - 1 else 1 << b)
    return out[:, :dims]


def dots(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact dot products (rows of v x rows of c) from planes, by popcounts of ANDs; the top plane counts negative."""
    n, words, top = len(v), v.shape[1], v.shape[2] - 1
    total = np.zeros((n, len(c)), dtype=np.int64)
    inner = np.empty_like(total)
    both = np.empty((n, len(c)), dtype=np.uint64)
    ones = np.empty((n, len(c)), dtype=np.uint8)
    for i in range(top, -1, -1):                 # Horner over the planes of both sides
        inner[:] = 0
        for j in range(top, -1, -1):
            inner <<= 1
            for w in range(words):
                np.bitwise_and(v[:, w, i, None], c[None, :, w, j], out=both)
                np.bitwise_count(both, out=ones)
                if j == top:
                    inner -= ones
                else:
                    inner += ones
        total <<= 1
        if i == top:
            total -= inner
        else:
            total += inner
    return total


def squares(v: np.ndarray) -> np.ndarray:
    """Exact squared length of every row, from its own planes."""
    top = v.shape[2] - 1
    total = np.zeros(len(v), dtype=np.int64)
    for i in range(top + 1):
        for j in range(i, top + 1):
            ones = np.bitwise_count(v[:, :, i] & v[:, :, j]).sum(axis=1, dtype=np.int64) << (i + j + (i != j))
            total += -ones if i != j and j == top else ones
    return total


# ---------------------------------------------------------------- packed table

def _names(words: int) -> list[list[str]]:
    return [[f"w{w}_b{b}" for b in range(PLANES)] for w in range(words)]


def _pack_batches(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, q in integer_rows(batch.column("v"), dims, scale):
            p = planes_of(q)
            sign = p[:, :, -1]
            need = np.bitwise_or.reduce(q ^ (q >> 63), axis=1) if len(q) else np.zeros(0, np.int64)
            bits = np.frexp(need.astype(np.float64))[1].astype(np.int32) + 1           # digits and the sign
            cols, names = [batch.column("vec_id").take(pa.array(rows)), pa.array(bits)], ["vec_id", "bits"]
            for w, ws in enumerate(_names(p.shape[1])):
                for b, name in enumerate(ws):
                    x = sign[:, w] if b == PLANES - 1 else p[:, w, b] ^ sign[:, w]
                    cols.append(pa.array(np.ascontiguousarray(x).view(np.int64)))
                    names.append(name)
            yield pa.RecordBatch.from_arrays(cols, names=names)


def pack_planes(vectors: DataFrame, dims: int, scale: int, vector_col: str = "embedding") -> DataFrame:
    """vec_id, bits (planes the row needs) and one long per plane: the plane XOR the sign plane, the sign itself last."""
    src = vectors.select("vec_id", F.col(vector_col).cast("array<double>").alias("v"))
    kind = dict(src.dtypes)["vec_id"]
    cols = ", ".join(f"{c} long" for ws in _names(-(-dims // WORD)) for c in ws)
    return written(src.mapInArrow(lambda it: _pack_batches(it, dims, scale), f"vec_id {kind}, bits int, {cols}"), "planes")


def _planes(batch: pa.RecordBatch, planes: int, words: int) -> np.ndarray:
    out = np.empty((batch.num_rows, words, planes), dtype=np.uint64)
    for w, ws in enumerate(_names(words)):
        sign = batch.column(ws[-1]).to_numpy().view(np.uint64)
        out[:, w, planes - 1] = sign
        for b in range(planes - 1):
            out[:, w, b] = batch.column(ws[b]).to_numpy().view(np.uint64) ^ sign
    return out


def _nearest(v: np.ndarray, c: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = c2[None, :] - 2 * dots(v, c)
    k = d.argmin(axis=1)
    return k, d[np.arange(len(k)), k] + squares(v)


def _blocks(batches: Iterator[pa.RecordBatch], planes: int, words: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            yield part, _planes(part, planes, words)


def _sum_batches(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, planes: int) -> Iterator[pa.RecordBatch]:
    """Per cluster and component: sum and number of the task's vectors, from how often every bit is set."""
    k, dims = centroids.shape
    c = planes_of(centroids, planes)
    words = c.shape[1]
    c2 = squares(c)
    bits = np.zeros((k, planes, words * WORD), dtype=np.int64)
    n = np.zeros(k, dtype=np.int64)
    for _, v in _blocks(batches, planes, words):
        label, _ = _nearest(v, c, c2)
        mine = (label[None, :] == np.arange(k)[:, None]).astype(np.float32)            # counts below 2^24: exact
        for b in range(planes):
            on = np.unpackbits(np.ascontiguousarray(v[:, :, b]).view(np.uint8).reshape(len(v), -1), axis=1, bitorder="little")
            bits[:, b] += (mine @ on.astype(np.float32)).astype(np.int64)
        n += np.bincount(label, minlength=k)
    weight = np.array([1 << b for b in range(planes - 1)] + [-(1 << (planes - 1))], dtype=np.int64)
    total = (bits * weight[None, :, None]).sum(axis=1)[:, :dims]
    at = np.flatnonzero(n)
    if len(at):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(at, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims), len(at)).astype(np.int32)),
             pa.array(total[at].ravel()), pa.array(np.repeat(n[at], dims))], names=["cluster", "component", "total", "n"])


def _assign_batches(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, planes: int) -> Iterator[pa.RecordBatch]:
    c = planes_of(centroids, planes)
    c2 = squares(c)
    for part, v in _blocks(batches, planes, c.shape[1]):
        label, dist = _nearest(v, c, c2)
        yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(label.astype(np.int32)), pa.array(dist)],
                                         names=["vec_id", "cluster", "distance"])


# ---------------------------------------------------------------- clustering

@dataclass
class Clustering:
    centroids: np.ndarray        # (clusters, components) integers
    assigned: DataFrame          # vec_id, cluster, distance


def first_centroids(packed: DataFrame, k: int, order: Column, dims: int) -> np.ndarray:
    names = [c for ws in _names(-(-dims // WORD)) for c in ws]
    rows = packed.select("vec_id", order.alias("_o"), *names).orderBy(F.asc_nulls_last("_o"), *names).limit(k).collect()     # k rows
    if not rows:
        return np.zeros((0, dims), dtype=np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in names], names=names)
    return integers_of(_planes(batch, PLANES, -(-dims // WORD)), dims)


def cluster(vectors: DataFrame, k: int, rounds: int, seed_order: Column, dims: int = 64, scale: int = 256,
            vector_col: str = "embedding") -> Clustering:
    """Lloyd rounds from the `k` vectors that come first by `seed_order` (an expression over vec_id)."""
    packed = pack_planes(vectors, dims, scale, vector_col)
    centroids = first_centroids(packed, k, seed_order, dims)
    if not len(centroids):
        return Clustering(centroids, packed.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")))
    planes = int(packed.agg(F.max("bits")).first()[0])          # a mean needs no more digits than its members
    words = -(-dims // WORD)
    read = ["vec_id", *[c for ws in _names(words) for c in [*ws[:planes - 1], ws[-1]]]]
    packed = packed.select(*read)
    for _ in range(rounds):
        held = centroids
        sums = packed.mapInArrow(lambda it, c=held: _sum_batches(it, c, planes), "cluster int, component int, total long, n long")
        centroids = held.copy()
        for r in sums.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("t"),
                                                          F.sum("n").alias("n")).collect():     # clusters x components
            centroids[r["cluster"], r["component"]] = int(r["t"]) // int(r["n"])
    kind = dict(packed.dtypes)["vec_id"]
    last = centroids
    assigned = packed.mapInArrow(lambda it: _assign_batches(it, last, planes), f"vec_id {kind}, cluster int, distance long")
    return Clustering(centroids, written(assigned, "clusters"))


def cluster_report(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    got = cluster(vectors, k, rounds, order, dims, scale)
    sums = {r["cluster"]: int(r["d"]) for r in got.assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}                   # one row a cluster
    each = [sums.get(c, 0) for c in range(len(got.centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in got.centroids.tolist()]
    at = F.col("cluster") + 1

    def by_cluster(values: list, kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]).cast(f"array<{kind}>"), at) if values else F.lit(None).cast(kind)

    return got.assigned.select("vec_id", "cluster", "distance", by_cluster(each, "long").alias("cluster_inertia"),
                               F.lit(sum(each)).cast("long").alias("inertia"), by_cluster(sha, "string").alias("centroid_sha256"))
