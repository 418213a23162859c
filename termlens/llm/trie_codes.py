"""Vector code compression: product codes fitted and assigned over a lexicographic trie of distinct vector parts.

Every component becomes an integer floor(scale * x); a vector is cut into equal consecutive parts, each coded by its own small
codebook. For the fit, a Spark aggregate reduces all parts to the distinct ones of every position with their number (a part
that a third of all vectors share is one row, combined before the shuffle) and stores them in lexicographic order. The sorted
parts are the leaves of a trie over the dimensions: a node's vector of accumulated squared distances to all codebook entries
is its parent's plus one dimension's, so parts with a common prefix share it. The trie is walked depth first, a block
of consecutive leaves at a time: from the block's top level down, each new node is extended once. Leaves take the nearest
entry and add their weighted components to the entry's sums. A round is one pass over the distinct parts and returns sums of fixed
size; the final codes come from the same walk over the tries of small blocks of vectors, without a shuffle or join.

Edge cases: a null vector or a null, NaN or infinite component: the row is left out; vectors of another length than most kept
ones are left out too (lengths as frequent: the longer); a length that is no multiple of the number of parts is padded
with zero components, which change no distance; an empty table gives no rows; fewer vectors than entries: as many entries;
equal distances: the lower entry; repeated vec_ids at the start are ordered by their components, null vec_ids come last;
components beyond +-(2^27 - 1) after scaling are held there; a null label is a label like any other; only vec_id, label and the vector
are read, so other columns of any name do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.llm.common import written
from termlens.llm.vectors import integer_rows

LEAVES = 8192                # leaves of the trie walked at once
ROWS_AT_ONCE = 2048          # vectors coded at once
_ZERO = 1 << 31              # added, so that unsigned big-endian bytes sort like the integers


# ---------------------------------------------------------------- integers and parts

def _bytes_of(q: np.ndarray) -> np.ndarray:
    """Integer rows as sortable bytes: (rows, 4 * dims)."""
    return (q + _ZERO).astype(">u4").view(np.uint8).reshape(len(q), -1)


def _integers_of(col: pa.Array, dims: int) -> np.ndarray:
    """Back from a binary column (fixed width, no null)."""
    raw = np.frombuffer(b"".join(col.to_pylist()), dtype=">u4")
    return raw.astype(np.int64).reshape(-1, dims) - _ZERO


def _quantize_batches(batches: Iterator[pa.RecordBatch], dims: int, padded: int, scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, q in integer_rows(batch.column("v"), dims, scale):
            full = np.zeros((len(q), padded), dtype=np.int64)
            full[:, :dims] = q
            at = pa.array(rows)
            flat = pa.py_buffer(np.ascontiguousarray(_bytes_of(full)).tobytes())
            offs = pa.py_buffer((np.arange(len(q) + 1) * 4 * padded).astype(np.int32))
            col = pa.Array.from_buffers(pa.binary(), len(q), [None, offs, flat])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), col],
                                             names=["vec_id", "label", "q"])


def quantized(vectors: DataFrame, parts: int, scale: int, vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """Written table (vec_id, label, q) of the kept vectors as sortable bytes, and the components of a part."""
    src = vectors.select("vec_id", "label", F.col(vector_col).cast("array<double>").alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    common = src.where(F.col("v").isNotNull() & (F.size("v") > 0) & whole).groupBy(F.size("v").alias("d")).count().orderBy(
        F.desc("count"), F.desc("d")).first()                       # one row
    dims = common["d"] if common else parts
    width = -(-dims // parts)
    kinds = dict(src.dtypes)
    got = src.mapInArrow(lambda it: _quantize_batches(it, dims, width * parts, scale),
                         f"vec_id {kinds['vec_id']}, label {kinds['label']}, q binary")
    return written(got, "quantized"), width


def distinct_parts(q: DataFrame, parts: int, width: int) -> DataFrame:
    """Written table (position, part, n): the distinct parts with their number, in lexicographic order within every file."""
    size = 4 * width
    cut = [F.struct(F.lit(p).cast("byte").alias("position"), F.substring("q", p * size + 1, size).alias("part")) for p in range(parts)]
    rows = q.select(F.explode(F.array(*cut)).alias("x")).select("x.position", "x.part")
    return written(rows.groupBy("position", "part").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("position", "part"), "parts")


# ---------------------------------------------------------------- trie

def walk(leaves: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (leaves x entries) of lexicographically sorted, distinct parts; every trie node is computed once."""
    n, dims = leaves.shape
    if not n:
        return np.zeros((0, len(entries)), dtype=np.int64)
    differs = np.zeros((n, dims), dtype=bool)
    differs[0] = True
    differs[1:] = leaves[1:] != leaves[:-1]
    opens = np.logical_or.accumulate(differs, axis=1)         # a new node at this depth begins with this leaf
    node = np.zeros(n, dtype=np.int64)                        # every leaf's node at the depth above
    acc = np.zeros((1, len(entries)), dtype=np.int64)
    for d in range(dims):
        first = np.flatnonzero(opens[:, d])
        term = leaves[first, d][:, None] - entries[None, :, d]
        acc = acc[node[first]] + term * term                  # shared by all leaves below
        node = np.cumsum(opens[:, d]) - 1
    return acc


def _sums(label: np.ndarray, weighted: np.ndarray, n: np.ndarray, total: np.ndarray, count: np.ndarray) -> None:
    """Add weighted rows and numbers by label, exactly."""
    order = np.argsort(label, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], np.diff(label[order]) > 0]))
    at = label[order][cut]
    total[at] += np.add.reduceat(weighted[order], cut, axis=0)
    count[at] += np.add.reduceat(n[order], cut)


def _round_batches(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, entries, width = books.shape
    total = np.zeros_like(books)
    count = np.zeros((parts, entries), dtype=np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, LEAVES):
            block = batch.slice(at, LEAVES)
            x, n = _integers_of(block.column("part"), width), block.column("n").to_numpy()
            position = block.column("position").to_numpy()
            for p in np.unique(position):
                mine = np.flatnonzero(position == p)
                label = walk(x[mine], books[p]).argmin(axis=1).astype(np.int16)
                _sums(label, x[mine] * n[mine][:, None], n[mine], total[p], count[p])
    p, e = np.nonzero(count)
    if len(p):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(p, width).astype(np.int32)), pa.array(np.repeat(e, width).astype(np.int32)),
             pa.array(np.tile(np.arange(width), len(p)).astype(np.int32)), pa.array(total[p, e].ravel()),
             pa.array(np.repeat(count[p, e], width))], names=["position", "entry", "component", "total", "n"])


def fit(q: DataFrame, parts: int, width: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (parts, entries, width) after `rounds` rounds from the parts of the smallest vec_ids."""
    first = q.select("vec_id", "q").orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).collect()     # `entries` rows
    books = _integers_of(pa.array([r["q"] for r in first], pa.binary()), width).reshape(len(first), parts, width).transpose(1, 0, 2)
    if not len(first):
        return books
    table = distinct_parts(q, parts, width)
    for _ in range(rounds):
        held = np.ascontiguousarray(books)
        sums = table.mapInArrow(lambda it, b=held: _round_batches(it, b), "position int, entry int, component int, total long, n long")
        books = held.copy()
        for r in sums.groupBy("position", "entry", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("t"),
                                                                     F.sum("n").alias("n")).collect():   # parts x entries x width
            books[r["position"], r["entry"], r["component"]] = int(r["t"]) // int(r["n"])
    return np.ascontiguousarray(books)


def _code_batches(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, _, width = books.shape
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            block = batch.slice(at, ROWS_AT_ONCE)
            x = _integers_of(block.column("q"), width).reshape(block.num_rows, parts, width)
            codes = np.empty((block.num_rows, parts), dtype=np.uint8)
            error = np.zeros(block.num_rows, dtype=np.int64)
            for p in range(parts):
                mine = x[:, p]
                order = np.lexsort(mine.T[::-1])
                leaves = mine[order]
                new = np.concatenate([[True], (leaves[1:] != leaves[:-1]).any(axis=1)])
                d = walk(leaves[new], books[p])
                best = d.argmin(axis=1)
                leaf = np.cumsum(new) - 1                      # of every sorted row
                codes[order, p] = best[leaf]
                error[order] += d[np.arange(len(best)), best][leaf]
            text = codes.tobytes().hex()
            w = 2 * parts
            yield pa.RecordBatch.from_arrays(
                [block.column("vec_id"), block.column("label"), pa.array([text[k:k + w] for k in range(0, len(text), w)], pa.string()),
                 pa.array(error)], names=["vec_id", "label", "code", "error"])


def encode(q: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distance to the coded vector)."""
    kinds = dict(q.dtypes)
    return q.mapInArrow(lambda it: _code_batches(it, books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def code_report(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector."""
    q, width = quantized(vectors, parts, scale)
    books = fit(q, parts, width, entries, rounds)
    if not books.size:
        coded = q.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = written(encode(q, books), "codes")
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = coded.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_l"))).select(
        "vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
