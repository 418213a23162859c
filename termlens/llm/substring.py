"""Removal of long repeated word spans by compaction of a sparse De Bruijn graph.

A window of `width` words is repeated if its words also start anywhere else. Every window holds at least one selected
k-mer: the k-mer of least hash among the `width - k + 1` of some window (a minimizer), which depends on the words alone.
Selected k-mers are the vertices; the words from one vertex to the next of a text are an edge, labelled by its
hash. A Spark aggregate over all occurrences finds the vertices that occur again and those that do not branch: every
occurrence has the same edge in and the same edge out. Texts meet these flags in a join, and each text's
own coordinates compact consecutive non-branching vertices into paths. A window that lies on such a path and whose
own minimizer is one of its inner vertices is repeated without a further look, because every occurrence of that vertex carries
the whole path. The remaining windows with a repeated minimizer (path ends, branches) are verified one by one: equal 128-bit
window hashes are counted in Spark and joined back. Copies thus cost a few rows each, not a row a word, and no group
of equal windows is ever gathered in one task (counts are combined map-side, hot join keys are left to the skew join).

Edge cases: null text = no words; fewer words than a window: nothing is removed; repeated rows are each other's copies;
overlapping repeats within one text count like any other; rows with equal doc_id are told apart by a hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.llm import words as W
from termlens.llm.common import text_or_empty, written

WIDTH = 35
KMER = 12


def _own(wh: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Position of every window's minimizer (ties: the last), and all k-mer hashes."""
    kh = W.window_hashes(wh, k)
    w = width - k + 1
    if len(kh) < w:
        return np.zeros(0, np.int64), kh
    sv = sliding_window_view(kh[::-1], w)
    return (len(kh) - 1 - (np.arange(len(sv)) + sv.argmin(axis=1)))[::-1], kh


def _texts(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bytes of the slice, word starts, word ends, word hashes) of every text."""
    for i, j, buf, offs in W.slices(col):
        s, e, first = W.word_spans(buf, offs, W.SPACE_WORDS)
        wh = W.word_hashes(buf, s, e)
        for r in range(j - i):
            a, b = first[r], first[r + 1]
            yield i + r, buf, s[a:b], e[a:b], wh[a:b]


def _edge_labels(wh: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Label of the words from each selected k-mer to the end of the next one."""
    n = len(wh)
    pre = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(W.mix(wh) * W.powers(W._R, n), out=pre[1:])
    h = (pre[at[1:] + k] - pre[at[:-1]]) * W.powers(W.inverse(W._R), n)[at[:-1]]
    h = W.mix(h ^ (at[1:] - at[:-1]).astype(np.uint64))
    return np.where(h == 0, np.uint64(1), h)


def _vertex_batches(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, pos, vertex, ein, eout = [], [], [], [], []
        for r, _, _, _, wh in _texts(b.column("text")):
            if len(wh) < width:
                continue
            own, kh = _own(wh, width, k)
            at = np.unique(own)
            lab = _edge_labels(wh, at, k)
            row.append(np.full(len(at), r))
            pos.append(at)
            vertex.append(kh[at])
            ein.append(np.concatenate([[np.uint64(0)], lab]))
            eout.append(np.concatenate([lab, [np.uint64(0)]]))
        if not row:
            continue
        take = pa.array(np.concatenate(row))
        cat = lambda x: pa.array(np.concatenate(x).astype(np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").take(take), b.column("th").take(take), pa.array(np.concatenate(pos).astype(np.int32)),
             cat(vertex), cat(ein), cat(eout)], names=["doc_id", "th", "pos", "vertex", "ein", "eout"])


def _marks(wh: np.ndarray, width: int, k: int, at: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all window starts: sure (repeated as part of a path) and open (to verify).

    `at` are the positions of the text's repeated vertices in order, `inner` says which of them do not branch. A window's
    own minimizer is a vertex wherever the window stands, so if that vertex does not branch and the window lies on its path,
    every occurrence of the vertex brings an occurrence of the window.
    """
    own, kh = _own(wh, width, k)
    repeated = np.zeros(len(kh), dtype=bool)
    repeated[at] = True
    lo = np.ones(len(kh), dtype=np.int64)              # a path's first and last window start; none: empty
    hi = np.zeros(len(kh), dtype=np.int64)
    idx = np.flatnonzero(inner)
    if len(idx):
        # a path is vertex a, then inner vertices, then vertex b (an inner vertex's neighbours are repeated too)
        run = np.cumsum(np.concatenate([[0], np.diff(idx) > 1]))
        first = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
        last = np.concatenate([first[1:] - 1, [len(idx) - 1]])
        lo[at[idx]] = at[np.maximum(idx[first] - 1, 0)][run]
        hi[at[idx]] = (at[np.minimum(idx[last] + 1, len(at) - 1)] + k - width)[run]
    start = np.arange(len(own))
    sure = (start >= lo[own]) & (start <= hi[own])
    return sure, repeated[own] & ~sure


def _vertices_of(flags) -> tuple[np.ndarray, np.ndarray]:
    v = np.unique(np.array(flags, dtype=np.int64))           # pos * 2 + inner, repeated rows collapse
    return v >> 1, (v & 1).astype(bool)


def _open_batches(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """One row per text and distinct window to verify: its 128-bit hash and how often it starts in the text."""
    for b in batches:
        flags = b.column("flags").to_pylist()
        row, h1s, h2s, ns = [], [], [], []
        for r, buf, s, e, wh in _texts(b.column("text")):
            if len(wh) < width or not flags[r]:
                continue
            _, todo = _marks(wh, width, k, *_vertices_of(flags[r]))
            p = np.flatnonzero(todo)
            if not len(p):
                continue
            h1, h2 = W.window_hashes(wh, width)[p], W.second_window_hashes(W.word_hashes(buf, s, e, 1), width)[p]
            order = np.lexsort((h2, h1))
            h1, h2 = h1[order], h2[order]
            i = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
            row.append(np.full(len(i), r))
            h1s.append(h1[i])
            h2s.append(h2[i])
            ns.append(np.diff(np.append(i, len(h1))))
        if not row:
            continue
        take = pa.array(np.concatenate(row))
        cat = lambda x: pa.array(np.concatenate(x).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("th").take(take), cat(h1s), cat(h2s),
                                          pa.array(np.concatenate(ns).astype(np.int64))], names=["doc_id", "th", "h1", "h2", "n"])


def _remove_batches(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flags, again = b.column("flags").to_pylist(), b.column("again").to_pylist()
        n_words, n_removed, kept_sha, texts = [], [], [], []
        for r, buf, s, e, wh in _texts(b.column("text")):
            n = len(wh)
            gone = np.zeros(n + 1, dtype=np.int32)
            if n >= width and flags[r]:
                sure, todo = _marks(wh, width, k, *_vertices_of(flags[r]))
                if again[r]:
                    p = np.flatnonzero(todo)
                    # both hashes were compared over all texts; within one text the first tells its windows apart
                    sure[p[np.isin(W.window_hashes(wh, width)[p].view(np.int64), np.array(again[r], dtype=np.int64))]] = True
                p = np.flatnonzero(sure)
                np.add.at(gone, p, 1)
                np.add.at(gone, p + width, -1)
            removed = np.cumsum(gone[:n]) > 0
            keep = np.flatnonzero(~removed)
            raw = buf[s[0]:e[-1]].tobytes() if n else b""
            if len(keep) == n:
                kept = b" ".join(raw.split())
            else:
                o = int(s[0])
                kept = b" ".join([raw[x - o:y - o] for x, y in zip(s[keep].tolist(), e[keep].tolist())])
            n_words.append(n)
            n_removed.append(n - len(keep))
            kept_sha.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_sha, pa.string()),
             pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def path_vertices(docs: DataFrame, width: int = WIDTH, k: int = KMER) -> DataFrame:
    """doc_id, th, flags: the repeated vertices of every text that has any, as positions * 2 + (does not branch)."""
    kind = dict(docs.dtypes)["doc_id"]
    occ = docs.select("doc_id", "th", "text").mapInArrow(
        lambda it: _vertex_batches(it, width, k), f"doc_id {kind}, th long, pos int, vertex long, ein long, eout long")
    occ = written(occ, "vertices")
    ends = [F.min(c).alias(f"min_{c}") for c in ("ein", "eout")] + [F.max(c).alias(f"max_{c}") for c in ("ein", "eout")]
    v = occ.groupBy("vertex").agg(F.count(F.lit(1)).alias("n"), *ends).where("n > 1").select(
        F.col("vertex").alias("v"), ((F.col("min_ein") == F.col("max_ein")) & (F.col("max_ein") != 0)
                                   & (F.col("min_eout") == F.col("max_eout")) & (F.col("max_eout") != 0)).alias("inner"))
    hit = occ.select("doc_id", "th", "pos", "vertex").join(v, F.col("vertex") == F.col("v"))
    flag = F.col("pos") * 2 + F.col("inner").cast("int")
    return hit.groupBy("doc_id", "th").agg(F.collect_set(flag).alias("flags"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, k: int = KMER) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept: the texts without the words of repeated windows."""
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("th", F.xxhash64("text"))
    flags = written(path_vertices(rows, width, k), "path-vertices").select(
        F.col("doc_id").alias("d"), F.col("th").alias("t"), "flags")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))
    kind = dict(rows.dtypes)["doc_id"]
    open_ = rows.join(flags, same).select("doc_id", "th", "text", "flags").mapInArrow(
        lambda it: _open_batches(it, width, k), f"doc_id {kind}, th long, h1 long, h2 long, n long")
    open_ = written(open_, "windows")
    often = open_.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("h1").alias("a"), F.col("h2").alias("b"))
    again = open_.join(often, (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b"))).groupBy("doc_id", "th").agg(
        F.collect_set("h1").alias("again"))
    marks = flags.join(again, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th")), "left").select("d", "t", "flags", "again")
    out = rows.join(marks, same, "left").select("doc_id", "text", "flags", "again")
    return out.mapInArrow(lambda it: _remove_batches(it, width, k),
                          f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
