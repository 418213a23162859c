"""Bit-plane clustering and trie codes against plain versions."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from termlens.llm import bitplane, trie_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def kept(rows, dims):
    return [(i, v, x) for i, v, x in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]


def nearest(v, cs):
    d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cs]
    return d.index(min(d)), min(d)


def plain_clusters(rows, k, rounds, dims=64, scale=256, salt="2:"):
    rows = [(i, [math.floor(scale * float(c)) for c in v]) for i, v, _ in kept(rows, dims)]
    first = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), r[1]))
    cs = [list(v) for _, v in first[:k]]
    for _ in range(rounds):
        of = [nearest(v, cs)[0] for _, v in rows]
        for c in range(len(cs)):
            mine = [v for (_, v), o in zip(rows, of) if o == c]
            if mine:
                cs[c] = [sum(x) // len(mine) for x in zip(*mine)]
    got = [(i, *nearest(v, cs)) for i, v in rows]
    each = {c: sum(d for _, o, d in got if o == c) for c in range(len(cs))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return [(i, c, d, each[c], sum(each.values()), sha[c]) for i, c, d in got]


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096, dims=64):
    rows = [(i, [math.floor(scale * float(c)) for c in v], x) for i, v, x in kept(rows, dims)]
    w = -(-dims // parts)
    cut = [[(v + [0] * (w * parts - dims))[w * p:w * p + w] for p in range(parts)] for _, v, _ in rows]
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:entries]
    books = [[list(cut[k][p]) for k in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(c[p], books[p])[0] for c in cut]
            for e in range(len(first)):
                mine = [c[p] for c, o in zip(cut, of) if o == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for (i, _, label), c in zip(rows, cut):
        got = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for e, _ in got), sum(d for _, d in got), label))
    total = {x: sum(r[2] for r in out if r[3] == x) for x in {r[3] for r in out}}
    return [(i, c, e, total[x], sha) for i, c, e, x in out]


def key(r):
    return tuple((x is None, str(x)) for x in r)


def same(df, want):
    assert sorted([tuple(r) for r in df.collect()], key=key) == sorted(want, key=key)


def edge_rows(n=120, dims=64):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, dims)], int(i % 3) if i % 7 else None) for i in range(n)]
    hot = rows[5][1]
    rows += [(1000 + i, hot, 1) for i in range(n // 2)]                                  # a third is one vector
    rows += [rows[3], rows[3], (3, rows[4][1], 2), (None, rows[6][1], None), (None, rows[7][1], 0)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, rows[1][1][:-1], 1), (2003, rows[1][1] + [0.5], 1), (2004, [None, *rows[1][1][1:]], 1),
             (2005, [float("nan"), *rows[1][1][1:]], 1), (2006, [float("-inf"), *rows[1][1][1:]], None), (2007, [0.0] * dims, 1),
             (2008, [-1000.0] * dims, 1), (2009, [1000.25] * dims, 2)]
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    rows = edge_rows()
    clash = ["v", "q", "bits", "w0_b0", "cluster", "distance", "code", "error", "_l", "position", "n"]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return rows, df.withColumns({c: F.lit("x") for c in clash})


@pytest.mark.parametrize("d,lim", [(64, 130), (64, 2**27 - 1), (70, 5), (3, 1), (1, 0)])
def test_planes_give_exact_products(d, lim):
    rng = np.random.default_rng(d)
    q, c = rng.integers(-lim, lim + 1, (40, d)), rng.integers(-lim, lim + 1, (7, d))
    planes = int(lim).bit_length() + 1
    v, w = bitplane.planes_of(q, planes), bitplane.planes_of(c, planes)
    assert (bitplane.integers_of(v, d) == q).all() and (bitplane.dots(v, w) == q @ c.T).all() and (bitplane.squares(v) == (q * q).sum(1)).all()


def test_bit_plane_clusters(vectors):
    rows, df = vectors
    same(bitplane.cluster_report(df, k=7, rounds=3), plain_clusters(rows, 7, 3))
    same(bitplane.cluster_report(df), plain_clusters(rows, 40, 5))


def test_bit_plane_ties_go_to_the_smaller_centroid(spark):
    rows = [(i, [float(i % 2)] * 64, 0) for i in range(9)]                               # two vectors, centroids repeat
    df = spark.createDataFrame(rows, SCHEMA)
    same(bitplane.cluster_report(df, k=5, rounds=2), plain_clusters(rows, 5, 2))


def test_bit_planes_of_other_widths(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-50, 50, 70)], 0) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    same(bitplane.cluster_report(df, k=4, rounds=2, dims=70, scale=1, salt="a"), plain_clusters(rows, 4, 2, 70, 1, "a"))


def test_trie_walk_is_exact():
    rng = np.random.default_rng(0)
    for dims, spread in ((8, 3), (1, 50), (4, 2**27 - 1)):
        x = np.unique(rng.integers(-spread, spread + 1, (400, dims)), axis=0)
        e = rng.integers(-spread, spread + 1, (16, dims))
        assert (trie_codes.walk(x, e) == ((x[:, None] - e[None]) ** 2).sum(2)).all()
    assert trie_codes.walk(np.zeros((0, 8), np.int64), np.zeros((16, 8), np.int64)).shape == (0, 16)


def test_sortable_bytes():
    import pyarrow as pa
    q = np.random.default_rng(1).integers(-2**27 + 1, 2**27, (200, 6))
    b = [r.tobytes() for r in trie_codes._bytes_of(q)]
    assert (trie_codes._integers_of(pa.array(b, pa.binary()), 6) == q).all()
    assert sorted(range(200), key=lambda k: b[k]) == sorted(range(200), key=lambda k: tuple(q[k]))


def test_trie_codes(vectors):
    rows, df = vectors
    same(trie_codes.code_report(df), plain_codes(rows))


@pytest.mark.parametrize("dims,parts,entries", [(10, 4, 3), (64, 8, 300)])
def test_trie_codes_of_other_shapes(spark, dims, parts, entries):
    rng = np.random.default_rng(dims)
    rows = [(i, [float(x) / 4 for x in rng.integers(-8, 9, dims)], i % 2) for i in range(90)] + [(500, [1.0] * (dims + 1), 0)]
    entries = min(entries, 60)
    same(trie_codes.code_report(spark.createDataFrame(rows, SCHEMA), parts, entries, 2, 64), plain_codes(rows, parts, entries, 2, 64, dims))


def test_vectors_empty_null_and_single(spark):
    for rows in ([], [(1, None, 1), (2, [float("nan")] * 64, None), (None, [], 3)]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert bitplane.cluster_report(df).collect() == [] and trie_codes.code_report(df).collect() == []
    one = [(1, [0.25] * 64, None)]
    df = spark.createDataFrame(one, SCHEMA)
    same(bitplane.cluster_report(df), plain_clusters(one, 40, 5))
    same(trie_codes.code_report(df), plain_codes(one))
