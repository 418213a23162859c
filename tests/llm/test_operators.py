"""Every training-data operator against a plain version, on edge rows and on the smallest table."""

from __future__ import annotations

import zlib

import brute
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from termlens.llm import (common, decontaminate, fingerprint, language_id, lm_score, packing, pii, queries, sharding, simhash,
                          substring, url_filter)

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path(queries.TOKENIZER)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def key(x):
    return tuple((v is None, str(v)) for v in x)


def same_rows(got, want):
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.fixture(scope="module", params=["docs", "sample"])
def table(request):
    return request.getfixturevalue(request.param)


@pytest.fixture(scope="module")
def plain(table):
    return [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- helpers

def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (202, 200), (300, 300)]
    got = dict(rows_of(common.components(spark.createDataFrame(edges, "a long, b long"))))
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))
    assert got[201] == got[202] == 200 and common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranks_have_no_gap(spark):
    df = common.written(spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k")), "t")
    got = common.ranked(df, ["k"], ["id"], ["id"], 2000, "r").toPandas()
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("k").r)


def test_missing_shared_folder_is_local_only(spark):
    assert common.shared_dir(spark)


def thue_morse(n, x, y):
    """Equal under every polynomial hash modulo 2^64 to its mirror image once n is large."""
    bits = [i.bit_count() % 2 for i in range(n)]
    return "".join((x, y)[b] for b in bits), "".join((y, x)[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_collide_under_polynomial_hashes(spark, n):
    a, b = thue_morse(n, "a", "b")
    head, tail = " ".join(f"w{i}" for i in range(20)), " ".join(f"v{i}" for i in range(20))
    texts = [f"{head} {a} {tail}", f"{head} {b} {tail}", a, b]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same_rows(rows_of(substring.remove_repeats(df).drop("kept")), [(d, *x) for d, x in enumerate(brute.repeats(texts))])
    items = [(1, "x " * 5 + a + " y" * 4), (2, "x " * 5 + b + " y" * 4)]
    hay = [(1, items[0][1]), (2, "z " + items[1][1])]
    got = decontaminate.decontamination_report(spark.createDataFrame(hay, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    same_rows(rows_of(got), [(d, *(c := brute.contamination(t, items)), c[1] > 0) for d, t in hay])
    lm = {r["doc_id"]: r["n_known"] for r in lm_score.score(df.where("doc_id >= 2"), F.col("doc_id") == 3).collect()}
    assert lm == {2: 2, 3: 1}


def test_suffix_buckets_hold_all_patterns_of_a_key():
    p = decontaminate.Patterns(2, ["a b", "c d", "e f"], [["1"], ["2"], ["3"]])
    p.keys[:] = p.keys[0]                                  # as if all three windows had one key
    p._keys_at = lambda wh, start: np.full(len(start), p.keys[0])
    for k, w in enumerate(p.words):
        start, pat = p.find(np.concatenate([w, w]), np.array([0, 4]))
        assert set(zip(start.tolist(), pat.tolist())) == {(0, k), (2, k)}


# ---------------------------------------------------------------- op1

def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.net/EN/", "http://a.example.net/en/x?y#z", "https://example.com/de/", "https://x.example.com/de",
            "ftp://some.org/fr/1", "http://notexample.com/de/", "http://bad.com/p/?utm_source=1", "http://www.bad.com/p", "http://bad.com/q",
            "http://host", "http://host?://x/", "http://é.net/", "http://a.net"]
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls)] + [(None, "http://m.bad.com/p#f", 1, 2)],
                                  "page_id long, url string, host int, rule int")
    listed = spark.createDataFrame([("bad.com/p",), (None,), ("bad.com/p",)], "canonical string")
    got = {r["page_id"]: r for r in url_filter.url_filter(pages, listed, queries.URL_RULES).collect()}
    assert len(got) == len(urls) + 1
    verdicts = [got[i]["verdict"] for i in range(len(urls))]
    assert verdicts == ["allow", "allow", "allow", "block", "allow", "block", "allow", "allow", "allow", "block", "block", "allow", "allow", "allow",
                        "block", "allow"]
    assert [got[i]["rule"] for i in (3, 4, 5, 6, 7, 8)] == ["net/", "example.net/en/", "example.com/de/", None, "org/fr/", None]
    assert (got[3]["host"], got[3]["path"], got[0]["host"], got[13]["host"], got[13]["path"]) == ("example.net", "/EN/", "", "host", "")
    assert got[None]["verdict"] == "block"
    none = listed.where("false")
    assert {r["verdict"] for r in url_filter.url_filter(pages.where("page_id > 8 AND page_id < 12"), none, []).collect()} == {"allow"}
    assert url_filter.url_filter(pages.where("false"), listed, queries.URL_RULES).count() == 0


def test_bloom_has_no_false_negative_and_a_tiny_filter_stays_exact(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(".com/p")).alias("url"))
    listed = spark.range(0, 3000, 7).select(F.concat(F.lit("h"), "id", F.lit(".com/p")).alias("canonical"))
    for blocks in (url_filter.MAX_BLOCKS, 1):
        got = url_filter.url_filter(pages, listed, [], max_blocks=blocks).where("verdict = 'block'").select("page_id").collect()
        assert sorted(r[0] for r in got) == list(range(0, 3000, 7))


# ---------------------------------------------------------------- op2

def test_pii_base_spans(table, plain):
    want = []
    for d, t in plain:
        s = brute.pii_base(t)
        want.append((d, *(sum(k == x for x, _, _ in s) for k in brute.KINDS), brute.sha(brute.spans_text(s))))
    got = pii.pii_report(table).collect()
    same_rows([tuple(r)[:-1] for r in got], want)
    base = {(d, brute.sha(brute.spans_text(brute.pii_base(t)))): brute.pii_base(t) for d, t in plain}
    for r in got:                       # base spans stay
        assert {brute.spans_text([s]) for s in base[r["doc_id"], r["base_sha256"]]} <= set(r["spans"].split(","))


def test_pii_patterns_are_leftmost_and_linear(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("a1.@+-2 (%"), 60)) for _ in range(300)]
    texts += ["1" * 20_000, "1." * 10_000, "1 " * 10_000, "a" * 20_000, "a." * 10_000 + "@", "a@" + "b." * 10_000, "+1" + "(" * 20_000,
              "a@b.c_d@e.f.g_@h.i", "1.2.3.4 " * 600, "\U0001F600 4111 1111 1111 1111 x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    for r in pii.base_spans(pii.keyed(df)).select("doc_id", *brute.KINDS).collect():
        t = texts[r["doc_id"]]
        assert [(k, s["start"], s["end"]) for k in brute.KINDS for s in r[k]] == brute.pii_base(t), t[:80]


def test_pii_model_finds_what_the_base_drops(spark):
    rng = np.random.default_rng(5)

    def card():
        d = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        return next(d + str(c) for c in range(10) if brute.luhn(d + str(c)))

    def phone():
        return f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
    rows = []
    for i in range(600):
        k = i % 6
        x = [card(), phone(), f"{rng.integers(1, 255)}.{rng.integers(0, 255)}.3.4", str(rng.integers(10**15, 10**16)), "build 2.0 of 1999", f"9{rng.integers(256, 999)}.1.2.3"][k]
        rows.append((i, f"some words {x} and more."))
    p, c = phone(), card()
    rows.append((1000, f"touching {p} {c} here"))         # one number run: the base patterns drop both
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.pii_report(df).collect()}
    assert brute.pii_base(rows[-1][1]) == [] and got[1000] == f"card:{10 + len(p)}:{10 + len(p) + 16},phone:9:{9 + len(p)}"
    assert all(got[i] == "" for i in range(600) if i % 6 == 4)
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert red[1000] == "touching [PHONE] [CARD] here" and red[4] == rows[4][1]


def test_pii_model_decides_on_formats_outside_the_base(spark):
    rng = np.random.default_rng(11)

    def card(sep):
        d = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        d = next(d + str(c) for c in range(10) if brute.luhn(d + str(c)))
        return sep.join(d[i:i + 4] for i in range(0, 16, 4))

    def phone(i):
        a, b, c = rng.integers(200, 999), rng.integers(100, 999), rng.integers(1000, 9999)
        return (f"+1 ({a}) {b}-{c}", f"+49 {a} {b}{c}")[i % 2]

    def word():
        return "".join(rng.choice(list("abcdefgh1"), rng.integers(3, 9)))
    rows = []
    for i in range(800):
        x = [phone(i // 8), f"{word()}@{word()}.de", card(" "), f"9{rng.integers(256, 999)}.1.2.3", f"{word()}@{word()}", phone(i // 8),
             str(rng.integers(10**15, 10**16)), f"20{rng.integers(10, 30)}-0{rng.integers(1, 9)}-{rng.integers(10, 28)}"][i % 8]
        rows.append((i, f"some words {x} and more."))
    lost = ["(555) 123-4567", "030 1234567", "user@müller.de", "имя@почта.рф"]
    rows += [(1000 + i, f"write to {x} today") for i, x in enumerate(lost)] + [(2000, "on 2024-01-15 we"), (2001, "at root@localhost now"), (2002, "not 999.1.2.3 here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    for i, x in enumerate(lost):
        assert brute.pii_base(rows[800 + i][1]) == []
        assert red[1000 + i] == f"write to [{'EMAIL' if '@' in x else 'PHONE'}] today", x
    assert [red[i] for i in (2000, 2001, 2002)] == [t for _, t in rows[-3:]]
    assert all(red[i] == rows[i][1] for i in range(800) if i % 8 in (3, 4, 7))


def test_pii_windows_are_bounded_by_digits(spark):
    rng = np.random.default_rng(12)

    def card(sep, step):
        d = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        d = next(d + str(c) for c in range(10) if brute.luhn(d + str(c)))
        return sep.join(d[i:i + step] for i in range(0, 16, step))

    def phone():
        return f"+33 {rng.integers(1, 9)} " + " ".join(str(x) for x in rng.integers(10, 99, 4))
    rows = [(i, f"some words {[phone(), card(' ', 2), rng.integers(10**15, 10**16), f'9{i}.1.2.3'][i % 4]} and more.") for i in range(600)]
    p = "+33 1 23 45 67 89"
    c = "41 11 11 11 11 11 11 11"
    rows += [(1000, f"call {p} 750013 end"), (1001, f"paid 12345 {c} 987 end")]
    assert all(not any(k in ("card", "phone") for k, _, _ in brute.pii_base(t)) for _, t in rows[-2:])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cand = pii.candidates(pii.base_spans(pii.keyed(df.where("doc_id >= 1000"))))
    got = {(r["doc_id"], r["kind"], r["start"], r["end"]) for r in cand.collect()}
    assert {(1000, "phone", 5, 5 + len(p)), (1001, "card", 11, 11 + len(c))} <= got
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert red[1000] == "call [PHONE] 750013 end" and "[CARD]" in red[1001] and c not in red[1001]


def test_pii_addresses_within_long_runs(spark):
    run = "x" * 300
    texts = [f'{{"a":"{run}","mail":"user@müller.de"}}', 'href="mailto:user@müller.de">x', f"{run}@müller.de", "a@" * 500, "see <user@müller.de>, now",
             "y" * 200_000 + "@" + "z." * 100_000]
    rows = pii.base_spans(pii.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    got = {}
    for r in pii.candidates(rows).where("kind = 'email'").collect():
        got.setdefault(r["doc_id"], set()).add(texts[r["doc_id"]][r["start"]:r["end"]])
    assert got[0] == got[1] == got[4] == {"user@müller.de"} and got[2] == {"x" * 64 + "@müller.de"}
    assert all(len(x) <= 320 for x in got[5])


def test_redact_keeps_columns_and_rows(docs, empty):
    got = pii.redact(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    r = got.where("doc_id = 1").first()
    assert r["text"] == "The quick brown fox, write to [EMAIL] or call [PHONE] now." and r["n_chars"] == len(r["text"])
    assert got.where("doc_id = 4").first()["text"] is None
    assert pii.pii_report(empty).count() == 0 and pii.redact(empty).count() == 0


# ---------------------------------------------------------------- op3

def test_lm_counts_and_base_score(table, plain):
    got = lm_score.score(table).collect()
    want = brute.unigram_scores(plain) if None not in [d for d, _ in plain] and len(set(plain)) == len(plain) else None
    assert len(got) == len(plain)
    if want:
        for r in got:
            h, n, k, total, s = want[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n, k, total)
            assert r["base_score"] == pytest.approx(s, rel=1e-9)
        held = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)        # the model knows more than unigrams
    assert all(np.isfinite(r["score"]) and r["score"] <= 0 for r in got)


def test_lm_is_a_distribution():
    """Class softmax times in-class shares sums to one over known tokens and the unseen rest."""
    rng = np.random.default_rng(0)
    w = rng.normal(size=(lm_score.ROWS, lm_score.CLASSES)).astype(np.float32)
    f = lm_score._history(rng.integers(0, 2**63, 50).astype(np.uint64), np.array([0, 20, 50]))
    assert np.allclose(np.exp(lm_score._log_softmax(w, f)).sum(axis=1), 1, atol=1e-5)


def test_lm_empty(empty, spark):
    assert lm_score.score(empty).count() == 0
    held = lm_score.score(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), F.lit(True)).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in held} == {(3, 0, 0, 0.0), (1, 0, 0, 0.0)}


# ---------------------------------------------------------------- op4

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_report(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.98
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()


def test_language_edges(docs, empty, spark):
    got = {r["doc_id"]: r for r in language_id.language_report(docs).collect()}
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (3, 4, 5, 6))
    assert got[1]["lang_pred"] in ("en", "fr", "de", "es")
    assert language_id.language_report(empty).count() == 0
    kept = language_id.keep_known(docs)
    assert kept.columns == docs.columns and sorted(r[0] or 0 for r in kept.select("doc_id").collect()) == [0, 1, 2, 2, 7, 8, 9, 10, 11, 12]
    assert kept.where("doc_id = 11").first()["lang"] is not None
    one = spark.createDataFrame([(1, "a b c", "xx"), (2, "d e f", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.language_report(one).collect()} <= {"xx", "und"}


# ---------------------------------------------------------------- op5

def test_fingerprints(table, plain):
    got = fingerprint.fingerprint_report(table).collect()
    assert len(got) == len(plain)
    by = {}
    for d, t in plain:
        by.setdefault(d, t or "")
    ids = sorted((d for d, _ in plain if d is not None), reverse=True) + [None] * sum(d is None for d, _ in plain)
    nxt = {d: ids[(i + 1) % len(ids)] for i, d in enumerate(ids)}     # of repeated ids: the last one's successor
    fp = {}
    for r in got:
        t = by[r["doc_id"]]
        assert r["n_chars"] == len(t) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert fp.setdefault(t, r["fingerprint"]) == r["fingerprint"] and len(r["fingerprint"]) == 256
        if ids.count(r["doc_id"]) == 1:
            n = by[nxt[r["doc_id"]]]
            e = t[:len(t) - len(t) // 3] + n[:len(t) // 3]
            assert r["edited_sha256"] == brute.sha(e)
            assert abs(r["near_edited"] - brute.jaccard(t, e)) < 0.25 and abs(r["near_next"] - brute.jaccard(t, n)) < 0.25


def test_likeness_is_unbiased(sample, spark):
    got = fingerprint.fingerprint_report(sample).toPandas().set_index("doc_id")
    t = sample.toPandas().sort_values("doc_id", ascending=False)
    texts = t.text.tolist()
    err = []
    for i, d in enumerate(t.doc_id):
        x, n = texts[i], texts[(i + 1) % len(texts)]
        err.append(got.near_edited[d] - brute.jaccard(x, x[:len(x) - len(x) // 3] + n[:len(x) // 3]))
    assert abs(np.mean(err)) < 0.01 and np.sqrt(np.mean(np.square(err))) < 0.06


def test_fingerprints_empty_and_single(empty, spark):
    assert fingerprint.fingerprint_report(empty).count() == 0
    r = fingerprint.fingerprint_report(spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == brute.sha("a b c d ea b " [:9] + "a b c d e f g"[:4])


# ---------------------------------------------------------------- op6

def test_substring(table, plain):
    want = [(d, *x) for (d, _), x in zip(plain, brute.repeats([t for _, t in plain]))]
    same_rows(rows_of(substring.remove_repeats(table).drop("kept")), want)


def test_substring_random_corpora(spark, empty):
    rng = np.random.default_rng(11)
    for width, k, letters in ((6, 3, 2), (8, 3, 3), (35, 12, 4), (5, 5, 2)):
        base = [" ".join(rng.choice(list("abcd")[:letters], n)) for n in rng.integers(0, 120, 40)]
        texts = base + [a[5:60] + " zz " + b[:50] for a, b in zip(base, base[1:])] + ["a a " * 40]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        want = [(d, *x) for d, x in enumerate(brute.repeats(texts, width))]
        same_rows(rows_of(substring.remove_repeats(df, width, k).drop("kept")), want)
    assert substring.remove_repeats(empty).count() == 0


# ---------------------------------------------------------------- op7

def test_simhash(table, plain):
    fps = [brute.simhash(t) for _, t in plain]
    comp = brute.linked([d for d, _ in plain], fps)
    want = [(d, f"{fp:016x}", c) for (d, _), fp, c in zip(plain, fps, comp)]
    same_rows(rows_of(simhash.simhash_components(table)), want)


@pytest.mark.parametrize("tile", [7, 2048])
def test_near_edges_connect_like_all_pairs(spark, tile):
    rng = np.random.default_rng(2)
    fps = [int(x) for x in rng.integers(0, 2**63, 150)]
    for x in fps[:40]:
        y = x
        for _ in range(6):                       # chains of fingerprints a few bits apart: hot shards
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                y ^= 1 << int(b)
            fps.append(y - 2**64 if y >= 2**63 else y & (2**64 - 1))
    fps = [x - 2**64 if x >= 2**63 else x for x in sorted(set(fps))]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = dict(rows_of(common.components(simhash.near_edges(df, len(fps), 4, tile))))
    comp = {}
    for x, c in zip(fps, brute.linked(fps, [x & (2**64 - 1) for x in fps])):
        comp[x] = c
    assert {x: got.get(x, x) for x in fps} == comp


def test_keep_one_per_group(docs, empty):
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    ids = sorted((r[0] is None, r[0]) for r in kept.select("doc_id").collect())
    got = [d for _, d in ids]
    assert 1 in got and 2 not in got and 12 not in got and got.count(None) == 1 and 3 in got and 4 not in got and 5 not in got
    assert simhash.keep_one_per_group(empty).count() == 0


def test_keep_one_judges_rows_without_id(spark):
    rows = [(None, "one and the same text here")] * 30 + [(None, "another text of five words"), (7, "another text of five words"), (None, None), (None, "")]
    kept = simhash.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept if r["doc_id"] is not None) == [(7, "another text of five words")]
    assert sorted(r["text"] or "" for r in kept if r["doc_id"] is None) == ["", "one and the same text here"]
    only = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(only).count() == 0


# ---------------------------------------------------------------- op8

@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(table, plain, capacity):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(TOKENIZER)
    got = packing.pack_documents(table, TOKENIZER, capacity).toPandas()
    ids = [(d, tok.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in plain]
    want = []
    for d, x in ids:
        first = (len(x) - 1) % capacity + 1
        cuts = [0, *range(first, len(x) + 1, capacity)]
        want += [(d, p, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    mine = [tuple(None if pd.isna(v) else int(v) for v in r) for r in got[cols].itertuples(index=False)]
    same_rows(mine, want)
    s = got.sort_values(["sequence_id", "offset"])
    for _, g in s.groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all() and g.length.sum() <= capacity
    assert got.sequence_id.nunique() <= best_fit_decreasing(got.length.tolist(), capacity)


def test_packing_plan_holds_every_length_and_is_near_the_bound():
    rng = np.random.default_rng(1)
    for n in (1, 30, 4000):
        lens = np.minimum(2048, rng.lognormal(6, 1.2, n).astype(int) + 1)
        counts = np.bincount(lens, minlength=2049)
        runs = packing.plan(counts)
        got = np.zeros(2049, dtype=int)
        for k, ls in runs:
            assert k > 0 and sum(ls) <= 2048
            np.add.at(got, ls, k)
        assert (got == counts).all() and sum(k for k, _ in runs) <= -(-lens.sum() // 2048) * 1.02 + 1


def test_packing_units_join_to_the_same_ids():
    import pyarrow as pa
    from tokenizers import Tokenizer
    from termlens.llm import words
    tok, enc = Tokenizer.from_file(TOKENIZER), packing.Encoder(TOKENIZER)
    texts = ["", " ", "a  b", "a \n b", " lead", "trail ", "x<|endoftext|> y <|endoftext|>", "tab\t x  y", "a  b", "don't  stop 12 3.4\r\n ok", "a, b.\nC d;e f-g h\n\ni j,\n k l,ñ m²,3", "é ü \U0001F600 z",
             "x" * 100_000]
    rng = np.random.default_rng(4)
    letters = [" ", " ", "\n", ".", ",", "'", "s", "a", "B", "é", "×", "ñ", "1", "²", "\u00a0", "\u3000", "\t", "\r", "&", "<|endoftext|>", "€", "中", "\u2028", "\x85", "ll", "\x1c", "\u0301"]
    texts += ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)]
    got = [x for _, _, buf, offs in words.slices(pa.array(texts), 1 << 14) for x in enc.encode(buf, offs)]
    assert len(got) == len(texts)
    for t, x in zip(texts, got):
        assert np.frombuffer(x, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def best_fit_decreasing(lens, capacity):
    import bisect
    gaps, n = [], 0
    for s in sorted(lens, reverse=True):
        k = bisect.bisect_left(gaps, s)
        if k == len(gaps):
            n, g = n + 1, capacity - s
        else:
            g = gaps.pop(k) - s
        bisect.insort(gaps, g)
    return n


@pytest.mark.parametrize("seed", range(12))
def test_packing_plan_is_never_worse_than_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([64, 100, 2048]))
    lens = [rng.integers(1, capacity + 1, 300), np.minimum(capacity, rng.lognormal(4, 1.5, 2000).astype(int) + 1),
            rng.choice([capacity // 2 + 1, capacity // 3 + 1, capacity // 4 + 1, 3], 500), np.full(77, capacity // 3 + 1)][seed % 4]
    counts = np.bincount(lens, minlength=capacity + 1)
    n = sum(k for k, _ in packing.plan(counts, capacity))
    assert n <= best_fit_decreasing(lens.tolist(), capacity)
    s = packing.configuration_lp(counts, capacity)
    held = np.zeros(capacity + 1)
    for x, conf in s.columns:
        assert sum(k * m for k, m in conf.items()) <= capacity
        for k, m in conf.items():
            held[k] += x * m
    assert (held >= counts * (1 - 1e-9)).all() and s.bound <= s.value * (1 + 1e-9) and s.bound <= n + 1e-6


def test_packing_empty(empty):
    assert packing.pack_documents(empty, TOKENIZER).count() == 0


# ---------------------------------------------------------------- op9

@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "passage3 PASSAGE4 passage5"), (10, " ".join(f"passage{i}" for i in range(20, 45))), (2, None), (3, "!!"), (4, "Fox"),
                                  (5, "fox"), (6, "nothing like this anywhere in any of the documents at all")], "item_id long, text string")


def test_decontamination(docs, items, empty):
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    its = [(r["item_id"], r["text"]) for r in items.collect()]
    want = [(d, *(c := brute.contamination(t, its)), c[1] > 0) for d, t in plain]
    same_rows(rows_of(decontaminate.decontamination_report(docs, items)), want)
    assert sum(w[-1] for w in want) >= 6
    none = decontaminate.decontamination_report(docs, items.where("false")).collect()
    assert len(none) == len(plain) and not any(r["contaminated"] for r in none)
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)
    assert decontaminate.decontamination_report(empty, items).count() == 0


def test_decontamination_in_shards(docs, items):
    one = rows_of(decontaminate.find_benchmark_words(docs.select("doc_id", "text"), items).select("doc_id", "n_words", "hit_items"))
    many = rows_of(decontaminate.find_benchmark_words(docs.select("doc_id", "text"), items, max_windows=4).select("doc_id", "n_words", "hit_items"))
    same_rows(one, many)


# ---------------------------------------------------------------- op10

def test_sharding(table, plain):
    got = sharding.shard_documents(table).toPandas()
    assert len(got) == len(plain)
    want = sorted((len((t or "").encode()) + 1 if t is not None else 1, zlib.crc32((t or "").encode())) for _, t in plain)
    assert sorted(zip(got["size"].tolist(), got.text_crc32.tolist())) == want
    n = got.shard.value_counts().reindex(range(8), fill_value=0)
    assert n.max() - n.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert got.grown_shard.isna().all() and (got.law == "rows").all()


def test_sharding_keeps_groups_together_and_splits_a_huge_one(spark, empty):
    rows = [(i, "hot" if i % 3 == 0 else f"pair {i // 4}" if i % 3 == 1 else f"alone {i}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(df).toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "text"]), on="doc_id")
    assert got.shard.value_counts().tolist() == [150] * 8
    small = got[got.text.str.startswith("pair")].groupby("text").shard.nunique()
    assert (small == 1).mean() > 0.95
    hot = got[got.text == "hot"].shard.value_counts()
    assert hot.iloc[0] > 100                       # an even spread has 50 in each; linked pairs share the room
    assert sharding.shard_documents(empty).count() == 0


@pytest.mark.parametrize("linked", [95, 100])
def test_sharding_of_nearly_all_linked_rows_keeps_groups_together(spark, linked):
    rng = np.random.default_rng(linked)
    rows, g = [], 0
    while len(rows) < 4000 * linked // 100:
        rows += [f"group {g}"] * int(rng.integers(2, 5))
        g += 1
    rows += [f"alone {i}" for i in range(4000 - len(rows))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = sharding.shard_documents(df).toPandas().merge(pd.DataFrame({"doc_id": range(len(rows)), "text": rows}), on="doc_id")
    n = got.shard.value_counts()
    assert len(got) == len(rows) and n.max() - n.min() <= 1
    split = got[got.text.str.startswith("group")].groupby("text").shard.nunique() > 1
    assert split.mean() < 0.1
