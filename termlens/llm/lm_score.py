"""Language-model scores: add-one unigrams and a hashed maximum-entropy model with a class-factored softmax.

P(token | history) = P(class | history) * P(token | class). The first factor is a softmax over `CLASSES` classes with hashed
features of the history (previous token, the one before it as a skip feature, both as a bigram, bias). The second is the
add-one share of the token's count within its class, one unit of each class being kept for unseen tokens, so the
factors sum to one over known tokens and unseen ones. The most frequent tokens are classes of their own, the others are
dealt out by a hash.

Training: `ROUNDS` synchronous rounds, each over its own slice of all training documents; every task runs mini-batch
gradient steps from the shared weights and sends its change (fixed size, about 1 MB), changes are averaged by tokens in two
streaming steps. Counts cover all training tokens: words are counted per batch, then summed in Spark. Tokens above a
frequency threshold (at most `FREQUENT` of them, a bounded broadcast) are scored in numpy batches; the rest meet
their counts in a join and are summed per document.

Edge cases: null text = empty = the end token alone; no training document: N = V = 0, every score 0; a null doc_id trains and
is not held out; repeated rows are scored (and counted) each; words of equal frequency are ordered by their hash; very long texts
are scored whole, a slice at a time; only doc_id and text are read, so other columns of any name do not matter. Words are told apart
by a 64-bit hash where they are frequent, by their text where they are not.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.llm import words as W
from termlens.llm.common import written

CLASSES = 32
OWN = 15                       # tokens that are a class of their own
PREV, SKIP, PAIR = 2048, 2048, 4096
ROWS = PREV + SKIP + PAIR + 1  # the last row is the bias
BLOCKS = 8
FREQUENT = 1 << 16
ROUNDS = 2
RATE = 0.4
STEP = 4096                    # tokens in one gradient step
COUNTED_AT_ONCE = 400_000
END = np.uint64(0xE7037ED1A0B428DB)
START = np.uint64(0x8EBC6AF09C88C6E3)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


# ---------------------------------------------------------------- counts

def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(c: Counter) -> pa.RecordBatch:
        words, ns = list(c), list(c.values())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64())], names=["word", "n"])

    c: Counter = Counter()
    for b in batches:
        c[b""] += b.num_rows                       # the end token: no word is empty
        for t in b.column("text"):
            c.update((t.as_py() or "").encode().lower().split())
            if len(c) > COUNTED_AT_ONCE:
                yield out(c)
                c = Counter()
    if c:
        yield out(c)


def token_counts(texts: DataFrame) -> DataFrame:
    """word, n over all texts; the end token is the empty word."""
    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_batches, "word string, n long").groupBy(
        "word").agg(F.sum("n").alias("n"))


def _hashes_of(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    buf = np.frombuffer(b" ".join(raw), dtype=np.uint8)
    lens = np.array([len(x) for x in raw], dtype=np.int64)
    s = np.concatenate([[0], np.cumsum(lens + 1)[:-1]]).astype(np.int64) if len(raw) else lens
    h = W.word_hashes(buf, s, s + lens) if len(raw) else np.zeros(0, np.uint64)
    h[lens == 0] = END
    return h


def _class_of(h: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Class of every token hash; `own` are the sorted hashes of the tokens that are classes of their own."""
    c = OWN + ((h >> np.uint64(33)) % np.uint64(CLASSES - OWN)).astype(np.int64)
    if len(own):
        k = np.minimum(np.searchsorted(own, h), len(own) - 1)
        c = np.where(own[k] == h, k, c)
    return c


def _class_batches(batches: Iterator[pa.RecordBatch], own: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, buf, offs in W.slices(b.column("word")):
            h = W.word_hashes(np.append(buf, np.uint8(0)), offs[:-1], offs[1:])
            h[offs[1:] == offs[:-1]] = END
            c = _class_of(h, own)
            n = b.column("n").to_numpy()[i:j]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(np.bincount(c, n, CLASSES).astype(np.int64)),
                                              pa.array(np.bincount(c, minlength=CLASSES).astype(np.int64))], names=["cls", "n", "v"])


class Vocabulary:
    """What scoring needs of the counts, of bounded size."""

    def __init__(self, counts: DataFrame):
        level = F.floor(F.log2("n") * 8)
        levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect()  # < 512 rows
        self.total, self.distinct = sum(r["n"] for r in levels), sum(r["v"] for r in levels)
        least, seen = None, 0
        for r in sorted(levels, key=lambda r: -r["level"]):
            seen += r["v"]
            if seen > FREQUENT:
                break
            least = r["level"]
        top = [] if least is None else counts.where(level >= least).collect()               # at most FREQUENT rows
        h, n = _hashes_of([r["word"] for r in top]), np.array([r["n"] for r in top], dtype=np.int64)
        order = np.argsort(h)
        self.hashes, self.counts = h[order], n[order]
        self.own = np.sort(self.hashes[np.lexsort((self.hashes, -self.counts))[:OWN]])
        z = np.ones(CLASSES)
        own = self.own
        seen = np.zeros(CLASSES)
        for r in counts.mapInArrow(lambda it: _class_batches(it, own), "cls long, n long, v long").groupBy("cls").agg(
                F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
            z[r["cls"]] += r["n"] + r["v"]
            seen[r["cls"]] = r["n"]
        self.log_z = np.log10(z)
        self.prior = np.log((seen + 1) / (seen.sum() + CLASSES)).astype(np.float32)      # natural log, where training starts


# ---------------------------------------------------------------- model

def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Token hashes of a slice with an end after every text, first token of every text, word starts / ends, and the
    token index of every word."""
    s, e, first = W.word_spans(buf, offs, W.SPACE_WORDS)
    rows = len(offs) - 1
    at = np.arange(len(s)) + np.repeat(np.arange(rows), np.diff(first))
    tok = np.empty(len(s) + rows, dtype=np.uint64)
    tok[at] = W.word_hashes(buf, s, e)
    tok[first[1:] + np.arange(rows)] = END
    return tok, first + np.arange(rows + 1), s, e, at


def _history(tok: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Feature rows (tokens x 3) of every token's history."""
    p1, p2 = np.empty_like(tok), np.empty_like(tok)
    p1[1:], p2[2:] = tok[:-1], tok[:-2]
    starts = first[:-1]
    p1[starts] = START
    p2[starts] = START
    p2[np.minimum(starts + 1, len(tok) - 1)[np.diff(first) > 1]] = START
    out = np.empty((len(tok), 3), dtype=np.int64)
    out[:, 0] = (p1 >> np.uint64(20)) % np.uint64(PREV)
    out[:, 1] = PREV + ((p2 >> np.uint64(24)) % np.uint64(SKIP)).astype(np.int64)
    out[:, 2] = PREV + SKIP + ((W.mix(p1 * np.uint64(3) + p2) >> np.uint64(20)) % np.uint64(PAIR)).astype(np.int64)
    return out


def _log_softmax(w: np.ndarray, f: np.ndarray) -> np.ndarray:
    z = w[f[:, 0]]
    z += w[f[:, 1]]
    z += w[f[:, 2]]
    z += w[-1]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def _add_rows(w: np.ndarray, f: np.ndarray, g: np.ndarray, rate: float) -> None:
    """w[f] += rate * sum of the gradients of a row / (their number + 1)."""
    order = np.argsort(f, kind="stable")
    fs = f[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(fs)) + 1])
    n = np.diff(np.append(cut, len(fs)))[:, None]
    w[fs[cut]] += (rate * np.add.reduceat(g[order], cut, axis=0) / (n + 1)).astype(np.float32)


def _gradient_batches(batches: Iterator[pa.RecordBatch], weights: np.ndarray, own: np.ndarray, rate: float) -> Iterator[pa.RecordBatch]:
    w, seen = weights.copy(), 0
    for b in batches:
        for _, _, raw, offs in W.slices(b.column("text")):
            tok, first, *_ = _tokens(W.lowered(raw), offs)
            f, c = _history(tok, first), _class_of(tok, own)
            for k in range(0, len(tok), STEP):
                fk, ck = f[k:k + STEP], c[k:k + STEP]
                g = -np.exp(_log_softmax(w, fk))
                g[np.arange(len(ck)), ck] += 1
                for x in range(3):
                    _add_rows(w, fk[:, x], g, rate)
                w[-1] += rate * g.mean(axis=0)
            seen += len(tok)
    if seen:
        delta = np.array_split((w - weights) * np.float64(seen), BLOCKS)
        yield _block_batch(list(range(BLOCKS)), [seen] * BLOCKS, delta)


def _block_batch(blocks: list[int], ns: list[int], deltas: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(ns, pa.int64()),
                                       pa.array([d.astype(np.float64).tobytes() for d in deltas], pa.binary())], names=["block", "n", "delta"])


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks of one partition, one running sum a block."""
    total: dict[int, np.ndarray] = {}
    seen: Counter = Counter()
    for b in batches:
        for k, n, d in zip(b.column("block").to_pylist(), b.column("n").to_pylist(), b.column("delta")):
            x = np.frombuffer(d.as_py(), dtype=np.float64)
            total[k] = total[k] + x if k in total else x
            seen[k] += n
    if total:
        yield _block_batch(list(total), [seen[k] for k in total], list(total.values()))


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, rate: float = RATE) -> np.ndarray:
    """Class weights (ROWS x CLASSES) after `rounds` rounds that together read every text once, starting from the classes' shares."""
    spark = texts.sparkSession
    w = np.zeros((ROWS, CLASSES), dtype=np.float32)
    w[-1] = vocabulary.prior
    ddl = "block int, n long, delta binary"
    own = vocabulary.own
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for r in range(rounds):
        held = spark.sparkContext.broadcast(w)
        part = texts.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(rounds)) == r).select("text")
        step = rate / (r + 1)
        got = part.mapInArrow(lambda it: _gradient_batches(it, held.value, own, step), ddl)  # noqa: B023
        got = got.repartition(parts, "block", F.pmod(F.spark_partition_id(), F.lit(16))).mapInArrow(_sum_batches, ddl)
        got = got.repartition(BLOCKS, "block").mapInArrow(_sum_batches, ddl).collect()       # BLOCKS rows
        if got:
            shapes = [len(x) for x in np.array_split(w, BLOCKS)]
            mean = {g["block"]: np.frombuffer(g["delta"], dtype=np.float64) / g["n"] for g in got}
            w = w + np.vstack([mean[k].reshape(shapes[k], CLASSES) for k in range(BLOCKS)]).astype(np.float32)
    return w


def _score_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    weights, hashes, counts, own, log_z = model
    logs = np.log10(counts + 1.0)
    for b in batches:
        n_tokens, known, unigram, classes, rare = [], [], [], [], []
        for _, _, raw, offs in W.slices(b.column("_text")):
            buf = W.lowered(raw)
            tok, first, s, e, at = _tokens(buf, offs)
            c = _class_of(tok, own)
            f = _history(tok, first)
            lp = np.empty(len(tok))
            for k in range(0, len(tok), 1 << 15):
                z = _log_softmax(weights, f[k:k + (1 << 15)])
                lp[k:k + (1 << 15)] = z[np.arange(len(z)), c[k:k + (1 << 15)]]
            lp = lp / np.log(10) - log_z[c]
            k = np.minimum(np.searchsorted(hashes, tok), max(0, len(hashes) - 1))
            hit = hashes[k] == tok if len(hashes) else np.zeros(len(tok), dtype=bool)
            starts = first[:-1]
            n_tokens.append(np.diff(first))
            known.append(np.add.reduceat(hit.astype(np.int64), starts))
            unigram.append(np.add.reduceat(np.where(hit, logs[k] if len(hashes) else 0.0, 0.0), starts))
            classes.append(np.add.reduceat(lp, starts))
            # words that are not frequent go on to the join
            r = np.flatnonzero(~hit[at])
            text = buf.tobytes()
            found = [text[x:y].decode() for x, y in zip(s[r].tolist(), e[r].tolist())]
            cut = np.searchsorted(at[r], first)
            rare += [found[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
        cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("held_out"), cat(n_tokens, pa.int64()), cat(known, pa.int64()), cat(unigram, pa.float64()),
             cat(classes, pa.float64()), pa.array(rare, pa.list_(pa.string()))],
            names=["doc_id", "held_out", "n_tokens", "known", "unigram", "classes", "rare"])


def score(docs: DataFrame, held: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("held_out", held_out() if held is None else held)
    known = docs.where("NOT held_out").select("doc_id", "text")
    counts = written(token_counts(known), "lm-counts")
    v = Vocabulary(counts)
    w = train(known, v)
    model = spark.sparkContext.broadcast((w, v.hashes, v.counts, v.own, v.log_z))
    kind = dict(docs.dtypes)["doc_id"]
    part = docs.withColumnRenamed("text", "_text").mapInArrow(
        lambda it: _score_batches(it, model.value),
        f"doc_id {kind}, held_out boolean, n_tokens long, known long, unigram double, classes double, rare array<string>")
    part = written(part.withColumn("_row", F.monotonically_increasing_id()), "lm-scores")
    rare = part.select("_row", F.explode("rare").alias("word")).join(counts, "word").groupBy("_row").agg(
        F.count(F.lit(1)).alias("_k"), F.sum(F.log10(F.col("n") + 1)).alias("_u"))
    out = part.drop("rare").join(rare, "_row", "left")
    uni = F.col("unigram") + F.coalesce("_u", F.lit(0.0))
    norm = float(np.log10(v.total + v.distinct + 1))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("_k", F.lit(0))).alias("n_known"),
                      F.lit(int(v.total)).cast("long").alias("train_tokens"),
                      (uni - F.col("n_tokens") * norm).alias("base_score"), (uni + F.col("classes")).alias("score"))
