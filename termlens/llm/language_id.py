"""Language ID by hierarchical discrimination: family first, then one-versus-one linear SVMs inside the family.

Features are hashed byte bigrams and trigrams of the whole lower-cased text (everything that is no letter counts as one
space), square-rooted and scaled to length 1, computed slice by slice in numpy. Family and language decisions are votes
of pairwise linear SVMs (squared hinge), ties broken by the summed margins. Every pair is trained in its own group on a
sample of about `per_lang` documents a language (`PER_LANG`, drawn by a hash of the row, all over the table); the
weights, a few kilobytes a pair, travel to the scoring tasks, which need no shuffle.

Edge cases: null text, or none with a letter: `und`, score 0; no labelled row at all: everything is `und`; one learned
language: always that one; a null lang or doc_id is never learned from (a null doc_id is not held out); repeated rows
are judged each; a language without a listed family is a family of its own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.llm import words as W
from termlens.llm.common import shielded, unshielded

DIM = 4096
PER_LANG = 800
ROUNDS = 150
REG = 1e-4
UNKNOWN = "und"
#: fixed values: languages by family
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
_FAMILY = {lang: f for f, langs in FAMILIES.items() for lang in langs}

#: letters and all non-ASCII bytes count; the rest is one space
_LETTERS = np.full(256, 0x20, dtype=np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, f"only-{lang}")


def features(col: pa.Array) -> Iterator[np.ndarray]:
    """Rows x DIM float32 matrices for runs of rows."""
    for i, j, raw, offs in W.slices(col):
        for lo in range(0, j - i, 256):              # at most 256 rows (4 MB) of features at once
            hi = min(lo + 256, j - i)
            buf = _LETTERS[raw[offs[lo]:offs[hi]]]
            o = offs[lo:hi + 1] - offs[lo]
            n = len(buf)
            row = np.repeat(np.arange(hi - lo), np.diff(o))
            out = np.zeros((hi - lo) * DIM)
            for width in (2, 3):
                if n < width:
                    continue
                g = np.zeros(n - width + 1, dtype=np.uint32)
                for k in range(width):
                    g = g * np.uint32(0x01000193) + buf[k:n - width + 1 + k] + np.uint32(1)
                blank = (buf[:n - width + 1] == 0x20) & (buf[width - 1:] == 0x20)
                ok = (row[:n - width + 1] == row[width - 1:]) & ~blank
                slot = ((g * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
                out += np.bincount(row[:n - width + 1][ok] * DIM + slot[ok], minlength=len(out))
            m = np.sqrt(out.reshape(hi - lo, DIM).astype(np.float32))
            norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
            yield m / np.maximum(norm, 1e-6)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        slots, values = [], []
        for m in features(b.column("text")):
            for r in m:
                k = np.flatnonzero(r)
                slots.append(k.astype(np.int16))
                values.append(r[k])
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(slots, pa.list_(pa.int16())), pa.array(values, pa.list_(pa.float32()))],
                                         names=["lang", "slots", "values"])


def train_svm(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, reg: float = REG) -> np.ndarray:
    """Linear SVM (squared hinge, balanced classes) by accelerated gradient; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], dtype=np.float32)
    z, step = w.copy(), 0.2
    for t in range(rounds):
        miss = np.maximum(0, 1 - y * (x @ z))
        grad = reg * z - 2 * (x.T @ (c * y * miss))
        new = z - step * grad
        z = new + t / (t + 3) * (new - w)
        w = new
    return w


def train(docs: DataFrame, per_lang: int = PER_LANG) -> dict[tuple[str, str], np.ndarray]:
    """Weights of every pair, ("family", "a|b") and ("lang", "a|b"), positive margins meaning a, and the languages,
    ("learned", x). Learns from the non-null `lang` of `docs` (doc_id, text, lang)."""
    good = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in good.groupBy("lang").count().collect()}       # one row a language
    langs = sorted(counts)
    if len(langs) < 2:
        return {("learned", x): np.zeros(1) for x in langs}
    tasks: dict[str, list[tuple[str, str, int]]] = {x: [] for x in langs}
    families = sorted({family_of(x) for x in langs})
    for a, b in itertools.combinations(families, 2):
        for x in langs:
            if family_of(x) in (a, b):
                tasks[x].append(("family", f"{a}|{b}", 1 if family_of(x) == a else -1))
    for a, b in itertools.combinations(langs, 2):
        if family_of(a) == family_of(b):
            tasks[a].append(("lang", f"{a}|{b}", 1))
            tasks[b].append(("lang", f"{a}|{b}", -1))
    spark = docs.sparkSession
    jobs = spark.createDataFrame([(x, min(1.0, per_lang / counts[x]), lv, pair, y) for x in langs for lv, pair, y in tasks[x]],
                                 "lang string, share double, level string, pair string, y int")
    share = F.create_map(*[z for x in langs for z in (F.lit(x), F.lit(min(1.0, per_lang / counts[x])))])
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1_000_000)) / 1e6
    sample = good.where(draw < share[F.col("lang")]).where(F.col("text").rlike(r"\p{L}"))
    vec = sample.select("lang", "text").mapInArrow(_sample_batches, "lang string, slots array<short>, values array<float>")
    rows = vec.join(jobs.drop("share"), "lang")

    def fit(pdf):
        import pandas as pd
        x = np.zeros((len(pdf), DIM), dtype=np.float32)
        for k, (s, v) in enumerate(zip(pdf["slots"], pdf["values"])):
            x[k, np.asarray(s, dtype=np.int64)] = v
        w = train_svm(x, pdf["y"].to_numpy().astype(np.float32))
        return pd.DataFrame({"level": [pdf["level"].iloc[0]], "pair": [pdf["pair"].iloc[0]], "w": [w.astype(float).tolist()]})

    got = rows.groupBy("level", "pair").applyInPandas(fit, "level string, pair string, w array<double>").collect()
    return {(r["level"], r["pair"]): np.array(r["w"]) for r in got} | {("learned", x): np.zeros(1) for x in langs}


class Judge:
    """Votes of the pairwise machines."""

    def __init__(self, models: dict[tuple[str, str], np.ndarray]):
        self.pairs = {lv: [p.split("|") for v, p in models if v == lv] for lv in ("family", "lang")}
        self.w = {lv: np.array([w for (v, _), w in models.items() if v == lv], dtype=np.float32).T for lv in ("family", "lang")}
        self.members: dict[str, list[str]] = {}
        for x in sorted(p for lv, p in models if lv == "learned"):
            self.members.setdefault(family_of(x), []).append(x)

    @staticmethod
    def vote(names: list[str], pairs: list[list[str]], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner of each row and its confidence: the mean of the winner's pairwise logistic margins."""
        at = {n: k for k, n in enumerate(names)}
        wins = np.zeros((len(margins), len(names)))
        sure = np.zeros_like(wins)
        for k, (a, b) in enumerate(pairs):
            if a not in at or b not in at:
                continue
            p = 1 / (1 + np.exp(-np.clip(3 * margins[:, k], -30, 30)))
            wins[:, at[a]] += p > 0.5
            wins[:, at[b]] += p <= 0.5
            sure[:, at[a]] += p
            sure[:, at[b]] += 1 - p
        best = (wins + 1e-3 * sure).argmax(axis=1)
        return best, sure[np.arange(len(best)), best] / max(1, len(names) - 1)

    def __call__(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.members:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        x1 = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
        fams = sorted(self.members)
        if len(fams) > 1:
            f, score = self.vote(fams, self.pairs["family"], x1 @ self.w["family"])
        else:
            f, score = np.zeros(len(x), dtype=int), np.ones(len(x))
        out = np.empty(len(x), dtype=object)
        margins = x1 @ self.w["lang"] if self.pairs["lang"] else None
        for k, fam in enumerate(fams):
            rows = np.flatnonzero(f == k)
            names = self.members[fam]
            if len(names) == 1 or not len(rows):
                out[rows] = names[0]
                continue
            best, p = self.vote(names, self.pairs["lang"], margins[rows])
            out[rows] = np.array(names, dtype=object)[best]
            score[rows] = score[rows] * p
        return out.tolist(), score


def _judge_batches(batches: Iterator[pa.RecordBatch], models, text: str) -> Iterator[pa.RecordBatch]:
    judge = Judge(models)
    for b in batches:
        langs, scores = [], []
        for m in features(b.column(text)):
            got, p = judge(m)
            langs += got
            scores += p.tolist()
        for k, t in enumerate(b.column(text)):
            if not has_letter(t.as_py()):
                langs[k], scores[k] = UNKNOWN, 0.0
            elif langs[k] == UNKNOWN:
                scores[k] = 0.0
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                         names=[*b.schema.names, "lang_pred", "score"])


def predict(docs: DataFrame, models: dict[tuple[str, str], np.ndarray], text_col: str = "text") -> DataFrame:
    """The columns of `docs` + lang_pred, score (in place of columns of these names)."""
    docs = docs.drop("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(models)
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double"
    return docs.mapInArrow(lambda it: _judge_batches(it, held.value, text_col), ddl)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    models = train(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), models).drop("text")


def keep_known(docs: DataFrame) -> DataFrame:
    """Documents with a recognisable language, columns unchanged; a null lang takes the prediction."""
    models = train(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    got = predict(shielded(docs, "text"), models).where(F.col("lang_pred") != UNKNOWN)
    lang = F.col(f"k_{docs.columns.index('lang')}")
    return unshielded(got, docs, lang=F.coalesce(lang.cast("string"), F.col("lang_pred")))
