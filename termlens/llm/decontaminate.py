"""Benchmark decontamination: Wu-Manber multi-pattern search over word sequences.

Patterns are the n-word windows of the benchmark items (an item of fewer words is one window). For every pattern length a block
shift table maps the hash of two consecutive words to the words that can be skipped; a shift of 0 looks the block up in the
suffix buckets (window hashes), and a direct comparison of the words confirms an occurrence. The cursors of many text
pieces move at once as numpy lanes, each by its own shift, so most positions are never looked at. No shuffle: the
benchmark side is read by every task, in shards of at most `max_windows` windows (a proven bound), one pass per shard.

Edge cases: null or wordless documents have 0 words and no hit; null or wordless items have no window; an empty benchmark
marks nothing; equal items both count; repeated documents are judged row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.llm import words as W
from termlens.llm.common import ascii_lower, shielded, text_or_empty, unshielded, written

WINDOW = 10
MAX_WINDOWS = 1 << 19        # windows in one broadcast shard (about 60 bytes each)
SHIFT_BITS = 18
LANE = 192                   # words a cursor runs over
WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def benchmark_windows(items: DataFrame, width: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(length, gram, item_ids): every distinct window text with the ids of the items that have it."""
    ws = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"({WORD_RE})"), 1)
    w = items.select(F.col(id_col).cast("string").alias("item"), ws.alias("ws")).where(F.size("ws") > 0)
    n = F.least(F.size("ws"), F.lit(width))
    w = w.select("item", "ws", n.alias("length"), F.explode(F.sequence(F.lit(1), F.size("ws") - n + 1)).alias("i"))
    w = w.select("item", "length", F.array_join(F.slice("ws", F.col("i"), F.col("length")), " ").alias("gram"))
    return w.groupBy("length", "gram").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))


class Patterns:
    """Shift table and suffix buckets of the patterns of one length (they travel to the tasks as plain arrays)."""

    def __init__(self, length: int, grams: list[str], items: list[list[str]]):
        self.length, self.block = length, min(2, length)
        self.grams = [g.encode() for g in grams]
        self.items = items
        buf = np.frombuffer(b" ".join(self.grams), dtype=np.uint8)
        s, e, _ = W.word_spans(buf, np.array([0, len(buf)]), W.ALNUM_WORDS)
        wh = W.word_hashes(buf, s, e).reshape(len(grams), length)
        self.words = wh
        self.keys = W.window_hashes(wh.ravel(), length)[::length]
        order = np.argsort(self.keys)
        self.keys, self.order = self.keys[order], order
        default = length - self.block + 1
        self.shift = np.full(1 << SHIFT_BITS, default, dtype=np.int32)
        for j in range(length - self.block + 1):         # block starting at word j: distance to the window's last block
            slot = self.slots(wh[:, j], wh[:, j + 1] if self.block == 2 else None)
            np.minimum.at(self.shift, slot, length - self.block - j)

    @staticmethod
    def slots(a: np.ndarray, b: np.ndarray | None) -> np.ndarray:
        x = a if b is None else a * np.uint64(0x9E3779B97F4A7C15) + b
        return (W.mix(x) >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)

    def find(self, wh: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position, pattern number) of candidates whose words hash equal; `first` are the rows' word offsets."""
        m, b = self.length, self.block
        lens = np.diff(first)
        rows = np.flatnonzero(lens >= m)
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # window ends from first+m-1 to the row's last word, cut into lanes
        lo, hi = first[rows] + m - 1, first[rows + 1] - 1
        n = (hi - lo) // LANE + 1
        at = np.repeat(lo, n) + LANE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        stop = np.minimum(at + LANE - 1, np.repeat(hi, n))
        found = []
        while len(at):
            slot = self.slots(wh[at - b + 1], wh[at] if b == 2 else None)
            step = self.shift[slot]
            zero = step == 0
            if zero.any():
                found.append(at[zero])
                step = np.where(zero, 1, step)
            at = at + step
            live = at <= stop
            at, stop = at[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = np.concatenate(found) - m + 1
        key = self._keys_at(wh, start)
        lo = np.searchsorted(self.keys, key)                  # the whole bucket of a key is compared
        n = np.searchsorted(self.keys, key, side="right") - lo
        pat = self.order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        start = np.repeat(start, n)
        same = (wh[start[:, None] + np.arange(m)] == self.words[pat]).all(axis=1)
        return start[same], pat[same]

    def _keys_at(self, wh: np.ndarray, start: np.ndarray) -> np.ndarray:
        p = W.powers(W._Q, self.length)
        with np.errstate(over="ignore"):
            return W.mix((wh[start[:, None] + np.arange(self.length)] * p).sum(axis=1, dtype=np.uint64))


def search(batches: Iterator[pa.RecordBatch], patterns: list[Patterns], text: str) -> Iterator[pa.RecordBatch]:
    """Add the occurrences of one shard of patterns to n_words, hit_spans and hit_items."""
    for batch in batches:
        n_words = []
        spans, items = batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist()
        for i, j, raw, offs in W.slices(batch.column(text)):
            buf = W.lowered(raw)
            s, e, first = W.word_spans(buf, offs, W.ALNUM_WORDS)
            wh = W.word_hashes(buf, s, e)
            n_words.append(np.diff(first))
            for p in patterns:
                start, pat = p.find(wh, first)
                row = np.searchsorted(first, start, side="right") - 1
                for w0, k, r in zip(start.tolist(), pat.tolist(), row.tolist()):
                    words = b" ".join(buf[s[w]:e[w]].tobytes() for w in range(w0, w0 + p.length))
                    if words == p.grams[k]:               # direct comparison
                        spans[i + r] += (w0 - int(first[r]), w0 - int(first[r]) + p.length)
                        items[i + r] = sorted({*items[i + r], *p.items[k]})
        new = {"n_words": pa.array(np.concatenate(n_words) if n_words else np.zeros(0, np.int64), pa.int64()),
               "hit_spans": pa.array(spans, pa.list_(pa.int32())), "hit_items": pa.array(items, pa.list_(pa.string()))}
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([new.get(n, batch.column(k)) for k, n in enumerate(names)], names=names)


def load_patterns(windows: DataFrame, max_windows: int = MAX_WINDOWS) -> Iterator[list[Patterns]]:
    """Shards of at most about `max_windows` distinct windows each, so that one shard is a bounded broadcast."""
    windows = written(windows, "windows")
    n = windows.count()
    shards = max(1, -(-n // max_windows))
    for k in range(shards):
        part = windows.where(F.pmod(F.xxhash64("gram"), F.lit(shards)) == k).collect()
        by: dict[int, list] = {}
        for r in part:
            by.setdefault(r["length"], []).append(r)
        yield [Patterns(m, [r["gram"] for r in rows], [list(r["item_ids"]) for r in rows]) for m, rows in sorted(by.items())]


def find_benchmark_words(docs: DataFrame, items: DataFrame, width: int = WINDOW, text_col: str = "text",
                         max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The columns of `docs` + n_words, hit_spans (word starts / ends of occurrences, flat) and hit_items (ids, sorted
    as strings), which take the place of columns of these names. One pass over the documents per shard of windows."""
    out = docs.withColumn(text_col, text_or_empty(text_col)).withColumns({
        "n_words": F.lit(0).cast("long"), "hit_spans": F.array().cast("array<int>"), "hit_items": F.array().cast("array<string>")})
    schema = out.schema
    for shard in load_patterns(benchmark_windows(items, width), max_windows):
        held = docs.sparkSession.sparkContext.broadcast(shard)
        out = out.mapInArrow(lambda it, held=held: search(it, held.value, text_col), schema)
    return out


def decontamination_report(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit (words inside an occurrence), n_items, items_sha256, contaminated."""
    found = find_benchmark_words(docs.select("doc_id", "text"), items, width)
    hits = F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(0), F.expr("size(hit_spans) div 2 - 1")),
        lambda k: F.sequence(F.get("hit_spans", 2 * k), F.get("hit_spans", 2 * k + 1) - 1))))
    n_hit = F.when(F.size("hit_spans") > 0, F.size(hits)).otherwise(0).cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, columns unchanged (a null text comes back as null)."""
    found = find_benchmark_words(shielded(docs, "text"), items, width)
    return unshielded(found.where(F.size("hit_spans") == 0), docs)
