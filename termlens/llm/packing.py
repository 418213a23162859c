"""Best-fit packing by a configuration linear program over the length histogram.

Documents are tokenised in one pass; only longer ones are cut (the first piece takes the odd length). What is planned on is the
histogram of piece lengths: at most `capacity` numbers, whatever the corpus. The program has a variable for every way to fill
one sequence (a configuration) and a covering row for every length. Multiplicative weights solve it: a length's weight falls
as it gets covered, a knapsack dynamic program over the weights prices the configurations, those near the best price get a
share, and the best price bounds the optimum from below (`Solution.bound`). The fractional solution is rounded down to whole
sequences, what is left is placed best-fit decreasing, and where best-fit decreasing alone needs fewer sequences its plan is
taken. All steps handle runs of equal sequences, so the plan's size and time depend on the number of lengths, not on the
number of documents. Pieces take the plan's slots by a distributed rank within their length.

Edge cases: null text = empty text = one piece of length 1 (the id 0 alone); an empty table gives no rows; repeated rows
are packed each; equal lengths are interchangeable; a very long text without a space is one unit of encoding and is never
cached; only doc_id and text are read, so extra columns of any name do not matter.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.llm import words as W
from termlens.llm.common import ranked, written

CAPACITY = 2048
END_ID = 0
CACHE_BYTES = 40 << 20       # one of the two generations of cached units, overhead included
CACHED_UNIT = 64             # longer units are not cached
UNIT_COST = 180              # bytes of a cached unit besides its letters
SLICE_BYTES = 1 << 23        # text encoded at once (or the longest single text)
ROUNDS = 300                 # knapsack tables
COLUMNS = 256                # configurations taken from one table
NEAR = 0.1                   # how far below the best price a configuration may be
GRAIN = 0.05                 # share of its scarcest length that one step covers
ETA = 20.0

#: a sentence mark after one of these bytes is a token of its own; the Latin-1 letters are 0xC3 and a second byte
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[list(b".,;:!?")] = True
#: surely no white space: printable ASCII and the lead byte of Latin-1 letters
_SOLID = np.zeros(256, dtype=bool)
_SOLID[[*range(0x21, 0x7F), 0xC3]] = True


# ---------------------------------------------------------------- tokens

def unit_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions where the byte-level pre-tokenizer surely starts a new token, whatever comes before: a text's first byte, a
    space or line end between two solid bytes (or a space before one), sentence marks after a letter or digit."""
    n = len(buf)
    start = np.zeros(n + 1, dtype=bool)
    if n > 1:
        prev, cur, after = buf[:-2], buf[1:-1], buf[2:]
        latin = np.zeros(n - 1, dtype=bool)                                   # whether a Latin-1 letter ends at a byte
        latin[1:] = (buf[:-2] == 0xC3) & (buf[1:-1] >= 0x80) & (buf[1:-1] != 0x97) & (buf[1:-1] != 0xB7)
        letter = _ALNUM[buf[:-1]] | latin
        start[1:n - 1] = ((cur == 0x20) & _SOLID[after]) | ((cur == 0x0A) & _SOLID[after] & (_SOLID[prev] | latin[:-1]))
        start[1:n] |= _POINT[buf[1:]] & letter
    start[offs] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Token ids as little-endian unsigned 32-bit numbers, by `tokenizers`.

    A text's ids are the joined ids of its units (see `unit_starts`). The distinct units of a slice are encoded once, many in one
    call where they begin alike (a token that begins with a space begins a unit), and kept in a cache of two generations
    with a bound in bytes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        vocabulary = self.tok.get_vocab()
        self.opens = {}
        for mark, sign in ((" ", "\u0120"), ("\n", "\u010a")):       # byte-level signs of a space and a line end
            self.opens[mark] = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.opens[mark][[k for w, k in vocabulary.items() if w.startswith(sign)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _apart(self, units: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(units, add_special_tokens=False)]

    def _joined(self, mark: str, units: list[str]) -> list[bytes]:
        """Units that begin with `mark` and have no other white space."""
        out: list[bytes] = []
        for k in range(0, len(units), 4096):
            group = units[k:k + 4096]
            ids = np.array(self.tok.encode_batch_fast(["".join(group)], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(self.opens[mark][ids])
            if len(at) == len(group) and at[0] == 0:
                raw, cut = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
                out += [raw[x:y] for x, y in zip(cut, cut[1:])]
            else:                                        # an added token swallowed a mark
                out += self._apart(group)
        return out

    def _ids(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units."""
        young, old = self.young, self.old
        got = [young.get(u) or old.get(u) for u in units]
        kinds: dict[str, list[int]] = {" ": [], "\n": [], "": []}
        for k, (u, x) in enumerate(zip(units, got)):
            if x is None:
                mark = u[0]
                kinds[mark if mark in kinds and len(u.split()) == 1 and len(u.lstrip()) == len(u) - 1 and not u[-1].isspace() else ""].append(k)
        for mark, at in kinds.items():
            todo = [units[k] for k in at]
            for k, x in zip(at, self._joined(mark, todo) if mark else self._apart(todo)):
                got[k] = x
        for u, x in zip(units, got):
            if len(u) <= CACHED_UNIT and u not in young:
                young[u] = x
                self.held += len(u) + len(x) + UNIT_COST
        if self.held > CACHE_BYTES:
            self.young, self.old, self.held = {}, young, 0
        return got

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> Iterator[bytes]:
        """Ids of the UTF-8 texts buf[offs[i]:offs[i + 1]]."""
        at = unit_starts(buf, offs[:-1][np.diff(offs) > 0])
        data = pa.py_buffer(np.ascontiguousarray(buf))
        units = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(at, len(buf)).astype(np.int64)), data])
        coded = units.dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist())
        index = coded.indices.to_numpy()
        size = np.array([len(x) for x in ids], dtype=np.int64) // 4
        n = size[index]
        upto = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat((np.cumsum(size) - size)[index] - upto[:-1], n) + np.arange(upto[-1])
        flat = np.frombuffer(b"".join(ids), dtype="<u4")[place].tobytes()
        ends = (4 * upto[np.searchsorted(at, offs)]).tolist()
        return (flat[x:y] for x, y in zip(ends, ends[1:]))


def _token_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    enc = Encoder(path)                                  # gone with the task, its cache too
    end = np.array([END_ID], dtype="<u4").tobytes()
    for b in batches:
        for at, to, buf, offs in W.slices(b.column("_text"), SLICE_BYTES):
            part = b.slice(at, to - at)
            starts, lengths, crcs = [], [], []
            for ids in enc.encode(buf, offs):
                ids += end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                cuts = [0, *range(first, n + 1, capacity)]
                starts.append(cuts[:-1])
                lengths.append([y - x for x, y in zip(cuts, cuts[1:])])
                crcs.append([zlib.crc32(ids[4 * x:4 * y]) for x, y in zip(cuts, cuts[1:])])
            longs = pa.list_(pa.int64())
            names = [c for c in b.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(starts, longs), pa.array(lengths, longs),
                                              pa.array(crcs, longs)], names=[*names, "starts", "lengths", "crcs"])


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row per piece."""
    src = docs.select("doc_id", F.col("text").cast("string").alias("_text"))
    kind = dict(src.dtypes)["doc_id"]
    got = src.mapInArrow(lambda it: _token_batches(it, tokenizer, capacity),
                         f"doc_id {kind}, starts array<long>, lengths array<long>, crcs array<long>")
    p = got.select("doc_id", F.posexplode(F.arrays_zip("starts", "lengths", "crcs")).alias("piece", "p"))
    return p.select("doc_id", F.col("piece").cast("int").alias("piece"), F.col("p.starts").alias("start"),
                    F.col("p.lengths").alias("length"), F.col("p.crcs").alias("ids_crc32"))


# ---------------------------------------------------------------- plan

def knapsack(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best value of every room 0 .. capacity and the length to take first (0: leave the rest empty); value[s] > 0 for the
    lengths that may be used, any number of times."""
    capacity = len(value) - 1
    v = np.where(value > 0, value, -np.inf)
    best = np.zeros(capacity + 1)
    pick = np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        gain = best[c - 1::-1] + v[1:c + 1] if c < capacity else best[capacity - 1::-1] + v[1:]
        k = int(gain.argmax())
        if gain[k] > 0:
            best[c], pick[c] = gain[k], k + 1
    return best, pick


def _filling(pick: np.ndarray, room: int) -> dict[int, int]:
    out: dict[int, int] = {}
    while room and pick[room]:
        s = int(pick[room])
        out[s] = out.get(s, 0) + 1
        room -= s
    return out


@dataclass
class Solution:
    columns: list[tuple[float, dict[int, int]]]     # (x, configuration), every length covered
    value: float                                    # sum of x
    bound: float                                    # no packing needs fewer sequences


def configuration_lp(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> Solution:
    """Multiplicative weights on: least sum of x with, for every length s, sum of x * (times s is held) >= counts[s].

    A length's price is its share of a sequence times exp(-eta * covered share). For any prices, counts times prices over
    the best price of a configuration is a lower bound (weak duality).
    """
    sizes = np.flatnonzero(counts)
    x: dict[tuple, float] = {}
    if not len(sizes):
        return Solution([], 0.0, 0.0)
    n = np.maximum(counts, 1).astype(float)
    covered = np.zeros(capacity + 1)
    share = np.arange(capacity + 1) / capacity
    bound = 0.0
    for _ in range(rounds):
        low = covered[sizes].min()
        if low >= 1:
            break
        price = np.zeros(capacity + 1)
        price[sizes] = share[sizes] * np.exp(-ETA * (covered[sizes] - low))
        best, pick = knapsack(price)
        bound = max(bound, float((counts * price).sum() / best[capacity]))
        ahead = covered + 2 * GRAIN
        for s in sizes[np.lexsort((-sizes, covered[sizes]))][:COLUMNS].tolist():         # those that lag
            conf = _filling(pick, capacity - s)
            conf[s] = conf.get(s, 0) + 1
            if sum(price[k] * m for k, m in conf.items()) < (1 - NEAR) * best[capacity] and s != sizes[covered[sizes].argmin()]:
                continue
            step = GRAIN * min(n[k] / m for k, m in conf.items())
            if any(covered[k] + step * m / n[k] > ahead[k] for k, m in conf.items() if k != s):
                continue                             # these prices are spent
            for k, m in conf.items():
                covered[k] += step * m / n[k]
            key = tuple(sorted(conf.items()))
            x[key] = x.get(key, 0.0) + step
    low = max(covered[sizes].min(), 1e-9)
    cols = [(v / low, dict(k)) for k, v in x.items()]
    return Solution(cols, sum(v for v, _ in cols), bound)


def best_fit(left: np.ndarray, capacity: int, runs: list[tuple[int, list[int]]]) -> list[tuple[int, list[int]]]:
    """Add left[s] pieces of every length s to the runs, longest first, into the smallest gap that takes it, else into new
    sequences."""
    runs = list(runs)
    gaps: dict[int, list[int]] = {}
    for k, (_, lens) in enumerate(runs):
        gaps.setdefault(capacity - sum(lens), []).append(k)
    sizes = np.zeros(capacity + 1, dtype=bool)
    for g in gaps:
        sizes[g] = True
    for s in np.flatnonzero(left)[::-1]:
        s = int(s)
        need = int(left[s])
        while need:
            fit = np.flatnonzero(sizes[s:])
            if len(fit):
                g = s + int(fit[0])
                k = gaps[g].pop()
                if not gaps[g]:
                    sizes[g] = False
                n, lens = runs[k]
                m = min(g // s, need // n) or 1  # best fit returns to the same sequence while it has the smallest gap
                if n > need:                     # split the run
                    runs[k] = (need, lens)
                    runs.append((n - need, list(lens)))
                    gaps.setdefault(g, []).append(len(runs) - 1)
                    sizes[g] = True
                    n = need
                runs[k] = (n, [*lens, *[s] * m])
                g -= s * m
                n *= m
            else:
                per = capacity // s
                n, m = (need // per, per) if need >= per else (1, need)
                runs.append((n, [s] * m))
                k, g = len(runs) - 1, capacity - s * m
                n = n * m
            need -= n
            gaps.setdefault(g, []).append(k)
            sizes[g] = True
    return runs


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Runs (number of equal sequences, lengths in them) that hold exactly counts[s] pieces of every length s: the rounded
    linear program or best-fit decreasing, whichever needs fewer sequences."""
    left = counts.astype(np.int64).copy()
    full: list[tuple[int, list[int]]] = []
    if left[capacity]:
        full.append((int(left[capacity]), [capacity]))
        left[capacity] = 0
    greedy = best_fit(left, capacity, full)
    runs = list(full)
    for x, conf in sorted(configuration_lp(left, capacity).columns, key=lambda c: -c[0]):
        n = min([int(x + 1e-9), *(int(left[s]) // m for s, m in conf.items())])
        if n > 0:
            runs.append((n, [s for s, m in sorted(conf.items(), reverse=True) for _ in range(m)]))
            for s, m in conf.items():
                left[s] -= n * m
    rounded = best_fit(left, capacity, runs)
    return min(rounded, greedy, key=lambda r: sum(n for n, _ in r))


def slot_table(runs: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank, per sequence, first sequence, first offset) of every run that holds the length."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    seq = 0
    for n, lens in runs:
        off = 0
        for s in sorted(set(lens), reverse=True):
            m = lens.count(s)
            out.setdefault(s, []).append((rank.get(s, 0), m, seq, off))
            rank[s] = rank.get(s, 0) + n * m
            off += s * m
        seq += n
    return {s: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for s, rows in out.items()}


def _place(batches: Iterator[pa.RecordBatch], slots: dict[int, tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        length = b.column("length").to_numpy()
        rank = b.column("_rank").to_numpy()
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for s in np.unique(length):
            at = np.flatnonzero(length == s)
            first, per, seq0, off0 = slots[int(s)]
            k = np.searchsorted(first, rank[at], side="right") - 1
            j = rank[at] - first[k]
            seq[at], off[at] = seq0[k] + j // per[k], off0[k] + (j % per[k]) * s
        names = [c for c in b.schema.names if c != "_rank"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(off)],
                                         names=[*names, "sequence_id", "offset"])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, ..., length). `pieces` should be a written stage."""
    hist = pieces.groupBy("length").count().collect()          # at most `capacity` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in hist:
        counts[r["length"]] = r["count"]
    slots = slot_table(plan(counts, capacity))
    held = pieces.sparkSession.sparkContext.broadcast(slots)
    rk = ranked(pieces, ["length"], ["doc_id", "piece"], ["doc_id", "piece"], int(counts.sum()), "_rank")
    rk = rk.select(*pieces.columns, "_rank")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return rk.mapInArrow(lambda it: _place(it, held.value), ddl)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(written(token_pieces(docs.select("doc_id", "text"), tokenizer, capacity), "pieces"), capacity)
