"""Plain Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii_valid(kind: str, m: str) -> bool:
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(d) <= 15
    return True


def pii_base(text: str | None) -> list[tuple[str, int, int]]:
    t = text or ""
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(PATTERNS[k], t) if pii_valid(k, m.group())]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def spans_text(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def tokens3(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split() + [b""]


def unigram_scores(docs: list[tuple[int, str | None]]) -> dict[int, tuple[bool, int, int, int, float]]:
    """doc_id -> held_out, n_tokens, n_known, N, base score."""
    import math
    import zlib
    from collections import Counter
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    c = Counter(t for d, x in docs if not held[d] for t in tokens3(x))
    n, v = sum(c.values()), len(c)
    out = {}
    for d, x in docs:
        ts = tokens3(x)
        out[d] = (held[d], len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts))
    return out


def words6(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def repeats(texts: list[str | None], width: int = 35) -> list[tuple[int, int, str]]:
    """n_words, n_removed, kept_sha256 of every text."""
    from collections import Counter
    ws = [words6(t) for t in texts]
    seen = Counter(tuple(w[i:i + width]) for w in ws for i in range(len(w) - width + 1))
    out = []
    for w in ws:
        gone = {i + k for i in range(len(w) - width + 1) if seen[tuple(w[i:i + width])] > 1 for k in range(width)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text: str | None) -> int:
    import xxhash
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(ids: list, fps: list[int], radius: int = 4) -> list:
    """Smallest reachable id of every row."""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


WORD9 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words9(text: str | None) -> list[str]:
    return WORD9.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contamination(text: str | None, items: list[tuple], width: int = 10) -> tuple[int, int, int, str]:
    w = words9(text)
    hit, ids = set(), set()
    for item, t in items:
        iw = words9(t)
        m = min(width, len(iw))
        wins = {tuple(iw[i:i + m]) for i in range(len(iw) - m + 1)} if m else set()
        for i in range(len(w) - m + 1):
            if tuple(w[i:i + m]) in wins:
                hit |= set(range(i, i + m))
                ids.add(str(item))
    return len(w), len(hit), len(ids), sha(",".join(sorted(ids)))


def jaccard(a: str, b: str) -> float:
    def sh(t):
        w = re.split("[ \t\n\x0b\f\r]+", t)
        w = [x for x in w if x]
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    x, y = sh(a), sh(b)
    return len(x & y) / len(x | y)
