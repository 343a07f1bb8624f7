"""The operators' contracts in plain Python, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, n=5):
    w = words((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    found = {i: i for i in sets}
    changed = True
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    while changed:
        changed = False
        for a, b in links:
            low = min(found[a], found[b])
            if found[a] != low or found[b] != low:
                found[a] = found[b] = low
                changed = True
    return {i: (len(sets[i]), found[i]) for i in sets}


def passages(rows, n=13):
    first = {}
    for i, t in sorted(rows):
        w = words(t)
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def long_repeats(rows, n=400):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + n] for _, b in data for k in range(len(b) - n + 1))
    out = {}
    for i, b in data:
        gone = [False] * len(b)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = [True] * n
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def statistics(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    repeated = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return (
        len(w),
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(repeated),
    )


def nearest(vectors, k=10):
    """query -> [(vec_id, distance)] for every hundredth usable vector."""
    good = {
        i: [float(x) for x in v]
        for i, v in vectors
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    }
    out = {}
    for q in good:
        if q % 100 == 0:
            ds = sorted((math.dist(good[q], good[i]), i) for i in good if i != q)
            out[q] = [(i, d) for d, i in ds[:k]]
    return out


def text_crc(text):
    return zlib.crc32((text or "").encode())


def groups(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out
