"""Plain single-machine versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def simhash(text, shingle=3):
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        for j in linked(i):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash_groups(rows, radius=3):
    """rows: (id, text) -> {(id, fingerprint, least id reachable)}"""
    fps = [simhash(t) for _, t in rows]
    array = np.array(fps, np.uint64)
    bits = np.unpackbits(array.view(np.uint8).reshape(-1, 8), axis=1)
    roots = components(len(rows), lambda i: np.flatnonzero((bits != bits[i]).sum(axis=1) <= radius).tolist())
    least = defaultdict(list)
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r].append(i)
    return [(i, f"{f:016x}", min(least[r], default=None)) for (i, _), f, r in zip(rows, fps, roots, strict=True)]


def shingles(text, shingle=5):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1)))


def near_groups(rows, similarity=0.8):
    """rows: (id, text) -> the rows' components by Jaccard similarity of their word shingles"""
    sets = [shingles(t) for _, t in rows]
    near = lambda i: [j for j in range(len(rows)) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    return components(len(rows), near)


def without_repeats(rows, threshold=200):
    counts = Counter()
    data = [(t or "").encode() for _, t in rows]
    for d in data:
        counts.update(d[i : i + threshold] for i in range(len(d) - threshold + 1))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 1, bool)
        for s in range(len(d) - threshold + 1):
            if counts[d[s : s + threshold]] > 1:
                gone[s : s + threshold] = True
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def pieces(rows, encode, size=2048):
    out = []
    for i, t in rows:
        ids = [*encode(t or ""), 0]
        for p, s in enumerate(range(0, len(ids), size)):
            part = ids[s : s + size]
            out.append((i, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out
