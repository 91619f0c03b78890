"""Brute-force versions that several test modules use."""

import collections
import hashlib
import re

import numpy as np
import xxhash


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def judged(texts, bench):
    windows = collections.defaultdict(set)
    for item, t in bench:
        w = words(t)
        m = min(13, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[i:i + m])].add("" if item is None else str(item))
    out = []
    for t in texts:
        w, hit, items = words(t), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                found = windows.get(tuple(w[i:i + m]))
                if found:
                    hit.update(range(i, i + m))
                    items |= found
        out.append((len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(t):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, t, re.A):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                  "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def bits_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.nonzero(np.bitwise_count(f ^ f[i]) <= 3)[0].tolist():
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    roots = [find(i) for i in range(len(f))]
    low = {}
    for r, i in zip(roots, ids):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [low.get(r) for r in roots], roots
