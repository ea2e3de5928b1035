"""Plain versions of the operators, for comparison on small inputs."""

import hashlib
import re

import numpy as np


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def components(ids, links):
    parent = {i: i for i in ids}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {i: find(parent, i) for i in ids}


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = components(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def substrings(rows, length=100):
    """doc_id -> (bytes, removed, spans, remaining bytes)."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        x = (t or "").encode()
        cover = np.zeros(len(x) + 1, int)
        for p in range(len(x) - length + 1):
            w = x[p : p + length]
            if w in seen:
                cover[p] += 1
                cover[p + length] -= 1
            seen.add(w)
        gone = np.cumsum(cover)[:-1] > 0
        rest = np.frombuffer(x, np.uint8)[~gone].tobytes()
        out[i] = (len(x), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), rest)
    return out


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()
