"""Plain versions of the operators, over all pairs or all rows of a small table."""

import re
import zlib
from itertools import combinations

import numpy as np


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = words(lowered)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(ids, links):
    """id -> smallest id reachable."""
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_duplicates(docs, percent=85):
    sets = {i: shingle_set(t) for i, t in docs}
    links = []
    for a, b in combinations([i for i in sets if sets[i]], 2):
        x, y = sets[a], sets[b]
        if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
            shared = len(x & y)
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                links.append((a, b))
    return {i: (len(sets[i]), c) for i, c in groups(sets, links).items()}


def counts(text):
    w = words(text)
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


def cosine_links(vectors, least=0.95):
    usable = {i: np.asarray(v, float) for i, v in vectors if v is not None and len(v) and None not in v}
    usable = {i: v for i, v in usable.items() if np.isfinite(v).all() and np.linalg.norm(v) > 0}
    return [(a, b) for a, b in combinations(usable, 2) if len(usable[a]) == len(usable[b])
            and usable[a] @ usable[b] / (np.linalg.norm(usable[a]) * np.linalg.norm(usable[b])) >= least]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
