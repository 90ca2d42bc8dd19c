"""Plain single-machine versions of the operators, for comparison."""

import hashlib
import re
from collections import Counter, defaultdict


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def components(rows, width, percent=80):
    """{index: smallest id reachable} for rows (doc_id, text)."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i in range(len(rows)):
        if rows[i][0] is not None:
            least[find(i)].append(rows[i][0])
    return [min(least[find(i)], default=None) if sets[i] else rows[i][0] for i in range(len(rows))], sets


def repeats(texts, length):
    """(bytes, removed, runs, sha256 of the rest, removed flags) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        runs = len(re.findall(b"\x01+", bytes(gone)))
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), runs, hashlib.sha256(rest).hexdigest(), bytes(gone)))
    return out


def words_only(text):
    return " ".join(re.findall(r"[^\W_]+", (text or "").lower()))
