"""Plain Python versions of the contracts."""

import re
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def repeats(texts, window):
    words = [SPACED.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for p in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def hits(texts, items, window):
    spans = []
    for item in items:
        w = ALNUM.findall((item or "").translate(LOW))
        k = min(window, len(w))
        spans.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    out = []
    for text in texts:
        w, hit, found = ALNUM.findall((text or "").translate(LOW)), set(), set()
        for n, item in enumerate(spans):
            for g in item:
                for i in range(len(w) - len(g) + 1):
                    if tuple(w[i:i + len(g)]) == g:
                        hit |= set(range(i, i + len(g)))
                        found.add(n)
        out.append((len(w), len(hit), found))
    return out


def shingles(text, size=5):
    w = SPACED.findall((text or "").translate(LOW))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def groups(rows, size=5, percent=80):
    """Smallest key that each row reaches by links."""
    sets = [shingles(t, size) for _, t in rows]
    where, parent = defaultdict(list), list(range(len(rows)))
    for n, s in enumerate(sets):
        for g in s:
            where[g].append(n)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, s in enumerate(sets):
        for m, o in Counter(m for g in s for m in where[g] if m > n).items():
            if 100 * o >= percent * (len(s) + len(sets[m]) - o):
                parent[find(m)] = find(n)
    least = {}
    for n, (key, _) in enumerate(rows):
        if key is not None:
            least[find(n)] = min(key, least.get(find(n), key))
    return [(len(sets[n]), least.get(find(n)) if sets[n] else rows[n][0]) for n in range(len(rows))]
