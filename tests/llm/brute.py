"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def base_stats(text):
    t = text or ""
    w = words(t)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside)


def removed(docs, window=13):
    first = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def grams(text, k):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def links(docs, k, percent):
    """(doc_id, set size, component) of rows; ids may repeat or be null."""
    sets = [grams(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if (o and 100 * o >= percent * len(sets[a] | sets[b])) or (docs[a][0] is not None and docs[a][0] == docs[b][0] and sets[a] and sets[b] and sets[a] == sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(docs):
        if i is not None:
            least[find(a)].append(i)
    return [(i, len(sets[a]), min(least[find(a)], default=None) if sets[a] else i) for a, (i, _) in enumerate(docs)]


def spans(text):
    t = text or ""
    key = r"(password|passwd|secret|token|api_?key)"
    rules = [
        ("assign", rf"(?ai:{key})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]+", 0, 32),
    ]
    found = []
    for n, (_, p, g, least) in enumerate(rules):
        found += [(m.start(), n, m.end()) for m in re.finditer(p, t) if len(m[g]) >= least]
    return ",".join(f"{rules[n][0]}:{s}:{e}" for s, n, e in sorted(found))


def leaks(docs, items, k=5, percent=80):
    """(doc_id, item_id, shingles of the item, those of them in the document); an item of fewer than k words is one shingle."""
    clean = lambda t: words(re.sub(r"[^\w\x20\x09-\x0D]|_", "", (t or "").lower()))
    cut = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    sides = [(j, min(k, len(w)), cut(w, min(k, len(w)))) for j, w in ((j, clean(t)) for j, t in items) if w]
    said = [(i, clean(t)) for i, t in docs]
    found = ((i, j, len(s), len(s & cut(w, n))) for i, w in said for j, n, s in sides)
    return sorted(x for x in found if 100 * x[3] >= percent * x[2])
