"""Plain restatements of the contracts, for small inputs."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def measures(text):
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = {g for g, n in Counter(grams).items() if n > 1}
    hit = {i + k for i, g in enumerate(grams) if g in many for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    rep = len(hit)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), rep, len(w) < 10 or 100 * rep > 20 * len(w))


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def repeats(rows, k=50):
    """doc_id -> (n_words, kept words) for distinct ids."""
    first = {}
    for d, t in rows:
        if d is not None:
            w = words(t)
            for i in range(len(w) - k + 1):
                g = tuple(w[i : i + k])
                first[g] = min(first.get(g, d), d)
    out = {}
    for d, t in rows:
        w = words(t)
        gone = set()
        if d is not None:
            for i in range(len(w) - k + 1):
                if first[tuple(w[i : i + k])] < d:
                    gone.update(range(i, i + k))
        out[d] = (len(w), [x for i, x in enumerate(w) if i not in gone])
    return out
