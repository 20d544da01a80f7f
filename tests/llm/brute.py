"""Plain versions of the operators, for small inputs."""

import hashlib


def words(text):
    return (text or "").encode().split()


def dedup(rows, window=13):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near(rows, threshold=0.8):
    """class and number of links of each row; rows are (id, text)."""
    sets = [shingles(t) if i is not None else set() for i, t in rows]
    above, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                above[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, None if i is None else least[root(k)], links[k]) for k, (i, _) in enumerate(rows)]
