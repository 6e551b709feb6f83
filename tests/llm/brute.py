"""Plain versions of the contracts, for comparison on small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
_ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_A2Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return _SPACE.findall(text or "")


def fingerprint(text):
    w = words((text or "").translate(_A2Z))
    if not w:
        return 0
    grams = [" ".join(w)] if len(w) < 4 else [" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def substring(docs, width=50):
    """{doc_id: (n_words, n_removed, sha)} of {doc_id: text}."""
    first = {}
    every = {i: words(t) for i, t in docs.items()}
    for i, w in every.items():
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in every.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def contamination(docs, items, width=13):
    split = lambda t: _ALNUM.findall((t or "").translate(_A2Z))
    owners = defaultdict(set)
    for i, t in items:
        w = split(t)
        if w:
            size = min(width, len(w))
            for k in range(len(w) - size + 1):
                owners[tuple(w[k : k + size])].add(str(i))
    sizes = {len(k) for k in owners}
    out = {}
    for d, t in docs.items():
        w = split(t)
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (o := owners.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    found |= o
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w))
    return out


def quality_base(text):
    text = text or ""
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    rep = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep), n < 50 or 100 * len(rep) > 50 * n
