"""Plain Python versions of what the operators must return, for small inputs."""

import hashlib
import re


def removed_bytes(rows, length):
    """rows: (doc_id, text) -> {doc_id: (n_bytes, n_removed, n_spans, sha)} by the definition; ids distinct."""
    seen, out = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\x01" * length
            else:
                seen[w] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[doc_id] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def jaccard_components(rows, k, percent):
    """{doc_id: (n_shingles, component)}; pairs found by a plain inverted index, then every pair counted."""
    sets = {d: shingles(t, k) for d, t in rows}
    post, parent = {}, {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for d in sorted(sets, key=lambda d: (len(sets[d]), d)):
        count = {}
        for s in sets[d]:
            for e in post.get(s, ()):
                count[e] = count.get(e, 0) + 1
            post.setdefault(s, []).append(d)
        for e, n in count.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def passage_components(rows, span=46, percent=80, words=5):
    """{doc_id: least id linked}: every two windows of ``span`` shingles compared; small inputs only."""
    import numpy as np

    toks = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        toks[d] = [tuple(w[i : i + words]) for i in range(len(w) - words + 1)]
    parent = {d: d for d in toks}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    post = {}
    for d, s in toks.items():
        for x in set(s):
            post.setdefault(x, set()).add(d)
    ids = sorted(toks)
    for a in ids:
        near = {}
        for x in set(toks[a]):
            for b in post[x]:
                if b > a:
                    near[b] = near.get(b, 0) + 1
        for b, n in near.items():
            if n < 2 * percent * span / (100 + percent) * 0.9 or len(toks[b]) < span or len(toks[a]) < span:
                continue
            hit = False
            for i in range(len(toks[a]) - span + 1):
                x = set(toks[a][i : i + span])
                flag = np.array([t in x for t in toks[b]])
                c = np.convolve(flag, np.ones(span, int), "valid")
                for j in np.flatnonzero(c >= 0.8 * span):
                    y = set(toks[b][j : j + span])
                    if 100 * len(x & y) >= percent * len(x | y):
                        hit = True
                        break
                if hit:
                    break
            if hit:
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {d: find(d) for d in ids}
