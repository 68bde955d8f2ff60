"""Plain versions of the operators, for small tables."""

import hashlib

LATEST = 2**63 - 1


def order(d):
    return LATEST if d is None else d


def remove_bytes(rows, k=50):
    """rows of (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept bytes."""
    least, out = {}, []
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - k + 1):
            w = b[i : i + k]
            least[w] = min(least.get(w, LATEST), order(d))
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - k + 1):
            if least[b[i : i + k]] < order(d):
                gone[i : i + k] = [True] * k
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def remove_words(rows, k=50):
    least, out = {}, []
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - k + 1):
            x = tuple(w[i : i + k])
            least[x] = min(least.get(x, LATEST), order(d))
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if least[tuple(w[i : i + k])] < order(d):
                gone[i : i + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out
