"""Plain Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib

SPACE = b" \t\n\r\x0b\x0c"


def _low(text):
    return (text or "").encode().lower()  # bytes: A-Z only


def shingle_set(text, n):
    w = _low(text).split()
    return {tuple(w)} if w and len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def near_groups(docs, n, percent):
    """[(doc_id, text)] -> {(doc_id, n_shingles, component, kept)}; doc_ids must be distinct."""
    sets = {d: shingle_set(t, n) for d, t in docs}
    top = {d: d for d in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    by: dict = {}
    for d in ids:
        for s in sets[d]:
            by.setdefault(s, []).append(d)
    seen = {(a, b) for x in by.values() for i, a in enumerate(x) for b in x[i + 1 :]}
    for a, b in seen:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((root(a), root(b)))
            top[b] = a
    return {(d, len(sets[d]), root(d), root(d) == d) for d in ids}


def decontaminated(docs, items, window):
    word = re.compile(rb"[0-9a-z\x80-\xff]+")
    windows: dict = {}
    for i, t in items:
        w = word.findall(_low(t))
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = set()
    for d, t in docs:
        w = word.findall(_low(t))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[k]
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out.add((d, len(w), len(hit), len({x for x in found if x is not None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def without_repeats(docs, n):
    """Bytes covered by an n-byte string that starts anywhere else go."""
    where: dict = {}
    raw = [(t or "").encode() for _, t in docs]
    for k, b in enumerate(raw):
        for s in range(len(b) - n + 1):
            where.setdefault(b[s : s + n], []).append((k, s))
    gone = [bytearray(len(b)) for b in raw]
    for places in where.values():
        if len(places) > 1:
            for k, s in places:
                gone[k][s : s + n] = b"\1" * n
    out = []
    for (d, _), b, g in zip(docs, raw, gone):
        kept = bytes(x for x, y in zip(b, g) if not y)
        spans = sum(1 for i, y in enumerate(g) if y and not (i and g[i - 1]))
        out.append((d, len(b), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def token_pieces(docs, encode, most):
    out = []
    for d, t in docs:
        ids = [*encode(t or ""), 0]
        first = len(ids) % most or most if len(ids) > most else len(ids)
        cuts = [0, *range(first, len(ids) + 1, most)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((d, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))))
    return sorted(out, key=str)
