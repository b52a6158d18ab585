"""Plain-Python versions of the contracts, and frames with every odd case."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns whose names the operators use inside; they must not disturb.
CLASHES = {"row_key": "x", "words": "y", "size": "z", "node": "n", "norm": "m", "h": "h", "skey": "s", "term": "t", "repo": "r", "owner": "o", "held_out": "q", "terms": "u", "part": "p"}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def documents(spark, rows, clashes=True):
    """rows: (doc_id, text, source)."""
    names = [c.split()[0] for c in DOCS.split(", ")]
    schema = DOCS + ("".join(f", {c} string" for c in CLASHES) if clashes else "")
    data = [(i, t, "en", s, None, *(CLASHES.values() if clashes else ())) for i, t, s in rows]
    df = spark.createDataFrame(data, schema)
    assert df.columns[:5] == names
    return df


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingle_set(text, n=5):
    w = words(text)
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def links(texts, least=0.8):
    """Indices of linked pairs of a list of texts."""
    sets = [shingle_set(t) for t in texts]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    both = Counter(pair for own in holders.values() for pair in combinations(own, 2))
    return sorted((a, b) for (a, b), n in both.items() if n >= least * (len(sets[a]) + len(sets[b]) - n) - 1e-9)


def classes(n, pairs):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def hits(text, items, window=10):
    """(number of words, number of hit words, sorted ids of items) for (item_id, text) items."""
    w = words(text)
    hit, found = set(), set()
    for item, item_text in items:
        v = words(item_text)
        n = min(window, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p:p + n] == v[i:i + n]:
                    hit.update(range(p, p + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def phrases(text):
    w = words(text)
    at = [(i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    n = Counter(k for _, k, _ in found)
    kinds = ("assign", "access", "hex")
    spans = [f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found)]
    return n[0], n[1], n[2], digest(",".join(spans)), spans


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(text):
    text = text or ""
    out = {
        "email": [m for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)],
        "phone": [m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15],
    }
    spans = [f"{k}:{m.start()}:{m.end()}" for k, ms in out.items() for m in ms]
    return tuple(len(ms) for ms in out.values()), digest(",".join(spans)), spans


def targets(sizes):
    """Targets of sources (name or None -> size) by filling up and resharing."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        share = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / share >= 2 * sizes[s]]
        if not full:
            target |= {s: left * weight[s] / share for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        free -= set(full)
        left = 1.5 * sum(sizes.values()) - sum(target.values())
    return target


def nearest(rows, queries, k=20):
    """rows: (vec_id, vector); per query id the best (vec_id, score), over valid rows."""
    import numpy as np

    good = {(i, tuple(map(float, v))) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, qv in sorted(good):
        if q in queries:
            best = defaultdict(lambda: -np.inf)
            for i, v in good:
                if i != q and len(v) == len(qv):
                    best[i] = max(best[i], float(np.dot(np.array(qv), np.array(v))))
            out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out
