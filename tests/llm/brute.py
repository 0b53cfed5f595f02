"""Plain Python versions, written from the operators' definitions."""

import hashlib
import math
import re
import struct
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            total += v - 9 * (v > 9)
        return 12 <= len(d) <= 19 and total % 10 == 0
    if kind == "phone":
        return 9 <= len(d) <= 15
    return True


def spans(text):
    out = []
    for k, p in enumerate(KINDS.values()):
        out += [(m.start(), k, m.end(), m.group(0)) for m in p.finditer(text or "") if holds(list(KINDS)[k], m.group(0))]
    return sorted(out)


def listed(found):
    return ",".join(f"{[*KINDS, 'term'][k]}:{a}:{b}" for a, k, b, *_ in sorted(found))


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def components(rows):
    """{doc_id: component} by all pairs through an inverted index; rows: (doc_id, text) with ids."""
    sets = defaultdict(set)
    for i, t in rows:
        s = shingles(t)
        if s:
            sets[i].add(s)
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    flat = [(i, s) for i, group in sets.items() for s in group]
    index = defaultdict(list)
    for k, (_, s) in enumerate(flat):
        for g in s:
            index[g].append(k)
    shared = Counter()
    for at in index.values():
        if len(at) > 1:
            for x in range(len(at)):
                for y in range(x):
                    shared[at[y], at[x]] += 1
    for (x, y), c in shared.items():
        (i, a), (j, b) = flat[x], flat[y]
        if 100 * c >= 80 * (len(a) + len(b) - c):
            i, j = root(i), root(j)
            parent[max(i, j)] = min(i, j)
    return {i: root(i) for i in parent}


def rules(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            marked.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def targets(sizes):
    """{source: target} by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in free)
        got = {s: rest * weight[s] / w for s in free}
        over = {s for s in free if got[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return got | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


def ids_bytes(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def pii_pieces(text):
    """(lo, piece, kind of the span after it) between the base spans."""
    at, out = 0, []
    for a, k, b, *_ in spans(text):
        if a >= at:
            out.append((at, text[at:a], k))
        at = max(at, b)
    return [*out, (at, text[at:], None)]


def pii_words(piece):
    """(start, end, word): maximal runs of two or more letters, marks and digits."""
    import regex

    return [(m.start(), m.end(), m[0].lower()) for m in regex.finditer(r"[\p{L}\p{M}\p{N}]{2,}", piece)]


def pii_telling(texts, support=3, own=2, own_length=3, generalise=0.7):
    """{term: share} of the terms that tell of an entity, over all rows."""
    per = []
    for t in texts:
        terms = {w for _, p, _ in pii_pieces(t or "") for _, _, w in pii_words(p)}
        per.append((terms, {(k, v) for _, k, _, v in spans(t or "")}))
    n, n_t, n_e, n_te = len(texts), Counter(), Counter(), Counter()
    for terms, entities in per:
        n_t.update(terms)
        n_e.update(entities)
        n_te.update((t, e) for e in entities for t in terms)
    out = {}
    for (t, e), c in n_te.items():
        part = e[0] == 0 and len(t) >= own_length and t in {w for _, _, w in pii_words(e[1])}
        if c + own * part >= support and n_e[e] < n:
            share = math.log(c * n / (n_t[t] * n_e[e])) / math.log(n / n_e[e])
            if share >= generalise:
                out[t] = max(share, out.get(t, 0))
    return out


def pii_sanitised(text, telling, remove=0.9):
    if text is None:
        return None
    out = []
    for _, piece, kind in pii_pieces(text):
        at = 0
        for a, b, w in pii_words(piece):
            if w in telling:
                word = "" if telling[w] >= remove else "[NUMBER]" if w.isnumeric() else "[CODE]" if any(c.isnumeric() for c in w) else "[TERM]"
                out += [piece[at:a], word]
                at = b
        out += [piece[at:], "" if kind is None else f"[{list(KINDS)[kind].upper()}]"]
    return "".join(out)
