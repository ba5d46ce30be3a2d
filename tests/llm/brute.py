"""Plain versions of the registered queries, straight from their definitions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return SPACED.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def windows(seq, n):
    return [tuple(seq[i : i + n]) for i in range(len(seq) - n + 1)]


def quality(text):
    w = words(text)
    seen = Counter(windows(w, 5))
    covered = {j for i, x in enumerate(windows(w, 5)) if seen[x] > 1 for j in range(i, i + 5)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def decontaminated(docs, items):
    found = {}
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        for x in windows(w, min(10, len(w))) if w else []:
            found.setdefault(x, set()).add(str(item))
    sizes = {len(x) for x in found}
    rows = []
    for d, text in docs:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, named = set(), set()
        for n in sizes:
            for i, x in enumerate(windows(w, n)):
                if x in found:
                    hit.update(range(i, i + n))
                    named |= found[x]
        rows.append((d, len(w), len(hit), len(named), sha(",".join(sorted(named))), bool(hit)))
    return rows


def without_repeats(docs, n=13):
    first = {}
    for d, text in docs:
        for x in windows(words(text), n) if d is not None else []:
            first[x] = min(first.get(x, d), d)
    rows = []
    for d, text in docs:
        w = words(text)
        gone = set()
        for i, x in enumerate(windows(w, n)) if d is not None else []:
            if first[x] < d:
                gone.update(range(i, i + n))
        rows.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return rows


def components(docs, n, percent):
    sets = {}
    for d, text in docs:
        w = words((text or "").translate(LOWER))
        sets[d] = set(windows(w, min(n, len(w)))) if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(d, len(sets[d]), find(d)) for d in ids]
