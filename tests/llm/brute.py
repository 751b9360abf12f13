"""Plain single-threaded statements of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def substring(rows, size=13):
    holders = defaultdict(set)
    top = float("inf")
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - size + 1):
            holders[tuple(w[i:i + size])].add(top if doc is None else doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - size + 1):
            if min(holders[tuple(w[i:i + size])]) < (top if doc is None else doc):
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, size=3):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


def components(rows, percent=90, size=3):
    sets = [(doc, shingles(text, size)) for doc, text in rows]
    label = {doc: doc for doc, _ in sets if doc is not None}
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i]
             if x and y and a is not None and b is not None and 100 * len(x & y) >= percent * len(x | y)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return [(doc, len(s), label.get(doc)) for doc, s in sets]


def measures(rows):
    out = []
    for doc, text in rows:
        text = text or ""
        w = words(text)
        windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] >= 2 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if words(x)]
        chars, symbols = sum(map(len, w)), sum(c in "#*$%&|<>" for c in text)
        dup = len(lines) - len(set(lines))
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        bad = 2 * chars < 5 * len(w) or chars > 12 * len(w) or 10 * symbols > len(w) or 10 * dup > 4 * len(lines)
        out.append((doc, len(w), chars, symbols, dup, len(covered), failed, not failed and not bad))
    return out


def copies(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[SPACE.sub(" ", text or "")].append(doc)
    out = []
    for doc, text in rows:
        norm = SPACE.sub(" ", text or "")
        keep = min((d for d in groups[norm] if d is not None), default=None)
        out.append((doc, keep, len(groups[norm]), doc == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=repr)
