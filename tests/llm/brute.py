"""Plain counterparts of the operators."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def roots(nodes, links):
    """Smallest node that links reach, by node."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(text, width=5):
    w = SPACED.findall(low(text))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def jaccard_classes(texts, percent=80):
    """texts by id: (size of the set, smallest id of the class)."""
    sets = {n: shingles(t) for n, t in texts.items()}
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                links.append((a, b))
    top = roots(ids, links)
    return {n: (len(sets[n]), top[n]) for n in ids}


def hits(texts, items, width=8):
    """texts by id: (words, words hit, ids of items found)."""
    windows = {}
    for item, text in items:
        w = WORD.findall(low(text))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(item)
    out = {}
    for n, text in texts.items():
        w, hit, found = WORD.findall(low(text)), set(), set()
        for size in set(map(len, windows)):
            for k in range(len(w) - size + 1):
                if (x := windows.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    found |= x
        out[n] = (len(w), len(hit), found)
    return out


def phrase_places(text, phrases):
    """(start, label) of all places."""
    w = WORD.findall(low(text))
    return [(k, label) for p, label in phrases for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
