"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re

LAST = 1 << 63


def at(doc_id):
    return LAST if doc_id is None else doc_id


def shingles(text, size=5):
    words = (text or "").lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def classes(rows, threshold=0.8):
    """{text: (text_id, copies, class_id, links, class number)} of (doc_id, text) rows."""
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(text or "", []).append(at(doc_id))
    names = list(texts)
    sets = [shingles(t) for t in names]
    root, links = list(range(len(names))), [0] * len(names)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(names)):
        for j in range(i):
            if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    head = {}
    for i, t in enumerate(names):
        head[find(i)] = min(head.get(find(i), LAST), min(texts[t]))
    return {t: (min(texts[t]), len(texts[t]), head[find(i)], links[i], find(i)) for i, t in enumerate(names)}


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def removed_lines(rows, least=4, near=10):
    """{(place, text): numbers of the lines that go} of (doc_id, text) rows."""
    lines = [
        (at(d), i, tuple(x.lower().split()), t) for d, t in rows for i, x in enumerate((t or "").split("\n"))
    ]
    first = {}
    for a, i, words, _ in lines:
        if len(words) >= least:
            first[words] = min(first.get(words, (LAST, 0)), (a, i))
    close = {
        w
        for w, place in first.items()
        if len(w) >= near
        and any(len(v) >= near and p < place and abs(len(v) - len(w)) < 2 and distance(v, w) <= 1 for v, p in first.items())
    }
    gone = {}
    for a, i, words, t in lines:
        if len(words) >= least:
            inside = any(x.lower().split() == list(words) for x in (t or "").split("\n")[:i])
            if first[words][0] < a or words in close or inside:
                gone.setdefault((a, t), set()).add(i)
    return gone


def without_lines(rows):
    gone = removed_lines(rows)
    kept = []
    for d, t in rows:
        lost = gone.get((at(d), t), set())
        text = t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in lost)
        kept.append((d, text, sorted(lost), 0 if t is None else t.count("\n") + 1))
    return kept


def words(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def holds(text, item):
    """Whether a text has all words of an item in a row."""
    a, b = words(text), words(item)
    return any(a[i : i + len(b)] == b for i in range(len(a) - len(b) + 1))
