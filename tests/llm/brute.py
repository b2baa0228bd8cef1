"""Plain versions of the operators for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def remove_repeats(docs, length=400):
    places = defaultdict(int)
    datas = [(d, (t or "").encode()) for d, t in docs]
    for _, data in datas:
        for i in range(len(data) - length + 1):
            places[data[i : i + length]] += 1
    rows = []
    for doc_id, data in datas:
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if places[data[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        rows.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return rows


def roots(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text, k, lower=True):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = WORD.findall(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def join_components(docs, k, num, den):
    sets = {d: shingle_set(t, k) for d, t in docs}
    ids = sorted(sets)
    links = [
        (a, b) for x, a in enumerate(ids) for b in ids[x + 1 :]
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    ]
    root = roots(ids, links)
    return [(d, len(sets[d]), root[d]) for d in ids]


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    held = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(held)
