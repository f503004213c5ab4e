"""Plain versions of the operators, over lists of (doc_id, text)."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard_classes(rows, threshold=0.8):
    """{id: (class, links)} by comparing all pairs that share a run of words."""
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    holders = defaultdict(list)
    parent = {i: i for i in sets}
    links = Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        common = Counter(j for run in sets[i] for j in holders[run])
        for j, n in common.items():
            if n >= threshold * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for run in sets[i]:
            holders[run].append(i)
    return {i: (find(i), links[i]) for i in sets}


def removed_bytes(rows, length=50):
    """[(id, bytes, removed, spans, sha256 of the rest)] in the order of rows."""
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        if i is not None:
            for k in range(len(data) - length + 1):
                part = data[k : k + length]
                first[part] = min(i, first.get(part, i))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        if i is not None:
            for k in range(len(data) - length + 1):
                if first[data[k : k + length]] < i:
                    gone[k : k + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        rest = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def generalised_jaccard(a, b):
    x, y = Counter(words(a)), Counter(words(b))
    if not x and not y:
        return 1.0
    both = set(x) | set(y)
    return sum(min(x[w], y[w]) for w in both) / sum(max(x[w], y[w]) for w in both)


def unigram(rows, held):
    """{id: (tokens, known, training tokens, base score)}"""
    tokens = {i: [*words((t or "").translate(LOWER)), None] for i, t in rows}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    return {
        i: (
            len(ws),
            sum(counts[w] > 0 for w in ws),
            total,
            float(sum(np.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws)),
        )
        for i, ws in tokens.items()
    }
