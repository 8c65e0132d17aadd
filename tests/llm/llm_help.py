"""Brute-force versions of what the operators compute."""

import hashlib
import re
from collections import Counter

import numpy as np

SF = "/root/testdata/sf0.001"


def spec_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_components(rows, k):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, by = {}, {}
    for i, t in rows:
        w = spec_words((t or "").translate(low))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        for g in sets[i]:
            by.setdefault(g, []).append(i)
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sorted(sets):
        for j, n in Counter(j for g in sets[i] for j in by[g] if j < i).items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def brute_repeats(rows, span=50):
    first, ws = {}, {}
    for i, t in rows:
        w = ws[i] = spec_words(t)
        for a in range(len(w) - span + 1):
            k = tuple(w[a : a + span])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in ws.items():
        gone = set()
        for a in range(len(w) - span + 1):
            if first[tuple(w[a : a + span])] < i:
                gone.update(range(a, a + span))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out


def uneven_copies(n=400, heavy=300, words=400):
    """Copies of one text: the first ones have eight or nine edits and link only to copies with one
    or two, which are the smallest node of few keys."""
    rng, texts = np.random.default_rng(4), []
    for i in range(n):
        ws = [f"c{j}" for j in range(words)]
        for j in rng.choice(words, int(rng.integers(8, 10) if i < heavy or rng.random() < 0.5 else rng.integers(1, 3)), replace=False):
            ws[j] = f"x{i}_{j}"
        texts.append((i, " ".join(ws)))
    return texts
