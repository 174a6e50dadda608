"""What several tests of the corpus operators share."""

import hashlib

from tilewright.llm.common import words_of

VOCABULARY = [a + b + c for a in ("ka", "to", "mi", "re", "su") for b in ("n", "l", "st", "") for c in ("a", "or", "ish", "um")]


def sentence(rng, n):
    return " ".join(rng.choices(VOCABULARY, k=n))


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def window_truth(texts, items):
    out = {}
    for name, text in texts:
        words, hit, found = words_of(text), set(), set()
        for item, said in items:
            w = words_of(said)
            n = min(8, len(w))
            windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
            for i in range(len(words) - n + 1 if n else 0):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        out[name] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)
    return out
