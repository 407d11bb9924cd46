"""Texts with the edge cases that every operator must handle, and brute-force versions of the operators."""
import collections
import hashlib
import re

LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
COLUMNS = "doc_id long, text string, lang string, id long, items string"


def frame(spark, texts):
    """Rows with ids from 0, and extra columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, "en", 7, "x") for i, t in enumerate(texts)], COLUMNS)


PASSAGE = " ".join(f"word{i} is here" for i in range(40))
TEXTS = [None, "", " \n\t", "one", "One two", "Alpha beta gamma delta", "alpha BETA gamma delta", "alpha beta gamma delta", PASSAGE, PASSAGE, PASSAGE + " tail", "head " + PASSAGE,
         "naïve Ünïcode 東京 " * 30, "a" * 700, "of " * 400, "long " + " ".join(f"w{i * 7919 % 997}" for i in range(6000)), "x y z"]


def bytes_of(t):
    return (t or "").encode()


def repeats(texts, length):
    """(n_removed, spans, kept hash) of each text."""
    count = collections.Counter(b[k : k + length] for b in map(bytes_of, texts) for k in range(len(b) - length + 1))
    out = []
    for b in map(bytes_of, texts):
        mask = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                mask[k : k + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(mask))]
        out.append((sum(mask), spans, hashlib.sha256(bytes(x for x, m in zip(b, mask) if not m)).hexdigest()))
    return out


def shingles(text, width):
    words = bytes_of(text).translate(LOWER).split()
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else [])


def classes(texts, width, percent):
    """Component of each row: the smallest row it reaches."""
    sets = [shingles(t, width) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]
