"""Small corpora and plain brute-force versions of the text operators."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """``(doc_id, text[, source])`` rows as a documents table."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def corpus(seed=1, n=60, vocabulary=400):
    """Texts with exact copies, near copies, shared passages, short and odd texts."""
    draw = random.Random(seed)
    word = lambda: "w" + "".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 7)))
    words = [word() for _ in range(vocabulary)]
    passage = " ".join(draw.choice(words) for _ in range(30))
    rows = []
    for i in range(n):
        text = " ".join(draw.choice(words) for _ in range(draw.choice([2, 9, 40, 120])))
        if i % 7 == 3:
            text = rows[draw.randrange(len(rows))][1]
        elif i % 7 == 5:
            parts = rows[draw.randrange(len(rows))][1].split(" ")
            parts[draw.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        elif i % 5 == 2:
            text = text + "\n" + passage + " " + text[:20]
        rows.append((i * 3 + 1, text))
    return rows + [(1000, ""), (1001, " \t\n"), (1002, "One."), (1003, "élan Ünïcode  naïve\x0bword"), (1004, "")]


def fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, prints, linked):
    """Smallest id reachable for each position; ``linked`` compares two prints."""
    label = list(range(len(ids)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(prints[i], prints[j]):
                label[top(i)] = top(j)
    best = collections.defaultdict(lambda: 1 << 60)
    for i, d in enumerate(ids):
        best[top(i)] = min(best[top(i)], d)
    return [best[top(i)] for i in range(len(ids))]


def cut(rows, span=13):
    """Per row: words, removed words, kept text."""
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - span + 1):
            key = tuple(w[i : i + span])
            first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - span + 1):
            if first[tuple(w[i : i + span])] < d:
                gone[i : i + span] = True
        out.append((d, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded_words(text):
    return FOLDED.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def leaks(rows, items, window=10):
    """Per row: words, hit words, item ids."""
    windows = collections.defaultdict(set)
    for name, text in items:
        w = folded_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(str(name))
    sizes = {len(k) for k in windows}
    out = []
    for d, text in rows:
        w, hit, found = folded_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                names = windows.get(tuple(w[i : i + n]))
                if names:
                    hit |= set(range(i, i + n))
                    found |= names
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def paragraphs(text):
    return collections.Counter(y for y in (x.strip(" ") for x in re.findall(r"[^.!?\n]*[.!?]+|[^.!?\n]+", text or "")) if y)


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    total = sum(a.values()) + sum(b.values())
    return 1.0 if not total else 1 - (sum((a - b).values()) + sum((b - a).values())) / total


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
