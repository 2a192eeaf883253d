"""Brute-force versions of the operators' rules, over plain Python values."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from xxhash import xxh64_intdigest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def statistics(text):
    w, text = words(text), text or ""
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def simhash(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def shingle_set(text, k=5):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similar(a, b, bound=0.8):
    """Whether two sets have that Jaccard similarity; empty ones are alike."""
    return len(a & b) >= bound * len(a | b)


def groups(n, linked):
    """Least position reachable from each of n positions; `linked(i, j)` says what is linked."""
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def repeat_flags(texts, window=35):
    """For each text, which of its words stay."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        out.append((~gone).tolist())
    return out


def without_repeats(texts, window=35):
    flags = repeat_flags(texts, window)
    return [(len(f), f.count(False), " ".join(x for x, stays in zip(words(t), f, strict=True) if stays)) for t, f in zip(texts, flags, strict=True)]


def in_place(text, kept):
    """`text` with only the words of the list `kept` (the words that stay, in order, as a list of flags), blanks as they were."""
    found = list(WORD.finditer(text or ""))
    if all(kept):
        return text or ""
    out = "" if not kept[0] else text[: found[0].start()]
    for k, (word, stays) in enumerate(zip(found, kept, strict=True)):
        if stays:
            out += text[word.start() : found[k + 1].start() if k + 1 < len(found) else len(text)]
    return out if kept[-1] else out.rstrip(" \t\n\x0b\f\r")


def url_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"(?s)[^?#]*", rest[len(host) :])[0]


def url_verdict(url, rules, default="allow"):
    host, path = url_parts(url)
    fits = [(h.count("."), len(p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[3], best[4]) if best else (host, path, None, default)
