"""Plain versions of the operators, over rows in memory."""

from __future__ import annotations

import hashlib
import re

import xxhash


def repeats(rows, length=100):
    """(doc_id, text) rows in any order: the removed places of each."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        rest = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def simhash(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_classes(prints, radius=4):
    """{id: fingerprint}: smallest reachable id of each."""
    parent = {d: d for d in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}


def best_windows(text, items, similarity=0.8):
    """{item: (similarity, first word)} of the best window of each item (item_id, text), by counting shingles."""
    from collections import Counter

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())

    def grams(w):
        n = min(5, len(w))
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else Counter()

    own, out = words(text), {}
    for item, item_text in items:
        wanted = words(item_text)
        size = min(len(wanted), len(own))
        if not size or (len(wanted) < 5 and size < len(wanted)):
            continue
        counts = grams(wanted)
        for i in range(len(own) - size + 1):
            window = grams(own[i : i + size])
            both = sum((counts & window).values())
            found = both / (sum(counts.values()) + sum(window.values()) - both)
            if found >= similarity and (item not in out or found > out[item][0]):
                out[item] = (found, i)
    return out


def license_base(text):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in phrases.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))
