"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import base64
import collections
import hashlib

import numpy as np

from faultsift.llm.decontamination import best_overlap, tokens


def roots(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def jaccard(docs):
    """{id: (set size, component)} of (id, text) by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    lists, seen, edges = collections.defaultdict(list), set(), []
    for i, s in sets.items():
        for gram in s:
            lists[gram].append(i)
    for ids in lists.values():
        for x, a in enumerate(ids):
            for b in ids[:x]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                        edges.append((a, b))
    found = roots(edges, sets)
    return {i: (len(sets[i]), found[i]) for i in sets}


def line_runs(docs, least=25):
    """{id: (text without later copies of runs, deleted lines)} of (id, text)."""
    lines = {i: [(n, line.strip(" ")) for n, line in enumerate((t or "").split("\n"))
                 if line.strip(" \t\n\x0b\x0c\r")] for i, t in docs}
    windows = collections.defaultdict(list)
    for i, s in lines.items():
        words = [len(line.encode().split()) for _, line in s]
        spans = set()
        for a in range(len(s)):
            total = 0
            for b in range(a, len(s)):
                total += words[b]
                if total >= least:
                    spans.add((a, b + 1))
                    break
            total = 0
            for b in range(a, -1, -1):
                total += words[b]
                if total >= least:
                    spans.add((b, a + 1))
                    break
        for a, b in spans:
            windows[tuple(line for _, line in s[a:b])].append((i, a, b))
    gone = collections.defaultdict(set)
    for places in windows.values():
        for i, a, b in sorted(places)[1:]:
            gone[i].update(lines[i][x][0] for x in range(a, b))
    return {i: ("\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) if gone[i] else t,
                len(gone[i])) for i, t in docs}


def overlaps(docs, items, least=10, shared=4):
    """{(id, item): equal tokens}: items laid over documents wherever four tokens in a row agree."""
    items = {i: tokens(t) for i, t in items}
    index, found = collections.defaultdict(list), {}
    for b, words in items.items():
        for j in range(len(words) - shared + 1):
            index[tuple(words[j:j + shared])].append((b, j))
    for i, text in docs:
        words = tokens(text)
        laid = {(b, p - j) for p in range(len(words) - shared + 1)
                for b, j in index.get(tuple(words[p:p + shared]), ())}
        for b, at in laid:
            item = items[b]
            equal = [words[k] == item[k - at] for k in range(max(at, 0), min(at + len(item), len(words)))]
            matches = best_overlap(np.array(equal))[2]
            if matches >= min(least, len(item)):
                found[i, b] = max(found.get((i, b), 0), matches)
    return found


def archive(pages, least=0):
    """{id: (bytes, digest, type, refers to)} of (id, payload)."""
    rows = [(i, len((t or "").encode()),
             base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()) for i, t in pages]
    first = {}
    for i, n, digest in rows:
        if n >= least:
            first[digest] = max(i, first.get(digest, i))
    return {i: (n, d, "response" if first.get(d, i) == i else "revisit",
                None if first.get(d, i) == i else first[d]) for i, n, d in rows}
