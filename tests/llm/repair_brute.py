"""Plain versions of conversation repair, packing checks and phrase mining, without imports from the library."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    """(conv, turn, role, text) after the damage of crc32, nulls as one space."""
    out = []
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        part = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        text = "" if part == 1 else re.sub("[.!?]", "", text) if part == 2 else text
        role = "user" if part == 4 else role
        out += [(conv, turn, role, text)] * (0 if part == 0 else 2 if part == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired lines) of (role, text, fault) by least-first search over (row, state)."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names, seen = {"u": "user", "a": "assistant"}, set()
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(lines)
        for r, name in names.items():
            if (state, r) in after:
                heapq.heappush(heap, (cost + 3, audit + "I", i, after[state, r], (*lines, f"{name}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, lines))
            if fault in (None, "truncated"):
                more = 3 if fault else 0
                if (state, role[:1]) in after:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, after[state, role[:1]],
                                          (*lines, f"{role}:{text}")))
                for r, name in names.items():
                    if (state, r) in after:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, after[state, r],
                                              (*lines, f"{name}:{text}")))
    raise AssertionError


def repair(rows, hurt=damage):
    """{conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, hash)}."""
    found, kept = {}, defaultdict(list)
    for row in hurt(rows):
        kept[row[0]].append(row[1:])
    for conv in {r[0] for r in rows}:
        own = sorted(kept[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1],
                                                hashlib.sha256(r[2].encode()).hexdigest()))
        turns, seen, faults = [t for t, _, _ in own if t is not None], set(), []
        for _, role, text in own:
            bare = text.rstrip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen
                          else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, audit, lines = cheapest([(r, t, f) for (_, r, t), f in zip(own, faults, strict=True)])
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        found[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"),
                       faults.count("duplicate"), faults.count("truncated"),
                       sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                       hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def phrases(docs, support=100, longest=5, top=2000):
    """[(lang, rank, phrase, a, l, r, n, score)] of (lang, text)."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        chosen = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        covered = {p[i:j]: 0 for p in chosen for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p)}
        for p, a in chosen.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        covered[p[i:j]] = max(covered[p[i:j]], a)
        rows = []
        for p, a in chosen.items():
            if covered.get(p, 0) >= a:
                continue
            score, _, left, right = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]])
                                        for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, n, p.decode(), -a, left, right, totals[lang], -s)
                for n, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)
