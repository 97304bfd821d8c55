"""The training-data operators, written out plainly for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import regex


def words(text, lower=True):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def suffix_dedup(rows, length=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[j : j + length] for _, t in data for j in range(len(t) - length + 1))
    out = []
    for i, t in data:
        gone = [False] * len(t)
        for j in range(len(t) - length + 1):
            if seen[t[j : j + length]] > 1:
                gone[j : j + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (x and gone[x - 1]) for x, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingle_set(text, n):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1))))


def near_duplicates(rows, n, percent):
    """Rows have distinct ids."""
    sets = {i: shingle_set(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return [(i, len(sets[i]), find(i), find(i) == i) for i in ids]


def base_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = defaultdict(list)
    for j in range(len(w) - 7):
        windows[tuple(w[j : j + 8])].append(j)
    again = {k for v in windows.values() if len(v) > 1 for j in v for k in range(j, j + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(again), failed


def secrets(text):
    text = text or ""
    letters = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    assign = rf"""({letters})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found)]


def unigram(rows):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    counts = Counter()
    for i, t in rows:
        if not held[i]:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        w = [*words(t), None]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out.append((i, held[i], len(w), sum(counts[x] > 0 for x in w), n, base))
    return out




def overlaps(rows, items, window=13, percent=80):
    """All alignments of all items with all documents: no seeds."""

    def tokens(t):
        return regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())

    out = {}
    sought = [(i, tokens(t)) for i, t in items]
    for d, t in rows:
        w = tokens(t)
        for item, g in sought:
            size = min(window, len(g))
            for shift in range(size - len(g), len(w) - size + 1) if g else ():
                first, skip = max(shift, 0), max(-shift, 0)
                n = min(len(g) - skip, len(w) - first)
                equal = [w[first + k] == g[skip + k] for k in range(n)]
                if sum(equal) * 100 >= size * percent:
                    if max(sum(equal[k : k + size]) for k in range(n - size + 1)) * 100 >= size * percent:
                        out[d, item] = max(out.get((d, item), (-1, 0, 0)), (sum(equal), -shift, n))
    return sorted((d, i, -back, equal, n) for (d, i), (equal, back, n) in out.items())


def verdict(url, rules, addresses_blocked=()):
    _, found, rest = (url or "").partition("://")
    rest = rest if found else ""
    host = re.match("[^/?#]*", rest)[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    path = re.match("[^/?#]*([^?#]*)", rest)[1]
    fits = []
    for rule, what in rules:
        name, start = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == name or host.endswith("." + name)) and path.startswith(start):
            fits.append((len(rule), rule, what))
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def one_edit_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[same:] == b[same + 1 :] if len(a) < len(b) else a[same + 1 :] == b[same + 1 :]


def noisy_words(rows):
    counted = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                counted[word] += 1
    return {w: n for w, n in counted.items() if n >= 2}


def variants(n):
    near = {w: [v for v in n if one_edit_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def token_alignment(rows, encode_a, encode_b):
    """``encode`` gives (id, bytes) of a text's tokens."""
    found, links = [], Counter()
    for doc, text in rows:
        whole = (" " + (text or "")).encode()
        a, b = (encode_a(text), encode_b(text)) if text else ([], [])
        if not text or any(b"".join(t for _, t in side) != whole for side in (a, b)):
            found.append((doc, None))
            continue
        spans = [[], []]
        for side, out in zip((a, b), spans):
            at = 0
            for i, token in side:
                out.append((at, at + len(token), i))
                at += len(token)
        cuts = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
        groups = [tuple([i for x, y, i in side if low <= x and y <= cut] for side in spans) for low, cut in zip([0, *cuts], cuts)]
        pairs = [(i, j) for x, y, i in spans[0] for u, v, j in spans[1] if x < v and u < y]
        links.update(pairs)
        found.append((doc, (len(a), len(b), groups, pairs)))
    most = Counter()
    for (_, j), n in links.items():
        most[j] = max(most[j], n)
    out = []
    for doc, value in found:
        if value is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, pairs = value
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(links[p] == most[p[1]] for p in pairs)
        digest = hashlib.sha256(written.encode()).hexdigest()
        out.append((doc, n_a, n_b, len(groups), len(pairs), best, sum(links[p] for p in pairs), digest))
    return out


def nearest(rows, k, every):
    """``{query: [(-score, id)]}`` of all other ids, nearest first."""

    def usable(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    kept = {(i, tuple(x + 0.0 for x in v)) for i, v in rows if i is not None and usable(v)}
    lengths = Counter(len(v) for _, v in kept)
    length = max(lengths, key=lambda n: (lengths[n], n), default=0)
    kept = [x for x in kept if len(x[1]) == length]
    out = {}
    for i, v in kept:
        for j, w in kept if i % every == 0 else ():
            if i != j:
                scores = out.setdefault(i, {})
                scores[j] = max(scores.get(j, -math.inf), sum(x * y for x, y in zip(v, w)))
    return {i: sorted((-s, j) for j, s in scores.items())[:k] for i, scores in out.items()}
