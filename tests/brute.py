"""Straightforward single-process versions of what the engine computes, for small fixtures."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter


def normalized(text):
    text = re.sub("\r\n?", "\n", text)
    text = re.sub("[ \t]+", " ", text)
    return re.sub("\n{3,}", "\n\n", text).strip()


def windows(text, size, overlap):
    """(start, end, text) of all non-blank windows."""
    text, found, position = normalized(text), [], 0
    while text:
        stop = min(position + size, len(text))
        if stop < len(text):
            tail = range(position + int(size * 0.6), stop)
            stop = max((i + 1 for i in tail if text[i] in "\n。！？；"), default=stop)
        if text[position:stop].strip():
            found.append((position, stop, text[position:stop].strip()))
        if stop == len(text):
            return found
        position = max(stop - overlap, position + 1)
    return found


def terms(text):
    signs = re.findall("[一-鿿]", text)
    words = [w.lower() for w in re.findall("[a-zA-Z0-9_+#.-]+|[一-鿿]", text)]
    return words + ["".join(pair) for pair in zip(signs, signs[1:])]


def hashed(text, dimension, family="blake2b"):
    vector = Counter()
    for term in terms(text):
        if family == "blake2b":
            number = int(hashlib.blake2b(term.encode(), digest_size=8).hexdigest(), 16)
        else:
            number = int(hashlib.md5(term.encode()).hexdigest()[:15], 16)
        vector[number % dimension] += 1 if number % 2 else -1
    return vector


def length(vector):
    return math.sqrt(sum(n * n for n in vector.values())) or 1.0


def ranked(scores, k):
    """Numbers of the k best entries; ties in order of position."""
    return sorted(range(len(scores)), key=lambda i: (-round(scores[i], 9), i))[:k]


def dense(texts, question, k, dimension=384, family="blake2b"):
    query = hashed(question, dimension, family)
    vectors = [hashed(t, dimension, family) for t in texts]
    scores = [sum(n * v[b] for b, n in query.items()) / (length(query) * length(v)) for v in vectors]
    return [(i, scores[i]) for i in ranked(scores, k)]


def bm25(texts, question, k, k1=1.5, b=0.75):
    counts = [Counter(terms(t)) for t in texts]
    sizes = [sum(c.values()) for c in counts]
    average = sum(sizes) / len(sizes) or 1.0
    scores = [0.0] * len(texts)
    for term, times in Counter(terms(question)).items():
        holders = sum(term in c for c in counts)
        idf = math.log(1 + (len(texts) - holders + 0.5) / (holders + 0.5))
        for i, c in enumerate(counts):
            if c[term]:
                scores[i] += times * idf * c[term] * (k1 + 1) / (c[term] + k1 * (1 - b + b * sizes[i] / average))
    return [(i, scores[i]) for i in ranked(scores, k) if scores[i] > 0]


def fuse(dense_hits, sparse_hits, k, rrf_k=60, dense_weight=1.0, sparse_weight=1.0):
    dense_rank = {i: r for r, (i, _) in enumerate(dense_hits, 1)}
    sparse_rank = {i: r for r, (i, _) in enumerate(sparse_hits, 1)}
    late = 10**9

    def score(i):
        total = dense_weight / (rrf_k + dense_rank[i]) if i in dense_rank else 0.0
        return total + (sparse_weight / (rrf_k + sparse_rank[i]) if i in sparse_rank else 0.0)

    order = sorted(
        dense_rank.keys() | sparse_rank.keys(),
        key=lambda i: (-score(i), dense_rank.get(i, late), sparse_rank.get(i, late)),
    )
    return [(i, score(i)) for i in order[:k]]


def fused(texts, question, k, rrf_k=60, dense_weight=1.0, sparse_weight=1.0, **options):
    depth = max(3 * k, 10)
    hits = dense(texts, question, depth, **options), bm25(texts, question, depth)
    return fuse(*hits, k, rrf_k, dense_weight, sparse_weight)
