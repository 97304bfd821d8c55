"""Near duplicates where one prefix region holds far more texts than two neighbours in each order."""

import random

import plain
import numpy as np
import pytest

from evidence_engine.llm import lsh_forest


def star(r, original, copies, changes):
    """The original and copies that are edited independently."""
    out = [original]
    for _ in range(copies):
        changed = list(original)
        for at in r.sample(range(len(original)), changes):
            changed[at] = f"edit{r.randrange(10**9)}"
        out.append(changed)
    return out


@pytest.mark.parametrize(("groups", "copies", "parts"), [(1, 300, 4), (3, 60, 7), (1, 2000, 16)])
def test_copies_of_one_original(spark, groups, copies, parts):
    """Each copy is linked to its original, hardly to another copy; the originals are versions of one text."""
    r = random.Random(copies)
    base = [f"w{r.randrange(5000)}" for _ in range(300)]
    rows, wanted = [], {}
    for group in range(groups):
        version = base[:]
        for at in range(group, 300, 12):
            version[at] = f"version{group}" if groups > 1 else version[at]
        first = len(rows)
        for text in star(r, version, copies, 6):
            wanted[len(rows)] = first
            rows.append((len(rows), " ".join(text)))
    sets = {i: plain.shingle_set(t, 3) for i, t in rows}
    assert all(100 * len(sets[i] & sets[o]) >= 85 * len(sets[i] | sets[o]) for i, o in wanted.items())
    r.shuffle(rows)
    dealt = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    found = {x["doc_id"]: x["component_id"] for x in lsh_forest.near_duplicates(dealt, 3, 85).collect()}
    assert found == wanted


def test_hub_levels(spark):
    """A leaf of a text with several links is no hub, a lone pair has two; others rank by their number of links."""
    links = [(0, i) for i in range(1, 41)] + [(100, 101), (200, 201), (200, 202), (201, 200), (300, 300)]
    found = lsh_forest.hub_levels(spark.createDataFrame(links, "u long, v long")).collect()
    wanted = {0: 3, 100: 1, 101: 1, 200: 1, 201: 0, 202: 0} | {i: 0 for i in range(1, 41)}
    assert {r["id"]: r["level"] for r in found} == wanted


def test_last_other():
    r = np.random.default_rng(4)
    for _ in range(200):
        n = int(r.integers(1, 30))
        component, wanted = r.integers(0, 4, n), r.random(n) < r.random()
        plain = [max((j for j in range(i) if wanted[j] and component[j] != component[i]), default=-1) for i in range(n)]
        assert lsh_forest.last_other(component, wanted).tolist() == plain
