"""What rounds and tasks need not do."""

import random
import sys
from collections import Counter

from test_crowded_regions import star

from evidence_engine.llm import lsh_forest, packing, queries


def test_new_words_cost_no_call_each():
    with open(queries.tokenizer_file(), encoding="utf-8") as file:
        ids = packing.WordIds(file.read())
    text = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}," for i in range(1000))
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(frame.f_code.co_name) if event == "call" else None)
    try:
        ids.encode_all([text.encode()])
    finally:
        sys.setprofile(None)
    assert max(Counter(name for name in calls if not name.startswith("<")).values()) < 100


def test_words_are_put_together_as_they_are_encoded():
    with open(queries.tokenizer_file(), encoding="utf-8") as file:
        ids = packing.WordIds(file.read())
    text = "Plain, PLAIN plain... ... caf\u00e9. \u00c9T\u00c9!! x<|endoftext|>y 3,5 don't-- (a) a) \u00df? ab\u00e9, #tag# -"
    assert ids.encode_all([text.encode(), b"", b"plain"]) == [ids._ids(t).tobytes() for t in (text, "", "plain")]


def test_only_likely_pairs_are_sought_among_the_tried(spark, monkeypatch):
    """Rounds compare signatures before they leave out what was tried: texts of one passage are mostly unlike."""
    r = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = [passage + [f"w{r.randrange(10**6)}" for _ in range(60)] for _ in range(150)]
    rows += star(r, passage + [f"o{i}" for i in range(60)], 60, 2)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    likely, fresh = [], []
    write, crowded = lsh_forest.Scratch.write, lsh_forest.crowded_candidates
    sought = []

    def kept(self, df, name):
        out = write(self, df, name)
        if name in ("forest-likely", "forest-fresh"):
            (likely if name == "forest-likely" else fresh).append(out.count())
        return out

    def offered(*args):
        out = crowded(*args)
        sought.append(out.count())
        return out

    monkeypatch.setattr(lsh_forest.Scratch, "write", kept)
    monkeypatch.setattr(lsh_forest, "crowded_candidates", offered)
    found = {x["doc_id"]: x["component_id"] for x in lsh_forest.near_duplicates(docs, 3, 85).collect()}
    assert all(found[i] == (i if i < 150 else 150) for i in found)
    assert len(fresh) == len(sought) and sought and likely[1] < sought[0] and fresh[0] <= likely[1]
