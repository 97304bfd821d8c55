"""Spelling variants: words and what is cut from them are larger than Spark takes them for, so no join sends them to all tasks."""

import random

from evidence_engine.llm import spelling


def test_no_word_table_is_broadcast(spark, monkeypatch):
    plans, materialize = [], spelling.materialize

    def recorded(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, name)

    monkeypatch.setattr(spelling, "materialize", recorded)
    r = random.Random(5)
    stems = ["".join(r.choices("abcdef", k=9)) for _ in range(300)]
    words = {w: 500 for w in stems} | {w[:4] + "g" + w[5:]: 3 for w in stems}
    found = spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"), pairs_per_word=1)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.where("form is not null").count() >= 250
    assert sum("Join" in plan for plan in plans) >= 4
    assert [plan for plan in plans if "Broadcast" in plan] == []
