import pytest
from pyspark.sql import functions as F

from evidence_engine import fixed_values as fv
from evidence_engine.operators import answers

HITS = "query_id int, rank int, chunk_id string, document_id string, source string, text string, metadata struct<chunk_index: int>, score double, dense_rank int, sparse_rank int"


@pytest.fixture
def hits(spark):
    long = "头\n" + "长" * 300
    rows = [
        (1, 2, "c2", "d2", "two.md", "second", (0,), 0.0163934426, None, 1),
        (1, 1, "c1", "d1", "one.md", long, (7,), 0.03278688524590164, 1, 2),
        (1, 4, "c4", "d4", "four.md", "fourth", (0,), 0.01, 3, None),
        (1, 3, "c3", "d3", "three.md", " \nthird\n", (2,), 0.0158730158, 2, None),
    ]
    return spark.createDataFrame(rows, HITS)


@pytest.fixture
def questions(spark):
    return spark.createDataFrame([(1, " what? "), (2, "nothing found"), (3, " 　")], "query_id int, question string")


def test_answers_use_three_hits_and_cite_all(questions, hits):
    rows = {r["query_id"]: r for r in answers.answer_queries(questions, hits).collect()}
    assert set(rows) == {1, 2}
    excerpts = ["头 " + "长" * 218 + " [1]", "second [2]", "third [3]"]
    assert rows[1]["answer"] == fv.ANSWER_LEAD + "\n\n" + "\n\n".join(excerpts)
    assert rows[1]["question"] == " what? "
    cited = rows[1]["citations"]
    assert [c["chunk_id"] for c in cited] == ["c1", "c2", "c3", "c4"]
    assert [c["score"] for c in cited] == [0.032787, 0.016393, 0.015873, 0.01]
    assert [(c["dense_rank"], c["sparse_rank"]) for c in cited] == [(1, 2), (None, 1), (2, None), (3, None)]
    assert [c["metadata"]["chunk_index"] for c in cited] == [7, 0, 2, 0]
    assert rows[2]["answer"] == fv.ANSWER_FALLBACK and rows[2]["citations"] == []


def test_strategies_are_answered_apart(questions, hits):
    both = hits.withColumns({"strategy": F.lit("dense"), "k": F.lit(4)}).unionByName(
        hits.where("rank = 2").withColumns({"rank": F.lit(1), "strategy": F.lit("bm25"), "k": F.lit(1)})
    )
    rows = {(r["query_id"], r["strategy"], r["k"]): r for r in answers.answer_queries(questions, both).collect()}
    assert set(rows) == {(1, "dense", 4), (1, "bm25", 1), (2, None, None)}
    assert [c["chunk_id"] for c in rows[1, "dense", 4]["citations"]] == ["c1", "c2", "c3", "c4"]
    assert [c["chunk_id"] for c in rows[1, "bm25", 1]["citations"]] == ["c2"]
    assert {(p["strategy"], p["k"]) for p in answers.prompt_table(questions, both).collect()} == {("dense", 4), ("bm25", 1)}


def test_contexts_and_prompts(questions, hits):
    context = answers.build_context(hits).first()["context"]
    assert context.startswith("[1] 来源：one.md\n头\n长长")
    assert context.endswith("[2] 来源：two.md\nsecond\n\n[3] 来源：three.md\n \nthird\n\n\n[4] 来源：four.md\nfourth")
    prompts = answers.prompt_table(questions, hits).collect()
    assert [p["query_id"] for p in prompts] == [1]
    assert prompts[0]["user_prompt"] == f"证据：\n{context}\n\n问题： what? "
    assert prompts[0]["system_prompt"] == fv.SYSTEM_PROMPT


def test_generated_answers_fall_back(questions, hits):
    prompts = answers.prompt_table(questions, hits)
    assert answers.generated_answers(prompts, lambda system, user: F.lit("")).first()["answer"] == fv.ANSWER_FALLBACK
    lengths = answers.generated_answers(prompts, lambda system, user: F.length(user).cast("string")).first()
    assert int(lengths["answer"]) > 300
