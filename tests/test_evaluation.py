import math
import random

import pytest
from pyspark.sql import functions as F

from evidence_engine import fixed_values as fv
from evidence_engine.operators import evaluation, reports

HITS = "strategy string, k int, query_id string, rank int, source string"


def make_cases(spark, rows):
    """(id, relevant sources, should_answer)"""
    full = [(i, "cat", f"question {i}", "", sources, answer) for i, sources, answer in rows]
    return spark.createDataFrame(
        full,
        "case_id string, category string, question string, reference_answer string, relevant_sources array<string>, should_answer boolean",
    )


def make_hits(spark, lists, ks):
    rows = [
        (strategy, k, case, rank, source)
        for (strategy, case), sources in lists.items()
        for k in ks
        for rank, source in enumerate(sources[:k], 1)
    ]
    return spark.createDataFrame(rows, HITS)


def scored(spark, cases, lists, strategies, ks):
    hits = make_hits(spark, lists, ks)
    relevance = evaluation.explode_relevance(cases)
    return evaluation.score_cases(cases, relevance, hits, strategies, ks), hits


def test_repeated_sources_are_credited_once(spark):
    cases = make_cases(spark, [("x", ["a", "b"], True)])
    scores, _ = scored(spark, cases, {("s", "x"): ["a", "a", "b"]}, ["s"], [3])
    row = scores.first()
    assert (row["hit"], row["recall"], row["reciprocal_rank"]) == (1.0, 1.0, 1.0)
    assert round(row["ndcg"], 4) == 0.9197


def test_cases_without_hits_score_zero_and_unanswerable_are_skipped(spark):
    cases = make_cases(spark, [("x", ["a"], True), ("y", ["a"], True), ("z", [], False), ("w", ["a"], False)])
    scores, hits = scored(spark, cases, {("s", "x"): ["b", "a"]}, ["s", "t"], [1, 2])
    metrics = {(r["strategy"], r["k"]): r for r in evaluation.eval_metrics(scores).collect()}
    assert len(metrics) == 4
    assert all(r["evaluated_case_count"] == 2 for r in metrics.values())
    assert [metrics["s", 2][m] for m in evaluation.METRICS] == [0.5, 0.5, 0.25, round(1 / math.log2(3) / 2, 4)]
    assert [metrics["s", 1][m] for m in evaluation.METRICS] == [0, 0, 0, 0]
    assert [metrics["t", 2][m] for m in evaluation.METRICS] == [0, 0, 0, 0]
    counts = evaluation.case_counts(cases, evaluation.explode_relevance(cases)).first()
    assert tuple(counts) == (4, 2, 2)
    details = {(r["strategy"], r["k"], r["case_id"]): r for r in evaluation.eval_details(scores, cases, hits).collect()}
    assert len(details) == 8
    assert details["s", 2, "x"]["retrieved"] == ["b", "a"] and details["s", 2, "x"]["expected"] == ["a"]
    assert details["t", 1, "y"]["retrieved"] == [] and details["t", 1, "y"]["hit"] is False


def test_metrics_equal_plain_loops(spark):
    rnd = random.Random(4)
    sources = [f"s{n}" for n in range(8)]
    rows = [(f"c{n}", sorted(set(rnd.choices(sources, k=rnd.randint(1, 5)))), True) for n in range(37)]
    lists = {(s, c): rnd.choices(sources, k=rnd.randint(0, 9)) for s in ("p", "q") for c, _, _ in rows}
    ks = [1, 3, 7]
    scores, _ = scored(spark, make_cases(spark, rows), lists, ["p", "q"], ks)
    got = {(r["strategy"], r["k"], r["case_id"]): r for r in scores.collect()}
    assert len(got) == 2 * 3 * 37
    for (strategy, k, case), row in got.items():
        wanted = dict((c, set(r)) for c, r, _ in rows)[case]
        top = lists[strategy, case][:k]
        hits = [i for i, s in enumerate(top, 1) if s in wanted]
        firsts = [i for i in hits if top[i - 1] not in top[: i - 1]]
        ideal = sum(1 / math.log2(i + 1) for i in range(1, min(len(wanted), k) + 1))
        assert row["hit"] == float(bool(hits))
        assert row["recall"] == pytest.approx(len(wanted & set(top)) / len(wanted))
        assert row["reciprocal_rank"] == pytest.approx(1 / hits[0] if hits else 0)
        assert row["ndcg"] == pytest.approx(sum(1 / math.log2(i + 1) for i in firsts) / ideal)


def test_nothing_to_evaluate_is_an_error(spark):
    for rows, message in (([], "empty"), ([("x", [], False)], "no answerable")):
        cases = make_cases(spark, rows)
        with pytest.raises(ValueError, match=message):
            evaluation.check_evaluable(cases, evaluation.explode_relevance(cases))


def test_missing_sources(spark):
    cases = make_cases(spark, [("x", ["b", "a", "z"], True), ("y", ["z", "y"], True)])
    documents = spark.createDataFrame([("a",), ("b",)], "source string")
    got = evaluation.missing_sources(evaluation.explode_relevance(cases), documents).collect()
    assert [r["source"] for r in got] == ["y", "z"]


def summary(spark, documents, chunks, cases):
    return spark.createDataFrame([(documents, chunks, cases)], "document_count long, chunk_count long, case_count long")


@pytest.mark.parametrize("sizes, numbers", [((9, 19, 49), [1, 2, 3]), ((10, 20, 50), []), ((10, 3, 50), [2])])
def test_size_warnings(spark, sizes, numbers):
    rows = reports.dataset_warnings(summary(spark, *sizes)).collect()
    assert [r["warning_no"] for r in rows] == numbers
    assert [r["warning"] for r in rows] == [fv.SIZE_WARNINGS[n - 1][2] for n in numbers]


def test_indistinguishable_warning(spark):
    schema = "strategy string, k int, hit_rate double, recall double, mrr double, ndcg double"
    same = [("a", 1, 0.5, 0.5, 0.5, 0.5), ("b", 1, 0.5, 0.5, 0.5, 0.5), ("a", 3, 1.0, 0.5, 0.5, 0.5)]
    last = ("b", 3, 1.0, 0.5, 0.5, 0.5)
    other = ("b", 3, 1.0, 0.5, 0.5, 0.6)

    def warned(rows):
        return reports.indistinguishable_warning(spark.createDataFrame(rows, schema)).count()

    assert warned([*same, last]) == 1
    assert warned([*same, other]) == 0
    assert warned([r for r in same if r[0] == "a"]) == 0


def test_report_is_written(spark, folder):
    tables = {
        "dataset": summary(spark, 1, 2, 3),
        "configuration": reports.configuration_table(
            spark, embedding="hashing", chunk_size=500, chunk_overlap=80, ks=[5, 1, 5], documents="d", questions="q"
        ),
    }
    reports.write_report(tables, f"{folder}/report")
    settings = {r["setting"]: r["value"] for r in spark.read.json(f"{folder}/report/configuration").collect()}
    assert settings["top_ks"] == "1,5" and settings["schema_version"] == "1.0"
    written = spark.read.json(f"{folder}/report/dataset").first()
    assert written["chunk_count"] == 2 and written["generated_at"]


def test_any_hits_can_be_evaluated(spark):
    """Hits need only strategy, k, query, rank and source, whatever made them."""
    cases = make_cases(spark, [("x", ["a"], True)])
    hits = spark.createDataFrame([("mine", 2, "x", 2, "a"), ("mine", 2, "x", 5, "b")], HITS)
    scores = evaluation.score_cases(cases, evaluation.explode_relevance(cases), hits, ["mine"], [2])
    assert scores.select(F.col("reciprocal_rank")).first()[0] == 0.5
