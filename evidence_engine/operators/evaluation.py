"""Retrieval metrics for any number of strategies and cut-offs in one job.

Cases are two tables: ``cases`` (``case_id, category, question, …, should_answer``) and the long
``relevance`` table (``case_id, source``). Relevant sources stay rows, because a passage may occur
in any share of the corpus. ``hits`` may come from anywhere, provided it has
``strategy, k, query_id, rank, source``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evidence_engine import fixed_values as fv
from evidence_engine.functions.rounding import round_exact

METRICS = ("hit_rate", "recall", "mrr", "ndcg")


def explode_relevance(cases: DataFrame) -> DataFrame:
    """The relevance table of cases that carry an array of relevant sources."""
    return cases.select("case_id", F.explode(F.array_distinct("relevant_sources")).alias("source"))


def split_answerable(cases: DataFrame, relevance: DataFrame) -> DataFrame:
    """Cases with ``n_relevant`` and ``answerable``; only answerable ones are scored."""
    counts = relevance.groupBy("case_id").agg(F.count_distinct("source").alias("n_relevant"))
    counted = cases.join(counts, "case_id", "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))
    return counted.withColumn("answerable", F.col("should_answer") & (F.col("n_relevant") > 0))


def missing_sources(relevance: DataFrame, documents: DataFrame) -> DataFrame:
    """Relevant sources that are not in the corpus, each once, sorted."""
    return (
        relevance.select("source")
        .distinct()
        .join(documents.select("source"), "source", "left_anti")
        .orderBy("source")
    )


def discounted_gain(ranks: Column) -> Column:
    return F.aggregate(ranks, F.lit(0.0), lambda total, rank: total + 1 / F.log2(rank + 1))


def score_cases(
    cases: DataFrame, relevance: DataFrame, hits: DataFrame, strategies: Sequence[str], ks: Sequence[int]
) -> DataFrame:
    """Unrounded metrics per ``strategy, k, case``: every answerable case has a row.

    A source is credited once, at its first rank; ranks are not compacted. Repeated rows of
    ``relevance`` count once.
    """
    relevance = relevance.select("case_id", "source").distinct()
    settings = [F.struct(F.lit(s).alias("strategy"), F.lit(k).alias("k")) for s in strategies for k in sorted(set(ks))]
    expected = (
        split_answerable(cases, relevance)
        .where("answerable")
        .withColumn("setting", F.explode(F.array(*settings)))
        .select("case_id", "setting.*", "n_relevant")
    )
    in_case = ["strategy", "k", "case_id"]
    first_ranks = (
        hits.withColumnRenamed("query_id", "case_id")
        .where(F.col("rank") <= F.col("k"))
        .groupBy(*in_case, "source")
        .agg(F.min("rank").alias("first_rank"))
    )
    found = (
        first_ranks.join(relevance, ["case_id", "source"])
        .groupBy(*in_case)
        .agg(F.array_sort(F.collect_list("first_rank")).alias("ranks"))
    )
    ranks = F.col("ranks")
    ideal = F.sequence(F.lit(1), F.least("n_relevant", "k").cast("int"))
    zero = F.lit(0.0)
    return expected.join(found, in_case, "left").select(
        *in_case,
        "n_relevant",
        F.coalesce(F.array_size("ranks"), F.lit(0)).alias("n_found"),
        F.when(ranks.isNotNull(), 1.0).otherwise(zero).alias("hit"),
        F.coalesce(F.array_size("ranks") / F.col("n_relevant"), zero).alias("recall"),
        F.coalesce(1.0 / F.get(ranks, 0), zero).alias("reciprocal_rank"),
        F.coalesce(discounted_gain(ranks) / discounted_gain(ideal), zero).alias("ndcg"),
    )


def eval_details(scores: DataFrame, cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Per-case report rows: metrics rounded, retrieved sources in rank order (at most K)."""
    in_case = ["strategy", "k", "case_id"]
    retrieved = (
        hits.withColumnRenamed("query_id", "case_id")
        .groupBy(*in_case)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "source"))).alias("ranked"))
        .select(*in_case, F.col("ranked.source").alias("retrieved"))
    )
    described = cases.select("case_id", "category", "question", *_expected(cases))
    rounded = [round_exact(F.col(m), fv.METRIC_DECIMALS).alias(m) for m in ("recall", "reciprocal_rank", "ndcg")]
    return (
        scores.join(described, "case_id")
        .join(retrieved, in_case, "left")
        .select(
            *in_case,
            "category",
            "question",
            *([c for c in described.columns if c == "expected"]),
            F.coalesce("retrieved", F.array().cast("array<string>")).alias("retrieved"),
            (F.col("hit") > 0).alias("hit"),
            *rounded,
        )
    )


def _expected(cases: DataFrame) -> list[Column]:
    if "relevant_sources" not in cases.columns:
        return []
    return [F.array_sort(F.array_distinct("relevant_sources")).alias("expected")]


def eval_metrics(scores: DataFrame) -> DataFrame:
    """Macro means over the answerable cases, rounded only here."""
    means = scores.groupBy("strategy", "k").agg(
        F.count(F.lit(1)).alias("evaluated_case_count"),
        F.avg("hit").alias("hit_rate"),
        F.avg("recall").alias("recall"),
        F.avg("reciprocal_rank").alias("mrr"),
        F.avg("ndcg").alias("ndcg"),
    )
    rounded = [round_exact(F.col(m), fv.METRIC_DECIMALS).alias(m) for m in METRICS]
    return means.select("strategy", "k", "evaluated_case_count", *rounded)


def case_counts(cases: DataFrame, relevance: DataFrame) -> DataFrame:
    answerable = F.count_if("answerable")
    return split_answerable(cases, relevance).agg(
        F.count(F.lit(1)).alias("case_count"),
        answerable.alias("evaluated_case_count"),
        (F.count(F.lit(1)) - answerable).alias("skipped_unanswerable_case_count"),
    )


def check_evaluable(cases: DataFrame, relevance: DataFrame) -> None:
    """Raise if there is no case, or none that can be scored."""
    counts = case_counts(cases, relevance).first()
    if not counts["case_count"]:
        raise ValueError("the evaluation set is empty")
    if not counts["evaluated_case_count"]:
        raise ValueError("the evaluation set has no answerable case with relevant sources")
