"""Answers, contexts and prompts from ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidence_engine import fixed_values as fv
from evidence_engine.functions import text as tx
from evidence_engine.functions.rounding import round_exact

CITATION_FIELDS = ("chunk_id", "document_id", "source", "text", "metadata")


def citation(score: str = "score") -> Column:
    """A hit as it is shown to a reader: its chunk with metadata, rounded score and both ranks."""
    return F.struct(
        *CITATION_FIELDS,
        round_exact(F.col(score), fv.SCORE_DECIMALS).alias("score"),
        "dense_rank",
        "sparse_rank",
    )


def citation_projection(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", citation().alias("citation")).select("query_id", "rank", "citation.*")


def search_keys(hits: DataFrame) -> list[str]:
    """What tells apart the searches that ``hits`` holds, besides their query."""
    return [c for c in ("strategy", "k") if c in hits.columns]


def collect_evidence(hits: DataFrame) -> DataFrame:
    """One row per query, and per strategy and K if the hits name them, with its at most K hits in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", citation().alias("citation"))))
    citations = F.transform(ordered, lambda hit: hit["citation"]).alias("citations")
    return hits.groupBy("query_id", *search_keys(hits)).agg(citations)


def answer_text(citations: Column) -> Column:
    """The first hits as numbered excerpts behind a lead sentence."""

    def excerpt(hit: Column, position: Column) -> Column:
        flat = tx.strip(F.replace(hit["text"], F.lit("\n"), F.lit(" ")))
        return F.concat(F.substring(flat, 1, fv.EXCERPT_LENGTH), F.lit(" ["), (position + 1).cast("string"), F.lit("]"))

    excerpts = F.transform(F.slice(citations, 1, fv.EXCERPT_HITS), excerpt)
    return F.concat(F.lit(fv.ANSWER_LEAD + "\n\n"), F.array_join(excerpts, "\n\n"))


def context_text(citations: Column) -> Column:
    def entry(hit: Column, position: Column) -> Column:
        head = F.concat(F.lit("["), (position + 1).cast("string"), F.lit("] " + fv.CONTEXT_SOURCE_LABEL))
        return F.concat(head, hit["source"], F.lit("\n"), hit["text"])

    return F.array_join(F.transform(citations, entry), "\n\n")


def extractive_answer(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """``query_id, answer``, with ``strategy, k`` if hits name them; without hits, the fallback sentence."""
    return answer_queries(questions, hits).select("query_id", *search_keys(hits), "answer")


def build_context(hits: DataFrame) -> DataFrame:
    return collect_evidence(hits).select("query_id", *search_keys(hits), context_text(F.col("citations")).alias("context"))


def prompt_table(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Prompts for a batch generator; questions without hits need none and have none."""
    prompt = F.concat(
        F.lit(fv.PROMPT_EVIDENCE_LABEL + "\n"),
        F.col("context"),
        F.lit("\n\n" + fv.PROMPT_QUESTION_LABEL),
        F.col("question"),
    )
    return (
        questions.select("query_id", "question")
        .join(build_context(hits), "query_id")
        .select("query_id", *search_keys(hits), F.lit(fv.SYSTEM_PROMPT).alias("system_prompt"), prompt.alias("user_prompt"))
    )


def answer_queries(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Question as asked, answer, and all its hits as citations; blank questions are left out.

    If the hits name ``strategy`` and ``k``, each of these with hits for a question answers it in a row
    of its own; a question without any hits has one row, where both are missing.
    """
    asked = questions.where(~tx.is_blank(F.col("question"))).select("query_id", "question")
    answered = asked.join(collect_evidence(hits), "query_id", "left")
    answer = F.when(F.col("citations").isNull(), F.lit(fv.ANSWER_FALLBACK)).otherwise(answer_text(F.col("citations")))
    citations = F.coalesce("citations", F.array().cast(answered.schema["citations"].dataType))
    return answered.select(
        "query_id", *search_keys(hits), "question", answer.alias("answer"), citations.alias("citations")
    )


def generated_answers(prompts: DataFrame, generate) -> DataFrame:
    """Apply a user's ``generate(system_prompt, user_prompt) -> Column`` to the prompt table.

    An empty reply becomes the fallback sentence.
    """
    reply = generate(F.col("system_prompt"), F.col("user_prompt"))
    filled = F.when(F.coalesce(reply, F.lit("")) == "", F.lit(fv.ANSWER_FALLBACK)).otherwise(reply)
    return prompts.select("query_id", *search_keys(prompts), filled.alias("answer"))
