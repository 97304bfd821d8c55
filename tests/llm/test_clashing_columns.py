"""Stages keep columns of any name, and treat odd rows and empty tables as their docstrings say."""

import pytest
from pyspark.sql import functions as F

from evidence_engine.llm import decontamination, line_chunks, lsh_forest, quality

NAMES = ("__id", "__h", "__n", "__lines", "__removed", "__chunks", "firsts", "id", "h", "row", "gone_id", "of_id", "kept", "doc", "x y")


def stages(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    benchmark = spark.createDataFrame([(1, "what is the name of the river that runs past the old mill")], "item_id long, text string")
    return {
        "quality": lambda d: quality.keep_good(d, labels),
        "lines": line_chunks.keep_first_chunks,
        "near": lsh_forest.keep_one,
        "clean": lambda d: decontamination.keep_clean(d, benchmark),
    }


@pytest.mark.parametrize("stage", ["quality", "lines", "near", "clean"])
def test_columns_of_any_name(spark, odd, stage):
    docs = odd[0].select("doc_id", "text", "n_chars", *(F.lit(n).alias(f"{name}") for n, name in enumerate(NAMES)))
    run = stages(spark)[stage]
    out = run(docs)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert {tuple(r)[3:] for r in out.collect()} == {tuple(range(len(NAMES)))}
    plain_rows = run(odd[0].select("doc_id", "text", "n_chars")).collect()
    assert sorted(map(repr, plain_rows)) == sorted(repr(r) for r in out.select("doc_id", "text", "n_chars").collect())
    assert run(docs.where("false")).collect() == []


def test_removed_chunks_beside_such_columns(spark, odd):
    docs = odd[0].select("doc_id", "text").withColumns({"firsts": F.lit(1), "id": F.lit(2)})
    assert line_chunks.remove_repeated_chunks(docs).columns == [*docs.columns, *line_chunks.ADDED]
    assert line_chunks.remove_repeated_chunks(docs).count() == docs.count()
