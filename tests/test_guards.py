"""Inputs that must not pass silently."""

import os

import pytest

from evidence_engine.operators import chunking, evaluation, retrieval
from evidence_engine.sources import files, scratch


def test_sources_are_relative_however_the_folder_is_written(spark, folder):
    top = f"{folder}/ab/b"
    os.makedirs(f"{top}/sub/b")
    for name in ("x.md", "sub/y.txt", "sub/b/z.md"):
        with open(f"{top}/{name}", "w") as file:
            file.write(name)
    for written in (top, top + "/", f"{folder}/ab//b", f"{folder}/ab/./b", f"{folder}/ab/b/../b", "file:" + top):
        found = {r["source"]: r["text"] for r in files.scan_files(spark, written).collect()}
        assert found == {n: n for n in ("x.md", "sub/y.txt", "sub/b/z.md")}
    with pytest.raises(ValueError, match="pattern"):
        files.scan_files(spark, f"{folder}/ab/*")


def test_pdfs_are_rejected_by_name(spark, folder):
    def write(name):
        with open(f"{folder}/{name}", "w") as file:
            file.write("content")  # Spark's file sources pass over empty files

    write("a.PDF")
    with pytest.raises(ValueError, match="no supported files"):
        files.scan_files(spark, folder)
    write("b.txt")
    write("c.png")
    found = {os.path.basename(r["path"]): r["reason"] for r in files.scan_rejects(spark, folder).collect()}
    assert set(found) == {"a.PDF", "c.png"} and found["a.PDF"].startswith("PDF")


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_vectors_must_be_finite(spark, bad):
    def table(rows):
        schema = "chunk_id string, source string, metadata struct<chunk_index: int>, doc_ord string, vector array<double>"
        return spark.createDataFrame([(str(i), "s", (0,), str(i), v) for i, v in enumerate(rows)], schema)

    def queries(vector):
        return spark.createDataFrame([(1, vector)], "query_id long, vector array<double>")

    keep = ("chunk_id", "source")
    with pytest.raises(Exception, match="not finite"):
        retrieval.rank_vectors(table([[1.0, 0.0], [bad, 1.0]]), queries([1.0, 1.0]), 1, keep).collect()
    with pytest.raises(Exception, match="not finite"):
        retrieval.rank_vectors(table([[1.0, 0.0]]), queries([bad, 1.0]), 1, keep).collect()
    with pytest.raises(ValueError, match="query id 1 occurs 2 times"):
        retrieval.rank_vectors(table([[1.0, 0.0]]), queries([1.0, 1.0]).union(queries([0.0, 1.0])), 1, keep)


def test_repeated_relevance_counts_once(spark):
    cases = spark.createDataFrame([(1, True)], "case_id long, should_answer boolean")
    once = spark.createDataFrame([(1, "a"), (1, "b")], "case_id long, source string")
    hits = spark.createDataFrame([("bm25", 3, 1, 1, "a"), ("bm25", 3, 1, 2, "a")], "strategy string, k int, query_id long, rank int, source string")
    scored = [evaluation.score_cases(cases, r, hits, ("bm25",), (3,)).collect() for r in (once, once.union(once))]
    assert scored[0] == scored[1] and scored[0][0]["n_relevant"] == 2
    assert evaluation.split_answerable(cases, once.union(once)).first()["n_relevant"] == 2


def test_equal_ids_of_different_documents_stay_apart(spark):
    rows = [("id", "a", "text", "1"), ("id", "b", "text", "2"), ("id", "a", "other", "3"), ("id", "a", "text", "4")]
    found = chunking.dedupe_documents(spark.createDataFrame(rows, "document_id string, source string, text string, doc_ord string"))
    assert sorted((r["source"], r["text"], r["doc_ord"]) for r in found.collect()) == [("a", "other", "3"), ("a", "text", "4"), ("b", "text", "2")]


def test_a_cluster_needs_a_shared_folder():
    class Nothing:
        master = "spark://somewhere:7077"

        def get(self, *_):
            return None

        def getCheckpointDir(self):
            return None

    session = Nothing()
    session.conf = session.sparkContext = session
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(session)
