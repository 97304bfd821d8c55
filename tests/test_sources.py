import json
import os

import pytest
from pyspark.sql import functions as F

from evidence_engine.operators import chunking
from evidence_engine.sources import cases, driver_tables, files, scratch


def put(folder, name, content):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(content)


def test_scan_files(spark, folder):
    put(folder, "a-b/one.txt", "plain é 中文".encode())
    put(folder, "a/two words.MD", "国标文本".encode("gb18030"))
    put(folder, "z.tXt", b"\xef\xbb\xbfwith mark")
    put(folder, "blank.md", " 　\n".encode())
    put(folder, "picture.png", b"\x89PNG")
    put(folder, "paper.pdf", b"%PDF")
    put(folder, "notes", b"no suffix")
    found = {r["source"]: r["text"] for r in files.scan_files(spark, folder).collect()}
    assert found == {
        "a-b/one.txt": "plain é 中文",
        "a/two words.MD": "国标文本",
        "z.tXt": "\ufeffwith mark",
        "blank.md": " 　\n",
    }
    documents = chunking.identify_documents(files.scan_files(spark, "file:" + folder + "/")).orderBy("doc_ord")
    assert [r["source"] for r in documents.collect()] == ["a/two words.MD", "a-b/one.txt", "z.tXt"]
    listed = files.list_files(spark, folder).select("path")
    assert {os.path.basename(r["path"]) for r in files.unsupported_files(listed).collect()} == {"picture.png", "notes"}
    with pytest.raises(Exception, match="unsupported file"):
        files.filter_supported(listed, strict=True).collect()


def test_undecodable_files(spark, folder):
    put(folder, "bad.txt", b"ok \xff\xff")
    put(folder, "good.txt", b"ok")
    with pytest.raises(Exception, match="undecodable file: bad.txt"):
        files.scan_files(spark, folder).collect()
    assert [r["source"] for r in files.scan_files(spark, folder, strict=False).collect()] == ["good.txt"]
    assert [os.path.basename(r["path"]) for r in files.undecodable_files(spark, folder).collect()] == ["bad.txt"]


def test_missing_or_empty_directory(spark, folder):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.scan_files(spark, folder + "/nowhere")
    put(folder, "picture.png", b"x")
    with pytest.raises(ValueError, match="no supported files"):
        files.scan_files(spark, folder)


@pytest.mark.parametrize(
    "path, suffix",
    [("a.TXT", ".txt"), ("x/y.tar.gz", ".gz"), (".txt", ""), ("a.", ""), ("d.md/plain", ""), ("d/a.b.Md", ".md")],
)
def test_suffix(spark, path, suffix):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(files.suffix(F.col("p"))).first()[0] == suffix


def test_pages_keep_their_order(spark):
    pages = [("d", n, None if n == 3 else f"p{n}") for n in range(12)] + [("e", 1, "only")]
    df = spark.createDataFrame(pages, "source string, page_no int, text string").repartition(5)
    got = {r["source"]: r["text"] for r in files.assemble_pages(df).collect()}
    assert got["d"] == "\n\n".join("" if n == 3 else f"p{n}" for n in range(12))
    assert got["e"] == "only"


def test_line_numbers_across_splits(spark, folder):
    lines = [f"line {n} " + "x" * (n % 50) for n in range(2000)]
    lines[700], lines[900], lines[1200] = "", "two\u2028parts", "three\x0bparts\x1c here"
    text = "\r\n".join(lines[:50]) + "\r\n" + "\n".join(lines[50:]) + "\n"
    put(folder, "lines.txt", text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        numbered = cases.numbered_lines(spark, folder)
        assert spark.read.text(folder).rdd.getNumPartitions() > 5
        got = {r["line_number"]: r["line"] for r in numbered.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == dict(enumerate(text.splitlines(), 1))


GOOD = {"id": "one", "category": "fact", "question": " q? ", "relevant_sources": [" a.md ", "b.md", "a.md"], "reference_answer": " r ", "should_answer": True}


def write_lines(folder, lines):
    put(folder, "cases.jsonl", "\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines).encode())
    return folder + "/cases.jsonl"


def test_good_cases(spark, folder):
    path = write_lines(folder, ["", GOOD, "  ", {"question": "no answer", "should_answer": False}, {"question": 5, "relevant_sources": ["x"], "category": " "}])
    rows = {r["case_id"]: r for r in cases.load_cases(spark, path).collect()}
    assert set(rows) == {"one", "case-0004", "case-0005"}
    assert rows["one"]["question"] == "q?" and rows["one"]["reference_answer"] == "r"
    assert rows["one"]["relevant_sources"] == ["a.md", "b.md"]
    assert rows["case-0004"]["should_answer"] is False and rows["case-0004"]["relevant_sources"] == []
    assert rows["case-0005"]["question"] == "5" and rows["case-0005"]["category"] == "unspecified"


@pytest.mark.parametrize(
    "line, message",
    [
        ('{"question": ', "line 2: not valid JSON"),
        ('["a"]', "line 2: not a JSON object"),
        ("7", "line 2: not a JSON object"),
        ({"question": "　", "relevant_sources": ["a"]}, "line 2: question is missing"),
        ({"relevant_sources": ["a"]}, "line 2: question is missing"),
        ({"question": "q", "relevant_sources": "a"}, "line 2: relevant_sources must be"),
        ({"question": "q", "relevant_sources": None}, "line 2: relevant_sources must be"),
        ({"question": "q", "relevant_sources": {"a": 1}}, "line 2: relevant_sources must be"),
        ({"question": "q", "relevant_sources": ["a", " "]}, "line 2: relevant_sources must be"),
        ({"question": "q", "relevant_sources": ["a", 1]}, "line 2: relevant_sources must be"),
        ({"question": "q", "relevant_sources": ["a"], "should_answer": "yes"}, "line 2: should_answer must be"),
        ({"question": "q", "relevant_sources": ["a"], "should_answer": None}, "line 2: should_answer must be"),
        ({"question": "q", "relevant_sources": ["a"], "should_answer": 1}, "line 2: should_answer must be"),
        ({"question": "q"}, "line 2: an answerable case needs"),
    ],
)
def test_bad_cases(spark, folder, line, message):
    with pytest.raises(ValueError, match=message):
        cases.load_cases(spark, write_lines(folder, [GOOD, line]))


def test_repeated_ids_and_empty_sets(spark, folder):
    with pytest.raises(ValueError, match="repeated case id: one"):
        cases.load_cases(spark, write_lines(folder, [GOOD, GOOD]))
    with pytest.raises(ValueError, match="empty"):
        cases.load_cases(spark, write_lines(folder, ["", " "]))


def test_passages_are_found_as_whole_words(spark):
    texts = ["x a b c d e f y", "a b c\nd  e f", "xa b c d e f", "a b c d e", "one two", "stone two", "one  two three", ""]
    passages = ["a b c d e f", "one two", "zz", " "]
    got = driver_tables.find_passages(
        spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"),
        spark.createDataFrame(list(enumerate(passages)), "item_id int, text string"),
    ).collect()
    assert sorted(map(tuple, got)) == [(0, 0), (1, 0), (4, 1), (6, 1)]


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    first = scratch.shared_folder(spark)
    assert first == (configured.rstrip("/") if configured else scratch.shared_folder(spark))
    table = scratch.materialize(spark.range(5).toDF("x"), "numbers")
    assert table.inputFiles()[0].find(first.split(":")[-1]) >= 0 and table.count() == 5


def test_derived_tables_follow_their_sources(spark, folder):
    def save(*rows):
        table = spark.createDataFrame(list(rows), "doc_id long, text string, source string")
        table.write.mode("overwrite").parquet(folder + "/documents.parquet")

    def indexed():
        return sorted(row["text"] for row in driver_tables.corpus_index(spark, folder).chunks.collect())

    save((1, "one", "a"))
    assert indexed() == ["one"]
    save((1, "one", "a"), (2, "two", "a"))
    assert indexed() == ["one", "two"]
