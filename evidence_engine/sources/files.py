"""Document files and page tables as raw documents."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidence_engine import fixed_values as fv


def suffix(path: Column) -> Column:
    """Lower-case suffix of the file name; names like ``.txt`` or ``a.`` have none."""
    name = F.regexp_extract(path, r"([^/]*)/*\z", 1)
    return F.lower(F.regexp_extract(name, r"(?s)\A.+(\.[^.]+)\z", 1))


def is_supported(path: Column) -> Column:
    return suffix(path).isin(*fv.SUPPORTED_SUFFIXES)


def filter_supported(files: DataFrame, strict: bool = False) -> DataFrame:
    """Keep supported files; in strict mode an unsupported one is an error."""
    supported = is_supported(F.col("path"))
    if strict:
        complaint = F.raise_error(F.concat(F.lit("unsupported file: "), F.col("path"))).cast("boolean")
        supported = F.when(supported, F.lit(True)).otherwise(complaint)
    return files.where(supported)


def unsupported_files(files: DataFrame) -> DataFrame:
    return files.where(~is_supported(F.col("path"))).select("path", F.lit("unsupported suffix").alias("reason"))


def _gb18030(content: Column) -> Column:
    """``text`` and ``failed``; a nested function, so that it travels to executors by value."""

    def decode(content):
        if content is None:
            return None, False
        try:
            return bytes(content).decode("gb18030"), False
        except UnicodeDecodeError:
            return None, True

    def decode_all(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode(c) for c in contents], columns=["text", "failed"])

    return F.pandas_udf(decode_all, "struct<text:string,failed:boolean>")(content)


def decode_text(files: DataFrame) -> DataFrame:
    """``text`` and ``undecodable`` from ``content``: UTF-8 where valid, else GB18030.

    The JVM decodes valid rows; Python receives bytes only of the others (NULL for the rest).
    """
    as_text = F.col("content").cast("string")
    valid = F.is_valid_utf8(as_text)
    fallback = _gb18030(F.when(~valid, F.col("content")))
    return (
        files.withColumn("fallback", fallback)
        .withColumn("text", F.when(valid, as_text).otherwise(F.col("fallback.text")))
        .withColumn("undecodable", F.coalesce(F.col("fallback.failed"), F.lit(False)))
        .drop("fallback", "content")
    )


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)


def _text_files(spark: SparkSession, directory: str) -> DataFrame:
    """Only text files; a file name pattern, so that the bytes of others are never read."""
    endings = ("".join(f"[{c}{c.upper()}]" for c in ending[1:]) for ending in fv.TEXT_SUFFIXES)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return reader.option("pathGlobFilter", "*.{" + ",".join(endings) + "}").load(directory)


def qualified(spark: SparkSession, directory: str) -> str:
    """A directory as its file system names it, without ``//``, ``.`` and ``..``; patterns are an error."""
    if re.search(r"[*?\[{]", directory):
        raise ValueError(f"{directory} is a pattern, not a directory")
    path = spark._jvm.org.apache.hadoop.fs.Path
    full = path(directory).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path(directory))
    return path(full.toUri().normalize()).toString()


def reject_files(files: DataFrame) -> DataFrame:
    """``path, reason`` of the files that a scan does not read for their names."""
    name = F.lower(F.col("path"))
    text = F.lit(False)
    for suffix in fv.TEXT_SUFFIXES:
        text = text | name.endswith(suffix)
    reason = F.when(name.endswith(".pdf"), "PDF files are not parsed: give their pages as a table").otherwise("unsupported file type")
    return files.where(~text).select("path", reason.alias("reason"))


def scan_rejects(spark: SparkSession, directory: str) -> DataFrame:
    """The reject table of :func:`scan_files`."""
    return reject_files(list_files(spark, qualified(spark, directory)).select("path"))


def scan_files(spark: SparkSession, directory: str, strict: bool = True) -> DataFrame:
    """Text files below a directory as ``source, text``; sources are relative paths.

    A missing directory is an error, as is one without text files, or a pattern. With ``strict`` an
    undecodable file is one too; otherwise it is left out (see :func:`undecodable_files`). What is
    not read for its name, PDFs among them, is in :func:`scan_rejects`. Empty files, and those whose
    names start with ``_`` or ``.``, are not seen by Spark's file sources.
    """
    directory = qualified(spark, directory)
    if _text_files(spark, directory).select("path").isEmpty():
        raise ValueError(f"no supported files in {directory}: only text files are read")
    root = directory.rstrip("/") + "/"
    outside = F.raise_error(F.concat(F.col("path"), F.lit(f" is not below {root}"))).cast("string")
    relative = F.when(F.startswith("path", F.lit(root)), F.substring(F.col("path"), len(root) + 1, 1 << 30)).otherwise(outside)
    decoded = decode_text(_text_files(spark, directory).select(relative.alias("source"), "content"))
    if strict:
        complaint = F.raise_error(F.concat(F.lit("undecodable file: "), F.col("source"))).cast("string")
        return decoded.select("source", F.when(F.col("undecodable"), complaint).otherwise(F.col("text")).alias("text"))
    return decoded.where(~F.col("undecodable")).select("source", "text")


def undecodable_files(spark: SparkSession, directory: str) -> DataFrame:
    files = decode_text(_text_files(spark, directory).select("path", "content"))
    return files.where("undecodable").select("path", F.lit("neither UTF-8 nor GB18030").alias("reason"))


def assemble_pages(pages: DataFrame, document: str = "source", page: str = "page_no") -> DataFrame:
    """``document, page, text`` rows to one text per document, pages in order, NULL as empty.

    The result holds a document in one row, so a document is also the unit of grouping here.
    """
    ordered = F.array_sort(F.collect_list(F.struct(page, F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy(document).agg(F.array_join(ordered["text"], fv.PAGE_SEPARATOR).alias("text"))
