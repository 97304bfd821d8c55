"""Evaluation cases from JSON lines, with the line number in every complaint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from evidence_engine import fixed_values as fv
from evidence_engine.functions import text as tx


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_number, line`` of text files, numbered across splits without one big task.

    Lines are counted per split; a split starts behind the lines of the splits before it. Row ids
    grow along a split, so they order the lines within it.
    """
    breaks = "[" + fv.LINE_BREAKS_INSIDE_TEXT_LINES + "]"
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.split("value", breaks).alias("lines"),
    )
    in_block = W.partitionBy("file", "block").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    before_block = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        raw.groupBy("file", "block")
        .agg(F.sum(F.array_size("lines").cast("bigint")).alias("n"))
        .withColumn("blocks_before", F.coalesce(F.sum("n").over(before_block), F.lit(0)))
        .drop("n")
    )
    return (
        raw.withColumn("rows_before", F.coalesce(F.sum(F.array_size("lines").cast("bigint")).over(in_block), F.lit(0)))
        .join(blocks, ["file", "block"])
        .select("file", "blocks_before", "rows_before", F.posexplode("lines").alias("position", "line"))
        .select("file", (F.expr("blocks_before + rows_before + position + 1")).alias("line_number"), "line")
    )


def scan_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases with an ``error`` column: NULL for good ones, else what is wrong with which line.

    Blank lines are skipped but counted. JSON ``null`` counts as a missing question or name.
    """
    return validate_cases(numbered_lines(spark, path))


def _text(field: str) -> Column:
    return F.coalesce(tx.strip(F.try_variant_get("json", f"$.{field}", "string")), F.lit(""))


def _type(field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("json", f"$.{field}", "variant"))


def validate_cases(lines: DataFrame) -> DataFrame:
    """``line_number, line`` to ``case_id, category, …, should_answer, line_number, error``."""
    parsed = lines.where(~tx.is_blank(F.col("line"))).withColumn("json", F.try_parse_json("line"))
    fields = parsed.select(
        "line_number",
        F.col("json").isNull().alias("broken"),
        F.schema_of_variant("json").alias("shape"),
        _text("id").alias("id"),
        _text("category").alias("category"),
        _text("question").alias("question"),
        _text("reference_answer").alias("reference_answer"),
        _type("relevant_sources").alias("sources_type"),
        F.try_variant_get("json", "$.relevant_sources", "array<variant>").alias("source_values"),
        _type("should_answer").alias("answer_type"),
        F.try_variant_get("json", "$.should_answer", "boolean").alias("answer_value"),
    )
    # A missing list is empty, a missing flag is true; values of another type are errors.
    sources = F.transform(
        F.coalesce("source_values", F.array().cast("array<variant>")),
        lambda v: F.when(
            F.schema_of_variant(v) == "STRING", tx.strip(F.try_variant_get(v, "$", "string"))
        ).otherwise(F.lit("")),
    )
    typed = fields.withColumn("sources", sources).withColumn(
        "should_answer", F.when(F.col("answer_type").isNull(), True).otherwise(F.col("answer_value"))
    )
    sources_bad = (~F.coalesce("sources_type", F.lit("ARRAY<>")).startswith("ARRAY")) | F.exists(
        "sources", lambda s: s == ""
    )
    problem = (
        F.when(F.col("broken"), F.lit("not valid JSON"))
        .when(~F.col("shape").startswith("OBJECT"), F.lit("not a JSON object"))
        .when(F.col("question") == "", F.lit("question is missing"))
        .when(sources_bad, F.lit("relevant_sources must be a list of non-blank strings"))
        .when(F.coalesce("answer_type", F.lit("BOOLEAN")) != "BOOLEAN", F.lit("should_answer must be a boolean"))
        .when(F.col("should_answer") & (F.array_size("sources") == 0), F.lit("an answerable case needs relevant_sources"))
    )
    number = F.lpad(
        F.col("line_number").cast("string"),
        F.greatest(F.lit(fv.CASE_ID_DIGITS), F.length(F.col("line_number").cast("string"))),
        F.lit("0"),
    )
    default_id = F.concat(F.lit(fv.CASE_ID_PREFIX), number)
    return typed.select(
        F.when(F.col("id") == "", default_id).otherwise(F.col("id")).alias("case_id"),
        F.when(F.col("category") == "", fv.DEFAULT_CATEGORY).otherwise(F.col("category")).alias("category"),
        "question",
        "reference_answer",
        F.array_distinct("sources").alias("relevant_sources"),
        "should_answer",
        "line_number",
        F.when(
            problem.isNotNull(),
            F.concat(F.lit("line "), F.col("line_number").cast("string"), F.lit(": "), problem),
        ).alias("error"),
    )


def duplicate_case_ids(cases: DataFrame) -> DataFrame:
    return (
        cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1").orderBy("case_id")
    )


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Checked cases; raises on the first bad line, a repeated id or an empty set."""
    scanned = scan_cases(spark, path)
    bad = scanned.where("error is not null").orderBy("line_number").select("error").first()
    if bad:
        raise ValueError(bad["error"])
    cases = scanned.drop("error", "line_number")
    repeated = duplicate_case_ids(cases).first()
    if repeated:
        raise ValueError(f"repeated case id: {repeated['case_id']}")
    if cases.isEmpty():
        raise ValueError("the evaluation set is empty")
    return cases
