"""Tables that are folders of files give what tables in one file give."""

import compare
import duckdb
import pytest

from evidence_engine.plans.oracles import ORACLES
from evidence_engine.plans.queries import QUERIES
from evidence_engine.sources import driver_tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark, folder):
    spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_a_stream_of_a_folder(spark, tables):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS FROM '{tables}/documents.parquet/*.parquet'")
    streamed = QUERIES["ingest_stream"](spark, tables)
    assert streamed.count() > 0
    assert compare.differences(streamed, connection, ORACLES["ingest_stream"]) == []


def test_a_stream_reads_one_table_only(spark, tables, folder):
    spark.range(5).write.parquet(f"{tables}/documents.parquet2")
    query = driver_tables.stream(spark, tables, "documents").writeStream.trigger(availableNow=True).format("parquet")
    query.option("checkpointLocation", f"{folder}/seen").start(f"{folder}/copy").awaitTermination()
    whole = spark.read.parquet(f"{tables}/documents.parquet")
    assert spark.read.parquet(f"{folder}/copy").exceptAll(whole).isEmpty() and spark.read.parquet(f"{folder}/copy").count() == whole.count()
