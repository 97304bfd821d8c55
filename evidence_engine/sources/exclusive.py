"""Small files that only one of several writers can create."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def publish(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Create ``folder/name`` with ``text``; False, and nothing changed, if it exists.

    The text is written aside first, so readers see all of it or nothing. Of two writers one wins where the file
    system renames atomically without overwriting (HDFS and the like; a hard link on a local disk). Plain object
    stores do not: there, let one writer at a time change a store.
    """
    jvm, context = spark._jvm, spark.sparkContext
    configuration = spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    draft = jvm.org.apache.hadoop.fs.Path(f"{folder}/.{name}-{uuid.uuid4().hex}")
    files = target.getFileSystem(configuration)
    stream = files.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if files.getUri().getScheme() == "file":
            jvm.java.nio.file.Files.createLink(files.pathToFile(target).toPath(), files.pathToFile(draft).toPath())
        else:
            rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            keep_existing = context._gateway.new_array(rename, 0)
            everywhere = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(target).toUri(), configuration)
            everywhere.rename(draft, target, keep_existing)
    except Py4JJavaError as error:
        if not error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            raise
        return False
    finally:
        files.delete(draft, False)
    return True
