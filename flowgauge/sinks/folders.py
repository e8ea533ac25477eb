"""Looking into folders of any file system Spark can reach, and small files that appear there whole or not at all."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), folder


def exists(spark: SparkSession, path: str) -> bool:
    system, folder = _open(spark, path)
    return system.exists(folder)


def names_below(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders directly below a folder."""
    system, folder = _open(spark, path)
    return [entry.getPath().getName() for entry in system.listStatus(folder)]


def read_small(spark: SparkSession, path: str) -> str:
    system, file = _open(spark, path)
    stream = system.open(file)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create_small(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file under a name that nobody else has taken; False if somebody has.

    It is written under another name and then renamed, so no reader sees part of it.
    """
    parent, _, name = path.rpartition("/")
    written = f"{parent}/.{name}-{uuid.uuid4().hex}"
    system, temporary = _open(spark, written)
    stream = system.create(temporary, False)
    stream.write(bytearray(content, "utf-8"))
    stream.close()
    jvm = spark._jvm
    wanted = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        system.makeQualified(wanted).toUri(), spark._jsparkSession.sessionState().newHadoopConf()
    )
    no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(system.makeQualified(temporary), system.makeQualified(wanted), no_overwrite)
        return True
    except Py4JJavaError as error:
        system.delete(temporary, False)
        if "FileAlreadyExistsException" in str(error.java_exception):
            return False
        raise
