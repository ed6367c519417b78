"""Removal of staged tables that nothing reads any more."""

from __future__ import annotations

from pyspark.sql import DataFrame


def discard(*staged: DataFrame) -> None:
    """Deletes the folders of staged tables; all their consumers must have been written already."""
    for frame in staged:
        files = frame.inputFiles()
        if files:
            spark = frame.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
