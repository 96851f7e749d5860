"""Feeds: texts that are appended batch by batch, each batch once and whole, and read from where a reader stopped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .log import Files, Log


class Feed:
    """A folder of batches and their log. A batch is a folder of lines or of texts parted by ``between``, written before the log
    names it; a batch that the log has for a writer already isn't written again, however often it is replayed."""

    def __init__(self, spark: SparkSession, path: str, between: str = "\n") -> None:
        self.spark, self.between = spark, between
        self.files = Files(spark, path)
        self.log = Log(self.files)

    def append(self, texts: DataFrame, writer: str, batch: int) -> bool:
        """Append texts (value); False if this batch or a later one of the writer is there already."""
        folder = None
        while True:
            version, body = self.log.latest()
            done = body.get("done", {})
            if done.get(writer, -1) >= batch:
                if folder:
                    self.files.delete(folder)
                return False
            if folder is None:
                folder = f"data/{uuid.uuid4().hex}"
                texts.select("value").write.option("lineSep", self.between).text(self.files.full(folder))
            if self.log.put(version + 1, {"done": done | {writer: batch}, "folder": folder, "writer": writer, "batch": batch}):
                return True

    def read(self, after: int = -1) -> DataFrame:
        """(value, version) of the batches that came after a version."""
        came = [(self.log.get(v)["folder"], v) for v in self.log.versions() if v > after]
        if not came:
            return self.spark.createDataFrame([], "value string, version long")
        texts = self.spark.read.option("lineSep", self.between).text([self.files.full(f) for f, _ in came])
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        versions = self.spark.createDataFrame([(f.split("/")[-1], v) for f, v in came], "_folder string, version long")
        return texts.withColumn("_folder", name).join(F.broadcast(versions), "_folder").select("value", "version")

    def sink(self, writer: str):
        """For writeStream.foreachBatch: every batch of a query once, over restarts as well."""
        return lambda df, batch: self.append(df, writer, batch)
