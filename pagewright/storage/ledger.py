"""A ledger of what providers answered: every distinct text is asked for once.

Answers are rows of a snapshot table, by a hash of the model's name and the text. What isn't there yet is found by an anti join,
asked for in batches, and written down in one job, so nothing later can make Spark ask again. A batch that fails is noted as
such; the others are committed before the failure is raised, and the next attempt asks for the failed ones only. (A task that
Spark runs again, because an executor was lost while it was asking, asks again.)
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .log import Files, release
from .snapshots import Table


class ProviderError(RuntimeError):
    """A provider failed for some texts; what it answered for others is kept."""


def _digest(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}\n"), text), 256)


class Ledger:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.files = Files(spark, path)

    def _table(self, model: str, kind: str) -> Table:
        """Answers of one type: texts and vectors are apart."""
        name = "".join(c if c.isalnum() else "_" for c in f"{model}-{kind}")
        return Table(self.spark, self.files.full(name), key="digest")

    def known(self, model: str, kind: str) -> DataFrame | None:
        """(digest, answer)"""
        table = self._table(model, kind)
        return None if table.snapshot().schema is None else table.read().select("digest", "answer")

    def answered(self, rows: DataFrame, text: Column, model: str, provider: Callable[[list[str]], list], kind: str = "string", batch: int = 64, to: str = "answer") -> DataFrame:
        """rows with the provider's answer to a text of theirs (null texts have none). The provider takes at most ``batch``
        texts and gives one answer for each, in order; another number of answers is a failure of the batch."""
        marked = rows.withColumn("_digest", _digest(model, text))
        asked = marked.select(F.col("_digest").alias("digest"), text.alias("text")).where("digest is not null").groupBy("digest").agg(F.first("text").alias("text"))
        known = self.known(model, kind)
        missing = asked if known is None else asked.join(known.select("digest"), "digest", "left_anti")
        calls = f"calls/{uuid.uuid4().hex}"

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i in range(0, len(pdf), batch):
                    some = pdf.iloc[i : i + batch]
                    answers, error = [None] * len(some), None
                    try:
                        got = list(provider(some["text"].tolist()))
                        if len(got) != len(some):
                            raise ValueError(f"{len(got)} answers to {len(some)} texts")
                        answers = got
                    except Exception as e:  # whatever it is, other batches go on and it is raised below
                        error = f"{type(e).__name__}: {e}"
                    yield pd.DataFrame({"digest": some["digest"], "answer": pd.Series(answers, index=some.index, dtype=object), "error": error})

        missing.mapInPandas(ask, f"digest string, answer {kind}, error string").write.parquet(self.files.full(calls))
        release(self.spark)
        try:
            said = self.spark.read.schema(f"digest string, answer {kind}, error string").parquet(self.files.full(calls))
            good = said.where("error is null").select("digest", "answer")
            if not good.isEmpty():
                self._table(model, kind).publish(good)
            bad = said.where("error is not null").agg(F.count(F.lit(1)).alias("n"), F.min("error").alias("e")).first()
        finally:
            self.files.delete(calls)
        if bad.n:
            raise ProviderError(f"{bad.n} texts without an answer: {bad.e}")
        known = self.known(model, kind)
        if known is None:
            return marked.drop("_digest").withColumn(to, F.lit(None).cast(kind))
        return marked.join(known.select(F.col("digest").alias("_digest"), F.col("answer").alias(to)), "_digest", "left").drop("_digest")
