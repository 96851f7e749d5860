"""Tables that cut lineage, and readers of the corpus tables."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OPEN: list[list[str]] = []  # tables of the operators that run now


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. The cluster names it in spark.checkpoint.dir; only where that is unset and all
    executors are on this machine, as in tests, a temporary folder is set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def save(df: DataFrame, name: str, cut: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: a later stage neither repeats the work nor
    depends on files of one executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    (df.coalesce(cut) if cut else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are saved in here are deleted at the end: what they were for must be written or collected by then."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.pop()
        delete(spark, made)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose rows are written to the shared folder, and whose other tables there are deleted, when it ends."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **more) -> DataFrame:
        made: list[str] = []
        _OPEN.append(made)
        try:
            out = operator(docs, *args, **more)
        except BaseException:
            delete(docs.sparkSession, made)
            raise
        finally:
            _OPEN.pop()
        if not made:
            return out
        result = save(out, operator.__name__)
        delete(docs.sparkSession, made)
        return result

    return run


BROADCAST = 1 << 20  # rows of an id and a number


def few(df: DataFrame) -> DataFrame:
    """A table of ids for a join with whole documents: sent to all tasks if it has at most BROADCAST rows, so that no text is
    shuffled for it; beyond, both sides are shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(df: DataFrame) -> int:
    """UTF-8 bytes of all texts: sets how many pieces work is dealt into."""
    return df.select(F.sum(F.octet_length("text")).alias("b")).first().b or 0


def pieces(total: int, each: int, least: int = 1) -> int:
    return max(least, -(-total // each))
