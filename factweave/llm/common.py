"""What the operators share: the folder for cutting lineage, and table reading."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Hashable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Delimiters of words in every contract here: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only where none is set and all runs in one process."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: no lineage, survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under its own names; null text becomes empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def unique_ids(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether every row has an id of its own: an aggregation of the ids alone."""
    odd = docs.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count("*").alias("n")).filter("n > 1 OR id IS NULL")
    return not odd.limit(1).count()


def with_row(docs: DataFrame, id_col: str = "doc_id", name: str = "row") -> DataFrame:
    """``docs`` with a unique long for each row, which follows the ids (rows without one last).

    Where ids are there and unique it is the id. Otherwise rows are sorted by (id, a number that they are given and
    that is written down), and numbered in that order: rows that repeat an id have an order, the same for everything
    that is made of the result.
    """
    if unique_ids(docs, id_col):
        return docs.withColumn(name, F.col(id_col).cast("long"))
    order = [F.col(id_col).cast("long").asc_nulls_last(), F.col(name)]
    given = cut(docs.withColumn(name, F.monotonically_increasing_id()))
    return cut(given.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


_HELD: dict = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def held(key: Hashable, make: Callable[[], object]):
    """What a Python worker keeps between tasks: one thing, so operators that follow each other do not add up."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Give back what an operator before this one left in the worker, also what the allocators still hold."""
    if _HELD:
        _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)
