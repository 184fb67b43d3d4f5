"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Functions of the named module travel with the task, so executors need no copy of this package.
def ship(module: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def others(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` that have none of the names, in letter case as Spark compares them."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true"
    taken = {n if exact else n.lower() for n in names}
    return [c for c in df.columns if (c if exact else c.lower()) not in taken]


def text_of(name: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def text_key(text: Column) -> Column:
    """16 bytes that stand for a whole text."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character kept; plain ASCII takes the fast way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def batches_of(batch: pa.RecordBatch, rows: int = 2000):
    """A batch in slices, so that what a task holds at once stays small."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


ship(__name__)
