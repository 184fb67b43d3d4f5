"""Vectors kept by content: only texts that were never embedded reach the model.

The table of vectors is keyed by the digest of the text, so a moved, copied or renamed text keeps its
vector and a change set costs as many model calls as it has new texts. A run adds a folder of its
own; the last row of ``runs``, which is written after it, names the folders that count.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.index import _stored, _table
from corpusloom.session import BROADCAST_BYTES, dealt_join, is_small, settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH = 32
Encode = Callable[[list[str]], list[list[float]]]


def vectors_of(encode: Encode, texts: list[str], dim: int) -> list[list[float] | None]:
    """A vector per text; if a batch fails its texts go one by one, and those that fail alone have none."""
    try:
        found = [[float(x) for x in v] for v in encode(texts)]
        if len(found) == len(texts) and all(len(v) == dim for v in found):
            return found
    except Exception:  # whatever a model raises concerns this batch alone
        pass
    if len(texts) == 1:
        return [None]
    return [v for t in texts for v in vectors_of(encode, [t], dim)]


def run_model(texts: DataFrame, load: Callable[[], Encode], dim: int, batch: int = BATCH) -> DataFrame:
    """``digest``, ``embedding`` of ``digest``, ``text``; the model is loaded once a task and asked ``batch`` texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                encode = encode or load()
                found = vectors_of(encode, part.column(1).to_pylist(), dim)
                good = pa.array([v is not None for v in found], pa.bool_())
                rows = [part.column(0), pa.array(found, pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(rows, ["digest", "embedding"]).filter(good)

    return texts.select("digest", "text").mapInArrow(run, "digest string, embedding array<float>")


def _runs(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Number of the last version, and the runs that it consists of."""
    state = _stored(spark, _table(path, "runs"))
    row = state.orderBy(F.desc("version")).first() if state is not None else None
    return (row["version"], row["runs"]) if row else (0, [])


def _put_runs(spark: SparkSession, path: str, version: int, runs: list[str]) -> None:
    state = spark.createDataFrame([(version, runs)], "version int, runs array<string>")
    state.coalesce(1).write.mode("append").parquet(_table(path, "runs"))


def known_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """``digest``, ``embedding`` of all runs that were completed."""
    names = _runs(spark, path)[1]
    return spark.read.parquet(*[f"{_table(path, 'vectors')}/{n}" for n in names]).select("digest", "embedding") if names else None


def save_run(vectors: DataFrame, path: str, alone: bool = False) -> None:
    """Add ``digest, embedding`` rows as a run; ``alone``: the only one that counts from now on."""
    spark = vectors.sparkSession
    run = f"r{uuid.uuid4().hex}"
    vectors.write.parquet(f"{_table(path, 'vectors')}/{run}")
    version, runs = _runs(spark, path)
    _put_runs(spark, path, version + 1, [run] if alone else [*runs, run])


def with_digest(docs: DataFrame, text: Column | str) -> DataFrame:
    """``docs`` with its text, a null one empty, as ``text`` and the ``digest`` of it."""
    return docs.withColumn("text", F.coalesce(T._col(text), F.lit(""))).withColumn("digest", F.sha2("text", 256))


def remember(
    rows: DataFrame, path: str, load: Callable[[], Encode], dim: int, batch: int = BATCH, key: str | None = None
) -> None:
    """Embed the texts of ``rows(text, digest)`` whose digest is not known at ``path``, each once; empty ones are passed over.

    ``key`` names a column of unique values, if there is one: where ``rows`` lie by it, texts are not exchanged.
    """
    known = known_vectors(rows.sparkSession, path)
    new = rows.where("text <> ''")
    new = new.groupBy("digest").agg(F.min(key).alias(key)) if key else new.select("digest").distinct()
    if known is not None:
        new = new.join(known.select("digest"), "digest", "left_anti")
    new = settle(new)
    if new.limit(1).count():
        # few new texts are picked where they stand; only they are exchanged
        picked = rows.join(F.broadcast(new) if is_small(new) else new, key or "digest", "left_semi")
        save_run(run_model(picked if key else picked.dropDuplicates(["digest"]), load, dim, batch), path)


def lookup(rows: DataFrame, known: DataFrame | None, dim: int) -> DataFrame:
    """``rows(digest, ...)`` with the ``embedding`` of their digest, zeros where none is known; a digest may be that of many rows."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    if known is None:
        return rows.drop("digest").withColumn("embedding", zeros)
    most = max(BROADCAST_BYTES // (4 * dim + 100), 1)  # a vector and its digest
    return dealt_join(rows, known, "digest", "left", rows=most).drop("digest").withColumn(
        "embedding", F.coalesce("embedding", zeros)
    )


def embed_by_content(
    docs: DataFrame, doc_id: str, text: Column | str, path: str, load: Callable[[], Encode], dim: int, batch: int = BATCH
) -> DataFrame:
    """``(doc_id, embedding)`` of every row of ``docs``; ``load`` returns the model, a function from texts to vectors.

    Texts whose digest is known are not embedded again; of equal new texts one is. Null, empty and failed texts have zeros;
    failed ones are asked again by the next call. ``path`` is shared storage and has one writer at a time.
    """
    rows = with_digest(docs.select(F.col(doc_id).alias("doc_id"), T._col(text).alias("text")), "text")
    remember(rows, path, load, dim, batch)
    return lookup(rows.select("doc_id", "digest"), known_vectors(docs.sparkSession, path), dim)


def forget(docs: DataFrame, text: Column | str, path: str) -> None:
    """Drop the vectors of texts that ``docs`` no longer has: what stays becomes one run, the only one that counts."""
    known = known_vectors(docs.sparkSession, path)
    if known is None:
        return
    used = docs.select(F.sha2(F.coalesce(T._col(text), F.lit("")), 256).alias("digest")).distinct()
    save_run(known.join(used, "digest", "left_semi"), path, alone=True)
