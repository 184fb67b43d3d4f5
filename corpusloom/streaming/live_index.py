"""Keep an index, its statistics and its vectors in step with a stream of file versions.

State is a set of append-only tables, not operator state: every micro-batch appends its
documents' postings under the batch's version, and readers keep the newest version of each
document. Deletions arrive as rows without text (tombstones). Statistics are sums of deltas: a batch
subtracts what it replaces and adds what it brings, so reading them never counts postings anew.
Vectors are kept by content: a document names the digest of its text, and only texts that no
batch has brought before reach the model. A batch's versions are written
last: until then readers see none of it. A replayed batch overwrites its own folders and looks only
at batches before it, so the result is the same after a failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import embeddings as E
from corpusloom.operators import index as I
from corpusloom.session import is_small, settle

COMPACTED = -1  # a number before all batches of any stream


def stream_update(changes: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                  load: Callable[[], E.Encode] | None = None, dim: int = 0):
    """Start the update from a streaming ``changes(doc_id, version, text)``; returns the query.

    ``version`` orders the changes of a document; a null ``text`` deletes it. Of equal versions the
    later batch decides, and in a batch a deletion, then the greatest text. A change that comes after a
    newer one has no effect, nor has one without an id or a version. With ``load``, a function that returns the model (see
    ``embeddings.embed_by_content``), vectors of ``dim`` numbers are kept as well.
    """
    base = path.rstrip("/")
    writer = changes.writeStream.foreachBatch(
        lambda batch, batch_id: apply_batch(batch, batch_id, base, load, dim)
    ).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def apply_batch(batch: DataFrame, batch_id: int, base: str,
                load: Callable[[], E.Encode] | None = None, dim: int = 0) -> None:
    """Append the changes of one batch; the same batch may be applied again after a failure."""
    spark = batch.sparkSession
    change = F.struct("version", F.col("text").isNull().alias("deleted"), "text")
    newest = batch.where("doc_id IS NOT NULL AND version IS NOT NULL").groupBy("doc_id").agg(F.max(change).alias("c")).select(
        "doc_id", "c.version", "c.deleted", "c.text"
    )
    newest = _effective(newest, _standing(spark, base, batch_id)).persist()
    live = newest.where("NOT deleted")

    def put(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch_id}")

    # one pass over the texts, which already lie by doc_id; lengths come from the postings just written
    counted = live.select("doc_id", "version", T.tokens("text").alias("tokens")).select(
        "doc_id", "version", F.size("tokens").cast("bigint").alias("dl"), F.explode("tokens").alias("term")
    )
    each = counted.groupBy("doc_id", "version", "dl", "term").agg(F.count("*").alias("tf"))
    # a row per document, so that those replaced later are found by joining documents and not postings
    put(each.groupBy("doc_id", "version", "dl").agg(F.collect_list(F.struct("term", "tf")).alias("terms")), "postings")
    held = spark.read.parquet(f"{base}/postings/batch={batch_id}").select("doc_id", "version", "dl")
    put(
        live.select("doc_id", "version").join(held, ["doc_id", "version"], "left")
        .withColumn("dl", F.coalesce("dl", F.lit(0).cast("bigint"))),
        "lengths",
    )
    terms, corpus = _deltas(spark, base, batch_id, newest)
    put(terms, "term_deltas")
    put(corpus, "corpus_deltas")
    if load is not None:
        texts = E.with_digest(live.select("doc_id", "version", "text"), "text")
        E.remember(texts, f"{base}/content", load, dim, key="doc_id")
        put(texts.select("doc_id", "version", "digest"), "digests")
    put(newest.select("doc_id", "version", "deleted"), "versions")
    newest.unpersist()


def _standing(spark: SparkSession, base: str, before: int | None = None) -> DataFrame | None:
    """``doc_id, version, batch, deleted`` of the last change of every document, None before the first batch."""
    rows = I._stored(spark, f"{base}/versions")
    if rows is None:
        return None
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return rows.groupBy("doc_id").agg(F.max(F.struct("version", "batch", "deleted")).alias("c")).select("doc_id", "c.*")


def _effective(newest: DataFrame, standing: DataFrame | None) -> DataFrame:
    """Changes that nothing newer stands against, with the live version (``old_version``, ``old_batch``) they replace."""
    if standing is None:
        return newest.withColumns({"old_version": F.lit(None).cast("long"), "old_batch": F.lit(None).cast("int")})
    held = standing.select("doc_id", F.col("version").alias("_v"), F.col("batch").alias("_b"), F.col("deleted").alias("_d"))
    return (
        newest.join(held, "doc_id", "left")
        .where("_v IS NULL OR version >= _v")
        .withColumn("old_version", F.expr("CASE WHEN NOT _d THEN _v END"))
        .withColumn("old_batch", F.expr("CASE WHEN NOT _d THEN _b END"))
        .drop("_v", "_b", "_d")
    )


def _deltas(spark: SparkSession, base: str, batch_id: int, newest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a batch adds to the document frequency of each term, and to the number and length of documents."""
    old = newest.where("old_version IS NOT NULL").select(
        "doc_id", F.col("old_version").alias("version"), F.col("old_batch").alias("batch")
    )
    batches = [r["batch"] for r in old.select("batch").distinct().collect()]  # as many as batches since compaction

    def both(name: str) -> DataFrame:
        new = spark.read.parquet(f"{base}/{name}/batch={batch_id}").withColumn("sign", F.lit(1))
        if not batches:
            return new
        # only the folders of versions that are replaced are read
        replaced = _in_force(spark, base, name, old, batches)
        return new.unionByName(replaced.select(*new.columns[:-1], F.lit(-1).alias("sign")))

    terms = both("postings").select("sign", F.explode("terms.term").alias("term")).groupBy("term").agg(F.sum("sign").alias("df")).where("df <> 0")
    corpus = both("lengths").agg(
        F.coalesce(F.sum("sign"), F.lit(0)).alias("n_docs"),
        F.coalesce(F.sum(F.col("sign") * F.col("dl")), F.lit(0)).alias("tokens"),
    )
    return terms, corpus


def _newest(spark: SparkSession, base: str) -> DataFrame:
    """``doc_id, version, batch`` in force of every live document."""
    standing = _standing(spark, base)
    if standing is None:
        raise ValueError(f"no batch was ever written to {base}")
    return standing.where("NOT deleted").drop("deleted")


def _in_force(spark: SparkSession, base: str, name: str, newest: DataFrame, batches: list[int] | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{base}/{name}")
    if batches is not None:
        rows = rows.where(F.col("batch").isin(batches))
        newest = F.broadcast(newest) if is_small(newest) else newest
    return rows.join(newest, ["doc_id", "version", "batch"], "left_semi").drop("batch")


def _sums(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """``term, df`` and ``n_docs, tokens``: deltas of all batches whose versions are written."""
    done = F.broadcast(spark.read.parquet(f"{base}/versions").select("batch").distinct())  # one row a batch

    def rows(name: str) -> DataFrame:
        return spark.read.parquet(f"{base}/{name}").join(done, "batch", "left_semi")

    terms = rows("term_deltas").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    corpus = rows("corpus_deltas").agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")
    )
    return terms, corpus


def current_index(spark: SparkSession, path: str) -> I.CorpusIndex:
    """Index of the newest version of every live document; its statistics are sums of the batches' deltas."""
    base = path.rstrip("/")
    newest = _newest(spark, base)
    postings, lengths = (
        _in_force(spark, base, name, newest).drop("version") for name in ("postings", "lengths")
    )
    terms, corpus = _sums(spark, base)
    average = F.when(F.col("n_docs") > 0, F.col("tokens") / F.col("n_docs")).otherwise(F.lit(0.0))
    return I.CorpusIndex(
        postings.select("doc_id", "dl", F.inline("terms")), terms, lengths, corpus.select("n_docs", average.alias("avgdl")),
        counted=True,
    )


def current_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """``doc_id, embedding`` of every live document; empty texts and those the model failed on have zeros."""
    base = path.rstrip("/")
    rows = _in_force(spark, base, "digests", _newest(spark, base))
    return E.lookup(rows.select("doc_id", "digest"), E.known_vectors(spark, f"{base}/content"), dim).select("doc_id", "embedding")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the current version of all documents below ``target``, as one batch before all others.

    A stream goes on there with any checkpoint. Deletions are kept, so a change that comes late cannot revive a document.
    Vectors of texts that no live document has are left behind.
    """
    base, out = path.rstrip("/"), target.rstrip("/")
    standing = settle(_standing(spark, base))
    newest = standing.where("NOT deleted").drop("deleted")

    def put(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{out}/{name}/batch={COMPACTED}")

    for name in ("postings", "lengths"):
        put(_in_force(spark, base, name, newest), name)
    terms, corpus = _sums(spark, base)
    put(terms, "term_deltas")
    put(corpus, "corpus_deltas")
    if I._stored(spark, f"{base}/digests") is not None:
        digests = _in_force(spark, base, "digests", newest)
        put(digests, "digests")
        known = E.known_vectors(spark, f"{base}/content")
        if known is not None:
            E.save_run(known.join(digests.select("digest").distinct(), "digest", "left_semi"), f"{out}/content")
    put(standing.select("doc_id", "version", "deleted"), "versions")
