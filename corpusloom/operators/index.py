"""Inverted index: build, persist, load, update; keyword-to-page table; default vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.session import parts_of


@dataclass
class CorpusIndex:
    """Tables of one index version.

    ``postings(doc_id, dl, term, tf)`` is partitioned by ``doc_id`` so that scoring a
    document never needs a shuffle; ``term_stats(term, df)``; ``doc_stats(doc_id, dl)``;
    ``corpus_stats(n_docs, avgdl)`` has one row. ``counted``: term statistics are a stored table, not to be counted from postings.
    """

    postings: DataFrame
    term_stats: DataFrame
    doc_stats: DataFrame
    corpus_stats: DataFrame
    buckets: int | None = None
    counted: bool = False


def index_text(*parts: Column | str) -> Column:
    """Text that is indexed: content, name, documentation, context and path in one string."""
    return F.concat_ws(" ", *[F.coalesce(T._col(p), F.lit("")) for p in parts])


def text_parts(docs: DataFrame, text: Column | str = "text") -> int:
    """Number of partitions of ``PART_BYTES`` of text each."""
    return parts_of(docs, F.octet_length(T._col(text)))


def _each_token(rows: DataFrame) -> DataFrame:
    """``doc_id, dl, term`` of ``rows(doc_id, text)``; one row with a null term for a text without tokens.

    Outer, as a plain explode would have each text cut a second time before the exchange, to look whether it has tokens.
    """
    return rows.select("doc_id", T.tokens("text").alias("tokens")).select(
        "doc_id", F.size("tokens").cast("bigint").alias("dl"), F.explode_outer("tokens").alias("term")
    )


def term_frequencies(docs: DataFrame, doc_id: str, text: Column | str,
                     buckets: int | None = None) -> DataFrame:
    """``(doc_id, dl, term, tf)``.

    A document is one row, so its length is known before the explode, and after one
    exchange by ``doc_id`` the term groups and every later per-document sum are local. Without
    ``buckets`` there are as many partitions as hold ``PART_BYTES`` of text each.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), T._col(text).alias("text"))
    return (
        _each_token(rows.repartition(buckets or text_parts(rows), "doc_id"))
        .where("term IS NOT NULL")
        .groupBy("doc_id", "dl", "term")
        .agg(F.count("*").alias("tf"))
    )


def document_lengths(docs: DataFrame, doc_id: str, text: Column | str) -> DataFrame:
    """``(doc_id, dl)`` for every document, 0 where it has no token or its text is null; no shuffle."""
    held = F.coalesce(T._col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.size(T.tokens(held)).cast("bigint").alias("dl"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus_statistics(doc_stats: DataFrame) -> DataFrame:
    return doc_stats.agg(
        F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")
    )


def build_index(docs: DataFrame, doc_id: str, text: Column | str,
                buckets: int | None = None) -> CorpusIndex:
    buckets = buckets or text_parts(docs, text)
    postings = term_frequencies(docs, doc_id, text, buckets)
    lengths = document_lengths(docs, doc_id, text)
    return CorpusIndex(
        postings, document_frequencies(postings), lengths, corpus_statistics(lengths), buckets
    )


# --- persistence ------------------------------------------------------------------------
STATE = "version int, buckets int"


def _table(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, None if there is none; any other fault is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _last_version(spark: SparkSession, path: str) -> tuple[int, int | None]:
    """Number and buckets of the last complete version, (0, None) before the first."""
    state = _stored(spark, _table(path, "state"))
    if state is None:
        return 0, None
    last = state.agg(F.max(F.struct("version", "buckets")).alias("x")).first()["x"]
    return (last["version"], last["buckets"]) if last else (0, None)


def _open_postings(spark: SparkSession, table: str, location: str, buckets: int) -> DataFrame:
    """The bucketed table over ``location``; a catalog entry of that name must lie there."""
    if spark.catalog.tableExists(table):
        rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'")
        known = rows.first()["data_type"]
        if urlparse(known).path.rstrip("/") != urlparse(location).path.rstrip("/"):
            raise ValueError(f"table {table} lies at {known}, not at {location}")
    else:
        columns = spark.read.parquet(location).schema
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns)
        spark.sql(
            f"CREATE TABLE {table} ({ddl}) USING parquet CLUSTERED BY (doc_id) "
            f"SORTED BY (term) INTO {buckets} BUCKETS LOCATION '{location}'"
        )
    return spark.table(table)


def save_index(index: CorpusIndex, path: str, name: str, buckets: int | None = None) -> int:
    """Write the index as the next version below ``path``; returns its number.

    Postings are bucketed by ``doc_id`` and sorted by term in a bucket, so scores sum without an
    exchange and a filter on terms skips row groups. The number of buckets is the one given, else
    that of the index, of the version before, or the session's shuffle partitions; it is kept with
    the version. An index built with it is written without a further exchange. A version counts once
    its row of ``state`` is written, which is last: readers of the version before are not disturbed,
    so an index may be loaded, updated and saved under one name.
    """
    spark = index.postings.sparkSession
    last, before = _last_version(spark, path)
    buckets = buckets or index.buckets or before or int(spark.conf.get("spark.sql.shuffle.partitions"))
    root, table = _table(path, f"v={last + 1}"), f"{name}_v{last + 1}_postings"
    postings = index.postings
    if index.buckets != buckets:
        postings = postings.repartition(buckets, "doc_id")
    (
        postings.write.mode("overwrite")
        .bucketBy(buckets, "doc_id")
        .sortBy("term")
        .option("path", _table(root, "postings"))
        .saveAsTable(table)
    )
    written = spark.table(table)
    index.doc_stats.write.mode("overwrite").parquet(_table(root, "doc_stats"))
    document_frequencies(written).write.mode("overwrite").parquet(_table(root, "term_stats"))
    lengths = spark.read.parquet(_table(root, "doc_stats"))
    corpus_statistics(lengths).write.mode("overwrite").parquet(_table(root, "corpus_stats"))
    state = spark.createDataFrame([(last + 1, buckets)], STATE)
    state.coalesce(1).write.mode("append").parquet(_table(path, "state"))
    return last + 1


def load_index(spark: SparkSession, path: str, name: str, lengths: DataFrame | None = None) -> CorpusIndex:
    """Read the last complete version below ``path``.

    Missing term and corpus statistics are rebuilt. Document lengths are rebuilt from ``lengths``
    (``document_lengths`` of the documents) only, as postings do not know documents without a term.
    """
    version, buckets = _last_version(spark, path)
    if not version:
        raise ValueError(f"no complete index version at {path}")
    root = _table(path, f"v={version}")
    postings = _open_postings(spark, f"{name}_v{version}_postings", _table(root, "postings"), buckets)
    held = {part: _stored(spark, _table(root, part)) for part in ("doc_stats", "term_stats", "corpus_stats")}
    of_docs = lengths if held["doc_stats"] is None else held["doc_stats"]
    if of_docs is None:
        raise ValueError(f"no document lengths at {root}: pass lengths to rebuild them")
    terms, corpus = held["term_stats"], held["corpus_stats"]
    return CorpusIndex(
        postings,
        document_frequencies(postings) if terms is None else terms,
        of_docs,
        corpus_statistics(of_docs) if corpus is None else corpus,
        buckets,
        terms is not None,
    )


# --- incremental maintenance -----------------------------------------------------------------
def update_index(index: CorpusIndex, changed: DataFrame, doc_id: str, text: Column | str,
                 removed: DataFrame | None = None) -> CorpusIndex:
    """New index version: documents in ``changed`` replace or extend, ``removed`` go.

    Only changed documents are tokenised. Stored statistics are delta-merged: they are sums,
    so subtracting the outgoing and adding the incoming counts is exact. Where they are still to be counted,
    only the postings that stay are.
    """
    incoming = build_index(changed, doc_id, text)
    gone = changed.select(F.col(doc_id).alias("doc_id"))
    if removed is not None:
        gone = gone.unionByName(removed.select(F.col(doc_id).alias("doc_id")))
    gone = gone.distinct().hint("shuffle_hash")  # the ids are hashed; postings stay as they lie and are not sorted
    kept = index.postings.join(gone, "doc_id", "left_anti")
    postings = kept.unionByName(incoming.postings)
    lengths = index.doc_stats.join(gone, "doc_id", "left_anti").unionByName(incoming.doc_stats)
    if index.counted:
        outgoing = document_frequencies(index.postings.join(gone, "doc_id", "left_semi"))
        staying = index.term_stats.unionByName(outgoing.select("term", (-F.col("df")).alias("df")))
    else:
        staying = document_frequencies(kept)
    terms = (
        staying.unionByName(incoming.term_stats)
        .groupBy("term")
        .agg(F.sum("df").alias("df"))
        .where("df > 0")
    )
    return CorpusIndex(postings, terms, lengths, corpus_statistics(lengths))


def index_state(chunks: DataFrame, corpus: str, path: str, version: int, model: str,
                hybrid: bool) -> DataFrame:
    """One-row state of an index version: counts of files and chunks, model, time."""
    return chunks.agg(
        F.countDistinct(path).alias("file_count"), F.count("*").alias("chunk_count")
    ).select(
        F.lit(corpus).alias("corpus_id"),
        F.lit(version).alias("version"),
        F.current_timestamp().alias("indexed_at"),
        "file_count",
        "chunk_count",
        F.lit(model).alias("embedding_model"),
        F.lit(hybrid).alias("has_hybrid_index"),
    )


# --- keyword to pages ---------------------------------------------------------------------------
def keyword_pages(pages: DataFrame, page_id: str, text: Column | str) -> DataFrame:
    """Distinct ``(keyword, page)`` pairs, long form: a common keyword stays many rows.

    A page is one row and its keywords are already distinct, so there is no shuffle.
    """
    return pages.select(F.col(page_id), F.explode(T.keywords(text)).alias("keyword"))


# --- vectors --------------------------------------------------------------------------------------
def embed(docs: DataFrame, doc_id: str, text: Column | str,
          fn: Callable[[Column], Column] | None = None, dim: int = 384) -> DataFrame:
    """``(doc_id, embedding)``; ``fn`` is a pandas UDF ``text -> array<float>``.

    Without a model: feature hashing weighted by inverse document frequency, unit length.
    The only fitted state is one count per dimension. Failed or empty texts give zeros.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), T._col(text).alias("text"))
    if fn is not None:
        zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
        return src.select("doc_id", F.coalesce(fn(F.col("text")), zeros).alias("embedding"))
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    counted = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=dim).transform(
        src.select("doc_id", T.tokens("text").alias("tokens"))
    )
    weighted = IDF(inputCol="tf", outputCol="w").fit(counted).transform(counted)
    unit = Normalizer(inputCol="w", outputCol="unit", p=2.0).transform(weighted)
    return unit.select("doc_id", vector_to_array("unit", "float32").alias("embedding"))
