"""Sinks: chunk and vector tables, index state, site manifest, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import fixed
from corpusloom.functions import text as T
from corpusloom.operators import pages as P


def write_chunks(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Chunk table, one folder per corpus."""
    chunks.write.mode(mode).partitionBy("corpus_id").parquet(path)


def write_vectors(vectors: DataFrame, path: str, mode: str = "append") -> None:
    vectors.withColumn("embedding", F.col("embedding").cast("array<float>")).write.mode(mode).parquet(path)


def write_state(state: DataFrame, path: str) -> None:
    """Append the state of an index version."""
    state.write.mode("append").parquet(path)


def latest_state(states: DataFrame) -> DataFrame:
    """Newest version of every corpus, one row each."""
    cols = [c for c in states.columns if c not in ("corpus_id", "version")]
    newest = states.groupBy("corpus_id").agg(F.max(F.struct("version", *cols)).alias("s"))
    return newest.select("corpus_id", "s.*")


def write_site_manifest(pages: DataFrame, path: str) -> None:
    """Search index, page list and navigation of a site as JSON datasets below ``path``."""
    base = path.rstrip("/")
    index = P.page_index(pages)
    index.write.mode("overwrite").json(f"{base}/search_index")
    index.select("path", "title", "description").write.mode("overwrite").json(f"{base}/pages")
    P.navigation(pages).write.mode("overwrite").json(f"{base}/navigation")


# --- bundles ---------------------------------------------------------------------------
def safe_path(path: str = "path") -> Column:
    """False for absolute paths and for paths that climb out of their folder."""
    depth = F.aggregate(
        F.split(F.col(path), "/"),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda s, p: F.struct(
            (s["d"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("d"),
            F.least(
                s["low"], s["d"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)
            ).alias("low"),
        ),
    )
    return (depth["low"] >= 0) & ~F.col(path).startswith("/")


def bundle(wiki: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Bundle table ``section, path, size, content`` of wiki files and index parts.

    ``wiki(path, content)``: markdown pages and static assets; ``index(path, content)``.
    """
    wanted = T.ends_with_any("path", [".md", *fixed.ASSET_EXTENSIONS])
    rows = wiki.where(wanted).select(
        F.lit("wiki").alias("section"), "path", F.octet_length("content").cast("bigint").alias("size"), "content"
    )
    if index is None:
        return rows
    return rows.unionByName(
        index.select(
            F.lit("rag").alias("section"), "path", F.octet_length("content").cast("bigint").alias("size"), "content"
        )
    )


def write_bundle(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("section").parquet(path)


def list_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Sections, paths and sizes; the contents are not read."""
    return spark.read.parquet(path).select("section", "path", "size")


def extract_bundle(rows: DataFrame, wiki_only: bool = False) -> DataFrame:
    """Rows to extract: unsafe paths drop; ``wiki_only`` reads one partition."""
    safe = rows.where(safe_path())
    return safe.where(F.col("section") == "wiki") if wiki_only else safe
