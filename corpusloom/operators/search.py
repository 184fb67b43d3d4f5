"""Search over a corpus for a whole table of queries: keyword, vector, hybrid, fields.

Results are ``(query_id, rank, doc_id, score, ...)``; ties are broken by ``doc_id``.
Every top-k is a ranked window with a bound, which Spark prunes inside each input
partition before the exchange by ``query_id``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import fixed
from corpusloom.functions import text as T
from corpusloom.functions.arrays import bind
from corpusloom.operators.grams import GramIndex, phrase_texts
from corpusloom.operators.index import CorpusIndex
from corpusloom.operators.matching import few_words, phrase_hits, word_hits
from corpusloom.session import BROADCAST_ROWS, is_small, settle

# task functions travel with the job, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SALTS = 16
SCORE_DIGITS = 9


def top_k(rows: DataFrame, k: int, group: str = "query_id", score: str = "score",
          tie: str = "doc_id") -> DataFrame:
    """Best ``k`` rows of every group with their ``rank`` from 1.

    Sums of doubles depend on the order of adding, so scores are compared rounded: equal
    documents then tie exactly and the tie key decides.
    """
    w = Window.partitionBy(group).orderBy(F.round(score, SCORE_DIGITS).desc(), F.col(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --- keyword search --------------------------------------------------------------------
def query_terms(queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """``(query_id, term, qtf)``: a repeated term counts as often as it occurs."""
    return (
        queries.select(F.col(query_id).alias("query_id"), F.explode(T.tokens(query)).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def bm25_scores(index: CorpusIndex, queries: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """``(query_id, doc_id, score)`` of every document that shares a term with the query.

    Corpus statistics enter as scalar subqueries. A checked, bounded set of query terms is
    broadcast, so the postings keep their partitioning by ``doc_id`` and the sum per
    (query, document) needs no exchange. A larger set is joined on (term, salt): a very
    common term is spread over ``SALTS`` tasks.
    """
    n = index.corpus_stats.select("n_docs").scalar()
    avgdl = index.corpus_stats.select("avgdl").scalar()
    df = F.col("df")
    terms = query_terms(queries)
    weighted = (
        terms.join(index.term_stats, "term")
        .select(
            "query_id",
            "term",
            (F.col("qtf") * F.log((n - df + 0.5) / (df + 0.5) + 1)).alias("weight"),
        )
    )
    postings = index.postings
    if allowed is not None:
        # the ids are hashed; postings stay as they lie and are not sorted
        postings = postings.join(allowed.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")
    if is_small(terms, BROADCAST_ROWS):
        if (few := few_words(terms.select(F.col("term").alias("word")))) is not None:
            postings = postings.where(F.col("term").isin(few))  # reaches the scan of stored postings
        matched = postings.join(F.broadcast(weighted), "term")
    else:
        salted = weighted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        matched = postings.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS))).join(
            salted, ["term", "salt"]
        )
    tf = F.col("tf").cast("double")
    k1, b = fixed.BM25_K1, fixed.BM25_B
    norm = tf * (k1 + 1) / (tf + k1 * (1 - b + b * (F.col("dl") / avgdl)))
    return matched.groupBy("doc_id", "query_id").agg(F.sum(F.col("weight") * norm).alias("score"))


def keyword_search(index: CorpusIndex, queries: DataFrame, k: int = 10,
                   allowed: DataFrame | None = None) -> DataFrame:
    scores = bm25_scores(index, queries, allowed).where("score > 0")
    return top_k(scores, k).select("query_id", "rank", "doc_id", "score")


# --- vector search -----------------------------------------------------------------------
BLOCK_ROWS = 4096
SLICE_ROWS = 1024


def _unit(rows: pd.Series) -> np.ndarray:
    """Unit vectors as a matrix; zero vectors stay zero."""
    grid = np.stack(rows.to_numpy()).astype("float64")
    length = np.sqrt((grid * grid).sum(axis=1, keepdims=True))
    return grid / np.where(length == 0, 1.0, length)


def _ids(rows: pd.Series) -> np.ndarray:
    """Ids as they are: whole numbers as 64-bit integers, all others as objects."""
    return rows.to_numpy(dtype="int64") if pd.api.types.is_integer_dtype(rows.dtype) else rows.to_numpy(dtype=object)


def _best_first(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Order by falling score, equal ones by id."""
    if ids.dtype != object:
        return np.lexsort((ids, -scores))
    return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), dtype="int64")


def _scan_block(qids: np.ndarray, qvecs: np.ndarray, k: int):
    """Scan function: scores a partition against one block of queries, keeps k per query.

    Documents are taken in slices, so the score grid stays small; only queries whose
    current k-th score is reached in a slice are touched.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[np.ndarray | None] = [None for _ in qids]
        best = [np.empty(0) for _ in qids]
        floor = np.full(len(qids), -np.inf)
        for pdf in batches:
            for at in range(0, len(pdf), SLICE_ROWS):
                part = pdf.iloc[at : at + SLICE_ROWS]
                doc = _ids(part["doc_id"])
                grid = np.round(_unit(part["vec"]) @ qvecs.T, SCORE_DIGITS)
                reached = grid >= floor
                for j in np.flatnonzero(reached.any(axis=0)):
                    rows = reached[:, j]
                    all_ids = doc[rows] if ids[j] is None else np.concatenate([ids[j], doc[rows]])
                    scores = np.concatenate([best[j], grid[rows, j]])
                    order = _best_first(all_ids, scores)[:k]
                    ids[j], best[j] = all_ids[order], scores[order]
                    if len(order) == k:
                        floor[j] = best[j][-1]
        for j, qid in enumerate(qids):
            if ids[j] is not None:
                yield pd.DataFrame({"query_id": qid, "doc_id": ids[j], "score": best[j]})

    return scan


def _scan_above(qids: np.ndarray, qvecs: np.ndarray, least: float):
    """Scan function: every pair of a partition and one block of queries that scores above ``least``."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), SLICE_ROWS):
                part = pdf.iloc[at : at + SLICE_ROWS]
                grid = np.round(_unit(part["vec"]) @ qvecs.T, SCORE_DIGITS)
                row, column = np.nonzero(grid > least)
                if len(row):
                    doc = _ids(part["doc_id"])
                    yield pd.DataFrame({"query_id": qids[column], "doc_id": doc[row], "score": grid[row, column]})

    return scan


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 10,
                  allowed: DataFrame | None = None) -> DataFrame:
    """Exact inner product on unit vectors, best ``k`` per query.

    ``vectors(doc_id, embedding)``, ``queries(query_id, embedding)``. Filters apply before
    the ranking. The document side is never shuffled: each task multiplies its Arrow
    batches with the query matrix and keeps ``k`` rows per query. The matrix is limited
    to ``BLOCK_ROWS`` queries; a larger query table goes through ``blocked_vector_search``.
    A query or document without a vector meets nothing.
    """
    docs, asked = _vectors(vectors, queries, allowed)
    partial = _scanned(docs, asked, lambda qids, qvecs: _scan_block(qids, qvecs, k))
    return top_k(partial, k).select("query_id", "rank", "doc_id", "score")


def vectors_above(vectors: DataFrame, queries: DataFrame, least: float,
                  allowed: DataFrame | None = None) -> DataFrame:
    """All ``query_id, doc_id, score`` with a score above ``least``; as ``vector_search``, without a top-k."""
    docs, asked = _vectors(vectors, queries, allowed)
    return _scanned(docs, asked, lambda qids, qvecs: _scan_above(qids, qvecs, least))


def _vectors(vectors: DataFrame, queries: DataFrame, allowed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    docs = vectors
    if allowed is not None:
        docs = docs.join(allowed.select("doc_id"), "doc_id", "left_semi")
    return (
        docs.where("embedding IS NOT NULL").select("doc_id", F.col("embedding").alias("vec")),
        queries.where("embedding IS NOT NULL").select("query_id", F.col("embedding").alias("vec")),
    )


def _scanned(docs: DataFrame, asked: DataFrame, scan_of: Callable) -> DataFrame:
    """Rows of ``scan_of(query ids, unit vectors)`` over all documents; one scan while the queries are one block."""
    block = asked.limit(BLOCK_ROWS + 1).toPandas()
    if len(block) > BLOCK_ROWS:
        return _block_pairs(docs, asked, scan_of, BLOCK_ROWS)
    if len(block) == 0:
        none = F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id")
        return docs.where("false").select(none, "doc_id", F.lit(0.0).alias("score"))
    scan = scan_of(_ids(block["query_id"]), _unit(block["vec"]))
    return docs.mapInPandas(scan, _pair_schema(docs, asked))


def _pair_schema(docs: DataFrame, asked: DataFrame) -> str:
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((asked, "query_id"), (docs, "doc_id"))]
    return f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"


def blocked_vector_search(docs: DataFrame, asked: DataFrame, k: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Vector search for a query table of any size.

    Both sides are cut into blocks of about ``rows`` rows by hash; documents are copied once
    per query block and queries once per document block, and each pair of blocks is one
    bounded group that emits at most ``k`` rows per query.
    """
    partial = _block_pairs(docs, asked, lambda qids, qvecs: _scan_block(qids, qvecs, k), rows)
    return top_k(partial, k).select("query_id", "rank", "doc_id", "score")


def _block_pairs(docs: DataFrame, asked: DataFrame, scan_of: Callable, rows: int) -> DataFrame:
    n_docs = max(1, -(-docs.count() // rows))
    n_asked = max(1, -(-asked.count() // rows))
    left = docs.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(n_docs).cast("bigint")).alias("db"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_asked - 1).cast("bigint"))).alias("qb"),
        "doc_id",
        "vec",
    )
    right = asked.select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_docs - 1).cast("bigint"))).alias("db"),
        F.pmod(F.xxhash64("query_id"), F.lit(n_asked).cast("bigint")).alias("qb"),
        "query_id",
        "vec",
    )

    def pair(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        if len(d) == 0 or len(q) == 0:
            return empty
        scan = scan_of(_ids(q["query_id"]), _unit(q["vec"]))
        out = list(scan(iter([d])))
        return pd.concat(out) if out else empty

    return (
        left.groupBy("db", "qb")
        .cogroup(right.groupBy("db", "qb"))
        .applyInPandas(pair, _pair_schema(docs, asked))
    )


# --- fusion and hybrid ---------------------------------------------------------------------
def fuse(lists: list[DataFrame], rrf_k: int = fixed.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: ``(query_id, doc_id, score)``."""
    rows = None
    for ranked in lists:
        part = ranked.select("query_id", "doc_id", "rank")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("query_id", "doc_id").agg(
        F.sum(F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))).alias("score")
    )


def hybrid_search(index: CorpusIndex, vectors: DataFrame, queries: DataFrame, k: int = 10,
                  allowed: DataFrame | None = None, rrf_k: int = fixed.RRF_K,
                  keep: int | None = None) -> DataFrame:
    """Fuse ``3k`` keyword and ``3k`` vector candidates; both sub-scores are kept.

    ``keep`` (default ``k``) is the length of the list handed on, ``2k`` before a rerank.
    """
    words = keyword_search(index, queries, 3 * k, allowed)
    near = vector_search(vectors, queries, 3 * k, allowed)
    step = F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))
    both = words.select(
        "query_id", "doc_id", step.alias("step"), F.col("score").alias("bm25_score"),
        F.lit(None).cast("double").alias("vector_score"),
    ).unionByName(
        near.select(
            "query_id", "doc_id", step.alias("step"), F.lit(None).cast("double").alias("bm25_score"),
            F.col("score").alias("vector_score"),
        )
    )
    fused = both.groupBy("query_id", "doc_id").agg(
        F.sum("step").alias("score"),
        F.max("vector_score").alias("vector_score"),
        F.max("bm25_score").alias("bm25_score"),
    )
    return top_k(fused, keep or k).select(
        "query_id", "rank", "doc_id", "score", "vector_score", "bm25_score"
    )


def overlap_scorer(query: Column, text: Column) -> Column:
    """Built-in pair scorer: share of the query's distinct tokens found in the text."""
    asked = F.array_distinct(T.tokens(query))
    shared = F.size(F.array_intersect(asked, T.tokens(text)))
    return F.coalesce(F.try_divide(shared.cast("double"), F.size(asked)), F.lit(0.0))


def rerank(results: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 10,
           scorer: Callable[[Column, Column], Column] = overlap_scorer) -> DataFrame:
    """Reorder candidates by a pair score; ``score`` stays what it was.

    ``docs(doc_id, text)`` holds the pair text, of any length. ``scorer`` may be a
    pandas UDF; a null score counts as 0.
    """
    found = settle(results.drop("rank"))
    ids = found.select("doc_id").distinct()
    # whole texts stay where they lie; only those of candidates are joined
    held = docs.select("doc_id", F.col("text").alias("_text")).join(
        F.broadcast(ids) if is_small(ids) else ids, "doc_id", "left_semi"
    )
    pairs = found.join(queries.select("query_id", "query"), "query_id").join(held, "doc_id")
    scored = pairs.withColumn(
        "rerank_score", F.coalesce(scorer(F.col("query"), F.col("_text")), F.lit(0.0))
    ).drop("query", "_text")
    return top_k(scored, k, score="rerank_score")


def search(index: CorpusIndex, vectors: DataFrame | None, queries: DataFrame, mode: str = "hybrid",
           k: int = 10, allowed: DataFrame | None = None, rrf_k: int = fixed.RRF_K,
           rerank_docs: DataFrame | None = None,
           scorer: Callable[[Column, Column], Column] = overlap_scorer,
           texts: DataFrame | None = None) -> DataFrame:
    """Search in one mode: ``keyword``, ``vector`` or ``hybrid``; reranked if docs are given.

    Without a vector table, hybrid search is keyword search, and vector search counts the words of
    the query in ``texts(doc_id, text)`` instead; without those it is an error.
    """
    width = 2 * k if rerank_docs is not None else k
    none = F.lit(None).cast("double")
    if mode == "vector" and vectors is None:
        if texts is None:
            raise ValueError("vector search needs vectors, or texts to count words in")
        held = texts if allowed is None else texts.join(allowed.select("doc_id"), "doc_id", "left_semi")
        found = occurrence_search(held, queries, width)
        found = found.withColumn("vector_score", F.col("score")).withColumn("bm25_score", none)
    elif mode == "keyword" or vectors is None:
        found = keyword_search(index, queries, width, allowed)
        found = found.withColumn("vector_score", none).withColumn("bm25_score", F.col("score"))
    elif mode == "vector":
        found = vector_search(vectors, queries, width, allowed)
        found = found.withColumn("vector_score", F.col("score")).withColumn("bm25_score", none)
    elif mode == "hybrid":
        found = hybrid_search(index, vectors, queries, k, allowed, rrf_k, keep=width)
    else:
        raise ValueError(f"unknown mode: {mode}")
    if rerank_docs is None:
        return found
    return rerank(found, queries, rerank_docs, k, scorer)


def search_by_mode(index: CorpusIndex, vectors: DataFrame, queries: DataFrame, k: int = 10,
                   **options) -> DataFrame:
    """Each query names its own mode in a ``mode`` column; three branches, one union."""
    out = None
    for mode in ("hybrid", "vector", "keyword"):
        part = search(index, vectors, queries.where(F.col("mode") == mode), mode, k, **options)
        part = part.withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


# --- counting and field search ------------------------------------------------------------------
def occurrence_search(docs: DataFrame, queries: DataFrame, k: int = 10,
                      constant: bool = True) -> DataFrame:
    """Fallback relevance: how often each query word occurs in the text, repeats added."""
    asked = (
        queries.select("query_id", F.explode(F.split(F.lower("query"), r"\s+")).alias("word"))
        .where("word <> ''")
        .groupBy("query_id", "word")
        .agg(F.count("*").alias("qn"))
    )
    hits = word_hits(docs, ["doc_id"], F.lower("text"), asked, constant=constant)
    scores = (
        hits.join(F.broadcast(asked) if is_small(asked) else asked, "word")
        .groupBy("query_id", "doc_id")
        .agg(F.sum(F.col("hits") * F.col("qn")).cast("double").alias("score"))
    )
    return top_k(scores, k).select("query_id", "rank", "doc_id", "score")


def asked_words(queries: DataFrame) -> DataFrame:
    """``(query_id, word, qn)`` for words longer than two characters."""
    return (
        queries.select("query_id", F.explode(T.query_words("query")).alias("word"))
        .groupBy("query_id", "word")
        .agg(F.count("*").alias("qn"))
    )


def field_scores(pages: DataFrame, queries: DataFrame, weights: dict[str, int],
                 every: dict[str, int] | None = None) -> DataFrame:
    """``(query_id, doc_id, score)``: a word adds a field's weight if the field contains it.

    Array fields count once if any element contains the word; those in ``every`` count
    for each element. All fields go through one matching pass.
    """
    every = every or {}
    types = dict(pages.dtypes)
    parts = None
    for field, weight in {**weights, **every}.items():
        value = F.col(field)
        if types[field].startswith("array") and field in every:
            rows = pages.select("doc_id", F.posexplode(value).alias("item", "text"))
        elif types[field].startswith("array"):
            # a word holds no line break, so it is in an element if it is in the joined text
            rows = pages.select("doc_id", F.lit(0).alias("item"), F.array_join(value, "\n").alias("text"))
        else:
            rows = pages.select("doc_id", F.lit(0).alias("item"), value.alias("text"))
        rows = rows.select(
            "doc_id", "item", F.lit(field).alias("field"), F.lit(weight).alias("weight"),
            F.lower("text").alias("text"),
        )
        parts = rows if parts is None else parts.unionByName(rows)
    asked = asked_words(queries)
    key = ["doc_id", "field", "weight", "item"]
    hits = word_hits(parts.where("text is not null"), key, "text", asked)
    return (
        hits.join(F.broadcast(asked) if is_small(asked) else asked, "word")
        .groupBy("query_id", "doc_id")
        .agg(F.sum(F.col("weight") * F.col("qn")).cast("double").alias("score"))
    )


def field_search(pages: DataFrame, queries: DataFrame, weights: dict[str, int], k: int = 10,
                 every: dict[str, int] | None = None) -> DataFrame:
    return top_k(field_scores(pages, queries, weights, every), k).select(
        "query_id", "rank", "doc_id", "score"
    )


def page_parts(pages: DataFrame) -> DataFrame:
    """``doc_id, ord, item, text``: lower-cased title (0), content (1) and headings (2 on) of ``pages``."""
    return (
        pages.select("doc_id", "ord", F.lit(0).alias("item"), F.lower("title").alias("text"))
        .unionByName(
            pages.select("doc_id", "ord", F.lit(1).alias("item"), F.lower("content").alias("text"))
        )
        .unionByName(
            pages.select("doc_id", "ord", F.posexplode("headings").alias("item", "text")).select(
                "doc_id", "ord", (F.col("item") + 2).alias("item"), F.lower("text").alias("text")
            )
        )
    )


def substring_search(pages: DataFrame | GramIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """First ``k`` pages, in page order, with the whole query in title, content or a heading.

    ``pages(doc_id, ord, title, content, headings)``, or the gram index of their ``page_parts``, which
    answers without reading a text; queries shorter than two characters find nothing.
    """
    asked = queries.where(F.length("query") >= 2).select(
        "query_id", F.lower("query").alias("query")
    )
    if isinstance(pages, GramIndex):
        hits = phrase_texts(pages, asked, ["query_id"], "query")
    else:
        hits = phrase_hits(page_parts(pages), ["doc_id", "ord", "item"], "text", asked, ["query_id"], "query")
    found = hits.select("query_id", "doc_id", "ord").distinct()
    w = Window.partitionBy("query_id").orderBy("ord")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "rank", "doc_id"
    )


def context_search(vectors: DataFrame, pages: DataFrame, queries: DataFrame, k: int = 5,
                   threshold: float = fixed.RELEVANCE_THRESHOLD, enough: int = 3) -> DataFrame:
    """Context for a question: the best vector hits above a threshold, topped up by words.

    Queries with fewer than ``enough`` vector hits also take word hits (title 3, content 1,
    every heading 2) on pages not found yet; all are sorted by score together.
    ``origin`` tells which side a row came from.
    """
    near = vector_search(vectors, queries, k).where(F.col("score") > threshold)
    near = near.select("query_id", "doc_id", "score", F.lit("vector").alias("origin"))
    served = near.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= enough)
    poor = queries.join(served, "query_id", "left_anti")
    words = field_scores(pages, poor, {"title": 3, "content": 1}, {"headings": 2})
    extra = words.join(near, ["query_id", "doc_id"], "left_anti").select(
        "query_id", "doc_id", "score", F.lit("words").alias("origin")
    )
    return top_k(near.unionByName(extra), k).select(
        "query_id", "rank", "doc_id", "score", "origin"
    )


def context_block(columns: list[str]) -> Column:
    """Text of a chunk in a context: header, start of the documentation, signature, fenced content."""

    def held(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in columns else F.lit("")

    place = F.concat(held("path"), F.lit(":"), held("start_line"))
    kind = F.when(held("chunk_type") != "", held("chunk_type")).otherwise("Code")
    named = F.concat(F.lit("### "), kind, F.lit(": "), held("name"), F.lit(" ("), place, F.lit(")"))
    bare = F.concat(F.lit("### "), place, F.lit("-"), held("end_line"))
    said = F.concat(F.lit("\n**Documentation:** "), F.substring(held("documentation"), 1, fixed.DOCUMENTATION_CHARS), F.lit("...\n"))
    signed = F.concat(F.lit("\n**Signature:** `"), held("signature"), F.lit("`\n"))
    return F.concat(
        F.lit("\n"), F.when(held("name") != "", named).otherwise(bare),
        F.when(held("documentation") != "", said).otherwise(""), F.when(held("signature") != "", signed).otherwise(""),
        F.lit("\n```"), held("language"), F.lit("\n"), F.substring(held("content"), 1, fixed.CHARS_PER_CHUNK), F.lit("\n```\n"),
    )


def topic_retrieval(results: DataFrame, chunks: DataFrame, topics: DataFrame,
                    budget: int = fixed.CONTEXT_BUDGET_CHARS) -> DataFrame:
    """Gather several queries' results for one topic, without repeats, up to a text budget.

    ``topics(topic_id, query_id, query_ord)``, ``chunks(doc_id, path, start_line, content)`` and, if there,
    ``end_line, name, chunk_type, documentation, signature, language``. A chunk counts at its first
    appearance; items are taken while the text before them stays within the budget. All that a chunk
    puts into the context counts, its header and fences too (``context_block``).
    """
    sized = chunks.select("doc_id", "path", "start_line", F.length(context_block(chunks.columns)).alias("chars"))
    rows = results.join(topics, "query_id").join(sized, "doc_id")
    first = Window.partitionBy("topic_id", "path", "start_line").orderBy("query_ord", "rank")
    seen = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return within_budget(seen, "topic_id", ["query_ord", "rank"], "chars", budget)


def within_budget(rows: DataFrame, group: str, order: list[str], size: str,
                  budget: int = fixed.CONTEXT_BUDGET_CHARS) -> DataFrame:
    """Keep items while the running size before the item is at most ``budget``."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(
        F.col("before") <= budget
    )


def extractive_answer(context: DataFrame, queries: DataFrame, best: int = 3) -> DataFrame:
    """Answer from the first result: its best sentences by question words, with related titles.

    ``context(query_id, rank, title, content)``. Sentences have 15 to 500 characters; without
    any hit the first two are taken. Everything happens on the row of the first result.
    """
    top = context.where("rank = 1").join(queries.select("query_id", "query"), "query_id")
    related = (
        context.where("rank between 2 and 4")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("r"))
        .select("query_id", F.col("r.title").alias("related"))
    )
    sentences = F.filter(
        F.transform(F.split(T.clean_markdown("content"), r"(?<=[.!?])\s+"), T.strip_ends),
        lambda s: (F.length(s) > 15) & (F.length(s) < 500),
    )
    rows = top.select(
        "query_id", "title", sentences.alias("s"), T.question_words("query").alias("q")
    )

    def answer(sentences: Column, words: Column) -> Column:
        scored = F.transform(
            sentences,
            lambda s, i: F.struct(
                (-F.size(F.filter(words, lambda w: F.contains(F.lower(s), w)))).alias("neg"),
                i.alias("i"),
                s.alias("text"),
            ),
        )
        hits = F.slice(F.array_sort(F.filter(scored, lambda x: x["neg"] < 0)), 1, best)
        return bind(
            hits,
            lambda h: F.when(
                F.size(h) > 0, F.array_join(F.transform(h, lambda x: x["text"]), " ")
            ).otherwise(F.array_join(F.slice(sentences, 1, 2), " ")),
        )

    rows = rows.select(
        "query_id", "title",
        bind(F.struct("s", "q"), lambda v: answer(v["s"], v["q"])).alias("_text"),
    )
    text = F.col("_text")
    ended = F.when((text != "") & ~text.rlike(r"[.!?]$"), F.concat(text, F.lit("."))).otherwise(text)
    return (
        rows.select("query_id", "title", ended.alias("answer"))
        .join(related, "query_id", "left")
        .select("query_id", "answer", F.col("title").alias("source"), "related")
    )
