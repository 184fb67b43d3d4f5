"""Exact vector search over blocks with bounds: whole blocks are left out by the triangle inequality of angles.

Vectors are dealt once to the nearest of a bounded number of centres, which are fitted on a bounded
sample; a block knows the least and the largest angle between its vectors and its centre. A query
that stands at angle ``a`` from the centre cannot come nearer to any of them than the difference of the angles. Every
query first searches the blocks that promise most; what its k-th best scores there decides which others are read.
Queries travel in blocks of bounded size, documents are never moved.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.index import _stored, _table
from corpusloom.operators.search import BLOCK_ROWS, SCORE_DIGITS, SLICE_ROWS, _best_first, _ids, _pair_schema, _unit, top_k

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Centres at most, vectors that they are fitted on, and rounds of the fit.
CENTRES, SAMPLE, ROUNDS = 4096, 20_000, 4
#: Block of zero vectors, which score 0 with everything; spare angle for rounding.
ZERO, SPARE = -1, 1e-6


@dataclass
class BallIndex:
    """``vectors(block, doc_id, embedding)`` ordered by block, and ``heads(block, centre, low, high, n)``, one row per block."""

    vectors: DataFrame
    heads: DataFrame


def fit_centres(sample: np.ndarray, many: int) -> np.ndarray:
    """Unit centres of the unit vectors in ``sample``: spherical k-means from evenly spaced rows."""
    centres = sample[np.linspace(0, len(sample) - 1, min(many, len(sample))).astype(int)]
    for _ in range(ROUNDS):
        of = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 1e-12, sums / np.where(length > 1e-12, length, 1), centres)
    return centres


def save_balls(vectors: DataFrame, path: str, centres: int | None = None) -> None:
    """Write the index of ``vectors(doc_id, embedding)``; rows without a vector are left out, copies stay.

    The centres come from the ``SAMPLE`` vectors of the least hash; every vector is indexed. Heads are
    written last and complete it.
    """
    spark = vectors.sparkSession
    rows = vectors.where("embedding IS NOT NULL").select("doc_id", "embedding")
    total = rows.count()
    many = centres or min(CENTRES, max(1, math.isqrt(total)))
    picked = rows.orderBy(F.xxhash64("doc_id")).limit(min(SAMPLE, max(1, total))).select("embedding").toPandas()
    unit = _unit(picked["embedding"]) if len(picked) else np.zeros((0, 1))
    unit = unit[(unit != 0).any(axis=1)]
    middle = fit_centres(unit, many) if len(unit) else unit

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), SLICE_ROWS):
                part = pdf.iloc[at : at + SLICE_ROWS].copy()
                x = _unit(part["embedding"])
                near = x @ middle.T if len(middle) else np.zeros((len(x), 1))
                bare = ~(x != 0).any(axis=1) | (not len(middle))
                part["block"] = np.where(bare, ZERO, near.argmax(axis=1))
                part["angle"] = np.where(bare, 0.0, np.arccos(np.clip(near.max(axis=1), -1, 1)))
                yield part[["block", "angle", "doc_id", "embedding"]]

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("doc_id", "embedding")}
    dealt = rows.mapInPandas(deal, f"block int, angle double, doc_id {kinds['doc_id']}, embedding {kinds['embedding']}")
    order = [F.col("block"), F.xxhash64("doc_id")]
    dealt.repartitionByRange(*order).sortWithinPartitions("block").write.parquet(_table(path, "vectors"))
    ends = spark.read.parquet(_table(path, "vectors")).groupBy("block").agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")
    )
    named = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(middle)] or [(ZERO, [])], "block int, centre array<double>")
    ends.join(named, "block", "left").write.parquet(_table(path, "heads"))


def load_balls(spark: SparkSession, path: str) -> BallIndex:
    heads = _stored(spark, _table(path, "heads"))
    if heads is None:
        raise ValueError(f"no complete vector index at {path}")
    return BallIndex(spark.read.parquet(_table(path, "vectors")).select("block", "doc_id", "embedding"), heads)


def bounds(heads: list, q: np.ndarray) -> np.ndarray:
    """Largest possible score of each block (row) for each unit query (column)."""
    out = np.zeros((len(heads), len(q)))
    live = (q != 0).any(axis=1)
    for i, h in enumerate(heads):
        if h["block"] != ZERO:
            apart = np.arccos(np.clip(q @ np.asarray(h["centre"]), -1, 1))
            gap = np.maximum(np.maximum(apart - h["high"], h["low"] - apart) - SPARE, 0)
            out[i] = np.where(live, np.cos(np.minimum(gap, math.pi)), 0.0)
    return out


def _scan(qids: np.ndarray, q: np.ndarray, k: int, asked: dict[int, np.ndarray]):
    """Scan function: scores each block with the queries that ask for it, keeps k per query."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: dict[int, np.ndarray] = {}
        best: dict[int, np.ndarray] = {}
        for pdf in batches:
            for block, rows in pdf.groupby("block", sort=False):
                mine = asked.get(int(block))
                for at in range(0, len(rows) if mine is not None else 0, SLICE_ROWS):
                    part = rows.iloc[at : at + SLICE_ROWS]
                    doc = _ids(part["doc_id"])
                    grid = np.round(_unit(part["embedding"]) @ q[mine].T, SCORE_DIGITS)
                    for column, j in enumerate(mine.tolist()):
                        score = grid[:, column]
                        if j in best:
                            reached = score >= best[j][-1] if len(best[j]) == k else np.ones(len(score), bool)
                            if not reached.any():
                                continue
                            all_ids, score = np.concatenate([ids[j], doc[reached]]), np.concatenate([best[j], score[reached]])
                        else:
                            all_ids = doc
                        order = _best_first(all_ids, score)[:k]
                        ids[j], best[j] = all_ids[order], score[order]
        for j in best:
            yield pd.DataFrame({"query_id": qids[j], "doc_id": ids[j], "score": best[j]})

    return scan


def _query_blocks(queries: DataFrame) -> Iterator[pd.DataFrame]:
    """Query vectors in blocks of at most about ``BLOCK_ROWS``, dealt by hash."""
    asked = queries.where("embedding IS NOT NULL").select("query_id", "embedding")
    parts = 1 + asked.count() // BLOCK_ROWS
    for i in range(parts):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).toPandas()
        if len(block):
            yield block


def ball_search(index: BallIndex, queries: DataFrame, k: int = 10, report: list | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``doc_id``, ``score``: the rows of ``vector_search``.

    ``report`` gets, for each block of queries, how many (query, vector) pairs were scored and how many a full scan scores.
    """
    heads = sorted(index.heads.collect(), key=lambda h: h["block"])  # ``CENTRES`` rows at most
    sizes = np.array([h["n"] for h in heads], dtype="int64")
    found = None
    for block in _query_blocks(queries):
        qids, q = _ids(block["query_id"]), _unit(block["embedding"])
        most = bounds(heads, q)

        def searched(wanted: np.ndarray) -> DataFrame:
            asked = {heads[i]["block"]: np.flatnonzero(wanted[i]) for i in range(len(heads)) if wanted[i].any()}
            rows = index.vectors.where(F.col("block").isin([int(b) for b in asked]))
            scan = _scan(qids, q, k, asked)
            return rows.mapInPandas(scan, _pair_schema(rows, queries))

        # the blocks that promise most, until they hold k vectors
        order = np.argsort(-most, axis=0, kind="stable")
        before = np.cumsum(sizes[order], axis=0) - sizes[order]
        first = np.zeros_like(most, dtype=bool)
        np.put_along_axis(first, order, before < k, axis=0)
        least = np.full(len(q), -np.inf)
        place = {qid: j for j, qid in enumerate(qids.tolist())}
        for r in top_k(searched(first), k).where(F.col("rank") == k).select("query_id", "score").collect():
            least[place[r["query_id"]]] = r["score"]
        wanted = most >= least - 10.0**-SCORE_DIGITS
        if report is not None:
            report.append((int((wanted * sizes[:, None]).sum()), int(sizes.sum()) * len(q)))
        part = searched(wanted)
        found = part if found is None else found.unionAll(part)
    if found is None:
        none = F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id")
        found = index.vectors.where("false").select(none, "doc_id", F.lit(0.0).alias("score"))
    return top_k(found, k).select("query_id", "rank", "doc_id", "score")
