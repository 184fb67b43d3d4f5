"""Ranked lexical search by norm buckets: exact top-k of integer term weights.

A document is the vector of what each of its query terms adds to a score, its impacts; a query is the
set of its terms, so a score is an inner product. Vectors are ordered by length and searched in
buckets. A bucket is left out for a query if, by Cauchy-Schwarz, its longest vector cannot reach
the score that the query's k-th best document has already. Inside a bucket the impacts of a few heavy
query terms, with the length of what is left of a vector and the largest impact of every other
term, bound each document's score. Survivors are scored exactly in integers.

Documents are read once for a block of queries, in tasks of any size; queries are held in blocks of
bounded size. Nothing is kept of a document but its query terms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of, ship
from corpusloom.session import scratch_path, with_global_rank

ship(__name__)

TOP = 10
#: Documents of a bucket, and how many of the heaviest terms of a query are looked at before bounds are drawn.
BUCKET, FOCUS = 2000, 6
#: Queries of a block at most, and bytes of their distinct terms (one query may have more).
ITEMS, ITEM_BYTES = 2048, 16 << 20

_BREAK = {*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}
_TABLE = bytes(0x20 if b in _BREAK else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of 0-9, a-z and characters beyond ASCII, after A-Z are lower-cased; null has none."""
    return (text or b"").translate(_TABLE).split()


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def ranked_queries(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``q`` (number of the row from 1), ``item``, ``terms`` (distinct)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole):
                found = [sorted(set(terms_of(t))) for t in as_bytes(batch.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item", "terms"]
                )

    rows = queries.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    kind = rows.schema["item"].dataType.simpleString()
    split = rows.mapInArrow(run, f"item {kind}, terms array<binary>").where(F.size("terms") > 0)
    return with_global_rank(split, [F.col("item"), F.to_json(F.col("terms").cast("array<string>"))], "q")


def query_blocks(ranked: DataFrame) -> Iterator[list]:
    """Blocks of (number, terms) of bounded size, one after the other."""
    total = ranked.count()
    sized = ranked.withColumn("size", F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 50))
    todo = [(lo, min(lo + ITEMS, total + 1)) for lo in range(total // ITEMS * ITEMS + 1, 0, -ITEMS)]
    while todo:
        lo, hi = todo.pop()
        here = sized.where((F.col("q") >= lo) & (F.col("q") < hi))
        if hi - lo > 1 and (here.agg(F.sum("size")).first()[0] or 0) > ITEM_BYTES:
            todo += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
        elif hi > lo:
            yield [(r["q"], r["terms"]) for r in here.orderBy("q").select("q", "terms").collect()]


def store_bags(docs: DataFrame, known, path: str) -> DataFrame:
    """Write ``doc``, ``n`` (all terms), ``terms``, ``tfs`` (those of ``known``, a broadcast term -> number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for whole in batches:
            for batch in batches_of(whole, 500):
                n, at, of = [], [], []
                for text in as_bytes(batch.column(1)):
                    words = terms_of(text)
                    bag = Counter(map(number, words))
                    bag.pop(None, None)
                    n.append(len(words))
                    at.append(list(bag))
                    of.append(list(bag.values()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(of, pa.list_(pa.int64()))],
                    ["doc", "n", "terms", "tfs"],
                )

    kind = docs.schema["doc"].dataType.simpleString()
    docs.mapInArrow(run, f"doc {kind}, n bigint, terms array<int>, tfs array<bigint>").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def lists_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the rows and all values of a list column without nulls."""
    at = column.offsets.to_numpy()
    return at - at[0], column.values.slice(at[0], at[-1] - at[0]).to_numpy()


def store_vectors(bags: DataFrame, weights, n_docs: int, n_terms: int, path: str) -> DataFrame:
    """Write ``doc``, ``norm``, ``terms``, ``impacts`` in the order of falling norm, in as many files as tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            at, terms = lists_of(batch.column(2))
            _, tf = lists_of(batch.column(3))
            m = np.array([10 + 90 * n * n_docs // n_terms for n in batch.column(1).to_pylist()], np.int64)
            row = np.repeat(np.arange(len(m)), np.diff(at))
            impact = w[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
            keep = impact > 0
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(m)))]).astype(np.int32)
            norm = np.sqrt(np.bincount(row, weights=impact.astype(float) ** 2, minlength=len(m)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(norm), pa.ListArray.from_arrays(pa.array(ends), pa.array(terms[keep])),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(impact[keep]))],
                ["doc", "norm", "terms", "impacts"],
            ).filter(pa.array(norm > 0))

    kind = bags.schema["doc"].dataType.simpleString()
    vectors = bags.where(F.size("terms") > 0).mapInArrow(run, f"doc {kind}, norm double, terms array<int>, impacts array<bigint>")
    # copies have one norm; the hash of the id deals them out
    order = [F.desc("norm"), F.xxhash64("doc")]
    vectors.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    return bags.sparkSession.read.parquet(path)


class Block:
    """Queries as sets of term numbers, heaviest term first, and what a task has found for them."""

    def __init__(self, sets: list[np.ndarray], weights: np.ndarray, least: np.ndarray, top: int):
        self.sets = [s[np.argsort(-weights[s], kind="stable")] for s in sets]
        self.flat = np.concatenate(self.sets)
        self.starts = np.concatenate([[0], np.cumsum([len(s) for s in self.sets])[:-1]])
        self.least, self.top = least.astype(float), top
        self.best: list[list] = [[] for _ in sets]
        self.scored = self.bounded = 0

    def search(self, docs: list, norm: np.ndarray, at: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int) -> None:
        """One bucket: vectors by row (``at``, ``terms``, ``impacts``), the longest first."""
        row = np.repeat(np.arange(len(norm)), np.diff(at))
        by = np.argsort(terms, kind="stable")
        column, of, value = np.searchsorted(terms[by], np.arange(n_terms + 1)), row[by], impacts[by]
        most = np.zeros(n_terms)
        np.maximum.at(most, terms, impacts)
        # Cauchy-Schwarz over the terms that the bucket has at all
        held = np.add.reduceat((most > 0)[self.flat].astype(np.int64), self.starts)
        self.bounded += len(norm) * len(self.sets)
        for q in np.flatnonzero((np.sqrt(held) * norm[0] * (1 + 1e-9) >= self.least) & (held > 0)):
            mine = self.sets[q]
            mine = mine[most[mine] > 0]
            focus, rest = mine[:FOCUS], mine[FOCUS:]
            rows = np.concatenate([of[column[t] : column[t + 1]] for t in focus])
            has = np.concatenate([value[column[t] : column[t + 1]] for t in focus]).astype(float)
            part = np.bincount(rows, weights=has, minlength=len(norm))
            left = np.maximum(norm**2 - np.bincount(rows, weights=has**2, minlength=len(norm)), 0)
            bound = part + np.minimum(np.sqrt(len(rest) * left), most[rest].sum())
            who = np.flatnonzero(bound * (1 + 1e-9) + 1e-3 >= self.least[q])
            if len(who):
                self.rescore(q, who, docs, at, terms, impacts, n_terms)

    def rescore(self, q: int, who: np.ndarray, docs: list, at: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int) -> None:
        asked = np.zeros(n_terms, bool)
        asked[self.sets[q]] = True
        sizes = at[who + 1] - at[who]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(at[who] - (ends - sizes), sizes)
        score = np.add.reduceat(np.where(asked[terms[places]], impacts[places], 0), ends - sizes)
        self.scored += len(who)
        good = np.flatnonzero((score > 0) & (score >= self.least[q]))
        if len(good) > self.top:  # ties at the end are decided by id below
            good = good[score[good] >= np.partition(score[good], -self.top)[-self.top]]
        if not len(good):
            return
        new = [(-int(score[i]), docs[who[i]] is None, docs[who[i]]) for i in good]
        self.best[q] = sorted(self.best[q] + new, key=lambda x: x if not x[1] else (x[0], True, 0))[: self.top]
        if len(self.best[q]) == self.top:
            self.least[q] = max(self.least[q], -self.best[q][-1][0])


def search_vectors(vectors: DataFrame, block, top: int) -> DataFrame:
    """``q``, ``doc``, ``score``: the best of each task; ``block`` is a broadcast (numbers, sets, weights, least scores)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, sets, weights, least = block.value
        found = Block(sets, weights, least, top)
        for whole in batches:
            for batch in batches_of(whole, BUCKET):
                at, terms = lists_of(batch.column(2))
                _, impacts = lists_of(batch.column(3))
                found.search(batch.column(0).to_pylist(), batch.column(1).to_numpy(), at, terms, impacts, len(weights))
        rows = [(numbers[q], x[2], -x[0]) for q, best in enumerate(found.best) for x in best]
        q, doc, score = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int64()), pa.array(doc, kind), pa.array(score, pa.int64())], ["q", "doc", "score"]
        )

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(vectors.schema["doc"].dataType)
    name = vectors.schema["doc"].dataType.simpleString()
    return vectors.mapInArrow(run, f"q bigint, doc {name}, score bigint")


def best_of(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def lexical_search(
    docs: DataFrame,
    queries: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_col: str = "item_id",
    query_text_col: str = "text",
    top: int = TOP,
) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score`` of the ``top`` best documents of every query.

    Terms are runs of 0-9, letters and characters beyond ASCII, A-Z lower-cased. With N documents
    that have a term, L terms in all, n of the document, df and tf of a term: w = floor(1000 ln((2N+2)/(2df+1))),
    m = 10 + 90 n N div L, and each distinct query term adds w ((10^9 tf) div (1000 tf + 8 m)). Scores of 0
    are not returned; equal scores stand by ascending id, null ids last. Every row is a document, and every row of
    ``queries`` a query, so repeated rows are ranked and asked again. Null and empty texts have
    no term: such a document is not found and not counted, such a query has no rows. Empty tables
    give no rows; other columns take no part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    ranked = ranked_queries(queries, query_col, query_text_col)
    done, counted = [], None
    for asked in query_blocks(ranked):
        number = {t: i for i, t in enumerate(sorted({bytes(t) for _, terms in asked for t in terms}))}
        known = spark.sparkContext.broadcast(number)
        bags = store_bags(rows, known, scratch_path(spark, "bags"))
        if counted is None:
            counted = bags.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        n_docs, n_terms = counted
        if not n_docs:
            break
        df = np.zeros(len(number), np.int64)
        for r in bags.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
            df[r["t"]] = r["df"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        vectors = store_vectors(bags, spark.sparkContext.broadcast(weights), n_docs, n_terms, scratch_path(spark, "vectors"))
        numbers = [q for q, _ in asked]
        sets = [np.array([number[bytes(t)] for t in terms], np.int64) for _, terms in asked]
        # what the longest vectors score is the least that every task has to reach
        least = np.ones(len(sets), np.int64)
        first = vectors.orderBy(F.desc("norm")).limit(BUCKET)
        block = spark.sparkContext.broadcast((numbers, sets, weights, least))
        for r in best_of(search_vectors(first, block, top), top).where(F.col("rank") == top).collect():
            least[r["q"] - numbers[0]] = r["score"]
        block = spark.sparkContext.broadcast((numbers, sets, weights, least))
        done.append(scratch_path(spark, "found"))
        search_vectors(vectors, block, top).write.parquet(done[-1])
    if not done:
        empty = rows.limit(0).select(F.lit(0).cast("long").alias("q"), "doc", F.lit(0).cast("long").alias("score"))
        found = best_of(empty, top)
    else:
        found = best_of(spark.read.parquet(*done), top)
    return found.join(ranked.select("q", "item"), "q").select(
        F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score"
    )
