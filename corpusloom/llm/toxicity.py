"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's score is logistic in the words and word beginnings that it holds; a document's score is
the noisy-or of its sentences. Only document labels are learned from; the sentences that carry a
document's score are then located.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of, ship
from corpusloom.session import settle

ship(__name__)

#: The bounds of what is learned from: labelled rows of each class, and features of the model.
TOXIC_ROWS, CLEAN_ROWS, FEATURES = 4000, 6000, 4096
#: A feature must stand in so many different sentences; so copies of a text count once.
LEAST_SENTENCES = 4
SENTENCE = re.compile(r"[^.!?\n|]+")
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6)
#: Words whose weight a task keeps; most words of a large corpus are rare and not worth the memory.
KEPT_WORDS = 50_000
ROUNDS, STEP, DECAY, START_BIAS = 250, 0.1, 1e-3, -5.0


def features(word: str) -> list[str]:
    """The word, and its beginnings marked by a following ``*``."""
    return [word, *[word[:n] + "*" for n in BEGINNINGS if n <= len(word)]]


def sentence_features(sentence: str) -> list[str]:
    return list(dict.fromkeys(f for w in dict.fromkeys(WORD.findall(sentence)) for f in features(w)))


@dataclass
class Model:
    """Weight of each feature and the bias of a sentence; bounded by ``FEATURES``."""

    weights: dict[str, float]
    bias: float


class Weights(dict):
    """Weight of each word, found on first use."""

    def __init__(self, model: Model):
        super().__init__()
        self.of = model.weights

    def __missing__(self, word: str) -> float:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = out = sum(self.of.get(f, 0.0) for f in features(word))
        return out


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    toxic_rows: int = TOXIC_ROWS,
    clean_rows: int = CLEAN_ROWS,
) -> Model:
    """Fit on at most ``toxic_rows`` and ``clean_rows`` labelled rows, whole texts, taken by hash of the id.

    Classes count by their share among all labels. Labels other than 0 and 1, null ids and null or
    empty texts teach nothing; without rows of both classes the model gives every text the bias.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")
    )
    order = [F.xxhash64("_id"), F.col("_id")]
    picked = [
        known.where(F.col("_label") == y).orderBy(*order).limit(n) for y, n in ((1, toxic_rows), (0, clean_rows))
    ]
    sample = picked[0].unionAll(picked[1])  # bounded, so it may be sent to every task
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(
        F.broadcast(sample), F.col("_doc") == F.col("_id")
    )
    cut = settle(
        rows.select("_doc", "_label", "_text").mapInArrow(
            _sentences, "_doc string, _label int, _sentence bigint, _features array<string>"
        )
    )
    totals = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    chosen = _choose(cut, FEATURES)
    names = sorted(r["f"] for r in chosen.collect())
    number = {f: i for i, f in enumerate(names)}
    bags = (
        cut.mapInArrow(_number(number), "_doc string, _label int, _at array<int>")
        .groupBy("_doc", "_label", "_at").agg(F.count("*").alias("_times"))
        .orderBy("_doc", "_label", "_at")
        .toArrow()
    )
    return _fit(bags, names, totals)


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in batches_of(whole, 200):
            out: list[list] = [[], [], [], []]
            for doc, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                for m in SENTENCE.finditer((text or "").lower()):
                    if found := sentence_features(m[0]):
                        for k, v in enumerate((str(doc), label, _hash(m[0]), found)):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()),
                 pa.array(out[3], pa.list_(pa.string()))],
                ["_doc", "_label", "_sentence", "_features"],
            )


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.strip().encode()) - (1 << 63)


def _choose(cut: DataFrame, most: int) -> DataFrame:
    """The features that tell the classes apart best, by their counts over distinct sentences."""
    once = cut.groupBy("_sentence").agg(F.max("_label").alias("y"), F.first("_features").alias("fs"))
    counts = (
        once.select("y", F.explode("fs").alias("f"))
        .groupBy("f")
        .agg(F.sum("y").alias("t"), F.count("*").alias("n"))
        .where(F.col("n") >= LEAST_SENTENCES)
    )
    share = once.agg(F.avg("y").alias("q")).first()["q"] or 0.0
    apart = (F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share) + 1e-9))
    return counts.select("f", F.round(F.abs(apart), 9).alias("z")).orderBy(F.desc("z"), "f").limit(most)


def _number(number: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [[number[f] for f in fs if f in number] for fs in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32()))], ["_doc", "_label", "_at"]
            )

    return run


def _fit(bags, names: list[str], totals: dict[int, int]) -> Model:
    """Adam on the noisy-or likelihood; sentences come in a fixed order, so the sums are fixed as well."""
    label = bags["_label"].to_numpy() == 1
    if label.all() or not label.any():
        return Model({}, START_BIAS)
    times = bags["_times"].to_numpy().astype(np.float64)
    names_of = bags["_doc"].combine_chunks().dictionary_encode()
    doc_of = names_of.indices.to_numpy()
    y = np.zeros(len(names_of.dictionary), bool)
    y[doc_of] = label
    at = bags["_at"].combine_chunks()
    col = at.flatten().to_numpy().astype(np.int64)
    sizes = at.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    weight = np.where(y, totals[1] / max(1, y.sum()), totals[0] / max(1, (~y).sum()))
    weight /= weight.sum()
    w = np.zeros(len(names) + 1)
    w[-1] = START_BIAS
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, ROUNDS + 1):
        z = np.clip(w[-1] + np.bincount(row, w[col], len(sizes)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        s = np.bincount(doc_of, times * np.log1p(np.exp(z)), len(y))
        push = np.where(y, -1 / np.expm1(np.maximum(s, 1e-9)), 1.0) * weight
        g = push[doc_of] * p * times
        grad = np.append(np.bincount(col, g[row], len(names)) + DECAY / 100 * w[:-1], g.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        w -= STEP * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model({n: float(v) for n, v in zip(names, w) if abs(v) > 1e-4}, float(w[-1]))


def score_text(text: str, weights: Weights, bias: float) -> tuple[float, list[tuple[int, int, float]]]:
    """The noisy-or of all sentences, and start, end and score of those at 0.5 or more."""
    clean, found = 0.0, []
    lower = text.lower()
    exact = len(lower) == len(text)  # a few letters change length; their texts are cut unlowered
    for m in SENTENCE.finditer(text):
        words = WORD.findall(lower, m.start(), m.end()) if exact else WORD.findall(m[0].lower())
        z = min(30.0, max(-30.0, bias + sum(map(weights.__getitem__, dict.fromkeys(words)))))
        e = math.exp(z)
        clean -= math.log1p(e)
        if z >= 0:
            found.append((m.start(), m.end(), e / (1 + e)))
    return 0.0 - math.expm1(clean), found


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``score`` (0 to 1) and ``sentences``, the offending ones.

    Only the text is an input. Null and empty texts score 0; repeated rows are scored one by one, an
    empty table gives none, other columns take no part. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(model)
        for whole in batches:
            for batch in batches_of(whole):
                done = [score_text(t or "", weights, model.bias) for t in batch.column(1).to_pylist()]
                spans = [[{"start": a, "end": b, "score": s} for a, b, s in x[1]] for x in done]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([x[0] for x in done], pa.float64()), pa.array(spans, pa.list_(SPAN))],
                    [id_col, "score", "sentences"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, score double, sentences array<struct<start:bigint,end:bigint,score:double>>"
    )


def score_column(model: Model):
    """The score as a function of a text column, for filters; null and empty texts score 0."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = Weights(model)  # one a task: words that were met before are known
        for texts in batches:
            out: list[float] = []
            for start in range(0, len(texts), 200):  # a slice of the texts at a time becomes Python strings
                some = texts.slice(start, 200).to_pylist()
                out += [score_text(t or "", weights, model.bias)[0] for t in some]
            yield pa.array(out, pa.float64())

    def of(text: Column) -> Column:
        return scored(text)

    return of
