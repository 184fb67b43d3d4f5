"""Near-duplicates by BagMinHash: weighted Jaccard of multisets of five-word shingles.

Every shingle owns Poisson processes over time, one for each dyadic range of the discretised weights
[0,1), [1,2), [2,4), ...; a point counts if its weight is below how often the shingle occurs. The
earliest point of each of ``M`` bins is the signature, and two texts agree in a bin with the
probability of their weighted Jaccard. Signatures are banded; in a bucket every text is compared with
one head, exactly. Where a bucket still holds texts of several groups, a prefix filter over rare
shingles finds all other pairs that can reach the threshold. Links are closed to classes by rounds of
least labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of, ship, text_key
from corpusloom.session import scratch_path, settle

ship(__name__)

#: Words of a shingle, least similarity; bins, and bands of ROWS bins each. At the threshold a pair
#: shares no band with probability (1 - 0.8 ** 5) ** 32 = 3e-6.
SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
M = BANDS * ROWS
WORD = re.compile(r"[^\W_]+")
_GOLDEN, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and how often each occurs; a shorter text is one shingle, no word none."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    s = np.full(n, np.uint64(min(len(h), SHINGLE)))
    for i in range(min(len(h), SHINGLE)):
        s = mix(s + h[i : i + n] + mix(np.full(1, i, np.uint64)))
    return np.unique(s, return_counts=True)


def bag_signature(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hash of the earliest counted point in each of ``M`` bins."""
    seeds, low, high, most = [keys], [np.zeros(len(keys))], [np.ones(len(keys))], [counts]
    level, start = 1, 1
    while len(more := np.flatnonzero(counts > start)):
        seeds.append(mix(keys[more] + mix(np.full(1, level, np.uint64))))
        low.append(np.full(len(more), float(start)))
        high.append(np.full(len(more), 2.0 * start))
        most.append(counts[more])
        level, start = level + 1, 2 * start
    seed, lo, hi, top = (np.concatenate(x) for x in (seeds, low, high, most))
    rate = M * (hi - lo)
    # within this time every bin is most likely met; if one is not, the time is doubled
    until = (np.log(M) + 3.0) / counts.sum()
    while True:
        usual = until * M  # points of one process within the time
        of, step, at, begun, alive = [], [], [], np.zeros(len(seed)), np.arange(len(seed))
        done, block = 0, 1 if usual < 0.5 else 4 + int(usual / 2)
        while len(alive):
            times = begun[:, None] + np.cumsum(_waits(seed[alive], done, block) / rate[alive, None], axis=1)
            row, column = np.nonzero(times <= until)
            of.append(alive[row])
            step.append(done + column)
            at.append(times[row, column])
            on = times[:, -1] <= until
            begun, alive, done, block = times[on, -1], alive[on], done + block, 4 + int(usual / 2)
        of, step, at = np.concatenate(of), np.concatenate(step), np.concatenate(at)
        mark = mix(mix(seed[of] + (step.astype(np.uint64) + np.uint64(1)) * _GOLDEN) ^ _B)
        weight = lo[of] + (hi[of] - lo[of]) * ((mark & np.uint64(0xFFFFFFFF)) * 2.0**-32)
        counted = weight < top[of]
        bins, at, mark = ((mark >> np.uint64(32)) % np.uint64(M))[counted], at[counted], mark[counted]
        order = np.argsort(at, kind="stable")
        met, place = np.unique(bins[order], return_index=True)
        if len(met) == M:
            return mark[order][place]
        until *= 2


def _waits(seed: np.ndarray, start: int, n: int) -> np.ndarray:
    """Unit exponentials number ``start`` to ``start + n - 1`` of each seed."""
    step = (np.arange(start, start + n, dtype=np.uint64) + np.uint64(1)) * _GOLDEN
    h = mix(seed[:, None] + step[None, :])
    return -np.log1p(-((h >> np.uint64(11)) * 2.0**-53))


def band_hashes(signature: np.ndarray) -> np.ndarray:
    out = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        out = mix(out + signature[i::ROWS] + _GOLDEN)
    return out.view(np.int64)


def overlap(a: tuple, b: tuple) -> float:
    """Weighted Jaccard of two multisets."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def signatures(docs: DataFrame) -> DataFrame:
    """``doc``, ``key``, ``n`` (shingles), ``bands`` of ``doc``, ``key``, ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, 500):
                sizes, bands = [], []
                for text in batch.column(2).to_pylist():
                    keys, counts = shingles(text)
                    sizes.append(int(counts.sum()))
                    bands.append(band_hashes(bag_signature(keys, counts)) if len(keys) else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc", "key", "n", "bands"],
                )

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", "key", "text").mapInArrow(run, f"doc {kind}, key binary, n bigint, bands array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs ``a``, ``b`` whose texts reach the threshold, compared exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for whole in batches:
            for batch in batches_of(whole, 500):
                a, b, one, two = (c.to_pylist() for c in batch.columns)
                good = []
                for i in range(len(a)):
                    if b[i] not in held:
                        held = {b[i]: shingles(two[i])}  # pairs of one head mostly follow each other
                    good.append(overlap(shingles(one[i]), held[b[i]]) >= threshold)
                yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("_one"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("_two"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "_one", "_two")
    return both.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (least node of its component) of all nodes of ``a``, ``b``.

    Each round takes the least label of the neighbours and then the label of that label, so long
    chains halve; it is written to the shared checkpoint folder, and only counts reach the driver.
    """
    both = settle(edges.select("a", "b").unionAll(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        least = labels.join(near, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        heads = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = settle(least.join(heads, "label").select("node", "old", F.least("label", "next").alias("label")))
        changed = moved.where("old <> label").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shingle occurrence: the k-th occurrence of a shingle is an element of its own."""
    for whole in batches:
        for batch in batches_of(whole, 200):
            nodes, found = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, counts = shingles(text)
                many = np.repeat(keys, counts)
                number = np.arange(len(many)) - np.repeat(np.cumsum(counts) - counts, counts)
                found.append(mix(many + number.astype(np.uint64) * _B).view(np.int64))
                nodes.append(np.full(len(many), node))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(nodes)), pa.array(np.concatenate(found))], ["node", "e"]
            )


def prefix_pairs(texts: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """All pairs of different ``label`` in ``groups`` (``node``, ``label``, ``n``) that can reach the threshold.

    Texts of n elements that overlap by the threshold share one of the n - ceil(threshold * n) + 1
    rarest elements of either, whatever passage or boilerplate they have in common beside. What stands
    from the first shared element on bounds the overlap; pairs whose bound is too low are not joined.
    """
    rows = texts.join(groups.select("node"), "node", "left_semi").select("node", "text")
    each = rows.mapInArrow(_elements, "node bigint, e bigint")
    df = each.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    ranked = (
        each.join(df, "e", "left")
        .groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "e"))).alias("es"))
    )
    size = F.size("es")
    first = F.slice("es", F.lit(1), size - F.ceil(threshold * size - 1e-9).cast("int") + 1)
    prefix = settle(
        ranked.select("node", F.posexplode(first).alias("at", "x"))
        .where("x.df > 1")
        .select("node", F.col("x.e").alias("e"), "at")
        .join(groups, "node")
        .select("e", "node", "label", "n", (F.col("n") - F.col("at")).alias("left"))
    )
    mixed = prefix.groupBy("e").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("e")
    open_rows = prefix.join(mixed, "e")
    a, b = (open_rows.select("e", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "n", "left")]) for x in "ab")
    least = threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-6
    fits = (F.col("label_a") < F.col("label_b")) & (F.least("left_a", "left_b") >= least)
    return a.join(b, "e").where(fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """All rows (``doc``, ``key``, ``n``), and the different texts with words: ``key``, ``doc``, ``copies``, ``label``."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")
    )
    path = scratch_path(spark, "signatures")
    signatures(rows).write.parquet(path)
    signed = spark.read.parquet(path)
    some = signed.where("n > 0")
    heads = settle(
        some.groupBy("key", "n").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    # the row of the head stands for all copies: the join is by key and id, so copies don't meet
    of_head = (F.col("key") == F.col("h_key")) & F.col("doc").eqNullSafe(F.col("h_doc"))
    named = heads.select(F.col("key").alias("h_key"), F.col("doc").alias("h_doc"), "node")
    buckets = (
        some.select("doc", "key", "bands").join(named, of_head)
        .select("node", F.explode("bands").alias("bucket"))
    )
    crowded = settle(
        buckets.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("c"))
        .where("lo < hi").select("bucket", "c")
    )
    shared = settle(buckets.join(crowded, "bucket").select("bucket", "node", "c").distinct())
    # the head of a bucket is the text that meets most others in all its buckets: an original before its copies
    met = shared.groupBy("node").agg(F.sum("c").alias("met"))
    heads_of = settle(
        shared.select("bucket", "node").join(met, "node")
        .groupBy("bucket").agg(F.max(F.struct("met", (-F.col("node")).alias("node"))).alias("x"))
        .select("bucket", (-F.col("x.node")).alias("head"))
    )
    members = settle(shared.select("bucket", "node").join(heads_of, "bucket"))
    pairs = members.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    path = scratch_path(spark, "texts")
    needed = named.join(members.select("node").distinct(), "node", "left_semi")
    (
        rows.join(needed, of_head).select("node", "text").groupBy("node").agg(F.first("text").alias("text"))
        .write.parquet(path)
    )
    texts = spark.read.parquet(path)
    links = settle(verified(pairs, texts, threshold).distinct())
    labels = components(links)
    label = F.coalesce("label", "node").alias("label")
    placed = members.join(labels, "node", "left").select("bucket", "node", label)
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    strays = placed.join(mixed.select("bucket"), "bucket").select("node", "label").distinct()
    groups = settle(strays.join(heads.select("node", "n"), "node"))
    more = settle(verified(prefix_pairs(texts, groups, threshold), texts, threshold).distinct())
    if more.limit(1).count():
        labels = components(links.unionAll(more))
    classed = heads.join(labels, "node", "left").select("key", "doc", "copies", label)
    return signed, classed


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document: id, ``class_id`` (least id of its class), ``class_size`` (rows of it).

    Words are runs of letters and digits, lower-cased; a text of fewer than five words is one shingle.
    Equal texts are one class, as are texts joined by a chain of pairs that reach the threshold. Null
    and empty texts and texts without a word have nothing to compare: each row is its own class. A
    repeated row is a member like any other; null ids belong to classes but never name one unless all
    ids are null; an empty table gives none; other columns take no part.
    """
    signed, classed = _classes(docs, id_col, text_col, threshold)
    named_classes = classed.groupBy("label").agg(
        F.min("doc").alias("class_id"), F.sum("copies").alias("class_size")
    )
    by_key = classed.join(named_classes, "label").select("key", "class_id", "class_size")
    alone = signed.where("n = 0").select(
        F.col("doc").alias(id_col), F.col("doc").alias("class_id"), F.lit(1).cast("long").alias("class_size")
    )
    return (
        signed.where("n > 0").select("doc", "key").join(by_key, "key")
        .select(F.col("doc").alias(id_col), "class_id", "class_size")
        .unionAll(alone)
    )


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` with one row of every class: that of the least id (null first), then of the least text key.

    Classes are those of ``near_duplicates``; texts without a word all stay.
    """
    signed, classed = _classes(docs, id_col, text_col, threshold)
    first = classed.groupBy("label").agg(F.min(F.struct("doc", "key")).alias("x")).select("x.*")
    alone = signed.where("n = 0").select("doc", "key").distinct()
    stay = first.withColumn("once", F.lit(True)).unionAll(alone.withColumn("once", F.lit(False)))
    rows = docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("_doc"), text_key(F.col(text_col)).alias("_key")
    )
    met = rows.join(stay, (F.col("_key") == F.col("key")) & F.col("_doc").eqNullSafe(F.col("doc")))
    repeated = met.where("once").groupBy("_key", "_doc").agg(F.first("row").alias("row")).select("row.*")
    return repeated.unionAll(met.where(~F.col("once")).select("row.*"))
