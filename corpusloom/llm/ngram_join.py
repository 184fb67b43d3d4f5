"""N-gram Jaccard join: links between documents whose sets of word n-grams overlap by a percentage.

The grouped prefix join: n-grams are put in one order, rarest first. Two sets that reach the threshold share one
of the first n - ceil(threshold * n) + 1 n-grams of either, the prefix. Sets with the same prefix and
size are one group; groups are paired through the n-grams of their prefixes, pairs whose sizes and
places bound the overlap too low are dropped, and only then members are expanded and compared exactly.

Equal sets are one node from the start. A cheaper prefix filter comes first, so that frequencies are counted only where
partners are possible: in the order of the n-gram hashes, a set that has a partner shares
at least ``k`` of its first n - ceil(threshold * n) + k n-grams with other sets. All filters ask by the last
bits of a hash, few enough to keep the exchanges small and, as they follow the number of n-grams, enough to
tell nearly all apart; n-grams taken for one only let more pairs through to the comparison of whole hashes.

Members of a group, and groups of one list, are first compared with one head; who stands in one
component already needs no further comparison, so a large family of near copies costs a comparison
per member. All pairs of different components that the filters leave are compared after that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of, ship
from corpusloom.llm.minhash import components, mix
from corpusloom.session import is_small, scratch_path, settle

ship(__name__)

#: Words of an n-gram, least overlap of a link in percent of the union, and by how many percent of its
#: n-grams the first filter looks beyond the prefix.
GRAM, PERCENT, BEYOND = 4, 85, 10
#: Numbers (16 bytes a row) that a scan takes along to find its rows; more are joined.
IDS_SENT = 500_000
#: Of so many n-grams that differ one is taken for another by the filters.
APART = 128
_STEP = 0x9E3779B97F4A7C15


def grams(text: bytes, size: int = GRAM) -> np.ndarray:
    """Distinct hashes of all runs of ``size`` words, ascending; fewer words are one run, no word none.

    Words are runs without ASCII white space, A-Z lower-cased.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(h))
    n = len(h) - size + 1
    s = np.full(n, size, np.uint64)
    for i in range(size):
        s = mix(s + h[i : i + n] + np.uint64((_STEP * (i + 1)) % 2**64))
    return np.unique(s)


def least_overlap(n: int, percent: int) -> int:
    """No partner of a set of ``n`` shares fewer."""
    return -(-percent * n // 100)


def beyond(n: int) -> int:
    return max(1, n * BEYOND // 100)


def first_grams(s: np.ndarray, percent: int) -> np.ndarray:
    """The prefix in hash order, extended so that a pair shares ``beyond`` of the smaller set."""
    n = len(s)
    return s[: n - least_overlap(n, percent) + beyond(n)]


def needed(n: int, percent: int) -> int:
    """How many n-grams of ``first_grams`` a set shares with any partner: the smallest one counts."""
    return beyond(least_overlap(n, percent))


def _as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def signed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``doc``, ``row`` (a number for id and text), ``key`` (of the whole set), ``n``, ``need``, ``first`` of ``doc``, ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, 500):
                keys, n, need, first = [], [], [], []
                for text in _as_bytes(batch.column(2)):
                    s = grams(text or b"", size)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    n.append(len(s))
                    need.append(needed(len(s), percent) if len(s) else 0)
                    first.append(first_grams(s, percent).view(np.int64) if len(s) else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(n, pa.int64()),
                     pa.array(need, pa.int64()), pa.array(first, pa.list_(pa.int64()))],
                    ["doc", "row", "key", "n", "need", "first"],
                )

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", F.xxhash64("doc", "text").alias("row"), "text").mapInArrow(
        run, f"doc {kind}, row bigint, key binary, n bigint, need bigint, first array<bigint>"
    )


def whole_sets(docs: DataFrame, size: int) -> DataFrame:
    """``node``, ``n``, ``grams`` of ``node``, ``n``, ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, 500):
                sets = [grams(t or b"", size).view(np.int64) for t in _as_bytes(batch.column(2))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], ["node", "n", "grams"]
                )

    return docs.select("node", "n", "text").mapInArrow(run, "node bigint, n bigint, grams array<bigint>")


def sent(few: DataFrame) -> DataFrame:
    """Marked for broadcast if it has no more than ``IDS_SENT`` rows."""
    return F.broadcast(few) if is_small(few, IDS_SENT) else few


def short(hashes: str, mask: int) -> Column:
    return F.transform(hashes, lambda e: e.bitwiseAND(F.lit(mask)))


def with_partners(firsts: DataFrame, mask: int) -> DataFrame:
    """``node``, ``n``, ``row`` of the ``firsts`` that share enough of ``first`` with others to have a partner."""
    each = firsts.select("node", F.explode(short("first", mask)).alias("e"))
    met = each.groupBy("e").agg(F.count("*").alias("c")).where("c > 1").select("e")
    shared = each.join(met, "e").groupBy("node").agg(F.count("*").alias("shares"))
    return shared.join(firsts.select("node", "n", "need", "row"), "node").where("shares >= need").select("node", "n", "row")


def prefixes(sets: DataFrame, percent: int, mask: int) -> DataFrame:
    """``sets`` (``node``, ``n``, ``grams``) with ``alone`` and ``prefix``, for those that can have a partner.

    The order is by frequency, then hash. N-grams of one set alone come first in it; they take up
    ``alone`` places of the prefix and are not listed.
    """
    each = sets.select("node", F.explode(short("grams", mask)).alias("e"))
    df = each.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    ranked = (
        each.join(df, "e")
        .groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("common"))
    )
    least = F.ceil(F.col("n") * percent / 100).cast("int")
    alone = F.col("n").cast("int") - F.size("common")
    length = F.col("n").cast("int") - least + 1 - F.col("alone")
    return (
        sets.select("node", "n")
        .join(ranked, "node")
        .withColumn("alone", alone)
        .where(length > 0)
        .select("node", "n", "alone", F.transform(F.slice("common", F.lit(1), length), lambda x: x["e"]).alias("prefix"))
    )


def enough(left_a: Column, left_b: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether as many n-grams as stand from here on can be the overlap of a link."""
    return (100 + percent) * F.least(left_a, left_b) >= percent * (n_a + n_b)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the node pairs ``a``, ``b`` whose whole sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, 500):
                one, two = batch.column(2), batch.column(3)
                good = []
                for i in range(batch.num_rows):
                    x, y = one[i].values.to_numpy(), two[i].values.to_numpy()
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= percent * (len(x) + len(y) - both))
                yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    asked = sent(settle(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    held = sets.join(asked, "node", "left_semi")
    left = held.select(F.col("node").alias("a"), F.col("grams").alias("one"))
    right = held.select(F.col("node").alias("b"), F.col("grams").alias("two"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "one", "two")
    return both.mapInArrow(run, "a bigint, b bigint")


def head_pairs(lists: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Every member with the head of its group, and with the heads of the lists that its group stands in.

    The head of a list is the group that meets most others in all its lists: an original before its copies.
    """
    size = lists.groupBy("e").agg(F.count("*").alias("c")).where("c > 1")
    open_lists = settle(lists.join(size, "e"))
    met = open_lists.groupBy("g").agg(F.sum("c").alias("met"))
    heads = (
        open_lists.join(met, "g")
        .groupBy("e")
        .agg(F.max(F.struct("met", (-F.col("g")).alias("h"), F.col("n").alias("n_h"), F.col("left").alias("left_h"))).alias("x"))
        .select("e", (-F.col("x.h")).alias("h"), "x.n_h", "x.left_h")
    )
    group_pairs = (
        open_lists.join(heads, "e")
        .where((F.col("g") != F.col("h")) & enough(F.col("left"), F.col("left_h"), F.col("n"), F.col("n_h"), percent))
        .select("g", "h")
        .distinct()
    )
    # a group is named after its first node, which is its head
    with_heads = members.join(group_pairs, "g").select(F.col("node").alias("a"), F.col("h").alias("b"))
    inside = members.where("node <> g").select(F.col("node").alias("a"), F.col("g").alias("b"))
    return with_heads.unionAll(inside)


def open_pairs(lists: DataFrame, members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All member pairs of different components that sizes and places allow.

    In a list, groups of its most frequent component are paired with the others only, so a large
    family that has become one component is not paired with itself.
    """
    placed = settle(
        members.join(labels, "node", "left").select("node", "g", F.coalesce("label", "node").alias("label"))
    )
    # a group of several components meets everybody, itself too
    groups = placed.groupBy("g").agg(
        F.when(F.min("label") == F.max("label"), F.min("label")).otherwise(-1 - F.col("g")).alias("of")
    )
    rows = settle(lists.join(groups, "g"))
    main = (
        rows.groupBy("e", "of").agg(F.count("*").alias("c"))
        .groupBy("e").agg(F.max(F.struct("c", "of")).alias("x"), F.count("*").alias("kinds"))
        .where("kinds > 1").select("e", F.col("x.of").alias("main"))
    )
    rest = rows.join(main, "e").where("of <> main").select(
        "e", F.col("g").alias("a"), F.col("n").alias("n_a"), F.col("left").alias("left_a"), F.col("of").alias("of_a")
    )
    fits = enough(F.col("left_a"), F.col("left"), F.col("n_a"), F.col("n"), percent)
    pairs = (
        rest.join(rows, "e")
        .where((F.col("of_a") != F.col("of")) & fits)
        .select(F.least("a", "g").alias("a"), F.greatest("a", "g").alias("b"))
    )
    mixed = groups.where("of < 0").select(F.col("g").alias("a"), F.col("g").alias("b"))
    one, two = (placed.select(F.col("g").alias(x), F.col("node").alias(f"node_{x}"), F.col("label").alias(f"label_{x}")) for x in "ab")
    return (
        pairs.unionAll(mixed).distinct()
        .join(one, "a").join(two, "b")
        .where("label_a <> label_b and (a <> b or node_a < node_b)")
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    )


def ngram_links(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = GRAM, percent: int = PERCENT
) -> DataFrame:
    """One row per document: id, ``n_shingles`` (size of its set), ``component_id`` (least id that links reach).

    Words are runs without ASCII white space, A-Z lower-cased; the set holds the distinct runs of
    ``size`` words, and a text of fewer words is one run. Two documents link when their
    overlap is at least ``percent`` of their union; equal sets always do. Null texts and texts
    without a word have an empty set and link with nothing, not even each other: each row is its own component.
    Repeated rows have a row each, of one component. A null id belongs to a component like any other
    but names one only if all its ids are null. An empty table gives no row; other columns take no part.
    N-grams are told apart by 64 bits of hash, whole sets by 128.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    path = scratch_path(spark, "ngrams")
    signed(rows, size, percent).write.parquet(path)
    all_rows = spark.read.parquet(path)
    some = all_rows.where("n > 0")
    total = some.agg(F.sum("n")).first()[0] or 0
    mask = 2 ** min(62, (APART * total).bit_length()) - 1
    nodes = settle(
        some.groupBy("key").agg(F.min("doc").alias("doc"), F.min("row").alias("row"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    # one row stands for all of its set; whole sets are made again only where partners are possible
    firsts = some.drop("doc", "key").dropDuplicates(["row"]).join(nodes.select("row", "node"), "row")
    found = settle(with_partners(firsts, mask))
    texts = rows.withColumn("row", F.xxhash64("doc", "text")).join(sent(found), "row")
    path = scratch_path(spark, "ngram-sets")
    whole_sets(texts, size).write.parquet(path)
    sets = spark.read.parquet(path)
    if sets.count() > found.count():  # a row that is repeated
        sets = settle(sets.dropDuplicates(["node"]))
    placed = settle(prefixes(sets, percent, mask).withColumn("same", F.sha2(F.to_json(F.struct("n", "alone", "prefix")), 256)))
    groups = placed.groupBy("same").agg(F.min("node").alias("g"))
    members = settle(placed.select("node", "same").join(groups, "same").select("node", "g"))
    lists = settle(
        placed.join(groups.select("g"), placed["node"] == F.col("g"), "left_semi")
        .select(F.col("node").alias("g"), "n", "alone", F.posexplode("prefix").alias("at", "e"))
        .select("e", "g", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("left"))
    )
    links = settle(verified(head_pairs(lists, members, percent).distinct(), sets, percent))
    labels = components(links)
    more = settle(verified(open_pairs(lists, members, labels, percent), sets, percent))
    if more.limit(1).count():
        labels = components(links.unionAll(more))
    classed = nodes.select("key", "doc", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = classed.groupBy("label").agg(F.min("doc").alias("component_id"))
    by_key = classed.join(least, "label").select("key", "component_id")
    out = [F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id"]
    alone = all_rows.where("n = 0").withColumn("component_id", F.col("doc"))
    return some.select("doc", "n", "key").join(by_key, "key").select(*out).unionAll(alone.select(*out))
