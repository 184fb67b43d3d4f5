"""Hard-negative mining: bounds of inner products along spanning trees of the anchors.

Anchors are put into trees of bounded size, each a minimum spanning tree by Euclidean distance. A task
scores its candidates with the root of a tree; along an edge a score changes by at most the edge's length times the
candidate's norm, so the parent's score, or the bounds known of it, bounds the child's.
Only candidates whose bounds overlap what the child still asks for are scored again, exactly in integers. What it
asks for is the window that its positives allow, cut by the worst of the best found so far.

Candidates stay in their partitions; anchors are sent in passes of bounded size, and every task hands on a
bounded number of rows per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm.common import batches_of, ship
from corpusloom.session import scratch_path, settle, with_global_rank

ship(__name__)

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: Negatives stand between these percentages of the positive's score.
LOW, HIGH = 30, 90
#: Anchors of a tree, and bytes of anchor vectors that a task holds at once.
TREE, PASS_BYTES = 1024, 16 << 20
#: Candidates of a batch.
BATCH = 2048
_LEAST, _MOST = -(2**63), 2**63 - 1


def encode(vectors: DataFrame, anchor: Column, label: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id``, ``label``, ``q`` (whole components), ``anchor`` and ``row`` (a number) of all rows that take part."""
    parts = F.col(vector_col)
    whole = ~F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col(id_col).alias("id"), label.cast("long").alias("label"), parts.alias("v"), anchor.alias("anchor"), whole.alias("whole"))
        .where("id is not null and label is not null and v is not null and whole")
        .select("id", "label", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("q"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
        .withColumn("row", F.monotonically_increasing_id())
    )


def matrix(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as 64-bit integers, cut or filled with 0 to one width, and as doubles."""
    at = column.offsets.to_numpy()
    values = column.values.slice(at[0], at[-1] - at[0]).to_numpy()
    at = at - at[0]
    sizes = np.diff(at)
    if (sizes == width).all():
        q = values.reshape(len(sizes), width)
    else:
        q = np.zeros((len(sizes), width), np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(values)) - np.repeat(at[:-1], sizes)
        q[row[place < width], place[place < width]] = values[place < width]
    return q, q.astype(float)


def spanning_trees(anchors: DataFrame, width: int) -> DataFrame:
    """``a``, ``step`` (order in which a tree grows), ``parent`` (null for its root), ``edge`` of anchors ``a``, ``q``."""

    def grow(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        a = group["a"].to_numpy()
        _, x = matrix(group["q"].combine_chunks() if group.num_rows else group["q"].chunk(0), width)
        square = (x * x).sum(1)
        near, via = np.full(len(a), np.inf), np.zeros(len(a), np.int64)
        out, at, is_open = [], 0, np.ones(len(a), bool)
        for step in range(len(a)):
            edge = float(np.sqrt(((x[at] - x[via[at]]) ** 2).sum())) if step else 0.0
            out.append((int(a[at]), step, int(a[via[at]]) if step else None, edge))
            is_open[at] = False
            apart = square - 2 * (x @ x[at]) + square[at]
            closer = is_open & (apart < near)
            near[closer], via[closer] = apart[closer], at
            at = int(np.argmin(np.where(is_open, near, np.inf)))
        return pa.table(dict(zip(("a", "step", "parent", "edge"), map(list, zip(*out)))), pa.schema(
            [("a", pa.int64()), ("step", pa.int64()), ("parent", pa.int64()), ("edge", pa.float64())]))

    trees = anchors.select("a", "q", F.floor((F.col("a") - 1) / TREE).alias("tree"))
    return trees.groupBy("tree").applyInArrow(grow, "a bigint, step bigint, parent bigint, edge double")


class Tree:
    """Anchors in the order of their tree, and what each of them asks for."""

    def __init__(self, a, row, label, q, parent, edge, asked: list[list[tuple[int, int, int]]], same: bool, most: int):
        self.a, self.row, self.label, self.q, self.parent, self.edge = a, row, label, q, parent, edge
        self.x = q.astype(float)
        self.norm = np.sqrt((self.x**2).sum(1))
        self.asked, self.same, self.most = asked, same, most
        self.best: list[list[list]] = [[[] for _ in slots] for slots in asked]
        self.least = [[low for _, low, _ in slots] for slots in asked]

    def exact(self, j: int, q: np.ndarray, x: np.ndarray, safe: bool) -> np.ndarray:
        """Whole scores; those beyond 64 bits stop at the bound."""
        if safe:
            return (x @ self.x[j]).astype(np.int64)
        mine = [int(v) for v in self.q[j]]
        return np.array([min(max(sum(int(v) * w for v, w in zip(r, mine)), _LEAST), _MOST) for r in q], np.int64)

    def search(self, ids: list, row: np.ndarray, label: np.ndarray, q: np.ndarray, x: np.ndarray, norm: np.ndarray) -> int:
        """Take in a batch, sorted by id; returns how many scores were computed."""
        low, high = np.empty((len(self.a), len(ids))), np.empty((len(self.a), len(ids)))
        longest, scored = norm.max(initial=0.0), 0
        for j in range(len(self.a)):
            p, slots = self.parent[j], self.asked[j]
            safe = longest * self.norm[j] < 2.0**52
            # rounding of sums and roots; scores are whole numbers
            spare = 1 + 1e-9 * longest * self.norm[j]
            if p >= 0:
                way = self.edge[j] * norm * (1 + 1e-9)
                np.subtract(low[p], way, out=low[j])
                np.add(high[p], way, out=high[j])
                wanted = (label == self.label[j]) == self.same
                if slots:
                    wanted &= high[j] + spare >= float(min(self.least[j]))
                    wanted &= low[j] - spare <= float(max(s[2] for s in slots))
                who = np.flatnonzero(wanted) if slots else ()
            if p < 0 or 2 * len(who) > len(ids):
                score = self.exact(j, q, x, safe)
                low[j] = high[j] = score
                scored += len(ids)
                who = np.flatnonzero((label == self.label[j]) == self.same)
                score = score[who]
            elif len(who):
                score = self.exact(j, q[who], x[who], safe)
                low[j, who] = high[j, who] = score
                scored += len(who)
            if slots and len(who):
                other = row[who] != self.row[j]
                for s, (_, _, top) in enumerate(slots):
                    self.keep(j, s, ids, who, score, other & (score >= self.least[j][s]) & (score <= top))
        return scored

    def keep(self, j: int, s: int, ids: list, who: np.ndarray, score: np.ndarray, good: np.ndarray) -> None:
        at = np.flatnonzero(good)
        if not len(at):
            return
        # who follows the ids, so a stable order puts the smaller id first
        at = at[np.argsort(-score[at].astype(float) if score[at].min() == _LEAST else -score[at], kind="stable")[: self.most]]
        mine = self.best[j][s] + [(-int(score[i]), ids[who[i]]) for i in at]
        self.best[j][s] = mine = sorted(mine)[: self.most]
        if len(mine) == self.most:
            self.least[j][s] = max(self.least[j][s], -mine[-1][0])


def search(rows: DataFrame, trees, width: int, same: bool, most: int) -> DataFrame:
    """``a``, ``slot``, ``id``, ``score``: the best of each task for all that the trees ask; ``trees`` is a broadcast."""
    kind = to_arrow_type(rows.schema["id"].dataType)
    name = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [Tree(*t, same, most) for t in trees.value]
        for whole in batches:
            for batch in batches_of(whole, BATCH):
                ids = batch.column(0).to_pylist()
                by = sorted(range(len(ids)), key=ids.__getitem__)
                q, x = matrix(batch.column(3), width)
                q, x, norm = q[by], x[by], np.sqrt((x[by] ** 2).sum(1))
                row, label = batch.column(1).to_numpy()[by], batch.column(2).to_numpy()[by]
                for t in mine:
                    t.search([ids[i] for i in by], row, label, q, x, norm)
        found = [
            (int(t.a[j]), slot[0], x[1], -x[0])
            for t in mine for j, slots in enumerate(t.asked) for s, slot in enumerate(slots) for x in t.best[j][s]
        ]
        a, slot, at, score = zip(*found) if found else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(slot, pa.int64()), pa.array(at, kind), pa.array(score, pa.int64())],
            ["a", "slot", "id", "score"],
        )

    return rows.select("id", "row", "label", "q").mapInArrow(run, f"a bigint, slot bigint, id {name}, score bigint")


def passes(anchors: DataFrame, width: int) -> Iterator[list[tuple]]:
    """Trees of a pass: arrays ``a``, ``row``, ``label``, ``q``, ``parent`` (place in the tree or -1), ``edge``."""
    total = anchors.count()
    many = max(1, PASS_BYTES // (8 * max(1, width) * TREE)) * TREE
    for lo in range(1, total + 1, many):
        here = anchors.where((F.col("a") >= lo) & (F.col("a") < lo + many))
        out: dict[int, list] = {}
        for r in here.orderBy("step").select("a", "row", "label", "q", "parent", "edge").collect():
            out.setdefault((r["a"] - 1) // TREE, []).append(r)
        trees = []
        for rows in out.values():
            place = {r["a"]: i for i, r in enumerate(rows)}
            q = np.zeros((len(rows), width), np.int64)
            for i, r in enumerate(rows):
                q[i, : len(r["q"])] = r["q"]
            trees.append((
                np.array([r["a"] for r in rows]), np.array([r["row"] for r in rows]), np.array([r["label"] for r in rows]), q,
                np.array([place.get(r["parent"], -1) for r in rows]), np.array([r["edge"] for r in rows]),
            ))
        yield trees


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | str = "label",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    A component x counts as floor(scale * x); a score is the inner product with the anchor, the larger
    first, equal ones by smaller id. An anchor (``anchor`` is true) has the first ``positives``
    other rows of its label as positives, and for each of them the first ``negatives`` rows of other
    labels whose score lies between ``low`` and ``high`` percent of the positive's.

    Rows with a null id, label, vector or component, or one that is not finite, take no part. Every row
    counts, so a repeated row is a candidate and an anchor of its own; only the anchor's very row is left out. A shorter
    vector ends in zeros, an empty one scores 0. Scores beyond 64 bits stop at the bound.
    A positive with a negative score has no window. Without anchors, positives or negatives there are no rows,
    as for an empty table; other columns take no part.
    """
    spark = vectors.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    path = scratch_path(spark, "vectors")
    encode(vectors, anchor, label, id_col, vector_col, scale).write.parquet(path)
    rows = spark.read.parquet(path)
    named = with_global_rank(rows.where("anchor"), [F.col("label"), F.col("id"), F.col("row")], "a")
    width = named.agg(F.max(F.size("q"))).first()[0] or 0
    anchors = settle(named.join(spanning_trees(named, width), "a"))
    found = {}
    for step, same, most in (("positives", True, positives), ("negatives", False, negatives)):
        paths = []
        for trees in passes(anchors, width):
            ends = [int(t[0].min()) for t in trees], [int(t[0].max()) for t in trees]
            asked: dict[int, list] = {}
            if same:
                asked = {int(a): [(0, _LEAST, _MOST)] for t in trees for a in t[0]}
            else:
                here = found["positives"].where((F.col("a") >= min(ends[0])) & (F.col("a") <= max(ends[1])))
                for r in here.select("a", "rank", "score").collect():
                    window = (r["rank"], -((-low * r["score"]) // 100), high * r["score"] // 100)
                    if window[1] <= window[2]:
                        asked.setdefault(r["a"], []).append(window)
            sent = spark.sparkContext.broadcast([(*t, [asked.get(int(a), []) for a in t[0]]) for t in trees])
            paths.append(scratch_path(spark, step))
            search(rows, sent, width, same, most).write.parquet(paths[-1])
        got = spark.read.parquet(*paths) if paths else rows.limit(0).select(
            *[F.lit(0).cast("long").alias(c) for c in ("a", "slot")], "id", F.lit(0).cast("long").alias("score"))
        order = Window.partitionBy("a", "slot").orderBy(F.desc("score"), "id")
        found[step] = settle(got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most))
    pairs = found["positives"].select("a", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    negative = found["negatives"].select("a", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (
        anchors.select("a", F.col("id").alias("anchor_id"))
        .join(pairs, "a").join(negative, ["a", "slot"])
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
