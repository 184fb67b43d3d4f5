"""An index of immutable segments: small commits, a deletion table, merges, and search by blocks with score bounds.

A commit writes what changed as one segment and names the documents of older segments that it
replaces or removes; nothing that was written is touched. The row of ``state`` is written last and
says which segments and deletions are in force, so a commit that was lost leaves the version before.
Segments of one size class are merged once there are ``FAN`` of them, so a document is written
again a logarithmic number of times.

Stored below ``path``, each by segment: ``docs`` (a row per document with its terms),
``blocks`` (up to ``BLOCK`` postings of one term, the best scoring first, with the largest frequency
and the least length in them); by commit: ``deleted`` (documents with the file and row of ``docs`` they lie in).
Terms are counted and dealt to blocks where the documents lie: no text and no posting is exchanged.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import fixed
from corpusloom.functions import text as T
from corpusloom.operators.index import CorpusIndex, _each_token, _stored, _table, text_parts
from corpusloom.operators.search import SCORE_DIGITS, query_terms, top_k
from corpusloom.session import is_light, is_small, settle

# task functions travel with the job, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Segments of one size class that are merged; postings of a block; documents whose postings of one term are ordered together.
FAN, BLOCK, PART_DOCS = 8, 128, 20_000
#: Postings that a task orders together, a part ends with them too; documents and blocks that it takes and gives at once.
PART_POSTINGS, STEP_DOCS, STEP_BLOCKS = 1 << 21, 1000, 8192
K1, B = fixed.BM25_K1, fixed.BM25_B
#: A segment of which a larger share is deleted is written anew.
MOST_DEAD = 0.5
#: Documents whose whole scores set the bound, times k; terms are weak while their best impacts together stay below this share of it.
AHEAD, WEAK = 4, 0.5
STATE = "version int, segments array<struct<id:string,made:bigint,docs:bigint,dl:bigint>>, deleted array<struct<id:string,segments:array<string>>>"


class Segment(NamedTuple):
    """Documents it was made with, and those still in force with their words."""

    id: str
    made: int
    docs: int
    dl: int


class Deletion(NamedTuple):
    """A commit that deleted documents of these segments."""

    id: str
    segments: list[str]


class Version(NamedTuple):
    number: int
    segments: list[Segment]
    deleted: list[Deletion]


@dataclass
class SegmentedIndex(CorpusIndex):
    """``CorpusIndex`` with its ``blocks`` and ``docs`` (``doc_id``, ``dl``, ``terms``), each without deleted documents."""

    blocks: DataFrame | None = None
    docs: DataFrame | None = None
    dead: DataFrame | None = None


def last_version(spark: SparkSession, path: str) -> Version:
    state = _stored(spark, _table(path, "state"))
    row = state.orderBy(F.desc("version")).limit(1).collect() if state is not None else []
    if not row:
        return Version(0, [], [])
    return Version(row[0]["version"], [Segment(*s) for s in row[0]["segments"]], [Deletion(*d) for d in row[0]["deleted"]])


def _commit(spark: SparkSession, path: str, version: Version) -> int:
    held = {s.id for s in version.segments}
    deleted = [d for d in version.deleted if held & set(d.segments)]
    spark.createDataFrame([(version.number, version.segments, deleted)], STATE).coalesce(1).write.mode("append").parquet(_table(path, "state"))
    return version.number


def _parts(spark: SparkSession, path: str, name: str, column: str, ids: list[str]) -> DataFrame:
    """Folders ``column=id`` of a table, the id as a column."""
    root = _table(path, name)
    return spark.read.option("basePath", root).parquet(*[f"{root}/{column}={i}" for i in ids])


def impact(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What an occurrence adds to a score at weight 1: it rises with ``tf`` and falls with ``dl``."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * (dl / avgdl)))


def _ranks(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values in ascending order, and the rank of each."""
    order = pc.sort_indices(values).to_numpy()
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.arange(len(order))
    return order, ranks


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, dl, terms`` of ``doc_id, tokens``: each text's distinct tokens with their counts, in order."""
    for batch in batches:
        tokens = batch.column(1)
        dl = np.diff(tokens.offsets.to_numpy()).astype(np.int64)
        coded = tokens.flatten().dictionary_encode()
        order, ranks = _ranks(coded.dictionary)
        of_text = np.repeat(np.arange(len(dl)), dl)
        key, tf = np.unique((of_text << 32) | ranks[coded.indices.to_numpy()], return_counts=True)
        offsets = np.searchsorted(key >> 32, np.arange(len(dl) + 1)).astype(np.int32)
        term = coded.dictionary.take(pa.array(order[key & 0xFFFFFFFF]))
        entries = pa.StructArray.from_arrays([term, pa.array(tf.astype(np.int64))], ["term", "tf"])
        terms = pa.ListArray.from_arrays(pa.array(offsets), entries)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dl), terms], ["doc_id", "dl", "terms"])


def _block_rows(rows: list[pa.RecordBatch], part: int, avgdl: float, block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the documents ``rows`` (``doc_id, dl, terms``), by term, the largest ``impact`` first."""
    whole = pa.Table.from_batches(rows).combine_chunks()
    ids, dl, terms = (c.chunk(0) for c in whole.columns)
    dl, sizes, flat = dl.to_numpy(), np.diff(terms.offsets.to_numpy()), terms.flatten()
    if not len(flat):
        return
    coded, tf = flat.field("term").dictionary_encode(), flat.field("tf").to_numpy()
    _, ranks = _ranks(coded.dictionary)
    code, doc = coded.indices.to_numpy(), np.repeat(np.arange(len(dl)), sizes)
    gain = (tf * (K1 + 1) / (tf + K1 * (1 - B + B * (dl[doc] / avgdl)))).astype(np.float32)
    # the bits of positive floats are in the order of their values
    order = np.argsort((ranks[code] << 32) | (0xFFFFFFFF - gain.view(np.uint32).astype(np.int64)))
    code, doc, tf = code[order], doc[order], tf[order]
    at = np.arange(len(code))
    begins = np.append(True, code[1:] != code[:-1])
    at -= np.maximum.accumulate(np.where(begins, at, 0))
    starts = np.flatnonzero(at % block == 0)
    ends = np.append(starts, len(code))
    entries = pa.StructArray.from_arrays([ids.take(pa.array(doc)), pa.array(dl[doc]), pa.array(tf)], ["doc_id", "dl", "tf"])
    columns = {
        "term": coded.dictionary.take(pa.array(code[starts])), "part": pa.array(np.full(len(starts), part)),
        "block": pa.array((at[starts] // block).astype(np.int32)), "n": pa.array(np.diff(ends).astype(np.int32)),
        "max_tf": pa.array(np.maximum.reduceat(tf, starts)), "min_dl": pa.array(np.minimum.reduceat(dl[doc], starts)),
        "entries": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries),
    }
    made = pa.RecordBatch.from_pydict(columns)
    for i in range(0, len(made), STEP_BLOCKS):
        yield made.slice(i, STEP_BLOCKS)


def _blocks(avgdl: float, block: int, docs: int, postings: int):
    """Function of batches ``doc_id, dl, terms``: their blocks, in parts of at most about so many documents and postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, n, size = TaskContext.get().partitionId() << 32, [], 0, 0
        step = min(STEP_DOCS, docs)
        for batch in batches:
            for piece in (batch.slice(i, step) for i in range(0, len(batch), step)):
                if rows and (n + len(piece) > docs or size >= postings):
                    yield from _block_rows(rows, part, avgdl, block)
                    part, rows, n, size = part + 1, [], 0, 0
                rows.append(piece)
                n, size = n + len(piece), size + len(piece.column(2).flatten())
        if rows:
            yield from _block_rows(rows, part, avgdl, block)

    return run


def forward_rows(docs: DataFrame, doc_id: str, text: Column | str) -> DataFrame:
    """``doc_id``, ``dl``, ``terms``: one row per document, without terms too.

    A document is counted where it lies. Only if ids are repeated the texts are exchanged, as texts of one id and length are one document.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(T._col(text), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    if rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        schema = f"doc_id {id_type}, dl bigint, terms array<struct<term:string,tf:bigint>>"
        return rows.select("doc_id", T.tokens("text").alias("tokens")).mapInArrow(_count_terms, schema)
    counted = _each_token(rows.repartition(text_parts(rows), "doc_id")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    held = F.when(F.col("term").isNotNull(), F.struct("term", "tf"))
    whole = counted.groupBy("doc_id", "dl").agg(
        F.array_sort(F.collect_list(held)).alias("terms"), F.max(F.when(F.col("term").isNull(), F.col("tf"))).alias("_bare")
    )
    # texts without terms keep a row each
    rows_of = F.array_repeat(F.lit(0), F.coalesce("_bare", F.lit(1)).cast("int"))
    return whole.select("doc_id", "dl", "terms", F.explode(rows_of).alias("_row")).drop("_row")


def _write_segment(forward: DataFrame, path: str) -> Segment | None:
    """Write a segment; None if it would be empty."""
    spark, name = forward.sparkSession, f"s{uuid.uuid4().hex}"
    root = f"{_table(path, 'docs')}/segment={name}"
    forward.select("doc_id", "dl", "terms").write.option("compression", "zstd").parquet(root)
    docs = spark.read.parquet(root)
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
    if not size["n"]:
        return None
    avgdl = max(1.0, size["dl"] / size["n"])
    # few large parts have few first blocks
    tasks = max(size["n"] // PART_DOCS, size["dl"] // PART_POSTINGS)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        "term string, part bigint, block int, n int, max_tf bigint, min_dl bigint, "
        f"entries array<struct<doc_id:{id_type},dl:bigint,tf:bigint>>"
    )
    blocks = docs.coalesce(max(1, tasks)).mapInArrow(_blocks(avgdl, BLOCK, PART_DOCS, PART_POSTINGS), schema)
    blocks.write.option("compression", "zstd").parquet(f"{_table(path, 'blocks')}/segment={name}")
    return Segment(name, size["n"], size["n"], size["dl"])


def _places(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """Documents of segments with the ``file`` and ``row`` they lie in."""
    docs = _parts(spark, path, "docs", "segment", ids)
    return docs.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def _bits(places: DataFrame) -> DataFrame:
    """``segment, file, bits``: a bit for each row of a file, set for those of ``places``; a row per file."""
    words = places.groupBy("segment", "file", F.expr("row div 64").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(row % 64 as int))")).alias("set")
    )
    files = words.groupBy("segment", "file").agg(F.map_from_entries(F.collect_list(F.struct("word", "set"))).alias("m"))
    count = F.array_max(F.map_keys("m"))
    dense = F.transform(F.sequence(F.lit(0), count), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("bigint")))
    return files.select("segment", "file", dense.alias("bits"))


def _at(places: DataFrame, bits: DataFrame, held: bool) -> DataFrame:
    """Rows of ``places`` whose bit is set, or all others. Bits are small and broadcast, so that rows stay where they lie."""
    marked = places.join(F.broadcast(bits), ["segment", "file"], "left")
    bit = F.expr("shiftright(coalesce(get(bits, cast(row div 64 as int)), 0L), cast(row % 64 as int)) & 1L")
    return marked.where(bit == int(held)).drop("bits")


def _live(spark: SparkSession, path: str, version: Version, ids: list[str] | None = None) -> DataFrame:
    """``segment``, ``doc_id``, ``dl``, ``terms``, ``file``, ``row`` of the documents in force."""
    docs = _places(spark, path, ids or [s.id for s in version.segments])
    if not version.deleted:
        return docs
    return _at(docs, settle(_bits(_dead(spark, path, version).select("segment", "file", "row"))), False)


def _dead(spark: SparkSession, path: str, version: Version) -> DataFrame | None:
    if not version.deleted:
        return None
    return _parts(spark, path, "deleted", "commit", [d.id for d in version.deleted])


def _without(rows: DataFrame, dead: DataFrame | None) -> DataFrame:
    if dead is None:
        return rows
    # the ids are hashed; rows are not sorted for them
    return rows.join(F.broadcast(dead) if is_small(dead) else dead.hint("shuffle_hash"), ["segment", "doc_id"], "left_anti")


def commit(
    spark: SparkSession, path: str, changed: DataFrame | None, doc_id: str, text: Column | str = "text",
    removed: DataFrame | None = None,
) -> int:
    """Write a version in which ``changed`` documents replace or extend and ``removed`` go; returns its number.

    The first commit builds the index. Only changed documents are read as text and written; of older
    segments the ids are read, and the terms of those that go. Ids are unique within ``changed`` and
    not null; a removed id that is also changed stays in its new form; unknown ids are passed over.
    """
    was = last_version(spark, path)
    made, gone = None, []
    if changed is not None:
        made = _write_segment(forward_rows(changed, doc_id, text), path)
        if made:
            gone.append(_parts(spark, path, "docs", "segment", [made.id]).select("doc_id"))
    if removed is not None:
        gone.append(removed.select(F.col(doc_id).alias("doc_id")))
    segments, deleted = was.segments, was.deleted
    if gone and segments:
        ids = settle((gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])).distinct())
        # ids meet ids; terms are read by place, and only where others stay
        places = _live(spark, path, was).select("doc_id", "segment", "file", "row", "dl")
        out = settle(places.join(F.broadcast(ids) if is_small(ids) else ids.hint("shuffle_hash"), "doc_id", "left_semi"))
        went = out.groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("dl"))
        less = {r["segment"]: (r["n"], r["dl"]) for r in went.collect()}  # a row per segment
        n, dl = ({i: x[j] for i, x in less.items()} for j in (0, 1))
        segments = [s._replace(docs=s.docs - n.get(s.id, 0), dl=s.dl - dl.get(s.id, 0)) for s in segments]
        thinned = sorted(s.id for s in segments if s.id in less and s.docs > 0)
        if thinned:
            name = f"c{uuid.uuid4().hex}"
            held = _at(_places(spark, path, thinned), settle(_bits(out.where(F.col("segment").isin(thinned)))), True)
            held.select("segment", "doc_id", "dl", F.transform("terms", lambda t: t["term"]).alias("terms"), "file", "row").write.option(
                "compression", "zstd"
            ).parquet(f"{_table(path, 'deleted')}/commit={name}")
            deleted = [*deleted, Deletion(name, thinned)]
    segments = [s for s in segments if s.docs > 0] + ([made] if made else [])
    return _commit(spark, path, Version(was.number + 1, segments, deleted))


def due(version: Version) -> list[str]:
    """Ids of the segments that one merge should join: a full size class, or one that is mostly deleted."""
    classes: dict[int, list[str]] = {}
    for s in version.segments:
        classes.setdefault(int(math.log(max(1, s.docs), FAN)), []).append(s.id)
    for _, ids in sorted(classes.items()):
        if len(ids) >= FAN:
            return ids
    return next(([s.id] for s in version.segments if s.docs < (1 - MOST_DEAD) * s.made), [])


def merge(spark: SparkSession, path: str) -> int:
    """Merge segments as long as ``due`` names some, a commit each; returns the last version's number."""
    while ids := due(was := last_version(spark, path)):
        made = _write_segment(_live(spark, path, was, ids), path)
        kept = [s for s in was.segments if s.id not in ids]
        _commit(spark, path, Version(was.number + 1, kept + ([made] if made else []), was.deleted))
    return was.number


def open_index(spark: SparkSession, path: str) -> SegmentedIndex:
    """The last version. Its tables are those of any index, so every search takes it; statistics are sums over heads of blocks."""
    version = last_version(spark, path)
    if not version.segments:
        raise ValueError(f"no documents in an index at {path}")
    ids = [s.id for s in version.segments]
    dead = _dead(spark, path, version)
    blocks = _parts(spark, path, "blocks", "segment", ids)
    docs = _live(spark, path, version).drop("file", "row")
    terms = blocks.select("term", F.col("n").cast("bigint").alias("df"))
    if dead is not None:
        terms = terms.unionByName(
            dead.where(F.col("segment").isin(ids)).select(F.explode("terms").alias("term"), F.lit(-1).cast("bigint").alias("df"))
        )
    n, dl = sum(s.docs for s in version.segments), sum(s.dl for s in version.segments)
    return SegmentedIndex(
        # from a row per document, so that deletions are looked up once a document and not once a posting
        docs.select("doc_id", "dl", F.inline("terms")),
        terms.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0"),
        docs.select("doc_id", "dl"),
        spark.createDataFrame([(n, dl / n)], "n_docs bigint, avgdl double"),
        blocks=blocks, docs=docs, dead=dead if dead is None else dead.select("segment", "doc_id"),
    )


# --- search -----------------------------------------------------------------------------------------
@dataclass
class Reading:
    """What a search reads: ``first`` and ``kept`` blocks (``n`` postings each), rows of documents ``ahead`` and of ``candidates``."""

    first: DataFrame
    ahead: DataFrame
    kept: DataFrame
    candidates: DataFrame
    weighted: DataFrame


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df) else df


def plan_search(index: SegmentedIndex, queries: DataFrame, k: int = 10) -> Reading:
    """Which blocks and documents can decide the best ``k`` of every query.

    The first blocks of a query's terms give partial sums. Of the documents that lead by them, ``AHEAD`` times k, whole
    scores are summed; the k-th best of those is a score that k documents reach. Terms whose largest impacts together stay
    below ``WEAK`` of it cannot lift a document to it, so documents are sought in the blocks of the others, and
    only in those that, with the best of all other terms, can reach it. What is known of a document
    so found, and the best of what was not read, decides whether it is scored.
    """
    n = index.corpus_stats.select("n_docs").scalar()
    avgdl = index.corpus_stats.select("avgdl").scalar()
    df, least_diff = F.col("df"), 10.0**-SCORE_DIGITS * 2
    weighted = settle(
        query_terms(queries).join(index.term_stats, "term")
        .select("query_id", "term", (F.col("qtf") * F.log((n - df + 0.5) / (df + 0.5) + 1)).alias("weight"))
    )
    met = index.blocks.join(_few(weighted), "term")
    bound = F.col("weight") * impact(F.col("max_tf").cast("double"), F.col("min_dl"), avgdl)
    best = settle(met.groupBy("query_id", "term").agg(F.max(bound).alias("best")))

    def sums(blocks: DataFrame, *more: Column) -> DataFrame:
        each = _without(blocks.select("query_id", "term", "weight", "segment", F.inline("entries"), *more), index.dead)
        part = F.col("weight") * impact(F.col("tf").cast("double"), F.col("dl"), avgdl)
        return each.withColumn("part", part)

    first = met.where("block = 0")
    partial = sums(first).groupBy("query_id", "segment", "doc_id").agg(F.sum("part").alias("score"))
    ahead = settle(top_k(partial, AHEAD * k).select("query_id", "segment", "doc_id"))
    whole = top_k(whole_scores(index, ahead, weighted), k)
    reached = whole.where(F.col("rank") == k).select("query_id", (F.col("score") - least_diff).alias("least"))
    rising = Window.partitionBy("query_id").orderBy("best", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    terms = settle(
        best.join(reached, "query_id", "left")
        .withColumn("least", F.coalesce("least", F.lit(0.0)))
        .withColumn("weak", F.sum("best").over(rising) < WEAK * F.col("least"))
        .withColumn("total", F.sum("best").over(Window.partitionBy("query_id")))
    )
    strong = terms.where(~F.col("weak")).join(weighted, ["query_id", "term"])
    asked = index.blocks.join(_few(strong), "term").withColumn("bound", bound)
    can = F.col("bound") + F.col("total") - F.col("best") >= F.col("least")
    kept = asked.where(can)
    # what a document may still have: the best of a weak term, or of the blocks of a strong one that were left out
    left_out = asked.where(~can).groupBy("query_id", "term").agg(F.max("bound").alias("hidden"))
    hidden = settle(
        terms.join(left_out, ["query_id", "term"], "left")
        .withColumn("hidden", F.when(F.col("weak"), F.col("best")).otherwise(F.coalesce("hidden", F.lit(0.0))))
        .withColumn("rest", F.sum("hidden").over(Window.partitionBy("query_id")))
        .where(~F.col("weak")).select("query_id", "term", "hidden", "rest")
    )
    found = (
        sums(kept.join(_few(hidden), ["query_id", "term"]), F.col("hidden"), F.col("rest"), F.col("least"))
        .groupBy("query_id", "segment", "doc_id")
        .agg((F.sum("part") + F.first("rest") - F.sum("hidden")).alias("most"), F.first("least").alias("least"))
        .where("most >= least")
        .select("query_id", "segment", "doc_id")
    )
    return Reading(first, ahead, kept, settle(found), weighted)


def whole_scores(index: SegmentedIndex, candidates: DataFrame, weighted: DataFrame) -> DataFrame:
    """``query_id``, ``doc_id``, ``score`` of ``candidates`` (``query_id``, ``segment``, ``doc_id``), from the documents' own rows."""
    avgdl = index.corpus_stats.select("avgdl").scalar()
    light = is_light(candidates, F.lit(64))
    rows = index.docs.join(F.broadcast(candidates) if light else candidates, ["segment", "doc_id"])
    each = rows.select("query_id", "doc_id", "dl", F.inline("terms"))
    part = F.col("weight") * impact(F.col("tf").cast("double"), F.col("dl"), avgdl)
    return each.join(_few(weighted), ["query_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def block_search(index: SegmentedIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id``, ``rank``, ``doc_id``, ``score``: the rows of ``keyword_search``, by ``plan_search``.

    Whole scores are summed from the rows of candidates only.
    """
    read = plan_search(index, queries, k)
    scores = whole_scores(index, read.candidates, read.weighted)
    return top_k(scores.where("score > 0"), k).select("query_id", "rank", "doc_id", "score")
