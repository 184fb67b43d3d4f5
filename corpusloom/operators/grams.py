"""Positional gram index: substring search that reads postings of a few rare grams and no text.

Every position of a text has the gram of ``GRAM`` characters that starts there, shorter at the end. Texts
are indexed in blocks where they lie, without an exchange: the characters of all texts have places in one
row of numbers, with gaps between texts. Stored are, by gram and block, all its places as steps in bytes, and for a block where its texts start. A phrase is
covered by grams that do not overlap, but for the last; its two rarest ones have to stand at their
distance in a text, whatever phrases ask for them, and the others at the same shift. A phrase shorter than a gram is looked up
as the beginning of grams. White space and repeated words are characters like any others.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.index import _stored, _table
from corpusloom.session import is_small, settle, spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM = 3
#: Texts and characters of a block (a longer text is one of its own), and grams that become a filter of the scan.
BATCH_TEXTS, BATCH_CHARS, FILTER_GRAMS = 20_000, 1 << 20, 200
#: Places without a character after a text; a block's number, its first place, is a multiple of BLOCK.
GAP, BLOCK = GRAM - 1, 1 << 16
#: Bytes of places read at once, ranges that tasks know while reading, bits of a place in its piece.
PLACES, RANGES, PIECE = 1 << 18, 1_000_000, 9


@dataclass
class GramIndex:
    """``postings(gram, block, n, m, steps)``, the last as bytes; ``grams(gram, df)``; ``texts(*keys, _start, _end)``."""

    postings: DataFrame
    grams: DataFrame
    texts: DataFrame
    keys: list[str]


def to_bytes(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Numbers from 0 as binaries of seven bits a byte, low ones first; ``bounds`` cut them into rows."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= 1 << bits
    ends = np.append(0, np.cumsum(size))
    out = np.zeros(ends[-1], np.uint8)
    for k in range(5):
        some = np.flatnonzero(size > k)
        out[ends[some] + k] = ((values[some] >> (7 * k)) & 127) | np.where(size[some] > k + 1, 128, 0)
    offsets = pa.py_buffer(ends[bounds].astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(out)])


def from_bytes(rows: pa.Array) -> np.ndarray:
    """All numbers of ``to_bytes``, row after row."""
    code = np.frombuffer(b"".join(rows.to_pylist()), np.uint8).astype(np.int64)
    ends = np.flatnonzero(code < 128)
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    out, size = np.zeros(len(ends), np.int64), ends - starts + 1
    for k in range(5):
        some = np.flatnonzero(size > k)
        out[some] |= (code[starts[some] + k] & 127) << (7 * k)
    return out


def block_grams(texts: list[str], starts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, pa.Array]:
    """Distinct grams of the texts; for each, how many texts and places it has, and the steps from place to place."""
    codes, gap = [], np.zeros(GAP, np.int64)  # 0 stands behind the end
    for text in texts:
        codes += [np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1, gap]
    code = np.concatenate([*codes, gap])
    size = len(code) - GAP
    whole = np.zeros(size, np.int64)
    for i in range(GRAM):
        whole = (whole << 21) | code[i : i + size]
    at = np.flatnonzero(code[:size])
    at = at[np.argsort(whole[at], kind="stable")]
    gram, of = whole[at], np.searchsorted(starts, at, "right") - 1
    new_gram = np.diff(gram, prepend=-1) != 0
    new_text = new_gram | (np.diff(of, prepend=-1) != 0)
    grams = np.flatnonzero(new_gram)
    names = [texts[of[g]][at[g] - starts[of[g]] : at[g] - starts[of[g]] + GRAM] for g in grams.tolist()]
    steps = np.diff(at, prepend=0)
    steps[grams] = at[grams]
    bounds = np.append(grams, len(at))
    return names, np.diff(np.searchsorted(np.flatnonzero(new_text), bounds)), np.diff(bounds), to_bytes(steps, bounds)


def text_grams(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``gram, block, n, m, steps``: texts and places of a gram in a block; null and empty texts have none.

    The row of a block without a gram has the keys of all its texts and where they start and end.
    """
    rows = texts.select(*keys, F.coalesce(text_col, F.lit("")).alias("_text"))

    def block_of(number: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        texts = whole.column(len(keys)).to_pylist()
        ends = np.cumsum([len(t) + GAP for t in texts])
        starts = np.append(0, ends[:-1])
        names, n, m, steps = block_grams(texts, starts)
        limits = [pa.array(number + starts), pa.array(number + ends - GAP)]
        of_texts = pa.StructArray.from_arrays([*[c.combine_chunks() for c in whole.columns[:-1]], *limits], [*keys, "_start", "_end"])
        kept = pa.ListArray.from_arrays(pa.array([0, len(of_texts)], pa.int32()), of_texts)
        one = [pa.array([None], k) for k in (pa.string(), pa.int32(), pa.int32(), pa.binary())]
        columns = ["gram", "n", "m", "steps", "block", "keys"]
        yield pa.RecordBatch.from_arrays([*one, pa.array([number], pa.int64()), kept], columns)
        of_grams = [pa.array(names, pa.string()), pa.array(n.astype(np.int32)), pa.array(m.astype(np.int32)), steps]
        rest = [pa.array(np.full(len(names), number)), pa.nulls(len(names), kept.type)]
        yield pa.RecordBatch.from_arrays([*of_grams, *rest], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, texts, chars = TaskContext.get().partitionId() << 40, [], 0, 0
        for whole in batches:
            sizes = np.array([len(t) for t in whole.column(len(keys)).to_pylist()], np.int64)
            start = 0
            while start < whole.num_rows:
                room = np.searchsorted(np.cumsum(sizes[start:]), BATCH_CHARS - chars, "right") + 1
                part = whole.slice(start, min(int(room), BATCH_TEXTS - texts))
                held.append(part)
                texts, chars = texts + part.num_rows, chars + int(sizes[start : start + part.num_rows].sum())
                start += part.num_rows
                if texts >= BATCH_TEXTS or chars > BATCH_CHARS:
                    yield from block_of(number, held)
                    number, held, texts, chars = number + (chars + GAP * texts) // BLOCK * BLOCK + BLOCK, [], 0, 0
        if held:
            yield from block_of(number, held)

    kinds = "".join(f"`{f.name}`: {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1]) + "_start: bigint, _end: bigint"
    return rows.mapInArrow(run, f"gram string, n int, m int, steps binary, block bigint, keys array<struct<{kinds}>>")


def save_grams(texts: DataFrame, keys: list[str], text_col: str, path: str) -> None:
    """Write the index of ``texts``, each task the blocks of its own; ``keys`` name a text. The table of grams is last and completes it."""
    postings = _table(path, "postings")
    rows = text_grams(spread(texts, keys[0]), keys, text_col)
    rows.sortWithinPartitions("gram", "block").write.option("compression", "zstd").parquet(postings)
    written = texts.sparkSession.read.parquet(postings).where("gram IS NOT NULL")
    written.groupBy("gram").agg(F.sum("n").alias("df")).write.parquet(_table(path, "grams"))


def load_grams(spark: SparkSession, path: str) -> GramIndex:
    grams = _stored(spark, _table(path, "grams"))
    if grams is None:
        raise ValueError(f"no complete gram index at {path}")
    stored = spark.read.parquet(_table(path, "postings"))
    texts = stored.where("gram IS NULL").select(F.inline("keys"))
    keys = [c for c in texts.columns if c not in ("_start", "_end")]
    return GramIndex(stored.where("gram IS NOT NULL").drop("keys"), grams, texts, keys)


def _places(ranges: pa.Table | None):
    """Function from postings to ``gram, _at``, rows of about ``PLACES`` bytes at a time.

    With ``ranges(lo, hi)``, ordered by ``lo``, only places from a ``lo`` to before its ``hi``.
    """
    low, high = (c.to_numpy() for c in ranges.columns) if ranges is not None else [np.zeros(0, np.int64)] * 2
    high = np.append(-1, np.maximum.accumulate(high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            parts = np.cumsum(pc.binary_length(whole.column(3)).to_numpy()) // PLACES
            starts = np.flatnonzero(np.diff(parts, prepend=-1))
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), whole.num_rows]):
                batch = whole.slice(start, end - start)
                m = batch.column(2).to_numpy()
                row = np.repeat(np.arange(len(m)), m)
                total = np.cumsum(from_bytes(batch.column(3)))
                before = np.append(0, total[np.cumsum(m) - 1])[:-1]  # steps begin anew with each row
                at = total - before[row] + batch.column(1).to_numpy()[row]
                if ranges is not None:
                    kept = high[np.searchsorted(low, at, "right")] > at
                    row, at = row[kept], at[kept]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(at)], ["gram", "_at"])

    return run


def _of_grams(index: GramIndex, grams: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """``gram, _at``: places of ``grams``, a few of which reach the scan as a filter.

    With ``ranges(lo, hi)`` at least those in them: up to ``RANGES`` are known to the tasks, with more all are read.
    """
    few = grams.select("gram").distinct().limit(FILTER_GRAMS + 1).collect()
    postings, known = index.postings, None
    if len(few) <= FILTER_GRAMS:
        postings = postings.where(F.col("gram").isin([r["gram"] for r in few]))
    else:
        postings = _met(postings, grams.select("gram").distinct(), ["gram"])
    if ranges is not None and is_small(ranges, RANGES):
        known = ranges.select("lo", "hi").orderBy("lo").toArrow()
    rows = postings.select("gram", "block", "m", "steps")
    return rows.mapInArrow(_places(known), "gram string, _at bigint")


def _met(many: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    return many.join(F.broadcast(few) if is_small(few) else few, on)


def phrase_places(index: GramIndex, phrases: DataFrame, phrase_key: list[str], phrase: str) -> DataFrame:
    """``*phrase_key, *keys, pos``: every place (from 0) of a phrase in a text, overlapping ones too.

    Null and empty phrases stand nowhere; a phrase that is repeated has its places again only under
    another key.
    """
    named = phrases.select(*phrase_key, F.col(phrase).alias("_phrase")).where("_phrase <> ''").distinct()
    asked = settle(named.select("_phrase").distinct().withColumn("_p", F.monotonically_increasing_id()))
    size = F.length("_phrase")
    short = asked.where(size < GRAM)
    heads = None
    for n in range(1, GRAM):
        part = short.where(size == n).join(index.grams, F.substring("gram", 1, n) == F.col("_phrase"))
        heads = part if heads is None else heads.unionAll(part)
    heads = settle(heads.select("_p", "gram"))
    found = _met(_of_grams(index, heads), heads, ["gram"]).select("_p", F.col("_at").alias("_pos"))
    offsets = F.array_distinct(F.concat(F.sequence(F.lit(0), size - GRAM, F.lit(GRAM)), F.array(size - GRAM)))
    parts = (
        asked.where(size >= GRAM)
        .select("*", size.alias("_size"), F.size(offsets).alias("_parts"), F.explode(offsets).alias("_offset"))
        .withColumn("gram", F.substring(F.col("_phrase"), F.col("_offset") + 1, F.lit(GRAM)))
        .drop("_phrase")
    )
    # a phrase with a gram that no text has stands nowhere
    of_phrase = Window.partitionBy("_p")
    ranked = settle(
        parts.join(index.grams, "gram")
        .withColumn("_known", F.count("*").over(of_phrase))
        .where(F.col("_known") == F.col("_parts"))
        .withColumn("_rank", F.row_number().over(of_phrase.orderBy("df", "_offset")))
        .drop("df", "_known")
    )
    rarest = ranked.where("_rank = 1")
    whole = rarest.where("_parts = 1").select("gram", "_p")
    single = _met(_of_grams(index, whole), whole, ["gram"]).select("_p", F.col("_at").alias("_pos"))
    # two grams at their distance come before any phrase: many phrases may share a gram, few share both
    second = ranked.where("_rank = 2").select("_p", F.col("gram").alias("_next"), F.col("_offset").alias("_to"))
    pairs = settle(
        rarest.where("_parts > 1").join(second, "_p")
        .select("_p", "_parts", "_size", "gram", "_offset", "_next", (F.col("_to") - F.col("_offset")).alias("_far"))
    )
    begins = _met(_of_grams(index, pairs), pairs.select("gram", "_far").distinct(), ["gram"]).select(
        (F.col("_at") + F.col("_far")).alias("_to"), "gram", "_far", "_at"
    )
    nexts = _of_grams(index, pairs.select(F.col("_next").alias("gram"))).select(
        F.col("_at").alias("_to"), F.col("gram").alias("_next")
    )
    both = begins.join(nexts, "_to")
    begun = settle(
        _met(both, pairs, ["gram", "_far", "_next"])
        .select("_p", "_parts", "_size", (F.col("_at") - F.col("_offset")).alias("_pos"))
    )
    others = ranked.where("_rank > 2").select("_p", "gram", "_offset")
    wanted = settle(
        _met(begun.where("_parts > 2"), others, ["_p"])
        .select("_p", "_parts", "_pos", "gram", (F.col("_pos") + F.col("_offset")).alias("_at"))
    )
    ranges = settle(
        begun.where("_parts > 2").groupBy(F.col("_pos").alias("lo")).agg(F.max(F.col("_pos") + F.col("_size")).alias("hi"))
    )
    lists = _of_grams(index, wanted, ranges)
    rest = _met(lists, wanted, ["gram", "_at"]).groupBy("_p", "_parts", "_pos").agg(F.count("*").alias("_met"))
    places = (
        found.unionByName(single)
        .unionByName(begun.where("_parts = 2").select("_p", "_pos"))
        .unionByName(rest.where(F.col("_met") + 2 == F.col("_parts")).select("_p", "_pos"))
    )
    under = _met(places, named.join(asked, "_phrase").select("_p", *phrase_key), ["_p"])
    # a place finds its text among those that reach into the same piece of its block
    piece = F.sequence(F.shiftright("_start", PIECE), F.shiftright(F.col("_end"), PIECE))
    pieces = index.texts.where("_start < _end").withColumn("_piece", F.explode(piece))
    met = under.withColumn("_piece", F.shiftright("_pos", PIECE)).join(pieces, "_piece")
    return met.where("_start <= _pos AND _pos < _end").select(
        *phrase_key, *index.keys, (F.col("_pos") - F.col("_start")).cast("int").alias("pos")
    )


def phrase_texts(index: GramIndex, phrases: DataFrame, phrase_key: list[str], phrase: str) -> DataFrame:
    """``*keys, *phrase_key`` for every phrase contained in a text."""
    return phrase_places(index, phrases, phrase_key, phrase).select(*index.keys, *phrase_key).distinct()
