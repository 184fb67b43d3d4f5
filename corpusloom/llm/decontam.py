"""Benchmark decontamination: a positional inverted index over the corpus, asked from the rarest terms.

Document frequencies of the test terms are counted over all documents. Each window of an item is
anchored at its rarest positions; only postings of anchor terms are stored (document, term,
position). A posting less the anchor's place in its item is a shift: lists adjusted by their offsets
are intersected per (document, item, shift), and the words that stand there are compared with the
item's. Texts are split twice, for the frequencies and for the postings; after that only the texts
of candidates are read. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import bind
from corpusloom.llm.common import ascii_lower
from corpusloom.session import is_light, is_small, scratch_path, settle

#: Words of one window, and how many of its rarest positions must agree before texts are compared.
WINDOW, ANCHORS = 10, 2
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Copies of an item-side row where that side is too large to broadcast, so a frequent term is split.
SALTS = 16


def words_of(text: Column) -> Column:
    """Runs of 0-9, a-z and characters beyond ASCII, after A-Z are lower-cased; null has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS)
    return F.filter(parts, lambda w: w != "")


def identity(id_col: str, text_col: str) -> list[Column]:
    """``k1``, ``k2``: 128 bits that stand for an id with its whole text; rows that agree have equal results."""
    return [F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(text_col, F.lit("k2"), id_col).alias("k2")]


def by_term(many: DataFrame, few: DataFrame, kind: str = "inner") -> DataFrame:
    """Join on ``term``; ``few`` is broadcast only if it is small, else frequent terms are salted."""
    if is_small(few):
        return many.join(F.broadcast(few), "term", kind)
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = many.withColumn("_salt", F.pmod(F.xxhash64("*"), F.lit(SALTS)).cast("int"))
    return spread.join(salted, ["term", "_salt"], kind).drop("_salt")


def item_table(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct items with words: ``item`` (its id as text), ``words``, ``item_key``, ``len``."""
    cut = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("words"))
    return (
        cut.where(F.size("words") > 0)
        .distinct()
        .withColumn("item_key", F.xxhash64("item", F.array_join("words", " ")))
        .withColumn("len", F.least(F.size("words"), F.lit(window)))
    )


def document_frequency(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """In how many documents each of ``terms`` stands: one partial sum per task and term."""
    each = docs.select(F.explode(F.array_distinct(words_of(F.col(text_col)))).alias("term"))
    return by_term(each, terms, "left_semi").groupBy("term").agg(F.count("*").alias("df"))


def anchor_places(items: DataFrame, df: DataFrame, anchors: int) -> DataFrame:
    """``item_key``, ``at`` (0-based), ``term``: the rarest places of all windows; ``need`` of them make a window."""
    placed = items.select("item_key", F.posexplode("words").alias("pos", "term"))
    rank = placed.join(df, "term", "left").select(
        "item_key", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "pos").alias("r")
    )
    ranks = rank.groupBy("item_key").agg(F.array_sort(F.collect_list("r")).alias("by_df"))

    def rarest(start: Column) -> Column:
        here = F.filter(F.col("by_df"), lambda r: (r["pos"] >= start) & (r["pos"] < start + F.col("len")))
        return F.transform(F.slice(here, 1, anchors), lambda r: r["pos"])

    starts = F.sequence(F.lit(0), F.size("words") - F.col("len"))
    return (
        items.join(ranks, "item_key")
        .select("item_key", "words", F.least("len", F.lit(anchors)).alias("need"), F.explode(F.array_distinct(F.flatten(F.transform(starts, rarest)))).alias("at"))
        .select("item_key", "need", "at", F.get("words", F.col("at")).alias("term"))
    )


def store_postings(docs: DataFrame, terms: DataFrame, text_col: str, id_col: str, path: str) -> DataFrame:
    """Write ``doc``, ``k1``, ``k2``, ``n`` (words of the text), ``term``, ``pos``.

    Besides the places of ``terms`` every document has one row with the term null, so the texts need not be split
    again for those that have none.
    """
    # hashes and counts stand below the explode, so that they are made once a text and not once a word
    cut = docs.select(
        F.col(id_col).alias("doc"), *identity(id_col, text_col),
        bind(words_of(F.col(text_col)), lambda w: F.struct(F.size(w).alias("n"), F.concat(F.array(F.lit("")), w).alias("words"))).alias("x"),
    )
    each = cut.select("doc", "k1", "k2", "x.n", F.posexplode("x.words").alias("pos", "term"))
    # no term is empty: the first place is the document's own row
    found = by_term(each, terms.unionAll(terms.sparkSession.sql("select '' as term")), "left_semi")
    found.select(
        "doc", "k1", "k2", "n", F.when(F.col("term") != "", F.col("term")).alias("term"), (F.col("pos") - 1).alias("pos")
    ).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def candidate_lines(postings: DataFrame, places: DataFrame, slack: int) -> DataFrame:
    """``k1``, ``k2``, ``item_key``, ``shift`` where enough anchors of an item stand at one shift."""
    shift = F.col("pos") - F.col("at")
    if slack > 0:
        shift = F.explode(F.sequence(shift - slack, shift + slack))
    shifted = by_term(postings.where("term is not null").select("k1", "k2", "term", "pos"), places).select(
        "k1", "k2", "item_key", "need", "at", shift.alias("shift")
    )
    lists = shifted.groupBy("k1", "k2", "item_key", "shift").agg(
        F.min("at").alias("lo"), F.max("at").alias("hi"), F.min("need").alias("need")
    )
    # two places of two lists, whichever they are, are worth a look; one is, if a window has no more or words may be displaced
    return lists.where(F.lit(slack > 0) | (F.col("lo") < F.col("hi")) | (F.col("need") == 1)).select("k1", "k2", "item_key", "shift")


def compared(lines: DataFrame, docs: DataFrame, items: DataFrame, id_col: str, text_col: str, slack: int) -> DataFrame:
    """``k1``, ``k2``, ``item``, ``len``, ``starts`` (hits, word positions) and ``near`` (shifts) of the lines.

    The words that stand at a line are cut out of the text before the item's come to them, so a row holds
    one item's length and not a whole text or all items of a document.
    """
    sized = lines.join(items.select("item_key", F.size("words").alias("size")), "item_key")
    per_doc = settle(sized.groupBy("k1", "k2").agg(F.collect_list(F.struct("item_key", "shift", "size")).alias("lines")))
    texts = docs.select(*identity(id_col, text_col), F.col(text_col).alias("text")).join(
        F.broadcast(per_doc) if is_light(per_doc, 48 + 48 * F.size("lines")) else per_doc, ["k1", "k2"]
    )
    first = F.greatest(F.col("line.shift") - slack, F.lit(0))
    last = F.col("line.shift") + F.col("line.size") + slack
    cut = (
        texts.select("k1", "k2", "lines", words_of(F.col("text")).alias("words"))
        .select("k1", "k2", "words", F.explode("lines").alias("line"))
        .select(
            "k1", "k2", "line.item_key", "line.shift", first.alias("first"),
            F.slice("words", first + 1, F.greatest(last - first, F.lit(0))).alias("held"),
        )
    )
    words = items.select("item_key", "item", "words", "len")
    light = is_light(words, 40 + F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + 16 + F.octet_length(w)))
    both = cut.join(F.broadcast(words) if light else words, "item_key")
    place = F.col("shift") - F.col("first")  # of the item's first word among the held ones
    starts = F.sequence(F.lit(0), F.size("words") - F.col("len"))
    same = F.transform("words", lambda w, i: F.coalesce(F.get("held", F.when(place + i >= 0, place + i)) == w, F.lit(False)))
    hits = bind(same, lambda ok: F.filter(starts, lambda s: ~F.exists(F.slice(ok, s + 1, F.col("len")), lambda x: ~x)))
    out = both.select(
        "k1", "k2", "item", "len", "shift",
        F.transform(hits, lambda s: s + F.col("shift")).alias("starts"),
        (_near(starts, place, slack) if slack > 0 else F.lit(False)).alias("near"),
    )
    return out.where("near or size(starts) > 0").distinct()


def _near(starts: Column, place: Column, slack: int) -> Column:
    """Whether a window has half or more of its words within ``slack`` places of theirs."""

    def found(w: Column, i: Column) -> Column:
        low = F.greatest(place + i - slack, F.lit(0))
        return F.array_contains(F.slice("held", low + 1, F.greatest(place + i + slack + 1 - low, F.lit(0))), w)

    close = F.transform("words", found)
    return bind(close, lambda ok: F.exists(
        starts, lambda s: 2 * F.size(F.filter(F.slice(ok, s + 1, F.col("len")), lambda x: x)) >= F.col("len")
    ))


def found_lines(
    docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str,
    window: int, anchors: int, slack: int,
) -> tuple[DataFrame, DataFrame]:
    """One row per document (``doc``, ``k1``, ``k2``, ``n``), and what ``compared`` found."""
    known = settle(item_table(items, item_col, item_text_col, window))
    terms = settle(known.select(F.explode("words").alias("term")).distinct())
    df = document_frequency(docs, terms, text_col)
    # without one of more than half of its words, less than half of a window is left
    places = settle(anchor_places(known, df, max(anchors, window // 2 + 1) if slack > 0 else anchors))
    postings = store_postings(
        docs, settle(places.select("term").distinct()), text_col, id_col, scratch_path(docs.sparkSession, "postings")
    )
    lines = settle(candidate_lines(postings, places, slack))
    return postings.where("term is null").drop("term", "pos"), settle(compared(lines, docs, known, id_col, text_col, slack))


def phrase_matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    anchors: int = ANCHORS,
    slack: int = 0,
) -> DataFrame:
    """One row per document: id, ``n_words``, ``hits`` (array of item, start, len), word positions from 0.

    A hit is an occurrence of ``window`` consecutive words of an item; an item with fewer words is one
    window, one without words none. With ``slack`` above 0, ``near`` also lists the (item, start) of
    shifts, negative ones too, at which half or more of the words of a window stand within ``slack`` places of
    theirs. One of the rarest words of a window, more than half of all, is then enough for a comparison.
    Null ids and texts are kept: a null document id gives its own rows, a null item id is the empty
    text, a null text has no words. Repeated rows give their row each; empty tables give no hits or no
    rows; other columns take no part. Texts are compared only where anchors agree, so a word or a
    passage that most documents share costs one row per document and item.
    """
    base, found = found_lines(docs, items, id_col, text_col, item_col, item_text_col, window, anchors, slack)
    hit = F.transform("starts", lambda s: F.struct(F.col("item").alias("item"), s.alias("start"), F.col("len").alias("len")))
    of_doc = found.groupBy("k1", "k2").agg(
        F.flatten(F.collect_list(hit)).alias("hits"),
        F.collect_list(F.when(F.col("near"), F.struct("item", F.col("shift").alias("start")))).alias("near"),
    )
    light = is_light(found, 64 + 72 * F.size("starts"))
    joined = base.join(F.broadcast(of_doc) if light else of_doc, ["k1", "k2"], "left")
    none = F.array()
    out = [
        F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_words"),
        F.coalesce("hits", none.cast("array<struct<item:string,start:int,len:int>>")).alias("hits"),
    ]
    if slack > 0:
        out.append(F.coalesce("near", none.cast("array<struct<item:string,start:int>>")).alias("near"))
    return joined.select(*out)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """``phrase_matches`` summed up: ``n_hit`` words in any hit, ``items`` (sorted ids), ``contaminated``."""
    found = phrase_matches(docs, items, id_col=id_col, **kw)
    covered = F.array_distinct(
        F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1)))
    )
    return found.select(
        id_col, "n_words",
        bind(covered, F.size).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"]))).alias("items"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def without_contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    anchors: int = ANCHORS,
) -> DataFrame:
    """The rows of ``docs`` without a hit of ``phrase_matches``, with all their columns; nulls and repeated rows as there."""
    _, found = found_lines(docs, items, id_col, text_col, item_col, item_text_col, window, anchors, 0)
    bad = found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct()
    k1, k2 = identity(id_col, text_col)
    same = (F.col("_k1") == k1) & (F.col("_k2") == k2)
    return docs.join(F.broadcast(bad) if is_small(bad) else bad, same, "left_anti")
