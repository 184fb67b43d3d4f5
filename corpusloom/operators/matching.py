"""Exact substring matching between a text table and a word table, as equi-joins.

A word without white space occurs in a text if and only if it occurs inside one of
the text's white-space-delimited tokens. So tokens meet words by equality of substrings: a
bounded list of words where the text lies, more of them against the vocabulary, whose
matches are joined back. No pair of text and word is formed that does not match.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.arrays import bind
from corpusloom.session import is_light, is_small, parts_of, settle

# task functions travel with the job, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM, LONGEST = 3, 32
#: Words that become a constant, and that a task looks for in its texts; bytes of text that it looks at together.
CONSTANT_WORDS, LISTED_WORDS, BLOCK_BYTES = 200, 20_000, 1 << 17
_STEP, _SPREAD, _FLAG_SHIFT = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), 47
#: A token that stands in more places than that is dealt to ``SALTS`` tasks.
DEALT_PLACES, SALTS = 10_000, 16


def token_counts(texts: DataFrame, key: list[str], text: Column | str) -> DataFrame:
    """``key, token, n``: white-space tokens of every text with their counts."""
    return (
        texts.select(*key, F.explode_outer(F.split(T._col(text), r"\s+")).alias("token"))
        .where("token <> ''")
        .groupBy(*key, "token")
        .agg(F.count("*").alias("n"))
    )


def dealt_tokens(held: DataFrame) -> DataFrame:
    """``token, _salts`` of those ``held(token, n)`` whose rows go to several tasks."""
    return held.where(F.col("n") > DEALT_PLACES).select("token", F.lit(SALTS).alias("_salts"))


def vocabulary_matches(vocabulary: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct ``(token, word, hits)``: how often the word occurs in the token.

    A place of a token counts where a word's first ``GRAM`` characters (or all of a shorter word) stand;
    from there the token offers its substrings of the lengths that words have, so tokens and
    words meet by equality. Words longer than ``LONGEST`` meet by their beginning and are verified. At
    most ``LONGEST`` lengths are read for that. Occurrences do not overlap, counted from the left.
    """
    need = words.select("word").distinct().where("word <> ''").withColumn(
        "gram", F.substring("word", 1, LONGEST)
    )
    sizes = sorted(r["n"] for r in need.select(F.length("gram").alias("n")).distinct().collect()) or [GRAM]
    length = F.length("token")

    def places_of(size: int) -> Column:
        starts = F.sequence(F.lit(1), length - size + 1)
        pieces = F.transform(
            starts, lambda i: F.struct(i.alias("at"), F.substring(F.col("token"), i, F.lit(size)).alias("head"))
        )
        return F.when(length >= size, pieces).otherwise(F.array().cast("array<struct<at:int,head:string>>"))

    heads = need.select(F.substring("gram", 1, GRAM).alias("head")).distinct()
    offered = F.flatten(F.array(*[places_of(n) for n in sorted({min(n, GRAM) for n in sizes})]))
    places = vocabulary.select("token", F.inline(offered)).join(
        F.broadcast(heads) if is_small(heads) else heads, "head", "left_semi"
    )
    long = F.array(*[F.lit(n) for n in sizes if n >= GRAM]).cast("array<int>")
    lengths = F.when(F.length("head") < GRAM, F.array(F.length("head"))).otherwise(
        F.filter(long, lambda n: n <= length - F.col("at") + 1)
    )
    grams = places.select("token", F.explode(F.transform(lengths, lambda n: F.substring(F.col("token"), F.col("at"), n))).alias("gram"))
    hits = (
        F.length("token") - F.length(F.replace(F.col("token"), F.col("word"), F.lit("")))
    ) / F.length("word")
    return (
        grams.join(need, "gram")
        .where((F.length("word") <= LONGEST) | F.contains("token", "word"))
        .select("token", "word", hits.cast("bigint").alias("hits"))
        .distinct()
    )


def _tables(words: list[bytes]) -> list[tuple]:
    """Per size in bytes: size, flags by the top bits of a hash, sorted hashes, the words' bytes and places.

    Words of more than ``LONGEST`` bytes stand under their beginning, the first of them for all.
    """
    of_size: dict[int, dict[bytes, int]] = {}
    for i, w in enumerate(words):
        of_size.setdefault(min(len(w), LONGEST), {}).setdefault(w[:LONGEST], i)
    tables = []
    for size, known in sorted(of_size.items()):
        grid = np.frombuffer(b"".join(known), np.uint8).reshape(-1, size)
        h = np.zeros(len(grid), np.uint64)
        for j in range(size):
            h = h * _STEP + grid[:, j]
        order = np.argsort(h)
        h, place = h[order], np.fromiter(known.values(), np.int64, len(known))[order]
        flags = np.zeros(1 << (64 - _FLAG_SHIFT), bool)
        flags[h * _SPREAD >> np.uint64(_FLAG_SHIFT)] = True
        # words of equal hash follow each other: so many steps lead from the first to the last
        turns = int(np.unique(h, return_counts=True)[1].max())
        tables.append((size, flags, h, grid[order], place, turns))
    return tables


def _places(data: np.ndarray, tables: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Where words stand in the bytes, which, and their size; a block of starts and a size at a time."""
    for start in range(0, len(data), BLOCK_BYTES):
        part = data[start : start + BLOCK_BYTES + LONGEST - 1]
        h, done = np.zeros(len(part), np.uint64), 0
        for size, flags, hashes, grid, place, turns in tables:
            if size > len(part):
                break
            for done in range(done, size):
                h = h[: len(part) - done] * _STEP
                h += part[done:]
            done = size
            at = np.flatnonzero(flags[h[:BLOCK_BYTES] * _SPREAD >> np.uint64(_FLAG_SHIFT)])
            held = np.lib.stride_tricks.sliding_window_view(part, size)
            first = np.searchsorted(hashes, h[at])
            for turn in range(turns):
                of = np.minimum(first + turn, len(hashes) - 1)
                same = (hashes[of] == h[at]) & (first + turn < len(hashes))
                same[same] = (held[at[same]] == grid[of[same]]).all(axis=1)
                yield start + at[same], place[of[same]], size


def _listed_hits(words: list[str]):
    """Function of texts: for each the places in ``words`` of those it holds, times 2^32, plus the hits.

    All beginnings in a batch's bytes are compared with the words of a size at once, by a hash that grows with the
    size, then byte by byte.
    """
    # a word with white space is in no token
    plain = [(i, w.encode()) for i, w in enumerate(words) if not re.search(r"[ \t\n\x0b\f\r]", w)]
    number, listed = np.array([i for i, _ in plain], np.int64), [w for _, w in plain]
    long: dict[bytes, list[int]] = {}
    for i, w in enumerate(listed):
        if len(w) >= LONGEST:
            long.setdefault(w[:LONGEST], []).append(i)
    # only a word that ends as it begins can overlap itself
    recount = np.array([len(w) >= LONGEST or any(w[:n] == w[-n:] for n in range(1, len(w))) for w in listed], bool)
    known: list[list[tuple]] = []

    def run(texts: pa.Array) -> pa.Array:
        if not known:
            known.append(_tables(listed))
        texts = texts.cast(pa.large_string())
        _, ends, body = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        body = body if body is not None else pa.py_buffer(b"")
        data = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at, of, size in _places(data, known[0]):
            text = np.searchsorted(ends, at, "right") - 1
            inside = at + size <= ends[text + 1]
            key, n = np.unique((text[inside] << 32) | of[inside], return_counts=True)
            keys.append(key)
            counts.append(n)
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)
        text, of = key >> 32, key & 0xFFFFFFFF
        again = np.flatnonzero(recount[of] & ((n > 1) | np.isin(of, [i for x in long.values() for i in x])))
        if len(again):
            plus: list[tuple[int, int, int]] = []
            for k in again.tolist():
                held, w = data[ends[text[k]] : ends[text[k] + 1]].tobytes(), listed[of[k]]
                n[k] = 0
                plus += [(int(text[k]), i, held.count(listed[i])) for i in (long[w[:LONGEST]] if len(w) >= LONGEST else [int(of[k])])]
            more = np.array(plus, np.int64).reshape(-1, 3)
            text, of, n = np.append(text, more[:, 0]), np.append(of, more[:, 1]), np.append(n, more[:, 2])
            text, of, n = text[n > 0], of[n > 0], n[n > 0]
            order = np.argsort(text, kind="stable")
            text, of, n = text[order], of[order], n[order]
        offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array((number[of] << 32) | n, pa.int64()))

    return run


# --- whole words ------------------------------------------------------------------------
def _runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of the runs of ``[a-z0-9_]`` in the bytes; none goes from one text (``ends``, from 0 on) to the next."""
    known = np.zeros(256, bool)
    known[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789_", np.uint8)] = True
    held = known[data]
    before, after = np.append(False, held[:-1]), np.append(held[1:], False)
    before[ends[:-1][ends[:-1] < len(data)]] = False
    after[ends[1:][ends[1:] > 0] - 1] = False
    begin, end = np.flatnonzero(held & ~before), np.flatnonzero(held & ~after) + 1
    return begin, end, np.searchsorted(ends, begin, "right") - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_STEP`` to the power of 0 to n - 1, and the inverses."""
    both = []
    for base in (int(_STEP), pow(int(_STEP), -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        both.append(np.cumprod(steps, dtype=np.uint64))
    return both[0], both[1]


def _sums(data: np.ndarray, powers: np.ndarray) -> np.ndarray:
    return np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], dtype=np.uint64))


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts behind each other, and where each ends, from 0 on."""
    texts = texts.cast(pa.large_string())
    _, ends, body = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(body if body is not None else pa.py_buffer(b""), np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def _word_hashes(words: pa.Array) -> pa.Array:
    data, ends = _text_bytes(words)
    powers, back = _powers(len(data) + 1)
    sums = _sums(data, powers)
    return pa.array(((sums[ends[1:]] - sums[ends[:-1]]) * back[ends[:-1]]).view(np.int64))


def _said_words(hashes: np.ndarray):
    """Function of texts: for each its distinct runs of ``[a-z0-9_]``, and neighbouring ones with what stands between, whose hash is listed."""
    hashes = np.sort(hashes.view(np.uint64))
    shift = np.uint64(64 - max(16, len(hashes).bit_length() + 3))
    known: list[np.ndarray] = []
    steps: list[tuple[np.ndarray, np.ndarray]] = [_powers(0)]

    def listed(h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(known[0][h * _SPREAD >> shift])
        place = np.searchsorted(hashes, h[at])
        at, place = at[place < len(hashes)], place[place < len(hashes)]
        return at[hashes[place] == h[at]]

    def block(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        if len(steps[0][0]) <= len(data):
            steps[0] = _powers(2 * len(data) + 1)
        powers, back = steps[0]
        begin, end, text = _runs(data, ends)
        sums = _sums(data, powers)
        pair = np.flatnonzero(text[1:] == text[:-1])
        begin, end, text = np.append(begin, begin[pair]), np.append(end, end[pair + 1]), np.append(text, text[pair])
        at = listed((sums[end] - sums[begin]) * back[begin])
        begin, end, text = begin[at], end[at], text[at]
        offsets = np.append(0, np.cumsum(end - begin))
        body = data[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], end - begin)]
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body))
        return words, text

    def run(texts: pa.Array) -> pa.Array:
        if not known:
            flags = np.zeros(1 << (64 - int(shift)), bool)
            flags[hashes * _SPREAD >> shift] = True
            known.append(flags)
        data, ends = _text_bytes(texts)
        words, of, first = [pa.array([], pa.large_string())], [np.empty(0, np.int64)], 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK_BYTES, "right")) - 1)
            found, text = block(data[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
            words.append(found)
            of.append(text + first)
            first = last
        coded = pa.concat_arrays(words).dictionary_encode()
        key = np.unique((np.concatenate(of) << 32) | coded.indices.to_numpy())
        offsets = np.searchsorted(key >> 32, np.arange(len(texts) + 1)).astype(np.int32)
        held = coded.dictionary.take(pa.array(key & 0xFFFFFFFF)).cast(pa.string())
        return pa.ListArray.from_arrays(pa.array(offsets), held)

    return run


def said_words(texts: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame | None:
    """``key, word``: which of ``words`` a lower-case text says as whole words, one or two neighbours with what stands between.

    Where the text lies it is compared with the hashes of all words, so single other words of equal hash may be among the rows. None
    if the hashes are too many to be handed to every task.
    """
    def hash_of(words: pa.Array) -> pa.Array:
        return _word_hashes(words)

    known = settle(words.select(F.arrow_udf(hash_of, "bigint")("word").alias("h")).distinct())
    if not is_light(known, F.lit(8)):
        return None
    run = _said_words(known.toArrow()["h"].to_numpy())

    def words_of(texts: pa.Array) -> pa.Array:
        return run(texts)

    # outer: a plain explode would have the text searched a second time, to look whether it has words
    said = texts.select(key, F.explode_outer(F.arrow_udf(words_of, "array<string>")(text)).alias("word"))
    return said.where("word IS NOT NULL")


def few_words(words: DataFrame, most: int = CONSTANT_WORDS) -> list[str] | None:
    """The distinct words if there are at most ``most``, else None; reads no more than that."""
    rows = words.select("word").distinct().where("word <> ''").limit(most + 1).collect()
    return [r["word"] for r in rows] if len(rows) <= most else None


def word_hits(texts: DataFrame, key: list[str], text: Column | str, words: DataFrame,
              constant: bool = True) -> DataFrame:
    """``key, word, hits``: every word that occurs in a text, with its number of occurrences.

    A checked, bounded word list becomes a constant searched on the text's own row: no
    shuffle. A list of up to ``LISTED_WORDS`` is looked for where the text lies: what a
    text holds is one row, exchanged once by the first of ``key``, so that sums by it need no further exchange. Any larger list
    goes through the vocabulary joins. ``constant=False`` leaves out the first way.
    """
    few = few_words(words) if constant else None
    if few is not None:
        known = F.array(*[F.lit(w) for w in few]).cast("array<string>")
        found = bind(
            T._col(text),
            lambda t: F.transform(
                F.filter(known, lambda w: F.contains(t, w)),
                lambda w: F.struct(
                    w.alias("word"),
                    ((F.length(t) - F.length(F.replace(t, w, F.lit("")))) / F.length(w))
                    .cast("bigint")
                    .alias("hits"),
                ),
            ),
        )
        return texts.select(*key, F.inline(found))
    listed = few_words(words, LISTED_WORDS)
    if listed:
        run = _listed_hits(listed)

        def hits_of(texts: pa.Array) -> pa.Array:
            return run(texts)

        rows = texts.select(*key, T._col(text).alias("_text")).where("_text <> ''")
        # a function's result has no known partitioning, so what it found is exchanged, not the text
        found = rows.select(*key, F.arrow_udf(hits_of, "array<bigint>")("_text").alias("_found"))
        placed = found.repartition(parts_of(rows, F.octet_length("_text")), key[0])
        each = placed.select(*key, F.explode_outer("_found").alias("_hit")).where("_hit IS NOT NULL")
        sums = each.groupBy(*key, F.shiftright("_hit", 32).alias("_place")).agg(
            F.sum(F.col("_hit").bitwiseAND(0xFFFFFFFF)).alias("hits")
        )
        names = texts.sparkSession.createDataFrame(list(enumerate(listed)), "_place bigint, word string")
        return sums.join(F.broadcast(names), "_place").select(*key, "word", "hits")
    each = texts.select(*key, F.explode(F.split(T._col(text), r"\s+")).alias("token")).where("token <> ''")
    held = settle(each.groupBy("token").agg(F.count("*").alias("n")))
    matches = settle(vocabulary_matches(held.select("token"), words))
    if is_light(matches, F.octet_length("token") + F.octet_length("word") + 64):
        # tokens that match no word go on the text's own row; only sums of matches are exchanged
        found = each.join(F.broadcast(matches), "token").withColumn("n", F.lit(1))
    else:
        # a token of very many places, of which there are few, is dealt to SALTS tasks
        dealt = F.broadcast(dealt_tokens(held))
        salts = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)).alias("_salt")
        matches = matches.join(dealt, "token", "left").select("token", "word", "hits", salts)
        counts = token_counts(texts, key, text).join(dealt, "token", "left").select(
            *key, "token", "n", F.pmod(F.xxhash64(*key), F.coalesce("_salts", F.lit(1))).cast("int").alias("_salt")
        )
        found = counts.join(matches, ["token", "_salt"])
    return found.groupBy(*key, "word").agg(F.sum(F.col("n") * F.col("hits")).alias("hits"))


def phrase_hits(texts: DataFrame, key: list[str], text: Column | str,
                phrases: DataFrame, phrase_key: list[str], phrase: str,
                constant: bool = True) -> DataFrame:
    """``key, phrase_key`` for every phrase (white space allowed) contained in a text.

    The longest word of the phrase gives the candidates; containment is then verified on
    the candidate's own text. Without any white space the word is the phrase and the
    candidates are the answer.
    """
    spread = phrases.select(*phrase_key, F.col(phrase).alias("_phrase")).withColumn(
        "word",
        F.try_element_at(
            F.array_sort(
                F.split(F.trim(F.col("_phrase")), r"\s+"),
                lambda a, b: F.length(b) - F.length(a),
            ),
            F.lit(1),
        ),
    )
    body = texts.select(*key, T._col(text).alias("_text"))
    blank_free = spread.where(F.col("_phrase").rlike(r"\s")).limit(1).count() == 0
    candidates = word_hits(body, key, "_text", spread.select("word"), constant=constant).join(spread, "word")
    if blank_free:
        return candidates.select(*key, *phrase_key)
    return (
        candidates.join(body, key)
        .where(F.contains("_text", "_phrase"))
        .select(*key, *phrase_key)
    )
