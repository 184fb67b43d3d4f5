"""Quality rules: a threshold table compiled into one Spark projection.

All metrics are counts of whole texts; a rule compares two of them in whole numbers, so no rounding
takes part. Nothing here is a user function and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import bind
from corpusloom.llm.common import others, text_of

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for was on with as be at by this from or an are not have "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es "
    "de la le et les des en un une du que est dans qui par pour au sur pas plus avec ce se "
    "el los del las por con una su para al lo como más y o"
).split()

WORD = r"[^\x20\x09-\x0D]+"


class Rule(NamedTuple):
    """Keeps a text while ``100 * count`` is at least/at most ``percent * base``."""

    name: str
    count: str
    keeps: str  # "at_least" or "at_most"
    percent: int
    base: str


#: The threshold table in production. ``one`` is the constant 1.
RULES = (
    Rule("words_too_short", "word_chars", "at_least", 200, "n_words"),
    Rule("words_too_long", "word_chars", "at_most", 2000, "n_words"),
    Rule("symbols", "n_symbols", "at_most", 10, "n_words"),
    Rule("few_stop_words", "n_stop_words", "at_least", 6, "n_words"),
    Rule("repeated_lines", "n_dup_lines", "at_most", 30, "n_lines"),
    Rule("bullet_lines", "n_bullet_lines", "at_most", 90, "n_lines"),
    Rule("ellipsis_lines", "n_ellipsis_lines", "at_most", 30, "n_lines"),
)


def repeated_window_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more, first occurrence included."""
    at = F.sequence(F.lit(1), F.size(words) - 2)

    def window(i: Column) -> list[Column]:
        return [F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)]

    windows = F.transform(at, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("w"), i.alias("i")))

    def repeated(ordered: Column) -> Column:
        return F.filter(
            ordered,
            lambda x, i: ((i > 0) & (F.get(ordered, i - 1)["w"] == x["w"]))
            | F.coalesce(F.get(ordered, i + 1)["w"] == x["w"], F.lit(False)),
        )

    marks = bind(F.sort_array(windows), repeated)
    covered = F.size(
        F.array_distinct(F.flatten(F.transform(marks, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    )
    # windows whose hashes all differ all differ themselves; only other texts need the sort
    hashes = F.transform(at, lambda i: F.xxhash64(*window(i)))
    differ = bind(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(words) < 3, 0).when(differ, 0).otherwise(covered)


def with_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one struct column ``_m`` of counts; null counts as an empty text."""
    text = text_of(text_col)
    cut = docs.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).withColumn(
        "_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    )
    words, lines = F.col("_words"), F.col("_lines")

    def count_lines(pattern: str) -> Column:
        return F.size(F.filter(lines, lambda x: x.rlike(pattern)))

    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.concat_ws("", words)),
        "n_symbols": F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_window_words(words),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
        "n_bullet_lines": count_lines(r"^[\x20\x09]*[-*•]"),
        "n_ellipsis_lines": count_lines(r"(\.\.\.|…)[\x20\x09\x0D]*$"),
    }
    return cut.withColumn("_m", F.struct(*[c.cast("long").alias(n) for n, c in counts.items()]))


def quality(
    docs: DataFrame,
    text_col: str = "text",
    rules: Sequence[Rule] = RULES,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """``docs`` with a struct ``quality``: all counts, ``base_failed``, ``failed_rules``, ``kept``.

    A text fails the base test with fewer than ``min_words`` words or more than
    ``max_repeat_percent`` of its words in repeated 3-word windows. Null and empty texts have no
    words, so they fail it. Repeated rows are judged one by one; an empty table gives no rows;
    other columns pass through, and one named ``quality``, in any letter case, is replaced.
    """
    inner = with_metrics(docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text")), "_text")
    m = F.col("_m")
    base_failed = (m["n_words"] < min_words) | (
        100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"]
    )
    verdicts = []
    for r in rules:
        left, right = 100 * m[r.count], r.percent * (F.lit(1) if r.base == "one" else m[r.base])
        bad = left < right if r.keeps == "at_least" else left > right
        verdicts.append(F.when(bad, F.lit(r.name)))
    judged = inner.select(
        "_row",
        F.struct(
            "_m.*",
            base_failed.alias("base_failed"),
            F.filter(F.array(*verdicts), lambda x: x.isNotNull()).alias("failed_rules"),
        ).alias("_q"),
    )
    q = F.col("_q")
    kept = ~q["base_failed"] & (F.size(q["failed_rules"]) == 0)
    return judged.select(
        *[F.col("_row")[c].alias(c) for c in others(docs, "quality")],
        q.withField("kept", kept).alias("quality"),
    )
