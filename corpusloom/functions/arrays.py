"""Array helpers: bind a value once inside an expression, and prefix scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: States of a scan are collected in blocks of blocks of ... of so many, ``LEVELS`` deep.
BLOCK, LEVELS = 16, 4


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held(value: Column, body: Callable[[Column], Column]) -> Column:
    """As ``bind``, but what the body returns is not copied: for arrays of long texts."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda same, _: same, body)


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """State after each item of an ordered array, as an array of the same length.

    Spark copies what a fold has collected at every item, with all that it holds. Blocks of blocks
    keep that to ``BLOCK / 2`` states an item and level even where a file has very many lines;
    ``items`` is computed once, not once a block.
    """
    return held(items, lambda known: _scan(known, zero, step, LEVELS))


def _scan(items: Column, zero: Column, step: Callable[[Column, Column], Column], level: int) -> Column:
    if level == 1:
        return F.aggregate(
            items,
            F.array(zero),
            lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))),
            lambda acc: F.slice(acc, F.lit(2), F.size(acc)),
        )
    width, count = BLOCK ** (level - 1), F.size(items)
    blocks = F.when(
        count > 0, F.sequence(F.lit(0), F.floor((count - 1) / width).cast("int"))
    ).otherwise(F.array().cast("array<int>"))

    def inner(state: Column, block: Column) -> Column:
        return held(
            F.slice(items, block * width + 1, F.lit(width)), lambda part: _scan(part, state, step, level - 1)
        )

    return F.aggregate(
        blocks,
        F.array(F.array(zero)),
        lambda acc, block: F.concat(acc, F.array(inner(F.element_at(F.element_at(acc, -1), -1), block))),
        lambda acc: F.flatten(F.slice(acc, F.lit(2), F.size(acc))),
    )


def count_of(text: Column, char: str) -> Column:
    """How often a character occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))
