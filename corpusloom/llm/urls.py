"""URL filters: exact membership in a key list by a cascade of Bloom filters.

Level 1 holds the listed keys. Level 2 holds those keys of the corpus that are not listed but hit
level 1, level 3 the listed keys that hit level 2, and so on until a level is hit by none of the
other side. Over the complete key universe of the corpus the answer is then exact, and a page is
judged on its own row: no join and no shuffle of the pages. Only distinct keys are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import settle

#: Bits for each key and hash functions: of the first level, of all later ones.
FIRST, LATER = (12, 6), (4, 2)
#: A level beyond this many bytes is not sent to the tasks; keys are then looked up by a semi join.
MAX_LEVEL_BYTES = 32_000_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_keys(host: Column, labels: int) -> list[Column]:
    """The host's last 1 .. ``labels`` labels, each as a host name; short hosts repeat their whole."""
    return [F.substring_index(host, ".", -i) for i in range(1, labels + 1)]


def _positions(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    """Double hashing: position i of a key is (h1 + i * h2) mod bits, both of 31 bits."""
    h1 = F.shiftrightunsigned(F.xxhash64(F.lit(2 * level), key), 33)
    h2 = F.shiftrightunsigned(F.xxhash64(F.lit(2 * level + 1), key), 33).bitwiseOR(F.lit(1))
    return [F.pmod(h1 + i * h2, F.lit(bits)) for i in range(hashes)]


class Level:
    """One filter: ``bits`` in words of 64, held in a one-row frame."""

    def __init__(self, number: int, keys: DataFrame, n_keys: int):
        per_key, self.hashes = FIRST if number == 1 else LATER
        words = max(1, -(-n_keys * per_key // 64))
        self.number, self.bits = number, 64 * words
        spots = F.array(*_positions(F.col("key"), number, self.hashes, self.bits))
        one = F.lit(1).cast("long")
        marks = keys.select(F.explode(spots).alias("p")).select(
            F.shiftright("p", 6).alias("w"),
            F.call_function("shiftleft", one, F.pmod("p", F.lit(64)).cast("int")).alias("v"),
        )
        empty = keys.sparkSession.range(words).select(
            F.col("id").alias("w"), F.lit(0).cast("long").alias("v")
        )
        packed = marks.unionAll(empty).groupBy("w").agg(F.bit_or("v").alias("v"))
        self.frame = settle(
            packed.agg(F.array_sort(F.collect_list(F.struct("w", "v"))).alias("x")).select(
                F.transform("x", lambda y: y["v"]).alias("x")
            )
        )

    def hit(self, key: Column) -> Column:
        held = self.frame.scalar()
        found = F.lit(True)
        for p in _positions(key, self.number, self.hashes, self.bits):
            word = F.get(held, F.shiftright(p, 6).cast("int"))
            bit = F.call_function("shiftright", word, F.pmod(p, F.lit(64)).cast("int"))
            found = found & (bit.bitwiseAND(F.lit(1)) == 1)
        return found


def build_cascade(universe: DataFrame, listed: DataFrame) -> list[Level] | None:
    """Levels for the column ``key`` of both; None where a level would pass ``MAX_LEVEL_BYTES``.

    Null keys are never listed. A list without a key of the universe needs no level.
    """
    tagged = settle(
        universe.select("key", F.lit(False).alias("listed"), F.lit(True).alias("seen"))
        .unionAll(listed.select("key", F.lit(True), F.lit(False)))
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.max("listed").alias("listed"), F.max("seen").alias("seen"))
        .where("seen")
    )
    sides = [tagged.where("listed").select("key"), tagged.where(~F.col("listed")).select("key")]
    levels: list[Level] = []
    inside, other = sides
    while n := inside.count():
        number = len(levels) + 1
        if n * (FIRST if number == 1 else LATER)[0] // 8 > MAX_LEVEL_BYTES:
            return None
        levels.append(Level(number, inside, n))
        inside, other = settle(other.where(levels[-1].hit(F.col("key")))), inside
    return levels


def is_listed(levels: list[Level], key: Column) -> Column:
    """Exact for every key of the universe: the first level that misses decides by its parity."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(~level.hit(key), F.lit(level.number % 2 == 0)).otherwise(out)
    return out


def url_filter(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict``.

    ``rules`` are (verdict, ``host/path``) pairs; a rule fits its host and all subdomains where the
    url's path starts with the rule's, and the longest fitting rule decides. Without one, a page is
    blocked if its host or a parent domain is a ``key`` of ``listed``. Null urls and urls without
    ``://`` have an empty host, fit no rule and are allowed. Repeated rows are judged one by one; an
    empty list allows; other columns of ``pages`` take no part.
    """
    cut = pages.select(
        F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    host, path = F.col("host"), F.col("path")
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        of, _, start = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + start)
        rule, ruled = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    # as many labels as the longest listed host has can decide
    longest = listed.agg(F.max(F.size(F.split("key", r"\."))).alias("n")).first()["n"] or 0
    keys = host_keys(host, longest)
    if longest == 0:
        blocked = F.lit(False)
    else:
        universe = cut.select("host").distinct().select(F.explode(F.array_distinct(F.array(*keys))).alias("key"))
        levels = build_cascade(universe, listed)
        if levels is None:
            return _by_join(cut, listed, keys, rule, ruled, id_col)
        blocked = F.lit(False)
        for key in keys if levels else []:
            blocked = blocked | is_listed(levels, key)
    method = F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))
    return cut.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(ruled, method).alias("verdict"))


def _by_join(cut, listed, keys, rule, ruled, id_col):
    """The same answer where the list is too large to send: listed hosts by an equality join."""
    hosts = cut.select("host").distinct()
    bad = (
        hosts.select("host", F.explode(F.array(*keys)).alias("key"))
        .join(listed.select("key").distinct(), "key", "left_semi")
        .select("host")
        .distinct()
        .withColumn("_bad", F.lit(True))
    )
    method = F.when(F.col("_bad"), F.lit("block")).otherwise(F.lit("allow"))
    return cut.join(bad, "host", "left").select(
        id_col, "host", "path", rule.alias("rule"), F.coalesce(ruled, method).alias("verdict")
    )
