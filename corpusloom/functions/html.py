"""HTML expressions for a table of raw pages: text, links, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import _col, strip_ends

# The entities decoded in text and attribute values, ampersand last.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]


def decode_entities(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def html_text(html: Column | str, sep: str = "") -> Column:
    """Visible text of the body: no script, style, comment or tag; white space collapsed.

    Neighbouring elements are glued unless ``sep`` is given.
    """
    h = F.regexp_replace(_col(html), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    h = F.regexp_replace(h, r"(?s)<!--.*?-->", "")
    body = F.regexp_extract(h, r"(?is)<body[^>]*>(.*?)(?:</body>|$)", 1)
    plain = decode_entities(F.regexp_replace(body, r"(?s)<[^>]+>", sep))
    return strip_ends(F.regexp_replace(plain, r"[\s ]+", " "))


def html_links(pages: DataFrame, html: str, url: str, *keep: str) -> DataFrame:
    """Long table of links: kept columns, ``pos``, ``link``.

    ``/path`` is resolved against the page's origin, ``http...`` stays, the rest is dropped.
    """
    href = F.regexp_extract_all(
        F.col(html), F.lit(r"(?is)<a\s[^>]*?\bhref\s*=\s*[\"']([^\"']+)[\"']"), 1
    )
    rows = pages.select(*keep, F.col(url).alias("_url"), F.posexplode(href).alias("pos", "href"))
    scheme = F.regexp_extract("_url", r"^([a-zA-Z][a-zA-Z0-9+.-]*:)//", 1)
    origin = F.regexp_extract("_url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    raw = decode_entities(F.col("href"))
    link = (
        F.when(raw.startswith("//"), F.concat(scheme, raw))
        .when(raw.startswith("/"), F.concat(origin, raw))
        .when(raw.startswith("http"), raw)
    )
    return rows.select(*keep, "pos", link.alias("link")).where(F.col("link").isNotNull())


def html_title(html: Column | str) -> Column:
    return strip_ends(decode_entities(F.regexp_extract(_col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def html_metadata(pages: DataFrame, html: str, *keep: str) -> DataFrame:
    """Long table of metadata: kept columns, ``name``, ``value``; the last of a name wins.

    The title is one of the names. All work is on the page's own row.
    """
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<meta\b[^>]*>"), 0)

    def attr(tag: Column, name: str) -> Column:
        return F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)

    def pair(tag: Column, i: Column) -> Column:
        by_name = attr(tag, "name")
        return F.struct(
            F.when(by_name != "", by_name).otherwise(attr(tag, "property")).alias("name"),
            decode_entities(attr(tag, "content")).alias("value"),
            i.alias("ord"),
        )

    metas = F.filter(
        F.transform(tags, pair), lambda m: (m["name"] != "") & (m["value"] != "")
    )
    title = F.array(
        F.struct(
            F.lit("title").alias("name"), html_title(html).alias("value"), F.lit(-1).alias("ord")
        )
    )
    rows = pages.select(*keep, F.concat(title, metas).alias("m"))
    last = F.filter(
        "m",
        lambda x: ~F.exists("m", lambda y: (y["name"] == x["name"]) & (y["ord"] > x["ord"])),
    )
    return rows.select(*keep, F.inline(last)).drop("ord")
