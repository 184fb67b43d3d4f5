"""Markdown page corpus: front matter, page elements, navigation, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import fixed
from corpusloom.functions import text as T
from corpusloom.functions.arrays import bind
from corpusloom.session import dealt_join, with_global_rank

FRONT_MATTER = r"(?s)^---\n(.*?)\n---(?:\n|$)"


# --- parsing ---------------------------------------------------------------------------
def front_matter(content: Column | str) -> Column:
    """Flat ``key: value`` map of the front matter; the last of a repeated key wins."""
    block = F.regexp_extract(T._col(content), FRONT_MATTER, 1)
    pair = r"^([A-Za-z_][\w-]*):[ \t]*(.*)$"
    entries = F.transform(
        F.filter(F.split(block, "\n"), lambda x: x.rlike(pair)),
        lambda x, i: F.struct(
            F.regexp_extract(x, pair, 1).alias("key"),
            F.regexp_replace(T.strip_ends(F.regexp_extract(x, pair, 2)), r"^[\"'](.*)[\"']$", "$1").alias("value"),
            i.alias("i"),
        ),
    )
    return bind(
        entries,
        lambda es: F.map_from_entries(
            F.transform(
                F.filter(es, lambda e: ~F.exists(es, lambda o: (o["key"] == e["key"]) & (o["i"] > e["i"]))),
                lambda e: F.struct(e["key"], e["value"]),
            )
        ),
    )


def _list(value: Column) -> Column:
    """``a, b`` or ``[a, b]`` to an array of trimmed items."""
    items = F.split(F.regexp_replace(value, r"^\[|\]$", ""), ",")
    return F.filter(
        F.transform(items, lambda x: F.regexp_replace(T.strip_ends(x), r"^[\"'](.*)[\"']$", "$1")),
        lambda x: x != "",
    )


def first_heading(body: Column | str) -> Column:
    """Text of the first level-1 heading, null if there is none."""
    return F.nullif(T.strip_ends(F.regexp_extract(T._col(body), r"(?m)^#\s+(.+)$", 1)), F.lit(""))


def parse_pages(files: DataFrame) -> DataFrame:
    """Pages of ``files(path, content, ...)``: title, description, category, lists, body.

    ``title`` is the front matter's, else the first level-1 heading, else the file name;
    ``listed_title`` skips the heading. ``content`` loses front matter and that heading.
    """
    keep = [c for c in files.columns if c not in ("content",)]
    fm = F.col("frontmatter")
    rows = files.select(
        *keep,
        front_matter("content").alias("frontmatter"),
        F.regexp_replace("content", FRONT_MATTER, "").alias("body"),
    )
    stem = F.regexp_replace(T.base_name("path"), r"\.md$", "")
    return rows.select(
        *keep,
        F.coalesce(F.nullif(fm["title"], F.lit("")), first_heading("body"), stem).alias("title"),
        F.coalesce(F.nullif(fm["title"], F.lit("")), stem).alias("listed_title"),
        fm["description"].alias("description"),
        fm["category"].alias("category"),
        _list(fm["sources"]).alias("sources"),
        _list(fm["related"]).alias("related"),
        "frontmatter",
        "body",
        F.regexp_replace("body", r"^\s*#\s+[^\n]+\n*", "").alias("content"),
    )


def headings(content: Column | str) -> Column:
    """Headings in order: ``array<struct<level, text, id>>``."""
    c = T._col(content)
    pattern = F.lit(r"(?m)^(#{1,6})\s+(.+)$")
    return F.zip_with(
        F.regexp_extract_all(c, pattern, 1),
        F.regexp_extract_all(c, pattern, 2),
        lambda marks, text: F.struct(
            F.length(marks).alias("level"),
            T.strip_ends(text).alias("text"),
            T.site_slug(T.strip_ends(text)).alias("id"),
        ),
    )


def heading_rows(pages: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    return pages.select(key, F.posexplode(headings(content)).alias("pos", "h")).select(
        key, "pos", "h.level", "h.text", "h.id"
    )


def code_blocks(pages: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """Fenced code blocks without diagrams: ``pos, language, code, source_ref``."""
    pattern = F.lit(r"(?s)```(\w*)\n(.*?)```")
    blocks = F.zip_with(
        F.regexp_extract_all(F.col(content), pattern, 1),
        F.regexp_extract_all(F.col(content), pattern, 2),
        lambda lang, code: F.struct(
            F.when(lang == "", "text").otherwise(lang).alias("language"),
            code.alias("code"),
            T.source_comment(code).alias("source_ref"),
        ),
    )
    rows = pages.select(key, F.posexplode(blocks).alias("pos", "b"))
    return rows.where("b.language <> 'mermaid'").select(key, "pos", "b.language", "b.code", "b.source_ref")


def diagrams(pages: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    found = F.regexp_extract_all(F.col(content), F.lit(r"(?s)```mermaid\n(.*?)```"), 1)
    return pages.select(key, F.posexplode(found).alias("pos", "d")).select(
        key, "pos", T.strip_ends("d").alias("diagram")
    )


def page_toc(pages: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """Headings of level 2 and 3 of pages that have at least two of them."""
    toc = F.filter(headings(content), lambda h: h["level"].between(2, 3))
    shown = bind(toc, lambda t: F.when(F.size(t) >= 2, t))
    return pages.select(key, F.posexplode(shown).alias("pos", "h")).select(
        key, "pos", (F.col("h.level") - 2).alias("indent"), "h.text", "h.id"
    )


def best_heading(content: Column | str, query: Column | str) -> Column:
    """Heading with most query words (first wins): struct of text and anchor, null if none hits."""
    words = T.query_words(query)
    texts = F.regexp_extract_all(T._col(content), F.lit(r"(?m)^#+\s+(.+)$"), 1)

    def scored(asked: Column) -> Column:
        return F.transform(
            texts,
            lambda h, i: F.struct(
                (-F.size(F.filter(asked, lambda w: F.contains(F.lower(h), w)))).alias("neg"),
                i.alias("i"), h.alias("text"), T.heading_anchor(h).alias("anchor"),
            ),
        )

    hits = F.filter(bind(words, scored), lambda s: s["neg"] < 0)
    best = F.try_element_at(F.array_sort(hits), F.lit(1))
    return F.when(best.isNotNull(), F.struct(best["text"].alias("text"), best["anchor"].alias("anchor")))


# --- order and navigation ------------------------------------------------------------------
def page_order() -> list[Column]:
    """Home page first, then by path."""
    return [(F.col("path") != "README.md").cast("int"), F.col("path")]


def ordered_pages(pages: DataFrame) -> DataFrame:
    return with_global_rank(pages, page_order(), "ord")


def section(path: Column | str) -> Column:
    p = T._col(path)
    return F.when(p.contains("/"), F.substring_index(p, "/", 1)).otherwise("Overview")


def _section_rank() -> Column:
    order = F.array(*[F.lit(s) for s in fixed.SECTION_ORDER])
    at = F.array_position(order, F.col("section"))
    return F.when(at > 0, at).otherwise(len(fixed.SECTION_ORDER) + 1)


def navigation(pages: DataFrame) -> DataFrame:
    """Navigation rows in long form: section with its rank and title, page with HTML path.

    Sort by ``section_rank, section, home, path`` to read it in order; a section of any size
    stays many rows.
    """
    return (
        pages.withColumn("section", section("path"))
        .withColumn("section_rank", _section_rank().cast("int"))
        .select(
            "section_rank", "section", T.section_title("section").alias("section_title"),
            (F.col("path") != "README.md").cast("int").alias("home"), "path",
            T.html_path("path").alias("html_path"), "title", "description",
        )
    )


def navigation_sections(pages: DataFrame) -> DataFrame:
    """One row per section: title, first page, number of pages."""
    rows = navigation(pages)
    return rows.groupBy("section_rank", "section", "section_title").agg(
        F.min(F.struct("home", "path", "html_path")).alias("first"), F.count("*").alias("pages")
    ).select("section_rank", "section", "section_title", F.col("first.html_path").alias("path"), "pages")


def neighbours(pages: DataFrame) -> DataFrame:
    """Previous and next page in navigation order.

    Rows get their global position by a distributed ranking; each row is then offered to the
    positions beside its own and met there by equality.
    """
    nav = with_global_rank(
        navigation(pages).select("section_rank", "section", "home", "path"),
        [F.col(c) for c in ("section_rank", "section", "home", "path")],
    )
    offers = F.array(
        F.struct(F.col("pos").alias("at"), F.lit(0).alias("role")),
        F.struct((F.col("pos") + 1).alias("at"), F.lit(1).alias("role")),
        F.struct((F.col("pos") - 1).alias("at"), F.lit(2).alias("role")),
    )
    rows = nav.select("path", F.inline(offers))
    role = F.col("role")
    return (
        rows.groupBy("at")
        .agg(
            F.max(F.when(role == 0, F.col("path"))).alias("path"),
            F.max(F.when(role == 1, F.col("path"))).alias("previous"),
            F.max(F.when(role == 2, F.col("path"))).alias("next"),
        )
        .where("path IS NOT NULL")
        .select(F.col("at").alias("pos"), "path", "previous", "next")
    )


# --- listings ----------------------------------------------------------------------------------
def category_of(category: Column | str = "category") -> Column:
    return F.coalesce(F.nullif(T._col(category), F.lit("")), F.lit("Uncategorized"))


def category_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy(category_of().alias("category")).agg(F.count("*").alias("pages"))


def category_listing(pages: DataFrame, category: str | None = None) -> DataFrame:
    """Pages by category and title, in long form with a distributed sort."""
    rows = pages.where(F.col("category") == category) if category else pages
    return rows.select(category_of().alias("category"), F.col("listed_title").alias("title"), "path", "description").orderBy(
        "category", "title", "path"
    )


def title_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("title").agg(F.count("*").alias("n"))


def find_pages(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Look pages up by ``request``: exact path, path + ``.md``, then without regard to case.

    One equality join on the lower-cased path; the best kind of match wins.
    """
    r = F.col("request")
    md = F.concat(r, F.lit(".md"))
    asked = requests.select(
        "request",
        F.explode(
            F.array_distinct(F.array(F.lower(r), F.lower(md)))
        ).alias("_key"),
    )
    known = pages.select("path", F.lower("path").alias("_key"))
    rank = (
        F.when(F.col("path") == r, 0)
        .when((F.col("path") == md) & ~r.endswith(".md"), 1)
        .otherwise(2)
    )
    hits = asked.join(known, "_key").select("request", rank.alias("kind"), "path")
    return hits.groupBy("request").agg(F.min(F.struct("kind", "path")).alias("m")).select(
        "request", "m.path", "m.kind"
    )


# --- site tables ------------------------------------------------------------------------------------
def page_index(pages: DataFrame, most: int = 5000) -> DataFrame:
    """Search table of a site: HTML path, title, plain content up to ``most``, headings."""
    return pages.select(
        T.html_path("path").alias("path"),
        "title",
        "description",
        F.substring(T.strip_markdown("content"), 1, most).alias("content"),
        F.transform(headings("content"), lambda h: h["text"]).alias("headings"),
    )


def siblings(pages: DataFrame, most: int = 3) -> DataFrame:
    """First ``most`` other pages of the same directory, by page order.

    Only the first ``most`` + 1 pages of a directory can ever be shown, so a bounded ranking
    comes first and every page then meets one short row per directory.
    """
    rows = pages.select("path", T.dir_name("path").alias("dir")).where("dir <> '.'")
    w = Window.partitionBy("dir").orderBy("path")
    first = (
        rows.withColumn("n", F.row_number().over(w))
        .where(F.col("n") <= most + 1)
        .groupBy("dir")
        .agg(F.array_sort(F.collect_list("path")).alias("firsts"))
    )
    shown = F.slice(F.filter("firsts", lambda p: p != F.col("path")), 1, most)
    return dealt_join(rows, first, "dir").select("path", F.posexplode(shown).alias("pos", "sibling"))


def related_pages(pages: DataFrame, most: int = 5) -> DataFrame:
    """Declared related pages first, then siblings, without repeats, ``most`` in all."""
    declared = pages.select("path", F.posexplode("related").alias("pos", "name")).select(
        "path", F.lit(0).alias("kind"), "pos",
        F.explode(F.array(F.col("name"), F.concat("name", F.lit(".md")))).alias("other"),
    )
    declared = declared.join(pages.select(F.col("path").alias("other")), "other", "left_semi")
    near = siblings(pages).select("path", F.lit(1).alias("kind"), "pos", F.col("sibling").alias("other"))
    rows = declared.select("path", "kind", "pos", "other").unionByName(near)
    once = rows.groupBy("path", "other").agg(F.min(F.struct("kind", "pos")).alias("o"))
    w = Window.partitionBy("path").orderBy("o", "other")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(
        "path", "rank", F.col("other").alias("related")
    )
