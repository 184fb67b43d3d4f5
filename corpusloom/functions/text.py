"""Text expressions: Column in, Column out, all on built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import fixed
from corpusloom.functions.arrays import bind

TOKEN_DELIMITERS = r"""[\s.,;:!?()\[\]{}<>=+\-*/&|^~`"'#@$%\\]+"""
WORD_PATTERN = r"(?<![a-z0-9_])[a-z][a-z0-9_]{2,}(?![a-z0-9_])"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ends(text: Column | str) -> Column:
    """Remove every kind of white space at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(_col(text), r"^\s+|\s+$", "")


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


# --- tokens and words -----------------------------------------------------------
def raw_tokens(text: Column | str) -> Column:
    """Code-aware split; may hold tokens shorter than two characters."""
    spaced = F.regexp_replace(_col(text), r"([a-z])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.split(F.translate(F.lower(spaced), "_", " "), TOKEN_DELIMITERS)


def tokens(text: Column | str) -> Column:
    """Lower-case tokens of two or more characters; splits camelCase and snake_case."""
    return F.filter(raw_tokens(text), lambda t: F.length(t) >= 2)


def keywords(text: Column | str) -> Column:
    """Distinct words of three or more characters that are no stop words."""
    words = F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD_PATTERN), 0)
    stop = F.array(*[F.lit(w) for w in fixed.PAGE_STOP_WORDS])
    return F.array_except(words, stop)


def query_words(query: Column | str) -> Column:
    """Lower-case words longer than two characters, repeats kept."""
    return F.filter(F.split(F.lower(_col(query)), r"\s+"), lambda w: F.length(w) > 2)


def question_words(question: Column | str) -> Column:
    """Words of a question without stop words, ASCII letters and digits only."""
    plain = F.regexp_replace(F.lower(_col(question)), r"[^a-z0-9\s]", "")
    stop = F.array(*[F.lit(w) for w in fixed.QUESTION_STOP_WORDS])
    return F.filter(
        F.split(plain, r"\s+"),
        lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w),
    )


# --- markdown cleaning ------------------------------------------------------------
def strip_markdown(text: Column | str) -> Column:
    """Drop fences and inline code, keep link text, drop emphasis and heading marks."""
    out = F.regexp_replace(_col(text), r"(?s)```.*?```", "")
    out = F.regexp_replace(out, r"`[^`]+`", "")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)]+\)", "$1")
    out = F.regexp_replace(out, r"[*_~]+", "")
    out = F.regexp_replace(out, r"(?m)^#+\s*", "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip_ends(out)


def clean_markdown(text: Column | str) -> Column:
    """Drop whole heading lines, keep the text of links, emphasis and inline code."""
    out = F.regexp_replace(_col(text), r"(?m)^#+\s+[^\n]*", "")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)]+\)", "$1")
    out = F.regexp_replace(out, r"\*\*([^*]+)\*\*", "$1")
    out = F.regexp_replace(out, r"\*([^*]+)\*", "$1")
    out = F.regexp_replace(out, r"`([^`]+)`", "$1")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip_ends(out)


# --- slugs --------------------------------------------------------------------------
def site_slug(text: Column | str) -> Column:
    out = F.regexp_replace(F.lower(_col(text)), r"[^A-Za-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(out, r"\s+", "-"), r"-+", "-")


def file_slug(text: Column | str) -> Column:
    out = F.regexp_replace(F.lower(_col(text)), r"[^a-z0-9]+", "-")
    return F.regexp_replace(out, r"^-+|-+$", "")


def heading_anchor(text: Column | str) -> Column:
    out = F.regexp_replace(F.lower(_col(text)), r"[^a-z0-9\s-]", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\s+", "-"), r"-+", "-")
    return F.regexp_replace(out, r"^-|-$", "")


# --- titles from names ----------------------------------------------------------------
def _upper_first(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))


def directory_title(path: Column | str) -> Column:
    """``src/user-data`` to ``Src User Data``; empty or ``root`` to ``Core Modules``."""
    p = _col(path)
    named = F.array_join(F.transform(F.split(p, r"[-_/]"), _upper_first), " ")
    return F.when(p.isNull() | p.isin("", "root"), "Core Modules").otherwise(named)


def name_title(name: Column | str) -> Column:
    """``userData_store`` to ``User Data Store``: split camel case, lower the rest."""
    spaced = F.regexp_replace(F.translate(_col(name), "-_", "  "), r"([a-z])([A-Z])", "$1 $2")
    return F.array_join(
        F.transform(
            F.split(spaced, " "),
            lambda w: F.concat(
                F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))
            ),
        ),
        " ",
    )


def section_title(name: Column | str) -> Column:
    return F.array_join(F.transform(F.split(_col(name), "-"), _upper_first), " ")


# --- paths ------------------------------------------------------------------------------
def dir_name(path: Column | str) -> Column:
    """Directory part, ``.`` when there is none."""
    d = F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)
    return F.when(d == "", ".").otherwise(d)


def base_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def extension(path: Column | str) -> Column:
    """Lower-case extension with its dot; a leading dot alone starts no extension."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1))


def stem(path: Column | str) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def html_path(path: Column | str) -> Column:
    return F.regexp_replace(_col(path), r"\.md$", ".html")


def relative_link(from_path: Column | str, to_path: Column | str) -> Column:
    """Link from one page to another: up to the root, then down to the HTML page."""
    depth = F.size(F.split(_col(from_path), "/")) - 1
    return F.concat(F.repeat(F.lit("../"), depth), html_path(to_path))


# --- source references ---------------------------------------------------------------------
_REF = r"([a-zA-Z0-9_\-./]+\.[a-zA-Z]+):(\d+)"
_CODE_REF = r"([a-zA-Z0-9_\-./]+\.[tj]sx?):(\d+)"
_LINK = "\U0001F4C4 [$1:$2](../$1#L$2)"


def link_source_references(text: Column | str) -> Column:
    """Turn ``file:line`` mentions into markdown links, five forms in order."""
    out = F.regexp_replace(_col(text), rf"(?:See:?\s*)`?{_REF}`?", _LINK)
    out = F.regexp_replace(out, rf"(?:Source:?\s*)`?{_REF}`?", _LINK)
    out = F.regexp_replace(out, rf"(?<!\[)`{_CODE_REF}`(?!\])", _LINK)
    out = F.regexp_replace(out, rf"\({_CODE_REF}\)(?!\])", f"({_LINK})")
    return F.regexp_replace(out, rf"(?:in|from|at)\s+{_CODE_REF}([.,])", f"in {_LINK}$3")


def source_references(text: Column | str) -> Column:
    """Array of ``file:line`` mentions."""
    return F.regexp_extract_all(_col(text), F.lit(_REF), 0)


def source_comment(code: Column | str) -> Column:
    """Text after ``// Source:`` or ``# Source:`` in code, else null."""
    return F.nullif(
        strip_ends(F.regexp_extract(_col(code), r"(?://|#)\s*Source:\s*([^\n\r]+)", 1)), F.lit("")
    )


def lacks_source_reference(path: Column | str, content: Column | str) -> Column:
    """True when a page that should cite source code does not."""
    c = _col(content)
    cites = c.contains("**Source:**") | c.contains("`src/") | c.contains("`lib/")
    return ~cites & ~_col(path).isin("README.md", "glossary.md")


# --- snippets ------------------------------------------------------------------------------------
def snippet(content: Column | str, query: Column | str, margin: int = 50) -> Column:
    """Text around the first hit, dots where it was cut; empty when there is no hit."""
    c, q = _col(content), _col(query)
    at = F.position(F.lower(q), F.lower(c))
    start = F.greatest(F.lit(0), at - 1 - margin)
    stop = F.least(F.length(c), at - 1 + F.length(q) + margin)
    cut = F.concat(
        F.when(start > 0, "...").otherwise(""),
        F.substring(c, start + 1, stop - start),
        F.when(stop < F.length(c), "...").otherwise(""),
    )
    return F.when(at > 0, cut).otherwise("")


def preview_line(content: Column | str, words: Column, width: int = 200) -> Column:
    """First line that holds any of the words, else the first line; cut to ``width``."""
    lines = F.split(_col(content), "\n")
    hit = bind(
        words,
        lambda ws: F.filter(
            lines, lambda line: F.exists(ws, lambda w: F.contains(F.lower(line), w))
        ),
    )
    found = F.substring(strip_ends(F.try_element_at(hit, F.lit(1))), 1, width)
    first = F.substring(strip_ends(F.element_at(lines, 1)), 1, width)
    return F.coalesce(F.nullif(found, F.lit("")), first)


def section_label(content: Column | str, page_title: Column | str) -> Column:
    """Short label of a passage: its heading, else a leading phrase, else a code name."""
    c, t = _col(content), _col(page_title)
    heading = F.regexp_extract(c, r"(?m)^#+\s+(.+)$", 1)
    lead = F.regexp_extract(c, r"^(.{10,50}?)(?:\n|\.|:)", 1)
    head = F.when(heading != "", heading).otherwise(lead)
    head = strip_ends(F.regexp_replace(strip_ends(head), r"[*_#`]", ""))
    head = F.when((F.length(head) > 5) & (F.length(head) < 50) & (head != t), head)

    sentence = strip_ends(F.element_at(F.split(c, r"[.!?\n]"), 1))
    phrase = F.regexp_extract(
        sentence, r"(?:the\s+)?([A-Z][a-z]+(?:\s+[A-Z]?[a-z]+){0,2})", 1
    )
    phrase = F.when(
        (F.length(sentence) > 10) & (F.length(sentence) < 60) & (phrase != "") & (phrase != t),
        phrase,
    )
    code = F.nullif(
        F.regexp_extract(
            c, r"(?:class|function|interface|type|const|export)\s+([A-Za-z_][A-Za-z0-9_]*)", 1
        ),
        F.lit(""),
    )
    return F.coalesce(head, phrase, code)


# --- texts handed to models -------------------------------------------------------------------------
def embedding_text(context: Column | str, documentation: Column | str, content: Column | str) -> Column:
    """Context, 300 characters of documentation, then content up to 2000 in all (500 at least)."""
    ctx, doc, body = _col(context), _col(documentation), _col(content)
    head = F.concat(
        F.when(F.coalesce(ctx, F.lit("")) != "", F.concat(ctx, F.lit("\n\n"))).otherwise(""),
        F.when(
            F.coalesce(doc, F.lit("")) != "", F.concat(F.substring(doc, 1, 300), F.lit("\n\n"))
        ).otherwise(""),
    )
    room = F.greatest(F.lit(2000) - F.length(head), F.lit(500))
    return F.concat(head, F.substring(body, F.lit(1), room))


def rerank_text(name: Column | str, documentation: Column | str, content: Column | str) -> Column:
    """Name, 200 characters of documentation and 500 of content, joined by blanks."""
    blank = F.lit("")
    return F.concat_ws(
        " ",
        F.coalesce(_col(name), blank),
        F.coalesce(F.substring(_col(documentation), 1, 200), blank),
        F.substring(_col(content), 1, 500),
    )


def domain_context(
    chunk_type: Column | str,
    name: Column | str,
    parent: Column | str,
    categories: Column | str,
    signature: Column | str,
) -> Column:
    """``[TYPE] name in parent (labels) - signature``; absent parts drop out."""
    ty, nm, pa = _col(chunk_type), _col(name), _col(parent)
    cats, sig = _col(categories), _col(signature)
    labels = F.array_join(
        F.transform(cats, lambda c: F.regexp_replace(c, r"^([^-]*)-", "$1 ")), ", "
    )
    return F.concat_ws(
        " ",
        F.when(~ty.isin("unknown", "file"), F.concat(F.lit("["), F.upper(ty), F.lit("]"))),
        F.when(nm != "", nm),
        F.when(pa != "", F.concat(F.lit("in "), pa)),
        F.when(labels != "", F.concat(F.lit("("), labels, F.lit(")"))),
        F.when(sig != "", F.concat(F.lit("- "), sig)),
    )


# --- questions ------------------------------------------------------------------------------------------
def is_flow_question(question: Column | str) -> Column:
    return _col(question).rlike("(?i)" + any_of(fixed.FLOW_QUESTION_PATTERNS))


def diagram_type(question: Column | str) -> Column:
    q = F.lower(_col(question))
    (first, pattern), *rest = fixed.DIAGRAM_PATTERNS
    out = F.when(q.rlike(pattern), first)
    for kind, pattern in rest:
        out = out.when(q.rlike(pattern), kind)
    return out.otherwise(fixed.DEFAULT_DIAGRAM)


# --- path predicates -------------------------------------------------------------------------------------
def is_test_file(path: Column | str) -> Column:
    return _col(path).rlike(any_of(fixed.TEST_FILE_PATTERNS))


def is_entry_point(path: Column | str) -> Column:
    p = _col(path)
    name = F.regexp_replace(F.lower(base_name(p)), r"\.[^.]+$", "")
    return p.rlike("(?i)" + any_of(fixed.ENTRY_POINT_PATTERNS)) | name.isin(
        fixed.ENTRY_POINT_NAMES
    )


def ends_with_any(path: Column | str, suffixes: list[str]) -> Column:
    """One pattern for all suffixes, so that the path is evaluated once."""
    return _col(path).rlike("(?:" + "|".join(f"\\Q{s}\\E" for s in suffixes) + ")$")


def size_label(size: Column | str) -> Column:
    s = _col(size)
    return F.when(s < 1000, "small").when(s < 10000, "medium").otherwise("large")


def lookup(values: dict[str, str], key: Column | str, default: Column | str | None) -> Column:
    """Constant map look-up, folded into the expression (no join)."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), _col(key))
    fallback = F.lit(default) if not isinstance(default, Column) else default
    return F.coalesce(found, fallback)


def language(path: Column | str, parser: bool = False) -> Column:
    """Language by extension; the parser map knows other extensions than the index map."""
    if parser:
        return lookup(fixed.PARSER_LANGUAGES, extension(path), "unknown")
    return lookup(fixed.INDEX_LANGUAGES, extension(path), "")


def explode_lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per line: kept columns, ``line_no`` from 1, ``line``."""
    return df.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).select(
        *keep, (F.col("pos") + 1).alias("line_no"), "line"
    )
