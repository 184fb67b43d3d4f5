"""Text, path, HTML and question queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import fixed, html
from corpusloom.functions import text as T
from registry import sqlkit as S
from registry.base import query, table
from registry.inputs import cte, derive

NL = "\n"


# --- tokens and words ---------------------------------------------------------------
@query("txt1_tokens", f"SELECT doc_id, {S.tokens('text')} AS tokens FROM documents")
def txt1(spark, d):
    return table(spark, d, "documents").select("doc_id", T.tokens("text").alias("tokens"))


_KW = (
    "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), "
    "lambda w: length(w) >= 3 AND regexp_matches(w, '^[a-z]') AND NOT list_contains("
    f"[{', '.join(repr(w) for w in fixed.PAGE_STOP_WORDS)}], w)))"
)


@query("txt2_keywords", f"SELECT doc_id, list_sort({_KW}) AS keywords FROM documents")
def txt2(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.array_sort(T.keywords("text")).alias("keywords")
    )


@query("txt3_query_words", f"SELECT item_id, {S.words('text')} AS words FROM benchmark")
def txt3(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.query_words("text").alias("words"))


# --- markdown cleaning -----------------------------------------------------------------
@query("txt4_strip_markdown",
       f"WITH {cte('wiki')} SELECT path, {S.strip_markdown('content')} AS plain FROM wiki")
def txt4(spark, d):
    return derive(spark, d, "wiki").select("path", T.strip_markdown("content").alias("plain"))


@query("txt5_clean_markdown",
       f"WITH {cte('wiki')} SELECT path, {S.clean_markdown('content')} AS plain FROM wiki")
def txt5(spark, d):
    return derive(spark, d, "wiki").select("path", T.clean_markdown("content").alias("plain"))


# --- slugs ---------------------------------------------------------------------------------
_TITLE = r"trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1))"


def _titles(spark, d):
    return table(spark, d, "pages").select(
        "page_id", F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("t")
    )


@query("txt6_site_slug", f"SELECT page_id, {S.site_slug(_TITLE)} AS slug FROM pages")
def txt6(spark, d):
    return _titles(spark, d).select("page_id", T.site_slug("t").alias("slug"))


@query("txt7_file_slug",
       f"SELECT page_id, {S.rx(S.rx(f'lower({_TITLE})', '[^a-z0-9]+', '-'), '^-+|-+$', '')} AS slug FROM pages")
def txt7(spark, d):
    return _titles(spark, d).select("page_id", T.file_slug("t").alias("slug"))


_ANCHOR = S.rx(S.rx(S.rx(S.rx(f"lower({_TITLE})", r"[^a-z0-9\s-]", ""), r"\s+", "-"), "-+", "-"), "^-|-$", "")


@query("txt8_heading_anchor", f"SELECT page_id, {_ANCHOR} AS anchor FROM pages")
def txt8(spark, d):
    return _titles(spark, d).select("page_id", T.heading_anchor("t").alias("anchor"))


# --- source references ------------------------------------------------------------------------
_R = r"([a-zA-Z0-9_\-./]+\.[a-zA-Z]+):(\d+)"
_C = r"([a-zA-Z0-9_\-./]+\.[tj]sx?):(\d+)"
_LK = "\U0001F4C4 [\\1:\\2](../\\1#L\\2)"


def _linked(text: str) -> str:
    out = S.rx(text, rf"(?:See:?\s*)`?{_R}`?", _LK)
    out = S.rx(out, rf"(?:Source:?\s*)`?{_R}`?", _LK)
    # no look-around here: the inputs hold no backticked reference next to a bracket
    out = S.rx(out, rf"`{_C}`", _LK)
    out = S.rx(out, rf"\({_C}\)", f"({_LK})")
    return S.rx(out, rf"(?:in|from|at)\s+{_C}([.,])", f"in {_LK}\\3")


@query("txt14_link_source_references",
       f"WITH {cte('wiki')} SELECT path, {_linked('content')} AS linked FROM wiki")
def txt14(spark, d):
    return derive(spark, d, "wiki").select(
        "path", T.link_source_references("content").alias("linked")
    )


@query("txt15_source_references",
       f"WITH {cte('wiki')} SELECT path, regexp_extract_all(content, '{_R}', 0) AS refs FROM wiki")
def txt15(spark, d):
    return derive(spark, d, "wiki").select("path", T.source_references("content").alias("refs"))


# --- snippets ---------------------------------------------------------------------------------------
_AT = "instr(lower(text), lang)"
_LO = f"greatest(0, {_AT} - 51)"
_HI = f"least(length(text), {_AT} - 1 + length(lang) + 50)"


@query("txt17_snippet", f"""
SELECT doc_id, CASE WHEN {_AT} = 0 THEN '' ELSE
  (CASE WHEN {_LO} > 0 THEN '...' ELSE '' END) || substr(text, {_LO} + 1, {_HI} - {_LO}) ||
  (CASE WHEN {_HI} < length(text) THEN '...' ELSE '' END) END AS snippet FROM documents""")
def txt17(spark, d):
    return table(spark, d, "documents").select("doc_id", T.snippet("text", "lang").alias("snippet"))


_LINES = f"string_split(text, '{NL}')"
_HITL = (f"list_filter({_LINES}, lambda l: len(list_filter(ws, lambda w: contains(lower(l), w))) > 0)")


@query("txt18_preview", f"""
SELECT doc_id, coalesce(nullif(substr({S.strip('h[1]')}, 1, 200), ''), substr({S.strip('ls[1]')}, 1, 200)) AS preview
FROM (SELECT *, {_HITL} AS h, {_LINES} AS ls
      FROM (SELECT doc_id, text, ['tion', lang || 'x'] AS ws FROM documents))""")
def txt18(spark, d):
    words = F.array(F.lit("tion"), F.concat("lang", F.lit("x")))
    return table(spark, d, "documents").select("doc_id", T.preview_line("text", words).alias("preview"))


_HEAD = r"regexp_extract(content, '(?m)^#+\s+(.+)$', 1)"
_LEAD = r"regexp_extract(content, '^(.{10,50}?)(?:\n|\.|:)', 1)"
_H2 = S.strip(S.rx(S.strip(f"CASE WHEN {_HEAD} <> '' THEN {_HEAD} ELSE {_LEAD} END"), "[*_#`]", ""))
_SENT = S.strip(r"string_split_regex(content, '[.!?\n]')[1]")
_PHR = r"regexp_extract(sent, '(?:the\s+)?([A-Z][a-z]+(?:\s+[A-Z]?[a-z]+){0,2})', 1)"


SECTION_LABEL = f"""coalesce(
  CASE WHEN length(h) > 5 AND length(h) < 50 AND h <> t THEN h END,
  CASE WHEN length(sent) > 10 AND length(sent) < 60 AND {_PHR} <> '' AND {_PHR} <> t THEN {_PHR} END,
  nullif(regexp_extract(content, '(?:class|function|interface|type|const|export)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1), ''))"""
LABEL_HEAD, LABEL_SENTENCE = _H2, _SENT


@query("txt19_section_label", f"""
WITH {cte('wiki')}
SELECT doc_id, {SECTION_LABEL} AS label
FROM (SELECT *, {_H2} AS h, {_SENT} AS sent, 'Topic' AS t FROM wiki)""")
def txt19(spark, d):
    return derive(spark, d, "wiki").select(
        "doc_id", T.section_label("content", F.lit("Topic")).alias("label")
    )


# --- titles and paths -----------------------------------------------------------------------------------
_DIR = S.dir_name("path")


def _titled(split: str, arr: str, rest: str) -> str:
    return f"array_to_string(list_transform({split}, lambda w: upper(w[1]) || {rest}), ' ')"


@query("txt20_directory_titles", f"""
WITH {cte('files')}
SELECT path, {_titled(f"string_split_regex({_DIR}, '[-_/]')", 'w', 'w[2:]')} AS directory_title,
  {_titled("string_split(" + S.rx(f"translate({S.stem('path')}, '-_', '  ')", '([a-z])([A-Z])', chr(92) + '1 ' + chr(92) + '2') + ", ' ')", 'w', 'lower(w[2:])')} AS name_title,
  {_titled("string_split(string_split(path, '/')[1], '-')", 'w', 'w[2:]')} AS section_title
FROM files""")
def txt20(spark, d):
    return derive(spark, d, "files").select(
        "path",
        T.directory_title(T.dir_name("path")).alias("directory_title"),
        T.name_title(T.stem("path")).alias("name_title"),
        T.section_title(F.substring_index("path", "/", 1)).alias("section_title"),
    )


@query("txt21_relative_link", f"""
WITH {cte('wiki')}
SELECT path, repeat('../', len(string_split(path, '/')) - 1) ||
  regexp_replace(regexp_extract(content, '\\[next\\]\\(([^)]+)\\)', 1), '\\.md$', '.html') AS link FROM wiki""")
def txt21(spark, d):
    return derive(spark, d, "wiki").select(
        "path",
        T.relative_link("path", F.regexp_extract("content", r"\[next\]\(([^)]+)\)", 1)).alias("link"),
    )


# --- texts handed to models ----------------------------------------------------------------------------
@query("txt24_embedding_text", f"""
WITH {cte('fields')},
h AS (SELECT *, CASE WHEN title <> '' THEN title || '{NL}{NL}' ELSE '' END ||
        CASE WHEN description <> '' THEN substr(description, 1, 300) || '{NL}{NL}' ELSE '' END AS head FROM fields)
SELECT doc_id, head || substr(content, 1, greatest(2000 - length(head), 500)) AS embedding_text FROM h""")
def txt24(spark, d):
    return derive(spark, d, "fields").select(
        "doc_id", T.embedding_text("title", "description", "content").alias("embedding_text")
    )


@query("txt25_rerank_text", f"""
WITH {cte('fields')}
SELECT doc_id, title || ' ' || substr(description, 1, 200) || ' ' || substr(content, 1, 500) AS pair_text FROM fields""")
def txt25(spark, d):
    return derive(spark, d, "fields").select(
        "doc_id", T.rerank_text("title", "description", "content").alias("pair_text")
    )


@query("txt26_domain_context", """
SELECT doc_id, concat_ws(' ', CASE WHEN source NOT IN ('unknown', 'file') THEN '[' || upper(source) || ']' END,
  'doc' || doc_id, 'in ' || lang, '(' || 'user ' || lang || ', search)', '- f(' || n_chars || ')') AS context
FROM documents""")
def txt26(spark, d):
    return table(spark, d, "documents").select(
        "doc_id",
        T.domain_context(
            "source",
            F.concat(F.lit("doc"), "doc_id"),
            "lang",
            F.array(F.concat(F.lit("user-"), "lang"), F.lit("search")),
            F.concat(F.lit("f("), "n_chars", F.lit(")")),
        ).alias("context"),
    )


# --- HTML -----------------------------------------------------------------------------------------------------
def _entities(text: str) -> str:
    for name, char in html.ENTITIES:
        quoted = char.replace("'", "''")
        text = f"replace({text}, '{name}', '{quoted}')"
    return text


def _html_text(sep: str) -> str:
    h = S.rx("html", r"(?is)<script\b[^>]*>.*?</script\s*>", "")
    h = S.rx(h, r"(?is)<style\b[^>]*>.*?</style\s*>", "")
    h = S.rx(h, "(?s)<!--.*?-->", "")
    h = S.rx(h, r"(?is)<head\b[^>]*>.*?</head>", "")
    h = S.rx(h, "(?is)^.*?<body[^>]*>", "")
    h = S.rx(h, "(?is)</body>.*$", "")
    return S.strip(S.rx(_entities(S.rx(h, "(?s)<[^>]+>", sep)), "[\\s ]+", " "))


@query("web1_html_text", f"SELECT page_id, {_html_text('')} AS text FROM pages")
def web1(spark, d):
    return table(spark, d, "pages").select("page_id", html.html_text("html").alias("text"))


@query("web1_html_text_spaced", f"SELECT page_id, {_html_text(' ')} AS text FROM pages")
def web1b(spark, d):
    return table(spark, d, "pages").select("page_id", html.html_text("html", " ").alias("text"))


_HREF = r"""regexp_extract_all(html, '(?is)<a\s[^>]*?\bhref\s*=\s*["'']([^"'']+)["'']', 1)"""
WEB_LINKS = f"""
hrefs AS (SELECT page_id, url, unnest({_HREF}) AS href, generate_subscripts({_HREF}, 1) - 1 AS pos FROM pages),
weblinks AS (SELECT page_id, url, pos, CASE
    WHEN starts_with({_entities('href')}, '//') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)//', 1) || {_entities('href')}
    WHEN starts_with({_entities('href')}, '/') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) || {_entities('href')}
    WHEN starts_with({_entities('href')}, 'http') THEN {_entities('href')} END AS link FROM hrefs)"""


@query("web2_html_links", f"WITH {WEB_LINKS} SELECT page_id, pos, link FROM weblinks WHERE link IS NOT NULL")
def web2(spark, d):
    return html.html_links(table(spark, d, "pages"), "html", "url", "page_id")


_TITLE2 = S.strip(_entities(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))


@query("web3_html_metadata", rf"""
WITH tags AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*>')) AS tag,
                generate_subscripts(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), 1) AS ord FROM pages),
attrs AS (SELECT page_id, ord, coalesce(nullif(regexp_extract(tag, '(?is)\bname\s*=\s*["'']([^"'']*)["'']', 1), ''),
            regexp_extract(tag, '(?is)\bproperty\s*=\s*["'']([^"'']*)["'']', 1)) AS name,
            {_entities("regexp_extract(tag, '(?is)" + chr(92) + "bcontent" + chr(92) + "s*=" + chr(92) + "s*[" + chr(34) + "'']([^" + chr(34) + "'']*)[" + chr(34) + "'']', 1)")} AS value FROM tags),
every AS (SELECT * FROM attrs WHERE name <> '' AND value <> ''
          UNION ALL SELECT page_id, 0, 'title', {_TITLE2} FROM pages)
SELECT page_id, name, arg_max(value, ord) AS value FROM every GROUP BY page_id, name""")
def web3(spark, d):
    return html.html_metadata(table(spark, d, "pages"), "html", "page_id")


# --- questions -----------------------------------------------------------------------------------------------------
_ASK = "(CASE WHEN role = 'user' THEN 'how does ' ELSE 'show me how ' END) || lower(text)"
_FLOW = "|".join(f"(?:{p})" for p in fixed.FLOW_QUESTION_PATTERNS)


@query("cls3_flow_question",
       f"SELECT conv_id, turn, regexp_matches({_ASK}, '(?i){_FLOW}') AS is_flow FROM conversations")
def cls3(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", T.is_flow_question(F.expr(_ASK)).alias("is_flow")
    )


_DIA = " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{k}'" for k, p in fixed.DIAGRAM_PATTERNS)


@query("cls4_diagram_type",
       f"SELECT doc_id, CASE {_DIA} ELSE 'flowchart' END AS diagram FROM documents")
def cls4(spark, d):
    return table(spark, d, "documents").select("doc_id", T.diagram_type("text").alias("diagram"))


# --- path predicates ----------------------------------------------------------------------------------------------------
@query("flt1_language", f"""
WITH {cte('files')} SELECT path, {S.mapping(S.extension('path'), fixed.INDEX_LANGUAGES, "''")} AS index_language,
  {S.mapping(S.extension('path'), fixed.PARSER_LANGUAGES, "'unknown'")} AS parser_language FROM files""")
def flt1(spark, d):
    return derive(spark, d, "files").select(
        "path", T.language("path").alias("index_language"),
        T.language("path", parser=True).alias("parser_language"),
    )


_TEST = "|".join(f"(?:{p})" for p in fixed.TEST_FILE_PATTERNS)


@query("flt2_test_files", f"WITH {cte('files')} SELECT path FROM files WHERE regexp_matches(path, '{_TEST}')")
def flt2(spark, d):
    return derive(spark, d, "files").where(T.is_test_file("path")).select("path")


@query("flt3_file_filters", f"""
WITH {cte('files')} SELECT path FROM files
WHERE {S.suffix_any('path', ['.ts', '.py'])} AND NOT regexp_matches(path, '{_TEST}')""")
def flt3(spark, d):
    return derive(spark, d, "files").where(
        T.ends_with_any("path", [".ts", ".py"]) & ~T.is_test_file("path")
    ).select("path")


_ENTRY = "|".join(f"(?:{p})" for p in fixed.ENTRY_POINT_PATTERNS)
ENTRY_SQL = (
    f"(regexp_matches(path, '(?i){_ENTRY}') OR regexp_replace(lower({S.base_name('path')}), '\\.[^.]+$', '') "
    f"IN {S.inlist(fixed.ENTRY_POINT_NAMES)})"
)


@query("flt4_entry_points", f"WITH {cte('files')} SELECT path FROM files WHERE {ENTRY_SQL}")
def flt4(spark, d):
    return derive(spark, d, "files").where(T.is_entry_point("path")).select("path")


@query("flt6_category", "SELECT doc_id, source FROM documents WHERE source = 'src7'")
def flt6(spark, d):
    return table(spark, d, "documents").where(F.col("source") == "src7").select("doc_id", "source")


@query("flt7_chunk_quality", f"""
SELECT doc_id, i AS line_no FROM (SELECT doc_id, unnest(string_split(text, '{NL}')) AS line,
  generate_subscripts(string_split(text, '{NL}'), 1) AS i FROM documents) WHERE length({S.strip('line')}) > 50""")
def flt7(spark, d):
    lines = T.explode_lines(table(spark, d, "documents"), "text", "doc_id")
    return lines.where(F.length(T.strip_ends("line")) > 50).select("doc_id", "line_no")


@query("flt10_source_changes",
       f"WITH {cte('files')} SELECT path FROM files WHERE {S.suffix_any('path', fixed.CHANGE_EXTENSIONS)}")
def flt10(spark, d):
    return derive(spark, d, "files").where(T.ends_with_any("path", fixed.CHANGE_EXTENSIONS)).select("path")


@query("flt11_size_label", f"""
WITH {cte('files')} SELECT path, CASE WHEN size < 1000 THEN 'small' WHEN size < 10000 THEN 'medium' ELSE 'large' END AS label FROM files""")
def flt11(spark, d):
    return derive(spark, d, "files").select("path", T.size_label("size").alias("label"))


@query("flt14_missing_source_refs", f"""
WITH {cte('wiki')} SELECT path FROM wiki WHERE NOT (contains(content, '**Source:**') OR contains(content, '`src/')
  OR contains(content, '`lib/')) AND path NOT IN ('README.md', 'glossary.md')""")
def flt14(spark, d):
    return derive(spark, d, "wiki").where(T.lacks_source_reference("path", "content")).select("path")
