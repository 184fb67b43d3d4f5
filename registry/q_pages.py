"""Page corpus, link graph and relationship queries over the derived wiki and the HTML pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import html
from corpusloom.functions import text as T
from corpusloom.operators import graph as G
from corpusloom.operators import pages as P
from corpusloom.sources import scan
from registry import sqlkit as S
from registry.base import query, table
from registry.inputs import cte, derive
from registry.q_search import CTX, context_rows, page_fields
from registry.q_text import LABEL_HEAD, LABEL_SENTENCE, SECTION_LABEL, WEB_LINKS

BS = chr(92)
FM = r"(?s)^---\n(.*?)\n---(?:\n|$)"


def _fm(key: str) -> str:
    return f"nullif(regexp_extract(fm, '(?m)^{key}:[ \\t]*(.*)$', 1), '')"


_STEM = f"regexp_replace({S.base_name('path')}, '\\.md$', '')"
PG = f"""{cte('wiki')},
fmx AS (SELECT doc_id, path, content AS raw, regexp_extract(content, '{FM}', 1) AS fm, regexp_replace(content, '{FM}', '') AS body FROM wiki),
pg AS (SELECT doc_id, path, fm, body, coalesce({_fm('title')}, nullif({S.strip("regexp_extract(body, '(?m)^#" + BS + "s+(.+)$', 1)")}, ''), {_STEM}) AS title,
  coalesce({_fm('title')}, {_STEM}) AS listed_title, {_fm('description')} AS description, {_fm('category')} AS category,
  regexp_replace(body, '^\\s*#\\s+[^\\n]+\\n*', '') AS content,
  CASE WHEN fm <> '' THEN list_filter(list_transform(string_split(coalesce({_fm('related')}, ''), ','), lambda x: trim(x)), lambda x: x <> '') ELSE [] END AS related FROM fmx)"""


def wiki_pages(spark, d):
    return P.parse_pages(derive(spark, d, "wiki"))


# --- parsing ----------------------------------------------------------------------------
@query("src4_parsed_pages", f"WITH {PG} SELECT path, title, listed_title, description, category, body, content FROM pg")
def src4(spark, d):
    return wiki_pages(spark, d).select("path", "title", "listed_title", "description", "category", "body", "content")


@query("src4_front_matter", f"""
WITH {PG}, kv AS (SELECT path, unnest(string_split(fm, chr(10))) AS l FROM pg WHERE fm <> '')
SELECT path, regexp_extract(l, '^([A-Za-z_][\\w-]*):', 1) AS name, trim(regexp_extract(l, '^[^:]*:(.*)$', 1)) AS value FROM kv
WHERE regexp_matches(l, '^[A-Za-z_][\\w-]*:')""")
def src4b(spark, d):
    return wiki_pages(spark, d).select("path", F.explode("frontmatter").alias("name", "value"))


HEADS = f"""hd AS (SELECT path, unnest(range(0, len(m))) AS pos, unnest(m) AS m, unnest(t) AS t FROM
  (SELECT path, regexp_extract_all(content, '(?m)^(#{{1,6}})\\s+(.+)$', 1) AS m, regexp_extract_all(content, '(?m)^(#{{1,6}})\\s+(.+)$', 2) AS t FROM pg)),
hs AS (SELECT path, pos, length(m) AS level, {S.strip('t')} AS text, {S.site_slug(S.strip('t'))} AS id FROM hd)"""


@query("txt9_headings", f"WITH {PG}, {HEADS} SELECT path, pos, level, text, id FROM hs")
def txt9(spark, d):
    return P.heading_rows(wiki_pages(spark, d))


@query("txt10_code_blocks", f"""
WITH {PG}, cb AS (SELECT path, unnest(range(0, len(m))) AS pos, unnest(m) AS m, unnest(t) AS code FROM
  (SELECT path, regexp_extract_all(content, '(?s)```(\\w*)\\n(.*?)```', 1) AS m, regexp_extract_all(content, '(?s)```(\\w*)\\n(.*?)```', 2) AS t FROM pg))
SELECT path, pos, CASE WHEN m = '' THEN 'text' ELSE m END AS language, code,
  nullif({S.strip("regexp_extract(code, '(?://|#)" + BS + "s*Source:" + BS + "s*([^" + BS + "n]+)', 1)")}, '') AS source_ref FROM cb WHERE m <> 'mermaid'""")
def txt10(spark, d):
    return P.code_blocks(wiki_pages(spark, d))


@query("txt11_diagrams", f"""
WITH {PG}, dg AS (SELECT path, regexp_extract_all(content, '(?s)```mermaid\\n(.*?)```', 1) AS t FROM pg)
SELECT path, pos, {S.strip('x')} AS diagram FROM (SELECT path, unnest(range(0, len(t))) AS pos, unnest(t) AS x FROM dg)""")
def txt11(spark, d):
    return P.diagrams(wiki_pages(spark, d))


@query("txt12_titles", f"WITH {PG} SELECT path, title FROM pg")
def txt12(spark, d):
    return wiki_pages(spark, d).select("path", "title")


@query("txt16_best_heading", f"""
WITH {PG}, h AS (SELECT path, unnest(range(0, len(t))) AS i, unnest(t) AS t, ws FROM
  (SELECT path, regexp_extract_all(content, '(?m)^#+\\s+(.+)$', 1) AS t, {S.words("title || ' ' || path")} AS ws FROM pg)),
sc AS (SELECT path, i, t, len(list_filter(ws, lambda w: contains(lower(t), w))) AS s FROM h)
SELECT path, arg_min(t, i) AS heading FROM sc WHERE s > 0 AND (path, s) IN (SELECT (path, max(s)) FROM sc GROUP BY path) GROUP BY path""")
def txt16(spark, d):
    best = P.best_heading("content", F.concat("title", F.lit(" "), "path"))
    rows = wiki_pages(spark, d).select("path", best.alias("h")).where("h IS NOT NULL")
    return rows.select("path", F.col("h.text").alias("heading"))


# --- links --------------------------------------------------------------------------------
LK = f"""
md AS (SELECT path, regexp_extract_all(body, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 1) AS a, regexp_extract_all(body, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 2) AS b,
  list_transform(regexp_extract_all(body, '\\[\\[([^\\]|]+)(?:\\|[^\\]]+)?\\]\\]', 1), lambda x: {S.strip('x')}) AS w FROM pg),
al AS (SELECT path AS source, a || w AS ts, b || list_transform(w, lambda x: CASE WHEN ends_with(x, '.md') THEN x ELSE x || '.md' END) AS gs, len(a) AS nmd FROM md),
lk AS (SELECT source, unnest(range(0, len(ts))) AS pos, unnest(ts) AS link_text, unnest(gs) AS target, nmd FROM al)"""
_SCOPE = r"^(?:http://|https://|#|mailto:)|github\.com|(?i:\.(?:ts|js|py|go|rs|java|tsx|jsx|cbl|cob|cpy|jcl)[:L#])"
_SCOPE_ALL = r"^(?:http://|https://|#)|github\.com|\.(?:ts|js|py|go|rs|java|tsx|jsx)[:L#]"
# resolve by rewriting: drop ./ then remove name/.. pairs; the inputs nest no deeper than two levels
_CLEAN = "string_split(target, '#')[1]"
_JOINED = f"(CASE WHEN instr(source, '/') > 0 THEN regexp_extract(source, '^(.*)/[^/]*$', 1) || '/' ELSE '' END) || {_CLEAN}"
_NODOT = f"regexp_replace({_JOINED}, '(^|/)(?:\\./)+', '\\1', 'g')"
_RES = f"regexp_replace(regexp_replace({_NODOT}, '(^|/)[^/.][^/]*/\\.\\./', '\\1'), '(^|/)[^/.][^/]*/\\.\\./', '\\1')"
PL = f"""pl AS (SELECT source, pos, link_text, {_CLEAN} AS target, {_RES} AS resolved_target, nmd FROM lk
  WHERE NOT regexp_matches(target, '{_SCOPE}') AND (ends_with(target, '.md') OR contains(target, '.md#'))),
pin AS (SELECT * FROM pl WHERE NOT starts_with(resolved_target, '..'))"""


def found_links(spark, d, **kw):
    pages = wiki_pages(spark, d)
    return G.page_links(pages, **kw), pages


@query("txt13_links", f"WITH {PG}, {LK} SELECT source, pos, link_text, target FROM lk")
def txt13(spark, d):
    return G.links(wiki_pages(spark, d))


@query("flt8_link_scope", f"WITH {PG}, {LK} SELECT source, pos, target FROM lk WHERE NOT regexp_matches(target, '{_SCOPE}')")
def flt8(spark, d):
    return G.links(wiki_pages(spark, d)).where(G.in_scope("target")).select("source", "pos", "target")


@query("grf1_resolved_links", f"WITH {PG}, {LK}, {PL} SELECT source, pos, resolved_target FROM pin")
def grf1(spark, d):
    return found_links(spark, d)[0].select("source", "pos", "resolved_target")


@query("grf2_broken_links", f"""
WITH {PG}, {LK}, {PL}
SELECT source, link_text, target, resolved_target FROM (SELECT *, row_number() OVER (PARTITION BY resolved_target ORDER BY source, pos) AS n
  FROM pin WHERE resolved_target NOT IN (SELECT path FROM pg)) WHERE n = 1""")
def grf2(spark, d):
    return G.broken_links(*found_links(spark, d))


@query("grf3_broken_links_all", f"""
WITH {PG}, {LK}, p3 AS (SELECT source, pos, link_text, {_CLEAN} AS target, {_RES} AS resolved_target FROM lk
  WHERE pos < nmd AND NOT regexp_matches(target, '{_SCOPE_ALL}') AND (ends_with(target, '.md') OR contains(target, '.md#')))
SELECT * FROM p3 WHERE resolved_target NOT IN (SELECT path FROM pg)""")
def grf3(spark, d):
    found, pages = found_links(spark, d, strict=False, wiki=False, escapes=True)
    return G.broken_links(found, pages, dedupe=False)


_ASSET = "'assets/' || regexp_extract(text, '([a-z]{3,})', 1) || '.png'"


@query("grf4_link_warnings", f"""
WITH {PG}, {LK}, w AS (SELECT source, pos, target, {_RES} AS resolved_target FROM lk WHERE pos < nmd AND regexp_matches(target, '^\\.\\.?/'))
SELECT source, pos, target, resolved_target FROM w
WHERE NOT ends_with(resolved_target, '.md') AND resolved_target NOT IN (SELECT {_ASSET} FROM documents WHERE doc_id % 2 = 0)""")
def grf4(spark, d):
    """Pictures and files that whole pages link to; the first word of every other document names a known picture."""
    known = table(spark, d, "documents").where("doc_id % 2 = 0").selectExpr(f"{_ASSET} AS path")
    return G.link_warnings(wiki_pages(spark, d), known)


@query("set2_missing_pages", f"WITH {PG}, {LK}, {PL} SELECT DISTINCT resolved_target AS path FROM pin WHERE resolved_target NOT IN (SELECT path FROM pg)")
def set2(spark, d):
    return G.missing_targets(*found_links(spark, d))


@query("agg10_link_report", f"""
WITH {PG}, {LK}, {PL}
SELECT (SELECT count(*) FROM pg) AS total_pages, count(DISTINCT resolved_target) AS referenced_pages,
  count(DISTINCT CASE WHEN resolved_target NOT IN (SELECT path FROM pg) THEN resolved_target END) AS missing_pages,
  count(CASE WHEN resolved_target NOT IN (SELECT path FROM pg) THEN 1 END) AS broken_links FROM pin""")
def agg10(spark, d):
    return G.link_report(*found_links(spark, d))


@query("agg14_broken_by_target", f"""
WITH {PG}, {LK}, {PL}, u AS (SELECT DISTINCT resolved_target, source FROM pin WHERE resolved_target NOT IN (SELECT path FROM pg))
SELECT resolved_target, count(*) AS sources, list_sort(list(source))[1:3] AS first_sources, greatest(count(*) - 3, 0) AS more FROM u GROUP BY resolved_target""")
def agg14(spark, d):
    return G.broken_by_target(*found_links(spark, d))


# --- HTML pages as a link graph ------------------------------------------------------------------
@query("grf2_broken_web_links", f"""
WITH {WEB_LINKS}, l AS (SELECT page_id, link FROM weblinks WHERE link IS NOT NULL)
SELECT link, count(*) AS n, min(page_id) AS first_page FROM l WHERE link NOT IN (SELECT url FROM pages) GROUP BY link""")
def grf2web(spark, d):
    pages = table(spark, d, "pages")
    found = html.html_links(pages, "html", "url", "page_id")
    per = found.groupBy("link").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))
    return per.join(pages.select(F.col("url").alias("link")), "link", "left_anti")


# --- related pages, order, navigation ---------------------------------------------------------------
SIB = f"""dirs AS (SELECT path, {S.dir_name('path')} AS dir FROM pg),
sb AS (SELECT path, other, pos FROM (SELECT a.path, b.path AS other, row_number() OVER (PARTITION BY a.path ORDER BY b.path) - 1 AS pos
  FROM dirs a JOIN dirs b ON a.dir = b.dir AND a.path <> b.path AND a.dir <> '.') WHERE pos < 3)"""


@query("win4_siblings", f"WITH {PG}, {SIB} SELECT path, pos, other AS sibling FROM sb")
def win4(spark, d):
    return P.siblings(wiki_pages(spark, d))


@query("grf5_related_pages", f"""
WITH {PG}, {SIB},
dc AS (SELECT path, unnest(range(0, len(related))) AS pos, unnest(related) AS name FROM pg),
rl AS (SELECT dc.path, 0 AS kind, pos, p.path AS other FROM dc JOIN pg p ON p.path = name OR p.path = name || '.md'
  UNION ALL SELECT path, 1, pos, other FROM sb),
o AS (SELECT path, other, min((kind, pos)) AS o FROM rl GROUP BY ALL)
SELECT path, rank, other AS related FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY o, other) AS rank FROM o) WHERE rank <= 5""")
def grf5(spark, d):
    return P.related_pages(wiki_pages(spark, d))


@query("win6_page_order", f"WITH {PG} SELECT path, row_number() OVER (ORDER BY path <> 'README.md', path) AS ord FROM pg")
def win6(spark, d):
    return P.ordered_pages(wiki_pages(spark, d)).select("path", "ord")


_SEC = "CASE WHEN instr(path, '/') > 0 THEN string_split(path, '/')[1] ELSE 'Overview' END"
NAV = f"""nav AS (SELECT path, title, description, section, CASE section WHEN 'Overview' THEN 1 WHEN 'architecture' THEN 2 WHEN 'components' THEN 3
  WHEN 'guides' THEN 4 WHEN 'api' THEN 5 WHEN 'reference' THEN 6 ELSE 7 END AS section_rank, (path <> 'README.md')::INT AS home,
  regexp_replace(path, '\\.md$', '.html') AS html_path,
  array_to_string(list_transform(string_split(section, '-'), lambda w: {S.upper_first('w')}), ' ') AS section_title
  FROM (SELECT *, {_SEC} AS section FROM pg))"""


@query("agg8_navigation", f"WITH {PG}, {NAV} SELECT section_rank, section, section_title, home, path, html_path, title, description FROM nav")
def agg8(spark, d):
    return P.navigation(wiki_pages(spark, d))


@query("agg8_navigation_sections", f"""
WITH {PG}, {NAV} SELECT section_rank, section, section_title, arg_min(html_path, (home, path)) AS path, count(*) AS pages FROM nav GROUP BY ALL""")
def agg8b(spark, d):
    return P.navigation_sections(wiki_pages(spark, d))


@query("win3_previous_next", f"""
WITH {PG}, {NAV} SELECT row_number() OVER w AS pos, path, lag(path) OVER w AS previous, lead(path) OVER w AS next FROM nav
WINDOW w AS (ORDER BY section_rank, section, home, path)""")
def win3(spark, d):
    return P.neighbours(wiki_pages(spark, d))


@query("win8_page_toc", f"""
WITH {PG}, {HEADS}, t AS (SELECT *, count(*) OVER (PARTITION BY path) AS n, row_number() OVER (PARTITION BY path ORDER BY pos) - 1 AS p
  FROM hs WHERE level BETWEEN 2 AND 3)
SELECT path, p AS pos, level - 2 AS indent, text, id FROM t WHERE n >= 2""")
def win8(spark, d):
    return P.page_toc(wiki_pages(spark, d))


# --- listings and look-up ------------------------------------------------------------------------------
@query("agg7_category_counts", f"WITH {PG} SELECT coalesce(category, 'Uncategorized') AS category, count(*) AS pages FROM pg GROUP BY ALL")
def agg7(spark, d):
    return P.category_counts(wiki_pages(spark, d))


@query("agg7_category_listing", f"WITH {PG} SELECT coalesce(category, 'Uncategorized') AS category, listed_title AS title, path, description FROM pg")
def agg7b(spark, d):
    return P.category_listing(wiki_pages(spark, d))


@query("agg15_title_counts", f"WITH {PG} SELECT title, count(*) AS n FROM pg GROUP BY title")
def agg15(spark, d):
    return P.title_counts(wiki_pages(spark, d))


_REQ = "CASE doc_id % 4 WHEN 0 THEN path WHEN 1 THEN regexp_replace(path, '[.]md$', '') WHEN 2 THEN upper(path) ELSE 'none/' || path END"


@query("flt12_find_pages", f"""
WITH {PG}, rq AS (SELECT {_REQ} AS request FROM pg)
SELECT request, path, CASE WHEN path = request THEN 0 WHEN path = request || '.md' THEN 1 ELSE 2 END AS kind
FROM rq JOIN pg ON lower(path) = lower(request) OR lower(path) = lower(request) || '.md'""")
def flt12(spark, d):
    pages = wiki_pages(spark, d)
    return P.find_pages(pages.selectExpr(f"{_REQ} AS request"), pages)


@query("snk6_page_index", f"""
WITH {PG} SELECT regexp_replace(path, '\\.md$', '.html') AS path, title, description, substr({S.strip_markdown('content')}, 1, 5000) AS content,
  list_transform(regexp_extract_all(content, '(?m)^(#{{1,6}})\\s+(.+)$', 2), lambda t: {S.strip('t')}) AS headings FROM pg""")
def snk6(spark, d):
    return P.page_index(wiki_pages(spark, d))


# --- relationships -----------------------------------------------------------------------------------------
VERBS = ["uses", "calls", "depends", "imports", "extends", "implements", "sends", "receives", "triggers", "creates", "returns", "handles"]
_VERB = " ".join(
    f"WHEN regexp_matches(text, '{v}.{{0,30}}' || regexp_escape(first)) THEN '{v}'" for v in VERBS
)
CI = f"ci AS (SELECT query_id, rank, title, content || ' uses ' || title || ' calls ' || lower(title) AS content FROM ctx JOIN pf USING (doc_id))"
REL = f"""{CTX}, {CI},
ra AS (SELECT query_id, rank AS src, lower(content) AS text FROM ci),
rb AS (SELECT query_id, rank AS dst, lower(title) AS title, list_filter(string_split_regex(lower(title), '\\s+'), lambda w: length(w) > 3) AS words FROM ci),
re AS (SELECT query_id, src, dst, text, coalesce(words[1], title) AS first FROM ra JOIN rb USING (query_id)
  WHERE src <> dst AND (contains(text, title) OR len(list_filter(words, lambda w: contains(text, w))) > 0)),
rel AS (SELECT query_id, src, dst, CASE {_VERB} ELSE 'uses' END AS type FROM re)"""


def context_items(spark, d):
    pages = page_fields(spark, d).select("doc_id", "title", "content")
    body = F.concat("content", F.lit(" uses "), "title", F.lit(" calls "), F.lower("title"))
    return context_rows(spark, d).join(pages, "doc_id").select("query_id", "rank", "title", body.alias("content"))


@query("grf6_relationships", f"WITH {REL} SELECT query_id, src, dst, type FROM rel")
def grf6(spark, d):
    return G.relationships(context_items(spark, d))


@query("grf7_distinct_edges", f"WITH {REL} SELECT query_id, src, dst, min(type) AS type FROM rel GROUP BY ALL")
def grf7(spark, d):
    edges = G.relationships(context_items(spark, d))
    return G.distinct_edges(edges.unionByName(edges))


@query("grf8_fallback_edges", f"""
WITH {REL}, e AS (SELECT * FROM rel WHERE type = 'calls'),
bare AS (SELECT query_id, rank, count(*) OVER (PARTITION BY query_id) AS n, lead(rank) OVER (PARTITION BY query_id ORDER BY rank) AS nx
  FROM ci WHERE query_id NOT IN (SELECT query_id FROM e))
SELECT query_id, src, dst, type FROM e
UNION ALL SELECT query_id, 1, rank, '' FROM bare WHERE n > 3 AND rank <> 1
UNION ALL SELECT query_id, rank, nx, '' FROM bare WHERE n <= 3 AND nx IS NOT NULL""")
def grf8(spark, d):
    ctx = context_items(spark, d)
    edges = G.relationships(ctx).where("type = 'calls'")
    return G.with_fallback_edges(edges, ctx, codemap=True)


@query("win5_unique_titles", f"""
WITH {CTX}, wn AS (SELECT query_id, rank, title, content FROM ctx JOIN pf USING (doc_id)),
lb AS (SELECT *, {SECTION_LABEL} AS label FROM (SELECT *, {LABEL_HEAD} AS h, {LABEL_SENTENCE} AS sent, title AS t FROM wn)),
c AS (SELECT *, count(*) OVER (PARTITION BY query_id, title) AS cnt, sum(CASE WHEN label IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, title ORDER BY rank) AS nth,
  regexp_extract(content, '\\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\\b', 1) AS camel FROM lb)
SELECT query_id, rank, CASE WHEN cnt = 1 THEN title WHEN label IS NOT NULL THEN label WHEN camel <> '' THEN camel ELSE title || ' §' || nth END AS label FROM c""")
def win5(spark, d):
    pages = page_fields(spark, d).select("doc_id", "title", "content")
    ctx = context_rows(spark, d).join(pages, "doc_id").select("query_id", "rank", "title", "content")
    return G.unique_titles(ctx).select("query_id", "rank", "label")


@query("grf10_title_mentions", f"""
WITH {PG}, pt AS (SELECT doc_id AS ord, path, 'The ' || regexp_extract(content, '([a-z]{{5,7}})', 1) AS title FROM pg),
k AS (SELECT ord, path, title, lower(title) AS mention FROM pt UNION ALL SELECT ord, path, title, regexp_replace(lower(title), '^(?:the |a |an )', '') FROM pt),
km AS (SELECT mention, arg_max((path, title), (ord, path, title)) AS p FROM k WHERE length(mention) > 3 GROUP BY mention)
SELECT doc_id, mention, p[1] AS path, p[2] AS title FROM documents JOIN km ON contains(lower(text), mention)
  AND regexp_matches(lower(text), '(?:^|[^A-Za-z0-9_])' || regexp_escape(mention) || '(?:[^A-Za-z0-9_]|$)')""")
def grf10(spark, d):
    pages = wiki_pages(spark, d).select(
        F.col("doc_id").alias("ord"), "path",
        F.concat(F.lit("The "), F.regexp_extract("content", "([a-z]{5,7})", 1)).alias("title"),
    )
    return G.title_mentions(table(spark, d, "documents"), "doc_id", "text", pages)
