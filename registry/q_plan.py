"""Classification, profile, planning, change-set, sink and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import fixed
from corpusloom.functions import text as T
from corpusloom.operators import changes as X
from corpusloom.operators import classify as C
from corpusloom.operators import grams
from corpusloom.operators import index as I
from corpusloom.operators import segment as G
from corpusloom.operators import segments
from corpusloom.plans import pages_plan as PP
from corpusloom.plans import profile as P
from corpusloom.session import scratch_path, settle, with_global_rank
from corpusloom.sources import scan, sinks
from corpusloom.streaming import live_index
from registry import sqlkit as S
from registry.base import query, table
from registry.inputs import cte, derive
from registry.q_pages import LK, PG, wiki_pages

BS = chr(92)
FILES = cte("files")
EXT = S.extension("path")
DIR = S.dir_name("path")


def files(spark, d):
    return derive(spark, d, "files")


# --- scans --------------------------------------------------------------------------------
def _in_dirs(names):
    return f"len(list_intersect(string_split({DIR}, '/'), [{', '.join(repr(n) for n in names)}])) > 0"


@query("src1_indexable_files", f"""
WITH {FILES} SELECT DISTINCT path FROM files WHERE {S.suffix_any('path', fixed.INDEXABLE_EXTENSIONS)}
  AND NOT ({_in_dirs(fixed.EXCLUDED_DIRS)} OR {S.suffix_any('path', fixed.EXCLUDED_SUFFIXES)} OR {S.base_name('path')} IN {S.inlist(fixed.EXCLUDED_NAMES)})""")
def src1(spark, d):
    return scan.indexable_files(files(spark, d)).select("path")


_HIDDEN = f"len(list_filter(string_split({DIR}, '/'), lambda x: starts_with(x, '.') AND x <> '.')) > 0"
INV = f"inv AS (SELECT path, {EXT} AS ext, size FROM files WHERE {EXT} IN {S.inlist(fixed.INVENTORY_EXTENSIONS)} AND NOT {_in_dirs(fixed.INVENTORY_IGNORED_DIRS)} AND NOT {_HIDDEN})"
SRCF = f"srcf AS (SELECT path FROM files WHERE {EXT} IN {S.inlist(fixed.SOURCE_EXTENSIONS)} AND NOT {_in_dirs(fixed.SOURCE_IGNORED_DIRS)} AND NOT {_HIDDEN})"


@query("src2_project_inventory", f"WITH {FILES}, {INV} SELECT path, ext, size FROM inv")
def src2(spark, d):
    return scan.project_inventory(files(spark, d))


@query("src3_source_files", f"WITH {FILES}, {SRCF} SELECT path FROM srcf")
def src3(spark, d):
    return scan.source_files(files(spark, d))


_CHANGE_LINE = "CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'D' ELSE 'R100' END || chr(9) || path || CASE WHEN doc_id % 4 = 3 THEN chr(9) || 'new/' || path ELSE '' END"
CHG = """chg AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'M' ELSE 'D' END AS status, path FROM files
  UNION ALL SELECT 'A', 'new/' || path FROM files WHERE doc_id % 4 = 3)"""


def change_lines(spark, d):
    return files(spark, d).selectExpr(f"{_CHANGE_LINE} AS line")


@query("src5_parse_changes", f"WITH {FILES}, {CHG} SELECT status, path FROM chg")
def src5(spark, d):
    return scan.parse_changes(change_lines(spark, d))


@query("src6_changed_paths", f"WITH {FILES}, {CHG} SELECT DISTINCT path FROM chg")
def src6(spark, d):
    return scan.changed_paths(scan.parse_changes(change_lines(spark, d)))


# --- profile ---------------------------------------------------------------------------------
@query("agg4_extension_counts", f"WITH {FILES} SELECT {EXT} AS ext, count(*) AS n FROM files GROUP BY ALL")
def agg4(spark, d):
    return P.extension_counts(files(spark, d))


@query("agg4_language_counts", f"WITH {FILES} SELECT {S.mapping(EXT, fixed.INDEX_LANGUAGES, repr(''))} AS language, count(*) AS n FROM files GROUP BY ALL")
def agg4b(spark, d):
    return P.language_counts(files(spark, d))


@query("agg5_totals", f"WITH {FILES} SELECT count(*) AS files, sum(size)::BIGINT AS total_size FROM files")
def agg5(spark, d):
    return P.totals(files(spark, d))


@query("agg5_largest_files", f"WITH {FILES} SELECT path, size FROM files ORDER BY size DESC, path LIMIT 10")
def agg5b(spark, d):
    return P.largest(files(spark, d))


@query("agg6_estimate", f"""
WITH {FILES}, t AS (SELECT count(*) AS files, sum(size)::BIGINT AS total_size, ceil(sum(size) / 1500.0::DOUBLE)::BIGINT AS chunks FROM files)
SELECT files, total_size, chunks, chunks * 375 AS tokens, round(chunks * 375 * 2 / 1e6 * 3, 2) AS input_cost, round(chunks * 375 * 0.5::DOUBLE / 1e6 * 15, 2) AS output_cost,
  round(chunks * 375 * 2 / 1e6 * 3 + chunks * 375 * 0.5::DOUBLE / 1e6 * 15, 2) AS total_cost, round(files / 100::DOUBLE, 1) AS indexing_minutes,
  round(ceil(files / 10::DOUBLE) * 0.5::DOUBLE, 1) AS generation_minutes, round(files / 100::DOUBLE + ceil(files / 10::DOUBLE) * 0.5::DOUBLE, 1) AS total_minutes FROM t""")
def agg6(spark, d):
    return P.estimate(files(spark, d))


@query("agg6_local_estimate", f"""
WITH {FILES}, t AS (SELECT ceil(sum(size) / 1500.0::DOUBLE)::BIGINT AS chunks FROM files)
SELECT chunks * 375 AS tokens, round(chunks * 375 * 2.5::DOUBLE / 20 / 60, 1) AS generation_minutes, round(chunks * 0.001::DOUBLE, 1) AS cache_gb FROM t""")
def agg6b(spark, d):
    return P.local_estimate(files(spark, d), 20)


@query("agg9_indexed_files", """
SELECT source AS path FROM documents GROUP BY source""")
def agg9(spark, d):
    return P.indexed_files(table(spark, d, "documents").select(F.col("source").alias("path")))


@query("agg11_bundle_manifest", f"""
WITH {PG}, w AS (SELECT path, strlen(body) AS size FROM pg)
SELECT count(*) AS page_count, sum(size)::BIGINT AS wiki_size, (SELECT count(*) FROM documents) AS chunk_count FROM w""")
def agg11(spark, d):
    return P.bundle_manifest(the_bundle(spark, d))


@query("agg12_batch_plan", """
WITH t AS (SELECT count(*) AS n FROM documents), b AS (SELECT unnest(range(0, ceil(n / 30::DOUBLE)::BIGINT)) AS i, n FROM t)
SELECT i + 1 AS batch, ceil(n / 30::DOUBLE)::BIGINT AS total_batches, n AS total_chunks, i * 30 AS batch_start, least(i * 30 + 30, n) AS batch_end, least(i * 30 + 30, n) - i * 30 AS chunks_in_batch FROM b""")
def agg12(spark, d):
    return P.batch_plan(table(spark, d, "documents"), 30)


@query("agg12_batch_of_chunk", """
SELECT doc_id, (row_number() OVER (ORDER BY source, doc_id) - 1) // 30 + 1 AS batch FROM documents""")
def agg12b(spark, d):
    ranked = with_global_rank(table(spark, d, "documents").select("source", "doc_id"), [F.col("source"), F.col("doc_id")])
    return ranked.select("doc_id", (F.floor((F.col("pos") - 1) / 30) + 1).alias("batch"))


_PARTS = f"list_filter(string_split({DIR}, '/'), lambda x: x NOT IN ('src', 'lib', 'app'))"
DST = f"""dst AS (SELECT dir, count(*) AS files, arg_min(depth, path) AS depth, bool_or(ends_with(path, '/index.ts') OR ends_with(path, '/index.tsx')) AS has_index, min(path) AS first_path
  FROM (SELECT path, {_PARTS}[1] AS dir, len({_PARTS})::INT AS depth FROM files WHERE {DIR} <> '.' AND len({_PARTS}) > 0) GROUP BY dir)"""


@query("agg13_directory_structure", f"WITH {FILES}, {DST} SELECT dir, files, depth, has_index, first_path FROM dst")
def agg13(spark, d):
    return P.directory_structure(files(spark, d))


@query("win7_top_extensions", f"WITH {FILES} SELECT {EXT} AS ext, count(*) AS n FROM files GROUP BY ALL ORDER BY n DESC, ext LIMIT 5")
def win7(spark, d):
    return P.top_extensions(files(spark, d), 5)


_ANCH = "|".join(f"(?:{p})" for p in fixed.ANCHORED_ENTRY_PATTERNS)
ENTRIES = f"""SELECT path FROM (SELECT DISTINCT path, CASE WHEN regexp_matches(path, '{_ANCH}') THEN 0 ELSE 1 END AS kind FROM files
  WHERE regexp_matches(path, '{_ANCH}') OR {S.suffix_any('path', fixed.INDEX_FILE_SUFFIXES)} ORDER BY kind, path LIMIT 20)"""


@query("flt5_anchored_entry_points", f"WITH {FILES} {ENTRIES}")
def flt5(spark, d):
    return P.entry_points(files(spark, d)).select("path")


# --- labels ---------------------------------------------------------------------------------------
DICT = """dict AS (SELECT 'cat-' || (item_id % 12) AS category, w AS keyword, min(item_id * 100000 + i) AS ord FROM
  (SELECT item_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{5,}') AS ws FROM benchmark)) GROUP BY ALL)"""
LAB = f"""lb AS (SELECT doc_id, category, list(keyword ORDER BY category, ord, keyword) AS keywords,
    least(sum(CASE WHEN contains(lower(title), keyword) THEN 3 WHEN contains(lower(description), keyword) THEN 2 ELSE 1 END) / 10::DOUBLE, 1) AS confidence,
    arg_min(CASE WHEN contains(lower(title), keyword) THEN 'name' WHEN contains(lower(description), keyword) THEN 'documentation' ELSE 'content' END, (ord, keyword)) AS source
  FROM fields, dict WHERE contains(lower(title || ' ' || description || '  ' || content), keyword) GROUP BY doc_id, category),
lr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, category) AS n FROM lb)"""


def dictionary(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), 0)
    rows = table(spark, d, "benchmark").select("item_id", F.posexplode(words).alias("i", "keyword"))
    return rows.groupBy(
        F.concat(F.lit("cat-"), F.col("item_id") % 12).alias("category"), "keyword"
    ).agg(F.min(F.col("item_id") * 100000 + F.col("i") + 1).alias("ord"))


def label_input(spark, d):
    return derive(spark, d, "fields").select(
        "doc_id", F.col("title").alias("name"), F.col("description").alias("documentation"),
        F.array().cast("array<string>").alias("decorators"), "content",
    )


def exploded_labels(labelled):
    rows = labelled.select("doc_id", F.inline("labels"))
    return rows.select("doc_id", "category", F.round("confidence", 6).alias("confidence"), "source", "keywords")


@query("cls1_domain_labels", f"""
WITH {cte('fields')}, {DICT}, {LAB} SELECT doc_id, category, round(confidence, 6) AS confidence, source, keywords FROM lr WHERE n <= 3""")
def cls1(spark, d):
    return exploded_labels(C.label_domains(label_input(spark, d), dictionary(spark, d)))


_DEFAULT = ", ".join(
    f"('{c}', '{w}', {i})" for i, c in enumerate(fixed.LABEL_CATEGORIES) if c != "unknown" for w in c.split("-")
)


@query("cls1_default_labels", f"""
WITH {cte('fields')}, dict AS (SELECT * FROM (VALUES {_DEFAULT}) t(category, keyword, ord)), {LAB}
SELECT doc_id, category, round(confidence, 6) AS confidence, source, keywords FROM lr WHERE n <= 3""")
def cls1_default(spark, d):
    """The way for dictionaries that become a constant."""
    return exploded_labels(C.label_domains(label_input(spark, d), C.default_dictionary(spark)))


@query("cls1_domain_labels_by_join", f"""
WITH {cte('fields')}, {DICT}, {LAB} SELECT doc_id, category, round(confidence, 6) AS confidence, source, keywords FROM lr WHERE n <= 3""")
def cls1b(spark, d):
    """The way for dictionaries beyond the constant's bound, on the same input."""
    chunks = label_input(spark, d)
    parts = chunks.select(
        "doc_id", F.lower("name").alias("_name"), F.lower("documentation").alias("_doc"),
        F.lower(F.concat_ws(" ", "name", "documentation", F.lit(""), "content")).alias("_all"),
    )
    return exploded_labels(C._label_by_join(parts, dictionary(spark, d), "doc_id", 3))


@query("cls2_confident_categories", f"""
WITH {cte('fields')}, {DICT}, {LAB} SELECT doc_id, coalesce(list(category ORDER BY n) FILTER (n <= 3 AND confidence > 0.3), []) AS categories
FROM documents LEFT JOIN lr USING (doc_id) GROUP BY doc_id""")
def cls2(spark, d):
    labelled = C.label_domains(label_input(spark, d), dictionary(spark, d))
    return labelled.select("doc_id", C.confident_categories("labels").alias("categories"))


@query("cls5_dominant_extension", f"""
WITH {FILES}, {INV}, e AS (SELECT ext, count(*) AS n FROM inv GROUP BY ext)
SELECT ext, n, {S.mapping('ext', fixed.EXTENSION_PROJECT_TYPES, repr('Software'))} AS project_type FROM e ORDER BY n DESC, ext LIMIT 1""")
def cls5(spark, d):
    return C.dominant_extension(scan.project_inventory(files(spark, d)))


_DEPS = ["next", "react", "vue", "svelte", "express", "fastify", "@anthropic-ai/sdk", "other"]
_DEP = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_DEPS)) + " END"
_MAN = f"""CASE doc_id % 13 WHEN 0 THEN 'not json' WHEN 1 THEN '{{"bin": "x.js"}}' WHEN 2 THEN '{{"devDependencies": {{"' || {_DEP} || '": "1"}}}}'
  ELSE '{{"dependencies": {{"' || {_DEP} || '": "1"}}}}' END"""
_MPATH = "CASE doc_id % 5 WHEN 1 THEN 'Cargo.toml' WHEN 2 THEN 'go.mod' WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'pyproject.toml' ELSE 'lib/x.c' END ELSE 'package.json' END"


@query("cls6_manifest_project_type", f"""
WITH m AS (SELECT doc_id, 'c' || doc_id AS corpus_id, {_MPATH} AS path, {_MAN} AS content, {_DEP} AS dep FROM documents),
k AS (SELECT *, path = 'package.json' AND content <> 'not json' AS ok FROM m)
SELECT corpus_id, CASE WHEN ok AND doc_id % 13 = 1 THEN 'CLI tool'
   WHEN ok AND dep IN ('next', 'react', 'vue', 'svelte') THEN 'web app' WHEN ok AND dep IN ('express', 'fastify') THEN 'server'
   WHEN ok AND dep = '@anthropic-ai/sdk' THEN 'AI application' WHEN ok THEN 'Node.js project'
   WHEN path = 'Cargo.toml' THEN 'Rust project' WHEN path = 'go.mod' THEN 'Go project' WHEN path = 'pyproject.toml' THEN 'Python project' ELSE 'software project' END AS type,
  CASE WHEN ok AND doc_id % 13 <> 1 THEN CASE dep WHEN 'next' THEN 'Next.js' WHEN 'react' THEN 'React' WHEN 'vue' THEN 'Vue' WHEN 'svelte' THEN 'Svelte'
    WHEN 'express' THEN 'Express' WHEN 'fastify' THEN 'Fastify' WHEN '@anthropic-ai/sdk' THEN 'Anthropic SDK' END END AS framework,
  CASE WHEN ok THEN 'TypeScript' WHEN path = 'Cargo.toml' THEN 'Rust' WHEN path = 'go.mod' THEN 'Go' WHEN path = 'pyproject.toml' THEN 'Python' ELSE 'unknown' END AS language FROM k""")
def cls6(spark, d):
    rows = table(spark, d, "documents").selectExpr("concat('c', doc_id) AS corpus_id", f"{_MPATH} AS path", f"{_MAN} AS content")
    return C.manifest_project_type(rows)


_KIND = S.mapping("lower(dir)", {k: v[0] for k, v in fixed.DIRECTORY_PAGE_TYPES.items()}, "NULL")
_PREF = S.mapping("lower(dir)", {k: v[1] for k, v in fixed.DIRECTORY_PAGE_TYPES.items()}, "NULL")
_NT = ("array_to_string(list_transform(string_split(" + S.rx("translate(dir, '-_', '  ')", "([a-z])([A-Z])", BS + "1 " + BS + "2")
       + ", ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')")
PTY = f"""pty AS (SELECT dir, first_path, files, {_NT} AS title, CASE WHEN {_KIND} IS NOT NULL THEN lower(dir) ELSE regexp_replace(lower(dir), '[^a-z0-9]', '-', 'g') END || '.md' AS filename,
  coalesce({_KIND}, 'module') AS type, CASE WHEN {_KIND} IS NOT NULL THEN {_PREF} || ' in the ' || {_NT} || ' directory' ELSE 'The ' || {_NT} || ' module and its functionality' END AS context
  FROM dst WHERE lower(dir) NOT IN {S.inlist(fixed.SKIPPED_PAGE_DIRS)} AND ({_KIND} IS NOT NULL OR files >= 5))"""


@query("cls7_directory_page_type", f"WITH {FILES}, {DST}, {PTY} SELECT dir, title, filename, type, context FROM pty")
def cls7(spark, d):
    return C.page_type(P.directory_structure(files(spark, d))).select("dir", "title", "filename", "type", "context")


_KW = "CASE doc_id % 9 WHEN 0 THEN 'Overview' WHEN 1 THEN 'components' WHEN 2 THEN 'Endpoint' WHEN 3 THEN 'routes' WHEN 4 THEN 'Tutorial' WHEN 5 THEN 'configuration' WHEN 6 THEN 'API' WHEN 7 THEN 'getting-started' ELSE lang END"


@query("cls8_normalize_page_type", f"""
SELECT doc_id, CASE WHEN k = 'overview' THEN 'overview' WHEN k IN ('component', 'components') THEN 'component' WHEN k IN ('api', 'endpoint', 'routes') THEN 'api'
  WHEN k IN ('guide', 'tutorial', 'getting-started') THEN 'guide' WHEN k IN ('config', 'configuration') THEN 'config' ELSE 'module' END AS type
FROM (SELECT doc_id, lower({_KW}) AS k FROM documents)""")
def cls8(spark, d):
    return table(spark, d, "documents").select("doc_id", C.normalize_page_type(F.expr(_KW)).alias("type"))


# --- plans --------------------------------------------------------------------------------------------
@query("pln1_minimum_pages", f"""
WITH {FILES} SELECT count(*) AS source_files, greatest(5, least(25, ceil(count(*) / 8::DOUBLE)::BIGINT)) AS min_pages FROM files WHERE {EXT} NOT IN {S.inlist(fixed.DOC_EXTENSIONS)}""")
def pln1(spark, d):
    return P.minimum_pages(files(spark, d))


_EXIST = """ex AS (SELECT 'Page ' || source AS title FROM documents WHERE n_chars > 20000 GROUP BY source),
cov AS (SELECT path FROM files WHERE size > 1500)"""
_DT = "array_to_string(list_transform(string_split_regex(key, '[-_/]'), lambda w: upper(w[1]) || w[2:]), ' ')"
_SLUG = S.rx(S.rx("lower(title)", "[^a-z0-9]+", "-"), "^-+|-+$", "")


_COVER = f"""{_EXIST},
op AS (SELECT path, {DIR} AS dir, {EXT} AS ext FROM files WHERE path NOT IN (SELECT path FROM cov)),
d AS (SELECT 1 AS place, CASE WHEN dir = '.' THEN 'root' ELSE dir END AS key, count(*) AS n, min(path) AS first FROM op GROUP BY dir HAVING count(*) >= 2),
dt AS (SELECT *, CASE WHEN key = 'root' THEN 'Core Modules' ELSE {_DT} END AS title, 'Source files in ' || key || ' - part of Mixed' AS context FROM d),
e AS (SELECT 2 AS place, ext AS key, count(*) AS n, min(path) AS first FROM op GROUP BY ext HAVING count(*) >= 3),
et AS (SELECT *, {S.mapping('key', fixed.COVERAGE_EXTENSION_TITLES, "upper(replace(key, '.', '')) || ' Files'")} AS title, n || ' ' || key || ' files in the project' AS context FROM e),
al AS (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY place, CASE WHEN place = 1 THEN -n ELSE 0 END, CASE WHEN place = 1 THEN key ELSE first END) AS r
  FROM (SELECT * FROM dt UNION ALL SELECT * FROM et) WHERE lower(title) NOT IN (SELECT lower(title) FROM ex)),
rk AS (SELECT *, row_number() OVER (ORDER BY place, CASE WHEN place = 1 THEN -n ELSE 0 END, CASE WHEN place = 1 THEN key ELSE first END) AS ord FROM al WHERE r = 1),
plan AS (SELECT place, key, ord, title, {_SLUG} || '.md' AS filename, context FROM rk WHERE ord <= 25 - (SELECT count(*) FROM ex))"""


def coverage(spark, d):
    pages = table(spark, d, "documents").where("n_chars > 20000").select(F.concat(F.lit("Page "), "source").alias("title")).distinct()
    fs = files(spark, d)
    return fs, fs.where("size > 1500"), PP.coverage_plan(fs, pages, fs.where("size > 1500"), 25, "Mixed")


@query("pln2_coverage_plan", f"WITH {FILES}, {_COVER} SELECT ord, title, filename, context FROM plan")
def pln2(spark, d):
    return coverage(spark, d)[2].select("ord", "title", "filename", "context")


@query("pln2_coverage_plan_files", f"""
WITH {FILES}, {_COVER},
l AS (SELECT path, place, key, row_number() OVER (PARTITION BY place, key ORDER BY path)::INT AS pos FROM (
  SELECT path, 1 AS place, CASE WHEN dir = '.' THEN 'root' ELSE dir END AS key FROM op UNION ALL SELECT path, 2, ext FROM op))
SELECT filename, pos, path FROM plan JOIN l USING (place, key) WHERE pos <= 10""")
def pln2b(spark, d):
    return PP.coverage_plan_files(*coverage(spark, d))


_COMP = f"""rw AS (SELECT path, string_split(path, '/')[1] AS top, {EXT} AS ext FROM files),
d AS (SELECT 1 AS place, top AS key, count(*) AS n, min(path) AS first FROM rw WHERE top NOT IN ('node_modules', '.git', 'dist', 'build') GROUP BY top HAVING count(*) >= 2),
e AS (SELECT 2 AS place, ext AS key, count(*) AS n, min(path) AS first FROM rw GROUP BY ext HAVING count(*) >= 3),
md AS (SELECT *, {_DT} AS title, 'Files in the ' || key || ' directory' AS context, {S.rx(S.rx("lower(key)", "[^a-z0-9]+", "-"), "^-+|-+$", "")} || '.md' AS filename FROM d
  UNION ALL SELECT *, {S.mapping('key', fixed.PLAN_EXTENSION_TITLES, "upper(replace(key, '.', '')) || ' Files'")} AS title, n || ' ' || key || ' files in the project', {_SLUG} || '.md' FROM e),
mr AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY place, CASE WHEN place = 1 THEN -n ELSE 0 END, CASE WHEN place = 1 THEN key ELSE first END) AS r FROM md),
mo AS (SELECT *, row_number() OVER (ORDER BY place, CASE WHEN place = 1 THEN -n ELSE 0 END, CASE WHEN place = 1 THEN key ELSE first END) AS ord FROM mr WHERE place = 1 OR r = 1),
plan AS (SELECT 0 AS place, 0 AS ord, 'Architecture Overview' AS title, 'architecture.md' AS filename, 'overview' AS type, 'High-level architecture of this Mixed project' AS context, NULL AS key
  UNION ALL SELECT place, ord, title, filename, 'module', context, key FROM mo WHERE ord <= 18
  UNION ALL SELECT 3, 0, 'Getting Started', 'getting-started.md', 'guide', 'Setup and development workflow', NULL)"""


@query("pln3_comprehensive_plan", f"WITH {FILES}, {_COMP} SELECT place, ord, title, filename, type, context FROM plan")
def pln3(spark, d):
    return PP.comprehensive_plan(files(spark, d), 20, F.lit("Mixed")).drop("key")


_ENTRY = "|".join(f"(?:{p})" for p in fixed.ENTRY_POINT_PATTERNS)


@query("pln3_comprehensive_plan_files", f"""
WITH {FILES}, {_COMP},
ld AS (SELECT path, top AS key, row_number() OVER (PARTITION BY top ORDER BY path) AS n, 1 AS place FROM rw),
le AS (SELECT path, ext AS key, row_number() OVER (PARTITION BY ext ORDER BY path) AS n, 2 AS place FROM rw)
SELECT filename, path FROM plan JOIN (SELECT * FROM ld UNION ALL SELECT * FROM le) l ON l.place = plan.place AND l.key = plan.key AND n <= 10
UNION ALL SELECT 'architecture.md', path FROM (SELECT path FROM files WHERE regexp_matches(path, '(?i){_ENTRY}')
  OR regexp_replace(lower({S.base_name('path')}), '\\.[^.]+$', '') IN {S.inlist(fixed.ENTRY_POINT_NAMES)} ORDER BY path LIMIT 10)
UNION ALL SELECT 'getting-started.md', path FROM files WHERE contains(lower(path), 'readme') OR contains(path, 'package.json')""")
def pln3b(spark, d):
    fs = files(spark, d)
    return PP.comprehensive_plan_files(fs, PP.comprehensive_plan(fs, 20, F.lit("Mixed")))


_BPAT = {
    0: "(contains(path, '/components/') OR contains(path, '/Components/') OR (ends_with(path, '.tsx') AND NOT contains(path, '/pages/')))",
    1: "(contains(path, '/hooks/') OR (contains(path, 'use') AND ends_with(path, '.ts')))",
}
_BK = " UNION ALL ".join(
    f"SELECT {i} AS bucket, path FROM files WHERE " + _BPAT.get(i, f"regexp_matches(path, '{b[3]}')")
    for i, b in enumerate(fixed.PAGE_BUCKETS)
)
_BSPEC = ", ".join(
    f"({i}, '{b[0]}', '{b[1]}', '{b[2]}', {b[4]}, '{b[7]}')" for i, b in enumerate(fixed.PAGE_BUCKETS)
)


@query("pln4_bucket_files", f"WITH {FILES} {_BK}")
def pln4a(spark, d):
    return PP.bucket_files(files(spark, d))


_PATTERN = f"""bk AS ({_BK}),
sp AS (SELECT * FROM (VALUES {_BSPEC}) t(bucket, title, filename, type, least_n, context)),
pg0 AS (SELECT 0 AS place, '' AS ord, 'Architecture Overview' AS title, 'architecture.md' AS filename, 'overview' AS type, '{fixed.OVERVIEW_CONTEXT.format('software project')}' AS context
 UNION ALL SELECT 1, first_path, title, filename, type, context FROM pty WHERE files >= 2
 UNION ALL SELECT CASE WHEN filename = 'configuration.md' THEN 4 ELSE 2 END, lpad(bucket::VARCHAR, 2, '0'), title, filename, type, context FROM sp
   JOIN (SELECT bucket, count(*) AS n FROM bk GROUP BY bucket) c USING (bucket) WHERE n >= least_n
   AND (bucket <> 0 OR (SELECT count(*) FROM pty WHERE files >= 2 AND contains(title, 'Component')) = 0)
 UNION ALL SELECT 5, '', 'Getting Started', 'getting-started.md', 'guide', '{fixed.GETTING_STARTED_CONTEXT}'),
plan AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY place, ord) AS r FROM pg0) WHERE r = 1)"""


@query("pln4_pattern_plan", f"WITH {FILES}, {DST}, {PTY}, {_PATTERN} SELECT place, ord, title, filename, type, context FROM plan")
def pln4(spark, d):
    return PP.pattern_plan(files(spark, d))


_CAPPED = " UNION ALL ".join(
    f"(SELECT '{b[1]}' AS filename, path FROM bk WHERE bucket = {i}" + (f" ORDER BY path LIMIT {b[6]})" if b[6] else ")")
    for i, b in enumerate(fixed.PAGE_BUCKETS)
)


@query("pln4_pattern_plan_files", f"""
WITH {FILES}, {DST}, {PTY}, {_PATTERN}, en AS ({ENTRIES}), cp AS ({_CAPPED}),
dl AS (SELECT path, dir, row_number() OVER (PARTITION BY dir ORDER BY path) AS n FROM (SELECT path, {_PARTS}[1] AS dir FROM files WHERE {DIR} <> '.' AND len({_PARTS}) > 0))
SELECT plan.filename, dl.path FROM plan JOIN dst ON place = 1 AND ord = first_path JOIN dl USING (dir) WHERE n <= 20
UNION ALL SELECT filename, path FROM cp WHERE filename IN (SELECT filename FROM plan WHERE place IN (2, 4))
UNION ALL SELECT filename, path FROM plan, files WHERE place = 5 AND regexp_matches(path, '{fixed.SETUP_FILE_PATTERN}')
UNION ALL SELECT filename, path FROM plan, (SELECT path FROM (SELECT DISTINCT path, CASE WHEN regexp_matches(path, '{_ANCH}') THEN 0 ELSE 1 END AS kind FROM files
  WHERE regexp_matches(path, '{_ANCH}') OR {S.suffix_any('path', fixed.INDEX_FILE_SUFFIXES)} ORDER BY kind, path LIMIT 5)) WHERE place = 5
UNION ALL SELECT 'architecture.md', path FROM en""")
def pln4b(spark, d):
    fs = files(spark, d)
    return PP.pattern_plan_files(fs, PP.pattern_plan(fs))


@query("pln6_candidate_files", f"""
WITH {FILES}, ms AS (SELECT DISTINCT lower({S.stem('path')}) AS page FROM files),
h AS (SELECT page, path, row_number() OVER (PARTITION BY page ORDER BY path) AS pos FROM ms JOIN files ON contains(lower(path), page))
SELECT page, pos, path FROM h WHERE pos <= 10""")
def pln6(spark, d):
    fs = files(spark, d)
    missing = fs.select(F.lower(T.stem("path")).alias("page")).distinct()
    return PP.candidate_files(missing, fs)


# --- set steps ---------------------------------------------------------------------------------------------
@query("set3_updated_chunks", f"""
WITH {FILES} SELECT path, 'old' AS version FROM files WHERE path NOT IN (SELECT path FROM files WHERE size > 3000)
UNION ALL SELECT path, 'new' FROM files WHERE size > 3000""")
def set3(spark, d):
    fs = files(spark, d)
    changed = fs.where("size > 3000").select("path")
    return X.update_chunks(fs.select("path", F.lit("old").alias("version")), changed, changed.withColumn("version", F.lit("new")))


@query("set4_first_by_filename", """
SELECT filename, place, ord, title FROM (SELECT source || '.md' AS filename, 1 AS place, doc_id AS ord, lang || doc_id AS title,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def set4(spark, d):
    specs = table(spark, d, "documents").select(
        F.concat("source", F.lit(".md")).alias("filename"), F.lit(1).alias("place"),
        F.col("doc_id").alias("ord"), F.concat("lang", "doc_id").alias("title"),
    )
    return PP.first_by_filename(specs)


@query("set5_existing_files", f"""
WITH {FILES}, p AS (SELECT 'page' AS page, CASE WHEN doc_id % 3 = 0 THEN 'no/' || path ELSE path END AS path FROM files)
SELECT page, path FROM p WHERE path IN (SELECT path FROM files)""")
def set5(spark, d):
    fs = files(spark, d)
    planned = fs.selectExpr("'page' AS page", "CASE WHEN doc_id % 3 = 0 THEN concat('no/', path) ELSE path END AS path")
    return PP.existing_files(planned, fs).select("page", "path")


@query("set6_uncovered_files", f"WITH {FILES} SELECT path FROM files WHERE path NOT IN (SELECT path FROM files WHERE size > 1500)")
def set6(spark, d):
    fs = files(spark, d)
    return PP.uncovered_files(fs.select("path"), fs.where("size > 1500"))


# --- change sets -----------------------------------------------------------------------------------------------
_OLD = {"path": "CASE WHEN doc_id % 11 = 4 THEN 'gone/f' || doc_id ELSE 'f' || doc_id END", "content": "text"}
_NEW = {
    "path": "CASE WHEN doc_id % 10 = 5 THEN 'moved/f' || doc_id WHEN doc_id % 11 = 4 AND doc_id % 2 = 0 THEN 'gone/f' || doc_id ELSE 'f' || doc_id END",
    "content": "CASE WHEN doc_id % 10 IN (3, 7) THEN text || ' changed' ELSE text END",
}


def snapshots(spark, d):
    docs = table(spark, d, "documents")
    return (docs.selectExpr("doc_id", f"{_OLD['path']} AS path", f"{_OLD['content']} AS content"),
            docs.selectExpr("doc_id", f"{_NEW['path']} AS path", f"{_NEW['content']} AS content"))


SNAP = f"""o AS (SELECT {_OLD['path']} AS path, sha256({_OLD['content']}) AS h FROM documents), n AS (SELECT {_NEW['path']} AS path, sha256({_NEW['content']}) AS h FROM documents),
c AS (SELECT coalesce(n.path, o.path) AS path, coalesce(n.h, o.h) AS h, CASE WHEN o.h IS NULL THEN 'A' WHEN n.h IS NULL THEN 'D' WHEN o.h <> n.h THEN 'M' END AS status
  FROM o FULL JOIN n ON o.path = n.path),
rn AS (SELECT *, row_number() OVER (PARTITION BY status, h ORDER BY path) AS k FROM c WHERE status IN ('A', 'D')),
ch AS (SELECT 'M' AS status, path, NULL AS old_path FROM c WHERE status = 'M'
  UNION ALL SELECT CASE WHEN max(path) FILTER (status = 'D') IS NULL THEN 'A' WHEN max(path) FILTER (status = 'A') IS NULL THEN 'D' ELSE 'R' END,
    coalesce(max(path) FILTER (status = 'A'), max(path) FILTER (status = 'D')),
    CASE WHEN max(path) FILTER (status = 'A') IS NOT NULL THEN max(path) FILTER (status = 'D') END FROM rn GROUP BY h, k)"""


@query("inc1_diff_snapshots", f"WITH {SNAP} SELECT status, path, old_path FROM ch")
def inc1(spark, d):
    return X.diff_snapshots(*snapshots(spark, d))


@query("inc1_flat_changes", f"WITH {SNAP} SELECT status, path FROM ch WHERE status <> 'R' UNION ALL SELECT 'D', old_path FROM ch WHERE status = 'R' UNION ALL SELECT 'A', path FROM ch WHERE status = 'R'")
def inc1b(spark, d):
    return X.flat_changes(X.diff_snapshots(*snapshots(spark, d)))


def updated(spark, d):
    old, new = snapshots(spark, d)
    changes = settle(X.diff_snapshots(old, new, renames=False))  # read by every table of the new version
    index = I.build_index(old, "path", "content")
    fresh = new.join(changes.where("status <> 'D'").select("path"), "path", "left_semi")
    gone = changes.where("status = 'D'").select("path")
    return I.update_index(index, fresh, "path", "content", gone)


_NEWDOCS = f"nd AS (SELECT {_NEW['path']} AS path, {_NEW['content']} AS content FROM documents)"


@query("inc2_updated_index_terms", f"WITH {_NEWDOCS}, {S.index_ctes('nd', 'path', 'content')} SELECT term, df FROM dfs")
def inc2(spark, d):
    return updated(spark, d).term_stats


@query("inc2_updated_index_postings", f"WITH {_NEWDOCS}, {S.index_ctes('nd', 'path', 'content')} SELECT doc_id AS path, dl, term, tf FROM tf")
def inc2b(spark, d):
    return updated(spark, d).postings.withColumnRenamed("doc_id", "path")


@query("inc2_updated_index_stats", f"WITH {_NEWDOCS}, {S.index_ctes('nd', 'path', 'content')} SELECT n AS n_docs, round(avgdl, 6) AS avgdl FROM cs")
def inc2c(spark, d):
    return updated(spark, d).corpus_stats.withColumn("avgdl", F.round("avgdl", 6))


def committed(spark, d):
    """The old files as one segment, all changes as a second one with its deletions."""
    old, new = snapshots(spark, d)
    changes = settle(X.diff_snapshots(old, new, renames=False))
    path = scratch_path(spark, "segments")
    segments.commit(spark, path, old, "path", "content")
    # paths are hashed, so that contents are not sorted
    fresh = new.join(changes.where("status <> 'D'").select("path").hint("shuffle_hash"), "path", "left_semi")
    segments.commit(spark, path, fresh, "path", "content", changes.where("status = 'D'").select("path"))
    return path


@query("inc2_segments_terms", f"WITH {_NEWDOCS}, {S.index_ctes('nd', 'path', 'content')} SELECT term, df FROM dfs")
def inc2_segments(spark, d):
    return segments.open_index(spark, committed(spark, d)).term_stats


@query("inc2_segments_postings", f"WITH {_NEWDOCS}, {S.index_ctes('nd', 'path', 'content')} SELECT doc_id AS path, dl, term, tf FROM tf")
def inc2_segments_b(spark, d):
    return segments.open_index(spark, committed(spark, d)).postings.withColumnRenamed("doc_id", "path")


@query("inc2_segments_merged", f"WITH {_NEWDOCS}, {S.index_ctes('nd', 'path', 'content')} SELECT doc_id AS path, dl, term, tf, (SELECT round(avgdl, 6) FROM cs) AS avgdl FROM tf")
def inc2_segments_c(spark, d):
    """The old files in as many commits as fill a size class, merged where that is due; then the changes."""
    old, new = snapshots(spark, d)
    path = scratch_path(spark, "segments")
    part = F.pmod(F.xxhash64("path"), F.lit(segments.FAN))
    for i in range(segments.FAN):
        segments.commit(spark, path, old.where(part == i), "path", "content")
        segments.merge(spark, path)
    changes = settle(X.diff_snapshots(old, new, renames=False))
    fresh = new.join(changes.where("status <> 'D'").select("path").hint("shuffle_hash"), "path", "left_semi")
    segments.commit(spark, path, fresh, "path", "content", changes.where("status = 'D'").select("path"))
    segments.merge(spark, path)
    index = segments.open_index(spark, path)
    avgdl = F.round(index.corpus_stats.select("avgdl").scalar(), 6)
    return index.postings.select(F.col("doc_id").alias("path"), "dl", "term", "tf", avgdl.alias("avgdl"))


@query("inc2_update_counts", f"""
WITH {SNAP}, t AS (SELECT path FROM c WHERE status IS NOT NULL)
SELECT (SELECT count(*) FROM o WHERE path NOT IN (SELECT path FROM t)) AS kept, (SELECT count(*) FROM o WHERE path IN (SELECT path FROM t)) AS removed,
  (SELECT count(*) FROM n WHERE path IN (SELECT path FROM t)) AS added""")
def inc2d(spark, d):
    old, new = snapshots(spark, d)
    changes = X.diff_snapshots(old, new, renames=False)
    fresh = new.join(changes.select("path"), "path", "left_semi")
    return X.update_counts(old, changes, fresh)


_CHANGED = "'src/a' || (doc_id * 3) || '.ts'"


@query("inc3_affected_pages", f"""
WITH {PG}, nm AS (SELECT DISTINCT 'a' || (doc_id * 3) AS name FROM documents)
SELECT DISTINCT path FROM pg JOIN nm ON contains(body, name)""")
def inc3(spark, d):
    changes = table(spark, d, "documents").selectExpr("'M' AS status", f"{_CHANGED} AS path")
    return X.affected_pages(wiki_pages(spark, d), changes, "body")


@query("inc3_affected_pages_by_grams", f"""
WITH {PG}, nm AS (SELECT DISTINCT 'a' || (doc_id * 3) AS name FROM documents)
SELECT DISTINCT path FROM pg JOIN nm ON contains(body, name)""")
def inc3_grams(spark, d):
    path = scratch_path(spark, "grams")
    grams.save_grams(wiki_pages(spark, d), ["path"], "body", path)
    changes = table(spark, d, "documents").selectExpr("'M' AS status", f"{_CHANGED} AS path")
    return X.affected_pages(grams.load_grams(spark, path), changes)


@query("inc4_pages_to_create", f"""
WITH {PG}, ad AS (SELECT CASE doc_id % 3 WHEN 0 THEN regexp_replace(path, '\\.md$', '') || '/x.ts' WHEN 1 THEN 'mod' || (doc_id % 20) || '/y.ts' ELSE 'z' || doc_id || '.ts' END AS path FROM wiki),
m AS (SELECT path, {S.dir_name('path')} AS dir, CASE WHEN instr(path, '/') = 0 THEN {S.stem('path')} ELSE regexp_extract({S.dir_name('path')}, '([^/]*)$', 1) END AS module FROM ad)
SELECT module || '.md' AS page, count(*)::BIGINT AS files FROM m WHERE module || '.md' NOT IN (SELECT path FROM pg)
  AND replace(dir, '/', '-') || '.md' NOT IN (SELECT path FROM pg) AND 'modules/' || module || '.md' NOT IN (SELECT path FROM pg) GROUP BY module""")
def inc4(spark, d):
    added = derive(spark, d, "wiki").selectExpr(
        "'A' AS status",
        r"CASE doc_id % 3 WHEN 0 THEN concat(regexp_replace(path, r'\.md$', ''), '/x.ts') WHEN 1 THEN concat('mod', doc_id % 20, '/y.ts') ELSE concat('z', doc_id, '.ts') END AS path",
    )
    return X.pages_to_create(added, wiki_pages(spark, d))


@query("inc6_streamed_index", f"WITH {S.index_ctes()} SELECT term, df FROM dfs")
def inc6(spark, d):
    """All documents through the stream into versioned tables, then the current index."""
    base = scratch_path(spark, "live")
    schema = table(spark, d, "documents").schema
    source = (
        spark.readStream.schema(schema).parquet(f"{d}/documents.parquet*")  # a file or a folder of files
        .select("doc_id", F.lit(1).alias("version"), "text")
    )
    live_index.stream_update(source, base, f"{base}/checkpoint").awaitTermination()
    return live_index.current_index(spark, base).term_stats


def _letter_model():
    return lambda texts: [[len(t), t.count("e"), t.count(" ")] for t in texts]


def streamed_history(spark, d) -> str:
    """Folder of a live index after three micro-batches: all documents, then new English texts and German deletions, then late ones."""
    base = scratch_path(spark, "live")
    docs = table(spark, d, "documents")
    lang = F.coalesce("lang", F.lit(""))
    changed = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce("source", F.lit("")))
    steps = [
        docs.select("doc_id", F.lit(2).alias("version"), "text"),
        docs.where(lang.isin("en", "de")).select(
            "doc_id", F.lit(3).alias("version"), F.when(lang == "en", changed).alias("text")
        ),
        docs.select("doc_id", F.lit(1).alias("version"), F.col("source").alias("text")),
    ]
    for rows in steps:
        rows.write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        live_index.stream_update(source, f"{base}/out", f"{base}/checkpoint", load=_letter_model, dim=3).awaitTermination()
    return f"{base}/out"


_HISTORY = """now AS (
SELECT doc_id, CASE WHEN lang = 'en' THEN coalesce(text, '') || ' ' || coalesce(source, '') ELSE text END AS text
FROM documents WHERE lang = 'en' OR (lang IS DISTINCT FROM 'de' AND text IS NOT NULL))"""


@query("inc6_streamed_statistics", f"""
WITH {_HISTORY}, {S.index_ctes('now')} SELECT term, df, (SELECT n FROM cs)::BIGINT AS n_docs, (SELECT round(avgdl, 6) FROM cs) AS avgdl FROM dfs""")
def inc6_statistics(spark, d):
    """Sums of the batches' deltas after replaced, deleted and late documents."""
    index = live_index.current_index(spark, streamed_history(spark, d))
    corpus = index.corpus_stats
    return index.term_stats.select(
        "term", "df", corpus.select("n_docs").scalar().alias("n_docs"),
        F.round(corpus.select("avgdl").scalar(), 6).alias("avgdl"),
    )


@query("inc6_streamed_vectors", f"""
WITH {_HISTORY} SELECT doc_id, [length(text)::DOUBLE, length(text) - length(replace(text, 'e', '')), length(text) - length(replace(text, ' ', ''))] AS embedding FROM now""")
def inc6_vectors(spark, d):
    """Vectors of the live documents: a text that a batch before brought is not embedded again."""
    made = live_index.current_vectors(spark, streamed_history(spark, d), 3)
    return made.select("doc_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


# --- sinks: written to shared storage and read back ------------------------------------------------------------------
@query("snk1_chunk_table", "SELECT source AS corpus_id, doc_id, lang FROM documents")
def snk1(spark, d):
    path = scratch_path(spark, "chunks")
    rows = table(spark, d, "documents").select(F.col("source").alias("corpus_id"), "doc_id", "lang", "text")
    sinks.write_chunks(rows, path)
    return spark.read.parquet(path).select("corpus_id", "doc_id", "lang")


@query("snk2_index_tables", f"WITH {S.index_ctes()} SELECT doc_id, dl, term, tf FROM tf")
def snk2(spark, d):
    path = scratch_path(spark, "index")
    name = "t" + path[-12:]
    I.save_index(I.build_index(table(spark, d, "documents"), "doc_id", "text"), path, name)
    return I.load_index(spark, path, name).postings


@query("snk3_vector_table", "SELECT vec_id AS doc_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS embedding FROM embeddings")
def snk3(spark, d):
    path = scratch_path(spark, "vectors")
    sinks.write_vectors(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), path)
    return spark.read.parquet(path).select(
        "doc_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("embedding")
    )


@query("snk4_index_state", """
SELECT source AS corpus_id, 3 AS version, count(DISTINCT doc_id) AS file_count, count(*) AS chunk_count FROM documents GROUP BY source""")
def snk4(spark, d):
    docs = table(spark, d, "documents")
    per = docs.groupBy("source").agg(F.countDistinct("doc_id").alias("file_count"), F.count("*").alias("chunk_count"))
    states = per.select(F.col("source").alias("corpus_id"), F.explode(F.array(*[F.lit(v) for v in (1, 2, 3)])).alias("version"), "file_count", "chunk_count")
    path = scratch_path(spark, "state")
    sinks.write_state(states, path)
    return sinks.latest_state(spark.read.parquet(path)).select("corpus_id", "version", "file_count", "chunk_count")


@query("snk5_loaded_index", f"""
WITH {S.index_ctes()} SELECT term, df, (SELECT n FROM cs)::BIGINT AS n_docs, (SELECT round(avgdl, 6) FROM cs) AS avgdl FROM dfs""")
def snk5(spark, d):
    """Only postings and state are stored; all statistics are rebuilt on loading."""
    path = scratch_path(spark, "postings")
    name = "t" + path[-12:]
    docs = table(spark, d, "documents")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    built = I.build_index(docs, "doc_id", "text", parts)
    built.postings.write.bucketBy(parts, "doc_id").sortBy("term").option("path", f"{path}/v=1/postings").saveAsTable(f"{name}_v1_postings")
    spark.createDataFrame([(1, parts)], I.STATE).write.parquet(f"{path}/state")
    index = I.load_index(spark, path, name, I.document_lengths(docs, "doc_id", "text"))
    corpus = index.corpus_stats
    return index.term_stats.select(
        "term", "df", corpus.select("n_docs").scalar().alias("n_docs"),
        F.round(corpus.select("avgdl").scalar(), 6).alias("avgdl"),
    )


@query("inc2_saved_and_reloaded", f"WITH {S.index_ctes()} SELECT doc_id, dl, term, tf FROM tf")
def inc2_saved(spark, d):
    """English documents saved first, all others added by an update saved under the same name."""
    path = scratch_path(spark, "index")
    name = "t" + path[-12:]
    docs = table(spark, d, "documents")
    I.save_index(I.build_index(docs.where("lang = 'en'"), "doc_id", "text"), path, name)
    rest = docs.where("lang <> 'en' or lang is null")
    I.save_index(I.update_index(I.load_index(spark, path, name), rest, "doc_id", "text"), path, name)
    return I.load_index(spark, path, name).postings


def the_bundle(spark, d):
    wiki = wiki_pages(spark, d).select("path", F.col("body").alias("content"))
    chunks = table(spark, d, "documents").select(
        F.concat(F.when(F.col("doc_id") % 10 == 3, "../").otherwise(""), F.lit("chunk-"), "doc_id").alias("path"),
        F.col("text").alias("content"),
    )
    return sinks.bundle(wiki, chunks)


@query("snk7_bundle", f"""
WITH {PG} SELECT 'wiki' AS section, path, strlen(body)::BIGINT AS size FROM pg
UNION ALL SELECT 'rag', CASE WHEN doc_id % 10 = 3 THEN '../' ELSE '' END || 'chunk-' || doc_id, strlen(text)::BIGINT FROM documents""")
def snk7(spark, d):
    path = scratch_path(spark, "bundle")
    sinks.write_bundle(the_bundle(spark, d), path)
    return sinks.list_bundle(spark, path)


@query("snk7_extract_safe", f"""
WITH {PG} SELECT 'wiki' AS section, path FROM pg UNION ALL SELECT 'rag', 'chunk-' || doc_id FROM documents WHERE doc_id % 10 <> 3""")
def snk7b(spark, d):
    return sinks.extract_bundle(the_bundle(spark, d)).select("section", "path")


@query("snk7_extract_wiki", f"WITH {PG} SELECT path, body AS content FROM pg")
def snk7c(spark, d):
    return sinks.extract_bundle(the_bundle(spark, d), wiki_only=True).select("path", "content")
