"""Segmentation queries over source code and pages derived from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import segment as G
from registry import sqlkit as S
from registry.base import CHECKS, query, table
from registry.inputs import cte, derive

COLS = ["path", "start_line", "end_line", "name", "chunk_type", "content"]


def lines_cte(src: str, more: str = "") -> str:
    return f"""
ln AS (SELECT path, CAST(unnest(range(1, len(ls) + 1)) AS INT) AS no, unnest(ls) AS line, len(ls) AS n {more}
       FROM (SELECT *, string_split(content, chr(10)) AS ls FROM {src}))"""


def rule_case(rules, line="line"):
    q = lambda p: p.replace("'", "''")
    name = " ".join(
        f"WHEN regexp_matches({line}, '{q(p)}') THEN regexp_extract({line}, '{q(p)}', 1)" for p, _ in rules
    )
    ty = " ".join(f"WHEN regexp_matches({line}, '{q(p)}') THEN '{k}'" for p, k in rules)
    return f"CASE {name} END AS name, CASE {ty} END AS type"


DEPTH = """
dl AS (SELECT *, length(line) - length(replace(line, '{', '')) AS op, length(line) - length(replace(line, '}', '')) AS cl FROM ln),
dp AS (SELECT *, (sum(op - cl) OVER (PARTITION BY path ORDER BY no))::INT AS after FROM dl),
db AS (SELECT *, after - (op - cl) AS before FROM dp)"""


def seg_ctes(marks: str, body: str = "string_agg(ln.line, chr(10) ORDER BY ln.no)") -> str:
    """Chunks from a ``marks(path, no, ord, kind, name, type)`` select."""
    return f"""
marks AS ({marks}),
nx AS (SELECT *, lead(no) OVER w AS nno, lead(kind) OVER w AS nk FROM marks WINDOW w AS (PARTITION BY path ORDER BY no, ord)),
rg AS (SELECT nx.path, no AS start_line, CASE nk WHEN 's' THEN nno - 1 WHEN 'e' THEN nno ELSE t.n END AS end_line, name, type AS chunk_type
       FROM nx JOIN (SELECT path, max(n) AS n FROM ln GROUP BY path) t USING (path) WHERE kind = 's'),
seg AS (SELECT rg.path, start_line, end_line::INT AS end_line, name, chunk_type, {body} AS content
        FROM rg JOIN ln ON ln.path = rg.path AND ln.no BETWEEN start_line AND end_line GROUP BY ALL)"""


def or_whole(src: str, where: str = "true") -> str:
    return f"""
SELECT path, start_line, end_line, name, chunk_type, content FROM seg WHERE {where}
UNION ALL SELECT path, 1, len(string_split(content, chr(10)))::INT, {S.stem('path')}, 'file', content FROM {src}
WHERE path NOT IN (SELECT path FROM seg WHERE {where})"""


# --- Python ------------------------------------------------------------------------------
_PY = f"""
WITH {cte('code_py')}, {lines_cte('code_py')},
dc AS (SELECT *, regexp_matches(line, '^\\s*@(\\w+)') AS deco FROM ln),
isl AS (SELECT *, sum(CASE WHEN deco THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY no) AS g FROM dc),
run AS (SELECT *, sum(CASE WHEN deco THEN 1 ELSE 0 END) OVER (PARTITION BY path, g ORDER BY no) AS r FROM isl),
pv AS (SELECT *, coalesce(lag(r) OVER (PARTITION BY path ORDER BY no), 0)::INT AS above FROM run),
rl AS (SELECT *, {rule_case(G.PY_RULES)} FROM pv),"""
_PY_MARKS = "SELECT path, no - above AS no, 0 AS ord, 's' AS kind, name, type FROM rl WHERE type IS NOT NULL"


@query("seg8_python", f"{_PY} {seg_ctes(_PY_MARKS)} {or_whole('code_py')}")
def seg8(spark, d):
    return G.segment_python(derive(spark, d, "code_py")).select(*COLS)


# --- C#, Java: each closing line closes levels; a start ends at the first such line after its brace --
def braces_sql(src: str) -> str:
    unions = " UNION ALL ".join(
        f"SELECT path, no, before AS level, regexp_extract(line, '{p}', 1) AS name, '{k}' AS type FROM db "
        f"WHERE regexp_matches(line, '{p}'){' AND NOT contains(line, chr(59))' if k == 'method' else ''}"
        for p, k in G.CS_RULES
    )
    return f"""
WITH {cte(src)}, {lines_cte(src)}, {DEPTH},
st AS ({unions}),
op AS (SELECT st.*, (SELECT min(no) FROM db WHERE db.path = st.path AND db.no >= st.no AND db.op > 0) AS o FROM st),
rg AS (SELECT op.*, (SELECT min(no) FROM db WHERE db.path = op.path AND db.no >= op.o AND db.after <= op.level) AS e FROM op),
ids AS (SELECT *, row_number() OVER () AS id FROM rg WHERE e IS NOT NULL),
seg AS (SELECT ids.path, ids.no AS start_line, e AS end_line, name, type AS chunk_type, string_agg(ln.line, chr(10) ORDER BY ln.no) AS content
   FROM ids JOIN ln ON ln.path = ids.path AND ln.no BETWEEN ids.no AND e GROUP BY id, ids.path, ids.no, e, name, type)
{or_whole(src, 'length(content) >= 100')}"""


@query("seg9_csharp", braces_sql("code_cs"))
def seg9(spark, d):
    return G.segment_braces(derive(spark, d, "code_cs")).select(*COLS)


@query("seg10_java_like", f"SELECT *, 'java' AS language FROM ({braces_sql('code_cs')})")
def seg10(spark, d):
    files = derive(spark, d, "code_cs").withColumn("language", F.lit("java"))
    return G.segment_braces(files).select(*COLS, "language")


# --- Go -------------------------------------------------------------------------------------------
_GO_MARKS = f"""
SELECT path, no, 0 AS ord, 's' AS kind, name, type FROM (SELECT *, {rule_case(G.GO_RULES)} FROM db) WHERE type IS NOT NULL AND before = 0
UNION ALL SELECT path, no, 1, 'e', NULL, NULL FROM db WHERE after = 0 AND cl > 0"""


@query("seg11_go", f"WITH {cte('code_go')}, {lines_cte('code_go')}, {DEPTH}, {seg_ctes(_GO_MARKS)} {or_whole('code_go')}")
def seg11(spark, d):
    return G.segment_go(derive(spark, d, "code_go")).select(*COLS)


# --- generic ------------------------------------------------------------------------------------------
_GEN_MARKS = f"""
WITH g AS (SELECT path, no, 0 AS ord, 's' AS kind, name, type FROM (SELECT *, {rule_case(G.GENERIC_RULES)} FROM db)
           WHERE type IS NOT NULL AND before = 0)
SELECT * FROM g UNION ALL SELECT DISTINCT path, 1, -1, 's', 'module', 'function' FROM ln
WHERE path NOT IN (SELECT path FROM g WHERE no = 1)"""


@query("seg12_generic", f"""
WITH {cte('code_rs')}, {lines_cte('code_rs')}, {DEPTH},
{seg_ctes(_GEN_MARKS, S.strip('string_agg(ln.line, chr(10) ORDER BY ln.no)'))} {or_whole('code_rs', 'length(content) >= 100')}""")
def seg12(spark, d):
    return G.segment_generic(derive(spark, d, "code_rs")).select(*COLS)


# --- SQL scripts -------------------------------------------------------------------------------------------
_SQL_MARKS = f"""
WITH k AS (SELECT *, {rule_case(G.SQL_RULES)}, trim(line) IN ('GO', 'END', 'END;') AS stop FROM ln),
b AS (SELECT *, last_value(CASE WHEN type IN ('function', 'handler') THEN 1 WHEN stop AND type IS NULL THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY path ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS blk FROM k)
SELECT path, no, 0 AS ord, CASE WHEN type IS NOT NULL THEN 's' ELSE 'e' END AS kind, name, type FROM b
WHERE type IS NOT NULL OR (stop AND blk = 1)"""


@query("seg16_sql", f"WITH {cte('code_sql')}, {lines_cte('code_sql')}, {seg_ctes(_SQL_MARKS)} {or_whole('code_sql')}")
def seg16(spark, d):
    return G.segment_sql(derive(spark, d, "code_sql")).select(*COLS)


# --- JCL ------------------------------------------------------------------------------------------------------
_JCL_MARKS = f"""
WITH k AS (SELECT *, CASE WHEN regexp_matches(line, '{G.JCL_JOB}') THEN 'job' WHEN regexp_matches(line, '{G.JCL_PROC}') THEN 'proc'
   WHEN regexp_matches(line, '{G.JCL_EXEC}') THEN 'exec' END AS kd FROM ln),
j AS (SELECT *, last_value(CASE WHEN kd IN ('job', 'proc') THEN kd END IGNORE NULLS) OVER (PARTITION BY path ORDER BY no) AS lj FROM k)
SELECT path, no, 0 AS ord, 's' AS kind, CASE WHEN kd = 'job' THEN regexp_extract(line, '{G.JCL_JOB}', 1)
  WHEN kd = 'proc' THEN regexp_extract(line, '{G.JCL_PROC}', 1)
  ELSE coalesce(nullif(regexp_extract(line, '{G.JCL_EXEC}', 1), ''), regexp_extract(line, '{G.JCL_EXEC}', 2)) END AS name,
  CASE WHEN kd = 'job' THEN 'handler' ELSE 'function' END AS type
FROM j WHERE kd IN ('job', 'proc') OR (kd = 'exec' AND lj IS DISTINCT FROM 'job')"""


@query("seg15_jcl", f"WITH {cte('code_jcl')}, {lines_cte('code_jcl')}, {seg_ctes(_JCL_MARKS)} {or_whole('code_jcl')}")
def seg15(spark, d):
    return G.segment_jcl(derive(spark, d, "code_jcl")).select(*COLS)


# --- COBOL: sequential state, so the check is a recursive walk over the flagged lines -----------------------------
_ROLE = """CASE WHEN regexp_matches(lower(name), 'init|start|begin') THEN 'constructor'
 WHEN regexp_matches(lower(name), 'read|fetch|get|write|update|insert|delete') THEN 'repository'
 WHEN regexp_matches(lower(name), 'valid|check|edit|calc|compute|process|display|print|report|error|abort|exception|term|end|close|final') THEN 'function'
 WHEN contains(lower(name), 'main') THEN 'handler' ELSE 'function' END"""
_COBOL = f"""
WITH RECURSIVE {cte('code_cbl')}, {lines_cte('code_cbl')},
fl AS (SELECT path, no, n, name, type AS kd FROM (SELECT *, {rule_case(G.COBOL_RULES).replace("'", "'")} FROM ln) WHERE type IS NOT NULL),
nb AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY no) AS k FROM fl),
walk AS (
  SELECT path, 0::BIGINT AS k, '' AS div, '' AS ty, NULL::VARCHAR AS nm, 0 AS no, false AS isnew, false AS keepp FROM (SELECT DISTINCT path FROM nb)
  UNION ALL
  SELECT path, k, CASE WHEN act = 'division' THEN upper(name) ELSE div END,
    CASE act WHEN 'division' THEN 'module' WHEN 'section' THEN CASE WHEN div = 'PROCEDURE' THEN 'function' ELSE 'module' END
      WHEN 'fd' THEN 'model' WHEN 'item' THEN 'model' WHEN 'paragraph' THEN {_ROLE} ELSE ty END,
    CASE act WHEN 'division' THEN upper(name) || ' DIVISION' ELSE name END, no, act IS NOT NULL,
    CASE act WHEN 'division' THEN true WHEN 'fd' THEN true WHEN 'section' THEN ty <> 'module' WHEN 'item' THEN ty = 'model'
      WHEN 'paragraph' THEN ty <> 'module' ELSE false END
  FROM (SELECT nb.path, nb.k, w.div, w.ty, nb.name, nb.no,
      CASE WHEN nb.kd = 'division' THEN 'division' WHEN nb.kd = 'section' AND w.div <> '' THEN 'section'
           WHEN nb.kd = 'fd' AND w.div = 'DATA' THEN 'fd' WHEN nb.kd = 'item' AND w.div = 'DATA' AND w.ty <> 'module' THEN 'item'
           WHEN nb.kd = 'paragraph' AND w.div = 'PROCEDURE' AND length(nb.name) > 2 AND NOT regexp_matches(nb.name, '^[0-9]') THEN 'paragraph' END AS act
    FROM walk w JOIN nb ON nb.path = w.path AND nb.k = w.k + 1)),
mk AS (SELECT *, lead(no) OVER w AS nno, lead(keepp) OVER w AS nkeep FROM walk WHERE isnew WINDOW w AS (PARTITION BY path ORDER BY no)),
rg AS (SELECT mk.path, no AS start_line, coalesce(nno - 1, t.n)::INT AS end_line, nm AS name, ty AS chunk_type, div || ' DIVISION > ' || nm AS context_path
   FROM mk JOIN (SELECT path, max(n) AS n FROM ln GROUP BY path) t USING (path) WHERE coalesce(nkeep, true)),
seg AS (SELECT rg.path, start_line, end_line, name, chunk_type, context_path, string_agg(ln.line, chr(10) ORDER BY ln.no) AS content
   FROM rg JOIN ln ON ln.path = rg.path AND ln.no BETWEEN start_line AND end_line WHERE NOT ends_with(rg.path, '.cpy') GROUP BY ALL)"""


@query("seg13_cobol", f"""{_COBOL}
SELECT path, start_line, end_line, name, chunk_type, content, context_path FROM seg
UNION ALL SELECT path, 1, len(string_split(content, chr(10)))::INT, coalesce((regexp_extract_all(content, '(?im)^\\s{{0,6}}\\s*PROGRAM-ID\\s*\\.\\s*(\\w[\\w-]*)', 1))[-1], {S.stem('path')}),
  CASE WHEN ends_with(path, '.cpy') THEN 'import-block' ELSE 'file' END, content, NULL FROM code_cbl WHERE path NOT IN (SELECT path FROM seg)""")
def seg13(spark, d):
    return G.segment_cobol(derive(spark, d, "code_cbl"), merge=False).select(*COLS, "context_path")


@query("seg13_cobol_copies", """WITH """ + cte("code_cbl") + r"""
SELECT path, len(regexp_extract_all(content, '(?im)^\s{0,6}\s*COPY\s+["'']?(\w[\w-]*)["'']?\s*\.?', 1))::INT AS copies
FROM code_cbl WHERE copies > 0""")
def seg13b(spark, d):
    chunks = G.segment_cobol(derive(spark, d, "code_cbl"), merge=False)
    return chunks.where("imports IS NOT NULL").select("path", F.size("imports").alias("copies"))


@query("seg14_paragraph_role", f"SELECT item_id, name, {_ROLE} AS role FROM (SELECT item_id, unnest({S.tokens('text')}) AS name FROM benchmark)")
def seg14(spark, d):
    names = table(spark, d, "benchmark").select("item_id", F.explode(T.tokens("text")).alias("name"))
    return names.select("item_id", "name", G.paragraph_role(F.col("name")).alias("role"))


# --- merging, whole files, priorities -------------------------------------------------------------------------------
@query("seg18_merge_small", f"""{_COBOL},
c AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY start_line) AS k, count(*) OVER (PARTITION BY path) AS cnt FROM seg),
mw AS (
  SELECT path, 0::BIGINT AS k, 0::BIGINT AS chars, 0::BIGINT AS grp, false AS closed FROM (SELECT DISTINCT path FROM c)
  UNION ALL
  SELECT c.path, c.k,
    CASE WHEN length(content) >= 200 THEN 0 WHEN m.chars + length(content) >= 200 THEN 0 ELSE m.chars + length(content) END,
    CASE WHEN length(content) >= 200 OR m.closed THEN m.grp + 1 ELSE m.grp END,
    length(content) >= 200 OR m.chars + length(content) >= 200
  FROM mw m JOIN c ON c.path = m.path AND c.k = m.k + 1),
mg AS (SELECT c.*, mw.grp FROM c JOIN mw USING (path, k))
SELECT path, min(start_line)::INT AS start_line, max(end_line)::INT AS end_line, string_agg(name, ', ' ORDER BY k) AS name,
  CASE WHEN count(*) = 1 THEN any_value(chunk_type) ELSE 'file' END AS chunk_type, string_agg(content, chr(10) || chr(10) ORDER BY k) AS content
FROM mg GROUP BY path, grp
UNION ALL SELECT path, 1, len(string_split(content, chr(10)))::INT, coalesce((regexp_extract_all(content, '(?im)^\\s{{0,6}}\\s*PROGRAM-ID\\s*\\.\\s*(\\w[\\w-]*)', 1))[-1], {S.stem('path')}),
  CASE WHEN ends_with(path, '.cpy') THEN 'import-block' ELSE 'file' END, content FROM code_cbl WHERE path NOT IN (SELECT path FROM seg)""")
def seg18(spark, d):
    return G.segment_cobol(derive(spark, d, "code_cbl")).select(*COLS)


@query("seg17_whole_files", f"""
WITH {cte('code_go')}, {lines_cte('code_go')}, {DEPTH}, {seg_ctes(_GO_MARKS)}
SELECT path, 1 AS start_line, len(string_split(content, chr(10)))::INT AS end_line, {S.stem('path')} AS name, 'file' AS chunk_type, content
FROM code_go WHERE path NOT IN (SELECT path FROM seg)""")
def seg17(spark, d):
    files = derive(spark, d, "code_go")
    found = G.segment_go(files).where("chunk_type <> 'file'")
    return G.whole_files(files, found).select(*COLS)


@query("seg21_prioritized", f"""
WITH {cte('files')}
SELECT path, priority FROM (SELECT path, CASE WHEN regexp_matches(lower(path), '^(src|lib|app)/') THEN 100 ELSE 0 END
  + CASE WHEN regexp_matches(lower(path), 'index\\.|main\\.|app\\.') THEN 50 ELSE 0 END
  + CASE WHEN regexp_matches(lower(path), 'config|\\.json$|\\.yaml$') THEN 30 ELSE 0 END
  - CASE WHEN regexp_matches(path, '\\.test\\.|\\.spec\\.|_test\\.|test_|__tests__|tests/|\\.stories\\.|__mocks__') THEN 50 ELSE 0 END
  - CASE WHEN regexp_matches(lower(path), 'vendor/|generated/|\\.min\\.') THEN 100 ELSE 0 END
  + CASE WHEN length(content) < 1000 THEN 20 WHEN length(content) > 3000 THEN -10 ELSE 0 END AS priority FROM files)
ORDER BY priority DESC, path LIMIT 300""")
def seg21(spark, d):
    return G.prioritized(derive(spark, d, "files"), 300, "path").select("path", "priority")


# --- line windows: the check walks the windows recursively -------------------------------------------------------------
@query("seg2_line_windows", f"""
WITH RECURSIVE src AS (SELECT doc_id AS path, text AS content FROM documents), {lines_cte('src')},
cm AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY path ORDER BY no) AS ends FROM ln),
lg AS (SELECT path, no FROM ln WHERE {S.strip('line')} IN ('', '}}', '}};', 'end')),
tot AS (SELECT path, max(n) AS n FROM ln GROUP BY path),
raw AS (SELECT a.path, a.no AS s, coalesce(min(b.no), any_value(a.n)) AS e FROM cm a LEFT JOIN cm b ON a.path = b.path AND b.no >= a.no
   AND b.ends - (a.ends - length(a.line) - 1) >= 1500 GROUP BY a.path, a.no),
fin AS (SELECT path, s, coalesce((SELECT min(no) FROM lg WHERE lg.path = raw.path AND lg.no BETWEEN e + 1 AND e + 10), e)::INT AS e FROM raw),
w AS (
  SELECT path, s, e FROM fin WHERE s = 1
  UNION ALL
  SELECT f.path, f.s, f.e FROM w JOIN tot USING (path) JOIN fin f ON f.path = w.path
    AND f.s = CASE WHEN w.e - 3 > w.s THEN w.e - 3 ELSE w.e + 1 END WHERE w.e < tot.n)
SELECT w.path AS doc_id, s AS start_line, e AS end_line, string_agg(line, chr(10) ORDER BY no) AS content
FROM w JOIN ln ON ln.path = w.path AND ln.no BETWEEN s AND e GROUP BY w.path, s, e HAVING length({S.strip('string_agg(line, chr(10) ORDER BY no)')}) > 50""")
def seg2(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return G.line_windows(docs)


# --- passages: marks replace look-around, packing is a recursive walk ------------------------------------------------------
def _pack(parts: str, key: str) -> str:
    """Recursive greedy packing of ``parts(key, prefix, k, p)``."""
    return f"""
pk AS (
  SELECT {key}, 0::BIGINT AS k, prefix AS cur, NULL::VARCHAR AS emitted FROM (SELECT DISTINCT {key}, prefix FROM {parts})
  UNION ALL
  SELECT {', '.join('q.' + x.strip() for x in key.split(','))}, q.k,
    CASE WHEN length(pk.cur) + length(q.p) > 800 AND length(pk.cur) > 50 THEN q.prefix ELSE pk.cur END || q.p || ' ',
    CASE WHEN length(pk.cur) + length(q.p) > 800 AND length(pk.cur) > 50 THEN pk.cur END
  FROM pk JOIN {parts} q ON {' AND '.join(f'q.{x.strip()} = pk.{x.strip()}' for x in key.split(','))} AND q.k = pk.k + 1)"""


@query("seg20_sentence_passages", f"""
WITH RECURSIVE st AS (SELECT doc_id, '' AS prefix, string_split({S.rx(S.strip_markdown('text'), r'([.!?])\s+', chr(92) + '1' + chr(1))}, chr(1)) AS ss FROM documents),
parts AS (SELECT doc_id, prefix, unnest(range(1, len(ss) + 1)) AS k, unnest(ss) AS p FROM st), {_pack('parts', 'doc_id')},
lastk AS (SELECT doc_id, arg_max(cur, k) AS cur, max(k) + 1 AS k FROM pk GROUP BY doc_id),
ps AS (SELECT doc_id, k, {S.strip('emitted')} AS passage FROM pk WHERE emitted IS NOT NULL
  UNION ALL SELECT doc_id, k, {S.strip('cur')} FROM lastk WHERE length({S.strip('cur')}) > 50)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS ord, passage FROM ps""")
def seg20(spark, d):
    return G.sentence_passages(table(spark, d, "documents").select("doc_id", "text"), "text")


@query("seg19_passages", f"""
WITH RECURSIVE {cte('wiki')},
sec AS (SELECT path, unnest(range(1, len(ss) + 1)) AS sno, unnest(ss) AS body FROM
  (SELECT path, string_split({S.rx('content', '(?m)^(#{1,3}' + chr(92) + 's)', chr(1) + chr(92) + '1')}, chr(1)) AS ss FROM wiki)),
hd AS (SELECT path, sno, body, regexp_extract(body, '^(#{{1,3}}\\s+[^\\n]+?)(?:\\n|$)', 1) AS hl FROM sec WHERE length({S.strip('body')}) > 0),
pr AS (SELECT path, sno, CASE WHEN {S.strip(S.rx('hl', '^#+' + chr(92) + 's*', ''))} <> '' THEN '[' || {S.strip(S.rx('hl', '^#+' + chr(92) + 's*', ''))} || '] ' ELSE '' END AS prefix,
  list_filter(string_split_regex(CASE WHEN hl <> '' THEN regexp_replace(body, '^#{{1,3}}\\s+[^\\n]+?(?:\\n|$)', '') ELSE body END, '\\n\\n+'),
              lambda p: length({S.strip('p')}) > 30) AS ps FROM hd),
parts AS (SELECT path, sno, prefix, unnest(range(1, len(ps) + 1)) AS k, unnest(list_transform(ps, lambda p: {S.strip_markdown('p')})) AS p FROM pr),
{_pack('parts', 'path, sno')},
lastk AS (SELECT path, sno, arg_max(cur, k) AS cur, max(k) + 1 AS k FROM pk GROUP BY path, sno),
ps AS (SELECT path, sno, k, {S.strip('emitted')} AS passage FROM pk WHERE emitted IS NOT NULL
  UNION ALL SELECT path, sno, k, {S.strip('cur')} FROM lastk WHERE length({S.strip('cur')}) > 50
  UNION ALL SELECT path, sno, 1, {S.strip('prefix')} FROM pr WHERE len(ps) = 0 AND length({S.strip('prefix')}) > 50)
SELECT path, (row_number() OVER (PARTITION BY path ORDER BY sno, k) - 1)::INT AS ord, passage FROM ps""")
def seg19(spark, d):
    return G.passages(derive(spark, d, "wiki").select("path", "content"), sentences=False)


# --- TypeScript: declarations by pattern and depth; parts that SQL can say are checked --------------
from corpusloom.operators import segment_code as K  # noqa: E402


@query("seg3_typescript")
def seg3(spark, d):
    return K.segment_typescript(derive(spark, d, "code_ts")).select(
        *COLS, "parent_name", "documentation", "signature", "is_public"
    )


_IMP = r"(?m)^import\s[^;''\"]*[''\"]([^''\"]+)[''\"]"


@query("seg4_import_block", f"""
WITH {cte('code_ts')}, {lines_cte('code_ts')},
im AS (SELECT path, min(no) AS s, max(no) AS e FROM ln WHERE starts_with(line, 'import ') GROUP BY path)
SELECT path, s AS start_line, e AS end_line, regexp_extract_all(content, '{_IMP}', 1) AS imports FROM im JOIN code_ts USING (path)""")
def seg4(spark, d):
    return K.import_block(derive(spark, d, "code_ts")).select("path", "start_line", "end_line", "imports")


def declarations(spark, d):
    lines = T.explode_lines(derive(spark, d, "code_ts"), "content", "path")
    name, kind = G._first_group(F.col("line"), K.TOP_RULES)
    return lines.select("path", "line_no", "line", name.alias("name"), kind.alias("kind")).where("kind IS NOT NULL")


_DECL = f"""
WITH {cte('code_ts')}, {lines_cte('code_ts')},
dc AS (SELECT path, no::INT AS line_no, line, name, type AS kind FROM (SELECT *, {rule_case(K.TOP_RULES)} FROM ln) WHERE type IS NOT NULL)"""
_PAR = S.rx(S.strip(S.rx(S.rx(S.rx(r"regexp_extract(line, '(?s)^[^(]*\((.*?)\)\s*(?::[^{};]*)?\s*(?:[{;]|=>|$)', 1)",
            r"\s*=\s*[^,]+", ""), r"\b(?:public|private|protected|readonly)\s+", ""), r"\s+", " ")), r"\s*,\s*", ", ")


@query("seg5_declaration_role", f"""{_DECL}
SELECT path, line_no, CASE kind
 WHEN 'class' THEN CASE WHEN ends_with(lower(name), 'controller') THEN 'controller' WHEN ends_with(lower(name), 'service') THEN 'service'
   WHEN regexp_matches(lower(name), 'repository$|repo$') THEN 'repository' WHEN regexp_matches(lower(name), 'model$|entity$') THEN 'model'
   WHEN ends_with(lower(name), 'middleware') THEN 'middleware' WHEN ends_with(lower(name), 'handler') THEN 'handler'
   WHEN ends_with(lower(name), 'component') THEN 'component' ELSE 'class' END
 WHEN 'function' THEN CASE WHEN regexp_matches(lower(name), '^use.') THEN 'hook' WHEN regexp_matches(lower(name), '^test|^it|spec') THEN 'test'
   WHEN contains(lower(name), 'handle') THEN 'handler' WHEN regexp_matches(lower({_PAR}), 'req\\b.*res\\b.*next\\b') THEN 'middleware' ELSE 'function' END
 WHEN 'variable' THEN CASE WHEN regexp_matches(line, '=\\s*(?:async\\s*)?(?:function\\b|\\([^)]*\\)\\s*(?::[^=]+)?=>|[\\w$]+\\s*=>)') THEN
     CASE WHEN upper(name[1]) = name[1] AND length(name) > 1 THEN 'component' WHEN starts_with(lower(name), 'use') THEN 'hook' ELSE 'function' END
   WHEN regexp_matches(line, '=\\s*\\{{') AND regexp_matches(lower(name), 'config|options|settings') THEN 'config' ELSE 'constant' END
 ELSE kind END AS role FROM dc""")
def seg5(spark, d):
    name, kind, line = F.col("name"), F.col("kind"), F.col("line")
    role = (
        F.when(kind == "class", K.class_role(name, F.lit("")))
        .when(kind == "function", K.function_role(name, K.parameters(line)))
        .when(kind == "variable", K.variable_role(name, line))
        .otherwise(kind)
    )
    return declarations(spark, d).select("path", "line_no", role.alias("role"))


@query("seg6_signature", f"""{_DECL}
SELECT path, line_no, name || '(' || {_PAR} || ')' || {S.strip(S.rx("regexp_extract(line, '(?s)^[^(]*" + chr(92) + "(.*?" + chr(92) + ")" + chr(92) + "s*(:[^{};]*?)" + chr(92) + "s*(?:[{;]|=>|$)', 1)", chr(92) + "s+", " "))} AS signature
FROM dc WHERE kind = 'function'""")
def seg6(spark, d):
    rows = declarations(spark, d).where("kind = 'function'")
    return rows.select("path", "line_no", K.signature(F.col("name"), F.col("line")).alias("signature"))


@query("seg7_public_flag", f"""{_DECL}
SELECT path, line_no, regexp_matches(line, '^\\s*export\\b') AS exported, regexp_matches(line, '\\bprivate\\b') AS private FROM dc""")
def seg7(spark, d):
    line = F.col("line")
    return declarations(spark, d).select(
        "path", "line_no", K.is_exported(line).alias("exported"), K.is_private(line).alias("private")
    )


# --- routing: the derived code of all languages as one corpus ---------------------------------------------
CODE = ["code_py", "code_go", "code_cs", "code_rs", "code_sql", "code_jcl", "code_cbl", "code_ts"]


def mixed_corpus(spark, d, names):
    out = None
    for name in names:
        part = derive(spark, d, name).select("path", "content")
        out = part if out is None else out.unionByName(part)
    return out


_ROUTED = {
    "code_py": ("python", "seg8_python"), "code_go": ("go", "seg11_go"), "code_cs": ("csharp", "seg9_csharp"),
    "code_rs": ("rust", "seg12_generic"), "code_sql": ("sql", "seg16_sql"), "code_jcl": ("jcl", "seg15_jcl"),
    "code_cbl": ("cobol", "seg18_merge_small"),
}
_ROUTED_SQL = " UNION ALL ".join(
    f"SELECT path || ':' || start_line || '-' || end_line AS chunk_id, '{lang}' AS language, "
    f"path, start_line, end_line, name, chunk_type, content FROM ({CHECKS[key]})"
    for lang, key in _ROUTED.values()
)


@query("seg1_routed_chunks", _ROUTED_SQL)
def seg1(spark, d):
    files = mixed_corpus(spark, d, list(_ROUTED))
    return K.segment_files(files).select("chunk_id", "language", *COLS)


@query("seg1_routed_chunks_with_typescript")
def seg1b(spark, d):
    return K.segment_files(mixed_corpus(spark, d, CODE)).select("chunk_id", "language", *COLS, "context_path")


def _q(p: str) -> str:
    return p.replace("'", "''")


_SYM = " UNION ALL ".join(
    [f"SELECT path, no AS line_no, '{k}' AS kind, regexp_extract(line, '{_q(p)}', 1) AS name, "
     f"regexp_extract(line, '{_q(p)}', 1) || {f'''regexp_extract(line, '{_q(p)}', 2)''' if w else repr('')} AS signature "
     f"FROM ln WHERE NOT ends_with(path, '.py') AND regexp_matches(line, '{_q(p)}')" for k, p, w in K.JS_SYMBOLS]
    + [f"SELECT path, no, '{k}', regexp_extract(line, '{_q(p)}', 1), "
       f"regexp_extract(line, '{_q(p)}', 1) || {f'''regexp_extract(line, '{_q(p)}', 2)''' if w else repr('')} "
       f"FROM ln WHERE ends_with(path, '.py') AND regexp_matches(line, '{_q(p)}')" for k, p, w in K.PY_SYMBOLS]
    + [f"SELECT path, no, 'import', m, m FROM (SELECT *, coalesce(nullif(regexp_extract(line, '{K.PY_IMPORT}', 1), ''), "
       f"regexp_extract(line, '{K.PY_IMPORT}', 2)) AS m FROM ln WHERE ends_with(path, '.py') AND regexp_matches(line, '{K.PY_IMPORT}'))"]
)
_BOTH = "both_src AS (SELECT path, content FROM code_ts UNION ALL SELECT path, content FROM code_py)"
SYMBOLS_SQL = f"{cte('code_ts', 'code_py')}, {_BOTH}, {lines_cte('both_src')}, sym AS ({_SYM})"


def both_languages(spark, d):
    return derive(spark, d, "code_ts").select("path", "content").unionByName(
        derive(spark, d, "code_py").select("path", "content")
    )


@query("seg22_symbols", f"WITH {SYMBOLS_SQL} SELECT path, line_no, kind, name, signature FROM sym")
def seg22(spark, d):
    return K.symbols(both_languages(spark, d))


@query("agg4_symbol_counts", f"WITH {SYMBOLS_SQL} SELECT kind, count(*) AS n FROM sym GROUP BY kind")
def agg4c(spark, d):
    return K.symbols(both_languages(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query("grf11_import_edges", f"WITH {SYMBOLS_SQL} SELECT DISTINCT path AS src, name AS dst FROM sym WHERE kind = 'import'")
def grf11(spark, d):
    return K.import_edges(both_languages(spark, d))
