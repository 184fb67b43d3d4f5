"""Inputs of the registered queries, derived from the given tables row by row.

Each derived table is a list of SQL expressions over one given table, written once and
rendered for Spark and for DuckDB. All rows and whole texts are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from registry.base import table

NL = "\n"


class Dialect:
    """The few places where the two SQL dialects differ."""

    def __init__(self, spark: bool):
        self.spark = spark

    def rx(self, text: str, pattern: str, repl: str) -> str:
        if self.spark:
            q = '"' if "'" in pattern + repl else "'"
            return f"regexp_replace({text}, r{q}{pattern}{q}, r{q}{repl}{q})"
        pattern, repl = pattern.replace("'", "''"), repl.replace("'", "''")
        for i in range(1, 10):
            repl = repl.replace(f"${i}", f"\\{i}")
        return f"regexp_replace({text}, '{pattern}', '{repl}', 'g')"

    def ex(self, text: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({text}, {'r' if self.spark else ''}'{pattern}', {group})"


SPARK, DUCK = Dialect(True), Dialect(False)


def _cols(exprs: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in exprs.items()]


def _case(key: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"(CASE {key} % {len(values)} {whens} ELSE '{values[-1]}' END)"


# --- a project's files -------------------------------------------------------------------
DIRS = ["src", "lib/core", "app/components", "src/hooks", "node_modules/pkg", "tests",
        "src/api", "docs", "vendor/x", "services/auth-user", "utils"]
NAMES = ["index", "main", "useItem", "helper_a", "config", "router", "UserData"]
EXTS = [".ts", ".tsx", ".js", ".py", ".go", ".java", ".md", ".json", ".test.ts", ".png",
        ".cs", ".rb", ".sql"]


def files_exprs(d: Dialect, key: str = "doc_id") -> dict[str, str]:
    path = (
        f"{_case(key, DIRS)} || CASE WHEN {key} % 97 = 0 THEN '/m' || {key} || '/' ELSE '/' END || "
        f"{_case(key, NAMES)} || CASE WHEN {key} % 97 = 0 THEN '' ELSE '_' || {key} END || {_case(key, EXTS)}"
    )
    return {"doc_id": key, "path": path, "size": "n_chars", "content": "text"}


# --- a wiki of markdown pages --------------------------------------------------------------
SECTIONS = ["architecture", "components", "guides", "zeta", "alpha"]


def page_path(key: str) -> str:
    return (
        f"(CASE WHEN ({key}) = 0 THEN 'README.md' WHEN ({key}) % 6 = 0 THEN 'page-' || ({key}) || '.md' "
        f"ELSE (CASE ({key}) % 6 WHEN 1 THEN 'architecture' WHEN 2 THEN 'components' WHEN 3 THEN 'guides' "
        f"WHEN 4 THEN 'zeta-team' ELSE 'alpha' END) || '/page-' || ({key}) || '.md' END)"
    )


def wiki_exprs(d: Dialect) -> dict[str, str]:
    topic = f"'Topic ' || {d.ex('text', '([a-z]{4,})')} || ' ' || (doc_id % 50)"
    up = "(CASE WHEN doc_id % 6 = 0 THEN '' ELSE '../' END)"
    front = (
        f"CASE WHEN doc_id % 3 = 0 THEN '---{NL}title: ' || {topic} || '{NL}description: about ' || lang || "
        f"'{NL}category: ' || source || '{NL}related: ' || {page_path('doc_id + 6')} || ',' || "
        f"{page_path('doc_id * 2 + 1')} || '{NL}---{NL}' ELSE '' END"
    )
    head = f"CASE WHEN doc_id % 4 <> 3 THEN '# ' || {topic} || '{NL}{NL}' ELSE '' END"
    body = d.rx("text", r"(^|\n)([A-F][a-z]+) ([a-z]+)", f"$1## $2 $3{NL}{NL}")
    body = d.rx(body, r"(\n)([I-L][a-z]+) ([a-z]+)", f"$1### $2 `$3`{NL}")
    body = d.rx(body, r" ([a-z]+), ([a-z]+) ", r" **$1** see _$2_ ")
    links = (
        f"'{NL}{NL}[next](' || {up} || {page_path('(doc_id * 7 + 3) % 1200')} || ') and [near](./' || "
        f"{page_path('doc_id % 40 + 3')} || '#part) and [[' || {page_path('doc_id % 90')} || '|See it]] "
        f"or [[Missing ' || (doc_id % 9) || ']] [ext](https://x.org/a.md) [code](src/a.ts:10) "
        f"[esc](../../out.md) [here](#top) [mail](mailto:a@b.c){NL}'"
    )
    first, last = d.ex("text", "([a-z]{3,})"), d.ex("lower(source || text)", "([a-z]{3})")
    pictures = (
        f"'![pic](' || {up} || 'assets/' || {first} || '.png) and [data](./files/' || {last} || '.csv) "
        f"![far](https://x.org/a.png) [dir](../assets/x)" + f"{NL}'"
    )
    code = (
        f"CASE WHEN doc_id % 5 = 0 THEN '{NL}```ts{NL}// Source: src/a' || doc_id || '.ts{NL}const x = 1;{NL}```{NL}' "
        f"WHEN doc_id % 5 = 1 THEN '{NL}```{NL}plain{NL}```{NL}' "
        f"WHEN doc_id % 5 = 2 THEN '{NL}```mermaid{NL}graph TD{NL}A-->B{NL}```{NL}' ELSE '' END"
    )
    refs = (
        "CASE doc_id % 4 WHEN 0 THEN ' See: src/core/a.ts:' || doc_id WHEN 1 THEN ' `src/b.tsx:7` ' "
        "WHEN 2 THEN ' (lib/c.js:9) ' ELSE ' defined in src/d.ts:12.' END"
    )
    return {
        "doc_id": "doc_id",
        "path": page_path("doc_id"),
        "content": f"{front} || {head} || {body} || {links} || {pictures} || {code} || {refs}",
    }


# --- rendering ---------------------------------------------------------------------------------
TABLES = {
    "files": ("documents", files_exprs),
    "wiki": ("documents", wiki_exprs),
    "queries": ("benchmark", lambda d: {"query_id": "item_id", "query": "text"}),
    "fields": (
        "documents",
        lambda d: {
            "doc_id": "doc_id",
            "title": d.ex("text", r"^([^ \n]+ [^ \n]+)"),
            "description": d.ex("text", r"\n([^\n]*)"),
            "content": "text",
        },
    ),
}


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, exprs = TABLES[name]
    return table(spark, sf_dir, base).selectExpr(*_cols(exprs(SPARK)))


def cte(*names: str) -> str:
    """``name AS (SELECT ...)`` list for the check queries."""
    parts = []
    for name in names:
        base, exprs = TABLES[name]
        parts.append(f"{name} AS (SELECT {', '.join(_cols(exprs(DUCK)))} FROM {base})")
    return ", ".join(parts)


# --- source code by language: every sentence of every document becomes one construct ---------
def _code(ext: str, rules: list[tuple[str, str]], head: str = "''"):
    def exprs(d: Dialect) -> dict[str, str]:
        text = f"replace(text, '. ', '.{NL}')"
        for initials, repl in rules:
            text = d.rx(text, rf"(?m)^([{initials}][a-z]+) ([a-z]+)(.*)$", repl)
        return {
            "doc_id": "doc_id",
            "path": f"source || '/f' || doc_id || '{ext}'" if ext.startswith(".") else ext,
            "content": f"{head} || {text}",
        }

    return ("documents", exprs)


TABLES["code_py"] = _code(".py", [
    ("A-F", "@$2\nclass $1($2):\n    x = 1 #$3"),
    ("G-N", "def $2($1):\n    return 1 #$3\n    class Inner$1:"),
    ("O-P", "@$1"),
    ("Q-S", "async def $2(x, y):"),
])
TABLES["code_go"] = _code(".go", [
    ("A-F", "type $1 struct {\n  $2 int //$3\n}"),
    ("G-K", "func $2(x int) {\n  if x {\n $3\n }\n}"),
    ("L-M", "func (r *$1) $2() {}"),
    ("N", "type $1 interface {\n $2()\n}"),
    ("O-P", "func $2(\n a int,"),
])
TABLES["code_cs"] = _code(".cs", [
    ("A-D", "public class $1\n{\n    int $2; //$3"),
    ("E-K", "    public void $2(int a)\n    {\n        call$1(a) //$3\n    }"),
    ("L-M", "interface $1 { void $2$3 }"),
    ("N-S", "}"),
    ("T-U", "    static string $2(int b) { return b }"),
], head=f"'namespace App.Core' || doc_id || '{NL}{{{NL}'")
TABLES["code_rs"] = _code(".rs", [
    ("A-C", "pub fn $2() {\n$3\n}"),
    ("D-F", "function $2() { $3 }"),
    ("G-H", "const $1 = 1;"),
    ("I-J", "static int $2(int a)$3"),
    ("K-N", "export async function $2(a) {\n $3\n}"),
])
TABLES["code_sql"] = _code(".sql", [
    ("A-C", "CREATE TABLE IF NOT EXISTS $1 ($3"),
    ("D-F", "create or replace function $2()\nBEGIN$3"),
    ("G-J", "  END;"),
    ("K-M", "CREATE VIEW $1 AS$3"),
    ("N-O", "CREATE TRIGGER $2 ON $1"),
    ("P-Q", "GO"),
])
TABLES["code_jcl"] = _code(".jcl", [
    ("A-B", "//$1 JOB (ACCT)"),
    ("C-H", "//$1 EXEC PGM=$2"),
    ("I-K", "//$1 PROC X=1"),
    ("L-M", "// EXEC $2"),
])
TABLES["code_cbl"] = _code(
    "source || '/f' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.cpy' ELSE '.cbl' END",
    [
        ("A", "       DATA DIVISION."),
        ("B", "       PROCEDURE DIVISION."),
        ("C-D", "       $2 SECTION."),
        ("E", "       FD  $2-FILE."),
        ("F-H", "       01  $1-REC.$3"),
        ("I-M", "       $1-PARA."),
        ("N", "       COPY $1."),
        ("O", "       read-$2."),
    ],
    head=f"'       IDENTIFICATION DIVISION.{NL}       PROGRAM-ID. PGM' || doc_id || '.{NL}'",
)
TABLES["code_ts"] = _code(".ts", [
    ("A-B", "/**\n * Doc of $1\n */\nexport class $1Service extends Base {\n  private $2: string = 'x'; //$3"),
    ("C-D", "  @Get('$2')\n  async $2Item(id: string, q?: number): Promise<void> {\n    if (id) {\n      call(id); //$3\n    }\n  }"),
    ("E-F", "}"),
    ("G-H", "// note on $2\nexport async function use$1(a: number, b?: string): string {\n  return a; //$3\n}"),
    ("I", "import { $1 } from './$2';"),
    ("J-K", "export interface $1 {\n  $2: string; //$3\n}"),
    ("L-M", "export const $2Config = {\n  a: 1, //$3\n};"),
    ("N", "type $1 = '$2' | 'b';"),
    ("O", "const $1View = (p: number) => {\n  return p; //$3\n};"),
    ("P", "enum $1 { A, B }"),
    ("R-S", "function $2Handler(req, res, next) {\n  next(); //$3\n}"),
    ("T", "  constructor(private a: string) {\n    super(); //$3\n  }"),
])
