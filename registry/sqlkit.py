"""Pieces of DuckDB SQL shared by the check queries."""

from __future__ import annotations

DELIMS = r"""[\s.,;:!?()\[\]{}<>=+\-*/&|^~`"''#@$%\\]+"""


def rx(text: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({text}, '{pattern}', '{repl}', 'g')"


def tokens(text: str) -> str:
    spaced = rx(rx(text, "([a-z])([A-Z])", r"\1 \2"), "([A-Z]+)([A-Z][a-z])", r"\1 \2")
    return (
        f"list_filter(string_split_regex(replace(lower({spaced}), '_', ' '), '{DELIMS}'), "
        f"lambda t: length(t) >= 2)"
    )


def words(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '\\s+'), lambda w: length(w) > 2)"


def strip(text: str) -> str:
    return rx(text, r"^\s+|\s+$", "")


def strip_markdown(text: str) -> str:
    out = rx(text, "(?s)```.*?```", "")
    out = rx(out, "`[^`]+`", "")
    out = rx(out, r"\[([^\]]+)\]\([^)]+\)", r"\1")
    out = rx(out, "[*_~]+", "")
    out = rx(out, r"(?m)^#+\s*", "")
    out = rx(out, r"\n{3,}", "\n\n")
    return strip(out)


def clean_markdown(text: str) -> str:
    out = rx(text, r"(?m)^#+\s+[^\n]*", "")
    out = rx(out, r"\[([^\]]+)\]\([^)]+\)", r"\1")
    out = rx(out, r"\*\*([^*]+)\*\*", r"\1")
    out = rx(out, r"\*([^*]+)\*", r"\1")
    out = rx(out, "`([^`]+)`", r"\1")
    out = rx(out, r"\n{3,}", "\n\n")
    return strip(out)


def site_slug(text: str) -> str:
    return rx(rx(rx(f"lower({text})", r"[^A-Za-z0-9_\s-]", ""), r"\s+", "-"), "-+", "-")


def base_name(path: str) -> str:
    return f"regexp_extract({path}, '([^/]*)$', 1)"


def extension(path: str) -> str:
    return f"lower(regexp_extract({base_name(path)}, '^.+(\\.[^.]*)$', 1))"


def stem(path: str) -> str:
    return rx(base_name(path), r"^(.+)\.[^.]*$", r"\1")


def dir_name(path: str) -> str:
    return f"(CASE WHEN instr({path}, '/') > 0 THEN regexp_extract({path}, '^(.*)/[^/]*$', 1) ELSE '.' END)"


def inlist(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def suffix_any(path: str, suffixes: list[str]) -> str:
    return "(" + " OR ".join(f"ends_with({path}, '{s}')" for s in suffixes) + ")"


def mapping(key: str, values: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())
    return f"(CASE {key} {whens} ELSE {default} END)"


def upper_first(w: str) -> str:
    return f"upper({w}[1]) || {w}[2:]"


# --- the inverted index over documents -------------------------------------------------------
def index_ctes(docs: str = "documents", doc_id: str = "doc_id", text: str = "text") -> str:
    return f"""
toks AS (SELECT {doc_id} AS doc_id, {tokens(text)} AS ts FROM {docs}),
tf AS (SELECT doc_id, len(ts) AS dl, t AS term, count(*) AS tf
       FROM toks, unnest(ts) AS u(t) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
cs AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM toks)"""


def bm25_ctes(queries: str = "queries") -> str:
    return f"""
qt AS (SELECT query_id, t AS term, count(*) AS qtf
       FROM (SELECT query_id, {tokens('query')} AS ts FROM {queries}), unnest(ts) AS u(t) GROUP BY ALL),
scored AS (
  SELECT qt.query_id, tf.doc_id,
         sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) *
             (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (dl / avgdl))))) AS score
  FROM qt JOIN tf USING (term) JOIN dfs USING (term), cs GROUP BY ALL)"""


def ranked(source: str, k: int, order: str = "round(score, 9) DESC, doc_id", group: str = "query_id") -> str:
    return (
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rank "
        f"FROM {source}) WHERE rank <= {k}"
    )
