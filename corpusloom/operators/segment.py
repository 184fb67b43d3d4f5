"""Segmentation of files into typed chunks.

A file is one row, so every segmenter is one expression over the array of its lines:
no shuffle, no Python, one output row per chunk. The shape is the same everywhere: flag the
lines where something starts or ends (marks), let each start run to the next mark, cut
the lines. Brace depth and similar context are prefix scans over the same array.

Chunks: ``path, start_line, end_line, name, chunk_type, content`` plus columns of the language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import fixed
from corpusloom.functions import text as T
from corpusloom.functions.arrays import bind, count_of, held, scan

MIN_CHARS = fixed.MIN_CHUNK_CHARS
MAX_CHARS = fixed.MAX_CHUNK_CHARS


# --- shared shape ----------------------------------------------------------------------
def _lines(content: Column) -> Column:
    return F.split(content, "\n")


def _cut(lines: Column, start: Column, end: Column) -> Column:
    """Lines start..end, 1-based and inclusive, as text."""
    return F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "\n")


def _mark(line: Column, kind: str, name: Column, chunk_type: Column | str) -> Column:
    ty = F.lit(chunk_type) if isinstance(chunk_type, str) else chunk_type
    return F.struct(
        line.cast("int").alias("line"), F.lit(kind).alias("kind"), name.alias("name"), ty.alias("type")
    )


_MARKS = "array<struct<line:int,kind:string,name:string,type:string>>"


def _no_marks() -> Column:
    return F.array().cast(_MARKS)


def _first_group(line: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Name and type from the first rule whose pattern matches; both null if none does."""
    name = ty = None
    for pattern, kind in rules:
        hit = F.regexp_extract(line, pattern, 1)
        ok = line.rlike(pattern)
        name = F.when(ok, hit) if name is None else name.when(ok, hit)
        ty = F.when(ok, F.lit(kind)) if ty is None else ty.when(ok, F.lit(kind))
    return name, ty


def _first_rule(line: Column, rules: list[tuple[str, str]]) -> Column:
    """Name and type of ``_first_group`` as one struct, null if no pattern matches; each is tried once."""
    out = None
    for pattern, kind in rules:
        found = F.struct(F.regexp_extract(line, pattern, 1).alias("name"), F.lit(kind).alias("type"))
        out = F.when(line.rlike(pattern), found) if out is None else out.when(line.rlike(pattern), found)
    return out


def depth_after(lines: Column) -> Column:
    """Brace depth after each line."""
    return scan(
        F.transform(lines, lambda x: count_of(x, "{") - count_of(x, "}")),
        F.lit(0),
        lambda d, delta: d + delta,
    )


def _with_depth(lines: Column) -> Column:
    """``struct(line, before, after)`` per line."""
    return F.zip_with(
        lines,
        depth_after(lines),
        lambda x, d: F.struct(
            x.alias("line"),
            (d - (count_of(x, "{") - count_of(x, "}"))).alias("before"),
            d.alias("after"),
        ),
    )


def _segments(lines: Column, marks: Column) -> Column:
    """Chunks from marks: a start runs to the next mark (before a start, through an end)."""

    def chunk(m: Column, j: Column) -> Column:
        nxt = F.try_element_at(marks, j + 2)
        end = F.coalesce(
            F.when(nxt["kind"] == "s", nxt["line"] - 1), F.when(nxt["kind"] == "e", nxt["line"]),
            F.size(lines),
        )
        return F.struct(
            m["kind"].alias("kind"),
            m["line"].alias("start_line"),
            end.alias("end_line"),
            m["name"].alias("name"),
            m["type"].alias("chunk_type"),
            F.when(m["kind"] == "s", _cut(lines, m["line"], end)).alias("content"),
        )

    return F.filter(F.transform(marks, chunk), lambda c: c["kind"] == "s")


def _emit(files: DataFrame, chunks: Column) -> DataFrame:
    keep = [c for c in files.columns if c not in ("content", "name", "chunk_type")]
    out = files.select(*keep, F.inline(chunks))
    return out.drop("kind") if "kind" in out.columns else out


def whole_files(files: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """One ``file`` chunk for every file that has none in ``chunks``."""
    rest = files if chunks is None else files.join(chunks.select("path").distinct(), "path", "left_anti")
    return rest.select(
        *[c for c in rest.columns if c != "content"],
        F.lit(1).alias("start_line"),
        F.size(_lines(F.col("content"))).alias("end_line"),
        T.stem("path").alias("name"),
        F.lit("file").alias("chunk_type"),
        "content",
    )


def _or_whole_file(lines: Column, chunks: Column) -> Column:
    """The chunks, or the whole file as one chunk; decided on the row, without a join."""
    whole = F.array(
        F.struct(
            F.lit("s").alias("kind"),
            F.lit(1).alias("start_line"),
            F.size(lines).alias("end_line"),
            T.stem("path").alias("name"),
            F.lit("file").alias("chunk_type"),
            F.array_join(lines, "\n").alias("content"),
        )
    )
    return held(chunks, lambda c: F.when(F.size(c) > 0, c).otherwise(whole))


# --- Python --------------------------------------------------------------------------------
PY_RULES = [(r"^\s*class\s+(\w+).*?:", "class"), (r"^(?:async\s+)?def\s+(\w+)\s*\(", "function")]
PY_DECORATOR = r"^\s*@(\w+)"


def python_chunks(lines: Column) -> Column:
    runs = scan(
        F.transform(lines, lambda x: x.rlike(PY_DECORATOR)),
        F.lit(0),
        lambda n, deco: F.when(deco, n + 1).otherwise(0),
    )

    def mark(pair: Column, i: Column) -> Column:
        def found(rule: Column) -> Column:
            start = F.array(_mark(i + 1 - pair["above"], "s", rule["name"], rule["type"]))
            return F.when(rule.isNotNull(), start).otherwise(_no_marks())

        return held(_first_rule(pair["line"], PY_RULES), found)

    before = F.concat(F.array(F.lit(0)), runs)
    pairs = F.zip_with(
        lines, F.slice(before, F.lit(1), F.size(lines)),
        lambda x, n: F.struct(x.alias("line"), n.alias("above")),
    )
    marks = F.flatten(F.transform(pairs, mark))
    return _or_whole_file(lines, held(marks, lambda m: _segments(lines, m)))


def segment_python(files: DataFrame) -> DataFrame:
    """Any class and every top-level function, with the decorator lines directly above."""
    out = _emit(files, held(_lines(F.col("content")), python_chunks))
    head = F.regexp_extract("content", r"^((?:[ \t]*@[^\n]*\n)*)", 1)
    decorators = F.regexp_extract_all(head, F.lit(r"(?m)^\s*@(\w+)"), 1)
    return out.withColumn("decorators", decorators)


# --- C# and Java-like ------------------------------------------------------------------------
CS_RULES = [
    (r"^\s*namespace\s+([\w.]+)", "module"),
    (
        r"^\s*(?:public|private|internal|protected)?\s*(?:static|abstract|sealed|partial)?\s*class\s+(\w+)",
        "class",
    ),
    (r"^\s*(?:public|private|internal)?\s*interface\s+(\w+)", "interface"),
    (
        r"^\s*(?:public|private|protected|internal)?\s*(?:static|virtual|override|async)?\s*"
        r"[\w<>\[\],\s]+\s+(\w+)\s*\(",
        "method",
    ),
]
#: A word that stands in every line the pattern fits, looked for first as that costs less.
CS_WORDS = ["namespace", "class", "interface", "("]
_STARTS = "array<struct<name:string,type:string>>"
_CLOSED = "array<struct<end:int,line:int,turn:int,name:string,type:string>>"


def _least_ahead(depths: Column, levels: Column) -> Column:
    """Arrays whose entry i is the least depth of the next 2 ** k lines from i on, for k = 0 to ``levels``."""

    def doubled(known: Column, k: Column) -> Column:
        return held(
            F.element_at(known, -1),
            lambda last: F.concat(
                known, F.array(F.transform(last, lambda v, i: F.least(v, F.get(last, i + _power(k)))))
            ),
        )

    return F.aggregate(F.sequence(F.lit(0), levels - 1), F.array(depths), doubled)


def _power(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), k)


def brace_chunks(lines: Column, minimum: int = MIN_CHARS) -> Column:
    """Chunks of a file by brace nesting; see ``segment_braces``."""

    def starts(line: Column) -> Column:
        found = []
        for (pattern, kind), word in zip(CS_RULES, CS_WORDS):
            ok = F.contains(line, F.lit(word))
            if kind == "method":
                ok = ok & ~F.contains(line, F.lit(";"))
            one = F.array(F.struct(F.regexp_extract(line, pattern, 1).alias("name"), F.lit(kind).alias("type")))
            found.append(F.when(ok & line.rlike(pattern), one).otherwise(F.array().cast(_STARTS)))
        return F.concat(*found)

    def step(s: Column, x: Column) -> Column:
        return F.struct(
            (s["depth"] + x["opens"] - x["closes"]).alias("depth"),
            (s["opened"] + (x["opens"] > 0).cast("int")).alias("opened"),
        )

    numbered = F.transform(
        lines,
        lambda x, i: F.struct(
            (i + 1).cast("int").alias("i"), count_of(x, "{").alias("opens"), count_of(x, "}").alias("closes"),
            starts(x).alias("starts"),
        ),
    )
    # a line without a brace and a start changes nothing, so the scan passes over it
    marked = F.filter(numbered, lambda m: (m["opens"] > 0) | (m["closes"] > 0) | (F.size(m["starts"]) > 0))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("opened"))

    def closed(ms: Column, states: Column, opening: Column, levels: Column, ahead: Column) -> Column:
        def end_of(m: Column, s: Column) -> Column:
            """Number of the first line from the first brace on at whose end the depth is back."""
            level = s["depth"] - m["opens"] + m["closes"]
            first = F.get(opening, s["opened"] - (m["opens"] > 0).cast("int"))
            at = F.aggregate(
                F.sequence(levels, F.lit(0)),
                first,
                lambda p, k: F.when(F.get(F.get(ahead, k), p) > level, p + _power(k)).otherwise(p),
            )
            return F.get(ms, at)["i"]

        def ends(m: Column, i: Column) -> Column:
            return held(
                end_of(m, F.get(states, i)),
                lambda end: F.transform(
                    m["starts"],
                    lambda b, turn: F.struct(
                        end.alias("end"), m["i"].alias("line"), turn.alias("turn"),
                        b["name"].alias("name"), b["type"].alias("type"),
                    ),
                ),
            )

        found = F.transform(ms, lambda m, i: F.when(F.size(m["starts"]) > 0, ends(m, i)).otherwise(F.array().cast(_CLOSED)))
        return F.array_sort(F.filter(F.flatten(found), lambda c: c["end"].isNotNull()))

    def done(ms: Column) -> Column:
        opening = F.filter(
            F.transform(ms, lambda m, i: F.when(m["opens"] > 0, i)), lambda i: i.isNotNull()
        )
        levels = F.length(F.bin(F.size(ms).cast("long")))
        return held(
            scan(ms, zero, step),
            lambda states: held(
                F.struct(
                    opening.alias("opening"), levels.alias("levels"),
                    _least_ahead(F.transform(states, lambda s: s["depth"]), levels).alias("ahead"),
                ),
                lambda t: closed(ms, states, t["opening"], t["levels"], t["ahead"]),
            ),
        )

    cut = F.transform(
        held(marked, done),
        lambda c: F.struct(
            F.lit("s").alias("kind"), c["line"].alias("start_line"), c["end"].alias("end_line"),
            c["name"].alias("name"), c["type"].alias("chunk_type"),
            _cut(lines, c["line"], c["end"]).alias("content"),
        ),
    )
    return _or_whole_file(lines, F.filter(cut, lambda c: F.length(c["content"]) >= minimum))


def segment_braces(files: DataFrame, minimum: int = MIN_CHARS) -> DataFrame:
    """Namespaces, classes, interfaces and methods by brace nesting (C#, Java, Kotlin).

    One fold over the lines carries the depth. A construct ends at the first line, from that of its
    first brace on, at whose end the depth is back at what it was; that line is found by doubling
    steps, so constructs that stay open cost no more than others.
    """
    return _emit(files, held(_lines(F.col("content")), lambda lines: brace_chunks(lines, minimum)))


def _start(x: Column, i: Column, rules: list[tuple[str, str]]) -> Column:
    """The start that a line of depth 0 holds, if any."""

    def found(rule: Column) -> Column:
        start = F.array(_mark(i + 1, "s", rule["name"], rule["type"]))
        return F.when(rule.isNotNull(), start).otherwise(_no_marks())

    return F.when(x["before"] == 0, held(_first_rule(x["line"], rules), found)).otherwise(_no_marks())


# --- Go -----------------------------------------------------------------------------------------
GO_RULES = [
    (r"^type\s+(\w+)\s+struct\s*\{", "model"),
    (r"^type\s+(\w+)\s+interface\s*\{", "interface"),
    (r"^func\s+(?:\([\w\s*]+\)\s+)?(\w+)\s*\(", "function"),
]


def go_chunks(lines: Column) -> Column:
    def mark(x: Column, i: Column) -> Column:
        start = _start(x, i, GO_RULES)
        stop = F.when(
            (x["after"] == 0) & F.contains(x["line"], F.lit("}")),
            F.array(_mark(i + 1, "e", F.lit(None).cast("string"), F.lit(None).cast("string"))),
        ).otherwise(_no_marks())
        return F.concat(start, stop)

    marks = F.flatten(F.transform(_with_depth(lines), mark))
    return _or_whole_file(lines, held(marks, lambda m: _segments(lines, m)))


def segment_go(files: DataFrame) -> DataFrame:
    """Functions and struct or interface types at depth 0, closed when the depth returns to 0."""
    return _emit(files, held(_lines(F.col("content")), go_chunks))


# --- any other language ---------------------------------------------------------------------------
GENERIC_RULES = [
    (r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)", "function"),
    (r"^(?:export\s+)?const\s+(\w+)\s*=", "function"),
    (r"^def\s+(\w+)", "function"),
    (r"^func\s+(\w+)", "function"),
    (r"^pub\s+fn\s+(\w+)", "function"),
    (r"^(?:public|private)?\s*(?:static)?\s*\w+\s+(\w+)\s*\(", "function"),
]


def generic_chunks(lines: Column, minimum: int = MIN_CHARS) -> Column:
    def mark(x: Column, i: Column) -> Column:
        return _start(x, i, GENERIC_RULES)

    marks = F.flatten(F.transform(_with_depth(lines), mark))
    led = held(
        marks,
        lambda m: F.when(F.try_element_at(m, F.lit(1))["line"] == 1, m).otherwise(
            F.concat(F.array(_mark(F.lit(1), "s", F.lit("module"), "function")), m)
        ),
    )
    trimmed = F.transform(
        held(led, lambda m: _segments(lines, m)),
        lambda c: c.withField("content", T.strip_ends(c["content"])),
    )
    return _or_whole_file(lines, F.filter(trimmed, lambda c: F.length(c["content"]) >= minimum))


def segment_generic(files: DataFrame, minimum: int = MIN_CHARS) -> DataFrame:
    """Six kinds of starts at depth 0; text before the first is chunk ``module``."""
    return _emit(files, held(_lines(F.col("content")), lambda lines: generic_chunks(lines, minimum)))


# --- SQL scripts ------------------------------------------------------------------------------------
SQL_RULES = [
    (r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:PROCEDURE|PROC)\s+(\w+)", "function"),
    (r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?FUNCTION\s+(\w+)", "function"),
    (r"(?i)^\s*CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)", "model"),
    (r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+(\w+)", "model"),
    (r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?TRIGGER\s+(\w+)", "handler"),
]
SQL_ENDS = ["GO", "END", "END;"]


def sql_chunks(lines: Column) -> Column:
    def classify(x: Column) -> Column:
        stop = T.strip_ends(x).isin(SQL_ENDS)
        return held(
            _first_rule(x, SQL_RULES),
            lambda rule: F.struct(rule["name"].alias("name"), rule["type"].alias("type"), stop.alias("stop")),
        )

    kinds = F.transform(lines, classify)
    # whether a block is open before each line
    after = scan(
        kinds,
        F.lit(False),
        lambda block, k: F.when(k["type"].isin("function", "handler"), True)
        .when(k["stop"] & k["type"].isNull(), False)
        .otherwise(block),
    )
    before = F.concat(F.array(F.lit(False)), after)
    pairs = F.zip_with(
        kinds, F.slice(before, F.lit(1), F.size(kinds)),
        lambda k, b: F.struct(k.alias("k"), b.alias("block")),
    )

    def mark(p: Column, i: Column) -> Column:
        none = F.lit(None).cast("string")
        return (
            F.when(p["k"]["type"].isNotNull(), F.array(_mark(i + 1, "s", p["k"]["name"], p["k"]["type"])))
            .when(p["k"]["stop"] & p["block"], F.array(_mark(i + 1, "e", none, none)))
            .otherwise(_no_marks())
        )

    marks = F.flatten(F.transform(pairs, mark))
    return _or_whole_file(lines, held(marks, lambda m: _segments(lines, m)))


def segment_sql(files: DataFrame) -> DataFrame:
    """CREATE statements; a routine or trigger ends at GO, END or END; on a line of its own."""
    return _emit(files, held(_lines(F.col("content")), sql_chunks))


# --- JCL ------------------------------------------------------------------------------------------------
JCL_JOB = r"^//(\w+)\s+JOB\s"
JCL_PROC = r"^//(\w+)\s+PROC\s"
JCL_EXEC = r"^//(\w*)\s+EXEC\s+(?:PGM=|PROC=)?(\w+)"


def jcl_chunks(lines: Column) -> Column:
    def classify(x: Column) -> Column:
        step = F.regexp_extract(x, JCL_EXEC, 1)
        return F.struct(
            F.when(x.rlike(JCL_JOB), "job").when(x.rlike(JCL_PROC), "proc")
            .when(x.rlike(JCL_EXEC), "exec").alias("kind"),
            F.when(x.rlike(JCL_JOB), F.regexp_extract(x, JCL_JOB, 1))
            .when(x.rlike(JCL_PROC), F.regexp_extract(x, JCL_PROC, 1))
            .when(step != "", step).otherwise(F.regexp_extract(x, JCL_EXEC, 2)).alias("name"),
        )

    kinds = F.transform(lines, classify)
    in_job = scan(
        kinds,
        F.lit(False),
        lambda job, k: F.when(k["kind"] == "job", True).when(k["kind"] == "proc", False).otherwise(job),
    )
    pairs = F.zip_with(kinds, in_job, lambda k, j: F.struct(k.alias("k"), j.alias("job")))

    def mark(p: Column, i: Column) -> Column:
        kind = p["k"]["kind"]
        ty = F.when(kind == "job", "handler").otherwise("function")
        starts = kind.isin("job", "proc") | ((kind == "exec") & ~p["job"])
        return F.when(starts, F.array(_mark(i + 1, "s", p["k"]["name"], ty))).otherwise(_no_marks())

    marks = F.flatten(F.transform(pairs, mark))
    return _or_whole_file(lines, held(marks, lambda m: _segments(lines, m)))


def segment_jcl(files: DataFrame) -> DataFrame:
    """JOB, PROC and EXEC statements; a job takes in its own steps."""
    return _emit(files, held(_lines(F.col("content")), jcl_chunks))


# --- COBOL ------------------------------------------------------------------------------------------------
_AREA = r"(?i)^\s{0,6}\s*"
COBOL_RULES = [
    (_AREA + r"(\w+)\s+DIVISION\s*\.?", "division"),
    (_AREA + r"(\w[\w-]*)\s+SECTION\s*\.?", "section"),
    (_AREA + r"[FS]D\s+(\w[\w-]*)", "fd"),
    (_AREA + r"01\s+(\w[\w-]*)", "item"),
    (r"^\s{0,6}\s*(\w[\w-]*)\s*\.\s*$", "paragraph"),
]
COBOL_COPY = r"(?im)^\s{0,6}\s*COPY\s+[\"']?(\w[\w-]*)[\"']?\s*\.?"
COBOL_PROGRAM = r"(?im)^\s{0,6}\s*PROGRAM-ID\s*\.\s*(\w[\w-]*)"


def paragraph_role(name: Column) -> Column:
    """Role of a COBOL paragraph by its name, first match wins."""
    n = F.lower(name)
    # Name parts by role.
    return (
        F.when(n.rlike("init|start|begin"), "constructor")
        .when(n.rlike("read|fetch|get"), "repository")
        .when(n.rlike("write|update|insert|delete"), "repository")
        .when(n.rlike("valid|check|edit|calc|compute|process|display|print|report"), "function")
        .when(n.rlike("error|abort|exception|term|end|close|final"), "function")
        .when(n.rlike("main"), "handler")
        .otherwise("function")
    )


def cobol_chunks(lines: Column, merge: bool = True) -> Column:
    copybook = F.lower(F.col("path")).rlike(r"\.(cpy|copy)$")

    def classify(x: Column) -> Column:
        return held(
            _first_rule(x, COBOL_RULES),
            lambda rule: F.struct(rule["name"].alias("name"), rule["type"].alias("kind")),
        )

    null = F.lit(None).cast("string")
    zero = F.struct(
        F.lit("").alias("division"), F.lit("").alias("type"), null.alias("name"),
        F.lit(False).alias("new"), F.lit(False).alias("keep"),
    )

    def state(division, ty, name, new, keep) -> Column:
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(
            as_col(division).alias("division"), as_col(ty).alias("type"), as_col(name).alias("name"),
            as_col(new).alias("new"), as_col(keep).alias("keep"),
        )

    def step(s: Column, k: Column) -> Column:
        div, ty, kind, name = s["division"], s["type"], k["kind"], k["name"]
        proper = (F.length(name) > 2) & ~name.rlike("^[0-9]")
        body = F.when(div == "PROCEDURE", "function").otherwise("module")
        same = state(div, ty, null, False, False)
        return (
            F.when(kind == "division",
                   state(F.upper(name), "module", F.concat(F.upper(name), F.lit(" DIVISION")), True, True))
            .when((kind == "section") & (div != ""), state(div, body, name, True, ty != "module"))
            .when((kind == "fd") & (div == "DATA"), state(div, "model", name, True, True))
            .when((kind == "item") & (div == "DATA") & (ty != "module"),
                  state(div, "model", name, True, ty == "model"))
            .when((kind == "paragraph") & (div == "PROCEDURE") & proper,
                  state(div, paragraph_role(name), name, True, ty != "module"))
            .otherwise(same)
        )

    states = scan(F.transform(lines, classify), zero, step)
    marks = F.filter(
        F.transform(states, lambda s, i: F.struct(s.alias("s"), (i + 1).alias("line"))),
        lambda m: m["s"]["new"],
    )

    def chunk(m: Column, j: Column, marks: Column) -> Column:
        nxt = F.try_element_at(marks, j + 2)
        end = F.coalesce(nxt["line"] - 1, F.size(lines))
        return F.struct(
            F.when(F.coalesce(nxt["s"]["keep"], F.lit(True)), "s").alias("kind"),
            m["line"].cast("int").alias("start_line"),
            end.cast("int").alias("end_line"),
            m["s"]["name"].alias("name"),
            m["s"]["type"].alias("chunk_type"),
            _cut(lines, m["line"], end).alias("content"),
            F.concat(m["s"]["division"], F.lit(" DIVISION > "), m["s"]["name"]).alias("context_path"),
        )

    kept = held(
        marks,
        lambda ms: F.filter(
            F.transform(ms, lambda m, j: chunk(m, j, ms)), lambda c: c["kind"].isNotNull()
        ),
    )
    program = F.coalesce(
        F.try_element_at(
            F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(COBOL_PROGRAM), 1), F.lit(-1)
        ),
        T.stem("path"),
    )
    whole = F.array(
        F.struct(
            F.lit("s").alias("kind"), F.lit(1).alias("start_line"), F.size(lines).alias("end_line"),
            program.alias("name"),
            F.when(copybook, "import-block").otherwise("file").alias("chunk_type"),
            F.col("content").alias("content"), null.alias("context_path"),
        )
    )
    merged = (lambda c: merge_small(c)) if merge else (lambda c: c)
    return held(kept, lambda c: F.when((F.size(c) == 0) | copybook, whole).otherwise(merged(c)))


def segment_cobol(files: DataFrame, merge: bool = True) -> DataFrame:
    """Divisions, sections, file and 01-level descriptions, paragraphs.

    A division header directly replaced by a section or paragraph is not kept. A copybook is
    one ``import-block``. ``context_path`` names the division, ``imports`` the copied books
    (on the first chunk of a file).
    """
    out = files.select(
        *[c for c in files.columns if c != "content"],
        F.regexp_extract_all("content", F.lit(COBOL_COPY), 1).alias("copies"),
        F.posexplode(held(_lines(F.col("content")), lambda x: cobol_chunks(x, merge))).alias("ord", "c"),
    )
    return out.select(
        *[c for c in files.columns if c != "content"],
        "c.start_line", "c.end_line", "c.name", "c.chunk_type", "c.content", "c.context_path",
        F.when((F.col("ord") == 0) & (F.size("copies") > 0), F.col("copies")).alias("imports"),
    )


# --- merging small neighbours --------------------------------------------------------------------------------
def merge_small(chunks: Column, minimum: int = 2 * MIN_CHARS) -> Column:
    """Merge runs of chunks shorter than ``minimum`` until a run reaches it.

    A run of several becomes one ``file`` chunk with the names joined; a single one stays.
    Scan over the file's own chunk array: each state holds what its chunk closed and the open run.
    """

    def join(run: Column) -> Column:
        first = F.element_at(run, 1)
        many = first
        for field, value in {
            "start_line": F.array_min(F.transform(run, lambda c: c["start_line"])),
            "end_line": F.array_max(F.transform(run, lambda c: c["end_line"])),
            "name": F.array_join(F.transform(run, lambda c: c["name"]), ", "),
            "chunk_type": F.lit("file"),
            "content": F.array_join(F.transform(run, lambda c: c["content"]), "\n\n"),
        }.items():
            many = many.withField(field, value)
        if_single = F.when(F.size(run) == 1, first).otherwise(many)
        return F.when(F.size(run) == 0, F.slice(run, F.lit(1), F.lit(0))).otherwise(F.array(if_single))

    none = F.slice(chunks, F.lit(1), F.lit(0))

    def step(s: Column, c: Column) -> Column:
        large = F.length(c["content"]) >= minimum
        total = s["chars"] + F.length(c["content"])
        run = F.concat(s["run"], F.array(c))
        return (
            F.when(
                large,
                F.struct(
                    F.concat(join(s["run"]), F.array(c)).alias("out"),
                    F.slice(s["run"], F.lit(1), F.lit(0)).alias("run"), F.lit(0).alias("chars"),
                ),
            )
            .when(
                total >= minimum,
                F.struct(
                    bind(run, join).alias("out"),
                    F.slice(s["run"], F.lit(1), F.lit(0)).alias("run"), F.lit(0).alias("chars"),
                ),
            )
            .otherwise(F.struct(F.slice(s["out"], F.lit(1), F.lit(0)).alias("out"), run.alias("run"), total.alias("chars")))
        )

    zero = F.struct(none.alias("out"), none.alias("run"), F.lit(0).alias("chars"))
    merged = held(
        scan(chunks, zero, step),
        lambda st: F.concat(F.flatten(F.transform(st, lambda s: s["out"])), join(F.element_at(st, -1)["run"])),
    )
    return F.when(F.size(chunks) <= 1, chunks).otherwise(merged)


# --- line windows ------------------------------------------------------------------------------------------------
def line_windows(files: DataFrame, size: int = fixed.WINDOW_CHARS,
                 overlap: int = fixed.WINDOW_OVERLAP_LINES, look: int = fixed.WINDOW_LOOK_AHEAD,
                 least: int = 50) -> DataFrame:
    """Windows of about ``size`` characters that prefer to end at a logical line.

    The end of a window is found by binary search in the running line sizes, so a window costs
    a logarithm of the file's lines; the windows themselves are a scan. Stops at the end of
    the file.
    """

    def chunks(lines: Column) -> Column:
        return bind(
            scan(F.transform(lines, lambda x: F.length(x) + 1), F.lit(0), lambda a, n: a + n),
            lambda ends: _windows(lines, ends, size, overlap, look, least),
        )

    return _emit(files, held(_lines(F.col("content")), chunks))


def _windows(lines: Column, ends: Column, size: int, overlap: int, look: int, least: int) -> Column:
    total = F.size(lines)

    def first_reaching(target: Column, low: Column) -> Column:
        """1-based line whose running size first reaches ``target``; the last line if none."""
        span = F.struct(low.alias("lo"), total.alias("hi"))
        found = F.aggregate(
            F.sequence(F.lit(1), F.lit(32)),
            span,
            lambda s, _: bind(
                F.floor((s["lo"] + s["hi"]) / 2).cast("int"),
                lambda mid: F.when(s["lo"] >= s["hi"], s)
                .when(F.element_at(ends, mid) >= target, F.struct(s["lo"].alias("lo"), mid.alias("hi")))
                .otherwise(F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))),
            ),
        )
        return found["lo"]

    def end_of(start: Column) -> Column:
        base = F.when(start > 1, F.element_at(ends, F.greatest(start - 1, F.lit(1)))).otherwise(0)
        return bind(
            first_reaching(base + size, start),
            lambda end: F.coalesce(
                F.try_element_at(
                    F.filter(
                        F.transform(
                            F.slice(lines, end + 1, F.lit(look)),
                            lambda x, i: F.when(
                                T.strip_ends(x).isin("", "}", "};", "end"), end + i + 1
                            ),
                        ),
                        lambda e: e.isNotNull(),
                    ),
                    F.lit(1),
                ),
                end,
            ).cast("int"),
        )

    def step(s: Column, _: Column) -> Column:
        def advance(end: Column) -> Column:
            back = end - overlap + 1
            nxt = F.when(back > s["start"], back).otherwise(end + 1)
            return F.struct(
                F.when(end >= total, total + 1).otherwise(nxt).cast("int").alias("start"),
                s["start"].alias("start_line"), end.alias("end_line"),
            )

        return F.when(s["start"] > total, F.struct(s["start"].alias("start"), none.alias("start_line"), none.alias("end_line"))).otherwise(
            bind(end_of(s["start"]), advance)
        )

    none = F.lit(None).cast("int")
    zero = F.struct(F.lit(1).alias("start"), none.alias("start_line"), none.alias("end_line"))
    cuts = F.filter(scan(F.sequence(F.lit(1), total), zero, step), lambda s: s["end_line"].isNotNull())
    chunks = F.transform(
        cuts,
        lambda c: F.struct(
            c["start_line"].alias("start_line"), c["end_line"].alias("end_line"),
            _cut(lines, c["start_line"], c["end_line"]).alias("content"),
        ),
    )
    return F.filter(chunks, lambda c: F.length(T.strip_ends(c["content"])) > least)


# --- markdown passages ----------------------------------------------------------------------------------------------
def _pack(parts: Column, prefix: Column, size: int) -> Column:
    """Greedy packing of ordered parts into passages of about ``size`` characters.

    The lengths alone tell where passages begin; each is then joined from its slice of the parts.
    """
    own = F.length(prefix)

    def step(s: Column, n: Column) -> Column:
        full = (s["chars"] + n > size) & (s["chars"] > 50)
        return F.struct(
            (F.when(full, own).otherwise(s["chars"]) + n + 1).alias("chars"),
            full.alias("begins"),
        )

    def packed(ps: Column) -> Column:
        states = scan(F.transform(ps, F.length), F.struct(own.alias("chars"), F.lit(False).alias("begins")), step)
        begins = F.filter(
            F.transform(states, lambda s, i: F.when(s["begins"], i + 1)), lambda i: i.isNotNull()
        )
        bounds = F.concat(F.array(F.lit(1)), begins, F.array(F.size(ps) + 1))

        return bind(
            bounds,
            lambda bs: F.filter(
                F.transform(
                    F.slice(bs, F.lit(2), F.size(bs)),
                    lambda at, i: F.struct(
                        T.strip_ends(
                            F.concat(prefix, F.array_join(F.slice(ps, F.get(bs, i), at - F.get(bs, i)), " "))
                        ).alias("passage"),
                        (i == F.size(bs) - 2).alias("last"),
                    ),
                ),
                lambda x: ~x["last"] | (F.length(x["passage"]) > 50),
            )["passage"],
        )

    return bind(parts, packed)


def _section_passages(content: Column, size: int) -> Column:
    def section(text: Column) -> Column:
        head_line = F.regexp_extract(text, r"^(#{1,3}\s+[^\n]+?)(?:\n|$)", 1)
        head = T.strip_ends(F.regexp_replace(head_line, r"^#+\s*", ""))
        body = F.regexp_replace(text, r"^#{1,3}\s+[^\n]+?(?:\n|$)", "")
        paragraphs = F.transform(
            F.filter(F.split(body, r"\n\n+"), lambda p: F.length(T.strip_ends(p)) > 30),
            T.strip_markdown,
        )
        prefix = F.when(head != "", F.concat(F.lit("["), head, F.lit("] "))).otherwise("")
        return bind(prefix, lambda p: _pack(paragraphs, p, size))

    sections = F.filter(
        F.split(content, r"(?m)(?=^#{1,3}\s)"), lambda s: F.length(T.strip_ends(s)) > 0
    )
    return F.flatten(F.transform(sections, section))


def _sentence_passages(content: Column, size: int) -> Column:
    return _pack(F.split(T.strip_markdown(content), r"(?<=[.!?])\s+"), F.lit(""), size)


def _passage_rows(pages: DataFrame, content: str, found: Column) -> DataFrame:
    keep = [c for c in pages.columns if c != content]
    return pages.select(*keep, F.posexplode(found).alias("ord", "passage"))


def passages(pages: DataFrame, content: str = "content", size: int = fixed.PASSAGE_CHARS,
             sentences: bool = True) -> DataFrame:
    """Passages of a markdown page: ``ord, passage``.

    Sections start at headings of level 1 to 3; paragraphs over 30 characters are packed
    greedily with the heading as prefix. A page without any passage is packed by sentences.
    """
    found = _section_passages(F.col(content), size)
    if sentences:
        found = bind(
            found,
            lambda p: F.when(F.size(p) > 0, p).otherwise(_sentence_passages(F.col(content), size)),
        )
    return _passage_rows(pages, content, found)


def sentence_passages(pages: DataFrame, content: str = "content",
                      size: int = fixed.PASSAGE_CHARS) -> DataFrame:
    """Passages packed from the sentences of the cleaned text."""
    return _passage_rows(pages, content, _sentence_passages(F.col(content), size))


# --- routing ------------------------------------------------------------------------------------------------------------
def prioritized(chunks: DataFrame, most: int, order: str = "chunk_id") -> DataFrame:
    """The ``most`` chunks of highest priority: core code first, tests and vendored code last."""
    p = F.lower("path")
    n = F.length("content")
    score = (
        F.when(p.rlike(r"^(src|lib|app)/"), 100).otherwise(0)
        + F.when(p.rlike(r"index\.|main\.|app\."), 50).otherwise(0)
        + F.when(p.rlike(r"config|\.json$|\.yaml$"), 30).otherwise(0)
        - F.when(T.is_test_file("path"), 50).otherwise(0)
        - F.when(p.rlike(r"vendor/|generated/|\.min\."), 100).otherwise(0)
        + F.when(n < 1000, 20).when(n > 3000, -10).otherwise(0)
    )
    return chunks.withColumn("priority", score).orderBy(F.col("priority").desc(), order).limit(most)
