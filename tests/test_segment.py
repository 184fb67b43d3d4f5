import pytest

from corpusloom.functions import fixed
from corpusloom.operators import segment as G
from corpusloom.operators import segment_code as K


def files(spark, path, content):
    return spark.createDataFrame([(path, content)], "path string, content string")


def spans(df):
    return [(r["start_line"], r["end_line"], r["name"], r["chunk_type"]) for r in df.orderBy("start_line", "end_line").collect()]


def test_python_decorators_belong_to_the_next_construct(spark):
    src = "import x\n@a\n@b.c(1)\ndef f(x):\n  pass\nclass C:\n  @p\n  def g(self): pass\nasync def h():\n  pass"
    got = G.segment_python(files(spark, "m.py", src))
    assert spans(got) == [(2, 5, "f", "function"), (6, 8, "C", "class"), (9, 10, "h", "function")]
    assert got.where("name = 'f'").first()["decorators"] == ["a", "b"]


def test_csharp_brace_on_next_line_and_nesting(spark):
    body = "      x = 1; // " + "y" * 90
    src = f"namespace N.M\n{{\n  public class A\n  {{\n    public void Run(int a)\n    {{\n{body}\n    }}\n  }}\n}}"
    assert spans(G.segment_braces(files(spark, "a.cs", src))) == [
        (1, 10, "N.M", "module"), (3, 9, "A", "class"), (5, 8, "Run", "method")]


def test_go(spark):
    src = "package m\ntype S struct {\n a int\n}\nvar x = 1\nfunc (s *S) Get() int {\n return 1\n}"
    assert spans(G.segment_go(files(spark, "a.go", src))) == [(2, 4, "S", "model"), (6, 8, "Get", "function")]


def test_sql(spark):
    src = "-- head\ncreate table t (a int);\nCREATE OR REPLACE FUNCTION f()\nBEGIN\nEND;\nselect 1;\nCREATE VIEW v AS select 1"
    assert spans(G.segment_sql(files(spark, "a.sql", src))) == [
        (2, 2, "t", "model"), (3, 5, "f", "function"), (7, 7, "v", "model")]


def test_jcl_job_takes_in_its_steps(spark):
    assert spans(G.segment_jcl(files(spark, "a.jcl", "//J1 JOB (A)\n//S1 EXEC PGM=X\n//P1 PROC A=1\n//S2 EXEC PGM=Y"))) == [
        (1, 2, "J1", "handler"), (3, 3, "P1", "function"), (4, 4, "S2", "function")]


def test_cobol_and_copybook(spark):
    src = ("       IDENTIFICATION DIVISION.\n       PROGRAM-ID. PAY.\n       DATA DIVISION.\n       FILE SECTION.\n"
           "       FD  EMP-FILE.\n       01  EMP-REC.\n       PROCEDURE DIVISION.\n       COPY BOOK1.\n       MAIN-PARA.\n           STOP RUN.\n       READ-EMP.\n           READ X.")
    got = G.segment_cobol(files(spark, "p.cbl", src), merge=False)
    assert spans(got) == [
        (1, 2, "IDENTIFICATION DIVISION", "module"), (4, 4, "FILE", "module"), (5, 5, "EMP-FILE", "model"), (6, 6, "EMP-REC", "model"),
        (9, 10, "MAIN-PARA", "handler"), (11, 12, "READ-EMP", "repository")]
    assert got.where("start_line = 1").first()["imports"] == ["BOOK1"]
    copy = G.segment_cobol(files(spark, "b.cpy", src)).collect()
    assert [(r["name"], r["chunk_type"]) for r in copy] == [("PAY", "import-block")]


def test_generic_and_whole_file(spark):
    rust = "use x;\n" + "// " + "c" * 110 + "\npub fn go() {\n" + "a" * 100 + "\n}\n"
    assert [s[2] for s in spans(G.segment_generic(files(spark, "a.rs", rust)))] == ["module", "go"]
    assert spans(G.segment_generic(files(spark, "d/tiny.rs", "x"))) == [(1, 1, "tiny", "file")]


TS = """import { A } from './a';
import {
  B,
} from "b";

/**
 * Handles users.
 */
@Injectable()
export class UserService extends Base {
  private name: string;
  constructor(private db: Db) {
    super();
  }
  @Get('x')
  async find(id: string, q = 1): Promise<User> {
    if (id) {
      return this.db.find(id); // PAD
    }
  }
  private hidden(a: number) {
    return a; // PAD
  }
}

export const useThing = (a: number) => {
  return a; // PAD
};

export const AppConfig = {
  a: 1, // PAD
};

function handleClick(req, res, next) {
  next(); // PAD
}

interface Shape {
  a: string; // PAD
}
"""


def test_typescript(spark):
    src = TS.replace("PAD", "p" * 420)
    got = {r["name"]: r for r in K.segment_typescript(files(spark, "u.ts", src)).collect()}
    assert got["imports"]["start_line"] == 1 and got["imports"]["end_line"] == 4
    service = got["UserService"]
    assert (service["chunk_type"], service["start_line"], service["end_line"], service["is_public"]) == ("service", 6, 24, True)
    assert service["documentation"].startswith("/**")
    assert (got["find"]["chunk_type"], got["find"]["parent_name"]) == ("handler", "UserService")
    assert got["find"]["signature"] == "find(id: string, q): Promise<User>"
    assert got["hidden"]["is_public"] is False
    assert got["useThing"]["chunk_type"] == "hook"
    assert got["AppConfig"]["chunk_type"] == "config"
    assert got["handleClick"]["chunk_type"] == "handler"
    assert (got["Shape"]["chunk_type"], got["Shape"]["is_public"]) == ("interface", False)
    assert {r["chunk_type"] for r in got.values()} <= set(fixed.CHUNK_TYPES)


def test_small_typescript_file_is_one_chunk(spark):
    assert spans(K.segment_typescript(files(spark, "s.ts", "const a = 1;"))) == [(1, 1, "s", "file")]


def test_routing_by_language(spark):
    rows = [("a.py", "def f():\n  pass"), ("b.go", "func g() {\n}"), ("c.sql", "CREATE TABLE t (a)"), ("d.xyz", "hello")]
    got = K.segment_files(spark.createDataFrame(rows, "path string, content string")).collect()
    assert {(r["chunk_id"], r["language"], r["name"]) for r in got} == {
        ("a.py:1-2", "python", "f"), ("b.go:1-2", "go", "g"), ("c.sql:1-1", "sql", "t"), ("d.xyz:1-1", "unknown", "d")}


def test_segmenters_shuffle_nothing(spark):
    plan = K.segment_files(files(spark, "a.py", "def f(): pass"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def brute_windows(text, size=1500, overlap=4, look=10):
    lines, out, start = text.split("\n"), [], 0
    while start < len(lines):
        end = chars = 0
        end = start
        while end < len(lines) and chars < size:
            chars += len(lines[end]) + 1
            end += 1
        for i in range(end, min(end + look, len(lines))):
            if lines[i].strip() in ("", "}", "};", "end"):
                end = i + 1
                break
        if len("\n".join(lines[start:end]).strip()) > 50:
            out.append((start + 1, end))
        if end >= len(lines):
            break
        start = end - overlap if end - overlap > start else end
    return out


def test_line_windows_against_brute_force(spark):
    import random
    rnd = random.Random(5)
    texts = ["\n".join("w" * rnd.choice([0, 5, 40, 90, 400, 1600]) for _ in range(rnd.randint(1, 700))) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    got = {}
    for r in G.line_windows(df).collect():
        got.setdefault(r["id"], []).append((r["start_line"], r["end_line"]))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == brute_windows(t), i


def test_passages_have_bounded_length(spark):
    para = "This is a sentence that is long enough to count as a paragraph of text."
    page = f"# One\n\n{para}\n\n{para}\n\n## Two\n\n{para} {para}\n\n{para}"
    df = spark.createDataFrame([(1, page), (2, ""), (3, "plain. " * 40)], "id long, content string")
    rows = G.passages(df, size=200).collect()
    assert all(50 < len(r["passage"]) < 400 for r in rows)
    assert {r["id"] for r in rows} == {1, 3}
    assert [r for r in rows if r["id"] == 1][0]["passage"].startswith("[One] ")


def test_symbols(spark):
    src = "import x from 'mod'\nexport const f = async (a) => 1\nexport function g(a, b) {}\nclass C {}"
    got = {(r["line_no"], r["kind"], r["name"], r["signature"]) for r in K.symbols(files(spark, "a.ts", src)).collect()}
    assert got == {(1, "import", "mod", "mod"), (2, "function", "f", "f"), (2, "export", "f", "f"),
                   (3, "function", "g", "g(a, b)"), (3, "export", "g", "g"), (4, "class", "C", "C")}


def test_declarations_of_many_lines_are_read_to_their_end(spark):
    head = "export function big(\n" + ",\n".join(f"  p{i}: number" for i in range(30)) + "\n): string {\n"
    body = "  const inner = { a: 1 };\n" * 5 + "  return 'a';\n}\n"
    setting = "export const appConfig = build(\n" + "  one,\n" * 30 + "  { a: 1 },\n);\n"
    files = spark.createDataFrame([("a.ts", head + body + setting)], "path string, content string")
    found = {r["name"]: r for r in K.segment_typescript(files, merge=False).collect()}
    assert found["big"]["signature"] == "big(" + ", ".join(f"p{i}: number" for i in range(30)) + "): string"
    assert found["big"]["is_public"] and found["appConfig"]["chunk_type"] == "constant"


def test_files_of_very_many_lines_stay_linear(spark):
    """Twice the lines cost about twice the time: no fold copies what it has closed."""
    import time

    def seconds(lines: int) -> float:
        n = lines // 4
        cs = "\n".join(f"public class C{i}\n{{\n  // {'x' * 100}\n}}" for i in range(n))
        ts = "\n".join(f"export function f{i}() {{\n  // {'x' * 100}\n}}\n" for i in range(n))
        page = "# Head\n\n" + "\n\n".join(f"Paragraph number {i} has more than thirty characters." for i in range(n))
        table = spark.createDataFrame([(f"a.{i}", t) for i, t in enumerate((cs, ts, page))], "path string, content string")
        began = time.time()
        assert G.segment_braces(table.where("path = 'a.0'")).count() == n
        assert K.segment_typescript(table.where("path = 'a.1'"), merge=False).count() >= n
        assert G.line_windows(table.where("path = 'a.0'")).count() > n / 40
        assert G.passages(table.where("path = 'a.2'")).count() > n / 40
        return time.time() - began

    seconds(400)
    small, large = seconds(10_000), seconds(40_000)
    assert large < 8 * small + 10, (small, large)


def braces_by_fold(text, minimum):
    """Constructs of a file, each open one looked at on every line."""
    import re

    depth, held, out, lines = 0, [], [], text.split("\n")
    for i, line in enumerate(lines, 1):
        opens, after = line.count("{"), depth + line.count("{") - line.count("}")
        for pattern, kind in G.CS_RULES:
            if (m := re.search(pattern, line, re.A)) and not (kind == "method" and ";" in line):
                held.append([i, m[1], kind, depth, False])
        for c in held:
            c[4] = c[4] or opens > 0
        out += [(c[0], i, c[1], c[2]) for c in held if c[4] and after <= c[3]]
        held = [c for c in held if not (c[4] and after <= c[3])]
        depth = after
    out = [c for c in out if len("\n".join(lines[c[0] - 1 : c[1]])) >= minimum]
    return sorted(out) or [(1, len(lines), "a", "file")]


def test_braces_as_by_a_fold_over_all_that_is_open(spark):
    import random

    rng = random.Random(5)
    parts = ["public class A{}", "  void Run(int a)", "{{", "}}", "}} }}", "{{ {{", "x;", "interface I{} {{", "", "int f(int b) {{ return }}", "namespace N.M"]
    texts = ["\n".join(rng.choice(parts).format(i) for i in range(rng.choice((1, 3, 17, 40, 300)))) for _ in range(40)]
    table = spark.createDataFrame([(f"{k}/a.cs", t) for k, t in enumerate(texts)], "path string, content string")
    got = {}
    for r in G.segment_braces(table, 20).collect():
        got.setdefault(int(r["path"].split("/")[0]), []).append((r["start_line"], r["end_line"], r["name"], r["chunk_type"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: braces_by_fold(t, 20) for k, t in enumerate(texts)}


def test_constructs_that_stay_open_stay_linear(spark):
    """Eight times the constructs that never close cost about eight times the time."""
    import time

    def seconds(n: int) -> float:
        text = "\n".join(f"public class C{i}\n{{" for i in range(n)) + "\n  // " + "x" * 100 + "\n}"
        table = spark.createDataFrame([("a.cs", text)], "path string, content string")
        began = time.time()
        assert spans(G.segment_braces(table)) == [(2 * n - 1, 2 * n + 2, f"C{n - 1}", "class")]
        return time.time() - began

    seconds(20)
    small, large = seconds(375), seconds(3000)
    assert large < 8 * small + 10, (small, large)


def test_scan_of_any_length(spark):
    from pyspark.sql import functions as F

    from corpusloom.functions.arrays import scan

    sizes = [0, 1, 15, 16, 17, 255, 256, 257, 4096, 4097, 9000]
    table = spark.createDataFrame([(n, list(range(n))) for n in sizes], "n int, items array<int>")
    sums = table.select("n", scan(F.col("items"), F.lit(0), lambda s, x: s + x).alias("s"))
    assert {r["n"]: r["s"] for r in sums.collect()} == {n: [i * (i + 1) // 2 for i in range(n)] for n in sizes}
