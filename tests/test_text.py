import pytest
from pyspark.sql import functions as F

from corpusloom.functions import fixed, html, vectors
from corpusloom.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def test_tokens_split_code_names(spark):
    got = one(spark, T.tokens("t"), t="getUserById XMLParser snake_case_x a-b")
    assert got == ["get", "user", "by", "id", "xml", "parser", "snake", "case"]


def test_keywords_are_ascii_words_without_stop_words(spark):
    got = one(spark, T.keywords("t"), t="The user_id2 and émentre x1y the user_id2")
    assert got == ["user_id2", "mentre", "x1y"]
    assert len(fixed.PAGE_STOP_WORDS) == len(set(fixed.PAGE_STOP_WORDS))


@pytest.mark.parametrize("raw, want", [
    ("a ```js\nx\n``` b", "a  b"),
    ("use `code` here", "use  here"),
    ("[text](http://x) y", "text y"),
    ("**bold** _it_ ~~s~~", "bold it s"),
    ("## Head\ntext", "Head\ntext"),
])
def test_strip_markdown(spark, raw, want):
    assert one(spark, T.strip_markdown("t"), t=raw) == want


def test_clean_markdown_drops_heading_lines_and_keeps_code_text(spark):
    assert one(spark, T.clean_markdown("t"), t="# H\nuse `code` *x*") == "use code x"


def test_three_slugs_differ(spark):
    t = "-My_Page: A & B-"
    assert one(spark, T.site_slug("t"), t=t) == "-my_page-a-b-"
    assert one(spark, T.file_slug("t"), t=t) == "my-page-a-b"
    assert one(spark, T.heading_anchor("t"), t=t) == "mypage-a-b"


def test_source_links(spark):
    got = one(spark, T.link_source_references("t"), t="See: src/a.ts:12 and `b.tsx:3` (c.js:4)")
    assert got == "📄 [src/a.ts:12](../src/a.ts#L12) and 📄 [b.tsx:3](../b.tsx#L3) (📄 [c.js:4](../c.js#L4))"


@pytest.mark.parametrize("question, flow, kind", [
    ("How does login work?", True, "flowchart"),
    ("What is a class?", False, "flowchart"),
    ("what happens when a step fails", True, "sequence"),
    ("show the parent and child", False, "hierarchy"),
    ("how is input turned to output in the pipeline", False, "dataflow"),
])
def test_questions(spark, question, flow, kind):
    assert one(spark, T.is_flow_question("q"), q=question) is flow
    assert one(spark, T.diagram_type("q"), q=question) == kind


def test_snippet_and_preview(spark):
    text = "x" * 80 + "NEEDLE" + "y" * 80
    got = one(spark, T.snippet("t", "q"), t=text, q="needle")
    assert got == "..." + "x" * 50 + "NEEDLE" + "y" * 50 + "..."
    assert one(spark, T.snippet("t", "q"), t="abc", q="zz") == ""
    words = T.query_words(F.lit("beta gamma"))
    assert one(spark, T.preview_line("t", words), t="one\n two BETA \nthree") == "two BETA"
    assert one(spark, T.preview_line("t", words), t=" first\nsecond") == "first"


def test_domain_context(spark):
    got = one(spark, T.domain_context("a", "b", "c", F.array(F.lit("user-management"), F.lit("api-endpoint")), "d"),
              a="method", b="getUser", c="UserService", d="getUser(id)")
    assert got == "[METHOD] getUser in UserService (user management, api endpoint) - getUser(id)"
    none = F.array().cast("array<string>")
    assert one(spark, T.domain_context("a", "b", F.lit(""), none, F.lit("")), a="file", b="x") == "x"


def test_embedding_text_budget(spark):
    got = one(spark, T.embedding_text("a", "b", "c"), a="ctx", b="d" * 400, c="c" * 5000)
    assert got.startswith("ctx\n\n" + "d" * 300 + "\n\n") and len(got) == 2000


def test_paths(spark):
    assert one(spark, T.extension("p"), p="a/b.Test.TS") == ".ts"
    assert one(spark, T.extension("p"), p="a/.gitignore") == ""
    assert one(spark, T.stem("p"), p="a/.gitignore") == ".gitignore"
    assert one(spark, T.relative_link("p", "q"), p="a/b/c.md", q="x/y.md") == "../../x/y.html"
    assert one(spark, T.is_entry_point("p"), p="cmd/main.go") is True
    assert one(spark, T.is_test_file("p"), p="src/a.spec.ts") is True
    assert one(spark, T.language("p"), p="x.mjs") == ""
    assert one(spark, T.language("p", parser=True), p="x.mjs") == "javascript"


def test_html(spark):
    page = ('<html><head><title> A &amp; B </title><meta name="k" content="1"><meta property="og" content="2">'
            '<meta name="k" content="3"></head><body><script>var t="</p>";</script><p>x</p><p>y &lt;</p>'
            '<a href="/a/b">1</a><a class="c" href="https://o.org">2</a><a href="#t">3</a></body></html>')
    assert one(spark, html.html_text("h"), h=page) == "xy <123"
    assert one(spark, html.html_text("h", " "), h=page) == "x y < 1 2 3"
    df = spark.createDataFrame([(1, "https://h.com/x/y?z", page)], "id int, url string, h string")
    assert [r["link"] for r in html.html_links(df, "h", "url", "id").orderBy("pos").collect()] == [
        "https://h.com/a/b", "https://o.org"]
    assert {r["name"]: r["value"] for r in html.html_metadata(df, "h", "id").collect()} == {
        "title": "A & B", "k": "3", "og": "2"}


@pytest.mark.parametrize("a, b, want", [
    ([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0),
    ([3.0, 4.0], [4.0, 3.0], 0.96), ([0.0, 0.0], [1.0, 0.0], None),
])
def test_cosine(spark, a, b, want):
    got = one(spark, vectors.cosine("a", "b"), a=a, b=b)
    assert got is None if want is None else got == pytest.approx(want)


def test_normalize_keeps_zero(spark):
    assert one(spark, vectors.normalize("a"), a=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, vectors.normalize("a"), a=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
