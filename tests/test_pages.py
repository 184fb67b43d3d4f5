import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph as G
from corpusloom.operators import pages as P

FILES = [
    ("README.md", "# Home\nSee [a](architecture/overview.md), [s](#x), [e](https://x.org/a.md), [m](mailto:a@b.md)\n[[components/auth|Auth]] [[Missing Page]]"),
    ("architecture/overview.md", "---\ntitle: The Overview\ndescription: d: e\ncategory: arch\nrelated: [components/auth, nope]\n---\n"
                                 "# Ignored\n## One\ntext [up](../README.md) [bad](./gone.md#part) [esc](../../out.md) [c](src/a.ts:10)\n### Two\n```ts\n// Source: a.ts\nx\n```\n```mermaid\ngraph\n```"),
    ("components/auth.md", "No heading. [bad](../architecture/gone.md) [bad2](../architecture/gone.md)"),
    ("components/Other.md", "## Only"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return P.parse_pages(spark.createDataFrame(FILES, "path string, content string"))


def test_front_matter_and_titles(pages):
    got = {r["path"]: r for r in pages.collect()}
    over = got["architecture/overview.md"]
    assert (over["title"], over["description"], over["category"]) == ("The Overview", "d: e", "arch")
    assert over["related"] == ["components/auth", "nope"] and over["content"].startswith("## One")
    assert got["README.md"]["title"] == "Home" and got["README.md"]["listed_title"] == "README"
    assert got["components/auth.md"]["title"] == "auth"


def test_elements(pages):
    heads = P.heading_rows(pages).where("path like 'arch%'").orderBy("pos").collect()
    assert [(h["level"], h["text"], h["id"]) for h in heads] == [(2, "One", "one"), (3, "Two", "two")]
    block = P.code_blocks(pages).collect()
    assert [(b["language"], b["source_ref"]) for b in block] == [("ts", "a.ts")]
    assert [d["diagram"] for d in P.diagrams(pages).collect()] == ["graph"]
    assert [t["indent"] for t in P.page_toc(pages).orderBy("pos").collect()] == [0, 1]


def test_broken_links(pages):
    found = G.page_links(pages)
    once = {r["resolved_target"]: r["source"] for r in G.broken_links(found, pages).collect()}
    assert once == {"architecture/gone.md": "architecture/overview.md", "Missing Page.md": "README.md"}
    assert G.broken_links(found, pages, dedupe=False).count() == 4
    by = {r["resolved_target"]: r for r in G.broken_by_target(found, pages).collect()}
    assert by["architecture/gone.md"]["first_sources"] == ["architecture/overview.md", "components/auth.md"]
    report = G.link_report(found, pages).first()
    assert (report["total_pages"], report["missing_pages"], report["broken_links"]) == (4, 2, 4)
    kept = G.page_links(pages, strict=False, wiki=False, escapes=True)
    assert kept.where("resolved_target = '../out.md'").count() == 1


def test_related_and_siblings(pages):
    rows = P.related_pages(pages).where("path = 'architecture/overview.md'").collect()
    assert [r["related"] for r in rows] == ["components/auth.md"]
    assert {(r["path"], r["sibling"]) for r in P.siblings(pages).collect()} == {
        ("components/auth.md", "components/Other.md"), ("components/Other.md", "components/auth.md")}


def test_navigation_and_neighbours(pages):
    rows = P.neighbours(pages).orderBy("pos").collect()
    order = [r["path"] for r in rows]
    assert order == ["README.md", "architecture/overview.md", "components/Other.md", "components/auth.md"]
    assert [r["previous"] for r in rows] == [None, *order[:-1]] and [r["next"] for r in rows] == [*order[1:], None]
    assert {r["section_title"] for r in P.navigation_sections(pages).collect()} == {"Overview", "Architecture", "Components"}


def test_find_pages(spark, pages):
    asks = spark.createDataFrame([("README.md",), ("components/auth",), ("COMPONENTS/other.MD",), ("zzz",)], "request string")
    got = {r["request"]: (r["path"], r["kind"]) for r in P.find_pages(asks, pages).collect()}
    assert got == {"README.md": ("README.md", 0), "components/auth": ("components/auth.md", 1),
                   "COMPONENTS/other.MD": ("components/Other.md", 2)}


def test_best_heading(spark):
    df = spark.createDataFrame([("# Alpha beta\n## beta gamma delta\n## gamma beta", "beta gamma")], "c string, q string")
    assert df.select(P.best_heading("c", "q").alias("h")).first()["h"]["anchor"] == "beta-gamma-delta"


def test_relationships_and_fallback(spark):
    ctx = spark.createDataFrame([
        (1, 1, "Login Page", "The login page calls the Token Store."), (1, 2, "Token Store", "stores things"),
        (2, 1, "Aaaa", "x"), (2, 2, "Bbbb", "y"), (2, 3, "Cccc", "z"), (2, 4, "Dddd", "w"),
    ], "query_id long, rank int, title string, content string")
    edges = G.relationships(ctx)
    assert [tuple(r) for r in edges.collect()] == [(1, 1, 2, "calls")]
    hub = G.with_fallback_edges(edges, ctx, codemap=True).where("query_id = 2")
    assert {(r["src"], r["dst"]) for r in hub.collect()} == {(1, 2), (1, 3), (1, 4)}
    chain = G.with_fallback_edges(edges, ctx).where("query_id = 2")
    assert {(r["src"], r["dst"]) for r in chain.collect()} == {(1, 2), (2, 3), (3, 4)}


def test_title_mentions_against_brute_force(spark):
    pages = spark.createDataFrame([(1, "a.md", "The Login Page"), (2, "b.md", "C++"), (3, "c.md", "login page"), (4, "d.md", "x (y) z")],
                                  "ord int, path string, title string")
    texts = spark.createDataFrame([(1, "see the login page."), (2, "relogin page"), (3, "an x (y) z here"), (4, "Login Pages")], "id long, t string")
    got = {(r["id"], r["mention"], r["path"]) for r in G.title_mentions(texts, "id", "t", pages).collect()}
    assert got == {(1, "the login page", "a.md"), (1, "login page", "c.md"), (3, "x (y) z", "d.md")}


def test_unique_titles(spark):
    ctx = spark.createDataFrame([(1, 1, "T", "ab"), (1, 2, "T", "cd"), (1, 3, "U", "ef"), (2, 1, "T", "gh")],
                                "query_id long, rank int, title string, content string")
    got = {(r["query_id"], r["rank"]): r["label"] for r in G.unique_titles(ctx).collect()}
    assert got == {(1, 1): "T §1", (1, 2): "T §2", (1, 3): "U", (2, 1): "T"}


@pytest.mark.parametrize("rows", [100_000, 0])
def test_one_key_on_most_rows(spark, monkeypatch, rows):
    """Joins where one directory or conversation holds most rows, broadcast and dealt, against plain results."""
    from corpusloom import session
    from corpusloom.operators import context as C

    monkeypatch.setattr(session.is_small, "__defaults__", (rows,))
    pages = spark.createDataFrame([(f"hot/{i:04d}.md",) for i in range(600)] + [(f"d{i}/a.md",) for i in range(50)], "path string")
    got = P.siblings(pages).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "sibling"))).alias("s")).collect()
    firsts = [f"hot/{i:04d}.md" for i in range(4)]
    assert {r["path"]: [x["sibling"] for x in r["s"]] for r in got} == {
        p: [x for x in firsts if x != p][:3] for p in (f"hot/{i:04d}.md" for i in range(600))
    }
    turns = [(1, i, "word " * 20) for i in range(500)] + [(2, 0, "a"), (2, 1, None), (None, 0, "b")]
    messages = spark.createDataFrame(turns, "conv_id bigint, turn bigint, text string")
    kept = C.trim_history(messages, max_tokens=250, keep=4).select("conv_id", "turn", "pruned").collect()
    assert sorted(map(tuple, kept), key=str) == sorted(
        [(1, t, True) for t in (0, 496, 497, 498, 499)] + [(2, 0, False), (2, 1, False), (None, 0, False)], key=str
    )


def test_title_of_two_words_is_found_without_its_text(spark):
    pages = spark.createDataFrame([(1, "a", "The Alpha"), (2, "b", "One Two Three"), (3, "c", "Alpha  Beta")], "ord long, path string, title string")
    texts = spark.createDataFrame([(1, "see the alpha."), (2, "other alpha beta"), (3, "one two threes"), (4, "one two three"), (5, None)], "id long, t string")
    found = G.title_mentions(texts, "id", "t", pages)
    got = sorted((r["id"], r["mention"]) for r in found.collect())
    assert got == [(1, "alpha"), (1, "the alpha"), (2, "alpha"), (4, "one two three")]
    # only titles of more than two words go to the texts
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT (word" in plan


@pytest.mark.parametrize("rows", [100_000, 0])
def test_title_mentions_where_texts_lie(spark, monkeypatch, rows):
    """Words looked up in the bytes of texts, titles broadcast or exchanged, against the regular expressions, on odd texts."""
    import random

    from corpusloom import session
    from corpusloom.operators import matching as M

    monkeypatch.setattr(session.is_small, "__defaults__", (rows,))
    monkeypatch.setattr(M, "BLOCK_BYTES", 64)
    monkeypatch.setattr(G, "is_light", lambda *a: rows > 0)
    rnd = random.Random(7)
    pieces = ["alpha", "Beta", "gam_ma", "x1", "\u00e9t\u00e9", "na\u00efve", "\u0130x", "a", "_", "9", "\U0001f600", " ", "  ", ". ", "-", "\n", "'"]
    said = lambda n: "".join(rnd.choices(pieces, [3] * 4 + [1] * 7 + [6] + [2] * 5, k=n))
    texts = [(i, said(rnd.randint(0, 60))) for i in range(150)] + [(7, "the alpha"), (7, ""), (500, None), (None, "alpha Beta"), (501, "")]
    titles = ["The Alpha", "Beta", "alpha Beta", "x1 alpha", "gam_ma", "na\u00efve alpha", "Beta. x1", "alpha-Beta x1", "\u00e9t\u00e9!", "alphabet", None, "x1\nBeta"]
    pages = spark.createDataFrame([(i, f"p{i}", t) for i, t in enumerate(titles)], "ord int, path string, title string")
    frame = spark.createDataFrame(texts, "id long, t string").repartition(3)
    out = lambda: sorted(map(tuple, G.title_mentions(frame, "id", "t", pages).collect()))
    got = out()
    said_words = G.said_words
    monkeypatch.setattr(G, "said_words", lambda *a: None)
    assert got == out() and len(got) > 100
    # only words that titles have leave the row of their text
    keys = spark.createDataFrame([("alpha",), ("alpha beta",)], "word string")
    low = frame.select("id", F.lower("t").alias("t")).where("t IS NOT NULL")
    assert {r["word"] for r in said_words(low, "id", "t", keys).collect()} == {"alpha", "alpha beta"}
    assert said_words(low, "id", "t", keys.where("false")).count() == 0
