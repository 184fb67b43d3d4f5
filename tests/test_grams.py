"""The gram index against a search of the texts."""

import random

import pytest

from corpusloom.operators import changes as X
from corpusloom.operators import grams as G
from corpusloom.operators import search as S
from corpusloom.session import scratch_path


def places(text, phrase):
    return [i for i in range(len(text) - len(phrase) + 1) if text.startswith(phrase, i)] if phrase else []


def stored(spark, texts, keys="doc_id bigint"):
    path = scratch_path(spark, "grams")
    G.save_grams(spark.createDataFrame(texts, f"{keys}, text string"), [k.split()[0] for k in keys.split(", ")], "text", path)
    return G.load_grams(spark, path)


@pytest.mark.parametrize("few", [200, 2])
def test_places_of_phrases(spark, monkeypatch, few):
    monkeypatch.setattr(G, "FILTER_GRAMS", few)
    monkeypatch.setattr(G, "BATCH_TEXTS", 7)
    rnd = random.Random(few)
    texts = ["", None, "a", "ab", "aaaaaaa", "the cat  the cat\n\tthe cat", "É😀x😀É😀x", "\x00\x00a", " "] + [
        "".join(rnd.choices("ab c", k=rnd.randint(0, 40))) for _ in range(60)
    ]
    phrases = ["", None, "a", " ", "aa", "ab", "abc", "aaaa", "the cat", "cat  the", "😀", "😀x😀", "\x00a", "zzz", "the dog", "t\n\tt"]
    phrases += [t[i : i + n] for t in texts[9:40] for n in (1, 2, 3, 4, 7, 11) for i in (0, 3) if t]
    index = stored(spark, list(enumerate(texts)))
    asked = spark.createDataFrame(list(enumerate(phrases)), "query_id bigint, phrase string")
    got = sorted(map(tuple, G.phrase_places(index, asked, ["query_id"], "phrase").collect()))
    want = sorted((q, d, p) for q, x in enumerate(phrases) for d, t in enumerate(texts) for p in places(t or "", x or ""))
    assert got == want
    assert G.phrase_texts(index, asked.limit(0), ["query_id"], "phrase").count() == 0


def test_substring_search_by_grams(spark):
    pages = spark.createDataFrame(
        [(1, 3, "The Title", "some  Text here", ["Head one", "Two"]), (2, 1, None, "head two some", []), (3, 2, "x", None, None)],
        "doc_id bigint, ord bigint, title string, content string, headings array<string>",
    )
    queries = spark.createDataFrame(
        [(i, q) for i, q in enumerate(["some", "SOME  text", "head", "x", "e t", "he", "two", None])], "query_id bigint, query string"
    )
    path = scratch_path(spark, "grams")
    G.save_grams(S.page_parts(pages), ["doc_id", "ord", "item"], "text", path)
    index = G.load_grams(spark, path)
    for k in (1, 10):
        assert sorted(S.substring_search(index, queries, k).collect()) == sorted(S.substring_search(pages, queries, k).collect())


def test_affected_pages_by_grams(spark):
    pages = [("a.md", "see src/user.ts"), ("b.md", "nothing"), ("c.md", "the user page"), ("d.md", "x y")]
    changes = spark.createDataFrame([("M", "src/user.ts"), ("A", "lib/y.py"), ("D", "zz.go")], "status string, path string")
    index = stored(spark, pages, "path string")
    df = spark.createDataFrame(pages, "path string, content string")
    assert sorted(X.affected_pages(index, changes).collect()) == sorted(X.affected_pages(df, changes).collect())


def test_an_incomplete_index_is_not_opened(spark):
    with pytest.raises(ValueError):
        G.load_grams(spark, scratch_path(spark, "grams"))


def test_repeated_and_null_keys_keep_their_places(spark):
    index = stored(spark, [(1, "one long phrase"), (1, "one long phrase"), (None, "a long phrase")])
    asked = spark.createDataFrame([(0, "long phrase")], "query_id bigint, phrase string")
    got = G.phrase_places(index, asked, ["query_id"], "phrase").collect()
    assert sorted((r.query_id, r.doc_id or 0, r.pos) for r in got) == [(0, 0, 2), (0, 1, 4), (0, 1, 4)]


def test_phrases_that_share_grams_are_not_paired_with_all_their_texts(spark, monkeypatch):
    """400 names of two grams that 20 names and 20 texts each share: both grams meet before a name does."""
    rows = []

    def counted(df, settle=G.settle):
        kept = settle(df)
        rows.append(kept.count())
        return kept

    monkeypatch.setattr(G, "settle", counted)
    both = sorted(3 * a + 3 * b for a in "ABCDEFGHIJKLMNOPQRST" for b in "abcdefghijklmnopqrst")
    index = stored(spark, [(i, f"- {x} -") for i, x in enumerate(both)])
    got = G.phrase_texts(index, spark.createDataFrame([(x,) for x in both], "name string"), ["name"], "name").collect()
    assert sorted((r.doc_id, r.name) for r in got) == list(enumerate(both))
    assert max(rows) <= 3 * len(both)


@pytest.mark.parametrize("most", [1_000_000, 1])
def test_long_phrases_in_many_texts(spark, monkeypatch, most):
    monkeypatch.setattr(G, "RANGES", most)
    texts = [(i, "x" * (i % 3) + "a passage of several words" + (" again" if i % 2 else " a passage of several word")) for i in range(30)]
    phrases = ["a passage of several words again", "passage of several word", "several words  again"]
    asked = spark.createDataFrame(list(enumerate(phrases)), "query_id bigint, phrase string")
    got = sorted(map(tuple, G.phrase_places(stored(spark, texts), asked, ["query_id"], "phrase").collect()))
    assert got == sorted((q, d, p) for q, x in enumerate(phrases) for d, t in texts for p in places(t, x))


def test_blocks_of_few_characters(spark, monkeypatch):
    monkeypatch.setattr(G, "BATCH_CHARS", 20)
    monkeypatch.setattr(G, "PLACES", 3)
    texts = [(i, "ab abc" * (i % 7)) for i in range(50)]
    asked = spark.createDataFrame([(0, "abab a"), (1, "c")], "query_id bigint, phrase string")
    got = sorted(map(tuple, G.phrase_places(stored(spark, texts), asked, ["query_id"], "phrase").collect()))
    assert got == sorted((q, d, p) for q, x in enumerate(["abab a", "c"]) for d, t in texts for p in places(t, x))
