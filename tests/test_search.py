import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import classify as C
from corpusloom.operators import context as X
from corpusloom.operators import index as I
from corpusloom.operators import matching as M
from corpusloom.operators import search as S
from corpusloom.session import scratch_path, with_global_rank

DOCS = [(0, "alpha beta beta gamma"), (1, "alpha delta"), (2, "beta beta beta beta beta"), (3, "zeta (x)"), (4, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def bm25(tf, df, n, dl, avgdl):
    return math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))


def test_bm25_formula_rare_terms_and_diminishing_returns():
    assert bm25(2, 1, 10, 100, 150) > bm25(2, 8, 10, 100, 150) > 0
    assert bm25(1, 3, 10, 100, 150) < bm25(5, 3, 10, 100, 150) < 5 * bm25(1, 3, 10, 100, 150)


def test_keyword_search_matches_formula(spark, docs):
    index = I.build_index(docs, "doc_id", "text")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in
           S.keyword_search(index, queries(spark, "beta beta", "alpha", "nothing", "")).collect()}
    avgdl = (4 + 2 + 5 + 1 + 0) / 5
    assert got[(0, 2)] == pytest.approx(2 * bm25(5, 2, 5, 5, avgdl))
    assert got[(0, 0)] == pytest.approx(2 * bm25(2, 2, 5, 4, avgdl))
    assert got[(1, 1)] == pytest.approx(bm25(1, 2, 5, 2, avgdl))
    assert len(got) == 4


def test_saved_index_scores_without_exchange_of_postings(spark, docs):
    path = scratch_path(spark, "idx")
    I.save_index(I.build_index(docs, "doc_id", "text", 4), path, "t_saved", 4)
    index = I.load_index(spark, path, "t_saved")
    scores = S.bm25_scores(index, queries(spark, "beta alpha"))
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    assert "hashpartitioning(doc_id" not in plan
    assert "In(term, [" in plan or "EqualTo(term" in plan
    assert scores.count() == 3


def test_index_opens_without_its_catalog_entry_and_rebuilds_statistics(spark, docs):
    path = scratch_path(spark, "idx")
    built = I.build_index(docs, "doc_id", "text", 4)
    I.save_index(built, path, "t_reopened", 4)
    want = sorted(map(tuple, S.keyword_search(I.load_index(spark, path, "t_reopened"), queries(spark, "beta alpha")).collect()))
    spark.sql("DROP TABLE t_reopened_v1_postings")
    index = I.load_index(spark, path, "t_reopened")
    assert sorted(map(tuple, S.keyword_search(index, queries(spark, "beta alpha")).collect())) == want
    bare = scratch_path(spark, "bare")
    built.postings.repartition(4, "doc_id").write.bucketBy(4, "doc_id").sortBy("term").option("path", f"{bare}/v=1/postings").saveAsTable("t_bare_v1_postings")
    spark.createDataFrame([(1, 4)], I.STATE).write.parquet(f"{bare}/state")
    with pytest.raises(ValueError):
        I.load_index(spark, bare, "t_bare")
    rebuilt = I.load_index(spark, bare, "t_bare", I.document_lengths(docs, "doc_id", "text"))
    assert {r["term"]: r["df"] for r in rebuilt.term_stats.collect()}["beta"] == 2
    assert rebuilt.corpus_stats.first().n_docs == 5
    with pytest.raises(ValueError):
        I.load_index(spark, path, "t_bare")


def test_updated_index_is_saved_under_its_own_name(spark, docs):
    path = scratch_path(spark, "idx")
    assert I.save_index(I.build_index(docs, "doc_id", "text", 4), path, "t_twice") == 1
    changed = spark.createDataFrame([(0, "omega"), (9, "omega beta")], "doc_id long, text string")
    assert I.save_index(I.update_index(I.load_index(spark, path, "t_twice"), changed, "doc_id", "text"), path, "t_twice") == 2
    got = I.load_index(spark, path, "t_twice")
    assert got.buckets == 4 and got.corpus_stats.first().n_docs == 6
    assert {r["term"]: r["df"] for r in got.term_stats.collect()}["omega"] == 2


def test_embed_default_and_plugged_function(spark, docs):
    rows = {r["doc_id"]: r["embedding"] for r in I.embed(docs, "doc_id", "text", dim=16).collect()}
    assert len(rows) == 5 and all(len(v) == 16 for v in rows.values())
    assert sum(x * x for x in rows[0]) == pytest.approx(1.0, abs=1e-5)
    assert sum(abs(x) for x in rows[4]) == 0
    half = I.embed(docs, "doc_id", "text", fn=lambda t: F.when(F.length(t) > 0, F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float"))), dim=2)
    assert {r["doc_id"]: list(r["embedding"]) for r in half.collect()}[4] == [0.0, 0.0]


def test_salted_join_equals_broadcast_join(spark, docs, monkeypatch):
    index = I.build_index(docs, "doc_id", "text")
    q = queries(spark, "beta gamma", "alpha zeta")
    want = sorted(map(tuple, S.bm25_scores(index, q).collect()))
    monkeypatch.setattr(S, "is_small", lambda *a: False)
    got = sorted(map(tuple, S.bm25_scores(index, q).collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_vector_search_blocked_equals_scan(spark):
    rnd = random.Random(1)
    vecs = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(300)], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(9)], "query_id long, embedding array<double>")
    want = sorted(map(tuple, S.vector_search(vecs, q, 5).collect()))
    unit = lambda df, k: df.select(k, F.col("embedding").alias("vec"))
    got = sorted(map(tuple, S.blocked_vector_search(unit(vecs, "doc_id"), unit(q, "query_id"), 5, rows=50).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want] and len(got) == 45


def test_vectors_above_a_threshold_are_all_kept(spark, monkeypatch):
    vecs = spark.createDataFrame(
        [(i, [1.0, i / 100]) for i in range(300)] + [(300, None)], "doc_id bigint, embedding array<double>"
    )
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "query_id bigint, embedding array<double>")
    want = sorted((1, i) for i in range(300) if 1 / (1 + (i / 100) ** 2) ** 0.5 > 0.5) + sorted(
        (3, i) for i in range(300) if (i / 100) / (1 + (i / 100) ** 2) ** 0.5 > 0.5
    )
    found = lambda: sorted((r["query_id"], r["doc_id"]) for r in S.vectors_above(vecs, q, 0.5).collect())
    assert found() == want
    monkeypatch.setattr(S, "BLOCK_ROWS", 1)  # the way of many queries gives the same rows
    assert found() == want


def test_vector_search_filters_before_ranking_and_keeps_zero_vectors(spark):
    vecs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [5.0, 5.0]), (2, [0.0, 0.0])], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, embedding array<double>")
    rows = S.vector_search(vecs, q, 2, allowed=vecs.where("doc_id > 0")).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == [1, 2]
    assert rows[0]["score"] == pytest.approx(math.sqrt(0.5))


def test_fusion_values(spark):
    ranked = lambda ids: spark.createDataFrame([(0, d, i + 1) for i, d in enumerate(ids)], "query_id long, doc_id long, rank int")
    fused = {r["doc_id"]: r["score"] for r in S.fuse([ranked([1, 2, 3]), ranked([2, 1, 4])]).collect()}
    assert min(fused[1], fused[2]) > max(fused[3], fused[4])
    assert S.fuse([ranked([1])]).first()["score"] == pytest.approx(1 / 61)
    assert S.fuse([ranked([1])], 10).first()["score"] == pytest.approx(1 / 11)
    swapped = {r["doc_id"]: r["score"] for r in S.fuse([ranked([2, 1, 4]), ranked([1, 2, 3])]).collect()}
    assert swapped == pytest.approx(fused)


def test_field_weights(spark):
    pages = spark.createDataFrame([(1, "Auth", "auth text", ["The auth", "auth again"], "about auth")],
                                  "doc_id long, title string, description string, headings array<string>, content string")
    q = queries(spark, "auth")
    weights = {"title": 10, "description": 5, "headings": 3, "content": 1}
    assert S.field_search(pages, q, weights).first()["score"] == 19
    assert S.field_search(pages, q, {"title": 3, "content": 1}, every={"headings": 2}).first()["score"] == 8


def test_word_paths_agree_with_brute_force(spark):
    rnd = random.Random(3)
    texts = [(i, " ".join("".join(rnd.choice("ab(.") for _ in range(rnd.randint(1, 6))) for _ in range(12))) for i in range(40)]
    words = ["a", "ab", "aba", "(.a", "bbbb", "zz", "a.b"]
    df = spark.createDataFrame(texts, "id long, text string")
    w = spark.createDataFrame([(x,) for x in words], "word string")
    want = sorted((i, x, t.count(x)) for i, t in texts for x in words if x in t)
    for constant in (True, False):
        got = M.word_hits(df, ["id"], "text", w, constant=constant).select("id", "word", "hits")
        assert sorted(map(tuple, got.collect())) == want


def test_word_paths_agree_on_long_words_and_repeated_keys(spark, monkeypatch):
    long = "x" * 40 + "y"
    texts = [(1, f"a{long}b\u00a0c {long}{long} aaaa"), (1, "aaa"), (2, None), (3, "\u00e9t\u00e9 \U0001f600aa")]
    df = spark.createDataFrame(texts, "id long, text string")
    w = spark.createDataFrame([(x,) for x in ("aa", long, "x" * 40, "\u00e9", "\U0001f600", "b\u00a0c")], "word string")
    want = [(1, "aa", 3), (1, "b\u00a0c", 1), (1, "x" * 40, 3), (1, long, 3), (3, "aa", 1), (3, "\u00e9", 2), (3, "\U0001f600", 1)]
    for listed in (20_000, 3):  # looked up on the text's own row, and through the vocabulary
        monkeypatch.setattr(M, "LISTED_WORDS", listed)
        got = M.word_hits(df, ["id"], "text", w, constant=False).select("id", "word", "hits")
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_listed_words_are_found_in_any_cut_of_the_bytes(monkeypatch):
    rnd = random.Random(5)
    for cut in (1, 7, 64, 1 << 17):
        monkeypatch.setattr(M, "BLOCK_BYTES", cut)
        for letters in ("ab", "a\u00e9\U0001f600 ", "abc \n"):
            made = lambda n: "".join(rnd.choice(letters) for _ in range(n))
            texts = [None, ""] + [made(rnd.randint(0, 150)) for _ in range(8)]
            words = sorted({made(rnd.choice([1, 2, 3, 9, 32, 40])) for _ in range(20)} | {t[2:44] for t in texts if t and len(t) > 60})
            want = [
                [(i << 32) | t.count(w) for i, w in enumerate(words) if w in t and not set(w) & set(" \n")] if t else []
                for t in texts
            ]
            held = pa.array(["ab", *texts]).slice(1)
            assert [sorted(x) for x in M._listed_hits(words)(held).to_pylist()] == want


def test_only_frequent_tokens_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(M, "LISTED_WORDS", 2)
    monkeypatch.setattr(M, "is_light", lambda *_: False)
    df = spark.createDataFrame([(i, f"alpha w{i} beta beta") for i in range(30)], "id long, text string")
    w = spark.createDataFrame([(x,) for x in ("alpha", "w1", "eta", "zz")], "word string")
    want = sorted((i, x, t.count(x)) for i, t in df.collect() for x in ("alpha", "w1", "eta") if x in t)
    for most, salts in ((20, 16), (1000, 1)):
        monkeypatch.setattr(M, "DEALT_PLACES", most)
        found = M.word_hits(df, ["id"], "text", w, constant=False).select("id", "word", "hits")
        assert sorted(map(tuple, found.collect())) == want
        rows = df.select("id", F.explode(F.split("text", " ")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
        dealt = M.dealt_tokens(rows).collect()
        assert {r["token"]: r["_salts"] for r in dealt} == ({"alpha": 16, "beta": 16} if salts > 1 else {})


def test_scores_of_listed_words_are_summed_where_the_text_lies(spark, monkeypatch):
    monkeypatch.setattr(M, "parts_of", lambda *_: 4)
    df = spark.createDataFrame([(i, f"alpha w{i} beta") for i in range(50)], "doc_id long, text string")
    q = queries(spark, "alpha beta w1", "w2 beta")
    plan = S.occurrence_search(df, q, constant=False)._jdf.queryExecution().executedPlan().toString()
    # found words go by doc_id once; pairs of text and word, or of text and query, are not exchanged
    by_doc = [x for x in plan.split("\n") if "Exchange hashpartitioning(" in x and "doc_id#" in x]
    assert len(by_doc) == 1 and "REPARTITION_BY_NUM" in by_doc[0]


def test_postings_are_made_in_tasks_of_bounded_size(spark, monkeypatch):
    df = spark.createDataFrame([(i, "alpha beta gamma delta " * 50) for i in range(64)], "doc_id long, text string")
    monkeypatch.setattr("corpusloom.session.parts_of.__defaults__", (4096,))
    built = I.build_index(df, "doc_id", "text")
    assert built.buckets >= 17 and built.postings.rdd.getNumPartitions() == built.buckets


def test_phrases_with_blanks(spark):
    df = spark.createDataFrame([(1, "the quick brown fox"), (2, "quick  brown"), (3, "uick brow")], "id long, text string")
    p = spark.createDataFrame([(9, "uick brow")], "pid long, p string")
    for constant in (True, False):
        got = M.phrase_hits(df, ["id"], "text", p, ["pid"], "p", constant=constant)
        assert sorted(r["id"] for r in got.collect()) == [1, 3]


def test_rerank_keeps_score_and_reorders(spark, docs):
    found = spark.createDataFrame([(0, 1, 0, 0.9), (0, 2, 1, 0.1)], "query_id long, rank int, doc_id long, score double")
    out = S.rerank(found, queries(spark, "delta"), docs, 1).collect()
    assert [(r["doc_id"], r["score"], r["rerank_score"]) for r in out] == [(1, 0.1, 1.0)]


def test_rerank_queries_read_whole_texts(spark, tmp_path):
    from registry import all_queries

    texts = {0: "alpha beta", 1: "alpha " + "filler " * 200 + "beta", 2: "alpha " * 300, 3: "gamma"}
    put = lambda rows, cols, name: spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/{name}.parquet")
    put([(i, t, "en", "web", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    put([(0, "alpha beta")], "item_id long, text string", "benchmark")
    put([(i, [1.0, float(i)], 0) for i in texts], "vec_id long, embedding array<float>, label int", "embeddings")
    want = {0: 1.0, 1: 1.0, 2: 0.5, 3: 0.0}
    for name in ("sch10_rerank", "udf2_pair_scorer"):
        rows = all_queries()[name](spark, str(tmp_path)).collect()
        got = {r["doc_id"]: r["rerank_score"] for r in rows}
        assert len(rows) == 4 and got == want, (name, got)


def test_label_paths_agree(spark):
    chunks = spark.createDataFrame(
        [(1, "LoginUser", "checks a token", ["Auth"], "db query"), (2, "x", None, [], "nothing")],
        "doc_id long, name string, documentation string, decorators array<string>, content string")
    d = spark.createDataFrame([("auth", "login", 0), ("auth", "token", 1), ("data", "db", 0), ("data", "query", 1), ("api", "token", 0)],
                              "category string, keyword string, ord int")
    got = {r["doc_id"]: r["labels"] for r in C.label_domains(chunks, d).collect()}
    assert [(x["category"], x["confidence"], x["source"], x["keywords"]) for x in got[1]] == [
        ("auth", 0.5, "name", ["login", "token"]), ("api", 0.2, "documentation", ["token"]), ("data", 0.2, "content", ["db", "query"])]
    assert got[2] == []
    assert C.default_dictionary(spark).count() > 25


def test_running_sums_in_blocks(spark):
    rows = spark.createDataFrame([(0, t, t + 1) for t in range(50)] + [(1, 5, 7)], "g int, turn int, n int")
    got = {(r["g"], r["turn"]): r["b"] for r in X.running_before(rows, "g", "turn", "n", "b", block=7).collect()}
    assert got == {**{(0, t): t * (t + 1) // 2 for t in range(50)}, (1, 5): 0}


def test_trim_history(spark):
    rows = spark.createDataFrame([(1, t, "user", "x" * 40) for t in range(30)] + [(2, t, "user", "x") for t in range(30)],
                                 "conv_id long, turn long, role string, text string")
    kept = X.trim_history(rows, max_tokens=300, keep=20).groupBy("conv_id").agg(F.collect_set("turn").alias("t")).collect()
    turns = {r["conv_id"]: sorted(r["t"]) for r in kept}
    assert turns[1] == [0, *range(10, 30)] and turns[2] == list(range(30))


def test_global_rank(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("v"))
    assert all(r["pos"] == r["v"] + 1 for r in with_global_rank(df, [F.col("v")]).collect())


def test_vector_search_keeps_the_type_of_ids(spark):
    rows = [(f"d{i:02d}", [float(i % 5), 1.0]) for i in range(20)] + [("none", None), ("zero", [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "doc_id string, embedding array<float>")
    queries = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", [0.0, 1.0])], "query_id string, embedding array<float>")
    got = S.vector_search(vectors, queries, 4)
    assert [(r["query_id"], r["rank"], r["doc_id"]) for r in got.orderBy("query_id", "rank").collect()] == [
        ("q1", i + 1, f"d{4 + 5 * i:02d}") for i in range(4)
    ] + [("q2", i + 1, f"d{5 * i:02d}") for i in range(4)]
    docs, asked = S._vectors(vectors, queries, None)
    blocked = S.blocked_vector_search(docs, asked, 4, 3)
    assert sorted(blocked.collect()) == sorted(got.collect())
    assert S.vector_search(vectors, queries.limit(0), 4).schema["query_id"].dataType.simpleString() == "string"
