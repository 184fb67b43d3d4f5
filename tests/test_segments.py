"""The segmented index against one that is built at once, and search by blocks against the plain sum."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import index as I
from corpusloom.operators import search as S
from corpusloom.operators import segments as G
from corpusloom.session import scratch_path


def corpus(rnd, n, start=0):
    """Words of very unequal frequency; some texts are empty or null."""
    word = [f"w{i}" for i in range(300)]
    weight = [1 / (i + 1) for i in range(300)]
    out = {i: " ".join(rnd.choices(word, weight, k=rnd.randint(1, 60))) for i in range(start, start + n)}
    out[start], out[start + 1] = "", None
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")


def tables(index):
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    n, avgdl = index.corpus_stats.first()
    return (rows(index.postings, "doc_id", "dl", "term", "tf"), rows(index.term_stats, "term", "df"),
            rows(index.doc_stats, "doc_id", "dl"), n, round(avgdl, 9))


def same(spark, path, texts):
    assert tables(G.open_index(spark, path)) == tables(I.build_index(frame(spark, texts), "doc_id", "text"))


def stored_bytes(folder):
    import os

    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_commits_equal_a_full_build(spark, monkeypatch):
    monkeypatch.setattr(G, "FAN", 3)
    monkeypatch.setattr(G, "BLOCK", 4)
    monkeypatch.setattr(G, "PART_DOCS", 20)
    rnd = random.Random(1)
    path, texts = scratch_path(spark, "segments"), corpus(rnd, 60)
    assert G.commit(spark, path, frame(spark, texts), "doc_id") == 1
    same(spark, path, texts)
    merged = 0
    for step in range(7):
        changed = corpus(rnd, 5, 60 + 5 * step) | {i: f"new{step} w0" for i in rnd.sample(sorted(texts), 4)}
        removed = rnd.sample(sorted(texts), 3) + [10_000]
        texts = {i: t for i, t in texts.items() if i not in removed} | changed
        G.commit(spark, path, frame(spark, changed), "doc_id", removed=spark.createDataFrame([(i,) for i in removed], "doc_id bigint"))
        before = len(G.last_version(spark, path).segments)
        G.merge(spark, path)
        merged += len(G.last_version(spark, path).segments) < before
        if step % 3 == 0:
            same(spark, path, texts)
    assert merged > 1 and not G.due(G.last_version(spark, path))
    same(spark, path, texts)
    gone = spark.createDataFrame([(i,) for i in texts if i != 60], "doc_id bigint")
    G.commit(spark, path, None, "doc_id", removed=gone)
    G.merge(spark, path)
    same(spark, path, {60: texts[60]})


def test_a_lost_commit_leaves_the_version_before(spark, monkeypatch):
    path, texts = scratch_path(spark, "segments"), {1: "a b", 2: "b c"}
    G.commit(spark, path, frame(spark, texts), "doc_id")
    with monkeypatch.context() as m:
        m.setattr(G, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            G.commit(spark, path, frame(spark, {2: "x", 3: "y"}), "doc_id")
    same(spark, path, texts)
    G.commit(spark, path, frame(spark, {2: "x", 3: "y"}), "doc_id")
    same(spark, path, {1: "a b", 2: "x", 3: "y"})
    with pytest.raises(ValueError):
        G.open_index(spark, scratch_path(spark, "none"))


def test_a_small_change_writes_little(spark):
    rnd = random.Random(2)
    word = [f"w{i}" for i in range(5000)]
    weight = [1 / (i + 1) for i in range(5000)]
    texts = {i: " ".join(rnd.choices(word, weight, k=400)) for i in range(3000)}
    path = scratch_path(spark, "segments")
    G.commit(spark, path, frame(spark, texts).coalesce(1), "doc_id")
    whole = stored_bytes(path)
    G.commit(spark, path, frame(spark, {i: texts[i] + " w1" for i in range(0, 3000, 100)}).coalesce(1), "doc_id")
    assert stored_bytes(path) - whole <= 0.05 * whole


@pytest.mark.parametrize("k", [1, 10, 500])
def test_block_search_equals_the_plain_sum(spark, monkeypatch, k):
    monkeypatch.setattr(G, "BLOCK", 8)
    rnd = random.Random(k)
    path, texts = scratch_path(spark, "segments"), corpus(rnd, 300)
    texts |= {i: texts[7] for i in range(300, 330)}  # ties
    G.commit(spark, path, frame(spark, texts), "doc_id")
    changed = {i: t for i, t in corpus(rnd, 40, 400).items()} | {8: "w1 w2 w200"}
    G.commit(spark, path, frame(spark, changed), "doc_id", removed=spark.createDataFrame([(9,), (11,)], "doc_id bigint"))
    index = G.open_index(spark, path)
    asked = [(i, (texts[i] or "")) for i in range(30)] + [(100, "w0 w0 w299 none"), (101, ""), (102, " ".join(f"w{i}" for i in range(300)))]
    queries = spark.createDataFrame(asked, "query_id bigint, query string")
    rows = lambda df: sorted((r[0], r[1], r[2], round(r[3], 8)) for r in df.collect())
    assert rows(G.block_search(index, queries, k)) == rows(S.keyword_search(index, queries, k))


def test_half_of_the_postings_are_not_read(spark):
    """Whole texts of over 200 words as queries: blocks that are scored and rows of candidates against all postings of the terms."""
    rnd = random.Random(5)
    word = [f"w{i}" for i in range(20_000)]
    weight = [1 / (i + 1) for i in range(20_000)]
    texts = {i: " ".join(rnd.choices(word, weight, k=260)) for i in range(1500)}
    texts |= {i: " ".join(rnd.sample(texts[i % 5].split(), 200)) for i in range(1500, 1560)}
    path = scratch_path(spark, "segments")
    G.commit(spark, path, frame(spark, texts), "doc_id")
    index = G.open_index(spark, path)
    queries = frame(spark, {i: texts[i] for i in range(5)}).toDF("query_id", "query")
    read = G.plan_search(index, queries)
    postings = index.postings.join(read.weighted, "term").count()
    scored = [index.docs.join(c, ["segment", "doc_id"]).agg(F.sum(F.size("terms"))).first()[0] for c in (read.ahead, read.candidates)]
    blocks = [b.agg(F.sum("n")).first()[0] for b in (read.first, read.kept)]
    assert sum(scored + blocks) <= 0.5 * postings, (scored, blocks, postings)
    rows = lambda df: sorted((r[0], r[1], r[2], round(r[3], 8)) for r in df.collect())
    assert rows(G.block_search(index, queries)) == rows(S.keyword_search(index, queries))


def test_postings_are_read_from_documents(spark):
    path = scratch_path(spark, "segments")
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "beta beta"), (4, "...")], "doc_id long, text string")
    G.commit(spark, path, docs, "doc_id")
    G.commit(spark, path, spark.createDataFrame([(3, "gamma")], "doc_id long, text string"), "doc_id")
    index = G.open_index(spark, path)
    assert sorted(map(tuple, index.postings.collect())) == [(1, 2, "alpha", 1), (1, 2, "beta", 1), (3, 1, "gamma", 1)]
    assert sorted(map(tuple, index.doc_stats.collect())) == [(1, 2), (2, 0), (3, 1), (4, 0)]
    plan = index.postings._jdf.queryExecution().optimizedPlan().toString()
    assert "entries" not in plan


def test_postings_are_not_exchanged(spark, monkeypatch):
    """Neither to write a segment, nor to leave out many deleted documents, of which a broadcast of ids would not be small."""
    monkeypatch.setattr(G, "is_small", lambda df, rows=0: False)
    path, texts = scratch_path(spark, "segments"), corpus(random.Random(3), 200)
    seen = []
    whole = G._write_segment
    monkeypatch.setattr(G, "_write_segment", lambda forward, path: seen.append(plan_of(forward)) or whole(forward, path))
    G.commit(spark, path, frame(spark, texts), "doc_id")
    changed = {i: "new w1" for i in range(2, 100)}
    G.commit(spark, path, frame(spark, changed), "doc_id")
    same(spark, path, texts | changed)
    seen.append(plan_of(G.open_index(spark, path).postings))
    assert len(seen) == 3 and not any("Repartition" in p or "Join LeftAnti" in p or "Aggregate" in p for p in seen), seen


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_segment_of_which_nothing_stays_leaves_no_deletions(spark):
    import os

    path, texts = scratch_path(spark, "segments"), corpus(random.Random(4), 50)
    G.commit(spark, path, frame(spark, texts), "doc_id")
    G.commit(spark, path, frame(spark, {i: f"w{i} w1" for i in texts}), "doc_id")
    same(spark, path, {i: f"w{i} w1" for i in texts})
    assert not os.path.exists(f"{path}/deleted".removeprefix("file:"))


@pytest.mark.parametrize("docs, postings", [(7, 1 << 20), (1000, 40)])
def test_blocks_hold_every_posting_once(spark, monkeypatch, docs, postings):
    """Parts end by documents or by postings; the heads of blocks bound what is in them, and the best come first."""
    monkeypatch.setattr(G, "BLOCK", 3)
    monkeypatch.setattr(G, "STEP_DOCS", 5)
    monkeypatch.setattr(G, "PART_DOCS", docs)
    monkeypatch.setattr(G, "PART_POSTINGS", postings)
    path, texts = scratch_path(spark, "segments"), corpus(random.Random(6), 90) | {200: "Ünï w1 w1 w10 w2 zz", 201: "w1"}
    G.commit(spark, path, frame(spark, texts).coalesce(2), "doc_id")
    index = G.open_index(spark, path)
    blocks = index.blocks.collect()
    held = sorted((e["doc_id"], e["dl"], b["term"], e["tf"]) for b in blocks for e in b["entries"])
    assert held == sorted(map(tuple, index.postings.collect()))
    assert len({(b["term"], b["part"], b["block"]) for b in blocks}) == len(blocks) and len({b["part"] for b in blocks}) > 2
    assert all(b["n"] == len(b["entries"]) <= 3 and b["max_tf"] == max(e["tf"] for e in b["entries"]) and b["min_dl"] == min(e["dl"] for e in b["entries"]) for b in blocks)
    avgdl = index.corpus_stats.first()["avgdl"]
    gains = {}
    for b in sorted(blocks, key=lambda b: b["block"]):
        gains.setdefault((b["term"], b["part"]), []).extend(e["tf"] * 2.2 / (e["tf"] + 1.2 * (0.25 + 0.75 * e["dl"] / avgdl)) for e in b["entries"])
    assert all(a >= b - 1e-5 for g in gains.values() for a, b in zip(g, g[1:]))


def test_texts_of_one_id_and_length_stay_one_document(spark, monkeypatch):
    rows = [(1, "a1 b2"), (1, "b2 c3"), (1, "x9"), (2, ""), (2, None), (3, "b2")]
    got = G.forward_rows(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted((r["doc_id"], r["dl"], [tuple(t) for t in r["terms"]]) for r in got) == [
        (1, 1, [("x9", 1)]), (1, 2, [("a1", 1), ("b2", 2), ("c3", 1)]), (2, 0, []), (2, 0, []), (3, 1, [("b2", 1)])]
