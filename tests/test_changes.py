import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import changes as X
from corpusloom.operators import index as I
from corpusloom.plans import pages_plan as PP
from corpusloom.plans import profile as P
from corpusloom.session import scratch_path
from corpusloom.sources import scan, sinks
from corpusloom.streaming import live_index


def table(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_diff_pairs_copies_one_to_one(spark):
    old = table(spark, [("a", "1"), ("b", "2"), ("c", "x"), ("d", "x"), ("e", "x")])
    new = table(spark, [("a", "1"), ("b", "3"), ("f", "x"), ("g", "x"), ("h", "9")])
    got = {(r["status"], r["path"], r["old_path"]) for r in X.diff_snapshots(old, new).collect()}
    assert got == {("M", "b", None), ("R", "f", "c"), ("R", "g", "d"), ("D", "e", None), ("A", "h", None)}
    flat = {tuple(r) for r in X.flat_changes(X.diff_snapshots(old, new)).select("status", "path").collect()}
    assert ("D", "c") in flat and ("A", "f") in flat


def test_parse_changes(spark):
    lines = spark.createDataFrame([("A\ta.ts",), ("R100\told.ts\tnew.ts",), ("M\twith\ttab",), ("",)], "line string")
    got = {(r["status"], r["path"]) for r in scan.parse_changes(lines).collect()}
    assert got == {("A", "a.ts"), ("D", "old.ts"), ("A", "new.ts"), ("M", "with\ttab")}


def test_incremental_index_equals_rebuild(spark):
    rnd = random.Random(2)
    text = lambda: " ".join(rnd.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(rnd.randint(0, 9)))
    old = [(f"f{i}", text()) for i in range(30)]
    new = old[5:20] + [(p, text()) for p, _ in old[20:]] + [(f"n{i}", text()) for i in range(6)]
    o, n = table(spark, old), table(spark, new)
    changes = X.diff_snapshots(o, n, renames=False)
    index = I.build_index(o, "path", "content")
    fresh = n.join(changes.where("status <> 'D'").select("path"), "path", "left_semi")
    got = I.update_index(index, fresh, "path", "content", changes.where("status = 'D'"))
    want = I.build_index(n, "path", "content")
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert rows(got.term_stats, "term", "df") == rows(want.term_stats, "term", "df")
    assert rows(got.postings, "doc_id", "dl", "term", "tf") == rows(want.postings, "doc_id", "dl", "term", "tf")
    assert got.corpus_stats.first() == want.corpus_stats.first()


def test_updated_terms_read_uncounted_postings_once(spark):
    index = I.build_index(table(spark, [("a", "aa bb"), ("b", "bb cc"), ("c", "cc")]), "path", "content")
    changed, gone = table(spark, [("b", "dd bb")]), table(spark, [("c", "")])
    plans = []
    for counted in (False, True):
        index.counted = counted
        terms = I.update_index(index, changed, "path", "content", gone).term_stats
        assert sorted(map(tuple, terms.collect())) == [("aa", 1), ("bb", 2), ("dd", 1)]
        plans.append(terms._jdf.queryExecution().analyzed().toString())
    assert "LeftSemi" not in plans[0] and "LeftSemi" in plans[1]


def test_affected_pages_and_new_pages(spark):
    pages = table(spark, [("a.md", "uses src/util/Auth.ts here"), ("b.md", "nothing"), ("util.md", "")])
    changes = spark.createDataFrame([("A", "src/util/Auth.ts"), ("A", "src/pay/x.ts"), ("A", "src/pay/y.ts")], "status string, path string")
    assert [r["path"] for r in X.affected_pages(pages, changes.where("path like '%Auth%'")).collect()] == ["a.md"]
    assert [tuple(r) for r in X.pages_to_create(changes, pages).collect()] == [("pay.md", 2)]


def test_scan_and_inventory(spark, tmp_path):
    for name, text in {"src/a.ts": "é", "node_modules/x.js": "x", "pkg.min.js": "x", "docs/r.md": "# R", "img.png": "x",
                       ".hid/b.py": "x", "lib/c.R": "x"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    files = scan.read_files(spark, str(tmp_path))
    assert {r["path"]: r["content"] for r in files.collect()}["src/a.ts"] == "é"
    paths = lambda df: sorted(r["path"] for r in df.collect())
    assert paths(scan.indexable_files(files)) == ["docs/r.md", "src/a.ts"]
    assert paths(scan.project_inventory(scan.read_files(spark, str(tmp_path), content=False))) == ["docs/r.md", "lib/c.R", "pkg.min.js", "src/a.ts"]
    assert paths(scan.source_files(files)) == ["pkg.min.js", "src/a.ts"]
    assert paths(scan.wiki_files(files)) == ["docs/r.md"]


def test_bundle_roundtrip_and_unsafe_paths(spark, tmp_path):
    wiki = table(spark, [("index.md", "# W"), ("a/b.md", "x"), ("style.css", "y"), ("raw.bin", "z")])
    index = table(spark, [("metadata.json", "{}"), ("../evil.json", "{}"), ("a/../../evil", "{}")])
    path = scratch_path(spark, "bundle")
    sinks.write_bundle(sinks.bundle(wiki, index), path)
    assert sinks.list_bundle(spark, path).count() == 6
    rows = sinks.extract_bundle(spark.read.parquet(path))
    assert sorted(r["path"] for r in rows.collect()) == ["a/b.md", "index.md", "metadata.json", "style.css"]
    only = sinks.extract_bundle(spark.read.parquet(path), wiki_only=True)
    assert only.count() == 3
    m = P.bundle_manifest(sinks.list_bundle(spark, path)).first()
    assert (m["page_count"], m["chunk_count"]) == (2, 3)


def test_site_manifest(spark):
    from corpusloom.operators import pages
    path = scratch_path(spark, "site")
    sinks.write_site_manifest(pages.parse_pages(table(spark, [("a.md", "# T\n## H\ntext")])), path)
    row = spark.read.json(f"{path}/search_index").first()
    assert (row["path"], row["title"], row["headings"]) == ("a.html", "T", ["H"])


def test_stream_replaces_and_deletes(spark):
    base = scratch_path(spark, "live")
    src, schema = f"{base}/in", "doc_id long, version long, text string"
    batches = [[(1, 1, "alpha beta"), (2, 1, "beta")], [(1, 2, "gamma"), (3, 2, "beta beta")], [(2, 3, None), (1, 1, "alpha beta")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        live_index.stream_update(stream, f"{base}/out", f"{base}/cp").awaitTermination()
    live_index.compact(spark, f"{base}/out", f"{base}/small")
    for where in ("out", "small"):
        index = live_index.current_index(spark, f"{base}/{where}")
        assert {r["term"]: r["df"] for r in index.term_stats.collect()} == {"gamma": 1, "beta": 1}
        assert index.corpus_stats.first()["n_docs"] == 2


def letters():
    """A model made here, so that it travels to the tasks by value."""
    return lambda: lambda texts: [[len(t), t.count("a")] for t in texts]


def test_any_order_of_batches_equals_a_batch_build(spark):
    """Random changes, late ones, deletions, a lost and two replayed batches, a compaction half way."""
    import random

    from corpusloom.operators import index as I

    rng = random.Random(7)
    kinds = "doc_id long, version long, text string"
    changes = [
        (d, v, rng.choice([None, "", " ".join(rng.choices(["ab", "ba", "cc", "da", "same"], k=rng.randint(1, 6)))]))
        for d in range(12) for v in range(1, 5)
    ]
    rng.shuffle(changes)
    base, small = scratch_path(spark, "live"), scratch_path(spark, "live")
    for n, start in enumerate(range(0, 48, 12)):
        if n == 2:
            live_index.compact(spark, base, small)
            base = small
        batch = spark.createDataFrame(changes[start : start + 12], kinds)
        live_index.apply_batch(batch, n, base, letters(), 2)
        if n % 2:
            live_index.apply_batch(batch, n, base, letters(), 2)
    # a batch that was lost before its versions were written
    spark.createDataFrame([("lost", 5)], "term string, df long").write.parquet(f"{base}/term_deltas/batch=9")
    spark.createDataFrame([(5, 50)], "n_docs long, tokens long").write.parquet(f"{base}/corpus_deltas/batch=9")
    last = {d: t for d, v, t in sorted(changes, key=lambda c: c[:2])}
    docs = {d: t for d, t in last.items() if t is not None}
    want = I.build_index(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), "doc_id", "text")
    got = live_index.current_index(spark, base)
    for name in ("postings", "term_stats", "doc_stats", "corpus_stats"):
        a, b = getattr(got, name), getattr(want, name)
        assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect())), name
    vectors = {r["doc_id"]: r["embedding"] for r in live_index.current_vectors(spark, base, 2).collect()}
    assert vectors == {d: [float(len(t)), float(t.count("a"))] for d, t in docs.items()}


def test_stream_keeps_postings_in_a_row_per_document(spark):
    base, kinds = scratch_path(spark, "live"), "doc_id long, version long, text string"
    live_index.apply_batch(spark.createDataFrame([(1, 1, "ab ba ab"), (2, 1, "ba cc"), (3, 1, "")], kinds), 0, base)
    live_index.apply_batch(spark.createDataFrame([(2, 2, "dd"), (1, 2, None)], kinds), 1, base)
    rows = spark.read.parquet(f"{base}/postings").select("batch", "doc_id", F.size("terms").alias("n")).collect()
    assert sorted(map(tuple, rows)) == [(0, 1, 2), (0, 2, 2), (1, 2, 1)]
    got = live_index.current_index(spark, base)
    assert got.postings.collect() == [(2, 1, "dd", 1)] and got.term_stats.collect() == [("dd", 1)]
    assert got.corpus_stats.collect() == [(2, 0.5)]


def test_stream_without_effective_rows(spark):
    base, kinds = scratch_path(spark, "live"), "doc_id long, version long, text string"
    live_index.apply_batch(spark.createDataFrame([], kinds), 0, base, letters(), 2)
    assert live_index.current_index(spark, base).corpus_stats.collect() == [(0, 0.0)]
    assert live_index.current_vectors(spark, base, 2).count() == 0
    live_index.apply_batch(spark.createDataFrame([(1, 3, None)], kinds), 1, base, letters(), 2)
    live_index.apply_batch(spark.createDataFrame([(1, 2, "late")], kinds), 2, base, letters(), 2)
    assert live_index.current_index(spark, base).term_stats.count() == 0


def test_plans(spark):
    paths = [f"src/components/C{i}.tsx" for i in range(6)] + ["src/index.ts", "src/store/a.ts", "src/store/b.ts", "package.json"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    plan = {r["filename"]: r for r in PP.pattern_plan(files).collect()}
    assert plan["components.md"]["title"] == "Components" and plan["state-management.md"]["type"] == "module"
    listed = {}
    for r in PP.pattern_plan_files(files, PP.pattern_plan(files)).collect():
        listed.setdefault(r["filename"], []).append(r["path"])
    assert set(listed) <= set(plan)  # no file of a page that is not planned
    assert sorted(listed["components.md"]) == paths[:6]
    assert "package.json" in listed["getting-started.md"]
    assert plan["architecture.md"]["place"] == 0 and plan["getting-started.md"]["place"] == 5
    cover = PP.coverage_plan(files, spark.createDataFrame([("Src Store",)], "title string"),
                             spark.createDataFrame([("src/index.ts",)], "path string"), 5, "X").orderBy("ord").collect()
    assert [r["title"] for r in cover] == ["Src Components", "React Components"]
    covered = spark.createDataFrame([("src/index.ts",)], "path string")
    planned = PP.coverage_plan(files, spark.createDataFrame([("Src Store",)], "title string"), covered, 5, "X")
    got = PP.coverage_plan_files(files, covered, planned).collect()
    assert sorted((r["filename"], r["pos"], r["path"]) for r in got) == sorted(
        (name, i + 1, f"src/components/C{i}.tsx") for name in ("src-components.md", "react-components.md") for i in range(6)
    )
    assert P.batch_plan(spark.range(7), 3).orderBy("batch").collect()[-1]["chunks_in_batch"] == 1
    assert P.minimum_pages(files).first()["min_pages"] == 5
