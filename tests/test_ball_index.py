"""Vector search by blocks against the full scan."""

import numpy as np
import pytest

from corpusloom.operators import ball_index as B
from corpusloom.operators import search as S
from corpusloom.session import scratch_path


def clustered(n, dim, groups, spread, seed):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(groups, dim))
    return (middle[rnd.integers(0, groups, n)] + spread * rnd.normal(size=(n, dim))).tolist()


def stored(spark, rows, kinds="doc_id bigint, embedding array<float>", **kw):
    df, path = spark.createDataFrame(rows, kinds).repartition(5), scratch_path(spark, "balls")
    B.save_balls(df, path, **kw)
    return df, B.load_balls(spark, path)


def same(got, want):
    rows = lambda df: sorted((r[0], r[1], r[2], round(r[3], 8) + 0.0) for r in df.collect())
    assert rows(got) == rows(want)


@pytest.mark.parametrize("k,block", [(1, 4096), (10, 4096), (10, 7), (1000, 4096)])
def test_equal_to_the_full_scan(spark, monkeypatch, k, block):
    monkeypatch.setattr(B, "BLOCK_ROWS", block)
    rows = list(enumerate(clustered(400, 8, 12, 0.2, k))) + [(400 + i, [0.0] * 8) for i in range(5)]
    rows += [(500 + i, rows[3][1]) for i in range(30)] + [(600, None), (601, [-x for x in rows[3][1]])]
    vectors, index = stored(spark, rows)
    asked = [(i, rows[i][1]) for i in range(0, 400, 20)] + [(900, [0.0] * 8), (901, None), (902, [1.0] + [0.0] * 7)]
    queries = spark.createDataFrame(asked, "query_id bigint, embedding array<float>")
    same(B.ball_search(index, queries, k), S.vector_search(vectors, queries, k))
    assert index.vectors.count() == sum(v is not None for _, v in rows)


def test_blocks_are_left_out(spark):
    """Most pairs of a query and a vector are never scored where vectors stand in groups."""
    rows = list(enumerate(clustered(3000, 16, 40, 0.05, 1)))
    vectors, index = stored(spark, rows)
    queries = spark.createDataFrame(rows[::100], "query_id bigint, embedding array<float>")
    report = []
    same(B.ball_search(index, queries, 10, report), S.vector_search(vectors, queries, 10))
    assert sum(read for read, _ in report) < 0.2 * sum(whole for _, whole in report)


def test_text_ids_and_empty_tables(spark):
    rows = [(f"d{i:03d}", v) for i, v in enumerate(clustered(60, 4, 3, 0.3, 2))]
    kinds = "doc_id string, embedding array<float>"
    vectors, index = stored(spark, rows, kinds)
    queries = spark.createDataFrame([(f"q{i}", v) for i, (_, v) in enumerate(rows[:4])], "query_id string, embedding array<float>")
    same(B.ball_search(index, queries, 5), S.vector_search(vectors, queries, 5))
    assert B.ball_search(index, queries.limit(0), 5).count() == 0
    _, empty = stored(spark, [], kinds)
    assert B.ball_search(empty, queries, 5).count() == 0
    _, zeros = stored(spark, [("a", [0.0] * 4), ("b", [0.0] * 4)], kinds)
    assert B.ball_search(zeros, queries.limit(1), 5).count() == 2
    with pytest.raises(ValueError):
        B.load_balls(spark, scratch_path(spark, "balls"))
