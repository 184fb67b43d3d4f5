"""Hard negatives, ranked lexical search and the n-gram join against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import lexical, negatives, ngram_join

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
ODD = [None, "", " \n\t", "a", "É Ünï 😀", "x" * 5000, LONG, LONG + " end"]


def texts_of(rnd):
    """Texts of few words, near copies, copies and a passage in many texts."""
    word = [f"w{i}" for i in range(120)]
    shared = " ".join(rnd.choices(word, k=25))
    out = list(ODD)
    for _ in range(25):
        base = rnd.choices(word, k=rnd.randint(3, 80))
        out.append(" ".join(base))
        for _ in range(rnd.randint(0, 4)):
            copy = list(base)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(word)
            out.append("  ".join(copy).upper() if rnd.random() < 0.3 else " ".join(copy))
        out.append(" ".join(rnd.choices(word, k=rnd.randint(0, 12))) + " " + shared)
    return out


def docs_of(spark, texts):
    rows = [(i, t, i, "s", b"z", "a") for i, t in enumerate(texts)]
    rows += [(None, texts[9], 1, None, None, None), (9, texts[9], 0, "s", b"z", "a"), (None, None, 0, None, None, None)]
    kinds = "doc_id bigint, text string, n bigint, node string, key binary, DOC string"
    return spark.createDataFrame(rows, kinds).repartition(5), [(r[0], r[1]) for r in rows]


# 11 hard negatives


def brute_negatives(rows):
    """rows: (id, label, components); anchors are ids divisible by 10."""
    kept = []
    for i, (at, label, v) in enumerate(rows):
        if at is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, at, label, [math.floor(256 * x) for x in v]))
    out = []
    for i, at, label, q in kept:
        if at % 10:
            continue
        scored = sorted(
            (-max(min(sum(a * b for a, b in zip(q, p)), 2**63 - 1), -(2**63)), of, other) for j, of, other, p in kept if j != i
        )
        for score, of, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 30 * -score <= 100 * -s[0] <= 90 * -score][:10]
            out += [(at, of, k + 1, s[1], -score, -s[0]) for k, s in enumerate(fit)]
    return Counter(out)


@pytest.mark.parametrize("tree", [4, 1024])
def test_hard_negatives(spark, monkeypatch, tree):
    monkeypatch.setattr(negatives, "TREE", tree)
    monkeypatch.setattr(negatives, "PASS_BYTES", 8 * 6 * 2 * tree)
    rnd = random.Random(tree)
    middle = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(400):
        m = rnd.choice(middle)
        rows.append((i, rnd.choice([0, 1, 2]), [x + rnd.gauss(0, 0.2) for x in m]))
    rows += [(i, 1, rows[0][2]) for i in range(400, 460)]  # one vector many times
    rows += [rows[10], rows[11], (500, 1, []), (501, 2, [0.5, 0.5]), (510, 0, [0.0] * 6), (520, 7, [1.0] * 6)]
    rows += [(None, 1, [1.0] * 6), (530, None, [1.0] * 6), (540, 1, None), (550, 1, [None] * 6)]
    rows += [(560, 1, [float("nan")] * 6), (570, 1, [float("inf")] + [0.0] * 5), (503, 1, [1.0] * 9)]
    kinds = "vec_id bigint, label int, embedding array<double>, row string, ID string, q string"
    df = spark.createDataFrame([(*r, "x", "y", None) for r in rows], kinds).repartition(7)
    got = Counter(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == brute_negatives(rows)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_negatives_of_huge_components_and_text_ids(spark):
    rnd = random.Random(3)
    rows = [(i, i % 2, [rnd.uniform(-1, 1) * 10 ** rnd.choice([0, 8, 17, 30]) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    limits = [(i, lab, [max(min(math.floor(256 * x), 2**63 - 1), -(2**63)) / 256 for x in v]) for i, lab, v in rows]
    got = {tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()}
    named = df.withColumn("vec_id", F.format_string("%03d", "vec_id"))
    again = negatives.hard_negatives(named, F.col("vec_id").endswith("0")).collect()
    assert {(int(r[0]), int(r[1]), r[2], int(r[3]), r[4], r[5]) for r in again} == got
    whole = [(i, lab, v) for i, lab, v in limits if max(map(abs, v)) < 10**9]
    small = df.where(F.col("vec_id").isin([r[0] for r in whole]))
    assert Counter(map(tuple, negatives.hard_negatives(small, F.col("vec_id") % 10 == 0).collect())) == brute_negatives(whole)


def test_bounds_along_the_tree_save_scores():
    """Near anchors: most candidates are not scored again, and what is found stays the same."""
    rnd = np.random.default_rng(1)
    a = rnd.integers(-200, 200, (1, 8)) + rnd.integers(-2, 3, (40, 8))
    q = rnd.integers(-200, 200, (2000, 8))
    parent = np.array([-1] + [0] * 39)
    edge = np.sqrt(((a - a[0]) ** 2).sum(1)).astype(float)
    asked = [[(0, -(2**63), 2**63 - 1)] for _ in a]
    t = negatives.Tree(np.arange(40), np.full(40, -1), np.zeros(40, int), a, parent, edge, asked, True, 5)
    scored = t.search(list(range(2000)), np.arange(2000), np.zeros(2000, int), q, q.astype(float), np.sqrt((q**2).sum(1)))
    scored += t.search(list(range(2000)), np.arange(2000), np.zeros(2000, int), q, q.astype(float), np.sqrt((q**2).sum(1)))
    assert scored < 0.6 * 2 * 40 * 2000
    for j in range(40):
        best = sorted((-int(s), i) for i, s in enumerate(q @ a[j]))
        assert t.best[j][0] == sorted(best * 2)[:5]


# 12 ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_search(docs, queries, top=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    many, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in queries:
        found = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * many // total
            score = 0
            for t in set(terms(text)) & set(b):
                w = math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1)))
                score += w * (10**9 * b[t] // (1000 * b[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found, key=lambda x: x[:3])[:top])]
    return Counter(out)


@pytest.mark.parametrize("bucket,items", [(7, 5), (2000, 2048)])
def test_lexical_search(spark, monkeypatch, bucket, items):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "ITEMS", items)
    monkeypatch.setattr(lexical, "ITEM_BYTES", 3000 if items == 5 else 16 << 20)
    rnd = random.Random(bucket)
    texts = texts_of(rnd)
    df, docs = docs_of(spark, texts)
    asked = [(i, " ".join(rnd.choices(t.split() or [""], k=12))) for i, t in enumerate(texts[8:40])]
    asked += [(100, None), (101, ""), (None, "w1 W2 w3-w4"), (3, "w1 w1 É"), (3, "w1 w1 É"), (102, LONG), (103, "nothing_here")]
    items_df = spark.createDataFrame([(*r, "q", "item") for r in asked], "item_id bigint, text string, q string, terms string")
    got = Counter(map(tuple, lexical.lexical_search(df, items_df).collect()))
    assert got == brute_search(docs, asked)
    assert lexical.lexical_search(df.limit(0), items_df).count() == 0
    assert lexical.lexical_search(df, items_df.limit(0)).count() == 0


def test_buckets_and_bounds_save_scores():
    """Long vectors first: once good documents are known, most others are never scored."""
    rnd = np.random.default_rng(4)
    n_terms, weights = 50, np.arange(50, 0, -1)
    block = lexical.Block([np.array([0, 1, 2, 3, 4, 5, 6, 7]), np.array([40, 41])], weights, np.ones(2), 10)
    scale = np.sort(rnd.uniform(1, 1000, 5000))[::-1]
    rows = []
    for s in scale:
        t = np.sort(rnd.choice(n_terms, 10, replace=False))
        rows.append((t, (rnd.uniform(0.1, 1, 10) * s).astype(np.int64) + 1))
    for start in range(0, 5000, 500):
        part = rows[start : start + 500]
        at = np.arange(0, 10 * len(part) + 1, 10)
        t, v = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
        norm = np.sqrt(np.add.reduceat(v.astype(float) ** 2, at[:-1]))
        by = np.argsort(-norm, kind="stable")
        t, v = t.reshape(-1, 10)[by].ravel(), v.reshape(-1, 10)[by].ravel()
        block.search([start + int(i) for i in by], norm[by], at, t, v, n_terms)
    assert block.scored < 0.2 * block.bounded
    for q, s in enumerate(([0, 1, 2, 3, 4, 5, 6, 7], [40, 41])):
        want = sorted((-int(v[np.isin(t, s)].sum()), False, i) for i, (t, v) in enumerate(rows))[:10]
        assert block.best[q] == want


# 13 n-gram join


def brute_links(rows, size=4, percent=85):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    label = list(range(len(rows)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                label[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (at, _) in enumerate(rows):
        known = [x for x in (least.get(top(i)), at) if x is not None]
        least[top(i)] = min(known) if known else None
    return Counter((at, len(sets[i]), least[top(i)]) for i, (at, _) in enumerate(rows))


@pytest.mark.parametrize("sent", [0, 500_000])
def test_ngram_links(spark, monkeypatch, sent):
    monkeypatch.setattr(ngram_join, "IDS_SENT", sent)
    rnd = random.Random(sent)
    texts = texts_of(rnd)
    # a family of near copies around one text, some of them further from each other than the threshold
    base = [f"b{i}" for i in range(100)]
    for i in range(40):
        copy = list(base)
        for k in range(rnd.randint(0, 4)):
            copy[rnd.randrange(100)] = f"new{i}_{k}"
        texts.append(" ".join(copy))
    df, rows = docs_of(spark, texts)
    got = Counter(map(tuple, ngram_join.ngram_links(df).collect()))
    assert got == brute_links(rows)
    assert ngram_join.ngram_links(df.limit(0)).count() == 0


def test_links_at_the_very_threshold(spark):
    """85 of 100 shingles link; 84 of 100 do not; chains reach further than links."""
    word = [f"x{i}" for i in range(103)]
    rows = [(0, " ".join(word[:103]))]
    rows += [(1, " ".join(word[:88])), (2, " ".join(word[:87])), (3, " ".join(word[:75])), (4, "x0 x1 x2"), (5, "X0\tx1\nx2 ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r[0]: (r[1], r[2]) for r in ngram_join.ngram_links(df).collect()}
    assert got == {0: (100, 0), 1: (85, 0), 2: (84, 0), 3: (72, 0), 4: (1, 4), 5: (1, 4)}
    few = df.where("doc_id in (0, 2)")
    assert {r[2] for r in ngram_join.ngram_links(few).collect()} == {0, 2}


def test_first_filter_keeps_every_pair():
    """Whatever the sizes, a pair at the threshold shares as many first n-grams as either set needs."""
    rnd = np.random.default_rng(2)
    for _ in range(3000):
        n = int(rnd.integers(1, 300))
        union = rnd.choice(10**6, n, replace=False)
        both = -(-85 * n // 100) if rnd.random() < 0.7 else int(rnd.integers(-(-85 * n // 100), n + 1))
        cut = both + int(rnd.integers(0, n - both + 1))
        a, b = np.sort(union[:cut]), np.sort(np.concatenate([union[:both], union[cut:]]))
        common = len(np.intersect1d(ngram_join.first_grams(a, 85), ngram_join.first_grams(b, 85)))
        assert common >= ngram_join.needed(len(a), 85) and common >= ngram_join.needed(len(b), 85)
