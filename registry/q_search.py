"""Inverted index, search, fusion, rerank and context queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.functions import fixed, vectors
from corpusloom.functions import text as T
from corpusloom.operators import ball_index
from corpusloom.operators import context as C
from corpusloom.operators import embeddings
from corpusloom.operators import grams
from corpusloom.operators import index as I
from corpusloom.operators import search as S_
from corpusloom.operators import segments
from corpusloom.session import scratch_path
from registry import sqlkit as S
from registry.base import CHECKS, query, table
from registry.inputs import cte, derive

_saved: dict[tuple[str, str], str] = {}


def saved_index(spark, d):
    """The documents' index, written once to shared storage and then read by every search."""
    key = (spark.sparkContext.applicationId, d)
    name = "idx_" + "".join(c if c.isalnum() else "_" for c in "_".join(key))
    if key not in _saved:
        path = scratch_path(spark, "index")
        built = I.build_index(table(spark, d, "documents"), "doc_id", "text")
        I.save_index(built, path, name)
        _saved[key] = path
    return I.load_index(spark, _saved[key], name)


def built_index(spark, d):
    return I.build_index(table(spark, d, "documents"), "doc_id", "text")


def rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


IDX = S.index_ctes()
BM25 = f"{cte('queries')}, {IDX}, {S.bm25_ctes()}"


# --- the index itself ---------------------------------------------------------------------
@query("agg1_term_frequency", f"WITH {IDX} SELECT doc_id, term, tf FROM tf")
def agg1(spark, d):
    return I.term_frequencies(table(spark, d, "documents"), "doc_id", "text").select(
        "doc_id", "term", "tf"
    )


@query("agg1_term_frequency_fields", f"""
WITH {cte('fields')}, toks AS (SELECT doc_id, {S.tokens("concat_ws(' ', content, title, description)")} AS ts FROM fields)
SELECT doc_id, t AS term, count(*) AS tf FROM toks, unnest(ts) AS u(t) GROUP BY ALL""")
def agg1b(spark, d):
    text = I.index_text("content", "title", "description")
    return I.term_frequencies(derive(spark, d, "fields"), "doc_id", text).drop("dl")


@query("agg2_document_frequency", f"WITH {IDX} SELECT term, df FROM dfs")
def agg2(spark, d):
    return built_index(spark, d).term_stats


@query("agg3_document_lengths", f"WITH {IDX} SELECT doc_id, len(ts) AS dl FROM toks")
def agg3(spark, d):
    return built_index(spark, d).doc_stats


@query("agg3_corpus_statistics", f"WITH {IDX} SELECT n AS n_docs, round(avgdl, 6) AS avgdl FROM cs")
def agg3b(spark, d):
    return rounded(built_index(spark, d).corpus_stats, "avgdl")


_KW = (
    "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), "
    "lambda w: length(w) >= 3 AND regexp_matches(w, '^[a-z]') AND NOT list_contains("
    f"[{', '.join(repr(w) for w in fixed.PAGE_STOP_WORDS)}], w)))"
)


@query("agg16_keyword_pages", f"SELECT doc_id, unnest({_KW}) AS keyword FROM documents")
def agg16(spark, d):
    return I.keyword_pages(table(spark, d, "documents"), "doc_id", "text")


# --- keyword search ---------------------------------------------------------------------------
@query("sch1_bm25_scores", f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score FROM scored")
def sch1(spark, d):
    return rounded(S_.bm25_scores(saved_index(spark, d), derive(spark, d, "queries")), "score")


@query("sch2_keyword_search",
       f"WITH {BM25} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ({S.ranked('scored', 10)})")
def sch2(spark, d):
    found = S_.keyword_search(saved_index(spark, d), derive(spark, d, "queries"))
    return rounded(found, "score")


def segmented_index(spark, d):
    """The documents' index in segments: two commits, so that what is read has deletions."""
    key = (spark.sparkContext.applicationId, d, "segments")
    if key not in _saved:
        path, docs = scratch_path(spark, "segments"), table(spark, d, "documents")
        segments.commit(spark, path, docs.withColumn("text", F.concat(F.lit("older "), "text")), "doc_id")
        segments.commit(spark, path, docs, "doc_id")
        _saved[key] = path
    return segments.open_index(spark, _saved[key])


@query("sch2_block_search",
       f"WITH {BM25} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ({S.ranked('scored', 10)})")
def sch2_blocks(spark, d):
    return rounded(segments.block_search(segmented_index(spark, d), derive(spark, d, "queries")), "score")


@query("sch2_keyword_search_filtered", f"""
WITH {BM25}, f AS (SELECT * FROM scored WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en'))
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ({S.ranked('f', 10)})""")
def sch2b(spark, d):
    allowed = table(spark, d, "documents").where("lang = 'en'")
    found = S_.keyword_search(saved_index(spark, d), derive(spark, d, "queries"), allowed=allowed)
    return rounded(found, "score")


# --- vectors --------------------------------------------------------------------------------------
UNIT = "list_transform(embedding, lambda x: x::DOUBLE)"
VEC = f"""
vecs AS (SELECT vec_id AS doc_id, {UNIT} AS v FROM embeddings),
unit AS (SELECT doc_id, CASE WHEN list_dot_product(v, v) = 0 THEN v ELSE
         list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) END AS u FROM vecs)"""
CENTROIDS = """
centre AS (SELECT label AS query_id, pos, avg(x::DOUBLE) AS x FROM
  (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL),
cq AS (SELECT query_id, list(x ORDER BY pos) AS v FROM centre GROUP BY query_id)"""


def doc_vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def label_centroids(spark, d):
    """One query vector per label: the mean of its vectors."""
    parts = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    mean = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("embedding")
    )


@query("sch3_vector_search", f"""
WITH {VEC}, {CENTROIDS},
near AS (SELECT query_id, doc_id, list_dot_product(u, v) / sqrt(list_dot_product(v, v)) AS score FROM cq, unit)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ({S.ranked('near', 10)})""")
def sch3(spark, d):
    return rounded(S_.vector_search(doc_vectors(spark, d), label_centroids(spark, d)), "score")


@query("sch3_vector_search_by_blocks", f"""
WITH {VEC}, {CENTROIDS},
near AS (SELECT query_id, doc_id, list_dot_product(u, v) / sqrt(list_dot_product(v, v)) AS score FROM cq, unit)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ({S.ranked('near', 10)})""")
def sch3_blocks(spark, d):
    path = scratch_path(spark, "balls")
    ball_index.save_balls(doc_vectors(spark, d), path)
    return rounded(ball_index.ball_search(ball_index.load_balls(spark, path), label_centroids(spark, d)), "score")


@query("sch4_normalize", f"""
WITH {VEC} SELECT doc_id, list_transform(u, lambda x: round(x, 6)) AS unit FROM unit""")
def sch4(spark, d):
    return doc_vectors(spark, d).select(
        "doc_id", F.transform(vectors.normalize("embedding"), lambda x: F.round(x, 6)).alias("unit")
    )


@query("sch5_cosine", f"""
WITH {VEC}, {CENTROIDS}
SELECT vec_id, round(list_dot_product({UNIT}, v) /
  (sqrt(list_dot_product({UNIT}, {UNIT})) * sqrt(list_dot_product(v, v))), 6) AS cosine
FROM embeddings JOIN cq ON query_id = label""")
def sch5(spark, d):
    own = label_centroids(spark, d).select(
        F.col("query_id").cast("int").alias("label"), F.col("embedding").alias("centre")
    )
    return table(spark, d, "embeddings").join(own, "label").select(
        "vec_id", F.round(vectors.cosine("embedding", "centre"), 6).alias("cosine")
    )


@query("sch6_occurrence_search", f"""
WITH {cte('queries')},
qw AS (SELECT query_id, unnest(string_split_regex(lower(query), '\\s+')) AS w FROM queries),
s AS (SELECT query_id, doc_id, sum((length(lower(text)) - length(replace(lower(text), w, ''))) // length(w))::DOUBLE AS score
      FROM qw, documents WHERE w <> '' AND contains(lower(text), w) GROUP BY ALL)
SELECT query_id, rank, doc_id, score FROM ({S.ranked('s', 10)})""")
def sch6(spark, d):
    return S_.occurrence_search(table(spark, d, "documents"), derive(spark, d, "queries"))


@query("sch6_occurrence_search_by_join", CHECKS["sch6_occurrence_search"])
def sch6b(spark, d):
    """The way for word lists beyond the constant's bound, on the same input."""
    return S_.occurrence_search(
        table(spark, d, "documents"), derive(spark, d, "queries"), constant=False
    )


# --- hybrid --------------------------------------------------------------------------------------------
HYB = f"""{BM25}, {VEC},
near AS (SELECT a.doc_id AS query_id, b.doc_id, list_dot_product(a.u, b.u) AS score
         FROM unit a, unit b WHERE a.doc_id IN (SELECT query_id FROM queries)),
kw AS ({S.ranked('scored', 30)}), nv AS ({S.ranked('near', 30)}),
fused AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, max(vs) AS vector_score, max(bs) AS bm25_score
  FROM (SELECT query_id, doc_id, rank, NULL::DOUBLE AS vs, score AS bs FROM kw
        UNION ALL SELECT query_id, doc_id, rank, score, NULL FROM nv) GROUP BY ALL)"""
ROUND3 = "query_id, rank, doc_id, round(score, 6) AS score, round(vector_score, 6) AS vector_score, round(bm25_score, 6) AS bm25_score"


def hybrid_inputs(spark, d):
    q = derive(spark, d, "queries").join(
        doc_vectors(spark, d).withColumnRenamed("doc_id", "query_id"), "query_id", "left"
    )
    return saved_index(spark, d), doc_vectors(spark, d), q


@query("sch7_rank_fusion", f"WITH {HYB} SELECT query_id, doc_id, round(score, 6) AS score FROM fused")
def sch7(spark, d):
    index, vecs, q = hybrid_inputs(spark, d)
    lists = [S_.keyword_search(index, q, 30), S_.vector_search(vecs, q, 30)]
    return rounded(S_.fuse(lists), "score")


@query("sch8_hybrid_search", f"WITH {HYB} SELECT {ROUND3} FROM ({S.ranked('fused', 10)})")
def sch8(spark, d):
    index, vecs, q = hybrid_inputs(spark, d)
    return rounded(S_.hybrid_search(index, vecs, q), "score", "vector_score", "bm25_score")


@query("sch9_search_by_mode", f"""
WITH {HYB},
m AS (SELECT query_id, CASE query_id % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'vector' ELSE 'keyword' END AS mode FROM queries)
SELECT {ROUND3}, mode FROM (
  SELECT f.*, mode FROM ({S.ranked('fused', 10)}) f JOIN m USING (query_id) WHERE mode = 'hybrid'
  UNION ALL BY NAME SELECT query_id, rank, doc_id, score, score AS vector_score, NULL AS bm25_score, mode
    FROM nv JOIN m USING (query_id) WHERE mode = 'vector' AND rank <= 10
  UNION ALL BY NAME SELECT query_id, rank, doc_id, score, NULL AS vector_score, score AS bm25_score, mode
    FROM kw JOIN m USING (query_id) WHERE mode = 'keyword' AND rank <= 10)""")
def sch9(spark, d):
    index, vecs, q = hybrid_inputs(spark, d)
    r = F.col("query_id") % 3
    q = q.withColumn("mode", F.when(r == 0, "hybrid").when(r == 1, "vector").otherwise("keyword"))
    found = S_.search_by_mode(index, vecs, q).select(
        "query_id", "rank", "doc_id", "score", "vector_score", "bm25_score", "mode"
    )
    return rounded(found, "score", "vector_score", "bm25_score")


RERANK = f"""{HYB},
cand AS ({S.ranked('fused', 20)}),
re AS (SELECT cand.query_id, doc_id, score, vector_score, bm25_score,
   len(list_intersect(list_distinct({S.tokens('query')}), {S.tokens('text')}))::DOUBLE
     / len(list_distinct({S.tokens('query')})) AS rerank_score
   FROM (SELECT * EXCLUDE (rank) FROM cand) cand JOIN queries USING (query_id) JOIN documents USING (doc_id))"""


@query("sch10_rerank", f"""
WITH {RERANK} SELECT {ROUND3}, round(rerank_score, 6) AS rerank_score
FROM ({S.ranked('re', 10, 'round(rerank_score, 9) DESC, doc_id')})""")
def sch10(spark, d):
    index, vecs, q = hybrid_inputs(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = S_.search(index, vecs, q, "hybrid", 10, rerank_docs=docs).select(
        "query_id", "rank", "doc_id", "score", "vector_score", "bm25_score", "rerank_score"
    )
    return rounded(found, "score", "vector_score", "bm25_score", "rerank_score")


# --- field search ---------------------------------------------------------------------------------------
def page_fields(spark, d):
    """Documents as pages: first two words as title, second line as description, lines as headings."""
    return derive(spark, d, "fields").withColumn("headings", F.split("content", "\n"))


PF = f"""{cte('queries', 'fields')},
pf AS (SELECT *, string_split(content, chr(10)) AS headings FROM fields),
w AS (SELECT query_id, unnest({S.words('query')}) AS w FROM queries)"""


def _any_heading() -> str:
    return "len(list_filter(headings, lambda h: contains(lower(h), w))) "


@query("sch9_occurrences_without_vectors", CHECKS["sch6_occurrence_search"])
def sch9_occurrences(spark, d):
    found = S_.search(built_index(spark, d), None, derive(spark, d, "queries"), "vector", texts=table(spark, d, "documents").select("doc_id", "text"))
    return found.select("query_id", "rank", "doc_id", "score")


@query("sch11_field_search", f"""
WITH {PF},
s AS (SELECT query_id, doc_id, sum(CASE WHEN contains(lower(title), w) THEN 10 ELSE 0 END
   + CASE WHEN contains(lower(description), w) THEN 5 ELSE 0 END
   + CASE WHEN {_any_heading()} > 0 THEN 3 ELSE 0 END
   + CASE WHEN contains(lower(content), w) THEN 1 ELSE 0 END)::DOUBLE AS score FROM w, pf GROUP BY ALL HAVING score > 0)
SELECT query_id, rank, doc_id, score FROM ({S.ranked('s', 10)})""")
def sch11(spark, d):
    weights = {"title": 10, "description": 5, "headings": 3, "content": 1}
    return S_.field_search(page_fields(spark, d), derive(spark, d, "queries"), weights)


@query("sch12_title_body_search", f"""
WITH {PF},
s AS (SELECT query_id, doc_id, sum(CASE WHEN contains(lower(title), w) THEN 10 ELSE 0 END
   + CASE WHEN contains(lower(content), w) THEN 1 ELSE 0 END)::DOUBLE AS score FROM w, pf GROUP BY ALL HAVING score > 0),
r AS ({S.ranked('s', 10)}),
ws AS (SELECT query_id, {S.words('query')} AS ws FROM queries)
SELECT query_id, rank, doc_id, score,
  coalesce(nullif(substr({S.strip("(list_filter(headings, lambda l: len(list_filter(ws, lambda x: contains(lower(l), x))) > 0))[1]")}, 1, 200), ''),
           substr({S.strip('headings[1]')}, 1, 200)) AS preview
FROM r JOIN pf USING (doc_id) JOIN ws USING (query_id)""")
def sch12(spark, d):
    pages, q = page_fields(spark, d), derive(spark, d, "queries")
    found = S_.field_search(pages, q, {"title": 10, "content": 1})
    return (
        found.join(pages.select("doc_id", "content"), "doc_id")
        .join(q, "query_id")
        .select("query_id", "rank", "doc_id", "score",
                T.preview_line("content", T.query_words("query")).alias("preview"))
    )


SUBSTRING = f"""
WITH {PF}, q2 AS (SELECT query_id, lower(query) AS q FROM queries),
hit AS (SELECT query_id, doc_id, doc_id AS ord FROM q2, pf WHERE length(q) >= 2 AND (contains(lower(title), q)
  OR contains(lower(content), q) OR len(list_filter(headings, lambda h: contains(lower(h), q))) > 0))
SELECT query_id, rank, doc_id FROM ({S.ranked('hit', 10, 'ord')})"""


@query("sch13_substring_search", SUBSTRING)
def sch13(spark, d):
    pages = page_fields(spark, d).withColumn("ord", F.col("doc_id"))
    return S_.substring_search(pages, derive(spark, d, "queries"))


@query("sch13_substring_search_by_grams", SUBSTRING)
def sch13_grams(spark, d):
    """The same answers from a stored gram index of titles, contents and headings."""
    pages, path = page_fields(spark, d).withColumn("ord", F.col("doc_id")), scratch_path(spark, "grams")
    grams.save_grams(S_.page_parts(pages), ["doc_id", "ord", "item"], "text", path)
    return S_.substring_search(grams.load_grams(spark, path), derive(spark, d, "queries"))


def _letter_model():
    return lambda texts: [[len(t), t.count("e"), t.count(" ")] for t in texts]


@query("udf1_embed_by_content", """
SELECT doc_id, [length(text)::DOUBLE, length(text) - length(replace(text, 'e', '')), length(text) - length(replace(text, ' ', ''))] AS embedding FROM documents""")
def udf1_content(spark, d):
    """English documents first, then all: the second call embeds only texts that the first did not see."""
    docs, path = table(spark, d, "documents"), scratch_path(spark, "vectors")
    embeddings.embed_by_content(docs.where("lang = 'en'"), "doc_id", "text", path, _letter_model, 3)
    made = embeddings.embed_by_content(docs, "doc_id", "text", path, _letter_model, 3)
    return made.select("doc_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


CTX = f"""{PF}, {VEC},
near AS (SELECT a.doc_id AS query_id, b.doc_id, list_dot_product(a.u, b.u) AS score
         FROM unit a, unit b WHERE a.doc_id IN (SELECT query_id FROM queries)),
nk AS (SELECT query_id, doc_id, score FROM ({S.ranked('near', 5)}) WHERE score > 0.45),
poor AS (SELECT query_id FROM queries WHERE query_id NOT IN
         (SELECT query_id FROM nk GROUP BY query_id HAVING count(*) >= 3)),
ws AS (SELECT query_id, doc_id, sum(CASE WHEN contains(lower(title), w) THEN 3 ELSE 0 END
   + CASE WHEN contains(lower(content), w) THEN 1 ELSE 0 END + 2 * {_any_heading()})::DOUBLE AS score
   FROM w JOIN poor USING (query_id), pf GROUP BY ALL HAVING score > 0),
allc AS (SELECT *, 'vector' AS origin FROM nk UNION ALL
   SELECT *, 'words' FROM ws WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM nk)),
ctx AS ({S.ranked('allc', 5)})"""


def context_rows(spark, d):
    q = derive(spark, d, "queries").join(
        doc_vectors(spark, d).withColumnRenamed("doc_id", "query_id"), "query_id", "left"
    )
    return S_.context_search(doc_vectors(spark, d), page_fields(spark, d), q, threshold=0.45)


@query("sch14_context_search", f"WITH {CTX} SELECT query_id, rank, doc_id, round(score, 6) AS score, origin FROM ctx")
def sch14(spark, d):
    return rounded(context_rows(spark, d), "score")


# --- topic retrieval and answers ---------------------------------------------------------------------------
_BLOCK = """(chr(10) || CASE WHEN doc_id % 3 <> 0 AND title <> '' THEN '### ' || CASE WHEN doc_id % 2 = 0 THEN 'Section' ELSE 'Code' END || ': ' || title || ' (' || path || ':1)'
  ELSE '### ' || path || ':1-9' END || CASE WHEN description <> '' THEN chr(10) || '**Documentation:** ' || description[1:200] || '...' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 4 = 0 AND lang <> '' THEN chr(10) || '**Signature:** `' || lang || '`' || chr(10) ELSE '' END
  || chr(10) || '```' || coalesce(lang, '') || chr(10) || content[1:1500] || chr(10) || '```' || chr(10))"""


@query("sch15_topic_retrieval", f"""
WITH {BM25}, {cte('fields')}, r AS ({S.ranked('scored', 5)}),
seen AS (SELECT *, row_number() OVER (PARTITION BY topic_id, doc_id ORDER BY query_id, rank) AS n
  FROM (SELECT r.query_id, r.rank, r.doc_id, r.query_id % 5 AS topic_id, length({_BLOCK}) AS chars
        FROM r JOIN (SELECT *, 'f' || doc_id || '.ts' AS path FROM fields JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)) USING (doc_id))),
b AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY topic_id ORDER BY query_id, rank
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM seen WHERE n = 1)
SELECT topic_id, query_id, rank, doc_id, before::BIGINT AS before FROM b WHERE before <= 12000""")
def sch15(spark, d):
    q = derive(spark, d, "queries")
    topics = q.select(
        (F.col("query_id") % 5).alias("topic_id"), "query_id", F.col("query_id").alias("query_ord")
    )
    chunks = derive(spark, d, "fields").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").selectExpr(
        "doc_id", "concat('f', doc_id, '.ts') AS path", "1 AS start_line", "9 AS end_line", "CASE WHEN doc_id % 3 <> 0 THEN title END AS name",
        "CASE WHEN doc_id % 2 = 0 THEN 'Section' END AS chunk_type", "description AS documentation",
        "CASE WHEN doc_id % 4 = 0 THEN lang END AS signature", "lang AS language", "content",
    )
    found = S_.keyword_search(saved_index(spark, d), q, 5)
    return S_.topic_retrieval(found, chunks, topics).select(
        "topic_id", "query_id", "rank", "doc_id", "before"
    )


# the sentence split needs look-behind, which RE2 lacks: mark the ends, then split
_SENT = (
    "list_filter(list_transform(string_split(" + S.rx(S.clean_markdown("content"), r"([.!?])\s+", "\\1\x01")
    + ", '\x01'), lambda s: " + S.strip("s") + "), lambda s: length(s) > 15 AND length(s) < 500)"
)
_QW = (
    "list_filter(string_split_regex(regexp_replace(lower(query), '[^a-z0-9\\s]', '', 'g'), '\\s+'), "
    f"lambda w: length(w) > 2 AND w NOT IN {S.inlist(fixed.QUESTION_STOP_WORDS)})"
)


@query("sch18_extractive_answer", f"""
WITH {CTX},
top AS (SELECT c.query_id, p.title, {_SENT} AS s, {_QW} AS q FROM ctx c JOIN pf p USING (doc_id)
        JOIN queries USING (query_id) WHERE c.rank = 1),
sc AS (SELECT query_id, i, s[i] AS txt, len(list_filter(q, lambda w: contains(lower(s[i]), w))) AS hits
       FROM (SELECT query_id, s, q, unnest(range(1, len(s) + 1)) AS i FROM top)),
bestx AS (SELECT query_id, string_agg(txt, ' ' ORDER BY hits DESC, i) AS answer FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, i) AS n FROM sc WHERE hits > 0) WHERE n <= 3 GROUP BY query_id),
a AS (SELECT query_id, title, coalesce(b.answer, array_to_string(s[1:2], ' ')) AS answer FROM top LEFT JOIN bestx b USING (query_id)),
rel AS (SELECT query_id, list(title ORDER BY rank) AS related FROM ctx JOIN pf USING (doc_id) WHERE rank BETWEEN 2 AND 4 GROUP BY query_id)
SELECT query_id, CASE WHEN answer <> '' AND NOT regexp_matches(answer, '[.!?]$') THEN answer || '.' ELSE answer END AS answer,
  title AS source, related FROM a LEFT JOIN rel USING (query_id)""")
def sch18(spark, d):
    pages = page_fields(spark, d).select("doc_id", "title", "content")
    ctx = context_rows(spark, d).join(pages, "doc_id")
    return S_.extractive_answer(ctx, derive(spark, d, "queries"))


@query("flt9_relevance_threshold", f"""
WITH {VEC}, {CENTROIDS},
near AS (SELECT query_id, doc_id, list_dot_product(u, v) / sqrt(list_dot_product(v, v)) AS score FROM cq, unit)
SELECT query_id, doc_id, round(score, 6) AS score FROM near WHERE round(score, 9) > 0.3""")
def flt9(spark, d):
    near = S_.vectors_above(doc_vectors(spark, d), label_centroids(spark, d), fixed.RELEVANCE_THRESHOLD)
    return rounded(near, "score")


@query("win1_fusion_rank", f"""
WITH {BM25} SELECT query_id, doc_id, rank, round(1.0::DOUBLE / (60 + rank), 6) AS step FROM ({S.ranked('scored', 30)})""")
def win1(spark, d):
    found = S_.keyword_search(saved_index(spark, d), derive(spark, d, "queries"), 30)
    return found.select(
        "query_id", "doc_id", "rank", F.round(F.lit(1.0) / (F.col("rank") + fixed.RRF_K), 6).alias("step")
    )


@query("win2_top_k", "SELECT source, doc_id, rank, n_chars::DOUBLE AS n_chars FROM ("
       "SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 10")
def win2(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    return S_.top_k(docs, 10, "source", "n_chars", "doc_id")


@query("set1_candidate_union", f"WITH {HYB} SELECT DISTINCT query_id, doc_id FROM (SELECT query_id, doc_id FROM kw UNION SELECT query_id, doc_id FROM nv)")
def set1(spark, d):
    index, vecs, q = hybrid_inputs(spark, d)
    a = S_.keyword_search(index, q, 30).select("query_id", "doc_id")
    return a.union(S_.vector_search(vecs, q, 30).select("query_id", "doc_id")).distinct()


# --- vectors from text: no SQL equivalent (hashing) -------------------------------------------------------------
@query("udf1_embed")
def udf1(spark, d):
    return I.embed(table(spark, d, "documents"), "doc_id", "text", dim=64)


@query("udf2_pair_scorer", f"""
WITH {RERANK} SELECT query_id, doc_id, round(rerank_score, 6) AS rerank_score FROM re""")
def udf2(spark, d):
    """The pluggable scorer as an Arrow UDF; tokens are cut by Spark, the UDF compares sets."""
    @F.pandas_udf("double")
    def share(asked: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series(
            [len(set(a) & set(b)) / max(1, len(set(a))) for a, b in zip(asked, found)], dtype="float64"
        )

    index, vecs, q = hybrid_inputs(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = S_.hybrid_search(index, vecs, q, 10, keep=20)
    scored = S_.rerank(found, q, docs, 20, lambda a, b: share(T.tokens(a), T.tokens(b)))
    return rounded(scored.select("query_id", "doc_id", "rerank_score"), "rerank_score")


# --- budgets and conversations ---------------------------------------------------------------------------------------
@query("ctx1_char_budget", """
SELECT conv_id, turn, before::BIGINT AS before FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) WHERE before <= 1200""")
def ctx1(spark, d):
    rows = table(spark, d, "conversations").withColumn("chars", F.length("text"))
    return C.fit_budget(rows, "conv_id", "turn", "chars", 1200).select("conv_id", "turn", "before")


@query("ctx2_trim_history", """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS up,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS down, count(*) OVER (PARTITION BY conv_id) AS n,
  sum(ceil(length(text) / 4.0)) OVER (PARTITION BY conv_id) AS tokens FROM conversations)
SELECT conv_id, turn, (tokens >= 250 AND n > 5) AS pruned FROM c WHERE NOT (tokens >= 250 AND n > 5) OR up = 1 OR down <= 4""")
def ctx2(spark, d):
    return C.trim_history(table(spark, d, "conversations"), max_tokens=250, keep=4).select(
        "conv_id", "turn", "pruned"
    )


@query("ctx3_token_use", """
SELECT conv_id, turn, (sum(ceil(length(text) / 4.0)) OVER w)::BIGINT AS used,
  (sum(ceil(length(text) / 4.0)) OVER w) > 200 AS warn
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def ctx3(spark, d):
    return C.token_use(table(spark, d, "conversations"), warn_above=200).select(
        "conv_id", "turn", "used", "warn"
    )


@query("ctx4_chat_prompt", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id, '<|im_start|>system' || chr(10) || 'Be brief.' || '<|im_end|>' || chr(10) ||
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) ||
  '<|im_start|>user' || chr(10) || 'Why ' || conv_id || '?' || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt
FROM r WHERE n <= 4 GROUP BY conv_id""")
def ctx4(spark, d):
    return C.chat_prompt(
        table(spark, d, "conversations"), F.lit("Be brief."), F.concat(F.lit("Why "), "conv_id", F.lit("?"))
    )


@query("ctx5_context_text", f"""
WITH {CTX} SELECT query_id, string_agg('## ' || title || chr(10) || CASE WHEN length(content) > 800
   THEN substr(content, 1, 800) || '...' ELSE content END, chr(10) || chr(10) ORDER BY rank) AS context
FROM ctx JOIN pf USING (doc_id) WHERE rank <= 3 GROUP BY query_id""")
def ctx5(spark, d):
    pages = page_fields(spark, d).select("doc_id", "title", "content")
    return C.context_text(context_rows(spark, d).join(pages, "doc_id"))
