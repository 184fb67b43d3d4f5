"""Labels by keyword dictionary and project or page types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import fixed
from corpusloom.functions import text as T
from corpusloom.functions.arrays import bind
from corpusloom.operators.matching import phrase_hits
from corpusloom.session import is_small

DICTIONARY_ROWS = 500


def default_dictionary(spark: SparkSession) -> DataFrame:
    """Dictionary built by rule: each category is recognised by the words of its own name.

    Real dictionaries are a parameter: any table ``category, keyword, ord``.
    """
    rows = [
        (c, w, i)
        for i, c in enumerate(fixed.LABEL_CATEGORIES)
        if c != "unknown"
        for w in c.split("-")
    ]
    return spark.createDataFrame(rows, "category string, keyword string, ord int")


def label_domains(chunks: DataFrame, dictionary: DataFrame, key: str = "doc_id", most: int = 3,
                  whole_word: bool = False) -> DataFrame:
    """``key, labels``: up to ``most`` labels with confidence, source and matched keywords.

    ``chunks(key, name, documentation, decorators, content)``, ``dictionary(category, keyword,
    ord)``; ``ord`` orders the keywords of a category. A keyword found in the name counts 3,
    in the documentation 2, else 1; ten points are full confidence.

    A checked, bounded dictionary becomes a constant of the expression, so labelling is one
    pass without shuffle. A larger one is matched by joins.
    """
    parts = chunks.select(
        key,
        F.lower(F.coalesce("name", F.lit(""))).alias("_name"),
        F.lower(F.coalesce("documentation", F.lit(""))).alias("_doc"),
        F.lower(
            F.concat_ws(
                " ", F.coalesce("name", F.lit("")), F.coalesce("documentation", F.lit("")),
                F.coalesce(F.array_join("decorators", " "), F.lit("")), "content",
            )
        ).alias("_all"),
    )
    if is_small(dictionary, DICTIONARY_ROWS):
        return _label_by_constant(parts, dictionary, key, most, whole_word)
    return _label_by_join(parts, dictionary, key, most, whole_word)


def _label(category: Column, score: Column, first_place: Column, keywords: Column) -> Column:
    return F.struct(
        category.alias("category"),
        F.least(score / F.lit(10.0), F.lit(1.0)).alias("confidence"),
        first_place.alias("source"),
        keywords.alias("keywords"),
    )


def _best(labels: Column, most: int) -> Column:
    ranked = F.array_sort(
        F.transform(labels, lambda x: F.struct((-x["confidence"]).alias("n"), x["category"].alias("c"), x.alias("x")))
    )
    return F.transform(F.slice(ranked, 1, most), lambda r: r["x"])


def _label_by_constant(parts: DataFrame, dictionary: DataFrame, key: str, most: int,
                       whole_word: bool) -> DataFrame:
    by_category: dict[str, list[str]] = {}
    for row in dictionary.orderBy("category", "ord", "keyword").collect():
        by_category.setdefault(row["category"], []).append(row["keyword"])
    constant = F.array(
        *[
            F.struct(F.lit(c).alias("category"), F.array(*[F.lit(w) for w in ws]).alias("words"))
            for c, ws in sorted(by_category.items())
        ]
    )
    texts = F.struct("_name", "_doc", "_all")
    labels = bind(texts, lambda t: _constant_labels(t["_name"], t["_doc"], t["_all"], constant, whole_word))
    return parts.select(key, bind(labels, lambda x: _best(x, most)).alias("labels"))


def _constant_labels(name: Column, doc: Column, everything: Column, constant: Column,
                     whole_word: bool) -> Column:
    """All labels of one chunk; the three texts are bound values, computed once."""

    def found(word: Column) -> Column:
        if not whole_word:
            return F.contains(everything, word)
        return _whole_word(everything, word)

    def place(word: Column) -> Column:
        return (
            F.when(F.contains(name, word), "name")
            .when(F.contains(doc, word), "documentation")
            .otherwise("content")
        )

    def category(entry: Column) -> Column:
        hits = F.filter(entry["words"], found)
        return bind(
            hits,
            lambda ws: F.when(
                F.size(ws) > 0,
                _label(
                    entry["category"],
                    F.aggregate(
                        ws,
                        F.lit(0),
                        lambda s, w: s
                        + F.when(F.contains(name, w), 3).when(F.contains(doc, w), 2).otherwise(1),
                    ),
                    place(F.element_at(ws, 1)),
                    ws,
                ),
            ),
        )

    return F.filter(F.transform(constant, category), lambda x: x.isNotNull())


def _whole_word(text: Column, word: Column) -> Column:
    edge = "(?![A-Za-z0-9_])"
    return F.regexp_like(text, F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), word, F.lit(r"\E" + edge)))


def _label_by_join(parts: DataFrame, dictionary: DataFrame, key: str, most: int,
                   whole_word: bool = False) -> DataFrame:
    words = dictionary.select("category", "keyword", "ord")
    unique = words.select(F.col("keyword")).distinct()

    everywhere = phrase_hits(parts, [key], "_all", unique, ["keyword"], "keyword")
    if whole_word:
        whole = _whole_word(F.col("_all"), F.col("keyword"))
        everywhere = everywhere.join(parts.select(key, "_all"), key).where(whole).drop("_all")
    # the texts are searched once: what the name or the documentation has, the whole has too
    rows = (
        everywhere.join(parts.select(key, "_name", "_doc"), key)
        .groupBy(key, "keyword")
        .agg(
            F.bool_or(F.contains("_name", "keyword")).alias("in_name"),
            F.bool_or(F.contains("_doc", "keyword")).alias("in_doc"),
        )
        .join(words, "keyword")
    )
    place = (
        F.when(F.col("in_name"), "name").when(F.col("in_doc"), "documentation").otherwise("content")
    )
    points = F.when(F.col("in_name"), 3).when(F.col("in_doc"), 2).otherwise(1)
    labels = rows.groupBy(key, "category").agg(
        F.sum(points).alias("score"),
        F.array_sort(F.collect_list(F.struct("ord", "keyword", place.alias("place")))).alias("k"),
    )
    label = _label(
        F.col("category"), F.col("score"), F.element_at("k", 1)["place"],
        F.transform("k", lambda x: x["keyword"]),
    )
    best = labels.groupBy(key).agg(F.collect_list(label).alias("l")).select(
        key, _best(F.col("l"), most).alias("labels")
    )
    return parts.select(key).join(best, key, "left").select(
        key, F.coalesce("labels", F.slice("labels", 1, 0), F.array().cast(best.schema["labels"].dataType)).alias("labels")
    )


def confident_categories(labels: Column | str, threshold: float = fixed.RELEVANCE_THRESHOLD) -> Column:
    """Category names of the labels above the threshold."""
    return F.transform(
        F.filter(T._col(labels), lambda x: x["confidence"] > threshold), lambda x: x["category"]
    )


# --- project and page types -------------------------------------------------------------------
def extension_project_type(ext: Column | str) -> Column:
    return T.lookup(fixed.EXTENSION_PROJECT_TYPES, ext, "Software")


def dominant_extension(inventory: DataFrame) -> DataFrame:
    """One row: most frequent extension, its count and the project type it stands for."""
    counts = inventory.groupBy("ext").agg(F.count("*").alias("n"))
    top = counts.agg(F.min(F.struct((-F.col("n")).alias("neg"), "ext")).alias("t"))
    return top.select(
        F.col("t.ext").alias("ext"), (-F.col("t.neg")).alias("n"),
        extension_project_type("t.ext").alias("project_type"),
    )


def manifest_project_type(files: DataFrame, corpus: str = "corpus_id") -> DataFrame:
    """Project type per corpus from its manifest files at the root: type, framework, language.

    Only manifest rows take part; each corpus is reduced with partial aggregates.
    """
    # Marker files and what they stand for.
    markers = {"Cargo.toml": ("Rust project", "Rust"), "go.mod": ("Go project", "Go"),
               "requirements.txt": ("Python project", "Python"), "pyproject.toml": ("Python project", "Python")}
    names = ["package.json", *markers]
    path = F.col("path")
    seen = (
        files.select(corpus, F.when(path.isin(names), path).alias("path"),
                     F.when(path == "package.json", F.col("content")).alias("manifest"))
        .groupBy(corpus)
        .agg(
            F.max("manifest").alias("m"),
            *[F.max((F.col("path") == n).cast("int")).alias(f"has_{i}") for i, n in enumerate(markers)],
        )
    )
    m = F.col("m")
    valid = F.get_json_object(m, "$").isNotNull()

    def has(key: str) -> Column:
        return F.coalesce(
            F.get_json_object(m, f"$.devDependencies['{key}']"),
            F.get_json_object(m, f"$.dependencies['{key}']"),
            F.lit(""),
        ) != ""

    kind = framework = None
    for key, label, name in fixed.MANIFEST_FRAMEWORKS:
        hit = valid & has(key)
        kind = F.when(hit, label) if kind is None else kind.when(hit, label)
        framework = F.when(hit, name) if framework is None else framework.when(hit, name)
    binary = F.coalesce(F.get_json_object(m, "$.bin"), F.lit("")) != ""
    kind = kind.when(valid & binary, "CLI tool").when(valid, "Node.js project")
    lang = F.when(valid, "TypeScript")
    for i, (label, name) in enumerate(markers.values()):
        kind = kind.when(F.col(f"has_{i}") == 1, label)
        lang = lang.when(F.col(f"has_{i}") == 1, name)
    return seen.select(
        corpus, kind.otherwise("software project").alias("type"), framework.alias("framework"),
        lang.otherwise("unknown").alias("language"),
    )


def page_type(dirs: DataFrame, directory: str = "dir", files: str = "files") -> DataFrame:
    """Page of a directory: known names by a fixed map, else a module from five files on."""
    d = F.col(directory)
    low = F.lower(d)
    kinds = {k: v[0] for k, v in fixed.DIRECTORY_PAGE_TYPES.items()}
    prefixes = {k: v[1] for k, v in fixed.DIRECTORY_PAGE_TYPES.items()}
    title = T.name_title(d)
    known = T.lookup(kinds, low, None)
    rows = dirs.where(~low.isin(fixed.SKIPPED_PAGE_DIRS)).where(known.isNotNull() | (F.col(files) >= 5))
    return rows.select(
        "*",
        title.alias("title"),
        F.when(known.isNotNull(), F.concat(low, F.lit(".md")))
        .otherwise(F.concat(F.regexp_replace(low, "[^a-z0-9]", "-"), F.lit(".md")))
        .alias("filename"),
        F.coalesce(known, F.lit("module")).alias("type"),
        F.when(
            known.isNotNull(),
            F.concat(T.lookup(prefixes, low, None), F.lit(" in the "), title, F.lit(" directory")),
        )
        .otherwise(F.concat(F.lit("The "), title, F.lit(" module and its functionality")))
        .alias("context"),
    )


def normalize_page_type(kind: Column | str) -> Column:
    k = F.lower(T._col(kind))
    return (
        F.when(k == "overview", "overview")
        .when(k.isin("component", "components"), "component")
        .when(k.isin("api", "endpoint", "routes"), "api")
        .when(k.isin("guide", "tutorial", "getting-started"), "guide")
        .when(k.isin("config", "configuration"), "config")
        .otherwise("module")
    )
