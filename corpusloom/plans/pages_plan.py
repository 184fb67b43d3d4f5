"""Page plans: which pages to write for a repository and from which files.

A plan is two tables: pages (ordered, at most a few dozen rows) and page files in long form.
Ranks are bounded before any global order is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import fixed
from corpusloom.functions import text as T
from corpusloom.operators.classify import page_type
from corpusloom.operators.matching import phrase_hits
from corpusloom.plans import profile as P

PLAN_COLUMNS = ["place", "ord", "title", "filename", "type", "context"]


# --- set steps -------------------------------------------------------------------------
def uncovered_files(files: DataFrame, covered: DataFrame) -> DataFrame:
    return files.join(covered.select("path").distinct(), "path", "left_anti")


def existing_files(planned: DataFrame, files: DataFrame) -> DataFrame:
    return planned.join(files.select("path").distinct(), "path", "left_semi")


def first_by_filename(pages: DataFrame) -> DataFrame:
    """Keep the first page spec of every file name, in plan order."""
    cols = [c for c in pages.columns if c != "filename"]
    first = pages.groupBy("filename").agg(F.min(F.struct("place", "ord", *[c for c in cols if c not in ("place", "ord")])).alias("p"))
    return first.select(*[F.col("filename") if c == "filename" else F.col(f"p.{c}").alias(c) for c in pages.columns])


def _ranked(rows: DataFrame, order: list[Column], most: int, name: str = "ord") -> DataFrame:
    """First ``most`` rows in order, numbered; the limit comes first, so few rows are numbered."""
    few = rows.orderBy(*order).limit(most)
    return few.withColumn(name, F.row_number().over(Window.orderBy(*order)))


# --- coverage plan ------------------------------------------------------------------------
def coverage_plan(files: DataFrame, pages: DataFrame, covered: DataFrame, min_pages: int,
                  project_type: str) -> DataFrame:
    """Pages for files no page covers: by directory (two files or more, largest first), then by
    extension (three or more), until there are ``min_pages`` with the given ones.

    ``files(path)``, ``pages(title)``, ``covered(path)``. ``key`` is the directory or extension.
    """
    have = pages.agg(F.count("*").alias("n")).select("n").scalar()
    taken = pages.select(F.lower("title").alias("low")).distinct()
    open_ = uncovered_files(files.select("path"), covered).select(
        "path", T.dir_name("path").alias("dir"), T.extension("path").alias("ext")
    )
    by_dir = (
        open_.groupBy(F.when(F.col("dir") == ".", "root").otherwise(F.col("dir")).alias("key"))
        .agg(F.count("*").alias("n"), F.min("path").alias("first"))
        .where("n >= 2")
        .select(F.lit(1).alias("place"), "key", "n", "first", T.directory_title("key").alias("title"),
                F.concat(F.lit("Source files in "), "key", F.lit(f" - part of {project_type}")).alias("context"))
    )
    title = T.lookup(
        fixed.COVERAGE_EXTENSION_TITLES, "key",
        F.concat(F.upper(F.regexp_replace("key", r"\.", "")), F.lit(" Files")),
    )
    by_ext = (
        open_.groupBy(F.col("ext").alias("key"))
        .agg(F.count("*").alias("n"), F.min("path").alias("first"))
        .where("n >= 3")
        .select(F.lit(2).alias("place"), "key", "n", "first", title.alias("title"),
                F.concat("n", F.lit(" "), "key", F.lit(" files in the project")).alias("context"))
    )
    order = [
        F.col("place"), F.when(F.col("place") == 1, -F.col("n")).otherwise(0),
        F.when(F.col("place") == 1, F.col("key")).otherwise(F.col("first")),
    ]
    rows = by_dir.unionByName(by_ext).withColumn("low", F.lower("title")).join(taken, "low", "left_anti")
    once = Window.partitionBy("low").orderBy(*order)
    rows = rows.withColumn("_r", F.row_number().over(once)).where("_r = 1")
    return _ranked(rows, order, min_pages).where(F.col("ord") <= min_pages - have).select(
        "place", "ord", "title", F.concat(T.file_slug("title"), F.lit(".md")).alias("filename"),
        F.lit("module").alias("type"), "context", "key",
    )


def coverage_plan_files(files: DataFrame, covered: DataFrame, plan: DataFrame) -> DataFrame:
    """``filename, pos, path``: the first ten uncovered files of each page of ``coverage_plan``."""
    open_ = uncovered_files(files.select("path"), covered)
    folder = T.dir_name("path")
    keys = F.array(
        F.struct(F.lit(1).alias("place"), F.when(folder == ".", "root").otherwise(folder).alias("key")),
        F.struct(F.lit(2).alias("place"), T.extension("path").alias("key")),
    )
    rows = open_.select("path", F.explode(keys).alias("page"))
    pages = plan.select(F.struct("place", "key").alias("page"), "filename")
    return P.first_files(rows, "page", fixed.PLANNED_PAGE_FILES).join(pages, "page").select("filename", "pos", "path")


# --- comprehensive plan ----------------------------------------------------------------------
def comprehensive_plan(files: DataFrame, min_pages: int, project_type: Column) -> DataFrame:
    """Overview, top directories, extensions and getting started, about ``min_pages`` in all."""
    rows = files.select(
        "path", F.substring_index("path", "/", 1).alias("top"), T.extension("path").alias("ext")
    )
    dirs = (
        rows.where(~F.col("top").isin("node_modules", ".git", "dist", "build"))
        .groupBy(F.col("top").alias("key"))
        .agg(F.count("*").alias("n"), F.min("path").alias("first"))
        .where("n >= 2")
        .select(F.lit(1).alias("place"), "key", "n", "first", T.directory_title("key").alias("title"),
                F.concat(T.file_slug("key"), F.lit(".md")).alias("filename"),
                F.concat(F.lit("Files in the "), "key", F.lit(" directory")).alias("context"))
    )
    title = T.lookup(
        fixed.PLAN_EXTENSION_TITLES, "key",
        F.concat(F.upper(F.regexp_replace("key", r"\.", "")), F.lit(" Files")),
    )
    exts = (
        rows.groupBy(F.col("ext").alias("key"))
        .agg(F.count("*").alias("n"), F.min("path").alias("first"))
        .where("n >= 3")
        .select(F.lit(2).alias("place"), "key", "n", "first", title.alias("title"),
                F.concat(T.file_slug(title), F.lit(".md")).alias("filename"),
                F.concat("n", F.lit(" "), "key", F.lit(" files in the project")).alias("context"))
    )
    order = [
        F.col("place"), F.when(F.col("place") == 1, -F.col("n")).otherwise(0),
        F.when(F.col("place") == 1, F.col("key")).otherwise(F.col("first")),
    ]
    once = Window.partitionBy("title").orderBy(*order)
    middle = dirs.unionByName(exts)
    middle = middle.withColumn("_r", F.row_number().over(once)).where("place = 1 OR _r = 1")
    middle = _ranked(middle, order, max(min_pages - 2, 0)).select(*PLAN_COLUMNS[:4], F.lit("module").alias("type"), "context", "key")
    ends = files.agg(F.count("*").alias("_n")).select(
        F.inline(
            F.array(
                F.struct(
                    F.lit(0).alias("place"), F.lit(0).alias("ord"), F.lit("Architecture Overview").alias("title"),
                    F.lit("architecture.md").alias("filename"), F.lit("overview").alias("type"),
                    F.concat(F.lit("High-level architecture of this "), project_type, F.lit(" project")).alias("context"),
                    F.lit(None).cast("string").alias("key"),
                ),
                F.struct(
                    F.lit(3).alias("place"), F.lit(0).alias("ord"), F.lit("Getting Started").alias("title"),
                    F.lit("getting-started.md").alias("filename"), F.lit("guide").alias("type"),
                    F.lit("Setup and development workflow").alias("context"),
                    F.lit(None).cast("string").alias("key"),
                ),
            )
        )
    )
    return ends.unionByName(middle)


def comprehensive_plan_files(files: DataFrame, plan: DataFrame) -> DataFrame:
    """``filename, path``: ten files per page; every setup file for getting started."""
    rows = files.select("path", F.substring_index("path", "/", 1).alias("top"), T.extension("path").alias("ext"))
    named = plan.where("key IS NOT NULL").select("place", "key", "filename")
    per_dir = P.first_files(rows, "top", 10).withColumnRenamed("top", "key").withColumn("place", F.lit(1))
    per_ext = P.first_files(rows, "ext", 10).withColumnRenamed("ext", "key").withColumn("place", F.lit(2))
    chosen = per_dir.unionByName(per_ext).join(named, ["place", "key"]).select("filename", "path")
    overview = files.where(T.is_entry_point("path")).select("path").orderBy("path").limit(10)
    setup = files.where(F.lower("path").contains("readme") | F.col("path").contains("package.json"))
    return chosen.unionByName(overview.select(F.lit("architecture.md").alias("filename"), "path")).unionByName(
        setup.select(F.lit("getting-started.md").alias("filename"), "path")
    )


# --- pattern plan --------------------------------------------------------------------------------
def bucket_files(files: DataFrame) -> DataFrame:
    """``bucket, path``: the page buckets a file belongs to, one pass over the files."""
    rules = F.array(
        *[
            F.struct(F.lit(i).alias("bucket"), F.col("path").rlike(b[3]).alias("hit"))
            for i, b in enumerate(fixed.PAGE_BUCKETS)
        ]
    )
    return files.select("path", F.inline(F.filter(rules, lambda r: r["hit"]))).select("bucket", "path")


def pattern_plan(files: DataFrame, project_type: str = "software project") -> DataFrame:
    """Overview, significant directories, pattern buckets, key files, getting started.

    ``files(path)`` are source files. Thresholds are lower under 50 files. The first spec of
    a file name is kept.
    """
    total = files.agg(F.count("*").alias("n")).select("n").scalar()
    dirs = page_type(P.directory_structure(files).where("files >= 2"))
    dirs = dirs.select(
        F.lit(1).alias("place"), F.col("first_path").alias("ord"), "title", "filename", "type", "context"
    )
    specs = F.array(
        *[
            F.struct(
                F.lit(i).alias("bucket"), F.lit(b[0]).alias("title"), F.lit(b[1]).alias("filename"),
                F.lit(b[2]).alias("type"), F.lit(b[4]).alias("least"), F.lit(b[5]).alias("least_small"),
                F.lit(b[7]).alias("context"),
            )
            for i, b in enumerate(fixed.PAGE_BUCKETS)
        ]
    )
    counted = bucket_files(files).groupBy("bucket").agg(F.count("*").alias("n"))
    buckets = counted.withColumn("s", F.element_at(specs, F.col("bucket") + 1)).where(
        F.col("n") >= F.when(total < 50, F.col("s.least_small")).otherwise(F.col("s.least"))
    )
    component_dirs = dirs.agg(F.count_if(F.col("title").contains("Component")).alias("n")).select("n").scalar()
    buckets = buckets.where((F.col("bucket") != 0) | (component_dirs == 0)).select(
        F.when(F.col("s.filename") == "configuration.md", 4).otherwise(2).alias("place"),
        F.lpad(F.col("bucket").cast("string"), 2, "0").alias("ord"),
        F.col("s.title").alias("title"), F.col("s.filename").alias("filename"), F.col("s.type").alias("type"),
        F.col("s.context").alias("context"),
    )
    base = F.lower(T.base_name("path"))
    key_files = files.where(
        base.isin("app.tsx", "app.ts", "main.tsx", "main.ts") | base.rlike("router|provider|context")
    ).select("path").orderBy("path").limit(3)
    key_files = key_files.where((total < 50) & (total > 5)).select(
        F.lit(3).alias("place"), F.col("path").alias("ord"),
        F.concat(T.name_title(T.stem("path")), F.lit(" (Core)")).alias("title"),
        F.concat(F.lower(T.stem("path")), F.lit(".md")).alias("filename"), F.lit("module").alias("type"),
        F.concat(F.lit("Core application file: "), "path", F.lit(fixed.CORE_FILE_CONTEXT)).alias("context"),
    )
    ends = files.agg(F.count("*").alias("_n")).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(p).alias("place"), F.lit("").alias("ord"), F.lit(t).alias("title"),
                        F.lit(f).alias("filename"), F.lit(k).alias("type"), F.lit(c).alias("context"),
                    )
                    for p, t, f, k, c in [
                        (0, "Architecture Overview", "architecture.md", "overview",
                         fixed.OVERVIEW_CONTEXT.format(project_type)),
                        (5, "Getting Started", "getting-started.md", "guide", fixed.GETTING_STARTED_CONTEXT),
                    ]
                ]
            )
        )
    )
    return first_by_filename(
        ends.unionByName(dirs).unionByName(buckets).unionByName(key_files).select(*PLAN_COLUMNS)
    )


def pattern_plan_files(files: DataFrame, plan: DataFrame) -> DataFrame:
    """``filename, path`` of the pages of ``pattern_plan(files)``: the first files where a page lists only some."""

    def planned(*places: int) -> DataFrame:
        return plan.where(F.col("place").isin(*places)).select("filename", "ord")

    dir_of = files.select("path", P.meaningful_dir().alias("dir")).where("dir IS NOT NULL")
    first = P.directory_structure(files).select("dir", F.col("first_path").alias("ord"))
    dirs = P.first_files(dir_of, "dir", fixed.DIRECTORY_PAGE_FILES).join(
        planned(1).join(first, "ord").select("dir", "filename"), "dir"
    )
    names = F.array(*[F.lit(b[1]) for b in fixed.PAGE_BUCKETS])
    caps = F.array(*[F.lit(b[6]).cast("int") for b in fixed.PAGE_BUCKETS])
    rows = bucket_files(files).select(
        "bucket", "path", F.get(names, F.col("bucket")).alias("filename"), F.get(caps, F.col("bucket")).alias("cap")
    )
    rows = rows.join(planned(2, 4).select("filename"), "filename", "left_semi")
    few = rows.where("cap IS NOT NULL").withColumn(
        "pos", F.row_number().over(Window.partitionBy("bucket").orderBy("path"))
    )
    few = few.where((F.col("pos") <= max(b[6] or 0 for b in fixed.PAGE_BUCKETS)) & (F.col("pos") <= F.col("cap")))
    setup = files.where(F.col("path").rlike(fixed.SETUP_FILE_PATTERN)).select("path")
    start = setup.union(P.entry_points(files, 5).select("path")).withColumn("filename", F.lit("getting-started.md"))
    overview = P.entry_points(files).select("path").withColumn("filename", F.lit("architecture.md"))
    parts = [
        dirs, rows.where("cap IS NULL"), few, planned(3).withColumnRenamed("ord", "path"),
        start.join(planned(5), "filename", "left_semi"), overview,
    ]
    out = parts[0].select("filename", "path")
    for part in parts[1:]:
        out = out.unionByName(part.select("filename", "path"))
    return out


def candidate_files(missing: DataFrame, files: DataFrame, most: int = 10) -> DataFrame:
    """First ``most`` files whose path contains the name of a missing page, ignoring case."""
    names = missing.select("page", F.lower("page").alias("name"))
    hits = phrase_hits(files.select("path"), ["path"], F.lower("path"), names, ["page"], "name")
    return P.first_files(hits, "page", most)
