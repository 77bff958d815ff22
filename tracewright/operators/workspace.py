"""Import and call graphs of workspaces, as joins over edge lists; file ranking, budgets and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import scratch

ENTRYPOINTS = ("index.js", "main.js", "app.js", "main.py", "app.py", "__main__.py", "program.cs", "index.ts")
MANIFESTS = ("package.json", "requirements.txt", "pyproject.toml", "setup.py")
FOLDERS = ("src", "app", "apps", "bin", "cli", "cmd", "packages", "server")


def imports(files: DataFrame) -> DataFrame:
    """(sample_id, source, target): modules that Python files import and paths that JavaScript files require."""
    py = F.regexp_extract_all("text", F.lit(r"(?m)^(?:from|import)\s+([\w.]+)"), F.lit(1))
    js = F.regexp_extract_all("text", F.lit(r"""(?:require\s*\(\s*|from\s+|import\s+)['"]([^'"]+)['"]"""), F.lit(1))
    return files.select("sample_id", F.col("path").alias("source"), F.explode(F.array_distinct(F.concat(py, js))).alias("target"))


def resolved(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with the file they mean: a Python module's file, an exact path, an extension or index file added, or else the one
    file whose path ends with the target; null if none or several do."""
    as_path = F.regexp_replace("target", r"\.", "/")
    tries = F.array(F.concat(as_path, F.lit(".py")), F.concat(as_path, F.lit("/__init__.py")), F.col("target"), F.concat("target", F.lit(".js")), F.concat("target", F.lit("/index.js")))
    posed = edges.select("sample_id", "source", "target", F.posexplode(tries).alias("pos", "path"))
    exact = posed.join(files.select("sample_id", "path"), ["sample_id", "path"]).groupBy("sample_id", "source", "target").agg(F.min_by("path", "pos").alias("exact"))
    # Every suffix of a path is a key, so "ends with" is an equi-join.
    parts = F.split("path", "/")
    suffixes = files.select("sample_id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))
    unique = suffixes.groupBy("sample_id", "suffix").agg(F.min("path").alias("by_suffix"), F.count("*").alias("n")).where("n = 1").drop("n")
    wanted = edges.withColumn("suffix", F.concat(as_path, F.lit(".py")))
    return wanted.join(exact, ["sample_id", "source", "target"], "left").join(unique, ["sample_id", "suffix"], "left").select("sample_id", "source", "target", F.coalesce("exact", "by_suffix").alias("resolved"))


def degrees(edges: DataFrame) -> DataFrame:
    """(sample_id, path, inbound, outbound) over distinct resolved edges."""
    one = edges.where("resolved is not null").select("sample_id", "source", "resolved").distinct()
    out = one.groupBy("sample_id", F.col("source").alias("path")).agg(F.lit(0).alias("i"), F.count("*").alias("o"))
    into = one.groupBy("sample_id", F.col("resolved").alias("path")).agg(F.count("*").alias("i"), F.lit(0).alias("o"))
    return out.unionByName(into).groupBy("sample_id", "path").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound"))


def reachable(edges: DataFrame, start: DataFrame, depth: int = 4) -> DataFrame:
    """(sample_id, path, depth): files reached from the start files in at most `depth` steps, at their least depth."""
    step = edges.where("resolved is not null").select("sample_id", F.col("source").alias("path"), F.col("resolved").alias("to")).distinct()
    step = scratch.written(step)
    seen = front = start.select("sample_id", "path").distinct().withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        found = front.join(step, ["sample_id", "path"]).select("sample_id", F.col("to").alias("path")).distinct()
        front = found.join(seen.select("sample_id", "path"), ["sample_id", "path"], "left_anti").withColumn("depth", F.lit(d))
        front = scratch.written(front)
        seen = seen.unionByName(front)
    return seen


def file_scores(files: DataFrame) -> DataFrame:
    """(sample_id, path, score, tags): how much a file deserves a place in a bundle."""
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    parts = F.split(F.lower("path"), "/")
    longest = F.coalesce(F.array_max(F.transform(T.lines(F.substring("text", 1, 20_000)), F.length)), F.lit(0))
    points = lambda test, n: F.when(test, n).otherwise(0.0)
    score = points(base.isin(*ENTRYPOINTS), 6.0) + points(base.isin(*MANIFESTS), 3.5) + F.when(base.endswith(".bundle.js"), 2.5).when(base.endswith(".min.js"), 2.0).otherwise(0.0)
    score = score + points(F.size(parts) <= 2, 1.0) + points(F.arrays_overlap(parts, F.array(*map(F.lit, FOLDERS))), 1.0) + points(longest > 500, 1.5)
    tags = F.array_compact(F.array(F.when(base.isin(*ENTRYPOINTS), "entrypoint"), F.when(base.isin(*MANIFESTS), "manifest"), F.when(base.endswith(".bundle.js"), "bundle"), F.when(base.endswith(".min.js"), "minified"), F.when(longest > 500, "suspicious")))
    return files.select("sample_id", "path", score.alias("score"), tags.alias("tags"), F.octet_length("text").alias("size"))


def best_files(scores: DataFrame, most: int) -> DataFrame:
    """The `most` files of each sample by score, then smaller size, then path."""
    w = Window.partitionBy("sample_id").orderBy(F.desc("score"), "size", "path")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def within_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """Files in rank order that fit the budget: one that overflows is skipped, later ones are still tried."""
    ordered = ranked.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "size"))).alias("files"))

    def step(acc, f):
        fits = acc["used"] + f["size"] <= budget
        return F.struct((acc["used"] + F.when(fits, f["size"]).otherwise(0)).cast("long").alias("used"), F.when(fits, F.concat(acc["kept"], F.array(f["path"]))).otherwise(acc["kept"]).alias("kept"))

    start = F.coalesce(F.lit(None).cast("struct<used:bigint,kept:array<string>>"), F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("kept")))
    return ordered.select("sample_id", F.explode(F.aggregate("files", start, step)["kept"]).alias("path"))


def overlay(base: DataFrame, top: DataFrame) -> DataFrame:
    """Files of both by path; where both have one, the top's text."""
    b, t = base.select("sample_id", "path", F.col("text").alias("old")), top.select("sample_id", "path", F.col("text").alias("new"))
    return b.join(t, ["sample_id", "path"], "full").select("sample_id", "path", F.coalesce("new", "old").alias("text"), F.col("new").isNotNull().alias("replaced"))


def call_counts(files: DataFrame) -> DataFrame:
    """(sample_id, path, name, calls)."""
    names = F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1))
    return files.select("sample_id", "path", F.explode(names).alias("name")).groupBy("sample_id", "path", "name").agg(F.count("*").alias("calls"))


def ratio(a, b):
    """a / b to four places; null where b isn't positive."""
    return F.when(b > 0, F.round(a / b, 4))
