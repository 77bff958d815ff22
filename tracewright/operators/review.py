"""Filters, rankings and comparisons that a reader of results asks for: by key, by text, by severity, before against after."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """The row, or the children, of one key. Null finds nothing."""
    return rows.where(F.col(key) == F.lit(value))


def newest_first(rows: DataFrame, project: str) -> DataFrame:
    """Rows with their place among their project's, the highest sample_id first."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(project).orderBy(F.desc("sample_id"))))


def matching(rows: DataFrame, pattern: str, *columns: str) -> DataFrame:
    """Rows of which one of the columns holds a match, whatever the case. Nulls don't match."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).rlike(f"(?i){pattern}"), F.lit(False))
    return rows.where(found)


def severe(rows: DataFrame, severity: str, column: str, text: str) -> DataFrame:
    """Findings of one severity whose column contains a text, whatever the case."""
    return rows.where((F.col("severity") == severity) & F.contains(F.lower(F.col(column)), F.lit(text.lower())))


_EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


_TOKEN = re.compile(r"\)\{\d+,\}(?=\||$)|\\s[*+]|\\b\\w\+|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?i\)|.", re.S)


def _heads(rest: str) -> list[str | None]:
    """The characters with which matches of the rest begin, as parts of a class; None among them if some aren't told easily."""
    rest = rest.removeprefix(r"\b")
    if not rest.startswith("(?:"):
        head = re.match(r"([A-Za-z0-9_-]|\\[^A-Za-z0-9])(?![?*{])|\[(\w+)\](?![?*]|\{0)", rest)
        return [(head[1] or head[2]).replace("-", r"\-") if head else None]
    parts, depth = [""], 0
    for m in _TOKEN.finditer(rest, 3):
        depth += (m[0] == "(") - (m[0][0] == ")")
        if depth < 0:
            break
        if depth == 0 and m[0] == "|":
            parts.append("")
        else:
            parts[-1] += m[0]
    if m[0] != ")" or rest[m.end() : m.end() + 1] in ("?", "*", "{"):
        return [None]
    return [head for part in parts for head in _heads(part)]


def _first(rest: str) -> str | None:
    """The inside of a class of the characters with which all matches of the rest begin, if that is told easily."""
    heads = _heads(rest)
    return None if None in heads else "".join(dict.fromkeys(heads))


def as_re2(pattern: str) -> str:
    """A pattern for Java that finds something where RE2, the matcher of the SQL, finds something with the given one: words and
    their edges are ASCII (Java counts letters of all scripts at an edge), white space has no \\v, and without case k and s have a
    third form each. What Java finds may be shorter. RE2 takes linear time and no stack; for that, white space is never given back
    (no pattern has more white space behind it), of a word only the end is sought, its last ASCII character and third forms behind
    it, and a group repeated at the end of the pattern or of one of its alternatives, which takes stack with every turn, is
    repeated as often as it must be. A look at the first character spares the trial of all alternatives."""
    fold, depth = pattern.startswith("(?i)"), 0

    def third_forms(x: str) -> str:
        inside = re.compile(x.replace("[^", "[", 1), re.I | re.A)
        return x[:-1] + "".join(more for letter, more in (("k", r"\u212a"), ("s", r"\u017f")) if inside.fullmatch(letter)) + "]"

    bare = pattern.removeprefix("(?i)")
    out = ["(?i)" * fold]
    if len(first := _first(f"(?:{bare})") or "") > 1:
        out.append(f"(?={third_forms(f'[{first}]') if fold else f'[{first}]'})")
    out.append("(?:")
    for m in _TOKEN.finditer(bare):
        x = m[0]
        depth += (x == "(") - (x[0] == ")")
        if x == r"\b" and re.fullmatch("[A-JL-RT-Za-jl-rt-z0-9_]+" if fold else r"\w+", _first(bare[m.end() :]) or "", re.A):
            x = "(?<![A-Za-z0-9_])"
        elif x[0] == ")" and depth == 0:
            x = x.replace(",", "")
        x = {r"\b": _EDGE, r"\s": r"[\t\n\f\r ]", r"\s*": r"[\t\n\f\r ]*+", r"\s+": r"[\t\n\f\r ]++", r"\w": "[A-Za-z0-9_]", r"\b\w+": "[A-Za-z0-9_]" + r"[\u212a\u017f]*" * fold}.get(x, x)
        if fold and len(x) > 1 and x[0] == "[" and x[-1] == "]":
            x = third_forms(x)
        elif fold:
            x = {"k": r"[k\u212a]", "s": r"[s\u017f]"}.get(x.lower(), x)
        out.append(x)
    return "".join(out) + ")"


def techniques(text: Column) -> Column:
    """Names of the generic obfuscation techniques a text shows, in their fixed order. Null shows none."""
    return F.array_compact(F.array(*[F.when(text.rlike(as_re2(p)), F.lit(name)) for name, p in fixed.TECHNIQUES]))


def technique_confidence(n: Column) -> Column:
    """Confidence in a fingerprint of n techniques without a known tool."""
    return F.when(n > 0, F.least(F.lit(0.9), 0.45 + 0.05 * n)).otherwise(0.1)


def nesting(text: Column) -> Column:
    """Greatest depth of brackets; a closing bracket too many doesn't count. Null stays null."""
    step = lambda a, c: F.struct(
        F.greatest(F.lit(0), a["at"] + F.when(c.isin("(", "[", "{"), 1).otherwise(-1)).alias("at"),
        F.greatest(a["top"], a["at"] + F.when(c.isin("(", "[", "{"), 1).otherwise(-1)).alias("top"),
    )
    return F.aggregate(F.regexp_extract_all(text, F.lit(r"([\[\](){}])"), F.lit(1)), F.struct(F.lit(0).alias("at"), F.lit(0).alias("top")), step, lambda a: a["top"])


def changed_names(before: Column, after: Column, pattern: str) -> Column:
    """Names that a rewrite lost and gained, each in the order of their first occurrence."""
    names = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)))
    return F.struct(F.array_except(names(before), names(after)).alias("missing"), F.array_except(names(after), names(before)).alias("added"))


def top(rows: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The k first rows of each group with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= k)


def told_apart(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """Repeated names get a number: name, name_1, name_2."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    return rows.withColumn("n", n).withColumn("unique_name", F.when(F.col("n") > 0, F.concat_ws("_", F.col(name), F.col("n").cast("string"))).otherwise(F.col(name))).drop("n")


def bundle_faults(expected: DataFrame, got: DataFrame) -> DataFrame:
    """(path, fault, n): paths that a returned bundle has twice, lacks, or adds."""
    n = got.groupBy("path").agg(F.count("*").alias("n"))
    want = expected.select("path").distinct()
    twice = n.where("n > 1").select("path", F.lit("duplicate").alias("fault"), "n")
    lost = want.join(n, "path", "left_anti").select("path", F.lit("missing").alias("fault"), F.lit(0).cast("long").alias("n"))
    added = n.join(want, "path", "left_anti").select("path", F.lit("unexpected").alias("fault"), "n")
    return twice.unionByName(lost).unionByName(added)


def manifest(text: Column) -> Column:
    """A map of `key: a | b` lines to their lists; `none` is an empty list, a line without a key is left out."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("^[^:]+:"))
    key = F.transform(lines, lambda x: F.trim(F.substring_index(x, ":", 1)))
    value = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "^[^:]+:", "")))
    split = F.transform(value, lambda v: F.when(F.lower(v) == "none", F.array().cast("array<string>")).otherwise(F.transform(F.split(v, r"\|"), lambda x: F.trim(x))))
    return F.map_from_arrays(key, split)


def readability_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """(sample_id, files, changed, delta): the mean change of files' scores, weighted by length (200 to 20,000), and a bonus of 0.05
    times the share of changed files (0.4 at most) if it is positive. Null if a side lacks a file."""
    both = before.select("sample_id", "path", F.col("score").alias("a"), F.col("text").alias("old")).join(after.select("sample_id", "path", F.col("score").alias("b"), F.col("text").alias("new")), ["sample_id", "path"], "full")
    w = F.least(F.greatest(F.length("new"), F.lit(200)), F.lit(20000))
    got = both.groupBy("sample_id").agg(F.count("*").alias("files"), F.count_if(F.col("old") != F.col("new")).alias("changed"), (F.sum((F.col("b") - F.col("a")) * w) / F.sum(w)).alias("mean"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("lost"))
    bonus = F.when(F.col("mean") > 0, 0.05 * F.least(F.col("changed") / F.col("files"), F.lit(0.4))).otherwise(0.0)
    return got.select("sample_id", "files", "changed", F.when(F.col("lost") == 0, F.round(F.col("mean") + bonus, 6)).alias("delta"))
