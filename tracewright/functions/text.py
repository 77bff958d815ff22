"""Scores and rewrites of a text as Column expressions: no shuffle, no Python on the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda variable, where Spark would repeat the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(text: Column) -> Column:
    """The lines of a text; a final line break opens no further line."""
    parts = F.split(text, BREAKS, -1)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def entropy(text: Column) -> Column:
    """Shannon entropy over code points in bits; an empty text has 0."""
    def of(t):
        def counted(n):
            kinds = F.transform(F.array_distinct(F.split(t, "")), lambda c: n - F.length(F.replace(t, c)))
            weighed = F.aggregate(kinds, F.lit(0.0), lambda acc, c: acc + c * F.log2(F.greatest(c, F.lit(1)).cast("double")))
            return F.when(n > 0, F.abs(F.log2(n.cast("double")) - weighed / n)).otherwise(0.0)

        return let(F.length(t), counted)

    return let(text, of)


def windows(text: Column) -> Column:
    """Windows of 256 code points at steps of 128 as (start, end); a rest of 128 or more counts, a short text is one window."""
    n = F.length(text)
    last = F.floor((n - fixed.WINDOW) / fixed.STEP)
    full = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * fixed.STEP).cast("int").alias("start"), (i * fixed.STEP + fixed.WINDOW).cast("int").alias("end")))
    after = ((last + 1) * fixed.STEP).cast("int")
    rest = F.when(n - after >= fixed.STEP, F.array(F.struct(after.alias("start"), n.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))
    return F.when(n <= fixed.WINDOW, whole).otherwise(F.concat(full, rest))


def readability(text: Column) -> Column:
    """The loop's readability, 0 to 1: letters and digits, line length, comments, identifier length, non-blank lines."""
    t = F.substring(text, 1, 200_000)
    rows = lines(t)
    n_lines = F.greatest(F.size(rows), F.lit(1))
    n = F.greatest(F.length(t), F.lit(1))
    plain = F.length(F.regexp_replace(t, r"[^\p{L}\p{N} _\n\t]", "")) / n
    mean = n / n_lines
    line = F.when(mean < 5, 0.2).when(mean <= 100, 1.0).when(mean <= 300, 0.5).otherwise(0.1)
    bare = lambda x: F.regexp_replace(x, r"^\s+", "")
    noted = F.size(F.filter(rows, lambda x: reduce(lambda a, b: a | b, [bare(x).startswith(m) for m in fixed.COMMENT_STARTS])))
    comment = F.least(noted / n_lines, F.lit(0.3)) / 0.3
    names = F.regexp_extract_all(t, F.lit(r"(?:^|[^\p{L}\p{N}_])([a-zA-Z_][\p{L}\p{N}_]*)"), F.lit(1))
    ident = F.when(F.size(names) > 0, F.least(F.length(F.array_join(names, "")) / F.size(names) / 8.0, F.lit(1.0))).otherwise(0.3)
    filled = F.size(F.filter(rows, lambda x: F.length(bare(x)) > 0)) / n_lines
    score = 0.25 * plain + 0.20 * line + 0.15 * comment + 0.25 * ident + 0.15 * filled
    return F.when(F.length(F.regexp_replace(t, r"\s", "")) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def minified(text: Column, language: Column) -> Column:
    """Minification score, 0 to 1, from nine additive cues; 0.45 and more is likely minified."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    rows = F.filter(lines(t), lambda x: F.length(F.regexp_replace(x, r"\s", "")) > 0)
    n_lines, n = F.greatest(F.size(rows), F.lit(1)), F.length(t)
    mean = n / n_lines
    longest = F.coalesce(F.array_max(F.transform(rows, F.length)), F.lit(0))
    semi = occurrences(t, ";") / n_lines
    blank = occurrences(t, r"\s") / F.greatest(n, F.lit(1))
    indent = F.size(F.filter(rows, lambda x: x.rlike(r"^\s"))) / n_lines
    punct = occurrences(t, r"[{}\[\]();,:]") / F.greatest(n, F.lit(1))
    js, py = language.isin(*fixed.JS), language.isin(*fixed.PY)
    cue = lambda test, value: F.when(test, value).otherwise(0.0)
    score = (
        cue((n >= 180) & (n_lines <= 3), F.lit(0.22)) + cue(mean >= 180, F.least(F.lit(0.25), (mean - 180) / 1200 + 0.08))
        + cue(longest >= 420, F.least(F.lit(0.2), (longest - 420) / 2000 + 0.08)) + cue(semi >= 4, F.least(F.lit(0.16), semi / 40))
        + cue((punct >= 0.16) & (blank <= 0.18), F.lit(0.14)) + cue((indent <= 0.08) & (mean >= 120), F.lit(0.08)) + cue(js & (semi >= 4), F.lit(0.06))
        + cue(py & (n_lines <= 4) & (semi >= 1.5), F.lit(0.18)) + cue(py & (mean >= 120) & (indent <= 0.05), F.lit(0.12))
    )
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), score))


def residual(text: Column, language: Column) -> Column:
    """struct(score, critical, has_residual): what decode and run-time wrappers remain in the first 20,000 code points."""
    t = F.substring(text, 1, 20_000)
    lang = F.coalesce(F.trim(F.lower(language)), F.lit(""))
    tests = [((lang.isin(*langs) if langs else F.lit(True)) & t.rlike(p), w) for langs, p, w in fixed.RESIDUAL]
    score = F.round(F.least(reduce(lambda a, b: a + b, [F.when(test, w).otherwise(0.0) for test, w in tests]), F.lit(9.9)), 2)
    critical = reduce(lambda a, b: a | b, [test for test, w in tests if w >= 0.9])
    return F.struct(score.alias("score"), critical.alias("critical"), ((score >= 1.0) | critical).alias("has_residual"))


def language_scores(text: Column) -> Column:
    """array of (score, language) in order of precedence: the sum over patterns of weight times matches, at most 5 each."""
    one = lambda table: reduce(lambda a, b: a + b, [F.least(occurrences(text, p), F.lit(5)) * w for p, w in table])
    return F.array(*[F.struct(one(table).cast("double").alias("score"), F.lit(lang).alias("language")) for lang, table in fixed.LANGUAGES.items()])


def detect_language(text: Column) -> Column:
    """struct(language, confidence): the best score's share; the first language wins a tie; none matches: null and 0.1."""
    def ranked(got):
        def of(top):
            total = F.aggregate(got, F.lit(0.0), lambda a, x: a + x["score"])
            best = F.element_at(F.filter(got, lambda x: x["score"] == top), 1)["language"]
            return F.struct(F.when(total > 0, best).alias("language"), F.when(total > 0, F.least(F.lit(0.99), top / total)).otherwise(0.1).alias("confidence"))

        return let(F.array_max(F.transform(got, lambda x: x["score"])), of)

    return let(language_scores(text), ranked)


def post_process(text: Column) -> Column:
    """Drop a byte order mark and control characters, unify line ends, strip line ends, at most two blank lines, one final line break."""
    t = F.regexp_replace(text, "^﻿", "")
    for pattern, new in ((r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), (r"\r\n|\r", "\n"), (r"[\p{Z}\t]+(?=\n|\z)", ""), (r"\n{4,}", "\n\n\n")):
        t = F.regexp_replace(t, pattern, new)
    t = F.when(t.endswith("\n"), t).otherwise(F.concat(t, F.lit("\n")))
    return F.when(F.length(F.regexp_replace(text, r"\s", "")) == 0, text).otherwise(t)


def refang(text: Column) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), fixed.REFANG, text)


def rot13(text: Column) -> Column:
    a, b = "abcdefghijklmnopqrstuvwxyz", "nopqrstuvwxyzabcdefghijklm"
    return F.translate(text, a + a.upper(), b + b.upper())


def printable_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\p{P}\p{S}\p{Zs}\n\r\t]", "")) / F.greatest(F.length(text), F.lit(1))


def decode_base64(text: Column, layers: int = 8) -> Column:
    """Peel base64 layers while the whole text is base64 of at least 16 characters and decodes to printable UTF-8."""

    def peel(t, _):
        raw = F.try_to_binary(F.translate(t, "-_", "+/"), F.lit("base64"))
        plain = F.try_validate_utf8(raw.cast("string"))
        return F.when(t.rlike(r"^[A-Za-z0-9+/_-]{14,}={0,2}$") & plain.isNotNull() & (printable_share(plain) > 0.75), plain).otherwise(t)

    return F.aggregate(F.sequence(F.lit(1), F.lit(layers)), text, peel)


def decode_hex(text: Column) -> Column:
    """Text of a hexadecimal string (plain, or with \\x before each byte) if 70 % of it is printable; else the text."""
    digits = F.regexp_replace(text, r"\\x", "")
    plain = F.try_validate_utf8(F.unhex(F.when(digits.rlike("^(?:[0-9a-fA-F]{2})+$"), digits)).cast("string"))
    return F.when(plain.isNotNull() & (printable_share(plain) > 0.7), plain).otherwise(text)
