"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..operators import decode, extract, history, reports, retrieval, workspace
from ..sources import archives

FLAGSHIP = "annotate"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, d) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), "text", F.col("lang").alias("language"), F.col("source").alias("project_id"))


def pages(spark, d) -> DataFrame:
    return read(spark, d, "pages").select(F.col("page_id").alias("sample_id"), F.col("html").alias("text"), F.lit("javascript").alias("language"), "url")


def iterations(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    w = history.Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("sample_id"), F.row_number().over(w).alias("iteration"), F.col("event_type").alias("action"), F.col("value").alias("score"), (F.pmod("event_id", F.lit(3)) != 0).alias("success"))


ITER = "(SELECT user_id AS sample_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iteration, event_type AS action, value AS score, event_id % 3 <> 0 AS success FROM events)"


def files(spark, d) -> DataFrame:
    """Source files made of parts: each imports two others and calls a function."""
    p = read(spark, d, "part")
    k = F.col("p_partkey")
    path = lambda x: F.concat(F.lit("pkg"), F.pmod(x, F.lit(7)).cast("string"), F.lit("/mod"), x.cast("string"), F.lit(".py"))
    module = lambda x: F.concat(F.lit("pkg"), F.pmod(x, F.lit(7)).cast("string"), F.lit(".mod"), x.cast("string"))
    text = F.concat(F.lit("import "), module(F.floor(k / 2).cast("long")), F.lit("\nfrom "), F.concat(F.lit("mod"), F.floor(k / 3).cast("string")), F.lit(" import run\nrun("), k.cast("string"), F.lit(")\nprint(len(run()))\n"))
    return p.select(F.pmod(k, F.lit(5)).alias("project"), F.lit(1).alias("sample_id"), path(k).alias("path"), text.alias("text"), F.col("p_size").alias("weight"))


FILES = """(SELECT 1 AS sample_id, 'pkg' || (p_partkey % 7) || '/mod' || p_partkey || '.py' AS path, 'import pkg' || ((p_partkey // 2) % 7) || '.mod' || (p_partkey // 2) || chr(10) || 'from mod' || (p_partkey // 3)
  || ' import run' || chr(10) || 'run(' || p_partkey || ')' || chr(10) || 'print(len(run()))' || chr(10) AS text, p_partkey AS k FROM part)"""
EDGES = f"""(WITH f AS {FILES} SELECT path AS source, 'pkg' || ((k // 2) % 7) || '.mod' || (k // 2) AS target, k // 2 AS t FROM f UNION SELECT path, 'mod' || (k // 3), k // 3 FROM f)"""
RESOLVED = f"""(WITH f AS {FILES} SELECT 1 AS sample_id, e.source, e.target, f.path AS resolved FROM {EDGES} e LEFT JOIN f ON f.k = e.t)"""


def resolved(spark, d) -> DataFrame:
    f = files(spark, d)
    return workspace.resolved(workspace.imports(f), f)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- queries -----------------------------------------------------------------------------------------------------------


def annotate(spark, d):
    """Language, readability, entropy and residual markers of every page in one projection."""
    t = F.col("text")
    got = T.detect_language(t)
    return pages(spark, d).select("sample_id", got["language"].alias("language"), F.round(got["confidence"], 6).alias("confidence"), F.round(T.entropy(t), 6).alias("entropy"), T.residual(t, F.col("language"))["score"].alias("residual"))


def _sql_entropy(t: str) -> str:
    return f"(CASE WHEN length({t}) > 0 THEN abs(log2(length({t})) - list_sum(list_transform(list_distinct(string_split({t}, '')), lambda c: (length({t}) - length(replace({t}, c, ''))) * log2(greatest(1, length({t}) - length(replace({t}, c, '')))))) / length({t})) ELSE 0.0 END)"


def _sql_languages(t: str) -> str:
    one = lambda table: " + ".join(f"least(5, len(regexp_extract_all({t}, {q(p)}))) * {w}" for p, w in table)
    return ", ".join(f"{one(table)} AS s_{lang}" for lang, table in fixed.LANGUAGES.items())


def _sql_residual(t: str, lang: str) -> str:
    tests = [f"CASE WHEN regexp_matches(substr({t}, 1, 20000), {q(p)}) THEN {w} ELSE 0 END" for langs, p, w in fixed.RESIDUAL if not langs or lang in langs]
    return f"round(least({' + '.join(tests)}, 9.9), 2)::DOUBLE"


ANNOTATE_SQL = f"""WITH s AS (SELECT page_id, html, {_sql_languages("html")} FROM pages), t AS (SELECT *, greatest(s_javascript, s_python, s_powershell, s_csharp) AS top, s_javascript + s_python + s_powershell + s_csharp AS total FROM s)
SELECT page_id AS sample_id, CASE WHEN total > 0 THEN CASE WHEN s_javascript = top THEN 'javascript' WHEN s_python = top THEN 'python' WHEN s_powershell = top THEN 'powershell' ELSE 'csharp' END END AS language,
round(CASE WHEN total > 0 THEN least(0.99, top / total) ELSE 0.1 END, 6)::DOUBLE AS confidence, round({_sql_entropy("html")}, 6)::DOUBLE AS entropy, {_sql_residual("html", "javascript")} AS residual FROM t"""


def entropy_windows(spark, d):
    rows = documents(spark, d).select("sample_id", "text", F.explode(T.windows(F.col("text"))).alias("w"))
    e = rows.select("sample_id", T.entropy(F.substring("text", F.col("w.start") + 1, F.col("w.end") - F.col("w.start"))).alias("e"))
    return e.groupBy("sample_id").agg(F.count("*").alias("windows"), F.round(F.min("e"), 6).alias("low"), F.round(F.max("e"), 6).alias("high"), F.round(F.avg("e"), 6).alias("mean"), F.count_if(F.col("e") > fixed.HIGH).alias("n_high"))


ENTROPY_WINDOWS_SQL = f"""WITH w AS (SELECT doc_id, text, length(text) AS n, CASE WHEN length(text) <= 256 THEN 0 ELSE (length(text) - 256) // 128 END AS last FROM documents),
x AS (SELECT doc_id, substr(text, i * 128 + 1, 256) AS s FROM (SELECT *, unnest(range(last + 1)) AS i FROM w) UNION ALL SELECT doc_id, substr(text, (last + 1) * 128 + 1) FROM w WHERE n > 256 AND n - (last + 1) * 128 >= 128),
e AS (SELECT doc_id, {_sql_entropy("s")} AS e FROM x)
SELECT doc_id AS sample_id, count(*) AS windows, round(min(e), 6) AS low, round(max(e), 6) AS high, round(avg(e), 6) AS mean, count(*) FILTER (e > 5.5) AS n_high FROM e GROUP BY doc_id"""


def readability(spark, d):
    return documents(spark, d).select("sample_id", F.round(T.readability(F.col("text")), 6).alias("readability"))


READABILITY_SQL = r"""WITH l AS (SELECT doc_id, text, length(text) AS n, CASE WHEN text LIKE '%' || chr(10) THEN list_slice(string_split(text, chr(10)), 1, len(string_split(text, chr(10))) - 1) ELSE string_split(text, chr(10)) END AS ls,
regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])([a-zA-Z_][\p{L}\p{N}_]*)', 1) AS ids FROM documents),
m AS (SELECT *, len(ls) AS k, n / len(ls) AS mean FROM l)
SELECT doc_id AS sample_id, round(0.25 * length(regexp_replace(text, '[^\p{L}\p{N} _\n\t]', '', 'g')) / n + 0.2 * CASE WHEN mean < 5 THEN 0.2 WHEN mean <= 100 THEN 1.0 WHEN mean <= 300 THEN 0.5 ELSE 0.1 END
+ 0.15 * least(len(list_filter(ls, lambda x: regexp_matches(x, '^\s*(#|//|/\*|<!--|<#|REM )'))) / k, 0.3) / 0.3
+ 0.25 * CASE WHEN len(ids) > 0 THEN least(length(array_to_string(ids, '')) / len(ids) / 8.0, 1.0) ELSE 0.3 END + 0.15 * len(list_filter(ls, lambda x: regexp_matches(x, '\S'))) / k, 6)::DOUBLE AS readability FROM m"""


def minified(spark, d):
    p = pages(spark, d)
    s = T.minified(F.col("text"), F.col("language"))
    return p.select("sample_id", F.round(s, 6).alias("score"), (s >= 0.45).alias("likely"))


def indicators(spark, d):
    both = documents(spark, d).select("sample_id", "text").unionByName(pages(spark, d).select((F.col("sample_id") + 10_000_000).alias("sample_id"), "text"))
    return extract.indicators(both).select("sample_id", "type", "value", "original", "defanged")


def _sql_indicators() -> str:
    parts = []
    for i, (kind, p, defanged) in enumerate(fixed.INDICATORS):
        value = "v"
        if defanged:
            for a, b in fixed.REFANG:
                value = f"regexp_replace({value}, {q(a)}, {q(b)}, 'g')"
        parts.append(f"SELECT sample_id, {i} AS rank, o, '{kind}' AS type, {value} AS value, v AS original, {str(defanged).lower()} AS defanged FROM (SELECT sample_id, unnest(l) AS v, unnest(range(len(l))) AS o FROM (SELECT sample_id, regexp_extract_all(text, {q(p)}, 1) AS l FROM s))")
    for i, (kind, n) in enumerate(fixed.HASHES):
        parts.append(rf"SELECT sample_id, {100 + i}, o, '{kind}', lower(v), v, false FROM (SELECT sample_id, unnest(l) AS v, unnest(range(len(l))) AS o FROM (SELECT sample_id, regexp_extract_all(text, '\b([a-fA-F0-9]{{{n}}})\b', 1) AS l FROM s)) WHERE regexp_matches(v, '[a-fA-F]')")
    return f"WITH s AS (SELECT doc_id AS sample_id, text FROM documents UNION ALL SELECT page_id + 10000000, html FROM pages), a AS ({' UNION ALL '.join(parts)}) SELECT sample_id, type, value, original, defanged FROM a QUALIFY row_number() OVER (PARTITION BY sample_id, type, value ORDER BY rank, o) = 1"


def indicator_counts(spark, d):
    return indicators(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("value").alias("kinds"))


def literals(spark, d):
    return extract.literals(pages(spark, d)).groupBy("sample_id").agg(F.count("*").alias("n"), F.count_if("is_url").alias("urls"), F.count_if("is_base64").alias("base64"), F.count_if("is_path").alias("paths"), F.count_if("is_long").alias("long"), F.min("start").alias("first"))


LITERALS_SQL = r"""WITH l AS (SELECT page_id, html, regexp_extract_all(html, '("(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*'')') AS m FROM pages), u AS (SELECT page_id, html, m[1] AS f, unnest(list_transform(m, lambda x: substr(x, 2, length(x) - 2))) AS v FROM l)
SELECT page_id AS sample_id, count(*) AS n, count(*) FILTER (regexp_matches(v, '(?i)https?://')) AS urls, count(*) FILTER (regexp_matches(v, '^[A-Za-z0-9+/]{16,}={0,2}$')) AS base64, count(*) FILTER (regexp_matches(v, '^/\w+(?:/[\w.-]+)+')) AS paths,
count(*) FILTER (length(v) > 50) AS "long", (min(instr(html, f)) - 1)::INTEGER AS first FROM u GROUP BY page_id"""


#: Lines of code that hold a call of each language, and calls that are none.
SINK_LINES = """eval(f(g(1), 2)); new Function('a', b(c)); el.innerHTML = x + y; setTimeout('run()', 9); setTimeout(run, 9); document.writeln(z)
exec(a); os.system('ls'); subprocess.run(['x']); getattr(o, 'n'); __import__('os'); recompile(x); evaluate(q)
IEX $a; $b | iex; $m.Invoke($x); powershell -enc QUJD; $w.DownloadString('u'); Start-Process calc
Assembly.LoadFrom(p); Activator.CreateInstance(t); d.DynamicInvoke(1); Process.Start('x'); eval(("""


def scripts(spark, d):
    """A script of every page: its text and lines of code, in one of five languages, one of them unknown."""
    p = read(spark, d, "pages")
    lang = F.element_at(F.array(*map(F.lit, ("javascript", "python", "powershell", "csharp", "other"))), (F.pmod("page_id", F.lit(5)) + 1).cast("int"))
    return p.select(F.col("page_id").alias("sample_id"), F.concat(F.lit(SINK_LINES + "\n"), F.coalesce("html", F.lit(""))).alias("text"), lang.alias("language"))


def sinks(spark, d):
    return extract.sinks(scripts(spark, d)).groupBy("sample_id", "api", "severity").agg(F.count("*").alias("n"), F.min("rank").alias("first_rank"))


def _sql_sinks(scripts: bool = False) -> str:
    """Of pages, whose language is JavaScript, or of scripts."""
    text, parts, seen = (f"{q(SINK_LINES)} || chr(10) || coalesce(html, '')" if scripts else "html"), [], set()
    for j, (lang, table) in enumerate(fixed.SINKS.items()):
        for name, severity, p in table:
            where = f"page_id % 5 = {j}" + ("" if name in seen else " OR page_id % 5 = 4") if scripts else str(lang == "javascript")
            seen.add(name)
            parts.append(f"SELECT page_id, {len(parts)} AS kind, '{name}' AS api, '{severity}' AS severity, unnest(range(len(regexp_extract_all({text}, {q(p)})))) AS o FROM pages WHERE {where}")
    return f"WITH s AS ({' UNION ALL '.join(parts)}), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, kind, o) AS rank FROM s) SELECT page_id AS sample_id, api, severity, count(*) AS n, min(rank)::INTEGER AS first_rank FROM r GROUP BY ALL"


def decode_layers(spark, d):
    """Every document. What is too short for a decoder (14 characters of base64) is digested as it stands; null stays null."""
    t = documents(spark, d)
    flat = lambda x: F.regexp_replace(F.base64(F.encode(x, "UTF-8")), r"\s", "")
    one = flat(flat("text"))
    return t.select("sample_id", F.md5(T.decode_base64(one)).alias("digest"), F.md5(T.decode_hex(F.hex(F.encode("text", "UTF-8")))).alias("hex_digest"), F.md5(T.rot13(T.rot13(F.col("text")))).alias("rot13_digest"))


def decrypted(spark, d):
    t = documents(spark, d).where("length(text) > 0")
    key = lambda n: F.substring(F.md5(F.concat(F.col("sample_id").cast("string"), F.lit(f"key{n}"))), 1, 16)
    rows = t.select("sample_id", F.aes_encrypt("text", key(2), F.lit("ECB"), F.lit("PKCS")).alias("cipher"))
    keys = t.select("sample_id", F.explode(F.array(*[F.struct(F.lit(n).alias("key_no"), key(n).alias("key")) for n in (1, 2, 3)])).alias("k")).select("sample_id", "k.*")
    return decode.decrypt_first(rows, keys).select("sample_id", "key_no", F.md5("plain").alias("digest"))


def xor_recovered(spark, d):
    """Every document. Empty and null texts have no found_key and are not right; of short texts a key is a guess."""
    t = documents(spark, d)
    key = (F.pmod("sample_id", F.lit(255)) + 1).cast("int")

    @F.pandas_udf("binary")
    def hide(text, k):
        return text.combine(k, lambda a, b: None if a is None else a.encode("latin-1", "replace").translate(bytes(x ^ int(b) for x in range(256))))

    got = decode.xor_recover(hide(F.regexp_replace("text", r"[^\x00-\x7F]", "?"), key))
    return t.select("sample_id", key.alias("true_key"), got.alias("x")).select("sample_id", "true_key", F.col("x.key").alias("found_key"), F.col("x.key").eqNullSafe(F.col("true_key")).alias("right"))


def post_processed(spark, d):
    raw = F.concat(F.lit("﻿"), F.replace("text", F.lit("."), F.lit(".  \r\n\r\n\r\n\r\n\r\n")), F.lit("\x07"))
    return documents(spark, d).where("length(trim(text)) > 0").select("sample_id", F.md5(T.post_process(raw)).alias("digest"))


POST_SQL = r"""SELECT doc_id AS sample_id, md5(CASE WHEN t LIKE '%' || chr(10) THEN t ELSE t || chr(10) END) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, '.', '.  ' || repeat(chr(10), 5)), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[\p{Z}\t]+(\n|\z)', '\1', 'g'), '\n{4,}', repeat(chr(10), 3), 'g') AS t FROM documents WHERE length(trim(text)) > 0)"""


def latest_state(spark, d):
    return history.latest(iterations(spark, d)).select("sample_id", "iteration", "action", "score")


def score_changes(spark, d):
    return history.changes(iterations(spark, d)).select("sample_id", "iteration", F.round("change", 6).alias("change"))


def plateaus(spark, d):
    return history.plateaus(iterations(spark, d), least=20.0)


def failure_streaks(spark, d):
    return history.failure_streaks(iterations(spark, d))


def outcome_counts(spark, d):
    return history.outcome_counts(iterations(spark, d))


def repeated_failures(spark, d):
    return history.repeated_failures(iterations(spark, d))


def next_actions(spark, d):
    h = iterations(spark, d)
    queue = h.select("sample_id", "action", (F.col("score") / 1000).alias("confidence"), F.when(F.col("iteration") % 2 == 0, F.round(F.col("score"), 3)).alias("priority"), F.col("iteration").alias("seq"), F.col("success").alias("deterministic"), F.when(F.col("iteration") % 5 == 0, "DONE").otherwise("PENDING").alias("status"))
    return history.next_actions(queue).select("sample_id", "action", "seq", F.round("priority", 6).alias("priority"))


def confidence_updates(spark, d):
    h = history.changes(iterations(spark, d)).join(iterations(spark, d), ["sample_id", "iteration"])
    c = history.updated_confidence(F.lit(0.5), F.col("success"), F.coalesce(F.col("change") / 1000, F.lit(0.0)), F.lit(0.8), F.pmod("iteration", F.lit(6)))
    return h.select("sample_id", "iteration", F.round(c, 6).alias("confidence"))


def import_edges(spark, d):
    return resolved(spark, d)


def degree_table(spark, d):
    return workspace.degrees(resolved(spark, d))


def coverage(spark, d):
    e = resolved(spark, d)
    return e.groupBy("sample_id").agg(F.count("*").alias("edges"), F.count("resolved").alias("found"), workspace.ratio(F.count("resolved"), F.count("*")).alias("share"))


def reachable(spark, d):
    start = spark.createDataFrame([(1, "pkg0/mod1995.py"), (1, "pkg1/mod1905.py"), (1, "pkg3/mod199.py")], "sample_id int, path string")
    return workspace.reachable(resolved(spark, d), start)


REACHABLE_SQL = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT source, resolved FROM {RESOLVED} WHERE resolved IS NOT NULL), r AS (SELECT unnest(['pkg0/mod1995.py', 'pkg1/mod1905.py', 'pkg3/mod199.py']) AS path, 0 AS depth UNION SELECT e.resolved, depth + 1 FROM r JOIN e ON e.source = r.path WHERE depth < 4) SELECT 1 AS sample_id, path, min(depth) AS depth FROM r GROUP BY path"""


def call_counts(spark, d):
    return workspace.call_counts(files(spark, d)).groupBy("name").agg(F.sum("calls").alias("calls"), F.count("*").alias("files"))


def language_counts(spark, d):
    return files(spark, d).select(archives.language_of(F.col("path")).alias("language")).groupBy("language").agg(F.count("*").alias("n"))


def ranked_files(spark, d):
    f = read(spark, d, "pages").select(F.lit(1).alias("sample_id"), F.concat(F.lit("src/"), F.when(F.col("page_id") % 50 == 0, "main.py").when(F.col("page_id") % 20 == 0, F.concat(F.lit("x"), F.col("page_id").cast("string"), F.lit(".min.js"))).otherwise(F.concat(F.lit("a/b/p"), F.col("page_id").cast("string"), F.lit(".js")))).alias("path"), F.concat(F.lit("n"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text"))
    f = f.withColumn("path", F.concat("id", F.lit("/"), "path")).drop("id")
    return workspace.best_files(workspace.file_scores(f), 32).select("sample_id", "path", "score", "size", "rank")


RANKED_SQL = r"""WITH f AS (SELECT 'n' || page_id || '/src/' || CASE WHEN page_id % 50 = 0 THEN 'main.py' WHEN page_id % 20 = 0 THEN 'x' || page_id || '.min.js' ELSE 'a/b/p' || page_id || '.js' END AS path, html FROM pages),
s AS (SELECT path, (CASE WHEN path LIKE '%/main.py' THEN 6 ELSE 0 END + CASE WHEN path LIKE '%.min.js' THEN 2 ELSE 0 END + 1 + CASE WHEN list_max(list_transform(string_split_regex(substr(html, 1, 20000), '\r\n|\n|\r'), lambda x: length(x))) > 500 THEN 1.5 ELSE 0 END)::DOUBLE AS score, octet_length(encode(html))::INTEGER AS size FROM f)
SELECT 1 AS sample_id, path, score, size, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, size, path) AS rank FROM s) WHERE rank <= 32"""


def overlaid(spark, d):
    """Every document is a file of both: the top replaces the base's where the id divides by three, else adds one."""
    t = documents(spark, d)
    place = F.when(F.pmod("sample_id", F.lit(3)) == 0, "f").otherwise("g")
    base = t.select(F.lit(1).alias("sample_id"), F.concat(F.lit("f"), F.col("sample_id").cast("string")).alias("path"), "text")
    top = t.select(F.lit(1).alias("sample_id"), F.concat(place, F.col("sample_id").cast("string")).alias("path"), F.concat(F.lit("new "), "text").alias("text"))
    return workspace.overlay(base, top).select("path", F.md5("text").alias("digest"), "replaced")


def line_changes(spark, d):
    lines = T.lines(F.col("text"))
    after = F.filter(lines, lambda x, i: i % 3 != 2)
    return documents(spark, d).select("sample_id", F.size(lines).alias("before"), F.size(after).alias("after"), F.size(F.array_except(lines, after)).alias("removed"))


TERMS = ("that", "with", "license")


def retrieved(spark, d):
    f = documents(spark, d).select("sample_id", F.concat("project_id", F.lit("/"), F.col("sample_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    return retrieval.scored(f, ["src3/7.txt", "src5/"], list(TERMS))


RETRIEVED_SQL = "WITH f AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS p, lower(text) AS t FROM documents) SELECT doc_id AS sample_id, p AS path, (CASE WHEN p = 'src3/7.txt' THEN 40 WHEN suffix(p, 'src3/7.txt') THEN 26 WHEN contains(p, 'src3/7.txt') THEN 18 WHEN regexp_extract(p, '[^/]*$') = '7.txt' THEN 12 ELSE 0 END + CASE WHEN contains(p, 'src5/') THEN 18 ELSE 0 END + " + " + ".join(f"least((length(t) - length(replace(t, '{k}', ''))) / {len(k)}, 4) * 3" for k in TERMS) + ")::DOUBLE AS score FROM f"


def excerpts(spark, d):
    return retrieval.excerpts(documents(spark, d), "license")


EXCERPTS_SQL = """WITH l AS (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN list_slice(string_split(text, chr(10)), 1, len(string_split(text, chr(10))) - 1) ELSE string_split(text, chr(10)) END AS ls FROM documents),
u AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l), s AS (SELECT doc_id, greatest(pos - 2, 0) AS a, least(pos + 3, n - 1) AS b FROM u WHERE contains(lower(line), 'license')),
m AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), k AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS block FROM m)
SELECT doc_id AS sample_id, block::INTEGER AS block, min(a)::INTEGER AS first, max(b)::INTEGER AS last FROM k WHERE block <= 3 GROUP BY doc_id, block"""


def searched(spark, d):
    return retrieval.search(documents(spark, d), "MIT", "text", "project_id").select("sample_id", "project_id")


def found(spark, d):
    p = pages(spark, d)
    return reports.findings(extract.sinks(p), extract.indicators(p))


def severity_overall(spark, d):
    return reports.overall(found(spark, d))


def json_reports(spark, d):
    return reports.json_report(found(spark, d))


def markdown_reports(spark, d):
    return reports.markdown_report(found(spark, d))


def snapshots(spark, d):
    p = pages(spark, d)
    return reports.snapshot(p, sinks=extract.sinks(p), indicators=extract.indicators(p))


def paths_normalised(spark, d):
    raw = F.concat(F.when(F.col("p_partkey") % 11 == 0, "/").otherwise(""), F.lit("a\\node_modules\\"), F.when(F.col("p_partkey") % 7 == 0, "../").otherwise("./"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".ps1").otherwise(".JS"))
    p = archives.normal_path(raw)
    return read(spark, d, "part").select("p_partkey", p.alias("path"), archives.ignored(p).alias("ignored"), archives.language_of(p).alias("language"))


def bundled(spark, d):
    f = documents(spark, d).where("length(text) > 0 and not contains(text, 'END FILE')").select(F.col("project_id").alias("sample_id"), F.concat(F.lit("d"), F.col("sample_id").cast("string")).alias("path"), "text")
    return archives.unbundle(archives.bundle(f)).select("sample_id", "path", F.md5("text").alias("digest"))


def content_kinds(spark, d):
    c = F.when(F.col("page_id") % 5 == 0, F.concat(F.unhex(F.lit("504B0304")), F.encode("html", "UTF-8"))).when(F.col("page_id") % 5 == 1, F.concat(F.encode("html", "UTF-8"), F.unhex(F.lit("00")))).otherwise(F.encode("html", "UTF-8"))
    c = F.when(F.col("page_id") % 5 == 2, F.concat(F.unhex(F.concat(F.lit("4D5A"), F.repeat(F.lit("00"), 58), F.lit("40000000504500004D5A"))), F.unhex(F.repeat(F.lit("01"), 256)))).otherwise(c)
    return read(spark, d, "pages").select("page_id", archives.content_kind(c).alias("kind"))


def folded_literals(spark, d):
    t = F.concat(F.lit('x = "'), F.col("p_brand"), F.lit('" + "'), F.col("p_type"), F.lit('" + "!"'))
    codes = F.concat(F.lit("String.fromCharCode("), F.array_join(F.transform(F.split(F.substring("p_brand", 1, 5), ""), lambda c: F.ascii(c).cast("string")), ", "), F.lit(")"))
    return read(spark, d, "part").select("p_partkey", decode.folded(t).alias("folded"), decode.char_codes(codes).alias("chars"))


QUERIES = {
    "annotate": (annotate, ANNOTATE_SQL), "x5_entropy_windows": (entropy_windows, ENTROPY_WINDOWS_SQL), "x8_readability": (readability, READABILITY_SQL), "x11_minified": (minified, None),
    "x6_indicators": (indicators, _sql_indicators()), "g2_indicator_counts": (indicator_counts, f"SELECT type, count(*) AS n, count(DISTINCT value) AS kinds FROM ({_sql_indicators()}) GROUP BY type"),
    "x3_literals": (literals, LITERALS_SQL), "x4_sinks": (sinks, _sql_sinks(True)),
    "y3_decode_layers": (decode_layers, "SELECT doc_id AS sample_id, md5(CASE WHEN length(rtrim(b, '=')) < 14 THEN b WHEN length(rtrim(a, '=')) < 14 THEN a ELSE text END) AS digest, md5(text) AS hex_digest, md5(text) AS rot13_digest FROM (SELECT *, to_base64(encode(a)) AS b FROM (SELECT *, to_base64(encode(text)) AS a FROM documents))"),
    "y7_decrypted": (decrypted, "SELECT doc_id AS sample_id, 2 AS key_no, md5(text) AS digest FROM documents WHERE length(text) > 0"),
    "y6_xor_recovered": (xor_recovered, None),
    "y24_post_processed": (post_processed, POST_SQL),
    "y9_folded_literals": (folded_literals, "SELECT p_partkey, 'x = \"' || p_brand || p_type || '!\"' AS folded, substr(p_brand, 1, 5) AS chars FROM part"),
    "w1_latest_state": (latest_state, f"SELECT sample_id, iteration, action, score FROM {ITER} QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY iteration DESC) = 1"),
    "w3_score_changes": (score_changes, f"SELECT sample_id, iteration, round(score - lag(score) OVER (PARTITION BY sample_id ORDER BY iteration), 6) AS change FROM {ITER}"),
    "w4_plateaus": (plateaus, f"SELECT sample_id, iteration, count(c) OVER w = 3 AND coalesce(max(c) OVER w < 20, false) AS plateau FROM (SELECT *, abs(score - lag(score) OVER (PARTITION BY sample_id ORDER BY iteration)) AS c FROM {ITER}) WINDOW w AS (PARTITION BY sample_id ORDER BY iteration ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"),
    "w5_failure_streaks": (failure_streaks, f"WITH h AS {ITER}, l AS (SELECT sample_id, max(iteration) FILTER (success) AS last FROM h GROUP BY sample_id) SELECT h.sample_id, count(*) FILTER (last IS NULL OR iteration > last) AS streak FROM h JOIN l ON l.sample_id = h.sample_id GROUP BY h.sample_id"),
    "g4_outcome_counts": (outcome_counts, f"SELECT sample_id, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, count(*) AS iterations FROM {ITER} GROUP BY sample_id"),
    "g10_repeated_failures": (repeated_failures, f"SELECT sample_id, action, count(*) AS failures FROM {ITER} WHERE NOT success GROUP BY ALL HAVING count(*) >= 2"),
    "o1_next_actions": (next_actions, f"SELECT sample_id, action, iteration AS seq, round(p, 6) AS priority FROM (SELECT *, coalesce(CASE WHEN iteration % 2 = 0 THEN round(score, 3) END, (1 - score / 1000) - CASE WHEN success THEN 0.5 ELSE 0 END) AS p FROM {ITER} WHERE iteration % 5 <> 0) QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY p, iteration) = 1"),
    "x24_confidence_updates": (confidence_updates, f"SELECT sample_id, iteration, round(CASE WHEN NOT success THEN 0.48 ELSE greatest(0, least(1, 0.5 + 0.3 * coalesce(c / 1000, 0) + 0.08 + least(0.08, (iteration % 6) * 0.02))) END, 6)::DOUBLE AS confidence FROM (SELECT *, score - lag(score) OVER (PARTITION BY sample_id ORDER BY iteration) AS c FROM {ITER})"),
    "j2_import_edges": (import_edges, f"SELECT sample_id, source, target, resolved FROM {RESOLVED}"),
    "g6_degrees": (degree_table, f"WITH e AS (SELECT DISTINCT source, resolved FROM {RESOLVED} WHERE resolved IS NOT NULL), a AS (SELECT source AS path, 0 AS i, 1 AS o FROM e UNION ALL SELECT resolved, 1, 0 FROM e) SELECT 1 AS sample_id, path, sum(i)::BIGINT AS inbound, sum(o)::BIGINT AS outbound FROM a GROUP BY path"),
    "g12_coverage": (coverage, f"SELECT sample_id, count(*) AS edges, count(resolved) AS found, round(count(resolved) / count(*), 4) AS share FROM {RESOLVED} GROUP BY sample_id"),
    "x10_reachable": (reachable, REACHABLE_SQL),
    "g7_call_counts": (call_counts, f"WITH c AS (SELECT path, unnest(regexp_extract_all(text, '([A-Za-z_]\\w*)\\s*\\(', 1)) AS name FROM {FILES}) SELECT name, count(*) AS calls, count(DISTINCT path) AS files FROM c GROUP BY name"),
    "g5_language_counts": (language_counts, "SELECT 'python' AS language, count(*) AS n FROM part"),
    "s13_ranked_files": (ranked_files, RANKED_SQL),
    "d4_overlaid": (overlaid, "SELECT 'f' || doc_id AS path, md5(CASE WHEN doc_id % 3 = 0 THEN 'new ' || text ELSE text END) AS digest, doc_id % 3 = 0 AS replaced FROM documents UNION ALL SELECT 'g' || doc_id, md5('new ' || text), true FROM documents WHERE doc_id % 3 <> 0"),
    "k9_line_changes": (line_changes, "WITH l AS (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN list_slice(string_split(text, chr(10)), 1, len(string_split(text, chr(10))) - 1) ELSE string_split(text, chr(10)) END AS a FROM documents), m AS (SELECT *, list_filter(a, lambda x, i: i % 3 <> 0) AS b FROM l) SELECT doc_id AS sample_id, len(a)::INTEGER AS before, len(b)::INTEGER AS after, len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x)))::INTEGER AS removed FROM m"),
    "x20_retrieved": (retrieved, RETRIEVED_SQL), "x21_excerpts": (excerpts, EXCERPTS_SQL),
    "f4_searched": (searched, "SELECT doc_id AS sample_id, source AS project_id FROM documents WHERE contains(lower(text), 'mit') OR contains(lower(source), 'mit')"),
    "x16_overall": (severity_overall, f"WITH s AS ({_sql_sinks()}), p AS (SELECT page_id + 10000000 AS k, page_id FROM pages), i AS (SELECT DISTINCT page_id AS sample_id FROM ({_sql_indicators()}) JOIN p ON k = sample_id), a AS (SELECT sample_id, severity FROM s UNION ALL SELECT sample_id, 'info' FROM i) SELECT sample_id, CASE WHEN count(*) FILTER (severity = 'high') >= 3 THEN 'critical' WHEN count(*) FILTER (severity = 'high') >= 1 THEN 'high' WHEN count(*) FILTER (severity = 'medium') >= 1 THEN 'medium' ELSE 'low' END AS overall FROM a GROUP BY sample_id"),
    "k4_json_reports": (json_reports, None), "k5_markdown_reports": (markdown_reports, None),
    "k8_snapshots": (snapshots, f"WITH s AS ({_sql_sinks()}), i AS ({_sql_indicators()}) SELECT page_id AS sample_id, coalesce((SELECT sum(n) FROM s WHERE s.sample_id = page_id), 0)::BIGINT AS n_sinks, (SELECT count(*) FROM i WHERE i.sample_id = page_id + 10000000) AS n_indicators FROM pages"),
    "s9_paths": (paths_normalised, "SELECT p_partkey, p AS path, CASE WHEN p IS NOT NULL THEN true END AS ignored, CASE WHEN p IS NOT NULL THEN CASE WHEN p_partkey % 2 = 0 THEN 'powershell' ELSE 'javascript' END END AS language FROM (SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 THEN 'a/node_modules/' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.ps1' ELSE '.JS' END END AS p FROM part)"),
    "s16_bundled": (bundled, "SELECT source AS sample_id, 'd' || doc_id AS path, md5(text) AS digest FROM documents WHERE length(text) > 0 AND NOT contains(text, 'END FILE')"),
    "s3_content_kinds": (content_kinds, "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'archive' WHEN 2 THEN 'pe_binary' WHEN 1 THEN CASE WHEN octet_length(encode(html)) < 1024 THEN 'binary' ELSE 'text' END ELSE 'text' END AS kind FROM pages"),
}


def everything() -> dict:
    from . import reviews  # which reads its tables through this module

    return QUERIES | reviews.QUERIES


def queries() -> dict:
    return {name: f for name, (f, _) in everything().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in everything().items() if sql}
