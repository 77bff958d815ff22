"""Queries of the review operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import extract, review
from . import registry as R

TECH = ", ".join(f"CASE WHEN regexp_matches(html, {R.q(p)}) THEN '{n}' END" for n, p in fixed.TECHNIQUES)
TECH_SQL = f"(SELECT page_id AS sample_id, list_filter([{TECH}], lambda x: x IS NOT NULL) AS t FROM pages)"
CODE = "'run(' || p_brand || ')' || chr(10) || 'print(len(' || p_type || '))' || chr(10) || 'run(1)'"


def code():
    return F.concat(F.lit("run("), "p_brand", F.lit(")\nprint(len("), "p_type", F.lit("))\nrun(1)"))


def one_document(spark, d):
    return review.by_key(R.documents(spark, d), "sample_id", 42).select("sample_id", "language", F.md5("text").alias("digest"))


def one_conversation(spark, d):
    return review.by_key(R.read(spark, d, "conversations"), "conv_id", 3).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


def project_lists(spark, d):
    return review.newest_first(R.documents(spark, d), "project_id").select("sample_id", "project_id", "place")


def regex_search(spark, d):
    return review.matching(R.documents(spark, d), "licen[cs]e|\\bcc-by\\b", "text", "project_id", "language").select("sample_id", "project_id")


def high_findings(spark, d):
    return review.severe(extract.sinks(R.scripts(spark, d)), "high", "api", "EV").groupBy("sample_id").agg(F.count("*").alias("n"))


def severity_counts(spark, d):
    return extract.sinks(R.scripts(spark, d)).groupBy("severity").agg(F.count("*").alias("n"))


def page_techniques(spark, d):
    t = R.pages(spark, d).select("sample_id", review.techniques(F.col("text")).alias("t"))
    return t.select("sample_id", F.concat_ws(",", "t").alias("techniques"), F.round(review.technique_confidence(F.size("t")), 6).alias("confidence"))


def top_techniques(spark, d):
    """The first five distinct techniques of two lists, the reversed one first."""
    t = R.pages(spark, d).select("sample_id", review.techniques(F.col("text")).alias("t"))
    return t.select("sample_id", F.concat_ws(",", F.slice(F.array_distinct(F.concat(F.reverse("t"), "t")), 1, 5)).alias("techniques"))


def detections(spark, d):
    t = R.pages(spark, d).select("url", "sample_id", F.size(review.techniques(F.col("text"))).alias("n"))
    t = t.withColumn("confidence", review.technique_confidence(F.col("n")))
    return review.top(t, "n", 10, F.desc("confidence"), F.col("sample_id")).select("n", "sample_id", "place", F.round("confidence", 6).alias("confidence"))


def depths(spark, d):
    return R.pages(spark, d).select("sample_id", review.nesting(F.col("text")).alias("depth"))


def lost_names(spark, d):
    t = R.read(spark, d, "part").select("p_partkey", code().alias("before"), F.concat(F.lit("walk(2)\n"), F.replace(code(), F.lit("run("), F.lit("go("))).alias("after"))
    x = review.changed_names(F.col("before"), F.col("after"), r"\b(\w+)\(")
    return t.select("p_partkey", F.concat_ws(",", x["missing"]).alias("missing"), F.concat_ws(",", x["added"]).alias("added"))


def hotspots(spark, d):
    return review.top(R.read(spark, d, "part"), "p_brand", 12, F.desc("p_size"), F.col("p_partkey")).select("p_brand", "p_partkey", "place")


def unique_names(spark, d):
    return review.told_apart(R.read(spark, d, "part"), "p_type", "p_partkey").select("p_partkey", "unique_name")


def sorted_strings(spark, d):
    t = extract.literals(R.pages(spark, d))
    return review.top(t, "sample_id", 1 << 30, F.desc(F.length("value")), F.col("start")).groupBy("sample_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("place") == 1, F.length("value"))).alias("longest"))


def faults(spark, d):
    p = R.read(spark, d, "part")
    path = F.concat(F.lit("m/"), F.col("p_partkey").cast("string"))
    got = p.select(F.when(F.col("p_size") > 10, path).otherwise(F.concat(F.lit("new/"), path)).alias("path"), F.explode(F.sequence(F.lit(1), F.when(F.col("p_size") > 40, 2).otherwise(1))))
    return review.bundle_faults(p.select(path.alias("path")), got.select("path"))


def manifests(spark, d):
    m = review.manifest(F.concat(F.lit("brand: "), "p_brand", F.lit("\nparts: "), F.replace("p_type", F.lit(" "), F.lit(" | ")), F.lit("\nno key\nnotes: None")))
    return R.read(spark, d, "part").select("p_partkey", F.concat_ws(",", m["brand"]).alias("brand"), F.concat_ws(",", m["parts"]).alias("parts"), F.size(m["notes"]).alias("notes"), F.size(F.map_keys(m)).alias("n_keys"))


def readability_changes(spark, d):
    t = R.documents(spark, d).select(F.col("project_id").alias("sample_id"), F.col("sample_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    score = lambda c: F.least(F.lit(1.0), F.length(c) / F.lit(4096.0))
    after = t.withColumn("text", F.replace("text", F.lit("the"), F.lit("those")))
    return review.readability_change(t.withColumn("score", score("text")), after.withColumn("score", score("text")))


def mean_confidences(spark, d):
    """The mean is that of the SQL, bit by bit: an exact sum of hundredths, and halves of the sixth place rounded up as doubles."""
    mean = F.sum(F.round(F.col("confidence") * 100).cast("long")).cast("double") / 100 / F.count("confidence")
    return page_techniques(spark, d).agg((F.round(mean * 1000000) / 1000000).alias("mean"), F.count_if(F.col("confidence") >= 0.5).alias("sure"))


CONF = "CASE WHEN len(t) > 0 THEN least(0.9, 0.45 + 0.05 * len(t)) ELSE 0.1 END"
QUERIES = {
    "f1_one_document": (one_document, "SELECT doc_id AS sample_id, lang AS language, md5(text) AS digest FROM documents WHERE doc_id = 42"),
    "f2_one_conversation": (one_conversation, "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations WHERE conv_id = 3"),
    "f3_project_lists": (project_lists, "SELECT doc_id AS sample_id, source AS project_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC)::INTEGER AS place FROM documents"),
    "f5_regex_search": (regex_search, "SELECT doc_id AS sample_id, source AS project_id FROM documents WHERE regexp_matches(concat_ws(chr(10), text, source, lang), '(?i)licen[cs]e|\\bcc-by\\b')"),
    "f6_high_findings": (high_findings, f"SELECT sample_id, sum(n)::BIGINT AS n FROM ({R._sql_sinks(True)}) WHERE severity = 'high' AND contains(lower(api), 'ev') GROUP BY sample_id"),
    "g3_severity_counts": (severity_counts, f"SELECT severity, sum(n)::BIGINT AS n FROM ({R._sql_sinks(True)}) GROUP BY severity"),
    "x2_techniques": (page_techniques, f"SELECT sample_id, array_to_string(t, ',') AS techniques, round({CONF}, 6)::DOUBLE AS confidence FROM {TECH_SQL}"),
    "g15_top_techniques": (top_techniques, f"SELECT sample_id, array_to_string(list_slice(list_reverse(t), 1, 5), ',') AS techniques FROM {TECH_SQL}"),
    "o9_detections": (detections, f"SELECT len(t)::INTEGER AS n, sample_id, (row_number() OVER w)::INTEGER AS place, round({CONF}, 6)::DOUBLE AS confidence FROM {TECH_SQL} WINDOW w AS (PARTITION BY len(t) ORDER BY sample_id) QUALIFY row_number() OVER w <= 10"),
    "w10_depths": (depths, """WITH b AS (SELECT page_id, generate_subscripts(m, 1) AS i, unnest(m) AS c FROM (SELECT page_id, regexp_extract_all(html, '[\\[\\](){}]') AS m FROM pages)),
      s AS (SELECT page_id, i, sum(CASE WHEN c IN ('(', '[', '{') THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i) AS s FROM b),
      d AS (SELECT page_id, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS depth FROM s)
      SELECT page_id AS sample_id, CASE WHEN html IS NOT NULL THEN coalesce((SELECT max(depth) FROM d WHERE d.page_id = p.page_id), 0) END::INTEGER AS depth FROM pages p"""),
    "j11_lost_names": (lost_names, "SELECT p_partkey, 'run' AS missing, 'walk,go' AS added FROM part"),
    "o3_hotspots": (hotspots, "SELECT p_brand, p_partkey, (row_number() OVER w)::INTEGER AS place FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) QUALIFY row_number() OVER w <= 12"),
    "w9_unique_names": (unique_names, "SELECT p_partkey, p_type || CASE WHEN n > 1 THEN '_' || (n - 1) ELSE '' END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part)"),
    "o6_sorted_strings": (sorted_strings, r"""SELECT page_id AS sample_id, len(m) AS n, list_max(list_transform(m, lambda x: length(x) - 2))::INTEGER AS longest FROM (SELECT page_id, regexp_extract_all(html, '("(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*'')') AS m FROM pages) WHERE len(m) > 0"""),
    "d6_bundle_faults": (faults, "WITH g AS (SELECT CASE WHEN p_size > 10 THEN '' ELSE 'new/' END || 'm/' || p_partkey AS path, CASE WHEN p_size > 40 THEN 2 ELSE 1 END::BIGINT AS n, p_size, p_partkey FROM part) SELECT path, 'duplicate' AS fault, n FROM g WHERE n > 1 UNION ALL SELECT 'm/' || p_partkey, 'missing', 0 FROM g WHERE p_size <= 10 UNION ALL SELECT path, 'unexpected', n FROM g WHERE p_size <= 10"),
    "s17_manifests": (manifests, "SELECT p_partkey, p_brand AS brand, replace(p_type, ' ', ',') AS parts, 0 AS notes, 3 AS n_keys FROM part"),
    "g13_readability_changes": (readability_changes, "WITH t AS (SELECT source, coalesce(text, '') AS a, replace(coalesce(text, ''), 'the', 'those') AS b FROM documents), s AS (SELECT source, a <> b AS c, least(1, length(b) / 4096.0::DOUBLE) - least(1, length(a) / 4096.0::DOUBLE) AS d, least(20000, greatest(200, length(b))) AS w FROM t), g AS (SELECT source, count(*) AS files, count(*) FILTER (c) AS changed, sum(d * w) / sum(w) AS m FROM s GROUP BY source) SELECT source AS sample_id, files, changed, round(m + CASE WHEN m > 0 THEN 0.05 * least(0.4, changed / files) ELSE 0 END, 6)::DOUBLE AS delta FROM g"),
    "g17_mean_confidences": (mean_confidences, f"SELECT round(avg(round({CONF}, 6)), 6)::DOUBLE AS mean, count(*) FILTER ({CONF} >= 0.5) AS sure FROM {TECH_SQL}"),
}
