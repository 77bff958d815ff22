"""Secret scans by multipart credential linking, in DataFrame functions alone.

Strong patterns are reported wherever they match. Weak parts (user names, opaque 40-character keys, endpoints) prove
nothing alone: they are reported only when an interval join finds the complementary parts within the same scope.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCOPE = 256  # code points from the end of a part to the start of the next that belongs to it
#: kind: (pattern, group whose length counts, least length, what a match must also be like)
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ""),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18, ""),
    "hex": (r"[0-9a-f]{16,}", 0, 16, ""),
    "user": (r"""((?i:username|user|login|client_?id|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 2, 3, ""),
    "opaque": (r"[A-Za-z0-9+/]{40,}", 0, 40, "^[A-Za-z0-9+/]{40}$"),
    "endpoint": (r"""(?:https?|ftp|s3|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9@:%._/?&=#+-]+""", 0, 8, ""),
}
KINDS = list(PATTERNS)
STRONG = ("assign", "access", "hex")
#: What a part is to the others, and which others a weak part needs in its scope.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "user": "id", "opaque": "secret", "endpoint": "endpoint"}
NEEDS = {"user": ["secret"], "opaque": ["id"], "endpoint": ["id", "secret"]}


def matches(kind: str, text: str = "text"):
    """Array of (start, end) of a kind's matches in code points, in order."""
    pattern, group, least, also = PATTERNS[kind]
    t, p = F.col(text), F.lit(pattern)
    # The gaps between matches and the matches add up to positions; one gap more than matches ends the list.
    pieces = F.arrays_zip(F.split(t, pattern, -1).alias("gap"), F.regexp_extract_all(t, p, F.lit(0)).alias("whole"), F.regexp_extract_all(t, p, F.lit(group)).alias("part"))
    none = F.lit(None).cast("struct<at:int,spans:array<struct<start:int,end:int,good:boolean>>>")
    empty = F.array().cast("array<struct<start:int,end:int,good:boolean>>")

    def step(acc, m):
        start = acc["at"] + F.length(m["gap"])
        end = start + F.length(m["whole"])
        good = F.length(m["part"]) >= least
        if also:
            good &= m["whole"].rlike(also)
        span = F.struct(start.alias("start"), end.alias("end"), good.alias("good"))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    start = F.coalesce(none, F.struct(F.lit(0).alias("at"), empty.alias("spans")))
    found = F.transform(F.aggregate(pieces, start, step)["spans"], lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return F.when(t.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def scan(docs: DataFrame, keep: tuple = ()) -> DataFrame:
    """Every row's doc_id (and the columns `keep`) with `spans`: an array of (start, kind number, kind, end), sorted.

    Null texts are empty and give no span. Repeated rows and null doc_ids are scanned alike, as rows of their own. The
    spans, not the texts, are written once to the shared folder. Rows whose spans lie close are joined by row and scope, so
    neither a long text nor a hot source meets in one task.
    """
    base = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("_tw_row"))
    base = base.select("doc_id", *keep, "_tw_row", *[matches(k).alias(k) for k in KINDS])
    base = common.materialize(base)
    tag = lambda k: F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(k)).alias("rank"), F.lit(k).alias("kind"), s["end"].alias("end")))
    weak = F.concat(*[tag(k) for k in NEEDS])
    parts = base.where(" OR ".join(f"size(`{k}`) > 0" for k in NEEDS)).select("_tw_row", F.explode(F.concat(*[tag(k) for k in KINDS])).alias("s"))
    role = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])
    bins = lambda slack: F.explode(F.sequence(F.floor((F.col("s.start") - slack) / F.lit(SCOPE)), F.floor((F.col("s.end") + slack) / F.lit(SCOPE)))).alias("bin")
    wanting = base.select("_tw_row", F.explode(weak).alias("s")).select("_tw_row", "s", bins(SCOPE))
    having = parts.select("_tw_row", bins(0), role[F.col("s.kind")].alias("role"), F.col("s.start").alias("at"), F.col("s.end").alias("to"))
    near = wanting.join(having, ["_tw_row", "bin"]).where(F.greatest("at", "s.start") - F.least("to", "s.end") <= SCOPE)
    roles = near.groupBy("_tw_row", "s").agg(*[F.max((F.col("role") == r).cast("int")).alias(r) for r in ("id", "secret", "endpoint")])
    enough = F.lit(False)
    for kind, needs in NEEDS.items():
        test = F.col("s.kind") == kind
        for r in needs:
            test &= F.col(r) == 1
        enough |= test
    linked = roles.where(enough).groupBy("_tw_row").agg(F.collect_list("s").alias("more"))
    own = F.concat(*[tag(k) for k in STRONG])
    out = base.join(linked, "_tw_row", "left")
    none = F.expr("CAST(array() AS array<struct<start:int,rank:int,kind:string,end:int>>)")
    return out.select("doc_id", *keep, *[F.size(k).cast("long").alias(f"n_{k}") for k in STRONG], F.array_sort(own).alias("base"), F.array_sort(F.concat(own, F.coalesce("more", none))).alias("spans"))


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    out = scan(common.table(spark, sf_dir, "documents"))
    return out.select(F.col("doc_id").cast("long"), "n_assign", "n_access", "n_hex", F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def _sql_matches(kind: str) -> str:
    pattern, group, least, also = PATTERNS[kind]
    p = "'" + pattern.replace("'", "''") + "'"
    good = f"length(part) >= {least}" + (f" AND regexp_matches(whole, '{also}')" if also else "")
    return f"""SELECT r, {KINDS.index(kind)} AS rank, '{kind}' AS kind, s AS start, s + length(whole) AS stop FROM (
      SELECT r, whole, part, sum(length(gap)) OVER w + coalesce(sum(length(whole)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
      FROM (SELECT r, unnest(range(len(m))) AS i, unnest(m) AS whole, unnest(g) AS part, unnest(list_slice(gaps, 1, len(m))) AS gap
            FROM (SELECT r, regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, {group}) AS g, string_split_regex(text, {p}) AS gaps FROM d) WHERE len(m) > 0)
      WINDOW w AS (PARTITION BY r ORDER BY i)) WHERE {good}"""


def op7_sql() -> str:
    role = " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in ROLE.items())
    needs = " OR ".join(f"(kind = '{k}' AND " + " AND ".join(f"bool_or(role = '{r}')" for r in rs) + ")" for k, rs in NEEDS.items())
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    s AS MATERIALIZED ({" UNION ALL ".join(_sql_matches(k) for k in KINDS)}),
    p AS (SELECT *, CASE kind {role} END AS role FROM s),
    w AS (SELECT a.r, a.rank, a.kind, a.start, a.stop FROM s a JOIN p b ON a.r = b.r AND greatest(a.start, b.start) - least(a.stop, b.stop) <= {SCOPE}
          WHERE a.rank >= {len(STRONG)} GROUP BY a.r, a.rank, a.kind, a.start, a.stop HAVING {needs.replace("kind =", "a.kind =")}),
    u AS (SELECT * FROM s WHERE rank < {len(STRONG)} UNION ALL SELECT r, rank, kind, start, stop FROM w),
    g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
          string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, rank) FILTER (rank < {len(STRONG)}) AS base,
          string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, rank) AS spans FROM u GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (r)"""
