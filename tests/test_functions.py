import base64
import io
import math
import zipfile
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.operators import decode, extract, history, reports, workspace
from tracewright.sources import archives
from tracewright.streaming import ingest


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_entropy(spark):
    for t in ("a", "aab", "née 😀 x", "abcdefgh" * 40):
        n = Counter(t)
        want = -sum(c / len(t) * math.log2(c / len(t)) for c in n.values())
        assert abs(one(spark, T.entropy(F.col("t")), t=t) - want) < 1e-9
    assert one(spark, T.entropy(F.lit(""))) == 0


def test_lines_and_windows(spark):
    assert one(spark, T.lines(F.col("t")), t="a\r\nb\n\nc\n") == ["a", "b", "", "c"]
    assert one(spark, T.lines(F.col("t")), t="") == []
    for n in (0, 100, 256, 383, 384, 600):
        want = [(0, n)] if n <= 256 else [(o, o + 256) for o in range(0, n - 255, 128)]
        if n > 256 and n - (want[-1][0] + 128) >= 128:
            want.append((want[-1][0] + 128, n))
        assert [(w.start, w.end) for w in one(spark, T.windows(F.repeat(F.lit("x"), n)))] == want


def test_language_and_ties(spark):
    got = one(spark, T.detect_language(F.col("t")), t="import os\ndef f(x):\n    return None\n")
    assert got.language == "python" and 0 < got.confidence <= 0.99
    assert one(spark, T.detect_language(F.lit("zzz"))).language is None


def test_indicators(spark):
    h = "a" * 64
    t = f"see hxxp://evil[.]com/x and 10.0.0.1 10.0.0.1 {h} me@x.org"
    rows = {(r.type, r.value) for r in extract.indicators(spark.createDataFrame([(1, t), (2, None), (3, "")], "sample_id long, text string")).collect()}
    assert {("ipv4", "10.0.0.1"), ("url", "http://evil"), ("email", "me@x.org"), ("sha256", h)} <= rows
    assert not {k for k, _ in rows} & {"sha1", "md5"}


def test_decoders(spark):
    plain = "hello world, this is plain text"
    z = base64.b64encode(zlib.compress(plain.encode())).decode()
    assert one(spark, decode.inflate(F.col("t")), t=z) == plain
    assert one(spark, decode.decode_base32_85(F.col("t")), t=base64.b32encode(plain.encode()).decode()) == plain
    assert one(spark, decode.unescape(F.col("t")), t=r"\x41B%43&lt;") == "ABC<"
    d = one(spark, decode.unified_diff(F.lit("a\nb"), F.lit("a\nc")))
    assert (d.added, d.removed) == (1, 1)
    r = decode.rewrite_rounds(spark.createDataFrame([(1, 'x="a"+"b"+"c"')], "sample_id long, text string"), [decode.folded]).first()
    assert r.text == 'x="abc"' and r.changed == 1


def test_budget_skips_and_goes_on(spark):
    f = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "b", 9), (1, 3, "c", 4)], "sample_id long, rank int, path string, size int")
    assert {r.path for r in workspace.within_budget(f, 10).collect()} == {"a", "c"}


def test_upsert_and_changes(spark):
    a = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.2)], "sample_id long, iteration int, score double")
    b = spark.createDataFrame([(1, 2, 0.5)], "sample_id long, iteration int, score double")
    assert sorted((r.iteration, r.score) for r in history.upserted(a, b).collect()) == [(1, 0.1), (2, 0.5)]


def test_archives_and_texts(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("src/a.py", "x = 1")
        z.writestr("../bad.py", "y")
    (tmp_path / "a.zip").write_bytes(buf.getvalue())
    (tmp_path / "b.zip").write_bytes(b"no archive")
    rows = archives.members(spark.read.format("binaryFile").load(str(tmp_path))).select("member", archives.normal_path(F.col("member")).alias("p"), archives.decoded(F.col("content")).alias("t")).collect()
    assert {(r.p, r.t) for r in rows} == {("src/a.py", "x = 1"), (None, "y")}
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "t.txt").write_text("one\ntwo")
    assert [r.text for r in archives.read_texts(spark, str(tmp_path / "texts")).collect()] == ["one\ntwo"]


def test_persist_overwrites_its_samples_only(spark, tmp_path):
    path = str(tmp_path / "out")
    reports.persist(spark.createDataFrame([(1, "a"), (2, "b")], "sample_id long, value string"), path)
    reports.persist(spark.createDataFrame([(2, "c" * 3000)], "sample_id long, value string"), path)
    assert sorted((r.sample_id, len(r.value)) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 2000)]


def test_streaming_matches_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "const x = 1;"), (2, "def f(x):\n  return x")], "sample_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    q = ingest.annotated(ingest.stream_samples(spark, str(tmp_path / "in"), "sample_id long, text string")).writeStream.format("memory").queryName("annotated").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("annotated").collect())) == sorted(map(tuple, ingest.annotated(df).collect()))
