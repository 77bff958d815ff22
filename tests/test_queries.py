import hashlib

import pytest
from compare import check

from tracewright.plans import registry

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    check(spark, registry.queries()[name], registry.oracle_sql()[name], D)


def test_entry_is_guarded(spark):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Texts of all lengths: none, empty, short, and longer than 4,000 characters."""
    texts = [None, "", "a", "short text", "It is a text of a few words. " * 2, "The rain in the east is not to be seen. " * 900, "x y z " * 20]
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d, {r[0]: r[1] for r in rows}


def test_decode_layers_of_all_lengths(spark, tables):
    d, texts = tables
    rows = {r.sample_id: r for r in registry.QUERIES["y3_decode_layers"][0](spark, d).collect()}
    digest = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    assert {i: (r.rot13_digest, r.hex_digest) for i, r in rows.items()} == {i: (digest(t), digest(t)) for i, t in texts.items()}
    assert all((rows[i].digest is None) == (t is None) for i, t in texts.items())
    assert all(rows[i].digest == digest(t) for i, t in texts.items() if t and len(t) >= 10)


def test_xor_keys_of_all_lengths(spark, tables):
    d, texts = tables
    rows = {r.sample_id: r for r in registry.QUERIES["y6_xor_recovered"][0](spark, d).collect()}
    assert rows.keys() == texts.keys() and rows[6].right and rows[5].right
    assert all((r.found_key is None) == (not texts[i]) and r.right == (r.found_key == r.true_key) for i, r in rows.items())


def test_overlay_has_every_document(spark, tables):
    d, texts = tables
    got = {r.path: (r.digest, r.replaced) for r in registry.QUERIES["d4_overlaid"][0](spark, d).collect()}
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    for i, t in texts.items():
        if t is not None:
            new = (digest("new " + t), True)
            assert (got[f"f{i}"], got.get(f"g{i}")) == ((new, None) if i % 3 == 0 else ((digest(t), False), new))


def test_xor_is_mostly_recovered(spark):
    rows = registry.QUERIES["y6_xor_recovered"][0](spark, D).collect()
    assert sum(r.right for r in rows) >= 0.93 * len(rows)


@pytest.fixture(scope="module")
def odd_pages(spark, tmp_path_factory):
    """Pages whose letters, spaces and cases Java's patterns and those of the SQL read differently, for every technique."""
    near = ["Ñllllll ción", "_ab1é", "éeval(", "eval(é", "ſeval(", "Kchr(", "xorñ", "^", "passé", "paſs", "if\x0b(0)", "if (0)", "if (0)", "ſ[1]", "é[1]", "aK[0x1f]", "K[2]", "a" * 19 + "ſ", "K" * 20 + "==", "aToB(", "b64decode\x0b(", "b64decode\f(",
            "-ENC " + "é" * 3 + "a" * 20, "Aſſembly.Load", "aſsembly.load", "piCKle.loadſ (", "marshal.loads(", "marſhal.loads(", "unſcramble(", "decrypt (", "ſtring.fromCharCode", "iNvoKe-Expression(", "inVoKe-expreSſion(", "IİX(", "while(!0){ſwitch", "while(1)\x85{switch", "á_abc", "[Char] ", "eval(function(p,a,c,K,e,d)", "eval(function(p,a,c,K,e,d)",
            "'a'+'b'+'c'+", "'a'\x0b+'b'+'c'+", "0x1f,0x2f, 0x3f\x0b0x4f", "0x1f,0x2f, 0x3f 0x4f", "\\x1f\\x2F\\x3f\\x4f", "K" + "1f" * 16, "_0xABCD", "_0xABCDж", "жIIIIII", "llIIll‍", None, ""]
    d = str(tmp_path_factory.mktemp("odd_pages"))
    spark.createDataFrame([(i, f"u{i}", t) for i, t in enumerate(near)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{d}/pages.parquet")
    return d


def check_pages(spark, name, d):
    import duckdb
    from compare import rows_of

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet/*.parquet'")
    got, cur = registry.queries()[name](spark, d), con.execute(registry.oracle_sql()[name])
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_techniques_read_letters_as_the_sql_does(spark, odd_pages):
    check_pages(spark, "x2_techniques", odd_pages)


def test_top_techniques_read_letters_as_the_sql_does(spark, odd_pages):
    check_pages(spark, "g15_top_techniques", odd_pages)


def test_mean_confidences_read_letters_as_the_sql_does(spark, odd_pages):
    check_pages(spark, "g17_mean_confidences", odd_pages)


def test_top_techniques_of_long_runs(spark, tmp_path):
    """Texts for which Java's matcher would take much stack, or time beyond the text's length."""
    gap = " " * 400
    long = ["0x1f, " * 50000, "'a' + " * 50000, "\\x1f" * 50000, "1f" * 50000, f"0x1f{gap}0x1f{gap}0x1f{gap}", "while(1)" + 20 * gap, "void" + 20 * gap + "0", "aſ" * 5000, "aſſ" * 5000 + "[1]", "a" * 100000 + "[ 1 ]", "I" * 100000 + "é", "'a'" + gap + "+" + gap + "'b'.'c'&"]
    spark.createDataFrame([(i, f"u{i}", t) for i, t in enumerate(long)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    check_pages(spark, "g15_top_techniques", str(tmp_path))


@pytest.mark.parametrize("n", range(7))
def test_mean_confidences_round_as_the_sql_does(spark, tmp_path, n):
    """Means halfway between two numbers of six places, and no page at all."""
    texts = (["void 0 ^ chr("] * 9 + ["^"] * (3 + 2 * n) + ["void 0 ^"] + [None] * 32)[: 32 if n else 0]
    spark.createDataFrame([(i, f"u{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    check_pages(spark, "g17_mean_confidences", str(tmp_path))
