"""Decoders that Column functions can't express: Arrow-batched scans over one text at a time."""

from __future__ import annotations

import base64
import difflib
import gzip
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.functions import pandas_udf


@pandas_udf(ST.StringType())
def inflate(payload: pd.Series) -> pd.Series:
    """Text inside base64 of zlib, gzip or raw deflate data; null if it is none."""

    def one(x):
        try:
            raw = base64.b64decode(x, validate=True)
        except (ValueError, TypeError):
            return None
        for f in (zlib.decompress, gzip.decompress, lambda r: zlib.decompress(r, -15)):
            try:
                return f(raw).decode("utf-8")
            except (zlib.error, OSError, EOFError, UnicodeDecodeError):
                continue
        return None

    return payload.map(one)


@pandas_udf(ST.StringType())
def decode_base32_85(payload: pd.Series) -> pd.Series:
    """Text of a base32 or base85 string with at least four characters, 70 % of them printable ASCII; else null."""

    def one(x):
        for f in (base64.b32decode, base64.b85decode, base64.a85decode):
            try:
                t = f(x.encode()).decode("utf-8")
            except (ValueError, AttributeError):
                continue
            if len(t) >= 4 and sum(32 <= ord(c) < 127 for c in t) >= 0.7 * len(t):
                return t
        return None

    return payload.map(one)


@pandas_udf(ST.StructType([ST.StructField("key", ST.IntegerType()), ST.StructField("text", ST.StringType()), ST.StructField("score", ST.DoubleType())]))
def xor_recover(payload: pd.Series) -> pd.DataFrame:
    """The single-byte key whose result looks most like text: letters, spaces and common punctuation count."""
    weight = np.zeros(256)
    weight[[*range(32, 127), 9, 10, 13]] = 0.6
    weight[[*range(97, 123), *range(65, 91)]] = 1.0
    weight[list(b"etaoinsrhld")] = 1.5
    weight[32] = 2.0

    def one(x):
        if not x:
            return None, None, None
        counts = np.bincount(np.frombuffer(x, np.uint8), minlength=256)
        best = max(range(1, 256), key=lambda k: counts @ weight[np.arange(256) ^ k])
        plain = bytes(b ^ best for b in x)
        return best, plain.decode("latin-1"), float(counts @ weight[np.arange(256) ^ best]) / len(x)

    return pd.DataFrame([one(x) for x in payload], columns=["key", "text", "score"])


@pandas_udf(ST.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """\\uXXXX, \\xXX, %XX and HTML entities decoded, for U+0020 to U+FFFF."""
    import html
    import re

    unit = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|%([0-9a-fA-F]{2})")

    def swap(m):
        c = int(next(g for g in m.groups() if g), 16)
        return chr(c) if c >= 32 and not 0xD800 <= c < 0xE000 else m[0]

    return text.map(lambda t: t if t is None else html.unescape(unit.sub(swap, t)))


@pandas_udf(ST.StructType([ST.StructField("added", ST.IntegerType()), ST.StructField("removed", ST.IntegerType()), ST.StructField("diff", ST.StringType())]))
def unified_diff(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    out = []
    for a, b in zip(before, after, strict=True):
        d = list(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), "before", "after", lineterm=""))
        out.append((sum(x[:1] == "+" for x in d[2:]), sum(x[:1] == "-" for x in d[2:]), "\n".join(d)))
    return pd.DataFrame(out, columns=["added", "removed", "diff"])


def folded(text: Column) -> Column:
    """Adjacent string literals joined: "a" + "b" becomes "ab"."""
    for _ in range(8):
        text = F.regexp_replace(text, r'"([^"\\\n]*)"\s*\+\s*"([^"\\\n]*)"', '"$1$2"')
    return text


def char_codes(text: Column) -> Column:
    """The text of String.fromCharCode(...) with decimal codes."""
    codes = F.transform(F.split(F.regexp_extract(text, r"String\.fromCharCode\(([\d,\s]+)\)", 1), r"\s*,\s*"), lambda c: F.char(c.cast("int")))
    return F.when(text.rlike(r"String\.fromCharCode\([\d,\s]+\)"), F.array_join(codes, ""))


def decrypt_first(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(sample_id, key_no, plain): each ciphertext under the first key of its sample that yields text. Keys join by sample."""
    tried = rows.join(keys, "sample_id").withColumn("plain", F.try_validate_utf8(F.try_aes_decrypt("cipher", "key", F.lit("ECB"), F.lit("PKCS")).cast("string")))
    return tried.where("plain is not null").groupBy("sample_id").agg(F.min_by(F.struct("key_no", "plain"), "key_no").alias("x")).select("sample_id", "x.key_no", "x.plain")


def rewrite_rounds(samples: DataFrame, steps: list, rounds: int = 4) -> DataFrame:
    """Apply column rewrites in order until a round changes nothing, at most `rounds` times: (sample_id, text, changed)."""

    def once(acc, _):
        text = acc["text"]
        for f in steps:
            text = f(text)
        return F.struct(text.alias("text"), (acc["changed"] + (text != acc["text"]).cast("int")).alias("changed"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.col("text").alias("text"), F.lit(0).alias("changed")), once)
    return samples.select("sample_id", done.alias("x")).select("sample_id", "x.text", "x.changed")
