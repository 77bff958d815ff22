"""Samples from files: content sniffing, text decoding, archives and workspace bundles."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 20 * 1024 * 1024
IGNORED = ("node_modules", ".git", "dist", "build", "__pycache__", "venv", ".venv")
EXTENSIONS = {"js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "ps1": "powershell", "psm1": "powershell", "cs": "csharp", "html": "html", "json": "json", "md": "markdown", "sh": "shell", "txt": "text"}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files of at most 20 MiB that aren't blank."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.where((F.octet_length("text") <= MAX_BYTES) & (F.trim("text") != ""))


def little_endian(content: Column, at: int) -> Column:
    h = F.hex(F.substring(content, at + 1, 4))
    return F.conv(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")


def is_pe(content: Column) -> Column:
    """An executable: 256 bytes or more, "MZ", and a header at the place that bytes 0x3C to 0x3F name."""
    at = little_endian(content, 0x3C)
    head = F.hex(F.call_function("substring", content, (at + 1).cast("int"), F.lit(4)))
    return (F.octet_length(content) >= 0x100) & (F.hex(F.substring(content, 1, 2)) == "4D5A") & (head == "50450000")


def content_kind(content: Column) -> Column:
    """dotnet_binary, pe_binary, archive, binary or text, from the bytes."""
    latin = F.decode(content, "ISO-8859-1")
    first = F.substring(latin, 1, 4096)
    control = F.regexp_count(first, F.lit(r"[\x00-\x08\x0E-\x1F]")) / F.greatest(F.length(first), F.lit(1))
    net = F.lower(latin).contains("mscoree.dll") | F.lower(latin).contains("bsjb")
    magic = F.hex(F.substring(content, 1, 4))
    return F.when(is_pe(content) & net, "dotnet_binary").when(is_pe(content), "pe_binary").when(magic.startswith("504B0304") | magic.startswith("1F8B"), "archive").when(F.substring(latin, 1, 1024).contains("\x00") | (control >= 0.18), "binary").otherwise("text")


def decoded(content: Column) -> Column:
    """UTF-8 if valid, else ISO-8859-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def normal_path(path: Column) -> Column:
    """Forward slashes, no empty or "." part; null for an absolute path or one with ".."."""
    p = F.translate(path, "\\", "/")
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    return F.when(p.startswith("/") | p.rlike("^[A-Za-z]:") | F.array_contains(parts, "..") | (F.size(parts) == 0), None).otherwise(F.array_join(parts, "/"))


def ignored(path: Column) -> Column:
    """Whether a folder above the file is one that holds no source."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, IGNORED)))


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return table[F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))]


def members(files: DataFrame) -> DataFrame:
    """(path, member, content) of zip and tar archives in a binaryFile frame. One archive is read in one task."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                out = []
                try:
                    if zipfile.is_zipfile(io.BytesIO(content)):
                        with zipfile.ZipFile(io.BytesIO(content)) as z:
                            out = [(path, i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
                    else:
                        with tarfile.open(fileobj=io.BytesIO(content)) as t:
                            out = [(path, m.name, t.extractfile(m).read()) for m in t if m.isfile()]
                except (zipfile.BadZipFile, tarfile.TarError, EOFError):
                    out = []  # not an archive
                if out:
                    yield pd.DataFrame(out, columns=["path", "member", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, content binary")


def bundle(files: DataFrame) -> DataFrame:
    """(sample_id, text): the files of each sample as one text of FILE blocks in path order."""
    block = F.concat(F.lit("FILE "), F.col("path"), F.lit("\n"), F.col("text"), F.lit("\nEND FILE\n"))
    rows = files.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("path", block.alias("block")))).alias("blocks"))
    return rows.select("sample_id", F.array_join(F.transform("blocks", lambda b: b["block"]), "").alias("text"))


def unbundle(samples: DataFrame) -> DataFrame:
    """(sample_id, path, text) from texts of FILE blocks."""
    pattern = r"(?ms)^FILE ([^\n]+)\n(.*?)\nEND FILE$"
    zipped = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("path"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("text"))
    return samples.select("sample_id", F.inline(zipped))
