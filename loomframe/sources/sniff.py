"""Format detection by content, never by extension."""

from __future__ import annotations

import codecs
import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = 8192


def sniff_bytes(head: bytes) -> str:
    """The format that a file's first bytes show."""
    starts = (
        (b"PAR1", "parquet"), (b"PK\x03\x04", "zip"), (b"PK\x05\x06", "zip"), (b"\x89HDF", "hdf5"), (b"SQLite format 3\x00", "sqlite"),
        (b"\x1f\x8b", "gz"), (b"HEADER RECORD*******LIBRARY HEADER", "xpt"), (b"$FL2", "sav"), (b"<stata_dta>", "dta"), (b"CDF", "netcdf"),
    )
    for magic, name in starts:
        if head.startswith(magic):
            return name
    if len(head) > 2 and head[0] in (113, 114, 115) and head[1] in (1, 2) and head[2] == 1:
        return "dta"
    text = head.lstrip(b"\xef\xbb\xbf \t\r\n")
    low = text[:512].lower()
    if low.startswith((b"<!doctype html", b"<html")) or b"<html" in low:
        return "html"
    if text.startswith(b"<"):
        return "html" if b"<table" in low else "xml"
    if text.startswith((b"{", b"[")):
        if b'"FeatureCollection"' in text:
            return "geojson"
        lines = [x for x in text.split(b"\n") if x.strip()]
        return "jsonl" if len(lines) > 1 and lines[0].rstrip().endswith(b"}") and lines[1].lstrip().startswith(b"{") else "json"
    first = text.split(b"\n", 1)[0]
    return "tsv" if b"\t" in first else "csv" if b"," in first else "txt"


def sniff(path: str) -> str:
    with open(path, "rb") as f:
        return sniff_bytes(f.read(HEAD))


def sniffed(head: Column) -> Column:
    """The same for a column of leading bytes, for formats with a signature."""
    text = F.lower(F.substring(head, 1, 512).cast("string"))
    starts = lambda h: F.startswith(F.hex(F.substring(head, 1, 16)), F.lit(h))
    return (
        F.when(starts("50415231"), "parquet").when(starts("504B0304"), "zip").when(starts("1F8B"), "gz").when(starts("53514C697465"), "sqlite").when(starts("89484446"), "hdf5")
        .when(F.ltrim(text).rlike(r"^<!doctype html|^<html"), "html").when(F.ltrim(text).startswith("<"), "xml")
        .when(F.ltrim(text).rlike(r"^[\[{]"), "json").when(F.substring_index(text, "\n", 1).contains("\t"), "tsv").when(F.substring_index(text, "\n", 1).contains(","), "csv").otherwise("txt")
    )


def sniff_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, sha256, format) of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"), sniffed(F.substring("content", 1, HEAD)).alias("format"))


def encoding_of(head: bytes, whole: bool = False) -> str:
    """The first encoding that reads a file's first bytes, which may end within a character unless they are all of it."""
    for name in ("utf-8", "gbk", "gb18030"):
        try:
            codecs.getincrementaldecoder(name)().decode(head, final=whole)
            return name
        except UnicodeDecodeError:
            continue
    return "latin-1"


def delimiter_of(text: str) -> str:
    try:
        return csv.Sniffer().sniff(text[:4096], delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def preamble_of(text: str, most: int = 12) -> int:
    """Lines before the header: the first with three commas or a tab, none where no line has them."""
    for i, line in enumerate(text.splitlines()[: most + 1]):
        if line.count(",") >= 3 or "\t" in line:
            return i
    return 0
