"""Readers from a file to a DataFrame with its format and facts about it.

Text formats, compressed or not, and Parquet are read by Spark in splits.  Formats without a
Spark source (SQLite, HTML, XLSX, Stata, SAS transport, shape files) are decoded by the task that
reads the file (``binaryFile``, at most 2 GB a file); the driver sees their schema and facts
alone.  Heads of files are read through Hadoop's file system, so paths may be of any kind.
Archives are unpacked into the shared folder, from which tasks read.
"""

from __future__ import annotations

import io
import json
import os
import sqlite3
import struct
import tempfile
import uuid
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from ..errors import EngineError
from ..operators.joins import append
from ..operators.reshape import flatten
from . import delimited, payload
from .archive import safe_extract
from .sniff import HEAD, delimiter_of, encoding_of, preamble_of, sniff, sniff_bytes

#: Records of an unwrapped payload in one Arrow batch.
RECORDS = 10_000


@dataclass(frozen=True)
class Source:
    """A table that was read: where from, as what, what is known about it, and its rows."""

    path: str
    fmt: str
    df: DataFrame
    meta: dict = field(default_factory=dict)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in floats}) if floats else df


def head_of(spark: SparkSession, path: str, n: int = 65536) -> bytes:
    """A file's first bytes, unpacked where it is gzipped."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        head = bytes(stream.readNBytes(n))
    finally:
        stream.close()
    return zlib.decompressobj(31).decompress(head, n) if head.startswith(b"\x1f\x8b") else head


def _plain(frame: pd.DataFrame) -> pa.Table:
    """A decoded frame as Arrow: names as text, odd objects as text, missing as null."""
    frame = frame.rename(columns=str)
    for c in frame.columns:
        if frame[c].dtype == object:
            frame[c] = pd.Series([x if x is None or isinstance(x, str) else None if pd.isna(x) else str(x) for x in frame[c]], dtype=object, index=frame.index)
    table = pa.Table.from_pandas(frame, preserve_index=False)
    fields = [pa.field(f.name, pa.string() if pa.types.is_null(f.type) or pa.types.is_large_string(f.type) else pa.timestamp("us") if pa.types.is_timestamp(f.type) else f.type) for f in table.schema]
    return table.cast(pa.schema(fields), safe=False).replace_schema_metadata(None)


def _decoded(spark: SparkSession, path: str, decode: Callable[[bytes], tuple[pd.DataFrame, dict]]) -> tuple[DataFrame, dict]:
    """The rows that ``decode`` finds in a file, and facts about it; a task decodes, once for the schema and once for the rows."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                try:
                    frame, meta = decode(body.as_py())
                    row = [_plain(frame).schema.serialize().to_pybytes(), json.dumps(meta, default=str), None]
                except EngineError as e:
                    row = [None, None, json.dumps([e.code, e.message])]
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.binary()), pa.array([row[1]], pa.string()), pa.array([row[2]], pa.string())], names=["schema", "meta", "error"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                yield from _plain(decode(body.as_py())[0]).to_batches(RECORDS)

    files = spark.read.format("binaryFile").load(path).select("content")
    found = files.mapInArrow(facts, "schema binary, meta string, error string").first()
    if found["error"]:
        raise EngineError(*json.loads(found["error"]), path=path)
    schema = pa.ipc.read_schema(pa.py_buffer(found["schema"]))
    df = files.mapInArrow(rows, from_arrow_schema(schema)) if len(schema) else spark.createDataFrame([], T.StructType([]))
    return nan_to_null(df), json.loads(found["meta"])


def _part(spark: SparkSession, path: str) -> str:
    """The first part of a folder, a file itself."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.getFileStatus(where).isDirectory():
        return path
    return min(f.getPath().toString() for f in fs.listStatus(where) if not f.getPath().getName().startswith(("_", ".")) and f.getLen() > 0)


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> Source:
    """A file or a folder of parts with one schema; ``surplus_rows`` had more cells than the header and are left out."""
    head = head_of(spark, _part(spark, path))
    guess = head.decode(encoding_of(head), errors="replace").lstrip("\ufeff")
    skip = preamble_of(guess)
    rows = delimited.lines(spark, path)
    known = delimited.facts(rows, skip)
    text = head.decode(known.encoding, errors="replace").lstrip("\ufeff")
    sep = sep or delimiter_of("\n".join(text.splitlines()[skip:]))
    cells, header = delimited.cells(delimited.records(rows, known, skip), known, sep)
    df, surplus = delimited.typed(cells, header)
    return Source(path, "tsv" if sep == "\t" else "csv", df, {"encoding": known.encoding, "separator": sep, "skipped_lines": skip, "surplus_rows": surplus})


def read_json(spark: SparkSession, path: str) -> Source:
    """The records of a payload of any shape, or of a folder of payloads, under the schema of all of them."""
    docs = spark.read.text(path, wholetext=True).filter(F.trim("value") != "")
    broken = docs.agg(F.count_if(F.try_parse_json("value").isNull()), F.count("*")).first()
    if broken[0]:
        raise EngineError("PARSE_FAILED", "no JSON", path=path)
    records = payload.explode_records(docs, "value")
    return Source(path, "json", flatten(payload.typed(records)), {"documents": broken[1]})


def read_jsonl(spark: SparkSession, path: str) -> Source:
    return Source(path, "jsonl", flatten(spark.read.json(path)))


def read_parquet(spark: SparkSession, path: str) -> Source:
    return Source(path, "parquet", nan_to_null(spark.read.parquet(path)))


def _row_tag(head: bytes) -> str:
    """The name of the first element within the outermost one, else the outermost one's."""
    parser, names = ET.XMLPullParser(["start"]), []
    parser.feed(head)
    for _, element in parser.read_events():
        names.append(element.tag.rpartition("}")[2])
        if len(names) == 2:
            break
    if not names:
        raise EngineError("PARSE_FAILED", "no element")
    return names[-1]


def read_xml(spark: SparkSession, path: str, row: str | None = None) -> Source:
    if row is None:
        row = _row_tag(head_of(spark, _part(spark, path)))
    return Source(path, "xml", spark.read.option("rowTag", row).xml(path), {"row": row})


def read_geojson(spark: SparkSession, path: str) -> Source:
    df = spark.read.option("multiLine", True).json(path)
    crs = df.select("crs.properties.name").first()[0] if "crs" in df.columns else "urn:ogc:def:crs:OGC:1.3:CRS84"
    rows = df.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("_geometry_type"), F.substring(F.to_json("f.geometry.coordinates"), 1, 2000).alias("_geometry_coords"))
    return Source(path, "geojson", rows, {"crs": crs})


def sqlite_table(body: bytes) -> tuple[pd.DataFrame, dict]:
    """The first table of a database, by name."""
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(body)
        tables = [r[0] for r in db.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name")]
        if not tables:
            raise EngineError("PARSE_FAILED", "no table")
        quoted = tables[0].replace('"', '""')
        return pd.read_sql_query(f'select * from "{quoted}"', db), {"tables": tables}
    finally:
        db.close()


def read_sqlite(spark: SparkSession, path: str) -> Source:
    return Source(path, "sqlite", *_decoded(spark, path, sqlite_table))


#: The spans that HTML allows.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


def _span(raw: str | None, most: int) -> int:
    text = (raw or "").strip()
    return min(max(int(text), 1), most) if text.isascii() and text.isdigit() else 1


def _spread(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Rows with a cell that spans columns or rows repeated in each of them."""
    out, held = [], {}  # column: (text, rows to come)
    for row in rows:
        line: list[str] = []
        cells, going = iter(row), {}

        def take_held():
            while (found := held.pop(len(line), None)) is not None:
                if found[1] > 1:
                    going[len(line)] = (found[0], found[1] - 1)
                line.append(found[0])

        take_held()
        for text, columns, down in cells:
            for _ in range(columns):
                if down > 1:
                    going[len(line)] = (text, down - 1)
                line.append(text)
            take_held()
        for at in sorted(held):
            line += [""] * (at - len(line)) if at > len(line) else []
            if at == len(line):
                text, left = held[at]
                if left > 1:
                    going[at] = (text, left - 1)
                line.append(text)
        held = going
        out.append(line)
    return out


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables: list[list[list[tuple[str, int, int]]]] = []  # cells with their column and row spans
        self.cell: list[str] | None = None
        self.spans = (1, 1)

    def handle_starttag(self, tag, attrs):
        if tag in ("table", "tr", "td", "th"):
            self.close()
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []
            given = dict(attrs)
            self.spans = _span(given.get("colspan"), MOST_COLUMNS), _span(given.get("rowspan"), MOST_ROWS)

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.close()

    def close(self):
        """End the cell, if one is open; its end tag may be left out."""
        if self.cell is not None:
            self.tables[-1][-1].append((" ".join("".join(self.cell).split()), *self.spans))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def first_table(html: str) -> tuple[list[str], list[list[str | None]]]:
    """Header and rows of the first table; none where there is no table.

    Spans are repeated in every place they cover, short rows padded with null, and cells beyond
    the header kept in columns named ``Unnamed: i``.
    """
    parser = _Tables()
    parser.feed(html)
    parser.close()
    rows = _spread([r for r in (parser.tables[0] if parser.tables else []) if r])
    if not rows:
        return [], []
    width = max(map(len, rows))
    header = rows[0] + [f"Unnamed: {i}" for i in range(len(rows[0]), width)]
    return header, [r + [None] * (width - len(r)) for r in rows[1:]]


def html_table(body: bytes) -> tuple[pd.DataFrame, dict]:
    header, rows = first_table(body.decode(encoding_of(body[:65536]), errors="replace"))
    if not header:
        raise EngineError("PARSE_FAILED", "no table")
    seen: dict[str, int] = {}
    names = []
    for h in header:  # a header that spans columns names several
        while (name := f"{h}.{seen[h]}" if seen.setdefault(h, 0) else h) in names:
            seen[h] += 1
        names.append(name)
    return pd.DataFrame(rows, columns=names, dtype=object), {}


def read_html(spark: SparkSession, path: str) -> Source:
    return Source(path, "html", *_decoded(spark, path, html_table))


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(book: zipfile.ZipFile, name: str) -> list[list[object]]:
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
    out = []
    for row in ET.fromstring(book.read(name)).iter(f"{_NS}row"):
        cells: dict[int, object] = {}
        for c in row.iter(f"{_NS}c"):
            col = 0
            for ch in c.get("r", "A"):
                if ch.isalpha():
                    col = col * 26 + ord(ch.upper()) - 64
            v, kind = c.find(f"{_NS}v"), c.get("t")
            if kind == "inlineStr":
                cells[col - 1] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
            elif v is not None and v.text is not None:
                cells[col - 1] = shared[int(v.text)] if kind == "s" else v.text if kind in ("str", "b", "e") else float(v.text)
        out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return out


def first_sheet(body: bytes) -> tuple[pd.DataFrame, dict]:
    with zipfile.ZipFile(io.BytesIO(body)) as book:
        sheets = [s.get("name") for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet")]
        names = sorted(n for n in book.namelist() if n.startswith("xl/worksheets/sheet"))
        rows = sheet_rows(book, names[0])
    header = [str(h) for h in rows[0]] if rows else []
    frame = pd.DataFrame([r + [None] * (len(header) - len(r)) for r in rows[1:]], columns=header)
    return frame, {"sheets": sheets, "sheet_count": len(sheets)}


def read_xlsx(spark: SparkSession, path: str) -> Source:
    return Source(path, "xlsx", *_decoded(spark, path, first_sheet))


def stata_table(body: bytes) -> tuple[pd.DataFrame, dict]:
    with pd.read_stata(io.BytesIO(body), iterator=True, convert_categoricals=False) as f:
        frame = f.read()
        return frame, {"variable_labels": f.variable_labels(), "value_labels": f.value_labels()}


def read_stata(spark: SparkSession, path: str) -> Source:
    df, meta = _decoded(spark, path, stata_table)
    for name, label in meta["variable_labels"].items():
        df = df.withMetadata(name, {"label": label})
    return Source(path, "dta", df, meta)


def xport_table(body: bytes) -> tuple[pd.DataFrame, dict]:
    return pd.read_sas(io.BytesIO(body), format="xport", encoding="utf-8"), {}


def read_xport(spark: SparkSession, path: str) -> Source:
    return Source(path, "xpt", *_decoded(spark, path, xport_table))


def dbf_table(raw: bytes) -> tuple[pd.DataFrame, dict]:
    """Attributes of a shape file's features."""
    n, head, width = struct.unpack_from("<IHH", raw, 4)
    fields, at = [], 32
    while raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode(), chr(raw[at + 11]), raw[at + 16]))
        at += 32
    rows = []
    for i in range(n):
        pos, row = head + i * width + 1, {}
        for name, kind, size in fields:
            text = raw[pos : pos + size].decode("utf-8", "replace").strip()
            row[name] = (float(text) if text else None) if kind in "NF" else text
            pos += size
        rows.append(row)
    return pd.DataFrame(rows, columns=[f[0] for f in fields]), {"feature_count": n}


# The shape types of shape files.
SHAPES = {0: "NULL", 1: "POINT", 3: "POLYLINE", 5: "POLYGON", 8: "MULTIPOINT"}


def read_dbf(spark: SparkSession, path: str) -> Source:
    """Attributes of a shape file, with its shape type from the .shp beside it."""
    base = os.path.splitext(path)[0]
    shape = SHAPES.get(struct.unpack_from("<I", head_of(spark, f"{base}.shp", 36), 32)[0], "OTHER")
    df, meta = _decoded(spark, f"{base}.dbf", dbf_table)
    return Source(path, "shp", df.withColumn("_shape_type", F.lit(shape)), meta)


def _shared_folder(spark: SparkSession) -> str:
    """A new folder that tasks can read: in the shared one where the session names it, else a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        return tempfile.mkdtemp(prefix="loomframe-zip-")
    local = shared.removeprefix("file://").removeprefix("file:").rstrip("/")
    if "://" in local:
        raise EngineError("PARSE_FAILED", "archives are unpacked into a mounted shared folder", folder=shared)
    folder = f"{local}/loomframe-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


def read_zip(spark: SparkSession, path: str) -> Source:
    with zipfile.ZipFile(path) as z:
        if "xl/workbook.xml" in z.namelist():
            return read_xlsx(spark, path)
    members = safe_extract(path, _shared_folder(spark))
    if shapes := [m for m in members if m.endswith(".shp")]:
        return read_dbf(spark, shapes[0])
    tables = [m for m in members if not os.path.basename(m).lower().startswith("metadata") and sniff(m) not in ("html", "hdf5")]
    if not tables:
        raise EngineError("PARSE_UNSUPPORTED_FORMAT", "no table in the archive", path=path)
    return read(spark, max(tables, key=os.path.getsize))


#: Formats that Spark reads from a gzipped file as from a plain one.
GZIPPED = ("csv", "tsv", "txt", "json", "jsonl", "xml", "geojson")


def read_gz(spark: SparkSession, path: str) -> Source:
    """A gzipped file by what it holds: text is unpacked by Spark's readers, all else by the task that decodes it."""
    fmt = sniff_bytes(head_of(spark, path))
    if fmt in GZIPPED:
        return READERS[fmt](spark, path if path.endswith(".gz") else _named_gz(spark, path))
    decode = {"sqlite": sqlite_table, "html": html_table, "dta": stata_table, "xpt": xport_table}.get(fmt)
    if decode is None:
        raise EngineError("PARSE_UNSUPPORTED_FORMAT", f"gzipped {fmt}", path=path)
    return Source(path, fmt, *_decoded(spark, path, lambda body: decode(zlib.decompress(body, 31))))


def _named_gz(spark: SparkSession, path: str) -> str:
    """A copy under a name by which Spark knows that the file is packed."""
    fs = spark._jvm.org.apache.hadoop.fs
    source, target = fs.Path(path), fs.Path(f"{_shared_folder(spark)}/data.gz")
    conf = spark._jsc.hadoopConfiguration()
    fs.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)
    return target.toString()


def unsupported(fmt: str) -> Callable[[SparkSession, str], Source]:
    def fail(spark: SparkSession, path: str) -> Source:
        raise EngineError("PARSE_UNSUPPORTED_FORMAT", f"{fmt} needs a library that isn't installed", path=path)

    return fail


READERS: dict[str, Callable[[SparkSession, str], Source]] = {
    "csv": read_delimited, "tsv": lambda s, p: read_delimited(s, p, "\t"), "txt": read_delimited, "json": read_json, "jsonl": read_jsonl, "parquet": read_parquet,
    "xml": read_xml, "geojson": read_geojson, "sqlite": read_sqlite, "html": read_html, "zip": read_zip, "gz": read_gz, "dta": read_stata, "xpt": read_xport,
    "sav": unsupported("sav"), "netcdf": unsupported("netcdf"), "hdf5": unsupported("hdf5"),
}


def read(spark: SparkSession, path: str) -> Source:
    """The table in a file, or in a folder of Parquet or text parts, by its content."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(where).isDirectory():
        parts = sorted(f.getPath().toString() for f in fs.listStatus(where) if not f.getPath().getName().startswith(("_", ".")) and f.getLen() > 0)
        if not parts or sniff_bytes(head_of(spark, parts[0], HEAD)) == "parquet":
            return read_parquet(spark, path)
        fmt = sniff_bytes(head_of(spark, parts[0]))
        if fmt in GZIPPED and fmt != "geojson":
            return READERS[fmt](spark, path)
        done = [read(spark, p) for p in parts]
        return Source(path, done[0].fmt, append([d.df for d in done]), done[0].meta)
    stream = fs.open(where)
    try:
        head = bytes(stream.readNBytes(HEAD))
    finally:
        stream.close()
    return READERS[sniff_bytes(head)](spark, path)


def json_stat(df: DataFrame, value: str = "value", ids: str = "id", sizes: str = "size") -> DataFrame:
    """Cells of a JSON-stat cube (a map of flat index to value) with a coordinate for each dimension; no product is made."""
    cells = df.select(F.posexplode(F.map_entries(value)).alias("_", "e"), ids, sizes)
    flat = F.col("e.key").cast("long")
    strides = F.transform(F.col(sizes), lambda s, i: F.aggregate(F.slice(F.col(sizes), i + 2, F.size(sizes)), F.lit(1).cast("long"), lambda a, x: a * x))
    coords = F.transform(F.col(sizes), lambda s, i: F.floor(flat / F.element_at(strides, i + 1)) % s)
    return cells.select(F.map_from_arrays(ids, coords).alias("coordinates"), F.col("e.value").alias("value"))

