"""Sinks and the package that goes with a result: operations, lineage, checks, checksums and a script to repeat it."""

from __future__ import annotations

import csv
import html
import io
import json
import os
import zipfile
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError

# What a worksheet can hold besides its header.
XLSX_ROWS, XLSX_COLUMNS = 1_048_575, 16_000


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_encoded_csv(df: DataFrame, path: str, encoding: str) -> None:
    """CSV parts with headers in any encoding that Python knows and that holds ASCII bytes as themselves; Spark's writer knows few."""
    names = df.columns

    def lines(batches):
        def encoded(rows) -> pa.RecordBatch:
            out = []
            for row in rows:
                text = io.StringIO()
                csv.writer(text, lineterminator="").writerow(row)
                out.append(text.getvalue().encode(encoding))
            return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["line"])

        yield encoded([names])
        for batch in batches:
            yield encoded(zip(*[c.to_pylist() for c in batch.columns], strict=True))

    df.mapInArrow(lines, "line binary").select(F.col("line").cast("string").alias("value")).write.mode("errorifexists").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def _cell(row: int, col: int, value: object) -> str:
    if value is None:
        return ""
    at = f"{_letters(col)}{row}"
    if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) != float("inf"):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    text = "".join(ch for ch in str(value) if ch >= " " or ch in "\t\n\r")
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_xlsx(df: DataFrame, path: str) -> None:
    """One worksheet, row by row; tables beyond a worksheet's size are refused before any row is read."""
    if len(df.columns) > XLSX_COLUMNS or df.limit(XLSX_ROWS + 1).count() > XLSX_ROWS:
        raise EngineError("EXPORT_TOO_LARGE", "more rows or columns than a worksheet holds", path=path)
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f"<worksheet {main}><sheetData>".encode())
            rows = df.toLocalIterator()
            for i, row in enumerate([df.columns]):
                sheet.write(f'<row r="{i + 1}">{"".join(_cell(i + 1, j, v) for j, v in enumerate(row))}</row>'.encode())
            for i, row in enumerate(rows, 2):
                sheet.write(f'<row r="{i}">{"".join(_cell(i, j, v) for j, v in enumerate(row))}</row>'.encode())
            sheet.write(b"</sheetData></worksheet>")


SINKS = {"parquet": write_parquet, "csv": write_csv, "json": write_json, "xlsx": write_xlsx}


def export(df: DataFrame, fmt: str, path: str) -> None:
    if fmt not in SINKS:
        raise EngineError("EXPORT_UNSUPPORTED_FORMAT", fmt)
    SINKS[fmt](df, path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, length) of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), "length")


@dataclass
class OperationLog:
    """The operations of a build in order, and which source columns each result column comes from."""

    operations: list[tuple[int, str, str, int | None, int | None]] = field(default_factory=list)
    lineage: list[tuple[str, str, str, str]] = field(default_factory=list)

    def record(self, kind: str, params: Mapping[str, object], rows_before: int | None = None, rows_after: int | None = None) -> int:
        self.operations.append((len(self.operations) + 1, kind, json.dumps(params, sort_keys=True, ensure_ascii=False, default=str), rows_before, rows_after))
        return len(self.operations)

    def derived(self, column: str, source: str, source_columns: Sequence[str], operation: str) -> None:
        self.lineage += [(column, source, c, operation) for c in source_columns]

    def operations_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.operations, "seq int, operation string, params string, rows_before long, rows_after long")

    def lineage_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.lineage, "column_name string, source string, source_column string, operation string")

    def methodology(self) -> str:
        lines = ["# Methodology", ""]
        for seq, kind, params, before, after in self.operations:
            counts = "" if before is None or after is None else f" ({before} rows before, {after} after)"
            lines.append(f"{seq}. **{kind}**{counts}: `{params}`")
        lines += ["", "## Columns", ""]
        lines += [f"- `{c}`: `{source}`.`{s}` by {op}" for c, source, s, op in self.lineage]
        return "\n".join(lines) + "\n"


def quality_html(checks: DataFrame, most: int = 10_000) -> str:
    """The rows of a checks table (code, severity, field, affected), at most ``most``: checks grow with columns, not rows."""
    rows = checks.limit(most).collect()
    cells = lambda r: "".join(f"<td>{html.escape('' if x is None else str(x))}</td>" for x in r)
    head = "".join(f"<th>{html.escape(c)}</th>" for c in checks.columns)
    return f"<!doctype html><meta charset='utf-8'><title>Quality</title><table><tr>{head}</tr>{''.join(f'<tr>{cells(r)}</tr>' for r in rows)}</table>"


def variables(df: DataFrame) -> list[dict[str, str]]:
    return [{"name": n, "type": t, "role": "imputation_mask" if n.startswith("__imputed_") else "variable"} for n, t in df.dtypes]


REPEAT = '''"""Checks the raw files of this package and writes the final table again."""
import hashlib, json, pathlib, sys
here = pathlib.Path(__file__).resolve().parent.parent
for line in (here / "provenance" / "sources.jsonl").read_text().splitlines():
    source = json.loads(line)
    found = hashlib.sha256(pathlib.Path(source["path"]).read_bytes()).hexdigest()
    if found != source["sha256"]:
        sys.exit(f"{source['path']} has changed")
from loomframe.session import get_session
get_session("local[*]").read.parquet(str(here / "data" / "final.parquet")).write.mode("overwrite").parquet(str(here / "data" / "repeated.parquet"))
print("repeated")
'''


def _store(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small file in the store that Spark writes to."""
    fs, at = _store(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _store(spark, path)
    return fs.exists(at)


def export_package(df: DataFrame, path: str, log: OperationLog, checks: DataFrame | None = None, sources: Sequence[Mapping[str, str]] = (), script: str = "") -> list[str]:
    """The final table with its metadata, provenance, reports and script; the files made, all of them there."""
    spark, path = df.sparkSession, path.rstrip("/")
    write_parquet(df, f"{path}/data/final.parquet")
    texts = {
        "metadata/variables.json": json.dumps(variables(df), indent=1, ensure_ascii=False),
        "provenance/operations.jsonl": "".join(json.dumps(dict(zip(("seq", "operation", "params", "rows_before", "rows_after"), o, strict=True)), ensure_ascii=False) + "\n" for o in log.operations),
        "provenance/lineage.jsonl": "".join(json.dumps(dict(zip(("column", "source", "source_column", "operation"), x, strict=True)), ensure_ascii=False) + "\n" for x in log.lineage),
        "provenance/sources.jsonl": "".join(json.dumps(dict(s), ensure_ascii=False) + "\n" for s in sources),
        "reports/methodology.md": log.methodology(),
        "reports/quality_report.html": quality_html(checks) if checks is not None else "<!doctype html><p>No checks.</p>",
        "scripts/reproduce.py": script or REPEAT,
    }
    for name, text in texts.items():
        write_text(spark, text, f"{path}/{name}")
    sums = checksums(spark, f"{path}/data/final.parquet").filter(F.endswith("file", F.lit(".parquet")))
    manifest = {"files": ["data/final.parquet", *texts], "sha256": {r["file"]: r["sha256"] for r in sums.toLocalIterator()}}
    write_text(spark, json.dumps(manifest, indent=1), f"{path}/metadata/manifest.json")
    made = [*manifest["files"], "metadata/manifest.json"]
    if lost := [m for m in made if not exists(spark, f"{path}/{m}")]:
        raise EngineError("PACKAGE_INCOMPLETE", ", ".join(lost))
    return made
