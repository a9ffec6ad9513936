"""Delimited text in splits, in any encoding that holds ASCII bytes as themselves, with line breaks inside quotes.

Lines are read as bytes.  A first pass reports, for each split of each file, the parity of its
quotes and the encodings that fail on its lines.  Where all lines are even, every line is a
record.  Else a prefix xor over a file's splits gives the parity at which each of them starts,
and a second pass cuts records in each split alone: what an open quote holds together goes on
over lines, and the pieces at a split's edges (at most two for each) meet in one shuffle.  The
driver holds a pair of facts for each split, as it holds the splits themselves.

Rows with more cells than the header are left out and counted; shorter rows end in nulls; blank
lines are skipped; a column holds long, double or boolean values if all its values can be read so.
"""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tried in this order; the first that reads all lines is taken.
ENCODINGS = ("utf-8", "gbk", "gb18030", "latin-1")
#: What counts as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
BOM = codecs.BOM_UTF8


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, at, line): the bytes of every line, in order of ``at`` within a split."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line"))


def _looker(skip: int, quote: bytes):
    """(file, start, line) to (file, start, parity, odd, failing, header): facts about a split, with the encodings that fail on it and a file's first record."""

    def failing(body: bytes) -> list[int]:
        out = []
        for k, name in enumerate(ENCODINGS):
            try:
                body.decode(name)
                break
            except UnicodeDecodeError:
                out.append(k)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list] = {}
        for batch in batches:
            files, starts, bodies = (c.to_pylist() for c in batch.columns)
            for key, group in groupby(zip(files, starts, bodies, strict=True), lambda r: r[:2]):
                mine = [r[2] for r in group]
                fact = seen.setdefault(key, [0, False, set(), skip if key[1] == 0 else 0, b"", key[1] != 0])
                fact[2].update(failing(b"\n".join(mine)))
                for line in mine[fact[3] :]:
                    if line.count(quote) % 2:
                        fact[0] ^= 1
                        fact[1] = True
                    if not fact[5] and (fact[4] or line.strip()):
                        fact[4] += line.removeprefix(BOM) + b"\n"
                        fact[5] = not fact[0]
                fact[3] = max(0, fact[3] - len(mine))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(*k, p, odd, sorted(bad), head or None) for k, (p, odd, bad, _, head, _) in seen.items()], strict=True), _FACTS.types, strict=True)], schema=_FACTS)

    return run


_FACTS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("parity", pa.int32()), ("odd", pa.bool_()), ("failing", pa.list_(pa.int32())), ("header", pa.binary())])
_CUT = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])
#: Kinds of pieces: a whole record, the end of one that began in an earlier split, the middle of one, the beginning of one.
WHOLE, END, MIDDLE, BEGIN = range(4)


def _cutter(opens: dict[tuple[str, int], int], skip: int, quote: bytes):
    """Sorted (file, start, line) to the pieces (file, start, kind, body) of records; a file's ``skip`` first lines and its first record, the header, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parity, held, begun, left, header = None, 0, [], True, 0, False

        def closed(kind: int) -> tuple:
            return (*key, kind, b"\n".join(held))

        for batch in batches:
            out = []
            for file, start, line in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (file, start) != key:
                    if held:
                        out.append(closed(BEGIN if begun else MIDDLE))
                    key, held = (file, start), []
                    parity = opens.get(key, 0)
                    begun, left, header = not parity, skip if start == 0 else 0, start == 0
                    line = line.removeprefix(BOM) if start == 0 else line
                if left or (header and not held and not line.strip()):
                    left = max(0, left - 1)
                    continue
                held.append(line)
                parity ^= line.count(quote) % 2
                if not parity:
                    if not header:
                        out.append(closed(WHOLE if begun else END))
                    held, begun, header = [], True, False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _CUT.types, strict=True)], schema=_CUT)
        if held:
            out = [closed(BEGIN if begun else MIDDLE)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _CUT.types, strict=True)], schema=_CUT)

    return run


def _celler(encoding: str, sep: str, quote: str, width: int):
    """Bodies of records to their cells; null for rows with surplus cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        for batch in batches:
            text = "\n".join(b.decode(encoding).removesuffix("\r") for b in batch.column(0).to_pylist())
            rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep, quotechar=quote) if len(r) > 1 or (r and r[0].strip())]
            cells = [r + [None] * (width - len(r)) if len(r) <= width else None for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.list_(pa.string()))], names=["cells"])

    return run


def _joined(pieces: DataFrame) -> DataFrame:
    """Pieces at the edges of splits put together: each record's beginning with what follows up to its end."""
    order = Window.partitionBy("file").orderBy("start", "kind")  # at most two rows for each split, an end before a beginning
    numbered = pieces.withColumn("record", F.sum((F.col("kind") == BEGIN).cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", "kind", F.hex("body").alias("h"))))
    return numbered.groupBy("file", "record").agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["h"]), "0A")).alias("body")).select("file", "body")


@dataclass(frozen=True)
class Facts:
    """What the first pass found: the encoding that reads all lines, the parity of quotes at the start of each split, each file's header."""

    encoding: str
    opens: dict[tuple[str, int], int]
    headers: dict[str, str]


def facts(rows: DataFrame, skip: int = 0, quote: str = '"') -> Facts:
    found = rows.sortWithinPartitions("file", "start", "at").select("file", "start", "line").mapInArrow(_looker(skip, quote.encode()), "file string, start long, parity int, odd boolean, failing array<int>, header binary").collect()  # a row for each split
    failing = {k for r in found for k in r["failing"]}
    encoding = next(name for k, name in enumerate(ENCODINGS) if k not in failing)
    opens: dict[tuple[str, int], int] = {}
    if any(r["odd"] for r in found):
        parity = {(r["file"], r["start"]): r["parity"] for r in found}
        for _, splits in groupby(sorted(parity), lambda k: k[0]):
            run = 0
            for key in splits:
                opens[key], run = run, run ^ parity[key]
    return Facts(encoding, opens, {r["file"]: bytes(r["header"]).decode(encoding) for r in found if r["header"]})


def records(rows: DataFrame, known: Facts, skip: int = 0, quote: str = '"') -> DataFrame:
    """(file, body): the bytes of every record but the headers."""
    ordered = rows.sortWithinPartitions("file", "start", "at").select("file", "start", "line")
    cut = ordered.mapInArrow(_cutter(known.opens, skip, quote.encode()), "file string, start long, kind int, body binary")
    if not any(known.opens.values()):
        return cut.select("file", "body")
    return cut.filter(F.col("kind") == WHOLE).select("file", "body").union(_joined(cut.filter(F.col("kind") != WHOLE)))


def cells(bodies: DataFrame, known: Facts, sep: str, quote: str = '"') -> tuple[DataFrame, list[str]]:
    """(cells) of every record under the union of the files' columns, and the columns' names."""
    named = {file: tuple(_names(next(csv.reader(io.StringIO(text, newline=""), delimiter=sep, quotechar=quote)))) for file, text in sorted(known.headers.items())}
    kinds: dict[tuple[str, ...], list[str]] = {}
    for file, names in named.items():
        kinds.setdefault(names, []).append(file)
    columns = list(dict.fromkeys(n for names in kinds for n in names))
    out = []
    most = max(kinds, key=lambda k: len(kinds[k]), default=())
    others = [f for names, files in kinds.items() if names != most for f in files]
    for names, files in kinds.items():
        mine = bodies if len(kinds) == 1 else bodies.filter(~F.col("file").isin(others) if names == most else F.col("file").isin(files))
        made = mine.select("body").mapInArrow(_celler(known.encoding, sep, quote, len(names)), "cells array<string>")
        if len(kinds) > 1:
            at = F.array(*[F.col("cells")[names.index(c)] if c in names else F.lit(None).cast("string") for c in columns])
            made = made.select(F.when(F.col("cells").isNotNull(), at).alias("cells"))
        out.append(made)
    return reduce(DataFrame.union, out) if out else bodies.sparkSession.createDataFrame([], "cells array<string>"), columns


def _names(header: list[str]) -> list[str]:
    """Stripped names, made up for empty ones and numbered where they repeat."""
    out: list[str] = []
    for k, name in enumerate(n.strip() or f"Unnamed: {k}" for k, n in enumerate(header)):
        same = sum(1 for h in header[:k] if h.strip() == name)
        out.append(f"{name}.{same}" if same else name)
    return out


def _known(c: Column) -> Column:
    return F.when(~c.isin(*MISSING), c)


INTEGER = r"^\s*[+-]?\d+\s*$"
NUMBER = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?(inf|Infinity|infinity))\s*$"
BOOLEAN = r"^(True|TRUE|true|False|FALSE|false)$"


def typed(rows: DataFrame, header: list[str]) -> tuple[DataFrame, int]:
    """Columns of the narrowest type that holds all their values, and the number of rows with surplus cells."""
    at = [_known(F.col("cells")[i]) for i in range(len(header))]
    whole = lambda c: c.rlike(INTEGER) & F.trim(c).try_cast("long").isNotNull()
    tests = [[F.bool_and(whole(c)), F.bool_and(c.rlike(NUMBER)), F.bool_and(c.rlike(BOOLEAN))] for c in at]
    found = rows.agg(F.count_if(F.col("cells").isNull()), *[t for three in tests for t in three]).first()
    kinds = []
    for i in range(len(header)):
        long, double, boolean = found[1 + 3 * i : 4 + 3 * i]
        kinds.append("long" if long else "double" if double else "boolean" if boolean else "string")
    cast = lambda c, kind: c if kind == "string" else F.trim(c).try_cast(kind)
    return rows.filter("cells is not null").select(*[cast(c, kind).alias(name) for c, kind, name in zip(at, kinds, header, strict=True)]), found[0]
