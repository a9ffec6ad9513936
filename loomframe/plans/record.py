"""Builds that keep a record: rows counted as they pass each step, sources, a digest, and a rebuild that is held against it."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..operators import reshape
from ..sources import readers, sinks
from . import build


@dataclass
class Record:
    """The steps of a build in order.

    Counts come from observations within the job that makes the panel, none from jobs of their
    own, and are there once the panel has been written.  A step that is computed again because an
    executor was lost counts again, so counts are facts for people and never decide anything.
    """

    steps: list[tuple[str, str, dict, str | None, Observation | None, int]] = field(default_factory=list)

    def step(self, df: DataFrame, name: str, operation: str, params: Mapping[str, object], after: str | None = None) -> DataFrame:
        """``df`` with its rows counted under ``name``; ``after`` is the step whose rows it was made from."""
        seen = Observation(f"{len(self.steps)}-{name}")
        self.steps.append((name, operation, dict(params), after, seen, len(df.columns)))
        return df.observe(seen, F.count(F.lit(1)).alias("n"))

    def table(self, spark: SparkSession) -> DataFrame:
        """(seq, step, operation, params, rows_before, rows_after, columns_after): once the panel has been written."""
        counts = {name: seen.get["n"] for name, _, _, _, seen, _ in self.steps}
        rows = [(k, name, op, json.dumps(p, sort_keys=True, default=str), counts.get(after), counts[name], width) for k, (name, op, p, after, _, width) in enumerate(self.steps, 1)]
        return spark.createDataFrame(rows, "seq int, step string, operation string, params string, rows_before long, rows_after long, columns_after int")


def run(config: build.Config, inputs: Mapping[str, DataFrame], filters: Mapping[str, Mapping[str, object]] | None = None, meanings: DataFrame | None = None) -> tuple[DataFrame, Record]:
    """The panel of ``build.run`` and the record of its steps."""
    record = Record()
    watched = {}
    for name in config.inputs:
        wanted = dict((filters or {}).get(name, {}))
        rows = record.step(inputs[name], f"load_{name}", "load_input", {"input": name})
        watched[name] = record.step(reshape.filter_equal(rows, wanted), f"filter_{name}", "filter", wanted, f"load_{name}") if wanted else rows
    if not watched:
        raise EngineError("BUILD_FAILED", "no inputs")
    finer = {name: build.is_finer(reshape.filter_equal(inputs[name], (filters or {}).get(name, {})), config) for name in config.inputs}

    def note(df: DataFrame, name: str, operation: str, params: Mapping[str, object], after: str | None) -> DataFrame:
        return record.step(df, name, operation, params, after)

    return build.assemble(config, watched, finer, meanings, note), record


#: Moves short decimals away from halves; a fixed part of the digest.
OFF_HALF = 1.0471975511965976


def _told(c: str, kind: T.DataType) -> Column:
    """A value as text that doesn't hang on the order in which fractions were added.

    Sums of cents often lie halfway between two texts of ten digits, where the last bit decides;
    times OFF_HALF they don't.
    """
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.format_string("%.9e", F.col(f"`{c}`").cast("double") * OFF_HALF)
    return F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else F.col(f"`{c}`").cast("string")


def digest(df: DataFrame) -> dict[str, object]:
    """Rows, sum and exclusive-or of the rows' hashes: equal for equal sets of rows with repeats, in any order of rows and columns."""
    h = F.xxhash64(*[F.coalesce(F.concat(F.lit("="), _told(c, df.schema[c].dataType)), F.lit("null")) for c in sorted(df.columns)])
    row = df.select(h.alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return {"rows": row[0], "sum": str(row[1] or 0), "xor": row[2] or 0, "columns": sorted(df.columns)}


@dataclass(frozen=True)
class Raw:
    """A raw file of a build: where it is, and what it was."""

    name: str
    path: str
    sha256: str
    facts: Mapping[str, str] = field(default_factory=dict)


def raw(spark: SparkSession, name: str, path: str, **facts: str) -> Raw:
    """A raw file or folder with its checksum: the hash of its files' hashes, by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("h"))
    total = files.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: x["h"]), ""), 256)).first()[0]
    return Raw(name, path, total, facts)


REBUILD = '''"""Builds the final table of this package anew from its raw files and compares it with what was recorded."""
import pathlib
from loomframe.plans import record
from loomframe.session import get_session
here = pathlib.Path(__file__).resolve().parent.parent
record.rebuild(get_session("local[*]"), str(here)).write.mode("overwrite").parquet(str(here / "data" / "repeated.parquet"))
print("repeated")
'''


def export(config: build.Config, raws: Sequence[Raw], spark: SparkSession, folder: str, filters: Mapping[str, Mapping[str, object]] | None = None) -> DataFrame:
    """Build from raw files and write the package; returns the operations with their counts and the source each input came from."""
    folder = folder.rstrip("/")
    panel, record = run(config, {r.name: readers.read(spark, r.path).df for r in raws}, filters)
    log = sinks.OperationLog()
    sinks.export_package(panel, folder, log, sources=[{"name": r.name, "path": r.path, "sha256": r.sha256, **r.facts} for r in raws], script=REBUILD)
    operations = record.table(spark)
    sources = spark.createDataFrame([(f"load_{r.name}", r.path, r.sha256) for r in raws], "step string, path string, sha256 string")
    joined = operations.join(F.broadcast(sources), "step", "left")  # a row for each step
    stored = {"config": asdict(config), "filters": dict(filters or {}), "digest": digest(spark.read.parquet(f"{folder}/data/final.parquet"))}
    sinks.write_text(spark, json.dumps(stored, indent=1, default=str), f"{folder}/metadata/build.json")
    sinks.write_text(spark, "".join(json.dumps(r.asDict(), ensure_ascii=False) + "\n" for r in joined.orderBy("seq").collect()), f"{folder}/provenance/operations.jsonl")
    return joined


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """The panel built anew from the raw files that a package names, by its stored config; refused where files or rows differ."""
    stored = json.loads(_text(spark, f"{folder}/metadata/build.json"))
    frames = {}
    for line in _text(spark, f"{folder}/provenance/sources.jsonl").splitlines():
        source = json.loads(line)
        if raw(spark, source["name"], source["path"]).sha256 != source["sha256"]:
            raise EngineError("CHECKSUM_MISMATCH", "a raw file has changed", path=source["path"])
        frames[source["name"]] = readers.read(spark, source["path"]).df
    kept = stored["config"]
    config = build.Config(tuple(kept["inputs"]), kept["unit"], tuple(kept["keys"]), kept["frequency"], kept["methods"], kept["missing"], tuple(map(tuple, kept["derived"])), kept["allow_mm"])
    panel = build.run(config, frames, stored["filters"])
    found = digest(panel)
    if found != stored["digest"]:
        raise EngineError("REPRODUCE_MISMATCH", f"recorded {stored['digest']}, rebuilt {found}", path=folder)
    return panel
