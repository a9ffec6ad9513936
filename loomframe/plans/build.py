"""Panel builds: a plan from the inputs' columns, its review, and its run as one lazy frame.

A plan names keys, the join and a yearly aggregate for each variable; a config is what is run.
Planning looks at column names alone; running is DataFrame work: years from wide columns, time
values to years, entities to codes, aggregates where rows are finer than years, guarded joins
(or an append without keys), a missing-value policy, derived variables, checks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import entities, formula, timeparse, units
from ..operators import aggregate, joins, missing, reshape, validate
from . import semantics

# What a variable's name says about its yearly aggregate, in the order in which markers count.
AGGREGATES = {
    "rate": "mean", "share": "mean", "ratio": "mean", "index": "mean", "price": "mean", "percent": "mean",
    "revenue": "sum", "expenditure": "sum", "export": "sum", "import": "sum", "investment": "sum", "emission": "sum", "patent": "sum",
    "stock": "last", "population": "last", "balance": "last", "area": "last",
}
# Keys of each unit of analysis; individuals have none and are appended.
KEYS = {
    "country": ("iso3", "year"), "province": ("province_code", "year"), "city": ("city_code", "year"), "prefecture": ("city_code", "year"),
    "firm": ("entity_key", "year"), "university": ("entity_key", "year"), "entity": ("entity_key", "year"), "individual": (),
}
GENERIC = ("firm", "university", "entity")
STEPS = ("input_compatibility", "semantic_mapping", "entity_resolution", "time_alignment", "join", "missing_policy", "derived_variables", "validation", "export")


@dataclass(frozen=True)
class Asset:
    """An input: its columns, and the canonical names of its variables."""

    name: str
    columns: Sequence[str]
    variables: Sequence[str] = ()


@dataclass(frozen=True)
class Point:
    """Something that a person should look at."""

    severity: str
    topic: str
    field: str | None
    message: str


@dataclass(frozen=True)
class Join:
    left: str
    right: str
    keys: tuple[str, ...]
    cardinality: str = "1:1"
    how: str = "inner"


@dataclass(frozen=True)
class Plan:
    inputs: tuple[str, ...]
    entity: str = "unknown"
    time: str = "annual"
    joins: tuple[Join, ...] = ()
    aggregations: tuple[tuple[str, str], ...] = ()
    missing: str = "none"
    derived: tuple[tuple[str, str], ...] = ()
    points: tuple[Point, ...] = ()


@dataclass(frozen=True)
class Config:
    """What is run: keys, a method for each variable that has one, policies and derived variables (name, formula)."""

    inputs: tuple[str, ...]
    unit: str
    keys: tuple[str, ...]
    frequency: str = "annual"
    methods: Mapping[str, str] = field(default_factory=dict)
    missing: str = "none"
    derived: tuple[tuple[str, str], ...] = ()
    allow_mm: bool = False
    points: tuple[Point, ...] = ()


def method_of(variable: str) -> str | None:
    """The aggregate that a variable's name suggests; None where it suggests none."""
    name = variable.lower()
    return next((method for marker, method in AGGREGATES.items() if marker in name), None)


def make_plan(assets: Sequence[Asset]) -> Plan:
    """Country and year as keys where every input shows both; what stays open becomes a review point."""
    points: list[Point] = []
    if not assets:
        return Plan((), points=(Point("blocking", "build", None, "no inputs"),))
    place = all(any("iso3" in c or "country" in c.lower() for c in a.columns) for a in assets)
    time = all(any(c.lower() in ("year", "time") or c.isdigit() for c in a.columns) for a in assets)
    found, steps = "unknown", ()
    if place and time:
        found = "country"
        if len(assets) > 1:
            steps = (Join(assets[0].name, assets[1].name, KEYS["country"]),)
    else:
        points.append(Point("blocking", "keys", None, "inputs lack a column of places or of times"))
    methods = []
    for asset in assets:
        for variable in asset.variables:
            method = method_of(variable)
            methods.append((variable, method or "none"))
            if method is None:
                points.append(Point("warning", "aggregation", variable, "no aggregate follows from the name"))
    return Plan(tuple(a.name for a in assets), found, joins=steps, aggregations=tuple(methods), points=tuple(points))


def review(plan: Plan) -> list[Point]:
    """What keeps a plan from being run (blocking) or should be decided (warning)."""
    out = [] if plan.inputs else [Point("blocking", "build", None, "no inputs")]
    for j in plan.joins:
        if j.cardinality == "m:m":
            out.append(Point("blocking", "join", f"{j.left},{j.right}", "both sides repeat keys"))
        if not j.keys:
            out.append(Point("blocking", "join", f"{j.left},{j.right}", "no keys"))
    if open_ := [v for v, m in plan.aggregations if m == "none"]:
        out.append(Point("warning", "aggregation", ",".join(open_[:5]), "no aggregate chosen"))
    return out


def configure(plan: Plan) -> Config:
    """The config of a plan: keys of its first join or of its unit; variables without an aggregate pass through and are marked."""
    unit = "country" if plan.entity == "unknown" else plan.entity
    keys = plan.joins[0].keys if plan.joins and plan.joins[0].keys else KEYS.get(unit, KEYS["country"])
    points = list(plan.points) + [Point("warning", "aggregation", v, "passed through") for v, m in plan.aggregations if m == "none"]
    if unit == "individual" or unit in GENERIC:
        points.append(Point("warning", "entity_resolution", None, f"{unit}: keys stay null"))
    return Config(plan.inputs, unit, tuple(keys), plan.time, {v: m for v, m in plan.aggregations if m != "none"}, plan.missing, plan.derived, points=tuple(points))


def steps(spark: SparkSession, config: Config) -> DataFrame:
    """(step, kind, parameters, warning): the nine steps of a build, for a person to read."""
    parameters = {
        "input_compatibility": ",".join(config.inputs), "entity_resolution": config.unit, "time_alignment": config.frequency, "join": ",".join(config.keys),
        "missing_policy": config.missing, "derived_variables": ",".join(f for _, f in config.derived),
    }
    warnings = {
        "join": "m:m joins are allowed" if config.allow_mm else "m:m joins are blocked",
        "missing_policy": "" if config.missing == "none" else f"filled by {config.missing}; filled cells are marked",
    }
    return spark.createDataFrame([(f"s{i}", kind, parameters.get(kind, ""), warnings.get(kind, "")) for i, kind in enumerate(STEPS, 1)], "step string, kind string, parameters string, warning string")


def same_name_conflicts(spark: SparkSession, inputs: Mapping[str, Sequence[units.Meaning]]) -> list[Point]:
    """Variables of one name in several inputs whose meanings can't stand in one column."""
    return [Point("blocking", "semantics", variable, f"{facet}: {message}") for severity, variable, facet, message in semantics.scan(semantics.declared(spark, inputs)) if severity == "blocking"]


def canonical_keys(keys: Sequence[str]) -> list[str]:
    """Keys under the names that the inputs have once they are canonical."""
    return [{"country": "iso3", "country_name": "iso3"}.get(k, k) for k in keys] or list(KEYS["country"])


def single_names(df: DataFrame) -> DataFrame:
    """The first of the columns that share a name."""
    seen: set[str] = set()
    keep = [i for i, c in enumerate(df.columns) if not (c in seen or seen.add(c))]
    if len(keep) == len(df.columns):
        return df
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(*[F.col(f"_{i}").alias(df.columns[i]) for i in keep])


def canonical(df: DataFrame, config: Config) -> DataFrame:
    """An input with an integer ``year`` and its entity's code."""
    df = reshape.wide_to_long(single_names(df))
    time = timeparse.find_time_column(df)
    if time is not None:
        rows = timeparse.with_time(df, time, "_time").withColumn("_granularity", F.col("_time.granularity")).withColumn("_within", F.struct("_time.quarter", "_time.month", "_time.day"))
        df = rows.withColumn("year", F.col("_time.year")).drop("_time", *([time] if time != "year" else []))
    return with_entity(df, config.unit)


def with_entity(df: DataFrame, unit: str) -> DataFrame:
    by_name = {c.lower().replace(" ", "_"): c for c in reversed(df.columns)}
    first = lambda names: next((c for c in df.columns if c.lower().replace(" ", "_") in names), None)
    if unit == "individual":
        return df
    if unit in GENERIC:
        return df.withColumn("entity_key", F.lit(None).cast("string"))
    if unit == "country":
        column = first(entities.COLUMN_NAMES["country"])
        return df if column is None or "iso3" in by_name else entities.resolve_countries(df, column, fuzzy=False)
    level = "province" if unit == "province" else "prefecture"
    column = first(entities.COLUMN_NAMES[level])
    key = KEYS[unit][0]
    if column is None:
        return df.withColumn(key, F.lit(None).cast("string"))
    named = df.withColumn(f"{column}_original", F.col(column))
    return entities.resolve_regions(named, column, level, F.col("year") if "year" in df.columns else None, out=f"_{key}").drop(*([key] if key in df.columns else [])).withColumnRenamed(f"_{key}", key)


def is_finer(df: DataFrame, config: Config) -> bool:
    """Whether an input holds rows of months, quarters or days."""
    rows = canonical(df, config)
    return config.frequency == "annual" and "_granularity" in rows.columns and not rows.filter(F.col("_granularity").isin(*aggregate.FINER)).isEmpty()


def annual(df: DataFrame, config: Config, finer: bool) -> DataFrame:
    """One row for each entity and year where rows are finer; a variable without a method keeps its first value."""
    marks = [c for c in ("_granularity", "_within") if c in df.columns]
    if not finer:
        return df.drop(*marks)
    group = [k for k in canonical_keys(config.keys) if k in df.columns] if config.keys else []
    values = [c for c in reshape.numeric_columns(df) if c not in (*group, "year")]
    others = [c for c in df.columns if c not in (*group, *values, *marks, "year")]
    at = F.col("_within")
    out = [aggregate.method_expr(c, config.methods.get(c, "none"), at).alias(c) for c in values] + [aggregate.method_expr(c, "first", at).alias(c) for c in others]
    return df.groupBy(*dict.fromkeys([*group, "year"])).agg(*out)


#: What is told of each step: (rows, name, operation, parameters, the step before) to the rows.
Note = Callable[[DataFrame, str, str, Mapping[str, object], str | None], DataFrame]


def assemble(config: Config, frames_in: Mapping[str, DataFrame], finer: Mapping[str, bool], meanings: DataFrame | None = None, note: Note = lambda df, *_: df) -> DataFrame:
    """The panel of inputs that are filtered already; conflicts of meaning stop it."""
    if meanings is not None and (found := [x for x in semantics.scan(meanings) if x[0] == "blocking"]):
        raise EngineError("SEMANTIC_CONFLICT", "; ".join(f"{variable} {facet}: {message}" for _, variable, facet, message in found))
    frames = []
    for i, name in enumerate(config.inputs, 1):
        df = canonical(frames_in[name], config)
        df = note(df, f"canonical_{name}", "canonicalize_input", {"input": name, "unit": config.unit}, f"load_{name}")
        df = annual(df, config, finer[name])
        if finer[name]:
            df = note(df, f"annual_{name}", "aggregate_to_year", dict(config.methods), f"canonical_{name}")
        frames.append(df.withColumnRenamed("value", f"value_i{i}") if "value" in df.columns else df)
    if not frames:
        raise EngineError("BUILD_FAILED", "no inputs")
    keys = canonical_keys(config.keys) if config.keys else []
    before = ("annual_" if finer[config.inputs[0]] else "canonical_") + config.inputs[0]
    panel = frames[0]
    if len(frames) > 1 and not keys:
        panel = note(joins.append(frames), "append", "append", {}, before)
        before = "append"
    elif len(frames) > 1:
        for name, right in zip(config.inputs[1:], frames[1:], strict=True):
            panel = joins.safe_join(panel, right, keys, allow_mm=config.allow_mm).df
            panel = note(panel, f"join_{name}", "join", {"keys": keys, "right": name}, before)
            before = f"join_{name}"
    values = [c for c in reshape.numeric_columns(panel) if c not in (*keys, "year")]
    order = [k for k in ("year",) if k in panel.columns]
    if values:
        panel = missing.fill(panel, values, config.missing, [k for k in keys if k != "year" and k in panel.columns], order)
    for name, text in config.derived:
        panel = formula.derive(panel, text, name, [t for kind, t in formula.tokens(text) if kind == "name"])
    return note(panel, "panel", "missing_and_derived", {"missing": config.missing, "derived": [n for n, _ in config.derived]}, before)


def run(config: Config, inputs: Mapping[str, DataFrame], filters: Mapping[str, Mapping[str, object]] | None = None, meanings: DataFrame | None = None) -> DataFrame:
    """The panel: lazy, but for the joins' guards, the look at each input's time notation and the scan of meanings, where they are stated."""
    if missing_ := [n for n in config.inputs if n not in inputs]:
        raise EngineError("NOT_FOUND", f"inputs {missing_} are not there")
    frames = {n: reshape.filter_equal(inputs[n], (filters or {}).get(n, {})) for n in config.inputs}
    return assemble(config, frames, {n: is_finer(df, config) for n, df in frames.items()}, meanings)


def checks(config: Config, panel: DataFrame) -> DataFrame:
    """The checks of a finished panel."""
    keys = canonical_keys(config.keys) if config.keys else []
    return validate.validate(panel, keys, keys[0]) if keys else validate.check_duplicates(panel)
