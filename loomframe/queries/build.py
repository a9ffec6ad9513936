"""Planning, reviewing and running a panel build."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile
from ..plans import build, record, semantics
from ..registry import query, table
from ..scratch import shared_folder

COUNTRIES = ["United States", "China", "Germany", "Japan", "France", "Brazil", "India", "Mexico", "Canada", "Kenya", "South Africa", "Spain", "Italy", "Poland", "Sweden", "Norway", "Chile", "Peru", "Egypt", "Turkey", "Greece", "Portugal", "Austria", "Belgium", "Ghana"]
CODES = ["USA", "CHN", "DEU", "JPN", "FRA", "BRA", "IND", "MEX", "CAN", "KEN", "ZAF", "ESP", "ITA", "POL", "SWE", "NOR", "CHL", "PER", "EGY", "TUR", "GRC", "PRT", "AUT", "BEL", "GHA"]
YEARS = (1996, 1997, 1998)


def _sold(spark, sf):
    """Orders with the country of their customer, as raw tables name it."""
    nation = table(spark, sf, "customer").select("c_custkey", F.element_at(F.array(*[F.lit(c) for c in COUNTRIES]), (F.col("c_nationkey") % 25 + 1).cast("int")).alias("country"))
    return table(spark, sf, "orders").join(nation, F.col("o_custkey") == F.col("c_custkey"))


def _inputs(spark, sf):
    """A table with a column a year, and one with a row a month."""
    sold = _sold(spark, sf)
    wide = sold.groupBy("country").agg(*[F.sum(F.when(F.year("o_orderdate") == y, F.col("o_totalprice"))).alias(str(y)) for y in YEARS])
    monthly = sold.groupBy("country", F.date_format("o_orderdate", "yyyy-MM").alias("time")).agg(F.sum("o_totalprice").alias("export_value"), F.max("o_totalprice").alias("price_peak"))
    return {"spending": wide, "exports": monthly}


def _plan(frames):
    return build.make_plan([build.Asset("spending", frames["spending"].columns, ["spending"]), build.Asset("exports", frames["exports"].columns, ["export_value", "price_peak"])])


CODE_SQL = "(["+", ".join(f"'{c}'" for c in CODES)+"])[(c_nationkey % 25 + 1)::INT]"
PANEL_SQL = f"""
WITH s AS (SELECT {CODE_SQL} AS iso3, year(o_orderdate)::INT AS year, strftime(o_orderdate, '%Y-%m') AS m, o_totalprice AS p FROM orders JOIN customer ON o_custkey = c_custkey),
n AS (SELECT iso3, y::INT AS year FROM (SELECT DISTINCT iso3 FROM s) CROSS JOIN (VALUES (1996), (1997), (1998)) t(y)),
a AS (SELECT n.iso3, n.year, sum(p) AS value_i1 FROM n LEFT JOIN s USING (iso3, year) GROUP BY ALL),
b AS (SELECT iso3, year, sum(v) AS export_value, avg(k) AS price_peak FROM (SELECT iso3, year, m, sum(p) AS v, max(p) AS k FROM s GROUP BY ALL) GROUP BY ALL)
SELECT iso3, year, round(value_i1, 2) AS spending, round(export_value, 2) AS export_value, round(price_peak, 2) AS price_peak, round(export_value / nullif(value_i1, 0), 4) AS export_share FROM a JOIN b USING (iso3, year)"""


@query(PANEL_SQL)
def run_build(spark, sf):
    """The panel that follows from the inputs' own plan, with a derived share."""
    frames = _inputs(spark, sf)
    plan = _plan(frames)
    config = build.configure(build.Plan(plan.inputs, plan.entity, plan.time, plan.joins, plan.aggregations, derived=(("export_share", "export_value / value_i1"),)))
    panel = build.run(config, frames)
    return panel.select("iso3", "year", F.round("value_i1", 2).alias("spending"), F.round("export_value", 2).alias("export_value"), F.round("price_peak", 2).alias("price_peak"), F.round("export_share", 4).alias("export_share"))


@query("SELECT * FROM (VALUES ('entity', 'country', ''), ('join', 'spending', 'exports'), ('key', 'iso3', ''), ('key', 'year', ''), ('aggregate', 'export_value', 'sum'), ('aggregate', 'price_peak', 'mean'), ('aggregate', 'spending', 'none'), ('warning', 'spending', 'no aggregate follows from the name'), ('review', 'spending', 'no aggregate chosen')) t(kind, name, detail)")
def plan_build(spark, sf):
    """What is planned for the two inputs, and what is left to decide."""
    plan = _plan(_inputs(spark, sf))
    rows = [("entity", plan.entity, "")] + [("join", j.left, j.right) for j in plan.joins] + [("key", k, "") for k in build.configure(plan).keys]
    rows += [("aggregate", v, m) for v, m in plan.aggregations] + [(p.severity, p.field or "", p.message) for p in plan.points] + [("review", p.field or "", p.message) for p in build.review(plan)]
    return spark.createDataFrame(rows, "kind string, name string, detail string")


@query("SELECT * FROM (VALUES ('s1', 'input_compatibility', 'spending,exports', ''), ('s2', 'semantic_mapping', '', ''), ('s3', 'entity_resolution', 'country', ''), ('s4', 'time_alignment', 'annual', ''), ('s5', 'join', 'iso3,year', 'm:m joins are blocked'), ('s6', 'missing_policy', 'none', ''), ('s7', 'derived_variables', '', ''), ('s8', 'validation', '', ''), ('s9', 'export', '', '')) t(step, kind, parameters, warning)")
def build_steps(spark, sf):
    return build.steps(spark, build.configure(_plan(_inputs(spark, sf))))


@query(f"SELECT x.code, x.severity, x.field, x.affected FROM (SELECT count(*)::BIGINT AS n FROM ({PANEL_SQL})) p CROSS JOIN LATERAL (VALUES ('KEY_UNIQUE', 'INFO', 'iso3,year', 0::BIGINT)) x(code, severity, field, affected)")
def build_checks(spark, sf):
    """The finished panel's check of its keys."""
    frames = _inputs(spark, sf)
    config = build.configure(_plan(frames))
    return build.checks(config, build.run(config, frames)).filter("code like 'KEY%'")


def _raw_build(spark, sf, folder):
    """The build's inputs as raw files, and its config."""
    frames = _inputs(spark, sf)
    config = build.configure(_plan(frames))
    raws = []
    for name, df in frames.items():
        df.write.option("header", True).csv(f"{folder}/raw/{name}")
        raws.append(record.raw(spark, name, f"{folder}/raw/{name}", license="open"))
    return build.Config(config.inputs, config.unit, config.keys, config.frequency, config.methods, derived=(("export_share", "export_value / value_i1"),)), raws


@query(f"""WITH s AS (SELECT {CODE_SQL} AS iso3, year(o_orderdate)::INT AS year, strftime(o_orderdate, '%Y-%m') AS m FROM orders JOIN customer ON o_custkey = c_custkey),
w AS (SELECT count(DISTINCT iso3) AS n FROM s), mo AS (SELECT count(*) AS n FROM (SELECT DISTINCT iso3, m FROM s)), y AS (SELECT count(*) AS n FROM (SELECT DISTINCT iso3, year FROM s)), p AS (SELECT count(*) AS n FROM ({PANEL_SQL}))
SELECT x.* FROM w, mo, y, p CROSS JOIN LATERAL (VALUES (1, 'load_spending', NULL::BIGINT, w.n, true), (2, 'load_exports', NULL, mo.n, true), (3, 'canonical_spending', w.n, 3 * w.n, false), (4, 'canonical_exports', mo.n, mo.n, false),
  (5, 'annual_exports', mo.n, y.n, false), (6, 'join_exports', 3 * w.n, p.n, false), (7, 'panel', p.n, p.n, false)) x(seq, step, rows_before, rows_after, sourced)""")
def build_log(spark, sf):
    """A build from raw files: rows before and after each step, observed while the panel was written, and which steps have a source."""
    folder = shared_folder(spark)
    config, raws = _raw_build(spark, sf, folder)
    return record.export(config, raws, spark, f"{folder}/package").select("seq", "step", "rows_before", "rows_after", F.col("sha256").isNotNull().alias("sourced"))


@query(PANEL_SQL)
def build_rebuilt(spark, sf):
    """A package's panel built again from its raw files and its stored config, its digest compared with the recorded one."""
    folder = shared_folder(spark)
    config, raws = _raw_build(spark, sf, folder)
    record.export(config, raws, spark, f"{folder}/package")
    panel = record.rebuild(spark, f"{folder}/package")
    return panel.select("iso3", "year", F.round("value_i1", 2).alias("spending"), F.round("export_value", 2).alias("export_value"), F.round("price_peak", 2).alias("price_peak"), F.round("export_share", 4).alias("export_share"))


@query("""WITH v AS (SELECT 'lines' AS input, 'discount_rate' AS variable, max(l_discount) AS m FROM lineitem UNION ALL SELECT 'lines', 'tax_share', max(l_tax) FROM lineitem UNION ALL SELECT 'books', 'discount_rate', max(l_discount * 100) FROM lineitem
  UNION ALL SELECT 'books', 'tax_share', max(l_tax) FROM lineitem), u AS (SELECT input, variable, CASE WHEN m <= 1.5 THEN 'fraction' ELSE 'percent' END AS value FROM v
  UNION ALL SELECT 'lines', 'spent_usd', 'usd' FROM (SELECT count(*) FROM lineitem) UNION ALL SELECT 'orders', 'spent_usd', 'cny' FROM (SELECT count(*) FROM orders))
SELECT variable, 'unit' AS facet, list_sort(list(DISTINCT value)) AS found, list_sort(list(DISTINCT input)) AS inputs, CASE WHEN list_sort(list(DISTINCT value)) = ['fraction', 'percent'] THEN 'conversion' ELSE 'blocking' END AS severity
FROM u GROUP BY variable HAVING count(DISTINCT value) > 1""")
def semantic_scan(spark, sf):
    """Units of three inputs' variables, from profiles of their values and from a statement, and where they differ."""
    lines = table(spark, sf, "lineitem")
    own = lines.select(F.col("l_discount").alias("discount_rate"), F.col("l_tax").alias("tax_share"), F.col("l_extendedprice").alias("spent_usd"))
    books = lines.select((F.col("l_discount") * 100).alias("discount_rate"), F.col("l_tax").alias("tax_share"))
    stated = table(spark, sf, "orders").agg(F.count("*").alias("n")).select(F.lit("orders").alias("input"), F.lit("spent_usd").alias("variable"), F.lit("unit").alias("facet"), F.lit("cny").alias("value"))
    found = semantics.profiled("lines", profile.profile(own)).union(semantics.profiled("books", profile.profile(books))).union(stated)
    return semantics.differences(found)
