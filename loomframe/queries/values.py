"""Time, entities, missing values, formulas, units, profiles and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import entities, formula, timeparse, units
from ..operators import joins, missing, profile, validate
from ..plans import semantics
from ..registry import query, table

FORMS = "CASE o_orderkey % 6 WHEN 0 THEN {y} WHEN 1 THEN {y} || '年' WHEN 2 THEN {d} WHEN 3 THEN {y} || 'Q' || {q} WHEN 4 THEN {m} ELSE 'FY' || {y} END"
SPARK_FORM = FORMS.format(y="CAST(year(o_orderdate) AS STRING)", d="date_format(o_orderdate, 'yyyy-MM-dd')", q="CAST(quarter(o_orderdate) AS STRING)", m="date_format(o_orderdate, 'yyyy-MM')")
DUCK_FORM = FORMS.format(y="CAST(year(o_orderdate) AS VARCHAR)", d="strftime(o_orderdate, '%Y-%m-%d')", q="CAST(quarter(o_orderdate) AS VARCHAR)", m="strftime(o_orderdate, '%Y-%m')")


def _forms(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.expr(SPARK_FORM).alias("raw"))


@query(f"SELECT o_orderkey, {DUCK_FORM} AS raw, (['year', 'year', 'day', 'quarter', 'month', 'fiscal_year'])[(o_orderkey % 6 + 1)::INT] AS granularity, year(o_orderdate)::INT AS year, CASE WHEN o_orderkey % 6 = 3 THEN quarter(o_orderdate)::INT END AS quarter, CASE WHEN o_orderkey % 6 IN (2, 4) THEN month(o_orderdate)::INT END AS month, CASE WHEN o_orderkey % 6 = 2 THEN day(o_orderdate)::INT END AS day FROM orders")
def time_parse_variants(spark, sf):
    return _forms(spark, sf).select("o_orderkey", "raw", timeparse.time_value(F.col("raw")).alias("t")).select("o_orderkey", "raw", "t.*")


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year_of_text, year(o_orderdate)::INT AS year_of_date FROM orders")
def time_to_int_year(spark, sf):
    rows = _forms(spark, sf).join(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    return rows.select("o_orderkey", timeparse.year_of(rows, "raw").alias("year_of_text"), timeparse.year_of(rows, "o_orderdate").alias("year_of_date"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN year(o_orderdate)::INT END AS year FROM orders")
def time_fiscal(spark, sf):
    return _forms(spark, sf).select("o_orderkey", timeparse.fiscal_to_year(F.col("raw")).alias("year"))


@query("WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 'unknown' ELSE (['year', 'year', 'day', 'quarter', 'month', 'fiscal_year'])[(o_orderkey % 6 + 1)::INT] END AS a, CASE WHEN o_custkey % 2 = 0 THEN 'year' ELSE 'month' END AS b FROM orders) SELECT o_orderkey, a <> 'unknown' AND a <> b AS conflict FROM t")
def time_freq_conflict(spark, sf):
    """Whether each order's time is of another frequency than its customer's; every fifth time is no time."""
    rows = _forms(spark, sf).join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    raw = F.when(F.col("o_orderkey") % 5 == 4, "soon").otherwise(F.col("raw"))
    own = timeparse.time_value(raw)["granularity"]
    return rows.select("o_orderkey", timeparse.frequency_conflict(own, F.when(F.col("o_custkey") % 2 == 0, "year").otherwise("month")).alias("conflict"))


@query("SELECT o_custkey, round(least(1.0, greatest(0, least(max(year(o_orderdate)), 2000) - greatest(min(year(o_orderdate)), 1996)) / 4.0), 4)::DOUBLE AS overlap FROM orders GROUP BY 1")
def time_overlap_score(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("s"), F.max(F.year("o_orderdate")).alias("e"))
    return rows.select("o_custkey", F.round(timeparse.overlap_score(F.col("s"), F.col("e"), F.lit(1996), F.lit(2000)), 4).alias("overlap"))


LABELS = ["United States", "usa", "CHN", "840", "World", "中国", "germany", "DE", "Atlantis", " Japan ", "Korea, Rep.", "FRA", "Viet Nam", "Euro area", "brazil", "IN", "uk", "MEX", "Canada", "", "russia", "ZAF", "Kenya", "Turkiye", "hong kong"]
ISO3 = ["USA", "USA", "CHN", "USA", None, "CHN", "DEU", "DEU", None, "JPN", "KOR", "FRA", "VNM", None, "BRA", "IND", "GBR", "MEX", "CAN", None, "RUS", "ZAF", "KEN", "TUR", "HKG"]
_sql_list = lambda xs: "[" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _labelled(spark, sf, labels, key="n_nationkey"):
    array = F.array(*[F.lit(x) for x in labels])
    return table(spark, sf, "nation").select(key, F.element_at(array, (F.col(key) % len(labels) + 1).cast("int")).alias("raw"))


@query(f"SELECT n_nationkey, {_sql_list(LABELS)}[n_nationkey % 25 + 1] AS raw, {_sql_list(LABELS)}[n_nationkey % 25 + 1] AS raw_original, {_sql_list(ISO3)}[n_nationkey % 25 + 1] AS iso3 FROM nation")
def entity_country_iso3(spark, sf):
    return entities.resolve_countries(_labelled(spark, sf, LABELS), "raw", fuzzy=False)


@query(f"SELECT value, count(*) AS n FROM (SELECT {_sql_list(LABELS)}[n_nationkey % 25 + 1] AS value, {_sql_list(ISO3)}[n_nationkey % 25 + 1] AS iso3 FROM nation) WHERE iso3 IS NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def entity_country_unresolved(spark, sf):
    return entities.unresolved(entities.resolve_countries(_labelled(spark, sf, LABELS), "raw", fuzzy=False), "raw", "iso3")


@query()
def entity_country_fuzzy(spark, sf):
    return entities.resolve_countries(_labelled(spark, sf, ["Germanny", "Argentinaa", "World", "Brasil", "Phillippines"]), "raw")


@query("SELECT s_suppkey, nullif(lower(trim(s_name)), '') AS entity_key FROM supplier")
def entity_generic(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", entities.generic_key(F.concat(F.lit("  "), F.upper("s_name"), F.lit(" "))).alias("entity_key"))


PROVINCES = ["北京", "北京市", "110000", "内蒙古", "广东", "广东省", "Nowhere"]
PROVINCE_CODES = ["110000", "110000", "110000", "150000", None, "440000", None]


@query(f"SELECT n_nationkey, {_sql_list(PROVINCES)}[n_nationkey % 7 + 1] AS raw, {_sql_list(PROVINCE_CODES)}[n_nationkey % 7 + 1] AS province_code FROM nation")
def entity_cn_province(spark, sf):
    return entities.resolve_regions(_labelled(spark, sf, PROVINCES), "raw", "province")


CITIES = ["武汉", "武汉市", "420100", "深圳", "襄樊市", "襄阳市"]
CITY_CODES = ["420100", "420100", "420100", "440300", None, "420600"]


@query(f"SELECT n_nationkey, raw, year, CASE WHEN code = '440300' AND year < 1979 THEN NULL WHEN raw = '襄樊市' AND year < 1983 THEN NULL WHEN raw = '襄樊市' THEN '420600' ELSE code END AS prefecture_code FROM (SELECT n_nationkey, {_sql_list(CITIES)}[n_nationkey % 6 + 1] AS raw, {_sql_list(CITY_CODES)}[n_nationkey % 6 + 1] AS code, (1970 + n_nationkey)::INT AS year FROM nation)")
def entity_cn_prefecture_year(spark, sf):
    rows = _labelled(spark, sf, CITIES).withColumn("year", (F.col("n_nationkey") + 1970).cast("int"))
    return entities.resolve_regions(rows, "raw", "prefecture", F.col("year"))


NULLS = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END"


def _gaps(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "ts", F.expr(NULLS).alias("value"))


def _filled(method, expr, group=("user_id",), limit=None, name=None):
    def run(spark, sf):
        out = missing.fill(_gaps(spark, sf), ["value"], method, group, ["ts", "event_id"], limit)
        mask = F.col("__imputed_value").alias("imputed") if "__imputed_value" in out.columns else F.lit(False).alias("imputed")
        return out.select("event_id", F.round("value", 6).alias("value"), mask)

    run.__name__ = name or f"missing_{method}"
    w = f"PARTITION BY {', '.join(group)} ORDER BY ts, event_id" if group else "ORDER BY ts, event_id"
    sql = f"""WITH t AS (SELECT event_id, user_id, ts, {NULLS} AS v FROM events), p AS (SELECT *, row_number() OVER ({w}) AS pos FROM t),
    n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp, last_value(v IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
      first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np, first_value(v IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM p)
    SELECT event_id, round({expr}, 6) AS value, v IS NULL AND ({expr}) IS NOT NULL AS imputed FROM n"""
    return query(sql)(run)


LINEAR = "CASE WHEN v IS NOT NULL THEN v WHEN pp IS NULL THEN NULL WHEN np IS NULL THEN pv ELSE pv + (nv - pv) * (pos - pp) / (np - pp) END"
missing_none = _filled("none", "v")
missing_ffill = _filled("ffill", "pv")
missing_bfill = _filled("bfill", "nv")
missing_linear = _filled("linear", LINEAR)
missing_group_linear = _filled("group_linear", LINEAR)
missing_linear_limit = _filled("linear", f"CASE WHEN v IS NULL AND pos - pp > 1 THEN NULL ELSE {LINEAR} END", limit=1, name="missing_linear_limit")
missing_ffill_whole = _filled("ffill", "pv", group=(), name="missing_ffill_whole")
missing_bfill_whole = _filled("bfill", "nv", group=(), name="missing_bfill_whole")
missing_linear_whole = _filled("linear", LINEAR, group=(), name="missing_linear_whole")
missing_mean = _filled("mean", "coalesce(v, avg(v) OVER ())", group=())
missing_median = _filled("median", "coalesce(v, (SELECT median(v) FROM t))", group=())


@query(f"SELECT event_id, value FROM (SELECT event_id, {NULLS} AS value FROM events) WHERE value IS NOT NULL")
def missing_drop(spark, sf):
    return missing.fill(_gaps(spark, sf), ["value"], "drop").select("event_id", "value")


@query(f"WITH t AS (SELECT {NULLS} AS v, min(CASE WHEN event_id % 3 <> 0 THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS f, (ts, event_id) AS spot FROM events) SELECT 'value' AS column_name, count(*) FILTER (WHERE v IS NULL AND spot > f) AS n_imputed, round((count(*) FILTER (WHERE v IS NULL AND spot > f))::DOUBLE / count(*) FILTER (WHERE v IS NULL), 4) AS imputed_ratio FROM t")
def missing_mask(spark, sf):
    return missing.imputed_ratios(missing.fill(_gaps(spark, sf), ["value"], "ffill", ["user_id"], ["ts", "event_id"]), ["value"])


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) / l_quantity AS unit_revenue FROM lineitem")
def derive_ratio(spark, sf):
    out = formula.derive(table(spark, sf, "lineitem"), "l_extendedprice * (1 - l_discount) / l_quantity", "unit_revenue", ["l_extendedprice", "l_discount", "l_quantity"])
    return out.select("l_orderkey", "l_linenumber", "unit_revenue")


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END, 6) AS ratio FROM lineitem")
def derive_div_zero(spark, sf):
    return formula.derive(table(spark, sf, "lineitem"), "l_tax / l_discount", "ratio", ["l_tax", "l_discount"]).select("l_orderkey", "l_linenumber", F.round("ratio", 6).alias("ratio"))


@query("SELECT p_partkey, round(-(p_size * 1.0) ** 2 + 0.5, 4)::DOUBLE AS y FROM part".replace("-(p_size * 1.0) ** 2", "-(power(p_size::DOUBLE, 2))"))
def derive_power(spark, sf):
    return formula.derive(table(spark, sf, "part"), "-p_size ** 2 + 0.5", "y", ["p_size"]).select("p_partkey", F.round("y", 4).alias("y"))


@query("SELECT l_orderkey, l_linenumber, round(l_discount * 100, 6) AS percent, round(l_discount * 100 / 100, 6) AS fraction FROM lineitem")
def unit_percent_fraction(spark, sf):
    up = units.convert(F.col("l_discount"), "share", "pct")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(up, 6).alias("percent"), F.round(units.convert(up, "percent", "fraction"), 6).alias("fraction"))


def _profile_sql(tab, cols):
    part = lambda c: f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_unique, round(min({c}::DOUBLE), 6) AS v_min, round(max({c}::DOUBLE), 6) AS v_max, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75 FROM {tab}"
    return " UNION ALL ".join(part(c) for c in cols)


@query(_profile_sql("lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def profile_lineitem(spark, sf):
    out = profile.profile(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"], exact=True)
    return out.select("column_name", "n_rows", "n_null", "n_unique", "v_min", "v_max", "q25", "q50", "q75")


@query("SELECT 'c_custkey' AS column_name, false AS likely_time, false AS likely_place, false AS likely_id, true AS likely_key UNION ALL SELECT 'country', false, true, false, false UNION ALL SELECT 'fiscal_year', true, false, false, false UNION ALL SELECT 'branch_id', false, false, true, true")
def profile_roles(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("country"), F.lit(2020).alias("fiscal_year"), F.col("c_custkey").alias("branch_id"))
    return profile.roles(profile.profile(rows, exact=True))


@query("SELECT 'lang' AS column_name, false AS numeric_text, false AS han_text, true AS categorical UNION ALL SELECT 'code', true, false, false UNION ALL SELECT 'han', false, true, true")
def profile_string_patterns(spark, sf):
    rows = table(spark, sf, "documents").select("lang", F.col("doc_id").cast("string").alias("code"), F.when(F.col("doc_id") % 2 == 0, "城市").otherwise("年份").alias("han"))
    return profile.profile(rows, exact=True).select("column_name", "numeric_text", "han_text", "categorical")


@query("""WITH u AS (SELECT 'v' || (s_suppkey % 7) AS variable, (['percent', 'fraction', 'usd'])[(CASE WHEN s_suppkey % 7 < 3 THEN s_suppkey % 2 WHEN s_suppkey % 7 < 5 THEN s_suppkey % 3 ELSE 2 END + 1)::INT] AS value FROM supplier)
SELECT variable, list_sort(list(DISTINCT value)) AS found, CASE WHEN list_sort(list(DISTINCT value)) = ['fraction', 'percent'] THEN 'conversion' ELSE 'blocking' END AS severity FROM u GROUP BY variable HAVING count(DISTINCT value) > 1""")
def semantics_compare(spark, sf):
    """Units that the suppliers state for variables of one name, and whether they stand in one column."""
    k = F.col("s_suppkey") % 7
    unit = F.element_at(F.array(F.lit("percent"), F.lit("fraction"), F.lit("usd")), (F.when(k < 3, F.col("s_suppkey") % 2).when(k < 5, F.col("s_suppkey") % 3).otherwise(2) + 1).cast("int"))
    stated = table(spark, sf, "supplier").select(F.col("s_name").alias("input"), F.concat(F.lit("v"), k.cast("string")).alias("variable"), F.lit("unit").alias("facet"), unit.alias("value"))
    return semantics.differences(stated).select("variable", "found", "severity")


CHECK = "SELECT '{code}' AS code, '{sev}' AS severity, {field} AS field, ({n})::BIGINT AS affected"


@query(CHECK.format(code="KEY_DUPLICATE", sev="ERROR", field="'l_orderkey,l_linenumber'", n="SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)") + " UNION ALL " + CHECK.format(code="KEY_UNIQUE", sev="INFO", field="'o_orderkey'", n="SELECT 0"))
def validate_keys(spark, sf):
    return validate.check_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).union(validate.check_keys(table(spark, sf, "orders"), ["o_orderkey"]))


@query(CHECK.format(code="DUPLICATE_ROWS", sev="WARNING", field="NULL::VARCHAR", n="SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_quantity, l_returnflag)"))
def validate_duplicates(spark, sf):
    return validate.check_duplicates(table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag"))


@query(CHECK.format(code="MISSING_HIGH", sev="WARNING", field="'a'", n="SELECT count(*) FROM events WHERE event_id % 3 <> 0") + " UNION ALL " + CHECK.format(code="MISSING", sev="INFO", field="'b'", n="SELECT count(*) FROM events WHERE event_id % 3 = 0"))
def validate_missing(spark, sf):
    rows = table(spark, sf, "events").select(F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("b"), "user_id")
    return validate.check_missing(rows)


@query(CHECK.format(code="IMPOSSIBLE_VALUE", sev="ERROR", field="'income'", n="SELECT count(*) FROM customer WHERE c_acctbal < 0"))
def validate_negative(spark, sf):
    return validate.check_negative(table(spark, sf, "customer").select(F.col("c_acctbal").alias("income"), "c_custkey"))


@query("WITH t AS (SELECT CASE WHEN o_orderkey % 5000 = 1 THEN 1e7 ELSE o_totalprice END AS v FROM orders), s AS (SELECT avg(v) AS m, stddev_samp(v) AS d FROM t) SELECT 'OUTLIER' AS code, 'WARNING' AS severity, 'v' AS field, count(*) AS affected FROM t, s WHERE abs((v - m) / d) > 6 HAVING count(*) > 0")
def validate_outlier(spark, sf):
    return validate.check_outliers(table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 5000 == 1, 1e7).otherwise(F.col("o_totalprice")).alias("v")))


@query("WITH p AS (SELECT DISTINCT o_custkey AS e, year(o_orderdate) AS y FROM orders) SELECT 'TEMPORAL_GAP' AS code, 'WARNING' AS severity, 'year' AS field, (count(DISTINCT e) * (max(y) - min(y) + 1) - count(*))::BIGINT AS affected FROM p")
def validate_temporal_gap(spark, sf):
    return validate.check_gaps(table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year")), "o_custkey")


@query("SELECT 'CONSTANT_COLUMN' AS code, 'WARNING' AS severity, 'kind' AS field, count(*) AS affected FROM customer")
def validate_constant(spark, sf):
    return validate.check_constant(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.lit("x").alias("kind")))


@query("SELECT 'ROW_COUNT_DRIFT' AS code, 'ERROR' AS severity, NULL::VARCHAR AS field, abs(count(*) - 100)::BIGINT AS affected FROM customer UNION ALL SELECT 'ROW_COUNT_STABLE', 'INFO', NULL, 0")
def validate_row_drift(spark, sf):
    return validate.check_row_count(table(spark, sf, "customer"), 100).union(validate.check_row_count(table(spark, sf, "region"), 5))


@query("SELECT 'TYPE_DRIFT' AS code, 'ERROR' AS severity, 'c_custkey' AS field, 1::BIGINT AS affected")
def validate_type_drift(spark, sf):
    return validate.check_types(table(spark, sf, "customer"), {"c_custkey": "string", "c_name": "string", "c_acctbal": "double"})


@query("""WITH l AS (SELECT c_custkey AS k FROM customer), r AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 40 = 0 GROUP BY 1),
f AS (SELECT count(*) FILTER (WHERE r.k IS NOT NULL)::DOUBLE / count(*) AS c, count(*) FILTER (WHERE r.k IS NULL) AS n FROM l LEFT JOIN r USING (k))
SELECT x.code, x.severity, x.affected FROM f CROSS JOIN LATERAL (VALUES ('JOIN_COVERAGE_LOW', 'WARNING', n, round(c, 4) < 0.8), ('JOIN_COVERAGE', 'INFO', n, round(c, 4) >= 0.8), ('UNMATCHED_ENTITIES', 'INFO', n, n > 0)) x(code, severity, affected, holds) WHERE x.holds""")
def validate_join(spark, sf):
    """Coverage of a join and its unmatched entities: customers and those that some orders name."""
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    right = table(spark, sf, "orders").filter("o_orderkey % 40 = 0").select(F.col("o_custkey").alias("k")).distinct()
    return validate.check_join(joins.join_report(left, right, ["k"])).select("code", "severity", "affected")


@query(f"WITH t AS (SELECT {NULLS} AS v, min(CASE WHEN event_id % 3 <> 0 THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS f, (ts, event_id) AS spot FROM events) SELECT 'IMPUTATION_PRESENT' AS code, 'INFO' AS severity, 'value' AS field, count(*) FILTER (WHERE v IS NULL AND spot > f)::BIGINT AS affected FROM t HAVING affected > 0")
def validate_imputed(spark, sf):
    """How many cells a fill made up."""
    return validate.check_imputed(missing.fill(_gaps(spark, sf), ["value"], "ffill", ["user_id"], ["ts", "event_id"])).select("code", "severity", "field", "affected")


@query("SELECT l_orderkey, l_linenumber, l_discount / 100.0 AS as_fraction, l_discount * 100.0 AS as_percent FROM lineitem")
def unit_convert(spark, sf):
    """Discounts read as percent and as a fraction, each in the other's unit."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", units.convert(F.col("l_discount"), "percent", "fraction").alias("as_fraction"), units.convert(F.col("l_discount"), "share", "percent").alias("as_percent"))


@query("SELECT x.column_name, x.unit_hint FROM (SELECT max(l_discount) AS d, max(l_quantity) AS q FROM lineitem) CROSS JOIN LATERAL (VALUES ('discount_rate', CASE WHEN d <= 1.5 THEN 'fraction' ELSE 'percent' END), ('quantity_share', CASE WHEN q <= 1.5 THEN 'fraction' ELSE 'percent' END), ('price_usd', 'usd'), ('tax', NULL)) x(column_name, unit_hint)")
def profile_units(spark, sf):
    """Units that names and values hint at, from the sketched profile."""
    rows = table(spark, sf, "lineitem").select(F.col("l_discount").alias("discount_rate"), F.col("l_quantity").alias("quantity_share"), F.col("l_extendedprice").alias("price_usd"), F.col("l_tax").alias("tax"))
    return profile.profile(rows).select("column_name", "unit_hint")
