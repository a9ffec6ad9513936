"""Planning and running panel builds, on inputs of each unit of analysis."""

import pytest

from loomframe.errors import EngineError
from loomframe.functions.units import Meaning
from loomframe.plans import build


def test_plan_of_inputs_without_keys_is_blocked():
    plan = build.make_plan([build.Asset("a", ["name", "amount"]), build.Asset("b", ["country", "year"])])
    assert not plan.joins and [p.severity for p in plan.points] == ["blocking"]
    assert build.make_plan([]).points[0].severity == "blocking" and build.review(build.Plan(()))[0].topic == "build"


@pytest.mark.parametrize(("name", "method"), [("unemployment_rate", "mean"), ("export_value", "sum"), ("population", "last"), ("gpa", None), ("price_share_import", "mean")])
def test_method_of_a_name(name, method):
    assert build.method_of(name) == method


def test_review_blocks_many_to_many_and_keyless_joins():
    plan = build.Plan(("a", "b"), joins=(build.Join("a", "b", (), "m:m"),), aggregations=(("x", "none"),))
    assert [(p.severity, p.topic) for p in build.review(plan)] == [("blocking", "join"), ("blocking", "join"), ("warning", "aggregation")]


def test_keys_follow_from_the_unit():
    assert build.configure(build.Plan(("a",), "province")).keys == ("province_code", "year")
    individual = build.configure(build.Plan(("a",), "individual"))
    assert individual.keys == () and individual.points[-1].topic == "entity_resolution"


def test_panel_of_wide_and_yearly_inputs(spark):
    wide = spark.createDataFrame([("China", 1.0, 2.0), ("Germany", 3.0, None), ("World", 9.0, 9.0)], "country string, `2019` double, `2020` double")
    long = spark.createDataFrame([("CHN", 2019, 10.0), ("DEU", 2019, 20.0), ("DEU", 2020, 30.0)], "iso3 string, year int, rate double")
    config = build.Config(("w", "l"), "country", ("country", "year"), derived=(("twice", "rate * 2"),))
    got = {(r["iso3"], r["year"]): (r["value_i1"], r["rate"], r["twice"]) for r in build.run(config, {"w": wide, "l": long}).collect()}
    assert got == {("CHN", 2019): (1.0, 10.0, 20.0), ("DEU", 2019): (3.0, 20.0, 40.0), ("DEU", 2020): (None, 30.0, 60.0)}


def test_months_are_aggregated_by_the_plans_methods(spark):
    rows = spark.createDataFrame([("USA", "2020-01", 1.0, 5.0), ("USA", "2020-03", 3.0, 6.0), ("USA", "2021-02", 4.0, 7.0)], "iso3 string, period string, export_value double, gpa double")
    config = build.configure(build.Plan(("m",), "country", aggregations=(("export_value", "sum"), ("gpa", "none"))))
    got = {r["year"]: (r["export_value"], r["gpa"]) for r in build.run(config, {"m": rows}).collect()}
    assert got == {2020: (4.0, 5.0), 2021: (4.0, 7.0)}


def test_keyless_inputs_are_appended_and_repeated_keys_refused(spark):
    a = spark.createDataFrame([(1, 2.0)], "person int, gpa double")
    config = build.configure(build.Plan(("a", "b"), "individual"))
    assert build.run(config, {"a": a, "b": a}).count() == 2
    twice = spark.createDataFrame([("USA", 2020, 1.0), ("USA", 2020, 2.0)], "iso3 string, year int, x double")
    with pytest.raises(EngineError, match="JOIN_CARDINALITY_BLOCKED"):
        build.run(build.Config(("a", "b"), "country", ("iso3", "year")), {"a": twice, "b": twice.withColumnRenamed("x", "y")})
    with pytest.raises(EngineError, match="NOT_FOUND"):
        build.run(build.Config(("a",), "country", ("iso3", "year")), {})


def test_provinces_are_valid_in_their_years_and_generic_keys_stay_null(spark):
    rows = spark.createDataFrame([("重庆市", 1990, 1.0), ("重庆市", 2000, 2.0)], "province string, year int, x double")
    got = {r["year"]: r["province_code"] for r in build.run(build.Config(("p",), "province", ("province_code", "year")), {"p": rows}).collect()}
    assert got == {1990: None, 2000: "500000"}
    firms = build.run(build.Config(("p",), "firm", ("entity_key", "year")), {"p": rows})
    assert {r["entity_key"] for r in firms.collect()} == {None}


def test_same_names_with_other_meanings(spark):
    points = build.same_name_conflicts(spark, {"a": [Meaning("gdp", unit="usd", price_basis="real")], "b": [Meaning("gdp", unit="usd", price_basis="nominal")], "c": [Meaning("pop")]})
    assert [(p.severity, p.field) for p in points] == [("blocking", "gdp")]


def test_repeated_column_names_keep_the_first(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("x", "x", "y")
    assert [tuple(r) for r in build.single_names(df).collect()] == [(1, 3)]
