"""Requests in plain language to structured requirements, as expressions over a text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words that tell each part of a request, in the order in which they count.
UNITS = [
    ("country", [r"国家层面", r"国家级", r"跨国", r"national level", r"国家", r"全球", r"countries?", r"country-level", r"国际"]),
    ("individual", [r"个体", r"个人层面", r"individuals?", r"respondents?", r"大学生", r"住户", r"微观"]),
    ("province", [r"省级", r"省层面", r"province-level", r"\bprovinces\b"]),
    ("prefecture", [r"地级", r"prefecture", r"城市层面"]),
    ("firm", [r"\bfirm-level\b", r"\bfirms\b", r"企业层面"]),
    ("year", [r"time series", r"时间序列"]),
]
FREQUENCIES = [
    ("annual", [r"年度", r"annual", r"yearly", r"每年"]),
    ("quarterly", [r"季度", r"quarterly"]),
    ("monthly", [r"月度", r"monthly", r"每月"]),
    ("daily", [r"日度", r"daily"]),
]
SOURCES = [("official", [r"官方", r"official"]), ("international_org", [r"国际组织", r"international organization", r"world bank|ilo|un |oecd|imf"])]
TASKS = [
    ("panel", [r"面板", r"panel"]),
    ("cross_section", [r"截面", r"cross.section"]),
    ("time_series", [r"时间序列", r"time series"]),
    ("ml_training", [r"训练数据", r"training data", r"machine learning", r"机器学习"]),
]
VARIABLES = [
    ("youth_unemployment_rate", "outcome", [r"青年失业", r"youth unemployment", r"young unemployment"]),
    ("unemployment_rate", "outcome", [r"失业率", r"unemployment rate"]),
    ("gdp_per_capita", "control", [r"人均\s*gdp", r"gdp\s*per\s*capita", r"per.capita gdp"]),
    ("gdp", "control", [r"\bgdp\b", r"国内生产总值", r"生产总值"]),
    ("education_level", "exposure", [r"教育水平", r"教育程度", r"education( level|al attainment)?", r"受教育程度"]),
    ("population", "control", [r"人口", r"population"]),
    ("inflation", "control", [r"通胀", r"inflation", r"cpi"]),
    ("trade_openness", "control", [r"贸易", r"trade openness"]),
    ("gpa", "outcome", [r"\bgpa\b", r"绩点"]),
    ("self_efficacy", "outcome", [r"自我效能", r"self.efficacy"]),
    ("engagement", "outcome", [r"学习投入", r"(study|learning) engagement"]),
    ("ai_usage", "exposure", [r"生成式\s*ai", r"generative ai", r"ai 使用", r"chatgpt"]),
]
PLACES = [("CN", [r"中国", r"china"]), ("US", [r"美国", r"united states"]), ("EU", [r"欧盟", r"european"]), ("global", [r"全球", r"global", r"世界", r"跨国"])]
DELIVERABLES = [("csv", [r"\bcsv\b"]), ("parquet", [r"parquet"]), ("xlsx", [r"xlsx|excel"]), ("report", [r"数据说明|质量报告|说明|report"]), ("reproducible", [r"可复现|reproduc"])]
RANGE = r"(20\d\d)\s*[—\-–~至to]+\s*(20\d\d)"
SINCE = r"(?:since|自|从)\s*(20\d\d)"
INTENTS = [
    ("EXPLAIN", ["为什么", "解释", "哪里来", "怎么做的", "推荐理由"]),
    ("DISCOVER_ACQUIRE_BUILD", ["合并", "合成", "构建", "做成", "面板", "build", "merge"]),
    ("DISCOVER_AND_ACQUIRE", ["下载", "download", "获取数据", "拿到", "导出"]),
]

Rules = Sequence[tuple[str, Sequence[str]]]


def _any(text: Column, patterns: Sequence[str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def first_match(text: Column, rules: Rules, default: str) -> Column:
    return F.coalesce(*[F.when(_any(text, ps), name) for name, ps in rules], F.lit(default))


def all_matches(text: Column, rules: Rules) -> Column:
    return F.array_compact(F.array(*[F.when(_any(text, ps), name) for name, ps in rules]))


def parse(df: DataFrame, text: str, this_year: int) -> DataFrame:
    """``df`` with struct ``requirement``; ``this_year`` ends the range of requests that only say since when."""
    t = F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))
    unit = first_match(t, UNITS, "unknown")
    number = lambda p, i: F.regexp_extract(t, p, i).try_cast("int")
    start = F.coalesce(number(RANGE, 1), number(SINCE, 1))
    end = F.coalesce(number(RANGE, 2), F.when(number(SINCE, 1).isNotNull(), F.lit(this_year)))
    macro = unit.isin("country", "province", "prefecture") & start.isNotNull()
    stated = first_match(t, FREQUENCIES, "unknown")
    frequency = F.when((stated == "unknown") & macro, "annual").otherwise(stated)
    places = all_matches(t, PLACES)
    geography = F.when((unit == "country") & (F.size(places) == 0), F.array(F.lit("global"))).otherwise(places)
    by_role = [all_matches(t, [(v, ps) for v, r, ps in VARIABLES if r == role]).alias(role) for role in ("outcome", "exposure", "control")]
    assumptions = F.array_compact(
        F.array(
            F.when(unit == "unknown", "unit of analysis unknown"),
            F.when(number(RANGE, 1).isNull() & start.isNotNull(), "end of the time range assumed"),
            F.when((stated == "unknown") & macro, "annual frequency assumed").when(stated == "unknown", "frequency unknown"),
        )
    )
    return df.withColumn(
        "requirement",
        F.struct(
            unit.alias("unit"), start.alias("year_start"), end.alias("year_end"), frequency.alias("frequency"), first_match(t, TASKS, "unknown").alias("task"),
            *by_role, all_matches(t, SOURCES).alias("sources"), geography.alias("geography"), all_matches(t, DELIVERABLES).alias("deliverables"), assumptions.alias("assumptions"),
        ),
    )


def problems(requirement: str = "requirement") -> Column:
    """What contradicts itself in a parsed requirement, as an array."""
    r = F.col(requirement)
    return F.array_compact(
        F.array(
            F.when(r["year_start"] > r["year_end"], "time range inverted"),
            F.when(~r["year_start"].between(1900, 2100) | ~r["year_end"].between(1900, 2100), "time range implausible"),
            F.when(F.size(r["outcome"]) + F.size(r["exposure"]) + F.size(r["control"]) == 0, "no variables"),
            F.when(r["unit"] == "unknown", "unit unknown"),
        )
    )


def intent(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(_any(t, words), name) for name, words in INTENTS], F.lit("DISCOVER_ONLY"))


def canonical_providers(names: Column, aliases: dict[str, str]) -> Column:
    """Known ids of the names users give, in order and once each."""
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.array_distinct(F.array_compact(F.transform(names, lambda n: F.try_element_at(known, F.lower(F.trim(n))))))
