"""Deduplication, ranking and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, ranking
from ..plans import fanout, requirement
from ..registry import query, table
from ..streaming import state
from .text import URL_SQL


@query(f"WITH k AS (SELECT page_id, 'url:' || {URL_SQL} AS group_id, (page_id * 37 % 101)::DOUBLE AS score FROM pages), g AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS group_size, first_value(page_id) OVER (PARTITION BY group_id ORDER BY score DESC, page_id) AS first FROM k) SELECT page_id, group_id, group_size, page_id = first AS is_primary FROM g")
def dedup_candidates(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", "url", F.lit(None).cast("string").alias("doi"), (F.col("page_id") * 37 % 101).cast("double").alias("score"))
    return dedup.deduplicate(rows, "page_id").select("page_id", "group_id", "group_size", "is_primary")


@query()
def fuzzy_title_pairs(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_type", "p_brand", "p_name").alias("title"))
    return dedup.fuzzy_pairs(rows, "p_partkey", "title", 0.9)


@query("SELECT min(doc_id) AS doc_id, source, doc_id % 50 AS post FROM documents GROUP BY source, doc_id % 50")
def social_dedupe(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", (F.col("doc_id") % 50).alias("post"))
    return dedup.dedupe_posts(rows, "source", "post", "doc_id")


@query("SELECT sha256(text) AS text_hash, count(*) AS n_posts, count(DISTINCT source) AS n_platforms FROM documents GROUP BY text HAVING count(DISTINCT source) > 1")
def social_cross_flags(spark, sf):
    return dedup.cross_platform(table(spark, sf, "documents"), "source", "text")


def _catalogue(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, "Unemployment rates of the world").otherwise("Prices").alias("title"), F.lit("Yearly unemployment and education data").alias("description"),
        F.when(F.col("p_partkey") % 2 == 0, "unemployment_rate").otherwise("").alias("hints"), F.when(F.col("p_partkey") % 4 == 0, "country").otherwise("firm").alias("unit"),
        (F.lit(2000) + F.col("p_size") % 20).alias("year_start"), F.lit(2023).alias("year_end"), F.array(F.when(F.col("p_partkey") % 5 == 0, "global").otherwise("CN")).alias("geography"),
        F.element_at(F.array(*[F.lit(x) for x in ("international", "official", "commercial")]), (F.col("p_partkey") % 3 + 1).cast("int")).alias("trust"),
        F.when(F.col("p_partkey") % 2 == 1, "10.1/x").alias("doi"), F.when(F.col("p_partkey") % 7 == 0, "UNKNOWN").otherwise("CC-BY-4.0").alias("license"), F.lit("PUBLIC_ANONYMOUS_API").alias("access"), (F.col("p_partkey") % 11 == 0).alias("requires_login"),
    )


RANK_SQL = """
WITH c AS (SELECT p_partkey AS id, p_partkey AS k, 2000 + p_size % 20 AS ys FROM part),
d AS (SELECT id, CASE WHEN k % 3 = 0 THEN 0.3 ELSE 0.0 END AS topic, 1.0 AS variables, CASE WHEN k % 4 = 0 THEN 1.0 ELSE 0.2 END AS unit,
 round(least(1.0, greatest(0, 2023 - greatest(ys, 2015))::DOUBLE / 8), 3) AS time, CASE WHEN k % 5 = 0 THEN 1.0 ELSE 0.3 END AS geo, ([1.0, 0.9, 0.3])[(k % 3 + 1)::INT] AS trust, CASE WHEN k % 2 = 1 THEN 1.0 ELSE 0.0 END AS doi,
 CASE WHEN k % 7 = 0 THEN 0.0 ELSE 1.0 END AS lic, CASE WHEN k % 11 = 0 THEN 0.4 ELSE 1.0 END AS acc, round(38.0 / 400, 3) AS docs FROM c)
SELECT id, round(((0.5 * topic + 3.0 * variables + 1.5 * unit + 1.5 * time + 1.0 * geo + 1.6 * trust + 0.6 * doi + 0.8 * lic + 1.2 * acc + 0.4 * docs) / 12.1)::DOUBLE, 4) AS score FROM d ORDER BY score DESC, id LIMIT 25"""


@query(RANK_SQL)
def rank_candidates(spark, sf):
    scored = ranking.score_candidates(_catalogue(spark, sf), ["unemployment_rate"], "country", (2015, 2023), ["DE"])
    return ranking.best(scored, 25).select("id", "score")


@query("""WITH p AS (SELECT s_suppkey AS k, s_suppkey::VARCHAR AS id, (['international_org', 'gov', 'cn', 'market'])[(s_suppkey % 4 + 1)::INT] AS category, (['international', 'official', 'academic', 'commercial'])[(s_suppkey % 5 % 4 + 1)::INT] AS trust, CASE WHEN s_nationkey % 3 = 0 THEN 'CN' ELSE 'EU' END AS region, s_suppkey % 11 <> 0 AS active, s_suppkey % 3 <> 0 AS anonymous, s_suppkey % 13 <> 0 AS searchable FROM supplier),
s AS (SELECT id, k, (2.0 * (CASE trust WHEN 'international' THEN 5 WHEN 'official' THEN 4 WHEN 'academic' THEN 3 ELSE 1 END) + CASE category WHEN 'international_org' THEN 14.0 WHEN 'gov' THEN 3.0 ELSE 0 END - CASE WHEN trust = 'commercial' THEN 1.5 ELSE 0 END + CASE WHEN category = 'cn' OR region = 'CN' THEN 5.0 ELSE 0 END
  - CASE WHEN anonymous THEN 0 ELSE 3.0 END - CASE WHEN searchable THEN 0 ELSE 100.0 END)::DOUBLE AS score FROM p WHERE active)
SELECT id, score FROM s WHERE score > -50 ORDER BY score DESC, k LIMIT 12""")
def select_providers_topk(spark, sf):
    """The twelve best of the suppliers, taken as providers of data."""
    k, pick = F.col("s_suppkey"), lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    df = table(spark, sf, "supplier").select(
        k.cast("string").alias("id"), F.col("s_name").alias("name"), pick(["international_org", "gov", "cn", "market"], k % 4).alias("category"), pick(["international", "official", "academic", "commercial"], k % 5 % 4).alias("trust"),
        F.when(F.col("s_nationkey") % 3 == 0, "CN").otherwise("EU").alias("region"), (k % 11 != 0).alias("active"), (k % 3 != 0).alias("anonymous"), (k % 13 != 0).alias("searchable"), k.alias("position"),
    )
    return ranking.select_providers(df, macro=True, china=True, public_only=True, preferences=["international_org"], k=12).select("id", "score")


@query("SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%brass%' THEN 2.0 WHEN lower(p_name) LIKE '%brass%' THEN 1.0 ELSE 0.0 END + CASE WHEN lower(p_type) LIKE '%part%' THEN 2.0 WHEN lower(p_name) LIKE '%part%' THEN 1.0 ELSE 0.0 END AS score FROM part ORDER BY score DESC, p_partkey LIMIT 10".replace("AS score FROM", "AS score FROM"))
def keyword_search(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.round(ranking.keyword_score(F.col("p_type"), F.col("p_name"), "brass or part"), 1).alias("score"))
    return ranking.best(rows, 10, tie="p_partkey")


WORDS = ["thnd", "erre"]


@query("WITH p AS (SELECT doc_id, lower(substr(text, 1, 60)) AS t, lower(text) AS a, doc_id % 3 = 0 AS d FROM documents), s AS (SELECT doc_id, (CASE WHEN t LIKE '%thnd%' THEN 2 WHEN a LIKE '%thnd%' THEN 1 ELSE 0 END + CASE WHEN t LIKE '%erre%' THEN 2 WHEN a LIKE '%erre%' THEN 1 ELSE 0 END - CASE WHEN t LIKE '%zzz%' OR a LIKE '%zzz%' THEN 2 ELSE 0 END + CASE WHEN d THEN 1 ELSE 0 END)::INT AS score FROM p) SELECT doc_id, score, CASE WHEN score >= 3 THEN 'must_read' WHEN score >= 1 THEN 'skim' ELSE 'scan' END AS tier FROM s")
def paper_rank(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 60).alias("title"), F.col("text").alias("abstract"), F.when(F.col("doc_id") % 3 == 0, "10.1/x").alias("doi"))
    return ranking.rank_papers(rows, WORDS, ["zzz"]).select("doc_id", "score", "tier")


@query("SELECT DISTINCT 'doi:' || (doc_id % 200) AS key FROM documents WHERE doc_id % 200 >= 100")
def paper_digest_new(spark, sf):
    keys = table(spark, sf, "documents").select(F.concat(F.lit("doi:"), (F.col("doc_id") % 200).cast("string")).alias("key")).distinct()
    seen = spark.range(100).select(F.concat(F.lit("doi:"), F.col("id").cast("string")).alias("key"))
    return state.unseen(keys, seen, "key")


REQUEST = "CASE conv_id % 4 WHEN 0 THEN '构建2015—2023年国家面板数据, 青年失业率, 人均GDP, csv' WHEN 1 THEN 'monthly inflation for firms since 2018' WHEN 2 THEN 'download official unemployment rate of provinces, annual' ELSE 'hello' END"


@query("SELECT conv_id, turn, (['country', 'firm', 'province', 'unknown'])[(conv_id % 4 + 1)::INT] AS unit, ([2015, 2018, NULL, NULL])[(conv_id % 4 + 1)::INT]::INT AS year_start, ([2023, 2026, NULL, NULL])[(conv_id % 4 + 1)::INT]::INT AS year_end, (['annual', 'monthly', 'annual', 'unknown'])[(conv_id % 4 + 1)::INT] AS frequency, (['youth_unemployment_rate,unemployment_rate', '', 'unemployment_rate', ''])[(conv_id % 4 + 1)::INT] AS outcomes, (['global', '', '', ''])[(conv_id % 4 + 1)::INT] AS geography FROM conversations")
def requirement_parse(spark, sf):
    rows = requirement.parse(table(spark, sf, "conversations").select("conv_id", "turn", F.expr(REQUEST).alias("q")), "q", 2026)
    r = F.col("requirement")
    return rows.select("conv_id", "turn", r["unit"].alias("unit"), r["year_start"].alias("year_start"), r["year_end"].alias("year_end"), r["frequency"].alias("frequency"), F.array_join(r["outcome"], ",").alias("outcomes"), F.array_join(r["geography"], ",").alias("geography"))


@query("SELECT conv_id, turn, (['DISCOVER_ACQUIRE_BUILD', 'DISCOVER_ONLY', 'DISCOVER_AND_ACQUIRE', 'DISCOVER_ONLY'])[(conv_id % 4 + 1)::INT] AS intent FROM conversations")
def intent_classify(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", requirement.intent(F.expr(REQUEST)).alias("intent"))


@query("SELECT conv_id, turn, CASE WHEN conv_id % 4 = 3 THEN 2 WHEN conv_id % 4 = 2 THEN 0 ELSE 0 END::INT AS n_problems FROM conversations")
def requirement_problems(spark, sf):
    rows = requirement.parse(table(spark, sf, "conversations").select("conv_id", "turn", F.expr(REQUEST).alias("q")), "q", 2026)
    return rows.select("conv_id", "turn", F.size(requirement.problems()).alias("n_problems"))


@query("SELECT p_partkey, (['world_bank', 'world_bank,oecd', '', 'oecd'])[(p_partkey % 4 + 1)::INT] AS ids FROM part")
def provider_aliases(spark, sf):
    names = F.array(F.array(F.lit("World Bank"), F.lit("worldbank")), F.array(F.lit("worldbank"), F.lit("OECD"), F.lit("x")), F.array(F.lit("nope")), F.array(F.lit(" oecd ")))
    mine = F.element_at(names, (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(requirement.canonical_providers(mine, {"world bank": "world_bank", "worldbank": "world_bank", "oecd": "oecd"}), ",").alias("ids"))


@query("""SELECT 'documents' AS provider, 'success' AS status, count(*) AS n_rows FROM documents WHERE contains(lower(text), 'data') UNION ALL SELECT 'pages', 'success', count(*) FROM pages WHERE contains(lower(html), 'data')
UNION ALL SELECT 'conversations', 'success', count(*) FROM conversations WHERE contains(lower(text), 'data') UNION ALL SELECT 'broken', 'failed', 0""")
def search_fanout(spark, sf):
    """Four sources searched at once, one of which fails: a status row for each, and the rows of the others."""
    holds = lambda name, text: lambda s: table(s, sf, name).filter(F.contains(F.lower(text), F.lit("data"))).select(F.col(text).alias("text"))
    broken = lambda s: table(s, sf, "documents").select(F.raise_error(F.lit("no answer")).alias("text"))
    found = fanout.search_all(spark, {"documents": holds("documents", "text"), "pages": holds("pages", "html"), "conversations": holds("conversations", "text"), "broken": broken})
    rows = found.rows.groupBy("provider").agg(F.count("*").alias("n_rows"))
    return found.tasks.select("provider", "status").join(rows, "provider", "left").select("provider", "status", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"))


@query("SELECT doc_id, CASE WHEN n_chars % 1000 / 1000.0 >= 0.6 THEN 'high' WHEN n_chars % 1000 / 1000.0 >= 0.35 THEN 'medium' ELSE 'low' END AS relevance FROM documents")
def relevance_bands(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ranking.relevance(F.col("n_chars") % 1000 / 1000.0).alias("relevance"))


@query("""SELECT key, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN '10.5/' || p_size WHEN p_partkey % 3 = 1 THEN 'arx' || p_size ELSE lower(trim(p_name)) END AS key FROM part) GROUP BY key""")
def paper_keys(spark, sf):
    """Papers under their DOI, else their preprint's number, else their title."""
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    key = dedup.paper_key(F.when(kind == 0, F.concat(F.lit("https://doi.org/10.5/"), size)), F.when(kind == 1, F.concat(F.lit(" ARX"), size)), F.col("p_name"))
    return table(spark, sf, "part").select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n"))
