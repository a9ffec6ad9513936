"""Functions over pages, URLs and text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..registry import query, table
from ..sources.readers import first_table


def _pages(spark, sf):
    return table(spark, sf, "pages")


@query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_title(spark, sf):
    return _pages(spark, sf).select("page_id", text.title(F.col("html")).alias("title"))


def _markdown_sql():
    """The steps of ``text.to_markdown`` in DuckDB's SQL, whose patterns have no back references."""
    cut = lambda e, p, to: f"regexp_replace({e}, '{p}', '{to}', 'g')"
    out = "CASE WHEN m <> '' THEN m WHEN c <> '' THEN c ELSE html END"
    for tag in ("script", "style", "noscript", "head"):
        out = cut(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    for level in range(1, 7):
        out = f"regexp_replace({out}, '(?is)<h{level}\\b[^>]*>(.*?)</h{level}>', chr(10) || '{'#' * level} \\1' || chr(10), 'g')"
    out = cut(out, r"""(?is)<a\b[^>]*href=["\x27]([^"\x27]*)["\x27][^>]*>(.*?)</a>""", r"[\2](\1)")
    out = f"regexp_replace({out}, '(?i)<br\\s*/?>|</(?:p|div|li|tr)>', chr(10), 'g')"
    out = cut(out, r"(?s)<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    out = f"regexp_replace({cut(out, r'[ \t]+', ' ')}, '\\n\\s*\\n+', chr(10) || chr(10), 'g')"
    out = cut(out, r"^\s+|\s+$", "")
    main = r"regexp_extract(html, '(?is)<(?:main|article)[^>]*>(.*?)</(?:main|article)>', 1)"
    content = r"""regexp_extract(html, '(?is)<div[^>]+(?:id|class)="[^"]*(?:content|main)[^"]*"[^>]*>(.*?)</div>\s*(?:<footer|<script|</body)', 1)"""
    return f"SELECT page_id, html, {out} AS text FROM (SELECT page_id, html, {main} AS m, {content} AS c FROM pages)"


MARKDOWN_SQL = _markdown_sql()


@query(f"SELECT page_id, sha256(text) AS text_hash FROM ({MARKDOWN_SQL})")
def html_text_hash(spark, sf):
    """The hash of each page's text, whatever its markup."""
    return _pages(spark, sf).select("page_id", F.sha2(text.to_markdown(F.col("html")), 256).alias("text_hash"))


@query(f"SELECT page_id, '# ' || trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) || chr(10) || chr(10) || text AS page FROM ({MARKDOWN_SQL})")
def html_page_markdown(spark, sf):
    """Each page's text under its title."""
    return _pages(spark, sf).select("page_id", text.page_markdown(F.col("html")).alias("page"))


@query(r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) ELSE 'shared ' || page_id END AS title, CASE WHEN page_id % 2 = 0 THEN 'html:title-tag' ELSE 'og:title' END AS source FROM pages""")
def html_page_title(spark, sf):
    """The pages' titles with the tag they come from; every other page keeps only its shared title."""
    shared = F.concat(F.lit('<meta property="og:title" content="shared '), F.col("page_id").cast("string"), F.lit('">'))
    html = F.when(F.col("page_id") % 2 == 0, F.concat(shared, "html")).otherwise(F.regexp_replace("html", r"(?is)<title[^>]*>.*?</title>", shared))
    found = _pages(spark, sf).select("page_id", text.metadata(html).alias("m"))
    return found.select("page_id", F.col("m.title.value").alias("title"), F.col("m.title.source").alias("source"))


LINKS = ["/a/b", "c/../d", "?q=1", "//other.org/x", "mailto:me@h.org", "https://sub.h.org/y", "http://bad.h.org/z", "../../up"]
FOUND = ["https://h.org/a/b", "https://h.org/p/d", "https://h.org/p/page?q=1", None, None, "https://sub.h.org/y", None, "https://h.org/up"]


@query("SELECT page_id, link FROM (SELECT page_id, " + "[" + ", ".join("NULL" if f is None else f"'{f}'" for f in FOUND) + "][(page_id % 8 + 1)::INT] AS link FROM pages) WHERE link IS NOT NULL")
def link_discovery(spark, sf):
    """Links of pages, absolute, in the allowed domains."""
    href = F.element_at(F.array(*[F.lit(x) for x in LINKS]), (F.col("page_id") % 8 + 1).cast("int"))
    html = F.concat(F.lit('<p><a class="x" href="'), href, F.lit('">y</a></p>'))
    return _pages(spark, sf).select("page_id", F.explode(text.discovered(html, F.lit("https://h.org/p/page?x=2#top"), ("h.org",), ("bad.h.org",))).alias("link"))


@query(r"""SELECT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href=["'']([^"''#]+)', 1)) AS link FROM pages)""")
def html_links(spark, sf):
    return _pages(spark, sf).select("page_id", F.explode(text.links(F.col("html"))).alias("link"))


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<meta[^>]+(?:name|property)=["'']description["''][^>]*content=["'']([^"'']*)["'']', 1) AS description, regexp_extract(html, '(?is)<meta[^>]+(?:name|property)=["'']author["''][^>]*content=["'']([^"'']*)["'']', 1) AS author, regexp_extract(html, '(?is)<link[^>]+rel=["'']canonical["''][^>]*href=["'']([^"'']*)["'']', 1) AS canonical FROM pages""")
def html_metadata(spark, sf):
    h = F.col("html")
    return _pages(spark, sf).select("page_id", text.meta(h, "description").alias("description"), text.meta(h, "author").alias("author"), text.canonical_link(h).alias("canonical"))


@query(r"""SELECT page_id, length(html) < 500 AS thin, len(regexp_extract_all(html, '<[^>]+>')) > length(html) / 10 AS tags, regexp_matches(html, '(?i)enable javascript|requires javascript|please upgrade your browser') AS shell FROM pages""")
def html_quality(spark, sf):
    r = text.quality_reasons(F.col("html"))
    return _pages(spark, sf).select("page_id", F.exists(r, lambda x: x.startswith("thin")).alias("thin"), F.array_contains(r, "unstripped tags remain").alias("tags"), F.array_contains(r, "JS-shell page").alias("shell"))


@query(f"SELECT page_id, text FROM ({MARKDOWN_SQL})")
def html_markdown(spark, sf):
    return _pages(spark, sf).select("page_id", text.to_markdown(F.col("html")).alias("text"))


#: Pages handed to a Python task at once, since one page may be very long; bounds a worker's memory.
BATCH_PAGES = 128


def page_batches(spark: SparkSession) -> None:
    """Bound the rows of the session's Arrow batches; a lower bound of its own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_PAGES:
        spark.conf.set(key, str(BATCH_PAGES))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def tables_of(html: pd.Series) -> pd.Series:
    """Header and rows of each page's first table."""

    def one(page: str | None) -> list | None:
        header, rows = first_table(page or "")
        return [header, *rows] if header else None

    return html.map(one)


@query("SELECT page_id, 'key|value' AS header, (page_id % 4)::INT AS n_rows FROM pages WHERE html IS NOT NULL")
def html_tables(spark, sf):
    """The first table of each page; the test pages have none of their own, so each is given one."""
    rows = F.repeat(F.lit("<tr><td>k</td><td>v</td></tr>"), (F.col("page_id") % 4).cast("int"))
    page_batches(spark)
    html = F.concat("html", F.lit("<table><tr><th>key</th><th>value</th></tr>"), rows, F.lit("</table>"))
    found = _pages(spark, sf).select("page_id", tables_of(html).alias("rows")).filter("rows is not null")
    return found.select("page_id", F.array_join(F.col("rows")[0], "|").alias("header"), (F.size("rows") - 1).alias("n_rows"))


@query("SELECT page_id, '{\"id\": ' || page_id || '}' AS block FROM pages WHERE html IS NOT NULL")
def jsonld_extract(spark, sf):
    """Linked data that parses, of pages that are given one block that does and one that doesn't."""
    script = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    html = F.concat("html", script(F.concat(F.lit('{"id": '), F.col("page_id").cast("string"), F.lit("}"))), script(F.lit("{no json")))
    return _pages(spark, sf).select("page_id", F.explode(text.jsonld_blocks(html)).alias("block")).filter(F.expr("try_parse_json(block) is not null"))


@query("SELECT page_id, lower(substr(html, 1, 4096)) LIKE '%<html%' OR lower(substr(html, 1, 4096)) LIKE '%<!doctype html%' OR lower(substr(html, 1, 4096)) LIKE '%<body%' AS is_html FROM pages")
def html_detect(spark, sf):
    return _pages(spark, sf).select("page_id", text.looks_like_html(F.col("html")).alias("is_html"))


SITEMAP = "'<urlset><url><loc>' || url || '</loc><lastmod>2024-01-0' || (page_id % 9 + 1) || '</lastmod></url><url><loc>' || url || '/b</loc></url></urlset>'"


@query("SELECT page_id, url AS loc, '2024-01-0' || (page_id % 9 + 1) AS lastmod FROM pages UNION ALL SELECT page_id, url || '/b', NULL FROM pages")
def sitemap_parse(spark, sf):
    xml = _pages(spark, sf).select("page_id", F.expr(SITEMAP).alias("xml"))
    return xml.select("page_id", F.explode(text.sitemap_entries(F.col("xml"))).alias("e")).select("page_id", "e.*")


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' password=abc, api_key: "xyz" ',
 '(?i)(password\s*[=:]\s*)("?[^\s"'',;)&]+)', '\1***MASKED***', 'g'), '(?i)(api[_-]?key\s*[=:]\s*)("?[^\s"'',;)&]+)', '\1***MASKED***', 'g'), '(?i)(access[_-]?token\s*[=:]\s*)("?[^\s"'',;)&]+)', '\1***MASKED***', 'g'), '(?i)(refresh[_-]?token\s*[=:]\s*)("?[^\s"'',;)&]+)', '\1***MASKED***', 'g'),
 '(?i)(authorization\s*[=:]\s*)("?[^\s"'',;)&]+)', '\1***MASKED***', 'g'), '(?i)(cookie\s*[=:]\s*)("?[^\s"'',;)&]+)', '\1***MASKED***', 'g'), '(?i)(\botp\s*[=:]\s*)("?[^\s"'',;)&]+)', '\1***MASKED***', 'g'), '("(?:password|api_?key|access_?token|refresh_?token|authorization|cookie|otp)"\s*:\s*")([^"]+)', '\1***MASKED***', 'g')) AS masked FROM documents""")
def redact_secrets(spark, sf):
    raw = F.concat("text", F.lit(' password=abc, api_key: "xyz" '))
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.redact(raw), 256).alias("masked"))


URL_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\.', ''), '[#?].*$', ''), '/+$', '')"


@query(f"SELECT page_id, {URL_SQL} AS key FROM pages")
def url_canon_dedup(spark, sf):
    return _pages(spark, sf).select("page_id", text.dedup_url(F.col("url")).alias("key"))


@query()
def url_canonicalize_crawl(spark, sf):
    return _pages(spark, sf).select("page_id", text.crawl_url(F.concat("url", F.lit("?utm_source=x&id=5&ref=a#top"))).alias("url"))


@query("SELECT doc_id, '10.1000/x' || doc_id AS doi, 'https://doi.org/10.1000/x' || doc_id AS doi_url FROM documents")
def doi_normalize(spark, sf):
    forms = F.array(*[F.concat(F.lit(p), F.col("doc_id").cast("string")) for p in ("https://doi.org/10.1000/X", "doi:10.1000/x", "10.1000/x", "http://dx.doi.org/10.1000/x")])
    raw = F.element_at(forms, (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", text.doi_key(raw).alias("doi"), text.doi_url(raw).alias("doi_url"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(lower(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS key FROM pages")
def title_key(spark, sf):
    return _pages(spark, sf).select("page_id", text.title_key(text.title(F.col("html"))).alias("key"))


@query("SELECT p_partkey, (['csv', 'parquet', 'json', 'unknown'])[(p_partkey % 4 + 1)::INT] AS format FROM part")
def format_of_url(spark, sf):
    names = F.array(*[F.lit(x) for x in ("/a.CSV?x=1", "/b.parquet", "/c.json#y", "/d")])
    url = F.concat(F.lit("https://h.org"), F.element_at(names, (F.col("p_partkey") % 4 + 1).cast("int")))
    return table(spark, sf, "part").select("p_partkey", text.format_of_url(url).alias("format"))


@query("SELECT p_partkey, (['CC-BY-4.0', 'ODbL', 'UNKNOWN', 'MY OWN'])[(p_partkey % 4 + 1)::INT] AS license FROM part")
def license_map(spark, sf):
    raw = F.element_at(F.array(F.lit("cc-by"), F.lit("odc-odbl"), F.lit(""), F.lit("x")), (F.col("p_partkey") % 4 + 1).cast("int"))
    name = F.when(F.col("p_partkey") % 4 == 3, "my own")
    return table(spark, sf, "part").select("p_partkey", text.license_of(raw, name).alias("license"))


@query("SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'bypass captcha' END AS marker FROM conversations")
def reject_unsafe(spark, sf):
    raw = F.when(F.col("conv_id") % 5 == 0, F.lit("How to Bypass CAPTCHA")).otherwise(F.lit("hello"))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.unsafe_marker(raw).alias("marker"))
