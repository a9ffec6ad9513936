"""Functions over raw HTML, URLs and text, all as built-in expressions but where noted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, masks of secrets, markers of pages and requests.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "referrer")
SECRETS = (
    r"(?i)(password\s*[=:]\s*)(\"?[^\s\"',;)&]+)",
    r"(?i)(api[_-]?key\s*[=:]\s*)(\"?[^\s\"',;)&]+)",
    r"(?i)(access[_-]?token\s*[=:]\s*)(\"?[^\s\"',;)&]+)",
    r"(?i)(refresh[_-]?token\s*[=:]\s*)(\"?[^\s\"',;)&]+)",
    r"(?i)(authorization\s*[=:]\s*)(\"?[^\s\"',;)&]+)",
    r"(?i)(cookie\s*[=:]\s*)(\"?[^\s\"',;)&]+)",
    r"(?i)(\botp\s*[=:]\s*)(\"?[^\s\"',;)&]+)",
    r"(\"(?:password|api_?key|access_?token|refresh_?token|authorization|cookie|otp)\"\s*:\s*\")([^\"]+)",
)
SHELL_PAGE = r"(?i)enable javascript|requires javascript|please upgrade your browser"
UNSAFE = ("绕过验证码", "bypass captcha", "破解密码", "crack password", "爬取付费", "bypass paywall")
LICENSES = {
    "cc-by-4.0": "CC-BY-4.0", "cc-by-3.0": "CC-BY-3.0", "cc-by": "CC-BY-4.0", "cc0-1.0": "CC0-1.0", "cc-zero": "CC0-1.0",
    "odc-by": "ODbL", "odc-pddl": "CC0-1.0", "odc-odbl": "ODbL", "other-open": "OPEN(unknown type)", "uk-ogl": "OGL-UK",
    "notspecified": "UNKNOWN", "": "UNKNOWN",
}
FORMATS = {"csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "jsonl", "parquet": "parquet", "xlsx": "xlsx", "xls": "xls", "zip": "zip", "gz": "gz", "xml": "xml", "html": "html", "txt": "txt", "dta": "dta", "sav": "sav", "geojson": "geojson", "shp": "shp", "nc": "netcdf", "tar": "tar", "pdf": "pdf", "rdf": "rdf"}
MASK = "***MASKED***"


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def meta(html: Column, name: str) -> Column:
    return F.regexp_extract(html, rf"(?is)<meta[^>]+(?:name|property)=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)


def canonical_link(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<link[^>]+rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']*)[\"']", 1)


def to_markdown(html: Column) -> Column:
    """The main part's text: headings as #, links as [text](url), scripts and tags dropped, blanks collapsed.

    The main part is the first main or article, else a division named content or main that ends the body, else the page.
    """
    main = F.regexp_extract(html, r"(?is)<(main|article)[^>]*>(.*?)</\1>", 2)
    content = F.regexp_extract(html, r"(?is)<div[^>]+(?:id|class)=\"[^\"]*(?:content|main)[^\"]*\"[^>]*>(.*?)</div>\s*(?:<footer|<script|</body)", 1)
    out = F.when(main != "", main).when(content != "", content).otherwise(html)
    out = F.regexp_replace(out, r"(?is)<(script|style|noscript|head)\b[^>]*>.*?</\1>", " ")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", "\n" + "#" * level + " $1\n")
    out = F.regexp_replace(out, r"(?is)<a\b[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "[$2]($1)")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|li|tr)>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\n\s*\n+", "\n\n"), r"^\s+|\s+$", "")


def page_markdown(html: Column) -> Column:
    """The main part's text under the page's title."""
    return F.when(title(html) != "", F.concat(F.lit("# "), title(html), F.lit("\n\n"), to_markdown(html))).otherwise(to_markdown(html))


def metadata(html: Column) -> Column:
    """What a page says of itself, each value with the tag that it came from; null where there is none."""

    def said(value: Column, source: str) -> Column:
        return F.when(value != "", F.struct(F.trim(value).alias("value"), F.lit(source).alias("source")))

    return F.struct(
        F.coalesce(said(title(html), "html:title-tag"), said(meta(html, "og:title"), "og:title")).alias("title"),
        said(meta(html, "description"), "html:description-tag").alias("description"),
        said(meta(html, "author"), "html:author-tag").alias("author"),
        said(canonical_link(html), "html:canonical-tag").alias("canonical"),
    )


def links(html: Column) -> Column:
    """All href values, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?i)href=[\"']([^\"'#]+)"), F.lit(1))


def quality_reasons(text: Column) -> Column:
    """Why a page's text won't do, as an array; empty where it will."""
    tags = F.regexp_count(text, F.lit(r"<[^>]+>"))
    return F.array_compact(
        F.array(
            F.when(F.length(text) < 500, F.concat(F.lit("thin text ("), F.length(text).cast("string"), F.lit(" chars)"))),
            F.when(tags > F.length(text) / 10, "unstripped tags remain"),
            F.when(text.rlike(SHELL_PAGE), "JS-shell page"),
        )
    )


def looks_like_html(raw: Column) -> Column:
    head = F.lower(F.substring(raw, 1, 4096))
    return head.contains("<html") | head.contains("<!doctype html") | head.contains("<body")


def jsonld_blocks(html: Column) -> Column:
    """Texts of the linked-data scripts of at most a million characters."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    return F.filter(found, lambda x: F.length(x) <= 1_000_000)


def sitemap_entries(xml: Column) -> Column:
    """Array of (loc, lastmod) of a sitemap."""
    entries = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:url|sitemap|item)\b[^>]*>(.*?)</(?:url|sitemap|item)>"), F.lit(1))
    return F.transform(
        entries,
        lambda x: F.struct(
            F.trim(F.regexp_extract(x, r"(?is)<(?:loc|link)>(.*?)</", 1)).alias("loc"),
            F.nullif(F.trim(F.regexp_extract(x, r"(?is)<(?:lastmod|pubDate)>(.*?)</", 1)), F.lit("")).alias("lastmod"),
        ),
    )


def redact(text: Column, values: tuple[str, ...] = ()) -> Column:
    """Secrets masked by their names' patterns, and any registered values."""
    for v in values:
        if len(v) >= 3:
            text = F.replace(text, F.lit(v), F.lit(MASK))
    for p in SECRETS:
        text = F.regexp_replace(text, p, "$1" + MASK.replace("*", "\\*"))
    return text


def dedup_url(url: Column) -> Column:
    """A URL as a key: lower case, without scheme, www, fragment, query and last slashes."""
    out = F.regexp_replace(F.lower(F.trim(url)), r"^https?://", "")
    out = F.regexp_replace(F.regexp_replace(out, r"^www\.", ""), r"[#?].*$", "")
    return F.regexp_replace(out, r"/+$", "")


def crawl_url(url: Column) -> Column:
    """A URL to fetch: host in lower case, default ports, tracking parameters, fragment and last slashes dropped."""
    whole = F.regexp_replace(url, "#.*$", "")
    part = lambda p: F.try_parse_url(whole, F.lit(p))
    host = F.lower(part("HOST"))
    port = F.regexp_extract(part("AUTHORITY"), r":(\d+)$", 1)
    where = F.when(port.isin("", "80", "443"), host).otherwise(F.concat(host, F.lit(":"), port))
    path = F.when(F.coalesce(part("PATH"), F.lit("")) == "", "/").otherwise(part("PATH"))
    path = F.when(F.length(path) > 1, F.regexp_replace(path, r"/+$", "")).otherwise(path)
    kept = F.filter(F.split(part("QUERY"), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    query = F.array_join(F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))), "&")
    return F.concat(part("PROTOCOL"), F.lit("://"), where, path, F.when(F.coalesce(query, F.lit("")) != "", F.concat(F.lit("?"), query)).otherwise(""))


def absolute(base: Column, href: Column) -> Column:
    """A link's address as seen from the page ``base``; dots in paths are taken out."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(page == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    joined = (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(page, href)).otherwise(F.concat(folder, href))
    )
    return _without_dots(joined)


def _without_dots(url: Column) -> Column:
    """An address whose path has no "." and ".." left, however many there are; steps above the root stay at the root."""
    root = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)/", 1)
    rest = F.substring(url, F.length(root) + 1, F.length(url))
    path, tail = F.regexp_extract(rest, r"^([^?#]*)", 1), F.regexp_extract(rest, r"([?#].*)$", 1)
    step = lambda kept, part: F.when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))
    parts = F.aggregate(F.split(F.substring(path, F.lit(2), F.length(path)), "/"), F.array().cast("array<string>"), step)
    last = F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")
    clean = F.regexp_replace(F.concat(F.lit("/"), F.array_join(parts, "/"), last), "^//$", "/")
    return F.when((root != "") & path.rlike(r"/\.\.?(/|$)"), F.concat(root, clean, tail)).otherwise(url)


# Beginnings of links that lead to no page.
NO_PAGE = ("mailto:", "javascript:", "data:", "tel:", "#")


def discovered(html: Column, base: Column, domains: tuple[str, ...], denied: tuple[str, ...] = (), same_host: bool = False) -> Column:
    """Addresses that a page links to within the allowed domains, absolute and in order."""
    found = F.transform(F.regexp_extract_all(html, F.lit(r'(?i)<a[^>]+href="([^"]+)"'), F.lit(1)), lambda h: F.trim(h))
    pages = F.filter(found, lambda h: (h != "") & ~h.rlike("^(" + "|".join(NO_PAGE) + ")"))
    host = lambda u: F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))

    def within(u: Column) -> Column:
        ok = F.lit(False)
        for d in domains:
            ok = ok | host_matches(host(u), d.lower())
        for d in denied:
            ok = ok & ~host_matches(host(u), d.lower())
        return ok & (host(u) == host(base)) if same_host else ok

    return F.filter(F.transform(pages, lambda h: absolute(base, h)), within)


def host_matches(host: Column, domain: str) -> Column:
    return (host == domain) | host.endswith(f".{domain}")


def format_of_url(url: Column) -> Column:
    ext = F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), ext), F.lit("unknown"))


def license_of(identifier: Column, name: Column) -> Column:
    raw = F.coalesce(F.nullif(identifier, F.lit("")), F.nullif(name, F.lit("")), F.lit("UNKNOWN"))
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in LICENSES.items() for x in kv]), F.lower(raw))
    return F.coalesce(found, F.upper(F.coalesce(F.nullif(name, F.lit("")), raw)))


def doi_key(raw: Column) -> Column:
    """A DOI in lower case without resolver, null where it isn't one."""
    out = F.regexp_replace(F.lower(F.trim(raw)), r"^(https?://)?(dx\.)?doi\.org/|^doi:\s*", "")
    return F.when(out.startswith("10."), out)


def doi_url(raw: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), doi_key(raw))


def title_key(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(raw), r"[^a-z0-9 ]", " "), r" +", " "))


def unsafe_marker(text: Column) -> Column:
    """The first marker of a request that policy refuses, null where there is none."""
    return F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(m)), m) for m in UNSAFE])


def first_of_languages(translations: Column) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(translations, F.lit(k)), F.lit("")) for k in ("en", "de", "fr", "it", "es", "nl")])


def topic(text: Column) -> Column:
    """The first run of Chinese characters, at most 30."""
    return F.regexp_extract(text, r"([\x{4e00}-\x{9fff}]{2,30})", 1)
