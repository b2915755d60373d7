"""HTML and URL functions as Column expressions; entities are decoded by a small Arrow function."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements whose text is no content, attribute words of furniture, and file endings that are no pages.
DROPPED = ["script", "style", "nav", "header", "footer", "aside", "iframe", "noscript"]
FURNITURE_CLASSES = ["menu", "navigation", "sidebar"]
NO_PAGES = ["pdf", "jpg", "jpeg", "png", "gif", "webp", "svg", "zip", "rar", "mp3", "mp4", "doc", "docx", "xls", "xlsx", "css", "js", "xml", "json"]
NO_PATHS = ["/admin", "/login", "/logout", "/register", "/cart", "/wp-admin", "/search", "/tag/", "/feed"]
# Fixed values of the crawl of a whole site: file endings, and parts of paths, that are no pages.
SITE_NO_PAGES = ["pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "exe", "mp3", "mp4", "avi", "jpg", "jpeg", "png", "gif", "css", "js", "json", "xml", "svg", "ico", "woff", "ttf"]
SITE_NO_PATHS = ["/admin", "/wp-admin", "/wp-content", "/assets", "/static", "/images", "/img", "/js", "/css", "/fonts", "/media", "/uploads", "/download", "/api", "/ajax"]


@F.pandas_udf(StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    """HTML entities as characters; only rows that have '&' should be sent here."""
    return text.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """The five basic entities and &nbsp; natively. For all others use decode_entities."""
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def clean_text(c: Column) -> Column:
    """The visible text of a page: without dropped elements and furniture blocks, entities decoded before tags are removed."""
    for tag in DROPPED:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    for word in FURNITURE_CLASSES:
        c = F.regexp_replace(c, rf"(?is)<(div|ul|section)\b[^>]*class=[\"'][^\"']*{word}[^\"']*[\"'][^>]*>.*?</\1>", " ")
    c = F.regexp_replace(unescape(c), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t\r]+", " "), r"\s*\n\s*", "\n"))


def _inside(c: Column, tag: str) -> Column:
    return F.trim(unescape(F.regexp_extract(c, rf"(?i)<{tag}[^>]*>([^<]+)</{tag}>", 1)))


def clean_title(t: Column) -> Column:
    """Without a site name behind the last separator, where what stands before is the longer part."""
    # Separators before a site's name.
    seps = F.array(*map(F.lit, [" - ", " | ", " :: ", " / ", " — "]))

    def step(t: Column, sep: Column) -> Column:
        after = F.call_function("substring_index", t, sep, F.lit(-1))
        head = F.substring(t, F.lit(1), F.length(t) - F.length(after) - F.length(sep))
        return F.when(t.contains(sep) & (F.length(head) > F.length(after)) & (F.length(head) > 10), head).otherwise(t)

    return F.trim(F.aggregate(seps, F.regexp_replace(t, r"\s+", " "), step))


def title(c: Column, url: Column) -> Column:
    """The page's title: <title>, else <h1>, else og:title, of 6 to 200 bytes; else one made of the host."""
    og = F.trim(unescape(F.regexp_extract(c, r"(?i)<meta[^>]+property=[\"']og:title[\"'][^>]+content=[\"']([^\"']+)[\"']", 1)))
    fit = lambda t: F.when((F.octet_length(t) > 5) & (F.octet_length(t) <= 200), clean_title(t))
    # The title of a page without one, and the name of a host that isn't known.
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("bilinməyən mənbə"))
    return F.coalesce(fit(_inside(c, "title")), fit(_inside(c, "h1")), fit(og), F.concat(F.lit("İmport edilmiş məzmun - "), host))


def meta(c: Column, name: str) -> Column:
    """The content of a named meta element; null if there is none."""
    found = F.regexp_extract(c, rf"(?i)<meta\s+name=[\"']{name}[\"']\s+content=[\"']([^\"']*)[\"']", 1)
    return F.when(found != "", found)


def charset(c: Column) -> Column:
    found = F.lower(F.regexp_extract(c, r"(?i)<meta[^>]+charset=[\"']?([A-Za-z0-9_-]+)", 1))
    return F.when(found != "", found)


def host(url: Column) -> Column:
    """Lower case host without www."""
    return F.regexp_replace(F.lower(F.try_parse_url(F.trim(url), F.lit("HOST"))), r"^www\.", "")


def absolute(link: Column, base: Column) -> Column:
    """A link as seen on the page BASE, without its fragment; null for anchors, scripts, mail and phone links."""
    scheme = F.lower(F.try_parse_url(base, F.lit("PROTOCOL")))
    root = F.concat(scheme, F.lit("://"), F.regexp_replace(F.try_parse_url(base, F.lit("AUTHORITY")), "^.*@", ""))  # the port too
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(://[^/]+/?.*?)[^/]*$", "$1")
    at = F.when(link.rlike("(?i)^https?://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(folder, link))
    return F.when(~link.rlike(r"(?i)^(#|javascript:|mailto:|tel:)") & (link != ""), F.regexp_replace(at, "#.*$", ""))


def links(pages: DataFrame, key: str, url: str, content: str) -> DataFrame:
    """(KEY, link) for every different link on a page that leads to the page's own host."""
    found = pages.where(F.col(content).contains("href")).select(key, F.col(url).alias("u"), F.explode(F.regexp_extract_all(content, F.lit(r"(?i)href=[\"']([^\"']+)[\"']"), F.lit(1))).alias("l"))
    out = found.select(key, "u", absolute(F.trim("l"), F.trim("u")).alias("link")).where("link is not null")
    return out.where(host(F.col("link")) == host(F.col("u"))).select(key, "link").distinct()


def in_scope(link: Column, base: Column) -> Column:
    """Same scheme and host, same first path segment as the start page (if it has one), and neither a file nor an excluded path."""
    part = lambda u, p: F.lower(F.try_parse_url(u, F.lit(p)))
    first = lambda u: F.regexp_extract(F.coalesce(part(u, "PATH"), F.lit("")), r"^/([^/]*)/?", 1)
    path = F.coalesce(part(link, "PATH"), F.lit(""))
    bad = path.rlike(r"\.(" + "|".join(NO_PAGES) + ")$") | F.exists(F.array(*map(F.lit, NO_PATHS)), lambda x: path.startswith(x))
    return F.coalesce((part(link, "PROTOCOL") == part(base, "PROTOCOL")) & (part(link, "HOST") == part(base, "HOST")) & ((first(base) == "") | (first(link) == first(base))) & ~bad, F.lit(False))


def in_site_scope(link: Column, base: Column, siblings: bool = False) -> Column:
    """Whether LINK belongs to the crawl of a whole site from the page BASE: its scheme and host, and on or below its path.

    With SIBLINGS pages count too that differ from BASE in the last segment only, from two segments on. Files and paths with an excluded part
    are out, as are null links and links without a scheme.
    """
    part = lambda u, i: F.regexp_extract(F.trim(u), r"^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)", i)
    path = lambda u: F.regexp_replace(part(u, 3), "/+$", "")
    same = (part(link, 2) != "") & (F.lower(part(link, 1)) == F.lower(part(base, 1))) & (F.lower(part(link, 2)) == F.lower(part(base, 2)))
    inside = F.concat(path(link), F.lit("/")).startswith(F.concat(path(base), F.lit("/")))
    if siblings:
        parents = r"/[^/]+$"  # doubled slashes are one
        one = lambda u: F.regexp_replace(path(u), "/+", "/")
        up = lambda u: F.regexp_replace(one(u), parents, "")
        inside = inside | ((up(base) != "") & (up(link) == up(base)) & (one(link) != one(base)))
    low = F.lower(path(link))
    bad = low.rlike(r"\.(" + "|".join(SITE_NO_PAGES) + ")$") | low.rlike("|".join(SITE_NO_PATHS))
    return F.coalesce(same & inside & ~bad, F.lit(False))
