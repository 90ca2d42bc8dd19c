"""Field extraction from stored post pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]*>", "")


def first_match(html: Column, pattern: str) -> Column:
    """First capture of ``pattern``, NULL (not empty) when it is missing."""
    return F.when(F.regexp_like(html, F.lit(pattern)), F.regexp_extract(html, pattern, 1))


def all_matches(html: Column, pattern: str, sep: str = "") -> Column:
    """All captures of ``pattern``, joined."""
    return F.array_join(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), sep)


# Where each field of a post sits in a stored page.
POST_FIELDS = {
    "name": r"(?s)<span[^>]*>([^<]*)</span>",
    "handle": r"(?s)<span[^>]*>([^<@]*@[^<]*)</span>",
    "timestamp": r'(?s)<time[^>]*\bdatetime="([^"]*)"',
    "location": r'(?s)<a[^>]*href="/places/[^"]*"[^>]*>\s*<span[^>]*>([^<]*)</span>',
    "text": r'(?s)<div[^>]*\bdata-testid="tweetText"[^>]*>(.*?)</div>',
}
POST_ELEMENT = r"(?s)<article\b.*?</article>"
IMAGE_TEXT = r'(?s)<img[^>]*\balt="([^"]*)"'


def extract_post_fields(
    pages: DataFrame,
    html: str = "html",
    patterns: dict[str, str] | None = None,
    image_text: str = IMAGE_TEXT,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per page that has every field; image descriptions end the text.

    ``patterns`` maps field to a regular expression with one capture. Fields are
    taken without their tags. A page that lacks one is dropped.
    """
    patterns = patterns or POST_FIELDS
    source = F.col(html)
    fields = {name: strip_tags(first_match(source, p)) for name, p in patterns.items()}
    if "text" in fields:
        fields["text"] = F.concat(fields["text"], all_matches(source, image_text))
    picked = pages.select(*(keep or []), *[e.alias(n) for n, e in fields.items()])
    return picked.dropna("any", subset=list(fields))


def extract_posts(
    pages: DataFrame,
    html: str = "html",
    element: str = POST_ELEMENT,
    keep: list[str] | None = None,
    **fields,
) -> DataFrame:
    """One row per post element of a page, numbered by ``post`` from 0 in page order.

    A page may hold any number of posts; elements that lack a field are dropped.
    """
    cut = F.posexplode(F.regexp_extract_all(F.col(html), F.lit(element), F.lit(0)))
    posts = pages.select(*(keep or []), cut.alias("post", "_element"))
    return extract_post_fields(posts, "_element", keep=[*(keep or []), "post"], **fields)


def search_posts(
    posts: DataFrame,
    query: str = "",
    since: str | None = None,
    until: str | None = None,
    within: tuple[float, float, float] | None = None,
) -> DataFrame:
    """Posts that contain ``query``, from ``since`` until before ``until``, newest first.

    ``within`` is (lat, lon, miles). Every condition is a plain filter, so text
    and time conditions reach the scan.
    """
    from geopanel.functions.geo import haversine_miles

    out = posts
    if query:
        out = out.where(F.col("text").contains(query))
    if since is not None:
        out = out.where(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    if until is not None:
        out = out.where(F.col("timestamp") < F.lit(until).cast("timestamp"))
    if within is not None:
        lat, lon, miles = within
        # a latitude band first: cheap and pushed down, the distance decides
        band = miles / 69.0 + 0.01
        out = out.where(F.col("lat").between(lat - band, lat + band))
        distance = haversine_miles(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))
        out = out.where(distance <= miles)
    return out.orderBy(F.desc("timestamp"))
