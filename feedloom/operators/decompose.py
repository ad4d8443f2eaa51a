"""Newsletter items to one item for each article they link.

Links are found by four rules, one after the other, over the whole text, and a
url counts once: markdown links, anchors (tracking links are unwrapped), lines
that end in a url, and title lines with a url nearby.
"""
from __future__ import annotations

import base64
import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.chunks import short_batches

# Urls and titles that are no articles.
BAD_URL = (
    r"/newsletters?(?:[/?#]|$)", r"/issues?(?:[/?#]|$)", r"/archive(?:[/?#]|$)",
    r"/(advertise|sponsor|advertising|partnership|ad-?service|advert|commerci)(?:[/?#]|$)",
    r"/(privacy|terms|policies|legal|disclaimer)(?:[/?#]|$)", r"/(unsubscribe|preferences|settings|manage|opt-?out)(?:[/?#]|$)",
    r"/(media-kit|press|about|contact|info|help)(?:[/?#]|$)", r"/(feeds?|rss|subscribe|signup|join|register|login|sign-?in)(?:[/?#]|$)",
    r"reddit\.com/r/", r"reddit\.com/u/",
    r"(csharpdigest|leadershipintech|reactdigest|programming[?_-]?digest|newsletter[?_-]?digest|tech[?_-]?digest)\.com",
    r"[A-Za-z0-9_]+digest\.[A-Za-z0-9_]+/(?![A-Za-z0-9_-]+/[0-9]+|[A-Za-z0-9_-]+$|p/|post/|article/|story/)",
    r"linktrak\.io", r"click\.linksynergy\.com", r"\.eventbrite\.com/([A-Za-z0-9_-]+)?(?:[/?#]|$)", r"meetup\.com/[^/]+/(?!events?/|members?/)",
)
BAD_TITLE = (r"^advertise$", r"^sponsor$", r"^advertisement$", r"^promotional content$", r"^(subscribe|join|sign up)$")
# Parts of urls on a newsletter's host that are no articles.
POST_ACTIONS = ("open.substack.com/", "action=restack", "action=share", "redirect=app-store")
INTERNAL = (
    "/subscribe", "/app-link/", "submitLike=", "comments=true", "action=share", "action=restack", "/action/disable_email", "redirect=app-store",
    "open.substack.com/", "eotrx.substackcdn.com/", "substackcdn.com/open",
)
LINE_INTERNAL = ("/redirect/", "/app-link/", "/subscribe", "substackcdn.com/open", "open.substack.com/")
TRACKER = "tracking.tldrnewsletter"

# How links are written, in the order in which they are looked for.
MARKDOWN = re.compile(r"\[([^\]]+)\]\((https?://[^)]+)\)")
ANCHOR = re.compile(r"""<a\s+[^>]*?href=["']([^"']+)["'][^>]*>(.*?)</a>""", re.I)
LINE = re.compile(r"""^(\d+\.\s+)?(.+?)(?:\s*[-–]|\s+)?(https?://[^\s<>"]+)""", re.M)
HEADER = re.compile(r"^([^\n—-]{10,150})\s+(?:—|-)\s+([A-Za-z\s]+?)(?:\n|\Z)", re.M)
NEARBY = re.compile(r"""https?://[^\s<>"')]+""")


class Finder:
    def __init__(self, aggregators: Sequence[str] = ()) -> None:
        self.aggregators = tuple(aggregators)
        self.bad_url = re.compile("|".join(f"(?:{p})" for p in BAD_URL), re.I)
        self.bad_title = re.compile("|".join(BAD_TITLE), re.I)

    def _good(self, url: str, title: str = "") -> bool:
        return not (any(a in url for a in self.aggregators) or url.startswith("javascript:") or self.bad_url.search(url) or self.bad_title.search(title))

    @staticmethod
    def _post(url: str) -> bool:
        return ("substack.com/" in url or "substackcdn.com/" in url) and "/p/" in url and not any(a in url for a in POST_ACTIONS)

    def _inside(self, url: str, marks: Sequence[str]) -> bool:
        """A page of the newsletter's host that is no article."""
        return ("substack.com/" in url or "substackcdn.com/" in url) and not self._post(url) and any(m in url for m in marks)

    @staticmethod
    def unwrapped(url: str) -> str:
        """The target of a tracking link."""
        if "/CL0/" in url:
            found = re.search(r"/CL0/(.+?)/\d+/", url)
            if found:
                url = found[1]
                for code, char in (("%2F", "/"), ("%3A", ":"), ("%3D", "="), ("%3F", "?")):
                    url = url.replace(code, char)
        found = re.search(r"substack\.com/redirect/2/([A-Za-z0-9_-]+)", url)
        if found:
            try:
                coded = found[1] + "=" * (-len(found[1]) % 4)
                target = json.loads(base64.urlsafe_b64decode(coded)).get("e")
                url = target if isinstance(target, str) and target else url
            except (ValueError, AttributeError):
                pass
        return url

    def links(self, html: str | None) -> list[tuple[str, str]]:
        """(title, url) of each article, in the order that the rules find them."""
        text = html or ""
        for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
            text = text.replace(entity, char)
        found: dict[str, str] = {}

        def put(url: str, title: str) -> None:
            if title and url and url not in found and self._good(url, title.strip()):
                found[url] = title.strip()

        for title, url in MARKDOWN.findall(text):
            put(url, title)
        for url, inner in ANCHOR.findall(text.replace("\n", "")):
            url, title = self.unwrapped(url), re.sub(r"<[^>]*>", "", inner).strip()
            slug = re.search(r"/p/([^?#]+)", url)
            if self._post(url) and len(title) < 3 and slug:
                title = re.sub(r"\b\w", lambda m: m[0].upper(), slug[1].replace("-", " "))
            if not self._inside(url, INTERNAL) and "substack.com/redirect/" not in url:
                put(url, title)
        for _, title, url in LINE.findall(text):
            if TRACKER not in url and not self._inside(url, LINE_INTERNAL) and len(title.strip()) < 200:
                put(url, title)
        for header in HEADER.finditer(text):
            near = NEARBY.search(text[header.end() : header.end() + 500])
            if near and header[1].strip() not in found and near[0] not in found and TRACKER not in near[0] and self._good(near[0]):
                found[near[0]] = header[1].strip()
        return [(title, url.strip()) for url, title in found.items()]


def decompose(items: DataFrame, newsletters: Sequence[str], html: str = "summary", aggregators: Sequence[str] = ()) -> DataFrame:
    """Items where those of a newsletter are replaced by their articles.

    items: id, source_title, title, url, summary, bm25, final and others.  An
    article's id is "{id}-article-{n}", its bm25 0.95 and its final 0.9 of the
    newsletter's; a newsletter with one article stays one row with its title and
    url and unchanged scores; one without any stays as it is.
    """

    short_batches()

    @F.pandas_udf("array<struct<title:string,url:string>>")
    def found(texts: pd.Series) -> pd.Series:
        finder = Finder(aggregators)
        return texts.map(lambda t: [{"title": a, "url": b} for a, b in finder.links(t)])

    letter = F.lit(False)
    for name in newsletters:
        letter = letter | F.col("source_title").contains(name)
    letters = items.where(letter)
    rows = letters.withColumn("__a", found(F.col(html))).withColumn("__n", F.size("__a"))
    rows = rows.select("*", F.posexplode_outer("__a").alias("__k", "__x"))
    many, any_found = F.col("__n") > 1, F.col("__n") > 0
    out = rows.withColumns({
        "id": F.when(many, F.concat(F.col("id").cast("string"), F.lit("-article-"), (F.col("__k") + 1).cast("string"))).otherwise(F.col("id").cast("string")),
        "title": F.when(any_found, F.col("__x.title")).otherwise(F.col("title")), "url": F.when(any_found, F.col("__x.url")).otherwise(F.col("url")),
        "summary": F.when(any_found, F.col("__x.title")).otherwise(F.col("summary")),
        "bm25": F.when(many, F.col("bm25") * 0.95).otherwise(F.col("bm25")), "final": F.when(many, F.col("final") * 0.9).otherwise(F.col("final")),
    }).select(*items.columns)
    return items.where(~letter | F.col("source_title").isNull()).withColumn("id", F.col("id").cast("string")).unionByName(out)
