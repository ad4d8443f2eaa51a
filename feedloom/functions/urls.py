"""URL columns."""
from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions import config, whatwg
from feedloom.functions.text import any_match, col, contains

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?"


def hostname(url: Column | str) -> Column:
    """Lower-case host without port; null if the url has none."""
    return F.nullif(F.lower(F.regexp_extract(col(url), AUTHORITY, 1)), F.lit(""))


def path(url: Column | str) -> Column:
    """Path from its slash; an empty path is "/"."""
    found = F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", F.lit("/")).otherwise(found)


#: Urls whose key can be read off: a lower-case name that doesn't end in a number, a
#: port of few digits, and a path of safe characters without dot segments.
PLAIN = r"^https?://(?=[^/?#:]*[a-z-](?:[:/?#]|$))[a-z0-9-]+(?:\.[a-z0-9-]+)*(?::[0-9]{0,4})?(?:/(?!(?:\.|%2[eE]){1,2}(?:[/?#]|$))[A-Za-z0-9._~!$&'()*+,;=:@%-]*)*(?:[?#][!-~]*)?$"


def url_key(url: Column | str) -> Column:
    """host + path by the URL standard, which query, fragment, port, user and the host's
    case don't change; null if the url can't be parsed without a base.

    Most urls are plain, and their parts are cut out by expressions; others (dot
    segments, characters that must be encoded, other alphabets, numbers as hosts,
    backslashes, other schemes) are parsed in Arrow batches, in which plain ones are null.
    """
    u = col(url)
    plain = F.coalesce(u.rlike(PLAIN) & ~F.lower(hostname(u)).rlike("(?:^|\\.)xn--"), F.lit(False))
    return F.when(plain, F.concat(hostname(u), path(u))).otherwise(F.arrow_udf(_parsed_keys, "string")(F.when(~plain, u)))


def _parsed_keys(urls: pa.Array) -> pa.Array:
    return pa.array([None if u is None else whatwg.key(u) for u in urls.to_pylist()], pa.string())


def final_url(url: Column | str, extracted: Column | str, aggregators: Sequence[str]) -> Column:
    """The url unless it is empty or an aggregator's, else the extracted one, else the url."""
    own = col(url)
    poor = F.coalesce(own, F.lit("")) == ""
    for host in aggregators:
        poor = poor | contains(own, host)
    return F.when(poor, F.coalesce(F.nullif(col(extracted), F.lit("")), own)).otherwise(own)


def is_web(url: Column | str) -> Column:
    return F.coalesce(col(url).startswith("http://") | col(url).startswith("https://"), F.lit(False))


def valid_url(url: Column | str, aggregators: Sequence[str] = ()) -> Column:
    """http(s) and not on an aggregator's host."""
    good = is_web(url)
    for host in aggregators:
        good = good & ~contains(url, host)
    return good


def bad_review_url(url: Column | str) -> Column:
    """Rejected by a digest review; an empty url is."""
    u = F.coalesce(col(url), F.lit(""))
    bad = (u == "") | any_match(u, config.BAD_URL)
    for domain in config.BAD_DOMAINS:
        bad = bad | contains(u, domain)
    links = contains(u, "/links/") & u.rlike("(?i)programmingdigest|digest")
    issue = F.regexp_replace(u, r"\?.*$", "").rlike(r"newsletters?/[0-9]+|issues?/[0-9]+|archive|index|(?:/[0-9]+$)")
    return bad | links | (issue & u.rlike("(?i)programmingdigest|csharpdigest|leadershipintech|reactdigest"))


def excluded_item(url: Column | str) -> Column:
    return any_match(url, config.EXCLUDED_ITEM)


def site_name(url: Column | str) -> Column:
    """Host without a leading "www."."""
    return F.regexp_replace(hostname(url), r"^www\.", "")


def metadata(url: Column | str) -> tuple[Column, Column]:
    """Author and source: on substack.com the subdomain, on medium.com the "@name" in
    the path; elsewhere, and without such a name, no author.  The source is the
    blog's host, or the site."""
    u = col(url)
    site = F.replace(hostname(u), F.lit("www."), F.lit(""))
    letter = F.nullif(F.regexp_extract(u, r"https://([^.]+)\.substack\.com", 1), F.lit(""))
    writer = F.nullif(F.regexp_extract(u, r"medium\.com/@([^/]+)", 1), F.lit(""))
    on_letter = contains(site, "substack.com") & letter.isNotNull()
    medium, dev = contains(site, "medium.com"), contains(site, "dev.to")
    good = F.coalesce(u.startswith("http"), F.lit(False))
    author = F.when(good & on_letter, letter).when(good & medium, writer)
    source = F.when(on_letter, "substack.com").when(medium, "medium.com").when(dev, "dev.to").otherwise(site)
    return author, F.when(good, source)


def bad_podcast_url(url: Column | str) -> Column:
    """Rejected for an episode; an empty url is."""
    u = F.coalesce(col(url), F.lit(""))
    return (u == "") | any_match(u, config.BAD_PODCAST_URL)


def bad_search_url(url: Column | str) -> Column:
    """Rejected as a search result; an empty url is."""
    u = F.coalesce(col(url), F.lit(""))
    return (u == "") | any_match(u, config.BAD_SEARCH_URL)


def first_url(text: Column | str, bad: Sequence[str] = config.BAD_FOUND_URL) -> Column:
    """The first url in a text that no bad pattern fits, or null."""
    found = F.regexp_extract_all(col(text), F.lit("""https?://[^\\s<>"')]+"""), F.lit(0))
    return F.get(F.filter(found, lambda u: ~any_match(u, bad)), F.lit(0))


def search_query(title: Column | str) -> Column:
    """What is searched for an article: 80 characters of its title without signs, or the title."""
    short = F.regexp_replace(F.substring(col(title), 1, 80), r"[^A-Za-z0-9_\s-]", "")
    short = F.regexp_replace(short, r"^\s+|\s+$", "")
    return F.when(short == "", col(title)).otherwise(short)


def paper_url(code: Column | str, base: str) -> Column:
    """A paper's page: the code in percent encoding, spaces too."""
    return F.concat(F.lit(base), F.regexp_replace(F.url_encode(col(code)), r"\+", "%20"))


def unwrap_cl0(url: Column | str) -> Column:
    """The target of a /CL0/<encoded>/<digits>/ tracking link, slashes included; other urls as they are."""
    found = F.regexp_extract(col(url), r"/CL0/(.+?)/[0-9]+/", 1)
    for code, char in (("%2F", "/"), ("%3A", ":"), ("%3D", "="), ("%3F", "?")):
        found = F.replace(found, F.lit(code), F.lit(char))
    return F.when(found != "", found).otherwise(col(url))


def unwrap_base64(url: Column | str, host: str = "substack.com") -> Column:
    """The target ("e") in the JSON of a <host>/redirect/2/<base64url> link; other urls, and other hosts', as they are."""
    coded = F.translate(F.regexp_extract(col(url), re.escape(host) + r"/redirect/2/([A-Za-z0-9_-]+)", 1), "-_", "+/")
    json = F.try_to_binary(coded, F.lit("base64")).cast("string")
    return F.coalesce(F.when(coded != "", F.nullif(F.get_json_object(json, "$.e"), F.lit(""))), col(url))


def arxiv_id(url: Column | str) -> Column:
    """The id in an arXiv url, or null."""
    return F.nullif(F.regexp_extract(col(url), r"arxiv\.org/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5})", 1), F.lit(""))


def arxiv_url(bibcode: Column | str, fixed: bool = False) -> Column:
    """The abstract's url for a bibliographic code, or null.  The plain rule wants seven
    digits (and puts the letter after the dot); `fixed` reads the usual nine."""
    if fixed:
        found = F.regexp_extract(col(bibcode), r"^[0-9]{4}arXiv([0-9]{4})([0-9]{5})[A-Z]$", 0)
        made = F.regexp_replace(found, r"^[0-9]{4}arXiv([0-9]{4})([0-9]{5})[A-Z]$", "https://arxiv.org/abs/$1.$2")
    else:
        found = F.regexp_extract(col(bibcode), r"^[0-9]{4}arXiv([0-9]{2})([0-9]{5})([A-Z])$", 0)
        made = F.regexp_replace(found, r"^[0-9]{4}arXiv([0-9]{2})([0-9]{5})([A-Z])$", "https://arxiv.org/abs/$1$2.$3")
    return F.when(found != "", made)
