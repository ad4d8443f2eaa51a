"""Digests as Markdown and HTML: one text for each issue."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import config
from feedloom.functions.text import col


def escaped(text: Column | str) -> Column:
    """Text for HTML."""
    out = F.coalesce(col(text), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def newsletter(digests: DataFrame, key: str, title: str, html: bool = False) -> DataFrame:
    """(key, body): all digests of an issue by category, in the fixed order of
    categories, the best first.  Takes key, category, relevance, title, url,
    source_title, gist and key_bullets.  An issue is one row, so its size follows
    the digests that the caller has put into it."""
    place = F.create_map(*[x for k, c in enumerate(config.DIGEST_ORDER) for x in (F.lit(c), F.lit(k))])
    label = F.create_map(*[F.lit(x) for pair in config.DIGEST_LABEL.items() for x in pair])
    name = F.coalesce(F.element_at(label, F.col("category")), F.initcap(F.replace(F.col("category"), F.lit("_"), F.lit(" "))))
    bullets = F.coalesce("key_bullets", F.array().cast("array<string>"))
    if html:
        points = F.concat(F.lit("<ul>"), F.array_join(F.transform(bullets, lambda b: F.concat(F.lit("<li>"), escaped(b), F.lit("</li>"))), ""), F.lit("</ul>"))
        entry = F.concat(F.lit('<article><h3><a href="'), escaped("url"), F.lit('">'), escaped("title"), F.lit("</a></h3><p><em>"), escaped("source_title"), F.lit("</em></p><p>"), escaped("gist"), F.lit("</p>"), points, F.lit("</article>"))
        section = lambda x: F.concat(F.lit("<section><h2>"), x["name"], F.lit("</h2>"), x["body"], F.lit("</section>"))
        head = f"<h1>{title}</h1>"
    else:
        plain = lambda c: F.coalesce(c, F.lit(""))
        points = F.array_join(F.transform(bullets, lambda b: F.concat(F.lit("- "), b)), "\n")
        entry = F.concat(F.lit("### ["), plain("title"), F.lit("]("), plain("url"), F.lit(")\n\n*"), plain("source_title"), F.lit("*\n\n"), plain("gist"), F.lit("\n\n"), points, F.lit("\n\n"))
        section = lambda x: F.concat(F.lit("## "), x["name"], F.lit("\n\n"), x["body"])
        head = f"# {title}\n\n"
    rows = digests.select(key, F.coalesce(F.element_at(place, F.col("category")), F.lit(99)).alias("p"), name.alias("name"), (-F.col("relevance")).alias("r"), "title", entry.alias("entry"))
    rows = rows.groupBy(key, "p", "name").agg(F.array_sort(F.collect_list(F.struct("r", "title", "entry"))).alias("entries"))
    rows = rows.select(key, F.struct("p", "name", F.array_join(F.transform("entries", lambda e: e["entry"]), "").alias("body")).alias("s"))
    rows = rows.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("sections"))
    return rows.select(key, F.concat(F.lit(head), F.array_join(F.transform("sections", section), "")).alias("body"))
