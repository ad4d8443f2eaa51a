"""Digests of items without a language model, and reports on scripts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import config
from feedloom.functions.text import ai_language_issues, bias_issues, half_up, hits, once, strip_html
from feedloom.functions.urls import bad_podcast_url, bad_review_url, excluded_item, is_web, site_name, valid_url
from feedloom.operators.decompose import decompose

NOTHING = "No summary available"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _content() -> Column:
    return F.coalesce(F.nullif("summary", F.lit("")), F.lit(NOTHING))


def fallback_digest(items: DataFrame) -> DataFrame:
    """id, title, url, source_title, category and what a digest says of each item:
    up to five tags, a gist of 100 characters, one bullet of 150, why it matters,
    credibility, and relevance from the final score."""
    raw = _content()
    clean = F.when(raw.contains("<"), strip_html(raw)).otherwise(raw)
    tags = F.slice("tags", 1, 5)
    head = _trimmed(F.substring(clean, 1, 150))
    why = F.when(F.length(head) < 50, F.concat(F.lit("From "), "source_title", F.lit(". Topics: "), F.array_join(tags, ", "))).when(head.endswith("."), head).otherwise(F.concat(head, F.lit("...")))
    return items.select(
        "id", "title", "url", "source_title", "category", tags.alias("topic_tags"), _trimmed(F.substring(clean, 1, 100)).alias("gist"),
        F.array(F.when(F.length(clean) > 150, F.concat(head, F.lit("..."))).otherwise(_trimmed(clean))).alias("key_bullets"), why.alias("why_it_matters"),
        F.lit("medium").alias("credibility"), half_up(F.col("final") * 10).cast("long").alias("relevance"), F.when(is_web("url"), site_name("url")).alias("original_source"),
    )


def podcast_digest(items: DataFrame, focus: str = "") -> DataFrame:
    """The spoken counterpart of fallback_digest()."""
    gist = _content()
    return items.select(
        "id", "title", "url", F.col("source_title").alias("source_name"), F.substring(gist, 1, 100).alias("one_sentence_gist"), F.array(F.substring(gist, 1, 150)).alias("key_facts"),
        F.concat(F.lit("New content from "), "source_title").alias("what_changed"), F.array(F.lit("developers"), F.lit("engineers")).alias("who_affected"),
        F.lit(f"Relevant to {focus or 'code intelligence'}").alias("one_line_takeaway"), F.array(F.substring("title", 1, 60)).alias("soundbite_lines"),
        F.concat("source_title", F.lit(" (medium credibility)")).alias("credibility_notes"), half_up(F.col("final") * 10).cast("long").alias("relevance_to_focus"),
    )


def verification_report(issues: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group..., errors, warnings, report): a script's issues as text, errors first.

    issues: severity (error, warning, or null for a script without issues), type,
    line, issue and fix.  A script passes if it has no errors.
    """

    def lines(severity: str, fault: str, remedy: str) -> Column:
        entry = F.concat(F.lit("- **"), "type", F.lit('**: "'), "line", F.lit(f'"\n  {fault}: '), "issue", F.lit(f"\n  {remedy}: "), "fix", F.lit("\n\n"))
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col("severity") == severity, entry))), "")  # one script's issues

    rows = issues.groupBy(*group).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"),
                                      lines("error", "Problem", "Fix").alias("__e"), lines("warning", "Issue", "Suggestion").alias("__w"))
    # The headings of a report.
    passed = F.when(F.col("errors") == 0, "Yes").otherwise("No")
    body = F.concat(F.when(F.col("errors") > 0, F.concat(F.lit("### Errors (must fix)\n\n"), "__e")).otherwise(""), F.when(F.col("warnings") > 0, F.concat(F.lit("### Warnings (consider fixing)\n\n"), "__w")).otherwise(""))
    found = F.when(F.col("errors") + F.col("warnings") > 0, F.concat(F.lit("## Issues Found\n\n"), body)).otherwise("## All Checks Passed\n\nNo issues found.\n")
    return rows.select(*group, "errors", "warnings", F.concat(F.lit("# Script Verification Report\n\n**Passed Verification:** "), passed, F.lit("\n\n"), found).alias("report"))


def extract(items: DataFrame, newsletters: Sequence[str], aggregators: Sequence[str] = ()) -> DataFrame:
    """Digests of items: discussion threads and redirects go, newsletters become
    their articles, and each row left gets a digest."""
    return fallback_digest(decompose(items.where(~excluded_item("url")), newsletters, aggregators=aggregators))


def podcast_digests(items: DataFrame, focus: str = "", aggregators: Sequence[str] = (), least: int = 3) -> DataFrame:
    """Digests for an episode of the items with a good url whose relevance is at least `least` (null counts as 5)."""
    rows = podcast_digest(items.where(~excluded_item("url") & valid_url("url", aggregators)), focus)
    return rows.where(F.coalesce("relevance_to_focus", F.lit(5)) >= least)


def _reported(found: Sequence[Column]) -> Column:
    return F.array_compact(F.array(*found))


def review(digests: DataFrame, product: str | None = None) -> DataFrame:
    """`digests` with `issues` (bad url, language of gist and of why it matters, bias,
    the first bad bullet) and `passed`."""
    def joined(found: Column, head: str) -> Column:
        return once(found, lambda x: F.when(F.size(x) > 0, F.concat(F.lit(head), F.array_join(x, "; "))))

    said = lambda c, title: joined(ai_language_issues(c), f"{title} has AI language: ")
    bullet = F.get(F.filter("key_bullets", lambda b: F.size(ai_language_issues(b)) > 0), F.lit(0))
    issues = _reported([
        F.when(bad_review_url("url"), F.concat(F.lit("Bad URL domain/pattern: "), F.coalesce("url", F.lit("")))),
        said(F.coalesce("gist", F.lit("")), "Gist"), said(F.coalesce("why_it_matters", F.lit("")), "Why It Matters"),
        joined(bias_issues("why_it_matters", product), "Why It Matters: "),
        once(bullet, lambda b: F.when(b.isNotNull(), F.concat(F.lit("Key bullet has AI language: "), F.substring(b, 1, 50), F.lit("...")))),
    ])
    return digests.withColumn("issues", issues).withColumn("passed", F.size("issues") == 0)


def review_podcast(digests: DataFrame) -> DataFrame:
    """`digests` of an episode with `issues` (bad url, language of gist, takeaway and
    soundbites, low relevance) and `passed`.  Words count inside words too."""
    bad = lambda c: hits(F.lower(F.coalesce(c, F.lit(""))), config.PODCAST_AI_WORDS) > 0
    relevance = F.col("relevance_to_focus")
    issues = _reported([
        F.when(bad_podcast_url("url"), F.concat(F.lit("Bad URL: "), F.coalesce("url", F.lit("")))),
        F.when(bad(F.col("one_sentence_gist")), "Gist contains AI-style language"),
        F.when(bad(F.col("one_line_takeaway")), "Takeaway contains AI-style language"),
        F.when(F.exists("soundbite_lines", bad), "Soundbite contains AI-style language"),
        F.when(F.coalesce(relevance, F.lit(5)) < 3, F.concat(F.lit("Low relevance score: "), relevance.cast("string"))),
    ])
    return digests.withColumn("issues", issues).withColumn("passed", F.size("issues") == 0)


def apply_fixes(scripts: DataFrame, issues: DataFrame, key: str, order: str) -> DataFrame:
    """`scripts` (key, script) with each script's issues mended in order: the first
    occurrence of an unsupported line is marked, once a script, and an overconfident
    line gives way to its fix.  Scripts without issues stay."""
    mark = " [NEEDS SUPPORT]"
    own = issues.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "severity", "type", "line", "fix"))).alias("__issues"))  # one script's issues

    def first(script, line, new):
        at = F.position(line, script)
        return F.when(at > 0, F.concat(F.substring(script, F.lit(1), at - 1), new, F.substring(script, at + F.length(line), F.length(script)))).otherwise(script)

    def mended(script, x):
        unsupported = (x["severity"] == "error") & (x["type"] == "unsupported_claim") & ~script.contains(mark.strip())
        marked = F.when(F.coalesce(unsupported, F.lit(False)), first(script, x["line"], F.concat(x["line"], F.lit(mark)))).otherwise(script)
        tone = F.coalesce((x["type"] == "overconfident_language") & (F.coalesce(x["fix"], F.lit("")) != ""), F.lit(False))
        return F.when(tone, first(marked, x["line"], x["fix"])).otherwise(marked)

    rows = scripts.join(own, key, "left")
    fixed = F.aggregate(F.coalesce("__issues", F.array().cast(own.schema["__issues"].dataType)), F.col("script"), mended)
    return rows.withColumn("script", fixed).drop("__issues")
