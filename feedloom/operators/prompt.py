"""Re-ranking and exclusion by the topics of a prompt."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import config
from feedloom.functions.text import contains, hits, text_of


@dataclass
class PromptProfile:
    """What a prompt asks for: a parameter of a query, not data."""

    focus_topics: list[str] = field(default_factory=list)
    exclude_topics: list[str] = field(default_factory=list)
    audience: str | None = None
    intent: str | None = None
    format_hints: list[str] = field(default_factory=list)
    voice_style: str | None = None


def prompt_profile(prompt: str | None, topics: Sequence[str] = config.PROMPT_TOPICS, avoid: Sequence[tuple[str, str]] = config.PROMPT_AVOID) -> PromptProfile | None:
    """A prompt's profile from the words that occur in it, or None for a blank one.
    A topic that is avoided is also a focus, as it is named."""
    if not prompt or not prompt.strip():
        return None
    lower = prompt.lower()

    def first(choices):
        return next((value for word, value in choices if word in lower), None)

    return PromptProfile(
        list(dict.fromkeys(t for t in topics if t in lower)), [value for word, value in avoid if word in lower],
        first(config.PROMPT_AUDIENCE), first(config.PROMPT_INTENT), [h for h in config.PROMPT_HINTS if h in lower], first(config.PROMPT_VOICE),
    )


def profile_columns(text: Column, topics: Sequence[str] = config.PROMPT_TOPICS, avoid: Sequence[tuple[str, str]] = config.PROMPT_AVOID) -> dict[str, Column]:
    """prompt_profile() of a column of prompts; all null for a blank one."""
    lower, blank = F.lower(text), F.trim(F.coalesce(text, F.lit(""))) == ""

    def named(pairs):
        return F.when(~blank, F.array_compact(F.array(*[F.when(contains(lower, word), value) for word, value in pairs])))

    def first(choices):
        return F.when(~blank, F.coalesce(*[F.when(contains(lower, word), value) for word, value in choices]))

    return {
        "focus_topics": F.array_distinct(named([(t, t) for t in topics])), "exclude_topics": named(avoid), "audience": first(config.PROMPT_AUDIENCE),
        "intent": first(config.PROMPT_INTENT), "format_hints": named([(h, h) for h in config.PROMPT_HINTS]), "voice_style": first(config.PROMPT_VOICE),
    }


def presence(text: Column, topics: Sequence[str]) -> Column:
    """The share of the topics that occur in a text."""
    if not topics:
        return F.lit(0.0)
    lower = [t.lower() for t in topics]
    return F.least(F.lit(1.0), hits(F.lower(text), lower) / F.lit(float(len(lower))))


def alignment(tags: Column, present: Column, topics: Sequence[str]) -> Column:
    """Half from tags that contain or are contained in a topic, half from topics in the text; each at most 1."""
    if not topics:
        return F.lit(0.0)
    lower = [t.lower() for t in topics]
    tagged = F.size(F.filter(tags, lambda tag: F.exists(F.array(*map(F.lit, lower)), lambda t: F.lower(tag).contains(t) | t.contains(F.lower(tag)))))
    return F.least(F.lit(1.0), tagged / F.lit(float(len(lower)))) * 0.5 + present * 0.5


def boost(a: Column) -> Column:
    return F.when(a > 0.5, 4.0 + a * 4.0).when(a > 0.3, 2.5 + a * 4.0).when(a > 0.1, 1.5 + a * 5.0).otherwise(0.3)


def rerank(items: DataFrame, topics: Sequence[str], final: str = "final", present: str | None = None) -> DataFrame:
    """`items` with `final` times the boost of their alignment; unchanged without
    topics.  `present` names a column of presence() made before texts were left
    behind; without it, title and summary are read."""
    if not topics:
        return items
    share = F.col(present) if present else presence(text_of("title", "summary"), topics)
    return items.withColumn(final, F.col(final) * boost(alignment(F.col("tags"), share, topics)))


def names_any(text: Column, topics: Sequence[str]) -> Column:
    lower, found = F.lower(text), F.lit(False)
    for t in topics:
        found = found | contains(lower, t.lower())
    return found


def exclude(items: DataFrame, topics: Sequence[str], named: str | None = None) -> DataFrame:
    """Items that name none of the topics in title, summary or tags.  `named` names a
    column of names_any() made before texts were left behind."""
    if not topics:
        return items
    if named:
        return items.where(~(F.col(named) | names_any(F.array_join("tags", " "), topics)))
    return items.where(~names_any(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.array_join("tags", " ")), topics))
