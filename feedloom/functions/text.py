"""Text columns: tokens, counts, cleaners, reviews, durations.  All are Catalyst expressions."""
from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions import config


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def add(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def text_of(*parts: Column | str) -> Column:
    """Parts joined by spaces; a null part is empty."""
    return F.concat_ws(" ", *[F.coalesce(col(p), F.lit("")) for p in parts])


def tokens(text: Column | str, longer_than: int = 2) -> Column:
    """Lower-case ASCII words of more than `longer_than` characters."""
    words = F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.filter(words, lambda t: F.length(t) > longer_than)


def contains(text: Column | str, term: str) -> Column:
    return F.coalesce(col(text).contains(term), F.lit(False))


def hits(text: Column | str, terms: Sequence[str]) -> Column:
    """How many of the terms occur in the text, as substrings."""
    return add([F.when(contains(text, t), 1).otherwise(0) for t in terms])


def any_match(text: Column | str, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(col(text).rlike(p), F.lit(False)) for p in patterns], F.lit(False))


def occurrences(text: Column | str, term: str) -> Column:
    """Occurrences of a literal term that don't overlap, parts of words included."""
    gone = F.length(col(text)) - F.length(F.replace(col(text), F.lit(term), F.lit("")))
    return F.coalesce((gone / F.lit(len(term))).cast("int"), F.lit(0))


def word_occurrences(text: Column | str, term: str) -> Column:
    """Occurrences of a literal term with no ASCII word character next to its own word ends."""
    left = r"(?<![A-Za-z0-9_])" if re.match(r"\w", term, re.A) else r"(?<=[A-Za-z0-9_])"
    right = r"(?![A-Za-z0-9_])" if re.search(r"\w\Z", term, re.A) else r"(?=[A-Za-z0-9_])"
    return F.coalesce(F.regexp_count(col(text), F.lit(left + re.escape(term) + right)), F.lit(0))


def half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10**digits + 0.5) / 10**digits, which is not round() for negative halves."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / F.lit(scale)


# -- cleaners ---------------------------------------------------------------------

# Entities that each cleaner decodes, in order.
BASIC = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
QUOTED = (("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
PLAIN = (*BASIC, ("&quot;", '"'), ("&#39;", "'"))


def _decoded(text: Column, entities) -> Column:
    for entity, char in entities:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _squeezed(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_html(html: Column | str) -> Column:
    """Tags to spaces, four entities decoded."""
    return _squeezed(_decoded(F.regexp_replace(col(html), "<[^>]*>", " "), BASIC))


def html_to_text(html: Column | str) -> Column:
    """Without scripts and styles; tags to spaces; named entities decoded, numbered ones dropped."""
    out = F.regexp_replace(col(html), r"(?is)<script\b.*?</script>", "")
    out = F.regexp_replace(out, r"(?is)<style\b.*?</style>", "")
    out = _decoded(F.regexp_replace(out, r"<[^>]+>", " "), QUOTED)
    return _squeezed(F.regexp_replace(out, r"&#[0-9]+;", ""))


def html_to_plaintext(html: Column | str) -> Column:
    """Lines for blocks, "text (url)" for links.  A rule's dot does not cross lines."""
    out = col(html)
    for pattern, new in (
        (r"(?i)<script[^>]*>.*?</script>", ""), (r"(?i)<style[^>]*>.*?</style>", ""), (r"(?i)<br\s*/?>", "\n"), (r"</p>", "\n"), (r"</li>", "\n"), (r"</div>", "\n"),
        (r"(?i)<h[1-6][^>]*>(.*?)</h[1-6]>", "\n$1\n"), (r"""(?i)<a[^>]*href=["']([^"']*?)["'][^>]*>(.*?)</a>""", "$2 ($1)"), (r"<[^>]+>", ""),
    ):
        out = F.regexp_replace(out, pattern, new)
    out = F.regexp_replace(_decoded(out, PLAIN), r"\n\n\n+", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def strip_formatting(text: Column | str) -> Column:
    """Markdown emphasis, headings and links to plain text."""
    out = F.regexp_replace(col(text), r"\*\*([^*]+)\*\*", "$1")
    out = F.regexp_replace(out, r"\*([^*]+)\*", "$1")
    out = F.regexp_replace(out, r"(?m)^#{1,6}\s+", "")
    return F.regexp_replace(out, r"\[([^\]]+)\]\([^)]+\)", "$1")


def truncate_word(text: Column | str, most: int) -> Column:
    """At most `most` characters, cut at the last space among them; null is empty."""
    whole = F.coalesce(col(text), F.lit(""))
    head = F.substring(whole, 1, most)
    at = most - F.instr(F.reverse(head), " ")  # characters before the last space
    cut = F.when((F.instr(head, " ") > 0) & (at > 0), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(whole) <= most, whole).otherwise(cut)


# What is not spoken of a transcript, in the order of removal.
CUES = (
    r"(?i)\[INTRO MUSIC\]", r"(?i)\[OUTRO MUSIC\]", r"(?i)\[BACKGROUND MUSIC\]", r"(?i)\[MUSIC\]", r"(?i)\[PAUSE\]", r"(?i)\[SOUND EFFECT\]",
    r"(?i)\[SFX[^\]]*\]", r"(?i)\[APPLAUSE\]", r"(?i)\[LAUGHTER\]", r"(?i)\[silence[^\]]*\]", r"(?i)\[\s*[A-Z\s]*\s*MUSIC\s*\]", r"(?i)\[NEEDS SUPPORT\]",
    r"(?i)cold open:?\s*", r"(?i)lightning round:?\s*", r"(?i)quick hits:?\s*", r"(?i)intro segment:?\s*", r"(?i)outro:?\s*", r"(?i)main segment:?\s*",
)
# Markup, speakers and white space of a transcript, in the order of removal.
MARKUP = (
    (r"(?m)^##\s*.+$", ""), (r"\*\*[A-Z]+:\*\*\s*", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\[[0-9:]+\]\s*", ""), (r"\(≈?[0-9]+s\)", ""),
    (r"(?m)^---+$", ""), (r"(?m)^Segment [0-9]+\s*[—–-]\s*.+$", ""),
)
SPEAKER = r"(?m)^[A-Z]+:\s*"
WHITE = ((r"\n{3,}", "\n\n"), (r"(?m)^\s+$", ""), (r"\n\s*\n\s*\n", "\n\n"), (r"\s{2,}", " "))


def sanitize_transcript(text: Column | str, cues: bool = True, markup: bool = True, keep_speakers: bool = False) -> Column:
    """A transcript as it is spoken: without cues, markup, and speaker labels."""
    steps = [(p, "") for p in CUES] if cues else []
    steps += list(MARKUP) if markup else []
    steps += [] if keep_speakers else [(SPEAKER, "")]
    out = col(text)
    for pattern, new in [*steps, *WHITE]:
        out = F.regexp_replace(out, pattern, new)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def word_count(text: Column | str) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"\S+"), F.lit(0)))


def duration_seconds(text: Column | str, words_per_minute: int = 150) -> Column:
    return F.ceil(word_count(text) / F.lit(float(words_per_minute)) * 60).cast("long")


def format_duration(seconds: Column | str) -> Column:
    """h:mm:ss from an hour on, m:ss below."""
    s = col(seconds)
    hours, minutes, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    long = F.concat_ws(":", hours.cast("string"), two(minutes), two(rest))
    return F.when(hours > 0, long).otherwise(F.concat_ws(":", minutes.cast("string"), two(rest)))


def format_mmss(seconds: Column | str) -> Column:
    s = col(seconds)
    return F.concat_ws(":", F.floor(s / 60).cast("string"), F.lpad((s % 60).cast("long").cast("string"), 2, "0"))


def transcript_hash(text: Column | str, provider: str, voice: str, fmt: str) -> Column:
    joined = F.concat_ws("|", sanitize_transcript(text), F.lit(provider), F.lit(voice), F.lit(fmt))
    return F.concat(F.lit("sha256:"), F.sha2(joined, 256))


# -- reviews ----------------------------------------------------------------------


def once(value: Column, use) -> Column:
    """use(value), with the value worked out once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def found_words(lower: Column, words: Sequence[str]) -> Column:
    """All whole-word occurrences of words of ASCII letters, found in one pass; null is none."""
    pattern = f"(?<![A-Za-z0-9_])(?:{'|'.join(words)})(?![A-Za-z0-9_])"
    return F.coalesce(F.regexp_extract_all(lower, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def ai_language_issues(text: Column | str) -> Column:
    """Array of issues: overused words with counts, and two phrase patterns."""

    def used(found: Column, word: str) -> Column:
        n = F.size(F.filter(found, lambda t: t == word))
        return once(n, lambda n: F.when(n > 0, F.concat(F.lit(f'Overused AI word: "{word}" ('), n.cast("string"), F.lit("x)"))))

    words = once(found_words(F.lower(col(text)), config.AI_WORDS), lambda found: F.array(*[used(found, w) for w in config.AI_WORDS]))
    inanimate = F.when(col(text).rlike(config.INANIMATE), F.lit("Possible inanimate subject doing human action"))
    preamble = F.when(col(text).rlike(config.PREAMBLE), F.lit("Corporate preamble pattern detected"))
    return F.array_compact(F.concat(words, F.array(inanimate, preamble)))


def bias_issues(text: Column | str, product: str | None = None) -> Column:
    """Array of issues: a product named more than twice, stuffed keywords, generic advice."""
    lower = F.lower(col(text))
    found = []
    if product:
        n = occurrences(lower, product.lower())
        found.append(F.when(n > 2, F.concat(F.lit(f"Over-mentions {product} ("), n.cast("string"), F.lit("x)"))))
    stuffed = add([occurrences(lower, t) for t in config.STUFFING])
    found.append(F.when(stuffed > 4, F.concat(F.lit("Heavy keyword stuffing detected ("), stuffed.cast("string"), F.lit(" keyword mentions)"))))
    found.append(F.when(col(text).rlike(config.ADVICE), F.lit("Generic corporate advice pattern")))
    return F.array_compact(F.array(*found))
