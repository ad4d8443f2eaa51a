"""Categories, periods, word lists and thresholds.

These must equal the published behaviour for equal results, so they are
stated plainly; every operator also takes its own values as parameters.
"""
from __future__ import annotations

from dataclasses import dataclass

CATEGORIES = ("newsletters", "podcasts", "tech_articles", "ai_news", "product_news", "community", "research")


@dataclass(frozen=True)
class Category:
    query: str
    half_life_days: float
    w_llm: float
    w_bm25: float
    w_recency: float
    min_relevance: float = 5
    max_items: int = 10


# One configuration for each category.
CATEGORY = {
    "newsletters": Category("code search semantic search codebase intelligence agents code review devtools IDE", 3, 0.45, 0.35, 0.2),
    "podcasts": Category("AI coding podcast agents code search LLM developer productivity tools infrastructure", 7, 0.5, 0.3, 0.2),
    "tech_articles": Category("code search semantic search codebase refactoring agents code intelligence testing CI/CD architecture patterns", 5, 0.4, 0.4, 0.2),
    "ai_news": Category("LLM transformer model reasoning AI inference coding agents foundation models context window", 2, 0.45, 0.35, 0.2),
    "product_news": Category("release feature announcement changelog IDE debugger code review tool productivity integrations", 4, 0.45, 0.35, 0.2),
    "community": Category("code search agents devtools codebase refactoring code review testing CI/CD best practices", 3, 0.4, 0.35, 0.15, 4),
    "research": Category("semantic search code search program synthesis AST machine learning software engineering empirical study", 10, 0.5, 0.3, 0.2),
}

# Days of each period, and the per-source cap of each.
PERIOD_DAYS = {"day": 1, "week": 7, "month": 30, "all": 90}
#: Days by period of each kind of request, and of any other period (none: an error).
ROUTE_DAYS = {
    "items": (PERIOD_DAYS, None), "search": (PERIOD_DAYS, 7), "ask": (PERIOD_DAYS, 7), "ranking": ({"month": 30}, 7), "analytics": ({"month": 30}, 7), "debug": ({"month": 30}, 7),
    "newsletter": ({"week": 7}, 30), "podcast": ({"week": 7}, 30),
}
PERIOD_SOURCE_CAP = {"day": 1, "week": 4, "month": 5, "all": 6}

# BM25.
K1, B = 1.5, 0.75

# Terms that raise a rank, and which of them combine with "agent".
CORE_TERMS = (
    "deep search", "code search", "code intelligence", "coding agent", "codebase understanding", "information retrieval",
    "context management", "context window", "software engineering", "benchmark", "evaluation", "developer productivity", "ai tooling",
)
CONTEXT_TERMS = slice(1, 8)

# Keyword groups of the heuristic score, with their tags, and off-topic words.
HEURISTIC_GROUPS = {
    "code-search": ("code search", "semantic search", "cross-reference", "codebase", "navigation", "indexing"),
    "semantic-search": ("semantic search", "embeddings", "rag", "vector", "retrieval"),
    "agent": ("agent", "agentic", "tool use", "planning", "orchestration", "multi-step"),
    "context": ("context window", "token budget", "context length", "compression", "summarization"),
    "devex": ("ide", "debugger", "refactoring", "productivity", "vscode", "intellij"),
    "devops": ("ci/cd", "testing", "deployment", "pipeline", "github actions", "test"),
    "enterprise": ("monorepo", "enterprise", "large codebase", "scale", "dependency", "modularization"),
    "research": ("paper", "arxiv", "research", "study", "empirical", "academic"),
}
OFF_TOPIC = ("marketing", "sales", "hr", "management", "sports", "politics")

# Words and phrases that a digest review counts.
AI_WORDS = (
    "highlights", "underscores", "shapes", "fosters", "emerging", "landscape", "approaches", "methodologies", "ecosystem",
    "leveraging", "harnessing", "delve", "showcase", "explore", "unpack",
)
INANIMATE = r"(?i)(this|that|the|research|finding|trend|approach|method)\s+(highlights|underscores|shapes|shows|demonstrates|indicates)"
PREAMBLE = r"(?i)^(This|The|Research|Studies?)\s+(further|also)?\s*(highlights|shows|demonstrates)"
STUFFING = ("code search", "context management", "agents", "information retrieval")
ADVICE = r"(?i)teams (should|can|must) (evaluate|explore|understand)"

# Urls that a digest review rejects.
BAD_DOMAINS = ("csharpdigest.com", "leadershipintech.com", "reactdigest.com", "programmingdigest.net", "newsletter-digest", "bonobopress.com")
BAD_URL = (
    r"(?i)/advertis(e|ing)", r"(?i)/sponsor", r"(?i)/media-kit", r"(?i)/unsubscribe", r"(?i)/subscribe", r"(?i)/privacy", r"(?i)/terms",
    r"(?i)/press", r"(?i)reddit\.com/r/", r"(?i)reddit\.com/u/", r"(?i)reddit\.com/user/", r"(?i)news\.google\.com/rss/articles/",
)
EXCLUDED_ITEM = (r"(?i)reddit\.com/r/", r"(?i)reddit\.com/u/", r"(?i)reddit\.com/user/", r"(?i)news\.google\.com/rss/articles/")

# A source's relevance rating to its multiplier.
SOURCE_MULTIPLIER = {0: 0.0, 1: 1.0, 2: 1.3, 3: 1.6}

# Order of categories in a rendered digest; others come last.
DIGEST_LABEL = {"ai_news": "AI News"}  # others are their names with capitals
DIGEST_ORDER = ("research", "tech_articles", "product_news", "ai_news", "community", "newsletters", "podcasts")

# Themes of digests with their weights.
THEMES = {
    "code search": 1.6, "semantic search": 1.5, "agents": 1.4, "context management": 1.5, "embeddings": 1.5, "devtools": 1.2, "code review": 1.0,
    "testing": 1.0, "refactoring": 1.0, "monorepo": 1.3, "llm": 1.2, "ai": 1.2, "infrastructure": 1.0, "information retrieval": 1.5, "rag": 1.5,
    "vector database": 1.5, "agentic workflows": 1.4, "fine-tuning": 1.2, "function calling": 1.2, "enterprise codebase": 1.3,
}

# What a prompt's words say; the first that occurs decides, but topics and hints are all taken.
#: Topics of a prompt that raise an issue's themes.
THEME_TOPICS = ("code search", "semantic search", "context management", "information retrieval", "agentic workflows", "agents", "developer productivity", "embeddings", "rag", "vector database")
PROMPT_TOPICS = (
    "agentic workflows", "information retrieval", "developer productivity", "vector database", "context management", "context window", "code search",
    "semantic search", "ai tools", "ai coding", "code review", "devtools", "embeddings", "refactoring", "monorepo", "enterprise", "infrastructure",
    "testing", "productivity", "research", "agents", "agentic", "vector", "rag", "llm",
)
PROMPT_AUDIENCE = (("senior", "senior engineers"), ("lead", "senior engineers"), ("engineer", "senior engineers"), ("everyone", "everyone"), ("team", "everyone"))
PROMPT_INTENT = (("focus", "focus"), ("emphasize", "focus"), ("deep", "deep-dive"), ("detailed", "deep-dive"), ("summary", "summary"), ("overview", "summary"))
PROMPT_HINTS = ("actionable", "strategic", "practical", "detailed", "summary")
PROMPT_VOICE = (
    ("conversational", "conversational"), ("casual", "conversational"), ("technical", "technical"), ("deep", "technical"), ("executive", "executive"), ("brief", "executive"),
)
PROMPT_AVOID = (("avoid theory", "theory"), ("avoid research", "research"), ("no research", "research"))

# Urls that podcast digests, searches and links found in texts reject.
BAD_PODCAST_URL = (
    r"(?i)reddit\.com/r/", r"(?i)reddit\.com/u/", r"(?i)news\.google\.com/rss/", r"(?i)inoreader\.com", r"(?i)/advertis(e|ing)", r"(?i)/sponsor",
    r"(?i)/unsubscribe", r"(?i)/subscribe(?![a-z])",
)
BAD_SEARCH_URL = (
    r"(?i)reddit\.com/r/", r"(?i)reddit\.com/u/", r"(?i)reddit\.com/user/", r"(?i)news\.google\.com/rss/", r"(?i)inoreader\.com", r"(?i)google\.com/reader",
    r"(?i)/advertis(e|ing)", r"(?i)/sponsor", r"(?i)/unsubscribe", r"(?i)/subscribe(?![a-z])", r"(?i)/privacy", r"(?i)/terms",
)
BAD_FOUND_URL = (
    r"(?i)inoreader\.com", r"(?i)google\.com/reader", r"(?i)news\.google\.com/rss/", r"(?i)tracking\.", r"(?i)/unsubscribe", r"(?i)reddit\.com/r/",
    r"(?i)reddit\.com/u/", r"(?i)reddit\.com/user/", r"(?i)/advertise", r"(?i)/sponsor", r"(?i)/media-kit", r"(?i)/privacy", r"(?i)/terms",
    r"(?i)substack\.com/redirect/", r"(?i)substackcdn\.com",
)

# Words that a podcast review looks for, as parts of words.
PODCAST_AI_WORDS = ("highlights", "underscores", "shapes", "fosters", "emerging", "landscape", "leveraging", "harnessing", "delve", "showcase")

# The fallback rundown and script of an episode.
RUNDOWN_SEGMENTS, RUNDOWN_LIGHTNING, SEGMENT_SECONDS, EPISODE_SECONDS = 4, 3, 120, 420
SEGMENT_INTROS = ("Let's kick things off with", "Moving on to", "Next up,", "Now let's look at")

# Libraries that are never shown, by parts of their names.
BLOCKED_LIBRARIES = ("scix", "2024 bibliography")
