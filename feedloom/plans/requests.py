"""Entry points: what a request asks for, checked, and the plans that answer it."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import config
from feedloom.functions.text import text_of
from feedloom.functions.urls import arxiv_url, paper_url, url_key, valid_url
from feedloom.operators import analytics, digests, podcast, prompt, ranking, render, replies, search, selection
from feedloom.sources.places import new_place


def period_days(period: str, strict: bool = True, default: int = 7) -> int:
    """Days of a period; an unknown one raises, or is the default where requests are lenient."""
    if period in config.PERIOD_DAYS:
        return config.PERIOD_DAYS[period]
    if strict:
        raise ValueError(f"unknown period: {period}")
    return default


def days_of(route: Column, period: Column) -> Column:
    """Days that a period means to a kind of request; null where it is an error."""
    out = F.lit(None).cast("int")
    for name, (days, other) in config.ROUTE_DAYS.items():
        known = F.lit(other).cast("int")
        for p, n in days.items():
            known = F.when(period == p, n).otherwise(known)
        out = F.when(route == name, known).otherwise(out)
    return out


def clamped(limit: Column, least: int, most: int, default: int) -> Column:
    """clamp() of a column."""
    return F.coalesce(F.greatest(F.lit(least), F.least(F.lit(most), limit)), F.lit(default))


def clamp(limit: int | None, least: int, most: int, default: int) -> int:
    return default if limit is None else max(least, min(most, int(limit)))


def category(name: str) -> str:
    if name not in config.CATEGORY:
        raise ValueError(f"unknown category: {name}")
    return name


def _small(rows: DataFrame) -> DataFrame:
    """A few rows that several parts of an answer are made from, worked out once."""
    place = new_place(rows.sparkSession, "chosen")
    rows.coalesce(1).write.parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


@dataclass
class Corpus:
    """The tables that requests read: items, scores and vectors, and the time of asking."""

    items: DataFrame
    scores: DataFrame
    vectors: DataFrame | None
    as_of: int

    def _terms(self, terms: dict | None) -> dict:
        return terms or {c: ranking.query_terms(config.CATEGORY[c].query) for c in config.CATEGORIES}

    def list_items(self, name: str, period: str = "week", limit: int | None = None, terms: dict | None = None, **how) -> DataFrame:
        """A category's ranked and source-diverse items, with scores to three digits."""
        limit = clamp(limit, 1, 50, config.CATEGORY[category(name)].max_items)
        cap = selection.source_cap(config.PERIOD_SOURCE_CAP[period], limit)
        rows = ranking.rank_categories(self.items, self.scores, self.as_of, period_days(period), [name], self._terms(terms), columns=["title"], **how)
        rows = selection.select_diverse(selection.best_of_sources(rows, cap, limit), cap, limit)
        return rows.select("position", "id", "title", "source_title", "reason", *[F.round(c, 3).alias(c) for c in ("final", "bm25", "llm", "recency")])

    def digest(self, period: str = "week", top: int = 5, terms: dict | None = None, **how) -> DataFrame:
        """The best items of every category, in one job."""
        days = {k: v for k, v in config.PERIOD_DAYS.items() if k != "all"}.get(period, 7)
        rows = ranking.rank_categories(self.items, self.scores, self.as_of, days, None, self._terms(terms), columns=["title"], **how)
        return ranking.with_rank(rows, most=top).select("category", "rank", "id", "title", F.round("final", 3).alias("final"))

    def find(self, query: str, kind: str = "hybrid", period: str = "week", name: str | None = None, limit: int | None = None, vector=None) -> DataFrame:
        """Keyword, semantic or hybrid search over a window, in one category or all."""
        limit = clamp(limit, 1, 100, 10)
        rows = self.items.where(ranking.in_window("published_at", self.as_of, period_days(period, strict=False)))
        rows = rows.where(F.col("category") == category(name)) if name else rows
        if kind == "keyword":
            return search.search_keyword(rows, query, limit)
        if kind == "semantic":
            return search.search_semantic(rows, self.vectors, query, vector, limit)
        if kind == "hybrid":
            return search.search_hybrid(rows, self.vectors, query, vector, limit)
        raise ValueError(f"unknown kind of search: {kind}")

    def ask(self, question_vector, period: str = "week", name: str | None = None, limit: int | None = None, terms: dict | None = None, **how) -> DataFrame:
        """The context for an answer: nearest items, ranked among themselves, blended with cosine."""
        limit = clamp(limit, 1, 20, 5)
        days = period_days(period, strict=False)
        rows = self.items.where(ranking.in_window("published_at", self.as_of, days))
        rows = rows.where(F.col("category") == category(name)) if name else rows
        near = rows.join(F.broadcast(search.nearest(rows, self.vectors, question_vector, search.retrieval_size(limit))), "id")  # 40 rows at most
        name = name or "newsletters"
        best = ranking.rank_categories(near.withColumn("category", F.lit(name)), self.scores, self.as_of, days, [name], self._terms(terms), **how)
        best = best.withColumn("final", F.col("final") * 0.7 + F.col("cosine") * 0.3)
        return search.topk(best, "final", limit, ["id"])

    def _chosen(self, names: list[str], period: str, limit: int, words: str, topics: tuple[str, ...], oversize: int | None, terms: dict | None, **how) -> DataFrame:
        """Items across categories, re-ranked by what the prompt names, or else in the
        order of the categories, and source-diverse."""
        profile = prompt.prompt_profile(words, topics)
        focus, avoid = (profile.focus_topics, profile.exclude_topics) if profile and profile.focus_topics else ([], [])  # exclusions alone are not looked at
        text = text_of("title", "summary")
        extra = {"present": prompt.presence(text, focus), "named": prompt.names_any(text, avoid), "size": F.length("summary")}
        own = [c for c in ("title", "url", "content_snippet") if c in self.items.columns]
        rows = ranking.rank_categories(self.items, self.scores, self.as_of, period_days(period), [category(n) for n in names], self._terms(terms), columns=own, extra=extra, **how)
        if oversize is not None:
            rows = rows.where(F.col("size") <= oversize)
        rows = prompt.exclude(prompt.rerank(rows, focus, present="present"), avoid, named="named")
        place = F.create_map(*[F.lit(x) for k, n in enumerate(dict.fromkeys(names)) for x in (n, k)])
        rows = rows.withColumns({"all": F.lit("all"), "place": F.lit(0) if focus else F.element_at(place, F.col("category"))})
        if "url" in own:
            rows = selection.keep_first(rows, url_key("url"), ["place", F.round("final", 9).desc(), "id"])
        per_source = 2 if period == "week" else 3
        rows = selection.best_of_sources(rows, per_source, limit, group=["all"], before=["place"])
        return selection.select_diverse(rows, per_source, limit, group=["all"]).drop("all", "place", "present", "named", "size")

    def newsletter(self, names: list[str], period: str = "week", limit: int | None = None, words: str = "", topics: tuple[str, ...] = config.PROMPT_TOPICS, oversize: int = 50_000, terms: dict | None = None, **how) -> DataFrame:
        """Items for a newsletter across categories, re-ranked by what the prompt names."""
        return self._chosen(names, period, -(-clamp(limit, 1, 50, 20) * 10 // 13), words, topics, oversize, terms, **how)

    def newsletter_issue(self, names: list[str], period: str = "week", limit: int | None = None, words: str = "", topics: tuple[str, ...] = config.PROMPT_TOPICS, oversize: int = 50_000, terms: dict | None = None,
                         newsletters: tuple[str, ...] = (), aggregators: tuple[str, ...] = (), title: str = "Digest", **how) -> dict[str, DataFrame]:
        """A newsletter from ranking to text: selected items, their digests (newsletters as
        their articles, each with a good url), the issue as Markdown and HTML, and its
        themes with their weights, which the prompt's topics raise."""
        chosen = _small(self.newsletter(names, period, limit, words, topics, oversize, terms, **how))
        texts = self.items.select("id", "summary").join(F.broadcast(chosen.select("id")), "id")  # 50 rows at most
        made = digests.extract(chosen.join(F.broadcast(texts), "id"), newsletters, aggregators).where(valid_url("url", aggregators))
        place = chosen.select(F.col("id").cast("string").alias("__of"), "position")
        made = _small(made.join(F.broadcast(place), F.regexp_replace("id", "-article-[0-9]+$", "") == F.col("__of")).drop("__of"))
        issue = made.withColumn("issue", F.lit(1))
        tags = made.select(F.explode("topic_tags").alias("theme")).groupBy("theme").agg(F.count(F.lit(1)).cast("double").alias("weight"))
        asked = [t for t in config.THEME_TOPICS if t in words.lower()]
        if asked:
            raised = F.exists(F.array(*map(F.lit, asked)), lambda t: F.lower("theme").contains(t) | t.contains(F.lower("theme")))
            tags = tags.withColumn("weight", F.when(raised, F.col("weight") * 2.5).otherwise(F.col("weight")))
        return {"selection": chosen, "digests": made, "markdown": render.newsletter(issue, "issue", title), "html": render.newsletter(issue, "issue", title, html=True), "themes": tags}

    def podcast(self, names: list[str], period: str = "week", limit: int | None = None, words: str = "", topics: tuple[str, ...] = config.PROMPT_TOPICS, terms: dict | None = None, aggregators: tuple[str, ...] = (), issues: Callable[[DataFrame], DataFrame] | None = None, **how) -> dict[str, DataFrame]:
        """An episode: selected items, their digests, the rundown, the script, its segments
        with times, and the report on issues: those that `issues` finds in the digests
        (severity, type, line, issue, fix), or none, as without a model."""
        chosen = _small(self._chosen(names, period, clamp(limit, 1, 50, 15), words, topics, None, terms, **how))
        texts = self.items.select("id", "summary").join(F.broadcast(chosen.select("id")), "id")  # `limit` rows
        chosen = chosen.join(F.broadcast(texts), "id")
        made = _small(digests.podcast_digests(chosen, words, aggregators).join(F.broadcast(chosen.select("id", "position")), "id"))
        bands = podcast.rundown(made.withColumn("episode", F.lit(1)), ["episode"], ["position"])
        script = podcast.fallback_script(bands, "episode")
        named = bands.where("band = 'segment'").select("episode", "place", "seconds", F.substring("one_line_takeaway", 1, 50).alias("title"))
        times = podcast.script_times(named, script.withColumnRenamed("seconds", "spoken"), "episode")
        found = script.select("episode", *[F.lit(None).cast("string").alias(c) for c in ("severity", "type", "line", "issue", "fix")])
        if issues is not None:
            found = found.unionByName(issues(made).withColumn("episode", F.lit(1)))
        return {"selection": chosen, "digests": made, "rundown": bands, "script": script, "segments": times, "report": digests.verification_report(found, ["episode"])}

    def ranking_debug(self, name: str, period: str = "week", limit: int | None = None, terms: dict | None = None, **how) -> DataFrame:
        """The best items of a category with all their scores, and when the newest stored score was made."""
        limit = clamp(limit, 1, 100, 50)
        rows = ranking.rank_categories(self.items, self.scores, self.as_of, 30 if period == "month" else 7, [category(name)], self._terms(terms), columns=["title"], **how)
        rows = ranking.with_rank(rows, most=limit)
        last = self.scores.groupBy("item_id").agg(F.max("scored_at").alias("stored_at"))
        return rows.join(last, rows.id == last.item_id, "left").drop("item_id")

    def score_analytics(self, name: str, period: str = "week", buckets: int = 10, terms: dict | None = None, **how) -> DataFrame:
        """Low, high, mean and upper median of each score of a category's ranked items."""
        rows = self._all_scores(name, period, terms, **how)
        metrics = ["final", "bm25", "llm", "recency", "boost"]
        middle = analytics.upper_median(analytics.long_form(rows, metrics), "value", ["metric"])
        return analytics.distribution(rows, metrics).join(middle, "metric", "left")

    def _all_scores(self, name: str, period: str, terms: dict | None, **how) -> DataFrame:
        return ranking.rank_categories(self.items, self.scores, self.as_of, 30 if period == "month" else 7, [category(name)], self._terms(terms), columns=[], **how)

    def score_histograms(self, name: str, period: str = "week", buckets: int = 10, terms: dict | None = None, **how) -> DataFrame:
        """(metric, bucket, low, n) of a category's scores: bm25, relevance, usefulness, recency and final."""
        rows = analytics.long_form(self._all_scores(name, period, terms, **how), ["bm25", "relevance", "usefulness", "recency", "final"])
        return analytics.histogram(rows, "value", buckets, ["metric"])

    def score_sources(self, name: str, period: str = "week", most: int = 10, terms: dict | None = None, **how) -> DataFrame:
        """(source, n, mean, high, low): a category's sources with the best final scores on average."""
        rows = self._all_scores(name, period, terms, **how).groupBy(F.col("source_title").alias("source"))
        rows = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("final").alias("mean"), F.max("final").alias("high"), F.min("final").alias("low"))
        return search.topk(rows, "mean", most, ["source"])

    def status(self, recent: int = 10) -> DataFrame:
        """(kind, name, value): items of each category, vectors in all, and the newest items with their times."""
        by = self.items.groupBy("category").agg(F.count(F.lit(1)).alias("value")).select(F.lit("category").alias("kind"), F.col("category").alias("name"), "value")
        embedded = self.vectors.agg(F.count(F.lit(1)).alias("value")).select(F.lit("embeddings").alias("kind"), F.lit("all").alias("name"), "value")
        newest = self.items.select("id", "title", "published_at").orderBy(F.desc("published_at"), "id").limit(recent)
        return by.unionByName(embedded).unionByName(newest.select(F.lit("recent").alias("kind"), F.col("title").alias("name"), F.col("published_at").alias("value")))

    def stages(self, name: str, period: str = "week") -> DataFrame:
        """How many rows each stage leaves, in one pass."""
        window = ranking.in_window("published_at", self.as_of, period_days(period, strict=False))
        own = F.col("category") == category(name)
        titled = text_of("title") != ""
        one = self.items.agg(F.count(F.lit(1)).alias("raw"), F.count_if(titled).alias("normalised"), F.count_if(titled & own).alias("categorised"), F.count_if(titled & own & window).alias("recent"))
        return analytics.long_form(one, ["raw", "normalised", "categorised", "recent"])


@dataclass
class Papers:
    """Papers (bibcode, title, authors as JSON, abstract, fetched_at) and their libraries' links (library_id, bibcode, position)."""

    papers: DataFrame
    links: DataFrame
    page: str

    def context(self, question: str, library: str | None = None, limit: int = 20, most: int = 10) -> DataFrame:
        """(n, bibcode, entry): the numbered papers that an answer may cite: a library's,
        or those whose title, abstract or authors have the question in them, newest first."""
        if library is not None:
            rows = self.papers.join(self.links.where(F.col("library_id") == library).select("bibcode"), "bibcode")
        else:
            like = F.lit(f"%{question}%")
            rows = self.papers.where(F.ilike("title", like) | F.ilike("abstract", like) | F.ilike("authors", like))
        rows = rows.orderBy(F.desc("fetched_at"), "bibcode").limit(min(limit, most))
        n = F.row_number().over(Window.orderBy(F.desc("fetched_at"), "bibcode"))  # `most` rows
        entry = F.concat(F.lit("["), n.cast("string"), F.lit("] Bibcode: "), "bibcode", F.lit("\nTitle: "), F.coalesce(F.nullif("title", F.lit("")), "bibcode"), F.lit("\nAuthors: "),
                         F.coalesce(replies.authors_label("authors"), F.lit("Unknown")), F.lit("\nAbstract: "), F.coalesce(F.nullif("abstract", F.lit("")), F.lit("N/A")))
        return rows.select(n.alias("n"), "bibcode", entry.alias("entry"))

    def cited(self, answers: DataFrame, context: DataFrame, answer: str = "answer") -> DataFrame:
        """(n, bibcode, url) for each paper that an answer cites, in the order of its citations."""
        refs = answers.select(*[c for c in answers.columns if c != answer], F.posexplode(replies.citations(answer, 10)).alias("at", "n"))
        return refs.join(F.broadcast(context.select("n", "bibcode")), "n").withColumn("url", paper_url("bibcode", self.page))

    def library(self, name: str, start: int = 0, rows: int = 20, blocked: tuple[str, ...] = config.BLOCKED_LIBRARIES) -> DataFrame:
        """A page of a library's papers with their urls, `total` and `has_more`; none of a blocked library."""
        if any(b in name.lower() for b in blocked):
            raise ValueError(f"library {name} is not available")
        own = self.links.where(F.col("library_id") == name)
        total = own.agg(F.count(F.lit(1)).alias("total"))
        found = own.where((F.col("position") >= start) & (F.col("position") < start + rows)).join(self.papers, "bibcode", "left").crossJoin(F.broadcast(total))
        return found.select("position", "bibcode", "title", "authors", paper_url("bibcode", self.page).alias("url"), arxiv_url("bibcode").alias("arxiv_url"), "total", (F.col("total") > start + rows).alias("has_more"))

    def libraries(self, blocked: tuple[str, ...] = config.BLOCKED_LIBRARIES) -> DataFrame:
        """Each library that isn't blocked, with its number of papers."""
        good = F.lit(True)
        for b in blocked:
            good = good & ~F.lower("library_id").contains(b)
        return self.links.where(good).groupBy("library_id").agg(F.count(F.lit(1)).alias("papers"))
