"""BM25, recency, boosts, heuristic scores and the category ranker.

No token is ever shuffled: a query has few terms, so each row counts them in
place.  The texts are read once: their counts go into a narrow cached table, which
the corpus statistics, the best score and the scores all read.
"""
from __future__ import annotations

import collections
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import config
from feedloom.functions.text import add, col, contains, half_up, hits, once, text_of
from feedloom.operators.analytics import beside
from feedloom.sources.places import written

DAY = 86_400


def query_terms(query: str) -> list[str]:
    """Lower-case words of a query; repeated ones stay and count twice."""
    return query.lower().split()


def term_counts(text: Column, terms: Sequence[str]) -> Column:
    """How many tokens a text has, then how often each term is one.  A token is a
    run of more than two ASCII word characters; other terms never are."""
    lower = F.lower(text)
    length = F.regexp_count(lower, F.lit("[a-z0-9_]{3,}"))
    able = [t for t in dict.fromkeys(terms) if re.fullmatch("[a-z0-9_]{3,}", t)]
    if not able:
        return F.array(length, *[F.lit(0)] * len(terms))
    found = F.regexp_extract_all(lower, F.lit(f"(?<![a-z0-9_])(?:{'|'.join(able)})(?![a-z0-9_])"), F.lit(0))
    # The matches are bound once, not looked for again for every term.
    counts = F.transform(F.array(found), lambda f: F.transform(F.array(*map(F.lit, terms)), lambda term: F.size(F.filter(f, lambda t: t == term))))
    return F.concat(F.array(length), F.get(counts, F.lit(0)))


_kept: collections.deque = collections.deque()
#: Narrow tables that stay cached, more than a plan has parts; older ones are made again if they are asked for once more.
MOST_KEPT = 32


def release() -> None:
    """Free the narrow tables, once no result of a ranking is to be read any more."""
    while _kept:
        old = _kept.popleft()
        if old.sparkSession.sparkContext._jsc is not None:
            old.unpersist()


def kept(rows: DataFrame) -> DataFrame:
    """`rows`, cached (in memory, else on disk) when they are first read, as several
    parts of a plan read them.  Callers free them with release(); without it the last
    `MOST_KEPT` stay.  A mark keeps a later query from reading this one's table, as files may have changed."""
    rows = rows.withColumn("__made", F.lit(uuid.uuid4().hex))
    while len(_kept) >= MOST_KEPT:
        old = _kept.popleft()
        if old.sparkSession.sparkContext._jsc is not None:
            old.unpersist()
    _kept.append(rows.persist())
    return rows


def bm25(items: DataFrame, terms: Sequence[str] | dict[str, Sequence[str]], text: Column, group: str | None = None, key: str = "id", columns: Sequence[str] | None = None,
         extra: dict[str, Column] | None = None, k1: float = config.K1, b: float = config.B) -> DataFrame:
    """The rows' `columns` (all by default; texts that aren't asked for stay behind)
    and `extra` columns, with bm25_raw, the BM25 score against the rows of the same
    group (or all rows), and bm25, that over max(the group's best, 1).

    terms: a query's, or with `group` each group's own; rows of other groups
    score 0.  Terms that can't be tokens (two characters or less, or with signs)
    score 0.
    """
    lists = terms if isinstance(terms, dict) else {None: list(terms)}
    different = list(dict.fromkeys(t for each in lists.values() for t in each))
    wanted = list(dict.fromkeys([key, *([group] if group else []), *(items.columns if columns is None else columns)]))
    rows = items.select(*[F.col(f"`{c}`") for c in wanted], *[x.alias(n) for n, x in (extra or {}).items()], term_counts(text, different).alias("__counts"))
    rows = kept(rows)
    count = lambda k: F.col("__counts")[k]
    by = [group] if group else []
    stats = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.sum(count(0)).alias("__all"), F.array(*[F.count_if(count(k + 1) > 0) for k in range(len(different))]).alias("__df"))
    # One row for each group that has terms, or one in all.
    if group:
        rows = rows.join(F.broadcast(stats.where(F.col(group).isin(list(lists)))), by, "left")
    else:
        rows = rows.crossJoin(F.broadcast(stats))
    ratio = F.coalesce(F.try_divide(count(0), F.col("__all") / F.greatest(F.col("__n"), F.lit(1))), F.lit(0.0))
    parts = []
    for k, term in enumerate(different):
        tf, df = count(k + 1), F.col("__df")[k]
        times = F.lit(0)
        for name, each in lists.items():
            n = list(each).count(term)
            times = F.lit(n) if name is None else F.when(F.col(group) == name, n).otherwise(times) if n else times
        idf = F.ln((F.col("__n") - df + 0.5) / (df + 0.5) + 1)
        parts.append(F.coalesce(F.when(tf > 0, idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * ratio)) * times), F.lit(0.0)))
    rows = rows.withColumn("bm25_raw", add(parts).cast("double")).drop("__n", "__all", "__df", "__counts", "__made")
    most = rows.groupBy(*by).agg(F.greatest(F.max("bm25_raw"), F.lit(1.0)).alias("__most"))
    rows = rows.join(F.broadcast(most.where(F.col(group).isin(list(lists)))), by, "left") if group else rows.crossJoin(F.broadcast(most))
    return rows.withColumn("bm25", F.coalesce(F.least(F.col("bm25_raw") / F.col("__most"), F.lit(1.0)), F.lit(0.0))).drop("__most")


def age_days(published: Column | str, as_of: int) -> Column:
    return (F.lit(as_of) - col(published)) / F.lit(float(DAY))


def recency(published: Column | str, as_of: int, half_life: Column | float) -> Column:
    """2 ** (-age / half life), from 0.2 to 1; `published` in epoch seconds."""
    half = half_life if isinstance(half_life, Column) else F.lit(float(half_life))
    return F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.pow(F.lit(2.0), -age_days(published, as_of) / half)))


def in_window(published: Column | str, as_of: int, days: int) -> Column:
    return col(published) >= F.lit(as_of - days * DAY)


def domain_boost(text: Column, terms: Sequence[str] = config.CORE_TERMS, highlight: str | None = None, agent: str = "agent") -> Column:
    """5 with the highlighted term; else 3, 2 or 1.5 for three, two or one core terms;
    2.5 if the only one is a context term and "agent" occurs."""
    lower = F.lower(text)
    n = hits(lower, terms)
    context = hits(lower, terms[config.CONTEXT_TERMS]) > 0
    boost = F.when(n >= 3, 3.0).when(n == 2, 2.0).when(contains(lower, agent) & context, 2.5).when(n == 1, 1.5).otherwise(1.0)
    return F.when(contains(lower, highlight), 5.0).otherwise(boost) if highlight else boost


def llm_composite(relevance: Column | str, usefulness: Column | str) -> Column:
    """0.7 * relevance + 0.3 * usefulness, from 0 to 10."""
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), col(relevance) * 0.7 + col(usefulness) * 0.3))


def heuristic_score(text: Column, groups: dict[str, Sequence[str]] = config.HEURISTIC_GROUPS, off_topic: Sequence[str] = config.OFF_TOPIC) -> Column:
    """A struct of relevance, usefulness and tags from keyword groups; a word is looked for once a text."""

    def made(n: Column) -> Column:
        boosts = {tag: F.least(n[k] * F.lit(0.5), F.lit(2.0)) for k, tag in enumerate(groups)}
        relevance, usefulness = F.lit(5.0), F.lit(5.0)
        for boost in boosts.values():
            relevance, usefulness = F.least(F.lit(10.0), relevance + boost), F.least(F.lit(10.0), usefulness + boost * 0.8)
        on = add([F.when(b > 0, 1).otherwise(0) for b in boosts.values()]) > 0
        off = (n[len(groups)] > 0) & ~on
        tags = F.array_compact(F.array(*[F.when(b > 0, F.lit(tag)) for tag, b in boosts.items()], F.when(off, F.lit("off-topic"))))
        final = F.when(off, F.greatest(F.lit(0.0), relevance - 3)).otherwise(relevance)
        return F.struct(half_up(final, 1).alias("relevance"), half_up(usefulness, 1).alias("usefulness"), tags.alias("tags"))

    counts = once(F.lower(text), lambda lower: F.array(*[hits(lower, words) for words in [*groups.values(), off_topic]]))
    return once(counts, made)


def heuristic_scores(text: Column, groups: dict[str, Sequence[str]] = config.HEURISTIC_GROUPS, off_topic: Sequence[str] = config.OFF_TOPIC) -> dict[str, Column]:
    """relevance, usefulness and tags of heuristic_score(), a column each."""
    found = heuristic_score(text, groups, off_topic)
    return {name: found[name] for name in ("relevance", "usefulness", "tags")}


def first_scores(scores: DataFrame, key: str = "item_id", at: str = "scored_at") -> DataFrame:
    """The oldest score of each item; an aggregate, so no window over an item's history.
    Of scores of one time it is always the same one."""
    rest = [c for c in scores.columns if c != key]
    return scores.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(at, F.xxhash64(*rest))).alias("s")).select(key, "s.*")


def latest_scores(scores: DataFrame, key: str = "item_id", at: str = "scored_at") -> DataFrame:
    rest = [c for c in scores.columns if c != key]
    return scores.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, F.xxhash64(*rest))).alias("s")).select(key, "s.*")


def rank_categories(items: DataFrame, scores: DataFrame, as_of: int, days: int, categories: Sequence[str] | None = None, terms: dict[str, Sequence[str]] | None = None,
                    core_terms: Sequence[str] = config.CORE_TERMS, highlight: str | None = None, unscored_min: float = 3.0, columns: Sequence[str] | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """Ranked items of each category in one job.

    items: id, title, summary, source_title, category, published_at (epoch
    seconds).  scores: item_id, scored_at, relevance, usefulness, tags; the
    oldest counts.  Adds bm25, recency, llm, relevance, usefulness, tags, boost
    and final to the items' `columns` (all by default; without texts less is
    shuffled) and `extra` columns, which are made from the items.  Kept are rows
    without an off-topic tag whose relevance reaches the category's least
    (`unscored_min` for items without a score).
    """
    categories = list(categories or config.CATEGORIES)
    terms = terms or {c: query_terms(config.CATEGORY[c].query) for c in categories}
    rows = items.where(in_window("published_at", as_of, days) & F.col("category").isin(categories))
    made = {"boost": domain_boost(text_of("title", "summary"), core_terms, highlight), **(extra or {})}
    if columns is not None:
        columns = ["source_title", "published_at", *columns]
    rows = bm25(rows, {c: list(terms[c]) for c in categories}, text_of("title", "summary", "source_title", "category"), "category", columns=columns, extra=made)
    own = lambda f: F.element_at(F.create_map(*[x for c in categories for x in (F.lit(c), F.lit(float(f(config.CATEGORY[c]))))]), F.col("category"))
    first = first_scores(scores.select("item_id", "scored_at", "relevance", "usefulness", "tags")).withColumnsRenamed({"relevance": "s_rel", "usefulness": "s_use", "tags": "s_tags"})
    rows = rows.join(first, rows.id == first.item_id, "left").drop("scored_at")
    scored = F.col("item_id").isNotNull()
    guess = half_up(F.col("bm25") * 10)
    rows = rows.withColumns({
        "llm": F.when(scored, (F.col("s_rel") * 0.7 + F.col("s_use") * 0.3) / 10).otherwise(F.col("bm25")),
        "recency": recency("published_at", as_of, own(lambda c: c.half_life_days)),
        "relevance": F.when(scored, F.col("s_rel")).otherwise(guess),
        "usefulness": F.when(scored, F.col("s_use")).otherwise(guess),
        "tags": F.coalesce("s_tags", F.array().cast("array<string>")),
        "least": F.when(scored, own(lambda c: c.min_relevance)).otherwise(F.lit(unscored_min)),
    })
    rows = rows.withColumn("final", (own(lambda c: c.w_llm) * F.col("llm") + own(lambda c: c.w_bm25) * F.col("bm25") + own(lambda c: c.w_recency) * F.col("recency")) * F.col("boost"))
    rows = rows.where((F.col("relevance") >= F.col("least")) & ~F.array_contains("tags", "off-topic"))
    return rows.drop("s_rel", "s_use", "s_tags", "least", "item_id", "bm25_raw")


def with_rank(rows: DataFrame, score: str = "final", group: Sequence[str] = ("category",), ties: Sequence[str] = ("id",), most: int | None = None, out: str = "rank", spread: int | None = None) -> DataFrame:
    """`rows` with their place by descending score (9 decimals, so that engines agree on ties; NaN first, null last).

    With `most`, rows beyond it go before the shuffle.  To number all rows of a
    group, it is cut into `spread` ranges of scores that are sorted apart; the
    counts of the ranges give each its first place, so places are the same for
    every spread.  By default small sessions sort a group at once, and larger
    ones cut it finer the more partitions they have.
    """
    place = F.round(score, 9)
    if most is not None:
        order = Window.partitionBy(*group).orderBy(place.desc_nulls_last(), *ties)
        return rows.withColumn(out, F.row_number().over(order).cast("long")).where(F.col(out) <= most)
    spread = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16) if spread is None else spread
    if spread == 1:
        order = Window.partitionBy(*group).orderBy(place.desc_nulls_last(), *ties)
        return rows.withColumn(out, F.row_number().over(order).cast("long"))
    marks = F.array(*[F.lit(k / spread) for k in range(1, spread)])
    # Approximate ends depend on the order in which partial results arrive, and two
    # parts of the plan read them: they are written once, so that both have the same.
    ends = written(rows.groupBy(*group).agg(F.percentile_approx(place, marks, F.lit(10_000)).alias("__ends")), "ends")
    cut = beside(rows, ends, group)
    own = F.size(F.filter(F.coalesce("__ends", F.array().cast("array<double>")), lambda end: end > place))
    cut = cut.withColumn("__range", F.when(place.isNull(), spread).otherwise(own)).drop("__ends")
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    first = cut.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n")).withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*group, "__range").orderBy(place.desc_nulls_last(), *ties)
    numbered = cut.withColumn("__k", F.row_number().over(inside))
    return beside(numbered, first, [*group, "__range"]).withColumn(out, F.col("__first") + F.col("__k")).drop("__first", "__k", "__range")
