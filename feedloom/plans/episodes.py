"""Episodes: digests, rundowns, scripts, segments, reports, and replies of models."""
from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import digests, podcast, render, replies
from feedloom.plans.registry import query
from feedloom.sources.items import items, read

#: An item's digest for its source's episode, and its place there.
DIGESTS = """WITH dig AS (SELECT id, title, source_title, CASE WHEN summary = '' THEN 'No summary available' ELSE summary END AS gist, 'Relevant to code intelligence' AS takeaway, id % 11 AS relevance FROM items WHERE id % 11 >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY source_title ORDER BY relevance DESC, id) AS k FROM dig) """


def _digests(spark, d):
    rows = items(spark, d).withColumns({"url": F.concat(F.lit("https://x.example/"), F.col("id").cast("string")), "final": F.col("id") % 11 / 10.0})
    return digests.podcast_digests(rows)


def _rundown(spark, d):
    return podcast.rundown(_digests(spark, d), ["source_name"], [F.desc("relevance_to_focus"), "id"])


@query(DIGESTS + """SELECT source_title AS source_name, id, CASE WHEN k <= 4 THEN 'segment' WHEN k <= 7 THEN 'lightning' ELSE 'cut' END AS band, CASE WHEN k <= 4 THEN 120 ELSE 0 END AS seconds,
  CASE WHEN k <= 7 THEN k END AS place FROM r""", "items")
def rundown_fallback(spark, d):
    return _rundown(spark, d).select("source_name", "id", "band", "seconds", F.col("place").cast("long").alias("place"))


SCRIPT = DIGESTS + """, seg AS (SELECT source_title, k, '## ' || substr(takeaway, 1, 50) || chr(10) || chr(10) || '**HOST:** ' || (['Let''s kick things off with', 'Moving on to', 'Next up,', 'Now let''s look at'])[k] || ' ' || lower(substr(takeaway, 1, 50)) || '. ' || substr(gist, 1, 150) || chr(10) || chr(10) || '[PAUSE]' || chr(10) || chr(10) AS part
  FROM r WHERE k <= 4),
script AS (SELECT source_title AS source_name, (SELECT count(*) FROM dig d WHERE d.source_title = seg.source_title) AS stories, '[INTRO MUSIC]' || chr(10) || chr(10) || '**HOST:** Welcome to this week''s code intelligence digest. I''m your host.' || chr(10) || chr(10) || '**COHOST:** And I''m your co-host. Today we''re covering '
  || (SELECT count(*) FROM dig d WHERE d.source_title = seg.source_title) || ' stories on code search, agents, and developer tools.' || chr(10) || chr(10) || string_agg(part, '' ORDER BY k)
  || '**HOST:** That''s all for this week. Thanks for listening. Check the show notes for all links.' || chr(10) || chr(10) || '[OUTRO MUSIC]' AS script FROM seg GROUP BY source_title),
timed AS (SELECT *, ceil(len(string_split_regex(script, '\\s+')) / 150.0::DOUBLE * 60)::BIGINT AS seconds FROM script) """


@query(SCRIPT + "SELECT source_name, stories, script, seconds FROM timed", "items")
def script_fallback(spark, d):
    return podcast.fallback_script(_rundown(spark, d), "source_name")


@query(SCRIPT + """, dealt AS (SELECT t.source_name, r.k, floor((t.seconds - 60) / (SELECT count(*)::DOUBLE FROM seg s WHERE s.source_title = t.source_name) + 0.5)::BIGINT AS duration FROM timed t JOIN r ON r.source_title = t.source_name AND r.k <= 4)
SELECT source_name, k AS place, duration, (30 + coalesce(sum(duration) OVER (PARTITION BY source_name ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM dealt""", "items")
def script_segments(spark, d):
    """Spoken time dealt to segments in proportion to what was planned."""
    rows = _rundown(spark, d)
    spoken = podcast.fallback_script(rows, "source_name").withColumnRenamed("seconds", "spoken")
    found = podcast.script_times(rows.where("band = 'segment'"), spoken, "source_name")
    return found.select("source_name", F.col("place").cast("long").alias("place"), "duration", "start")


@query(DIGESTS + "SELECT source_title AS source_name, k AS place, (k - 1) * 120 AS start, k * 120 AS stop FROM r WHERE k <= 4", "items")
def script_planned(spark, d):
    found = podcast.planned_times(_rundown(spark, d).where("band = 'segment'"), "source_name")
    return found.select("source_name", F.col("place").cast("long").alias("place"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


def _transcripts(spark, d):
    """Conversations as transcripts with a segment for each turn; those of one turn have no marks."""
    n, ref = F.col("turn").cast("string"), (F.col("turn") % 4).cast("string")
    body = F.concat(F.lit("Said (ref: item-"), ref, F.lit(").\n- A point made by "), "role", F.lit(" (ref: item-"), ref, F.lit(")\n— short\n"), "text", F.lit("\n"))
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("## SEGMENT: Part "), n, F.lit("\n"), body).alias("said"), body.alias("body")))).alias("turns"))
    joined = F.array_join(F.transform("turns", lambda t: t["said"]), "")
    return rows.select("conv_id", F.when(F.size("turns") > 1, joined).otherwise(F.col("turns")[0]["body"]).alias("script"))


SEGMENTS = """WITH b AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS turns, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n,
  'Said (ref: item-' || turn % 4 || ').' || chr(10) || '- A point made by ' || role || ' (ref: item-' || turn % 4 || ')' || chr(10) || '— short' || chr(10) || text || chr(10) AS body FROM conversations),
l AS (SELECT *, ceil(len(string_split_regex(body, '\\s+')) / 150.0::DOUBLE * 60)::BIGINT AS duration,
  list_filter(list_transform(list_filter(string_split(body, chr(10)), lambda x: contains(x, '—') OR regexp_matches(x, '^\\s*-')), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^[-\\s]+', ''), '\\(ref:.*?\\)', '', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 10) AS lines FROM b),
seg AS (SELECT conv_id, n, CASE WHEN turns = 1 THEN 'Full Episode' ELSE 'Part ' || turn END AS title, duration, (sum(duration) OVER (PARTITION BY conv_id ORDER BY n))::BIGINT AS stop, turn % 4 AS ref, CASE WHEN turns = 1 THEN [] ELSE lines[1:3] END AS lines FROM l) """


@query(SEGMENTS + """SELECT conv_id, n, title, stop - duration AS start, stop, printf('%d:%02d', stop // 60, stop % 60) AS end_time, ref::VARCHAR AS refs, array_to_string(lines, '; ') AS highlights FROM seg""")
def transcript_segments(spark, d):
    """Segments of transcripts with running times, references and highlights."""
    found = podcast.segments(_transcripts(spark, d), "conv_id")
    return found.select("conv_id", F.col("n").cast("long").alias("n"), "title", "start", "stop", "end_time", F.array_join(F.col("refs").cast("array<string>"), ",").alias("refs"), F.array_join("highlights", "; ").alias("highlights"))


@query(SEGMENTS + """SELECT conv_id, n, ref, CASE WHEN ref < 2 THEN (conv_id * 10 + ref)::VARCHAR ELSE 'item-' || ref END AS item_id, CASE WHEN ref < 2 THEN 'T' || ref ELSE 'Unknown' END AS title FROM seg""")
def transcript_references(spark, d):
    """What the references of segments stand for; an episode has two items here."""
    own = read(spark, d, "conversations").select("conv_id").distinct().select("conv_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("position"))
    own = own.select("conv_id", "position", (F.col("conv_id") * 10 + F.col("position")).alias("item_id"), F.concat(F.lit("T"), F.col("position").cast("string")).alias("title"), F.lit("u").alias("url"), F.lit("s").alias("source_title"))
    found = podcast.referenced(podcast.segments(_transcripts(spark, d), "conv_id"), own, "conv_id")
    return found.select("conv_id", F.col("n").cast("long").alias("n"), F.col("ref").cast("long").alias("ref"), "item_id", "title")


@query("""SELECT conv_id, count(*) FILTER (WHERE turn % 3 = 0) AS errors, count(*) FILTER (WHERE turn % 3 = 1) AS warnings, CASE WHEN count(*) FILTER (WHERE turn % 3 = 0) = 0 THEN 'Yes' ELSE 'No' END AS passed FROM conversations GROUP BY conv_id""")
def verification_report(spark, d):
    severity = F.when(F.col("turn") % 3 == 0, "error").when(F.col("turn") % 3 == 1, "warning")
    rows = read(spark, d, "conversations").select("conv_id", severity.alias("severity"), F.lit("fact").alias("type"), F.col("role").alias("line"), F.lit("wrong").alias("issue"), F.lit("mend").alias("fix"))
    found = digests.verification_report(rows, ["conv_id"])
    return found.select("conv_id", "errors", "warnings", F.regexp_extract("report", r"Verification:\*\* (\w+)", 1).alias("passed"))


@query("""WITH s AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS script, arg_min(text, turn) AS line FROM conversations GROUP BY conv_id),
a AS (SELECT conv_id, line, CASE WHEN conv_id % 2 = 0 AND contains(script, line) THEN line || ' [NEEDS SUPPORT]' || substr(script, length(line) + 1) ELSE script END AS script FROM s)
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'It may be so.' || substr(script, length(line) + 1) ELSE script END AS script FROM a""")
def verification_fixes(spark, d):
    """The first line of a script is unsupported, or says too much, or both."""
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    rows = rows.select("conv_id", F.array_join(F.transform("turns", lambda t: t["text"]), "\n").alias("script"), F.col("turns")[0]["text"].alias("line"))
    one = rows.where("conv_id % 2 = 0").select("conv_id", F.lit(1).alias("n"), F.lit("error").alias("severity"), F.lit("unsupported_claim").alias("type"), "line", F.lit("").alias("fix"))
    two = rows.where("conv_id % 3 = 0").select("conv_id", F.lit(2).alias("n"), F.lit("warning").alias("severity"), F.lit("overconfident_language").alias("type"), "line", F.lit("It may be so.").alias("fix"))
    return digests.apply_fixes(rows.drop("line"), one.unionByName(two), "conv_id", "n")


@query("""WITH f AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all('a [' || doc_id % 5 || '] b [' || doc_id % 3 || '] [' || doc_id % 5 || '] [9] [x] ' || text, '\\[([0-9]+)\\]', 1), lambda x: x::BIGINT), lambda n: n >= 1 AND n <= 4) AS l FROM documents)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS cited FROM f""")
def citation_extract(spark, d):
    n = F.col("doc_id")
    made = F.concat(F.lit("a ["), (n % 5).cast("string"), F.lit("] b ["), (n % 3).cast("string"), F.lit("] ["), (n % 5).cast("string"), F.lit("] [9] [x] "), "text")
    return read(spark, d, "documents").select("doc_id", F.array_join(replies.citations(made, 4), ",").alias("cited"))


@query("""WITH c AS (SELECT doc_id, doc_id // 5 AS batch, row_number() OVER (PARTITION BY doc_id // 5 ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY doc_id // 5) AS n FROM documents),
g AS (SELECT *, batch % 4 <> 3 AND batch % 7 <> 6 AS good FROM c)
SELECT doc_id, CASE WHEN NOT good OR doc_id % 12 = 0 THEN 5 ELSE least(10, doc_id % 12) END::DOUBLE AS relevance, CASE WHEN NOT good OR doc_id % 2 = 0 THEN 5 ELSE 0 END::DOUBLE AS usefulness, CASE WHEN good THEN 'b' || batch ELSE '' END AS tags FROM g""")
def llm_json_parse(spark, d):
    """Replies to batches of five: some have no list, some one of another length, some lack a score."""
    n = F.col("doc_id")
    one = F.concat(F.lit('{"relevance": '), (n % 12).cast("string"), F.when(n % 2 == 1, ', "usefulness": -3').otherwise(""), F.lit(', "tags": ["b'), F.floor(n / 5).cast("string"), F.lit('"]}'))
    rows = read(spark, d, "documents").groupBy(F.floor(n / 5).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("doc_id", one.alias("said")))).alias("rows"))
    said = F.array_join(F.transform("rows", lambda r: r["said"]), ", ")
    more = F.when(F.col("batch") % 7 == 6, ', {"relevance": 1}').otherwise("")
    reply = F.when(F.col("batch") % 4 == 3, "no list").otherwise(F.concat(F.lit("Sure:\n["), said, more, F.lit("]\ndone")))
    found = replies.batch_scores(rows.select(F.transform("rows", lambda r: r["doc_id"]).alias("ids"), reply.alias("reply")))
    return found.select(F.col("id").alias("doc_id"), "relevance", "usefulness", F.array_join("tags", ",").alias("tags"))


@query("""SELECT doc_id, 1 + doc_id % 12 AS failures, least(60 * pow(2, doc_id % 12), 28800)::BIGINT AS wait FROM documents""")
def backoff(spark, d):
    n = F.col("doc_id") % 12 + 1
    return read(spark, d, "documents").select("doc_id", n.alias("failures"), replies.retry_after(n).alias("wait"))


ISSUE = """WITH x AS (SELECT id % 50 AS issue, category, list_position(['research', 'tech_articles', 'product_news', 'ai_news', 'community', 'newsletters', 'podcasts'], category) AS p, id % 11 AS relevance, title, source_title, substr(summary, 1, 100) AS gist, id FROM items),
n AS (SELECT *, CASE WHEN category = 'ai_news' THEN 'AI News' ELSE array_to_string(list_transform(string_split(category, '_'), lambda w: upper(w[1]) || w[2:]), ' ') END AS name FROM x) """


def _issues(spark, d):
    rows = items(spark, d).select((F.col("id") % 50).alias("issue"), "category", (F.col("id") % 11).alias("relevance"), "title", F.concat(F.lit("https://x.example/?a=1&b="), F.col("id").cast("string")).alias("url"), "source_title", F.substring("summary", 1, 100).alias("gist"))
    return rows.withColumn("key_bullets", F.array(F.lit("one <b>"), F.lit("two")))


@query(ISSUE + """, e AS (SELECT *, '### [' || title || '](https://x.example/?a=1&b=' || id || ')' || chr(10) || chr(10) || '*' || source_title || '*' || chr(10) || chr(10) || gist || chr(10) || chr(10) || '- one <b>' || chr(10) || '- two' || chr(10) || chr(10) AS entry FROM n),
s AS (SELECT issue, p, '## ' || name || chr(10) || chr(10) || string_agg(entry, '' ORDER BY -relevance, title, entry) AS body FROM e GROUP BY issue, p, name)
SELECT issue, '# Weekly' || chr(10) || chr(10) || string_agg(body, '' ORDER BY p) AS body FROM s GROUP BY issue""", "items")
def render_markdown(spark, d):
    return render.newsletter(_issues(spark, d), "issue", "Weekly")


ESCAPE = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')"


@query(ISSUE + f""", e AS (SELECT *, '<article><h3><a href="https://x.example/?a=1&amp;b=' || id || '">' || {ESCAPE.format("title")} || '</a></h3><p><em>' || source_title || '</em></p><p>' || {ESCAPE.format("gist")} || '</p><ul><li>one &lt;b&gt;</li><li>two</li></ul></article>' AS entry FROM n),
s AS (SELECT issue, p, '<section><h2>' || name || '</h2>' || string_agg(entry, '' ORDER BY -relevance, title, entry) || '</section>' AS body FROM e GROUP BY issue, p, name)
SELECT issue, '<h1>Weekly</h1>' || string_agg(body, '' ORDER BY p) AS body FROM s GROUP BY issue""", "items")
def render_html(spark, d):
    return render.newsletter(_issues(spark, d), "issue", "Weekly", html=True)
