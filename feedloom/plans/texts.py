"""Text, url and transcript functions over the driver's tables."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedloom.functions import chunks, config, text, urls
from feedloom.operators import decompose as newsletters
from feedloom.operators import digests, replies
from feedloom.plans.registry import query
from feedloom.sources.items import read, spread, text_items, with_urls

HOST_SQL = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"


@query("""WITH r AS (SELECT page_id, split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1) AS rest FROM pages),
k AS (SELECT page_id, CASE WHEN strpos(rest, '/') > 0 THEN lower(substr(rest, 1, strpos(rest, '/') - 1)) || substr(rest, strpos(rest, '/')) ELSE lower(rest) || '/' END AS key FROM r)
SELECT page_id, form, CASE form WHEN 'encoded' THEN key || '%C3%A9%20' ELSE key END AS key FROM k, (VALUES ('plain'), ('loud'), ('dots'), ('spaces'), ('encoded')) f(form)""")
def url_key(spark, d):
    """Keys of urls as they are, with a louder host, port and query, with dot segments,
    between spaces, and with what has to be encoded at the end."""
    cut = F.regexp_extract("url", "^([^?#]*)", 1)
    head, tail = F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0), F.substring(cut, F.length(F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)) + 1, F.length("url"))
    port = F.when(head.startswith("https"), ":443").otherwise(":80")
    path = F.when(tail == "", "/").otherwise(tail)
    forms = {"plain": F.col("url"), "loud": F.concat(F.upper(head), port, path, F.lit("?x=/../y#z")), "dots": F.concat(head, F.lit("/q/./r/.."), F.lit("/%2E%2e"), path), "spaces": F.concat(F.lit(" \t"), "url", F.lit("\n ")), "encoded": F.concat(head, path, F.lit("é ?q"))}
    rows = read(spark, d, "pages").select("page_id", F.explode(F.array(*[F.struct(F.lit(n).alias("form"), u.alias("url")) for n, u in forms.items()])).alias("f"))
    return rows.select("page_id", "f.form", urls.url_key("f.url").alias("key"))


@query(f"SELECT page_id, {HOST_SQL} AS host FROM pages")
def vendor_hostname(spark, d):
    return read(spark, d, "pages").select("page_id", urls.hostname("url").alias("host"))


#: Pages' urls moved to hosts with rules of their own, by page number.
BLOGS = "CASE page_id % 6 WHEN 0 THEN 'https://ann.substack.com/p/' WHEN 1 THEN 'https://www.medium.com/@bob/' WHEN 2 THEN 'https://medium.com/x/' WHEN 3 THEN 'https://dev.to/c/' WHEN 4 THEN 'http://substack.com/' ELSE url END"


def _blogs(spark, d):
    own = F.when(F.col("page_id") % 6 == 5, F.col("url"))
    for k, u in enumerate(("https://ann.substack.com/p/", "https://www.medium.com/@bob/", "https://medium.com/x/", "https://dev.to/c/", "http://substack.com/")):
        own = own.when(F.col("page_id") % 6 == k, F.lit(u))
    return read(spark, d, "pages").select("page_id", own.alias("u"))


@query(f"""WITH h AS (SELECT page_id, {BLOGS} AS url FROM pages), s AS (SELECT page_id, url, replace({HOST_SQL}, 'www.', '') AS site FROM h)
SELECT page_id, CASE WHEN site = 'ann.substack.com' THEN 'ann' WHEN contains(url, '/@') THEN regexp_extract(url, '@([a-z]+)', 1) END AS author,
  CASE WHEN site = 'ann.substack.com' THEN 'substack.com' ELSE site END AS source FROM s""")
def url_metadata(spark, d):
    return _blogs(spark, d).select("page_id", *[c.alias(n) for n, c in zip(("author", "source"), urls.metadata("u"))])


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://x.example/' || page_id WHEN 1 THEN 'https://y.example/a/b?c=' || page_id WHEN 2 THEN 'https://track.example/CL0/https:%2F%2Fx.example/none' ELSE url END AS target FROM pages""")
def url_unwrap_cl0(spark, d):
    n = F.col("page_id").cast("string")
    encoded = F.concat(F.lit("https://track.example/CL0/https:%2F%2Fx.example%2F"), n, F.lit("/1/abc"))
    plain = F.concat(F.lit("https://track.example/CL0/https://y.example/a/b%3Fc%3D"), n, F.lit("/22/abc"))
    wrapped = F.when(n % 4 == 0, encoded).when(n % 4 == 1, plain).when(n % 4 == 2, "https://track.example/CL0/https:%2F%2Fx.example/none").otherwise(F.col("url"))
    return read(spark, d, "pages").select("page_id", urls.unwrap_cl0(wrapped).alias("target"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://mail.example/redirect/2/abc' ELSE url END AS target FROM pages")
def url_unwrap_b64(spark, d):
    coded = F.translate(F.base64(F.concat(F.lit('{"e":"'), "url", F.lit('"}')).cast("binary")), "+/=\r\n", "-_")
    wrapped = F.when(F.col("page_id") % 3 == 0, "https://mail.example/redirect/2/abc").otherwise(F.concat(F.lit("https://substack.com/redirect/2/"), coded, F.lit("?r=1")))
    return read(spark, d, "pages").select("page_id", urls.unwrap_base64(wrapped).alias("target"))


def _rejects(patterns):
    return " OR ".join("regexp_matches(u, '" + p.replace("(?i)", "").replace("'", "''") + "', 'i')" for p in patterns)


PATHS = "['/subscribe', '/press/', '/archive', '/links/digest', '/p/post', '/issues/12', '/about', '/story']"
PATH_LIST = ["/subscribe", "/press/", "/archive", "/links/digest", "/p/post", "/issues/12", "/about", "/story"]


def _made_urls(spark, d):
    tail = F.element_at(F.array(*map(F.lit, PATH_LIST)), (F.col("page_id") % 8 + 1).cast("int"))
    return read(spark, d, "pages").select("page_id", F.concat(F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0), tail).alias("u"))


MADE = f"WITH m AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') || ({PATHS})[page_id % 8 + 1] AS u FROM pages) "


@query(MADE + f"SELECT page_id, ({_rejects(config.BAD_URL)} OR (contains(u, '/links/') AND contains(u, 'digest'))) AS bad FROM m")
def url_block_review(spark, d):
    return _made_urls(spark, d).select("page_id", urls.bad_review_url("u").alias("bad"))


@query(MADE + "SELECT page_id, (u LIKE '%/subscribe' OR u LIKE '%/press/' OR u LIKE '%/archive' OR u LIKE '%/issues/12' OR u LIKE '%/about') AS bad FROM m")
def url_block_decompose(spark, d):
    return _made_urls(spark, d).select("page_id", text.any_match("u", [f"(?i){p}" for p in newsletters.BAD_URL]).alias("bad"))


@query("""SELECT doc_id, trim(lower(t)) IN ('advertise', 'sponsor', 'advertisement', 'promotional content', 'subscribe', 'join', 'sign up') AS bad FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN text ELSE (['Sponsor', 'a sponsor', 'sign up'])[doc_id % 4 + 1] END AS t FROM documents)""")
def title_block(spark, d):
    n = F.col("doc_id") % 4
    title = F.when(n == 3, F.col("text")).otherwise(F.element_at(F.array(*map(F.lit, ["Sponsor", "a sponsor", "sign up", ""])), (n + 1).cast("int")))
    return read(spark, d, "documents").select("doc_id", text.any_match(title, [f"(?i){p}" for p in newsletters.BAD_TITLE]).alias("bad"))


@query(MADE + f"SELECT page_id, ({_rejects(config.BAD_PODCAST_URL[:-1])} OR u LIKE '%/subscribe') AS bad FROM m")
def url_block_podcast(spark, d):
    return _made_urls(spark, d).select("page_id", urls.bad_podcast_url("u").alias("bad"))


@query(MADE + f"SELECT page_id, ({_rejects([p for p in config.BAD_SEARCH_URL if '(?!' not in p])} OR u LIKE '%/subscribe') AS bad FROM m")
def url_block_search(spark, d):
    return _made_urls(spark, d).select("page_id", urls.bad_search_url("u").alias("bad"))


@query(f"""SELECT page_id, list_filter(regexp_extract_all('https://a.tracking.example/x https://b.example/sponsor ' || html, 'https?://[^\\s<>"'')]+'), lambda u: NOT ({_rejects(config.BAD_FOUND_URL)}))[1] AS first_url FROM pages""")
def url_first_in_text(spark, d):
    html = F.concat(F.lit("https://a.tracking.example/x https://b.example/sponsor "), "html")
    return read(spark, d, "pages").select("page_id", urls.first_url(html).alias("first_url"))


@query("""WITH q AS (SELECT doc_id, text, trim(regexp_replace(substr(text, 1, 80), '[^A-Za-z0-9_\\s-]', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS q FROM documents)
SELECT doc_id, CASE WHEN q = '' THEN text ELSE q END AS q FROM q""")
def search_query_clean(spark, d):
    return read(spark, d, "documents").select("doc_id", urls.search_query("text").alias("q"))


@query("""SELECT doc_id, nullif(regexp_extract(text || ' https://arxiv.org/' || CASE WHEN doc_id % 2 = 0 THEN 'abs/' ELSE 'list/' END || printf('%04d.%05d', 1000 + doc_id % 9000, doc_id % 100000) || 'v2', 'arxiv\\.org/(abs|pdf)/([0-9]{4}\\.[0-9]{4,5})', 2), '') AS arxiv FROM documents""")
def arxiv_id(spark, d):
    n = F.col("doc_id")
    made = F.concat("text", F.lit(" https://arxiv.org/"), F.when(n % 2 == 0, "abs/").otherwise("list/"), F.lpad((1000 + n % 9000).cast("string"), 4, "0"), F.lit("."), F.lpad((n % 100000).cast("string"), 5, "0"), F.lit("v2"))
    return read(spark, d, "documents").select("doc_id", urls.arxiv_id(made).alias("arxiv"))


@query("SELECT p_partkey, 'https://papers.example/abs/' || url_encode(p_name) AS url FROM part")
def paper_url(spark, d):
    return read(spark, d, "part").select("p_partkey", urls.paper_url("p_name", "https://papers.example/abs/").alias("url"))


@query("SELECT o_orderkey, year(o_orderdate)::INTEGER AS year FROM orders")
def year_from_pubdate(spark, d):
    return read(spark, d, "orders").select("o_orderkey", replies.year_of(F.date_format("o_orderdate", "yyyy-MM")).alias("year"))


@query("""SELECT conv_id, CASE WHEN count(*) > 3 THEN string_agg(role, ', ' ORDER BY turn) FILTER (WHERE turn <= (SELECT min(turn) + 2 FROM conversations c WHERE c.conv_id = o.conv_id)) || ' et al.'
  ELSE string_agg(role, ', ' ORDER BY turn) END AS label FROM conversations o GROUP BY conv_id""")
def authors_label(spark, d):
    names = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(names).alias("json"))
    return rows.select("conv_id", replies.authors_label("json").alias("label"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g')) AS txt FROM pages""")
def strip_html(spark, d):
    return read(spark, d, "pages").select("page_id", text.strip_html("html").alias("txt"))


@query("""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<script\\b.*?</script>', '', 'gis'), '<style\\b.*?</style>', '', 'gis') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') AS t FROM a)
SELECT page_id, trim(regexp_replace(regexp_replace(t, '&#[0-9]+;', '', 'g'), '\\s+', ' ', 'g')) AS txt FROM b""")
def html_to_text(spark, d):
    return read(spark, d, "pages").select("page_id", text.html_to_text("html").alias("txt"))


@query("""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gi'), '<style[^>]*>.*?</style>', '', 'gi'), '<br\\s*/?>', chr(10), 'gi') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(replace(replace(replace(t, '</p>', chr(10)), '</li>', chr(10)), '</div>', chr(10)), '<h[1-6][^>]*>(.*?)</h[1-6]>', chr(10) || '\\1' || chr(10), 'gi') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(t, '<a[^>]*href=["'']([^"'']*?)["''][^>]*>(.*?)</a>', '\\2 (\\1)', 'gi'), '<[^>]+>', '', 'g') AS t FROM b),
d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)) AS t FROM c)
SELECT page_id, regexp_replace(regexp_replace(t, '\\n\\n\\n+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS txt FROM d""")
def html_to_plaintext(spark, d):
    return read(spark, d, "pages").select("page_id", text.html_to_plaintext("html").alias("txt"))


@query(None)
def chunk_2000(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(chunks.chunk_sentences()("text")).alias("n", "chunk"))
    return rows.select("doc_id", "n", F.length("chunk").alias("chars"))


@query(None)
def chunk_tts_3800(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(chunks.chunk_speech()("text")).alias("n", "chunk"))
    return rows.select("doc_id", "n", F.length("chunk").alias("chars"))


@query("""WITH h AS (SELECT doc_id, text, substr(text, 1, 200) AS head FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN NOT contains(head, ' ') THEN head ELSE array_to_string(string_split(head, ' ')[:-2], ' ') END AS short FROM h""")
def truncate_word(spark, d):
    return read(spark, d, "documents").select("doc_id", text.truncate_word("text", 200).alias("short"))


@query(None)
def decompose_newsletter(spark, d):
    pages = read(spark, d, "pages")
    n = pages.count()  # from the file footers
    rows = text_items(spark, d).join(pages.select("page_id", "url", "html"), F.col("id") % max(n, 1) == F.col("page_id")).drop("page_id")
    rows = rows.withColumns({"summary": F.col("html"), "bm25": F.lit(0.8), "final": F.lit(0.9)}).drop("html")
    return newsletters.decompose(rows, ["src"]).select("id", "title", "url", F.round("bm25", 6).alias("bm25"), F.round("final", 6).alias("final"))


WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: The digest of every item, with markup in every other text.
DIGEST = f"""WITH f AS (SELECT id, source_title, title, CASE WHEN summary = '' THEN 'No summary available' ELSE CASE WHEN id % 2 = 0 THEN '<p class="x">Lead &amp; &lt;more&gt;</p> ' ELSE '' END || summary END AS raw, id % 11 / 10.0 AS final FROM items),
g AS (SELECT *, CASE WHEN contains(raw, '<') THEN trim(regexp_replace(replace(replace(replace(replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g')) ELSE raw END AS c FROM f),
h AS (SELECT *, trim(substr(c, 1, 150), {WHITE}) AS head FROM g),
dig AS (SELECT id, title, trim(substr(c, 1, 100), {WHITE}) AS gist, CASE WHEN length(head) < 50 THEN 'From ' || source_title || '. Topics: a, b' WHEN ends_with(head, '.') THEN head ELSE head || '...' END AS why,
  CASE WHEN length(c) > 150 THEN head || '...' ELSE trim(c, {WHITE}) END AS bullet, floor(final * 10 + 0.5)::BIGINT AS relevance FROM h) """


def _digests(spark, d):
    marked = F.when(F.col("summary") == "", "").when(F.col("id") % 2 == 0, F.concat(F.lit('<p class="x">Lead &amp; &lt;more&gt;</p> '), "summary")).otherwise(F.col("summary"))
    rows = text_items(spark, d).withColumns({"summary": marked, "final": F.col("id") % 11 / 10.0, "tags": F.array(F.lit("a"), F.lit("b")), "url": F.lit("https://x.example/a")})
    return digests.fallback_digest(rows)


@query(DIGEST + "SELECT id, gist, why AS why_it_matters, bullet, relevance FROM dig", "items")
def digest_fallback(spark, d):
    return _digests(spark, d).select("id", "gist", "why_it_matters", F.get("key_bullets", F.lit(0)).alias("bullet"), "relevance")


@query(None)
def digest_extract(spark, d):
    """Exclusion, newsletters to articles, and digests in one."""
    pages = read(spark, d, "pages")
    n = pages.count()  # from the file footers
    rows = text_items(spark, d).join(pages.select("page_id", "url", "html"), F.col("id") % max(n, 1) == F.col("page_id")).drop("page_id")
    rows = rows.withColumns({"summary": F.when(F.col("id") % 2 == 0, F.col("html")).otherwise(F.col("summary")), "url": F.when(F.col("id") % 10 == 1, "https://reddit.com/r/x").otherwise(F.col("url")),
                             "bm25": F.lit(0.8), "final": F.col("id") % 11 / 10.0, "tags": F.array(F.lit("a"))}).drop("html")
    return digests.extract(rows, ["src"]).select("id", "title", "url", "gist", "relevance")


@query("""SELECT id, substr(CASE WHEN summary = '' THEN 'No summary available' ELSE summary END, 1, 100) AS one_sentence_gist, 'New content from ' || source_title AS what_changed,
  substr(title, 1, 60) AS soundbite, (id % 11)::BIGINT AS relevance_to_focus FROM items""", "items")
def podcast_digest_fallback(spark, d):
    rows = text_items(spark, d).withColumns({"final": F.col("id") % 11 / 10.0, "url": F.lit("")})
    return digests.podcast_digest(rows).select("id", "one_sentence_gist", "what_changed", F.col("soundbite_lines")[0].alias("soundbite"), "relevance_to_focus")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'https://arxiv.org/abs/2512.' || printf('%05d', doc_id % 100000) END AS url FROM documents")
def arxiv_url(spark, d):
    n = F.col("doc_id")
    code = F.concat(F.when(n % 3 == 0, "2025arXiv2512").otherwise("2025ApJ..2512"), F.lpad((n % 100000).cast("string"), 5, "0"), F.lit("Q"))
    return read(spark, d, "documents").select("doc_id", urls.arxiv_url(code, fixed=True).alias("url"))


#: Every text, after prose with words that reviews count, as few texts have any.
def _made_text():
    n = F.col("doc_id")
    return F.concat(
        F.when(n % 2 == 0, "This trend highlights a landscape. ").otherwise("We tested it. "), F.when(n % 3 == 0, "They delve, delve and explore. ").otherwise("Delves only. "),
        F.when(n % 5 == 0, "code search, code search, agents, agents and information retrieval. ").otherwise("search. "), F.when(n % 7 == 0, "Teams should explore it. ").otherwise("Done. "), "text")


MADE_TEXT = """WITH m AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'This trend highlights a landscape. ' ELSE 'We tested it. ' END || CASE WHEN doc_id % 3 = 0 THEN 'They delve, delve and explore. ' ELSE 'Delves only. ' END
 || CASE WHEN doc_id % 5 = 0 THEN 'code search, code search, agents, agents and information retrieval. ' ELSE 'search. ' END || CASE WHEN doc_id % 7 = 0 THEN 'Teams should explore it. ' ELSE 'Done. ' END || text AS t FROM documents) """

AI_WORDS_SQL = "['highlights', 'underscores', 'shapes', 'fosters', 'emerging', 'landscape', 'approaches', 'methodologies', 'ecosystem', 'leveraging', 'harnessing', 'delve', 'showcase', 'explore', 'unpack']"
INANIMATE_SQL = "regexp_matches(any_value(t), '(this|that|the|research|finding|trend|approach|method)\\s+(highlights|underscores|shapes|shows|demonstrates|indicates)', 'i')"
PREAMBLE_SQL = "regexp_matches(any_value(t), '^(This|The|Research|Studies?)\\s+(further|also)?\\s*(highlights|shows|demonstrates)', 'i')"


@query(MADE_TEXT + f""", w AS (SELECT unnest({AI_WORDS_SQL}) AS word), c AS (SELECT doc_id, t, word, len(regexp_extract_all(lower(t), '\\b' || word || '\\b')) AS n FROM m, w)
SELECT doc_id, sum(n)::BIGINT AS words, (count(*) FILTER (WHERE n > 0) + CASE WHEN {INANIMATE_SQL} THEN 1 ELSE 0 END + CASE WHEN {PREAMBLE_SQL} THEN 1 ELSE 0 END)::INTEGER AS issues FROM c GROUP BY doc_id""")
def ai_language_review(spark, d):
    words = F.size(text.found_words(F.lower("t"), config.AI_WORDS))
    rows = spread(read(spark, d, "documents")).select("doc_id", _made_text().alias("t"))
    return rows.select("doc_id", words.cast("long").alias("words"), F.size(text.ai_language_issues("t")).alias("issues"))


@query(MADE_TEXT + """, k AS (SELECT doc_id, t, len(regexp_extract_all(lower(t), 'code search|context management|agents|information retrieval')) AS n FROM m)
SELECT doc_id, concat_ws('; ', CASE WHEN n > 4 THEN 'Heavy keyword stuffing detected (' || n || ' keyword mentions)' END, CASE WHEN regexp_matches(t, 'teams (should|can|must) (evaluate|explore|understand)', 'i') THEN 'Generic corporate advice pattern' END) AS issues FROM k""")
def bias_review(spark, d):
    return spread(read(spark, d, "documents")).select("doc_id", F.array_join(text.bias_issues(_made_text()), "; ").alias("issues"))


#: Digests whose gist, reason and bullet hold whole texts, so that every text is reviewed.
REVIEW = MADE_TEXT + f""", x AS (SELECT m.doc_id, m.t, p.url AS u FROM m JOIN pages p ON p.page_id = m.doc_id % (SELECT count(*) FROM pages)),
w AS (SELECT k, word FROM (SELECT unnest({AI_WORDS_SQL}) AS word, generate_subscripts({AI_WORDS_SQL}, 1) AS k)),
c AS (SELECT x.doc_id, x.t, x.u, w.k, w.word, len(regexp_extract_all(lower(x.t), '\\b' || w.word || '\\b')) AS n FROM x, w),
lang AS (SELECT doc_id, any_value(t) AS t, any_value(u) AS u, concat_ws('; ', string_agg('Overused AI word: "' || word || '" (' || n || 'x)', '; ' ORDER BY k) FILTER (WHERE n > 0),
  CASE WHEN {INANIMATE_SQL} THEN 'Possible inanimate subject doing human action' END, CASE WHEN {PREAMBLE_SQL} THEN 'Corporate preamble pattern detected' END) AS ai FROM c GROUP BY doc_id),
bias AS (SELECT *, concat_ws('; ', CASE WHEN n > 4 THEN 'Heavy keyword stuffing detected (' || n || ' keyword mentions)' END, CASE WHEN regexp_matches(t, 'teams (should|can|must) (evaluate|explore|understand)', 'i') THEN 'Generic corporate advice pattern' END) AS bias
  FROM (SELECT *, len(regexp_extract_all(lower(t), 'code search|context management|agents|information retrieval')) AS n FROM lang)) """


@query(REVIEW + f"""SELECT doc_id, concat_ws(' | ', CASE WHEN {_rejects(config.BAD_URL)} THEN 'Bad URL domain/pattern: ' || u END, CASE WHEN ai <> '' THEN 'Gist has AI language: ' || ai END,
  CASE WHEN ai <> '' THEN 'Why It Matters has AI language: ' || ai END, CASE WHEN bias <> '' THEN 'Why It Matters: ' || bias END, CASE WHEN ai <> '' THEN 'Key bullet has AI language: ' || substr(t, 1, 50) || '...' END) AS issues FROM bias""")
def review_digests(spark, d):
    rows = with_urls(spread(read(spark, d, "documents")).select("doc_id", F.col("doc_id").alias("id"), _made_text().alias("t")), spark, d)
    rows = rows.select("doc_id", "url", F.col("t").alias("gist"), F.col("t").alias("why_it_matters"), F.array(F.lit("Fine."), F.col("t")).alias("key_bullets"))
    return digests.review(rows).select("doc_id", F.array_join("issues", " | ").alias("issues"))


PODCAST_WORDS = "(" + " OR ".join(f"contains(lower(g), '{w}')" for w in config.PODCAST_AI_WORDS) + ")"


@query(MADE_TEXT + f""", x AS (SELECT m.doc_id, m.t AS g, p.url AS u, m.doc_id % 10 AS r FROM m JOIN pages p ON p.page_id = m.doc_id % (SELECT count(*) FROM pages))
SELECT doc_id, concat_ws(' | ', CASE WHEN {_rejects(config.BAD_PODCAST_URL[:-1])} THEN 'Bad URL: ' || u END, CASE WHEN {PODCAST_WORDS} THEN 'Gist contains AI-style language' END, CASE WHEN doc_id % 4 = 0 THEN 'Takeaway contains AI-style language' END,
  CASE WHEN {PODCAST_WORDS} THEN 'Soundbite contains AI-style language' END, CASE WHEN r < 3 THEN 'Low relevance score: ' || r END) AS issues FROM x""")
def review_podcast(spark, d):
    """Words are looked for as substrings here, unlike in the review of digests."""
    rows = with_urls(spread(read(spark, d, "documents")).select("doc_id", F.col("doc_id").alias("id"), _made_text().alias("t")), spark, d)
    rows = rows.select("doc_id", "url", F.col("t").alias("one_sentence_gist"), F.when(F.col("doc_id") % 4 == 0, "Showcased").otherwise("Short").alias("one_line_takeaway"),
                       F.array(F.lit("Fine."), F.col("t")).alias("soundbite_lines"), (F.col("doc_id") % 10).alias("relevance_to_focus"))
    return digests.review_podcast(rows).select("doc_id", F.array_join("issues", " | ").alias("issues"))


def _script(spark, d):
    """A transcript of each conversation: labelled turns with cues, in order."""
    said = F.concat(F.when(F.col("role") == "user", "HOST: ").otherwise("COHOST: "), F.lit("[PAUSE] "), F.regexp_replace("text", "(?i)host", "guest"), F.lit(" (10s)"))
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))).alias("turns"))
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda t: t["said"]), "\n").alias("script"))


SCRIPT = """WITH s AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'HOST: ' ELSE 'COHOST: ' END || '[PAUSE] ' || regexp_replace(text, 'host', 'guest', 'gi') || ' (10s)', chr(10) ORDER BY turn) AS script FROM conversations GROUP BY conv_id),
c1 AS (SELECT conv_id, regexp_replace(regexp_replace(script, '\\[(INTRO MUSIC|OUTRO MUSIC|BACKGROUND MUSIC|MUSIC|PAUSE|SOUND EFFECT|APPLAUSE|LAUGHTER|NEEDS SUPPORT)\\]', '', 'gi'), '(cold open|lightning round|quick hits|intro segment|outro|main segment):?\\s*', '', 'gi') AS t FROM s),
c2 AS (SELECT conv_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '\\[[0-9:]+\\]\\s*', '', 'g'), '\\(≈?[0-9]+s\\)', '', 'g'), '(?m)^[A-Z]+:\\s*', '', 'g') AS t FROM c1),
clean AS (SELECT conv_id, trim(regexp_replace(t, '\\s{2,}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM c2) """


@query(SCRIPT + "SELECT conv_id, t FROM clean")
def sanitize_transcript(spark, d):
    return _script(spark, d).select("conv_id", text.sanitize_transcript("script").alias("t"))


@query(SCRIPT + "SELECT conv_id, 'sha256:' || sha256(t || '|voicebox|alto|mp3') AS hash FROM clean")
def transcript_hash(spark, d):
    return _script(spark, d).select("conv_id", text.transcript_hash("script", "voicebox", "alto", "mp3").alias("hash"))


@query(None)
def speaker_turns(spark, d):
    rows = _script(spark, d).select("conv_id", F.posexplode(chunks.speaker_turns()("script")).alias("n", "t"))
    return rows.select("conv_id", "n", F.col("t.speaker").alias("speaker"), F.length("t.text").alias("chars"))


@query(None)
def multi_voice_plan(spark, d):
    """Each speaker's turns in a transcript with a voice, and the seconds they take."""
    rows = _script(spark, d).select("conv_id", F.posexplode(chunks.speaker_turns()("script")).alias("n", "t"))
    rows = rows.select("conv_id", F.when(F.col("t.speaker") == "HOST", "alto").otherwise("bass").alias("voice"), text.duration_seconds("t.text").alias("secs"))
    return rows.groupBy("conv_id", "voice").agg(F.count(F.lit(1)).alias("turns"), F.sum("secs").alias("seconds"))


@query("SELECT doc_id, ceil(len(regexp_extract_all(text, '\\S+')) / 150.0::DOUBLE * 60)::BIGINT AS seconds FROM documents")
def duration_est(spark, d):
    return read(spark, d, "documents").select("doc_id", text.duration_seconds("text").alias("seconds"))


@query("SELECT doc_id, CASE WHEN n_chars >= 3600 THEN printf('%d:%02d:%02d', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) ELSE printf('%d:%02d', n_chars // 60, n_chars % 60) END AS t FROM documents")
def format_duration(spark, d):
    return read(spark, d, "documents").select("doc_id", text.format_duration("n_chars").alias("t"))


@query("SELECT doc_id, printf('%d:%02d', n_chars // 60, n_chars % 60) AS t FROM documents")
def format_mmss(spark, d):
    return read(spark, d, "documents").select("doc_id", text.format_mmss("n_chars").alias("t"))


@query("SELECT doc_id, regexp_replace(regexp_replace('**' || source || '** and *' || lang || '* ' || text, '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '\\*([^*]+)\\*', '\\1', 'g') AS t FROM documents")
def strip_formatting(spark, d):
    made = F.concat(F.lit("**"), "source", F.lit("** and *"), "lang", F.lit("* "), "text")
    return read(spark, d, "documents").select("doc_id", text.strip_formatting(made).alias("t"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'research' WHEN doc_id % 3 = 1 THEN 'ai_news' ELSE 'newsletters' END AS category FROM documents""")
def folder_to_category(spark, d):
    from feedloom.sources.items import categorize

    label = F.element_at(F.array(F.lit("Papers"), F.lit("AI"), F.lit("Other")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = read(spark, d, "documents").select("doc_id", F.array(F.lit("starred"), label).alias("categories"))
    return categorize(rows, {"Papers": "research", "AI": "ai_news"}).select("doc_id", "category")
