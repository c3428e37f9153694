"""The queries of the engine, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import pages, scores, text, urls
from newsloom.operators import analytics, classify, dedup, evaluate, existence, filters, graph, ingest, keywords, prepare, substring, topics, trends
from newsloom.plans.sql import KEYWORDS, NEWS, PREDICTIONS
from newsloom.session import materialize, scratch_path
from newsloom.sources import tables
from newsloom.sources.files import feed_items
from newsloom.streaming.ingest import event_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


DAY = "coalesce(published_at, crawled_at)::DATE"
JANUARY = filters.Filters(from_date="2024-01-05", to_date="2024-01-25", content_source="fulltext")
IN_JANUARY = f"content_source = 'fulltext' AND {DAY} BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'"
START, END = "2024-01-10 00:00:00", "2024-01-20 00:00:00"


# Descriptive analytics


@query(f"""WITH {NEWS} SELECT count(*) AS total_articles, count(DISTINCT category) AS total_categories, count(DISTINCT source) AS total_sources,
    count(*) FILTER (content_source = 'fulltext') AS fulltext_articles, count(*) FILTER (content_source = 'rss_fallback') AS rss_fallback_articles, max(crawled_at) AS latest_crawled_at FROM news""")
def analytics_summary(spark, sf_dir):
    return analytics.summary(tables.news(spark, sf_dir))


@query(f"""WITH {NEWS} SELECT count(*) AS total_articles, count(DISTINCT category) AS total_categories, count(DISTINCT source) AS total_sources,
    count(*) FILTER (content_source = 'fulltext') AS fulltext_articles, count(*) FILTER (content_source = 'rss_fallback') AS rss_fallback_articles, max(crawled_at) AS latest_crawled_at
    FROM news WHERE {IN_JANUARY}""")
def analytics_summary_filtered(spark, sf_dir):
    return analytics.summary(tables.news(spark, sf_dir), JANUARY)


@query(f"""WITH {NEWS} SELECT category, count(*) AS count, round_even(count(*) / sum(count(*)) OVER () * 100, 2) AS percentage FROM news GROUP BY category""")
def analytics_categories(spark, sf_dir):
    return analytics.categories(tables.news(spark, sf_dir))


@query(f"WITH {NEWS} SELECT {DAY} AS day, count(*) AS count FROM news WHERE {IN_JANUARY} GROUP BY 1")
def analytics_daily(spark, sf_dir):
    return analytics.daily(tables.news(spark, sf_dir), JANUARY)


@query(f"WITH {NEWS} SELECT source, count(*) AS count FROM news GROUP BY 1")
def analytics_sources(spark, sf_dir):
    return analytics.by_column(tables.news(spark, sf_dir), "source")


@query(f"WITH {NEWS} SELECT content_source, count(*) AS count FROM news WHERE category = 'en' GROUP BY 1")
def analytics_content_sources(spark, sf_dir):
    return analytics.by_column(tables.news(spark, sf_dir), "content_source", filters.Filters(category="en"))


@query(f"WITH {NEWS} SELECT {DAY} AS day, category, count(*) AS count FROM news GROUP BY 1, 2")
def analytics_daily_categories(spark, sf_dir):
    return analytics.daily_categories(tables.news(spark, sf_dir))


@query(f"""WITH {NEWS} SELECT {DAY} AS day, count(*) FILTER (category = 'de') AS de, count(*) FILTER (category = 'en') AS en, count(*) FILTER (category = 'es') AS es,
    count(*) FILTER (category = 'fr') AS fr, count(*) AS total FROM news GROUP BY 1""")
def analytics_trend_by_category(spark, sf_dir):
    return analytics.trend_table(analytics.trend_by_category(tables.news(spark, sf_dir)), ["de", "en", "es", "fr"])


RECENT = "id, title, url, source, category, content_source, decision_score, published_at, crawled_at"


@query(f"WITH {NEWS} SELECT {RECENT} FROM news ORDER BY coalesce(published_at, crawled_at) DESC, id LIMIT 20")
def analytics_recent(spark, sf_dir):
    return analytics.recent(tables.news(spark, sf_dir))


@query(f"WITH {NEWS} SELECT category, count(*) AS count FROM news WHERE published_at >= TIMESTAMP '{START}' AND published_at < TIMESTAMP '{END}' GROUP BY 1")
def category_counts_range(spark, sf_dir):
    return analytics.category_counts(tables.news(spark, sf_dir), START, END)


@query(f"WITH {NEWS} SELECT id, published_at, crawled_at FROM news WHERE category = 'en' ORDER BY published_at DESC NULLS LAST, crawled_at DESC, id DESC LIMIT 20 OFFSET 5")
def latest_news(spark, sf_dir):
    return analytics.latest(tables.news(spark, sf_dir), "en", 20, 5).select("id", "published_at", "crawled_at")


@query(f"WITH {NEWS} SELECT id, published_at FROM news WHERE published_at >= TIMESTAMP '{START}' AND published_at < TIMESTAMP '{END}'")
def news_range(spark, sf_dir):
    return analytics.published(tables.news(spark, sf_dir), START, END).select("id", "published_at")


@query(f"WITH {NEWS} SELECT id, crawled_at FROM news ORDER BY crawled_at DESC, id DESC LIMIT 25 OFFSET 50")
def news_page(spark, sf_dir):
    return analytics.page(tables.news(spark, sf_dir), 25, 50).select("id", "crawled_at")


@query(f"""WITH {NEWS} SELECT id, title FROM news WHERE source = 'src3' AND contains(lower(concat_ws(chr(10), title, category, source)), 'en')
    ORDER BY coalesce(published_at, crawled_at) DESC, id LIMIT 10 OFFSET 10""")
def client_search(spark, sf_dir):
    return analytics.search(tables.news(spark, sf_dir), " EN ", 2, source="src3").select("id", "title")


@query(f"""WITH {NEWS}, r AS (SELECT * FROM news ORDER BY coalesce(published_at, crawled_at) DESC, id LIMIT 30)
    SELECT id FROM r WHERE contains(lower(concat_ws(chr(10), title, category, source)), 'src1') ORDER BY coalesce(published_at, crawled_at) DESC, id LIMIT 10""")
def client_explore(spark, sf_dir):
    return analytics.explore(tables.news(spark, sf_dir), "src1").select("id")


@query(f"WITH {NEWS} SELECT id, url FROM news WHERE url = 'https://news.example/src5/105'")
def news_lookup(spark, sf_dir):
    return analytics.lookup(tables.news(spark, sf_dir), "url", "https://news.example/src5/105").select("id", "url")


@query(f"WITH {NEWS} SELECT id FROM news WHERE published_at IS NOT NULL AND published_at::DATE <= DATE '2024-01-12'")
def crawl_date_filter(spark, sf_dir):
    return tables.news(spark, sf_dir).where(filters.in_crawl_range(F.col("published_at").cast("date"), None, "2024-01-12")).select("id")


@query(f"WITH {NEWS} SELECT id, row_number() OVER (ORDER BY published_at DESC NULLS LAST, id DESC) AS position FROM news QUALIFY position <= 50")
def keyword_processing_order(spark, sf_dir):
    first = tables.news(spark, sf_dir).orderBy(F.desc_nulls_last("published_at"), F.desc("id")).limit(50)
    from pyspark.sql import Window

    return first.select("id", F.row_number().over(Window.orderBy(F.desc_nulls_last("published_at"), F.desc("id"))).cast("long").alias("position"))


@query("SELECT 1 AS ok")
def health_probe(spark, sf_dir):
    return analytics.health(tables.news(spark, sf_dir))


# Keywords and trends


def views(spark, sf_dir):
    return tables.keyword_occurrences(spark, sf_dir), tables.news(spark, sf_dir)


ROLL_UP = """SELECT keyword, max(display_keyword) AS display_keyword, count(DISTINCT news_id) AS article_count, sum(frequency)::BIGINT AS total_frequency,
    round(sum(final_score::DECIMAL(38,9))::DOUBLE, 6) AS total_score FROM keyword_occurrences k JOIN news n ON n.id = k.news_id WHERE published_at IS NOT NULL {more}
    GROUP BY keyword HAVING count(DISTINCT news_id) >= {least} ORDER BY article_count DESC, total_frequency DESC, sum(final_score::DECIMAL(38,9)) DESC, keyword LIMIT {limit}"""


@query(f"WITH {NEWS}, {KEYWORDS} " + ROLL_UP.format(more="", least=2, limit=50))
def keywords_rollup(spark, sf_dir):
    return trends.roll_up(*views(spark, sf_dir), min_articles=2, limit=50).withColumn("total_score", F.round("total_score", 6))


@query(f"WITH {NEWS}, {KEYWORDS} " + ROLL_UP.format(more="AND keyword ILIKE '%en%' AND category = 'en'", least=1, limit=20))
def keyword_search(spark, sf_dir):
    return trends.roll_up(*views(spark, sf_dir), filters.Filters(category="en"), "en").withColumn("total_score", F.round("total_score", 6))


@query(f"WITH {NEWS}, {KEYWORDS} " + ROLL_UP.format(more="AND keyword ILIKE '%ent%'", least=1, limit=100))
def keyword_search_indexed(spark, sf_dir):
    """keyword_search by the trigrams of the keywords."""
    k, n = views(spark, sf_dir)
    found = substring.search(k, "keyword", "%ent%", substring.build(k, "keyword"))
    return trends.roll_up(found, n, limit=100).withColumn("total_score", F.round("total_score", 6))


@query(f"WITH {NEWS} SELECT id, title FROM news WHERE title ILIKE '%ation%'")
def title_search_indexed(spark, sf_dir):
    n = tables.news(spark, sf_dir)
    return substring.search(n, "title", "%ation%", substring.build(n, "title")).select("id", "title")


BASE = f"""base AS (
    SELECT k.keyword, max(display_keyword) AS display_keyword, k.news_id, k.frequency, k.final_score, {DAY} AS article_day
    FROM keyword_occurrences k JOIN news n ON n.id = k.news_id GROUP BY ALL)"""


@query(f"WITH {NEWS}, {KEYWORDS}, {BASE} SELECT * FROM base")
def trend_base(spark, sf_dir):
    return trends.base(*views(spark, sf_dir))


TREND = f"""{NEWS}, {KEYWORDS}, {BASE}, bounds AS (SELECT max(article_day) AS anchor_day FROM base), agg AS (
    SELECT keyword, max(display_keyword) AS display_keyword, count(DISTINCT news_id) AS total_articles, sum(frequency)::BIGINT AS total_frequency,
           sum(final_score::DECIMAL(38,9))::DOUBLE AS keyword_strength,
           count(DISTINCT CASE WHEN article_day >= anchor_day - 2 THEN news_id END) AS recent_articles,
           count(DISTINCT CASE WHEN article_day < anchor_day - 2 AND article_day >= anchor_day - 5 THEN news_id END) AS previous_articles,
           max(date_diff('day', article_day, anchor_day))::BIGINT AS age_days, max(anchor_day) AS anchor_day
    FROM base, bounds GROUP BY keyword HAVING count(DISTINCT news_id) >= 2
), parts AS (
    SELECT *, CASE WHEN keyword_strength <= 0 THEN 0 ELSE least(1, ln(1 + keyword_strength) / ln(1 + max(keyword_strength) OVER ())) END AS strength_score,
           1 - exp(-greatest(0::DOUBLE, ln(1 + recent_articles::DOUBLE) - ln(1 + previous_articles::DOUBLE))) AS momentum_score,
           exp(-greatest(age_days, 0)::DOUBLE / 3) AS recency_score,
           CASE WHEN previous_articles > 0 THEN (recent_articles - previous_articles)::DOUBLE / previous_articles * 100 END AS growth_percent
    FROM agg
), scored AS (
    SELECT *, 0.45::DOUBLE * strength_score + 0.35::DOUBLE * momentum_score + 0.20::DOUBLE * recency_score AS trend_score FROM parts)"""
TREND_COLUMNS = """keyword, display_keyword, total_articles, total_frequency, round(keyword_strength, 6) AS keyword_strength, recent_articles, previous_articles, age_days,
    anchor_day, round(strength_score, 6) AS strength_score, round(momentum_score, 6) AS momentum_score, round(recency_score, 6) AS recency_score,
    round(growth_percent, 6) AS growth_percent, round(trend_score, 6) AS trend_score"""


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def rounded_rows(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """rounded() for many rows, without a decimal number for each: halves go away from 0, of the value times 10 to the places as DuckDB has it. Values are no NaN and below 10^12."""
    scale = 10.0**places
    return df.withColumns({n: F.when(F.col(n) < 0, -F.floor(0.5 - F.col(n) * scale)).otherwise(F.floor(F.col(n) * scale + 0.5)).cast("double") / scale for n in names})


def tidy_trends(df: DataFrame) -> DataFrame:
    return rounded(df.drop("growth_label"), "keyword_strength", "strength_score", "momentum_score", "recency_score", "growth_percent", "trend_score")


@query(f"WITH {TREND} SELECT {TREND_COLUMNS} FROM scored")
def trends_all(spark, sf_dir):
    return tidy_trends(trends.trends(*views(spark, sf_dir)))


SEARCHED = TREND.replace("n.id = k.news_id GROUP BY ALL", "n.id = k.news_id WHERE lower(k.keyword) LIKE '%en_a%' GROUP BY ALL")


@query(f"WITH {SEARCHED} SELECT {TREND_COLUMNS} FROM scored")
def trend_search(spark, sf_dir):
    return tidy_trends(trends.trends(*views(spark, sf_dir), keyword="EN_a"))


def flagship(spark, sf_dir):
    return tidy_trends(trends.top_trends(trends.trends(*views(spark, sf_dir)), 50))


QUERIES["trends"] = flagship
SQL["trends"] = f"WITH {TREND} SELECT {TREND_COLUMNS} FROM scored ORDER BY scored.trend_score DESC, recent_articles DESC, total_articles DESC, scored.keyword_strength DESC, keyword LIMIT 50"


# A printed half is rounded away from 0, as the engine's formatter does.
@query(f"""WITH {TREND} SELECT keyword, recent_articles, previous_articles,
    CASE WHEN previous_articles = 0 THEN 'NEW' ELSE printf('%+.1f%%', round((recent_articles - previous_articles)::DOUBLE / previous_articles * 100, 1)) END AS growth_label FROM scored""")
def growth_labels(spark, sf_dir):
    return trends.trends(*views(spark, sf_dir)).select("keyword", "recent_articles", "previous_articles", "growth_label")


EDGES = f"""{TREND}, rel AS (
    SELECT DISTINCT k.keyword, k.news_id FROM keyword_occurrences k JOIN news n ON n.id = k.news_id JOIN scored USING (keyword) WHERE published_at IS NOT NULL
), sizes AS (SELECT keyword, count(*) AS size FROM rel GROUP BY 1), pairs AS (
    SELECT a.keyword AS l, b.keyword AS r, count(*) AS overlap FROM rel a JOIN rel b ON a.news_id = b.news_id AND a.keyword < b.keyword GROUP BY 1, 2 HAVING count(*) >= 2
), edges AS (
    SELECT l, r, overlap, overlap::DOUBLE / (x.size + y.size - overlap) AS jaccard FROM pairs JOIN sizes x ON x.keyword = l JOIN sizes y ON y.keyword = r
    WHERE overlap::DOUBLE / (x.size + y.size - overlap) >= 0.20::DOUBLE)"""


def edge_table(spark, sf_dir):
    k, n = views(spark, sf_dir)
    return topics.edges(topics.relations(k, n, trends.trends(k, n)))


@query(f'WITH {EDGES} SELECT l AS "left", r AS "right", overlap, round(jaccard, 9) AS jaccard FROM edges')
def topic_edges(spark, sf_dir):
    return rounded(edge_table(spark, sf_dir), "jaccard", places=9)


COMPONENTS = EDGES + """, both_ways AS (SELECT l AS a, r AS b FROM edges UNION SELECT r, l FROM edges), reach AS (
    SELECT a AS node, a AS other FROM both_ways UNION SELECT reach.node, b FROM reach JOIN both_ways ON a = other
), comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""


@query(f"WITH RECURSIVE {COMPONENTS} SELECT * FROM comp")
def topic_components(spark, sf_dir):
    return graph.connected_components(edge_table(spark, sf_dir))


@query(f"""WITH RECURSIVE {COMPONENTS}, topics AS (
        SELECT first(display_keyword ORDER BY trend_score DESC, total_articles DESC, keyword) AS label, string_agg(keyword, '|' ORDER BY trend_score DESC, total_articles DESC, keyword) AS keywords,
               count(*) AS keyword_count, max(trend_score) AS max_trend_score, avg(trend_score) AS topic_strength, max(total_articles) AS article_volume
        FROM comp JOIN scored ON node = keyword GROUP BY component HAVING count(*) >= 2)
    SELECT label, keywords, keyword_count, round(max_trend_score, 6) AS max_trend_score, round(topic_strength, 6) AS topic_strength, article_volume FROM topics
    ORDER BY round(topics.topic_strength, 12) DESC, keyword_count DESC, article_volume DESC, label LIMIT 10""")
def hot_topics(spark, sf_dir):
    found = topics.hot_topics(*views(spark, sf_dir)).withColumn("keywords", F.array_join("keywords", "|"))
    return rounded(found, "max_trend_score", "topic_strength")


@query(f"WITH {NEWS}, {KEYWORDS} SELECT count(*) AS rows, count(DISTINCT news_id) AS articles FROM keyword_occurrences")
def keyword_stored_counts(spark, sf_dir):
    return keywords.stored_counts(tables.keyword_occurrences(spark, sf_dir))


@query(f"""WITH {KEYWORDS}, new AS (SELECT news_id, keyword, frequency + 1 AS frequency FROM keyword_occurrences WHERE news_id % 3 = 0 UNION ALL SELECT news_id + 1000000, keyword, frequency FROM keyword_occurrences WHERE news_id % 5 = 0)
    SELECT news_id, keyword, frequency FROM new UNION ALL SELECT news_id, keyword, frequency FROM keyword_occurrences k ANTI JOIN new USING (news_id, keyword)""")
def keyword_upsert(spark, sf_dir):
    k = tables.keyword_occurrences(spark, sf_dir).select("news_id", "keyword", "frequency")
    changed = k.where("news_id % 3 = 0").withColumn("frequency", F.col("frequency") + 1)
    added = k.where("news_id % 5 = 0").withColumn("news_id", F.col("news_id") + 1000000)
    first = changed.withColumn("frequency", F.lit(0).cast("long")).withColumn("at", F.lit(1))
    return dedup.upsert(k, first.unionByName(changed.unionByName(added).withColumn("at", F.lit(2))), ["news_id", "keyword"], "at")


# Keyword extraction

FULL = "regexp_matches(text, '[^\\s\\p{Z}]')"
WORDS = rf"w AS (SELECT doc_id AS id, regexp_extract_all(translate(text, '_' || chr(160), '  '), '[\p{{L}}\p{{N}}_]+(?:[./:&+#-][\p{{L}}\p{{N}}_]+)*') AS w FROM documents WHERE {FULL})"
AS_WRITTEN = rf"w AS (SELECT doc_id AS id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+(?:[./:&+#-][\p{{L}}\p{{N}}_]+)*') AS w FROM documents WHERE {FULL})"
EACH_GRAM = """, pos AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM w), g AS (
    SELECT id, n, i - 1 AS pos, list_slice(w, i, i + n - 1) AS raw FROM pos, (SELECT unnest([1, 2, 3, 4, 5]) AS n) WHERE i + n - 1 <= len(w))"""
GRAMS = WORDS + EACH_GRAM


def as_docs(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.substring_index("text", ".", 1).alias("title"))


@query(f"WITH {WORDS} SELECT lower(t) AS token, count(*) AS count FROM (SELECT unnest(w) AS t FROM w) GROUP BY 1")
def tokenize_counts(spark, sf_dir):
    return as_docs(spark, sf_dir).select(F.explode(text.tokens(F.col("text"))).alias("t")).groupBy(F.lower("t").alias("token")).agg(F.count("*").alias("count"))


@query(f"WITH {GRAMS} SELECT n, lower(array_to_string(raw, ' ')) AS gram, count(*) AS count FROM g GROUP BY 1, 2")
def ngram_counts(spark, sf_dir):
    return keywords.ngram_counts(as_docs(spark, sf_dir))


@query(f"WITH {WORDS} SELECT count(*) AS documents, sum(len(w))::BIGINT AS tokens, " + ", ".join(f"greatest(sum(len(w)) - {k - 1} * count(*), 0)::BIGINT AS total_{k}" for k in range(2, 6)) + " FROM w")
def ngram_totals(spark, sf_dir):
    return keywords.totals(as_docs(spark, sf_dir))


@query(f"WITH {AS_WRITTEN} {EACH_GRAM} SELECT array_to_string(raw, ' ') AS gram, count(DISTINCT id) AS df FROM g GROUP BY 1")
def doc_frequency(spark, sf_dir):
    return keywords.document_frequency(as_docs(spark, sf_dir))


TFIDF = AS_WRITTEN + EACH_GRAM + """, tf AS (SELECT id, array_to_string(raw, ' ') AS gram, count(*) AS tf FROM g GROUP BY 1, 2),
    df AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1), weights AS (
    SELECT id, gram, tf, (1 + ln(tf::DOUBLE)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS x FROM tf JOIN df USING (gram), (SELECT count(*) AS n FROM w) WHERE df <= floor(0.9 * n))"""


@query(f"WITH {TFIDF} SELECT id, gram, tf, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS tfidf FROM weights")
def tfidf(spark, sf_dir):
    return rounded_rows(keywords.tfidf(as_docs(spark, sf_dir)), "tfidf")


PMI = GRAMS + """, c AS (SELECT n, lower(array_to_string(raw, ' ')) AS gram, count(*) AS c FROM g GROUP BY 1, 2), t AS (SELECT sum(len(w)) AS tokens, count(*) AS docs FROM w),
    x AS (SELECT b.n, b.gram, b.c, unnest(string_split(b.gram, ' ')) AS word FROM c b WHERE b.n > 1),
    y AS (SELECT x.n, x.gram, any_value(x.c) AS c, sum(log2(u.c::DOUBLE)) AS parts FROM x JOIN c u ON u.n = 1 AND u.gram = x.word GROUP BY 1, 2)"""


@query(f"""WITH {PMI} SELECT gram, n, c AS count, round(log2(c::DOUBLE) - log2(greatest(tokens - (n - 1) * docs, 1)::DOUBLE) - parts + n * log2(tokens::DOUBLE), 6) AS pmi FROM y, t""")
def pmi(spark, sf_dir):
    return rounded_rows(keywords.phrase_pmi(as_docs(spark, sf_dir)), "pmi")


STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"


# Each token's properties once, and those of n-grams from slices of them.
CANDIDATES = rf"""{WORDS}, t AS (
    SELECT id, w, list_transform(w, lambda t: list_contains({STOP}, lower(t))) AS stop, list_transform(w, lambda t: regexp_matches(t, '\p{{L}}')) AS letter,
           list_transform(w, lambda t: regexp_full_match(replace(replace(t, '.', ''), ',', ''), '\p{{Nd}}+')::INT) AS num,
           list_transform(w, lambda t: length(t) <= 2 AND NOT (regexp_matches(t, '\p{{L}}') AND (regexp_matches(t, '\p{{Nd}}') OR regexp_matches(t, '^\p{{Lu}}')))) AS short FROM w
), pos AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM t), ok AS (
    SELECT id, n, i - 1 AS pos, array_to_string(list_slice(w, i, i + n - 1), ' ') AS raw FROM pos, (SELECT unnest([1, 2, 3, 4, 5]) AS n)
    WHERE i + n - 1 <= len(w) AND NOT stop[i] AND NOT stop[i + n - 1] AND NOT (n = 1 AND short[i]) AND list_bool_or(list_slice(letter, i, i + n - 1)) AND list_sum(list_slice(num, i, i + n - 1)) <= 1)"""


@query(f"WITH {CANDIDATES} SELECT id, lower(raw) AS key, n, count(*) AS freq, arg_min(raw, pos) AS display FROM ok GROUP BY 1, 2, 3")
def keyword_candidates(spark, sf_dir):
    return keywords.candidates(as_docs(spark, sf_dir)).drop("entity_like")


ENTITY = r"(regexp_matches(t, '\p{L}') AND (regexp_matches(t, '\p{Nd}') OR regexp_matches(t, '^\p{Lu}')))"
SCORES = rf"""cand AS (WITH {CANDIDATES} SELECT id, lower(raw) AS key, n, count(*) AS freq, arg_min(raw, pos) AS display FROM ok GROUP BY 1, 2, 3),
    feat AS (WITH {TFIDF} SELECT id, gram AS key, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS tfidf FROM weights),
    assoc AS (WITH {PMI} SELECT gram AS key, n, c, greatest(tokens - (n - 1) * docs, 1)::DOUBLE AS total, log2(c::DOUBLE) - log2(greatest(tokens - (n - 1) * docs, 1)::DOUBLE) - parts + n * log2(tokens::DOUBLE) AS pmi FROM y, t),
    head AS (WITH {WORDS.replace("(text, '_'", "(split_part(text, '.', 1), '_'")} SELECT id, ' ' || lower(array_to_string(w, ' ')) || ' ' AS title FROM w),
    parts AS (
        SELECT c.id, c.key, c.n, c.freq, c.display, tfidf, coalesce(pmi, 0) AS pmi,
               CASE WHEN c.n = 1 THEN 1 ELSE greatest(0.76::DOUBLE, least(1.24::DOUBLE, 1 + 0.24::DOUBLE * tanh(2 * greatest(-1::DOUBLE, least(1::DOUBLE, pmi / greatest(-log2(greatest(a.c / total, 1e-12)), 1e-9))))
                    * least(1::DOUBLE, sqrt(a.c / 3::DOUBLE)))) END AS association_boost,
               len(list_filter(string_split(c.key, ' ')[2:c.n - 1], lambda w: list_contains({STOP}, w))) AS inner_stop,
               list_bool_and(list_transform(string_split(c.display, ' '), lambda t: {ENTITY})) AS entity,
               CASE WHEN contains(title, ' ' || c.key || ' ') THEN 1.25::DOUBLE ELSE 1 END AS title_boost
        FROM cand c JOIN feat USING (id, key) LEFT JOIN assoc a ON a.key = c.key AND a.n = c.n JOIN head USING (id)
    ), q AS (
        SELECT *, greatest(0.45::DOUBLE, least(1.20::DOUBLE, CASE WHEN inner_stop > 0 THEN greatest(0.78::DOUBLE, 1 - 0.07::DOUBLE * inner_stop) ELSE 1 END
               * CASE n WHEN 2 THEN 1.02::DOUBLE WHEN 3 THEN 1.04::DOUBLE WHEN 4 THEN 1.05::DOUBLE WHEN 5 THEN 1.06::DOUBLE ELSE 1 END * CASE WHEN entity THEN 1.06::DOUBLE ELSE 1 END)) AS phrase_quality,
               least(1.24::DOUBLE, 1 + 0.08::DOUBLE * ln(1 + freq::DOUBLE)) AS frequency_boost
        FROM parts)"""


@query(f"""WITH {SCORES} SELECT id, key, n, freq, display, round(tfidf, 6) AS tfidf, round(pmi, 6) AS pmi, round(association_boost, 6) AS association_boost, round(phrase_quality, 6) AS phrase_quality,
    round(tfidf * CASE n WHEN 1 THEN 0.55::DOUBLE WHEN 3 THEN 1.06::DOUBLE WHEN 4 THEN 1.12::DOUBLE WHEN 5 THEN 1.15::DOUBLE ELSE 1 END * association_boost * phrase_quality * frequency_boost * title_boost, 6) AS score FROM q""")
def keyword_scores(spark, sf_dir):
    s = keywords.scored(as_docs(spark, sf_dir)).select("id", "key", "n", "freq", "display", "tfidf", "pmi", "association_boost", "phrase_quality", "score")
    return rounded_rows(s, "tfidf", "pmi", "association_boost", "phrase_quality", "score")


@query()
def keyword_extract(spark, sf_dir):
    return rounded(keywords.extract(as_docs(spark, sf_dir)), "tfidf", "score", "pmi")


@query()
def keyword_persist(spark, sf_dir):
    return rounded(keywords.occurrences(keywords.extract(as_docs(spark, sf_dir))), "tfidf", "association", "final_score")


# Text, addresses and duplicates


@query(rf"""WITH {NEWS} SELECT id, sha256(regexp_replace(coalesce(title, ''), '^\s+|\s+$', '', 'g') || chr(10) || regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g')) AS content_hash FROM news""")
def content_hash(spark, sf_dir):
    return tables.news(spark, sf_dir).select("id", urls.content_hash(F.col("title"), F.col("content")).alias("content_hash"))


URL = r"""(SELECT page_id, CASE WHEN ends_with(whole, '/') AND length(whole) > length(regexp_extract(base, '^([a-z][a-z0-9+.-]*://[^/?]*/?)', 1)) THEN rtrim(whole, '/') ELSE whole END AS url FROM (
    SELECT page_id, base, base || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS whole FROM (
        SELECT page_id, split_part(u, '?', 1) AS base, list_transform(list_filter(string_split(CASE WHEN contains(u, '?') THEN u[strpos(u, '?') + 1:] ELSE '' END, '&'),
            lambda p: p <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND NOT list_contains(['fbclid', 'gclid', 'ref', 'redirect', 'source', 'rss', 'from', 'zarsrc', 'catename'], lower(split_part(p, '=', 1)))),
            lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END) AS kept
        FROM (SELECT page_id, split_part(trim(url), '#', 1) AS u FROM pages))))"""


@query(f"SELECT * FROM {URL}")
def url_normalize(spark, sf_dir):
    return tables.read(spark, sf_dir, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("url"))


@query(f"SELECT url, min(page_id) AS page_id, count(*) AS pages FROM {URL} GROUP BY url")
def url_dedup(spark, sf_dir):
    p = url_normalize(spark, sf_dir)
    kept = dedup.keep_first(p, ["url"], [F.col("page_id")])
    return kept.join(p.groupBy("url").agg(F.count("*").alias("pages")), "url")


@query(r"""WITH d AS (SELECT doc_id AS pos, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'u' || (doc_id % 700) END AS url, text AS clean_text FROM documents),
    a AS (SELECT * FROM d WHERE url = '' UNION ALL (SELECT * FROM d WHERE url <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1))
    SELECT pos, url FROM a QUALIFY row_number() OVER (PARTITION BY clean_text ORDER BY url = '', pos) = 1""")
def dedup_first(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.expr("CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('u', doc_id % 700) END").alias("url"), F.col("text").alias("clean_text"))
    return dedup.deduplicate(d).select("pos", "url")


# Row by row: each step of the recursion inserts the next row into the lists of what is stored.
@query(r"""WITH RECURSIVE d AS (SELECT doc_id AS pos, 'u' || (doc_id * 3 % 800) AS url, sha256(text) AS hash FROM documents),
    b AS (SELECT *, row_number() OVER (ORDER BY pos) AS n FROM d WHERE pos % 4 <> 0), w AS (
    SELECT 0::BIGINT AS n, NULL::BIGINT AS pos, '' AS status, (SELECT list(url) FROM d WHERE pos % 4 = 0) AS urls, (SELECT list(hash) FROM d WHERE pos % 4 = 0) AS hashes
    UNION ALL
    SELECT n, pos, status, CASE status WHEN 'CREATED' THEN list_append(urls, url) ELSE urls END, CASE status WHEN 'CREATED' THEN list_append(hashes, hash) ELSE hashes END
    FROM (SELECT b.*, urls, hashes, CASE WHEN list_contains(urls, url) THEN 'DUPLICATE_URL' WHEN list_contains(hashes, hash) THEN 'DUPLICATE_CONTENT' ELSE 'CREATED' END AS status
          FROM w JOIN b ON b.n = w.n + 1))
    SELECT pos, status FROM w WHERE n > 0""")
def insert_status(spark, sf_dir):
    d = arrivals(spark, sf_dir)
    return dedup.insert_status(d.where("pos % 4 <> 0"), d.where("pos % 4 = 0")).select("pos", "status")


def arrivals(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.expr("concat('u', doc_id * 3 % 800)").alias("url"), F.sha2("text", 256).alias("content_hash"))


def stored_arrivals(spark, sf_dir):
    """The existence index of every fourth document, stored in two batches."""
    root, d = scratch_path(spark, "existence"), arrivals(spark, sf_dir)
    for number in (0, 1):
        existence.append(d.where(F.col("pos") % 8 == 4 * number), root, number)
    return root


@query(SQL["insert_status"])
def insert_status_indexed(spark, sf_dir):
    """insert_status by the existence index."""
    d = arrivals(spark, sf_dir).where("pos % 4 <> 0")
    return dedup.insert_status(d, existence.known(d, stored_arrivals(spark, sf_dir))).select("pos", "status")


@query("""WITH d AS (SELECT doc_id AS pos, 'u' || (doc_id * 3 % 800) AS url, sha256(text) AS hash FROM documents)
    SELECT pos, url IN (SELECT url FROM d WHERE pos % 4 = 0) AS known_url, hash IN (SELECT hash FROM d WHERE pos % 4 = 0) AS known_content FROM d""")
def known_articles(spark, sf_dir):
    """Whether the address and the content of each article are stored, by the existence index."""
    d = arrivals(spark, sf_dir)
    have = existence.known(d, stored_arrivals(spark, sf_dir))
    for c, name in (("url", "known_url"), ("content_hash", "known_content")):
        d = d.join(have[c].withColumn(name, F.lit(True)), c, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return d.select("pos", "known_url", "known_content")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_existing(spark, sf_dir):
    return dedup.not_existing(tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", "source")


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[\s\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x0B]+', ' ', 'g')) AS clean FROM documents""")
def clean_whitespace(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", text.collapse(text.remove_control(F.col("text"))).alias("clean"))


@query()
def clean_html(spark, sf_dir):
    return tables.read(spark, sf_dir, "pages").select("page_id", text.clean_text(F.col("html")).alias("clean_text"))


@query(rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(translate(text, '_' || chr(160), '  ')), '[\p{{L}}\p{{N}}_]+(?:[./:&+#-][\p{{L}}\p{{N}}_]+)*') AS w FROM documents)
    SELECT doc_id, array_to_string(list_filter(w, lambda t: NOT list_contains({STOP}, t)), ' ') AS model_text FROM w""")
def model_preprocess(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", F.array_join(text.model_tokens(F.col("text")), " ").alias("model_text"))


@query()
def page_extract(spark, sf_dir):
    p = tables.read(spark, sf_dir, "pages")
    a = pages.article_extractor(["article", *pages.CONTENT], 100)("html")
    return p.select("page_id", a.alias("a")).select("page_id", "a.title", F.length("a.content").alias("chars"), F.sha2("a.content", 256).alias("content_sha256"), "a.error")


@query("""SELECT page_id, regexp_replace(url, '[?#].*', '') AS url, 'item ' || page_id AS title, TIMESTAMP '2024-01-02 03:04:05' - INTERVAL 1 HOUR AS published_at FROM pages""")
def rss_items(spark, sf_dir):
    p = tables.read(spark, sf_dir, "pages")
    item = F.concat(F.lit("<rss><channel><item><title>item &amp;lt;b&amp;gt;"), F.col("page_id").cast("string"), F.lit("&lt;/b&gt;</title><link> "), F.regexp_replace("url", "[?#].*", ""), F.lit(" </link><pubDate>Tue, 02 Jan 2024 03:04:05 +0100</pubDate></item></channel></rss>"))
    items = feed_items(p.select(item.alias("data")), "feed")
    return items.select(F.regexp_extract("title", r"(\d+)", 1).cast("long").alias("page_id"), "url", "title", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*', '') AS url FROM pages)
    SELECT count(*) AS total, count(*) FILTER (s = 'CREATED') AS created, count(*) FILTER (s = 'DUPLICATE_URL') AS duplicate_url, 0::BIGINT AS duplicate_content, count(*) FILTER (page_id % 2 = 0) AS fulltext, count(*) FILTER (page_id % 2 = 1) AS rss_fallback
    FROM (SELECT page_id, CASE WHEN row_number() OVER (PARTITION BY url ORDER BY page_id) = 1 THEN 'CREATED' ELSE 'DUPLICATE_URL' END AS s FROM p)""")
def crawl_stats(spark, sf_dir):
    p = tables.read(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), F.regexp_replace("url", "[?#].*", "").alias("url"), F.col("page_id").cast("string").alias("title"), F.lit("").alias("content"))
    p = ingest.resolve_content(p, F.when(F.col("pos") % 2 == 0, F.lit("full text")))
    none = spark.createDataFrame([], "url string, content_hash string")
    return ingest.crawl_stats(ingest.decide(p, none))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*', '') AS url FROM pages), q AS (SELECT *, page_id % 11 = 0 AS late, page_id % 7 = 0 AS skipped, page_id % 2 = 0 AS whole FROM p),
    f AS (SELECT *, CASE WHEN late THEN 'DATE' WHEN skipped THEN 'SKIPPED' WHEN row_number() OVER (PARTITION BY url, late OR skipped ORDER BY page_id) = 1 THEN 'CREATED' ELSE 'DUPLICATE_URL' END AS fate FROM q)
    SELECT 5::BIGINT AS feeds_total, 4::BIGINT AS feeds_success, 1::BIGINT AS feeds_failed, count(*) AS articles_parsed, count(*) FILTER (late) AS articles_date_filtered, count(*) FILTER (fate = 'SKIPPED') AS articles_skipped,
           count(*) FILTER (fate = 'DUPLICATE_URL') AS articles_duplicate, count(*) FILTER (NOT late) AS articles_predicted, count(*) FILTER (fate = 'CREATED') AS articles_created,
           count(*) FILTER (NOT late AND whole) AS articles_fulltext_fetched, count(*) FILTER (NOT late AND NOT whole) AS articles_fulltext_fallback FROM f""")
def crawl_counters(spark, sf_dir):
    return ingest.crawl_counters(*crawled(spark, sf_dir))


def crawled(spark, sf_dir):
    """Feeds, and pages as what a crawl finds in them."""
    p = tables.read(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), F.regexp_replace("url", "[?#].*", "").alias("url"), F.col("page_id").cast("string").alias("content_hash"))
    early = F.when(F.col("pos") % 11 == 0, "DATE").when(F.col("pos") % 7 == 0, "SKIPPED")
    items = p.withColumn("early", early).withColumn("content_source", F.when(F.col("early") == "DATE", None).when(F.col("pos") % 2 == 0, "fulltext").otherwise("rss_fallback"))
    none = spark.createDataFrame([], "url string, content_hash string")
    decided = dedup.insert_status(items.where("early is null"), none).withColumnRenamed("status", "fate")
    feeds = spark.createDataFrame([(i != 3,) for i in range(5)], "ok boolean")
    return feeds, decided.unionByName(items.where("early is not null").withColumn("fate", F.col("early")))


@query(SQL["crawl_counters"])
def crawl_counters_observed(spark, sf_dir):
    """crawl_counters, counted in the job that writes the new articles."""
    feeds, items = crawled(spark, sf_dir)
    counts = ingest.write_counted(items, scratch_path(spark, "articles"), F.col("fate") == "CREATED")
    return ingest.feed_counts(feeds).crossJoin(ingest.counters(spark, counts))


@query("""SELECT 'thanhnien' AS name, 'Thanh Niên' AS source UNION ALL SELECT 'tuoitre', 'Tuổi Trẻ'""")
def feed_selection(spark, sf_dir):
    return ingest.resolve_feeds(ingest.feeds(spark), [" TuoiTre ", "thanhnien"]).select("name", "source")


# Dataset preparation


@query("SELECT lang AS label, count(*) AS count FROM documents GROUP BY 1 HAVING count(*) < (SELECT count(*) // count(DISTINCT lang) FROM documents)")
def class_min_samples(spark, sf_dir):
    """Languages with fewer documents than they have on average."""
    d = tables.read(spark, sf_dir, "documents").select(F.col("lang").alias("label"))
    return prepare.too_small(d, d.agg(F.expr("count(*) div count(DISTINCT label)")).first()[0])


# Markup that the title leaves open hides nothing of the content.
@query(r"""WITH d AS (SELECT doc_id AS id, lang AS label, 'A & B ' || translate(split_part(text, '.', 1), '<&', '') AS title, translate(text, '<&', '') AS content FROM documents),
    c AS (SELECT id, label, [trim(regexp_replace(regexp_replace(nfc_normalize(x), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[\s\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x0B]+', ' ', 'g')) FOR x IN [title, content]] AS p FROM d)
    SELECT id, label, p[1] AS title, trim(p[1] || ' ' || p[2]) AS clean_text FROM c""")
def prepare_clean(spark, sf_dir):
    plain = F.translate("text", "<&", "")
    title = F.concat(F.lit("A &amp; B <b>"), F.substring_index(plain, ".", 1), F.lit("</b> <script>x = 1"))
    d = tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), title.alias("title"), plain.alias("content"))
    return prepare.add_clean_text(prepare.fill_missing(d)).select("id", "label", "title", "clean_text")


def split_rows(spark, sf_dir):
    return prepare.stratified_split(tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label")))


@query("""WITH n AS (SELECT count(*) AS n, ceil(round(count(*) * 0.3, 9)) AS held, ceil(round(ceil(round(count(*) * 0.3, 9)) * 0.5, 9)) AS test FROM documents)
    SELECT 'train' AS split, (n - held)::BIGINT AS count FROM n UNION ALL SELECT 'validation', (held - test)::BIGINT FROM n UNION ALL SELECT 'test', test::BIGINT FROM n""")
def stratified_split(spark, sf_dir):
    return split_rows(spark, sf_dir).groupBy("split").agg(F.count("*").alias("count"))


# Whole numbers dealt to classes by largest remainder, twice: what is held out, and of that what is for tests.
QUOTAS = """c AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n) AS n, ceil(round(sum(n) * 0.3::DOUBLE, 9)) AS held FROM c),
    a AS (SELECT label, c.n, held, held * c.n / t.n AS x, ceil(round(held * 0.15::DOUBLE / 0.3::DOUBLE, 9)) AS tests FROM c, t),
    b AS (SELECT *, floor(x) + (row_number() OVER (ORDER BY floor(x) - x, label) <= held - sum(floor(x)) OVER ())::INT AS kept_out FROM a),
    y AS (SELECT *, tests * kept_out / held AS y FROM b),
    quotas AS (SELECT label, n, kept_out::BIGINT AS kept_out, (floor(y) + (row_number() OVER (ORDER BY floor(y) - y, label) <= tests - sum(floor(y)) OVER ())::INT)::BIGINT AS test FROM y)"""


@query(f"WITH {QUOTAS} SELECT label, n - kept_out AS train, kept_out - test AS validation, test, n AS total, round_even((n - kept_out) / n * 100, 2) AS train_pct FROM quotas")
def class_split_pivot(spark, sf_dir):
    return prepare.split_table(split_rows(spark, sf_dir))


@query(f"""WITH {QUOTAS}, r AS (SELECT doc_id AS id, lang AS label, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id)) AS rank FROM documents)
    SELECT id, label, CASE WHEN rank <= test THEN 'test' WHEN rank <= kept_out THEN 'validation' ELSE 'train' END AS split FROM r JOIN quotas USING (label)""")
def split_assignment(spark, sf_dir):
    return split_rows(spark, sf_dir)


@query("SELECT max(c)::DOUBLE / min(c) AS ratio FROM (SELECT count(*) AS c FROM documents GROUP BY lang)")
def class_imbalance(spark, sf_dir):
    return prepare.imbalance(tables.read(spark, sf_dir, "documents").withColumnRenamed("lang", "label"))


@query(r"""WITH s AS (SELECT length(text) AS c, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS w FROM documents)
    SELECT round(avg(c), 6) AS chars_mean, median(c)::DOUBLE AS chars_median, min(c) AS chars_min, max(c) AS chars_max, round(avg(w), 6) AS words_mean, median(w)::DOUBLE AS words_median, min(w) AS words_min, max(w) AS words_max FROM s""")
def text_stats(spark, sf_dir):
    return prepare.text_stats(tables.read(spark, sf_dir, "documents"), "text")


@query("SELECT doc_id AS id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) <= 50")
def stratified_sample(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return prepare.sample_per_class(d, "lang", 50)


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' ELSE 'Deutsch' END AS lang FROM documents WHERE lang IN ('en', 'de') AND length(text) >= 30")
def category_remap(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents").where(F.length("text") >= 30)
    return prepare.remap(d, "lang", {"en": "English", "de": "Deutsch"}).select("doc_id", "lang")


# Quality of predictions


def predicted(spark, sf_dir):
    return tables.predictions(spark, sf_dir)


@query(f"WITH {PREDICTIONS} SELECT count(*) AS total, count(*) FILTER (correct) AS correct, count(*) FILTER (NOT correct) AS errors, round(avg(correct::INT), 9) AS accuracy FROM predictions")
def accuracy(spark, sf_dir):
    return evaluate.accuracy(predicted(spark, sf_dir))


PRF = f"""{PREDICTIONS}, s AS (SELECT ground_truth AS label, 1 AS t, 0 AS p, correct::INT AS tp FROM predictions UNION ALL SELECT prediction, 0, 1, 0 FROM predictions),
    c AS (SELECT label, sum(tp)::BIGINT AS tp, sum(p)::BIGINT AS pred, sum(t)::BIGINT AS support FROM s GROUP BY label),
    r AS (SELECT *, CASE WHEN pred = 0 THEN 0 ELSE tp / pred END AS pr, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS re FROM c),
    classes AS (SELECT label, tp, pred - tp AS fp, support - tp AS fn, round(pr, 9) AS precision, round(re, 9) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 9) AS f1, support FROM r)"""


@query(f"WITH {PRF} SELECT * FROM classes")
def prf_per_class(spark, sf_dir):
    return evaluate.per_class(predicted(spark, sf_dir))


@query(f"""WITH {PRF} SELECT 'macro avg' AS average, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, sum(support)::BIGINT AS support FROM classes
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM classes""")
def macro_weighted(spark, sf_dir):
    return evaluate.averages(evaluate.per_class(predicted(spark, sf_dir)))


@query(f"WITH {PREDICTIONS} SELECT ground_truth, " + ", ".join(f"count(*) FILTER (prediction = '{x}') AS {x}" for x in ("de", "en", "es", "fr")) + " FROM predictions GROUP BY 1")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(predicted(spark, sf_dir), ["de", "en", "es", "fr"])


@query(f"""WITH {PREDICTIONS} SELECT ground_truth, prediction, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY ground_truth), 9) AS error_rate_within_class
    FROM predictions WHERE NOT correct GROUP BY 1, 2""")
def confusion_pairs(spark, sf_dir):
    return evaluate.confusion_pairs(predicted(spark, sf_dir))


BUCKET = "CASE WHEN margin < 0.10::DOUBLE THEN 0 WHEN margin < 0.20::DOUBLE THEN 1 WHEN margin < 0.30::DOUBLE THEN 2 WHEN margin < 0.50::DOUBLE THEN 3 ELSE 4 END"
BUCKETS = f"""{PREDICTIONS}, b AS (SELECT unnest(range(5))::INT AS position, unnest(['<0.10', '0.10–0.20', '0.20–0.30', '0.30–0.50', '>=0.50']) AS bucket),
    m AS (SELECT {BUCKET} AS position, count(*) AS n, count(*) FILTER (correct) AS c FROM predictions {{where}} GROUP BY 1)"""
MARGINS = """SELECT position, bucket, coalesce(n, 0) AS total, coalesce(c, 0) AS correct, coalesce(n - c, 0) AS errors, round(coalesce(c / n, 0), 9) AS accuracy, round(coalesce((n - c) / n, 0), 9) AS error_rate FROM b """


@query(f"WITH {BUCKETS.replace('{where}', '')} {MARGINS} LEFT JOIN m USING (position)")
def margin_buckets(spark, sf_dir):
    return evaluate.margin_stats(predicted(spark, sf_dir))


@query(f"WITH {BUCKETS.replace('{where}', 'WHERE margin < 0.25::DOUBLE')} {MARGINS} JOIN m USING (position)")
def margin_buckets_present(spark, sf_dir):
    return evaluate.margin_stats(predicted(spark, sf_dir).where("margin < 0.25D"), empty=False)


@query(f"WITH {BUCKETS.replace('{where}', '')} SELECT bucket, n AS total, round(n * 100 / sum(n) OVER (), 6) AS percent FROM b JOIN m USING (position)")
def margin_shares(spark, sf_dir):
    return evaluate.bucket_shares(predicted(spark, sf_dir))


@query(f"""WITH {PREDICTIONS} SELECT ground_truth, count(*) AS total, count(*) FILTER (correct) AS correct, count(*) FILTER (NOT correct) AS errors, round(avg(correct::INT), 9) AS accuracy,
    round(avg(margin), 9) AS avg_margin, round(median(margin), 9) AS median_margin FROM predictions GROUP BY 1""")
def per_class_margin(spark, sf_dir):
    return evaluate.per_class_margin(predicted(spark, sf_dir))


@query(f"""WITH {PREDICTIONS} SELECT ground_truth, round(median(sqrt(margin + id)), 9) AS median FROM predictions GROUP BY 1""")
def margin_medians(spark, sf_dir):
    p = predicted(spark, sf_dir).withColumn("spread", F.sqrt(F.col("margin") + F.col("id")))
    return rounded(evaluate.medians(p, "ground_truth", "spread"), "median", places=9)


@query(f"""WITH {PREDICTIONS} SELECT threshold, count(*) FILTER (margin < threshold) AS unknown, count(*) FILTER (margin >= threshold) AS remaining,
    round(count(*) FILTER (margin >= threshold AND correct) / count(*) FILTER (margin >= threshold), 9) AS remaining_accuracy, count(*) FILTER (margin < threshold AND NOT correct) AS errors_caught
    FROM predictions, (SELECT unnest([0.05, 0.10, 0.15, 0.20, 0.25, 0.30]::DOUBLE[]) AS threshold) GROUP BY 1""")
def threshold_simulation(spark, sf_dir):
    return evaluate.thresholds(predicted(spark, sf_dir))


@query(f"""WITH {PREDICTIONS} SELECT threshold, count(*) FILTER (margin < threshold) AS count, round(count(*) FILTER (margin < threshold) * 100 / count(*), 6) AS percent
    FROM predictions, (SELECT unnest([0.10, 0.20, 0.30, 0.50]::DOUBLE[]) AS threshold) GROUP BY 1""")
def margins_below(spark, sf_dir):
    return evaluate.below(predicted(spark, sf_dir))


@query(f"WITH {PREDICTIONS} SELECT id, margin FROM predictions ORDER BY margin, id LIMIT 100")
def uncertain_topk(spark, sf_dir):
    return evaluate.least_certain(predicted(spark, sf_dir)).select("id", "margin")


@query(f"WITH {PREDICTIONS} SELECT id, margin FROM predictions WHERE NOT correct ORDER BY margin, id LIMIT 15")
def uncertain_wrong(spark, sf_dir):
    return evaluate.least_certain(predicted(spark, sf_dir), 15, True).select("id", "margin")


@query(f"WITH {PREDICTIONS} SELECT id, ground_truth, prediction FROM predictions WHERE ground_truth <> prediction")
def category_mismatch(spark, sf_dir):
    return evaluate.mismatches(predicted(spark, sf_dir), "ground_truth", "prediction").select("id", "ground_truth", "prediction")


@query(f"WITH {PREDICTIONS} SELECT id FROM predictions WHERE abs(margin - round(margin, 1)) > 1e-6")
def score_drift(spark, sf_dir):
    p = predicted(spark, sf_dir).withColumn("stored", F.round("margin", 1))
    return evaluate.score_drift(p, "stored", "margin").select("id")


@query(f"""WITH {PREDICTIONS}, s AS (SELECT source AS stage, round(avg(correct::INT), 9) AS macro_f1 FROM predictions GROUP BY 1)
    SELECT stage, macro_f1, round(macro_f1 - lag(macro_f1) OVER (ORDER BY stage), 9) AS delta, stage = (SELECT stage FROM s ORDER BY macro_f1 DESC, stage DESC LIMIT 1) AS is_best FROM s""")
def ablation_deltas(spark, sf_dir):
    s = predicted(spark, sf_dir).groupBy(F.col("source").alias("stage")).agg(F.round(F.avg(F.col("correct").cast("double")), 9).alias("macro_f1"))
    return evaluate.ablation(s)


@query(f"""WITH {PRF} SELECT (SELECT label FROM classes ORDER BY f1 DESC, label DESC LIMIT 1) AS strongest, max(f1) AS strongest_f1, (SELECT label FROM classes ORDER BY f1, label LIMIT 1) AS weakest, min(f1) AS weakest_f1 FROM classes""")
def class_extremes(spark, sf_dir):
    return evaluate.extremes(evaluate.per_class(predicted(spark, sf_dir)))


@query(f"WITH {PREDICTIONS} SELECT count(*) FILTER (correct) AS diagonal, count(*) FILTER (NOT correct) AS off_diagonal FROM predictions")
def confusion_diagonal(spark, sf_dir):
    return evaluate.diagonal(predicted(spark, sf_dir))


@query(f"WITH {PREDICTIONS} SELECT id, '' AS human_category, '' AS label_note FROM predictions")
def labelling_sheet(spark, sf_dir):
    return evaluate.labelling_sheet(predicted(spark, sf_dir)).select("id", "human_category", "label_note")


# Classification and streams


#: What predict_batch is fitted on: labelled rows of each class, and the solver's rounds. All rows are predicted.
FIT_ROWS, FIT_ROUNDS = 500, 20


@query()
def predict_batch(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))
    rows = materialize(classify.with_tokens(prepare.sample_per_class(d, "label", FIT_ROWS)), "training")
    model = classify.train(rows, rounds=FIT_ROUNDS)
    return rounded(classify.predict(model, d).select("id", "label", "prediction", "score", "margin", "status"), "score", "margin")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def event_window_counts(spark, sf_dir):
    return event_windows(tables.read(spark, sf_dir, "events"))
