"""DuckDB forms of the views in sources/tables.py."""

NEWS = """news AS (
    SELECT doc_id AS id, 'https://news.example/' || source || '/' || doc_id AS url, split_part(text, '.', 1) AS title, text AS content,
           CASE WHEN n_chars >= 500 THEN 'fulltext' ELSE 'rss_fallback' END AS content_source, source, lang AS category,
           n_chars::DOUBLE / 1000 AS decision_score,
           CASE WHEN doc_id % 10 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + to_hours((doc_id * 7 % 720)::INT) END AS published_at,
           TIMESTAMP '2024-01-31 00:00:00' + to_hours((doc_id % 48)::INT) AS crawled_at
    FROM documents)"""

TOKENS = r"""tok AS (
    SELECT news_id, keyword, count(*) AS frequency
    FROM (SELECT doc_id AS news_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS keyword FROM documents)
    WHERE length(keyword) >= 5 GROUP BY ALL)"""

KEYWORDS = TOKENS + """, dfs AS (
    SELECT keyword, count(*) AS df FROM tok GROUP BY keyword
), ranked AS (
    SELECT news_id, keyword, keyword AS display_keyword, frequency,
           round((1 + ln(frequency::DOUBLE)) * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1), 9) AS final_score
    FROM tok JOIN dfs USING (keyword), (SELECT count(*) AS n FROM documents) WHERE df <= 0.9::DOUBLE * n
), keyword_occurrences AS (
    SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY news_id ORDER BY final_score DESC, keyword) <= 10)"""

PREDICTIONS = """predictions AS (
    SELECT *, ground_truth = prediction AS correct FROM (
        SELECT doc_id AS id, source, lang AS ground_truth,
               CASE WHEN doc_id % 7 = 0 THEN map {'en': 'de', 'de': 'fr', 'fr': 'es', 'es': 'en'}[lang] ELSE lang END AS prediction,
               (doc_id * 37 % 100) / 100::DOUBLE AS margin
        FROM documents))"""


