"""The same results in SQL on the given tables."""

from __future__ import annotations

from workload.queries import AS_OF, TABLES
from workload.roles import ALIASES

_TIME = "'%Y-%m-%d %H:%M:%S'"
_MICROS = "'%Y-%m-%d %H:%M:%S.%f'"

_ARTICLES = f"""articles AS (
  SELECT doc_id,
    CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS provider_rank,
    CAST(substr(source, 4) AS INT) AS symbol_rank,
    CASE lang WHEN 'en' THEN 'Alpha Vantage' WHEN 'fr' THEN 'Finnhub'
      WHEN 'de' THEN 'Marketaux' ELSE 'yfinance' END AS source_api,
    source AS symbol, 'Story ' || doc_id AS title, text AS description, source,
    'https://news.example.com/a/' || md5(text) AS url,
    strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), {_TIME}) AS published_at
  FROM documents)"""
_STORED = """stored AS (
  SELECT 'https://news.example.com/a/' || md5(text) AS url, min(doc_id) AS id
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1)"""
_UNIQUE = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY provider_rank, symbol_rank, doc_id) AS rn
  FROM articles),
uniq AS (SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1)"""
_FRESH = "fresh AS (SELECT * FROM uniq WHERE url NOT IN (SELECT url FROM stored))"
_STOCKS = """stocks AS (
  SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS id, source AS symbol FROM documents)"""
_MATCHED = """matched AS (
  SELECT e.*, CASE WHEN d.doc_id <> 0 THEN d.doc_id END AS news_id
  FROM events e LEFT JOIN documents d ON e.event_id = d.doc_id)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _hit(names, text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{n.lower()}')" for n in names) + ")"


def _match(text: str, fallback: str) -> str:
    whens = " ".join(f"WHEN {_hit(names, text)} THEN '{s}'" for s, names in ALIASES.items())
    return f"CASE {whens} ELSE {fallback} END"


_LOWER = "lower(title || ' ' || description)"
_ASSIGNED = f"assigned AS (SELECT * REPLACE ({_match(_LOWER, 'symbol')} AS symbol) FROM fresh)"


def _shown_articles() -> str:
    return "source_api, symbol, title, description, source, url, published_at"


def _feed(provider: str, rank: int) -> str:
    """Both items of every response; the second has a bad time."""
    common = f"""'run' AS run_id, {rank} AS provider_rank, doc_id AS seq"""
    rest = f"""'{provider}' AS source_api, source AS symbol, 'Story ' || doc_id AS title,
      text AS description, source"""
    url = "'https://news.example.com/a/' || md5(text)"
    return f"""
SELECT {common}, 0 AS pos, {rest}, {url} AS url,
  strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), {_TIME}) AS published_at FROM documents
UNION ALL
SELECT {common}, 1 AS pos, {rest}, {url} || '/b' AS url, NULL AS published_at FROM documents"""


# Documents delivered as landed responses: every response has a second item.
_DELIVERED = """delivered AS (
  SELECT *, 0 AS pos FROM articles
  UNION ALL
  SELECT * REPLACE (url || '/b' AS url, NULL AS published_at), 1 AS pos FROM articles),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY provider_rank, doc_id, pos) AS rn
  FROM delivered),
uniq AS (SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1)"""

_LIMIT = """CASE WHEN event_type IN ('error', 'signup') THEN true ELSE false END"""

_DAILY_SOURCE = """daily_source AS (
  SELECT event_id, user_id % 20 AS stock_id, 'src' || (user_id % 20) AS symbol,
    strftime(ts, '%Y-%m-%d') AS sentiment_date,
    CAST(trunc(value) AS BIGINT) AS article_count,
    CAST(trunc(-value) AS BIGINT) AS positive_articles,
    CASE WHEN event_type = 'error' THEN 0 ELSE CAST(trunc(value) AS BIGINT) END AS neutral_articles,
    CAST(CASE WHEN event_type = 'click' THEN 0 ELSE 1000 END AS BIGINT) AS negative_articles,
    value AS average_positive,
    CASE WHEN event_type <> 'signup' THEN value END AS average_neutral,
    CASE WHEN event_type <> 'error' THEN value END AS average_negative,
    value AS average_sentiment, CAST(0.5 AS DOUBLE) AS sentiment_balance
  FROM events WHERE event_type <> 'view')"""
_DAILY_LAST = """daily_last AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY stock_id, sentiment_date ORDER BY event_id DESC) AS rn
    FROM daily_source) WHERE rn = 1)"""


def _rollup(stocks: int) -> str:
    return f"""
  SELECT user_id % {stocks} AS stock_id, 'src' || (user_id % {stocks}) AS symbol,
    strftime(ts, '%Y-%m-%d') AS sentiment_date, count(*) AS article_count,
    count(*) FILTER (event_type = 'purchase') AS positive_articles,
    count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS neutral_articles,
    count(*) FILTER (event_type = 'error') AS negative_articles,
    round(avg(value), 9) AS average_positive, round(avg(value / 2), 9) AS average_neutral,
    round(avg(value / 4), 9) AS average_negative, round(avg(value - 100), 9) AS average_sentiment,
    round((count(*) FILTER (event_type = 'purchase') - count(*) FILTER (event_type = 'error'))
      / count(*), 9) AS sentiment_balance
  FROM events GROUP BY ALL"""


_GAPS = """gaps AS (
  SELECT event_id,
    CASE event_type WHEN 'error' THEN '' WHEN 'signup' THEN NULL ELSE props END AS title,
    CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN NULL ELSE props END AS url
  FROM events)"""

_MINUTES = f"""greatest(0, floor((epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(ts)) / 60000.0))::BIGINT"""
_AGE = f"""CASE WHEN {_MINUTES} < 1 THEN 'Just now'
    WHEN {_MINUTES} < 60 THEN {_MINUTES} || ' min ago'
    WHEN {_MINUTES} < 1440 THEN ({_MINUTES} // 60) || ' hr ago'
    ELSE ({_MINUTES} // 1440) || ' days ago' END"""

_ORIGIN = r"regexp_extract(url, '^(https?://[^/?#]+)', 1)"
_PATH = r"regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
_FOLDER = rf"regexp_replace({_PATH}, '[^/]*$', '')"
_PARENT = r"regexp_replace({0}, '[^/]+/$', '')".format(_FOLDER)
_SCHEME = "split_part(url, ':', 1)"
_IMAGE = f"""CASE
    WHEN url LIKE '%#top' THEN {_ORIGIN} || '/img/' || page_id || '.jpg'
    WHEN contains(url, '?') THEN {_SCHEME} || '://cdn.example.com/' || page_id || '.png?w=1&h=2'
    WHEN url LIKE '%.html' THEN {_ORIGIN} || {_PARENT} || 'pic/' || page_id || '.gif'
    WHEN url LIKE '%/' THEN 'https://img.example.org/' || page_id END"""

_CSV_FATES = """copies AS (SELECT DISTINCT url, symbol FROM articles),
winner AS (SELECT url, min(symbol_rank) AS best FROM articles GROUP BY url)"""


def _summary(fate: str, joins: str) -> str:
    return f"""fates AS (
  SELECT c.symbol, {fate} AS kind FROM copies c {joins}),
kinds AS (
  SELECT symbol, 'row' AS kind FROM articles UNION ALL SELECT symbol, kind FROM fates)
SELECT symbol, count(*) FILTER (kind = 'row') AS rows,
  count(*) FILTER (kind = 'inserted') AS inserted, count(*) FILTER (kind = 'skipped') AS skipped,
  count(*) FILTER (kind = 'missing') AS missing, CAST(0 AS BIGINT) AS errors
FROM kinds GROUP BY ROLLUP (symbol)"""


def oracle_sql() -> dict[str, str]:
    base = _with(_ARTICLES, _STORED, _UNIQUE, _FRESH)
    sql = {
        "stock_dim": _with(_STOCKS) + "SELECT id, symbol FROM stocks",
        "stock_lookup": _with(_STOCKS)
        + """SELECT w.symbol, s.id FROM (SELECT DISTINCT 'src' || user_id AS symbol FROM events) w
LEFT JOIN stocks s ON s.symbol = w.symbol""",
        "null_image_rows": "SELECT url, 'Page ' || page_id AS title FROM pages WHERE url NOT LIKE '%.html'",
        "payload_parse": _with(_ARTICLES)
        + """SELECT source_api AS provider, symbol, CAST(doc_id AS INT) AS seq, 0 AS pos, 200 AS status,
  url AS link FROM articles
UNION ALL SELECT source_api, symbol, CAST(doc_id AS INT), 1, 200, url || '/b' FROM articles
UNION ALL SELECT source_api, symbol, CAST(doc_id AS INT), 2, 200, '' FROM articles
WHERE source_api = 'yfinance'""",
        "csv_scan": _with(_ARTICLES)
        + f"SELECT symbol_rank, {_shown_articles()} FROM articles",
        "csv_scan_broken": _with(_ARTICLES)
        + "SELECT doc_id, symbol, symbol_rank, url FROM articles WHERE doc_id % 3 = 0",
        "load_news_job": _with(_ARTICLES)
        + """SELECT symbol, count(*) AS inserted, count(*) AS stored, count(*) AS urls FROM (
  SELECT url, arg_min(symbol, symbol_rank) AS symbol FROM articles
  WHERE url <> '' AND symbol <> 'src19' GROUP BY url)
GROUP BY symbol""",
        "article_record": _with(_ARTICLES)
        + f"""SELECT CAST(symbol_rank AS BIGINT) AS stock_id, CAST(NULL AS VARCHAR) AS text,
  {_shown_articles()}, substr(published_at, 1, 10) AS published_day FROM articles""",
        "sentiment_record": _with(_MATCHED)
        + """SELECT news_id,
  CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'error' THEN 'negative'
    WHEN 'view' THEN NULL ELSE 'neutral' END AS sentiment_label,
  round(value, 9) AS positive_score,
  CASE WHEN event_type <> 'click' THEN round(value, 9) END AS neutral_score,
  CASE WHEN event_type <> 'signup' THEN round(value, 9) END AS negative_score,
  round(value, 9) AS sentiment_score, 'ProsusAI/finbert' AS model
FROM matched WHERE news_id IS NOT NULL""",
        "daily_record": _with(_DAILY_SOURCE) + "SELECT * FROM daily_source",
        "csv_scan_daily": _with(_DAILY_SOURCE) + "SELECT * EXCLUDE (event_id) FROM daily_source",
        "csv_scan_sentiment": """SELECT 'src' || (event_id % 20) AS symbol,
  CAST(event_id % 20 AS INT) AS symbol_rank, 'https://news.example.com/d/' || event_id AS url,
  CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'error' THEN 'negative'
    WHEN 'view' THEN NULL ELSE 'neutral' END AS sentiment_label,
  round(value, 9) AS positive_score,
  CASE WHEN event_type <> 'click' THEN round(value, 9) END AS neutral_score,
  CASE WHEN event_type <> 'signup' THEN round(value, 9) END AS negative_score,
  round(value, 9) AS sentiment_score FROM events""",
        "feed_projection": """SELECT CAST(NULL AS VARCHAR) AS symbol, 'Page ' || page_id AS title,
  '' AS description, 'crawl' AS source, url, page_id AS published_at, 'pages' AS source_api,
  CASE WHEN url LIKE '%/' THEN '' ELSE url || ' ~*é%+' END AS image_url,
  CASE WHEN url NOT LIKE '%/' THEN '/api/news-image?url=' || url_encode(url || ' ~*é%+') END
    AS image_proxy_url FROM pages""",
        "feed_display": f"""SELECT CAST(event_id AS VARCHAR) AS url,
  ({_AGE}) || ' • ' || CASE event_type WHEN 'click' THEN 'log' WHEN 'view' THEN 'Financial News'
    ELSE event_type END AS byline,
  CASE WHEN event_type = 'error' THEN 'Untitled financial news' ELSE props END AS headline,
  CASE WHEN event_type = 'signup' THEN '' ELSE event_type END AS teaser,
  CASE WHEN event_type = 'purchase' THEN '' ELSE CAST(user_id AS VARCHAR) END AS symbol,
  CASE WHEN event_type IN ('click', 'view') THEN 'Financial news' ELSE event_type END AS image_alt
FROM events""",
        "age_label": f"SELECT event_id, {_AGE} AS age FROM events",
        "lookback_window": """SELECT event_id, event_type FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-15 00:00:00' AND TIMESTAMP '2024-01-15 02:00:00'""",
        "valid_articles": _with(_GAPS) + "SELECT event_id FROM gaps WHERE title <> '' AND url <> ''",
        "url_present": _with(_GAPS) + "SELECT event_id FROM gaps WHERE url <> ''",
        "limit_responses": f"SELECT event_id, {_LIMIT} AS is_limit FROM events",
        "provider_breaker": """SELECT event_id, user_id FROM (
  SELECT event_id, user_id, max(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tripped FROM events) WHERE NOT tripped""",
        "admissible_url": """WITH links AS (
  SELECT page_id, 0 AS pos, url AS link, url LIKE 'https://%' AS admissible FROM pages
  UNION ALL SELECT page_id, 1, regexp_replace(url, '^http:', 'https:'), true FROM pages
  UNION ALL SELECT page_id, 2,
    'https://' || (page_id % 256) || '.' || (length(url) % 256) || '.7.1:8443/x.png',
    NOT (page_id % 256 IN (0, 10, 127) OR page_id % 256 >= 224
      OR (page_id % 256 = 169 AND length(url) % 256 = 254)
      OR (page_id % 256 = 172 AND length(url) % 256 BETWEEN 16 AND 31)
      OR (page_id % 256 = 192 AND length(url) % 256 = 168)
      OR (page_id % 256 = 198 AND length(url) % 256 BETWEEN 18 AND 19)) FROM pages
  UNION ALL SELECT page_id, 3, 'https://[::1]/a.png', false FROM pages
  UNION ALL SELECT page_id, 4, 'https://user@LOCALHOST./' || page_id, false FROM pages
  UNION ALL SELECT page_id, 5, 'https://' || page_id || '/a.png', false FROM pages
  UNION ALL SELECT page_id, 6, 'not a url', false FROM pages)
SELECT * FROM links""",
        "attach_stock_id": _with(_STOCKS)
        + """SELECT e.event_id, s.symbol, s.id AS stock_id FROM events e
JOIN stocks s ON s.symbol = 'src' || e.user_id""",
        "missing_symbols": _with(_STOCKS)
        + """SELECT DISTINCT 'src' || user_id AS symbol FROM events
WHERE 'src' || user_id NOT IN (SELECT symbol FROM stocks)""",
        "new_articles": base + "SELECT url, doc_id, symbol FROM fresh",
        "new_articles_probed": base + "SELECT url, doc_id, symbol FROM fresh",
        "load_skip_counts": _with(_ARTICLES, _STORED)
        + """SELECT CASE WHEN url IN (SELECT url FROM stored) THEN 'skipped' ELSE 'inserted' END AS status,
  count(DISTINCT url) AS urls FROM articles GROUP BY 1""",
        "sentiment_match": _with(_MATCHED) + "SELECT event_id, news_id FROM matched",
        "new_sentiment": _with(_MATCHED)
        + """SELECT news_id, CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'error' THEN 'negative'
    WHEN 'view' THEN 'NA' ELSE 'neutral' END AS sentiment_label
FROM matched WHERE news_id IS NOT NULL AND news_id NOT IN (SELECT doc_id FROM labels)""",
        "stock_association": _with(_ARTICLES, _STORED, _UNIQUE, _FRESH, _ASSIGNED)
        + "SELECT url, doc_id, symbol FROM assigned",
        "stock_association_large": _with(
            _ARTICLES,
            _UNIQUE,
            r"""aliases AS (
  SELECT DISTINCT item_id AS rank, unnest(regexp_extract_all(lower(text), '\w{8,}')) AS alias FROM benchmark)""",
            f"""hits AS (
  SELECT url, min(rank) AS rank FROM uniq JOIN aliases ON contains({_LOWER}, alias) GROUP BY url)""",
        )
        + """SELECT u.url, doc_id, coalesce('item' || rank, nullif(symbol, '')) AS symbol
FROM uniq u LEFT JOIN hits h ON h.url = u.url WHERE coalesce('item' || rank, nullif(symbol, '')) IS NOT NULL""",
        "all_stock_matches": _with(_ARTICLES)
        + "\nUNION ALL\n".join(
            f"SELECT doc_id, {rank} AS match_rank, '{s}' AS match_symbol FROM articles "
            f"WHERE {_hit(names, _LOWER)}"
            for rank, (s, names) in enumerate(ALIASES.items())
        ),
        "dedup_first_seen": base + "SELECT * FROM uniq",
        "dedup_csv": _with(_ARTICLES)
        + """SELECT url, arg_min(symbol, symbol_rank * 1000000000::BIGINT + doc_id) AS symbol,
  arg_min(doc_id, symbol_rank * 1000000000::BIGINT + doc_id) AS doc_id,
  CAST(count(DISTINCT symbol) AS INT) AS copies FROM articles GROUP BY url""",
        "dedup_last_wins": _with(_DAILY_SOURCE, _DAILY_LAST) + "SELECT * FROM daily_last",
        "distinct_urls": _with(_GAPS) + "SELECT DISTINCT url FROM gaps WHERE url <> ''",
        "provider_counts": """SELECT p.source_api, count(e.event_id) AS articles
FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('refund')) p(source_api)
LEFT JOIN events e ON e.event_type = p.source_api GROUP BY 1""",
        "provider_status": f"""SELECT event_type AS provider,
  CASE WHEN max({_LIMIT}) THEN 'LIMIT HIT - DISABLED THIS RUN' ELSE 'ACTIVE' END AS status
FROM events GROUP BY 1 UNION ALL SELECT 'refund', 'ACTIVE'""",
        "run_funnel": base
        + """SELECT 'raw' AS step, count(*) AS rows FROM articles
UNION ALL SELECT 'unique', count(*) FROM uniq
UNION ALL SELECT 'already_stored', count(*) FROM uniq WHERE url IN (SELECT url FROM stored)
UNION ALL SELECT 'new', count(*) FROM fresh
UNION ALL SELECT 'unmatched', 0
UNION ALL SELECT 'assigned', count(*) FROM fresh
UNION ALL SELECT 'inserted', count(*) FROM fresh""",
        "load_summary_rollup": _with(_ARTICLES, _STORED, _CSV_FATES)
        + ", "
        + _summary(
            """CASE WHEN s.url IS NULL AND CAST(substr(c.symbol, 4) AS INT) = w.best
    THEN 'inserted' ELSE 'skipped' END""",
            "JOIN winner w ON w.url = c.url LEFT JOIN stored s ON s.url = c.url",
        ),
        "sentiment_load_summary": _with(
            _ARTICLES,
            _CSV_FATES,
            """known AS (
  SELECT url, arg_max(quality, a.doc_id) AS quality, max(a.doc_id) AS doc_id
  FROM articles a JOIN labels l ON l.doc_id = a.doc_id GROUP BY url)""",
        )
        + ", "
        + _summary(
            """CASE WHEN k.url IS NULL THEN 'missing'
    WHEN k.quality = 1 OR CAST(substr(c.symbol, 4) AS INT) <> w.best THEN 'skipped'
    ELSE 'inserted' END""",
            "JOIN winner w ON w.url = c.url LEFT JOIN known k ON k.url = c.url",
        ),
        "table_counts": "\nUNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in TABLES
        ),
        "daily_sentiment": f"SELECT * FROM ({_rollup(20)})",
        "daily_rollup": f"""SELECT r.* REPLACE (n.symbol AS symbol) FROM ({_rollup(20)}) r JOIN (
  SELECT user_id % 20 AS stock_id, strftime(ts, '%Y-%m-%d') AS sentiment_date,
    arg_max('src' || (user_id % 20) || CASE WHEN hour(ts) >= 12 THEN 'x' ELSE '' END, ts) AS symbol
  FROM events GROUP BY 1, 2) n USING (stock_id, sentiment_date)""",
        "news_page": f"""SELECT o_orderkey, strftime(o_orderdate, {_TIME}) AS o_orderdate FROM orders
ORDER BY orders.o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 100 OFFSET 200""",
        "news_page_deep": f"""SELECT o_orderkey, strftime(o_orderdate, {_TIME}) AS o_orderdate FROM orders
ORDER BY orders.o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 100 OFFSET 11900""",
        "news_page_meta": """SELECT 3 AS page, 100 AS "limit", count(*) AS count,
  count(*) = 100 AS has_next FROM (SELECT o_orderkey FROM orders
  ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 100 OFFSET 200)""",
        "latest_six": f"""SELECT o_orderkey, strftime(o_orderdate, {_TIME}) AS o_orderdate FROM orders
ORDER BY orders.o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 6""",
        "union_providers": """SELECT doc_id AS item, text AS body, 'Alpha Vantage' AS source_api,
  0 AS provider_rank FROM documents
UNION ALL SELECT conv_id, text, 'Finnhub', 1 FROM conversations
UNION ALL SELECT page_id, html, 'Marketaux', 2 FROM pages
UNION ALL SELECT event_id, props, 'yfinance', 3 FROM events""",
        "clean_values": """SELECT event_id,
  CASE event_type WHEN 'click' THEN CAST(value AS VARCHAR) WHEN 'view' THEN value || 'd'
    WHEN 'purchase' THEN ' -' || value END AS value,
  CASE event_type WHEN 'click' THEN value WHEN 'purchase' THEN -value END AS score,
  CAST(CASE event_type WHEN 'click' THEN trunc(value) WHEN 'purchase' THEN trunc(-value) ELSE 0 END
    AS BIGINT) AS whole,
  CASE event_type WHEN 'click' THEN CAST(value AS VARCHAR) WHEN 'view' THEN value || 'd'
    WHEN 'error' THEN 'NaN' WHEN 'purchase' THEN ' -' || value ELSE 'none' END AS shown
FROM events""",
        "parse_times": f"""SELECT event_id,
  strftime(date_trunc('second', ts), {_MICROS}) AS compact_ts,
  strftime(date_trunc('second', ts), {_MICROS}) AS epoch_ts,
  strftime(ts - INTERVAL 2 HOUR, {_MICROS}) AS iso_ts,
  strftime(date_trunc('second', ts), {_MICROS}) AS rfc_ts,
  CASE WHEN event_type <> 'error' THEN strftime(date_trunc('minute', ts), {_MICROS}) END AS slashed_ts
FROM events""",
        "request_window": """SELECT event_id,
  strftime(ts - INTERVAL 2 HOUR, '%Y%m%dT%H%M') AS compact_from,
  strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d') AS day_from,
  strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M') AS minute_from,
  strftime(ts, '%Y%m%dT%H%M') AS compact_to, strftime(ts, '%Y-%m-%d') AS day_to,
  strftime(ts, '%Y-%m-%dT%H:%M') AS minute_to FROM events""",
        "url_parts": r"""SELECT page_id,
  CASE WHEN url LIKE 'https://%' THEN regexp_extract(url, '^https://([^/?#]+)', 1) END AS host,
  url_encode(url) AS encoded, true AS is_web FROM pages""",
        "resolve_url": f"""SELECT page_id, 0 AS pos, {_ORIGIN} || '/a/b.png' AS link FROM pages
UNION ALL SELECT page_id, 1, {_SCHEME} || '://cdn.example.com/c.png' FROM pages
UNION ALL SELECT page_id, 2, {_ORIGIN} || {_FOLDER} || 'pic.png' FROM pages
UNION ALL SELECT page_id, 3, {_ORIGIN} || {_PARENT} || 'up.png' FROM pages
UNION ALL SELECT page_id, 4, 'https://o.example.com/x?y=1' FROM pages""",
        "short_title": "SELECT doc_id, substr(text, 1, 90) AS title FROM documents",
        "image_extract": f"SELECT url, {_IMAGE} AS image_url FROM pages WHERE url NOT LIKE '%.html'",
        "backfill_counts": """SELECT count(*) FILTER (url LIKE '%#top' OR contains(url, '?') OR url LIKE '%/')
    AS updated,
  count(*) FILTER (NOT (url LIKE '%#top' OR contains(url, '?') OR url LIKE '%/')) AS not_found
FROM pages WHERE url NOT LIKE '%.html'""",
        "fill_missing_image": f"""SELECT page_id AS id, url, 'Page ' || page_id AS title,
  CASE WHEN url LIKE '%.html' THEN 'https://old.example.com/kept.png' ELSE {_IMAGE} END AS image_url
FROM pages""",
        "insert_if_absent": base
        + """SELECT id, url, 'stored' AS title FROM stored
UNION ALL SELECT NULL, url, title FROM fresh""",
        "upsert_daily": _with(_DAILY_SOURCE, _DAILY_LAST, f"target AS ({_rollup(40)})")
        + """SELECT t.* FROM target t WHERE NOT EXISTS (SELECT 1 FROM daily_last s
  WHERE s.stock_id = t.stock_id AND s.sentiment_date = t.sentiment_date)
UNION ALL SELECT * EXCLUDE (event_id) FROM daily_last""",
        "collector_run": _with(_ARTICLES, _STORED, _DELIVERED, _FRESH, _ASSIGNED)
        + """SELECT CAST(substr(symbol, 4) AS BIGINT) AS stock_id, symbol, source_api,
  count(*) AS articles, min(published_at) AS first_published, max(published_at) AS last_published
FROM assigned GROUP BY ALL""",
        "stream_ingest_runs": _with(
            _ARTICLES,
            """in_runs AS (SELECT *, doc_id // 50 AS run FROM articles),
cutoffs AS (
  SELECT run, source_api, min(doc_id) AS cutoff FROM in_runs
  WHERE run % 4 = 0 AND doc_id % 50 = 13 AND source_api <> 'yfinance' GROUP BY ALL),
open AS (
  SELECT a.* FROM in_runs a LEFT JOIN cutoffs c ON c.run = a.run AND c.source_api = a.source_api
  WHERE cutoff IS NULL OR doc_id < cutoff),
delivered AS (
  SELECT *, 0 AS pos FROM open
  UNION ALL
  SELECT * REPLACE (url || '/b' AS url, NULL AS published_at), 1 AS pos FROM open),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY run, provider_rank, doc_id, pos) AS rn
  FROM delivered),
fresh AS (SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1)""",
            _ASSIGNED,
        )
        + f"SELECT CAST(substr(symbol, 4) AS BIGINT) AS stock_id, {_shown_articles()} FROM assigned",
        "stream_dedup": _with(
            _ARTICLES,
            """breaks AS (
  SELECT *, CASE WHEN doc_id - lag(doc_id) OVER (PARTITION BY url ORDER BY doc_id) <= 1440 THEN 0 ELSE 1 END AS fresh
  FROM articles),
chains AS (SELECT *, sum(fresh) OVER (PARTITION BY url ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS chain FROM breaks),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY url, chain ORDER BY provider_rank, symbol_rank, doc_id) AS rn
  FROM chains)""",
        )
        + """SELECT doc_id, provider_rank, symbol_rank, source_api, symbol, source, url, published_at
FROM ranked WHERE rn = 1""",
        "normalize_feed_compact_ts": _feed("Alpha Vantage", 0),
        "normalize_feed_epoch": _feed("Finnhub", 1),
        "normalize_feed_plain": _feed("Marketaux", 2),
        "normalize_feed_nested": _feed("yfinance", 3),
    }
    return sql
