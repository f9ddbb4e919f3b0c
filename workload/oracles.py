"""SQL for DuckDB with the same results as the registered queries.

Written apart from the Spark code: only the fixed values and the derived tables
are shared.
"""

from __future__ import annotations

from tidings.fixed_values import (
    CURRENCY, FORMS, GUIDANCE, GUIDANCE_TAIL, IR_KEYWORDS, METRICS, NO_FIGURES_NOTE, NUMBER,
    ORDINAL_QUARTERS, PERIODS, RNS_KEYWORDS, UNIT, YOY_PHRASE, YOY_REACH, YOY_VERB,
)
from workload.tables import cte


def _text(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


def _stamp(sql: str) -> str:
    return f"strftime({sql}, '%Y-%m-%d %H:%M:%S')"


_RANK = "CASE source WHEN 'edgar' THEN 0 WHEN 'lse' THEN 1 ELSE 2 END"
_FORM_LIST = ", ".join(f"'{f}'" for f in FORMS)

_RESOLVED = """resolved AS (
  SELECT i.issuer_id, i.name, i.ticker,
         coalesce(lpad(CAST(i.cik AS VARCHAR), 10, '0'), m.cik10) AS cik10
  FROM issuers i LEFT JOIN ticker_map m ON i.cik IS NULL AND lower(i.ticker) = m.ticker_key
  WHERE i.cik IS NOT NULL OR m.cik10 IS NOT NULL)"""


# -- figures -----------------------------------------------------------------
def _marked(metric: str) -> str:
    _, label, gap = METRICS[metric]
    amount = rf"{CURRENCY}\s*{NUMBER}" if metric == "eps" else rf"{CURRENCY}\s*{NUMBER}(?:\s*{UNIT})?|{NUMBER}\s*{UNIT}"
    return _text(rf"(?i)({label}[^\n\r]{{0,{gap}}}?({amount}))")


def _bare(metric: str) -> str:
    """First number after the label that is neither a year nor a percentage."""
    _, label, gap = METRICS[metric]
    after = f"regexp_extract(text, {_text(f'(?is){label}(.*)$')}, 1)"
    numbers = f"regexp_extract_all({after}, {_text(rf'\s({NUMBER})(?:[.,;)]?(?:\s+[^\s%]|$))')}, 1)"
    return f"list_filter({numbers}, lambda n: NOT regexp_matches(n, '^(19|20)\\d\\d$'))[1]"


def _squash(sql: str) -> str:
    return f"trim(regexp_replace({sql}, '\\s+', ' ', 'g'))"


def _current(metric: str) -> str:
    return _squash(f"coalesce(nullif(regexp_extract(text, {_marked(metric)}, 2), ''), {_bare(metric)})")


def _yoy(metric: str) -> str:
    hit = f"nullif(regexp_extract(text, {_marked(metric)}, 1), '')"
    at = f"strpos(text, {hit})"
    first = f"greatest(1, {at} - {YOY_REACH})"
    near = f"substr(text, {first}, {at} + length({hit}) + {YOY_REACH} - {first})"

    def change(pattern):
        verb, figure = (f"nullif(regexp_extract({near}, {_text(pattern)}, {g}), '')" for g in (1, 2))
        return f"CASE WHEN {figure} IS NOT NULL THEN concat_ws(' ', {verb}, {figure}) END"

    return _squash(f"coalesce({change(YOY_PHRASE)}, {change(YOY_VERB)})")


def _period(title: str = "title") -> str:
    options = []
    for blob in (title, "substr(text, 1, 1000)"):
        for pattern in PERIODS:
            name = f"upper(regexp_extract({blob}, {_text(pattern)}, 1))"
            words = " ".join(f"WHEN '{w.upper()}' THEN '{q}'" for w, q in ORDINAL_QUARTERS.items())
            shown = f"CASE {name} {words} ELSE {name} END"
            options.append(f"CASE WHEN {name} <> '' THEN concat({shown}, ' ', regexp_extract({blob}, {_text(pattern)}, 2)) END")
    return "coalesce(" + ",\n".join(options) + ")"


# Two matches, unrolled: positions first, then the sentence around each.
_GUIDANCE = f"""
hits AS (SELECT *, regexp_extract_all(text, {_text(GUIDANCE)}) AS h FROM docs),
at1 AS (SELECT *, strpos(text, h[1]) AS p1, strpos(text, h[1]) + length(h[1]) AS e1 FROM hits),
at2 AS (SELECT *, e1 - 1 + strpos(substr(text, e1), h[2]) AS p2, e1 - 1 + strpos(substr(text, e1), h[2]) + length(h[2]) AS e2 FROM at1),
snippets AS (SELECT *,
  {_squash("concat(regexp_extract(substr(text, 1, p1 - 1), '[^.]*$'), h[1], CASE WHEN contains(substr(text, e1), '.') THEN regexp_extract(substr(text, e1), '^[^.]*[.]') ELSE substr(substr(text, e1), 1, " + str(GUIDANCE_TAIL) + ") END)")} AS s1,
  {_squash("concat(regexp_extract(substr(text, 1, p2 - 1), '[^.]*$'), h[2], CASE WHEN contains(substr(text, e2), '.') THEN regexp_extract(substr(text, e2), '^[^.]*[.]') ELSE substr(substr(text, e2), 1, " + str(GUIDANCE_TAIL) + ") END)")} AS s2
  FROM at2),
guided AS (SELECT *, CASE WHEN len(h) = 0 THEN [] WHEN len(h) = 1 OR s1 = s2 THEN [s1] ELSE [s1, s2] END AS guidance FROM snippets)"""

_DOCS = cte("announcements") + ",\ndocs AS (SELECT * FROM announcements)"
_READ = _DOCS + "," + _GUIDANCE + """,
read AS (SELECT doc_id, url, text, guidance, coalesce(nullif(title, ''), url) AS headline, """ + _period() + """ AS period,
""" + ",\n".join(f"{_current(m)} AS {m}_current, {_yoy(m)} AS {m}_yoy" for m in METRICS) + """ FROM guided),
shown AS (SELECT *, """ + ", ".join(
    f"CASE WHEN {m}_yoy IS NOT NULL THEN concat({m}_current, ' (', {m}_yoy, ')') ELSE {m}_current END AS {m}_shown"
    for m in METRICS) + """ FROM read),
lists AS (SELECT *, list_filter([""" + ", ".join(
    f"CASE WHEN {m}_shown IS NOT NULL THEN concat('{label}: ', {m}_shown) END" for m, (label, _, _) in METRICS.items()) + """],
    lambda b: b IS NOT NULL) AS bullets FROM shown),
payload AS (SELECT *, list_concat(bullets, list_filter(guidance, lambda g: NOT list_contains(bullets, g)))[1:6] AS highlights,
  coalesce(nullif(concat_ws(' ', CASE WHEN period IS NOT NULL THEN concat(period, ' results:') END, """ + ", ".join(
    f"CASE WHEN {m}_shown IS NOT NULL THEN concat('{label} ', {m}_shown) END" for m, (label, _, _) in METRICS.items()) + f"""), ''), headline) AS short_summary,
  CASE WHEN len(bullets) = 0 THEN '{NO_FIGURES_NOTE}' END AS final_thoughts FROM lists)
"""

# -- pages -------------------------------------------------------------------
_BODY = "body"
for _tag in ("script", "style", "nav", "footer", "header", "aside", "form"):
    _BODY = f"regexp_replace({_BODY}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', ' ', 'g')"
_BODY = f"""regexp_replace({_BODY}, '(?is)<div class="ad">.*?</div>', ' ', 'g')"""
_BODY = f"regexp_replace(regexp_replace({_BODY}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"


def _decoded(sql: str) -> str:
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        sql = f"replace({sql}, {_text(entity)}, {_text(character)})"
    return sql


_TITLE = "nullif(trim(" + _decoded("regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1)") + "), '')"

# -- news --------------------------------------------------------------------
_WANTED = (
    f"CASE source WHEN 'lse' THEN regexp_matches(title, {_text(f'(?i)({RNS_KEYWORDS})')})"
    f" WHEN 'ir' THEN regexp_matches(title, {_text(f'(?i)({IR_KEYWORDS})')}) ELSE true END"
)
_ONCE = cte("news_items") + f""",
once AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY {_RANK}, item_idx) AS nth FROM news_items WHERE url <> '') WHERE nth = 1)"""

_ARTICLES = """articles AS (
  SELECT url, min(event_id) AS k FROM event_times GROUP BY url),
read_articles AS (
  SELECT url, k, concat('Q', k % 4 + 1, ' 2023') AS period, concat('$', k % 900 + 1, '.5 million') AS revenue,
         concat('up ', k % 60, '.2%') AS yoy FROM articles WHERE k % 13 <> 0)"""
_ALERT_COLUMNS = """concat('[Earnings Watch] ', coalesce(nullif(title, ''), concat('Notice ', k))) AS subject,
  concat(CASE WHEN title = 'Q3 2023 Results' THEN 'Q3 2023' ELSE period END, ' results: Revenue ', revenue, ' (', yoy, ')') AS short_summary"""

_EDGAR = f"""captured AS (SELECT * FROM primary_captures UNION ALL SELECT * FROM index_captures),
numbered AS (SELECT *, filing_id // 1000 AS block,
  row_number() OVER (PARTITION BY cik10, filing_id // 1000 ORDER BY filing_id) - 1 AS pos,
  count(*) OVER (PARTITION BY cik10, filing_id // 1000) AS n FROM filings),
wanted AS (SELECT n.*, coalesce(r.ticker, r.name) AS epic,
  concat('https://www.sec.gov/Archives/edgar/data/', CAST(n.cik10 AS BIGINT), '/', replace(accession, '-', ''), '/') AS folder
  FROM numbered n JOIN resolved r ON n.cik10 = r.cik10 WHERE pos < n - block % 2 AND form IN ({_FORM_LIST})
    AND try_cast(filing_date AS TIMESTAMP) >= TIMESTAMP '2001-08-01 12:00:00' - INTERVAL 90 DAY),
met AS (SELECT w.*, p.body AS primary_body, i.body AS index_body,
    regexp_extract(i.body, 'href="([^"]+)"[^>]*>EX-99[.]1', 1) AS exhibit
  FROM wanted w
  LEFT JOIN captured p ON p.url = concat(folder, primary_doc) AND p.status < 400
  LEFT JOIN captured i ON i.url = concat(folder, accession, '-index.html') AND i.status < 400),
chosen AS (SELECT *, CASE
    WHEN primary_body IS NOT NULL AND (form <> '8-K' OR contains(primary_body, 'Item 2.02')) THEN concat(folder, primary_doc)
    WHEN primary_body IS NOT NULL AND index_body IS NULL THEN NULL
    WHEN primary_body IS NOT NULL AND exhibit <> '' THEN concat(folder, exhibit)
    WHEN primary_body IS NOT NULL THEN concat(folder, primary_doc)
    WHEN index_body IS NOT NULL THEN concat(folder, accession, '-index.html') END AS url FROM met)"""

_LONDON_URL = "concat('https://www.londonstockexchange.com/news-article/', CASE WHEN item_idx % 2 = 0 THEN lower(epic) ELSE epic END, '/', item_idx)"
_LONDON = f"""lse AS (SELECT * FROM news_items WHERE source = 'lse' AND page_no <= 2),
listed AS (SELECT epic, page_no, title, concat('https://www.londonstockexchange.com/news-article/',
    CASE WHEN item_idx % 2 = 0 THEN lower(epic) ELSE epic END, '/', item_idx) AS url,
  CASE item_idx % 3 WHEN 0 THEN published_at WHEN 1 THEN date_trunc('minute', published_at)
    ELSE date_trunc('day', published_at) END AS dated FROM lse WHERE title <> ''),
facts AS (SELECT epic, page_no, max(dated) AS newest, count(*) AS n_items, count(dated) AS n_dated FROM listed GROUP BY epic, page_no),
flags AS (SELECT p.epic, p.page_no,
  CASE WHEN f.n_items IS NULL OR (f.n_dated = f.n_items AND f.newest < TIMESTAMP '2024-01-17') THEN 1 ELSE 0 END AS stops
  FROM (SELECT DISTINCT epic, page_no FROM lse) p LEFT JOIN facts f ON p.epic = f.epic AND p.page_no = f.page_no),
reached AS (SELECT epic, page_no FROM flags f
  WHERE NOT EXISTS (SELECT 1 FROM flags e WHERE e.epic = f.epic AND e.page_no < f.page_no AND e.stops = 1))"""

_PAGING = cte("news_items", "event_times") + """,
lse AS (SELECT * FROM news_items WHERE source = 'lse'),
users AS (SELECT DISTINCT user_id FROM event_times),
pages_read AS (SELECT concat('E', user_id) AS epic, n AS page_no
  FROM users CROSS JOIN (VALUES (1), (2), (3)) v(n) WHERE (user_id + n) % 17 <> 0),
facts AS (SELECT epic, page_no, max(published_at) AS newest, count(*) AS n_items, count(published_at) AS n_dated
  FROM lse GROUP BY epic, page_no),
flags AS (SELECT p.epic, p.page_no,
  CASE WHEN f.n_items IS NULL OR (f.n_dated = f.n_items AND f.newest < TIMESTAMP '2024-01-17') THEN 1 ELSE 0 END AS stops
  FROM pages_read p LEFT JOIN facts f ON p.epic = f.epic AND p.page_no = f.page_no),
reached AS (SELECT epic, page_no FROM (SELECT *, coalesce(sum(stops) OVER (
  PARTITION BY epic ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM flags) WHERE stopped = 0)
SELECT i.item_idx, i.epic, i.page_no, """ + _stamp("i.published_at") + """ AS published
FROM lse i JOIN reached r ON i.epic = r.epic AND i.page_no = r.page_no
WHERE i.published_at IS NULL OR i.published_at >= TIMESTAMP '2024-01-17'"""


def _figure(metric: str) -> str:
    return f"{_DOCS} SELECT doc_id, {_current(metric)} AS current FROM docs"


_LINKS = cte("captures") + """,
anchors AS (SELECT page_id, url, unnest(regexp_extract_all(body, '<li><a href="([^"]*)"[^>]*>[^<]*</a>', 1)) AS href,
    unnest(regexp_extract_all(body, '<li><a href="[^"]*"[^>]*>([^<]*)</a>', 1)) AS shown,
    generate_subscripts(regexp_extract_all(body, '<li><a href="([^"]*)"[^>]*>[^<]*</a>', 1), 1) AS pos
  FROM captures WHERE status < 400),
resolved AS (SELECT page_id, pos, concat(regexp_extract(url, '^(https?://[^/]*)', 1), """ + _decoded("href") + """) AS item_url,
    trim(""" + _decoded("shown") + """) AS title FROM anchors),
links AS (SELECT page_id, item_url, title FROM (SELECT *, row_number() OVER (PARTITION BY page_id, item_url ORDER BY pos) AS nth
  FROM resolved WHERE title <> '') WHERE nth = 1)"""


ORACLES = {
    "issuer_cik_lookup": cte("issuers", "ticker_map") + """,
listed AS (SELECT 0 AS part, issuer_id, name, ticker, cik FROM issuers
  UNION ALL SELECT 1, issuer_id, NULL, lower(ticker), NULL FROM issuers WHERE ticker IS NOT NULL),
keyed AS (SELECT *, coalesce(CAST(cik AS VARCHAR), lower(ticker)) AS k FROM listed),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY part, issuer_id) AS nth
  FROM keyed WHERE k IS NOT NULL) WHERE nth = 1)
SELECT part, issuer_id, name, ticker, coalesce(lpad(CAST(cik AS VARCHAR), 10, '0'), m.cik10) AS cik10
FROM once LEFT JOIN ticker_map m ON cik IS NULL AND lower(ticker) = m.ticker_key
WHERE cik IS NOT NULL OR m.cik10 IS NOT NULL""",

    "ticker_directory_json": cte("ticker_map") + " SELECT ticker_key, cik10 FROM ticker_map",

    "submissions_to_rows": cte("issuers", "ticker_map", "filings") + ",\n" + _RESOLVED + """,
numbered AS (SELECT *, filing_id // 1000 AS block,
  row_number() OVER (PARTITION BY cik10, filing_id // 1000 ORDER BY filing_id) - 1 AS pos,
  count(*) OVER (PARTITION BY cik10, filing_id // 1000) AS n FROM filings)
SELECT f.cik10, f.block, f.pos, r.name, f.form, f.filing_date, f.accession, f.primary_doc
FROM numbered f JOIN resolved r ON f.cik10 = r.cik10 WHERE f.pos < f.n - f.block % 2""",

    "filings_in_window": cte("filings") + f"""
SELECT filing_id, form, filing_date, accession FROM filings
WHERE form IN ({_FORM_LIST})
  AND try_cast(filing_date AS TIMESTAMP) >= TIMESTAMP '2001-08-01 12:00:00' - INTERVAL 90 DAY""",

    "filing_urls_titles": cte("issuers", "ticker_map", "filings") + ",\n" + _RESOLVED + """
SELECT filing_id,
  concat('https://www.sec.gov/Archives/edgar/data/', CAST(f.cik10 AS BIGINT), '/', replace(accession, '-', ''), '/', primary_doc) AS primary_url,
  concat('https://www.sec.gov/Archives/edgar/data/', CAST(f.cik10 AS BIGINT), '/', replace(accession, '-', ''), '/', accession, '-index.html') AS index_url,
  concat(form, ' ', coalesce(ticker, name), ' (', filing_date, ')') AS title
FROM filings f JOIN resolved r ON f.cik10 = r.cik10""",

    "filing_document_choice": cte("filings", "primary_captures", "index_captures") + f""",
captured AS (SELECT * FROM primary_captures UNION ALL SELECT * FROM index_captures),
wanted AS (SELECT filing_id, form,
  concat('https://www.sec.gov/Archives/edgar/data/', CAST(cik10 AS BIGINT), '/', replace(accession, '-', ''), '/') AS folder,
  primary_doc, accession FROM filings WHERE form IN ({_FORM_LIST})),
met AS (SELECT w.*, p.body AS primary_body, i.body AS index_body,
    regexp_extract(i.body, 'href="([^"]+)"[^>]*>EX-99[.]1', 1) AS exhibit
  FROM wanted w
  LEFT JOIN captured p ON p.url = concat(folder, primary_doc) AND p.status < 400
  LEFT JOIN captured i ON i.url = concat(folder, accession, '-index.html') AND i.status < 400),
chosen AS (SELECT filing_id, form, CASE
    WHEN primary_body IS NOT NULL AND (form <> '8-K' OR contains(primary_body, 'Item 2.02')) THEN concat(folder, primary_doc)
    WHEN primary_body IS NOT NULL AND index_body IS NULL THEN NULL
    WHEN primary_body IS NOT NULL AND exhibit <> '' THEN concat(folder, exhibit)
    WHEN primary_body IS NOT NULL THEN concat(folder, primary_doc)
    WHEN index_body IS NOT NULL THEN concat(folder, accession, '-index.html') END AS url FROM met)
SELECT filing_id, form, url FROM chosen WHERE url IS NOT NULL""",

    "news_keyword_rns": cte("news_items") + f"""
SELECT item_idx, source, url, title FROM news_items WHERE regexp_matches(title, {_text(f'(?i)({RNS_KEYWORDS})')})""",
    "news_keyword_ir": cte("news_items") + f"""
SELECT item_idx, source, url, title FROM news_items WHERE regexp_matches(title, {_text(f'(?i)({IR_KEYWORDS})')})""",

    "news_in_window": cte("news_items") + f"""
SELECT item_idx, url, {_stamp('published_at')} AS published FROM news_items
WHERE published_at IS NULL OR published_at >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY""",

    "news_paging_stop": _PAGING,

    "news_quarantine": cte("news_items") + " SELECT item_idx, source, 'empty url' AS reason, title FROM news_items WHERE url = ''",

    "feed_entries": cte("news_items") + f"""
SELECT epic, item_idx // 200 AS block, url, title, {_stamp("date_trunc('day', published_at)")} AS published
FROM news_items WHERE url <> '' AND title <> ''""",

    "date_formats": cte("news_items") + f""",
shown AS (SELECT item_idx, published_at AS ts, CASE item_idx % 6
    WHEN 0 THEN strftime(published_at, '%d %b %Y %H:%M') WHEN 1 THEN strftime(published_at, '%-d %b %Y')
    WHEN 2 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') WHEN 3 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%S+0100')
    WHEN 4 THEN strftime(published_at, '%Y-%m-%d') ELSE strftime(published_at, '%Y-%m-%dT%H:%M:%S') END AS shown FROM news_items)
SELECT item_idx, shown, {_stamp('''CASE item_idx % 6 WHEN 0 THEN date_trunc('minute', ts) WHEN 1 THEN date_trunc('day', ts)
    WHEN 2 THEN ts WHEN 3 THEN ts - INTERVAL 1 HOUR WHEN 4 THEN date_trunc('day', ts) END''')} AS published FROM shown""",

    "first_source_wins": _ONCE + " SELECT url, source, item_idx, title FROM once",
    "unseen_items": _ONCE.replace("WITH ", cte("seen_rows") + ",\n", 1) + """
SELECT url, source, item_idx, title FROM once WHERE url NOT IN (SELECT url FROM seen_rows)""",

    "ledger_formats": cte("seen_rows", "news_items") + """
SELECT url FROM seen_rows UNION SELECT url FROM news_items WHERE url <> ''""",

    "page_titles": cte("captures") + f"""
SELECT page_id, {_TITLE} AS title_html, coalesce({_TITLE}, url) AS headline FROM captures WHERE status < 400""",
    "page_clean_text": cte("captures") + f"""
SELECT page_id, {_TITLE} AS title_html, {_squash(_decoded(_BODY))} AS text FROM captures WHERE status < 400""",

    "page_links": _LINKS + """
SELECT page_id, 1 AS selector_rank, item_url, title, CAST(NULL AS VARCHAR) AS published FROM links""",
    "ir_links_sql": _LINKS + " SELECT page_id, item_url, title FROM links",
    "damaged_pages": _LINKS + """
SELECT page_id, item_url, title, CAST(NULL AS VARCHAR) AS quarantine FROM links
UNION ALL SELECT page_id, 'http://[bad/x', 'Bad', 'address not resolved' FROM captures WHERE status < 400 AND page_id % 4 = 1""",
    "ledger_round_trip": cte("seen_rows") + " SELECT DISTINCT url FROM seen_rows",
    "filings_override_forms": cte("filings") + " SELECT filing_id, form FROM filings WHERE form IN ('SC 13G', '8-K')",
    "news_own_keywords": cte("news_items") + """
SELECT item_idx, source, url, title FROM news_items WHERE url <> '' AND (published_at IS NULL OR published_at >= TIMESTAMP '2024-01-17')
  AND CASE source WHEN 'lse' THEN regexp_matches(title, '(?i)(board)') WHEN 'ir' THEN regexp_matches(title, '(?i)(directorate|update)') ELSE true END""",
    "comma_lists": """
SELECT o_orderkey, 3 AS n, concat_ws('|', o_orderpriority, o_orderstatus, CAST(o_custkey AS VARCHAR)) AS parts FROM orders""",

    "rns_listing": cte("news_items") + f"""
SELECT epic, page_no, concat('https://www.londonstockexchange.com/news-article/',
    CASE WHEN item_idx % 2 = 0 THEN lower(epic) ELSE epic END, '/', item_idx) AS item_url, title,
  {_stamp('''CASE item_idx % 3 WHEN 0 THEN published_at WHEN 1 THEN date_trunc('minute', published_at)
    ELSE date_trunc('day', published_at) END''')} AS published
FROM news_items WHERE source = 'lse' AND title <> ''""",

    "detail_dates": cte("news_items", "event_times") + f""",
details AS (SELECT url, min(ts) AS ts, min(event_id) AS first_id FROM event_times GROUP BY url)
SELECT i.item_idx, i.url, i.title, {_stamp(f'''coalesce(i.published_at,
    CASE WHEN regexp_matches(i.title, {_text(f'(?i)({RNS_KEYWORDS})')}) AND d.first_id % 13 <> 0
      THEN CASE WHEN d.first_id % 2 = 0 THEN date_trunc('minute', d.ts) ELSE d.ts END END)''')} AS published
FROM news_items i LEFT JOIN details d ON i.url = d.url WHERE i.source = 'lse' AND i.url <> ''""",

    **{f"kpi_{m}": _figure(m) for m in METRICS},
    "kpi_yoy": _DOCS + " SELECT doc_id, " + ", ".join(f"{_yoy(m)} AS {m}_yoy" for m in METRICS) + " FROM docs",
    "report_period": _DOCS + f" SELECT doc_id, {_period()} AS period FROM docs",
    "guidance_sentences": _DOCS + "," + _GUIDANCE + """
SELECT doc_id, len(guidance) AS n, array_to_string(guidance, ' | ') AS guidance FROM guided""",
    "summary_payload": _READ + """SELECT doc_id, headline, url AS final_url, short_summary,
  array_to_string(highlights, ' | ') AS key_highlights, """ + ", ".join(
        f"{m}_{part}" for m in METRICS for part in ("current", "yoy")) + ", final_thoughts FROM payload",
    "alert_text": _READ + """SELECT doc_id, concat('[Earnings Watch] ', headline) AS subject,
  concat('Headline: ', headline, chr(10), 'URL: ', url, chr(10), chr(10), 'Summary: ', short_summary,
    CASE WHEN len(highlights) > 0 THEN concat(chr(10), chr(10), 'Key Highlights:', chr(10), ' - ', array_to_string(highlights, chr(10) || ' - ')) ELSE '' END,
    CASE WHEN len(bullets) > 0 THEN concat(chr(10), chr(10), 'Metrics:', chr(10), ' - ', array_to_string(bullets, chr(10) || ' - ')) ELSE '' END,
    CASE WHEN final_thoughts IS NOT NULL THEN concat(chr(10), chr(10), 'Notes: ', final_thoughts) ELSE '' END, chr(10)) AS body
FROM payload""",
    "corpus_kpi_scan": cte("corpus") + " SELECT doc_id, " + _period("CAST(NULL AS VARCHAR)") + " AS period, " + ", ".join(
        f"{_current(m)} AS {m}" for m in METRICS) + " FROM corpus",

    "edgar_items": cte("issuers", "ticker_map", "filings", "primary_captures", "index_captures") + ",\n" + _RESOLVED + ",\n" + _EDGAR + f"""
SELECT 'edgar' AS source, epic, url, concat(form, ' ', epic, ' (', filing_date, ')') AS title,
  concat(filing_date, ' 00:00:00') AS published FROM chosen WHERE url IS NOT NULL""",

    "london_items": cte("news_items") + ",\n" + _LONDON + f"""
SELECT 'lse' AS source, l.epic, url, title, {_stamp('dated')} AS published
FROM listed l JOIN reached r ON l.epic = r.epic AND l.page_no = r.page_no
WHERE regexp_matches(title, {_text(f'(?i)({RNS_KEYWORDS})')}) AND (dated IS NULL OR dated >= TIMESTAMP '2024-01-17')""",

    "ir_items": cte("news_items") + f"""
SELECT 'ir' AS source, epic, url, title, {_stamp("date_trunc('day', published_at)")} AS published
FROM news_items WHERE url <> '' AND title <> '' AND regexp_matches(title, {_text(f'(?i)({IR_KEYWORDS})')})
  AND (published_at IS NULL OR date_trunc('day', published_at) >= TIMESTAMP '2024-01-17')""",

    "sources_to_alerts": cte("news_items", "event_times", "seen_rows", "issuers", "ticker_map", "filings", "primary_captures", "index_captures")
    + ",\n" + _RESOLVED + ",\n" + _EDGAR + ",\n" + _LONDON + f""",
pages AS (
  SELECT url, min(event_id) AS k FROM event_times GROUP BY url
  UNION ALL SELECT {_LONDON_URL}, item_idx FROM news_items WHERE source = 'lse'
  UNION ALL SELECT url, CAST(regexp_extract(url, '/d([0-9]+)[.]htm$', 1) AS BIGINT) FROM primary_captures),
read_pages AS (
  SELECT url, k, concat('Q', k % 4 + 1, ' 2023') AS period, concat('$', k % 900 + 1, '.5 million') AS revenue,
         concat('up ', k % 60, '.2%') AS yoy FROM pages WHERE k % 13 <> 0),
items AS (
  SELECT 0 AS rank, 'edgar' AS source, epic, 0 AS idx, url, concat(form, ' ', epic, ' (', filing_date, ')') AS title FROM chosen
  WHERE url IS NOT NULL AND try_cast(filing_date AS TIMESTAMP) >= TIMESTAMP '2001-07-25'
  UNION ALL
  SELECT 1, 'lse', l.epic, 0, url, title FROM listed l JOIN reached r ON l.epic = r.epic AND l.page_no = r.page_no
  WHERE regexp_matches(title, {_text(f'(?i)({RNS_KEYWORDS})')}) AND (dated IS NULL OR dated >= TIMESTAMP '2024-01-24')
  UNION ALL
  SELECT 2, 'ir', epic, item_idx, url, title FROM news_items
  WHERE url <> '' AND title <> '' AND regexp_matches(title, {_text(f'(?i)({IR_KEYWORDS})')})
    AND (published_at IS NULL OR date_trunc('day', published_at) >= TIMESTAMP '2024-01-24')
  UNION ALL
  SELECT 2, 'ir', epic, item_idx, {_LONDON_URL}, title FROM news_items
  WHERE source = 'lse' AND item_idx % 5 = 1 AND title <> '' AND regexp_matches(title, {_text(f'(?i)({IR_KEYWORDS})')})),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY rank, idx) AS nth FROM items) WHERE nth = 1)
SELECT o.url, source, epic, {_ALERT_COLUMNS}
FROM once o JOIN read_pages a ON o.url = a.url WHERE o.url NOT IN (SELECT url FROM seen_rows)""",

    "ledger_buckets": cte("filings") + """
SELECT filing_id, concat('https://www.sec.gov/Archives/edgar/data/', CAST(CAST(cik10 AS BIGINT) AS VARCHAR), '/', replace(accession, '-', ''), '/', primary_doc) AS url
FROM filings WHERE filing_id % 51 = 0""",

    "own_selectors": cte("news_items") + f"""
SELECT epic, 0 AS selector_rank, concat('https://ir.example.com/n/', item_idx) AS item_url, title, {_stamp("""coalesce(
    CASE item_idx % 3 WHEN 0 THEN date_trunc('day', published_at) WHEN 1 THEN published_at END, TIMESTAMP '2024-01-15 08:00:00')""")} AS published
FROM news_items WHERE source = 'ir' AND title <> ''
UNION ALL
SELECT epic, 2, concat('https://ir.example.com/extra/', item_idx), 'Extra', '2024-01-15 08:00:00'
FROM news_items WHERE source = 'ir' AND item_idx % 4 = 1
UNION ALL
SELECT epic, 2, concat('https://ir.example.com/n/', item_idx), 'Again', '2024-01-15 08:00:00'
FROM news_items WHERE source = 'ir' AND item_idx % 4 = 0 AND title = ''""",

    "sources_switched": cte("news_items") + f"""
SELECT 'ir' AS source, epic, url, title, {_stamp("date_trunc('day', published_at)")} AS published
FROM news_items WHERE url <> '' AND title <> '' AND regexp_matches(title, {_text(f'(?i)({IR_KEYWORDS})')})
  AND (published_at IS NULL OR date_trunc('day', published_at) >= TIMESTAMP '2024-01-17')
  AND CAST(substr(epic, 2) AS BIGINT) % 10 <> 0""",

    "pdf_alerts": cte("news_items", "event_times", "seen_rows") + ",\n" + _ARTICLES + f""",
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY {_RANK}, item_idx) AS nth
  FROM news_items WHERE url <> '' AND {_WANTED}) WHERE nth = 1),
told AS (SELECT o.url, source, item_idx, k % 4 < 2 AS pdf, CASE WHEN k % 4 = 1 THEN o.url || '.PDF' ELSE o.url END AS final_url, title, k, revenue, yoy,
    coalesce(nullif(title, ''), o.url) AS pdf_headline, {_ALERT_COLUMNS}
  FROM once o JOIN read_articles a ON o.url = a.url WHERE o.url NOT IN (SELECT url FROM seen_rows)),
shown AS (SELECT url, source, item_idx, pdf, final_url, revenue, yoy, CASE WHEN pdf THEN concat('[Earnings Watch] ', pdf_headline) ELSE subject END AS subject,
    CASE WHEN NOT pdf THEN short_summary WHEN title = 'Q3 2023 Results' THEN 'Q3 2023 results:' ELSE pdf_headline END AS short_summary FROM told)
SELECT url, source, item_idx, subject, short_summary,
  concat('Headline: ', substr(subject, 18), chr(10), 'URL: ', final_url, chr(10), chr(10), 'Summary: ', short_summary, chr(10), chr(10),
    CASE WHEN pdf THEN concat('Notes: ', {_text(NO_FIGURES_NOTE)}) ELSE concat(
    'Key Highlights:', chr(10), ' - Revenue: ', revenue, ' (', yoy, ')', chr(10), ' - The outlook is stable.', chr(10), chr(10),
    'Metrics:', chr(10), ' - Revenue: ', revenue, ' (', yoy, ')') END, chr(10)) AS body FROM shown""",

    "batch_alerts": cte("news_items", "event_times", "seen_rows") + ",\n" + _ARTICLES + f""",
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY {_RANK}, item_idx) AS nth
  FROM news_items WHERE url <> '' AND {_WANTED}) WHERE nth = 1),
told AS (SELECT o.url, source, item_idx, title, k, revenue, yoy, {_ALERT_COLUMNS}
  FROM once o JOIN read_articles a ON o.url = a.url WHERE o.url NOT IN (SELECT url FROM seen_rows))
SELECT url, source, item_idx, subject, short_summary,
  concat('Headline: ', substr(subject, 18), chr(10), 'URL: ', url, chr(10), chr(10), 'Summary: ', short_summary, chr(10), chr(10),
    'Key Highlights:', chr(10), ' - Revenue: ', revenue, ' (', yoy, ')', chr(10), ' - The outlook is stable.', chr(10), chr(10),
    'Metrics:', chr(10), ' - Revenue: ', revenue, ' (', yoy, ')', chr(10)) AS body FROM told""",

    "incremental_alerts": cte("news_items", "news_slices", "event_times", "seen_rows") + ",\n" + _ARTICLES + f""",
sliced AS (SELECT n.*, s.slice AS batch_id FROM news_items n JOIN news_slices s ON n.item_idx = s.item_idx),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY batch_id, {_RANK}, item_idx) AS nth
  FROM sliced WHERE url <> '' AND {_WANTED}) WHERE nth = 1)
SELECT o.url, source, item_idx, CASE WHEN k % 3 = 0 THEN 2 ELSE batch_id END AS batch_id, {_ALERT_COLUMNS}
FROM once o JOIN read_articles a ON o.url = a.url WHERE o.url NOT IN (SELECT url FROM seen_rows)""",

    "outbox_in_order": cte("news_items", "event_times", "seen_rows") + ",\n" + _ARTICLES + f""",
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY {_RANK}, item_idx) AS nth
  FROM news_items WHERE url <> '' AND {_WANTED}) WHERE nth = 1)
SELECT row_number() OVER (ORDER BY {_RANK}, item_idx) AS place, source, item_idx, o.url
FROM once o JOIN read_articles a ON o.url = a.url WHERE o.url NOT IN (SELECT url FROM seen_rows)""",

    "sources_report": cte("news_items") + f""",
recent AS (SELECT * FROM news_items WHERE published_at IS NULL OR published_at >= TIMESTAMP '2024-01-17'),
ir AS (SELECT * FROM news_items WHERE url <> '' AND title <> '' AND regexp_matches(title, {_text(f'(?i)({IR_KEYWORDS})')})
  AND (published_at IS NULL OR date_trunc('day', published_at) >= TIMESTAMP '2024-01-17'))
SELECT 'news' AS source, 'ok' AS status, count(*) FILTER (url <> '') AS valid, count(*) FILTER (url = '') AS malformed,
  count(*) FILTER (url <> '') AS items, CAST(NULL AS BOOLEAN) AS told FROM recent
UNION ALL SELECT 'ir', 'ok', count(*), 0, count(*), NULL FROM ir
UNION ALL SELECT 'damaged', 'failed', NULL, NULL, NULL, true""",

    "ir_pages_sql": _LINKS + " SELECT l.page_id, c.url, c.status, item_url, l.title FROM links l JOIN captures c USING (page_id)",

    "ledger_arrays": cte("news_items") + """
SELECT DISTINCT CASE WHEN item_idx % 50 = 0 THEN concat(url, '?q="a\\",["b\\\\"') ELSE url END AS url FROM news_items WHERE url <> ''""",
}
