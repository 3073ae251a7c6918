"""The questions of :mod:`catalog.spark_queries` in DuckDB SQL.

Written apart from the Spark code: other patterns, other decompositions.  Where
the test pages keep to simple forms (no nested clutter, no quoted '>'), so does the SQL.
"""

from __future__ import annotations

from sitewise import constants as K

# White space in RE2, tags, parts without text.
SPACE = r"\s\x0B\x85\pZ"
TAG = r"<[a-zA-Z/!?][^>]*>"
HIDDEN = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
RULE = "-" * 80


def words(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def decode(x: str) -> str:
    for name, char in (("quot", "'\"'"), ("copy", "'©'"), ("middot", "'·'"), ("amp", "'&'")):
        x = f"replace({x}, '&{name};', {char})"
    return x


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '[{SPACE}]+', ' ', 'g')")


def reduced(html: str) -> str:
    return f"regexp_replace({html}, '{HIDDEN}', chr(1), 'g')"


def one_line(markup: str) -> str:
    return collapse("replace(" + decode(f"regexp_replace({markup}, '{TAG}', chr(1), 'g')") + ", chr(1), ' ')")


def nodes(markup: str, between: str) -> str:
    marked = decode(f"regexp_replace({markup}, '{TAG}', chr(1), 'g')")
    joined = f"regexp_replace({marked}, '[{SPACE}]*\\x01[{SPACE}\\x01]*', {between}, 'g')"
    return strip(joined)


def clean(x: str) -> str:
    x = f"regexp_replace({x}, '[\\x{{00A0}}\\t\\r]+', ' ', 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(f"regexp_replace({x}, ' {{2,}}', ' ', 'g')")


def lines(markup: str) -> str:
    return clean(nodes(markup, "chr(10)"))


def decluttered(markup: str) -> str:
    blocks = " || ".join(
        f"regexp_extract_all({markup}, '(?is)<{t}[\\s>].*?</{t}>')" for t in K.CLUTTER_TAGS
    )
    short = f"list_filter({blocks}, lambda b: length({nodes('b', chr(39) + ' ' + chr(39))}) < 400)"
    return f"list_reduce([{markup}] || {short}, lambda a, b: replace(a, b, chr(1)))"


BLOCK = "p|div|section|article|main|aside|header|footer|nav|form|ul|ol|dl|table|blockquote|pre|figure|h[1-6]|hr|body|html"


def paragraphs(markup: str) -> str:
    cut = f"regexp_replace(x, '(?is)</?(?:{BLOCK})[\\s/>].*$', '')"
    each = f"list_transform(string_split_regex({markup}, '(?i)<p>')[2:], lambda x: {lines(cut)})"
    return f"array_to_string(list_filter({each}, lambda t: t <> ''), chr(10))"


def densest(markup: str, part: str = "t", between: str = "chr(10)") -> str:
    """The largest difference of prefix sums, a later and the least before it; lists of one stand for names."""
    cut = f"regexp_replace({markup}, '(?i)(</?(?:{BLOCK})[\\s/>])', chr(2) || '\\1', 'g')"
    links = "array_to_string(regexp_extract_all(x, '(?is)<a\\s[^>]*>(.*?)</a\\s*>', 1), ' ')"
    blocks = (
        f"list_filter(list_transform(string_split({cut}, chr(2)), lambda x: {{'m': x, 't': {lines('x')}, 'l': length({lines(links)})}}), "
        "lambda b: b.t <> '')"
    )
    sums = (
        f"list_transform(range(0, len(b) + 1), lambda k: coalesce(list_sum(list_transform(b[1:k], "
        f"lambda x: length(x.t) - {K.LINK_WEIGHT} * x.l - {K.BLOCK_TOLL})), 0))"
    )
    gains = "list_transform(range(1, len(b) + 1), lambda j: s[j + 1] - list_min(s[1:j]))"
    start = "list_max(list_filter(range(1, e + 1), lambda k: s[k] = list_min(s[1:e])))"
    chosen = f"array_to_string(list_transform(b[{start}:e], lambda x: x.{part}), {between})"
    ends = f"list_transform([{gains}], lambda g: list_transform([list_position(g, list_max(g))], lambda e: {chosen})[1])[1]"
    return (
        f"list_transform([{blocks}], lambda b: CASE WHEN len(b) = 0 THEN '' ELSE "
        f"list_transform([{sums}], lambda s: {ends})[1] END)[1]"
    )


def main_text(markup: str, minimum: int) -> str:
    region = lines(f"regexp_extract({markup}, '(?is)<article>(.*)</article>', 1)")
    # A list of one stands for a name, so that the scan is written once.
    run = densest(markup, "m", "''")
    found = f"list_transform([{run}], lambda d: list_transform([{paragraphs('d')}], lambda p: CASE WHEN length(p) > {minimum} THEN p END)[1])[1]"
    return f"CASE WHEN length({region}) > {minimum} THEN {region} ELSE coalesce({found}, {lines(markup)}) END"


def normal(u: str) -> str:
    s = f"regexp_replace({strip(u)}, '[\\t\\r\\n]', '', 'g')"
    v = f"(CASE WHEN regexp_matches({s}, '(?i)^https?://') THEN {s} ELSE 'https://' || {s} END)"
    path = f"regexp_extract({v}, '^[^:]+://[^/?#]*([^?#]*)', 1)"
    query = f"regexp_extract({v}, '^[^?#]*(\\?[^#]*)', 1)"
    return (
        f"CASE WHEN {s} = '' THEN '' ELSE lower(regexp_extract({v}, '^([^:]+)://', 1)) || '://' || "
        f"regexp_extract({v}, '^[^:]+://([^/?#]*)', 1) || coalesce(nullif({path}, ''), '/') || "
        f"CASE WHEN {query} = '?' THEN '' ELSE {query} END END"
    )


HOST = "lower(split_part(url, '/', 3))"


def row_id(value: str, ordinal: str) -> str:
    v = f"lower({strip(value)})"
    return f"CASE WHEN {v} = '' THEN 'row_' || {ordinal} ELSE 'site_' || left(sha1({v}), 12) END"


def hits(u: str) -> str:
    return "(" + " + ".join(f"(contains(lower({u}), '{k}'))::INT" for k in K.KEYWORDS) + ")"


def depth(u: str) -> str:
    return f"(length({u}) - length(replace({u}, '/', '')))"


LINK_SCORE = f"(2 * {hits('url')} + greatest(3 - {depth('url')}, 0))"
HINT_SCORE = f"(3 * {hits('url')} + greatest(4 - {depth('url')}, 0))"

SITES = f"""
sites AS (
  SELECT website, ord, {row_id('website', 'ord')} AS row_id
  FROM (SELECT {HOST} AS website, min(page_id) AS ord FROM pages GROUP BY ALL)
)"""

FETCHES = f"""
normalized AS (SELECT page_id, html, {HOST} AS host, {normal('url')} AS url FROM pages),
fetches AS (
  SELECT page_id, {row_id('host', 'page_id')} AS row_id, url,
    CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^http:', 'https:') ELSE '' END AS final_url,
    CASE WHEN page_id % 23 = 7 THEN 404 WHEN page_id % 31 = 5 THEN 503 ELSE 200 END AS status_code,
    CASE WHEN page_id % 29 = 11 THEN 'application/pdf' WHEN page_id % 3 = 0 THEN ''
      ELSE 'text/html; charset=utf-8' END AS content_type,
    CASE WHEN page_id % 5 = 0 THEN 'playwright' ELSE 'requests' END AS method,
    html, (page_id % 17) * 500 AS elapsed_ms,
    TIMESTAMP '2024-01-01' + to_seconds(page_id) AS fetched_at
  FROM normalized
),
usable AS (
  SELECT *, method = 'playwright' OR (status_code < 400 AND content_type <> 'application/pdf') AS has_html,
    {reduced('html')} AS reduced
  FROM fetches
),
content AS (
  SELECT * EXCLUDE (text, markup),
    CASE WHEN has_html THEN text ELSE '' END AS main_text,
    CASE WHEN has_html THEN length(text) ELSE 0 END AS text_len,
    CASE WHEN has_html THEN strlen(html) ELSE 0 END AS bytes
  FROM (
    SELECT *, {main_text('markup', 200)} AS text
    FROM (SELECT *, {decluttered('reduced')} AS markup FROM usable)
  )
)"""

HEAD = f"""
head AS (
  SELECT page_id,
    CASE WHEN has_html THEN {strip(decode("regexp_extract(reduced, '(?is)<title>(.*?)</title>', 1)"))}
      ELSE '' END AS title,
    CASE WHEN has_html THEN to_json([{collapse(decode("regexp_extract(reduced, '(?is)<h1>(.*?)</h1>', 1)"))}])::VARCHAR
      ELSE '[]' END AS headings
  FROM usable
)"""

RECORDS = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY page_id) - 1 AS pos FROM content
),
budgeted AS (
  SELECT *, pos = 0 AS is_home,
    coalesce(sum(elapsed_ms + CASE WHEN pos = 0 THEN 0 ELSE 600 END) OVER (
      PARTITION BY row_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
  FROM ranked
),
records AS (
  SELECT * EXCLUDE (url), CASE WHEN is_home THEN coalesce(nullif(final_url, ''), url) ELSE url END AS url,
    CASE WHEN is_home THEN text_len > 0 ELSE text_len > 100 END AS ok
  FROM budgeted WHERE pos < 12 AND spent <= 45000
)"""

ROLLUP = f"""
grouped AS (
  SELECT row_id,
    count(*) AS attempted, count(*) FILTER (ok) AS scraped, sum(bytes) AS all_bytes, sum(text_len) AS all_len,
    count(DISTINCT method) AS methods, min(method) AS method,
    string_agg(status_code::VARCHAR, ';' ORDER BY pos) AS statuses,
    string_agg(url, ';' ORDER BY pos) AS visited,
    min(fetched_at) AS started_at, max(fetched_at) AS finished_at,
    coalesce(chr(10) || chr(10) || string_agg('URL: ' || url || chr(10) || main_text,
      chr(10) || chr(10) || '{RULE}' || chr(10) || chr(10) ORDER BY pos) FILTER (ok), '') AS combined
  FROM records GROUP BY row_id
),
homes AS (
  SELECT row_id, url, status_code, has_html, main_text, title, headings
  FROM records JOIN head USING (page_id) WHERE is_home
),
results AS (
  SELECT row_id,
    CASE WHEN has_html AND combined <> '' THEN 'done' ELSE 'error' END AS scrape_status,
    CASE WHEN NOT has_html THEN 'homepage_failed: HTTP ' || status_code
      WHEN combined = '' THEN 'no_text_extracted' ELSE '' END AS error_reason,
    url AS final_url,
    CASE WHEN has_html THEN attempted ELSE 0 END::INT AS pages_attempted,
    CASE WHEN has_html THEN scraped ELSE 0 END::INT AS pages_scraped,
    CASE WHEN NOT has_html THEN '' WHEN methods > 1 THEN 'both' ELSE method END AS methods_used,
    CASE WHEN has_html THEN statuses ELSE '' END AS http_statuses,
    CASE WHEN has_html THEN all_bytes ELSE 0 END::BIGINT AS total_bytes,
    CASE WHEN has_html THEN all_len ELSE 0 END::BIGINT AS total_text_len,
    has_html AND length(combined) > 250000 AS truncated_full,
    has_html AND length(combined) > 8000 AS truncated_preview,
    epoch_us(finished_at - started_at) / 1000000.0::DOUBLE AS duration_sec,
    started_at, finished_at,
    CASE WHEN has_html THEN visited ELSE '' END AS visited_urls,
    CASE WHEN has_html THEN left(combined, 250000) ELSE '' END AS website_text_full,
    CASE WHEN has_html THEN left(combined, 8000) ELSE '' END AS website_text_preview,
    CASE WHEN has_html THEN main_text ELSE '' END AS website_text_main,
    CASE WHEN has_html THEN title ELSE '' END AS site_title,
    '' AS site_meta_description,
    CASE WHEN has_html THEN headings ELSE '' END AS site_headings,
    CASE WHEN has_html THEN length(main_text) ELSE 0 END::INT AS main_text_len,
    CASE WHEN has_html THEN attempted ELSE 0 END::INT AS pages_planned
  FROM grouped JOIN homes USING (row_id)
)"""

SITE_JOB = "WITH " + ",".join((FETCHES, HEAD, RECORDS, ROLLUP))

EARLIER = """
earlier AS (
  SELECT row_id, 'old.' || website AS website, copy AS saved,
    CASE WHEN copy = 1 AND regexp_matches(row_id, '[0-9]$') THEN 'done' ELSE 'error' END AS scrape_status,
    CASE WHEN copy = 1 AND regexp_matches(row_id, '[0-9]$') THEN '' ELSE 'no_text_extracted' END AS error_reason,
    length(website) * copy AS pages_attempted, upper(website) AS site_title
  FROM sites, (VALUES (1), (2)) c(copy) WHERE ord % 3 <> 0
),
old AS (SELECT * FROM earlier QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY saved) = 1)"""

# Tries 0, 1, 2 of a page; the rank of a try is 2 with a browser's content, 1 with usable content.
TRIES = """
tries AS (
  SELECT page_id, row_id, url, n,
    CASE WHEN n = 0 THEN final_url ELSE '' END AS final_url,
    CASE WHEN n = 2 THEN NULL WHEN n = 0 AND page_id % 4 = 0 THEN 503 WHEN n = 0 THEN status_code
      WHEN page_id % 8 = 1 THEN 500 ELSE 200 END AS status_code,
    n > 0 OR content_type <> 'application/pdf' AS is_page,
    CASE WHEN n = 2 THEN 'playwright' ELSE 'requests' END AS method,
    CASE WHEN (n = 0 AND page_id % 4 = 0) OR (n = 2 AND page_id % 6 <> 0) THEN ''
      ELSE html || ['', '<p>again</p>', '<p>rendered</p>'][n + 1] END AS html,
    CASE WHEN n = 0 AND page_id % 4 = 0 THEN 'blocked' WHEN n = 2 AND page_id % 6 <> 0 THEN 'render timeout' ELSE '' END AS error,
    elapsed_ms + 1000 * n AS elapsed_ms, fetched_at + to_hours(n) AS fetched_at
  FROM {fetched}, (VALUES (0), (1), (2)) t(n)
  WHERE n = 0 OR (n = 1 AND page_id % 4 < 2) OR (n = 2 AND page_id % 3 = 0)
),
logged AS (
  SELECT *, CASE WHEN html = '' THEN 0 WHEN n = 2 THEN 2 WHEN status_code < 400 AND is_page THEN 1 ELSE 0 END AS rank FROM tries
  UNION ALL
  SELECT *, CASE WHEN html = '' THEN 0 WHEN status_code < 400 AND is_page THEN 1 ELSE 0 END FROM tries WHERE n = 0 AND page_id % 10 = 7
),
picked AS (
  SELECT page_id, row_id, url, max(rank) AS rank, max_by(n, 10 * rank + n) AS stands, max(n) FILTER (n < 2) AS plain,
    count(*) AS fetch_count, sum(elapsed_ms) AS elapsed_ms, min(fetched_at) AS fetched_at, max(fetched_at) AS last_fetched_at,
    bool_or(n = 2 AND rank = 0) AS render_failed
  FROM logged GROUP BY ALL
),
merged AS (
  SELECT p.page_id, p.row_id, p.url, coalesce(nullif(s.final_url, ''), t.final_url) AS final_url, t.status_code, s.method, s.html, p.rank,
    trim(t.error || CASE WHEN p.rank < 2 AND render_failed THEN ' render timeout' ELSE '' END) AS error,
    p.elapsed_ms, p.fetched_at, p.last_fetched_at, p.fetch_count
  FROM picked p JOIN tries s ON s.page_id = p.page_id AND s.n = p.stands
  JOIN tries t ON t.page_id = p.page_id AND t.n = CASE WHEN p.rank = 1 THEN p.stands ELSE p.plain END
)"""

MERGED_FETCHES = (
    FETCHES.replace("fetches AS (", "once AS (").replace("usable AS (", f"{TRIES.format(fetched='once').strip()},\nusable AS (")
    .replace("method = 'playwright' OR (status_code < 400 AND content_type <> 'application/pdf') AS has_html", "rank > 0 AS has_html")
    .replace("FROM fetches", "FROM merged")
)
MERGED_JOB = "WITH " + ",".join((MERGED_FETCHES, HEAD, RECORDS, ROLLUP.replace(
    "'homepage_failed: HTTP ' || status_code", "'homepage_failed: ' || coalesce(nullif(error, ''), 'HTTP ' || status_code)"
).replace("max(fetched_at)", "max(last_fetched_at)").replace("SELECT row_id, url, status_code, has_html", "SELECT row_id, url, status_code, error, has_html")))

LOG = """
log AS (
  SELECT event_id, ts, 'user_' || user_id AS row_id,
    'https://u' || user_id || '.example.com/' || json_extract_string(props, '$.k') AS url,
    CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 404 ELSE 200 END AS status_code,
    round(value / 10 * 1000)::BIGINT AS ms,
    CASE WHEN user_id % 5 <> 4 THEN 'f' || (user_id % 5) END AS input_file,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'skipped' WHEN 'view' THEN NULL
      ELSE 'done' END AS scrape_status
  FROM events
)"""

COUNTS = """count(*) AS rows_total,
    count(*) FILTER (scrape_status = 'done') AS rows_done,
    count(*) FILTER (scrape_status = 'error') AS rows_error,
    count(*) FILTER (scrape_status = 'skipped') AS rows_skipped"""
PENDING = "greatest(0, rows_total - rows_done - rows_error - rows_skipped) AS rows_pending"

ANCHORS = r"""
anchors AS (
  SELECT page_id, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages)
)"""

# All hrefs of the test pages are root-relative and stay on their host.
PLANS = f"""
bases AS (
  SELECT page_id, {normal('url')} AS home, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin FROM pages
),
internal AS (
  SELECT page_id, origin || regexp_extract(href, '^[^#]*') AS url, min(pos) AS pos
  FROM anchors JOIN bases USING (page_id) GROUP BY ALL
),
common AS (
  SELECT page_id, origin || path AS url, 1000000 + ord AS pos
  FROM bases, (SELECT unnest({words(K.COMMON_PATHS)}) AS path, generate_subscripts({words(K.COMMON_PATHS)}, 1) AS ord)
),
scored AS (
  SELECT page_id, url, pos, {LINK_SCORE} AS score FROM internal
  UNION ALL
  SELECT page_id, url, pos, 3 AS score FROM common ANTI JOIN internal USING (page_id, url)
)"""


LANDED_PLANS = PLANS.replace(
    f"SELECT page_id, {normal('url')} AS home, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin FROM pages",
    """SELECT page_id, has_html, coalesce(nullif(final_url, ''), url) AS home,
    regexp_extract(coalesce(nullif(final_url, ''), url), '^[a-z]+://[^/?#]*') AS origin FROM usable WHERE page_id % 7 <> 3""",
).replace("FROM anchors JOIN bases USING (page_id) GROUP BY ALL", "FROM anchors JOIN bases USING (page_id) WHERE has_html GROUP BY ALL")


def plan(limit: int, source: str = "scored") -> str:
    return f"""
plan AS (
  SELECT page_id, 0 AS pos, home AS url, NULL::INT AS score FROM bases
  UNION ALL
  SELECT page_id, rank AS pos, url, score FROM (
    SELECT page_id, url, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank
    FROM {source} JOIN bases USING (page_id) WHERE url <> home
  ) WHERE rank < {limit}
)"""


SITEMAPS = f"""
places AS (SELECT ['', '/services', '/a/b', '/help/faq', '/products', ''] AS place),
locations AS (
  SELECT page_id, origin || place[pos % 6 + 1] || href AS url, pos
  FROM anchors JOIN bases USING (page_id), places
),
hints AS (
  SELECT page_id, url, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) - 1 AS pos
  FROM (SELECT page_id, url, min(pos) AS pos, {HINT_SCORE} AS score FROM locations GROUP BY page_id, url)
  QUALIFY pos < 10
)"""

ORACLE = {
    "site_list": f"WITH {SITES} SELECT row_id, website, 'say \"hi\",' || chr(10) || website AS note FROM sites",
    "files_union": f"""
        SELECT 'site' AS kind, page_id // 50 AS sheet, page_id % 50 AS ord, {HOST} AS website,
          {row_id(HOST, 'page_id')} AS row_id, url AS note
        FROM pages WHERE page_id // 50 % 3 <> 2
        UNION ALL
        SELECT DISTINCT 'failure', page_id // 50, NULL, NULL, NULL, 'the site list needs a ''website'' column'
        FROM pages WHERE page_id // 50 % 3 = 2""",
    "conform_schema": f"""WITH {SITES}
        SELECT row_id, website, website AS final_url, '' AS scrape_status, '' AS error_reason,
          '' AS normalized_url, NULL::INT AS pages_attempted, NULL::INT AS pages_scraped,
          '' AS methods_used, '' AS http_statuses, NULL::BIGINT AS total_bytes,
          NULL::BIGINT AS total_text_len, NULL::BOOLEAN AS truncated_full,
          NULL::BOOLEAN AS truncated_preview, NULL::DOUBLE AS duration_sec,
          NULL::TIMESTAMP AS started_at, NULL::TIMESTAMP AS finished_at, '' AS visited_urls,
          NULL::VARCHAR AS website_text_full, NULL::VARCHAR AS website_text_preview,
          NULL::VARCHAR AS website_text_main, NULL::VARCHAR AS site_title,
          NULL::VARCHAR AS site_meta_description, NULL::VARCHAR AS site_headings,
          NULL::INT AS main_text_len, NULL::INT AS pages_planned
        FROM sites""",
    "sink_roundtrip": f"""{SITE_JOB}
        SELECT row_id, total_bytes, scrape_status, error_reason, website_text_preview, site_headings,
          strftime(started_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS started_at FROM results""",
    "url_normalize": f"""
        WITH forms AS (
          SELECT page_id, 0 AS form, url AS raw FROM pages
          UNION ALL SELECT page_id, 1, '  ' || regexp_replace(url, '^[a-z]+://', '') || chr(10) FROM pages
          UNION ALL SELECT page_id, 2,
            regexp_replace(upper(regexp_extract(url, '^[a-z]+://[^/]*')), '^HTTP', 'HtTp') || '?#x' FROM pages
          UNION ALL SELECT page_id, 3, '   ' FROM pages)
        SELECT page_id, form, {normal('raw')} AS normalized_url FROM forms""",
    "domain_key": f"SELECT page_id, regexp_extract({HOST}, '[^.]+[.][^.]+$') AS domain FROM pages",
    "domain_key_by_table": f"SELECT page_id, array_to_string(string_split({HOST}, '.')[-2:], '.') AS domain FROM pages",
    "link_resolve": f"""WITH {ANCHORS}, bases AS (
          SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin,
            regexp_extract(url, '^([a-z]+):', 1) AS scheme,
            coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM pages)
        SELECT page_id, pos, CASE (pos + page_id) % 6
            WHEN 0 THEN origin || href
            WHEN 1 THEN origin || regexp_replace(path, '[^/]*$', '') || href[2:]
            WHEN 2 THEN origin || coalesce(nullif(regexp_replace(path, '[^/]*/?[^/]*$', ''), ''), '/') || href[2:]
            WHEN 3 THEN origin || path || '?q=' || href[2:]
            WHEN 4 THEN scheme || '://cdn.example.org/' || href[2:]
            ELSE origin || regexp_replace(path, '[^/]*$', '') || href[2:] END AS url
        FROM anchors JOIN bases USING (page_id)""",
    "stable_row_id": f"""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'row_' || page_id
          ELSE 'site_' || left(sha1(lower(url)), 12) END AS row_id FROM pages""",
    "clean_text": f"""SELECT doc_id, {clean(
        "replace(replace(text, '. ', '. ' || chr(9) || ' '), chr(10), repeat(chr(10), 4))")} AS text FROM documents""",
    "page_full_text": f"SELECT page_id, {one_line(reduced('html'))} AS full_text FROM pages",
    "page_text_declutter": f"""
        WITH r AS (SELECT page_id, {reduced('html')} AS m FROM pages)
        SELECT page_id, {lines(decluttered('m'))} AS text FROM r""",
    "page_main_text": f"""
        WITH r AS (SELECT page_id, {reduced('html')} AS m FROM pages),
        s AS (SELECT page_id, {decluttered('m')} AS m FROM r)
        SELECT page_id, {main_text('m', 200)} AS main_text, {paragraphs('m')} AS paragraph_text FROM s""",
    "page_densest_block": f"""
        WITH h AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?i)</?(?:article|nav)>', '<div>', 'g'),
            '<li><a href="([^"]*)">([^<]*)</a></li>', '<p><a href="\\1">All about \\2 and \\2</a></p>', 'g') AS html FROM pages),
        r AS (SELECT page_id, {reduced('html')} AS m FROM h),
        s AS (SELECT page_id, {decluttered('m')} AS m FROM r)
        SELECT page_id, {densest('m')} AS text FROM s""",
    "page_metadata": f"""WITH {FETCHES}, {HEAD}
        SELECT page_id, title, '' AS meta_description, headings FROM head""",
    "page_description": """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'd & ' || page_id
          ELSE 'd' || page_id END AS meta_description FROM pages""",
    "page_headings": f"""
        WITH h AS (
          SELECT page_id, regexp_replace({reduced('html')}, '<p>([^<]*)</p>',
            '<h2>\\1</h2><H3 class=''x''>The</H3>', 'g') AS html FROM pages),
        found AS (
          SELECT page_id, unnest(t) AS t, generate_subscripts(t, 1) AS pos FROM (
            SELECT page_id, list_transform(regexp_extract_all(html, '(?is)<h[1-3](?:\\s[^>]*)?>(.*?)</h[1-3]>', 1),
              lambda x: {one_line('x')}) AS t FROM h)),
        firsts AS (
          SELECT page_id, arg_min(t, pos) AS t, min(pos) AS pos FROM found WHERE t <> '' GROUP BY page_id, lower(t))
        SELECT page_id, to_json(list(t ORDER BY pos)[1:50])::VARCHAR AS headings FROM firsts GROUP BY page_id""",
    "page_links": f"WITH {ANCHORS} SELECT page_id, pos, href FROM anchors",
    "text_truncate": """SELECT doc_id, left(text, 500) AS preview, length(text) > 500 AS truncated_preview,
          left(text, 5000) AS full, length(text) > 5000 AS truncated_full FROM documents""",
    "page_stats": f"WITH {FETCHES} SELECT page_id, has_html, bytes, text_len FROM content",
    "html_filter": f"WITH {FETCHES} SELECT page_id, status_code < 400 AND content_type <> 'application/pdf' AS is_html FROM fetches",
    "js_shell": f"""
        WITH h AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN ''
            WHEN page_id % 3 = 0 THEN replace(html, '<article>', '<article ID="root">') ELSE html END AS html
          FROM pages)
        SELECT page_id, html = '' OR (html LIKE '%ID="root"%' AND length({one_line(reduced('html'))}) < 800)
          AS is_shell FROM h""",
    "render_queue": f"""WITH {FETCHES}
        SELECT page_id, url, text_len, CASE WHEN has_html THEN 'short_text' ELSE 'no_html' END AS reason
        FROM content WHERE method <> 'playwright' AND (NOT has_html OR text_len < 900)""",
    "retry_queue": f"""WITH {LOG}
        SELECT row_id, url, count(*) FILTER (status_code = 503) AS failures,
          arg_max(status_code, (ts, event_id)) AS last_status
        FROM log GROUP BY row_id, url HAVING last_status = 503 AND failures <= 3""",
    "pending_sites": f"""WITH {SITES}, {EARLIER}
        SELECT row_id, 'pending' AS kind FROM sites
        WHERE row_id NOT IN (SELECT row_id FROM old WHERE scrape_status = 'done')
        UNION ALL
        SELECT row_id, 'stale' FROM sites WHERE ord % 2 = 0
        AND row_id NOT IN (SELECT row_id FROM old WHERE scrape_status = 'done')""",
    "page_results": f"""WITH {FETCHES},
        checked AS (
          SELECT *, CASE WHEN page_id % 4 = 0 THEN text_len > 0 ELSE text_len > 600 END AS ok FROM content)
        SELECT page_id, url, ok, status_code, method, bytes, text_len,
          CASE WHEN NOT has_html THEN 'HTTP ' || status_code WHEN ok THEN ''
            WHEN page_id % 4 = 0 THEN 'empty_text' ELSE 'empty_or_too_short' END AS error
        FROM checked""",
    "site_page_cap": f"""
        SELECT {row_id(HOST, 'page_id')} AS row_id, page_id,
          row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) - 1 AS pos, pos = 0 AS is_home
        FROM pages QUALIFY pos < 12""",
    "site_rollup": f"""{SITE_JOB}
        SELECT row_id, scrape_status, error_reason, final_url, pages_attempted, pages_scraped,
          methods_used, http_statuses, total_bytes, total_text_len, duration_sec, started_at, finished_at,
          visited_urls, main_text_len, pages_planned FROM results""",
    "site_text": f"""WITH {FETCHES}, {RECORDS}
        SELECT row_id, left(chr(10) || chr(10) || string_agg('URL: ' || url || chr(10) || main_text,
          chr(10) || chr(10) || '{RULE}' || chr(10) || chr(10) ORDER BY pos), 250000) AS combined_text,
          (sum(length('URL: ' || url || chr(10) || main_text)) + 84 * (count(*) - 1) + 2)::BIGINT AS n_chars, n_chars > 250000 AS truncated
        FROM records WHERE ok GROUP BY row_id""",
    "site_text_chunks": f"""WITH {FETCHES}, {RECORDS},
        texts AS (
          SELECT row_id, chr(10) || chr(10) || string_agg('URL: ' || url || chr(10) || main_text,
            chr(10) || chr(10) || '{RULE}' || chr(10) || chr(10) ORDER BY pos) AS t FROM records WHERE ok GROUP BY row_id)
        SELECT row_id, chunk, substring(t, chunk * 2000 + 1, 2000) AS text
        FROM texts, unnest(range(0, (length(t) + 1999) // 2000)) u(chunk)""",
    "conversation_text_chunks": f"""WITH texts AS (
          SELECT conv_id, chr(10) || chr(10) || string_agg('URL: ' || role || chr(10) || text,
            chr(10) || chr(10) || '{RULE}' || chr(10) || chr(10) ORDER BY turn) AS t
          FROM conversations WHERE text <> '' GROUP BY conv_id)
        SELECT conv_id, chunk, substring(t, chunk * 500 + 1, 500) AS text
        FROM texts, unnest(range(0, (length(t) + 499) // 500)) u(chunk)""",
    "conversation_text": f"""
        SELECT conv_id, left(coalesce(chr(10) || chr(10) || string_agg(
          'URL: ' || role || chr(10) || text,
          chr(10) || chr(10) || '{RULE}' || chr(10) || chr(10) ORDER BY turn) FILTER (text <> ''), ''), 250000)
          AS combined_text,
          coalesce(2 + sum(length('URL: ' || role || chr(10) || text) + 84) FILTER (text <> '') - 84, 0)::BIGINT AS n_chars,
          n_chars > 250000 AS truncated
        FROM conversations GROUP BY conv_id""",
    "site_output": f"""{SITE_JOB}, {SITES}
        SELECT CASE WHEN ord % 13 <> 5 THEN website END AS website, ord, row_id,
          CASE WHEN ord % 13 = 5 THEN 'skipped' ELSE scrape_status END AS scrape_status,
          CASE WHEN ord % 13 = 5 THEN 'empty_url' ELSE error_reason END AS error_reason,
          CASE WHEN ord % 13 = 5 THEN '' ELSE 'https://' || website || '/' END AS normalized_url,
          results.* EXCLUDE (row_id, scrape_status, error_reason) REPLACE (
            {", ".join(f"(CASE WHEN ord % 13 = 5 THEN 0 ELSE {c} END)::{t} AS {c}" for c, t in (
                ("pages_attempted", "INT"), ("pages_scraped", "INT"), ("total_bytes", "BIGINT"), ("total_text_len", "BIGINT"),
                ("main_text_len", "INT"), ("pages_planned", "INT"), ("truncated_full", "BOOLEAN"), ("truncated_preview", "BOOLEAN")))})
        FROM sites JOIN results USING (row_id)""",
    "fetch_merge": f"""WITH {MERGED_FETCHES}
        SELECT row_id, url, page_id, page_id AS pos, final_url, status_code, method, error, elapsed_ms / 1000.0 AS elapsed_sec,
          fetched_at, last_fetched_at, fetch_count, length(html) AS html_chars FROM merged""",
    "site_output_refetched": f"""{MERGED_JOB}
        SELECT row_id, scrape_status, error_reason, final_url, pages_attempted, pages_scraped, methods_used, http_statuses,
          total_bytes, total_text_len, duration_sec, started_at, finished_at, visited_urls FROM results""",
    "site_output_resumed": f"""{MERGED_JOB}, {SITES}, {EARLIER}, done AS (
          SELECT * FROM earlier WHERE scrape_status = 'done')
        SELECT row_id, sites.website, coalesce(done.scrape_status, results.scrape_status) AS scrape_status,
          coalesce(done.error_reason, results.error_reason) AS error_reason,
          coalesce(done.pages_attempted, results.pages_attempted)::INT AS pages_attempted,
          CASE WHEN done.row_id IS NULL THEN results.total_bytes END AS total_bytes,
          coalesce(done.site_title, results.site_title) AS site_title
        FROM sites LEFT JOIN results USING (row_id) LEFT JOIN done USING (row_id)""",
    # A home page's links go by the URL where it landed; of a home page which is no HTML there are none.
    "to_fetch": f"""WITH {FETCHES}, {ANCHORS}, {LANDED_PLANS}, {plan(12)},
        archived AS (SELECT url FROM fetches WHERE page_id % 7 <> 3)
        SELECT {row_id('pages.url', 'pages.page_id')} AS row_id, plan.url, plan.pos FROM plan JOIN pages USING (page_id)
        WHERE plan.pos > 0 AND plan.url NOT IN (SELECT url FROM archived)
        UNION ALL
        SELECT {row_id('pages.url', 'pages.page_id')}, fetches.url, 0 FROM fetches JOIN pages USING (page_id) WHERE page_id % 7 = 3""",
    "link_candidates": f"WITH {ANCHORS}, {PLANS}, {plan(12)} SELECT * FROM plan",
    "link_candidates_wide": f"WITH {ANCHORS}, {PLANS}, {plan(30)} SELECT * FROM plan",
    "sitemap_urls": f"""WITH {ANCHORS}, {PLANS}, {SITEMAPS}
        SELECT page_id::VARCHAR AS row_id, pos, url,
          CASE WHEN page_id % 3 = 0 THEN '/sitemap_index.xml' ELSE '/sitemap.xml' END AS path FROM locations""",
    "plan_with_sitemap": f"""WITH {ANCHORS}, {PLANS}, {SITEMAPS},
        together AS (
          SELECT page_id, url, pos, score FROM scored
          UNION ALL
          SELECT page_id, url, 2000000 + pos, score FROM hints ANTI JOIN scored USING (page_id, url)),
        {plan(12, 'together')}
        SELECT page_id::VARCHAR AS row_id, pos, url, score FROM plan""",
    "plan_with_sitemap_leftover": f"""WITH {ANCHORS}, {PLANS}, {SITEMAPS}, {plan(30)},
        sizes AS (SELECT page_id, count(*) AS n FROM plan GROUP BY page_id),
        added AS (
          SELECT page_id, n - 1 + row_number() OVER (PARTITION BY page_id ORDER BY pos) AS pos, url, score
          FROM hints JOIN sizes USING (page_id) ANTI JOIN plan USING (page_id, url)
          WHERE pos < 30 - n)
        SELECT page_id::VARCHAR AS row_id, pos, url, score FROM plan
        UNION ALL SELECT page_id::VARCHAR, pos, url, score FROM added""",
    "unvisited_links": f"""WITH {ANCHORS}, {PLANS}, {plan(12)}
        SELECT page_id AS row_id, url, pos FROM plan WHERE pos <> 0 AND pos % 3 <> 1""",
    **{
        name: f"""WITH {ANCHORS}, {PLANS}, {plan(limit)}, {FETCHES},
        known AS (SELECT url, arg_max(page_id, fetched_at) AS page_id FROM fetches GROUP BY url)
        SELECT plan.page_id AS from_page, plan.pos, plan.url, known.page_id, fetches.status_code,
          known.page_id IS NOT NULL AS hit
        FROM plan LEFT JOIN known USING (url) LEFT JOIN fetches ON fetches.page_id = known.page_id"""
        for name, limit in (("crawl_lookup", 12), ("crawl_lookup_wide", 30))
    },
    "archive_crawl": f"""WITH {FETCHES},
        known AS (SELECT * FROM content QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC) = 1)
        SELECT pages.page_id AS ord, {row_id('pages.url', 'pages.page_id')} AS row_id,
          CASE WHEN text_len > 0 THEN 'done' ELSE 'error' END AS scrape_status,
          CASE WHEN NOT has_html THEN 'homepage_failed: HTTP ' || status_code ELSE '' END AS error_reason,
          coalesce(nullif(known.final_url, ''), known.url) AS final_url,
          has_html::INT AS pages_attempted, text_len AS total_text_len,
          CASE WHEN has_html THEN coalesce(nullif(known.final_url, ''), known.url) ELSE '' END AS visited_urls,
          1 AS plan_hits
        FROM pages JOIN normalized USING (page_id) JOIN known ON known.url = normalized.url""",
    "resume_merge": f"""WITH {SITES}, {EARLIER}
        SELECT row_id, ord, CASE WHEN ord % 4 = 0 THEN old.website ELSE sites.website END AS website,
          scrape_status, error_reason, pages_attempted, site_title, NULL::BIGINT AS total_bytes
        FROM sites LEFT JOIN old USING (row_id)""",
    "upsert_results": f"""WITH {SITES}, {EARLIER}
        SELECT row_id, CASE WHEN ord % 2 = 0 THEN 'done' ELSE scrape_status END AS scrape_status,
          CASE WHEN ord % 2 = 0 THEN '' ELSE error_reason END AS error_reason,
          CASE WHEN ord % 4 = 0 THEN ord WHEN ord % 2 = 0 THEN NULL ELSE pages_attempted END AS pages_attempted,
          site_title
        FROM sites LEFT JOIN old USING (row_id)""",
    "site_time_budget": f"""WITH {LOG}
        SELECT event_id, row_id, coalesce(sum(ms) OVER (PARTITION BY row_id ORDER BY ts, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_ms
        FROM log QUALIFY spent_ms <= 45000""",
    "progress_timeline": f"""WITH {LOG},
        run AS (
          SELECT input_file, event_id,
            count(*) OVER w AS processed,
            count(*) FILTER (scrape_status = 'done') OVER w AS done,
            count(*) FILTER (scrape_status = 'error') OVER w AS error,
            count(*) FILTER (scrape_status = 'skipped') OVER w AS skipped,
            count(*) OVER (PARTITION BY input_file) AS rows_total
          FROM log WINDOW w AS (PARTITION BY input_file ORDER BY ts, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT *, greatest(0, rows_total - done - error - skipped) AS pending
        FROM run WHERE processed % 10 = 0 OR processed = rows_total""",
    "status_counts": f"WITH {LOG} SELECT input_file, {COUNTS} FROM log GROUP BY input_file",
    "status_rollup": f"""WITH {LOG}, c AS (
          SELECT input_file, {COUNTS}, grouping(input_file) = 1 AS is_total FROM log GROUP BY ROLLUP (input_file))
        SELECT *, {PENDING} FROM c""",
    "failure_sample": f"""WITH {LOG},
        failed AS (
          SELECT row_id || ': event ' || event_id AS message, row_number() OVER (ORDER BY ts, event_id) AS n
          FROM log WHERE scrape_status = 'error')
        SELECT message, 1 AS failures FROM failed WHERE n <= 25
        UNION ALL
        SELECT '... and ' || (count(*) - 25) || ' more', count(*) - 25 FROM failed HAVING count(*) > 25""",
    "run_summary": f"""WITH {LOG},
        spans AS (
          SELECT input_file, false AS is_total, scrape_status, ts AS a, ts + to_milliseconds(ms) AS z FROM log
          UNION ALL SELECT NULL, true, scrape_status, ts, ts + to_milliseconds(ms) FROM log),
        -- Each span adds what reaches beyond all spans which began before it.
        reach AS (
          SELECT *, max(z) OVER (PARTITION BY is_total, input_file ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far
          FROM spans),
        c AS (
          SELECT is_total, input_file, {COUNTS}, min(a) AS started_at, max(z) AS finished_at,
            sum(greatest(0, epoch_us(z) - greatest(epoch_us(a), coalesce(epoch_us(far), 0)))) AS busy
          FROM reach GROUP BY is_total, input_file),
        p AS (SELECT *, {PENDING} FROM c),
        failures AS (SELECT DISTINCT 'list' || (page_id // 50) AS input_file FROM pages WHERE page_id // 50 % 3 = 2)
        SELECT CASE WHEN is_total THEN 'totals' ELSE 'file' END AS kind, input_file, rows_total, rows_done, rows_error, rows_skipped,
          rows_pending, started_at, finished_at, round(epoch_us(finished_at - started_at) / 1000000.0::DOUBLE, 3) AS duration_sec,
          round((busy / 1000000.0)::DOUBLE, 3) AS busy_sec,
          CASE WHEN is_total THEN (SELECT count(DISTINCT input_file) FROM log) + (SELECT count(*) FROM failures) END AS files_total,
          CASE WHEN is_total THEN (SELECT count(*) FROM p q WHERE NOT q.is_total AND q.input_file IS NOT NULL AND q.rows_pending = 0) END
            AS files_completed,
          CASE WHEN is_total THEN (SELECT count(*) FROM failures) END AS files_failed, NULL::VARCHAR AS message
        FROM p
        UNION ALL
        SELECT 'failure', input_file, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no website column' FROM failures""",
    "incremental_sites": f"""{SITE_JOB}
        SELECT row_id, scrape_status, pages_attempted, pages_scraped, total_bytes, total_text_len, visited_urls,
          site_title FROM results""",
    "incremental_refetched": f"""{MERGED_JOB}
        SELECT row_id, scrape_status, error_reason, pages_attempted, http_statuses, total_text_len, duration_sec, visited_urls
        FROM results""",
    "live_status_latest": f"""WITH {LOG},
        latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ts DESC, event_id DESC) = 1)
        SELECT input_file, {COUNTS} FROM latest GROUP BY input_file""",
    "resume_cycle": f"""
        WITH one AS ({SITE_JOB} SELECT * FROM results), two AS ({MERGED_JOB} SELECT * FROM results), {SITES.strip()},
        kept AS (SELECT one.* FROM one JOIN sites USING (row_id) WHERE ord % 2 = 0 AND scrape_status = 'done')
        SELECT row_id, website, r.scrape_status, r.error_reason, r.pages_attempted, r.total_bytes, r.visited_urls,
          row_id IN (SELECT row_id FROM kept) AS done_before
        FROM sites JOIN (
          SELECT * FROM kept UNION ALL SELECT * FROM two WHERE row_id NOT IN (SELECT row_id FROM kept)) r USING (row_id)""",
    "live_status": f"WITH {LOG} SELECT input_file, {COUNTS} FROM log GROUP BY input_file",
}
