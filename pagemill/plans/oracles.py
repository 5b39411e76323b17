"""DuckDB SQL for the registered queries: the same results by other means.

Queries on derived pages are checked against the rows the pages were written from, so the SQL
never parses that markup.  Queries on the given pages use regular expressions of their own.
"""

from __future__ import annotations

from ..operators.classify import BLOCK_PHRASES, HARD_SITES
from ..operators.presets import PRESETS

ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- pieces of SQL

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def unescape(s: str) -> str:
    for name, char in [("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")]:
        s = f"replace({s}, '&{name};', '{char}')"
    return s


def clean(s: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({s}, '{WS}+', ' ', 'g'), '[\p{{Cc}}\p{{Cf}}\p{{Co}}\p{{Cs}}]', '', 'g'))"


def no_tags(s: str) -> str:
    return f"regexp_replace({s}, '<[^>]*>', ' ', 'g')"


def money(c: str) -> str:
    return f"'£' || printf('%.2f', {c})"


SEEN = (
    "seen AS (SELECT page_id, url, regexp_replace(html, "
    "'(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g') AS body FROM pages)"
)
SITE_OF = r"regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
HOST_OF = r"regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"

LINKS = f"""{SEEN}, cut AS (
  SELECT page_id, url, regexp_extract_all(body, '(?s)<a href="[^"]*">.*?</a>') AS found FROM seen),
links AS (
  SELECT page_id, url, CAST(i AS INTEGER) AS pos,
    {unescape("regexp_extract(found[i], 'href=\"([^\"]*)\"', 1)")} AS raw,
    {clean(unescape(no_tags("found[i]")))} AS text
  FROM (SELECT page_id, url, found, unnest(range(1, len(found) + 1)) AS i FROM cut))"""
HEADER = f"""{SEEN}, header AS (
  SELECT page_id,
    {clean(unescape(no_tags("regexp_extract(body, '(?s)<title>(.*?)</title>', 1)")))} AS title,
    regexp_extract(body, '<html lang="([^"]*)"', 1) AS lang,
    len(regexp_extract_all(body, '<h1>')) AS n_h1
  FROM seen)"""

ORACLES["page_header"] = f"WITH {HEADER} SELECT page_id, title, '' AS description, lang FROM header"
ORACLES["stream_page_header"] = ORACLES["page_header"]
ORACLES["extract_links"] = f"""WITH {LINKS}
SELECT page_id, pos, text, {SITE_OF} || raw AS href, 'internal' AS type, '' AS status, '' AS detail FROM links"""
ORACLES["links_by_host"] = f"""WITH {LINKS}
SELECT {HOST_OF} AS host, 'internal' AS type, count(*) AS n_links FROM links GROUP BY ALL"""
ORACLES["extract_headings"] = f"""WITH {SEEN}, cut AS (
  SELECT page_id, regexp_extract_all(body, '(?s)<h[1-6]>.*?</h[1-6]>') AS found FROM seen)
SELECT page_id, CAST(i AS INTEGER) AS pos, CAST(found[i][3] AS INTEGER) AS level,
  {clean(unescape(no_tags("found[i]")))} AS text
FROM (SELECT page_id, found, unnest(range(1, len(found) + 1)) AS i FROM cut)"""

TOKENS = r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<[^>]*>|[^<]+"
ORACLES["token_counts"] = (
    f"SELECT page_id, CAST(len(regexp_extract_all(html, '{TOKENS}')) AS INTEGER) AS n_tokens FROM pages"
)
TAGS = f"""SELECT lower(regexp_extract(token, '^<(/?[a-zA-Z0-9]+)', 1)) AS tag FROM (
  SELECT unnest(regexp_extract_all(html, '{TOKENS}')) AS token FROM pages)
WHERE regexp_matches(token, '^</?[a-zA-Z]')"""
ORACLES["tag_histogram"] = f"SELECT tag, count(*) AS n FROM ({TAGS}) GROUP BY tag"
ORACLES["html_nodes"] = (
    f"SELECT tag, count(*) AS n, CAST(0 AS BIGINT) AS bad_ends FROM ({TAGS}) WHERE tag[1] != '/' GROUP BY tag"
)
ORACLES["nav_nodes"] = f"WITH {LINKS} SELECT page_id, 'a' AS tag, text FROM links"

# A menu's score: count, root of the upper median of text lengths, every entry a link, in <nav>.
ORACLES["nav_groups"] = f"""WITH {LINKS}, menus AS (
  SELECT page_id, count(*) AS n, list_sort(list(length(text))) AS lens,
    avg(CASE WHEN regexp_matches(text, '(?i)(?:[$€£¥₹]|\\b(?:USD|MYR|RM|Rs\\.?|INR|EUR|GBP))\\s?[0-9]|[0-9]\\s?(?:USD|MYR|RM|€|£)')
        THEN 1 ELSE 0 END) AS price
  FROM links GROUP BY page_id HAVING count(*) >= 3)
SELECT page_id, CAST(n AS INTEGER) AS count,
  round_even(n * sqrt(least(lens[n // 2 + 1], 300)) * (2 + 2 * price) * 0.15, 1) AS score,
  'html > body > nav > ul > li' AS selector
FROM menus WHERE lens[n // 2 + 1] >= 8"""

QA_HEADER = """
SELECT page_id, 'High' AS severity, 'Missing <title>' AS "check", 'Page has no title.' AS detail, '' AS "where" FROM header WHERE title = ''
UNION ALL SELECT page_id, 'Low', 'Long <title>', length(title) || ' chars.', title FROM header WHERE length(title) > 70
UNION ALL SELECT page_id, 'Medium', 'Missing meta description', 'No <meta name=description>.', '' FROM header WHERE description = ''
UNION ALL SELECT page_id, 'Low', 'Missing lang attribute', '<html> has no lang.', '' FROM header WHERE lang = ''
UNION ALL SELECT page_id, 'Medium', 'No <h1>', 'Page has no top-level heading.', '' FROM header WHERE n_h1 = 0
UNION ALL SELECT page_id, 'Low', 'Multiple <h1>', n_h1 || ' h1s found.', h1s FROM header WHERE n_h1 > 1"""
GIVEN_HEADER = HEADER.replace("header AS (", "given AS (") + (
    ", header AS (SELECT *, '' AS description, '' AS h1s FROM given)"
)
ORACLES["qa_header"] = f"WITH {GIVEN_HEADER} {QA_HEADER}"
ORACLES["qa_summary"] = (
    f"WITH {GIVEN_HEADER} SELECT severity, count(*) AS n FROM ({QA_HEADER}) GROUP BY severity"
)

BLOCKED = "|".join(BLOCK_PHRASES)
FLAGS = f"""flags AS (
  SELECT page_id,
    regexp_matches(lower(html), '{BLOCKED}') AS blocked,
    len(regexp_extract_all(html, '(?i)<(?:a|input|button|select|textarea)\\b')) < 5
      AND length(trim(regexp_replace({unescape(no_tags("body"))}, '{WS}+', ' ', 'g'))) < 200 AS thin
  FROM seen JOIN pages USING (page_id, url))"""
ORACLES["page_flags"] = f"WITH {SEEN}, {FLAGS} SELECT page_id, blocked, thin FROM flags"
ORACLES["fetch_verdict"] = f"""WITH {SEEN}, {FLAGS}, asked AS (
  SELECT *, CASE page_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END AS status,
    CASE page_id % 3 WHEN 0 THEN 'static' WHEN 1 THEN 'auto' ELSE 'headless' END AS mode FROM flags),
judged AS (
  SELECT *, CASE WHEN mode = 'headless' THEN NOT blocked AND status NOT IN (401, 403, 429, 503)
    ELSE status < 400 AND NOT blocked AND (mode = 'static' OR NOT thin) END AS usable FROM asked)
SELECT page_id, usable, CASE WHEN usable THEN 'use' WHEN mode = 'headless' THEN 'visible'
  WHEN mode = 'static' THEN 'fail' ELSE 'render' END AS next_step FROM judged"""
ORACLES["detect_cms"] = """SELECT page_id,
  CASE WHEN contains(lower(html), 'mage/') THEN 'magento' ELSE 'generic' END AS preset,
  CASE WHEN contains(lower(html), 'mage/') THEN 5 ELSE 0 END AS score FROM pages"""
ORACLES["detect_platforms"] = """SELECT p_partkey AS page_id,
  CASE p_partkey % 8 WHEN 0 THEN 'shopify' WHEN 1 THEN 'woocommerce' WHEN 2 THEN 'wordpress'
    WHEN 3 THEN 'magento' WHEN 4 THEN 'wix' WHEN 6 THEN 'magento' ELSE 'generic' END AS preset,
  CASE p_partkey % 8 WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 6 WHEN 3 THEN 5 WHEN 4 THEN 5
    WHEN 6 THEN 5 ELSE 0 END AS score FROM part"""

# ---------------------------------------------------------------- text and URLs

ORACLES["clean_text"] = f"SELECT doc_id, sha1({clean('text')}) AS cleaned FROM documents"
PRICE = (
    r"(?i)(?:[$€£¥₹]|\b(?:USD|MYR|RM|Rs\.?|INR|EUR|GBP))\s?[0-9][0-9,]*(?:\.[0-9]+)?"
    r"|[0-9][0-9,]*(?:\.[0-9]+)?\s?(?:USD|MYR|RM|€|£)"
)
ORACLES["price_parse"] = rf"""WITH found AS (
  SELECT doc_id, trim(regexp_extract(text, '{PRICE}')) AS price FROM documents)
SELECT doc_id, price, TRY_CAST(replace(
  regexp_extract(price, '^[^0-9\-]{{0,4}}(-?[0-9][0-9,]*(?:\.[0-9]+)?)[^0-9]{{0,4}}$', 1), ',', '') AS DOUBLE) AS amount
FROM found"""
ORACLES["distinct_lines"] = f"""WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
each_line AS (SELECT doc_id, i, {clean("parts[i]")} AS line
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM cut)),
firsts AS (SELECT doc_id, line, min(i) AS i FROM each_line WHERE line != '' GROUP BY ALL),
joined AS (SELECT doc_id, string_agg(line, ' | ' ORDER BY i) AS lines FROM firsts GROUP BY doc_id)
SELECT doc_id, coalesce(lines, '') AS lines FROM documents LEFT JOIN joined USING (doc_id)"""
LABELS = (
    "^(add to (cart|bag|basket)|view( product| details| more)?|buy( now)?|read more|learn more|"
    "details|more|shop now|quick view|see more|select options|sign ?up|log ?in)$"
)
ORACLES["label_kinds"] = f"""SELECT regexp_matches({clean("text")}, '(?i){LABELS}') AS generic, count(*) AS n
FROM conversations GROUP BY ALL"""
ORACLES["url_parts"] = f"""SELECT page_id, split_part(url, '://', 1) AS scheme, {HOST_OF} AS netloc,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
  split_part(url, '#', 1) AS defrag, rtrim(split_part(url, '#', 1), '/') AS norm,
  {HOST_OF} AS label, regexp_matches(url, '\\.html?$') AS single FROM pages"""
ORACLES["url_join"] = """SELECT p_partkey, CASE p_partkey % 8
  WHEN 0 THEN 'http://cdn.example.net/a/../b'
  WHEN 1 THEN 'http://h.example.com:80/x/y?z=1#f'
  WHEN 2 THEN 'http://h.example.com:80/a/b' || p_partkey || '/c;p?page=' || p_partkey
  WHEN 3 THEN 'http://h.example.com:80/up' || p_partkey
  WHEN 4 THEN 'http://h.example.com:80/a/b' || p_partkey || '/sub/' || p_partkey || '/'
  WHEN 5 THEN 'mailto:a@example.com'
  WHEN 6 THEN 'http://h.example.com:80/a/b' || p_partkey || '/c;p?q=' || p_partkey || '#s' || p_partkey
  ELSE 'http://h.example.com:80/a/b' || p_partkey || '/c;p?q=' || p_partkey || '#old' END AS url FROM part"""
ORACLES["url_dedupe"] = "SELECT DISTINCT rtrim(split_part(url, '#', 1), '/') AS norm_url FROM pages"
ORACLES["known_hard"] = (
    "SELECT page_id, CASE "
    + " ".join(
        f"WHEN contains(u, '{h}') THEN 'known anti-bot site ({h.rstrip('.')})'" for h in HARD_SITES
    )
    + " ELSE '' END AS reason FROM (SELECT page_id, lower(replace(url, 'example', 'amazonx')) AS u FROM pages)"
)

# ---------------------------------------------------------------- records, from the parts themselves

SHOP = "https://shop.example.com"
ITEMS = f"""SELECT p_partkey // 20 AS page_id, CAST(p_partkey % 20 + 1 AS INTEGER) AS "index",
  p_name || ' ' || p_brand || ' no. ' || p_partkey AS title, {money("p_retailprice")} AS price,
  '{SHOP}/item/' || p_partkey AS link, '{SHOP}/img/' || p_partkey || '.jpg' AS image,
  p_name || ' ' || p_brand || ' no. ' || p_partkey || ' | ' || {money("p_retailprice")} AS text FROM part"""
ORACLES["catalog_items"] = ITEMS
ORACLES["book_cards"] = ITEMS.replace("' | '", "' '")
ORACLES["csv_round_trip"] = ITEMS
ORACLES["catalog_groups"] = f"""SELECT page_id, 1 AS rank,
  round_even(n * sqrt(least(lens[n // 2 + 1], 300)) * 5, 1) AS score, CAST(n AS INTEGER) AS count,
  'html > body > section > article.product_pod' AS selector
FROM (SELECT page_id, count(*) AS n, list_sort(list(length(replace(text, ' | ', ' ')))) AS lens
  FROM ({ITEMS}) GROUP BY page_id)"""
ORACLES["catalog_candidates"] = """SELECT p_partkey // 20 AS page_id, 1 AS rank, CAST(count(*) AS INTEGER) AS count,
  'html > body > ul > li.card' AS selector FROM part GROUP BY 1"""
ORACLES["preset_items"] = f"""SELECT p_partkey // 3 AS page_id, CAST(p_partkey % 3 + 1 AS INTEGER) AS "index",
  p_name || ' ' || p_partkey AS title, {money("p_retailprice")} AS price,
  '{SHOP}/products/' || p_partkey AS link FROM part"""
ORACLES["item_selectors"] = f"""SELECT page_id, CAST(n AS INTEGER) AS n_items, CASE page_id % 3
  WHEN 0 THEN '{PRESETS["shopify"]["item_selector"]}  (preset:shopify)'
  WHEN 1 THEN '{PRESETS["woocommerce"]["item_selector"]}  (preset:woocommerce)'
  ELSE 'html > body > div > p.box' END AS selector
FROM (SELECT p_partkey // 3 AS page_id, count(*) AS n FROM part GROUP BY 1)"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ORACLES["item_selectors"] = ORACLES["item_selectors"].replace(
    f"'{PRESETS['shopify']['item_selector']}", _quoted(PRESETS["shopify"]["item_selector"])[:-1]
)
ORACLES["presets"] = (
    f"SELECT page_id, preset, item_selector, next_selector FROM ({ORACLES['detect_platforms']}) JOIN (VALUES "
    + ", ".join(
        f"({_quoted(name)}, {_quoted(p['item_selector'])}, {_quoted(p['next_selector'])})" for name, p in PRESETS.items()
    )
    + ") v(name, item_selector, next_selector) ON preset = name"
)
ORACLES["product_page"] = f"""SELECT p_partkey AS page_id, 1 AS "index", p_name || ' ' || p_partkey AS title,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE {money("p_retailprice")} END AS price,
  '{SHOP}/p/' || p_partkey AS link, '{SHOP}/img/' || p_partkey || '.jpg' AS image,
  p_type || ' part by ' || p_brand AS text FROM part"""
ORACLES["next_links"] = f"""SELECT p_partkey AS page_id,
  CASE WHEN p_partkey % 8 < 5 THEN '{SHOP}/n/' || (p_partkey + 1) ELSE '' END AS next_url FROM part"""
ORACLES["html_tables"] = """SELECT c_custkey // 10 AS page_id, 1 AS table_no, 'Customers ' || c_custkey // 10 AS caption,
  CASE WHEN (c_custkey // 10) % 2 = 0 THEN 'key|name|' ELSE 'col_1|col_2|col_3' END AS header,
  CAST(count(*) + 1 AS INTEGER) AS n_rows FROM customer GROUP BY 1, 3, 4"""
ORACLES["table_cells"] = """WITH body AS (
  SELECT c_custkey // 10 AS page_id, c_custkey % 10 + 1 AS row_no,
    [CAST(c_custkey AS VARCHAR), c_name, c_mktsegment] AS cells FROM customer
  UNION ALL SELECT c_custkey // 10, count(*) + 1, ['end', '', ''] FROM customer GROUP BY 1)
SELECT page_id, 1 AS table_no, CAST(row_no AS INTEGER) AS row_no, CAST(i AS INTEGER) AS col_no,
  CASE WHEN page_id % 2 = 0 THEN ['key', 'name', 'col_3'][i] ELSE 'col_' || i END AS col_name, cells[i] AS cell
FROM (SELECT *, unnest(range(1, 4)) AS i FROM body)"""
ORACLES["extract_images"] = f"""SELECT p_partkey // 40 AS page_id, CAST(p_partkey % 40 + 1 AS INTEGER) AS pos,
  '{SHOP}/img/' || p_partkey || '.jpg' AS src,
  CASE WHEN p_partkey % 2 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN ' ' ELSE p_name END AS alt,
  CASE WHEN p_partkey % 2 = 0 THEN 'missing' WHEN p_partkey % 4 = 1 THEN 'empty' ELSE 'ok' END AS alt_state,
  '10' AS width, '' AS height FROM part"""

# ---------------------------------------------------------------- rules


def first_fifteen(rows: str, check: str, detail: str) -> str:
    return f"""SELECT page_id, 'Medium' AS severity, '{check}' AS "check", '{detail}' AS detail, w AS "where"
FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) AS rn FROM ({rows})) WHERE rn <= 15
UNION ALL SELECT page_id, 'Medium', '{check}', '... +' || (count(*) - 15) || ' more.', ''
FROM ({rows}) GROUP BY page_id HAVING count(*) > 15"""


def every_one(rows: str, check: str, detail: str) -> str:
    return f"""SELECT page_id, 'Medium' AS severity, '{check}' AS "check", '{detail}' AS detail, w AS "where"
FROM ({rows})"""


def row_issues(listed) -> str:
    """Issues of images and links, each kind listed in full or not."""
    images = (
        f"SELECT p_partkey // 40 AS page_id, p_partkey AS k, '{SHOP}/img/' || p_partkey || '.jpg' AS w "
        "FROM part WHERE p_partkey % 2 = 0"
    )
    links = (
        f"SELECT p_partkey // 40 AS page_id, p_partkey AS k, '{SHOP}/x/' || p_partkey AS w "
        "FROM part WHERE p_partkey % 2 = 1"
    )
    return (
        listed(images, "Image without alt", "<img> has no alt.")
        + " UNION ALL "
        + listed(links, "Link without accessible name", "No text / aria-label / img alt.")
        + """ UNION ALL SELECT p_partkey // 40, 'Low', 'Placeholder links', count(*) || ' placeholder links.', ''
FROM part WHERE p_partkey % 2 = 0 GROUP BY 1"""
    )


QA_ALL_ROWS = row_issues(every_one)
ORACLES["qa_rows"] = row_issues(first_fifteen)
QA_ELEMENTS = """SELECT p_partkey // 40 AS page_id, 'Medium' AS severity, 'Button without accessible name' AS "check",
  'No text/aria-label/title.' AS detail, '<button class="b"></button>' AS "where" FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT p_partkey // 40, 'Medium', 'Duplicate id', 'id="c' || p_partkey % 37 || '" used ' || count(*) || ' times.',
  '#c' || p_partkey % 37 FROM part GROUP BY 1, p_partkey % 37 HAVING count(*) > 1
UNION ALL SELECT p_partkey // 40, 'Medium', 'Form field without label', 'No <label>/aria-label.',
  '<input name="f' || p_partkey || '"/>' FROM part WHERE p_partkey % 6 = 0
UNION ALL SELECT p_partkey // 40, 'Low', 'Form field without label', 'Only placeholder.',
  '<input placeholder="p" name="f' || p_partkey || '"/>' FROM part WHERE p_partkey % 6 = 1"""
ORACLES["qa_elements"] = QA_ELEMENTS
CARDS = """cards AS (SELECT p_partkey // 20 AS page_id, p_partkey AS k, p_partkey // 2 AS link, p_retailprice FROM part),
per_page AS (SELECT page_id, count(*) AS n, count(*) FILTER (k % 4 = 0) AS untitled FROM cards GROUP BY page_id)"""
ORACLES["qa_items"] = f"""WITH {CARDS}
SELECT page_id, 'Medium' AS severity, 'Duplicate item link' AS "check", count(*) || ' items → same URL.' AS detail,
  '{SHOP}/p/' || link AS "where" FROM cards GROUP BY page_id, link HAVING count(*) > 1
UNION ALL SELECT page_id, 'Medium', 'Items without title', untitled || '/' || n || ' items have no title.', ''
FROM per_page WHERE untitled > 0
UNION ALL SELECT page_id, 'Low', 'No prices detected', 'No price pattern in any item.', '' FROM per_page WHERE page_id % 2 = 1"""
FAULTY_HEADER = """header AS (SELECT n AS page_id,
  CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN repeat('long title ', 8) || n ELSE 'short' END AS title,
  CASE WHEN n % 2 = 0 THEN '' ELSE 'd' END AS description, CASE WHEN n % 4 = 0 THEN '' ELSE 'en' END AS lang,
  n % 3 AS n_h1, 'one; two' AS h1s FROM (SELECT DISTINCT p_partkey // 40 AS n FROM part))"""
ORACLES["qa_faulty_header"] = f"WITH {FAULTY_HEADER} {QA_HEADER}"
ORACLES["sorted_issues"] = ORACLES["qa_faulty_header"]
ORACLES["strict_gate"] = f"""WITH {FAULTY_HEADER} SELECT count(*) FILTER (severity = 'High') AS high,
  count(*) FILTER (severity = 'High') > 0 AS failed,
  CASE WHEN count(*) FILTER (severity = 'High') > 0 THEN 3 ELSE 0 END AS exit_code FROM ({QA_HEADER})"""
ORACLES["qa_issues"] = f"""WITH {FAULTY_HEADER}, blocks AS (
  SELECT p_partkey // 40 AS page_id, count(*) FILTER (p_partkey % 2 = 1) AS links FROM part GROUP BY 1),
untitled AS (
  SELECT p_partkey // 40 AS page_id FROM part
  WHERE p_partkey % 2 = 1 GROUP BY 1 HAVING count(*) > 0)
SELECT page_id, severity, "check", count(*) AS n FROM (
  {QA_HEADER} UNION ALL {QA_ALL_ROWS} UNION ALL {QA_ELEMENTS}
  UNION ALL SELECT page_id, 'Low', 'No prices detected', '', '' FROM blocks
  UNION ALL SELECT page_id, 'Medium', 'Duplicate item link', '', '' FROM blocks WHERE false
  UNION ALL SELECT page_id, 'Medium', 'Items without title', '', '' FROM untitled) GROUP BY ALL"""

# ---------------------------------------------------------------- duplicates, completeness

MARKED = f"SELECT *, sha1('shop.example.com/item/' || (page_id * 20 + \"index\" - 1))[:16] AS fingerprint FROM ({ITEMS})"
ORACLES["dedupe_items"] = MARKED
ORACLES["dedupe_stats"] = """SELECT CAST(count(*) + count(*) FILTER (p_partkey % 5 = 0) AS BIGINT) AS items,
  count(*) AS "unique", count(*) FILTER (p_partkey % 5 = 0) AS removed FROM part"""
ORACLES["sink_rows"] = f"""SELECT CAST(page_id AS VARCHAR) AS page, CAST("index" AS VARCHAR) AS "index", title, price,
  link, image, text, fingerprint FROM ({MARKED})"""
ORACLES["completeness"] = f"""WITH {CARDS} SELECT count(*) AS total,
  count(*) FILTER (k % 4 = 0) AS missing_title, count(*) FILTER (page_id % 2 = 1) AS missing_price,
  CAST(0 AS BIGINT) AS missing_link, count(*) AS missing_image,
  count(*) - count(DISTINCT link) AS duplicate_fingerprints,
  4 * count(DISTINCT page_id) AS qa_issues_total, count(DISTINCT page_id) AS qa_issues_high FROM cards"""
ORACLES["quality_summary"] = f"""SELECT missing_title || ' missing titles; ' || missing_price || ' missing prices; '
  || duplicate_fingerprints || ' duplicates; ' || qa_issues_high || ' HIGH-severity issues' AS summary
FROM ({ORACLES["completeness"]})"""

# ---------------------------------------------------------------- runs over the catalog

PER_PAGE = "SELECT p_partkey // 20 AS n, count(*) AS cards FROM part GROUP BY 1"
ORACLES["extract_pages"] = f"""SELECT n AS page_id, 'Shop page ' || n AS title, 'Parts of page ' || n AS description,
  'en' AS lang, 'html > body > section > article.product_pod' AS selector,
  '{SHOP}/list/' || (n + 1) AS next_url, 1 AS n_candidates FROM ({PER_PAGE})"""
ORACLES["page_metrics"] = f"""SELECT n AS page_id, CAST(cards AS INTEGER) AS n_items, CAST(cards + 2 AS INTEGER) AS n_links,
  CAST(cards AS INTEGER) AS n_images, 0 AS n_tables, 0 AS n_issues FROM ({PER_PAGE})"""
ORACLES["run_counts"] = f"""WITH t AS (SELECT count(*) AS pages, CAST(sum(cards) AS BIGINT) AS items FROM ({PER_PAGE}))
SELECT 'pages' AS what, pages AS n FROM t UNION ALL SELECT 'items', items FROM t
UNION ALL SELECT 'links', items + 2 * pages FROM t UNION ALL SELECT 'images', items FROM t
UNION ALL SELECT unnest(['tables', 'qa_issues', 'checked_links', 'deduped_items']), 0"""
ORACLES["run_meta"] = f"""SELECT '{SHOP}/list/0' AS url, 'shop.example.com' AS host, 'static' AS method, count(*) AS pages,
  0 AS checked, 'html > body > section > article.product_pod' AS selector, '' AS preset, '' AS session,
  'crawl' AS mode, count(*) AS crawled_urls, 0 AS deduped_items, 1 AS concurrency, false AS strict,
  '' AS resumed_from FROM ({PER_PAGE})"""
ORACLES["run_documents"] = f"""SELECT p_partkey // 20 AS page_id, 'Shop page ' || p_partkey // 20 AS title,
  {money("p_retailprice")} AS price FROM part WHERE p_partkey % 20 = 0"""
ORACLES["saved_tables"] = f"""SELECT n AS page, cards AS items, CAST(cards AS INTEGER) AS "last", cards + 2 AS links
FROM ({PER_PAGE})"""
ORACLES["manifest"] = f"""SELECT '{SHOP}/list/0' AS url, CAST(sum(cards) AS BIGINT) AS items,
  CAST(sum(cards + 2) AS BIGINT) AS links, '2.0' AS schema_version, true AS has_files FROM ({PER_PAGE})"""
ORACLES["finished_items"] = MARKED
FINISHED = f"""WITH listed AS (
  SELECT p_partkey // 20 AS n, '{SHOP}/item/' || p_partkey AS href FROM part
  UNION ALL SELECT 1000000 + p_partkey // 100, '{SHOP}/item/' || p_partkey || '?ref=again' FROM part WHERE p_partkey % 5 = 0),
each_page AS (SELECT DISTINCT n FROM listed),
all_links AS (SELECT href FROM listed UNION ALL SELECT '{SHOP}/' FROM each_page
  UNION ALL SELECT '{SHOP}/list/' || (n + 1) FROM each_page),
answered AS (SELECT href, ANSWER AS a FROM (SELECT DISTINCT href FROM all_links))
SELECT 'pages' AS what, count(*) AS n FROM each_page UNION ALL SELECT 'items', count(*) FROM listed
UNION ALL SELECT 'deduped_items', count(*) FROM part UNION ALL SELECT 'checked_links', count(*) FROM all_links
UNION ALL SELECT CASE a[1] WHEN 'BROKEN' THEN 'issues_high' ELSE 'issues_medium' END, count(*)
FROM answered WHERE a[1] IN ('BROKEN', 'ERROR') GROUP BY ALL"""
ORACLES["manifest_folders"] = """SELECT unnest(['items.csv', 'links.csv', 'images.csv', 'headings.csv', 'qa_issues.csv',
  'tables.csv', 'items.jsonl', 'links.jsonl', 'images.jsonl', 'headings.jsonl', 'qa_issues.jsonl', 'run.json',
  'data/items', 'data/links', 'data/images', 'data/headings', 'data/qa_issues']) AS folder"""
ORACLES["report_filter"] = f"SELECT * FROM ({ITEMS}) WHERE contains(lower(title), 'brand#1')"
ORACLES["report_sort"] = f'SELECT page_id, "index", price FROM ({ITEMS})'
ORACLES["report_order"] = f"""SELECT row_number() OVER (ORDER BY CAST(printf('%.2f', p_retailprice) AS DOUBLE) DESC, page_id, "index") AS place,
  page_id, "index" FROM (SELECT *, p_partkey // 20 AS page_id, CAST(p_partkey % 20 + 1 AS INTEGER) AS "index" FROM part)"""
ORACLES["report_title_order"] = """SELECT row_number() OVER (ORDER BY p_partkey) AS place, p_partkey // 20 AS page_id,
  CAST(p_partkey % 20 + 1 AS INTEGER) AS "index", 'no. ' || p_partkey AS title FROM part"""
ORACLES["issue_order"] = f"""WITH {FAULTY_HEADER} SELECT row_number() OVER (ORDER BY array_position(['High', 'Medium', 'Low'], severity),
  page_id, array_position(['Missing <title>', 'Long <title>', 'Missing meta description', 'Missing lang attribute', 'No <h1>',
  'Multiple <h1>'], "check")) AS place, page_id, severity, "check" FROM ({QA_HEADER})"""
ORACLES["preview_images"] = f"""SELECT p_partkey // 20 AS page_id, '{SHOP}/img/' || p_partkey || '.jpg' AS src, p_name AS alt
FROM part ORDER BY p_partkey LIMIT 500"""
ORACLES["jsonl_round_trip"] = ITEMS
ORACLES["document_files"] = ITEMS
ORACLES["catalog_tables"] = f"""SELECT 'items' AS table_name, CAST(sum(cards) AS BIGINT) AS n FROM ({PER_PAGE})
UNION ALL SELECT 'links', CAST(sum(cards + 2) AS BIGINT) FROM ({PER_PAGE}) UNION ALL SELECT 'images', CAST(sum(cards) AS BIGINT) FROM ({PER_PAGE})
UNION ALL SELECT 'headings', CAST(sum(1 + cards) AS BIGINT) FROM ({PER_PAGE}) UNION ALL SELECT 'qa_issues', 0 UNION ALL SELECT 'run_meta', 1"""
ORACLES["table_files"] = ORACLES["table_cells"]
ORACLES["pushed_rows"] = f"""SELECT fingerprint, title, CAST(2 AS BIGINT) AS times, (SELECT count(*) FROM part) AS pushed FROM ({MARKED})"""
ORACLES["html_files"] = f"WITH {HEADER} SELECT page_id, title, lang FROM header"
ORACLES["done_twice"] = """SELECT url, count(*) AS times, true AS done FROM pages WHERE page_id % 4 <> 3 GROUP BY url
UNION ALL SELECT url, count(*), false FROM pages WHERE page_id % 4 = 3 AND url NOT IN (SELECT url FROM pages WHERE page_id % 4 <> 3) GROUP BY url"""
ORACLES["preview"] = f'SELECT * FROM ({ITEMS}) ORDER BY page_id, "index" LIMIT 2000'

# ---------------------------------------------------------------- JSON

ORDER_ITEM = """o_orderkey // 25 AS payload_id, CAST(o_orderkey % 25 + 1 AS INTEGER) AS "index\""""
ORACLES["json_items"] = f"""SELECT {ORDER_ITEM}, 'order ' || o_orderkey AS title, {money("o_totalprice")} AS price,
  '/o/' || o_orderkey AS link, '' AS image, o_orderstatus AS text FROM orders"""
ORACLES["json_mapped_items"] = f"""SELECT {ORDER_ITEM}, o_orderpriority AS title, {money("o_totalprice")} AS price,
  '' AS link, '' AS image, CAST(o_orderkey AS VARCHAR) AS text FROM orders"""
ORACLES["payload_files"] = f"SELECT payload_id, \"index\", title, price FROM ({ORACLES['json_items']})"
ORACLES["capped_json_items"] = f"SELECT payload_id, \"index\", title FROM ({ORACLES['json_items']}) WHERE \"index\" <= 7"
ORACLES["json_field_map"] = """SELECT payload_id, field, key FROM (SELECT DISTINCT o_orderkey // 25 AS payload_id FROM orders),
(VALUES ('title', 'Name'), ('price', 'cost'), ('link', 'url'), ('image', ''), ('text', 'summary')) v(field, key)"""
ORACLES["json_path_values"] = """SELECT o_orderkey // 25 AS payload_id, count(*) AS n,
  CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY 1"""
ORACLES["event_items"] = """SELECT event_id, 1 AS "index", json_extract_string(props, '$.k') AS title FROM events"""
ORACLES["reply_items"] = f"""SELECT p_partkey // 10 AS reply_id, CAST(p_partkey % 10 + 1 AS INTEGER) AS "index",
  p_name AS title, {money("p_retailprice")} AS price, '/p/' || p_partkey AS link, '' AS image, '' AS text
FROM part WHERE (p_partkey // 10) % 10 != 9"""

# ---------------------------------------------------------------- links, sites, graphs

HREFS = f"{LINKS}, hrefs AS (SELECT page_id, pos, text, {SITE_OF} || raw AS href FROM links)"
ANSWER = """CASE length(href) % 5 WHEN 0 THEN ['OK', '200'] WHEN 1 THEN ['OK', '301'] WHEN 2 THEN ['BROKEN', '404']
  WHEN 3 THEN ['RESTRICTED', '403'] ELSE ['ERROR', 'Timeout'] END"""
ORACLES["finished_run"] = FINISHED.replace("ANSWER", ANSWER)
ORACLES["check_links"] = f"""WITH {HREFS} SELECT page_id, pos, text, href, 'internal' AS type,
  ({ANSWER})[1] AS status, ({ANSWER})[2] AS detail FROM hrefs"""
ORACLES["broken_links"] = f"""WITH {HREFS}, each_one AS (SELECT DISTINCT href, {ANSWER} AS a FROM hrefs)
SELECT CAST(NULL AS BIGINT) AS page_id, CASE a[1] WHEN 'BROKEN' THEN 'High' ELSE 'Medium' END AS severity,
  CASE a[1] WHEN 'BROKEN' THEN 'Broken link' ELSE 'Link check failed' END AS "check",
  a[1] || ' (' || a[2] || ')' AS detail, href AS "where" FROM each_one WHERE a[1] IN ('BROKEN', 'ERROR')"""
CANDIDATES = f"""WITH {HREFS}, firsts AS (SELECT href, min(struct_pack(p := page_id, q := pos)) AS spot FROM hrefs GROUP BY href)
SELECT href, spot.p AS page_id, spot.q AS pos FROM firsts"""
ORACLES["link_candidates"] = CANDIDATES
ORACLES["first_link_candidates"] = f"{CANDIDATES} ORDER BY spot LIMIT 100"
ORACLES["crawlable_links"] = f"WITH {HREFS} SELECT page_id, pos, rtrim(href, '/') AS url FROM hrefs"
ORACLES["robots_filter"] = f"""WITH site AS (SELECT page_id, length({SITE_OF}) % 4 AS kind,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS path FROM pages)
SELECT page_id, CASE WHEN kind < 2 THEN true WHEN kind = 2 THEN NOT starts_with(path, '/en/')
  WHEN starts_with(path, '/de/') THEN true ELSE NOT (starts_with(path, '/d') OR starts_with(path, '/e')) END AS allowed
FROM site"""
ORACLES["crawl_site"] = """WITH RECURSIVE walk AS (
  SELECT o_orderkey AS k, 0 AS depth FROM orders WHERE o_orderkey = 0
  UNION ALL
  SELECT o_orderkey, depth + 1 FROM walk JOIN orders ON o_orderkey IN (2 * k + 1, 2 * k + 2)
  WHERE o_orderkey % 11 != 5)
SELECT 'https://site.example.com/n/' || k AS url, CAST(depth AS INTEGER) AS depth,
  row_number() OVER (ORDER BY k) AS visit_no FROM walk"""
ORACLES["paginate"] = """WITH RECURSIVE n AS (SELECT max(p_partkey) AS last FROM part),
step AS (
  SELECT p_partkey AS start, 1 AS page_no, p_partkey AS k, [p_partkey] AS seen FROM part
  UNION ALL
  SELECT start, page_no + 1, t, list_append(seen, t) FROM (
    SELECT *, CASE WHEN k % 9 = 4 THEN k - 1 ELSE k + 1 END AS t FROM step), n
  WHERE t <= last AND NOT list_contains(seen, t))
SELECT 'https://chain.example.com/p/' || start AS start, CAST(page_no AS INTEGER) AS page_no,
  'https://chain.example.com/p/' || k AS url FROM step"""
SIGNALS = f"""signals AS (SELECT n AS page_id, n % 4 AS kind,
  CASE WHEN n % 4 IN (0, 3) THEN cards ELSE 0 END AS auto_items,
  CASE n % 4 WHEN 2 THEN 0 ELSE cards END AS fallback_items, n % 3 != 2 AND (n % 3 = 1) AS has_next
  FROM ({PER_PAGE}))"""
ORACLES["page_signals"] = f"""WITH {SIGNALS} SELECT page_id, CAST(auto_items AS INTEGER) AS auto_items,
  CASE WHEN auto_items > 0 THEN 'html > body > main > article.card' ELSE '' END AS auto_selector,
  CAST(fallback_items AS INTEGER) AS fallback_items,
  CASE kind WHEN 1 THEN 'div[class*=''item'']' WHEN 2 THEN '' ELSE 'article.card' END AS fallback_selector,
  'generic' AS preset, 0 AS preset_score, has_next, kind = 2 AS has_login, kind = 3 AS has_captcha FROM signals"""
ORACLES["verdicts"] = f"""WITH {SIGNALS} SELECT page_id,
  CASE WHEN page_id % 7 = 6 THEN 'DECLINE' WHEN page_id % 11 = 10 THEN 'HARD' WHEN kind = 3 THEN 'DECLINE'
    WHEN auto_items >= 10 THEN 'EASY' WHEN fallback_items >= 10 THEN 'MEDIUM' ELSE 'HARD' END AS verdict,
  CASE WHEN page_id % 7 = 6 THEN 'robots.txt disallows this path'
    WHEN page_id % 11 = 10 THEN 'known anti-bot site (amazon) — expected to block scraping after a few pages'
    WHEN kind = 3 THEN 'site uses CAPTCHA — unreliable to scrape'
    WHEN auto_items >= 10 THEN 'auto-detected ' || auto_items || ' items in the card block'
    WHEN fallback_items >= 10 THEN 'auto-detect failed but `div[class*=''item'']` returns ' || fallback_items || ' items'
    WHEN kind = 2 THEN 'login-walled — needs --interactive --save-session'
    ELSE 'could not find repeating items with common selectors' END AS reason FROM signals"""

# ---------------------------------------------------------------- incremental, errors

ORACLES["pending_pages"] = "SELECT page_id, url FROM pages WHERE length(url) % 2 = 1"
ORACLES["latest_by_key"] = """SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""
ORACLES["upsert_users"] = """WITH ranked AS (SELECT user_id, event_id, event_type FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id DESC) = 1)
SELECT user_id, event_id, event_type FROM ranked
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 = 0) = 1"""
ORACLES["stream_dedupe"] = """SELECT sha1('e.example.com/u/' || user_id)[:16] AS fingerprint, min(event_id) AS page_id
FROM events GROUP BY user_id"""
ORACLES["map_with_errors"] = """SELECT event_id, CASE WHEN k % 10 != 0 THEN CAST(2 * k AS VARCHAR) END AS result,
  CASE WHEN k % 10 = 0 THEN 'ValueError: round number' END AS error
FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""
ORACLES["skip_bad_rows"] = (
    "SELECT event_id, 1.0 / (event_id % 4)::DOUBLE AS result FROM events WHERE event_id % 4 != 0"
)
