"""The core's queries in DuckDB's SQL, and the test cases that both sides share."""

from __future__ import annotations

from folio import cases
from folio.functions.site import SUFFIXES, TRACKER_HOSTS

__all__ = ["ADDRESSES", "COOKIES", "EDGES", "GLOBS", "HOSTS", "ROBOTS", "SELECTORS", "oracle_sql"]

ADDRESSES = [
    "http://127.0.0.1/", "http://10.1.2.3/x", "http://172.16.0.1/", "http://172.32.0.1/", "http://192.168.1.1/", "http://169.254.169.254/latest", "http://100.64.0.1/", "http://100.128.0.1/", "http://192.0.0.5/", "http://192.0.2.1/",
    "http://198.18.0.1/", "http://198.51.100.7/", "http://203.0.113.9/", "http://240.0.0.1/", "http://255.255.255.255/", "http://0.0.0.0/", "http://8.8.8.8/", "http://localhost:8080/", "https://a.localhost/", "ftp://a.example/", "file:///etc/passwd",
    "http:///nohost", "https://packet-notes.example/", "https://www.packet-notes.example/x", "https://notpacket-notes.example/",
]
HOSTS = ["www.google-analytics.com", "stats.g.doubleclick.net", "example.org", "sub.hotjar.com", "nothotjar.com", "twitter.com", "mc.yandex.ru", "yandex.ru", "news.co.uk", "a.b.criteo.net."]
ROBOTS = "# rules\nUser-agent: *\nDisallow: /a/\nAllow: /a/what\nDisallow:\n\nUser-agent: ExampleBot\nUser-agent: other\nDisallow: /science/\nAllow: /science/how\nDisallow: /r # moved\nCrawl-delay: 5\n"
GLOBS = ["https://*/a/*", "http://www.*", "*.html", "https://go.linkhop.example/?", "*?s=law"]
COOKIES = [("a=1; b=2", ["a=3; Path=/"]), ("", ["x=1", "y = 2 ; Secure", "novalue", "=z"]), ("a=1", ["a=", "b=2", "a=4; Max-Age=1"])]
EDGES = [("u1", "u2"), ("u2", "u3"), ("u3", "u4"), ("u4", "u5"), ("u5", "u6"), ("s1", "s1"), ("l1", "l2"), ("l2", "l1"), ("x1", "x2")]
#: name -> (selector, SQL that counts the same in the text of a page)
SELECTORS = {
    "heading": ("h1, h2, h3, h4", "len(regexp_extract_all(html, '(?i)<h[1-4][ >]'))"),
    "class": ("div.c0", "len(regexp_extract_all(html, '<div class=\"c0\"'))"),
    "attr": ("div[class]", "len(regexp_extract_all(html, '(?i)<div [^>]*class='))"),
    "attr_prefix": ("link[href^='https://']", "len(regexp_extract_all(html, '<link rel=\"canonical\" href=\"https://'))"),
    "attr_word": ("div[class~='main']", "len(regexp_extract_all(html, '<div class=\"page-content main\"')) + len(regexp_extract_all(html, '<div class=\"main\"'))"),
    "id": ("#thread", "len(regexp_extract_all(html, ' id=\"thread\"'))"),
    "item": ("li", "len(regexp_extract_all(html, '(?i)<li[ >]'))"),
    "figure": ("figcaption", "len(regexp_extract_all(html, '(?i)<figcaption[ >]'))"),
    "union": ("nav, aside, footer", "len(regexp_extract_all(html, '(?i)<(?:nav|aside|footer)[ >]'))"),
    "never": ("a:visited", "0"),
}

_V = lambda rows: ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
_HOST = "rtrim(lower(regexp_extract({u}, '^\\s*[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.')"


def host(u: str) -> str:
    return _HOST.format(u=u)


def domain(h: str) -> str:
    parts = f"string_split({h}, '.')"
    two = f"array_to_string({parts}[-2:], '.')"
    v4 = "regexp_full_match(" + h + ", '(?:(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)\\.){3}(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)')"
    return f"CASE WHEN len({parts}) < 3 OR {v4} OR contains({h}, ':') THEN {h} WHEN {two} IN ({', '.join(repr(s) for s in SUFFIXES)}) THEN array_to_string({parts}[-3:], '.') ELSE {two} END"


_SPACE = "[\\s\\x{85}\\p{Z}]"


def _strip(t: str) -> str:
    out = f"regexp_replace({t}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
    for sep in (" :: ", " · ", " - ", " | ", " – ", " — "):
        tail = f"list_last(string_split({t}, '{sep}'))"
        head = f"left({t}, length({t}) - length({tail}) - {len(sep)})"
        out = f"CASE WHEN contains({t}, '{sep}') AND trim({head}) <> '' AND length({tail}) <= 40 AND length({head}) > length({tail}) THEN trim({head}) ELSE {out} END"
    return out


def _signature(e: str) -> str:
    pattern = "([A-Za-z]*Error):\\s*([^\\n]{0,90})"
    masked = f"regexp_replace(regexp_replace(regexp_extract({e}, '{pattern}', 2), 'https?://\\S+', '<url>', 'g'), '\\b\\d+\\b', 'N', 'g')"
    other = f"left(regexp_replace(string_split({e}, chr(10))[1], 'https?://\\S+', '<url>', 'g'), 80)"
    return f"CASE WHEN regexp_extract({e}, '{pattern}', 1) = '' THEN {other} ELSE left(regexp_extract({e}, '{pattern}', 1) || ': ' || trim({masked}), 90) END"


_READS = """reads AS (SELECT read_id, arg_min(site, arrived_at) AS site, arg_min(text, arrived_at) AS text, arg_min(chrome_text, arrived_at) AS chrome_text, arg_min(status, arrived_at) AS status, arg_min(ms, arrived_at) AS ms,
  arg_min(coalesce(failure, ''), arrived_at) AS failure, arg_min(errors, arrived_at) AS errors FROM corpus_row WHERE read_id IS NOT NULL GROUP BY read_id)"""
_CLASS = """CASE WHEN failure <> '' THEN 'refused' WHEN coalesce(chrome_text, 0) < 400 AND coalesce(text, 0) < 400 THEN 'both empty' WHEN coalesce(chrome_text, 0) < 400 THEN 'browser empty, engine has text'
  WHEN text < 0.1 * chrome_text THEN 'empty' WHEN text < 0.6 * chrome_text THEN 'partial' ELSE 'reads' END"""
_TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
_CLEAN_TITLE = f"trim(regexp_replace(replace(replace(replace({_TITLE}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '{_SPACE}+', ' ', 'g'))"
_PATH = "regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1)"
_JARS = "jars AS (SELECT response_id, min(list_transform(list_filter(headers, lambda h: lower(h.name) = 'set-cookie'), lambda h: h.value)) AS writes FROM responses GROUP BY response_id), jar AS (SELECT response_id, writes, array_to_string(writes, '; ') AS jar FROM jars)"
_CT = "(list_filter(headers, lambda h: lower(h.name) = 'content-type')[1]).value"
_KIND = f"trim(string_split(lower(coalesce({_CT}, '')), ';')[1])"
_KINDS = f"""CASE WHEN {_KIND} = 'application/pdf' OR starts_with(coalesce(raw, ''::BLOB)::VARCHAR, '%PDF-') THEN 'pdf' WHEN {_KIND} IN ('text/html', 'application/xhtml+xml') THEN 'html' WHEN {_KIND} IN ('application/json', 'text/json', 'application/ld+json') THEN 'json'
  WHEN {_KIND} IN ('application/xml', 'text/xml', 'application/rss+xml', 'application/atom+xml') THEN 'xml' WHEN starts_with({_KIND}, 'text/') THEN 'text' WHEN starts_with({_KIND}, 'image/') THEN 'image' WHEN starts_with({_KIND}, 'audio/') OR starts_with({_KIND}, 'video/') THEN 'media' ELSE 'other' END"""
_BLOCK = "CASE WHEN status = 403 THEN '403: the server refused the request' WHEN status = 429 THEN '429: rate limited' WHEN status = 439 THEN '439: the site''s bot check refused the request' WHEN status = 503 AND strlen(html) < 20000 THEN '503: likely a bot-check interstitial' END"
_O = [f"TRY_CAST(string_split(h, '.')[{k}] AS INT)" for k in (1, 2, 3, 4)]
_PRIVATE = f"""regexp_full_match(h, '(?:(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)\\.){{3}}(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)') AND ({_O[0]} IN (127, 10) OR h = '0.0.0.0' OR ({_O[0]} = 172 AND {_O[1]} BETWEEN 16 AND 31) OR ({_O[0]} = 192 AND {_O[1]} = 168)
  OR ({_O[0]} = 169 AND {_O[1]} = 254) OR ({_O[0]} = 192 AND {_O[1]} = 0 AND {_O[2]} IN (0, 2)) OR ({_O[0]} = 198 AND {_O[1]} = 51 AND {_O[2]} = 100) OR ({_O[0]} = 203 AND {_O[1]} = 0 AND {_O[2]} = 113) OR ({_O[0]} = 100 AND {_O[1]} BETWEEN 64 AND 127)
  OR ({_O[0]} = 198 AND {_O[1]} IN (18, 19)) OR {_O[0]} >= 240)"""


def _relation() -> str:
    o = lambda u: f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1)) || '|' || {host(u)} || '|' || CASE WHEN regexp_extract({u}, '^[A-Za-z]+://[^/?#:]+:(\\d+)', 1) <> '' THEN regexp_extract({u}, '^[A-Za-z]+://[^/?#:]+:(\\d+)', 1) WHEN starts_with(lower({u}), 'https:') THEN '443' ELSE '80' END"
    two = lambda u: f"array_to_string(string_split({host(u)}, '.')[-2:], '.')"
    return f"""WITH f AS (SELECT page_id, min(final_url) AS final_url FROM render_report GROUP BY page_id)
SELECT page_id, CASE WHEN {o('url')} = {o('final_url')} THEN 'same-origin' WHEN {two('url')} = {two('final_url')} THEN 'same-site' ELSE 'cross-site' END AS relation,
  {domain(host('url'))} = {domain(host('final_url'))} AS same_site FROM pages JOIN f USING (page_id)"""


def oracle_sql() -> dict[str, str]:
    out = {
        "domain_counts": f"SELECT {domain(host('url'))} AS domain, count(*) AS pages FROM pages GROUP BY 1",
        "host_site_relation": _relation(),
        "url_policy": f"""WITH u AS (SELECT DISTINCT url FROM responses UNION ALL SELECT * FROM (VALUES {_V((a,) for a in ADDRESSES)}) v(url)), h AS (SELECT url, lower(regexp_extract(url, '^\\s*([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS s, lower(regexp_extract(url, '^\\s*[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]+)', 1)) AS h FROM u)
SELECT url, CASE WHEN s NOT IN ('http', 'https') THEN 'scheme' WHEN h = '' THEN 'no host' WHEN h = 'packet-notes.example' OR ends_with(h, '.packet-notes.example') THEN 'host' WHEN {_PRIVATE} THEN 'private address' WHEN h = 'localhost' OR ends_with(h, '.localhost') THEN 'host' END AS error FROM h""",
        "tracker_flag": f"""WITH h AS (SELECT DISTINCT {host('url')} AS host FROM pages UNION ALL SELECT * FROM (VALUES {_V((x,) for x in HOSTS)}) v(host)), t AS (SELECT * FROM (VALUES {_V((x,) for x in TRACKER_HOSTS)}) v(t))
SELECT host, EXISTS (SELECT 1 FROM t WHERE lower(rtrim(host, '.')) = t OR ends_with(lower(rtrim(host, '.')), '.' || t)) AS tracker FROM h""",
        "page_site": f"""WITH f AS (SELECT page_id, min(final_url) AS final_url FROM render_report WHERE page_id IN (SELECT page_id FROM pages) GROUP BY page_id), h AS (SELECT page_id, {host('final_url')} AS h FROM f)
SELECT page_id, arg_max(site, length(site)) AS site FROM h JOIN sites ON h = lower(site) OR ends_with(h, '.' || lower(site)) GROUP BY page_id""",
        "robots_rules": f"SELECT site AS origin, agent, pattern, allowed, ord FROM sites, (VALUES {_V([('*', '/a/', False, 2), ('*', '/a/what', True, 3), ('examplebot', '/science/', False, 8), ('examplebot', '/science/how', True, 9), ('examplebot', '/r', False, 10), ('other', '/science/', False, 8), ('other', '/science/how', True, 9), ('other', '/r', False, 10)])}) v(agent, pattern, allowed, ord)".replace("ord FROM", "CAST(ord AS BIGINT) AS ord FROM"),
        "robots_verdict": f"""WITH p AS (SELECT page_id, regexp_replace({host('url')}, '^www\\.', '') AS origin, {_PATH} AS path FROM pages)
SELECT page_id, path, NOT (origin IN (SELECT site FROM sites) AND (starts_with(path, '/r') OR starts_with(path, '/science/') AND NOT starts_with(path, '/science/how'))) AS allowed FROM p""",
        "glob_match": "SELECT url, pattern FROM (SELECT DISTINCT url FROM pages) p JOIN (VALUES " + _V([(GLOBS[0], "^https://.*/a/.*$"), (GLOBS[1], "^http://www\\..*$"), (GLOBS[2], "^.*\\.html$"), (GLOBS[3], "^https://go\\.linkhop\\.example/.$"), (GLOBS[4], "^.*.s=law$")]) + ") g(pattern, re) ON regexp_matches(url, re, 's')",
        "cookie_pairs": f"WITH {_JARS}, p AS (SELECT response_id, unnest(list_filter(string_split(jar, ';'), lambda x: contains(x, '='))) AS part, generate_subscripts(list_filter(string_split(jar, ';'), lambda x: contains(x, '=')), 1) - 1 AS n FROM jar) SELECT response_id, CAST(n AS BIGINT) AS n, trim(string_split(part, '=')[1]) AS name, trim(regexp_replace(part, '^[^=]*=', '')) AS value FROM p",
        "cookie_fingerprint": f"WITH {_JARS} SELECT array_to_string(list_sort(string_split(jar, '; ')), '; ') AS fingerprint, count(*) AS responses FROM jar WHERE jar <> '' GROUP BY 1",
        "cookie_candidates": f"""WITH u AS (SELECT DISTINCT url, string_split({host('url')}, '.') AS l, string_split({_PATH}, '/') AS p FROM responses)
SELECT url, array_to_string(list_transform(range(1, greatest(len(l), 2)), lambda i: array_to_string(l[i:], '.')), ' ') AS domains,
  array_to_string(list_concat(list_transform(list_reverse(range(2, len(p) + 1)), lambda k: array_to_string(p[1:k], '/')), CASE WHEN len(p) > 2 OR p[2] <> '' THEN ['/'] ELSE [] END), ' ') AS paths FROM u""",
        "cookie_writes": f"WITH {_JARS} SELECT response_id, 's=1' || CASE WHEN len(writes) = 0 THEN '' ELSE '; ' || array_to_string(list_transform(writes, lambda w: trim(string_split(w, ';')[1])), '; ') END AS jar FROM jar UNION ALL SELECT * FROM (VALUES (-1, 'a=3; b=2'), (-2, 'x=1; y=2'), (-3, 'a=4; b=2')) v(response_id, jar)",
        "content_type_charset": f"SELECT DISTINCT response_id, nullif(regexp_extract(lower({_CT}), 'charset\\s*=\\s*[''\"]*([^''\"; ]+)', 1), '') AS charset FROM responses",
        "content_kind": f"WITH k AS (SELECT DISTINCT response_id, {_KINDS} AS kind FROM responses) SELECT response_id, kind, kind IN ('html', 'xml', 'text') AS readable FROM k",
        "meta_charset": "SELECT page_id, nullif(lower(regexp_extract(left(html, 8192), '(?i)<meta\\s+charset=\"?([^\">\\s]+)', 1)), '') AS charset FROM pages WHERE html IS NOT NULL",
        "body_limit": "SELECT DISTINCT response_id, CAST(least(strlen(body), 1000) AS BIGINT) AS kept, strlen(body) > 1000 AS cut FROM responses WHERE body IS NOT NULL",
        "block_reason": f"SELECT page_id, status, {_BLOCK} AS reason FROM (SELECT DISTINCT page_id, status FROM render_report) r JOIN pages USING (page_id)",
        "canned_routes": "SELECT url, CASE WHEN contains(url, '/api/json') THEN 200 WHEN contains(url, '/api/') THEN 200 WHEN contains(url, 'trois') THEN 404 END AS status, CASE WHEN contains(url, '/api/json') THEN 'application/json' WHEN contains(url, '/api/') THEN 'text/plain' WHEN contains(url, 'trois') THEN 'text/html' END AS content_type, CASE WHEN contains(url, '/api/json') THEN '{}' WHEN contains(url, '/api/') THEN 'ok' WHEN contains(url, 'trois') THEN '' END AS body FROM (SELECT DISTINCT url FROM responses)",
        "listed_pages": "SELECT trim(url) AS url FROM pages",
        "page_title": f"WITH t AS (SELECT page_id, {_CLEAN_TITLE} AS t FROM pages WHERE html IS NOT NULL) SELECT page_id, t AS title, {_strip('t')} AS headline FROM t",
        "html_lang": "SELECT page_id, nullif(trim(regexp_extract(html, '(?i)<html[^>]*\\slang=\"([^\"]*)\"', 1)), '') AS lang FROM pages WHERE html IS NOT NULL",
        "script_inventory": """WITH s AS (SELECT page_id, regexp_extract_all(source_html, '(?i)<script[^>]*>') AS tags FROM pages WHERE source_html IS NOT NULL), k AS (SELECT page_id, tags, list_transform(tags, lambda x: lower(regexp_extract(x, '(?i)type="([^"]*)"', 1))) AS kinds FROM s)
SELECT page_id, len(tags) AS scripts, len(list_filter(kinds, lambda x: x IN ('', 'text/javascript', 'application/javascript', 'module'))) AS run, len(list_filter(tags, lambda x: contains(x, 'src='))) AS external, len(list_filter(kinds, lambda x: x = 'application/ld+json')) AS structured FROM k""",
        "page_metadata": f"""WITH t AS (SELECT page_id, html, {_CLEAN_TITLE} AS t, coalesce(json_extract_string(nullif(regexp_extract(html, '<script type="application/ld\\+json">(.*?)</script>', 1), ''), '$.datePublished'), '') AS ld, regexp_extract(html, '"@type":"([^"]*)"', 1) AS ty FROM pages)
SELECT page_id, {_strip('t')} AS title, CASE WHEN contains(ty, 'Article') AND ld <> '' THEN ld ELSE coalesce(nullif(regexp_extract(html, '<meta property="article:published_time" content="([^"]+)"', 1), ''), nullif(regexp_extract(html, '<meta name="date" content="([^"]+)"', 1), '')) END AS published,
  nullif(regexp_extract(html, '<meta property="article:modified_time" content="([^"]+)"', 1), '') AS modified, nullif(regexp_extract(html, '<link rel="canonical" href="([^"]*)"', 1), '') AS canonical_url, nullif(regexp_extract(html, '(?i)<html[^>]*\\slang="([^"]*)"', 1), '') AS language, ty AS schema_types FROM t""",
        "page_links": f"""WITH l AS (SELECT page_id, unnest(list_distinct_ordered) AS href, generate_subscripts(list_distinct_ordered, 1) - 1 AS n FROM (SELECT page_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS list_distinct_ordered FROM (SELECT page_id, list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: regexp_replace(regexp_replace(lower(regexp_extract(url, '^([a-z]+://[^/]*)', 1)), '^(https://.*):443$', '\\1'), '^(http://.*):80$', '\\1') || x) AS a FROM pages WHERE html IS NOT NULL)))
SELECT page_id, CAST(n AS BIGINT) AS n, href FROM l""",
        "element_counts": "SELECT lower(regexp_extract(x, '<([a-zA-Z0-9]+)', 1)) AS tag, count(*) AS elements FROM (SELECT unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', '', 'g'), '(?i)<(?:div|h1|h2|h3|h4|ul|ol|li|blockquote|figure|nav|header|footer|aside|main|article|section|img|pre)(?:[ >])')) AS x FROM pages) GROUP BY 1",
        "head_titles": f"SELECT page_id, trim(replace(replace(replace({_TITLE}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title FROM pages WHERE {_TITLE} <> ''",
        "meta_tags": """WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '<meta (?:name|property)="([^"]+)" content="([^"]*)">', 1)) AS key, unnest(regexp_extract_all(html, '<meta (?:name|property)="([^"]+)" content="([^"]*)">', 2)) AS content, unnest(range(1, 100)) AS k FROM pages)
SELECT page_id, lower(key) AS key, arg_min(content, k) AS content FROM m WHERE trim(content) <> '' GROUP BY 1, 2""",
        "sql_functions": f"""SELECT page_id, CAST(len(regexp_extract_all(regexp_replace(coalesce(html, ''), '(?is)<noscript[^>]*>.*?</noscript>', '', 'g'), '(?i)<li[ >]')) AS INT) AS items, {host('url')} AS host, regexp_replace(regexp_replace(lower(regexp_extract(url, '^([a-z]+://[^/]*)', 1)), '^(https://.*):443$', '\\1'), '^(http://.*):80$', '\\1') || '/x?y#z' AS target FROM pages""",
        "seed_score": "SELECT doc_id, round(1.0 + length(t) - length(replace(t, ',', '')) + length(t) - length(replace(t, '，', '')) + least(length(t) / 100.0, 3.0), 4) AS score FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
        "strip_site_suffix": f"WITH t AS (SELECT doc_id, title || ' - ' || coalesce(source, '') AS t FROM documents WHERE title IS NOT NULL) SELECT doc_id, {_strip('t')} AS title FROM t",
        "truncate_chars": """WITH c AS (SELECT doc_id, regexp_replace(text, '[ \t\r\n]+', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, t, left(t, 300) AS cut, regexp_extract(left(t, 300), '(?s)^(.*) ', 1) AS head FROM c)
SELECT doc_id, CASE WHEN length(t) <= 300 THEN t WHEN contains(cut, ' ') AND strlen(head) > 150 THEN head || '…' ELSE cut || '…' END AS summary FROM h""",
        "front_matter": "SELECT page_id, '---' || chr(10) || " + " || ".join(f"CASE WHEN {c} IS NULL THEN '' ELSE '{n}: \"' || replace(replace({c}, '\\', '\\\\'), '\"', '\\\"') || '\"' || chr(10) END" for n, c in (("title", "title"), ("author", "author"), ("site", "site_name"), ("published", "published"), ("url", "canonical_url"), ("description", "description")))
        + " || 'length: ' || length(coalesce(description, '')) || chr(10) || CASE WHEN length(coalesce(description, '')) < 50 THEN 'low_confidence: true' || chr(10) ELSE '' END || '---' || chr(10) || chr(10) AS head FROM page_meta",
        "scrape_outcomes": """WITH r AS (SELECT page_id, max(status) AS status, min(content_kind) AS k FROM render_report GROUP BY page_id), e AS (SELECT page_id, url, k, CASE WHEN k IS NULL THEN 'no response' WHEN k NOT IN ('html', 'xml', 'text') THEN 'not readable: ' || k WHEN status >= 400 THEN 'status ' || status END AS error FROM pages LEFT JOIN r USING (page_id))
SELECT page_id, CASE WHEN error IS NULL THEN '{"kind":"' || k || '","url":"' || url || '"}' ELSE '{"error":"' || error || '","url":"' || url || '"}' END AS record FROM e""",
        "batch_summary": "WITH r AS (SELECT page_id, max(total_ms) AS ms, max(coalesce(len(errors) > 0, false)) AS bad FROM render_report GROUP BY page_id) SELECT count(*) AS pages, CAST(greatest(sum(ms), 1) AS BIGINT) AS total_ms, round(count(*) * 1000.0 / greatest(sum(ms), 1), 3) AS pages_per_s, CAST(count_if(bad) AS BIGINT) AS failed FROM r",
        "report_errors": f"SELECT signature, count(*) AS pages FROM (SELECT DISTINCT page_id, {_signature('e')} AS signature FROM (SELECT page_id, unnest(errors) AS e FROM render_report)) GROUP BY 1",
        "corpus_classify": f"WITH {_READS} SELECT read_id, {_CLASS} AS class FROM reads",
        "corpus_class_counts": f"WITH {_READS}, c AS (SELECT {_CLASS} AS class, count(*) AS reads FROM reads GROUP BY 1) SELECT class, reads, round(100.0 * reads / sum(reads) OVER (), 1) AS share FROM c",
        "corpus_errors": f"WITH {_READS} SELECT signature, count(*) AS reads FROM (SELECT DISTINCT read_id, {_signature('e')} AS signature FROM (SELECT read_id, unnest(errors) AS e FROM reads)) GROUP BY 1 ORDER BY reads DESC, signature LIMIT 15",
        "corpus_failures": f"WITH {_READS} SELECT left(failure, 60) AS failure, count(*) AS reads FROM reads WHERE failure <> '' GROUP BY 1 ORDER BY reads DESC, failure LIMIT 8",
        "latency_median_p90": f"WITH {_READS}, o AS (SELECT site, ms, row_number() OVER (PARTITION BY site ORDER BY ms) - 1 AS k, count(*) OVER (PARTITION BY site) AS n FROM reads WHERE status = 200 AND ms > 0) SELECT site, CAST(any_value(n) AS BIGINT) AS reads, round(median(ms), 1) AS median_ms, max(CASE WHEN k = floor(n * 9 / 10) THEN ms END) AS p90_ms FROM o GROUP BY site",
        "read_medians": f"WITH {_READS}, p AS (SELECT read_id, arg_min(page_id, arrived_at) AS page_id FROM corpus_row WHERE read_id IS NOT NULL GROUP BY read_id), r AS (SELECT page_id, ms, row_number() OVER (PARTITION BY page_id ORDER BY read_id) AS n FROM reads JOIN p USING (read_id) WHERE status = 200 AND ms IS NOT NULL) SELECT page_id, count(*) AS runs, median(ms) AS median FROM r WHERE n > 1 GROUP BY page_id",
        "fetch_patterns": f"SELECT DISTINCT response_id FROM (SELECT response_id, url, {_KINDS} AS kind FROM responses) WHERE contains(url, '/api/') AND kind = 'json'",
        "late_reads": "SELECT site, CAST(floor((epoch(date_trunc('second', arrived_at)) - epoch(date_trunc('second', started_at))) / 86400) AS BIGINT) AS days, count(DISTINCT read_id) AS reads FROM corpus_row WHERE read_id IS NOT NULL GROUP BY 1, 2",
        "feed_kinds": "SELECT f.kind AS kind, count(*) AS feeds, count(DISTINCT f.url) AS addresses FROM (SELECT unnest(feeds) AS f FROM page_meta) GROUP BY 1",
        "schema_types": "SELECT type, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(schema_types) AS type FROM page_meta) GROUP BY 1",
        "timer_fire_order": """WITH t AS (SELECT user_id, event_id AS timer_id, CAST((event_id * 37) % 15000 AS BIGINT) AS due_ms, event_type FROM events WHERE event_type <> 'signup'), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, due_ms, timer_id) AS rank FROM t WHERE due_ms <= 10000)
SELECT user_id, timer_id, due_ms, rank FROM r WHERE rank <= 10000""",
        "timer_intervals": "SELECT user_id, event_id AS timer_id, CAST((10000 - d) // greatest(d, 1) + 1 AS BIGINT) AS fired, CAST(d + (10000 - d) // greatest(d, 1) * greatest(d, 1) AS BIGINT) AS last_ms FROM (SELECT user_id, event_id, (event_id * 37) % 15000 AS d FROM events WHERE event_type = 'view') WHERE d <= 10000",
        "admitted_requests": "SELECT page_id, response_id FROM (SELECT page_id, response_id, row_number() OVER (PARTITION BY page_id ORDER BY response_id) AS n FROM (SELECT DISTINCT page_id, response_id FROM responses)) WHERE n <= 384",
        "redirect_hops": f"""WITH RECURSIVE e AS (SELECT * FROM (VALUES {_V(EDGES)}) v(url, target)), c AS (SELECT url AS start, url AS place, [url] AS seen, 0 AS hops FROM e UNION ALL SELECT start, target, list_append(seen, target), hops + 1 FROM c JOIN e ON place = e.url WHERE NOT list_contains(seen, target) AND hops < 3)
SELECT start, place AS url, CAST(hops AS BIGINT) AS hops, CASE WHEN target IS NULL THEN 'end' WHEN hops = 3 THEN 'limit' ELSE 'loop' END AS stopped FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hops DESC) AS k FROM c) c LEFT JOIN e ON place = e.url WHERE k = 1""",
        "import_targets": "SELECT page_id, specifier, CASE specifier WHEN 'app' THEN o || '/static/app.js' WHEN 'lib/x.js' THEN o || '/static/lib/x.js' END AS target FROM (SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^([a-z]+://[^/]*)', 1)), '^(https://.*):443$', '\\1'), '^(http://.*):80$', '\\1') AS o FROM pages) p, (VALUES ('app'), ('lib/x.js'), ('other')) v(specifier)",
        "event_windows": "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start_s, event_type, count(*) AS events FROM events GROUP BY 1, 2",
    }
    out |= {
        "selector_cases": cases.values(list(cases.SELECTORS.items()), "selector, ids"),
        "selector_join_cases": cases.values([(s, i) for s in cases.SELECTORS_JOINED for i in cases.SELECTORS[s].split()], "selector, id"),
        "markdown_cases": cases.values([(r[0], r[2]) for r in cases.MARKDOWN], 'name, markdown'),
        "url_join_cases": f"SELECT CAST(n AS BIGINT) AS n, url FROM ({cases.values([(k, r[2]) for k, r in enumerate(cases.JOINS)], 'n, url')})",
        "url_part_cases": f"SELECT CAST(n AS BIGINT) AS n, scheme, host, path, query, fragment FROM ({cases.values([(k, *r[1:]) for k, r in enumerate(cases.PARTS)], 'n, scheme, host, path, query, fragment')})",
        "body_cases": cases.values([(r[0], *r[3:]) for r in cases.BODIES], 'name, charset, text'),
        "kind_cases": cases.values([(r[0], r[3]) for r in cases.KINDS], 'name, kind'),
        "refresh_cases": cases.values([(r[0], r[2]) for r in cases.REFRESH], 'name, target'),
        "link_cases": f"SELECT what, CAST(n AS BIGINT) AS n, href FROM ({cases.values(cases.LINKS[1], 'what, n, href')})",
        "module_cases": cases.values([(r[0], r[2]) for r in cases.MODULES], 'name, imports'),
        "metadata_cases": cases.values([(r[0], r[3]) for r in cases.METADATA], 'name, value'),
        "tree_cases": cases.values([(r[0], r[2]) for r in cases.NODES], 'name, body'),
    }
    for name, (_, sql) in SELECTORS.items():
        out[f"select_{name}"] = f"SELECT page_id, CAST({sql} AS BIGINT) AS elements FROM (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', '', 'g') AS html FROM pages)"
    return out
