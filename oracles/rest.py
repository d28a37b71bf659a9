"""Checking SQL for discovery, models, costs, companies, jobs, elements and sinks."""

from sitelore.functions import vocab as V
from oracles import assembly as A, sqlgen as G, text as X, urls as U
from oracles.sqlgen import arr, build, cte, has, q

NL = "chr(10)"
cte("home_all", f"""SELECT site, arg_min({G.norm('url')}, (CASE WHEN {G.path('url')} IN ('', '/') THEN 0 ELSE 1 END) * 1000000000000 + page_id) AS base_url
  FROM crawl_raw GROUP BY site""")
cte("robots", """SELECT DISTINCT site, 'User-agent: *' || chr(10) || chr(9) || ' SITEMAP:' || chr(9) || ' https://' || site || '/index-' || (page_id // 1000) || '.xml' || chr(10) || 'Disallow: /x' || chr(10) AS body FROM crawl_raw""")
cte("sitemap_starts", f"""SELECT site, trim(regexp_replace(line, '^[^:]*:', ''), ' ' || chr(9)) AS sitemap_url FROM (SELECT site, unnest(string_split(body, chr(10))) AS line FROM robots)
   WHERE starts_with(lower(trim(line, ' ' || chr(9))), 'sitemap:')
  UNION SELECT site, {G.scheme('base_url')} || '://' || {G.netloc('base_url')} || unnest(['/sitemap.xml', '/sitemap_index.xml']) FROM home_all""")
cte("map_files", """SELECT site, page_id // 50 AS n, string_agg('<url><loc> ' || replace(url, '&', '&amp;') || ' </loc></url>', '' ORDER BY page_id) AS entries FROM crawl_raw GROUP BY 1, 2""")
cte("sitemaps", """
  SELECT site, 'https://' || site || '/pages-' || n || '.xml' AS sitemap_url, CASE WHEN n % 5 = 4 THEN '<urlset>' || entries || '</url'
   WHEN n % 5 = 3 THEN '<sm:urlset xmlns:sm="http://www.sitemaps.org/schemas/sitemap/0.9">' || replace(replace(replace(replace(entries, '<url>', '<sm:url>'),
     '</url>', '</sm:url>'), '<loc>', '<sm:loc>'), '</loc>', '</sm:loc>') || '</sm:urlset>'
   WHEN n % 2 = 0 THEN '<urlset>' || entries || '</urlset>'
   ELSE '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || entries || '</urlset>' END AS xml FROM map_files
  UNION ALL SELECT site, 'https://' || site || '/index-' || (n // 20) || '.xml', '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
   || string_agg('<sitemap><loc> https://' || site || '/pages-' || n || '.xml </loc></sitemap>', '' ORDER BY n) || '</sitemapindex>' FROM map_files GROUP BY site, n // 20""")
cte("locs", f"""SELECT site, sitemap_url, replace(trim(unnest(regexp_extract_all(xml, '<(?:sm:)?loc>([^<]*)</(?:sm:)?loc>', 1))), '&amp;', '&') AS loc
  FROM sitemaps WHERE ends_with(xml, '</urlset>') OR ends_with(xml, '</sm:urlset>') OR ends_with(xml, '</sitemapindex>')""")
REACHED = """reached AS (
  SELECT DISTINCT site, sitemap_url FROM sitemap_starts
  UNION SELECT l.site, l.loc FROM reached r JOIN locs l ON l.site = r.site AND l.sitemap_url = r.sitemap_url WHERE ends_with(l.loc, '.xml'))"""
MAP_PAGES = "SELECT DISTINCT l.site, l.loc AS url FROM locs l JOIN reached r USING (site, sitemap_url) WHERE NOT ends_with(l.loc, '.xml')"
cte("section_pages", f"SELECT site, page_id, {G.norm('url')} AS url, page_id % 4 AS part FROM good")
cte("heads", "SELECT site, part, arg_min(url, page_id) AS head FROM section_pages GROUP BY 1, 2")
cte("chained", "SELECT *, lag(url) OVER (PARTITION BY site, part ORDER BY page_id) AS before FROM section_pages")
cte("graph", """SELECT DISTINCT p.site, CASE WHEN part = 3 THEN coalesce(before, head) ELSE head END AS src, p.url AS dst FROM chained p JOIN heads h USING (site, part)
  UNION SELECT h.site, b.base_url, h.head FROM heads h JOIN home b USING (site)""")
WALK = """walk AS (SELECT site, base_url AS url, 0 AS depth FROM home
  UNION SELECT w.site, g.dst, w.depth + 1 FROM walk w JOIN graph g ON g.site = w.site AND g.src = w.url WHERE w.depth < 400)"""
CRAWLED = """SELECT site, url, depth, row_number() OVER (PARTITION BY site ORDER BY depth, url) AS rank FROM (
   SELECT site, url, min(depth) AS depth FROM walk GROUP BY site, url)"""
DISCOVERED = f"""counts AS (SELECT b.site, b.base_url, coalesce(n, 0) AS n FROM home b LEFT JOIN (SELECT site, count(*) AS n FROM ({MAP_PAGES}) GROUP BY site) USING (site))"""
cte("core_dim", "SELECT * FROM (VALUES " + ", ".join(f"({q(p)}, {i})" for i, p in enumerate(V.CORE_PATHS, 1)) + ") c(path, ord)")


def title_case(x):
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(substring(w, 2))), ' ')"


cte("usage", """SELECT o_custkey AS run_id, list_extract(['gpt-5-nano', 'gpt-5-mini', 'gpt-5-mini-2025-08-07', 'gpt-4o', 'other-model', NULL, '', 'gpt-5-2025', 'gpt-4o-mini'], CAST(o_orderkey % 9 + 1 AS INT)) AS model,
  o_orderkey % 5000 + 100 AS p, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 700 END AS c FROM orders""")
cte("dated_usage", """SELECT o_custkey AS run_id, list_extract(['gpt-5-nano', 'gpt-5-mini', 'gpt-5-mini-2025-08-07', 'gpt-4o', 'other-model', NULL, '', 'gpt-5-2025', 'gpt-4o-mini'], CAST(o_orderkey % 9 + 1 AS INT)) AS model,
  o_orderkey % 5000 + 100 AS p, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 700 END AS c, CAST(o_orderdate AS DATE) AS day FROM orders""")
cte("priced_days", "SELECT DISTINCT model, day FROM dated_usage")
cte("dated_prices", "SELECT name, i + y % 5 AS i, o + y % 3 AS o, y, make_date(y, 7, 1) AS valid_from FROM (SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS y FROM orders), (VALUES "
    + ", ".join(f"({q(m)}, CAST({i} AS DOUBLE), CAST({o} AS DOUBLE))" for m, (i, o) in [*V.PRICES.items(), ("gpt", (9, 9)), ("gpt-5-mini-2025", (0.3, 2.5)), ("other-model-x", (1, 1))]) + ") t(name, i, o) WHERE name <> 'gpt-4o' OR y % 2 = 0")
cte("prices", "SELECT * FROM (VALUES " + ", ".join(f"({q(m)}, CAST({i} AS DOUBLE), CAST({o} AS DOUBLE))" for m, (i, o) in V.PRICES.items()) + ") t(name, inp, outp)")
cte("priced_models", """SELECT m.model, coalesce(arg_max(inp, length(name)), CAST(0.05 AS DOUBLE)) AS inp, coalesce(arg_max(outp, length(name)), CAST(0.4 AS DOUBLE)) AS outp
  FROM (SELECT DISTINCT model FROM usage UNION SELECT 'gpt-5-nano') m LEFT JOIN prices ON starts_with(m.model, name) GROUP BY m.model""")
cte("model_sums", "SELECT run_id, coalesce(nullif(model, ''), 'gpt-5-nano') AS model, CAST(sum(p) AS BIGINT) AS p, CAST(coalesce(sum(c), 0) AS BIGINT) AS c FROM usage GROUP BY 1, 2")
cte("model_costs", "SELECT run_id, s.model, p, c, p / 1000000 * inp + c / 1000000 * outp AS cost FROM model_sums s JOIN priced_models m ON m.model = s.model")
cte("answers", f"""SELECT conv_id || '-' || turn AS request_id, 'https://site.example.org/' || conv_id AS page_url, 'Title ' || role AS page_title, (conv_id * 3 + turn) % 7 AS form,
   'https://x.example.org/' || conv_id AS url, role, list_extract(['contact', 'faq', 'policies', 'additional'], CAST((conv_id * 3 + turn) % 4 + 1 AS INT)) AS category,
   regexp_replace(regexp_replace(text, '["' || chr(92) || chr(92) || ']', '', 'g'), '\\s+', ' ', 'g') AS chunk FROM conversations""")
cte("kinds", f"""SELECT conv_id || '-' || turn AS request_id, role, text, conv_id * 8 + turn AS key, (conv_id * 8 + turn) % 4 AS form, list_extract(['prospect', 'colors', 'audit', 'categories', 'clusters', 'introduction'],
   CAST((conv_id * 8 + turn) % 6 + 1 AS INT)) AS kind, regexp_replace(regexp_replace(coalesce(text, ''), '["' || chr(92) || chr(92) || ']', '', 'g'), '\\s+', ' ', 'g') AS said FROM conversations""")
LINK = "'https://x.example.org/' || (key + {})"
ITEMS = [
    ("categories", "form < 2", [("company_info_pages", [LINK.format(1), LINK.format(2)]), ("other_pages", [LINK.format(3)])]),
    ("categories", "form = 3", [("product_pages", ["'a'", "'b'"])]),
    ("clusters", "form < 2", [("educational_content", [LINK.format(1), LINK.format(2), LINK.format(3)]), ("company_information", [LINK.format(4)]),
                              ("priority_extraction_order", ["'company_information'", "'educational_content'"])]),
    ("clusters", "form = 3", [("buying_guides", ["'b'"])]),
    ("audit", "form < 2", [("missing", ["'policies'", "role"])]),
]
cte("first_good", f"SELECT site, {G.norm('url')} AS url, min(page_id) AS page_id FROM good GROUP BY 1, 2")
FLAT = f"{G.strip(G.rep('t', G.WS + '+', ' '))}"
DESCRIBE = f"""descr AS (SELECT c.site, c.rank, c.url, {G.strip("array_to_string(regexp_extract_all(" + FLAT + ", '[^.!?؟]+[.!?؟]*')[1:2], '')")} AS description
  FROM ({CRAWLED}) c JOIN first_good f ON f.site = c.site AND f.url = c.url JOIN (SELECT page_id, {G.lines(G.body(G.no_scripts('html', '<br>')))} AS t FROM good) USING (page_id) WHERE c.rank <= 10)"""
cte("asked_urls", "SELECT page_id % 3 AS request_id, trim(url) AS url FROM crawl_raw UNION SELECT (page_id + 1) % 3, trim(url) FROM crawl_raw WHERE page_id % 5 = 0")
cte("prospect_texts", f"""SELECT a.request_id, a.url, t.text FROM asked_urls a LEFT JOIN (SELECT url, min(page_id) AS page_id FROM good GROUP BY url) g USING (url)
  LEFT JOIN (SELECT page_id, {G.lines(G.body(G.no_scripts('html', '<br>')))} AS text FROM good) t USING (page_id)""")
TERMS = "list_sort(list_distinct(regexp_extract_all(lower({}), '\\p{{L}}{{4,}}')))"
cte("profile", f"SELECT item_id % 3 AS request_id, item_id, {TERMS.format('text')} AS terms FROM benchmark")
cte("known_pages", f"SELECT request_id, url, {TERMS.format('text')} AS terms FROM prospect_texts WHERE coalesce(text, '') <> ''")
cte("scored", """SELECT request_id, url, item_id, page, persona, (200 * h + n) // (2 * n) AS conf FROM (
   SELECT k.request_id, k.url, p.item_id, k.terms AS page, p.terms AS persona, length(list_intersect(k.terms, p.terms)) AS h, length(p.terms) AS n
   FROM known_pages k JOIN profile p ON p.request_id = k.request_id)""")
cte("best_persona", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, url ORDER BY conf DESC, item_id) AS r FROM scored) WHERE r = 1")
cte("analysis", """SELECT request_id, url, item_id AS persona_id, conf >= 50 AS is_potential_customer, conf AS confidence_score,
   array_to_string(list_filter(persona, lambda w: list_contains(page, w)), ', ') AS reasoning_for,
   array_to_string(list_filter(persona, lambda w: NOT list_contains(page, w)), ', ') AS reasoning_against FROM best_persona""")
cte("prospect_states", f"""SELECT request_id, url, CASE WHEN coalesce(text, '') = '' THEN 'failed' ELSE 'completed' END AS status,
   CASE WHEN coalesce(text, '') = '' THEN {q(V.EMPTY_PAGE_ERROR)} END AS error, {G.toks('text')} AS prompt_tokens FROM prospect_texts""")
STATUS = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'completed' END"
MESSAGES = ["Detecting language...", "Extracting from page 3/20: https://x.example.org/a:b", "Extracting knowledge 4/9 pages...",
            "Writing section: FAQ...", "Warming up", "Knowledge base generation completed successfully."]
LOCAL = [V.PROGRESS_FA["Detecting language..."], V.PAGE_PROGRESS_FA + "3/20: https://x.example.org/a:b", V.PROGRESS_FA["Extracting knowledge"],
         V.PROGRESS_FA["Writing section"], "Warming up", V.PROGRESS_FA["Knowledge base generation completed successfully."]]
cte("job_events", f"""SELECT user_id AS job_id, event_id, ts, CASE WHEN user_id % 3 = 0 THEN 'prospects' ELSE 'knowledge_base' END AS job_type, {STATUS} AS status,
   list_extract({arr(MESSAGES)}, CAST(event_id % 6 + 1 AS INT)) AS progress, list_extract({arr(LOCAL)}, CAST(event_id % 6 + 1 AS INT)) AS progress_fa,
   event_id % 40 + 1 AS done, CASE WHEN event_type IN ('purchase', 'signup') THEN '# Knowledge Base' || chr(10) || chr(10) || repeat(props || ' ', event_id % 90) END AS document,
   row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events""")
TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
cte("last_docs", "SELECT job_id, document FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS r FROM job_events WHERE document IS NOT NULL) WHERE r = 1")
cte("run_rows", f"""SELECT j.job_id, CASE WHEN e.status IN ('completed', 'failed') THEN e.status ELSE 'timeout' END AS status, s, f, n, tok, cnt, d.document,
   (epoch_us(f) - epoch_us(s)) / 1000000 AS secs FROM (SELECT job_id, min(ts) AS s, max(ts) AS f, max(done) AS n, sum(done) AS tok, count(*) AS cnt FROM job_events GROUP BY job_id) j
   JOIN job_events e ON e.job_id = j.job_id AND e.back = 1 LEFT JOIN last_docs d ON d.job_id = j.job_id""")
HEX = "lower(printf('%02x', CAST(job_id % 256 AS INT)))"
FLAT_RUN = f"""SELECT 'https://site' || job_id || '.example.org/' AS url, status, CAST(job_id AS VARCHAR) AS job_id, {TS.format('s')} AS start_time, {TS.format('f')} AS end_time,
  CAST(secs AS DOUBLE) AS duration_seconds, CAST(n AS {{n}}) AS pages_processed, '#' || {HEX} || {HEX} || {HEX} AS main_background_color, '#000000' AS primary_brand_color, 'from run' AS background_color_description,
  '' AS brand_color_description, CASE WHEN status = 'timeout' THEN '' ELSE printf('%d.%06d', CAST(tok // 1000000 AS BIGINT), CAST(tok % 1000000 AS BIGINT)) END AS total_cost_usd,
  CASE WHEN status = 'timeout' THEN '' ELSE CAST(tok AS VARCHAR) END AS prompt_tokens, CASE WHEN status = 'timeout' THEN '' ELSE CAST(cnt AS VARCHAR) END AS completion_tokens,
  CASE WHEN status = 'failed' THEN 'job failed' ELSE '' END AS error, CAST(length(coalesce(document, '')) AS {{n}}) AS knowledge_base_length FROM run_rows"""

# --- elements -------------------------------------------------------------------------------
def pick(options, k=1):
    return f"list_extract({arr(options)}, CAST((page_id // {k}) % {len(options)} + 1 AS INT))"


cte("element_pages", f"""SELECT page_id, {G.netloc('url')} AS site, html || '<button id="' || {pick(["follow", "id_12", "auto9x", "menu", "content", "btn-number-12345"])}
  || '" class="x btn-main" aria-label="' || {pick(["Follow user", "Like post", "Share 5", "Open"], 2)} || '">' || {pick(["Follow", "Save", "Reply 7", "Don't like", "Go"], 3)} || '</button>'
  || '<div role="' || {pick(["button", "menu", "note"])} || '" data-testid="' || {pick(["tweetText", "likeBtn", "share-box", "follow-x", "box"])} || '">text' || page_id || '</div>'
  || '<input type="' || {pick(["submit", "button", "search", "text"])} || '" name="q" placeholder="Search ' || {pick(["here", "2024"])} || '">'
  || '<img alt="' || {pick(["Profile picture of A", "logo", "a@b"])} || '" src="/i.png">'
  || '<a href="' || {pick(["/user/", "/x/followers", "/x/following", "/@me", "/plain"])} || '">' || {pick(["followers", "Home", "About us"])} || '</a>'
  || '<input type=submit name=q2><my-widget role="button" aria-label="a > b">w</my-widget>'
  || '<textarea class="post-box wide"></textarea><form class="plain"></form><h2 title="More">View more</h2>' AS html FROM pages""")
TAG = r"""<[/!?A-Za-z][^>=]*(?:=\s*(?:"[^"]*"|'[^']*')?[^>=]*)*>"""
cte("tags_found", f"""SELECT page_id, site, pl, regexp_extract(raw, {q('^' + TAG)}) AS tag, {G.unescape(f"regexp_replace(raw, {q('^' + TAG)}, '')")} AS txt FROM (
   SELECT page_id, site, unnest(f) AS raw, generate_subscripts(f, 1) AS pl FROM (
    SELECT page_id, site, regexp_extract_all({G.no_scripts('html')}, {q(TAG + '(?:[^<]|<[^/!?A-Za-z<])*')}) AS f FROM element_pages))""")
EMPTY = "name IN (" + ", ".join(map(q, V.EMPTY_TAGS)) + ") OR ends_with(tag, '/>')"
cte("tag_lists", f"""SELECT page_id, list(CASE WHEN starts_with(tag, '</') THEN '/' || name WHEN {EMPTY} THEN '' ELSE name END ORDER BY pl) AS signs,
   list(txt ORDER BY pl) AS texts, list({G.strip('txt')} ORDER BY pl) AS stripped
  FROM (SELECT *, lower(regexp_extract(tag, '^</?([a-zA-Z][a-zA-Z0-9-]*)', 1)) AS name FROM tags_found) GROUP BY page_id""")
LAST = "len(stack) - list_position(list_reverse(list_transform(stack, lambda x: x.n)), sign[2:]) + 1"
cte("tag_walk", f"""SELECT page_id, 0 AS pl, CAST([] AS STRUCT(n VARCHAR, p BIGINT)[]) AS stack, CAST([] AS BIGINT[]) AS shut FROM tag_lists
  UNION ALL SELECT page_id, pl, CASE WHEN last > 0 THEN stack[1 : last - 1] WHEN sign = '' OR sign[1] = '/' THEN stack ELSE list_append(stack, {{'n': sign, 'p': CAST(pl AS BIGINT)}}) END,
    CASE WHEN last > 0 THEN list_transform(stack[last : len(stack)], lambda x: x.p) ELSE [] END
   FROM (SELECT *, CASE WHEN sign[1] = '/' AND list_contains(list_transform(stack, lambda x: x.n), sign[2:]) THEN {LAST} ELSE 0 END AS last
    FROM (SELECT w.page_id, w.pl + 1 AS pl, w.stack, t.signs[w.pl + 1] AS sign FROM tag_walk w JOIN tag_lists t USING (page_id) WHERE w.pl < len(t.signs)))""")
cte("tag_ends", "SELECT page_id, unnest(shut) AS pl, pl AS until FROM tag_walk")


def attribute(name):
    return f"""regexp_extract(open, '(?is)\\s{name}\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''=<>`]+)', 1)"""


NAMES = ["id", "class", "href", "role", "type", "aria-label", "data-testid", "name", "placeholder", "alt", "title"]
ident = lambda n: "a_" + n.replace("-", "_")
cte("elements", f"""SELECT page_id, site, no, tag, open, texts, stripped, pl, until, array_to_string(stripped[pl : until - 1], '') AS text, array_to_string(texts[pl : until - 1], '') AS whole,
   {attribute('href')} <> '' AS has_href, {", ".join(f"{G.unescape(G.rep(attribute(n), '^[' + chr(34) + chr(39) + ']|[' + chr(34) + chr(39) + ']$'))} AS {ident(n)}" for n in NAMES)}
  FROM (SELECT f.page_id, f.site, f.pl, f.tag AS open, row_number() OVER (PARTITION BY f.page_id ORDER BY f.pl) AS no, lower(regexp_extract(f.tag, '^<([a-zA-Z][a-zA-Z0-9-]*)', 1)) AS tag,
    t.texts, t.stripped, CASE WHEN t.signs[f.pl] = '' THEN f.pl ELSE coalesce(e.until, len(t.signs) + 1) END AS until
   FROM tags_found f JOIN tag_lists t USING (page_id) LEFT JOIN tag_ends e ON e.page_id = f.page_id AND e.pl = f.pl WHERE regexp_matches(f.tag, '^<[a-zA-Z]'))""")


def rule(tag, name, test, value):
    parts = [f"tag = {q(tag)}"] if tag else []
    a = ident(name) if name else None
    parts += {None: [], "present": ["has_href"], "equals": [f"{a} = {q(value or '')}"], "contains": [f"contains({a}, {q(value or '')})"],
              "icontains": [f"contains(lower({a}), {q(value or '')})"], "text": [f"contains(whole, {q(value or '')})"]}[test]
    return " AND ".join(parts)


cte("inventory", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, sel_no ORDER BY no) AS r FROM (" + " UNION ALL ".join(
    f"SELECT *, {q(c)} AS category, {q(s)} AS selector, {i} AS sel_no FROM elements WHERE {rule(*r)}" for i, (c, s, *r) in enumerate(V.SELECTORS)
) + "))")
NUM = lambda x: f"length(regexp_replace({x}, '\\P{{Nd}}', '', 'g'))"
TEXT_OK = f"""length(text) > 1 AND length(text) < 30 AND {NUM('text')} = 0 AND NOT contains(text, '@') AND NOT {has('lower(text)', V.PERSONAL_TEXT_WORDS)} AND {has('lower(text)', V.ACTION_WORDS)}"""
ESC = "replace(text, '''', chr(92) || '''')"


def by_attr(n):
    a = ident(n)
    ok = f"{a} <> '' AND length({a}) < 50" + (f" AND {a} IN (" + ", ".join(map(q, V.ATTRIBUTE_VALUES[n])) + ")" if V.ATTRIBUTE_VALUES[n] else "")
    plain = f"CASE WHEN {NUM(a)} = 0 AND NOT contains({a}, '@') THEN '//' || tag || '[@{n}=''' || {a} || ''']' END"
    if n == "alt":
        plain = f"CASE WHEN contains(lower({a}), 'profile picture') THEN '//' || tag || '[contains(@alt, ''profile picture'')]' ELSE {plain} END"
    return f"CASE WHEN {ok} THEN {plain} END"


LOCATORS = [
    f"""CASE WHEN a_id <> '' AND NOT ((length(a_id) > 10 AND {NUM('a_id')} > 0) OR contains(a_id, '__') OR starts_with(a_id, 'id_') OR {NUM('a_id')} > 3 OR {has('lower(a_id)', V.DYNAMIC_ID_WORDS)})
      AND (a_id IN ({", ".join(map(q, V.STABLE_IDS))}) OR (length(a_id) < 8 AND {NUM('a_id')} = 0)) AND NOT {has('lower(a_id)', V.PERSONAL_ID_WORDS)} THEN '//' || tag || '[@id=''' || a_id || ''']' END""",
    f"CASE WHEN {TEXT_OK} THEN '//' || tag || '[contains(text(), ''' || {ESC} || ''')]' END",
    f"CASE WHEN {TEXT_OK} THEN '//' || tag || '[text()=''' || {ESC} || ''']' END",
    *[by_attr(n) for n in V.ATTRIBUTE_VALUES],
    f"CASE WHEN a_href <> '' AND NOT {has('lower(a_href)', V.PERSONAL_HREFS)} THEN '//' || tag || '[@href=''' || a_href || ''']' END",
]
cte("located", f"SELECT page_id, site, category, selector, sel_no, no, tag, a_class, list_filter([{', '.join(LOCATORS)}], lambda x: x IS NOT NULL) AS l FROM inventory")
cte("located2", f"""SELECT page_id, site, category, selector, sel_no, no, CASE WHEN length(l) > 0 THEN l ELSE list_transform(
   list_filter(regexp_split_to_array(a_class, '\\s+'), lambda c: {has('lower(c)', V.CLASS_WORDS)} AND length(c) < 25)[1:1], lambda c: '//' || tag || '[contains(@class, ''' || c || ''')]') END AS l FROM located""")
cte("xpaths", """SELECT page_id, site, category, selector, sel_no, no, x AS xpath, row_number() OVER (PARTITION BY page_id, sel_no, no ORDER BY i) AS xpath_no FROM (
   SELECT page_id, site, category, selector, sel_no, no, x, min(i) AS i FROM (SELECT *, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM located2) GROUP BY ALL)""")
REPORT = """SELECT d.site, md5(d.site) AS job_id, b.base_url, d.lang, coalesce(n, 0) AS pages, printf('%.6f', d.final_doc_tokens / 1000000 * CAST(0.05 AS DOUBLE)) AS cost, d.document, a.*
 FROM kb_docs d JOIN home b USING (site) JOIN audit a USING (site) LEFT JOIN (SELECT site, count(*) AS n FROM kb_chunks GROUP BY site) USING (site)"""
cte("audit", A.AUDIT)
NAME = "replace(replace(" + G.netloc("base_url") + ", 'www.', ''), '.', '_') || '_20240101_000000_' || substring(job_id, 1, 8)"
FLAGS = "concat_ws(', ', " + ", ".join(f"CASE WHEN {f} THEN '{f}' END" for f in ("has_contact", "has_email", "has_phone", "has_policies", "has_faq", "has_services")) + ")"

# the full chain over other candidates and other ways to pick pages
cte("disc", f"""WITH RECURSIVE {REACHED}, {WALK}, {DISCOVERED} SELECT site, 0 AS source, base_url AS url FROM home
  UNION ALL SELECT site, 1, url FROM ({MAP_PAGES}) UNION ALL SELECT site, 2, url FROM ({CRAWLED}) JOIN counts USING (site) WHERE rank <= 30 AND n < 5""")
G.variant("d_", {"kb_urls": f"""SELECT a.site, min(a.pos + d.source * 1000000000000) AS pos, a.norm
  FROM (SELECT site, min(page_id) AS pos, {G.norm('url')} AS norm FROM good GROUP BY ALL) a JOIN (SELECT site, source, {G.norm('url')} AS norm FROM disc) d USING (site, norm) GROUP BY a.site, a.norm"""})
ORDERED = "SELECT site, row_number() OVER (PARTITION BY site ORDER BY ord, url) AS rank, url, 'company_information' AS cluster FROM ({}) WHERE (site, url) IN (SELECT site, norm FROM kb_urls)"
G.variant("c_", {"kb_picked": ORDERED.format(f"""SELECT site, {G.norm('url')} AS url, min(ord) AS ord FROM (SELECT site, 0 AS ord, base_url AS url FROM home
  UNION ALL SELECT c.site, d.ord, c.url FROM good c JOIN home b USING (site) JOIN core_dim d ON c.url = {G.scheme('b.base_url')} || '://' || c.site || d.path) GROUP BY 1, 2""")})
cte("asked_all", "SELECT site, min(page_id) AS ord, url FROM crawl_raw GROUP BY site, url")
G.variant("s_", {"kb_picked": ORDERED.format(f"""SELECT site, {G.norm('url')} AS url, min(ord) AS ord FROM (
  SELECT site, ord, url FROM asked_all a WHERE EXISTS (SELECT 1 FROM good g WHERE g.site = a.site AND g.url = a.url)
  UNION ALL SELECT site, 0, base_url FROM home b WHERE NOT EXISTS (SELECT 1 FROM asked_all a JOIN good g ON g.site = a.site AND g.url = a.url WHERE a.site = b.site AND a.url = b.base_url)) GROUP BY 1, 2""")})

ORACLES = {
    "knowledge_base_discovered": build("SELECT * FROM d_kb_docs"),
    "knowledge_base_core": build("SELECT * FROM c_kb_docs"),
    "knowledge_base_specified": build("SELECT * FROM s_kb_docs"),
    "document_parts": build(f"SELECT site, part, substring(document, part * {V.PART_CHARS} + 1, {V.PART_CHARS}) AS text FROM (SELECT site, document, unnest(range((length(document) + {V.PART_CHARS} - 1) // {V.PART_CHARS})) AS part FROM s_kb_docs)"),
    "scan_robots_sitemaps": build("SELECT * FROM sitemap_starts"),
    "sitemap_locs": build("SELECT site, sitemap_url, loc FROM locs"),
    "sitemap_expand": build(f"WITH RECURSIVE {REACHED} {MAP_PAGES}"),
    "crawl_reach": build(f"WITH RECURSIVE {WALK} SELECT site, rank, url, depth FROM ({CRAWLED}) WHERE rank <= 10"),
    "discover_candidates": build(f"""WITH RECURSIVE {REACHED}, {WALK}, {DISCOVERED} SELECT site, 0 AS source, 0 AS ord, base_url AS url FROM home
       UNION ALL SELECT site, 1, 0, url FROM ({MAP_PAGES})
       UNION ALL SELECT site, 2, rank, url FROM ({CRAWLED}) JOIN counts USING (site) WHERE rank <= 30 AND n < 5"""),
    "discovery_meta": build(f"""WITH RECURSIVE {REACHED}, {WALK}, {DISCOVERED} SELECT site, n AS sitemap_urls, crawled_urls,
      CASE WHEN n < 5 THEN 'crawl' ELSE 'sitemap' END AS method, false AS capped FROM (
       SELECT c.site, c.n, CASE WHEN c.n < 5 THEN coalesce(w.n, 0) ELSE 0 END AS crawled_urls FROM counts c
       LEFT JOIN (SELECT site, count(*) AS n FROM ({CRAWLED}) WHERE rank <= 30 GROUP BY site) w USING (site))"""),
    "core_pages": build(f"""SELECT site, 0 AS ord, base_url AS url, 'Main Page' AS title, 'main_page' AS type FROM home_all
      UNION ALL SELECT DISTINCT c.site, d.ord, c.url, {title_case("replace(trim(d.path, '/'), '-', ' ')")}, 'auto_discovered_core_page'
       FROM crawl_raw c JOIN home_all b USING (site) JOIN core_dim d ON c.url = {G.scheme('b.base_url')} || '://' || c.site || d.path WHERE c.status < 400"""),
    "specified_pages": build("""SELECT site, min(page_id) AS ord, url, 'N/A' AS title, 'specified_core_page' AS type FROM crawl_raw c
       WHERE EXISTS (SELECT 1 FROM crawl_raw k WHERE k.site = c.site AND k.url = c.url AND k.status < 400) GROUP BY site, url
      UNION ALL SELECT site, 0, base_url, 'Main Page', 'main_page' FROM home_all b WHERE NOT EXISTS (SELECT 1 FROM crawl_raw k WHERE k.site = b.site AND k.url = b.base_url AND k.status < 400)"""),
    "model_requests": build("WITH RECURSIVE " + A.PACK.format(b=14000) + f"""
      SELECT site, kind, ref, text, tier, {G.toks('text')} AS tokens, mx AS max_output_tokens, {G.toks('text')} / 1000000 * CAST(0.05 AS DOUBLE) + mx / 1000000 * CAST(0.4 AS DOUBLE) AS max_cost_usd FROM (
       SELECT site, 'page_extraction' AS kind, url AS ref, chunk AS text, 'cheap' AS tier, 4000 AS mx FROM kb_chunks
       UNION ALL SELECT site, 'section_synthesis', section || '#' || batch, string_agg(chunk, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos), 'strong', 8000
        FROM kb_chunks JOIN packed USING (site, section, pos) GROUP BY site, section, batch)"""),
    "model_responses": build("""SELECT request_id, CASE WHEN form IN (0, 1, 2) THEN url ELSE page_url END AS url, CASE WHEN form IN (0, 1, 2) THEN role ELSE page_title END AS title_suggestion,
      CASE WHEN form IN (0, 1, 2) THEN category WHEN form = 4 THEN 'faq' ELSE 'additional' END AS primary_category, CASE WHEN form IN (0, 1, 2) THEN chunk ELSE '' END AS extracted_chunk FROM answers"""),
    "model_answers_prospect": build("""SELECT request_id, form <> 2 AS readable, form < 2 AND key % 2 = 0 AS is_potential_customer, CASE WHEN form < 2 THEN CAST(key % 101 AS INTEGER) ELSE 0 END AS confidence_score,
      CASE WHEN form < 2 THEN said ELSE '' END AS reasoning_for, CASE WHEN form < 2 THEN role WHEN form = 3 THEN 'r' ELSE '' END AS reasoning_against FROM kinds WHERE kind = 'prospect'"""),
    "model_answers_colors": build(f"""SELECT request_id, form < 2 AS readable, CASE WHEN form < 2 THEN '#' || lpad(CAST(key % 1000000 AS VARCHAR), 6, '0') ELSE '#ffffff' END AS main_background_color,
      CASE WHEN form < 2 THEN '#123456' ELSE '#000000' END AS primary_brand_color, CASE WHEN form < 2 THEN said ELSE {q(V.BACKGROUND_FALLBACK)} END AS background_color_description,
      {q(V.BRAND_FALLBACK)} AS brand_color_description FROM kinds WHERE kind = 'colors'"""),
    "model_answers_audit": build("""SELECT request_id, form <> 2 AS readable, form < 2 AND key % 3 = 0 AS has_contact, false AS has_policies, form <> 2 AS has_faq, false AS has_services,
      CASE WHEN form < 2 THEN said ELSE '' END AS notes FROM kinds WHERE kind = 'audit'"""),
    "model_answer_items": build(" UNION ALL ".join(
        f"SELECT request_id, '{kind}' AS kind, '{name}' AS list, CAST({n} AS BIGINT) AS item_no, {item} AS item FROM kinds WHERE kind = '{kind}' AND {form}"
        for kind, form, lists in ITEMS for name, items in lists for n, item in enumerate(items, 1))),
    "model_answer_texts": build(f"SELECT request_id, kind, {G.strip("coalesce(text, '')")} AS text FROM kinds WHERE kind = 'introduction'"),
    "model_apply": "SELECT doc_id, length(text) AS score FROM documents",
    "model_price": build("SELECT u.model, count(*) AS n, any_value(inp) AS input, any_value(outp) AS output FROM usage u JOIN priced_models p ON u.model IS NOT DISTINCT FROM p.model GROUP BY u.model"),
    "model_price_table": build("""SELECT c.model, CAST(CAST(day AS DATE) AS VARCHAR) AS called_at, coalesce(arg_max(p.i, rank), CAST(0.05 AS DOUBLE)) AS input, coalesce(arg_max(p.o, rank), CAST(0.4 AS DOUBLE)) AS output
      FROM priced_days c LEFT JOIN (SELECT *, length(name) * 10000 + y AS rank FROM dated_prices) p ON starts_with(c.model, p.name) AND p.valid_from <= c.day GROUP BY c.model, c.day"""),
    "cost_at_prices": build("""SELECT run_id, model, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, CAST(sum(p * CAST(round(inp * 1000000) AS HUGEINT) + c * CAST(round(outp * 1000000) AS HUGEINT)) AS DOUBLE) / CAST(1e12 AS DOUBLE) AS cost_usd FROM (
      SELECT s.run_id, s.model, s.day, any_value(s.p) AS p, any_value(s.c) AS c, coalesce(arg_max(d.i, rank), CAST(0.05 AS DOUBLE)) AS inp, coalesce(arg_max(d.o, rank), CAST(0.4 AS DOUBLE)) AS outp
      FROM (SELECT run_id, coalesce(nullif(model, ''), 'gpt-5-nano') AS model, day, CAST(sum(p) AS BIGINT) AS p, CAST(coalesce(sum(c), 0) AS BIGINT) AS c FROM dated_usage GROUP BY ALL) s
      LEFT JOIN (SELECT *, length(name) * 10000 + y AS rank FROM dated_prices) d ON starts_with(s.model, d.name) AND d.valid_from <= s.day GROUP BY s.run_id, s.model, s.day) GROUP BY run_id, model"""),
    "cost_by_model": build("SELECT run_id, model, p AS prompt_tokens, c AS completion_tokens, CAST(printf('%.6f', cost) AS DOUBLE) AS cost_usd FROM model_costs"),
    "cost_estimate": build("SELECT run_id, printf('%.6f', list_reduce(list(cost ORDER BY model), lambda a, b: a + b, CAST(0 AS DOUBLE))) AS total_cost_usd, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens FROM model_costs GROUP BY run_id"),
    "cost_flat": build("SELECT run_id, p AS prompt_tokens, c AS completion_tokens, printf('%.6f', p / 1000000 * CAST(0.05 AS DOUBLE) + c / 1000000 * CAST(0.4 AS DOUBLE)) AS total_cost_usd FROM (SELECT run_id, CAST(sum(p) AS BIGINT) AS p, CAST(coalesce(sum(c), 0) AS BIGINT) AS c FROM usage GROUP BY run_id)"),
    "company_pages": build(f"WITH RECURSIVE {WALK}, {DESCRIBE} SELECT site, rank, url, description FROM descr WHERE description <> ''"),
    "company_summary": build(f"""WITH RECURSIVE {WALK}, {DESCRIBE} SELECT d.site, count(*) AS analyzed_pages, 'Based on analyses of pages from ' || any_value(base_url) || ':' || {NL} || {NL}
      || string_agg('- URL: ' || url || {NL} || '  Summary: ' || description, {NL} ORDER BY rank) AS summary FROM descr d JOIN home USING (site) WHERE description <> '' GROUP BY d.site"""),
    "scan_prospect_list": build("SELECT request_id, url FROM asked_urls"),
    "prospect_score": build("SELECT * FROM analysis"),
    "prospect_status": build("SELECT request_id, url, status, error, prompt_tokens FROM prospect_states"),
    "jobs_list": build(f"""SELECT j.job_id, e.job_type, e.status, {TS.format('c')} AS created_at, CASE WHEN e.status IN ('completed', 'failed') THEN {TS.format('l')} END AS finished_at
      FROM (SELECT job_id, min(ts) AS c, max(ts) AS l FROM job_events GROUP BY job_id) j JOIN job_events e ON e.job_id = j.job_id AND e.back = 1"""),
    "job_latest": build("""SELECT e.job_id, status, progress, progress_fa, substring(d.document, 1, 500) || '...' AS preview, CASE WHEN status = 'completed' THEN d.document END AS document
      FROM job_events e LEFT JOIN last_docs d ON d.job_id = e.job_id WHERE back = 1"""),
    "progress_localise": build("SELECT event_id, progress_fa FROM job_events"),
    "run_flatten": build(FLAT_RUN.format(n="BIGINT")),
    "run_summary": build("""SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'timeout') AS timed_out,
      CAST(sum(epoch_us(f) - epoch_us(s)) AS BIGINT) / 1000000 AS total_duration_seconds FROM run_rows"""),
    "run_totals": build("""SELECT day, status, count(*) AS runs, CAST(sum(n) AS BIGINT) AS pages, CAST(sum(epoch_us(f) - epoch_us(s)) AS BIGINT) / 1000000 AS seconds, CAST(grouping(day, status) AS INTEGER) AS level
      FROM (SELECT *, CAST(CAST(s AS DATE) AS VARCHAR) AS day FROM run_rows) GROUP BY ROLLUP (day, status)"""),
    "element_inventory": build("WITH RECURSIVE one AS (SELECT 1) SELECT page_id, category, selector, no AS element_no, tag, text FROM inventory"),
    "element_xpaths": build("WITH RECURSIVE one AS (SELECT 1) SELECT page_id, category, selector, no AS element_no, xpath_no, xpath FROM xpaths"),
    "page_xpaths": build("""WITH RECURSIVE one AS (SELECT 1) SELECT page_id, category, xpath, sel_no AS selector_no, no AS element_no FROM (
      SELECT *, row_number() OVER (PARTITION BY page_id, category, xpath ORDER BY sel_no, no, xpath_no) AS first FROM xpaths) WHERE first = 1"""),
    "selector_coverage": build("""WITH RECURSIVE one AS (SELECT 1) SELECT site, category, xpath, n_pages, site_pages, n_pages / site_pages AS share FROM (SELECT site, category, xpath, count(DISTINCT page_id) AS n_pages FROM xpaths GROUP BY 1, 2, 3)
      JOIN (SELECT site, count(*) AS site_pages FROM element_pages GROUP BY site) USING (site)"""),
    "sink_kb_markdown": build(f"""SELECT site, 'knowledge_base_' || {NAME} || '.md' AS name, concat_ws({NL}, '# Knowledge Base Report' || {NL}, '**Generated:** 2024-01-01 00:00:00', '**Job ID:** ' || job_id,
      '**Source URL:** ' || base_url, '**Language:** ' || lang, '**Pages Processed:** ' || pages, '**Screenshot Captured:** False', '**Total Cost:** $' || cost, '**Depth:** deep',
      '**Models:** cheap=gpt-5-nano / strong=gpt-5-nano', '**Completeness:** present=' || coalesce(nullif({FLAGS}, ''), 'none') || CASE WHEN missing <> '' THEN '; missing=' || replace(missing, ',', ', ') ELSE '' END)
      || {NL} || {NL} || '---' || {NL} || {NL} || document AS content FROM ({REPORT.replace('a.*', 'a.* EXCLUDE (site)')})"""),
    "sink_kb_metadata": build(f"""SELECT site, 'metadata_' || {NAME} || '.json' AS name, job_id, base_url AS url, 'knowledge_base_' || {NAME} || '.md' AS knowledge_base_file, pages AS extracted_pages_count,
      lang AS detected_target_language, cost AS total_cost_usd, analysis_summary, has_email, doc_tokens, missing
      FROM ({REPORT.replace('a.*', 'a.* EXCLUDE (site)')}) JOIN (SELECT site, analysis_summary FROM ({A.SUMMARY})) USING (site)"""),
    "sink_prospect_csv": build("""SELECT request_id, url AS website, status, coalesce(CAST(is_potential_customer AS VARCHAR), '') AS is_potential_customer, coalesce(CAST(confidence_score AS VARCHAR), '') AS confidence_score,
      coalesce(reasoning_for, '') AS reasoning_for, coalesce(reasoning_against, '') AS reasoning_against, coalesce(error, '') AS error FROM prospect_states LEFT JOIN analysis USING (request_id, url)"""),
    "sink_run_csv": build(FLAT_RUN.format(n="VARCHAR")),
}
cte("stream_pages", f"""SELECT page_id, url, html, {X.title('html')} AS title FROM (
  SELECT *, row_number() OVER (PARTITION BY {G.norm('url')}, html ORDER BY page_id) AS copy FROM pages) WHERE copy = 1""")
cte("stream_chunks", X.main_content("stream_pages", "page_id, url, title"))
cte("stream_contacts", X.contacts("stream_chunks", "page_id", "chunk"))
ORACLES["page_stream"] = build(f"""
 SELECT f.page_id, {G.netloc('f.url')} AS site, {G.norm('f.url')} AS url, f.title, f.chunk, coalesce(e.v, '') AS emails, coalesce(p.v, '') AS phones
 FROM stream_chunks f LEFT JOIN (SELECT site AS page_id, string_agg(value, ', ' ORDER BY value) AS v FROM stream_contacts WHERE kind = 'email' GROUP BY site) e USING (page_id)
 LEFT JOIN (SELECT site AS page_id, string_agg(value, ', ' ORDER BY value) AS v FROM stream_contacts WHERE kind = 'phone' GROUP BY site) p USING (page_id)""")
ORACLES["job_progress_stream"] = build("""SELECT e.job_id, status, progress_fa, d || '/40' AS counter FROM job_events e JOIN (SELECT job_id, max(done) AS d FROM job_events GROUP BY job_id) USING (job_id) WHERE back = 1""")
