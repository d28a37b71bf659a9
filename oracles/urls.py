"""Checking SQL for links, URL rules, clusters and selection."""

from sitelore.functions import vocab as V
from oracles import sqlgen as G
from oracles.sqlgen import build, cte, has, q

HOME = "'https://' || site"
cte("crawl_raw", f"""
 SELECT page_id, {G.netloc('url')} AS site,
  CASE WHEN page_id % 3 = 0 THEN {G.scheme('url')} || '://' || {G.netloc('url')}
       || list_extract({G.arr(V.CORE_PATHS)}, CAST((page_id // 3) % 33 + 1 AS INT)) ELSE url END AS url,
  CASE WHEN page_id % 17 = 5 THEN 404 ELSE 200 END AS status,
  CASE WHEN page_id % 19 = 7 THEN 'application/json' ELSE 'text/html; charset=utf-8' END AS content_type,
  html FROM pages""")
cte("good", "SELECT * FROM crawl_raw WHERE status < 400 AND content_type LIKE 'text/html%'")
cte("home", f"""
 SELECT site, arg_min({G.norm('url')}, (CASE WHEN {G.path('url')} IN ('', '/') THEN 0 ELSE 1 END) * 1000000000000 + page_id) AS base_url
 FROM good GROUP BY site""")
cte("bases", "SELECT * FROM home UNION ALL SELECT DISTINCT 'shop.example.com', 'https://shop.example.com/' FROM part")

LINK = r"""(?is)<a\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def resolve(base, href):
    """RFC 3986 steps on the (unescaped) href; dot segments by a fold."""
    sch, host, p = G.scheme(href), G.netloc(href), G.rawpath(href)
    tail = f"substring({href}, length(regexp_extract({href}, '(?s)^[^?#]*', 0)) + 1)"
    origin = f"({G.scheme(base)} || '://' || {G.netloc(base)})"
    bq = f"(CASE WHEN contains(split_part({base}, '#', 1), '?') THEN '?' || {G.query(base)} ELSE '' END)"
    folder = f"regexp_replace({G.rawpath(base)}, '[^/]*$', '')"
    joined = (
        f"(CASE WHEN starts_with({p}, '/') THEN {p} ELSE "
        f"{G.rep(f'''(CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {p})''', '/+', '/')} END)"
    )
    seg = f"string_split({joined}, '/')"
    fold = (
        f"list_reduce(list_transform({seg}, lambda s: [s]), lambda acc, s: CASE WHEN s[1] = '..' "
        f"THEN acc[1:greatest(length(acc) - 1, 0)] WHEN s[1] = '.' THEN acc ELSE acc || s END, CAST([] AS VARCHAR[]))"
    )
    walked = (
        f"('/' || regexp_replace(array_to_string({fold}, '/') || "
        f"CASE WHEN list_extract({seg}, -1) IN ('.', '..') THEN '/' ELSE '' END, '^/+', ''))"
    )
    return f"""(CASE WHEN {href} = '' THEN {base}
      WHEN {sch} <> '' AND ({sch} <> {G.scheme(base)} OR {host} <> '') THEN {href}
      WHEN {host} <> '' THEN {G.scheme(base)} || ':' || {href}
      WHEN {p} <> '' THEN {origin} || (CASE WHEN regexp_matches({joined}, '(^|/)\\.\\.?(/|$)') THEN {walked} ELSE {joined} END) || {tail}
      WHEN starts_with({tail}, '?') THEN {origin} || {G.rawpath(base)} || {tail}
      ELSE {origin} || {G.rawpath(base)} || {bq} || {tail} END)"""


cte("raw_links", f"""
 SELECT page_id, site, url AS src_url, unnest(found) AS raw, generate_subscripts(found, 1) - 1 AS link_no
 FROM (SELECT page_id, site, url, regexp_extract_all({G.no_scripts('html')}, {q(LINK)}, 1) AS found FROM crawl_raw)""")
cte("hrefs_found", f"""SELECT page_id, site, src_url, link_no,
 {G.unescape(G.rep('raw', '''^["']|["']$'''))} AS href FROM raw_links""")
cte("links", f"""SELECT page_id, site, src_url, link_no, href, {G.norm('dst')} AS dst_url
 FROM (SELECT *, {resolve('src_url', 'href')} AS dst FROM hrefs_found)""")
cte("shop", """
 SELECT 'shop.example.com' AS site, p_partkey AS pos, 'https://shop.example.com'
  || list_extract(['/product/', '/category/', '/guide-', '/brand/', '/item-product-', '/help/'], CAST(p_partkey % 6 + 1 AS INT))
  || p_partkey || CASE WHEN p_partkey % 6 = 5 THEN '?page=2' ELSE '' END AS url FROM part""")
cte("candidates", f"""
 SELECT site, page_id * 1000000 AS pos, url FROM crawl_raw
 UNION ALL SELECT site, page_id * 1000000 + 1 + link_no, dst_url FROM links
 UNION ALL SELECT site, page_id * 1000000 + 900000, url FROM crawl_raw WHERE page_id % 7 = 0
 UNION ALL SELECT site, page_id * 1000000 + 900001, CASE page_id % 9
   WHEN 0 THEN {HOME} || '/cart' WHEN 1 THEN {HOME} || '/tag/x' WHEN 2 THEN {HOME} || '/a.pdf'
   WHEN 3 THEN {HOME} || '/x?orderby=1' WHEN 4 THEN 'mailto:a@b.co' WHEN 5 THEN ''
   WHEN 6 THEN NULL WHEN 7 THEN 'https://cdn.example.org/x' ELSE {HOME} || '/how-to-' || page_id END FROM crawl_raw
 UNION ALL SELECT site, pos, url FROM shop""")
LP, LQ = f"lower({G.path('norm')})", f"lower({G.query('norm')})"
SUFFIX = "(" + " OR ".join(f"ends_with({LP}, {q(s)})" for s in V.ASSET_SUFFIXES) + ")"
cte("labelled", f"""
 SELECT site, pos, norm, CASE
   WHEN norm IS NULL THEN 'invalid'
   WHEN row_number() OVER (PARTITION BY site, norm ORDER BY pos) > 1 THEN 'duplicate'
   WHEN {G.scheme('norm')} NOT IN ('http', 'https') THEN 'non_http'
   WHEN {G.netloc('norm')} <> site THEN 'offsite'
   WHEN {SUFFIX} THEN 'asset'
   WHEN {has(LP, V.TRANSACTIONAL_PATHS)} THEN 'transactional'
   WHEN {has(LP, V.ARCHIVE_PATHS)} THEN 'archive'
   WHEN {has(LQ, V.FACET_QUERIES)} THEN 'faceted'
   WHEN {has(LP, V.PRODUCT_PATHS)} THEN 'product'
   ELSE 'kept' END AS reason
 FROM (SELECT site, pos, CASE WHEN url <> '' THEN {G.norm('url')} END AS norm FROM candidates)""")
cte("sampled", """
 SELECT *, reason = 'product' AND row_number() OVER (PARTITION BY site, reason ORDER BY pos) <= 15 AS sampled FROM labelled""")
cte("kept", """
 SELECT site, norm AS url, pos, CASE WHEN sampled THEN 1 ELSE 0 END AS tail FROM sampled WHERE reason = 'kept' OR sampled""")
cte("numbered", "SELECT *, row_number() OVER (PARTITION BY site ORDER BY tail, pos, url) AS rn, count(*) OVER (PARTITION BY site) AS n FROM kept")
LU = "lower(url)"
TIER = f"""CASE WHEN {has(LU, V.TIER_SKIP)} THEN 'skip' WHEN {has(LU, V.TIER_HIGH)} THEN 'high'
 WHEN {has(LU, V.TIER_MEDIUM)} THEN 'medium' WHEN contains({LU}, 'product') THEN 'low' ELSE 'medium' END"""


def quota(source):
    """Rank inside the quota sample of an ordered list (site, url, pos, tail, rn, n)."""
    return f"""
 SELECT site, url, pos, tail, tier, rank FROM (
  SELECT *, CASE WHEN tier = 'all' THEN rn WHEN tier = 'high' THEN r
    WHEN tier = 'medium' THEN th + r WHEN tier = 'low' THEN th + tm + r END AS rank,
   CASE WHEN tier = 'all' THEN true WHEN tier = 'high' THEN r <= th WHEN tier = 'medium' THEN r <= tm
     WHEN tier = 'low' THEN r <= least(400 - th - tm, nl) ELSE false END AS pick
  FROM (SELECT *, least((400 - th) // 2, nm) AS tm FROM (
   SELECT *, least(nh, 150) AS th FROM (
    SELECT *, row_number() OVER (PARTITION BY site, tier ORDER BY CASE WHEN tier = 'high' THEN rn END, md5(url), url) AS r,
     count(*) FILTER (tier = 'high') OVER (PARTITION BY site) AS nh,
     count(*) FILTER (tier = 'medium') OVER (PARTITION BY site) AS nm,
     count(*) FILTER (tier = 'low') OVER (PARTITION BY site) AS nl
    FROM (SELECT *, CASE WHEN n <= 400 THEN 'all' ELSE {TIER} END AS tier FROM {source}))))
 ) WHERE pick"""


cte("tiersample", quota("numbered"))
cte("listed", """
 SELECT *, row_number() OVER (PARTITION BY site ORDER BY tail, pos, url) AS rn, count(*) OVER (PARTITION BY site) AS n FROM (
  SELECT site, url, pos, tail FROM kept
  UNION ALL SELECT site, base_url, -1, -1 FROM bases b
   WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.site = b.site AND k.url = b.base_url))""")


def clusters(source):
    return " UNION ALL ".join(
        f"SELECT site, '{c}' AS cluster, url, pos, tail FROM {source} WHERE {has(LU, w)}" for c, w in V.CLUSTER_WORDS.items()
    )


def selection(base, lst, budget):
    """First-wins union of start page, clusters in pick order and the list; cut at the budget."""
    return f"""
 SELECT site, rank, url, cluster FROM (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY src, tail, pos, url) AS rank FROM (
   SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY src) AS seen FROM (
    SELECT site, base_url AS url, 'company_information' AS cluster, 0 AS src, 0 AS tail, 0 AS pos FROM {base}
    UNION ALL SELECT site, url, cluster, CASE cluster WHEN 'company_information' THEN 1 WHEN 'educational_content' THEN 2 ELSE 3 END, tail, pos
     FROM ({clusters(lst)})
    UNION ALL SELECT site, url, 'company_information', 9, tail, pos FROM {lst}))
  WHERE seen = 1) WHERE rank <= {budget}"""


cte("picked", selection("bases", "listed", 25))

ORACLES = {
    "scan_pages": build("SELECT page_id, url, status, length(html) AS n_chars, md5(html) AS html_md5 FROM crawl_raw WHERE status < 400"),
    "scan_lang_snippet": build("SELECT page_id, url, substring(html, 1, 20000) AS snippet FROM good"),
    "url_parts": build(f"""SELECT site, pos, {G.scheme('url')} AS scheme, {G.netloc('url')} AS netloc, {G.path('url')} AS path,
      {G.query('url')} AS query, {G.fragment('url')} AS fragment FROM candidates"""),
    "url_normalize": build(f"SELECT site, pos, {G.norm('url')} AS norm FROM candidates"),
    "url_resolve": build(f"""SELECT page_id, href, {resolve('url', 'href')} AS resolved FROM (SELECT page_id, url,
      list_extract(['/a/./b/../' || page_id, '../' || page_id, 'sub/' || page_id, '?q=' || page_id, '#s' || page_id,
       '//cdn.example.org/' || page_id, 'mailto:a@b.co', '', 'http://other.example.org/x?y#' || page_id,
       './../../' || page_id || '/..'], CAST(page_id % 10 + 1 AS INT)) AS href FROM pages)"""),
    "extract_links": build("SELECT page_id, link_no, href, dst_url FROM links"),
    "same_site_links": build(f"SELECT page_id, link_no, dst_url FROM links WHERE {G.netloc('dst_url')} = site"),
    "prefilter_urls": build("SELECT site, url, pos, tail FROM kept"),
    "dropped_by_reason": build("""SELECT site, reason, count(*) AS n FROM sampled WHERE reason <> 'kept' AND NOT sampled
      GROUP BY site, reason"""),
    "dropped_totals": build("""SELECT site, reason, count(*) AS n, CAST(grouping(site, reason) AS INTEGER) AS level FROM sampled
      WHERE reason <> 'kept' AND NOT sampled GROUP BY ROLLUP (site, reason)"""),
    "is_product_url": build(f"""SELECT site, pos, coalesce({has(f"lower({G.path('url')})", V.PRODUCT_PATHS)}, false) AS is_product FROM candidates"""),
    "product_sample": build("""SELECT site, norm AS url, row_number() OVER (PARTITION BY site ORDER BY pos) AS rank
      FROM sampled WHERE sampled"""),
    "knowledge_tier": build(f"SELECT site, url, {TIER} AS tier FROM numbered"),
    "tier_quota_sample": build("SELECT site, url, tier, rank FROM tiersample"),
    "url_category_sample": build(f"""
      SELECT site, url, kind FROM (SELECT *, least(np, 50) AS tp,
        row_number() OVER (PARTITION BY site, kind ORDER BY CASE WHEN kind = 'priority' THEN rn END, md5(url), url) AS r FROM (
        SELECT *, count(*) FILTER ({has(LU, V.CATEGORY_PRIORITY)}) OVER (PARTITION BY site) AS np,
         CASE WHEN n <= 300 THEN 'all' WHEN {has(LU, V.CATEGORY_PRIORITY)} THEN 'priority'
              WHEN NOT {has(LU, V.CATEGORY_SKIP)} THEN 'regular' END AS kind FROM numbered))
      WHERE CASE kind WHEN 'all' THEN true WHEN 'priority' THEN r <= tp WHEN 'regular' THEN r <= 250 - tp ELSE false END"""),
    "url_category": build(f"""
      SELECT site, 'company_info_pages' AS category, url FROM numbered WHERE {has(LU, V.CATEGORY_COMPANY)}
      UNION ALL SELECT site, 'service_pages', url FROM numbered WHERE {has(LU, V.CATEGORY_SERVICE)}
      UNION ALL SELECT site, 'product_pages', url FROM numbered WHERE NOT
        {has(LU, V.CATEGORY_NOT_PRODUCT + V.CATEGORY_COMPANY + V.CATEGORY_SERVICE)}
      UNION ALL SELECT site, CASE reason WHEN 'transactional' THEN 'technical_pages' WHEN 'asset' THEN 'asset_pages' ELSE 'other_pages' END, norm
       FROM labelled WHERE reason IN ('transactional', 'asset', 'archive', 'faceted')"""),
    "cluster_assign": build(clusters("kept")),
    "cluster_counts": build(
        "SELECT site, cluster, n, sum(n) OVER (PARTITION BY site) AS total_knowledge_pages FROM ("
        + " UNION ALL ".join(
            f"SELECT site, '{c}' AS cluster, "
            + (f"count(*) FILTER ({has(LU, V.CLUSTER_WORDS[c])}) AS n" if c in V.CLUSTER_WORDS else "0 AS n")
            + " FROM kept GROUP BY site"
            for c in V.CLUSTERS
        ) + ")"),
    "page_budget": """SELECT p_partkey, CAST(greatest(1, least(coalesce(nullif(requested, 0), 25), 80)) AS BIGINT) AS budget FROM (
      SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size * 3 - 10 - p_partkey % 3 END AS requested FROM part)""",
    "select_pages": build("SELECT * FROM picked"),
    "pages_by_cluster": build("SELECT site, cluster, count(*) AS n FROM picked GROUP BY site, cluster"),
}
