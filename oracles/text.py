"""Checking SQL for text, language, contacts, colours and chunks."""

from sitelore.functions import vocab as V
from oracles import sqlgen as G
from oracles import urls as _urls  # declares the shared CTEs first
from oracles.sqlgen import build, cte, has, q

BOILER = ["nav", "footer", "header", "noscript", "svg", "form", "iframe"]


def title(x):
    raw = f"regexp_extract({x}, '(?is)<title\\b[^>]*>([^<]*)</title\\s*>', 1)"
    return f"CASE WHEN {raw} = '' THEN 'N/A' ELSE {G.strip(G.unescape(raw))} END"


def main_content(source, keep, html="html"):
    """Three tiers over (keep, html) rows."""
    blk = r"(?i)</?(?:p|li|td|h[1-6]|pre|blockquote)\b[^>]*>"
    tag = r"<[/!?A-Za-z][^>]*>"
    anchors = f"array_to_string(regexp_extract_all(b, {q(r'(?is)<a' + chr(92) + r'b[^>]*>(.*?)</a' + chr(92) + r's*>')}, 1), '')"
    return f"""SELECT {keep}, CASE WHEN length(art) > 40 THEN art WHEN length(blk) > 40 THEN blk ELSE {G.rep(G.lines('page'), chr(92) + 'n{3,}', chr(10) * 2)} END AS chunk
     FROM (SELECT *, {G.lines("array_to_string(regexp_extract_all(page, '(?is)<(?:article|main)" + chr(92) + "b[^>]*>(.*?)</(?:article|main)" + chr(92) + "s*>', 1), '<br>')")} AS art,
       {G.lines(f"array_to_string(list_filter(regexp_split_to_array(page, {q(blk)}), lambda b: regexp_matches({G.rep('b', tag)}, '[^' || {q(G.WS[1:-1])} || ']') AND 2 * length({G.rep(anchors, tag)}) < length({G.rep('b', tag)})), '<br>')")} AS blk
      FROM (SELECT *, {G.drop(G.body(G.no_scripts(html, '<br>')), BOILER, '<br>')} AS page FROM {source}))"""


def section(url, t):
    low = f"lower({G.path(url)} || ' ' || {t})"
    return "CASE " + " ".join(f"WHEN {has(low, w)} THEN '{k}'" for k, w in V.SECTION_WORDS.items()) + " ELSE 'additional' END"


def script_lang(x):
    ar = f"length(regexp_replace({x}, '[^{V.ARABIC_RANGES}]', '', 'g'))"
    la = f"length(regexp_replace({x}, '[^A-Za-z]', '', 'g'))"
    return f"CASE WHEN {ar} >= 20 AND {ar} * 1.0 / ({ar} + {la}) >= 0.15 THEN CASE WHEN regexp_matches({x}, '[{V.PERSIAN_LETTERS}]') THEN 'fa' ELSE 'ar' END END"


def word_lang(x):
    words = f"regexp_extract_all(lower({x}), '\\p{{L}}+')"
    votes = ", ".join(
        f"{{'n': -length(list_filter({words}, lambda w: list_contains({G.arr(V.STOPWORDS[c])}, w))), 'c': '{c}'}}"
        for c in V.STOPWORDS
    )
    return f"(SELECT CASE WHEN v.n = 0 THEN 'en' ELSE v.c END FROM (SELECT list_min([{votes}]) AS v))"


EMAIL = q(V.EMAIL_RE)
PHONE = q(V.PHONE_RE)


def contacts(source, site, text):
    return f"""SELECT DISTINCT {site} AS site, 'email' AS kind, unnest(regexp_extract_all({text}, {EMAIL})) AS value FROM {source}
     UNION SELECT site, kind, value FROM (SELECT {site} AS site, 'phone' AS kind, {G.strip('m')} AS value
       FROM (SELECT {site}, unnest(regexp_extract_all({text}, {PHONE})) AS m FROM {source}))
      WHERE length(regexp_replace(value, '\\P{{Nd}}', '', 'g')) BETWEEN 7 AND 15"""


def contact_rows(found):
    return f"""SELECT site, coalesce(string_agg(value, ', ' ORDER BY value) FILTER (kind = 'email'), '') AS emails,
      coalesce(string_agg(value, ', ' ORDER BY value) FILTER (kind = 'phone'), '') AS phones
     FROM (SELECT *, row_number() OVER (PARTITION BY site, kind ORDER BY value) AS r FROM {found}) GROUP BY site"""


cte("doc_contacts", contacts("documents", "source", "text"))
LETTERS = "regexp_replace"
cte("script_texts", """SELECT doc_id, CASE doc_id % 4
  WHEN 1 THEN translate(lower(text), 'aeioutnsrlp', 'اهیوتنسرلپچ')
  WHEN 2 THEN translate(lower(text), 'aeioutnsrl', 'اهعوتنسرلد') ELSE text END AS text FROM documents""")
cte("shaped", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN replace(html, 'article', 'div')
  ELSE replace(replace(html, 'article', 'div'), '<p>', '<br>') END AS html FROM pages""")
cte("titled", f"SELECT page_id, site, url, html, {title('html')} AS title FROM good")
cte("chunked", main_content("titled", "page_id, site, url, title"))
cte("allchunks", f"""SELECT page_id, site, url, title, {section('url', 'title')} AS section, chunk, {G.toks('chunk')} AS tokens
  FROM chunked WHERE regexp_matches(chunk, '[^' || {q(G.WS[1:-1])} || ']')""")
cte("styled", """SELECT page_id, site, url, regexp_replace(html, '(?i)</head>', '<style>body{background:'
  || list_extract(['#FAFAFA', '#fff', '#123456', 'white'], CAST(page_id % 4 + 1 AS INT)) || ';color:'
  || list_extract(['#0a0', '#00AA00', 'red'], CAST(page_id % 3 + 1 AS INT)) || '}a{border:1px solid '
  || list_extract(['#abc', '#00aa00', '#c0ffee'], CAST(page_id % 3 + 1 AS INT)) || ';background-color : #EEE}</style></head>', 'g') AS html FROM good""")
HEX6 = r"(?i)#(?:[0-9a-f]{6}|[0-9a-f]{3})\b"
BG = r"(?i)background(?:-color)?\s*:\s*(#(?:[0-9a-f]{6}|[0-9a-f]{3})\b)"
cte("start_pages", f"""SELECT b.site, min(p.page_id) AS page_id FROM home b JOIN good p ON p.site = b.site AND {G.norm('p.url')} = b.base_url GROUP BY b.site""")
cte("found_colors", f"""
  SELECT site, role, CASE WHEN length(c) = 4 THEN regexp_replace(c, '([0-9a-f])', '\\1\\1', 'g') ELSE c END AS c FROM (
   SELECT s.site, 'bg' AS role, lower(unnest(regexp_extract_all(p.html, {q(BG)}, 1))) AS c FROM styled p JOIN start_pages s USING (page_id)
   UNION ALL SELECT s.site, 'brand', lower(unnest(regexp_extract_all(regexp_replace(p.html, {q(BG)}, '', 'g'), {q(HEX6)}))) FROM styled p JOIN start_pages s USING (page_id))""")
cte("top_colors", """SELECT site, role, c, n FROM (SELECT site, role, c, count(*) AS n, row_number() OVER (PARTITION BY site, role ORDER BY count(*) DESC, c) AS r
  FROM found_colors GROUP BY site, role, c) WHERE r = 1""")

QA_TEXT = "replace(replace(text, ', ', '?' || chr(10)), '. ', '.' || chr(10))"
ORACLES = {
    "page_title": build(f"SELECT page_id, {title('html')} AS title FROM pages"),
    "clean_text": build(f"SELECT page_id, {G.clean('html')} AS text FROM pages"),
    "plain_text": build(f"SELECT page_id, {G.lines(G.body(G.no_scripts('html', '<br>')))} AS text FROM pages"),
    "main_content": build(main_content("shaped", "page_id")),
    "strip_noise_html": build(f"""SELECT page_id, {G.rep(G.drop(G.drop('html', ['script', 'style']), ['nav', 'footer', 'header', 'noscript', 'svg']), '(?i)<(?:meta|link)' + chr(92) + 'b[^>]*>')} AS html FROM pages"""),
    "token_count": build(f"SELECT doc_id, {G.toks('text')} AS tokens FROM documents"),
    "detect_script_lang": build(f"SELECT doc_id, {script_lang('text')} AS lang FROM script_texts"),
    "detect_lang": build(f"SELECT doc_id, {word_lang('text')} AS detected, lang AS labelled FROM documents"),
    "language_name": build("SELECT doc_id, code, coalesce(m.n, CASE WHEN coalesce(code, '') = '' THEN 'the source language' ELSE code END) AS name FROM ("
        "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN upper(lang) WHEN 1 THEN 'Xx' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN 'fa' ELSE lang END AS code FROM documents) d "
        "LEFT JOIN (VALUES " + ", ".join(f"({q(c)}, {q(n)})" for c, n in V.LANGUAGE_NAMES.items()) + ") m(c, n) ON m.c = lower(d.code)"),
    "harvest_emails": build("SELECT site, value AS email FROM doc_contacts WHERE kind = 'email'"),
    "harvest_phones": build("SELECT site, value AS phone FROM doc_contacts WHERE kind = 'phone'"),
    "site_contacts": build(contact_rows("doc_contacts")),
    "site_colors": build("""SELECT h.site, coalesce(b.c, '#ffffff') AS main_background_color, coalesce(d.c, '#000000') AS primary_brand_color,
       CASE WHEN b.c IS NULL THEN 'Default white background (fallback)' ELSE 'Set as a background ' || b.n || ' times on the start page' END AS background_color_description,
       CASE WHEN d.c IS NULL THEN 'Default black text (fallback)' ELSE 'Used ' || d.n || ' times besides backgrounds on the start page' END AS brand_color_description
      FROM home h LEFT JOIN top_colors b ON b.site = h.site AND b.role = 'bg' LEFT JOIN top_colors d ON d.site = h.site AND d.role = 'brand'"""),
    "page_section": build(f"SELECT page_id, {section('url', 'title')} AS section FROM titled"),
    "page_chunks": build("SELECT page_id, site, url, title, section, chunk, tokens FROM allchunks"),
    "faq_pairs": build(f"""SELECT doc_id, line_no, question, answer FROM (SELECT doc_id, l[i] AS question, l[i + 1] AS answer, i AS line_no
      FROM (SELECT doc_id, l, unnest(range(1, length(l) + 1)) AS i FROM (SELECT doc_id, {G.paras(QA_TEXT)} AS l FROM documents)))
      WHERE regexp_matches(question, '[?؟]$') AND answer IS NOT NULL AND NOT regexp_matches(answer, '[?؟]$')"""),
}
