"""Checking SQL for sections, documents and the full chain."""

from sitelore.functions import vocab as V
from oracles import sqlgen as G
from oracles import text as X, urls as U
from oracles.sqlgen import build, cte, q

LP, LQ = U.LP, U.LQ
cte("kb_urls", f"""
 SELECT site, min(page_id) AS pos, {G.norm('url')} AS norm FROM good GROUP BY site, {G.norm('url')}""")
cte("kb_labelled", f"""SELECT site, pos, norm, CASE
   WHEN {U.SUFFIX} THEN 'asset' WHEN {G.has(LP, V.TRANSACTIONAL_PATHS)} THEN 'transactional'
   WHEN {G.has(LP, V.ARCHIVE_PATHS)} THEN 'archive' WHEN {G.has(LQ, V.FACET_QUERIES)} THEN 'faceted'
   WHEN {G.has(LP, V.PRODUCT_PATHS)} THEN 'product' ELSE 'kept' END AS reason FROM kb_urls""")
cte("kb_kept", """SELECT site, norm AS url, pos, CASE WHEN reason = 'product' THEN 1 ELSE 0 END AS tail FROM (
  SELECT *, row_number() OVER (PARTITION BY site, reason ORDER BY pos) AS r FROM kb_labelled)
  WHERE reason = 'kept' OR (reason = 'product' AND r <= 15)""")
cte("kb_listed", """
 SELECT *, row_number() OVER (PARTITION BY site ORDER BY tail, pos, url) AS rn, count(*) OVER (PARTITION BY site) AS n FROM (
  SELECT site, url, pos, tail FROM kb_kept
  UNION ALL SELECT site, base_url, -1, -1 FROM home b
   WHERE NOT EXISTS (SELECT 1 FROM kb_kept k WHERE k.site = b.site AND k.url = b.base_url))""")
cte("kb_picked", U.selection("home", "kb_listed", 25))
cte("kb_chunks", """SELECT k.site, k.rank AS pos, k.url, k.cluster, c.title, c.section, c.chunk, c.tokens
  FROM kb_picked k JOIN (SELECT site, norm, pos % 1000000000000 AS page_id FROM kb_urls) u ON u.site = k.site AND u.norm = k.url
  JOIN (SELECT page_id, title, chunk, section, tokens FROM kb_rows) c ON c.page_id = u.page_id""")
# the section of a selected page is read off its normalised address
cte("kb_rows", f"""SELECT page_id, title, chunk, {X.section(G.norm('url'), 'title')} AS section, {G.toks('chunk')} AS tokens
  FROM chunked WHERE regexp_matches(chunk, '[^' || {q(G.WS[1:-1])} || ']')""")
# declared order matters: rows before the CTE that reads them
G.CTES["kb_chunks"] = G.CTES.pop("kb_chunks")
cte("kb_found", X.contacts("kb_chunks", "site", "chunk"))
cte("kb_contacts", X.contact_rows("kb_found"))
cte("kb_lang", f"""SELECT site, lang FROM (SELECT site, lang, row_number() OVER (PARTITION BY site ORDER BY lang = 'en', count(*) DESC, lang) AS r
  FROM (SELECT site, coalesce({X.script_lang('chunk')}, {X.word_lang('chunk')}) AS lang FROM kb_chunks) GROUP BY site, lang) WHERE r = 1""")


def merged(source, keys, text="chunk"):
    """First copy of every paragraph, put back in order."""
    return f"""
 SELECT {keys}, string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS body FROM (
  SELECT {keys}, pos, string_agg(para, chr(10) ORDER BY no) AS t FROM (
   SELECT *, row_number() OVER (PARTITION BY {keys}, {G.pkey('para')} ORDER BY pos, no) AS copy FROM (
    SELECT {keys}, pos, unnest(ps) AS para, generate_subscripts(ps, 1) AS no
    FROM (SELECT {keys}, pos, {G.paras(text)} AS ps FROM {source})))
  WHERE copy = 1 GROUP BY {keys}, pos) GROUP BY {keys}"""


cte("kb_merged", merged("kb_chunks", "site, section"))
# greedy packing, one text after the other
cte("packing_order", "SELECT site, section, pos, greatest(tokens, 1) AS tokens, row_number() OVER (PARTITION BY site, section ORDER BY pos) AS i FROM kb_chunks")
PACK = """packed AS (
  SELECT site, section, pos, tokens, i, 1 AS batch, tokens AS used FROM packing_order WHERE i = 1
  UNION ALL SELECT o.site, o.section, o.pos, o.tokens, o.i,
   CASE WHEN p.used + o.tokens > {b} THEN p.batch + 1 ELSE p.batch END,
   CASE WHEN p.used + o.tokens > {b} THEN o.tokens ELSE p.used + o.tokens END
  FROM packed p JOIN packing_order o ON o.site = p.site AND o.section = p.section AND o.i = p.i + 1)"""
cte("contact_block", """SELECT site, 'Emails: ' || coalesce(nullif(emails, ''), 'none') || chr(10) || 'Phones: ' || coalesce(nullif(phones, ''), 'none') AS block FROM kb_contacts""")
cte("kb_sections", f"""SELECT site, section, body, {G.toks('body')} AS tokens FROM (
  SELECT site, section, CASE WHEN block IS NULL THEN m.body WHEN m.body IS NULL THEN block ELSE block || chr(10) || chr(10) || m.body END AS body
  FROM kb_merged m FULL OUTER JOIN (SELECT site, 'contact' AS section, block FROM contact_block) c USING (site, section))""")
cte("section_dim", "SELECT * FROM (VALUES " + ", ".join(
    f"({q(k)}, {i}, {V.SECTION_PRIORITY.index(k)}, {q(t)}, {q(V.SECTIONS_FA[k])})" for i, (k, t) in enumerate(V.SECTIONS.items())
) + ") d(section, ord, prio, en, fa)")
cte("lead_paras", f"""SELECT site, section, i, para, sum({G.toks('para')}) OVER (PARTITION BY site, section ORDER BY i) AS used FROM (
  SELECT site, section, unnest(ps) AS para, generate_subscripts(ps, 1) AS i FROM (SELECT site, section, {G.paras('body')} AS ps FROM kb_sections))""")
cte("condensed_bodies", f"""SELECT site, section, coalesce(string_agg(para, chr(10) ORDER BY i) FILTER (used <= 4000),
   substring(max(para) FILTER (i = 1), 1, 16000)) AS condensed FROM lead_paras GROUP BY site, section""")


def plan(target):
    return f"""SELECT site, section, ord, tokens, ct AS condensed_tokens, tokens >= 400 AND total - coalesce(prior, 0) > {target} AS compress, body, condensed FROM (
   SELECT *, sum(tokens) OVER (PARTITION BY site) AS total,
    sum(CASE WHEN tokens >= 400 THEN tokens - ct ELSE 0 END) OVER (PARTITION BY site ORDER BY prio DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
   FROM (SELECT s.*, d.prio, d.ord, c.condensed, {G.toks('c.condensed')} AS ct FROM kb_sections s JOIN condensed_bodies c USING (site, section) JOIN section_dim d USING (section)))"""


def documents(target):
    intro = f"list_filter({G.paras('src')}, lambda p: p <> '---')[1]"
    return f"""SELECT site, lang, document, sections_present, compressed_sections, compressed_sections <> '' AS trimmed, {G.toks('document')} AS final_doc_tokens FROM (
  SELECT h.site, coalesce(l.lang, 'en') AS lang, coalesce(p.sp, '') AS sections_present, coalesce(p.cs, '') AS compressed_sections,
   CASE WHEN p.site IS NULL THEN '# Knowledge Base' || chr(10) || chr(10) || 'No extractable customer knowledge was found on ' || h.base_url || '.'
   ELSE {G.strip(f"concat_ws(chr(10) || chr(10), {intro}, '## ' || CASE WHEN p.lang = 'fa' THEN {q(V.TOC_TITLE_FA)} ELSE {q(V.TOC_TITLE)} END, p.toc, p.bodies)")} END AS document
  FROM home h LEFT JOIN kb_lang l USING (site) LEFT JOIN (
   SELECT r.site, any_value(r.lang) AS lang, string_agg(r.section, ',' ORDER BY ord) AS sp, string_agg(r.section, ',' ORDER BY ord) FILTER (compress) AS cs,
    string_agg('- ' || name, chr(10) ORDER BY ord) AS toc,
    string_agg('## ' || name || chr(10) || chr(10) || {G.strip('CASE WHEN compress THEN condensed ELSE body END')}, chr(10) || chr(10) ORDER BY ord) AS bodies,
    coalesce(string_agg(body, chr(10) || chr(10) ORDER BY ord) FILTER (r.section IN ('company_overview', 'products_services')), '') AS src
   FROM (SELECT p.*, coalesce(l.lang, 'en') AS lang, CASE WHEN l.lang = 'fa' THEN d.fa ELSE d.en END AS name
     FROM ({plan(target)}) p JOIN section_dim d USING (section) LEFT JOIN kb_lang l USING (site)) r GROUP BY r.site) p USING (site))"""


cte("kb_docs", documents(10**15))
cte("kb_docs_small", documents(2000))
AUDIT = f"""SELECT site, regexp_matches(document, {X.EMAIL}) OR coalesce(emails, '') <> '' AS has_email,
  regexp_matches(document, {q(V.DOC_PHONE_RE)}) OR coalesce(phones, '') <> '' AS has_phone, final_doc_tokens AS doc_tokens,
  list_contains(s, 'contact') OR coalesce(emails, '') <> '' OR coalesce(phones, '') <> '' AS has_contact,
  list_contains(s, 'policies') AS has_policies, list_contains(s, 'faq') AS has_faq, list_contains(s, 'products_services') AS has_services,
  concat_ws(',', CASE WHEN NOT list_contains(s, 'contact') THEN 'contact' END, CASE WHEN NOT list_contains(s, 'policies') THEN 'policies' END,
   CASE WHEN NOT list_contains(s, 'faq') THEN 'faq' END, CASE WHEN NOT list_contains(s, 'products_services') THEN 'services' END) AS missing
 FROM (SELECT *, string_split(sections_present, ',') AS s FROM kb_docs LEFT JOIN kb_contacts USING (site))"""
DROPPED = """SELECT site, sum(n) AS n, string_agg(reason || '=' || n, ',' ORDER BY reason) AS why FROM (
  SELECT site, reason, CASE WHEN reason = 'product' THEN count(*) - 15 ELSE count(*) END AS n FROM kb_labelled WHERE reason <> 'kept' GROUP BY 1, 2
  UNION ALL SELECT g.site, 'duplicate', g.n - u.n FROM (SELECT site, count(*) AS n FROM good GROUP BY site) g JOIN (SELECT site, count(*) AS n FROM kb_urls GROUP BY site) u USING (site))
 WHERE n > 0 GROUP BY site"""
SUMMARY = f"""SELECT h.site, d.lang, coalesce(f.n, 0) AS discovered, coalesce(f.n, 0) - coalesce(r.n, 0) AS kept, coalesce(r.why, '') AS dropped_by_reason, coalesce(t.n, 0) AS total_pages_analyzed, coalesce(e.n, 0) AS extracted_pages_count,
  coalesce(t.types, '') AS pages_by_type, sections_present, compressed_sections, final_doc_tokens, coalesce(emails, '') AS emails, coalesce(phones, '') AS phones,
  'Deep pipeline: discovered ~' || coalesce(f.n, 0) || ' URLs, selected ' || coalesce(t.n, 0) || ' knowledge pages, extracted ' || coalesce(e.n, 0)
   || ', synthesised ' || CASE WHEN sections_present = '' THEN 0 ELSE length(string_split(sections_present, ',')) END || ' sections.' AS analysis_summary
 FROM home h LEFT JOIN (SELECT site, count(*) AS n FROM good GROUP BY site) f USING (site) LEFT JOIN ({DROPPED}) r USING (site)
 LEFT JOIN (SELECT site, sum(n) AS n, string_agg(cluster || '=' || n, ',' ORDER BY cluster) AS types FROM (SELECT site, cluster, count(*) AS n FROM kb_picked GROUP BY 1, 2) GROUP BY site) t USING (site)
 LEFT JOIN (SELECT site, count(*) AS n FROM kb_chunks GROUP BY site) e USING (site) JOIN kb_docs d USING (site) LEFT JOIN kb_contacts USING (site)"""
ORACLES = {
    "site_language": build("SELECT * FROM kb_lang"),
    "section_chunks": build("""SELECT site, section, count(*) AS n_chunks, sum(tokens) AS tokens FROM kb_chunks GROUP BY 1, 2
      UNION ALL SELECT site, 'contact', 0, 0 FROM kb_contacts WHERE site NOT IN (SELECT site FROM kb_chunks WHERE section = 'contact')"""),
    "token_batches": build("WITH RECURSIVE " + PACK.format(b=1500) + " SELECT site, section, pos, tokens, batch FROM packed"),
    "section_partial": build("WITH RECURSIVE " + PACK.format(b=1500) + merged("(SELECT k.*, batch FROM kb_chunks k JOIN packed USING (site, section, pos))", "site, section, batch")),
    "section_merge": build("SELECT * FROM kb_merged"),
    "contact_context": build("SELECT * FROM contact_block"),
    "section_title": build("""SELECT doc_id, section, lang, CASE WHEN lower(lang) = 'fa' AND fa IS NOT NULL THEN fa ELSE coalesce(en, section) END AS title FROM (
      SELECT doc_id, CASE WHEN doc_id % 9 = 8 THEN 'unknown' ELSE list_extract(['company_overview', 'contact', 'products_services', 'policies', 'faq',
       'ordering_payment', 'support_howto', 'additional'], CAST(doc_id % 9 + 1 AS INT)) END AS section,
       CASE WHEN doc_id % 3 = 0 THEN 'FA' ELSE lang END AS lang FROM documents) LEFT JOIN section_dim USING (section)"""),
    "toc": build(f"""SELECT site, string_agg(section, ',' ORDER BY ord) AS sections_present, CASE WHEN any_value(lang) = 'fa' THEN {q(V.TOC_TITLE_FA)} ELSE {q(V.TOC_TITLE)} END AS heading,
      string_agg('- ' || CASE WHEN lang = 'fa' THEN fa ELSE en END, chr(10) ORDER BY ord) AS toc FROM kb_sections JOIN section_dim USING (section) JOIN kb_lang USING (site) GROUP BY site"""),
    "overview_source": build("""SELECT site, string_agg(body, chr(10) || chr(10) ORDER BY section) AS overview FROM kb_sections
      WHERE section IN ('company_overview', 'products_services') GROUP BY site"""),
    "target_tokens": """SELECT o_orderkey, CAST(greatest(2000, least(coalesce(TRY_CAST(r AS BIGINT), 18000), 120000)) AS BIGINT) AS target FROM (
      SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'many' ELSE CASE WHEN o_orderkey % 8 = 2 THEN '99999999999' ELSE CAST((o_orderkey * 37) % 200000 - 500 AS VARCHAR) END END AS r FROM orders)""",
    "compression_plan": build(f"SELECT site, section, tokens, condensed_tokens, compress FROM ({plan(2000)})"),
    "assemble_document": build("SELECT * FROM kb_docs_small"),
    "completeness_audit": build(AUDIT),
    "kb_summary": build(SUMMARY),
    "knowledge_base": build("SELECT * FROM kb_docs"),
    "legacy_compile": build("""SELECT site, cluster, upper(replace(cluster, '_', ' ')) || ':' || chr(10) || string_agg(chunk, chr(10) || chr(10) ORDER BY pos) AS text FROM kb_chunks GROUP BY site, cluster
      UNION ALL SELECT site, '(all)', string_agg('--- Chunk from ' || url || ' ---' || chr(10) || 'Title: ' || title || chr(10) || 'Content:' || chr(10) || chunk, chr(10) || chr(10) ORDER BY pos) FROM kb_chunks GROUP BY site"""),
}
