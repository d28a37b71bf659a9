"""SQL that states what the operators' queries return, where SQL can, for a database with the same tables."""

from sitelore.llm.secrets import BASE, RULES

EXACT = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), best AS (
  SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id
  FROM rows
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM best
"""

JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w
), x AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2
  HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
), pairs AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, b.v FROM reach r JOIN pairs b ON b.u = r.other
)
SELECT s.doc_id, len(any_value(sh)) AS n_shingles, min(other) AS component_id FROM s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id
"""

VECTORS = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.v FROM reach r JOIN links l ON l.u = r.other
), sizes AS (
  SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT r.vec_id, coalesce(any_value(n), 0) AS n_links, min(other) AS component_id, r.vec_id = min(other) AS kept
FROM reach r LEFT JOIN sizes ON u = r.vec_id GROUP BY r.vec_id
"""

REPEATS = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY part ORDER BY doc_id, s) AS copy
  FROM (SELECT doc_id, s, md5(b[s + 1 : s + 100]) AS part FROM (SELECT doc_id, b, unnest(range(0, n - 99)) AS s FROM d))
), edge AS (
  SELECT doc_id, s, CASE WHEN s > max(s + 100) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new
  FROM w WHERE copy > 1
), spans AS (
  SELECT doc_id, run, min(s) AS a, max(s) + 100 AS z
  FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM edge) GROUP BY doc_id, run
), kept AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM (
    SELECT doc_id, a, z FROM spans UNION ALL SELECT doc_id, n, n FROM d)
)
SELECT d.doc_id, any_value(n) AS n_bytes, CAST(sum(k.z - k.a) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans,
  sha256(unhex(coalesce(string_agg(hex(b[before + 1 : a]), '' ORDER BY a, k.z), ''))) AS kept_sha256
FROM d JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.doc_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    """Ends are running lengths of the pieces "all up to a match"; starts follow from the matches' lengths."""
    kinds = []
    for k, (name, pattern, group, least) in enumerate(RULES):
        kinds.append(f"""SELECT doc_id, {k} AS k, '{name}' AS kind, sum(up) OVER (PARTITION BY doc_id ORDER BY i) - len AS a,
    sum(up) OVER (PARTITION BY doc_id ORDER BY i) AS z, val >= {least} AS good FROM (
    SELECT doc_id, length(unnest(regexp_extract_all(t, {_quoted('(?s).*?(?:' + pattern + ')')}))) AS up,
      length(unnest(regexp_extract_all(t, {_quoted(pattern)}))) AS len, length(unnest(regexp_extract_all(t, {_quoted(pattern)}, {group}))) AS val,
      unnest(range(1, len(regexp_extract_all(t, {_quoted(pattern)})) + 1)) AS i FROM d)""")
    counts = ", ".join(f"count(*) FILTER (kind = '{n}') AS n_{n}" for n in BASE)
    base = f"k < {len(BASE)}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS (
  {" UNION ALL ".join(kinds)}
), written AS (SELECT doc_id, k, kind, a, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(z AS BIGINT) AS w FROM found WHERE good)
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(w, ',' ORDER BY a, k) FILTER ({base}), '')) AS base_sha256,
  coalesce(string_agg(w, ',' ORDER BY a, k), '') AS spans
FROM d LEFT JOIN written x ON x.doc_id = d.doc_id GROUP BY d.doc_id
"""


CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, ['user', 'assistant'][i + 1], '<|im_end|><|im_start|>assistant ok' FROM range(2) t(i)
), p AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(length('<|im_start|>' || replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A') || chr(10)
      || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10))) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, md5(role || chr(10) || text))
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR pos = n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""


DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), o AS (
  SELECT r, lang, source, unnest(ws) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3
), v AS (
  SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL
), full_ AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n::HUGEINT AS lang_n
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT f.lang, f.source, f.term, f.n, 1 + 1000000000::HUGEINT * (f.n + 1) // (sum(f.n) OVER (PARTITION BY f.lang, f.source) + v.v)::HUGEINT AS p,
    1 + 1000000000::HUGEINT * (f.lang_n + 1) // (v.total + v.v) AS q
  FROM full_ f JOIN v ON v.lang = f.lang
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


COLLOCATIONS = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), spots AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces
), found AS (
  SELECT lang, i, ws, unnest(range(1, least(5, len(ws) - i + 1) + 1)) AS k FROM spots
), grams AS MATERIALIZED (
  SELECT lang, phrase, k, count(*) AS a FROM (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM found) GROUP BY ALL
  HAVING count(*) >= 100
), totals AS (
  SELECT lang, sum(len(ws))::HUGEINT AS n FROM pieces GROUP BY lang
), cand AS MATERIALIZED (
  SELECT *, string_split(phrase, ' ') AS ws FROM grams WHERE k > 1
), parts AS (
  SELECT lang, a, ws, k, i, unnest(range(2, k - i + 2)) AS m FROM (SELECT *, unnest(range(1, k)) AS i FROM cand)
), inside AS MATERIALIZED (
  SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(ws[i : i + m - 1], ' ') AS phrase FROM parts WHERE m < k) GROUP BY ALL
), halves AS MATERIALIZED (
  SELECT lang, phrase, a, cut, array_to_string(ws[1 : cut], ' ') AS first, array_to_string(ws[cut + 1 : k], ' ') AS rest
  FROM (SELECT c.*, unnest(range(1, c.k)) AS cut FROM cand c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase
    WHERE i.longer IS NULL OR 100 * i.longer < 100 * c.a)
), cuts AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS lowest FROM (
    SELECT h.*, x.a AS l, y.a AS r, n, 1000 * h.a::HUGEINT * n // (x.a::HUGEINT * y.a) AS score
    FROM halves h JOIN grams x ON x.lang = h.lang AND x.phrase = h.first JOIN grams y ON y.lang = h.lang AND y.phrase = h.rest
    JOIN totals t ON t.lang = h.lang)
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
    CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM cuts WHERE lowest = 1
)
SELECT * FROM ranked WHERE rank <= 2000
"""


ORACLES = {
    "op1_exact_dedup": EXACT,
    "op2_jaccard_join": JACCARD,
    "op5_lattice_dedup": VECTORS,
    "op8_suffix_dedup": REPEATS,
    "op10_secrets": _secrets(),
    "op11_chat_format": CHAT,
    "op12_source_divergence": DIVERGENCE,
    "op13_collocations": COLLOCATIONS,
}
