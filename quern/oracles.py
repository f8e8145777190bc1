"""DuckDB SQL for the registered queries, written apart from them."""

_SEARCH = """
v AS (SELECT vec_id, CASE WHEN label < 6 THEN 'text' ELSE 'image' END AS modality, embedding::DOUBLE[] AS e FROM embeddings),
q AS (SELECT CAST(vec_id AS INTEGER) AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {which}),
s AS (SELECT query_id, vec_id, modality, coalesce(list_cosine_similarity(v.e, q.e), 0) AS score FROM v, q),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, modality ORDER BY score DESC, vec_id) AS r FROM s),
h AS (SELECT query_id, vec_id, modality, score FROM n WHERE (modality = 'text' AND r <= 10) OR (modality = 'image' AND r <= 5))"""
_HITS, _QUESTION = _SEARCH.format(which="vec_id % 100 = 0"), _SEARCH.format(which="vec_id < 5")

_FUSED = f"""{_QUESTION},
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, modality DESC, vec_id) - 1 AS rank FROM h),
f AS (SELECT vec_id, modality, sum(CASE WHEN modality = 'text' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END / (rank + 60.0::DOUBLE)) AS score, min({{'q': query_id, 'r': rank}}) AS seen FROM k GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, seen, vec_id) - 1 AS rank FROM f QUALIFY rank < 10)"""

_PARENTS = f"""{_FUSED},
up AS (SELECT t.conv_id, min(top.rank) AS rank FROM top JOIN conversations t ON t.conv_id = top.vec_id // 3 AND t.turn = top.vec_id % 3 GROUP BY 1),
par AS (SELECT up.rank, c.conv_id || '-0' AS node_id, CASE c.conv_id % 3 WHEN 0 THEN 'section' WHEN 1 THEN 'image' END AS type, CASE WHEN c.conv_id % 3 = 1 THEN 'image' ELSE 'text' END AS kind, c.text
        FROM up JOIN conversations c ON c.conv_id = up.conv_id AND c.turn = 0 WHERE c.conv_id % 3 <> 2)"""

_MARKED = """
lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS x FROM documents),
marked AS (SELECT doc_id, i, CASE WHEN i = 0 THEN x WHEN i % 4 = 1 THEN '== Part ' || i || ' ==' || chr(10) || x WHEN i % 4 = 2 THEN '=== Detail ' || i || ' ===' || chr(10) || x
                  WHEN i % 4 = 3 THEN '==== Deep ' || i || ' ====' || chr(10) || x ELSE x END AS y FROM lines),
content AS (SELECT doc_id, string_agg(y, chr(10) ORDER BY i) AS content FROM marked GROUP BY 1)"""

_TURNS = "SELECT conv_id, turn, conv_id || '-' || turn AS node_id, lag(conv_id || '-' || turn) OVER w AS prev_id, lead(conv_id || '-' || turn) OVER w AS next_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"

_REFS = """
rows AS (SELECT conv_id // 5 AS page_id, conv_id, turn, CASE WHEN turn = 0 THEN '#cite_ref-' || conv_id END AS cite_ref, text, 'http://ref/' || conv_id || '/' || turn AS url FROM conversations),
refs AS (SELECT page_id, conv_id, max(cite_ref) AS cite_ref, list({'text': text, 'url': url} ORDER BY turn) FILTER (turn > 0) AS l FROM rows GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY conv_id) AS ref_pos FROM refs),
tuples AS (SELECT page_id, ref_pos, cite_ref, conv_id::VARCHAR AS ref_no, coalesce(list_filter(l, lambda x: x.text <> '')[1].text, '') AS title, l[1].url AS link,
                  array_to_string(list_transform(l[2:], lambda x: x.url), '|') AS archived, conv_id FROM numbered WHERE len(l) > 0)"""

_TYPES = "['chunk', 'entities', 'summary', 'key_takeaways', 'table_analysis', 'page', 'image_description', 'plot_insights', 'image_entities', 'image']"



def _ranked(queries: str) -> str:
    """BM25 of every document for each query (query_id, text)."""
    found = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
    return f"""WITH asked AS (SELECT DISTINCT query_id, unnest({found.format("text")}) AS t FROM ({queries})),
texts AS (SELECT doc_id, {found.format("coalesce(text, '')")} AS w FROM documents),
about AS (SELECT count(*) AS texts, avg(len(w)) AS mean FROM texts),
found AS (SELECT doc_id, len(w) AS size, unnest(w) AS t FROM texts),
n AS (SELECT doc_id, t, any_value(size) AS size, count(*) AS n FROM found WHERE t IN (SELECT t FROM asked) GROUP BY 1, 2),
have AS (SELECT t, count(*) AS k FROM n GROUP BY 1),
scored AS (SELECT query_id, doc_id, sum(ln(1 + (texts - k + 0.5::DOUBLE) / (k + 0.5::DOUBLE)) * n * 2.2::DOUBLE / (n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))) AS score
           FROM n JOIN asked USING (t) JOIN have USING (t), about GROUP BY 1, 2)
"""


SQL = {
    "knn_filtered_topk": f"WITH {_HITS} SELECT query_id, vec_id, round(score, 9) AS score FROM h WHERE modality = 'text'",
    "text_first_hits": f"WITH {_HITS} SELECT query_id, vec_id, modality, round(score, 9) AS score FROM h",
    "rrf_fusion": f"WITH {_FUSED} SELECT vec_id, modality, round(score, 9) AS score FROM top",
    "parent_lookup": f"WITH {_PARENTS} SELECT CAST(rank AS INTEGER) AS rank, node_id, type, kind FROM par",
    "context_concat": f"WITH {_PARENTS} SELECT coalesce(string_agg(text, ' ' ORDER BY rank) FILTER (kind = 'text' AND text <> ''), '') AS texts, coalesce(string_agg('http://images/' || node_id || '.png', ' ' ORDER BY rank) FILTER (kind = 'image'), '') AS image_urls FROM par",
    "clean_text": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'citation' ELSE 'section' END AS type, CASE WHEN doc_id % 5 = 0 THEN text ELSE regexp_replace(text, '[^0-9A-Za-z ]', '', 'g') END AS text FROM documents",
    "sanitise_title": r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[<>:,"/\\|?*]', '-', 'g'), '[\s\x{0b}\x{85}\x{a0}\x{2028}\x{2029}\x{3000}-]+', '-', 'g') AS title FROM documents""",
    "intro_split": f"WITH {_MARKED} SELECT doc_id, regexp_replace(string_split_regex(content, '(==[^=].*?==)|(===.*?===)')[1], '^\\s+|\\s+$', '', 'g') AS intro FROM content",
    "section_titles": f"""WITH {_MARKED},
hs AS (SELECT doc_id, unnest(regexp_extract_all(content, '(?m)(^==[^=].*?==)|(^===.*?===)')) AS h, generate_subscripts(regexp_extract_all(content, '(?m)(^==[^=].*?==)|(^===.*?===)'), 1) AS pos FROM content),
t AS (SELECT doc_id, pos, substr(h, 3, 1) <> '=' AS top, trim(trim(h, '= ')) AS title, sum(CASE WHEN substr(h, 3, 1) <> '=' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM hs)
SELECT doc_id, CAST(s - 1 AS INTEGER) AS section_no, max(title) FILTER (top) AS title, coalesce(string_agg(title, '|' ORDER BY pos) FILTER (NOT top), '') AS subsections FROM t WHERE s > 0 GROUP BY doc_id, s""",
    "semantic_chunks": r"""WITH a AS (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*\s*') AS ss FROM documents),
s AS (SELECT doc_id, unnest(ss) AS x, generate_subscripts(ss, 1) AS i FROM a),
g AS (SELECT doc_id, i, x, lower(coalesce(lag(x) OVER w, '') || x || coalesce(lead(x) OVER w, '')) AS y FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
v AS (SELECT doc_id, i, x, list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: (length(y) - length(replace(y, c, '')))::DOUBLE) AS e FROM g),
w AS (SELECT *, lead(e) OVER (PARTITION BY doc_id ORDER BY i) AS f FROM v),
d AS (SELECT doc_id, i, x, CASE WHEN f IS NULL THEN NULL ELSE round(1.0::DOUBLE - CASE WHEN list_sum(e) = 0 OR list_sum(f) = 0 THEN 0 ELSE list_inner_product(e, f) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(f, f))) END, 9) END AS d FROM w),
p AS (SELECT *, round(quantile_cont(d, 0.7) OVER (PARTITION BY doc_id), 9) AS t FROM d),
c AS (SELECT *, coalesce(sum(CASE WHEN d > t THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM p)
SELECT doc_id, CAST(n AS INTEGER) AS chunk_no, string_agg(x, '' ORDER BY i) AS chunk FROM c GROUP BY doc_id, n""",
    "prev_next_links": f"SELECT node_id, prev_id, next_id FROM ({_TURNS})",
    "edges_from_nodes": f"""WITH t AS ({_TURNS}) SELECT prev_id AS src_id, node_id AS dst_id, 'PREVIOUS' AS rel FROM t WHERE prev_id IS NOT NULL
UNION ALL SELECT next_id, node_id, 'NEXT' FROM t WHERE next_id IS NOT NULL
UNION ALL SELECT conv_id || '-0', node_id, 'PARENT' FROM t WHERE turn > 0 AND EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = t.conv_id AND c.turn = 0)""",
    "page_links": r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?s)<a\s[^>]*?href="[^"]*"[^>]*>.*?</a>') AS l FROM pages),
u AS (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS pos FROM a),
p AS (SELECT page_id, pos, regexp_replace(regexp_extract(x, '(?s)^<a\s[^>]*>(.*?)</a>$', 1), '<[^>]*>', '', 'g') AS text, regexp_extract(x, 'href="([^"]*)"', 1) AS url FROM u)
SELECT page_id, 'Body' AS section, text, url, CAST(min(pos) AS BIGINT) AS pos FROM p
WHERE NOT contains(url, 'cite_note') AND NOT regexp_matches(lower(url), '\.(jpg|jpeg|png|svg|gif)$') GROUP BY page_id, text, url""",
    "citation_groups": f"WITH {_REFS} SELECT page_id, CAST(ref_pos AS BIGINT) AS ref_pos, cite_ref, ref_no, title, link, archived FROM tuples",
    "citation_resolve": f"WITH {_REFS} SELECT page_id, CASE WHEN conv_id % 2 = 1 THEN 'Part 1' ELSE 'Introduction' END AS section, ref_no, title, link, archived FROM tuples",
    "vector_routing": f"""WITH t AS (SELECT vec_id, {_TYPES}[label + 1] AS type, embedding::DOUBLE[] AS e FROM embeddings WHERE label <> 9)
SELECT vec_id, 'wiki_text' AS collection, CASE WHEN type IN ('image', 'plot', 'image_description', 'plot_insights', 'image_entities') THEN 'image' ELSE 'text' END AS modality, round(sqrt(list_inner_product(e, e)), 6) AS norm FROM t WHERE type <> 'page'""",
    "embedding_flags": f"""WITH t AS (SELECT vec_id, {_TYPES}[label + 1] AS type FROM embeddings)
SELECT vec_id, type, CASE WHEN type = 'image' THEN true WHEN type IN ('table_analysis', 'page') THEN false ELSE vec_id % 3 <> 0 END AS needs_embedding FROM t""",
    "type_normalise": """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unknown' WHEN event_id % 5 = 0 THEN 'image' WHEN contains(lower(event_type), 'image') THEN 'image' ELSE lower(event_type) END AS type, upper(event_type[1]) || lower(event_type[2:]) AS label FROM events""",
    "token_cost": "SELECT source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS tokens, round(sum(n_chars)::DOUBLE * 0.00002::DOUBLE, 6) AS cost FROM documents GROUP BY source",
    "union_nodes": "SELECT 'd' || doc_id AS node_id, 'section' AS type, doc_id AS ord, length(text) AS size FROM documents UNION ALL SELECT 'p' || page_id, 'page', 1000000000000 + page_id, length(html) FROM pages",
    "search_topn": r"""WITH s AS (SELECT doc_id, len(regexp_extract_all(lower(text), '\bthe\b')) + len(regexp_extract_all(lower(text), '\bof\b')) + len(regexp_extract_all(lower(text), '\blicensed\b')) AS score FROM documents)
SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""",
    "node_to_graph": """SELECT conv_id || '-' || turn AS node_id, CASE WHEN turn % 2 = 1 THEN 'text' ELSE 'image' END AS kind, CASE WHEN turn % 2 = 1 THEN 'section' ELSE 'image' END AS type, role AS title,
CASE WHEN turn % 2 = 1 THEN text END AS text, CASE WHEN turn % 2 = 0 THEN 'u' || turn END AS image_url, conv_id || '-0' AS parent_id FROM conversations WHERE turn > 0""",
    "generated_queries": r"""WITH l AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations),
p AS (SELECT conv_id, turn, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS q FROM l),
u AS (SELECT conv_id, turn, unnest(q) AS query, generate_subscripts(q, 1) - 1 AS line FROM p),
m AS (SELECT conv_id, query, min({'turn': turn, 'line': CAST(line AS INTEGER)}) AS p FROM u GROUP BY 1, 2)
SELECT conv_id, query, p.turn AS turn, p.line AS line FROM m""",
    "payload_ids": "SELECT vec_id, 'n' || vec_id AS node_id FROM embeddings",
}


def _title(c: str) -> str:
    return rf"""regexp_replace(regexp_replace({c}, '[<>:,"/\\|?*]', '-', 'g'), '[\s\x{{0b}}\x{{85}}\x{{a0}}\x{{2028}}\x{{2029}}\x{{3000}}-]+', '-', 'g')"""


def _trim(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


_SENTENCES = rf"""
a AS (SELECT doc_id, source, regexp_extract_all(text, '[^.!?]+[.!?]*\s*') AS l FROM documents),
s AS (SELECT doc_id, source, list_filter(list_transform(l, lambda x: {_trim("x")}), lambda x: x <> '') AS l FROM a)"""

#: Sections and subsections of the marked documents: Part i, Detail i, Deep i, numbered by Part.
_SECTIONS = rf"""{_MARKED},
x AS (SELECT doc_id, i, x, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM lines),
heads AS (SELECT doc_id, i, i // 4 + 1 AS no, i % 4 - 1 AS sub, CASE i % 4 WHEN 1 THEN 'Part ' WHEN 2 THEN 'Detail ' ELSE 'Deep ' END || i AS title,
                 {_trim("CASE WHEN i % 4 = 3 AND y IS NOT NULL THEN x || chr(10) || y ELSE x END")} AS body FROM x WHERE i % 4 > 0),
secs AS (SELECT h.*, sha256(h.doc_id || '|section|' || h.no || '.' || h.sub) AS node_id, sha256(h.doc_id || '|section|' || h.no || '.0') AS top_id, sha256(h.doc_id || '|page|0') AS page_node
         FROM heads h JOIN heads p ON p.doc_id = h.doc_id AND p.no = h.no AND p.sub = 0 WHERE h.body <> '' AND p.body <> '')"""

_CITED = f"""{_REFS},
cited AS (SELECT page_id, CASE WHEN conv_id % 2 = 1 THEN 'Part ' || conv_id % 3 ELSE 'Introduction' END AS section, CASE WHEN conv_id % 2 = 1 THEN conv_id % 3 ELSE -1 END AS section_pos, ref_no, title, link, archived, conv_id FROM tuples)"""

_ENTITIES = r"""
a AS (SELECT doc_id, regexp_extract_all(text, '(?:\b(?:in|from|near) )?\b[A-Z][a-z]+(?: [A-Z][a-z]+)*') AS p, regexp_extract_all(text, '\b(?:1[0-9]{3}|20[0-9]{2})\b') AS y FROM documents),
p AS (SELECT doc_id, unnest(p) AS context, generate_subscripts(p, 1) AS pos, NULL AS kind FROM a UNION ALL SELECT doc_id, unnest(y), generate_subscripts(y, 1), 'date' FROM a),
n AS (SELECT doc_id, context, pos, regexp_replace(context, '^(in|from|near) ', '') AS name, kind FROM p),
k AS (SELECT doc_id, context, pos, name, CASE WHEN kind = 'date' THEN kind WHEN context <> name THEN 'location' WHEN list_contains(['Inc', 'Ltd', 'Company', 'University', 'Institute', 'Bank', 'Party', 'Press', 'Foundation', 'Office'], string_split(name, ' ')[-1]) THEN 'organization' ELSE 'person' END AS kind FROM n),
found AS (SELECT sha256(kind || '|' || lower(name)) AS entity_id, kind, name, arg_min(context, pos) AS context, doc_id::VARCHAR AS doc_id FROM k GROUP BY kind, name, doc_id)"""

SQL |= {
    "wiki_tables": f"""SELECT page_id::VARCHAR AS page_id, t.pos::BIGINT AS pos, {_title("url")} || '_table_' || t.pos AS title,
CASE t.pos WHEN 0 THEN '0,1' || chr(10) || 'k,"v, w"' || chr(10) || page_id || ',' || chr(10) WHEN 1 THEN '0,1,2' || chr(10) || 'a,b,c' || chr(10) || page_id || ',,' || chr(10) || ',\"\"\"q\"\"\",' || chr(10) ELSE '0' || chr(10) || 'x' || page_id || chr(10) || page_id || chr(10) END AS csv
FROM pages, (VALUES (0), (1), (2)) t(pos)""",
    "page_nodes": f"""WITH p AS (SELECT page_id::VARCHAR AS page_id, {_title("url")} AS t, {_trim("regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', ' ', 'g'), '(?s)<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g')")} AS intro FROM pages)
SELECT sha256(page_id || '|page|0') AS node_id, page_id, 'page' AS type, t AS title, NULL AS parent_id, NULL AS prev_id, NULL AS next_id FROM p
UNION ALL SELECT sha256(page_id || '|intro|0'), page_id, 'section', t || '_intro', sha256(page_id || '|page|0'), NULL, NULL FROM p WHERE intro <> ''
UNION ALL SELECT sha256(page_id || '|table|0'), page_id, 'table', t || '_table_0', sha256(page_id || '|page|0'), NULL, NULL FROM p""",
    "extractive_summary": f"WITH {_SENTENCES} SELECT doc_id::VARCHAR AS parent_id, source || '_summary' AS title, array_to_string(l[:6], ' ') AS text FROM s WHERE len(l) > 0",
    "key_takeaways": f"""WITH {_SENTENCES},
u AS (SELECT doc_id, source, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(x) DESC, i) AS n FROM u)
SELECT doc_id::VARCHAR AS parent_id, source || '_takeaways' AS title, string_agg('- ' || x, chr(10) ORDER BY i) AS text FROM r WHERE n <= 3 GROUP BY doc_id, source""",
    "entities_rule": r"""WITH w AS (SELECT doc_id, source, regexp_replace(text, '[\pL\pN_]*(?:[^\PL\x00-\x7f]|[^\PN\x00-\x7f])[\pL\pN_]*', 'x', 'g') AS t FROM documents),
f AS (SELECT doc_id, source, list_concat(regexp_extract_all(t, '\b[A-Z][a-z]+(?: [A-Z][a-z]+)*\b'), regexp_extract_all(t, '\b(?:1[0-9]{3}|20[0-9]{2})\b')) AS l FROM w)
SELECT doc_id::VARCHAR AS parent_id, source || '_entities' AS title, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ', ') AS text FROM f WHERE len(l) > 0""",
    "string_parts": rf"""SELECT page_id, regexp_replace(string_split(url, '/')[-1], '\.[^.]*$', '') AS name, url || '"' || chr(10) AS unquoted, page_id::VARCHAR AS number, page_id::VARCHAR AS ref_no,
CASE WHEN page_id % 3 > 1 THEN 'archive-' || (page_id + 1) ELSE 'archive' END AS suffix, {_title("url")} AS title FROM pages""",
    "base64_texts": "SELECT doc_id, base64(encode(text)) AS coded, true AS same FROM documents",
    "page_fetch": f"""WITH {_MARKED},
names AS (SELECT doc_id, string_agg('Part ' || i, '|' ORDER BY i) AS sections FROM lines WHERE i % 4 = 1 GROUP BY 1)
SELECT d.doc_id::VARCHAR AS page_id, 'Page: ' || d.doc_id AS title, {_trim("string_split_regex(c.content, '(==[^=].*?==)|(===.*?===)')[1]")} AS intro, CASE WHEN d.doc_id % 3 = 0 THEN d.lang || '|' || d.source ELSE '' END AS categories,
coalesce(n.sections, '') AS sections, '' AS html, 0 AS images, CAST(length(c.content) AS INTEGER) AS size FROM documents d JOIN content c USING (doc_id) LEFT JOIN names n USING (doc_id)""",
    "page_lookup": f"WITH {_MARKED} SELECT doc_id::VARCHAR AS page_id, content FROM content WHERE doc_id = 7",
    "section_content": f"WITH {_SECTIONS} SELECT d.doc_id::VARCHAR AS page_id, coalesce(h.body, '') AS body FROM documents d LEFT JOIN heads h ON h.doc_id = d.doc_id AND h.title = 'Part 5'",
    "section_nodes": f"""WITH {_SECTIONS}
SELECT s.doc_id::VARCHAR AS page_id, node_id, CASE WHEN sub = 0 THEN 'section' ELSE 'subsection' END AS type, replace(title, ' ', '-') AS title, CASE WHEN sub > 0 THEN 'Part-' || ((no - 1) * 4 + 1) END AS parent_section,
CASE WHEN s.doc_id % 2 = 0 THEN d.source ELSE '' END AS context, body AS text, CASE WHEN sub = 0 THEN page_node ELSE top_id END AS parent_id, page_node AS source_id,
lag(node_id) OVER w AS prev_id, lead(node_id) OVER w AS next_id FROM secs s JOIN documents d USING (doc_id) WINDOW w AS (PARTITION BY s.doc_id, CASE WHEN sub = 0 THEN 0 ELSE no END ORDER BY no, sub)""",
    "section_map": f"WITH {_SECTIONS} SELECT doc_id::VARCHAR AS page_id, title AS section, top_id AS parent_id FROM secs",
    "page_documents": """SELECT doc_id::VARCHAR AS page_id, sha256(doc_id || '|page|0') AS node_id, 'document' AS kind, 'page' AS type, 'Page- ' AS t, 'Page-' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS summary,
CASE WHEN doc_id % 3 = 0 THEN lang || '|' || source ELSE '' END AS categories FROM documents""".replace("'Page- ' AS t, ", ""),
    "in_text_references": "SELECT conv_id // 5 AS page_id, 'Part ' || conv_id % 3 AS section, '[' || conv_id || ']' AS text, '/page#cite_note-' || conv_id AS url FROM conversations WHERE turn = 0 AND conv_id % 2 = 1",
    "cite_notes": "SELECT conv_id // 5 AS page_id, 'Part ' || conv_id % 3 AS section, conv_id::VARCHAR AS ref_no FROM conversations WHERE turn = 0 AND conv_id % 2 = 1",
    "all_citations": f"WITH {_CITED} SELECT page_id, section, ref_no, title, link, archived FROM cited",
    "citations_by_section": f"WITH {_CITED} SELECT page_id, section, string_agg(link, '|' ORDER BY conv_id) AS urls, string_agg(replace(archived, '|', ','), '|' ORDER BY conv_id) AS archives FROM cited GROUP BY 1, 2",
    "citation_nodes": f"""WITH {_CITED},
parts AS (SELECT page_id, section, section_pos, 0 AS a, conv_id, 0 AS k, title, link AS url, 'citation' AS type FROM cited
          UNION ALL SELECT page_id, section, section_pos, 1, conv_id, k - 1, title || '-' || CASE WHEN n > 1 THEN 'archive-' || k ELSE 'archive' END, u, 'archive-citation'
          FROM (SELECT *, len(string_split(archived, '|')) AS n, unnest(string_split(archived, '|')) AS u, generate_subscripts(string_split(archived, '|'), 1) AS k FROM cited WHERE archived <> ''))
SELECT page_id::VARCHAR AS page_id, type, CASE WHEN type = 'citation' THEN {_title("regexp_replace(title, '^\x22+|\x22+$', '', 'g')")} ELSE {_title("regexp_replace(regexp_replace(title, '-archive(-[0-9]+)?$', ''), '^\x22+|\x22+$', '', 'g')")} || regexp_extract(title, '-archive(-[0-9]+)?$') END AS title,
url AS text, replace(section, ' ', '-') AS parent_section, CASE WHEN type = 'citation' THEN 'about' END AS context, row_number() OVER (PARTITION BY page_id ORDER BY section_pos, a, conv_id, k) - 1 AS pos,
CASE section WHEN 'Part 0' THEN sha256(page_id || '|section|1.0') WHEN 'Part 1' THEN sha256(page_id || '|section|1.0') WHEN 'Part 2' THEN sha256(page_id || '|section|2.0') END AS parent_id, sha256(page_id || '|page|0') AS source_id FROM parts""",
    "image_counts": "SELECT count(*) FILTER (label = 9) AS images, count(*) FILTER (label = 8) AS plots FROM embeddings",
    "usable_answers": """SELECT conv_id, turn, turn NOT IN (1, 2, 3) AND text <> '' AS of_text, turn NOT IN (1, 2, 3, 4) AND text <> '' AND NOT contains(lower(text), 'error: unable') AS of_image FROM conversations""",
    "embedded_nodes": f"""WITH t AS (SELECT vec_id, {_TYPES}[label + 1] AS type FROM embeddings)
SELECT vec_id::VARCHAR AS node_id, type, type NOT IN ('image', 'table_analysis', 'page') AND vec_id % 3 <> 0 AS embedded,
CASE WHEN type NOT IN ('image', 'table_analysis', 'page') AND vec_id % 3 <> 0 THEN array_to_string(list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: length('text ' || type) - length(replace('text ' || type, c, ''))), ',') END AS vector FROM t""",
    "node_lookup": """WITH k AS (SELECT DISTINCT (vec_id // 4) || '-' || (vec_id % 2) AS node_id FROM embeddings)
SELECT node_id, CASE WHEN turn = 0 THEN ['section', 'image', 'page'][conv_id % 3 + 1] ELSE 'chunk' END AS type, CASE WHEN turn = 0 AND conv_id % 3 = 1 THEN 'image' ELSE 'text' END AS kind
FROM k JOIN conversations c ON c.conv_id || '-' || c.turn = k.node_id""",
    "run_queries": f"WITH {_SEARCH.format(which='vec_id < 3')} SELECT query_id, vec_id, modality, round(score, 9) AS score FROM h",
    "fusion_retrieve": f"WITH {_PARENTS} SELECT node_id, type, kind FROM par",
}

_WIKI_LINKS = SQL["page_links"]
SQL["wiki_ref_nodes"] = f"""WITH w AS ({_WIKI_LINKS}), n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos, url) - 1 AS n FROM w)
SELECT page_id::VARCHAR AS page_id, sha256(page_id || '|wiki-ref|' || n) AS node_id, 'wiki-ref' AS type, {_title("text")} AS title, url AS text, 'Body' AS parent_section, n AS pos FROM n"""

_IMAGES = """
i AS (SELECT page_id, 0 AS pos, CASE WHEN page_id % 3 = 0 THEN 'sales_chart-' || page_id ELSE 'photo-' || page_id END AS title, CASE WHEN page_id % 3 = 0 THEN 'plot' ELSE 'image' END AS type FROM pages
      UNION ALL SELECT page_id, 1, 'map-' || page_id, 'image' FROM pages WHERE page_id % 2 = 1),
n AS (SELECT *, sha256(page_id || '|image|' || pos) AS node_id, sha256(page_id || '|page|0') AS page_node FROM i)"""

_STORED = """
t AS (SELECT conv_id, turn, conv_id || '-' || turn AS node_id, CASE WHEN turn % 3 = 2 THEN 'image' ELSE 'text' END AS kind, conv_id % 4 = 0 AS again FROM conversations),
kept AS (SELECT * FROM t WHERE NOT again OR turn < 3),
vecs AS (SELECT node_id, 'wiki_' || kind AS collection, kind AS modality, round(sqrt(turn * turn + conv_id * conv_id::DOUBLE), 6) AS norm FROM kept WHERE NOT again)"""

SQL |= {
    "table_analysis": f"""SELECT page_id::VARCHAR AS page_id, {_title("url")} || '_table_0_analysis' AS title, 'A table of 2 rows' AS text, 'table_analysis' AS type FROM pages""",
    "image_gates": "SELECT page_id, CASE WHEN page_id % 7 > 0 THEN page_id % 97 + 1 < 50 OR page_id % 89 + 1 < 50 END AS too_small FROM pages",
    "image_nodes": f"""WITH {_IMAGES} SELECT page_id::VARCHAR AS page_id, node_id, 'image' AS kind, type, title, 'P-' || page_id AS source_page, 'about' AS context, 'http://i/' || page_id AS image_url, page_node AS parent_id,
lag(node_id) OVER w AS prev_id, lead(node_id) OVER w AS next_id FROM n WINDOW w AS (PARTITION BY page_id ORDER BY pos)""",
    "image_stages": f"""WITH {_IMAGES}, s AS (SELECT n.*, k.stage FROM n JOIN (VALUES ('image_description', 'image'), ('image_description', 'plot'), ('image_entities', 'image'), ('plot_insights', 'plot')) k(stage, of) ON k.of = n.type)
SELECT page_id::VARCHAR AS page_id, stage AS type, title || '_' || stage AS title, replace(stage, '_', ' ') || ': ' || regexp_replace(title, '[-_]+', ' ', 'g') AS text, 'about' AS context, node_id AS parent_id, page_node AS source_id, true AS needs_embedding FROM s""",
    "latest_pages": "SELECT conv_id AS page_id, text AS content, role AS title FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "stored_nodes": f"WITH {_STORED} SELECT node_id, conv_id::VARCHAR AS page_id, kind, CASE WHEN turn > 0 THEN conv_id || '-0' END AS parent_id FROM kept",
    "stored_edges": f"WITH {_STORED} SELECT conv_id || '-0' AS src_id, node_id AS dst_id, 'PARENT' AS rel FROM kept k WHERE turn > 0 AND EXISTS (SELECT 1 FROM kept z WHERE z.conv_id = k.conv_id AND z.turn = 0)",
    "stored_vectors": f"WITH {_STORED} SELECT * FROM vecs",
    "stored_node": f"""WITH {_STORED} SELECT node_id FROM kept WHERE node_id = '5-1' UNION ALL (SELECT node_id FROM vecs WHERE collection = 'wiki_image' ORDER BY node_id LIMIT 10) UNION ALL SELECT DISTINCT collection FROM vecs""",
    "indexed_knn": f"WITH {_HITS} SELECT query_id, vec_id, modality, round(score, 9) AS score FROM h",
    "probed_recall": "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0",
    "ranked_search": _ranked("SELECT 0 AS query_id, 'The licensed copy of a notice, without warranty' AS text") + "SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 9) DESC, doc_id LIMIT 20",
    "ranked_search_all": _ranked("SELECT item_id AS query_id, text FROM benchmark") + "SELECT query_id AS item_id, doc_id, round(score, 6) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 5",
    "title_suggestions": """WITH q AS (SELECT page_id, substr(url, 1, length(url) - 3) || substr(url, length(url) - 1, 2) AS c FROM pages),
m AS (SELECT page_id, lower(substr(c, 1, 12) || substr(c, 12)) AS text FROM q),
e AS (SELECT page_id, t.url, CAST(levenshtein(m.text, lower(t.url)) AS INTEGER) AS edits FROM m, (SELECT DISTINCT url FROM pages) t WHERE abs(length(m.text) - length(t.url)) <= 2)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY edits, url) AS INTEGER) AS rank, url, edits FROM e WHERE edits <= 2 QUALIFY rank <= 3""",
    "entity_mentions": f"WITH {_ENTITIES} SELECT entity_id, kind, name, context, doc_id FROM found",
    "entity_table": f"WITH {_ENTITIES} SELECT entity_id, kind, name, count(*) AS sections FROM found GROUP BY 1, 2, 3",
    "scrolled_vectors": f"WITH {_STORED} SELECT node_id, modality FROM vecs WHERE collection = 'wiki_text' ORDER BY node_id LIMIT 20 OFFSET 10",
}
