"""SQL that checks the subpackage's queries, where SQL can express them."""

_PASSAGES = """WITH w AS (SELECT doc_id, i - 1 AS pos, md5(substr(text, i, 200)) AS h
  FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
s AS (SELECT h, min(doc_id) AS lo FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT doc_id, pos, false AS removable FROM w JOIN s USING (h) UNION ALL SELECT doc_id, pos, true FROM w JOIN s USING (h) WHERE lo < doc_id),
f AS (SELECT *, pos > coalesce(lag(pos) OVER (PARTITION BY doc_id, removable ORDER BY pos) + 200, -1) AS fresh FROM m),
g AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY doc_id, removable ORDER BY pos) AS n FROM f),
p AS (SELECT doc_id, removable, min(pos)::INTEGER AS "start", (max(pos) + 200)::INTEGER AS "end" FROM g GROUP BY doc_id, removable, n)
"""

SQL: dict[str, str] = {
    "p2_found": """WITH ok AS (SELECT dest_vert FROM edge WHERE dest_vert BETWEEN 0 AND 4294967294)
SELECT dest_vert FROM ok GROUP BY dest_vert HAVING count(*) * 400 >= (SELECT count(*) FROM ok)""",
    "p3_found": """WITH RECURSIVE ends AS (
  SELECT CASE WHEN src_vert BETWEEN 0 AND 4294967294 THEN src_vert END AS a, CASE WHEN dest_vert BETWEEN 0 AND 4294967294 THEN dest_vert END AS b FROM tmp_in_edge
  UNION SELECT CASE WHEN id BETWEEN 0 AND 4294967294 THEN id END, CASE WHEN component_root BETWEEN 0 AND 4294967294 THEN component_root END FROM cc_vert_attr),
verts AS (SELECT a AS v FROM ends WHERE a IS NOT NULL UNION SELECT b FROM ends WHERE b IS NOT NULL),
sym AS (SELECT a, b FROM ends WHERE a <> b UNION SELECT b, a FROM ends WHERE a <> b),
t(i, v, c) AS (SELECT 0, v, v FROM verts
  UNION ALL SELECT i + 1, v, min(c) FROM (SELECT i, v, c FROM t UNION ALL SELECT t.i, sym.b, t.c FROM t JOIN sym ON sym.a = t.v) WHERE i < 60 GROUP BY i, v)
SELECT c AS component_root, v AS vert FROM t WHERE i = 60""",
    "p8_found": """WITH w AS (SELECT DISTINCT doc_id, md5(substr(text, i, 200)) AS h
  FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
s AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1), m AS (SELECT doc_id, h FROM w SEMI JOIN s USING (h))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM m a JOIN m b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p2_checks": "SELECT least(100, count(DISTINCT dest_vert)) AS \"values\", 0::BIGINT AS too_low, 0::BIGINT AS too_high FROM edge WHERE dest_vert BETWEEN 0 AND 4294967294",
    "p6_checks": """SELECT container, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS broken, 0::BIGINT AS uneven FROM pack_size""",
    "p7_checks": """SELECT 0::BIGINT AS over_used, 0::BIGINT AS untargeted, 0::BIGINT AS repeated, count(DISTINCT (source, lower(coalesce(lang, 'und')))) AS leaves,
  0::BIGINT AS off_budget, 0::BIGINT AS over_supply FROM documents JOIN mix_target USING (source) WHERE text <> '' AND max_repeats > 0 AND target_share > 0""",
    "p8_passages": _PASSAGES + """SELECT doc_id, "start", "end", removable FROM p""",
    "p8_report": _PASSAGES + """, t AS (SELECT doc_id, count(*) FILTER (NOT removable) AS n, sum("end" - "start") FILTER (NOT removable) AS c, sum("end" - "start") FILTER (removable) AS r FROM p GROUP BY doc_id)
SELECT d.doc_id, coalesce(length(text), 0)::BIGINT AS chars, coalesce(n, 0)::BIGINT AS passages, coalesce(c, 0)::BIGINT AS shared_chars, coalesce(r, 0)::BIGINT AS removable_chars,
  CASE WHEN length(text) > 0 THEN coalesce(c, 0) / length(text) ELSE 0 END::DOUBLE AS shared_share FROM documents d LEFT JOIN t USING (doc_id)""",
    "p8_lines": """WITH l AS (SELECT doc_id, n, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1 AS "start" FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)),
u AS (SELECT doc_id, "start"::BIGINT AS "start", ("start" + length(line))::BIGINT AS "end", trim(regexp_replace(line, '[ \\t\\r\\f]+', ' ', 'g'), ' ') AS unit FROM l),
f AS (SELECT unit, min({'d': doc_id, 's': "start"}) AS first FROM u WHERE length(unit) >= 40 GROUP BY unit HAVING count(*) > 1)
SELECT doc_id, "start", "end", first.d AS first_doc, first.s AS first_start FROM u JOIN f USING (unit) WHERE doc_id <> first.d OR "start" <> first.s""",
}
