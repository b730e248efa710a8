"""The same results in plain SQL, where SQL can express them; for the small test tables."""

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_NO_SUBJECT = "'na','none','null','unknown','nil','tbd','untitled','misc',''"
_PLAIN = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_NAME = r"regexp_replace(trim(doc_id), '^.*/', '')"
_STEM = rf"regexp_replace({_NAME}, '(\.[A-Za-z]{{2,5}}|\s*\(\d+\)|[ _.-]+v\d+|[ _-]+copy)+\s*$', '')"
_NOBODY = "anon|anonymous|author|authors|course|department|editor|editors|faculty|na|nobody|none|null|staff|team|unknown|various"

_P1 = rf"""
WITH RECURSIVE base AS (
  SELECT spec_id, {_PLAIN.format('subject')} AS s, {_PLAIN.format(f"regexp_replace({_STEM}, '[^a-zA-Z0-9]+[0-9]+$', '')")} AS f,
    regexp_replace(lower(trim(author)), '[.\s]+', ' ', 'g') AS a FROM doc_specs WHERE spec_id IS NOT NULL),
named AS (
  SELECT *, list_filter(string_split_regex(replace(a, ',', ' '), '\s+'), lambda x: x <> '') AS p FROM base),
keyed AS (
  SELECT spec_id, CASE WHEN s NOT IN ({_NO_SUBJECT}) THEN 's:' || s END AS s, CASE WHEN f NOT IN ({_NO_SUBJECT}) THEN 's:' || f END AS f,
    CASE WHEN len(p) < 2 OR regexp_matches(' ' || array_to_string(p, ' ') || ' ', ' ({_NOBODY}) ') THEN NULL
         WHEN a LIKE '%,%' THEN 'a:' || {_PLAIN.format("split_part(a, ',', 1)")} || '|' || left(trim(split_part(a, ',', 2)), 1)
         WHEN length(p[len(p)]) = 1 THEN 'a:' || {_PLAIN.format("array_to_string(p[1:len(p)-1], ' ')")} || '|' || p[len(p)]
         ELSE 'a:' || {_PLAIN.format("array_to_string(p[2:len(p)], ' ')")} || '|' || left(p[1], 1) END AS w FROM named),
node AS (SELECT spec_id, unnest([s, f, w]) AS k FROM keyed),
edge AS (SELECT DISTINCT x.k AS u, y.k AS v FROM node x JOIN node y USING (spec_id) WHERE x.k IS NOT NULL AND y.k IS NOT NULL),
reach AS (SELECT u, v FROM edge UNION SELECT r.u, e.v FROM reach r JOIN edge e ON r.v = e.u),
label AS (SELECT u AS k, min(v) FILTER (WHERE v LIKE 's:%') AS name FROM reach GROUP BY u)
SELECT n.spec_id, coalesce(substr(min(l.name), 3), 'record' || n.spec_id) AS group_key FROM node n LEFT JOIN label l ON n.k = l.k GROUP BY n.spec_id
"""

_EN = "'although','and','are','at','because','been','but','by','each','for','from','had','has','have','he','how','into','is','it','its','more','most','neither','nor','not','of','on','only','or','over','she','that','the','their','then','there','these','they','this','those','through','to','under','were','what','when','where','which','while','who','why','with','without'"
_DE = "'aber','auf','aus','bei','bleibt','dann','das','dass','dem','den','der','des','die','durch','ein','eine','einen','einer','für','ist','mit','nach','nicht','noch','oder','sich','und','vom','von','weil','wenn','wie','wird','zu','zum','zur'"
_FR = "'alors','aussi','avec','bien','car','ce','ces','cette','dans','du','elle','et','le','les','leur','montre','ne','ou','par','pas','pour','quand','que','sur','une'"
_ES = "'como','con','cuando','el','los','las','por','para','pero','porque','sin','su','también','una','más','ya','muy','lo','y'"

_P3 = rf"""
WITH page AS (
  SELECT document_id, page_number, regexp_replace(coalesce(max(text), ''), '(\p{{L}})[-¬­‐]\s*\n\s*(\p{{Ll}})', '\1\2', 'g') AS t
  FROM document_pages WHERE document_id IS NOT NULL GROUP BY ALL),
part AS (
  SELECT document_id, len(list_filter(string_split(regexp_replace(t, '[.!?]+(\s|$)', chr(30), 'g'), chr(30)), lambda s: regexp_matches(s, '\p{{L}}{{2}}'))) AS s,
    regexp_extract_all(lower(t), '\p{{L}}+') AS w FROM page),
sent AS (SELECT document_id, sum(s) AS s FROM part GROUP BY 1),
word AS (SELECT document_id, unnest(w) AS w FROM part),
doc AS (
  SELECT document_id, count(*) AS n, sum(greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN w LIKE '%e' AND NOT regexp_matches(w, '(le|ee|ye)$') AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END)) AS syl,
    count(*) FILTER (WHERE w IN ({_EN})) AS en, count(*) FILTER (WHERE w IN ({_DE})) AS de, count(*) FILTER (WHERE w IN ({_FR})) AS fr, count(*) FILTER (WHERE w IN ({_ES})) AS es
  FROM word GROUP BY 1),
grade AS (SELECT document_id, 0.39 * n / greatest(s, 1) + 11.8 * syl / n - 15.59 AS g FROM doc JOIN sent USING (document_id) WHERE n >= 100 AND en > greatest(de, fr, es))
SELECT document_id, CASE WHEN g < 6 THEN 'elementary' WHEN g <= 12 THEN 'secondary' ELSE 'university' END AS level FROM grade
"""

_P5 = rf"""
WITH page AS (SELECT document_id, page_number, coalesce(max(text), '') AS t FROM document_pages WHERE document_id IS NOT NULL GROUP BY ALL),
doc AS (SELECT document_id, string_agg(t, chr(10) ORDER BY page_number) AS t FROM page GROUP BY 1),
word AS (SELECT document_id, {_WORDS.format('t')} AS w FROM doc),
gram AS (SELECT DISTINCT document_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM word WHERE len(w) >= 60),
size AS (SELECT document_id, count(*) AS n FROM gram GROUP BY 1),
shared AS (SELECT x.document_id AS a, y.document_id AS b, count(*) AS c FROM gram x JOIN gram y ON x.g = y.g AND x.document_id < y.document_id GROUP BY ALL)
SELECT a AS document_id_a, b AS document_id_b FROM shared JOIN size p ON a = p.document_id JOIN size q ON b = q.document_id WHERE c > 0.5 * (p.n + q.n - c)
"""

_P8 = rf"""
WITH doc AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE doc_id IS NOT NULL),
item AS (SELECT item_id, {_WORDS.format('max(text)')} AS w FROM eval_items WHERE item_id IS NOT NULL GROUP BY item_id),
gram AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM item),
held AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM doc WHERE len(w) >= 12)
SELECT DISTINCT item_id, doc_id FROM gram JOIN held USING (g)
"""

_P5_GROUPS = f"""
WITH RECURSIVE p5 AS ({_P5}), both_ AS (SELECT document_id_a AS a, document_id_b AS b FROM p5 UNION ALL SELECT document_id_b, document_id_a FROM p5),
page AS (SELECT document_id, page_number, coalesce(max(text), '') AS t FROM document_pages WHERE document_id IS NOT NULL GROUP BY ALL),
doc AS (SELECT document_id, string_agg(t, chr(10) ORDER BY page_number) AS t FROM page GROUP BY 1),
own AS (SELECT document_id FROM doc WHERE len({_WORDS.format('t')}) >= 60),
reach AS (SELECT document_id AS d, document_id AS r FROM own UNION SELECT d, b FROM reach JOIN both_ ON r = a)
SELECT d AS document_id, min(r) AS group_id, (SELECT count(*) FROM both_ WHERE a = d) AS links FROM reach GROUP BY d
"""

ORACLES: dict[str, str] = {
    "p5_groups": _P5_GROUPS,
    "p1_found": _P1,
    "p3_found": _P3,
    "p5_found": _P5,
    "p6_found": r"SELECT DISTINCT id FROM chunks WHERE id IS NOT NULL AND len(regexp_extract_all(coalesce(text, ''), '[^\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}\x{85}\x{1c}-\x{1f}]+')) > 350",
    "p8_found": _P8,
}
