"""The core queries in plain SQL, written from what the operators mean; regular expressions without look-around."""

from lectern.functions import text as T
from lectern.plans.fixtures import FIXTURES

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_DOC = "doc AS (SELECT doc_id, max(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)"
_TOKEN = r"regexp_extract_all(coalesce({0}, ''), '[A-Za-z][A-Za-z''\-]*|\d+(?:\.\d+)?')"
_SENT = r"list_filter(list_transform(string_split(regexp_replace(coalesce({0}, ''), '([.!?])\s+([A-Z0-9\"''(])', '\1' || chr(30) || '\2', 'g'), chr(30)), lambda x: trim(x, ' ')), lambda x: x <> '')"
_SYL = r"CASE WHEN trim({0}, '''') = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(trim({0}, ''''), '[aeiouy]+')) - CASE WHEN trim({0}, '''') LIKE '%e' AND NOT regexp_matches(trim({0}, ''''), '(le|ee|ye)$') AND len(regexp_extract_all(trim({0}, ''''), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END"
_CONTENT = rf"list_filter(list_transform({_TOKEN}, lambda x: lower(x)), lambda x: x NOT IN ({_STOP}) AND length(x) > 2)"
_PARTS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '\s+'), lambda x: x <> '')"

_SEGMENT = """seg AS (
  SELECT segment_id, any_value(spec_id) AS spec_id, any_value(order_index) AS order_index, coalesce(max(text), '') AS text, any_value(page) AS page, any_value(x0) AS x0, any_value(y0) AS y0,
    any_value(font_size) AS font_size, any_value(is_bold) AS is_bold, any_value(is_italic) AS is_italic, any_value(line_count) AS line_count, any_value(gap_before) AS gap_before,
    any_value(source) AS source, any_value(label) AS label
  FROM segments WHERE segment_id IS NOT NULL AND spec_id IS NOT NULL GROUP BY segment_id)"""

_TREE = f"""{_SEGMENT},
one AS (SELECT *, coalesce(label, 'PARAGRAPH') AS lab, row_number() OVER f AS i, count(*) FILTER (WHERE label = 'TITLE') OVER f AS titles FROM seg WINDOW f AS (PARTITION BY spec_id ORDER BY order_index, segment_id)),
kind AS (SELECT *, lab = 'TITLE' AND titles = 1 AS is_title, lab = 'HEADING' OR (lab = 'TITLE' AND titles > 1) AS top, lab = 'SUBHEADING' AS sub FROM one),
place AS (SELECT *, max(CASE WHEN top THEN i END) OVER f AS at1, max(CASE WHEN sub THEN i END) OVER f AS at2, count(*) FILTER (WHERE top OR sub) OVER f AS section_seq FROM kind WINDOW f AS (PARTITION BY spec_id ORDER BY i)),
tree AS (
  SELECT p.*, coalesce(t.text, '') AS title, a.text AS h1, CASE WHEN p.at2 > coalesce(p.at1, 0) THEN b.text END AS h2 FROM place p
  LEFT JOIN kind t ON t.spec_id = p.spec_id AND t.is_title LEFT JOIN kind a ON a.spec_id = p.spec_id AND a.i = p.at1 LEFT JOIN kind b ON b.spec_id = p.spec_id AND b.i = p.at2
  WHERE NOT p.is_title AND NOT p.top AND NOT p.sub)"""

_FEATURES = f"""{_SEGMENT},
size AS (SELECT spec_id, median(font_size) AS md, max(font_size) AS mx, count(*) AS n FROM seg GROUP BY spec_id),
base AS (SELECT s.*, md, mx, n, row_number() OVER f - 1 AS i, regexp_replace(text, '\\s+$', '') AS e, regexp_replace(text, '\\s+', '', 'g') AS bare, regexp_replace(text, '[^\\p{{L}}]+', '', 'g') AS letters,
    {_PARTS.format('text')} AS parts FROM seg s JOIN size USING (spec_id) WINDOW f AS (PARTITION BY spec_id ORDER BY order_index, segment_id)),
feat AS (SELECT *, CASE WHEN coalesce(md, 0) = 0 THEN 11.0 ELSE md END AS m, coalesce(font_size, 0.0) AS fs, list_filter(parts, lambda w: regexp_matches(w, '^\\p{{L}}')) AS named FROM base)"""

_FLAG = "CASE WHEN {0} THEN 1.0 ELSE 0.0 END"


def _cue(pattern: str, fold: bool = True) -> str:
    return _FLAG.format(f"regexp_matches(text, '{'(?i)' if fold else ''}{pattern}')")


_FEATURE_LIST = f"""
  round(fs / m, 6) AS font_ratio, {_FLAG.format('is_bold')} AS is_bold, {_FLAG.format('is_italic')} AS is_italic,
  round(CASE WHEN length(letters) > 0 THEN (length(letters) - length(regexp_replace(letters, '\\p{{Lu}}', '', 'g'))) / length(letters) ELSE 0.0 END, 6) AS caps_ratio,
  round(CASE WHEN len(named) > 0 THEN len(list_filter(named, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) / len(named) ELSE 0.0 END, 6) AS title_case_ratio,
  round(ln(1 + len(parts)), 6) AS n_tokens_log, CAST(least(coalesce(line_count, 0), 10) AS DOUBLE) AS line_count,
  {_FLAG.format("e LIKE '%:'")} AS ends_colon, {_FLAG.format("e LIKE '%?'")} AS ends_question, {_FLAG.format("e LIKE '%.'")} AS ends_period,
  {_cue('^\\s*[•●▪◦\\-–*]\\s+', False)} AS starts_bullet, {_cue('^\\s*\\(?\\d{1,3}[.)]\\s+', False)} AS starts_number, {_cue('^\\s*\\d{1,3}\\.\\d{1,3}(\\.\\d{1,3})?\\.?\\s+', False)} AS starts_subnumber,
  {_cue('^\\s*(q\\s*\\d+|question\\s*\\d*)\\s*[.:)]')} AS starts_qprefix, {_cue('^\\s*(ans(wer)?|solution|sol)\\s*[.:)\\-]')} AS starts_aprefix,
  {_cue('\\b(is defined as|refers to|is called|is known as|means that|definition)\\b')} AS def_pattern, {_cue('^\\s*(e\\.g\\.|example|for example|for instance|consider|illustration)\\b')} AS ex_pattern,
  {_cue('\\b(step\\s*\\d+|first,|then,|next,|finally,|procedure|method:)')} AS proc_pattern, {_cue('^\\s*(important|note|remember|key point|caution|warning|tip)\\b')} AS imp_pattern,
  {_cue('^\\s*(in conclusion|to conclude|in summary|to summari[sz]e|overall|thus,|therefore,|conclusion)\\b')} AS conc_pattern,
  {_cue('^\\s*(explain|describe|discuss|define|compare|what|why|how|which|state|list|calculate|derive|name)\\b')} AS imperative_q,
  round(CASE WHEN length(bare) > 0 THEN (length(bare) - length(regexp_replace(bare, '\\p{{Nd}}', '', 'g'))) / length(bare) ELSE 0.0 END, 6) AS digit_ratio,
  round(CASE WHEN length(bare) > 0 THEN (length(bare) - length(regexp_replace(bare, '[=+−\\-×*/÷^²³√∑Σ∫πθλμσΔ≤≥≈≠<>()\\[\\]{{}}|]', '', 'g'))) / length(bare) ELSE 0.0 END, 6) AS math_ratio,
  {_FLAG.format("len(regexp_extract_all(text, '(?i)(\\[\\d+\\]|\\(\\d{4}\\)|\\b(?:19|20)\\d{2}\\b|et al\\.|doi:|https?://|pp\\.|vol\\.)')) >= 2")} AS ref_pattern,
  round(i / greatest(n - 1, 1), 6) AS rel_position, {_FLAG.format('i = 0')} AS is_first, round(coalesce(y0, 0.0) / 842.0, 6) AS rel_y, round(coalesce(x0, 0.0) / 595.0, 6) AS indent_ratio,
  round(least(coalesce(gap_before, 0.0) / greatest(fs, 1.0), 5.0), 6) AS gap_before_ratio,
  round(coalesce(CASE WHEN lead(page) OVER f = page THEN least(lead(gap_before) OVER f / greatest(fs, 1.0), 5.0) END, 0.0), 6) AS gap_after_ratio,
  round(coalesce(lag(fs) OVER f, 0.0) / m, 6) AS prev_font_ratio, round(coalesce(lead(fs) OVER f, 0.0) / m, 6) AS next_font_ratio,
  {_FLAG.format('lag(is_bold) OVER f')} AS prev_is_bold, {_FLAG.format('lead(is_bold) OVER f')} AS next_is_bold, {_FLAG.format("lag(e) OVER f LIKE '%?'")} AS prev_ends_question,
  {_FLAG.format('fs >= mx AND mx > m * 1.05')} AS is_largest_font, {_FLAG.format("source = 'txt'")} AS is_txt, length(text) AS n_chars"""

_RULE = """CASE WHEN is_first = 1 AND font_ratio >= 1.3 THEN 'TITLE'
  WHEN n_tokens_log < 2.5 AND ends_period = 0 AND (starts_subnumber = 1 OR (font_ratio > 1.05 AND font_ratio < 1.3)) THEN 'SUBHEADING'
  WHEN n_tokens_log < 2.5 AND ends_period = 0 AND (font_ratio >= 1.3 OR is_bold = 1) THEN 'HEADING'
  WHEN ends_question = 1 OR starts_qprefix = 1 THEN 'QUESTION' WHEN ref_pattern = 1 THEN 'REFERENCE'
  WHEN math_ratio > 0.15 AND n_chars < 120 THEN 'FORMULA' WHEN def_pattern = 1 THEN 'DEFINITION' ELSE 'PARAGRAPH' END"""
_RULED = f"{_FEATURES}, full_ AS (SELECT segment_id, spec_id, {_FEATURE_LIST} FROM feat WINDOW f AS (PARTITION BY spec_id ORDER BY order_index, segment_id)), ruled AS (SELECT segment_id, spec_id, {_RULE} AS rule FROM full_)"
_PAIRED = f"{_RULED}, pair AS (SELECT s.label, r.rule AS predicted FROM ruled r JOIN seg s USING (segment_id) WHERE s.label IS NOT NULL)"

_CUE = T.CUE.replace("(?iu)", "(?i)")
_STRIP = f"trim(regexp_replace({{0}}, '{_CUE}', ''), ' ')"

_DEFS = [p.replace("(?iu)", "(?i)") for p in T.DEFINITIONS]


def _definition() -> str:
    """CASE over the patterns: [term, definition] or NULL."""
    out = []
    for p in _DEFS:
        term = rf"regexp_replace(regexp_replace(trim(regexp_extract(t, '{p}', 1)), '(?i)^(the|an|a)\s+', ''), '(?i)^(definition|key term)\s*[:\-–]\s*', '')"
        said = f"trim(regexp_extract(t, '{p}', 2))"
        n = lambda x: f"len({_PARTS.format(x)})"
        out.append(f"WHEN regexp_matches(t, '{p}') AND {n(term)} BETWEEN 1 AND 6 AND {n(said)} >= 3 THEN [upper(left({term}, 1)) || substr({term}, 2), upper(left({said}, 1)) || substr({said}, 2) || '.']")
    return "CASE " + " ".join(out) + " END"


_DEFINED = rf"""{_TREE},
tried AS (SELECT spec_id, order_index, segment_id, page, CASE WHEN lab = 'DEFINITION' THEN [{_STRIP.format('text')}] ELSE {_SENT.format('text')} END AS l FROM tree WHERE lab IN ('DEFINITION', 'PARAGRAPH', 'IMPORTANT_POINT')),
flat AS (SELECT spec_id, order_index, segment_id, page, generate_subscripts(l, 1) - 1 AS pos, regexp_replace(trim(unnest(l)), '\.+$', '') AS t FROM tried),
parsed AS (SELECT spec_id, order_index, segment_id, page, pos, {_definition()} AS d FROM flat),
first_ AS (SELECT *, row_number() OVER (PARTITION BY spec_id, lower(d[1]) ORDER BY order_index, segment_id, pos) AS r FROM parsed WHERE d IS NOT NULL),
defs AS (SELECT spec_id, row_number() OVER (PARTITION BY spec_id ORDER BY order_index, segment_id, pos) - 1 AS ord, d[1] AS term, d[2] AS definition, page FROM first_ WHERE r = 1)"""

_LINES = r"""ln AS (
  SELECT l.document_id, l.page, l.line_no, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(coalesce(max(l.text), ''), '’', ''''), '‘', ''''), '‚', ''''), '“', '"'), '”', '"'), '„', '"'), chr(160), ' '), '[\x00-\x08\x0b-\x1f\x7f-\x{9f}\x{ad}\x{200b}]', '', 'g'), '[ \t]+', ' ', 'g'), ' ') AS text,
    any_value(l.x0) AS x0, any_value(l.y0) AS y0, any_value(l.x1) AS x1, any_value(l.y1) AS y1, any_value(l.height) AS fs, any_value(l.confidence) AS conf, coalesce(any_value(p.h), 842.0) AS h
  FROM ocr_lines l LEFT JOIN (SELECT document_id, page_number, max(height) AS h FROM document_pages GROUP BY ALL) p ON l.document_id = p.document_id AND l.page = p.page_number
  WHERE l.document_id IS NOT NULL GROUP BY ALL)"""
_KEPT = rf"""{_LINES},
band AS (SELECT *, h > 0 AND (y0 / h < 0.08 OR y0 / h > 0.92) AS b, trim(regexp_replace(lower(text), '\d+', '#', 'g')) AS mask FROM ln),
many AS (SELECT x.document_id, x.mask FROM (SELECT document_id, mask, count(DISTINCT page) AS c FROM band WHERE b AND text <> '' GROUP BY ALL) x
  JOIN (SELECT document_id, count(DISTINCT page) AS n FROM ln GROUP BY 1) y USING (document_id) WHERE n >= 3 AND c >= greatest(2, n // 2)),
kept AS (SELECT * FROM band WHERE NOT (b AND regexp_matches(text, '(?i)^\s*(page\s*)?[-–—]?\s*\d{{1,4}}\s*[-–—]?\s*(of\s*\d+)?\s*$')) AND NOT (b AND (document_id, mask) IN (SELECT document_id, mask FROM many)))"""
_LEAD = """(SELECT document_id, coalesce(median(CASE WHEN g > -2 AND g < pf * 2 THEN g END), 2.0) AS lead_gap FROM (
  SELECT document_id, CASE WHEN lag(page) OVER f = page AND lag(text) OVER f <> '' AND text <> '' AND abs(lag(fs) OVER f - fs) < 0.6 THEN y0 - lag(y1) OVER f END AS g, lag(fs) OVER f AS pf
  FROM {0} WINDOW f AS (PARTITION BY document_id ORDER BY page, line_no)) GROUP BY document_id)"""

_TERMS = rf"list_filter(regexp_extract_all(lower(coalesce({{0}}, '')), '[a-z0-9]+'), lambda x: x NOT IN ({_STOP}) AND length(x) > 1)"
_BM25 = rf"""ch AS (SELECT id AS chunk_id, max(document_id) AS document_id, max(text) AS text FROM chunks WHERE id IS NOT NULL GROUP BY id),
qu AS (SELECT item_id AS question_id, max(document_id) AS document_id, max(question) AS question FROM study_items WHERE item_id % 100 = 0 GROUP BY item_id),
cw AS (SELECT chunk_id, document_id, {_TERMS.format('text')} AS w FROM ch),
sz AS (SELECT document_id, count(*) AS n, avg(CAST(len(w) AS DOUBLE)) AS al FROM cw GROUP BY 1),
tf AS (SELECT document_id, chunk_id, len, term, count(*) AS tf FROM (SELECT document_id, chunk_id, len(w) AS len, unnest(w) AS term FROM cw) GROUP BY ALL),
df AS (SELECT document_id, term, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT document_id, term, n, al, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df JOIN sz USING (document_id)),
av AS (SELECT document_id, avg(idf) AS a FROM raw GROUP BY 1),
qt AS (SELECT question_id, document_id, term, count(*) AS k FROM (SELECT question_id, document_id, unnest({_TERMS.format('question')}) AS term FROM qu) GROUP BY ALL),
sc AS (SELECT question_id, chunk_id, round(sum(k * CASE WHEN idf < 0 THEN 0.25 * a ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))), 6) AS bm25
  FROM qt JOIN raw USING (document_id, term) JOIN av USING (document_id) JOIN tf USING (document_id, term) GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY bm25 DESC, chunk_id) AS rank FROM sc WHERE bm25 > 0)"""

_UP = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS r FROM uploaded_documents WHERE id IS NOT NULL) WHERE r = 1)"

ORACLES: dict[str, str] = {
    "doc_stats": rf"""WITH {_DOC}, t AS (SELECT doc_id, coalesce(text, '') AS text, {_TOKEN.format('text')} AS w, len({_SENT.format('text')}) AS s, list_transform({_TOKEN.format('left(text, 20000)')}, lambda x: lower(x)) AS head FROM doc),
      c AS (SELECT doc_id, length(text) AS ch, len(w) AS n, s, len(list_filter(w, lambda x: NOT regexp_matches(x, '^\d'))) AS k, coalesce(list_sum(list_transform(list_filter(w, lambda x: NOT regexp_matches(x, '^\d')), lambda x: {_SYL.format('lower(x)')})), 0) AS y,
        len(head) AS hn, len(list_filter(head, lambda x: x IN ({_STOP}))) AS st FROM t)
      SELECT doc_id, ch AS characters, n AS words, s AS sentences, round(CASE WHEN s > 0 THEN n / s ELSE 0.0 END, 1) AS avg_sentence_length, round(n / 200, 1) AS reading_time_min,
        CASE WHEN hn >= 20 AND st > 0.15 * hn THEN 'en' ELSE 'unknown' END AS language,
        round(CASE WHEN n > 30 AND s > 0 AND k > 0 THEN 206.835 - 1.015 * (k / s) - 84.6 * (y / k) END, 1) AS flesch_reading_ease, round(CASE WHEN n > 30 AND s > 0 AND k > 0 THEN 0.39 * (k / s) + 11.8 * (y / k) - 15.59 END, 1) AS flesch_kincaid_grade FROM c""",
    "vocabulary_syllables": rf"""WITH {_DOC}, w AS (SELECT lower(unnest({_TOKEN.format('text')})) AS word FROM doc)
      SELECT word, {_SYL.format('word')} AS syllables, count(*) AS n FROM w WHERE NOT regexp_matches(word, '^\d') GROUP BY word""",
    "keyphrases": rf"""WITH {_DOC}, w AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, lower(unnest(l)) AS word FROM (SELECT doc_id, {_TOKEN.format('text')} AS l FROM doc)),
      c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS f FROM w WHERE word NOT IN ({_STOP}) AND length(word) > 3 GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS rank FROM c) SELECT doc_id, rank, word, n FROM r WHERE rank <= 12""",
    "injection_flags": rf"""WITH {_DOC}, p(pattern, re) AS (VALUES (0, 'ignore (all |any )?(the )?(previous|prior|above) (instructions|prompts?)'), (1, 'disregard (the )?(system|previous) (prompt|instructions)'), (2, 'you are now (a|an|the) '),
      (3, 'system prompt'), (4, 'reveal (your|the) (instructions|prompt|api key)'), (5, '<\s*/?\s*(system|assistant|instructions)\s*>'))
      SELECT doc_id, pattern, len(regexp_extract_all(text, '(?i)' || re)) AS n FROM doc, p WHERE len(regexp_extract_all(text, '(?i)' || re)) > 0""",
    "lang_counts": "SELECT lang, count(*) AS n FROM (SELECT doc_id, max(lang) AS lang FROM documents WHERE doc_id IS NOT NULL GROUP BY 1) GROUP BY 1",
    "extraction_summary": """WITH p AS (SELECT document_id, page_number, max(source) AS source, coalesce(max(text), '') AS text FROM document_pages WHERE document_id IS NOT NULL GROUP BY ALL)
      SELECT document_id, count(*) AS pages, coalesce(string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) FILTER (WHERE source = 'ocr'), '') AS ocr_pages, sum(length(text)) AS characters FROM p GROUP BY 1""",
    "text_lines": rf"""WITH {_DOC}, l AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM doc), f AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS s FROM l)
      SELECT doc_id, n // 50 + 1 AS page, n % 50 AS line_no, trim(s, ' ') AS text, 72.0 + 5.0 * (length(s) - length(ltrim(s, ' '))) AS x0, 72.0 + 14.0 * (n % 50) AS y0 FROM f""",
    "furniture_removed": f"WITH {_KEPT} SELECT document_id, page, line_no, text FROM kept",
    "lead_gaps": f"WITH {_LINES} SELECT * FROM {_LEAD.format('ln')}",
    "segment_features": f"WITH {_FEATURES} SELECT segment_id, spec_id, {_FEATURE_LIST} FROM feat WINDOW f AS (PARTITION BY spec_id ORDER BY order_index, segment_id)",
    "rule_labels": f"WITH {_RULED} SELECT * FROM ruled",
    "label_counts": f"WITH {_SEGMENT} SELECT label, count(*) AS n FROM seg GROUP BY 1",
    "classification_report": f"""WITH {_PAIRED}, l(label) AS (VALUES ('TITLE'), ('HEADING'), ('SUBHEADING'), ('PARAGRAPH'), ('DEFINITION'), ('EXAMPLE'), ('PROCEDURE'), ('IMPORTANT_POINT'), ('FORMULA'), ('QUESTION'), ('ANSWER'), ('CONCLUSION'), ('REFERENCE')),
      c AS (SELECT label, (SELECT count(*) FROM pair p WHERE p.label = l.label) AS support, (SELECT count(*) FROM pair p WHERE p.predicted = l.label) AS predicted, (SELECT count(*) FROM pair p WHERE p.label = l.label AND p.predicted = l.label) AS hits FROM l),
      r AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS r FROM c)
      SELECT label, support, predicted, hits, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM r""",
    "confusion_matrix": f"WITH {_PAIRED} SELECT label, predicted, count(*) AS n FROM pair GROUP BY ALL",
    "split_counts": f"""WITH {_SEGMENT}, sp AS (SELECT spec_id, max(lower(trim(split))) AS split FROM doc_specs GROUP BY 1)
      SELECT coalesce(split, 'train') AS split, count(*) AS segments, count(DISTINCT spec_id) AS documents FROM seg LEFT JOIN sp USING (spec_id) GROUP BY 1""",
    "section_tree": f"WITH {_TREE} SELECT segment_id, spec_id, order_index, page, lab AS label, title, h1, h2, section_seq, concat_ws(' > ', h1, h2) AS section_path FROM tree",
    "section_pages": f"""WITH {_TREE},
      t1 AS (SELECT spec_id, 1 AS level, min(section_seq) AS section_seq, max(CASE WHEN top THEN text END) AS heading, list(page) AS l, count(*) FILTER (WHERE NOT is_title AND NOT top AND NOT sub) AS items FROM place WHERE at1 IS NOT NULL GROUP BY spec_id, at1),
      t2 AS (SELECT spec_id, 2 AS level, section_seq, max(CASE WHEN sub THEN text END) AS heading, list(page) AS l, count(*) FILTER (WHERE NOT is_title AND NOT top AND NOT sub) AS items FROM place GROUP BY spec_id, section_seq HAVING bool_or(sub))
      SELECT spec_id, level, section_seq, heading, array_to_string(list_sort(list_distinct(l)), ',') AS pages, items FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2)""",
    "question_answers": f"""WITH {_TREE}, n AS (SELECT *, lead(lab) OVER f AS nl, lead(text) OVER f AS nt, lead(segment_id) OVER f AS ns FROM tree WINDOW f AS (PARTITION BY spec_id, section_seq ORDER BY i))
      SELECT spec_id, segment_id AS question_id, ns AS answer_id, {_STRIP.format('text')} AS question, {_STRIP.format('nt')} AS answer FROM n WHERE lab = 'QUESTION' AND nl = 'ANSWER'""",
    "doc_freq": f"WITH {_TREE} SELECT spec_id, word, count(*) AS df FROM (SELECT spec_id, unnest(list_distinct({_CONTENT.format('text')})) AS word FROM tree) GROUP BY ALL",
    "key_sentences": f"""WITH {_TREE}, df AS (SELECT spec_id, word, count(*) AS df FROM (SELECT spec_id, unnest(list_distinct({_CONTENT.format('text')})) AS word FROM tree) GROUP BY ALL),
      s AS (SELECT spec_id, segment_id, k, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS sentence FROM (SELECT spec_id, segment_id, CASE WHEN len({_PARTS.format('text')}) > 40 THEN 2 ELSE 1 END AS k, {_SENT.format('text')} AS l FROM tree WHERE lab IN ('PARAGRAPH', 'CONCLUSION'))),
      w AS (SELECT spec_id, segment_id, pos, len({_CONTENT.format('sentence')}) AS n, unnest(list_distinct({_CONTENT.format('sentence')})) AS word FROM s),
      c AS (SELECT segment_id, pos, round(sum(ln(1 + df)) / sqrt(any_value(n)), 6) AS score FROM w JOIN df USING (spec_id, word) GROUP BY ALL),
      r AS (SELECT s.*, row_number() OVER (PARTITION BY segment_id ORDER BY coalesce(score, 0.0) DESC, pos) AS r FROM s LEFT JOIN c USING (segment_id, pos))
      SELECT segment_id, pos, sentence FROM r WHERE r <= k""",
    "definitions": f"WITH {_DEFINED} SELECT * FROM defs",
    "quiz_choices": f"""WITH {_DEFINED}, n AS (SELECT *, count(*) OVER (PARTITION BY spec_id) AS n FROM defs), q AS (SELECT * FROM n WHERE n >= 4),
      o AS (SELECT q.spec_id, q.ord, q.term, q.definition AS d, q.page, q.ord % 4 AS ci, list(x.definition ORDER BY (x.ord - q.ord + q.n) % q.n) AS l FROM q JOIN q x ON x.spec_id = q.spec_id AND (x.ord - q.ord + q.n) % q.n BETWEEN 1 AND 3 GROUP BY ALL)
      SELECT spec_id, ord, term, array_to_string(list_concat(list_concat(l[1:ci], [d]), l[ci + 1:3]), ' | ') AS options, ci AS correct_index, 'Which statement best describes ' || term || '?' AS question, 'The document defines ' || term || ' as: ' || d AS explanation, 'medium' AS difficulty, CAST(page AS VARCHAR) AS source_pages FROM o""",
    "quiz_problems": """WITH q AS (SELECT item_id, any_value(document_id) AS document_id, any_value(coalesce(options, [])) AS o, any_value(correct_index) AS ci, any_value(coalesce(source_pages, [])) AS sp FROM study_items WHERE item_kind = 'quiz' AND item_id IS NOT NULL GROUP BY 1),
      n AS (SELECT document_id, max(page_number) AS n FROM document_pages GROUP BY 1)
      SELECT item_id, len(o) = 4 AND len(list_distinct(list_transform(o, lambda x: lower(x)))) = 4 AS options_ok, coalesce(ci BETWEEN 0 AND 3, false) AS index_ok,
        coalesce(array_to_string(list_sort(list_distinct(list_filter(sp, lambda p: p >= 1 AND p <= coalesce(n, 0)))), ','), '') AS pages FROM q LEFT JOIN n USING (document_id)""",
    "bm25_topk": f"WITH {_BM25} SELECT question_id, chunk_id, bm25, rank FROM bm WHERE rank <= 20",
    "dense_topk": """WITH v AS (SELECT vec_id, any_value(embedding) AS e FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1),
      c AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(CAST(v.e AS DOUBLE[]), CAST(q.e AS DOUBLE[])), 6) AS cosine FROM v JOIN v q ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM c) SELECT * FROM r WHERE rank <= 20""",
    "list_documents": f"SELECT id, title, status, updated_at, id IN (SELECT document_id FROM analyses WHERE document_id IS NOT NULL) AS has_analysis FROM {_UP}",
    "latest_documents": f"SELECT id, title, status, page_count, updated_at FROM {_UP}",
    "upload_codes": rf"""SELECT id, CASE WHEN coalesce(size_bytes, 0) <= 0 THEN 'EMPTY_FILE' WHEN size_bytes > 26214400 THEN 'FILE_TOO_LARGE' WHEN NOT regexp_matches(lower(coalesce(original_name, '')), '\.(pdf|docx|txt)$') THEN 'UNSUPPORTED_TYPE' WHEN page_count > 300 THEN 'TOO_MANY_PAGES' ELSE 'ok' END AS code FROM {_UP}""",
    "orphan_chunks": f"SELECT DISTINCT id AS chunk_id, document_id FROM chunks WHERE id IS NOT NULL AND document_id NOT IN (SELECT id FROM {_UP} WHERE status <> 'failed')",
    "version_dedup": """WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
      SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, sha256(event_type) AS content_hash FROM e WHERE p IS NULL OR p <> event_type""",
    "checkpoint_throttle": """WITH RECURSIVE t AS (SELECT DISTINCT user_id, ts FROM events WHERE ts IS NOT NULL), c AS (SELECT user_id, min(ts) AS ts FROM t GROUP BY 1
      UNION ALL SELECT c.user_id, (SELECT min(t.ts) FROM t WHERE t.user_id = c.user_id AND t.ts > c.ts + INTERVAL 1440 MINUTE) AS ts FROM c WHERE c.ts IS NOT NULL) SELECT user_id, ts FROM c WHERE ts IS NOT NULL""",
    "canonical_hash": """SELECT DISTINCT spec_id, sha256('{' || concat_ws(',', '"doc_id":' || to_json(doc_id), '"fmt":' || to_json(fmt), '"n_blocks":' || n_blocks, '"spec_id":' || spec_id) || '}') AS content_hash FROM doc_specs""",
    "line_collisions": """WITH b AS (SELECT document_id, page, line_no, any_value(x0) AS x0, any_value(y0) AS y0, any_value(x1) AS x1, any_value(y1) AS y1 FROM ocr_lines GROUP BY ALL)
      SELECT p.document_id, p.page, p.line_no AS line_a, q.line_no AS line_b FROM b p JOIN b q ON p.document_id = q.document_id AND p.page = q.page AND p.line_no < q.line_no AND p.x0 < q.x1 AND q.x0 < p.x1 AND p.y0 < q.y1 AND q.y0 < p.y1""",
    "page_metrics": """WITH b AS (SELECT document_id, page, line_no, any_value(y0) AS y0, any_value(y1) AS y1, any_value(height) AS height FROM ocr_lines GROUP BY ALL), s AS (SELECT document_id, page_number AS page, max(height) AS ph FROM document_pages GROUP BY ALL)
      SELECT document_id, page, count(*) AS lines, round((max(y1) - min(y0)) / max(ph), 6) AS fill_ratio, min(height) AS min_height FROM b JOIN s USING (document_id, page) GROUP BY ALL""",
    "lonely_headings": f"WITH {_SEGMENT}, n AS (SELECT *, lead(page) OVER (PARTITION BY spec_id ORDER BY order_index, segment_id) AS np FROM seg) SELECT spec_id, page, segment_id FROM n WHERE np > page AND label IN ('HEADING', 'SUBHEADING', 'TITLE')",
    "rate_sliding": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW) AS hits FROM events",
    "autosave_bursts": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e)
      SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS events FROM s GROUP BY user_id, g""",
    "tumbling_counts": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "rollup_lines": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, grouping(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "last_before": "SELECT event_id, coalesce((SELECT arg_max(x.event_id, (x.ts, x.event_id)) FROM events x WHERE x.user_id = e.user_id AND x.event_type <> 'purchase' AND (x.ts, x.event_id) < (e.ts, e.event_id)), -1) AS before FROM events e WHERE event_type = 'purchase'",
}

_HEADS = f"""{_SEGMENT},
ht AS (SELECT *, count(*) FILTER (WHERE label = 'TITLE') OVER f AS nt FROM seg WINDOW f AS (PARTITION BY spec_id ORDER BY order_index, segment_id)),
hd AS (SELECT spec_id, row_number() OVER (PARTITION BY spec_id ORDER BY order_index, segment_id) AS ord, CASE WHEN label = 'SUBHEADING' THEN 2 ELSE 1 END AS level, text AS heading
  FROM ht WHERE label IN ('HEADING', 'SUBHEADING') OR (label = 'TITLE' AND nt > 1))"""
_HEADS_ON = _HEADS[_HEADS.index("ht AS") :]
_UNNUM = r"regexp_replace(heading, '(?i)^(chapter\s*)?[0-9.]+\s*[:.]?\s*', '')"
_STEP_MARK = r"(?i)step\s*\d+\s*[:.)-]\s*|\b\d\)\s*|^\s*(?:first|procedure:|method:)\s*,?\s*"
#: Steps: the look-behind of one alternative is replaced by keeping the mark before the cut.
_STEPS = rf"""list_filter(list_transform(string_split(regexp_replace(regexp_replace({{0}}, '(?i)([.;])\s*(?:first|then|next|finally|after that)\s*,\s*', '\1' || chr(30), 'g'), '{_STEP_MARK}', chr(30), 'g'), chr(30)), lambda x: regexp_replace(x, '^[ ;.,]+|[ ;.,]+$', '', 'g')), lambda x: x <> '')"""
_DIFFICULTY = f"CASE WHEN len({_PARTS.format('{0}')}) <= 12 THEN 'easy' WHEN len({_PARTS.format('{0}')}) <= 30 THEN 'medium' ELSE 'hard' END"

ORACLES |= {
    "analysis_stats": """SELECT DISTINCT id, document_id, CASE WHEN json_valid(stats) THEN TRY_CAST(stats ->> '$.characters' AS BIGINT) END AS characters, CASE WHEN json_valid(stats) THEN TRY_CAST(stats ->> '$.words' AS BIGINT) END AS words,
      CASE WHEN json_valid(stats) THEN TRY_CAST(stats ->> '$.sentences' AS BIGINT) END AS sentences, CASE WHEN json_valid(stats) THEN stats ->> '$.language' END AS language,
      CASE WHEN json_valid(stats) THEN TRY_CAST(stats ->> '$.readability.flesch_reading_ease' AS DOUBLE) END AS flesch_reading_ease FROM analyses""",
    "assignment_objectives": f"""WITH {_HEADS}, r AS (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY ord) AS n FROM hd WHERE level = 1 AND trim(heading) <> '' AND NOT regexp_matches(heading, '(?i)question|exercise|reference|bibliograph|source|conclusion|summary|self-test'))
      SELECT spec_id, n AS ord, 'Explain ' || lower({_UNNUM}) AS text FROM r WHERE n <= 5""",
    "exam_sheet": f"""WITH {_DEFINED}, {_HEADS_ON},
      fo AS (SELECT spec_id, row_number() OVER (PARTITION BY spec_id ORDER BY i) AS ord, CASE WHEN contains(text, '=') THEN left(trim(split_part(text, '=', 1)), 60) ELSE 'Formula' END AS name, text FROM tree WHERE lab = 'FORMULA'),
      qs AS (SELECT spec_id, row_number() OVER (PARTITION BY spec_id ORDER BY i) AS n, {_STRIP.format('text')} AS text FROM tree WHERE lab = 'QUESTION'),
      nq AS (SELECT spec_id, count(*) AS c FROM qs GROUP BY 1),
      hq AS (SELECT h.spec_id, coalesce(c, 0) + row_number() OVER (PARTITION BY h.spec_id ORDER BY ord) AS n, 'Explain the key ideas of ''' || {_UNNUM} || '''.' AS text FROM hd h LEFT JOIN nq USING (spec_id) WHERE trim(heading) <> '' AND NOT regexp_matches(heading, '(?i)question|reference|bibliograph|conclusion|summary'))
      SELECT spec_id, 'definition' AS part, ord, term AS name, definition AS text FROM defs UNION ALL SELECT spec_id, 'formula', ord, name, text FROM fo
      UNION ALL SELECT spec_id, 'question', n, NULL, text FROM qs WHERE n <= 10 UNION ALL SELECT spec_id, 'question', n, NULL, text FROM hq WHERE n <= 8""",
    "outlines": f"""WITH {_SEGMENT}, o AS (SELECT spec_id, left(string_agg(CASE WHEN label IN ('TITLE', 'HEADING') THEN '# ' WHEN label = 'SUBHEADING' THEN '## ' ELSE '[' || coalesce(label, 'PARAGRAPH') || ' p.' || coalesce(CAST(page AS VARCHAR), '?') || '] ' END || text, chr(10) ORDER BY order_index, segment_id), 400000) AS t FROM seg GROUP BY 1)
      SELECT spec_id, length(t) AS characters, sha256(t) AS digest FROM o""",
    "flashcards": f"""WITH {_DEFINED},
      qa AS (SELECT *, lead(lab) OVER f AS nl, lead(text) OVER f AS nt, lead(page) OVER f AS np FROM tree WINDOW f AS (PARTITION BY spec_id, section_seq ORDER BY i)),
      al AS (SELECT spec_id, 0 AS source, ord AS at_, 'What is ' || CASE WHEN regexp_matches(substr(term, 2, 1), '^\\p{{Ll}}') THEN lower(term) ELSE term END || '?' AS question, definition AS answer, {_DIFFICULTY.format('definition')} AS difficulty, CAST(page AS VARCHAR) AS source_pages FROM defs
        UNION ALL SELECT spec_id, 1, order_index, {_STRIP.format('text')}, {_STRIP.format('nt')}, {_DIFFICULTY.format(_STRIP.format('nt'))}, array_to_string(list_sort(list_distinct([page, np])), ',') FROM qa WHERE lab = 'QUESTION' AND nl = 'ANSWER'
        UNION ALL SELECT spec_id, 2, order_index, 'Write the formula for ' || trim(split_part(text, '=', 1)) || '.', text, 'medium', CAST(page AS VARCHAR) FROM tree WHERE lab = 'FORMULA' AND contains(text, '=') AND trim(split_part(text, '=', 1)) <> ''
        UNION ALL SELECT spec_id, 3, order_index, 'What is an important point to remember from this topic?', {_STRIP.format('text')}, 'easy', CAST(page AS VARCHAR) FROM tree WHERE lab = 'IMPORTANT_POINT'),
      un AS (SELECT *, row_number() OVER (PARTITION BY spec_id, lower(question) ORDER BY source, at_, answer) AS r FROM al), nu AS (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY source, at_, answer) AS ord FROM un WHERE r = 1)
      SELECT spec_id, ord, question, answer, difficulty, source_pages FROM nu WHERE ord <= 10""",
    "merged_segments": rf"""WITH {_KEPT}, lead_ AS {_LEAD.format('kept')},
      pr AS (SELECT k.*, lead_gap, lag(k.page) OVER f AS pp, lag(text) OVER f AS pt, lag(fs) OVER f AS pf, lag(x0) OVER f AS px0, lag(x1) OVER f AS px1, lag(y0) OVER f AS py0, lag(y1) OVER f AS py1 FROM kept k JOIN lead_ USING (document_id) WINDOW f AS (PARTITION BY k.document_id ORDER BY k.page, k.line_no)),
      br AS (SELECT *, CASE WHEN pp IS NULL OR pp <> page OR pt = '' OR abs(pf - fs) > 0.6 OR regexp_matches(text, '(?i)^\s*(?:[•●▪◦\-–*]\s+|\(?\d{{1,3}}[.)]\s+|\(?[a-z][.)]\s+|q\d+[.:)]|step\s*\d+|\[\d+\]|answer\s*[:.]|definition\s*[:.]|example\s*[:.]|note\s*[:.]|important\s*[:.])')
        OR regexp_matches(text, '^[A-Z][a-z]+,\s(?:[A-Z]\.\s?)+(?:,|&|\(|et al)') OR y0 - py1 > 0.9 * greatest(py1 - py0, pf * 1.1, 1.0) OR y0 - py1 < -greatest(py1 - py0, pf * 1.1, 1.0)
        OR (px1 - px0 > 0 AND regexp_matches(pt, '[.:!?]$') AND px1 - px0 < 0.7 * greatest(x1 - x0, px1 - px0)) THEN 1 ELSE 0 END AS nw FROM pr),
      bl AS (SELECT *, sum(nw) OVER (PARTITION BY document_id ORDER BY page, line_no) AS blk FROM br),
      ag AS (SELECT document_id, blk, min(page) AS page, list_reduce(list(text ORDER BY page, line_no), lambda p, q: CASE WHEN regexp_matches(p, '[A-Za-z]-$') AND regexp_matches(q, '^\p{{Ll}}') THEN left(p, length(p) - 1) || q ELSE p || ' ' || q END) AS text,
        min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, median(fs) AS font_size, count(*) AS line_count, round(avg(conf), 1) AS ocr_confidence FROM bl WHERE text <> '' GROUP BY ALL),
      fin AS (SELECT * REPLACE (trim(regexp_replace(text, '[ \t]+', ' ', 'g')) AS text) FROM ag)
      SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY blk) - 1 AS order_index, page, text, x0, y0, x1, y1, font_size, false AS is_bold, line_count, ocr_confidence,
        coalesce(round(greatest(0.0, y0 - lag(y1) OVER g), 2), 0.0) AS gap_before, coalesce(round(greatest(0.0, lead(y0) OVER g - y1), 2), 0.0) AS gap_after FROM fin WHERE text <> '' WINDOW g AS (PARTITION BY document_id, page ORDER BY blk)""",
    "notes_clean": rf"""WITH {_TREE}, a AS (SELECT spec_id, section_seq, row_number() OVER (PARTITION BY spec_id, section_seq ORDER BY i) AS block, lab, trim(text) AS x, {_STRIP.format('trim(text)')} AS y FROM tree),
      b AS (SELECT *, regexp_replace(trim(y), '\.+$', '') AS t FROM a), c AS (SELECT *, CASE WHEN lab = 'DEFINITION' THEN {_definition()} END AS d1, regexp_replace(trim(x), '\.+$', '') AS t2 FROM b),
      e AS (SELECT * EXCLUDE (t), t2 AS t FROM c), f AS (SELECT *, coalesce(d1, CASE WHEN lab = 'DEFINITION' THEN {_definition()} END) AS d, {_STEPS.format('x')} AS st FROM e)
      SELECT spec_id, section_seq, block, CASE lab WHEN 'DEFINITION' THEN 'definition' WHEN 'EXAMPLE' THEN 'example' WHEN 'FORMULA' THEN 'formula' WHEN 'IMPORTANT_POINT' THEN 'key_point' WHEN 'PROCEDURE' THEN 'numbered' ELSE 'paragraph' END AS type, d[1] AS term,
        CASE WHEN lab = 'DEFINITION' THEN coalesce(d[2], y) WHEN lab IN ('EXAMPLE', 'IMPORTANT_POINT') THEN y WHEN lab = 'PROCEDURE' THEN CASE WHEN len(st) >= 2 THEN array_to_string(list_transform(st, lambda s: upper(left(s, 1)) || substr(s, 2)), chr(10)) ELSE x END ELSE x END AS text
      FROM f WHERE x <> '' """,
}
# written apart, so that what is folded in order here is a recursion there
ORACLES |= {
    "rate_limited": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL),
      r AS (SELECT event_id, user_id, i, [us] AS held, true AS allowed, CAST(NULL AS BIGINT) AS retry_after FROM e WHERE i = 1
      UNION ALL SELECT event_id, user_id, i, CASE WHEN len(f) < 3 THEN list_append(f, us) ELSE f END, len(f) < 3, CASE WHEN len(f) >= 3 THEN greatest(1, (f[1] + 86400000000 - us) // 1000000 + 1) END
        FROM (SELECT e.*, list_filter(r.held, lambda x: e.us - x <= 86400000000) AS f FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
      SELECT event_id, user_id, allowed, retry_after FROM r""",
    "editor_kept": "SELECT DISTINCT spec_id, true AS kept FROM segments WHERE segment_id IS NOT NULL AND spec_id IS NOT NULL",
    "autosaves": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY user_id) AS k FROM events WHERE user_id IS NOT NULL),
      r AS (SELECT user_id, i, k, us AS first_, us AS last, 1 AS n, CAST(NULL AS BIGINT) AS s1, CAST(NULL AS BIGINT) AS n1, CAST(NULL AS BIGINT) AS s2, CAST(NULL AS BIGINT) AS n2 FROM e WHERE i = 1
      UNION ALL SELECT user_id, i, k, CASE WHEN b2 THEN NULL ELSE f END, us, CASE WHEN b2 THEN 0 ELSE m END, CASE WHEN b1 THEN last + 21600000000 END, CASE WHEN b1 THEN n END, CASE WHEN b2 THEN us END, CASE WHEN b2 THEN m END FROM (
        SELECT *, us - f >= 86400000000 AS b2 FROM (SELECT *, CASE WHEN b1 OR first_ IS NULL THEN us ELSE first_ END AS f, CASE WHEN b1 THEN 1 ELSE n + 1 END AS m FROM (
          SELECT e.user_id, e.i, e.k, e.us, r.first_, r.last, r.n, r.n > 0 AND e.us - r.last >= 21600000000 AS b1 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))))
      SELECT user_id, s1 AS saved_us, n1 AS edits FROM r WHERE s1 IS NOT NULL UNION ALL SELECT user_id, s2, n2 FROM r WHERE s2 IS NOT NULL UNION ALL SELECT user_id, last + 21600000000, n FROM r WHERE i = k AND n > 0""",
    "document_phrases": f"""WITH {_TREE}, w AS (SELECT spec_id, order_index, segment_id, generate_subscripts(l, 1) AS pos, unnest(l) AS word FROM (SELECT spec_id, order_index, segment_id, {_TOKEN.format('text')} AS l FROM tree)),
      c AS (SELECT spec_id, lower(word) AS low, count(*) AS n, min((order_index, segment_id, pos)) AS f, arg_min(word, (order_index, segment_id, pos)) AS phrase FROM w WHERE lower(word) NOT IN ({_STOP}) AND length(word) > 3 GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY n DESC, f) AS rank FROM c) SELECT spec_id, rank, phrase FROM r WHERE rank <= 12""",
} | {k: f.sql() for k, f in FIXTURES.items()}
_REPORT = ORACLES["classification_report"]
ORACLES["classification_summary"] = f"""WITH q AS ({_REPORT}), v AS (SELECT CAST(sum(support) AS DOUBLE) AS n, sum(hits) / sum(support) AS accuracy, avg(precision) AS macro_precision, sum(precision * support) / sum(support) AS weighted_precision, avg(recall) AS macro_recall,
  sum(recall * support) / sum(support) AS weighted_recall, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM q) SELECT metric, round(value, 4) AS value FROM (UNPIVOT v ON COLUMNS(*) INTO NAME metric VALUE value)"""
