"""DuckDB SQL of the queries that SQL can express."""

from callscape.llm.licenses import PHRASES, TEMPLATES

SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

QUALITY_CTES = rf"""
rows_ AS (SELECT *, row_number() OVER () AS r, coalesce(text, '') AS t FROM {{docs}}),
split_ AS (
  SELECT *, regexp_extract_all(t, '{WORD}') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM rows_),
win AS (
  SELECT r, p, w[p] || chr(1) || w[p + 1] || chr(1) || w[p + 2] AS h
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM split_)),
rep AS (SELECT r, p FROM win QUALIFY count(*) OVER (PARTITION BY r, h) > 1),
cover AS (
  SELECT r, count(DISTINCT p + k) AS n FROM rep CROSS JOIN (VALUES (0), (1), (2)) AS v(k)
  GROUP BY r),
counts AS (
  SELECT s.r, s.doc_id, s.source, s.t, s.l, len(s.w)::BIGINT AS n_words,
    length(regexp_replace(s.t, '{SPACE_CLASS}', '', 'g'))::BIGINT AS word_chars,
    (length(s.t) - length(regexp_replace(s.t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(s.l) - len(list_distinct(s.l)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM split_ s LEFT JOIN cover c USING (r)),
kinds AS (SELECT source, t, any_value(l) AS l, any_value(n_words) AS n_words
          FROM counts GROUP BY source, t),
lines_ AS (
  SELECT source, t, x, translate(trim(regexp_replace(x, '{SPACE_CLASS}+', ' ', 'g')), {UPPER})
    AS line
  FROM (SELECT source, t, unnest(l) AS x FROM kinds)),
hosts AS (SELECT source, count(*) AS n_docs FROM kinds GROUP BY source),
common AS (
  SELECT h.source, h.line
  FROM (SELECT source, line, count(DISTINCT t) AS n FROM lines_ GROUP BY source, line) h
  JOIN hosts ON h.source IS NOT DISTINCT FROM hosts.source
  WHERE h.n >= 20 OR (h.n >= 3 AND h.n >= 0.1 * hosts.n_docs)),
gone AS (
  SELECT a.source, a.t, sum(len(regexp_extract_all(a.x, '{WORD}'))) AS removed,
    list(DISTINCT a.line) AS removed_lines
  FROM lines_ a JOIN common b ON a.source IS NOT DISTINCT FROM b.source AND a.line = b.line
  GROUP BY a.source, a.t),
judged AS (
  SELECT c.*, g.removed_lines,
    c.n_words < 50 OR 100 * c.n_repeat_words > 50 * c.n_words AS base_failed,
    NOT (c.n_words < 50 OR 100 * c.n_repeat_words > 50 * c.n_words)
      AND coalesce(c.n_words - g.removed >= 0.3 * c.n_words, true) AS kept
  FROM counts c
  LEFT JOIN gone g ON c.source IS NOT DISTINCT FROM g.source AND c.t = g.t)
"""



def _list(text: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"


def _key_phrases() -> str:
    """(template, place in it, phrase) rows."""
    rows = []
    for k, (_, text, phrases) in enumerate(TEMPLATES):
        words = text.split()
        for phrase in phrases:
            n = len(phrase.split())
            at = next(q for q in range(len(words)) if words[q : q + n] == phrase.split())
            rows.append(f"({k}, {at}, {_list(phrase)})")
    return ", ".join(rows)


LICENSES = f"""
WITH templates AS (SELECT * FROM (VALUES {", ".join(
    f"({k}, '{label}', {_list(text)})" for k, (label, text, _) in enumerate(TEMPLATES))})
    AS v(k, label, t)),
phrases AS (SELECT * FROM (VALUES {", ".join(
    f"('{label}', {_list(text)})" for label, text in PHRASES)}) AS v(label, f)),
keys AS (SELECT * FROM (VALUES {_key_phrases()}) AS v(k, q, f)),
postings AS (SELECT k, generate_subscripts(t, 1) - 1 AS q, unnest(t) AS word FROM templates),
vocabulary AS (SELECT DISTINCT word FROM postings UNION SELECT unnest(f) FROM phrases),
docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), {UPPER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
hits AS (
  SELECT r, i, word FROM (
    SELECT r, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word FROM docs) x
  JOIN vocabulary USING (word)),
base AS (
  SELECT h.r, h.i, p.label FROM hits h JOIN docs d USING (r) JOIN phrases p
    ON h.word = p.f[1] AND d.w[h.i + 1 : h.i + len(p.f)] = p.f),
anchors AS (SELECT k, min(q) AS q, arg_min(f, q) AS f FROM keys GROUP BY k),
placed AS (SELECT DISTINCT h.r, a.k, h.i - a.q AS at FROM hits h JOIN anchors a ON h.word = a.f[1]),
good AS (
  SELECT p.* FROM placed p JOIN docs d USING (r) JOIN keys y USING (k)
  GROUP BY ALL
  HAVING bool_and(p.at + y.q >= 0 AND d.w[p.at + y.q + 1 : p.at + y.q + len(y.f)] = y.f)),
shares AS (
  SELECT g.r, t.label,
    len(list_filter(range(0, len(t.t)), lambda q: g.at + q >= 0 AND d.w[g.at + q + 1] = t.t[q + 1]))
      / len(t.t) AS share
  FROM good g JOIN docs d USING (r) JOIN templates t USING (k)),
b AS (SELECT r, count(*) AS n, min(i) AS first_word, max(i) AS last_word,
        list(DISTINCT label) AS labels FROM base GROUP BY r),
m AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM shares GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base,
  b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(
    list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
  greatest(coalesce(m.share, 0.0), CASE WHEN b.n > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
FROM docs d LEFT JOIN b USING (r) LEFT JOIN m USING (r)"""

ORACLE: dict[str, str] = {
    "op4_license_scan": LICENSES,
    "op2_warc_archive": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top
  FROM pages),
v AS (SELECT *, list_transform(range(0, 8), lambda i:
        ('0x' || substr(d, CAST(1 + 5 * i AS INT), 5))::BIGINT) AS q FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  list_aggregate(flatten(list_transform(q, lambda x: list_transform([15, 10, 5, 0], lambda b:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x >> b) & 31) + 1 AS INT), 1)))),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM v""",
    "op5_line_dedup": r"""
WITH lines_ AS (
  SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS raw
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
occ AS (SELECT *, trim(raw, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS line
        FROM lines_),
kinds AS (
  SELECT line, length(line) AS n, min(row(doc_id, pos)) AS first FROM occ
  WHERE length(line) >= 20 GROUP BY line),
cuts AS (
  SELECT line, n, first, i, CASE WHEN i = 0 THEN line
    ELSE left(line, CAST(i - 1 AS INT)) || substr(line, CAST(i + 1 AS INT)) END AS v
  FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM kinds)),
near AS (
  SELECT DISTINCT a.line
  FROM cuts a JOIN cuts b
    ON hash(a.v) = hash(b.v) AND a.v = b.v AND (a.i = b.i OR a.i = 0 OR b.i = 0)
    AND a.line <> b.line
  WHERE b.first < a.first AND levenshtein(a.line, b.line) <= 1),
kept AS (
  SELECT o.doc_id, o.pos, o.raw,
    k.line IS NOT NULL AND (row(o.doc_id, o.pos) > k.first OR n.line IS NOT NULL) AS gone
  FROM occ o LEFT JOIN kinds k ON o.line = k.line LEFT JOIN near n ON o.line = n.line)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines,
  coalesce(k.n_removed, 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone) AS text
  FROM kept GROUP BY doc_id) k USING (doc_id)""",
    "op9_quality_rules": f"""
WITH {QUALITY_CTES.format(docs="documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
FROM judged""",
}
