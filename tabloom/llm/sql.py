"""The same results as DuckDB SQL, where SQL can express them on whole tables."""

from __future__ import annotations

OP1 = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), m AS (
  SELECT *, len(w) AS n, regexp_replace(t, '[^#*$%&|<>]+', '', 'g') AS sy, regexp_replace(t, '[^A-Z]+', '', 'g') AS up,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM w
), tri AS (
  SELECT doc_id, p, w[p] || chr(10) || w[p + 1] || chr(10) || w[p + 2] AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(n - 1, 1))) AS p FROM m WHERE n >= 3)
), rep AS (
  SELECT DISTINCT doc_id, p + d AS q
  FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c FROM tri), (SELECT unnest([0, 1, 2]) AS d)
  WHERE c > 1
), r AS (SELECT doc_id, count(*) AS n_rep FROM rep GROUP BY doc_id),
x AS (
  SELECT doc_id, n::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, len(sy)::BIGINT AS n_symbols,
         (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words,
         len(ln)::BIGINT AS n_lines, len(up)::BIGINT AS n_upper
  FROM m LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 2 * n_words)::INT
    + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines)::INT + 16 * (100 * n_upper > 40 * word_chars)::INT
    + 32 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words))::INT AS bits
  FROM x
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept,
       n_lines, n_upper, bits::BIGINT AS failure_bits, 'standard-1' AS policy
FROM b
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source
), c AS (
  SELECT *, [5.0, 2.0, 1.0][(sid - 1) % 3 + 1]::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev
  FROM c WINDOW b AS (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, sid, source_size, least(cap, w * max(lev) OVER ()) AS target FROM l
), p AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS full_epochs,
         coalesce(sum(size) OVER (PARTITION BY t.sid ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (full_epochs * size + greatest(0, least(size, floor(target - full_epochs * source_size) - start)))::BIGINT AS taken
FROM p
"""

OP8 = r"""
WITH iw AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item, least(8, len(w)) AS k, array_to_string(w[p:p + 7], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS p FROM iw WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), g AS (
  SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, (SELECT DISTINCT k FROM win))
), h AS (SELECT doc_id, g.k, p, item FROM g JOIN win ON g.gram = win.gram AND g.k = win.k),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS p FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(v, m) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, r.m FROM r JOIN e ON r.v = e.x),
m AS (SELECT v, min(m) AS m FROM r GROUP BY v)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, w.doc_id)::BIGINT AS component_id, w.doc_id = coalesce(m, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.v = w.doc_id
"""

OP7 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM w WHERE len(w) >= 35)),
r AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM g) WHERE c > 1),
q AS (SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, unnest(range(p, p + 35)) AS q FROM r) GROUP BY doc_id),
t AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w WHERE doc_id IN (SELECT doc_id FROM q)),
k AS (SELECT t.doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM t ANTI JOIN (SELECT doc_id, unnest(gone) AS i FROM q) AS z ON t.doc_id = z.doc_id AND t.i = z.i GROUP BY t.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM w LEFT JOIN q ON q.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id
"""

OP9 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS f FROM p GROUP BY h)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, sha256(p.h) AS payload_digest,
       CASE WHEN strlen(p.h) >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(p.h) >= 100 AND page_id <> f THEN f END AS refers_to
FROM p JOIN f ON p.h = f.h
"""

def _ablation() -> str:
    """Counts over the failure bits of OP1, for each policy and each rule left out of it."""
    from tabloom.llm.quality_rules import BASE, RULES, STANDARD

    bit = {r.name: 1 << r.bit for r in RULES}
    rows = [(p.version, n, p.mask(), p.mask() & ~bit[n]) for p in (BASE, STANDARD) for n in p.rules]
    selects = " UNION ALL ".join(f"SELECT '{v}' AS policy, '{n}' AS rule, count(*)::BIGINT AS documents, count_if(bits & {full} = 0)::BIGINT AS kept, count_if(bits & {less} = 0)::BIGINT AS kept_without FROM b" for v, n, full, less in rows)
    return OP1[: OP1.rindex("SELECT doc_id")] + selects


def _licenses() -> str:
    """OP4 for texts without identifier tags, whose expressions SQL can't parse: base places word by
    word, labels by phrases in the joined words, the score in order of the labels."""
    from tabloom.llm.licenses import _BASE_WEIGHT, BASE, PHRASES

    rows = [(p, label, _BASE_WEIGHT, "true") for p, label in BASE.items()] + [(p, *x, "false") for p, x in PHRASES.items()]
    values = ", ".join(f"('{p}', '{label}', {weight!r}::DOUBLE, {base})" for p, label, weight, base in rows)
    return f"""
    WITH d AS (
      SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
    ), l AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS line FROM d),
    m AS (
      SELECT r, q - 1 AS at_word, k, label, weight, base
      FROM (SELECT r, w, label, weight, base, phrase, len(string_split(phrase, ' ')) AS k, unnest(range(1, len(w) + 1)) AS q FROM l JOIN (VALUES {values}) AS p(phrase, label, weight, base) ON contains(line, ' ' || phrase || ' '))
      WHERE array_to_string(w[q:q + k - 1], ' ') = phrase
    ), f AS (
      SELECT r, label, max(weight) AS weight FROM m
      WHERE base OR NOT EXISTS (SELECT 1 FROM m AS x WHERE x.r = m.r AND NOT x.base AND x.k > m.k AND x.at_word <= m.at_word AND x.at_word + x.k >= m.at_word + m.k)
      GROUP BY r, label
    ), s AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels, 1 - list_reduce(list(1 - weight ORDER BY label), lambda a, b: a * b) AS score FROM f GROUP BY r),
    c AS (SELECT r, count(*) AS n, min(at_word) AS low, max(at_word) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM m WHERE base GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, low::BIGINT AS first_word, high::BIGINT AS last_word, coalesce(c.labels, '') AS base_labels,
           coalesce(s.labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score, '' AS expressions, NULL::BOOLEAN AS permitted
    FROM d LEFT JOIN s ON s.r = d.r LEFT JOIN c ON c.r = d.r"""


OP2 = "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, md5(coalesce(text, '')) AS digest FROM documents"

SQL: dict[str, str] = {"op2_sharding": OP2, "op4_licenses": _licenses(), "quality_ablation": _ablation(), "op1_quality_rules": OP1, "op3_near_dedup": OP3, "op6_mixing": OP6, "op7_substring_dedup": OP7, "op8_decontaminate": OP8, "op9_warc": OP9}
