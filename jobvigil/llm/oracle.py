"""The queries that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

URL_FILTERS = f"""
WITH split AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM split
), listed AS (
  SELECT *, '.' || host AS dotted FROM parts
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN dotted LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN dotted LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN dotted LIKE '%.org' AND starts_with(path, '/') THEN 'org/'
    WHEN dotted LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN dotted LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
  END AS rule
  FROM listed
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host || path, '(?:^|\\.)spam-farm\\.') THEN 'block'
  WHEN regexp_matches(host || path, '/(?:login|signin|cart|wp-admin)(?:[/.]|$)') THEN 'block'
  ELSE 'allow' END AS verdict
FROM ruled
"""

CHAT_FORMATTING = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), ordered AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
         replace(replace(role, '\', '\\'), '<|', '<\|') AS safe_role,
         replace(replace(text, '\', '\\'), '<|', '<\|') AS safe_text
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(safe_text) + CASE WHEN before IS NULL OR before <> role
      THEN length('<|from|>') + length(safe_role) + length('<|says|>') + length('<|done|>') ELSE length('<|next|>') END)::BIGINT AS formatted_chars
FROM ordered GROUP BY conv_id
"""


MIXING = """
WITH RECURSIVE doc AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, '') AS k, coalesce(source, '') AS s,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS words
  FROM documents
), totals AS (
  SELECT s, sum(words)::BIGINT AS words FROM doc GROUP BY s
), shares AS (
  SELECT words, words / (SELECT sum(words) FROM totals)::DOUBLE AS p FROM totals WHERE words > 0
), facts AS (
  SELECT count(*) AS n, max(words)::DOUBLE AS most, min(words)::DOUBLE AS least FROM shares
), by_entropy AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END FROM (
    SELECT step, low, high, (low + high) / 2 AS mid,
      (SELECT ln(sum(pow(p, (low + high) / 2))) - (low + high) / 2 * sum(pow(p, (low + high) / 2) * ln(p)) / sum(pow(p, (low + high) / 2)) FROM shares)
        >= 0.998 * ln((SELECT n FROM facts)::DOUBLE) AS ok
    FROM by_entropy WHERE step < 32)
), chosen AS (
  SELECT CASE WHEN n < 2 OR most = least THEN 1.0 ELSE round(greatest(
    CASE WHEN (SELECT ln(sum(p)) - sum(p * ln(p)) / sum(p) FROM shares) >= 0.998 * ln(n::DOUBLE) THEN 1.0 ELSE (SELECT low FROM by_entropy WHERE step = 32) END,
    CASE WHEN most / least <= 2.0 THEN 0.0 ELSE 1.0 - ln(2.0) / ln(most / least) END), 6) END AS a, most
  FROM facts
), sources AS (
  SELECT *, floor(words * passes)::BIGINT AS budget FROM (
    SELECT s, words, CASE WHEN words > 0 THEN round(pow(most / words, 1.0 - a), 6) ELSE 1.0 END AS passes,
           greatest(1, ceil(words / 1048576.0))::BIGINT AS n_blocks
    FROM totals, chosen)
), named AS (
  SELECT *, CASE WHEN words > 0 THEN budget // words ELSE 1 END AS whole FROM sources
), placed AS (
  SELECT doc.*, ('0x' || substr(md5(k), 1, 8))::BIGINT % n_blocks AS block FROM doc JOIN named USING (s)
), each AS (
  SELECT *, epoch * source_words + coalesce(sum(block_words) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         row_number() OVER w AS block_rank
  FROM (
    SELECT b.s, b.block, b.block_words, n.words AS source_words, n.budget, n.whole, unnest(range(0, n.whole + 1)) AS epoch
    FROM (SELECT s, block, sum(words)::BIGINT AS block_words FROM placed GROUP BY ALL) b JOIN named n USING (s))
  WINDOW w AS (PARTITION BY s, epoch ORDER BY md5(concat_ws('|', s, block::VARCHAR, epoch::VARCHAR)), block)
), drawn AS (
  SELECT p.doc_id, p.source, p.words, e.*, md5(concat_ws('|', p.k, e.epoch::VARCHAR)) AS draw
  FROM placed p JOIN each e USING (s, block)
), counted AS (
  SELECT *, before + sum(words) OVER (PARTITION BY s, block, epoch ORDER BY draw) AS upto FROM drawn
)
SELECT doc_id, source, words, epoch::BIGINT AS epoch, block, block_rank::INT AS block_rank,
       CASE WHEN budget > 0 THEN before::DOUBLE / budget ELSE 0.0 END AS slot
FROM counted WHERE epoch < whole OR (before < budget AND (upto <= budget OR before + block_words <= budget))
"""

DIVERGENCE = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("coalesce(text, '')")} AS text FROM documents
), said AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM doc
), kept AS (
  SELECT lang, term, count(*) AS n FROM said GROUP BY ALL HAVING count(DISTINCT r) >= 3
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), here AS (
  SELECT lang, source, term, count(*) AS n FROM said SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, coalesce(any_value(l.v), 0) AS v, coalesce(sum(h.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM doc) g LEFT JOIN langs l USING (lang) LEFT JOIN here h USING (lang, source) GROUP BY g.lang, g.source
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 1)) // (g.total + g.v) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN here h USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT s.lang, s.source, t.source AS item, sum(((s.p - t.p) * (s.p - t.p)) // t.p) AS value
             FROM shares s JOIN shares t ON s.lang = t.lang AND s.term = t.term AND s.source <> t.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, ((s.p - q) * (s.p - q)) // q AS value
  FROM (SELECT shares.*, 1 + (1000000000::HUGEINT * (kept.n + 1)) // (langs.total + langs.v) AS q
        FROM shares JOIN kept USING (lang, term) JOIN langs USING (lang) WHERE shares.n > 0) s
  WHERE s.p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

FILL_IN_MIDDLE = """
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), drawn AS (
  SELECT *, ('0x' || substr(d, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(d, 9, 8))::BIGINT % (n + 1) AS b,
         n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(d, 17, 8))::BIGINT % 100 >= 90 AS plain,
         ('0x' || substr(d, 25, 8))::BIGINT % 100 < 20 AS turned
  FROM doc
), cut AS (
  SELECT *, substr(text, 1, least(a, b)) AS prefix, substr(text, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle, substr(text, greatest(a, b) + 1) AS suffix FROM drawn
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN turned THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN least(a, b) END AS prefix_chars, CASE WHEN NOT plain THEN greatest(a, b) - least(a, b) END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN turned THEN concat('<S>', suffix, '<P>', prefix, '<M>', middle) ELSE concat('<P>', prefix, '<S>', suffix, '<M>', middle) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""

ORACLE = {
    "op1_url_filters": URL_FILTERS,
    "op3_chat_formatting": CHAT_FORMATTING,
    "op6_mixing": MIXING,
    "op11_divergence": DIVERGENCE,
    "op12_fill_in_middle": FILL_IN_MIDDLE,
}
