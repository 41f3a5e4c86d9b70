"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from hunkwise.llm import licences

# Words, hash and targets as in mixing.py; the thresholds come from a sorted running sum instead.
OP4 = r"""
WITH d AS (
  SELECT doc_id, source, text,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
         coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM s
), f AS (
  SELECT arg_min((budget - before) / w_left, before) AS level FROM r WHERE (budget - before) / w_left * w <= cap
), g AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target,
         CAST(floor(CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END / greatest(source_size, 1)) AS BIGINT) AS whole
  FROM r CROSS JOIN f
), run AS (
  SELECT d.source, d.h, sum(d.size) AS size, sum(sum(d.size)) OVER (PARTITION BY d.source ORDER BY d.h) AS upto
  FROM d WHERE d.size > 0 GROUP BY d.source, d.h
), b AS (
  SELECT run.source, run.h, run.upto, run.upto - run.size AS under, g.target - g.whole * g.source_size AS budget,
         row_number() OVER (PARTITION BY run.source ORDER BY run.h) AS k
  FROM run JOIN g ON run.source IS NOT DISTINCT FROM g.source
  WHERE run.upto > g.target - g.whole * g.source_size
), bound AS (
  SELECT source, h + CASE WHEN upto - budget < budget - under THEN 1 ELSE 0 END AS bound FROM b WHERE k = 1
)
SELECT d.doc_id, d.size, g.source_size, g.target,
       CAST(d.size * least(2, g.whole + CASE WHEN d.h < bound.bound THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
LEFT JOIN bound ON d.source IS NOT DISTINCT FROM bound.source
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def op7() -> str:
    values = ", ".join(f"({k}, {_quoted(name)}, {_quoted(text)})" for k, (name, text) in enumerate(licences.TEMPLATES))
    norm = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    bag = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
WITH t0(template, licence, body) AS (VALUES {values}),
t1 AS (SELECT template, licence, string_split({norm.format('body')}, ' ') AS w FROM t0),
t2 AS (SELECT template, licence, len(w) - 1 AS n_template, unnest({bag}) AS bigram FROM t1),
t AS (SELECT template, licence, n_template, bigram, count(*) AS n_bigram FROM t2 GROUP BY ALL),
d AS (SELECT row_number() OVER () AS row, doc_id, text, string_split(text, chr(10)) AS lines,
             string_split_regex(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), ' ' || chr(10)), '\\n ?(?:\\n ?)+') AS blocks
      FROM documents WHERE text IS NOT NULL),
p AS (SELECT row, doc_id, unnest(range(len(blocks))) AS unit, unnest(blocks) AS body FROM d WHERE len(blocks) > 1),
u AS (SELECT row, doc_id, 'text' AS kind, 0 AS unit, text AS body FROM d
      UNION ALL SELECT row, doc_id, 'paragraph', CAST(unit AS INT), body FROM p WHERE contains(body, chr(10))
      UNION ALL SELECT row, doc_id, 'line', CAST(unnest(range(len(lines))) AS INT), unnest(lines) FROM d WHERE len(lines) > 1),
v AS (SELECT row, doc_id, kind, unit, string_split({norm.format('body')}, ' ') AS w FROM u),
x AS (SELECT row, doc_id, kind, unit, len(w) - 1 AS n_unit, unnest({bag}) AS bigram FROM v WHERE len(w) BETWEEN 2 AND 1000),
y AS (SELECT row, doc_id, kind, unit, n_unit, bigram, count(*) AS n FROM x GROUP BY ALL),
m AS (SELECT row, doc_id, kind, unit, n_unit, template, licence, n_template, sum(least(n, n_bigram)) AS common
      FROM y JOIN t USING (bigram) GROUP BY ALL),
z AS (SELECT *, 2 * common / (n_unit + n_template) AS dice FROM m WHERE 2 * common / (n_unit + n_template) >= {licences.DICE}),
k AS (SELECT *, row_number() OVER (PARTITION BY row, kind, unit ORDER BY dice DESC, licence, common) AS best FROM z)
SELECT doc_id, kind, CAST(unit AS INT) AS unit, licence, CAST(dice AS DOUBLE) AS dice, CAST(common AS BIGINT) AS common FROM k WHERE best = 1
"""


ORACLES = {"op4_mix": OP4, "op7_licences": op7()}
