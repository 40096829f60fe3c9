"""DuckDB SQL for op2_quality_rules."""

from __future__ import annotations

from tessera.llm.quality_rules import DELTA, GRID, MAX_FALSE_REJECTION, RULES

_A = MAX_FALSE_REJECTION / len(RULES)

SQL = f"""
WITH words AS (
    SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
           list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
    FROM documents
), windows AS (
    SELECT doc_id, i, list_slice(w, i, i + 7) AS win FROM words, unnest(range(1, len(w) - 6)) AS r(i)
), repeated AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1
), covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, range(8) AS o(k) GROUP BY doc_id
), m AS (
    SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words,
           CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
           CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
           CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals
    FROM words LEFT JOIN covered USING (doc_id)
), b AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), shares AS (
    {" UNION ALL ".join(f"SELECT doc_id, stratum, base_failed, '{r}' AS rule, {n} AS a, {d} AS d FROM b" for r, (n, d) in RULES.items())}
), known AS (
    SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)
), drawn AS (
    SELECT doc_id FROM (SELECT DISTINCT * FROM m) GROUP BY doc_id HAVING count(*) = 1
), tried AS (
    SELECT stratum, rule, cutoff, count(*) FILTER (quality = 1) AS n,
           count(*) FILTER (quality = 1 AND 1000 * a > cutoff * d) AS k, count(*) FILTER (quality = 0 AND 1000 * a > cutoff * d) AS bad
    FROM (SELECT DISTINCT * FROM shares) JOIN known USING (doc_id) JOIN drawn USING (doc_id), unnest([{", ".join(map(str, GRID))}]) AS g(cutoff)
    WHERE NOT base_failed GROUP BY ALL
), tails AS (
    SELECT *, (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_A}) + (n - j) * ln(1 - {_A}))) FROM range(k + 1) AS r(j)) AS p,
           (SELECT count(DISTINCT stratum) FROM tried) AS strata
    FROM tried WHERE k < n * {_A} AND bad > k
), best AS (
    SELECT stratum, rule, arg_max(cutoff, (bad - k) * 10000 + cutoff) AS cutoff FROM tails WHERE p <= {DELTA / len(RULES)} / strata GROUP BY ALL
), cut AS (
    SELECT DISTINCT doc_id FROM shares JOIN best USING (stratum, rule) WHERE 1000 * a > cutoff * d
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM cut WHERE doc_id IS NOT NULL) AS kept
FROM b
"""
