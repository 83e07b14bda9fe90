"""DuckDB SQL of the queries that SQL can express."""

EXACT_DEDUP = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

QUALITY_RULES = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) > 0) AS lines
  FROM documents
), numbered AS (
  SELECT row_number() OVER () AS r, * FROM base
), windows AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS window_words
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM numbered)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, window_words) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), judged AS (
  SELECT r, sum(CASE WHEN n_marks > 1 AND n_marks * 2 >= n_words OR n_bars >= 2 AND n_bars * 5 >= n_words
                       OR n_words < 3 AND NOT ended OR notice AND n_words <= 20 THEN 0 ELSE chars END) AS left_chars,
         sum(CASE WHEN n_marks > 1 AND n_marks * 2 >= n_words OR n_bars >= 2 AND n_bars * 5 >= n_words
                       OR n_words < 3 AND NOT ended OR notice AND n_words <= 20 THEN 1 ELSE 0 END) AS failed_lines
  FROM (
    SELECT r, length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS chars,
           len(regexp_extract_all(l, '[#*$%&|<>!]')) AS n_marks,
           len(regexp_extract_all(l, '[|]')) AS n_bars,
           len(list_filter(string_split(translate(l, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda w: w <> '')) AS n_words,
           regexp_matches(rtrim(l, ' '), '[.!?:;"''”»)…]$') AS ended,
           regexp_matches(lower(l), 'cookie policy|privacy policy|terms of use|terms of service|enable javascript|click here|sign up|log in|add to cart') AS notice
    FROM (SELECT r, unnest(lines) AS l FROM numbered))
  GROUP BY r
), counted AS (
  SELECT doc_id, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(failed_lines, 0)::BIGINT AS n_failed_lines,
         coalesce(left_chars, 0) AS left_chars
  FROM numbered LEFT JOIN covered USING (r) LEFT JOIN judged USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND left_chars * 100 >= word_chars * 50 AS kept
FROM counted
"""
