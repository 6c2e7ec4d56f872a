"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from weekwise.llm.quality_rules import RULES, STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))
_BOUNDS = " AND ".join(
    f"coalesce({rule.measure} {sign} {bound}, false)"
    for rule in RULES
    for sign, bound in ((">=", rule.low), ("<=", rule.high))
    if bound is not None
)

ORACLE: dict[str, str] = {
    "op6_quality_rules": rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS body,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split),
windows AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM starts),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM again) GROUP BY 1),
counted AS (
  SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS worded,
         coalesce(c.n, 0) AS n_repeat_words,
         CAST(len(list_filter(words, lambda x: lower(x) IN ({_STOP}))) AS BIGINT) AS n_stop_words,
         len(lines) AS n_lines, length(body) AS n_chars
  FROM split s LEFT JOIN covered c ON c.doc_id = s.doc_id),
rated AS (
  SELECT *, CAST(len(worded) - len(list_distinct(worded)) AS BIGINT) AS n_dup_lines,
         CAST(word_chars AS DOUBLE) / nullif(n_words, 0) AS mean_word_chars,
         CAST(n_symbols AS DOUBLE) / nullif(n_words, 0) AS symbols_per_word,
         CAST(n_stop_words AS DOUBLE) / nullif(n_words, 0) AS stop_word_ratio,
         CAST(len(worded) - len(list_distinct(worded)) AS DOUBLE) / nullif(len(worded), 0) AS dup_line_ratio,
         CAST(len(worded) AS DOUBLE) / nullif(n_lines, 0) AS worded_line_ratio,
         CAST(word_chars AS DOUBLE) / nullif(n_chars, 0) AS word_char_ratio,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, mean_word_chars,
       symbols_per_word, stop_word_ratio, dup_line_ratio, worded_line_ratio, word_char_ratio, base_failed,
       NOT base_failed AND {_BOUNDS} AS kept
FROM rated""",
    "op12_phrase_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split WHERE len(w) > 0),
runs AS (SELECT lang, w, i, unnest(range(1, 6)) AS words FROM starts),
f AS (
  SELECT lang, array_to_string(w[i:i + words - 1], ' ') AS phrase, words, count(*) AS n
  FROM runs WHERE i + words - 1 <= len(w) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n_all FROM f WHERE words = 1 GROUP BY lang),
often AS (SELECT lang, phrase, words, n, string_split(phrase, ' ') AS w FROM f WHERE n >= 100),
inside AS (
  SELECT lang, unnest([array_to_string(w[1:words - 1], ' '), array_to_string(w[2:words], ' ')]) AS phrase, n
  FROM often WHERE words > 2),
most AS (SELECT lang, phrase, max(n) AS most FROM inside GROUP BY ALL),
kept AS (
  SELECT o.* FROM often o LEFT JOIN most m USING (lang, phrase)
  WHERE o.words > 1 AND coalesce(100 * m.most < 100 * o.n, true)),
cuts AS (SELECT lang, phrase, w, words, n AS a, unnest(range(1, words)) AS k FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, x.n AS l, y.n AS r, t.n_all AS n,
         CAST((CAST(1000 AS HUGEINT) * c.a * t.n_all) // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.words], ' ')
  JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000""",
}
