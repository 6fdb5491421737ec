"""DuckDB SQL of the queries that SQL can express."""

OP1 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
triples AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest([i, i + 1, i + 2]) AS p
    FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM triples) WHERE n > 1)
  GROUP BY r),
line AS (
  SELECT r, l, length(l) AS size, lower(l) AS low, regexp_matches(l, '[^\x20\x09-\x0D]') AS filled
  FROM (SELECT r, unnest(lines) AS l FROM d)),
judged AS (
  SELECT *, filled AND (
      NOT regexp_matches(l, '[.!?…。！？।؟]')
      OR (size <= 24 AND regexp_matches(low, '^\W*(home|menu|login|log in|sign in|sign up|next|previous|search|contact us|about us|back to top|read more|share this)\W*$'))
      OR (size <= 200 AND regexp_matches(low, 'all rights reserved|copyright ©|terms of use|terms of service|privacy policy|cookie policy|we use cookies|accept cookies|enable javascript|lorem ipsum|powered by wordpress|subscribe to our newsletter'))
      OR len(list_filter(regexp_split_to_array(l, '\s'), lambda x: length(x) = 1 AND regexp_matches(x, '[|›»·•]'))) * 100 > size * 3
      OR len(regexp_extract_all(l, '[#*$%&|<>]+|[!?]{2,}')) * 100 > size * 4) AS fails
  FROM line),
cleaned AS (
  SELECT r, count(*) FILTER (fails) AS removed, coalesce(sum(size) FILTER (fails), 0) AS lost, sum(size) AS size,
         count(*) FILTER (filled) - count(DISTINCT l) FILTER (filled) AS dup
  FROM judged GROUP BY r),
base AS (
  SELECT doc_id, len(w) AS n_words, length(list_aggregate(w, 'string_agg', '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         dup AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, removed AS n_lines_removed, lost AS lost_chars, size
  FROM d JOIN cleaned USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars * 100 <= size * 50 AS kept,
       n_lines_removed::BIGINT AS n_lines_removed, lost_chars::BIGINT AS lost_chars
FROM base
"""

OP10 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
esc AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS body,
         replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '<|lf|>') AS head
  FROM rows),
agg AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, head, body) AS spoken,
         coalesce(string_agg(text, '' ORDER BY turn, head, body) FILTER (role = 'assistant'), '') AS loss,
         sum(length('<|im_start|>') + length(head) + 1 + length(body) + length('<|im_end|>') + 1) AS formatted_chars
  FROM esc GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars
FROM agg
"""

OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS s FROM counts GROUP BY ALL),
groups AS MATERIALIZED (
  SELECT lang, source, coalesce(s, 0)::HUGEINT AS s, coalesce(v, 0)::HUGEINT AS v
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN sums USING (lang, source) LEFT JOIN v USING (lang)),
p AS MATERIALIZED (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (s + v) AS p
  FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (s + v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL) JOIN (SELECT lang, sum(s) AS s, max(v) AS v FROM groups GROUP BY ALL) USING (lang)),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
  FROM p JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (FROM pairs UNION ALL FROM terms)
QUALIFY part = 'pair' OR rank <= 200
"""

OP12 = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER g = 1 AS kept, text_sha256
FROM d
WINDOW g AS (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


def lloyd(rounds: int) -> str:
    """Codebooks b0 to b<rounds> and assignments a1 to a<rounds + 1>, each part against every entry."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k + 1} AS MATERIALIZED (
  SELECT r, part, min(struct_pack(d := d, e := entry)) AS best
  FROM (SELECT x.r, x.part, b.entry, sum((x.val - b.val) * (x.val - b.val)) AS d FROM x JOIN b{k} b USING (part, pos) GROUP BY ALL)
  GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""
b{k + 1} AS MATERIALIZED (
  SELECT part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, val) AS val
  FROM b{k} LEFT JOIN (
    SELECT part, best.e AS entry, pos, sum(val) AS s, count(*) AS n FROM x JOIN a{k + 1} USING (r, part) GROUP BY ALL) USING (part, entry, pos))""")
    return ",".join(steps)


OP13 = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT r, k * 4 // len(v) AS part, k % (len(v) // 4) AS pos, v[k + 1] AS val
  FROM (SELECT r, v, unnest(range(len(v))) AS k FROM v)),
b0 AS MATERIALIZED (SELECT part, r AS entry, pos, val FROM x WHERE r < 256),{lloyd(4)},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
  FROM a5 JOIN v USING (r) GROUP BY r, vec_id, label),
books AS (SELECT sha256(string_agg(val::BIGINT, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, books
"""
