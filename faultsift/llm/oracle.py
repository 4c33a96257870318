"""SQL with the same rows, for the operators that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_QUALITY = rf"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
lines AS (
    SELECT r, line, count(*) AS n FROM (
        SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts)
    WHERE NOT regexp_full_match(line, '[\x20\x09-\x0D]*') GROUP BY r, line),
line_counts AS (
    SELECT r, sum(n) AS n_lines, sum(n - 1) AS n_dup,
           sum(CASE WHEN regexp_full_match(line, '(?s).*\.\.\.[\x20\x09-\x0D]*') THEN n ELSE 0 END) AS dotted
    FROM lines GROUP BY r),
tokens AS (
    SELECT r, unnest(words) AS w, unnest(range(len(words))) AS i FROM texts),
windows AS (
    SELECT r, i, w || chr(10) || lead(w, 1) OVER o || chr(10) || lead(w, 2) OVER o || chr(10)
                   || lead(w, 3) OVER o || chr(10) || lead(w, 4) OVER o AS win
    FROM tokens WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows WHERE win IS NOT NULL)
    WHERE n > 1),
repeated AS (
    SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY r),
base AS (
    SELECT t.doc_id, t.text, CAST(len(words) AS BIGINT) AS n_words,
           CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
           CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
           coalesce(n_lines, 0) AS n_lines, coalesce(dotted, 0) AS dotted,
           length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS digits,
           length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS upper,
           length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS letters
    FROM texts t LEFT JOIN line_counts l ON t.r = l.r LEFT JOIN repeated p ON t.r = p.r),
judged AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words
            OR word_chars > 20 * n_words OR 100 * n_dup_lines > 60 * n_lines OR 100 * dotted > 30 * n_lines
            OR 100 * digits > 20 * word_chars OR 100 * upper > 50 * letters) AS kept
FROM judged"""

#: Base32 of 20 bits at a time: each 5 hex digits give 4 digits.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(sha, {5 * part + 1}, 5) AS BIGINT) "
    f">> {5 * (3 - digit)}) & 31) + 1, 1)" for part in range(8) for digit in range(4))

_WARC = f"""
WITH payloads AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
           sha1(coalesce(html, '')) AS sha FROM pages),
firsts AS (SELECT *, max(page_id) OVER (PARTITION BY sha, payload_bytes) AS first FROM payloads)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts"""

#: Phrases of one to five words, as k neighbours of a piece; products in 128 bits.
_PHRASES = r"""
WITH pieces AS (
    SELECT row_number() OVER () AS p, lang, piece FROM (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
words AS (
    SELECT p, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws)) AS n FROM words GROUP BY lang),
counts AS (
    SELECT lang, k, phrase, count(*) AS f FROM (
        SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (
            SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
            FROM words, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k))
    GROUP BY lang, k, phrase),
found AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws FROM counts WHERE k > 1 AND f >= 100),
inside AS (
    SELECT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, max(f) AS longer FROM (
        SELECT lang, ws, f, j, unnest(range(1, k - j + 2)) AS i FROM (
            SELECT lang, ws, f, k, unnest(range(2, k)) AS j FROM found)) GROUP BY ALL),
kept AS (
    SELECT f.* FROM found f LEFT JOIN inside i ON f.lang = i.lang AND f.phrase = i.phrase
    WHERE longer IS NULL OR 100 * longer < 100 * f.f),
cuts AS (
    SELECT lang, phrase, f AS a, c, array_to_string(ws[:c], ' ') AS x, array_to_string(ws[c + 1:], ' ') AS y
    FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)),
scored AS (
    SELECT c.lang, c.phrase, c.a, c.c, l.f AS l, r.f AS r, t.n,
           (1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f) AS score
    FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.x
    JOIN counts r ON r.lang = c.lang AND r.phrase = c.y JOIN totals t ON t.lang = c.lang),
worst AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000"""

SQL = {"op13_collocations": _PHRASES, "op3_quality_cascade": _QUALITY, "op6_warc_chains": _WARC}
