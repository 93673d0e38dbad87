"""SQL for DuckDB that gives the same rows as the queries, where SQL can."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP5 = r"""
WITH split_ AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each_ AS (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM split_),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each_),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP7 = (
    r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, """
    + _WORDS
    + r""" AS words FROM documents),
win AS (SELECT doc_id, words, unnest(range(1, length(words) - 3)) AS i FROM w WHERE length(words) >= 5),
twice AS (SELECT doc_id, list(i) AS places FROM win GROUP BY doc_id, words[i:i + 4] HAVING count(*) > 1),
cover AS (SELECT DISTINCT doc_id, i + j AS k FROM (SELECT doc_id, unnest(places) AS i FROM twice), (SELECT unnest(range(5)) AS j)),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM cover GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (SELECT doc_id, sum(n) AS n_lines, sum(n - 1) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
s AS (SELECT w.doc_id, source, length(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
      FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id LEFT JOIN dup ON w.doc_id = dup.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base, 100 * n_symbols > 10 * word_chars AS symbols, 100 * n_dup_lines > 30 * n_lines AS dup_lines FROM s),
hosts AS (SELECT source, rule, count(*) AS n, count(*) FILTER (failed) AS bad
          FROM (SELECT source, unnest(['base', 'symbols', 'dup_lines']) AS rule, unnest([base, symbols, dup_lines]) AS failed FROM f WHERE source IS NOT NULL) GROUP BY source, rule),
m AS (SELECT rule, count(*) AS hosts, avg(bad / n) AS r1, avg((bad / n) ** 2) AS r2, avg(1 / n) AS inv, least(greatest(avg(bad / n), 0.0001), 0.9999) AS m FROM hosts GROUP BY rule),
p AS (SELECT rule, m, r1, CASE WHEN hosts < 2 THEN 1.0 WHEN r2 - r1 * r1 - m * (1 - m) * inv <= 0 THEN 1e6
                           ELSE least(greatest(m * (1 - m) / (r2 - r1 * r1 - m * (1 - m) * inv) - 1, 0.1), 1e6) END AS strength FROM m),
rated AS (SELECT source, r1, n + strength AS weight, (bad + m * strength) / (n + strength) AS rate FROM hosts JOIN p ON hosts.rule = p.rule),
refused AS (SELECT DISTINCT source FROM rated WHERE rate - 2 * sqrt(rate * (1 - rate) / (weight + 1)) > r1 + 0.2)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, CAST(n_lines AS BIGINT) AS n_lines,
       base AS base_failed, NOT base AND refused.source IS NULL AS kept
FROM f LEFT JOIN refused ON f.source = refused.source
"""
)

# The plain patterns; what they add up to is what the operator's possessive forms give. Score and words of context stand last.
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 0.9, ("mail", "contact")),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(m, '.'), lambda x: len(ltrim(x, '0')) > 3 OR coalesce(try_cast(x AS HUGEINT), 0) > 255)) = 0", 0.6, ("ip", "address", "host", "server")),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", "len(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 14 AND 19 AND luhn(regexp_replace(m, '[^0-9]', '', 'g'))", 0.8, ("card", "visa", "credit", "payment")),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "len(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 10 AND 15", 0.7, ("phone", "mobile", "call", "tel")),
    ("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", "mod97(replace(m, ' ', ''))", 0.8, ("iban", "account", "bank")),
    # a whole run of digits and hyphens, as none may stand beside it
    ("ssn", r"[0-9-]+", r"regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND NOT regexp_matches(m, '^(?:000|666|9..)|-00-|-0000$')", 0.3, ("ssn", "social security")),
)
_LUHN = "list_sum(list_transform(range(len({d})), lambda i: CASE WHEN i % 2 = 0 THEN CAST({d}[len({d}) - i] AS INT) WHEN CAST({d}[len({d}) - i] AS INT) > 4 THEN 2 * CAST({d}[len({d}) - i] AS INT) - 9 ELSE 2 * CAST({d}[len({d}) - i] AS INT) END)) % 10 = 0"
_MOD97 = "list_reduce(list_prepend(0, list_transform(string_split({a}[5:] || {a}[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INT) ELSE ascii(c) - 55 END)), lambda r, v: (CASE WHEN v < 10 THEN r * 10 + v ELSE r * 100 + v END) % 97) = 1"


def _op8() -> str:
    parts = []
    for ord_, (name, rx, valid, score, context) in enumerate(_KINDS):
        digits = "regexp_replace(m, '[^0-9]', '', 'g')"
        valid = valid.replace(f"luhn({digits})", _LUHN.replace("{d}", digits)).replace("mod97(replace(m, ' ', ''))", _MOD97.replace("{a}", "replace(m, ' ', '')"))
        near = " OR ".join(f"contains(lower(t[greatest(s - 48, 0) + 1:s]), '{w}')" for w in context)
        parts.append(
            f"SELECT doc_id, {ord_} AS ord, '{name}' AS kind, s AS start, s + len(m) AS end_, CASE WHEN {near} THEN least({score} + 0.35, 1) ELSE {score} END AS score FROM (SELECT doc_id, t, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: coalesce(list_sum(list_transform(gs[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0))) AS s "
            f"FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{rx}') AS ms, string_split_regex(coalesce(text, ''), '{rx}') AS gs FROM documents)) WHERE {valid}"
        )
    body = " UNION ALL ".join(parts)
    text = "kind || ':' || CAST(start AS BIGINT) || ':' || CAST(end_ AS BIGINT)"
    return f"""
WITH spans AS (SELECT * FROM ({body}) WHERE ord < 4 OR score >= 0.5),
one AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ('email', 'ip', 'card', 'phone'))},
        string_agg({text}, ',' ORDER BY start, ord) FILTER (ord < 4) AS base, string_agg({text}, ',' ORDER BY start, ord) AS spans, string_agg(printf('%.2f', CAST(score AS DOUBLE)), ',' ORDER BY start, ord) AS scores FROM spans GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in ('email', 'ip', 'card', 'phone'))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM documents d LEFT JOIN one ON d.doc_id = one.doc_id
"""


OP8 = _op8()

OP3 = (
    r"""
WITH w AS (SELECT doc_id, """
    + _WORDS
    + r""" AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS seq FROM (SELECT doc_id, words, unnest(range(1, length(words) - 11)) AS i FROM w WHERE length(words) >= 13)),
least AS (SELECT seq, min(doc_id) AS doc_id FROM win GROUP BY seq),
gone AS (SELECT win.doc_id, list(DISTINCT i + j) AS places FROM win JOIN least ON win.seq = least.seq AND least.doc_id < win.doc_id, (SELECT unnest(range(13)) AS j) GROUP BY win.doc_id)
SELECT w.doc_id, CAST(length(words) AS BIGINT) AS n_words, CAST(coalesce(length(places), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(words, lambda x, i: places IS NULL OR NOT list_contains(places, i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id
"""
)

OP6 = (
    r"""
WITH RECURSIVE w AS (SELECT doc_id, """
    + _WORDS
    + r""" AS words FROM documents),
grams AS (SELECT DISTINCT doc_id, gram FROM (
  SELECT doc_id, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, length(words) - 3)) AS i FROM w WHERE length(words) >= 5)
  UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE length(words) BETWEEN 1 AND 4)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9),
reach AS (SELECT doc_id, doc_id AS least FROM documents UNION SELECT l.y, r.least FROM reach r JOIN links l ON l.x = r.doc_id AND r.least < l.y),
least AS (SELECT doc_id, min(least) AS class_id FROM reach GROUP BY doc_id),
counted AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT least.doc_id, class_id, coalesce(n_links, 0) AS n_links FROM least LEFT JOIN counted ON least.doc_id = x
"""
)
