"""SQL for DuckDB that gives the same rows as the queries.

Patterns there know ASCII only, so texts are searched with other characters replaced by an
underscore, which is a word character too; places stay the same. The made-up forms are ASCII.
"""

from __future__ import annotations

import re

from ..functions import names, places, rules
from ..operators import name_lists, redact, review
from . import corpus
from .queries import DENY

_FORMS = f"forms AS ({corpus.forms_sql()})"
_SEGMENTS = f"{_FORMS}, segments AS ({corpus.segments_sql()})"
_ASCII = r"regexp_replace({t}, '[^\x00-\x7F]', '_', 'g')"


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_lit(v) for v in values) + ")"


def found(table: str, rx: str, *, keys: str = "doc_id", text: str = "text", group: int = 0, masked: bool = False, cut: str | None = None) -> str:
    """Rows of a pattern's matches: keys, start_at, end_at, match, source text t."""
    t = _ASCII.replace("{t}", f"coalesce({text}, '')") if masked else f"coalesce({text}, '')"
    own = f"regexp_extract_all(t, {_lit(rx)}, {group})" if group else "ms"
    inner = (
        f"SELECT {keys}, t, ms, {own} AS os, list_transform(range(1, len(ms) + 1), lambda i: "
        "list_sum(list_transform(gs[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i], lambda x: len(x))), 0)) AS ends "
        f"FROM (SELECT {keys}, {t} AS t, regexp_extract_all({t}, {_lit(rx)}) AS ms, string_split_regex({t}, {_lit(rx)}) AS gs FROM {table})"
    )
    return f"SELECT {keys}, t, CAST(e - len(o) AS BIGINT) AS start_at, CAST(e AS BIGINT) AS end_at, o AS match FROM (SELECT {keys}, t, unnest(os) AS o, unnest(ends) AS e FROM ({inner}))"


_VALID = {
    "D04": "regexp_matches(regexp_replace(regexp_replace(match, '[^0-9]', '', 'g'), '^(?:234|0)', ''), '^[789][01][0-9]{8}$')",
    "D06": "2 * len(regexp_replace(match, '[^0-9]', '', 'g')) >= len(regexp_replace(match, '[^0-9A-Za-z]', '', 'g'))",
}


def _near(start: str = "start_at") -> str:
    return f"lower(array_to_string(string_split(trim(regexp_replace(t[greatest({start} - 100, 0) + 1:{start}], '\\s+', ' ', 'g')), ' ')[-5:], ' '))"


def _score(r: rules.PatternRule) -> str:
    if r.valid:
        return "1.0"
    if not r.context:
        return str(float(r.score))
    seen = " OR ".join(f"contains({_near()}, {_lit(w.lower())})" for w in r.context)
    return f"CASE WHEN {seen} THEN {round(min(1.0, max(0.4, r.score + 0.35)), 2)} ELSE {float(r.score)} END"


def rule_rows(table: str, which=rules.RULES, keys: str = "doc_id", masked: bool = False) -> str:
    """keys, start_at, end_at, match, rule_id, entity_type, ord, score of valid matches."""
    parts = []
    for i, r in enumerate(rules.RULES):
        if r in which:
            parts.append(f"SELECT {keys}, t, start_at, end_at, match, '{r.rule_id}' AS rule_id, '{r.entity_type}' AS entity_type, {i} AS ord, CAST({_score(r)} AS DOUBLE) AS score FROM ({found(table, '(?i)' + r.regex, keys=keys, masked=masked)}) WHERE {_VALID.get(r.rule_id, 'true')}")
    return " UNION ALL ".join(parts)


def _rule(i: str) -> rules.PatternRule:
    return next(r for r in rules.RULES if r.rule_id == i)


_KIND = {k: "(?i)" + r"\b(?:" + "|".join(sorted((re.escape(x).replace(r"\ ", " ").replace(r"\-", "-") for x in terms), key=lambda x: (-len(x), x))) + r")\b" for k, terms in {"LGA": {a for a, _ in places.SAMPLE_LGAS}, "STATE_OF_ORIGIN": {*places.STATES, *places.STATE_ALIASES}, "ETHNIC_GROUP": set(places.ETHNIC_GROUPS), "DENY": set(DENY)}.items()}
_TITLE, _LABEL = (rx.replace("(?iU)", "(?i)") for rx in (names.DEFAULT.title, names.DEFAULT.label))
_ADDRESS = r"\b\d{1,4}[A-Za-z]?,?\s+[A-Z][a-zA-Z\s]{2,40}(?:" + "|".join(names.ROADS) + r")\b"
_WORDS = "list_filter(string_split_regex(match, '\\s+'), lambda w: w <> '')"
_SHARE = f"CASE WHEN len({_WORDS}) > 0 THEN len(list_filter({_WORDS}, lambda w: trim(lower(w), '''-') IN {_in(names.DEFAULT.parts)})) / len({_WORDS}) ELSE 0.0 END"
_STOP = f"coalesce({_WORDS}[1] IN {_in(names.STOP_FIRST)}, false)"
_FORM = f"(len({_WORDS}) > 0 AND len(list_filter({_WORDS}, lambda w: NOT (trim(rtrim(lower(w), '''s'), '''-') IN {_in(names.DEFAULT.vocabulary)}))) = 0)"


def _plain(sql: str, with_: str = _FORMS, columns: str = "doc_id, start_at, end_at, match") -> str:
    return f"WITH {with_} SELECT {columns} FROM ({sql})"


def name_rows(table: str, keys: str = "doc_id", masked: bool = False) -> str:
    one = lambda rx, group, rank, score, more: f"SELECT {keys}, start_at, end_at, match, {rank} AS rank, {score} AS score FROM ({found(table, rx, group=group, keys=keys, masked=masked)}) WHERE NOT {_STOP} AND NOT {_FORM}{more}"
    parts = [one(_LABEL, 1, 0, f"least(0.95, 0.7 + 0.15 * ({_SHARE}))", ""), one(_TITLE, 1, 1, f"least(0.95, 0.75 + 0.15 * ({_SHARE}))", ""), one(names.SHAPE, 0, 2, f"0.5 + 0.2 * ({_SHARE})", f" AND len({_WORDS}) >= 2 AND ({_SHARE}) >= 0.5")]
    return f"SELECT {keys}, start_at, end_at, match, CAST(score AS DOUBLE) AS score FROM ({' UNION ALL '.join(parts)}) QUALIFY row_number() OVER (PARTITION BY {keys}, start_at, end_at ORDER BY rank) = 1"


def context_rows(table: str, keys: str = "doc_id", masked: bool = False) -> str:
    parts = [f"SELECT {keys}, start_at, end_at, match, '{k}' AS entity_type, {i} AS ord, CAST({places.SCORES[k]} AS DOUBLE) AS score FROM ({found(table, _KIND[k], keys=keys, masked=masked)})" for i, k in enumerate(places.SCORES)]
    parts.append(f"SELECT {keys}, start_at, end_at, match, 'PERSON_NAME' AS entity_type, 3 AS ord, round(score, 2) AS score FROM ({name_rows(table, keys, masked)})")
    parts.append(f"SELECT {keys}, start_at, end_at, match, 'ADDRESS' AS entity_type, 4 AS ord, CAST(0.5 AS DOUBLE) AS score FROM ({found(table, _ADDRESS, keys=keys, masked=masked)})")
    return " UNION ALL ".join(parts)


def union_rows(table: str, keys: str = "doc_id", deny: bool = True, masked: bool = False) -> str:
    """All detections with src and the order within their source."""
    pattern = f"SELECT {keys}, start_at, end_at, match, entity_type, 0 AS src, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, start_at, end_at, ord) - 1 AS ord, score, 'pattern' AS source FROM ({rule_rows(table, keys=keys, masked=masked)})"
    out = f"{pattern} UNION ALL SELECT {keys}, start_at, end_at, match, entity_type, 1, ord, score, 'local_context' FROM ({context_rows(table, keys, masked)})"
    if deny:
        out += f" UNION ALL SELECT {keys}, start_at, end_at, match, 'PERSON_NAME', 0, 1000, 0.65, 'pattern' FROM ({found(table, _KIND['DENY'], keys=keys)})"
    return out


def resolved_rows(table: str, keys: str = "doc_id", deny: bool = True, rows: str | None = None) -> str:
    """The fold over each document's detections in order, as a list that starts with one of them."""
    prio = lambda x: f"(CASE WHEN {x}.source = 'ner' AND {x}.entity_type IN {_in(rules.MODEL_TYPES)} THEN 1 WHEN {x}.source = 'local_context' AND {x}.entity_type IN {_in(rules.CONTEXT_TYPES)} THEN 2 WHEN {x}.source = 'pattern' AND {x}.entity_type IN {_in(rules.PATTERN_TYPES)} THEN 3 ELSE 4 END)"
    a, b = "acc[-1]", "x[1]"
    newer = f"CASE WHEN {prio(a)} <> {prio(b)} THEN {prio(b)} < {prio(a)} WHEN {prio(a)} < 4 THEN false ELSE {b}.score > {a}.score OR ({b}.score = {a}.score AND {b}.end_at - {b}.start_at > {a}.end_at - {a}.start_at) END"
    wide = lambda w: f"CASE WHEN {a}.entity_type = {b}.entity_type THEN {{'start_at': least({a}.start_at, {b}.start_at), 'end_at': greatest({a}.end_at, {b}.end_at), 'src': {w}.src, 'ord': {w}.ord, 'entity_type': {w}.entity_type, 'score': {w}.score, 'source': {w}.source}} ELSE {w} END"
    fold = f"list_reduce(dets, lambda acc, x: CASE WHEN {a}.start_at < {b}.end_at AND {b}.start_at < {a}.end_at THEN list_concat(acc[:-2], [CASE WHEN {newer} THEN {wide(b)} ELSE {wide(a)} END]) ELSE list_concat(acc, x) END)"
    dets = f"SELECT {keys}, list([{{'start_at': start_at, 'end_at': end_at, 'src': CAST(src AS INT), 'ord': CAST(ord AS INT), 'entity_type': entity_type, 'score': CAST(score AS DOUBLE), 'source': source}}] ORDER BY start_at, end_at, src, ord, entity_type) AS dets FROM ({rows or union_rows(table, keys, deny)}) GROUP BY {keys}"
    return f"SELECT {keys}, e.start_at, e.end_at, e.entity_type, e.score, e.source FROM (SELECT {keys}, unnest({fold}) AS e FROM ({dets}))"


_RESOLVED = f"{_FORMS}, r AS ({resolved_rows('forms')}), resolved AS (SELECT r.*, text[start_at + 1:end_at] AS match FROM r JOIN forms ON r.doc_id = forms.doc_id)"
_ENTITY = "doc_id, start_at, end_at, entity_type, score, source, match"

# pages of words
_PAGE = f"""raw AS ({corpus.ocr_words_sql()}),
w AS (SELECT * REPLACE (trim(text) AS text) FROM raw WHERE level = 5 AND conf >= 0 AND trim(text) <> ''),
o AS (SELECT *, lag(block_num) OVER p AS pb, lag(line_num) OVER p AS pl FROM w WINDOW p AS (PARTITION BY doc_id, page_num ORDER BY block_num, line_num, word_num)),
s AS (SELECT *, CASE WHEN pb IS NULL THEN '' WHEN pb = block_num AND pl = line_num THEN ' ' ELSE chr(10) END AS sep FROM o),
placed AS (SELECT *, CAST(sum(len(sep) + len(text)) OVER p AS BIGINT) AS end_at, CAST(sum(len(sep) + len(text)) OVER p - len(text) AS BIGINT) AS start_at FROM s WINDOW p AS (PARTITION BY doc_id, page_num ORDER BY block_num, line_num, word_num)),
page AS (SELECT doc_id, page_num, string_agg(sep || text, '' ORDER BY block_num, line_num, word_num) AS page_text FROM placed GROUP BY doc_id, page_num),
first_ AS (SELECT doc_id, page_num, block_num, greatest(min(start_at) - 1, 0) AS b FROM placed GROUP BY doc_id, page_num, block_num),
blocks AS (SELECT f.doc_id, f.page_num, block_num, b, coalesce(lead(b) OVER (PARTITION BY f.doc_id, f.page_num ORDER BY block_num), len(page_text)) AS e, page_text FROM first_ f JOIN page ON f.doc_id = page.doc_id AND f.page_num = page.page_num),
seg AS (SELECT doc_id, block_num, b, page_text[b + 1:e] AS text FROM blocks),
found_ AS ({resolved_rows('seg', 'doc_id, block_num', deny=False)}),
ent AS (SELECT f.doc_id, 0 AS page_num, f.start_at + b AS start_at, f.end_at + b AS end_at, entity_type, score, source, text[f.start_at + 1:f.end_at] AS match FROM found_ f JOIN seg ON f.doc_id = seg.doc_id AND f.block_num = seg.block_num)"""

# numbered entities of segments
_SEGENT = f"""{_SEGMENTS},
sr AS ({resolved_rows('segments', 'doc_id, seg_no', deny=False)}),
se AS (SELECT sr.doc_id, sr.seg_no, start_at, end_at, entity_type, score, source, text[start_at + 1:end_at] AS match FROM sr JOIN segments s ON sr.doc_id = s.doc_id AND sr.seg_no = s.seg_no),
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg_no, start_at, end_at, entity_type, score) - 1 AS id FROM se)"""
_REDACTED_TYPES = ("NG_NIN", "NG_BVN", "NG_TIN", "NG_NUBAN", "EMAIL_ADDRESS", "NG_PLATE")


def _claims(types) -> str:
    """R01 for values that don't lie in one another within a segment: longer values first, then earlier ones."""
    return f"""{_SEGENT},
val AS (SELECT doc_id, match AS v, min(id) AS o FROM num WHERE entity_type IN {_in(types)} GROUP BY doc_id, match),
cand AS (SELECT s.doc_id, s.seg_no, s.text, v, o, unnest(list_transform(range(1, len(string_split(s.text, v))), lambda i: list_sum(list_transform(string_split(s.text, v)[1:i], lambda x: len(x))) + (i - 1) * len(v))) AS st FROM segments s JOIN val ON s.doc_id = val.doc_id AND contains(s.text, v)),
claim AS (SELECT doc_id, seg_no, text, v, o, CAST(st AS BIGINT) AS st, CAST(st + len(v) AS BIGINT) AS en FROM cand c
          WHERE NOT EXISTS (SELECT 1 FROM cand d WHERE d.doc_id = c.doc_id AND d.seg_no = c.seg_no AND d.st < c.st + len(c.v) AND c.st < d.st + len(d.v) AND (len(d.v) > len(c.v) OR (len(d.v) = len(c.v) AND (d.o < c.o OR (d.o = c.o AND d.st < c.st))))))"""


_CLAIMS = _claims(_REDACTED_TYPES)
_PIECES = "SELECT doc_id, seg_no, text, list({'st': st, 'en': en, 'v': v} ORDER BY st) AS c FROM claim GROUP BY doc_id, seg_no, text"
_REWRITTEN = f"""rew AS (SELECT doc_id, seg_no, list_reduce(list_prepend('', list_transform(range(1, len(c) + 1), lambda i: text[CASE WHEN i = 1 THEN 1 ELSE c[i - 1].en + 1 END:c[i].st] || '{redact.LABEL}')), lambda a, b: a || b) || text[c[-1].en + 1:] AS redacted FROM ({_PIECES}))"""
_TRAIL = f"""{_CLAIMS},
hits AS (SELECT doc_id, v, list(seg_no + 1 ORDER BY seg_no) AS paras, count(*) AS n FROM claim GROUP BY doc_id, v),
lst AS (SELECT doc_id, match AS v, arg_max(entity_type, id) AS entity_type, arg_max(score, id) AS score FROM num WHERE entity_type IN {_in(_REDACTED_TYPES)} GROUP BY doc_id, match),
trail AS (SELECT hits.*, entity_type, score FROM hits JOIN lst ON hits.doc_id = lst.doc_id AND hits.v = lst.v)"""


_DETAIL = f"det AS (SELECT doc_id, entity_type, CAST(paras[1] AS BIGINT) AS place, 'Paragraph(s) ' || array_to_string(list_transform(paras[1:6], lambda x: CAST(x AS VARCHAR)), ', ') || CASE WHEN len(paras) > 6 THEN ', ... (+' || (len(paras) - 6) || ' more)' ELSE '' END || ' (' || n || ' occurrence' || CASE WHEN n <> 1 THEN 's' ELSE '' END || ')' AS location, printf('%.1f%%', score * 100) AS confidence_text, n AS occurrence_count FROM trail)"
_LINE = "string_agg(printf('%06d-%06d:%s', start_at, end_at, entity_type), ',' ORDER BY start_at, end_at, entity_type)"


def _filed() -> str:
    """Claims of all that is found in the forms' files, which have no 22nd segment."""
    plain = _claims(sorted({r.entity_type for r in rules.RULES} | set(rules.CONTEXT_TYPES)))
    own = f"segments AS (SELECT doc_id, CAST(n - 1 AS INT) AS seg_no, split_part(text, chr(10), n) AS text FROM forms CROSS JOIN (SELECT unnest(range(1, 22)) AS n))"
    return plain.replace(_SEGMENTS, f"{_FORMS}, {own}")


def _policy() -> str:
    parts = []
    every = [*((p, p, review.POLICIES[p]) for p in review.POLICIES), ("Custom: NG_NIN, NO_SUCH_TYPE", "", ("NG_NIN",)), ("Custom: none", "", ("-",)), (review.EVERYTHING, "", None)]
    for label, _, types in every:
        ok = "true" if types is None else f"entity_type IN {_in(sorted(types))}"
        parts.append(f"SELECT count(*) FILTER ({ok}) AS n_approved, count(*) FILTER (NOT ({ok})) AS n_rejected, {_lit(label)} AS policy FROM num")
    return f"WITH {_SEGENT} " + " UNION ALL ".join(parts)


_RUNS = rf"""{_FORMS},
f AS (SELECT 'run' || CAST(doc_id % 2 AS VARCHAR) AS run, doc_id, text, regexp_replace(regexp_replace(text, '(NIN: )[0-9]+', '\1[REDACTED]', 'g'), '(Licence )[A-Z0-9]+', '\1[REDACTED]', 'g') AS red FROM forms),
truth AS (SELECT run, doc_id, string_split(x, ' ')[1] AS type, string_split(x, ' ')[-1] AS item FROM (SELECT run, doc_id, unnest([split_part(text, chr(10), 2), split_part(text, chr(10), 11)]) AS x FROM f)),
plain AS MATERIALIZED (SELECT run, doc_id, trim(regexp_replace(red, '\s+', ' ', 'g')) AS x FROM f),
item AS (SELECT t.run, t.doc_id, type, item, CASE WHEN contains(x, item) THEN regexp_matches(x, '(^|[^\w-])' || item || '([^\w-]|$)') ELSE false END AS left_ FROM truth t JOIN plain ON t.run = plain.run AND t.doc_id = plain.doc_id),
bag AS (SELECT run, doc_id, side, word, count(*) AS n FROM (SELECT run, doc_id, side, trim(unnest(string_split(trim(regexp_replace(x, '\s+', ' ', 'g')), ' ')), '.,;:()"''') AS word FROM (SELECT run, doc_id, 'a' AS side, text AS x FROM f UNION ALL SELECT run, doc_id, 'b', red FROM f UNION ALL SELECT run, doc_id, 'g', item FROM truth)) WHERE word NOT IN ('', '[REDACTED]') GROUP BY run, doc_id, side, word),
cnt AS (SELECT run, doc_id, word, coalesce(sum(n) FILTER (side = 'a'), 0) AS a, coalesce(sum(n) FILTER (side = 'b'), 0) AS b, coalesce(sum(n) FILTER (side = 'g'), 0) AS g FROM bag GROUP BY run, doc_id, word),
sc AS (SELECT run, doc_id, word, greatest(a - b, 0) AS r, g FROM cnt),
tot AS (SELECT run, CAST(sum(least(r, g)) AS BIGINT) AS tp, CAST(sum(greatest(r - g, 0)) AS BIGINT) AS fp, CAST(sum(greatest(g - r, 0)) AS BIGINT) AS fn FROM sc GROUP BY run)"""
_PRF = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r"
_PERSON = rf"""lines AS ({corpus.conll_sql()}),
tok AS (SELECT file, line_no, string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' ') AS p FROM lines),
runs AS (SELECT file, line_no, p[1] AS token, p[2] AS tag, sum(CASE WHEN p[2] <> 'I-PER' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no) AS run FROM tok WHERE len(p) = 2 AND p[1] <> ''),
person AS (SELECT DISTINCT file, span FROM (SELECT file, run, string_agg(token, ' ' ORDER BY line_no) AS span, arg_min(tag, line_no) AS head FROM runs GROUP BY file, run) WHERE head = 'B-PER')"""
_TIDY = r"""trim(regexp_replace({x}, '\s*-\s*', '-', 'g'), ' .,;:''"()-')"""
_OK = f"regexp_matches(name, '\\p{{L}}') AND lower(name) NOT IN {_in(name_lists.STOP_WORDS)}"
_STRIPPED = r"""replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?i)</?(?:p|div|li|h[1-6]|br|tr|article|nav|ul|ol|table)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"""
_TURNS = f"turns AS (SELECT conv_id AS doc_id, turn AS page_num, text FROM conversations), hit AS (SELECT DISTINCT doc_id, page_num FROM ({union_rows('turns', 'doc_id, page_num', deny=False, masked=True)})), flag AS (SELECT t.doc_id, t.page_num, len(trim(regexp_replace(t.text, '^\\s+|\\s+$', '', 'g'))) >= 15 AND hit.doc_id IS NULL AND len(t.text) < 100 AS flagged FROM turns t LEFT JOIN hit ON t.doc_id = hit.doc_id AND t.page_num = hit.page_num)"
_MARK = '<mark style="background-color:' + redact.APPROVED + '; padding:1px 2px; border-radius:3px;">'
_GREY = '<mark style="background-color:' + redact.REJECTED + '; padding:1px 2px; border-radius:3px;">'
_SUM = "count(*) FILTER (ok) AS n_approved, count(*) FILTER (NOT ok) AS n_rejected"

_HTML = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _preview() -> str:
    types = sorted({r.entity_type for r in rules.RULES} | set(rules.CONTEXT_TYPES))
    mark = f"CASE WHEN ok THEN {_lit(_MARK)} ELSE {_lit(_GREY)} END"
    gap = _HTML.replace("{x}", "text[CASE WHEN i = 1 THEN 1 ELSE c[i - 1].en + 1 END:c[i].st]")
    tail = _HTML.replace("{x}", "text[c[-1].en + 1:]")
    return f"""WITH {_claims(types)},
st AS (SELECT doc_id, match AS v, bool_or(entity_type IN ('NG_NIN', 'NG_TIN')) AS ok FROM num GROUP BY doc_id, match),
pc AS (SELECT cl.doc_id, seg_no, text, list({{'st': st, 'en': en, 'h': {mark} || {_HTML.replace("{x}", "cl.v")} || '</mark>'}} ORDER BY st) AS c FROM claim cl JOIN st ON cl.doc_id = st.doc_id AND cl.v = st.v GROUP BY cl.doc_id, seg_no, text),
hx AS (SELECT doc_id, seg_no, list_reduce(list_prepend('', list_transform(range(1, len(c) + 1), lambda i: {gap} || c[i].h)), lambda a, b: a || b) || {tail} AS html FROM pc)
SELECT s.doc_id, s.seg_no, '<p>' || coalesce(html, {_HTML.replace("{x}", "s.text")}) || '</p>' AS html FROM segments s LEFT JOIN hx ON s.doc_id = hx.doc_id AND s.seg_no = hx.seg_no WHERE trim(s.text) <> ''"""


def _whole() -> str:
    return f"""WITH r AS ({resolved_rows('documents', rows=union_rows('documents', deny=False, masked=True))}),
pc AS (SELECT doc_id, list({{'st': start_at, 'en': end_at}} ORDER BY start_at) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(c), 0) AS BIGINT) AS n, md5(CASE WHEN c IS NULL THEN coalesce(text, '') ELSE list_reduce(list_prepend('', list_transform(range(1, len(c) + 1), lambda i: text[CASE WHEN i = 1 THEN 1 ELSE c[i - 1].en + 1 END:c[i].st] || '{redact.LABEL}')), lambda a, b: a || b) || text[c[-1].en + 1:] END) AS digest
FROM documents d LEFT JOIN pc ON d.doc_id = pc.doc_id"""


ORACLES: dict[str, str] = {
    "fixed_id_spans": f"WITH {_FORMS} SELECT doc_id, start_at, end_at, match, rule_id, entity_type FROM ({rule_rows('forms')})",
    "fixed_id_counts": f"WITH {_FORMS} SELECT rule_id, entity_type, count(*) AS n FROM ({rule_rows('forms')}) GROUP BY rule_id, entity_type",
    "phone_validated": f"WITH {_FORMS}, m AS ({found('forms', '(?i)' + _rule('D04').regex)}) SELECT f.doc_id, count(m.match) AS n_raw, count(m.match) FILTER ({_VALID['D04']}) AS n_valid FROM forms f LEFT JOIN m ON f.doc_id = m.doc_id GROUP BY f.doc_id",
    "vin_raw_vs_validated": f"WITH m AS ({found('documents', '(?i)' + _rule('D06').regex, keys='doc_id, lang', masked=True)}) SELECT l.lang, count(m.match) AS n_raw, count(m.match) FILTER ({_VALID['D06']}) AS n_valid FROM (SELECT DISTINCT lang FROM documents) l LEFT JOIN m ON l.lang = m.lang GROUP BY l.lang",
    "email_spans_documents": _plain(found("documents", "(?i)" + _rule("D16").regex, masked=True), "z AS (SELECT 1)"),
    "context_boosted_scores": f"WITH {_FORMS} SELECT doc_id, start_at, end_at, entity_type, score, 'pattern' AS source, match FROM ({rule_rows('forms')})",
    "requested_types_only": f"WITH {_FORMS} SELECT doc_id, start_at, end_at, entity_type, score, 'pattern' AS source, match FROM ({rule_rows('forms', [r for r in rules.RULES if r.entity_type in ('NG_TIN', 'NG_NYSC')])})",
    "deny_list_hits": _plain(found("forms", _KIND["DENY"])),
    "lga_hits_by_state": f"WITH {_FORMS}, m AS ({found('forms', _KIND['LGA'])}), areas AS (SELECT * FROM (VALUES {', '.join(f'({_lit(a)}, {_lit(s)}, {i})' for i, (a, s) in enumerate(places.SAMPLE_LGAS))}) v(lga, state, ord)), by_ AS (SELECT lga, arg_max(state, ord) AS state FROM areas GROUP BY lga) SELECT state, lga, count(*) AS n FROM m LEFT JOIN by_ ON lower(match) = lower(lga) GROUP BY state, lga",
    "state_hits": _plain(found("forms", _KIND["STATE_OF_ORIGIN"])),
    "ethnic_hits": _plain(found("forms", _KIND["ETHNIC_GROUP"])),
    "titled_names": _plain(found("forms", _TITLE, group=1)),
    "labelled_names": _plain(found("forms", _LABEL, group=1)),
    "bare_names": f"WITH {_FORMS} SELECT doc_id, start_at, end_at, match, round({_SHARE}, 6) AS share, {_STOP} AS is_stop, {_FORM} AS is_form FROM ({found('forms', names.SHAPE)})",
    "name_scores": f"WITH {_FORMS} SELECT doc_id, start_at, end_at, match, round(score, 6) AS score FROM ({name_rows('forms')})",
    "addresses": _plain(found("forms", _ADDRESS)),
    "context_detections": f"WITH {_FORMS} SELECT doc_id, start_at, end_at, entity_type, score, 'local_context' AS source, match FROM ({context_rows('forms')})",
    "union_counts": f"WITH {_FORMS}, u AS ({union_rows('forms')}) SELECT doc_id, count(*) FILTER (src = 0) AS n_pattern, count(*) FILTER (src = 1) AS n_context FROM u GROUP BY doc_id",
    "merged_entities": f"WITH {_RESOLVED} SELECT {_ENTITY} FROM resolved",
    "merged_counts_by_source": f"WITH {_RESOLVED} SELECT source, entity_type, count(*) AS n FROM resolved GROUP BY source, entity_type",
    "widened_names": f"WITH {_RESOLVED}, u AS ({union_rows('forms')}) SELECT {_ENTITY} FROM resolved WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.doc_id = resolved.doc_id AND u.start_at = resolved.start_at AND u.end_at = resolved.end_at)",
    "uncovered_chars": f"WITH {_RESOLVED}, u AS ({union_rows('forms')}), a AS (SELECT DISTINCT doc_id, unnest(range(start_at, end_at)) AS c FROM u), b AS (SELECT DISTINCT doc_id, unnest(range(start_at, end_at)) AS c FROM resolved) SELECT f.doc_id, count(c) AS n FROM forms f LEFT JOIN (SELECT * FROM a EXCEPT SELECT * FROM b) x ON f.doc_id = x.doc_id GROUP BY f.doc_id",
    "page_text_assembly": f"WITH {_PAGE} SELECT page.doc_id, page.page_text, (SELECT string_agg(start_at || '-' || end_at, ',' ORDER BY start_at) FROM placed p WHERE p.doc_id = page.doc_id) AS words, (SELECT string_agg(b || '-' || e, ',' ORDER BY b) FROM blocks k WHERE k.doc_id = page.doc_id) AS blocks FROM page",
    "segment_offsets": f"WITH {_PAGE} SELECT {_ENTITY} FROM ent",
    "stitched_addresses": "SELECT s_suppkey AS doc_id, CAST(0 AS BIGINT) AS start_at, CAST(CASE WHEN s_suppkey % 3 = 2 THEN 12 ELSE 25 END AS BIGINT) AS end_at, 'ADDRESS' AS entity_type, CAST(CASE WHEN s_suppkey % 3 = 2 THEN 0.5 ELSE 0.6 END AS DOUBLE) AS score, 'local_context' AS source, CASE s_suppkey % 3 WHEN 0 THEN '12 Hill Road 3 Palm Close' WHEN 1 THEN '12 Hill Road' || chr(10) || '3 Palm Close' ELSE '12 Hill Road' END AS match FROM supplier UNION ALL SELECT s_suppkey, 15, 27, 'ADDRESS', 0.6, 'local_context', '3 Palm Close' FROM supplier WHERE s_suppkey % 3 = 2",
    "deduped_docx_entities": f"WITH {_SEGENT} SELECT doc_id, seg_no, start_at, end_at, entity_type, score, match FROM se QUALIFY row_number() OVER (PARTITION BY doc_id, match ORDER BY seg_no, start_at, end_at, entity_type) = 1",
    "ocr_low_confidence": f"WITH {_PAGE} SELECT e.doc_id, e.start_at, e.end_at, e.entity_type, min(p.conf) AS ocr_confidence, coalesce(min(p.conf) < 60, true) AS low_confidence FROM ent e LEFT JOIN placed p ON p.doc_id = e.doc_id AND p.start_at < e.end_at AND e.start_at < p.end_at GROUP BY e.doc_id, e.start_at, e.end_at, e.entity_type",
    "entity_rects": f"WITH {_PAGE} SELECT e.doc_id, e.page_num, e.start_at, e.end_at, e.entity_type, CAST(lft AS DOUBLE) AS x0, CAST(top AS DOUBLE) AS y0, CAST(lft + width AS DOUBLE) AS x1, CAST(top + height AS DOUBLE) AS y1 FROM ent e JOIN placed p ON p.doc_id = e.doc_id AND p.start_at < e.end_at AND e.start_at < p.end_at",
    "page_class_counts": f"SELECT CASE WHEN len(regexp_replace({_STRIPPED}, '^\\s+|\\s+$', '', 'g')) < 15 THEN 'scanned' ELSE 'text' END AS page_class, count(*) AS n FROM pages GROUP BY 1",
    "garble_class_counts": f"WITH t AS (SELECT page_id AS doc_id, {_STRIPPED} AS x FROM pages), m AS (SELECT doc_id, len(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS n_chars, len(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> '')) AS n_words, CASE WHEN len(regexp_replace(x, '\\s', '', 'g')) > 0 THEN len(regexp_replace(regexp_replace(x, '\\s', '', 'g'), '[^\\p{{L}}\\p{{N}}]', '', 'g')) / len(regexp_replace(x, '\\s', '', 'g')) ELSE 0.0 END AS ratio FROM t) SELECT doc_id, n_chars, n_words, round(ratio, 6) AS alnum_ratio, CASE WHEN n_chars = 0 THEN 'no text' WHEN ratio < 0.5 OR n_words < 3 THEN 'garbled' ELSE 'normal' END AS garble FROM m",
    "pages_flagged": f"WITH {_TURNS} SELECT doc_id, page_num FROM flag WHERE flagged",
    "flagged_pages": f"WITH {_TURNS} SELECT doc_id, coalesce(string_agg(CAST(page_num AS VARCHAR), ',' ORDER BY page_num) FILTER (flagged), '') AS flagged_pages FROM flag GROUP BY doc_id",
    "full_texts": "SELECT conv_id, len(string_agg(text, chr(10) ORDER BY turn)) AS n_chars, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id",
    "file_router": "SELECT s_suppkey AS doc_id, '/in/v1.2/file' || CAST(s_suppkey AS VARCHAR) || CASE s_suppkey % 6 WHEN 0 THEN '.DOCX' WHEN 1 THEN '.pdf' WHEN 2 THEN '.Tiff' WHEN 3 THEN '.jpeg' WHEN 4 THEN '.csv' ELSE '' END AS path, CASE s_suppkey % 6 WHEN 0 THEN 'docx' WHEN 1 THEN 'pdf' WHEN 2 THEN 'image' WHEN 3 THEN 'image' END AS file_type FROM supplier",
    "numbered_ids": f"WITH {_SEGENT} SELECT doc_id, id, seg_no, start_at, end_at, entity_type, true AS approved FROM num",
    "policy_approved_counts": _policy(),
    "decisions_applied": f"WITH {_SEGENT} SELECT entity_type, count(*) AS n FROM num WHERE id % 4 <> 1 GROUP BY entity_type",
    "unknown_decisions": f"WITH {_SEGENT} SELECT DISTINCT doc_id, CAST(1000 AS BIGINT) AS entity_id FROM num WHERE doc_id % 7 = 0",
    "review_summary": f"WITH {_SEGENT} SELECT doc_id, {_SUM}, count(*) FILTER (entity_type IN {_in(review.AMBIGUOUS)}) AS n_ambiguous, count(DISTINCT entity_type) AS n_types FROM (SELECT *, entity_type IN {_in(sorted(review.POLICIES['Financial IDs only']))} AS ok FROM num) GROUP BY doc_id",
    "friendly_labels": f"WITH {_SEGENT} SELECT DISTINCT entity_type, CASE entity_type " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in review.FRIENDLY.items()) + " ELSE entity_type END AS label FROM num",
    "manual_add_values": f"WITH {_SEGENT}, h AS (SELECT DISTINCT doc_id, match AS text FROM ({found('segments', '(?i)grace', keys='doc_id, seg_no')})), mx AS (SELECT doc_id, max(id) AS m FROM num GROUP BY doc_id) SELECT h.doc_id, m + row_number() OVER (PARTITION BY h.doc_id ORDER BY text) AS id, text, 'PERSON_NAME' AS entity_type, CAST(1.0 AS DOUBLE) AS score, 'manual' AS source FROM h JOIN mx ON h.doc_id = mx.doc_id",
    "manual_add_occurrences": f"WITH {_SEGENT}, h AS ({found('segments', '(?i)street', keys='doc_id, seg_no')}), mx AS (SELECT doc_id, max(id) AS m FROM num GROUP BY doc_id) SELECT h.doc_id, seg_no AS page_num, m + row_number() OVER (PARTITION BY h.doc_id ORDER BY seg_no, start_at) AS id, start_at, end_at, match AS text FROM h JOIN mx ON h.doc_id = mx.doc_id",
    "redacted_documents": f"WITH {_CLAIMS}, {_REWRITTEN} SELECT s.doc_id, s.seg_no, coalesce(redacted, s.text) AS redacted, redacted IS NOT NULL AS changed FROM segments s LEFT JOIN rew ON s.doc_id = rew.doc_id AND s.seg_no = rew.seg_no",
    "redaction_counts": f"WITH {_CLAIMS} SELECT doc_id, seg_no + 1 AS paragraph_index, v AS text, count(*) AS n FROM claim GROUP BY doc_id, seg_no, v",
    "redaction_summary": f"WITH {_CLAIMS} SELECT doc_id, count(DISTINCT v) AS entities_matched, count(DISTINCT seg_no) AS paragraphs_redacted FROM claim GROUP BY doc_id",
    "audit_by_type": f"WITH {_TRAIL} SELECT entity_type, count(*) AS n FROM trail GROUP BY entity_type",
    "audit_detail": f"WITH {_TRAIL}, {_DETAIL} SELECT * FROM det",
    "audit_totals": f"WITH {_TRAIL} SELECT doc_id, entity_type, count(*) AS n FROM trail GROUP BY ROLLUP (doc_id, entity_type)",
    "summary_lines": f"WITH {_TRAIL} SELECT doc_id, entity_type || ' | x' || n || ' | ' || array_to_string(list_transform(paras, lambda x: CAST(x AS VARCHAR)), ',') AS line FROM trail",
    "audit_report_html": f"WITH {_TRAIL}, {_DETAIL}, ty AS (SELECT doc_id, sum(n) AS total, string_agg('<tr><td>' || entity_type || '</td><td>' || n || '</td></tr>', '' ORDER BY n DESC, entity_type) AS types FROM (SELECT doc_id, entity_type, count(*) AS n FROM trail GROUP BY doc_id, entity_type) GROUP BY doc_id), rw AS (SELECT doc_id, string_agg('<tr><td>' || entity_type || '</td><td>' || location || '</td><td>' || confidence_text || '</td></tr>', '' ORDER BY place, entity_type, location, confidence_text) AS rows_ FROM det GROUP BY doc_id) SELECT ty.doc_id, '<html><body><h1>Redaction audit</h1><p>' || CAST(total AS BIGINT) || ' redacted values</p><table><tr><th>Type</th><th>Count</th></tr>' || types || '</table><table><tr><th>Type</th><th>Location</th><th>Confidence</th></tr>' || rows_ || '</table></body></html>' AS html FROM ty JOIN rw ON ty.doc_id = rw.doc_id",
    "detected_documents": f"WITH {_SEGENT} SELECT doc_id, id, seg_no, start_at, end_at, entity_type, score, source, match FROM num",
    "docx_segments_read": f"WITH {_FORMS} SELECT doc_id, 'form' || doc_id || '.docx' AS path, 'body' AS part, CAST(n - 1 AS BIGINT) AS seg_no, CAST(n AS BIGINT) AS paragraph_index, split_part(text, chr(10), n) AS text FROM forms CROSS JOIN (SELECT unnest(range(1, 22)) AS n)",
    "redacted_files": f"WITH {_filed()}, {_REWRITTEN} SELECT s.doc_id, CAST(s.seg_no + 1 AS BIGINT) AS paragraph_index, coalesce(redacted, s.text) AS text FROM segments s LEFT JOIN rew ON s.doc_id = rew.doc_id AND s.seg_no = rew.seg_no",
    "detections_side_by_side": f"WITH {_RESOLVED}, u AS ({union_rows('forms')}), a AS (SELECT doc_id, {_LINE} FILTER (src = 0) AS by_pattern, {_LINE} FILTER (src = 1) AS by_context FROM u GROUP BY doc_id), b AS (SELECT doc_id, {_LINE} AS merged FROM resolved GROUP BY doc_id) SELECT f.doc_id, coalesce(by_pattern, '') AS by_pattern, coalesce(by_context, '') AS by_context, coalesce(merged, '') AS merged FROM forms f LEFT JOIN a ON f.doc_id = a.doc_id LEFT JOIN b ON f.doc_id = b.doc_id",
    "ocr_entity_dump": f"WITH {_PAGE} SELECT e.doc_id, e.start_at, e.entity_type, e.match AS text, string_agg(p.text || '(' || CAST(round(p.conf) AS INT) || ')', ' ' ORDER BY p.start_at) AS shown FROM ent e JOIN placed p ON p.doc_id = e.doc_id AND p.start_at < e.end_at AND e.start_at < p.end_at GROUP BY e.doc_id, e.start_at, e.entity_type, e.match",
    "page_overlay": f"WITH {_PAGE} SELECT e.doc_id, e.start_at, e.entity_type, CASE WHEN e.entity_type = 'STATE_OF_ORIGIN' THEN 'manual' WHEN e.entity_type = 'PERSON_NAME' THEN 'rejected' ELSE 'approved' END AS colour, CAST(lft AS DOUBLE) AS x0, CAST(top AS DOUBLE) AS y0 FROM ent e JOIN placed p ON p.doc_id = e.doc_id AND p.start_at < e.end_at AND e.start_at < p.end_at",
    "preview_html": _preview(),
    "deny_list_joined": _plain(found("forms", _KIND["DENY"])),
    "merged_documents": f"WITH r AS ({resolved_rows('documents', rows=union_rows('documents', deny=False, masked=True))}) SELECT entity_type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM r GROUP BY entity_type",
    "redacted_whole_documents": _whole(),
    "page_audit_counts": f"WITH {_PAGE} SELECT entity_type, CAST(page_num + 1 AS INT) AS page_number, count(*) AS n FROM ent e WHERE EXISTS (SELECT 1 FROM placed p WHERE p.doc_id = e.doc_id AND p.start_at < e.end_at AND e.start_at < p.end_at) GROUP BY entity_type, page_num",
    "eval_report": f"WITH {_RUNS}, ty AS (SELECT run, type, count(*) FILTER (NOT left_) AS ok, count(*) AS n FROM item GROUP BY run, type), agg AS (SELECT run, CAST(sum(ok) AS BIGINT) AS items_ok, CAST(sum(n) AS BIGINT) AS items_total, '{{' || string_agg('\"' || type || '\":{{\"items_ok\":' || ok || ',\"items_total\":' || n || '}}', ',' ORDER BY type) || '}}' AS per_type FROM ty GROUP BY run) SELECT tot.run, tp, fp, fn, items_ok, items_total, per_type FROM tot JOIN agg ON tot.run = agg.run",
    "eval_item_recall": f"WITH {_RUNS} SELECT run, type, count(*) FILTER (NOT left_) AS items_ok, count(*) AS items_total FROM item GROUP BY run, type",
    "eval_leaked_items": f"WITH {_RUNS} SELECT run, doc_id, type, item FROM item WHERE left_",
    "eval_collateral": f"WITH {_RUNS} SELECT run, doc_id, word, CAST(r - g AS BIGINT) AS n FROM sc WHERE r > g",
    "eval_word_prf": f"WITH {_RUNS} SELECT run, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM (SELECT run, tp, fp, fn, {_PRF} FROM tot)",
    "conll_spans": f"WITH {_PERSON} SELECT file, span FROM person",
    "gazetteer_build": f"WITH {_PERSON}, tidied AS (SELECT {_TIDY.replace('{x}', 'span')} AS name FROM person), whole AS (SELECT name FROM tidied WHERE {_OK} AND len(name) >= CASE WHEN contains(name, ' ') THEN 1 ELSE 4 END), tokens AS (SELECT name FROM (SELECT {_TIDY.replace('{x}', 'w')} AS name FROM (SELECT unnest(string_split_regex(name, '\\s+')) AS w FROM whole)) WHERE {_OK} AND len(name) >= 4), both_ AS (SELECT name FROM whole UNION SELECT name FROM tokens) SELECT name FROM both_ UNION SELECT strip_accents(name) FROM both_",
    "error_kinds": "SELECT s_suppkey AS doc_id, CASE s_suppkey % 4 WHEN 0 THEN 'password' WHEN 1 THEN 'corrupt' ELSE 'other' END AS kind FROM supplier",
    "manifest_rows": f"WITH {_SEGENT} SELECT 'd' || CAST(doc_id AS VARCHAR) AS input_path, 'docx' AS file_type, count(*) AS n_spans, string_agg(id || ':' || entity_type || ':' || start_at, ',' ORDER BY id) AS ids FROM num GROUP BY doc_id",
}
