"""Made-up forms, from the keys of the tables by one SQL text that Spark and DuckDB read alike. All values are invented."""

from __future__ import annotations

_FIRST = ("Emeka", "Zuma", "Ngozi", "Aisha", "Tunde", "Grace")
_LAST = ("Adewale", "Okafor", "Zubair", "Bello", "Danladi", "Peter")
_AREA = ("Ikeja", "Surulere", "Obi", "Port Harcourt", "Kogi", "Ibadan North-East", "Bassa")
_STATE = ("Lagos", "FCT Abuja", "Edo", "Cross River", "Abuja")
_GROUP = ("Yoruba", "Shuwa Arab", "Edo", "Igbo")
_TITLE = ("Mr.", "Dr", "Chief", "Alhaja")
_ROAD = ("Hill Road", "Palm Tree Street", "Old Market Close")


def _pick(key: str, values: tuple[str, ...]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _number(key: str, digits: int, times: int, plus: int) -> str:
    return f"lpad(CAST(({key} * {times} + {plus}) % {10 ** min(digits, 15)} AS STRING), {digits}, '7')"


def forms_sql() -> str:
    """doc_id, text: a form for each customer, with identifiers, names, places, and lines that only look like them."""
    k = "c_custkey"
    name = f"{_pick(k, _FIRST)} || ' ' || {_pick(f'({k} + 1)', _LAST)}"
    lines = [
        f"'Full Name: ' || {name}",
        f"'NIN: ' || {_number(k, 11, 7919, 40000000000)}",
        f"'bank verification ' || {_number(k, 11, 104729, 22000000000)} || ' seen'",
        f"'Passport A' || {_number(k, 8, 31, 10000000)} || ', Plate: KJA ' || {_number(k, 3, 7, 100)} || ' QQ'",
        f"'Tel +234 80' || CAST({k} % 10 AS STRING) || ' ' || {_number(k, 3, 3, 100)} || ' ' || {_number(k, 4, 11, 1000)} || ' Next'",
        f"'Office 0601 ' || {_number(k, 3, 3, 100)} || ' 0001'",
        f"'voter card ' || {_number(k, 2, 3, 10)} || 'AA 11BB 2222 3333 4444'",
        "'seen abundant evidence'",
        f"'Licence ZZZ' || {_number(k, 5, 13, 10000)} || 'QQ' || {_number(k, 2, 7, 10)}",
        f"'TIN ' || {_number(k, 8, 17, 10000000)} || ' -' || {_number(k, 4, 19, 1000)}",
        f"'account number ' || {_number(k, 10, 23, 1000000000)}",
        f"'enrollee ' || {_number(k, 10, 29, 2000000000)}",
        f"'PEN' || {_number(k, 12, 37, 100000000000)}",
        f"'NYSC/ZZ/YYY/2000/' || {_number(k, 6, 41, 100000)} || ' or ZZ/00A/' || {_number(k, 4, 43, 1000)}",
        f"'RC ' || {_number(k, 7, 47, 1000000)}",
        f"'write to user' || CAST({k} AS STRING) || '@mail.example.com, ssn ' || {_number(k, 3, 5, 100)} || '-' || {_number(k, 2, 7, 10)} || '-' || {_number(k, 4, 9, 1000)}",
        f"'LGA: ' || {_pick(k, _AREA)} || ' in ' || {_pick(k, _STATE)} || ', ' || {_pick(k, _GROUP)}",
        f"{_pick(k, _TITLE)} || ' ' || {_pick(f'({k} + 2)', _LAST)} || ' lives at ' || CAST(1 + {k} % 400 AS STRING) || ' ' || {_pick(k, _ROAD)} || ' since ' || CAST(1990 + {k} % 30 AS STRING)",
        f"'The {_LAST[0]} and Grace {_LAST[1]} met.'",
        "'Next of Kin:'",
        "'Home Address'",
    ]
    return f"SELECT {k} AS doc_id, " + " || chr(10) || ".join(lines) + " AS text FROM customer"


def segments_sql() -> str:
    """doc_id, seg_no, text: the lines of the forms, and for every third document one of them again."""
    lines = "SELECT doc_id, CAST(n - 1 AS INT) AS seg_no, split_part(text, chr(10), n) AS text FROM forms CROSS JOIN (SELECT 1 AS n" + "".join(f" UNION ALL SELECT {i}" for i in range(2, 22)) + ") numbers"
    return f"SELECT * FROM ({lines}) a UNION ALL SELECT doc_id, 21 AS seg_no, split_part(text, chr(10), 2) || ' again ' || split_part(text, chr(10), 13) AS text FROM forms WHERE doc_id % 3 = 0"


def ocr_words_sql() -> str:
    """Words of scanned pages, from suppliers: two blocks of two lines, with words that don't count and low confidences."""
    k = "s_suppkey"
    word = {(1, 1, 1): "'Name'", (1, 1, 2): _pick(k, _FIRST), (1, 1, 3): _pick(f"({k} + 1)", _LAST), (1, 2, 1): "'NIN'", (1, 2, 2): _number(k, 11, 7919, 40000000000), (2, 1, 1): f"CAST(1 + {k} % 400 AS STRING)", (2, 1, 2): "'Palm'", (2, 1, 3): "'Street'", (2, 2, 1): _pick(k, _STATE), (2, 2, 2): "' '", (2, 2, 3): "'lost'"}
    rows = []
    for (b, l, w), text in word.items():
        conf = f"CAST(CASE WHEN {w} = 3 AND {b} = 2 AND {l} = 2 THEN -1 ELSE 55 + ({k} * 7 + {b} * 11 + {l} * 3 + {w}) % 40 END AS DOUBLE)"
        rows.append(f"SELECT {k} AS doc_id, 0 AS page_num, 5 AS level, {b} AS block_num, 1 AS par_num, {l} AS line_num, {w} AS word_num, {w * 60} AS lft, {b * 100 + l * 20} AS top, 50 AS width, 15 AS height, {conf} AS conf, {text} AS text FROM supplier")
    rows.append(f"SELECT {k} AS doc_id, 0 AS page_num, 4 AS level, 1 AS block_num, 1 AS par_num, 1 AS line_num, 0 AS word_num, 0 AS lft, 0 AS top, 900 AS width, 15 AS height, CAST(-1 AS DOUBLE) AS conf, '' AS text FROM supplier")
    return " UNION ALL ".join(rows)


def conll_sql() -> str:
    """file, line_no, line of tagged text, from suppliers: spans that begin anew, go on over blank lines, or have no begin."""
    k = "s_suppkey"
    lines = [f"{_pick(k, _FIRST)} || ' B-PER'", f"{_pick(f'({k} + 1)', _LAST)} || ' I-PER'", "'went O'", "'Ade B-PER'", "'Bola B-PER'", "''", "'Ojo-Kuti, I-PER'", "'in O'", "'Lost I-PER'", "'three columns here'", "'The B-PER'", "'Ohio B-PER'", f"{_pick(k, _LAST)} || ' B-PER'", "'- I-PER'", "'Odu I-PER'", "'Adérónkẹ B-PER'", "'Ọlá-Olú I-PER'", "'Ṣeun B-PER'"]
    return " UNION ALL ".join(f"SELECT CAST({k} AS STRING) AS file, CAST({i} AS BIGINT) AS line_no, {line} AS line FROM supplier" for i, line in enumerate(lines))
