"""Spans as column expressions: where a pattern matches, and how overlapping spans are resolved.

All expressions are row-local: no shuffle, no Python. Places are code points, from 0, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: The sort keys stand first, so sort_array() orders them as they are; array_sort() would run its comparator as an interpreted lambda.
SPAN = "struct<start:int,end:int,src:int,ord:int,entity_type:string,score:double,source:string,text:string>"
SPANS = f"array<{SPAN}>"
PLACE = "array<struct<text:string,start:int,end:int>>"
#: Unicode classes, boundaries and letter case for a Java pattern, as the rules mean them.
UNICODE, ANY_CASE = "(?U)", "(?iU)"


def none(kind: str = SPANS) -> Column:
    return F.array().cast(kind)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once. Functions of arrays are interpreted and share no equal parts, so what they use more than once is bound here."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


#: Entries that a fold holds at once in running().
BLOCK = 64


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each entry op (a sum or greatest(), from 0) over all entries up to it.

    A fold that appends to an array copies it each time, so values are folded in blocks, and so are
    the blocks' ends: work grows with the number of entries (and only its square over 64 twice).
    """
    def fold(v: Column) -> Column:
        return F.aggregate(v, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    def carried(blocks: Column) -> Column:
        ends = fold(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return let(ends, lambda base: F.flatten(F.transform(blocks, lambda b, i: F.transform(F.slice(b, F.lit(2), F.size(b)), lambda x: op(F.get(base, i), x)))))

    numbers = lambda v: F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / BLOCK).cast("int") - 1, F.lit(0)))
    return let(values, lambda v: let(F.transform(numbers(v), lambda k: fold(F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))), carried))


#: Stands at both ends of a match in a marked text, and what stands for it if the text itself has it. Neither is of a word, white space or in a pattern.
_MARK, _OTHER = "\x01", "\x02"


def _first_group(pattern: str) -> int:
    """Where a pattern's first group with a number opens."""
    return re.search(r"(?<!\\)\((?!\?)", pattern).start()


def seen(text: Column, pattern: str) -> Column:
    """Whether a pattern matches somewhere; Unicode classes as in parts()."""
    flags, body = _flags(pattern)
    if not flags:
        return text.rlike(pattern)
    return F.when(F.octet_length(text) == F.char_length(text), text.rlike(_plain(flags) + body)).otherwise(text.rlike(pattern))


def _flags(pattern: str) -> tuple[str, str]:
    flags = next((f for f in (ANY_CASE, UNICODE) if pattern.startswith(f)), "")
    return flags, pattern[len(flags) :]


def _plain(flags: str) -> str:
    return flags.replace("U", "").replace("(?)", "")


def parts(text: Column, pattern: str, group: int = 0, guard: str | Column | None = None) -> Column:
    """What stands before the first match, the match, what stands before the next one, and so on (an odd number of strings).

    The pattern runs once, and a literal split parts what it marked. group: 1 to have the first
    group alone as the match; the pattern must end with it. In a text of ASCII alone Unicode classes
    mean the same as plain ones, which are faster. guard: see matches().
    """
    plain = F.translate(text, _MARK, _OTHER)
    (flags, body), new = _flags(pattern), f"{_MARK}$0{_MARK}"
    if group:
        at = _first_group(body)
        body, new = f"({body[:at]}){body[at:]}", f"$1{_MARK}$2{_MARK}"
    done = F.regexp_replace(plain, F.lit(flags + body), F.lit(new))
    if flags:
        done = F.when(F.octet_length(text) == F.char_length(text), F.regexp_replace(plain, F.lit(_plain(flags) + body), F.lit(new))).otherwise(done)
    some = F.split(done, _MARK, -1)
    if guard is None:
        return some
    return F.when(text.rlike(guard) if isinstance(guard, str) else guard, some).otherwise(F.array(text))


def matches(text: Column, pattern: str, group: int = 0, guard: str | Column | None = None) -> Column:
    """All matches as PLACE, by start. group: of each match only that group, which must end where the match ends.

    The parts between matches and the matches alternate, so the running sum of their lengths gives
    the places (D01 to D16). guard: a cheap pattern that every text with a match has, or whether this one has it;
    others are not searched.
    """
    return let(parts(text, pattern, group, guard), placed)


def placed(p: Column) -> Column:
    """PLACE of each second part."""
    one = lambda x, end: F.struct(x.alias("text"), (end - F.length(x)).alias("start"), end.alias("end"))
    found = let(running(F.transform(p, F.length), lambda a, b: a + b), lambda ends: F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), lambda i: one(F.get(p, i), F.get(ends, i))))
    return F.when(F.size(p) > 2, found).otherwise(none(PLACE))


#: Words before a match that count as its context, of at most so many characters; and how many parts hold these at most, as every rule's match has seven characters.
CONTEXT_WORDS, CONTEXT_CHARS, CONTEXT_PARTS = 5, 100, 30


def tails(p: Column, chars: int, most: int) -> Column:
    """For each second part the last characters before it, so many at most, which so many parts hold for certain."""
    cut = lambda x: F.right(x, F.lit(chars))
    near = lambda t: F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), lambda i: cut(F.array_join(F.slice(t, F.greatest(i - most, F.lit(0)) + 1, F.least(i, F.lit(most))), "")))
    return let(F.transform(p, cut), near)


def before(p: Column) -> Column:
    """For each second part the last words before it in lower case."""
    words = lambda near: F.lower(F.substring_index(F.trim(F.regexp_replace(near, r"\s+", " ")), " ", -CONTEXT_WORDS))
    return F.transform(tails(p, CONTEXT_CHARS, CONTEXT_PARTS), words)


def boosted(score: float, context: tuple[str, ...]) -> Callable[[Column], Column]:
    """The score by what before() gives: 0.35 more (0.4 at least, 1 at most) where a word or phrase of the context stands there."""
    if not context:
        return lambda near: F.lit(float(score))
    # one pattern, so that what stands before is cut out once
    seen = "|".join(re.escape(w.lower()) for w in context)
    return lambda near: F.when(near.rlike(seen), F.lit(round(min(1.0, max(0.4, score + 0.35)), 2))).otherwise(F.lit(float(score)))


def as_spans(places: Column, *, src: int, ord_: int, entity_type: str, source: str, score: Callable[[Column], Column]) -> Column:
    """PLACE to SPANS; score gets a place."""
    return F.transform(
        places,
        lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit(src).alias("src"), F.lit(ord_).alias("ord"), F.lit(entity_type).alias("entity_type"), F.round(score(p), 2).alias("score"), F.lit(source).alias("source"), p["text"].alias("text")),
    ).cast(SPANS)


def overlaps(a: Column, b: Column) -> Column:
    """Touching spans do not overlap; a span without a place overlaps none."""
    return F.coalesce((a["start"] < b["end"]) & (b["start"] < a["end"]), F.lit(False))


def slice_text(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start + 1, end - start)


def priority(s: Column, classes: dict[str, tuple[str, ...]]) -> Column:
    """1 to 3 where a source reports a type that is its own, in the order of classes; else 4."""
    out = F.lit(4)
    for k, (source, types) in reversed(list(enumerate(classes.items(), 1))):
        out = F.when((s["source"] == source) & s["entity_type"].isin(*types), F.lit(k)).otherwise(out)
    return out


def united(a: Column, b: Column, text: Column) -> Column:
    """The text from the start of the first of two overlapping spans to the end of the last, from their own texts where they have them."""
    def two(x: Column, y: Column) -> Column:  # x starts first
        own = (F.length(x["text"]) == x["end"] - x["start"]) & (F.length(y["text"]) == y["end"] - y["start"])
        longer = F.when(own, F.concat(x["text"], F.substr(y["text"], x["end"] - y["start"] + 1))).otherwise(slice_text(text, x["start"], y["end"]))
        return F.when(y["end"] > x["end"], longer).when(F.length(x["text"]) == x["end"] - x["start"], x["text"]).otherwise(slice_text(text, x["start"], x["end"]))

    return F.when(a["start"] <= b["start"], two(a, b)).otherwise(two(b, a))


def clusters(spans: Column, kind: str = SPANS) -> Column:
    """Sorted spans (of that type) in runs: a span that starts where all before it have ended opens a new one."""
    def cut(s: Column) -> Column:
        def at(most: Column) -> Column:
            opens = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | F.coalesce(F.get(s, i)["start"] >= F.get(most, i - 1), F.lit(False)))
            return let(opens, lambda o: F.transform(o, lambda b, j: F.slice(s, b + 1, F.coalesce(F.get(o, j + 1), F.size(s)) - b)))

        return F.when(F.size(s) > 0, let(running(F.transform(s, lambda x: x["end"]), F.greatest), at)).otherwise(F.array().cast(f"array<{kind}>"))

    return let(spans, cut)


def folded(cluster: Column, text: Column, classes: dict[str, tuple[str, ...]]) -> Column:
    """M05 for one cluster: spans in order, each against the last kept one; of two that overlap one stays.

    The lesser priority stays; of equal ones under 4 the earlier; of two at 4 the higher score, then
    the longer, then the earlier. Where both have one type, what stays is widened over both (M04).
    """
    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        p, q = priority(last, classes), priority(s, classes)
        width = lambda x: x["end"] - x["start"]
        newer = F.when(p != q, q < p).when(p < 4, F.lit(False)).otherwise((s["score"] > last["score"]) | ((s["score"] == last["score"]) & (width(s) > width(last))))
        same = s["entity_type"] == last["entity_type"]
        lo, hi = F.least(s["start"], last["start"]), F.greatest(s["end"], last["end"])

        def one(w: Column) -> Column:
            wide = F.struct(lo.alias("start"), hi.alias("end"), w["src"].alias("src"), w["ord"].alias("ord"), w["entity_type"].alias("entity_type"), w["score"].alias("score"), w["source"].alias("source"), united(s, last, text).alias("text"))
            return F.when(same, wide.cast(SPAN)).otherwise(w)

        winner = F.transform(F.array(F.when(newer, s).otherwise(last)), one)
        clash = (F.size(acc) > 0) & overlaps(last, s)
        return F.when(clash, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), winner)).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(cluster, none(), step)


def resolve(spans: Column, text: Column, classes: dict[str, tuple[str, ...]]) -> Column:
    """Spans in order, resolved. Spans of different clusters don't touch, so the fold goes cluster by cluster."""
    return F.flatten(F.transform(clusters(F.sort_array(spans)), lambda c: F.when(F.size(c) > 1, folded(c, text, classes)).otherwise(c)))


def widened(spans: Column, text: Column, classes: dict[str, tuple[str, ...]]) -> Column:
    """Of the resolved spans those at a place that none of the spans has. Only spans of its own cluster can have it."""
    def moved(c: Column) -> Column:
        return F.filter(folded(c, text, classes), lambda s: ~F.exists(c, lambda x: (x["start"] == s["start"]) & (x["end"] == s["end"])))

    return F.flatten(F.transform(F.filter(clusters(F.sort_array(spans)), lambda c: F.size(c) > 1), moved))


def stitch(spans: Column, text: Column, entity_type: str = "ADDRESS") -> Column:
    """Neighbouring spans of the type with only white space between are one, with the higher score and the first one's source."""
    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        blank = ~slice_text(text, last["end"], s["start"]).rlike(r"(?U)\S")
        joins = (F.size(acc) > 0) & (s["entity_type"] == entity_type) & (last["entity_type"] == entity_type) & (s["start"] >= last["end"]) & blank
        wide = F.struct(last["start"].alias("start"), s["end"].alias("end"), last["src"].alias("src"), last["ord"].alias("ord"), last["entity_type"].alias("entity_type"), F.greatest(last["score"], s["score"]).alias("score"), last["source"].alias("source"), slice_text(text, last["start"], s["end"]).alias("text"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wide.cast(SPAN)))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.sort_array(spans), none(), step)


def shift(spans: Column, by: Column) -> Column:
    """Spans of a segment in the places of the whole text."""
    return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), *[s[c].alias(c) for c in ("src", "ord", "entity_type", "score", "source", "text")])).cast(SPANS)


#: Code points of a block of a text. A place is cut out of the blocks that it lies in, since Spark counts code points from a string's start.
_BITS = 12


def cut_up(text: Column) -> Column:
    size = 1 << _BITS
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size).cast("int") - 1, F.lit(0))), lambda k: F.substr(text, k * size + 1, F.lit(size)))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """What stands between two places of a text that was cut up."""
    lo, hi = F.shiftright(start, _BITS), F.shiftright(end - 1, _BITS)
    return F.when(end > start, F.substr(F.array_join(F.slice(blocks, lo + 1, hi - lo + 1), ""), start - F.shiftleft(lo, _BITS) + 1, end - start)).otherwise("")


def replaced(text: Column, places: Column, mark: Callable[[Column], Column], between: Callable[[Column], Column] = lambda x: x) -> Column:
    """The text with mark(place) at each place and between(text) for the rest. Places are ordered, don't overlap and lie in the text."""
    def build(b: Column) -> Column:
        def join(p: Column) -> Column:
            each = F.transform(p, lambda x, i: F.concat(between(piece(b, F.coalesce(F.get(p, i - 1)["end"], F.lit(0)), x["start"])), mark(x)))
            rest = between(piece(b, F.coalesce(F.get(p, F.size(p) - 1)["end"], F.lit(0)), F.length(text)))
            return F.array_join(F.concat(each, F.array(rest)), "")

        return let(places, join)

    return let(cut_up(text), build)


RANGES = "array<struct<start:int,end:int>>"


def apart(places: Column, text: Column) -> Column:
    """Places by start, cut to the text, without empty ones and without those that start before the last kept one ended."""
    inside = F.transform(places, lambda p: F.struct(F.greatest(p["start"], F.lit(0)).cast("int").alias("start"), F.least(p["end"], F.length(text)).cast("int").alias("end")))
    step = lambda acc, p: F.when((F.size(acc) > 0) & (p["start"] < F.get(acc, F.size(acc) - 1)["end"]), acc).otherwise(F.concat(acc, F.array(p)))
    runs = clusters(F.sort_array(F.filter(inside, lambda p: p["start"] < p["end"])), RANGES)
    return F.flatten(F.transform(runs, lambda c: F.aggregate(c, none(RANGES), step)))
