"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.
Column expressions only.

Matches and what stands between them alternate, and their lengths add up to the places (see
spanloom.functions.spans: work grows with a text's length). A cheap test goes first, so that a
pattern runs only over texts that can hold a match. Patterns are written
with possessive runs and with a look back to a run's start: the same matches as the plain forms,
in time linear in the text and without the recursion that long runs cause in Java.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import spans

SPAN = "array<struct<start:bigint,ord:int,kind:string,end:bigint,score:double,text:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether digits pass the Luhn check: from the right, every second one doubled, digits summed."""
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number's check digits hold: first four characters last, letters as 10 to 35, remainder 1."""
    bare = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    def add(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), rest * 10 + c.cast("int")).otherwise(rest * 100 + (F.ascii(c) - 55)) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(add(r, c))) == 1


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. guard: what a text must hold for any match. base: kept whatever the score."""

    name: str
    pattern: str
    guard: str
    valid: object
    score: float
    context: tuple[str, ...]
    base: bool = True


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@[A-Za-z0-9-]", lambda m: F.lit(True), 0.9, ("mail", "contact")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), 0.6, ("ip", "address", "host", "server")),
    Kind("card", r"[0-9]++(?:[\x20-][0-9]++)*+", r"[0-9](?:[\x20-]?[0-9]){13}", lambda m: F.length(_digits(m)).between(14, 19) & luhn(_digits(m)), 0.8, ("card", "visa", "credit", "payment")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda m: F.length(_digits(m)).between(10, 15), 0.7, ("phone", "mobile", "call", "tel")),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", lambda m: mod97(m), 0.8, ("iban", "account", "bank"), False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda m: ~m.rlike("^(?:000|666|9..)|-00-|-0000$"), 0.3, ("ssn", "social security"), False),
)
#: A span that isn't base is kept from this score on.
LEAST_SCORE = 0.5
#: What a word of the kind's context within so many code points before a span adds.
CONTEXT_CHARS, CONTEXT_ADDS = 48, 0.35


#: Parts that hold CONTEXT_CHARS at least: every match has five code points or more.
CONTEXT_PARTS = 22


def _spans(text: Column, kind: Kind, ord_: int) -> Column:
    """All spans of a kind by start, as SPAN."""
    def one(place: Column, near: Column) -> Column:
        hit = reduce(lambda a, b: a | b, [F.contains(near, F.lit(w)) for w in kind.context])
        score = F.when(hit, F.least(F.lit(1.0), F.lit(kind.score + CONTEXT_ADDS))).otherwise(F.lit(kind.score))
        return F.struct(place["start"].cast("bigint").alias("start"), F.lit(ord_).alias("ord"), F.lit(kind.name).alias("kind"), place["end"].cast("bigint").alias("end"), score.alias("score"), place["text"].alias("text"))

    def found(p: Column) -> Column:
        every = F.zip_with(spans.placed(p), F.transform(spans.tails(p, CONTEXT_CHARS, CONTEXT_PARTS), F.lower), one)
        keep = lambda s: F.coalesce(kind.valid(s["text"]), F.lit(False)) & (F.lit(True) if kind.base else s["score"] >= LEAST_SCORE)
        return F.when(F.size(p) > 2, F.filter(every, keep).cast(SPAN)).otherwise(F.array().cast(SPAN))

    return spans.let(spans.parts(text, kind.pattern, guard=kind.guard), found)


def find(docs: DataFrame, *, text_col: str = "text", out_col: str = "pii", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The rows with one more column (in place of one of that name): the spans of text_col by start, then by kind as listed.

    start and end are code points, end exclusive. Spans of one kind don't overlap; those of two
    kinds may. A null or empty text has none. Rows are neither added nor dropped, so repeated rows
    and empty tables need no care. Base kinds are kept whatever their score.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(out_col, F.array_sort(F.concat(*[_spans(text, k, i) for i, k in enumerate(kinds)])))


def redact(docs: DataFrame, *, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The rows with each run of overlapping spans in text_col replaced by its first kind in brackets, as [EMAIL]. A text without spans, or null, stays as it is."""
    name, text = "__pii_spans", F.col(text_col)
    while name in docs.columns:
        name += "_"
    found = find(docs, text_col=text_col, out_col=name, kinds=kinds)
    plain = F.transform(F.col(name), lambda s: F.struct(s["start"].cast("int").alias("start"), s["ord"].alias("ord"), s["end"].cast("int").alias("end"), s["kind"].alias("kind")))
    runs = spans.clusters(plain, "array<struct<start:int,ord:int,end:int,kind:string>>")
    places = F.transform(runs, lambda c: F.struct(F.get(c, F.lit(0))["start"].alias("start"), F.array_max(F.transform(c, lambda s: s["end"])).alias("end"), F.get(c, F.lit(0))["kind"].alias("kind")))
    new = spans.replaced(text, places, lambda p: F.concat(F.lit("["), F.upper(p["kind"]), F.lit("]")))
    return found.withColumn(text_col, F.when(F.size(name) > 0, new).otherwise(text)).drop(name)
