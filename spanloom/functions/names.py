"""Names and addresses by shape, by what stands before them, and by known parts of names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from . import spans

# Titles, field labels, parts of names, first words that are no names, words of forms.
TITLES = (
    "Mr", "Mrs", "Miss", "Ms", "Dr", "Engr", "Barr", "Prof", "Chief", "Alhaji", "Alhaja", "Prince", "Princess", "Otunba", "Hon", "Rev",
    "Pastor", "Comrade", "Reverend",
)
LABELS = ("Name", "Applicant", "Full Name", "Next of Kin", "Beneficiary", "Guarantor", "Employee", "Employer", "Signatory", "Witness")
FRAGMENTS = (
    "chukwu", "chukwuemeka", "chidi", "chidinma", "ngozi", "obiora", "uche", "ifeoma", "emeka", "nnamdi", "okonkwo", "eze", "adaeze",
    "chinwe", "ikenna", "obinna", "chioma", "amaka", "nkechi", "kelechi", "okoro", "onyekachi", "chiamaka", "okafor", "nwosu", "anyanwu",
    "adebayo", "adeyemi", "oluwaseun", "folake", "olamide", "temitope", "adewale", "oluwafemi", "bunmi", "yetunde", "babatunde", "ayodele",
    "olusegun", "abiodun", "oyinlola", "adeola", "kehinde", "taiwo", "olawale", "adekunle", "ogundipe", "afolabi", "ade", "oladele",
    "omitogun", "oluwatoni",
    "ibrahim", "musa", "aisha", "fatima", "yusuf", "sani", "bello", "aliyu", "hassan", "hussaini", "muhammad", "mohammed",
    "abubakar", "garba", "usman", "suleiman", "zainab", "hadiza", "amina", "yakubu",
    "peter", "john", "james", "paul", "mary", "grace", "victoria", "comfort", "blessing", "joseph", "daniel", "david", "samuel",
    "emmanuel", "elizabeth", "faith", "peace", "precious", "patience", "joy", "praise", "goodness", "esther", "ruth", "deborah", "victor",
)
STOP_FIRST = (
    "The", "This", "That", "These", "Those", "January", "February", "March", "April", "May", "June", "July", "August", "September",
    "October", "November", "December", "State", "Nigeria", "Federal",
)
FORM_WORDS = (
    "home", "address", "local", "government", "area", "certificate", "origin", "seal", "public", "father", "mother", "state", "date",
    "signature", "hand", "year", "district", "council", "ward",
)
ROADS = ("Road", "Street", "Close", "Avenue", "Crescent", "Drive", "Lane", "Way")
SHAPE = r"[A-Z][a-zA-Z'\-]+(?:[ \t]+[A-Z][a-zA-Z'\-]+){0,3}"


@dataclass(frozen=True)
class NameRules:
    """compat: the published behaviour with its oddities. Without it a name must be capitalised also after a
    title or label, `abdullahi` is a part of names, and a possessive is taken off as such."""

    compat: bool = True
    fragments: tuple[str, ...] = FRAGMENTS

    @property
    def parts(self) -> tuple[str, ...]:
        return self.fragments if self.compat else (*self.fragments, "abdullahi")

    def anchored(self, anchor: str) -> str:
        """A pattern of the anchor (in any case) and the name, which is group 1."""
        return spans.ANY_CASE + rf"\b{anchor}({SHAPE})" if self.compat else rf"(?U)\b(?i:{anchor})({SHAPE})"

    @property
    def title(self) -> str:
        """C01."""
        return self.anchored(rf"(?:{'|'.join(TITLES)})\.?\s+")

    @property
    def label(self) -> str:
        """On one line, so a blank field gives nothing."""
        return self.anchored(rf"(?:{'|'.join(LABELS)})[ \t]*:[ \t]*")

    @property
    def vocabulary(self) -> tuple[str, ...]:
        own = [x.lower() for x in LABELS]
        return (*own, *FORM_WORDS) if self.compat else tuple(dict.fromkeys([w for x in own for w in x.split()] + list(FORM_WORDS)))


DEFAULT = NameRules()


def words_of(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit(r"[^ \t\r\n]+"), F.lit(0))


def known_share(words: Column, rules: NameRules = DEFAULT) -> Column:
    known = F.aggregate(words, F.lit(0), lambda n, w: n + F.trim(F.lower(w), F.lit("'-")).isin(*rules.parts).cast("int"))
    return F.when(F.size(words) > 0, known / F.size(words)).otherwise(F.lit(0.0))


def stops(words: Column) -> Column:
    return F.get(words, F.lit(0)).isin(*STOP_FIRST)


def all_of_forms(words: Column, rules: NameRules = DEFAULT) -> Column:
    bare = (lambda w: F.rtrim(F.lower(w), F.lit("'s"))) if rules.compat else (lambda w: F.regexp_replace(F.lower(w), "'s?$", ""))
    return (F.size(words) > 0) & F.forall(words, lambda w: F.trim(bare(w), F.lit("'-")).isin(*rules.vocabulary))


def fragment_share(name: Column, rules: NameRules = DEFAULT) -> Column:
    """The share of a name's words that are known parts of names."""
    return known_share(words_of(name), rules)


def is_stop_phrase(name: Column) -> Column:
    """C04."""
    return stops(words_of(name))


def is_form_phrase(name: Column, rules: NameRules = DEFAULT) -> Column:
    """All words are words of forms. Letters and marks of a possessive go from a word's end."""
    return all_of_forms(words_of(name), rules)


def _named(places: Column, rules: NameRules, rank: int, base: float, weight: float, most: float, bare: bool = False) -> Column:
    """Places that are names, with scores. Words and share are found once for each place, in a struct that later steps read."""
    split = F.transform(places, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["text"].alias("text"), words_of(p["text"]).alias("w")))
    split = F.filter(split, lambda p: ~stops(p["w"]) & ((F.size(p["w"]) >= 2) if bare else F.lit(True)) & ~all_of_forms(p["w"], rules))
    scored = F.transform(split, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), known_share(p["w"], rules).alias("share"), p["text"].alias("text")))
    if bare:
        scored = F.filter(scored, lambda p: p["share"] >= 0.5)
    return F.transform(scored, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit(rank).alias("rank"), F.least(F.lit(most), F.lit(base) + weight * p["share"]).alias("score"), p["text"].alias("text")))


def name_places(text: Column, rules: NameRules = DEFAULT, titled: Column | None = None) -> Column:
    """Names after a label, after a title, and bare ones of known parts; at one place the first of these counts. titled: whether the text has any title."""
    label = _named(spans.matches(text, rules.label, 1, guard=":"), rules, 0, 0.7, 0.15, 0.95)
    title = _named(spans.matches(text, rules.title, 1, guard=titled), rules, 1, 0.75, 0.15, 0.95)
    free = _named(spans.matches(text, SHAPE), rules, 2, 0.5, 0.2, 1.0, bare=True)
    # (sorted: equal places stand together, the first kind first)
    new = lambda x, y: (x["start"] != y["start"]) | (x["end"] != y["end"])
    return spans.let(F.sort_array(F.concat(label, title, free)), lambda e: F.filter(e, lambda x, i: (i == 0) | new(F.get(e, i - 1), x)))


def address_pattern() -> str:
    return rf"(?U)\b\d{{1,4}}[A-Za-z]?,?\s+[A-Z][a-zA-Z\s]{{2,40}}(?:{'|'.join(ROADS)})\b"


def address_places(text: Column) -> Column:
    """A number, capitalised words and a kind of road; case counts."""
    return spans.matches(text, address_pattern(), guard="|".join(ROADS))


def name_spans(text: Column, rules: NameRules = DEFAULT, src: int = 1, titled: Column | None = None) -> Column:
    return F.transform(name_places(text, rules, titled), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit(src).alias("src"), F.lit(3).alias("ord"), F.lit("PERSON_NAME").alias("entity_type"), F.round(p["score"], 2).alias("score"), F.lit("local_context").alias("source"), p["text"].alias("text"))).cast(spans.SPANS)


def address_spans(text: Column, src: int = 1) -> Column:
    return spans.as_spans(address_places(text), src=src, ord_=4, entity_type="ADDRESS", source="local_context", score=lambda p: F.lit(0.5))
