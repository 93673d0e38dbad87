"""The pattern rules as data, and the types that belong to each source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from . import spans


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def phone_valid(x: Column) -> Column:
    """Ten digits after the country code 234, or else after a leading 0; the first 7, 8 or 9, the second 0 or 1."""
    return F.regexp_replace(_digits(x), "^(?:234|0)", "").rlike("^[789][01][0-9]{8}$")


def voter_valid(x: Column) -> Column:
    """At least half of the letters and digits are digits."""
    return 2 * F.length(_digits(x)) >= F.length(F.regexp_replace(x, "[^0-9A-Za-z]", ""))


@dataclass(frozen=True)
class PatternRule:
    """guard: what a text with a match always has. A valid match scores 1; without a validator context words add to the score."""

    rule_id: str
    entity_type: str
    regex: str
    score: float
    context: tuple[str, ...] = ()
    valid: Callable[[Column], Column] | None = None
    guard: str = "[0-9]"

    @property
    def digits(self) -> bool:
        """Whether every match has a digit."""
        return "[0-9]" in self.guard or r"\d" in self.guard

    @property
    def ascii_digits(self) -> bool:
        return r"\d" not in self.guard


# Entity types, patterns, scores and context words.
NYSC_WORDS = ("NYSC", "call-up", "corps member", "state code", "orientation camp")
RULES = (
    PatternRule("D01", "NG_NIN", r"\b[0-9]{11}\b", 0.6, ("NIN", "national identification", "national id", "national id card", "eID"), guard="[0-9]{11}"),
    PatternRule("D02", "NG_BVN", r"\b[0-9]{11}\b", 0.6, ("BVN", "bank verification", "verification number"), guard="[0-9]{11}"),
    PatternRule("D03", "NG_PASSPORT", r"\bA[0-9]{8}\b", 0.85, ("passport", "international passport"), guard="[Aa][0-9]{8}"),
    PatternRule("D04", "NG_PHONE", r"\b(?:\+?234|0)[\d\s-]{10,14}\b", 0.6, ("phone", "mobile", "contact number", "tel"), phone_valid, guard=r"(?U)[\d\s-]{11}"),
    PatternRule("D05", "NG_PLATE", r"\b[A-Z]{2,3}[-\s]?\d{3}[-\s]?[A-Z]{2}\b", 0.8, guard=r"(?U)\d{3}"),
    PatternRule("D06", "NG_VIN", r"\b[A-Z0-9]{4}[\s-]?[A-Z0-9]{4}[\s-]?[A-Z0-9]{4}[\s-]?[A-Z0-9]{4}[\s-]?[A-Z0-9]{1,4}\b", 0.7, ("VIN", "voter", "PVC", "permanent voter card", "voter registration"), voter_valid, guard="[0-9]"),
    PatternRule("D07", "NG_DRIVERS_LICENSE", r"\b[A-Za-z]{3}[0-9]{5}[A-Za-z]{2}[0-9]{2}\b", 0.75, ("driver's license", "driving license", "FRSC"), guard="[0-9]{5}"),
    PatternRule("D08", "NG_TIN", r"\b[0-9]{8}\s?-\s?[0-9]{4}\b", 0.85, ("TIN", "tax identification", "taxpayer"), guard="[0-9]{8}"),
    PatternRule("D09", "NG_NUBAN", r"\b[0-9]{10}\b", 0.4, ("account number", "NUBAN", "bank account"), guard="[0-9]{10}"),
    PatternRule("D10", "NG_RSA_PIN", r"\bPEN[0-9]{12}\b", 0.9, ("RSA", "pension", "PenCom", "retirement savings"), guard="[0-9]{12}"),
    PatternRule("D11", "NG_NYSC", r"\bNYSC/[A-Z]{2,3}(?:/[A-Z]{2,3})?/[0-9]{4}/[0-9]{5,6}\b", 0.85, NYSC_WORDS, guard="/[0-9]{4}/"),
    PatternRule("D12", "NG_NYSC", r"\b[A-Z]{2}/[0-9]{2}[A-Z]/[0-9]{3,4}\b", 0.6, NYSC_WORDS, guard="/[0-9]{2}"),
    PatternRule("D13", "NG_CAC_RC", r"\b(?:RC|BN|IT|LP)[\s-]?[0-9]{5,8}\b", 0.75, ("CAC", "corporate affairs", "registration number", "certificate of incorporation", "RC number"), guard="[0-9]{5}"),
    PatternRule("D14", "NG_NHIS", r"\b[0-9]{10}\b", 0.3, ("NHIS", "health insurance", "enrollee", "NHIA"), guard="[0-9]{10}"),
    PatternRule("D16", "EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b", 1.0, guard="@"),
    PatternRule("D16b", "US_SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.5, ("social", "security", "ssn"), guard="[0-9]-[0-9]{2}-[0-9]"),
)
PATTERN_TYPES = (
    "NG_NIN", "NG_BVN", "NG_PASSPORT", "NG_PHONE", "NG_PLATE", "EMAIL_ADDRESS", "ACCOUNT_NUMBER", "NG_VIN",
    "NG_DRIVERS_LICENSE", "NG_TIN", "NG_NUBAN", "NG_RSA_PIN", "NG_NYSC", "NG_NYSC_STATE_CODE", "NG_CAC_RC", "NG_NHIS",
)
CONTEXT_TYPES = ("PERSON_NAME", "LGA", "STATE_OF_ORIGIN", "ETHNIC_GROUP", "ADDRESS")
MODEL_TYPES = ("PERSON_NAME",)
#: Sources and the types that each one reports best, the best source first.
SOURCE_TYPES = {"ner": MODEL_TYPES, "local_context": CONTEXT_TYPES, "pattern": PATTERN_TYPES}
#: Types beyond the rules that a model backend may report.
MODEL_ONLY = ("PERSON", "LOCATION", "DATE_TIME")
#: What a model's labels are called here.
MODEL_LABELS = {"PERSON": "PERSON_NAME", "PER": "PERSON_NAME"}

#: Place of each source in the union of detections.
SRC = {"pattern": 0, "local_context": 1, "ner": 2}


def rule_places(text: Column, rule: PatternRule) -> Column:
    """Valid matches of a rule as places."""
    found = spans.matches(text, spans.ANY_CASE + rule.regex, guard=rule.guard)
    return F.filter(found, lambda p: rule.valid(p["text"])) if rule.valid else found


def rule_spans(text: Column, rule: PatternRule, ord_: int) -> Column:
    """Spans of one rule, with the score that context or the validator gives."""
    same = {"src": SRC["pattern"], "ord_": ord_, "entity_type": rule.entity_type, "source": "pattern"}
    if rule.valid or not rule.context:
        return spans.as_spans(rule_places(text, rule), **same, score=lambda p: F.lit(1.0 if rule.valid else rule.score))
    score = spans.boosted(rule.score, rule.context)

    def scored(p: Column) -> Column:
        both = F.zip_with(spans.placed(p), spans.before(p), lambda x, near: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"), score(near).alias("score")))
        return F.when(F.size(p) > 2, spans.as_spans(both, **same, score=lambda x: x["score"])).otherwise(spans.none())

    return spans.let(spans.parts(text, spans.ANY_CASE + rule.regex, guard=rule.guard), scored)


def pattern_spans(text: Column, types: tuple[str, ...] | None = None, rules: tuple[PatternRule, ...] = RULES) -> Column:
    """Spans of all rules whose type is wanted; others are not planned at all.

    Of spans at one place the higher score stands first, then the rule registered first.
    """
    wanted = [(i, r) for i, r in enumerate(rules) if types is None or r.entity_type in types]
    if not wanted:
        return spans.none()
    # most texts have no digit, so most rules are asked about at once
    digits = [rule_spans(text, r, i) for i, r in wanted if r.digits]
    others = [rule_spans(text, r, i) for i, r in wanted if not r.digits]
    every = F.concat(*([F.when(text.rlike("[0-9]" if all(r.ascii_digits for _, r in wanted) else r"(?U)\d"), F.concat(*digits)).otherwise(spans.none())] if digits else []), *others)
    # by score first: the order within a source decides between equal priorities
    ranked = F.sort_array(F.transform(every, lambda s: F.struct((-s["score"]).alias("k"), s.alias("s"))))
    return F.transform(ranked, lambda x, i: F.struct(*[(i if c == "ord" else x["s"][c]).alias(c) for c in ("start", "end", "src", "ord", "entity_type", "score", "source", "text")])).cast(spans.SPANS)
