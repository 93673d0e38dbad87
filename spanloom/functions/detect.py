"""The whole of detection as one column expression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from . import names, places, rules, spans


@dataclass(frozen=True)
class Detector:
    """What is looked for. types: only these (rules for others are not planned). deny: listed names.

    model: a column of spans from a model (N01), if there is one.
    """

    types: tuple[str, ...] | None = None
    pattern_rules: tuple[rules.PatternRule, ...] = rules.RULES
    gazetteer: places.Gazetteer = field(default_factory=places.Gazetteer)
    name_rules: names.NameRules = names.DEFAULT
    deny: tuple[str, ...] = ()

    def pattern(self, text: Column) -> Column:
        """Rules and listed names."""
        out = rules.pattern_spans(text, self.types, self.pattern_rules)
        if self.deny and (self.types is None or "PERSON_NAME" in self.types):
            listed = spans.as_spans(places.term_places(text, places.any_of(self.deny)), src=rules.SRC["pattern"], ord_=1000, entity_type="PERSON_NAME", source="pattern", score=lambda p: F.lit(0.65))
            out = F.concat(out, listed)
        return out

    def context(self, text: Column) -> Column:
        """Places, names and addresses. One pass asks for any of the places and titles, so most texts are not searched for each kind."""
        terms = spans.seen(text, spans.ANY_CASE + places.any_of(sorted({*self.gazetteer.terms(), *names.TITLES})))
        every = spans.let(terms, lambda some: F.concat(places.place_spans(text, self.gazetteer, guard=some), names.name_spans(text, self.name_rules, titled=some), names.address_spans(text)))
        return every if self.types is None else F.filter(every, lambda s: s["entity_type"].isin(*self.types))

    def union(self, text: Column, model: Column | None = None) -> Column:
        """Patterns, context, model."""
        parts = [self.pattern(text), self.context(text)]
        if model is not None:
            parts.append(relabelled(model))
        return F.concat(*parts)

    def detect(self, text: Column, model: Column | None = None) -> Column:
        """Resolved spans by place; a null or blank text has none."""
        some = F.coalesce(text, F.lit(""))
        found = spans.resolve(self.union(some, model), some, rules.SOURCE_TYPES)
        return F.when(some.rlike(r"(?U)\S"), found).otherwise(spans.none())

    def widened(self, text: Column, model: Column | None = None) -> Column:
        """Those of the resolved spans that have a place no source found."""
        some = F.coalesce(text, F.lit(""))
        found = spans.widened(self.union(some, model), some, rules.SOURCE_TYPES)
        return F.when(some.rlike(r"(?U)\S"), found).otherwise(spans.none())


def relabelled(model: Column) -> Column:
    """A model's spans under the types used here."""
    def kind(t: Column) -> Column:
        out = t
        for a, b in rules.MODEL_LABELS.items():
            out = F.when(t == a, F.lit(b)).otherwise(out)
        return out

    return F.transform(model, lambda s: F.struct(*[(kind(s[c]) if c == "entity_type" else s[c]).alias(c) for c in ("start", "end", "src", "ord", "entity_type", "score", "source", "text")])).cast(spans.SPANS)


def detect(text: Column, detector: Detector | None = None) -> Column:
    return (detector or Detector()).detect(text)
