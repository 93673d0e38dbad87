"""Gazetteers as patterns: places, states and ethnic groups, and any list of terms.

The built-in list of local government areas is a small one for forms and tests; the full one is
read from a JSON file (spanloom.sources.gazetteer) and passed in.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from . import spans

# States, aliases of the capital territory, ethnic groups.
STATES = (
    "Abia", "Adamawa", "Akwa Ibom", "Anambra", "Bauchi", "Bayelsa", "Benue", "Borno", "Cross River", "Delta",
    "Ebonyi", "Edo", "Ekiti", "Enugu", "Federal Capital Territory", "Gombe", "Imo", "Jigawa", "Kaduna", "Kano",
    "Katsina", "Kebbi", "Kogi", "Kwara", "Lagos", "Nasarawa", "Niger", "Ogun", "Ondo", "Osun",
    "Oyo", "Plateau", "Rivers", "Sokoto", "Taraba", "Yobe", "Zamfara",
)
STATE_ALIASES = {"Abuja": "Federal Capital Territory", "FCT": "Federal Capital Territory", "FCT Abuja": "Federal Capital Territory"}
ETHNIC_GROUPS = (
    "Yoruba", "Igbo", "Hausa", "Fulani", "Ijaw", "Kanuri", "Ibibio", "Tiv", "Edo", "Bini", "Nupe", "Igala", "Idoma", "Urhobo", "Itsekiri",
    "Efik", "Annang", "Ekoi", "Gwari", "Gbagyi", "Jukun", "Ogoni", "Isoko", "Ebira", "Esan", "Ijebu", "Egba", "Kalabari", "Ikwerre",
    "Ogba", "Etsako", "Chamba", "Bachama", "Angas", "Berom", "Waja", "Shuwa Arab", "Yala", "Ikwo", "Ishan",
)
# Local government areas: those named in two states, those named like a state, some of several words.
SAMPLE_LGAS = (
    ("Aba North", "Abia"), ("Isiala Ngwa North", "Abia"), ("Umu-Nneochi", "Abia"), ("Obi", "Benue"), ("Ado", "Benue"),
    ("Bauchi", "Bauchi"), ("Ebonyi", "Ebonyi"), ("Ekiti", "Ekiti"), ("Gombe", "Gombe"), ("Katsina", "Katsina"), ("Kogi", "Kogi"),
    ("Bassa", "Kogi"), ("Ifelodun", "Kwara"), ("Irepodun", "Kwara"), ("Ikeja", "Lagos"), ("Surulere", "Lagos"), ("Eti-Osa", "Lagos"),
    ("Nasarawa", "Kano"), ("Nasarawa", "Nasarawa"), ("Obi", "Nasarawa"), ("Ifelodun", "Osun"), ("Irepodun", "Osun"),
    ("Surulere", "Oyo"), ("Ibadan North", "Oyo"), ("Ibadan North-East", "Oyo"), ("Bassa", "Plateau"), ("Port Harcourt", "Rivers"),
)


def any_of(terms: Iterable[str]) -> str:
    """A pattern for whole terms, of several that match at a place the longest.

    Terms are folded into a prefix tree, so a place costs the length of what matches there and not
    one try for each term; branches that go on come before the end of a shorter term.
    """
    tree: dict = {}
    for t in terms:
        node = tree
        for c in t:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ends = "" in node
        parts = sorted(re.escape(c) + pattern(n) for c, n in node.items() if c)
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and not ends else f"(?:{'|'.join(parts)})"
        return body + "?" if ends else body

    return rf"\b{pattern(tree)}\b"


@dataclass(frozen=True)
class Gazetteer:
    """Terms of places. lgas: (area, state) pairs in order."""

    lgas: tuple[tuple[str, str], ...] = SAMPLE_LGAS
    states: tuple[str, ...] = STATES
    aliases: dict[str, str] = field(default_factory=lambda: dict(STATE_ALIASES))
    ethnic: tuple[str, ...] = ETHNIC_GROUPS

    def state_of(self) -> dict[str, str]:
        """The state of each area; of several the last."""
        return dict(self.lgas)

    def terms(self) -> set[str]:
        return {*(a for a, _ in self.lgas), *self.states, *self.aliases, *self.ethnic}

    def patterns(self) -> dict[str, str]:
        """G02 to G04, by entity type."""
        return {"LGA": any_of(sorted({a for a, _ in self.lgas})), "STATE_OF_ORIGIN": any_of(sorted({*self.states, *self.aliases})), "ETHNIC_GROUP": any_of(self.ethnic)}


DEFAULT = Gazetteer()
#: Scores by entity type.
SCORES = {"LGA": 0.85, "STATE_OF_ORIGIN": 0.85, "ETHNIC_GROUP": 0.8}


def term_places(text: Column, pattern: str, guard: Column | None = None) -> Column:
    return spans.matches(text, spans.ANY_CASE + pattern, guard=guard)


def place_spans(text: Column, gazetteer: Gazetteer = DEFAULT, src: int = 1, guard: Column | None = None) -> Column:
    """Areas, states and groups, in that order at one place. guard: whether the text has any of these terms."""
    parts = [spans.as_spans(term_places(text, rx, guard), src=src, ord_=i, entity_type=kind, source="local_context", score=lambda p, k=kind: F.lit(SCORES[k])) for i, (kind, rx) in enumerate(gazetteer.patterns().items())]
    return F.concat(*parts)
