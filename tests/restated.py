"""Plain restatements of the rules, for differential tests. Written from the rules' descriptions, in another way than the expressions."""

import re

from spanloom.functions import names, places, rules

I = re.IGNORECASE


def rule_matches(text, rule):
    out = []
    for m in re.finditer(rule.regex, text, I):
        digits = re.sub("[^0-9]", "", m[0])
        if rule.rule_id == "D04":
            local = digits[3:] if digits.startswith("234") else digits[1:] if digits.startswith("0") else digits
            if not (len(local) == 10 and local[0] in "789" and local[1] in "01"):
                continue
        if rule.rule_id == "D06" and 2 * len(digits) < len(re.sub("[^0-9A-Za-z]", "", m[0])):
            continue
        out.append((m.start(), m.end()))
    return out


def terms(text, listed):
    rx = r"\b(?:" + "|".join(sorted(map(re.escape, listed), key=lambda x: (-len(x), x))) + r")\b"
    return [(m.start(), m.end()) for m in re.finditer(rx, text, I)]


def share(name):
    w = name.split()
    return sum(x.lower().strip("'-") in names.FRAGMENTS for x in w) / len(w)


def taken(name):
    w = name.split()
    vocabulary = {x.lower() for x in names.LABELS} | set(names.FORM_WORDS)
    return w[0] in names.STOP_FIRST or all(x.lower().rstrip("'s").strip("'-") in vocabulary for x in w)


def people(text):
    found = {}
    for m in re.finditer(names.SHAPE, text):
        if len(m[0].split()) >= 2 and share(m[0]) >= 0.5 and not taken(m[0]):
            found[m.span()] = 0.5 + 0.2 * share(m[0])
    for anchor, base in ((rf"\b(?:{'|'.join(names.TITLES)})\.?\s+", 0.75), (rf"\b(?:{'|'.join(names.LABELS)})[ \t]*:[ \t]*", 0.7)):
        for m in re.finditer(anchor + f"({names.SHAPE})", text, I):
            if not taken(m[1]):
                found[m.span(1)] = min(0.95, base + 0.15 * share(m[1]))
    return sorted((a, b, round(s, 6)) for (a, b), s in found.items())


def rank(d):
    kind, source = d["entity_type"], d["source"]
    for i, (s, own) in enumerate(rules.SOURCE_TYPES.items(), 1):
        if source == s and kind in own:
            return i
    return 4


def resolve(spans, text):
    """The fold over spans in order."""
    kept = []
    for s in sorted(spans, key=lambda d: (d["start"], d["end"], d["src"], d["ord"], d["entity_type"])):
        if not kept or not (kept[-1]["start"] < s["end"] and s["start"] < kept[-1]["end"]):
            kept.append(dict(s))
            continue
        a = kept.pop()
        if rank(a) != rank(s):
            win = a if rank(a) < rank(s) else s
        elif rank(a) < 4:
            win = a
        else:
            key = lambda d: (d["score"], d["end"] - d["start"])
            win = s if key(s) > key(a) else a
        win = dict(win)
        if a["entity_type"] == s["entity_type"]:
            win["start"], win["end"] = min(a["start"], s["start"]), max(a["end"], s["end"])
            win["text"] = text[win["start"] : win["end"]]
        kept.append(win)
    return kept


def claims(text, values):
    held = []
    for v in sorted(filter(None, values), key=len, reverse=True):
        at = text.find(v)
        while at >= 0:
            if all(b <= at or at + len(v) <= a for a, b, _ in held):
                held.append((at, at + len(v), v))
            at = text.find(v, at + len(v))
    return sorted(held)


class WordListBackend:
    """A stand-in for a model: runs of capitalised words of which one is listed."""

    def __init__(self, words, label="PER", score=0.9):
        self.words, self.label, self.score = {w.lower() for w in words}, label, score

    def find(self, texts):
        shape = re.compile(r"[A-Z][\w'-]+(?: [A-Z][\w'-]+)*")
        return [[(m.start(), m.end(), self.label, self.score) for m in shape.finditer(t) if any(w.lower() in self.words for w in m[0].split())] for t in texts]


__all__ = ["WordListBackend", "claims", "people", "places", "resolve", "rule_matches", "share", "taken", "terms"]
