"""Review: policies, decisions and additions by hand, as joins and columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rules, spans

#: All types that a policy can allow.
UNIVERSE = frozenset(rules.PATTERN_TYPES) | frozenset(rules.CONTEXT_TYPES)
# Policies, types that share a shape, labels for readers.
POLICIES = {
    "Financial IDs only": frozenset({"NG_BVN", "NG_NUBAN", "NG_TIN", "NG_RSA_PIN", "ACCOUNT_NUMBER", "NG_CAC_RC"}),
    "Names + Location only": frozenset({"PERSON_NAME", "LGA", "STATE_OF_ORIGIN", "ADDRESS"}),
    "Full NDPA profile": UNIVERSE,
}
AMBIGUOUS = ("NG_NUBAN", "NG_NHIS")
FRIENDLY = {
    "NG_NIN": "National ID Number (NIN)",
    "NG_BVN": "Bank Verification Number (BVN)",
    "NG_PASSPORT": "Passport Number",
    "NG_PHONE": "Phone Number",
    "NG_PLATE": "Vehicle Plate Number",
    "NG_VIN": "Voter ID Number (VIN)",
    "NG_DRIVERS_LICENSE": "Driver's License Number",
    "NG_TIN": "Tax ID Number (TIN)",
    "NG_NUBAN": "Bank Account Number (NUBAN)",
    "NG_RSA_PIN": "Pension Number (RSA PIN)",
    "NG_NYSC": "NYSC Number",
    "NG_NYSC_STATE_CODE": "NYSC State Code",
    "NG_CAC_RC": "Company Registration Number (CAC/RC)",
    "NG_NHIS": "Health Insurance Number (NHIS)",
    "PERSON_NAME": "Person's Name",
    "ADDRESS": "Address",
    "LGA": "Local Government Area (LGA)",
    "UNKNOWN": "Unknown",
}
CUSTOM, EVERYTHING = "Custom", "All detected"


def policy_types(policy: str, custom: Iterable[str] = ()) -> frozenset[str] | None:
    """The types that a policy allows. Custom: those given that exist. All detected (an addition): None, every type."""
    if policy == EVERYTHING:
        return None
    if policy == CUSTOM:
        return frozenset(custom) & UNIVERSE
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}: one of {sorted(POLICIES)} or {CUSTOM!r}")
    return POLICIES[policy]


def approve_types(entities: DataFrame, types: Iterable[str] | None) -> DataFrame:
    """Approved is whether the type (UNKNOWN if null) is allowed; earlier approvals are overwritten."""
    if types is None:
        return approve_all(entities, True)
    wanted = sorted(types)
    return entities.withColumn("approved", F.coalesce(F.col("entity_type"), F.lit("UNKNOWN")).isin(*wanted) if wanted else F.lit(False))


def policy_counts(entities: DataFrame, policies: dict[str, frozenset[str] | None]) -> DataFrame:
    """For each policy (a name and its types, None for all) how many entities it approves and rejects, in one pass over them."""
    names = list(policies)
    ok = [F.lit(True) if policies[n] is None else F.coalesce(F.col("entity_type"), F.lit("UNKNOWN")).isin(*sorted(policies[n])) if policies[n] else F.lit(False) for n in names]
    sums = entities.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"p{i}") for i, c in enumerate(ok)])
    each = F.array(*[F.struct(F.lit(n).alias("policy"), F.col(f"p{i}").alias("n_approved"), (F.col("n") - F.col(f"p{i}")).alias("n_rejected")) for i, n in enumerate(names)])
    return sums.select(F.explode(each).alias("x")).select("x.*")


def approve_all(entities: DataFrame, value: bool) -> DataFrame:
    """V04."""
    return entities.withColumn("approved", F.lit(value))


def unknown_decisions(entities: DataFrame, decisions: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Decisions on entities that aren't there. Entities may be many whatever size Spark makes of a plan's start, so they are never broadcast."""
    return decisions.join(entities.select(key, F.col("id").alias("entity_id")).hint("merge"), [key, "entity_id"], "left_anti")


def decide(entities: DataFrame, decisions: DataFrame, *, key: str = "doc_id", strict: bool = True) -> DataFrame:
    """Approvals by document and entity; others stay. A decision on no entity is an error if strict.

    If strict both are read once for that, at once, and again for the result: tables (tables.written())
    where they are costly.
    """
    if strict and unknown_decisions(entities, decisions, key=key).limit(1).count():
        raise KeyError("a decision names an entity that is not there")
    d = decisions.select(F.col(key).alias("__k"), F.col("entity_id").alias("__i"), F.col("approved").alias("__a"))
    return entities.join(d.hint("merge"), (F.col(key) == F.col("__k")) & (F.col("id") == F.col("__i")), "left").withColumn("approved", F.coalesce("__a", "approved")).drop("__k", "__i", "__a")


def review_order(entities: DataFrame, file_type: str, *, key: str = "doc_id") -> DataFrame:
    """Pages of PDFs by page and place, others as numbered."""
    return entities.orderBy(key, "page_num", "start") if file_type == "pdf" else entities.orderBy(key, "id")


def _quoted(text: str) -> str:
    return r"(?iU)\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def add_by_text(segments: DataFrame, entities: DataFrame, text: str, entity_type: str, *, key: str = "doc_id", segment_text: str = "text", per_place: bool = False, page: str = "page_num") -> DataFrame:
    """Entities for a text that a reviewer gave, to be added to the others.

    The trimmed text is sought in any case. For word processing files an entity is made for each way
    it is written in a document, without places; for pages (per_place) one for each place. What was
    added by hand before with the same type (and text, or place) is not added again. Ids go on
    after the document's greatest. A blank text adds nothing.
    """
    needle = text.strip()
    found = spans.matches(F.coalesce(F.col(segment_text), F.lit("")), _quoted(needle) if needle else r"(?!)")
    keys = [key, page] if per_place else [key]
    hits = segments.select(*keys, F.explode(found).alias("m")).select(*keys, "m.*")
    manual = entities.filter((F.col("source") == "manual") & (F.col("entity_type") == entity_type))
    if per_place:
        same = [*keys, "start", "end"]
        new = hits.select(*same, "text").dropDuplicates(same)
    else:
        same = [key, "text"]
        new = hits.select(*same).distinct().withColumn("start", F.lit(None).cast("int")).withColumn("end", F.lit(None).cast("int"))
    new = new.join(manual.select(*same).distinct(), same, "left_anti")
    last = entities.groupBy(key).agg(F.max("id").alias("__last"))
    order = W.partitionBy(key).orderBy(*(["page_num", "start"] if per_place else ["text"]))
    new = new.join(last, key, "left").withColumn("id", (F.coalesce("__last", F.lit(-1)) + F.row_number().over(order)).cast("long")).drop("__last")
    return new.withColumn("entity_type", F.lit(entity_type)).withColumn("score", F.lit(1.0)).withColumn("source", F.lit("manual")).withColumn("approved", F.lit(True))


def approved(entities: DataFrame) -> DataFrame:
    """What will be redacted; without a decision an entity is."""
    return entities.filter(F.coalesce(F.col("approved"), F.lit(True)))


def friendly(entity_type: Column) -> Column:
    """A label for readers, or the type itself."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FRIENDLY.items() for x in kv]), entity_type), entity_type)


def summary(entities: DataFrame, *, types: Sequence[str] | None = None, key: str = "doc_id") -> DataFrame:
    """By document, entities of the wanted types: approved, rejected, ambiguous, and how many types."""
    e = entities if types is None else entities.filter(F.col("entity_type").isin(*types))
    a = F.coalesce(F.col("approved"), F.lit(True))
    return e.groupBy(key).agg(F.count_if(a).alias("n_approved"), F.count_if(~a).alias("n_rejected"), F.count_if(F.col("entity_type").isin(*AMBIGUOUS)).alias("n_ambiguous"), F.count_distinct("entity_type").alias("n_types"))


# What a reader's error says, by kind.
PASSWORD_SIGNS = ("password", "encrypt", "decrypt", "needs_pass")
BROKEN_SIGNS = ("bad zip", "not a zip file", "packagenotfounderror", "damaged", "cannot open", "file data error", "invalid pdf", "syntax error")


def error_kind(message: Column) -> Column:
    """Password, corrupt or other."""
    m = F.lower(F.coalesce(message, F.lit("")))
    has = lambda signs: F.exists(F.array(*[F.lit(s) for s in signs]), lambda s: F.contains(m, s))
    return F.when(has(PASSWORD_SIGNS), "password").when(has(BROKEN_SIGNS), "corrupt").otherwise("other")
