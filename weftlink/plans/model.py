"""What a reconciliation is made of: mappings, rules and their validation. Plan-time values only; no data."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

# The families of meaning that a mapping can have, and the kinds that only older mappings infer.
FAMILIES = (
    "persistent_identifier", "source_local_identifier", "name_or_title", "contact_person", "email", "phone", "domain",
    "address", "geography", "categorical", "numeric", "date_or_timestamp", "free_text", "unknown",
)
LEGACY_KINDS = ("name", "city", "region", "postal", "other")
NORMALIZERS = ("text", "phone", "email", "number", "date")

# Weight of a field's agreement, and the part of it that a conflict costs.
WEIGHTS = {
    "persistent_identifier": 2.5, "source_local_identifier": 0.25, "name_or_title": 2.0, "contact_person": 0.75,
    "geography": 0.4, "categorical": 0.3, "numeric": 0.5, "date_or_timestamp": 0.3, "free_text": 0.25, "unknown": 0.25,
    "email": 1.5, "phone": 1.5, "domain": 1.0, "address": 1.5,
    "name": 2.0, "city": 0.3, "region": 0.3, "postal": 0.6, "other": 0.5,
}
CONFLICTS = {
    "persistent_identifier": 1.0, "source_local_identifier": 0.0, "name_or_title": 0.1, "contact_person": 0.1,
    "geography": 0.2, "categorical": 0.1, "numeric": 0.2, "date_or_timestamp": 0.1, "free_text": 0.1, "unknown": 0.1,
    "phone": 0.15, "email": 0.2, "domain": 0.15, "address": 0.2,
    "name": 0.1, "city": 0.2, "region": 0.2, "postal": 0.2, "other": 0.25,
}
# Words that make no blocking key of their own.
STOP_TOKENS = ("and", "company", "corporation", "group", "inc", "incorporated", "llc", "ltd", "limited", "of", "services", "solutions", "the")
# The blockers, in the order of their diagnostics.
BLOCKERS = ("persistent_exact_v1", "exact_supporting_v1", "supporting_context_v1", "exact_strong_v1", "name_token_v1", "name_character_v1", "location_name_v2", "address_name_v2")
LEGACY_BLOCKERS = ("exact_strong_v1", "name_token_v1", "name_character_v1", "location_name_v1", "address_name_v1")
STRONG_FAMILIES = ("persistent_identifier", "name_or_title", "email", "phone", "address")
WEAK_FAMILIES = ("contact_person", "geography", "categorical", "source_local_identifier", "free_text", "unknown")
ASSIGNMENT_POLICIES = ("assignment-one-to-one-conservative-v1", "assignment-legacy-v1")


class Invalid(ValueError):
    """A plan that can't be run as asked."""


@dataclass(frozen=True)
class Mapping:
    """One confirmed correspondence of a column of A and one of B."""

    mapping_id: str
    a_column: str
    b_column: str
    family: str | None = None
    normalizer: str = "text"
    label: str = ""
    matching: bool = True
    merge: bool = True

    @property
    def kind(self) -> str:
        """The family if one is given, even `unknown`; else inferred from names."""
        return self.family if self.family is not None else infer_kind(self)


# Which words in names point to which kind, first match wins.
_KIND_WORDS = (
    ("phone", ("phone", "telephone")), ("email", ("email",)), ("domain", ("website", "domain", "url")), ("postal", ("postal", "zip")),
    ("city", ("city",)), ("region", ("state", "region", "province")), ("address", ("street", "address")), ("name", ("name", "organization", "company")),
)


def infer_kind(m: Mapping) -> str:
    """The kind of a mapping without a family."""
    names = " ".join((m.mapping_id, m.label, m.a_column, m.b_column)).casefold()
    for kind, words in _KIND_WORDS:
        if m.normalizer == kind or any(w in names for w in words):
            return kind
    return "other"


# Words in the names of a mapping that point to a family; the first row of which all patterns match decides.
_FAMILY_WORDS = (
    ("source_local_identifier", r"\b(record|row|source|internal)\s*(id|key|number|no|pk)\b|\b(primary\s*key|source\s*pk)\b"),
    ("contact_person", r"\b(contact|representative|attention|attn|salesperson|owner)\b", r"\b(name|person|representative|contact)\b"),
    ("email", r"\b(email|e mail)\b"),
    ("phone", r"\b(phone|telephone|mobile|fax)\b"),
    ("domain", r"\b(domain|website|web site|url|host name|hostname)\b"),
    ("address", r"\b(address|street|road|avenue|boulevard)\b"),
    ("geography", r"\b(city|state|province|region|country|postal|postcode|zip)\b"),
    ("categorical", r"\b(category|status|type|class|segment|department|brand)\b"),
    ("free_text", r"\b(description|notes?|comments?|memo|details?)\b"),
    ("name_or_title", r"\b(name|title|organization|organisation|company|vendor|supplier|customer|product|facility|location|item)\b"),
)
_FAMILY_OF_NORMALIZER = {"email": "email", "phone": "phone", "number": "numeric", "date": "date_or_timestamp"}


def infer_family(m: Mapping) -> str:
    """A proposal for a saved mapping that omits its family; it isn't used for matching unless confirmed."""
    if m.normalizer in _FAMILY_OF_NORMALIZER:
        return _FAMILY_OF_NORMALIZER[m.normalizer]
    names = re.sub(r"[^a-z0-9]+", " ", " ".join((m.mapping_id, m.label, m.a_column, m.b_column)).lower())
    return next((family for family, *patterns in _FAMILY_WORDS if all(re.search(p, names) for p in patterns)), "unknown")


@dataclass(frozen=True)
class CandidateConfig:
    blockers: tuple[str, ...] = BLOCKERS
    prefix: int = 4
    max_side: int = 20
    max_pairs: int = 100
    #: 4 is current; 1 to 3 are older engines: without supporting keys, and below 3 without generic exact keys.
    engine: int = 4


@dataclass(frozen=True)
class Rules:
    auto: float = 0.50
    review: float = 0.25
    margin: float = 0.04
    agreements: int = 2
    floor: float = 0.25
    window: float = 0.30
    alternatives: int = 3
    gate_contradictions: bool = True
    gate_agreements: bool = True


def check_versions(candidates: str, matcher: str, supported: Sequence[tuple[str, str]]) -> None:
    """Candidate and matcher configurations are only run in pairs that belong together."""
    if (candidates, matcher) not in supported:
        raise Invalid(f"candidate configuration {candidates} doesn't go with matcher configuration {matcher}")


def check_policy(policy: str) -> str:
    """Fails closed on an assignment policy that isn't known."""
    if policy not in ASSIGNMENT_POLICIES:
        raise Invalid(f"unknown assignment policy {policy}")
    return policy


def check_mappings(mappings: Sequence[Mapping], a_columns: Sequence[str], b_columns: Sequence[str]) -> None:
    """At least one matching field, known columns, families and normalizers, no id or pair of columns twice."""
    if not any(m.matching for m in mappings):
        raise Invalid("at least one field must be used for matching")
    if len({m.mapping_id for m in mappings}) < len(mappings) or len({(m.a_column, m.b_column) for m in mappings}) < len(mappings):
        raise Invalid("mapping ids and pairs of columns must be unique")
    for m in mappings:
        if m.a_column not in a_columns or m.b_column not in b_columns:
            raise Invalid(f"mapping {m.mapping_id} names a column that isn't there")
        if m.family is not None and m.family not in FAMILIES or m.normalizer not in NORMALIZERS:
            raise Invalid(f"mapping {m.mapping_id} has an unknown family or normalizer")


def identity(mappings: Sequence[Mapping]) -> list[Mapping]:
    """The mappings that may make keys and evidence."""
    return [m for m in mappings if m.matching]


def as_matching(m: Mapping, role: str) -> Mapping:
    """The product form of a mapping that has a role, identity or comparison."""
    return replace(m, matching=role == "identity")


def check_headers(columns: Sequence[str], forbidden: Sequence[str]) -> None:
    """Guards against inputs that carry the truth."""
    if leaked := sorted({c.lower() for c in columns} & {f.lower() for f in forbidden}):
        raise Invalid(f"input has forbidden columns: {', '.join(leaked)}")


def canonical_json(value: object) -> str:
    """One text for equal values: keys sorted at every level, no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_hash(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


@dataclass(frozen=True)
class FieldPolicy:
    mapping_id: str
    strategy: str
    trusted: str | None = None
    a_timestamp: str | None = None
    b_timestamp: str | None = None


STRATEGIES = ("keep_both", "prefer_non_null", "prefer_trusted_source", "prefer_newest")


@dataclass(frozen=True)
class Policy:
    version: str
    fields: tuple[FieldPolicy, ...] = field(default_factory=tuple)

    def rule_id(self, mapping_id: str) -> str:
        return next(f"rule-{i + 1}-{f.mapping_id}" for i, f in enumerate(self.fields) if f.mapping_id == mapping_id)


def build_policy(fields: Sequence[FieldPolicy], mappings: Sequence[Mapping]) -> Policy:
    """Validates field policies and names their version by their content."""
    merge = {m.mapping_id for m in mappings if m.merge}
    for f in fields:
        if f.mapping_id not in merge or f.strategy not in STRATEGIES:
            raise Invalid(f"no policy {f.strategy} for field {f.mapping_id}")
        if f.strategy == "prefer_trusted_source" and f.trusted not in ("A", "B"):
            raise Invalid("a trusted source must be A or B")
        if f.strategy == "prefer_newest" and not (f.a_timestamp and f.b_timestamp):
            raise Invalid("the newest value needs a timestamp column on either side")
    if len({f.mapping_id for f in fields}) < len(fields):
        raise Invalid("a field has more than one policy")
    content = [vars(f) for f in sorted(fields, key=lambda f: f.mapping_id)]
    return Policy(f"survivorship-policy-v1-{canonical_hash(content)[:16]}", tuple(fields))
