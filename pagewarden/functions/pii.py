"""Personal-data findings as column expressions.

A rules table stands in for a language model; `operators.detectors` plugs one in.
Patterns use only what Java and RE2 regular expressions share.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewarden.constants import (
    DEFAULT_THRESHOLD,
    PII_GROUPS,
    SAFE_MESSAGE,
    UNSAFE_MESSAGE,
)
from pagewarden.schema import ENTITY


@dataclass(frozen=True)
class Rule:
    """One pattern. `needs` is a character every match holds: a text without it
    is passed over without running the pattern."""

    entity_group: str
    pattern: str
    score: float
    needs: str = ""

    def found(self, text: Column) -> Column:
        """All findings of a text, by place."""
        words = F.transform(
            F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0)),
            lambda word: F.struct(
                F.lit(self.entity_group).alias("entity_group"),
                word.alias("word"),
                F.lit(self.score).alias("score"),
            ),
        )
        if self.needs:
            return F.when(F.contains(text, F.lit(self.needs)), words).otherwise(_no_entities())
        return F.coalesce(words, _no_entities())

    def hit(self, text: Column, threshold: float, groups: Iterable[str]) -> Column | None:
        """Whether a text holds a finding that counts; none if this rule's never do."""
        if self.entity_group not in set(groups) or self.score < threshold:
            return None
        found = F.rlike(text, F.lit(self.pattern))
        return F.contains(text, F.lit(self.needs)) & found if self.needs else found


# Rules table. SECRET is no listed group and DATE_TIME scores below the default
# threshold, so both are found but neither rejects a text by default.
RULES = [
    # Counted repeats, as long as addresses may be: an open one takes time with the
    # square of a long run of letters, and stack for every label of a domain.
    Rule(
        "EMAIL_ADDRESS",
        r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){1,126}",
        0.99,
        "@",
    ),
    Rule("CREDIT_CARD", r"\b[0-9]{13,16}\b", 0.95),
    Rule("SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.95, "-"),
    Rule("IP_ADDRESS", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", 0.90, "."),
    Rule("PHONE_NUMBER", r"(?:\([0-9]{3}\) |\b[0-9]{3}-)?\b[0-9]{3}-[0-9]{4}\b", 0.85, "-"),
    Rule("DATE_TIME", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", 0.70, "-"),
    Rule("SECRET", r"\b[0-9a-f]{40}\b", 0.90),
]


def _no_entities() -> Column:
    return F.array().cast(f"array<{ENTITY.simpleString()}>")


def entities(text: Column, rules: Iterable[Rule] = RULES) -> Column:
    """All findings of a text, in rule order and then by place in the text.

    Lists of phrases (`functions.phrases.PhraseList`) may stand among the rules.
    """
    return F.concat(_no_entities(), *[rule.found(text) for rule in rules])


def listed(
    found: Column,
    threshold: float = DEFAULT_THRESHOLD,
    groups: Iterable[str] = PII_GROUPS,
) -> Column:
    """Findings of a listed group whose score reaches the threshold."""
    wanted = list(groups)
    return F.filter(found, lambda e: e["entity_group"].isin(wanted) & (e["score"] >= threshold))


def has_pii(
    text: Column,
    threshold: float = DEFAULT_THRESHOLD,
    rules: Iterable[Rule] = RULES,
    groups: Iterable[str] = PII_GROUPS,
) -> Column:
    """Yes or no only: stops at the first match and builds no findings."""
    groups = list(groups)
    tests = [hit for rule in rules if (hit := rule.hit(text, threshold, groups)) is not None]
    any_hit = reduce(lambda a, b: a | b, tests, F.lit(False))
    return F.coalesce(any_hit, F.lit(False))


def warnings(found: Column) -> Column:
    """Array of `word (group)`."""
    return F.transform(found, lambda e: F.format_string("%s (%s)", e["word"], e["entity_group"]))


def verdict(found: Column) -> Column:
    """Message for the writer of a text, given its listed findings."""
    described = F.transform(
        found,
        lambda e: F.format_string("%s (%s, %.2f)", e["word"], e["entity_group"], e["score"]),
    )
    return F.when(
        F.size(found) > 0, F.concat(F.lit(UNSAFE_MESSAGE), F.array_join(described, ", "))
    ).otherwise(F.lit(SAFE_MESSAGE))
