"""What a rule job is, and the registry of jobs, which users can extend."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from nearmark.operators.joins import size_bound, sliced_join
from nearmark.schemas import KEPT_RULE_COLUMNS, PAIR_KEY, RESULT_COLUMNS, RESULT_TYPES, RULE_VALUES


@dataclass(frozen=True)
class Options:
    """How rules are evaluated.

    ``substring_mode``: ``parity`` slides the window of the substring rules by growing steps,
    ``exhaustive`` visits every window.
    ``shortcut_distance``: leave out the distance of a mismatch when the lengths alone rule it out.
    """

    substring_mode: str = "parity"
    shortcut_distance: bool = False


@dataclass(frozen=True)
class RuleJob:
    """One rule type as a set-level job.

    ``find(parts, rules, profile, options)`` returns the matching pairs of a distinct parts table and
    the rules of this type. ``score(pairs, options)`` adds the result columns to any pairs, matching
    or not. A job without its own ``find`` scores every pair of a chain.
    """

    rule_type: str
    score: Callable[[DataFrame, Options], DataFrame]
    find: Callable[[DataFrame, DataFrame, Row, Options], DataFrame] | None = None
    params: tuple[str, ...] = field(default=())

    def slim(self, rules: DataFrame) -> DataFrame:
        """Rules of this type with only the columns the job reads."""
        wanted = ["chain_id", *KEPT_RULE_COLUMNS, "target", *self.params]
        return rules.where(F.col("rule_type") == self.rule_type).select(*dict.fromkeys(wanted))

    def matches(self, parts: DataFrame, rules: DataFrame, profile: Row, options: Options) -> DataFrame:
        slim = self.slim(rules)
        if self.find is not None:
            found = self.find(parts, slim, profile, options)
        else:
            pairs = sliced_join(parts.select("chain_id", "part"), slim, ["chain_id"], size_bound(profile))
            found = self.score(pairs, options).where("match")
        return found.select(*RESULT_COLUMNS)


JOBS: dict[str, RuleJob] = {}


def register(job: RuleJob) -> RuleJob:
    JOBS[job.rule_type] = job
    return job


def register_rule(rule_type: str, score: Callable[[DataFrame], DataFrame],
                  find: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> RuleJob:
    """Add a rule type of your own.

    ``score`` gets pairs with ``part``, ``target`` and ``rule_values`` (the JSON text of the rule's
    values) and adds ``match`` and, if it has any, ``metadata`` (a JSON object as text) and ``error``.
    ``find`` gets ``(parts, rules)`` and returns candidate pairs; without it every pair is scored.
    """
    if rule_type in RULE_VALUES:
        raise ValueError(f"{rule_type} is a built-in rule type")

    def full_score(pairs: DataFrame, options: Options) -> DataFrame:
        scored = score(pairs)
        missing = {n: F.lit(None).cast(t) for n, t in RESULT_TYPES.items() if n not in scored.columns}
        return scored.withColumns(missing)

    def full_find(parts: DataFrame, rules: DataFrame, profile: Row, options: Options) -> DataFrame:
        candidates = find(parts.select("chain_id", "part"), rules)
        return full_score(candidates.dropDuplicates(PAIR_KEY), options).where("match")

    return register(RuleJob(rule_type, full_score, full_find if find else None, ("rule_values",)))


def unregister_rule(rule_type: str) -> None:
    if rule_type not in RULE_VALUES:
        JOBS.pop(rule_type, None)


def custom_types() -> list[str]:
    return [t for t in JOBS if t not in RULE_VALUES]


def used_jobs(profile: Iterable[str]) -> list[RuleJob]:
    return [JOBS[t] for t in sorted(profile)]
