"""Rules in layers (D11): a rule may read what other rules and the lender statistics give.

:class:`~.rules.RuleSpec` names in ``reads`` the further columns that its predicate
needs. A rule that reads only application, cluster and pair columns is in layer 0;
the lender/state statistics are aggregates of layer 0's violation table, so a rule
that reads a statistic comes after it, and a rule that reads another rule's score
comes after that rule. The order follows from ``reads`` alone; a cycle is an error.

The audit's default rule set stays as it is: :func:`layered_rules` is the opt-in set in which
the two documented rules R002 and R009 are evaluated, too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import dlit, label_map
from . import rules as R

# ---- parameters of R002 and R009, whose published text names no numbers ---------
LOW_INCOME = 50.0  # below the lowest income band's upper bound, in thousands
HIGH_DTI = 0.43
SUBPRIME_SPREAD = 1.5
CONFIDENCE = 0.85
#: The evidence level of an application as a number.
LEVEL_CONFIDENCE = {R.HIGH_EVIDENCE: 0.95, R.MEDIUM_EVIDENCE: 0.8, R.LOW_EVIDENCE: 0.5}
# ---------------------------------------------------------------------------------
BLOCK = ("lei", "state_code")
SIGNIFICANCE = ("white_black_significant", "white_hispanic_significant", "male_female_significant")


def layered_rules(low_income: float = LOW_INCOME, high_dti: float = HIGH_DTI,
                  subprime_spread: float = SUBPRIME_SPREAD, confidence: float = CONFIDENCE) -> list[R.RuleSpec]:
    """The audit's nine rules with R002 and R009 evaluated.

    R002 hits an approved application of low income, high DTI and a subprime rate with a
    denied similar application, of whatever demographics, as the rule's text has no word on them. R009 hits an application whose evidence
    level counts as more than ``confidence`` in a lender/state with a significant difference."""
    c = F.col
    weak = (c("income") < dlit(low_income)) & (c("calculated_dti_ratio") > dlit(high_dti)) & (
        c("rate_spread_adj") >= dlit(subprime_spread))
    significant = F.lit(False)
    for name in SIGNIFICANCE:
        significant = significant | F.coalesce(c(name), F.lit(False))
    sure = label_map(c("ai_confidence_level"), LEVEL_CONFIDENCE, 0.0) > dlit(confidence)
    filled = {
        "R002": {"row": weak & c("approved"), "pair": ~c("similar_approved"), "pair_mode": "exists", "reads": ("income", "rate_spread_adj")},
        "R009": {"row": sure & significant, "reads": ("ai_confidence_level", *SIGNIFICANCE)},
    }
    return [replace(r, **filled.get(r.rule_id, {})) for r in R.default_rules()]


def rule_layers(rules: Sequence[R.RuleSpec], statistics: Sequence[str] = SIGNIFICANCE,
                totals: Sequence[str] = R.VIOLATION_TOTALS) -> list[list[R.RuleSpec]]:
    """The evaluated rules by layer. ``statistics`` and ``totals`` name columns that layer 0
    feeds; a rule reading one comes after it."""
    rules = [r for r in rules if r.evaluated]
    giver = {r.column: r for r in rules}
    layer: dict[str, int] = {}

    def of(r: R.RuleSpec, path: tuple[str, ...]) -> int:
        if r.rule_id in path:
            raise ValueError(f"rules read each other: {' -> '.join((*path, r.rule_id))}")
        if r.rule_id not in layer:
            before = [of(giver[name], (*path, r.rule_id)) for name in r.reads if name in giver]
            before += [0 for name in r.reads if name in statistics or name in totals]
            layer[r.rule_id] = max(before) + 1 if before else 0
            if layer[r.rule_id] and r.pair is not None:
                raise ValueError(f"{r.rule_id}: a pair predicate is evaluated in the first layer")
        return layer[r.rule_id]

    depth = max((of(r, ()) for r in rules), default=-1) + 1
    return [[r for r in rules if layer[r.rule_id] == k] for k in range(depth)]


def evaluate_layers(embedded: DataFrame, clusters: DataFrame, pairs: DataFrame, rules: Sequence[R.RuleSpec],
                    statistics: Callable[[DataFrame], DataFrame],
                    store: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The violation table of all layers.

    Layer 0 is the audit's violation table (one join of applications, clusters and pair
    evidence); ``store`` may write it, as both ``statistics`` (violations to one row a lender/state)
    and the later layers read it. Its statistics are joined once, by lender and state; every later
    layer adds its scores in one projection. Total and severity cover all layers; the
    evidence level is that of layer 0. A lender/state without statistics has null ones.
    """
    first, *later = rule_layers(rules)
    evidence = R.pair_evidence(pairs, first)
    violations = store(R.evaluate_rules(embedded, clusters, evidence, first, carry=("has_race_pair", "has_gender_pair")))
    columns = violations.columns
    if not later:
        return violations
    reads = {name for layer in later for r in layer for name in r.reads} - set(columns)
    given = statistics(violations)
    wanted = [name for name in given.columns if name in reads]
    out = violations.join(given.select(*BLOCK, *wanted), list(BLOCK), "left")
    for layer in later:
        out = out.withColumns({r.column: F.when(r.row, dlit(r.weight)).otherwise(dlit(0.0)) for r in layer})
        out = out.withColumn("total_ai_violation_score", sum((F.col(r.column) for r in layer), F.col("total_ai_violation_score")))
    scores = [r.column for layer in later for r in layer]
    return out.withColumn("ai_violation_severity", R.severity()).select(*columns, *scores)
